"""Benchmark decontamination: a prefix-filtered join of item windows with document shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import as_bytes, fill_partitions, id_and_text
from palimpsest.sources.scratch import cut

#: A-Z to a-z; digits, letters and bytes above 0x7F stay; all else separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP = 1 << 18


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class _Windows:
    """The distinct windows of a block of items, and their shingles as integers."""

    def __init__(self, items: list[tuple[object, bytes]], window: int, shingle: int):
        vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], dict[object, None]] = {}
        for item, text in items:
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), {})[item] = None
        self.vocab, self.shingle, self.base = vocab, shingle, len(vocab) + 1
        self.owners = [list(x) for x in owners.values()]
        #: by length of the shingle (shorter where the item is): window ids, and for each its shingles
        self.groups = {}
        for wid, ids in enumerate(owners):
            k = min(shingle, len(ids))
            self.groups.setdefault((k, len(ids)), []).append((wid, ids))
        self.codes = {k: np.unique(np.concatenate([self.code(np.array([x for _, x in g]), k).ravel() for (n, _), g in self.groups.items() if n == k])) for k in {k for k, _ in self.groups}}
        self.prefix: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}

    def code(self, ids: np.ndarray, k: int) -> np.ndarray:
        """The shingles of k consecutive ids along the last axis; 0 where a word is in no item."""
        n = ids.shape[-1] - k + 1
        if n <= 0:
            return np.zeros((*ids.shape[:-1], 0), np.int64)
        code, known = np.zeros((*ids.shape[:-1], n), np.int64), np.ones((*ids.shape[:-1], n), bool)
        for j in range(k):
            part = ids[..., j : j + n]
            code = code * self.base + part
            known &= part > 0
        return np.where(known, code, 0)

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle: containment of all shingles needs a prefix of one."""
        for (k, length), group in self.groups.items():
            ids = np.array([x for _, x in group], np.int64)
            codes = self.code(ids, k)
            at = np.argmin(counts[k][np.searchsorted(self.codes[k], codes)], axis=1)
            key = codes[np.arange(len(ids)), at]
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self.prefix[k, length] = (keys, np.append(first, len(order)), at[order], ids[order], np.array([w for w, _ in group])[order])


def _encode(index: _Windows, text: bytes) -> np.ndarray:
    get = index.vocab.get
    words = words_of(text)
    return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def _present(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of codes that are among the sorted keys, and which key each is."""
    at = np.flatnonzero(codes)
    which = np.searchsorted(keys, codes[at])
    found = keys[np.minimum(which, len(keys) - 1)] == codes[at]
    return at[found], which[found]


def _matches(index: _Windows, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Starts, length and window ids of all windows that stand in a document."""
    codes = {k: index.code(ids, k) for k in index.codes}
    for (k, length), (keys, first, offset, words, wids) in index.prefix.items():
        at, which = _present(keys, codes[k])
        sizes = first[which + 1] - first[which]
        block = np.cumsum(sizes) // _STEP
        for b in np.unique(block):
            p, w, n = at[block == b], which[block == b], sizes[block == b]
            row = np.repeat(first[w] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            start = np.repeat(p, n) - offset[row]
            fits = (start >= 0) & (start + length <= len(ids))  # what is left on either side of the shingle
            start, row = start[fits], row[fits]
            for j in range(length):
                same = ids[start + j] == words[row, j]
                start, row = start[same], row[same]
            if len(start):
                yield start, length, wids[row]


def _count(docs: DataFrame, index: _Windows) -> dict[int, np.ndarray]:
    """How often each shingle of the windows stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        sums = {k: np.zeros(len(c), np.int64) for k, c in ix.codes.items()}
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                ids = _encode(ix, text)
                for k, keys in ix.codes.items():
                    _, which = _present(keys, ix.code(ids, k))
                    if len(which):
                        np.add.at(sums[k], which, 1)
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(s[at])], ["k", "at", "n"])

    rows = docs.select("text").mapInArrow(run, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = {k: np.zeros(len(c), np.int64) for k, c in index.codes.items()}
    for k in counts:
        mine = rows.filter(pc.equal(rows["k"], k))
        counts[k][mine["at"].to_numpy()] = mine["n"].to_numpy()
    return counts


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _search(docs: DataFrame, index: _Windows, item_type: str, doc_type: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            texts = batch.column("text")
            total, spans, items = [], [], []
            for text, old_spans, old_items in zip(as_bytes(texts), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                ids = _encode(ix, text)
                mask, owners = None, {}
                for start, length, wids in _matches(ix, ids):
                    mask = np.zeros(len(ids) + 1, np.int64) if mask is None else mask
                    np.add.at(mask, start, 1)
                    np.add.at(mask, start + length, -1)
                    for w in np.unique(wids):
                        owners.update(dict.fromkeys(ix.owners[w]))
                if mask is not None:
                    hit = np.cumsum(mask)[:-1] > 0
                    for s in old_spans:
                        hit[s["start"] : s["end"]] = True
                    old_spans = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in _spans(hit)), strict=True)]
                    old_items = list(dict.fromkeys([*old_items, *owners]))
                total.append(len(ids))
                spans.append(old_spans)
                items.append(old_items)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), texts, pa.array(total, pa.int64()), pa.array(spans, span), pa.array(items, batch.schema.field("items").type)],
                ["doc_id", "text", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, f"doc_id {doc_type}, text string, n_words long, spans array<struct<start:long,end:long>>, items array<{item_type}>")


def _indexes(docs: DataFrame, items: DataFrame, window: int, shingle: int, block_bytes: int) -> Iterator[_Windows]:
    """Items (item, text) in blocks: their windows, with the rarest shingle of each over all documents (text)."""
    items = cut(items.distinct())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    for block in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        rows = part.toArrow()
        index = _Windows(list(zip(rows["item"].to_pylist(), as_bytes(rows["text"]), strict=True)), window, shingle)
        if index.groups:
            index.choose(_count(docs, index))
        yield index


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (hit word ranges, end exclusive), items (ids with a window in it).

    An item's windows are its runs of `window` words; an item of fewer words, but
    not none, is one window. Each window is a set of shingles that must all stand
    in the document, so a prefix of one shingle is enough: the rarest over all
    documents. Shingles of the documents are joined with those prefixes, the
    shingle's place in the window bounds where the window can start and end, and
    the words themselves are then compared.

    Items, each once, are sent to the executors in blocks of about `block_bytes` of
    text, however large the benchmark is; each block is one more pass over a
    document inside the same job, so nothing of unbounded size is broadcast or in
    the driver at once, and documents are never shuffled.

    A null or empty document has no words and no hit; a null or empty item has no
    window; an item id may repeat or be null (null is reported as an item). An
    empty table on either side gives rows without hits, or no rows. Repeated
    documents get a row each; other columns are not read. Texts of any length are
    read whole.
    """
    docs = fill_partitions(id_and_text(docs, id_col, text_col))
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    doc_type, item_type = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item"]
    found = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.expr(f"cast(array() as array<{item_type}>)").alias("items"))
    for index in _indexes(docs, items, window, shingle, block_bytes):
        found = _search(found, index, item_type, doc_type)
    return found.drop("text")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no window of an item stands; see decontaminate().

    A row is judged by its text alone, so repeated rows and rows without an id are
    judged like any other. Null and empty texts stay; an empty benchmark leaves all
    rows. Only the text passes through Python, where the rows lie.
    """
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    for index in _indexes(texts, items, window, shingle, block_bytes):
        docs = docs.filter(~_holds(docs.sparkSession, index)(F.col(f"`{text_col}`")))
    return docs


def _holds(spark: SparkSession, index: _Windows):
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def holds(text: pa.Array) -> pa.Array:
        ix = shared.value
        return pa.array([next(_matches(ix, _encode(ix, x)), None) is not None for x in as_bytes(text)], pa.bool_())

    return holds
