"""Line dedup: two Bloom filters find the lines that may repeat, and only those are shuffled and counted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_bytes, fill_partitions, id_and_text
from palimpsest.sources.scratch import cut

#: Bits of either filter: 64 MB as it is sent to the tasks, whatever the input is.
BITS = 1 << 29
#: Bits of a block of a filter; a line sets two bits of one block.
_BLOCK = 1 << 16
_HASHES = 2
#: Hashes that a task gathers before it hands on the bits they set.
_GATHERED = 1 << 21
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """(number, key) of the lines whose keys have at least so many code points."""
    for i, line in enumerate(text.split(b"\n")):
        if len(line) < least:
            continue
        key = line.strip(_SPACE).lower()  # of bytes: ASCII letters only
        if len(key) >= 4 * least or len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
            yield i, key


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """One row of places in a filter for each hash."""
    shift = np.uint64(64 - (bits // _BLOCK).bit_length() + 1)
    block = (h >> shift << np.uint64(16)) if bits > _BLOCK else np.zeros(len(h), np.uint64)
    return np.stack([block | (h >> np.uint64(16 * k) & np.uint64(_BLOCK - 1)) for k in range(_HASHES)], axis=1).astype(np.int64)


def _by_block(places: np.ndarray, blocks: np.ndarray) -> pa.Array:
    """The places inside each of the blocks, as 16-bit numbers; places are sorted."""
    ends = np.searchsorted(places, np.append(blocks, blocks[-1] + 1) << 16)
    data = np.ascontiguousarray((places & (_BLOCK - 1)).astype("<u2"))
    return pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(data)])


def _set_bits(texts: DataFrame, least: int, bits: int) -> DataFrame:
    """(block, once, twice): for blocks of both filters the places that some documents set, those of lines of two of them in twice."""

    def part(gathered: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(gathered), return_counts=True)
        once, twice = np.unique(_places(h, bits)), np.unique(_places(h[n > 1], bits))
        blocks = np.unique(once >> 16)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), _by_block(once, blocks), _by_block(twice, blocks)], ["block", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                own = {xxhash.xxh64_intdigest(key) for _, key in line_keys(text, least)}
                if own:
                    gathered.append(np.fromiter(own, np.uint64, len(own)))
                    size += len(own)
            if size >= _GATHERED:
                yield part(gathered)
                gathered, size = [], 0
        if gathered:
            yield part(gathered)

    return texts.select("text").mapInArrow(run, "block long, once binary, twice binary")


def _merged(parts: DataFrame) -> DataFrame:
    """(block, seen): the second filter, of bits set for two documents; rows of a block are read one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "seen"]
        at, once, twice = None, np.zeros(_BLOCK, bool), np.zeros(_BLOCK, bool)
        for batch in batches:
            out = []
            for block, first, second in zip(*(batch.column(k) for k in range(3)), strict=True):
                if block.as_py() != at:
                    if twice.any():
                        out.append((at, np.packbits(twice).tobytes()))
                    at = block.as_py()
                    once[:] = twice[:] = False
                set_now = np.frombuffer(first.as_buffer(), "<u2")
                twice[set_now] |= once[set_now]
                once[set_now] = True
                twice[np.frombuffer(second.as_buffer(), "<u2")] = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names)
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names)

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, seen binary")


def _suspects(texts: DataFrame, seen, least: int, bits: int) -> DataFrame:
    """(doc_id, mark, key, lines): lines that the second filter knows, once for each document, by the SHA-256 of their keys."""
    id_type = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seen.value.reshape(-1)
        for batch in batches:
            row, digest, lines = [], [], []
            for r, text in enumerate(as_bytes(batch.column("text"))):
                own: dict[bytes, list[int]] = {}
                for i, key in line_keys(text, least):
                    own.setdefault(key, []).append(i)
                if not own:
                    continue
                at = _places(np.array([xxhash.xxh64_intdigest(key) for key in own], np.uint64), bits)
                found = np.all(known[at >> 3] >> (7 - (at & 7)) & 1, axis=1)
                for (key, where), suspect in zip(own.items(), found.tolist(), strict=True):
                    if suspect:
                        row.append(r)
                        digest.append(hashlib.sha256(key).digest())
                        lines.append(where)
            row = pa.array(row, pa.int64())
            columns = [batch.column("doc_id").take(row), batch.column("mark").take(row), pa.array(digest, pa.binary()), pa.array(lines, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "key", "lines"])

    return texts.mapInArrow(run, f"doc_id {id_type}, mark long, key binary, lines array<int>")


def _without_lines(rows: DataFrame) -> DataFrame:
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(as_bytes(batch.column("text")), batch.column("gone"), strict=True):
                lines, gone = text.split(b"\n"), set(gone.as_py() or ())
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            columns = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_lines long, n_dropped long, kept string")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, keep: str = "largest", bits: int = BITS) -> DataFrame:
    r"""One row per input row: doc_id, n_lines, n_dropped, kept (the lines that stay, joined by \n).

    A line's key is the line without ASCII white space at its ends and with A-Z in
    lower case. A key of at least `least_chars` code points that stands in at least
    `least_docs` documents loses its lines in all of them but the one of the
    `keep` (largest or smallest) id; other lines stay.

    A first scan sets bits for the hashes of such lines: a filter of bits set by a
    document, and one of bits set by two. Tasks hand on which bits they set, block
    by block (four bytes for a line); a bit that two of them set goes to the second
    filter, so every line of two documents is found there. It is sent to a second
    scan, in which only lines that it knows are handed on, by their SHA-256, and
    these are counted exactly. Both filters have `bits` bits, of which a task that
    merges holds one block; more lines than they can tell apart make more lines
    suspect (a tenth of 300 million lines at 2^29 bits), which costs shuffle, never
    a right answer. What is left for a document are the numbers of its lines to
    drop, joined by id. A line that stands in a third of all documents is counted
    on the map side; where it meets its documents again the join is split by
    adaptive execution.

    Null and empty texts are one empty line; one of any length is read whole, and a
    text may lose all its lines. Rows that share an id are one document: their
    lines count once, and stay in all of them if the id is the one that keeps. So
    are rows without an id, which come before any id and never keep a line. An
    empty table gives an empty result; other columns are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be largest or smallest")
    if bits < _BLOCK or bits & bits - 1:
        raise ValueError(f"bits must be a power of two, {_BLOCK} or more")
    source = fill_partitions(id_and_text(docs, id_col, text_col))
    plain = source.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty()
    mark = F.lit(0).cast("long") if plain else F.xxhash64(F.coalesce("text", F.lit("")))
    texts = source.select("doc_id", mark.alias("mark"), "text")

    second = np.zeros((bits // _BLOCK, _BLOCK // 8), np.uint8)
    for r in _merged(_set_bits(texts, least_chars, bits)).toLocalIterator():  # at most all blocks of one filter
        second[r.block] = np.frombuffer(r.seen, np.uint8)
    seen = docs.sparkSession.sparkContext.broadcast(second)
    found = cut(_suspects(texts, seen, least_chars, bits))
    seen.unpersist()

    found = found if plain else found.dropDuplicates(["doc_id", "mark", "key"])
    holders = found if plain else found.select("key", "doc_id").distinct()
    holder = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    # Written first: a side that is aggregated in the stage of the join would keep it from being split.
    decided = cut(holders.groupBy("key").agg(F.count(F.lit(1)).alias("n"), holder.alias("holder")).filter(F.col("n") >= least_docs).select("key", "holder"))
    gone = found.join(decided, "key").filter("not (doc_id <=> holder)")
    gone = gone.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("id_mark")).agg(F.flatten(F.collect_list("lines")).alias("gone"))
    rows = texts.join(gone, texts["doc_id"].eqNullSafe(gone["id"]) & (texts["mark"] == gone["id_mark"]), "left")
    return _without_lines(rows.select("doc_id", "text", "gone"))
