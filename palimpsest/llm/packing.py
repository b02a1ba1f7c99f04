"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm.common import as_bytes, fill_partitions, id_and_text
from palimpsest.sources.scratch import cut

#: Distinct words of a generation that a worker remembers the ids of; it keeps two generations, of about 270 bytes a word.
REMEMBERED = 300_000
#: Any other character sends a text to the tokenizer as a whole: white space and normal forms need its own rules.
_OTHER = re.compile(r"[^\x20-\x7E\n\t\rÀ-ÖØ-öø-ÿ]").search
#: Bytes of text, and texts, whose words are looked up together.
_AT_ONCE, _ROWS = 1 << 23, 4096
#: Of these, words whose ids are looked up in Python at once, and texts whose ids are put together at once.
_WORDS, _TEXTS = 1 << 14, 256
#: Rows that one window of equal lengths may hold.
_RANKED = 100_000


def _with_tail(word: str) -> tuple[str, ...]:
    """A word, and apart from it the stops behind its last letter or digit: a tokenizer that splits words from signs cuts there."""
    own = word.rstrip(".,;:!?")
    return (own, word[len(own) :]) if own != word and own and own[-1].isalnum() else (word,)


class _Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    A tokenizer that drops white space splits at it first, so what stands between
    two spaces has the same ids in any text; those are remembered. Where it splits
    words from signs too, a comma or stop behind a word is looked up apart, and
    where it lowers case so are the words, so a word is remembered in one form.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        splits = (known.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        normal = known.get("normalizer") or {}
        self.lowers = any(x.get("type") == "Lowercase" for x in normal.get("normalizers", [normal]))
        self.wordwise = splits.get("type") == "Split" and splits.get("behavior") == "Removed" and splits.get("invert") is True and r"[^\s\p{L}\p{N}]" in splits["pattern"].get("Regex", "")

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each of some texts; every different word of them is looked up once."""
        whole = [not self.wordwise or bool(_OTHER(x)) or any(s in x for s in self.specials) for x in texts]
        out = iter(self.direct([x for x, y in zip(texts, whole, strict=True) if y]))
        plain = pa.array([x for x, y in zip(texts, whole, strict=True) if not y], pa.large_string())
        lists = pc.utf8_split_whitespace(pc.utf8_lower(plain) if self.lowers else plain)
        counts, words = pc.list_value_length(lists).to_numpy(), lists.flatten().dictionary_encode()
        del plain, lists  # words in whole lists, and their ids in Python, would be most of a worker's memory
        flat, sizes = self._ids_of(words.dictionary)
        first, code, ends = np.cumsum(sizes) - sizes, words.indices.to_numpy(), np.cumsum(counts)
        found = chain.from_iterable(self._put_together(flat, first, sizes, code, counts[at : at + _TEXTS], ends[at : at + _TEXTS]) for at in range(0, len(counts), _TEXTS))
        return [next(out if y else found) for y in whole]

    @staticmethod
    def _put_together(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, code: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """Ids of a few texts that follow each other, of so many words up to those ends."""
        code = code[int(ends[0] - counts[0]) : int(ends[-1])]
        n = sizes[code]
        end = np.concatenate(([0], np.cumsum(n)))
        every = flat[np.repeat(first[code] - end[:-1], n) + np.arange(end[-1])]
        cuts = end[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return (every[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has; _WORDS of them are Python's at once."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words), _WORDS):
            ids = self._looked_up(words.slice(at, _WORDS).to_pylist())
            flat.append(np.frombuffer(b"".join(ids), "<u4"))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        return np.concatenate(flat), np.concatenate(sizes)

    def _looked_up(self, words: list[str]) -> list[bytes]:
        known = self.known
        parts = list(map(known.get, words))
        apart = {i: _with_tail(words[i]) for i, x in enumerate(parts) if x is None}
        missing = [x for x in dict.fromkeys(chain.from_iterable(apart.values())) if x not in known]
        found = {x: self.before[x] for x in missing if x in self.before}
        new = [x for x in missing if x not in found]
        found.update(zip(new, self._apart(new), strict=True))
        for i, own in apart.items():
            parts[i] = b"".join([found[x] if x in found else known[x] for x in own])
        if len(known) + len(found) > self.remembered:  # what comes back is taken over from the generation before
            self.before, self.known = known, found
        else:
            known.update(found)
        return parts

    def _apart(self, words: list[str]) -> list[bytes]:
        """Ids of each of some words: of one in ASCII letters by the model alone, as no rule cuts or changes it; of the rest from one call on all of them."""
        if not self.lowers:
            return self._cut_apart(words)
        plain = [x.isascii() and x.isalpha() for x in words]
        rest = iter(self._cut_apart([x for x, y in zip(words, plain, strict=True) if not y]))
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(x)]).tobytes() if y else next(rest) for x, y in zip(words, plain, strict=True)]

    def _cut_apart(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        at = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        cuts = np.concatenate(([0], np.searchsorted(at, ends)))
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _groups(texts: Iterator[bytes]) -> Iterator[list[str]]:
    """Texts a few at a time, of _AT_ONCE bytes or so."""
    group, size = [], 0
    for text in texts:
        group.append(text.decode("utf-8", "replace"))
        size += len(text)
        if size >= _AT_ONCE or len(group) >= _ROWS:
            yield group
            group, size = [], 0
    if group:
        yield group


@lru_cache(maxsize=2)
def _encoder(path: str, remembered: int) -> _Encoder:
    """One encoder for all tasks of a Python worker, so that what it remembers outlives a task."""
    return _Encoder(path, remembered)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, digest: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Token ids of whole texts, then end_id, cut only where longer than capacity.

    Returns doc_id, piece (from 0), start (ids of the document before it), length,
    and ids (array of int), or with `digest` their ids_crc32 (CRC-32 of the
    little-endian unsigned 32-bit ids) in place of ids. A null or empty text is
    end_id alone. Rows keep their task: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, remembered)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            row, piece, start, length, out = [], [], [], [], []
            for i, found in enumerate(chain.from_iterable(map(encoder.encode, _groups(as_bytes(batch.column(1)))))):
                ids = found + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    out.append(zlib.crc32(part) if digest else np.frombuffer(part, "<i4"))
            last = pa.array(out, pa.int64()) if digest else pa.array(out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pc.take(batch.column(0), pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), last],
                ["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids"],
            )

    texts = fill_partitions(id_and_text(docs, id_col, text_col))
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, " + ("ids_crc32 long" if digest else "ids array<int>"))


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, first bin, pieces per bin, offset).

    The pieces of a length, ranked from 0, fill the bins of a row in order from
    the first bin on, so many in each, from the offset on. Lengths above a third
    of the capacity share a bin with at most one other of the kind: the longest is
    matched with the longest that still fits. The rest, longest first, go to the
    bin whose gap they leave smallest, or to a new one. The plan has a few rows
    for each length, whatever the counts are.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    rank: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def place(length: int, first: int, n_bins: int, each: int, gap: int) -> None:
        """n_bins bins with this gap get `each` pieces of the length."""
        plan.append((length, rank[length], first, each, capacity - gap))
        rank[length] += n_bins * each
        left[length] -= n_bins * each

    def leave(gap: int, first: int, n_bins: int) -> None:
        if gap and n_bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n_bins))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] < 2:
            b = large[at - 1] if at > 0 else None
        n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        place(a, bins, n, 1, capacity)
        if b is not None:
            place(b, bins, n, 1, capacity - a)
        leave(capacity - a - (b or 0), bins, n)
        bins += n
        large = [x for x in large if left[x]] if not left[a] or (b is not None and not left[b]) else large
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first = capacity, bins
                n = max(1, left[s] // (capacity // s))
                bins += n
            each = min(gap // s, left[s])
            used = min(n, left[s] // each)
            place(s, first, used, each, gap)
            leave(gap - each * s, first, used)
            leave(gap, first + used, n - used)
    return plan


def pack(pieces: DataFrame, capacity: int = 4096, order_by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` from 1 to capacity; all other columns stay.

    Only the histogram of lengths, of at most `capacity` rows, comes to the
    driver; plan_bins turns it into a plan of bounded size, which every task
    applies to its rows. A row's place follows from its rank among the rows of its
    length: lengths are dealt into buckets of bounded size, so a length that a
    third of all rows share is ranked in many tasks. Each sequence is filled
    gaplessly from 0. An empty table gives an empty result. Rows of a length out
    of range raise.
    """
    pieces = cut(pieces)
    sizes = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if sizes and (min(sizes) < 1 or max(sizes) > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = sorted(plan_bins(sizes, capacity))
    n_buckets = max(1, -(-max(sizes.values(), default=1) // _RANKED))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order_by), F.lit(n_buckets)))
    if n_buckets > 1:
        # starts has a row for each length and bucket that occurs: at most `capacity` rows for each _RANKED rows of input
        counts = dealt.groupBy("length", "_bucket").count()
        before = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
        starts = counts.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
        dealt = dealt.join(starts, ["length", "_bucket"])
    else:
        dealt = dealt.withColumn("_start", F.lit(0).cast("long"))
    rest = [c for c in pieces.columns if c not in order_by]
    in_bucket = Window.partitionBy("length", "_bucket").orderBy(*order_by, *[c for c in rest if c != "length"])
    ranked = dealt.withColumn("_rank", F.col("_start") + F.row_number().over(in_bucket) - 1).drop("_start", "_bucket")
    length, first_rank, first_bin, each, offset = (np.array([p[i] for p in plan], np.int64) for i in range(5))
    shared = pieces.sparkSession.sparkContext.broadcast(((length << 44) | first_rank, first_rank, first_bin, each, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first_rank, first_bin, each, offset = shared.value
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (n << 44) | r, side="right") - 1
            k = r - first_rank[at]
            sequence, place = first_bin[at] + k // each[at], offset[at] + k % each[at] * n
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(place)], [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    return ranked.select(*pieces.columns, "_rank").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, digest: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenize whole texts, cut the longest and pack all pieces; see token_pieces and pack.

    A worker remembers the ids of up to twice `remembered` words, for speed alone.

    Null and empty texts give a piece of one id; very long ones give as many
    pieces as they need; repeated rows are packed each; a null id is kept; an
    empty table gives an empty result; other columns are not read.
    """
    return pack(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, digest=digest, remembered=remembered), capacity)
