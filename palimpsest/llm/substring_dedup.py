"""Removal of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import as_bytes, fill_partitions, id_and_text, in_pieces
from palimpsest.sources.scratch import cut, shared_folder

#: Bytes of a trigger. Each string of the length searched for holds at least one.
TRIGGER = 20
#: A longer text is parsed in sections of so many bytes.
SECTION = 1 << 25
#: Bytes of text whose phrases a task holds at once, if it isn't one text; a phrase takes far more than the 15 bytes it stands for.
_PIECE = 1 << 23
_PLACE = np.uint64((1 << 26) - 1)
_NO_ID = (1 << 63) - 1
#: Of so many documents one shows which triggers are hot, and every text of so many bytes does; a hot one has more than a quarter of a task's share of rows, and so many at least.
_EVERY, _LONG, _HOT_ROWS = 256, 1 << 20, 16_384
_SEVERAL = 1 << 24
_START, _HOT = 0x7FFFFFFF, 1 << 8


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint64(0x9E3779B97F4A7C15) ^ (left >> np.uint64(29))) + right


def _rolling(a: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    powers, n = {1: a.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * n <= k:
        h = powers[n]
        powers[2 * n] = _mix(h[: len(h) - n], h[n:])
        n *= 2
    h = powers[n]
    while n < k:
        m = max(x for x in powers if x <= k - n)
        size = len(a) - (n + m) + 1
        h = _mix(h[:size], powers[m][n : n + size])
        n += m
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def parse(text: bytes, length: int, section: int = SECTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, trigger hash) of the phrases of a text.

    The trigger of a string of `length` bytes is its part of TRIGGER bytes with the
    least rolling hash, the leftmost of equal ones: it depends on the string alone.
    The strings that share a trigger follow each other; a phrase is what they cover.
    """
    wide = length - TRIGGER + 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(0, len(text) - length + 1), section):
        h = _rolling(np.frombuffer(text, np.uint8)[at : at + section + length - 1], TRIGGER)
        n = len(h) - wide + 1
        v = np.full(-(-len(h) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        v[: len(h)] = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        rows = v.reshape(-1, wide)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(rows, axis=1).ravel()
        q = np.minimum(ahead[:n], behind[wide - 1 : wide - 1 + n]) & _PLACE
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        end = np.append(first[1:], n) - 1 + length
        out.append((first + at, end + at, h[q[first].astype(np.int64)].view(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _changes(keys: tuple[np.ndarray, ...], order: np.ndarray) -> np.ndarray:
    """Where rows of other keys begin, in an order that sorts by them; one key at a time is copied."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return new


def _firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """For each row, whether no row of this batch with the same keys has a smaller id."""
    order = np.lexsort((doc, *keys))
    new = _changes(keys, order)
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc
    out = np.empty(len(doc), bool)
    out[order] = doc[order] == least
    return out


def _equal(keys: tuple[np.ndarray, ...], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows sorted by keys and place, and where rows of other keys begin."""
    order = np.lexsort((at, *keys))
    new = _changes(keys, order)
    return order, new


def _digests(text: bytes, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(low, high): 128 bits of hash of each phrase."""
    each = b"".join([xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(first.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(each, np.int64).reshape(-1, 2).T


def _runs(doc: np.ndarray, mark: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at which runs of touching ranges of one text begin, and end."""
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (first[1:] > end[:-1]) | (first[1:] < first[:-1])))
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(doc)) - 1


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _drained(parts: list[np.ndarray]) -> np.ndarray:
    """_join() of a list that is empty afterwards."""
    out = _join(parts)
    parts.clear()
    return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among some sorted ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _phrases(texts: DataFrame, length: int, section: int, hot: np.ndarray) -> DataFrame:
    """(key, place, did, mark, low, rest): the phrases of all texts, packed, as they are most of what goes through a shuffle.

    A phrase is known by 128 bits of hash of its bytes. key: 48 bits of the
    trigger's hash and 16 of the phrase's; place: 24 more bits of the phrase's
    hash, 31 of its start, 1 for a hot trigger and 8 of its length; low: 64 more;
    rest: the last 24, and 1 where the document holds the phrase more than once.

    Of equal phrases of one document only the first goes on: what is found out
    about it holds for all of them (_others()), and a run of one character is one
    row. Texts are taken in pieces of _PIECE bytes. Of equal phrases in one piece only
    those of the smallest id go on; the others are known to repeat, and go on as
    merged spans under a key of their own, with 0 for the length and that of the
    span in place of the phrase's hash. So a text that makes up a third of all rows
    is a few rows for each piece.
    """
    names = ["key", "place", "did", "mark", "low", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(in_pieces(x, 2, _PIECE) for x in batches):
            dids, marks = (np.array(batch.column(c).to_pylist(), np.int64) for c in (0, 1))
            trigger, phrase, first, end = [], [], [], []
            for text in as_bytes(batch.column(2)):
                a, b, t = parse(text, length, section)
                trigger.append(t)
                phrase.append(_digests(text, a, b))
                first.append(a)
                end.append(b)
            r = np.repeat(np.arange(len(dids)), list(map(len, first)))
            low, high = np.concatenate(phrase, axis=1) if phrase else np.zeros((2, 0), np.int64)
            phrase.clear()  # each list is let go as soon as it is one array: phrases of a piece are most of a worker's memory
            t, a, b = (_drained(x) for x in (trigger, first, end))
            d, m = dids[r], marks[r]
            open_ = _firsts((low, high, t), d)
            chosen = np.flatnonzero(open_)
            order, new = _equal((r[chosen], low[chosen], high[chosen], t[chosen]), a[chosen])
            one = chosen[order[new]]
            several = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
            key = (t & ~0xFFFF) | (high & 0xFFFF)
            place = (high >> 16 << 40) | a << 9 | np.where(_among(t >> 16, hot), _HOT, 0)
            rest = (high >> 40 & 0xFFFFFF)[one] | np.where(several, _SEVERAL, 0)
            yield _batch(names, [key[one], (place | b - a)[one], d[one], m[one], low[one], rest])
            d, m, a, b = (x[~open_] for x in (d, m, a, b))
            if len(d):
                new, last = _runs(d, m, a, b)
                size = b[last] - a[new]
                spread = ((d[new] * 0x9E3779B9) ^ (a[new] << 20)) << 16
                none = np.zeros(len(new), np.int64)
                yield _batch(names, [spread | size & 0xFFFF, size >> 16 << 40 | a[new] << 9, d[new], m[new], none, none])

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


#: What _phrases() packs, as SQL.
_TRIGGER, _KNOWN, _IS_HOT = "shiftright(key, 16)", "place & 255 = 0", f"place & {_HOT} <> 0"
_PHRASE = "shiftleft(key & 65535, 24) + (shiftright(place, 40) & 16777215)"
_PART = f"if({_IS_HOT}, ({_PHRASE}) & 255, 0)"
_FIRST = f"shiftright(place, 9) & {_START}"
_SIZE = "if(place & 255 = 0, shiftleft(shiftright(place, 40) & 16777215, 16) + (key & 65535), place & 255)"


def _hot_triggers(texts: DataFrame, length: int, section: int) -> np.ndarray:
    """Triggers that a few tasks can't be left alone with: at most four for each shuffle partition, whatever the input is."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = texts.filter((F.pmod(F.xxhash64("did", "mark", F.lit(3)), F.lit(_EVERY)) == 0) | (F.octet_length("text") >= _LONG))
    counts = cut(_phrases(few, length, section, np.zeros(0, np.int64)).filter(~F.expr(_KNOWN)).groupBy(F.expr(_TRIGGER).alias("trigger")).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(total / (4 * tasks), _HOT_ROWS / _EVERY)
    return np.sort(np.array([r.trigger for r in counts.filter(F.col("count") > least).select("trigger").collect()], np.int64))


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """(trigger, spread, context, did, mark, start): the bytes of the phrases listed in `open`.

    Those of a hot trigger go string by string, spread by their bytes; of equal
    strings in one batch only those of the smallest id, the others are known to
    repeat and have no context.
    """
    names = ["trigger", "spread", "context", "did", "mark", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, strings = [], []
            for did, mark, text, phrases in zip(*(batch.column(c).to_pylist() for c in ("did", "mark")), as_bytes(batch.column("text")), batch.column("open").to_pylist(), strict=True):
                for x in phrases:
                    start, size = x["place"] >> 9 & _START, x["place"] & 255
                    if x["place"] & _HOT:
                        strings += [(x["trigger"], text[i : i + length], did, mark, i) for i in range(start, start + size - length + 1)]
                    else:
                        rows.append((x["trigger"], 0, text[start : start + size], did, mark, start))
            least: dict[tuple[int, bytes], int] = {}
            for t, s, did, _, _ in strings:
                if did < least.get((t, s), did + 1):
                    least[t, s] = did
            for t, s, did, mark, i in strings:
                spread = xxhash.xxh64_intdigest(s) >> 1
                rows.append((t, spread, s, did, mark, i) if least[t, s] == did else (spread ^ did, i, None, did, mark, i))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "context" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return texts.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'context' else 'long'}" for n in names))


def _again(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """(did, mark, start, end): strings that stand under a smaller id too, those that touch as one; all contexts of a trigger are here.

    The suffixes of the dictionary, which is the contexts, are sorted by their
    bytes to the depth of `length`, then by id: equal ones follow each other, the
    one of the smallest id first.
    """
    trigger, spread, did, mark, start = (part.column(c).to_numpy() for c in ("trigger", "spread", "did", "mark", "start"))
    context = part.column("context")
    offsets = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
    data = np.frombuffer(context.buffers()[2] or b"", np.uint8)
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    padded = np.zeros((len(row), -(-length // 8) * 8), np.uint8)
    if len(row):
        padded[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[offsets[:-1][row] + i]
    words = padded.view(">u8").astype(np.uint64)
    group = np.cumsum(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (spread[1:] != spread[:-1]))))[row]
    order = np.lexsort((did[row], *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), group))
    w, g = words[order], group[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | np.any(w[1:] != w[:-1], axis=1))) if len(order) else np.zeros(0, bool)
    ids = did[row][order]
    found = np.zeros(len(row), bool)
    found[order] = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else False
    row, i = row[found], i[found]
    edge = np.concatenate(([True], (row[1:] != row[:-1]) | (i[1:] != i[:-1] + 1))) if len(row) else np.zeros(0, bool)
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(row)) - 1 if len(a) else a
    return _batch(["did", "mark", "start", "end"], [did[row[a]], mark[row[a]], start[row[a]] + i[a], start[row[a]] + i[b] + length])


def _repeats(dictionary: DataFrame, length: int) -> DataFrame:
    """What _again() finds in all contexts, whole groups of rows of a trigger at a time, and the strings known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table["context"].null_count:
                known = table.filter(pc.is_null(table["context"]))
                start = known["start"].to_numpy()
                yield _batch(["did", "mark", "start", "end"], [known["did"].to_numpy(), known["mark"].to_numpy(), start, start + length])
                table = table.filter(pc.is_valid(table["context"]))
            rest = table if rest is None else pa.concat_tables([rest, table])
            if len(rest) < 10_000:
                continue
            rest = rest.combine_chunks()
            t, s = rest["trigger"].to_numpy(), rest["spread"].to_numpy()
            last = int(np.flatnonzero((t == t[-1]) & (s == s[-1]))[0])  # its group may go on in the next batch
            if last:
                yield _again(rest.slice(0, last).to_batches()[0], length)
                rest = rest.slice(last)
        if rest is not None and len(rest):
            yield _again(rest.combine_chunks().to_batches()[0], length)

    rows = dictionary.repartition("trigger", "spread").sortWithinPartitions("trigger", "spread")
    return rows.mapInArrow(run, "did long, mark long, start long, end long")


def _others(text: bytes, spans: list[tuple[int, int]], length: int, section: int) -> list[tuple[int, int]]:
    """The spans, and those of the same strings in phrases that equal earlier ones of the text."""
    n = len(text) - length + 1
    steps = np.zeros(n + 1, np.int64)
    for a, b in spans:
        steps[a] += 1
        steps[b - length + 1] -= 1
    gone = np.cumsum(steps[:n]) > 0  # strings by their first byte
    first, end, _ = parse(text, length, section)
    low, high = _digests(text, first, end)
    order, new = _equal((low, high), first)
    model = first[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]
    here, count = first[order], (end - first - length + 1)[order]
    later = ~new
    here, model, count = here[later], model[later], count[later]
    i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    again = np.repeat(model, count) + i
    gone[(np.repeat(here, count) + i)[gone[again]]] = True
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1 + length).tolist(), strict=True))


def _cut_out(rows: DataFrame, id_type: str, length: int, section: int) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for text, found, several in zip(as_bytes(batch.column("text")), batch.column("found").to_pylist(), batch.column("several").to_pylist(), strict=True):
                merged: list[list[int]] = []
                known = [(x["start"], x["end"]) for x in found or () if x["end"]]
                known = _others(text, known, length, section) if several and known else known
                for a, b in sorted(known):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(x for s in merged for x in s), len(text)]
                n_bytes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            ids = [None if i == _NO_ID else i for i in batch.column("did").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    out = rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


@contextmanager
def _shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind: Spark removes them at the end of each execution, where its version can."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, section: int = SECTION) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed byte ranges, maximal, end exclusive), kept (bytes).

    A byte goes when it lies in a string of `length` bytes that also starts in a
    document of a smaller id; strings overlap, never cross documents, and are
    judged on the input. Ids are integers under 2^63 - 1, which stands for null;
    ids of another type are refused.

    Texts are parsed into phrases at triggers that depend on content alone, so
    equal strings lie in phrases of equal triggers, and only phrases go through
    the shuffle, about one for 15 bytes. A phrase that equals one of a smaller id
    in 128 bits of hash repeats as a whole. Phrases that share a trigger but differ (a repeat begins or
    ends in them) are the dictionary: its suffixes are sorted by their bytes, and
    of equal ones all but those of the smallest id repeat. Phrases overlap, so that
    a suffix as long as a string never runs into the next phrase: where the order
    of the parse would break a tie between equal suffixes, the ids do.

    A trigger with many phrases is dealt to many tasks, by the phrases at first and
    by the strings then; equal ones of a batch go as one. What is left for the
    documents is a list of places each, joined by id.

    A null text is empty; a text shorter than `length` stays whole; one of any
    length is read whole, in sections. A text is removed in full when all of it
    repeats. Rows that share an id don't count against each other, whether their
    texts are equal or not; a null id is larger than any other. Where ids repeat or
    are null, rows are told apart by id and a 64-bit hash of the text, and places
    of equal rows are kept once. An empty table gives an empty result; other
    columns are not read.
    """
    if not TRIGGER < length < 128:
        raise ValueError(f"length must be over {TRIGGER} and under 128")
    spark = docs.sparkSession
    source = fill_partitions(id_and_text(docs, id_col, text_col))
    id_type = dict(source.dtypes)["doc_id"]
    if id_type not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be integers, not {id_type}")
    plain = source.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty()
    mark = F.lit(0).cast("long") if plain else F.xxhash64(F.coalesce("text", F.lit("")))
    texts = source.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), mark.alias("mark"), "text")
    keys = ["did"] if plain else ["did", "mark"]

    # Rows cross the shuffle packed and are taken apart behind it.
    packed = _phrases(texts, length, section, _hot_triggers(texts, length, section)).repartition(F.expr(_TRIGGER), F.expr(_PART))
    phrases = packed.selectExpr(f"{_TRIGGER} as trigger", f"{_PART} as part", f"{_PHRASE} as phrase", "low", f"rest & {_SEVERAL - 1} as rest", f"rest & {_SEVERAL} <> 0 as several", "place", "did", "mark", f"({_FIRST}) + {_SIZE} as end")
    digest = ["phrase", "low", "rest"]
    least = F.min("did").over(Window.partitionBy("trigger", "part", *digest))
    by_trigger = Window.partitionBy("trigger", "part")
    mixed = reduce(or_, (F.min(c).over(by_trigger) != F.max(c).over(by_trigger) for c in digest))
    seen = phrases.withColumn("least", least).withColumn("mixed", mixed)
    whole = F.expr(f"{_KNOWN} or least < did")
    seen = seen.filter(whole | F.expr(f"mixed or {_IS_HOT}")).select("did", "mark", "place", "end", "several", F.when(~whole, F.col("trigger")).alias("trigger"))
    path = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    with _shuffle_files_removed(spark):
        seen.write.parquet(path)

    seen = spark.read.parquet(path)
    seen = seen if plain else seen.distinct()
    open_ = seen.filter("trigger is not null").groupBy(*keys).agg(F.collect_list(F.struct("trigger", "place")).alias("open"))
    strings = _repeats(_contexts(texts.join(open_, keys).select("did", "mark", "text", "open"), length), length)
    # A phrase that a document holds several times leaves a mark also where it is still open: an empty span.
    known = seen.filter("trigger is null or several").select("did", "mark", F.expr(f"if(trigger is null, {_FIRST}, 0)").alias("start"), F.expr("if(trigger is null, end, 0)").alias("end"), "several")
    found = known.unionByName((strings if plain else strings.distinct()).withColumn("several", F.lit(False)))
    spans = found.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("found"), F.max("several").alias("several"))
    return _cut_out(texts.join(spans, keys, "left").select("did", "text", "found", "several"), id_type, length, section)
