"""SimHash near-dedup: fingerprints linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SENT_ROWS, as_bytes, fill_partitions, id_and_text, keep_rows, keyed
from palimpsest.operators.components import connected_components
from palimpsest.sources.scratch import cut

#: Bits of one word of a fingerprint.
BITS = 64
#: Shingles whose bits are counted at once; bounds the memory a very long text takes.
_BLOCK = 1 << 15
#: Members of a bucket that every probe is held against at first.
_PICKED = 4
#: Buckets that may be sent to every executor; more of them are joined by a shuffle.
_SENT = 200_000
#: Words of the fingerprint of a set of shingles; samples of its bits, and bits in each: of pairs of similarity 0.8 all but 1 in 1,000 or so share one.
_WORDS, _SAMPLES, _WIDTH = 10, 120, 16
#: Of sets that share a sample go on together those that differ in no more of their first 128 bits (at 0.8 it is 19 on average, by chance 64).
_APART = 34
#: Rows of one sample whose fingerprints are held against each other; what is more is similar and goes on whole.
_SHARED = 1024
#: Rows of a bucket that one task compares at once.
_DEALT = 4096
#: The bits of each sample, one after another: three shufflings of all bits.
_DRAWN = np.concatenate([np.random.default_rng(k).permutation(BITS * _WORDS) for k in range(_SAMPLES * _WIDTH // (BITS * _WORDS))])


def _more(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits of a hash, for the wider fingerprints: the finaliser of SplitMix64."""
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """64-bit hashes of the shingles of a text, in blocks (A-Z lower-cased, words between ASCII white space)."""
    parts = text.lower().split()
    if not parts:
        return
    n = max(1, len(parts) - shingle + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        upto = min(n, at + _BLOCK)
        pairs = zip(starts[at:upto].tolist(), ends[at + last : upto + last].tolist(), strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in pairs], "<u8")


def _signs(blocks: Iterable[np.ndarray], words: int) -> list[int]:
    """The majority of each bit over hashes, in unsigned 64-bit words."""
    counts, n = np.zeros((words, BITS), np.int64), 0
    for h in blocks:
        n += len(h)
        for w in range(words):
            bits = np.unpackbits((_more(h, w) if w else h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[w] += bits.sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * c > n, bitorder="little").tobytes(), "little") for c in counts]


def fingerprint(text: bytes, shingle: int, words: int = 1) -> list[int]:
    """SimHash of the shingles of a text in unsigned 64-bit words."""
    return _signs(shingle_hashes(text, shingle), words)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text, ascending, each once."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, shingle)]))


def _names(words: int) -> list[str]:
    return [f"f{w}" for w in range(words)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...): the words of one fingerprint per input row, as signed 64-bit numbers."""
    names = ["doc_id", *_names(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, shingle, words) for x in as_bytes(batch.column(1))], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(prints[:, w])) for w in range(words))], names)

    texts = fill_partitions(id_and_text(docs, id_col, text_col))
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in _names(words)))


def _segments(words: int, max_distance: int) -> list[tuple[str, int, int]]:
    """(word, shift, width) of the segments. One word has as many as it takes for a link to leave one flip at most in one of them; of several, each has three."""
    n = (max_distance + 2) // 2 if words == 1 else 3
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return [(f, a, b - a) for f in _names(words) for a, b in zip(edges, edges[1:], strict=False)]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _tables(nodes: DataFrame, segments: list[tuple[str, int, int]], radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """The table entries (one per segment) and the probes (the ball around each segment) of all fingerprints.

    Of two segment values a flip apart, only the smaller one probes for the
    larger, so each pair of rows meets once per segment.
    """
    values = [F.shiftrightunsigned(f, shift).bitwiseAND(F.lit((1 << width) - 1)) for f, shift, width in segments]

    def ball(seg: int, value, width: int):
        def neighbour(mask):
            key = value.bitwiseXOR(mask)
            return F.struct(F.lit(seg).alias("seg"), key.alias("key"), (key == value).alias("same"))

        masks = F.array(*[F.lit(m).cast("long") for m in _masks(width, radius)])
        return F.transform(F.filter(masks, lambda m: value.bitwiseXOR(m) >= value), neighbour)

    entries = F.array(*[F.struct(F.lit(s).alias("seg"), v.alias("key")) for s, v in enumerate(values)])
    probes = F.flatten(F.array(*[ball(s, v, width) for s, (v, (_, _, width)) in enumerate(zip(values, segments, strict=True))]))
    return tuple(nodes.select("*", F.explode(x).alias("e")).select(*nodes.columns, "e.*") for x in (entries, probes))


def _distance(a, b, names: list[str]):
    return sum((F.bit_count(a[n].bitwiseXOR(b[n])) for n in names), F.lit(0))


def _node(names: list[str], row=None):
    """One number for a fingerprint: itself, or a hash of its words. It isn't sent along with them."""
    parts = [F.col(n) if row is None else row[n] for n in names]
    return parts[0] if len(parts) == 1 else F.xxhash64(*parts)


def linked(nodes: DataFrame, words: int, max_distance: int) -> DataFrame:
    """(node, component) of distinct fingerprints (nodes: f0, f1, ...); component is the smallest node reachable.

    First each probe is held against four members of the bucket it meets. Those
    are all members of nearly every bucket; in a dense bucket they link its members
    without any pair among them. The components of those links label the
    fingerprints. Then the buckets of more members that meet another label are
    searched in full, and only members with another label are compared. So a large
    group of near copies costs a few rows for each fingerprint, not the square of
    the group, and no link between components is lost.
    """
    names, segments = _names(words), _segments(words, max_distance)
    table, probe = _tables(nodes, segments)
    one, mixed = F.struct(*names), F.xxhash64(*names, F.lit(1))
    picks = table.groupBy("seg", "key").agg(
        F.count(F.lit(1)).alias("members"), F.min(one).alias("a"), F.max(one).alias("b"), F.min_by(one, mixed).alias("c"), F.max_by(one, mixed).alias("d")
    )
    # Some of the four can be one and the same member, so a bucket of three or more may still have others.
    me = {n: F.col(n) for n in names}
    near = F.filter(F.array("a", "b", "c", "d"), lambda x: _distance(x, me, names).between(1, max_distance))
    stars = probe.join(picks, ["seg", "key"]).select(_node(names).alias("src"), F.explode(F.array_distinct(F.transform(near, lambda x: _node(names, x)))).alias("dst"))
    first = connected_components(stars)
    named = cut(nodes.withColumn("n", _node(names)).join(first, F.col("node") == F.col("n"), "left").select(*names, F.coalesce("component", "n").alias("label")))

    table, probe = _tables(named, segments)
    dense = cut(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).filter("members > 2"))
    few = dense.count() <= _SENT
    dense = F.broadcast(dense) if few else dense
    asking = probe.join(dense, ["seg", "key"]).filter("low <> label or high <> label").drop("members", "low", "high")
    t = table.join(dense.select("seg", "key"), ["seg", "key"]).select(F.struct(*names).alias("t"), "seg", "key", F.col("label").alias("t_label"))
    met = asking.join(t, ["seg", "key"]).filter((F.col("label") != F.col("t_label")) & (~F.col("same") | (_node(names) < _node(names, F.col("t")))) & (_distance(F.col("t"), me, names) <= max_distance))
    merged = connected_components(met.select(F.col("label").alias("src"), F.col("t_label").alias("dst")))
    return named.join(merged, F.col("label") == F.col("node"), "left").select(_node(names).alias("node"), F.coalesce("component", "label").alias("component"))


def _set_node(hashes: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of the SimHash of a set of shingles, each counted once. Two sets of Jaccard similarity 0.8 differ in 0.15 of them on average."""
    counts = np.zeros(BITS * _WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        h = hashes[at : at + 255]
        mixed = np.stack([_more(h, w) if w else h for w in range(_WORDS)], axis=1)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * counts > len(hashes)


def set_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, f0, f1, samples) of docs (doc_id, text): a number for the set of shingles, the first two words of its SimHash, and all samples of its bits, each with its number; none for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(_SAMPLES, dtype=np.int32) << _WIDTH
        for batch in batches:
            nodes, words, samples = [], [], []
            for x in as_bytes(batch.column(1)):
                h = shingle_set(x, shingle)
                bits = set_bits(h)
                nodes.append(_set_node(h))
                words.append(np.packbits(bits[: 2 * BITS], bitorder="little").view("<i8"))
                samples.append(number | np.packbits(bits[_DRAWN].reshape(_SAMPLES, _WIDTH), axis=1).view(">u2").ravel() if len(h) else ())
            f = np.array(words, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), *(pa.array(np.ascontiguousarray(f[:, w])) for w in (0, 1)), pa.array(samples, pa.list_(pa.int32()))], ["doc_id", "node", "f0", "f1", "samples"])

    texts = fill_partitions(docs)
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, node long, f0 long, f1 long, samples array<int>")


def _near_rows(sample: np.ndarray, prints: np.ndarray, shared: int = _SHARED) -> np.ndarray:
    """For each row the first row of its group: rows in order of their sample, linked where they share it and differ in few bits."""
    edge = np.flatnonzero(np.concatenate(([True], sample[1:] != sample[:-1], [True])))
    size = np.diff(edge)
    after = np.repeat(np.where(size > shared, 0, edge[1:]), size) - np.arange(len(sample)) - 1  # rows of the sample behind this one
    src, dst, step, at = [], [], 1, np.flatnonzero(after >= 1)
    while len(at):
        near = at[np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)).sum(axis=1) <= _APART]
        src.append(near)
        dst.append(near + step)
        step += 1
        at = at[after[at] >= step]
    label = np.where(np.repeat(size > shared, size), np.repeat(edge[:-1], size), np.arange(len(sample)))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (src, dst))
    while len(a):
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_groups(nodes: DataFrame, shared: int = _SHARED) -> DataFrame:
    """(src, dst): the sets (node, f0, f1, samples) whose fingerprints share a sample of their bits and are near each other, each with the first of its group.

    Rows of a sample meet in one task, which gives out the groups of two or more,
    so what goes on are members and not pairs. A sample of more than `shared` rows
    isn't chance; its rows go on as one group, as they come.
    """

    def out(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, node, prints, large = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), -1
        head = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                s, n, *f = (batch.column(c).to_numpy() for c in ("sample", "node", "f0", "f1"))
                known = int(np.searchsorted(s, large, side="right")) if large >= 0 else 0
                if known:
                    yield out(np.full(known, head), n[:known])
                sample, node = np.concatenate([sample, s[known:]]), np.concatenate([node, n[known:]])
                prints = np.concatenate([prints, np.stack(f, axis=1)[known:]])
            last = int(np.searchsorted(sample, sample[-1])) if batch is not None and len(sample) else len(sample)  # the last sample may go on
            label = _near_rows(sample[:last], prints[:last], shared)
            kept = np.flatnonzero(label != np.arange(last))
            if len(kept):
                yield out(node[label[kept]], node[kept])
            sample, node, prints = sample[last:], node[last:], prints[last:]
            if len(sample) > shared:
                large, head = int(sample[0]), int(node[0])
                yield out(np.full(len(node), head), node)
                sample, node, prints = sample[:0], node[:0], prints[:0]

    rows = nodes.select("node", "f0", "f1", F.explode("samples").alias("sample"))
    return rows.repartition("sample").sortWithinPartitions("sample").mapInArrow(run, "src long, dst long")


def _stars(links: DataFrame) -> DataFrame:
    """(src, dst): of the links (src, dst) of near_groups() as few as put the same sets together: the firsts of a set's groups, and the set, each with the least of them.

    A set has a first in each sample at most, so its firsts are a short list however
    large its group is. A group of near copies has dozens of links a member, as its
    samples fall into groups with firsts of their own; here that becomes a few, without
    a join, and only those go through the rounds of the components.
    """
    firsts = links.groupBy("dst").agg(F.collect_set("src").alias("firsts"))
    all_of = firsts.select(F.array_append("firsts", F.col("dst")).alias("of"))
    stars = all_of.select(F.explode("of").alias("src"), F.array_min("of").alias("dst"))
    return stars.filter("src <> dst").distinct()


def _sets_of(needed: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the sets of some nodes, from the text of one document each."""
    needed = cut(nodes.join(needed, "node", "left_semi").select("node", "low_id"))
    ids = needed.select("low_id").distinct()
    ids = F.broadcast(ids) if needed.count() <= SENT_ROWS else ids
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["low_id"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(x, shingle) for x in as_bytes(batch.column(0).slice(at, 256))]
                arrays = pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(map(_set_node, sets), pa.int64()), arrays], ["node", "shingles"])

    sets = texts.mapInArrow(run, "node long, shingles array<long>").join(needed.select("node"), "node", "left_semi")
    return cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))


def _group_links(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, flat: np.ndarray, hundredths: int) -> list[tuple[int, int]]:
    """Links of a group (its sets one after another in flat) that put its labels together, exact: each row is counted against all others by its shingles, until one label is left."""
    label = np.unique(labels, return_inverse=True)[1]
    left, out = label.max(initial=0), []
    if not left:
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    shingle, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
    count = np.diff(np.append(first, len(shingle)))
    run = np.empty(len(flat), np.int64)
    run[order] = np.repeat(np.arange(len(first)), count)
    ends = np.cumsum(sizes)
    for i, end in enumerate(ends.tolist()):
        mine = run[end - sizes[i] : end]
        n = count[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sizes))
        close = (100 * both >= hundredths * (sizes[i] + sizes - both)) & (label != label[i])
        for other in np.unique(label[close]).tolist():
            j = int(np.flatnonzero(close & (label == other))[0])
            out.append((max(int(nodes[i]), int(nodes[j])), min(int(nodes[i]), int(nodes[j]))))
            left -= 1
        label[np.isin(label, label[close])] = label[i]
        if not left:
            break
    return out


def _linked_in(rows: DataFrame, hundredths: int) -> DataFrame:
    """(src, dst): links between rows of a group (bucket, part, node, label, shingles); no more than it has labels, less one."""

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = [table[c].to_numpy() for c in ("bucket", "part")]
        edge = np.flatnonzero(np.concatenate(([True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]), [True])))
        nodes, labels = table["node"].to_numpy(), table["label"].to_numpy()
        lists = table["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        src, dst = [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for x, y in _group_links(nodes[a:b], labels[a:b], np.diff(offsets[a : b + 1]).astype(np.int64), flat[offsets[a] : offsets[b]], hundredths):
                src.append(x)
                dst.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            key = [rest[c].to_numpy() for c in ("bucket", "part")]
            last = int(np.flatnonzero((key[0] == key[0][-1]) & (key[1] == key[1][-1]))[0]) if len(rest) else 0
            if last:  # the last group may go on in the next batch
                yield from groups(rest.slice(0, last).combine_chunks())
                rest = rest.slice(last)
        if rest is not None and len(rest):
            yield from groups(rest.combine_chunks())

    dealt = rows.select("bucket", "part", "node", "label", "shingles").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")
    return dealt.mapInArrow(run, "src long, dst long")


def _blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of hot buckets whose labels differ, with `part`: once for each other part of the bucket, so that any two parts meet."""
    named = members.join(labels, "node")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("bucket")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    both = named.join(mixed, "bucket", "left_semi").withColumn("other", other)
    return both.withColumn("part", (F.least("part", "other").cast("long") * F.col("parts") + F.greatest("part", "other")).cast("long"))


def linked_sets(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, component) of distinct sets of shingles (nodes: node, low_id, f0, f1, samples); component is the smallest node reachable.

    What near_groups() puts together, whatever the sample, is one bucket, so a set
    is in one at most. A bucket of two is a pair; pairs are joined with their sets
    and compared. Of larger buckets a task compares the sets, exactly, and gives
    out no more links than it takes to put them together, so the rows grow with the
    members and not with their pairs. A hot bucket is dealt to several tasks, each
    with the smallest set of all beside its own; if its labels still differ after
    that, its parts are compared two by two.
    """
    hundredths = round(100 * similarity)
    met = cut(connected_components(cut(_stars(near_groups(nodes)))).select("node", F.col("component").alias("bucket")))
    groups = cut(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")))
    pairs = cut(groups.filter("n = 2").select(F.col("high").alias("src"), F.col("low").alias("dst")))
    dense = cut(groups.filter("n > 2").select("bucket", "low", F.ceil(F.col("n") / _DEALT).cast("int").alias("parts")))
    few = dense.count() <= _SENT
    members = met.join(F.broadcast(dense) if few else dense, "bucket").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
    members = cut(members.select("bucket", "parts", "part", "node"))
    sets = _sets_of(pairs.select(F.explode(F.array("src", "dst")).alias("node")).union(members.select("node")).distinct(), nodes, docs, shingle)

    a, b = (sets.select(F.col("node").alias(end), F.col("shingles").alias(x)) for end, x in (("src", "a"), ("dst", "b")))
    both, of = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    links = cut(pairs.join(a, "src").join(b, "dst").filter(100 * both >= hundredths * (of - both)).select("src", "dst"))
    least = dense.filter("parts > 1").select("bucket", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("low").alias("node"))
    every = members.unionByName(least).distinct().withColumn("label", F.col("node"))
    links = cut(links.union(_linked_in(every.join(sets, "node"), hundredths)))
    found = cut(connected_components(links))
    hot = members.filter("parts > 1")
    if not hot.isEmpty():
        label = F.coalesce("component", "node").alias("label")
        labels = hot.select("node").distinct().join(found, "node", "left").select("node", label)
        more = _linked_in(_blocks(hot, labels).join(sets, "node"), hundredths)
        found = cut(connected_components(links.union(more)))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, words: int = 1, similarity: float | None = None) -> DataFrame:
    """One row per input row: doc_id, f0, f1, ... (64-bit words of its SimHash), component_id.

    Two rows link when their fingerprints differ in at most `max_distance` bits;
    component_id is the smallest doc_id reachable over links. Equal fingerprints
    collapse to one node first, so exact copies cost one row each.

    With one word every link is found: of the (max_distance + 2) // 2 segments, two
    linked fingerprints differ by one bit at most in one. With more words, for
    larger distances, each word has three segments and a link is found where one
    of them differs by one bit at most; that is likely, not certain.

    With `similarity` (in whole hundredths, for 0.8 or more) two rows link when the
    Jaccard similarity of their sets of shingles is that or more, compared exactly;
    words and max_distance aren't read and no fingerprint is returned. A SimHash of
    640 bits, of the shingles each counted once, says which rows to compare: those
    that share one of 120 samples of 16 bits and differ little in 128 more. No other
    rows link, and of pairs of 0.8 all but about 1 in 1,000 meet (of 4 and 5
    shingles 1 in 50), of closer ones all but next to none.

    A null or empty text, or one of white space only, has fingerprint zero and
    links like any other. A text of fewer words than a shingle is one shingle.
    Repeated rows get the same answer each. A null id never wins; a component
    without any id has a null component_id. Texts of any length are read whole, in
    blocks. An empty table gives an empty result; other columns are not read.
    """
    names = _names(words)
    if similarity is not None:
        texts = id_and_text(docs, id_col, text_col)
        prints = cut(set_prints(texts, shingle))
        nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("low_id"), *(F.first(c).alias(c) for c in ("f0", "f1", "samples"))))
        found = nodes.select("node", "low_id").join(linked_sets(nodes, texts, shingle, similarity), "node")
        ids = found.groupBy("component").agg(F.min("low_id").alias("component_id"))
        return prints.select("doc_id", "node").join(found.join(ids, "component").select("node", "component_id"), "node").select("doc_id", "component_id")
    prints = cut(fingerprints(docs, id_col, text_col, shingle, words))
    nodes = cut(prints.groupBy(*names).agg(F.min("doc_id").alias("low_id")))
    found = nodes.withColumn("node", _node(names)).join(linked(nodes.select(*names), words, max_distance), "node")
    ids = found.groupBy("component").agg(F.min("low_id").alias("component_id"))
    by_print = found.join(ids, "component").select(*names, "component_id")
    return prints.join(by_print, names).select("doc_id", *names, "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each group of near copies the row (doc_id, text and any others) with the smallest id, with all its columns.

    Groups are those of simhash_dedup() with the same options. Exactly one row of
    each stays: of rows that share the smallest id one of those of the smallest
    hash of their bytes, where no row has an id too. Texts without words are one
    group. Another text under the id of a copy stays. An empty table gives an empty
    result; clashing column names don't matter.
    """
    found = simhash_dedup(keyed(docs), **options)
    return keep_rows(docs, found.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")))


def hex16(fp):
    """16 lowercase hex digits of a 64-bit column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
