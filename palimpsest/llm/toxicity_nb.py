"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_bytes, fill_partitions, held_out, id_and_text, label_sample
from palimpsest.sources.scratch import cut

BITS = 20
SIZES = (4, 5, 6, 7, 8)
#: Everything but letters, digits and bytes above 0x7F separates words; A-Z become a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = 1 << 20
#: Tasks that count the bounded sample; each sends a row for every bucket it met.
_TASKS = 8


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Hash buckets of the character n-grams of a text, words set apart by one space; block by block, repeats included."""
    whole = b" " + b" ".join(text.translate(_WORDS).split()) + b" "
    for at in range(0, len(whole), _BLOCK):
        a = np.frombuffer(whole[at : at + _BLOCK + max(SIZES) - 1], np.uint8).astype(np.uint32)
        h = np.zeros(len(a), np.uint32)
        for n in range(1, min(max(SIZES), len(a)) + 1):
            h = h[: len(a) - n + 1] * np.uint32(0x01000193) + a[n - 1 :]
            if n in SIZES:
                yield (h ^ np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)


def presence(text: bytes) -> np.ndarray:
    """Which buckets a text has any n-gram in."""
    seen = np.zeros(1 << BITS, bool)
    for codes in grams(text):
        seen[codes] = True
    return seen


@dataclass
class Model:
    """Weight of each n-gram bucket that was kept (slot: its place + 1, else 0)."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def found(self, text: bytes) -> np.ndarray:
        parts = [s[s > 0] for s in (self.slot[codes] for codes in grams(text))]
        return np.unique(np.concatenate(parts)) - 1 if parts else np.zeros(0, np.int64)

    def score(self, text: bytes) -> float:
        z = float(self.weights[self.found(text)].sum() + self.bias)
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Texts of either label that have an n-gram in each bucket, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                sums[int(y == 1), :-1] += presence(text)
                sums[int(y == 1), -1] += 1
        for y in range(2):
            at = np.flatnonzero(sums[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y, np.int32)), pa.array(at), pa.array(sums[y, at])], ["y", "at", "n"])

    rows = sample.mapInArrow(run, "y int, at long, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, (1 << BITS) + 1), np.int64)
    out[rows["y"].to_numpy(), rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out[1, :-1], out[0, :-1], int(out[1, -1]), int(out[0, -1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, keep: int = 4_000, steps: int = 300, rate: float = 0.05, l2: float = 1.0) -> Model:
    """Fit on about max_rows labelled texts that aren't held out, twice as many at most, taken by a hash of the id.

    Every bucket gets the log ratio of its smoothed shares among texts of either
    label. The `keep` buckets whose shares differ most for their spread stay; a
    text is the ratios of those it has, and a logistic regression, to which either
    label counts as much, weighs them.
    Without texts of both labels every text gets the same score: the share of
    toxic labels, a half where there is none.
    """
    sample = cut(label_sample(docs, labels, label, max_rows)).coalesce(_TASKS)
    pos, neg, n_pos, n_neg = _counts(sample)
    slot = np.zeros(1 << BITS, np.int32)
    if not n_pos or not n_neg:
        return Model(slot, np.zeros(0), 0.0 if n_pos == n_neg else 30.0 if n_pos else -30.0)
    ratio = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
    spread = np.sqrt((pos + neg + 1) / (n_pos + n_neg) * (1 / n_pos + 1 / n_neg))
    best = np.argsort(-np.abs(pos / n_pos - neg / n_neg) / spread, kind="stable")[:keep]
    slot[best] = np.arange(1, len(best) + 1)
    scale = ratio[best]
    model = Model(slot, np.zeros(len(best)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.found(t).astype(np.int32) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([int(y == 1) for y in batch.column(0).to_pylist()], pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["y", "found"])

    rows = sample.mapInArrow(run, "y int, found array<int>").toArrow().combine_chunks()
    y = rows["y"].to_numpy().astype(float)
    found = rows["found"].combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    sizes, f = np.diff(found.offsets.to_numpy()), found.flatten().to_numpy()
    doc, x, n = np.repeat(np.arange(len(y)), sizes), scale[f], len(y)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    theta, m, v = np.zeros(keep + 1), np.zeros(keep + 1), np.zeros(keep + 1)
    for t in range(1, steps + 1):
        z = np.bincount(doc, theta[f] * x, minlength=n) + theta[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.append(np.bincount(f, r[doc] * x, minlength=keep), r.sum())
        g[:-1] += l2 / n * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(slot, theta[: len(best)] * scale, float(theta[-1]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options: float) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted.

    Learns from `labels` (doc_id, toxic) as train() says and scores every whole
    text where it lies, without a shuffle; the model is one number for each of
    2^20 buckets. A null or empty text has no n-gram but the space and gets the
    bias; one of any length is read whole, block by block. Repeated rows get the
    same score each; a null id is never held out; an empty table gives an empty
    result; other columns are not read.
    """
    texts = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(texts, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = fill_partitions(texts).mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
