"""Quality classifier from positive and unlabelled texts: non-negative unbiased risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_bytes, bounded, by_hash, fill_partitions, held_out, id_and_text, label_sample
from palimpsest.sources.scratch import cut

_UPPER = bytes(range(65, 91))
_LETTERS = bytes(range(97, 123)) + _UPPER + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_SPACES = b" \t\n\r\x0b\x0c"
_MARKS = b".,;:?'\"-()"
_SYMBOLS = b"#$%&*@^~|<>{}[]\\/=+_`"
_PARTS = 32
#: Strings of so many characters, in so many buckets (a power of 2), are the lexical feature.
GRAM, GRAM_BITS = 4, 16
_BLOCK = 1 << 20


def _without(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def features(text: bytes) -> list[float]:
    """What the text looks like, in shares that do not depend on its language."""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(lines)
    solid = max(1, n - _without(text, _SPACES))
    letters = max(1, _without(text, _LETTERS))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    top = counts.most_common(1)[0][1] if counts else 0
    # The worst of equal parts, so that a bad stretch of a long text still shows.
    step = max(16, -(-len(words) // _PARTS))
    parts = [words[i : i + step] for i in range(0, len(words), step)]
    joined = [b"".join(p) for p in parts]
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        solid / m,
        letters / solid,
        _without(text, _UPPER) / letters,
        _without(text, _DIGITS) / solid,
        _without(text, _MARKS) / solid,
        _without(text, _SYMBOLS) / solid,
        text.count(b"!") / m,
        text.count(b"|") / m,
        text.count(b".") / m,
        same / m,
        len(counts) / m,
        np.log1p(len(counts)) / np.log1p(m),
        top / m,
        1 - sum(map(len, distinct)) / max(1, sum(map(len, lines))),
        len(words) / max(1, len(lines)),
        max((_without(x, _SYMBOLS) / max(1, len(x)) for x in joined), default=0),
        max((_without(x, _UPPER) / max(1, len(x)) for x in joined), default=0),
        max((sum(a == b for a, b in zip(p, p[1:], strict=False)) / len(p) for p in parts), default=0),
        max((_without(x, _DIGITS) / max(1, len(x)) for x in joined), default=0),
    ]


def gram_buckets(text: bytes) -> np.ndarray:
    """Buckets of a text's strings of GRAM characters (A-Z lower-cased), one for each place; texts of any length, block by block."""
    out = []
    low = text.lower()
    for at in range(0, max(1, len(low) - GRAM + 1), _BLOCK):
        a = np.frombuffer(low[at : at + _BLOCK + GRAM - 1], np.uint8).astype(np.uint32)
        h = np.zeros(max(0, len(a) - GRAM + 1), np.uint32)
        for j in range(GRAM if len(h) else 0):
            h = h * np.uint32(0x01000193) + a[j : j + len(h)]
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS))
    return np.concatenate(out)


@dataclass
class Model:
    """A linear score over the bins that a text's features fall into; the last of them is how much its strings read like the positives'."""

    edges: np.ndarray  # features x (bins - 1)
    weights: np.ndarray  # features x bins
    bias: float
    grams: np.ndarray = field(default_factory=lambda: np.zeros(1 << GRAM_BITS, np.float32))  # log ratio of each bucket

    def lexical(self, text: bytes) -> float:
        """The mean log ratio of a text's strings; 0 without any."""
        at = gram_buckets(text)
        return float(self.grams[at].mean()) if len(at) else 0.0

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Bin of each feature: one number from 0 to bins - 1."""
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[np.arange(x.shape[1]), self.rows(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(theta: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the unbiased risk with the logistic loss, and their gradients.

    p and u have the places of each row's weights in theta, whose last is the bias.
    The first part is prior * E_P[l(+)], the second E_U[l(-)] - prior * E_P[l(-)].
    """

    def spread(places: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(places.ravel(), np.repeat(g, places.shape[1]), minlength=len(theta) - 1), g.sum())

    zp, zu = theta[:-1][p].sum(axis=1) + theta[-1], theta[:-1][u].sum(axis=1) + theta[-1]
    first = prior * np.logaddexp(0, -zp).mean()
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    plus = spread(p, -prior * (1 - _sigmoid(zp)) / len(zp))
    minus = spread(u, _sigmoid(zu) / len(zu)) - spread(p, prior * _sigmoid(zp) / len(zp))
    return first, rest, plus, minus


def _minimise(gradient, theta: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def _binned(positive: np.ndarray, unlabelled: np.ndarray, bins: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """An empty model with its bins, and the places of the weights of either sample."""
    every = np.concatenate([positive, unlabelled])
    edges = np.quantile(every, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    model = Model(edges, np.zeros((every.shape[1], bins)), 0.0)
    columns = np.arange(every.shape[1]) * bins
    return model, model.rows(positive) + columns, model.rows(unlabelled) + columns


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, bins: int = 16, steps: int = 300, rate: float = 0.1, l2: float = 0.03, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the two samples alone.

    A classifier tells the samples apart on one half of each, and scores the other
    half; then the other way round. Above any score the unlabelled share is at
    least the prior times the positives' share; where their ratio, with a bound for
    the sizes of the samples, is least, there are next to no negatives, and it is
    the prior.
    """
    scores = [np.zeros(len(positive)), np.zeros(len(unlabelled))]
    for k in (0, 1):
        model, p, u = _binned(positive[k::2], unlabelled[k::2], bins)

        def gradient(theta: np.ndarray, p=p, u=u) -> np.ndarray:
            zp, zu = theta[:-1][p].sum(axis=1) + theta[-1], theta[:-1][u].sum(axis=1) + theta[-1]
            gp, gu = -(1 - _sigmoid(zp)) / len(zp), _sigmoid(zu) / len(zu)
            g = np.bincount(p.ravel(), np.repeat(gp, p.shape[1]), minlength=len(theta) - 1) + np.bincount(u.ravel(), np.repeat(gu, u.shape[1]), minlength=len(theta) - 1)
            return np.append(g + l2 * theta[:-1], gp.sum() + gu.sum())

        theta = _minimise(gradient, np.zeros(model.weights.size + 1), steps, rate)
        model.weights, model.bias = theta[:-1].reshape(model.weights.shape), float(theta[-1])
        for s, x in zip(scores, (positive, unlabelled), strict=True):
            s[1 - k :: 2] = model.score(x[1 - k :: 2])
    sp, su = map(np.sort, scores)
    above = lambda scores, at: (len(scores) - np.searchsorted(scores, at, side="left")) / len(scores)
    qp, qu = above(sp, sp), above(su, sp)
    bound = sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (sp, su))
    best = np.argmin((qu + bound) / qp)
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = 16, steps: int = 600, rate: float = 0.1, l2: float = 1e-5) -> Model:
    """Minimise prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]) with the logistic loss.

    Where the difference falls below zero, which only overfitting can do, the step
    goes up along it instead, as the non-negative estimator prescribes.
    """
    model, p, u = _binned(positive, unlabelled, bins)

    def gradient(theta: np.ndarray) -> np.ndarray:
        _, rest, plus, minus = risk(theta, p, u, prior)
        g = plus + minus if rest >= 0 else -minus
        return g + l2 * np.append(theta[:-1], 0.0)

    theta = _minimise(gradient, np.append(np.zeros(model.weights.size), np.log(prior / (1 - prior))), steps, rate)
    model.weights, model.bias = theta[:-1].reshape(model.weights.shape), float(theta[-1])
    return model


def gram_ratios(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's smoothed share of the strings of the positives and of the unlabelled, between -3 and 3."""
    share = lambda n: np.log((n + 1) / (n.sum() + len(n)))
    return np.clip(share(positive) - share(unlabelled), -3, 3).astype(np.float32)


def _gram_counts(texts: DataFrame) -> np.ndarray:
    """How many strings of all texts fall in each bucket, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << GRAM_BITS, np.int64)
        for batch in batches:
            for x in as_bytes(batch.column(0)):
                sums += np.bincount(gram_buckets(x), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    rows = texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << GRAM_BITS, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def _matrix(texts: DataFrame, grams: np.ndarray) -> np.ndarray:
    """Features of a bounded sample, at the driver."""
    model = Model(np.zeros(0), np.zeros(0), 0.0, grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[*features(x), model.lexical(x)] for x in as_bytes(batch.column(0))], pa.list_(pa.float64()))], ["x"])

    rows = texts.select("text").mapInArrow(run, "x array<double>").toArrow()["x"].to_pylist()
    return np.array(rows, float).reshape(len(rows), len(features(b"")) + 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_positive: int = 20_000, max_unlabelled: int = 20_000) -> Model:
    """Fit on trusted positives (labelled 1, not held out) and unlabelled documents.

    Both samples are bounded, by about twice max_positive and max_unlabelled rows,
    and taken by a hash of the id, rows that repeat an id by chance. One half of either gives the log ratios of the strings, the
    other the features that the rest is fitted on. The class prior is estimated
    from the two samples; of the labels nothing but the positives is used. Without
    any positive, or without documents, every text gets a score of a half.
    """
    trusted = label_sample(docs, labels.filter(F.col(label) == 1), label, max_positive)
    unlabelled = bounded(by_hash(docs, "doc_id", docs.count(), max_unlabelled).select("text"), max_unlabelled)
    # Texts are dealt to the halves by their content, so that copies stay together.
    halves = [[x.filter(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(2)) == k) for k in (0, 1)] for x in (cut(trusted.select("text")), cut(unlabelled))]
    grams = gram_ratios(*(_gram_counts(h[0]) for h in halves))
    positive, other = (_matrix(h[1], grams) for h in halves)
    if not len(positive) or not len(other):
        n = len(features(b"")) + 1
        return Model(np.zeros((n, 0)), np.zeros((n, 1)), 0.0)
    model = fit(positive, other, estimate_prior(positive, other))
    model.grams = grams
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **bounds: int) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: better), predicted.

    Learns from `labels` (doc_id, quality) as train() says, then scores every whole
    text where it lies, without a shuffle; the model is a small table. A null or
    empty text is scored by its (empty) features; one of any length is read whole. Repeated rows get the same score
    each; a null id is never held out; an empty table gives an empty result; other
    columns are not read.
    """
    texts = id_and_text(docs, id_col, text_col)
    score = scorer(train(texts, labels, **bounds))
    scored = fill_partitions(texts).select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scorer(model: Model):
    """The score of a text column, for use in any DataFrame; other columns don't pass through Python."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        x = np.array([[*features(t), model.lexical(t)] for t in as_bytes(text)], float)
        return pa.array(model.score(x) if len(x) else np.zeros(0), pa.float64())

    return score


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **bounds: int) -> DataFrame:
    """The rows, with all their columns, that quality() predicts 1 for.

    A row is judged by its text alone: repeated rows, and rows without an id, are
    judged like any other; a null text is judged as an empty one. An empty table
    gives an empty result; clashing column names don't matter.
    """
    score = scorer(train(id_and_text(docs, id_col, text_col), labels, **bounds))
    return docs.filter(score(F.col(f"`{text_col}`")) >= threshold)
