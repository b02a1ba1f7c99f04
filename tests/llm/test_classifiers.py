import math
import random
import zlib
from collections import Counter

import numpy as np

from palimpsest.llm import toxicity_nb
from palimpsest.llm.common import bounded, label_sample
from palimpsest.llm.quality_pu import GRAM, GRAM_BITS, estimate_prior, features, fit, gram_buckets, gram_ratios, keep_good, quality, risk
from palimpsest.llm.toxicity_nb import toxicity

FOLDER = "/root/testdata/sf0.01"


def measured(scores, labels, name):
    rows = [r for r in scores.join(labels, "doc_id").collect() if r.held_out]
    good, bad = [r for r in rows if r[name] == 1], [r for r in rows if r[name] == 0]
    wins = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in good for b in bad)
    return wins / (len(good) * len(bad)), rows


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    for f, name in ((quality, "quality"), (toxicity, "toxic")):
        auc, rows = measured(f(docs, labels), labels, name)
        assert auc > 0.8
        assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_edge_cases(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["calm", "river", "walks", "home"]) for _ in range(30)) + ".", 1) for i in range(100)]
    bad = [(100 + i, " ".join(rng.choice(["idiot$$$", "trash###"]) for _ in range(30)), 0) for i in range(60)]
    odd = [(500, None), (501, ""), (None, "calm river"), (502, "a" * 300_000), (500, None)]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t, *_ in [*good, *bad, *odd]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, y, 1 - y) for d, _, y in good + bad] + [(None, 1, 0), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (quality, toxicity):
        got = f(docs, labels).collect()
        assert len(got) == 165 and all(0 <= r.score <= 1 for r in got)
        assert f(docs.limit(0), labels).collect() == []
        assert len({r.score for r in f(docs, labels.limit(0)).collect()}) == 1
    by_id = {r.doc_id: r.predicted for r in toxicity(docs, labels).collect()}
    assert all(by_id[d] == 0 for d, *_ in good) and all(by_id[d] == 1 for d, *_ in bad)
    kept = {r.doc_id for r in keep_good(docs, labels).collect()}
    assert kept >= {d for d, *_ in good} and not kept & {d for d, *_ in bad}


def test_risk_and_gradient_by_hand(spark):
    """The two parts of the non-negative risk in plain Python, and their gradients by differences."""
    rng = np.random.default_rng(1)
    p, u = rng.integers(0, 4, (7, 3)) + [0, 4, 8], rng.integers(0, 4, (9, 3)) + [0, 4, 8]
    theta, prior = rng.normal(size=13), 0.37

    def plain(theta):
        z = lambda row: sum(theta[i] for i in row) + theta[-1]
        loss = lambda x: math.log1p(math.exp(-x))
        first = prior * sum(loss(z(r)) for r in p) / len(p)
        return first, sum(loss(-z(r)) for r in u) / len(u) - prior * sum(loss(-z(r)) for r in p) / len(p)

    first, rest, plus, minus = risk(theta, p, u, prior)
    assert np.allclose((first, rest), plain(theta))
    for i in range(13):
        step = np.eye(13)[i] * 1e-6
        up, down = plain(theta + step), plain(theta - step)
        assert abs((up[0] - down[0]) / 2e-6 - plus[i]) < 1e-6 and abs((up[1] - down[1]) / 2e-6 - minus[i]) < 1e-6


def test_prior_is_estimated_from_the_samples():
    """Positives around one point, unlabelled with a known share of them; no label is given."""
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.9):
        good = lambda n: rng.normal(0, 1, (n, 4))
        u = np.concatenate([good(int(8000 * share)), rng.normal(3, 1, (8000 - int(8000 * share), 4))])
        assert abs(estimate_prior(good(8000), rng.permutation(u)) - share) < 0.06


def test_fit_separates_what_it_never_saw_labelled():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0, 1, (4000, 4)), rng.normal(3, 1, (2000, 4))
    model = fit(good[:2000], np.concatenate([good[2000:], bad[:1000]]), 2 / 3)
    assert (model.score(rng.normal(0, 1, (500, 4))) >= 0.5).mean() > 0.95 and (model.score(bad[1000:]) >= 0.5).mean() < 0.05


def test_string_ratios_by_counter():
    texts = [b"The cat sat on the mat", b"abc", b"", b"abcd" * 9]
    plain = Counter()
    for t in texts:
        low = t.lower()
        for i in range(len(low) - GRAM + 1):
            h = 0
            for c in low[i : i + GRAM]:
                h = (h * 0x01000193 + c) % 2**32
            plain[(h * 0x9E3779B1) % 2**32 >> (32 - GRAM_BITS)] += 1
    found = Counter(int(x) for t in texts for x in gram_buckets(t))
    assert found == plain
    n = np.zeros(1 << GRAM_BITS, np.int64)
    for k, v in plain.items():
        n[k] = v
    ratios, k = gram_ratios(n, n[::-1].copy()), next(iter(plain))
    want = math.log((n[k] + 1) / (n.sum() + len(n))) - math.log((n[::-1][k] + 1) / (n.sum() + len(n)))
    assert abs(ratios[k] - max(-3, min(3, want))) < 1e-6
    assert len(features(b"")) == len(features(b"word " * 100_000))


def test_toxicity_counts_and_scores_by_counter(spark):
    """Which texts have which n-gram, their log-count ratios and the score of each text, all in plain Python."""
    rng = random.Random(6)
    word = lambda bad: rng.choice(["idiot", "trash", "awful"] if bad else ["calm", "river", "home"])
    rows = [(i, " ".join(word(i % 3 == 0) if rng.random() < 0.5 else rng.choice(["the", "and", "it"]) for _ in range(12)), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")

    def buckets(text):
        whole, out = b" " + b" ".join(text.lower().encode().split()) + b" ", set()
        for n in toxicity_nb.SIZES:
            for i in range(len(whole) - n + 1):
                h = 0
                for c in whole[i : i + n]:
                    h = (h * 0x01000193 + c) % 2**32
                out.add(((h ^ n) * 0x9E3779B1) % 2**32 >> (32 - toxicity_nb.BITS))
        return out

    learned = [(buckets(t), y) for d, t, y in rows if zlib.crc32(str(d).encode()) % 5]
    n_pos, n_neg = (sum(y == k for _, y in learned) for k in (1, 0))
    pos, neg = (Counter(b for found, y in learned if y == k for b in found) for k in (1, 0))
    model = toxicity_nb.train(docs, labels, keep=1 << 20)
    slots = {b: int(model.slot[b]) - 1 for b in {*pos, *neg}}
    assert min(slots.values()) >= 0
    scale = {b: math.log((pos[b] + 1) / (n_pos + 2)) - math.log((neg[b] + 1) / (n_neg + 2)) for b in slots}
    # A weight is the regression's times the ratio: strings of ratio zero weigh nothing, and every score is the sum over the text.
    assert all(abs(model.weights[slots[b]]) < 1e-9 for b in slots if scale[b] == 0)
    assert all(model.weights[slots[b]] >= 0 or scale[b] < 0 for b in slots if pos[b] and not neg[b])
    for d, t, _ in rows[:20]:
        z = sum(model.weights[model.slot[b] - 1] for b in buckets(t) if model.slot[b]) + model.bias
        assert abs(model.score(t.encode()) - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    found = toxicity_nb._counts(docs.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 <> 0").select(labels["toxic"].alias("label"), "text"))
    assert found[2:] == (n_pos, n_neg)
    assert {int(b): int(found[0][b]) for b in np.flatnonzero(found[0])} == dict(pos) and {int(b): int(found[1][b]) for b in np.flatnonzero(found[1])} == dict(neg)


def test_samples_stay_bounded_whatever_ids_repeat(spark):
    """A third of all rows under one labelled id that isn't held out, or without one, with one text or many."""
    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    for one in (hot, "null"):
        docs = spark.range(0, 30_000, 1, 6).selectExpr(f"case when id % 3 = 0 then {one} else id end as doc_id", "case when id % 6 = 0 then 'the same text' else concat('text ', id) end as text")
        labels = spark.range(0, 100).selectExpr("id as doc_id", "1 as quality")
        n = label_sample(docs, labels, "quality", 150).count()
        assert 50 <= n <= 400 if one == hot else 30 <= n <= 100
        assert 50 <= bounded(docs.select("text"), 150).count() <= 400
    few = docs.filter("doc_id < 100")
    assert bounded(few, 10_000).count() == few.count()
