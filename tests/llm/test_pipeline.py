import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from palimpsest.llm import quality_pu
from palimpsest.llm.decontaminate import keep_clean
from palimpsest.llm.exact_dedup import keep_first
from palimpsest.llm.quality_pu import keep_good
from palimpsest.llm.simhash_dedup import keep_one
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import jaccard, shingles

FOLDER = "/root/testdata/sf0.001"


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def firsts(rows):
    """Of (id, text) rows of equal texts the one with the smallest id, null last."""
    out = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        out.setdefault(normal(t), (d, t))
    return out.values()


def groups(rows):
    """Of (id, text) rows of one group of near copies the one with the smallest id; compared pair by pair."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [shingles(t or "") if (t or "").split() else set() for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = not sets[i] and not sets[j] or sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8
            if same and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [rows[r] for r in sorted(set(root))]


def test_quality_stage(spark):
    """The rows that the trained model, applied to each text in plain Python, scores 0.3 or more."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    trained = quality_pu.train(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    score = lambda t: trained.score(np.array([[*quality_pu.features((t or "").encode()), trained.lexical((t or "").encode())]]))[0]
    good = {d for d, t in rows.items() if score(t) >= 0.3}
    assert 0.5 * len(rows) < len(good) < len(rows)
    assert {r.doc_id for r in cp.quality_classifier(spark, docs, folder).collect()} == good


def test_stages(spark):
    """Each stage after the first against a plain version of its rule, on what its predecessor kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in cp.quality_classifier(spark, docs, FOLDER).collect()}

    unique = {d for d, _ in firsts([(d, rows[d]) for d in good])}
    kept = docs.filter(docs.doc_id.isin(*unique))
    assert {r.doc_id for r in cp.exact_duplicates(spark, docs.filter(docs.doc_id.isin(*good)), FOLDER).collect()} == unique

    alone = {d for d, _ in groups([(d, rows[d]) for d in unique])}
    near = cp.near_duplicates(spark, kept, FOLDER)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == alone

    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {d for d, _, hit, _ in brute([(d, rows[d]) for d in alone], items) if not hit}
    assert {r.doc_id for r in cp.benchmark_decontamination(spark, near, FOLDER).collect()} == clean

    packed = cp.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == clean
    assert all(1 <= r.length <= 4096 for r in packed)


LONG = " ".join(f"w{i}" for i in range(60))
ODD = [
    (3, "x"), (5, "x"), (5, "unique"), (7, "z"), (7, "z"), (7, "z "), (None, "x"), (None, "only here"), (None, "only here"), (8, None), (9, ""), (None, None), (2, " \n"), (11, LONG), (11, LONG + " more"), (10, LONG.replace("w59", "v")), (12, "long " * 60_000),
]
SCHEMA = "doc_id long, text string, kept boolean, row string, component_id long, low string, label int, id int, md5 string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, True, str(i), 1, "l", 2, 3, "m") for i, (d, t) in enumerate(rows)], SCHEMA)


def found(df):
    assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [ODD, ODD[::-1], []])
def test_rows_go_and_not_ids(spark, rows):
    """Null and repeated ids, equal rows, empty and long texts, clashing columns: one row of each text or group stays, whatever else its id has."""
    docs = frame(spark, rows)
    exact = found(keep_first(docs))
    assert [normal(t) for _, t in exact] == [normal(t) for _, t in sorted(firsts(rows), key=lambda r: repr(next(e for e in exact if normal(e[1]) == normal(r[1]))))]
    assert {(d, normal(t)) for d, t in exact} == {(d, normal(t)) for d, t in firsts(rows)} and len(exact) == len(firsts(rows))
    near = found(keep_one(docs, **cp.NEAR))
    want = groups(rows)
    assert len(near) == len(want) and {(d, tuple((t or "").split())) for d, t in near} == {(d, tuple((t or "").split())) for d, t in want}


def test_contaminated_rows_go_whatever_their_id(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, "a " + item), (1, "clean"), (None, item + " b"), (None, "clean too"), (2, None), (2, ""), (3, item), (3, item), (4, item[:-4]), (5, "pad " * 50_000 + item)]
    items = spark.createDataFrame([("i", item), ("i", item), (None, None), ("e", "")], "item_id string, text string")
    assert found(keep_clean(frame(spark, rows), items)) == sorted([(1, "clean"), (None, "clean too"), (2, None), (2, "")], key=repr)
    assert found(keep_clean(frame(spark, []), items)) == [] and len(found(keep_clean(frame(spark, rows), items.limit(0)))) == len(rows)


def test_quality_judges_texts(spark):
    rng = random.Random(9)
    good = [(i, " ".join(rng.choice(["calm", "river", "walks", "home", "late"]) for _ in range(30)) + ".") for i in range(400)]
    bad = [(1000 + i, " ".join(rng.choice(["$$$", "###", "!!!", "%%%"]) for _ in range(30))) for i in range(300)]
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _ in good + bad], "doc_id long, quality int")
    extra = [(None, good[3][1]), (None, bad[3][1]), (5, good[5][1]), (5, bad[5][1]), (5000, None)]
    got = found(keep_good(frame(spark, good + bad + extra), labels))
    texts = {t for _, t in got}
    assert {t for _, t in good} <= texts and not texts & {t for _, t in bad}
    assert (None, good[3][1]) in got and got.count((5, good[5][1])) == 2
    assert found(keep_good(frame(spark, []), labels)) == []
