import hashlib
import re

from pyspark.sql import functions as F

from palimpsest.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, h string, body int, keep_id int"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm, strict=True):
        ids = [i for (i, _), m in zip(rows, norm, strict=True) if m == n and i is not None]
        keep = min(ids, default=None)
        out.append((d, keep, norm.count(n), d is not None and d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in exact_dedup(docs, **options).collect()), key=repr)


ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (9, None), (8, ""), (8, ""), (7, " "), (None, "a b"), (None, "z"), (5, "é x"), (4, "é x"), (6, "w " * 50000), (10, "w  " * 50000)]


def test_equals_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)
    assert run(spark, []) == []


def test_collisions_are_told_apart(spark):
    assert run(spark, ROWS, key=lambda text: F.substring(F.md5(text), 1, 0)) == brute(ROWS)


def test_many_groups_meet_by_a_shuffle(spark):
    assert run(spark, ROWS, sent_groups=0) == brute(ROWS)
    assert run(spark, ROWS, sent_groups=0, key=lambda text: F.substring(F.md5(text), 1, 0)) == brute(ROWS)
