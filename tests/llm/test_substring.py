import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import substring_dedup as module
from palimpsest.llm.common import in_pieces
from palimpsest.llm.substring_dedup import substring_dedup


def brute(rows, length=50):
    texts = [(t or "").encode() for _, t in rows]
    ids = [float("inf") if d is None else d for d, _ in rows]
    least = {}
    for d, x in zip(ids, texts, strict=True):
        for s in range(len(x) - length + 1):
            w = x[s : s + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for (doc, _), d, x in zip(rows, ids, texts, strict=True):
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            if least[x[s : s + length]] < d:
                gone[s : s + length] = b"\1" * length
        spans, at = [], 0
        while at < len(x):
            end = at
            while end < len(x) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append((doc, len(x), spans, bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, size long, trigger string")
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in substring_dedup(docs, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = ["the", "of", "and", "straße", "été", "na", "ation", "er", "x"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(5, 40)) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 20) :], text(rng.randint(0, 9))]
        rows.append((i * 37 % 101, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(200 + i, rows[i % 7][1]) for i in range(30)]
    rows += [(300 + i, rows[3][1].replace("the", "The", rng.randint(0, 3))) for i in range(10)]
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    body = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-" * 2
    rows = [(1, None), (2, ""), (3, "short"), (4, body), (5, body), (5, body), (5, body + "tail of another text"), (None, body), (None, body + "!")]
    rows += [(6, body[:49]), (7, body[:50]), (8, "aa" * 200), (9, "a" * 70), (10, "b" * 49 + "a" * 60), (11, "The " * 3000), (12, "The " * 40), (0, "The " * 13)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, section=64) == brute(rows)
    assert run(spark, []) == []


def test_many_rows_without_an_id_and_under_one(spark):
    """Hundreds of equal and different texts under a null id and under one id count only against smaller ids."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(5, 40))) for _ in range(30)]
    rows = [(None, texts[i % 20]) for i in range(300)] + [(7, texts[10 + i % 20]) for i in range(300)] + [(3, texts[15]), (9, texts[0] + texts[12])]
    assert run(spark, rows) == brute(rows)


def test_hot_triggers(spark, monkeypatch):
    """Passages that every document goes on from differently, with every trigger that occurs in a sample dealt out."""
    monkeypatch.setattr(module, "_EVERY", 2)
    monkeypatch.setattr(module, "_HOT_ROWS", 4)
    rng = random.Random(3)
    passage = "this passage stands in every document and then each of them goes on in another way: "
    rows = [(i, passage * rng.randint(1, 3) + " ".join(f"{rng.randrange(10**6)}" for _ in range(rng.randint(0, 12)))) for i in range(200)] + [(500, "x" * 700), (501, "x" * 60), (502, "y" + "x" * 300)]
    docs = spark.createDataFrame(rows, "did long, text string").select("did", F.lit(0).cast("long").alias("mark"), "text")
    assert len(module._hot_triggers(docs, 50, module.SECTION)) > 0
    assert run(spark, rows) == brute(rows)


def test_phrases_that_share_bits_of_their_hash(spark):
    """Two phrases of one trigger that agree in 40 bits of a 64-bit hash: no string of 50 bytes is shared, so nothing goes."""
    rows = [(1, "orqdtqyuibjisoiqjtoppxqcxkvuokejhlpfwxoahcndpduitp"), (2, "lvhufzoelxlezazlcalubdnswjilwiejhlpfwxoahcndpduitp")]
    assert [r[2] for r in run(spark, rows)] == [[], []]
    assert run(spark, rows) == brute(rows)


def test_equal_phrases_of_a_document_are_one_row(spark):
    docs = spark.createDataFrame([(1, 0, "a" * 1_000_000), (2, 0, "a" * 1_000_000 + "b"), (3, 0, "ab" * 100_000)], "did long, mark long, text string").repartition(3)
    assert module._phrases(docs, 50, module.SECTION, module.np.zeros(0, module.np.int64)).count() < 2_000
    rng = random.Random(7)
    unit = ["x" * 120, "ab" * 60, "the same sentence once more, and then again. ", "\x00" * 55]
    rows = [(i, "".join(rng.choice(unit) + rng.choice(["", "-", str(i)]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(70, "a" * 2_000), (71, "b" + "a" * 3_000 + "c"), (None, "a" * 60), (71, "ab" * 300), (72, "xab" + "ab" * 200)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, section=64) == brute(rows)


def test_ids_that_are_not_integers_are_refused(spark):
    with pytest.raises(ValueError):
        substring_dedup(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_phrases_of_a_batch_are_taken_in_pieces(monkeypatch):
    """A task holds the phrases of a few texts, however large the batch: each piece goes on before the next one is parsed."""

    class Texts:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(module, "_PIECE", 50_000, raising=False)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=10_000)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([0] * 40), pa.array(texts)], ["did", "mark", "text"])
    out = list(module._phrases(Texts(), 50, module.SECTION, module.np.zeros(0, module.np.int64))(iter([batch])))
    assert len(out) == 8 and sum(map(len, out)) > 20_000
    assert max(map(len, out)) < 5_000
    assert sorted({d for x in out for d in x.column(2).to_pylist()}) == list(range(40))


def test_pieces_hold_every_row_once():
    sizes = [3, 0, None, 7, 30, 1, 1, 10, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([n if n is None else "x" * n for n in sizes])], ["doc_id", "text"])
    pieces = [x.column(0).to_pylist() for x in in_pieces(batch.slice(0), 1, 10)]
    assert pieces == [[0, 1, 2, 3], [4], [5, 6], [7, 8]]
    assert [x.column(0).to_pylist() for x in in_pieces(batch.slice(3), "text", 10)] == [[3], [4], [5, 6], [7, 8]]
    assert list(in_pieces(batch.slice(9), 1, 10)) == []
