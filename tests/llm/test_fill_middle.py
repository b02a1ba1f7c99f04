import hashlib
import random
import re

from palimpsest.llm.fill_middle import fill_middle


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, None, text, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return doc_id, len(units), "spm" if spm else "psm", p, m, s, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n int, form string")
    return sorted((tuple(r) for r in fill_middle(docs).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pieces = ["ab", "Zq", "\x01", "\x02", "\x020", "\x021", "0", "1", " ", "\n", "\r\n", "é", "𝄞", "<", ">", "<P", "S>", "<S<", "\\", "$0", "\x00", "-"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(i, x) for i, x in enumerate(["<P>", "a<S>b", "<M>", "<P", "x" * 3, "1", "\x01", "\x02\x01\x02"] * 8)]
    assert run(spark, rows) == sorted((brute(*r) for r in rows), key=repr)
    assert {r[2] for r in run(spark, rows)} == {"plain", "psm", "spm"}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "no id at all"), (None, None), (3, "same row"), (3, "same row"), (3, "other text"), (-7, "negative id"), (4, "long words " * 60_000), (5, "y" * 500_000), (6, "\x01" * 100_000)]
    assert run(spark, rows) == sorted((brute(*r) for r in rows), key=repr)
    assert run(spark, []) == []
