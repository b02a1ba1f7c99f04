import random

import pytest

from palimpsest.llm import line_dedup as module
from palimpsest.llm.line_dedup import line_dedup


def brute(rows, least_chars=40, least_docs=5, keep=max):
    def key(line):
        x = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)

    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stays = []
        for line in lines:
            k = key(line)
            ids = holders[k]
            if len(k) < least_chars or len(ids) < least_docs or d == keep(i for i in ids if i is not None):
                stays.append(line)
        out.append((d, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out, key=repr)


def run(spark, rows, parts=5, **options):
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, key string, lines int").repartition(parts)
    return sorted((tuple(r) for r in line_dedup(docs, **options).collect()), key=repr)


def corpus(rng, n, pool, ids):
    lines = [rng.choice(["", " ", "\t"]) + x + rng.choice(["", "  ", "\r"]) for x in pool for _ in range(2)]
    return [(i, "\n".join(rng.choice(lines + ["own line of document number %d and nothing else but it" % i]) for _ in range(rng.randint(0, 6)))) for i in ids[:n]]


@pytest.mark.parametrize("bits", [1 << 16, 1 << 20])
def test_equals_brute_force(spark, bits):
    rng = random.Random(6)
    pool = [("line %d of a page that many of the others show " % i) + "é" * rng.randint(0, 4) + rng.choice(["Abc", "ABC", "ß", "É"]) for i in range(60)]
    pool += ["x" * 39, "x" * 40, "é" * 39, "é" * 40, "𝄞" * 39, "𝄞" * 40, "X" * 40, "", "short"]
    rows = corpus(rng, 200, pool, rng.sample(range(10_000), 300))
    assert run(spark, rows, bits=bits) == brute(rows)
    assert run(spark, rows, bits=bits, keep="smallest", least_docs=2) == brute(rows, least_docs=2, keep=min)


def test_edge_cases(spark):
    line = "a line that stands in more than five documents of this table"
    rows = [(1, None), (2, ""), (3, line), (4, line.upper() + "\r\n\n"), (5, f" {line}\n{line}\nmine"), (6, line), (6, line), (6, line + "\n" + "z" * 50), (None, line), (None, line + "\nother"), (None, None)]
    rows += [(10 + i, "z" * 50) for i in range(3)] + [(20, "word " * 100_000), (21, "\n" * 50_000), (22, (line + "\n") * 20_000), (23, line)]
    assert run(spark, rows, bits=1 << 20) == brute(rows)
    assert run(spark, [], bits=1 << 20) == []
    with pytest.raises(ValueError):
        run(spark, rows, bits=1000)
    with pytest.raises(ValueError):
        run(spark, rows, keep="any")


def test_rows_without_an_id_are_one_document(spark):
    line = "the very same line, forty code points and more"
    rows = [(None, f"{line}\n{i}") for i in range(50)] + [(i, line) for i in range(3)]
    assert all(r[2] == 0 for r in run(spark, rows, bits=1 << 16))
    rows.append((9, line))
    assert run(spark, rows, bits=1 << 16) == brute(rows)


def test_only_suspects_are_handed_on(spark, monkeypatch):
    """Lines of one document stay in their scan; those of two are all found, however they are dealt out."""
    monkeypatch.setattr(module, "_GATHERED", 50)
    rows = [(i, f"line {i // 2} that stands in two documents of the table\nline of document {i} that stands nowhere else") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).selectExpr("doc_id", "0L as mark", "text")
    second = module.np.zeros(((1 << 20) // module._BLOCK, module._BLOCK // 8), module.np.uint8)
    for r in module._merged(module._set_bits(docs, 40, 1 << 20)).collect():
        second[r.block] = module.np.frombuffer(r.seen, module.np.uint8)
    found = module._suspects(docs, spark.sparkContext.broadcast(second), 40, 1 << 20).select("doc_id", "lines").collect()
    assert sorted(r.doc_id for r in found if r.lines == [0]) == list(range(400))
    assert sum(r.lines == [1] for r in found) < 5
