import itertools
import random
import re

from palimpsest.llm.filter_audit import filter_audit


def brute(rows, labels):
    failed = []
    for d, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if any((u or "") == t and i is not None and (d is None or i < d) for i, u, _ in rows):
            fails.add("E")
        failed.append(fails)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part in {s or "" for _, _, s in rows}:
        mine = [(f, d) for f, (d, _, s) in zip(failed, rows, strict=True) if (s or "") == part]
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone, left = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                total[x] += len(gone)
                fails = sum(x in f for f, _ in mine)
                found.append(("".join(order), k + 1, x, len(left), len(gone), fails - len(gone), sum(f == {x} for f, _ in mine), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone)))
        out += [(part, o, k, *rest, total[x]) for o, k, x, *rest in found]
    return sorted(out)


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, True, 1) for r in rows], "doc_id long, text string, source string, A boolean, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit(docs, marks).collect())


def test_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = []
    for _ in range(40):
        few = [word() for _ in range(rng.choice([3, 60]))]
        text = " ".join(rng.choice(few) for _ in range(rng.choice([10, 60])))
        text = text.upper() if rng.random() < 0.3 else text
        texts.append(text + rng.choice(["", "", " $", "\n|x"]))
    ids = rng.sample(range(1000), 150)
    rows = [(i, rng.choice(texts), rng.choice(["x", "y", "hot", "hot", "hot", None, ""])) for i in ids]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(ids, 90)] + [(5000, 1, 1), (None, 1, 1), (ids[0], 1, 0), (ids[0], 0, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_edge_cases(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "s"), (2, "", "s"), (None, "", "s"), (None, words, "s"), (None, words, "t"), (3, words, "t"), (3, words, "t"), (3, words, "s"), (4, words, None), (5, "A" * 300_000, "t"), (6, "a b " * 50_000, "t"), (7, " \t\n", "s"), (None, "own", "u"), (None, "own", "u")]
    labels = [(3, 1, 1), (4, None, 1), (6, 0, 0)]
    got = run(spark, rows, labels)
    assert got == brute(rows, labels)
    assert len(got) == 4 * 600
    assert run(spark, [], labels) == []
    assert run(spark, rows, []) == brute(rows, [])
