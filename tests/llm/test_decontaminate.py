import random
import re

from palimpsest.llm.decontaminate import decontaminate


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for win, owners in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= owners
        out.append((d, len(w), sorted(hit), sorted(found, key=repr)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(d, t, "s") for d, t in items], "item_id long, text string, spans string")
    return sorted(((r.doc_id, r.n_words, [i for s in r.spans for i in range(s.start, s.end)], sorted(r["items"], key=repr)) for r in decontaminate(a, b, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)] + ["The", "ÉTÉ", "straße"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(12)] + [(3, text(12)), (50, None), (51, ""), (52, "..."), (None, text(14)), (60, "the the the the the the the the the the the")]
    docs = [(1, None), (2, ""), (None, items[3][1]), (3, "the " * 3000)]
    for i in range(40):
        t = rng.choice(items)[1] or ""
        docs.append((i, f"{text(rng.randint(0, 9))}, {t[rng.randint(0, 4) :]}! {text(rng.randint(0, 30))}"))
    docs += docs[-3:]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, block_bytes=200) == want
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])
