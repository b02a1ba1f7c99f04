import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm.packing import _Encoder, pack, pack_documents, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_full(rows, capacity):
    bins = defaultdict(list)
    for length, sequence, offset in rows:
        bins[sequence].append((offset, length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_plan_fills_bins_gaplessly():
    rng = random.Random(0)
    for capacity in (10, 30, 100, 4096):
        for _ in range(20):
            sizes = Counter(rng.randint(1, capacity) if rng.random() < 0.7 else max(1, capacity // 3 + rng.randint(-1, 1)) for _ in range(rng.randint(0, 2000)))
            plan = defaultdict(list)
            for row in sorted(plan_bins(sizes, capacity)):
                plan[row[0]].append(row)
            rows = []
            for n, count in sizes.items():
                for r in range(count):
                    _, first, start, each, offset = [p for p in plan[n] if p[1] <= r][-1]
                    rows.append((n, start + (r - first) // each, offset + (r - first) % each * n))
            used = check_full(rows, capacity)
            large = sum(c for n, c in sizes.items() if 2 * n > capacity)
            total = -(-sum(n * c for n, c in sizes.items()) // capacity)
            assert max(large, total) <= used <= 1.25 * max(large, total) + 2


def test_documents(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "it's I'LL don't", "naïve ÜNÏCODE ßtraße", "İstanbul Σίσυφος", "á b", "x<|endoftext|>y", "tab\tx\r\ny\x0bz\x1cq", "日本語", "½ ² ª", "a1b22 ...!!", "word " * 9000]
    texts += [" ".join(rng.choice(["the", "Of,", "été", "xyzzy!!", "12"]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    rows = [(i % 70, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "it's I'LL don't")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int")
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[d, k, at, len(part), tuple(part)] += 1
    got = pack_documents(docs, PATH, capacity=512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, tuple(r.ids)) for r in got) == want
    used = check_full([(r.length, r.sequence_id, r.offset) for r in got], 512)
    assert used <= 1.1 * sum(r.length for r in got) / 512 + 2
    digest = pack_documents(docs, PATH, capacity=512, digest=True).collect()
    assert Counter(r.ids_crc32 for r in digest) == Counter(zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert pack_documents(docs.limit(0), PATH).collect() == []


def test_one_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr("palimpsest.llm.packing._RANKED", 50)
    rows = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "cast(case when id % 3 = 0 then 7 else id % 9 + 1 end as long) as length")
    got = pack(rows, 20).collect()
    assert len(got) == 1000
    check_full([(r.length, r.sequence_id, r.offset) for r in got], 20)


def test_a_word_is_remembered_in_one_form():
    """Case and stops behind a word make no new entry, and ids stay those of the tokenizer on the whole text."""
    encoder, tokenizer = _Encoder(PATH, 50), Tokenizer.from_file(PATH)
    encoder.encode(["qorvan . ,", "", " Qorvan, QORVAN. qorvan."])
    assert set(encoder.known) - {""} == {"qorvan", ".", ","}
    rng = random.Random(3)
    parts = ["Été", "it's", "'s", "x'", "a.b", "...", "?!", "12", "7.", "ß.", "½", "(n)", "I'LL", "q,,", "--", "'", "e.g.", "O'", "_", "word;:"]
    for _ in range(60):
        texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_are_looked_up_a_few_at_a_time():
    """What Python holds for a group of texts is a few times its bytes, also where nearly every word is another one."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=6)) for _ in range(1_000)) + f" {i}, Été." for i in range(300)]
    encoder, tokenizer = _Encoder(PATH, 1_000), Tokenizer.from_file(PATH)
    tracemalloc.start()
    try:
        found = encoder.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * sum(map(len, texts))
    for i in (0, 1, 255, 256, 299):
        assert np.frombuffer(found[i], "<u4").tolist() == tokenizer.encode(texts[i], add_special_tokens=False).ids
    assert encoder.encode([]) == []
