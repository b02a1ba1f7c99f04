import math
import re

from palimpsest.llm.license_scan import PHRASES, TEMPLATES, license_scan

NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
ROWS = [
    (1, None), (2, ""), (3, "Under the MIT\nLicense; under the mit license"), (4, "cc-by-nc cc by nc by"), (5, "Licensed under the Apache License, Version 2.0."),
    (6, "x " * 40 + NOTICE + " y" * 9000), (7, NOTICE.replace("hereby", "now")), (8, "license mit the under"), (8, "license mit the under"), (None, "All rights reserved."), (9, "released the under license MIT z"), (10, "mit " * 5000),
]


def brute(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    places = sorted((label, i, i + len(p.split())) for p, label in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    blocks = []
    for t, label in TEMPLATES:
        want, size, mine = set(t.split()), max(32, 2 * len(t.split())), []
        for i in range(len(w)):
            share = len(want & set(w[i : i + size])) / len(want)
            if w[i] in want and share >= 0.85 - 1e-9:
                stop = min(len(w), i + size)
                if mine and i < mine[-1][2]:
                    mine[-1] = (label, mine[-1][1], stop, max(share, mine[-1][3]))
                else:
                    mine.append((label, i, stop, share))
        blocks += mine
    return len(w), places, sorted(blocks)


def test_spread_notices_are_found_at_any_place(spark):
    """A notice whose words are spread over 31 by inserted ones, at every offset, and a whole license with a word after every second."""
    words = NOTICE.lower().replace(",", "").split()
    spread = [x for i, w in enumerate(words) for x in ([w, "zz"] if i % 2 == 0 or i > 2 else [w])][:31]
    rows = [(k, "qq " * k + " ".join(spread) + " qq" * 40) for k in range(33)]
    whole = [x for i, w in enumerate(TEMPLATES[-1][0].split()) for x in ([w, "zz"] if i % 2 else [w])]
    rows += [(100, "start of file " * 50 + " ".join(whole)), (101, " ".join(reversed(whole))), (102, " ".join(x for w in TEMPLATES[-1][0].split() for x in (w, "a1", "b1")))]
    got = {r.doc_id: {b.label for b in r.blocks} for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("mit" in got[k] for k in range(33))
    assert "isc" in got[100] and "isc" in got[101] and "isc" not in got[102]


def test_license_scan(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, places int")
    got = sorted(((r.doc_id, r.n_words, sorted(map(tuple, r.places)), sorted(map(tuple, r.blocks))) for r in license_scan(docs).collect()), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in ROWS), key=repr)
    assert license_scan(docs.limit(0)).collect() == []
