"""License scan: an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_bytes, fill_partitions, id_and_text

# The phrases that are looked for word by word, and what they mean.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices that a block of text can hold in other words or order.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license version 2 0", "mpl-2"),
    ("all rights reserved", "all-rights-reserved"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
        "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
        "isc",
    ),
)

#: A-Z to a-z; digits, letters and bytes above 0x7F stay; all else separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class _Join:
    """Templates as token ranks from the rarest on, with the prefixes that a block must share a token with."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], threshold: float, counts: dict[bytes, int], block: int):
        order = {w: r for r, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        self.phrases = []
        for text, label in phrases:
            words = words_of(text.encode())
            at = min(range(len(words)), key=lambda i: order[words[i]])
            self.phrases.append((words, at, label))
        #: (tokens, prefix, how many a block must hold, words of a block, label)
        self.templates = []
        for text, label in templates:
            words = words_of(text.encode())
            tokens = sorted(set(words), key=order.__getitem__)
            need = math.ceil(threshold * len(tokens) - 1e-9)
            self.templates.append((frozenset(tokens), frozenset(tokens[: len(tokens) - need + 1]), need, max(block, 2 * len(words)), label))
        self.rare = frozenset().union(*(prefix for _, prefix, *_ in self.templates)) | {w[at] for w, at, _ in self.phrases}

    def places(self, words: list[bytes], found: set[bytes]) -> list[tuple[str, int, int]]:
        """Where the phrases stand."""
        out = []
        for phrase, at, label in self.phrases:
            if phrase[at] in found:
                n = len(phrase)
                out += [(label, i - at, i - at + n) for i, w in enumerate(words) if w == phrase[at] and i >= at and words[i - at : i - at + n] == phrase]
        return sorted(out, key=lambda x: (x[1], x[0]))

    def blocks(self, words: list[bytes], found: set[bytes]) -> list[tuple[str, int, int, float]]:
        """For each template the blocks that meet the threshold, those that overlap as one, with the best containment."""
        out = []
        own = set(words)
        for tokens, prefix, need, size, label in self.templates:
            if prefix.isdisjoint(found) or len(tokens & own) < need:  # too few of them in the whole text
                continue
            at = [i for i, w in enumerate(words) if w in tokens]
            hits = [i for i in at if words[i] in prefix]
            counts: dict[bytes, int] = {}
            end, h, runs = 0, 0, []
            for n, i in enumerate(at):  # blocks that begin with a token; any other holds no more than the next of them
                while end < len(at) and at[end] < i + size:
                    counts[words[at[end]]] = counts.get(words[at[end]], 0) + 1
                    end += 1
                while h < len(hits) and hits[h] < i:
                    h += 1
                if h < len(hits) and hits[h] < i + size and end - n >= need and len(counts) >= need:
                    stop, share = min(len(words), i + size), len(counts) / len(tokens)
                    if runs and i < runs[-1][1]:
                        runs[-1][1:] = stop, max(share, runs[-1][2])
                    else:
                        runs.append([i, stop, share])
                counts[words[i]] -= 1
                if not counts[words[i]]:
                    del counts[words[i]]
            out += [(label, a, b, share) for a, b, share in runs]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _counts(texts: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """Documents that have each token of the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = dict.fromkeys(tokens, 0)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                for w in tokens.intersection(words_of(text)):
                    sums[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["token", "n"])

    rows = texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(tokens, 0) | {bytes(r.token): r.n for r in rows}


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.85,
    block: int = 32,
) -> DataFrame:
    """One row per input row: doc_id, n_words, places, blocks.

    places: where a phrase's words stand in a row (label, start, end in words).
    blocks: for each template the runs of words that hold at least `threshold` of
    its distinct tokens within a block of twice its words, or `block` words where
    that is more (label, start, end, containment): a block may begin at any word,
    those that overlap are one, and the best containment of them counts. So a
    notice is found wherever it stands, with as many words again between its own.

    Template tokens are ordered by the number of documents that have them, over all
    documents. A block that reaches the threshold must hold one of a template's
    rarest tokens, its prefix, so only places around such a token are looked at;
    the number of a template's tokens in the text and in the block bounds what can
    be shared; only then are the sets compared, token by token as the block moves.
    Templates and phrases are arguments, not data: they go to every task, and
    documents are scanned where they lie, at a cost in proportion to their words.

    A null or empty text has no words, places or blocks. Repeated rows get a row
    each; a null id is kept; an empty table gives an empty result; other columns
    are not read. Texts of any length are read whole.
    """
    texts = fill_partitions(id_and_text(docs, id_col, text_col))
    tokens = {w for t, _ in (*phrases, *templates) for w in words_of(t.encode())}
    join = _Join(phrases, templates, threshold, _counts(texts, tokens), block)
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    hit = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, places, blocks = [], [], []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                found = join.rare.intersection(words)
                total.append(len(words))
                places.append([dict(zip(("label", "start", "end"), x, strict=True)) for x in (join.places(words, found) if found else ())])
                blocks.append([dict(zip(("label", "start", "end", "containment"), x, strict=True)) for x in (join.blocks(words, found) if found else ())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(places, place), pa.array(blocks, hit)], ["doc_id", "n_words", "places", "blocks"])

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<label:string,start:long,end:long>>, blocks array<struct<label:string,start:long,end:long,containment:double>>")
