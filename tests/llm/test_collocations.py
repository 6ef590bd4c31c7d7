"""Phrase collocations against a count of every run of words."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import collocations as C

SF = "/root/testdata/sf0.001"


def plain(rows, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in count.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * found[q]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def check(docs, **options):
    got = sorted(tuple(r) for r in C.collocations(docs, **options).collect())
    assert got == plain([tuple(r) for r in docs.select("text", "lang").collect()], **options)
    return got


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check(docs)
    assert len(check(docs, least=3, top=7)) <= 4 * 7


def test_awkward_rows(spark):
    rows = brute.awkward() * 6
    check(brute.table(spark, rows), least=4)
    assert check(brute.table(spark, [])) == []


def test_pieces_ties_and_languages(spark):
    text = "Alpha beta. gamma\tdelta epsilon\nbeta,alpha beta;;alpha  beta?delta epsilon! zeta zeta zeta zeta"
    rows = [(text, "en")] * 7 + [(text.upper(), None)] * 11 + [("", "und"), (None, None), ("é ü é ü", "und")]
    got = check(spark.createDataFrame(rows, "text string, lang string"), least=2)
    assert {"und", "en"} == {r[0] for r in got}
    assert not any("beta gamma" in r[2] for r in got)


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_a_long_text_loses_no_phrase_at_its_segments(size, monkeypatch):
    monkeypatch.setattr(C, "_SEG", size)
    rnd = random.Random(size)
    texts = ["".join(rnd.choice(["a", "b ", "cc ", ". ", "\t", ","]) for _ in range(n)) for n in (0, 3, 30, 400, 5, 90)]
    batch = pa.RecordBatch.from_arrays([pa.array([5] * len(texts), pa.int64()), pa.array(texts)], ["salt", "text"])
    for carry in (0, 1, 2):
        got = Counter()
        for w, _, _ in C.segments([batch], carry):
            for i in range(len(w.keys) - carry):
                if i + carry >= w.given and not w.first[i + 1 : i + carry + 1].any():
                    got[tuple(w.keys[i : i + carry + 1].tolist())] += 1
        want = Counter()
        for text in texts:
            whole = C.Words(text.encode(), np.array([len(text) + 1]), np.array([5], dtype=np.uint64))
            for i in range(len(whole.keys) - carry):
                if not whole.first[i + 1 : i + carry + 1].any():
                    want[tuple(whole.keys[i : i + carry + 1].tolist())] += 1
        assert got == want


def test_dense_and_sparse_tiles_agree():
    rnd = np.random.default_rng(3)
    keys = C.mix64(np.arange(1, 6001, dtype=np.uint64))
    full = np.full(1 << (C.MAP_BITS - 6), np.uint64(0xFFFFFFFFFFFFFFFF))
    ranked = C.Ranked(keys[: C.HEAD], full)
    tiles, want = C.Tiles(ranked, ranked), Counter()
    for _ in range(3):
        a, b = (keys[np.minimum(rnd.zipf(1.3, 200_000) - 1, 5999)] for _ in range(2))
        tiles.add(a, b)
        want.update(zip(a.tolist(), b.tolist()))
    assert tiles.dense and tiles.sparse.size
    got = Counter()
    for n, left, right in [*tiles.cells(), *(x[1:] for x in tiles.sparse.take())]:
        for x, y, m in zip(left.tolist(), right.tolist(), n.tolist()):
            got[x, y] += m
    assert got == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = [(9_000_000_000_000_000, 9_000_000_000_000_001, 9_100_000_000_000_000), (3_000_000_001, 3_000_000_007, 4_000_000_009)]
    rows = spark.createDataFrame(big, "a long, l long, r long").select(C._score("a", "l", "r").alias("s"), F.col("a"))
    assert {r.a: r.s for r in rows.collect()} == {a: 1000000 * a * a // (left * right) for a, left, right in big}
