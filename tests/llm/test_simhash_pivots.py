"""SimHash near-duplicates against bit counts by hand and all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
import xxhash

from touchline.llm import simhash_pivots as S

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(brute.WORD, low)
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64(r.encode("utf-8", "surrogatepass"), seed=42).intdigest() for r in runs]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain(rows, most=4, k=4):
    fps = np.array([plain_fingerprint(t, k) for _, t in rows], dtype=np.uint64)
    union = brute.Union(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= most).tolist():
            union.join(i, j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            root = union.find(i)
            least[root] = min(least.get(root, id_), id_)
    return Counter((id_, f"{int(f):016x}", least.get(union.find(i))) for i, ((id_, _), f) in enumerate(zip(rows, fps)))


def check(docs, **options):
    got = Counter(tuple(r) for r in S.simhash_components(docs, **options).collect())
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got == plain(rows, options.get("most", 4), options.get("k", 4))
    return got


def test_whole_table(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert any(i != c for i, _, c in got)


@pytest.mark.parametrize("options", [{}, {"parts": 7}, {"most": 0, "parts": 3}, {"k": 1, "most": 2}])
def test_awkward_rows(spark, options):
    check(brute.table(spark), **options)


def test_empty_table(spark):
    assert not check(brute.table(spark, []))


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_segments_of_a_long_text(size, monkeypatch):
    monkeypatch.setattr(S, "_SEG", size)
    monkeypatch.setattr(S, "_RUNS", 7)
    for seed in range(20):
        text = random.Random(seed).choice(["\n", "  ", " "]).join(brute.words(seed, seed * 3).split()) + "\t"
        assert S.fingerprint(text, 4) % (1 << 64) == plain_fingerprint(text)


def clustered(n, seed, spread=6):
    """Fingerprints around few centres."""
    rnd = np.random.default_rng(seed)
    centre = rnd.integers(0, 1 << 63, 5, dtype=np.uint64)
    out = centre[rnd.integers(0, 5, n)]
    for _ in range(spread):
        out = out ^ (np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64))
    return np.unique(out)


def pairs_of(a, b, most):
    return {(min(x, y), max(x, y)) for x in a.tolist() for y in b.tolist() if x != y and (x ^ y).bit_count() <= most}


@pytest.mark.parametrize("most", [0, 2, 4])
def test_pivots_discard_no_near_pair(most, monkeypatch):
    monkeypatch.setattr(S, "_PAIRS", 1000)
    a, b = clustered(300, 1), clustered(200, 1, 5)
    zero = lambda x: np.zeros(len(x), dtype=np.int64)
    told = lambda p: {(min(x, y), max(x, y)) for x, y in zip(*(s.tolist() for s in p)) if x != y}
    assert told(S.near_pairs(a, zero(a), None, None, most)) == pairs_of(a, a, most)
    assert told(S.near_pairs(a, zero(a), b, zero(b), most)) == pairs_of(a, b, most)
    group = np.arange(len(a)) % 3
    want = set().union(*(pairs_of(a[group == g], a[group == g], most) for g in range(3)))
    assert told(S.near_pairs(a, group, None, None, most)) == want


def test_stars_keep_the_groups():
    rnd = random.Random(5)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]
    a, b = (np.array(x, dtype=np.uint64) for x in zip(*links))
    before, after = brute.Union(400), brute.Union(400)
    for x, y in links:
        before.join(x, y)
    more = list(zip(*(s.tolist() for s in S.stars(a, b))))
    for x, y in more:
        after.join(x, y)
    assert len(more) == 400 - len({before.find(i) for i in range(400)})
    assert all((before.find(x) == before.find(y)) == (after.find(x) == after.find(y)) for x in range(400) for y in range(0, 400, 7))


def test_large_keys_in_tiles(spark, monkeypatch):
    """A key far above a tile: the tiles' pairs give what all pairs give."""
    monkeypatch.setattr(S, "TILE", 64)
    fps = clustered(1500, 9, 4)
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = S._links(rows, 6, 4).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got, want = brute.Union(len(fps)), brute.Union(len(fps))
    for r in links:
        got.join(at[r.a], at[r.b])
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4).tolist():
            want.join(i, j)
    first = {}
    for i in range(len(fps)):
        first.setdefault(want.find(i), i)
    assert len({want.find(i) for i in range(len(fps))}) == len({got.find(i) for i in range(len(fps))})
    assert all(got.find(i) == got.find(first[want.find(i)]) for i in range(len(fps)))
