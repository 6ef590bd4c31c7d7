"""Plain Python versions of the operators, and a table of awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, row string, n int, node string, "
    "size string, doc string, tag string, keep_id string, `key` string, component long, kept string, n_lines string, "
    "s string, lam int, mean string, target int, source_size int, `full` int, below int, __key int, __size int, __doc int"
)
EXTRA = (1, "r", 2, "x", "s", "d", "t", "k", "key", 3, "yes", "many", "s", 4, "m", 5, 6, 7, 8, 9, 10, 11)


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in any column, empty and blank texts, a very long text without a
    newline, repeated rows, repeated ids, ties, near copies."""
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed")
    line = words(2, 30)
    long_text = words(3, 30_000)
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, None, "en", "b"),
        (5, "", "de", None), (6, " \t\n ", None, "c"), (None, base, "en", "a"), (None, "alone here, with no id at all", "en", "c"),
        (7, long_text, "en", "a"), (8, line + "\n" + words(4, 40), "en", "b"), (9, line + "\n" + words(5, 40), "fr", None),
        (9, words(6, 50), "fr", "c"), (10, "x", "es", "c"), (11, "one two", "es", "a"), (12, "one two", "es", "a"),
        (13, "a  b\tc\x0bd", "en", "a"), (14, "a b c d", "en", "a"), (15, "é́ß 中文 \U0001f600 <|endoftext|> don't", "xx", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in texts]


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def shingles(text: str | None, k: int) -> frozenset:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(WORD, low)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def jaccard_components(docs: list[tuple], k: int, num: int, den: int) -> Counter:
    """(id, size of the set, smallest id of the component) of each row."""
    sets = [shingles(t, k) for _, t in docs]
    union = Union(len(docs))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    least: dict[int, int] = {}
    for i, (id_, _) in enumerate(docs):
        if id_ is not None:
            root = union.find(i)
            least[root] = min(least.get(root, id_), id_)
    return Counter(
        (id_, len(s), id_ if not s else least.get(union.find(i))) for i, ((id_, _), s) in enumerate(zip(docs, sets))
    )


def repeated_bytes(texts: list[str | None], length: int) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, spans, kept bytes) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(d) else 0, kept))
    return out


def levenshtein(a: str, b: str) -> int:
    """The edit distance by Myers' bit vectors."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    all_, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = all_, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        x, y = same | down, (((same & up) + up) ^ up) | same
        plus, minus = down | ~(y | up) & all_, up & y
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(x | plus)) & all_, plus & x & all_
    return score


def winnow(units: list[int], w: int) -> list[tuple[int, int]]:
    """(position, hash) chosen from rolling hashes: the smallest of each
    window, the rightmost of equal ones."""
    here = max(1, min(w, len(units) // 4))
    chosen = set()
    for i in range(max(0, len(units) - here + 1)):
        best = min(range(i, i + here), key=lambda j: (units[j], -j))
        chosen.add((best, units[best]))
    return sorted(chosen)


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def by(rows, key) -> dict:
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out
