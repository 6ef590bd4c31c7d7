"""Operator 3: language identification by Bayesian evidence fusion.

Each row's posterior over the languages and "und" (undetermined) multiplies:

* the likelihood of the whole text under character-trigram models (hashed to a
  fixed table, one per language). "und" has a background model, the pairs of bytes
  of all languages' samples together, or the uniform one if that fits better: a text
  in the letters of the known languages but not in their trigrams is nearer to the
  background. It must be better by UNKNOWN_MARGIN a trigram, as single odd words are
  no other language. The mean log likelihood of a trigram counts as at most
  TEXT_WEIGHT independent trigrams, so a long text does not silence the other
  evidence;
* the declared language (the markup's lang attribute, or a column), which is
  right with probability TRUST;
* the address suffix, by how often each suffix goes with each declared
  language;
* the host's prior, hierarchically smoothed: the host's counts of declared
  languages are smoothed towards its domain's, those towards the corpus's.

The counts come from grouped aggregation over all rows; only the trigram models
are fitted on a bounded sample of labelled rows (`per_language` for each
language, those with the smallest hash of id and text). Texts never leave the scan:
they become a few numbers first, and these are joined with the hosts' priors,
so a host that holds a third of all rows is a partial aggregate and a join
partition that the adaptive planner splits.

Rejected (kept = false): "und" is the most probable, or the most probable
language has less than `least` of the posterior. Cases: null and empty texts
and texts without letters have no trigram and are "und"; a null or unknown
declared language, suffix or host is no evidence (a null host's prior is its
domain's or the corpus's); repeated rows count each; an empty table gives an
empty result; a language without a labelled row keeps a uniform text model;
of languages that are equally probable the first named is told; very long texts are
read whole, in segments; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from touchline.llm.common import staged, text_or_empty
from touchline.llm.tokens import slices

LANGUAGES = ("en", "de", "fr", "es")
UNKNOWN = "und"
TABLE = 1 << 16
PER_LANGUAGE = 2000
TEXT_WEIGHT = 60.0
TRUST = 0.9
SMOOTH = 10.0
UNKNOWN_PRIOR = 0.01
UNKNOWN_MARGIN = 0.5
_SEG = 1 << 20
# Bytes of a text that are part of a word: letters and everything beyond ASCII.
_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_CLEAN = np.array([b if _LETTER[b] else 0x20 for b in range(256)], dtype=np.int64)


def _bytes(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, whether a trigram starts there) of the text's segments: lower case,
    anything but letters is a space, at most one space in a trigram."""
    data = text.lower().encode("utf-8", "surrogatepass")
    for at in range(0, len(data), _SEG):
        b = _CLEAN[np.frombuffer(data, dtype=np.uint8, count=min(_SEG + 2, len(data) - at), offset=at)]
        if len(b) > 2:
            space = b == 0x20
            yield b, space[:-2].astype(np.int8) + space[1:-1] + space[2:] < 2


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def trigrams(text: str) -> np.ndarray:
    """Places in the table of the text's trigrams."""
    out = []
    for b, ok in _bytes(text):
        place = (b[:-2] * 0x9E37 + b[1:-1]) * 0x85EB + b[2:]
        out.append((place[ok] ^ place[ok] >> 16) & (TABLE - 1))
    return _joined(out)


def pairs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second pair of bytes of each of the text's trigrams."""
    both = [(b[:-1] * 256 + b[1:], ok) for b, ok in _bytes(text)]
    return _joined([p[:-1][ok] for p, ok in both]), _joined([p[1:][ok] for p, ok in both])


# --- text models ------------------------------------------------------------------
def train(
    labelled: DataFrame, languages: Sequence[str] = LANGUAGES, per_language: int = PER_LANGUAGE,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> np.ndarray:
    """Log probabilities [language, trigram] from at most `per_language` different
    rows of each language; then two lines of the background: of pairs of bytes, and of
    their second byte given the first."""
    rows = labelled.select(
        F.xxhash64(id_col, text_col).alias("h"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text")
    )
    picked = []
    for lang in languages:
        few = rows.where(F.col("lang") == lang)
        # the hash below which `per_language` rows lie, from narrow columns; then their texts
        last = few.select("h").distinct().orderBy("h").limit(per_language).agg(F.max("h")).first()[0]
        if last is not None:
            picked.append(few.where(F.col("h") <= last).dropDuplicates(["h"]))
    counts = np.zeros((2, len(languages), TABLE), dtype=np.float64)  # of trigrams, of pairs
    if picked:
        sample = reduce(DataFrame.unionByName, picked)

        def count(batches):
            tables: dict[tuple[str, int], np.ndarray] = {}
            for b in slices(batches):
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for kind, places in enumerate((trigrams(text), pairs(text)[0])):
                        t = tables.setdefault((lang, kind), np.zeros(TABLE, dtype=np.int64))
                        t += np.bincount(places, minlength=TABLE)
            for (lang, kind), t in tables.items():
                g = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g), pa.string()), pa.array([kind] * len(g), pa.int32()), pa.array(g), pa.array(t[g])],
                    ["lang", "kind", "g", "n"],
                )

        grams = sample.select("lang", "text").mapInArrow(count, "lang string, kind int, g long, n long")
        place = {lang: i for i, lang in enumerate(languages)}
        # at most 2 * languages * TABLE rows
        for lang, kind, g, n in grams.groupBy("lang", "kind", "g").agg(F.sum("n")).toLocalIterator():
            counts[kind, place[lang], g] = n
    grams, both = counts
    smooth = 0.1
    known = np.log((grams + smooth) / (grams.sum(axis=1, keepdims=True) + smooth * TABLE))
    # each language has the same part in the background, whatever its sample
    total = both.sum(axis=1, keepdims=True)
    shares = (both / np.maximum(total, 1)).sum(axis=0) / max(1, np.count_nonzero(total))
    pair = (shares * both.sum() + smooth) / (both.sum() * (total.sum() > 0) + smooth * TABLE)
    given = pair / np.repeat(pair.reshape(256, 256).sum(axis=1), 256)
    return np.vstack([known, np.log(pair), np.log(given)]).astype(np.float32)


def text_evidence(rows: DataFrame, model: np.ndarray, k: int, text_col: str = "text") -> DataFrame:
    """`rows` without the text, with `grams` (number of trigrams) and `scores`
    (weighted log likelihood of each of the k languages, then "und"). A model of k
    lines has no background but the uniform one."""
    other = [c for c in rows.columns if c != text_col]
    uniform = -math.log(TABLE)

    def score(batches):
        for b in slices(batches):
            grams, scores = [], []
            for text in b.column(len(other)).to_pylist():
                g = trigrams(text or "")
                grams.append(len(g))
                if len(g):
                    mean = [model[i][g].mean(dtype=np.float64) for i in range(k)]
                    other_text = uniform
                    if len(model) > k:
                        one, two = pairs(text)
                        spread = model[k][one].mean(dtype=np.float64) + model[k + 1][two].mean(dtype=np.float64)
                        other_text = max(uniform, spread - UNKNOWN_MARGIN)
                    scores.append([float(m) * min(len(g), TEXT_WEIGHT) for m in (*mean, other_text)])
                else:
                    scores.append([0.0] * (k + 1))
            cols = [b.column(i) for i in range(len(other))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(grams, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], [*other, "grams", "scores"]
            )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in other)
    return rows.select(*other, text_col).mapInArrow(score, f"{kinds}, grams long, scores array<double>")


# --- the other evidence -----------------------------------------------------------
def _counts(rows: DataFrame, keys: list[str], languages: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("declared") == x, F.col("rows")).otherwise(0)).cast("double").alias(f"c{i}")
          for i, x in enumerate(languages)]
    )


def _total(languages: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(len(languages))])


def host_priors(rows: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(host, domain, prior): probabilities of the languages for each host."""
    declared = rows.groupBy("host", "domain", "declared").agg(F.count(F.lit(1)).alias("rows"))
    hosts = staged(_counts(declared, ["host", "domain"], languages), "lang-hosts")
    n, k = _total(languages), len(languages)
    every = hosts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(k)]).first()
    whole = [(every[i] + 1.0) / (sum(every) + k) for i in range(k)]
    domains = hosts.groupBy("domain").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).select(
        F.col("domain").alias("d"),
        F.array(*[(F.col(f"c{i}") + SMOOTH * whole[i]) / (n + SMOOTH) for i in range(k)]).alias("above"),
    )
    none = F.col("domain").isNull()
    above = F.when(none, F.array(*[F.lit(x) for x in whole])).otherwise(F.col("above"))
    both = hosts.join(domains, F.col("domain").eqNullSafe(F.col("d"))).withColumn("above", above)
    prior = F.array(*[(F.col(f"c{i}") + SMOOTH * F.get("above", F.lit(i))) / (n + SMOOTH) for i in range(k)])
    return both.select(
        F.col("host").alias("h"), F.col("domain").alias("d"),
        F.when(F.col("host").isNull(), F.col("above")).otherwise(prior).alias("prior"),
    )


def suffix_likelihoods(rows: DataFrame, languages: Sequence[str]) -> DataFrame:
    """(suffix, seen): how probable the suffix is for each language."""
    declared = rows.where("suffix IS NOT NULL").groupBy("suffix", "declared").agg(F.count(F.lit(1)).alias("rows"))
    by = staged(_counts(declared, ["suffix"], languages), "lang-suffixes")
    k = len(languages)
    every = by.agg(F.count(F.lit(1)).alias("kinds"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(k)]).first()
    return by.select(
        F.col("suffix").alias("s"),
        F.array(*[(F.col(f"c{i}") + 1.0) / (every[f"c{i}"] + every["kinds"]) for i in range(k)]).alias("seen"),
    )


def identify(
    rows: DataFrame,
    model: np.ndarray,
    languages: Sequence[str] = LANGUAGES,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    domain_col: str | None = None,
    suffix_col: str | None = None,
    least: float = 0.5,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, lang, posterior, text_lang, declared, kept,
    and the columns named in `carry`."""
    k = len(languages)
    optional = lambda c, name: (F.col(c) if c else F.lit(None)).cast("string").alias(name)
    declared = F.lower(F.substring_index(F.col(declared_col), "-", 1)) if declared_col else F.lit(None).cast("string")
    taken = rows.select(
        F.col(id_col).alias("__id"), *[F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)],
        F.when(declared.isin(*languages), declared).alias("declared"),
        optional(host_col, "host"), optional(domain_col, "domain"), optional(suffix_col, "suffix"),
        text_or_empty(text_col).alias("text"),
    )
    facts = staged(text_evidence(taken, model, k), "lang-evidence")
    where = facts.select("host", "domain", "suffix", "declared")
    hosts, suffixes = host_priors(where, languages), suffix_likelihoods(where, languages)
    fused = facts.join(
        hosts, F.col("host").eqNullSafe(F.col("h")) & F.col("domain").eqNullSafe(F.col("d")), "left"
    ).join(suffixes, F.col("suffix") == F.col("s"), "left")

    def weight(i: int) -> Column:
        said = F.when(F.col("declared").isNull(), F.lit(0.0)).when(
            F.col("declared") == languages[i], F.lit(math.log(TRUST))
        ).otherwise(F.lit(math.log((1 - TRUST) / max(1, k - 1))))
        seen = F.coalesce(F.log(F.get("seen", F.lit(i))), F.lit(0.0))
        prior = F.log(F.get("prior", F.lit(i)) * (1 - UNKNOWN_PRIOR))
        return F.get("scores", F.lit(i)) + said + seen + prior

    # "und" gets each piece of evidence at its mean over the languages
    unknown = F.get("scores", F.lit(k)) + F.lit(math.log(UNKNOWN_PRIOR)) + F.when(
        F.col("declared").isNull(), F.lit(0.0)
    ).otherwise(F.lit(math.log(1 / k))) + F.coalesce(
        F.log(reduce(lambda a, b: a + b, [F.get("seen", F.lit(i)) for i in range(k)]) / k), F.lit(0.0)
    )
    names = [*languages, UNKNOWN]
    fused = fused.select("*", F.array(*[weight(i) for i in range(k)], unknown).alias("weights"))
    top = F.array_max("weights")
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("weights", top).cast("int"))
    total = F.aggregate("weights", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("weights")))
    text_best = F.slice("scores", 1, k)
    text_lang = F.element_at(
        F.array(*[F.lit(x) for x in languages]), F.array_position(text_best, F.array_max(text_best)).cast("int")
    )
    seen_any = F.col("grams") > 0
    return fused.select(
        F.col("__id").alias(id_col), *[F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry)],
        F.when(seen_any, best).otherwise(F.lit(UNKNOWN)).alias("id_lang"),
        F.when(seen_any, 1.0 / total).otherwise(F.lit(1.0)).alias("posterior"),
        F.when(seen_any, text_lang).alias("text_lang"),
        "declared",
        (seen_any & (best != UNKNOWN) & (1.0 / total >= least)).alias("kept"),
    )


# --- web pages ----------------------------------------------------------------------
def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, host, domain, suffix) of raw pages: the markup's
    lang attribute, the parts of the address, and the text between the tags."""
    html = text_or_empty(html_col)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z0-9#]+;", " ")
    lang = F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select(
        F.col(id_col), text.alias("text"), blank(lang).alias("declared"), blank(host).alias("host"),
        blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        blank(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"),
    )
