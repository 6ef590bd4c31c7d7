"""Operator 9: document fingerprints by winnowing, in DataFrame functions only.

A text's units are its words (runs of other characters than space and
U+0009..U+000D), cut into parts of WORD_CHARS characters, and single characters of
scripts that are written without spaces: the same at every length of text, so
that texts of any two lengths can share hashes. Units are hashed, each run of `k`
units gets a rolling hash of their hashes, and of each window of `w` such hashes
the smallest is chosen, the rightmost of equal ones. The fingerprint is the chosen
hashes with their positions. Any run of w + k - 1 units that two texts share
leaves a common hash in both. The window is never more than a quarter of the
hashes, so short texts choose more of them: a smaller window's choice holds that
of any larger one, so the guarantee stands between short and long texts too.

A hash (32 bits) and its position are held in one number, hash * 2**31 +
(2**31 - 1 - position), so that the smallest number of a window is the rightmost
smallest hash.

Cases: null text counts as empty; a text of any length is one row's arrays of
numbers; an empty text has an empty fingerprint, which
is alike (1) to another empty one and unlike (0) to any other; fewer than k
words make one hash, fewer than w hashes one window; equal texts have equal
fingerprints; an empty table gives an empty result; other columns are ignored.
For `next_document`: a null id comes last, rows that repeat an id follow each
other in the order of their texts' hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.llm.common import text_or_empty

K_WORDS = 4
W_HASHES = 12
WORD_CHARS = 8
# Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han and their neighbours.
UNSPACED = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u2E80-\uABFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
UNIT_PATTERN = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,{WORD_CHARS}}}"
LOW32, LAST = 0xFFFFFFFF, 0x7FFFFFFF


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once: a lambda variable is bound to
    it, where a plain reference could be inlined into every element's lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def units(text: Column) -> Column:
    """Parts of words, and single characters of scripts without spaces."""
    return F.regexp_extract_all(text, F.lit(UNIT_PATTERN), F.lit(0))


def winnow(text: Column, k: int = K_WORDS, w: int = W_HASHES) -> Column:
    """The chosen (hash, position) numbers of a text, by position."""

    def grams(hashes: Column) -> Column:
        n = F.greatest(F.size(hashes) - (k - 1), F.least(F.size(hashes), F.lit(1)))
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            at,
            lambda i: F.shiftleft(F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]).bitwiseAND(F.lit(LOW32)), 31)
            .bitwiseOR(F.lit(LAST).cast("long") - i.cast("long")),
        )

    def minima(packed: Column) -> Column:
        here = F.greatest(F.lit(1), F.least(F.lit(w), F.floor(F.size(packed) / 4).cast("int")))
        n = F.size(packed) - (here - 1)
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return _let(here, lambda v: F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(packed, i, v)))))

    return _let(F.transform(units(text), lambda x: F.xxhash64(x)), lambda h: _let(grams(h), minima))


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def positions(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda x: (F.lit(LAST).cast("long") - x.bitwiseAND(F.lit(LAST).cast("long"))).cast("int"))


def as_string(fingerprint: Column) -> Column:
    """Eight hex digits a chosen hash, by position."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(F.shiftright(x, 31)), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _bucket(id_: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are <= id, by two steps of about
    sqrt(bounds) comparisons; null ids come last."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= id_))
    coarse = count(literal([g[0] for g in groups]))
    fine = count(F.get(F.array(*[literal(g) for g in groups]), coarse - 1))
    return F.when(id_.isNull(), F.lit(len(bounds))).when(coarse == 0, F.lit(0)).otherwise(
        (coarse - 1) * step + fine
    )


def next_document(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> DataFrame:
    """(id, text, fp, next_text, next_fp): each row with the text and the
    fingerprint of the next one by id; after the last comes the first.

    The ids are cut at their approximate quantiles into buckets; inside one,
    lead() finds the next row; the last row of a bucket takes the first row of
    the next bucket, one row a bucket. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("id", cuts, 100 * buckets)).first()[0] if cuts else []
    bounds = sorted(set(bounds or []))
    order = [F.col("id").asc_nulls_last(), F.col("order")]
    rows = rows.select("id", "text", _bucket(F.col("id"), bounds).alias("bucket"), F.xxhash64("text").alias("order"))
    first = rows.groupBy("bucket").agg(
        F.min_by("text", F.struct(F.col("id").isNull(), "id", "order")).alias("text")
    )
    # one row a bucket
    along = Window.orderBy("bucket")
    first = first.select("bucket", "text", winnow(F.col("text")).alias("fp"))
    pair = F.struct("text", "fp")
    first = first.select(
        F.col("bucket").alias("b"),
        F.coalesce(F.lead(pair).over(along), F.first(pair).over(along)).alias("after"),
    )
    here = Window.partitionBy("bucket").orderBy(*order)
    led = rows.select("*", winnow(F.col("text")).alias("fp")).select(
        "id", "text", "fp", "bucket", F.lead(F.struct("text", "fp")).over(here).alias("next")
    )
    led = led.join(first, F.col("bucket") == F.col("b"), "left")
    following = F.coalesce(F.col("next"), F.col("after"))
    return led.select("id", "text", "fp", following["text"].alias("next_text"), following["fp"].alias("next_fp"))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last quarter (rounded down) of code points replaced by
    as many of the next text's first."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(next_text, F.lit(1), cut))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and its fingerprint, as numbers."""
    return docs.select(F.col(id_col), winnow(text_or_empty(text_col)).alias("fingerprint"))


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next row."""
    rows = next_document(docs, id_col, text_col)
    rows = rows.select("id", "text", "fp", "next_fp", edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = rows.select(
        "id", F.char_length("text").cast("long").alias("n_chars"), "fp", "next_fp",
        F.sha2("edited", 256).alias("edited_sha256"), winnow(F.col("edited")).alias("edited_fp"),
    )
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(hashes(F.col("fp")), hashes(F.col("edited_fp"))).alias("near_edited"),
        likeness(hashes(F.col("fp")), hashes(F.col("next_fp"))).alias("near_next"),
        positions(F.col("fp")).alias("positions"),
    )
