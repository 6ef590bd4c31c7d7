"""Operator 2: token counts from an exact length histogram.

Every text is encoded once; the corpus is reduced to (encoded length, number
of documents) by a map-side combined count. Everything asked afterwards comes
from suffix sums over that histogram, which has at most as many rows as there
are distinct lengths (at most about the square root of twice the token count):
for each context limit the documents that are longer, the tokens kept when
texts are truncated there, the windows needed when they are cut, and quantiles.

The suffix sums are two-level: blocks of lengths are summed, the block totals
are summed, and each block is scanned on its own, so no task holds the whole
histogram.

Cases: null and empty texts have length 0 and are counted; repeated rows count
each; an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from touchline.llm.common import staged
from touchline.llm.tokens import token_lengths

BLOCK = 4096  # lengths a block


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, docs) for every encoded length that occurs."""
    return token_lengths(docs, tokenizer_path, text_col).groupBy("n_tokens").agg(
        F.count(F.lit(1)).alias("docs")
    )


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L: docs and tokens of length L, those of length >= L
    (docs_from, tokens_from) and of length <= L (docs_upto), all documents and
    tokens, and `truncated`: the tokens left when every text is cut after L."""
    hist = staged(
        histogram.select(
            "n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"),
            F.floor(F.col("n_tokens") / BLOCK).alias("block"),
        ),
        "lengths",
    )
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    # one row a block: lengths over BLOCK
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("docs_all"),
        F.sum("t").over(every).alias("tokens_all"),
    )
    here = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    out = hist.join(blocks, "block").select(
        "n_tokens", "docs", "tokens",
        (F.sum("docs").over(here) + F.col("docs_after")).alias("docs_from"),
        (F.sum("tokens").over(here) + F.col("tokens_after")).alias("tokens_from"),
        "docs_all", "tokens_all",
    )
    return out.select(
        "n_tokens", "docs", "tokens", "docs_from", "tokens_from",
        (F.col("docs_all") - F.col("docs_from") + F.col("docs")).alias("docs_upto"),
        "docs_all", "tokens_all",
        (F.col("tokens_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row: what a context of `limit` tokens keeps; any limit, also one
    that is no length of a document."""
    longer = F.col("n_tokens") > limit
    return sums.agg(
        F.coalesce(F.sum(F.when(longer, F.col("docs"))), F.lit(0)).alias("docs_longer"),
        (
            F.coalesce(F.sum(F.when(~longer, F.col("tokens"))), F.lit(0))
            + F.coalesce(F.sum(F.when(longer, F.col("docs"))), F.lit(0)) * F.lit(limit)
        ).alias("truncated"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least q of the documents do not exceed."""
    return sums.where(F.col("docs_upto") >= F.col("docs_all") * q).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    return suffix_sums(length_histogram(docs, tokenizer_path, text_col))
