"""Operator 1: exact deduplication by progressive refinement.

Texts are equal when they are identical after each run of white space
(space, U+0009..U+000D) is replaced by one space. The refinement runs in three
levels, each over what the one before left undecided:

1. byte length of the normalised text: a length that occurs once is decided;
2. hash of a short prefix within the lengths that are left;
3. SHA-256 of the full text within the (length, prefix) groups that are left.

Levels 1 and 2 work on a staged table of two numbers a row. The group tables
come from map-side combined counts and are joined back on their keys, so a
group of copies that holds a third of all rows is a partial aggregate and a
join partition that the adaptive planner splits; no window gathers a group.

Cases: null text counts as empty; empty texts are equal to each other; rows
that repeat (also their id) are counted each, and rows that share the smallest
id all stay; a null id never is the smallest unless all ids of the group are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from touchline.llm.common import SPACE_CLASS, staged, text_or_empty


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE_CLASS + "+", " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest: str = "survivors",
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    digest="survivors": only rows left after level 2 are hashed, and their
    text travels to the level-3 join (text_sha256 is null for the others).
    digest="all": the caller wants every row's SHA-256 anyway, so it is taken
    in the scan and 32 bytes a row travel in place of the text. The
    refinement, hence the groups, are the same.
    """
    if digest not in ("survivors", "all"):
        raise ValueError("digest must be 'survivors' or 'all'")
    text = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    keyed = text.select(
        "id", "t", F.octet_length("t").alias("n"),
        F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix"),
    )
    keys = staged(keyed.select("n", "prefix"), "dedup-keys")
    lengths = keys.groupBy("n").count().where("count > 1").select("n")
    prefixes = (
        keys.join(lengths, "n", "left_semi").groupBy("n", "prefix").count().where("count > 1")
        .select("n", "prefix", F.lit(True).alias("open"))
    )
    sha = F.unhex(F.sha2("t", 256))
    if digest == "all":
        marked = keyed.select("id", "n", "prefix", sha.alias("sha")).join(prefixes, ["n", "prefix"], "left")
        marked = marked.select("id", "n", "prefix", "sha", F.when(F.col("open"), F.col("sha")).alias("full"))
    else:
        marked = keyed.join(prefixes, ["n", "prefix"], "left")
        marked = marked.select("id", "n", "prefix", F.when(F.col("open"), sha).alias("full"))
        marked = marked.withColumn("sha", F.col("full"))
    marked = staged(marked, "dedup-marked")
    groups = (
        marked.where("full IS NOT NULL").groupBy("n", "prefix", "full")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first")).where("rows > 1")
    )
    joined = marked.join(groups, ["n", "prefix", "full"], "left")
    keep = F.when(F.col("rows").isNotNull(), F.col("first")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce(F.col("rows"), F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
