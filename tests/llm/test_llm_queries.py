"""Registered queries: DuckDB where SQL can express them, and the pipeline
against plain versions of its stages."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from touchline.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_registered():
    found = entry.queries()
    assert {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in found}
    assert found["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, name):
    r = compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], duck(SF))
    assert r["columns_match"] and r["rows"][0] == r["rows"][1] and r["hash_match"]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs_over_the_whole_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    tables = {"doc_id": "documents", "page_id": "pages", "conv_id": "conversations"}
    key = next((c for c in tables if c in out.columns), None)
    if key:
        table = tables[key]
        want = spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct()
        assert out.select(key).distinct().exceptAll(want).count() == 0
        assert out.select(key).distinct().count() == want.count()
    else:
        assert out.count() > 0


def stages(spark, docs, upto=None):
    for name, stage in corpus_pipeline.STAGES[:upto]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        yield name, docs


def test_pipeline_stages_match_plain_versions(spark):
    from test_llm_operators import check_pieces, lines_without

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    for name, out in stages(spark, docs):
        rows = [tuple(r) for r in out.collect()]
        if name == "language_id":
            assert Counter(rows) == Counter(before)  # all of them are clean
        elif name == "line_dedup":
            pairs = [(r[0], r[1]) for r in before]
            want = Counter((i, t) for (i, t, n) in lines_without(pairs).elements() if not n or t.strip(" \t\n\v\f\r"))
            assert Counter((r[0], r[1]) for r in rows) == want
            assert all(r[4] == len(r[1]) for r in rows)
        elif name == "near_duplicates":
            groups = brute.jaccard_components([(r[0], r[1]) for r in before], 5, 80, 100)
            stay = {i for i, _, c in groups if i == c}
            assert Counter(rows) == Counter(r for r in before if r[0] in stay)
        elif name == "mixing":
            kinds = set(rows)
            assert kinds <= set(before) and max(Counter(rows).values()) <= 2
        else:
            times = Counter((r[0], r[1]) for r in before)
            check_pieces(out.collect(), list(times.elements()))
        if name != "packing":
            assert out.columns == docs.columns
        before = rows


def test_pipeline_on_awkward_rows(spark):
    for rows in (brute.awkward(), []):
        docs = brute.table(spark, rows)
        kept = []
        for name, out in stages(spark, docs):
            kept.append(out.count())
            if name != "packing":
                assert out.columns == docs.columns
                if rows and name == "near_duplicates":
                    assert out.where(F.col("doc_id") == 2).count() <= 1
        assert len(kept) == 5 and (rows or not any(kept))
