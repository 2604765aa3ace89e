"""Queries that must not leave out a part of their input."""

import pytest
from pyspark.sql import functions as F

from siftmill.plans import catalog


@pytest.mark.parametrize("name", ["str1_normal_cells", "str3_numeric_tokens", "str4_paren_tokens", "str6_first_paren"])
def test_rows_of_both_kinds_are_read(name, spark, sf):
    parities = {r[0] for r in catalog.QUERIES[name](spark, sf).selectExpr("row_index % 2").distinct().collect()}
    assert parities == {0, 1}


@pytest.mark.parametrize("name", ["lay2_row_labels", "lay3_column_labels"])
def test_cells_of_all_lines_are_labelled(name, spark):
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.01").selectExpr("cell_id % 100000 DIV 10000 AS line").distinct().collect()
    assert min(r["line"] for r in got) < 4


def test_evidence_reads_the_tests_of_all_papers(spark, sf, monkeypatch):
    seen = []
    given = catalog.summary.page_borderline
    monkeypatch.setattr(catalog.summary, "page_borderline", lambda t: seen.append(t.agg({"paper_id": "max"}).first()[0]) or given(t))
    monkeypatch.setattr(catalog.fx, "tests", lambda s, d, given=catalog.fx.tests: given(s, d).withColumn("paper_id", F.col("paper_id") + 40))
    catalog.QUERIES["jn13_evidence_with_tests"](spark, sf)
    assert seen[0] is not None and seen[0] >= 40
