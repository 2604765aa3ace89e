"""What the plans must look like for large inputs."""

from siftmill.operators import corpus, summary, tests
from siftmill.plans import catalog, fixtures


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_pair_by_pair_joins(spark, sf):
    papers = spark.createDataFrame([("a", "1")], "paper_id string, sha256 string")
    rows = spark.createDataFrame([("a", "2", 1)], "paper_id string, sha256 string, line int")
    shown = plan(corpus.match_rows(papers, rows))
    assert "NestedLoop" not in shown and "Cartesian" not in shown


def test_counts_need_no_python_and_two_columns_more_than_the_key(spark, sf):
    shown = plan(tests.test_features(fixtures.tests(spark, sf, with_p=False)))
    assert "Python" not in shown and "ArrowEval" not in shown
    assert "l_extendedprice" not in shown.split("ReadSchema")[1].split("\n")[0]


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(summary.page_borderline(fixtures.tests(spark, sf)))


def test_tops_of_tables_take_one_pass_over_the_cells(spark, sf):
    shown = plan(catalog.QUERIES["jn12_pairs_with_table_tops"](spark, sf))
    assert "Join" not in shown and shown.count("FileScan") == 2  # the fixture's upper and lower cells
    assert shown.count("Exchange hashpartitioning(paper_id") == 1


def test_row_pairs_read_their_rows_once(spark, sf):
    shown = plan(catalog.QUERIES["agg25_row_pairs"](spark, sf))
    assert shown.count("FileScan") == 1 and shown.count("Exchange hashpartitioning(paper_id") == 1
    assert shown.split("Window [lead")[0].count("regexp_extract_all(text") == 1
