"""Inputs derived from the star-schema tables, by the same SQL in Spark and in the oracle's engine.

``{lineitem}`` and the like stand for tables; Spark puts DataFrames there, the oracle plain names.
Texts are put together from whole numbers, so that both engines make the same ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import stats
from siftmill.session import table

SEQ = ("o", "ln", "pk", "sk", "q", "ep", "sd")

SQL = {
    # one row of lineitem is one test; SEQ orders them and is unique
    "stat_tests": """
SELECT l_suppkey AS paper_id, CAST(1 + (l_orderkey % 12) AS INT) AS page, CAST(l_linenumber - 1 AS INT) AS table_index,
       round((l_discount - 0.05) * 100, 0) AS coef, 0.5 + l_quantity / 20 AS paren,
       abs(round((l_discount - 0.05) * 100, 0) / (0.5 + l_quantity / 20)) AS abs_t,
       CAST(l_partkey % 4 AS INT) AS stars,
       l_orderkey AS o, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, l_extendedprice AS ep, l_shipdate AS sd
FROM {lineitem}
""",
    # one order is one page
    "page_texts": """
SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY o_orderkey) AS INT) AS page,
  CASE WHEN k % 10 = 1 THEN 'Table ' || CAST(1 + k % 4 AS STRING) || '. Determinants of item ' || CAST(k AS STRING) || chr(10)
       WHEN k % 10 = 2 THEN '  Panel B: continued' || chr(10)
       WHEN k % 20 = 3 THEN '  References' || chr(10)
       WHEN k % 10 = 4 THEN 'Figure A' || CAST(k % 3 AS STRING) || ': Event study' || chr(10) || chr(10)
       ELSE 'Section ' || CAST(k AS STRING) || chr(10) END
  || CASE WHEN k % 3 = 0 THEN 'We find p = 0.0' || CAST(40 + k % 20 AS STRING) || ' and p < 0.10*** in the table.' || chr(10) ELSE '' END
  || CASE WHEN k % 4 = 1 THEN 'The p-value = 0.0' || CAST(90 + k % 9 AS STRING) || ' is robust; robustness to each specification is shown.' || chr(10) ELSE '' END
  || CASE WHEN k % 7 = 2 THEN 'Bonferroni and FDR corrections for multiple testing, after a search.' || chr(10) ELSE '' END
  || CASE WHEN k % 5 = 0 THEN 'Standard errors are in parentheses. Observations 1234; Appendix.' || chr(10) ELSE '' END
  || CASE WHEN k % 10 = 1 THEN 'As Table ' || CAST(1 + k % 4 AS STRING) || ' shows, and table ' || CAST(1 + k % 4 AS STRING) || ' again, the effect of figure A' || CAST(k % 3 AS STRING) || ' is small.' || chr(10) ELSE '' END
  || CASE WHEN k % 11 = 3 THEN 'The t-statistics are reported in parentheses (t-stat).' || chr(10) ELSE '' END
  || CASE WHEN k % 6 = 3 THEN 'Author (1999) and other (2004), doi 10.1000/x www.example.org.' || chr(10) ELSE '' END AS text
FROM (SELECT o_orderkey, o_custkey % 40 AS paper_id, o_orderkey % 60 AS k FROM {orders}) t
""",
    # two grid rows and one column for each row of lineitem: a coefficient's cell above one that may hold parentheses
    "grid": """
SELECT paper_id, page, table_index, pair, kind, c, q2 AS q FROM (
  SELECT l_suppkey AS paper_id, CAST(1 + (l_orderkey % 12) AS INT) AS page, CAST(l_linenumber - 1 AS INT) AS table_index,
         row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 12, l_linenumber ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pair,
         CAST(l_partkey % 8 AS INT) AS kind, CAST(1 + l_partkey % 9 AS INT) AS c, CAST(l_quantity AS INT) AS q2
  FROM {lineitem}) t
""",
    "cells": """
SELECT paper_id, page, table_index, CAST(2 * pair AS INT) AS row_index, CAST(0 AS INT) AS col_index,
       CASE kind WHEN 0 THEN '0.' || lpad(CAST(c * 7 AS STRING), 2, '0') || repeat('*', 1 + c % 3)
                 WHEN 1 THEN ' 0.' || lpad(CAST(c * 7 AS STRING), 2, '0') || ' ( 0.' || lpad(CAST(q AS STRING), 2, '0') || ' ) '
                 WHEN 2 THEN CAST(c AS STRING) || ') (' || CAST(c + 1 AS STRING) || ')'
                 WHEN 3 THEN CAST(2000 + c AS STRING)
                 WHEN 4 THEN '12 (3): 45' || CAST(c AS STRING)
                 WHEN 5 THEN 'Controls ' || CAST(c AS STRING)
                 WHEN 6 THEN '- ' || CAST(c AS STRING) || ' . 1 0'
                 ELSE CAST(c AS STRING) || ',234' END AS cell_text
FROM grid UNION ALL
SELECT paper_id, page, table_index, CAST(2 * pair + 1 AS INT) AS row_index, CAST(0 AS INT) AS col_index,
       CASE kind WHEN 0 THEN '(0.' || lpad(CAST(q AS STRING), 2, '0') || ')'
                 WHEN 3 THEN '(0.' || lpad(CAST(q AS STRING), 2, '0') || ')'
                 WHEN 6 THEN '-(0.' || lpad(CAST(q AS STRING), 2, '0') || ')'
                 WHEN 7 THEN '(' || CAST(45 + q AS STRING) || ')'
                 ELSE '' END AS cell_text
FROM grid
""",
    # words of tables: a column for each line number, a line for each order, five lines a table; with gaps, jitter and cells of two words
    "table_words": """
SELECT paper_id, page, word_no, text, x0, y0, x0 + w AS x1, y0 + 9.0 AS y1 FROM (
  SELECT paper_id, page, word_no, text, CAST(40 + 70 * col + shift AS DOUBLE) + 0.5 * (pk % 3) AS x0, CAST(w AS DOUBLE) AS w,
         CAST(60 + 12 * line + 40 * CAST(floor(line / 5) AS INT) + pk % 3 AS DOUBLE) AS y0 FROM (
    SELECT l_suppkey AS paper_id, CAST(1 + (l_orderkey % 12) AS INT) AS page, l_orderkey * 10 + l_linenumber AS word_no, l_partkey AS pk, l_linenumber - 1 AS col,
           CASE WHEN l_partkey % 6 = 0 THEN 10 WHEN l_partkey % 11 = 0 THEN -25 ELSE 0 END AS shift, CASE WHEN l_partkey % 6 = 0 THEN 20 ELSE 30 END AS w,
           CASE WHEN l_partkey % 5 = 0 THEN '(0.' || lpad(CAST(CAST(l_quantity AS INT) AS STRING), 2, '0') || ')' WHEN l_partkey % 13 = 0 THEN ' ' ELSE '0.' || CAST(l_partkey % 90 + 10 AS STRING) || repeat('*', CAST(l_partkey % 4 AS INT)) END AS text,
           dense_rank() OVER (PARTITION BY l_suppkey, l_orderkey % 12 ORDER BY l_orderkey) - 1 AS line
    FROM {lineitem}) a) b
""",
    # a word box for each row of lineitem
    "words": """
SELECT l_suppkey AS paper_id, CAST(1 + (l_orderkey % 12) AS INT) AS page,
       CAST(l_partkey % 5 AS INT) AS block_no, CAST(l_linenumber AS INT) AS line_in_block, l_orderkey * 10 + l_linenumber AS word_no,
       'w' || CAST(l_partkey AS STRING) AS text,
       CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_linenumber * 12 AS DOUBLE) AS y0, CAST(l_partkey % 500 + 30 AS DOUBLE) AS x1, CAST(l_linenumber * 12 + 10 AS DOUBLE) AS y1
FROM {lineitem}
""",
}
NEEDS = {"cells": ("grid",)}
TABLES = ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events")


def plain(sql: str) -> str:
    """SQL for the oracle, with plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def oracle(sql: str, *names: str) -> str:
    """``sql`` with the fixtures that it names before it."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*NEEDS.get(name, ()), name) if n not in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({plain(SQL[n])})" for n in wanted) + (",\n" if sql.lstrip().startswith("+") else "\n") + sql.lstrip().lstrip("+")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{%s}" % t in sql}
    for need in NEEDS.get(name, ()):
        sql = re.sub(rf"\b{need}\b", "{%s}" % need, sql)
        used[need] = fixture(spark, sf_dir, need)
    return spark.sql(sql, **used)


def tests(spark: SparkSession, sf_dir: str, with_p: bool = True) -> DataFrame:
    """stat_tests with the columns that summaries ask for."""
    made = fixture(spark, sf_dir, "stat_tests").withColumn("seq", F.struct(*SEQ)).withColumn("t", F.col("coef") / F.col("paren"))
    return made.withColumn("p_approx_2s", stats.p_of_t(F.col("abs_t"))) if with_p else made


def cells(spark: SparkSession, sf_dir: str, *dealt_by: str) -> DataFrame:
    box = lambda c: F.array(F.lit(100.0), c.cast("double"), F.lit(140.0), (c + 10).cast("double"))
    made = fixture(spark, sf_dir, "cells")
    made = made.repartition(*dealt_by) if dealt_by else made  # before the boxes are made, so that these are not moved
    return made.withColumn("table_bbox", F.array(F.lit(50.0), F.lit(0.0), F.lit(500.0), F.lit(100000.0))).withColumn("cell_bbox", box(F.col("row_index") * 12))
