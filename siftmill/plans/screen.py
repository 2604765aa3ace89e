"""The two runs of the engine as plans over a whole corpus: extraction and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions import text
from siftmill.operators import layout, report, summary, tests
from siftmill.operators import pages as page_ops
from siftmill.sources import writers

TRIAGE_PAGES = 12
TEST_ORDER = ("page", "table_index", "row_index", "col_index")


@dataclass
class Extraction:
    """features: a row for each paper; tests: kept pairs; dropped: pairs with their reasons; meta: a row for each paper about its extraction; counts: of pairs, tests and reasons over all papers, from the pass that wrote them (empty if nothing was held)."""

    features: DataFrame
    tests: DataFrame
    dropped: DataFrame
    meta: DataFrame
    counts: dict[str, int]


def extract(pages: DataFrame, cells: DataFrame, papers: DataFrame | None = None, max_pages: int = TRIAGE_PAGES, max_pdf_pages: int | None = None, hold: Callable[[DataFrame, str], DataFrame] | None = None) -> Extraction:
    """Pages and cells of a corpus to tests, features and scores.

    Only cells of the ``max_pages`` best pages of each paper are read. papers: further columns of
    each paper (sha256, path, …). Papers with more than ``max_pdf_pages`` pages get a stub row. hold:
    writes a table under a name and rereads it; the pairs are used by several results.
    """
    counts = pages.groupBy("paper_id").agg(F.max("page").alias("pages"))
    skipped = None
    if max_pdf_pages is not None:
        skipped = tests.skipped(counts, max_pdf_pages)
        small = counts.filter(F.col("pages") <= max_pdf_pages).select("paper_id")
        pages, cells = pages.join(small, "paper_id", "left_semi"), cells.join(small, "paper_id", "left_semi")
    scored = page_ops.triage_scores(pages)
    chosen = page_ops.triage_pages(scored, max(1, max_pages))
    raw = tests.pairs(cells.join(chosen.select("paper_id", "page"), ["paper_id", "page"], "left_semi"))
    raw = hold(raw, "pairs") if hold else raw
    modes = tests.paren_modes(raw, pages)
    made, counts_of = tests.reconstruct(raw, modes), {}
    if hold:
        made, counts_of = writers.watched(hold, made, "reconstructed", **tests.counters())
    key = text.cache_key(F.lit(max_pages), F.lit(max_pdf_pages).cast("int"))
    base = (counts if skipped is None else counts.join(small, "paper_id", "left_semi")).withColumn("extractor_version", F.lit(fixed.VERSION)).withColumn("cache_key", key)
    base = base.join(scored.groupBy("paper_id").agg(F.count_if("is_reference").alias("reference_pages")), "paper_id")
    base = base.join(chosen.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"]).alias("candidate_pages")), "paper_id")
    if papers is not None:
        base = base.join(papers, "paper_id", "left")
    features = tests.paper_features(base, pages, made, modes).withColumn("generated_at", text.now())
    meta = features.select("paper_id", "extractor_version", "cache_key", "candidate_pages", "paren_mode", "paren_mode_source", "pairs_raw", F.col("tests").alias("pairs_kept"), "filter_counts", "generated_at")
    meta = meta.withColumn("max_pages_per_paper", F.lit(max_pages)).withColumn("max_pdf_pages", F.lit(max_pdf_pages).cast("int"))
    meta = meta.join(tests.tables_of(made), "paper_id", "left").join(tests.dropped_examples(made), "paper_id", "left")
    if skipped is not None:
        features = features.unionByName(skipped, allowMissingColumns=True)
    return Extraction(features, tests.kept(made), made.filter(F.size("reasons") > 0), meta, counts_of)


def labelled_examples(examples: DataFrame, words: DataFrame, found: DataFrame) -> DataFrame:
    """Examples (paper_id, page, … with boxes) with row_label and col_label from the words of their pages. found: the tests, for the tables' upper edges."""
    lines = layout.lines(words)
    cell = F.concat_ws(":", *(F.col(c).cast("string") for c in TEST_ORDER))
    flagged = examples.withColumn("cell_id", cell).join(summary.table_tops(found), ["paper_id", "page", "table_index"], "left").withColumnRenamed("coef_cell_bbox", "cell_bbox")
    named = flagged.join(layout.row_labels(flagged, lines), ["paper_id", "page", "cell_id"], "left").join(layout.column_labels(flagged, lines), ["paper_id", "page", "cell_id"], "left")
    return named.drop("cell_id", "top").withColumnRenamed("cell_bbox", "coef_cell_bbox")


def reports(pages: DataFrame, found: DataFrame, papers: DataFrame, refs: list[str] | None = None) -> DataFrame:
    """paper_id, score, report of every paper that has tests. papers: paper_id, title, risk_score."""
    ordered = found.withColumn("seq", F.struct(*TEST_ORDER))
    captions = page_ops.captions(pages, "table").unionByName(page_ops.captions(pages, "figure"))
    evidence = report.page_evidence(pages)
    titles = report.page_titles(pages, captions, evidence)
    p, t = summary.examples(ordered, "p"), summary.examples(ordered, "t")
    made = report.report(papers, summary.paper_summary(ordered), summary.near_by_title(p, captions, "p"), summary.near_by_title(t, captions, "t"), p, t, summary.page_counts(ordered), titles)
    return report.with_references(made, refs or [])
