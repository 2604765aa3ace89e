"""Evidence of pages without a model, and the report of a paper."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill import fixed
from siftmill.functions import stats, text
from siftmill.functions.tokens import strip

BORDERLINE = T.ArrayType(T.StructType([T.StructField("anchor", T.StringType()), T.StructField("why_borderline", T.StringType())]))


def _names(t: Column) -> Column:
    tables, figures = (F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0)))), 1, 6) for p in (fixed.NAMES_TABLE, fixed.NAMES_FIGURE))
    return F.slice(F.concat(tables, figures), 1, 6)


def page_evidence(pages: DataFrame) -> DataFrame:
    """paper_id, page and what a page's text shows: names, conventions, borderline results, signals, notes, confidence."""
    t = F.coalesce("text", F.lit(""))
    signals = []
    for name, evidence, patterns in fixed.SIGNALS:
        anchors = text.snippets(t, patterns, most=3)
        short = F.transform(anchors, lambda a: text.clean_snippet(a, 180))
        signals.append(F.when(F.size(anchors) > 0, F.struct(F.lit(name).alias("signal"), F.lit(evidence).alias("evidence"), short.alias("anchors"))))
    made = pages.select(
        "paper_id", "page", F.lit(None).cast("string").alias("page_role"), _names(t).alias("table_or_figure_names"),
        text.snippets(t, fixed.CONVENTIONS, most=4, around=60).alias("significance_conventions"),
        borderline_results(t).alias("borderline_results"), F.array_compact(F.array(*signals)).alias("signals"), (F.length(strip(t)) == 0).alias("empty"),
    )
    nothing = (F.size("significance_conventions") == 0) & (F.size("borderline_results") == 0) & (F.size("signals") == 0)
    notes = F.array_compact(F.array(F.when(nothing, F.lit(fixed.NOTE_NOTHING)), F.when(F.col("empty"), F.lit(fixed.NOTE_EMPTY))))
    return made.withColumn("notes", notes).drop("empty").withColumn("confidence_0_1", F.lit(0.25))


def borderline_results(t: Column) -> Column:
    """Up to three (anchor, why_borderline) of p-values written near 0.05 or 0.10, in the order of the text.

    The spots are found by splitting at the pattern: what stands before a spot ends the text so far,
    and what stands after it begins the rest.
    """
    values = F.regexp_extract_all(t, F.lit(fixed.BORDERLINE_P), F.lit(1))
    whole = F.regexp_extract_all(t, F.lit(fixed.BORDERLINE_P), F.lit(0))
    between = F.split(t, fixed.BORDERLINE_P)
    # the end of a spot: lengths of what stands before it and of the spots up to it
    def spot(i: Column) -> Column:
        before = F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda a, s: a + F.length(s))
        spots = F.aggregate(F.slice(whole, F.lit(1), i), F.lit(0), lambda a, s: a + F.length(s))
        start = before + spots
        end = start + F.length(F.get(whole, i))
        first = F.greatest(F.lit(0), start - 60)
        p = F.get(values, i).cast("double")
        why = F.when(p.between(*fixed.BINS["p_0_05"][::2]), "p≈0.05").when(p.between(*fixed.BINS["p_0_10"][::2]), "p≈0.10")
        return F.struct(text.clean_snippet(F.substr(t, first + 1, end + 60 - first)).alias("anchor"), why.alias("why_borderline"))

    found = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.size(values) - 1), spot))
    return F.coalesce(F.slice(F.filter(found, lambda x: x["why_borderline"].isNotNull()), 1, 3), F.array().cast(BORDERLINE))


def with_test_examples(evidence: DataFrame, examples: DataFrame) -> DataFrame:
    """Evidence with tests nearest to a threshold added, three in all; the confidence is then 0.35 at least.

    examples: paper_id, page, rank, anchor, why_borderline.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "anchor", "why_borderline"))), lambda x: F.struct(x["anchor"].alias("anchor"), x["why_borderline"].alias("why_borderline")))
    added = evidence.join(examples.groupBy("paper_id", "page").agg(listed.alias("more")), ["paper_id", "page"], "left")
    merged = F.slice(F.concat("borderline_results", F.coalesce("more", F.array().cast(BORDERLINE))), 1, 3)
    confidence = F.when(F.size("more") > 0, F.greatest("confidence_0_1", F.lit(0.35))).otherwise(F.col("confidence_0_1"))
    return added.withColumn("borderline_results", merged).withColumn("confidence_0_1", confidence).drop("more")


def page_titles(pages: DataFrame, captions: DataFrame, evidence: DataFrame) -> DataFrame:
    """paper_id, page, title: the page's table caption, else the first name that its evidence has, else empty."""
    caption = captions.filter("kind = 'table'").select("paper_id", "page", "caption")
    named = evidence.select("paper_id", "page", F.get("table_or_figure_names", F.lit(0)).alias("name"))
    return pages.select("paper_id", "page").join(caption, ["paper_id", "page"], "left").join(named, ["paper_id", "page"], "left").select("paper_id", "page", F.coalesce("caption", "name", F.lit("")).alias("title"))


def fallback_score(summary: DataFrame) -> DataFrame:
    """summary (``paper_summary``) with fallback_score: what a report shows where a paper has no risk score."""
    t_l, t_r, p_l, p_r = (F.col(c) for c in ("t_1_96_left", "t_1_96_right", "p_0_05_left", "p_0_05_right"))
    by_t = F.when(t_l + t_r < 30, 0).when(t_r >= t_l + 6, 14).when(t_r >= t_l + 2, 8).otherwise(0)
    by_p = F.when(p_l + p_r < 10, 0).when(p_l >= p_r + 4, 12).when(p_l >= p_r + 1, 6).otherwise(0)
    curve = F.when(F.col("curve_z") < -1.0, 6).otherwise(0)
    return summary.withColumn("fallback_score", F.greatest(F.lit(0), F.least(F.lit(100), F.lit(fixed.BASE_SCORE) + by_t + by_p + curve)))


def paper_meta(papers: DataFrame) -> DataFrame:
    """paper_id, title, authors, year, venue, doi_or_url. papers: paper_id, title, author, subject, first_page.

    A DOI comes from the subject ("doi: …", else 10.…), else from the first page.
    """
    title, author, subject = (strip(F.coalesce(c, F.lit(""))) for c in ("title", "author", "subject"))
    found = lambda s, p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    doi = F.coalesce(
        found(subject, r"(?iU)\bdoi:\s*([0-9]{2}\.[0-9A-Za-z./_-]+)"),
        found(subject, r"(?iU)\b(10\.[0-9A-Za-z./_-]+)"),
        found(F.coalesce("first_page", F.lit("")), r"(?iU)\bdoi[:\s]*([0-9]{2}\.[0-9A-Za-z./_-]+)"),
    )
    return papers.select(
        "paper_id",
        F.when(F.length(title) > 0, title).otherwise(F.col("paper_id").cast("string")).alias("title"),
        F.when(F.length(author) > 0, F.array(author)).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.nullif(F.regexp_extract(subject, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int").alias("year"),
        F.nullif(strip(F.split_part(subject, F.lit("."), F.lit(1))), F.lit("")).alias("venue"),
        F.concat(F.lit("https://doi.org/"), doi).alias("doi_or_url"),
    )


def references(notes: DataFrame) -> DataFrame:
    """doc_id, pos, ref: the bullets of a Markdown note under its heading of APA references, up to the next heading.

    notes: doc_id, text. A line that is no bullet goes on with the one before; each text once.
    """
    heading = r"(?iU)^##\s+(?:参考文献（APA）|References\b.*APA.*)\s*$"
    lines = notes.select("doc_id", F.posexplode(F.split("text", "\\r\\n|\\n|\\r")).alias("n", "line"))
    so_far = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lines.withColumn("starts", F.min(F.when(F.col("line").rlike(heading), F.col("n"))).over(so_far)).filter("starts IS NOT NULL AND n > starts")
    at = at.withColumn("over", F.max(F.col("line").startswith("## ").cast("int")).over(so_far)).filter("over = 0").filter(F.length(strip(F.col("line"))) > 0)
    bullet = F.regexp_replace("line", r"(?U)^\s+", "").startswith("- ")
    at = at.withColumn("item", F.sum(bullet.cast("int")).over(so_far)).filter("item > 0")
    said = F.when(bullet, strip(F.substring(F.regexp_replace("line", r"(?U)^\s+", ""), 3, 1_000_000))).otherwise(strip(F.col("line")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("n", said.alias("said")))), lambda x: x["said"])
    joined = at.groupBy("doc_id", "item").agg(strip(F.regexp_replace(F.array_join(parts, " "), r"(?U)\s+", " ")).alias("ref")).filter(F.length("ref") > 0)
    once = joined.groupBy("doc_id", "ref").agg(F.min("item").alias("item"))
    return once.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("item")).alias("pos"), "ref")


def with_references(reports: DataFrame, refs: list[str]) -> DataFrame:
    """Reports (…, report) that name every reference; where one is missing, all are added under a heading."""
    if not refs:
        return reports
    body = text.contains_form(F.col("report"))
    lacks = functools.reduce(operator.or_, [~body.contains(text.contains_form(F.lit(r))) for r in refs])
    tail = "\n\n## Sources of the methods\n\n" + "".join(f"- {r}\n" for r in refs)
    full = F.concat(F.regexp_replace("report", r"(?U)\s+$", ""), F.lit(tail))
    return reports.withColumn("report", F.when((F.length("report") > 0) & lacks, full).otherwise(F.col("report")))


def _table(head: str, rule: str, rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"{head}\n{rule}\n"), F.array_join(rows, "\n"), F.lit("\n")))


def _listed(frame: DataFrame, line: Column, name: str) -> DataFrame:
    rows = F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return frame.groupBy("paper_id").agg(rows.alias(name))


def page_order(counts: DataFrame) -> DataFrame:
    """counts (paper_id, page, p_count, t_count) of pages that have any, with their rank in the paper: most first."""
    most_first = Window.partitionBy("paper_id").orderBy(F.desc(F.col("p_count") + F.col("t_count")), "page")
    return counts.filter("p_count + t_count > 0").withColumn("rank", F.row_number().over(most_first))


def report(papers: DataFrame, summary: DataFrame, p_titles: DataFrame, t_titles: DataFrame, p_examples: DataFrame, t_examples: DataFrame, counts: DataFrame, titles: DataFrame) -> DataFrame:
    """paper_id, report (Markdown): bottom line, both windows with their nearest entries, where they lie, and caveats.

    papers: paper_id, title, risk_score (may be null). Sections without counts are left out. Each
    list of a paper is bounded by its cap; the text is built from columns alone.
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    by_title = lambda d, name: _listed(d, F.concat(F.lit("| "), F.col("title"), F.lit(" | "), cell("left"), F.lit(" | "), cell("right"), F.lit(" |")), name)

    def entries(d: DataFrame, name: str) -> DataFrame:
        titled = d.drop("title").join(titles, ["paper_id", "page"], "left")
        bits = [cell("page"), F.coalesce(F.nullif("title", F.lit("")), F.lit("(unknown)")), F.concat(F.lit("`"), cell("coef_raw"), F.lit("`")), F.concat(F.lit("`"), cell("se_cell_text_snippet"), F.lit("`")), F.format_number("at", 3), F.format_number("p_approx_2s", 4), cell("stars")]
        return _listed(titled, F.concat(F.lit("| "), F.concat_ws(" | ", *bits), F.lit(" |")), name)

    where = page_order(counts).join(titles, ["paper_id", "page"], "left")
    where = where.withColumn("has_p", F.max("p_count").over(Window.partitionBy("paper_id")) > 0).filter("has_p")
    spots = _listed(where, F.concat(F.lit("| "), F.concat_ws(" | ", cell("page"), cell("title"), cell("p_count"), cell("t_count")), F.lit(" |")), "spots")
    joined = papers.join(fallback_score(summary), "paper_id")
    for part in (by_title(p_titles, "p_by"), by_title(t_titles, "t_by"), entries(p_examples, "p_rows"), entries(t_examples.filter(F.col("rank") <= fixed.T_SHOWN), "t_rows"), spots):
        joined = joined.join(part, "paper_id", "left")
    score = F.coalesce(F.bround("risk_score").cast("int"), F.col("fallback_score"))
    p_n, t_n = F.col("p_0_05_left") + F.col("p_0_05_right"), F.col("t_1_96_left") + F.col("t_1_96_right")
    count_line = lambda w: F.concat(F.lit("- Counts: left="), cell(f"{w}_left"), F.lit(", right="), cell(f"{w}_right"), F.lit("\n"))
    head = "| page | table | coef | paren | abs t | p | stars |"
    sections = [
        F.concat(F.lit("# Screening report: "), F.col("title"), F.lit("\n\n## Bottom line\n\n- Risk level: "), stats.risk_level(score), F.lit(" (a signal, no proof)\n- Risk score: "), score.cast("string"), F.lit("/100\n")),
        F.when(p_n > 0, F.concat(F.lit("\n## p near 0.05: [0.045, 0.05] against (0.05, 0.055]\n\n"), count_line("p_0_05"))),
        F.when(p_n > 0, _table("\n| table | left | right |", "|---|---:|---:|", F.col("p_by"))),
        F.when(p_n > 0, _table("\n" + head, "|---:|---|---:|---:|---:|---:|---:|", F.col("p_rows"))),
        F.when(t_n > 0, F.concat(F.lit("\n## abs t near 1.96: [1.76, 1.96] against (1.96, 2.16]\n\n"), count_line("t_1_96"))),
        F.when(t_n > 0, _table("\n| table | left | right |", "|---|---:|---:|", F.col("t_by"))),
        F.when(t_n > 0, _table("\n" + head, "|---:|---|---:|---:|---:|---:|---:|", F.col("t_rows"))),
        _table("\n## Where they lie\n\n| page | table | p near 0.05 | abs t near 1.96 |", "|---:|---|---:|---:|", F.col("spots")),
        F.lit("\n## What else could explain it\n\n"),
        F.when((t_n > 0) & (F.col("exact_2") > 0), F.concat(F.lit("- abs t is exactly 2 in "), cell("exact_2"), F.lit(" of "), t_n.cast("string"), F.lit(" entries: few reported decimals can do that.\n"))),
        F.lit("- Stars and table formats make results near a threshold more visible; that implies no intent.\n"),
    ]
    return joined.select("paper_id", score.alias("score"), F.concat_ws("", *sections).alias("report"))
