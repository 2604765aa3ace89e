"""The light workflow over a whole corpus: a model chooses pages, looks at their images and writes reports.

Each step has the answer that the text alone gives beside it, and takes that row by row where the
model gives none that fits: pages by their scores, evidence by patterns, a paper's data by its file's
fields, a report from the tests. Images are a table; a page without one is asked about by its text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.operators import pages as page_ops
from siftmill.operators import report, summary
from siftmill.plans import screen
from siftmill.plans.expert import SYSTEM_JSON, SYSTEM_TEXT
from siftmill.plans.screen import TEST_ORDER
from siftmill.sources.ledger import Ledger
from siftmill.sources.responder import Direct, Hold, Responder, as_it_is

MOST_PAGES, PAGE_CHARS = 8, 2500
SIGNALS, BORDERLINE = 4, 3
CHOOSE = 'TASK choose pages. Of the listed pages choose at most %d to be looked at as images: results in tables, robustness or an appendix, no lists of references. Give {"selected_pages": [{"page": number, "role": text, "reason": text}]}.\n'
LOOK = 'TASK look at a page. Give {"page_role": text, "table_or_figure_names": [text], "significance_conventions": [text], "borderline_results": [{"anchor": text, "why_borderline": text}], "signals": [{"signal": text, "evidence": text, "anchors": [text]}], "notes": [text], "confidence_0_1": number}, at most four signals and three borderline results. Trust the image more than the text.\n'
LOOK_SHORT = 'TASK look at a page again, in short. Your last answer was no JSON object. Give only {"signals": [{"signal": text, "evidence": text, "anchors": [text]}], "confidence_0_1": number}.\n'
META = 'TASK read the first page. Give {"title": text, "authors": [text], "year": number, "venue": text, "doi_or_url": text}; null for what is not there.\n'
WRITE = "TASK write a screening report in Markdown from what follows: a line 'Risk score: n/100' and a line 'Risk level: ...', then cards of evidence, each with its page and anchors, then what limits it. Cover multiple testing, results near thresholds, search for a specification, the p-curve and publication bias. A signal is no proof.\n"
SEEN = "page_role string, table_or_figure_names array<string>, significance_conventions array<string>, borderline_results array<struct<anchor:string,why_borderline:string>>, signals array<struct<signal:string,evidence:string,anchors:array<string>>>, notes array<string>, confidence_0_1 double"
READ = "title string, authors array<string>, year int, venue string, doi_or_url string"


@dataclass
class Light:
    """pages chosen, evidence of each, data of each paper, reports; ``source`` tells who gave a row: model or text."""

    chosen: DataFrame
    evidence: DataFrame
    meta: DataFrame
    reports: DataFrame


def _or_text(answers: DataFrame, text: DataFrame, key: list[str]) -> DataFrame:
    """The model's rows, and those of the text for every key that it has none for."""
    rest = text.join(answers.select(*key).distinct(), key, "left_anti").withColumn("source", F.lit("text"))
    return answers.withColumn("source", F.lit("model")).unionByName(rest)


def _prompt(task: str, *columns: "str | Column") -> Column:
    return F.concat(F.lit(task), F.to_json(F.struct(*columns)))


def choose(pages: DataFrame, papers: DataFrame, who: Direct | Ledger, most: int = MOST_PAGES) -> DataFrame:
    """paper_id, page, role, rank, source: the pages that the model chooses of those there are, each once; else those of the best scores."""
    scored = page_ops.report_scores(pages)
    row = F.struct("page", F.round("score", 3).alias("score"), "text_len", "digit_count", "star_count", "p_mentions", "table_mentions", "robust_mentions", F.col("text_head").alias("head"))
    listed = scored.groupBy("paper_id").agg(F.sort_array(F.collect_list(row)).alias("pages"))
    asked = papers.select("paper_id", "title").join(listed, "paper_id").select("paper_id", _prompt(CHOOSE % most, "title", "pages").alias("prompt"))
    said = who.objects(asked, SYSTEM_JSON, "pages").filter("object IS NOT NULL")
    picks = said.select("paper_id", F.posexplode(F.from_json("object", "selected_pages array<struct<page:int,role:string>>")["selected_pages"]).alias("k", "p")).select("paper_id", "k", "p.page", "p.role")
    known = picks.join(pages.select("paper_id", "page").distinct(), ["paper_id", "page"]).groupBy("paper_id", "page").agg(F.min("k").alias("k"), F.min_by("role", "k").alias("role"))
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy("k"))).filter(F.col("rank") <= most).select("paper_id", "page", "role", "rank")
    return _or_text(ranked, page_ops.report_pages(scored, most).select("paper_id", "page", "role", "rank"), ["paper_id"])


def look(pages: DataFrame, images: DataFrame, titles: DataFrame, who: Direct | Ledger) -> DataFrame:
    """The columns of ``report.page_evidence`` and source for ``pages``: by their images, asked again in short where the answer is no object, else by their text."""
    packets = pages.join(titles, "paper_id", "left").join(images, ["paper_id", "page"], "left")
    ask = lambda task: packets.select("paper_id", "page", _prompt(task, "title", "page", F.substring("text", 1, PAGE_CHARS).alias("text")).alias("prompt"), "image")
    key = ["paper_id", "page"]
    first = who.objects(ask(LOOK), SYSTEM_JSON, "look", 1).select(*key, "object")
    lacking = first.filter("object IS NULL").select(*key)
    again = who.objects(ask(LOOK_SHORT).join(lacking, key, "left_semi"), SYSTEM_JSON, "look_again", 1).select(*key, "object")
    said = first.unionByName(again).filter("object IS NOT NULL").select(*key, F.from_json("object", SEEN).alias("s"))
    text = report.page_evidence(pages.select("paper_id", "page", "text"))
    kinds = dict(text.dtypes)
    most = {"signals": SIGNALS, "borderline_results": BORDERLINE}

    def column(name: str) -> Column:
        own = F.col(f"s.{name}").cast(kinds[name])
        if kinds[name].startswith("array"):
            own = F.coalesce(own, F.array().cast(kinds[name]))
            own = F.slice(own, 1, most[name]) if name in most else own
        return own.alias(name)

    return _or_text(said.select(*key, *(column(c) for c in text.columns if c not in key)), text, key)


def read_first_pages(pages: DataFrame, images: DataFrame, papers: DataFrame, who: Direct | Ledger) -> DataFrame:
    """paper_id, title, authors, year, venue, doi_or_url, source: from the image of a paper's first page, else from the fields of its file."""
    first = papers.join(pages.filter("page = 1").select("paper_id", F.col("text").alias("first_page")), "paper_id", "left")
    shown = images.filter("page = 1").select("paper_id", "image")
    asked = first.join(shown, "paper_id").select("paper_id", _prompt(META, F.substring("first_page", 1, PAGE_CHARS).alias("text")).alias("prompt"), "image")
    read = who.objects(asked, SYSTEM_JSON, "first_page").filter("object IS NOT NULL").select("paper_id", F.from_json("object", READ).alias("m")).select("paper_id", "m.*").filter(F.length(F.trim("title")) > 0)
    fields = {c: F.col(c) if c in papers.columns else F.lit(None).cast("string") for c in ("author", "subject")}
    text = report.paper_meta(first.withColumns(fields))
    return _or_text(read.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))), text, ["paper_id"])


def fits(answer: Column) -> Column:
    """Whether a report has a score and a level."""
    return F.coalesce(answer.rlike(r"(?i)risk score\W+\d{1,3}") & answer.rlike(r"(?i)risk level"), F.lit(False))


def run(pages: DataFrame, found: DataFrame, papers: DataFrame, images: DataFrame, who: "Responder | Ledger", hold: Hold = as_it_is, refs: list[str] | None = None, most: int = MOST_PAGES) -> Light:
    """All steps. pages: paper_id, page, text; found: the tests; papers: paper_id, title, risk_score (author, subject); images: paper_id, page, image."""
    who = who if isinstance(who, Ledger) else Direct(who, hold)
    titles, key = papers.select("paper_id", "title"), ["paper_id", "page"]
    images = images.groupBy(*key).agg(F.min("image").alias("image"))
    chosen = hold(choose(pages, papers, who, most), "chosen")
    evidence = hold(look(pages.join(chosen.select(*key), key, "left_semi"), images, titles, who), "evidence")
    meta = hold(read_first_pages(pages, images, papers, who), "meta")
    ordered = found.withColumn("seq", F.struct(*TEST_ORDER))
    counted = summary.paper_summary(ordered)
    listed = lambda rows, name: rows.drop("source").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.to_json(F.struct(*(c for c in rows.columns if c not in ("paper_id", "source")))))).alias(name))
    about = meta.drop("source").select("paper_id", F.struct("title", "authors", "year", "venue", "doi_or_url").alias("paper"))
    heuristics = counted.select("paper_id", F.to_json(F.struct(*(c for c in counted.columns if c != "paper_id"))).alias("heuristics"))
    known = papers.select("paper_id", "risk_score").join(about, "paper_id", "left").join(heuristics, "paper_id", "left").join(listed(chosen, "chosen"), "paper_id", "left").join(listed(evidence, "evidence"), "paper_id", "left")
    written = hold(who.ask(known.select("paper_id", _prompt(WRITE, "paper", "risk_score", "heuristics", "chosen", "evidence").alias("prompt")), SYSTEM_TEXT, "light_report"), "light_reports")
    own = written.filter(fits(F.col("answer"))).select("paper_id", F.col("answer").alias("report"))
    both = _or_text(own, screen.reports(pages, found, papers).select("paper_id", "report"), ["paper_id"])
    ended = report.with_references(both.select("paper_id", "report"), refs or [])
    return Light(chosen, evidence, meta, hold(ended.join(both.select("paper_id", "source"), "paper_id"), "reports"))
