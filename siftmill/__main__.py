"""python -m siftmill extract|report|expert|light: the engine on extracted tables in Parquet."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill import fixed, session
from siftmill.functions import text
from siftmill.operators import corpus, report, summary
from siftmill.plans import expert, light, screen
from siftmill.sources import ledger, readers, responder, writers


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftmill", description=__doc__)
    p.add_argument("what", choices=("extract", "report", "expert", "light"))
    p.add_argument("--pages", required=True, help="folder of page texts")
    p.add_argument("--cells", help="folder of table cells (extract)")
    p.add_argument("--papers", help="folder of papers with paper_id and sha256; without it the page texts are hashed")
    p.add_argument("--images", help="folder of page images: paper_id, page, image (light)")
    p.add_argument("--tests", help="folder of tests (report, expert)")
    p.add_argument("--features", help="CSV folder of features, for titles and scores (report, expert)")
    p.add_argument("--references", help="Markdown note with a list of APA references (report, expert)")
    p.add_argument("--ids", help="file of paper ids, one a line")
    p.add_argument("--only-regex", help="only papers whose id has a match of this pattern")
    p.add_argument("--limit", type=int, help="at most so many papers, by id")
    p.add_argument("--max-pages", type=int, default=screen.TRIAGE_PAGES)
    p.add_argument("--max-pdf-pages", type=int)
    p.add_argument("--cache", help="folder of results of former runs (extract); default: OUT/cache")
    p.add_argument("--force", action="store_true", help="work everything out, and ask everything, again")
    p.add_argument("--export", action="store_true", help="also tests as JSON lines and reports as Markdown, a folder for each paper")
    p.add_argument("--endpoint", help="chat endpoint of a model (expert); without it no model is asked")
    p.add_argument("--model", default="", help="the model's name at the endpoint (expert)")
    p.add_argument("--key-file", help="file with the endpoint's key (expert)")
    p.add_argument("--ledger", help="folder of all answers of former runs (expert); default: OUT/ledger")
    p.add_argument("--calls", type=int, default=ledger.SLOTS, help="most calls at once (expert)")
    p.add_argument("--pause", type=float, default=ledger.PAUSE, help="seconds between the calls of one of them (expert)")
    p.add_argument("--out", required=True)
    return p


def chosen_pages(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    pages = readers.pages(spark, a.pages)
    if a.ids:
        pages = corpus.in_list(pages, readers.id_list(spark, a.ids))
    if a.only_regex or a.limit is not None:
        kept = corpus.chosen(pages.select("paper_id").distinct(), "paper_id", a.only_regex, a.limit)
        pages = pages.join(kept.select("paper_id"), "paper_id", "left_semi")
    return pages


def extract(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Papers that the cache lacks are worked out and added to it; what the run asks for then comes from the cache."""
    pages, cells, cache = chosen_pages(spark, a), readers.cells(spark, a.cells), a.cache or f"{a.out}/cache"
    hold = writers.holder(f"{a.out}/work")
    own = spark.read.parquet(a.papers).select("paper_id", "sha256") if a.papers else corpus.content_hash(pages)
    key = text.cache_key(F.lit(a.max_pages), F.lit(a.max_pdf_pages).cast("int"))
    papers = pages.select("paper_id").distinct().join(own, "paper_id", "left").withColumn("cache_key", key)
    papers, asked = writers.watched(hold, papers, "papers")
    touched = writers.buckets_of(papers)
    cached = None if a.force else writers.read_cache(spark, f"{cache}/features", touched)
    todo, worked = writers.watched(hold, papers if cached is None else writers.not_cached(papers, cached), "todo")
    some = todo.select("paper_id")
    done = screen.extract(pages.join(some, "paper_id", "left_semi"), cells.join(some, "paper_id", "left_semi"), todo.select("paper_id", "sha256"), a.max_pages, a.max_pdf_pages, hold)
    keys = writers.keyed(todo).select(*writers.CACHE_KEY)
    for name, frame in (("tests", done.tests), ("meta", done.meta), ("features", done.features)):  # features last: they tell that a paper is there
        writers.cache(frame.drop("cache_key", "extractor_version").join(keys, "paper_id"), f"{cache}/{name}", hold, name)
    wanted, out = writers.keyed(papers).select(*writers.CACHE_KEY), {}
    for name, made in (("tests", done.tests), ("meta", done.meta), ("features", done.features)):
        cached = writers.read_cache(spark, f"{cache}/{name}", touched)
        rows = made.join(keys, "paper_id").limit(0) if cached is None else cached.drop("bucket")
        out[name] = rows.join(wanted, list(writers.CACHE_KEY), "left_semi").drop("sha12")
    written = writers.by_paper(out["tests"], f"{a.out}/tests.parquet")
    writers.features_csv([out["features"]], f"{a.out}/features")
    writers.meta_json(out["meta"], f"{a.out}/meta")
    if a.export:
        writers.tests_json(out["tests"], f"{a.out}/tests")
    return {"papers": asked["rows"], "worked_out": worked["rows"], "tests": written["rows"], "pairs": done.counts}


def reported(spark: SparkSession, a: argparse.Namespace) -> dict:
    pages, hold = chosen_pages(spark, a), writers.holder(f"{a.out}/work")
    found = spark.read.parquet(a.tests) if a.tests.rstrip("/").endswith(".parquet") else readers.tests(spark, a.tests)
    found = found.join(pages.select("paper_id").distinct(), "paper_id", "left_semi")
    titles = found.select("paper_id").distinct().withColumn("title", F.col("paper_id"))
    if a.features:
        listed = readers.features(spark, a.features)
        sha256 = F.col("sha256") if "sha256" in listed.columns else F.lit(None).cast("string")
        rows = listed.select("paper_id", sha256.alias("sha256"), F.col("risk_score").cast("double").alias("risk_score"), "line")
        own = spark.read.parquet(a.papers).select("paper_id", "sha256") if a.papers else corpus.content_hash(pages)
        scores = corpus.match_rows(titles.select("paper_id").join(own, "paper_id", "left"), rows)
        titles = titles.join(scores.select("paper_id", "risk_score"), "paper_id", "left")
    else:
        titles = titles.withColumn("risk_score", F.lit(None).cast("double"))
    refs = [r["ref"] for r in report.references(readers.notes(spark, a.references)).orderBy("pos").collect()] if a.references else []
    ordered = found.withColumn("seq", F.struct(*screen.TEST_ORDER))
    if a.what in ("expert", "light"):
        key = readers.notes(spark, a.key_file).first()["text"].strip() if a.key_file else ""
        if a.endpoint:
            who = ledger.Ledger(spark, a.ledger or f"{a.out}/ledger", responder.Adaptive(responder.Endpoint(a.endpoint, a.model, key)), a.calls, pause=a.pause, again=a.force)
        else:
            who = responder.Offline()
        if a.what == "light":
            images = readers.images(spark, a.images) if a.images else spark.createDataFrame([], readers.IMAGES)
            done = light.run(pages, found, titles, images, who, hold, refs)
        else:
            done = expert.run(pages, found, titles, who, hold, refs)
        if a.endpoint:
            writers.objects(ledger.log(who.calls()), f"{a.out}/{a.what}/calls")
        for name in ("inventory", "chunks", "digests", "audits") if a.what == "expert" else ("chosen", "evidence", "meta"):
            writers.objects(getattr(done, name), f"{a.out}/{a.what}/{name}")
        if a.what == "expert":
            writers.objects(done.metrics.drop("facts"), f"{a.out}/diagnostic_metrics")
        made = done.reports
    else:
        made = screen.reports(pages, found, titles, refs)
    written = writers.by_paper(made, f"{a.out}/reports.parquet")
    writers.objects(titles.join(summary.paper_summary(ordered), "paper_id", "left"), f"{a.out}/diagnostic")
    if a.export:
        writers.reports(made.select("paper_id", "report"), f"{a.out}/reports")
    return {"reports": written["rows"]}


def main(argv: list[str] | None = None) -> None:
    a = options().parse_args(argv)
    spark = SparkSession.builder.appName("siftmill").getOrCreate()
    session.ship(spark)
    began = datetime.datetime.now(datetime.timezone.utc)
    made = extract(spark, a) if a.what == "extract" else reported(spark, a)
    asked = {k: v for k, v in vars(a).items() if k != "key_file"}
    writers.run_record(spark, f"{a.out}/run_{a.what}", version=fixed.VERSION, began=began, ended=datetime.datetime.now(datetime.timezone.utc), asked=asked, made=made)


if __name__ == "__main__":
    main()
