"""The expert workflow over a whole corpus: a model reads pages, audits artifacts and writes reports.

Each step is one DataFrame of prompts, asked on the executors, and its answers are held (written and
reread) before the next step, so that no model is asked twice; asked through a ledger, they are kept
for later runs too. Prompts hold nothing that differs between two runs over the same papers. What a
model leaves out or gets wrong is asked for again; what it never gives is made from the tests alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions import stats, text
from siftmill.operators import artifacts, report, summary
from siftmill.operators import pages as page_ops
from siftmill.plans import screen
from siftmill.plans.screen import TEST_ORDER
from siftmill.sources.ledger import Ledger
from siftmill.sources.responder import Direct, Hold, Responder, as_it_is, page_chunks

MOST_ARTIFACTS, PAGES_OF_ARTIFACT, CHUNK_PAGES, PAGE_CHARS, BATCH, REPAIRS = 40, 4, 8, 3200, 4, 2

SYSTEM_JSON = "You review empirical papers for signs of selective reporting. Use only what you are given. Answer with one JSON object and nothing else."
SYSTEM_TEXT = "You review empirical papers for signs of selective reporting. Use only what you are given. Answer in Markdown. A signal is no proof of intent."
GUIDE = (
    "How to read the counts: p_005_left and p_005_right are results just below and just above p = 0.05, t_196_left and t_196_right those just below and above |t| = 1.96; "
    "more on the significant side is a signal. pcurve_low_half and pcurve_high_half split the significant results at p = 0.025; true effects give more of the low half. "
    "A table without tests gives no numeric evidence; say so."
)
CHUNK = 'TASK summarise pages. Give {"key_points": [text], "claims": [{"claim": text, "pages": [number]}], "notes": [{"type": text, "pages": [number], "evidence": text}]}.\n'
DIGEST = 'TASK digest the paper. Give {"summary": text, "question": text, "data": text, "strategy": text, "claims": [text], "conventions": [text], "choices": [text], "priorities": [text]}.\n'
AUDIT = 'TASK audit one table or figure. Give {"risk_score": number from 0 to 100, "risk_level": "Low" or "Moderate" or "High", "concerns": [text], "evidence": [{"signal": text, "strength": text, "pages": [number]}], "alternatives": [text], "checks": [text]}.\n'
METRICS = 'TASK metrics of the paper. Give {"paper": {"title": text, "overall_risk_score_0_100": number, "overall_risk_level": text, "top_concerns": [text], "key_artifacts": [id]}, "artifacts": [{"kind": text, "id": id, "pages": [number], "risk_score_0_100": number, "risk_level": text, "has_numeric_evidence": boolean, "evidence_counts": object, "signals": [text]}], "generated_at": text}, with every artifact of the inventory once and no other key at the top.\n'
HEAD_PARTS = ("## Summary", "## The paper", "## What was checked", "## Tables and figures")
TAIL_PARTS = ("## Assessment", "## Limits")
HEADER = "TASK write the head of the report: a title line, then the headings " + ", ".join(HEAD_PARTS) + " in this order, the last one without text. No headings of the third level.\n"
SECTIONS = "TASK write one section for each of these tables and figures, each under a heading '### id: caption' with the id as given.\n"
TAIL = "TASK write the end of the report under the headings " + " and ".join(TAIL_PARTS) + ".\n"
AUDITED = "risk_score double, risk_level string, concerns array<string>"


@dataclass
class Expert:
    """inventory, summaries of page chunks, digests, audits, metrics (JSON of each paper, with its source) and reports of all papers."""

    inventory: DataFrame
    chunks: DataFrame
    digests: DataFrame
    audits: DataFrame
    metrics: DataFrame
    reports: DataFrame


def _prompt(task: str, *columns: "str | Column") -> Column:
    return F.concat(F.lit(task + GUIDE + "\n"), F.to_json(F.struct(*columns)))


Asker = Direct | Ledger


def _texts(packets: DataFrame, who: Asker, name: str, hold: Hold, good: Column) -> DataFrame:
    """packets with their answer; one that is not ``good`` (a test of ``answer``) is asked for again, REPAIRS times."""
    done = hold(who.ask(packets, SYSTEM_TEXT, name), f"{name}_0")
    for k in range(REPAIRS):
        bad = done.filter(~F.coalesce(good, F.lit(False)) & F.col("error").isNull())
        if bad.isEmpty():
            break
        again = bad.select(*(F.concat(F.lit("Your last answer lacked a required heading or had one too many. Write it again.\n"), "prompt").alias(c) if c == "prompt" else F.col(c) for c in packets.columns))
        kept = done.filter(F.coalesce(good, F.lit(False)) | F.col("error").isNotNull())
        done = hold(kept.unionByName(who.ask(again, SYSTEM_TEXT, f"{name}_again_{k}")), f"{name}_{k + 1}")
    return done


def _has(parts: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & F.col("answer").contains(part)
    return out


def _metrics(papers: DataFrame, items: DataFrame, audits: DataFrame, counted: DataFrame, digests: DataFrame, who: Asker, hold: Hold) -> DataFrame:
    """paper_id, object, facts (the object without its time), source: the model's metrics where they fit the inventory, after repairs if need be, else those made from the audits."""
    place = F.struct("place", "kind", "id", "pages")
    listed = items.groupBy("paper_id").agg(F.sort_array(F.collect_list(place)).alias("inventory"))
    said = audits.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "level", "concerns"))).alias("audits"))
    packets = papers.join(listed, "paper_id").join(said, "paper_id", "left").join(digests, "paper_id", "left").select("paper_id", _prompt(METRICS, "title", "digest", "inventory", "audits").alias("prompt"))
    packets = hold(packets, "metrics_prompts")
    good, todo = None, packets
    for k in range(REPAIRS + 1):
        answered = who.objects(todo, SYSTEM_JSON, f"metrics_{k}", 1).filter("object IS NOT NULL").select("paper_id", "object")
        judged = hold(answered.join(artifacts.validate(answered, items), "paper_id"), f"metrics_judged_{k}")
        now = judged.filter("ok").select("paper_id", "object", F.col("object").alias("facts"))
        good = now if good is None else good.unionByName(now)
        why = judged.filter("NOT ok").select("paper_id", "why")
        todo = packets.join(why, "paper_id").select("paper_id", F.concat(F.lit("Your last answer did not fit: "), "why", F.lit(". Give the whole object again.\n"), "prompt").alias("prompt"))
    own = artifacts.fallback_metrics(items, audits, counted)
    entry = F.struct("place", "kind", "id", "pages", "risk_score_0_100", "risk_level", "has_numeric_evidence", "evidence_counts", "signals")
    entries = own.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x.dropFields("place")).alias("artifacts"))
    paper = F.struct("title", "overall_risk_score_0_100", "overall_risk_level", "top_concerns", "key_artifacts").alias("paper")
    made = artifacts.fallback_paper(own).join(papers, "paper_id").join(entries, "paper_id").select("paper_id", *(F.to_json(F.struct(paper, "artifacts", *time)).alias(c) for c, time in (("object", [text.now().alias("generated_at")]), ("facts", []))))
    rest = made.join(good.select("paper_id"), "paper_id", "left_anti").withColumn("source", F.lit("audits"))
    return hold(good.withColumn("source", F.lit("model")).unionByName(rest), "metrics")


def _reports(papers: DataFrame, items: DataFrame, audits: DataFrame, metrics: DataFrame, digests: DataFrame, who: Asker, hold: Hold) -> DataFrame:
    """paper_id, report of the papers for which the model wrote all parts."""
    known = papers.join(metrics.select("paper_id", F.col("facts").alias("metrics")), "paper_id").join(digests, "paper_id", "left")
    heads = _texts(known.select("paper_id", _prompt(HEADER, "title", "digest", "metrics").alias("prompt")), who, "heads", hold, _has(HEAD_PARTS) & ~F.col("answer").contains("### "))
    ends = _texts(known.select("paper_id", _prompt(TAIL, "title", "metrics").alias("prompt")), who, "ends", hold, _has(TAIL_PARTS))
    shown = items.select("paper_id", "place", "kind", "id", "caption", "pages", "table_metrics").join(audits.select("paper_id", "id", "kind", F.col("object").alias("audit")), ["paper_id", "kind", "id"], "left")
    one = F.struct("place", "kind", "id", "caption", "pages", "table_metrics", "audit")
    batches = shown.withColumn("batch", ((F.col("place") - 1) / BATCH).cast("int")).groupBy("paper_id", "batch").agg(F.sort_array(F.collect_list(one)).alias("artifacts"))
    sections = hold(who.ask(batches.select("paper_id", "batch", _prompt(SECTIONS, "artifacts").alias("prompt")), SYSTEM_TEXT, "sections"), "sections_asked")
    in_order = lambda df: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("batch", "answer"))), lambda x: x["answer"]), "\n\n")
    body = sections.filter("answer IS NOT NULL").groupBy("paper_id").agg(in_order(sections).alias("body"))
    lacking = shown.join(body, "paper_id").filter(~F.col("body").contains(F.concat(F.lit("### "), "id", F.lit(":"))))
    singles = lacking.select("paper_id", F.col("place").alias("batch"), _prompt(SECTIONS, F.array(one).alias("artifacts")).alias("prompt"))
    added = hold(who.ask(singles, SYSTEM_TEXT, "sections_added"), "sections_added_asked").filter("answer IS NOT NULL").groupBy("paper_id").agg(in_order(singles).alias("added"))
    parts = heads.filter("answer IS NOT NULL").select("paper_id", F.col("answer").alias("head")).join(body, "paper_id").join(added, "paper_id", "left").join(ends.filter("answer IS NOT NULL").select("paper_id", F.col("answer").alias("tail")), "paper_id")
    return parts.select("paper_id", F.concat_ws("\n\n", *(F.trim(c) for c in ("head", "body", "added", "tail"))).alias("report"))


def run(pages: DataFrame, found: DataFrame, papers: DataFrame, who: "Responder | Ledger", hold: Hold = as_it_is, refs: list[str] | None = None) -> Expert:
    """All steps. pages: paper_id, page, text; found: the tests; papers: paper_id, title, risk_score; who: a responder, or a ledger that asks one; hold: writes a table under a name and rereads it."""
    who = who if isinstance(who, Ledger) else Direct(who, hold)
    ordered = found.withColumn("seq", F.struct(*TEST_ORDER))
    captions = page_ops.captions(pages, "table").unionByName(page_ops.captions(pages, "figure"))
    counted = hold(summary.table_metrics(ordered, captions), "table_metrics")
    items = hold(artifacts.enriched(artifacts.inventory(captions, MOST_ARTIFACTS), pages, counted), "inventory")

    chunked = page_chunks(pages, CHUNK_PAGES, PAGE_CHARS).select("paper_id", "chunk", F.concat(F.lit(CHUNK + GUIDE + "\n"), "prompt").alias("prompt"))
    chunks = who.objects(chunked, SYSTEM_JSON, "summaries").filter("object IS NOT NULL").select("paper_id", "chunk", "object")
    chunks = hold(chunks, "chunks")
    summaries = chunks.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "object"))), lambda x: x["object"]).alias("chunks"))
    listed = items.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "id", "caption", "pages"))).alias("inventory"))
    asked = papers.join(summaries, "paper_id", "left").join(listed, "paper_id", "left").select("paper_id", _prompt(DIGEST, "title", "chunks", "inventory").alias("prompt"))
    digests = hold(who.objects(asked, SYSTEM_JSON, "digest").select("paper_id", F.col("object").alias("digest")), "digests")

    packet = ("kind", "id", "caption", "pages", "mentions", "page_text_excerpts", "table_metrics", "digest")
    each = items.join(digests, "paper_id", "left").select("paper_id", "kind", "id", "place", _prompt(AUDIT, *packet).alias("prompt"))
    judged = who.objects(each, SYSTEM_JSON, "audit").filter("object IS NOT NULL")
    said = F.from_json("object", AUDITED)
    audits = hold(judged.select("paper_id", "kind", "id", "place", "object", said["risk_score"].alias("score"), F.coalesce(said["risk_level"], stats.risk_level(said["risk_score"], fixed.EXPERT_LEVELS)).alias("level"), said["concerns"].alias("concerns")), "audits")

    titled = papers.select("paper_id", "title")
    metrics = _metrics(titled, items, audits, counted, digests, who, hold)
    written = _reports(titled, items, audits, metrics, digests, who, hold)
    light = screen.reports(pages, found, papers).select("paper_id", F.col("report").alias("light"))
    both = light.join(written, "paper_id", "full").select("paper_id", F.coalesce("report", "light").alias("report"))
    return Expert(items, chunks, digests, audits, metrics, hold(report.with_references(both, refs or []), "reports"))
