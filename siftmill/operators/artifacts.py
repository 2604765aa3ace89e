"""Tables and figures of papers: inventory, mentions, excerpts, audits, and the metrics object."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions import stats, text


def inventory(captions: DataFrame, cap: int | None = None) -> DataFrame:
    """paper_id, kind, id, caption, pages, place: one row of each table and figure, by first page, tables before figures.

    captions: paper_id, page, kind, caption of both kinds. cap: at most so many of each paper.
    """
    named = captions.withColumn("id", F.when(F.col("kind") == "table", text.artifact_id(F.col("caption"), "table")).otherwise(text.artifact_id(F.col("caption"), "figure")))
    grouped = named.groupBy("paper_id", "kind", "id").agg(F.min_by("caption", "page").alias("caption"), F.sort_array(F.collect_set("page")).alias("pages"))
    order = Window.partitionBy("paper_id").orderBy(F.col("pages")[0], F.when(F.col("kind") == "table", 0).otherwise(1), "id")
    placed = grouped.withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= cap) if cap is not None else placed


AROUND, CUT = 140, 220


def name_index(pages: DataFrame) -> DataFrame:
    """paper_id, page, name (lower case), k, snippet: every place where a page names a numbered table or figure, from one reading of it."""
    return pages.select("paper_id", "page", F.explode(text.named(F.col("text"), AROUND, CUT)).alias("m")).select("paper_id", "page", "m.*")


def mentions(items: DataFrame, pages: DataFrame, most: int = 8, of_page: int = 2) -> DataFrame:
    """paper_id, kind, id, page, snippet, rank: where a paper's pages name an artifact.

    Numbered artifacts meet the index of names by an equi-join on paper and name, so a page is read
    once and by one pattern, however many artifacts its paper has. The few whose caption has no number
    are looked for by their own words, on the pages of their papers only. Each hit has its own
    surroundings, also where they overlap.
    """
    numbered = F.col("id").rlike(r"(?iU)^(table|figure) [a-z]{0,3}\d+[a-z]?$")
    own = items.select("paper_id", "kind", "id", F.when(numbered, F.lower("id")).otherwise("").alias("name"))
    # one join, so that the inventory is worked out once: whole pages have the name of those without a number
    none = {"text": "string", "k": "int", "snippet": "string"}
    named = name_index(pages).withColumn("text", F.lit(None).cast("string"))
    whole = pages.select("paper_id", "page", "text", F.lit("").alias("name"), *(F.lit(None).cast(none[c]).alias(c) for c in ("k", "snippet")))
    met = own.join(named.unionByName(whole), ["paper_id", "name"])
    words = F.concat(F.lit(r"(?iU)\b\Q"), F.col("id"), F.lit(r"\E\b"))
    t = F.coalesce("text", F.lit(""))
    searched = F.when(F.regexp_like(t, words), F.transform(text.snippets(t, [words], of_page, AROUND, CUT), lambda s, k: F.struct(k.alias("k"), s.alias("snippet"))))
    shown = F.when(F.col("name") != "", F.array(F.struct("k", "snippet"))).otherwise(searched)
    found = met.select("paper_id", "kind", "id", "page", F.inline(shown)).filter("snippet <> ''")
    first = found.groupBy("paper_id", "kind", "id", "page", F.lower("snippet").alias("same")).agg(F.min("k").alias("k"), F.min_by("snippet", "k").alias("snippet"))
    upto = Window.partitionBy("paper_id", "kind", "id", "page").orderBy("k")
    rows = first.withColumn("k", F.row_number().over(upto) - 1).filter(F.col("k") < of_page).select("paper_id", "kind", "id", "page", "k", "snippet")
    order = Window.partitionBy("paper_id", "kind", "id").orderBy("page", "k")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("k")


def excerpts(items: DataFrame, pages: DataFrame, most_pages: int = 4, most_chars: int = 3200) -> DataFrame:
    """paper_id, kind, id, page, excerpt of each artifact's first pages."""
    wanted = items.select("paper_id", "kind", "id", F.explode(F.slice("pages", 1, most_pages)).alias("page"))
    return wanted.join(pages.select("paper_id", "page", "text"), ["paper_id", "page"]).select("paper_id", "kind", "id", "page", text.page_excerpt(F.col("text"), most_chars).alias("excerpt"))


def enriched(items: DataFrame, pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """The inventory with mentions, excerpts and (tables) metrics of each artifact."""
    key = ["paper_id", "kind", "id"]
    said = mentions(items, pages).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "page", "snippet"))), lambda x: F.struct(x["page"].alias("page"), x["snippet"].alias("snippet"))).alias("mentions"))
    shown = excerpts(items, pages).groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("page", "excerpt")))).alias("page_text_excerpts"))
    counted = metrics.select("paper_id", F.lit("table").alias("kind"), F.col("table_id").alias("id"), F.struct(*(c for c in metrics.columns if c not in ("paper_id", "table_id"))).alias("table_metrics"))
    return items.join(said, key, "left").join(shown, key, "left").join(counted, key, "left")


def by_position(audits: DataFrame, items: DataFrame) -> DataFrame:
    """Audits (paper_id, place, …) with kind, id, caption and pages of the artifact in their place, where a paper has as many of both."""
    identity = ("kind", "id", "caption", "pages")
    n_a = audits.groupBy("paper_id").agg(F.count("*").alias("n_audits"))
    n_i = items.groupBy("paper_id").agg(F.count("*").alias("n_items"))
    equal = n_a.join(n_i, "paper_id").filter("n_audits = n_items").select("paper_id")
    named = items.join(equal, "paper_id", "left_semi").select("paper_id", "place", *(F.col(c).alias(f"own_{c}") for c in identity))
    joined = audits.join(named, ["paper_id", "place"], "left")
    has = set(audits.columns)
    return joined.select("paper_id", "place", *(F.coalesce(f"own_{c}", c).alias(c) if c in has else F.col(f"own_{c}").alias(c) for c in identity), *(c for c in audits.columns if c not in ("paper_id", "place", *identity)))


def last_audit(audits: DataFrame) -> DataFrame:
    """One audit of each artifact: the last. audits: paper_id, id, place and what an audit says."""
    others = [c for c in audits.columns if c not in ("paper_id", "id")]
    return audits.groupBy("paper_id", "id").agg(F.max_by(F.struct(*others), "place").alias("audit"))


def fallback_metrics(items: DataFrame, audits: DataFrame, metrics: DataFrame) -> DataFrame:
    """The metrics of each artifact when no model gave any: its audit's score and concerns beside its counts.

    audits: paper_id, id, place, score (null if none), level, concerns (array). The score of an
    artifact without one shows as 0, but does not count in ``overall``.
    """
    audit = last_audit(audits).select("paper_id", "id", "audit.score", "audit.level", "audit.concerns")
    counts = metrics.select("paper_id", F.lit("table").alias("kind"), F.col("table_id").alias("id"), "n_tests", F.col("p_005_left").alias("p_005_just_sig"), F.col("p_005_right").alias("p_005_just_nonsig"), F.col("t_196_left").alias("t_196_just_below"), F.col("t_196_right").alias("t_196_just_above"), "t_exact_2_count", "sig_p_le_0_05", "sig_p_le_0_10", "pcurve_low_half", "pcurve_high_half", "pcurve_right_skew_z")
    joined = items.join(audit, ["paper_id", "id"], "left").join(counts, ["paper_id", "kind", "id"], "left")
    numeric = (F.col("kind") == "table") & (F.coalesce("n_tests", F.lit(0)) > 0)
    return joined.select(
        "paper_id", "kind", "id", "pages", "place", "score",
        F.coalesce("score", F.lit(0.0)).alias("risk_score_0_100"),
        F.coalesce("level", stats.risk_level(F.col("score"), fixed.EXPERT_LEVELS)).alias("risk_level"),
        numeric.alias("has_numeric_evidence"),
        F.struct(*(F.when(numeric, F.col(c)).alias(c) for c in fixed.EVIDENCE_COUNTS)).alias("evidence_counts"),
        F.slice(F.coalesce("concerns", F.array().cast("array<string>")), 1, 6).alias("signals"),
        F.coalesce("concerns", F.array().cast("array<string>")).alias("concerns"),
    )


def fallback_paper(artifacts: DataFrame) -> DataFrame:
    """paper_id, overall score and level, top_concerns (10), key_artifacts (8 of highest score) from ``fallback_metrics``."""
    concerns = F.filter(F.transform(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "concerns"))), lambda x: x["concerns"])), lambda c: F.trim(c)), lambda c: F.length(c) > 0)
    keys = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("risk_score_0_100")).alias("low"), "place", "id"))), 1, 8), lambda x: x["id"])
    made = artifacts.groupBy("paper_id").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"), F.slice(F.array_distinct(concerns), 1, 10).alias("top_concerns"), keys.alias("key_artifacts"))
    return made.select("paper_id", F.bround("mean", 2).alias("overall_risk_score_0_100"), stats.risk_level(F.col("mean"), fixed.EXPERT_LEVELS).alias("overall_risk_level"), "top_concerns", "key_artifacts")


def missing(items: DataFrame, covered: DataFrame) -> DataFrame:
    """Artifacts of the inventory whose id is not among those covered."""
    return items.join(covered.select("paper_id", "id"), ["paper_id", "id"], "left_anti")


def validate(objects: DataFrame, items: DataFrame) -> DataFrame:
    """paper_id, ok, why of metrics objects (paper_id, object: JSON text) against the inventory.

    The checks run in order and the first that fails is named: shape, known ids, no id twice, kinds,
    pages, every artifact covered, and the keys of ``paper``.
    """
    v = F.try_parse_json("object")
    top = objects.select("paper_id", v.alias("v"))
    shape = top.select(
        "paper_id", "v",
        F.coalesce(F.schema_of_variant("v"), F.lit("VOID")).startswith("OBJECT").alias("is_object"),
        F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")).alias("keys"),
        F.map_keys(F.try_variant_get("v", "$.paper", "map<string,variant>")).alias("paper_keys"),
        F.try_variant_get("v", "$.artifacts", "array<variant>").alias("artifacts"),
    )
    entries = shape.select("paper_id", F.posexplode("artifacts").alias("k", "a")).select(
        "paper_id", "k", F.try_variant_get("a", "$.id", "string").alias("id"), F.try_variant_get("a", "$.kind", "string").alias("kind"),
        F.try_variant_get("a", "$.pages", "array<variant>").isNotNull().alias("has_pages"), F.schema_of_variant("a").startswith("OBJECT").alias("is_object"),
    )
    known = items.select("paper_id", "id", F.col("kind").alias("own_kind"))
    judged = entries.join(known, ["paper_id", "id"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("paper_id", "id").orderBy("k")))
    name = F.coalesce("id", F.lit(""))
    fault = (
        F.when(~F.col("is_object"), F.lit("an artifacts entry is not an object"))
        .when(F.col("own_kind").isNull(), F.concat(F.lit("artifact id not in inventory: "), name))
        .when(F.col("nth") > 1, F.concat(F.lit("duplicate artifact id: "), name))
        .when(~F.coalesce(F.col("kind").isin("table", "figure"), F.lit(False)), F.concat(F.lit("invalid kind for "), name))
        .when(F.col("kind") != F.col("own_kind"), F.concat(F.lit("kind mismatch for "), name))
        .when(~F.col("has_pages"), F.concat(F.lit("invalid pages for "), name))
    )
    faults = judged.withColumn("fault", fault).filter("fault IS NOT NULL").groupBy("paper_id").agg(F.min_by("fault", "k").alias("fault"))
    lacking = missing(items.join(objects.select("paper_id"), "paper_id", "left_semi"), entries).groupBy("paper_id").agg(F.min_by("id", "place").alias("lacking"))
    joined = shape.join(faults, "paper_id", "left").join(lacking, "paper_id", "left")
    extra = F.get(F.array_sort(F.array_except("keys", F.array(*map(F.lit, fixed.METRIC_TOP)))), F.lit(0))
    key = F.get(F.filter(F.array(*map(F.lit, fixed.METRIC_PAPER)), lambda k: ~F.array_contains(F.col("paper_keys"), k)), F.lit(0))
    why = (
        F.when(~F.col("is_object"), F.lit("top-level is not an object"))
        .when(extra.isNotNull(), F.concat(F.lit("unexpected top-level key: "), extra))
        .when(F.col("paper_keys").isNull(), F.lit("missing/invalid paper"))
        .when(F.col("artifacts").isNull(), F.lit("missing/invalid artifacts"))
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("lacking").isNotNull(), F.concat(F.lit("missing artifact: "), F.col("lacking")))
        .when(key.isNotNull(), F.concat(F.lit("missing paper."), key))
        .otherwise(F.lit("ok"))
    )
    return joined.select("paper_id", (why == "ok").alias("ok"), why.alias("why"))
