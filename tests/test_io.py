import json

import pytest
from pyspark.sql import functions as F

from siftmill.operators import corpus, tests
from siftmill.plans import expert, fixtures
from siftmill.sources import pdf, readers, responder, writers
from siftmill.streaming import ingest


def test_pdf_scan(spark, tmp_path):
    folder = tmp_path / "pdfs"
    folder.mkdir()
    with pytest.raises(ValueError):
        readers.pdfs(spark, str(tmp_path))
    for name in ("b", "a", "c"):
        (folder / f"{name}.pdf").write_bytes(b"%PDF " + name.encode())
    (folder / "x.txt").write_text("no")
    got = readers.pdfs(spark, str(tmp_path), first=2).collect()
    assert sorted(r["paper_id"] for r in got) == ["a", "b"] and len(got[0]["sha256"]) == 64
    (tmp_path / "ids").write_text("# note\n\n c \nc\n")
    ids = readers.id_list(spark, str(tmp_path / "ids"))
    assert [r["paper_id"] for r in readers.pdfs(spark, str(tmp_path), ids=ids).collect()] == ["c"]
    assert sorted(r["paper_id"] for r in readers.pdfs(spark, str(tmp_path), pattern="^[ab]$").collect()) == ["a", "b"]
    assert readers.pdfs(spark, str(tmp_path), pattern="nothing").count() == 0
    (folder / "c.pdf").chmod(0)  # what is not chosen is not read, and nothing with a content is sorted
    few = readers.pdfs(spark, str(tmp_path), first=2)
    assert sorted(few.inputFiles()) == sorted(f"file://{folder}/{n}.pdf" for n in "ab") and "Sort" not in few._jdf.queryExecution().toString()


def test_lines_of_tests(spark, tmp_path):
    lines = ['{"paper_id": "a", "page": 1, "abs_t": 2.0}', "", "no json", "[1]", '{"paper_id": "b", "page": "x", "abs_t": 1.0}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = readers.tests(spark, str(tmp_path / "t.jsonl")).orderBy("paper_id").collect()
    assert [(r["paper_id"], r["page"], r["abs_t"]) for r in got] == [("a", 1, 2.0), ("b", None, 1.0)]


def test_round_trips(spark, sf, tmp_path):
    made = fixtures.tests(spark, sf).select("paper_id", "page", "table_index", "coef", "paren", "abs_t", "p_approx_2s")
    writers.tests_json(made, str(tmp_path / "tests"))
    assert spark.read.json(str(tmp_path / "tests")).count() == made.count()
    features = tests.risk_score(tests.test_features(made))
    stub = spark.createDataFrame([(99, "pages>10")], "paper_id int, skipped_reason string")
    writers.features_csv([features, stub], str(tmp_path / "features"))
    back = readers.features(spark, str(tmp_path / "features"))
    assert {"risk_components", "skipped_reason"} <= set(back.columns) and back.count() == features.count() + 1
    assert json.loads(back.filter("risk_components IS NOT NULL").first()["risk_components"])
    writers.objects(features, str(tmp_path / "objects"))
    assert spark.read.text(str(tmp_path / "objects")).count() == features.count()


def test_cache(spark, tmp_path):
    papers = spark.createDataFrame([("a", "1" * 64, "k"), ("b", "2" * 64, "k")], "paper_id string, sha256 string, cache_key string")
    row = papers.filter("paper_id = 'a'").withColumn("sha12", F.substring("sha256", 1, 12)).withColumn("extractor_version", F.lit(tests.fixed.VERSION))
    hold, path = writers.holder(str(tmp_path / "held")), str(tmp_path / "cache")
    assert writers.read_cache(spark, path) is None
    writers.cache(row, path, hold, "x")
    cached = writers.read_cache(spark, path)
    assert [r["paper_id"] for r in writers.not_cached(papers, cached).collect()] == ["b"]
    changed = papers.withColumn("sha256", F.lit("3" * 64))
    assert writers.not_cached(changed, cached).count() == 2


def test_one_paper_touches_one_bucket(spark, tmp_path):
    """Only the bucket of a new or changed paper is read and written; a key has one row, and a bucket does not pile up files."""
    hold, path = writers.holder(str(tmp_path / "held")), str(tmp_path / "cache")

    def rows(names, value, more=""):
        frame = spark.createDataFrame([(n, f"{k:064d}", "k", value) for k, n in enumerate(names)], "paper_id string, sha256 string, cache_key string, value int")
        frame = writers.keyed(frame)
        return frame.withColumn(more, F.lit("new")) if more else frame

    def files():
        return {tuple(str(p.relative_to(path)).split("/")) for p in (tmp_path / "cache").rglob("*.parquet")}

    names = [f"p{k}" for k in range(40)]
    writers.cache(rows(names, 1), path, hold, "x")
    before = files()
    writers.cache(rows(["p0"], 2, "added"), path, hold, "x")
    after = files()
    own = f"bucket={writers.buckets_of(rows(['p0'], 2))[0]}"
    assert {d for d, _ in before - after} == {own} == {d for d, _ in after - before}
    assert sum(d == own for d, _ in after) == 1
    got = {r["paper_id"]: (r["value"], r["added"]) for r in writers.read_cache(spark, path).collect()}
    assert got == {n: (1, None) for n in names} | {"p0": (2, "new")}
    one = writers.read_cache(spark, path, writers.buckets_of(rows(["p0"], 2)))
    assert {f.split("/")[-2] for f in one.inputFiles()} == {own}
    writers.cache(rows([], 3), path, hold, "x")
    assert files() == after


def test_features_in_file_order(spark, tmp_path):
    """The first match is the same from one file as from several, whatever their sizes and however Spark packs them."""
    listed = [(f"p{k % 7}", f"h{k % 5}", str(k)) for k in range(200)]
    for name, cuts in (("one", [0, 200]), ("three", [0, 3, 190, 200])):
        (tmp_path / name).mkdir()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / name / f"part-{k:05d}.csv").write_text("paper_id,sha256,note\n" + "".join(f'{p},{h},"n{n}\nsecond line"\n' for p, h, n in listed[a:b]))
    papers = spark.createDataFrame([("p3", "h4"), ("none", "h2"), ("p6", "h0")], "paper_id string, sha256 string")
    want = {p: next(n for q, g, n in listed if q == p or g == h) for p, h in (("p3", "h4"), ("none", "h2"), ("p6", "h0"))}
    for name in ("one", "three"):
        rows = readers.features(spark, str(tmp_path / name))
        assert {r["paper_id"]: r["note"].split("\n")[0][1:] for r in corpus.match_rows(papers, rows).collect()} == want


def test_stream_equals_batch(spark, sf, tmp_path):
    made = fixtures.tests(spark, sf).select(F.col("paper_id").cast("string").alias("paper_id"), "page", "table_index", "abs_t", "p_approx_2s")
    made.repartition(3).write.json(str(tmp_path / "in"))
    ingest.keep_counts(ingest.test_lines(spark, str(tmp_path / "in")), str(tmp_path / "counts"), str(tmp_path / "ck")).awaitTermination()
    got = {r["paper_id"]: (r["tests"], r["t_1_96_left"], r["p_0_05_z"]) for r in ingest.totals(spark, str(tmp_path / "counts")).collect()}
    want = {r["paper_id"]: (r["tests"], r["t_1_96_left"], r["p_0_05_z"]) for r in tests.test_features(made).collect()}
    assert got == want


def test_adapters_say_what_is_missing():
    with pytest.raises(ImportError, match="fitz"):
        pdf.need("fitz")


def echo():
    class Echo:  # within a function, so that it travels to the workers by value
        def __init__(self):
            self.calls = 0

        def answer(self, system, prompt):
            self.calls += 1
            if prompt == "flaky" and self.calls == 1:
                raise RuntimeError("Your request was blocked")
            return "no object" if prompt == "bad" else '{"ok": 1}'

    return Echo()


def test_responder(spark):
    waits = []
    assert responder.persistent(echo(), "", "flaky", wait=waits.append) == '{"ok": 1}' and waits == [1.0]
    with pytest.raises(RuntimeError):
        responder.persistent(responder.Offline(), "", "x")
    packets = spark.createDataFrame([("a", "bad"), ("b", "good")], "paper_id string, prompt string")
    got = {r["paper_id"]: r["object"] for r in responder.objects(packets, echo(), "s").collect()}
    assert got == {"a": '{"ok":1}', "b": '{"ok":1}'}  # the first is repaired when asked again
    assert responder.passing(ValueError("Error code: 403 - permission_denied")) and not responder.passing(ValueError("403"))


def test_settings_fail_fast(spark):
    with pytest.raises(ValueError, match="spark.siftmill.model"):
        readers.settings(spark)


def test_extract_and_report(spark, tmp_path):
    """From page texts and cells to tests, features and reports, by way of the command line."""
    from siftmill import __main__
    from siftmill.plans import screen

    text = "Table 1. Effects\nStandard errors are in parentheses. Robustness of each specification."
    pages = spark.createDataFrame([("a", 1, text), ("a", 2, "References"), ("b", 1, "nothing"), ("b", 2, "x"), ("b", 3, "x")], readers.PAGES)
    grid = [("0.20**", "(0.10)"), ("1.95", "(1.0)"), ("0.5 (0.1)", ""), ("3)", "(4)")]
    cells = []
    for paper, page in (("a", 1), ("a", 2)):
        for r, row in enumerate(grid):
            for k, cell in enumerate(row):
                cells.append((paper, page, 0, 2 * r + k, 0, cell, [0.0, 0.0, 500.0, 500.0], [100.0, 20.0 * r, 140.0, 20.0 * r + 10]))
    cells = spark.createDataFrame(cells, readers.CELLS)
    pages.write.parquet(str(tmp_path / "pages"))
    cells.write.parquet(str(tmp_path / "cells"))
    done = screen.extract(pages, cells, max_pdf_pages=2)
    rows = {r["paper_id"]: r for r in done.features.collect()}
    assert rows["a"]["tests"] == 3 and rows["a"]["pairs_raw"] == 4 and rows["a"]["filter_counts"] == {"column_label_like": 1}
    assert rows["a"]["t_1_96_left"] == 1 and rows["a"]["t_1_96_right"] == 1 and rows["a"]["reference_pages"] == 1 and rows["a"]["candidate_pages"] == [1]
    assert rows["b"]["skipped_reason"] == "pages>2" and rows["b"]["risk_score"] is None
    assert {r["paren_mode"] for r in done.meta.collect()} == {"se"}
    words = spark.createDataFrame([("a", 1, 0, 0, 0, "Income", 10.0, 0.0, 60.0, 10.0), ("a", 1, 0, 1, 0, "(1)", 105.0, 3.0, 130.0, 8.0)], "paper_id string, page int, block_no int, line_in_block int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    named = screen.labelled_examples(done.tests, words, done.tests)
    assert {r["row_label"] for r in named.collect() if r["row_index"] == 0} == {"Income"}
    __main__.main(["extract", "--pages", str(tmp_path / "pages"), "--cells", str(tmp_path / "cells"), "--out", str(tmp_path / "out"), "--export"])
    assert spark.read.json(str(tmp_path / "out/tests")).count() == spark.read.parquet(str(tmp_path / "out/tests.parquet")).count() == 3
    meta = {r["paper_id"]: r for r in spark.read.json(str(tmp_path / "out/meta")).collect()}["a"]
    assert meta["dropped_examples"][0]["reasons"] == ["column_label_like"] and meta["tables_raw_list"] == meta["tables_kept_list"] == [[1, 0]]
    (tmp_path / "note.md").write_text("## References (APA)\n- Smith (2001)\n")
    __main__.main(["report", "--pages", str(tmp_path / "pages"), "--tests", str(tmp_path / "out/tests.parquet"), "--features", str(tmp_path / "out/features"), "--references", str(tmp_path / "note.md"), "--out", str(tmp_path / "out"), "--export"])
    shown = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out/reports"), wholetext=True).collect())
    assert "Risk score" in shown and "- Smith (2001)" in shown and "Table 1. Effects" in shown
    assert json.loads(spark.read.text(str(tmp_path / "out/diagnostic")).first()["value"])["tests"] == 3
    record = json.loads(spark.read.text(str(tmp_path / "out/run_report")).first()["value"])
    assert record["made"] == {"reports": 1} and record["version"] == tests.fixed.VERSION


def test_a_second_run_reads_the_cache(spark, tmp_path):
    """Only papers whose pages or settings changed are worked out again."""
    from siftmill import __main__

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / name))

    grid = [("0.20**", "(0.10)"), ("1.95", "(1.0)")]
    cells = [(paper, 1, 0, 2 * r + k, 0, cell, [0.0, 0.0, 9.0, 9.0], [1.0, 2.0, 3.0, 4.0]) for paper in "abc" for r, row in enumerate(grid) for k, cell in enumerate(row)]
    write("cells", cells, readers.CELLS)
    write("pages", [(p, 1, f"Table 1. Effects in {p}") for p in "abc"], readers.PAGES)
    run = ["extract", "--pages", str(tmp_path / "pages"), "--cells", str(tmp_path / "cells"), "--out", str(tmp_path / "out")]

    def made(*more):
        __main__.main([*run, *more])
        record = json.loads(spark.read.text(str(tmp_path / "out/run_extract")).first()["value"])["made"]
        pairs.append(record.pop("pairs"))
        return record

    pairs = []
    assert made("--only-regex", "^[ab]$") == {"papers": 2, "worked_out": 2, "tests": 4}
    assert made() == {"papers": 3, "worked_out": 1, "tests": 6}
    write("pages", [("a", 1, "Table 1. Something else")] + [(p, 1, f"Table 1. Effects in {p}") for p in "bc"], readers.PAGES)
    assert made() == {"papers": 3, "worked_out": 1, "tests": 6}
    assert made("--force", "--limit", "1") == {"papers": 1, "worked_out": 1, "tests": 2}
    assert [(p["rows"], p["tests"]) for p in pairs] == [(4, 4), (2, 2), (2, 2), (2, 2)]  # seen in the pass that wrote them


def test_sidecars_and_logs(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"extractor_version": "v"}')
    (tmp_path / "bad.json").write_text("{")
    got = readers.sidecars(spark, str(tmp_path / "*.json"), "extractor_version string")
    assert sorted(str(r["extractor_version"]) for r in got.collect()) == ["None", "v"]
    writers.reports(spark.createDataFrame([("a", "# R\ntext")], "paper_id string, report string"), str(tmp_path / "reports"))
    assert spark.read.text(str(tmp_path / "reports"), wholetext=True).first()["value"].startswith("# R\ntext")


def test_packets(spark):
    pages = spark.createDataFrame([("a", i, f"text {i}") for i in range(1, 12)], "paper_id string, page int, text string")
    chunks = responder.page_chunks(pages).orderBy("chunk").collect()
    assert len(chunks) == 2 and json.loads(chunks[0]["prompt"])[0] == {"page": 1, "text": "text 1"}


def reviewer():
    class Reviewer:
        """Answers each task; gets the metrics of paper a wrong twice, those of b always, and leaves out a section of a."""

        model = "made-up"

        def __init__(self):
            self.asked = {}

        def answer(self, system, prompt):
            import json as j
            import re

            task = re.search(r"TASK (\w+ \w+)", prompt).group(1)
            given = j.loads(prompt[prompt.rindex("\n") + 1 :]) if prompt.rstrip().endswith("}") else {}
            if task == "summarise pages":
                return '{"key_points": ["x"]}'
            if task == "digest the":
                return 'Here it is: {"summary": "s"}'
            if task == "audit one":
                return j.dumps({"risk_score": 80 if given["id"] == "Table 1" else 10, "concerns": ["c " + given["id"]]})
            if task == "metrics of":
                entries = [{"kind": i["kind"], "id": i["id"], "pages": i["pages"]} for i in given["inventory"]]
                good = given["title"] == "a" and "Give the whole object again" in prompt
                return j.dumps({"paper": {k: 1 for k in ("title", "overall_risk_score_0_100", "overall_risk_level", "top_concerns", "key_artifacts")}, "artifacts": entries if good else entries[1:], "generated_at": "now"})
            if task == "write the":
                if "head of" in prompt:
                    return "# Review: " + given["title"] + "\n\n## Summary\n\ns\n\n## The paper\n\np\n\n## What was checked\n\nw\n\n## Tables and figures"
                return "## Assessment\n\na\n\n## Limits\n\nl"
            listed = given["artifacts"]
            return "\n\n".join(f"### {i['id']}: {i['caption']}\n\ntext" for i in (listed if len(listed) == 1 else listed[:-1]))

    return Reviewer()


def papers_of_an_expert(spark):
    pages = [(p, k, f"Table {k}. Effects in {p}\nSee table {k}.") for p in "ab" for k in range(1, 4)] + [("b", 4, "Figure 1. Trends")]
    rows = [(p, k, 0, r, 0, 1.9 + r / 100, 1.0, 1.9 + r / 100, 0.05, 1.9 + r / 100, "1.9", "(1.0)", 1) for p in "ab" for k in (1, 2) for r in range(12)]
    found = spark.createDataFrame(rows, "paper_id string, page int, table_index int, row_index int, col_index int, coef double, paren double, t double, p_approx_2s double, abs_t double, coef_raw string, se_cell_text_snippet string, stars int")
    return spark.createDataFrame(pages, "paper_id string, page int, text string"), found, spark.createDataFrame([("a", "a", 30.0), ("b", "b", None)], "paper_id string, title string, risk_score double")


def test_expert_workflow(spark, tmp_path):
    pages, found, papers = papers_of_an_expert(spark)
    done = expert.run(pages, found, papers, reviewer(), writers.holder(str(tmp_path / "held")), ["Smith (2001)"])
    audits = {(r["paper_id"], r["id"]): r for r in done.audits.collect()}
    assert len(audits) == 7 and audits["a", "Table 1"]["level"] == "High" and audits["b", "Figure 1"]["concerns"] == ["c Figure 1"]
    metrics = {r["paper_id"]: (r["source"], json.loads(r["object"])) for r in done.metrics.collect()}
    assert metrics["a"][0] == "model" and metrics["b"][0] == "audits"  # a was repaired, b never fitted
    assert [x["id"] for x in metrics["b"][1]["artifacts"]] == ["Table 1", "Table 2", "Table 3", "Figure 1"] and metrics["b"][1]["paper"]["key_artifacts"][0] == "Table 1"
    assert metrics["b"][1]["artifacts"][0]["has_numeric_evidence"] and not metrics["b"][1]["artifacts"][3]["has_numeric_evidence"]
    reports = {r["paper_id"]: r["report"] for r in done.reports.collect()}
    for paper, ids in (("a", ["Table 1", "Table 2", "Table 3"]), ("b", ["Table 1", "Table 2", "Table 3", "Figure 1"])):
        assert reports[paper].startswith(f"# Review: {paper}") and all(f"### {i}:" in reports[paper] for i in ids)  # also the one left out at first
        assert "## Limits" in reports[paper] and "- Smith (2001)" in reports[paper]
    log = spark.read.parquet(str(tmp_path / "held/heads_0"))
    assert {"started", "attempts", "prompt_sha256", "model", "system_chars"} <= set(log.columns) and log.first()["model"] == "made-up"


def test_expert_workflow_without_a_model(spark, tmp_path):
    pages, found, papers = papers_of_an_expert(spark)
    done = expert.run(pages, found, papers, responder.Offline(), writers.holder(str(tmp_path / "held")))
    assert done.audits.count() == 0 and {r["source"] for r in done.metrics.collect()} == {"audits"}
    assert all(r["report"].startswith("# Screening report") for r in done.reports.collect())


def test_endpoint():
    import http.server
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((body, self.headers.get("Authorization")))
            said = body["messages"][-1]["content"]
            self.send_response(403 if said == "blocked" else 200)
            self.end_headers()
            self.wfile.write(b"permission_denied" if said == "blocked" else json.dumps({"choices": [{"message": {"content": "" if said == "empty" else "fine"}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        who = responder.Endpoint(f"http://127.0.0.1:{server.server_port}/chat", "m", "k", 5)
        assert who.answer("sys", "hello") == "fine" and asked[0][1] == "Bearer k" and asked[0][0]["messages"][0] == {"role": "system", "content": "sys"}
        for prompt in ("blocked", "empty"):
            with pytest.raises(RuntimeError) as e:
                who.answer("", prompt)
            assert responder.passing(e.value)
    finally:
        server.shutdown()


FITZ = """
class Rect(tuple):
    def __new__(cls, *edges):
        return tuple.__new__(cls, edges)


Matrix = Rect


class Pixmap:
    def __init__(self, clip):
        self.clip = clip

    def tobytes(self, kind, jpg_quality):
        return f"{kind} {jpg_quality} {self.clip}".encode()


class Page:
    def __init__(self, text):
        self.text = text

    def get_text(self, kind):
        return self.text if kind == "text" else [(1.0, 2.0, 3.0, 4.0, w, 0, 0, k) for k, w in enumerate(self.text.split())]

    def get_pixmap(self, matrix, alpha, clip):
        return Pixmap(clip)


class Document(list):
    metadata = {"title": "T", "author": None, "subject": "S"}

    def __enter__(self):
        return self

    def __exit__(self, *error):
        return False

    page_count = property(len)

    def load_page(self, k):
        return self[k]


def open(stream, filetype):
    assert filetype == "pdf"
    return Document(map(Page, stream.decode().split("|")))
"""
PDFPLUMBER = """
class Table:
    bbox = (0, 0, 10, 10)

    def __init__(self, text):
        self.grid = [line.split(",") for line in text.split(";")]
        self.rows = [type("Row", (), {"cells": [(c, r, c + 1, r + 1) for c in range(len(line) - (r == 1))]})() for r, line in enumerate(self.grid)]

    def extract(self):
        return self.grid


class Page:
    def __init__(self, text):
        self.text = text

    def find_tables(self, table_settings):
        if self.text == "broken":
            raise ValueError("no tables here")
        return [Table(self.text)]


class Document:
    def __init__(self, pages):
        self.pages = pages

    def __enter__(self):
        return self

    def __exit__(self, *error):
        return False


def open(stream):
    return Document([Page(t) for t in stream.read().decode().split("|")])
"""


def test_pdf_adapter_with_libraries_that_stand_in(spark, tmp_path, monkeypatch):
    """The adapter's own code, on modules with the few calls that it makes; a "PDF" is its pages' texts with bars between."""
    import sys

    monkeypatch.setattr(sys, "path", list(sys.path))
    for name, code in (("fitz", FITZ), ("pdfplumber", PDFPLUMBER)):
        (tmp_path / f"{name}.py").write_text(code)
        spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    files = spark.createDataFrame([("a", bytearray(b"one two|three")), ("b", bytearray(b"x,1;y|broken"))], "paper_id string, content binary")
    assert sorted(tuple(r) for r in pdf.pages(files).select("paper_id", "page", "text").collect()) == [("a", 1, "one two"), ("a", 2, "three"), ("b", 1, "x,1;y"), ("b", 2, "broken")]
    assert [(r["text"], r["word_no"], r["x1"]) for r in pdf.words(files).filter("paper_id = 'a'").orderBy("page", "word_no").collect()] == [("one", 0, 3.0), ("two", 1, 3.0), ("three", 0, 3.0)]
    assert pdf.metadata(files).filter("paper_id = 'a'").first().asDict() == {"title": "T", "author": None, "subject": "S", "pages": 2, "paper_id": "a"}
    wanted = files.withColumn("wanted", F.array(F.lit(1), F.lit(2), F.lit(9)))
    got = {(r["row_index"], r["col_index"]): (r["cell_text"], r["cell_bbox"]) for r in pdf.cells(wanted.filter("paper_id = 'b'")).collect()}
    assert got == {(0, 0): ("x", [0, 0, 1, 1]), (0, 1): ("1", [1, 0, 2, 1]), (1, 0): ("y", None)}  # a page that cannot be read has no table
    regions = files.withColumn("regions", F.expr("from_json('[{\"page\": 1, \"x0\": 0, \"y0\": 1, \"x1\": 2, \"y1\": 3}, {\"page\": 2}]', 'array<struct<page int, x0 double, y0 double, x1 double, y1 double>>')"))
    shown = [(r["page"], bytes(r["image"]).decode()) for r in pdf.renders(regions.filter("paper_id = 'a'")).orderBy("page").collect()]
    assert shown == [(1, "jpeg 75 (0.0, 1.0, 2.0, 3.0)"), (2, "jpeg 75 None")]
    for name in ("fitz", "pdfplumber"):
        sys.modules.pop(name, None)
