"""The light workflow with a made-up model that sees, one that does not answer, and none."""

import json

from test_io import papers_of_an_expert

from siftmill.plans import light
from siftmill.sources import ledger, readers, responder, writers


def seer():
    class Seer:
        """Chooses pages of paper a only, sees what stands in an image, breaks its JSON once for page 2, and writes no score for b."""

        model = "seer"

        def answer(self, system, prompt, image=None):
            import json as j

            given = j.loads(prompt[prompt.index("\n") + 1 :])
            if "choose pages" in prompt:
                pages = [3, 2, 3, 77, 1] if given["title"] == "a" else []
                return j.dumps({"selected_pages": [{"page": p, "role": f"r{p}", "reason": "x"} for p in pages]}) if pages else "none of them"
            if "look at a page" in prompt:
                if image == b"refused":
                    raise ValueError("no images please")
                if image == b"two" and "again" not in prompt:
                    return "not JSON"
                return j.dumps({"signals": [{"signal": f"s{k}", "evidence": (image or b"text only").decode(), "anchors": []} for k in range(6)], "confidence_0_1": 0.9}) if given["page"] != 1 else "nothing at all"
            if "first page" in prompt:
                return j.dumps({"title": f"seen {image.decode()}", "year": 1999})
            return "Risk score: 12/100\nRisk level: Low\n" + "; ".join(sorted(j.loads(e)["signals"][0]["evidence"] for e in given["evidence"] if j.loads(e).get("signals"))) if given["paper"]["title"].startswith("seen") else "no score"

    return Seer()


def inputs(spark):
    pages, found, papers = papers_of_an_expert(spark)
    images = [("a", 1, b"one"), ("a", 2, b"two"), ("a", 3, b"refused"), ("b", 2, b"bee")]
    return pages, found, papers, spark.createDataFrame(images, readers.IMAGES)


def test_with_a_model_that_sees(spark, tmp_path):
    who = ledger.Ledger(spark, str(tmp_path / "ledger"), seer(), slots=2, pause=0.0)
    done = light.run(*inputs(spark), who, writers.holder(str(tmp_path / "held")), ["Smith (2001)"], most=2)
    chosen = {(r["paper_id"], r["rank"]): (r["page"], r["role"], r["source"]) for r in done.chosen.collect()}
    assert chosen["a", 1] == (3, "r3", "model") and chosen["a", 2] == (2, "r2", "model") and chosen["b", 1][::2] == (1, "text") and len(chosen) == 4
    evidence = {(r["paper_id"], r["page"]): r for r in done.evidence.collect()}
    assert len(evidence) == 4 and len(evidence["a", 2]["signals"]) == light.SIGNALS
    assert evidence["a", 2]["signals"][0]["evidence"] == "two" and evidence["a", 2]["source"] == "model"  # at the second, short question
    assert evidence["a", 3]["signals"][0]["evidence"] == "text only"  # the image was refused
    assert evidence["b", 1]["source"] == "text" and evidence["b", 1]["confidence_0_1"] == 0.25
    meta = {r["paper_id"]: (r["title"], r["year"], r["source"]) for r in done.meta.collect()}
    assert meta == {"a": ("seen one", 1999, "model"), "b": ("b", None, "text")}
    reports = {r["paper_id"]: (r["report"], r["source"]) for r in done.reports.collect()}
    assert reports["a"][0].startswith("Risk score: 12/100") and "text only; two" in reports["a"][0] and "- Smith (2001)" in reports["a"][0]
    assert reports["b"][1] == "text" and reports["b"][0].startswith("# Screening report")
    calls = who.calls().filter("error IS NULL").count()
    light.run(*inputs(spark), who, writers.holder(str(tmp_path / "held2")), most=2)
    assert who.calls().filter("error IS NULL").count() == calls  # nothing that was answered is asked again


def test_without_a_model(spark, tmp_path):
    done = light.run(*inputs(spark), responder.Offline(), writers.holder(str(tmp_path / "held")))
    for frame in (done.chosen, done.evidence, done.meta, done.reports):
        assert {r["source"] for r in frame.collect()} == {"text"}


def test_an_image_is_a_part_of_the_message():
    import http.server
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "fine"}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        who = responder.Adaptive(responder.Endpoint(f"http://127.0.0.1:{server.server_port}/chat", "m"))
        assert who.answer("s", "look", b"\x89PNG...") == "fine" and who.answer("s", "look") == "fine"
    finally:
        server.shutdown()
    assert asked[0][1]["image_url"]["url"].startswith("data:image/png;base64,") and asked[0][0]["text"] == "look" and asked[1] == "look"
