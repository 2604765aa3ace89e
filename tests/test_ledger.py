"""The ledger of answers: resumed runs, the log, waves, pace, and prompts without a system message."""

import json

import pytest
from pyspark.sql import functions as F
from test_io import papers_of_an_expert, reviewer

from siftmill.plans import expert
from siftmill.sources import ledger, responder, writers


def counting(answers, folder):
    """Answers through another responder and writes down each call in a folder that all tasks share."""

    class Counting:
        model, most_tokens, temperature = "counted", 99, 0.5

        def __init__(self, inner, folder):
            self.inner, self.folder = inner, folder

        def answer(self, system, prompt):
            import json as j
            import time as t
            import uuid

            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(j.dumps([t.time(), prompt]))
            return self.inner.answer(system, prompt)

    return Counting(answers, str(folder))


def calls_in(folder):
    return [json.loads(p.read_text()) for p in folder.iterdir()]


def test_a_second_run_asks_nothing_and_a_changed_page_only_its_chunk(spark, tmp_path):
    pages, found, papers = papers_of_an_expert(spark)

    def run(pages, name):
        seen = tmp_path / name
        seen.mkdir()
        who = ledger.Ledger(spark, str(tmp_path / "ledger"), counting(reviewer(), seen), slots=4, pause=0.0)
        done = expert.run(pages, found, papers, who, writers.holder(str(tmp_path / f"held_{name}")))
        reports = {r["paper_id"]: r["report"] for r in done.reports.collect()}
        return reports, {r["paper_id"]: r["source"] for r in done.metrics.collect()}, [p for _, p in calls_in(seen)], who

    first = run(pages, "first")
    assert first[1] == {"a": "model", "b": "audits"} and len(first[2]) - 1 == len(set(first[2])) > 20  # the last repair of b is the one before it, asked once more
    second = run(pages, "second")
    assert second[2] == [] and second[:2] == first[:2]
    more = pages.withColumn("text", F.when((F.col("paper_id") == "a") & (F.col("page") == 3), F.concat("text", F.lit("\nA new line."))).otherwise(F.col("text")))
    third = run(more, "third")
    tasks = sorted(p.split(" ", 2)[1] for p in third[2])
    assert tasks == ["audit", "summarise"]  # the page's chunk, and the table whose excerpt it is in; both answers are the same as before
    calls = third[3].calls()
    log = ledger.log(calls)
    row = log.filter("kind = 'digest'").first()
    assert row["model"] == "counted" and row["max_tokens"] == 99 and row["temperature"] == 0.5 and row["prompt_chars"] > 0 and row["answer_chars"] > 0 and row["error"] is None
    assert calls.count() == len(first[2]) + len(third[2])
    assert "prompt" not in log.columns and set(calls.select("system").distinct().toPandas()["system"]) == {expert.SYSTEM_JSON, expert.SYSTEM_TEXT}


def packets(spark, prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "k int, prompt string")


def test_errors_are_asked_again_and_equal_prompts_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    well = str(tmp_path / "well")

    class Moody:
        def answer(self, system, prompt):
            import os

            if prompt == "bad" and not os.path.exists(well):
                raise RuntimeError("no")
            return f"{system}/{prompt}"

    who = ledger.Ledger(spark, str(tmp_path / "ledger"), counting(Moody(), seen), slots=2, pause=0.0)
    given = packets(spark, ["x", "x", "bad", None, "y"])
    got = {r["k"]: (r["answer"], r["error"]) for r in who.ask(given, "S", "k").collect()}
    assert got == {0: ("S/x", None), 1: ("S/x", None), 2: (None, "RuntimeError: no"), 3: (None, None), 4: ("S/y", None)}
    assert len(calls_in(seen)) == 3
    (tmp_path / "well").write_text("")
    got = {r["k"]: (r["answer"], r["error"]) for r in who.ask(given, "S", "k").collect()}
    assert got[2] == ("S/bad", None) and len(calls_in(seen)) == 4
    assert who.ask(given, "other", "k").filter("answer = 'other/x'").count() == 2 and len(calls_in(seen)) == 7  # another system text is another question
    assert who.ask(packets(spark, []), "S", "k").count() == 0
    anew = ledger.Ledger(spark, str(tmp_path / "ledger"), counting(Moody(), seen), pause=0.0, again=True)
    assert anew.ask(packets(spark, ["x"]), "S", "k").first()["answer"] == "S/x" and len(calls_in(seen)) == 8
    assert who.calls().filter("kind = 'k'").count() == 8


def test_a_stopped_run_has_kept_its_waves(spark, tmp_path):
    """Waves are appended one by one, so what is asked before a failure is not asked again."""
    seen = tmp_path / "seen"
    seen.mkdir()

    class Plain:
        def answer(self, system, prompt):
            return prompt

    who = ledger.Ledger(spark, str(tmp_path / "ledger"), counting(Plain(), seen), slots=2, per_slot=5, pause=0.0)
    put, n = responder.ask, []

    def failing(*args):
        if len(n) == 2:
            raise RuntimeError("the cluster is gone")
        n.append(1)
        return put(*args)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(responder, "ask", failing)
        with pytest.raises(RuntimeError):
            who.ask(packets(spark, [f"p{i}" for i in range(50)]), "", "k")
    before = len(calls_in(seen))
    assert 0 < before < 50
    assert who.ask(packets(spark, [f"p{i}" for i in range(50)]), "", "k").filter("answer = prompt").count() == 50
    assert len(calls_in(seen)) == 50


def test_calls_keep_their_pace(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    class Plain:
        def answer(self, system, prompt):
            return prompt

    who = ledger.Ledger(spark, str(tmp_path / "ledger"), counting(Plain(), seen), slots=2, per_slot=100, pause=0.1)
    assert who.ask(packets(spark, [f"p{i}" for i in range(24)]), "", "k").filter("answer = prompt").count() == 24
    times = sorted(t for t, _ in calls_in(seen))
    for start in times:  # two slots of ten calls a second
        assert sum(start <= t < start + 0.5 for t in times) <= 2 * 6
    waits, now = [], [0.0]
    turn = responder.paced(1.0, lambda: now[0], waits.append)
    turn()
    now[0] = 0.25
    turn()
    now[0] = 5.0
    turn()
    assert waits == [0.75]


def test_prompts_without_a_system_message_after_a_refusal():
    asked = []

    class Picky:
        model = "m"

        def answer(self, system, prompt):
            asked.append((system, prompt))
            if system:
                raise RuntimeError("Error code: 403 - permission_denied")
            return prompt

    who = responder.Adaptive(Picky())
    assert who.answer("S", "p") == "S\n\np" and who.answer("S", "q") == "S\n\nq"
    assert asked == [("S", "p"), ("", "S\n\np"), ("", "S\n\nq")] and who.model == "m"

    class Wrong:
        def answer(self, system, prompt):
            raise ValueError("no such model")

    with pytest.raises(ValueError):
        responder.Adaptive(Wrong()).answer("S", "p")
