"""A ledger of a model's answers: asked once, kept for good, and the log of every call.

A row is one call: what was asked (kind of step, system text, prompt), of whom (model, address,
limits), how it went and what came back. Rows are only ever appended. A prompt is known by the hashes
of its text (with its image) and of the system's text and by the model; of a prompt that has an answer none is asked
again, by any later step or run, so a run that failed goes on where it stopped and a run over changed
papers asks only what has changed. Errors are in the log, and are asked again.

Prompts go out in waves of at most ``slots * per_slot``, each appended when it is done, which bounds
what a lost executor or a stopped run has to ask again. A wave has ``slots`` partitions, so no more
calls run at once, and each keeps ``pause`` seconds between the starts of two calls.

Defined cases: a null prompt is not asked and has neither answer nor error; equal prompts of several
packets are asked once; a packet that has an answer has a null error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.functions import jsons
from siftmill.sources import responder as responders
from siftmill.sources import writers
from siftmill.sources.responder import ATTEMPTS, REPAIRS, Responder

SLOTS, PER_SLOT, PAUSE = 8, 64, 0.2
ROW = "kind string, prompt_sha256 string, system_sha256 string, model string, base_url string, max_tokens int, temperature double, system string, prompt string, answer string, error string, attempts int, started string, seconds double, system_chars int, prompt_chars int, answer_chars int, notes string"
NAMES = [c.split()[0] for c in ROW.split(", ")]


class Ledger:
    """Asks ``who`` through the ledger in ``folder``. ``again``: what earlier runs were told counts as unasked."""

    def __init__(self, spark: SparkSession, folder: str, who: Responder, slots: int = SLOTS, per_slot: int = PER_SLOT, pause: float = PAUSE, attempts: int = ATTEMPTS, again: bool = False):
        self.spark, self.folder, self.who = spark, folder, who
        self.slots, self.per_slot, self.pause, self.attempts = slots, per_slot, pause, attempts
        self.model = responders.name_of(who)
        self.since = self._last() if again else None

    def _last(self) -> str | None:
        return self.calls().agg(F.max("started")).first()[0]

    def calls(self) -> DataFrame:
        """Every call so far (see ROW)."""
        if not writers.has_cache(self.spark, self.folder):
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(self.folder)

    def _answers(self, system_sha256: Column, kind: str) -> DataFrame:
        """One row of each prompt asked: the first answer, else the last error. Only the folder of the kind is read."""
        own = self.calls().filter((F.col("kind") == kind) & (F.col("model") == self.model) & (F.col("system_sha256") == system_sha256))
        if self.since is not None:
            own = own.filter(F.col("started") > self.since)
        said = F.struct("answer", "error", "attempts", "started", "seconds", "answer_chars")
        first = F.min_by(F.when(F.col("answer").isNotNull(), said), F.when(F.col("answer").isNotNull(), F.col("started")))
        return own.groupBy("prompt_sha256").agg(F.coalesce(first, F.max_by(said, "started")).alias("said"))

    def ask(self, packets: DataFrame, system: str, kind: str) -> DataFrame:
        """packets (key columns, prompt) with answer and error; what the ledger lacks is asked and appended first."""
        system_sha256 = F.sha2(F.lit(system).cast("binary"), 256)
        image = ["image"] if "image" in packets.columns else []
        asked = F.col("prompt").cast("binary")
        asked = F.concat(asked, F.coalesce("image", F.lit(b""))) if image else asked
        hashed = packets.withColumn("prompt_sha256", F.sha2(asked, 256))
        answered = self._answers(system_sha256, kind).filter("said.answer IS NOT NULL").select("prompt_sha256")
        todo = hashed.filter("prompt IS NOT NULL").select("prompt_sha256", "prompt", *image).join(answered, "prompt_sha256", "left_anti").dropDuplicates(["prompt_sha256"])
        todo, n = self._waiting(todo, kind)
        waves = -(-n // (self.slots * self.per_slot))
        for wave in range(waves):
            own = todo.filter(F.pmod(F.xxhash64("prompt_sha256"), F.lit(waves)) == wave).repartition(self.slots, "prompt_sha256")
            made = responders.ask(own, self.who, system, self.attempts, self.pause)
            facts = {"kind": F.lit(kind), "system_sha256": system_sha256, "base_url": F.lit(getattr(self.who, "url", None)).cast("string"), "max_tokens": F.lit(getattr(self.who, "most_tokens", None)).cast("int"), "temperature": F.lit(getattr(self.who, "temperature", None)).cast("double"), "system": F.lit(system), "notes": F.when(F.col("attempts") > 1, F.concat(F.lit("retries: "), F.col("attempts") - 1))}
            made.withColumns(facts).select(*NAMES).write.mode("append").partitionBy("kind").parquet(self.folder)
        known = self._answers(system_sha256, kind).select("prompt_sha256", "said.answer", "said.error")
        return hashed.drop(*image).join(known, "prompt_sha256", "left").select(*(c for c in packets.columns if c != "image"), "answer", "error")

    def _waiting(self, todo: DataFrame, kind: str) -> tuple[DataFrame, int]:
        """The prompts to ask, written beside the ledger, so that the waves do not read what they append; and their number."""
        held = writers.holder(f"{self.folder.rstrip('/')}_waiting")(todo, kind)
        return held, held.count()

    def objects(self, packets: DataFrame, system: str, kind: str, repairs: int = REPAIRS) -> DataFrame:
        """packets with ``object``, the JSON object answered; an answer without one is asked to be repaired, up to so many times."""
        done = self.ask(packets, system, kind).withColumn("object", jsons.json_object(F.col("answer")))
        for _ in range(repairs - 1):
            if done.filter(F.col("object").isNull() & F.col("answer").isNotNull()).isEmpty():
                break
            repair = F.when(F.col("object").isNull() & F.col("answer").isNotNull(), F.concat(F.lit("Give this again as one valid JSON object:\n"), "answer"))
            asked = done.select(*(c for c in done.columns if c != "prompt"), F.col("prompt").alias("own_prompt"), repair.alias("prompt")).withColumnsRenamed({"answer": "had", "error": "had_error"})
            again = self.ask(asked, system, kind)
            mended = F.col("prompt").isNotNull()
            answer = F.when(mended, F.coalesce("answer", "had")).otherwise(F.col("had"))
            done = again.select(*(F.col("own_prompt").alias(c) if c == "prompt" else F.col(c) for c in packets.columns if c != "image"), answer.alias("answer"), F.when(mended, F.col("error")).otherwise(F.col("had_error")).alias("error"), F.coalesce("object", jsons.json_object(F.col("answer"))).alias("object"))
        return done


def log(calls: DataFrame) -> DataFrame:
    """The calls in the order they were begun, numbered within their kind, without the texts (those stay in the ledger)."""
    return calls.select("kind", "model", "base_url", "max_tokens", "temperature", "started", F.bround(F.col("seconds") * 1000, 0).cast("long").alias("duration_ms"), "attempts", "system_chars", "prompt_chars", "answer_chars", "error", "notes", "prompt_sha256", "system_sha256")
