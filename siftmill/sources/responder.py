"""Optional language-model plug-in: who answers prompts, with retries and repair of JSON answers.

The engine runs without one (``Offline``): pages are then chosen by score, evidence comes from the
text, and metrics from audits that exist. A responder is called on the executors, once for each row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.functions import jsons
from siftmill.functions.stats import retry_delay

ATTEMPTS, REPAIRS = 10, 4
#: Parts of messages of errors that pass.
BLOCKED_STATUS = ("error code: 403", " status=403")
BLOCKED_REASON = ("validation_required", "verify your account", "permission_denied", "request was blocked")
PASSING = ("your request was blocked", "empty response content")


class Responder(Protocol):
    """Answers a prompt; one that can see takes an image (JPEG or PNG) as a third argument."""

    def answer(self, system: str, prompt: str) -> str: ...


class Offline:
    """Answers nothing."""

    def answer(self, system: str, prompt: str) -> str:
        raise RuntimeError("no model: the engine is offline")


class Endpoint:
    """A responder over HTTP, for servers that take {model, messages} and answer {choices: [{message: {content}}]}."""

    temperature = 0.0

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 180.0, most_tokens: int = 3500):
        self.url, self.model, self.key, self.timeout, self.most_tokens = url, model, key, timeout, most_tokens

    def answer(self, system: str, prompt: str, image: bytes | None = None) -> str:
        messages = [{"role": "system", "content": system}] if system else []
        said = prompt
        if image is not None:
            kind = "png" if image.startswith(b"\x89PNG") else "jpeg"
            said = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:image/{kind};base64,{base64.b64encode(image).decode()}"}}]
        body = {"model": self.model, "messages": [*messages, {"role": "user", "content": said}], "temperature": self.temperature, "max_tokens": self.most_tokens}
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                said = json.load(reply)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"Error code: {e.code} - {e.read(2000).decode('utf-8', 'replace')}") from None
        content = said["choices"][0]["message"].get("content")
        if not content:
            raise RuntimeError("empty response content")
        return content


class Joined:
    """A responder for endpoints that take no system message: it becomes the beginning of the prompt."""

    def __init__(self, inner: Responder):
        self.inner = inner

    def answer(self, system: str, prompt: str, *image: bytes) -> str:
        return self.inner.answer("", f"{system}\n\n{prompt}" if system else prompt, *image)


class Adaptive:
    """Asks with a system message until an answer is refused for it, and from then on in this worker without one."""

    def __init__(self, inner: Responder):
        self.inner, self.joined = inner, Joined(inner)
        self.url, self.model, self.most_tokens, self.temperature = (getattr(inner, n, None) for n in ("url", "model", "most_tokens", "temperature"))
        self.model = self.model or type(inner).__name__
        self.only_prompts = False

    def answer(self, system: str, prompt: str, *image: bytes) -> str:
        if self.only_prompts or not system:
            return self.joined.answer(system, prompt, *image)
        try:
            return self.inner.answer(system, prompt, *image)
        except Exception as e:
            if not passing(e):
                raise
            self.only_prompts = True
            return self.joined.answer(system, prompt, *image)


def name_of(responder: Responder) -> str:
    return getattr(responder, "model", None) or type(responder).__name__


def passing(error: BaseException) -> bool:
    """Whether an error is one that may be gone at the next attempt."""
    said = str(error).lower()
    blocked = any(s in said for s in BLOCKED_STATUS) and any(s in said for s in BLOCKED_REASON)
    return blocked or any(s in said for s in PASSING)


def persistent(responder: Responder, system: str, prompt: str, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep, image: bytes | None = None) -> str:
    """The answer, asked for again while errors pass; where an image is refused, without it."""
    for attempt in range(1, attempts + 1):
        try:
            return responder.answer(system, prompt, image) if image is not None else responder.answer(system, prompt)
        except Exception as e:
            if image is not None and not passing(e):
                image = None
                continue
            if attempt == attempts or not passing(e):
                raise
            wait(retry_delay(attempt))
    raise AssertionError


Hold = Callable[[DataFrame, str], DataFrame]


def as_it_is(frame: DataFrame, name: str) -> DataFrame:
    """Holds nothing: right where a frame is read once, or its answers are sure to be the same."""
    return frame


#: What is known of each call; with the packets' own columns it is the log.
CALL = "answer string, error string, attempts int, started string, seconds double, model string, system_chars int, prompt_chars int, answer_chars int, prompt_sha256 string"


def paced(pause: float, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Callable[[], None]:
    """To be called before each call: waits until ``pause`` seconds are over since the last one began."""
    free = [float("-inf")]

    def turn() -> None:
        now = clock()
        if now < free[0]:
            wait(free[0] - now)
        free[0] = max(now, free[0]) + pause

    return turn


def ask(packets: DataFrame, responder: Responder, system: str, attempts: int = ATTEMPTS, pause: float = 0.0) -> DataFrame:
    """packets (key columns, prompt, perhaps image) with the columns of CALL, without the image: also the log of the calls. No key is ever in it.

    ``pause``: seconds between calls of a task. A prompt_sha256 that packets have is kept.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = paced(pause)
        for part in parts:
            rows = []
            images = part["image"] if "image" in part else [None] * len(part)
            known = part["prompt_sha256"] if "prompt_sha256" in part else [None] * len(part)
            for prompt, image, sha256 in zip(part["prompt"], images, known):
                waits: list[float] = []

                def wait(seconds: float, waits: list[float] = waits) -> None:
                    waits.append(seconds)
                    time.sleep(seconds)

                turn()
                began, started = time.monotonic(), datetime.now(timezone.utc).isoformat(timespec="microseconds")
                try:
                    answer, error = persistent(responder, system, prompt, attempts, wait, None if image is None else bytes(image)), None
                except Exception as e:
                    answer, error = None, f"{type(e).__name__}: {e}"[:500]
                rows.append((answer, error, len(waits) + 1, started, time.monotonic() - began, name_of(responder), len(system), len(prompt), len(answer or ""), sha256 or hashlib.sha256(prompt.encode()).hexdigest()))
            yield part.drop(columns=["prompt_sha256", "image"], errors="ignore").reset_index(drop=True).join(pd.DataFrame(rows, columns=[c.split()[0] for c in CALL.split(", ")]))

    fields = ", ".join(f"`{c}` {kind}" for c, kind in packets.dtypes if c not in ("prompt_sha256", "image"))
    return packets.mapInPandas(run, f"{fields}, {CALL}")


class Direct:
    """Asks a responder for every packet, and holds the answers; ``Ledger`` keeps them from one run to the next."""

    def __init__(self, who: Responder, hold: "Hold"):
        self.who, self.hold = who, hold

    def ask(self, packets: DataFrame, system: str, kind: str) -> DataFrame:
        return self.hold(ask(packets, self.who, system), kind)

    def objects(self, packets: DataFrame, system: str, kind: str, repairs: int = REPAIRS) -> DataFrame:
        return objects(packets, self.who, system, repairs, lambda df, name: self.hold(df, f"{kind}_{name}"))


def objects(packets: DataFrame, responder: Responder, system: str, repairs: int = REPAIRS, hold: Hold = as_it_is) -> DataFrame:
    """packets with ``object``: the JSON object answered. An answer without one is asked to be repaired, up to so many times.

    Answers are held after each round, so that none is asked for again by a later step.
    """
    columns = [c for c in packets.columns if c != "image"]
    done = hold(ask(packets, responder, system).withColumn("object", jsons.json_object(F.col("answer"))), "0")
    for k in range(repairs - 1):
        todo = done.filter(F.col("object").isNull() & F.col("answer").isNotNull())
        again = todo.select(*columns, F.col("answer").alias("bad")).withColumn("asked", F.col("prompt")).withColumn("prompt", F.concat(F.lit("Give this again as one valid JSON object:\n"), F.col("bad"))).drop("bad")
        mended = ask(again, responder, system).withColumn("object", jsons.json_object(F.col("answer"))).withColumn("prompt", F.col("asked")).drop("asked")
        done = hold(done.filter(F.col("object").isNotNull() | F.col("answer").isNull()).unionByName(mended), str(k + 1))
    return done


def page_chunks(pages: DataFrame, size: int = 8, most_chars: int = 3200) -> DataFrame:
    """paper_id, chunk, prompt: consecutive pages of a paper, ``size`` at a time, each with its beginning."""
    cut = pages.select("paper_id", ((F.col("page") - 1) / size).cast("int").alias("chunk"), "page", F.substring("text", 1, most_chars).alias("text"))
    return cut.groupBy("paper_id", "chunk").agg(F.to_json(F.sort_array(F.collect_list(F.struct("page", "text")))).alias("prompt"))
