"""Chat formatting after collapsing cumulative snapshots.

A conversation logged again after each turn appears many times, each log a prefix of the next. The
rolling hash of a turn prefix is the exclusive or of 64-bit hashes of (position, role, text), taken
twice with different salts (128 bits). A conversation whose whole hash is the hash of a proper turn
prefix of another is a snapshot: an anti-join drops it. Of equal conversations the least conv_id
stays. The rest are rendered, one row each. Column expressions only.

What is decided is decided on hashes alone, which are written once; texts are moved once, and only
those of the conversations that stay.

Skew: prefixes and whole conversations are made distinct (with map-side partial results) before
they meet, so a first turn or a conversation with any number of copies is one row there. A single
conversation is one output value, and is held as one.

Defined cases: turns are ordered by turn, then role, then text (nulls first); rows that are equal in
all four columns are turns each, as often as they are logged; a null text renders as empty and a null
role as ``unknown`` but both differ from the empty string when compared; a null conv_id is one
conversation; texts of any length are rendered whole; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.shared import Shelf

#: How a turn is rendered.
TURN = "<|im_start|>%s\n%s<|im_end|>\n"


def _content_hash(salt: int) -> Column:
    role, text = F.col("role"), F.col("text")
    return F.xxhash64(F.lit(salt), role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit("")))


def _keyed(turns: DataFrame) -> DataFrame:
    """turn, role, text with the conversation as (cid, lost): one key for each conv_id and one for null, so that joins need no null-safe rule."""
    return turns.select(F.coalesce("conv_id", F.lit(0).cast(turns.schema["conv_id"].dataType)).alias("cid"), F.col("conv_id").isNull().alias("lost"), "turn", "role", "text")


def prefix_hashes(turns: DataFrame, shelf: Shelf) -> DataFrame:
    """cid, lost, pos (from 1), n (turns of the conversation), h1, h2: the hash of turns 1 to pos.

    Texts only matter for the order of turns that tie in number and role: just those are moved.
    """
    conv = ["cid", "lost"]
    tie = [*conv, "turn", "no_turn", "role", "no_role"]

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("no_turn", F.col("turn").isNull()).withColumn("no_role", F.col("role").isNull())

    keyed = marked(_keyed(turns))
    plain = keyed.select(*tie, _content_hash(1).alias("c1"), _content_hash(2).alias("c2"))
    bare = [F.coalesce("turn", F.lit(0).cast(turns.schema["turn"].dataType)).alias("turn"), F.coalesce("role", F.lit("")).alias("role")]
    filled = plain.select(*conv, bare[0], "no_turn", bare[1], "no_role", "c1", "c2")
    tied = shelf.put(filled.groupBy(*tie).agg(F.min("c1").alias("low"), F.max("c1").alias("high")).filter("low <> high").select(*tie))
    with_text = keyed.select(*conv, bare[0], "no_turn", bare[1], "no_role", _content_hash(1).alias("c1"), "text")
    order = shelf.put(with_text.join(tied, tie, "left_semi").groupBy(*tie, "c1").agg(F.min("text").alias("text")))
    rows = filled.join(order, [*tie, "c1"], "left")
    ordered = Window.partitionBy(*conv).orderBy(F.desc("no_turn"), "turn", F.desc("no_role"), "role", "text", "c1")
    rolling = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*conv)
    placed = rows.withColumn("pos", F.row_number().over(ordered))
    return shelf.put(placed.select(
        *conv, "pos",
        F.count("*").over(whole).alias("n"),
        F.bit_xor(F.xxhash64("pos", "c1")).over(rolling).alias("h1"),
        F.bit_xor(F.xxhash64("pos", "c2")).over(rolling).alias("h2"),
    ))


def maximal(hashed: DataFrame) -> DataFrame:
    """cid, lost of the conversations that no other one continues or, with a lesser id (null comes last), repeats."""
    whole = hashed.filter("pos = n").groupBy("pos", "h1", "h2").agg(F.min(F.struct("lost", "cid")).alias("id"))
    parts = hashed.filter("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(parts, ["pos", "h1", "h2"], "left_anti").select("id.cid", "id.lost")


def render(turns: DataFrame, turn_format: str = TURN) -> DataFrame:
    """conv_id, n_turns, text, n_chars of the maximal conversations."""
    shelf = Shelf(turns.sparkSession, "chat")
    kept = _keyed(turns).join(shelf.put(maximal(prefix_hashes(turns, shelf))), ["cid", "lost"], "left_semi")
    piece = F.format_string(turn_format, F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", piece.alias("piece")))), lambda x: x["piece"])
    rendered = kept.groupBy("cid", "lost").agg(F.count("*").alias("n_turns"), F.array_join(lines, "").alias("text"))
    return rendered.select(F.when(~F.col("lost"), F.col("cid")).alias("conv_id"), "n_turns", "text", F.length("text").cast("long").alias("n_chars"))


SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns, count(*) AS n_turns,
             string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, text, length(text) AS n_chars FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND a.conv_id <> b.conv_id
                  AND (b.n_turns > a.n_turns OR (b.n_turns = a.n_turns AND b.conv_id < a.conv_id))
                  AND b.turns[1:a.n_turns] = a.turns)
"""
