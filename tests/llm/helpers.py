"""Small inputs that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(n, T.StringType()) for n in ("fp", "rank", "score", "label", "component_id", "kept_id", "votes", "length", "piece", "host", "k", "rid")),
])


def docs(spark, rows):
    """(doc_id, text) rows with the other columns of documents, and some whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, *["x"] * 12) for i, t in rows], DOCS)


LONG = "long words here. " * 12_000
ODD = [(None, "a null id of nine words is here too ok"), (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five"), (4, "one two three four five"), (5, "one two three four five"), (6, LONG), (7, "Ünïcode — 漢字 🙂 text"), (2, "another text with the same id")]
