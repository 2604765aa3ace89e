"""Readers of a corpus: PDFs as files, extracted tables, tests, features, id lists, notes, sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions import jsons, text
from siftmill.functions.tokens import strip

BOX = T.ArrayType(T.DoubleType())
PAGES = T.StructType([T.StructField("paper_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
CELLS = T.StructType([
    T.StructField("paper_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("table_index", T.IntegerType()), T.StructField("row_index", T.IntegerType()),
    T.StructField("col_index", T.IntegerType()), T.StructField("cell_text", T.StringType()), T.StructField("table_bbox", BOX), T.StructField("cell_bbox", BOX),
])
IMAGES = T.StructType([T.StructField("paper_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("image", T.BinaryType())])
#: Fields of a line of tests, by the type that they are read as.
TESTS = {
    "paper_id": "string", "page": "int", "table_index": "int", "table_bbox": "array<double>", "row_index": "int", "col_index": "int", "coef_raw": "string",
    "coef": "double", "paren": "double", "paren_source": "string", "stars": "int", "coef_cell_bbox": "array<double>", "se_cell_bbox": "array<double>",
    "cell_text_snippet": "string", "se_cell_text_snippet": "string", "extractor_version": "string", "paren_mode_assumed": "string", "t_mode": "string",
    "se": "double", "t": "double", "abs_t": "double", "p_approx_2s": "double",
}


def pdfs(spark: SparkSession, corpus: str, pattern: str | None = None, ids: DataFrame | None = None, first: int | None = None, hash_bytes: int | None = 5_000_000) -> DataFrame:
    """paper_id, path, sha256, content of the PDFs of a corpus.

    pattern: a search in the paper's id; ids: only these paper_id; first: only so many, by path. They are
    chosen by the listing alone; only the files chosen are read. Without a PDF it raises ValueError.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(f"{corpus}/pdfs").select("path")
    if listed.isEmpty():
        raise ValueError(f"no PDF in {corpus}/pdfs")
    own = F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("paper_id")
    if ids is None and not pattern and first is None:
        chosen = [f"{corpus}/pdfs"]
    else:
        named = listed.select(own, "path")
        named = named.join(ids, "paper_id", "left_semi") if ids is not None else named
        named = named.filter(F.col("paper_id").rlike(pattern)) if pattern else named
        named = named.orderBy("path").limit(first) if first is not None else named
        chosen = [r["path"] for r in named.select("path").collect()]  # no more than the listing that the driver has made
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf")
    found = whole.load(chosen) if chosen else whole.load(f"{corpus}/pdfs").limit(0)
    return found.select(own, "path", text.file_hash(F.col("content"), hash_bytes).alias("sha256"), "content")


def tests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of tests. Blank and malformed lines and such as are no objects are passed over; a malformed field alone is null.

    Where a folder names the paper (``writers.tests_json``), its name is the paper's id.
    """
    lines = spark.read.text(path).filter(F.length(strip(F.col("value"))) > 0).filter(jsons.is_object(F.col("value")))
    made = {name: jsons.field(F.col("value"), name, kind) for name, kind in TESTS.items()}
    if "paper_id" in lines.columns:
        made["paper_id"] = F.coalesce(F.col("paper_id").cast("string"), made["paper_id"])
    return lines.select(*(c.alias(name) for name, c in made.items()))


def features(spark: SparkSession, path: str) -> DataFrame:
    """The feature table as text columns, with its file order in ``line``: the file, then the place in it, however Spark packs files into tasks."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')  # of such files none is split
    return rows.withColumn("line", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))


def sidecars(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object a file; a file that cannot be parsed has nulls."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """paper_id: the lines of a list, without blank lines and comments, each once."""
    line = strip(F.col("value"))
    return spark.read.text(path).select(line.alias("paper_id")).filter((F.length("paper_id") > 0) & ~F.col("paper_id").startswith("#")).distinct()


def notes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path), text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Extracted page texts (Parquet)."""
    return spark.read.schema(PAGES).parquet(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Page images (Parquet)."""
    return spark.read.schema(IMAGES).parquet(path)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Extracted table cells (Parquet)."""
    return spark.read.schema(CELLS).parquet(path)


def settings(spark: SparkSession, required: tuple[str, ...] = ("base_url", "model", "api_key")) -> dict[str, str]:
    """The endpoint's settings, from spark.siftmill.*; ValueError names what is missing."""
    found = {name: spark.conf.get(f"spark.siftmill.{name}", "") for name in required}
    if lacking := [name for name, value in found.items() if not value.strip()]:
        raise ValueError("missing settings: " + ", ".join(f"spark.siftmill.{name}" for name in lacking))
    return found
