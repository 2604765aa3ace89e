"""Optional PDF adapter: page texts, word boxes, table cells and metadata of PDFs.

It needs PyMuPDF (``fitz``) and pdfplumber on the executors; without them a query raises ImportError
with their names. Neither library is part of the environment this was built in: tests run the adapter on
modules that stand in for them, with the few calls that it makes.
"""

from __future__ import annotations

import importlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: How tables are looked for: by the words' alignment.
TABLE_SETTINGS = {
    "vertical_strategy": "text", "horizontal_strategy": "text", "min_words_vertical": 2, "min_words_horizontal": 1, "intersection_tolerance": 5,
    "snap_tolerance": 3, "join_tolerance": 3, "text_x_tolerance": 2, "text_y_tolerance": 2,
}


def need(name: str):
    """The module, or an ImportError that says what to install."""
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ImportError(f"the PDF adapter needs {name} on every executor") from e


def _each(name: str, rows):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module = need(name)
        for part in parts:
            for paper_id, content, *more in part.itertuples(index=False):
                made = list(rows(module, content, *more))
                if made:
                    yield pd.DataFrame(made).assign(paper_id=paper_id)

    return run


def pages(pdfs: DataFrame) -> DataFrame:
    """paper_id, page, text."""

    def rows(fitz, content):
        with fitz.open(stream=content, filetype="pdf") as doc:
            for i, page in enumerate(doc, 1):
                yield {"page": i, "text": page.get_text("text")}

    return pdfs.select("paper_id", "content").mapInPandas(_each("fitz", rows), "page int, text string, paper_id string")


def words(pdfs: DataFrame) -> DataFrame:
    """paper_id, page, box edges, text, block_no, line_in_block, word_no."""

    def rows(fitz, content):
        with fitz.open(stream=content, filetype="pdf") as doc:
            for i, page in enumerate(doc, 1):
                for x0, y0, x1, y1, text, block, line, word in page.get_text("words"):
                    yield {"page": i, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text, "block_no": block, "line_in_block": line, "word_no": word}

    schema = "page int, x0 double, y0 double, x1 double, y1 double, text string, block_no int, line_in_block int, word_no int, paper_id string"
    return pdfs.select("paper_id", "content").mapInPandas(_each("fitz", rows), schema)


def metadata(pdfs: DataFrame) -> DataFrame:
    """paper_id, title, author, subject, pages."""

    def rows(fitz, content):
        with fitz.open(stream=content, filetype="pdf") as doc:
            m = doc.metadata or {}
            yield {"title": m.get("title"), "author": m.get("author"), "subject": m.get("subject"), "pages": doc.page_count}

    return pdfs.select("paper_id", "content").mapInPandas(_each("fitz", rows), "title string, author string, subject string, pages int, paper_id string")


def cells(pdfs: DataFrame) -> DataFrame:
    """paper_id, page, table_index, row_index, col_index, cell_text, table_bbox, cell_bbox of the wanted pages (array ``wanted``)."""

    def rows(pdfplumber, content, wanted):
        with pdfplumber.open(io.BytesIO(content)) as doc:
            for number in wanted:
                if not 1 <= number <= len(doc.pages):
                    continue
                try:
                    tables = doc.pages[number - 1].find_tables(table_settings=TABLE_SETTINGS)
                except Exception:  # a page whose tables cannot be read has none
                    continue
                for t, table in enumerate(tables):
                    for r, (texts, row) in enumerate(zip(table.extract(), table.rows)):
                        for c, text in enumerate(texts):
                            box = row.cells[c] if c < len(row.cells) else None
                            yield {"page": number, "table_index": t, "row_index": r, "col_index": c, "cell_text": text, "table_bbox": list(table.bbox), "cell_bbox": list(box) if box else None}

    schema = "page int, table_index int, row_index int, col_index int, cell_text string, table_bbox array<double>, cell_bbox array<double>, paper_id string"
    return pdfs.select("paper_id", "content", "wanted").mapInPandas(_each("pdfplumber", rows), schema)


def renders(pdfs: DataFrame, zoom: float = 2.0, quality: int = 75) -> DataFrame:
    """paper_id, page, image (JPEG) of the regions asked for: ``regions`` is an array of (page, x0, y0, x1, y1), edges null for the whole page."""

    def rows(fitz, content, regions):
        with fitz.open(stream=content, filetype="pdf") as doc:
            for region in regions:
                number, *edges = region.values() if isinstance(region, dict) else region
                clip = fitz.Rect(*edges) if edges[0] is not None else None
                shown = doc.load_page(number - 1).get_pixmap(matrix=fitz.Matrix(zoom, zoom), alpha=False, clip=clip)
                yield {"page": number, "image": shown.tobytes("jpeg", jpg_quality=quality)}

    return pdfs.select("paper_id", "content", "regions").mapInPandas(_each("fitz", rows), "page int, image binary, paper_id string")
