"""Column expressions for table cells: normal form, numbers, parentheses, labels, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill import fixed
from siftmill.functions.stats import year_like


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it (a chain of replacements must not be copied into each use)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(s: Column) -> Column:
    """Without white space at its ends (Unicode's)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def numeric_ratio(s: Column) -> Column:
    """Share of digits and numeric marks among the characters that are not white space; 0 without any."""

    def share(dense: Column) -> Column:
        numeric = F.length(dense) - F.length(F.regexp_replace(dense, fixed.NUMERIC_CHARS, ""))
        return F.when(F.length(dense) > 0, numeric / F.length(dense)).otherwise(F.lit(0.0))

    return let(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", ""), share)


#: Fixed values, applied in this order.
TIGHTEN = (
    (r"(?U)(?<=\d),(?=\d{3}\b)", ""),
    (r"(?U)(?<=\d)\s+(?=[\.,])", ""),
    (r"(?U)(?<=[\.,])\s+(?=\d)", ""),
    (r"(?U)(?<=[+-])\s+(?=\d)", ""),
    (r"(?U)(?<=\d)\s+(?=\*)", ""),
    (r"(?U)(?<=\*)\s+(?=\*)", ""),
    (r"(?U)\(\s+", "("),
    (r"(?U)\s+\)", ")"),
)
#: Every pattern of TIGHTEN but the first takes white space beside one of these marks.
LOOSE = r"(?U)[.,+\-(]\s|\s[.,*)]"


def normal_cell(s: Column) -> Column:
    """A cell's text with plain minus signs and points and without stray spaces in numbers."""

    def plain(c: Column) -> Column:
        return F.translate(c, "−–—‑·∙•", "----...")

    def tight(c: Column) -> Column:
        def marks(t: Column) -> Column:
            for pattern, by in TIGHTEN[1:]:
                t = F.regexp_replace(t, pattern, by)
            return t

        t = let(F.regexp_replace(plain(strip(c)), *TIGHTEN[0]), lambda x: F.when(x.rlike(LOOSE), marks(x)).otherwise(x))
        t = let(t, lambda x: F.when(x.rlike(r"(?U)\d\s+\d") & (numeric_ratio(x) >= 0.9), F.regexp_replace(x, r"(?U)(?<=\d)\s+(?=\d)", "")).otherwise(x))
        return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))

    # each replacement takes white space or a comma: without either there is nothing to do
    return let(F.coalesce(s, F.lit("")), lambda c: F.when(c.rlike(r"(?U)[\s,]"), tight(c)).otherwise(plain(c)))


def numeric_tokens(normal: Column) -> Column:
    """Array of (raw, value, stars) of the numbers in a normal cell."""
    found = F.regexp_extract_all(normal, F.lit(fixed.NUMERIC_TOKEN), F.lit(0))

    def parts(raw: Column) -> Column:
        number = F.rtrim(raw, F.lit("*"))  # marks stand at a token's end only
        return F.struct(raw.alias("raw"), number.cast("double").alias("value"), (F.length(raw) - F.length(number)).alias("stars"))

    return F.transform(found, parts)


def paren_tokens(normal: Column) -> Column:
    """Array of the numbers in parentheses of a normal cell, without years; a minus before them counts."""

    def numbers(t: Column) -> Column:
        found = F.arrays_zip(*(F.regexp_extract_all(t, F.lit(fixed.PAREN_NUMBER), F.lit(g)).alias(n) for g, n in ((1, "sign"), (2, "number"))))
        signed = F.transform(found, lambda x: F.when((x["sign"] == "-") & ~x["number"].rlike(r"^[+-]"), -x["number"].cast("double")).otherwise(x["number"].cast("double")))
        return F.filter(signed, lambda v: ~year_like(v))

    return let(normal, lambda t: F.when(t.contains("("), numbers(t)).when(t.isNotNull(), F.array().cast("array<double>")))


def first_paren(normal: Column) -> Column:
    return F.get(paren_tokens(normal), F.lit(0))


def first_coefficient(normal: Column) -> Column:
    """(raw, value, stars) of the first number outside parentheses, a starred one before others; null for label cells."""
    outside = F.when(normal.contains("("), F.regexp_replace(F.regexp_replace(normal, r"\([^)]*\)", " "), fixed.DANGLING_PAREN, " ")).otherwise(normal)
    chosen = let(numeric_tokens(normal_cell(outside)), lambda found: F.coalesce(F.get(F.filter(found, lambda x: x["stars"] > 0), F.lit(0)), F.get(found, F.lit(0))))
    return F.when(~normal.rlike(fixed.LABEL_ONLY_CELL), chosen)


def citation_like(s: Column) -> Column:
    """Whether a cell looks like a part of a citation."""

    def any_of(t: Column) -> Column:
        out = F.lit(False)
        for pattern in fixed.CITATION_PATTERNS:
            out = out | t.rlike(pattern)
        return out

    return let(strip(F.coalesce(s, F.lit(""))), any_of)


def label_pair(cell: Column, paren_cell: Column, coef_raw: Column, stars: Column) -> Column:
    """Whether a pair is a column label such as "8) (9)" taken for a coefficient."""
    cell, paren_cell, raw = (strip(F.coalesce(c, F.lit(""))) for c in (cell, paren_cell, coef_raw))
    bare = raw.rlike(r"^\d+$") & paren_cell.rlike(fixed.PAREN_ONLY_CELL) & F.regexp_like(cell, F.concat(F.lit(r"\b"), raw, F.lit(r"\)")))  # the pattern of the row itself comes last
    return (F.coalesce(stars, F.lit(0)) == 0) & (cell.rlike(fixed.LABEL_PAIR_CELL) | bare)


def usable(normal: Column) -> Column:
    """Whether a normal cell is numeric enough and no citation."""
    return (numeric_ratio(normal) >= 0.60) & ~citation_like(normal)
