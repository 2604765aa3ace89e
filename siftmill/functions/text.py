"""Column expressions for page text, captions, snippets and identifiers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill import fixed
from siftmill.functions.tokens import let, strip


def hits(text: Column, patterns: Iterable[str] | str) -> Column:
    """How often the patterns are found, all together."""
    out = F.lit(0)
    for p in [patterns] if isinstance(patterns, str) else patterns:
        out = out + F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p))
    return out


def digits(text: Column) -> Column:
    return hits(text, r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]")


def stars(text: Column) -> Column:
    return hits(text, r"\*")


def p_values(text: Column) -> Column:
    """All p-values written in a text, pattern after pattern, that are within 0 and 1."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in fixed.P_VALUE_PATTERNS)))
    return F.filter(F.transform(found, lambda v: v.cast("double")), lambda v: v.between(0.0, 1.0))


def p_values_across(before: Column, after: Column) -> Column:
    """The p-values that begin in one text and end in the next: found in both together, but in neither of them."""

    def of(pattern: str) -> Column:
        found = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
        both = found(F.concat(before, after))
        own = lambda x: let(F.size(found(before)), lambda n: F.slice(x, n + 1, F.greatest(F.lit(0), F.size(x) - n - F.size(found(after)))))
        return let(both, lambda x: F.when(F.size(x) > 0, own(x)).otherwise(F.array().cast("array<string>")))

    values = F.transform(F.flatten(F.array(*map(of, fixed.P_VALUE_PATTERNS))), lambda v: v.cast("double"))
    return F.filter(values, lambda v: v.between(0.0, 1.0))


def hits_across(before: Column, after: Column, patterns: Iterable[str] | str) -> Column:
    """How many more hits two texts have together than each by itself; most have none, and are read once."""
    return let(hits(F.concat(before, after), patterns), lambda n: F.when(n > 0, n - hits(before, patterns) - hits(after, patterns)).otherwise(0))


def p_sample(values: Column, most: int = 30) -> Column:
    """The least p-values of an array, ascending."""
    return F.slice(F.array_sort(values), 1, most)


def reference_page(text: Column) -> Column:
    """Whether a page looks like a list of references."""

    def looks(t: Column) -> Column:
        head = F.lower(F.substring(t, 1, 800))
        years, links = hits(t, fixed.PAREN_YEAR), hits(t, fixed.LINK)
        return (F.length(t) > 0) & (head.rlike(fixed.REFERENCE_HEADER) | (head.rlike(fixed.REFERENCE_WORD) & ((years >= 12) | (links >= 3))) | ((years >= 25) & (links >= 2)))

    return let(strip(F.coalesce(text, F.lit(""))), looks)


def paren_mode_of(t: Column, se: Column) -> Column:
    """t or se, whichever is said more often to be in parentheses; null if neither."""
    return F.when(t > se, "t").when(se > t, "se")


def lines(text: Column) -> Column:
    """The lines of a text that are not blank, trimmed."""
    split = F.split(F.coalesce(text, F.lit("")), "\\r\\n|[\\n\\x0b\\f\\r\\x1c-\\x1e\\x85\\u2028\\u2029]")
    return F.filter(F.transform(split, strip), lambda x: F.length(x) > 0)


def head(text: Column) -> Column:
    """The first six lines that are not blank, at most 600 characters."""
    return F.substring(F.array_join(F.slice(lines(text), 1, 6), "\n"), 1, 600)


def caption(text: Column, kind: str) -> Column:
    """The first caption line of a page ("Table 3. What it shows"), null if none."""
    pattern = fixed.CAPTION % kind
    spaced = F.transform(F.slice(lines(text), 1, fixed.CAPTION_LINES[kind]), lambda x: F.regexp_replace(x, r"(?U)\s+", " "))
    named = lambda x: strip(F.concat(F.lit(kind.title() + " "), F.regexp_extract(x, pattern, 1), F.lit(". "), F.regexp_extract(x, pattern, 2)))
    return let(F.get(F.filter(spaced, lambda x: x.rlike(pattern)), F.lit(0)), named)


def panel(text: Column, kind: str) -> Column:
    """Whether a page's first lines go on with panel A, B or C."""
    return F.lower(F.array_join(F.slice(lines(text), 1, fixed.PANEL_LINES[kind]), " ")).rlike("panel [abc]")


def artifact_id(caption_: Column, kind: str) -> Column:
    """The id that a caption begins with ("Table A3b"), else its first sentence, else its beginning."""
    c = strip(F.coalesce(caption_, F.lit("")))
    number = F.regexp_extract(c, fixed.ARTIFACT_ID % kind, 1)
    first = strip(F.split_part(c, F.lit("."), F.lit(1)))
    return (
        F.when(F.length(number) > 0, F.concat(F.lit(kind.title() + " "), number))
        .when(F.length(first) > 0, first)
        .when(F.length(c) > 0, F.substring(c, 1, 32))
        .otherwise(F.lit(f"{kind.title()} (unknown)"))
    )


def clean_snippet(s: Column, most: int = 220) -> Column:
    """White space made single; longer than ``most`` characters, cut with an ellipsis."""
    t = strip(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, max(0, most - 1)), r"(?U)\s+$", ""), F.lit("…")))


def page_excerpt(s: Column, most: int) -> Column:
    """A page's text with at most one blank line at a time, cut as ``clean_snippet`` cuts."""
    t = F.regexp_replace(strip(F.coalesce(s, F.lit(""))), "\n{3,}", "\n\n")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, max(0, most - 1)), r"(?U)\s+$", ""), F.lit("…")))


def markdown_cell(s: Column) -> Column:
    return F.replace(strip(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))


def contains_form(s: Column) -> Column:
    """The form in which texts are looked up in others."""
    return F.lower(strip(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " ")))


def slug(s: Column, most: int = 80) -> Column:
    """A name for files: other characters than letters, digits, _, - and . become single underscores."""
    t = F.regexp_replace(strip(F.coalesce(s, F.lit(""))), r"(?U)\s+|[^\w\-. ]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_|_$", "")
    return F.when(F.length(t) > 0, F.regexp_replace(F.substring(t, 1, most), "_+$", "")).otherwise(F.lit("paper"))


def cache_key(max_pages: Column, max_pdf_pages: Column) -> Column:
    return F.concat(F.lit("mp"), F.greatest(F.lit(1), max_pages.cast("int")).cast("string"), F.lit("_pdfp"), F.coalesce(max_pdf_pages.cast("int").cast("string"), F.lit("None")))


def file_hash(content: Column, first: int | None = 5_000_000) -> Column:
    """SHA-256 of the first bytes of a binary column."""
    return F.sha2(F.substring(content, 1, first) if first is not None else content, 256)


def now() -> Column:
    """The time of the query as text; never compared."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def masked_key(key: Column) -> Column:
    """A secret of which only the last four characters can be read."""
    return F.regexp_replace(F.coalesce(key, F.lit("")), ".(?=.{4})", "*")


def anchor(page: Column, table_index: Column, coef: Column, paren: Column, t: Column, p: Column) -> Column:
    """Where a test is found, as text: p.3 · Table#1 · coef=… · paren=… · |t|≈2.01 · p≈0.0444."""
    filled = lambda c: F.when(F.length(strip(F.coalesce(c, F.lit("")))) > 0, strip(c))
    known = lambda c: F.when(c.isNotNull() & ~F.isnan(c), c)
    shown = _shown(F.abs(known(t)), known(p))
    bits = F.concat_ws(
        " · ",
        F.concat(F.lit("p."), page.cast("string")),
        F.concat(F.lit("Table#"), (table_index + 1).cast("string")),
        F.concat(F.lit("coef="), filled(coef)),
        F.concat(F.lit("paren="), filled(paren)),
        F.concat(F.lit("|t|≈"), shown["t"]),
        F.concat(F.lit("p≈"), shown["p"]),
    )
    return F.when(F.length(bits) > 0, bits).otherwise(F.lit("(unavailable)"))


@F.pandas_udf(T.StructType([T.StructField("t", T.StringType()), T.StructField("p", T.StringType())]))
def _shown(t: pd.Series, p: pd.Series) -> pd.DataFrame:
    """Both numbers as text, half to even on their exact values as no JVM format has it; whole columns at a time."""

    def column(x: pd.Series, form: str) -> pd.Series:
        return pd.Series(np.char.mod(form, x.to_numpy(np.float64, na_value=np.nan)), dtype=object).where(x.notna().to_numpy(), None)

    return pd.DataFrame({"t": column(t, "%.2f"), "p": column(p, "%.3g")})


def _around(text: Column, pattern: Column, around: int, cut: int, most: int) -> Column:
    """What stands around the hits of a pattern, each hit by itself, also where these parts overlap: the first ``most`` that differ in more than their case."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))

    def one(sofar: Column, piece: Column) -> Column:
        at = sofar["at"] + F.length(piece["before"])
        first = F.greatest(F.lit(0), at - around)
        end = at + F.length(piece["hit"])
        shown = clean_snippet(F.substring(text, first + 1, end + around - first), cut)
        more = let(shown, lambda s: F.when((F.length(s) == 0) | F.exists(sofar["out"], lambda x: F.lower(x) == F.lower(s)), sofar["out"]).otherwise(F.concat(sofar["out"], F.array(s))))
        return F.struct(end.alias("at"), F.when(F.size(sofar["out"]) >= most, sofar["out"]).otherwise(more).alias("out"))

    pieces = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, h: F.struct(b.alias("before"), h.alias("hit")))
    none = F.array().cast("array<string>")
    every = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), one, lambda done: done["out"])
    return F.when(F.regexp_like(text, pattern), every).otherwise(none)


def named(text: Column, around: int, cut: int) -> Column:
    """Array of (name, k, snippet): every name of a table or figure in a text, by one pattern, in lower case, with what stands around it."""

    def shown(t: Column, names: Column, sizes: Column) -> Column:
        def one(name: Column, k: Column) -> Column:
            at = F.aggregate(F.slice(sizes, F.lit(1), k + 1), F.lit(0), lambda a, n: a + n)
            first = F.greatest(F.lit(0), at - around)
            return F.struct(F.lower(name).alias("name"), k.alias("k"), clean_snippet(F.substring(t, first + 1, at + F.length(name) + around - first), cut).alias("snippet"))

        return F.transform(names, one)

    def of(t: Column) -> Column:
        # the pattern has no width: the parts between are the whole text, and none stands before a name at its very beginning
        lengths = lambda names: let(F.transform(F.split(t, fixed.NAMED, -1), F.length), lambda parts: F.when(F.size(parts) == F.size(names), F.concat(F.array(F.lit(0)), parts)).otherwise(parts))
        found = let(F.regexp_extract_all(t, F.lit(fixed.NAMED), F.lit(1)), lambda names: F.when(F.size(names) > 0, let(lengths(names), lambda sizes: shown(t, names, sizes))))
        return F.when(t.rlike("(?i)table|figure"), found)

    return let(F.coalesce(text, F.lit("")), of)


def snippets(text: Column, patterns: "Iterable[str] | Iterable[Column]", most: int = 6, around: int = 80, cut: int = 220) -> Column:
    """Hits of the patterns with ``around`` characters on either side, pattern after pattern, each text once (whatever its case)."""

    def of(t: Column) -> Column:
        every = F.concat(*(_around(t, F.lit(p) if isinstance(p, str) else p, around, cut, most) for p in patterns))
        return let(every, lambda all_: let(F.transform(all_, F.lower), lambda low: F.filter(all_, lambda s, k: F.array_position(low, F.lower(s)) == k + 1)))

    return F.slice(let(F.coalesce(text, F.lit("")), of), 1, most)
