"""Column expressions for JSON that a model or a file gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.tokens import strip


def json_object(text: Column) -> Column:
    """The JSON object in a text, as canonical JSON text: the whole without code fences, or first { to last }. Null if there is none."""
    bare = strip(F.coalesce(text, F.lit("")))
    bare = F.when(bare.startswith("```"), strip(F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", ""))).otherwise(bare)
    first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    inner = F.when((first > 0) & (F.instr(bare, "}") > 0) & (last > first), F.substr(bare, first, last - first + 1))

    def object_of(s: Column) -> Column:
        v = F.try_parse_json(s)
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v))

    return F.coalesce(object_of(bare), object_of(inner))


def field(line: Column, name: str, kind: str) -> Column:
    """A field of a JSON line; null where the line or only this field is malformed."""
    return F.try_variant_get(F.try_parse_json(line), f"$.{name}", kind)


def is_object(line: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))
