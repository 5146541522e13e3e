"""Values in JSON by dotted paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def json_path(dotted: str) -> str:
    """``a.0.b`` as a JSON path: digits are positions, other segments keys; '' is the whole value."""
    out = "$"
    for s in dotted.split(".") if dotted else []:
        out += f"[{s}]" if s.isdigit() else "['" + s.replace("'", "\\'") + "']"
    return out


def dotted_value(text: Column | str, dotted: str) -> Column:
    """The value at a dotted path as text; null if a segment is missing or the text is no JSON."""
    return F.get_json_object(_col(text), json_path(dotted))


def dotted_items(text: Column | str, dotted: str) -> Column:
    """The array at a path as an array of JSON texts; null if there is none."""
    v = F.try_variant_get(F.try_parse_json(_col(text)), json_path(dotted), "array<variant>")
    return F.transform(v, lambda x: F.to_json(x))


def object_or_empty(text: Column | str) -> Column:
    """The object's text if it is one, else ``{}``."""
    t = F.trim(_col(text))
    ok = F.try_parse_json(t).isNotNull() & F.startswith(t, F.lit("{"))
    return F.when(ok, t).otherwise("{}")


def object_keys(text: Column | str, most: int = 40) -> Column:
    """The first keys of an object in order."""
    return F.slice(F.array_sort(F.json_object_keys(object_or_empty(text))), 1, most)


def byline_names(text: Column | str, dotted: str = "bylines") -> Column:
    """The names of an array's objects; entries that are no objects go."""
    items = F.coalesce(dotted_items(text, dotted), F.array().cast("array<string>"))
    return F.transform(F.filter(items, lambda x: F.startswith(x, F.lit("{"))), lambda x: F.get_json_object(x, "$.name"))
