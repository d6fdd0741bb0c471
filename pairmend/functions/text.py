"""Column functions on text and JSON attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour names, in the order in which they are looked for.
BASIC_COLORS = ("black", "white", "gray", "red", "green", "blue", "yellow", "orange", "pink", "purple", "brown")

ATTRIBUTES = "map<string,string>"
TYPED = "map<string,variant>"


def strip(c: Column | str) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column | str) -> Column:
    """Stripped text; empty for null."""
    return F.coalesce(strip(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), F.lit(""))


def json_map(c: Column | str) -> Column:
    """A JSON object as a map; empty for null, blank or invalid text and for other JSON. Of a key given twice
    the last value counts, at the first one's place."""
    return F.coalesce(once(F.from_json(strip(c), ATTRIBUTES), lambda m: _merged(m, m)), empty_map())


def json_values(c: Column | str) -> Column:
    """The same with each value as it is in JSON: numbers, booleans, nulls, lists and objects, whose own keys are in order of name."""
    return F.coalesce(once(F.from_json(strip(c), TYPED), lambda m: _merged(m, m)), F.from_json(F.lit("{}"), TYPED))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often use() names it."""
    return F.transform(F.array(value), use)[0]


def empty_map() -> Column:
    return F.from_json(F.lit("{}"), ATTRIBUTES)


def merge(left: Column, right: Column) -> Column:
    """left with right's entries: known keys keep their places, new ones follow."""
    return once(F.struct(left.alias("l"), right.alias("r")), lambda m: _merged(m["l"], m["r"]))


def _merged(left: Column, right: Column) -> Column:
    last = lambda m, k: F.element_at(F.filter(F.map_entries(m), lambda e: e["key"] == k), -1)["value"]
    keys = F.array_distinct(F.concat(F.map_keys(left), F.map_keys(right)))
    values = lambda ks: F.transform(ks, lambda k: F.when(F.array_contains(F.map_keys(right), k), last(right, k)).otherwise(last(left, k)))
    return once(keys, lambda ks: F.map_from_arrays(ks, values(ks)))


def dump(attributes: Column) -> Column:
    """A map as JSON, nulls kept."""
    return F.to_json(attributes, {"ignoreNullFields": "false"})


def canonical_text(title: Column, category: Column, attributes: Column) -> Column:
    """The sentence that is embedded: title, category and attributes in their order; a null value reads None."""
    pairs = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return F.concat(title, F.lit(". Category: "), category, F.lit(". Attributes: "), F.array_join(pairs, ", "), F.lit("."))


def is_text_missing(title: Column, attributes: Column) -> Column:
    return (title == "") & (F.size(attributes) == 0)


def first_color(text: Column) -> Column:
    """The first of BASIC_COLORS, in list order, that is a word of the text; empty if none is."""
    found = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("")
    for name in reversed(BASIC_COLORS):
        out = F.when(found.rlike(rf"(?U)\b{name}\b"), name).otherwise(out)
    return out


def text_color(attributes: Column, title: Column) -> Column:
    """The attribute color, lower-case, or else the title's first colour; a null attribute reads none."""
    own = F.when(F.map_contains_key(attributes, "color"), F.coalesce(strip(F.lower(attributes["color"])), F.lit("none"))).otherwise("")
    return F.when(own != "", own).otherwise(first_color(title))


def resolve_path(root: str, path: Column) -> Column:
    """An absolute path or URI as it is, another under root."""
    return F.when(path.rlike("^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
