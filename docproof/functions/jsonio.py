"""Reading and writing the JSON held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docproof.functions.text import let, py_strip

FENCE = r"```(?:json)?"
QUOTED = r'"(?:[^"\\]|\\.)*+"'
TIMINGS_TYPE = "map<string,double>"


def _object_only(text: Column) -> Column:
    """A variant when the text is one JSON object and nothing else, else null."""
    # The parser stops after the first value; inside brackets anything that follows it becomes an error or an element.
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = lambda v: F.when(
        F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")
    )
    braced = F.startswith(F.ltrim(text), F.lit("{")) & F.endswith(F.rtrim(text), F.lit("}"))
    return F.when(braced, let(listed, alone))


def parse_model_json(text: Column) -> Column:
    """The object a model answered with: fences removed, else the outermost braces, else null."""
    outermost = lambda c: F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return let(
        py_strip(F.regexp_replace(text, FENCE, "")),
        # The second part is only reached when the clean text is not an object by itself.
        lambda c: F.coalesce(_object_only(c), let(outermost(c), _object_only)),
    )


def json_path_text(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def is_json_number(variant: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.coalesce(F.rlike(kind, F.lit("^(?:BIGINT|DECIMAL|DOUBLE)")), F.lit(False))


def read_object(text: Column) -> Column:
    """Stored JSON text as a variant; blank, bad or non-object text reads as an empty object."""
    return F.coalesce(_object_only(text), F.parse_json(F.lit("{}")))


def timings_map(text: Column) -> Column:
    """Stage timings, an empty map for anything unreadable."""
    return F.coalesce(F.from_json(text, TIMINGS_TYPE), F.create_map().cast(TIMINGS_TYPE))


def public_keys(payload: Column) -> Column:
    """Drop private entries (leading underscore) of a map."""
    return F.map_filter(payload, lambda k, _: ~F.startswith(k, F.lit("_")))


def json_payload(value: Column, is_text: bool) -> Column:
    """Text for a JSON column: text is passed through, anything else is serialised."""
    return value if is_text else F.to_json(value, {"ignoreNullFields": "false"})


def download_json(json_output: Column, extracted_json: Column) -> Column:
    return F.coalesce(F.nullif(json_output, F.lit("")), F.nullif(extracted_json, F.lit("")), F.lit("{}"))


def normalize_issues(text: Column) -> Column:
    """A stored issue list with defaults filled in; entries that are not objects are dropped."""
    items = F.coalesce(
        F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), F.array().cast("array<variant>")
    )
    objects = F.filter(items, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    return F.transform(
        objects,
        lambda v: F.struct(
            F.coalesce(json_path_text(v, "$.field"), F.lit("document")).alias("field"),
            F.coalesce(json_path_text(v, "$.message"), F.to_json(v)).alias("message"),
            F.coalesce(json_path_text(v, "$.severity"), F.lit("warning")).alias("severity"),
        ),
    )


def json_depth(text: Column) -> Column:
    """How deep objects and arrays are nested in JSON text, at least 1."""
    brackets = F.regexp_replace(F.regexp_replace(text, QUOTED, ""), r"[^\[\]{}]+", "")
    step = lambda a, c: F.struct(
        (a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(a["top"], a["now"]).alias("top")
    )
    start = F.struct(F.lit(0).alias("now"), F.lit(1).alias("top"))
    return F.aggregate(F.split(brackets, ""), start, step, lambda a: a["top"])


def flatten_json(variant: Column) -> Column:
    """``array<struct<path, value>>`` of every leaf at any depth, with dotted paths; arrays are one leaf, as JSON text."""
    no_entries = F.array().cast("array<struct<key:string,value:variant>>")
    entries_of = lambda v: F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), no_entries)
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))

    def one_level_down(entries: Column) -> Column:
        inner = lambda e: F.transform(
            entries_of(e["value"]),
            lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")),
        )
        return F.flatten(F.transform(entries, lambda e: F.when(is_object(e["value"]), inner(e)).otherwise(F.array(e))))

    levels = F.sequence(F.lit(1), json_depth(F.coalesce(variant.cast("string"), F.lit(""))))
    entries = F.aggregate(levels, entries_of(variant), lambda entries, _: one_level_down(entries))
    return F.transform(
        entries, lambda e: F.struct(e["key"].alias("path"), e["value"].cast("string").alias("value"))
    )


def flatten_object(variant: Column, paths: dict[str, str]) -> list[Column]:
    """Named columns out of nested JSON; arrays come back as JSON text."""
    return [json_path_text(variant, path).alias(name) for name, path in paths.items()]
