"""Nested answer to flat fields and to the canonical export record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions.jsonio import is_json_number, json_path_text
from docproof.functions.numbers import normalize_number, parse_float_amount
from docproof.functions.text import let, py_strip

#: JSON of what counts as absent: null, false, zero, or an empty text, object or array.
FALSY_JSON = r'^(?:null|false|""|\{\}|\[\]|-?[0.]+(?:E[-+]?[0-9]+)?)$'
#: Texts that don't tell alone whether the value is absent, or a boolean. Of the others only the empty one, which is written
#: for the empty text alone, belongs to an absent value.
UNCLEAR = r"^(?:true|false|\{\}|\[\]|-?[0.]+(?:E[-+]?[0-9]+)?)$"


def _type_of(paths: dict[str, str]) -> str:
    """The struct type that holds the given values: path to kind, at the top or one level down."""
    parts: dict[str, dict[str, str] | str] = {}
    for path, kind in paths.items():
        *above, name = path.removeprefix("$.").split(".")
        (parts.setdefault(above[0], {}) if above else parts)[name] = kind
    struct = lambda entries: "struct<" + ",".join(f"`{n}`:{struct(t) if isinstance(t, dict) else t}" for n, t in entries.items()) + ">"
    return struct(parts)


def values_at(variant: Column, paths: dict[str, str]) -> Column:
    """All values at the given paths (path to type) in one walk; each is what ``try_variant_get`` finds at its path."""
    return F.try_variant_get(variant, "$", _type_of(paths))


def value_at(values: Column, path: str) -> Column:
    """One value out of ``values_at``."""
    for name in path.removeprefix("$.").split("."):
        values = values[name]
    return values


def flat_values(variant: Column) -> Column:
    """The values of all validated fields: texts, amounts as they stand."""
    return values_at(variant, {C.FIELD_PATHS[f]: "variant" if f in C.AMOUNT_FIELDS else "string" for f in C.FIELDS})


def canonical_texts(variant: Column) -> Column:
    """The texts at all places of the canonical fields."""
    return values_at(variant, {path: "string" for f in C.CANONICAL_FIELDS for path in C.CANONICAL_PATHS[f]})


def truthy_coalesce(*texts: Column) -> Column:
    """First text that is neither null nor empty; the last one is returned as it is."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts[:-1]), texts[-1])


def flat_text(variant: Column, field: str) -> Column:
    return F.coalesce(py_strip(json_path_text(variant, C.FIELD_PATHS[field])), F.lit(""))


def flat_amount(variant: Column, field: str) -> Column:
    """JSON numbers as they are, texts through the strict amount reader."""
    return read_amount(variant, C.FIELD_PATHS[field])


def read_amount(variant: Column, path: str = "$") -> Column:
    return F.when(is_json_number(variant, path), F.try_variant_get(variant, path, "double")).otherwise(
        parse_float_amount(json_path_text(variant, path))
    )


def is_present_json(json: Column) -> Column:
    """Whether JSON text stands for a present value."""
    return F.coalesce(~F.rlike(json, F.lit(FALSY_JSON)), F.lit(False))


def _json_at(variant: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(variant, path, "variant"))


def _text_at(variant: Column, path: str, texts: Column | None) -> Column:
    return json_path_text(variant, path) if texts is None else value_at(texts, path)


def _told(variant: Column, path: str, text: Column, absent, clear) -> Column:
    """``absent(json)`` where the text of a value leaves open what it is, else ``clear``; few texts need their JSON."""
    return F.when(F.rlike(text, F.lit(UNCLEAR)), absent(_json_at(variant, path))).otherwise(clear)


def is_truthy(variant: Column, path: str, texts: Column | None = None) -> Column:
    """Whether a JSON value counts as present: not null, false, zero, or an empty text, object or array."""
    text = _text_at(variant, path, texts)
    return _told(variant, path, text, is_present_json, F.coalesce(text != "", F.lit(False)))


def _shown(variant: Column, path: str, texts: Column | None = None) -> Column:
    """A present JSON value as text, null for an absent one; booleans as the replaced system spells them."""
    text = _text_at(variant, path, texts)
    unclear = lambda json: F.when(json == "true", "True").when(is_present_json(json), text)
    return _told(variant, path, text, unclear, F.nullif(text, F.lit("")))


def flat_document_type(variant: Column) -> Column:
    return F.coalesce(_shown(variant, "$.document_type"), F.lit("invoice"))


def canonical_text(variant: Column, field: str, texts: Column | None = None) -> Column:
    """``texts``, here and below, is a column of ``canonical_texts``, which spares looking up each place by itself."""
    default = F.lit("invoice" if field == "document_type" else "")
    return py_strip(F.coalesce(*(_shown(variant, p, texts) for p in C.CANONICAL_PATHS[field]), default))


def canonical_amount(variant: Column, field: str, texts: Column | None = None) -> Column:
    """The first present amount, read as a number; where none is, the last place as it stands.

    The choice is made on presence, not on readability: an unreadable text hides the places after it.
    """
    paths = C.CANONICAL_PATHS[field]
    fact = lambda path: F.struct(
        is_json_number(variant, path).alias("number"), _text_at(variant, path, texts).alias("text")
    )
    found = F.coalesce(*(F.when(is_truthy(variant, p, texts), fact(p)) for p in paths), fact(paths[-1]))
    return let(found, lambda f: F.when(f["number"], f["text"].cast("double")).otherwise(normalize_number(f["text"])))


def canonical_columns(variant: Column, texts: Column | None = None) -> list[Column]:
    """The canonical export fields of a stored answer, in order."""
    return [
        (canonical_amount if f in C.AMOUNT_FIELDS else canonical_text)(variant, f, texts).alias(f)
        for f in C.CANONICAL_FIELDS
    ]
