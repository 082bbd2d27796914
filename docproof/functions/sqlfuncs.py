"""The rules as temporary SQL functions, for users who write SQL.

Each body is plain SQL over the same fixed values the column functions use. Functions that return a table are called in
``LATERAL`` position; Spark turns them into a generator over the rows beside them, without a join or a shuffle. Spark
takes no call of another SQL function as their argument: make it a column of a subquery first.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from docproof import constants as C
from docproof.functions import jsonio as js
from docproof.functions import numbers as num
from docproof.functions import text as tx
from docproof.functions.text import minimal_words


def quote(text: str) -> str:
    """A SQL string literal; backslashes and quotes are escaped."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_of(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(w)})" for w in minimal_words(words)) + ")"


# SQL functions cannot be called inside a generator or a lambda, so rules used there are written once as text.


def _parse_amount(t: str) -> str:
    spaces = quote(C.PY_SPACES)
    return (
        f"try_cast(btrim(regexp_replace(translate(btrim({t}, {spaces}), {quote(C.DECIMAL_DIGITS_FROM + ' $€£,')},"
        f" {quote(C.DECIMAL_DIGITS_TO)}), '[A-Za-z]+', ''), {spaces}) AS DOUBLE)"
    )


def _currency(t: str) -> str:
    marked = _any_of(f"lower(coalesce({t}, ''))", C.RIYAL_MARKS)
    return f"CASE WHEN {marked} THEN 'SAR' ELSE btrim(coalesce({t}, ''), {quote(C.PY_SPACES)}) END"


def _number_text(v: str) -> str:
    return (
        f"CASE WHEN abs({v}) >= 1e7 AND abs({v}) < 1e16 THEN"
        f" regexp_replace(regexp_replace(CAST(CAST({v} AS DECIMAL(38,10)) AS STRING), '0+$', ''), '[.]$', '.0')"
        f" ELSE CAST({v} AS STRING) END"
    )


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name -> (parameters, result type, body)."""
    fold = f"translate(lower(coalesce(t, '')), {quote(C.FOLD_DIGITS_FROM)}, {quote(C.FOLD_DIGITS_TO)})"
    digits_from = C.DECIMAL_DIGITS_FROM + C.ARABIC_DECIMAL_SEPARATOR + C.PY_SPACES
    plain = f"translate(t, {quote(digits_from)}, {quote(C.DECIMAL_DIGITS_TO + '.')})"
    separators = (
        f"CASE WHEN locate(',', s) = 0 THEN s"
        f" WHEN locate('.', s) > 0 AND locate('.', reverse(s)) > locate(',', reverse(s))"
        f" THEN replace(replace(s, '.', ''), ',', '.')"
        f" WHEN locate('.', s) = 0 AND rlike(s, ',[0-9]{{1,2}}$') THEN replace(s, ',', '.')"
        f" ELSE replace(s, ',', '') END"
    )
    layouts = ", ".join(f"try_to_timestamp(t, {quote(spark)})" for spark, _ in C.DATE_LAYOUTS)
    spaces = quote(C.PY_SPACES)
    code = r"(?:^|[^\p{L}\p{N}])(" + "|".join(C.CURRENCY_CODES) + r")(?:$|[^\p{L}\p{N}])"
    suffix = r"^.*[^.].*?(\.[^./]+)$"
    words = f"filter(split(coalesce(t, ''), {quote('[' + C.PY_SPACES + ']+')}), w -> w <> '')"
    one_blank = f"regexp_replace(t, {quote(tx.BLANK_RUN)}, ' ')"
    unended = f"regexp_replace({one_blank}, {quote('(?:' + tx.LINE_BREAK + ')' + chr(92) + 'z')}, '')"
    lines = f"transform(split({unended}, {quote(tx.LINE_BREAK)}), l -> btrim(l, {spaces}))"
    iso, no_micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", r"\.000000$"
    listed = "try_parse_json(concat('[', t, ']'))"
    unfenced, outermost = f"btrim(regexp_replace(t, {quote(js.FENCE)}, ''), {spaces})", r"(?s)\{.*\}"
    return {
        "dp_fold_digits": (
            "t STRING", "STRING", f"translate(t, {quote(C.FOLD_DIGITS_FROM)}, {quote(C.FOLD_DIGITS_TO)})",
        ),
        "dp_fold_text": ("t STRING", "STRING", f"regexp_replace({fold}, {quote(tx.NON_ALNUM)}, '')"),
        "dp_resolve_separators": ("s STRING", "STRING", separators),
        "dp_normalize_number_str": ("t STRING", "STRING", f"dp_resolve_separators({plain})"),
        "dp_normalize_number": (
            "t STRING", "DOUBLE",
            f"try_cast(regexp_replace(dp_normalize_number_str(t), {quote('[^0-9.-]')}, '') AS DOUBLE)",
        ),
        "dp_parse_amount": ("t STRING", "DOUBLE", _parse_amount("t")),
        "dp_amount_grounded": (
            "v DOUBLE, t STRING", "BOOLEAN",
            f"exists(transform(transform(regexp_extract_all(t, {quote(num.AMOUNT_RUN)}, 0), t -> {plain}),"
            f" s -> try_cast(regexp_replace({separators}, {quote('[^0-9.-]')}, '') AS DOUBLE)),"
            f" x -> coalesce(abs(round(x, 2) - round(v, 2)) < {C.AMOUNT_TOLERANCE}, false))",
        ),
        "dp_normalize_currency": ("t STRING", "STRING", _currency("t")),
        "dp_is_valid_date": ("t STRING", "BOOLEAN", f"coalesce({layouts}) IS NOT NULL"),
        "dp_date_iso": ("t STRING", "STRING", f"date_format(coalesce({layouts}), 'yyyy-MM-dd')"),
        "dp_is_empty_value": (
            "t STRING", "BOOLEAN",
            f"coalesce(btrim(t, {spaces}), '') IN ({', '.join(quote(w) for w in C.EMPTY_WORDS)})",
        ),
        "dp_status_slug": ("t STRING", "STRING", "replace(lower(t), ' ', '_')"),
        "dp_reject_placeholder": (
            "t STRING", "STRING",
            f"CASE WHEN btrim(t, {spaces}) NOT IN ({', '.join(quote(w) for w in C.PLACEHOLDERS)}) THEN t END",
        ),
        "dp_currency_code": (
            "t STRING", "STRING",
            f"coalesce(nullif(regexp_extract(upper(t), {quote(code)}, 1), ''),"
            f" CASE WHEN {_any_of('lower(t)', C.RIYAL_NAMES)} THEN 'SAR' END)",
        ),
        "dp_number_text": ("v DOUBLE", "STRING", _number_text("v")),
        "dp_vat_format_ok": ("t STRING", "BOOLEAN", "coalesce(rlike(t, '^[A-Za-z0-9]{10,20}$'), false)"),
        "dp_vat_format_ksa": ("t STRING", "BOOLEAN", "coalesce(rlike(t, '^[0-9]{15}$'), false)"),
        "dp_safe_basename": ("t STRING", "STRING", "regexp_extract(t, '([^/]*)/*$', 1)"),
        "dp_file_suffix": ("t STRING", "STRING", f"regexp_extract(t, {quote(suffix)}, 1)"),
        "dp_file_stem": ("t STRING", "STRING", "substr(t, 1, length(t) - length(dp_file_suffix(t)))"),
        "dp_initials": (
            "t STRING", "STRING",
            f"coalesce(concat(upper(left(get({words}, 0), 1)), coalesce(upper(left(get({words}, 1), 1)), '')), 'U')",
        ),
        "dp_has_html": ("t STRING", "BOOLEAN", f"coalesce(contains(t, '>') AND rlike(t, {quote(C.HTML_TAG)}), false)"),
        "dp_clean_ocr": (
            "t STRING", "STRING",
            f"coalesce(btrim(array_join(get(transform(array({lines}),"
            f" a -> filter(a, (x, i) -> i = 0 OR x <> get(a, i - 1))), 0), '\n'), {spaces}), '')",
        ),
        "dp_day_start": ("d STRING", "TIMESTAMP_NTZ", "CAST(CAST(d AS DATE) AS TIMESTAMP_NTZ)"),
        "dp_day_end": ("d STRING", "TIMESTAMP_NTZ", "CAST(date_add(CAST(d AS DATE), 1) AS TIMESTAMP_NTZ)"),
        "dp_iso_timestamp": (
            "ts TIMESTAMP_NTZ", "STRING",
            f"regexp_replace(date_format(ts, {quote(iso)}), {quote(no_micros)}, '')",
        ),
        "dp_download_json": ("a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), nullif(b, ''), '{}')"),
        "dp_timings": (
            "t STRING", "MAP<STRING, DOUBLE>",
            "coalesce(from_json(t, 'map<string,double>'), CAST(map() AS MAP<STRING, DOUBLE>))",
        ),
        "dp_object": (
            "t STRING", "VARIANT",
            f"CASE WHEN startswith(ltrim(t), '{{') AND endswith(rtrim(t), '}}')"
            f" AND try_variant_get({listed}, '$[1]', 'variant') IS NULL THEN try_variant_get({listed}, '$[0]', 'variant') END",
        ),
        "dp_model_json": (
            "t STRING", "VARIANT",
            f"coalesce(dp_object({unfenced}), dp_object(nullif(regexp_extract({unfenced}, {quote(outermost)}, 0), '')))",
        ),
        "dp_read_object": ("t STRING", "VARIANT", "coalesce(dp_object(t), parse_json('{}'))"),
        "dp_text_grounded": ("v STRING, t STRING", "BOOLEAN", "contains(dp_fold_text(t), dp_fold_text(v))"),
    }


def _field(position: int, field: str) -> str:
    """One row of the long form of an answer, as a struct."""
    path = quote(C.FIELD_PATHS[field])
    text = f"try_variant_get(a, {path}, 'string')"
    trimmed = f"coalesce(btrim({text}, {quote(C.PY_SPACES)}), '')"
    if field in C.AMOUNT_FIELDS:
        number = f"rlike(schema_of_variant(try_variant_get(a, {path}, 'variant')), '^(BIGINT|DECIMAL|DOUBLE)')"
        number = f"CASE WHEN {number} THEN try_variant_get(a, {path}, 'double') ELSE {_parse_amount(text)} END"
        value = _number_text(f"({number})")
    elif field in ("purchase_order", "customer_vat", "payment_terms"):
        value = text
    else:
        value = _currency(trimmed) if field == "currency" else trimmed
    return f"struct({position} AS position, {quote(field)} AS field, {value} AS value)"


def table_definitions() -> dict[str, tuple[str, str, str]]:
    """Name -> (parameters, columns, query) of the functions that return a table."""
    entries = lambda v: (
        f"coalesce(map_entries(try_variant_get({v}, '$', 'map<string,variant>')),"
        " CAST(array() AS ARRAY<STRUCT<key: STRING, value: VARIANT>>))"
    )
    below = f"transform({entries('e.value')}, x -> named_struct('key', concat(e.key, '.', x.key), 'value', x.value))"
    is_object = "coalesce(startswith(schema_of_variant(e.value), 'OBJECT'), false)"
    one_down = f"flatten(transform(found, e -> CASE WHEN {is_object} THEN {below} ELSE array(e) END))"
    unquoted = f"regexp_replace(coalesce(CAST(a AS STRING), ''), {quote(js.QUOTED)}, '')"
    brackets = f"regexp_replace({unquoted}, {quote('[^' + chr(92) + '[' + chr(92) + ']{}]+')}, '')"
    depth = (
        f"aggregate(split({brackets}, ''), named_struct('now', 0, 'top', 1), (s, c) -> named_struct("
        "'now', s.now + CASE WHEN c IN ('{', '[') THEN 1 ELSE -1 END, 'top', greatest(s.top, s.now)), s -> s.top)"
    )
    leaves = f"aggregate(sequence(1, {depth}), {entries('a')}, (found, level) -> {one_down})"
    fields = ", ".join(_field(i, f) for i, f in enumerate(C.FIELDS, 1))
    return {
        "dp_amounts": (
            "t STRING", "pos INT, run STRING",
            f"SELECT p, r FROM posexplode(regexp_extract_all(t, {quote(num.AMOUNT_RUN)}, 0)) AS x(p, r)",
        ),
        "dp_leaves": (
            "a VARIANT", "path STRING, value STRING",
            f"SELECT e.key, CAST(e.value AS STRING) FROM explode({leaves}) AS x(e)",
        ),
        "dp_fields": ("a VARIANT", "position INT, field STRING, value STRING", f"SELECT * FROM inline(array({fields}))"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, (parameters, result, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, columns, body) in table_definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return [*definitions(), *table_definitions()]
