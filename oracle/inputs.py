"""Building blocks of the expected-result SQL: derived input tables and scalar rules as SQL text."""

from __future__ import annotations

from docproof import constants as C


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


SPACES = q(C.PY_SPACES)
BREAKS = "".join(chr(c) for c in (10, 13, 11, 12, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029))
BLANKS = " \t\xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def fold_digits(x: str) -> str:
    return f"translate({x}, {q(C.FOLD_DIGITS_FROM)}, {q(C.FOLD_DIGITS_TO)})"


def fold(x: str) -> str:
    return f"regexp_replace({fold_digits(f'lower({x})')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def any_word(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def ascii_number(x: str) -> str:
    # Digits of the two Arabic blocks are the only non-ASCII ones in the data.
    src = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫"
    return f"regexp_replace(translate({x}, {q(src)}, '01234567890123456789.'), {q('[' + C.PY_SPACES + ']')}, '', 'g')"


def separators(s: str) -> str:
    rev = lambda c: f"instr(reverse({s}), '{c}')"
    return (
        f"CASE WHEN contains({s}, '.') AND contains({s}, ',') THEN"
        f" CASE WHEN {rev('.')} > {rev(',')} THEN replace(replace({s}, '.', ''), ',', '.')"
        f" ELSE replace({s}, ',', '') END"
        f" WHEN contains({s}, ',') THEN CASE WHEN regexp_matches({s}, ',[0-9]{{1,2}}$') THEN replace({s}, ',', '.')"
        f" ELSE replace({s}, ',', '') END ELSE {s} END"
    )


def number_str(x: str) -> str:
    return let(ascii_number(x), "s", separators("s"))


def number(x: str) -> str:
    return f"TRY_CAST(regexp_replace({number_str(x)}, '[^0-9.-]', '', 'g') AS DOUBLE)"


def parse_amount(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '[a-zA-Z]+', '', 'g'), '[ $€£,]', '', 'g')"
    return f"TRY_CAST({strip(bare)} AS DOUBLE)"


def candidates(x: str) -> str:
    return f"regexp_extract_all({x}, {q('[0-9٠-٩۰-۹.,٫' + C.PY_SPACES + ']+')})"


def amounts(x: str) -> str:
    return f"list_transform({candidates(x)}, lambda c: round({number('c')}, 2))"


def amount_in(v: str, listed: str) -> str:
    return f"coalesce(list_bool_or(list_transform({listed}, lambda a: coalesce(abs(a - round({v}, 2)) < 0.01, false))), false)"


def date(x: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({x}, {q(p)})" for _, p in C.DATE_LAYOUTS) + ")"


def currency(x: str) -> str:
    return f"CASE WHEN {any_word(f'lower({x})', C.RIYAL_MARKS)} THEN 'SAR' ELSE {strip(x)} END"


def mentioned(field: str, lower: str) -> str:
    return "true" if field in C.VENDOR_FIELDS else any_word(lower, C.FIELD_KEYWORDS[field])


def model_json(x: str) -> str:
    clean = strip(f"regexp_replace({x}, '```(json)?', '', 'g')")
    whole = "CASE WHEN json_valid(c) AND json_type(c) = 'OBJECT' THEN c END"
    inner = let("regexp_extract(c, '(?s)\\{.*\\}')", "b", "CASE WHEN json_valid(b) AND json_type(b) = 'OBJECT' THEN b END")
    return let(clean, "c", f"coalesce({whole}, {inner})")


def lines(x: str) -> str:
    one = f"replace({x}, chr(13) || chr(10), chr(10))"
    return f"string_split_regex(regexp_replace({one}, {q('[' + BREAKS + ']$')}, ''), {q('[' + BREAKS + ']')})"


def clean(x: str) -> str:
    tidy = f"list_transform({lines(x)}, lambda l: {strip('regexp_replace(l, ' + q('[' + BLANKS + ']+') + ', chr(32), chr(103))')})"
    kept = let(tidy, "a", "list_filter(a, lambda l, i: i = 1 OR l <> a[i - 1])")
    return strip(f"array_to_string({kept}, chr(10))")


def money(c: str) -> str:
    return f"(({c}) // 100)::VARCHAR || '.' || lpad((({c}) % 100)::VARCHAR, 2, '0')"


ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"

_INV_BASE = """
inv_base AS (
  SELECT o_orderkey AS doc_id, o_custkey AS session_id, o_orderdate AS created_at, (o_orderkey % 10)::INTEGER AS k,
         sub_c, sub_c * 15 // 100 AS tax_c,
         sub_c + sub_c * 15 // 100 + CASE WHEN o_orderkey % 10 = 1 THEN 500 ELSE 0 END AS tot_c,
         n_lines, l.s_suppkey, s_name, c_name, c_nationkey, n_name, strftime(o_orderdate, '%Y-%m-%d') AS day
  FROM orders
  JOIN (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sub_c, min(l_suppkey) AS s_suppkey,
               count(*) AS n_lines FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN supplier s ON s.s_suppkey = l.s_suppkey
)"""


def _invoices() -> str:
    nl = " || chr(10) || "
    number_ = "'INV-' || doc_id"
    vat = "'3' || lpad(s_suppkey::VARCHAR, 14, '0')"
    text = nl.join(
        (
            "'Vendor: ' || s_name",
            "'المورد ' || s_suppkey",
            f"'Invoice No: ' || {number_}",
            f"'VAT No: ' || {vat}",
            "'Customer: ' || c_name",
            "'العميل ' || session_id",
            "'Address: ' || n_name",
            "'حي ' || c_nationkey || CASE WHEN k <> 2 THEN chr(10) || 'Date: ' || day ELSE '' END",
            f"'Subtotal: ' || {money('sub_c')} || ' SAR'",
            f"'VAT: ' || {money('tax_c')}",
            f"'Total: ' || {money('tot_c')}",
        )
    )
    answer = (
        "'{\"document_type\":\"invoice\",\"document\":{\"number\":\"'"
        f" || CASE WHEN k = 4 THEN 'INV-X' || doc_id ELSE {number_} END"
        " || '\",\"date\":\"' || CASE WHEN k IN (2, 3) THEN '' ELSE day END"
        " || '\",\"currency\":\"' || CASE WHEN k = 9 THEN 'Saudi Riyal' ELSE 'SAR' END"
        " || '\"},\"vendor\":{\"name_ar\":\"المورد ' || s_suppkey || '\",\"name_en\":\"' || s_name"
        f" || '\",\"vat_number\":\"' || {vat} || '\",\"address_ar\":\"حي ' || c_nationkey"
        " || '\",\"phone\":\"05' || s_suppkey || '\",\"address_en\":\"' || n_name || '\"},\"customer\":{\"name_ar\":\"العميل ' || session_id"
        " || '\",\"name_en\":\"' || c_name || '\",\"address_ar\":\"\",\"address_en\":\"\"},\"financials\":{\"subtotal\":'"
        f" || {money('sub_c')} || ',\"tax_amount\":' || {money('tax_c')} || ',\"total_amount\":'"
        f" || CASE doc_id % 30 WHEN 6 THEN '\"SAR ' || {money('tot_c')} || '\"'"
        f" WHEN 16 THEN '\"' || replace({money('tot_c')}, '.', ',') || '\"'"
        f" WHEN 26 THEN '\"' || {money('tot_c')} || ' ريال\"' ELSE {money('tot_c')} END"
        " || '},\"metadata\":{\"purchase_order\":\"\",\"reference_number\":\"\",\"payment_terms\":\"\",\"notes\":\"\"'"
        " || CASE WHEN k = 3 THEN ',\"extra\":{\"b\":{\"c\":{\"d\":{\"e\":{\"f\":{\"g\":\"deep\"}}}}}}' ELSE '' END || '}}'"
    )
    return f"""{_INV_BASE},
inv_text AS (SELECT *, {text} AS txt, {answer} AS ans FROM inv_base),
inv AS (
  SELECT doc_id, session_id, created_at, k, n_lines,
    'invoice_' || doc_id || '.' || CASE WHEN doc_id % 9 = 8 THEN 'docx' WHEN doc_id % 2 = 0 THEN 'PDF' ELSE 'png' END
      AS original_filename, 'uploads/' || doc_id AS file_path, (n_lines % 3 + 1)::INTEGER AS page_count,
    CASE WHEN k = 5 THEN translate(txt, '0123456789', {q(ARABIC_INDIC)}) ELSE txt END AS ocr_text,
    CASE WHEN k = 8 THEN 'not json' WHEN k = 7 THEN '```json' || chr(10) || ans || chr(10) || '```' ELSE ans END
      AS raw_llm_response,
    CASE WHEN k = 8 THEN 'not json' ELSE '{{"ocr_time":' || {money('doc_id % 977 + 10')}
      || ',"extraction_time":' || {money('doc_id % 499 + 100')} || ',"validation_time":0.0' || (doc_id % 7) || '}}' END
      AS processing_timings
  FROM inv_text
)"""


INV = _invoices()

DOCS = """
docs AS (
  SELECT o_orderkey AS id, o_custkey AS session_id, o_orderdate AS created_at, o_orderpriority AS document_type,
    CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Needs Review' ELSE 'Rejected' END AS status,
    (o_orderkey % 101) / 100.0::DOUBLE AS confidence, 'invoice_' || o_orderkey || '.pdf' AS filename,
    'invoice_' || o_orderkey || '.pdf' AS original_filename, '{"customer":"' || c_name || '"}' AS json_output,
    '{}' AS extracted_json, '' AS excel_file_path
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""

SESSIONS = """
sess AS (
  SELECT c_custkey AS id, c_name AS name, created_at
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS created_at FROM orders GROUP BY 1) o
    ON c_custkey = o_custkey
)"""

AUDIT = """
audit AS (SELECT event_id AS id, user_id AS document_id, event_type, props AS payload, ts AS created_at FROM events)"""

EXTRACTIONS = """
extr AS (SELECT l_linenumber::BIGINT AS id, l_orderkey AS document_id, l_discount AS confidence,
  l_returnflag AS engine, l_shipdate AS created_at FROM lineitem)"""

EDITS = """
edits AS (
  SELECT doc_id AS document_id, 1::BIGINT AS seq, 'Approved' AS status,
    '1,' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '.50' AS e_total, 'FIX-' || doc_id AS e_number,
    'Corrected Vendor' AS e_vendor, 'USD' AS e_currency FROM inv WHERE doc_id % 7 = 0
  UNION ALL
  SELECT doc_id, 2, 'Rejected', NULL, NULL, NULL, NULL FROM inv WHERE doc_id % 11 = 0
)"""

PAGES = """
pgs AS (
  SELECT conv_id AS doc_id, turn::BIGINT AS page_no, text AS header_text, text AS body_text,
    text AS footer_text, length(text) AS h_tokens, length(text) AS b_tokens,
    length(text) AS f_tokens,
    CASE WHEN length(text) % 5 = 0 THEN 'length' ELSE 'stop' END AS h_reason,
    CASE WHEN (length(text) + 2) % 5 = 0 THEN 'length' ELSE 'stop' END AS f_reason,
    length(text) % 40 AS total_lines
  FROM conversations
)"""


def pages_cleaned() -> str:
    """Cleaned pages with their compressed body and their place in the document."""
    has_table = any_word("lower(b)", C.TABLE_WORDS)
    kept = let(lines("b"), "l", (
        "array_to_string(l[1:3], chr(10)) || chr(10) || '[PRODUCT TABLE REMOVED - '"
        " || greatest(1, total_lines - least(len(l), 3)) || ' ROWS]'"
    ))
    return f"""{PAGES},
pgs_clean AS (SELECT *, {clean('header_text')} AS h, {clean('body_text')} AS b, {clean('footer_text')} AS f,
   page_no = min(page_no) OVER (PARTITION BY doc_id) AS is_first,
   page_no = max(page_no) OVER (PARTITION BY doc_id) AS is_last FROM pgs),
pgs_comp AS (SELECT *, CASE WHEN {has_table} THEN {kept} ELSE b END AS cb FROM pgs_clean)"""


UPLOADS = """
ups AS (
  SELECT doc_id AS pos, original_filename AS name, n_lines AS size, doc_id AS last_modified FROM inv
  UNION ALL
  SELECT doc_id + 1000000000000, original_filename, n_lines, doc_id FROM inv WHERE doc_id % 3 = 0
)"""


def values() -> str:
    """``ans`` (parsed answer), ``v_<field>`` columns, text index."""
    js = lambda p: f"json_extract_string(a, {q(p)})"
    cols = []
    for field, path in C.FIELD_PATHS.items():
        if field in C.AMOUNT_FIELDS:
            expr = (
                f"CASE WHEN json_type(a, {q(path)}) IN ('BIGINT','UBIGINT','DOUBLE') THEN {js(path)}::DOUBLE"
                f" ELSE {parse_amount(js(path))} END"
            )
        elif field in ("purchase_order", "customer_vat", "payment_terms"):
            expr = js(path)
        else:
            expr = f"coalesce({strip(js(path))}, '')"
            if field == "currency":
                expr = currency(expr)
        cols.append(f"{expr} AS v_{field}")
    return f"""
parsed AS (SELECT *, {model_json('raw_llm_response')} AS a FROM inv),
vals AS (SELECT *, {', '.join(cols)}, lower(ocr_text) AS t_lower, {fold('ocr_text')} AS t_fold,
  {amounts('ocr_text')} AS t_amounts FROM parsed)"""


def grounded(field: str) -> str:
    v = f"v_{field}"
    if field in C.AMOUNT_FIELDS:
        return amount_in(v, "t_amounts")
    if field == "document_date":
        parts = f"list_transform(regexp_extract_all({v}, '[0-9]+'), lambda p: contains(t_fold, p))"
        return f"({date(v)} IS NOT NULL AND coalesce(list_bool_or({parts}), false))"
    text = f"contains(t_fold, {fold(v)})"
    if field == "currency":
        return f"CASE WHEN upper({strip(v)}) = 'SAR' THEN {any_word('t_lower', C.RIYAL_MARKS)} ELSE {text} END"
    return text


def empty(field: str) -> str:
    v = f"v_{field}"
    return f"{v} IS NULL" if field in C.AMOUNT_FIELDS else f"coalesce({strip(v)}, '') IN ('', 'null', 'None')"


def state(field: str) -> str:
    return (
        f"CASE WHEN NOT {mentioned(field, 't_lower')} THEN '{C.ABSENT}' WHEN {empty(field)} THEN '{C.MISSING}'"
        f" WHEN {grounded(field)} THEN '{C.VALID}' ELSE '{C.INCORRECT}' END"
    )


def states() -> str:
    """``f_<field>`` states found, ``s_<field>`` final states, ``math_failed``."""
    found = ", ".join(f"{state(f)} AS f_{f}" for f in C.FIELDS)
    math = "coalesce(abs((v_subtotal + v_tax_amount) - v_total_amount) > 0.05, false)"
    final = ", ".join(
        f"CASE WHEN math_failed THEN '{C.INCORRECT}' ELSE f_{f} END AS s_{f}" if f == "total_amount" else f"f_{f} AS s_{f}"
        for f in C.FIELDS
    )
    return f"""{values()},
found AS (SELECT *, {found}, {math} AS math_failed FROM vals),
st AS (SELECT *, {final} FROM found)"""


def score(field: str) -> str:
    good = 99 if field in C.AMOUNT_FIELDS else 98 if field == "document_date" else 97
    return f"CASE s_{field} WHEN '{C.VALID}' THEN {good} WHEN '{C.ABSENT}' THEN 100 WHEN '{C.MISSING}' THEN 10 ELSE 40 END"


def scored() -> str:
    """Confidence, valid flag and status on top of the states.

    The mean is taken of the binary values of the scores, added exactly as multiples of 2 ** -57, and written with two
    decimals from its own binary value, so that halves go where they go in float arithmetic.
    """
    is_ = lambda f, s: f"(s_{f} = '{s}')::INTEGER"
    n99 = " + ".join(is_(f, C.VALID) for f in C.AMOUNT_FIELDS)
    n98 = is_("document_date", C.VALID)
    n97 = " + ".join(is_(f, C.VALID) for f in C.FIELDS if f not in C.AMOUNT_FIELDS and f != "document_date")
    n10 = " + ".join(is_(f, C.MISSING) for f in C.FIELDS)
    n40 = " + ".join(is_(f, C.INCORRECT) for f in C.FIELDS)
    scores = ("0.99", "0.98", "0.97", "0.10", "0.40")
    exact = " + ".join(f"n{i} * ({x}::DOUBLE * pow(2, 57))::BIGINT" for i, x in enumerate(scores))
    low = " OR ".join(f"s_{f} IN ('{C.MISSING}', '{C.INCORRECT}')" for f in C.FIELDS)
    return f"""{states()},
cnt AS (SELECT *, {n99} AS n0, {n98} AS n1, {n97} AS n2, {n10} AS n3, {n40} AS n4 FROM st),
tot AS (SELECT *, n0 + n1 + n2 + n3 + n4 AS n, ({exact})::DOUBLE / pow(2, 57) AS total FROM cnt),
conf AS (SELECT *, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE format('{{:.2f}}', total / n)::DOUBLE END AS confidence,
  NOT (math_failed OR f_document_number IN ('{C.MISSING}', '{C.INCORRECT}') OR f_total_amount = '{C.MISSING}') AS valid,
  ({low}) AS low FROM tot),
fin AS (SELECT *, CASE WHEN confidence <= 0.05 THEN 'Rejected' WHEN low THEN 'Needs Review' ELSE 'Approved' END
  AS status FROM conf)"""


def canonical(j: str, doc_type: str | None = None) -> dict[str, str]:
    """Canonical fields of stored JSON text ``j``."""
    js = lambda p: f"json_extract_string({j}, {q(p)})"
    out = {}
    for field, paths in C.CANONICAL_PATHS.items():
        if field in C.AMOUNT_FIELDS:
            cases = "".join(
                f" WHEN json_type({j}, {q(p)}) IN ('BIGINT','UBIGINT','DOUBLE') AND {js(p)}::DOUBLE <> 0 THEN {js(p)}::DOUBLE"
                f" WHEN json_type({j}, {q(p)}) = 'VARCHAR' AND {js(p)} <> '' THEN {number(js(p))}"
                for p in paths[:-1]
            )
            out[field] = f"CASE{cases} ELSE {number(js(paths[-1]))} END"
        else:
            default = "'invoice'" if field == "document_type" else "''"
            out[field] = strip("coalesce(" + ", ".join(f"nullif({js(p)}, '')" for p in paths) + f", {default})")
    if doc_type:
        out["document_type"] = doc_type
    return out


SKELETON = {
    "document": '{"number":"","date":"","currency":""}',
    "vendor": '{"name_ar":"","name_en":"","vat_number":"","address_ar":"","address_en":""}',
    "customer": '{"name_ar":"","name_en":"","vat_number":"","address_ar":"","address_en":""}',
    "financials": '{"subtotal":null,"tax_amount":null,"total_amount":null}',
    "metadata": '{"purchase_order":"","reference_number":"","payment_terms":"","notes":""}',
}


def stored() -> str:
    """Stored documents: flat fields and the sections of the raw answer, as columns and JSON text."""
    sec = lambda names: ", ".join(f"{k} := {v}" for k, v in names.items())
    raw = {n: f"coalesce(json_extract(a, '$.{n}'), {q(blank)}::JSON)" for n, blank in SKELETON.items()}
    raw["document"] = f"CASE WHEN v_currency <> '' THEN json_merge_patch({raw['document']}, json_object('currency', v_currency)) ELSE {raw['document']} END"
    flat = sec({f: f"v_{f}" for f in C.FIELDS[:13]})
    kind = "coalesce(nullif(json_extract_string(a, '$.document_type'), ''), 'invoice')"
    return f"""{scored()},
stored AS (SELECT doc_id AS id, session_id, original_filename AS filename, status, confidence, valid, created_at,
  to_json(struct_pack({flat}, document_type := {kind}, {sec(raw)}))::VARCHAR AS js FROM fin)"""
