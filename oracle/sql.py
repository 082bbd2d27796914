"""Expected results per query name."""

from __future__ import annotations


from docproof import constants as C
from oracle import inputs as i
from oracle.inputs import q


def bare_of(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', chr(10), 'g')"


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    inv, docs, sess, audit, extr = i.INV, i.DOCS, i.SESSIONS, i.AUDIT, i.EXTRACTIONS
    short = "id, filename, document_type, status, confidence"
    vals = f"WITH {inv}, {i.values()}"
    st = f"WITH {inv}, {i.states()}"
    fin = f"WITH {inv}, {i.scored()}"
    stored = f"WITH {inv}, {i.stored()}"
    edits = f"{stored}, {i.EDITS}"

    # --- scans and sources
    sql["scan_documents"] = f"WITH {docs} SELECT {short}, created_at FROM docs"
    sql["document_by_id"] = f"WITH {docs} SELECT {short}, created_at FROM docs WHERE id = 4242"
    suffixes = ", ".join(q(s) for s in C.UPLOAD_SUFFIXES)
    sql["ingest_manifest"] = f"""WITH {inv}, f AS (
      SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS filename FROM pages
      UNION ALL SELECT doc_id, original_filename FROM inv),
      g AS (SELECT *, CASE WHEN regexp_matches(filename, '^[.]*[^.].*[.][^.]+$')
        THEN lower(regexp_extract(filename, '([.][^.]+)$', 1)) ELSE '' END AS suffix FROM f)
      SELECT page_id, filename, suffix, suffix IN ({suffixes}) AS accepted FROM g"""
    sql["storage_name"] = f"""WITH {inv} SELECT doc_id, 'invoice_' || doc_id || '_'
      || left(sha256(original_filename || '#' || doc_id), 12) || '.' || split_part(original_filename, '.', 2)
      AS stored_name FROM inv"""
    sql["seed_if_empty"] = f"WITH {docs} SELECT {short} FROM docs"
    demo = (
        '{"invoice_number": "INV-1001", "invoice_date": "2026-06-01", "vendor_name": "Northwind Traders", '
        '"customer_name": "Contoso Ltd", "currency": "USD", "subtotal": 1000.0, "tax_amount": 180.0, '
        '"total_amount": 1180.0}'
    )
    sql["seed_empty_store"] = f"""SELECT 1::BIGINT AS id, 'sample-invoice.pdf' AS filename, 'invoice' AS document_type,
      'pending_review' AS status, 0.93::DOUBLE AS confidence, {q(demo)} AS json_output
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = 'no such type')"""
    sql["schema_backfill"] = f"""WITH {docs} SELECT id, '' AS ocr_text, '' AS raw_llm_response,
      CASE WHEN id % 3 = 2 THEN '{{"a":1}}' ELSE json_output END AS extracted_json, '{{}}' AS validation_result,
      '' AS excel_file_path, 'qwen2.5-vl' AS extraction_engine, '{{}}' AS processing_timings FROM docs"""

    # --- sinks
    can = i.canonical("js")
    can_session = i.canonical("js", "'invoice'")
    titled = lambda c: ", ".join(f'{c[f]} AS "{t}"' for t, f in C.EXPORT_COLUMNS)
    sql["export_rows"] = f"{stored} SELECT id, {titled(can)} FROM stored"
    sql["export_session"] = f"{stored} SELECT session_id, id, {titled(can_session)} FROM stored"
    plain = f"{stored} SELECT id, {', '.join(f'{can[f]} AS {f}' for _, f in C.EXPORT_COLUMNS)} FROM stored"
    sql["csv_sink"] = plain
    sql["json_sink"] = plain
    sql["session_export_files"] = f"""{stored} SELECT session_id, id, {can['document_number']} AS document_number,
      {can['total_amount']} AS total_amount, 'invoice' AS document_type FROM stored"""
    widths = " UNION ALL ".join(
        f"""SELECT '{t}' AS column_name, greatest(greatest(coalesce(max(length({
            f'nullif({f}, 0)::VARCHAR' if f in C.AMOUNT_FIELDS else f})), 0), {len(t)}) + 3, 12)::BIGINT AS width FROM cols"""
        for t, f in C.EXPORT_COLUMNS
    )
    sql["export_col_width"] = f"""{stored}, cols AS (SELECT {', '.join(f'{can_session[f]} AS {f}' for _, f in C.EXPORT_COLUMNS)}
      FROM stored) {widths}"""
    sql["persist_document"] = f"""{fin} SELECT doc_id AS id, session_id, original_filename AS filename, original_filename,
      'invoice' AS document_type, status, confidence, ocr_text, raw_llm_response, page_count,
      'qwen_llm' AS extraction_engine, v_document_number AS document_number,
      coalesce(json_extract_string(a, '$.vendor.name_en'), '') AS vendor_name_en, s_document_date AS date_state FROM fin"""
    sql["persist_extractions"] = f"""{fin} SELECT doc_id AS document_id, ocr_text AS raw_text, 'qwen_llm' AS engine,
      confidence FROM fin"""
    sql["persist_audit"] = f"""{fin} SELECT doc_id AS document_id, 'system' AS actor, 'processed' AS event_type, status,
      confidence, ocr_text FROM fin"""
    path = lambda c: f"CASE WHEN {c} IN (SELECT id FROM sess WHERE created_at >= '2001-06-01'::TIMESTAMP) THEN 'exports/combined_export_' || {c} || '.xlsx' ELSE '' END"
    sql["set_export_path"] = f"""WITH {docs}, {sess} SELECT 'document' AS kind, id, {path('session_id')} AS excel_file_path FROM docs
      UNION ALL SELECT 'session', id, {path('id')} FROM sess"""

    # --- filters
    sql["search_text"] = f"WITH {docs} SELECT {short} FROM docs WHERE json_output ILIKE '%customer#0000001_7%'"
    sql["search_text_indexed"] = f"WITH {docs} SELECT {short} FROM docs WHERE json_output ILIKE '%customer#0000001%'"
    sql["filter_type"] = f"WITH {docs} SELECT {short} FROM docs WHERE document_type = '1-URGENT'"
    sql["filter_status"] = f"WITH {docs} SELECT {short} FROM docs WHERE status = 'Needs Review'"
    sql["filter_date_range"] = f"""WITH {docs} SELECT {short} FROM docs
      WHERE created_at BETWEEN '1997-02-01'::TIMESTAMP AND '1997-03-15 23:59:59.999999'::TIMESTAMP"""
    iso = lambda c: f"regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '[.]000000$', '')"
    sql["document_list"] = f"WITH {docs} SELECT {short}, {iso('created_at')} AS created_at FROM docs"
    sql["document_list_events"] = f"SELECT event_id AS id, {iso('ts')} AS created_at FROM events"
    newest = f"newest AS (SELECT * FROM docs ORDER BY created_at DESC, id DESC LIMIT 1000)"
    sql["select_ids"] = f"WITH {docs} SELECT {short} FROM docs WHERE document_type = '1-URGENT'"
    sql["select_ids_newest"] = f"WITH {docs}, {newest} SELECT {short} FROM newest WHERE document_type = '1-URGENT'"
    sql["public_json"] = "SELECT event_id, event_type || '=' || user_id AS public FROM events"
    n_issues = " + ".join(
        f"(f_{f} IN ('{C.MISSING}', '{C.INCORRECT}'))::BIGINT" for f in C.FIELDS
    )
    js_dbl = lambda p: f"json_extract_string(processing_timings, '$.{p}')"
    timings = (
        "CASE WHEN k = 8 THEN '' ELSE 'extraction_time=' || json_extract(processing_timings, '$.extraction_time')::DOUBLE"
        " || ';ocr_time=' || json_extract(processing_timings, '$.ocr_time')::DOUBLE || ';validation_time='"
        " || json_extract(processing_timings, '$.validation_time')::DOUBLE END"
    )
    sql["document_detail"] = f"""{fin} SELECT doc_id AS id, original_filename AS filename, status, confidence,
      page_count, v_total_amount AS total_amount, valid, {n_issues} + math_failed::BIGINT AS n_issues,
      {timings} AS timings FROM fin"""

    # --- joins
    children = f"""ch AS (
      SELECT document_id, 'extraction' AS kind, id AS child_id, engine AS label, created_at FROM extr
      UNION ALL SELECT document_id, 'review', seq, status, NULL FROM edits
      UNION ALL SELECT document_id, 'audit_log', id, event_type, created_at FROM audit)"""
    sql["document_with_children"] = f"""WITH {inv}, {i.EDITS}, {docs}, {extr}, {audit}, {children}
      SELECT d.id, filename, status, kind, child_id, label, ch.created_at AS child_created_at
      FROM docs d LEFT JOIN ch ON d.id = document_id"""
    sql["session_documents"] = f"""WITH {docs}, {sess} SELECT s.id AS session_id, name AS session_name,
      d.id AS document_id, filename, status FROM sess s LEFT JOIN docs d ON d.session_id = s.id"""
    pairs = " || ';' || ".join(f"'{f}=' || s_{f}" for f in sorted(C.FIELDS))
    low = " + ".join(f"(s_{f} IN ('{C.MISSING}', '{C.INCORRECT}'))::BIGINT" for f in C.FIELDS)
    exported = i.number("json_extract_string(a, '$.financials.total_amount')")
    sql["session_view"] = f"""{fin}, {sess} SELECT session_id, name AS session_name, doc_id AS document_id, status,
      v_document_number AS document_number, v_vendor_name_en AS vendor_name_en, v_document_date AS document_date,
      v_currency AS currency, coalesce({exported}, v_total_amount) AS total_amount, {pairs} AS field_states, {low} AS n_low
      FROM fin JOIN sess s ON s.id = session_id"""
    sql["recent_sessions"] = f"""WITH {docs}, {sess} SELECT s.id, name,
      (SELECT count(*) FROM docs WHERE session_id = s.id) AS n_documents, strftime(created_at, '%d %b %Y') AS created_on
      FROM (SELECT * FROM sess ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 10) s"""
    counted = lambda name, key, src: f"SELECT '{name}' AS table_name, count(*) AS n, sum({key})::BIGINT AS key_sum FROM {src}"
    kept = "document_id NOT IN (SELECT id FROM gone)"
    tail = (
        f"{counted('documents', 'id', 'docs WHERE id NOT IN (SELECT id FROM gone)')}"
        f" UNION ALL {counted('extractions', 'document_id', f'extr WHERE {kept}')}"
        f" UNION ALL {counted('reviews', 'document_id', f'edits WHERE {kept}')}"
        f" UNION ALL {counted('audit_logs', 'document_id', f'audit WHERE {kept}')}"
    )
    tables = f"WITH {inv}, {i.EDITS}, {docs}, {extr}, {audit}, {sess}"
    sql["delete_document"] = f"{tables}, gone AS (SELECT id FROM docs WHERE status = 'Rejected') {tail}"
    sql["delete_session"] = f"""{tables}, gone AS (SELECT id FROM docs WHERE session_id IN (SELECT id FROM sess WHERE created_at < '2001-06-01'::TIMESTAMP))
      {counted('sessions', 'id', "sess WHERE created_at IS NULL OR created_at >= '2001-06-01'::TIMESTAMP")} UNION ALL {tail}"""
    sql["attach_session"] = f"""WITH {docs} SELECT id, CASE WHEN status = 'Needs Review' THEN id + 1000000 ELSE session_id END
      AS session_id FROM docs"""
    sql["user_lookup"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)"

    # --- aggregations
    sql["docs_by_type"] = f"WITH {docs} SELECT document_type AS label, count(id) AS value FROM docs GROUP BY 1"
    sql["daily_trend"] = "SELECT ts::DATE AS label, count(*) AS value FROM events GROUP BY 1"
    sql["confidence_distribution"] = f"WITH {docs} SELECT confidence FROM docs"
    quantiles = ", ".join(f"quantile_disc(confidence, {p / 100}) AS q{p}" for p in (5, 25, 50, 75, 95))
    sql["confidence_summary"] = f"WITH {docs} SELECT count(*) AS counted, {quantiles} FROM docs"
    sql["audit_count"] = "SELECT count(event_id) AS value FROM events"
    sql["search_total"] = f"WITH {docs} SELECT count(*) AS total FROM docs WHERE json_output ILIKE '%customer#00000001%'"
    good = " + ".join(f"(s_{f} IN ('{C.VALID}', '{C.ABSENT}'))::BIGINT" for f in C.FIELDS)
    sql["session_accuracy"] = f"""{fin}, {sess} SELECT s.id AS session_id, coalesce(acc, 100.0)::DOUBLE AS accuracy
      FROM sess s LEFT JOIN (SELECT session_id, format('{{:.1f}}', sum({good})::DOUBLE / (count(*) * 16) * 100)::DOUBLE AS acc
      FROM fin GROUP BY 1) x ON s.id = x.session_id"""
    sql["session_pending"] = f"""WITH {docs} SELECT session_id, count(*) FILTER (status = 'Needs Review') AS pending,
      count(*) FILTER (status = 'Needs Review') > 0 AS review_required FROM docs GROUP BY 1"""
    sql["batch_summary"] = f"""WITH {docs} SELECT session_id, count(*) AS processed,
      count(*) FILTER (status = 'Approved') AS approved, count(*) FILTER (status = 'Needs Review') AS needs_review,
      ((2 * sum(id % 101) + count(*)) // (2 * count(*)))::BIGINT AS avg_confidence_pct FROM docs GROUP BY 1"""
    sql["session_name"] = f"""WITH {inv} SELECT session_id, arg_min(original_filename, doc_id)
      || CASE WHEN count(*) = 1 THEN '' ELSE ' and ' || (count(*) - 1) || ' other files' END AS name
      FROM inv GROUP BY 1"""
    hdr = lambda x: f"CASE WHEN is_first THEN {x} ELSE 0 END"
    ftr = lambda x: f"CASE WHEN is_last THEN {x} ELSE 0 END"
    whole = (
        "'========== HEADER ==========' || chr(10) || any_value(h) FILTER (is_first) || chr(10)"
        " || '========== BODY ==========' || chr(10) || " + i.strip("string_agg(cb, chr(10) ORDER BY page_no)")
        + " || chr(10) || '========== FOOTER ==========' || chr(10) || any_value(f) FILTER (is_last)"
    )
    sql["ocr_telemetry"] = f"""WITH {i.pages_cleaned()} SELECT doc_id,
      sum({hdr('h_tokens')} + b_tokens + {ftr('f_tokens')})::BIGINT AS tokens,
      sum({hdr('length(h)')} + length(b) + {ftr('length(f)')})::BIGINT AS raw_length,
      length({whole})::BIGINT AS compressed_length,
      sum({hdr('length(h)')})::BIGINT AS header_length, sum(length(cb))::BIGINT AS body_length,
      sum({ftr('length(f)')})::BIGINT AS footer_length,
      CASE WHEN bool_or((is_first AND h_reason = 'length') OR (is_last AND f_reason = 'length')) THEN 'length' ELSE 'stop' END
      AS done_reason FROM pgs_comp GROUP BY 1"""
    stages = " UNION ALL ".join(
        f"SELECT '{s}' AS stage, round(json_extract_string(processing_timings, '$.{s}')::DOUBLE * 10000)::BIGINT AS tick"
        " FROM inv WHERE k <> 8"
        for s in ("ocr_time", "extraction_time", "validation_time")
    )
    sql["stage_latency"] = f"""WITH {inv}, t AS ({stages}),
      r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY tick) AS rn, count(*) OVER (PARTITION BY stage) AS n FROM t)
      SELECT stage, count(*) AS documents, min(tick) / 10000.0::DOUBLE AS min_seconds,
        round(sum(tick) / 10000.0::DOUBLE / count(*), 4) AS avg_seconds,
        min(tick) FILTER (rn >= n * 0.95::DOUBLE) / 10000.0::DOUBLE AS p95_seconds FROM r GROUP BY 1"""
    sql["latency_by_days"] = sql["stage_latency"].replace("FROM inv ", "FROM inv_days ").replace(
        f"{inv}, t AS", f"{inv}, inv_days AS (SELECT * FROM inv WHERE created_at::DATE BETWEEN '1994-03-10' AND '1997-06-20'), t AS")
    sql["confidence_by_days"] = f"""WITH {docs} SELECT q::INTEGER AS quantile_no, n AS counted, true AS within_rank_error
      FROM (SELECT count(*) AS n FROM docs WHERE created_at::DATE BETWEEN '1994-03-10' AND '1997-06-20'), range(1, 6) r(q)"""
    sql["documents_of_days"] = sql["filter_date_range"]
    sql["doc_confidence"] = f"{fin} SELECT doc_id, confidence FROM fin"

    # --- ordered scans
    kept_lines = i.let(i.lines("text"), "a", "list_filter(a, lambda l, n: n = 1 OR l <> a[n - 1])")
    sql["dedupe_adjacent_lines"] = f"""WITH d AS (SELECT doc_id, {kept_lines} AS kept FROM documents)
      SELECT doc_id, array_to_string(kept, chr(10)) AS text, len(kept)::BIGINT AS n_lines FROM d"""
    islands = lambda share: f"""WITH a AS (SELECT user_id, ts, event_id,
        value > max(value) OVER (PARTITION BY user_id) * {share}::DOUBLE AS above FROM events),
      e AS (SELECT user_id, above AND NOT lag(above, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS edge FROM a)
      SELECT user_id, sum(edge::BIGINT)::BIGINT AS islands FROM e GROUP BY 1"""
    sql["island_count"] = islands("0.05")
    sql["island_count_tall"] = islands("0.4")
    sql["page_role"] = f"""WITH {i.PAGES}, r AS (SELECT *, page_no = min(page_no) OVER (PARTITION BY doc_id) AS is_first,
      page_no = max(page_no) OVER (PARTITION BY doc_id) AS is_last FROM pgs)
      SELECT doc_id, page_no, is_first, is_last, CASE WHEN is_first THEN header_text ELSE '' END AS header,
      CASE WHEN is_last THEN footer_text ELSE '' END AS footer FROM r"""
    sql["assemble_document_text"] = f"""WITH {i.pages_cleaned()} SELECT doc_id, 0::BIGINT AS segment, {whole} AS text
      FROM pgs_comp GROUP BY doc_id"""
    piece = (
        "CASE WHEN is_first THEN '========== HEADER ==========' || chr(10) || h || chr(10) || '========== BODY ==========' || chr(10)"
        " ELSE '' END || cb || CASE WHEN is_last THEN chr(10) || '========== FOOTER ==========' || chr(10) || f ELSE '' END"
    )
    # Every page of the data has a printed body, so each page adds its body and nothing is trimmed away.
    sql["assemble_document_segments"] = f"""WITH {i.pages_cleaned()}, p AS (SELECT doc_id, page_no,
      (page_no - min(page_no) OVER (PARTITION BY doc_id)) // 3 AS segment, {piece} AS piece FROM pgs_comp)
      SELECT doc_id, segment::BIGINT AS segment, string_agg(piece, chr(10) ORDER BY page_no) AS text FROM p GROUP BY 1, 2"""
    words = "len(string_split(text, ' '))"
    nonempty = words  # each chunk is a word and a blank, never empty
    req = "(conv_id * 100 + turn)"
    sql["assemble_token_stream"] = f"""SELECT {req} AS req_id, 0::BIGINT AS segment, {i.clean(i.strip("text || ' '"))} AS text,
      {nonempty}::BIGINT AS tokens, CASE WHEN {req} % 5 = 0 THEN 'length' ELSE 'stop' END AS done_reason FROM conversations"""

    # --- sort, limit
    sql["sort_by_any"] = f"WITH {docs} SELECT {short} FROM docs"
    sql["page_documents"] = f"""WITH {docs} SELECT {short} FROM docs ORDER BY confidence DESC, id DESC LIMIT 12 OFFSET 24"""
    sql["page_documents_unknown_sort"] = f"""WITH {docs} SELECT {short} FROM docs ORDER BY created_at DESC, id DESC
      LIMIT 12 OFFSET 12"""
    sql["page_ranked"] = f"""WITH {docs} SELECT {short} FROM docs ORDER BY confidence DESC, id DESC LIMIT 12 OFFSET 1068"""
    sql["page_after"] = f"""WITH {docs} SELECT {short} FROM docs WHERE (created_at, id) < ('1998-06-01'::TIMESTAMP, 700)
      ORDER BY created_at DESC, id DESC LIMIT 12"""
    sql["newest_n"] = f"WITH {docs}, {newest} SELECT {short} FROM newest"

    # --- keyed maintenance
    sql["dedupe_uploads"] = f"""WITH {inv}, {i.UPLOADS} SELECT name, size, last_modified, min(pos) AS pos FROM ups
      GROUP BY 1, 2, 3"""
    nested_total = i.number("(js->>'$.financials.total_amount')")
    review = lambda strict: f"""{stored}, e AS (
        SELECT s.*, s.id % 7 = 0 AS fixed, s.id % 11 = 0 AS rejected,
          '1,' || lpad((s.id % 1000)::VARCHAR, 3, '0') || '.50' AS e_total FROM stored s),
      r AS (SELECT *, {i.number('e_total')} AS n_total FROM e)
      SELECT id, CASE WHEN rejected THEN 'Rejected' WHEN fixed THEN 'Approved' ELSE status END AS status,
        CASE WHEN fixed OR rejected THEN 1.0::DOUBLE ELSE confidence END AS confidence, fixed OR rejected AS reviewed,
        CASE WHEN fixed THEN 'FIX-' || id ELSE js->>'$.document_number' END AS flat_number,
        CASE WHEN fixed THEN 'FIX-' || id ELSE js->>'$.document.number' END AS nested_number,
        CASE WHEN fixed THEN 'Corrected Vendor' ELSE js->>'$.vendor_name_en' END AS flat_vendor,
        {"CASE WHEN fixed THEN 'Corrected Vendor' ELSE js->>'$.vendor.name_en' END" if strict else "js->>'$.vendor.name_en'"}
          AS nested_vendor,
        CASE WHEN fixed THEN n_total ELSE (js->>'$.total_amount')::DOUBLE END AS flat_total,
        {f"CASE WHEN fixed THEN n_total ELSE {can['total_amount']} END" if strict else
         f"CASE WHEN fixed THEN coalesce({nested_total}, n_total) ELSE {can['total_amount']} END"} AS exported_total,
        {"CASE WHEN fixed THEN 'Corrected Vendor' ELSE coalesce(js->>'$.vendor.name_en', '') END" if strict else
         "coalesce(nullif(js->>'$.vendor.name_en', ''), CASE WHEN fixed THEN 'Corrected Vendor' END, js->>'$.vendor_name_en', '')"}
          AS exported_vendor_name_en,
        CASE WHEN fixed THEN 'FIX-' || id ELSE js->>'$.document_number' END AS exported_document_number,
        CASE WHEN fixed THEN 'USD' ELSE js->>'$.currency' END AS exported_currency,
        confidence AS kept_score, CASE WHEN rejected THEN false WHEN fixed THEN true ELSE valid END AS valid,
        CASE WHEN fixed OR rejected THEN 0 ELSE n_issues END AS n_issues,
        CASE WHEN rejected THEN '' WHEN fixed THEN 'currency=FOUND_AND_VALID;document_number=FOUND_AND_VALID;'
          || 'total_amount=FOUND_AND_VALID;vendor_name_en=FOUND_AND_VALID' END AS field_states
      FROM r JOIN (SELECT doc_id, {n_issues} + math_failed::BIGINT AS n_issues FROM fin) f ON f.doc_id = r.id"""
    sql["apply_review"] = review(False)
    sql["apply_review_strict"] = review(True)
    sql["review_audit"] = f"""WITH {inv}, {i.EDITS} SELECT document_id, 'reviewer' AS actor, 'reviewed' AS event_type,
      status FROM edits"""
    sql["session_reexport"] = f"""{stored} SELECT session_id, id,
      CASE WHEN id % 7 = 0 THEN 'FIX-' || id ELSE js->>'$.document_number' END AS document_number,
      CASE WHEN id % 7 = 0 THEN 'USD' ELSE js->>'$.currency' END AS currency,
      CASE WHEN id % 7 = 0 THEN coalesce({nested_total}, 1000.5 + id % 1000) ELSE {can['total_amount']} END AS total_amount
      FROM stored WHERE session_id IN (SELECT session_id FROM stored WHERE id % 7 = 0 OR id % 11 = 0)"""
    upd = "'{\"id\":' || id || '}'"
    sql["json_update"] = f"WITH {docs} SELECT id, CASE WHEN document_type = '2-HIGH' THEN {upd} ELSE json_output END AS json_output FROM docs"
    sql["json_update_audit"] = f"""WITH {docs} SELECT id AS document_id, 'system' AS actor, 'json_updated' AS event_type,
      {upd} AS payload FROM docs WHERE document_type = '2-HIGH'
      UNION ALL SELECT id, 'system', 'json_updated', '{{"z":"older"}}' FROM docs WHERE document_type = '2-HIGH' AND id % 2 = 0"""
    sql["upsert_latest"] = """WITH old AS (SELECT c_custkey AS user_id, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0),
      new AS (SELECT user_id, max(event_id) AS e, arg_max(event_type, event_id) AS t, arg_max(ts, event_id) AS ts FROM events GROUP BY 1)
      SELECT coalesce(old.user_id, new.user_id) AS user_id,
        CASE WHEN new.user_id IS NULL THEN c_name ELSE 'User ' || e END AS full_name,
        CASE WHEN old.user_id IS NULL THEN t ELSE c_mktsegment END AS email,
        CASE WHEN old.user_id IS NULL THEN ts END AS created_at, ts AS last_login
      FROM old FULL JOIN new ON old.user_id = new.user_id"""

    # --- scalar functions
    sql["fold_text"] = f"""WITH {inv} SELECT doc_id, {i.fold('text')} AS folded FROM documents
      UNION ALL SELECT doc_id, {i.fold('ocr_text')} FROM inv"""
    sql["fold_digits"] = f"WITH {inv} SELECT doc_id, {i.fold_digits('ocr_text')} AS folded FROM inv"
    cents = "lpad((c % 100)::VARCHAR, 2, '0')"
    whole_ = "(c // 100)::VARCHAR"
    grouped = f"regexp_replace({whole_}, '([0-9])([0-9]{{3}})$', '\\1,\\2')"
    amt = f"""am AS (SELECT l_orderkey, l_linenumber, CASE m WHEN 0 THEN {whole_} || '.' || {cents}
        WHEN 1 THEN replace({grouped}, ',', '.') || ',' || {cents} WHEN 2 THEN 'SAR ' || {grouped} || '.' || {cents}
        WHEN 3 THEN translate({whole_} || '٫' || {cents}, '0123456789', {q(i.ARABIC_INDIC)})
        WHEN 4 THEN {whole_} || ',' || {cents} || 'SAR' WHEN 5 THEN '$ ' || {grouped}
        ELSE 'n/a ' || l_linenumber || '-' || {cents} END AS raw
      FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT AS c, l_orderkey % 7 AS m FROM lineitem))"""
    sql["normalize_number_str"] = f"WITH {amt} SELECT *, {i.number_str('raw')} AS plain FROM am"
    sql["normalize_number"] = f"WITH {amt} SELECT *, {i.number('raw')} AS number FROM am"
    ascii_raw = f"translate(raw, {q(i.ARABIC_INDIC)}, '0123456789')"
    sql["parse_float_amount"] = f"WITH {amt} SELECT *, {i.parse_amount(ascii_raw)} AS number FROM am"
    runs = i.candidates("ocr_text")
    sql["amount_candidates"] = f"""WITH {inv} SELECT doc_id, len({runs})::BIGINT AS n, array_to_string({runs}, '|') AS runs
      FROM inv"""
    other = "(doc_id * 97 % 100000) / 100.0::DOUBLE"
    sql["amount_grounded"] = f"""{vals} SELECT doc_id, {i.amount_in('v_total_amount', 't_amounts')} AS total_grounded,
      {i.amount_in(other, 't_amounts')} AS other_grounded FROM vals"""
    named = ", ".join(f"{i.mentioned(f, 'lower(ocr_text)')} AS {f}" for f in C.FIELDS)
    sql["field_mentioned"] = f"WITH {inv} SELECT doc_id, {named} FROM inv"
    sql["normalize_currency"] = f"""WITH o AS (SELECT o_orderkey,
      ['Saudi Riyal', 'ر.س', 'USD', ' EUR ', '', 'SR', 'aed'][o_orderkey % 7 + 1] AS raw FROM orders)
      SELECT o_orderkey, raw, {i.currency('raw')} AS currency FROM o"""
    spellings = (
        "strftime(d, '%Y-%m-%d')", "day(d) || '-' || month(d) || '-' || year(d)", "strftime(d, '%Y/%m/%d')",
        "strftime(d, '%d/%m/%Y')", "strftime(d, '%m/%d/%Y')", "year(d) || '.' || month(d) || '.' || day(d)",
        "day(d) || strftime(d, '.%m.%Y')", "strftime(d, '%Y-%m-%dT%H:%M:%S')", "strftime(d, '%y-%m-%d')",
        "strftime(d, '%b ') || day(d) || strftime(d, ' %Y')", "strftime(d, '%Y-%m-%d ')",
    )
    cases = " ".join(f"WHEN {n} THEN {s}" for n, s in enumerate(spellings))
    dates = f"dt AS (SELECT o_orderkey, CASE o_orderkey % 12 {cases} ELSE '' END AS raw FROM (SELECT o_orderkey, o_orderdate AS d FROM orders))"
    # The other engine's reader accepts blanks at the end and short years; the rule wants neither.
    exact = f"CASE WHEN raw = trim(raw) AND regexp_matches(raw, '[0-9]{{4}}') THEN {i.date('raw')} END"
    sql["is_valid_date"] = f"WITH {dates} SELECT o_orderkey, raw, {exact} IS NOT NULL AS valid FROM dt"
    sql["normalize_date_iso"] = f"WITH {dates} SELECT o_orderkey, raw, strftime({exact}, '%Y-%m-%d') AS iso FROM dt"
    sql["is_empty_value"] = f"""SELECT event_id, event_id % 8 = 7
      OR {i.strip("['', ' null ', 'None', 'none', '0', ' ' || chr(9), 'x'][event_id % 7 + 1]")} IN ('', 'null', 'None')
      AS is_empty FROM events"""
    sql["parse_model_json"] = f"""WITH {inv}, w AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN raw_llm_response
        WHEN 1 THEN 'Here it is: ' || raw_llm_response || ' done.' WHEN 2 THEN '[' || raw_llm_response || ']'
        ELSE '[1]' END AS r FROM inv), p AS (SELECT doc_id, {i.model_json('r')} AS a FROM w)
      SELECT doc_id, a IS NOT NULL AS parsed, json_extract_string(a, '$.document.number') AS number FROM p"""
    flat = ", ".join(
        (f"coalesce({i.strip(f'json_extract_string(a, {q(C.FIELD_PATHS[f])})')}, '') AS {f}" if f == "currency" else f"v_{f} AS {f}")
        for f in C.FIELDS[:13]
    )
    sql["flatten_canonical"] = f"""{vals} SELECT doc_id, coalesce(nullif(json_extract_string(a, '$.document_type'), ''), 'invoice')
      AS document_type, {flat} FROM vals"""
    total = i.money("round(o_totalprice * 100)::BIGINT")
    alias = f"""al AS (SELECT o_orderkey AS id, '{{' || CASE WHEN o_orderkey % 3 = 0
        THEN '"document":{{"number":"","date":null}},"invoice_number":' ELSE '"number":' END || '"INV-' || o_orderkey
        || '","vendor_name_en":" ' || o_orderpriority || ' ","invoice_date":"' || strftime(o_orderdate, '%Y-%m-%d')
        || '","financials":{{"subtotal":0,"total_amount":' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || {total} || ' SAR"'
        ELSE '""' END || '}},"subtotal":' || {total} || ',"vat_amount":"' || o_custkey || ',50","grand_total":' || {total}
        || ',"po_number":"PO' || o_custkey || CASE WHEN o_orderkey % 5 = 0 THEN '","type":"receipt"}}' ELSE '"}}' END AS js
      FROM orders)"""
    can_alias = i.canonical("js")
    sql["map_to_canonical"] = f"""WITH {alias} SELECT id, {', '.join(f'{can_alias[f]} AS {f}' for f in C.CANONICAL_FIELDS)}
      FROM al"""
    leaves = {
        "document": ("number", "date", "currency"),
        "vendor": ("name_ar", "name_en", "vat_number", "address_ar", "address_en"),
        "customer": ("name_ar", "name_en", "address_ar", "address_en"),
        "metadata": ("purchase_order", "reference_number", "payment_terms", "notes"),
    }
    leaf_paths = ["document_type"] + [f"{s}.{n}" for s, names in leaves.items() for n in names]
    text_leaves = " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS path, json_extract_string(a, '$.{p}') AS value FROM m" for p in leaf_paths
    )
    # Numbers come back without trailing zeros.
    number_leaves = " UNION ALL ".join(
        f"SELECT doc_id, 'financials.{n}', regexp_replace(json_extract_string(a, '$.financials.{n}')::VARCHAR, '[.]0$', '') FROM m"
        for n in C.AMOUNT_FIELDS
    )
    sql["flatten_json"] = f"""WITH {inv}, m AS MATERIALIZED (SELECT doc_id, {i.model_json('raw_llm_response')} AS a FROM inv WHERE k <> 8)
      {text_leaves} UNION ALL {number_leaves}
      UNION ALL SELECT doc_id, 'vendor.phone', json_extract_string(a, '$.vendor.phone') FROM m
      UNION ALL SELECT doc_id, 'metadata.extra.b.c.d.e.f.g', 'deep' FROM m WHERE doc_id % 10 = 3"""
    flat_paths = {"document_number": "document.number", "document_date": "document.date",
                  "vendor_name_en": "vendor.name_en", "notes": "metadata.notes", "document_type": "document_type"}
    sql["flatten_object"] = f"""{vals} SELECT doc_id,
      {', '.join(f"json_extract_string(a, '$.{p}') AS {n}" for n, p in flat_paths.items())} FROM vals"""
    sql["json_path_get"] = """SELECT event_id, json_extract_string(props, '$.k') AS k,
      json_extract_string(props, '$.k.deeper') AS deeper, json_extract_string(props, '$.absent') AS absent FROM events"""
    sql["iso_day_bounds"] = """SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day_start,
      date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS next_day_start FROM events"""
    sql["normalize_issues"] = """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '' ELSE event_type || '|warning|m' || event_id
      || chr(10) || 'document|error|n' END AS issues FROM events"""
    sql["safe_basename"] = "SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name FROM pages"
    sql["initials"] = """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN '  '
        WHEN c_custkey % 3 = 0 THEN replace(c_name, '#', ' ') WHEN c_custkey % 3 = 1 THEN c_name
        ELSE ' ' || lower(c_mktsegment) || '  ' || lower(c_name) || ' x' END AS name FROM customer),
      w AS (SELECT c_custkey, list_filter(string_split(name, ' '), lambda x: x <> '') AS p FROM n)
      SELECT c_custkey, CASE WHEN len(p) > 1 THEN upper(left(p[1], 1)) || upper(left(p[2], 1))
        WHEN len(p) = 1 THEN upper(left(p[1], 1)) ELSE 'U' END AS initials FROM w"""
    sql["timings_map"] = f"""WITH {inv} SELECT doc_id, CASE WHEN k = 8 THEN 0 ELSE 3 END::BIGINT AS n,
      CASE WHEN k <> 8 THEN (doc_id % 977 + 10) / 100.0::DOUBLE END AS ocr_time,
      CASE WHEN k <> 8 THEN (doc_id % 499 + 100) / 100.0::DOUBLE END AS extraction_time FROM inv"""
    sql["json_payload"] = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '{"event_type":"' || event_type
      || '","who":{"event_id":' || event_id || ',"user_id":' || user_id || '},"note":"نعم"}' END AS payload FROM events"""
    sql["download_json"] = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 2 = 0 THEN '{"x":1}'
      ELSE '{}' END AS payload FROM events"""
    sql["display_ts"] = """SELECT event_id, strftime(ts, '%d %b %Y, %I:%M %p') AS shown,
      strftime(ts, '%d %b %Y') AS shown_day FROM events"""
    sql["status_slug"] = f"WITH {docs} SELECT id, replace(lower(status), ' ', '_') AS slug FROM docs"

    # --- document text
    tag = q("</?[a-zA-Z][^>]*>")
    sql["has_html"] = f"""SELECT page_id AS id, regexp_matches(html, {tag}) AS has_html FROM pages
      UNION ALL SELECT doc_id, regexp_matches(text, {tag}) FROM documents"""
    def decoded(x: str) -> str:
        """The references that occur in the pages; an ampersand is put in last, so that one level is decoded."""
        for entity, char in (("&amp;", "\x03"), ("&amp", "\x03"), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'),
                             ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("\x03", "&")):
            x = f"replace({x}, {q(entity)}, {q(char)})"
        return x

    gaps = f"regexp_replace({decoded(bare_of('html'))}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g')"
    sql["strip_tags_simple"] = f"SELECT page_id, {i.strip(gaps)} AS text FROM pages"
    blocks = "p|div|h[1-6]|li|tr|table|br|section|body|html"
    # The only markup inside a script of these pages is the closing tag in a text constant.
    steps = "replace(html, '\"</p>\"', '\"' || chr(2) || '/p>\"')"
    for pattern, by in ((r"(?s)<!--.*?-->", ""), (rf"(?i)</?({blocks})([ /\t\n][^>]*)?>", "\x01"), (r"<[^>]*>", ""), (r"<[^>]*$", "")):
        steps = f"regexp_replace({steps}, {q(pattern)}, {q(by)}, 'g')"
    tail = "regexp_replace(t, '[^\x01>]*&[^&\\t\\n\\f\\r ;]{0,33}$', '')"
    marked = f"regexp_replace({decoded('t')}, '(^|\\n)\x01+', '\\1', 'g')"
    broken = f"regexp_replace(regexp_replace({marked}, '\x01+', chr(10), 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')"
    sql["strip_html"] = f"""WITH a AS (SELECT page_id, html, {steps} AS t FROM pages),
      b AS (SELECT page_id, CASE WHEN regexp_matches(html, '&[^&\\t\\n\\f\\r ;<>]{{0,33}}$') THEN {tail} ELSE t END AS t FROM a)
      SELECT page_id, {i.strip(f"replace({broken}, chr(2), '<')")} AS text FROM b"""
    sql["clean_ocr"] = f"SELECT doc_id, {i.clean('text')} AS text FROM documents"
    sql["compress_table"] = f"WITH {i.pages_cleaned()} SELECT doc_id, page_no, cb AS compressed_body FROM pgs_comp"

    # --- validation
    each = lambda fn: " UNION ALL ".join(fn(n, f) for n, f in enumerate(C.FIELDS, 1))
    sql["unpivot_fields"] = f"""{vals} {each(lambda n, f: f"SELECT doc_id, {n}::INTEGER AS position, '{f}' AS field, v_{f}::VARCHAR AS value FROM vals")}"""
    sql["field_state"] = f"""{st}, m AS MATERIALIZED (SELECT doc_id, {', '.join(f's_{f}' for f in C.FIELDS)} FROM st)
      {each(lambda n, f: f"SELECT doc_id, '{f}' AS field, s_{f} AS state FROM m")}"""
    sql["field_confidence"] = f"""{st}, m AS MATERIALIZED (SELECT doc_id, {', '.join(f's_{f}' for f in C.FIELDS)} FROM st)
      {each(lambda n, f: f"SELECT doc_id, '{f}' AS field, ({i.score(f)}) / 100.0::DOUBLE AS confidence FROM m")}"""
    sql["amount_grounding"] = f"""{vals} SELECT doc_id, {', '.join(f"{i.amount_in(f'v_{f}', 't_amounts')} AS {f}" for f in C.AMOUNT_FIELDS)}
      FROM vals"""
    sql["date_grounding"] = f"{vals} SELECT doc_id, {i.grounded('document_date')} AS grounded FROM vals"
    sql["currency_grounding"] = f"{vals} SELECT doc_id, {i.grounded('currency')} AS grounded FROM vals"
    texts = [f for f in C.FIELDS[:10] if f not in ("document_date", "currency")]
    sql["text_grounding"] = f"{vals} SELECT doc_id, {', '.join(f'{i.grounded(f)} AS {f}' for f in texts)} FROM vals"
    sql["math_check"] = f"{st} SELECT doc_id, math_failed, s_total_amount AS total_state FROM st"

    def issue(field: str) -> str:
        missing = "error" if field in ("document_number", "total_amount") else "warning"
        wrong = "error" if field == "document_number" else "warning"
        v = f"v_{field}::VARCHAR"
        if field in C.AMOUNT_FIELDS:
            message = f"'Amount ''' || {v} || ''' for ''{field}'' not found in OCR text.'"
        elif field == "document_date":
            message = (
                f"CASE WHEN {i.date(f'v_{field}')} IS NULL THEN 'Document date ''' || {v} || ''' is not a valid date format.'"
                f" ELSE 'Date digits from ''' || {v} || ''' are not grounded in OCR text.' END"
            )
        elif field == "currency":
            message = f"'Currency ''' || {v} || ''' is not grounded in OCR text.'"
        else:
            message = f"'Field ''{field}'' value ''' || {v} || ''' is not present in OCR text.'"
        return (
            f"CASE f_{field} WHEN '{C.MISSING}' THEN '{field}|{missing}|Field ''{field}'' exists in OCR but was not extracted.'"
            f" WHEN '{C.INCORRECT}' THEN '{field}|{wrong}|' || {message} END"
        )

    math_text = (
        "CASE WHEN math_failed THEN 'total_amount|error|Math check failed: subtotal (' || v_subtotal || ') + tax (' || v_tax_amount"
        " || ') = ' || printf('%.2f', v_subtotal + v_tax_amount) || ', but total is ' || v_total_amount || '.' END"
    )
    issue_text = "concat_ws(chr(10), " + ", ".join([issue(f) for f in C.FIELDS] + [math_text]) + ")"
    sql["issues"] = f"{st} SELECT doc_id, {issue_text} AS issues FROM st"
    weight = {"document_number": 20, "vat_number": 15, "document_date": 15}
    penalty = " + ".join(
        f"CASE WHEN f_{f} IN ('{C.MISSING}', '{C.INCORRECT}') THEN {weight.get(f, 5)} ELSE 0 END" for f in C.FIELDS
    )
    sql["penalties"] = f"""{st} SELECT doc_id, ({penalty} + CASE WHEN math_failed THEN 20 ELSE 0 END) / 100.0::DOUBLE
      AS penalty_total FROM st"""
    sql["valid_flag"] = f"{fin} SELECT doc_id, valid FROM fin"
    sql["document_status"] = f"{fin} SELECT doc_id, status FROM fin"
    badge = " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, ({i.score(f)}) / 100.0::DOUBLE AS confidence, ({i.score(f)}) < 80 AS needs_review FROM m"
        for f in C.FIELDS
        if f in C.CANONICAL_FIELDS
    )
    sql["review_badge"] = f"""{st}, m AS MATERIALIZED (SELECT doc_id, {', '.join(f's_{f}' for f in C.FIELDS)} FROM st) {badge}
      UNION ALL SELECT doc_id, unnest(['reference_number', 'document_type']), 1.0::DOUBLE, false FROM m"""
    sql["currency_in_place"] = f"{vals} SELECT doc_id AS document_id, v_currency AS flat, v_currency AS nested FROM vals"
    seconds = "CASE WHEN k = 8 THEN 0.0 ELSE round((doc_id % 977 + doc_id % 499 + 110) / 100.0::DOUBLE + (doc_id % 7) / 100.0::DOUBLE, 4) END"
    sql["process_documents"] = f"""{fin} SELECT doc_id AS document_id, original_filename AS filename, 'invoice' AS document_type,
      status, confidence, 'qwen_llm' AS extraction_engine, valid, {issue_text} AS issues, {pairs} AS field_states,
      v_document_number AS document_number, v_vendor_name_en AS vendor_name_en, v_currency AS currency,
      v_total_amount AS total_amount, length(ocr_text)::BIGINT AS text_length, page_count,
      {seconds}::DOUBLE AS processing_time, file_path,
      CASE WHEN json_type(a, '$.financials.total_amount') = 'VARCHAR' THEN json_extract_string(a, '$.financials.total_amount') END
        AS raw_total, json_extract_string(a, '$.vendor.phone') AS vendor_phone FROM fin"""

    # --- pages to verdict: pages of 25 characters, cleaned and joined again, judged as one text
    cut = """pgs AS (SELECT doc_id, p AS page_no, '' AS header_text, ocr_text[25 * p + 1 : 25 * p + 25] AS body_text,
      '' AS footer_text, 1 AS total_lines FROM (SELECT doc_id, ocr_text, unnest(range((length(ocr_text) - 1) // 25 + 1)) AS p FROM inv))"""
    joined = f"""{i.pages_cleaned().replace(i.PAGES, cut)},
      texts AS (SELECT doc_id, {whole} AS page_text FROM pgs_comp GROUP BY doc_id),
      judged AS (SELECT inv.* REPLACE (page_text AS ocr_text) FROM inv JOIN texts USING (doc_id))"""
    penalty = " + ".join(
        f"CASE WHEN f_{f} IN ('{C.MISSING}', '{C.INCORRECT}') THEN {C.PENALTY.get(f, C.PENALTY['other'])} ELSE 0 END" for f in C.FIELDS
    )
    chain = i.scored().replace("FROM inv)", "FROM judged)")
    sql["process_pages"] = f"""WITH {inv}, {joined}, {chain} SELECT doc_id, status, confidence, valid,
      CASE WHEN math_failed THEN {C.PENALTY['math']} ELSE 0 END + {penalty} AS penalty, length(ocr_text)::BIGINT AS text_length,
      {issue_text} AS issues, {pairs} AS field_states FROM fin"""
    sql["process_pages_short_spans"] = sql["process_pages"]

    # --- staged design
    def labelled(label: str) -> str:
        pattern = f"(?im)^[ \\t]*{label}[ \\t]*(?:[:#]|[ \\t])[ \\t]*([^\\n]*[^\\s])[ \\t]*$"
        return f"nullif(regexp_extract(ocr_text, {q(pattern)}, 1), '')"

    def code(x: str) -> str:
        names = "|".join(C.CURRENCY_CODES)
        found = f"nullif(regexp_extract(upper({x}), '(?:^|[^\\p{{L}}\\p{{N}}])({names})(?:$|[^\\p{{L}}\\p{{N}}])', 1), '')"
        return f"coalesce({found}, CASE WHEN {i.any_word(f'lower({x})', C.RIYAL_NAMES)} THEN 'SAR' END)"

    label_cols = {
        f: "coalesce(" + ", ".join(labelled(l) for l in labels) + ")" for f, labels in C.FIELD_LABELS.items() if labels
    }
    label_cols["currency"] = code("ocr_text")
    sql["label_extract"] = f"WITH {inv} SELECT doc_id, {', '.join(f'{e} AS {f}' for f, e in label_cols.items())} FROM inv"
    held = ", ".join(q(p) for p in C.PLACEHOLDERS)
    sql["reject_placeholder"] = f"""WITH r AS (SELECT event_id, [{held}, 'Acme', ' Client ', 'customer'][event_id % 12 + 1] AS raw
      FROM events) SELECT event_id, CASE WHEN trim(raw) NOT IN ({held}) THEN raw END AS value FROM r"""
    vat = "CASE WHEN doc_id % 3 = 0 THEN left(v_vat_number, doc_id % 16) ELSE v_vat_number END"
    sql["vat_format_ok"] = f"""{vals} SELECT doc_id, coalesce(regexp_full_match({vat}, '[A-Za-z0-9]{{10,20}}'), false) AS ok,
      coalesce(regexp_full_match({vat}, '[0-9]{{15}}'), false) AS ksa FROM vals"""
    usd = "lang || ' usd, ' || text"
    sql["currency_code"] = f"""WITH {inv} SELECT doc_id, {code('ocr_text')} AS code FROM inv
      UNION ALL SELECT doc_id, {code(usd)} FROM documents"""
    source = {"vendor_name": "vendor_name_en", "customer_name": "customer_name_en"}
    value = {f: f"nullif(v_{source.get(f, f)}::VARCHAR, '')" for f in C.STAGED_FIELDS}
    score = {f: f"((doc_id + {n}) % 101)" for n, f in enumerate(C.STAGED_FIELDS)}
    weighted = " + ".join(f"{score[f]} * {w}" for f, w in C.FIELD_WEIGHTS.items())
    nulls = " + ".join(f"({value[f]} IS NULL)::INTEGER" for f in C.STAGED_FIELDS)
    sql["weighted_confidence"] = f"""{vals} SELECT doc_id, ({weighted})::BIGINT AS score,
      ({weighted} - 500 * ({nulls}))::BIGINT AS score_less_penalties FROM vals"""
    sql["merge_field_results"] = f"""{vals} SELECT doc_id, {', '.join(f'{value[f]} AS {f}' for f in C.STAGED_FIELDS)},
      'vendor_name: ' || coalesce(v_vendor_name_en, '') AS vendor_evidence, {score['total_amount']}::BIGINT AS total_score FROM vals"""
    occurs = lambda x: f"coalesce({i.fold(x)} <> '' AND contains(t_fold, {i.fold(x)}), false)"
    ev = lambda f: f"('{f}: ' || coalesce(v_{source.get(f, f)}::VARCHAR, ''))"
    sql["evidence_grounded"] = vals + " " + " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, {occurs(value[f])} OR {occurs(ev(f))} AS grounded FROM vals" for f in C.STAGED_FIELDS
    )
    sql["export_9col"] = f"""{vals} SELECT doc_id, {', '.join(f'{value[f]} AS "{t}"' for t, f in C.STAGED_EXPORT_COLUMNS)} FROM vals"""
    long = " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, {value[f]} AS value, {label_cols[f]} AS expected FROM vals" for f in C.STAGED_FIELDS
    )
    right = lambda x: f"coalesce({i.fold(x)} = {i.fold('coalesce(expected, chr(32))')}, false)::BIGINT"
    null_as_text = lambda x: f"coalesce({x}, '')"
    sql["engine_compare"] = f"""{vals}, lg AS MATERIALIZED ({long}),
      e AS (SELECT 'single' AS engine, field, {right("coalesce(value, '')")} AS ok FROM lg
        UNION ALL SELECT 'staged', field, {right("CASE WHEN doc_id % 13 = 0 THEN '' ELSE coalesce(value, '') END")} FROM lg)
      SELECT engine, field, count(*) AS n, sum(ok)::BIGINT AS n_right, round(sum(ok)::DOUBLE / count(*), 4) AS accuracy
      FROM e GROUP BY 1, 2"""

    # --- streams
    sql["stream_process"] = f"""{fin} SELECT doc_id AS id, original_filename AS filename, status, confidence,
      v_document_number AS document_number FROM fin"""
    # Repeats within the hour fall away; a day later every file is new again.
    sql["stream_dedupe"] = f"""WITH {inv}, {i.UPLOADS} SELECT DISTINCT name, size, last_modified, day::BIGINT AS day FROM ups, (VALUES (0), (1)) d(day)"""
    sql["with_model_response"] = f"""WITH {inv} SELECT doc_id, '{{"n":' || length(ocr_text) || '}}' AS raw_llm_response FROM inv"""
    sql["sql_functions"] = f"""WITH {amt} SELECT l_orderkey AS id, l_linenumber AS part, {i.number_str('raw')} AS text,
      {i.number('raw')} AS number FROM am UNION ALL SELECT doc_id, 0, {i.fold('text')}, NULL FROM documents"""
    sql["sql_amounts"] = f"""WITH {inv}, r AS (SELECT doc_id, {runs} AS found FROM inv)
      SELECT doc_id, (unnest(range(1, len(found) + 1)) - 1)::INTEGER AS pos, unnest(found) AS run FROM r"""
    sql["sql_leaves"], sql["sql_fields"] = sql["flatten_json"], sql["unpivot_fields"]
    sql["stream_trend"] = "SELECT ts::DATE AS label, count(*) AS value FROM events GROUP BY 1"
    sql["stream_tokens"] = sql["assemble_token_stream"]
    return sql
