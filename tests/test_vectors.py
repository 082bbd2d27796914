"""Scalar rules on hand-derived inputs."""

import pytest
from pyspark.sql import functions as F

from docproof import constants as C
from docproof.functions import canonical, currency, dates, jsonio, numbers, sqlfuncs, text
from docproof.functions.html import strip_html, strip_tags_simple
from docproof.operators import fieldrules

NUMBERS = {
    "28.100,31": 28100.31, "28,100.31": 28100.31, "1,180": 1180.0, "100,5": 100.5, "100,50SAR": 10050.0,
    "١٬١٨٠٫٥٠": 1180.5, "١١٨٠٫٥٠": 1180.5, "1.2.3": None, "INV-5": -5.0, "-": None, "": None, "1 180.00": 1180.0,
    "12-05": None, "۸۹": 89.0, "1,234,56": None, "SAR 5": 5.0, ".": None, " 1,180.00.": None, "1e5": 15.0,
    "1 000 000,00": 1000000.0, "1 180.00": 1180.0, "१२": 12.0,
}
AMOUNTS = {"100,50": 10050.0, "$1,180.00": 1180.0, "SAR 5": 5.0, "1e5": 15.0, "٫5": None, "abc": None, "": None}
DATES = {
    "2026-06-01": "2026-06-01", "2026-6-1": "2026-06-01", "31-12-2026": "2026-12-31", "12/31/2026": "2026-12-31",
    "31/12/2026": "2026-12-31", "2026.6.1": "2026-06-01", "2026-06-01T10:00:00": "2026-06-01", "03/04/2026": "2026-04-03",
    "2026-02-30": None, "26-06-01": None, "02026-06-01": None, "2026-06-01 ": None, "": None, "2026/06/01": "2026-06-01",
}
FOLDS = {"فَاتُورَة رقم ١٢٣": "فاتورةرقم123", "۸۹-AB_c é": "۸۹abcé", "Ⅷ½": "ⅷ½", "a̲b": "ab", "": ""}
CURRENCIES = {"Saudi Riyal": "SAR", "ر.س": "SAR", "USD": "USD", " EUR ": "EUR", "": "", None: ""}


def run(spark, fn, inputs, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]


@pytest.mark.parametrize(
    ("fn", "table"),
    [
        (numbers.normalize_number, NUMBERS),
        (numbers.parse_float_amount, AMOUNTS),
        (dates.normalize_date_iso, DATES),
        (text.fold_text, FOLDS),
        (currency.normalize_currency, CURRENCIES),
    ],
)
def test_table(spark, fn, table):
    assert run(spark, fn, list(table)) == list(table.values())


def test_valid_dates(spark):
    assert run(spark, dates.is_valid_date, list(DATES)) == [d is not None for d in DATES.values()]


def test_strict_fold_adds_persian_eight_and_nine(spark):
    assert run(spark, lambda c: text.fold_text(c, strict=True), ["۸۹"]) == ["89"]


def test_amounts_merge_across_lines(spark):
    sample = "Sub 1,000.00\n150.00 VAT; Total: ١١٥٠٫٠٠ x 7 ROWS"
    runs = run(spark, numbers.amount_candidates, [sample])[0]
    assert runs == [" 1,000.00\n150.00 ", " ", " ١١٥٠٫٠٠ ", " 7 "]
    grounded = lambda v, strict: run(spark, lambda c: numbers.amount_grounded(F.lit(v), c, strict), [sample])[0]
    assert [grounded(v, False) for v in (1000.0, 150.0, 1150.0, 7.0)] == [False, False, True, True]
    assert [grounded(v, True) for v in (1000.0, 150.0, 1150.0, 7.0)] == [True, True, True, True]


def test_model_json(spark):
    inputs = ['```json\n{"a":1}\n```', 'pre {"a":1} post', '[{"a":1}]', "[1]", "no", '{"a":NaN}', '{"a":1} {"b":2}', '"x"']
    out = run(spark, lambda c: F.to_json(jsonio.parse_model_json(c)), inputs)
    assert out == ['{"a":1}', '{"a":1}', '{"a":1}', None, None, None, None, None]


def test_clean_ocr(spark):
    assert run(spark, text.clean_ocr, ["a  b\r\na b\n\n\n c d\nc d\nA", "", " \n ", "x\n"]) == ["a b\n\nc d\nA", "", "", "x"]


def test_compress_table(spark):
    five = "a\nb Qty\nc\nd\ne"
    out = lambda n: run(spark, lambda c: text.compress_table(c, F.lit(n)), [five, "no words here"])
    assert out(9) == ["a\nb Qty\nc\n[PRODUCT TABLE REMOVED - 6 ROWS]", "no words here"]
    assert out(2)[0].endswith("- 1 ROWS]")
    short = run(spark, lambda c: text.compress_table(c, F.lit(9)), ["qty"])
    assert short == ["qty\n[PRODUCT TABLE REMOVED - 8 ROWS]"]


def test_files(spark):
    names = ["a/b/c.PDF", "c.tar.gz", ".bashrc", "noext", "dir/", "x.", "..a.png"]
    assert run(spark, text.safe_basename, names) == ["c.PDF", "c.tar.gz", ".bashrc", "noext", "dir", "x.", "..a.png"]
    assert run(spark, text.file_suffix, ["c.PDF", "c.tar.gz", ".bashrc", "noext", "..a.png"]) == [".PDF", ".gz", "", "", ".png"]
    assert run(spark, text.file_stem, ["c.PDF", "c.tar.gz", ".bashrc"]) == ["c", "c.tar", ".bashrc"]


def test_small_text_rules(spark):
    assert run(spark, text.initials, ["ada lovelace x", "ada", "", None, "  "]) == ["AL", "A", "U", "U", "U"]
    assert run(spark, text.is_empty_value, ["", " null ", "None", "none", None, "0"]) == [True, True, True, False, True, False]
    assert run(spark, text.status_slug, ["Needs Review Now"]) == ["needs_review_now"]


def test_number_text(spark):
    values = [1180.0, 0.5, 12345678.9, 10000000.0, 99999999999.25, 0.0]
    assert run(spark, numbers.number_text, values, "double") == [repr(v) for v in values]


def test_issue_list(spark):
    raw = '[{"field":"f","message":"m","severity":"error"},{"message":"n"},"x",3]'
    out = run(spark, jsonio.normalize_issues, [raw, '{"a":1}', "bad", None])
    assert [tuple(r) for r in out[0]] == [("f", "m", "error"), ("document", "n", "warning")]
    assert out[1:] == [[], [], []]


def test_canonical_of_demo_record(spark):
    from docproof.constants import DEMO_JSON

    df = spark.createDataFrame([(DEMO_JSON,)], "j string").select(
        *canonical.canonical_columns(jsonio.read_object(F.col("j")))
    )
    row = df.first().asDict()
    assert row["document_number"] == "INV-1001" and row["document_date"] == "2026-06-01"
    assert row["vendor_name_en"] == "" and row["customer_name_en"] == ""
    assert (row["currency"], row["document_type"]) == ("USD", "invoice")
    assert (row["subtotal"], row["tax_amount"], row["total_amount"]) == (1000.0, 180.0, 1180.0)


def test_truthiness_decides_between_places(spark):
    text = lambda field: lambda c: canonical.canonical_text(jsonio.read_object(c), field)
    amount = lambda c: canonical.canonical_amount(jsonio.read_object(c), "total_amount")
    nothing = ["0", "0.0", "false", "{}", "[]", '""', "null"]
    raw = [f'{{"document":{{"number":{v}}},"document_number":"A1"}}' for v in nothing]
    assert run(spark, text("document_number"), raw) == ["A1"] * len(nothing)
    assert run(spark, text("currency"), [f'{{"currency":{v}}}' for v in nothing]) == [""] * len(nothing)
    assert run(spark, text("currency"), ['{"currency":true}', '{"currency":[1]}', '{"currency":"0"}']) == ["True", "[1]", "0"]
    assert run(spark, amount, [f'{{"financials":{{"total_amount":{v}}},"total_amount":7}}' for v in nothing]) == [7.0] * len(nothing)
    kinds = [f'{{"document_type":{v}}}' for v in nothing] + ['{"document_type":"receipt"}', "{}"]
    assert run(spark, lambda c: canonical.flat_document_type(jsonio.read_object(c)), kinds) == ["invoice"] * len(nothing) + ["receipt", "invoice"]


def test_one_decimal_rounds_the_binary_value(spark):
    from docproof.operators.analytics import one_decimal

    values = [k / n * 100 for n in (16, 48, 160, 1000, 2000, 3200, 7) for k in range(n + 1)]
    assert run(spark, one_decimal, values, "double") == [float("%.1f" % v) for v in values]


def test_canonical_zero_falls_through(spark):
    raw = ['{"financials":{"subtotal":0},"subtotal":5}', '{"financials":{"subtotal":0}}', '{"subtotal":0}',
           '{"financials":{"subtotal":"x"},"subtotal":5}']
    out = run(spark, lambda c: canonical.canonical_amount(jsonio.read_object(c), "subtotal"), raw)
    assert out == [5.0, None, 0.0, None]


PAGES = {
    "<p>a</p><p>b &amp; c</p>": "a\nb & c",
    '<script>var t="</p>";</script>x': 'var t="</p>";x',
    "<SCRIPT>a &amp; <b></SCRIPT >x<style>": "a &amp; <b>x",
    "<!-- c > --><b>x</b>y": "xy",
    "plain < text >": "plain < text >",
    "<p>a</p>tail &am": "a",
    "<p>a</p>tail & more": "a\ntail & more",
    "<div>a\n\n\n\n\nb</div>": "a\n\nb",
    "<p>x</p><![foo[bar]]>tail": "x\n\n\ntail".replace("\n\n\n", "\n\n"),
    "<b>x</b><![CDATA[y]]>z": "xz",
    "<b>never <i closed": "never",
    '<a title="x>y" class=z>t</a> < u': "t < u",
    "<b>&#65;&#x42;&#128;&#0;&copy&notit;&bogus;</b>": "AB€�©¬it;&bogus;",
    "no tags &amp;": "no tags &amp;",
    "<br/><hr><br>a<br/><br/>b": "a\nb",
}


def test_strip_html(spark):
    assert run(spark, strip_html, [*PAGES, None]) == [*PAGES.values(), None]
    assert run(spark, strip_tags_simple, ["<p>a</p>b &amp;lt; c&nbsp;d &#39;"]) == ["a\nb &lt; c\xa0d '"]


def test_strip_html_takes_very_long_tags_and_texts(spark):
    tag = "<p " + "a='b' c=\"d\" " * 20_000 + ">"
    assert run(spark, strip_html, [tag + "x " * 100_000 + "</p>", "<" * 50_000 + "<b>x"]) == [("x " * 100_000).strip(), "<" * 50_000 + "x"]


def test_strip_html_runs_no_python(spark):
    plan = spark.range(1).select(strip_html(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan


def test_sql_functions_agree_with_columns(spark):
    names = sqlfuncs.register(spark)
    assert "dp_fold_text" in names
    inputs = list(NUMBERS) + list(AMOUNTS) + list(DATES) + list(FOLDS) + ["Saudi Riyal", " EUR "]
    df = spark.createDataFrame([(v,) for v in inputs], "v string")
    df.createOrReplaceTempView("sql_inputs")
    by_sql = spark.sql(
        "SELECT v, dp_fold_text(v) a, dp_normalize_number(v) b, dp_parse_amount(v) c, dp_is_valid_date(v) d,"
        " dp_normalize_currency(v) e, dp_is_empty_value(v) f, dp_date_iso(v) g, dp_amount_grounded(5.0D, v) h FROM sql_inputs"
    )
    v = F.col("v")
    by_column = df.select(
        "v", text.fold_text(v), numbers.normalize_number(v), numbers.parse_float_amount(v), dates.is_valid_date(v),
        currency.normalize_currency(v), text.is_empty_value(v), dates.normalize_date_iso(v),
        numbers.amount_grounded(F.lit(5.0), v),
    )
    assert [tuple(r) for r in by_sql.collect()] == [tuple(r) for r in by_column.collect()]


def test_brackets_in_quoted_text_do_not_hide_levels(spark):
    df = spark.createDataFrame([(r'{"x":"a\"}}}\"b\\","a":{"b":{"c":{"d":1}}}}',)], "j string")
    leaves = df.select(F.inline(jsonio.flatten_json(F.parse_json("j")))).collect()
    assert {r["path"]: r["value"] for r in leaves} == {"x": 'a"}}}"b\\', "a.b.c.d": "1"}


def test_further_sql_functions_agree_with_columns(spark):
    sqlfuncs.register(spark)
    inputs = [
        None, "", " ", "a", "a/b/c.pdf", "dir/", "/", ".hidden", "x.tar.gz", "no suffix", "Jane Q Doe", "  amy ", "\u0645\u062d\u0645\u062f \u0639\u0644\u064a",
        "total 5 USD now", "SARX", "\u0631\u064a\u0627\u0644 \u0633\u0639\u0648\u062f\u064a", "<p>x</p>", "a > b", "1  2\t3\n\nx\nx\r\ny\n", "123456789012345", "ABC1234567",
        '{"a":1}', '{"a":1} tail', 'x ```json\n{"a":{"b":[1]}}\n``` y', '{"ocr":1.5,"llm":null}', "[1]", "{", *C.PLACEHOLDERS, "it's \\\\ \\d",
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    v = F.col("v")
    variant = lambda c: c.cast("string")
    pairs = {
        "dp_reject_placeholder(v)": fieldrules.reject_placeholder(v),
        "dp_currency_code(v)": currency.currency_code(v),
        "dp_vat_format_ok(v)": fieldrules.vat_format_ok(v),
        "dp_vat_format_ksa(v)": fieldrules.vat_format_ksa(v),
        "dp_safe_basename(v)": text.safe_basename(v),
        "dp_file_suffix(v)": text.file_suffix(v),
        "dp_file_stem(v)": text.file_stem(v),
        "dp_initials(v)": text.initials(v),
        "dp_has_html(v)": text.has_html(v),
        "dp_clean_ocr(v)": text.clean_ocr(v),
        "dp_download_json(v, 'x')": jsonio.download_json(v, F.lit("x")),
        "dp_timings(v)": jsonio.timings_map(v),
        "CAST(dp_model_json(v) AS STRING)": variant(jsonio.parse_model_json(v)),
        "CAST(dp_read_object(v) AS STRING)": variant(jsonio.read_object(v)),
        "dp_number_text(i * 1234567.25D)": numbers.number_text(F.col("i") * F.lit(1234567.25)),
        "dp_day_start('2026-02-28')": dates.day_start(F.lit("2026-02-28")),
        "dp_day_end('2026-02-28')": dates.day_end(F.lit("2026-02-28")),
        "dp_iso_timestamp(dp_day_end('2026-02-28'))": dates.iso_timestamp(dates.day_end(F.lit("2026-02-28"))),
    }
    names = [f"c{k}" for k in range(len(pairs))]
    by_sql = df.selectExpr("i", *(f"{e} AS {n}" for e, n in zip(pairs, names))).collect()
    by_column = df.select("i", *(c.alias(n) for c, n in zip(pairs.values(), names))).collect()
    for got, want in zip(by_sql, by_column):
        for n, e in zip(names, pairs):
            assert got[n] == want[n], (e, inputs[got["i"]])


def test_sql_table_functions_are_generators(spark):
    sqlfuncs.register(spark)
    docs = spark.createDataFrame(
        [(1, '{"a":{"b":{"c":"d","e":[1,{"x":2}]},"f":null},"g":"{{{"}', "7,5 and 8"), (2, None, None), (3, "{}", "none")], "id int, j string, t string")
    leaves = spark.sql("SELECT id, path, value FROM (SELECT id, dp_model_json(j) AS a FROM {d}) d, LATERAL dp_leaves(d.a)", d=docs)
    found = {(r["id"], r["path"]): r["value"] for r in leaves.collect()}
    assert found == {(1, "a.b.c"): "d", (1, "a.b.e"): '[1,{"x":2}]', (1, "a.f"): None, (1, "g"): "{{{"}
    amounts = spark.sql("SELECT id, pos, trim(run) AS run FROM {d} d, LATERAL dp_amounts(d.t) WHERE trim(run) <> ''", d=docs)
    assert [(r["id"], r["run"]) for r in amounts.collect()] == [(1, "7,5"), (1, "8")]
    for df in (leaves, amounts):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in plan and "Join" not in plan and "Exchange" not in plan


def test_python_functions_need_no_package_on_executors(tmp_path):
    """A worker without this package on its path can load and run them."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from docproof.streaming.tokens import _collector

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(_collector(None)))
    code = (
        "import pickle, sys; pickle.load(open('f.pkl', 'rb'));"
        "assert not [m for m in sys.modules if m.startswith('docproof')]; print('loaded')"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "loaded"
