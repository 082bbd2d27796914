"""Fixed values of the domain.

Every literal in this module is data that results depend on (names, word lists, labels, thresholds); the logic
that uses them lives in ``functions`` and ``operators``. All of them are fixed values.
"""

from __future__ import annotations

import sys
import unicodedata

# --- characters -------------------------------------------------------------------------------------------

# Whitespace as Python's str.strip / re ``\s`` see it.
PY_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Blanks collapsed inside a line, and the characters at which text is cut into lines (besides CR LF).
LINE_BLANKS = " \t\xa0\u2000-\u200a\u202f\u205f\u3000"
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Digits folded to ASCII before text is compared. Persian 8 and 9 are deliberately absent: the system whose
# results we match lists the Arabic forms twice instead (``strict=True`` adds them).
FOLD_DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷"
FOLD_DIGITS_TO = "012345678901234567"
STRICT_DIGITS_FROM = FOLD_DIGITS_FROM + "۸۹"
STRICT_DIGITS_TO = FOLD_DIGITS_TO + "89"

# Number parsing accepts every Unicode decimal digit; the table is derived from the character database.
_DECIMALS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
DECIMAL_DIGITS_FROM = "".join(_DECIMALS)
DECIMAL_DIGITS_TO = "".join(str(unicodedata.decimal(c)) for c in _DECIMALS)

ARABIC_DECIMAL_SEPARATOR = "٫"

# What is stored of each section when a model gave no answer that can be read.
EMPTY_SECTIONS = {
    "document": '{"number":"","date":"","currency":""}',
    "vendor": '{"name_ar":"","name_en":"","vat_number":"","address_ar":"","address_en":""}',
    "customer": '{"name_ar":"","name_en":"","vat_number":"","address_ar":"","address_en":""}',
    "financials": '{"subtotal":null,"tax_amount":null,"total_amount":null}',
    "metadata": '{"purchase_order":"","reference_number":"","payment_terms":"","notes":""}',
}

# --- markup -----------------------------------------------------------------------------------------------

HTML_TAG = r"</?[a-zA-Z][^>]*>"
ANY_TAG = r"<[^>]+>"
# Numeric references that stand for another character, by the HTML standard.
REPLACED_CODES = tuple((0x80 + i, c) for i, c in enumerate(
    "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ")) + ((0x0D, "\r"),)

# --- fields -----------------------------------------------------------------------------------------------

FIELDS = (
    "document_number",
    "vat_number",
    "document_date",
    "currency",
    "vendor_name_ar",
    "vendor_name_en",
    "customer_name_ar",
    "customer_name_en",
    "address_ar",
    "address_en",
    "subtotal",
    "tax_amount",
    "total_amount",
    "purchase_order",
    "customer_vat",
    "payment_terms",
)
AMOUNT_FIELDS = ("subtotal", "tax_amount", "total_amount")
VENDOR_FIELDS = ("vendor_name_ar", "vendor_name_en")

# Where each field sits in the nested answer of the extraction model.
FIELD_PATHS = {
    "document_number": "$.document.number",
    "vat_number": "$.vendor.vat_number",
    "document_date": "$.document.date",
    "currency": "$.document.currency",
    "vendor_name_ar": "$.vendor.name_ar",
    "vendor_name_en": "$.vendor.name_en",
    "customer_name_ar": "$.customer.name_ar",
    "customer_name_en": "$.customer.name_en",
    "address_ar": "$.vendor.address_ar",
    "address_en": "$.vendor.address_en",
    "subtotal": "$.financials.subtotal",
    "tax_amount": "$.financials.tax_amount",
    "total_amount": "$.financials.total_amount",
    "purchase_order": "$.metadata.purchase_order",
    "customer_vat": "$.customer.vat_number",
    "payment_terms": "$.metadata.payment_terms",
}

# A field counts as printed on the document when one of its words occurs in the lower-cased text.
FIELD_KEYWORDS = {
    "document_number": (
        "invoice no", "invoice number", "inv no", "inv number", "invoice#", "invoice #",
        "فاتورة رقم", "رقم الفاتورة", "رقم", "رقم المستند",
    ),
    "vat_number": (
        "vat no", "vat number", "vat id", "الرقم الضريبي", "الرقم التعريفي الضريبي", "tin",
        "tax registration", "tax no", "tax number", "رقم التسجيل الضريبي",
    ),
    "document_date": (
        "date", "issue date", "invoice date", "التاريخ", "تاريخ الفاتورة", "تاريخ الاصدار", "تاريخ",
    ),
    "currency": ("sar", "riy", "ريال", "ر.س", "sr", "currency", "العملة"),
    "subtotal": (
        "subtotal", "sub-total", "net amount", "before vat", "before tax", "الاجمالي قبل", "المجموع قبل",
        "المبلغ الخاضع للضريبة",
    ),
    "tax_amount": ("vat", "tax", "value added tax", "الضريبة", "قيمة الضريبة", "مبلغ الضريبة"),
    "total_amount": (
        "total", "grand total", "total amount", "net total", "amount due", "المجموع", "الاجمالي", "الصافي",
        "المبلغ المستحق",
    ),
    "customer_name_ar": ("customer", "bill to", "sold to", "client", "العميل", "المشتري", "السادة", "إلى"),
    "customer_name_en": ("customer", "bill to", "sold to", "client", "العميل", "المشتري", "السادة", "to"),
    "address_ar": ("address", "location", "العنوان", "الموقع", "ص.ب"),
    "address_en": ("address", "location", "العنوان", "الموقع", "p.o.box", "p.o. box"),
    "purchase_order": ("po #", "po no", "po number", "purchase order", "طلب شراء", "p.o", "p.o."),
    "payment_terms": ("payment terms", "payment term", "شروط الدفع", "تاريخ الاستحقاق", "due date"),
    "customer_vat": ("customer vat", "customer's vat", "الرقم الضريبي للمشتري", "الرقم الضريبي للعميل"),
}

RIYAL_MARKS = ("sar", "riy", "ريال", "ر.س", "sr")
EMPTY_WORDS = ("", "null", "None")

# --- states, scores, status -------------------------------------------------------------------------------

VALID = "FOUND_AND_VALID"
INCORRECT = "FOUND_BUT_INCORRECT"
MISSING = "NOT_EXTRACTED"
ABSENT = "NOT_PRESENT_IN_SOURCE"

# Scores are kept in hundredths so that sums are exact.
SCORE_VALID = {"amount": 99, "document_date": 98, "other": 97}
SCORE_MISSING = 10
SCORE_INCORRECT = 40
SCORE_ABSENT = 100

ERROR_IF_MISSING = ("document_number", "total_amount")
ERROR_IF_INCORRECT = ("document_number",)
PENALTY = {"document_number": 20, "vat_number": 15, "document_date": 15, "other": 5, "math": 20}
MATH_TOLERANCE = 0.05
AMOUNT_TOLERANCE = 0.01
REVIEW_THRESHOLD = 0.80
REJECT_THRESHOLD = 0.05

APPROVED = "Approved"
NEEDS_REVIEW = "Needs Review"
REJECTED = "Rejected"

# Engine name stored with processed documents.
ENGINE = "qwen_llm"

# --- dates ------------------------------------------------------------------------------------------------

# Accepted date layouts, in order of preference: (Spark pattern, strptime pattern).
DATE_LAYOUTS = (
    ("yyyy-M-d", "%Y-%m-%d"),
    ("d-M-yyyy", "%d-%m-%Y"),
    ("yyyy/M/d", "%Y/%m/%d"),
    ("d/M/yyyy", "%d/%m/%Y"),
    ("M/d/yyyy", "%m/%d/%Y"),
    ("yyyy.M.d", "%Y.%m.%d"),
    ("d.M.yyyy", "%d.%m.%Y"),
    ("yyyy-M-d'T'H:m:s", "%Y-%m-%dT%H:%M:%S"),
)

# --- text and files ---------------------------------------------------------------------------------------

UPLOAD_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".webp")
BLOCK_TAGS = frozenset(
    ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "table", "br", "section", "body", "html")
)
TABLE_WORDS = (
    "description", "qty", "quantity", "unit price", "amount", "price", "item", "desc", "amt",
    "الوصف", "الكمية", "سعر", "الاجمالي", "السعر", "البيان",
)
TABLE_LINES_KEPT = 3
SECTION_RULER = "========== {} =========="

# --- export -----------------------------------------------------------------------------------------------

CANONICAL_FIELDS = (
    "document_number",
    "vendor_name_ar",
    "vendor_name_en",
    "customer_name_ar",
    "customer_name_en",
    "address_ar",
    "address_en",
    "document_date",
    "currency",
    "subtotal",
    "tax_amount",
    "total_amount",
    "purchase_order",
    "reference_number",
    "document_type",
)

# Places a canonical value may be found in, first non-empty one wins.
CANONICAL_PATHS = {
    "document_number": ("$.document.number", "$.document_number", "$.invoice_number", "$.number"),
    "vendor_name_ar": ("$.vendor.name_ar", "$.vendor_name_ar"),
    "vendor_name_en": ("$.vendor.name_en", "$.vendor_name_en"),
    "customer_name_ar": ("$.customer.name_ar", "$.customer_name_ar"),
    "customer_name_en": ("$.customer.name_en", "$.customer_name_en"),
    "address_ar": ("$.vendor.address_ar", "$.address_ar"),
    "address_en": ("$.vendor.address_en", "$.address_en"),
    "document_date": ("$.document.date", "$.document_date", "$.date", "$.invoice_date"),
    "currency": ("$.document.currency", "$.currency"),
    "subtotal": ("$.financials.subtotal", "$.subtotal"),
    "tax_amount": ("$.financials.tax_amount", "$.tax_amount", "$.vat", "$.vat_amount"),
    "total_amount": ("$.financials.total_amount", "$.total_amount", "$.grand_total"),
    "purchase_order": ("$.metadata.purchase_order", "$.purchase_order", "$.po_number"),
    "reference_number": ("$.metadata.reference_number", "$.reference_number"),
    "document_type": ("$.document_type", "$.type"),
}

EXPORT_COLUMNS = (
    ("Vendor Name (Arabic)", "vendor_name_ar"),
    ("Vendor Name (English)", "vendor_name_en"),
    ("Customer Name (Arabic)", "customer_name_ar"),
    ("Customer Name (English)", "customer_name_en"),
    ("Address (Arabic)", "address_ar"),
    ("Address (English)", "address_en"),
    ("Invoice Number", "document_number"),
    ("Invoice Date", "document_date"),
    ("Currency", "currency"),
    ("Subtotal", "subtotal"),
    ("VAT", "tax_amount"),
    ("Total", "total_amount"),
    ("Purchase Order", "purchase_order"),
    ("Reference Number", "reference_number"),
    ("Document Type", "document_type"),
)

# Columns of the staged design's spreadsheet.
STAGED_EXPORT_COLUMNS = (
    ("Invoice Number", "document_number"),
    ("Date", "document_date"),
    ("Vendor", "vendor_name"),
    ("Customer", "customer_name"),
    ("VAT", "vat_number"),
    ("Currency", "currency"),
    ("Subtotal", "subtotal"),
    ("Tax", "tax_amount"),
    ("Total", "total_amount"),
)
STAGED_FIELDS = tuple(field for _, field in STAGED_EXPORT_COLUMNS)

# Labels that introduce a value, in priority order.
FIELD_LABELS = {
    "vendor_name": ("Seller", "Supplier", "Vendor", "From", "المؤسسة", "المورد", "اسم البائع"),
    "customer_name": ("Customer", "Bill To", "Buyer", "Client", "العميل", "اسم العميل"),
    "document_number": ("Invoice No", "Invoice Number", "Tax Invoice No", "رقم الفاتورة"),
    "vat_number": (
        "VAT No", "VAT Number", "TRN", "Tax Registration Number", "الرقم الضريبي", "رقم الضريبة",
    ),
    "document_date": ("Invoice Date", "Date", "Tax Invoice Date", "تاريخ الفاتورة"),
    "currency": (),
    "subtotal": ("Subtotal", "Amount Before VAT", "Net Amount", "الإجمالي قبل الضريبة"),
    "tax_amount": ("VAT Amount", "Tax Amount", "VAT Amt", "قيمة الضريبة"),
    "total_amount": ("Total", "Grand Total", "Total Amount", "Amount Due", "الإجمالي"),
}
CURRENCY_CODES = ("SAR", "AED", "USD", "QAR", "OMR", "BHD", "KWD")
RIYAL_NAMES = ("saudi riyal", "ريال سعودي")
PLACEHOLDERS = (
    "Customer", "Client", "M/s", "Receiver", "Signature", "Customer:", "Client:", "Supplier:", "Vendor:",
)
# Weights of the staged design's overall score, in hundredths.
FIELD_WEIGHTS = {
    "document_number": 22,
    "vat_number": 20,
    "total_amount": 18,
    "vendor_name": 12,
    "customer_name": 8,
    "document_date": 7,
    "currency": 5,
    "subtotal": 4,
    "tax_amount": 4,
}

# The demo record written into an empty store; fixed values.
DEMO_JSON = (
    '{"invoice_number": "INV-1001", "invoice_date": "2026-06-01", "vendor_name": "Northwind Traders", '
    '"customer_name": "Contoso Ltd", "currency": "USD", "subtotal": 1000.0, "tax_amount": 180.0, '
    '"total_amount": 1180.0}'
)
