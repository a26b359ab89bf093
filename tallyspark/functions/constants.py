"""Vocabularies, thresholds and dimensions.

Everything in this file is a FIXED VALUE: results depend on these exact words and numbers.
Operators take them as arguments, so a caller can swap a vocabulary without touching code.
"""

# ---- receipt filter (fixed values) -------------------------------------------------------
RECEIPT_SENDERS = (
    "billing", "invoices", "invoice", "receipts", "receipt", "orders", "order",
    "no-reply", "noreply", "payments", "sales",
)
RECEIPT_SUBJECT_TELLS = (
    "receipt", "invoice", "order confirmation", "your order", "payment", "paid",
    "purchase", "subscription", "renewal",
)
NON_RECEIPT_TELLS = (
    "unsubscribe", "newsletter", "digest", "webinar", "follow us", "new post", "weekly update",
)
RECEIPT_CONFIDENCE = 0.9
UNCERTAIN_RECEIPT_CONFIDENCE = 0.4
DROP_THRESHOLD = 0.7
REASON_RECEIPT = "sender/subject/attachment matched a receipt signal"
REASON_NON_RECEIPT = "subject/body matched a newsletter/marketing tell"
REASON_UNCERTAIN = "ambiguous, needs review"
REASON_ADVISORY = "LLM classification"

# ---- document layout (fixed values) ------------------------------------------------------
HEADER_LABELS = {
    "invoice_number": "Invoice Number",
    "invoice_date": "Invoice Date",
    "due_date": "Due Date",
    "vendor_name": "Vendor",
    "sponsor_name": "Sponsor",
    "study_name": "Study",
    "protocol_number": "Protocol",
    "site_identifier": "Site",
    "billing_period": "Billing Period",
    "currency": "Currency",
    "total_amount": "Total Amount",
    "tax": "Tax",
    "payment_terms": "Payment Terms",
}
HEADER_FIELDS = tuple(HEADER_LABELS)
DECIMAL_FIELDS = ("total_amount", "tax")
LINE_ITEMS_MARKER = "Line Items"
LINE_ITEMS_FIRST_COLUMN = "description"
IMAGE_SUFFIX_PATTERN = r"\.(png|jpg|jpeg|tif|tiff|gif|bmp)$"
RASTER_SUFFIX_PATTERN = r"\.(pdf|png|jpg|jpeg|tif|tiff|gif|bmp)$"

# ---- extraction confidences and evidence labels (fixed values) ----------------------------
CONF_CORROBORATED = 0.95
CONF_PRESENT = 0.9
CONF_LINE_COMPLETE = 0.9
CONF_LINE_PARTIAL = 0.6
EVIDENCE_LABELS = {
    "pdf": "PDF attachment",
    "image": "scanned image",
    "attachment": "attachment",
    "email_body": "email body",
}
EVIDENCE_DEFAULT = "source document"
REVIEWER_EVIDENCE = "corrected by reviewer"
CITATION_STATUSES = ("extracted", "uncertain", "unreadable", "missing")
CITATION_UNCERTAIN_BELOW = 0.7
OCR_COLUMNS = ("left", "top", "width", "height", "conf", "text")

# ---- categories in declared order, with their keywords (fixed values) ---------------------
CATEGORY_KEYWORDS = {
    "Advertising": (
        "advertising", "ads", "ad", "marketing", "campaign", "promotion", "seo"),
    "Car and truck expenses": (
        "fuel", "gas", "gasoline", "mileage", "parking", "toll", "uber", "lyft",
        "rental car", "vehicle"),
    "Commissions and fees": (
        "commission", "fee", "processing", "stripe", "paypal", "merchant"),
    "Contract labor": (
        "contractor", "freelance", "freelancer", "subcontractor", "1099"),
    "Insurance": ("insurance", "premium", "liability", "coverage"),
    "Legal and professional services": (
        "legal", "attorney", "lawyer", "accountant", "accounting", "bookkeeping",
        "consulting", "consultant", "professional"),
    "Office expense": (
        "office", "software", "saas", "subscription", "hosting", "domain", "cloud", "app",
        "license", "google", "microsoft", "adobe", "notion", "zoom", "slack"),
    "Rent or lease": ("rent", "lease", "coworking", "workspace", "office space"),
    "Repairs and maintenance": ("repair", "maintenance", "fix", "service"),
    "Supplies": ("supplies", "supply", "paper", "ink", "toner", "stationery", "materials"),
    "Taxes and licenses": ("tax", "license", "permit", "registration", "filing"),
    "Travel": (
        "travel", "flight", "airfare", "airline", "hotel", "lodging", "airbnb", "train"),
    "Meals": (
        "meal", "meals", "restaurant", "dining", "lunch", "dinner", "coffee", "catering"),
    "Utilities": (
        "utility", "utilities", "internet", "phone", "electricity", "water", "wireless",
        "broadband"),
    "Other expenses": ("misc", "miscellaneous", "other"),
    "Gross receipts (income)": (
        "payout", "payment received", "deposit", "invoice paid", "you've been paid", "sales",
        "revenue"),
}
INCOME_CATEGORY = "Gross receipts (income)"
INCOME_KEYWORDS = (
    "payout", "payment received", "you've been paid", "you got paid", "deposit",
    "invoice paid", "remittance", "disbursement", "we've sent you", "earnings",
)
ADVERSARIAL_PATTERNS = (
    r"ignore (all|any|previous|prior) (instructions|prompts)",
    r"disregard (the|all|any|previous) (above|instructions|rules)",
    r"system prompt",
    r"you are (now )?(a|an) ",
    r"forget (everything|all|the) (above|previous|instructions)",
    r"do not (hold|flag|review)",
    r"mark this as (approved|posted|filed)",
)
CATEGORY_FLOOR = 0.5
AMBIGUITY_GAP = 0.15
HIT_SCORES = (0.0, 0.8, 0.9, 0.95)  # 0, 1, 2, 3-or-more distinct keywords
AMBIGUOUS_CAP = 0.7
TYPE_CONFIDENCE = 0.9
WEAK_TYPE_CONFIDENCE = 0.6
EVIDENCE_INCOME = "income wording in the document"
EVIDENCE_PURCHASE = "vendor + total present (a purchase)"
EVIDENCE_WEAK = "amount present but weak vendor signal"
EVIDENCE_NO_TYPE = "no clear income/expense signal"
NO_CATEGORY_RATIONALE = "no category keywords matched"
DOCUMENT_TYPES = ("income", "expense", "unknown")
ADJUDICATION_RATIONALE = "LLM adjudication"

# ---- decision thresholds, messages and actions (fixed values) -----------------------------
TOTAL_TOLERANCE = "0.01"
EXTRACTION_HOLD = 0.5
EXTRACTION_WATCH = 0.8
TYPE_HOLD = 0.7
CATEGORY_HOLD = 0.7
DECISION_FLOOR = 0.8
SUBMIT_RATIONALE = "Classified and categorized with high confidence; filed to the ledger."
REQUIRED_ACTIONS = {
    "suspected_adversarial": "Verify the source; the content looks spoofed before filing",
    "ambiguous_income_expense": "Confirm whether this is income or an expense",
    "low_category_confidence": "Confirm or correct the Schedule C category",
    "suspected_duplicate": "Confirm this is not a duplicate of an already-filed item",
    "sheet_write_failed": "Retry the Sheet append",
    "missing_total": "Add the missing amount",
    "low_extraction_confidence": "Re-extract or verify the low-confidence fields",
    "total_mismatch": "Reconcile line items against the total",
    "low_confidence": "Review the item; overall confidence is below the file threshold",
}

# ---- hold reasons: code, title, severity, retryable -----------------------------------------
# (fixed values)
HOLD_REASONS = (
    ("unresolved_sponsor", "Unresolved sponsor", "high", False),
    ("unresolved_study", "Unresolved study", "high", False),
    ("unresolved_site", "Unresolved site", "high", False),
    ("context_unresolved", "Context resolved with low confidence", "high", False),
    ("context_ambiguity", "Multiple likely context candidates", "high", False),
    ("context_mismatch", "Mismatched metadata vs reference data", "high", False),
    ("missing_invoice_number", "Missing invoice number", "high", False),
    ("missing_total", "Missing invoice total", "high", False),
    ("low_extraction_confidence", "Low extraction confidence", "high", False),
    ("moderate_extraction_confidence", "Moderate extraction confidence", "medium", False),
    ("missing_optional_fields", "Missing optional fields", "low", False),
    ("unmatched_line_item", "Unmatched line item", "high", False),
    ("amount_mismatch", "Line amount mismatch", "high", False),
    ("quantity_mismatch", "Line quantity mismatch", "high", False),
    ("low_match_confidence", "Low line-item match confidence", "high", False),
    ("weak_match", "Weak line-item match", "medium", False),
    ("total_mismatch", "Invoice total mismatch", "high", False),
    ("catalog_unavailable", "Catalog unavailable", "high", False),
    ("ambiguous_income_expense", "Ambiguous income vs expense", "high", False),
    ("low_category_confidence", "Low category confidence", "high", False),
    ("suspected_duplicate", "Suspected duplicate transaction", "high", False),
    ("suspected_adversarial", "Suspected adversarial/spoofed content", "high", False),
    ("sheet_write_failed", "Sheet append failed (retryable)", "high", True),
    ("low_confidence", "Low overall decision confidence", "high", False),
    ("submission_failed", "Backend submission failure", "high", True),
    ("catalog_fetch_failed", "Catalog fetch failed (retryable)", "high", True),
    ("extraction_failed", "LLM extraction failed (retryable)", "high", True),
    ("stage_failure", "Processing stage failed (retryable)", "high", True),
)

# ---- ledger, duplicates, triage, retry (fixed values) -------------------------------------
LEDGER_HEADERS = ("Type", "Category", "Vendor", "Date", "Amount", "Source")
LEDGER_TAB = "Ledger"
DUPLICATE_WINDOW_DAYS = 3
FILTER_KEYS = ("failed", "held", "low_confidence", "needs_review", "posted")
LOW_CONFIDENCE_CODES = (
    "low_extraction_confidence", "moderate_extraction_confidence", "low_confidence",
    "ambiguous_income_expense", "low_category_confidence",
)
SUBMIT_WATCH = 0.75
SPOT_CHECK_K = 5
MAX_ATTEMPTS = 3
POLL_SECONDS = 60
CONFIDENCE_BANDS = (("conf-low", 0.6), ("conf-mid", 0.85))  # below the bound; else conf-high
CONNECTION_ERRORS = (
    "APIConnectionError", "APITimeoutError", "ConnectError", "ConnectTimeout", "ReadTimeout",
    "PoolTimeout", "ConnectionError", "TimeoutError",
)
DECISION_ACTIONS = ("posted", "held")
CONFIRMING_ACTIONS = ("corrected", "escalated")
TERMINAL_ACTIONS = ("posted", "held", "failed", "rejected")
ACTION_STATUS = {
    "received": "received", "parsed": "parsed", "extracted": "extracted",
    "classified": "classified", "categorized": "categorized", "posted": "posted",
    "held": "held", "failed": "failed", "corrected": "corrected", "escalated": "escalated",
    "rejected": "rejected", "rerun": "rerun_requested", "recovered": "rerun_requested",
}
REVIEW_ACTION_STATUS = {"correct": "corrected", "reject": "rejected", "escalate": "escalated"}
REVIEW_ACTION_EVENT = {
    "correct": "corrected", "reject": "rejected", "escalate": "escalated",
    "review": "reviewed", "note": "note", "confirm": "confirmed",
}
