"""Logical schemas of the ledger tables. Money is decimal(18,2), days are dates, and the order of a statement's rows is the column row_pos."""

STATEMENT_RAW = "source string, row_pos long, txn_date string, value_date string, description string, reference string, credits string, debits string, balance string"
LEDGER = (
    "company string, account_number string, row_pos long, txn_date date, value_date date, description string, reference string, "
    "debits decimal(18,2), credits decimal(18,2), reported_balance decimal(18,2), business_unit string, head string, type string, "
    "tcp_head string, narration string, confidence string, reason string, source_file string"
)
WORDS = "doc_id string, page int, word_no int, text string, x0 double, x1 double, top double, bottom double"
ACCOUNTS = "account_number string, bank_name string, company string, business_unit string, account_stage string, financial_year string, account_order int"
OVERRIDE_RULES = "rule_order int, account_suffix string, keyword string, head string, business_unit string, type string, tcp_head string, status string"
HEAD_RULES = "head string, priority int, direction string, party_types array<string>, keywords array<string>, patterns array<string>, fallback boolean"
PARTIES = "canonical string, type string, aliases array<string>, confidence string"
PAYEES = "company string, name string, head1 string, head2 string, head3 string, status string"
HISTORY = "request_id string, ts timestamp_ntz, file string, bank string, account_number string, status string, total_rows int, new_rows int, duplicates_skipped int, error string, failed_stage int, source string"

DEDUP_KEY = ("txn_date", "credits", "debits", "reported_balance")
FINGERPRINT = ("txn_date", "debits", "credits", "description")
CLASS_COLUMNS = ("head", "business_unit", "type", "tcp_head", "narration")
