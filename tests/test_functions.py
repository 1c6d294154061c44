from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import amounts, dates, names, text
from tallyforge.operators import narrate, parse, rules


def one(spark, value, f, schema="c string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("given", "wanted"), [("2026-04-05", dt.date(2026, 4, 5)), ("05-Apr-2026", dt.date(2026, 4, 5)), ("06/04/2026", dt.date(2026, 4, 6)), ("06-04-2026", dt.date(2026, 4, 6)), ("bad", None), ("", None), (None, None)])
def test_dates(spark, given, wanted):
    assert one(spark, given, dates.parsed_date) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("1,20,000.00", "120000.00"), ("", "0.00"), ("x", "0.00"), (None, "0.00"), ("-5", "-5.00")])
def test_amounts(spark, given, wanted):
    assert one(spark, given, amounts.parsed_amount) == Decimal(wanted)


def test_fiscal_year(spark):
    row = spark.createDataFrame([("2026-03-31",), ("2026-04-01",)], "c string").select(dates.fiscal_year(F.to_date("c")).alias("y"), dates.fiscal_quarter(F.to_date("c")).alias("q")).collect()
    assert [(r["y"], r["q"]) for r in row] == [("2025-26", "Q4"), ("2026-27", "Q1")]
    ok, bad = one(spark, "2026-27", dates.fiscal_range), one(spark, "2026-28", dates.fiscal_range)
    assert (ok["first"], ok["last"], bad) == (dt.date(2026, 4, 1), dt.date(2027, 3, 31), None)


LAYOUTS = [
    ("NEFT CR-QRST0770077-Maple Traders-Willow Homes-QRSTN5150001", ("Maple Traders", "NEFT", "QRSTN5150001", None, None)),
    ("RTGS CR-QRST0770077-Maple-Willow-9Z", ("Maple", "RTGS", "9Z", None, None)),
    ("NEFT-RETURN-Z9Z-Birch Person-no such account-again", ("Birch Person", "NEFT", "Z9Z", None, "no such account-again")),
    ("IMPS-5150-Cedar-QRST-xx77-fees for june", ("Cedar", "IMPS", "5150", "xx77", "fees for june")),
    ("imps/Elder/ xxx 7 7 9/rrn: 61/", ("Elder", "IMPS", "61", "779", None)),
    ("IMPS/Elder/XXX779/RR N:61/a/b", ("Elder", "IMPS", "61", "779", "a/b")),
    ("UPI/71/FROM:as pen@q/TO:fir@q/gas/bill", ("aspen", "UPI", "71", None, "gas/bill")),
    ("UPI-71-Hazel-QRST-hz@q.x-tea", ("Hazel", "UPI", "71", "hz@q.x", "tea")),
    ("yib-neft-K3-Holly-QRST0770077-Vendor-b-c", ("Holly", "NEFT", "K3", None, "b-c")),
    ("ABC-TPT-Juniper-Works-TFR 61", ("Juniper-Works", "TPT", "61", None, None)),
    ("ABC-TPT-Juniper-TFR-61", ("Juniper", "TPT", "61", None, None)),
    ("NET-TPT-Laurel-61-2", ("Laurel", "TPT", "61-2", None, None)),
    ("NEFT/K3/Linden/Bank/NA/NAgas/NANA/NA", ("Linden", "NEFT", "K3", None, "gas")),
    ("INB/NEFT/K3/Myrtle/Bank///", ("Myrtle", "NEFT", "K3", None, None)),
    ("INB/61/WATER/TAX/NA", (None, "INB", "61", None, "WATER/TAX")),
    ("BY CLG:Oak Person:Bank:01", ("Oak Person", "CLG", None, None, "Bank:01")),
    ("DD ISSUED/6/1/Poplar/note", ("Poplar", "DD", "6/1", None, "note")),
    ("BILLDESK-K3-Rowan-gas-7-7", ("Rowan", "BILLDESK", "K3", "7-7", "gas")),
    ("K3-Spruce-WILLOW HOMES-Z9", ("Spruce", None, "Z9", None, None)),
    ("QRSTN515000177-Teak Stores-770077-vendor-x", ("Teak Stores", None, "QRSTN515000177", "770077", "vendor-x")),
    # Each layout refuses what only looks like it.
    ("neft cr-QRST0770077-Maple-Fir-9Z", (None,) * 5), ("NEFT CR-QRST0770077--Willow-9Z", (None,) * 5), ("NEFT CR-QRST-Maple-Fir-9z", (None,) * 5),
    ("NEFT-RETURN-Z9Z-Birch", (None,) * 5), ("IMPS-51a-Cedar-QRST-xx77-f", (None,) * 5), ("IMPS/Elder/779/RR N:61/", (None,) * 5), ("UPI/71/FROM:aspen/TO:fir@q/x", (None,) * 5),
    ("UPI-71-Hazel-qrst-hz@q-tea", (None,) * 5), ("YIB-NEFT-K3-Holly-QRST0770077-Vendor", (None,) * 5), ("ABC-TPT-Juniper-61", (None,) * 5), ("NET-TPT-Laurel", (None,) * 5),
    ("NEFT/K3/Linden/Bank/NA/gas/NANA/NA", (None,) * 5), ("INB/NEFT/K3/Myrtle/Bank", (None,) * 5), ("INB/x/WATER/NA", (None,) * 5), ("BY CLG:Oak", (None,) * 5), ("DD ISSUED/6/1/Poplar", (None,) * 5),
    ("BILLDESK-K3-Rowan-gas-x", (None,) * 5), ("K3-Spruce-OTHER HOMES-Z9", (None,) * 5), ("SHORT-Teak-770077-v", (None,) * 5), ("QRSTN515000177-Teak-77-v", (None,) * 5), ("something else", (None,) * 5), ("", (None,) * 5), (None, (None,) * 5),
]


def test_layouts(spark):
    rows = spark.createDataFrame([(i, given) for i, (given, _) in enumerate(LAYOUTS)], "i int, c string")
    got = {r["i"]: tuple(r["r"]) for r in rows.select("i", parse.parsed_description(F.col("c"), ("WILLOW",)).alias("r")).collect()}
    for i, (given, wanted) in enumerate(LAYOUTS):
        assert got[i] == wanted, given


@pytest.mark.parametrize(("given", "wanted"), [("A-Vendor-B", "Vendor"), ("x/MUKTA VEN DOR/y", None), ("x-VEN DOR-y", "Vendor"), ("IMPS/Some One CONTRACTOR/1", "Contractor"), ("a-cancellation12-b", "Cancellation"), ("plain", None)])
def test_roles(spark, given, wanted):
    assert one(spark, given, names.role_in) == wanted


def test_names(spark):
    assert one(spark, "YIB-NEFT-Y1-Eta Person VENDOR-ABCD0123456", names.payee_name) == "ETA PERSON"
    assert one(spark, "UTR1-Alpha Stores-123456789-vendor", names.dashed_payee_name) == "ALPHA STORES"
    assert one(spark, "IMPS-12-Beta-HDFC-x1-y", names.dashed_payee_name) == "BETA"
    assert one(spark, "IMPS/1/2", names.payee_name) is None


def test_words(spark):
    assert one(spark, "a EPF b", lambda c: rules.bounded_any(c, ["PF"])) is False
    assert one(spark, "a-PF-b", lambda c: rules.bounded_any(c, ["PF"])) is True
    assert one(spark, "BANK CHA RGE", lambda c: rules.contains_any(c, rules.BANK_CHARGES)) is True
    assert one(spark, "Alpha Pvt Ltd", text.company_key) == one(spark, "Alpha Private Limited", text.company_key) == "ALPHAPVTLTD"
    assert one(spark, "Alpha Limited", text.company_key) == one(spark, "alpha ltd", text.company_key) == "ALPHALTD" and one(spark, "Alpha LLP", text.company_key) == "ALPHALLP"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Account No: 12345678", "5678"), ("a/c no. XXXX1234 credited", "1234"), ("Account Number - X9876", "9876"), ("your account ending 4321.", "4321"), ("A/C XX55", None), ("no digits", None), (None, None),
    ],
)
def test_account_tail(spark, given, wanted):
    assert one(spark, given, text.account_tail) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("a b/c d.PDF", "c_d.PDF"), ("x y.txt", "x_y.txt.pdf"), ("../../etc/pass wd", "pass_wd.pdf"), ("", ".pdf")])
def test_safe_filename(spark, given, wanted):
    assert one(spark, given, text.safe_filename) == wanted


def test_term_text(spark):
    assert one(spark, "PAY ELECTRICITY BILL CONTRACTOR MAINTENANCE ALPHA", text.term_text) == "PAY ELECTRICITY BILL CONTRACTOR MAINTENANCE ALPHA"
    assert one(spark, "neft-HDFC0AB1234567/Party 12345 x99999", text.term_text) == "NEFT PARTY X99999"


@pytest.mark.parametrize(
    ("stage", "error", "wanted"),
    [
        (5, None, "Account not found"), (6, "Wrong PASSWORD", "Invalid PDF password"), (6, "x", "Corrupted PDF"), (7, "Unsupported layout", "Unsupported bank format"), (7, "", "Parsing failed"), (8, "x", "Financial Year mismatch"),
        (9, "Duplicate file", "Duplicate statement"), (9, "tab not found", "Account not found"), (9, "429", "Failed to upload to Google Sheets"), (None, None, "Processing failed"), (3, "e" * 90, "e" * 77 + "..."),
    ],
)
def test_failure_category(spark, stage, error, wanted):
    assert spark.createDataFrame([(stage, error)], "s int, e string").select(text.failure_category(F.col("s"), F.col("e")).alias("r")).first()["r"] == wanted


@pytest.mark.parametrize(("given", "wanted"), [("6-Jul-26", "2026-07-06"), (" 06-Jul-2026 ", "2026-07-06"), ("XXXX", "XXXX"), (None, ""), ("  ", "")])
def test_canonical_date(spark, given, wanted):
    assert one(spark, given, dates.canonical_date) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("BY CLG:Lambda Person:Some Bank - 01", "Lambda Person"), ("DD ISSUED/QQ/Mu House/atPar", "Mu House"), ("DD Cancln 123", None), ("NEFT CR-WXYZ0000001-Nu Stores-Own Firm-WXYZN123456789", "Nu Stores"),
        ("NEFT WXYZN1234567890 Xi Works Pr WXYZ0004114", "Xi Works Pr"), ("RTGS WXYZN1234567890 Omicron", "Omicron"), ("INB/IFT/PI PERSONAXIS/TPARTY TRANSFER", "PI PERSON"), ("NEFT/K77/Rho House/Bank/NA", "Rho House"),
        ("RTGS/K77/Sigma/Bank/x", "Sigma"), ("IMPS-123-Tau Person-WXYZ-xx12-rent", "Tau Person"), ("BILLDESK-B7-Upsilon Gas-x-9", "Upsilon Gas"), ("NEFT-RETURN-K5-Phi-WRONG", "Phi"), ("INB/55/Chi House/NA", "Chi House"),
        ("INB/55/EPFO PAYMENT/NA", None), ("WXYZH00123456789-Psi-Co Works-123456789012-vendor", "Psi-Co Works"), ("WXYZH00123456789-Omega-123456789012", "Omega"), ("WXYZH00123456789-Omega-salary", "Omega"), ("SMS CHARGES", None), ("", None), (None, None),
    ],
)
def test_any_payee_name(spark, given, wanted):
    assert one(spark, given, names.any_payee_name) == wanted


def test_reason_skips_unresolved(spark):
    assert one(spark, "Vendor", lambda c: narrate.reason(narrate.explained("Head", c, F.lit("R1")), narrate.explained("BU", F.lit("?"), F.lit("R1")))) == "Head: Vendor (R1)"
