from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import names, text
from tallyforge.operators import balance, geometry, ingest, lookups, master, pieces, reconcile, rules, similar
from tallyforge.sources import tables
from tallyforge.sources.statements import first_success, required
from tallyforge.streaming import landing

RAW = [
    ("s", 0, "2026-04-05", "", "B/F", "", "", "", "1,000.00"), ("s", 1, "05-Apr-2026", "", "UTRA00000001-Alpha Stores-123456789-vendor", "r", "", "250.00", "750.00"), ("s", 2, "06/04/2026", "", "BY CLG:Beta Person:Gamma Bank", "r", "1,20,000.00", "", "1,20,750.00"),
    ("s", 3, "06-04-2026", "", "GST", "", "", "18.00", "1,20,732.00"), ("s", 4, "", "", "orphan text", "", "", "", ""), ("s", 5, "06-04-2026", "", "GST again", "", "", "18.00", "1,20,732.00"),
]


def test_ingest_is_idempotent(spark):
    raw = spark.createDataFrame(RAW, schemas.STATEMENT_RAW)
    first = ingest.ingest(raw, ingest.normalized(raw).limit(0))
    rows = sorted(first.collect(), key=lambda r: r["row_pos"])
    assert [r["row_pos"] for r in rows] == [1, 2, 3]  # row 5 repeats the key of row 3
    assert ingest.ingest(raw, first).count() == 0
    assert ingest.ingest_metrics(raw, first).first().asDict() == {"total": 6, "new": 3, "brought_forward": 1, "skipped": 3}


def test_running_balance_has_no_errors(spark):
    raw = spark.createDataFrame(RAW, schemas.STATEMENT_RAW)
    rows = ingest.ingest(raw, ingest.normalized(raw).limit(0)).withColumn("account_number", ingest.F.lit("1"))
    checked = balance.balance_check(balance.running_balance(rows, ["account_number"], ["row_pos"])).collect()
    assert all(r["check"] == 0 and not r["is_error"] for r in checked)


def ledger(spark, rows):
    return spark.createDataFrame([("1", i, dt.date.fromisoformat(d) if d else None, Decimal(a), Decimal(0), t) for i, (d, a, t) in enumerate(rows)], "account_number string, row_pos long, txn_date date, debits decimal(18,2), credits decimal(18,2), description string")


def test_three_way(spark):
    auto = ledger(spark, [("2026-04-01", "5.00", "x"), ("2026-04-01", "5.00", "x"), ("2026-04-02", "6.00", "new text"), ("2026-04-05", "7.00", "same"), ("2026-04-09", "8.00", "far"), ("2026-04-05", "7.00", "same")])
    main = ledger(spark, [("2026-04-01", "5.00", "X"), ("2026-04-02", "6.00", "old text"), ("2026-04-03", "7.00", "same"), ("2026-04-01", "8.00", "far")])
    got = {r["auto_pos"]: (r["status"], r["main_pos"]) for r in reconcile.three_way(auto, main).collect()}
    assert got == {0: ("present", None), 1: ("new", None), 2: ("review", 1), 3: ("review", 2), 4: ("new", None), 5: ("new", None)}


def test_three_way_against_a_plain_walk(spark):
    """Random ledgers with recurring fees: bags by count, then each open row looks through all that is left, in order."""
    import random

    r = random.Random(3)
    day = lambda: r.choice([f"2026-04-{r.randint(1, 9):02d}"] * 9 + [None])
    some = lambda n: [(day(), r.choice(["5.00", "5.00", "7.00"]), r.choice(["fee", "fee", "rent", "x y"])) for _ in range(n)]
    auto, main = some(140), some(120)
    a, m = ledger(spark, auto), ledger(spark, main)
    squeezed = lambda t: t.upper().replace(" ", "")
    bag = {}
    for d, amount, t in main:
        bag[d, amount, squeezed(t)] = bag.get((d, amount, squeezed(t)), 0) + 1
    own = {}
    for d, amount, t in auto:
        own[d, amount, squeezed(t)] = own.get((d, amount, squeezed(t)), 0) + 1
    want, seen, left, kept = {}, {}, [], {}
    for i, (d, amount, t) in enumerate(main):
        key = d, amount, squeezed(t)
        kept[key] = kept.get(key, 0) + 1
        if kept[key] <= bag[key] - min(bag[key], own.get(key, 0)):
            left.append((i, d, amount, squeezed(t)))
    taken = set()
    for i, (d, amount, t) in enumerate(auto):
        key = d, amount, squeezed(t)
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= bag.get(key, 0):
            want[i] = ("present", None)
            continue
        same = [j for j, e, x, _ in left if j not in taken and (e, x) == (d, amount)]
        number = lambda e: dt.date.fromisoformat(e).toordinal()
        near = [] if d is None else sorted((abs(number(e) - number(d)), j) for j, e, x, u in left if j not in taken and e and x == amount and u == squeezed(t) and abs(number(e) - number(d)) <= 3)
        claim = same[0] if same else near[0][1] if near else None
        taken.add(claim)
        want[i] = ("new" if claim is None else "review", claim)
    assert {x["auto_pos"]: (x["status"], x["main_pos"]) for x in reconcile.three_way(a, m).collect()} == want and len(taken) > 10


def test_chain_placement_against_a_plain_walk(spark):
    """Random chains with rows taken out: each new row lies between the rows that its balances name, found by looking at all of them."""
    import random

    r = random.Random(6)
    balance, rows = 1000.0, []
    for _ in range(120):
        credit, debit = (float(r.randint(20, 400)), 0.0) if r.random() < 0.5 else (0.0, float(r.randint(20, 300)))
        balance += credit - debit
        rows.append((balance, credit, debit))
    rows.reverse()  # newest first
    new = {i for i in range(len(rows)) if r.random() < 0.3}
    frame = lambda keep: spark.createDataFrame([("1", 1000 * (i in new) + i, *x) for i, x in enumerate(rows) if (i in new) == keep], "account_number string, row_pos long, balance double, credits double, debits double")
    got = {x["row_pos"]: x for x in reconcile.placed(frame(True), frame(False)).collect()}
    pool = [(i, *x) for i, x in enumerate(rows) if i not in new] + [(1000 + i, *x) for i, x in enumerate(rows) if i in new]
    older = lambda p, b, c, d: next((q for q, e, _, _ in pool if q != p and abs(e - (b - c + d)) <= reconcile.BALANCE_TOLERANCE), None)
    by_pos = {x[0]: x for x in pool}
    points = {p: older(*by_pos[p]) for p in by_pos if p >= 1000}
    heads = [p for p in points if p not in {q for q in points.values() if q is not None and q >= 1000}]
    seen = set()
    for block, head in enumerate(heads):
        run, p = [], head
        while p is not None and p >= 1000 and p not in seen:
            seen.add(p)
            run.append(p)
            p = points[p]
        upper = next((q for q, e, c, d in pool if q < 1000 and abs(e - c + d - by_pos[head][1]) <= reconcile.BALANCE_TOLERANCE), None)
        lower = p if p is not None and p < 1000 else None
        for k, q in enumerate(run):
            assert (got[q]["block"], got[q]["seq"], got[q]["upper_row"], got[q]["lower_row"]) == (block, k, upper, lower)
    assert len(got) == len(new) and len(seen) > 20


def test_chains_with_ties_rings_and_nulls(spark, monkeypatch):
    """Accounts whose balances repeat, with rings, null amounts, a null account and an empty side, in narrow cells: every row as a plain walk has it."""
    import random

    r = random.Random(9)
    monkeypatch.setattr(reconcile, "CELL_CENTS", 1500)
    monkeypatch.setattr(reconcile, "RANK_ROWS", 4)
    schema = "account_number string, row_pos long, balance double, credits double, debits double"
    old, new = [], []
    for account, n_old, n_new, far in (("1", 30, 60, 60), ("2", 0, 40, 400), ("3", 200, 80, 3000), (None, 10, 20, 50), ("5", 15, 0, 50)):
        for side, n in ((old, n_old), (new, n_new)):
            for i in range(n):
                amount = r.choice([0, 3, r.randint(0, far)]) if r.random() > 0.05 else None
                side.append((account, i, r.randint(-far, far) + r.choice([0.0, 0.01, 0.5]) if r.random() > 0.05 else None, *((amount, 0.0) if r.random() < 0.5 else (0.0, amount))))
    old, new = ([tuple(float(v) if k > 1 and v is not None else v for k, v in enumerate(x)) for x in side] for side in (old, new))
    # A ring of three rows that nothing else points to: each balance less its credit is the next one's.
    new += [("6", 1, 1000.0, 100.0, 0.0), ("6", 2, 900.0, 100.0, 0.0), ("6", 3, 800.0, 0.0, 200.0)]
    cents = lambda v: None if v is None else round(v * 100)
    want = set()
    for account in {x[0] for x in new}:
        pool = [(side is new, x[1], cents(x[2]), None if None in x[2:] else cents(x[2]) - cents(x[3]) + cents(x[4])) for side in (old, new) for x in side if x[0] == account]
        first = lambda v, skip, k, only_old=False: next((j for j, y in enumerate(pool) if v is not None and j != skip and y[k] is not None and abs(y[k] - v) <= 500 and not (only_old and y[0])), None)  # noqa: E731, B023
        points = {i: first(x[3], i, 2) for i, x in enumerate(pool) if x[0]}
        heads = [i for i in points if i not in set(points.values())]
        seen, block = set(), 0
        for i in heads + list(points):
            if i in seen:
                continue
            run, j = [], i
            while j is not None and pool[j][0] and j not in seen:
                seen.add(j)
                run.append(j)
                j = points[j] if i in heads else None
            upper = first(pool[i][2], None, 3, True) if i in heads else None
            lower = pool[j][1] if j is not None and not pool[j][0] else None
            want |= {(account, block, k, pool[q][1], None if upper is None else pool[upper][1], lower) for k, q in enumerate(run)}
            block += 1
    got = reconcile.placed(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()
    assert len(got) == len(new) and {tuple(x) for x in got} == want
    assert max(x[2] for x in want) >= 3 and {x[2:] for x in want if x[0] == "6"} == {(0, p, None, None) for p in (1, 2, 3)}
    assert reconcile.placed(spark.createDataFrame([], schema), spark.createDataFrame(old, schema)).count() == 0


def test_chain_placement(spark):
    # Newest first: 130 <- 120 <- [110] <- 100
    old = spark.createDataFrame([("1", 0, 130.0, 10.0, 0.0), ("1", 1, 100.0, 10.0, 0.0)], "account_number string, row_pos long, balance double, credits double, debits double")
    new = spark.createDataFrame([("1", 10, 120.0, 10.0, 0.0), ("1", 11, 110.0, 10.0, 0.0), ("1", 12, 900.0, 1.0, 0.0)], old.schema)
    got = {(r["row_pos"]): (r["seq"], r["upper_row"], r["lower_row"]) for r in reconcile.placed(new, old).collect()}
    assert got[10] == (0, 0, 1) and got[11] == (1, 0, 1) and got[12] == (0, None, None)


def test_overrides_first_match_and_wildcards(spark):
    rows = spark.createDataFrame([("9007", 1, "pay alpha"), ("9008", 2, "pay alpha"), ("9008", 3, "other")], "account_number string, row_pos long, description string")
    r = spark.createDataFrame([(1, "7", "ALPHA", "A", "u", "t", "c", "Active"), (2, "", "alpha", "B", "u", "t", "c", "Active"), (3, "", "", "C", "u", "t", "c", "Active"), (4, "8", "", "D", "u", "t", "c", "Disabled")], schemas.OVERRIDE_RULES)
    active = lookups.active_overrides(r)
    got = lookups.first_override(rows, active, ["head"])
    assert {x["row_pos"]: x["head"] for x in got.collect()} == {1: "A", 2: "B", 3: None}
    assert "Join" not in got._jdf.queryExecution().toString() and "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()


def test_first_match_judges_each_row(spark):
    """Repeated and null keys, null values, an empty table of rules, and one that is too large."""
    rows = spark.createDataFrame([(1, "a1"), (1, "b2"), (None, "b3"), (2, None)], "k int, t string")
    r = spark.createDataFrame([("b", "TWO", 2), ("a", "ONE", 1)], "w string, out string, ord int")
    got = lookups.contains_lookup(rows, rows["t"], r, "w", "ord", ["out"]).collect()
    assert sorted((str(x["t"]), x["out"]) for x in got) == [("None", None), ("a1", "ONE"), ("b2", "TWO"), ("b3", "TWO")]
    assert [x["out"] for x in lookups.contains_lookup(rows, rows["t"], r.limit(0), "w", "ord", ["out"]).collect()] == [None] * 4
    with pytest.raises(Exception, match="1 rows at most"):
        rows.select(lookups.as_array(r, ["ord"], 1).alias("x")).collect()


def test_classify(spark):
    accounts = spark.createDataFrame([("000111222333", "b", "c", "SW", "Master", "2026-27", 1), ("000444555666", "b", "c", "SW", "RERA", "2026-27", 2), ("777", "b", "c", "HO", "Free", "2026-27", 3)], schemas.ACCOUNTS)
    rules_table = spark.createDataFrame([(1, "", "SPECIAL", "Loan", "HO", "t", "c", "Active")], schemas.OVERRIDE_RULES)
    payees = spark.createDataFrame([("c", "ETA PERSON", "Vendor", "Contractor", None, "Confirmed"), ("c", "IOTA", "Vendor", None, None, "Conflict"), ("c", "IOTA", "Salary HO", None, None, "Conflict")], schemas.PAYEES)
    texts = [("SPECIAL THING", 0, 1), ("transfer to 000444555666", 0, 1), ("BY CLG:x:y", 5, 0), ("UPI/1/x", 5, 0), ("YIB-NEFT-Y1-ETA PERSON-ABCD0123456", 0, 1), ("pay-salary-x", 0, 1), ("a-PF-b", 0, 1), ("GST", 0, 1), ("x-Vendor-y", 0, 1), ("nothing", 0, 1), ("YIB-NEFT-Y1-IOTA-ABCD0123456", 0, 1), ("", 0, 1), (None, 0, 1)]
    rows = spark.createDataFrame([("000111222333", i, t, float(c), float(d)) for i, (t, c, d) in enumerate(texts)], "account_number string, row_pos long, description string, credits double, debits double")
    got = {r["row_pos"]: r for r in rules.classify(rows, accounts, rules_table, payees, rules.Business(keywords={"Vendor": "vend", "Salary HO": "salary"})).collect()}
    assert [got[i]["classified_by"] for i in range(len(texts))] == ["R0", "R1", "R3", "R4", "R6", "R7", "R8", "R10", "R11", "R13", "R6a", "R13", "R13"]
    assert got[1]["type"] == "Master 2 RERA" and got[4]["dual_head"] and got[0]["manual_override"]


def test_engine_head(spark):
    heads = spark.createDataFrame([("Internal", 1, "both", ["Own"], ["SELF"], [], False), ("Vendor", 2, "debit", ["Shop"], ["STORE"], ["(?i)inv[0-9]+"], False), ("Refund", 3, "credit", ["Shop"], ["STORE"], [], False), ("Others", 99, None, [], [], [], True)], schemas.HEAD_RULES)
    parties = spark.createDataFrame([("Own Firm", "Own", ["OWN"], "high"), ("Shop A", "Shop", [], "high"), ("Low", "Own", [], "low")], schemas.PARTIES)
    rows = spark.createDataFrame([(1, "x", "own", 1.0, 0.0), (2, "a store", None, 5.0, 0.0), (3, "a store", None, 0.0, 5.0), (4, "INV12", None, 0.0, 1.0), (5, "q", "Shop A", 5.0, 0.0), (6, "q", "low", 0.0, 1.0), (7, "", None, 0.0, 1.0)], "row_pos long, description string, parsed_party string, credits double, debits double")
    got = {r["row_pos"]: r["engine_head"] for r in rules.engine_head(rows, parties, heads).collect()}
    assert got == {1: "Internal", 2: "Refund", 3: "Vendor", 4: "Vendor", 5: "Refund", 6: "Others", 7: "Others"}


def test_stage_rules(spark):
    r = spark.createDataFrame([(1, "Master", None, None, ["CHARGE"], "Bank Charges", "SW", "HO - Admin", "", "High"), (2, "Master", "credit", None, None, "Collection", "SW", "Customer Collection", "Credit- no effect", "High"), (3, "Master", "debit", "counterparty", None, "Internal", "{unit}", "{pair}", "Internal transfer", "High"), (4, "IDW", "debit", "payee", None, "{payee}", "SW", "x", "y", "High")], rules.STAGE_RULES)
    rows = spark.createDataFrame([(1, "bank charge", "Master", None, "U", None, False, False, False, 0.0, 1.0), (2, "z", "Master", None, "U", None, False, False, False, 1.0, 0.0), (3, "z", "Master", "Free", "U", None, False, False, False, 0.0, 1.0), (4, "z", "IDW", None, "U", "Vendor", False, False, False, 0.0, 1.0), (5, "z", "IDW", None, "U", None, False, False, False, 0.0, 1.0)], "row_pos long, description string, account_stage string, other_stage string, own_unit string, payee_head string, own_company boolean, salary boolean, imprest boolean, credits double, debits double")
    got = {x["row_pos"]: (x["s_head"], x["s_unit"], x["s_type"]) for x in rules.stage_rules(rows, r).collect()}
    assert got == {1: ("Bank Charges", "SW", "HO - Admin"), 2: ("Collection", "SW", "Customer Collection"), 3: ("Internal", "U", "Master to Free"), 4: ("Vendor", "SW", "x"), 5: (None, None, None)}


def test_master(spark):
    names = spark.createDataFrame([("ALPHA PRIVATE LIMITED", "V", 3, 0), ("ALPHA PVT LTD", "V", 1, 1), ("ALPHABET SOUP KITCHEN", "C", 1, 2), ("RAMESHWAR KUMAR SINGH", "C", 2, 3), ("RAMESHWAR KUMER SINGH", "C", 1, 4), ("ABC", "V", 1, 5), ("ABD", "V", 1, 6), ("RAMESH KUMAR", "C", 1, 7), ("RAMESH KUMER", "C", 1, 8)], "name string, head string, n int, first_pos int")
    canonical = {r["name"]: r["canonical"] for r in master.merged_names(names, allow_prefix=False).collect()}
    assert canonical["ALPHA PVT LTD"] == "ALPHA PRIVATE LIMITED" and canonical["RAMESHWAR KUMER SINGH"] == canonical["RAMESHWAR KUMAR SINGH"]
    assert canonical["RAMESH KUMER"] == "RAMESH KUMER" and canonical["RAMESH KUMAR"] == "RAMESH KUMAR"  # a ratio of 0.909
    assert canonical["ABC"] == "ABC" and canonical["ABD"] == "ABD" and canonical["ALPHABET SOUP KITCHEN"] == "ALPHABET SOUP KITCHEN"
    left, right = names.select("name").limit(1), spark.createDataFrame([("ALPHA PVT LTD",), ("ALPHA LTD",)], "name string")
    assert master.fuzzy_one_to_one(left, right).count() == 1


def test_similar_names_against_all_pairs(spark):
    """Random names with a few letters changed anywhere, at both ends too: every pair alike is found, with and without prefixes."""
    import random

    from tallyforge.functions.text import CORPORATE_FORMS

    r = random.Random(5)
    base = ["".join(r.choice("ABCDEFGHIJ") for _ in range(r.randint(4, 34))) for _ in range(25)]

    def changed(s):
        for _ in range(r.randint(0, 3)):
            i = r.choice([0, len(s) - 1, r.randrange(len(s))])
            s = s[:i] + r.choice(["", r.choice("ABCXYZ"), s[i] + "Q"]) + s[i + 1 :] or "A"
        return s + r.choice(["", "", " PVT LTD", " PRIVATE LIMITED", " LTD"])

    names = sorted({changed(s) for s in base for _ in range(5)} | {"XACMEINFRASTRUCTUREBUILDERSINDIAA", "YACMEINFRASTRUCTUREBUILDERSINDIAB"})

    def keys(s):
        t = s.upper()
        for p, put in CORPORATE_FORMS.items():
            t = re.sub(p, put, t)
        return re.sub("[^A-Z0-9]", "", s.upper()), re.sub("[^A-Z0-9]", "", t)

    frame = spark.createDataFrame([(n,) for n in names], "name string")
    for prefix in (False, True):
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if any(master.similar_keys(min(p, q), max(p, q), prefix) for p in set(keys(a)) for q in set(keys(b)))}
        got = {(x["a"], x["b"]) for x in master.similar_pairs(frame, prefix).collect()}
        assert got == want and len(want) > 40
    with pytest.raises(RuntimeError, match="settled"):
        master.components(spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(50)], "a string, b string"), 2)


def test_similarity_against_all_pairs(spark):
    """A word that every text has finds nothing by itself, and counts where others find: as brute force has it."""
    import collections
    import math

    words = ["every", *"alpha beta gamma delta omega sigma kappa zeta".split()]
    texts = {i: "every " + " ".join(words[1 + (i * k) % 8] for k in range(1, 2 + i % 4)) for i in range(60)}
    terms = lambda t: t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:], strict=False)]
    df = collections.Counter(x for t in texts.values() for x in set(terms(t)))

    def vector(t):
        w = {x: (1 + math.log(n)) * (math.log(61 / (1 + df[x])) + 1) for x, n in collections.Counter(terms(t)).items()}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / size for x, v in w.items()}

    v = {i: vector(t) for i, t in texts.items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = similar.top_similar(frame, frame.filter("doc_id < 10"), "doc_id", "text", 7, 0.3, term_rows=7).collect()
    for q in range(10):
        sims = sorted(((-round(sum(v[q][x] * v[d].get(x, 0) for x in v[q]), 9), d) for d in texts))
        assert [r["doc"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [d for s, d in sims if -s >= 0.3][:7]


def test_conflicts(spark):
    old = spark.createDataFrame([("c", "A", "Vendor", None, None, "Confirmed")], schemas.PAYEES)
    new = spark.createDataFrame([("A", "Vendor"), ("A", "Salary HO"), ("B", "X"), ("B", "Y")], "name string, head string")
    inserts, flags = master.updates(new, old)
    assert {(r["name"], r["head1"], r["status"]) for r in inserts.collect()} == {("A", "Salary HO", "Conflict"), ("B", "X", "Pending"), ("B", "Y", "Pending")}
    assert [(r["name"], r["head1"]) for r in flags.collect()] == [("A", "Vendor")]


def test_similarity(spark):
    docs = spark.createDataFrame([(1, "steel rods order", "V"), (2, "steel rods order", "V"), (3, "steel rods paid", "V"), (4, "salary april", "S"), (5, "", "V")], "doc_id long, text string, head string")
    near = similar.top_similar(similar.training_rows(docs), docs.filter("doc_id = 1"), "doc_id", "text")
    got = sorted((r["rank"], r["doc"]) for r in near.collect())
    assert [d for _, d in got] == [1, 2, 3]
    assert similar.vote(near, docs, "doc_id").first()["head"] == "V"


def test_geometry_vocabulary():
    p = geometry.Profile(tokens={"paid": "debits"}, excluded=("channel",))
    assert p.vocabulary()["paid"] == "debits" and "channel" not in p.vocabulary()


def test_first_success_raises_the_first_error():
    def fail(text):
        def f():
            raise ValueError(text)

        return f

    assert first_success([fail("a"), lambda: [(1,)]]) == [(1,)]
    with pytest.raises(ValueError, match="a"):
        first_success([fail("a"), fail("b")])


def test_required(spark):
    with pytest.raises(ValueError, match="transactions"):
        required(spark.range(0))


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429")
        return "ok"

    assert tables.with_retry(call, lambda e: "429" in str(e), sleep=waits.append) == "ok" and waits == [2.0, 4.0]


def test_landing(spark, tmp_path):
    schema = "account_number string, row_pos long, txn_date date, debits double"
    rows = [("1", 1, dt.date(2026, 4, 1), 1.0), ("1", 2, dt.date(2026, 4, 2), 2.0)]
    into, out, review, check = (str(tmp_path / x) for x in ("in", "ledger", "review", "checkpoint"))
    key, order = ["account_number", "txn_date", "debits"], ["row_pos"]

    def run():
        landing.run_landing(landing.landed(spark, into, schema), out, review, check, key, order).awaitTermination(120)
        return spark.read.parquet(out).count(), spark.read.parquet(review).count()

    spark.createDataFrame(rows, schema).write.mode("append").parquet(into)
    assert run() == (2, 0)
    spark.createDataFrame([*rows, ("1", 3, dt.date(2026, 3, 1), 9.0), ("1", 4, dt.date(2026, 4, 3), 3.0)], schema).write.mode("append").parquet(into)
    assert run() == (3, 1)


def test_claims_of_a_fee_that_recurs_for_years(spark):
    """One key with a row every few days for decades, some edited, some moved by days, some missing, some without a date: cut into ranges, the claims are those of one walk over the key."""
    import random

    r = random.Random(8)
    day = lambda n: dt.date(1990, 1, 1) + dt.timedelta(days=n)
    auto, main, at = [], [], 0
    for i in range(3000):
        at += r.choice([0, 1, 2, 5, 9])
        text = r.choice(["fee", "fee", "other"])
        auto.append(("A", i, None if i % 97 == 0 else day(at), Decimal("18.00"), Decimal("0.00"), text))
        if r.random() < 0.8:
            main.append(("A", i, None if i % 89 == 0 else day(at + r.choice([0, 0, 1, 3, 4])), Decimal("18.00"), Decimal("0.00"), r.choice([text, text, text + "!"])))
    shape = "account_number string, row_pos long, txn_date date, debits decimal(18,2), credits decimal(18,2), description string"
    a, m = spark.createDataFrame(auto, shape), spark.createDataFrame(main, shape)
    ranged = reconcile.day_ranges(a.unionByName(m), ["account_number", "debits", "credits"])
    assert ranged.select("days").distinct().count() > 300 and ranged.count() == len(auto) + len(main)
    key = lambda x: (x[2], reconcile_key(x[5]))
    reconcile_key = lambda t: t.upper().replace(" ", "")
    # Bags by day and text: the first rows of each side are used up.
    from collections import Counter

    have, seen = Counter(key(x) for x in main), Counter()
    got_auto = Counter(key(x) for x in auto)
    want, open_rows = {}, []
    for x in auto:
        seen[key(x)] += 1
        if seen[key(x)] <= have[key(x)]:
            want[x[1]] = ("present", None)
        else:
            open_rows.append(x)
    left, n = [], Counter()
    for x in main:
        n[key(x)] += 1
        if n[key(x)] <= have[key(x)] - min(have[key(x)], got_auto[key(x)]):
            left.append(x)
    taken = set()
    for x in open_rows:
        same = [y for y in left if y[1] not in taken and y[2] == x[2]]
        near = [y for y in left if y[1] not in taken and x[2] and y[2] and abs((y[2] - x[2]).days) <= 3 and reconcile_key(y[5]) == reconcile_key(x[5])]
        pick = min(same, key=lambda y: y[1], default=None) or min(near, key=lambda y: (abs((y[2] - x[2]).days), y[1]), default=None)
        want[x[1]] = ("review", pick[1]) if pick else ("new", None)
        taken |= {pick[1]} if pick else set()
    assert {x["auto_pos"]: (x["status"], x["main_pos"]) for x in reconcile.three_way(a, m).collect()} == want and len(taken) > 100


def stages(spark):
    """Number and shuffled records of the stages that ran."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, j = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    ran = store.stageList(j.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(j.double, 0), j.java.util.ArrayList())
    return {x.stageId(): x.shuffleWriteRecords() for x in (ran.apply(i) for i in range(ran.size()))}


def test_rows_matched_by_count_are_shuffled_once(spark):
    """Both ledgers go through one shuffle, whatever is made of them; only rows that no bag matched are shuffled again."""
    rows = [(f"2026-04-{i % 28 + 1:02d}", f"{i}.00", "fee") for i in range(400)]
    a, m = ledger(spark, rows), ledger(spark, rows)
    last = max(stages(spark), default=-1)
    assert {(x["auto_pos"], x["status"]) for x in reconcile.three_way(a, m).collect()} == {(i, "present") for i in range(400)}
    assert sum(n for i, n in stages(spark).items() if i > last) == 800


def test_claims_go_on_over_batches(spark):
    """Groups that lie in several batches, null accounts and amounts, and ranges with rows of one side only."""
    import random

    r = random.Random(5)
    shape = "account_number string, row_pos long, txn_date date, debits decimal(18,2), credits decimal(18,2), description string"
    day = lambda: r.choice([None, *(dt.date(2026, 4, 1) + dt.timedelta(days=n) for n in (0, 1, 2, 3, 12, 13, 40))])
    some = lambda n, last: [(r.choice(["A", None]), i, day(), r.choice([None, Decimal("5.00")]), Decimal("0.00"), r.choice(["fee", "rent"])) for i in range(n)] + [last]
    auto, main = some(200, ("A", 900, dt.date(2027, 1, 1), Decimal("5.00"), Decimal("0.00"), "fee")), some(180, ("A", 901, dt.date(2028, 1, 1), Decimal("5.00"), Decimal("0.00"), "fee"))
    # Bags by count, then each open row looks through all that is left, in order.
    bag = lambda x: (x[0], x[2], x[3], x[5])
    count = lambda rows, x: sum(bag(y) == bag(x) for y in rows)
    left = [y for i, y in enumerate(main) if count(main[: i + 1], y) <= count(main, y) - count(auto, y)]
    want, taken = {}, set()
    for i, x in enumerate(auto):
        if count(auto[: i + 1], x) <= count(main, x):
            want[x[0], x[1]] = ("present", None)
            continue
        free = [y for y in left if (y[0], y[3]) == (x[0], x[3]) and y[1] not in taken]
        near = [(abs((y[2] - x[2]).days), y[1]) for y in free if x[2] and y[2] and y[5] == x[5] and abs((y[2] - x[2]).days) <= 3]
        pick = min((y[1] for y in free if y[2] == x[2]), default=None)
        pick = min(near)[1] if pick is None and near else pick
        want[x[0], x[1]] = ("new" if pick is None else "review", pick)
        taken |= set() if pick is None else {pick}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(x["account_number"], x["auto_pos"]): (x["status"], x["main_pos"]) for x in reconcile.three_way(spark.createDataFrame(auto, shape), spark.createDataFrame(main, shape)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(taken) > 20


def test_copies_of_a_text_meet_as_one_class(spark):
    """Ids are those of all pairs, ties by id over classes too, and no text is weighed once a copy."""
    texts = {i: ("steel rods order", "steel rods paid", "Steel rods order", "salary april", None)[i % 5] for i in range(400)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert similar.classes(frame, "doc_id", "text").count() == 4
    got = {(r["query"], r["rank"]): (r["doc"], round(r["similarity"], 6)) for r in similar.top_similar(frame, frame.filter("doc_id in (10, 12, 13, 14)"), "doc_id", "text", 5, prepared=True).collect()}
    assert [got[10, k] for k in range(1, 6)] == [got[12, k] for k in range(1, 6)] == [(d, 1.0) for d in (0, 2, 5, 7, 10)]
    assert [got[13, k][0] for k in range(1, 6)] == [3, 8, 13, 18, 23] and len(got) == 15


def test_headers_of_many_pages_in_one_batch(spark):
    """Anchors come page by page, without a group a page in Python; a page without a description cell has none."""
    cells = [("Date", 10.0, 40.0), ("Description", 50.0, 90.0), ("Debit", 100.0, 130.0)]
    rows = [(f"d{d}", 0, i, t, a, b, 10.0, 18.0) for d in range(30) for i, (t, a, b) in enumerate(cells) if d % 3 or t != "Description"]
    pages = geometry.page_words(geometry.clustered(spark.createDataFrame(rows, schemas.WORDS)))
    found = geometry.headers(pages)
    assert "InPandas" in found._jdf.queryExecution().toString() and "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {(r["doc_id"], r["field"]): r["anchor"] for r in found.collect()}
    assert len({d for d, _ in got}) == 20 and (got["d1", "txn_date"], got["d1", "description"], got["d1", "debits"]) == (10.0, 50.0, 130.0)


def test_counterparty_among_many_accounts(spark, monkeypatch):
    """Many accounts find what a search of them all finds, a row's own number and ties of order included; beyond 50,000 too."""
    numbers = ["", "7", "123", *(f"{i:09d}" for i in range(100, 180)), *(f"99{i % 3}4000000{i:05d}" for i in range(60)), "000000150"]
    accounts = spark.createDataFrame([(n, "U", f"S{i}", i % 40) for i, n in enumerate(numbers)], "account_number string, business_unit string, account_stage string, account_order int")
    texts = ["to 000 000 105", "x000000150y000000102", "9914000000 00004", "7", None, "", "none", "40000000004100", "a123b7"]
    rows = spark.createDataFrame([(o, t) for t in texts for o in (None, "", "7", "000000150", "000000105", "99140000000004")], "account_number string, description string")
    shown = lambda x: sorted(map(str, x.select("account_number", "description", "other_account", "other_unit", "other_stage").collect()))
    many = shown(lookups.counterparty(rows, accounts))
    monkeypatch.setattr(lookups, "FEW_ACCOUNTS", 1000)
    assert many == shown(lookups.counterparty(rows, accounts))
    monkeypatch.undo()
    large = spark.range(60_000).select(F.concat(F.lit("ACC-"), "id").alias("account_number"), F.lit("U").alias("business_unit"), F.lit("S").alias("account_stage"), F.lit(99).alias("account_order"))
    got = lookups.counterparty(spark.createDataFrame([("ACC-5", "paid ACC-59999 today")], "account_number string, description string"), large).first()
    assert got["other_account"] == "ACC-59"  # the first of equal order, past its own


def test_lines_of_pages_as_whole_rows(spark):
    """Words join lines as a fold over the sorted words has it, stand by line from the left, and only heights go to Python."""
    import random

    rng = random.Random(5)
    rows = [(f"d{d}", p, i, f"w{i}", float(rng.randint(0, 90)), 95.0, rng.choice((1.0, 2.5, 4.0, 5.5, 9.0, 12.5, 40.0)), 50.0) for d in range(3) for p in range(4) for i in range(rng.randint(1, 25))]
    got = geometry.clustered(spark.createDataFrame(rows, schemas.WORDS))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "InPandas" not in plan
    pages = {(r["doc_id"], r["page"]): r for r in got.collect()}
    assert len(pages) == 12
    for key, page in pages.items():
        wanted, anchor, line = [], None, -1
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (r[6], r[4], r[2])):
            if anchor is None or r[6] - anchor > geometry.LINE_TOLERANCE:
                anchor, line = r[6], line + 1
            wanted.append((line, r[4], r[2], r[3], anchor))
        wanted.sort()
        assert [tuple(w)[:5] for w in page["words"]] == wanted
        assert [[w["line_no"] for w in page["words"][s["start"] - 1 : s["start"] - 1 + s["n"]]] for s in page["lines"]] == [[k] * sum(w[0] == k for w in wanted) for k in range(line + 1)]


def test_ends_within_texts(spark):
    """Pieces that may be ends of words lose none, take hardly any other, and the sketch is not carried by the rows."""
    import random

    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("ab1é-€") for _ in range(n))
    words = [made(rng.randint(1, 40)) for _ in range(150)]
    texts = ["", "a", *(made(rng.randint(0, 9)) + w + made(rng.randint(0, 9)) for w in words), *(made(30) for _ in range(150))]
    shown = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known = spark.createDataFrame([(w,) for w in words], "word string")
    ends = {r["word"]: r["e"] for r in known.withColumn("e", pieces.end_hash("word")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["text"]: set(r["found"]) for r in shown.withColumn("found", pieces.ends_within(known)(F.col("text"))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tail = lambda w: w.encode()[-(1 << (len(w.encode()).bit_length() - 1)) :]
    assert len(set(ends.values())) == len({tail(w) for w in words})
    for t in texts:
        assert got[t] >= {ends[w] for w in words if tail(w) in t.encode()}
    assert sum(len(found - set(ends.values())) for found in got.values()) < 0.1 * sum(len(t.encode()) for t in texts)
    assert spark.createDataFrame([("",)], "word string").select(pieces.end_hash("word")).first()[0] is None
    accounts = spark.range(100).select(F.concat(F.lit("ACC-"), "id").alias("account_number"), F.lit("U").alias("business_unit"), F.lit("S").alias("account_stage"), F.col("id").cast("int").alias("account_order"))
    plan = lookups.counterparty(spark.createDataFrame([("ACC-5", "to ACC-7")], "account_number string, description string"), accounts)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "_sketch" not in plan


def test_words_without_spaces_hold_what_words_hold(spark):
    """The shortened conditions are those of plain Python: a word itself, or without spaces from five letters on; segments and roles by their own text."""
    texts = ["SAFE BOX", "SAF EBOX", "SB OX", "A SBOX-1", "P OS GST", "posgst", "LF CHG", "L FCHG", "-PF-", "EP F", "a/Prof", "x-pro f-y", "pay/site vendor", "im prest-x", "an imprest", "imprests", "a-b/SALARY", "cancellation of-x", "Cont ractor/1", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    got = frame.select("t", rules.contains_any(t, rules.BANK_CHARGES).alias("c"), names.role_in(t).alias("role"), names.mentions_segment(t, "imprest").alias("imprest"), text.segments(t).alias("s")).collect()
    for r in got[:-1]:
        up, low = r["t"].upper(), r["t"].lower()
        parts = [p.strip() for p in re.split("[-/]", low)]
        assert r["s"] == re.split("[-/]", r["t"])
        assert r["c"] == any(w in up or (len(w.replace(" ", "")) >= 5 and w.replace(" ", "") in up.replace(" ", "")) for w in rules.BANK_CHARGES), r["t"]
        assert r["imprest"] == any(p.replace(" ", "") == "imprest" or p.endswith(" imprest") for p in parts), r["t"]
    assert [r["role"] for r in got] == [None] * 10 + ["Professional", "Professional", "Vendor", "Imprest", "Imprest", None, None, "Cancellation", "Contractor", None]
    assert got[-1]["c"] is None and got[-1]["imprest"] is None


def test_every_row_votes(spark):
    """Rows of one text take the vote of their class; every row with a text asks, whatever its id."""
    from tallyforge.plans import ledger

    texts = {i: ("steel rods order", "steel rods paid", "salary april", None, "steel rods paid twice")[i % 5] for i in range(1, 120)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = frame.select("doc_id", F.when(F.col("doc_id") % 7 < 4, "A").otherwise("B").alias("head"))
    got = {tuple(r) for r in similar.votes_of_all(frame, labels, "doc_id", "text", prepared=True).collect()}
    near = similar.top_similar(frame, frame, "doc_id", "text", prepared=True)
    assert got == {tuple(r) for r in similar.vote(near, labels, "doc_id").collect()}
    assert {q for q, *_ in got} == {i for i, t in texts.items() if t}
    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet")
    voted = ledger.vote_topk(spark, sf)
    assert voted.filter("query % 20 > 0").count() and voted.count() == voted.join(parts, F.col("query") == F.col("p_partkey")).count()
    assert "% 20" not in ledger.ORACLES["vote_topk"] and "q.doc % 20 = 0" in ledger.ORACLES["tfidf_topk"]
