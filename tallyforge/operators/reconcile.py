"""Reconciling one ledger with another: bags, leftovers, three-way matching and placement by balances."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed_upper
from ..sources.tables import settled
from .lookups import occurrence

NEAR_DAYS, BALANCE_TOLERANCE = 3, 5.0


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("description_key", squeezed_upper(F.coalesce("description", F.lit(""))))


def bag_matched(auto: DataFrame, main: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(present, unmatched, leftover): the first rows of auto's key are matched by count with main's; of main the first rows beyond those consumed are left.

    Counts and row numbers are shuffled by the key, once a side.
    """
    totals = lambda df, name: df.groupBy(*(F.col(k).alias(f"_k_{k}") for k in key)).agg(F.count(F.lit(1)).alias(name))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    a, m = occurrence(auto, key, order, "_rn"), occurrence(main, key, order, "_rn").withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    marked = a.join(totals(main, "_n"), same, "left").select(*auto.columns, (F.coalesce("_n", F.lit(0)) >= F.col("_rn")).alias("_present"))
    left = m.join(totals(auto, "_n"), same, "left").select(*main.columns, (F.col("_rn") <= F.col("_c") - F.least(F.col("_c"), F.coalesce("_n", F.lit(0)))).alias("_left"))
    return marked.filter("_present").drop("_present"), marked.filter("not _present").drop("_present"), left.filter("_left").drop("_left")


def bag_difference(auto: DataFrame, main: DataFrame, key: list[str]) -> DataFrame:
    """Keys of auto beyond main's, with multiplicity."""
    return auto.select(*key).exceptAll(main.select(*key))


_MATCHED = "account_number string, auto_pos long, main_pos long, status string, reason string"


def bag_marked(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows of both ledgers (is_main) with is_first: an automated row is matched by count if it is, a row of the main ledger is left over if it is.

    Both sides go through one shuffle by the key and one sort: with the automated rows before the others, the first n of a bag,
    n being its rows in the main ledger, are the matched automated ones and then, if there are fewer of those, what is left over.
    """
    w = Window.partitionBy(*key).orderBy("is_main", *order)
    n_main = F.sum(F.col("is_main").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("*", F.row_number().over(w).alias("_rn"), n_main.alias("_n")).select(*rows.columns, (F.col("_rn") <= F.col("_n")).alias("is_first"))


def _claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (account, debits, credits, days), the main ledger's before the automated ones: within a group each automated row in order claims at most one leftover row.

    Leftover rows wait in queues by day and by (text, day), in their order; claimed ones leave a queue when they come to its
    front, so a fee that recurs thousands of times costs each row a few looks.
    """
    group = ["debits", "credits", "days", "account_number"]
    before = None
    by_day: dict[int, deque[int]] = {}
    by_text: dict[tuple[str, int], deque[int]] = {}
    taken: set[int] = set()

    def front(queue: deque[int] | None) -> int | None:
        while queue and queue[0] in taken:
            queue.popleft()
        return queue[0] if queue else None

    for batch in batches:
        if not len(batch):
            continue
        # Where a group begins is found for the whole batch; a null is like another null.
        begins = pd.Series(False, index=batch.index)
        for c in group:
            begins |= ~((batch[c] == batch[c].shift()) | (batch[c].isna() & batch[c].shift().isna()))
        first = tuple(None if pd.isna(v) else v for v in batch[group].iloc[0])
        begins.iloc[0] = first != before
        before = tuple(None if pd.isna(v) else v for v in batch[group].iloc[-1])
        accounts, positions, claims, reasons = [], [], [], []
        for new, side, account, pos, day, days, text in zip(begins.tolist(), *(batch[c].tolist() for c in ("side", "account_number", "row_pos", "day", "days", "description_key")), strict=True):
            if new:
                by_day, by_text, taken = {}, {}, set()
            if side == 0:
                by_day.setdefault(day, deque()).append(pos)
                by_text.setdefault((text, day), deque()).append(pos)
                continue
            claim, reason = front(by_day.get(day)), "same date and amount, different description"
            # Rows without a date are the range -1.
            if claim is None and days >= 0:
                reason = "same amount and description, different date"
                for apart in range(1, NEAR_DAYS + 1):
                    claim, other = front(by_text.get((text, day - apart))), front(by_text.get((text, day + apart)))
                    if claim is None or (other is not None and other < claim):
                        claim = other
                    if claim is not None:
                        break
            if claim is not None:
                taken.add(claim)
            accounts.append(account)
            positions.append(pos)
            claims.append(claim)
            reasons.append(None if claim is None else reason)
        if positions:
            claimed = pd.array(claims, dtype="Int64")
            status = pd.Series("new", index=range(len(claims))).where(claimed.isna(), "review")
            yield pd.DataFrame({"account_number": pd.Series(accounts, dtype=object), "auto_pos": positions, "main_pos": claimed, "status": status, "reason": pd.Series(reasons, dtype=object)})


def day_ranges(rows: DataFrame, key: list[str], day: str = "txn_date", apart: int = NEAR_DAYS, side: str | None = None) -> DataFrame:
    """rows with days, the number of the range of days that they lie in: ranges of a key are further apart than a claim reaches, so each can be settled by itself.

    What is scanned is the distinct days of a key, not its rows. Rows without a date are a range of their own, -1. Keys may be null.
    With side, a boolean column, rows get two_sided as well: whether the range has rows of both sides.
    """
    x = rows.withColumn("_d", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    sides = F.lit(None).cast("boolean") if side is None else F.col(side)
    w = Window.partitionBy(*key).orderBy("_d")
    distinct = x.groupBy(*key, "_d").agg(F.min(sides).alias("_low"), F.max(sides).alias("_high")).withColumn("_gap", F.coalesce((F.col("_d") - F.lag("_d").over(w) > apart).cast("int"), F.lit(0)))
    known = distinct.select(*key, "_d", "_low", "_high", F.when(F.col("_d").isNull(), -1).otherwise(F.sum("_gap").over(w)).cast("long").alias("days"))
    if side is not None:
        r = Window.partitionBy(*key, "days")
        known = known.withColumn("two_sided", F.min("_low").over(r) != F.max("_high").over(r))
    added = known.columns[len(key) + 3 :]
    on = F.lit(True)
    for k in (*key, "_d"):
        on = on & x[k].eqNullSafe(F.col(f"_d_{k}"))
    return x.join(known.select(*(F.col(k).alias(f"_d_{k}") for k in (*key, "_d")), *added), on).select(*rows.columns, *added)


def three_way(auto: DataFrame, main: DataFrame) -> DataFrame:
    """present, review or new for each automated row: bags first, then claims within (account, debits, credits) and a range of days, outside which no claim can reach.

    A fee that recurs for years is cut where no row lies within the reach of a claim, so its ranges go to many tasks.
    The ledgers are read once, and all of their rows are shuffled once; what follows is of the rows that no bag matched.
    Both sides: account_number, row_pos, txn_date, debits, credits, description.
    """
    key = ["debits", "credits", "txn_date", "account_number", "description_key"]
    sided = lambda df, is_main: with_fingerprint(df).select(*key, "row_pos", F.lit(is_main).alias("is_main"))
    marked = bag_marked(sided(auto, False).unionByName(sided(main, True)), key, ["row_pos"])
    marked = settled(marked.filter("is_first or not is_main"))
    settled_as = lambda df, status: df.select("account_number", F.col("row_pos").alias("auto_pos"), F.lit(None).cast("long").alias("main_pos"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("reason"))
    present = settled_as(marked.filter("is_first and not is_main"), "present")
    ranged = day_ranges(marked.filter("is_first = is_main"), ["debits", "credits", "account_number"], side="is_main")
    # A range without rows of the main ledger needs no matching and stays in the JVM.
    plain = settled_as(ranged.filter("not two_sided and not is_main"), "new")
    # A range streams through its task in order; nothing of it is held but what may still be claimed.
    group = ("debits", "credits", "days", "account_number")
    day = F.coalesce(F.datediff(F.col("txn_date"), F.lit("1970-01-01").cast("date")), F.lit(0)).alias("day")
    asked = ranged.filter("two_sided").select((~F.col("is_main")).cast("int").alias("side"), "account_number", "row_pos", day, *(F.col(c).cast("string").alias(c) for c in ("debits", "credits")), "days", "description_key")
    matched = asked.repartition(*group).sortWithinPartitions(*group, "side", "row_pos").mapInPandas(_claims, _MATCHED)
    return present.unionByName(matched).unionByName(plain)


def nearest_by_date(left: DataFrame, right: DataFrame, key: list[str], day: str, ident: str, days: int = NEAR_DAYS) -> DataFrame:
    """The nearest row of right within so many days, not one to one: band join on day buckets, so a key's rows are never all paired."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (days + 1))
    a = left.withColumn("_b", F.explode(F.array(*(bucket(F.col(day)) + i for i in (-1, 0, 1)))))
    b = right.select(*(F.col(k).alias(f"_r_{k}") for k in key), F.col(day).alias("_r_day"), F.col(ident).alias("_r_id"), bucket(F.col(day)).alias("_rb"))
    on = (a["_b"] == b["_rb"]) & (F.abs(F.datediff(a[day], b["_r_day"])) <= days) & (a[ident] != b["_r_id"])
    for k in key:
        on = on & (a[k] == b[f"_r_{k}"])
    return a.join(b, on).groupBy(*(a[k] for k in key), a[ident], a[day]).agg(F.min(F.struct(F.abs(F.datediff(day, "_r_day")).alias("days"), F.col("_r_id").alias("id"))).alias("_n")).select(*key, ident, day, F.col("_n.id").alias("near_id"), F.col("_n.days").alias("near_days"))


_NEAREST = "account_number string, value long, first_new boolean, first_pos long, second_new boolean, second_pos long"
#: Balances are dealt out in cells of so many cents; candidates within the tolerance of a cell's edge go to both of its sides.
CELL_CENTS = 100_000
RANK_ROWS = 1 << 16


def _cents(c: str) -> Column:
    return F.round(F.col(c).try_cast("decimal(20,2)") * 100).cast("long")


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates and asked values of a cell in the order of their values: for each asked one the first two candidates, in pool order, within the tolerance.

    A heap in pool order holds the candidates that a later value may still reach: two a cent at most.
    """
    reach = round(200 * BALANCE_TOLERANCE)
    group, heap, most = None, [], 4096
    for batch in batches:
        out = []
        for account, cell, at, asked, new, pos in zip(*(batch[c] for c in ("account_number", "cell", "at", "asked", "is_new", "row_pos")), strict=True):
            if (account, cell) != group:
                group, heap, most = (account, cell), [], 4096
            if not asked:
                heapq.heappush(heap, (bool(new), int(pos), at))
                if len(heap) > most:
                    heap = [x for x in heap if x[2] >= at - reach]
                    heapq.heapify(heap)
                    most = max(4096, 2 * len(heap))
                continue
            found = []
            while heap and len(found) < 2:
                x = heapq.heappop(heap)
                if x[2] >= at - reach:
                    found.append(x)
            for x in found:
                heapq.heappush(heap, x)
            (a, b, _), (c, d, _) = (found + [(None, None, None)] * 2)[:2]
            out.append((account, at - reach // 2, a, b, c, d))
        found = pd.DataFrame(out, columns=["account_number", "value", "first_new", "first_pos", "second_new", "second_pos"])
        yield found.astype({"first_new": "boolean", "first_pos": "Int64", "second_new": "boolean", "second_pos": "Int64"})


def nearest_values(pool: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (account_number, value) the first two rows of the pool (account_number, value, is_new, row_pos), older ones before new ones, whose value is within the tolerance.

    Two rows of each value can be among them at most, so no more go on, and a value is asked once, however many rows
    ask for it: work and memory of a task follow the distinct cents of a cell, not the rows of an account.
    """
    far = round(100 * BALANCE_TOLERANCE)
    w = Window.partitionBy("account_number", "value").orderBy("is_new", "row_pos")
    few = pool.filter("value is not null").withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    cell = lambda v: F.floor(v / CELL_CENTS)
    both = F.array_distinct(F.array(cell(F.col("value") - far), cell(F.col("value") + far)))
    here = few.select("account_number", F.explode(both).alias("cell"), F.col("value").alias("at"), F.lit(False).alias("asked"), "is_new", "row_pos")
    there = asked.filter("value is not null").distinct().select("account_number", cell(F.col("value")).alias("cell"), (F.col("value") + far).alias("at"), F.lit(True).alias("asked"), F.lit(None).cast("boolean").alias("is_new"), F.lit(None).cast("long").alias("row_pos"))
    dealt = here.unionByName(there).repartition("account_number", "cell").sortWithinPartitions("account_number", "cell", "at", "asked")
    return dealt.mapInPandas(_nearest, _NEAREST)


def _beside(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
    """left and what right has for it, by columns of left and their names in right; null accounts are one account."""
    r = right.select(*(F.col(c).alias(f"_on_{c}" if c in on.values() else c) for c in right.columns))
    same = F.lit(True)
    for a, b in on.items():
        same = same & (F.col(a).eqNullSafe(F.col(f"_on_{b}")) if a == "account_number" else F.col(a) == F.col(f"_on_{b}"))
    return left.join(r, same, how).drop(*(f"_on_{b}" for b in on.values()))


def _reached(links: DataFrame) -> DataFrame:
    """links (account_number, row_pos, next) with head and seq: the first row, of those that no other points to, from which a row is reached, and how far from it it lies.

    Pointers double, so a chain of n rows takes log2(n) rounds, each of them settled. Rows that only a ring reaches have no head.
    """
    pointed = links.filter("next is not null").select("account_number", F.col("next").alias("row_pos"), F.lit(True).alias("_pointed")).distinct()
    start = _beside(links, pointed, {"account_number": "account_number", "row_pos": "row_pos"})
    best = F.when(F.col("_pointed").isNull(), F.struct(F.col("row_pos").alias("head"), F.lit(0).cast("long").alias("seq")))
    x = settled(start.select("account_number", "row_pos", best.alias("best"), F.col("next").alias("jump")))
    most = x.groupBy("account_number").count().agg(F.max("count")).first()[0] or 0
    step = 1
    # Whoever still has a pointer after as many steps as there are rows goes round in a ring, and all that reach it have told it so.
    while step <= most and x.filter("jump is not null").limit(1).count():
        told = x.filter("jump is not null and best is not null").groupBy("account_number", F.col("jump").alias("row_pos")).agg(F.min(F.struct("best.head", (F.col("best.seq") + step).alias("seq"))).alias("_told"))
        beyond = x.filter("jump is not null").select("account_number", "row_pos", F.col("jump").alias("_jump"))
        y = _beside(x, told, {"account_number": "account_number", "row_pos": "row_pos"})
        y = _beside(y, beyond, {"account_number": "account_number", "jump": "row_pos"})
        nxt = settled(y.select("account_number", "row_pos", F.least("best", "_told").alias("best"), F.col("_jump").alias("jump")))
        if x.is_cached:
            x.unpersist()
        x, step = nxt, 2 * step
    return x.select("account_number", "row_pos", "best.head", "best.seq")


def _numbered(heads: DataFrame) -> DataFrame:
    """heads with block: their rank within the account by (ring, row_pos), from 0; ranks within runs of positions are added to those of the runs before."""
    x = heads.withColumn("_run", F.floor(F.col("row_pos") / RANK_ROWS))
    runs = x.groupBy("account_number", "ring", "_run").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("account_number").orderBy("ring", "_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col("account_number").alias("_a"), F.col("ring").alias("_g"), F.col("_run").alias("_r"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("account_number", "ring", "_run").orderBy("row_pos")
    y = x.join(starts, F.col("account_number").eqNullSafe(F.col("_a")) & (F.col("ring") == F.col("_g")) & (F.col("_run") == F.col("_r")))
    return y.withColumn("block", (F.col("_start") + F.row_number().over(within) - 1).cast("int")).select(*heads.columns, "block")


def placed(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Where new rows belong between existing ones (newest first): account_number, block, seq, row_pos, upper_row, lower_row.

    A new row points to the first other row, existing ones first, whose balance is the one before it; chains are walked from rows
    that no new row points to, each row once, and end at an existing row (lower_row). upper_row is the first existing row
    before which the chain's first balance stood. Rows of a ring that no chain enters stand alone, without rows above and below.

    row_pos tells the rows of one side of an account apart. Amounts count in cents; rows with a null amount point nowhere, and
    nothing points to a null balance. Null accounts are one account, and an empty side is no exception.
    No account goes through one task: see nearest_values and _reached.
    """
    amounts = lambda df, is_new: df.select(F.col("account_number").cast("string").alias("account_number"), F.col("row_pos").cast("long").alias("row_pos"), F.lit(is_new).alias("is_new"), _cents("balance").alias("balance"), (_cents("balance") - _cents("credits") + _cents("debits")).alias("target"))
    rows = settled(amounts(existing, False).unionByName(amounts(new, True)))
    fresh = rows.filter("is_new")
    near = nearest_values(rows.withColumnRenamed("balance", "value"), fresh.select("account_number", F.col("target").alias("value")))
    found = _beside(fresh, near, {"account_number": "account_number", "target": "value"})
    itself = F.coalesce(F.col("first_new") & (F.col("first_pos") == F.col("row_pos")), F.lit(False))
    at, is_new = F.when(itself, F.col("second_pos")).otherwise(F.col("first_pos")), F.when(itself, F.col("second_new")).otherwise(F.col("first_new"))
    links = settled(found.select("account_number", "row_pos", "balance", F.when(is_new, at).alias("next"), F.when(~is_new, at).alias("lower")))

    chains = settled(_beside(links, _reached(links.select("account_number", "row_pos", "next")), {"account_number": "account_number", "row_pos": "row_pos"}))
    chains = chains.withColumns({"ring": F.col("head").isNull(), "head": F.coalesce("head", "row_pos"), "seq": F.coalesce("seq", F.lit(0))})
    heads = chains.groupBy("account_number", "ring", F.col("head").alias("row_pos")).agg(F.max(F.when(~F.col("ring"), F.col("lower"))).alias("lower_row"), F.max(F.when((F.col("seq") == 0) & ~F.col("ring"), F.col("balance"))).alias("_first"))
    above = nearest_values(rows.filter("not is_new").select("account_number", F.col("target").alias("value"), "is_new", "row_pos"), heads.select("account_number", F.col("_first").alias("value")))
    blocks = _numbered(_beside(heads, above.select("account_number", "value", F.col("first_pos").alias("upper_row")), {"account_number": "account_number", "_first": "value"}))
    told = _beside(chains.select("account_number", "head", F.col("seq").cast("int").alias("seq"), "row_pos"), blocks.select("account_number", F.col("row_pos").alias("head"), "block", "upper_row", "lower_row"), {"account_number": "account_number", "head": "head"})
    return told.select("account_number", "block", "seq", "row_pos", "upper_row", "lower_row")


def placement_plan(new: DataFrame, ledger: DataFrame, ascending: DataFrame) -> DataFrame:
    """place: append, review, top or chain for each new row, by its account's direction and the dates at the ledger's end.

    ascending: account_number, is_ascending.
    """
    ends = ledger.groupBy("account_number").agg(F.max("txn_date").alias("_last"))
    x = new.join(ends, "account_number", "left").join(ascending, "account_number", "left")
    oldest = new.groupBy("account_number").agg(F.min("txn_date").alias("_oldest"))
    x = x.join(oldest, "account_number")
    fits = F.col("_last").isNull() | (F.col("txn_date") >= F.col("_last"))
    place = F.when(F.coalesce("is_ascending", F.lit(False)), F.when(fits, "append").otherwise("review")).when(F.col("_last").isNull() | (F.col("_oldest") >= F.col("_last")), "top").otherwise("chain")
    return x.withColumn("place", place).drop("_last", "_oldest", "is_ascending")


def cross_check(reference: DataFrame, live: DataFrame, key: list[str], order: list[str], field: str) -> DataFrame:
    """outcome (matched, mismatched, skipped) of each reference row against the k-th live row of its key."""
    a, b = occurrence(reference, key, order, "_rn"), occurrence(live, key, order, "_rn").select(*(F.col(k).alias(f"_l_{k}") for k in key), F.col("_rn").alias("_l_rn"), F.col(field).alias("live_value"))
    on = a["_rn"] == b["_l_rn"]
    for k in key:
        on = on & a[k].eqNullSafe(b[f"_l_{k}"])
    x = a.join(b, on, "left")
    outcome = F.when(F.col("_l_rn").isNull(), "skipped").when(F.col(field).eqNullSafe(F.col("live_value")), "matched").otherwise("mismatched")
    return x.select(*reference.columns, "live_value", outcome.alias("outcome"))
