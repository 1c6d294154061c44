"""State within streams, the mailbox and the sketch of stored keys, each against the plain answer on the same rows."""

from __future__ import annotations

import datetime as dt
import shutil
from email.message import EmailMessage

import pytest

from pyspark.sql import functions as F

from tallyforge.operators.ingest import keep_first, not_loaded
from tallyforge.sources.sketch import SketchedLedger
from tallyforge.streaming import guarding, landing, mailbox

ATTEMPTS = "file string, status string, at timestamp"


def _at(minute: int) -> dt.datetime:
    return dt.datetime(2026, 4, 1) + dt.timedelta(minutes=minute)


def test_failures_are_counted_across_restarts(spark, tmp_path):
    into, out, check = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    batches = [
        [("a", "failed", _at(0)), ("b", "success", _at(1)), ("c", None, None), (None, "failed", _at(1))],
        [("a", "failed", _at(2)), ("b", "failed", _at(3)), (None, "failed", _at(2))],
        [("a", "success", _at(5)), ("d", "failed", None), ("d", "failed", None)],
    ]
    for rows in batches:  # each run is a query of its own, started anew from the checkpoint
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(into)
        q = guarding.run_updates(guarding.guarded(landing.landed(spark, into, ATTEMPTS)), out, check)
        assert q.awaitTermination(120)
    got = {r.file: (r.n_tried, r.n_failed, r.last_at, r.is_skipped) for r in guarding.newest(spark, out, "file").collect()}
    assert got == {"a": (3, 2, _at(5), True), "b": (2, 1, _at(3), False), "c": (1, 0, None, False), "d": (2, 2, None, True), None: (2, 2, _at(2), True)}
    plain = {r.file: r.n_failed for r in landing.failures(spark.read.parquet(into)).collect()}
    assert {f: n for f, (_, n, _, skipped) in got.items() if skipped} == plain


def test_a_timer_ends_the_state_of_a_file(spark, tmp_path):
    into, out, check = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for rows in ([("a", "failed", _at(0)), ("a", "failed", _at(1))], [("b", "success", _at(90))], [("b", "success", _at(91))], [("a", "failed", _at(92))]):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(into)
        stream = landing.landed(spark, into, ATTEMPTS).withWatermark("at", "5 minutes")
        guarding.run_updates(guarding.guarded(stream, keep_ms=60 * 60 * 1000), out, check).awaitTermination(120)
    states = spark.read.parquet(out).filter("file = 'a'").orderBy("batch").select("n_failed", "is_skipped", "is_ended").collect()
    assert [tuple(s) for s in states] == [(2, True, False), (2, False, True), (1, False, False)]


def test_latest_status_in_a_stream(spark, tmp_path):
    into, out, check = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "key string, status_json string, updated_at timestamp"
    for rows in ([("x", "1", _at(5)), ("x", "0", _at(1)), ("y", None, _at(9)), ("y", "p", None)], [("x", "late", _at(2)), ("y", "q", _at(3))], [("y", "z", _at(3)), ("y", "a", _at(3))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(into)
        guarding.run_updates(guarding.latest_statuses(landing.landed(spark, into, schema)), out, check).awaitTermination(120)
    got = {r.key: (r.status_json, r.updated_at) for r in guarding.newest(spark, out, "key").collect()}
    assert got == {"x": ("1", _at(5)), "y": ("z", _at(3))}
    # A status that came late changes nothing, so it gives no row.
    assert spark.read.parquet(out).filter("key = 'x'").count() == 1
    plain = landing.latest_status(spark.read.parquet(into).filter("key = 'x'")).collect()[0]
    assert (plain.status_json, plain.updated_at) == got["x"]


def test_states_of_many_keys_need_no_python(spark, tmp_path):
    """State that nothing ends is added up in the JVM: no call a key."""
    stream = spark.readStream.format("rate").load().select(F.col("value").cast("string").alias("file"), F.lit("failed").alias("status"), F.col("timestamp").alias("at"))
    plan = lambda x: x._jdf.queryExecution().logical().toString()
    assert "InPySpark" not in plan(guarding.guarded(stream)) and "InPandas" not in plan(guarding.guarded(stream))
    statuses = stream.select(F.col("file").alias("key"), F.col("status").alias("status_json"), F.col("at").alias("updated_at"))
    assert "InPySpark" not in plan(guarding.latest_statuses(statuses)) and "InPandas" not in plan(guarding.latest_statuses(statuses))
    assert "TransformWithState" in plan(guarding.guarded(stream.withWatermark("at", "1 minute"), keep_ms=1000))


LEDGER = "account_number string, txn_date date, debits double, text string, row_pos long"
KEY = ["account_number", "txn_date", "debits", "text"]


def _statement(spark, days: range, again: int = 0):
    """Rows of 20 accounts for these days, of which every again-th comes twice; nulls and empty texts in keys."""
    x = spark.range(days.start * 20, days.stop * 20).select(
        F.when(F.col("id") % 20 > 0, (F.col("id") % 20).cast("string")).alias("account_number"), F.date_add(F.lit(dt.date(2026, 1, 1)), F.floor(F.col("id") / 20).cast("int")).alias("txn_date"),
        F.when(F.col("id") % 7 == 0, -0.0).otherwise(F.col("id") % 7).alias("debits"), F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 > 1, F.concat(F.lit("t"), F.col("id") % 3)).alias("text"), F.col("id").alias("row_pos"),
    )
    return x.unionByName(x.filter(F.col("row_pos") % again == 0)) if again else x


def test_new_rows_read_only_parts_that_may_hold_them(spark, tmp_path):
    ledger = SketchedLedger(spark, str(tmp_path / "ledger"), KEY, LEDGER)
    plain = spark.createDataFrame([], LEDGER)
    read = []
    for n, days in enumerate([range(0, 30), range(30, 60), range(60, 90), range(50, 70), range(0, 30)]):
        rows = _statement(spark, days, again=3)
        plain = spark.createDataFrame(plain.unionByName(keep_first(not_loaded(rows, plain, KEY), KEY, ["row_pos"])).collect(), LEDGER)
        read.append(ledger.add_new(rows, f"b{n}", ["row_pos"]))
    rows = lambda d: sorted((tuple(map(str, r)) for r in d.collect()))
    norm = plain.withColumn("debits", F.col("debits") + 0.0)
    assert rows(ledger.read()) == rows(norm)
    assert read == [0, 0, 0, 2, 1] and ledger.parts() == {f"b{n}" for n in range(5)}
    # A batch that is run anew gives the same part; one that has no sketch is read.
    ledger.add_new(_statement(spark, range(30, 60), again=3), "b1", ["row_pos"])
    assert rows(ledger.read()) == rows(norm)
    shutil.rmtree(tmp_path / "ledger" / "sketches" / "part=b2")
    assert ledger.may_hold(_statement(spark, range(200, 210))) == {"b2"}


def test_a_full_sketch_is_less_selective_but_right(spark, tmp_path):
    tiny = SketchedLedger(spark, str(tmp_path / "ledger"), KEY, LEDGER, word_bits=1)
    tiny.add_new(_statement(spark, range(0, 30)), "a", ["row_pos"])
    assert tiny.may_hold(_statement(spark, range(100, 130))) == {"a"}  # all bits are set
    assert tiny.add_new(_statement(spark, range(10, 40)), "b", ["row_pos"]) == 1
    whole = keep_first(_statement(spark, range(0, 40)), KEY, ["row_pos"])
    assert tiny.read().select(*KEY).distinct().count() == tiny.read().count() == whole.count()


def test_landing_in_parts_equals_landing_whole(spark, tmp_path):
    into, out, review, check = (str(tmp_path / x) for x in ("in", "ledger", "review", "checkpoint"))
    parts, aside = (SketchedLedger(spark, str(tmp_path / x), KEY, LEDGER) for x in ("parts", "aside"))
    for days in (range(10, 20), range(15, 25), range(5, 12)):
        _statement(spark, days, again=2).coalesce(1).write.mode("append").parquet(into)
        stream = landing.landed(spark, into, LEDGER)
        landing.run_landing(stream, out, review, check, KEY, ["row_pos"]).awaitTermination(120)
        landing.run_parts(stream, parts, aside, check + "-parts", ["row_pos"]).awaitTermination(120)
    rows = lambda d: sorted((tuple(map(str, r)) for r in d.select(LEDGER_COLUMNS).withColumn("debits", F.col("debits") + 0.0).collect()))
    assert rows(parts.read()) == rows(spark.read.parquet(out)) and rows(aside.read()) == rows(spark.read.parquet(review))
    assert len(parts.parts()) == 3 and aside.read().count() > 0


LEDGER_COLUMNS = [c.split()[0] for c in LEDGER.split(", ")]


def _mail(folder, name: str, body: str, files: dict[str, bytes], html: bool = False) -> None:
    m = EmailMessage()
    m["To"], m["From"], m["Subject"] = "books@example.org", "bank@example.org", f"Statement {name}"
    m.set_content("<p>" + body + "</p>", subtype="html") if html else m.set_content(body)
    for f, content in files.items():
        m.add_attachment(content, maintype="application", subtype="octet-stream", filename=f)
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(m.as_bytes())


def _run(spark, box, tmp_path, load, **options):
    mailbox.run_mailbox(mailbox.mailbox(spark, str(box), str(tmp_path / "state"), **options), load, str(tmp_path / "checkpoint"), str(tmp_path / "state"))


def test_a_failed_batch_loses_and_doubles_no_mail(spark, tmp_path):
    box, out = tmp_path / "box", str(tmp_path / "out")
    _mail(box, "m2.eml", "account no. XX1234", {"a.PDF": b"1", "note.txt": b"x", "b.pdf": b"\x00\xff"})
    _mail(box, "m3.eml", "none here", {}, html=True)

    def load(rows, batch):
        rows.withColumn("batch_no", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    def lost(rows, batch):
        load(rows, batch)
        raise RuntimeError("lost after it was written")

    with pytest.raises(Exception, match="lost after"):
        _run(spark, box, tmp_path, lost)
    assert mailbox.acknowledged(spark, str(tmp_path / "state")).count() == 0
    _mail(box, "m1.eml", "late, with an older name", {"c.pdf": b"3"})
    _mail(box, "m4.eml", "more", {"d.pdf": b"4"})
    _run(spark, box, tmp_path, load, maxMessages="1")
    _mail(box, "m0.eml", "last", {"e.pdf": b"5"})
    _run(spark, box, tmp_path, load)
    _run(spark, box, tmp_path, load)  # nothing new
    got = sorted((r.name, r.filename, None if r.content is None else bytes(r.content)) for r in spark.read.parquet(out).collect())
    assert got == [("m0.eml", "e.pdf", b"5"), ("m1.eml", "c.pdf", b"3"), ("m2.eml", "a.PDF", b"1"), ("m2.eml", "b.pdf", b"\x00\xff"), ("m3.eml", None, None), ("m4.eml", "d.pdf", b"4")]
    assert {r.name for r in mailbox.acknowledged(spark, str(tmp_path / "state")).collect()} == {f"m{i}.eml" for i in range(5)}


def test_mail_of_every_shape():
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("forwarded")
    inner.add_attachment(b"deep", maintype="application", subtype="pdf", filename="deep.pdf")
    outer = EmailMessage()
    outer.set_content("plain text")
    outer.add_alternative("<b>html</b>", subtype="html")
    outer.add_attachment(inner)
    rows = mailbox.message_rows(outer.as_bytes(), "x", ".pdf")
    assert [(r[4], r[5], r[6], r[7], r[8]) for r in rows] == [("plain text", 1, "deep.pdf", b"deep", None)]
    assert mailbox.message_rows(b"", "empty", ".pdf") == [("empty", None, None, None, "", None, None, None, None)]
    assert len(mailbox.message_rows(b"\xff\xfe not mail \x00" * 100, "odd", ".pdf")) == 1
    broken = b"Content-Type: application/pdf; name=a.pdf\nContent-Disposition: attachment; filename=a.pdf\nContent-Transfer-Encoding: base64\n\nnot base64 at all!"
    assert [r[6] for r in mailbox.message_rows(broken, "b", ".pdf")] == ["a.pdf"]


def test_outcomes_of_messages(spark):
    rows = [("a", 1, "success", None), ("a", 2, "failed", None), ("b", 1, "failed", None), ("b", 1, "success", None), ("c", 1, "failed", None), ("c", 1, "failed", None), ("c", 1, "failed", None), ("d", None, None, None), ("e", 1, None, None)]
    got = {r.name: (r.n_parts, r.n_failed, r.is_read) for r in mailbox.message_outcomes(spark.createDataFrame(rows, "name string, part int, status string, at timestamp")).collect()}
    assert got == {"a": (2, 1, False), "b": (1, 1, True), "c": (1, 3, True), "d": (0, 0, False), "e": (1, 0, False)}
