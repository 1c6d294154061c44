"""A mailbox as a stream: messages that have landed in a folder, their text and attachments as rows.

A message is a file of raw mail. Its folder is listed when the names of the last listing are used up, and the
names not listed before are written to a log, batch by batch; an offset is the length of
that log. So a batch that is run anew has the same messages, whatever has landed since,
and a message that lands with an older name or time is not passed over. The reader holds the
names, not the mails. When Spark commits
an offset, the messages up to it are acknowledged: their names are written below `read`.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .landing import MAX_FAILURES

MESSAGE = "name string, mailbox string, sender string, subject string, body string, part int, filename string, content binary, error string"
MESSAGES_A_TASK = 64


class _Names(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _leaves(message: EmailMessage) -> Iterator[EmailMessage]:
    """Parts that hold no parts themselves, in order; a forwarded message is walked through like a part."""
    if message.is_multipart():
        for part in message.iter_parts() if not message.get_content_type().startswith("message/") else message.get_payload():
            yield from _leaves(part)
    else:
        yield message


def message_rows(raw: bytes, name: str, suffix: str) -> list[tuple]:
    """One row an attachment whose file name ends so (in either case), or one row without one; mail that cannot be parsed is one row with its error."""
    try:
        message = BytesParser(policy=policy.default).parsebytes(raw)
        leaves = list(_leaves(message))
        told = {p.get_content_type(): p for p in reversed(leaves) if not p.get_filename()}
        best = told.get("text/plain") or told.get("text/html")
        body = "" if best is None else (best.get_payload(decode=True) or b"").decode("utf-8", "ignore").replace("\r\n", "\n").strip()
        head = (name, message["Delivered-To"] or message["To"], message["From"], message["Subject"], body)
        head = tuple(None if v is None else str(v) for v in head)
        found = [p for p in leaves if (p.get_filename() or "").lower().endswith(suffix)]
        rows = [(*head, i, p.get_filename(), p.get_payload(decode=True), None) for i, p in enumerate(found, 1)]
        return rows or [(*head, None, None, None, None)]
    except Exception as e:  # a message as a row with its error, so that one bad mail does not hold up the stream
        return [(name, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.state, self.suffix = options["path"].rstrip("/"), options["statepath"].rstrip("/"), options.get("attachments", ".pdf").lower()
        self.most = int(options.get("maxmessages", 10_000))
        self.names: list[str] = []
        self.kept = 0  # files of the log that have been read
        self.waiting: list[str] = []  # listed, for later batches

    def _open(self) -> None:
        """Reads what the log has that this reader has not seen."""
        files, root = fs.FileSystem.from_uri(self.state)
        files.create_dir(f"{root}/seen", recursive=True)
        files.create_dir(f"{root}/read", recursive=True)
        logs = sorted(i.path for i in files.get_file_info(fs.FileSelector(f"{root}/seen")) if i.path.endswith(".json"))
        for path in logs[self.kept :]:
            self.names += json.loads(_whole(files, path))["names"]
        self.kept = len(logs)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self._open()
        if not self.waiting:
            # Not in each batch: a large backlog would be listed as often as it has batches.
            files, root = fs.FileSystem.from_uri(self.path)
            listed = {i.base_name for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))}
            self.waiting = sorted(listed - set(self.names))
        new, self.waiting = self.waiting[: self.most], self.waiting[self.most :]
        if new:
            state, below = fs.FileSystem.from_uri(self.state)
            path = f"{below}/seen/{self.kept:09d}.json"
            _put(state, path, json.dumps({"start": len(self.names), "names": new}).encode())
            self.names += new
            self.kept += 1
        return {"n": len(self.names)}

    def partitions(self, start: dict, end: dict) -> list[_Names]:
        self._open()
        names = self.names[start["n"] : end["n"]]
        return [_Names(names[i : i + MESSAGES_A_TASK]) for i in range(0, len(names), MESSAGES_A_TASK)]

    def read(self, partition: _Names) -> Iterator[tuple]:
        files, root = fs.FileSystem.from_uri(self.path)
        for name in partition.names:
            yield from message_rows(_whole(files, f"{root}/{name}"), name, self.suffix)

    def commit(self, end: dict) -> None:
        _acknowledge(self.state, end["n"])


def _acknowledge(state: str, n: int) -> None:
    files, below = fs.FileSystem.from_uri(_uri(state))
    _put(files, f"{below}/read/{n:012d}.json", json.dumps({"n": n}).encode())


def _uri(path: str) -> str:
    return path if ":" in path.split("/", 1)[0] else f"file://{path}"


def _whole(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as f:
        return f.read()


def _put(files: fs.FileSystem, path: str, content: bytes) -> None:
    """Written beside its place and moved there, so that a reader meets the whole file or none."""
    with files.open_output_stream(path + ".new") as f:
        f.write(content)
    files.move(path + ".new", path)


def land(mails: DataFrame, path: str) -> int:
    """Writes mails (name, mail) as files into a mailbox's folder, in many tasks; gives their number. A task that is run anew writes the same files anew."""
    files, root = fs.FileSystem.from_uri(_uri(path))
    files.create_dir(root, recursive=True)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(_uri(path))
        for batch in batches:
            for name, mail in zip(batch["name"], batch["mail"], strict=True):
                with files.open_output_stream(f"{root}/.{name}") as f:  # a name that a reader passes over
                    f.write(mail.encode())
                files.move(f"{root}/.{name}", f"{root}/{name}")
            yield pd.DataFrame({"n": [len(batch)]})

    dealt = mails.select("name", "mail").repartition(4 * mails.sparkSession.sparkContext.defaultParallelism, "name")
    return dealt.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


class MailboxSource(DataSource):
    """Options: path, statePath (the log, on shared storage), attachments (ending of their names), maxMessages (new ones a batch)."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def mailbox(spark: SparkSession, path: str, state: str, **options: str) -> DataFrame:
    """The stream of a mailbox's rows. Paths are URIs (file:, hdfs:) or absolute."""
    spark.dataSource.register(MailboxSource)
    return spark.readStream.format("mailbox").options(path=_uri(path), statePath=_uri(state), **options).load()


def run_mailbox(rows: DataFrame, load: Callable[[DataFrame, int], None], checkpoint: str, state: str) -> None:
    """Loads all that has landed, batch by batch, acknowledges it and ends; an error of load is raised, and its batch comes again in the next run.

    Spark tells a source of a batch's end only when the next begins, so the last batch of a run is acknowledged here, once Spark says that it is done.
    """
    query = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
        done = query.lastProgress
    finally:
        query.stop()
    end = done and done["sources"][0]["endOffset"]
    if end:
        _acknowledge(state, ast.literal_eval(str(end))["n"])


def acknowledged(spark: SparkSession, state: str) -> DataFrame:
    """Names of the messages that Spark has committed; none before the first commit."""
    done = spark.read.schema("n long").json(f"{state}/read").agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    log = spark.read.schema("start long, names array<string>").json(f"{state}/seen")
    return log.select("start", F.posexplode("names").alias("i", "name")).filter(F.col("start") + F.col("i") < done).select("name")


def message_outcomes(attempts: DataFrame, most: int = MAX_FAILURES) -> DataFrame:
    """Attempts at attachments (name, part, status, at) -> of each message n_parts, n_failed and is_read.

    A message counts as read once each of its attachments succeeded at some time or failed
    more than most times, so that it is passed over; else it comes back. A message without
    attachments (part null, no status) stays unread.
    """
    ok, bad = F.col("status") == "success", F.col("status") == "failed"
    parts = attempts.groupBy("name", "part").agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("ok"), F.count_if(bad).alias("failed"))
    over = F.col("ok") | (F.col("failed") > most)
    return parts.groupBy("name").agg(F.count("part").alias("n_parts"), F.sum("failed").alias("n_failed"), (F.bool_and(over) & (F.count("part") > 0)).alias("is_read"))
