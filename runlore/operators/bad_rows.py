"""Problem 1: rows that fail to parse are set aside with a reason while valid rows are loaded."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FORMATS = ("zsh", "fish", "jsonl", "csv")
CSV_FIELDS = 6
csv.field_size_limit(2**31 - 1)  # a long field is no fault

_TS = re.compile(r"[0-9]{10}\Z")
_DIGITS = re.compile(r"[0-9]+\Z")
_ZSH_TIMED = re.compile(r":[ \t]*[0-9]")
_ZSH = re.compile(r":[ \t]*([0-9]{10}):[0-9]*;(.*)\Z", re.S)
_FISH_WHEN = re.compile(r"(?:  |\t)when:(.*)\Z", re.S)
#: One field as RFC 4180 allows it: quoted with doubled quotes inside, or free of quotes, commas and line ends.
_FIELD = re.compile(r'"(?:[^"]|"")*"|[^",\r\n]*')


class BadRecord(ValueError):
    """A record that its format does not allow; the message is the reason."""


def assemble(lines: Iterator[str]) -> Iterator[str]:
    """Physical lines joined to records, quote-aware: a line end inside an open quote continues the record."""
    held: list[str] = []
    quotes = 0
    for line in lines:
        held.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            yield "\n".join(held)
            held, quotes = [], 0
    if held:
        yield "\n".join(held)


def _command(value: object) -> str:
    if not isinstance(value, str):
        raise BadRecord("command is not a string")
    if not value.strip():
        raise BadRecord("command is blank")
    return value


def _ts(value: str) -> int:
    if not _TS.match(value):
        raise BadRecord("ts is not ten digits")
    return int(value)


def parse_zsh(raw: str) -> tuple[str, int | None]:
    if not _ZSH_TIMED.match(raw):
        return raw, None
    m = _ZSH.match(raw)
    if not m:
        raise BadRecord("zsh header is damaged")
    return _command(m[2]), int(m[1])


def parse_fish(raw: str) -> tuple[str, int | None]:
    head, *rest = raw.split("\n")
    if not head.startswith("- cmd: "):
        raise BadRecord("fish record does not start with a command")
    command, ts = _command(head[7:].rstrip("\r")), None
    for line in rest:
        line = line.rstrip("\r")
        if line[:1] not in (" ", "\t"):
            raise BadRecord("fish line is not indented")
        if m := _FISH_WHEN.match(line):
            ts = _ts(m[1].strip(" \t"))
    return _unescape_fish(command), ts


def _unescape_fish(text: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", text)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse_jsonl(raw: str) -> tuple[str, int | None]:
    try:
        rec = json.loads(raw, parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        raise BadRecord("not one JSON object") from e
    if not isinstance(rec, dict):
        raise BadRecord("not one JSON object")
    command = _command(rec.get("command"))
    if not isinstance(rec.get("dir"), str):
        raise BadRecord("dir is not a string")
    ts = rec.get("ts")
    if isinstance(ts, bool) or not isinstance(ts, (int, str)):
        raise BadRecord("ts is not ten digits")
    ts = _ts(str(ts))
    for name, least in (("exit_code", None), ("duration_ms", 0)):
        v = rec.get(name)
        if v is not None and (isinstance(v, bool) or not isinstance(v, int) or (least is not None and v < least)):
            raise BadRecord(f"{name} is not an integer" + " of at least 0" * (least == 0))
    return command, ts


def parse_csv(raw: str) -> tuple[str, int | None]:
    """The physical lines are assembled to one record, which strict parsing takes apart: structure (quotes, six fields)
    first, then the typed fields."""
    assembled = list(assemble(iter(raw.split("\n"))))
    if len(assembled) != 1:
        raise BadRecord("csv line end outside quotes")
    record = assembled[0]
    if record.count('"') % 2:
        raise BadRecord("csv quote is not closed")
    try:
        records = list(csv.reader(io.StringIO(record, newline=""), strict=True))
    except csv.Error as e:
        raise BadRecord("csv quoting") from e
    if len(records) != 1:
        raise BadRecord("csv line end outside quotes")
    at = 0
    while True:  # the reader takes a quote inside an unquoted field as text; RFC 4180 does not
        at = _FIELD.match(raw, at).end()
        if at == len(raw):
            break
        if raw[at] != ",":
            raise BadRecord("csv quoting")
        at += 1
    fields = records[0]
    if len(fields) != CSV_FIELDS:
        raise BadRecord(f"csv has {len(fields)} fields")
    seq, ts, exit_code, duration, _, command = fields
    if not _DIGITS.match(seq):
        raise BadRecord("seq is not a number")
    ts = _ts(ts)
    for name, v in (("exit_code", exit_code), ("duration_ms", duration)):
        if v and not _DIGITS.match(v):
            raise BadRecord(f"{name} is not a number")
    return _command(command), ts


_PARSERS = {"zsh": parse_zsh, "fish": parse_fish, "jsonl": parse_jsonl, "csv": parse_csv}


def parse_record(fmt: str | None, raw: str | None) -> tuple[str | None, int | None, str | None] | None:
    """(command, ts, reason) of a record; None for a blank one. Reason is null for a valid record.

    A null record is blank; an unknown or null format is a failure of its own.
    """
    raw = raw or ""
    raw = raw[:-1] if raw.endswith("\r") else raw
    if not raw.strip(" \t"):
        return None
    parser = _PARSERS.get(fmt)
    if parser is None:
        return None, None, "unknown format"
    try:
        command, ts = parser(raw)
    except BadRecord as e:
        return None, None, str(e)
    return command, ts, None


def parse_records(lines: DataFrame, id_col: str = "line_id", fmt: str = "fmt", raw: str = "raw", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every non-blank record as (id, carried columns, entry_command, entry_ts, reason); one narrow pass, no shuffle.

    Valid records have a null ``reason``. Clashing names cannot occur: carried columns that are called like
    an output column are refused by Spark with a clear error before any work.
    """
    picked = lines.select(F.col(id_col), *carry, F.col(fmt).alias("__fmt"), F.col(raw).alias("__raw"))
    schema = picked.drop("__fmt", "__raw").schema.add("entry_command", "string").add("entry_ts", "long").add("reason", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], ([], [], [])
            for i, (f, r) in enumerate(zip(b.column("__fmt").to_pylist(), b.column("__raw").to_pylist())):
                rec = parse_record(f, r)
                if rec is not None:
                    keep.append(i)
                    for col, v in zip(out, rec):
                        col.append(v)
            kept = b.select([id_col, *carry]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=schema.names
            )

    return picked.mapInArrow(run, schema)


def split_records(lines: DataFrame, **kw: object) -> tuple[DataFrame, DataFrame]:
    """(entries, failed): valid records as (id, command, ts), the others as (id, reason)."""
    parsed = parse_records(lines, **kw)
    ident = [c for c in parsed.columns if c not in ("entry_command", "entry_ts", "reason")]
    good = parsed.where("reason is null").select(*ident, F.col("entry_command").alias("command"), F.col("entry_ts").alias("ts"))
    return good, parsed.where("reason is not null").select(*ident, "reason")


#: A line that is a whole record by itself, with six typed fields.
WHOLE_LINE = r'^("[0-9]+"|[0-9]+),("[0-9]{10}"|[0-9]{10}),("[0-9]*"|[0-9]*),("[0-9]*"|[0-9]*),("([^"]|"")*"|[^",]*),("([^"]|"")*"|[^",]+)\r?$'
#: Lines of a file that one task joins; a file may have any number.
LINES = 100_000


def physical_records(lines: DataFrame, file: str = "file_name", order: str = "line_no", text: str = "text", block: int = LINES) -> DataFrame:
    """Physical lines of csv files as records: file, first line, n_lines, raw.

    A line continues the record before it while a quote is open. One damaged quote does not take the rest of the
    file with it: a line that is a whole record by itself ends what is open before it. Whether a quote is open at a
    line is the parity of quotes since the last such line; it is summed in blocks of lines, and each block hands
    on its parity, so no file has to fit into one task. Null lines are empty ones.
    """
    d = lines.select(F.col(file).alias("f"), F.col(order).cast("long").alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumns({"block": F.floor(F.col("at") / block), "whole": F.rlike("text", F.lit(WHOLE_LINE)), "q": F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))})
    d = d.withColumn("q", F.when(F.col("whole"), 0).otherwise(F.col("q") % 2))
    w = Window.partitionBy("f", "block").orderBy("at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("sum", F.coalesce(F.sum("q").over(before), F.lit(0)))
    d = d.withColumn("base", F.last(F.when(F.col("whole"), F.col("sum")), ignorenulls=True).over(before))
    own = d.groupBy("f", "block").agg(F.max_by(F.when(F.col("base").isNotNull() | F.col("whole"), F.col("sum") + F.col("q") - F.when(F.col("whole"), F.col("sum")).otherwise(F.col("base"))), "at").alias("since"), F.sum("q").alias("all"))
    over = Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("g", F.sum(F.col("since").isNotNull().cast("int")).over(Window.partitionBy("f").orderBy("block")))
    within = Window.partitionBy("f", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("ends", F.sum(F.coalesce("since", "all")).over(within))
    carry = own.select(F.col("f").alias("cf"), F.col("block").alias("cb"), F.coalesce(F.last("ends").over(over), F.lit(0)).alias("carry"))
    d = d.join(carry, F.col("f").eqNullSafe(F.col("cf")) & (F.col("block") == F.col("cb"))).drop("cf", "cb")
    open_ = F.coalesce(F.col("sum") - F.col("base"), F.col("sum") + F.col("carry")) % 2 == 1
    d = d.withColumn("start", F.when(F.col("whole") | ~open_, F.col("at")))
    d = d.withColumn("rec", F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = d.groupBy("f", "block").agg(F.max("start").alias("s"))
    held = last.select(F.col("f").alias("cf"), F.col("block").alias("cb"), F.max("s").over(over).alias("held"))
    d = d.join(held, F.col("f").eqNullSafe(F.col("cf")) & (F.col("block") == F.col("cb"))).withColumn("rec", F.coalesce("rec", "held"))
    joined = d.groupBy("f", "rec").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("rows"))
    return joined.select(F.col("f").alias(file), F.col("rec").alias(order), F.size("rows").cast("long").alias("n_lines"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("raw"))


def failed_lines(lines: DataFrame) -> DataFrame:
    """Per file: loaded records, failed_lines and how many fail for each reason (as a map-free long form)."""
    parsed = parse_records(lines, carry=("file_name", "fmt"))
    reason = F.coalesce(F.col("reason"), F.lit("ok"))
    return parsed.groupBy("file_name", "fmt", reason.alias("reason")).agg(F.count("*").alias("n_lines"))
