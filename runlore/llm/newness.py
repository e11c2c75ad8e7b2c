"""Problem 6: a new batch against all history, by content and paragraph hashes in bucketed tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlore.runtime import exists, scratch

NEAR_S = 5
MAX_EDITS = 3
MIN_CHARS = 20
#: Seconds of one time cell; a record can be near an entry only in the entry's cell or the next one.
CELL_S = 32
#: A command is cut into this many paragraphs; with fewer edits than paragraphs one is untouched.
PARTS = MAX_EDITS + 1
#: Tasks over which the entries of one content are spread.
SALTS = 8
#: Records of one cell that one task compares with; a cell with more is worked on in chunks of this size.
HOT = 2048
#: The batch number under which history is stored; batches count from 1.
HISTORY = 0

#: Table: (columns, the one its buckets follow).
_TABLES = {
    "contents": ("content BINARY, ord BIGINT", "content"),
    "paragraphs": ("cell BIGINT, ts BIGINT, ord BIGINT, parts ARRAY<INT>, norm STRING", "cell"),
}


def normal(command: Column) -> Column:
    """Lower-case, trimmed, every stretch of white space one blank."""
    return F.trim(F.regexp_replace(F.lower(command), r"(?U)\s+", " "))


def _cell(device: Column | str, cell: Column) -> Column:
    return F.xxhash64(F.lit("cell"), device, cell)


def _content(device: Column | str, norm: Column) -> Column:
    """96 bits that stand for a device's normalised command: one column, so grouping and bucketing share a shuffle."""
    return F.substring(F.unhex(F.md5(F.concat_ws("\u0001", device, norm))), 1, 12)


def _cut(length: Column, part: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a paragraph of a text of that length."""
    lo, hi = F.floor(length * part / PARTS), F.floor(length * (part + 1) / PARTS)
    return lo.cast("int"), (hi - lo).cast("int")


def _whole() -> Column:
    return F.hash(F.lit(PARTS), "norm")


def _record_parts() -> Column:
    """A record's hashes: of its whole content and, where long enough, of its paragraphs. 32 bits are enough within
    a cell, as every candidate is checked on its text."""
    n = F.char_length("norm")
    parts = []
    for p in range(PARTS):
        lo, size = _cut(n, p)
        parts.append(F.hash(F.lit(p), n, F.substring(F.col("norm"), lo + 1, size)))
    return F.when(n >= MIN_CHARS, F.array(_whole(), *parts)).otherwise(F.array(_whole()))


def _entry_parts() -> Column:
    """The hashes under which an alike record of the same cell must be.

    For each length that records of the cell have (``lens``), the stretches of the entry where a paragraph of such a
    record can lie: a paragraph with p paragraphs before it moves by at most p edits from the left, and by at most
    the remaining edits counted from the right. Lengths that no record of the cell has are not looked for.
    """
    n = F.char_length("norm")
    keys = []
    for d in range(-MAX_EDITS, MAX_EDITS + 1):
        there = F.array_contains("lens", n + d) & (n + d >= MIN_CHARS)
        found = []
        for p in range(PARTS):
            lo, size = _cut(n + d, p)
            left = range(-p, p + 1)
            right = range(-d - (MAX_EDITS - p), -d + (MAX_EDITS - p) + 1)
            for shift in sorted(set(left) & set(right)):
                at = lo + shift
                found.append(F.when((at >= 0) & (at + size <= n), F.hash(F.lit(p), n + d, F.substring(F.col("norm"), at + 1, size))))
        keys.append(F.when(there, F.array(*found)).otherwise(F.array().cast("array<int>")))
    near = F.array_distinct(F.array_compact(F.flatten(F.array(*keys))))
    return F.when(n >= MIN_CHARS, F.concat(F.array(_whole()), near)).otherwise(F.array(_whole()))


def _record_rows(df: DataFrame, ord_: Column) -> DataFrame:
    """Dated records by time cell."""
    dated = df.where((F.col("ts") > 0) & F.col("command").isNotNull())
    cell = _cell("device", F.floor(F.col("ts") / CELL_S))
    return dated.select(cell.alias("cell"), F.col("ts").cast("long").alias("ts"), ord_.alias("ord"), normal(F.col("command")).alias("norm"))


def _hashed(rows: DataFrame) -> DataFrame:
    """Records with their hashes, as they are stored."""
    return rows.select("cell", "ts", "ord", _record_parts().alias("parts"), "norm")


def _content_rows(df: DataFrame, ord_: Column) -> DataFrame:
    """Distinct contents of each device with their earliest order; combined before the shuffle."""
    rows = df.where("command is not null").select(_content("device", normal(F.col("command"))).alias("content"), ord_.alias("ord"))
    return rows.groupBy("content").agg(F.min("ord").alias("ord"))


class Accepted:
    """Everything accepted so far: hash tables bucketed by key under ``path``, grown by each batch.

    ``contents`` (content, ord) is bucketed by the content hash; ``paragraphs`` (cell, ts, ord, parts, norm) holds
    each record's paragraph hashes and text, bucketed by the hash of (device, time cell). Both are made when a record
    is accepted and never again. A batch is met by semi-joins that read the tables bucket by bucket and move only the
    batch, and adds only its own rows. The folder describes itself: another job, in another session, opens the same
    ``path`` and goes on. Rows are stored by batch number, so a batch that is added again takes its own place.
    ``ord`` orders records: an entry is compared with smaller ones only. History rows come before all entries.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path or scratch(spark, "accepted")
        layout = f"{self.path}/layout"
        if not exists(spark, layout):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(n).alias("buckets")).coalesce(1).write.parquet(layout)
        self.buckets = spark.read.parquet(layout).first()["buckets"]
        self.name = f"runlore_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"
        for what, (columns, key) in _TABLES.items():
            t = f"{self.name}_{what}"
            spark.sql(f"""CREATE TABLE IF NOT EXISTS {t} ({columns}, batch INT) USING parquet OPTIONS (compression 'zstd')
                PARTITIONED BY (batch) CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{what}'""")
            if exists(spark, f"{self.path}/{what}"):  # what other sessions stored
                spark.sql(f"MSCK REPAIR TABLE {t}")

    def _table(self, what: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{what}").drop("batch")

    def _put(self, what: str, rows: DataFrame, batch: int) -> None:
        view = f"runlore_{uuid.uuid4().hex}"
        placed = rows.repartition(self.buckets, _TABLES[what][1])
        (_hashed(placed) if what == "paragraphs" else placed).createOrReplaceTempView(view)  # hashes do not move
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name}_{what} PARTITION (batch = {int(batch)}) SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)

    def add(self, rows: DataFrame, ord_: Column, batch: int) -> None:
        self._put("paragraphs", _record_rows(rows, ord_), batch)
        self._put("contents", _content_rows(rows, ord_), batch)

    def add_history(self, history: DataFrame) -> None:
        """Accept history rows (device, command, ts, seq); null commands hold nothing and are left out."""
        self.add(history.select("device", "command", "ts", "seq"), -1 - F.col("seq").cast("long"), HISTORY)

    def add_batch(self, entries: DataFrame, batch: int) -> None:
        """Accept the entries (device, command, ts, entry_id) of a batch; ``batch`` is its number, from 1."""
        self.add(entries.select("device", "command", "ts", "entry_id"), F.col("entry_id").cast("long"), batch)

    def held(self, entries: DataFrame) -> DataFrame:
        """The entries already held, exactly or nearly, by what was accepted or by a smaller entry of the batch: entry_id.

        Dated: a record within 5 s that is equal, or alike (both 20 characters or more, at most three single-
        character edits), each checked on its text. Undated (null or 0): an equal record of any date, by 96 bits of
        its content. Entries with a null command or id are never held. No join broadcasts: a batch has no proven size.
        """
        ord_ = F.col("entry_id").cast("long")
        batch = entries.where("command is not null and entry_id is not null").select("device", "command", F.col("ts").cast("long").alias("ts"), "entry_id")
        return self._held_undated(batch, ord_).unionAll(self._held_dated(batch, ord_)).distinct().select(F.col("eid").alias("entry_id"))

    def _held_undated(self, batch: DataFrame, ord_: Column) -> DataFrame:
        """By content alone. The table is met by the batch's contents, bucket by bucket; each content's earliest
        order then goes out once per salt, so entries of one hot content are spread over tasks."""
        undated = batch.where("ts is null or ts <= 0").select(ord_.alias("eid"), _content("device", normal(F.col("command"))).alias("content"))
        asked = undated.groupBy("content").agg(F.count("*").alias("n")).hint("shuffle_hash")
        known = self._table("contents").join(asked, "content", "left_semi").unionByName(_content_rows(batch, ord_).join(asked, "content", "left_semi"))
        first = known.groupBy("content").agg(F.min("ord").alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return undated.withColumn("salt", F.pmod("eid", F.lit(SALTS)).cast("int")).join(first.hint("merge"), ["content", "salt"]).where("first < eid").select("eid")

    def _held_dated(self, batch: DataFrame, ord_: Column) -> DataFrame:
        """By time and by content or paragraph hashes.

        Equal entries of a device and second hold one another, so only the first of them looks further, and equal
        records of a second count once. The records of the batch's cells come out of their buckets without moving
        the others. An entry then asks, under each of its hashes, for one record that is near and alike (a
        semi-join, so nothing is emitted by pairs); a cell with very many records is asked in chunks of ``HOT``.
        """
        dated = batch.where("ts > 0").select(ord_.alias("eid"), "device", F.col("ts").alias("at"), normal(F.col("command")).alias("norm"))
        first = Window.partitionBy("device", "at", F.xxhash64("norm"), "norm").orderBy("eid")
        path = scratch(self.spark, "near")
        dated.withColumn("nth", F.row_number().over(first)).write.parquet(f"{path}/entries")
        ranked = self.spark.read.parquet(f"{path}/entries")
        at = ranked.where("nth = 1").drop("nth")
        cells = F.array_distinct(F.array(F.floor((F.col("at") - NEAR_S) / CELL_S), F.floor((F.col("at") + NEAR_S) / CELL_S)))
        probe = at.select("eid", "at", "norm", F.explode(F.transform(cells, lambda c: _cell(F.col("device"), c))).alias("cell"))
        stored = self._table("paragraphs").join(probe.select("cell").hint("shuffle_hash"), "cell", "left_semi")
        stored = stored.groupBy("cell", "ts", "norm").agg(F.min("ord").alias("ord"), F.first("parts").alias("parts")).select("cell", "ts", "ord", "parts", "norm")
        own = at.select(_cell("device", F.floor(F.col("at") / CELL_S)).alias("cell"), F.col("at").alias("ts"), F.col("eid").alias("ord"), "norm")
        stored.unionByName(_hashed(own)).write.parquet(f"{path}/records")
        records = self.spark.read.parquet(f"{path}/records")
        size = records.groupBy("cell").agg(F.collect_set(F.char_length("norm")).alias("lens"), F.ceil(F.count("*") / HOT).cast("int").alias("chunks"))
        hot = size.where("chunks > 1")
        asking = probe.join(size.hint("merge"), "cell").select("cell", "eid", "at", "norm", "chunks", F.explode(_entry_parts()).alias("key"))
        asked = records.select("cell", "ts", "ord", F.col("norm").alias("theirs"), F.explode("parts").alias("key"))
        close = (F.abs(F.col("ts") - F.col("at")) <= NEAR_S) & (F.col("ord") < F.col("eid"))
        alike = (F.col("norm") == F.col("theirs")) | (
            (F.char_length("norm") >= MIN_CHARS) & (F.char_length("theirs") >= MIN_CHARS) & (F.levenshtein("norm", "theirs", MAX_EDITS) >= 0)
        )

        def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
            r = right.select(*[F.col(c).alias(f"r_{c}") for c in on], "ts", "ord", "theirs").hint("merge")
            same = [F.col(c) == F.col(f"r_{c}") for c in on]
            return left.join(r, [*same, close, alike], "left_semi").select("eid")

        found = meet(asking.where("chunks = 1"), asked, ["cell", "key"])
        if not hot.isEmpty():
            there = asked.join(hot.select("cell", "chunks").hint("merge"), "cell").withColumn("chunk", F.pmod(F.xxhash64("ord"), F.col("chunks")).cast("int"))
            ask = asking.where("chunks > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            found = found.unionAll(meet(ask, there, ["cell", "key", "chunk"]))
        return found.unionAll(ranked.where("nth > 1").select("eid"))

    def drop(self) -> None:
        """Take the tables out of the catalog; the files stay, to be opened again."""
        for what in _TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{what}")


def held_entries(history: DataFrame, entries: DataFrame, buckets: int | None = None) -> DataFrame:
    """Entries already held when they arrive: one catch-up over all the batches given, each met once.

    An entry is compared with history and smaller entries only, so batches handed over together or one after
    the other (``replayed``) give the same rows.
    """
    state = Accepted(history.sparkSession, buckets=buckets)
    state.add_history(history)
    return state.held(entries)


def replayed(history: DataFrame, entries: DataFrame, batch: str = "batch_no", buckets: int | None = None) -> DataFrame:
    """The same, batch by batch: each one opens the state anew, is met with what was accepted before, and is appended.

    Nothing accepted before is hashed or shuffled again. Result: entry_id and the batch it came in.
    """
    spark, path = history.sparkSession, scratch(history.sparkSession, "accepted")
    Accepted(spark, path, buckets).add_history(history)
    for (no,) in sorted(entries.select(batch).where(F.col(batch).isNotNull()).distinct().collect()):
        state, part = Accepted(spark, path), entries.where(F.col(batch) == no)
        state.held(part).withColumn(batch, F.lit(no)).write.parquet(f"{path}/held/{batch}_{no}")
        state.add_batch(part, no)
    kind = entries.schema["entry_id"].dataType.simpleString()
    return spark.read.schema(f"entry_id {kind}, {batch} {entries.schema[batch].dataType.simpleString()}").option("recursiveFileLookup", "true").parquet(f"{path}/held")
