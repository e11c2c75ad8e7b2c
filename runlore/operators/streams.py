"""The de-duplicated, ordered event streams of one device in one repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.blocks import WHOLE, block_of, block_seconds, stream_id

#: Everything but ``seq`` that tells two captures of one event apart, besides the stream and ``ts``.
REST = ("command", "dir", "exit_code", "duration_ms", "session", "imported")


def event_streams(history: DataFrame, keep: list, block_s: int | None = None) -> tuple[DataFrame, int]:
    """(events, block length): rows ``s1, s2, block, ts, seq`` and the columns ``keep``, partitioned by (s1, s2, block).

    ``imported`` rows are left out (a null flag counts as captured); of rows equal in every column but
    ``seq`` the one with the smallest ``seq`` stays. Equality of the remaining columns is decided on a
    128-bit digest of them, so texts are not shuffled. Rows with a null ``ts`` are not on the time line
    and are left out. One exchange on (s1, s2, block) serves the de-duplication here and every window
    that follows; the hot stream is spread over its blocks.
    """
    rows = history.where(~F.coalesce(F.col("imported"), F.lit(False)) & F.col("ts").isNotNull() & F.col("seq").isNotNull())
    rows = rows.withColumns(dict(zip(("s1", "s2"), stream_id("device", "repo"))))
    if block_s is None:
        block_s = block_seconds(rows, ["s1", "s2"], "ts")
    rest = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in REST]
    slim = rows.select(
        "s1", "s2", block_of("ts", block_s).alias("block"), F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"),
        F.xxhash64(*rest).alias("d1"), F.xxhash64(F.lit("second"), *reversed(rest)).alias("d2"), *keep,
    )
    kept = [c for c in slim.columns if c not in ("s1", "s2", "block", "ts", "seq", "d1", "d2")]
    spread = slim.repartition("s1", "s2", "block").groupBy("s1", "s2", "block", "ts", "d1", "d2")
    return spread.agg(F.min("seq").alias("seq"), *[F.first(c).alias(c) for c in kept]).drop("d1", "d2"), block_s


__all__ = ["event_streams", "WHOLE"]
