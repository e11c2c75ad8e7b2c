"""Problem 3: runs of repeated consecutive events collapsed to one, by adjacent agglomeration."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.operators.streams import event_streams
from runlore.runtime import written

GAP_S = 120
MIN_EVENTS = 3


def same_event(command: Column) -> Column:
    """The text two commands must share to be one event: no case, quotes, amount of white space or digits."""
    c = F.regexp_replace(F.lower(command), "['\"]", "")
    c = F.regexp_replace(c, r"(?U)\d+", "0")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def ratio(a: str, b: str, least: float) -> Column:
    """1 less the share of characters to be edited between two text columns; 0 where that is below ``least``."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    most = F.floor((1 - least) * longest + 1e-9).cast("int")
    edits = F.call_function("levenshtein", F.col(a), F.col(b), most)
    short = F.abs(F.char_length(a) - F.char_length(b)) > most
    return F.when(F.col(a) == F.col(b), 1.0).when(short, 0.0).when(edits >= 0, 1 - edits / longest).otherwise(0.0)


@lru_cache(1 << 13)
def similarity(a: str, b: str, least: float = 0.0) -> float:
    """The same for two texts."""
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)  # further off there are too many edits
        new = [most + 1] * (len(b) + 1)
        new[lo - 1] = i if lo == 1 else most + 1
        for j in range(lo, hi + 1):
            new[j] = row[j - 1] if x == b[j - 1] else 1 + min(row[j - 1], row[j], new[j - 1])
        row = new
        if min(row[lo - 1 : hi + 1]) > most:
            return 0.0
    return 1 - row[-1] / longest if row[-1] <= most else 0.0


class Runs:
    """Neighbouring runs as a linked list; a priority queue merges the most similar pair first.

    A run is ``[first_seq, first_ts, last_ts, n, first text, touch]``; ``touch`` is how alike its first event and the
    one before it are, which no merge changes. Two neighbours may merge if the gap between them is within ``gap`` and
    both their touching events and their first events reach ``least``. Of equally similar pairs the earlier one
    merges first, so the result is defined for ties.
    """

    #: Equal events that are held before they are merged; the run they make goes on with the next ones.
    CHUNK = 1024

    def __init__(self, gap: int, least: float) -> None:
        self.gap, self.least = gap, least
        self.runs: list[list | None] = []

    def add(self, seq: int, ts: int, text: str, touch: float | None, n: int = 1, last_ts: int | None = None) -> None:
        end = ts if last_ts is None else last_ts
        last = self.runs[-1] if self.runs else None
        # equal texts have the highest priority of all: where others are among them, a run of equals is one entry
        if self.least < 1.0 and last is not None and last[6] and touch == 1.0 and last[4] == text and ts - last[2] <= self.gap:
            last[2], last[3] = end, last[3] + n
            return
        self.runs.append([seq, ts, end, n, text, touch, True])
        if self.least >= 1.0 and len(self.runs) >= self.CHUNK:  # all are equal, so what they merge to goes on merging
            self.runs = self.merged()

    def score(self, i: int, j: int) -> float:
        a, b = self.runs[i], self.runs[j]
        if b[1] - a[2] > self.gap or b[5] is None or b[5] < self.least:
            return 0.0
        return min(b[5], similarity(a[4], b[4], self.least))

    def merged(self) -> list[list]:
        n = len(self.runs)
        if n < 2:
            return self.runs
        after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        queue = [(-s, i, 0, i + 1, 0) for i in range(n - 1) if (s := self.score(i, i + 1)) >= self.least]
        heapq.heapify(queue)
        while queue:
            _, i, vi, j, vj = heapq.heappop(queue)
            if self.runs[i] is None or self.runs[j] is None or (version[i], version[j]) != (vi, vj):
                continue
            a, b = self.runs[i], self.runs[j]
            self.runs[i] = [a[0], a[1], b[2], a[3] + b[3], a[4], a[5], False]
            self.runs[j] = None
            version[i] += 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (s := self.score(left, right)) >= self.least:
                    heapq.heappush(queue, (-s, left, version[left], right, version[right]))
        return [r for r in self.runs if r is not None]


_RUN = "s1 long, s2 long, block long, first_seq long, first_ts long, last_ts long, n_events long, first_text string, last_text string, touch double, opens boolean, closes boolean"


def _agglomerate(gap: int, least: float):
    """Rows of a block, cut into pieces wherever a row is not alike the one before it.

    The events that touch where two runs meet never change, so a piece merges as it would within its stretch.
    Of pieces at a block border, exact ones go on as the run they make, others as their runs of equal events; the
    others become merged runs without texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, begins, out = None, None, False, []

        def flush(ends: bool) -> None:
            runs = held.merged() if least >= 1.0 or not (begins or ends) else held.runs
            if begins or ends:
                out.extend((*key, *r[:5], r[4], r[5], begins, ends) for r in runs)
            else:
                out.extend((*key, *r[:4], None, None, None, False, False) for r in runs if r[3] >= 2)

        for b in batches:
            for s1, s2, block, ts, seq, text, left, touch, edge_l, edge_r in zip(*(c.to_pylist() for c in b.columns)):
                if not left or key != (s1, s2, block):
                    if held is not None:
                        flush(was_edge)
                    key, held, begins, touch = (s1, s2, block), Runs(gap, least), edge_l, None
                held.add(seq, ts, text, touch)
                was_edge = edge_r
            if len(out) >= 4096:
                yield _batch(out)
                out.clear()
        if held is not None:
            flush(was_edge)
        yield _batch(out)

    return run


def _agglomerate_chains(gap: int, least: float):
    """Pieces that go on over block borders, agglomerated as a whole: rows s1, s2, chain and a run of equal events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, None, []

        def flush() -> None:
            out.extend((*key, *r[:4], None, None, None, False, False) for r in held.merged() if r[3] >= 2)

        for b in batches:
            for s1, s2, chain, ts, seq, last_ts, n, text, touch in zip(*(c.to_pylist() for c in b.columns)):
                if key != (s1, s2, chain):
                    if held is not None:
                        flush()
                    key, held = (s1, s2, chain), Runs(gap, least)
                held.add(seq, ts, text, touch, n, last_ts)
            if len(out) >= 4096:
                yield _batch(out)
                out.clear()
        if held is not None:
            flush()
        yield _batch(out)

    return run


_ARROW = pa.schema([(p.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[p.split()[1]]) for p in _RUN.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def collapse_runs(history: DataFrame, gap_s: int = GAP_S, min_similarity: float = 1.0, block_s: int | None = None) -> DataFrame:
    """Every run of at least two like neighbours of a stream as first_seq, n_events, span_s.

    Only neighbours no further apart than ``gap_s`` and alike enough can ever merge, so the JVM measures how alike
    they are and cuts a stream at every other place; only linked events go on to the agglomeration, in their sorted
    partition and without another shuffle. With ``min_similarity`` 1 texts are compared by digest and all runs are
    maximal; those that touch a block border are joined to those of the next block afterwards. Below 1, pieces that
    go on over block borders first come together, so the rows do not depend on the blocks. Null commands are never
    linked; an empty table gives no rows; equal ``ts`` go by ``seq``.
    """
    text = same_event(F.col("command"))
    exact = min_similarity >= 1.0
    digest = F.when(F.col("command").isNotNull(), F.xxhash64(text, F.lit(1)).cast("string"))
    ev, block_s = event_streams(history, [(digest if exact else text).alias("text")], block_s)
    blk = ["s1", "s2", "block"]
    w = Window.partitionBy(*blk).orderBy("ts", "seq")
    alike = (lambda a, b: (F.col(a) == F.col(b)).cast("double")) if exact else (lambda a, b: ratio(a, b, min_similarity))
    ev = ev.withColumns({"pt": F.lag("ts").over(w), "px": F.lag("text").over(w)})
    near = F.col("ts") - F.col("pt") <= gap_s
    ev = ev.withColumn("touch", F.when(near, alike("px", "text")))
    ev = ev.withColumn("left", F.coalesce(F.col("touch") >= min_similarity, F.lit(False)))
    ev = ev.withColumns({"right": F.coalesce(F.lead("left").over(w), F.lit(False)), "edge_l": F.col("pt").isNull(), "edge_r": F.lead("ts").over(w).isNull()})
    # a lone event matters only where it may go on in a neighbouring block
    cand = ev.where("left or right or edge_l or edge_r").select(*blk, "ts", "seq", "text", "left", "touch", "edge_l", "edge_r")
    runs = cand.mapInArrow(_agglomerate(gap_s, min_similarity), _RUN)
    if not exact:  # read three times below
        runs = written(runs, "runs")
    cols = ["first_seq", "n_events", (F.col("last_ts") - F.col("first_ts")).alias("span_s")]
    inner = runs.where("not opens and not closes")
    # a piece at a border continues the last piece of the block before: at most two a block
    border = pieces = runs.where("opens or closes")
    piece = [*blk, "opens", "closes"]
    if not exact:
        at = F.struct("first_ts", "first_seq")
        pieces = border.groupBy(*piece).agg(
            F.min_by("first_text", at).alias("first_text"), F.max_by("last_text", at).alias("last_text"), F.min_by("first_seq", at).alias("first_seq"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
        )
    by_key = Window.partitionBy("s1", "s2").orderBy("block", "first_ts", "first_seq")
    pieces = pieces.withColumns({
        "pc": F.lag("closes").over(by_key), "pl": F.lag("last_ts").over(by_key), "pt": F.lag("last_text").over(by_key), "pb": F.lag("block").over(by_key),
    })
    pieces = pieces.withColumn("over", alike("pt", "first_text"))
    goes_on = F.col("opens") & F.col("pc") & (F.col("first_ts") - F.col("pl") <= gap_s) & (F.col("pb") < F.col("block")) & (F.col("over") >= min_similarity)
    pieces = pieces.withColumn("chain", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    chain = ["s1", "s2", "chain"]
    if exact:
        joined = pieces.groupBy(*chain).agg(
            F.min_by("first_seq", F.struct("first_ts", "first_seq")).alias("first_seq"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_events").alias("n_events")
        )
    else:
        rows = border.join(pieces.select(*piece, "chain", "over"), piece)
        rows = rows.select(*chain, "first_ts", "first_seq", "last_ts", "n_events", "first_text", F.coalesce("touch", "over").alias("touch"))
        joined = rows.repartition(*chain).sortWithinPartitions(*chain, "first_ts", "first_seq").mapInArrow(_agglomerate_chains(gap_s, min_similarity), _RUN)
    return inner.select(*cols).unionAll(joined.select(*cols)).where("n_events >= 2")
