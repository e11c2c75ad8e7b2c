"""Problem 7: frequent subsequences of many sequences, by weighted sequence decision diagrams."""

from __future__ import annotations

import bisect
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlore.blocks import block_of, block_seconds
from runlore.runtime import checkpointed, written

MIN_SHARE = 0.08
LENGTHS = (3, 5)
#: Distinct sequences that one diagram is built from. Tasks are made of about as many, never of a small rest, in
#: which every pattern would be frequent.
CHUNK = 20_000
#: Pairs that a task counts before it hands them on, and candidate patterns that are counted at a time.
PAIRS, CANDIDATES = 1 << 20, 1 << 17


def step_of(command: Column) -> Column:
    """The first two words of a command, lower-case and without a leading sudo; null where there is no word."""
    words = F.filter(F.split(F.lower(command), r"(?U)\s+"), lambda w: w != "")
    words = F.when(F.try_element_at(words, F.lit(1)) == "sudo", F.slice(words, 2, 2)).otherwise(F.slice(words, 1, 2))
    return F.when(F.size(words) > 0, F.array_join(words, " "))


class _Ranks:
    """Ranks from one end: 1 + the smallest rank since the item was last seen (1 for the first time)."""

    def __init__(self) -> None:
        self.at: list[int] = []  # places of the minima since, in order, with growing ranks
        self.low: list[int] = []
        self.seen: dict[int, int] = {}
        self.n = 0

    def peek(self, item: int) -> int:
        since = self.seen.get(item)
        return 1 if since is None else 1 + self.low[bisect.bisect_left(self.at, since)]

    def take(self, item: int, rank: int) -> None:
        while self.low and self.low[-1] >= rank:
            self.low.pop()
            self.at.pop()
        self.low.append(rank)
        self.at.append(self.n)
        self.seen[item] = self.n
        self.n += 1


def shorten(seq: list[int], k: int) -> list[int]:
    """A short form of ``seq`` with the same subsequences of up to ``k`` items.

    Simon's congruence: an item whose rank from the left plus rank from the right exceeds ``k + 1`` is in no
    such subsequence that cannot be had without it. The length is bounded by the alphabet and ``k``, whatever
    the length of ``seq``; being a congruence, it may be taken piece by piece and again over the pieces.
    """
    ranks, left = _Ranks(), []
    for a in seq:
        x = ranks.peek(a)
        ranks.take(a, x)
        left.append(x)
    ranks, out = _Ranks(), []
    for a, x in zip(reversed(seq), reversed(left)):
        y = ranks.peek(a)
        if x + y <= k + 1:
            ranks.take(a, y)
            out.append(a)
    return out[::-1]


class Diagrams:
    """Weighted sequence decision diagrams with shared nodes.

    A node is (item, lo, hi): ``hi`` holds the sequences that go on with ``item`` here, ``lo`` the others.
    Terminals carry the weight of the sequences that end. Equal nodes are one object, so equal suffix sets
    are stored once and every operation is memoised on node numbers.
    """

    def __init__(self) -> None:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))
        self.nodes: list[tuple[int, int, int]] = [(-1, 0, 0)]  # node 0: nothing
        self.known: dict[tuple[int, int, int], int] = {(-1, 0, 0): 0}
        self.memo: dict[tuple, object] = {}

    def leaf(self, weight: int) -> int:
        return self.node(-1, weight, 0)

    def node(self, item: int, lo: int, hi: int) -> int:
        if item >= 0 and hi == 0:
            return lo
        key = (item, lo, hi)
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return at

    def sequence(self, seq: tuple[int, ...], weight: int) -> int:
        f = self.leaf(weight)
        for a in reversed(seq):
            f = self.node(a, 0, f)
        return f

    def union(self, f: int, g: int) -> int:
        if f == 0 or g == 0:
            return f or g
        if f > g:
            f, g = g, f
        key = ("u", f, g)
        got = self.memo.get(key)
        if got is None:
            (a, fl, fh), (b, gl, gh) = self.nodes[f], self.nodes[g]
            if a < 0 and b < 0:
                got = self.leaf(fl + gl)
            elif b < 0 or (0 <= a < b):
                got = self.node(a, self.union(fl, g), fh)
            elif a < 0 or b < a:
                got = self.node(b, self.union(f, gl), gh)
            else:
                got = self.node(a, self.union(fl, gl), self.union(fh, gh))
            self.memo[key] = got
        return got

    def build(self, weighted: list[tuple[tuple[int, ...], int]]) -> int:
        level = [self.sequence(s, w) for s, w in sorted(weighted)]
        while len(level) > 1:
            level = [self.union(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else 0

    def weight(self, f: int) -> int:
        key = ("w", f)
        got = self.memo.get(key)
        if got is None:
            a, lo, hi = self.nodes[f]
            got = lo if a < 0 else self.weight(lo) + self.weight(hi)
            self.memo[key] = got
        return got

    def without(self, f: int, x: int) -> int:
        """The diagram with item ``x`` struck from every sequence."""
        a, lo, hi = self.nodes[f]
        if a < 0:
            return f
        key = ("d", f, x)
        got = self.memo.get(key)
        if got is None:
            rest, on = self.without(lo, x), self.without(hi, x)
            got = self.union(rest, on) if a == x else self.union(rest, self.node(a, 0, on))
            self.memo[key] = got
        return got

    def after(self, f: int, x: int) -> int:
        """The conditional diagram of prefix item ``x``: what follows its first occurrence."""
        a, lo, hi = self.nodes[f]
        if a < 0:
            return 0
        key = ("c", f, x)
        got = self.memo.get(key)
        if got is None:
            got = self.union(self.after(lo, x), hi if a == x else self.after(hi, x))
            self.memo[key] = got
        return got

    def items(self, f: int) -> frozenset[int]:
        a, lo, hi = self.nodes[f]
        if a < 0:
            return frozenset()
        key = ("i", f)
        got = self.memo.get(key)
        if got is None:
            got = self.memo[key] = self.items(lo) | self.items(hi) | {a}
        return got

    def mine(self, f: int, depth: int, least: float) -> list[tuple[tuple[int, ...], int]]:
        """Patterns of different items, of length 1 to ``depth``, with a weight of at least ``least``.

        Each prefix item's conditional diagram is pushed with that item struck out; equal diagrams are mined once.
        """
        if depth == 0 or self.weight(f) < least:
            return []
        key = ("m", f, depth)
        got = self.memo.get(key)
        if got is None:
            got = []
            for x in sorted(self.items(f)):
                g = self.after(f, x)
                w = self.weight(g)
                if w >= least:
                    got.append(((x,), w))
                    got += [((x, *p), n) for p, n in self.mine(self.without(g, x), depth - 1, least)]
            self.memo[key] = got
        return got


def _reduced(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [shorten(s, k) for s in b.column(b.num_columns - 1).to_pylist()]
            arrays = [*b.columns[:-1], pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial weights of ordered pairs of different items."""
    count: Counter[tuple[int, int]] = Counter()
    for b in batches:
        for seq, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            before: set[int] = set()
            got: set[tuple[int, int]] = set()
            for x in seq:
                got.update([(y, x) for y in before if y != x])
                before.add(x)
            for pair in got:
                count[pair] += w
        if len(count) > PAIRS:  # they are added up after the shuffle
            yield _pair_rows(count)
            count = Counter()
    yield _pair_rows(count)


def _pair_rows(count: Counter[tuple[int, int]]) -> pa.RecordBatch:
    cols = list(zip(*count)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(list(count.values()), pa.int64())], names=["a", "b", "n"])


def _candidates(share: float, depth: int):
    """Patterns that are frequent within a task's sequences; one that is frequent over all is frequent in some task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple[int, ...], int]] = []
        for b in batches:
            held += [(tuple(s), w) for s, w in zip(b.column("items").to_pylist(), b.column("weight").to_pylist())]
        if held:
            d = Diagrams()
            least = share * sum(w for _, w in held)
            found = [list(p) for p, _ in d.mine(d.build(held), depth, least)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["pattern"])

    return run


def _supports(patterns: list[tuple[int, ...]]):
    """Partial weights of the sequences that hold each pattern: one walk down the patterns' trie a sequence."""
    root: list = [{}, None]
    for k, p in enumerate(patterns):
        at = root
        for x in p:
            at = at[0].setdefault(x, [{}, None])
        at[1] = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(patterns)
        for b in batches:
            for seq, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where: dict[int, list[int]] = defaultdict(list)
                for i, x in enumerate(seq):
                    where[x].append(i)
                stack = [(root, -1)]
                while stack:
                    at, i = stack.pop()
                    for x, nxt in at[0].items():
                        p = where.get(x)
                        if p and p[-1] > i:
                            if nxt[1] is not None:
                                total[nxt[1]] += w
                            if nxt[0]:
                                stack.append((nxt, p[bisect.bisect_right(p, i)]))
        met = [k for k, n in enumerate(total) if n]
        yield pa.RecordBatch.from_arrays([pa.array([list(patterns[k]) for k in met], pa.list_(pa.int32())), pa.array([total[k] for k in met], pa.int64())], names=["pattern", "n"])

    return run


def weighted_sequences(rows: DataFrame, items: DataFrame, depth: int, block_s: int | None = None) -> DataFrame:
    """Distinct reduced item sequences and how many sessions have them: items, weight."""
    # the frequent steps: at most mean steps a session / share
    ev = rows.join(F.broadcast(items), "step").select("session", "ts", "seq", "item")
    if block_s is None:
        block_s = block_seconds(ev, ["session"], "ts", 100_000)
    ev = ev.withColumn("block", block_of("ts", block_s))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "item"))), lambda r: r["item"])
    cut = ev.groupBy("session", "block").agg(ordered.alias("items")).mapInArrow(_reduced(depth), "session string, block long, items array<int>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "items"))), lambda r: r["items"]))
    seqs = cut.groupBy("session").agg(whole.alias("items")).select("items").mapInArrow(_reduced(depth), "items array<int>")
    return seqs.groupBy("items").agg(F.count("*").alias("weight"))


def frequent_subsequences(history: DataFrame, share: float = MIN_SHARE, lengths: tuple[int, int] = LENGTHS, block_s: int | None = None) -> DataFrame:
    """Ordered patterns of different steps in at least ``share`` of all sessions: steps, length, support.

    A session is a non-empty ``session`` value with the steps of its rows by (ts, seq); rows without a word
    have no step. No sessions give no rows. Steps below the share are struck first (at most mean steps per
    session / share remain, which bounds what is sent to the executors), then those in no frequent ordered
    pair. Each session is reduced to a form of bounded length with the same short subsequences, in blocks, so
    a session with a third of all rows is no single task. Equal sequences become one weighted row. Tasks of about
    ``CHUNK`` of them are mined as sequence decision diagrams; the union of the tasks' frequent patterns holds every
    globally frequent one and is then counted exactly over all sequences, ``CANDIDATES`` patterns at a time.
    """
    spark = history.sparkSession
    least_len, most_len = lengths
    rows = written(history.where("session <> ''").select("session", "ts", "seq", step_of(F.col("command")).alias("step")), "steps")
    n_sessions = rows.select("session").distinct().count()
    schema = "steps array<string>, length int, support long"
    per_step = rows.where("step is not null").select("session", "step").distinct().groupBy("step").count()
    least = share * n_sessions
    steps = sorted(r["step"] for r in per_step.where(F.col("count") >= least).collect())
    if not steps:
        return spark.createDataFrame([], schema)
    items = spark.createDataFrame([(s, i) for i, s in enumerate(steps)], "step string, item int")
    seqs = checkpointed(weighted_sequences(rows, items, most_len, block_s))  # small, and read by every later pass
    part = seqs.mapInArrow(_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    paired = sorted({x for r in part.where(F.col("n") >= least).collect() for x in (r["a"], r["b"])})
    if not paired:
        return spark.createDataFrame([], schema)
    keep = F.array(*[F.lit(x) for x in paired])
    pruned = seqs.select(F.filter("items", lambda x: F.array_contains(keep, x)).alias("items"), "weight")
    pruned = checkpointed(pruned.where(F.size("items") >= 1).groupBy("items").agg(F.sum("weight").alias("weight")))
    tasks = max(1, round(pruned.count() / CHUNK))
    spread = pruned.repartition(tasks, F.xxhash64("items"))
    found = written(spread.mapInArrow(_candidates(share, most_len), "pattern array<int>").where(F.size("pattern") >= least_len).distinct(), "candidates")
    blocks = -(-found.count() // CANDIDATES)
    names = spark.createDataFrame([(i, s) for i, s in enumerate(steps)], "item int, name string")
    counted = []
    for k in range(blocks):  # as many as a task may hold
        part = found.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        patterns = sorted(tuple(p) for (p,) in part.collect())
        if patterns:
            support = pruned.mapInArrow(_supports(patterns), "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("support"))
            counted.append(support.where(F.col("support") >= least))
    if not counted:
        return spark.createDataFrame([], schema)
    placed = reduce(DataFrame.unionAll, counted).select("pattern", "support", F.posexplode("pattern").alias("at", "item")).join(F.broadcast(names), "item")
    named = placed.groupBy("pattern", "support").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("s"))
    return named.select(F.transform("s", lambda r: r["name"]).alias("steps"), F.size("s").alias("length"), "support")


__all__ = ["Diagrams", "frequent_subsequences", "shorten", "step_of"]
