"""Problem 9: evaluation items leaking into a corpus, by latent semantic retrieval and alignment."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlore.runtime import written

#: Words of a passage and words from one corpus passage to the next.
PASSAGE, STRIDE = 16, 4
#: Latent dimensions, and extra ones of the random start.
RANK, EXTRA = 128, 16
#: Latent cosine from which an item is a candidate. Passages of both sides begin every four words, so over a quote
#: of 16 words one of the corpus lies within two words of it and one of the item within two words of that: with two
#: edits at least 10 of 16 words agree. The README has the recall measured at this bound.
MIN_COSINE = 0.5
#: Item words a passage must have to be looked at: the bound above.
MIN_SHARED = 10
#: A quote has this many consecutive item words, with at most one edit in any ten.
MIN_WORDS, EDIT_EVERY = 16, 10
#: Its edits lie so far apart that it has an unbroken stretch of this many words.
UNBROKEN = MIN_WORDS // 2
#: A paraphrase keeps this share of the item's words in order, and this share of its answer's.
PARAPHRASE, ANSWER = 0.5, 0.8
#: Near passages that a text must have to be looked at for a paraphrase of an item.
PARAPHRASE_PASSAGES = 4

_WORD = re.compile(r"[^\W_]+")
_ANSWER = re.compile(r"\banswer\s*:", re.I)
_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
_ZERO = re.compile("[­​-‍⁠﻿]")


def words(text: str | None) -> list[str]:
    """Stretches of letters and digits, lower-case; tags, entities and zero-width characters do not count."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _ZERO.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


class Space:
    """The vocabulary of the items with its weights over the corpus, and the latent space of its passages."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.words = [(i, words(t)) for i, t in items]
        #: How many words of each item are its answer, at its end; 0 where it names none.
        self.answers = [len(words(parts[-1])) if len(parts := _ANSWER.split(t)) > 1 else 0 for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.words for w in ws}))}
        self.size = len(self.vocabulary)
        self.idf = np.ones(self.size + 1)
        self.basis: np.ndarray | None = None

    def ids(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, ws, repeat(self.size)), np.int32, len(ws))

    def weigh(self, df: np.ndarray, passages: int) -> None:
        """Inverse document frequencies over all corpus passages; words of no item weigh as much as the rarest."""
        idf = np.log((1 + passages) / (1 + df)) + 1
        self.idf = np.append(idf, idf.max(initial=1.0))

    def starts(self, n: int, stride: int) -> np.ndarray:
        """Where the passages of a text of ``n`` words begin; the last one ends with the text."""
        if n <= PASSAGE:
            return np.zeros(min(n, 1), np.int64)
        at = np.arange(0, n - PASSAGE + 1, stride)
        return at if at[-1] == n - PASSAGE else np.append(at, n - PASSAGE)

    def norms(self, p: np.ndarray) -> np.ndarray:
        """TF-IDF norms of passages (rows of word ids, -1 where a text is short); each word of no item is its own."""
        p = np.sort(p, axis=1)
        own = np.where(p < 0, 0.0, self.idf[p] ** 2)
        total = own.sum(1)
        for k in range(1, p.shape[1]):  # a word that is there t times weighs t * t
            same = (p[:, k:] == p[:, :-k]) & (p[:, k:] < self.size)
            if not same.any():
                break
            total += 2 * np.where(same, own[:, k:], 0.0).sum(1)
        return np.sqrt(total)

    def embed(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Latent coordinates of the passages of a text, as sums over its words."""
        sums = np.zeros((len(ids) + 1, self.basis.shape[1]))
        np.cumsum(self.weighted[ids], axis=0, out=sums[1:])
        return sums[np.minimum(starts + PASSAGE, len(ids))] - sums[starts]

    @property
    def weighted(self) -> np.ndarray:
        """The words' latent directions times their weights; a word of no item has no place in the space.

        Rows of the basis are brought to length 1: a space of fixed rank holds little of a rare word of a large
        vocabulary, and passages would be told apart by their frequent words alone."""
        if getattr(self, "_weighted", None) is None:
            size = np.maximum(np.linalg.norm(self.basis, axis=1), 1e-30)
            self._weighted = np.vstack([self.basis * (self.idf[:-1] / size)[:, None], np.zeros((1, self.basis.shape[1]))])
        return self._weighted


#: Rows of a dense block of passages, cells it may have, and word weights whose products are held at a time.
_ROWS, _CELLS, _SOME = 2048, 1 << 19, 1 << 15


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    lists = batch.column(1)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
    for k, doc in enumerate(batch.column(0).to_pylist()):
        yield doc, flat[ends[k] : ends[k + 1]]


def _dense(space: Space, batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    """The texts of a batch with enough item words within the length of a passage."""
    lists = batch.column(1)
    known = lists.flatten().to_numpy(zero_copy_only=False) < space.size
    c = np.concatenate(([0], np.cumsum(known)))
    ends = np.minimum(np.arange(len(known)) + PASSAGE, len(known))
    rich = np.concatenate(([0], np.cumsum(c[ends] - c[:-1] >= MIN_SHARED)))  # a window may reach into the next text
    at = 0
    for (doc, ids), n in zip(_texts(batch), lists.value_lengths().fill_null(0).to_pylist()):
        if rich[at + n] > rich[at]:
            yield doc, ids
        at += n


def _consecutive(space: Space, lists: list[np.ndarray]) -> np.ndarray:
    """The consecutive passages of texts as rows of word ids, the last of a text filled up with -1."""
    sizes = np.array([len(x) for x in lists], np.int64)
    rows = -(-sizes // PASSAGE)
    p = np.full((int(rows.sum()), PASSAGE), -1, np.int32)
    if len(p):
        flat = np.concatenate(lists)
        shift = np.repeat((np.cumsum(rows) - rows) * PASSAGE - (np.cumsum(sizes) - sizes), sizes)
        p.reshape(-1)[np.arange(len(flat)) + shift] = flat
    return p


def _distinct(space: Space, p: np.ndarray) -> np.ndarray:
    """How many passages hold each item word."""
    p = np.sort(p, axis=1)
    new = np.ones(p.shape, bool)
    new[:, 1:] = p[:, 1:] != p[:, :-1]
    return np.bincount(p[new & (p >= 0) & (p < space.size)], minlength=space.size)


def _gram_times(space: Space, p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A'(A m) for passages, in blocks: by a dense block where the vocabulary is small, else through the words' rows."""
    out = np.zeros(m.shape, np.float32)
    norm = space.norms(p)
    some = ((p >= 0) & (p < space.size)).any(1)
    p, norm = p[some], norm[some]
    rows = min(_ROWS, _CELLS // max(1, space.size))
    if rows >= 256:
        scaled, idf = (m * space.idf[:-1, None]).astype(np.float32), space.idf[:-1].astype(np.float32)[:, None]
        for k in range(0, len(p), rows):
            b = p[k : k + rows]
            r, c = np.nonzero((b >= 0) & (b < space.size))
            tf = np.bincount(r * space.size + b[r, c], minlength=len(b) * space.size).reshape(len(b), space.size).astype(np.float32)
            tf /= norm[k : k + rows, None].astype(np.float32)
            out += (tf.T @ (tf @ scaled)) * idf
        return out
    r, c = np.nonzero((p >= 0) & (p < space.size))
    w = p[r, c]
    v = (space.idf[w] / norm[r]).astype(np.float32)
    heads = np.flatnonzero(np.diff(r, prepend=-1))
    cuts = [0, *heads[np.searchsorted(heads, np.arange(_SOME, len(r), _SOME))[:-1]].tolist(), len(r)] if len(r) > _SOME else [0, len(r)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        rw, ww, vw = r[a:b], w[a:b], v[a:b, None]
        new = np.diff(rw, prepend=-1) != 0
        y = np.add.reduceat(m[ww] * vw, np.flatnonzero(new))
        back = y[np.cumsum(new) - 1] * vw
        order = np.argsort(ww, kind="stable")
        head = np.flatnonzero(np.diff(ww[order], prepend=-1))
        out[ww[order][head]] += np.add.reduceat(back[order], head)
    return out


def latent_space(space: Space, tokens: DataFrame, seed: int = 7) -> None:
    """Weights and randomised SVD of the TF-IDF matrix of all corpus passages (A, of item words).

    ``tokens`` has (id, ids, df): texts as word numbers, and in rows without an id how many passages of a task hold
    each word. A'(A Omega) is summed over all passages in one pass; the right singular vectors follow from it by the
    Nystroem factorisation of A'A, which needs no second product. The driver only holds matrices of vocabulary by rank.
    """
    total = np.zeros(space.size + 1)
    counts = tokens.where("df is not null").select(F.posexplode("df").alias("w", "n")).groupBy("w").agg(F.sum("n").alias("n"))
    for row in counts.collect():
        total[row["w"]] = row["n"]
    space.weigh(total[:-1], int(total[-1]))
    width = min(space.size, RANK + EXTRA)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((space.size, width)))[0].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(omega.shape)
        for b in batches:
            out += _gram_times(space, _consecutive(space, [ids for _, ids in _texts(b)]), omega)
        at = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(out[at].astype(np.float32)), pa.list_(pa.float32()))], names=["r", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = np.sum([x.as_py() for x in t["v"].combine_chunks()], axis=0)
        return pa.table({"r": t["r"][:1], "v": pa.array([v], pa.list_(pa.float64()))})

    y = np.zeros(omega.shape)
    parts = tokens.where("df is null").select("id", "ids").mapInArrow(run, "r int, v array<float>")
    for row in parts.groupBy("r").applyInArrow(add, "r int, v array<double>").collect():
        y[row["r"]] = row["v"]
    nu = np.sqrt(space.size) * 1e-6 * max(np.linalg.norm(y, 2), 1e-30)  # float32 sums: keep the factor positive
    y += nu * omega
    core = omega.T.astype(np.float64) @ y
    lo = np.linalg.cholesky((core + core.T) / 2)
    u, _, _ = np.linalg.svd(np.linalg.solve(lo, y.T).T, full_matrices=False)
    space.basis = u[:, : min(RANK, width)]


class Matcher:
    """Candidate items of a text's passages by latent cosine, then the alignment and answer checks."""

    def __init__(self, space: Space) -> None:
        self.space = space
        z, owner = [np.zeros((0, space.basis.shape[1]))], []
        self.ids = [space.ids(ws) for _, ws in space.words]
        for k, ids in enumerate(self.ids):
            at = space.starts(len(ids), STRIDE)
            z.append(space.embed(ids, at))
            owner += [k] * len(at)
        z = np.concatenate(z)
        self.items = (z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]).T.astype(np.float32)
        self.owner = np.array(owner, np.int64)
        self.lists = [x.tolist() for x in self.ids]
        self.stretches = [frozenset(_stretches(x).tolist()) for x in self.ids]

    def candidates(self, ids: np.ndarray) -> dict[int, list[int]]:
        """Items with a passage near enough to one of the text's, and where in the text (starts of passages).

        The items are a stated query set: all their passages, in one matrix of passages by rank, meet the passages
        of the text that have enough item words, in blocks.
        """
        out: dict[int, list[int]] = defaultdict(list)
        starts = self.space.starts(len(ids), STRIDE)
        c = np.concatenate(([0], np.cumsum(ids < self.space.size)))
        starts = starts[c[np.minimum(starts + PASSAGE, len(ids))] - c[starts] >= MIN_SHARED]
        if not len(starts):
            return out
        z = self.space.embed(ids, starts)
        norm = np.maximum(np.linalg.norm(z, axis=1), 1e-9)
        for k in range(0, len(z), _ROWS):
            cos = (z[k : k + _ROWS] / norm[k : k + _ROWS, None]).astype(np.float32) @ self.items
            row, col = np.nonzero(cos >= MIN_COSINE)
            for code in np.unique(row * len(self.ids) + self.owner[col]).tolist():
                r, o = divmod(code, len(self.ids))
                out[o].append(int(starts[k + r]))
        return out

    def leaks(self, ids: np.ndarray) -> list[tuple[int, int, bool, bool]]:
        """(item number, quoted words, whether the answer is there, whether quoted): items the text quotes or retells."""
        out, text, stretches = [], ids.tolist(), _stretches(ids).tolist()
        for o, starts in self.candidates(ids).items():
            spans: list[list[int]] = []
            for s in starts:  # stretches of near passages, with room for a quote that goes on
                a, b = max(0, s - PASSAGE), min(len(text), s + 2 * PASSAGE)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            item, n_answer = self.lists[o], self.space.answers[o]
            some = [(a, b) for a, b in spans if not self.stretches[o].isdisjoint(stretches[a : max(a, b - UNBROKEN + 1)])]
            best = max((longest_quote(item, text[a:b]) for a, b in some), default=0)
            quoted = best >= MIN_WORDS
            if not quoted and (not n_answer or len(starts) < PARAPHRASE_PASSAGES):
                continue
            told = [w for a, b in spans for w in text[a:b]]
            answer = n_answer > 0 and common(item[-n_answer:], told) >= ANSWER * n_answer
            if quoted or (answer and common(item, told) >= PARAPHRASE * len(item)):
                out.append((o, best, answer, quoted))
        return out


def _stretches(ids: np.ndarray) -> np.ndarray:
    """A number for each stretch of ``UNBROKEN`` words; equal stretches have equal numbers."""
    n = len(ids) - UNBROKEN + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(UNBROKEN if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    return out


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = where.get(w, 0)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def longest_quote(item: list[int], text: list[int]) -> int:
    """Most consecutive item words that the text holds in order, with at most one edit in any ten.

    A common subsequence of the two in which any two changed, dropped or added words have nine kept ones between
    them. State per pair of places: kept words since the last edit (up to nine) and item words covered. Texts
    without an unbroken stretch that a long enough quote must have give the length of their longest stretch.
    """
    need = EDIT_EVERY - 1
    where: dict[int, list[int]] = defaultdict(list)
    for j, w in enumerate(text):
        where[w].append(j)
    runs: dict[tuple[int, int], int] = {}
    long_run = 0
    for i, w in enumerate(item):
        for j in where.get(w, ()):
            r = runs[i, j] = runs.get((i - 1, j - 1), 0) + 1
            long_run = max(long_run, r)
    if long_run < UNBROKEN:
        return long_run
    best = 0
    # state[(i, j)] = {kept since edit: item words covered}, over places where the words agree
    state: dict[tuple[int, int], dict[int, int]] = {}
    for i, j in sorted(runs):
        s = {need: 1}
        for c, n in state.get((i - 1, j - 1), {}).items():
            c = min(need, c + 1)
            s[c] = max(s.get(c, 0), n + 1)
        for di, dj in ((2, 2), (2, 1), (1, 2)):  # changed, dropped, added
            n = state.get((i - di, j - dj), {}).get(need)
            if n is not None:
                s[1] = max(s.get(1, 0), n + di)
        state[i, j] = s
        best = max(best, *s.values())
    return best


def find_leaks(corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, n_words, has_answer, is_quote): every pair of a corpus text and a leaked item.

    ``n_words`` is the longest quoted stretch (0 for a paraphrase without an unbroken one); a pair without a quote is a paraphrase: it keeps half of the item's
    words in order, its answer among them. ``items`` is a fixed test set and is held by every task, with its
    vocabulary; the corpus is read once, its item words are kept as numbers in a table of the shared folder, and all
    later passes read that. Null and empty texts hold no leak, items without words are never found, repeated ids
    give one row per text, an item without ``answer:`` is never paraphrased.
    """
    spark = corpus.sparkSession
    rows = [(r[0], r[1]) for r in items.select(item_id, item_text).collect()]
    space = Space([(i, t) for i, t in rows if words(t)])
    picked = corpus.where(F.col(text_col) != "").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = picked.schema["id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"{id_col} {kind}, {item_id} {item_kind}, n_words long, has_answer boolean, is_quote boolean"
    if not space.size:
        return spark.createDataFrame([], schema)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as numbers, and at a task's end how many of its passages hold each word (last: all passages)."""
        df = np.zeros(space.size + 1, np.int64)
        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            lists = [space.ids(words(t)) for t in b.column(1).to_pylist()]
            p = _consecutive(space, lists)
            df[:-1] += _distinct(space, p)
            df[-1] += len(p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32())), pa.nulls(len(lists), pa.list_(pa.int64()))], names=["id", "ids", "df"])
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.list_(pa.int32())), pa.array([df], pa.list_(pa.int64()))], names=["id", "ids", "df"])

    tokens = written(picked.mapInArrow(tokenise, f"id {kind}, ids array<int>, df array<long>"), "leak-words")
    latent_space(space, tokens)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(space)
        for b in batches:
            found = [(doc, space.words[o][0], *x) for doc, ids in _dense(space, b) for o, *x in m.leaks(ids)]
            cols = list(zip(*found)) or [[], [], [], [], []]
            arrays = [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1]).cast(item_arrow), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, item_id, "n_words", "has_answer", "is_quote"])

    item_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind]
    return tokens.where("df is null").select("id", "ids").mapInArrow(search, schema)
