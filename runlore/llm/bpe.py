"""Problem 8: encoding and decoding with a public byte-level BPE vocabulary, as a lazy transducer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
#: Pieces and states a worker remembers before it starts afresh.
MEMORY = 400_000
#: Pending bytes up to which states are remembered.
PENDING = 96


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The rank file of an installed public vocabulary; any path to such a file may be given instead."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Transducer:
    """The merges as a finite-state transducer, determinised as far as the texts ask for.

    After some bytes of a piece, the encoding of each prefix ends in one certain token; a token may follow
    another exactly if encoding the two together leaves them apart. A state is the last token that no further
    byte can change and the bytes pending since. A step follows every token in progress, picks the one that
    ends here, and emits the tokens on which all positions still in play agree: the lookahead is bounded by
    the longest token in progress, not by the piece. Steps are remembered per state and byte.
    """

    def __init__(self, path: str) -> None:
        self.ids: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            if line:
                token, rank = line.split()
                self.ids[base64.b64decode(token)] = int(rank)
        self.bytes = {i: t for t, i in self.ids.items()}
        self.trie: dict = {}
        for token, i in self.ids.items():
            node = self.trie
            for b in token:
                node = node.setdefault(b, {})
            node[-1] = i
        self.apart: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [(-1, b"", (-1,), ((0, self.trie),))]
        self.numbers: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merge(self, text: bytes) -> list[int]:
        """The merges applied by rank, for the short texts that decide whether two tokens stay apart."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ids.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        got = self.apart.get(key)
        if got is None:
            if len(self.apart) > 4 * MEMORY:
                self.apart.clear()
            alone = self.merge(self.bytes[b]) == [b]
            got = self.apart[key] = alone if a < 0 else alone and self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return got

    def advance(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """(state, tokens emitted) after one more byte."""
        certain, pending, last, active = state
        m = len(pending) + 1
        moved, ending = [], None
        for start, node in active:  # the earliest start is the longest token
            node = node.get(byte)
            if node is None:
                continue
            moved.append((start, node))
            e = node.get(-1)
            if ending is None and e is not None and self.may_follow(last[start], e):
                ending = e
        pending, last = pending + bytes((byte,)), (*last, ending)
        moved.append((m, self.trie))
        common = None
        for start, _ in moved:
            chain, at = set(), start
            while at > 0:
                chain.add(at)
                at -= len(self.bytes[last[at]])
            common = chain if common is None else common & chain
            if not common:
                return (certain, pending, last, tuple(moved)), ()
        cut = max(common)
        out, at = [], cut
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes[last[at]])
        certain = last[cut]
        return (certain, pending[cut:], (certain, *last[cut + 1 :]), tuple((s - cut, n) for s, n in moved)), tuple(reversed(out))

    def finish(self, state: tuple) -> tuple[int, ...]:
        last, at, out = state[2], len(state[1]), []
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes[last[at]])
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        if len(self.states) > MEMORY:
            self.clear()
        out: list[int] = []
        number, state = 0, None  # state is set while it is too long to be remembered
        for byte in piece:
            if state is None:
                step = self.steps.get(number << 8 | byte)
                if step is not None:
                    number, tokens = step
                    out += tokens
                    continue
                state = self.states[number]
            new, tokens = self.advance(state, byte)
            out += tokens
            if len(new[1]) > PENDING:
                number, state = -1, new
                continue
            key = (new[0], new[1])
            to = self.numbers.get(key)
            if to is None:
                to = self.numbers[key] = len(self.states)
                self.states.append(new)
            if number >= 0:
                self.steps[number << 8 | byte] = (to, tokens)
            number, state = to, None
        if state is not None:
            out += self.finish(state)
        else:
            end = self.ends.get(number)
            if end is None:
                end = self.ends[number] = self.finish(self.states[number])
            out += end
        return out


class Utf8Stream:
    """Bytes to text as they come: a state machine over the lead and continuation bytes of UTF-8.

    A sequence cut off at the end of a part goes on in the next; a byte that cannot go on a sequence closes
    it with one replacement character.
    """

    def __init__(self) -> None:
        self.need, self.code, self.lo, self.hi = 0, 0, 0x80, 0xBF

    def feed(self, part: bytes) -> str:
        if not self.need and part.isascii():
            return part.decode("ascii")
        out: list[str] = []
        for b in part:
            if self.need:
                if self.lo <= b <= self.hi:
                    self.code, self.need, self.lo, self.hi = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.lo, self.hi = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.lo, self.hi = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.lo, self.hi = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        cut, self.need = self.need, 0
        return "�" if cut else ""


def ascii_split(pattern: str) -> re.Pattern | None:
    """What a splitting pattern is over texts of ASCII alone, for the faster engine: letters, digits and white space
    spelt out. None where the pattern has classes that this does not know."""
    plain = re.sub(r"\[\^?[^\]]*\]|\\p\{[LN]\}|\\s", lambda m: _ascii_class(m[0]), pattern)
    return None if "\\p" in plain or "(?i" in plain or "\\w" in plain else re.compile(plain, re.ASCII)


def _ascii_class(text: str) -> str:
    inside = text[0] == "["
    for name, spelt in ((r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9"), (r"\s", r" \t\n\r\f\v")):
        text = text.replace(name, spelt if inside else f"[{spelt}]")
    return text


class Tokenizer:
    """Texts to ids and back, with remembered pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        self.fst = Transducer(path)
        self.split = regex.compile(pattern)
        self.ascii_split = ascii_split(pattern) or self.split
        self.pieces: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known, split = self.pieces, self.ascii_split if text.isascii() else self.split
            for m in split.finditer(text) if len(text) > 1 << 20 else split.findall(text):
                piece = m if isinstance(m, str) else m[0]
                ids = known.get(piece)
                if ids is None:
                    ids = tuple(self.fst.encode(piece.encode("utf-8")))
                    if len(piece) <= 48:
                        if len(known) > MEMORY:
                            known.clear()
                        known[piece] = ids
                out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        stream = Utf8Stream()
        return "".join([stream.feed(self.fst.bytes[i]) for i in ids]) + stream.close()


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens; null and empty texts have an empty list.

    One narrow pass. Special-token strings in a text are ordinary text. Whole texts are encoded, however long;
    repeated ids and other columns do not matter.
    """
    path, pattern = vocabulary_path(vocabulary), pattern or split_pattern()
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for b in batches:
            ids, sizes = [], [0]
            for text in b.column(1):
                ids += t.encode(text.as_py())
                sizes.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "ids"])

    out = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, id_col: str, ids_col: str, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(id, text) from lists of ids; a null or empty list is the empty text."""
    path, pattern = vocabulary_path(vocabulary), pattern or split_pattern()
    picked = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for b in batches:
            texts = pa.array([t.decode(x.as_py() or ()) for x in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["id", "text"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
