"""Problem 8: encoding the whole corpus with a public byte-level BPE tokenizer, and decoding it.

Method: a bounded-lookahead streaming transducer. The text is cut into words by the tokenizer's pattern
through a window of characters: a word is final once the window holds `HOLD` characters behind it, since
no alternative of the pattern looks farther. A word longer than the window is passed on in pieces. Its
bytes go through `Merger`, which keeps, for each of the last `lookahead` byte positions, the last token
of the encoding of the word up to there (a token may follow another only if the two encode to
themselves); `lookahead` is the longest token the merge list can build. Every later encoding passes
through one of those positions, so tokens before their common ancestor are stable and are emitted.
Words that end within the window are remembered, up to a bound.
"""

from __future__ import annotations

import base64
import codecs
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import tokenizer_dir

#: The pattern of the public byte-level vocabularies, and how it goes on inside a word.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RUNS = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")
HOLD = 3
WINDOW, WORD, MEMO = 65_536, 64, 300_000


class Vocabulary:
    """Ranks of a merge list, its lookahead, and whether two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.lookahead = max(map(len, self.ranks))
        self.endings = {k[-1:] for k in self.ranks}
        self._beside: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; used on two tokens at a time."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > MEMO:
                self._beside.clear()
            known = self._beside[key] = self.merged(a + b) == [a, b]
        return known


class Merger:
    """Bytes in, token ids out as soon as they can't change."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.start()

    def start(self) -> None:
        self.buf, self.base, self.last = b"", 0, [b""]  # last[i]: last token of the encoding up to base + i

    def feed(self, piece: bytes) -> list[int]:
        out: list[int] = []
        for lo in range(0, len(piece), 1024):
            self._extend(piece[lo : lo + 1024])
            if len(self.buf) > 4 * self.v.lookahead + 1024:
                out += self._stable()
        return out

    def _extend(self, piece: bytes) -> None:
        ranks, most, beside, last = self.v.ranks, self.v.lookahead, self.v.beside, self.last
        n = len(self.buf)
        buf = self.buf = self.buf + piece
        for i in range(n + 1, len(buf) + 1):
            for j in range(max(0, i - most), i):
                t = buf[j:i]
                if t in ranks and (u := last[j]) is not None and (not u or beside(u, t)):
                    last.append(t)
                    break
            else:
                last.append(None)

    def _walk(self, end: int) -> list[int]:
        """Positions of token ends on the way back from `end`."""
        way = [end]
        while end > 0:
            end -= len(self.last[end])
            way.append(end)
        return way

    def _stable(self) -> list[int]:
        n = len(self.buf)
        way = self._walk(n)
        on, meet = set(way), n
        for e in range(max(1, n - self.v.lookahead), n):
            if self.last[e] is not None:
                while e not in on:
                    e -= len(self.last[e])
                meet = min(meet, e)
        ends = sorted(x for x in way if 0 < x <= meet)
        if not ends:
            return []
        out, at = [], 0
        for e in ends:
            out.append(self.v.ranks[self.buf[at:e]])
            at = e
        self.buf, self.base = self.buf[at:], self.base + at
        self.last = [self.last[at], *self.last[at + 1 :]]
        return out

    def finish(self) -> list[int]:
        ends, out, at = sorted(x for x in self._walk(len(self.buf)) if x), [], 0
        for e in ends:
            out.append(self.v.ranks[self.buf[at:e]])
            at = e
        self.start()
        return out


class _Memo(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.merger = Merger(vocabulary)

    def __missing__(self, word: str) -> tuple[int, ...]:
        self.merger.start()
        ids = tuple(self.merger.feed(word.encode()) + self.merger.finish())
        if len(word) <= WORD:
            if len(self) > MEMO:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str, window: int = WINDOW):
        self.vocabulary, self.window = Vocabulary(path), max(window, 2 * HOLD)
        self.memo, self.pattern = _Memo(self.vocabulary), regex.compile(PATTERN)
        self.runs = [regex.compile(r) for r in RUNS]

    def encode(self, text: str | None):
        """An iterable of ids; nothing for a null or empty text."""
        if not text:
            return ()
        if len(text) <= self.window:
            return chain.from_iterable(map(self.memo.__getitem__, self.pattern.findall(text)))
        return self._stream(text)

    def _stream(self, text: str):
        at, n, size = 0, len(text), self.window
        while at < n:
            end = min(n, at + size)
            words, used = [], at
            for m in self.pattern.finditer(text, at, end):
                if end < n and m.end() > end - HOLD:
                    break
                words.append(m.group())
                used = m.end()
            yield from chain.from_iterable(map(self.memo.__getitem__, words))
            if used == at:  # one word fills the window
                yield from self._long(text, at, end)
                used = self.reached
            at = used

    def _long(self, text: str, at: int, end: int):
        merger = Merger(self.vocabulary)
        first = at + (text[at] == " " and end > at + 1 and not text[at + 1].isspace())
        run = next(r for r in self.runs if r.match(text, first))
        space = run is self.runs[-1]
        yield from merger.feed(text[at:first].encode())
        at = first
        while at < len(text):
            end = min(len(text), at + self.window)
            m = run.match(text, at, end)
            if m is None:
                break
            stop = m.end()
            if space and stop < len(text) and not run.match(text, stop, stop + 1):
                stop -= stop > first + 1  # the last space of a run goes to what follows
                yield from merger.feed(text[at:stop].encode())
                at = stop
                break
            if space and stop == end < len(text):
                stop -= 1
            yield from merger.feed(text[at:stop].encode())
            at = stop
            if stop < end - space:
                break
        yield from merger.finish()
        self.reached = at


class Decoder:
    """Ids in, text out: bytes are held back only while a character is unfinished."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes, self.state = vocabulary.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def rank_file(folder: str | None = None, name: str = "byte_bpe_50k") -> str:
    return f"{folder or tokenizer_dir()}/{name}.tiktoken"


#: Token ids of one record batch that leaves a task.
BATCH_IDS = 2_000_000


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sizes: bool = False) -> DataFrame:
    """`id_col` and `ids` (list of ints) of every row; with `sizes`, `n_tokens` instead of the ids.

    Null and empty texts get the empty list. Special tokens' strings are ordinary text. Repeated rows
    come out as often as they came in, null ids stay null, other columns are left out, an empty table
    gives no rows. Texts of any length are encoded whole, in constant memory beside their ids.
    """
    path = path or rank_file()
    kind = df.schema[id_col].dataType.simpleString()
    out = pa.int32() if sizes else pa.list_(pa.int32())
    name = "n_tokens" if sizes else "ids"

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts, lo, lengths, flat = b.column(1), 0, [], []

            def done(hi):
                ids = b.column(0).slice(lo, hi - lo)  # noqa: B023
                if sizes:
                    return pa.record_batch([ids, pa.array(lengths, pa.int32())], names=[id_col, name])  # noqa: B023
                off = np.zeros(len(lengths) + 1, np.int32)  # noqa: B023
                np.cumsum(lengths, out=off[1:])  # noqa: B023
                return pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))], names=[id_col, name])  # noqa: B023

            total = 0
            for k, t in enumerate(texts):
                ids = np.fromiter(enc.encode(t.as_py()), np.int32)
                lengths.append(len(ids))
                total += len(ids)
                if not sizes:
                    flat.append(ids)
                    if total > BATCH_IDS:
                        yield done(k + 1)
                        lo, lengths, flat, total = k + 1, [], [], 0
            if lengths:
                yield done(len(texts))

    return df.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"`{id_col}` {kind}, {name} {'int' if out == pa.int32() else 'array<int>'}")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """`id_col` and `text` of every row; null lists give null, empty lists the empty text."""
    path = path or rank_file()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        v = encoder(path).vocabulary
        for b in batches:
            out = []
            for x in b.column(1):
                if not x.is_valid:
                    out.append(None)
                    continue
                d, ids = Decoder(v), x.as_py()
                out.append("".join(d.feed(ids[lo : lo + 4096]) for lo in range(0, len(ids), 4096)) + d.finish())
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return df.select(f"`{id_col}`", f"`{ids_col}`").mapInArrow(run, f"`{id_col}` {kind}, text string")
