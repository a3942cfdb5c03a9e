"""BPE encoding by per-prefix dynamic programming, and decoding.

In an encoding by ranked merges the last token of every prefix is unique.  It is
found from left to right: an automaton over the vocabulary gives every token
that is a suffix of the prefix, and the one that may follow the last token of
the shorter prefix is stored.  Two tokens may stand side by side if no merge
across their boundary would have come first; that is read off the merge ranks
along the right edge of one and the left edge of the other.  The ids follow from
the back-pointers of the whole word.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewind.llm.common import bounded, chunks, tidy

#: Words and pairs of tokens whose results a task keeps, some 40 MB and 20 MB.
CACHE_WORDS = 200_000
CACHE_PAIRS = 150_000
CHARS_OUT = 1 << 21
NEVER = 1 << 60


@cache
def unknown_characters() -> re.Pattern:
    """Finds a code point that Python's Unicode tables don't know."""
    found = []
    for unknown, run in groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c)) == "Cn"):
        if unknown:
            first, *rest = run
            found.append(f"\\U{first:08x}-\\U{rest[-1] if rest else first:08x}")
    return re.compile(f"[{''.join(found)}]")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """Ids of each word as little-endian 32-bit integers, kept for when it comes again.

    When half of the room is full, the words since then become the old ones;
    old ones that come again move back, the others go.
    """

    def __init__(self, bpe: "Bpe") -> None:
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.pop(word, None) or self.bpe.word(word)
        if len(self) >= CACHE_WORDS // 2:
            self.old = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = found
        return found


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next free from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return letters


class Bpe:
    """Tables of one vocabulary (a parsed tokenizer file)."""

    def __init__(self, source: str) -> None:
        spec, self.source, self.library = json.loads(source), source, None
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.text_of = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.pair_rank[pair] = rank
            self.parts.setdefault(whole, (rank, *pair))
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + self.end] for b in range(256)]
        self.edges: dict[int, tuple[tuple, tuple]] = {}
        self.fits: dict[int, bool] = {}
        self.words = Words(self)
        self.any = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+")
        self.rare = re.compile("[^\\x00-\u024f\u2010-\u2027\u20ac]")
        self.cut = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._automaton(set(vocab.values()))

    def close(self) -> None:
        """Let go of all tables now: the words refer back to this object."""
        self.__dict__.clear()

    def symbols(self, token: int) -> list[int]:
        out, todo = [], [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                todo += (self.parts[t][2], self.parts[t][1])
            else:
                out.append(t)
        return out

    def _automaton(self, tokens: set[int]) -> None:
        """States are prefixes of tokens; each knows its longest proper suffix state and the tokens that end there, longest first."""
        self.next: list[dict[int, int]] = [{}]
        ends: list[tuple[int, int] | None] = [None]
        for t in tokens:
            state, seq = 0, self.symbols(t)
            for s in seq:
                at = self.next[state].get(s)
                if at is None:
                    at = self.next[state][s] = len(self.next)
                    self.next.append({})
                    ends.append(None)
                state = at
            ends[state] = (t, len(seq))
        self.suffix = [0] * len(self.next)
        self.matches: list[tuple] = [()] * len(self.next)
        todo = deque([0])
        while todo:
            state = todo.popleft()
            for s, at in self.next[state].items():
                back = self.suffix[state]
                while back and s not in self.next[back]:
                    back = self.suffix[back]
                self.suffix[at] = self.next[back].get(s, 0) if state else 0
                self.matches[at] = ((ends[at],) if ends[at] else ()) + self.matches[self.suffix[at]]
                todo.append(at)

    def _edge(self, token: int) -> tuple[tuple, tuple]:
        """Pieces along the right and the left edge, from single symbols up, each with the rank of the merge that ends it."""
        found = self.edges.get(token)
        if found is None:
            sides = []
            for side in (2, 1):
                pieces, t, until = [], token, NEVER
                while True:
                    pieces.append((t, until))
                    if t not in self.parts:
                        break
                    until, t = self.parts[t][0], self.parts[t][side]
                sides.append(tuple(reversed(pieces)))
            found = self.edges[token] = tuple(sides)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """True if merging the symbols of both tokens gives just these two.

        A merge over the boundary happens if its rank comes before the pieces on
        either side are merged away; of equal ranks the one further left wins.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            lefts, rights = self._edge(left)[0], self._edge(right)[1]
            i = j = 0
            known = True
            while True:
                (x, x_end), (y, y_end) = lefts[i], rights[j]
                rank = self.pair_rank.get((x, y))
                if rank is not None and rank < x_end and rank <= y_end:
                    known = False
                    break
                if x_end == NEVER and y_end == NEVER:
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def encode_symbols(self, seq: list[int]) -> list[int]:
        n, state = len(seq), 0
        last, start = [0] * (n + 1), [0] * (n + 1)
        step, suffix, matches, known, fits = self.next, self.suffix, self.matches, self.fits.get, self.compatible
        for i, s in enumerate(seq, 1):
            while state and s not in step[state]:
                state = suffix[state]
            state = step[state].get(s, 0)
            for token, size in matches[state]:
                at = i - size
                if at:
                    fit = known(last[at] << 32 | token)
                    if fit is None:
                        fit = fits(last[at], token)
                    if not fit:
                        continue
                last[i], start[i] = token, at
                break
        out, i = [], n
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]

    def word(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        raw = piece.encode("utf-8", "surrogatepass")
        seq = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return _packed(self.encode_symbols(seq))

    def pieces(self, text: str) -> list[str]:
        """Normalized words: canonical composition, white space to one blank, lower case letter by letter.

        Code points that are newer than Python's Unicode tables have the class and
        the lower case that the library gives them.
        """
        if text.isascii():
            return self.plain.findall(text.lower())
        if self.rare.search(text) and unknown_characters().search("".join(set(text))):
            if self.library is None:
                self.library = Tokenizer.from_str(self.source)
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        text = unicodedata.normalize("NFC", text)
        low = text.lower()
        return self.any.findall("".join(map(str.lower, text)) if "Σ" in text or len(low) != len(text) else low)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids and decoded text.  Strings of special tokens become their ids, as they do by default."""
        found, word = [], self.words.__getitem__
        for i, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            if i % 2:
                found.append(_packed([self.added[part]]))
            else:
                found += map(word, self.pieces(part))
        ids = b"".join(found)
        return ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.text_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids, decoded)``, one row per row.

    ids holds little-endian unsigned 32-bit integers, decoded is their decoding.
    A null text counts as empty: no ids, an empty text.  Words of any length and
    texts of any length are encoded whole, repeated rows each by themselves; no
    rows give no rows.  Other columns are not read.  The driver reads the
    vocabulary file, of fixed size, and sends it along.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        source = file.read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = Bpe(source)
        try:
            for pdf in batches:
                for part in chunks(pdf, CHARS_OUT):
                    done = [bpe.encode(t) for t in part["text"]]
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": [d[0] for d in done], "decoded": [d[1] for d in done]})
        finally:
            bpe.close()  # a worker that waits for its next task holds no tables

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(tidy(run), "doc_id long, ids binary, decoded string")
