"""Byte-level byte-pair encoding from a public vocabulary file.

Merges are found with a heap of adjacent pairs over a doubly linked list of
symbols: the pair of the lowest rank (leftmost at ties) is popped, entries
that a former merge made stale are skipped, and the two new neighbours are
pushed. A piece of n bytes costs O(n log n), whatever it holds.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import islice

#: Code points whose class is the same in every Unicode version in use; texts
#: with others are split by the tokenizers library, whose tables may differ.
SETTLED_RANGES = [(0, 0x530), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x2190, 0x21FF), (0x2500, 0x257F), (0x3040, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
#: White space as the splitting pattern knows it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of text that are split at once.
SPAN = 1 << 20
#: Pieces kept with their result (in each of two generations), and the longest piece kept.
KEPT_PIECES, KEPT_CHARS = 100_000, 48
#: Bits of a heap entry that hold the position.
POSITION = 32


def ranges(kind: str) -> str:
    """The settled code points of one general category, as the inside of a class."""
    out: list[list[int]] = []
    for low, high in SETTLED_RANGES:
        for c in range(low, high + 1):
            if unicodedata.category(chr(c))[0] == kind:
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
    return "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in out)


def splitter() -> re.Pattern:
    """Words, numbers and symbol runs with the space before them, contractions, and white space."""
    letter, number = ranges("L"), ranges("N")
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Kept(dict):
    """A bounded cache in two generations: what was not asked for during one generation goes."""

    def __init__(self, make, most: int = KEPT_PIECES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str):
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
            if len(piece) > KEPT_CHARS:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class ByteBpe:
    """Vocabulary and merges of a ``tokenizers`` JSON file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.rank: dict[int, int] = {}  # of a pair a << 32 | b
        self.merged: list[int] = []  # by rank
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = k
            self.merged.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = splitter()
        self.unsettled = re.compile(f"[^{''.join(f'{chr(a)}-{chr(b)}' for a, b in SETTLED_RANGES)}]")
        self.path = path
        self._library = self._tiktoken = None
        self.counts = Kept(self.count)
        self.texts = Kept(self.text)

    def merge(self, piece: bytes) -> tuple[list[int], int]:
        """Symbols that are left of one piece (merged-away ones are -1), and the number of merges."""
        symbols = [self.first[b] for b in piece]
        n, rank, merged = len(symbols), self.rank.get, self.merged
        heap, i, a = [], -1, None
        for b in symbols:
            if i >= 0 and (k := rank(a << 32 | b)) is not None:
                heap.append(k << POSITION | i)
            i, a = i + 1, b
        if not heap:
            return symbols, 0
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, mask = 0, (1 << POSITION) - 1
        while heap:
            entry = pop(heap)
            i, k = entry & mask, entry >> POSITION
            j = after[i]
            a = symbols[i]
            if a < 0 or j >= n or rank(a << 32 | symbols[j]) != k:
                continue  # a former merge took one of the two
            merges += 1
            new = symbols[i] = merged[k]
            symbols[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (k := rank(new << 32 | symbols[j])) is not None:
                    push(heap, k << POSITION | i)
            h = before[i]
            if h >= 0 and (k := rank(symbols[h] << 32 | new)) is not None:
                push(heap, k << POSITION | h)
        return symbols, merges

    def count(self, piece: str) -> int:
        """Tokens of a piece: its bytes minus its merges."""
        data = piece.encode("utf-8")
        return len(data) - self.merge(data)[1]

    def ids(self, piece: str) -> list[int]:
        return [x for x in self.merge(piece.encode("utf-8"))[0] if x >= 0]

    def library_ids(self, piece: str) -> list[int]:
        """The ids of one piece by tiktoken, which merges by the same ranks."""
        if self._tiktoken is None:
            import tiktoken

            ranks = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
            self._tiktoken = tiktoken.Encoding("pieces", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        return self._tiktoken.encode_ordinary(piece)

    def text(self, piece: str) -> tuple[str, int, bytes]:
        """The piece's ids in decimal, joined by commas, their number, and what they decode to."""
        ids = self.library_ids(piece)
        return ",".join([self.decimal[i] for i in ids]), len(ids), b"".join([self.bytes_of[i] for i in ids])

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and these strings themselves (True)."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:] if at else text, False

    def settled(self, segment: str) -> bool:
        """Whether this module's pattern splits the segment as the library does."""
        return segment.isascii() or self.unsettled.search(segment) is None

    def library_pieces(self, segment: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [segment[a:b] for _, (a, b) in self._library.pre_tokenize_str(segment)]

    def pieces(self, segment: str) -> Iterator[list[str]]:
        """The pieces that merges don't cross, in bounded lists."""
        if not self.settled(segment):
            yield self.library_pieces(segment)
        elif len(segment) <= SPAN:
            yield self.split.findall(segment)
        else:
            matches = self.split.finditer(segment)
            while part := [m[0] for m in islice(matches, SPAN // 8)]:
                yield part

    def n_tokens(self, text: str) -> int:
        total = 0
        for segment, special in self.segments(text):
            if special:
                total += 1
                continue
            for part in self.pieces(segment):
                known = self.counts
                for piece, times in Counter(part).items():
                    total += times * known[piece]
        return total


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One vocabulary a worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
