"""Byte-pair encoding that reuses content-defined chunks, with exact joins.

A gear hash over the last 32 bytes cuts a text where its low bits vanish, so
a passage that many documents share is cut alike in all of them. A chunk's
core (all but its first two and its last two pieces) is encoded once and kept;
at each join the pieces from the last certain piece start to the next core are
split and encoded again. The join is right when a piece ends exactly where the
core begins, since splitting depends only on what follows a piece start; when
none does, the whole chunk is split again and the search goes on at the next.

A piece is certain once two more characters are known: runs and white space
need one, and an apostrophe needs two to tell whether ``re``, ``ve`` or ``ll``
follows. So the last two pieces of a chunk, which may end in its last two
characters, are never part of a core, and a join looks two characters into it.

Null and empty texts give no tokens; the digests are then those of nothing.
Texts of any length are read chunk by chunk; repeated rows are encoded each,
with the chunks kept from the first; an empty table gives an empty result;
other columns aren't read. Chunks are kept up to a bound of bytes in each
worker, in two generations: a chunk that is asked for again outlives the bound.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm import byte_bpe, common

#: Bits of the hash that must vanish at a cut; the least and greatest bytes of a chunk.
CUT_BITS, LEAST, GREATEST = 10, 256, 8192
#: Bytes of chunk texts and pieces with their ids (in each of two generations) that a worker keeps, and bytes hashed at once.
KEPT_BYTES, KEPT_TEXTS, HASHED = 4 << 20, 25_000, 1 << 20

_gear = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks, each at a code point's start."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    found = []
    for at in range(0, n, HASHED):
        lo = max(0, at - 31)
        h = _gear[raw[lo : at + HASHED]]
        for step in (1, 2, 4, 8, 16):
            moved = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += moved
        # bits 22 to 31 depend on the last 32 bytes
        found.append(np.flatnonzero((h[at - lo :] >> np.uint32(32 - CUT_BITS)) == 0) + at + 1)
    ends, last = [], 0

    def put(end: int) -> None:
        nonlocal last
        while end - last > GREATEST:
            cut = last + GREATEST
            while cut > last and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            last = cut
        ends.append(end)
        last = end

    for end in np.concatenate(found).tolist():
        while end < n and raw[end] & 0xC0 == 0x80:
            end += 1
        if end - last >= LEAST and end < n:
            put(end)
    if last < n:
        put(n)
    return ends


class ChunkEncoder:
    def __init__(self, vocabulary: str, kept_bytes: int = KEPT_BYTES):
        self.bpe = byte_bpe.load(vocabulary)
        self.bpe.texts.most = KEPT_TEXTS
        self.kept: dict[bytes, tuple | None] = {}
        self.old: dict[bytes, tuple | None] = {}
        self.held, self.most = 0, kept_bytes // 2
        self.cuts = cuts
        self.hits = self.misses = self.rescans = 0

    def chunk(self, data: bytes) -> tuple | None:
        """(text, end of the head, start of the tail, core's ids in decimal, their number, core decoded), or None where it is too short for a core."""
        if data in self.kept:
            self.hits += 1
            return self.kept[data]
        if data in self.old:
            self.hits += 1
            out = self.old[data]
        else:
            self.misses += 1
            text = data.decode("utf-8")
            pieces = self.bpe.split.findall(text)
            out = None
            if len(pieces) >= 6:
                known = self.bpe.texts
                ids, numbers, backs = zip(*[known[p] for p in pieces[2:-2]])
                tail = len(text) - len(pieces[-1]) - len(pieces[-2])
                out = (text, len(pieces[0]) + len(pieces[1]), tail, ",".join(ids), sum(numbers), b"".join(backs))
        if self.held + len(data) > self.most:
            self.old, self.kept, self.held = self.kept, {}, 0
        self.kept[data] = out
        self.held += len(data)
        return out

    def parts(self, text: str):
        """(ids in decimal, their number, decoded bytes) of consecutive parts of the text."""
        for segment, special in self.bpe.segments(text):
            if special:
                i = self.bpe.special[segment]
                yield str(i), 1, self.bpe.bytes_of[i]
            elif not self.bpe.settled(segment):
                yield from self.loose(self.bpe.library_pieces(segment))
            else:
                yield from self.joined(segment)

    def loose(self, pieces):
        known = self.bpe.texts
        for p in pieces:
            yield known[p]

    def joined(self, segment: str):
        data, last, open_text = segment.encode("utf-8"), 0, ""
        for end in self.cuts(data):
            piece = data[last:end]
            last = end
            core = self.chunk(piece)
            if core is None:
                open_text += piece.decode("utf-8")
                continue
            text, head, tail, ids, n, back = core
            due = len(open_text) + head
            seen = open_text + text[: head + 2]
            pieces, at = [], 0
            for m in self.bpe.split.finditer(seen):
                if at >= due:
                    break
                pieces.append(m[0])
                at = m.end()
            if at == due:
                yield from self.loose(pieces)
                yield ids, n, back
                open_text = text[tail:]
            else:
                self.rescans += 1
                open_text += text
        for part in self.bpe.pieces(open_text):
            yield from self.loose(part)

    def ids(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.parts(text) for i in ids.split(",")]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids in decimal with commas, SHA-256 of the decoded text."""
        total, ids_hash, text_hash, comma = 0, hashlib.sha256(), hashlib.sha256(), ""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        held, backs, size = [], [], 0

        def flush(final: bool = False) -> None:
            nonlocal comma, size
            if held:
                ids_hash.update((comma + ",".join(held)).encode())
                comma = ","
            text_hash.update(decoder.decode(b"".join(backs), final).encode("utf-8"))
            held.clear()
            backs.clear()
            size = 0

        for ids, n, back in self.parts(text):
            held.append(ids)
            backs.append(back)
            total += n
            size += len(back)
            if size > 1 << 20:
                flush()
        flush(True)
        return total, ids_hash.hexdigest(), text_hash.hexdigest()


_encoders: dict[str, ChunkEncoder] = {}


def encoder(vocabulary: str) -> ChunkEncoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = ChunkEncoder(vocabulary)
    return _encoders[vocabulary]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids array<int>: the tokens themselves, in the text's order."""
    common.text_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [[] if x is None else enc.ids(x) for x in b["text"]]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    from pyspark.sql import functions as F

    common.text_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.give_back()
        enc = encoder(vocabulary)
        for texts in batches:
            yield pd.DataFrame([enc.digest("" if x is None else x) for x in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        common.give_back()

    out = docs.select("doc_id", run("text").alias("out"))
    return out.select("doc_id", "out.n_tokens", "out.ids_sha256", "out.decoded_sha256")


def query(spark, sf_dir):
    return round_trip(common.table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"))
