"""Objects at URLs, whole or in byte ranges where their server gives ranges."""

from __future__ import annotations

import io
import urllib.request
from dataclasses import dataclass

from tidemark.sources.objects import LOOK, OVERLAP

#: Fixed value: chunks under this size aren't made.
LEAST_CHUNK = 1 << 20


@dataclass(frozen=True)
class UrlPart:
    """What a function of a ``url`` gets. Parts overlap; ``data_stream`` gives the lines that begin in the part."""

    path: str
    size: int | None
    part: int = 0
    start: int = 0
    chunk_size: int | None = None  # None: the whole object

    @property
    def data_byte_range(self) -> tuple[int, int] | None:
        return self.chunk_size and (self.start, self.start + self.chunk_size + OVERLAP)

    @property
    def data_stream(self) -> io.BufferedIOBase:
        """A stream of the lines that begin in the part, each whole however long."""
        if self.chunk_size is None:
            return urllib.request.urlopen(self.path)
        end = min(self.start + self.chunk_size, self.size)
        first = self.line_start(self.start)
        last = self.line_start(end)
        return io.BytesIO(self.fetch(first, last) if first < last else b"")

    def fetch(self, start: int, end: int) -> bytes:
        request = urllib.request.Request(self.path, headers={"Range": f"bytes={start}-{end - 1}"})
        with urllib.request.urlopen(request) as f:
            return f.read()

    def line_start(self, at: int) -> int:
        """The first start of a line at or after a place, or the size."""
        if at == 0 or at >= self.size:
            return min(at, self.size)
        at -= 1
        while at < self.size:
            block = self.fetch(at, min(at + LOOK, self.size))
            if (k := block.find(b"\n")) >= 0:
                return at + k + 1
            at += len(block)
        return self.size


def head(url: str) -> tuple[int | None, bool]:
    """Size, if the server says it, and whether it gives ranges."""
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD")) as f:
        size = f.headers.get("Content-Length")
        return (int(size) if size else None), "Accept-Ranges" in f.headers


def parts(url: str, chunk_size: int | None = None, chunk_number: int | None = None, least: int = LEAST_CHUNK) -> list[UrlPart]:
    """The parts of the object at a URL. ``chunk_number`` divides the chunk size (and adds what the object's size leaves), not the object as elsewhere."""
    size, ranged = head(url)
    each = chunk_size
    if chunk_number and size is not None:
        each = (chunk_size or size) // chunk_number + size % chunk_number
    if each is not None and each < least:
        each = None
    if not ranged or each is None or size is None or size <= each:
        return [UrlPart(url, size)]
    return [UrlPart(url, size, k, at, each) for k, at in enumerate(range(0, size, each))]
