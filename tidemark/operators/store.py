"""Values that calls put down for other calls, by reference."""

from __future__ import annotations

import posixpath
import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyarrow import fs as pafs
from pyspark import cloudpickle

from tidemark.sources.objects import open_file


@dataclass(frozen=True)
class StoredObject:
    """Where a value lies; small enough to be an argument or result."""

    path: str


@dataclass(frozen=True)
class Storage:
    """What a parameter ``storage`` gets: puts and gets values in a folder that driver and executors share."""

    root: str

    def put_object(self, value: Any, key: str | None = None) -> StoredObject:
        """Write a value, under a name of its own or the key below the folder. A file appears whole or not at all, so a repeated call does no harm."""
        path = f"{self.root}/{key or uuid.uuid4().hex}"
        files, name = filesystem(path)
        files.create_dir(posixpath.dirname(name), recursive=True)
        part = f"{posixpath.dirname(name)}/.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(cloudpickle.dumps(value))
        files.move(part, name)
        return StoredObject(path)

    def get_object(self, stored: StoredObject) -> Any:
        with open_file(stored.path) as f:
            return cloudpickle.loads(f.read())


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+://", path) and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", path)
