"""Files of any store that executors reach: a mounted folder, or hdfs, s3, gs by their addresses. Whole names are taken as they are, also `%` and `#`."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs

_ADDRESS = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*|$)", re.DOTALL)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(store, path within it). `file:/x`, `file:///x` and `/x` are the same file."""
    found = _ADDRESS.fullmatch(path)
    if found is None or found[1].lower() == "file":
        return fs.LocalFileSystem(), found[3] if found else path
    store, root = fs.FileSystem.from_uri(f"{found[1]}://{found[2] or ''}/")
    return store, root.rstrip("/") + found[3]


def write(path: str, data: bytes) -> None:
    """The whole file or none, in place of one that is there: it gets its name when it is complete, so a task may run twice, also at the same time."""
    store, target = located(path)
    part = f"{target}.{uuid.uuid4().hex}.part"
    if "/" in target:
        store.create_dir(target.rsplit("/", 1)[0] or "/", recursive=True)
    with store.open_output_stream(part) as out:
        out.write(data)
    try:
        store.move(part, target)
    except OSError:  # stores that don't move over a file
        store.delete_file(target)
        store.move(part, target)


def read_part(path: str, start: int, size: int) -> bytes:
    """So many bytes from a place on, fewer at the end of the file; nothing else is read."""
    store, name = located(path)
    with store.open_input_file(name) as held:
        held.seek(min(start, held.size()))
        return held.read(size)
