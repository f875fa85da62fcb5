"""Binary files in the shared folder, written and read by tasks.

A task gives every file a name of its own, and returns it. Only names that Spark has
committed to a manifest table are read, so a task that is lost and run again leaves
at most files that nobody reads.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def _resolved(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, suffix: str, parts: list[bytes]) -> str:
    """Write ``parts`` in order to a new file of ``folder``; its name."""
    fs, path = _resolved(folder)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with fs.open_output_stream(f"{path}/{name}") as out:
        for part in parts:
            out.write(part)
    return name


def read_file(folder: str, name: str) -> bytes:
    fs, path = _resolved(folder)
    with fs.open_input_stream(f"{path}/{name}") as source:
        return source.read()
