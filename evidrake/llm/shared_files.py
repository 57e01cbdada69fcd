"""Raw files in the shared folder, written by tasks: a private name first, then one rename to the final name.

A retried or speculative task writes the same bytes to the same final name, so lost executors do no harm.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))


def make_dir(uri: str) -> None:
    system, path = _at(uri)
    system.create_dir(path, recursive=True)


def write_file(folder: str, name: str, data: bytes) -> None:
    system, path = _at(folder)
    private = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(private) as out:
        out.write(data)
    system.move(private, f"{path}/{name}")


def open_file(folder: str, name: str):
    """A seekable handle."""
    system, path = _at(folder)
    return system.open_input_file(f"{path}/{name}")
