"""Files of an operator's own format in the shared folder, opened by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def write(uri: str, content: bytes) -> None:
    store, path = opened(uri)
    with store.open_output_stream(path, compression=None) as f:
        f.write(content)


def read(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        return f.read()


def read_range(uri: str, offset: int, length: int) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def attempt_name(folder: str, ending: str) -> str:
    """A name that no other attempt of a task uses; only names that a finished task has returned count."""
    return f"{folder}/{uuid.uuid4().hex}{ending}"
