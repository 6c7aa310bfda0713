"""Files that tasks write into the shared folder: temporary name first, then one rename."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs) and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri.removeprefix("file:")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write_whole(store: fs.FileSystem, path: str, write) -> None:
    """`write(stream)` into a temporary file that becomes `path` when it is complete.

    A retried or doubled task writes the same bytes under another temporary name, so whichever
    attempt renames last leaves the same file.
    """
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}-{name}"
    with store.open_output_stream(draft) as stream:
        write(stream)
    if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(draft, path)


def write_json(uri: str, value) -> None:
    store, path = open_store(uri)
    write_whole(store, path, lambda stream: stream.write(json.dumps(value, sort_keys=True).encode()))


def read_json(uri: str):
    store, path = open_store(uri)
    with store.open_input_stream(path) as stream:
        return json.loads(stream.read())
