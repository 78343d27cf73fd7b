"""Binary files in the shared folder, written and read by executors.

A writer goes to a name of its own and is moved to its final name once complete; a repeated task writes another
file, and only the file that the successful task reports is ever read.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a uri: file:, hdfs:, s3:, gs: or a plain absolute path."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if re.match(r"file:/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def new_file(folder: str, stem: str) -> Iterator[tuple[object, str]]:
    """(stream, name): the file `name` appears in the folder when the block ends without an error."""
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    hidden = f"{path}/.{name}.part"
    stream = system.open_output_stream(hidden, compression=None)
    try:
        yield stream, name
        stream.close()
        system.move(hidden, f"{path}/{name}")
    except BaseException:
        with contextlib.suppress(Exception):
            stream.close()
            system.delete_file(hidden)
        raise


def open_file(folder: str, name: str):
    """A seekable reader of a file that new_file wrote."""
    system, path = open_fs(folder)
    return system.open_input_file(f"{path}/{name}")
