"""Binary files in the shared folder, written and read by tasks through Arrow's file systems.

A task writes under a name of its own and moves the file when it is whole, so a task that is repeated or runs twice
leaves the same file. A path without a scheme or with file: is opened as a memory map for reading.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


@contextmanager
def whole_file(uri: str) -> Iterator[pa.NativeFile]:
    """A file to write, which stands under its name once the block ends without an error."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(own, compression=None) as out:
            yield out
        system.move(own, path)
    except BaseException:
        if system.get_file_info(own).type == fs.FileType.File:
            system.delete_file(own)
        raise


def open_map(uri: str) -> pa.NativeFile:
    """A file for reading at any offset; mapped into memory where it is local."""
    system, path = fs.FileSystem.from_uri(uri)
    return pa.memory_map(path, "r") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
