"""Binary files in the shared folder, written and read inside tasks.

A task's file has a name of its own for each attempt, and only names that finished tasks return are read, so a lost
executor or a second attempt leaves at most an unused file behind.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as URI or plain path."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def new_file(folder: str, suffix: str) -> tuple[fs.FileSystem, str]:
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    return system, f"{path.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def read_range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)
