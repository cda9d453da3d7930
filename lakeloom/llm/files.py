"""Files that tasks write to and read from shared storage, by URI."""

from __future__ import annotations

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (or of an absolute path) and the path in it."""
    return fs.FileSystem.from_uri(uri)


def delete(uri: str) -> None:
    """Delete a folder with what is in it; nothing happens where there is none."""
    system, path = place(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def make_folder(uri: str) -> None:
    system, path = place(uri)
    system.create_dir(path, recursive=True)
