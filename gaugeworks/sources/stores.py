"""Folders and files by path, in any store that pyarrow opens."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyarrow import fs

#: Fixed value: bytes at a file's start, and before an offset, that its fingerprint covers.
SAMPLE = 65_536


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path's name in it; without a scheme it is local."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over an entry of that name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def files_below(uri: str, own: int = 0, shares: int = 1) -> Iterator[tuple[str, int, int]]:
    """(path, modified in ms, length) of the files below a folder: of its entries those whose
    name's checksum leaves `own` when divided by `shares`. One folder's entries are held."""
    store, top = opened(uri)
    scheme = "file:" if isinstance(store, fs.LocalFileSystem) else uri.rstrip("/").removesuffix(top.rstrip("/"))
    found = store.get_file_info(fs.FileSelector(top))
    held = [x for x in found if zlib.crc32(x.base_name.encode()) % shares == own]
    while held:
        x = held.pop()
        if _hidden(x.base_name):
            continue
        if x.type == fs.FileType.Directory:
            held += store.get_file_info(fs.FileSelector(x.path))
        elif x.type == fs.FileType.File:
            yield scheme + x.path, x.mtime_ns // 1_000_000, x.size


def exists(uri: str) -> bool:
    store, name = opened(uri)
    return store.get_file_info(name).type != fs.FileType.NotFound


def remove_folder(uri: str) -> None:
    """Removes a folder with all in it; none is no error."""
    store, name = opened(uri)
    if store.get_file_info(name).type == fs.FileType.Directory:
        store.delete_dir(name)


def replace_text(uri: str, text: str) -> None:
    """Writes a small file whole: beside its place first, then moved there."""
    store, name = opened(uri)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{name}.new") as f:
        f.write(text.encode())
    store.move(f"{name}.new", name)


def text_of(uri: str) -> str | None:
    store, name = opened(uri)
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with store.open_input_file(name) as f:
        return f.read().decode()


def fingerprint(f, offset: int) -> str:
    """SHA-256 of the first 64 KiB before an offset and of the last, where they don't overlap."""
    f.seek(0)
    head = f.read(min(offset, SAMPLE))
    start = max(SAMPLE, offset - SAMPLE)
    f.seek(start if offset > SAMPLE else 0)
    return hashlib.sha256(head + (f.read(offset - start) if offset > SAMPLE else b"")).hexdigest()
