"""Byte ranges of files, for Python data sources. Paths are those of a store that pyarrow opens: local or mounted
folders, file:, hdfs:, s3:, gs:. Only sizes and headers are looked at on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The path's file system, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def size_of(path: str) -> int:
    store, inside = opened(path)
    found = store.get_file_info(inside)
    if found.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return found.size


def read_range(path: str, start: int, end: int) -> bytes:
    store, inside = opened(path)
    with store.open_input_file(inside) as file:
        return file.read_at(max(0, end - start), start)


def files_below(folder: str) -> list[str]:
    """All files below a folder, by name, as paths of the same form."""
    store, inside = opened(folder)
    found = store.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
    names = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    head = folder[: len(folder) - len(inside)] if folder.endswith(inside) else ""
    return [head + n for n in names]


def ranges(sizes: Sequence[tuple[str, int]], most: int) -> Iterator[tuple[str, int, int]]:
    """(path, start, end): each file in parts of at most so many bytes."""
    for path, size in sizes:
        n = max(1, -(-size // most))
        for k in range(n):
            yield path, size * k // n, size * (k + 1) // n
