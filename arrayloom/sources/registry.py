"""Choosing a format by probing, and formats registered at run time."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from arrayloom.errors import ImageFileError, UnsupportedError
from arrayloom.sources import dm, eer, mrc, tiff, zarr
from arrayloom.sources.image import ImageFile

#: Suitabilities: the highest wins, of equals the format registered first.
FALLBACK, NORMAL, OPTIMAL = -1024, 0, 1024
LEADING = 4096


@dataclass(frozen=True)
class Probe:
    """What is known of a path before it is opened; ``name`` is in lower case, without separators at its end."""

    path: str
    name: str
    head: bytes
    exists: bool
    is_directory: bool

    @classmethod
    def of(cls, path: str, data: bytes | None = None) -> Probe:
        plain = path.rstrip("/") or path
        if data is not None:
            return cls(path, plain.lower(), data[:LEADING], True, False)
        is_directory, head = os.path.isdir(plain), b""
        if os.path.isfile(plain):
            with open(plain, "rb") as f:
                head = f.read(LEADING)
        return cls(path, plain.lower(), head, os.path.exists(plain), is_directory)


@dataclass(frozen=True)
class Format:
    """``score(probe)`` is a suitability or None; ``open(path, data)`` gets the bytes of a file, None for a directory."""

    name: str
    score: Callable[[Probe], int | None]
    open: Callable[[str, bytes | None], ImageFile]


def _plain(probe: Probe) -> bytes:
    return b"" if probe.is_directory else probe.head


def _gzip_score(probe: Probe) -> int | None:
    if probe.head[:2] != b"\x1f\x8b":
        return None
    import zlib

    try:
        head = zlib.decompressobj(31).decompress(probe.head, 1024)
    except zlib.error:
        return None
    return mrc.score(probe.name.removesuffix(".gz"), head)


FORMATS: list[Format] = [
    Format("mrc", lambda p: mrc.score(p.name, _plain(p)), lambda path, data: mrc.open_mrc(path.lower(), data)),
    Format("mrc.gz", _gzip_score, lambda path, data: mrc.open_gzip(path.lower(), data)),
    Format("tiff", lambda p: tiff.score(p.name, _plain(p)), tiff.open_tiff),
    Format("dm", lambda p: dm.score(p.name, _plain(p)), dm.open_dm),
    Format("zarr", lambda p: zarr.score(p.path) if p.is_directory else None, lambda path, data: zarr.open_zarr(path)),
]


def register(fmt: Format) -> None:
    """Add a format, behind those there are."""
    FORMATS.append(fmt)


def select(probe: Probe) -> Format:
    return _best(FORMATS, probe, "no format reads it")


def contents(path: str):
    """A file's bytes, mapped: only the pages that are looked at are read, so a header costs a header."""
    import mmap

    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""


def open_image(path: str, data: bytes | None = None) -> ImageFile:
    """An image file by its path (read as far as it is asked for), or by its path and bytes that were read otherwise."""
    probe = Probe.of(path, data)
    fmt = select(probe)
    return fmt.open(path, contents(path) if data is None and not probe.is_directory else data)


@dataclass(frozen=True)
class TimelineFormat:
    """``score(probe)`` is a suitability or None; ``open(path, data)`` gives a timeline: pages, height, width, h, v, frame(t)."""

    name: str
    score: Callable[[Probe], int | None]
    open: Callable[[str, bytes], eer.Timeline]


TIMELINES: list[TimelineFormat] = [TimelineFormat("eer", lambda p: eer.score(p.name, _plain(p)), eer.Timeline)]


def register_timeline(fmt: TimelineFormat) -> None:
    """Add a format of event timelines, behind those there are."""
    TIMELINES.append(fmt)


def _best(formats: list, probe: Probe, error: str):
    scored = [(s, -k, f) for k, f in enumerate(formats) if (s := f.score(probe)) is not None]
    if not scored:
        raise (UnsupportedError if probe.exists else ImageFileError)(f"{probe.path}: {error if probe.exists else 'it is not there'}")
    return max(scored, key=lambda x: x[:2])[2]


def open_timeline(path: str, data: bytes | None = None) -> eer.Timeline:
    return _best(TIMELINES, Probe.of(path, data), "no format reads it as an event timeline").open(path, contents(path) if data is None else data)


@dataclass(frozen=True)
class WriteFormat:
    """``score(name)`` is a suitability or None for a name in lower case; ``write(path, array, core_rank)`` makes the whole file."""

    name: str
    score: Callable[[str], int | None]
    write: Callable[[str, object, int], None]


def _by_bytes(encode: Callable[[str, object, int], bytes]) -> Callable[[str, object, int], None]:
    """Writes the bytes beside the path and renames them into place."""

    def write(path: str, array, core_rank: int) -> None:
        import uuid

        data = encode(path.lower(), array, core_rank)
        beside = f"{path}.{uuid.uuid4().hex}"
        with open(beside, "wb") as f:
            f.write(data)
        os.replace(beside, path)

    return write


def _ends(*endings: str) -> Callable[[str], int | None]:
    return lambda name: NORMAL if name.endswith(endings) else None


WRITERS: list[WriteFormat] = [
    WriteFormat("zarr", _ends(".zarr"), zarr.write_zarr),
    WriteFormat("mrc", _ends(".mrc", ".mrcs", ".map"), _by_bytes(mrc.write_mrc)),
    WriteFormat("tiff", _ends(".tif", ".tiff"), _by_bytes(lambda name, array, core_rank: tiff.write_tiff(array, core_rank))),
]


def register_writer(fmt: WriteFormat) -> None:
    """Add a format that writes, behind those there are."""
    WRITERS.append(fmt)


def write_image(path: str, array, core_rank: int) -> None:
    """A file of the format that its name asks for."""
    chosen_writer(path).write(path, array, core_rank)


def chosen_writer(path: str) -> WriteFormat:
    name = path.rstrip("/").lower()
    scored = [(s, -k, f) for k, f in enumerate(WRITERS) if (s := f.score(name)) is not None]
    if not scored:
        raise UnsupportedError(f"{path}: no format writes it")
    return max(scored, key=lambda x: x[:2])[2]


def copied(path: str, head: bytes, pieces: list[str], tail=()) -> str:
    """A file beside ``path`` of ``head``, the pieces' bytes and what ``tail`` gives."""
    import shutil
    import uuid

    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as out:
        out.write(head)
        for piece in pieces:
            with open(piece, "rb") as f:
                shutil.copyfileobj(f, out, 4 << 20)
        for more in tail:
            out.write(more)
    return beside


def write_pieces(path: str, shape: tuple[int, ...], dtype, core_rank: int, pieces: list[str], strips: list[int] | None = None) -> None:
    """A file of the format that its name asks for, of raw values that lie in ``pieces`` one behind the other.

    MRC and plain TIFF files are the pieces' bytes behind a header; ``strips`` has the sizes where they are packed for
    TIFF already. Other formats map the values and are written as ``write_image`` does.
    """
    import numpy as np

    dtype, name = np.dtype(dtype).newbyteorder("="), path.rstrip("/").lower()
    chosen = chosen_writer(path)
    if chosen.name == "mrc":
        os.replace(copied(path, mrc.header(name, shape, dtype, core_rank), pieces), path)
    elif chosen.name == "tiff" and (strips is not None or dtype.kind in "fc"):
        tiff.check(shape, dtype, core_rank)
        head, directories = tiff.frame(shape, dtype, strips)
        os.replace(copied(path, head, pieces, directories), path)
    else:
        raw = copied(path, b"", pieces)
        try:
            empty = not os.path.getsize(raw)
            chosen.write(path, np.zeros(shape, dtype) if empty else np.memmap(raw, dtype.newbyteorder("<"), "r", 0, shape), core_rank)
        finally:
            os.remove(raw)
