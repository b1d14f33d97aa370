"""TIFF and BigTIFF images and stacks: strips or tiles, LZW, Deflate, predictors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from arrayloom.errors import FormatError, UnsupportedError
from arrayloom.sources.image import ImageFile, little

# Tags, field types (struct codes) and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f", 6: "c"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
STRIP_BYTES = 256 << 10
#: Directories that are looked at or written at once, and bytes of the largest classic file that is written.
PAGES, CLASSIC = 1 << 14, 1 << 31


def score(name: str, head: bytes) -> int | None:
    return 0 if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+") and not name.endswith(".eer") else None


class Pages:
    """The pages' tags, each parsed when it is asked for; ``at`` has the places of their directories."""

    def __init__(self, data: bytes, order: str, large: bool, at: np.ndarray):
        self.data, self.order, self.large, self.at = data, order, large, at

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, k: int) -> dict[int, tuple]:
        if not 0 <= k < len(self.at):
            raise IndexError(k)
        data, order, large = self.data, self.order, self.large
        try:
            at = int(self.at[k])
            n = struct.unpack_from(order + ("Q" if large else "H"), data, at)[0]
            at += 8 if large else 2
            tags = {}
            for _ in range(n):
                tag, kind, count = struct.unpack_from(order + ("HHQ" if large else "HHI"), data, at)
                place, room = (at + 12, 8) if large else (at + 8, 4)
                if kind in TYPES:
                    code = TYPES[kind]
                    size = struct.calcsize(code) * count
                    if size > room:
                        place = struct.unpack_from(order + ("Q" if large else "I"), data, place)[0]
                    if place + size > len(data):
                        raise FormatError("a TIFF tag lies outside the file")
                    tags[tag] = (data[place : place + count].rstrip(b"\0"),) if code == "s" else struct.unpack_from(f"{order}{count}{code}", data, place)
                at += 20 if large else 12
        except struct.error as e:
            raise FormatError("the TIFF file is truncated") from e
        return tags

    def alike(self) -> bool:
        """Whether all directories are known to be the first but for the values of offsets and counts, and what lies where they point."""
        entry, head, word = (20, 8, 8) if self.large else (12, 2, 4)
        n = struct.unpack_from(self.order + ("Q" if self.large else "H"), self.data, int(self.at[0]))[0]
        size = head + n * entry
        if int(self.at.max()) + size > len(self.data):
            return False
        first = np.frombuffer(self.data, np.uint8, size, int(self.at[0]))
        same = np.ones(size, bool)
        for k in range(n):
            tag, kind, count = struct.unpack_from(self.order + ("HHQ" if self.large else "HHI"), self.data, int(self.at[0]) + head + k * entry)
            far = struct.calcsize(TYPES.get(kind, "B")) * count > word
            if far and tag in (WIDTH, HEIGHT, BITS, FORMAT, SAMPLES):
                return False
            if far or tag in (OFFSETS, COUNTS, TILE_OFFSETS, TILE_COUNTS):
                same[head + (k + 1) * entry - word : head + (k + 1) * entry] = False
        wanted, held = np.flatnonzero(same), np.frombuffer(self.data, np.uint8)
        return all((held[self.at[k : k + PAGES, None] + wanted] == first[wanted]).all() for k in range(0, len(self.at), PAGES))


def _chain(data: bytes, order: str, large: bool) -> np.ndarray:
    """Places of all directories; a run of equal ones at one distance is followed at once."""
    entry, head, word = (20, 8, "Q") if large else (12, 2, "I")
    width = struct.calcsize(word)
    link = lambda at: at + head + struct.unpack_from(order + ("Q" if large else "H"), data, at)[0] * entry
    found, seen = [], set()
    at = struct.unpack_from(order + word, data, 8 if large else 4)[0]
    held = np.frombuffer(data, np.uint8)
    while at and at not in seen:
        seen.add(at)
        found.append(at)
        size = link(at) - at
        after = struct.unpack_from(order + word, data, at + size)[0]
        step = after - at
        room = (len(data) - at - size - width) // step if step >= size + width else 0
        if room > 1 and len(found) > 1 and found[-1] - found[-2] == step:
            k = np.arange(1, min(room, PAGES) + 1, dtype=np.int64)
            places = at + k * step
            count = held[places[:, None] + np.arange(head)] == held[at : at + head]
            links = np.ascontiguousarray(held[places[:, None] + size + np.arange(width)]).view(f"{order}u{width}").ravel()
            good = count.all(axis=1) & (links == places + step)
            n = len(good) if good.all() else int(np.argmin(good))
            if n:
                found += places[:n].tolist()
                seen.update(found[-n:])
                after = int(links[n - 1])
        at = after
    return np.array(found, np.int64)


def pages(data: bytes) -> tuple[str, Pages]:
    """Byte order and the tags of all pages."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise FormatError("not a TIFF file")
    version = struct.unpack_from(order + "H", data, 2)[0]
    if version not in (42, 43):
        raise FormatError("not a TIFF file")
    try:
        at = _chain(data, order, version == 43)
    except struct.error as e:
        raise FormatError("the TIFF file is truncated") from e
    if not len(at):
        raise FormatError("a TIFF file without pages")
    return order, Pages(data, order, version == 43, at)


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first, 256 clears, 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table) or (code == len(table) and not last):
            raise FormatError("a broken LZW code")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """The inverse of ``unlzw``."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256, 9)
    table, width, now = {bytes([k]): k for k in range(256)}, 9, b""
    size = 258
    for k in data:
        longer = now + bytes([k])
        if longer in table:
            now = longer
            continue
        put(table[now], width)
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256, width)
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        now = bytes([k])
    if now:
        put(table[now], width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 0xFF)
    return bytes(out)


def _unpack(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += 2 + n
        else:
            out += data[k + 1 : k + 2] * (257 - n) if n > 128 else b""
            k += 2 if n > 128 else 1
    return bytes(out)


def _block(raw: bytes, compression: int, predictor: int, kind: np.dtype, rows: int, width: int) -> np.ndarray:
    size = rows * width * kind.itemsize
    try:
        data = {NONE: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: _unpack}[compression](raw)
    except KeyError as e:
        raise UnsupportedError(f"TIFF compression {compression}") from e
    except zlib.error as e:
        raise FormatError(f"deflate: {e}") from e
    if len(data) < size:
        raise FormatError("a TIFF block is truncated")
    data = data[:size]
    if predictor == 3:  # bytes of a row by significance, each the difference from the one before
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
        joined = planes.reshape(rows, kind.itemsize, width).transpose(0, 2, 1)
        return np.ascontiguousarray(joined).view(kind.newbyteorder(">")).reshape(rows, width).astype(kind.newbyteorder("="))
    block = np.frombuffer(data, kind).reshape(rows, width)
    if predictor == 2:
        whole = block.astype(kind.newbyteorder("=")).view(f"u{kind.itemsize}")
        return np.cumsum(whole, axis=1, dtype=whole.dtype).view(kind.newbyteorder("="))
    if predictor != 1:
        raise UnsupportedError(f"TIFF predictor {predictor}")
    return block


def read_page(data: bytes, tags: dict[int, tuple], order: str) -> np.ndarray:
    kind = element(tags, order)
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    compression, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    out = np.empty((height, width), kind.newbyteorder("="))
    if TILE_OFFSETS in tags:
        tw, th = tags[TILE_W][0], tags[TILE_H][0]
        across = -(-width // tw)
        for k, (at, n) in enumerate(zip(tags[TILE_OFFSETS], tags[TILE_COUNTS], strict=True)):
            y, x = k // across * th, k % across * tw
            if y < height:
                out[y : y + th, x : x + tw] = _block(data[at : at + n], compression, predictor, kind, th, tw)[: height - y, : width - x]
        return out
    step = min(tags.get(ROWS, (height,))[0], height) or height
    for k, (at, n) in enumerate(zip(tags[OFFSETS], tags[COUNTS], strict=True)):
        rows = min(step, height - k * step)
        out[k * step : k * step + rows] = _block(data[at : at + n], compression, predictor, kind, rows, width)
    return out


def element(tags: dict[int, tuple], order: str) -> np.dtype:
    if tags.get(SAMPLES, (1,))[0] != 1:
        raise UnsupportedError("several samples a pixel")
    bits, kind = tags.get(BITS, (1,))[0], KINDS.get(tags.get(FORMAT, (1,))[0])
    if bits not in {"u": (8, 16, 32, 64), "i": (8, 16, 32, 64), "f": (16, 32, 64), "c": (64, 128)}.get(kind, ()):
        raise UnsupportedError(f"TIFF samples of {bits} bits")
    return np.dtype(f"{order}{kind}{bits // 8}")


def open_tiff(name: str, data: bytes) -> ImageFile:
    order, found = pages(data)
    shapes = {(t.get(HEIGHT), t.get(WIDTH), element(t, order)) for t in ([found[0]] if found.alike() else found)}
    if len(shapes) != 1:
        raise UnsupportedError("pages of different shapes or types")
    (height,), (width,), kind = shapes.pop()
    n = len(found)
    dtype = {"c8": "complex_float32", "c16": "complex_float64"}.get(kind.str[1:], kind.name)

    def load(index: int | None) -> np.ndarray:
        if index is None and n > 1:
            return little(np.stack([read_page(data, t, order) for t in found]))
        return little(read_page(data, found[index or 0], order))

    return ImageFile("tiff", (height, width) if n == 1 else (n, height, width), 2, dtype, load)


def strips(shape: tuple[int, int], dtype: np.dtype) -> int:
    """Rows of a strip."""
    return max(1, min(shape[0], STRIP_BYTES // (shape[1] * dtype.itemsize)))


def packed(images: np.ndarray) -> Iterator[bytes]:
    """The LZW strips of images (leading axis), one after the other."""
    rows = strips(images.shape[1:], images.dtype)
    for page in little(images):
        for y in range(0, len(page), rows):
            yield lzw(page[y : y + rows].tobytes())


def check(shape: tuple[int, ...], dtype: np.dtype, core_rank: int) -> None:
    if core_rank != 2 or len(shape) not in (2, 3) or 0 in shape or (len(shape) == 3 and shape[0] == 1):
        raise UnsupportedError("TIFF files hold an image or a stack of several")
    if dtype.kind not in "uifc":
        raise UnsupportedError(f"TIFF files hold no {dtype}")


def frame(shape: tuple[int, ...], dtype: np.dtype, counts: np.ndarray | None = None) -> tuple[bytes, Iterator[bytes]]:
    """What a file has before its strips, which lie close together, and the directories behind them.

    ``counts``: the bytes of each strip packed by LZW; None for plain ones.
    """
    pages, (height, width) = shape[0] if len(shape) == 3 else 1, shape[-2:]
    rows = strips((height, width), dtype)
    each = -(-height // rows)
    if counts is None:
        line = width * dtype.itemsize
        counts = np.tile([line * rows] * (each - 1) + [line * (height - (each - 1) * rows)], pages)
    counts = np.asarray(counts, np.int64)
    size = int(counts.sum())
    large = size + pages * (256 + 16 * each) > CLASSIC
    word, short, room = ("Q", 16, 8) if large else ("I", 4, 4)
    unit = struct.calcsize(word)
    begin = 16 if large else 8
    at = begin + size + -(begin + size) % 8
    offsets = begin + np.concatenate([[0], np.cumsum(counts)[:-1]])
    far = 2 * each * unit if each > 1 else 0
    tags = {WIDTH: (4, width), HEIGHT: (4, height), BITS: (3, 8 * dtype.itemsize), COMPRESSION: (3, NONE if dtype.kind in "fc" else LZW), PHOTOMETRIC: (3, 1), OFFSETS: (short, None), SAMPLES: (3, 1), ROWS: (4, rows), COUNTS: (short, None), FORMAT: (3, {"u": 1, "i": 2, "f": 3, "c": 6}[dtype.kind])}
    model, places = struct.pack("<" + ("Q" if large else "H"), len(tags)), {}
    for tag, (t, value) in sorted(tags.items()):
        raw = bytes(room) if value is None else struct.pack("<" + TYPES[t], value)
        places[tag] = far + len(model) + 4 + unit
        model += struct.pack("<HH" + word, tag, t, each if value is None else 1) + raw.ljust(room, b"\0")
    link, step = far + len(model), far + len(model) + room
    step += -step % 8
    model = np.frombuffer((bytes(far) + model).ljust(step, b"\0"), np.uint8)

    def directories() -> Iterator[bytes]:
        yield bytes(at - begin - size)
        for p in range(0, pages, PAGES):
            n = min(PAGES, pages - p)
            out = np.tile(model, (n, 1))
            begins = at + (p + np.arange(n, dtype=np.int64)) * step
            put = lambda place, values: out.__setitem__((slice(None), slice(place, place + values.shape[1] * unit)), np.ascontiguousarray(values, f"<u{unit}").view(np.uint8).reshape(n, -1))
            for k, (tag, values) in enumerate(((OFFSETS, offsets), (COUNTS, counts))):
                own = values[p * each : (p + n) * each].reshape(n, each)
                if far:
                    put(k * each * unit, own)
                    own = begins[:, None] + k * each * unit
                put(places[tag], own)
            put(link, np.where(p + np.arange(n) + 1 < pages, begins + step + far, 0)[:, None])
            yield out.tobytes()

    return (b"II+\0\x08\0\0\0" if large else b"II*\0") + struct.pack("<" + word, at + far), directories()


def write_tiff(array: np.ndarray, core_rank: int) -> bytes:
    """An image or a stack of several: integers by LZW, other types plain; BigTIFF for large arrays."""
    check(array.shape, array.dtype, core_rank)
    many = little(array).reshape(-1, *array.shape[-2:])
    if array.dtype.kind not in "ui":
        head, directories = frame(array.shape, array.dtype)
        return b"".join([head, many.tobytes(), *directories])
    every = list(packed(many))
    head, directories = frame(array.shape, array.dtype, np.array([len(e) for e in every]))
    return b"".join([head, *every, *directories])


def file_of(pages: list[tuple[dict[int, int], bytes]]) -> bytes:
    """A classic file of pages with plain tags and one strip each."""
    out = bytearray(b"II*\0" + bytes(4))
    link = 4
    for tags, strip in pages:
        every = {**tags, OFFSETS: len(out), COUNTS: len(strip)}
        out += strip + bytes(-len(strip) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(every)) + b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in sorted(every.items()))
        link = len(out)
        out += bytes(4)
    return bytes(out)
