"""MRC images, stacks and volumes, plain or gzipped."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

from arrayloom.errors import FormatError, UnsupportedError
from arrayloom.sources.image import ImageFile, little

# Layout of the 1024-byte header and codes in it.
HEADER = 1024
MODES = {0: "i1", 1: "i2", 2: "f4", 4: "c8", 6: "u2", 12: "f2"}
NAMES = {"i1": "int8", "u1": "uint8", "i2": "int16", "f4": "float32", "c8": "complex_float32", "u2": "uint16", "f2": "float16"}
STAMPS = {b"\x44\x44": "<", b"\x44\x41": "<", b"\x11\x11": ">"}
IMOD_STAMP = 1146047817
VOLUME_STACKS = range(401, 631)
#: Bytes of a gzip file that are inflated at once.
PART = 1 << 16
#: Bytes read onward that are kept before they are dropped.
KEPT = 1 << 22
#: Bytes of a block of a gzip file that can be entered at each block, and what a member begins with up to its length.
BLOCK, MEMBER = 65280, b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
#: The empty member behind the last.
END = MEMBER + b"\x1b\0\x03\0" + bytes(8)
EXTENSIONS = (".mrc", ".mrcs", ".map", ".st", ".rec", ".ali")


def score(name: str, head: bytes) -> int | None:
    if head[208:211] == b"MAP":
        return 0
    return -1024 if name.endswith(EXTENSIONS) and len(head) >= HEADER else None


def byte_order(head: bytes) -> str:
    """As the stamp says, if the mode makes sense that way; else the first order in which it does."""
    stated = STAMPS.get(bytes(head[212:214]))
    for order in dict.fromkeys([*([stated] if stated else []), "<", ">"]):
        if struct.unpack_from(order + "i", head, 12)[0] in MODES:
            return order
    raise FormatError("no byte order gives a known mode")


def open_mrc(name: str, data: bytes, part: Callable[[int, int, bool], bytes] | None = None) -> ImageFile:
    """``name`` decides between one image and a stack of one.

    ``part(first, size, onward)`` gives those bytes, or those there are, where ``data`` is the header alone; ``onward``
    says that what lies before won't be asked for.
    """
    if len(data) < HEADER or data[208:211] != b"MAP":
        raise FormatError("not an MRC header")
    order = byte_order(data)
    at = lambda offset, n=1: struct.unpack_from(f"{order}{n}i", data, offset)
    (nx, ny, nz, mode), (group, extended), axes = at(0, 4), at(88, 2), at(64, 3)
    if mode not in MODES:
        raise UnsupportedError(f"MRC mode {mode}")
    code = MODES[mode]
    if mode == 0 and at(152)[0] == IMOD_STAMP and not at(156)[0] & 1:
        code = "u1"
    if min(nx, ny, nz) < 0 or extended < 0:
        raise FormatError("negative counts in an MRC header")
    if group in VOLUME_STACKS:
        depth = at(36)[0]
        if depth <= 0 or nz % depth:
            raise FormatError("sections don't make whole volumes")
        extents, core = (nz // depth, depth, ny, nx), 3
    elif group == 0:
        extents, core = ((ny, nx), 2) if nz == 1 and not name.endswith(".mrcs") else ((nz, ny, nx), 2)
    else:
        extents, core = (nz, ny, nx), 3
    kind, begin = np.dtype(order + code), HEADER + extended
    values = int(np.prod(extents, dtype=np.int64))
    lead = len(extents) - core
    # file axes, slowest first, and where z, y, x lie among them
    if axes == (0, 0, 0):
        axes = (1, 2, 3)
    stored = [axes[k] for k in reversed(range(3))][-core:]
    if sorted(axes) != [1, 2, 3]:
        raise FormatError("the axes aren't those of space, one each")
    turn = [*range(lead), *(lead + stored.index(s) for s in (3, 2, 1) if s in stored)]

    def values_of(first: int, size: int, onward: bool = False) -> np.ndarray:
        first, held = begin + first * kind.itemsize, data
        if part:
            held, first = part(first, size * kind.itemsize, onward), 0
        if first + size * kind.itemsize > len(held):
            raise FormatError("the MRC file is truncated")
        return np.frombuffer(held, kind, size, first)

    def load(index: int | None) -> np.ndarray:
        size = values if index is None else values // extents[0]
        array = values_of(0 if index is None else index * size, size).reshape(extents if index is None else extents[1:])
        return little(array.transpose(turn if index is None else [t - lead for t in turn[lead:]]))

    def several(first: int, end: int) -> np.ndarray:
        size = values // extents[0]
        return little(values_of(first * size, (end - first) * size, True).reshape(end - first, *extents[1:]).transpose(turn))

    return ImageFile("mrc", tuple(extents[t] for t in turn), core, NAMES[code], load, several if lead else None)


class Inflated:
    """What a gzip file holds, inflated as far as it is asked for; members may follow one another."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self._rewind()

    def _rewind(self) -> None:
        self.rest, self.out, self.member, self.dropped = self.data, bytearray(), zlib.decompressobj(31), 0

    def _reach(self, n: int) -> None:
        while self.dropped + len(self.out) < n and len(self.rest):
            try:
                self.out += self.member.decompress(self.rest[:PART])
            except zlib.error as e:
                if not self.out and not self.dropped:
                    raise FormatError(f"gzip: {e}") from e
                self.rest = self.rest[:0]  # what follows the last member isn't one
                break
            left = len(self.member.unused_data)
            self.rest = self.rest[min(PART, len(self.rest)) - left :]
            if self.member.eof:
                self.member = zlib.decompressobj(31)

    def upto(self, n: int) -> bytes:
        """The first n bytes, or all there are."""
        return self.part(0, n)

    def part(self, first: int, size: int, onward: bool = False) -> bytes:
        """``size`` bytes from ``first`` on, or those there are; with ``onward`` the bytes before are dropped, to be inflated anew if asked for."""
        if first < self.dropped:
            self._rewind()
        if onward:  # long gaps are dropped as they are passed
            while self.dropped + len(self.out) < first and len(self.rest):
                self._reach(min(first, self.dropped + len(self.out) + KEPT))
                self._drop(first)
        self._reach(first + size)
        held = bytes(memoryview(self.out)[max(first - self.dropped, 0) : max(first + size - self.dropped, 0)])
        if onward:
            self._drop(first + size)
        return held

    def _drop(self, upto: int) -> None:
        n = min(upto - self.dropped, len(self.out))
        if n >= KEPT:
            del self.out[:n]
            self.dropped += n


def packed_blocks(raw: bytes) -> bytes:
    """Bytes as gzip members of one block each that say how long they are (an extra field ``BC``, as in BGZF)."""
    out = bytearray()
    for k in range(0, len(raw), BLOCK):
        piece = raw[k : k + BLOCK]
        packer = zlib.compressobj(9, zlib.DEFLATED, -15)
        body = packer.compress(piece) + packer.flush()
        out += MEMBER + struct.pack("<H", len(MEMBER) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(piece), len(piece))
    return bytes(out)


class Blocks:
    """A gzip file all of whose members say how long they are: any stretch is inflated from the members that hold it."""

    def __init__(self, data: bytes, places: np.ndarray, begins: np.ndarray):
        self.data, self.places, self.begins = data, places, begins
        self.last: tuple[int, bytes] = (-1, b"")

    @classmethod
    def of(cls, data: bytes) -> Blocks | None:
        """The members found by their lengths, None if one doesn't say its own."""
        at, places, sizes = 0, [0], []
        while at < len(data):
            if data[at : at + len(MEMBER)] != MEMBER or at + len(MEMBER) + 2 > len(data):
                return None
            at += struct.unpack_from("<H", data, at + len(MEMBER))[0] + 1
            if at > len(data):
                return None
            places.append(at)
            sizes.append(struct.unpack_from("<I", data, at - 4)[0])
        return cls(data, np.array(places), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])) if sizes else None

    def _block(self, k: int) -> bytes:
        if self.last[0] != k:
            try:
                self.last = (k, zlib.decompress(self.data[self.places[k] : self.places[k + 1]], 31))
            except zlib.error as e:
                raise FormatError(f"gzip: {e}") from e
        return self.last[1]

    def part(self, first: int, size: int, onward: bool = False) -> bytes:
        end = min(first + size, int(self.begins[-1]))
        if first >= end:
            return b""
        low = int(np.searchsorted(self.begins, first, "right")) - 1
        high = int(np.searchsorted(self.begins, end, "left"))
        held = b"".join(self._block(k) for k in range(low, high))
        return held[first - int(self.begins[low]) : end - int(self.begins[low])]


def open_gzip(name: str, data: bytes) -> ImageFile:
    """A gzipped MRC file; what follows the last value that is read isn't looked at."""
    blocks = Blocks.of(data)
    held = blocks or Inflated(data)
    image = open_mrc(name.removesuffix(".gz"), held.part(0, HEADER), held.part)
    image.format, image.single_pass = "mrc.gz", blocks is None
    return image


def write_mrc(name: str, array: np.ndarray, core_rank: int) -> bytes:
    """The file of an array of rank 2 to 4; refused if it would be read back with another shape."""
    return header(name, array.shape, array.dtype, core_rank) + little(array).tobytes()


def header(name: str, shape: tuple[int, ...], dtype: np.dtype, core_rank: int) -> bytes:
    """What a file has before its values."""
    code = {v: k for k, v in NAMES.items()}.get({"bool": ""}.get(dtype.name, dtype.name).replace("complex64", "complex_float32"))
    if code in (None, "u1") or not name.endswith((".mrc", ".mrcs", ".map")):
        raise UnsupportedError(f"MRC files hold no {dtype} in {name!r}")
    rank = len(shape)
    if not 2 <= rank <= 4 or (rank, core_rank) not in ((2, 2), (3, 2), (3, 3), (4, 3)):
        raise UnsupportedError("MRC files hold images, volumes or stacks of them")
    if (rank == 2 and name.endswith(".mrcs")) or (rank == 3 and core_rank == 2 and shape[0] == 1 and not name.endswith(".mrcs")):
        raise UnsupportedError("it would be read back with another shape")
    nx, ny = shape[-1], shape[-2]
    nz = int(np.prod(shape[:-2], dtype=np.int64))
    mz = shape[1] if rank == 4 else nz if core_rank == 3 else 1
    head = bytearray(HEADER)
    struct.pack_into("<4i", head, 0, nx, ny, nz, {v: k for k, v in MODES.items()}[code])
    struct.pack_into("<3i", head, 28, nx, ny, mz)
    struct.pack_into("<3f3f", head, 40, nx, ny, mz, 90, 90, 90)
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    struct.pack_into("<3f", head, 76, 0, -1, -2)
    struct.pack_into("<i", head, 88, 0 if core_rank == 2 else 401 if rank == 4 else 1)
    struct.pack_into("<i", head, 108, 20141)
    head[208:216] = b"MAP \x44\x44\x00\x00"
    struct.pack_into("<f", head, 216, -1)
    return bytes(head)
