"""DigitalMicrograph 3 and 4 images and stacks: a big-endian tree of tags around values in either order."""

from __future__ import annotations

import struct

import numpy as np

from arrayloom.errors import FormatError, UnsupportedError
from arrayloom.sources.image import ImageFile, little

# Scalar codes of tags, data types of images.
SCALARS = {2: "h", 3: "i", 4: "H", 5: "I", 6: "f", 7: "d", 8: "?", 9: "b", 10: "b", 11: "q", 12: "Q"}
IMAGES = {1: "i2", 2: "f4", 3: "c8", 6: "u1", 7: "i4", 9: "i1", 10: "u2", 11: "u4", 12: "f8", 13: "c16", 14: "?", 39: "i8", 40: "u8"}
GROUP, DATUM, DEEPEST = 20, 21, 64


def score(name: str, head: bytes) -> int | None:
    if not name.endswith((".dm3", ".dm4")) or len(head) < 16:
        return None
    return 0 if struct.unpack_from(">I", head)[0] in (3, 4) else None


class _Tags:
    """A walk over the tag tree; a datum becomes (encoding, offset)."""

    def __init__(self, data: bytes):
        self.data, self.wide = data, struct.unpack_from(">I", data)[0] == 4
        self.at = 16 if self.wide else 12
        self.order = "<" if struct.unpack_from(">I", data, self.at - 4)[0] else ">"

    def take(self, code: str) -> int:
        value = struct.unpack_from(">" + code, self.data, self.at)[0]
        self.at += struct.calcsize(code)
        return value

    def word(self) -> int:
        return self.take("Q" if self.wide else "I")

    def group(self, depth: int = 1) -> list:
        if depth > DEEPEST:
            raise FormatError("tags are nested too deep")
        self.at += 2
        out = []
        for _ in range(self.word()):
            kind, size = self.take("B"), self.take("H")
            label = self.data[self.at : self.at + size].decode("latin-1")
            self.at += size + (8 if self.wide else 0)
            if kind == GROUP:
                out.append((label, self.group(depth + 1)))
            elif kind == DATUM:
                out.append((label, self.datum()))
            else:
                raise FormatError(f"a tag of kind {kind}")
        return out

    def datum(self) -> tuple[list[int], int]:
        if self.data[self.at : self.at + 4] != b"%%%%":
            raise FormatError("a datum lacks its delimiter")
        self.at += 4
        n = self.word()
        if n > len(self.data):
            raise FormatError("the file is truncated")
        encoding = [self.word() for _ in range(n)]
        begin = self.at
        self.at += self.size(encoding, 0)[0]
        if self.at > len(self.data):
            raise FormatError("the file is truncated")
        return encoding, begin

    def size(self, encoding: list[int], k: int, depth: int = 0) -> tuple[int, int]:
        """Bytes of the value that the encoding describes from word k on, and the word behind it."""
        if depth > 8 or k >= len(encoding):
            raise FormatError("a broken encoding")
        kind = encoding[k]
        if kind in SCALARS:
            return struct.calcsize(SCALARS[kind]), k + 1
        if kind == 18:
            return 2 * encoding[k + 1], k + 2
        if kind == 15:
            total, fields, k = 0, encoding[k + 2], k + 3
            for _ in range(fields):
                n, k = self.size(encoding, k + 1, depth + 1)
                total += n
            return total, k
        if kind == 20:
            n, k = self.size(encoding, k + 1, depth + 1)
            return n * encoding[k], k + 1
        raise FormatError(f"a value of kind {kind}")

    def number(self, datum: tuple[list[int], int]) -> int:
        encoding, begin = datum
        if encoding[0] not in SCALARS:
            raise FormatError("a number was expected")
        return int(struct.unpack_from(self.order + SCALARS[encoding[0]], self.data, begin)[0])


def _child(group: list, label: str, default=None):
    return next((v for k, v in group if k == label), default)


def open_dm(name: str, data: bytes) -> ImageFile:
    try:
        tags = _Tags(data)
        root = tags.group()
        thumbs = {tags.number(_child(t, "ImageIndex")) for _, t in _child(root, "Thumbnails", []) if isinstance(t, list) and _child(t, "ImageIndex")}
        images = _child(root, "ImageList") or []
        image = next((v for k, (_, v) in enumerate(images) if isinstance(v, list) and k not in thumbs), None)
        held = _child(image or [], "ImageData")
        if held is None:
            raise FormatError("no image but thumbnails")
        extents = tuple(tags.number(v) for _, v in _child(held, "Dimensions", []))[::-1]
        code = IMAGES.get(tags.number(_child(held, "DataType")))
        encoding, begin = _child(held, "Data")
    except (struct.error, TypeError, IndexError) as e:
        raise FormatError("a broken tag tree") from e
    if code is None:
        raise UnsupportedError("a packed or coloured image")
    if len(extents) not in (2, 3) or min(extents) < 1:
        raise UnsupportedError("an image of other than two or three axes")
    kind = np.dtype(tags.order + code)
    values = int(np.prod(extents, dtype=np.int64))
    if tags.size(encoding, 0)[0] != values * kind.itemsize:
        raise FormatError("the datum isn't as large as the image")

    def load(index: int | None) -> np.ndarray:
        size = values if index is None else values // extents[0]
        array = np.frombuffer(data, kind, size, begin + (0 if index is None else index * size * kind.itemsize))
        return little(array.reshape(extents if index is None else extents[1:]))

    return ImageFile("dm", extents, 2, {"c8": "complex_float32", "c16": "complex_float64", "?": "boolean"}.get(code, kind.name), load)
