"""What all formats give: a described array of which single images can be read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from arrayloom.errors import FormatError


@dataclass
class ImageFile:
    """extents (slowest first), the trailing axes of one image, the element type and a reader of one image.

    ``load(i)`` gives image i, or the whole array for None. ``several(begin, end)`` gives images that follow one another
    at once; a format that can't is read image by image. ``single_pass`` says that a file can't be entered in its middle.
    """

    format: str
    extents: tuple[int, ...]
    core_rank: int
    dtype: str
    load: Callable[[int | None], np.ndarray] = field(repr=False)
    several: Callable[[int, int], np.ndarray] | None = field(default=None, repr=False)
    single_pass: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.core_rank <= len(self.extents):
            raise FormatError("the core rank must be from 1 to the rank")

    @property
    def core(self) -> tuple[int, ...]:
        return self.extents[len(self.extents) - self.core_rank :]

    @property
    def count(self) -> int:
        """Images that can be read by an index: those along the leading axis, 0 for a single one."""
        return self.extents[0] if len(self.extents) > self.core_rank else 0

    def read(self, index: int | None = None) -> np.ndarray:
        if index is not None and not 0 <= index < self.count:
            raise IndexError(f"image {index} of {self.count}")
        return self.load(index)

    def reads(self, begin: int, end: int) -> np.ndarray:
        """The images [begin, end), at least one, along a leading axis."""
        if not 0 <= begin < end <= self.count:
            raise IndexError(f"images {begin} to {end} of {self.count}")
        return self.several(begin, end) if self.several else np.stack([self.load(k) for k in range(begin, end)])


def little(array: np.ndarray) -> np.ndarray:
    """The array in C order and little-endian."""
    return np.ascontiguousarray(array, array.dtype.newbyteorder("<"))


def cast(array: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """A static cast: fractions cut off, low bits kept, not 0 is true; complex to real is refused."""
    from arrayloom.errors import UnsupportedError

    if np.iscomplexobj(array) and np.dtype(dtype).kind != "c":
        raise UnsupportedError("complex values can't become real ones")
    if np.dtype(dtype).kind == "b":
        return array != 0
    with np.errstate(invalid="ignore", over="ignore"):
        return array.astype(dtype)
