"""EER event timelines: TIFF pages of run-length coded electron events."""

from __future__ import annotations

import numpy as np

from arrayloom.errors import FormatError
from arrayloom.sources import tiff

# Compression -> (run, horizontal, vertical) bits, and the tags that state them otherwise.
ENCODINGS = {65000: (8, 2, 2), 65001: (7, 2, 2)}
STATED, STATED_TAGS, STATED_DEFAULTS = 65002, (65007, 65008, 65009), (7, 2, 2)


def score(name: str, head: bytes) -> int | None:
    return 0 if name.endswith(".eer") and tiff.score(name.removesuffix(".eer"), head) is not None else None


class Timeline:
    """Frames of one encoding: rows and columns of positions, frames, subdivisions of a pixel."""

    def __init__(self, name: str, data: bytes):
        self.data = data
        _, self.pages = tiff.pages(data)
        kinds = {(p.get(tiff.HEIGHT), p.get(tiff.WIDTH), self._encoding(p)) for p in self.pages}
        if len(kinds) != 1:
            raise FormatError("frames of different sizes or encodings")
        (self.height,), (self.width,), (self.run, self.h, self.v) = kinds.pop()
        self.extents = (self.height << self.v, self.width << self.h)
        if max(self.extents) > 1 << 32:
            raise FormatError("the grid is too large")

    @staticmethod
    def _encoding(page: dict) -> tuple[int, int, int]:
        compression = page.get(tiff.COMPRESSION, (1,))[0]
        if compression == STATED:
            return tuple(page.get(t, (d,))[0] for t, d in zip(STATED_TAGS, STATED_DEFAULTS, strict=True))
        if compression not in ENCODINGS:
            raise FormatError("a page isn't compressed with a scheme of EER")
        return ENCODINGS[compression]

    def frame(self, t: int) -> np.ndarray:
        """(events, 2): row and column, in quanta, of a frame's events."""
        page = self.pages[t]
        rows = page.get(tiff.ROWS, (self.height,))[0]
        parts = [self._strip(self.data[at : at + n], k * rows, min(rows, self.height - k * rows)) for k, (at, n) in enumerate(zip(page[tiff.OFFSETS], page[tiff.COUNTS], strict=True))]
        return np.concatenate(parts) if parts else np.zeros((0, 2), np.uint32)

    def _strip(self, data: bytes, first_row: int, rows: int) -> np.ndarray:
        """(events, 2) of a strip, decoded as arrays: the codes' places first, then all runs and sub-positions at once.

        A code is a run of pixels without an event; unless it is the longest run, an event with its sub-position follows.
        """
        none, event_bits, pixels = (1 << self.run) - 1, self.run + self.h + self.v, self.width * rows
        bits = 8 * len(data)
        if bits < self.run or not pixels:
            return np.zeros((0, 2), np.uint32)
        # what stands at each bit place, as a word of five bytes from the byte it lies in
        padded = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint64)
        words = sum(padded[k : len(data) + k] << np.uint64(8 * k) for k in range(5))
        places = np.arange(bits - self.run + 1)
        at_place = lambda b, shift, n: (words[b >> 3] >> ((b & 7) + shift).astype(np.uint64)) & np.uint64((1 << n) - 1)
        after = (places + np.where(at_place(places, 0, self.run) == none, self.run, event_bits)).tolist()
        found, place = [], 0
        while place < len(after):
            found.append(place)
            place = after[place]
        codes = np.array(found)
        skipped = at_place(codes, 0, self.run).astype(np.int64)
        event = skipped != none
        pixel = np.cumsum(skipped + event) - event  # of the event, or behind the run
        over = np.flatnonzero(pixel >= pixels)
        if len(over):
            k = over[0]
            if pixel[k] > pixels > pixel[k] - skipped[k]:
                raise FormatError("events past the end of a strip")
            codes, event, pixel = codes[:k], event[:k], pixel[:k]
        codes, pixel = codes[event], pixel[event]
        if len(codes) and codes[-1] + event_bits > bits:
            raise FormatError("a truncated code")
        # Sub-positions are stored with these bits turned over.
        turned = lambda n: n & ((1 << n) - 1)
        x = at_place(codes, self.run, self.h).astype(np.int64) ^ turned(self.h)
        y = at_place(codes, self.run + self.h, self.v).astype(np.int64) ^ turned(self.v)
        row, column = np.divmod(pixel, self.width)
        return np.column_stack([(first_row + row) << self.v | y, column << self.h | x]).astype(np.uint32)


def encoded(frames: list[np.ndarray], height: int, width: int, run: int = 7, h: int = 2, v: int = 2) -> bytes:
    """A file of the frames' events (row and column in quanta, no two in a pixel), each frame one strip: for stand-ins and tests."""
    pages = []
    for events in frames:
        row, column = np.asarray(events, np.int64).reshape(-1, 2).T
        pixel = (row >> v) * width + (column >> h)
        order = np.argsort(pixel)
        if len(np.unique(pixel)) < len(pixel) or len(pixel) and pixel[order[-1]] >= height * width:
            raise ValueError("two events in a pixel, or one past the grid")
        gaps = np.diff(pixel[order], prepend=-1, append=height * width) - 1
        full, rest = np.divmod(gaps, (1 << run) - 1)
        turned = lambda n: n & ((1 << n) - 1)
        at = [np.append((c[order] & ((1 << n) - 1)) ^ turned(n), 0) for c, n in ((column, h), (row, v))]
        codes = (rest | at[0] << run | at[1] << (run + h)).tolist()
        sizes = [run + h + v] * (len(codes) - 1) + [run]
        text = "".join("1" * (run * n) + f"{code & ((1 << size) - 1):0{size}b}"[::-1] for n, code, size in zip(full.tolist(), codes, sizes, strict=True))
        raw = int(text[::-1], 2).to_bytes(-(-len(text) // 8), "little")
        pages.append(({tiff.WIDTH: width, tiff.HEIGHT: height, tiff.BITS: 1, tiff.COMPRESSION: STATED, tiff.SAMPLES: 1, tiff.ROWS: height} | dict(zip(STATED_TAGS, (run, h, v), strict=True)), raw))
    return tiff.file_of(pages)
