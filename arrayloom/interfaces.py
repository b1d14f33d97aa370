"""What readers, writers, loaders, savers, sanitizers, sources and caches must offer to take the place of those here."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import Future
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame

from arrayloom.sources.image import ImageFile

Location = tuple[str, int | None]


@runtime_checkable
class ReaderProvider(Protocol):
    def acquire(self, key: str) -> ImageFile: ...


@runtime_checkable
class ImageWriter(Protocol):
    def store(self, key: str, index: int | None, image: np.ndarray) -> None: ...

    def flush(self, key: str) -> None: ...

    def close(self) -> None: ...


@runtime_checkable
class ImageLoader(Protocol):
    def read_batch(self, out: np.ndarray, locations: Sequence[Location]) -> np.ndarray: ...

    def read_batch_async(self, out: np.ndarray, locations: Sequence[Location]) -> Future: ...


@runtime_checkable
class ImageSaver(Protocol):
    def write_batch(self, images: np.ndarray, locations: Sequence[Location]) -> None: ...

    def write_batch_async(self, images: np.ndarray, locations: Sequence[Location]) -> Future: ...


@runtime_checkable
class Sanitizer(Protocol):
    def __call__(self, regions: DataFrame, axes: list[str]) -> DataFrame: ...


@runtime_checkable
class RunStorage(Protocol):
    def load(self, run: tuple[str, int]) -> tuple[int | None, np.ndarray] | None: ...

    def store(self, run: tuple[str, int], stamp: int | None, values: np.ndarray) -> None: ...


@runtime_checkable
class Source(Protocol):
    shape: tuple[int, ...]
    dtype: np.dtype

    def __len__(self) -> int: ...

    def take(self, rows: np.ndarray, loader: ImageLoader) -> np.ndarray: ...

    def subset(self, rows: np.ndarray) -> Source: ...
