"""ZARR arrays of version 2 and 3, OME groups, shards; written as version 3 with OME metadata."""

from __future__ import annotations

import gzip
import json
import math
import os
import struct
import uuid
import zlib
from itertools import product
from typing import BinaryIO

import numpy as np

from arrayloom.errors import FormatError, ImageFileError, UnsupportedError
from arrayloom.sources.image import ImageFile, little

NAMES = {"bool": "boolean", "complex64": "complex_float32", "complex128": "complex_float64"}
TYPES = {"bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "complex64", "complex128"}
ABSENT = (1 << 64) - 1
SHUFFLE, MEMCPY, BITSHUFFLE, WHOLE = 1, 2, 4, 16
CORE_RANK = "arrayloom_core_rank"
#: Edges of written chunks: of images and of volumes.
IMAGE_EDGE, VOLUME_EDGE = 1024, 128


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (0x82F63B78 if k & 1 else 0)
        out.append(k)
    return out


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ _CRC[(c ^ b) & 0xFF]
    return c ^ 0xFFFFFFFF


def unblosc(data: bytes) -> bytes:
    """A Blosc 1 container."""
    import pyarrow as pa
    import zstandard

    if len(data) < 16:
        raise FormatError("a truncated Blosc chunk")
    flags, size, block, whole = data[2], *struct.unpack_from("<III", data, 4)
    item = data[3]
    if whole > len(data):
        raise FormatError("a truncated Blosc chunk")
    if flags & MEMCPY:
        return data[16 : 16 + size]
    unpack = {1: lambda raw, n: pa.Codec("lz4_raw").decompress(raw, n, asbytes=True), 3: lambda raw, n: zlib.decompress(raw), 4: lambda raw, n: zstandard.ZstdDecompressor().decompress(raw, max_output_size=n)}.get(flags >> 5)
    if unpack is None or flags & BITSHUFFLE:
        raise UnsupportedError("this Blosc compressor or filter")
    out = bytearray()
    for k in range(-(-size // block)):
        at = struct.unpack_from("<i", data, 16 + 4 * k)[0]
        n = min(block, size - k * block)
        parts = item if not flags & WHOLE and n == block and 1 < item <= 16 and block // item >= 128 else 1
        raw = bytearray()
        for _ in range(parts):
            packed = struct.unpack_from("<i", data, at)[0]
            piece = data[at + 4 : at + 4 + packed]
            raw += piece if packed == n // parts else unpack(piece, n // parts)
            at += 4 + packed
        if flags & SHUFFLE and item > 1:
            even = n - n % item
            raw = np.frombuffer(raw, np.uint8, even).reshape(item, -1).T.tobytes() + bytes(raw[even:])
        out += raw
    return bytes(out)


def blosc(data: bytes, item: int, level: int = 5) -> bytes:
    """One shuffled zstd block in a Blosc 1 container."""
    import zstandard

    even = len(data) - len(data) % item
    shuffled = np.frombuffer(data, np.uint8, even).reshape(-1, item).T.tobytes() + data[even:] if item > 1 else data
    packed = zstandard.ZstdCompressor(level=level).compress(shuffled)
    if len(packed) >= len(data) or not data:
        return struct.pack("<BBBBIII", 2, 1, MEMCPY, item, len(data), len(data), 16 + len(data)) + data
    return struct.pack("<BBBBIIIi", 2, 1, SHUFFLE * (item > 1) | WHOLE | 4 << 5, item, len(data), len(data), 24 + len(packed), 20) + struct.pack("<i", len(packed)) + packed


def _decode(name: str, config: dict, data: bytes) -> bytes:
    import zstandard

    try:
        if name == "blosc":
            return unblosc(data)
        if name == "zstd":
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)
        if name == "gzip":
            return gzip.decompress(data)
        if name == "zlib":
            return zlib.decompress(data)
        if name == "crc32c":
            if crc32c(data[:-4]) != int.from_bytes(data[-4:], "little"):
                raise FormatError("a checksum doesn't match")
            return data[:-4]
    except (zstandard.ZstdError, zlib.error, OSError, EOFError, struct.error) as e:
        raise FormatError(f"{name}: {e}") from e
    raise UnsupportedError(f"codec {name}")


class Codecs:
    """A chain of codecs: transposes, one that makes bytes, then those over bytes; or one of shards."""

    def __init__(self, chain: list[dict], kind: np.dtype):
        self.kind, self.turn, self.packers, self.shard = kind, None, [], None
        seen = False
        for k, c in enumerate(chain):
            name, config = c["name"], c.get("configuration", {})
            if name == "transpose" and not seen:
                order = config["order"]
                self.turn = tuple(order) if self.turn is None else tuple(self.turn[o] for o in order)
            elif name == "bytes" and not seen:
                seen, self.kind = True, kind.newbyteorder(">" if config.get("endian") == "big" else "<")
            elif name == "sharding_indexed":
                if len(chain) != 1 or any(x["name"] == "sharding_indexed" for x in config["codecs"]):
                    raise UnsupportedError("codecs around a shard, or shards in shards")
                seen, self.shard = True, config
            elif seen:
                self.packers.append((name, config))
            else:
                raise UnsupportedError(f"codec {name}")
            _ = k
        if not seen:
            raise FormatError("no codec makes bytes")

    def decode(self, data: bytes, shape: tuple[int, ...]) -> np.ndarray:
        for name, config in reversed(self.packers):
            data = _decode(name, config, data)
        stored = tuple(shape[o] for o in self.turn) if self.turn else shape
        if len(data) != math.prod(stored) * self.kind.itemsize:
            raise FormatError("a chunk of another size")
        array = np.frombuffer(data, self.kind).reshape(stored)
        return array.transpose(np.argsort(self.turn)) if self.turn else array


def fill_value(value: object, kind: np.dtype) -> np.ndarray:
    """A fill value as an element: null is zero, NaN and infinities by name, bits in hexadecimal, complex as a pair."""
    if value is None:
        return np.zeros((), kind)
    if kind.kind == "c" and isinstance(value, list):
        part = np.dtype(f"f{kind.itemsize // 2}")
        return np.array(complex(float(fill_value(value[0], part)), float(fill_value(value[1], part))), kind)
    if isinstance(value, str):
        if value.startswith("0x"):
            return np.frombuffer(int(value, 16).to_bytes(kind.itemsize, "little"), kind.newbyteorder("<"))[0]
        value = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}[value]
    return np.array(value).astype(kind)


def _load(path: str, name: str) -> dict | None:
    try:
        with open(os.path.join(path, name), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return None
    except ValueError as e:
        raise FormatError(f"{name}: {e}") from e


def node(path: str) -> tuple[int, dict, dict]:
    """Version, metadata and attributes of a node; zarr.json before .zarray before .zgroup."""
    if (meta := _load(path, "zarr.json")) is not None:
        return 3, meta, meta.get("attributes", {})
    for name in (".zarray", ".zgroup"):
        if (meta := _load(path, name)) is not None:
            return 2, meta | {"node_type": "array" if name == ".zarray" else "group"}, _load(path, ".zattrs") or {}
    raise ImageFileError(f"{path}: no ZARR node")


class Array:
    """A stored array: shape, chunks, type, codecs, keys and fill value."""

    def __init__(self, path: str, version: int, meta: dict):
        self.path, self.shape = path, tuple(meta["shape"])
        if version == 2:
            if meta.get("filters"):
                raise UnsupportedError("filters")
            kind = np.dtype(meta["dtype"])
            self.chunk, self.separator, self.prefix = tuple(meta["chunks"]), meta.get("dimension_separator", "."), ""
            chain = [{"name": "transpose", "configuration": {"order": list(range(len(self.shape)))[::-1]}}] if meta.get("order") == "F" else []
            chain.append({"name": "bytes", "configuration": {"endian": "big" if kind.byteorder == ">" else "little"}})
            if meta.get("compressor"):
                chain.append({"name": meta["compressor"]["id"], "configuration": meta["compressor"]})
        else:
            known = {"zarr_format", "node_type", "shape", "data_type", "chunk_grid", "chunk_key_encoding", "fill_value", "codecs", "attributes", "dimension_names", "storage_transformers"}
            if any(k not in known and not (isinstance(v, dict) and v.get("must_understand") is False) for k, v in meta.items()) or meta.get("storage_transformers"):
                raise UnsupportedError("unknown members of the metadata")
            if meta["chunk_grid"]["name"] != "regular" or meta["data_type"] not in TYPES:
                raise UnsupportedError("this chunk grid or data type")
            kind, chain = np.dtype(meta["data_type"]), meta["codecs"]
            self.chunk = tuple(meta["chunk_grid"]["configuration"]["chunk_shape"])
            keys = meta["chunk_key_encoding"]
            default = keys["name"] == "default"
            self.separator, self.prefix = keys.get("configuration", {}).get("separator", "/" if default else "."), "c" if default else ""
        if kind.name not in TYPES:
            raise UnsupportedError(f"elements of {kind}")
        self.kind, self.codecs = kind.newbyteorder("="), Codecs(chain, kind.newbyteorder("="))
        self.fill = fill_value(meta.get("fill_value"), self.kind)
        self.inner = tuple(self.codecs.shard["chunk_shape"]) if self.codecs.shard else None

    def key(self, place: tuple[int, ...]) -> str:
        parts = ([self.prefix] if self.prefix else []) + [str(p) for p in place]
        return self.separator.join(parts) if parts else "0"

    def get(self, place: tuple[int, ...], low: tuple[int, ...] | None = None, high: tuple[int, ...] | None = None) -> np.ndarray | None:
        """A chunk, or None where it isn't stored; of a shard only what the box [low, high) within it needs is read and decoded."""
        try:
            with open(os.path.join(self.path, *self.key(place).split("/")), "rb") as f:
                if self.inner:
                    return self._shard(f, low or (0,) * len(self.chunk), high or self.chunk)
                return self.codecs.decode(f.read(), self.chunk)
        except FileNotFoundError:
            return None

    def _shard(self, f: BinaryIO, low: tuple[int, ...], high: tuple[int, ...]) -> np.ndarray:
        config = self.codecs.shard
        counts = tuple(c // i for c, i in zip(self.chunk, self.inner, strict=True))
        checked = any(c["name"] == "crc32c" for c in config["index_codecs"])
        size = 16 * math.prod(counts) + 4 * checked
        length = os.fstat(f.fileno()).st_size
        if length < size:
            raise FormatError("a truncated shard")
        f.seek(0 if config.get("index_location", "end") == "start" else length - size)
        raw = f.read(size)
        raw = _decode("crc32c", {}, raw) if checked else raw
        index, inner = np.frombuffer(raw, "<u8").reshape(*counts, 2), Codecs(config["codecs"], self.kind)
        out = np.full(self.chunk, self.fill, self.kind)
        for place in product(*(range(a // i, -(-z // i)) for a, z, i in zip(low, high, self.inner, strict=True))):
            at, n = (int(x) for x in index[place])
            if (at, n) != (ABSENT, ABSENT):
                f.seek(at)
                out[tuple(slice(p * i, (p + 1) * i) for p, i in zip(place, self.inner, strict=True))] = inner.decode(f.read(n), self.inner)
        return out

    def read(self, begin: tuple[int, ...], end: tuple[int, ...]) -> np.ndarray:
        """The box [begin, end): only the chunks that it meets are opened."""
        out = np.full([e - b for b, e in zip(begin, end, strict=True)], self.fill, self.kind)
        for place in product(*(range(b // c, -(-e // c)) for b, e, c in zip(begin, end, self.chunk, strict=True))):
            low = tuple(max(b - p * c, 0) for b, p, c in zip(begin, place, self.chunk, strict=True))
            high = tuple(min(e - p * c, c) for e, p, c in zip(end, place, self.chunk, strict=True))
            held = self.get(place, low, high)
            if held is not None:
                target = tuple(slice(p * c + a - b, p * c + z - b) for p, c, a, z, b in zip(place, self.chunk, low, high, begin, strict=True))
                out[target] = held[tuple(slice(a, z) for a, z in zip(low, high, strict=True))]
        return out


def scales(attributes: dict) -> dict | None:
    many = (attributes.get("ome") or attributes).get("multiscales")
    return many[0] if many else None


def core_rank(rank: int, attributes: dict, names: list | None, level: dict | None) -> int:
    """Trailing axes of one image: as written, by OME's space axes, by names z, y, x, or three at most."""
    if isinstance(attributes.get(CORE_RANK), int):
        return attributes[CORE_RANK]
    if level and isinstance(level.get("axes"), list) and all(isinstance(a, dict) for a in level["axes"]):
        space = 0
        for a in reversed(level["axes"]):
            if a.get("type") != "space" or space == 3:
                break
            space += 1
        if space:
            first = len(level["axes"]) - space
            factors = [t["scale"] for d in level.get("datasets", []) for t in d.get("coordinateTransformations", []) if t.get("type") == "scale"]
            fixed = len({f[first] for f in factors}) == 1 and any(len({f[k] for f in factors}) > 1 for k in range(first + 1, rank)) if len(factors) > 1 else False
            return space - 1 if fixed and space > 1 else space
    if names:
        named = 0
        for n, want in zip(reversed(names), "xyz", strict=False):
            if n != want:
                break
            named += 1
        if named:
            return named
    return min(rank, 3)


def score(path: str) -> int | None:
    return 0 if any(os.path.exists(os.path.join(path, n)) for n in ("zarr.json", ".zarray", ".zgroup")) else None


def open_zarr(path: str) -> ImageFile:
    """An array, or a group's finest level; an array in an OME group takes the group's axes."""
    version, meta, attributes = node(path)
    level = None
    if meta["node_type"] == "group":
        level = scales(attributes)
        if not level:
            raise UnsupportedError("a group without scales")
        path = os.path.join(path, *level["datasets"][0]["path"].split("/"))
        version, meta, attributes = node(path)
    else:
        try:
            level = scales(node(os.path.dirname(os.path.abspath(path)))[2])
        except (RuntimeError, OSError):
            level = None
    array = Array(path, version, meta)
    rank = len(array.shape)
    core = core_rank(rank, attributes, meta.get("dimension_names"), level)
    if not 1 <= core <= rank:
        raise FormatError("a core rank out of range")

    def load(index: int | None) -> np.ndarray:
        if index is None:
            return little(array.read((0,) * rank, array.shape))
        return little(array.read((index, *[0] * (rank - 1)), (index + 1, *array.shape[1:]))[0])

    return ImageFile("zarr", array.shape, core, NAMES.get(array.kind.name, array.kind.name), load)


def write_zarr(path: str, array: np.ndarray, core: int) -> None:
    """A version 3 group with one level. Chunks that hold only the fill value aren't stored; each is renamed into place."""
    if os.path.exists(path) and score(path) is None and os.listdir(path):
        raise ImageFileError(f"{path} holds something else")
    if array.dtype.name not in TYPES:
        raise UnsupportedError(f"ZARR arrays hold no {array.dtype}")
    edge = VOLUME_EDGE if core == 3 else IMAGE_EDGE
    lead = array.ndim - core
    chunk = tuple(1 if k < lead else min(edge, max(n, 1)) for k, n in enumerate(array.shape))
    names = "tczyx"[-array.ndim :]
    axes = [{"name": n, "type": "space"} if k >= lead else {"name": f"i{k}"} for k, n in enumerate(names)]
    level = {"axes": axes, "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1.0] * array.ndim}]}]}
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "blosc", "configuration": {"cname": "zstd", "clevel": 5, "shuffle": "shuffle", "typesize": array.itemsize, "blocksize": 0}}]
    fill = [0.0, 0.0] if array.dtype.kind == "c" else False if array.dtype.kind == "b" else 0
    inner = {"zarr_format": 3, "node_type": "array", "shape": list(array.shape), "data_type": array.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}}, "chunk_key_encoding": {"name": "default"}, "fill_value": fill, "codecs": codecs, "attributes": {CORE_RANK: core}}
    group = {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": "0.5", "multiscales": [level]}}}

    def put(name: str, data: bytes) -> None:
        target = os.path.join(path, name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        beside = f"{target}.{uuid.uuid4().hex}"
        with open(beside, "wb") as f:
            f.write(data)
        os.replace(beside, target)

    put("zarr.json", json.dumps(group).encode())
    put("0/zarr.json", json.dumps(inner).encode())
    for place in product(*(range(-(-n // c)) for n, c in zip(array.shape, chunk, strict=True))):
        held = array[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunk, strict=True))]
        target = "0/c/" + "/".join(map(str, place))
        if held.any():
            whole = np.zeros(chunk, array.dtype)
            whole[tuple(slice(0, n) for n in held.shape)] = held
            put(target, blosc(little(whole).tobytes(), array.itemsize))
        elif os.path.exists(os.path.join(path, target)):
            os.remove(os.path.join(path, target))
