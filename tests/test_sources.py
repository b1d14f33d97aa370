"""Round trips, and specimens rebuilt from their formulas."""

import gzip
import json
import struct
import zlib

import numpy as np
import pytest

from arrayloom.errors import FormatError, ImageFileError, UnsupportedError
from arrayloom.sources import mrc, tiff, zarr
from arrayloom.sources.eer import Timeline
from arrayloom.sources.registry import open_image, open_timeline, write_image
from arrayloom.sources.spark import describe, pixels, read_stack, read_timeline, register, write_stacks


@pytest.mark.parametrize("dtype", ["int8", "int16", "uint16", "float32", "float16", "complex64"])
@pytest.mark.parametrize("name,shape,core", [("a.mrc", (6, 8), 2), ("a.mrcs", (1, 6, 8), 2), ("a.mrcs", (3, 6, 8), 2), ("a.map", (4, 5, 6), 3), ("a.mrc", (2, 4, 5, 6), 3)])
def test_mrc_round_trip(tmp_path, dtype, name, shape, core):
    array = (np.arange(np.prod(shape)) - 3).reshape(shape).astype(dtype)
    write_image(f"{tmp_path}/{name}", array, core)
    f = open_image(f"{tmp_path}/{name}")
    assert (f.extents, f.core_rank) == (shape, core) and np.array_equal(f.read(), array)
    if f.count:
        assert np.array_equal(f.read(f.count - 1), array[-1])
    with open(f"{tmp_path}/{name}", "rb") as g:
        packed = gzip.compress(g.read())
    assert np.array_equal(open_image(f"{tmp_path}/{name}.gz", packed).read(), array)


def test_mrc_odd_headers():
    array = np.arange(24, dtype=">i2").reshape(2, 3, 4)
    head = bytearray(mrc.write_mrc("a.map", array.astype("<i2"), 3)[:1024])
    for at in (0, 4, 8, 12, 28, 32, 36, 64, 68, 72, 88, 108):
        struct.pack_into(">i", head, at, struct.unpack_from("<i", head, at)[0])
    head[212:214] = b"\x11\x11"
    assert np.array_equal(mrc.open_mrc("a.map", bytes(head) + array.tobytes()).read(), array)
    struct.pack_into(">3i", head, 64, 3, 1, 2)  # columns along z, rows along x, sections along y
    turned = mrc.open_mrc("a.map", bytes(head) + array.tobytes())
    assert turned.extents == (4, 2, 3) and np.array_equal(turned.read(), array.transpose(2, 0, 1))
    struct.pack_into(">3i", head, 64, 1, 1, 2)
    with pytest.raises(FormatError):
        mrc.open_mrc("a.map", bytes(head) + array.tobytes())
    struct.pack_into(">i", head, 12, 3)
    with pytest.raises(FormatError):  # in neither order a mode that is known
        mrc.open_mrc("a.map", bytes(head))
    with pytest.raises(UnsupportedError):
        mrc.write_mrc("a.mrc", np.zeros((1, 2, 2), "f4"), 2)


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint32", "int64", "float32", "float64", "complex64"])
def test_tiff_round_trip(dtype):
    array = (np.arange(3 * 70 * 90) * 7 % 251).reshape(3, 70, 90).astype(dtype)
    f = tiff.open_tiff("a.tif", tiff.write_tiff(array, 2))
    assert f.extents == array.shape and np.array_equal(f.read(), array) and np.array_equal(f.read(2), array[2])
    one = tiff.open_tiff("a.tif", tiff.write_tiff(array[0], 2))
    assert one.count == 0 and np.array_equal(one.read(), array[0])
    with pytest.raises(UnsupportedError):
        tiff.write_tiff(array[:1], 2)


def build_tiff(order, page_list):
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for tags, blocks, (offsets, counts) in page_list:
        places = []
        for b in blocks:
            places.append(len(out))
            out += b
        tags = tags | {offsets: (4, places), counts: (4, [len(b) for b in blocks])}
        far = {}
        for t, (kind, values) in tags.items():
            raw = struct.pack(f"{order}{len(values)}{tiff.TYPES[kind]}", *values)
            if len(raw) > 4:
                far[t] = len(out)
                out += raw
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for t, (kind, values) in sorted(tags.items()):
            raw = struct.pack(order + "I", far[t]) if t in far else struct.pack(f"{order}{len(values)}{tiff.TYPES[kind]}", *values)
            out += struct.pack(order + "HHI", t, kind, len(values)) + raw.ljust(4, b"\0")
        link = len(out)
        out += bytes(4)
    return bytes(out)


def test_tiff_specimens():
    base = lambda h, w, bits, kind, compression, **more: {256: (3, [w]), 257: (3, [h]), 258: (3, [bits]), 259: (3, [compression]), 277: (3, [1]), 339: (3, [kind]), **{int(k[1:]): v for k, v in more.items()}}
    lzw = np.array([(7 * i + 3) % 251 for i in range(48)], np.uint8).reshape(6, 8)
    data = build_tiff("<", [(base(6, 8, 8, 1, 5, t278=(3, [4])), [tiff.lzw(lzw[:4].tobytes()), tiff.lzw(lzw[4:].tobytes())], (273, 279))])
    assert np.array_equal(tiff.open_tiff("a.tif", data).read(), lzw)
    u16 = (1000 + 257 * np.arange(48)).astype("<u2").reshape(6, 8)
    differences = np.diff(u16, axis=1, prepend=np.zeros((6, 1), "<u2")).astype("<u2")
    data = build_tiff("<", [(base(6, 8, 16, 1, 8, t317=(3, [2])), [zlib.compress(differences.tobytes())], (273, 279))])
    assert np.array_equal(tiff.open_tiff("a.tif", data).read(), u16)
    f32 = (0.25 * np.arange(24 * 40) - 3.5).astype("f4").reshape(24, 40)
    blocks = []
    for y in (0, 16):
        for x in (0, 16, 32):
            tile = np.zeros((16, 16), "f4")
            part = f32[y : y + 16, x : x + 16]
            tile[: part.shape[0], : part.shape[1]] = part
            planes = tile.astype(">f4").view(np.uint8).reshape(16, 16, 4).transpose(0, 2, 1).reshape(16, 64)
            blocks.append(zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((16, 1), np.uint8)).astype(np.uint8).tobytes()))
    data = build_tiff("<", [(base(24, 40, 32, 3, 8, t317=(3, [3]), t322=(3, [16]), t323=(3, [16])), blocks, (324, 325))])
    assert np.array_equal(tiff.open_tiff("a.tif", data).read(), f32)
    big = (37 * np.arange(48) - 300).astype(">i2").reshape(6, 8)
    data = build_tiff(">", [(base(6, 8, 16, 2, 1), [big.tobytes()], (273, 279))])
    assert np.array_equal(tiff.open_tiff("a.tif", data).read(), big)
    with pytest.raises(UnsupportedError):
        tiff.open_tiff("a.tif", build_tiff("<", [(base(6, 8, 8, 1, 1) | {277: (3, [3])}, [bytes(144)], (273, 279))]))
    with pytest.raises(UnsupportedError):
        tiff.open_tiff("a.tif", build_tiff("<", [(base(h, 8, 8, 1, 1), [bytes(8 * h)], (273, 279)) for h in (6, 5)]))


def eer_file(frames, height, width, run, h, v, strip, compression):
    def pack(rows, frame):
        held = bits = gap = 0
        for p in range(rows.start * width, rows.stop * width):
            if (7 * p + 3 * frame) % 5:
                gap += 1
                continue
            while gap >= (1 << run) - 1:
                held |= ((1 << run) - 1) << bits
                bits, gap = bits + run, gap - (1 << run) + 1
            y, x = (3 * p + frame) % (1 << v), (p + frame) % (1 << h)
            code = gap | (x ^ (h & (1 << h) - 1)) << run | (y ^ (v & (1 << v) - 1)) << (run + h)
            held |= code << bits
            bits, gap = bits + run + h + v, 0
        while gap >= (1 << run) - 1:
            held |= ((1 << run) - 1) << bits
            bits, gap = bits + run, gap - (1 << run) + 1
        held |= gap << bits
        bits += run
        return held.to_bytes(-(-bits // 8), "little")

    tags = {256: (3, [width]), 257: (3, [height]), 258: (3, [1]), 259: (3, [compression]), 277: (3, [1]), 278: (3, [strip])}
    if compression == 65002:
        tags |= {65007: (3, [run]), 65008: (3, [h]), 65009: (3, [v])}
    strips = [range(y, min(y + strip, height)) for y in range(0, height, strip)]
    return build_tiff("<", [(tags, [pack(rows, f) for rows in strips], (273, 279)) for f in range(frames)])


@pytest.mark.parametrize("shape,coding,strip,compression", [((6, 8), (7, 2, 2), 3, 65001), ((8, 16), (6, 1, 2), 4, 65002), ((64, 80), (8, 2, 2), 64, 65000), ((9, 50), (2, 1, 1), 5, 65002)])
def test_eer(shape, coding, strip, compression):
    (height, width), (run, h, v) = shape, coding
    line = Timeline("a.eer", eer_file(3, height, width, run, h, v, strip, compression))
    assert line.extents == (height << v, width << h) and len(line.pages) == 3
    for f in range(3):
        want = [((p // width << v) + (3 * p + f) % (1 << v), (p % width << h) + (p + f) % (1 << h)) for p in range(height * width) if (7 * p + 3 * f) % 5 == 0]
        assert np.array_equal(line.frame(f), np.array(want, np.uint32))


def dm_file(array, version, order, thumbnail):
    word = ">Q" if version == 4 else ">I"
    kind = {"float32": (2, 6), "uint16": (10, 4), "int16": (1, 2)}[array.dtype.name]

    def entry(label, body, group):
        size = struct.pack(">Q", len(body)) if version == 4 else b""
        return struct.pack(">BH", 20 if group else 21, len(label)) + label.encode() + size + body

    group = lambda label, *entries: entry(label, b"\0\0" + struct.pack(word, len(entries)) + b"".join(entries), True)
    data = lambda label, encoding, raw: entry(label, b"%%%%" + struct.pack(word, len(encoding)) + b"".join(struct.pack(word, e) for e in encoding) + raw, False)
    number = lambda label, n: data(label, [5], struct.pack(order + "I", n))

    def image(a):
        return group("", group("ImageData", number("DataType", kind[0]), group("Dimensions", *[number("", n) for n in a.shape[::-1]]), data("Data", [20, kind[1], a.size], a.astype(a.dtype.newbyteorder(order)).tobytes())))

    images = [image(array[..., :2, :2])] * thumbnail + [image(array)]
    tags = [data("Name", [15, 0, 2, 0, 3, 0, 6], bytes(8)), data("Text", [18, 3], b"a\0b\0c\0"), group("ImageList", *images)]
    if thumbnail:
        tags.append(group("Thumbnails", group("", number("ImageIndex", 0))))
    root = b"\0\0" + struct.pack(word, len(tags)) + b"".join(tags)
    return struct.pack(">I", version) + struct.pack(word, len(root)) + struct.pack(">I", int(order == "<")) + root


@pytest.mark.parametrize("version,order,thumbnail", [(3, "<", True), (4, "<", True), (3, ">", False)])
def test_dm(version, order, thumbnail):
    for array in ((0.25 * np.arange(48) - 4).astype("f4").reshape(6, 8), (1000 + 3 * np.arange(35)).astype("u2").reshape(5, 7), np.arange(72).astype("i2").reshape(3, 4, 6)):
        data = dm_file(array, version, order, thumbnail)
        f = open_image(f"a.dm{version}", data)
        assert f.extents == array.shape and np.array_equal(f.read(), array)
        with pytest.raises(FormatError):
            open_image(f"a.dm{version}", data[: len(data) // 2])


def test_zarr_round_trip(tmp_path):
    for k, (shape, core, dtype) in enumerate([((5, 6, 7), 3, "f4"), ((2, 1030, 12), 2, "u2"), ((9, 8), 2, "c8"), ((4, 4), 2, "?")]):
        array = (np.arange(np.prod(shape)) % 100).reshape(shape).astype(dtype)
        write_image(f"{tmp_path}/{k}.zarr", array, core)
        f = open_image(f"{tmp_path}/{k}.zarr")
        assert (f.extents, f.core_rank) == (shape, core) and np.array_equal(f.read(), array)
    write_image(f"{tmp_path}/0.zarr", np.zeros((5, 6, 7), "f4"), 3)
    assert not any(p.is_file() for p in tmp_path.glob("0.zarr/0/c/**/*"))
    assert not open_image(f"{tmp_path}/0.zarr").read().any()


def zarr_v2(path, array, chunks, put, **meta):
    path.mkdir()
    (path / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": array.shape, "chunks": chunks, "dtype": array.dtype.str, "order": "C", "fill_value": 0, "filters": None, "compressor": None} | meta))
    for place in np.ndindex(*(-(-n // c) for n, c in zip(array.shape, chunks))):
        whole = np.zeros(chunks, array.dtype)
        part = array[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks))]
        whole[tuple(slice(0, n) for n in part.shape)] = part
        put(place, whole)


def test_zarr_specimens(tmp_path):
    a = (500 - 3 * np.arange(60)).astype(">i2").reshape(6, 10)
    zarr_v2(tmp_path / "f", a, (4, 4), lambda p, c: (tmp_path / "f" / f"{p[0]}.{p[1]}").write_bytes(zlib.compress(c.tobytes("F"))), order="F", compressor={"id": "zlib", "level": 6})
    assert np.array_equal(open_image(str(tmp_path / "f")).read(), a)
    b = (np.arange(24) + 20).astype("u1").reshape(4, 6)
    zarr_v2(tmp_path / "g", b, (2, 3), lambda p, c: p == (1, 0) or (tmp_path / "g" / f"{p[0]}.{p[1]}").write_bytes(gzip.compress(c.tobytes())), fill_value=7, compressor={"id": "gzip"})
    want = b.copy()
    want[2:, :3] = 7
    assert np.array_equal(open_image(str(tmp_path / "g")).read(), want)
    c = (0.25 * np.arange(210) - 4).astype("<f4").reshape(5, 6, 7)
    zarr_v2(tmp_path / "b", c, (2, 4, 3), lambda p, x: (tmp_path / "b" / ".".join(map(str, p))).write_bytes(zarr.blosc(x.tobytes(), 4)), compressor={"id": "blosc"})
    assert np.array_equal(open_image(str(tmp_path / "b")).read(), c)
    assert np.isnan(zarr.fill_value("NaN", np.dtype("f4"))) and zarr.fill_value("0x3f800000", np.dtype("f4")) == 1 and zarr.fill_value([1, "Infinity"], np.dtype("c8")).imag == np.inf


@pytest.mark.parametrize("location", ["start", "end"])
def test_zarr_shards(tmp_path, location):
    array = (3 * np.arange(60) + 5).astype("<u2").reshape(6, 10)
    meta = {"zarr_format": 3, "node_type": "array", "shape": [6, 10], "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 4]}}, "chunk_key_encoding": {"name": "default"}, "fill_value": 9, "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2], "codecs": [{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip"}], "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": location}}]}
    (tmp_path / "zarr.json").write_text(json.dumps(meta))
    want = np.full((8, 12), 9, "u2")
    want[:6, :10] = array
    want[2:4, 2:4] = 9
    for sy, sx in np.ndindex(2, 3):
        body, index = b"", []
        begin = 68 if location == "start" else 0
        for y, x in np.ndindex(2, 2):
            part = want[sy * 4 + y * 2 :, sx * 4 + x * 2 :][:2, :2]
            if (part == 9).all():
                index += [zarr.ABSENT, zarr.ABSENT]
                continue
            raw = gzip.compress(part.T.astype(">u2").tobytes())
            index += [begin + len(body), len(raw)]
            body += raw
        raw = struct.pack(f"<{len(index)}Q", *index)
        raw += struct.pack("<I", zarr.crc32c(raw))
        (tmp_path / "c" / str(sy)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / str(sy) / str(sx)).write_bytes(raw + body if location == "start" else body + raw)
    assert np.array_equal(open_image(str(tmp_path)).read(), want[:6, :10])


def test_core_rank():
    space = [{"name": n, "type": "space"} for n in "zyx"]
    level = lambda *scale: {"axes": space, "datasets": [{"coordinateTransformations": [{"type": "scale", "scale": s}]} for s in scale]}
    assert zarr.core_rank(3, {}, None, level([1, 1, 1], [2, 2, 2])) == 3
    assert zarr.core_rank(3, {}, None, level([1, 1, 1], [1, 2, 2])) == 2
    assert zarr.core_rank(4, {}, ["t", "z", "y", "x"], None) == 3 and zarr.core_rank(3, {}, ["a", "y", "x"], None) == 2
    assert zarr.core_rank(5, {}, None, None) == 3 and zarr.core_rank(5, {zarr.CORE_RANK: 2}, None, None) == 2


def test_missing_and_unknown(tmp_path):
    with pytest.raises(ImageFileError):
        open_image(f"{tmp_path}/none.mrc")
    (tmp_path / "a.bin").write_bytes(b"nothing")
    with pytest.raises(UnsupportedError):
        open_image(f"{tmp_path}/a.bin")
    with pytest.raises(UnsupportedError):
        open_timeline(f"{tmp_path}/a.bin")


def test_spark(spark, tmp_path):
    array = np.arange(5 * 4 * 6, dtype="f4").reshape(5, 4, 6)
    write_image(f"{tmp_path}/s.mrcs", array, 2)
    write_image(f"{tmp_path}/t.tif", array.astype("u2"), 2)
    paths = [f"{tmp_path}/s.mrcs", f"{tmp_path}/t.tif"]
    assert sorted((r.format, tuple(r.extents), r.core_rank, r.dtype) for r in describe(spark, paths).collect()) == [("mrc", (5, 4, 6), 2, "float32"), ("tiff", (5, 4, 6), 2, "uint16")]
    stack = read_stack(spark, paths, "float64")
    assert stack.count() == 10
    sums = {r.idx: r.s for r in pixels(stack.where("key like '%mrcs'")).groupBy("idx").sum("value").withColumnRenamed("sum(value)", "s").collect()}
    assert sums == {k: float(array[k].sum()) for k in range(5)}
    out = stack.where("key like '%mrcs'").selectExpr(f"'{tmp_path}/out.tif' AS key", "idx", "shape", "'float64' AS dtype", "data")
    assert [tuple(r) for r in write_stacks(out).collect()] == [(f"{tmp_path}/out.tif", 5)]
    assert np.array_equal(open_image(f"{tmp_path}/out.tif").read(), array.astype("f8"))
    register(spark)
    read = spark.read.format("arrayloom").option("images_per_partition", 2).option("idx_begin", 1).load(f"{tmp_path}/s.mrcs")
    assert read.rdd.getNumPartitions() == 2 and sorted(r.idx for r in read.collect()) == [1, 2, 3, 4]
    read.write.format("arrayloom").mode("append").save(f"{tmp_path}/parts")
    assert sum(open_image(str(p)).count or 1 for p in tmp_path.glob("parts/*")) == 4
    (tmp_path / "m.eer").write_bytes(eer_file(3, 6, 8, 7, 2, 2, 3, 65001))
    events = read_timeline(spark, [f"{tmp_path}/m.eer"], 1, 3)
    assert {r.t for r in events.collect()} == {1, 2} and events.count() == 20


def test_eer_strips_round_trip():
    """Random events of several widths, written as codes and read back; cut-off and overlong strips."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        line = object.__new__(Timeline)
        line.run, line.h, line.v, line.width = (int(n) for n in (rng.integers(3, 10), rng.integers(0, 4), rng.integers(0, 4), rng.integers(1, 40)))
        rows = int(rng.integers(1, 9))
        pixels = np.flatnonzero(rng.random(line.width * rows) < rng.random())
        x, y = rng.integers(0, 1 << line.h, len(pixels)), rng.integers(0, 1 << line.v, len(pixels))
        longest, text = (1 << line.run) - 1, ""
        turned = lambda n: n & ((1 << n) - 1)
        number = lambda value, n: f"{value:0{n}b}"[::-1] if n else ""
        gaps = np.diff(pixels, prepend=-1) - 1
        for gap, a, b in zip([*gaps.tolist(), line.width * rows - 1 - int(pixels[-1] if len(pixels) else -1)], [*x.tolist(), None], [*y.tolist(), None], strict=True):
            text += number(longest, line.run) * (gap // longest) + number(gap % longest, line.run)
            if a is not None:
                text += number(a ^ turned(line.h), line.h) + number(b ^ turned(line.v), line.v)
        pack = lambda t: bytes(int(t[k : k + 8].ljust(8, "0")[::-1], 2) for k in range(0, len(t), 8))
        want = np.column_stack([(3 + pixels // line.width) << line.v | y, (pixels % line.width) << line.h | x])
        assert np.array_equal(line._strip(pack(text), 3, rows), want)
        assert line._strip(b"", 3, rows).shape == (0, 2)
    line.run, line.h, line.v, line.width = 8, 2, 2, 16
    with pytest.raises(FormatError, match="truncated"):
        line._strip(bytes([5]), 0, 1)
    with pytest.raises(FormatError, match="past"):
        line._strip(bytes([200, 0, 0]), 0, 1)
