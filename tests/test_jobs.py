"""Jobs over files: what is read, cut and written by ranges, against the whole arrays."""

import gzip
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom import jobs
from arrayloom.errors import FormatError, UnsupportedError
from arrayloom.operators import reads as R
from arrayloom.sources import mrc, tiff
from arrayloom.sources import spark as source
from arrayloom.sources.registry import open_image, write_image


def boxes(image, centres, box, fill):
    padded = np.pad(image.astype("f8"), 50, constant_values=fill)
    return np.stack([padded[50 + y - box[0] // 2 :, 50 + x - box[1] // 2 :][: box[0], : box[1]] for y, x in centres]).astype("f4")


@pytest.fixture
def whole_partitions(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("extension", [".mrcs", ".tif"])
def test_particles_are_cut_out_once(spark, tmp_path, extension, monkeypatch, whole_partitions):
    """Boxes at borders and outside, several at one place; later reads of the result write nothing."""
    rng = np.random.default_rng(3)
    images = {k: rng.random((20, 30)).astype("f4") for k in range(3)}
    paths = [f"{tmp_path}/m.{k}.mrc" for k in images]
    for k, path in enumerate(paths):
        write_image(path, images[k], 2)
    particles = [(int(s), f"file:{paths[s % 3]}", float(y), float(x)) for s, (y, x) in enumerate(zip(rng.integers(-3, 24, 400), rng.integers(-3, 34, 400)))]
    particles += [(1000 + s, paths[0], 5.9, 7.2) for s in range(5)]
    os.makedirs(f"{tmp_path}/out")
    lines = []
    monkeypatch.setattr(jobs, "read_patches", lambda *a: lines.append(a))  # lines would be joined
    frame = spark.createDataFrame(particles, "slot long, key string, y double, x double").repartition(3)
    done = jobs.extract_particles(spark, frame, paths, f"{tmp_path}/out", (6, 5), -2, extension)
    files = {f"{tmp_path}/out/m.{k}{extension}" for k in images}
    before = {f: os.stat(f).st_ino for f in files}
    rows = sorted(map(tuple, done.collect()))
    assert done.count() == len(particles) == len(rows) and not lines
    assert {f: os.stat(f).st_ino for f in files} == before and sorted(os.listdir(f"{tmp_path}/out")) == sorted(map(os.path.basename, files))
    for k in images:
        own = sorted(p for p in particles if p[1].endswith(f"m.{k}.mrc"))
        path = f"{tmp_path}/out/m.{k}{extension}"
        assert [r for r in rows if r[1] == path] == [(p[0], path, i, f"{i + 1}@{path}") for i, p in enumerate(own)]
        assert np.array_equal(open_image(path).read(), boxes(images[k], [(int(p[2]), int(p[3])) for p in own], (6, 5), -2))


@pytest.mark.parametrize("extension,dtype", [(".mrcs", "f4"), (".tif", "f8"), (".tif", "u2"), (".zarr", "f4")])
def test_stacks_are_read_and_written_in_pieces(spark, tmp_path, extension, dtype, monkeypatch, whole_partitions):
    monkeypatch.setattr(source, "RANGE_IMAGES", 16)
    monkeypatch.setattr(source, "BATCH_BYTES", 400)
    array = (np.arange(100 * 6 * 8) * 7 % 1000).reshape(100, 6, 8).astype(dtype)
    write_image(f"{tmp_path}/a.tif", array, 2)
    stack = source.read_stack(spark, [f"{tmp_path}/a.tif"])
    assert stack.rdd.getNumPartitions() == 7  # one for the file before
    kept = stack.where("idx % 3 != 1").selectExpr(f"'{tmp_path}/b{extension}' AS key", "idx * 5 AS idx", "shape", "dtype", "data").repartition(5)
    done = source.write_stacks(kept)
    path = f"{tmp_path}/b{extension}"
    assert os.path.exists(path) and [tuple(r) for r in done.collect()] == [(path, 67)]
    want = array[[k for k in range(100) if k % 3 != 1]]
    assert np.array_equal(open_image(path).read(), want) and sorted(os.listdir(tmp_path)) == sorted({"a.tif", f"b{extension}"})
    got = {(r.idx, r.y, r.x): r.value for r in source.pixels(stack).collect()}
    assert len(got) == array.size and all(array[at] == v for at, v in got.items())
    assert {r.idx: r["values"] for r in source.values(stack).collect()} == {k: a.ravel().tolist() for k, a in enumerate(array)}


def test_images_are_written_by_lines(spark, tmp_path, whole_partitions):
    """One tall image and a stack, whose lines lie in several partitions; images of several heights are refused."""
    rng = np.random.default_rng(4)
    tall, stack = rng.random((3000, 4)), rng.random((50, 7, 4))
    rows = [(f"{tmp_path}/a.mrc", None, y, line.tolist()) for y, line in enumerate(tall)] + [(f"{tmp_path}/b.mrcs", k, y, line.tolist()) for k, image in enumerate(stack) for y, line in enumerate(image)]
    lines = spark.createDataFrame(rows, "key string, idx long, row long, values array<double>").repartition(7)
    assert sorted(map(tuple, source.write_lines(lines).collect())) == [(f"{tmp_path}/a.mrc", 1), (f"{tmp_path}/b.mrcs", 50)]
    assert np.array_equal(open_image(f"{tmp_path}/a.mrc").read(), tall.astype("f4")) and np.array_equal(open_image(f"{tmp_path}/b.mrcs").read(), stack.astype("f4"))
    with pytest.raises(Exception, match="several shapes"):
        source.write_lines(lines.where("key like '%mrcs' AND NOT (idx = 3 AND row = 2)")).collect()


def test_zipped_stacks_are_entered_at_any_block(spark, tmp_path, monkeypatch):
    """Files packed in parts are read by ranges and by anyone's gzip; a stack of one member is inflated once and not held."""
    monkeypatch.setattr(jobs, "ZIPPED", 3 * mrc.BLOCK)
    monkeypatch.setattr(source, "RANGE_IMAGES", 100)
    array = np.random.default_rng(6).random((1500, 16, 16)).astype("f4")
    paths = [f"{tmp_path}/a.mrcs", f"{tmp_path}/b.mrcs"]
    for path, part in zip(paths, (array, array[:3])):
        write_image(path, part, 2)
    packed = jobs.zipped(spark, paths)
    assert packed == [f"{p}.gz" for p in paths] and sorted(os.listdir(tmp_path)) == ["a.mrcs", "a.mrcs.gz", "b.mrcs", "b.mrcs.gz"]
    for path in paths:
        with open(path, "rb") as f, gzip.open(f"{path}.gz") as g:
            assert f.read() == g.read()
    stack = source.read_stack(spark, packed)
    assert stack.rdd.getNumPartitions() == 15 + 1  # one for each file before
    assert {(r.key[-9:-8], r.idx): bytes(r.data) for r in stack.collect()} == {(n, k): a.tobytes() for n, part in (("a", array), ("b", array[:3])) for k, a in enumerate(part)}
    image = open_image(packed[0])
    assert np.array_equal(image.read(1499), array[1499]) and np.array_equal(image.read(), array)


def test_one_gzip_stream_is_read_onward(monkeypatch):
    """Images are inflated without copying all that lies before them; what was read is dropped, and inflated anew for a step back."""
    monkeypatch.setattr(mrc, "KEPT", 1 << 16)
    array = np.random.default_rng(6).random((1500, 16, 16)).astype("f4")
    held = []
    inner = mrc.Inflated
    monkeypatch.setattr(mrc, "Inflated", lambda data: held.append(inner(data)) or held[0])
    image = mrc.open_gzip("a.mrcs.gz", gzip.compress(mrc.write_mrc("a.mrcs", array, 2)))
    assert image.single_pass
    for k in range(0, 1500, 50):
        assert np.array_equal(image.reads(k, k + 50), array[k : k + 50]) and len(held[0].out) < 500_000
    assert np.array_equal(image.read(3), array[3]) and np.array_equal(image.reads(1400, 1410), array[1400:1410]) and np.array_equal(image.read(), array)


def test_odd_stacks_are_read_by_ranges(spark, tmp_path, monkeypatch):
    """A big-endian stack behind an extended header, volumes, one image and a cut-off file."""
    monkeypatch.setattr(source, "RANGE_IMAGES", 4)
    array = np.arange(10 * 3 * 4, dtype=">i2").reshape(10, 3, 4)
    head = bytearray(mrc.write_mrc("a.mrcs", array.astype("<i2"), 2)[:1024])
    for at in (0, 4, 8, 12, 28, 32, 36, 64, 68, 72, 88, 108):
        struct.pack_into(">i", head, at, struct.unpack_from("<i", head, at)[0])
    struct.pack_into(">i", head, 92, 160)
    head[212:214] = b"\x11\x11"
    (tmp_path / "a.mrcs").write_bytes(bytes(head) + bytes(160) + array.tobytes())
    volumes = np.arange(6 * 2 * 3 * 4, dtype="f4").reshape(6, 2, 3, 4)
    write_image(f"{tmp_path}/b.mrc", volumes, 3)
    write_image(f"{tmp_path}/c.mrc", volumes[0, 0], 2)
    stack = source.read_stack(spark, [f"{tmp_path}/{n}" for n in ("a.mrcs", "b.mrc", "c.mrc")], "float64")
    assert stack.rdd.getNumPartitions() == 3 + 2 + 1  # one for each file before
    got = {(r.key[-6:].strip("/"), r.idx): np.frombuffer(r.data).reshape(r["shape"]) for r in stack.collect()}
    want = {("a.mrcs", k): a for k, a in enumerate(array)} | {("b.mrc", k): a for k, a in enumerate(volumes)} | {("c.mrc", None): volumes[0, 0]}
    assert set(got) == set(want) and all(np.array_equal(got[k], want[k]) for k in want)
    (tmp_path / "d.mrcs").write_bytes((tmp_path / "a.mrcs").read_bytes()[:-1])
    with pytest.raises(Exception, match="truncated"):
        source.read_stack(spark, [f"{tmp_path}/d.mrcs"]).collect()


@pytest.mark.parametrize("dtype,classic,strip", [("f8", 1 << 31, 1 << 18), ("f4", 100, 1 << 18), ("f8", 1 << 31, 100), ("u1", 100, 20), ("u2", 1 << 31, 1 << 18)])
def test_tiff_directories_are_followed_at_once(tmp_path, dtype, classic, strip, monkeypatch):
    """Many pages, classic and large, of one strip and several: opening parses few of them; an odd page among them is found."""
    monkeypatch.setattr(tiff, "CLASSIC", classic)
    monkeypatch.setattr(tiff, "STRIP_BYTES", strip)
    monkeypatch.setattr(tiff, "PAGES", 300)
    array = (np.arange(1000 * 5 * 7) % 251).reshape(1000, 5, 7).astype(dtype)
    raw = tiff.write_tiff(array, 2)
    assert (raw[2] == 43) == (classic == 100)
    parsed, inner = [], tiff.Pages.__getitem__
    monkeypatch.setattr(tiff.Pages, "__getitem__", lambda self, k: parsed.append(k) or inner(self, k))
    f = tiff.open_tiff("a.tif", raw)
    assert f.extents == array.shape and len(parsed) < 5  # all of them before
    assert all(np.array_equal(f.read(k), array[k]) for k in (0, 1, 299, 300, 301, 998, 999)) and np.array_equal(f.read(), array)
    at = tiff.pages(raw)[1].at
    odd = bytearray(raw)
    place = int(at[700]) + (8 if classic == 100 else 2)
    assert struct.unpack_from("<H", odd, place)[0] == tiff.WIDTH
    struct.pack_into("<I", odd, place + (12 if classic == 100 else 8), 6)
    with pytest.raises(UnsupportedError, match="different"):
        tiff.open_tiff("a.tif", bytes(odd))
    with pytest.raises(FormatError):
        tiff.open_tiff("a.tif", raw[: int(at[700]) + 3])


def test_centres_at_one_place_share_their_box(spark):
    """The join has a row for each line of a place, however many centres lie there; each slot has its lines, as has one without a place."""
    volume = np.random.default_rng(8).random((4, 5, 6))
    rows = spark.createDataFrame([("v", z, y, volume[z, y].tolist()) for z, y in np.ndindex(4, 5)], "key string, z long, y long, line array<double>")
    at = [(0, 0, 0), (2, 3, 4), (3, 4, 5), (-1, 2, 7), (9, 9, 9)]
    centres = [(s, "v", *at[s % 5]) for s in range(3000)] + [(3000, "other", 1, 1, 1), (3001, "v", None, 1, 1), (3002, None, 1, 1, 1)]
    frame = spark.createDataFrame(centres, "slot long, key string, z long, y long, x long")
    extents = {"z": 3, "y": 2, "x": 4}
    assert R.boxes_at(frame, rows, extents, -1).count() == (5 + 3) * 6  # 6 for each centre before
    got = {}
    for r in R.read_boxes(frame, rows, extents, -1).collect():
        got.setdefault(r.slot, {})[r.z_at, r.y_at] = (r["values"], r.inside)
    padded = np.pad(volume, 12, constant_values=-1)
    for slot, key, *place in centres[:3001]:
        z, y, x = (12 + p - n // 2 for p, n in zip(place, extents.values()))
        want = padded[z : z + 3, y : y + 2, x : x + 4] if key == "v" else np.full((3, 2, 4), -1.0)
        assert len(got[slot]) == 6 and all(got[slot][k][0] == want[k].tolist() and got[slot][k][1] == (want[k] >= 0).sum() for k in np.ndindex(3, 2))
    assert len(got) == len(centres) and len(got[3001]) == len(got[3002]) == 6
    sums = R.over_boxes(frame, rows, extents, F.sum("inside").alias("n"), fill=-1)
    assert {r.slot: r.n for r in sums.collect()} == {s: sum(n for _, n in lines.values()) for s, lines in got.items()}
