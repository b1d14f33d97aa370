"""Client-side reads, datasets, loaders; the cache; the streaming twin."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom import api
from arrayloom.data import ArraySource, BatchSampler, DataLoader, Dataset, ImageSource, PatchSource, as_columns, make_locations, normalize_rows, parse_locations
from arrayloom.functions.types import convert, numerical_type, numpy_type
from arrayloom.operators import events as E
from arrayloom.operators import planning as P
from arrayloom.operators import reads as R
from arrayloom.operators.sampling import exact_order
from arrayloom.plans.cache import Scratch, fingerprint, fnv1a, held
from arrayloom.plans.lineage import numbered
from arrayloom.streaming.events import count_images, fraction_counts
from tests.test_sources import eer_file


@pytest.fixture
def stacks(tmp_path):
    arrays = [np.arange(20 * 16 * 16, dtype="f4").reshape(20, 16, 16) + 1000 * k for k in range(3)]
    for k, a in enumerate(arrays):
        api.write_stack(a, f"{tmp_path}/{k}.mrcs")
    return [f"{tmp_path}/{k}.mrcs" for k in range(3)], arrays


def test_reads_and_writes(tmp_path, stacks):
    paths, arrays = stacks
    assert api.get_core_extents(api.query_descriptor(paths[0])) == (16, 16)
    assert np.array_equal(api.read((paths[1], 4)), arrays[1][4]) and api.read(paths[0], data_type="int16").dtype == np.int16
    out = np.zeros((16, 16))
    assert api.read((paths[2], 0), out=out) is out and np.array_equal(out, arrays[2][0])
    with pytest.raises(IndexError):
        api.read((paths[0], 20))
    batch = np.empty((3, 16, 16), "f8")
    api.Loader(2).read_batch_async(batch, [(paths[2], 1), (paths[0], 0), (paths[2], 1)]).result()
    assert np.array_equal(batch[0], batch[2]) and np.array_equal(batch[1], arrays[0][0])
    with pytest.raises(ValueError):
        api.Loader().read_batch(batch, [(paths[0], 1), paths[1], (paths[0], 2)])
    patch = np.empty((2, 5, 5), "f4")
    api.Loader().read_patches(patch, (paths[0], 0), [(0, 0), (40, 40)], fill=-1)
    assert np.array_equal(patch[0][2:, 2:], arrays[0][0][:3, :3]) and (patch[0][:2] == -1).all() and (patch[1] == -1).all()
    api.write(arrays[0], f"{tmp_path}/v.map", api.Descriptor((20, 16, 16), 3, "int16"))
    assert api.query_descriptor(f"{tmp_path}/v.map") == api.Descriptor((20, 16, 16), 3, "int16")
    (tmp_path / "m.eer").write_bytes(eer_file(4, 6, 8, 7, 2, 2, 3, 65001))
    movie = api.read(f"{tmp_path}/m.eer", api.EventMovies(2, 2))
    assert movie.shape == (2, 3, 4) and movie.sum() == 39 and len(api.read_events(f"{tmp_path}/m.eer", 3)) == 9
    with pytest.raises(ValueError):
        api.EventMovies(5).acquire(f"{tmp_path}/m.eer")


def test_dataset_and_loader(stacks):
    paths, arrays = stacks
    images = [(paths[k % 3], k % 20) for k in range(10)]
    data = Dataset({"image": ImageSource(images), "pair": ImageSource([[a, b] for a, b in zip(images, images[::-1])]), "patch": PatchSource(images, [[3, 3]] * 10, (4, 4)), "label": np.arange(10) * 2})
    one = data[-1]
    assert one["index"] == 9 and np.array_equal(one["image"], arrays[0][9]) and one["pair"].shape == (2, 16, 16)
    assert data[2:5]["label"].tolist() == [4, 6, 8] and data[np.zeros(0, int)]["image"].shape == (0, 16, 16)
    part = data.subset([5, 1])
    assert part[[1, 0, 1]]["label"].tolist() == [2, 10, 2] and part[0]["index"] == 0
    assert np.array_equal(data.preload(["image"])[3]["image"], data[3]["image"])
    seen = [b for b in DataLoader(data, 4, True, seed=1, pad_last=True)]
    assert [len(b["index"]) for b in seen] == [4, 4, 4] and seen[-1]["valid"].tolist() == [True, True, False, False]
    assert sorted(np.concatenate([b["index"][b["valid"]] for b in seen]).tolist()) == list(range(10))
    with pytest.raises(IndexError):
        ImageSource([(paths[0], 20)])
    with pytest.raises(ValueError):
        DataLoader(data, 4, pad_last=True, drop_last=True)
    with pytest.raises(IndexError):
        normalize_rows([10], 10)
    assert normalize_rows(np.array([True, False, True]), 3).tolist() == [0, 2] and len(ArraySource([1, 2])) == 2


def test_sampler_and_tables():
    s = BatchSampler(10, 3, True, seed=5, shard=(1, 4))
    want = np.random.default_rng([5, 0]).permutation(10)
    assert s.order(0).tolist() == np.resize(want, 12)[1::4].tolist() and len(s) == 1
    assert [b.tolist() for b in s] == [s.order(0).tolist()] and s.epoch == 1
    assert list(BatchSampler(0, 3)) == [] and exact_order(10, 5, 0).tolist() == want.tolist()
    assert parse_locations(["3@a.mrcs", b"b.mrc"], "/r") == [("/r/a.mrcs", 2), ("/r/b.mrc", None)]
    for bad in ("0@k", "x@k", "@k", "3@", "", f"{1 << 63}@k"):
        with pytest.raises(ValueError):
            parse_locations([bad])
    assert make_locations([">a", "b"], [0, 4]) == [("a", 0), ("b", 4)]
    with pytest.raises(ValueError):
        as_columns({"a": [1], "b": [1, 2]})


def test_types(spark):
    assert numerical_type("complex64") == "complex_float32" and numerical_type(np.uint8) == "uint8"
    with pytest.raises(TypeError):
        numerical_type(None)
    with pytest.raises(NotImplementedError):
        numpy_type("complex_float16")
    df = spark.createDataFrame([(300, -1.9), (-1, float("nan")), (70000, 0.0)], "i int, d double")
    got = df.select(convert(F.col("i"), "int32", "uint8"), convert(F.col("i"), "int32", "int8"), convert(F.col("i"), "int32", "int16"), convert(F.col("d"), "float64", "boolean")).collect()
    assert [tuple(r) for r in got] == [(44, 44, 300, True), (255, -1, -1, True), (112, 112, 4464, False)]
    with pytest.raises(NotImplementedError):
        convert(F.col("i"), "complex64", "int8")


def test_plans(spark):
    assert P.steps([5, 5, 20, 1], 10) == [[0, 1], [2], [3]]
    assert P.region_split([10, 4, 8], [1000, 100, 4], 4, 50, 10_000) == [0, 1] and P.region_split([10, 4, 8], [1000, 100, 4], 4, 100, 10_000) == [0]
    assert P.write_runs([2, 3, 4], [100, 16, 4], 4) == (48, [0, 100])
    locations = spark.createDataFrame([(0, "a", 1), (1, "a", 9)], "slot int, key string, idx long")
    images = spark.createDataFrame([("a", 1, "v")], "key string, idx long, value string")
    with pytest.raises(Exception, match="no such image"):
        R.read_batch(locations, images).collect()
    assert R.read_batch(locations, images, strict=False).where("value is null").count() == 1
    for bad in (0, 8):
        with pytest.raises(ValueError):
            E.fraction(F.col("t"), 7, bad)
    for extent, count in ((7, 3), (39, 39), (720, 7)):
        got = spark.range(extent).select(E.fraction(F.col("id"), extent, count)).collect()
        assert [r[0] for r in got] == [max(i for i in range(count) if i * extent // count <= t) for t in range(extent)]


def test_cache(spark, tmp_path):
    assert fnv1a(b"") == 0xCBF29CE484222325 and fnv1a(b"a") == 0xAF63DC4C8601EC8C
    locations = spark.createDataFrame([("b", 3), ("b", 0), ("a", None)], "key string, idx long")
    images = spark.createDataFrame([("a", 10, 3), ("b", 10, 5)], "key string, size long, n long")
    wanted = held(locations, images, "size", 40, 2)
    assert sorted(map(tuple, wanted.collect())) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("b", 0, 0)]
    with pytest.raises(ValueError):
        held(locations, images, "size", 5, 2)
    source = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in range(5)], "key string, idx long, value string")
    files = spark.createDataFrame([("a", 1), ("b", 1)], "key string, mtime long")
    name = fingerprint(2, [("a", "float32", [3, 8, 8], [0, 1, 2]), ("b", "float32", [5, 8, 8], [0])])
    cache = Scratch(spark, f"{tmp_path}/scratch", name, 1)
    assert cache.rows() is None
    assert sorted(r.value for r in cache.store(wanted, source, files).collect()) == ["a0", "a1", "a2", "b0"]
    changed, newer = source.withColumn("value", F.upper("value")), files.withColumn("mtime", F.when(F.col("key") == "b", 2).otherwise(1).cast("long"))
    reader = cache.rows()  # planned before the next fill, run after it
    assert sorted(r.value for r in cache.store(wanted, changed, newer).collect()) == ["B0", "a0", "a1", "a2"]
    assert sorted(r.value for r in reader.collect()) == ["a0", "a1", "a2", "b0"]
    other = Scratch(spark, f"{tmp_path}/scratch", "0" * 16, 1)
    other.store(wanted, source, files)
    assert cache.rows() is None and other.rows().count() == 4


def test_cache_keeps_what_was_read_last(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0)], "key string, idx long, run long")
    source, files = rows.selectExpr("key", "idx", "'v' as value"), spark.createDataFrame([("a", 1)], "key string, mtime long")
    caches = [Scratch(spark, f"{tmp_path}/s", c * 16) for c in "ab"]
    for c in caches:
        c.store(rows, source, files)
    time.sleep(1.1)
    caches[0].rows()  # written first, read last
    third = Scratch(spark, f"{tmp_path}/s", "c" * 16)
    third.store(rows, source, files)
    third.budget = sum(t[2] for t in third._tables()) - 1
    assert [p.rsplit("/", 1)[1][0] for p in third.evict()] == ["b"] and caches[0].rows().count() == 1


def test_folds_of_a_hot_key(spark):
    """A key with nearly all rows, over many partitions, and columns of the helpers' own names."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b"]), k, rng.randrange(5000), rng.randrange(60)) for k in range(700)]
    df = spark.createDataFrame(rows, "key string, slot long, begin long, size long").withColumns({"part": F.lit(1), "own": F.lit(2), "carried": F.lit(3), "row_in_part": F.lit(4), "before": F.lit(5)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = P.number_regions(df)
        want, seen = {}, {}
        for key, slot, *_ in sorted(rows):
            want[slot] = seen[key] = seen.get(key, -1) + 1
        assert {r.slot: r.place for r in got.collect()} == want and set(got.columns) == {*df.columns, "place"}
        assert {r.slot: r.pos for r in numbered(df, [F.col("slot")]).collect()} == {k: k for k in range(700)}
        merged = P.merge_ranges(df.withColumn("end", F.col("begin") + F.col("size")), 3, "slot")
        plain = []
        for key, _, begin, size in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
            if plain and plain[-1][0] == key and begin <= plain[-1][2] + 3:
                plain[-1] = (key, plain[-1][1], max(plain[-1][2], begin + size), plain[-1][3] + 1)
            else:
                plain.append((key, begin, begin + size, 1))
        assert sorted(map(tuple, merged.select("key", "begin", "end", "parts").collect())) == sorted(plain)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_streaming(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 39).alias("t"), (F.col("id") % 6).alias("y"), (F.col("id") % 4).alias("x"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, out in (("fractions", fraction_counts(stream, "ts", 39, 7)), ("images", count_images(stream, 39, 7, 6, 4, 3, 2))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination()
    batch = {tuple(r) for r in rows.groupBy(E.fraction(F.col("t"), 39, 7).alias("f")).count().collect()}
    assert {tuple(r) for r in spark.table("fractions").collect()} == batch
    dense = {tuple(r) for r in E.movie(rows, 39, 7, 6, 4, 3, 2).where("n > 0").collect()}
    assert {tuple(r) for r in spark.table("images").collect()} == dense
