"""Registered queries that write files into the shared folder and read them back, each with SQL over the tables they were made of.

Stand-ins: an embedding is an image of 8 x 8, those with one remainder of vec_id by 3 make a stack; the events of
``events`` (one for each hour and pixel) make a timeline of 720 frames of 150 x 24 pixels.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom import jobs
from arrayloom.operators import planning as P
from arrayloom.operators import reads as R
from arrayloom.plans.cache import Scratch, fingerprint, held
from arrayloom.queries import HOURS_SQL, SCALED, SCALED_SUM, big, hours, query, scaled_sum, stack, table
from arrayloom.sources.eer import encoded
from arrayloom.sources.spark import describe, pixels, read_stack, read_timeline, register, values, write_lines

STACKS_SQL = f"""SELECT 'e' || (vec_id % 3) AS name, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY vec_id) - 1 AS idx, {SCALED_SUM.format("embedding")} AS pixel_sum FROM embeddings"""


def _folder(spark: SparkSession) -> str:
    return jobs.mounted(spark, f"files-{uuid.uuid4().hex}")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("e"), (F.col("vec_id") % 3).cast("string")).alias("name"), "embedding")
    return P.number_regions(rows, "name", "vec_id").withColumnRenamed("place", "idx")


def _written(spark: SparkSession, sf_dir: str, extension: str, dtype: str = "float32") -> list[str]:
    """The stacks' files, written by Spark tasks."""
    folder = _folder(spark)
    each = _numbered(spark, sf_dir).select(F.concat(F.lit(f"{folder}/"), "name", F.lit(extension)).alias("key"), "idx", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row"), "embedding")
    done = write_lines(each.select("key", "idx", "row", F.slice("embedding", F.col("row") * 8 + 1, 8).alias("values")), dtype)
    return sorted(r.key for r in done.collect())  # three names


def _sums(images: DataFrame) -> DataFrame:
    name = F.substring_index(F.substring_index("key", "/", -1), ".", 1).alias("name")
    return values(images).select(name, "idx", scaled_sum(F.col("values")).alias("pixel_sum"))


@query(STACKS_SQL)
def read_mrc_stacks(spark, sf_dir):
    return _sums(read_stack(spark, _written(spark, sf_dir, ".mrcs")))


@query(STACKS_SQL)
def read_gzipped_stacks(spark, sf_dir):
    return _sums(read_stack(spark, jobs.zipped(spark, _written(spark, sf_dir, ".mrcs"))))


@query(STACKS_SQL)
def convert_to_tiff(spark, sf_dir):
    folder = _folder(spark)
    done = jobs.convert(spark, _written(spark, sf_dir, ".mrcs"), folder, ".tif", "float64")
    return _sums(read_stack(spark, sorted(r.key for r in done.collect())))


@query(STACKS_SQL)
def read_zarr_ranges(spark, sf_dir):
    register(spark)
    path = _written(spark, sf_dir, ".zarr", "float64")[0].rsplit("/", 1)[0]
    return _sums(spark.read.format("arrayloom").option("images_per_partition", 100).load(f"{path}/*.zarr"))


@query("""SELECT 'e' || (vec_id % 3) AS name, k.format, CAST(count(*) AS VARCHAR) || ',8,8' AS extents, CAST(2 AS INTEGER) AS core_rank, 'float32' AS dtype
    FROM embeddings, (SELECT unnest(['mrc', 'tiff']) AS format) AS k GROUP BY vec_id % 3, k.format""")
def describe_files(spark, sf_dir):
    found = describe(spark, [*_written(spark, sf_dir, ".mrcs"), *_written(spark, sf_dir, ".tif")])
    return found.select(F.substring_index(F.substring_index("key", "/", -1), ".", 1).alias("name"), "format", F.array_join(F.col("extents").cast("array<string>"), ",").alias("extents"), "core_rank", "dtype")


@query(STACKS_SQL)
def scratch_across_epochs(spark, sf_dir):
    """Two epochs over the stacks: the first fills a cache that holds a part of them, the second is read through it."""
    folder = _folder(spark)
    source = _numbered(spark, sf_dir).select(F.col("name").alias("key"), "idx", scaled_sum(F.col("embedding")).alias("pixel_sum"))
    images = source.groupBy("key").agg(F.count("*").alias("n")).withColumn("size", big(256))
    wanted = held(source.select("key", F.lit(None).cast("bigint").alias("idx")).distinct(), images, "size", 256 * (source.count() // 2 + 1), 16)
    files = images.select("key", big(1).alias("mtime"))
    known = sorted((r.key, "float32", [r.n, 8, 8], []) for r in images.collect())  # three files
    cache = Scratch(spark, folder, fingerprint(16, known))
    cache.store(wanted, source, files)
    through = R.overlay(source.select("key", "idx"), cache.fresh(files).select("key", "idx", "pixel_sum"), source, ["key", "idx"])
    return through.select(F.col("key").alias("name"), "idx", "pixel_sum")


def _timeline(spark: SparkSession, sf_dir: str) -> str:
    """The events, no two in a pixel of a frame, as a file: frames come to the driver one after the other."""
    path = f"{_folder(spark)}/events.eer"
    rows = hours(spark, sf_dir).groupBy("t").agg(F.collect_set(F.struct("y", "x")).alias("at"))  # 3,600 pixels a frame at most
    frames = [np.zeros((0, 2), np.int64)] * 720
    for r in rows.toLocalIterator():
        frames[r.t] = np.array(r["at"], np.int64).reshape(-1, 2)
    with open(path, "wb") as f:
        f.write(encoded(frames, 150, 24, 7, 0, 0))
    return path


@query(f"WITH {HOURS_SQL} SELECT DISTINCT t, y, x FROM e WHERE t BETWEEN 100 AND 299")
def read_eer_events(spark, sf_dir):
    return read_timeline(spark, [_timeline(spark, sf_dir)], 100, 300).select("t", "y", "x")


@query(f"WITH {HOURS_SQL} SELECT DISTINCT t, y, x FROM e WHERE t >= 50 AND t < 700")
def read_eer_ranges(spark, sf_dir):
    register(spark)
    return spark.read.format("arrayloom_events").options(begin=50, end=700, frames_per_partition=100).load(_timeline(spark, sf_dir)).select("t", "y", "x")


@query(f"""WITH {HOURS_SQL}, d AS (SELECT DISTINCT t, y, x FROM e)
    SELECT ((t + 1) * 7 - 1) // 720 AS f, y // 2 AS y, x // 2 AS x, count(*) AS n FROM d GROUP BY ALL""")
def fractionate_eer(spark, sf_dir):
    done = jobs.fractionate_files(spark, [_timeline(spark, sf_dir)], _folder(spark), 7, 2)
    images = pixels(read_stack(spark, [r.key for r in done.collect()]))  # one file
    return images.where("value > 0").select(F.col("idx").alias("f"), "y", "x", F.col("value").cast("bigint").alias("n"))


@query(f"""WITH c AS (SELECT event_id AS slot, event_id % 2 AS k, user_id % 150 AS y, event_id % 64 AS x FROM events),
    px AS (SELECT vec_id % 2 AS k, vec_id // 2 AS y, i AS x, {SCALED.format("embedding[i + 1]")} AS v FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)),
    o AS (SELECT slot, k, y + dy AS y, x + dx AS x FROM c, (SELECT unnest(generate_series(-3, 2)) AS dy), (SELECT unnest(generate_series(-2, 2)) AS dx)),
    s AS (SELECT slot, CAST(coalesce(sum(v), 0) AS BIGINT) AS box_sum FROM o LEFT JOIN px USING (k, y, x) GROUP BY slot)
    SELECT slot, CAST(row_number() OVER (PARTITION BY slot % 2 ORDER BY slot) AS VARCHAR) || '@boxes/m' || (slot % 2) || '.mrcs' AS location, box_sum FROM s""")
def extract_particles(spark, sf_dir):
    """Boxes of 6 x 5 pixels cut out of two micrographs' files, written as stacks and read back by their locations."""
    folder = _folder(spark)
    lines = table(spark, sf_dir, "embeddings").select(F.concat(F.lit(f"{folder}/m"), (F.col("vec_id") % 2).cast("string"), F.lit(".mrc")).alias("key"), F.lit(None).cast("bigint").alias("idx"), P.div(F.col("vec_id"), 2).alias("row"), F.col("embedding").cast("array<double>").alias("values"))
    paths = sorted(r.key for r in write_lines(lines).collect())  # two files
    centres = table(spark, sf_dir, "events").select(F.col("event_id").alias("slot"), F.concat(F.lit(f"{folder}/m"), (F.col("event_id") % 2).cast("string"), F.lit(".mrc")).alias("key"), F.pmod("user_id", big(150)).alias("y"), F.pmod("event_id", big(64)).alias("x"))
    boxes = jobs.mounted(spark, f"{folder.rsplit('/', 1)[1]}/boxes")
    done = jobs.extract_particles(spark, centres, paths, boxes, (6, 5))
    sums = values(read_stack(spark, [f"{boxes}/m{k}.mrcs" for k in range(len(paths))])).select(jobs.plain_path("key").alias("key"), "idx", scaled_sum(F.col("values")).alias("box_sum"))
    return done.join(sums, ["key", "idx"]).select("slot", F.regexp_replace("location", "@.*/boxes/", "@boxes/").alias("location"), "box_sum")


@query(f"""WITH c AS (SELECT event_id AS slot, user_id % 8 AS z, event_id % 20 AS y, event_id % 64 AS x FROM events),
    px AS (SELECT vec_id // 20 AS z, vec_id % 20 AS y, i AS x, {SCALED.format("embedding[i + 1]")} AS v FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)),
    o AS (SELECT slot, z + dz AS z, y + dy AS y, x + dx AS x FROM c, (SELECT unnest(generate_series(-1, 1)) AS dz), (SELECT unnest(generate_series(-2, 1)) AS dy), (SELECT unnest(generate_series(-2, 2)) AS dx))
    SELECT slot, count(v) AS inside, CAST(coalesce(sum(v), 0) AS BIGINT) AS box_sum FROM o LEFT JOIN px USING (z, y, x) GROUP BY slot""")
def boxes_of_volume(spark, sf_dir):
    centres = table(spark, sf_dir, "events").select(F.col("event_id").alias("slot"), F.lit("stack").alias("key"), F.pmod("user_id", big(8)).alias("z"), F.pmod("event_id", big(20)).alias("y"), F.pmod("event_id", big(64)).alias("x"))
    rows = stack(spark, sf_dir).select("key", P.div(F.col("idx"), 20).alias("z"), (F.col("idx") % 20).alias("y"), "line")
    boxes = R.over_boxes(centres, rows, {"z": 3, "y": 4, "x": 5}, F.sum("inside").alias("inside"), F.sum(scaled_sum(F.col("values"))).alias("box_sum"))
    return boxes.groupBy("slot").agg(F.sum("inside").alias("inside"), F.sum("box_sum").alias("box_sum"))
