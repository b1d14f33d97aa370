"""The registered queries over the test tables, each with its SQL twin.

Stand-ins: ``embeddings`` is an image (y = vec_id, x = place in the vector) or a stack of vectors; ``events`` is an
acquisition of 720 hours; ``orders`` a dataset of rows; ``lineitem`` and ``pages`` lists of locations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions import locations as L
from arrayloom.functions.types import convert
from arrayloom.operators import events as E
from arrayloom.operators import planning as P
from arrayloom.operators import reads as R
from arrayloom.operators import sampling as S
from arrayloom.plans.lineage import numbered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SEED, EPOCH, HOURS = 7, 3, 720


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c: Column | int) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("bigint")


def scaled(x: Column) -> Column:
    """A value as whole millionths, which add up alike in any order."""
    return F.round(x.cast("double") * 1_000_000).cast("bigint")


def scaled_sum(values: Column) -> Column:
    return F.aggregate(F.transform(values, scaled), F.lit(0).cast("bigint"), lambda a, b: a + b)


SCALED = "CAST(round(CAST({0} AS DOUBLE) * 1000000) AS BIGINT)"
SCALED_SUM = "CAST(list_sum(list_transform({0}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT)"


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (event_id, key, t, y, x, micros)."""
    e = table(spark, sf_dir, "events")
    us = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    t = P.div(us, 3_600_000_000)
    return e.select("event_id", "user_id", F.col("event_type").alias("key"), us.alias("micros"), t.alias("t"), F.pmod("user_id", big(150)).alias("y"), F.pmod(t, big(24)).alias("x"))


HOURS_SQL = """e AS (SELECT event_id, user_id, event_type AS key, epoch_us(ts) - 1704067200000000 AS micros,
    (epoch_us(ts) - 1704067200000000) // 3600000000 AS t, user_id % 150 AS y,
    ((epoch_us(ts) - 1704067200000000) // 3600000000) % 24 AS x FROM events)"""


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("stack").alias("key"), F.col("vec_id").alias("idx"), F.col("embedding").alias("line"))


# Locations

LOCATION_TEXT = """CASE page_id % 6 WHEN 0 THEN CAST(page_id + 1 AS VARCHAR) || '@' || url WHEN 1 THEN url WHEN 2 THEN '0@' || url
    WHEN 3 THEN 'x@' || url WHEN 4 THEN '@' || url ELSE '3@' END"""


@query(f"""WITH p AS (SELECT page_id, {LOCATION_TEXT} AS t FROM pages),
    s AS (SELECT page_id, t, position('@' IN t) AS k FROM p),
    q AS (SELECT *, substr(t, 1, k - 1) AS l, substr(t, k + 1) AS r FROM s),
    v AS (SELECT *, k > 0 AND regexp_full_match(l, '[0-9]+') AND TRY_CAST(l AS BIGINT) > 0 AND length(r) > 0 AS ok FROM q)
    SELECT page_id, CASE WHEN k = 0 THEN t WHEN ok THEN r END AS key,
           CASE WHEN ok THEN TRY_CAST(l AS BIGINT) - 1 END AS idx, (k = 0 AND length(t) > 0) OR coalesce(ok, false) AS valid FROM v""")
def loc_parse(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 6
    t = F.when(k == 0, F.concat((F.col("page_id") + 1).cast("string"), F.lit("@"), "url")).when(k == 1, F.col("url")).when(k == 2, F.concat(F.lit("0@"), "url")).when(k == 3, F.concat(F.lit("x@"), "url")).when(k == 4, F.concat(F.lit("@"), "url")).otherwise(F.lit("3@"))
    return p.select("page_id", L.parse_location(t).alias("l")).select("page_id", "l.key", "l.idx", "l.valid")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 99 THEN '' ELSE CAST(o_orderkey % 100 + 1 AS VARCHAR) || '@' END
    || 'stack_' || CAST(o_custkey AS VARCHAR) || '.mrcs' AS location FROM orders""")
def loc_format(spark, sf_dir):
    idx = F.when(F.col("o_orderkey") % 100 != 99, F.col("o_orderkey") % 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", L.format_location(F.concat(F.lit("stack_"), F.col("o_custkey").cast("string"), F.lit(".mrcs")), idx).alias("location"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'root/' || url WHEN 1 THEN 'root/rel' || CAST(page_id AS VARCHAR) ELSE '/abs' || CAST(page_id AS VARCHAR) END AS key,
    page_id % 7 AS idx FROM pages""")
def loc_make(spark, sf_dir):
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    key = F.when(k == 0, F.concat(F.lit(">"), "url")).when(k == 1, F.concat(F.lit("rel"), n)).otherwise(F.concat(F.lit("/abs"), n))
    return table(spark, sf_dir, "pages").select("page_id", L.make_location(key, F.col("page_id") % 7, "root").alias("l")).select("page_id", "l.key", "l.idx")


@query("""SELECT l_suppkey AS key, bool_or(l_returnflag = 'R') AS whole, CASE WHEN bool_or(l_returnflag = 'R') THEN '' ELSE
    coalesce(string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)), '') END AS indices FROM lineitem GROUP BY l_suppkey""")
def loc_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.when(F.col("l_returnflag") != "R", big(F.col("l_linenumber"))).alias("idx"))
    return L.group_locations(rows).select("key", "whole", F.array_join("indices", ",").alias("indices"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey % 50, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 20 END NULLS LAST, o_orderkey) - 1 AS pos FROM orders""")
def loc_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("key"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") % 20).alias("idx"))
    return numbered(rows, [*L.location_order(), F.col("o_orderkey")]).select("o_orderkey", "pos")


@query("""SELECT p_partkey, list_aggregate(list_slice([CAST(p_size AS BIGINT), p_size % 7 + 1, p_size % 5 + 1, 4], 4 - CAST(p_partkey % 4 AS INTEGER), 4), 'string_agg', ',') AS core FROM part""")
def core_extents(spark, sf_dir):
    extents = F.array(big(F.col("p_size")), big(F.col("p_size") % 7 + 1), big(F.col("p_size") % 5 + 1), big(4))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(L.core_extents(extents, (F.col("p_partkey") % 4 + 1).cast("int")).cast("array<string>"), ",").alias("core"))


# Reads as joins


@query(f"""SELECT o_orderkey AS slot, vec_id AS idx, {SCALED_SUM.format("embedding")} AS pixel_sum
    FROM orders JOIN embeddings ON vec_id = (o_orderkey * 7) % (SELECT count(*) FROM embeddings)""")
def read_batch(spark, sf_dir):
    images = stack(spark, sf_dir).select("key", "idx", scaled_sum(F.col("line")).alias("pixel_sum"))
    size = big(max(1, images.count()))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"), F.lit("stack").alias("key"), F.pmod(F.col("o_orderkey") * 7, size).alias("idx"))
    return R.read_batch(wanted, images).select("slot", "idx", "pixel_sum")


@query(f"""SELECT o_orderkey AS slot, vec_id AS idx, {SCALED.format("embedding[1]")} AS first_pixel
    FROM orders JOIN embeddings ON vec_id = (o_custkey * 3) % (SELECT count(*) FROM embeddings)""")
def read_batch_dups(spark, sf_dir):
    images = stack(spark, sf_dir).select("key", "idx", scaled(F.get("line", 0)).alias("first_pixel"))
    size = big(max(1, images.count()))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"), F.lit("stack").alias("key"), F.pmod(F.col("o_custkey") * 3, size).alias("idx"))
    return R.read_batch(wanted, images).select("slot", "idx", "first_pixel")


@query("""SELECT l_returnflag, count(*) AS n FROM lineitem
    WHERE l_linenumber * 8 - 9 < 0 OR l_linenumber * 8 - 9 + CAST(trunc(l_quantity) AS BIGINT) > 64 GROUP BY l_returnflag""")
def strict_violations(spark, sf_dir):
    regions = table(spark, sf_dir, "lineitem").select("l_returnflag", big(F.col("l_linenumber") * 8 - 9).alias("y_off"), big(F.col("l_quantity")).alias("y_len"), big(64).alias("y_size"), big(0).alias("y_at"), big(64).alias("y_room"))
    return R.violations(regions, ["y"]).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT (user_id % 150) * 3 - 4 AS y, event_id % 64 - 4 AS x FROM events),
    k AS (SELECT least(y + 9, 440) - greatest(y, 0) AS y_len, least(x + 9, 64) - greatest(x, 0) AS x_len FROM c)
    SELECT y_len, x_len, count(*) AS n FROM k WHERE y_len > 0 AND x_len > 0 GROUP BY y_len, x_len""")
def clip_regions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.pmod("user_id", big(150)) * 3 - 4).alias("y_off"), (F.pmod("event_id", big(64)) - 4).alias("x_off"))
    same = {f"{a}_{n}": big(v) for a, size in (("y", 440), ("x", 64)) for n, v in (("len", 9), ("size", size), ("at", 0), ("room", 9))}
    return R.clip(e.withColumns(same), ["y", "x"]).groupBy("y_len", "x_len").agg(F.count("*").alias("n"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 x 5 patches of the embeddings around the events' centres: slot, inside, patch_sum."""
    centres = table(spark, sf_dir, "events").select(F.col("event_id").alias("slot"), F.lit("stack").alias("key"), (F.pmod("user_id", big(150)) * 3).alias("y"), F.pmod("event_id", big(64)).alias("x"))
    rows = stack(spark, sf_dir).withColumnRenamed("idx", "y")
    boxes = R.over_boxes(centres, rows, {"y": 5, "x": 5}, F.sum("inside").alias("inside"), F.sum(scaled_sum(F.col("values"))).alias("patch_sum"))
    return boxes.groupBy("slot").agg(F.sum("inside").alias("inside"), F.sum("patch_sum").alias("patch_sum"))


@query(f"""WITH c AS (SELECT event_id AS slot, (user_id % 150) * 3 AS y, event_id % 64 AS x FROM events),
    px AS (SELECT vec_id AS y, i AS x, {SCALED.format("embedding[i + 1]")} AS v FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i)),
    o AS (SELECT slot, y + dy AS y, x + dx AS x FROM c, (SELECT unnest(generate_series(-2, 2)) AS dy), (SELECT unnest(generate_series(-2, 2)) AS dx))
    SELECT slot, count(v) AS inside, CAST(coalesce(sum(v), 0) AS BIGINT) AS patch_sum FROM o LEFT JOIN px USING (y, x) GROUP BY slot""")
def patch_crop(spark, sf_dir):
    return patches(spark, sf_dir)


@query(f"""SELECT a.vec_id AS "row", CAST({SCALED.format("a.embedding[1]")} AS VARCHAR) || ',' || CAST({SCALED.format("b.embedding[1]")} AS VARCHAR) AS "values"
    FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 13 + 1) % (SELECT count(*) FROM embeddings)""")
def multi_location(spark, sf_dir):
    at = lambda i: F.struct(F.lit("stack").alias("key"), i.alias("idx"))
    size = big(max(1, stack(spark, sf_dir).count()))
    rows = stack(spark, sf_dir).select(F.col("idx").alias("row"), F.array(at(F.col("idx")), at(F.pmod(F.col("idx") * 13 + 1, size))).alias("locations"))
    images = stack(spark, sf_dir).select("key", "idx", scaled(F.get("line", 0)).alias("v"))
    return R.read_multi(rows, images, "locations", "v").select("row", F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))


@query(f"SELECT vec_id AS y, {SCALED.format('embedding[8]')} AS v FROM embeddings")
def slice_axis(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), scaled(F.get("embedding", 7)).alias("v"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders),
    r AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 11 % n ELSE n - 1 - o_orderkey END AS "row" FROM orders, n)
    SELECT pos, o.o_orderkey, o.o_custkey FROM r JOIN orders AS o ON o.o_orderkey = "row" """)
def subset_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("row", F.col("o_orderkey"))
    n, i = orders.count(), F.col("id")
    asked = spark.range(n).select(i.alias("pos"), F.when(i % 3 == 0, F.pmod(i * 11, big(max(1, n)))).otherwise(-1 - i).alias("row"))
    return R.take(orders, R.normalise_rows(asked, n)).select("pos", "o_orderkey", "o_custkey")


@query(f"""SELECT vec_id AS idx, {SCALED.format("embedding[1]")} AS v, vec_id % 3 = 0 AS cached FROM embeddings""")
def scratch_overlay(spark, sf_dir):
    images = stack(spark, sf_dir).select("key", "idx", scaled(F.get("line", 0)).alias("v"))
    return R.overlay(images.select("key", "idx"), images.where(F.col("idx") % 3 == 0), images, ["key", "idx"]).select("idx", "v", "cached")


@query("""WITH a AS (SELECT l_suppkey AS key, max(l_linenumber) AS most FROM lineitem GROUP BY 1)
    SELECT key, true AS indexed, most, coalesce(most < s_nationkey % 9, false) AS valid FROM a LEFT JOIN supplier ON s_suppkey = key""")
def validate_shapes(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("idx"))
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.array(F.col("s_nationkey") % 9).alias("extents"))
    return R.bounds(asked, images)


@query("""SELECT l_suppkey, s_name, count(*) AS particles FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 4 <> 0 GROUP BY ALL
    UNION ALL SELECT l_suppkey, NULL, count(*) FROM lineitem WHERE l_suppkey % 4 = 0 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ALL""")
def extract_merge(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 4 != 0).select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("particles"))
    joined, unknown, _ = R.merge_one(counts, known, "l_suppkey")
    return joined.unionByName(unknown.withColumn("s_name", F.lit(None).cast("string"))).select("l_suppkey", "s_name", "particles")


@query(f"""WITH g AS (SELECT y, x FROM (SELECT unnest(generate_series(0, (SELECT max(vec_id) FROM embeddings) // 16 + 1)) AS y), (SELECT unnest(generate_series(0, 15)) AS x)),
    s AS (SELECT vec_id // 16 AS y, vec_id % 16 AS x, {SCALED.format("embedding[1]")} AS v FROM embeddings)
    SELECT y, x, coalesce(v, -7) AS v FROM g LEFT JOIN s USING (y, x)""")
def chunk_fill(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings").select(P.div(F.col("vec_id"), 16).alias("y"), (F.col("vec_id") % 16).alias("x"), scaled(F.get("embedding", 0)).alias("v"))
    last = stored.agg(F.max("y").alias("y")).first()["y"]
    # a row of chunks beyond the last is missing whole
    grid = spark.range(0 if last is None else last + 2).select(F.col("id").alias("y"), F.explode(F.sequence(big(0), big(15))).alias("x"))
    return R.fill_missing(grid, stored, ["y", "x"], "v", big(-7))


# Events


@query(f"""WITH {HOURS_SQL} SELECT 7 AS n, ((t + 1) * 7 - 1) // {HOURS} AS f, count(*) AS events FROM e GROUP BY ALL
    UNION ALL SELECT 40 AS n, ((t + 1) * 40 - 1) // {HOURS} AS f, count(*) AS events FROM e GROUP BY ALL""")
def event_fraction(spark, sf_dir):
    each = hours(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), E.fraction(F.col("t"), HOURS, n).alias("f")) for n in (7, 40)])).alias("k"))
    return each.groupBy("k.n", "k.f").agg(F.count("*").alias("events"))


@query(f"SELECT n, i, i * {HOURS} // n AS begins FROM (SELECT unnest([1, 7, 40, 720]) AS n), LATERAL (SELECT unnest(generate_series(0, n)) AS i)")
def event_fraction_bounds(spark, sf_dir):
    parts = [spark.range(n + 1).select(F.lit(n).alias("n"), F.col("id").alias("i"), E.fraction_begin(F.col("id"), HOURS, n).alias("begins")) for n in (1, 7, 40, 720)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {HOURS_SQL} SELECT y // 5 AS y, x // 4 AS x, count(*) AS n FROM e GROUP BY ALL")
def event_count_image(spark, sf_dir):
    binned = hours(spark, sf_dir).select(E.bin_of(F.col("y"), 1, 5, 150).alias("y"), E.bin_of(F.col("x"), 1, 4, 24).alias("x"))
    return E.count_events(binned, ["y", "x"], {"y": 30, "x": 6})


@query(f"""WITH {HOURS_SQL}, c AS (SELECT ((t + 1) * 7 - 1) // {HOURS} AS f, y // 5 AS y, x // 4 AS x, count(*) AS n FROM e GROUP BY ALL),
    g AS (SELECT * FROM (SELECT unnest(generate_series(0, 6)) AS f), (SELECT unnest(generate_series(0, 29)) AS y), (SELECT unnest(generate_series(0, 5)) AS x))
    SELECT f, y, x, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (f, y, x)""")
def event_movie_dense(spark, sf_dir):
    return E.movie(hours(spark, sf_dir), HOURS, 7, 150, 24, 5, 4)


@query(f"WITH {HOURS_SQL} SELECT event_id, t, y, x FROM e WHERE t >= 100 AND t < 200")
def read_events_range(spark, sf_dir):
    return E.between(hours(spark, sf_dir), 100, 200, HOURS).select("event_id", "t", "y", "x")


# Epochs

ORDERED_SQL = f"""r AS (SELECT o_orderkey AS "row", row_number() OVER (ORDER BY md5('{SEED}:{EPOCH}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS pos FROM orders),
    n AS (SELECT count(*) AS n FROM orders)"""


def ordered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"))
    return S.epoch_order(rows, SEED, EPOCH), rows.count()


@query(f"WITH {ORDERED_SQL} SELECT pos, \"row\" FROM r")
def epoch_order(spark, sf_dir):
    return ordered(spark, sf_dir)[0].select("pos", "row")


@query(f"""WITH {ORDERED_SQL}, p AS (SELECT unnest(generate_series(0, ((n + 6) // 7) * 7 - 1)) AS p, n FROM n)
    SELECT p % 7 AS shard, p // 7 AS at, "row" FROM p JOIN r ON r.pos = p % n""")
def shards(spark, sf_dir):
    rows, n = ordered(spark, sf_dir)
    return S.shard(rows, n, 7).select("shard", "at", "row")


@query(f"WITH {ORDERED_SQL} SELECT pos // 64 AS batch, pos % 64 AS item, \"row\" FROM r, n WHERE pos // 64 < n // 64")
def batches_drop_last(spark, sf_dir):
    rows, n = ordered(spark, sf_dir)
    return S.batches(rows, n, 64, drop_last=True).select("batch", "item", "row")


@query(f"""WITH {ORDERED_SQL}, p AS (SELECT unnest(generate_series(0, ((n + 63) // 64) * 64 - 1)) AS p, n FROM n),
    q AS (SELECT p, CASE WHEN p < n THEN p ELSE (n // 64) * 64 + (p % 64) % (n % 64) END AS pos, p < n AS valid FROM p)
    SELECT p // 64 AS batch, p % 64 AS item, "row", valid FROM q JOIN r USING (pos)""")
def batches_pad_last(spark, sf_dir):
    rows, n = ordered(spark, sf_dir)
    return S.pad_last(rows, n, 64).select("batch", "item", "row", "valid")


@query(f"""WITH r AS (SELECT o_orderkey AS "row", row_number() OVER (ORDER BY md5('{SEED}:0:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS pos FROM orders)
    SELECT "row", pos < greatest(1, CAST(round(0.1 * (SELECT count(*) FROM orders)) AS BIGINT)) AS validation FROM r""")
def train_valid_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"))
    return S.split(rows, rows.count(), 0.1, SEED).select("row", "validation")


@query("SELECT vec_id, label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM embeddings")
def class_encode(spark, sf_dir):
    return S.encode_classes(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label").select("vec_id", "label", "code")


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS x FROM embeddings),
    s AS (SELECT vec_id, avg(CAST(e AS DOUBLE)) AS m, stddev_samp(CAST(e AS DOUBLE)) AS d FROM v GROUP BY vec_id)
    SELECT vec_id, CAST(x - 1 AS INTEGER) AS x, CAST(floor((CAST(e AS DOUBLE) - m) / greatest(d, 1e-6) * 10000 + 0.5) AS BIGINT) AS v FROM v JOIN s USING (vec_id)""")
def normalise_image(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.normalise(F.col("embedding"))).alias("x", "v")).select("vec_id", "x", F.floor(F.col("v") * 10000 + 0.5).cast("bigint").alias("v"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders")
def dest_numbering(spark, sf_dir):
    return P.number_regions(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").withColumn("place", big(F.col("place")))


# Planning


@query(f"""WITH {HOURS_SQL}, r AS (SELECT user_id AS key, event_id, micros AS b, micros + 1800000000 AS f FROM e),
    m AS (SELECT *, max(f) OVER (PARTITION BY key ORDER BY b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    k AS (SELECT *, sum(CASE WHEN before IS NULL OR b > before + 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY b, event_id) AS run FROM m)
    SELECT key, min(b) AS "begin", max(f) AS "end", count(*) AS parts FROM k GROUP BY key, run""")
def range_merge(spark, sf_dir):
    ranges = hours(spark, sf_dir).select(F.col("user_id").alias("key"), "event_id", F.col("micros").alias("begin"), (F.col("micros") + 1_800_000_000).alias("end"))
    return P.merge_ranges(ranges, 7_200_000_000, "event_id")


@query()
def range_merge_budgeted(spark, sf_dir):
    ranges = hours(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("micros").alias("begin"), (F.col("micros") + 1_800_000_000).alias("end"))
    return P.budgeted_ranges(ranges, 7_200_000_000, 36_000_000_000, grid=1_000_000)


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS run FROM orders")
def run_assign(spark, sf_dir):
    return P.runs(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 4, "o_custkey", "o_orderkey")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, 1000 + s_suppkey * 37 % 500 AS size FROM supplier),
    c AS (SELECT *, CAST(sum(size) OVER (ORDER BY s_nationkey, s_suppkey) AS BIGINT) AS used FROM s) SELECT s_suppkey, size, used FROM c WHERE used <= 40000""")
def budget_fit(spark, sf_dir):
    sizes = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") * 37 % 500 + 1000).alias("size"))
    return P.fit_budget(sizes, 40_000, [F.col("s_nationkey"), F.col("s_suppkey")], "size").select("s_suppkey", "size", "used")


@query("""WITH f AS (SELECT o_orderkey, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders),
    c AS (SELECT *, CAST(sum(size) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freed FROM f)
    SELECT o_orderkey, freed FROM c WHERE freed - size < (SELECT CAST(sum(size) AS BIGINT) + 1000000 - 100000000 FROM f)""")
def lru_evict(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.floor("o_totalprice").cast("bigint").alias("size"))
    return P.evict(files, 100_000_000, 1_000_000, "o_orderdate", "o_orderkey", "size").select("o_orderkey", "freed")


REGIONS_SQL = "r AS (SELECT event_id, (user_id % 150) * 3 AS y, event_id % 64 AS x, user_id % 40 + 1 AS h, event_id % 30 + 1 AS w FROM events)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.pmod("user_id", big(150)) * 3).alias("y_off"), (F.col("event_id") % 64).alias("x_off"), (F.col("user_id") % 40 + 1).alias("y_len"), (F.col("event_id") % 30 + 1).alias("x_len"))


@query(f"""WITH {REGIONS_SQL}, a AS (SELECT *, unnest(generate_series(y // 32, (y + h - 1) // 32)) AS cy FROM r),
    b AS (SELECT *, unnest(generate_series(x // 16, (x + w - 1) // 16)) AS cx FROM a)
    SELECT event_id, cy AS y_chunk, cx AS x_chunk, greatest(y - cy * 32, 0) AS y_in, greatest(x - cx * 16, 0) AS x_in,
           least(y + h, cy * 32 + 32) - greatest(y, cy * 32) AS y_part, least(x + w, cx * 16 + 16) - greatest(x, cx * 16) AS x_part FROM b""")
def chunk_split(spark, sf_dir):
    return P.chunks(regions(spark, sf_dir), {"y": 32, "x": 16}).select("event_id", "y_chunk", "x_chunk", "y_in", "x_in", "y_part", "x_part")


@query(f"WITH {REGIONS_SQL} SELECT event_id, unnest(generate_series(y, y + h - 1)) AS page FROM r")
def page_split(spark, sf_dir):
    return P.chunks(regions(spark, sf_dir), {"y": 1}).select("event_id", F.col("y_chunk").alias("page"))


@query(f"""WITH {REGIONS_SQL} SELECT event_id, y // 8 AS shard_y, x // 4 AS shard_x, (y % 8) * 4 + x % 4 AS entry FROM r""")
def shard_lookup(spark, sf_dir):
    (y, x), entry = P.shard_entry([F.col("y_off"), F.col("x_off")], [8, 4])
    return regions(spark, sf_dir).select("event_id", y.alias("shard_y"), x.alias("shard_x"), entry.alias("entry"))


@query(f"WITH {REGIONS_SQL} SELECT event_id, 'c/' || CAST(y AS VARCHAR) || '/' || CAST(x AS VARCHAR) AS v3, CAST(y AS VARCHAR) || '.' || CAST(x AS VARCHAR) AS v2 FROM r")
def chunk_key(spark, sf_dir):
    places = [F.col("y_off"), F.col("x_off")]
    return regions(spark, sf_dir).select("event_id", P.chunk_key(places).alias("v3"), P.chunk_key(places, "v2").alias("v2"))


@query(f"WITH {REGIONS_SQL} SELECT event_id, y * 64 + x AS at, row_number() OVER (PARTITION BY y ORDER BY y * 64 + x, event_id) - 1 AS place FROM r")
def region_offsets(spark, sf_dir):
    at = P.linear_offset(F.array("y_off", "x_off"), F.array(big(64), big(1)))
    rows = regions(spark, sf_dir).select("event_id", "y_off", at.alias("at"), F.struct(at.alias("a"), "event_id").alias("o"))
    return P.number_regions(rows, "y_off", "o").select("event_id", "at", big(F.col("place")).alias("place"))


# Types and formats


@query("""WITH v AS (SELECT DISTINCT l_extendedprice * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS d FROM lineitem)
    SELECT d, CAST(trunc(d) AS BIGINT) AS i64, ((CAST(trunc(d) AS BIGINT) % 256) + 256) % 256 AS u8,
           ((CAST(trunc(d) AS BIGINT) % 65536) + 65536 + 32768) % 65536 - 32768 AS i16, d <> 0 AS b FROM v""")
def cast_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("d")).distinct()
    whole = convert(F.col("d"), "float64", "int64")
    return d.select("d", whole.alias("i64"), big(convert(whole, "int64", "uint8")).alias("u8"), big(convert(whole, "int64", "int16")).alias("i16"), convert(F.col("d"), "float64", "boolean").alias("b"))


@query("""WITH c AS (SELECT page_id, f.name, f.place, CASE WHEN page_id % 4 = f.place THEN 1024 WHEN (page_id + f.place) % 3 = 0 THEN 0 WHEN page_id % 5 = 0 THEN -1024 END AS score
        FROM pages, (SELECT unnest(['mrc', 'tiff', 'eer', 'zarr']) AS name, unnest([0, 1, 2, 3]) AS place) f)
    SELECT page_id, arg_max(name, score * 10 - place) AS format FROM c WHERE score IS NOT NULL GROUP BY page_id""")
def format_select(spark, sf_dir):
    formats = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("place")) for k, n in enumerate(("mrc", "tiff", "eer", "zarr"))]))
    each = table(spark, sf_dir, "pages").select("page_id", formats.alias("f")).select("page_id", "f.name", "f.place")
    score = F.when(F.col("page_id") % 4 == F.col("place"), 1024).when((F.col("page_id") + F.col("place")) % 3 == 0, 0).when(F.col("page_id") % 5 == 0, -1024)
    return each.withColumn("score", score).where("score is not null").groupBy("page_id").agg(F.max_by("name", F.struct("score", -F.col("place"))).alias("format"))


@query("""SELECT p_partkey, CAST(coalesce(CASE WHEN p_partkey % 7 = 0 THEN 2 END,
        CASE WHEN p_partkey % 5 < 3 THEN CASE WHEN p_partkey % 2 = 0 AND least(p_size % 5, 3) = 3 THEN 2 ELSE nullif(least(p_size % 5, 3), 0) END END,
        CASE WHEN p_partkey % 11 = 0 THEN 1 END, least(p_size, 3)) AS INTEGER) AS core_rank FROM part""")
def core_rank(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    rank = P.core_rank(F.when(k % 7 == 0, 2), F.when(k % 5 < 3, size % 5), k % 2 == 0, F.when(k % 11 == 0, 1), size)
    return table(spark, sf_dir, "part").select("p_partkey", rank.cast("int").alias("core_rank"))


# Those over files register themselves
import arrayloom.file_queries  # noqa: E402, F401
