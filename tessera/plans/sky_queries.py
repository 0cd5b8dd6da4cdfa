"""Queries of the spherical operators on the driver's tables: the first three components of a vector, in any length, are a position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sphere
from tessera.operators import sky
from tessera.plans import tiling
from tessera.plans.shared import folder, table
from tessera.sources import datasource
from tessera.sources.catalog import Catalog

AT = ("x", "y", "z")
#: Rows of a tile and the deepest tiles of the queries' catalogs; the order of the sky map that is returned.
MOST, DEEPEST, MAP = 40, 6, 3


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, x, y, z) of every vector."""
    at = [F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate(AT)]
    return table(spark, sf, "embeddings").select("vec_id", "label", *at)


def _built(spark: SparkSession, sf: str) -> Catalog:
    return tiling.build_catalog(placed(spark, sf), f"{folder(spark)}/sky", AT, MOST, DEEPEST)


def cone_search(spark: SparkSession, sf: str) -> DataFrame:
    """Half a radian around (1, 1, 1) in a catalog made of all vectors, of which only the files and row groups on the way are read."""
    found = sky.search_catalog(_built(spark, sf), (1, 1, 1), 0.5, AT, ["vec_id"])
    return found.select("vec_id", F.round("separation", 9).alias("separation"))


def cross_match(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest others within 0.3 radians of every vector whose id is divisible by 50."""
    rows = placed(spark, sf)
    found = sky.cross_match(rows.filter("vec_id % 50 = 0"), rows.filter("vec_id % 50 <> 0"), 0.3, AT, ("vec_id", "vec_id"), nearest=3)
    return found.select(F.col("left.vec_id").alias("vec_id"), "rank", F.col("right.vec_id").alias("other"), F.round("separation", 9).alias("separation"))


def close_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors within 0.05 radians of each other, counted by label."""
    rows = placed(spark, sf)
    found = sky.cross_match(rows, rows, 0.05, AT, ("vec_id", "vec_id")).filter("left.vec_id < right.vec_id")
    return found.groupBy(F.col("left.label").alias("label")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("right.vec_id").alias("others"))


def sky_density(spark: SparkSession, sf: str) -> DataFrame:
    return sky.density(sky.keyed(placed(spark, sf), AT), MAP)


def sky_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return sky.tiles(sky.density(sky.keyed(placed(spark, sf), AT), DEEPEST), DEEPEST, MOST)


def tiled_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog written by the two-phase writer and read back by the source: what each file holds, and what the catalog says of itself."""
    made = _built(spark, sf)
    rows = datasource.scan(spark, made.url, ["vec_id"], places=True)
    by = rows.groupBy(F.col("_order").alias("order"), F.col("_pixel").alias("pixel")).agg(F.count(F.lit(1)).alias("rows"), F.sum("vec_id").alias("ids"), F.max("_row").alias("last"))
    return by.withColumn("all_rows", F.lit(int(made.properties["hats_nrows"]))).withColumn("map_order", F.lit(int(made.properties["hats_skymap_order"])))


def catalog_sky_map(spark: SparkSession, sf: str) -> DataFrame:
    """The sky map that stands beside the data, at a lower order."""
    return tiling.sky_map(_built(spark, sf)).groupBy(F.shiftright("pixel", 2 * (DEEPEST - MAP)).alias("pixel")).agg(F.sum("rows").alias("rows"))


def catalog_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth pixel of an order as ranges of keys, read by the source from the files and row groups that have some."""
    made = _built(spark, sf)
    shift = 2 * (sphere.DEEPEST - MAP)
    within = [(p << shift, (p + 1 << shift) - 1) for p in range(0, 12 << 2 * MAP, 5)]
    return datasource.scan(spark, made.url, ["vec_id", "label"], within=within)


def damaged_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog with one damaged file: a row that says so, and all of the others."""
    made = _built(spark, sf)
    path = made.path(made.partitions[len(made.partitions) // 2])
    with made.fs.open_input_file(path) as f:
        held = f.read()
    with made.fs.open_output_stream(path) as f:
        f.write(held[:40] + bytes(100) + held[140:])
    rows = datasource.scan(spark, made.url, ["vec_id"], places=True, errors="column")
    by = rows.groupBy("_order", "_pixel").agg(F.count("vec_id").alias("rows"), F.max(F.col("_error").isNotNull().cast("int")).alias("failed"))
    return by.groupBy((F.col("rows") == 0).alias("empty"), "failed").agg(F.count(F.lit(1)).alias("files"))


QUERIES = {f.__name__: f for f in (cone_search, cross_match, close_pairs, sky_density, sky_tiles, tiled_catalog, catalog_sky_map, catalog_scan, damaged_scan)}

_UNIT = """unit AS (
  SELECT vec_id, label, x / r AS x, y / r AS y, z / r AS z FROM (
    SELECT *, sqrt(x * x + y * y + z * z) AS r FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)))"""
_APART = "2 * asin(least(1, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2))"


def _pixels(order: int) -> str:
    """CTEs up to pixels (vec_id, label, p): the projection in plain SQL."""
    n = 1 << order
    bits = " + ".join(f"((((ix >> {i}) & 1) << {2 * i}) + (((iy >> {i}) & 1) << {2 * i + 1}))" for i in range(order))
    return f"""{_UNIT},
turned AS (
  SELECT *, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) / (pi() / 2) + 4 ELSE atan2(y, x) / (pi() / 2) END AS t, {n} * sqrt(3 * (x * x + y * y) / (1 + abs(z))) AS far FROM unit),
lines AS (
  SELECT vec_id, label, z, least(floor(t), 3)::BIGINT AS q,
         CASE WHEN abs(z) <= 2 / 3 THEN floor({n} * (t + 0.5) - z * {0.75 * n}) ELSE least(floor((t - least(floor(t), 3)) * far), {n - 1}) END::BIGINT AS jp,
         CASE WHEN abs(z) <= 2 / 3 THEN floor({n} * (t + 0.5) + z * {0.75 * n}) ELSE least(floor((1 - (t - least(floor(t), 3))) * far), {n - 1}) END::BIGINT AS jm FROM turned),
faced AS (
  SELECT vec_id, label,
         CASE WHEN abs(z) > 2 / 3 THEN CASE WHEN z >= 0 THEN q ELSE q + 8 END WHEN jp >> {order} = jm >> {order} THEN (jp >> {order}) | 4 WHEN jp >> {order} < jm >> {order} THEN jp >> {order} ELSE (jm >> {order}) + 8 END AS face,
         CASE WHEN abs(z) <= 2 / 3 THEN jm & {n - 1} WHEN z >= 0 THEN {n - 1} - jm ELSE jp END AS ix,
         CASE WHEN abs(z) <= 2 / 3 THEN {n - 1} - (jp & {n - 1}) WHEN z >= 0 THEN {n - 1} - jp ELSE jm END AS iy FROM lines),
pixels AS (SELECT vec_id, label, (face << {2 * order}) + {bits} AS p FROM faced)"""


def _tiles(columns: Sequence[str]) -> str:
    """SQL over tiled (vec_id, label, order, pixel): the first order whose pixel has few enough rows, else the deepest."""
    counts = ", ".join(f"count(*) OVER (PARTITION BY p >> {2 * (DEEPEST - k)}) AS n{k}" for k in range(DEEPEST))
    order = " ".join(f"WHEN n{k} <= {MOST} THEN {k}" for k in range(DEEPEST))
    return f"""WITH {_pixels(DEEPEST)},
tiled AS (SELECT vec_id, "order", p >> (2 * ({DEEPEST} - "order")) AS pixel FROM (SELECT vec_id, p, CASE {order} ELSE {DEEPEST} END AS "order" FROM (SELECT *, {counts} FROM pixels)))
SELECT "order", pixel, {", ".join(columns)} FROM tiled GROUP BY 1, 2"""


ORACLE_SQL = {
    "cone_search": f"WITH {_UNIT} SELECT a.vec_id, round({_APART}, 9) AS separation FROM unit a, (SELECT 1 / sqrt(3) AS x, 1 / sqrt(3) AS y, 1 / sqrt(3) AS z) b WHERE {_APART} <= 0.5",
    "cross_match": f"WITH {_UNIT} SELECT * FROM (SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_APART}, b.vec_id)::INT AS rank, b.vec_id AS other, round({_APART}, 9) AS separation FROM unit a JOIN unit b ON a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 AND {_APART} <= 0.3) WHERE rank <= 3",
    "close_pairs": f"WITH {_UNIT} SELECT a.label, count(*) AS pairs, sum(b.vec_id)::BIGINT AS others FROM unit a JOIN unit b ON a.vec_id < b.vec_id AND {_APART} <= 0.05 GROUP BY 1",
    "sky_density": f'WITH {_pixels(MAP)} SELECT p AS pixel, count(*) AS "rows" FROM pixels GROUP BY 1',
    "sky_tiles": _tiles(['count(*) AS "rows"']),
    "tiled_catalog": _tiles(['count(*) AS "rows"', "sum(vec_id)::BIGINT AS ids", "count(*) - 1 AS last", "(SELECT count(*) FROM embeddings)::INT AS all_rows", f"{DEEPEST} AS map_order"]),
    "catalog_sky_map": f'WITH {_pixels(MAP)} SELECT p AS pixel, count(*)::BIGINT AS "rows" FROM pixels GROUP BY 1',
    "catalog_scan": f"WITH {_pixels(MAP)} SELECT vec_id, label FROM pixels WHERE p % 5 = 0",
    "damaged_scan": f"SELECT i = 1 AS empty, i AS failed, CASE i WHEN 1 THEN 1 ELSE n - 1 END AS files FROM (SELECT count(*) AS n FROM ({_tiles(['count(*) AS k'])})), (SELECT unnest([0, 1]) AS i)",
}
