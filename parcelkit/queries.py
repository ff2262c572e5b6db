"""The registered queries over the general-purpose test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelkit import fixtures as fx
from parcelkit.fixtures import with_tables as w
from parcelkit.functions import stats
from parcelkit.operators import aggregate, complexity, connectivity, dims, onthefly, prep, reho, spectral
from parcelkit.plans import markers, pipeline
from parcelkit.plans.lineage import cut
from parcelkit.sources import elements, patterns, readers, store

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
#: Rounded values in SQL; adding zero makes a negative zero positive.
R = lambda e, name="value": f"round({e}, 6) + 0.0 AS {name}"
_S16, _S8 = w("signal", "parc16"), w("signal", "parc8", "series8")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[name] = fn
        if sql:
            _sql[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns or ("value",)})


def _series(spark: SparkSession, d: str, size: int) -> DataFrame:
    return aggregate.with_index(aggregate.parcel_aggregation(fx.signal(spark, d), fx.parcels(spark, size)), fx.labels(size))


# Aggregation over regions.

def _parcel(name: str, sql_value: str, method: str, params: dict | None = None) -> None:
    @query(name, f"{_S16} SELECT element, timepoint, label AS col, {R(sql_value)} FROM signal JOIN parc16 USING (voxel) GROUP BY ALL")
    def _(spark: SparkSession, d: str) -> DataFrame:
        return rounded(aggregate.parcel_aggregation(fx.signal(spark, d), fx.parcels(spark, 4), method, params))


_parcel("parcel_mean", "avg(value)", "mean")
_parcel("parcel_std", "stddev_pop(value)", "std")
_parcel("parcel_count", "CAST(count(*) AS DOUBLE)", "count")

_SORTED = "(SELECT element, timepoint, label AS col, value, row_number() OVER (PARTITION BY element, timepoint, label ORDER BY value) AS r FROM signal JOIN {} USING (voxel))"
_MODE = "(SELECT element, label AS col, round(value, 2) AS v, count(*) AS n FROM signal JOIN parc16 USING (voxel) GROUP BY ALL)"


@query("parcel_mode", f"{_S16} SELECT element, col, v + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY element, col ORDER BY n DESC, v) AS r FROM {_MODE}) WHERE r = 1")
def parcel_mode(spark: SparkSession, d: str) -> DataFrame:
    coarse = fx.signal(spark, d).withColumn("value", F.round("value", 2)).withColumn("timepoint", F.lit(0))
    return aggregate.parcel_aggregation(coarse, fx.parcels(spark, 4), "mode").select("element", "col", (F.col("value") + F.lit(0.0)).alias("value"))


@query("parcel_select", f"{_S16} SELECT element, timepoint, col, value FROM (SELECT element, timepoint, label AS col, value, row_number() OVER (PARTITION BY element, timepoint, label ORDER BY voxel) AS r FROM signal JOIN parc16 USING (voxel)) WHERE r IN (1, 3)")
def parcel_select(spark: SparkSession, d: str) -> DataFrame:
    joined = fx.signal(spark, d).join(fx.parcels(spark, 4).select("voxel", F.col("label").alias("col")), "voxel")
    return stats.select(joined, ["element", "timepoint", "col"], "voxel", pick=[0, 2]).select("element", "timepoint", "col", "value")


_S8_ONLY = w("signal", "parc8")


@query("parcel_winsorized", f"{_S8_ONLY}, s AS {_SORTED.format('parc8')} SELECT element, timepoint, col, {R('avg(greatest(lo, least(hi, value)))')} FROM (SELECT *, max(value) FILTER (r = 2) OVER w AS lo, max(value) FILTER (r = 7) OVER w AS hi FROM s WINDOW w AS (PARTITION BY element, timepoint, col)) GROUP BY ALL")
def parcel_winsorized(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.parcel_aggregation(fx.signal(spark, d), fx.parcels(spark, 8), "winsorized_mean", {"limits": [0.2, 0.2]}))


@query("parcel_trimmed", f"{_S8_ONLY}, s AS {_SORTED.format('parc8')} SELECT element, timepoint, col, {R('avg(value)')} FROM s WHERE r BETWEEN 2 AND 7 GROUP BY ALL")
def parcel_trimmed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.parcel_aggregation(fx.signal(spark, d), fx.parcels(spark, 8), "trim_mean", {"proportiontocut": 0.2}))


_EDGE = "(SELECT 0 AS element, 0 AS timepoint, c_custkey AS voxel, c_acctbal AS value, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer WHERE c_custkey BETWEEN 1 AND 100)"


@query("parcel_trimmed_edge", f"SELECT element, timepoint, 'all' AS col, {R('avg(value)')} FROM {_EDGE} WHERE r BETWEEN 29 AND 72 GROUP BY ALL")
def parcel_trimmed_edge(spark: SparkSession, d: str) -> DataFrame:
    """0.29 of 100 values is 28.999999999999996: 28 values go on either side."""
    c = fx.table(spark, d, "customer").where("c_custkey BETWEEN 1 AND 100").select(F.lit(0).alias("element"), F.lit(0).alias("timepoint"), F.col("c_custkey").cast("int").alias("voxel"), F.col("c_acctbal").alias("value"))
    return rounded(aggregate.parcel_aggregation(c, c.select("voxel", F.lit("all").alias("label")), "trim_mean", {"proportiontocut": 0.29}))


@query("parcel_time_mean", f"{_S16} SELECT element, col, {R('stddev_pop(v)')} FROM (SELECT element, timepoint, label AS col, avg(value) AS v FROM signal JOIN parc16 USING (voxel) GROUP BY ALL) GROUP BY ALL")
def parcel_time_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.parcel_aggregation(fx.signal(spark, d), fx.parcels(spark, 4), "mean", time_method="std"))


@query("parcel_masked", w("signal", "parc16", "mask_a", "mask_b") + f"SELECT element, timepoint, label AS col, {R('avg(value)')} FROM signal JOIN parc16 USING (voxel) WHERE voxel IN (SELECT voxel FROM mask_a) AND voxel IN (SELECT voxel FROM mask_b) GROUP BY ALL")
def parcel_masked(spark: SparkSession, d: str) -> DataFrame:
    mask = dims.intersect_masks([fx.mask(spark, "a"), fx.mask(spark, "b")], 1.0)
    return rounded(aggregate.parcel_aggregation(fx.signal(spark, d), fx.parcels(spark, 4), mask=mask))


@query("parcel_empty_label", w("signal", "parc16", "mask_b") + f"SELECT f.element, f.timepoint, l.label AS col, {R('avg(value)')} FROM (SELECT DISTINCT element, timepoint FROM signal) f CROSS JOIN (SELECT DISTINCT label FROM parc16) l LEFT JOIN (SELECT * FROM signal JOIN parc16 USING (voxel) WHERE voxel >= 16) s ON s.element = f.element AND s.timepoint = f.timepoint AND s.label = l.label GROUP BY ALL")
def parcel_empty_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.parcel_aggregation(fx.signal(spark, d), fx.parcels(spark, 4), mask=fx.mask(spark, "b"), labels=fx.labels(4)))


@query("parcel_merge_overlap", _S8_ONLY + f"""SELECT element, timepoint, col, {R('avg(value)')} FROM signal JOIN (
  SELECT voxel, CASE WHEN voxel BETWEEN 8 AND 39 THEN 'over_P' || CAST((voxel - 8) // 8 + 1 AS VARCHAR) ELSE CASE WHEN parcel_id <= 4 THEN 'base_' ELSE '' END || label END AS col FROM parc8) m USING (voxel) GROUP BY ALL""")
def parcel_merge_overlap(spark: SparkSession, d: str) -> DataFrame:
    merged = dims.merge_parcellations([("over", fx.overlapping(spark)), ("base", fx.parcels(spark, 8))])
    return rounded(aggregate.parcel_aggregation(fx.signal(spark, d), merged))


_SPHERE = w("signal", "grid", "seeds")
_D2 = "(g.x - s.x) ** 2 + (g.y - s.y) ** 2 + (g.z - s.z) ** 2"


@query("sphere_mean", f"{_SPHERE} SELECT element, timepoint, seed AS col, {R('avg(value)')} FROM signal JOIN (SELECT voxel, seed FROM grid g JOIN seeds s ON {_D2} <= 1) v USING (voxel) GROUP BY ALL")
def sphere_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.sphere_aggregation(fx.signal(spark, d), fx.grid(spark), fx.seeds(spark), 1.0))


@query("sphere_nearest", f"{_SPHERE} SELECT element, timepoint, seed AS col, {R('value')} FROM signal JOIN (SELECT voxel, seed, row_number() OVER (PARTITION BY seed ORDER BY {_D2}, voxel) AS r FROM grid g CROSS JOIN seeds s) v USING (voxel) WHERE r = 1")
def sphere_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.sphere_aggregation(fx.signal(spark, d), fx.grid(spark), fx.seeds(spark), None))


@query("maps_weighted", w("signal") + f"SELECT element, timepoint, CASE WHEN voxel < 32 THEN 'm1' ELSE 'm2' END AS col, {R('sum(value * (1 + voxel % 4)) / sum((1 + voxel % 4) ** 2)')} FROM signal GROUP BY ALL")
def maps_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.maps_aggregation(fx.signal(spark, d), fx.maps(spark)))


@query("maps_least_squares", w("signal") + f""", s AS (SELECT element, timepoint, sum(value * (1 + voxel % 4)) AS y1, sum(value * (1 + voxel % 3)) AS y2, sum((1 + voxel % 4) ** 2) AS a, sum((1 + voxel % 4) * (1 + voxel % 3)) AS b, sum((1 + voxel % 3) ** 2) AS c FROM signal GROUP BY ALL)
SELECT element, timepoint, 'm1' AS col, {R('(c * y1 - b * y2) / (a * c - b * b)')} FROM s UNION ALL SELECT element, timepoint, 'm2', {R('(a * y2 - b * y1) / (a * c - b * b)')} FROM s""")
def maps_least_squares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.maps_aggregation(fx.signal(spark, d), fx.blended_maps(spark)))


# Masks and other dimension tables.

def _mask(name: str, threshold: float, least: int) -> None:
    @query(name, w("mask_a", "mask_b") + f"SELECT voxel FROM (SELECT voxel FROM mask_a UNION ALL SELECT voxel FROM mask_b) GROUP BY voxel HAVING count(*) >= {least}")
    def _(spark: SparkSession, d: str) -> DataFrame:
        return dims.intersect_masks([fx.mask(spark, "a"), fx.mask(spark, "b")], threshold)


_mask("mask_intersect", 1.0, 2)
_mask("mask_union", 0.0, 1)
_mask("mask_threshold", 0.5, 1)


@query("mask_connected", w("grid", "mask_a", "mask_b").replace("WITH ", "WITH RECURSIVE ") + """, cells AS (SELECT voxel, x, y, z FROM grid WHERE voxel IN (SELECT voxel FROM mask_a) AND voxel IN (SELECT voxel FROM mask_b)),
near AS (SELECT a.voxel AS u, b.voxel AS v FROM cells a JOIN cells b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
reach AS (SELECT voxel AS u, voxel AS v FROM cells UNION SELECT reach.u, near.v FROM reach JOIN near ON near.u = reach.v),
part AS (SELECT u AS voxel, min(v) AS label FROM reach GROUP BY u), size AS (SELECT label, count(*) AS n FROM part GROUP BY label)
SELECT voxel FROM part WHERE label = (SELECT label FROM size ORDER BY n DESC, label LIMIT 1)""")
def mask_connected(spark: SparkSession, d: str) -> DataFrame:
    return dims.intersect_masks([fx.mask(spark, "a"), fx.mask(spark, "b")], 1.0, True, fx.grid(spark))


@query("brain_mask", w("signal") + "SELECT voxel FROM signal GROUP BY voxel HAVING avg(abs(value)) >= 0.1")
def brain_mask(spark: SparkSession, d: str) -> DataFrame:
    return dims.brain_mask(fx.signal(spark, d).groupBy("voxel").agg(F.avg(F.abs("value")).alias("probability")), 0.1)


@query("label_parcels", w("parc8") + ", ids AS (SELECT parcel_id, row_number() OVER (ORDER BY parcel_id) AS r FROM (SELECT DISTINCT parcel_id * 10 AS parcel_id FROM parc8)) SELECT voxel, CAST(parc8.parcel_id * 10 AS INTEGER) AS parcel_id, 'L' || CAST(r - 1 AS VARCHAR) AS label FROM parc8 JOIN ids ON ids.parcel_id = parc8.parcel_id * 10")
def label_parcels(spark: SparkSession, d: str) -> DataFrame:
    names = spark.range(8).select(F.col("id").cast("int").alias("place"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("label"))
    return dims.label_parcels(fx.parcels(spark, 8).select("voxel", (F.col("parcel_id") * 10).alias("parcel_id")), names)


@query("closest_resolution", "SELECT p_partkey, p_size, coalesce((SELECT max(r) FROM (VALUES (5.0::DOUBLE), (10.0), (25.0), (40.0)) v(r) WHERE r <= p_size), 5.0) AS resolution FROM part")
def closest_resolution(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select("p_partkey", "p_size", dims.closest_resolution(F.col("p_size"), [40, 5, 25, 10]).alias("resolution"))


@query("affine_points", w("grid") + "SELECT voxel, CAST(2 * x + 1 AS DOUBLE) AS x, CAST(y - z AS DOUBLE) AS y, CAST(3 * z - 2 AS DOUBLE) AS z FROM grid")
def affine_points(spark: SparkSession, d: str) -> DataFrame:
    return dims.transform_coordinates(fx.grid(spark), [[2, 0, 0, 1], [0, 1, -1, 0], [0, 0, 3, -2]])


@query("warp_lookup", w("signal") + "SELECT element, timepoint, CAST(63 - voxel AS INTEGER) AS voxel, value FROM signal WHERE voxel % 2 = 0")
def warp_lookup(spark: SparkSession, d: str) -> DataFrame:
    lookup = fx.grid(spark).where("voxel % 2 = 0").select("voxel", (63 - F.col("voxel")).alias("target"))
    return dims.warp(fx.signal(spark, d), lookup).select("element", "timepoint", "voxel", "value")


# Connectivity.

_CELLS = 'element, a.col AS "row", CAST(a.idx AS INTEGER) AS row_idx, b.col AS col, CAST(b.idx AS INTEGER) AS col_idx'


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def _fc(name: str, kind: str, value: str) -> None:
    @query(name, w("signal", "parc16", "series16") + f"SELECT {_CELLS}, {R(value)} FROM series16 a JOIN series16 b USING (element, timepoint) WHERE a.idx >= b.idx GROUP BY ALL")
    def _(spark: SparkSession, d: str) -> DataFrame:
        return rounded(connectivity.matrix(_series(spark, d, 4), kind))


_fc("fc_correlation_tril", "correlation", _corr("a.value", "b.value"))
_fc("fc_covariance", "covariance", "covar_pop(a.value, b.value)")


@query("fc_spheres", _SPHERE + f", t AS (SELECT element, timepoint, CAST(CASE seed WHEN 's1' THEN 0 ELSE 1 END AS INTEGER) AS idx, seed AS col, avg(value) AS value FROM signal JOIN (SELECT voxel, seed FROM grid g JOIN seeds s ON {_D2} <= 1) v USING (voxel) GROUP BY ALL) SELECT {_CELLS}, {R(_corr('a.value', 'b.value'))} FROM t a JOIN t b USING (element, timepoint) WHERE a.idx >= b.idx GROUP BY ALL")
def fc_spheres(spark: SparkSession, d: str) -> DataFrame:
    frames = aggregate.sphere_aggregation(fx.signal(spark, d), fx.grid(spark), fx.seeds(spark), 1.0)
    return rounded(connectivity.matrix(aggregate.with_index(frames, ["s1", "s2"])))


@query("fc_maps", w("signal") + f", t AS (SELECT element, timepoint, CAST(voxel // 32 AS INTEGER) AS idx, CASE WHEN voxel < 32 THEN 'm1' ELSE 'm2' END AS col, sum(value * (1 + voxel % 4)) / sum((1 + voxel % 4) ** 2) AS value FROM signal GROUP BY ALL) SELECT {_CELLS}, {R(_corr('a.value', 'b.value'))} FROM t a JOIN t b USING (element, timepoint) WHERE a.idx >= b.idx GROUP BY ALL")
def fc_maps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(connectivity.matrix(aggregate.with_index(aggregate.maps_aggregation(fx.signal(spark, d), fx.maps(spark)), ["m1", "m2"])))


@query("fc_cross", w("signal", "parc16", "parc8", "series16", "series8") + f"SELECT {_CELLS}, {R(_corr('a.value', 'b.value'))} FROM series8 a JOIN series16 b USING (element, timepoint) GROUP BY ALL")
def fc_cross(spark: SparkSession, d: str) -> DataFrame:
    return rounded(connectivity.cross(_series(spark, d, 4), _series(spark, d, 8)))


_RANKED = "ranked AS (SELECT element, timepoint, idx, col, value, rank() OVER (PARTITION BY element, idx ORDER BY value) + (count(*) OVER (PARTITION BY element, idx, value) - 1) / 2.0 AS r, rank() OVER (PARTITION BY element, idx ORDER BY value) AS k FROM series8)"


@query("fc_spearman", f"{_S8}, {_RANKED} SELECT {_CELLS}, {R(_corr('a.r', 'b.r'))} FROM ranked a JOIN ranked b USING (element, timepoint) WHERE a.idx >= b.idx GROUP BY ALL")
def fc_spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(connectivity.spearman(_series(spark, d, 8)))


@query("fc_xi", f"""{_S8}, {_RANKED}, steps AS (SELECT element, a.col AS "row", a.idx AS row_idx, b.col AS col, b.idx AS col_idx, abs(b.k - lag(b.k) OVER (PARTITION BY element, a.idx, b.idx ORDER BY a.value, timepoint)) AS s FROM ranked a JOIN ranked b USING (element, timepoint))
SELECT element, "row", CAST(row_idx AS INTEGER) AS row_idx, col, CAST(col_idx AS INTEGER) AS col_idx, {R('1 - 3.0::DOUBLE * sum(s) / (count(*) * count(*) - 1)')} FROM steps GROUP BY ALL""")
def fc_xi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(connectivity.matrix(_series(spark, d, 8), "xi correlation"))


_COV = "c AS (SELECT element, a.idx AS i, b.idx AS j, covar_pop(a.value, b.value) AS c FROM t a JOIN t b USING (element, timepoint) GROUP BY ALL)"
#: Three series, the covariance matrix in one row, and its inverse by cofactors.
_THREE = f"""{_S8}, t AS (SELECT * FROM series8 WHERE idx < 3), {_COV},
m AS (SELECT element, {", ".join(f"max(c) FILTER (i = {i} AND j = {j}) AS c{i}{j}" for i in range(3) for j in range(i + 1))} FROM c GROUP BY element),
p AS (SELECT element, c00 * (c11 * c22 - c21 * c21) - c10 * (c10 * c22 - c21 * c20) + c20 * (c10 * c21 - c11 * c20) AS det, c11 * c22 - c21 * c21 AS p00, c00 * c22 - c20 * c20 AS p11, c00 * c11 - c10 * c10 AS p22,
  c20 * c21 - c10 * c22 AS p10, c10 * c21 - c11 * c20 AS p20, c10 * c20 - c00 * c21 AS p21 FROM m)"""


def _three(cell: Callable[[int, int], str]) -> str:
    return f"{_THREE} " + " UNION ALL ".join(f"""SELECT element, 'P{i + 1}' AS "row", {i} AS row_idx, 'P{j + 1}' AS col, {j} AS col_idx, {R(cell(i, j))} FROM p""" for i in range(3) for j in range(i + 1))


for _name, _kind, _cell in (
    ("fc_precision", "precision", lambda i, j: f"p{i}{j} / det"),
    ("fc_partial", "partial correlation", lambda i, j: "1.0" if i == j else f"-p{i}{j} / sqrt(p{i}{i} * p{j}{j})"),
):
    query(_name, _three(_cell))(lambda spark, d, kind=_kind: rounded(connectivity.matrix(_series(spark, d, 8).where("idx < 3"), kind)))


#: The shrinkage of Ledoit and Wolf from sums over cells and frames.
@query("fc_ledoit_wolf", f"""{_S8}, n AS (SELECT element, count(DISTINCT timepoint)::DOUBLE AS n, count(DISTINCT idx)::DOUBLE AS k FROM series8 GROUP BY ALL),
z AS (SELECT element, timepoint, idx, col, value - avg(value) OVER (PARTITION BY element, idx) AS value FROM series8),
s AS (SELECT element, a.idx AS i, a.col AS ci, b.idx AS j, b.col AS cj, avg(a.value * b.value) AS s, avg(a.value * a.value * b.value * b.value) AS q FROM z a JOIN z b USING (element, timepoint) GROUP BY ALL),
mu AS (SELECT element, sum(s) FILTER (i = j) / any_value(k) AS mu FROM s JOIN n USING (element) GROUP BY ALL),
d AS (SELECT element, any_value(mu) AS mu, sum((s - CASE WHEN i = j THEN mu ELSE 0 END) ** 2) / any_value(k) AS delta, sum(q - s * s) / (any_value(k) * any_value(n)) AS beta FROM s JOIN mu USING (element) JOIN n USING (element) GROUP BY element),
r AS (SELECT s.*, (1 - least(beta, delta) / delta) * s + CASE WHEN i = j THEN least(beta, delta) / delta * mu ELSE 0 END AS r FROM s JOIN d USING (element))
SELECT a.element, a.ci AS "row", CAST(a.i AS INTEGER) AS row_idx, a.cj AS col, CAST(a.j AS INTEGER) AS col_idx, {R('a.r / sqrt(x.r * y.r)')} FROM r a JOIN r x ON x.element = a.element AND x.i = a.i AND x.j = a.i JOIN r y ON y.element = a.element AND y.i = a.j AND y.j = a.j WHERE a.i >= a.j""")
def fc_ledoit_wolf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(connectivity.matrix(_series(spark, d, 8), "correlation", True))


@query("fc_tangent")
def fc_tangent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(connectivity.tangent(_series(spark, d, 16)))


_E8 = w("signal", "parc8", "series8", "z8", "ets8")


@query("ets", f"{_E8} SELECT element, timepoint, idx, col, {R('value')} FROM ets8")
def ets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(connectivity.edge_series(_series(spark, d, 8)))


@query("rss_ets", f"{_E8} SELECT element, timepoint, {R('sqrt(sum(value * value))')}, 'root_sum_of_squares_ets' AS col FROM ets8 GROUP BY ALL")
def rss_ets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(connectivity.edge_rss(_series(spark, d, 8)))


@query("edge_fc", f"{_E8} SELECT {_CELLS}, {R(_corr('a.value', 'b.value'))} FROM ets8 a JOIN ets8 b USING (element, timepoint) WHERE a.idx >= b.idx GROUP BY ALL")
def edge_fc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(connectivity.edge_connectivity(_series(spark, d, 8)))


_RANGED = f"""{_S8}, x AS (SELECT element, timepoint, idx, col, CASE WHEN (timepoint + idx) % 7 <> 0 THEN value END AS value FROM series8)"""


@query("fc_cross_spearman_missing", f"""{_RANGED}, p AS (SELECT element, a.idx AS row_idx, a.col AS "row", b.idx AS col_idx, b.col AS col, timepoint, a.value AS x, b.value AS y FROM x a JOIN x b USING (element, timepoint) WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY element, row_idx, col_idx ORDER BY x) + (count(*) OVER (PARTITION BY element, row_idx, col_idx, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY element, row_idx, col_idx ORDER BY y) + (count(*) OVER (PARTITION BY element, row_idx, col_idx, y) - 1) / 2.0 AS ry FROM p)
SELECT element, "row", CAST(row_idx AS INTEGER) AS row_idx, col, CAST(col_idx AS INTEGER) AS col_idx, {R(_corr('rx', 'ry'))} FROM r GROUP BY ALL""")
def fc_cross_spearman_missing(spark: SparkSession, d: str) -> DataFrame:
    gaps = _series(spark, d, 8).withColumn("value", F.when((F.col("timepoint") + F.col("idx")) % 7 != 0, F.col("value")))
    return rounded(connectivity.cross(gaps, gaps, "spearman"))


@query("fc_multi_key", w("signal", "parc16", "series16") + f"SELECT 'sub-' || CAST(element // 2 AS VARCHAR) AS subject, 'ses-' || CAST(element % 2 AS VARCHAR) AS session, {_CELLS.removeprefix('element, ')}, {R(_corr('a.value', 'b.value'))} FROM series16 a JOIN series16 b USING (element, timepoint) WHERE a.idx >= b.idx GROUP BY ALL")
def fc_multi_key(spark: SparkSession, d: str) -> DataFrame:
    keys = ["subject", "session"]
    two = fx.signal(spark, d).select(F.concat(F.lit("sub-"), F.floor(F.col("element") / 2).cast("string")).alias("subject"), F.concat(F.lit("ses-"), (F.col("element") % 2).cast("string")).alias("session"), "timepoint", "voxel", "value")
    marker = markers.functional_connectivity("fc", "parcels", {"parcels": fx.parcels(spark, 4)}, fx.labels(4))
    return rounded(marker.features(two, keys)["functional_connectivity"][1])


_THREE_MAPS = "(SELECT voxel, 'm' || CAST(voxel % 3 AS VARCHAR) AS col, CAST(voxel % 3 AS INTEGER) AS idx, 1.0 + voxel % 4 AS w FROM grid)"
_THREE_SEEDS = "(SELECT voxel, s AS col, CAST(i AS INTEGER) AS idx, 1.0 AS w FROM grid g JOIN (VALUES ('s0', 0, 0, 0, 0), ('s1', 1, 3, 0, 0), ('s2', 2, 0, 3, 3)) q(s, i, a, b, c) ON (g.x - a) ** 2 + (g.y - b) ** 2 + (g.z - c) ** 2 <= 1)"


def _edge_sql(regions: str, value: str) -> str:
    return f"""{w('signal', 'grid')}, t AS (SELECT element, timepoint, idx, col, {value} AS value FROM signal JOIN {regions} q USING (voxel) GROUP BY ALL),
z AS (SELECT element, timepoint, idx, col, (value - avg(value) OVER v) / nullif(stddev_pop(value) OVER v, 0) AS value FROM t WINDOW v AS (PARTITION BY element, idx)),
ets AS (SELECT element, timepoint, a.idx * (a.idx - 1) // 2 + b.idx AS idx, a.col || '~' || b.col AS col, a.value * b.value AS value FROM z a JOIN z b USING (element, timepoint) WHERE a.idx > b.idx)
SELECT {_CELLS}, {R(_corr('a.value', 'b.value'))} FROM ets a JOIN ets b USING (element, timepoint) WHERE a.idx >= b.idx GROUP BY ALL"""


@query("edge_fc_spheres", _edge_sql(_THREE_SEEDS, "avg(value)"))
def edge_fc_spheres(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([("s0", 0.0, 0.0, 0.0), ("s1", 3.0, 0.0, 0.0), ("s2", 0.0, 3.0, 3.0)], "seed string, x double, y double, z double")
    return rounded(markers.functional_connectivity("e", "spheres", {"grid": fx.grid(spark), "seeds": seeds}, edges=True, radius=1.0).features(fx.signal(spark, d))["functional_connectivity"][1])


@query("edge_fc_maps", _edge_sql(_THREE_MAPS, "sum(value * w) / sum(w * w)"))
def edge_fc_maps(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("voxel")
    maps = fx.grid(spark).select("voxel", F.concat(F.lit("m"), (v % 3).cast("string")).alias("region"), (1.0 + v % 4).alias("weight"))
    return rounded(markers.functional_connectivity("e", "maps", {"maps": maps}, edges=True).features(fx.signal(spark, d))["functional_connectivity"][1])


@query("pipeline_yaml", w("signal", "parc16", "series16") + f"""SELECT 'sub-' || CAST(element // 2 AS VARCHAR) AS subject, 'ses-' || CAST(element % 2 AS VARCHAR) AS session, {_CELLS.removeprefix('element, ')},
  {R(_corr('a.value', 'b.value'))} FROM series16 a JOIN series16 b USING (element, timepoint) WHERE a.idx >= b.idx AND element BETWEEN 2 AND 7 GROUP BY ALL""")
def pipeline_yaml(spark: SparkSession, d: str) -> DataFrame:
    """A configuration with a source of tables, a named parcellation and a marker, run into a store."""
    with fx.store_folder(spark) as folder:
        two = fx.signal(spark, d).select(F.concat(F.lit("sub-"), F.floor(F.col("element") / 2).cast("string")).alias("subject"), F.concat(F.lit("ses-"), (F.col("element") % 2).cast("string")).alias("session"), "timepoint", "voxel", "value")
        two.write.parquet(f"{folder}/bold.parquet")
        fx.parcels(spark, 4).write.parquet(f"{folder}/parcels.parquet")
        config = {
            "data": [{"kind": "parcellation", "name": "sixteen", "path": f"{folder}/parcels.parquet"}],
            "source": {"kind": "tables", "tables": {"BOLD": f"{folder}/bold.parquet"}, "keys": ["subject", "session"]},
            "markers": [{"kind": "functional_connectivity", "name": "fc", "regions": "parcels", "dims": {"parcels": "sixteen"}}],
            "storage": {"uri": f"{folder}/out", "force_float32": False},
            "elements": ["sub-1", ["sub-2", "ses-0"], ["ses-1", "sub-2"], "sub-3"],
        }
        return rounded(cut(pipeline.run(spark, config).read("BOLD_fc_functional_connectivity")))


# Voxel maps.

_TSNR = "tsnr AS (SELECT element, voxel, avg(value) / nullif(stddev_pop(value), 0) AS v FROM signal GROUP BY ALL)"


@query("tsnr_parcels", f"{_S16}, {_TSNR} SELECT element, label AS col, {R('avg(v)')} FROM tsnr JOIN parc16 USING (voxel) GROUP BY ALL")
def tsnr_parcels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.parcel_aggregation(aggregate.temporal_snr(fx.signal(spark, d)), fx.parcels(spark, 4)).drop("timepoint"))


@query("tsnr_spheres", f"{_SPHERE}, {_TSNR} SELECT element, seed AS col, {R('avg(v)')} FROM tsnr JOIN (SELECT voxel, seed FROM grid g JOIN seeds s ON {_D2} <= 1) q USING (voxel) GROUP BY ALL")
def tsnr_spheres(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.sphere_aggregation(aggregate.temporal_snr(fx.signal(spark, d)), fx.grid(spark), fx.seeds(spark), 1.0).drop("timepoint"))


@query("tsnr_maps", f"{w('signal')}, {_TSNR} SELECT element, CASE WHEN voxel < 32 THEN 'm1' ELSE 'm2' END AS col, {R('sum(v * (1 + voxel % 4)) / sum((1 + voxel % 4) ** 2)')} FROM tsnr GROUP BY ALL")
def tsnr_maps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate.maps_aggregation(aggregate.temporal_snr(fx.signal(spark, d)), fx.maps(spark)).drop("timepoint"))


_DFT = """sized AS (SELECT s.*, n FROM signal s JOIN (SELECT element, max(timepoint) + 1 AS n FROM signal GROUP BY ALL) USING (element)),
waves AS (SELECT element, voxel, n, k, sum(value * cos(2 * pi() * ((k * timepoint) % n) / n)) AS re, sum(value * sin(2 * pi() * ((k * timepoint) % n) / n)) AS im
  FROM (SELECT *, unnest(range(n)) AS k FROM sized) GROUP BY ALL),
amp AS (SELECT element, voxel, n, least(k, n - k) / CAST(n AS DOUBLE) AS f, sqrt(re * re + im * im) AS a FROM waves),
alff AS (SELECT element, voxel, sum(CASE WHEN f > 0.01 AND f < 0.1 THEN a ELSE 0 END) AS num, sum(CASE WHEN f > 0 THEN a ELSE 0 END) AS den, any_value(n) AS n FROM amp GROUP BY ALL)"""


def _alff(name: str, value: str) -> None:
    @query(name, f"{_S16}, {_DFT} SELECT element, label AS col, {R(f'avg({value})')} FROM alff JOIN parc16 USING (voxel) GROUP BY ALL")
    def _(spark: SparkSession, d: str) -> DataFrame:
        voxels = spectral.alff(fx.signal(spark, d)).select("element", "voxel", F.lit(0).alias("timepoint"), F.col(name).alias("value"))
        return rounded(aggregate.parcel_aggregation(voxels, fx.parcels(spark, 4)).drop("timepoint"))


_alff("alff", "num / sqrt(n)")
_alff("falff", "CASE WHEN den > 1e-6 THEN num / den ELSE 0 END")


@query("alff_fft", f"{w('signal')}, {_DFT} SELECT element, voxel, {R('num / sqrt(n)', 'alff')}, {R('CASE WHEN den > 1e-6 THEN num / den ELSE 0 END', 'falff')} FROM alff")
def alff_fft(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.alff(fx.signal(spark, d)), "alff", "falff")


def _reho_sql(n: int) -> str:
    near = ", ".join(f"({a}, {b}, {c})" for a, b, c in reho.neighbours(n))
    return f"""{w('signal', 'grid', 'parc16')}, o(a, b, c) AS (VALUES {near}),
near AS (SELECT p.voxel AS center, q.voxel FROM grid p CROSS JOIN o JOIN grid q ON q.x = p.x + a AND q.y = p.y + b AND q.z = p.z + c),
whole AS (SELECT * FROM near WHERE center IN (SELECT center FROM near GROUP BY center HAVING count(*) = {n})),
ranks AS (SELECT element, timepoint, voxel, rank() OVER (PARTITION BY element, voxel ORDER BY value) + (count(*) OVER (PARTITION BY element, voxel, value) - 1) / 2.0::DOUBLE AS r FROM signal),
ties AS (SELECT element, voxel, sum(t * t * t - t) AS tie FROM (SELECT element, voxel, CAST(count(*) AS DOUBLE) AS t FROM signal GROUP BY element, voxel, value) GROUP BY ALL),
sums AS (SELECT element, center, timepoint, sum(r) AS s FROM ranks JOIN whole USING (voxel) GROUP BY ALL),
sq AS (SELECT element, center, sum(s * s) AS s2, CAST(count(*) AS DOUBLE) AS t FROM sums GROUP BY ALL),
tt AS (SELECT element, center, sum(tie) AS tie FROM ties JOIN whole USING (voxel) GROUP BY ALL),
kw AS (SELECT element, center AS voxel, (12 * s2 - 3 * {n * n} * t * (t + 1) * (t + 1)) / nullif({n * n} * t * (t * t - 1) - {n} * tie, 0) AS kw FROM sq JOIN tt USING (element, center))
SELECT element, label AS col, {R('avg(coalesce(kw, 1))')} FROM (SELECT DISTINCT element, voxel FROM signal) LEFT JOIN kw USING (element, voxel) JOIN parc16 USING (voxel) GROUP BY ALL"""


for _n in (7, 27):
    query(f"reho{_n}", _reho_sql(_n))(lambda spark, d, n=_n: rounded(aggregate.parcel_aggregation(reho.reho(fx.signal(spark, d), fx.grid(spark), n), fx.parcels(spark, 4)).drop("timepoint")))


# The same measures over spheres and maps.

_IN_SPHERES = f"(SELECT voxel, seed FROM grid g JOIN seeds s ON {_D2} <= 1)"
_IN_MAPS = "(SELECT voxel, CASE WHEN voxel < 32 THEN 'm1' ELSE 'm2' END AS seed, (1.0 + voxel % 4) AS w FROM grid)"


def _over(value: str, maps: bool) -> str:
    return R(f"sum({value} * w) / sum(w * w)" if maps else f"avg({value})")


def _regions(spark: SparkSession, maps: bool) -> tuple[str, dict]:
    return ("maps", {"maps": fx.maps(spark), "grid": fx.grid(spark)}) if maps else ("spheres", {"grid": fx.grid(spark), "seeds": fx.seeds(spark), "radius": 1.0})


def _marked(spark: SparkSession, d: str, marker: Callable[..., markers.Marker], feature: str, maps: bool, **params) -> DataFrame:
    """A marker's feature over spheres or maps."""
    kind, data = _regions(spark, maps)
    how = {k: data.pop(k) for k in ("radius",) if k in data}
    return rounded(marker("m", kind, data, **how, **params).features(fx.signal(spark, d))[feature][1])


for _maps in (False, True):
    _of, _in = ("maps", _IN_MAPS) if _maps else ("spheres", _IN_SPHERES)
    for _name, _value in (("alff", "num / sqrt(n)"), ("falff", "CASE WHEN den > 1e-6 THEN num / den ELSE 0 END")):
        query(f"{_name}_{_of}", f"{w('signal', 'grid', 'seeds')}, {_DFT} SELECT element, seed AS col, {_over(_value, _maps)} FROM alff JOIN {_in} q USING (voxel) GROUP BY ALL")(
            lambda spark, d, name=_name, maps=_maps: _marked(spark, d, markers.alff, name, maps)
        )
    query(f"reho7_{_of}", _reho_sql(7).replace("voxel)) v", "voxel)) v").replace("SELECT element, label AS col, round(avg(coalesce(kw, 1)), 6) + 0.0 AS value", f"SELECT element, seed AS col, {_over('coalesce(kw, 1)', _maps)}").replace("JOIN parc16 USING (voxel) GROUP BY ALL", f"JOIN {_in} q USING (voxel) GROUP BY ALL").replace(w("signal", "grid", "parc16").rstrip(), w("signal", "grid", "seeds").rstrip()))(
        lambda spark, d, maps=_maps: _marked(spark, d, markers.regional_homogeneity, "reho", maps, nneigh=7)
    )


# Complexity.

def _pe_sql(m: int, weight: str) -> str:
    leads = ", ".join(f"lead(value, {k}) OVER w AS v{k}" for k in range(m))
    pairs = ", ".join(f"{{'v': v{k}, 'k': {k}}}" for k in range(m))
    return f"""{_S8}, e AS (SELECT element, col, {leads} FROM series8 WINDOW w AS (PARTITION BY element, col ORDER BY timepoint)),
p AS (SELECT element, col, CAST(list_transform(list_sort([{pairs}]), lambda x: x.k) AS VARCHAR) AS p, sum({weight}) AS c FROM e WHERE v{m - 1} IS NOT NULL GROUP BY ALL),
s AS (SELECT element, col, c / sum(c) OVER (PARTITION BY element, col) AS s FROM p)
SELECT element, col, {R(f'-sum(CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END) / ln(factorial({m}))')} FROM s GROUP BY ALL"""


_MEAN4 = "((v0 + v1 + v2 + v3) / 4)"
query("perm_entropy", _pe_sql(4, "1.0::DOUBLE"))(lambda spark, d: rounded(complexity.perm_entropy(_series(spark, d, 8))))
query("wperm_entropy", _pe_sql(4, " + ".join(f"(v{k} - {_MEAN4}) ** 2 / 4" for k in range(4))))(lambda spark, d: rounded(complexity.perm_entropy(_series(spark, d, 8), weighted=True)))

_SE = f"""{_S8}, e AS (SELECT element, col, timepoint, value AS v0, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2, 0.5 * stddev_pop(value) OVER (PARTITION BY element, col) AS r FROM series8 WINDOW w AS (PARTITION BY element, col ORDER BY timepoint)),
m AS (SELECT element, a.col AS col, count(*) AS b, count(*) FILTER (abs(a.v2 - b.v2) <= a.r) AS a FROM e a JOIN e b USING (element, col) WHERE a.timepoint <> b.timepoint AND a.v2 IS NOT NULL AND b.v2 IS NOT NULL AND abs(a.v0 - b.v0) <= a.r AND abs(a.v1 - b.v1) <= a.r GROUP BY ALL)
SELECT element, col, {R('-ln(a / CAST(b AS DOUBLE))')} FROM m"""
query("sample_entropy", _SE)(lambda spark, d: rounded(complexity.complexity(_series(spark, d, 8), "sample_entropy", m=2)))

def _range_sql(tolerances: str) -> str:
    """Matches of segments of two and of three values for each tolerance; distances are (max - min) / (max + min)."""
    spread = lambda n: f"(list_max([{n}]) - list_min([{n}])) / nullif(list_max([{n}]) + list_min([{n}]), 0)"
    two, three = (", ".join(f"abs(a.v{k} - b.v{k})" for k in range(n)) for n in (2, 3))
    return f"""{_S8}, e AS (SELECT element, col, timepoint, value AS v0, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2 FROM series8 WINDOW w AS (PARTITION BY element, col ORDER BY timepoint)),
d AS (SELECT element, a.col AS col, coalesce({spread(two)}, 0) AS d2, coalesce({spread(three)}, 0) AS d3 FROM e a JOIN e b USING (element, col) WHERE a.timepoint <> b.timepoint AND a.v2 IS NOT NULL AND b.v2 IS NOT NULL),
m AS (SELECT element, col, tol, count(*) FILTER (d2 <= tol) AS b, count(*) FILTER (d3 <= tol) AS a FROM d CROSS JOIN ({tolerances}) t(tol) GROUP BY ALL),
h AS (SELECT element, col, tol, CASE WHEN a > 0 AND b > 0 THEN -ln(a / CAST(b AS DOUBLE)) END AS h FROM m)"""


query("range_entropy", f"{_range_sql('VALUES (0.5::DOUBLE)')} SELECT element, col, coalesce(round(h, 6) + 0.0, 'nan'::DOUBLE) AS value FROM h")(lambda spark, d: rounded(complexity.complexity(_series(spark, d, 8), "range_entropy")))
query("range_entropy_auc", f"{_range_sql('SELECT k / 10.0::DOUBLE FROM range(10) r(k)')} SELECT element, col, {R('sum(coalesce(h, 0) * CASE WHEN tol = 0 OR tol = 0.9 THEN 0.5 ELSE 1 END) / 10')} FROM h GROUP BY ALL")(
    lambda spark, d: rounded(complexity.complexity(_series(spark, d, 8), "range_entropy_auc"))
)
_LONG = f"""{_S8}, x AS (SELECT element, col, value, row_number() OVER o - 1 AS t, count(*) OVER p AS n, avg(value) OVER p AS mean, 0.5 * stddev_pop(value) OVER p AS r FROM series8 WINDOW p AS (PARTITION BY element, col), o AS (PARTITION BY element, col ORDER BY timepoint))"""


@query("multiscale_entropy_auc", f"""{_LONG}, c AS (SELECT element, col, s, t // s AS g, avg(value) AS v, any_value(r) AS r FROM x CROSS JOIN range(1, 11) q(s) WHERE t < (n // s) * s AND n // s > 3 GROUP BY ALL),
e AS (SELECT element, col, s, g, r, v AS v0, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2 FROM c WINDOW w AS (PARTITION BY element, col, s ORDER BY g)),
m AS (SELECT element, col, s, count(*) AS b, count(*) FILTER (abs(a.v2 - b.v2) <= a.r) AS a FROM e a JOIN e b USING (element, col, s) WHERE a.g <> b.g AND a.v2 IS NOT NULL AND b.v2 IS NOT NULL AND abs(a.v0 - b.v0) <= a.r AND abs(a.v1 - b.v1) <= a.r GROUP BY ALL),
h AS (SELECT element, col, s, -ln(a / CAST(b AS DOUBLE)) AS h FROM m WHERE a > 0)
SELECT element, col, {R('(sum(h) - (arg_min(h, s) + arg_max(h, s)) / 2) / count(*)')} FROM h GROUP BY ALL""")
def multiscale_entropy_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(complexity.complexity(_series(spark, d, 8), "multiscale_entropy_auc"))


@query("hurst_dfa", f"""{_LONG}, y AS (SELECT element, col, t, n, sum(value - mean) OVER (PARTITION BY element, col ORDER BY t) AS y FROM x),
most AS (SELECT element, col, any_value(n) AS n, greatest(any_value(n) // 10, CASE WHEN any_value(n) < 160 THEN any_value(n) // 4 ELSE 0 END, 5) AS m FROM y GROUP BY ALL),
sizes AS (SELECT DISTINCT element, col, n, CAST(round(4 * (m / 4.0::DOUBLE) ** (k / 15.0::DOUBLE)) AS BIGINT) AS s FROM most CROSS JOIN range(16) r(k)),
starts AS (SELECT element, col, s, unnest(range(0, n - s + 1, greatest(1, s // 2))) AS st FROM sizes WHERE s BETWEEN 3 AND n),
rest AS (SELECT element, col, s, st, var_pop(y) - covar_pop(y, t) ** 2 / var_pop(t) AS v FROM starts JOIN y USING (element, col) WHERE t BETWEEN st AND st + s - 1 GROUP BY ALL),
f AS (SELECT element, col, s, sqrt(avg(v)) AS f FROM rest GROUP BY ALL)
SELECT element, col, {R('regr_slope(ln(f), ln(s))')} FROM f WHERE f > 0 GROUP BY ALL""")
def hurst_dfa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(complexity.complexity(_series(spark, d, 8), "hurst_exponent"))


# Preprocessing.

@query("slice_time", w("signal") + "SELECT element, timepoint - 5 AS timepoint, voxel, value FROM signal WHERE timepoint >= 5 AND timepoint < 15")
def slice_time(spark: SparkSession, d: str) -> DataFrame:
    return prep.slice_time(fx.signal(spark, d), *prep.slice_bounds(40, 10, None, 20, 2.0))


@query("detrend", w("signal") + f"SELECT element, timepoint, voxel, {R('value - (regr_intercept(value, timepoint) OVER w + regr_slope(value, timepoint) OVER w * timepoint)')} FROM signal WINDOW w AS (PARTITION BY element, voxel)")
def detrend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prep.detrend(fx.signal(spark, d))).select("element", "timepoint", "voxel", "value")


@query("zscore", w("signal") + f"SELECT element, timepoint, voxel, {R('coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0)')} FROM signal WINDOW w AS (PARTITION BY element, voxel)")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prep.standardise(fx.signal(spark, d))).select("element", "timepoint", "voxel", "value")


_GAIN = "CASE WHEN k = 0 THEN 0 ELSE 1 / (1 + (f / 0.2) ** 10) / (1 + (0.02 / f) ** 10) END"


@query("band_pass", w("signal") + f""", d AS (SELECT element, timepoint, voxel, value - (regr_intercept(value, timepoint) OVER v + regr_slope(value, timepoint) OVER v * timepoint) AS value, count(*) OVER v AS n FROM signal WHERE voxel < 16 WINDOW v AS (PARTITION BY element, voxel)),
s AS (SELECT element, voxel, n, k, least(k, n - k) / CAST(n AS DOUBLE) AS f, sum(value * cos(2 * pi() * ((k * timepoint) % n) / n)) AS re, sum(value * sin(2 * pi() * ((k * timepoint) % n) / n)) AS im FROM (SELECT *, unnest(range(n)) AS k FROM d) GROUP BY ALL),
g AS (SELECT *, {_GAIN} AS gain FROM s),
b AS (SELECT element, voxel, t AS timepoint, sum(gain * (re * cos(2 * pi() * ((k * t) % n) / n) + im * sin(2 * pi() * ((k * t) % n) / n))) / any_value(n) AS value FROM (SELECT *, unnest(range(n)) AS t FROM g) GROUP BY ALL)
SELECT element, CAST(timepoint AS INTEGER) AS timepoint, voxel, round((value - avg(value) OVER v) / stddev_samp(value) OVER v, 5) + 0.0 AS value FROM b WINDOW v AS (PARTITION BY element, voxel)""")
def band_pass(spark: SparkSession, d: str) -> DataFrame:
    found = prep.temporal_filter(fx.signal(spark, d).where("voxel < 16"), low_pass=0.2, high_pass=0.02)
    return found.select("element", "timepoint", "voxel", (F.round("value", 5) + F.lit(0.0)).alias("value"))


_CONF = w("ev", "confounds")
_PLAN = {"select": ["csf", "csf_derivative1", "csf_power2", "csf_derivative1_power2"], "derivatives": ["csf_derivative1"], "squares": ["csf_power2", "csf_derivative1_power2"]}
_FIRST = lambda c: f"CASE WHEN timepoint = 0 AND {c} IS NULL THEN lead({c}) OVER w ELSE {c} END"


@query("confounds_derive", f"""{_CONF}, a AS (SELECT *, csf - lag(csf) OVER (PARTITION BY element ORDER BY timepoint) AS d FROM confounds), b AS (SELECT *, csf * csf AS p, d * d AS q FROM a)
SELECT element, timepoint, {', '.join(R(_FIRST(c), n) for c, n in (('csf', 'csf'), ('d', 'csf_derivative1'), ('p', 'csf_power2'), ('q', 'csf_derivative1_power2')))} FROM b WINDOW w AS (PARTITION BY element ORDER BY timepoint)""")
def confounds_derive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prep.pick_confounds(fx.confounds(spark, d), _PLAN), *_PLAN["select"])


@query("confounds_spike", f"{_CONF} SELECT element, timepoint, {R(_FIRST('csf'), 'csf')}, CASE WHEN framewise_displacement > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS spike FROM confounds WINDOW w AS (PARTITION BY element ORDER BY timepoint)")
def confounds_spike(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prep.pick_confounds(fx.confounds(spark, d), {"select": ["csf"], "derivatives": [], "squares": []}, spike=0.5), "csf")


@query("scrub", f"""{_CONF}, calm AS (SELECT element, timepoint, timepoint - row_number() OVER (PARTITION BY element ORDER BY timepoint) AS run FROM confounds
  WHERE NOT (coalesce(framewise_displacement > 0.5, false) OR coalesce(std_dvars > 1.5, false)))
SELECT element, timepoint FROM (SELECT *, count(*) OVER (PARTITION BY element, run) AS n FROM calm) WHERE n >= 3""")
def scrub(spark: SparkSession, d: str) -> DataFrame:
    return prep.scrub(fx.confounds(spark, d), segment=3)


@query("scrub_nan", f"""{_CONF} SELECT element, timepoint FROM confounds WHERE NOT (coalesce(framewise_displacement > 0.5 AND timepoint > 0, false) OR coalesce(std_dvars > 1.5 AND timepoint > 0, false))""")
def scrub_nan(spark: SparkSession, d: str) -> DataFrame:
    gone = lambda c: F.when(F.col("timepoint") == 0, F.lit(float("nan"))).otherwise(F.col(c))  # noqa: E731  as a first frame has it
    return prep.scrub(fx.confounds(spark, d).withColumns({c: gone(c) for c in ("framewise_displacement", "std_dvars")}))


_MOVED = "fd AS (SELECT element, timepoint, max(abs(value)) FILTER (voxel < 8) * 2 AS fd, avg(value) FILTER (voxel = 0) AS csf, avg(value) FILTER (voxel = 1) AS white_matter FROM signal GROUP BY ALL)"
_FREED = lambda c, by, src, x: f"{c} - avg({c}) OVER {by} - covar_pop({c}, {x}) OVER {by} / nullif(var_pop({x}) OVER {by}, 0) * ({x} - avg({x}) OVER {by}) AS {c}"  # noqa: E731, ARG005


@query("confound_remover", f"""{w('signal')}, {_MOVED}, calm AS (SELECT * FROM fd WHERE NOT fd > 0.5),
x AS (SELECT element, timepoint, {_FREED('csf', 'e', '', 'timepoint')}, {_FREED('white_matter', 'e', '', 'timepoint')} FROM calm WINDOW e AS (PARTITION BY element)),
x1 AS (SELECT element, timepoint, csf, {_FREED('white_matter', 'e', '', 'csf')} FROM x WINDOW e AS (PARTITION BY element)),
y AS (SELECT element, voxel, timepoint, {_FREED('value', 'v', '', 'timepoint')} FROM signal JOIN calm USING (element, timepoint) WINDOW v AS (PARTITION BY element, voxel)),
y0 AS (SELECT y.*, csf, white_matter FROM y JOIN x1 USING (element, timepoint)),
y1 AS (SELECT element, voxel, timepoint, {_FREED('value', 'v', '', 'csf')}, white_matter FROM y0 WINDOW v AS (PARTITION BY element, voxel)),
y2 AS (SELECT element, voxel, timepoint, {_FREED('value', 'v', '', 'white_matter')} FROM y1 WINDOW v AS (PARTITION BY element, voxel))
SELECT element, voxel, timepoint, round((value - avg(value) OVER v) / stddev_samp(value) OVER v, 4) + 0.0 AS value FROM y2 WHERE voxel >= 2 WINDOW v AS (PARTITION BY element, voxel)""")
def confound_remover(spark: SparkSession, d: str) -> DataFrame:
    s = fx.signal(spark, d)
    first = lambda k: F.avg(F.when(F.col("voxel") == k, F.col("value")))
    moved = s.groupBy("element", "timepoint").agg((F.max(F.when(F.col("voxel") < 8, F.abs("value"))) * 2).alias("framewise_displacement"), F.lit(0.0).alias("std_dvars"), first(0).alias("csf"), first(1).alias("white_matter"))
    freed = prep.confound_remover(s.where("voxel >= 2"), moved, {"wm_csf": "basic"}, scrub_segment=0, fd_threshold=0.5)
    return freed.withColumn("value", F.round("value", 4) + F.lit(0.0))


@query("confound_regress1", f"""{w('ev')}, x AS (SELECT element, timepoint, value AS x FROM ev WHERE col = 'view'), j AS (SELECT ev.element, col, timepoint, value, x FROM ev JOIN x USING (element, timepoint) WHERE col <> 'view')
SELECT element, col, timepoint, {R('value - avg(value) OVER w - coalesce(covar_pop(value, x) OVER w / nullif(var_pop(x) OVER w, 0), 0) * (x - avg(x) OVER w)')} FROM j WINDOW w AS (PARTITION BY element, col)""")
def confound_regress1(spark: SparkSession, d: str) -> DataFrame:
    events = fx.ev(spark, d)
    return rounded(prep.regress_one(events.where("col <> 'view'"), events.where("col = 'view'").withColumnRenamed("value", "x"), by="col"))


def _residuals(k: int) -> str:
    """Regression on k confounds, one after the other, each freed of those before it."""
    steps, names = [], [f"n{j}" for j in range(k)]
    steps.append("x0 AS (SELECT element, timepoint, " + ", ".join(f"max(value) FILTER (voxel = {j}) AS n{j}" for j in range(k)) + " FROM signal GROUP BY ALL)")
    for j in range(k):
        over = "OVER (PARTITION BY element)"
        rest = lambda c: f"{c} - avg({c}) {over} - covar_pop({c}, n{j}) {over} / nullif(var_pop(n{j}) {over}, 0) * (n{j} - avg(n{j}) {over}) AS {c}"  # noqa: E731, B023
        steps.append(f"x{j + 1} AS (SELECT element, timepoint, {', '.join([*names[: j + 1], *map(rest, names[j + 1 :])])} FROM x{j})")
    steps.append(f"y0 AS (SELECT element, timepoint, voxel, value AS y, {', '.join(names)} FROM signal JOIN x{k} USING (element, timepoint) WHERE voxel >= {k})")
    for j in range(k):
        over = "OVER (PARTITION BY element, voxel)"
        steps.append(f"y{j + 1} AS (SELECT element, timepoint, voxel, y - avg(y) {over} - covar_pop(y, n{j}) {over} / nullif(var_pop(n{j}) {over}, 0) * (n{j} - avg(n{j}) {over}) AS y, {', '.join(names)} FROM y{j})")
    return w("signal") + ", " + ", ".join(steps) + f" SELECT element, voxel, timepoint, {R('y')} FROM y{k}"


@query("confound_regress_k", _residuals(4))
def confound_regress_k(spark: SparkSession, d: str) -> DataFrame:
    s = fx.signal(spark, d)
    noise = s.where("voxel < 4").groupBy("element", "timepoint").pivot("voxel", [0, 1, 2, 3]).agg(F.first("value")).toDF("element", "timepoint", "n0", "n1", "n2", "n3")
    return rounded(prep.remove_confounds(s.where("voxel >= 4"), noise))


@query("smooth_grid", w("signal", "grid") + f""", k AS (SELECT p.voxel AS v, q.voxel, exp(-((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) / (2 * (1.5 / sqrt(8 * ln(2))) ** 2)) AS g
  FROM grid p CROSS JOIN grid q)
SELECT element, timepoint, v AS voxel, {R('sum(g * value) / sum(g)')} FROM signal JOIN k USING (voxel) GROUP BY ALL""")
def smooth_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prep.smooth(fx.signal(spark, d), fx.grid(spark), 1.5))


# Elements and sources.

def _pairs_of(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment")).distinct()


_PAIRS = "WITH e AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer) "


@query("elements_intersect", "SELECT CAST(c_nationkey AS VARCHAR) AS nation FROM customer INTERSECT SELECT CAST(s_nationkey AS VARCHAR) FROM supplier")
def elements_intersect(spark: SparkSession, d: str) -> DataFrame:
    return elements.intersect([_pairs_of(spark, d).select("nation"), fx.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("nation"))])


@query("elements_combine", _PAIRS + "SELECT nation, segment, n_name FROM e JOIN nation ON CAST(n_nationkey AS VARCHAR) = nation")
def elements_combine(spark: SparkSession, d: str) -> DataFrame:
    return elements.combine([_pairs_of(spark, d), fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("nation"), "n_name")], ["nation"])


@query("elements_semi", _PAIRS + "SELECT nation, segment FROM e WHERE nation IN (SELECT CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000)")
def elements_semi(spark: SparkSession, d: str) -> DataFrame:
    rich = fx.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("string").alias("nation"))
    return patterns.semi(_pairs_of(spark, d), rich, ["nation"])


@query("elements_filter", _PAIRS + "SELECT nation, segment FROM e WHERE nation = '3' OR segment = '3' OR (nation = '7' AND segment = 'BUILDING')")
def elements_filter(spark: SparkSession, d: str) -> DataFrame:
    return elements.select(_pairs_of(spark, d), ["3", ("BUILDING", "7")])


@query("elements_lines", _PAIRS + "SELECT nation || ',' || segment AS line FROM e")
def elements_lines(spark: SparkSession, d: str) -> DataFrame:
    return elements.as_lines(_pairs_of(spark, d))


@query("elements_product_exclude", """SELECT s AS subject, e AS session, t AS task, p AS phase_encoding, CASE p WHEN 'AP' THEN '1' ELSE '2' END AS run
FROM (VALUES ('f1'), ('f2'), ('f3')) a(s), (VALUES ('wave1'), ('wave2')) b(e), (VALUES ('Rest'), ('Stroop')) c(t), (VALUES ('AP'), ('PA')) g(p) WHERE NOT (s = 'f2' AND e = 'wave2' AND t = 'Rest')""")
def elements_product_exclude(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([("f2", "wave2", "Rest")], "subject string, session string, task string")
    return elements.session_elements(spark, ["f1", "f2", "f3"], ["wave1", "wave2"], ["Rest", "Stroop"], ["AP", "PA"], gone)


@query("elements_tasks", """SELECT s AS subject, t AS task, p AS phase_encoding, CASE WHEN t LIKE 'REST%' THEN 'rfMRI_' ELSE 'tfMRI_' END || t || '_' || p AS name
FROM (VALUES ('a'), ('b')) x(s), (VALUES ('REST1'), ('WM')) y(t), (VALUES ('LR'), ('RL')) z(p)""")
def elements_tasks(spark: SparkSession, d: str) -> DataFrame:
    return elements.task_elements(spark, ["a", "b"], ["REST1", "WM"], ["LR", "RL"])


_URL = "^(https?)://([^/]+?)/([^/]+?)/([^/]+?)$"


@query("pattern_parse", "SELECT " + ", ".join(f"regexp_extract(url, '{_URL}', {k}) AS {n}" for k, n in enumerate(("scheme", "host", "lang", "page"), 1)) + f", url AS path FROM pages WHERE regexp_matches(url, '{_URL}')")
def pattern_parse(spark: SparkSession, d: str) -> DataFrame:
    return patterns.parse(fx.table(spark, d, "pages"), "{scheme}://{host}/{lang}/{page}", ["scheme", "host", "lang", "page"], F.col("url"))


@query("pattern_repeated", "SELECT n_name AS nation, c_mktsegment AS segment, n_name || '/' || c_mktsegment || '_' || n_name || '_run-' || CAST(c_custkey % 10 AS VARCHAR) AS path FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0")
def pattern_repeated(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "customer").join(fx.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    second = F.when(F.col("c_custkey") % 3 == 0, "other").otherwise(F.col("n_name"))
    files = c.select(F.concat("n_name", F.lit("/"), "c_mktsegment", F.lit("_"), second, F.lit("_run-"), (F.col("c_custkey") % 10).cast("string")).alias("path"))
    return patterns.parse(files, "{nation}/{segment}_{nation}_run-[0-9]", ["nation", "segment"])


@query("pack_frames", w("signal") + "SELECT element, timepoint, list(value ORDER BY voxel) AS values FROM signal GROUP BY ALL")
def pack_frames(spark: SparkSession, d: str) -> DataFrame:
    return readers.pack(fx.signal(spark, d), ["element"])


@query("unpack_frames", w("signal") + "SELECT element, timepoint, voxel, value FROM signal")
def unpack_frames(spark: SparkSession, d: str) -> DataFrame:
    return readers.unpack(readers.pack(fx.signal(spark, d), ["element"]), ["element"])


# Storage.

def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = fx.table(spark, d, "customer")
    return c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)


_OLD, _NEW = "SELECT * FROM customer WHERE c_custkey % 2 = 0", "SELECT * REPLACE (c_acctbal + 1 AS c_acctbal) FROM customer WHERE c_custkey % 3 = 0"
query("upsert_update", f"{_NEW} UNION ALL {_OLD} AND c_custkey % 3 <> 0")(lambda spark, d: store.upsert(*_old_new(spark, d), ["c_custkey"], "update"))
query("upsert_ignore", f"{_OLD} UNION ALL {_NEW} AND c_custkey % 2 <> 0")(lambda spark, d: store.upsert(*_old_new(spark, d), ["c_custkey"], "ignore"))
query("append_dedup", f"{_NEW} AND c_custkey % 2 <> 0")(lambda spark, d: store.not_stored(*_old_new(spark, d)[::-1], ["c_custkey"]))


@query("collect_union", "SELECT CAST(c_custkey AS VARCHAR) AS customer, c_mktsegment AS col, CAST(c_acctbal AS DOUBLE) AS value FROM customer")
def collect_union(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer"), F.col("c_mktsegment").alias("col"), F.lit(0).alias("col_idx"), F.col("c_acctbal").alias("value"))
    with fx.store_folder(spark) as folder:
        parts = [store.FeatureStore(spark, f"{folder}/part{k}", ["customer"], force_float32=False) for k in range(3)]
        for k, part in enumerate(parts):  # the parts share some customers
            part.store("vector", c.where(f"customer % 3 = {k} OR customer % 7 = 0"), {"element": {"customer": ""}, "type": "BOLD", "marker": {"name": "balance"}})
        whole = store.FeatureStore(spark, f"{folder}/whole", ["customer"], force_float32=False)
        whole.collect(parts)
        return cut(whole.read("BOLD_balance").select("customer", "col", "value"))


_F8 = w("signal", "parc8", "series8", "fc8")


def _fc8(spark: SparkSession, d: str) -> DataFrame:
    return connectivity.matrix(_series(spark, d, 8))


@query("matrix_triu", w("signal", "parc8", "series8", "fc8") + f"""SELECT element, col || '~' || "row" AS col, CAST(row_number() OVER (PARTITION BY element ORDER BY col_idx, row_idx) - 1 AS INTEGER) AS col_idx, {R('value')} FROM fc8""")
def matrix_triu(spark: SparkSession, d: str) -> DataFrame:
    upper = _fc8(spark, d).select("element", F.col("col").alias("row"), F.col("col_idx").alias("row_idx"), F.col("row").alias("col"), F.col("row_idx").alias("col_idx"), "value")
    return rounded(store.matrix_to_vector(upper, "triu"))


@query("matrix_tril_nodiag", f"""{_F8} SELECT element, "row" || '~' || col AS col, CAST(row_number() OVER (PARTITION BY element ORDER BY row_idx, col_idx) - 1 AS INTEGER) AS col_idx, {R('value')} FROM fc8 WHERE row_idx > col_idx""")
def matrix_tril_nodiag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(store.matrix_to_vector(_fc8(spark, d), "tril", False))


@query("pivot_wide", f"{_S8} SELECT element, timepoint, " + ", ".join(f"round(max(value) FILTER (col = 'P{k}'), 6) + 0.0 AS P{k}" for k in range(1, 9)) + " FROM series8 GROUP BY ALL")
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(store.wide(_series(spark, d, 8), ["element", "timepoint"], fx.labels(8)), *fx.labels(8))


@query("unpivot_long", "SELECT l_orderkey, l_linenumber, col, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR col IN (l_quantity, l_discount, l_tax))")
def unpivot_long(spark: SparkSession, d: str) -> DataFrame:
    return store.long(fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"])


# Transforms at reading.

def _full8(spark: SparkSession, d: str) -> DataFrame:
    return onthefly.full_matrix(_fc8(spark, d))


def _nan8(spark: SparkSession, d: str) -> DataFrame:
    gone = (F.col("element") == 3) & (F.col("row") == "P2") & F.col("col").isin("P2", "P3")
    return _full8(spark, d).withColumn("value", F.when(~gone, F.col("value")))


_N8 = w("signal", "parc8", "series8", "fc8", "full8", "nan8")
for _policy, _where in {
    "drop_element": "element <> 3", "drop_rows": "NOT (element = 3 AND \"row\" = 'P2')", "drop_columns": "NOT (element = 3 AND col IN ('P2', 'P3'))",
    "drop_symmetric": "NOT (element = 3 AND (\"row\" IN ('P2', 'P3') OR col IN ('P2', 'P3')))",
}.items():
    query(f"nan_{_policy}", f'{_N8} SELECT element, "row", col, {R("value")} FROM nan8 WHERE {_where}')(lambda spark, d, p=_policy: rounded(onthefly.nan_policy(_nan8(spark, d), p)).select("element", "row", "col", "value"))


def _thin8(spark: SparkSession, d: str) -> DataFrame:
    return _full8(spark, d).withColumn("value", F.when((F.col("row") != F.col("col")) & (F.abs("value") >= 0.1), F.col("value")).otherwise(0.0))


_T8 = w("signal", "parc8", "series8", "fc8", "full8", "thin8")
query("degrees_und", f'{_T8} SELECT element, "row" AS node, CAST(count(*) FILTER (value <> 0) AS DOUBLE) AS value FROM thin8 GROUP BY ALL')(lambda spark, d: onthefly.read_transform(_thin8(spark, d), "degrees_und"))
query("strengths_und", f'{_T8} SELECT element, "row" AS node, {R("sum(value)")} FROM thin8 GROUP BY ALL')(lambda spark, d: rounded(onthefly.read_transform(_thin8(spark, d), "strengths_und")))
query("clustering_coef_wu", f"""{_T8}, e AS (SELECT element, "row" AS i, col AS j, sign(value) * abs(value) ** (1.0::DOUBLE / 3) AS c FROM thin8 WHERE value <> 0),
t AS (SELECT element, a.i AS node, sum(a.c * b.c * d.c) AS t FROM e a JOIN e b USING (element) JOIN e d USING (element) WHERE a.j = b.i AND b.j = d.i AND d.j = a.i GROUP BY ALL),
k AS (SELECT element, "row" AS node, count(*) FILTER (value <> 0) AS k FROM thin8 GROUP BY ALL)
SELECT element, node, {R("CASE WHEN k < 2 THEN 0 ELSE coalesce(t, 0) / (k * (k - 1)) END")} FROM k LEFT JOIN t USING (element, node)""")(lambda spark, d: rounded(onthefly.read_transform(_thin8(spark, d), "clustering_coef_wu")))
query("eigenvector_centrality", w("signal", "parc8", "series8", "fc8", "full8").replace("WITH ", "WITH RECURSIVE ") + f""", a AS (SELECT element, list(value ORDER BY "row", col) AS a, count(DISTINCT "row") AS k, list(DISTINCT "row" ORDER BY "row") AS names FROM full8 GROUP BY element),
shifted AS (SELECT element, k, names, list_transform(range(k * k), lambda i: a[i + 1] + CASE WHEN i // k = i % k THEN k ELSE 0 END) AS a FROM a),
p AS (SELECT element, k, names, a, 0 AS step FROM shifted UNION ALL SELECT element, k, names,
    list_transform(range(k * k), lambda i: list_sum(list_transform(range(k), lambda m: a[(i // k) * k + m + 1] * a[m * k + i % k + 1])) / list_max(list_transform(a, lambda x: abs(x)))), step + 1 FROM p WHERE step < 12),
v AS (SELECT element, names, unnest(range(k)) AS i, a, k FROM p WHERE step = 12),
best AS (SELECT element, any_value(k) AS k, any_value(names) AS names, any_value(a) AS a, arg_max(i, a[i * k + i + 1]) AS c FROM v GROUP BY element),
e AS (SELECT element, names[i + 1] AS node, a[i * k + c + 1] AS x FROM (SELECT *, unnest(range(k)) AS i FROM best))
SELECT element, node, {R('abs(x) / sqrt(sum(x * x) OVER (PARTITION BY element))')} FROM e""")(lambda spark, d: rounded(onthefly.read_transform(_full8(spark, d), "eigenvector_centrality_und")))

_EIGEN = """WITH l AS (SELECT l_suppkey AS subject, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS ev, l_extendedprice AS value FROM lineitem),
size AS (SELECT l_suppkey AS subject, sum(l_quantity) AS area, sum(l_tax) + 1 AS volume FROM lineitem GROUP BY ALL) """


def _eigen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    items = fx.table(spark, d, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber")
    spectrum = items.select(F.col("l_suppkey").alias("subject"), F.row_number().over(order).alias("ev"), F.col("l_extendedprice").alias("value"))
    sizes = items.groupBy(F.col("l_suppkey").alias("subject")).agg(F.sum("l_quantity").alias("area"), (F.sum("l_tax") + 1).alias("volume"))
    return spectrum, sizes


query("normalize_surface", _EIGEN + "SELECT subject, CAST(ev AS INTEGER) AS ev, round(value * area, 4) AS value FROM l JOIN size USING (subject)")(lambda spark, d: onthefly.normalize(*_eigen(spark, d), "surface", ["subject"]).withColumn("value", F.round("value", 4)))
query("normalize_volume", _EIGEN + "SELECT subject, CAST(ev AS INTEGER) AS ev, round(value * volume ** (2.0::DOUBLE / 3), 4) AS value FROM l JOIN size USING (subject)")(lambda spark, d: onthefly.normalize(*_eigen(spark, d), "volume", ["subject"]).withColumn("value", F.round("value", 4)))
query("reweight", _EIGEN + "SELECT subject, CAST(ev AS INTEGER) AS ev, value / ev AS value FROM l")(lambda spark, d: onthefly.reweight(_eigen(spark, d)[0], "ev", ["subject"]))


# The catalog, from a store in a folder of its own, which is deleted again.

def _stored(spark: SparkSession, d: str, read: Callable[[store.FeatureStore], DataFrame]) -> DataFrame:
    with fx.store_folder(spark) as folder:
        kept = store.FeatureStore(spark, folder, ["element"])
        for size in (4, 8):
            frames = aggregate.parcel_aggregation(fx.signal(spark, d), fx.parcels(spark, size), time_method="mean").withColumn("col_idx", F.lit(0))
            kept.store("vector", frames, {"element": {"element": ""}, "type": "BOLD", "marker": {"name": f"mean{size}_aggregation"}})
        return cut(read(kept))


query("catalog_list", "SELECT 'BOLD_mean4_aggregation' AS name, 'vector' AS kind UNION ALL SELECT 'BOLD_mean8_aggregation', 'vector'")(lambda spark, d: _stored(spark, d, lambda k: k.catalog().select("name", "kind")))
query("feature_lookup", f"{_S8} SELECT element, col, round(CAST(CAST(avg(value) AS FLOAT) AS DOUBLE), 6) + 0.0 AS value FROM series8 GROUP BY ALL")(
    lambda spark, d: _stored(spark, d, lambda k: k.read("BOLD_mean8_aggregation").select("element", "col", (F.round(F.col("value").cast("double"), 6) + F.lit(0.0)).alias("value")))
)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
