"""Hand-computed cases, numpy as an oracle, and properties."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelkit import fixtures as fx
from parcelkit.functions import stats
from parcelkit.model import KINDS, element_prefix, feature_identity, schema
from parcelkit.operators import aggregate, complexity, connectivity, dims, onthefly, prep, reho, spectral
from parcelkit.plans import cli, pipeline, registry
from parcelkit.plans.markers import Marker, aggregation
from parcelkit.sources import elements, patterns, readers, store

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(df, column):
    return df.agg(column.alias("v")).first()["v"]


def test_winsorized_golden(spark):
    df = spark.createDataFrame([(float(v),) for v in (22, 4, 9, 8, 5, 3, 7, 2, 1, 6)], "v double")
    assert one(df, stats.winsorized_mean(F.col("v"), [0.1, 0.1])) == 5.5
    with pytest.raises(ValueError):
        stats.winsorized_mean(F.col("v"), [0.1])


@QUICK
@given(st.lists(st.floats(-100, 100).map(lambda x: round(x, 3)), min_size=1, max_size=12))
def test_no_trimming_is_the_mean(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.agg(stats.trim_mean(F.col("v"), 0).alias("t"), stats.winsorized_mean(F.col("v"), [0, 0]).alias("w"), F.avg("v").alias("m")).first()
    assert math.isclose(got["t"], got["m"], abs_tol=1e-9) and math.isclose(got["w"], got["m"], abs_tol=1e-9)


def test_select_needs_one_choice(spark):
    df = spark.createDataFrame([("a", k, k * 1.0) for k in range(7)], "g string, i int, v double")
    picked = {r["i"] for r in stats.select(df, ["g"], "i", pick=[1, 4, 6]).collect()}
    dropped = {r["i"] for r in stats.select(df, ["g"], "i", drop=[0, 2, 3, 5]).collect()}
    assert picked == dropped == {1, 4, 6}
    with pytest.raises(ValueError):
        stats.select(df, ["g"], "i")


def test_constant_series_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert one(df, stats.correlation(F.col("x"), F.col("y"))) is None


@pytest.mark.parametrize(
    "args, expected",
    [((168, 0, 10, None, 1.0), (0, 10)), ((168, 2, None, None, 2.0), (1, 84)), ((168, 10, None, 20, 2.0), (5, 15)), ((168, 4, -2, None, 1.0), (4, 167))],
)
def test_slices(args, expected):
    assert prep.slice_bounds(*args) == expected


@pytest.mark.parametrize("args, error", [((168, 0, None, None, 1.0), ValueError), ((168, 1, 5, 3, 1.0), ValueError), ((168, 1, 200, None, 1.0), IndexError)])
def test_bad_slices(args, error):
    with pytest.raises(error):
        prep.slice_bounds(*args)


def test_confound_plan():
    plan = prep.confound_plan({"wm_csf": "full"}, ["csf", "white_matter", "csf_derivative1"])
    assert plan["select"][:4] == ["csf", "csf_derivative1", "csf_power2", "csf_derivative1_power2"]
    assert "csf_derivative1" not in plan["derivatives"] and "white_matter_derivative1" in plan["derivatives"]
    with pytest.raises(ValueError):
        prep.confound_plan({"motion": "basic"}, ["csf"])


def series(spark, x):
    return spark.createDataFrame([(0, t, k, f"c{k}", float(v)) for t, row in enumerate(x) for k, v in enumerate(row)], "element int, timepoint int, idx int, col string, value double")


def as_matrix(df, k):
    m = np.full((k, k), np.nan)
    for r in df.collect():
        m[r["row_idx"], r["col_idx"]] = r["value"]
    return m


def test_connectivity_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=(40, 4)) @ np.random.default_rng(4).normal(size=(4, 4))
    df, low = series(spark, x), np.tril_indices(4)
    cov = np.cov(x.T, bias=True)
    precision = np.linalg.inv(cov)
    d = np.sqrt(np.diag(precision))
    partial = -precision / np.outer(d, d)
    np.fill_diagonal(partial, 1)
    for kind, expected in (("correlation", np.corrcoef(x.T)), ("covariance", cov), ("precision", precision), ("partial correlation", partial)):
        assert np.allclose(as_matrix(connectivity.matrix(df, kind), 4)[low], expected[low])
    shrunk = as_matrix(connectivity.matrix(df, "covariance", shrink=True), 4)
    assert np.isclose(np.trace(shrunk), np.trace(cov)) and (abs(shrunk[low]) <= abs(cov[low]).max()).all()
    xi = as_matrix(connectivity.matrix(df, "xi correlation"), 4)
    assert np.allclose(np.diag(xi), 1 - 3 / 41)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    edges = np.stack([z[:, u] * z[:, v] for u in range(4) for v in range(u)], axis=1)
    got = {(r["timepoint"], r["idx"]): r["value"] for r in connectivity.edge_series(df).collect()}
    assert all(np.isclose(got[t, e], edges[t, e]) for t in range(40) for e in range(6))
    rss = {r["timepoint"]: r["value"] for r in connectivity.edge_rss(df).collect()}
    assert np.allclose([rss[t] for t in range(40)], np.sqrt((edges**2).sum(axis=1)))
    assert as_matrix(connectivity.tangent(df), 4)[low] == pytest.approx(np.zeros(10), abs=1e-8)


def test_alff_agrees_with_numpy(spark):
    x = np.random.default_rng(5).normal(size=60)
    df = spark.createDataFrame([(0, t, 0, float(v)) for t, v in enumerate(x)], "element int, timepoint int, voxel int, value double")
    f, a = np.abs(np.fft.fftfreq(60, 2.0)), np.abs(np.fft.fft(x))
    num = a[(f > 0.01) & (f < 0.1)].sum()
    r = spectral.alff(df, tr=2.0).first()
    assert math.isclose(r["alff"], num / math.sqrt(60), rel_tol=1e-9) and math.isclose(r["falff"], num / a[f > 0].sum(), rel_tol=1e-9)


def test_reho_is_one_for_equal_voxels(spark):
    rows = [(0, t, v, float((t * 7) % 5)) for t in range(10) for v in range(64)]
    df = spark.createDataFrame(rows, "element int, timepoint int, voxel int, value double")
    assert {round(r["value"], 9) for r in reho.reho(df, fx.grid(spark), 27).collect()} == {1.0}
    assert [len(reho.neighbours(n)) for n in (7, 19, 27, 125)] == [7, 19, 27, 125]


def test_complexity_kernels():
    rng = np.random.default_rng(7)
    noise, wave = rng.normal(size=400), np.sin(np.arange(400) / 5)
    assert complexity.sample_entropy(noise, 2) > complexity.sample_entropy(wave, 2)
    assert complexity.range_entropy(noise) > complexity.range_entropy(wave)
    assert 0.3 < complexity.hurst_dfa(noise) < 0.7 < complexity.hurst_dfa(np.cumsum(noise))
    assert complexity.multiscale_entropy_auc(noise) > complexity.multiscale_entropy_auc(wave)
    assert complexity.range_entropy_auc(noise) > 0
    assert math.isnan(complexity.sample_entropy(np.arange(3.0), 4))


def test_range_entropy_auc_compares_each_pair_once(monkeypatch):
    """Not once for each of the ten tolerances, nor for each place of a segment."""
    x, taken, absolute = np.random.default_rng(2).normal(size=200), [], np.abs
    monkeypatch.setattr(complexity.np, "abs", lambda d: taken.append(d.size) or absolute(d))
    assert complexity.range_entropy_auc(x) > 0
    assert 0 < sum(taken) <= len(x) ** 2


@pytest.mark.parametrize("x", [np.random.default_rng(4).normal(size=60), np.random.default_rng(5).integers(0, 5, 60) / 8, np.ones(9), np.arange(2.0), np.zeros(0)])
def test_range_entropy_against_all_pairs(x):
    """Ties at a tolerance, equal segments and short series too, whatever the blocks."""
    def distance(i, j, m):
        d = [abs(x[i + k] - x[j + k]) for k in range(m)]
        return (max(d) - min(d)) / (max(d) + min(d)) if max(d) else 0.0

    tolerances, pairs = [k / 10 for k in range(10)], [(i, j) for i in range(len(x) - 2) for j in range(len(x) - 2) if i != j]
    expected = tuple([sum(distance(i, j, m) <= t for i, j in pairs) for t in tolerances] for m in (2, 3))
    assert complexity._range_matches(x, 2, 1, tolerances) == complexity._range_matches(x, 2, 1, tolerances, block=7) == expected
    h = [-math.log(a / b) if a and b else 0.0 for b, a in zip(*expected, strict=True)]
    assert complexity.range_entropy_auc(x) == pytest.approx(float(np.trapezoid(h)) / 10, abs=1e-12)


def test_missing_values_match_nothing():
    x = np.random.default_rng(8).normal(size=40)
    assert complexity._range_matches(np.r_[np.nan, np.nan, np.nan, x], 2, 1, [0.0, 0.5]) == complexity._range_matches(x, 2, 1, [0.0, 0.5])
    assert math.isnan(complexity.range_entropy(np.full(9, np.nan))) and complexity.range_entropy(np.ones(9)) == 0


def test_small_series_go_to_several_tasks(spark):
    """However few bytes they are: the kernels' work is what counts."""
    df = series(spark, np.random.default_rng(6).normal(size=(50, 40)))
    got = complexity.complexity(df, "range_entropy_auc").withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 40 and len({r["task"] for r in got}) > 1


def test_perm_entropy_bounds(spark):
    df = series(spark, np.c_[np.arange(50), np.random.default_rng(1).normal(size=50)])
    got = {r["col"]: r["value"] for r in complexity.perm_entropy(df, 3).collect()}
    assert got["c0"] == 0 and 0.8 < got["c1"] <= 1


def test_confounds_against_numpy(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(30, 2)), rng.normal(size=30)
    signal = spark.createDataFrame([(0, t, 5, float(v)) for t, v in enumerate(y)], "element int, timepoint int, voxel int, value double")
    noise = spark.createDataFrame([(0, t, float(a), float(b)) for t, (a, b) in enumerate(x)], "element int, timepoint int, a double, b double")
    design = np.c_[x, np.ones(30)]
    expected = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = {r["timepoint"]: r["value"] for r in prep.remove_confounds(signal, noise).collect()}
    assert np.allclose([got[t] for t in range(30)], expected)


def test_band_pass_keeps_the_band(spark):
    t = np.arange(200)
    slow, quick = np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 0.4 * t)
    df = spark.createDataFrame([(0, int(k), 0, float(v)) for k, v in zip(t, slow + quick, strict=True)], "element int, timepoint int, voxel int, value double")
    got = {r["timepoint"]: r["value"] for r in prep.band_pass(df, 0.15, 0.01, 1.0).collect()}
    assert np.allclose([got[int(k)] for k in t], slow, atol=0.05)


def test_spheres_must_not_overlap(spark):
    with pytest.raises(ValueError):
        aggregate.sphere_voxels(fx.grid(spark), fx.seeds(spark), 2.0)
    assert aggregate.sphere_voxels(fx.grid(spark), fx.seeds(spark), 2.0, True).count() > 0


def test_merge_prefixes_labels(spark):
    merged = dims.merge_parcellations([("over", fx.overlapping(spark)), ("base", fx.parcels(spark, 8))])
    assert merged.count() == 64 and {r["label"] for r in merged.where("voxel = 8").collect()} == {"over_P1"}
    assert merged.groupBy("label").agg(F.count_distinct("parcel_id").alias("n")).where("n > 1").count() == 0


def test_connected_mask(spark):
    mask = spark.createDataFrame([(v,) for v in (0, 1, 2, 60, 63)], "voxel int")
    assert sorted(r["voxel"] for r in dims.largest_component(mask, fx.grid(spark)).collect()) == [0, 1, 2]


def test_registry_of_dimensions(spark):
    dims.register_data("mask", "mine", lambda s: fx.mask(s, "a"))
    with pytest.raises(ValueError):
        dims.register_data("mask", "mine", lambda s: fx.mask(s, "a"))
    assert "mine" in dims.list_data("mask") and dims.load_data("mask", "mine", spark).count() == 42
    dims.deregister_data("mask", "mine")
    with pytest.raises(ValueError):
        dims.load_data("mask", "mine", spark)
    with pytest.raises(ValueError):
        dims.warper_for([], "a", "b")


def test_identity():
    meta = {"element": {"subject": 1}, "type": "BOLD", "marker": {"name": "fc", "a": 1, "b": 2}}
    first = feature_identity(meta)
    assert first[:2] == feature_identity({"marker": {"b": 2, "a": 1, "name": "fc"}, "type": "BOLD", "element": {"subject": 2}})[:2]
    assert first[0] != feature_identity(meta | {"element": {"session": 1}})[0] and first[1] == "BOLD_fc"
    assert element_prefix({"subject": 1, "session": 2}) == "element_1_2_"
    with pytest.raises(ValueError):
        feature_identity({"type": "BOLD"})
    assert schema("vector", ["subject"]).names == ["subject", "col", "col_idx", "value"]


def test_matrix_goldens(spark):
    rows = [(0, f"r{i}", i, f"c{j}", j, float(3 * i + j)) for i in range(3) for j in range(3)]
    m = spark.createDataFrame(rows, "element int, row string, row_idx int, col string, col_idx int, value double")
    cells = lambda *a: [r["value"] for r in store.matrix_to_vector(m, *a).orderBy("col_idx").collect()]
    assert cells("triu") == [0, 1, 2, 4, 5, 8] and cells("triu", False) == [1, 2, 5]
    assert cells("tril") == [0, 3, 4, 6, 7, 8] and cells("tril", False) == [3, 6, 7]
    assert cells("full") == [float(k) for k in range(9)]
    with pytest.raises(ValueError):
        cells("full", False)
    with pytest.raises(ValueError):
        store.check_matrix(2, 3, ["a", "b"], ["a", "b", "c"], "triu")


def test_store_round_trip(spark, tmp_path):
    kept = store.FeatureStore(spark, str(tmp_path / "a"), ["subject"], force_float32=False)
    rows = spark.createDataFrame([("s1", "f1", 0, 10.0), ("s1", "f2", 1, 20.0)], "subject string, col string, col_idx int, value double")
    meta = {"element": {"subject": ""}, "type": "BOLD", "marker": {"name": "m_x"}}
    md5 = kept.store("vector", rows, meta)
    assert kept.store("vector", rows.withColumn("value", F.lit(1.0)), meta) == md5
    assert sorted(r["value"] for r in kept.read("BOLD_m_x").collect()) == [10.0, 20.0]
    kept.store("vector", rows.withColumn("value", F.col("value") + 1), meta, "update")
    assert kept.read_wide(md5=md5).first().asDict() == {"subject": "s1", "f1": 11.0, "f2": 21.0}
    with pytest.raises(ValueError):
        kept.store("vector", rows, meta, "fail")
    with pytest.raises(ValueError):
        kept.store("image", rows, meta)
    other = store.FeatureStore(spark, str(tmp_path / "b"), ["subject"], force_float32=False)
    other.store("vector", rows.withColumn("subject", F.lit("s2")), meta)
    all_of_them = store.FeatureStore(spark, str(tmp_path / "c"), ["subject"], force_float32=False)
    all_of_them.collect([kept, other])
    all_of_them.collect([other], files=1)
    assert all_of_them.read("BOLD_m_x").count() == 4 and all_of_them.catalog().count() == 1
    (tmp_path / "c" / "mine.txt").write_text("stays")
    all_of_them.reset()
    assert (tmp_path / "c" / "mine.txt").exists()
    with pytest.raises(ValueError):
        all_of_them.read("BOLD_m_x")


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    once = store.upsert(a, b, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.upsert(once, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, store.upsert(a, b, ["k"], "ignore").collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_pattern_source(spark):
    names = [f"func/{s}.csv" for s in ("s1", "s3")] + [f"anat/{s}_{e}.csv" for s in ("s1", "s2", "s3") for e in ("e1", "e2")] + ["noise.txt"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    source = patterns.PatternSource(["BOLD", "T1w"], {"BOLD": {"pattern": "func/{subject}.csv"}, "T1w": {"pattern": "anat/{subject}_{session}.csv"}}, ["subject", "session"], files)
    assert sorted(map(tuple, source.elements().collect())) == [("s1", "e1"), ("s1", "e2"), ("s3", "e1"), ("s3", "e2")]
    assert source[("s1", "e2")]["T1w"].first()["path"] == "anat/s1_e2.csv"
    with pytest.raises(ValueError):
        patterns.validate({"BOLD": {"pattern": "{subject}"}}, ["subject", "session"], ["BOLD"])
    with pytest.raises(ValueError):
        patterns.validate({"BOLD": {"pattern": "{subject}", "odd": 1}}, ["subject"], ["BOLD"])
    assert patterns.to_regex("{a}/x_{a}_[0-9]*.csv", ["a"])[1] == ["a"]


def test_selectors(spark):
    e = spark.createDataFrame([(s, t) for s in ("s1", "s2", "s3") for t in ("rest", "work")], "subject string, task string")
    assert elements.select(e, ["s1", ("work", "s2")]).count() == 3
    assert elements.unmatched(e, ["s1", "s9"]) == ["s9"]
    with pytest.raises(ValueError):
        elements.intersect([e, e.select("subject")])


def test_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\tb\n1\tn/a\n2\t3\n")
    assert readers.read(spark, str(tmp_path / "c.tsv")).count() == 2
    assert readers.read(spark, "x.unknown") is None and readers.read(spark, "x.csv", "Warp") is None
    (tmp_path / "e.csv").write_text("s1, e1\n s2,e2\n")
    assert sorted(map(tuple, readers.element_file(spark, str(tmp_path / "e.csv"), ["subject", "session"]).collect())) == [("s1", "e1"), ("s2", "e2")]


def test_nan_policies(spark):
    m = spark.createDataFrame([(e, r, c, float("nan") if (e, r, c) == (1, "a", "b") else 1.0) for e in (0, 1) for r in "abc" for c in "abc"], "element int, row string, col string, value double")
    counts = {p: onthefly.nan_policy(m, p).count() for p in onthefly.POLICIES}
    assert counts == {"bypass": 18, "drop_element": 9, "drop_rows": 15, "drop_columns": 15, "drop_symmetric": 10}
    with pytest.raises(ValueError):
        onthefly.nan_policy(m, "other")


def test_pipeline_end_to_end(spark, tmp_path, sf_dir):
    @registry.register("source", "test_source")
    class Source:
        def __init__(self, spark):
            self.spark = spark

        def elements(self):
            return self.signals()["BOLD"].select("element").distinct()

        def signals(self):
            return {"BOLD": fx.signal(self.spark, sf_dir)}

    registry.register("marker", "test_marker")(lambda name: aggregation(name, "parcels", {"parcels": fx.parcels(spark, 8)}, time_method="mean"))
    (tmp_path / "extra.py").write_text("LOADED = True\n")
    (tmp_path / "c.yaml").write_text("with: extra.py\nsource: {kind: test_source}\nmarkers: [{kind: test_marker, name: m}]\nstorage: {uri: out}\nelements: ['1', '2']\n")
    config = pipeline.parse_yaml(tmp_path / "c.yaml")
    kept = pipeline.run(spark, config)
    assert kept.read("BOLD_m_aggregation").select("element").distinct().count() == 2
    assert pipeline.list_elements(spark, config, ["3"]).first()["line"] == "3"
    with pytest.raises(ValueError):
        pipeline.run(spark, config, ["none"])
    assert "spark-submit" in pipeline.queue("c.yaml", spark__executor__memory="8g")
    pipeline.reset(spark, config)


def test_collections_are_checked(spark):
    m = Marker("m", {"x": "vector"}, lambda s, keys: {})
    with pytest.raises(ValueError):
        pipeline.MarkerCollection([m, m])
    with pytest.raises(ValueError):
        pipeline.MarkerCollection([m]).validate(["T1w"])
    with pytest.raises(ValueError):
        m.features(None)
    assert set(KINDS) == {"vector", "matrix", "timeseries", "timeseries_2d", "scalar_table"}


def test_command_line(tmp_path, capsys):
    (tmp_path / "e.txt").write_text("s1,e1\ns2\n")
    assert cli.selectors([str(tmp_path / "e.txt"), "s3"]) == [["s1", "e1"], "s2", "s3"]
    assert cli.main(["wtf"]) == 0 and "pyspark" in capsys.readouterr().out
    assert cli.main(["queue", "c.yaml"]) == 0


def test_streamed_elements_are_stored_once(spark, tmp_path, sf_dir):
    from parcelkit.streaming.ingest import ingest

    signal = fx.signal(spark, sf_dir).where("element < 2")
    signal.coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = store.FeatureStore(spark, str(tmp_path / "out"), ["element"])
    meta = {"element": {"element": ""}, "type": "BOLD", "marker": {"name": "s"}}
    marker = lambda s: aggregate.parcel_aggregation(s, fx.parcels(spark, 8), time_method="mean")
    for k in range(2):
        ingest(spark, str(tmp_path / "in"), signal.schema, marker, kept, "vector", meta, str(tmp_path / f"ck{k}")).awaitTermination()
    assert kept.read("BOLD_s").count() == 16


def write_nifti(path, image, affine=None, code=16, zipped=False):
    import gzip
    import struct

    shape = image.shape
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into("<2h", header, 70, code, 32)
    struct.pack_into("<8f", header, 76, 1, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into("<3f", header, 108, 352, 1, 0)
    if affine is not None:
        struct.pack_into("<h", header, 254, 1)
        struct.pack_into("<12f", header, 280, *np.ravel(affine))
    header[344:348] = b"n+1\0"
    content = bytes(header) + image.astype({16: "<f4", 4: "<i2"}[code]).tobytes(order="F")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(content) if zipped else content)


def test_images_are_read(spark, tmp_path):
    image = np.arange(24, dtype=float).reshape(2, 3, 2, 2)
    image[0, 0, 0, 1] = np.nan
    write_nifti(tmp_path / "a.nii.gz", image, [[2, 0, 0, -1], [0, 2, 0, 0], [0, 0, 2, 5]], zipped=True)
    got = {(r["i"], r["j"], r["k"], r["timepoint"]): r for r in readers.read(spark, str(tmp_path / "a.nii.gz")).collect()}
    assert len(got) == 24 and got[0, 0, 0, 1]["value"] is None
    assert all(got[c]["value"] == image[c] for c in got if c != (0, 0, 0, 1))
    r = got[1, 2, 1, 0]
    assert (r["voxel"], r["x"], r["y"], r["z"]) == (1 + 2 * (2 + 3 * 1), 1.0, 4.0, 7.0)
    write_nifti(tmp_path / "b.nii", np.ones((2, 2, 2)), code=4)
    assert readers.nifti(spark, str(tmp_path / "b.nii")).agg(F.max("y")).first()[0] == 3.0
    with pytest.raises(ValueError):
        readers.decode_nifti(b"\0" * 400)


def test_named_dimension_tables(spark, tmp_path):
    parcels = np.repeat([1, 1, 5, 0], 2).reshape(4, 2, 1).astype(float)
    write_nifti(tmp_path / "p.nii", parcels, code=4)
    (tmp_path / "labels.txt").write_text("left\nright\n")
    dims.register_data("parcellation", "two", str(tmp_path / "p.nii"), labels=str(tmp_path / "labels.txt"))
    got = {(r["voxel"], r["label"]) for r in dims.load_data("parcellation", "two", spark).collect()}
    assert got == {(0, "left"), (1, "left"), (4, "left"), (5, "left"), (2, "right"), (6, "right")}
    dims.deregister_data("parcellation", "two")
    with pytest.raises(ValueError):
        dims.read_data(spark, "parcellation", str(tmp_path / "p.nii"), ["one"])
    assert dims.load_data("mask", str(tmp_path / "p.nii"), spark).count() == 6
    assert dims.load_data("grid", str(tmp_path / "p.nii"), spark).count() == 8
    write_nifti(tmp_path / "m.nii", np.stack([parcels, 2 * parcels], axis=3))
    assert {r["region"] for r in dims.load_data("maps", str(tmp_path / "m.nii"), spark).collect()} == {"map_0", "map_1"}
    with pytest.raises(ValueError):
        dims.load_data("parcellation", "nowhere", spark)


def test_mask_specifications(spark, sf_dir):
    for which in "ab":
        dims.register_data("mask", f"mask_{which}", lambda s, which=which: fx.mask(s, which), True)
    count = lambda spec, **how: dims.mask_of(spec, spark, **how).count()
    assert count("mask_a") == 42 and count(["mask_a", "mask_b"]) >= count(["mask_a", "mask_b", {"threshold": 1.0}]) == 32
    assert count(["mask_a", "mask_b", {"threshold": 0.0}]) == 58
    assert count(["mask_a", "inherit", {"threshold": 1.0}], inherit=fx.mask(spark, "b")) == 32
    assert 0 < count({"quantile_mask": {"lower": 0.5}}, signal=fx.signal(spark, sf_dir)) <= 32
    for wrong in (["mask_a", {"threshold": 1.0}], {"mask_a": {"x": 1}}, "inherit", [], {"quantile_mask": {}}, {"a": 1, "b": 2}):
        with pytest.raises(ValueError):
            dims.mask_of(wrong, spark)


def test_a_folder_of_images_by_configuration_alone(spark, tmp_path):
    rng = np.random.default_rng(3)
    shape = (4, 2, 2)
    images = {}
    for s in ("s1", "s2"):
        for e in ("e1", "e2"):
            images[s, e] = rng.normal(size=(*shape, 12)).astype(np.float32).astype(float)
            write_nifti(tmp_path / f"data/{s}/{e}/{s}_{e}_bold.nii.gz", images[s, e], zipped=True)
            write_nifti(tmp_path / f"data/{s}/{e}/{s}_{e}_mask.nii.gz", np.ones(shape), zipped=True)
            rows = "".join(f"{'n/a' if t == 0 else rng.normal()}\t{rng.normal()}\t{rng.normal()}\n" for t in range(12))
            (tmp_path / f"data/{s}/{e}/{s}_{e}_conf.tsv").write_text("framewise_displacement\tcsf\twhite_matter\n" + rows)
    parcels = np.arange(16).reshape(shape, order="F") // 4 + 1.0
    write_nifti(tmp_path / "parcels.nii", parcels, code=4)
    (tmp_path / "c.yaml").write_text("""
data: [{kind: parcellation, name: four, path: parcels.nii, labels: [P1, P2, P3, P4]}]
source:
  kind: folder
  datadir: data
  types: [BOLD]
  replacements: [subject, session]
  patterns:
    BOLD:
      pattern: "{subject}/{session}/{subject}_{session}_bold.nii.gz"
      mask: {pattern: "{subject}/{session}/{subject}_{session}_mask.nii.gz"}
preprocess: [{kind: slice_time, start: 2, stop: 12}, {kind: temporal_filter, masks: inherit}]
markers:
  - {kind: functional_connectivity, name: fc, regions: parcels, dims: {parcels: four}}
  - {kind: aggregation, name: mean, regions: parcels, dims: {parcels: four}, time_method: mean}
  - {kind: edge_rss, name: rss, parcels: four}
storage: {uri: out, force_float32: false}
""")
    config = pipeline.parse_yaml(tmp_path / "c.yaml")
    assert sorted(r["line"] for r in pipeline.list_elements(spark, config).collect()) == ["s1,e1", "s1,e2", "s2,e1", "s2,e2"]
    kept = pipeline.run(spark, config, [["s1", "e2"], "s2"])
    fc = {(r["subject"], r["session"], r["row"], r["col"]): r["value"] for r in kept.read("BOLD_fc_functional_connectivity").collect()}
    assert {k[:2] for k in fc} == {("s1", "e2"), ("s2", "e1"), ("s2", "e2")}
    for (s, e), image in images.items():
        if (s, e) == ("s1", "e1"):
            continue
        x = image.reshape(16, 12, order="F")[:, 2:]
        t = np.arange(10)
        x = np.stack([v - np.polyval(np.polyfit(t, v, 1), t) for v in x])
        x = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
        r = np.corrcoef(x.reshape(4, 4, 10).mean(axis=1))
        assert all(fc[s, e, f"P{i + 1}", f"P{j + 1}"] == pytest.approx(r[i, j], abs=1e-9) for i in range(4) for j in range(i + 1))
    whole = pipeline.collect(spark, str(tmp_path / "whole"), [str(tmp_path / "out")])
    assert whole.keys == ["subject", "session"] and len(whole.catalog().collect()) == 3
    config["source"]["patterns"]["BOLD"]["confounds"] = {"pattern": "{subject}/{session}/{subject}_{session}_conf.tsv", "format": "fmriprep"}
    config["preprocess"] = [{"kind": "remove_confounds", "strategy": {"wm_csf": "basic"}, "standardize": False, "detrend": False}]
    config["storage"]["uri"] = str(tmp_path / "freed")
    mean = pipeline.run(spark, config).read("BOLD_mean_aggregation").collect()
    assert len(mean) == 16 and all(abs(r["value"]) < 1e-9 for r in mean)
    pipeline.reset(spark, config)
    with pytest.raises(ValueError):
        pipeline.run(spark, config, ["nobody"])


def test_command_line_runs_a_configuration(spark, tmp_path, sf_dir, monkeypatch):
    fx.signal(spark, sf_dir).where("element < 3").write.parquet(str(tmp_path / "signal"))
    fx.parcels(spark, 8).write.parquet(str(tmp_path / "parcels.parquet"))
    (tmp_path / "c.yaml").write_text("""
source: {kind: tables, tables: {BOLD: signal}, keys: [element]}
data: [{kind: parcellation, name: eight, path: parcels.parquet}]
markers: [{kind: aggregation, name: mean, regions: parcels, dims: {parcels: eight}, time_method: mean}]
storage: {uri: out, single_output: false}
""")
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["list-elements", str(tmp_path / "c.yaml"), "--output", str(tmp_path / "e.txt")]) == 0
    assert sorted((tmp_path / "e.txt").read_text().split()) == ["0", "1", "2"]
    assert cli.main(["run", str(tmp_path / "c.yaml"), "--element", "1", "--verbose", "info"]) == 0
    assert cli.main(["run", str(tmp_path / "c.yaml"), "--overwrite"]) == 0
    assert cli.main(["collect", str(tmp_path / "all"), str(tmp_path / "out"), "--files", "1"]) == 0
    kept = store.FeatureStore.open(spark, str(tmp_path / "all"))
    assert kept.read("BOLD_mean_aggregation").count() == 24
    own = [p.name for p in (tmp_path / "out/vector").rglob("_element=*")]
    assert sorted(own) == [f"_element=element_{k}_" for k in range(3)]
    assert cli.main(["reset", str(tmp_path / "c.yaml")]) == 0 and not (tmp_path / "out/vector").exists()


def test_a_feature_is_replaced_by_a_new_version(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a", 0, 1.0), ("s2", "a", 0, 2.0)], "subject string, col string, col_idx int, value double")
    meta = {"element": {"subject": ""}, "type": "T1w", "marker": {"name": "m"}}
    kept = store.FeatureStore(spark, str(tmp_path / "r"), ["subject"])
    kept.store("vector", rows, meta)
    kept.store("vector", rows.where("subject = 's1'").withColumn("value", F.lit(5.0)), meta, "update")
    assert {r["subject"]: r["value"] for r in kept.read("T1w_m").collect()} == {"s1": 5.0, "s2": 2.0}
    kept.store("vector", rows.limit(1), meta, "replace")
    assert kept.read("T1w_m").count() == 1
    # A job that died before its version was named changes nothing.
    md5, kind = kept.find("T1w_m")
    rows.write.parquet(kept._folder(kind, md5, 3))
    assert kept.read("T1w_m").count() == 1
    kept.store("vector", rows, meta, "update")
    assert kept.read("T1w_m").count() == 2


def test_matrices_are_checked_when_stored(spark, tmp_path, sf_dir):
    series = aggregate.with_index(aggregate.parcel_aggregation(fx.signal(spark, sf_dir).where("element < 2"), fx.parcels(spark, 16)), fx.labels(16))
    fc, kept = connectivity.matrix(series), store.FeatureStore(spark, str(tmp_path / "m"), ["element"])
    meta = {"element": {"element": ""}, "type": "BOLD", "marker": {"name": "fc"}}
    kept.store("matrix", fc, meta, matrix_kind="tril")
    for how in ({"matrix_kind": "triu"}, {"matrix_kind": "tril", "diagonal": False}, {"matrix_kind": "full", "diagonal": False}):
        with pytest.raises(ValueError):
            kept.store("matrix", fc, meta, **how)


def test_pairwise_measures_with_gaps():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    x[3, 1] = x[5, 2] = x[6, 2] = np.nan
    r = connectivity.rank_pairwise(x, x)
    for i in range(4):
        for j in range(4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = (np.argsort(np.argsort(x[both, k])) for k in (i, j))
            assert r[i, j] == pytest.approx(np.corrcoef(a, b)[0, 1])
            assert connectivity.pairwise(x, x)[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])
    x[:, 3] = 2.5
    assert np.isnan(connectivity.pairwise(x, x)[3]).all()


def test_edges_in_blocks(spark, sf_dir, monkeypatch):
    series = aggregate.with_index(aggregate.parcel_aggregation(fx.signal(spark, sf_dir).where("element < 2"), fx.parcels(spark, 8)), fx.labels(8))
    whole = {tuple(r)[:5]: r["value"] for r in connectivity.matrix(connectivity.edge_series(series)).collect()}
    for block in (1024, 5):
        monkeypatch.setattr(connectivity, "BLOCK", block)
        got = {tuple(r)[:5]: r["value"] for r in connectivity.edge_connectivity(series).collect()}
        assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k], abs=1e-9) for k in got)


def test_confounds_are_checked(spark):
    signal = spark.createDataFrame([(0, t, 0, float(t % 3)) for t in range(6)], "element int, timepoint int, voxel int, value double")
    confounds = spark.createDataFrame([(0, t, float(t * t)) for t in range(5)], "element int, timepoint int, csf double")
    with pytest.raises(ValueError):
        prep.check_confounds(signal, confounds, ["csf"])
    with pytest.raises(ValueError):
        prep.check_confounds(signal.where("timepoint < 5"), confounds, ["white_matter"])
    prep.check_confounds(signal.where("timepoint < 5"), confounds, ["csf"])


def test_a_confound_that_repeats_another_changes_nothing(spark):
    rng = np.random.default_rng(0)
    c, y = rng.normal(size=(30, 2)), rng.normal(size=30)
    signal = spark.createDataFrame([(0, t, 0, float(y[t])) for t in range(30)], "element int, timepoint int, voxel int, value double")
    confounds = spark.createDataFrame([(0, t, float(c[t, 0]), float(c[t, 1]), float(2 * c[t, 0]), 1.0) for t in range(30)], "element int, timepoint int, a double, b double, a2 double, one double")
    got = [r["value"] for r in prep.remove_confounds(signal, confounds).orderBy("timepoint").collect()]
    design = np.c_[c, np.ones(30)]
    assert np.allclose(got, y - design @ np.linalg.lstsq(design, y, rcond=None)[0])


def test_settings(spark, monkeypatch):
    from parcelkit.plans import settings as kept

    assert kept.get("no.such", 3) == 3
    monkeypatch.setenv("PARCELKIT_A_B", "2.5")
    assert kept.get("a.b") == 2.5
    kept.put("a.b", True, spark)
    assert kept.get("a.b", spark=spark) is True
    spark.conf.unset("spark.parcelkit.a.b")


def test_data_sets_find_their_files(spark, tmp_path):
    from parcelkit.plans import registry as known
    from parcelkit.sources import datasets

    for name in ("rfMRI_REST1_LR", "rfMRI_REST1_RL", "tfMRI_WM_LR"):
        write_nifti(tmp_path / f"h/100/MNINonLinear/Results/{name}/{name}.nii.gz", np.ones((2, 1, 1, 2)), zipped=True)
    found = known.build("source", {"kind": "hcp1200", "spark": spark, "datadir": str(tmp_path / "h"), "types": ["BOLD"], "phase_encodings": ["LR"]})
    assert sorted(map(tuple, found.elements().collect())) == [("100", "rfMRI_REST1", "LR"), ("100", "tfMRI_WM", "LR")]
    assert found.signals()["BOLD"].select("task").distinct().count() == 2
    with pytest.raises(ValueError):
        datasets.hcp1200(spark, str(tmp_path / "h"), ica_fix=True)
    stem = "derivatives/fmriprep-1.3.2/sub-f1/ses-wave1bas/func/sub-f1_ses-wave1bas_task-Rest_acq-mb4AP_run-1"
    for end in ("_space-MNI152NLin2009cAsym_desc-preproc_bold.nii.gz", "_space-MNI152NLin2009cAsym_desc-brain_mask.nii.gz"):
        write_nifti(tmp_path / f"d/{stem}{end}", np.ones((2, 1, 1)), zipped=True)
    (tmp_path / f"d/{stem}_desc-confounds_regressors.tsv").write_text("csf\n1\n")
    found = datasets.dmcc13(spark, str(tmp_path / "d"), ["BOLD"])
    assert [tuple(r) for r in found.elements().collect()] == [("sub-f1", "ses-wave1bas", "Rest", "AP", "1")]
    assert set(found.signals()) == {"BOLD", "BOLD.mask", "BOLD.confounds"}
    write_nifti(tmp_path / "v/m0wp1x_ses-2_T1w.nii.gz", np.ones((1, 1, 1)), zipped=True)
    assert [tuple(r) for r in known.build("source", {"kind": "ukb_vbm", "spark": spark, "datadir": str(tmp_path / "v")}).elements().collect()] == [("x", "2")]
    with pytest.raises(ValueError):
        datasets.aomic_id1000(spark, str(tmp_path / "v"), ["BOLD"]).elements()


def sphere_mesh(times):
    """An octahedron, split and drawn to the unit sphere."""
    points = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    faces = [(a, b, c) if s > 0 else (b, a, c) for a, x in ((0, 1), (1, -1)) for b, y in ((2, 1), (3, -1)) for c, z in ((4, 1), (5, -1)) for s in (x * y * z,)]
    points = [np.array(p, float) for p in points]
    for _ in range(times):
        middle, split = {}, []
        for a, b, c in faces:
            m = []
            for p, q in ((a, b), (b, c), (c, a)):
                key = (min(p, q), max(p, q))
                if key not in middle:
                    v = points[p] + points[q]
                    middle[key] = len(points)
                    points.append(v / np.linalg.norm(v))
                m.append(middle[key])
            split += [(a, m[0], m[2]), (b, m[1], m[0]), (c, m[2], m[1]), tuple(m)]
        faces = split
    return np.array(points), np.array(faces)


@pytest.mark.parametrize("times, near", [(3, 0.1), (4, 0.03)])
def test_spectrum_of_a_sphere(times, near, monkeypatch):
    from parcelkit.operators import shapes

    mesh = shapes.Laplacian(*sphere_mesh(times))
    assert (mesh.n > shapes.DENSE) == (times > 3)
    values = mesh.smallest(16)
    assert np.allclose(values, [0] + [2] * 3 + [6] * 5 + [12] * 7, rtol=near, atol=1e-5)
    monkeypatch.setattr(shapes, "DENSE", 0 if times == 3 else 10**6)
    assert np.allclose(mesh.smallest(16), values, rtol=1e-5, atol=1e-5)
    assert mesh.area == pytest.approx(4 * math.pi, rel=0.02) and mesh.volume == pytest.approx(4 / 3 * math.pi, rel=0.03)


def test_spectra_of_meshes(spark):
    from parcelkit.operators import shapes
    from parcelkit.plans.markers import shape_spectrum

    points, faces = sphere_mesh(2)
    vertices = spark.createDataFrame([(e, 10 + k, *(float(r * v) for v in p)) for e, r in (("a", 1), ("b", 2)) for k, p in enumerate(points)] + [("c", 1, 0.0, 0.0, 0.0)], "element string, vertex int, x double, y double, z double")
    triangles = spark.createDataFrame([(e, *(int(10 + v) for v in f)) for e in "ab" for f in faces], "element string, a int, b int, c int")
    got = {(r["element"], r["ev"]): r for r in shapes.shape_spectrum(vertices, triangles, 5).collect()}
    assert len(got) == 10 and all(got["b", k]["value"] == pytest.approx(got["a", k]["value"] / 4, abs=1e-9) for k in range(1, 6))
    assert got["b", 1]["area"] == pytest.approx(4 * got["a", 1]["area"])
    found = shape_spectrum("s", vertices, 5).features(triangles)
    assert {f: kind for f, (kind, _) in found.items()} == {"eigenvalues": "scalar_table", "areas": "vector", "volumes": "vector"} and found["areas"][1].count() == 2


def test_resampling(spark):
    shape = (4, 3, 2)
    cells = np.indices(shape).reshape(3, -1)
    grid = spark.createDataFrame([(k, *map(int, c)) for k, c in enumerate(cells.T)], "voxel int, x int, y int, z int")
    plane = lambda x, y, z: 2.0 * x - y + 3 * z + 1  # noqa: E731  linear, so linear interpolation is exact
    values = spark.createDataFrame([(0, 0, k, plane(*map(float, c))) for k, c in enumerate(cells.T)], "element int, timepoint int, voxel int, value double")
    half = [[0.5, 0, 0, 0.25], [0, 1, 0, 0], [0, 0, 1, 0]]
    got = {r["voxel"]: r["value"] for r in dims.resample(values, grid, grid, half, "continuous").collect()}
    assert len(got) == 24 and all(got[k] == pytest.approx(plane(0.5 * c[0] + 0.25, c[1], c[2])) for k, c in enumerate(cells.T))
    near = {r["voxel"]: r["value"] for r in dims.resample(values, grid, grid, half, "nearest").collect()}
    assert all(near[k] == pytest.approx(plane(math.floor(0.5 * c[0] + 0.75), c[1], c[2])) for k, c in enumerate(cells.T))
    away = dims.resample(values, grid, grid, [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 1, 0]], "continuous").collect()
    assert {r["voxel"] for r in away} == {k for k, c in enumerate(cells.T) if c[0] < 2}
    ones = values.withColumn("value", (F.col("voxel") % 2).cast("double"))
    assert dims.interpolation(ones) == "nearest" and dims.interpolation(values) == "continuous"
    with pytest.raises(ValueError):
        dims.resample(values, grid, grid, half, "cubic")


def test_sources_are_opened_and_closed(spark, tmp_path, sf_dir):
    seen = []

    @registry.register("source", "watched")
    class Watched:
        def __init__(self, spark):
            self.spark = spark

        def open(self):
            seen.append("open")

        def close(self):
            seen.append("close")

        def elements(self):
            return self.signals()["BOLD"].select("element").distinct()

        def signals(self):
            return {"BOLD": fx.signal(self.spark, sf_dir).where("element < 2")}

    registry.register("marker", "failing")(lambda name: Marker(name, {"x": "vector"}, lambda s, keys: {}))
    config = {"source": {"kind": "watched"}, "markers": [{"kind": "failing", "name": "f"}], "storage": {"uri": str(tmp_path / "o")}}
    with pytest.raises(ValueError):
        pipeline.run(spark, config)
    assert seen == ["open", "close"]
    with pytest.raises(ImportError):
        pipeline.MarkerCollection([Marker("m", {"x": "vector"}, lambda s, keys: {}, dependencies=["no_such_package"])]).validate(["BOLD"])
    with pytest.raises(ImportError):
        pipeline.MarkerCollection([Marker("m", {"x": "vector"}, lambda s, keys: {}, programs=["no_such_program"])]).validate(["BOLD"])


def test_matrices_by_frame_are_read_wide(spark, tmp_path):
    rows = spark.createDataFrame([("s1", t, r, c, float(100 * t + 10 * i + j)) for t in range(2) for i, r in enumerate("ab") for j, c in enumerate("xyz")], "subject string, timepoint int, row string, col string, value double")
    kept = store.FeatureStore(spark, str(tmp_path / "f"), ["subject"], compression="gzip")
    kept.store("timeseries_2d", rows, {"element": {"subject": ""}, "type": "BOLD", "marker": {"name": "w"}})
    wide = kept.read_wide("BOLD_w").orderBy("timepoint").collect()
    assert len(wide) == 2 and wide[1]["b~z"] == 112.0 and set(wide[0].asDict()) == {"subject", "timepoint"} | {f"{r}~{c}" for r in "ab" for c in "xyz"}
    assert list((tmp_path / "f").rglob("*.gz.parquet"))
