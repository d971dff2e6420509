import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import exprs
from tideline.operators import batch, chunked, kernel
from tideline.options import InvalidData, InvalidOption, Options, UnsupportedFeature
from tideline.plans import ranks, relational
from tideline.plans.shared import Scratch
from tideline.sources import series
from tideline.streaming import processors


def frame(spark, n=120, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 10, n), 0 if ties else 6)
    y = np.sin(x) + rng.normal(0, 0.3, n)
    rows = [(["a", "b", None][k % 3], k, float(x[k]), float(y[k]), float(k % 4), "t") for k in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id long, v double, y double, w double, extra string").repartition(4)


@pytest.mark.parametrize("options", [{}, {"fraction": 0.3, "confidence_level": 0.9, "prediction_level": 0.9}, {"fraction": 1}, {"fraction": 1, "standard_error": True}, {"cv_fractions": (0.3, 0.6), "iterations": 0}])
def test_smooth_is_the_kernel_by_group(spark, options):
    rows, df = frame(spark)
    got = {r.id: r for r in batch.smooth(df, "v", "y", ["g"], "w", **options).collect()}
    assert len(got) == len(rows) and got[0].extra == "t"
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        f = kernel.fit_series([r[2] for r in own], [r[3] for r in own], [r[4] for r in own] if options.get("fraction") != 1 else None, Options.of(**options))
        assert np.allclose([got[r[1]].y_smooth for r in own], f.y_smooth, atol=1e-9)
        for name, v in f.bounds.items():
            assert np.allclose([got[r[1]][name] for r in own], v)


def test_edges_of_smooth(spark):
    schema = "g string, v double, y double"
    assert batch.smooth(spark.createDataFrame([], schema), "v", "y", ["g"]).collect() == []
    bad = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 3.0), ("a", 2.0, 5.0)], schema)
    with pytest.raises(Exception, match="isn't finite"):
        batch.smooth(bad, "v", "y", ["g"]).collect()
    assert len(batch.smooth(bad, "v", "y", ["g"], dropna=True).collect()) == 2
    with pytest.raises(InvalidOption):
        batch.smooth(bad, "v", "y", fraction=2)
    again = batch.smooth(batch.smooth(bad, "v", "y", dropna=True), "v", "y", dropna=True)
    assert again.columns == ["g", "v", "y", "y_smooth", "residual", "robustness_weight"]
    days = spark.createDataFrame([(dt.datetime(2024, 1, 1 + k), float(k)) for k in range(9)], "t timestamp, y double")
    assert np.allclose([r.y_smooth for r in batch.smooth(days, "t", "y", fraction=0.9, boundary="none").orderBy("t").collect()], np.arange(9))


def test_summaries_and_cross_validation(spark):
    rows, df = frame(spark)
    got = {r.g: r for r in batch.summarize(df, "v", "y", ["g"], cv_fractions=(0.3, 0.6), confidence_level=0.9).collect()}
    scores = batch.cross_validate(df, "v", "y", ["g"], fractions=(0.3, 0.6)).collect()
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        f = kernel.fit_series([r[2] for r in own], [r[3] for r in own], None, Options.of(cv_fractions=(0.3, 0.6), diagnostics=True, confidence_level=0.9))
        assert got[g].n == len(own) and got[g].fraction_used == f.fraction_used and got[g].diagnostics.aicc == pytest.approx(f.diagnostics.aicc)
        mine = {r.fraction: r for r in scores if r.g == g}
        assert [mine[a].score for a in (0.3, 0.6)] == pytest.approx([s for _, s in f.cv_scores])
        assert [a for a in mine if mine[a].is_best] == [f.fraction_used]


def test_expressions_equal_arrays(spark):
    u = np.linspace(0, 1.2, 61)
    df = spark.createDataFrame([(float(v),) for v in u], "u double")
    for name in exprs.KERNELS:
        got = np.array([r[0] for r in df.select(exprs.kernel_weight(F.col("u"), name)).collect()])
        assert np.allclose(got, kernel.kernel_weight(u, name))
        got = np.array([r[0] for r in df.select(exprs.window_weight(F.col("u"), F.lit(1.1), name)).collect()])
        assert np.allclose(got, kernel.window_weight(u, 1.1, name))
        assert 0 < exprs.efficiency(name) <= 1.2
    r = np.array([-3, -0.5, 0.0, 0.1, 1, 2, 20.0])
    df = spark.createDataFrame([(float(v),) for v in r], "r double")
    for name in ("bisquare", "huber", "talwar"):
        got = [x[0] for x in df.select(exprs.robustness_weight(F.col("r"), F.lit(kernel.scale_of(r, "mad")), name)).collect()]
        assert np.allclose(got, kernel.robustness_weights(r, name, "mad"))


def chunks_by_hand(x, y, o):
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    out, before = [], np.zeros((0, 4))
    for a in range(0, len(x), o.chunk_size):
        last = a + o.chunk_size >= len(x)
        cx, cy = np.concatenate([before[:, 0], x[a : a + o.chunk_size]]), np.concatenate([before[:, 1], y[a : a + o.chunk_size]])
        fit, _, rw, _ = kernel.fit_sorted(cx, cy, None, o, o.fraction, o.delta)
        n = len(before)
        for k in range(n):
            s, p = k / n, before[k, 2]
            fit[k] = {"average": (p + fit[k]) / 2, "weighted_average": p * (1 - s) + fit[k] * s, "take_first": p, "take_last": fit[k]}[o.merge]
        cut = len(cx) if last else max(n, len(cx) - o.overlap)
        full = np.column_stack([cx, cy, fit, rw])
        out.append(full[:cut])
        before = full[cut:]
    return np.concatenate(out)


@pytest.mark.parametrize("merge,size,lap", [("average", 20, 5), ("weighted_average", 20, 7), ("take_first", 30, 10), ("take_last", 19, 18), ("average", 20, 0), ("weighted_average", 500, 50)])
@pytest.mark.parametrize("by", [["g"], []])
def test_chunks(spark, merge, size, lap, by):
    rows, df = frame(spark, 133)
    options = {"merge": merge, "chunk_size": size, "overlap": lap, "fraction": 0.5, "iterations": 1}
    got = {r.id: r.y_smooth for r in chunked.smooth_chunked(df, "v", "y", by, **options).collect()}
    assert len(got) == len(rows)
    for g in ("a", "b", None) if by else ("all",):
        own = [r for r in rows if not by or r[0] == g]
        want = chunks_by_hand(np.array([r[2] for r in own]), np.array([r[3] for r in own]), Options.of(delta=0.0, **options))
        order = sorted(own, key=lambda r: (r[2], r[3]))
        if lap < size - 1 or merge != "take_last":
            assert np.allclose([got[r[1]] for r in order], want[:, 2], atol=1e-9)
    assert chunked.chunk_diagnostics(chunked.smooth_chunked(df, "v", "y", by, **options), "y", by).count() == (3 if by else 1)


def online_by_hand(x, y, o):
    return [chunked.online_values(x[: k + 1], y[: k + 1], o, k)[0][0] for k in range(len(x))]


@pytest.mark.parametrize("update", ["full", "incremental"])
@pytest.mark.parametrize("by", [["g"], []])
def test_online(spark, update, by):
    rows, df = frame(spark, 90)
    options = {"update": update, "window_capacity": 12, "min_points": 3, "fraction": 0.5, "iterations": 1}
    got = {r.id: r for r in chunked.smooth_online(df, "v", "y", ["id"], by, block=15, **options).collect()}
    for g in ("a", "b", None) if by else ("all",):
        own = [r for r in rows if not by or r[0] == g]
        want = online_by_hand(np.array([r[2] for r in own]), np.array([r[3] for r in own]), Options.of(delta=0.0, **options))
        have = [got[r[1]].y_smooth for r in own]
        assert have[:2] == [None, None] and np.allclose(have[2:], want[2:])
    with pytest.raises(UnsupportedFeature):
        chunked.smooth_online(df, "v", "y", ["id"], confidence_level=0.9)


def test_online_line_is_exact(spark):
    df = spark.createDataFrame([(k, float(k), 2.0 * k + 1) for k in range(30)], "s long, x double, y double")
    got = chunked.smooth_online(df, "x", "y", ["s"], window_capacity=10).orderBy("s").collect()
    assert got[0].y_smooth is None and np.allclose([r.y_smooth for r in got[1:]], [2 * k + 1 for k in range(1, 30)])


@pytest.mark.parametrize("options", [{}, {"boundary": "reflect", "scale": "mar", "kernel": "gaussian"}, {"boundary": "none", "robustness": "talwar", "scale": "mean"}, {"boundary": "zero", "robustness": "huber", "iterations": 1}, {"fraction": 1}, {"auto_converge": 1e-3, "iterations": 8}, {"delta": 100.0}])
def test_large_series(spark, options, monkeypatch):
    if options.get("delta") or options.get("scale"):  # anchors step by step, as beyond WALK points
        monkeypatch.setattr(relational, "WALK", 0)
    rows, df = frame(spark, 400, 5, ties=options.get("scale") == "mar")
    options = {"fraction": 0.4, "iterations": 2} | options
    got = {r.id: r for r in relational.smooth_large(df, "v", "y", "w", **options).collect()} if options["fraction"] < 1 else {r.id: r for r in relational.smooth_large(df, "v", "y", **options).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[3]))
    f = kernel.fit_series([r[2] for r in order], [r[3] for r in order], [r[4] for r in order] if options["fraction"] < 1 else None, Options.of(**options))
    assert np.allclose([got[r[1]].y_smooth for r in order], f.y_smooth, atol=1e-8)
    assert np.allclose([got[r[1]].robustness_weight for r in order], f.robustness_weight, atol=1e-6)


def test_large_series_edges(spark):
    _, df = frame(spark, 60)
    with pytest.raises(UnsupportedFeature):
        relational.smooth_large(df, "v", "y", standard_error=True)
    assert relational.smooth_large(df.where("id < 0"), "v", "y").collect() == []


def test_medians_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(relational, "COLLECT", 5)
    rng = np.random.default_rng(1)
    for v in (rng.normal(size=501), np.repeat([1.0, 2.0, 7.0], 40), np.array([3.0]), rng.exponential(size=300) ** 4):
        df = spark.createDataFrame([(float(a),) for a in v], "v double")
        assert relational.exact_median(df, F.col("v")) == pytest.approx(np.median(v), rel=1e-15)
    rows, df = frame(spark, 100)
    got = ranks.global_rank(df, ["v", "id"], Scratch(spark, "test")).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(100)) and [r.id for r in got] == [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]


def test_streams_equal_batches(spark, tmp_path):
    rows, df = frame(spark, 120)
    data = [(r[0], r[1], float(r[1]), r[3], False) for r in rows] + [(g, 10**6, None, None, True) for g in ("a", "b", None)]
    schema = "g string, id long, v double, y double, last boolean"
    for k in range(0, len(data), 41):
        spark.createDataFrame(data[k : k + 41], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    options = {"fraction": 0.5, "iterations": 1}
    whole = spark.createDataFrame(data[:120], schema)
    cases = [
        (processors.online_stream, {"window_capacity": 9}, chunked.smooth_online(whole, "v", "y", ["id"], ["g"], window_capacity=9, **options)),
        (processors.chunk_stream, {"chunk_size": 15, "overlap": 4}, chunked.smooth_chunked(whole, "v", "y", ["g"], chunk_size=15, overlap=4, **options)),
    ]
    for n, (make, more, want) in enumerate(cases):
        stream = series.stream_series(spark, str(tmp_path / "in"), schema, maxFilesPerTrigger=1)
        query = make(stream, "v", "y", "id", ["g"], final="last", **options, **more).writeStream.format("memory").queryName(f"s{n}").option("checkpointLocation", str(tmp_path / f"c{n}")).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
        got = {r.seq: r for r in spark.table(f"s{n}").where("NOT late").collect()}
        want = {r.id: r.y_smooth for r in want.collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert (got[k].y_smooth is None and v is None) or got[k].y_smooth == pytest.approx(v, abs=1e-9)


def streamed(spark, path, make, batches, schema, **options):
    """The rows that a stream over these micro-batches gives."""
    (path / "in").mkdir(parents=True)
    stream = series.stream_series(spark, str(path / "in"), schema, maxFilesPerTrigger=1)
    query = make(stream, "x", "y", "seq", ["g"], **options).writeStream.format("memory").queryName(path.name).option("checkpointLocation", str(path / "c")).outputMode("append")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        if k == 0:
            query = query.start()
        query.processAllAvailable()
    query.stop()
    return spark.table(path.name).collect()


SIGNALS = "g string, seq long, x double, y double, last boolean, again boolean"


@pytest.mark.parametrize("lap", [0, 3])
def test_late_rows_of_a_stream_with_falling_x(spark, tmp_path, lap):
    path = tmp_path / f"late{lap}"
    rows = [("a", k, 100.0 - k, float(k), False, False) for k in range(10)]
    late = [("a", k, 50.0, 7.0, False, False) for k in (3, 9)]
    more = [("a", k, 100.0 - k, float(k), False, False) for k in range(10, 20)] + [("a", 99, None, None, True, False)]
    got = streamed(spark, path, processors.chunk_stream, [rows, late, more], SIGNALS, chunk_size=10, overlap=lap, final="last")
    assert sorted((r.seq, r.late) for r in got) == sorted([(k, False) for k in range(20)] + [(3, True), (9, True)])
    assert all(r.y_smooth is None or np.isnan(r.y_smooth) for r in got if r.late)


def test_reset_and_a_second_start(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("a", k, float(k), float(rng.normal()), False, k == 8) for k in range(16)]
    options = {"fraction": 0.5, "window_capacity": 6}
    got = streamed(spark, tmp_path / "online", processors.online_stream, [rows[:5], rows[5:]], SIGNALS, reset="again", **options)
    x, y = (np.array([r[c] for r in rows]) for c in (2, 3))
    o = Options.of(delta=0.0, **options)
    want = np.concatenate([chunked.online_values(x[:8], y[:8], o)[0], chunked.online_values(x[8:], y[8:], o)[0]])
    assert np.allclose([r.y_smooth if r.y_smooth is not None else np.nan for r in sorted(got, key=lambda r: r.seq)], want, equal_nan=True)
    # of chunks, what waits is dropped
    rows = [("a", k, float(k), 1.0, False, False) for k in range(13)] + [("a", 13, None, None, False, True)] + [("a", k, float(k), 2.0, False, False) for k in range(14, 26)] + [("a", 26, None, None, True, False)]
    got = streamed(spark, tmp_path / "chunks", processors.chunk_stream, [rows], SIGNALS, chunk_size=10, overlap=2, final="last", reset="again")
    assert sorted(r.seq for r in got) == [*range(8), *range(14, 26)]


@pytest.mark.parametrize("update", ["incremental"])
def test_online_arrays_equal_single_fits(update):
    rng = np.random.default_rng(7)
    for o in (Options.of(delta=0.0, window_capacity=9, fraction=f, min_points=m, kernel=k) for f, m, k in ((0.5, 2, "tricube"), (0.3, 3, "gaussian"), (1.0, 2, "uniform"))):
        for x in (np.arange(40.0), np.round(np.sort(rng.uniform(0, 9, 40))), rng.uniform(0, 9, 40), np.zeros(40)):
            y = rng.normal(size=40)
            got, _ = chunked.online_values(x, y, o)
            for k in range(2, 40):
                a = max(0, k - 8)
                want = np.nan if k + 1 < o.min_points else kernel.fit_last(x[a : k + 1], y[a : k + 1], o)
                assert got[k] == pytest.approx(want, abs=1e-12)
            assert np.array_equal(chunked.online_values(x, y, o, 25)[0], got[25:], equal_nan=True)


FULL = [
    {},
    {"boundary": "reflect", "scale": "mar", "kernel": "gaussian", "robustness": "huber"},
    {"boundary": "none", "robustness": "talwar", "scale": "mean", "iterations": 2, "kernel": "uniform", "fallback": "return_original"},
    {"boundary": "zero", "robustness": "talwar", "kernel": "cosine", "fallback": "return_none", "strict_none": True},
    {"delta": 1.5, "iterations": 1},
    {"delta": None},
    {"auto_converge": 0.05, "iterations": 6},
    {"fraction": 1.0},
    {"iterations": 0, "fraction": 0.05},
]


@pytest.mark.parametrize("options", FULL)
def test_full_updates_equal_single_fits_and_come_from_arrays(options, monkeypatch):
    """Windows are worked out together: a fit a window was 1.3 ms a row, whatever else was done."""
    rng = np.random.default_rng(9)
    o = Options.of(**{"delta": 0.0, "fraction": 0.5, "window_capacity": 9, "min_points": 2, "update": "full"} | options)
    single = kernel.fit_series
    for x in (np.arange(40.0), np.round(np.sort(rng.uniform(0, 9, 40))), rng.uniform(0, 9, 40), np.round(rng.uniform(0, 9, 40)), np.zeros(40), 1.7e9 + np.sort(rng.uniform(0, 1e6, 40))):
        for y in (rng.normal(size=40), np.where(rng.random(40) < 0.1, 1e4, rng.normal(size=40)), np.ones(40)):
            one = [single(x[max(0, k - 8) : k + 1], y[max(0, k - 8) : k + 1], None, o) for k in range(2, 40)]
            with monkeypatch.context() as m:
                m.setattr(kernel, "fit_series", None)
                fit, rw = chunked.online_values(x, y, o)
            assert np.allclose(fit[2:], [f.y_smooth[-1] for f in one], rtol=1e-12, atol=1e-12, equal_nan=True)
            assert np.allclose(rw[2:], [f.robustness_weight[-1] for f in one], rtol=1e-12, atol=1e-12, equal_nan=True)
    y[20] = np.nan
    with pytest.raises(InvalidData, match="isn't finite"):
        chunked.online_values(x, y, o)


def test_full_updates_that_choose_their_span():
    rng = np.random.default_rng(11)
    x, y = np.arange(20.0), rng.normal(size=20)
    o = Options.of(delta=0.0, window_capacity=12, min_points=12, update="full", cv_fractions=(0.4, 0.8), cv_k=3, iterations=1)
    fit, _ = chunked.online_values(x, y, o)
    assert np.isnan(fit[:11]).all()
    assert np.allclose(fit[11:], [kernel.fit_series(x[k - 11 : k + 1], y[k - 11 : k + 1], None, o).y_smooth[-1] for k in range(11, 20)])


def test_data_is_checked_for_lines_too(spark):
    schema = "g string, v double, y double, w double"
    good = [("a", 1.0, 2.0, 1.0), ("a", 2.0, 3.0, 0.0)]
    for fraction in (0.5, 1):
        assert batch.smooth(spark.createDataFrame(good, schema), "v", "y", ["g"], "w", fraction=fraction).count() == 2
        for bad, why in (([("b", 1.0, 2.0, 1.0)], "two points"), ([("b", None, 2.0, 1.0)] * 2, "x"), ([("b", 1.0, float("nan"), 1.0)] * 2, "y"), ([("b", 1.0, 2.0, -1.0), ("b", 2.0, 2.0, 1.0)], "weight")):
            with pytest.raises(Exception, match=why):
                batch.smooth(spark.createDataFrame(good + bad, schema), "v", "y", ["g"], "w", fraction=fraction).collect()


def test_results_one_after_the_other(spark):
    a = spark.createDataFrame([(1.0, 0.5, 2)], "y_smooth double, fraction_used double, iterations_used int")
    b = spark.createDataFrame([(2.0, 4.0, 0.9)], "y_smooth double, standard_error double, fraction_used double")
    got = sorted(batch.concat_results(a, b).collect(), key=lambda r: r.y_smooth)
    assert [(r.y_smooth, r.fraction_used, r.iterations_used, r.standard_error) for r in got] == [(1.0, 0.5, 2, None), (2.0, 0.5, 2, 4.0)]
    assert kernel.df_from_leverages([0.5, 0.25, 1.0]) == 1.75
    with pytest.raises(InvalidOption, match="one fraction"):
        Options.of(cv_fractions=())


def test_files(spark, tmp_path):
    _, df = frame(spark, 12)
    for kind in ("parquet", "csv", "json"):
        series.write_series(df, str(tmp_path / kind), kind)
        assert series.read_series(spark, str(tmp_path / kind), kind).count() == 12
