"""Cleaning, quality, heterogeneity, sources, model, stream and command line on hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom.config import CandidateConfig, GraphConfig, HeterogeneityConfig, QualityConfig
from rasterloom.functions.geometry import brightness_class
from rasterloom.model import fit
from rasterloom.model.features import Sizes, features, initial
from rasterloom.operators import fill, graphs, heterogeneity, learning, positions, quality, raster
from rasterloom.operators import neighborhood as N
from rasterloom.plans import builders, tiled
from rasterloom.sources import frames, npy, sinks, synthetic
from rasterloom.streaming import ingest

SHAPE = (14, 13, 13)
CONFIG = GraphConfig(ext_range=2, max_ext=2, edge_time=4, edge_height=4, edge_width=4, sample_per_class=40)


@pytest.fixture(scope="module")
def cube(spark):
    return raster.clean(synthetic.cube(spark, SHAPE)).cache()


def test_quality_flags_and_nodata(spark):
    rows = [(0, 0, 0, 650, None), (0, 0, 1, 650, 0), (0, 0, 2, 650, 1), (0, 0, 3, 650, 2), (0, 0, 4, 65535, 0), (0, 0, 5, 650, 255)]
    found = raster.clean(spark.createDataFrame(rows, "t int, h int, w int, raw int, quality int")).orderBy("w").collect()
    assert [r.value is not None for r in found] == [True, True, True, False, False, False]
    assert found[0].value == pytest.approx(0.65)
    joined = raster.join_quality(spark.createDataFrame([(0, 0, 5, 650)], "t int, h int, w int, raw int"), spark.createDataFrame([(0, 0, 5, 255)], "t int, h int, w int, quality int"))
    assert raster.clean(joined).first().value is not None


def test_values_on_a_break_belong_to_no_open_class(spark):
    df = spark.createDataFrame([(raw,) for raw in (1, 2, 25, 100, 0, 99, 101)], "raw int")
    value = (F.col("raw").cast("double") / 10.0 / 100.0).cast("float")
    breaks = GraphConfig().breaks
    got = {r.raw: (r.o, r.c) for r in df.select("raw", brightness_class(value, breaks).alias("o"), brightness_class(value, breaks, "left_closed").alias("c")).collect()}
    assert got == {1: (0, 2), 2: (2, 2), 25: (0, 6), 100: (0, 7), 0: (1, 1), 99: (6, 6), 101: (7, 7)}


def test_quantiles_equal_sorted_values(spark):
    rng = np.random.default_rng(6)
    for values in ([1.5], [2.0, 2.0, 2.0], [1.0, 4.0], list(rng.exponential(size=3_001)), [0.0] * 900 + [float(v) for v in rng.integers(0, 5, 101)], [1e-9, 1.0, 1e9, -3.0]):
        points = (0.0, 0.25, 0.5, 0.999, 1.0)
        got = raster.quantiles(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3), points).first()
        assert list(got) == pytest.approx(list(np.quantile(values, points)), rel=1e-12)
    assert list(raster.quantiles(spark.createDataFrame([(None,)], "v double"), (0.5,)).first()) == [None]


def test_quality_of_flat_zero_and_single_pixels(spark):
    rows = [(t, 0, 0, 5.0) for t in range(3)] + [(t, 0, 1, 0.0) for t in range(3)] + [(0, 0, 20, 1.0), (1, 0, 20, None), (2, 0, 20, None), (0, 0, 40, None)]
    plane = quality.pixels(spark.createDataFrame(rows, "t int, h int, w int, value float"))
    stable = {r.w: r.tstab for r in quality.stability(plane).collect()}
    assert stable == {0: 1.0, 1: 0.5, 20: 1.0, 40: 0.0}
    smooth = {r.w: r.s for r in quality.continuity(plane).collect()}
    assert smooth[20] == 1.0 and smooth[40] == 0.0 and smooth[0] == pytest.approx(np.exp(-62.5))
    bound = QualityConfig()
    n = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "q double").select("q", quality.node_count(F.col("q"), bound).alias("n"))
    assert {r.q: r.n for r in n.collect()} == {0.0: 18, 0.5: 36, 1.0: 54, None: 36}


def test_heterogeneity_needs_pixels_and_brightness(spark):
    rows = [(0, h, w, 0.0) for h in range(3) for w in range(3)] + [(0, h, w + 50, float(h + 1)) for h in range(3) for w in range(3)] + [(0, 0, 99, 1.0)]
    centers = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 1, 51), (3, 0, 0, 99), (4, 0, 500, 500)], "graph_id long, t int, h int, w int")
    found = heterogeneity.weights(heterogeneity.index(centers, spark.createDataFrame(rows, "t int, h int, w int, value float"), HeterogeneityConfig(radius=2)))
    got = {r.graph_id: (r.het, r.w_spatial) for r in found.collect()}
    assert got[1] == (-1.0, 0.5) and got[3] == (-1.0, 0.5) and got[4] == (-1.0, 0.5)
    assert got[2][0] == pytest.approx(np.std([1, 2, 3]) / 2) and got[2][1] > 0.5


def test_samples_are_exact_and_repeatable(spark, cube):
    drawn = positions.training_centers(cube, SHAPE, CONFIG)
    by = {r["class"]: r["count"] for r in drawn.groupBy("class").count().collect()}
    assert set(by.values()) == {40}
    again = positions.training_centers(cube.repartition(7), SHAPE, CONFIG)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    parts = positions.split(spark.range(101), ("id",)).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 80, "val": 21}


def test_candidates_leave_the_center_out_and_respect_the_pool(spark, cube):
    centers = builders.numbered(cube.where(positions.in_region(SHAPE, (6, 6, 6)) & F.col("value").isNotNull()).select("t", "h", "w"), SHAPE)
    config = CandidateConfig(initial_radius=3, max_radius=6)
    pool = N.candidates(centers, cube, config)
    assert pool.where("dt = 0 and dh = 0 and dw = 0").count() == 0
    counts = pool.groupBy("graph_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert counts and all(r.n == 64 == r.last for r in counts)
    row = graphs.padded(pool.where("rank <= 50"), 64).first()
    assert sum(row.mask) == 50 and len(row.candidates) == 64
    nodes = builders.from_candidates(centers, cube, config)[1]
    assert nodes.groupBy("graph_id").count().where("count <> 36").count() == 0


def test_frames_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    planes = {d: rng.integers(0, 60_000, (4, 5)).astype(np.uint16) for d in (1, 3, 366)}
    for d, plane in planes.items():
        (tmp_path / f"2020{d:03d}_50KM.tif").write_bytes(frames.encode_tiff(plane))
    (tmp_path / "2020002_50KM.tif").write_bytes(b"broken")
    (tmp_path / "notes_50KM.tif").write_bytes(b"")
    found = frames.year_cube(spark, str(tmp_path), 2020, (4, 5))
    assert found.count() == 366 * 20
    assert found.where("t = 1 and raw is not null").count() == 0
    for d, plane in planes.items():
        rows = found.where(F.col("t") == d - 1).orderBy("h", "w").collect()
        assert [r.raw for r in rows] == plane.ravel().tolist()


def test_npy_cube(spark, tmp_path):
    data = np.arange(5 * 3 * 4, dtype=np.float32).reshape(5, 3, 4)
    data[2, 1, 1] = np.nan
    np.save(tmp_path / "c.npy", data)
    rows = npy.read(spark, str(tmp_path / "c.npy"), days=2).collect()
    assert len(rows) == 60
    for r in rows:
        assert (r.raw is None) if (r.t, r.h, r.w) == (2, 1, 1) else r.raw == data[r.t, r.h, r.w]


def test_npy_bounds_reach_the_source(spark, tmp_path):
    data = np.arange(40 * 6 * 7, dtype=np.float64).reshape(40, 6, 7)
    np.save(tmp_path / "c.npy", data)
    every = npy.read(spark, str(tmp_path / "c.npy"), days=4)
    some = every.where("t >= 9 and t < 14 and h = 2 and w > 3")
    assert every.rdd.getNumPartitions() == 10 and some.rdd.getNumPartitions() == 2
    assert {(r.t, r.h, r.w): r.raw for r in some.collect()} == {(t, 2, w): data[t, 2, w] for t in range(9, 14) for w in range(4, 7)}
    assert every.where("t = 99").count() == 0


def test_npy_cube_is_written_whole_or_not_at_all(spark, tmp_path):
    rng, path = np.random.default_rng(2), str(tmp_path / "cube")
    data = np.where(rng.random((9, 11, 10)) < 0.3, np.nan, rng.random((9, 11, 10)))
    rows = [(*map(int, i), None if np.isnan(v) else float(v)) for i, v in np.ndenumerate(data)]
    df = spark.createDataFrame(rows, "t int, h int, w int, value double").repartition(5)
    npy.write(df, path, data.shape, days=4, side=4)
    read = lambda: {(r.t, r.h, r.w): r.raw for r in npy.read(spark, path).collect()}
    assert read() == {r[:3]: r[3] for r in rows}
    assert npy.read(spark, path).where("h >= 8 and t < 4").rdd.getNumPartitions() == 3

    @F.udf("double")
    def fails(t, v):
        if t == 8:
            raise RuntimeError("planned")
        return v

    with pytest.raises(Exception, match="planned"):
        npy.write(df.withColumn("value", fails("t", "value")), path, data.shape, days=4, side=4)
    assert read() == {r[:3]: r[3] for r in rows}  # the cube before is untouched
    npy.write(df.where("t < 3 and value is not null"), path, data.shape, days=4, side=4)
    assert {k: v for k, v in read().items() if v is not None} == {r[:3]: r[3] for r in rows if r[0] < 3 and r[3] is not None}
    with pytest.raises(Exception, match="off the grid"):
        npy.write(df, path, (9, 11, 9), days=4, side=4)


def packed_bits(data: bytes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        n = 1
        while n < 128 and data[at : at + n + 1] == data[at : at + 1] * (n + 1):
            n += 1
        out += bytes([257 - n, data[at]]) if n > 1 else bytes([0, data[at]])
        at += n
    return out


def packed_lzw(data: bytes) -> bytes:
    codes, table, width, now = [], {}, 9, b""

    def clear():
        codes.append((256, width))
        table.clear()
        table.update({bytes([i]): i for i in range(256)})

    clear()
    for byte in data:
        grown = now + bytes([byte])
        if grown in table:
            now = grown
            continue
        codes.append((table[now], width))
        table[grown] = len(table) + 2
        if len(table) + 2 >= 4094:
            clear()
            width = 9
        elif len(table) + 2 > (1 << width) - 1:
            width += 1
        now = bytes([byte])
    if now:
        codes.append((table[now], width))
        if len(table) + 3 > (1 << width) - 1:  # the reader's table grows by one more
            width = min(12, width + 1)
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def plain_tiff(plane, order="<", big=False, tile=None, method=1, predictor=1, rows=3, samples=1) -> bytes:
    """A TIFF file of the plane as its first band, by the letter of the format."""
    import struct
    import zlib

    height, width = plane.shape
    kind = plane.dtype.newbyteorder(order)
    pack = {1: bytes, 5: packed_lzw, 8: zlib.compress, 32773: packed_bits}[method]
    boxes = [(t, 0, min(rows, height - t), width) for t in range(0, height, rows)] if tile is None else [(t, x, tile, tile) for t in range(0, height, tile) for x in range(0, width, tile)]
    bodies = []
    for t, x, h, w in boxes:
        box = np.zeros((h, w), plane.dtype)
        part = plane[t : t + h, x : x + w]
        box[: part.shape[0], : part.shape[1]] = part
        if predictor == 2:
            box[:, 1:] = box[:, 1:] - box[:, :-1]
        bodies.append(pack(np.repeat(box[:, :, None], samples, axis=2).astype(kind).tobytes()))
    head = (struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 16) if big else struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8))
    form = {"u": 1, "i": 2, "f": 3}[plane.dtype.kind]
    word, code = ("Q", 16) if big else ("I", 4)
    tags = [(256, [width]), (257, [height]), (258, [plane.dtype.itemsize * 8]), (259, [method]), (277, [samples]), (317, [predictor]), (339, [form])]
    tags += [(322, [tile]), (323, [tile])] if tile else [(278, [rows])]
    places = (324, 325) if tile else (273, 279)
    size = (8 + 20 * (len(tags) + 2) + 8) if big else (2 + 12 * (len(tags) + 2) + 4)
    lists = len(head) + size
    step = 8 if big else 4
    body_at = lists + 2 * step * len(bodies)
    offsets = [body_at + sum(map(len, bodies[:i])) for i in range(len(bodies))]
    tags = sorted([*tags, (places[0], offsets), (places[1], [len(b) for b in bodies])])
    out, extra = struct.pack(order + ("Q" if big else "H"), len(tags)), b""
    for tag, values in tags:
        held = struct.pack(f"{order}{len(values)}{word}", *values)
        if len(held) > step:
            held, extra = struct.pack(order + word, lists + len(extra)), extra + held
        out += struct.pack(order + ("HHQ" if big else "HHI"), tag, code, len(values)) + held.ljust(step, b"\0")
    return head + out + b"\0" * step + extra.ljust(body_at - lists, b"\0") + b"".join(bodies)


def test_tiff_forms_round_trip():
    rng = np.random.default_rng(8)
    smooth = (np.add.outer(np.arange(37) * 3, np.arange(53) * 5) + rng.integers(0, 4, (37, 53)))
    for kind in ("u1", "u2", "i2", "u4", "f4", "f8"):
        plane = smooth.astype(kind)
        for order in "<>":
            for big in (False, True):
                for tile in (None, 16):
                    for method in (1, 5, 8, 32773):
                        for predictor in (1, 2) if plane.dtype.kind != "f" else (1,):
                            got = frames.decode(plain_tiff(plane, order, big, tile, method, predictor))
                            assert got.dtype == plane.dtype and (got == plane).all(), (kind, order, big, tile, method, predictor)
    assert (frames.decode(plain_tiff(smooth.astype("u2"), samples=3)) == smooth).all()
    wide = rng.integers(0, 256, (120, 200)).astype("u1")  # fills LZW's table several times
    assert (frames.decode(plain_tiff(wide, method=5, rows=120)) == wide).all()


def test_broken_tiffs_say_why(spark, tmp_path):
    rng = np.random.default_rng(9)
    plane = rng.integers(0, 60_000, (9, 8)).astype("u2")
    whole = {m: plain_tiff(plane, method=m, tile=16 if m == 5 else None) for m in (1, 5, 8, 32773)}
    for n in range(4_000):
        data = bytearray(whole[[1, 5, 8, 32773][n % 4]])
        for _ in range(rng.integers(1, 5)):
            data[rng.integers(0, len(data))] = rng.integers(0, 256)
        try:
            frames.decode(bytes(data[: rng.integers(1, len(data) + 1)] if n % 3 else data))
        except ValueError:
            pass
    (tmp_path / "2021001_50KM.tif").write_bytes(whole[8])
    (tmp_path / "2021002_50KM.tif").write_bytes(whole[8][:-9])
    (tmp_path / "2021003_50KM.tif").write_bytes(b"not a frame")
    report = {r.doy: r for r in frames.frame_report(spark, str(tmp_path)).collect()}
    assert (report[1].height, report[1].width, report[1].error) == (9, 8, None)
    assert report[2].error and report[3].error == "not a TIFF file"
    assert frames.read(spark, str(tmp_path)).select("doy").distinct().count() == 1


def test_cube_store_prunes_by_days(spark, cube, tmp_path):
    sinks.write_cube(cube, str(tmp_path / "cube"), days=4)
    held = sinks.read_cube(spark, str(tmp_path / "cube"), (4, 6), block=4)
    assert held.select("t").distinct().count() == 3
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert sinks.built_once(spark, str(tmp_path / "once"), build).count() == 3
    assert len(calls) == 1


def test_early_stop_and_metrics(spark):
    history = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 2.5), (3, 2.0), (4, 1.0)], "epoch int, val_loss double")
    assert learning.best_epoch(history).first().epoch == 4
    assert [r.stale for r in learning.early_stop(history, 2).orderBy("epoch").collect()] == [0, 0, 1, 2, 0]
    flat = learning.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "target double, predicted double")).first()
    assert (flat.mse, flat.mae, flat.r2) == (1.0, 1.0, 0.0)


def test_gradient_by_differences(spark):
    rng = np.random.default_rng(1)
    rows = [([float(v) for v in rng.normal(size=5)], float(rng.normal())) for _ in range(40)]
    df = spark.createDataFrame(rows, "x array<double>, target double").repartition(4).cache()
    params = fit.start(5, 3, np.full(5, 0.1), np.full(5, 1.3), 2).params
    params |= {"b1": rng.normal(size=3), "b2": rng.normal(size=1)}
    grads, loss, n = fit.gradient(df, params)
    assert n == 40
    half = lambda p: fit.predicted(df, p).agg(F.avg((F.col("estimate") - F.col("target")) ** 2) / 2).first()[0]
    assert loss == pytest.approx(2 * half(params))
    for name in fit.FITTED:
        at = tuple(rng.integers(0, n) for n in params[name].shape)
        ends = []
        for move in (1e-5, -1e-5):
            moved = params | {name: params[name].copy()}
            moved[name][at] += move
            ends.append(half(moved))
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6), name
    assert fit.gradient(df.limit(0), params)[2] == 0


def test_training_goes_on_after_a_stop_as_if_there_were_none(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = np.tanh(x[:, 0]) + 0.5 * x[:, 1] ** 2
    rows = [(i, [float(v) for v in x[i]], float(y[i]), "train" if i % 5 else "val") for i in range(300)] + [(300, [0.0] * 4, None, "train")]
    vectors = spark.createDataFrame(rows, "graph_id long, x array<double>, target double, part string")
    fit.store(vectors, str(tmp_path / "v"), 2)
    how = {"hidden": 6, "epochs": 4, "rate": 0.1, "batches": 2}
    best, history = fit.train(spark, str(tmp_path / "v"), str(tmp_path / "once"), **how)
    whole = sorted(map(tuple, history.collect()))
    assert len(whole) == 4 and min(h[2] for h in whole) < 0.9 * whole[0][2]
    for now in (2, None):
        again, history = fit.train(spark, str(tmp_path / "v"), str(tmp_path / "stopped"), **how, now=now)
    assert np.allclose(whole, sorted(map(tuple, history.collect())), rtol=1e-9)
    assert all(np.allclose(best[k], again[k]) for k in best)
    kept = fit.from_table(fit.to_table(spark, best))
    assert all((kept[k] == best[k]).all() for k in best)


def test_training_lowers_the_loss_and_fills(spark, cube, tmp_path):
    centers = positions.training_centers(cube, SHAPE, CONFIG).withColumn("graph_id", F.col("class").cast("long") * 1000 + F.col("sample_id"))
    target = centers.join(cube.select("t", "h", "w", F.col("value").cast("double").alias("target")), ["t", "h", "w"]).select("graph_id", "target")
    sizes = Sizes(hidden=4, layers=1)
    layers = initial(sizes, "fixed")
    made = tiled.build(centers, cube, SHAPE, CONFIG).cache()
    vectors = features(made, layers, sizes).join(target, "graph_id")
    fit.store(positions.split(vectors, ("graph_id",)), str(tmp_path / "v"), 2)
    best, history = fit.train(spark, str(tmp_path / "v"), str(tmp_path / "c"), epochs=4, rate=0.05, batches=2)
    losses = [r.val_loss for r in history.orderBy("epoch").collect()]
    assert min(losses) < losses[0]
    gaps = builders.numbered(positions.missing(cube, SHAPE, (4, 4, 4)), SHAPE)
    found = tiled.build(gaps, cube, SHAPE, CONFIG).cache()
    scored = fit.predicted(features(found, layers, sizes), best).join(gaps, "graph_id").cache()
    full = fill.write_back(cube, scored).cache()
    assert full.where("was_gap and filled is not null").count() == scored.count() == found.count() > 0
    assert full.count() == cube.count()
    for kept in (made, found, scored, full):
        kept.unpersist()


def test_stream_builds_each_batch_once(spark, cube, tmp_path):
    raw = synthetic.cube(spark, SHAPE)
    land = str(tmp_path / "land")
    raw.coalesce(1).write.parquet(land)
    config = GraphConfig(ext_range=2, max_ext=1, edge_time=4, edge_height=5, edge_width=5)
    for _ in range(2):
        query = ingest.start(ingest.frames(spark, land), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"), SHAPE, config)
        query.awaitTermination(240)
    got = ingest.latest_graphs(spark, str(tmp_path / "out"))
    want = builders.for_prediction(cube, SHAPE, config).packed()
    assert sorted(r.graph_id for r in got.select("graph_id").collect()) == sorted(r.graph_id for r in want.select("graph_id").collect())


def test_command_line_converts_frames(spark, tmp_path):
    plane = np.arange(12, dtype=np.uint16).reshape(3, 4)
    (tmp_path / "2020002_50KM.tif").write_bytes(plain_tiff(plane, method=8))
    cli.main(["convert", "--input", str(tmp_path), "--output", str(tmp_path / "cube"), "--year", "2020", "--height", "3", "--width", "4"])
    held = sinks.read_cube(spark, str(tmp_path / "cube"))
    assert held.count() == 366 * 12
    assert [r.raw for r in held.where("t = 1").orderBy("h", "w").collect()] == list(range(12)) and held.where("t <> 1 and raw is not null").count() == 0


def test_command_line(spark, tmp_path):
    store = str(tmp_path / "in")
    synthetic.cube(spark, SHAPE).write.parquet(store)
    common = ["--input", store, "--ext-range", "2", "--max-ext", "2", "--edge-time", "4", "--edge-height", "4", "--edge-width", "4", "--sample-per-class", "10"]
    cli.main(["predict", *common, "--output", str(tmp_path / "p")])
    assert spark.read.parquet(str(tmp_path / "p" / "graph_32_forPred")).count() > 0
    cli.main(["train", *common, "--output", str(tmp_path / "t"), "--path", "relational"])
    assert spark.read.parquet(str(tmp_path / "t" / "graph_10_32_forTrain")).where("class is not null").count() > 0


@pytest.mark.parametrize("scheme", ["a", "b", "c"])
def test_command_line_schemes(spark, tmp_path, scheme):
    store, out = str(tmp_path / "in"), str(tmp_path / scheme)
    synthetic.cube(spark, SHAPE).write.parquet(store)
    common = ["--input", store, "--ext-range", "3", "--max-ext", "1", "--edge-time", "4", "--edge-height", "4", "--edge-width", "4", "--sample-per-class", "6", "--scheme", scheme, "--max-radius", "4", "--output", out]
    fitting = ["--model", f"{out}/model", "--epochs", "1", "--hidden-dim", "4", "--num-layers", "1"]
    cli.main(["fit", *common, *fitting, "--build-only"])
    made = spark.read.parquet(f"{out}/graphs_{scheme}")
    assert {r.part for r in made.select("part").distinct().collect()} == {"train", "val"}
    if scheme == "a":
        assert {r.n % 2 for r in made.select(F.size("idx").alias("n")).collect()} == {0}
    cli.main(["fit", *common, *fitting])
    cli.main(["fill", *common[:-1], f"{out}/cube", *fitting])
    assert spark.read.parquet(f"{out}/cube").where("was_gap and filled is not null").count() > 0
    cli.main(["train", *common])
    kept = spark.read.parquet(f"{out}/graph_6_32_forTrain")
    assert {"a": "nodes", "b": "het", "c": "candidates"}[scheme] in kept.columns and kept.count() > 0


def test_command_line_fits_stored_graphs_of_several_schemes(spark, tmp_path):
    store, stores = str(tmp_path / "in"), []
    synthetic.cube(spark, SHAPE).write.parquet(store)
    common = ["--input", store, "--ext-range", "3", "--max-ext", "1", "--edge-time", "4", "--edge-height", "4", "--edge-width", "4", "--sample-per-class", "6", "--max-radius", "4"]
    for scheme in ("plain", "a", "c"):
        cli.main(["train", *common, "--scheme", scheme, "--output", str(tmp_path / scheme)])
        stores.append(f"{scheme}={tmp_path / scheme}/graph_6_32_forTrain")
    out = str(tmp_path / "out")
    fitting = ["baseline", "--graphs", *stores, "--output", out, "--hidden-dim", "4", "--num-layers", "1"]
    cli.main([*fitting, "--epochs", "1"])
    metrics = {(r.scheme, r.part): r for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert {s for s, _ in metrics} == {"plain", "a", "c"} and all(np.isfinite(r.mse) for r in metrics.values())
    parts = {(r.t, r.h, r.w): r.part for r in spark.read.parquet(f"{out}/parts").collect()}
    for s in stores:  # a position is in one part, whatever the scheme
        name, path = s.split("=")
        held = spark.read.parquet(f"{out}/vectors_{name}").join(spark.read.parquet(path).select("graph_id", "center"), "graph_id")
        assert held.count() and all(parts[tuple(r.center)] == r.part for r in held.select("center", "part").collect())
    cli.main([*fitting, "--epochs", "2"])
    assert spark.read.parquet(f"{out}/history").groupBy("scheme").count().where("count <> 2").count() == 0
