"""Neighbourhood graphs against the sequential model, and the tile path against the relational one."""

from dataclasses import replace

import numpy as np
import pytest
from oracle_py import graph, quadrant, walk
from pyspark.sql import functions as F

from rasterloom.config import GraphConfig
from rasterloom.functions.geometry import line_to_center, offsets
from rasterloom.operators import neighborhood as N
from rasterloom.operators import tiles
from rasterloom.plans import builders, tiled

CONFIG = GraphConfig(ext_range=2, max_ext=3, edge_time=5, edge_height=5, edge_width=5)


def voxels(spark, cube):
    rows = [(*map(int, i), None if np.isnan(v) else float(v)) for i, v in np.ndenumerate(cube)]
    return spark.createDataFrame(rows, "t int, h int, w int, value float")


def cubes():
    rng = np.random.default_rng(5)
    full = rng.random((13, 13, 13)).astype(np.float32)
    gap = full.copy()
    gap[6, 6, 6] = np.nan
    out = {"full": full, "centre_gap": gap, "ties": np.ones((13, 13, 13), np.float32)}
    for share in (10, 30, 50):
        out[f"sparse_{share}"] = np.where(rng.random(full.shape) < share / 100, np.nan, full)
    lean = full.copy()
    for d in np.ndindex(13, 13, 13):
        x = tuple(v - 6 for v in d)
        if quadrant(*x) == 4 and max(map(abs, x)) <= 3:
            lean[d] = np.nan
    out["one_quadrant_empty"] = lean
    return out


def as_dicts(made):
    nodes, edges, radius = {}, {}, {}
    for r in made.nodes.collect():
        nodes.setdefault(r.graph_id, {})[r.idx] = (r.dt, r.dh, r.dw)
        radius[r.graph_id] = r.radius
    for r in made.edges.orderBy("graph_id", "ordinal").collect():
        edges.setdefault(r.graph_id, []).append((r.src, r.dst, r.kind))
    return nodes, edges, radius


@pytest.mark.parametrize("name", sorted(cubes()))
def test_graphs_equal_the_sequential_model(spark, name):
    cube = cubes()[name]
    held = voxels(spark, cube)
    places = [(6, 6, 6), (5, 6, 7), (2, 6, 6), (0, 0, 0)]
    centers = builders.numbered(spark.createDataFrame(places, "t int, h int, w int"), cube.shape)
    made = builders.build(centers, held, cube.shape, CONFIG)
    nodes, edges, radius = as_dicts(made)
    for p in places:
        key = (p[0] * 13 + p[1]) * 13 + p[2]
        want = graph(cube, p, 32, 2, 3)
        if want is None:
            assert key not in nodes
            continue
        assert radius[key] == want[0]
        assert [nodes[key][i] for i in range(1, 33)] == want[1][1:]
        assert sorted(edges[key]) == sorted(want[2])
    flat = tiled.build(centers, held, cube.shape, CONFIG, most=2, top=8, finest=2)
    assert sorted(map(tuple, tiled.nodes(flat).select("graph_id", "idx", "dt", "dh", "dw").collect())) == sorted((g, i, *d) for g, n in nodes.items() for i, d in n.items())
    got = {}
    for r in tiled.edges(flat).orderBy("graph_id", "ordinal").collect():
        got.setdefault(r.graph_id, []).append((r.src, r.dst, r.kind))
    assert got == edges


def test_rings_equal_one_step(spark):
    held = voxels(spark, cubes()["sparse_50"])
    centers = builders.numbered(spark.createDataFrame([(6, 6, 6), (6, 5, 6), (7, 6, 6)], "t int, h int, w int"), (13, 13, 13))
    config = replace(CONFIG, max_ext=4)
    once = N.select_nodes(N.measured(N.extract(centers, held, config.reach)), config)
    steps = N.nodes_of(centers, held, config)
    cols = ["graph_id", "idx", "dt", "dh", "dw", "radius"]
    assert sorted(map(tuple, once.select(*cols).collect())) == sorted(map(tuple, steps.select(*cols).collect()))


def test_no_tile_holds_more_than_its_most_however_centres_crowd(spark):
    """Centres heaped on few places, one of them many times over: groups stay bounded and graphs equal the relational path's."""
    cube = cubes()["sparse_30"]
    places = [(6, 6, 6)] * 130 + [(6, 6, 5)] * 40 + [(5, 6, 7), (2, 6, 6), (10, 9, 9), (0, 0, 0)]
    centers = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "graph_id long, t int, h int, w int")
    found = tiles.leaves(centers, 16, 8, 2)
    dealt = tiles.in_leaves(centers, found, 16, 8, 2)
    sizes = {tuple(r[c] for c in tiles.LEAF): r["count"] for r in dealt.groupBy(*tiles.LEAF).count().collect()}
    assert sum(sizes.values()) == len(places) and max(sizes.values()) <= 16
    for (t0, h0, w0, side, _), (t, h, w) in ((tuple(r[c] for c in tiles.LEAF), (r.t, r.h, r.w)) for r in dealt.collect()):
        assert t0 <= t < t0 + side and h0 <= h < h0 + side and w0 <= w < w0 + side
    held = voxels(spark, cube)
    want = builders.build(centers, held, cube.shape, CONFIG)
    flat = tiled.build(centers, held, cube.shape, CONFIG, most=16, top=8, finest=2).persist()
    cols = ["graph_id", "idx", "dt", "dh", "dw"]
    assert sorted(map(tuple, tiled.nodes(flat).select(*cols).collect())) == sorted(map(tuple, want.nodes.select(*cols).collect()))
    cols = ["graph_id", "ordinal", "src", "dst", "kind"]
    assert sorted(map(tuple, tiled.edges(flat).select(*cols).collect())) == sorted(map(tuple, want.edges.select(*cols).collect()))
    assert flat.count() > 170
    flat.unpersist(), want.release()


def test_tree_without_centres(spark):
    none = spark.createDataFrame([], "graph_id long, t int, h int, w int")
    assert tiles.leaves(none, 5).count() == 0 and tiled.build(none, voxels(spark, cubes()["full"]), (13, 13, 13), CONFIG).count() == 0


def test_a_build_that_stops_goes_on_where_it_ended(spark, tmp_path):
    cube = cubes()["sparse_10"]
    held = voxels(spark, cube)
    centers = builders.numbered(spark.createDataFrame([(t, h, w) for t in (4, 6, 8) for h in (5, 7) for w in (4, 6, 8)], "t int, h int, w int"), cube.shape).persist()
    how = {"most": 3, "top": 4, "finest": 2, "batches": 4}
    want = {r.graph_id: tuple(r.src) for r in tiled.build(centers, held, cube.shape, CONFIG, most=3, top=4, finest=2).collect()}
    path = str(tmp_path / "tiles")
    tiled.build_into(path, centers, held, cube.shape, CONFIG, now=2, **how)
    assert sorted(r.batch for r in tiled.finished(spark, path).collect()) == [0, 1]
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "tiles" / "graphs").rglob("*.parquet")}
    made = tiled.build_into(path, centers, held, cube.shape, CONFIG, **how)
    assert {r.graph_id: tuple(r.src) for r in made.collect()} == want and made.count() == len(want)
    assert all(f.stat().st_mtime_ns == at for f, at in before.items())  # finished batches are not written again
    done = tiled.finished(spark, path).collect()
    assert sorted(r.batch for r in done) == [0, 1, 2, 3]
    assert sum(r.centers for r in done) == centers.count() and sum(r.graphs for r in done) == len(want)
    centers.unpersist()


def test_offsets_partition_and_lines(spark):
    rows = offsets(spark, 6).collect()
    assert len(rows) == 13**3
    for r in rows:
        assert r.quadrant == quadrant(r.dt, r.dh, r.dw)
    sizes = [sum(r.quadrant == q for r in rows) for q in range(7)]
    assert sizes == [1, 454, 454, 322, 322, 322, 322]
    line = line_to_center(F.col("dt"), F.col("dh"), F.col("dw"))
    for r in offsets(spark, 5).select("dt", "dh", "dw", line.alias("p")).collect():
        assert [(c.dt, c.dh, c.dw) for c in r.p] == walk((r.dt, r.dh, r.dw))


def test_packed_graph_keeps_the_target_and_hides_the_center(spark):
    cube = cubes()["full"]
    centers = builders.numbered(spark.createDataFrame([(6, 6, 6)], "t int, h int, w int"), cube.shape)
    row = builders.build(centers, voxels(spark, cube), cube.shape, CONFIG).packed().first()
    assert len(row.nodes) == 33 and row.nodes[0].feature == -1.0
    assert row.nodes[0].truth == pytest.approx(cube[6, 6, 6])
    assert [n.idx for n in row.nodes] == list(range(33))
    assert all(e.src >= e.dst for e in row.edges)
