"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Graphs of the throughput runs.
CENTERS = int(os.environ.get("BENCH_CENTERS", "11200"))


def main() -> None:
    from pyspark.sql import SparkSession

    from rasterloom.config import GraphConfig
    from rasterloom.operators import positions
    from rasterloom.operators.raster import clean
    from rasterloom.plans import builders, catalog, tiled
    from rasterloom.sources import synthetic
    from rasterloom.sources.derived import MIDDLE, cube

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name, make):
        """From the call that makes the table, which may itself run jobs, to its last row."""
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)

    voxels = cube(spark, SF, MIDDLE).persist()
    voxels.count()
    config = GraphConfig(ext_range=3, max_ext=3, edge_time=6, edge_height=6, edge_width=6)
    centers = builders.numbered(voxels.where(positions.in_region(MIDDLE, (6, 6, 6))).select("t", "h", "w"), MIDDLE).limit(CENTERS).persist()
    n = centers.count()
    tiled.build(centers.limit(64), voxels, MIDDLE, config).write.format("noop").mode("overwrite").save()  # starts the workers
    for name, make in (
        ("graphs_tiled", lambda: tiled.build(centers, voxels, MIDDLE, config, most=700, top=16)),
        ("graphs_relational", lambda: builders.build(centers, voxels, MIDDLE, config).packed()),
    ):
        timed(name, make)
        rates[f"{name}_per_sec"] = round(n / times[name], 1)
    # the published neighbourhood, 6 grown by up to 20 with 32 neighbours, around every gap that such cubes fit
    shape, wide = (64, 72, 72), GraphConfig(edge_time=26, edge_height=26, edge_width=26)
    big = clean(synthetic.cube(spark, shape)).persist()
    gaps = builders.numbered(positions.missing(big, shape, (26, 26, 26)), shape).persist()
    big.count(), gaps.count()
    for name, make in (
        ("graphs_6_20_tiled", lambda: tiled.build(gaps, big, shape, wide, most=100, top=32)),
        ("graphs_6_20_relational", lambda: builders.build(gaps, big, shape, wide).packed()),
    ):
        timed(name, make)
        rates[f"{name}_per_sec"] = round(gaps.count() / times[name], 1)
    for name in ("missing_by_day", "stratified_sample", "quality_map", "heterogeneity_index", "candidate_pool", "prediction_graphs_by_day", "idw_fill", "gap_neighbours_by_day"):
        timed(name, lambda: catalog.QUERIES[name](spark, SF))
    try:
        from rasterloom.llm import queries as corpus
    except ImportError:
        corpus = None
    if corpus is not None:
        for name in sorted(corpus.QUERIES):
            timed(name, lambda: corpus.QUERIES[name](spark, SF))
    print(json.dumps({"metric": "total wall-clock of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates": rates, "graphs": n, "sf": SF.rsplit("sf", 1)[-1], "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
