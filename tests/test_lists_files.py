"""Chunked lists, exact order statistics, stratified samples and files that many tasks write, against plain versions."""

import math
import os
import random
import xml.etree.ElementTree as ET
from hashlib import md5

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litforge.operators import graph, linkage, lists, quantile, topics
from litforge.sources import one_file, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def many_ranges(spark):
    """Several ranges, however small the tables are."""
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_chunks_of_hot_keys(spark, many_ranges):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(400)) for _ in range(1500)] + [(f"k{rng.randrange(30)}", rng.randrange(50)) for _ in range(300)] + [(None, i) for i in range(40)] + [("gone", None)] * 3
    got = lists.chunked(frame(spark, rows, "k string, i long"), ["k"], "i", 7).collect()
    want = {}
    for k, i in rows:
        if i is not None:
            want.setdefault(k, []).append(i)
    found = {k: [] for k in want}
    for r in sorted(got, key=lambda r: r["chunk"]):
        assert r["n"] == len(r["items"]) <= 7 and r["chunk"] * 7 == len(found[r["k"]])
        found[r["k"]] += r["items"]
    assert found == {k: sorted(v) for k, v in want.items()}
    sizes = {r["k"]: (r["n"], r["n_chunks"]) for r in lists.list_sizes(frame(spark, got, "k string, chunk long, items array<long>, n long"), ["k"]).collect()}
    assert sizes == {k: (len(v), math.ceil(len(v) / 7)) for k, v in want.items()}
    assert lists.chunked(frame(spark, [], "k string, i long"), ["k"], "i").count() == 0


def test_places_within_hot_keys_span_ranges(spark, many_ranges):
    df = spark.range(0, 5000, 1, 4).select((F.col("id") % 3 == 0).alias("k"), F.lit("x").alias("l"), (F.col("id") * 7919 % 5003).alias("v"))
    got = lists.place_within(df, ["k", "l"], ["v"]).collect()
    for k in (True, False):
        mine = sorted((r["v"], r["place"]) for r in got if r["k"] == k)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_survivors_without_lists(spark):
    df = frame(spark, [("a", 1, "s"), ("a", 2, "t"), ("b", 3, "s")], "k string, id long, src string")
    plain = linkage.survivorship(df, "k", [F.col("id")], "src", "id")
    bare = linkage.survivorship(df, "k", [F.col("id")], "src", "id", id_list=False)
    assert "id_list" not in bare.columns
    assert sorted(map(str, bare.collect())) == sorted(map(str, plain.drop("id_list").collect()))
    ids = {r["k"]: r["items"] for r in lists.chunked(df, ["k"], "id").collect()}
    assert ids == {r["k"]: r["id_list"] for r in plain.collect()}


def test_edges_without_lists(spark):
    df = frame(spark, [("a", "b", "1", 0.5, 2000, "x"), ("a", "b", "2", 0.7, 2001, "y")], "s string, d string, r string, c double, y int, o string")
    out = graph.edge_aggregate(df, "s", "d", None, {}, [], "c", "y", ("o", {"x": 1, "y": 2})).collect()[0]
    assert out["n_records"] == 2 and "record_ids" not in out.asDict()


def test_resolve_in_chunks_equals_lists(spark):
    df = frame(spark, [(i, i % 4) for i in range(60)], "id long, p int")
    comp = frame(spark, [(i, 0) for i in range(40)] + [(50, 50), (51, 50)], "id long, component long")
    want = {r["component"]: (r["id"], r["absorbed"]) for r in linkage.resolve_components(df, comp, "id", F.desc("p"), F.asc("id")).collect()}
    stay, absorbed = linkage.resolve_in_chunks(df, comp, "id", [-F.col("p"), F.col("id")], 6)
    got = {r["component"]: (r["id"], []) for r in stay.collect()}
    for r in sorted(absorbed.collect(), key=lambda r: r["chunk"]):
        assert r["n"] <= 6
        got[r["component"]][1].extend(r["items"])
    assert got == want


def test_order_statistic(spark):
    rng = random.Random(3)
    groups = {
        "ties": [1.0] * 200 + [2.0] * 30, "heavy": [10.0 ** rng.uniform(-300, 300) for _ in range(60)], "one": [5.0], "few": [3.0, -1.0],
        None: [float(rng.randrange(40)) for _ in range(100)], "odd": [math.inf, -math.inf, 0.0, 1.0, 2.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("ties", None), ("empty", None)]
    df = frame(spark, rows, "g string, v double")
    for bins, expr, place in ((4, "(2 * (n - 1) + 4) div 5", lambda n: (2 * (n - 1) + 4) // 5), (64, "n - 1", lambda n: n - 1)):
        got = {r["g"]: r["cut"] for r in quantile.order_statistic(df, "g", "v", F.expr(expr), bins=bins).collect()}
        assert got == {g: sorted(v)[place(len(v))] for g, v in groups.items()}
    assert {r["g"] for r in quantile.order_statistic(df, "g", "v", F.lit(3)).collect()} == {g for g, v in groups.items() if len(v) > 3}


def test_order_statistic_of_large_longs(spark):
    values = [2**62 + i for i in range(300)]
    df = frame(spark, [("a", v) for v in values], "g string, v long")
    assert quantile.order_statistic(df, "g", "v", F.lit(123)).collect()[0]["cut"] == values[123]


def plain_sample(rows, takes, seed=42):
    out = set()
    for s, take in takes.items():
        mine = [r for r in rows if r[1] == s]
        scores = sorted(r[2] for r in mine if r[2] is not None)
        high = [r for r in mine if r[2] is not None and r[2] >= scores[(2 * (len(scores) - 1) + 4) // 5]] if scores else []
        pool = high if len(high) >= take else mine
        out |= {r[0] for r in sorted(pool, key=lambda r: (md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0]))[:take]}
    return out


def test_stratified_sample_equals_plain(spark, many_ranges):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), None if i % 11 == 0 else float(rng.randrange(20))) for i in range(2000)] + [(9000 + i, "blank", None) for i in range(5)]
    df = frame(spark, rows, "id long, s string, p double")
    for n in (3, 300, 2005):
        takes = {r["s"]: r["take"] for r in topics.allocation(df.groupBy("s").agg(F.count(F.lit(1)).alias("size")), "s", n).collect()}
        got = [r["id"] for r in topics.stratified_sample(df, "s", "id", "p", n).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_sample(rows, takes)
    assert topics.stratified_sample(df.limit(0), "s", "id", "p", 10).count() == 0


def test_graphml_by_many_tasks_equals_one_task(spark, tmp_path, many_ranges):
    nodes = frame(spark, [(f"n{i:03d}", "a<b & \"c\"" if i % 2 else None, "é" * (i % 5)) for i in range(200)], "node_id string, label string, note string").repartition(4)
    edges = frame(spark, [(f"n{i:03d}", f"n{(i * 7) % 200:03d}", i) for i in range(200)] * 2, "src string, dst string, w long").repartition(4)
    sinks.write_graphml(nodes, edges, f"file://{tmp_path}/folder")
    sinks.write_graphml_file(nodes, edges, f"file://{tmp_path}/one/graph.graphml")
    part = next(p for p in (tmp_path / "folder").iterdir() if p.name.startswith("part-"))
    one = (tmp_path / "one" / "graph.graphml").read_bytes()
    assert one == part.read_bytes() and os.listdir(tmp_path / "one") == ["graph.graphml"]
    assert len(ET.fromstring(one)[-1]) == 600
    with pytest.raises(FileExistsError):
        sinks.write_graphml_file(nodes, edges, f"file://{tmp_path}/one/graph.graphml")


def test_vos_files(spark, tmp_path):
    nodes, edges = frame(spark, [(2, "b\tx", 3), (1, "a", 5)], "id long, label string, weight long"), frame(spark, [(1, 2, 4)], "id_a long, id_b long, strength long")
    sinks.write_vos_files(nodes, edges, str(tmp_path / "v"))
    assert (tmp_path / "v" / "map.txt").read_text() == "id\tlabel\tweight\n1\ta\t5\n2\tb x\t3\n" and (tmp_path / "v" / "network.txt").read_text() == "1\t2\t4\n"


def batch(rows):
    return pa.RecordBatch.from_pydict({"at": [r[0] for r in rows], "value": [r[1] for r in rows]})


def test_tasks_of_one_file(tmp_path):
    w = one_file.PlacedLines(str(tmp_path / "f"), 12)
    late, early = [(6, "two"), (10, "z")], [(0, "onee"), (5, "")]
    done = [w.write(iter([batch(late)])), w.write(iter([batch(early)]))]
    again = w.write(iter([batch(late)]))  # a second attempt writes the same
    assert again == done[0] and not (tmp_path / "f").exists()
    w.commit(done)
    assert (tmp_path / "f").read_bytes() == b"onee\n\ntwo\nz\n" and os.listdir(tmp_path) == ["f"]
    w = one_file.PlacedLines(str(tmp_path / "g"), 12)
    with pytest.raises(ValueError):
        w.commit([w.write(iter([batch(early)]))])  # bytes are missing
    assert os.listdir(tmp_path) == ["f"]


def test_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(one_file.OneFile)
    rows = frame(spark, [(0, "fine"), (5, None)], "at long, value string").repartition(2)
    with pytest.raises(Exception):
        rows.write.format("one_file").mode("append").option("file", str(tmp_path / "f")).option("bytes", "10").save()
    assert os.listdir(tmp_path) == []


def test_one_file_of_nothing_and_other_systems(spark, tmp_path):
    one_file.write_lines(frame(spark, [], "value string"), str(tmp_path / "empty"), "value")
    assert (tmp_path / "empty").read_bytes() == b""
    with pytest.raises(ValueError):
        one_file.local_path("s3a://bucket/x")
