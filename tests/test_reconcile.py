"""The streamed corpora against the batch ones, however records and their corrections are cut into batches."""

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from litforge.operators import linkage
from litforge.scratch import folder
from litforge.streaming import incremental, reconcile

SCHEMA = "id string, version int, corpus string, key string, place long, moved boolean"


def streamed(spark, batches):
    src, log, out = (folder(spark, x) for x in ("records", "log", "changes"))
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).repartition(2).write.mode("append").parquet(src)
        s = incremental.file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
        s = reconcile.record_log(s, "id", "version", F.col("corpus"), F.col("key"), F.col("place"), F.col("moved"))
        incremental.run_available(s, log, f"{log}-done")
        s = incremental.file_stream(spark, log, s.schema, files_a_batch=4)
        incremental.run_available(reconcile.corpus_changes(s), out, f"{out}-done")
    return {tuple(r) for r in reconcile.standing(spark.read.schema(reconcile.CHANGE).parquet(out)).collect()}


def batch(spark, rows):
    last = {}
    for row in sorted(rows, key=lambda r: r[1]):
        last[row[0]] = row
    x = spark.createDataFrame(list(last.values()), SCHEMA)
    m, p = linkage.reconcile(x.filter("corpus = 'main'"), x.filter("corpus = 'partial'"), "key", F.struct("place", "id"), F.col("moved"))
    return {tuple(r) for r in m.select("corpus", "id").unionAll(p.select(F.lit("partial"), "id")).collect()}


def test_any_split_gives_the_batch_result(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        for version in range(1, rng.choice((2, 2, 3, 4))):
            key = rng.choice((None, "hot", "hot", *"abcdefgh"))
            rows.append((f"r{i}", version, rng.choice(("main", "partial", "partial")), key, rng.randrange(9), rng.choice((None, True, True, False))))
    rows = [(*r[:2], "partial" if r[3] == "hot" else r[2], *r[3:]) for r in rows]
    want = batch(spark, rows)
    assert {c for c, _ in want} == {"main", "partial"}
    for k in (1, 3):
        shuffled = rows + rng.sample(rows, 20)
        rng.shuffle(shuffled)
        assert streamed(spark, [shuffled[j::k] for j in range(k)]) == want


def test_late_keys_and_years(spark):
    first = [("a", 1, "main", "k", 1, None), ("b", 1, "partial", "k", 2, None), ("c", 1, "partial", None, 3, None), ("d", 1, "partial", "n", None, None), ("e", 1, "partial", "n", 5, None), (None, 1, "main", None, 1, False)]
    assert streamed(spark, [first]) == {("main", "a"), ("partial", "c"), ("partial", "e"), ("main", None)}
    # the year of a comes: it leaves main, and b, of the partial corpus before, stands; the key of c comes and is before b; d goes to main and takes its key along
    late = [("a", 2, "main", "k", 1, True), ("c", 2, "partial", "k", 1, None), ("d", 2, "main", "n", None, False)]
    assert streamed(spark, [first, late, late]) == {("partial", "c"), ("main", "d"), ("main", None)}
    assert streamed(spark, [late, first]) == {("partial", "c"), ("main", "d"), ("main", None)}


def test_null_ids_and_places_beyond_doubles(spark):
    rows = [(None, 1, "partial", "k", 1, None), ("x", 1, "partial", "k", 2, None), ("z", 1, "partial", "m", 2**53, None), ("y", 1, "partial", "m", 2**53 + 1, None), ("w", 1, "partial", "m", None, None)]
    assert streamed(spark, [rows]) == {("partial", None), ("partial", "z")}


def test_state_is_touched_by_page_not_by_record():
    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, new):
            self.calls += 1
            self.held = new

    class Now:
        def __init__(self, now):
            self.getCurrentProcessingTimeInMs = lambda: now

    def run(processor, value, rows, now=0):
        processor.init(type("Handle", (), {"getValueState": lambda *_: value}))
        table = pa.Table.from_pylist(rows, pa.schema({"id": pa.string(), "version": pa.int64(), "corpus": pa.string(), "key": pa.string(), "place": pa.int64(), "moved": pa.bool_()}))
        packs = [reconcile.packed(table.slice(i, 100))[0] for i in range(0, len(rows), 100)]
        return [r for out in processor.handleInputRows((0,), iter([pd.DataFrame({"rows": packs})]), Now(now)) for r in out.to_dict("records")]

    value, rows = Value(), [{"id": f"r{i}", "version": 2, "corpus": "main", "key": "k", "place": i, "moved": False} for i in range(1000)]
    assert len(run(reconcile.Latest(0), value, rows)) == 1000 and value.calls == 2
    assert run(reconcile.Latest(0), value, rows) == [] and value.calls == 3
    assert sorted((r["id"], r["key"], r["change"]) for r in run(reconcile.Latest(0), value, [rows[7] | {"version": 3, "key": "n"}])) == [("r7", "k", -1), ("r7", "n", 1)]
    # forgotten after ten milliseconds: an older version then counts as new
    value = Value()
    assert [[r["change"] for r in run(reconcile.Latest(10), value, [rows[0] | {"version": v}], now)] for v, now in ((2, 0), (1, 9), (1, 10))] == [[1], [], [1]]
