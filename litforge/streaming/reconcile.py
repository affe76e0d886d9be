"""SET4 on a stream: records move between the main and the partial corpus when their key or their year comes late.

Two queries, each with a checkpoint of its own. The first keeps the latest version of every record and logs what changes; the second keeps, by key, who may stand for it, and writes +1 and -1
for each record that enters or leaves a corpus. Summed up (``standing``), these are the corpora that ``linkage.reconcile`` gives for the last versions, however the input was cut into batches.
State is in RocksDB, by pages: records are dealt to ``pages`` parts by a hash, a part is one Arrow table, read and written whole when a batch touches it and worked on column by column; rows come
to it in packs as well. So a batch costs a few calls for each page it touches instead of some for each record. More pages suit larger corpora that get small batches; their number holds for a checkpoint.
A key with many records is kept in SHARES parts, in pages of their own: each tells the next step no more than its first candidates, so no task holds a key's records. Rows without a key need no
state beyond the first query's.

Cases: null moved is false; a null id is one record like any other; of two versions with one number the greater (corpus, key, place, moved) stays, nulls first; an empty stream writes nothing; a row
repeated changes nothing; columns beyond those named are not read. Candidates without a place or an id are last. A record untouched for ``ttl`` milliseconds (0: never) is forgotten: what comes later for it counts as new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAGES = 512
SHARES = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = "id string, corpus string, key string, place long, moved boolean, change int"
CHANGE = "corpus string, id string, change int"
#: The first candidates of a share; stays has neither place nor id.
FIRST = "key string, share int, kind string, id string, place long, change int"
RECORDS = pa.schema({"id": pa.string(), "corpus": pa.string(), "key": pa.string(), "place": pa.int64(), "moved": pa.bool_(), "version": pa.int64(), "touched": pa.int64()})
CANDIDATES = pa.schema({"key": pa.string(), "share": pa.int32(), "kind": pa.string(), "id": pa.string(), "place": pa.int64(), "change": pa.int64()})


def paged(rows: DataFrame, pages: int, *by: str) -> GroupedData:
    """(page, rows), by page: the rows of a page in packs, so that they reach its state without a Python object for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = table.take(pc.sort_indices(table["page"]))
                page, at, n = np.unique(table["page"].to_numpy(), return_index=True, return_counts=True)
                packs = [packed(table.slice(i, k).drop_columns("page"))[0] for i, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch([pa.array(page, pa.int32()), pa.array(packs, pa.binary())], names=["page", "rows"])

    page = F.pmod(F.xxhash64(*by), F.lit(pages)).cast("int")
    return rows.select(page.alias("page"), "*").repartition("page").mapInArrow(run, "page int, rows binary").groupBy("page")


def unpacked(state: tuple | None, schema: pa.Schema) -> pa.Table:
    return schema.empty_table() if state is None else pa.ipc.open_stream(state[0]).read_all()


def packed(table: pa.Table) -> tuple[bytes]:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table.combine_chunks())
    return (out.getvalue().to_pybytes(),)


def read(packs: Iterator[pd.DataFrame]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for p in packs for x in p["rows"]])


def firsts(table: pa.Table, by: list[str], order: list[tuple[str, str]]) -> np.ndarray:
    """Where the first row of each group is. Nulls are last; of equal rows the earlier is first."""
    at = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in by] + order, null_placement="at_end").to_numpy()
    new = np.zeros(len(at), bool)
    new[:1] = True
    for c in by:
        code = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()[at]
        new[1:] |= code[1:] != code[:-1]
    return at[new]


def summed(tables: list[pa.Table], names: list[str]) -> pa.Table:
    """Changes of equal rows as one; those that cancel out go."""
    total = pa.concat_tables(tables).group_by(names, use_threads=False).aggregate([("change", "sum")]).rename_columns({"change_sum": "change"})
    return total.filter(pc.not_equal(total["change"], 0)).select([*names, "change"])


def signed(table: pa.Table, change: int) -> pa.Table:
    return table.append_column("change", pa.array(np.full(len(table), change, np.int64)))


def frame(table: pa.Table) -> pd.DataFrame:
    """For Spark; whole numbers stay whole beside nulls."""
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


class Latest(StatefulProcessor):
    """The latest versions of a page's records; a version that replaces another takes it back."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "records binary", self.ttl or None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old, now = unpacked(self.page.get(), RECORDS), timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        if self.ttl:
            old = old.filter(pc.greater(old["touched"], now - self.ttl))
        new = read(rows)
        new = new.append_column("touched", pa.array(np.full(len(new), now, np.int64))).select(RECORDS.names).cast(RECORDS)
        versions = pa.concat_tables([old, new])
        best = firsts(versions, ["id"], [(c, "descending") for c in ("version", "corpus", "key", "place", "moved")])
        gained, lost = best[best >= len(old)], np.setdiff1d(np.arange(len(old)), best)
        if len(gained):
            self.page.update(packed(versions.take(best)))
            names = ["id", "corpus", "key", "place", "moved"]
            out = summed([signed(versions.take(lost).select(names), -1), signed(versions.take(gained).select(names), 1)], names)
            yield frame(out)

    def close(self) -> None:
        pass


class Candidates(StatefulProcessor):
    """Sums of changes by page; what a view of them gives more or less than before the batch goes on as changes."""

    def __init__(self, view: Callable[[pa.Table], pa.Table]):
        self.view = view

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "candidates binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old, changes = unpacked(self.page.get(), CANDIDATES), read(rows).select(CANDIDATES.names).cast(CANDIDATES)
        # changes are sums, so their order does not matter: one taken back before it came is held at -1
        new = summed([old, changes], CANDIDATES.names[:-1])
        self.page.update(packed(new))
        keys = changes["key"].unique()
        before, after = (self.view(x.filter(pc.is_in(x["key"], keys)).filter(pc.field("change") > 0)) for x in (old, new))
        out = summed([signed(before, -1), signed(after, 1)], before.column_names)
        if len(out):
            yield frame(out)

    def close(self) -> None:
        pass


FIRST_PLACE = [("place", "ascending"), ("id", "ascending")]


def share_firsts(candidates: pa.Table) -> pa.Table:
    """Of each share whether records of the key stay in main, and its first candidate of either kind."""
    return candidates.take(firsts(candidates, ["key", "share", "kind"], FIRST_PLACE)).select(CANDIDATES.names[:-1])


def stands(candidates: pa.Table) -> pa.Table:
    """Who stands for a key in the partial corpus: none while main has the key, else the first of the partial corpus, else the first that leaves main."""
    found = candidates.take(firsts(candidates, ["key"], [("kind", "descending"), *FIRST_PLACE]))
    found = found.filter(pc.not_equal(found["kind"], "stays"))
    return pa.table({"corpus": pa.array(["partial"] * len(found), pa.string()), "id": found["id"]})


def record_log(stream: DataFrame, id: str, version: str, corpus: Column, key: Column, place: Column, moved: Column, ttl: int = 0, pages: int = PAGES) -> DataFrame:
    """Changes of records (id, corpus, key, place, moved, change); corpus is main or partial. A later version may bring a key or a year that was missing, or another corpus."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    moved = F.coalesce(moved, F.lit(False))
    picked = stream.select(F.col(id).cast("string").alias("id"), F.col(version).cast("long").alias("version"), corpus.alias("corpus"), key.cast("string").alias("key"), place.cast("long").alias("place"), moved.alias("moved"))
    return paged(picked, pages, "id").transformWithStateInPandas(Latest(ttl), LOG, "Append", "ProcessingTime" if ttl else "None")


def corpus_changes(log: DataFrame, pages: int = PAGES) -> DataFrame:
    """Changes of the corpora (corpus, id, change) from a stream over the log."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stays = (F.col("corpus") == "main") & ~F.col("moved")
    direct = log.filter(stays | F.col("key").isNull()).select(F.when(stays, "main").otherwise("partial").alias("corpus"), "id", "change")
    kind = F.when(stays, "stays").when(F.col("corpus") == "main", "leaving").otherwise("partial")
    share = F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")
    candidate = [F.when(~stays, F.col(c)).alias(c) for c in ("id", "place")]
    keyed = log.filter("key is not null").select("key", share.alias("share"), kind.alias("kind"), *candidate, "change")
    told = paged(keyed, pages, "key", "share").transformWithStateInPandas(Candidates(share_firsts), FIRST, "Append", "None")
    return direct.unionAll(paged(told, pages, "key").transformWithStateInPandas(Candidates(stands), CHANGE, "Append", "None"))


def standing(changes: DataFrame) -> DataFrame:
    """(corpus, id) of the records that are in a corpus after all changes."""
    return changes.groupBy("corpus", "id").agg(F.sum("change").alias("n")).filter("n > 0").select("corpus", "id")
