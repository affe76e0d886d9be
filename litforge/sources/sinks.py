"""Writers: tables, maps and networks for viewers, graphs, summaries, reports. Small results are joined into one file; large ones keep their parts."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.operators.running import placed
from litforge.sources.one_file import write_lines


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    """SNK1, SNK7: always a new path; a table is never written over while it is read."""
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """SNK2"""
    (df.coalesce(1) if single else df).write.mode("errorifexists").csv(path, header=True)


def summary_json(df: DataFrame) -> DataFrame:
    """SNK3: a table of one row as a JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def append_jsonl(df: DataFrame, path: str, done_key: str | None = None) -> None:
    """SNK8: new records as JSON lines; those whose key is there already are skipped. Spark's commit takes the place of a lock."""
    if done_key:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(p):
            df = df.join(df.sparkSession.read.schema(df.schema).json(path).select(done_key).distinct(), done_key, "left_anti")
    df.write.mode("append").json(path)


def vos_tables(nodes: DataFrame, edges: DataFrame, node_least: int, edge_least: int) -> tuple[DataFrame, DataFrame]:
    """SNK4: the map (id, label, weight) with ids from 1 by weight, and the network (id_a, id_b, strength) among kept nodes. nodes: (node, n); edges: (a, b, n)."""
    ids = placed(nodes.filter(F.col("n") >= node_least), [F.desc("n"), "node"], "id").select("id", F.col("node").alias("label"), F.col("n").alias("weight"))
    net = edges.filter(F.col("n") >= edge_least)
    for end in "ab":
        net = net.join(ids.select(F.col("label").alias(end), F.col("id").alias(f"id_{end}")), end)
    return ids, net.select("id_a", "id_b", F.col("n").alias("strength"))


def write_vos(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK4: map.txt with a head, network.txt without."""
    nodes.orderBy("id").coalesce(1).write.csv(f"{path}/map", sep="\t", header=True)
    edges.orderBy("id_a", "id_b").coalesce(1).write.csv(f"{path}/network", sep="\t")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK5: lines of a GraphML document in order. nodes: node_id and attributes; edges: src, dst and attributes. Made by column expressions, so that it needs no driver memory."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda cols, p: F.concat_ws("", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{p}_{c}">'), esc(F.col(c)), F.lit("</data>"))) for c in cols])
    spark = nodes.sparkSession
    na, ea = [c for c in nodes.columns if c != "node_id"], [c for c in edges.columns if c not in ("src", "dst")]
    keys = [f'<key id="{p}_{c}" for="{kind}" attr.name={quoteattr(c)} attr.type="string"/>' for p, kind, cols in (("n", "node", na), ("e", "edge", ea)) for c in cols]
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="undirected">']
    frame = lambda rows, part: spark.createDataFrame([(part, f"{i:06d}", r) for i, r in enumerate(rows)], "part int, at string, value string")
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").cast("string").alias("at"), F.concat(F.lit('<node id="'), esc(F.col("node_id")), F.lit('">'), data(na, "n"), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2), F.concat_ws(" ", "src", "dst"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('">'), data(ea, "e"), F.lit("</edge>")))
    return frame(head, 0).unionAll(n).unionAll(e).unionAll(frame(["</graph>", "</graphml>"], 3))


def write_vos_files(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK4: path/map.txt and path/network.txt, each one file that many tasks write."""
    tabs = lambda df: df.select(F.concat_ws("\t", *[F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\n\r", "   ") for c in df.columns]).alias("value"), *df.columns)
    spark = nodes.sparkSession
    head = spark.createDataFrame([("id\tlabel\tweight",)], "value string").select("value", F.lit(None).cast("long").alias("id"))
    write_lines(head.unionAll(tabs(nodes.select("id", "label", "weight")).select("value", "id")), f"{path}/map.txt", F.asc_nulls_first("id"))
    write_lines(tabs(edges.select("id_a", "id_b", "strength")), f"{path}/network.txt", "id_a", "id_b", "value")


def write_graphml_file(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK5: one file that many tasks write, on a file system that driver and executors share."""
    write_lines(graphml(nodes, edges), path, "part", "at", "value")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK5: a folder with one part, which one task writes."""
    graphml(nodes, edges).repartitionByRange(1, "part").sortWithinPartitions("part", "at").select("value").write.text(path)


def markdown_table(df: DataFrame, title: str, limit: int = 200) -> str:
    """SNK6: a report of an aggregate's first rows; a last line tells if there are more."""
    rows = df.limit(limit + 1).collect()
    more = ["", f"First {limit} rows only."] if len(rows) > limit else []
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows[:limit]], *more, ""])
