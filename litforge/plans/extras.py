"""Queries for the operators that share another's code: each inventory row has one of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.functions import text as X
from litforge.operators import association as A
from litforge.operators import extraction, graph, laws, linkage, ranking, topics
from litforge.plans.connectors import TITLE, tagged_export
from litforge.plans.descriptive import LOTKA, counts
from litforge.plans.registry import Tables, query, rounded
from litforge.plans.statistics import CT, FISHER, cells, triples
from litforge.scratch import folder
from litforge.sources import records as R
from litforge.sources import sinks


@query("flt6_year_range", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def flt6(t: Tables) -> DataFrame:
    return t.orders.filter(F.year("o_orderdate").between(1996, 1998)).select("o_orderkey")


@query("flt13_source_policy", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'O') GROUP BY 1")
def flt13(t: Tables) -> DataFrame:
    return t.lineitem.filter(~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"))).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("jon3_keyword_year", "SELECT year(o_orderdate)::BIGINT AS year, l_returnflag AS keyword, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def jon3(t: Tables) -> DataFrame:
    y = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("long").alias("year"))
    return t.lineitem.select("l_orderkey", "l_returnflag").join(y, "l_orderkey").groupBy("year", F.col("l_returnflag").alias("keyword")).agg(F.count(F.lit(1)).alias("n"))


@query("jon12_keyword_cluster", "SELECT n_regionkey::BIGINT AS cluster, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def jon12(t: Tables) -> DataFrame:
    j = t.customer.select("c_nationkey").join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.col("n_regionkey").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("mth1_cagr", "WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT round((pow(arg_max(n, y)::DOUBLE / arg_min(n, y), 1.0 / (max(y) - min(y))) - 1) * 100, 4) AS cagr_pct FROM c")
def mth1(t: Tables) -> DataFrame:
    from litforge.operators.trend import period_statistics

    return rounded(period_statistics(counts(t), [("all", 1900, 2100)]).select("cagr_pct"))


@query("mth3_lotka_regime", f"WITH {LOTKA} SELECT CASE WHEN alpha < 1.8 THEN 'sub' WHEN alpha > 2.5 THEN 'super' ELSE 'classic' END AS regime FROM f")
def mth3(t: Tables) -> DataFrame:
    return laws.lotka(laws.productivity(t.orders, "o_custkey")).select("regime")


@query("mth5_expected_log_or", f"WITH {CT} SELECT row, col, round(row_total * col_total / total::DOUBLE, 6) AS expected, round(log2((n + 0.5) * (total - row_total - col_total + n + 0.5) / ((row_total - n + 0.5) * (col_total - n + 0.5))), 6) AS log2_or FROM m")
def mth5(t: Tables) -> DataFrame:
    return rounded(A.fisher_cells(cells(t)).select("row", "col", "expected", "log2_or"), 6)


@query("mth9_upper_median", "SELECT event_type, round(list_sort(list(value))[(count(*) // 2 + 1)::BIGINT], 6) AS upper_median FROM events GROUP BY 1")
def mth9(t: Tables) -> DataFrame:
    """The element at the middle of the sorted values, the upper one of two: a discrete quantile just above one half, by counts of values."""
    from pyspark.sql.window import Window

    n = t.events.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("event_type")
    n = n.withColumns({"upto": F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("c").over(w)})
    return n.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("event_type").agg(F.round(F.min("value"), 6).alias("upper_median"))


@query("arr4_null_to_list", "SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id)")
def arr4(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNotNull(), F.array("quality")).alias("l"))
    return x.select("doc_id", F.size(F.coalesce("l", F.array().cast("array<int>"))).cast("long").alias("n"))


@query("agg17_keyword_lookup", "WITH k AS (SELECT DISTINCT o_custkey AS record, o_orderstatus AS source, o_orderpriority AS keyword FROM orders), g AS (SELECT keyword, count(*) FILTER (WHERE source = 'F') AS n_F, count(*) FILTER (WHERE source = 'O') AS n_O, count(*) AS total, count(DISTINCT record) AS n_records FROM k GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n_records DESC, keyword) AS rank FROM g")
def agg17(t: Tables) -> DataFrame:
    x = t.orders.select(F.col("o_custkey").alias("record"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("keyword"))
    return ranking.keyword_inventory(x, "record", "source", "keyword", ["F", "O"])


EDGE = """WITH x AS (SELECT r_name, n_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), t AS (SELECT {a} AS src, {b} AS dst, {c} AS v, row_number() OVER (PARTITION BY {a}, {b} ORDER BY count(*) DESC, {c}) AS k FROM x GROUP BY {a}, {b}, {c})
    SELECT {a} AS src, {b} AS dst, count(*) AS n_records, count(DISTINCT {c}) AS n_distinct, (SELECT v FROM t WHERE t.src = x.{a} AND t.dst = x.{b} AND k = 1) AS top FROM x GROUP BY {a}, {b}"""


def edge(t: Tables, a: str, b: str, c: str) -> DataFrame:
    x = triples(t).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(c).alias("v"))
    top = graph.top_value(x, ["src", "dst"], "v", "top")
    return x.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("v").alias("n_distinct")).join(top, ["src", "dst"], "left")


@query("agg21_edge_aggregate_top_partner", EDGE.format(a="n_name", b="o_orderpriority", c="c_mktsegment"))
def agg21(t: Tables) -> DataFrame:
    return edge(t, "n_name", "o_orderpriority", "c_mktsegment")


@query("agg22_edge_aggregate_third_side", EDGE.format(a="c_mktsegment", b="o_orderpriority", c="n_name"))
def agg22(t: Tables) -> DataFrame:
    return edge(t, "c_mktsegment", "o_orderpriority", "n_name")


@query("fuz5_thesaurus_build")
def fuz5(t: Tables) -> DataFrame:
    k = t.part.groupBy(F.col("p_name").alias("keyword")).agg(F.count(F.lit(1)).alias("n"))
    return linkage.build_thesaurus(k, t.spark.createDataFrame([("a", "b")], "alias string, canonical string"), 60.0)


@query("src6_src12_multi_file_glob", f"SELECT 'WoS:' || doc_id AS record_id, 'WoS' AS source_db, {TITLE} AS title, doc_id::VARCHAR AS source_id FROM documents WHERE trim(text) <> ''")
def src6(t: Tables) -> DataFrame:
    """All files of a pattern as one table of unified records."""
    return R.from_tagged(R.read_tagged(t.spark, f"{tagged_export(t)}/part-*.txt")).select("record_id", "source_db", "title", "source_id")


@query("snk8_append_resume", "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM documents")
def snk8(t: Tables) -> DataFrame:
    path = folder(t.spark, "append")
    x = t.documents.select("doc_id", "lang")
    sinks.append_jsonl(x.filter("doc_id % 3 = 0"), path, "doc_id")
    sinks.append_jsonl(x, path, "doc_id")
    return t.spark.read.schema(x.schema).json(path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_ids"))


@query("jsn2_schema_keywords", """SELECT p_partkey, '{"type": "object", "properties": {"title": {"type": "string"}, "' || p_brand || '": {"anyOf": [{"type": "integer"}, {"enum": [' || p_size || ', "format"]}]}}}' AS schema FROM part""")
def jsn2(t: Tables) -> DataFrame:
    """A schema for each part: keywords go at any depth, a property of a keyword's name and values stay."""
    schema = F.format_string(
        '{"title": "%s", "type": "object", "properties": {"title": {"type": "string", "minLength": %d}, "%s": {"default": null, "anyOf": [{"type": "integer", "minimum": 0}, {"format": "x", "enum": [%d, "format"]}]}}}',
        "p_name", "p_size", "p_brand", "p_size",
    )
    return t.part.select("p_partkey", extraction.strip_schema_text(schema).alias("schema"))


@query("dq9_pilot_fisher", f"WITH {FISHER}, a AS (SELECT row FROM m GROUP BY 1 ORDER BY max(row_total) DESC, row LIMIT 1) SELECT row, col, n, row_total, round(p, 6) AS p FROM e WHERE row IN (SELECT row FROM a)")
def dq9(t: Tables) -> DataFrame:
    """The tests of the entity with the largest margin."""
    x = A.fisher_cells(cells(t))
    top = x.select("row", "row_total").distinct().orderBy(F.desc("row_total"), "row").limit(1).select("row")
    return rounded(x.join(F.broadcast(top), "row", "left_semi").select("row", "col", "n", "row_total", "p"), 6)


@query("vec1_pluggable_encoder", "SELECT doc_id, lang, length(lang)::DOUBLE AS x FROM documents")
def vec1(t: Tables) -> DataFrame:
    """A stand-in encoder: no model is at hand offline."""
    out = topics.embed(t.documents.select("doc_id", "lang"), "lang", lambda xs: [[float(len(x))] for x in xs])
    return out.select("doc_id", "lang", F.get("embedding", 0).cast("double").alias("x"))


@query("str6_split_by_source", """WITH x AS (SELECT s_suppkey, s_suppkey % 4 AS k, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT DISTINCT s_suppkey, ['WoS', 'Scopus', 'OpenAlex', 'PubMed'][k + 1] AS source_db, affiliation FROM (SELECT s_suppkey, k, n_name AS affiliation FROM x UNION ALL SELECT s_suppkey, k, r_name FROM x) WHERE k < 3""")
def str6(t: Tables) -> DataFrame:
    """Two affiliations of each supplier in four sources' forms, the last of which has none."""
    x = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    k, lines = F.col("s_suppkey") % 4, F.concat(F.lit("[Doe, J] "), "n_name", F.lit(".\n"), "r_name", F.lit("\n"), "n_name")
    x = x.withColumn("source_db", F.when(k == 0, "WoS").when(k == 1, "Scopus").when(k == 2, "OpenAlex").otherwise("PubMed"))
    raw = F.when(k == 1, F.concat("n_name", F.lit("; "), "r_name", F.lit("."))).otherwise(lines)
    return x.select("s_suppkey", "source_db", F.explode(X.split_affiliations(F.col("source_db"), raw, F.array("n_name", "r_name"))).alias("affiliation"))
