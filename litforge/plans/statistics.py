"""Queries on association statistics, graphs, topics and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.functions.text import assign_period
from litforge.operators import association as A, lists
from litforge.operators import density, extraction, graph, linkage, manifold, ranking, topics, trend
from litforge.plans.descriptive import CASE, PERIODS, supplied
from litforge.plans.registry import Tables, query, r, rounded

LINES = "l AS (SELECT p_type AS row, l_returnflag || l_linestatus AS col, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)"


def lines(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.col("p_type").alias("type"), "p_brand")
    return t.lineitem.select("l_orderkey", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("flag"), "l_shipdate").join(p, F.col("l_partkey") == F.col("p_partkey"))


@query("agg18_contingency_matrix", f"WITH {LINES} SELECT row, col, count(*) AS n FROM l GROUP BY 1, 2")
def agg18(t: Tables) -> DataFrame:
    return A.contingency(lines(t), "type", "flag")


@query("agg19_distinct_record_matrix", f"WITH {LINES} SELECT row, col, count(DISTINCT l_orderkey) AS n FROM l GROUP BY 1, 2")
def agg19(t: Tables) -> DataFrame:
    return A.contingency(lines(t), "type", "flag", "l_orderkey")


@query("agg23_crosstab", "SELECT p_type AS row, p_brand AS col, count(*) AS n FROM part GROUP BY 1, 2")
def agg23(t: Tables) -> DataFrame:
    return A.contingency(t.part, "p_type", "p_brand")


@query("agg24_crosstab_margins", f"WITH {LINES} SELECT CASE WHEN grouping(row) = 1 THEN 'All' ELSE row END AS row, CASE WHEN grouping(col) = 1 THEN 'All' ELSE col END AS col, count(*) AS n FROM l GROUP BY CUBE (row, col)")
def agg24(t: Tables) -> DataFrame:
    return A.with_margins(lines(t), "type", "flag")


@query("flt8_flt9_flt10_filters", "SELECT count(*) AS n FROM events WHERE (event_type NOT IN ('view', 'other') OR event_type IS NULL) AND value >= 0.7 AND user_id >= 0")
def flt9(t: Tables) -> DataFrame:
    """FLT8 noise cluster, FLT9 noise category with nulls kept, FLT10 confidence floor."""
    e = t.events.filter(A.not_noise(F.col("event_type"), ("view", "other"))).filter("value >= 0.7").filter("user_id >= 0")
    return e.agg(F.count(F.lit(1)).alias("n"))


@query("flt11_entity_min_support", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 12")
def flt11(t: Tables) -> DataFrame:
    return A.entity_min_support(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 12).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


#: Small margins, so that the sums are short: nations of customers against priorities, by distinct customers of one segment.
CT = """ct AS (SELECT n_name AS row, o_orderpriority AS col, count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
    g AS (SELECT a.row, b.col, coalesce(ct.n, 0)::BIGINT AS n FROM (SELECT DISTINCT row FROM ct) a CROSS JOIN (SELECT DISTINCT col FROM ct) b LEFT JOIN ct ON ct.row = a.row AND ct.col = b.col),
    m AS (SELECT *, sum(n) OVER (PARTITION BY row)::BIGINT AS row_total, sum(n) OVER (PARTITION BY col)::BIGINT AS col_total, sum(n) OVER ()::BIGINT AS total FROM g)"""
FISHER = CT + """, s AS (SELECT DISTINCT row_total, col_total, total FROM m),
    x AS (SELECT *, unnest(range(greatest(0, row_total + col_total - total), least(row_total, col_total) + 1)) AS x FROM s),
    lp AS (SELECT *, exp(lgamma(row_total + 1) - lgamma(x + 1) - lgamma(row_total - x + 1) + lgamma(total - row_total + 1) - lgamma(col_total - x + 1) - lgamma(total - row_total - col_total + x + 1) - lgamma(total + 1) + lgamma(col_total + 1) + lgamma(total - col_total + 1)) AS pr FROM x),
    f AS (SELECT m.row, m.col, m.n, m.row_total, m.col_total, m.total, least(1.0, sum(CASE WHEN q.pr <= o.pr * (1 + 1e-7) THEN q.pr ELSE 0 END)) AS p FROM m JOIN lp o ON o.row_total = m.row_total AND o.col_total = m.col_total AND o.total = m.total AND o.x = m.n
          JOIN lp q ON q.row_total = m.row_total AND q.col_total = m.col_total AND q.total = m.total GROUP BY 1, 2, 3, 4, 5, 6),
    e AS (SELECT *, row_total * col_total / total::DOUBLE AS expected, (n + 0.5) * (total - row_total - col_total + n + 0.5) / ((row_total - n + 0.5) * (col_total - n + 0.5)) AS o,
          CASE WHEN (row_total - n) * (col_total - n) > 0 THEN n * (total - row_total - col_total + n) / ((row_total - n) * (col_total - n))::DOUBLE END AS odds FROM f),
    q0 AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q0 FROM e),
    q AS (SELECT *, least(1.0, min(q0) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM q0)"""


def cells(t: Tables) -> DataFrame:
    c = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    o = t.orders.join(c, F.col("c_custkey") == F.col("o_custkey"))
    return A.completed(A.contingency(o, "n_name", "o_orderpriority", "o_custkey"))


@query("sta1_fisher_exact", f"WITH {FISHER} SELECT row, col, n, row_total, col_total, total, round(expected, 6) AS expected, round(odds, 6) AS odds_ratio, round(log2(o), 6) AS log2_or, round(p, 6) AS p, CASE WHEN n > expected THEN 'enriched' WHEN n < expected THEN 'depleted' ELSE 'neutral' END AS direction FROM e")
def sta1(t: Tables) -> DataFrame:
    """STA1, MTH5, DQ9"""
    return rounded(A.fisher_cells(cells(t)), 6)


@query("win11_sta2_bh_fdr", f"WITH {FISHER} SELECT row, col, round(q, 5) AS q FROM q")
def win11(t: Tables) -> DataFrame:
    return rounded(A.bh_fdr(A.fisher_cells(cells(t))).select("row", "col", "q"), 5)


@query("sta3_strength_classes", f"WITH {FISHER} SELECT row, col, CASE WHEN q < 0.9 THEN CASE WHEN coalesce(odds > 1.2, true) AND n >= 2 THEN 'strong_enrichment' WHEN odds < 0.8 AND expected >= 2 THEN 'strong_depletion' ELSE 'weak_sig' END ELSE 'ns' END AS classification FROM q")
def sta3(t: Tables) -> DataFrame:
    return A.strength_class(A.bh_fdr(A.fisher_cells(cells(t))), 0.9, 1.2, 0.8, 2).select("row", "col", "classification")


ERA = "CASE WHEN year(l_shipdate) <= 1996 THEN 'a' WHEN year(l_shipdate) <= 1998 THEN 'b' ELSE 'c' END"


@query("sta4_era_trajectory", f"""WITH l AS (SELECT {ERA} AS era, p_brand AS row, l_linestatus AS col, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
    g AS (SELECT e.era, a.row, b.col, coalesce(l.n, 0)::BIGINT AS n FROM (SELECT DISTINCT era FROM l) e CROSS JOIN (SELECT DISTINCT row FROM l) a CROSS JOIN (SELECT DISTINCT col FROM l) b LEFT JOIN l ON l.era = e.era AND l.row = a.row AND l.col = b.col),
    m AS (SELECT *, sum(n) OVER (PARTITION BY era, row)::BIGINT AS row_total, sum(n) OVER (PARTITION BY era, col)::BIGINT AS col_total, sum(n) OVER (PARTITION BY era)::BIGINT AS total FROM g),
    s AS (SELECT DISTINCT row_total, col_total, total FROM m), x AS (SELECT *, unnest(range(greatest(0, row_total + col_total - total), least(row_total, col_total) + 1)) AS x FROM s),
    lp AS (SELECT *, exp(lgamma(row_total + 1) - lgamma(x + 1) - lgamma(row_total - x + 1) + lgamma(total - row_total + 1) - lgamma(col_total - x + 1) - lgamma(total - row_total - col_total + x + 1) - lgamma(total + 1) + lgamma(col_total + 1) + lgamma(total - col_total + 1)) AS pr FROM x),
    f AS (SELECT m.era, m.row, m.col, m.n, m.row_total * m.col_total / m.total::DOUBLE AS expected, least(1.0, sum(CASE WHEN q.pr <= o.pr * (1 + 1e-7) THEN q.pr ELSE 0 END)) AS p FROM m JOIN lp o ON o.row_total = m.row_total AND o.col_total = m.col_total AND o.total = m.total AND o.x = m.n
          JOIN lp q ON q.row_total = m.row_total AND q.col_total = m.col_total AND q.total = m.total GROUP BY 1, 2, 3, 4, 5),
    q0 AS (SELECT *, p * count(*) OVER (PARTITION BY era) / count(*) OVER (PARTITION BY era ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q0 FROM f),
    q AS (SELECT *, least(1.0, min(q0) OVER (PARTITION BY era ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM q0),
    b AS (SELECT row, col, max(CASE WHEN era = 'a' AND q < 0.8 AND n > expected THEN 1 ELSE 0 END)::VARCHAR || max(CASE WHEN era = 'b' AND q < 0.8 AND n > expected THEN 1 ELSE 0 END)::VARCHAR || max(CASE WHEN era = 'c' AND q < 0.8 AND n > expected THEN 1 ELSE 0 END)::VARCHAR AS pattern FROM q GROUP BY 1, 2)
    SELECT row, col, pattern, CASE pattern WHEN '111' THEN 'STABLE' WHEN '001' THEN 'EMERGING' WHEN '100' THEN 'DECLINING' WHEN '011' THEN 'RISING' WHEN '110' THEN 'FADING' WHEN '010' THEN 'TRANSIENT_MIDDLE' WHEN '101' THEN 'BIMODAL' ELSE 'WEAK_NONE' END AS trajectory FROM b""")
def sta4(t: Tables) -> DataFrame:
    era = F.when(F.year("l_shipdate") <= 1996, "a").when(F.year("l_shipdate") <= 1998, "b").otherwise("c")
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(era.alias("era"), F.col("p_brand").alias("row"), F.col("l_linestatus").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    grid = x.select("era").distinct().crossJoin(x.select("row").distinct()).crossJoin(x.select("col").distinct())
    full = grid.join(x, ["era", "row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = lambda *k: F.sum("n").over(Window.partitionBy("era", *k))
    full = full.select("*", total("row").alias("row_total"), total("col").alias("col_total"), total().alias("total"))
    tested = A.bh_fdr(A.fisher_cells(full, keys=("era", "row", "col")), "p", "era")
    return A.era_trajectory(tested, ["a", "b", "c"], alpha=0.8)


SIG = "count(*) % 2 = 0"


@query("sta5_jon13_chain_classes", f"""WITH t AS (SELECT DISTINCT r_name AS family, n_name AS species, CASE WHEN n_nationkey % 3 > 0 THEN c_mktsegment END AS compound FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    b AS (SELECT r_name, n_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    f AS (SELECT r_name AS e, o_orderpriority AS c, {SIG} AS sig FROM b GROUP BY 1, 2), s AS (SELECT n_name AS e, o_orderpriority AS c, {SIG} AS sig FROM b GROUP BY 1, 2), m AS (SELECT c_mktsegment AS e, o_orderpriority AS c, {SIG} AS sig FROM b GROUP BY 1, 2),
    g AS (SELECT family, species, compound, category, coalesce(f.sig, false) AS fs, coalesce(s.sig, false) AS ss, coalesce(m.sig, false) AS cs FROM t CROSS JOIN (SELECT DISTINCT o_orderpriority AS category FROM orders)
          LEFT JOIN f ON f.e = family AND f.c = category LEFT JOIN s ON s.e = species AND s.c = category LEFT JOIN m ON m.e = compound AND m.c = category)
    SELECT category, CASE WHEN fs AND ss AND compound IS NOT NULL AND cs THEN 'FULL_CHAIN' WHEN fs AND ss AND compound IS NULL THEN 'FAMILY_SPECIES_NO_COMPOUND_DATA' WHEN fs AND ss THEN 'F_S_COMPOUND_NOT_SIG' WHEN fs THEN 'FAMILY_PERVASIVE'
    WHEN ss AND cs THEN 'SPECIES_COMPOUND_NO_FAMILY' WHEN ss THEN 'SPECIES_SPECIFIC' WHEN cs THEN 'COMPOUND_ORPHAN' ELSE 'ALL_NS' END AS chain_class, count(*) AS n FROM g GROUP BY 1, 2""")
def sta5(t: Tables) -> DataFrame:
    c = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    triples = c.select(F.col("r_name").alias("family"), F.col("n_name").alias("species"), F.when(F.col("n_nationkey") % 3 > 0, F.col("c_mktsegment")).alias("compound")).distinct()
    b = t.orders.join(c, F.col("c_custkey") == F.col("o_custkey"))
    sig = lambda e: b.groupBy(F.col(e).alias("entity"), F.col("o_orderpriority").alias("category")).agg((F.count(F.lit(1)) % 2 == 0).alias("sig"))
    cats = t.orders.select(F.col("o_orderpriority").alias("category")).distinct()
    out = A.hierarchy_chains(triples, cats, {"family": sig("r_name"), "species": sig("n_name"), "compound": sig("c_mktsegment")})
    return out.groupBy("category", "chain_class").agg(F.count(F.lit(1)).alias("n"))


@query("sta6_agreement", """WITH c AS (SELECT lang AS a, source AS b, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2), r AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
    x AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS ij, sum(n * ln(n)) AS h FROM c), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n * ln(n)) AS hi FROM r), j AS (SELECT sum(n * (n - 1) / 2) AS j, sum(n * ln(n)) AS hj FROM k)
    SELECT t::BIGINT AS n, round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS ari, round(2 * (ln(t) + (h - hi - hj) / t) / (2 * ln(t) - (hi + hj) / t), 6) AS nmi FROM x, i, j""")
def sta6(t: Tables) -> DataFrame:
    return rounded(A.agreement(t.documents, "lang", "source"), 6)


@query("agg36_jaccard_groups", """WITH s AS (SELECT DISTINCT event_type AS g, user_id AS i FROM events), n AS (SELECT g, count(*) AS n FROM s GROUP BY 1), b AS (SELECT x.g AS a, y.g AS b, count(*) AS k FROM s x JOIN s y ON x.i = y.i AND x.g < y.g GROUP BY 1, 2)
    SELECT p.g AS a, q.g AS b, coalesce(k, 0) AS n_both, round(coalesce(k, 0) / (p.n + q.n - coalesce(k, 0))::DOUBLE, 6) AS jaccard FROM n p JOIN n q ON p.g < q.g LEFT JOIN b ON b.a = p.g AND b.b = q.g""")
def agg36(t: Tables) -> DataFrame:
    return rounded(A.jaccard_groups(t.events, "event_type", "user_id"), 6)


@query("agg27_majority_vote", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def agg27(t: Tables) -> DataFrame:
    return A.majority_vote(t.events, "user_id", "event_type")


@query("agg20_edge_aggregate", """WITH x AS (SELECT c.n_name AS src, s.n_name AS dst, o_orderkey, o_orderpriority AS mech, o_orderstatus AS st, year(o_orderdate) AS y, l_discount FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey), t AS (SELECT src, dst, mech, row_number() OVER (PARTITION BY src, dst ORDER BY (mech = '5-LOW')::INT, count(*) DESC, mech) AS k FROM x GROUP BY 1, 2, 3)
    SELECT src, dst, count(*) AS n_records, round(avg(l_discount), 12) AS mean_l_discount, min(y)::BIGINT AS year_min, max(y)::BIGINT AS year_max, (max(y) - min(y) + 1)::BIGINT AS year_span, string_agg(DISTINCT mech, '|' ORDER BY mech) AS mech_set, count(DISTINCT mech) AS n_mech,
    CASE max(CASE st WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) WHEN 2 THEN 'P' WHEN 1 THEN 'O' ELSE 'F' END AS max_st, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS record_ids, (SELECT mech FROM t WHERE t.src = x.src AND t.dst = x.dst AND k = 1) AS top_mech FROM x GROUP BY src, dst""")
def agg20(t: Tables) -> DataFrame:
    """AGG20, AGG21, AGG22: the same operator over other pairs of ends."""
    out = graph.edge_aggregate(trade(t), "src", "dst", "o_orderkey", {"top_mech": "mech"}, ["mech"], "l_discount", "y", ("st", {"P": 2, "O": 1}), {"mech": F.col("mech") != "5-LOW"})
    return rounded(out, 12)  # means of cents over so many rows have no more places, so there are no ties to round


def trade(t: Tables) -> DataFrame:
    """Line items with the nations of customer and supplier."""
    s = supplied(t).select("o_orderkey", F.col("n_name").alias("dst"), "l_discount")
    n = t.nation.select("n_nationkey", F.col("n_name").alias("src"))
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    o = o.select("o_orderkey", "src", F.col("o_orderpriority").alias("mech"), F.col("o_orderstatus").alias("st"), F.year("o_orderdate").alias("y"))
    return o.join(s, "o_orderkey")  # order and line number together are no key in these tables


@query("agg20_record_chunks", """WITH x AS (SELECT c.n_name AS src, s.n_name AS dst, o_orderkey AS i FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation s ON s.n_nationkey = s_nationkey),
    w AS (SELECT *, (row_number() OVER (PARTITION BY src, dst ORDER BY i) - 1) // 1000 AS chunk FROM x) SELECT src, dst, chunk, md5(string_agg(i::VARCHAR, ',' ORDER BY i)) AS items_md5, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def agg20_chunks(t: Tables) -> DataFrame:
    """AGG20: the records behind each edge, 1000 a row."""
    chunks = lists.chunked(trade(t), ["src", "dst"], "o_orderkey", 1000)
    return chunks.select("src", "dst", "chunk", F.md5(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").cast("binary")).alias("items_md5"), "n")


TRIPLES = "x AS (SELECT r_name, n_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def triples(t: Tables) -> DataFrame:
    c = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    return t.orders.join(c, F.col("c_custkey") == F.col("o_custkey")).select("r_name", "n_name", "c_mktsegment", "o_orderpriority")


@query("grf6_triples_to_edges", f"""WITH {TRIPLES}, e AS (SELECT 'r_name::' || r_name AS src, 'n_name::' || n_name AS dst, 'r_name_n_name' AS edge_type, o_orderpriority AS label FROM x UNION ALL SELECT 'n_name::' || n_name, 'c_mktsegment::' || c_mktsegment, 'n_name_c_mktsegment', o_orderpriority FROM x
    UNION ALL SELECT 'r_name::' || r_name, 'c_mktsegment::' || c_mktsegment, 'r_name_c_mktsegment', o_orderpriority FROM x) SELECT src, dst, edge_type, label, count(*) AS weight FROM e GROUP BY 1, 2, 3, 4""")
def grf6(t: Tables) -> DataFrame:
    return graph.triples_to_edges(triples(t), "r_name", "n_name", "c_mktsegment", "o_orderpriority")


@query("grf7_agg25_sankey_flows", f"""WITH {TRIPLES}, c AS (SELECT r_name, c_mktsegment, o_orderpriority, count(*) AS n FROM x GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 50)
    SELECT 'r_name:' || r_name AS source, 'c_mktsegment:' || c_mktsegment AS target, sum(n)::BIGINT AS value FROM c GROUP BY 1, 2 UNION ALL SELECT 'c_mktsegment:' || c_mktsegment, 'o_orderpriority:' || o_orderpriority, sum(n)::BIGINT FROM c GROUP BY 1, 2""")
def grf7(t: Tables) -> DataFrame:
    return graph.flows(triples(t), "r_name", "c_mktsegment", "o_orderpriority")


@query("grf8_three_fields", f"""WITH {TRIPLES}, n AS (SELECT n_name FROM x GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10), y AS (SELECT * FROM x WHERE n_name IN (SELECT n_name FROM n)), s AS (SELECT c_mktsegment FROM y GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4), z AS (SELECT * FROM y WHERE c_mktsegment IN (SELECT c_mktsegment FROM s)),
    p AS (SELECT o_orderpriority FROM z GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), w AS (SELECT * FROM z WHERE o_orderpriority IN (SELECT o_orderpriority FROM p))
    SELECT n_name AS source, c_mktsegment AS target, count(*) AS value, 'left' AS side FROM w GROUP BY 1, 2 UNION ALL SELECT c_mktsegment, o_orderpriority, count(*), 'right' FROM w GROUP BY 1, 2""")
def grf8(t: Tables) -> DataFrame:
    return graph.three_fields(triples(t), "n_name", "c_mktsegment", "o_orderpriority", (10, 4, 3))


@query("grf5_node_table", f"WITH {TRIPLES} SELECT r_name AS node_id, 'src' AS node_type, NULL AS n_regionkey FROM x GROUP BY 1 UNION ALL SELECT n_name, 'dst', (SELECT min(n_regionkey)::BIGINT FROM nation WHERE nation.n_name = x.n_name) FROM x GROUP BY 1")
def grf5(t: Tables) -> DataFrame:
    e = triples(t).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return rounded(graph.node_table(e, t.nation.select(F.col("n_name").alias("node_id"), "n_regionkey")))


@query("mth8_grf4_density", f"WITH {TRIPLES}, e AS (SELECT DISTINCT n_name AS s, o_orderpriority AS d FROM x) SELECT count(DISTINCT s) AS n_src, count(DISTINCT d) AS n_dst, count(*) AS n_edges, round(count(*)::DOUBLE / (count(DISTINCT s) * count(DISTINCT d)), 6) AS bipartite_density, round(2.0 * count(*) / ((count(DISTINCT s) + count(DISTINCT d)) * (count(DISTINCT s) + count(DISTINCT d) - 1)), 6)::DOUBLE AS density FROM e")
def mth8(t: Tables) -> DataFrame:
    return rounded(graph.density(triples(t).select(F.col("n_name").alias("src"), F.col("o_orderpriority").alias("dst"))), 6)


NET = """rec AS (SELECT DISTINCT l_orderkey AS k, n_name AS e FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey), net AS (SELECT x.e AS a, y.e AS b, count(*) AS n FROM rec x JOIN rec y ON x.k = y.k AND x.e < y.e GROUP BY 1, 2),
    mem AS (SELECT n_name AS node, n_regionkey::BIGINT AS community FROM nation), e AS (SELECT a, b, n, p.community AS ca, q.community AS cb FROM net JOIN mem p ON p.node = a JOIN mem q ON q.node = b)"""


def network(t: Tables) -> tuple[DataFrame, DataFrame]:
    return ranking.pair_counts(supplied(t), "l_orderkey", "n_name"), t.nation.select(F.col("n_name").alias("node"), F.col("n_regionkey").cast("long").alias("community"))


@query("grf1_cooccurrence_graph", f"WITH {NET}, top AS (SELECT e FROM rec GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15) SELECT a, b, n FROM net WHERE n >= 5 AND a IN (SELECT e FROM top) AND b IN (SELECT e FROM top)")
def grf1(t: Tables) -> DataFrame:
    x = supplied(t).select("l_orderkey", "n_name").distinct()
    top = x.groupBy("n_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "n_name").limit(15)
    return ranking.pair_counts(x.join(F.broadcast(top.select("n_name")), "n_name", "left_semi"), "l_orderkey", "n_name", 5)


@query("flt15_snk4_vos_network", f"""WITH {NET}, m AS (SELECT row_number() OVER (ORDER BY count(*) DESC, e) AS id, e, count(*) AS n FROM rec GROUP BY e HAVING count(*) >= 10) SELECT p.id AS id_a, q.id AS id_b, net.n AS strength FROM net JOIN m p ON p.e = a JOIN m q ON q.e = b WHERE net.n >= 3""")
def snk4(t: Tables) -> DataFrame:
    from litforge.sources.sinks import vos_tables

    nodes = supplied(t).select("l_orderkey", "n_name").distinct().groupBy(F.col("n_name").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return vos_tables(nodes, network(t)[0], 10, 3)[1]


@query("grf2_modularity", f"""WITH {NET}, k AS (SELECT ca AS c, n FROM e UNION ALL SELECT cb, n FROM e), g AS (SELECT c, sum(n)::DOUBLE AS k FROM k GROUP BY 1), i AS (SELECT ca AS c, sum(n)::DOUBLE AS i FROM e WHERE ca = cb GROUP BY 1), m AS (SELECT sum(n)::DOUBLE AS m FROM e)
    SELECT round(sum(coalesce(i, 0) / m - pow(k / (2 * m), 2)), 6) AS modularity, count(*) AS n_communities FROM g LEFT JOIN i USING (c), m""")
def grf2(t: Tables) -> DataFrame:
    return rounded(graph.modularity(*network(t)), 6)


@query("grf3_within_strength", f"""WITH {NET}, s AS (SELECT ca AS community, a AS node, n FROM e WHERE ca = cb UNION ALL SELECT ca, b, n FROM e WHERE ca = cb), g AS (SELECT community, node, sum(n)::BIGINT AS strength FROM s GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY strength DESC, node) AS rank FROM g) WHERE rank <= 15""")
def grf3(t: Tables) -> DataFrame:
    return graph.within_strength(*network(t))


@query("grf2_louvain")
def louvain(t: Tables) -> DataFrame:
    """Iterative; tests hold its score against all partitions of small graphs."""
    return graph.louvain(network(t)[0])


@query("grf2_label_propagation", f"""WITH {NET}, sym AS (SELECT a, b, n FROM net UNION ALL SELECT b, a, n FROM net), l0 AS (SELECT DISTINCT a AS v, a AS c FROM sym),
    {", ".join(f"w{k} AS (SELECT sym.a AS v, l{k - 1}.c, sum(sym.n) AS w FROM sym JOIN l{k - 1} ON l{k - 1}.v = sym.b GROUP BY 1, 2), l{k} AS (SELECT v, c FROM w{k} QUALIFY row_number() OVER (PARTITION BY v ORDER BY w DESC, c) = 1)" for k in (1, 2, 3))}
    SELECT v AS node, c AS community FROM l3""")
def propagation(t: Tables) -> DataFrame:
    return graph.label_propagation(network(t)[0], 3)


@query("grf9_thematic_map", f"""WITH {NET}, f AS (SELECT e, count(*)::DOUBLE AS n FROM rec GROUP BY 1), q AS (SELECT ca, cb, e.n * e.n / (x.n * y.n) AS v FROM e JOIN f x ON x.e = a JOIN f y ON y.e = b), o AS (SELECT ca AS c, v FROM q WHERE ca <> cb UNION ALL SELECT cb, v FROM q WHERE ca <> cb),
    s AS (SELECT community, count(*) AS size FROM mem GROUP BY 1) SELECT community, size, round(10 * coalesce((SELECT sum(v) FROM o WHERE c = community), 0), 6) AS centrality, round(100 * coalesce((SELECT sum(v) FROM q WHERE ca = cb AND ca = community), 0) / size, 6) AS density FROM s""")
def grf9(t: Tables) -> DataFrame:
    counts = supplied(t).select("l_orderkey", "n_name").distinct().groupBy(F.col("n_name").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    net, mem = network(t)
    return rounded(graph.thematic_map(net, counts, mem), 6)


@query("grf10_bursts", """WITH RECURSIVE ev AS (SELECT event_type::VARCHAR AS item, dayofyear(ts)::BIGINT AS t FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL), n AS (SELECT item, t, count(*) AS r FROM ev GROUP BY 1, 2),
    d AS (SELECT t, count(*)::DOUBLE AS d, row_number() OVER (ORDER BY t) AS i FROM ev GROUP BY 1), p AS (SELECT item, count(*)::DOUBLE / (SELECT count(*) FROM ev) AS p0 FROM ev GROUP BY 1),
    g AS (SELECT p.item, d.i, d.t, coalesce(n.r, 0)::DOUBLE AS r, d.d, p0, least(0.9999, 1.2 * p0) AS p1, 0.2 * ln((SELECT count(*) FROM d) + 1.0) AS up FROM p CROSS JOIN d LEFT JOIN n ON n.item = p.item AND n.t = d.t WHERE p0 > 0 AND p0 < 1),
    k AS (SELECT *, -(r * ln(p0) + (d - r) * ln(1 - p0)) AS c0, -(r * ln(p1) + (d - r) * ln(1 - p1)) AS c1 FROM g),
    f AS (SELECT item, 0::BIGINT AS i, 0.0::DOUBLE AS b0, max(up)::DOUBLE AS b1, 0 AS f0, 1 AS f1 FROM k GROUP BY 1
        UNION ALL SELECT k.item, k.i, least(b0, b1) + c0, CASE WHEN b0 + up < b1 THEN b0 + up ELSE b1 END + c1, CASE WHEN b0 <= b1 THEN 0 ELSE 1 END, CASE WHEN b0 + up < b1 THEN 0 ELSE 1 END FROM f JOIN k ON k.item = f.item AND k.i = f.i + 1),
    s AS (SELECT item, i, CASE WHEN b1 < b0 THEN 1 ELSE 0 END AS state, f0, f1 FROM f WHERE i = (SELECT max(i) FROM d) UNION ALL SELECT f.item, f.i, CASE s.state WHEN 0 THEN s.f0 ELSE s.f1 END, f.f0, f.f1 FROM s JOIN f ON f.item = s.item AND f.i = s.i - 1 WHERE s.i > 1),
    b AS (SELECT s.item, k.t, c0 - c1 AS w, s.i - row_number() OVER (PARTITION BY s.item ORDER BY s.i) AS run FROM s JOIN k ON k.item = s.item AND k.i = s.i WHERE state = 1)
    SELECT item, min(t) AS first, max(t) AS last, round(sum(w), 4) AS weight FROM b GROUP BY item, run""")
def grf10(t: Tables) -> DataFrame:
    """A two-state automaton over days."""
    x = t.events.select("event_type", F.dayofyear("ts").alias("day"))
    return rounded(graph.bursts(x, "event_type", "day", 1.2, 0.2), 4)


@query("grf10_g_index", """WITH c AS (SELECT year(o_orderdate)::BIGINT AS year, o_custkey AS item, count(*) AS n FROM orders GROUP BY 1, 2),
    w AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, item) AS rank, sum(n) OVER (PARTITION BY year ORDER BY n DESC, item ROWS UNBOUNDED PRECEDING) AS upto FROM c) SELECT year, item, n, rank FROM w WHERE rank * rank <= 25 * upto""")
def grf10_g_index(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.col("o_custkey").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return graph.g_index_nodes(n, "year", "item", "n")


@query("grf10_cosine_links", f"WITH {NET}, c AS (SELECT e, count(*) AS n FROM rec GROUP BY 1) SELECT a, b, net.n, round(net.n / sqrt(p.n::DOUBLE * q.n), 6) AS cosine FROM net JOIN c p ON p.e = a JOIN c q ON q.e = b")
def grf10_cosine(t: Tables) -> DataFrame:
    n = supplied(t).select("l_orderkey", "n_name").distinct().groupBy(F.col("n_name").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(graph.cosine_links(network(t)[0], n), 6)


@query("grf10_pathfinder")
def grf10_pathfinder(t: Tables) -> DataFrame:
    """Paths of any length are beyond plain SQL; tested by brute force."""
    return graph.pathfinder(network(t)[0])


@query("grf10_llr_labels", f"""WITH {TRIPLES}, c AS (SELECT n_name AS cluster, o_orderpriority AS term, count(*) AS n FROM x GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY cluster)::DOUBLE AS c, sum(n) OVER (PARTITION BY term)::DOUBLE AS w, sum(n) OVER ()::DOUBLE AS t FROM c),
    o AS (SELECT cluster, term, n, c, w, t, unnest([n::DOUBLE, c - n, w - n, t - c - w + n]) AS seen, unnest([c * w / t, c * (t - w) / t, (t - c) * w / t, (t - c) * (t - w) / t]) AS expected FROM m WHERE n * t > c * w),
    g AS (SELECT cluster, term, n, 2 * sum(CASE WHEN seen > 0 THEN seen * ln(seen / expected) ELSE 0 END) AS llr FROM o GROUP BY 1, 2, 3) SELECT cluster, term, n, round(llr, 6) AS llr, row_number() OVER (PARTITION BY cluster ORDER BY llr DESC, term) AS rank FROM g QUALIFY rank <= 2""")
def grf10_llr(t: Tables) -> DataFrame:
    return rounded(graph.llr_labels(triples(t), "n_name", "o_orderpriority", 2), 6)


@query("txt1_ctfidf_bigrams", """WITH t AS (SELECT lang AS class, regexp_extract_all(lower(text), '[a-z][a-z-]{2,}') AS t FROM documents), w AS (SELECT class, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t),
    c AS (SELECT class, term, count(*) AS n FROM w GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(DISTINCT lang) FROM documents)),
    k AS (SELECT c.*, df, sum(n) OVER (PARTITION BY class) AS total FROM c JOIN d USING (term)) SELECT class, term, n, round(n / total::DOUBLE * ln(1 + (SELECT count(DISTINCT lang) FROM documents) / df::DOUBLE), 8) AS score FROM k""")
def txt1_bigrams(t: Tables) -> DataFrame:
    return rounded(topics.ctfidf(t.documents, "lang", "text", up_to=2), 8)


@query("txt1_ctfidf", """WITH w AS (SELECT lang AS class, unnest(regexp_extract_all(lower(text), '[a-z][a-z-]{2,}')) AS term FROM documents), c AS (SELECT class, term, count(*) AS n FROM w GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(DISTINCT lang) FROM documents)), k AS (SELECT c.*, df, sum(n) OVER (PARTITION BY class) AS total FROM c JOIN d USING (term))
    SELECT class, term, n, round(n / total::DOUBLE * ln(1 + (SELECT count(DISTINCT lang) FROM documents) / df::DOUBLE), 8) AS score FROM k""")
def txt1(t: Tables) -> DataFrame:
    return rounded(topics.ctfidf(t.documents, "lang", "text", up_to=1), 8)


@query("txt2_txt3_centroid_cosine", """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY 1, 2), s AS (SELECT vec_id, v.label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cosine FROM v JOIN c ON c.label = v.label AND c.i = v.i GROUP BY 1, 2)
    SELECT vec_id, label::BIGINT AS label, round(cosine, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS k FROM s) WHERE k <= 15""")
def txt2(t: Tables) -> DataFrame:
    out = topics.cosine_to_centroid(t.embeddings, "label", "embedding", 15, "vec_id")
    return rounded(out.select("vec_id", F.col("label").cast("long").alias("label"), "cosine"), 5)


WEEK = "CASE WHEN day(ts) <= 10 THEN 'early' WHEN day(ts) >= 21 THEN 'late' ELSE 'mid' END"


@query("txt4_mth6_topic_evolution", f"""WITH n AS (SELECT event_type, count(*) FILTER (WHERE p = 'early') AS n_early, count(*) FILTER (WHERE p = 'late') AS n_late FROM (SELECT event_type, {WEEK} AS p FROM events) WHERE p IN ('early', 'late') GROUP BY 1),
    s AS (SELECT *, 100.0 * n_early / sum(n_early) OVER () AS pe, 100.0 * n_late / sum(n_late) OVER () AS pl FROM n) SELECT event_type, n_early, n_late, round(pe::DOUBLE, 4) AS pct_early, round(pl::DOUBLE, 4) AS pct_late, round(pl::DOUBLE - pe::DOUBLE, 4) AS delta, round((pl::DOUBLE + 0.01) / (pe::DOUBLE + 0.01), 4) AS fold FROM s""")
def txt4(t: Tables) -> DataFrame:
    p = F.when(F.day("ts") <= 10, "early").when(F.day("ts") >= 21, "late").otherwise("mid")
    return rounded(trend.evolution(t.events.withColumn("p", p), "event_type", "p", "early", "late"))


@query("txt5_keyword_evolution", f"""WITH x AS (SELECT o_orderpriority AS item, o_custkey AS rec, {CASE} AS period FROM (SELECT *, year(o_orderdate) AS year FROM orders)), d AS (SELECT period, count(DISTINCT rec) AS total FROM x GROUP BY 1)
    SELECT period, item, count(DISTINCT rec) AS n, total, round(100.0 * count(DISTINCT rec) / total, 4)::DOUBLE AS pct FROM x JOIN d USING (period) GROUP BY 1, 2, 4""")
def txt5(t: Tables) -> DataFrame:
    x = t.orders.select(F.col("o_orderpriority").alias("item"), F.col("o_custkey").alias("rec"), assign_period(F.year("o_orderdate"), PERIODS).alias("period"))
    return rounded(trend.share_by_period(x, "item", "rec", "period"))


@query("srt2_rising_declining", f"""WITH n AS (SELECT event_type, count(*) FILTER (WHERE p = 'early')::DOUBLE AS e, count(*) FILTER (WHERE p = 'late')::DOUBLE AS l FROM (SELECT event_type, {WEEK} AS p FROM events) WHERE p IN ('early', 'late') GROUP BY 1), s AS (SELECT event_type, 100 * l / sum(l) OVER () - 100 * e / sum(e) OVER () AS d FROM n)
    SELECT event_type, round(d, 4) AS delta, CASE WHEN d > 0 THEN 'rising' ELSE 'declining' END AS trend FROM s WHERE d <> 0""")
def srt2(t: Tables) -> DataFrame:
    p = F.when(F.day("ts") <= 10, "early").when(F.day("ts") >= 21, "late").otherwise("mid")
    out = trend.rising_declining(trend.evolution(t.events.withColumn("p", p), "event_type", "p", "early", "late"), "event_type")
    return rounded(out.select("event_type", "delta", "trend"))


ALLOCATION = """WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), a AS (SELECT *, CASE WHEN 50 >= count(*) OVER () THEN 1 ELSE 0 END AS base, 50 - count(*) OVER () AS rest FROM s), b AS (SELECT *, size / sum(size) OVER ()::DOUBLE * rest AS share FROM a),
    c AS (SELECT *, round_even(share, 0)::BIGINT AS extra FROM b), d AS (SELECT *, rest - sum(extra) OVER () AS gap, row_number() OVER (ORDER BY share - extra DESC, lang) AS up, row_number() OVER (ORDER BY extra DESC, lang) AS down FROM c)
    SELECT lang, size, (base + extra + CASE WHEN gap > 0 AND up <= gap THEN 1 WHEN gap < 0 AND down <= -gap THEN -1 ELSE 0 END)::BIGINT AS take FROM d"""


@query("smp1_allocation", ALLOCATION)
def smp1(t: Tables) -> DataFrame:
    return topics.allocation(t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "lang", 50)


@query("smp1_stratified_sample", f"""WITH t AS ({ALLOCATION}), p AS (SELECT doc_id, d.lang, n_chars, take, n_chars >= quantile_cont(n_chars, 0.4) OVER (PARTITION BY d.lang) AS high FROM documents d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang),
    h AS (SELECT *, count(*) FILTER (WHERE high) OVER (PARTITION BY lang) AS n_high FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM h WHERE high OR n_high < take)
    SELECT doc_id, lang, n_chars FROM r WHERE k <= take""")
def stratified(t: Tables) -> DataFrame:
    return topics.stratified_sample(t.documents.select("doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars", 50)


@query("smp2_uniform_sample", "SELECT doc_id, lang FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 20")
def smp2(t: Tables) -> DataFrame:
    return topics.uniform_sample(t.documents.select("doc_id", "lang"), "doc_id", 20)


@query("vec1_vec2_vec3_clusters")
def vec3(t: Tables) -> DataFrame:
    """Stand-ins for projection and density clustering; rows only."""
    return topics.cluster_vectors(t.embeddings, "embedding", 10).select("vec_id", "cluster_id", r("probability", 6).alias("probability"), r("outlier_score", 6).alias("outlier_score"))


@query("vec2_manifold_projection")
def vec2_manifold(t: Tables) -> DataFrame:
    """A layout by sampled edges is beyond SQL; tests measure the recall of its graph, its trustworthiness against principal components, and that it comes out the same again."""
    x = manifold.project(t.embeddings, "vec_id", "embedding")
    return x.select("vec_id", F.round(F.get("position", 0), 4).alias("x"), F.round(F.get("position", 1), 4).alias("y"))


@query("vec3_density_clusters")
def vec3_density(t: Tables) -> DataFrame:
    """Clusters by hierarchy are beyond SQL; tests hold the rows against a version that splits from the whole down."""
    flat = topics.principal(t.embeddings, "embedding", 3, "flat")
    x = density.density_clusters(flat, "vec_id", "flat", min_cluster=10, min_samples=5, epsilon=0.15)
    return x.select("vec_id", "cluster_id", r("probability", 6).alias("probability"), r("outlier_score", 6).alias("outlier_score"))


@query("agg31_cluster_stats", "SELECT label::BIGINT AS label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS mean_probability, round(avg(embedding[2]::DOUBLE), 6) AS mean_outlier, round(100.0 * count(*) / (SELECT count(*) FROM embeddings), 6)::DOUBLE AS pct FROM embeddings GROUP BY 1")
def agg31(t: Tables) -> DataFrame:
    x = t.embeddings.select(F.col("label").cast("long").alias("label"), F.get("embedding", 0).cast("double").alias("p"), F.get("embedding", 1).cast("double").alias("o"))
    return rounded(topics.cluster_stats(x, "label", "p", "o"), 6)


@query("cls1_flt14_interaction_class", "SELECT CASE WHEN a AND b THEN 'complete' WHEN a THEN 'herb_drug_no_target' WHEN b THEN 'herb_target_no_drug' ELSE 'fragmentary' END AS class, count(*) AS n, count(*) FILTER (WHERE a AND b AND o_orderstatus = 'F' AND o_orderpriority IS NOT NULL) AS n_gold FROM (SELECT *, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b FROM orders) GROUP BY 1")
def cls1(t: Tables) -> DataFrame:
    x = t.orders.withColumn("class", extraction.interaction_class(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0)).withColumn("specific", F.col("o_orderstatus") == "F")
    gold = extraction.gold_triples(x, "class", "specific", ["o_orderpriority"]).groupBy("class").agg(F.count(F.lit(1)).alias("g"))
    return x.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(gold, "class", "left").select("class", "n", F.coalesce("g", F.lit(0)).alias("n_gold"))


@query("cls2_mechanism_group", "SELECT CASE WHEN m IN ('CYP_inhibition', 'UGT_induction') THEN 'PK' WHEN m = 'additive_toxicity' THEN 'PD' ELSE 'other' END AS g, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'CYP_inhibition' WHEN 1 THEN 'UGT_induction' WHEN 2 THEN 'additive_toxicity' ELSE 'unspecified' END AS m FROM events) GROUP BY 1")
def cls2(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    m = F.when(k == 0, "CYP_inhibition").when(k == 1, "UGT_induction").when(k == 2, "additive_toxicity").otherwise("unspecified")
    return t.events.groupBy(extraction.mechanism_group(m).alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("agg34_confidence_buckets", "SELECT CASE WHEN v < 0.5 THEN '<0.5' WHEN v < 0.7 THEN '[0.5,0.7)' WHEN v < 0.9 THEN '[0.7,0.9)' ELSE '>=0.9' END AS bucket, count(*) AS n FROM (SELECT (event_id % 100) / 100.0::DOUBLE AS v FROM events) GROUP BY 1")
def agg34(t: Tables) -> DataFrame:
    return t.events.groupBy(extraction.confidence_bucket(F.col("event_id") % 100 / 100.0).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("agg35_benchmark_summary", """SELECT role AS model, count(*) AS n, round(100.0 * count(*) FILTER (WHERE turn % 5 > 0) / count(*), 4)::DOUBLE AS pct_valid, count(*) FILTER (WHERE turn % 2 = 0) AS n_positive, sum(turn)::BIGINT AS n_interactions, round(avg(length(text)), 4) AS mean_elapsed_s, round(sum(length(text) / 1e6 * 1.5 + turn / 1e6 * 2.5), 4) AS cost FROM conversations GROUP BY 1""")
def agg35(t: Tables) -> DataFrame:
    x = t.conversations.select(F.col("role").alias("model"), (F.col("turn") % 5 > 0).alias("ok"), (F.col("turn") % 2 == 0).alias("contains_hdi"), F.col("turn").alias("n_interactions"), F.length("text").alias("elapsed_s"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return rounded(extraction.model_summary(x, "model", 1.5, 2.5))


@query("agg37_flow1_prisma", "SELECT 1::BIGINT AS step, 'identified' AS box, count(*) AS n FROM documents UNION ALL SELECT 2, 'deduplicated', count(DISTINCT text) FROM documents UNION ALL SELECT 3, 'screened', count(DISTINCT text) FROM documents WHERE length(text) >= 100 UNION ALL SELECT 4, 'labelled', count(*) FROM documents JOIN labels USING (doc_id)")
def agg37(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text")
    one = d.agg(F.count(F.lit(1)).alias("identified"), F.countDistinct(F.xxhash64("text")).alias("deduplicated"), F.countDistinct(F.when(F.length("text") >= 100, F.xxhash64("text"))).alias("screened"))
    one = one.crossJoin(d.join(t.labels, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("labelled")))
    boxes = F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(b).alias("box"), F.col(b).alias("n")) for i, b in enumerate(("identified", "deduplicated", "screened", "labelled"), 1)])
    return one.select(F.explode(boxes).alias("b")).select("b.*")


@query("dq1_schema_profile", "SELECT 'o_orderkey' AS \"column\", 'bigint' AS dtype, 100.0::DOUBLE AS pct_filled, count(DISTINCT o_orderkey) AS n_unique FROM orders UNION ALL SELECT 'o_orderstatus', 'string', 100.0, count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', 'string', 100.0, count(DISTINCT o_orderpriority) FROM orders")
def dq1(t: Tables) -> DataFrame:
    return rounded(extraction.profile(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")))


@query("dq2_src13_field_detection", "SELECT (SELECT column_name FROM (DESCRIBE orders) WHERE lower(column_name) = 'o_orderpriority') AS found, (SELECT count(*) FROM (DESCRIBE orders) WHERE contains(lower(column_name), 'key')) AS n_dates_and_keys")
def dq2(t: Tables) -> DataFrame:
    """DQ2, SRC13: from the schema alone."""
    found, some = extraction.find_column(t.orders, ["priority", "O_ORDERPRIORITY"]), extraction.columns_like(t.orders, ["key"])
    return t.spark.createDataFrame([(found, len(some))], "found string, n_dates_and_keys long")


@query("dq3_purity_and_overlap", "SELECT count(*) FILTER (WHERE year(o_orderdate) NOT BETWEEN 1995 AND 2000) AS out_of_range, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) < 2001)) AS n_overlap FROM orders")
def dq3(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    o = extraction.id_overlap(t.orders.filter(y == 2001).select("o_custkey"), t.orders.filter(y < 2001).select("o_custkey"), "o_custkey")
    return t.orders.agg(F.count_if(~y.between(1995, 2000)).alias("out_of_range")).crossJoin(o.select(F.col("both").alias("n_overlap")))


@query("dq4_dq6_length_profile", """WITH x AS (SELECT length(text) AS c, len(regexp_extract_all(text, '\\S+')) AS w FROM documents) SELECT round(quantile_cont(c, 0.5), 4)::DOUBLE AS chars_median, round(quantile_cont(c, 0.95), 4)::DOUBLE AS chars_p95, round(quantile_cont(c, 0.99), 4)::DOUBLE AS chars_p99,
    round(quantile_cont(w, 0.5), 4)::DOUBLE AS words_median, round(quantile_cont(w, 0.95), 4)::DOUBLE AS words_p95, round(quantile_cont(w, 0.99), 4)::DOUBLE AS words_p99, max(c)::BIGINT AS chars_max, max(w)::BIGINT AS words_max FROM x""")
def dq4(t: Tables) -> DataFrame:
    return rounded(extraction.length_profile(t.documents, "text"))


@query("dq5_dq8_coverage_by_year", "SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS n_both FROM orders GROUP BY 1")
def dq5(t: Tables) -> DataFrame:
    f = F.col("o_orderstatus") == "F"
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(f).alias("n_f"), F.count_if(f & (F.col("o_totalprice") > 100000)).alias("n_both"))


@query("dq7_id_overlap", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS \"both\", (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_a, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_b")
def dq7(t: Tables) -> DataFrame:
    return extraction.id_overlap(t.documents, t.labels, "doc_id")


@query("dq10_profiling", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(text, ';')) AS n_semicolon, count(*) FILTER (WHERE contains(text, '|')) AS n_bar FROM documents GROUP BY 1")
def dq10(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").contains(";")).alias("n_semicolon"), F.count_if(F.col("text").contains("|")).alias("n_bar"))


@query("flow2_label_round_trip", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS labels, count(DISTINCT p_type) AS n FROM part GROUP BY 1")
def flow2(t: Tables) -> DataFrame:
    """Bar-delimited lists to JSON and back."""
    x = t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("s"))
    j = x.select("p_brand", F.to_json(F.struct(F.filter(F.split("s", r"\|"), lambda v: v != "").alias("l"))).alias("j"))
    back = j.select("p_brand", F.from_json("j", "l array<string>")["l"].alias("l"))
    return back.select("p_brand", F.array_join("l", "|").alias("labels"), F.size("l").cast("long").alias("n"))


@query("flow3_stable_pairs", f"WITH {FISHER} SELECT row, col, round(log2(o), 6) AS log2_or, sign FROM (SELECT *, CASE WHEN log2(o) > 0 THEN 1 ELSE -1 END::BIGINT AS sign, row_number() OVER (PARTITION BY log2(o) > 0 ORDER BY round(abs(log2(o)), 9) DESC, row, col) AS k FROM e) WHERE k <= 3")
def flow3(t: Tables) -> DataFrame:
    x = A.fisher_cells(cells(t)).withColumn("sign", F.when(F.col("log2_or") > 0, 1).otherwise(-1).cast("long"))
    return rounded(ranking.top_per_group(x, "sign", 3, F.desc(F.round(F.abs("log2_or"), 9)), F.asc("row"), F.asc("col")).select("row", "col", "log2_or", "sign"), 6)


@query("flow4_flow8_heatmap_matrix", f"""WITH {LINES}, c AS (SELECT row, count(*) FILTER (WHERE col = 'AF') AS af, count(*) FILTER (WHERE col = 'NO') AS no, count(*) FILTER (WHERE col = 'RF') AS rf, count(*) AS total FROM l GROUP BY 1)
    SELECT row, least(af, 800)::BIGINT AS af, least(no, 800)::BIGINT AS no, least(rf, 800)::BIGINT AS rf, total, row_number() OVER (ORDER BY total DESC, row) AS rank FROM c""")
def flow4(t: Tables) -> DataFrame:
    """Pivot at the sink with a fixed column order, rows by their totals, values capped for the picture."""
    ct = A.contingency(lines(t), "type", "flag")
    wide = ct.groupBy("row").pivot("col", ["AF", "NO", "RF"]).agg(F.sum("n")).na.fill(0)
    total = ct.groupBy("row").agg(F.sum("n").alias("total"))
    x = wide.join(total, "row").select("row", *[F.least(F.col(c), F.lit(800)).cast("long").alias(c.lower()) for c in ("AF", "NO", "RF")], "total")
    return ranking.with_rank(x, F.desc("total"), F.asc("row"))


@query("flow5_model_comparison", "WITH a AS (SELECT DISTINCT conv_id, 'user' AS m FROM conversations WHERE role = 'user'), b AS (SELECT DISTINCT conv_id FROM conversations WHERE role <> 'user') SELECT count(*) AS n_first, count(b.conv_id) AS n_both FROM a LEFT JOIN b USING (conv_id)")
def flow5(t: Tables) -> DataFrame:
    a = t.conversations.filter("role = 'user'").select("conv_id").distinct()
    b = t.conversations.filter("role <> 'user'").select("conv_id").distinct().withColumn("hit", F.lit(1))
    return a.join(b, "conv_id", "left").agg(F.count(F.lit(1)).alias("n_first"), F.count("hit").alias("n_both"))


@query("flow6_reextract_selection", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def flow6(t: Tables) -> DataFrame:
    hit = t.lineitem.filter("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(hit, "o_orderkey", "left_semi")


@query("flow7_top_keywords", "WITH k AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT p_name, n, round(100.0 * n / (SELECT count(*) FROM part), 4)::DOUBLE AS pct FROM k ORDER BY n DESC, p_name LIMIT 50")
def flow7(t: Tables) -> DataFrame:
    total = t.part.agg(F.count(F.lit(1)).alias("total"))
    x = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_name").limit(50).crossJoin(F.broadcast(total))
    return rounded(x.select("p_name", "n", (100.0 * F.col("n") / F.col("total")).alias("pct")))


@query("flt11_pending_sample", "SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending(t: Tables) -> DataFrame:
    return linkage.pending(t.documents.select("doc_id"), t.labels.filter("quality = 1"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
