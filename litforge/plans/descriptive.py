"""Queries on trends, rankings and laws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.functions.text import assign_period, normalize_journal
from litforge.operators import laws, ranking, trend
from litforge.plans.registry import Tables, query, r, rounded

PERIODS = [("early", 1995, 1996), ("middle", 1997, 1998), ("late", 1999, 2001)]
CASE = "CASE WHEN year BETWEEN 1995 AND 1996 THEN 'early' WHEN year BETWEEN 1997 AND 1998 THEN 'middle' WHEN year BETWEEN 1999 AND 2001 THEN 'late' END"
COUNTS = "c AS (SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1)"


def counts(t: Tables) -> DataFrame:
    return trend.annual_counts(t.orders.select(F.year("o_orderdate").alias("year")))


@query("annual_trend", f"""WITH {COUNTS} SELECT year, n, sum(n) OVER (ORDER BY year)::BIGINT AS cumulative, round(100.0 * n / sum(n) OVER (), 4)::DOUBLE AS pct_of_total,
    round((n::DOUBLE / lag(n) OVER (ORDER BY year) - 1) * 100, 4) AS yoy_growth_pct,
    CASE WHEN count(*) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN round(avg(n) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) END AS rolling_mean FROM c""")
def annual_trend(t: Tables) -> DataFrame:
    return rounded(trend.annual_trend(counts(t)))


@query("agg6_annual_counts", f"WITH {COUNTS} SELECT year, n FROM c WHERE year BETWEEN 1996 AND 2000")
def agg6(t: Tables) -> DataFrame:
    """AGG6 with FLT6, a range of years."""
    return counts(t).filter(F.col("year").between(1996, 2000))


@query("agg7_period_cagr", f"""WITH {COUNTS}, p AS (SELECT *, {CASE} AS period FROM c),
    g AS (SELECT period, sum(n)::BIGINT AS n_total, round(avg(n), 4) AS annual_mean, arg_min(n, year) AS first, arg_max(n, year) AS last, max(year) - min(year) AS span FROM p WHERE period IS NOT NULL GROUP BY 1)
    SELECT period, n_total, annual_mean, CASE WHEN span > 0 THEN round((pow(last::DOUBLE / first, 1.0 / span) - 1) * 100, 4) END AS cagr_pct FROM g""")
def agg7(t: Tables) -> DataFrame:
    return rounded(trend.period_statistics(counts(t), PERIODS))


@query("win1_cumulative", f"WITH {COUNTS} SELECT year, sum(n) OVER (ORDER BY year)::BIGINT AS cumulative FROM c")
def win1(t: Tables) -> DataFrame:
    return trend.annual_trend(counts(t)).select("year", "cumulative")


@query("win2_yoy_growth", f"WITH {COUNTS} SELECT year, round((n::DOUBLE / lag(n) OVER (ORDER BY year) - 1) * 100, 4) AS yoy_growth_pct FROM c")
def win2(t: Tables) -> DataFrame:
    return rounded(trend.annual_trend(counts(t)).select("year", "yoy_growth_pct"))


@query("win3_centered_rolling_mean", f"""WITH {COUNTS} SELECT year, CASE WHEN count(*) OVER (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3
    THEN round(avg(n) OVER (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) END AS rolling_mean FROM c""")
def win3(t: Tables) -> DataFrame:
    return rounded(trend.annual_trend(counts(t), window=3).select("year", "rolling_mean"))


@query("win9_peak_year", f"WITH {COUNTS} SELECT year AS peak_year, n FROM c ORDER BY n DESC, year LIMIT 1")
def win9(t: Tables) -> DataFrame:
    return trend.peak(counts(t))


@query("win10_acceleration", f"WITH {COUNTS}, y AS (SELECT year, n, (n::DOUBLE / lag(n) OVER (ORDER BY year) - 1) * 100 AS g FROM c) SELECT year, n, round(g, 4) AS yoy_growth_pct FROM y WHERE g >= 0.5")
def win10(t: Tables) -> DataFrame:
    return rounded(trend.acceleration(trend.annual_trend(counts(t)), 0.5))


@query("per1_assign_period", f"SELECT {CASE} AS period, count(*) AS n FROM (SELECT year(o_orderdate) AS year FROM orders) GROUP BY 1")
def per1(t: Tables) -> DataFrame:
    return t.orders.groupBy(assign_period(F.year("o_orderdate"), PERIODS).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("per3_linear_forecast", "SELECT year(o_orderdate)::BIGINT AS year, round(count(*) * 12 / 7.0, 4)::DOUBLE AS forecast FROM orders WHERE year(o_orderdate) = 2001 GROUP BY 1")
def per3(t: Tables) -> DataFrame:
    return rounded(counts(t).filter("year = 2001").select("year", trend.linear_forecast(F.col("n"), 7.0).cast("double").alias("forecast")))


#: Records are orders, entities the nations of an order's suppliers, citations its price in whole units.
RECORDS = """rec AS (SELECT DISTINCT o.o_orderkey AS k, n.n_name AS e, floor(o.o_totalprice)::BIGINT AS c FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey),
    w AS (SELECT *, count(*) OVER (PARTITION BY k) AS m FROM rec)"""


def supplied(t: Tables) -> DataFrame:
    """(order, line, supplier, nation, price)"""
    s = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "n_regionkey")
    l = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return l.join(t.orders.select("o_orderkey", F.floor("o_totalprice").alias("price"), "o_orderpriority", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))


def records(t: Tables) -> DataFrame:
    return supplied(t).groupBy("o_orderkey").agg(F.collect_set("n_name").alias("nations"), F.max("price").alias("price"))


@query("agg8_country_ranking", f"""WITH {RECORDS}, g AS (SELECT e AS entity, count(*) AS n, sum(c)::BIGINT AS citations, avg(c) AS mean_citations, count(*) FILTER (WHERE m > 1) AS mcp FROM w GROUP BY 1)
    SELECT entity, n, round(100.0 * n / (SELECT count(DISTINCT k) FROM rec), 4)::DOUBLE AS pct, citations, round(mean_citations, 4) AS mean_citations, mcp, round(mcp::DOUBLE / n, 4) AS mcp_ratio, row_number() OVER (ORDER BY n DESC, entity) AS rank FROM g""")
def agg8(t: Tables) -> DataFrame:
    return rounded(ranking.entity_ranking(records(t), "nations", "price"))


@query("agg9_scp_mcp_split", f"WITH {RECORDS}, s AS (SELECT k, count(*) AS m FROM rec GROUP BY 1) SELECT count(*) FILTER (WHERE m = 1) AS scp, count(*) FILTER (WHERE m > 1) AS mcp, round(avg(CASE WHEN m > 1 THEN m END), 4) AS mean_entities FROM s")
def agg9(t: Tables) -> DataFrame:
    return rounded(ranking.single_multi_split(records(t), "nations"))


@query("agg10_pair_counts", f"WITH {RECORDS} SELECT x.e AS a, y.e AS b, count(*) AS n FROM rec x JOIN rec y ON x.k = y.k AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 3")
def agg10(t: Tables) -> DataFrame:
    return ranking.pair_counts(supplied(t), "o_orderkey", "n_name", 3)


@query("agg11_institution_ranking", """WITH x AS (SELECT o.o_orderkey AS k, s.s_name AS e, n.n_name AS g, l.l_linenumber AS p, floor(o.o_totalprice)::BIGINT AS c FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey),
    s AS (SELECT k, count(DISTINCT g) > 1 AS wide FROM x GROUP BY 1), o AS (SELECT k, e, min(p) AS p, max(c) AS c FROM x GROUP BY 1, 2)
    SELECT e AS s_name, count(*) AS n, count(*) FILTER (WHERE p = 1) AS n_first, sum(c)::BIGINT AS citations, count(*) FILTER (WHERE wide) AS n_intl, round(count(*) FILTER (WHERE wide) / count(*)::DOUBLE, 4) AS intl_ratio FROM o JOIN s USING (k) GROUP BY 1""")
def agg11(t: Tables) -> DataFrame:
    return rounded(ranking.position_ranking(supplied(t), "o_orderkey", "s_name", "l_linenumber", "price", "n_name"))


@query("agg12_author_stats", """WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS k FROM c),
    i AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)
    SELECT p_brand, count(*) AS n_variants, max(p_name) FILTER (WHERE k = 1) AS main_name, string_agg(p_name, ' | ' ORDER BY k) FILTER (WHERE k <= 3) AS top_names, sum(n)::BIGINT AS n_records,
    (SELECT string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FROM i WHERE i.p_brand = r.p_brand AND i.k <= 5) AS sample_ids FROM r GROUP BY p_brand""")
def agg12(t: Tables) -> DataFrame:
    return ranking.variant_stats(t.part, "p_brand", "p_name", "p_partkey")


@query("agg13_modal_institution", """WITH x AS (SELECT o.o_custkey, n.n_name, count(*) AS c FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY 1, 2)
    SELECT o_custkey, n_name AS institution FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, n_name) AS k FROM x) WHERE k = 1""")
def agg13(t: Tables) -> DataFrame:
    x = supplied(t).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey", "n_name").agg(F.count(F.lit(1)).alias("c"))
    return x.groupBy("o_custkey").agg(F.min(F.struct((-F.col("c")).alias("c"), "n_name"))["n_name"].alias("institution"))


@query("agg14_journal_ranking", """SELECT p_name AS source, count(*) AS n, sum(floor(l_extendedprice))::BIGINT AS citations, round(avg(floor(l_extendedprice)), 4) AS mean_citations, min(year(l_shipdate))::BIGINT AS first_year, max(year(l_shipdate))::BIGINT AS last_year
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def agg14(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.part.select("p_partkey", F.col("p_name").alias("source")), F.col("l_partkey") == F.col("p_partkey")).select("source", F.floor("l_extendedprice").alias("c"), F.year("l_shipdate").alias("y"))
    return rounded(ranking.source_ranking(x, "source", "c", "y"))


@query("agg15_citation_stats", """SELECT count(*) AS n, count(*) FILTER (WHERE c = 0) AS n_zero, round(avg(c), 4) AS mean, median(c)::DOUBLE AS median, max(c) AS max, count(*) FILTER (WHERE c >= 10) AS n_ge_10, count(*) FILTER (WHERE c >= 50) AS n_ge_50,
    count(*) FILTER (WHERE c >= 100) AS n_ge_100 FROM (SELECT (l_partkey * 7 % 130)::BIGINT AS c FROM lineitem)""")
def agg15(t: Tables) -> DataFrame:
    return rounded(laws.citation_descriptives(t.lineitem.select((F.col("l_partkey") * 7 % 130).alias("c")), "c"))


@query("agg28_ordered_institutions", """WITH x AS (SELECT l_orderkey, l_linenumber, n_name, r_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    f AS (SELECT l_orderkey, n_name, min(l_linenumber) AS p FROM x GROUP BY 1, 2), i AS (SELECT l_orderkey, string_agg(n_name, '|' ORDER BY p, n_name) AS institutions FROM f GROUP BY 1),
    c AS (SELECT l_orderkey, string_agg(DISTINCT r_name, '|' ORDER BY r_name) AS countries FROM x GROUP BY 1) SELECT l_orderkey, institutions, countries FROM i JOIN c USING (l_orderkey)""")
def agg28(t: Tables) -> DataFrame:
    x = supplied(t).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return ranking.ordered_institutions(x, "l_orderkey", "l_linenumber", "n_name", "r_name").select("l_orderkey", F.array_join("institutions", "|").alias("institutions"), F.array_join("countries", "|").alias("countries"))


@query("agg29_affiliation_inventory", """WITH d AS (SELECT DISTINCT o_custkey AS k, o_orderpriority || ' ' || o_orderstatus AS a FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY k) AS i FROM d)
    SELECT 'AF_' || substr(md5(lower(a)), 1, 12) AS affil_id, a AS affiliation, count(*) AS n_records, string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (WHERE i <= 5) AS sample_ids FROM w GROUP BY a""")
def agg29(t: Tables) -> DataFrame:
    x = t.orders.select("o_custkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("affiliation"))
    return ranking.affiliation_inventory(x, "o_custkey", "affiliation")


@query("agg30_topk_other", """WITH t AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
    SELECT CAST(ts AS DATE)::VARCHAR AS day, CASE WHEN event_type IN (SELECT event_type FROM t) THEN event_type ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1, 2""")
def agg30(t: Tables) -> DataFrame:
    return trend.topk_other(t.events.select(F.to_date("ts").cast("string").alias("day"), "event_type"), "day", "event_type", 3)


@query("agg32_group_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.75), 4) AS p75 FROM events GROUP BY 1")
def agg32(t: Tables) -> DataFrame:
    q = lambda v: F.percentile("value", F.lit(v))
    return rounded(t.events.groupBy("event_type").agg(q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75")))


@query("agg39_hub_degrees", """WITH e AS (SELECT DISTINCT n_name AS src, o_orderpriority AS dst FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), b AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)
    SELECT node, count(*) AS degree FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def agg39(t: Tables) -> DataFrame:
    x = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    return ranking.hub_degrees(x.select(F.col("n_name").alias("src"), F.col("o_orderpriority").alias("dst")), 15)


BRADFORD = """g AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_partkey) AS rank, sum(n) OVER (ORDER BY n DESC, l_partkey) AS cum, sum(n) OVER () AS total FROM g),
    z AS (SELECT l_partkey, n, rank, cum::BIGINT AS cumulative, round(100.0 * cum / total, 4)::DOUBLE AS cumulative_pct, (1 + CASE WHEN 3 * (cum - n) >= total THEN 1 ELSE 0 END + CASE WHEN 3 * (cum - n) >= 2 * total THEN 1 ELSE 0 END)::BIGINT AS zone FROM w)"""


@query("win5_win7_bradford", f"WITH {BRADFORD} SELECT * FROM z")
def win5(t: Tables) -> DataFrame:
    return rounded(laws.bradford(t.lineitem, "l_partkey"))


@query("sta8_mth4_bradford_zones", f"""WITH {BRADFORD}, s AS (SELECT zone, count(*) AS sources, sum(n)::BIGINT AS records FROM z GROUP BY 1)
    SELECT zone, sources, records, round(sqrt((SELECT sources FROM s WHERE zone = 3)::DOUBLE / (SELECT sources FROM s WHERE zone = 1)), 4) AS multiplier FROM s""")
def sta8(t: Tables) -> DataFrame:
    return rounded(laws.bradford_zones(laws.bradford(t.lineitem, "l_partkey")))


@query("win6_h_index", """WITH x AS (SELECT l_suppkey, l_quantity::BIGINT AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS k FROM lineitem) SELECT l_suppkey, coalesce(max(CASE WHEN c >= k THEN k END), 0) AS h_index FROM x GROUP BY 1""")
def win6(t: Tables) -> DataFrame:
    return laws.h_index(t.lineitem, "l_quantity", "l_suppkey")


LOTKA = """p AS (SELECT x, count(*) AS producers FROM (SELECT o_custkey, count(*) AS x FROM orders GROUP BY 1) GROUP BY 1),
    f AS (SELECT -regr_slope(log10(producers), log10(x)) AS alpha, pow(10, regr_intercept(log10(producers), log10(x))) AS c, regr_r2(log10(producers), log10(x)) AS r2, sum(producers)::BIGINT AS total FROM p),
    m AS (SELECT p.x, producers, c / pow(p.x, alpha) AS model FROM p, f), g AS (SELECT abs(sum(producers) OVER (ORDER BY x)::DOUBLE / sum(producers) OVER () - sum(model) OVER (ORDER BY x) / sum(model) OVER ()) AS gap FROM m)"""


@query("sta7_mth2_win12_lotka", f"""WITH {LOTKA} SELECT total, round(alpha, 4) AS alpha, round(c, 4) AS c, round(r2, 4) AS r2, round((SELECT max(gap) FROM g), 4) AS ks, round(1.36 / sqrt(total), 4) AS ks_critical, (SELECT max(gap) FROM g) < 1.36 / sqrt(total) AS ks_pass,
    CASE WHEN alpha < 1.8 THEN 'sub' WHEN alpha > 2.5 THEN 'super' ELSE 'classic' END AS regime FROM f""")
def sta7(t: Tables) -> DataFrame:
    """With MTH3, the regime's label."""
    return rounded(laws.lotka(laws.productivity(t.orders, "o_custkey")))


@query("win8_top_per_group", "SELECT c_mktsegment, c_custkey, round(c_acctbal, 2) AS c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5")
def win8(t: Tables) -> DataFrame:
    x = t.customer.select("c_mktsegment", "c_custkey", "c_acctbal")
    return rounded(ranking.top_per_group(x, "c_mktsegment", 5, F.desc("c_acctbal"), F.asc("c_custkey")), 2)


@query("win4_dense_rank", "SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1")
def win4(t: Tables) -> DataFrame:
    return ranking.with_rank(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), F.desc("n"), F.asc("event_type"))


@query("win13_quadrants", """WITH x AS (SELECT user_id, count(*)::DOUBLE AS x, round(avg(value), 6) AS y FROM events GROUP BY 1), m AS (SELECT median(x) AS mx, median(y) AS my FROM x)
    SELECT user_id, CASE WHEN x >= mx AND y >= my THEN 'Q1' WHEN x < mx AND y >= my THEN 'Q2' WHEN x < mx THEN 'Q3' ELSE 'Q4' END AS quadrant FROM x, m""")
def win13(t: Tables) -> DataFrame:
    x = t.events.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("x"), r(F.avg("value"), 6).alias("y"))
    return laws.quadrants(x, "x", "y").select("user_id", "quadrant")


@query("str7_journal_names", "SELECT nullif(upper(trim(regexp_replace(trim(p_name || ' (' || p_brand || ')'), '\\s*\\([^)]*\\)\\s*$', ''))), '') AS journal, count(*) AS n FROM part GROUP BY 1")
def str7(t: Tables) -> DataFrame:
    return t.part.groupBy(normalize_journal(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))).alias("journal")).agg(F.count(F.lit(1)).alias("n"))


@query("jon14_position_assignment", """WITH i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), s_name) AS p, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey, s_name),
    a AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS position FROM lineitem)
    SELECT a.k AS l_orderkey, a.position, coalesce(x.s_name, f.s_name, '(unknown)') AS institution FROM a LEFT JOIN i x ON x.k = a.k AND x.p = a.position LEFT JOIN i f ON f.k = a.k AND f.p = 1""")
def jon14(t: Tables) -> DataFrame:
    s = supplied(t).filter("l_orderkey % 3 <> 0")
    inst = ranking.ordered_institutions(s, "l_orderkey", "l_linenumber", "s_name", "n_name").select("l_orderkey", "institutions")
    authors = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("position"))
    return ranking.assign_by_position(authors, inst, "l_orderkey", "position", "institutions")


@query("agg3_overlap_combos", "WITH d AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '+' ORDER BY o_orderpriority) AS combo FROM orders GROUP BY 1) SELECT combo, count(*) AS n FROM d GROUP BY 1")
def agg3(t: Tables) -> DataFrame:
    return ranking.overlap_counts(t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s")), "s")


@query("agg4_multiplicity", "SELECT multiplicity, count(*) AS n_keys FROM (SELECT text, count(*) AS multiplicity FROM documents GROUP BY 1) GROUP BY 1")
def agg4(t: Tables) -> DataFrame:
    return ranking.multiplicity(t.documents, "text")


@query("agg5_coverage", """SELECT source, count(*) AS n, count(quality) AS n_quality, count(*) FILTER (WHERE trim(text) <> '') AS n_text, round(100.0 * count(quality) / count(*), 4)::DOUBLE AS pct_quality,
    round(100.0 * count(*) FILTER (WHERE trim(text) <> '') / count(*), 4)::DOUBLE AS pct_text FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def agg5(t: Tables) -> DataFrame:
    return rounded(ranking.coverage(t.documents.join(t.labels, "doc_id", "left"), "source", ["quality", "text"]))


@query("prj2_presence_combos", """SELECT CASE WHEN quality IS NOT NULL AND trim(text) <> '' THEN 'text+quality' WHEN quality IS NOT NULL THEN 'quality' WHEN trim(text) <> '' THEN 'text' ELSE 'none' END AS combo, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def prj2(t: Tables) -> DataFrame:
    return ranking.presence_combos(t.documents.join(t.labels, "doc_id", "left"), ["text", "quality"])


@query("srt1_mixed_sort", "SELECT o_orderkey, o_orderpriority, rank FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 50")
def srt1(t: Tables) -> DataFrame:
    top = t.orders.orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(50)
    return ranking.with_rank(top, F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "o_orderpriority", "rank")


@query("srt2_nlargest", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 20")
def srt2(t: Tables) -> DataFrame:
    return rounded(t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20), 2)


@query("srt3_head_counts", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def srt3(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(25)


@query("sta9_top_cited", """SELECT o_orderkey, year, c, round(c::DOUBLE / (2001 - year + 1), 4) AS per_year, round(c / avg(c) OVER (PARTITION BY year), 4) AS normalised FROM (SELECT o_orderkey, year(o_orderdate)::BIGINT AS year, floor(o_totalprice)::BIGINT AS c FROM orders) QUALIFY row_number() OVER (ORDER BY c DESC, o_orderkey) <= 20""")
def sta9(t: Tables) -> DataFrame:
    """Most cited records with citations a year and relative to their year's mean."""
    x = t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"), F.floor("o_totalprice").alias("c"))
    mean = x.groupBy("year").agg(F.avg("c").alias("m"))
    top = x.orderBy(F.desc("c"), "o_orderkey").limit(20).join(mean, "year")
    return rounded(top.select("o_orderkey", "year", "c", (F.col("c") / (2001 - F.col("year") + 1)).alias("per_year"), (F.col("c") / F.col("m")).alias("normalised")))


@query("sta9_summary", """WITH x AS (SELECT o_orderkey, o_orderpriority, o_custkey, n_name, floor(o_totalprice)::BIGINT AS c, year(o_orderdate) AS year FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    f AS (SELECT 'sources' AS section, o_orderpriority AS name, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'authors', o_custkey::VARCHAR, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'countries', n_name, count(*) FROM x GROUP BY 2)
    SELECT section, row_number() OVER (PARTITION BY section ORDER BY n DESC, name) AS rank, name, n, NULL::DOUBLE AS per_year, NULL::DOUBLE AS normalised FROM f QUALIFY rank <= 10
    UNION ALL SELECT 'cited', row_number() OVER (ORDER BY c DESC, o_orderkey) AS rank, o_orderkey::VARCHAR, c, round(c::DOUBLE / (2001 - year + 1), 4), round(c / avg(c) OVER (PARTITION BY year), 4) FROM x QUALIFY rank <= 10""")
def sta9_summary(t: Tables) -> DataFrame:
    x = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    x = x.select("o_orderkey", "o_orderpriority", F.array(F.col("o_custkey").cast("string")).alias("authors"), F.array("n_name").alias("countries"), F.floor("o_totalprice").alias("c"), F.year("o_orderdate").alias("year"))
    return rounded(ranking.bibliometric_summary(x, "o_orderkey", "o_orderpriority", "authors", "countries", "c", "year", 2001))


@query("agg26_family_summary", "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS n_brands, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1")
def agg26(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("n_brands"), F.countDistinct("p_name").alias("n_names"))


@query("agg38_axis_share", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'PK' WHEN event_type = 'purchase' THEN 'PD' ELSE 'Other' END AS axis, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 4)::DOUBLE AS pct FROM events GROUP BY 1")
def agg38(t: Tables) -> DataFrame:
    axis = F.when(F.col("event_type").isin("click", "view"), "PK").when(F.col("event_type") == "purchase", "PD").otherwise("Other")
    n = t.events.groupBy(axis.alias("axis")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())))
