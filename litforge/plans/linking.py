"""Queries on filters, joins, record linkage, sets and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.functions.text import is_exclusive, leading_token, core_tokens, listed_tokens, first_rule_match, normalize_title, term_block_class
from litforge.operators import linkage, lists
from litforge.plans.registry import Tables, query, r, rounded
from litforge.scratch import folder, stored
from litforge.streaming import incremental, reconcile

TITLE = "trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def titled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars", F.md5(normalize_title(F.col("text")).cast("binary")).alias("key"))


@query("agg1_survivorship", f"""WITH d AS (SELECT doc_id, lang, source, n_chars, md5({TITLE}) AS key, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS prio FROM documents),
    w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, n_chars DESC, doc_id) AS k, max(n_chars) OVER (PARTITION BY key) AS most FROM d), g AS (SELECT key, string_agg(DISTINCT lang, '+' ORDER BY lang) AS sources, count(DISTINCT lang) AS source_count, count(*) AS n_merged FROM d GROUP BY 1)
    SELECT doc_id, lang, source, most AS n_chars, sources, source_count, n_merged FROM w JOIN g USING (key) WHERE k = 1""")
def agg1(t: Tables) -> DataFrame:
    prio = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    x = titled(t).withColumn("len", F.col("n_chars"))
    out = linkage.survivorship(x, "key", [prio, -F.col("len"), F.col("doc_id")], "lang", "doc_id", maxes=["n_chars"])
    return out.select("doc_id", "lang", "source", "n_chars", F.array_join("source_list", "+").alias("sources"), F.col("source_count").cast("long").alias("source_count"), "n_merged")


CHUNKED = "list_aggregate(list(i ORDER BY i), 'string_agg', ',') AS items, count(*) AS n"


def joined(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query("agg1_id_chunks", f"""WITH d AS (SELECT doc_id AS i, md5({TITLE}) AS key FROM documents), w AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY i) - 1) // 16 AS chunk FROM d)
    SELECT key, chunk, {CHUNKED} FROM w GROUP BY 1, 2""")
def agg1_chunks(t: Tables) -> DataFrame:
    """AGG1: the ids behind each golden record, 16 a row, so that a title of very many records makes rows and not one long list."""
    return joined(lists.chunked(titled(t), ["key"], "doc_id", 16))


@query("agg2_merge_audit", f"""WITH d AS (SELECT doc_id, lang, md5({TITLE}) AS key, n_chars FROM documents), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) AS k FROM d)
    SELECT count(*) AS n_merged, string_agg(lang || ':' || doc_id, ';' ORDER BY lang, doc_id) AS merged, max(doc_id) FILTER (WHERE k = 1) AS chosen FROM w GROUP BY key HAVING count(*) > 1""")
def agg2(t: Tables) -> DataFrame:
    out = linkage.survivorship(titled(t), "key", [-F.col("n_chars"), F.col("doc_id")], "source", "doc_id").filter("n_merged > 1").select("key", F.col("doc_id").alias("chosen"), "n_merged")
    who = titled(t).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lang", "doc_id"))).alias("m"))
    return out.join(who, "key").select("n_merged", F.array_join(F.transform("m", lambda x: F.concat(x["lang"], F.lit(":"), x["doc_id"].cast("string"))), ";").alias("merged"), "chosen")


@query("flt1_split_has_key", "SELECT quality IS NOT NULL AS has_key, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def flt1(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").groupBy(linkage.has_key("quality").alias("has_key")).agg(F.count(F.lit(1)).alias("n"))


@query("flt2_block_eligible", "SELECT count(*) FILTER (WHERE p_size IS NOT NULL AND length(p_name) >= 10 AND length(p_brand) >= 2) AS eligible, count(*) AS n FROM part")
def flt2(t: Tables) -> DataFrame:
    return t.part.agg(F.count_if(linkage.block_eligible(F.col("p_size"), F.col("p_name"), F.col("p_brand"))).alias("eligible"), F.count(F.lit(1)).alias("n"))


BLOCKS = [("B1_direct", [["the and", "der die"]]), ("B2_both", [["tion"], ["ment", "heit"]]), ("B3_rest", [["que ", "los "], ["de "]])]
BLOCK_SQL = """CASE WHEN contains(lower(text), 'the and') OR contains(lower(text), 'der die') THEN 'B1_direct' WHEN contains(lower(text), 'tion') AND (contains(lower(text), 'ment') OR contains(lower(text), 'heit')) THEN 'B2_both'
    WHEN (contains(lower(text), 'que ') OR contains(lower(text), 'los ')) AND contains(lower(text), 'de ') THEN 'B3_rest' ELSE 'B0_none' END"""


@query("flt3_term_blocks", f"SELECT doc_id, {BLOCK_SQL} AS block FROM documents")
def flt3(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", term_block_class(F.col("text"), BLOCKS).alias("block"))


@query("flt4_exclusive_source", "SELECT o_custkey, bool_and(o_orderpriority = '1-URGENT') AS only_urgent FROM orders GROUP BY 1")
def flt4(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s")).select("o_custkey", is_exclusive(F.col("s"), "1-URGENT").alias("only_urgent"))


@query("flt5_conditional_filter", f"SELECT matched_block, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN {BLOCK_SQL} ELSE 'auto_pass' END AS matched_block FROM documents) WHERE matched_block <> 'B0_none' GROUP BY 1")
def flt5(t: Tables) -> DataFrame:
    out = linkage.conditional_filter(t.documents, F.col("lang") == "en", term_block_class(F.col("text"), BLOCKS))
    return out.groupBy("matched_block").agg(F.count(F.lit(1)).alias("n"))


@query("jon1_left_lookup", "SELECT doc_id, lang, quality::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def jon1(t: Tables) -> DataFrame:
    """JON1, JON2: a left join with a lookup table."""
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.col("quality").cast("long").alias("quality")), "doc_id", "left")


@query("jon4_inner_lookup", "SELECT lang, quality::BIGINT AS quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def jon4(t: Tables) -> DataFrame:
    """JON3, JON4, JON12"""
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang", F.col("quality").cast("long").alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("jon5_consistency_check", "SELECT count(*) AS n, count(*) FILTER (WHERE d.n_chars <> length(e.text)) AS mismatches FROM documents d JOIN documents e USING (doc_id)")
def jon5(t: Tables) -> DataFrame:
    a, b = t.documents.select("doc_id", "n_chars"), t.documents.select("doc_id", F.length("text").alias("n2"))
    return a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") != F.col("n2")).alias("mismatches"))


MAPPING = [("1-URGENT", "high"), ("2-HIGH", "high"), ("3-MEDIUM", "normal")]
MAP_SQL = "(VALUES ('1-URGENT', 'high'), ('2-HIGH', 'high'), ('3-MEDIUM', 'normal')) m(alias, canonical)"


@query("jon6_dictionary_lookup", f"SELECT coalesce(canonical, o_orderpriority) AS priority, count(*) AS n FROM orders LEFT JOIN {MAP_SQL} ON alias = o_orderpriority GROUP BY 1")
def jon6(t: Tables) -> DataFrame:
    m = t.spark.createDataFrame(MAPPING, "alias string, canonical string")
    return linkage.map_values(t.orders, "o_orderpriority", m, "priority").groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query("jon7_key_fill", """WITH x AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN lang END AS v FROM documents), f AS (SELECT source, string_agg(DISTINCT v, '+' ORDER BY v) AS fill FROM x WHERE v IS NOT NULL GROUP BY 1)
    SELECT doc_id, coalesce(v, fill, '') AS langs FROM x LEFT JOIN f USING (source)""")
def jon7(t: Tables) -> DataFrame:
    x = t.documents.select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("langs"))
    return linkage.fill_from_key(x, "source", "langs").select("doc_id", F.array_join("langs", "+").alias("langs"))


@query("jon8_semi_join", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jon8(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("jon9_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon9(t: Tables) -> DataFrame:
    return linkage.pending(t.documents.select("doc_id"), t.labels, "doc_id")


PAIRS = "SELECT l.p_partkey AS a, r.p_partkey AS b FROM part l JOIN part r ON l.p_brand = r.p_brand AND l.p_type = r.p_type AND l.p_partkey < r.p_partkey"


@query("jon10_fuz1_fuzzy_pairs", f"""WITH p AS (SELECT l.p_partkey AS a, r.p_partkey AS b, l.p_name AS x, r.p_name AS y FROM part l JOIN part r ON l.p_brand = r.p_brand AND l.p_type = r.p_type AND l.p_partkey < r.p_partkey),
    s AS (SELECT a, b, 100.0 * (1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y), 1)) AS score FROM p),
    rep AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_name) AS rep FROM part)
    SELECT a, b, round(score, 4) AS score FROM s WHERE score >= 60 AND a IN (SELECT rep FROM rep) AND (b IN (SELECT rep FROM rep) OR (SELECT rep FROM rep WHERE p_partkey = b) = a)""")
def jon10(t: Tables) -> DataFrame:
    """Pairs between distinct texts of a block, and each copy with the first of its text."""
    return rounded(linkage.block_pairs(t.part, "p_partkey", ["p_brand", "p_type"], "p_name", 60.0, metric="levenshtein"))


@query("fuz1_indel_pairs")
def fuz1(t: Tables) -> DataFrame:
    """The Indel ratio needs a longest common subsequence, which SQL lacks; tests hold it against brute force."""
    return rounded(linkage.block_pairs(t.part, "p_partkey", ["p_brand", "p_type"], "p_name", 80.0))


@query("jon10_segment_index", """WITH p AS (SELECT l.p_partkey AS a, r.p_partkey AS b, l.p_name AS x, r.p_name AS y FROM part l JOIN part r ON l.p_brand = r.p_brand AND l.p_partkey < r.p_partkey),
    s AS (SELECT a, b, 100.0 * (1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y), 1)) AS score FROM p), rep AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS rep FROM part)
    SELECT a, b, round(score, 4) AS score FROM s WHERE score >= 75 AND a IN (SELECT rep FROM rep) AND (b IN (SELECT rep FROM rep) OR (SELECT rep FROM rep WHERE p_partkey = b) = a)""")
def jon10_segments(t: Tables) -> DataFrame:
    """Blocks as if all were hot: candidates by the index of segments alone."""
    return rounded(linkage.block_pairs(t.part, "p_partkey", ["p_brand"], "p_name", 75.0, metric="levenshtein", direct=0))


COMPONENTS = f"""e AS (SELECT a, b FROM ({PAIRS}) JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b WHERE 100.0 * (1 - levenshtein(x.p_name, y.p_name)::DOUBLE / greatest(length(x.p_name), length(y.p_name), 1)) >= 60),
    both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT DISTINCT a AS id, a AS c FROM both_ UNION SELECT w.id, x.b FROM w JOIN both_ x ON x.a = w.c)"""


@query("fuz3_fuzzy_components", f"WITH RECURSIVE {COMPONENTS} SELECT id, min(c) AS component FROM w GROUP BY 1")
def fuz3(t: Tables) -> DataFrame:
    return linkage.connected_components(linkage.block_pairs(t.part, "p_partkey", ["p_brand", "p_type"], "p_name", 60.0, metric="levenshtein"))


@query("fuz4_resolve_components", f"""WITH RECURSIVE {COMPONENTS}, g AS (SELECT id, min(c) AS component FROM w GROUP BY 1), p AS (SELECT p_partkey, p_size, coalesce(component, p_partkey) AS component FROM part LEFT JOIN g ON id = p_partkey),
    k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY p_size DESC, p_partkey) AS k FROM p)
    SELECT component, max(p_partkey) FILTER (WHERE k = 1) AS p_partkey, coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FILTER (WHERE k > 1), '') AS absorbed FROM k GROUP BY 1""")
def fuz4(t: Tables) -> DataFrame:
    c = linkage.connected_components(linkage.block_pairs(t.part, "p_partkey", ["p_brand", "p_type"], "p_name", 60.0, metric="levenshtein"))
    out = linkage.resolve_components(t.part.select("p_partkey", "p_size"), c, "p_partkey", F.desc("p_size"), F.asc("p_partkey"))
    return out.select("component", "p_partkey", F.array_join("absorbed", ",").alias("absorbed"))


@query("fuz4_absorbed_chunks", f"""WITH RECURSIVE {COMPONENTS}, g AS (SELECT id, min(c) AS component FROM w GROUP BY 1), p AS (SELECT p_partkey AS i, p_size, coalesce(component, p_partkey) AS component FROM part LEFT JOIN g ON id = p_partkey),
    k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY p_size DESC, i) AS k FROM p), c AS (SELECT *, (row_number() OVER (PARTITION BY component ORDER BY i) - 1) // 4 AS chunk FROM k WHERE k > 1)
    SELECT 'absorbed' AS kind, component, chunk, {CHUNKED} FROM c GROUP BY 2, 3 UNION ALL SELECT 'kept', component, 0, i::VARCHAR, 1 FROM k WHERE k = 1""")
def fuz4_chunks(t: Tables) -> DataFrame:
    """FUZ4 without a list or a window that grows with its component."""
    c = linkage.connected_components(linkage.block_pairs(t.part, "p_partkey", ["p_brand", "p_type"], "p_name", 60.0, metric="levenshtein"))
    stay, absorbed = linkage.resolve_in_chunks(t.part.select("p_partkey", "p_size"), c, "p_partkey", [-F.col("p_size"), F.col("p_partkey")], 4)
    kept = stay.select(F.lit("kept").alias("kind"), "component", F.lit(0).cast("long").alias("chunk"), F.col("p_partkey").cast("string").alias("items"), F.lit(1).cast("long").alias("n"))
    return joined(absorbed).select(F.lit("absorbed").alias("kind"), "component", "chunk", "items", "n").unionAll(kept)


KEYWORDS = "k AS (SELECT p_name AS keyword, count(*) AS n FROM part GROUP BY 1)"


@query("jon11_fuz2_topk_fuzzy_join")
def jon11(t: Tables) -> DataFrame:
    """JON11, FUZ2, FUZ5: candidates of the fuzzy thesaurus; the token-sorted ratio is an Indel ratio, so it is tested by brute force."""
    k = t.part.groupBy(F.col("p_name").alias("keyword")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(linkage.suggest_thesaurus(k, 60.0))


@query("fuz6_apply_thesaurus", """WITH m AS (SELECT o_orderkey AS record, o_orderstatus AS source, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'normal' ELSE o_orderpriority END AS keyword FROM orders)
    SELECT DISTINCT record, keyword FROM m WHERE keyword <> '5-LOW'""")
def fuz6(t: Tables) -> DataFrame:
    m, stop = t.spark.createDataFrame(MAPPING, "alias string, canonical string"), t.spark.createDataFrame([("5-LOW",)], "keyword string")
    x = t.orders.select(F.col("o_orderkey").alias("record"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("keyword"))
    return linkage.apply_thesaurus(x, m, stop, "record", "source", "keyword")


@query("map1_variant_closure", """WITH RECURSIVE m AS (SELECT 'v' || n_nationkey AS alias, 'v' || (n_nationkey // 2) AS canonical FROM nation WHERE n_nationkey > 0), w AS (SELECT alias, canonical, 1 AS d FROM m UNION ALL SELECT w.alias, m.canonical, d + 1 FROM w JOIN m ON m.alias = w.canonical)
    SELECT alias, arg_max(canonical, d) AS canonical FROM w GROUP BY 1""")
def map1(t: Tables) -> DataFrame:
    m = t.nation.filter("n_nationkey > 0").select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("v"), F.expr("n_nationkey div 2").cast("string")).alias("canonical"))
    return linkage.close_mapping(m)


@query("str16_drug_lookup", f"SELECT l_returnflag, coalesce(c, l_returnflag) AS drug, count(*) AS n FROM lineitem LEFT JOIN (VALUES ('A', 'accepted'), ('R', 'returned')) m(a, c) ON a = l_returnflag GROUP BY 1, 2")
def str16(t: Tables) -> DataFrame:
    m = t.spark.createDataFrame([("A", "accepted"), ("R", "returned")], "alias string, canonical string")
    return linkage.map_values(t.lineitem, "l_returnflag", m, "drug").groupBy("l_returnflag", "drug").agg(F.count(F.lit(1)).alias("n"))


@query("str17_tiered_lookup", f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS b FROM orders)
    SELECT o_orderkey, coalesce(m.canonical, k.canonical, b, a) AS name, CASE WHEN coalesce(m.canonical, k.canonical) IS NOT NULL THEN 'mapped' WHEN coalesce(b, a) IS NOT NULL THEN 'unmapped' END AS name_status
    FROM x LEFT JOIN {MAP_SQL} ON m.alias = x.a LEFT JOIN {MAP_SQL.replace(') m(', ') k(')} ON k.alias = x.b""")
def str17(t: Tables) -> DataFrame:
    m = t.spark.createDataFrame(MAPPING, "alias string, canonical string")
    x = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("b"))
    return linkage.coalesce_lookup(x, ["a", "b"], m, "name", ["b", "a"]).select("o_orderkey", "name", "name_status")


@query("set1_union_by_name", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def set1(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(t.supplier.select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))


@query("set2_key_sets", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only_first', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def set2(t: Tables) -> DataFrame:
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n(a.intersect(b), "both").unionAll(n(a.subtract(b), "only_first"))


@query("set3_latest_per_key", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS k FROM conversations) WHERE k = 1")
def set3(t: Tables) -> DataFrame:
    return linkage.latest_by_key(t.conversations.select("conv_id", "turn", "role"), "conv_id", F.col("turn"), F.col("role"))


@query("set5_patch_merge", "SELECT doc_id, 'old' AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'new' FROM labels")
def set5(t: Tables) -> DataFrame:
    return linkage.patch_merge(t.documents.select("doc_id", F.lit("old").alias("version")), t.labels.select("doc_id", F.lit("new").alias("version")), "doc_id")


RECONCILED = """WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS key, year(o_orderdate)::BIGINT AS year FROM orders WHERE o_orderkey % 2 = 0),
    p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS key, year(o_orderdate)::BIGINT AS year FROM orders WHERE o_orderkey % 2 = 1 AND year(o_orderdate) = 2001),
    s AS (SELECT * FROM m WHERE year <> 2001), l AS (SELECT * FROM m WHERE year = 2001 AND (key IS NULL OR key NOT IN (SELECT key FROM p WHERE key IS NOT NULL))),
    u AS (SELECT * FROM p UNION ALL SELECT * FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS k FROM u WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM s WHERE key IS NOT NULL))
    SELECT 'main' AS corpus, id FROM s UNION ALL SELECT 'partial', id FROM k WHERE k = 1 UNION ALL SELECT 'partial', id FROM u WHERE key IS NULL"""


@query("set4_cross_corpus_reconcile", RECONCILED)
def set4(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", F.year("o_orderdate").alias("year"))
    main = o.filter("id % 2 = 0").select("id", F.when(F.col("id") % 7 != 0, F.col("o_custkey")).alias("key"), "year")
    part = o.filter("id % 2 = 1 and year = 2001").select("id", F.when(F.col("id") % 5 != 0, F.col("o_custkey")).alias("key"), "year")
    m, p = linkage.reconcile(main, part, "key", F.col("id"), F.col("year") == 2001)
    return m.select(F.lit("main").alias("corpus"), "id").unionAll(p.select(F.lit("partial"), "id"))


@query("set4_late_records", RECONCILED)
def set4_late(t: Tables) -> DataFrame:
    """The same corpora from a stream: a third of the orders come without key and year first, some of them in the other corpus, and whole in a later batch."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", F.year("o_orderdate").alias("year"))
    even = F.col("id") % 2 == 0
    key = F.when(F.when(even, F.col("id") % 7 != 0).otherwise(F.col("id") % 5 != 0), F.col("o_custkey"))
    whole = o.filter(even | (F.col("year") == 2001)).select("id", F.lit(2).alias("version"), F.when(even, "main").otherwise("partial").alias("corpus"), key.alias("key"), "year")
    late = F.col("id") % 3 == 0
    other = F.when(F.col("id") % 9 == 0, F.when(F.col("corpus") == "main", "partial").otherwise("main")).otherwise(F.col("corpus"))
    early = whole.filter(late).select("id", F.lit(1).alias("version"), other.alias("corpus"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("year"))
    src, log, out = (folder(t.spark, f"late-{x}") for x in ("records", "log", "changes"))
    stream = lambda: reconcile.record_log(incremental.file_stream(t.spark, src, whole.schema), "id", "version", F.col("corpus"), F.col("key"), F.col("id"), F.col("year") == 2001)
    for rows in (whole.filter(~late).unionByName(early), whole.filter(late)):
        rows.write.mode("append").parquet(src)
        incremental.run_available(stream(), log, f"{log}-done")
        incremental.run_available(reconcile.corpus_changes(incremental.file_stream(t.spark, log, T.StructType.fromDDL(reconcile.LOG))), out, f"{out}-done")
    return reconcile.standing(t.spark.read.schema(reconcile.CHANGE).parquet(out)).select("corpus", F.col("id").cast("long").alias("id"))


CITIES = ["the", "and", "der", "que", "los", "tion"]


@query("fuz8_catch_all", """WITH x AS (SELECT source, lower(text) AS s, quality FROM documents LEFT JOIN labels USING (doc_id)), w AS (SELECT source, regexp_extract(split_part(s, ',', 1), '[a-z]+') AS lead FROM x),
    c AS (SELECT source, count(DISTINCT c) AS n_cities FROM (SELECT source, unnest(['the', 'and', 'der', 'que', 'los', 'tion']) AS c, s FROM x) WHERE regexp_matches(s, '(^|[^\\p{L}\\p{N}_])' || c || '([^\\p{L}\\p{N}_]|$)') GROUP BY 1),
    g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(s, '(^|[^\\p{L}\\p{N}_])tion([^\\p{L}\\p{N}_]|$)'))::DOUBLE / count(*) < 0.4 AS overlap, quantile_disc(quality, 0.5) < 1 AS low_score FROM x GROUP BY 1),
    l AS (SELECT source, count(DISTINCT lead) FILTER (WHERE length(lead) >= 3)::DOUBLE / count(*) > 0.6 AS lead_diverse FROM w GROUP BY 1)
    SELECT source, n, coalesce(n_cities > 5, false) AS cities, overlap, lead_diverse, coalesce(low_score, false) AS low_score, (coalesce(n_cities > 5, false)::INT + overlap::INT + lead_diverse::INT + coalesce(low_score, false)::INT)::BIGINT AS score,
    (coalesce(n_cities > 5, false)::INT + overlap::INT + lead_diverse::INT + coalesce(low_score, false)::INT) >= 2 AS is_catch_all FROM g JOIN l USING (source) LEFT JOIN c USING (source) WHERE n >= 30""")
def fuz8(t: Tables) -> DataFrame:
    """FUZ8, STR14, MTH9: one aggregation, cities and leading words as sets of a few values a row."""
    x = t.documents.join(t.labels, "doc_id", "left").select("source", "quality", "text", leading_token(F.col("text")).alias("lead"))
    hits = F.aggregate(F.array(*[F.max(F.lower("text").rlike(rf"(?U)\b{c}\b").cast("int")) for c in CITIES]), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    criteria = {
        "cities": hits > 5, "overlap": F.count_if(F.lower("text").rlike(r"(?U)\btion\b")) / F.count(F.lit(1)) < 0.4,
        "lead_diverse": F.countDistinct(F.when(F.length("lead") >= 3, F.col("lead"))) / F.count(F.lit(1)) > 0.6, "low_score": F.expr("percentile_disc(0.5) within group (order by quality)") < 1,
    }
    return linkage.catch_all_groups(x, "source", 30, criteria)


@query("fuz9_postprocess_rules", """WITH x AS (SELECT p_partkey, p_type AS matched, CASE WHEN regexp_matches(p_name, '(?i)^a') THEN 'rule_a' WHEN regexp_matches(p_name, '(?i)e$') THEN 'rule_e' END AS rule, p_brand = 'Brand#11' AS bad FROM part)
    SELECT p_partkey, CASE WHEN rule IS NOT NULL THEN rule WHEN bad THEN NULL ELSE matched END AS value, CASE WHEN rule IS NOT NULL THEN 'override' WHEN bad THEN 'unmatched' ELSE 'kept' END AS reason FROM x""")
def fuz9(t: Tables) -> DataFrame:
    """FUZ9, STR13"""
    rule = first_rule_match(F.col("p_name"), [("^a", "rule_a"), ("e$", "rule_e")])
    return t.part.select("p_partkey", linkage.override_matches(F.col("p_type"), rule, F.col("p_brand") == "Brand#11").alias("m")).select("p_partkey", "m.value", "m.reason")


def authority(name: str) -> list[dict]:
    """A stand-in for an affiliation service: none for long names, an error for some, else two candidates."""
    if name.startswith("U"):
        raise ValueError("refused")
    if len(name) > 12:
        return []
    return [{"id": f"a:{name[0]}", "name": name, "country": name[:2], "score": 0.4, "chosen": name.endswith("A")}, {"id": f"b:{name[-1]}", "name": name.lower(), "country": None, "score": len(name) / 20}]


@query("fuz7_pluggable_matcher", """WITH x AS (SELECT DISTINCT n_name AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey), y AS (SELECT *, CASE WHEN text LIKE 'U%' THEN 'error' WHEN length(text) > 12 THEN 'none' WHEN text LIKE '%A' OR length(text) <= 8 THEN 'first' ELSE 'second' END AS k FROM x)
    SELECT text, k IN ('first', 'second') AS matched, CASE k WHEN 'first' THEN 'a:' || text[1] WHEN 'second' THEN 'b:' || text[-1] END AS id, CASE k WHEN 'first' THEN text WHEN 'second' THEN lower(text) END AS name, CASE k WHEN 'first' THEN text[1:2] END AS country,
    CASE k WHEN 'first' THEN 0.4::DOUBLE WHEN 'second' THEN length(text) / 20::DOUBLE END AS score, CASE k WHEN 'error' THEN 'ValueError: refused' END AS error FROM y""")
def fuz7(t: Tables) -> DataFrame:
    """Each distinct name asked for once, in two runs: the second goes on from the first's stored answers."""
    x = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey")).select("n_name")
    first = stored(linkage.match_affiliations(x.filter("n_name < 'K'"), "n_name", authority, wait=0.0), "matches")
    return first.filter("error is null").unionAll(linkage.match_affiliations(x, "n_name", authority, done=first, wait=0.0))


@query("str14_token_sets", """SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ('of', 'the', 'and', 'in', 'for', 'a', 'an', 'at'))))::BIGINT AS n_core,
    regexp_extract(split_part(lower(text), ',', 1), '[a-z]+') AS lead, array_to_string(list_filter(['the', 'der'], lambda c: regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || c || '([^\\p{L}\\p{N}_]|$)')), '+') AS listed FROM documents""")
def str14(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", F.size(core_tokens(x)).cast("long").alias("n_core"), leading_token(x).alias("lead"), F.array_join(listed_tokens(x, ["the", "der"]), "+").alias("listed"))


@query("jon2_ratio_by_lookup", "SELECT n_name, round(avg(c_acctbal), 4) AS mean_balance FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def jon2(t: Tables) -> DataFrame:
    return t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(r(F.avg("c_acctbal")).alias("mean_balance"))
