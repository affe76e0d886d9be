"""Queries on text, names, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.functions import text as X
from litforge.operators import extraction, ranking
from litforge.operators.topics import tokens
from litforge.plans.registry import Tables, query, rounded


@query("str1_normalize_title", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS title_md5 FROM documents")
def str1(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.normalize_title(F.col("text")).cast("binary")).alias("title_md5"))


@query("str2_normalize_doi", "SELECT page_id, nullif(regexp_replace(lower(trim(CASE WHEN page_id % 4 = 0 THEN ' ' ELSE 'https://doi.org/10.' || page_id || '/' || upper(substr(url, 1, 12)) END)), 'https?://doi\\.org/', '', 'g'), '') AS doi FROM pages")
def str2(t: Tables) -> DataFrame:
    raw = F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.concat(F.lit("https://doi.org/10."), F.col("page_id").cast("string"), F.lit("/"), F.upper(F.substring("url", 1, 12))))
    return t.pages.select("page_id", X.normalize_doi(raw).alias("doi"))


@query("str3_collapse_ws", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def str3(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.collapse_ws(F.col("text")).cast("binary")).alias("h"))


KEYWORD = """trim(regexp_replace(regexp_replace(translate(lower(trim(k)), '–—−‒‐', '-----'), '\\[[^\\]]*\\]', '', 'g'), '\\s+', ' ', 'g'), ' ,.;:/\\"''*')"""


@query("str4_flt12_normalize_keyword", f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS k FROM documents), n AS (SELECT doc_id, {KEYWORD} AS s FROM w)
    SELECT s AS keyword, count(*) AS n FROM n WHERE length(s) >= 3 AND NOT regexp_full_match(s, '[0-9]+') AND regexp_matches(s, '[a-z]') GROUP BY 1""")
def str4(t: Tables) -> DataFrame:
    """Composed (NFKC) once a distinct word; the tables are composed text, which is why SQL can do without."""
    w = t.documents.select(F.explode(F.split("text", " ")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    return w.select(X.normalize_keyword(F.col("k")).alias("keyword"), "m").filter("keyword is not null").groupBy("keyword").agg(F.sum("m").alias("n"))


def inventory_sql(langs: list[str]) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS n_{x}" for x in langs)
    return f"""WITH k AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z-]{{5,}}')) AS keyword FROM documents WHERE lang IN {str(tuple(langs))}),
    g AS (SELECT keyword, {counts}, count(*) AS total, count(DISTINCT doc_id) AS n_records FROM k GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY n_records DESC, keyword) AS rank FROM g"""


def inventory(t: Tables, langs: list[str]) -> DataFrame:
    k = t.documents.filter(F.col("lang").isin(langs)).select("doc_id", "lang", F.explode(tokens(F.col("text"), 6)).alias("keyword"))
    return ranking.keyword_inventory(k, "doc_id", "lang", "keyword", langs)


@query("agg16_keyword_inventory", inventory_sql(["de", "en", "es", "fr"]))
def agg16(t: Tables) -> DataFrame:
    """AGG16, AGG17 over all languages of the table."""
    return inventory(t, ["de", "en", "es", "fr"])


@query("flt13_source_policy", inventory_sql(["en", "fr"]))
def flt13(t: Tables) -> DataFrame:
    """FLT13: the inventory with the keywords of two sources left out by policy."""
    return inventory(t, ["en", "fr"])


@query("str5_str6_affiliations", """WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents), n AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(s), '^\\[[^\\]]*\\]\\s*', ''), '\\s+', ' ', 'g')), '\\.+$', '')) AS a FROM a)
    SELECT doc_id, count(DISTINCT a) FILTER (WHERE a <> '') AS n_affiliations FROM n GROUP BY 1""")
def str5(t: Tables) -> DataFrame:
    a = X.split_affiliations(F.lit("WoS"), F.col("text"), F.array().cast("array<string>"))
    return t.documents.select("doc_id", F.size(a).cast("long").alias("n_affiliations"))


@query("str8_str9_person_names", """WITH x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ', ' || n_name WHEN 1 THEN n_name || ' YH' WHEN 2 THEN 'Yong ' || n_name ELSE n_name END AS s, n_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey),
    p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 2 THEN regexp_extract(n_name, '[^ ]+$') WHEN 3 THEN NULL ELSE n_name END AS surname, CASE c_custkey % 4 WHEN 0 THEN substr(n_name, 1, 1) ELSE 'Y' END AS initial FROM x)
    SELECT c_custkey, surname, CASE WHEN surname IS NOT NULL THEN initial END AS initial, CASE WHEN surname IS NOT NULL THEN regexp_replace(lower(surname), '[^a-z]', '', 'g') || '_' || lower(initial) END AS fini FROM p""")
def str8(t: Tables) -> DataFrame:
    x = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    m = F.col("c_custkey") % 4
    name = F.when(m == 0, F.concat_ws(", ", "c_mktsegment", "n_name")).when(m == 1, F.concat(F.col("n_name"), F.lit(" YH"))).when(m == 2, F.concat(F.lit("Yong "), F.col("n_name"))).otherwise(F.col("n_name"))
    p = x.select("c_custkey", X.parse_person_name(name).alias("p")).select("c_custkey", "p.surname", "p.initial")
    return p.withColumn("fini", X.make_fini(F.col("surname"), F.col("initial")))


@query("str10_institution_slug", "SELECT s_suppkey, 'x_' || lower(left(n_name, 1)) || '@' || array_to_string(list_slice(list_filter(regexp_extract_all(lower('University of ' || n_name || ' and ' || r_name), '[a-z]+'), lambda w: length(w) >= 2 AND w NOT IN ('of', 'the', 'and', 'in')), 1, 5), '_') AS d2_id FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def str10(t: Tables) -> DataFrame:
    x = t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    inst = F.concat(F.lit("University of "), F.col("n_name"), F.lit(" and "), F.col("r_name"))
    return x.select("s_suppkey", X.make_d2_id(F.concat(F.lit("x_"), F.lower(F.substring("n_name", 1, 1))), inst).alias("d2_id"))


@query("str11_str12_countries", """WITH x AS (SELECT c_custkey, n_name, r_name, lower('Dept, ' || n_name || CASE c_custkey % 6 WHEN 0 THEN '; Hong Kong, China' WHEN 2 THEN '; Hong Kong' || repeat('.', c_custkey % 40) || ' China' ELSE '; Kyoto, Japan' END) AS a FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN [r_name] ELSE [] END AS s, list_sort(list_filter([CASE WHEN c_custkey % 2 = 0 AND contains(a, 'hong kong') THEN 'HK' END, CASE WHEN c_custkey % 2 = 0 AND contains(a, 'china') AND NOT contains(right(left(a, strpos(a, 'china') - 1), 30), 'hong kong') THEN 'CN' END, CASE WHEN c_custkey % 2 = 0 AND contains(a, 'japan') THEN 'JP' END], lambda v: v IS NOT NULL)) AS f FROM x),
    u AS (SELECT c_custkey, s, f, list_sort(list_distinct(list_concat(s, f))) AS b FROM c)
    SELECT c_custkey, CASE WHEN len(b) = 0 THEN 'XX' ELSE array_to_string(b, '+') END AS codes, CASE WHEN len(s) > 0 AND len(f) > 0 THEN 'structured+affiliation' WHEN len(s) > 0 THEN 'structured' WHEN len(f) > 0 THEN 'affiliation' ELSE 'reprint' END AS origin FROM u""")
def str11(t: Tables) -> DataFrame:
    x = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    empty = F.array().cast("array<string>")
    """A country counts unless the name of its region stands in the 30 characters before it; here the distance varies."""
    k = F.col("c_custkey")
    place = F.when(k % 6 == 0, "; Hong Kong, China").when(k % 6 == 2, F.concat(F.lit("; Hong Kong"), F.repeat(F.lit("."), (k % 40).cast("int")), F.lit(" China"))).otherwise("; Kyoto, Japan")
    found = X.extract_countries(F.concat(F.lit("Dept, "), F.col("n_name"), place), {"japan": "JP"}, {"hong kong": "HK", "taiwan": "TW"})
    chain = X.country_chain(F.when(F.col("c_custkey") % 5 == 0, F.array("r_name")).otherwise(empty), F.when(F.col("c_custkey") % 2 == 0, found).otherwise(empty), F.array(F.lit("XX")))
    return x.select("c_custkey", chain.alias("c")).select("c_custkey", F.array_join("c.codes", "+").alias("codes"), "c.origin")


@query("str13_regex_rules", "SELECT CASE WHEN regexp_matches(p_type, '(?i)^eco') THEN 'economy' WHEN regexp_matches(p_type, '(?i)o') THEN 'with_o' END AS rule, count(*) AS n FROM part GROUP BY 1")
def str13(t: Tables) -> DataFrame:
    return t.part.groupBy(X.first_rule_match(F.col("p_type"), [("^eco", "economy"), ("o", "with_o")]).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("str15_split_entities", """WITH s AS (SELECT c_custkey, unnest(regexp_split_to_array(c_mktsegment || ' and (' || n_name || ') / ' || c_mktsegment, '\\s*(?:[,;/+]|\\band\\b|\\bor\\b)\\s*')) AS e FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT c_custkey, count(DISTINCT trim(regexp_replace(lower(e), '[\\[\\](){}"'']', '', 'g'))) FILTER (WHERE trim(e) <> '') AS n_entities FROM s GROUP BY 1""")
def str15(t: Tables) -> DataFrame:
    x = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    text = F.concat(F.col("c_mktsegment"), F.lit(" and ("), F.col("n_name"), F.lit(") / "), F.col("c_mktsegment"))
    return x.select("c_custkey", F.size(X.split_entities(text)).cast("long").alias("n_entities"))


@query("str18_null_if_in", "SELECT CASE WHEN lower(trim(v)) IN ('unknown', 'nan', '', 'f') THEN NULL ELSE v END AS v, count(*) AS n FROM (SELECT o_orderstatus AS v FROM orders) GROUP BY 1")
def str18(t: Tables) -> DataFrame:
    return t.orders.groupBy(X.null_if_in(F.col("o_orderstatus"), ("unknown", "nan", "", "f")).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("str19_clean_text", "SELECT page_id, md5(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\b\\d+\\b', ' ', 'g'), '[^A-Za-z\\-]+', ' ', 'g')), '\\s+', ' ', 'g'))) AS h FROM pages")
def str19(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.clean_text(F.col("html")).cast("binary")).alias("h"))


@query("str20_strip_fence", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def str20(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return t.events.select("event_id", F.get_json_object(X.strip_fence(fenced), "$.k").cast("long").alias("k"))


@query("str21_smart_truncate", """WITH w AS (SELECT doc_id, lang, string_split_regex(trim(text), '\\s+') AS w FROM documents), x AS (SELECT doc_id, lang, w, 64 - 1 AS room FROM w)
    SELECT doc_id, (CASE WHEN len(w) <= room THEN len(w) ELSE room END + 1)::BIGINT AS n_words, w[1] AS first, CASE WHEN len(w) <= room OR room - floor(room * 0.75) > 0 THEN w[len(w)] ELSE w[floor(room * 0.75)::INT] END AS last FROM x""")
def str21(t: Tables) -> DataFrame:
    out = F.split(X.smart_truncate(F.col("lang"), F.col("text"), 64), r"\s+")
    words = F.filter(out, lambda w: w != "")
    return t.documents.select("doc_id", F.size(words).cast("long").alias("n_words"), F.element_at(words, 2).alias("first"), F.element_at(words, -1).alias("last"))


@query("str22_token_estimate", "SELECT doc_id, floor(len(regexp_extract_all(text, '\\S+')) * 1.3)::BIGINT AS n_tokens FROM documents")
def str22(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.n_tokens_estimate(F.col("text")).cast("long").alias("n_tokens"))


@query("str23_template", "SELECT c_custkey, 'Name: ' || c_name || ' (' || c_mktsegment || ')' AS prompt FROM customer")
def str23(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.fill_template("Name: {{name}} ({{seg}})", name=F.col("c_name"), seg=F.col("c_mktsegment")).alias("prompt"))


@query("per2_year_of_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate)::BIGINT END AS year FROM orders")
def per2(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Spring 1999")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" Jan-Feb")))
    return t.orders.select("o_orderkey", X.year_of_text(text).cast("long").alias("year"))


@query("arr1_inverted_index", "SELECT doc_id, array_to_string(string_split_regex(trim(text), '\\s+'), ' ') AS words FROM documents")
def arr1(t: Tables) -> DataFrame:
    """Each text becomes a map word -> positions and is put together again."""
    m = X.inverted_index(F.split(F.trim("text"), r"\s+"))
    return t.documents.select("doc_id", X.inverted_index_text(m).alias("words"))


@query("arr2_arr3_lists", "SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')))::BIGINT AS n_lines FROM documents")
def arr2(t: Tables) -> DataFrame:
    """ARR2, ARR3, ARR4"""
    return t.documents.select("doc_id", F.size(F.array_distinct(X.split_clean(F.col("text"), "\n"))).cast("long").alias("n_lines"))


@query("arr5_item_pairs", "SELECT x.o_orderpriority AS a, y.o_orderpriority AS b, count(DISTINCT x.o_custkey) AS n FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderpriority < y.o_orderpriority GROUP BY 1, 2")
def arr5(t: Tables) -> DataFrame:
    return ranking.pair_counts(t.orders, "o_custkey", "o_orderpriority")


@query("jsn1_validate_json", "SELECT event_id % 3 = 0 AS valid, count(*) AS n FROM events GROUP BY 1")
def jsn1(t: Tables) -> DataFrame:
    """A third of the objects has the one known field; the others have one more, or none."""
    schema = T.StructType([T.StructField("k", T.LongType())])
    m = F.col("event_id") % 3
    raw = F.when(m == 0, F.col("props")).when(m == 1, F.replace(F.col("props"), F.lit("{"), F.lit('{"x": 1, '))).otherwise(F.lit("{}"))
    out = extraction.validate_json(t.events.select(raw.alias("raw")), "raw", schema)
    return out.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


@query("jsn3_src10_flatten", "SELECT conv_id AS record_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS idx, role FROM conversations")
def jsn3(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy(F.col("conv_id").alias("record_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.md5(F.col("text").cast("binary")).alias("h")))).alias("items"))
    text = turns.select("record_id", F.to_json("items").alias("j")).select("record_id", F.from_json("j", "array<struct<turn: long, role: string, h: string>>").alias("items"))
    return text.select("record_id", F.posexplode("items").alias("idx", "i")).select("record_id", F.col("idx").cast("long").alias("idx"), "i.role")


@query("agg33_keyword_counts", "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z-]{2,}')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word NOT IN ('the', 'and', 'for') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def agg33(t: Tables) -> DataFrame:
    w = t.documents.select(F.explode(tokens(F.col("text"), 3, ("the", "and", "for"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(30)


@query("flt7_min_length_not_review", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 100 AND NOT regexp_matches(source, '(?i)src1[0-9]')")
def flt7(t: Tables) -> DataFrame:
    return t.documents.filter((F.length(F.trim("text")) >= 100) & ~F.col("source").rlike("(?i)src1[0-9]")).select("doc_id")


@query("mth7_cost", "SELECT conv_id, round(sum(length(text)) / 1e6 * 0.15 + count(*) / 1e6 * 0.6, 6) AS cost FROM conversations GROUP BY 1")
def mth7(t: Tables) -> DataFrame:
    c = t.conversations.groupBy("conv_id").agg(F.sum(F.length("text")).alias("i"), F.count(F.lit(1)).alias("o"))
    return rounded(c.select("conv_id", extraction.cost(F.col("i"), F.col("o"), 0.15, 0.6).alias("cost")), 6)
