"""Queries that write tables in each source's format and read them back, sinks, and the streaming extension. Files go to the shared folder."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.functions import text as X
from litforge.operators import extraction
from litforge.plans.registry import Tables, query
from litforge.scratch import folder
from litforge.sources import records as R
from litforge.sources import sinks
from litforge.streaming import incremental


def words(t: Tables) -> DataFrame:
    """(id, title): all words of each document, on one line."""
    return t.documents.select(F.col("doc_id").alias("id"), F.array_join(F.split(F.trim("text"), r"\s+"), " ").alias("title"), "lang", "source")


TITLE = "array_to_string(string_split_regex(trim(text), '\\s+'), ' ')"


def tagged_export(t: Tables) -> str:
    path = folder(t.spark, "tagged")
    text = F.concat_ws("\n", F.lit("PT J"), F.concat(F.lit("AU Smith, J\n   Doe, A"), F.col("id").cast("string")), F.concat(F.lit("TI "), F.col("title")), F.concat(F.lit("UT "), F.col("id").cast("string")), F.lit("DT Article; Review"), F.lit("PY 20x1"), F.lit("XX kept"), F.lit("ER\n"))
    words(t).filter("title <> ''").select(text).write.text(path)
    return path


@query("src1_src2_tagged_scan", f"SELECT 'WoS:' || doc_id AS record_id, {TITLE} AS title, 2::BIGINT AS n_authors, 'Smith' AS first_author_lastname, 'Review' AS doc_type, NULL::BIGINT AS year FROM documents WHERE trim(text) <> ''")
def src1(t: Tables) -> DataFrame:
    """SRC1, SRC2, SRC6, SRC12: documents as a tagged export, parsed and unified."""
    u = R.from_tagged(R.read_tagged(t.spark, tagged_export(t)))
    return u.select("record_id", "title", F.size("authors").cast("long").alias("n_authors"), "first_author_lastname", "doc_type", "year")


def csv_export(t: Tables) -> str:
    path = folder(t.spark, "csv")
    x = words(t)
    row = [F.lit("https://doi.org/10.1/A").alias("DOI"), F.lit("2001").alias("Year"), F.lit("Liu K.; Xu Z.").alias("Authors"), F.concat(F.lit("x "), "title").alias("Title"), F.lit("[No abstract available]").alias("Abstract"), F.lit("J\nB").alias("Source title"), F.col("lang").alias("Language of Original Document"), F.col("id").cast("string").alias("EID"), F.lit("Article").alias("Document Type"), F.lit("7").alias("Cited by"), F.lit("a; b; c").alias("References"), F.lit("k1; k2").alias("Author Keywords")]
    x.select(*row).write.csv(path, header=True, escape='"', quoteAll=True)
    return path


@query("src3_csv_scan", f"SELECT 'Scopus:' || doc_id AS record_id, '10.1/a' AS doi, trim('x ' || {TITLE}) AS title, '' AS abstract, 'Liu' AS first_author_lastname, lang AS language, 7::BIGINT AS cited_by, 3::BIGINT AS references_count, 2001::BIGINT AS year FROM documents")
def src3(t: Tables) -> DataFrame:
    u = R.from_scopus(R.read_csv_records(t.spark, csv_export(t)))
    return u.select("record_id", "doi", "title", "abstract", "first_author_lastname", "language", "cited_by", "references_count", "year")


def works_export(t: Tables) -> str:
    path = folder(t.spark, "works")
    x = words(t).filter("title <> ''").select("id", "lang", X.inverted_index(F.split("title", " ")).alias("abstract_inverted_index"))
    author = F.array(F.struct(F.struct(F.lit("Ann Lee").alias("display_name")).alias("author"), F.array(F.struct(F.lit("U").alias("display_name"), F.lit("CN").alias("country_code"))).alias("institutions")))
    good = x.select(F.to_json(F.struct(F.concat(F.lit("https://openalex.org/W"), F.col("id").cast("string")).alias("id"), F.lit("T").alias("title"), F.lit("journal-article").alias("type"), "abstract_inverted_index", author.alias("authorships"))).alias("value"))
    good.unionAll(t.spark.createDataFrame([("{broken",), ("",)], "value string")).write.text(path)
    return path


@query("src4_nested_jsonl_scan", f"SELECT 'OpenAlex:W' || doc_id AS record_id, {TITLE} AS abstract, 'Lee' AS first_author_lastname, 'Article' AS doc_type, 1::BIGINT AS n_institutions FROM documents WHERE trim(text) <> ''")
def src4(t: Tables) -> DataFrame:
    u = R.from_works(R.read_jsonl(t.spark, works_export(t), R.WORKS))
    return u.select("record_id", "abstract", "first_author_lastname", "doc_type", F.size("institutions_list").cast("long").alias("n_institutions"))


@query("src5_flat_jsonl_scan", f"SELECT 'PubMed:' || doc_id AS record_id, {TITLE} AS title, 'Review' AS doc_type, lang AS language, 1::BIGINT AS n_mesh FROM documents")
def src5(t: Tables) -> DataFrame:
    path = folder(t.spark, "pubmed")
    row = F.struct(F.col("id").cast("string").alias("pmid"), "title", F.array("lang").alias("language"), F.array(F.lit("Journal Article"), F.lit("Review")).alias("publication_types"), F.array(F.lit("M")).alias("mesh_terms"), F.array(F.lit("Smith J")).alias("authors"))
    words(t).select(F.to_json(row).alias("value")).write.text(path)
    u = R.from_pubmed(R.read_jsonl(t.spark, path, R.PUBMED))
    return u.select("record_id", "title", "doc_type", "language", F.size("mesh_terms").cast("long").alias("n_mesh"))


@query("set1_prj1_unified_sources", "SELECT 'WoS' AS source_db, count(*) FILTER (WHERE trim(text) <> '') AS n FROM documents UNION ALL SELECT 'Scopus', count(*) FROM documents")
def unified(t: Tables) -> DataFrame:
    u = R.unify(R.from_tagged(R.read_tagged(t.spark, tagged_export(t))), R.from_scopus(R.read_csv_records(t.spark, csv_export(t))))
    return u.groupBy("source_db").agg(F.count(F.lit(1)).alias("n"))


def service(t: Tables) -> tuple[str, DataFrame]:
    """A stand-in for a service: the customers as stored pages of JSON lines, for each market segment and, overlapping with these, each region; and the table of its pages (query, page)."""
    path = folder(t.spark, "service")
    c = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    names = F.explode(F.array(F.concat(F.lit("segment-"), "c_mktsegment"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"))))
    value = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    x = c.select(names.alias("query"), F.floor(F.col("c_custkey") / 1000).cast("int").alias("page"), value.alias("value"))
    x.repartition("query", "page").write.partitionBy("query", "page").text(path)
    return path, x.select("query", "page").distinct()


def stored_page(path: str, query: str, page: int) -> list[str]:
    """What the service answers: the lines of one page, none for a page that it hasn't got."""
    fs, root = pafs.FileSystem.from_uri(path)
    files = fs.get_file_info(pafs.FileSelector(f"{root}/query={query}/page={page}", allow_not_found=True))
    return [x for f in files if f.base_name.startswith("part-") for x in fs.open_input_stream(f.path).read().decode().splitlines()]


@query("src7_paged_pull", "SELECT DISTINCT c_custkey AS key FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)")
def src7(t: Tables) -> DataFrame:
    """SRC7: overlapping queries of stored pages; works met twice come once."""
    path, pages = service(t)
    return R.read_pages(t.spark, pages, lambda q, p: stored_page(path, q, p)).select(F.col("key").cast("long").alias("key"))


@query("src7_cursor_pull", "SELECT DISTINCT c_custkey AS key FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (SELECT n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(*) <= (SELECT count(*) FROM customer) / 5)")
def src7_cursor(t: Tables) -> DataFrame:
    """SRC7: the regions' queries read by cursor; those that find more than a fifth of all customers are too broad and skipped."""
    path, pages = service(t)
    last = dict(pages.filter("query like 'region-%'").groupBy("query").agg(F.max("page")).collect())  # a row a region
    count = lambda q: sum(len(stored_page(path, q, p)) for p in range(last[q] + 1))
    page = lambda q, cursor, size: (stored_page(path, q, cursor or 0), (cursor or 0) + 1 if (cursor or 0) < last[q] else None)
    works, _ = R.pull(t.spark, sorted(last), count, page, most=t.customer.count() // 5)
    return works.select(F.col("key").cast("long").alias("key"))


@query("src8_medline_xml", "SELECT n_nationkey::VARCHAR AS pmid, n_name AS title, (1990 + n_nationkey)::BIGINT AS year, 'Doe J' AS author FROM nation")
def src8(t: Tables) -> DataFrame:
    xml = F.format_string("<PubmedArticle><PMID>%d</PMID><Article><ArticleTitle>%s</ArticleTitle><Journal><JournalIssue><PubDate><MedlineDate>%d Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>Doe</LastName><Initials>J</Initials></Author></AuthorList></Article></PubmedArticle>", "n_nationkey", "n_name", F.col("n_nationkey") + 1990)
    return R.from_medline_xml(t.nation.select(xml.alias("xml"))).select("pmid", "title", "year", F.get("authors", 0).alias("author"))


@query("src9_snk1_parquet", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def src9(t: Tables) -> DataFrame:
    path = folder(t.spark, "parquet")
    sinks.write_parquet(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), path, "o_orderstatus")
    return t.spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("src10_results_jsonl", "SELECT conv_id::VARCHAR AS record_id, count(*) AS n_interactions FROM conversations GROUP BY 1")
def src10(t: Tables) -> DataFrame:
    """SRC10, SNK8: results appended as JSON lines in two rounds, the second of which skips what is done; bad lines are left out on reading."""
    path = folder(t.spark, "results")
    x = t.conversations.groupBy(F.col("conv_id").cast("string").alias("record_id")).agg(F.struct(F.lit(True).alias("contains_hdi"), F.collect_list(F.struct(F.col("role").alias("drug_name"), F.col("text").alias("evidence_quote"))).alias("interactions")).alias("extraction"))
    sinks.append_jsonl(x.filter("crc32(record_id) % 2 = 0"), path, "record_id")
    sinks.append_jsonl(x, path, "record_id")
    rows = extraction.record_rows(R.read_jsonl(t.spark, path, extraction.RESULT))
    return rows.select("record_id", F.col("n_interactions").cast("long").alias("n_interactions"))


@query("src11_snk2_delimited", "SELECT r_name AS alias, lower(r_name) AS canonical FROM region")
def src11(t: Tables) -> DataFrame:
    path = folder(t.spark, "lookup")
    sinks.write_csv(t.region.select(F.col("r_name").alias("alias"), F.lower("r_name").alias("canonical")), path)
    return R.read_lookup(t.spark, path).select("alias", "canonical")


@query("src14_file_inventory", "SELECT 'WoS' AS database, count(*) FILTER (WHERE trim(text) <> '') AS records FROM documents")
def src14(t: Tables) -> DataFrame:
    inv = R.file_inventory(t.spark, {"WoS": (tagged_export(t), "tagged")})
    return inv.groupBy("database").agg(F.sum("record_count").alias("records"))


@query("snk3_summary_json", "SELECT '{\"n\":' || count(*) || ',\"n_texts\":' || count(DISTINCT text) || '}' AS value FROM documents")
def snk3(t: Tables) -> DataFrame:
    return sinks.summary_json(t.documents.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_texts")))


@query("snk4_vos_files", "SELECT 'map' AS part, count(*) + 1 AS lines FROM nation UNION ALL SELECT 'network', count(*) FROM nation WHERE n_nationkey > 0")
def snk4(t: Tables) -> DataFrame:
    path = folder(t.spark, "vos")
    nodes = t.nation.select(F.col("n_name").alias("node"), (F.col("n_nationkey") + 10).cast("long").alias("n"))
    edges = t.nation.filter("n_nationkey > 0").select(F.col("n_name").alias("a"), F.lit(5).cast("long").alias("n")).crossJoin(t.nation.filter("n_nationkey = 0").select(F.col("n_name").alias("b")))
    sinks.write_vos(*sinks.vos_tables(nodes, edges, 10, 3), path)
    lines = lambda p: t.spark.read.text(f"{path}/{p}").agg(F.count(F.lit(1)).alias("lines")).select(F.lit(p).alias("part"), "lines")
    return lines("map").unionAll(lines("network"))


@query("snk5_graphml", "SELECT 'node' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'edge', count(*) FROM supplier")
def snk5(t: Tables) -> DataFrame:
    path = folder(t.spark, "graphml")
    edges = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"))
    sinks.write_graphml(t.nation.select(F.col("n_name").alias("node_id"), F.col("n_regionkey").alias("group")), edges, path)
    lines = t.spark.read.text(path)
    kind = F.when(F.col("value").startswith("<node"), "node").when(F.col("value").startswith("<edge"), "edge")
    return lines.select(kind.alias("kind")).filter("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("snk5_graphml_one_file", """SELECT '<node id="' || doc_id || '"><data key="n_lang">' || lang || '</data><data key="n_n_chars">' || n_chars || '</data></node>' AS line FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL
    UNION ALL SELECT '<edge source="' || doc_id || '" target="' || replace(replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"></edge>' FROM documents WHERE source IS NOT NULL""")
def snk5_one(t: Tables) -> DataFrame:
    """SNK5: documents and their sources as one GraphML file that many tasks write; its lines of nodes and edges are read back."""
    path = folder(t.spark, "graphml") + "/graph.graphml"
    d = t.documents
    nodes = d.filter("lang is not null and n_chars is not null").select(F.col("doc_id").alias("node_id"), "lang", "n_chars")
    sinks.write_graphml_file(nodes, d.filter("source is not null").select(F.col("doc_id").alias("src"), F.col("source").alias("dst")), path)
    return t.spark.read.text(path).select(F.col("value").alias("line")).filter("line like '<node %' or line like '<edge %'")


@query("snk4_vos_one_file", """WITH s AS (SELECT source AS label, count(*) AS weight FROM documents WHERE source IS NOT NULL GROUP BY 1), i AS (SELECT row_number() OVER (ORDER BY weight DESC, label) AS id, * FROM s),
    p AS (SELECT DISTINCT source, lang FROM documents), e AS (SELECT a.source AS a, b.source AS b, count(*) AS n FROM p a JOIN p b ON a.lang = b.lang AND a.source < b.source GROUP BY 1, 2)
    SELECT 'map' AS part, 'id	label	weight' AS line UNION ALL SELECT 'map', id || '	' || label || '	' || weight FROM i
    UNION ALL SELECT 'network', x.id || '	' || y.id || '	' || n FROM e JOIN i x ON x.label = a JOIN i y ON y.label = b""")
def snk4_one(t: Tables) -> DataFrame:
    """SNK4: sources, linked by the languages they share, as one map and one network file."""
    path = folder(t.spark, "vos")
    p = t.documents.select("source", "lang").distinct()
    a, b = p.select(F.col("source").alias("a"), "lang"), p.select(F.col("source").alias("b"), "lang")
    edges = a.join(b, "lang").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    nodes = t.documents.filter("source is not null").groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_vos_files(*sinks.vos_tables(nodes, edges, 1, 1), path)
    lines = lambda name: t.spark.read.text(f"{path}/{name}.txt").select(F.lit(name).alias("part"), F.col("value").alias("line"))
    return lines("map").unionAll(lines("network"))


@query("snk6_markdown_report", "SELECT 4::BIGINT + count(*) AS n_lines FROM region")
def snk6(t: Tables) -> DataFrame:
    text = sinks.markdown_table(t.region.orderBy("r_regionkey"), "Regions")
    return t.spark.createDataFrame([(len(text.rstrip("\n").split("\n")),)], "n_lines long")


@query("snk7_rewrite_to_new_path", "SELECT doc_id FROM documents WHERE lang = 'en'")
def snk7(t: Tables) -> DataFrame:
    a, b = folder(t.spark, "before"), folder(t.spark, "after")
    sinks.write_parquet(t.documents.select("doc_id", "lang"), a)
    sinks.write_parquet(t.spark.read.parquet(a).filter("lang = 'en'"), b)
    return t.spark.read.parquet(b).select("doc_id")


@query("str_first_seen_resume", "SELECT DISTINCT user_id, event_type FROM events")
def resume(t: Tables) -> DataFrame:
    """§2.11: two runs over a growing folder; the second takes up what came since, and keys come once."""
    src, out, mark = (folder(t.spark, x) for x in ("stream-in", "stream-out", "stream-mark"))
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(src)
        incremental.run_available(incremental.first_seen(incremental.file_stream(t.spark, src, e.schema), ["user_id", "event_type"], "ts", "400 days"), out, mark)
    return t.spark.read.parquet(out).select("user_id", "event_type")


@query("str_window_counts", "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2")
def windows(t: Tables) -> DataFrame:
    """Daily counts as a stream; the last day stays open until the watermark passes it."""
    src, out, mark = (folder(t.spark, x) for x in ("stream-in", "stream-out", "stream-mark"))
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.write.parquet(src)
    incremental.run_available(incremental.window_counts(incremental.file_stream(t.spark, src, e.schema), "ts", "1 day", "0 seconds", "event_type"), out, mark)
    return t.spark.read.parquet(out).select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")
