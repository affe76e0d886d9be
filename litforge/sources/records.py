"""Readers of bibliographic exports, each to the unified record. All mapping is by column expressions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litforge.functions.text import collapse_ws, inverted_index_text, normalize_doi, normalize_title, split_clean
from litforge.scratch import stored

S, I, A = T.StringType(), T.LongType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


INSTITUTIONS = T.ArrayType(_struct(name=S, country_code=S, ror_id=S, type=S))
UNIFIED = _struct(
    record_id=S, source_db=S, source_id=S, doi=S, title=S, title_normalized=S, year=I, first_author_lastname=S, authors=A, journal=S, abstract=S, doc_type=S, language=S, cited_by=I, references_count=I,
    author_keywords=A, keywords_plus=A, mesh_terms=A, openalex_concepts=A, affiliations_raw=S, reprint_address=S, institutions_list=INSTITUTIONS,
)
#: Field tags of the tagged export.
TAGS = {
    "PT": "publication_type", "AU": "authors_short", "AF": "authors_full", "TI": "title", "SO": "journal", "AB": "abstract", "DE": "author_keywords", "ID": "keywords_plus", "DI": "doi", "PY": "year", "UT": "wos_uid", "DT": "doc_type",
    "LA": "language", "TC": "times_cited", "NR": "references_count", "CR": "cited_references", "C1": "affiliations_raw", "RP": "reprint_address", "FU": "funding", "JI": "journal_iso_abbr", "SN": "issn", "EI": "eissn", "VL": "volume",
    "IS": "issue", "BP": "beginning_page", "EP": "ending_page",
}
_INST = _struct(display_name=S, country_code=S, ror=S, type=S)
WORKS = _struct(
    id=S, doi=S, title=S, display_name=S, publication_year=I, type=S, language=S, cited_by_count=I, referenced_works=A, concepts=T.ArrayType(_struct(display_name=S)),
    authorships=T.ArrayType(_struct(author=_struct(display_name=S), institutions=T.ArrayType(_INST))), primary_location=_struct(source=_struct(display_name=S)),
    abstract_inverted_index=T.MapType(S, T.ArrayType(T.IntegerType())),
)
PUBMED = _struct(pmid=S, title=S, year=I, journal=S, abstract=S, authors=A, mesh_terms=A, doi=S, language=A, publication_types=A)
SCOPUS_COLUMNS = ["DOI", "Year", "Authors", "Title", "Abstract", "Source title", "Language of Original Document", "EID", "Document Type", "Cited by", "References", "Author Keywords", "Index Keywords", "Affiliations", "Correspondence Address"]


def read_tagged(spark: SparkSession, path: str | list[str], tags: dict[str, str] | None = None) -> DataFrame:
    """SRC1, SRC6, SRC12: one row a record with a map field -> text and its file; unknown tags are kept as ``wos_XX``. Lines that continue a field are joined by line breaks; the file head and end are dropped."""
    names = F.create_map(*[F.lit(x) for kv in (tags or TAGS).items() for x in kv])
    blocks = spark.read.text(path, lineSep="\nER").select(F.regexp_replace("value", "[\r\ufeff]", "").alias("b"), F.col("_metadata.file_path").alias("file"))
    fields = F.filter(F.split(F.regexp_replace("b", r"^\s+", ""), r"\n(?=[A-Z][A-Z0-9] )"), lambda f: f.rlike(r"^[A-Z][A-Z0-9] ") & ~F.substring(f, 1, 3).isin("FN ", "VR ", "EF "))
    name = lambda f: F.coalesce(F.try_element_at(names, F.substring(f, 1, 2)), F.concat(F.lit("wos_"), F.substring(f, 1, 2)))
    value = lambda f: F.array_join(F.transform(F.split(F.regexp_replace(f, r"^.{3}", ""), "\n"), lambda x: F.trim(x)), "\n")
    entries = F.transform(fields, lambda f: F.struct(name(f).alias("key"), value(f).alias("value")))
    # a tag that comes twice: the last one holds, as map_from_entries would refuse it
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    return blocks.filter(F.size(fields) > 0).select(F.map_from_entries(last).alias("fields"), "file")


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _digits(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c)).cast("long")


def _kind(raw: Column, other: Column) -> Column:
    """Review beats article."""
    low = F.lower(raw)
    return F.when(low.contains("article") & ~low.contains("review"), "Article").when(low.contains("review"), "Review").otherwise(F.when(raw == "", "Unknown").otherwise(other))


def _unified(df: DataFrame, source: str, columns: dict[str, Column]) -> DataFrame:
    out = df.select(*[c.alias(k) for k, c in columns.items()]).withColumn("source_db", F.lit(source))
    out = out.withColumns({"record_id": F.concat(F.lit(f"{source}:"), "source_id"), "title_normalized": normalize_title(F.col("title"))})
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in UNIFIED])


def from_tagged(rows: DataFrame) -> DataFrame:
    """SRC2"""
    f = lambda n: F.try_element_at(F.col("fields"), F.lit(n))
    flat = lambda n: collapse_ws(F.translate(_text(f(n)), "\n", " "))
    authors = split_clean(f("authors_short"), "\n")
    words = lambda n: split_clean(F.translate(f(n), "\n", ";"), ";")
    return _unified(rows, "WoS", {
        "source_id": _text(f("wos_uid")), "doi": normalize_doi(f("doi")), "title": flat("title"), "year": _digits(f("year")), "authors": authors,
        "first_author_lastname": F.trim(F.substring_index(F.coalesce(F.get(authors, 0), F.lit("")), ",", 1)), "journal": F.trim(F.translate(_text(f("journal")), "\n", " ")), "abstract": flat("abstract"),
        "author_keywords": words("author_keywords"), "keywords_plus": words("keywords_plus"), "doc_type": _kind(_text(f("doc_type")), _text(f("doc_type"))), "language": _text(f("language")),
        "cited_by": _digits(f("times_cited")), "references_count": _digits(f("references_count")), "affiliations_raw": _text(f("affiliations_raw")), "reprint_address": _text(f("reprint_address")),
        "institutions_list": F.array(),
    })


def read_csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC3: CSV with quoted line breaks, all columns as text by name."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in SCOPUS_COLUMNS])


def from_scopus(rows: DataFrame) -> DataFrame:
    """SRC3: here an article beats a review, as the source's own rule has it."""
    c = lambda n: F.when(_text(F.col(f"`{n}`")) == "nan", "").otherwise(_text(F.col(f"`{n}`")))
    authors = F.when(c("Authors").contains(";"), split_clean(c("Authors"), ";")).otherwise(split_clean(c("Authors"), ","))
    kind = c("Document Type")
    number = lambda n: F.when(c(n).rlike(r"^\d+(\.0*)?$"), F.substring_index(c(n), ".", 1)).cast("long")
    refs = c("References")
    return _unified(rows, "Scopus", {
        "source_id": c("EID"), "doi": normalize_doi(c("DOI")), "title": c("Title"), "year": number("Year"), "authors": authors,
        "first_author_lastname": F.coalesce(F.get(F.split(F.get(authors, 0), r"\s+"), 0), F.lit("")), "journal": c("Source title"),
        "abstract": F.when(c("Abstract") == "[No abstract available]", "").otherwise(c("Abstract")), "author_keywords": split_clean(c("Author Keywords"), ";"), "keywords_plus": split_clean(c("Index Keywords"), ";"),
        "doc_type": F.when(kind.contains("Article"), "Article").when(kind.contains("Review"), "Review").when(kind == "", "Unknown").otherwise(kind), "language": c("Language of Original Document"), "cited_by": number("Cited by"),
        "references_count": F.when(refs != "", F.length(refs) - F.length(F.replace(refs, F.lit(";"), F.lit(""))) + 1), "affiliations_raw": c("Affiliations"), "reprint_address": c("Correspondence Address"), "institutions_list": F.array(),
    })


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """SRC4, SRC5, SRC10: one object a line by a given schema; lines that are no JSON are skipped."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", S)])
    # kept columns must be read with the corrupt one, so it is tested on the parsed text
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.filter("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def from_works(rows: DataFrame) -> DataFrame:
    """SRC4"""
    none = F.array().cast(A)
    authors = F.filter(F.coalesce(F.transform("authorships", lambda a: a["author"]["display_name"]), none), lambda x: F.coalesce(x != "", F.lit(False)))
    kind = _text(F.col("type"))
    institutions = F.flatten(F.transform(F.coalesce("authorships", F.array().cast(WORKS["authorships"].dataType)), lambda a: F.coalesce(a["institutions"], F.array().cast(T.ArrayType(_INST)))))
    named = F.filter(F.transform(institutions, lambda i: F.struct(i["display_name"].alias("name"), i["country_code"].alias("country_code"), i["ror"].alias("ror_id"), i["type"].alias("type"))), lambda i: F.coalesce(i["name"] != "", F.lit(False)))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("display_name"))
    return _unified(rows, "OpenAlex", {
        "source_id": F.replace(_text(F.col("id")), F.lit("https://openalex.org/"), F.lit("")), "doi": normalize_doi(F.col("doi")), "title": _text(title), "year": F.col("publication_year"), "authors": authors,
        "first_author_lastname": F.coalesce(F.try_element_at(F.split(F.trim(F.get(authors, 0)), r"\s+"), F.lit(-1)), F.lit("")), "journal": _text(F.col("primary_location.source.display_name")),
        "abstract": inverted_index_text(F.col("abstract_inverted_index")), "author_keywords": F.array(), "keywords_plus": F.array(), "doc_type": _kind(kind, F.initcap(kind)), "language": _text(F.col("language")),
        "cited_by": F.col("cited_by_count"), "references_count": F.when(F.size("referenced_works") > 0, F.size("referenced_works")),
        "openalex_concepts": F.filter(F.coalesce(F.transform("concepts", lambda x: x["display_name"]), none), lambda x: F.coalesce(x != "", F.lit(False))), "affiliations_raw": F.lit(""), "reprint_address": F.lit(""), "institutions_list": named,
    })


def from_pubmed(rows: DataFrame) -> DataFrame:
    """SRC5"""
    none = F.array().cast(A)
    kinds = F.coalesce("publication_types", none)
    has = lambda w: F.exists(kinds, lambda k: F.lower(k).contains(w))
    return _unified(rows, "PubMed", {
        "source_id": _text(F.col("pmid")), "doi": F.nullif(F.lower(_text(F.col("doi"))), F.lit("")), "title": _text(F.col("title")), "year": F.col("year"), "authors": F.coalesce("authors", none),
        "first_author_lastname": F.coalesce(F.get(F.split(F.trim(F.get("authors", 0)), r"\s+"), 0), F.lit("")), "journal": _text(F.col("journal")), "abstract": _text(F.col("abstract")), "author_keywords": F.array(),
        "keywords_plus": F.array(), "doc_type": F.when(has("review"), "Review").when(has("journal article"), "Article").otherwise(F.coalesce(F.get(kinds, 0), F.lit("Unknown"))),
        "language": F.coalesce(F.get("language", 0), F.lit("")), "mesh_terms": F.coalesce("mesh_terms", none), "affiliations_raw": F.lit(""), "reprint_address": F.lit(""), "institutions_list": F.array(),
    })


def unify(*frames: DataFrame) -> DataFrame:
    """SET1, PRJ1: sources one below the other, the unified columns first, any others after them."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    first = [c for c in UNIFIED.fieldNames() if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


def file_inventory(spark: SparkSession, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """SRC14: per file its database, batch and record range from the name, records, and size. paths: database -> (path, format: tagged, csv or jsonl)."""
    out = []
    for database, (path, kind) in paths.items():
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        count = {"tagged": F.count_if(F.col("value").startswith("PT ")), "jsonl": F.count_if(F.trim("value") != ""), "csv": F.count(F.lit(1)) - 1}[kind]
        if kind == "csv":
            rows = spark.read.csv(path, header=True, multiLine=True, escape='"').select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("record_count"))
            sized = lines.groupBy("file").agg(F.max("size").alias("size")).join(rows, "file", "left")
        else:
            sized = lines.groupBy("file").agg(F.max("size").alias("size"), count.alias("record_count"))
        name = F.substring_index("file", "/", -1)
        number = lambda p, g, name=name: F.nullif(F.regexp_extract(name, p, g), F.lit("")).cast("long")
        out.append(sized.select(
            F.lit(database).alias("database"), name.alias("file_name"), number(r"batch_(\d+)", 1).alias("batch"), number(r"(\d+)-(\d+)\.\w+$", 1).alias("range_start"), number(r"(\d+)-(\d+)\.\w+$", 2).alias("range_end"),
            F.coalesce("record_count", F.lit(0)).cast("long").alias("record_count"), F.bround(F.col("size") / 1048576, 2).alias("size_mb"), F.lit(kind).alias("format"),
        ))
    return unify(*out) if len(out) > 1 else out[0]


def read_lookup(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """SRC11"""
    return spark.read.csv(path, header=True, sep=sep)


def read_pages(spark: SparkSession, query_pages: DataFrame, fetch: object, key: str = "id") -> DataFrame:
    """SRC7, SRC8: a pull over pages of a service: each row (query, page) is fetched by a function that returns JSON texts; works met by several queries come once."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(q, x) for q, p in zip(pdf["query"], pdf["page"], strict=True) for x in fetch(q, p)], columns=["query", "value"])

    got = query_pages.repartition("query", "page").mapInPandas(run, "query string, value string")
    return got.withColumn("key", F.get_json_object("value", f"$.{key}")).groupBy("key").agg(F.min(F.struct("query", "value")).alias("r")).select("key", "r.value")


def pull(spark: SparkSession, queries: Sequence[str], count: Callable[[str], int], page: Callable[..., tuple], key: str = "id", most: int = 80_000, size: int = 200, retries: int = 4, wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """SRC7, SRC8: a pull by cursor: (key, value) of the works, those met by several queries once, and a report (query, found, pulled, status).

    ``count(query)`` tells how many works there are; a query of more than ``most`` is too broad and is skipped, as its report says. ``page(query, cursor, size)`` gives JSON texts and the next
    cursor, None at the end; the first cursor is None. Calls that raise are repeated after waits that double; after the last the query's status is its error and what came before stays.
    One task a query; pages are handed on as they come. The pull is stored, so that nothing is asked for twice.
    """

    def patient(call: Callable, *args: object) -> object:
        for k in range(retries):
            try:
                return call(*args)
            except Exception:
                if k + 1 == retries:
                    raise
                time.sleep(wait * 2**k)

    def of_query(q: str) -> Iterator[pd.DataFrame]:
        rows = lambda found, status, values: pd.DataFrame({"query": q, "found": found, "status": status, "value": values}, columns=["query", "found", "status", "value"])
        found, cursor = None, None
        try:
            found = patient(count, q)
            if found > most:
                yield rows(found, ["skipped"], [None])
                return
            while True:
                values, cursor = patient(page, q, cursor, size)
                if values:
                    yield rows(found, None, list(values))
                if cursor is None:
                    break
            yield rows(found, ["done"], [None])
        except Exception as e:  # whatever a service throws ends this query only
            yield rows(found, [f"{type(e).__name__}: {e}"[:200]], [None])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q in pdf["query"]:
                yield from of_query(q)

    asked = spark.createDataFrame([(q,) for q in queries], "query string").repartition(max(1, len(queries)), "query")
    got = stored(asked.mapInPandas(run, "query string, found long, status string, value string"), "pull")
    works = got.filter("value is not null").withColumn("key", F.get_json_object("value", f"$.{key}")).filter("key is not null")
    report = got.groupBy("query").agg(F.max("found").alias("found"), F.count("value").alias("pulled"), F.max("status").alias("status"))
    return works.groupBy("key").agg(F.min(F.struct("query", "value")).alias("r")).select("key", "r.value"), report


def from_medline_xml(rows: DataFrame, column: str = "xml") -> DataFrame:
    """SRC8: stored article XML to the flat record; the year from Year, else from the start of MedlineDate."""
    x = lambda p: F.xpath_string(column, F.lit(p))
    l = lambda p: F.xpath(column, F.lit(p))
    year = F.coalesce(F.nullif(x("//PubDate/Year"), F.lit("")), F.nullif(F.substring(x("//PubDate/MedlineDate"), 1, 4), F.lit("")))
    return rows.select(
        x("//PMID").alias("pmid"), x("//ArticleTitle").alias("title"), F.when(year.rlike(r"^\d{4}$"), year).cast("long").alias("year"), x("//Journal/Title").alias("journal"), F.array_join(l("//AbstractText/text()"), " ").alias("abstract"),
        F.zip_with(l("//Author/LastName/text()"), l("//Author/Initials/text()"), lambda a, b: F.concat_ws(" ", a, b)).alias("authors"), l("//MeshHeading/DescriptorName/text()").alias("mesh_terms"),
        F.nullif(x("//ArticleId[@IdType='doi']"), F.lit("")).alias("doi"), l("//Language/text()").alias("language"), l("//PublicationType/text()").alias("publication_types"),
    )
