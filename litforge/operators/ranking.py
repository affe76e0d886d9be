"""Rankings and inventories of entities: countries, institutions, persons, journals, keywords, affiliations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.operators.running import placed


def with_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """WIN4: place in a total order."""
    return placed(df, order, name)


def entity_ranking(df: DataFrame, codes: str, cites: str) -> DataFrame:
    """AGG8: per entity of an array column its records, share, citations and mean, and records shared with other entities. Null citations count 0."""
    rows = df.select(F.array_distinct(codes).alias("codes"), F.coalesce(F.col(cites), F.lit(0)).alias("cites")).filter(F.size("codes") > 0)
    total = rows.agg(F.count(F.lit(1)).alias("attributed"))
    each = rows.select(F.explode("codes").alias("entity"), "cites", (F.size("codes") > 1).alias("multi"))
    out = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("cites").alias("citations"), F.avg("cites").alias("mean_citations"), F.count_if("multi").alias("mcp"))
    out = out.crossJoin(F.broadcast(total))  # one row
    out = out.select("entity", "n", (100.0 * F.col("n") / F.col("attributed")).alias("pct"), "citations", "mean_citations", "mcp", (F.col("mcp") / F.col("n")).alias("mcp_ratio"))
    return with_rank(out, F.desc("n"), F.asc("entity"))


def single_multi_split(df: DataFrame, codes: str) -> DataFrame:
    """AGG9: records of one entity and of several, and the mean entities of the latter."""
    n = F.size(F.array_distinct(codes))
    return df.agg(F.count_if(n == 1).alias("scp"), F.count_if(n > 1).alias("mcp"), F.avg(F.when(n > 1, n)).alias("mean_entities"))


def pair_counts(df: DataFrame, record: str, item: str, least: int = 1) -> DataFrame:
    """AGG10, GRF1: unordered pairs of distinct items of a record, with the records that have both. A record's items become one array; pairs are made within it."""
    sets = df.filter(F.col(item).isNotNull()).groupBy(record).agg(F.array_sort(F.collect_set(item)).alias("s")).filter(F.size("s") > 1)
    left = sets.select("s", F.posexplode("s").alias("i", "a"))
    pairs = left.select("a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def position_ranking(df: DataFrame, record: str, entity: str, position: str, cites: str, group: str) -> DataFrame:
    """AGG11: per entity its records, those in first position, citations, and those with two and more groups (such as countries)."""
    spread = df.groupBy(record).agg((F.size(F.collect_set(group)) > 1).alias("wide"))
    once = df.groupBy(record, entity).agg(F.min(position).alias("at"), F.max(F.coalesce(F.col(cites), F.lit(0))).alias("c"))
    out = once.join(spread, record).groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") == 1).alias("n_first"), F.sum("c").alias("citations"), F.count_if("wide").alias("n_intl"))
    return out.withColumn("intl_ratio", F.col("n_intl") / F.col("n"))


def variant_stats(df: DataFrame, key: str, name: str, record: str, top: int = 3, samples: int = 5) -> DataFrame:
    """AGG12, AGG13: per id the most frequent spelling (ties by name), records, spellings, the top ones as text, and the smallest record ids."""
    names = df.groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    spelled = names.groupBy(key).agg(F.count(F.lit(1)).alias("n_variants"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(name).alias("v")))).alias("l"))
    spelled = spelled.select(key, "n_variants", F.element_at("l", 1)["v"].alias("main_name"), F.array_join(F.transform(F.slice("l", 1, top), lambda x: x["v"]), " | ").alias("top_names"))
    records = df.groupBy(key).agg(F.countDistinct(record).alias("n_records"))
    ranked = df.select(key, record).distinct().withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(record))).filter(F.col("r") <= samples)
    ids = ranked.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(record)), ",").alias("sample_ids"))
    return spelled.join(records, key).join(ids, key)


def source_ranking(df: DataFrame, source: str, cites: str, year: str) -> DataFrame:
    """AGG14: per source its records, citations (null counts 0), mean, first and last year."""
    c = F.coalesce(F.col(cites), F.lit(0))
    return df.filter(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("citations"), F.avg(c).alias("mean_citations"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def keyword_inventory(df: DataFrame, record: str, source: str, keyword: str, sources: Sequence[str]) -> DataFrame:
    """AGG16, AGG17: per keyword the distinct records of each source and their sum, with a rank."""
    once = df.filter(F.col(keyword).isNotNull()).select(record, source, keyword).distinct()
    wide = once.groupBy(keyword).agg(*[F.count_if(F.col(source) == s).alias(f"n_{s}") for s in sources], F.count(F.lit(1)).alias("total"), F.countDistinct(record).alias("n_records"))
    return with_rank(wide, F.desc("n_records"), F.asc(keyword))


def affiliation_inventory(df: DataFrame, record: str, text: str, samples: int = 5) -> DataFrame:
    """AGG29: distinct strings with their records, smallest record ids, and an id from the string's digest."""
    once = df.filter(F.length(text) > 0).select(record, text).distinct().withColumn("r", F.row_number().over(Window.partitionBy(text).orderBy(record)))
    out = once.groupBy(text).agg(F.count(F.lit(1)).alias("n_records"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= samples, F.col(record)))), ",").alias("sample_ids"))
    return out.select(F.concat(F.lit("AF_"), F.substring(F.md5(F.lower(text).cast("binary")), 1, 12)).alias("affil_id"), text, "n_records", "sample_ids")


def ordered_institutions(df: DataFrame, record: str, position: str, name: str, country: str) -> DataFrame:
    """AGG28: per record its institutions in order, each once, and its sorted countries."""
    l = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(name).alias("v"))))
    return df.groupBy(record).agg(F.array_distinct(F.transform(l, lambda x: x["v"])).alias("institutions"), F.array_sort(F.collect_set(country)).alias("countries"))


def assign_by_position(authors: DataFrame, institutions: DataFrame, record: str, position: str, names: str) -> DataFrame:
    """JON14: the author at place N gets institution N, else the first, else (unknown)."""
    at = F.get(F.col(names), F.col(position).cast("int") - 1)
    return authors.join(institutions, record, "left").withColumn("institution", F.coalesce(at, F.get(F.col(names), 0), F.lit("(unknown)"))).drop(names)


def hub_degrees(edges: DataFrame, k: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """AGG39, GRF4: nodes by distinct neighbours, the k largest."""
    once = edges.select(src, dst).distinct()
    both = once.select(F.col(src).alias("node")).unionAll(once.select(F.col(dst)))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def presence_combos(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PRJ2: counts of which fields are filled, as ``a+b+c``."""
    label = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.lit(c)) for c in columns])), "+")
    return df.groupBy(F.when(label == "", F.lit("none")).otherwise(label).alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def overlap_counts(df: DataFrame, items: str) -> DataFrame:
    """AGG3: records by their sorted set of items, as ``A+B``."""
    return df.groupBy(F.array_join(F.array_sort(F.array_distinct(items)), "+").alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """AGG4: how many keys come once, twice, ..."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("multiplicity")).groupBy("multiplicity").agg(F.count(F.lit(1)).alias("n_keys"))


def coverage(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """AGG5: per group the rows, and the filled values and percent of each column."""
    filled = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[filled(c).alias(f"n_{c}") for c in columns])
    return out.select("*", *[(100.0 * F.col(f"n_{c}") / F.col("n")).alias(f"pct_{c}") for c in columns])


def top_per_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """WIN8"""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def bibliometric_summary(df: DataFrame, identifier: str, source: str, authors: str, countries: str, cites: str, year: str, until: int, k: int = 10) -> DataFrame:
    """STA9: the first k sources, authors and countries by records, and the k most cited records: (section, rank, name, n, per_year, normalised).

    For a cited record n is its citations, per_year these by years up to ``until``, normalised these over the mean of its year. Ties go by name; null names don't count.
    """
    none = F.lit(None).cast("double")

    def first(section: str, rows: DataFrame, tie: str = "name") -> DataFrame:
        top = rows.orderBy(F.desc("n"), tie).limit(k)
        w = Window.orderBy(F.desc("n"), tie)  # k rows
        return top.select(F.lit(section).alias("section"), F.row_number().over(w).cast("long").alias("rank"), F.col("name").cast("string").alias("name"), "n", "per_year", "normalised")

    def frequent(name: Column) -> DataFrame:
        return df.select(name.alias("name")).filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumns({"per_year": none, "normalised": none})

    mean = df.groupBy(F.col(year).alias("_year")).agg(F.avg(cites).alias("_mean"))
    cited = df.filter(F.col(cites).isNotNull()).select(F.col(identifier).alias("name"), F.col(cites).cast("long").alias("n"), F.col(year).alias("_year")).orderBy(F.desc("n"), "name").limit(k).join(mean, "_year", "left")
    cited = cited.withColumns({"per_year": F.try_divide(F.col("n"), until - F.col("_year") + 1), "normalised": F.try_divide(F.col("n"), F.col("_mean"))})
    parts = [first("sources", frequent(F.col(source))), first("authors", frequent(F.explode(F.array_distinct(authors)))), first("countries", frequent(F.explode(F.array_distinct(countries)))), first("cited", cited)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
