"""Record linkage: golden records, blocked fuzzy pairs, components, reconciliation of two corpora, lookups and their closure."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.functions.text import indel_ratio, safe_prefilter, token_sorted
from litforge.operators.lists import CHUNK, chunked
from litforge.operators.segments import candidates
from litforge.scratch import stored

BROADCAST_ROWS = 100_000
DIRECT = 500  # texts of a block up to which all its pairs are looked at


def has_key(c: str) -> Column:
    """FLT1: filled, not blank."""
    return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")


def block_eligible(year: Column, title: Column, author: Column) -> Column:
    """FLT2"""
    return F.coalesce(year.isNotNull() & (F.length(title) >= 10) & (F.length(author) >= 2), F.lit(False))


def survivorship(df: DataFrame, key: str, order: Sequence[Column], source: str, identifier: str, maxes: Sequence[str] = (), fills: dict[str, tuple[str, str]] | None = None, id_list: bool = True) -> DataFrame:
    """AGG1, AGG2: one row a key, the first in the given total order, with all sources, their number, all ids, greatest values, and columns filled from a named source.

    Without ``id_list`` no row grows with its key, and ``lists.chunked(df, [key], identifier)`` holds the ids in chunks.

    One aggregation, no window: the winner is the least of (order, row) structs, so that partial winners are picked before the shuffle.
    """
    rest = [c for c in df.columns if c not in maxes and c != key and c not in (fills or {})]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))
    extra = [F.max(m).alias(m) for m in maxes]
    own = [F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(c).alias("v")))["v"].alias(f"_own_{c}") for c in fills or {}]
    special = [F.max(F.when(F.col(source) == s, F.col(column))).alias(f"_fill_{c}") for c, (s, column) in (fills or {}).items()]
    out = df.groupBy(key).agg(
        F.min(ranked)["row"].alias("row"), *extra, *own, *special,
        F.array_sort(F.collect_set(source)).alias("source_list"), *([F.array_sort(F.collect_list(F.struct(F.col(source), F.col(identifier)))).alias("ids")] if id_list else []), F.count(F.lit(1)).alias("n_merged"),
    )
    ids = [F.transform("ids", lambda x: x[identifier]).alias("id_list")] if id_list else []
    filled = [F.coalesce(F.col(f"_fill_{c}"), F.col(f"_own_{c}")).alias(c) for c in fills or {}]
    return out.select(key, "row.*", *maxes, *filled, "source_list", F.size("source_list").alias("source_count"), *ids, "n_merged")


def block_pairs(df: DataFrame, identifier: str, blocks: Sequence[str], text: str, threshold: float, metric: str = "indel", direct: int = DIRECT) -> DataFrame:
    """JON10, FUZ1: pairs of a block, smaller id first, whose texts are alike by the threshold (over 50). Identifiers are distinct; null texts are like nothing.

    Equal texts of a block become one class first. Blocks of up to ``direct`` classes are joined with themselves; larger ones go by an exact index of segments, so that a hot block costs no square.
    Length band and bounded edit distance come before the ratio, so only what passes both reaches the Arrow UDF.
    """
    if not 50 < threshold <= 100:
        raise ValueError("the threshold lies over 50 and up to 100")
    classes = df.filter(F.col(text).isNotNull()).groupBy(*blocks, text).agg(F.min(identifier).alias("rep"))
    copies = df.join(classes, [*blocks, text]).filter(F.col(identifier) != F.col("rep")).select(F.col("rep").alias("a"), F.col(identifier).alias("b"), F.lit(100.0).alias("score"))
    classes = stored(classes, "classes")
    large = classes.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > direct).drop("_n")
    large = stored(large, "hot")
    hot = not large.isEmpty()
    few = classes.join(large, list(blocks), "left_anti") if hot else classes
    l, r = few.alias("l"), few.alias("r")
    same = [F.col(f"l.{b}") == F.col(f"r.{b}") for b in blocks]
    x, y = F.col("x"), F.col("y")
    # 2 * common / total can reach the threshold only if the shorter one is long enough
    band = 200.0 * F.least(F.length(f"l.{text}"), F.length(f"r.{text}")) >= threshold * (F.length(f"l.{text}") + F.length(f"r.{text}"))
    pairs = l.join(r, [*same, F.col("l.rep") < F.col("r.rep"), band]).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), F.col(f"l.{text}").alias("x"), F.col(f"r.{text}").alias("y"))
    if hot:
        many = classes.join(large, list(blocks), "left_semi")
        for_end = lambda id_, h, t: many.select(F.col("rep").alias(id_), F.xxhash64(text).alias(h), F.col(text).alias(t)).distinct()
        found = candidates(many, blocks, "rep", text, threshold, metric)
        pairs = pairs.unionAll(found.join(for_end("a", "ha", "x"), ["a", "ha"]).join(for_end("b", "hb", "y"), ["b", "hb"]).select("a", "b", "x", "y"))
    if metric == "indel":
        pairs = pairs.filter(safe_prefilter(x, y, threshold)).withColumn("score", indel_ratio(x, y))
    else:
        pairs = pairs.withColumn("score", 100.0 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))))
    return pairs.filter(F.col("score") >= threshold).select("a", "b", "score").unionAll(copies)


def connected_components(pairs: DataFrame) -> DataFrame:
    """FUZ3: (id, component), the smallest id reachable. Alternating large and small stars until nothing moves, which takes rounds by the logarithm of the longest path; each round is stored."""
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        open_ = edges.groupBy("u").count().filter("count > 1").select("u").unionAll(edges.join(edges.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").select("u"))
        if open_.isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())
        both = edges.unionAll(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low).distinct(), "edges")


def resolve_components(df: DataFrame, components: DataFrame, identifier: str, *order: Column) -> DataFrame:
    """FUZ4: of each component the first row in the given order stays; a column tells which ids it absorbed."""
    ends = components.select(F.col("id").alias("_id"), "component")
    tagged = df.join(ends, F.col(identifier) == F.col("_id"), "left").withColumn("component", F.coalesce("component", identifier)).drop("_id")
    placed = tagged.withColumn("_r", F.row_number().over(Window.partitionBy("component").orderBy(*order)))
    lost = placed.filter("_r > 1").groupBy("component").agg(F.array_sort(F.collect_list(identifier)).alias("absorbed"))
    return placed.filter("_r = 1").drop("_r").join(lost, "component", "left").withColumn("absorbed", F.coalesce("absorbed", F.array().cast("array<bigint>")))


def resolve_in_chunks(df: DataFrame, components: DataFrame, identifier: str, order: Sequence[Column], size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """FUZ4 for components of any size: the rows that stay, with their component, and (component, chunk, items, n), the ids absorbed. Identifiers are distinct; the order is ascending and total.

    The row that stays is a minimum, summed before the shuffle; the others are those whose id is not among these.
    """
    ends = components.select(F.col("id").alias("_id"), F.col("component"))
    tagged = df.join(ends, F.col(identifier) == F.col("_id"), "left").withColumn("component", F.coalesce("component", identifier)).drop("_id")
    tagged = stored(tagged, "tagged")
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*df.columns).alias("row"))
    stay = stored(tagged.groupBy("component").agg(F.min(rank)["row"].alias("row")).select("component", "row.*"), "stay")
    lost = tagged.select("component", identifier).join(stay.select(F.col(identifier).alias("_id")), F.col(identifier) == F.col("_id"), "left_anti")
    return stay, chunked(lost, ["component"], identifier, size)


def conditional_filter(df: DataFrame, subset: Column, block: Column, drop: str = "B0_none") -> DataFrame:
    """FLT5: the block decides within the subset; all other rows pass."""
    return df.withColumn("matched_block", F.when(subset, block).otherwise("auto_pass")).filter(F.col("matched_block") != drop)


def map_values(df: DataFrame, column: str, mapping: DataFrame, out: str, keep: bool = True) -> DataFrame:
    """JON6, STR16: alias to canonical name by a lookup table (alias, canonical); without a match the value itself or null. Of several names of an alias the smallest counts, so no row is doubled. The table is broadcast only while it is small."""
    m = mapping.groupBy(F.col("alias").alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    m = F.broadcast(m) if m.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else m
    return df.join(m, F.col(column) == F.col("_alias"), "left").withColumn(out, F.coalesce("_canonical", F.col(column)) if keep else F.col("_canonical")).drop("_alias", "_canonical")


def coalesce_lookup(df: DataFrame, columns: Sequence[str], mapping: DataFrame, out: str, fallback: Sequence[str] = ()) -> DataFrame:
    """STR17: the first of some columns that the lookup knows; else the first filled one of the fallback columns, marked unmapped."""
    for i, c in enumerate(columns):
        df = map_values(df, c, mapping, f"_hit{i}", keep=False)
    hit = F.coalesce(*[F.col(f"_hit{i}") for i in range(len(columns))])
    rest = F.coalesce(*[F.col(c) for c in fallback]) if fallback else F.lit(None).cast("string")
    kind = F.when(hit.isNotNull(), "mapped").when(rest.isNotNull(), "unmapped")
    return df.withColumns({out: F.coalesce(hit, rest), f"{out}_status": kind}).drop(*[f"_hit{i}" for i in range(len(columns))])


def close_mapping(mapping: DataFrame) -> DataFrame:
    """MAP1: every alias to the end of its chain, by pointer doubling. An alias has one canonical name (of several the smallest); chains that run into a loop end at the loop's smallest name."""
    links = mapping.filter("alias <> canonical").groupBy("alias").agg(F.min("canonical").alias("canonical"))
    ends = links.select(F.col("canonical").alias("alias")).distinct().join(links.select("alias"), "alias", "left_anti")
    m = stored(links.unionAll(ends.select("alias", F.col("alias").alias("canonical"))), "closure")
    # after so many doublings every image is an end, or lies in a loop
    for _ in range(max(1, m.count().bit_length())):
        after = m.join(m.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c")), F.col("canonical") == F.col("_a"))
        if after.filter("canonical <> _c").isEmpty():
            return m.filter("alias <> canonical")
        m = stored(after.select("alias", F.col("_c").alias("canonical")), "closure")
    # each connected part has one end or one loop, and its images cover the loop
    part = connected_components(links.select(F.col("alias").alias("a"), F.col("canonical").alias("b")))
    whole = m.join(part, F.col("alias") == F.col("id"))
    least = whole.groupBy("component").agg(F.min("canonical").alias("least"))
    return whole.join(least, "component").select("alias", F.col("least").alias("canonical")).filter("alias <> canonical")


def suggest_thesaurus(keywords: DataFrame, threshold: float = 88.0, heads: int = 500, tails: int = 1500, best: int = 10) -> DataFrame:
    """JON11, FUZ2, FUZ5: rarer keywords to more frequent ones that are alike after sorting words; each takes its best. keywords: (keyword, n). Both sides are top lists, so the cross join is bounded."""
    top = keywords.orderBy(F.desc("n"), "keyword").limit(tails)
    head = top.orderBy(F.desc("n"), "keyword").limit(heads).select(F.col("keyword").alias("canonical"), F.col("n").alias("canonical_n"))
    pairs = top.crossJoin(F.broadcast(head)).filter("canonical_n > n and keyword <> canonical")
    x, y = token_sorted(F.col("keyword")), token_sorted(F.col("canonical"))
    scored = pairs.filter(safe_prefilter(x, y, threshold)).withColumn("score", indel_ratio(x, y)).filter(F.col("score") >= threshold)
    w = Window.partitionBy("keyword").orderBy(F.desc("score"), F.desc("canonical_n"), "canonical")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= best)


def build_thesaurus(keywords: DataFrame, known: DataFrame, threshold: float = 88.0, never: DataFrame | None = None) -> DataFrame:
    """FUZ5: (alias, canonical): known aliases first, then each other keyword's best candidate, both ways without the pairs that must never merge; chains are followed to their ends, loops go."""
    best = suggest_thesaurus(keywords, threshold, best=1).select(F.col("keyword").alias("alias"), "canonical")
    if never is not None:
        both = never.select("alias", "canonical").unionAll(never.select("canonical", "alias"))
        best = best.join(both, ["alias", "canonical"], "left_anti")
    return close_mapping(known.select("alias", "canonical").unionByName(best.join(known.select("alias"), "alias", "left_anti")))


def apply_thesaurus(df: DataFrame, mapping: DataFrame, stop: DataFrame, record: str, source: str, keyword: str) -> DataFrame:
    """FUZ6: canonical names, stop words dropped after mapping, one row for each record and keyword."""
    mapped = map_values(df, keyword, mapping, "_k").select(record, source, F.col("_k").alias(keyword))
    return mapped.join(stop.select(F.col("keyword").alias("_s")), F.col(keyword) == F.col("_s"), "left_anti").select(record, source, keyword).distinct().select(record, keyword).distinct()


def fill_from_key(df: DataFrame, key: str, column: str) -> DataFrame:
    """JON7: empty arrays filled with the values of all rows that share the key."""
    known = df.filter(F.col(key).isNotNull() & (F.size(column) > 0)).select(F.col(key).alias("_k"), F.explode(column).alias("_v")).groupBy("_k").agg(F.array_sort(F.collect_set("_v")).alias("_fill"))
    out = df.join(known, F.col(key) == F.col("_k"), "left")
    return out.withColumn(column, F.when(F.size(column) > 0, F.col(column)).otherwise(F.coalesce("_fill", F.col(column)))).drop("_k", "_fill")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JON9"""
    return df.join(done.select(key).distinct(), key, "left_anti")


def latest_by_key(df: DataFrame, key: str, *ordinal: Column) -> DataFrame:
    """SET3, SET5: of each key the row with the greatest ordinal, rows of null keys all; one aggregation."""
    some = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(ordinal)], F.struct("*").alias("row")))["row"].alias("row")).select("row.*")
    return some.unionByName(df.filter(F.col(key).isNull()))


def patch_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SET5: rows of old whose key new has are replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def reconcile(main: DataFrame, partial: DataFrame, key: str, order: Column, moved: Column) -> tuple[DataFrame, DataFrame]:
    """SET4: rows of main that meet a condition go over to partial unless their key is there; partial keeps one row a key, all of null keys, and none whose key main still has."""
    stays, leaves = main.filter(~F.coalesce(moved, F.lit(False))), main.filter(F.coalesce(moved, F.lit(False)))
    keys = partial.filter(F.col(key).isNotNull()).select(key).distinct()
    pool = partial.unionByName(leaves.join(keys, key, "left_anti").select(*partial.columns))
    known = stays.filter(F.col(key).isNotNull()).select(key).distinct()
    keyed = pool.filter(F.col(key).isNotNull()).join(known, key, "left_anti").select(*pool.columns)
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")
    return stays, first.unionByName(pool.filter(F.col(key).isNull()))


def catch_all_groups(df: DataFrame, name: str, least: int, criteria: dict[str, Column]) -> DataFrame:
    """FUZ8: names that gather unlike strings. criteria are boolean aggregates; two of them make a catch-all."""
    out = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in criteria.items()]).filter(F.col("n") >= least)
    score = sum((F.col(k).cast("int") for k in criteria), F.lit(0))
    return out.withColumn("score", score.cast("long")).withColumn("is_catch_all", F.col("score") >= 2)


def override_matches(matched: Column, rule: Column, catch_all: Column) -> Column:
    """FUZ9: struct(value, reason): a rule that disagrees wins; a known catch-all without a rule is taken back."""
    return (
        F.when(rule.isNotNull() & ~rule.eqNullSafe(matched), F.struct(rule.alias("value"), F.lit("override").alias("reason")))
        .when(rule.isNull() & F.coalesce(catch_all, F.lit(False)), F.struct(F.lit(None).cast("string").alias("value"), F.lit("unmatched").alias("reason")))
        .otherwise(F.struct(matched.alias("value"), F.lit("kept").alias("reason")))
    )


def match_affiliations(df: DataFrame, text: str, lookup: Callable[[str], list[dict]], done: DataFrame | None = None, retries: int = 4, wait: float = 1.0) -> DataFrame:
    """FUZ7: (text, matched, id, name, country, score, error) of each distinct text, looked up once by a service.

    ``lookup`` gives candidates with id, name, country, score and chosen. The chosen one is taken, else the one of the best score, the first of equals. A call that raises is repeated after waits
    that double; the last error is kept and the text counts as unmatched. ``done`` holds earlier results, say read back from ``sinks.append_jsonl``: their texts are left out, but for those that
    ended in an error. Null and empty texts are not asked for.
    """

    def ask(x: str) -> tuple:
        error = None
        for k in range(retries):
            try:
                found = lookup(x)
            except Exception as e:  # whatever a service throws is its answer
                error = f"{type(e).__name__}: {e}"[:200]
                if k + 1 < retries:
                    time.sleep(wait * 2**k)
                continue
            best = next((c for c in found if c.get("chosen")), None) or max(found, key=lambda c: c.get("score") or 0, default=None)
            return (x, best is not None, *[(best or {}).get(k) for k in ("id", "name", "country", "score")], None)
        return x, False, None, None, None, None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [ask(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for a in answers], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()))], ["text", "matched", "id", "name", "country", "score", "error"])

    asked = df.filter(F.length(text) > 0).select(F.col(text).cast("string").alias("text")).distinct()
    if done is not None:
        asked = asked.join(done.filter("error is null").select("text"), "text", "left_anti")
    return asked.mapInArrow(run, "text string, matched boolean, id string, name string, country string, score double, error string")
