"""Association statistics on long contingency tables (row, col, n): margins, Fisher's exact test, false discovery rate, strength classes, trajectories, chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litforge.operators.running import BEFORE, ranged
from litforge.scratch import stored

#: Label of each pattern of significance over three eras.
TRAJECTORIES = {"111": "STABLE", "001": "EMERGING", "100": "DECLINING", "011": "RISING", "110": "FADING", "010": "TRANSIENT_MIDDLE", "101": "BIMODAL", "000": "WEAK_NONE"}


def not_noise(c: Column, noise: Sequence[str] = ("unspecified", "other")) -> Column:
    """FLT9: keeps null, which SQL's NOT IN would drop."""
    return F.coalesce(~c.isin(*noise), F.lit(True))


def entity_min_support(df: DataFrame, entity: str, record: str, least: int) -> DataFrame:
    """FLT11"""
    kept = df.groupBy(entity).agg(F.countDistinct(record).alias("_n")).filter(F.col("_n") >= least).select(entity)
    return df.join(kept, entity, "left_semi")


def contingency(df: DataFrame, row: str, col: str, record: str | None = None) -> DataFrame:
    """AGG18, AGG19, AGG23: rows, or distinct records, of each cell; null keys go."""
    n = F.countDistinct(record) if record else F.count(F.lit(1))
    return df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(n.alias("n"))


def with_margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """AGG24: all cells, margins and the total, margins named All."""
    c = df.cube(row, col).agg(F.count(F.lit(1)).alias("n"), F.grouping(row).alias("_r"), F.grouping(col).alias("_c"))
    return c.select(F.when(F.col("_r") == 1, "All").otherwise(F.col(row)).alias("row"), F.when(F.col("_c") == 1, "All").otherwise(F.col(col)).alias("col"), "n")


def completed(ct: DataFrame) -> DataFrame:
    """All combinations of rows and columns with their margins: (row, col, n, row_total, col_total, total). The grid is one of entities by categories."""
    grid = ct.select("row").distinct().crossJoin(ct.select("col").distinct())
    full = grid.join(ct, ["row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    return full.select("*", total("row").alias("row_total"), total("col").alias("col_total"), total().alias("total"))


def likely_counts(margins: DataFrame, deviations: int = 40, more: int = 200) -> DataFrame:
    """(row_total, col_total, total, x, share): the hypergeometric probability of each count x around the mode, over so many standard deviations and some more that all beyond is less than
    the smallest double. So a margin gives rows by the root of its size, not by its size."""
    r, c, t = (F.col(k).cast("double") for k in ("row_total", "col_total", "total"))
    low, high = F.greatest(F.lit(0), F.col("row_total") + F.col("col_total") - F.col("total")), F.least("row_total", "col_total")
    mode = F.floor((r + 1) * (c + 1) / (t + 2))
    half = F.ceil(deviations * F.sqrt(F.coalesce(F.try_divide(r * c * (t - r) * (t - c), t * t * F.greatest(t - 1, F.lit(1.0))), F.lit(0.0)))) + more
    x = margins.withColumn("x", F.explode(F.sequence(F.greatest(low, mode - half).cast("long"), F.least(high, mode + half).cast("long"))))
    # each probability follows from the one before it; sums of logarithms, scaled by the largest, keep exp in range
    up = (F.col("row_total") - F.col("x") + 1).cast("double") * (F.col("col_total") - F.col("x") + 1)
    down = F.col("x").cast("double") * (F.col("total") - F.col("row_total") - F.col("col_total") + F.col("x"))
    w = Window.partitionBy("row_total", "col_total", "total")
    first = F.row_number().over(w.orderBy("x")) == 1
    x = x.withColumn("step", F.when(first, F.lit(0.0)).otherwise(F.log(up) - F.log(down)))
    x = x.withColumn("lp", F.sum("step").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("rel", F.exp(F.col("lp") - F.max("lp").over(w)))
    return x.select("row_total", "col_total", "total", "x", (F.col("rel") / F.sum("rel").over(w)).alias("share"))


def fisher_cells(cells: DataFrame, skip_degenerate: bool = False, keys: Sequence[str] = ("row", "col"), slack: float = 1e-7) -> DataFrame:
    """STA1, MTH5: two-sided Fisher's exact p of each cell against the rest, expected count, odds ratio (null if infinite), log2 odds ratio with one half added, direction.

    p is the sum of hypergeometric probabilities not greater than that of the observed table, up to ``slack`` of it. Equal margins are worked out once. An observed count so far out that its
    probability is below the smallest double has p = 0; an empty margin has p = 1, or no row with skip_degenerate.
    """
    a = F.col("n")
    b, c, d = F.col("row_total") - a, F.col("col_total") - a, F.col("total") - F.col("row_total") - F.col("col_total") + a
    empty = (F.col("row_total") == 0) | (F.col("col_total") == 0) | (F.col("row_total") == F.col("total")) | (F.col("col_total") == F.col("total"))
    base = cells.filter(~empty) if skip_degenerate else cells
    base = base.withColumns({"expected": F.try_divide(F.col("row_total") * F.col("col_total"), F.col("total").cast("double")), "odds_ratio": F.try_divide(a * d, (b * c).cast("double")), "log2_or": F.log2((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))})
    margin = ["row_total", "col_total", "total"]
    support = likely_counts(base.select(*margin).distinct())
    observed = base.select(*margin, "n").distinct()
    own = observed.join(support.select(*margin, F.col("x").alias("n"), F.col("share").alias("own")), [*margin, "n"])
    p = own.join(support, margin).groupBy(*margin, "n").agg(F.least(F.lit(1.0), F.sum(F.when(F.col("share") <= F.col("own") * (1 + slack), F.col("share")).otherwise(0.0))).alias("p"))
    direction = F.when(F.col("n") > F.col("expected"), "enriched").when(F.col("n") < F.col("expected"), "depleted").otherwise("neutral")
    return base.join(p, [*margin, "n"], "left").withColumns({"p": F.coalesce("p", F.when(empty, 1.0).otherwise(0.0)), "direction": direction}).select(*keys, "n", *margin, "expected", "odds_ratio", "log2_or", "p", "direction")


def bh_fdr(df: DataFrame, p: str = "p", *family: str) -> DataFrame:
    """WIN11, STA2: q of Benjamini and Hochberg within each family: the least of p*m/rank over all ranks from a test's own on. A null p is no test and gets a null q.

    Equal p-values are counted first, and of these the highest rank holds. Ranks and minima run within ranges of (family, p) and are carried from range to range, so no task sees a whole family.
    """
    df = stored(df.drop("q"), "tests")
    keys = [f"_f{i}" for i in range(len(family))]
    named = [F.col(f).alias(k) for f, k in zip(family, keys, strict=True)]
    x = ranged(df.filter(F.col(p).isNotNull()).groupBy(*named, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c")), *keys, "_p")
    here = Window.partitionBy("_part", *keys).orderBy("_p")
    across = Window.partitionBy(*keys)  # rows of spans: a row for each range and family

    def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
        spans = spans.withColumnsRenamed({k: f"_s{k}" for k in keys} | {"_part": "_s_part"})
        return rows.join(spans, [F.col("_part") == F.col("_s_part"), *[F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]]).drop("_s_part", *[f"_s{k}" for k in keys])

    spans = x.groupBy("_part", *keys).agg(F.sum("_c").alias("_n"))
    spans = spans.withColumns({"_m": F.sum("_n").over(across), "_before": F.coalesce(F.sum("_n").over(across.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0))})
    rank = F.col("_before") + F.sum("_c").over(here.rowsBetween(Window.unboundedPreceding, 0))
    x = with_spans(x, spans).withColumn("_q", F.col("_p") * F.col("_m") / rank).select("_part", *keys, "_p", "_q")
    later = x.groupBy("_part", *keys).agg(F.min("_q").alias("_l"))
    later = later.withColumn("_l", F.min("_l").over(across.orderBy(F.desc("_part")).rowsBetween(*BEFORE)))
    onward = F.min("_q").over(here.rowsBetween(0, Window.unboundedFollowing))
    q = with_spans(x, later).select(*keys, "_p", F.least(F.lit(1.0), onward, "_l").alias("q"))
    return df.join(q, [F.col(p) == F.col("_p"), *[F.col(f).eqNullSafe(F.col(k)) for f, k in zip(family, keys, strict=True)]], "left").drop("_p", *keys)


def strength_class(df: DataFrame, alpha: float = 0.05, high: float = 2.0, low: float = 0.5, least: int = 5) -> DataFrame:
    """STA3; an infinite odds ratio (null) is above any bound."""
    strong = (F.coalesce(F.col("odds_ratio") > high, F.lit(True))) & (F.col("n") >= least)
    weak = (F.col("odds_ratio") < low) & (F.col("expected") >= least)
    label = F.when(F.col("q") < alpha, F.when(strong, "strong_enrichment").when(weak, "strong_depletion").otherwise("weak_sig")).otherwise("ns")
    return df.withColumn("classification", label)


def era_trajectory(tested: DataFrame, eras: Sequence[str], enriched: bool = True, alpha: float = 0.05) -> DataFrame:
    """STA4: (row, col, pattern, trajectory) from tests of each era: one bit an era, set if significant in the wanted direction."""
    side = F.col("direction") == ("enriched" if enriched else "depleted")
    bit = [F.coalesce(F.max(F.when((F.col("era") == e) & (F.col("q") < alpha) & side, F.lit(1)).otherwise(0)), F.lit(0)).cast("string") for e in eras]
    out = tested.groupBy("row", "col").agg(F.concat(*bit).alias("pattern"))
    label = F.lit(None).cast("string")
    for k, v in TRAJECTORIES.items():
        label = F.when(F.col("pattern") == k, v).otherwise(label)
    return out.withColumn("trajectory", label)


def chain_class(f: Column, s: Column, c: Column, has_c: Column) -> Column:
    """STA5: class of a three-tier chain from each tier's significance and whether the lowest tier exists."""
    return (
        F.when(f & s & has_c & c, "FULL_CHAIN")
        .when(f & s & ~has_c, "FAMILY_SPECIES_NO_COMPOUND_DATA")
        .when(f & s, "F_S_COMPOUND_NOT_SIG")
        .when(f, "FAMILY_PERVASIVE")
        .when(s & has_c & c, "SPECIES_COMPOUND_NO_FAMILY")
        .when(s, "SPECIES_SPECIFIC")
        .when(has_c & c, "COMPOUND_ORPHAN")
        .otherwise("ALL_NS")
    )


def hierarchy_chains(pairs: DataFrame, categories: DataFrame, stats: dict[str, DataFrame], category: str = "category") -> DataFrame:
    """JON13: every (family, species, compound) by category with each tier's flag. pairs: the distinct triples, compound may be null; stats: tier -> (entity, category, sig). The grid is triples by categories, both small."""
    out = pairs.crossJoin(categories)
    for tier in ("family", "species", "compound"):
        s = stats[tier].select(F.col("entity").alias(tier), category, F.col("sig").alias(f"{tier}_sig"))
        out = out.join(s, [tier, category], "left").withColumn(f"{tier}_sig", F.coalesce(f"{tier}_sig", F.lit(False)))
    return out.withColumn("chain_class", chain_class(F.col("family_sig"), F.col("species_sig"), F.col("compound_sig"), F.col("compound").isNotNull()))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """STA6: adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings; both are 1 where each has one class. Null labels go."""
    ct = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda c: F.sum(c * (c - 1) / 2)
    rows, cols = (ct.groupBy(k).agg(F.sum("n").alias("n")) for k in "ab")
    n = F.col("n")
    # entropies in counts: sum n ln n
    xlnx = lambda c: F.sum(c * F.log(c))
    x = ct.agg(F.sum("n").alias("t"), two(n).alias("ij"), xlnx(n).alias("hij"))
    one = x.crossJoin(rows.agg(two(n).alias("i"), xlnx(n).alias("hi"))).crossJoin(cols.agg(two(n).alias("j"), xlnx(n).alias("hj")))
    t = F.col("t")
    expected = F.col("i") * F.col("j") / F.nullif(t * (t - 1) / 2, F.lit(0.0))
    most = (F.col("i") + F.col("j")) / 2
    ha, hb = F.log(t) - F.col("hi") / t, F.log(t) - F.col("hj") / t
    mi = F.log(t) + (F.col("hij") - F.col("hi") - F.col("hj")) / t
    return one.select(t.cast("long").alias("n"), F.coalesce((F.col("ij") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"), F.when(ha + hb > 1e-12, 2 * mi / (ha + hb)).otherwise(1.0).alias("nmi"))


def jaccard_groups(df: DataFrame, group: str, item: str) -> DataFrame:
    """AGG36: Jaccard of the distinct items of each two groups; items are joined by equality and counted, groups are few."""
    sets = df.filter(F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    size = sets.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    arrays = sets.groupBy("i").agg(F.array_sort(F.collect_set("g")).alias("s")).select("s", F.posexplode("s").alias("p", "a"))
    both = arrays.select("a", F.explode(F.expr("slice(s, p + 2, size(s))")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("inter"))
    na, nb = size.select(F.col("g").alias("a"), F.col("n").alias("na")), size.select(F.col("g").alias("b"), F.col("n").alias("nb"))
    all_ = na.crossJoin(nb).filter("a < b").join(both, ["a", "b"], "left").withColumn("n_both", F.coalesce("inter", F.lit(0)).cast("long"))
    return all_.select("a", "b", "n_both", (F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both"))).alias("jaccard"))


def majority_vote(df: DataFrame, record: str, label: str) -> DataFrame:
    """AGG27: the most frequent label of each record, ties to the smallest."""
    return df.filter(F.col(label).isNotNull()).groupBy(record, label).agg(F.count(F.lit(1)).alias("votes")).groupBy(record).agg(F.min(F.struct((-F.col("votes")).alias("o"), F.col(label).alias("v")))["v"].alias(label))
