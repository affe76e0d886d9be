"""Topics: class-based term weights, centroids, vector clustering with noise, samples by stratum, cluster statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from litforge.operators.lists import place_within
from litforge.operators.quantile import beside, order_statistic
from litforge.scratch import stored

CHUNK_WORDS = 1_000_000  # about so many are counted at once


def tokens(text: Column, least: int = 3, stop: Sequence[str] = ()) -> Column:
    """Lower-case words of Latin letters and hyphens; stop words go before any pairing."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z][a-z-]{{{least - 1},}}"), 0)
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def _runs(batch: pa.RecordBatch, up_to: int) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of up to so many words in some rows of (class, words). A run is the number of the run before it and a word's number, so only distinct ones become text."""
    cls, words = batch.column(0).dictionary_encode(null_encoding="encode"), batch.column(1).flatten().dictionary_encode()
    word, vocabulary = words.indices.to_numpy().astype(np.int64), words.dictionary
    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
    kind = cls.indices.to_numpy().astype(np.int64)[row]
    at, run = np.arange(len(word)), kind
    for n in range(1, up_to + 1):
        within = at[at + n - 1 < len(word)]
        within = row[within] == row[within + n - 1]
        at, run = at[: len(within)][within], run[: len(within)][within]
        _, where, run, count = np.unique(run * len(vocabulary) + word[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        first = at[where]
        term = [vocabulary.take(pa.array(word[first + j])) for j in range(n)]
        yield pa.record_batch([cls.dictionary.take(pa.array(kind[first])), pc.binary_join_element_wise(*term, " ") if n > 1 else term[0], pa.array(count)], names=["class", "term", "n"])


def ngram_counts(df: DataFrame, cls: str, words: Column, up_to: int = 2) -> DataFrame:
    """(class, term, n): words and the joined runs of up to so many words, counted by class. Rows are counted some at a time first; what is shuffled, by term, are these counts."""
    x = df.select(F.col(cls).alias("class"), words.alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
            part = upto // CHUNK_WORDS
            for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if len(rows):
                    yield from _runs(batch.slice(rows[0], len(rows)), up_to)

    schema = T.StructType([T.StructField("class", x.schema["class"].dataType), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    return x.mapInArrow(run, schema).repartition("term").groupBy("class", "term").agg(F.sum("n").alias("n"))


def ctfidf(df: DataFrame, cls: str, text: str, up_to: int = 2, min_df: int = 2, max_df: float = 0.9, stop: Sequence[str] = ()) -> DataFrame:
    """TXT1: (class, term, n, score): term share within a class times ln(1 + classes/classes with the term). Terms in fewer than min_df classes or over max_df of them go before shares are taken. Rows without a class are a class, which the number of classes leaves out."""
    counts = ngram_counts(df, cls, tokens(F.col(text), stop=stop), up_to)
    classes = df.agg(F.countDistinct(cls).alias("k"))
    spread = counts.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))  # a row for each class of a term
    kept = stored(spread.crossJoin(F.broadcast(classes)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("k"))), "terms")
    total = kept.groupBy("class").agg(F.sum("n").alias("total"))
    return beside(kept, total, "class").select("class", "term", "n", (F.col("n") / F.col("total") * F.log(1 + F.col("k") / F.col("df"))).alias("score"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group."""
    each = df.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("m"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


def embed(df: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """VEC1: vectors of texts by a pluggable encoder, each distinct text once; the encoder sees lists of texts, batch by batch."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{"_vector": encode(pdf["_text"].tolist())})

    once = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).distinct().mapInPandas(run, "_text string, _vector array<float>")
    return df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).join(once, "_text").withColumnRenamed("_vector", out).drop("_text")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_to_centroid(df: DataFrame, group: str, vector: str, k: int = 15, identifier: str = "id") -> DataFrame:
    """TXT2, TXT3: of each group the k rows nearest to its centroid."""
    c = df.join(centroids(df, group, vector), group).withColumn("cosine", cosine(F.col(vector), F.col("centroid"))).drop("centroid")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("cosine"), identifier)).cast("long")).filter(F.col("rank") <= k)


def principal(df: DataFrame, vector: str, dims: int, out: str) -> DataFrame:
    """The rows with the first principal components of a vector column without nulls; only a covariance matrix meets in one place."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=dims, inputCol="_x", outputCol="_p").fit(x).transform(x).withColumn(out, vector_to_array("_p")).drop("_x", "_p")


def cluster_vectors(df: DataFrame, vector: str, k: int, dims: int = 5, noise: float = 0.95, seed: int = 42) -> DataFrame:
    """VEC2, VEC3: (all columns, cluster_id, probability, outlier_score). Principal components stand in for a manifold projection, k-means with a distance limit for density clustering; both are approximations:
    rows farther from their centre than the given quantile of their cluster's distances are noise (-1)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    x = PCA(k=dims, inputCol="_x", outputCol="_p").fit(x).transform(x).drop("_x")
    model = KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="_c").fit(x)
    centers = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "_c int, _m array<double>")
    d = model.transform(x).withColumn("_p", vector_to_array("_p")).join(F.broadcast(centers), "_c")  # k rows
    d = d.withColumn("_d", F.sqrt(F.aggregate(F.zip_with("_p", "_m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
    limit = d.groupBy("_c").agg(F.percentile_approx("_d", noise).alias("_limit"), F.max("_d").alias("_far"))
    d = d.join(F.broadcast(limit), "_c")
    out = d.withColumns({"cluster_id": F.when(F.col("_d") > F.col("_limit"), -1).otherwise(F.col("_c")).cast("long"), "probability": 1 - F.coalesce(F.try_divide("_d", "_far"), F.lit(0.0)), "outlier_score": F.coalesce(F.try_divide("_d", "_far"), F.lit(0.0))})
    return out.drop("_c", "_p", "_m", "_d", "_limit", "_far")


def cluster_stats(df: DataFrame, cluster: str, probability: str, outlier: str) -> DataFrame:
    """AGG31, FLT8 (noise is cluster -1 and stays in as a row of its own)."""
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.avg(outlier).alias("mean_outlier"))
    return out.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def allocation(sizes: DataFrame, stratum: str, n: int) -> DataFrame:
    """SMP1: how many rows each stratum (stratum, size) gives to a sample of n: one each while n allows, the rest by size with half-even rounding, mended by the largest deficits or the largest cells."""
    w = Window.partitionBy()
    k = F.count(F.lit(1)).over(w)
    base = F.when(F.lit(n) >= k, 1).otherwise(0)
    rest = F.lit(n) - base * k
    share = F.col("size") / F.sum("size").over(w) * rest
    out = sizes.withColumns({"base": base, "rest": rest, "share": share}).withColumn("extra", F.bround("share", 0).cast("long"))
    out = out.withColumn("gap", F.col("rest") - F.sum("extra").over(w))
    up = F.row_number().over(Window.orderBy(F.desc(F.col("share") - F.col("extra")), stratum))
    down = F.row_number().over(Window.orderBy(F.desc("extra"), stratum))
    fixed = F.col("extra") + F.when((F.col("gap") > 0) & (up <= F.col("gap")), 1).when((F.col("gap") < 0) & (down <= -F.col("gap")), -1).otherwise(0)
    return out.withColumn("take", (F.col("base") + fixed).cast("long")).select(stratum, "size", "take")


def stratified_sample(df: DataFrame, stratum: str, identifier: str, score: str, n: int, seed: int = 42) -> DataFrame:
    """SMP1: rows with scores from the 40th percentile of their stratum on where those suffice, else any, picked by the md5 of seed and id. Identifiers are distinct; a null stratum is one.

    No stratum is gathered: the percentile is found by counting. As hashes are spread evenly, a bound on them that leaves a little more than the rows wanted is known beforehand;
    only what it leaves is placed, by ranges. A stratum that it leaves too few of (which chance hardly allows) is placed whole.
    """
    sizes = stored(allocation(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size")), stratum, n), "sizes")
    cuts = order_statistic(df, stratum, score, F.expr("(2 * (n - 1) + 4) div 5"), "_cut").withColumnRenamed(stratum, "_s")
    plan = stored(sizes.join(cuts, F.col(stratum).eqNullSafe(F.col("_s")), "left").select(stratum, "size", "take", "_cut"), "cuts")
    high = beside(df, plan.select(stratum, "_cut"), stratum).groupBy(stratum).agg(F.count_if(F.col(score) >= F.col("_cut")).alias("_high"))
    plan = beside(plan, high, stratum)
    enough = F.col("_high") >= F.col("take")
    share = (2 * F.col("take") + 8 * F.sqrt("take") + 64) / F.greatest(F.when(enough, F.col("_high")).otherwise(F.col("size")), F.lit(1))
    plan = stored(plan.select(stratum, "take", F.when(enough, F.col("_cut")).alias("_from"), F.least(share, F.lit(1.0)).alias("_share")), "plan")
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(identifier).cast("string"), F.lit("")))))
    pool = lambda p: beside(hashed, p, stratum).filter(F.col("_from").isNull() | (F.col(score) >= F.col("_from")))
    low = F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") / float(16**13) < F.col("_share")
    near = stored(pool(plan).filter((F.col("_share") >= 1) | low).select(*df.columns, "_h", "take"), "near")
    left = near.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_left"))
    short = stored(plan.join(left, F.col(stratum).eqNullSafe(F.col("_s")), "left").filter((F.col("_share") < 1) & (F.coalesce("_left", F.lit(0)) < F.col("take"))).select(*plan.columns), "short")
    if not short.isEmpty():
        kept = near.join(short.select(F.col(stratum).alias("_s")), F.col(stratum).eqNullSafe(F.col("_s")), "left_anti")
        near = kept.unionAll(pool(short).select(*df.columns, "_h", "take"))
    return place_within(near, [stratum], ["_h", identifier], "_place").filter("_place < take").select(*df.columns)


def uniform_sample(df: DataFrame, identifier: str, n: int, seed: int = 42) -> DataFrame:
    """SMP2: n rows by a seeded hash of the id; the same rows each time, in any engine."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(identifier).cast("string"))), identifier).limit(n)
