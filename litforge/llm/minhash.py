"""Operator 1: near-duplicate groups by SetSketch.

Each text's set of word shingles gives a sketch of REGISTERS registers: the minimum of independent exponential variables over the set, on a logarithmic scale of base BASE,
truncated to 16 bits. Sketches of parts merge by maximum, so texts of any length are sketched in parts. Four registers make a band, one 64-bit value.

1. Texts with equal sets form a class; its smallest id stands for it from here on.
2. Representatives that share a band value are candidates. First each one is held against one leader: of each bucket the member that meets most others leads, as it lies nearest to the
   origin of a group of copies; of the leaders it meets, a member takes the one it shares most bands with. That links large groups with as many checks as members.
   Then, where a bucket still has several components, members outside its largest one are held against that component's members in such buckets and against each other, in blocks that give no
   more links than they have texts.
3. The likelihood of the three register counts (greater, less, equal), given both set sizes, is taken jointly at its maximum and at the threshold; pairs
   that are lower by more than DOUBT go.
4. The rest are verified on their full sets. Components of the links that hold are the groups.

A pair at similarity 0.8 escapes all 32 bands with probability 5e-8. All pairs of a bucket that are not yet connected are checked, so nothing else is lost.
Cases: null, empty and blank texts have no set and no links; null ids are kept and link with nothing; rows that share an id are one
node, so an id joins the groups of all its texts; repeated rows give repeated rows; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.llm.common import materialise, mix64, ragged, slices, small_batches, utf8_of
from litforge.llm.components import components
from litforge.llm.shingles import shingle_sets

REGISTERS, BAND = 128, 4
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
DOUBT = 18.0
BLOCK = 256
_rows = 4096
_a = (mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_b = (mix64(np.arange(1001, REGISTERS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions over each set; sets are taken in parts and merged."""
    x = (values >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full((len(bounds) - 1, REGISTERS), 0xFFFFFFFF, np.uint32)
    room = np.empty((_rows, REGISTERS), np.uint32)
    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for at in range(lo, hi, _rows):
            part = room[: min(hi, at + _rows) - at]
            np.multiply(x[at : at + len(part)], _a, out=part)
            part += _b
            np.minimum(out[i], part.min(axis=0), out=out[i])
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Registers of the sketch: minima of uniform values become minima of exponential ones, then their place on the scale."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, key_a, key_b, bands): set size, a 128-bit digest of the set, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values, bounds = shingle_sets(*utf8_of(part.column("text")), k)
            total = [np.r_[np.uint64(0), np.cumsum(mix64(values ^ np.uint64(s)), dtype=np.uint64)] for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            keys = [(t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total]
            packed = registers(minima(values, bounds)).astype("<u2").view("<i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(packed) + 1) * packed.shape[1], pa.int32()), pa.array(packed.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), *map(pa.array, keys), lists], ["doc_id", "n", "key_a", "key_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, key_a long, key_b long, bands array<long>")


def expected(share: np.ndarray) -> np.ndarray:
    """p_b(x): probability that one register exceeds another, from the share of the union that only the first set holds."""
    return -np.log1p(-np.clip(share, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likely(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the joint likelihood leaves room for a similarity of the threshold or more."""
    more, less = (first > second).sum(1), (first < second).sum(1)
    same = first.shape[1] - more - less
    u, v = n_first / (n_first + n_second), n_second / (n_first + n_second)
    most = np.minimum(u / v, v / u)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = expected(u - v * j), expected(v - u * j)
        tiny = 1e-12
        return more * np.log(p + tiny) + less * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, tiny))

    lo, hi = np.zeros(len(u)), most.copy()
    for _ in range(40):  # the likelihood is concave in the similarity
        third = (hi - lo) / 3
        left = log_likelihood(lo + third) < log_likelihood(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    best = (lo + hi) / 2
    return (most >= threshold - 1e-9) & ((best >= threshold) | (log_likelihood(best) - log_likelihood(np.minimum(threshold, most)) <= DOUBT))


def estimated(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that the sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = REGISTERS // BAND
        for batch in batches:
            if batch.num_rows:
                x, y = (np.asarray(batch.column(c).flatten()).astype("<i8").view("<u2").reshape(-1, REGISTERS)[: batch.num_rows] for c in ("bands_a", "bands_b"))
                assert len(x) == batch.num_rows and width
                ok = likely(x, y, *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    sides = [table.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bands").alias(f"bands_{s}")) for s in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "bands_a", "bands_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets meet the threshold exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            values, bounds = shingle_sets(*utf8_of(batch.column("text_b")), k)
            ids, column, ok = batch.column("a").to_pylist(), batch.column("text_a"), []
            for i, a in enumerate(ids):
                # rows come in order of a; an id may stand for several texts
                if a != last or i == 0 or column[i] != column[i - 1]:
                    known, last = shingle_sets(*utf8_of(column.slice(i, 1)), k)[0], a
                other = values[bounds[i] : bounds[i + 1]]
                both = 0
                if len(known) and len(other):
                    small, large = (known, other) if len(known) < len(other) else (other, known)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int(np.count_nonzero(large[at] == small))
                ok.append(both > 0 and 100 * both >= percent * (len(known) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def within_components(meeting: DataFrame, table: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join texts to a component they meet and to each other. meeting has (target, id, component): the members of buckets with several components, by the largest one there.
    Those of other components are visitors. Two texts that share a bucket meet the same largest component, so every pair that is still open lies in one target.

    Of a component, only members that share a bucket with a visitor come here. They and the visitors are cut into blocks of BLOCK by hash; a pair of blocks is one key, so no component is
    gathered in one task. Each visitor is held against those it shares a band with and the likelihood allows, unless links found in the task connect them already: a task gives no more links
    than it has texts.
    """
    visitors = meeting.filter("component <> target")
    size = lambda df, name: df.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    # stored, so that Spark knows its size and a common component is not dealt to one task
    blocks = materialise(size(visitors, "visits").join(size(meeting, "homes"), "target"), "blocks")
    mine = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = F.col("component").alias("own")
    home = meeting.join(blocks, "target").select("target", mine("homes").alias("home"), every("visits").alias("visit"), F.lit(0).alias("role"), "id", own)
    visit = visitors.join(blocks, "target").select("target", every("homes").alias("home"), mine("visits").alias("visit"), F.lit(1).alias("role"), "id", own)
    rows = home.unionAll(visit)
    rows = rows.join(table.select(F.col("doc_id").alias("id"), "bands"), "id").join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    keys = ["target", "home", "visit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, stacked = None, [], None
        ids = roots = sizes = flat = bounds = None
        joined: dict[int, int] = {}  # components that links of this task joined

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        for batch in batches:
            if not batch.num_rows:
                continue
            values, ends = shingle_sets(*utf8_of(batch.column("text")), k)
            sketch = np.asarray(batch.column("bands").flatten()).reshape(batch.num_rows, -1)
            out: list[tuple[int, int]] = []
            fields = zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), *(batch.column(c).to_pylist() for c in ("role", "id", "own")), strict=True)
            for i, (key, role, id_, component) in enumerate(fields):
                if key != now:
                    now, held, stacked, joined = key, [], None, {}
                mine_ = values[ends[i] : ends[i + 1]]
                if role == 0:
                    held.append((id_, component, sketch[i].copy(), mine_.copy()))
                    continue
                if not held:
                    continue
                if stacked is None:
                    ids, roots, stacked = np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held])
                    sizes, flat = np.array([len(h[3]) for h in held]), np.concatenate([h[3] for h in held])
                    bounds = np.cumsum(sizes) - sizes
                n, me = len(mine_), root(component)
                at = np.flatnonzero((roots != me) & (100 * sizes >= percent * n) & (100 * n >= percent * sizes))
                at = at[(stacked[at] == sketch[i]).any(1)]
                if len(at):
                    x = np.repeat(np.ascontiguousarray(sketch[i]).view("<u2")[None], len(at), 0)
                    at = at[likely(x, np.ascontiguousarray(stacked[at]).view("<u2"), np.full(len(at), float(n)), sizes[at].astype(float), percent / 100)]
                while len(at):
                    part, at = at[:64], at[64:]
                    other = flat[ragged(bounds[part], sizes[part])]
                    hit = mine_[np.minimum(np.searchsorted(mine_, other), n - 1)] == other
                    both = np.add.reduceat(hit, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
                    for j in part[100 * both >= percent * (n + sizes[part] - both)].tolist():
                        if roots[j] != me:
                            out.append((min(id_, int(ids[j])), max(id_, int(ids[j]))))
                            joined[int(roots[j])] = me
                            roots[roots == roots[j]] = me
                    at = at[roots[at] != me]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    # costly rows: as many tasks as there are, however few bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "role").select(*keys, "role", "id", "own", "bands", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. docs is read more than once, so it should be a stored table."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    table = materialise(sketches(rows, k), "sketches")
    usable = table.filter("n > 0 and doc_id is not null")
    keys = ["key_a", "key_b", "n"]
    classes = materialise(usable.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes.withColumnRenamed("rep", "doc_id"), [*keys, "doc_id"], "left_semi").dropDuplicates(["doc_id", *keys])
    ratio = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)

    bands = reps.select(F.col("doc_id").alias("id"), "n", F.posexplode("bands").alias("band", "value"))
    shared = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = materialise(bands.join(shared, ["band", "value"]), "met")
    central = met.groupBy("id").agg(F.sum("c").alias("meets"))
    led = met.join(central, "id")
    leaders = led.groupBy("band", "value").agg(F.max_by(F.struct("id", "n"), F.struct("meets", -F.col("id"))).alias("leader"))
    members = materialise(met.drop("c").join(leaders, ["band", "value"]), "members")
    texts = materialise(rows.join(members.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id", "text"]), "candidate-texts")
    small = reps.select("doc_id", "n", "bands")

    votes = members.filter((F.col("id") != F.col("leader.id")) & ratio("n", "leader.n")).groupBy(F.col("leader.id").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
    first = materialise(votes.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", "b"), "first-pairs")
    links = materialise(verified(estimated(first, small, percent / 100), texts, k, percent), "links")

    # an id with several sets joins the classes of all of them
    sets = usable.select("doc_id", *keys).distinct()
    several = sets.join(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "doc_id")
    same = several.join(classes, keys).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    known = components(links.unionAll(same))
    placed = members.drop("leader").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tally = placed.groupBy("band", "value", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = tally.groupBy("band", "value").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("target"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    meeting = materialise(placed.join(mixed, ["band", "value"]).select("target", "id", "component").distinct(), "meeting")
    more = materialise(within_components(meeting, small, texts, k, percent), "links")

    found = components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))
    heads = classes.join(found, F.col("rep") == F.col("id"), "left").select(*keys, F.coalesce("component", "rep").alias("group"))
    out = table.drop("bands").join(heads, keys, "left")
    group = F.when(F.col("n") > 0, F.coalesce("group", "doc_id")).otherwise(F.col("doc_id"))
    alone = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(group)
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.cast("long").alias("component_id"), F.coalesce(F.col("doc_id") == alone, F.lit(True)).alias("kept"))
