"""Golden values and edge cases of the operators."""

import itertools
import os
import random
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from litforge.functions import text as X
from litforge.operators import association as A
from litforge.operators import extraction, graph, laws, linkage, ranking, running, topics, trend
from litforge.operators.segments import candidates
from litforge.scratch import stored
from litforge.sources import records as R
from litforge.sources import sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(spark, values, expr):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").select("i", expr(F.col("c")).alias("x")).orderBy("i").select("x").collect()]


#: Published yearly counts with the values that follow from them.
YEARS = dict(zip(range(2005, 2026), [261, 262, 300, 277, 314, 340, 356, 423, 437, 501, 449, 453, 443, 467, 538, 550, 611, 591, 471, 632, 737], strict=True))


def test_trend_golden(spark):
    counts = frame(spark, list(YEARS.items()), "year long, n long")
    t = {r["year"]: r for r in trend.annual_trend(counts).collect()}
    assert t[2025]["cumulative"] == 9413 and round(t[2007]["pct_of_total"], 2) == 3.19
    assert round(t[2024]["yoy_growth_pct"], 1) == 34.2 and t[2005]["yoy_growth_pct"] is None
    assert round(t[2007]["rolling_mean"], 1) == 282.8 and t[2006]["rolling_mean"] is None and t[2024]["rolling_mean"] is None
    periods = [("a", 2005, 2010), ("b", 2011, 2017), ("c", 2018, 2023), ("d", 2024, 2025)]
    p = {r["period"]: r for r in trend.period_statistics(counts, periods).collect()}
    assert [round(p[k]["cagr_pct"], 1) for k in "abcd"] == [5.4, 3.7, 0.2, 16.6] and [p[k]["n_total"] for k in "abcd"] == [1754, 3062, 3228, 1369]
    assert trend.peak(counts).collect()[0]["peak_year"] == 2025


def test_fisher_golden(spark):
    cell = frame(spark, [("h", "m", 39, 59, 134, 846)], "row string, col string, n long, row_total long, col_total long, total long")
    r = A.fisher_cells(cell).collect()[0]
    assert round(r["expected"], 4) == 9.3452 and round(r["odds_ratio"], 4) == 14.2042 and r["p"] == pytest.approx(7.576e-20, rel=1e-3)


def test_fisher_against_exact_sums(spark):
    """Margins small and large, counts near and far from the mode; whole numbers in place of doubles."""
    from math import comb

    rows = [(f"{i}", r, c, t, n) for i, (r, c, t, n) in enumerate([(5, 7, 20, 3), (5, 7, 20, 0), (1, 1, 2, 1), (9, 9, 9, 9), (0, 4, 9, 0), (300, 500, 1000, 160), (300, 500, 1000, 100), (4000, 3000, 9000, 1400), (2000, 2000, 4000, 2000), (3, 100000, 200000, 3), (150, 160, 1000000, 4)])]
    df = spark.createDataFrame([(i, "c", n, r, c, t) for i, r, c, t, n in rows], "row string, col string, n long, row_total long, col_total long, total long")
    got = {r["row"]: r["p"] for r in A.fisher_cells(df).collect()}
    for i, r, c, t, n in rows:
        weights = [comb(r, x) * comb(t - r, c - x) for x in range(max(0, r + c - t), min(r, c) + 1)]
        own = weights[n - max(0, r + c - t)]
        p = sum(w for w in weights if w <= own) / sum(weights)
        assert got[i] == pytest.approx(p, rel=1e-6, abs=1e-290), (r, c, t, n)


def test_fisher_degenerate_and_zero(spark):
    rows = [("a", "x", 0, 0, 3, 10), ("b", "x", 3, 10, 3, 10), ("c", "x", 0, 4, 3, 10), ("d", "x", 3, 3, 3, 10)]
    df = frame(spark, rows, "row string, col string, n long, row_total long, col_total long, total long")
    p = {r["row"]: r["p"] for r in A.fisher_cells(df).collect()}
    assert p["a"] == p["b"] == 1.0 and p["d"] == pytest.approx(1 / 120) and p["c"] == pytest.approx(0.2)
    assert {r["row"] for r in A.fisher_cells(df, skip_degenerate=True).collect()} == {"c", "d"}


def test_bh_ties(spark):
    q = {r["i"]: r["q"] for r in A.bh_fdr(frame(spark, [(1, 0.01), (2, 0.02), (3, 0.02), (4, 1.0)], "i int, p double")).collect()}
    assert q == {1: pytest.approx(0.02666666, abs=1e-6), 2: pytest.approx(0.02666666, abs=1e-6), 3: pytest.approx(0.02666666, abs=1e-6), 4: 1.0}
    assert A.bh_fdr(frame(spark, [(1, 0.3)], "i int, p double")).collect()[0]["q"] == pytest.approx(0.3)


@pytest.fixture
def uncoalesced(spark):
    """Small tables in several ranges, as large ones would be."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def test_bh_by_brute_force(uncoalesced):
    """Families of which one is null and one holds most tests, ties, a null p, and ranges that cut families."""
    spark, rng = uncoalesced, random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), None if i % 50 == 7 else round(rng.random() ** 2, 2)) for i in range(600)]
    df = frame(spark, rows, "i int, f string, p double")

    def expected(ps):
        ps = sorted(ps)
        return {p: min([1.0] + [x * len(ps) / (k + 1) for k, x in enumerate(ps) if x >= p]) for p in ps}

    whole = expected([p for _, _, p in rows if p is not None])
    each = {f: expected([p for _, g, p in rows if g == f and p is not None]) for f in ("a", "b", None)}
    for family, want in (((), lambda f: whole), (("f",), lambda f: each[f])):
        got = A.bh_fdr(df, "p", *family).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["q"] is None if r["p"] is None else r["q"] == pytest.approx(want(r["f"])[r["p"]])


def test_places_over_ranges(uncoalesced):
    spark = uncoalesced
    rows = [(i, (i * 7919) % 101) for i in range(2000)]
    x = running.ranged(frame(spark, rows, "i int, n int"), F.desc("n"), "i")
    got = sorted((r["rank"], r["i"], r["upto"]) for r in running.placed(frame(spark, rows, "i int, n int"), [F.desc("n"), "i"], sums={"upto": "n"}).collect())
    order, upto = sorted(rows, key=lambda r: (-r[1], r[0])), 0
    assert x.select("_part").distinct().count() > 2 and len(got) == len(order)
    for (rank, i, total), (k, (j, n)) in zip(got, enumerate(order), strict=True):
        upto += n
        assert (rank, i, total) == (k + 1, j, upto)
    assert running.placed(frame(spark, [], "n int"), ["n"]).count() == 0


def test_trajectories(spark):
    rows = [(k, "m", e, 0.01 if b == "1" else 0.9, "enriched") for k in A.TRAJECTORIES for e, b in zip("abc", k, strict=True)]
    out = A.era_trajectory(frame(spark, rows, "row string, col string, era string, q double, direction string"), list("abc"))
    assert {r["row"]: r["trajectory"] for r in out.collect()} == A.TRAJECTORIES


@pytest.mark.parametrize("values,want", [([], None), ([0], 0), ([5] * 5, 5), ([10, 1], 1), ([None, 3, 3], 2)])
def test_h_index(spark, values, want):
    assert laws.h_index(frame(spark, [(v,) for v in values], "c int"), "c").collect()[0]["h_index"] == want


def test_bradford_edges(spark):
    got = {r["s"]: r["zone"] for r in laws.bradford(frame(spark, [("a",)] * 5 + [("b",), ("c",)], "s string"), "s").collect()}
    assert got == {"a": 1, "b": 3, "c": 3}
    assert laws.bradford(frame(spark, [], "s string"), "s").count() == 0


def test_names(spark):
    names = ["Wang, YH", "Wang Y.-H.", "Wang YH", "Yong Wang", "Van der Berg, P.", "WHO", "", None]
    got = column(spark, names, X.parse_person_name)
    assert [tuple(x) if x else None for x in got] == [("Wang", "Y")] * 4 + [("Van der Berg", "P"), None, None, None]
    assert frame(spark, [("Müller-Lüdenscheid", "K")], "s string, i string").select(X.make_fini(F.col("s"), F.col("i"))).collect()[0][0] == "mller_ldenscheid_k"


def test_titles_and_keywords(spark):
    assert column(spark, ["Background: Abstract: X", "Abstract: Background: X", "Été, l'eau!", "", None], X.normalize_title) == ["abstract x", "x", "été l eau", "", ""]
    assert column(spark, ["Ｃｙｐ３Ａ４", "St. John–wort [*use]", "123", "ab", None, "  'aspirin';"], X.normalize_keyword) == ["cyp3a4", "st. john-wort", None, None, None, "aspirin"]
    assert column(spark, ["https://DOI.org/10.1/AB", " ", None], X.normalize_doi) == ["10.1/ab", None, None]
    assert column(spark, ["Unknown ", "x ", None], X.null_if_in) == [None, "x ", None]
    assert column(spark, ["CYP3A4, P-gp and (UGT)", None], X.split_entities) == [["cyp3a4", "p-gp", "ugt"], []]


def test_countries(spark):
    f = lambda c: X.extract_countries(c, {"japan": "JP", "china": "CN"}, {"hong kong": "HK", "taiwan": "TW"})
    assert column(spark, ["Hong Kong, China", "Beijing, China; Hong Kong", "Tokyo, Japan", "", None], f) == [["HK"], ["CN", "HK"], ["JP"], [], []]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_indel_ratio_and_prefilter(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("a", ""), (None, "a")] + [("".join(rng.choices("abc ", k=rng.randint(1, 30))), "".join(rng.choices("abc ", k=rng.randint(1, 30)))) for _ in range(300)]
    out = frame(spark, pairs, "a string, b string").select("a", "b", X.indel_ratio(F.col("a"), F.col("b")).alias("r"), X.safe_prefilter(F.col("a"), F.col("b"), 70.0).alias("s")).collect()
    for r in out:
        if r["a"] is None:
            assert r["r"] is None
            continue
        n = len(r["a"]) + len(r["b"])
        want = 200.0 * brute_lcs(r["a"], r["b"]) / n if n else 100.0
        assert r["r"] == pytest.approx(want) and (want < 70 or r["s"])


def test_block_pairs_and_components(spark):
    rows = [(1, "x", "alpha beta"), (2, "x", "alpha beta"), (3, "x", "alpha betb"), (4, "y", "alpha beta"), (5, "x", "zzz"), (6, "x", None)]
    df = frame(spark, rows, "id long, b string, t string")
    pairs = linkage.block_pairs(df, "id", ["b"], "t", 80.0)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2), (1, 3)}
    chain = frame(spark, [(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in linkage.connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert linkage.connected_components(chain.limit(0)).count() == 0


def test_thesaurus_by_brute_force(spark):
    rng = random.Random(8)
    words = sorted({" ".join(rng.choices(["herb", "herbs", "drug", "drugs", "cyp", "effect"], k=rng.randint(1, 3))) for _ in range(60)})
    n = {w: rng.randint(1, 9) for w in words}
    k = frame(spark, list(n.items()), "keyword string, n long")
    ratio = lambda a, b: 200.0 * brute_lcs(a, b) / (len(a) + len(b))
    sort = lambda w: " ".join(sorted(w.split()))
    want = {}
    for w in words:
        near = sorted((-ratio(sort(w), sort(c)), -n[c], c) for c in words if n[c] > n[w] and ratio(sort(w), sort(c)) >= 88)
        want[w] = [c for _, _, c in near[:10]]
    got = {}
    for r in linkage.suggest_thesaurus(k, 88.0).orderBy("keyword", "place").collect():
        got.setdefault(r["keyword"], []).append(r["canonical"])
    assert got == {w: c for w, c in want.items() if c} and len(got) > 5
    never = [(w, c[0]) for w, c in want.items() if c][:1]
    built = {r["alias"]: r["canonical"] for r in linkage.build_thesaurus(k, frame(spark, [("zz", "herb")], "alias string, canonical string"), 88.0, frame(spark, [never[0][::-1]], "alias string, canonical string")).collect()}
    links = {w: c[0] for w, c in want.items() if c and (w, c[0]) != never[0]} | {"zz": "herb"}

    def end(w):
        while w in links:
            w = links[w]
        return w

    assert built == {w: end(w) for w in links}


def test_folder_without_setting(tmp_path):
    """A session of a fresh process whose configuration names no checkpoint folder stores its tables all the same."""
    code = "from litforge.scratch import session, stored; s = session(cores='1', partitions=1); assert not s.conf.get('spark.checkpoint.dir', None); print(stored(stored(s.range(3))).count())"
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    run = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.stdout.strip().endswith("3"), run.stderr[-2000:]


def test_repeated_alias(spark):
    df, m = frame(spark, [("a",), ("b",), (None,)], "v string"), frame(spark, [("a", "y"), ("a", "x"), ("a", None), ("c", "z"), (None, "n")], "alias string, canonical string")
    assert sorted((r["v"] or "", r["o"] or "") for r in linkage.map_values(df, "v", m, "o").collect()) == [("", ""), ("a", "x"), ("b", "b")]


def test_label_propagation_by_hand(spark):
    edges = [("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("x", "y", 5), ("y", "z", 5), ("x", "z", 5), ("c", "x", 1)]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {v: v for v in near}
    for _ in range(4):
        new = {}
        for v, around in near.items():
            weight = {}
            for u, w in around:
                weight[label[u]] = weight.get(label[u], 0) + w
            new[v] = min(weight, key=lambda c: (-weight[c], c))
        label = new
    got = {r["node"]: r["community"] for r in graph.label_propagation(frame(spark, edges, "a string, b string, n long"), 4).collect()}
    assert got == label


def test_survivorship_ties(spark):
    rows = [("k", "B", 2, "long text", 1, None), ("k", "A", 3, "x", None, "m"), ("k", "A", 1, "x", 5, None), ("j", "A", 9, "y", None, None)]
    df = frame(spark, rows, "key string, db string, id long, abstract string, cites long, mesh string")
    prio = F.when(F.col("db") == "A", 0).otherwise(1)
    out = {r["key"]: r for r in linkage.survivorship(df, "key", [prio, -F.length("abstract"), F.col("id")], "db", "id", ["cites"], {"mesh": ("A", "mesh")}).collect()}
    assert out["k"]["id"] == 1 and out["k"]["cites"] == 5 and out["k"]["mesh"] == "m" and out["k"]["source_list"] == ["A", "B"] and out["k"]["n_merged"] == 3
    assert out["j"]["cites"] is None


def test_reconcile_keeps_null_keys(spark):
    main = frame(spark, [(1, "a", 2025), (2, "b", 2026), (3, "c", 2026), (4, None, 2026)], "id long, key string, year int")
    part = frame(spark, [(5, "b", 2026), (6, "a", 2026), (7, None, 2026), (8, None, 2026), (9, "d", 2026), (10, "d", 2026)], "id long, key string, year int")
    m, p = linkage.reconcile(main, part, "key", F.col("id"), F.col("year") == 2026)
    assert {r["id"] for r in m.collect()} == {1} and {r["id"] for r in p.collect()} == {5, 3, 4, 7, 8, 9}


def test_closure_with_cycle(spark):
    m = frame(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "w"), ("w", "x"), ("in", "y"), ("z", "z")], "alias string, canonical string")
    got = {r["alias"]: r["canonical"] for r in linkage.close_mapping(m).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "x": "w", "y": "w", "in": "w"}
    assert linkage.close_mapping(m.filter("alias < 'd'")).count() == 3 and linkage.close_mapping(m.limit(0)).count() == 0


def partitions(items):
    if not items:
        yield []
        return
    for p in partitions(items[1:]):
        for i in range(len(p)):
            yield [*p[:i], [items[0], *p[i]], *p[i + 1 :]]
        yield [[items[0]], *p]


def score(edges, parts):
    m = sum(w for _, _, w in edges)
    home = {n: i for i, p in enumerate(parts) for n in p}
    k = [sum(w * ((home[a] == i) + (home[b] == i)) for a, b, w in edges) for i in range(len(parts))]
    return sum(w for a, b, w in edges if home[a] == home[b]) / m - sum((x / (2 * m)) ** 2 for x in k)


def test_louvain_and_modularity(spark):
    edges = [(a, b, 3) for a, b in itertools.combinations("abc", 2)] + [(a, b, 3) for a, b in itertools.combinations("defg", 2)] + [("c", "d", 1)]
    df = frame(spark, edges, "a string, b string, n long")
    parts = graph.louvain(df)
    got = {}
    for r in parts.collect():
        got.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["d", "e", "f", "g"]]
    q = graph.modularity(df, parts).collect()[0]["modularity"]
    assert q == pytest.approx(max(score(edges, p) for p in partitions(list("abcdefg"))))


@pytest.mark.parametrize("one_task", [0, 60])
def test_louvain_rounds(spark, one_task):
    """Rounds in which all move at once give no less modularity than node by node, lose no node, and number communities by size."""
    rng = random.Random(2)
    edges = [(f"n{a:02d}", f"n{b:02d}", rng.randint(1, 3)) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.4 if a % 4 == b % 4 else 0.04)] + [("n00", "n00", 2), ("loop", "loop", 1), ("p", "q", 1)]
    df = frame(spark, edges, "a string, b string, n long")
    alone, rounds = graph.louvain(df), stored(graph.louvain(df, one_task=one_task))
    value = lambda m: graph.modularity(df, m).first()["modularity"]
    assert value(rounds) >= value(stored(alone)) - 1e-9 and value(rounds) > 0.3
    home = {r["node"]: r["community"] for r in rounds.collect()}
    assert set(home) == {x for a, b, _ in edges for x in (a, b)}
    sizes = Counter(home.values())
    assert sorted(sizes) == list(range(len(sizes))) and [sizes[c] for c in range(len(sizes))] == sorted(sizes.values(), reverse=True)
    assert graph.louvain(df.limit(0), one_task=one_task).count() == 0
    assert {r["node"] for r in graph.louvain(df, least=3, one_task=one_task).collect()} == {n for n in home if sizes[home[n]] >= 3}


@pytest.mark.parametrize("metric,threshold", [("indel", 86.0), ("levenshtein", 80.0), ("indel", 60.0)])
def test_segment_index_by_brute_force(spark, metric, threshold):
    """One block of 3,000 texts, of which the index looks at few pairs and misses none; all pairs are held against a bound from their letters first."""
    rng = random.Random(4)
    n = 3000 if threshold > 70 else 300
    letters = "abcdefghijklmnopqrstuvwxyz "
    words = ["".join(rng.choices(letters[:26], k=rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(2, 8))) for _ in range(n * 3 // 4)]
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(rng.randint(1, 6)):
            p = rng.randrange(len(t) + 1)
            t[p : p + rng.randint(0, 1)] = rng.choice(["", *letters])
        texts.append("".join(t))
    texts = list(dict.fromkeys([*texts, "", "a", "ab", "abc"]))
    count = np.array([[t.count(c) for c in letters] for t in texts])
    size = count.sum(1)
    want = set()
    for i in range(len(texts)):
        common = np.minimum(count[i], count[:i]).sum(1)
        far = 200.0 * common / np.maximum(size[i] + size[:i], 1) if metric == "indel" else 100.0 * common / np.maximum(np.maximum(size[i], size[:i]), 1)
        for j in np.flatnonzero(far >= threshold - 1e-9).tolist():
            a, b = texts[j], texts[i]
            value = 200.0 * brute_lcs(a, b) / (len(a) + len(b)) if metric == "indel" else 100.0 * (1 - brute_levenshtein(a, b) / max(len(a), len(b)))
            if value >= threshold:
                want.add((j, i))
    df = frame(spark, [(i, "x", t) for i, t in enumerate(texts)], "id long, b string, t string")
    assert {(r["a"], r["b"]) for r in linkage.block_pairs(df, "id", ["b"], "t", threshold, metric, direct=0).collect()} == want and len(want) > 50
    if threshold > 70:
        assert candidates(df, ["b"], "id", "t", threshold, metric).count() < 0.02 * len(texts) * (len(texts) - 1) / 2


def brute_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_block_pairs_mixes_both_ways(spark):
    """Hot and small blocks in one table, and null texts and blocks, give what small blocks alone do."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice([None, "", *["".join(rng.choices("abc", k=rng.randint(3, 7))) for _ in range(4)]])) for i in range(300)]
    df = frame(spark, rows, "id long, b string, t string")
    plain, mixed = (Counter(tuple(r) for r in linkage.block_pairs(df, "id", ["b"], "t", 70.0, direct=d).collect()) for d in (10**9, 100))
    assert plain == mixed and len(plain) > 100
    with pytest.raises(ValueError):
        linkage.block_pairs(df, "id", ["b"], "t", 50.0)


def test_bursts_by_brute_force(spark):
    import math

    r, d, s, gamma = [1, 1, 6, 7, 1, 1], [10] * 6, 2.0, 1.0
    rows = [("w", t) for t, k in enumerate(r) for _ in range(k)] + [("o", t) for t in range(6) for _ in range(d[t] - r[t])]
    out = {x["item"]: x for x in graph.bursts(frame(spark, rows, "i string, t int"), "i", "t", s, gamma).collect()}
    p0 = sum(r) / sum(d)
    p = (p0, min(0.9999, p0 * s))
    cost = lambda k, i: -(math.lgamma(d[i] + 1) - math.lgamma(r[i] + 1) - math.lgamma(d[i] - r[i] + 1) + r[i] * math.log(p[k]) + (d[i] - r[i]) * math.log(1 - p[k]))
    up = gamma * math.log(len(r) + 1)
    path = min(itertools.product((0, 1), repeat=6), key=lambda q: sum(cost(k, i) for i, k in enumerate(q)) + up * sum(b > a for a, b in zip((0, *q), q, strict=False)))
    on = [i for i, k in enumerate(path) if k]
    assert (out["w"]["first"], out["w"]["last"]) == (on[0], on[-1])


def test_pathfinder_by_brute_force(spark):
    rng = random.Random(5)
    for most in (2, 1000):
        edges = {(a, b): rng.randint(1, most) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.6}
        best = {(a, b): 0 for a in range(9) for b in range(9)}
        for (a, b), n in edges.items():
            best[a, b] = best[b, a] = n
        for k, a, b in itertools.product(range(9), repeat=3):
            best[a, b] = max(best[a, b], min(best[a, k], best[k, b]))
        got = {(int(r["a"]), int(r["b"])): r["n"] for r in graph.pathfinder(frame(spark, [(str(a), str(b), n) for (a, b), n in edges.items()], "a string, b string, n long")).collect()}
        assert got == {e: n for e, n in edges.items() if best[e] <= n}


def test_cursor_pull(spark):
    """A call that fails once, a query that is too broad, one that breaks off, and works that two queries find."""
    failed = []

    def page(q, cursor, size):
        at = cursor or 0
        if q == "broken" and at:
            raise OSError("gone")
        if at == 4 and at not in failed:
            failed.append(at)
            raise TimeoutError("slow")
        return [f'{{"id": {i}}}' for i in range(at, min(at + size, 9))], at + size if at + size < 9 else None

    works, report = R.pull(spark, ["one", "two", "broad", "broken"], {"one": 9, "two": 9, "broad": 80_001, "broken": 9}.get, page, size=4, wait=0.0)
    assert sorted(int(r["key"]) for r in works.collect()) == list(range(9))
    assert {tuple(r) for r in report.collect()} == {("one", 9, 9, "done"), ("two", 9, 9, "done"), ("broad", 80_001, 0, "skipped"), ("broken", 9, 4, "OSError: gone")}


def test_affiliation_matcher(spark):
    seen = []

    def lookup(x):
        seen.append(x)
        if x == "down" or x == "slow" and seen.count(x) < 3:
            raise OSError("no answer")
        return {"none": []}.get(x, [{"id": "1", "score": 0.2}, {"id": "2", "score": 0.9}, {"id": "3", "score": 0.9}, {"id": "4", "score": 0.1, "chosen": x == "picked"}])

    df = frame(spark, [("none",), ("best",), ("best",), ("picked",), ("slow",), ("down",), (None,), ("",)], "s string")
    got = {r["text"]: (r["matched"], r["id"], r["score"], r["error"]) for r in linkage.match_affiliations(df, "s", lookup, retries=3, wait=0.0).collect()}
    assert got == {"none": (False, None, None, None), "best": (True, "2", 0.9, None), "picked": (True, "4", 0.1, None), "slow": (True, "2", 0.9, None), "down": (False, None, None, "OSError: no answer")}
    done = frame(spark, [("best", None), ("picked", None), ("down", "OSError: no answer")], "text string, error string")
    assert {r["text"] for r in linkage.match_affiliations(df, "s", lookup, done, retries=3, wait=0.0).collect()} == {"none", "slow", "down"}


def test_agreement_extremes(spark):
    same = A.agreement(frame(spark, [("a", 1), ("a", 1), ("b", 2), (None, 1)], "x string, y int"), "x", "y").collect()[0]
    assert same["n"] == 3 and same["ari"] == pytest.approx(1) and same["nmi"] == pytest.approx(1)
    assert A.majority_vote(frame(spark, [(1, "b"), (1, "a"), (2, None)], "r int, l string"), "r", "l").collect() == [(1, "a")]


def test_allocation_and_samples(spark):
    sizes = frame(spark, [("a", 1), ("b", 10), ("c", 989)], "s string, size long")
    assert {r["s"]: r["take"] for r in topics.allocation(sizes, "s", 50).collect()} == {"a": 1, "b": 1, "c": 48}
    assert sum(r["take"] for r in topics.allocation(sizes, "s", 2).collect()) == 2
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("s"), F.col("id").cast("double").alias("p"))
    one, two = (sorted(r["id"] for r in topics.stratified_sample(df, "s", "id", "p", 30).collect()) for _ in range(2))
    assert one == two and len(one) == 30 and min(one) >= 398
    assert topics.uniform_sample(df, "id", 7).count() == 7


def test_ctfidf_bigrams(spark):
    df = frame(spark, [("a", "red green red"), ("b", "red green blue"), ("c", None), ("d", "blue stone")], "k string, t string")
    got = {(r["class"], r["term"]): r["n"] for r in topics.ctfidf(df, "k", "t").collect()}
    assert got == {("a", "red"): 2, ("a", "green"): 1, ("a", "red green"): 1, ("b", "red"): 1, ("b", "green"): 1, ("b", "red green"): 1, ("b", "blue"): 1, ("d", "blue"): 1}


def test_ctfidf_long_texts_and_no_class(spark):
    words = [f"{a}{b}{c}x" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwyz"] * 80
    df = frame(spark, [("a", " ".join(words)), ("b", " ".join(words)), ("c", "red"), (None, "akux akvx")], "k string, t string")
    began = time.time()
    got = {(r["class"], r["term"]): r["n"] for r in topics.ctfidf(df, "k", "t", max_df=1.0).collect()}
    assert time.time() - began < 40  # the words of a text were found again for each of them
    want = Counter(words) + Counter(f"{x} {y}" for x, y in zip(words, words[1:]))
    assert got == {(c, t): n for c in "ab" for t, n in want.items()} | {(None, "akux"): 1, (None, "akvx"): 1, (None, "akux akvx"): 1}


GOOD = '{"record_id": "r", "contains_hdi": true, "interactions": [{"interaction_type": "both", "mechanism": "other", "direction": "no_change", "evidence_type": "review", "clinical_significance": "low", "confidence": 0.5, "evidence_quote": "ten chars and more", "co_herbs": []}], "extraction_notes": null}'


def test_validation(spark):
    bad = GOOD.replace("0.5", "1.5").replace('"both"', '"new"')
    rows = [(0, GOOD), (1, bad), (2, '{"record_id": "r", "x": 1}'), (3, "no json"), (4, None)]
    out = extraction.validate_json(frame(spark, rows, "i int, j string"), "j").orderBy("i").collect()
    assert [r["valid"] for r in out] == [True, False, False, False, False]
    assert set(out[1]["errors"]) == {"interaction_type", "confidence"} and "extra x" in out[2]["errors"] and "missing interactions" in out[2]["errors"]
    assert extraction.strip_schema_keywords({"title": "t", "properties": {"title": {"type": "s", "default": 1}}, "anyOf": [{"format": "x", "type": "y"}]}) == {"properties": {"title": {"type": "s"}}, "anyOf": [{"type": "y"}]}


TAGGED = """﻿FN Clarivate
VR 1.0
PT J
AU Wang, YH
   Li, Q
TI A long
   title here
C1 [Wang, YH] Univ A, Beijing, China.
   Univ B, Tokyo, Japan.
ZZ kept
DT Article; Review
PY n.d.
UT WOS:1
ER

PT J
AU Solo
TI Second
PY 2001
TC 12
DI https://doi.org/10.1/X
DT Article
UT WOS:2
ER

EF"""


def test_sources(spark, tmp_path):
    (tmp_path / "wos_batch_1.txt").write_text(TAGGED, encoding="utf-8")
    raw = R.read_tagged(spark, str(tmp_path / "wos_batch_*.txt"))
    assert raw.filter("fields['wos_ZZ'] = 'kept'").count() == 1
    u = {r["record_id"]: r for r in R.from_tagged(raw).collect()}
    assert set(u) == {"WoS:WOS:1", "WoS:WOS:2"}
    a, b = u["WoS:WOS:1"], u["WoS:WOS:2"]
    assert a["authors"] == ["Wang, YH", "Li, Q"] and a["title"] == "A long title here" and a["doc_type"] == "Review" and a["year"] is None and a["doi"] is None and a["affiliations_raw"].count("\n") == 1
    assert b["year"] == 2001 and b["cited_by"] == 12 and b["doi"] == "10.1/x" and b["first_author_lastname"] == "Solo" and b["doc_type"] == "Article"
    (tmp_path / "s.csv").write_text('DOI,Year,Authors,Title,Document Type,References\n10.1/A,2001,"Liu K., Xu Z.","A ""quoted""\ntitle",Review of Article,a; b\n,,,,,\n', encoding="utf-8")
    s = R.from_scopus(R.read_csv_records(spark, str(tmp_path / "s.csv"))).collect()
    assert s[0]["authors"] == ["Liu K.", "Xu Z."] and s[0]["doc_type"] == "Article" and s[0]["references_count"] == 2 and s[0]["title"] == 'A "quoted"\ntitle'
    assert s[1]["doi"] is None and s[1]["doc_type"] == "Unknown"
    (tmp_path / "o.jsonl").write_text('{"id":"https://openalex.org/W1","authorships":null,"abstract_inverted_index":{"b":[1],"a":[0,2]},"type":"book-chapter"}\n\n{broken\n', encoding="utf-8")
    o = R.from_works(R.read_jsonl(spark, str(tmp_path / "o.jsonl"), R.WORKS)).collect()
    assert len(o) == 1 and o[0]["abstract"] == "a b a" and o[0]["source_id"] == "W1" and o[0]["authors"] == []
    (tmp_path / "p.jsonl").write_text('{"pmid":"7","authors":["Smith J"],"publication_types":["Journal Article","Review"],"language":[],"doi":null}\n', encoding="utf-8")
    p = R.from_pubmed(R.read_jsonl(spark, str(tmp_path / "p.jsonl"), R.PUBMED)).collect()[0]
    assert p["doc_type"] == "Review" and p["first_author_lastname"] == "Smith" and p["language"] == "" and p["mesh_terms"] == []
    assert R.unify(R.from_tagged(raw), R.from_pubmed(R.read_jsonl(spark, str(tmp_path / "p.jsonl"), R.PUBMED))).columns == R.UNIFIED.fieldNames()
    inv = R.file_inventory(spark, {"WoS": (str(tmp_path / "wos_batch_1.txt"), "tagged"), "O": (str(tmp_path / "o.jsonl"), "jsonl")})
    assert {r["database"]: r["record_count"] for r in inv.collect()} == {"WoS": 2, "O": 2}


def test_results_and_graphml(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"record_id":"a","ok":true,"extraction":' + GOOD + '}\n{"record_id":"b","ok":false,"extraction":null}\nnot json\n', encoding="utf-8")
    res = R.read_jsonl(spark, str(tmp_path / "r.jsonl"), extraction.RESULT)
    assert {(r["record_id"], r["ok"], r["n_interactions"]) for r in extraction.record_rows(res).collect()} == {("a", True, 1), ("b", False, 0)}
    assert [(r["record_id"], r["interaction_idx"], r["mechanism"], r["co_herbs"]) for r in extraction.flatten_interactions(res).collect()] == [("a", 0, "other", "")]
    sinks.write_graphml(frame(spark, [("a&b", "x"), ("c", None)], "node_id string, kind string"), frame(spark, [("a&b", "c", 2)], "src string, dst string, w int"), str(tmp_path / "g"))
    import xml.etree.ElementTree as E

    doc = E.fromstring("\n".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*"))))
    tags = [e.tag.split("}")[1] for e in doc.iter()]
    assert tags.count("node") == 2 and tags.count("edge") == 1


def test_overlap_and_coverage(spark):
    df = frame(spark, [(["b", "a"], "x", None), (["a", "b", "a"], "x", " "), ([], "y", "t")], "s array<string>, g string, v string")
    assert {r["combo"]: r["n"] for r in ranking.overlap_counts(df, "s").collect()} == {"a+b": 2, "": 1}
    assert {r["g"]: (r["n"], r["n_v"]) for r in ranking.coverage(df, "g", ["v"]).collect()} == {"x": (2, 0), "y": (1, 1)}


def test_schema_helpers_and_encoder(spark):
    df = frame(spark, [("x", 1), (None, 2)], "Priority string, order_key long")
    assert extraction.find_column(df, ["nothing", "PRIORITY"]) == "Priority" and extraction.find_column(df, ["nothing"]) is None and extraction.columns_like(df, ["KEY"]) == ["order_key"]
    out = topics.embed(df, "Priority", lambda xs: [[float(len(x)), 1.0] for x in xs]).collect()
    assert {(r["order_key"], tuple(r["embedding"])) for r in out} == {(1, (1.0, 1.0)), (2, (0.0, 1.0))}
    a = X.split_affiliations(F.col("s"), F.col("raw"), F.array(F.lit("N"), F.lit("N")))
    rows = frame(spark, [("WoS", "[A] U.\nU\nV"), ("Scopus", "U; V."), ("OpenAlex", None), ("PubMed", "U")], "s string, raw string").select("s", a.alias("a")).collect()
    assert {r["s"]: r["a"] for r in rows} == {"WoS": ["U", "V"], "Scopus": ["U", "V"], "OpenAlex": ["N"], "PubMed": []}


def test_library_stands_without_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for f in (root / "litforge").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "litforge.llm" not in f.read_text(), f


def test_chains_keep_all_categories(spark):
    pairs = spark.createDataFrame([("f", "s", None)], "family string, species string, compound string")
    none = spark.createDataFrame([], "entity string, category long, sig boolean")
    out = A.hierarchy_chains(pairs, spark.range(10_050).withColumnRenamed("id", "category"), dict.fromkeys(("family", "species", "compound"), none))
    assert out.count() == 10_050


def test_inverted_index(spark):
    from litforge.functions import text as X

    rows = [(1, ["b", "a", "b", "é", "a", "b"]), (2, []), (3, None), (4, ["x"]), (5, [""]), (1, ["b"])]
    x = spark.createDataFrame(rows, "id int, w array<string>").select("id", "w", X.inverted_index(F.col("w")).alias("m"), X.inverted_index_text(X.inverted_index(F.col("w"))).alias("t"))
    for r in x.collect():
        want = None if r.w is None else {w: [i for i, v in enumerate(r.w) if v == w] for w in r.w}
        assert r.m == want and r.t == " ".join(r.w or [])


def test_schemas_as_texts(spark):
    from litforge.operators.extraction import strip_schema_text

    x = spark.createDataFrame([('{"title": "ä", "properties": {"format": {"format": "x", "anyOf": [{"pattern": "y"}, 1]}}}',), (None,), ("[]",)], "s string")
    assert [r[0] for r in x.select(strip_schema_text(F.col("s"))).collect()] == ['{"properties": {"format": {"anyOf": [{}, 1]}}}', None, "[]"]
