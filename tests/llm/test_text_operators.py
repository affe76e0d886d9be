"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from litforge.llm import divergence, queries
from litforge.llm.divergence import source_divergence
from litforge.llm.infill import Chunks, fill_in_middle, restored
from litforge.llm.token_counts import PrefixCounter, prefix_counts, tokens_of, truncated, within_budget

BYTE = queries.tokenizer("byte_bpe_50k.json")
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(11)
    rows = [(7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "one"), (11, "one"), (None, "no id at all"), (12, "<P>"), (13, "a <S> b"), (14, "<M"), (15, "日本 É ½\n\nΣ 𝒳 x"), (16, "é" * 9000), (17, "x" * 5000), (18, "<|endoftext|> 's x'll <|endof")]
    return rows + [(100 + i, "".join(rng.choices(["ab", " ", "\n", "é", "<", "S>", "日", "word "], k=rng.randint(1, 60)))) for i in range(150)]


def units(text, unit):
    if unit == "char":
        return list(text)
    cut = r"(?<=[ \t-\r])(?=[^ \t-\r])" if unit == "word" else r"(?<=\n)"
    return [u for u in re.split(cut, text) if u]


@pytest.mark.parametrize("unit,chunk", [("char", 4096), ("char", 7), ("word", 5), ("line", 3)])
def test_fill_in_middle(spark, odd_rows, unit, chunk):
    df = spark.createDataFrame(odd_rows, DOC).repartition(3)
    x = fill_in_middle(df.withColumns({"id": F.lit(1), "form": F.lit("f"), "h1": F.lit(0), "plain": F.lit(2)}), unit=unit, chunk=chunk)
    got = x.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = []
    for i, t in odd_rows:
        t = t or ""
        u = units(t, unit)
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        lo, hi = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
        if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((i, len(u), "plain", None, None, t, t))
        elif h[3] % 100 < 20:
            want.append((i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_edges(spark):
    assert fill_in_middle(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], DOC)
    assert {r["form"] for r in fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fill_in_middle(df, rate=100, spm=100).collect()} == {"spm"}
    other = fill_in_middle(df, markers=("[pre]", "[suf]", "[mid]"), rate=100, seed=5)
    assert other.filter(restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")) == F.concat(F.lit("text "), "doc_id")).count() == 200
    for bad in (("<a><", "<b>", "<c>"), ("<a>", "x<a>y", "<c>"), ("<a>", "<a>", "<c>"), ("", "<a>", "<c>")):
        with pytest.raises(ValueError):
            fill_in_middle(df, markers=bad)


def test_only_owning_chunks_are_scanned_again():
    text = ("word " * 4000).encode()
    c = Chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]), "word", 100)
    scanned, plain = [], c.flags
    c.flags = lambda lo, hi: scanned.append((lo, hi)) or plain(lo, hi)
    assert c.units.tolist() == [4000] and c.place(np.array([0, 0]), np.array([1234, 4000])).tolist() == [6170, len(text)]
    assert scanned == [(61, 62)]


ALPHABET = ["a", "b", "the ", " ", "  ", "\n", "\t", "'", "'re", "'ll", "'s", "'r", "é", "日本", "١", "½", "!", "=", "-- ", "<|endoftext|>", "<|endof", "Hello", " 12", "aaaa", "İ", "𝒳", "\U0001fae9", "\U00016d40", "'v", " ", " "]


def test_every_prefix_as_the_library_counts_it():
    counter, rng = PrefixCounter(BYTE), random.Random(3)
    texts = ["", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "  <|endoftext|>  ", "a" * 400, "abcde" * 80, "=" * 300, "x'rex  'll", "éé" * 90]
    texts += ["".join(rng.choices(ALPHABET, k=rng.randint(1, 25))) for _ in range(150)]
    for _ in range(2):  # new words, then known ones
        counts, bounds = counter.prefix_counts(texts)
        for i, t in enumerate(texts):
            assert counts[bounds[i] : bounds[i + 1]].tolist() == [len(counter.library.encode(t[:j], add_special_tokens=False).ids) for j in range(len(t) + 1)], t
        counter.words.most = 50  # the table starts anew all the time


def test_token_counts(spark, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    long = "".join(random.Random(2).choices(ALPHABET, k=30_000))
    rows = [*odd_rows, (19, long), (20, "abcdefgh" * 20_000)]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], DOC + ", n_bytes int, counts string")
    x = prefix_counts(df, BYTE).select("doc_id", "n_bytes", tokens_of("counts").alias("n"), F.size("counts").alias("size"), tokens_of("counts", 7).alias("seven"), within_budget("counts", 4).alias("four"))
    got = Counter(tuple(r) for r in x.collect())
    best = lambda t: max(j for j in range(min(len(t), 400) + 1) if count(t[:j]) <= 4)  # noqa: E731  no text here has so few tokens in more characters, but for the repeated ones
    known = {i: r for i, *r in got}
    for i, t in rows:
        t = t or ""
        n_bytes, n, size, seven, four = known[i]
        assert (n_bytes, n, size, seven) == (len(t.encode()), count(t), len(t) + 1, count(t[:7]))
        assert four == best(t)
    assert sum(got.values()) == len(rows)


def test_token_budget(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "x")], DOC)
    x = prefix_counts(df, BYTE).join(df, "doc_id")
    assert {r["doc_id"]: r["t"] for r in x.select("doc_id", truncated("text", "counts", 2).alias("t")).collect()} == {1: "one two", 2: "", 3: "x"}
    assert {r["t"] for r in x.select(truncated("text", "counts", 0).alias("t")).collect()} == {""}
    assert prefix_counts(spark.createDataFrame([], DOC), BYTE).count() == 0
    with pytest.raises(ValueError):
        PrefixCounter(queries.tokenizer("word_bpe_49k.json"))


def audit(rows, least=3, top=200):
    docs = [((x or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for x, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = sorted((w for w in df if df[w] >= least), key=str.encode)
        count = defaultdict(Counter)
        for _, s, words in mine:
            count[s].update(w for w in words if df[w] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in count if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1)]
    return Counter(out)


@pytest.mark.parametrize("chunk_rows,small,cells", [(1 << 17, 4 << 20, 1 << 21), (7, 0, 1 << 21), (50, 0, 4)])
def test_source_divergence(spark, chunk_rows, small, cells):
    rng = random.Random(chunk_rows)
    words = ["the", "The", "ÉTÉ", "été", "naïve", "日本", "x\u0080y", "don't", "a1b", "zz", "\U0001f600", "Ünder_score", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", "Z", None, "a b"]), rng.choice([None, "", "...", " ".join(rng.choices(words, k=rng.randint(1, 30)))])) for _ in range(160)]
    rows += [("solo", "only", "a a a b"), ("rare", "one", "never seen"), ("rare", "two", None), ("rare", None, "twice"), ("en", "big", " ".join(rng.choices(words, k=20_000)))] + [rows[3]] * 4
    rows += [("tie", s, "p q r s") for s in "abcd"] + [("tie", s, "p q") for s in "abc"]
    df = spark.createDataFrame([(*r, 3, "t", 4) for r in rows], "lang string, source string, text string, n int, term string, v int").repartition(5)
    got = Counter(tuple(r) for r in source_divergence(df, chunk_rows=chunk_rows, small=small, top=6, cells=cells).collect())
    assert got == audit(rows, top=6)


def test_source_divergence_empty(spark):
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_billionths():
    rng = random.Random(1)
    for top in (10, 10**6, 10**12, 8 * 10**15):
        whole = rng.randint(1, top)
        counts = np.array([0, whole - 1, *[rng.randrange(whole) for _ in range(20)]])
        assert divergence.billionths(counts, whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in counts.tolist()]
