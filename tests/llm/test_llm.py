"""The ten operators and the pipeline against brute force, round trips and held-out labels, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from litforge.llm import common, media, minhash, packing, quality, queries, shingles, warc
from litforge.llm.components import components
from litforge.llm.bpe import SpeculativeEncoder, encode_decode
from litforge.llm.embed_dedup import near_vectors
from litforge.llm.encoder import Encoder
from litforge.llm.html_template import BODY, Page, ascending, deduced, host, main_texts, occurrences
from litforge.llm.line_dedup import remove_repeats
from litforge.llm.token_files import read_token_files, write_token_files

BYTE, WORD = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def rng_words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs():
    rng = random.Random(5)
    base = " ".join(rng_words(rng, 60))
    long = " ".join(rng_words(rng, 30_000))
    rows = [(7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "one"), (12, "One"), (13, base), (14, base), (13, base), (15, base.replace(" ", "\n") + " tail"), (None, base), (16, long), (17, long + " end"), (18, "<|endoftext|> 's x's 日本 É ½"), (19, "ΑΣ ΣΑΣ İ \r\n  x")]
    return rows + [(20 + i, " ".join(rng_words(rng, 40))) for i in range(20)]


def sets(rows, k):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def groups(rows, k, percent):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [(i, x) for i, x in sets(rows, k) if i is not None and x]
    for n, (i, x) in enumerate(s):
        for j, y in s[:n]:
            if 100 * len(x & y) >= percent * len(x | y):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, odd_docs, k):
    rng = random.Random(k)
    rows = list(odd_docs)
    for g in range(6):
        w = rng_words(rng, 150, "abcdefghijklmnop")
        for c in range(12):
            v = list(w)
            for _ in range(rng.randint(0, 14)):
                v[rng.randrange(len(v))] = "x" + str(rng.randrange(10**6))
            rows.append((1000 + 50 * g + c, " ".join(v)))
    rng.shuffle(rows)
    got = minhash.near_duplicates(common.materialise(spark.createDataFrame(rows, DOC), "t"), k).collect()
    want, sizes = groups(rows, k, 80), Counter((i, len(s)) for i, s in sets(rows, k))
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    for r in got:
        assert (r["component_id"], r["kept"]) == ((None, True) if r["doc_id"] is None else (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]))


def test_minhash_shared_ids(spark):
    """An id with several texts joins the groups of all of them; columns with clashing names are left alone."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(rng_words(rng, 80, "abcdefghijklmnop")) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (2, b), (9, c + " x"), (8, c), (9, d), (7, d + " y"), (9, None), (6, "")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOC + ", component int, n int, bands int")
    got = minhash.near_duplicates(common.materialise(df, "t")).collect()
    want = {3: 2, 5: 2, 2: 2, 8: 7, 7: 7, 6: 6}
    assert Counter((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] != 9) == Counter((i, want[i]) for i, _ in rows if i != 9)
    assert sorted(r["component_id"] for r in got if r["doc_id"] == 9) == [7, 7, 9] and {r["n_shingles"] for r in got if r["component_id"] == 9} == {0}


def test_minhash_empty(spark):
    assert minhash.near_duplicates(common.materialise(spark.createDataFrame([], DOC), "t")).count() == 0


def test_likelihood():
    rng = np.random.default_rng(1)
    make = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    for j, want in ((0.8, True), (0.9, True), (0.2, False), (0.4, False)):
        both = int(1000 * 2 * j / (1 + j))
        shared = make(both)
        x, y = np.r_[shared, make(1000 - both)], np.r_[shared, make(1000 - both)]
        r = minhash.registers(minhash.minima(np.r_[x, y], np.array([0, 1000, 2000])))
        assert minhash.likely(r[:1], r[1:], np.array([1000.0]), np.array([1000.0]), 0.8)[0] == want


def test_sketches_merge():
    x = np.random.default_rng(2).integers(0, 1 << 63, 9000, dtype=np.uint64) * np.uint64(2)
    whole, parts = minhash.minima(x, np.array([0, 9000])), minhash.minima(x, np.array([0, 5000, 9000]))
    assert (minhash.registers(whole)[0] == minhash.registers(parts).max(0)).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5)] + [(1000 + i, 1001 + i) for i in range(30)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts_for_tokenizers():
    rng = random.Random(9)
    letters = list(" \n\t  '''sStTdmreveLLl09٣½ΣσςİıßÉ日本&*.,-_<|> ́🙂") + ["<|endoftext|>", " 's", "'re", "  ", "\r\n", "aaaa", "====", "tion"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(1500)] + ["a" * n for n in range(40)] + [" " * n for n in range(90)] + ["ab" * 30]


@pytest.mark.parametrize("cls,path,kind", [(Encoder, BYTE, "byte"), (Encoder, WORD, "word"), (SpeculativeEncoder, BYTE, "byte")])
def test_encoders_match_library(cls, path, kind):
    enc, texts = cls(path, kind), texts_for_tokenizers()
    for lo in range(0, len(texts), 200):
        part = texts[lo : lo + 200]
        ids, bounds = enc.encode(part)
        for i, t in enumerate(part):
            want = enc.library.encode(t, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want, t
            if cls is SpeculativeEncoder:
                assert enc.decode(np.array(want, np.int64)) == enc.library.decode(want, skip_special_tokens=False)
    enc.words.most = 50  # a full table starts anew and gives the same
    again, _ = enc.encode(texts[:400])
    fresh, _ = cls(path, kind).encode(texts[:400])
    assert (again == fresh).all()


def test_bpe_round_trip(spark, odd_docs):
    lib = SpeculativeEncoder(BYTE).library
    got = Counter(map(tuple, encode_decode(spark.createDataFrame(odd_docs, DOC), BYTE).collect()))
    want = Counter()
    for i, t in odd_docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want


def test_token_files(spark, odd_docs):
    lib = Encoder(BYTE, "byte").library
    folder = common.shared_dir(spark, "t")
    manifest = write_token_files(spark.createDataFrame(odd_docs, DOC), folder, BYTE)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], list(r["ids"])) for r in read_token_files(manifest, folder, digest_only=False).collect()]
    want, at = [], 0
    for i, t in sorted(odd_docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    root = Path(folder.removeprefix("file://"))
    assert not list(root.glob("*.part")) and sum(p.stat().st_size for p in root.glob("*.bin")) == 2 * at
    empty = write_token_files(spark.createDataFrame([], DOC), common.shared_dir(spark, "t"), BYTE)
    assert read_token_files(empty, folder).count() == 0


def test_other_tokenizer_files(spark, tmp_path, odd_docs):
    """A file of another kind is left to the library, and a vocabulary over 16 bits is written in 32."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(Path(BYTE).read_text())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    top = max(spec["model"]["vocab"].values())
    spec["model"]["vocab"] |= {f"<unused {i}>": top + 10 + i for i in range(70_000)}
    spec["added_tokens"].append({"id": 200_000, "content": "xyzzy", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = str(tmp_path / "wide.json")
    Path(path).write_text(json.dumps(spec))
    lib, rows = Tokenizer.from_file(path), [*odd_docs, (99, "a xyzzy b")]
    folder = common.shared_dir(spark, "t")
    manifest = write_token_files(spark.createDataFrame(rows, DOC), folder, path)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in read_token_files(manifest, folder, digest_only=False).collect())
    assert got == Counter((i, (*lib.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows) and {r["width"] for r in manifest.collect()} == {4}
    assert any(x >= 1 << 16 for (_, ids) in got for x in ids)
    with pytest.raises(ValueError):
        SpeculativeEncoder(path)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc(spark):
    a, b = "x" * 150 + "é", "y" * 99
    rows = [(3, "http://h/a b\n", a), (1, "http://h/1", a), (2, None, a), (1, "http://h/1", a), (4, "http://h", b), (5, "http://h", b), (6, "http://h", None), (7, "h", ""), (None, "http://n", a), (8, "u", "z" * 100), (9, "u", "z" * 100)]
    got = Counter(map(tuple, warc.archived(pages_of(spark, rows)).collect()))
    digest = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = Counter()
    for i, _, h in rows:
        n, first = len((h or "").encode()), {a: 1, "z" * 100: 8}.get(h)
        again = first is not None and n >= 100 and i != first
        want[(i, n, digest(h), "revisit" if again else "response", first if again else None)] += 1
    assert got == want
    assert warc.archived(pages_of(spark, [])).count() == 0


def test_warc_common_payload(spark):
    """One payload on a third of all rows, null and repeated ids, long payloads, columns with clashing names."""
    big = "z" * 3_000_000
    rows = [(i, f"u{i}", "p" * 200 if i % 3 else f"q{i}" * 60) for i in range(300)] + [(5, "u", "r" * 200), (5, "u", "p" * 200), (400, "u", big), (401, "u", big), (None, "u", big)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, original int")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived(df).collect())
    first = {"p" * 200: 1, big: 400}
    assert got == Counter((i, len(h), "revisit" if first.get(h, i) != i else "response", first[h] if first.get(h, i) != i else None) for i, _, h in rows)


def test_warc_detects_damage():
    import gzip
    import io

    good = warc.record(1, "u", "x" * 300, hashlib.sha256(b"x" * 300).hexdigest(), None, "d")
    head, block = warc.parse(next(warc.members(io.BytesIO(good))))
    assert head["warc-type"] == "response" and block.endswith(b"x" * 300)
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(io.BytesIO(good[:-20])))
    with pytest.raises(ValueError):
        warc.parse(gzip.decompress(good)[:-3])


@pytest.mark.parametrize("seed", range(8))
def test_packing_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 64, 2048])
    histogram = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 30, 3000])))
    used, places = defaultdict(list), Counter()
    for length, rank, ranks, first, each, offset in packing.plan(dict(histogram), capacity):
        assert ranks and rank == places[length]
        places[length] += ranks
        for k in range(ranks):
            used[first + k // each].append((offset + k % each * length, length))
    assert places == histogram
    for pieces in used.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
    rooms = []  # plain best-fit decreasing
    for n in sorted(histogram.elements(), reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    assert len(used) <= len(rooms) + 1 and sorted(used) == list(range(len(used)))


def test_packing(spark, odd_docs):
    lib = Encoder(WORD, "word").library
    got = packing.packed(spark.createDataFrame(odd_docs, DOC), WORD, capacity=256).collect()
    want = Counter()
    for i, t in odd_docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seq.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 256
    assert packing.packed(spark.createDataFrame([], DOC), WORD).count() == 0


def test_ogg_pages():
    bits = lambda data: __import__("functools").reduce(lambda c, b: _step(c ^ b << 24), data, 0)

    def _step(c):
        for _ in range(8):
            c = (c << 1 ^ 0x104C11DB7) if c & 0x80000000 else c << 1
        return c & 0xFFFFFFFF

    assert media.checksum(b"OggS", b"\0abc") == bits(b"OggS\0abc")
    packets = [(b"head", 0), (bytes(1000), 1000), (b"x" * 255 * 300, 2000), (b"", 2000), (b"y" * 255, 3000)]
    pages = media.paged(9, packets)
    data = b"".join(p for _, p in pages)
    s = media.streams(data)[9]
    assert s.packets == [p for p, _ in packets] and s.granules[-1] == 3000
    other = media.paged(4, [(b"h", 0), (b"zz", 5)])
    mixed = pages[0][1] + other[0][1] + b"".join(p for _, p in pages[1:]) + other[1][1]
    assert media.streams(mixed)[4].packets == [b"h", b"zz"] and media.streams(mixed)[9].packets == s.packets
    for bad in (data[:100] + bytes([data[100] ^ 1]) + data[101:], data[: len(pages[0][1])] + b"".join(p for _, p in pages[2:]), b"".join(p for _, p in pages[:-1]), b"junk" + data):
        with pytest.raises(ValueError):
            media.streams(bad)
    assert media.times([-1, 20, -1, 40], [b"x" * 10] * 4) == [10 / 8000, 20 / 8000, 30 / 8000, 40 / 8000]


def test_media(spark, odd_docs):
    rows = media.media_columns(spark.createDataFrame(odd_docs, DOC), keep_media=True).collect()
    texts = defaultdict(list)
    for i, t in odd_docs:
        texts[i].append(t or "")
    for r in rows:
        raw = texts[r["doc_id"]][0].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] == len(r["media"]) and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and media.restored(bytes(r["media"]))[0] == payload
    assert len(rows) == len(odd_docs)
    x = spark.createDataFrame([(7, "abc", b"z", 1)], "doc_id long, text string, media binary, n_bytes long")
    out = media.media_columns(x).collect()
    assert [(r["doc_id"], r["n_bytes"], r["payload_bytes"]) for r in out] == [(7, 3, 576)] and media.media_columns(x.limit(0)).count() == 0
    broken = media.media_table(x).selectExpr("doc_id", "n_bytes", "concat(substring(media, 1, octet_length(media) - 1), X'FE') as media")  # the last byte is of a sample or caption, another before
    with pytest.raises(Exception, match="another checksum"):
        media.described(broken).collect()


def own_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


OWN_BYTE = [own_mix(i + 1) for i in range(256)]


def own_lines(t, breaks_only=False):
    """Line ends found word by word, without arrays: (first byte, line) of each."""
    raw = t.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    sentences, cuts = [], set()
    for i, (a, _) in enumerate(words):
        if not i or b"\n" in raw[words[i - 1][1] : a] or not breaks_only and raw[words[i - 1][1] - 1] in b".!?":
            sentences.append([])
        sentences[-1].append(i)
    code = [sum(OWN_BYTE[c] for c in raw[a:b]) for a, b in words]
    for s in sentences:
        cuts.add(s[0])
        for at in range(0 if breaks_only else len(s) - 12):
            # before which of the twelve words the pair of words has the smallest hash; the last of equal ones
            cuts.add(min(s[at + 1 : at + 13], key=lambda i: (own_mix((code[i - 1] * 0xA24BAED4963EE407 + code[i]) % 2**64) % 2**63 >> 24, -i)))
    at = sorted(cuts)
    return [(words[i][0], raw[words[i][0] : words[j - 1][1]]) for i, j in zip(at, at[1:] + [len(words)], strict=False)]


def brute_lines(rows, lines=3, breaks_only=False):
    """Whole strings in place of hashes: for each row, its text and the number of lines removed. Places are (id, line)."""
    units = [own_lines(t or "", breaks_only) for _, t in rows]
    first, out = {}, []
    for (i, _), u in zip(rows, units, strict=True):
        for p in range(len(u) - lines + 1) if i is not None else ():
            key = tuple(x for _, x in u[p : p + lines])
            first[key] = min(first.get(key, (i, p)), (i, p))
    for (i, t), u in zip(rows, units, strict=True):
        gone = {q for p in range(len(u) - lines + 1) if i is not None and first[tuple(x for _, x in u[p : p + lines])] != (i, p) for q in range(p, p + lines)}
        raw = (t or "").encode()
        ends = [a for a, _ in u[1:]] + [len(raw)]
        out.append((t if not gone else (raw[: u[0][0]] + b"".join(raw[u[q][0] : ends[q]] for q in range(len(u)) if q not in gone)).decode(), len(gone)))
    return out


def test_sentence_units():
    t = "A b. C d!  E\nf g.h i?\n\nJ"
    s, e, w, b = shingles.sentence_units(np.frombuffer((t + t).encode(), np.uint8), np.array([0, len(t), 2 * len(t)]))
    assert [(t + t)[x:y] for x, y in zip(s, e, strict=True)] == ["A b.", "C d!", "E", "f g.h i?", "J"] * 2 and w.tolist() == [2, 2, 1, 3, 1] * 2 and b.tolist() == [0, 5, 10]


def test_line_dedup(spark, odd_docs):
    rng = random.Random(4)
    line = lambda: " ".join(rng_words(rng, rng.randint(1, 9))) + rng.choice([".", "!", "\n", "?"])
    passage = [line() for _ in range(12)]
    rows = [(500 + i, " ".join([line() for _ in range(5)] + (passage[i % 3 :] if i % 2 else []) + [line() for _ in range(4)])) for i in range(30)]
    rows += [*odd_docs, (600, "Es. Er. Of. " * 50), (601, "same three words here. and a second one here. a third one is here. " * 3)]
    # short windows, one id with different and with equal texts, the same window at equal and at other lines of it
    rows += [(700, "a b c.\nd e f.\ng h i."), (701, "a b c.\nd e f.\ng h i."), (702, "x. y. z. w."), (702, "x. y. z. v."), (702, "u. x. y. z."), (702, "u. x. y. z."), (703, "one"), (703, " ".join(passage)), (703, None), (None, "x. y. z. w.")]
    rng.shuffle(rows)
    df = common.materialise(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cover string, c1 int"), "t")
    got = remove_repeats(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "cover", "c1", "n_lines", "n_removed"} and {(r["cover"], r["c1"]) for r in got} == {("x", 1)}
    want = Counter((i, *x, len(own_lines(t or ""))) for (i, t), x in zip(rows, brute_lines(rows), strict=True))
    assert Counter((r["doc_id"], r["text"], r["n_removed"], r["n_lines"]) for r in got) == want
    assert sum(r["n_removed"] > 0 for r in got) >= 14 and {r["text"] for r in got if r["doc_id"] in (701,)} == {""}
    assert remove_repeats(common.materialise(df.limit(0), "t")).count() == 0


def test_line_dedup_pipeline_table(spark):
    """The whole table of the smallest scale, against the brute force and, for line breaks alone, against SQL."""
    import duckdb

    df = common.table(spark, DATA, "documents", "doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_lines(rows), strict=True))
    assert Counter((r["doc_id"], r["text"], r["n_removed"]) for r in remove_repeats(df).collect()) == want
    sql = f"""
        WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS raw, generate_subscripts(regexp_split_to_array(text, '\n'), 1) AS place FROM '{DATA}/documents.parquet'),
        n AS (SELECT doc_id, trim(raw, ' \t\r') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS p FROM l WHERE trim(raw, ' \t\r') <> ''),
        w AS (SELECT doc_id, p, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
        f AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w WHERE c IS NOT NULL) WHERE k > 1),
        g AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM f, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(g.n, 0)::INT FROM '{DATA}/documents.parquet' d LEFT JOIN g USING (doc_id)"""
    removed = dict(duckdb.sql(sql).fetchall())
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(df, breaks_only=True).collect()} == removed and sum(removed.values())


def test_line_dedup_cut_passages(spark):
    """Passages of 50 words and more that begin and end within a sentence, or have no sentences, lose words wherever they stand."""
    rng = random.Random(9)
    prose = lambda n, stops: " ".join(w + ("." if rng.random() < stops else "") for w in rng_words(rng, n, "abcdefghijklmnop"))
    passages = [prose(n, stops) for n in (50, 61, 120) for stops in (0, 0.03, 0.1) for _ in range(20)]
    bare = prose(70, 0)
    rows = [(2 * k + c, f"{prose(rng.randint(1, 30), 0.1)} {p} {prose(rng.randint(1, 30), 0.1)}") for k, p in enumerate(passages) for c in range(2)] + [(1000, bare), (1001, bare)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(common.materialise(spark.createDataFrame(rows, DOC), "t")).collect()}
    lost = {i: len(t.split()) - len(got[i].split()) for i, t in rows}
    assert not any(lost[2 * k] for k in range(len(passages))) and got[1000] == bare
    assert all(lost[2 * k + 1] >= max(10, len(p.split()) - 48) for k, p in enumerate(passages)) and lost[1001] >= 50


def test_features_stand_alone():
    """A text's features do not depend on its neighbours."""
    texts = ["", "A b.", "WORD!! WORD!! x", "été | b | c |\nnew line 12", " " * 5, "a a a a b b"]
    import pyarrow as pa

    whole = quality.features(*common.utf8_of(pa.array(texts)))
    for i, t in enumerate(texts):
        one = quality.features(*common.utf8_of(pa.array([t])))[0]
        assert np.allclose(whole[i], one) and np.isfinite(one).all()


def test_quality_held_out(spark):
    import duckdb

    from_dir = "/root/testdata/sf0.1"
    out = queries.op9_quality_classifier(spark, from_dir).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"select doc_id, quality from '{from_dir}/labels.parquet'").df().set_index("doc_id")
    both = out.join(labels, how="inner")
    assert len(out) == 10_000 and out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in out.held_out.items())
    held = both[both.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None]).mean()
    assert auc > 0.97 and (good >= 0.3).mean() > 0.98


def test_quality_repeated_ids(spark):
    """Rows that share an id give one row to fit on."""
    docs = common.materialise(spark.createDataFrame([(1, "A b c."), (1, "X y."), (1, None), (2, "d e f."), (2, "d e f.")], DOC), "t")
    ids = docs.select("doc_id").distinct()
    assert quality.gathered(docs, ids).shape[0] == 2


def test_quality_edges(spark):
    docs = common.materialise(spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, "")], DOC), "t")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = quality.quality(docs, none).collect()
    assert len(out) == 4 and {r["score"] for r in out} == {0.5} and [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    assert quality.quality(docs.limit(0), none).count() == 0
    kept = quality.keep_good(docs.selectExpr("doc_id", "text", "1 as score", "2 as c0"), none)
    assert kept.columns == ["doc_id", "text", "score", "c0"] and kept.count() == 4


def test_html_roles():
    page = Page(
        '<!DOCTYPE html><html><head><title>t</title></head><body><header>H</header><nav>n</nav><div class="side-bar sidebar">s</div><main><h1>T &amp; U</h1><p>a &lt;b&gt; <b>c</b>\n d<ul><li>x<li>y</ul>'
        '<section id="comments"><p>bad</section><form>f</form><div class=cookie-notice>n</div><script>"</p>"</script><!-- c --><p hidden>z</p>tail<br>end</main><footer>f</footer>'
    )
    assert page.main().split("\n\n") == ["T & U", "a <b> c d", "x", "y", "tail end"]
    assert Page("").main() == "" and Page("plain &eacute;").main() == "plain é" and Page("<p>one<p>two").main() == "one\n\ntwo"


def test_html_names_hide_no_article():
    body = "<article><h1>T</h1><p>one</p></article>"
    for name in ("layout has-sidebar", "elementor-widget", "widget", "content-sidebar-wrap"):
        assert Page(f"<div class='{name}'>{body}</div><div class=widget>w</div>").main() == "T\n\none"
    assert Page("<article><p class='related-work'>a</p><p>b <math><mi>x</mi></math> <svg><text>s</text></svg></p><div class='related-posts'>r</div><div class=comments><article>c</article></div></article>").main() == "a\n\nb x s"
    assert Page("<h1>Title</h1><p>by</p><article>t</article><h1>next</h1><div class=related><article>teaser</article></div>").main() == "Title\n\nt"
    long = " ".join(f"w{i}" for i in range(200_000))
    assert Page(f"<nav>n</nav><article><p>{long}<p>{long}</article>").main() == f"{long}\n\n{long}"


def test_html_forms_and_names_in_articles():
    body = "<h1>T</h1><p>one two three</p>"
    for page in (f"<form id=aspnetForm><article>{body}</article></form>", f"<form id=aspnetForm><div>{body}</div><div class=sidebar>s</div><nav>n</nav></form><div>x</div>", f"<form><h1>T</h1><article><p>one two three</p></article></form>"):
        assert Page(page).main() == "T\n\none two three"
    assert Page(f"<div>{body}</div><form><p>your name and your address, please</p></form>").main() == "T\n\none two three"
    assert Page(f"<article>{body}<form><p>mail</p></form></article><form><h1>Sign up</h1><p>{'long ' * 50}</p></form>").main() == "T\n\none two three"
    kept = "<section id=discussion><h2 id=related>D</h2><p class='text menu'>e</p></section><section class=discussion><p>f</p></section><div class='content widget'>g</div>"
    gone = "<section id=comments><p>x</p></section><div class=comment-list>x</div><div class=share>x</div><div id=related-posts>x</div><section class=related>x</section><div class=notice>x</div>"
    assert Page(f"<article>{body}{kept}{gone}</article>").main() == "T\n\none two three\n\nD\n\ne\n\nf\n\ng"


def test_html_nothing_beside_an_article(spark):
    """Teasers beside the article vary from page to page, yet are none of it; the heading before it is."""
    rows = [(i, f"http://a.example/{i}", f"<body><p>Site</p><h1>T {i}</h1><article><p>Own text of page {i} is here.</p></article><div class=teaser><p>Read also {i}</p></div></body>") for i in range(12)]
    for r in main_texts(common.materialise(pages_of(spark, rows), "t")).collect():
        assert r["text"] == f"T {r['page_id']}\n\nOwn text of page {r['page_id']} is here."


def test_ascending():
    rng = random.Random(1)
    for _ in range(200):
        v = [rng.randrange(9) for _ in range(rng.randrange(9))]
        run = ascending(v)
        most = max((len(c) for m in range(1 << len(v)) if (c := [x for i, x in enumerate(v) if m >> i & 1]) == sorted(set(c))), default=0)
        assert [v[i] for i in run] == sorted({v[i] for i in run}) and run == sorted(run) and len(run) == most


@pytest.mark.parametrize("n", [1, 5, 20])
def test_html_template(spark, n):
    """Without an article element only the template tells what is common; one page tells none. Rotating notices lie in a slot that does not vary."""
    long, own = "Our terms apply to each of these pages. " * 20, lambda i: " ".join(f"Text number {i} is here." for _ in range(60))
    body = lambda i: f"<html><body><div><p>Welcome to our site</p></div><i>tip {i % 2}</i><div><h1>Title {i}</h1><p>{own(i)}</p><p>Share this</p></div><div>{long}</div></body></html>"
    rows = [(i, f"http://a.example/{i}", body(i)) for i in range(n)] + [(101, None, None), (102, "bad url", ""), (0, "http://a.example/0", body(0)), (None, "http://a.example/x", body(0))]
    df = common.materialise(spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int"), "t")
    got = main_texts(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    for r in got:
        if r["page_id"] in (101, 102):
            assert r["text"] == ""
        elif n > 1:
            i = r["page_id"] or 0
            assert r["text"] == f"Title {i}\n\n{own(i)}"
        else:
            assert "Welcome" in r["text"] and long.strip() in r["text"]
    assert main_texts(common.materialise(pages_of(spark, []), "t")).count() == 0


def test_html_shared_paragraph(spark):
    """What comes again within article elements is content, short or long; nothing is cut by length."""
    shared = ["Short one.", "A longer one that is said again. " * 30]
    rows = [(i, f"http://a.example/{i}", f"<body><div>top</div><article><h1>T {i}</h1><p>{shared[0]}<p>own {i}<p>{shared[1]}</article><div>end</div>") for i in range(20)]
    for r in main_texts(common.materialise(pages_of(spark, rows), "t")).collect():
        i = r["page_id"]
        assert r["text"] == "\n\n".join([f"T {i}", shared[0], f"own {i}", shared[1].strip()])


def test_html_classes_by_brute_force(spark):
    """Classes, slots and their conditions from whole occurrence vectors kept as tuples."""
    rng = random.Random(12)
    rows = []
    for h in range(6):
        for i in range(h * 3 + 1):
            items = "".join(f"<li>{w}</li>" for w in ["home", "news", "about"][: rng.choice([3, 3, 3, 2])])
            text = "".join(f"<p>{' '.join(rng_words(rng, rng.randint(1, 9)))}</p>" for _ in range(rng.randint(0, 4)))
            rows.append((len(rows), f"http://h{h}.example/{i}", f"<body><ul>{items}</ul><div class=x><h1>{rng.randrange(4)}</h1>{text}<i>{rng.choice('ab')}</i></div><p>foot</p></body>"))
    rows += rows[-4:]
    df = pages_of(spark, rows).withColumn("host", host())
    template, slots = deduced(common.materialise(occurrences(df), "t"))
    got = defaultdict(set)
    for r in template.collect():
        got[r["host"], r["class"]].add(r["token"])
    want, want_slots = set(), {}
    for h in {u.split("/")[2] for _, u, _ in rows}:
        pages = defaultdict(list)
        for _, u, x in rows:
            if u.split("/")[2] == h:
                pages[Page(x).article()].append(Page(x))
        articles = sorted(pages)
        counts = {t: tuple(max(p.tokens[t] for p in pages[a]) for a in articles) for a in articles for p in pages[a] for t in p.tokens}
        kinds = {t: p.texts.get(t) for ps in pages.values() for p in ps for t in p.tokens}
        parent = {t: p.parents[t] for ps in pages.values() for p in ps for t in p.tokens}
        support = {t: sum(c > 0 for c in v) for t, v in counts.items()}
        classes = defaultdict(set)
        for t, v in counts.items():
            if support[t] >= 3 and 2 * support[t] >= len(articles):
                classes[v].add(t)
        valid = {frozenset(c) for c in classes.values() if len(c) > 1 and any(kinds[t] is None for t in c)}
        want |= {(h, c) for c in valid}
        kinds = {t: k for t, k in kinds.items() if not any(t in c for c in valid)}
        for place in {parent[t] for t, k in kinds.items() if k == BODY} if len(articles) >= 3 else ():
            own = [t for t, k in kinds.items() if k == BODY and parent[t] == place]
            total = sum(support[t] for t in own)
            if total >= 3 and 2 * total >= len(articles):
                want_slots[h, place] = 2 * len(own) >= total
    assert {(h, frozenset(c)) for (h, _), c in got.items()} == want and want
    assert {(r["host"], r["token"]): r["varies"] for r in slots.collect()} == want_slots and set(want_slots.values()) == {True, False}


def test_html_order_and_nesting():
    """Tokens out of their class's order, and classes in two others, are no template on that page."""
    page = Page("<body><p>a</p><p>b</p><div><i>x</i></div><ul><li>y</li></ul></body>")
    tokens = list(page.tokens)
    body, p, a, b, div, i, x, ul, li, y = tokens
    known = {t: (1, float(n)) for n, t in enumerate(tokens)}
    assert page.template(known) == set(tokens) and page.main(known, {}) == ""
    assert page.template(known | {a: (1, 3.5), b: (1, 2.5)}) in (set(tokens) - {a}, set(tokens) - {b})
    body, div, p, a, ul, li, y, i, x = list((page := Page("<body><div><p>a</p></div><ul><li>y</li></ul><div><i>x</i></div></body>")).tokens)
    assert page.template({body: (1, 0.0), div: (2, 1.0), ul: (3, 4.0), li: (4, 5.0), i: (4, 7.0)}) == {body, div, ul}


def test_html_copied_article(spark):
    """Copies of one article on most of a host's pages, alike or with another link beside it, lose none of it; texts that different articles share go where no element marks the article."""
    share = "<p>Share this</p>"
    page = lambda i, j, tag: f"<html><body><{tag}><h1>Title {i}</h1><p>First words of number {i}.</p><p>The longer second paragraph of article {i} is here.</p>{share}<p>ref {j}</p></{tag}></body></html>"
    rows = []
    for h, tag in enumerate(("article", "div")):
        rows += [(1000 * h + i, f"http://{tag}.example/{i}", page(i, 0, tag)) for i in range(12)]
        rows += [(1000 * h + 100 + i, f"http://{tag}.example/0?s={i}", page(0, i % 2 * i, tag)) for i in range(30)]
        rows += [(1000 * h + 500 + i, f"http://one-{tag}.example/0?s={i}", page(0, 0, tag)) for i in range(20)]
    for r in main_texts(common.materialise(pages_of(spark, rows), "t")).collect():
        p, one = r["page_id"] % 1000, "one-" in r["url"]
        i = p if p < 100 else 0
        assert r["text"].startswith(f"Title {i}\n\nFirst words of number {i}.\n\nThe longer second paragraph of article {i} is here.") and ("Share this" in r["text"]) == (one or r["page_id"] < 1000)


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = [(int(i), (centres[i % 12] + rng.normal(size=16) * 0.12).tolist()) for i in range(400)]
    x += [(1000 + i, x[3][1]) for i in range(5)] + [(1000, x[3][1])] + [(2000, [2 * v for v in x[3][1]])]
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [None] + [1.0] * 15), (3003, [float("nan")] + [1.0] * 15), (3004, [float("inf")] + [1.0] * 15), (None, x[0][1]), (3005, []), (3006, [1.0, 2.0]), (3007, [1.0, 2.0])]
    df = common.materialise(spark.createDataFrame(x + odd, "vec_id long, embedding array<double>"), "t")
    got = near_vectors(df).collect()
    assert len(got) == len(x) + len(odd)
    m = np.array([v for _, v in x])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _ in x])
    low = ids.copy()
    for _ in range(len(ids)):
        new = np.minimum(low, np.where(link, low[None], 1 << 60).min(1))
        new = np.array([new[ids == i].min() for i in ids])
        if (new == low).all():
            break
        low = new
    want = Counter((int(i), int(n), int(c)) for i, n, c in zip(ids, link.sum(1), low, strict=True))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None and r["vec_id"] < 3000) == want
    assert all(r["n_links"] == 0 and r["kept"] for r in got if r["vec_id"] is None or 3000 <= r["vec_id"] <= 3005)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got if (r["vec_id"] or 0) > 3005} == {(3006, 1, 3006), (3007, 1, 3006)}
    assert near_vectors(common.materialise(df.limit(0), "t")).count() == 0


def test_embedding_shared_ids(spark):
    """An id with several vectors joins the components of all of them, and each has its own links."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, a), (5, a), (5, b), (2, b), (5, b), (7, c), (7, [0.0, 0.1, 1.0]), (7, a)]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, id int, row int")
        got = Counter(tuple(r)[:3] for r in near_vectors(common.materialise(df, "t")).collect())
        assert got == Counter([(3, 2, 2), (5, 2, 2), (5, 2, 2), (2, 2, 2), (5, 2, 2), (7, 1, 2), (7, 1, 2), (7, 2, 2)])


def test_embedding_components_beyond_least_neighbour(spark):
    """Hubs with the largest id and leaves that are no neighbours of each other; chains in any order of ids."""
    rng = np.random.default_rng(8)
    x = []
    for g in range(10):
        basis = np.linalg.qr(rng.normal(size=(64, 8)))[0].T
        for k in range(6):
            x.append((100 * g + k, (0.955 * basis[0] + (1 - 0.955**2) ** 0.5 * basis[k + 1]).tolist()))
        x.append((100 * g + 50, basis[0].tolist()))
        turns = rng.permutation(12) * 0.3  # neighbours at cosine 0.955, the next at 0.825
        x += [(5000 + 100 * g + k, (np.cos(a) * basis[6] + np.sin(a) * basis[7]).tolist()) for k, a in enumerate(turns)]
    m = np.array([v for _, v in x])
    link = m @ m.T >= 0.95
    low = np.array([i for i, _ in x])
    for _ in range(len(x)):
        low = np.where(link, low[None], 1 << 60).min(1)
    got = near_vectors(common.materialise(spark.createDataFrame(x, "vec_id long, embedding array<double>"), "t")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (int(n) - 1, int(c), i == c) for (i, _), n, c in zip(x, link.sum(1), low, strict=True)}


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = common.table(spark, DATA, "documents")
    names, rows = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = common.materialise(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == names and dict(docs.dtypes) == dict(before.dtypes)
            rows[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(rows[name]) <= {r["doc_id"] for r in before.select("doc_id").collect()}
    lines = zip(rows["quality"], brute_lines(list(rows["quality"].items())), strict=True)
    assert rows["line_dedup"] == {i: t for i, (t, n) in lines if not n or t.strip()}
    heads = groups(list(rows["line_dedup"].items()), 5, 80)
    assert set(rows["near_dedup"]) == {i for i in rows["line_dedup"] if heads[i] == i}
    lib = Encoder(WORD, "word").library
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for t in rows["near_dedup"].values())
    assert sum(r["length"] for r in docs.collect()) == total
    seq = Counter()
    for r in docs.collect():
        seq[r["sequence_id"]] += r["length"]
    assert max(seq.values()) <= 2048


def test_pipeline_odd_rows(spark, odd_docs):
    """Nulls, empty and long texts, repeated ids and rows, and an empty table go through all stages; all but the last keep the columns."""
    import corpus_pipeline as P

    names = common.table(spark, DATA, "documents").columns
    rows = [(i, t, "en", None, len(t or "")) for i, t in odd_docs] + [(7, "again another text of one id.", None, "s", 1), (None, None, None, None, None)]
    for some in (rows, []):
        docs = common.materialise(spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").select(*names), "t")
        for name, stage in P.STAGES:
            before, docs = docs, common.materialise(stage(spark, docs, DATA), name)
            assert name == "packing" or docs.columns == names and docs.count() <= before.count()
        assert bool(docs.count()) == bool(some)
