"""Text expressions, all Column -> Column and inside whole-stage code generation but for NFKC and the Indel ratio, which are Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section labels that open a title or abstract, in the order in which they are taken off.
TITLE_PREFIXES = ("ethnopharmacological relevance:", "abstract:", "background:", "introduction:", "objective:", "purpose:")
#: Dashes that become a hyphen.
DASHES = "–—−‒‐"
#: Spellings of a missing value.
NULL_TOKENS = ("null", "unknown", "not specified", "nan", "none", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def null_if_in(c: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """STR18: null where the trimmed lower-case value is one of the tokens; any other value comes back unchanged."""
    return F.when(~F.lower(F.trim(c)).isin(*tokens), c)


def collapse_ws(c: Column) -> Column:
    """STR3"""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_title(c: Column, prefixes: Sequence[str] = TITLE_PREFIXES) -> Column:
    """STR1: lower case, each prefix taken off once in the given order, signs to spaces (letters of any script stay), spaces collapsed; null gives ''."""
    out = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    for p in prefixes:
        out = F.when(out.startswith(p), F.trim(F.substring(out, len(p) + 1, 1 << 30))).otherwise(out)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normalize_doi(c: Column) -> Column:
    """STR2: lower case without a resolver's address; blank gives null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"https?://doi\.org/", ""), F.lit(""))


def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Compatibility composition; Spark has no built-in for it. The UDF is made when asked for, as workers import this module too."""
    return F.pandas_udf(_compose, "string")(c)


def normalize_keyword(c: Column, compose: bool = True) -> Column:
    """STR4 and FLT12: composed, lower case, dashes unified, bracketed qualifiers dropped, outer signs stripped; null if shorter than 3, all digits, or without a-z.

    compose=False leaves NFKC out, for texts known to be composed, and keeps the plan free of Python.
    """
    s = F.lower(F.trim(nfkc(c) if compose else c))
    s = F.translate(s, DASHES, "-" * len(DASHES))
    s = F.regexp_replace(F.regexp_replace(s, r"\[[^\]]*\]", ""), r"\s+", " ")
    s = F.regexp_replace(s, r"^[ ,.;:/\\\"'*]+|[ ,.;:/\\\"'*]+$", "")
    return F.when((F.length(s) >= 3) & ~s.rlike(r"^\d+$") & s.rlike("[a-z]"), s)


def normalize_affiliation(c: Column) -> Column:
    """STR5: without a leading [authors] part and trailing dots."""
    return F.trim(F.regexp_replace(collapse_ws(F.regexp_replace(F.trim(c), r"^\[[^\]]*\]\s*", "")), r"\.+$", ""))


def split_clean(c: Column, pattern: str) -> Column:
    """ARR3: parts, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def split_affiliations(source: Column, raw: Column, names: Column) -> Column:
    """STR6: distinct affiliation strings by source: lines, semicolons, structured names, or none."""
    lines = F.transform(split_clean(raw, "\n"), normalize_affiliation)
    parts = F.transform(split_clean(raw, ";"), normalize_affiliation)
    picked = F.when(source == "WoS", lines).when(source == "Scopus", parts).when(source == "OpenAlex", names).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(picked, lambda x: F.length(x) > 0))


def normalize_journal(c: Column) -> Column:
    """STR7: upper case without a trailing parenthesis; blank gives null."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(F.trim(c), r"\s*\([^)]*\)\s*$", ""))), F.lit(""))


def parse_person_name(c: Column) -> Column:
    """STR8: struct(surname, initial), null where a name has one part. Comma form first, then trailing initials, then given name before surname."""
    name = F.trim(F.regexp_replace(F.trim(c), r"\.+$", ""))
    last = F.trim(F.substring_index(name, ",", 1))
    given = F.regexp_replace(F.trim(F.regexp_replace(name, r"^[^,]*,", "")), r"[.\-\s]+", "")
    comma = name.contains(",") & (last != "") & (given != "")
    tokens = F.split(name, r"\s+")
    tail = F.regexp_replace(F.element_at(tokens, -1), r"[.\-]", "")
    several = F.size(tokens) >= 2
    initials = several & tail.rlike(r"^\p{L}{1,3}$") & ((tail == F.upper(tail)) | (F.length(tail) == 1))
    head = F.element_at(tokens, 1)
    full = several & (F.length(head) > 1) & ((head != F.upper(head)) | ~head.rlike(r"\p{L}"))
    pair = lambda s, i: F.struct(s.alias("surname"), F.upper(F.substring(i, 1, 1)).alias("initial"))
    return (
        F.when(comma, pair(last, given))
        .when(initials, pair(F.array_join(F.slice(tokens, 1, F.size(tokens) - 1), " "), tail))
        .when(full, pair(F.element_at(tokens, -1), head))
    )


def make_fini(surname: Column, initial: Column) -> Column:
    """STR9: ``surname_i`` in a-z only; letters with marks are dropped."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(surname)), r"\s+", " "), r"[^a-z\- ]", "")
    s = F.translate(F.trim(s), " -", "__")
    return F.when((s != "") & (initial != ""), F.concat(s, F.lit("_"), F.lower(initial)))


def make_inst_slug(c: Column) -> Column:
    """STR10: the first five words of two letters and more without of, the, and, in; at most 60 characters."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0), lambda w: (F.length(w) >= 2) & ~w.isin("of", "the", "and", "in"))
    slug = F.substring(F.array_join(F.slice(words, 1, 5), "_"), 1, 60)
    return F.when(c.isNull() | c.isin("", "(unknown)") | (slug == ""), F.lit("unknown")).otherwise(slug)


def make_d2_id(fini: Column, institution: Column) -> Column:
    return F.when(fini.isNotNull() & (fini != ""), F.concat(fini, F.lit("@"), make_inst_slug(institution)))


def extract_countries(c: Column, aliases: dict[str, str], special: dict[str, str] | None = None, country: str = "china", code: str = "CN", gap: int = 30) -> Column:
    """STR11: sorted distinct codes of whole-word aliases. A country word beside the name of one of its special regions counts only if some occurrence has no such name in the gap characters before it."""
    text = F.lower(F.coalesce(c, F.lit("")))
    special = special or {}
    hits = [F.when(text.rlike(rf"(?U)\b{a}\b"), F.lit(k)) for a, k in {**special, **aliases}.items() if a != country]
    ahead = "".join(rf"(?<!{a}.{{0,{gap - len(a)}}})" for a in special)
    hits.append(F.when(text.rlike(rf"(?sU){ahead}\b{country}\b"), F.lit(code)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def country_chain(structured: Column, affiliation: Column, reprint: Column) -> Column:
    """STR12: struct(codes, origin) from arrays of codes: structured and affiliation together, the reprint address only where both are empty."""
    none = F.array().cast("array<string>")
    s, a, r = (F.coalesce(x, none) for x in (structured, affiliation, reprint))
    both = F.array_union(s, a)
    late = F.size(both) == 0
    origin = F.array_join(F.array_compact(F.array(F.when(F.size(s) > 0, F.lit("structured")), F.when(F.size(a) > 0, F.lit("affiliation")), F.when(late & (F.size(r) > 0), F.lit("reprint")))), "+")
    return F.struct(F.array_sort(F.when(late, r).otherwise(both)).alias("codes"), F.when(origin == "", F.lit("none")).otherwise(origin).alias("origin"))


def first_rule_match(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """STR13: label of the first pattern, case-insensitive, that the text has."""
    return F.coalesce(*[F.when(c.rlike(f"(?i){p}"), F.lit(label)) for p, label in rules], F.lit(None).cast("string"))


def core_tokens(c: Column, stop: Sequence[str] = ("of", "the", "and", "in", "for", "a", "an", "at")) -> Column:
    """STR14: distinct lower-case words of three letters and more that are no stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0), lambda w: (F.length(w) >= 3) & ~w.isin(*stop)))


def listed_tokens(c: Column, names: Sequence[str]) -> Column:
    """STR14: those of the given names that occur as whole words."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?U)\b{n}\b"), F.lit(n)) for n in names]))


def leading_token(c: Column) -> Column:
    """STR14: first word before the first comma, after an [author] part."""
    return F.regexp_extract(F.lower(F.substring_index(F.trim(F.regexp_replace(c, r"^\[[^\]]+\]\s*", "")), ",", 1)), "[a-z]+", 0)


def split_entities(c: Column, pattern: str = r"\s*(?:[,;/+]|\band\b|\bor\b)\s*") -> Column:
    """STR15: names in a list text, cleaned of brackets and quotes, each once, in order."""
    clean = F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\[\](){}\"']", "")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def clean_text(c: Column) -> Column:
    """STR19: no tags, no numbers that stand alone, Latin letters and hyphens only, lower case."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\b\d+\b", " "), r"[^A-Za-z\-]+", " ")
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def strip_fence(c: Column) -> Column:
    """STR20: the content of a fenced code block."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def smart_truncate(title: Column, body: Column, budget: int) -> Column:
    """STR21: title whole; of the body the first three quarters and the last quarter of the words left in the budget."""
    words = F.split(F.trim(body), r"\s+")
    room = F.greatest(F.lit(budget) - F.size(F.split(F.trim(title), r"\s+")), F.lit(0))
    head = F.floor(room * 0.75).cast("int")
    tail = room - head
    cut = F.concat_ws(" ", F.slice(words, 1, head), F.when(tail > 0, F.slice(words, -tail, tail)).otherwise(F.array().cast("array<string>")))
    return F.concat_ws(" ", title, F.when(F.size(words) <= room, body).otherwise(cut))


def n_tokens_estimate(c: Column) -> Column:
    """STR22: 1.3 times the words, rounded down."""
    return F.floor(F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), 0)) * 1.3)


def fill_template(template: str, **values: Column) -> Column:
    """STR23: each {{name}} replaced by its value, as it is."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def term_present(text: Column, terms: Sequence[str]) -> Column:
    hits = [text.contains(t) for t in terms]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def term_block_class(text: Column, blocks: Sequence[tuple[str, Sequence[Sequence[str]]]], default: str = "B0_none") -> Column:
    """FLT3: label of the first block of which every term list has a term in the text (substrings, lower case)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for label, groups in reversed(blocks):
        condition = term_present(low, groups[0])
        for g in groups[1:]:
            condition = condition & term_present(low, g)
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def is_exclusive(sources: Column, name: str) -> Column:
    """FLT4"""
    return F.coalesce((F.size(sources) == 1) & (F.element_at(F.coalesce(sources, F.array(F.lit(""))), 1) == name), F.lit(False))


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence by bit vectors: one word of len(a) bits for each character of b."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 100.0 if not x and not y else 200.0 * _common_subsequence(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    """FUZ1: 100 times twice the common subsequence over both lengths; two empty texts are equal, null gives null."""
    return F.pandas_udf(_ratios, "double")(a, b)


def token_sorted(c: Column) -> Column:
    """FUZ2: words in order of the alphabet."""
    return F.array_join(F.array_sort(F.split(F.trim(c), r"\s+")), " ")


def safe_prefilter(a: Column, b: Column, threshold: float) -> Column:
    """Never false for a pair at or above an Indel ratio: the Levenshtein distance is at most the Indel distance, (1 - ratio) times both lengths."""
    total = F.length(a) + F.length(b)
    return F.levenshtein(a, b) <= F.floor(total * (100 - threshold) / 100.0)


def assign_period(year: Column, periods: Sequence[tuple[str, int, int]]) -> Column:
    """PER1: label of the closed range that has the year; null outside."""
    out = F.lit(None).cast("string")
    for label, lo, hi in reversed(periods):
        out = F.when(year.between(lo, hi), F.lit(label)).otherwise(out)
    return out


def year_of_text(c: Column) -> Column:
    """PER2: the year that opens a free-text date."""
    return F.when(F.substring(F.trim(c), 1, 4).rlike(r"^\d{4}$"), F.substring(F.trim(c), 1, 4)).cast("int")


def inverted_index(words: Column) -> Column:
    """Map word -> ascending positions of an array of words, within the row: words are sorted with their positions and cut where the word changes. Null stays null."""
    let = lambda c, f: F.get(F.transform(F.array(c), f), 0)  # noqa: E731  works an expression out once
    placed = F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["w"] != F.get(s, i - 1)["w"]), i)), lambda i: i.isNotNull())
    run = lambda s, b, e: F.struct(F.get(s, b)["w"].alias("w"), F.transform(F.slice(s, b + 1, e - b), lambda x: x["p"]).alias("p"))
    entries = lambda s: let(starts(s), lambda at: F.transform(at, lambda b, k: run(s, b, F.coalesce(F.get(at, k + 1), F.size(s)))))
    return F.when(words.isNotNull(), F.map_from_entries(let(placed, entries)))


def inverted_index_text(m: Column) -> Column:
    """ARR1: words of a map word -> positions, in order."""
    pairs = F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " "), F.lit(""))
