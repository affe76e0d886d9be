"""Operator 2: main text of web pages by template deduction over equivalence classes.

1. A page is read as tokens: each start tag with its path of tags and classes, and each text with its path.
2. The occurrence vector of a token has its count in every article of the host; pages with the same article, by its longest text outside marked parts, count once, so copies prove nothing. Vectors are compared by
   two random sums, their total and their support.
3. Tokens of a host with equal vectors are a class. It is valid if it has SIZE tokens, a tag among them, in MINIMUM articles and SUPPORT of the host's, and if on the page at hand its tokens
   stand in the class's order (those off the longest ascending run are left out) and its tags lie in one class that begins before it, or in none. Valid classes, nested, are the template.
4. Texts between template tokens under one path are a slot. A slot varies if VARIES of its texts, one article each, are different ones.
5. Content are texts that are no template, in slots that vary. Marks only break ties: what stands in an article or main element is content even if it comes again; menus, headers, footers,
   sidebars, notices, adverts, forms, scripts, styles and comment sections are told by fixed tags, roles and names. A name or a form that encloses the only article, or a form that encloses the
   page's main heading and most of its text, hides nothing. Beside an article only main headings before it are added. Within an article names hide whole parts, not paragraphs or headings, nor parts
   that are named as text as well; ids there are anchors and hide no section.

One page tells no template: hosts with fewer than MINIMUM articles, and pages that none of the classes fit, rely on marks alone: the article with the main headings before it, else the body.
Templates go to the scan by broadcast while they have fewer than BROADCAST_ROWS rows, else by a join on the host.

Cases: null and empty html give an empty text; null urls share one host of their own; unclosed tags end as HTML has it; pages of any length are read whole; repeated rows give equal rows;
null page_ids pass through; columns other than page_id, url and html are not read, whatever their names. Texts that are equal on most articles of a host without article elements go, whatever their length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.llm.common import materialise, slices, small_batches

SUPPORT, MINIMUM, SIZE, VARIES = 0.5, 3, 2, 0.5
BROADCAST_ROWS = 200_000
HOSTS = 64  # whose templates a task holds
GONE, BODY, ARTICLE, NAMED, INNER, FORMED = range(6)  # roles of texts; INNER is an article within an element of a NAMED kind or a form, FORMED other text within a form

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
CLASS = re.compile(r"(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Fixed values of HTML: elements without end tag, elements whose content is no markup, elements that make a block of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "optgroup", "option", "legend", "body", "html", "button", "select"}
#: What an opening tag ends, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
OUT_TAGS = set("nav footer aside form button select dialog menu search head script style noscript template iframe object".split())
OUT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
OUT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs topbar footer sidebar aside widget widgets notice "
    "cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist discussion disqus respond reply replies social share sharing "
    "related recommended pagination pager toolbar".split()
)
#: Words that may stand beside them in a name; with any other word, a name says nothing.
BESIDE = set(
    "site page post posts entry article articles list item items box bar block area section container wrapper wrap inner outer top bottom left right primary secondary global header "
    "link links button buttons icon icons title text body row col column".split()
)
#: In an article: elements that names don't hide, and names that say that an element is text.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption".split())
KEEPS = set("text body content entry paragraph".split())
SPACE = re.compile(r"[ \t\n\r\f\v   -     　\u0085]+")


def hash64(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


@lru_cache(1 << 16)
def named_out(names: str) -> bool:
    """Whether one of an element's names, whole, is that of a part beside the text."""
    for name in names.split():
        words = set(re.split(r"[^a-z]+", name)) - {""}
        if words & OUT_NAMES and words <= OUT_NAMES | BESIDE:
            return True
    return False


def told(tag: str, names: str, anchor: str, inside: bool) -> str:
    """The names by which an element may be told to lie beside the text."""
    if not inside:
        return f"{names} {anchor}"
    if tag in TEXTUAL or KEEPS & set(names.split()):
        return ""
    if tag == "section" and (not names or "discussion" in names.split()):  # comments by any other name are no heading of a paper
        return "" if "discussion" in f"{names} {anchor}" else anchor
    return f"{names} {anchor}"


def ascending(values: list) -> list[int]:
    """Places of a longest ascending run."""
    tails, last, before = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        before.append(last[at - 1] if at else -1)
        tails[at : at + 1], last[at : at + 1] = [v], [i]
    run, i = [], last[-1] if last else -1
    while i >= 0:
        run.append(i)
        i = before[i]
    return run[::-1]


TOP = ("", 0, False, False, False, False, "", False)  # the stack's entry outside all elements


class Page:
    """Reads a page once: ``blocks`` of (text, role, token, in a main heading) and the counts of all tokens, in order of their first place, with their enclosing tag's token."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, bool]] = []
        self.tokens: Counter[int] = Counter()
        self.parents: dict[int, int] = {}
        self.texts: dict[int, int] = {}  # role of each text token
        self.stack: list[tuple] = []  # tag, token, gone, named, inside an article, that one named, path, in a form
        self.pending: list[str] = []
        self.read(source)

    def push(self, tag: str, attributes: str) -> None:
        _, parent, gone, named, inside, under, path, formed = self.stack[-1] if self.stack else TOP
        names, found = "", {}
        if attributes:
            found = {m[1].lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), "")).lower() for m in CLASS.finditer(attributes)}
            names = found.get("class", "")
        role = found.get("role", "")
        form = not inside and (tag == "form" or role == "form") and role in ("", "form")
        gone = gone or (tag in OUT_TAGS or role in OUT_ROLES) and not form or tag == "header" and not inside
        gone = gone or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        if tag in ("article", "main") or role in ("main", "article"):
            if not inside:
                inside, under, named, formed = True, named or formed, False, False
        elif form:
            formed = True
        elif tag not in ("html", "body"):
            named = named or bool(found) and named_out(told(tag, names, found.get("id", ""), inside))
        path = f"{path}/{tag}.{names}"
        token = hash64(path)
        self.tokens[token] += 1
        self.parents[token] = parent
        self.stack.append((tag, token, gone, named, inside, under, path, formed))

    def flush(self) -> None:
        if self.pending:
            text = SPACE.sub(" ", "".join(self.pending)).strip(" ")
            self.pending.clear()
            if text:
                tag, parent, gone, named, inside, under, path, formed = self.stack[-1] if self.stack else TOP
                token = hash64(f"{path}/#{text}")
                self.tokens[token] += 1
                self.parents[token] = parent
                role = GONE if gone else NAMED if named else (INNER if under else ARTICLE) if inside else FORMED if formed else BODY
                self.texts[token] = role
                self.blocks.append((text, role, token, tag == "h1"))

    def close(self, tags: set[str], fence: set[str]) -> None:
        """End the nearest open element of some tags, and all within it, unless a fence stands before it."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                del self.stack[i:]
                return
            if self.stack[i][0] in fence:
                return

    def read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if not m:
                self.pending.append(html.unescape(source[at:]))
                break
            if m.start() > at:
                self.pending.append(html.unescape(source[at : m.start()]))
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK:
                    self.flush()
                self.close({tag}, BLOCK - {tag} if tag not in BLOCK else set())
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = n if not end else (source.find(">", end.start()) + 1 or n)
                token = hash64(f"{self.stack[-1][6] if self.stack else ''}/{tag}")
                self.tokens[token] += 1
                self.parents[token] = self.stack[-1][1] if self.stack else 0
                continue
            if tag in BLOCK:
                self.flush()
                if tag in ENDS_P:
                    self.close({"p"}, {"button", "table", "td", "th", "caption", "body", "html"})
                if tag in ENDS:
                    self.close(*ENDS[tag])
            if tag == "body":
                self.close({"head"}, set())
            if tag in ("br", "wbr", "hr"):
                self.pending.append(" " if tag != "wbr" else "")
            if tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCK - VOID:
                self.push(tag, m[3])
        self.flush()

    def template(self, known: dict[int, tuple[int, float]]) -> set[int]:
        """Tokens of known classes (token: class, place) that are valid on this page."""
        members = defaultdict(list)
        for token in self.tokens:
            if token in known:
                members[known[token][0]].append(token)
        held = {tokens[i] for tokens in members.values() for i in ascending([(known[t][1], t) for t in tokens])}
        outer, begin = defaultdict(set), {}
        for place, token in enumerate(self.tokens):
            if token in held:
                begin.setdefault(known[token][0], place)
        for token in held:
            if token not in self.texts:
                at = self.parents[token]
                while at and at not in held:
                    at = self.parents[at]
                within = known[at][0] if at else None
                # a class that begins later is an inner one, which a tag of this one may lie in
                if within is None or begin[within] < begin[known[token][0]]:
                    outer[known[token][0]].add(within)
        return {t for t in held if len(outer[known[t][0]]) < 2}

    def chosen(self, known: dict[int, tuple[int, float]] | None = None, slots: dict[int, bool] | None = None) -> list[str]:
        """Texts of the content, in order; known has the classes of the host, slots whether a slot varies."""
        roles = {role for _, role, _, _ in self.blocks}
        heads = {role for _, role, _, head in self.blocks if head}
        size = Counter()
        for text, role, _, _ in self.blocks:
            size[role] += len(text)
        if FORMED in heads and BODY not in heads and size[FORMED] > size[BODY]:
            body = FORMED
        else:
            body = NAMED if BODY not in roles and NAMED in heads else BODY
        main = ARTICLE if ARTICLE in roles else INNER if INNER in roles else body
        fixed = self.template(known) if known else set()
        around = FORMED if main == INNER and BODY not in heads else BODY
        first = next((i for i, block in enumerate(self.blocks) if block[1] == main), 0)
        slots = slots or {}
        out = []
        for i, (text, role, token, head) in enumerate(self.blocks):
            if role == main and (not fixed or main in (ARTICLE, INNER)):
                out.append(text)
            elif main in (ARTICLE, INNER) or not fixed:
                # the article's own heading may stand before its element
                if role == around and head and i < first and token not in fixed:
                    out.append(text)
            elif role in (main, BODY) and token not in fixed and slots.get(self.parents[token], role == main):
                out.append(text)
        return out

    def article(self) -> int:
        """What tells the page's article from others: its longest content block, so that copies with another date or link beside it are one article."""
        return hash64(max(self.chosen(), key=lambda t: (len(t), t), default=""))

    def main(self, known: dict[int, tuple[int, float]] | None = None, slots: dict[int, bool] | None = None) -> str:
        return "\n\n".join(self.chosen(known, slots))


def host(url: str = "url") -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, parent, kind, c, n, a, b, place): the occurrence vector of each token over the articles of its host, as its total, its support and two random sums. kind is 0 for tags, 1 for
    texts in the body and 2 for other texts. Token 0 stands for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for part in slices(batches, "html"):
            columns: list[list] = [[] for _ in kinds]
            for where, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                page = Page(source or "")
                article = page.article()
                rows = [(0, 0, 0, 1)] + [(t, page.parents[t], 0 if t not in page.texts else 1 if page.texts[t] == BODY else 2, c) for t, c in page.tokens.items()]
                for place, (t, parent, kind, c) in enumerate(rows):
                    for column, x in zip(columns, (where, article, t, parent, kind, c, place), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "article", "token", "parent", "kind", "c", "place"])

    rows = pages.mapInArrow(run, "host string, article long, token long, parent long, kind int, c long, place long")
    each = rows.groupBy("host", "token", "article").agg(F.max("parent").alias("parent"), F.max("kind").alias("kind"), F.max("c").alias("c"), F.min("place").alias("place"))
    weight = lambda salt: F.shiftrightunsigned(F.xxhash64("article", F.lit(salt)), 40)
    sums = [F.sum("c").alias("total"), F.count(F.lit(1)).alias("n"), F.sum(F.col("c") * weight(1)).alias("a"), F.sum(F.col("c") * weight(2)).alias("b"), F.avg("place").alias("place")]
    return each.groupBy("host", "token").agg(F.max("parent").alias("parent"), F.max("kind").alias("kind"), *sums)


def deduced(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens of classes with size and support (host, token, class, place), and the slots of the other texts (host, token of the path, varies), of hosts with MINIMUM articles."""
    hosts = vectors.filter("token = 0").select("host", F.col("n").alias("articles")).filter(F.col("articles") >= MINIMUM)
    often = lambda n: (F.col(n) >= MINIMUM) & (F.col(n) >= SUPPORT * F.col("articles"))
    frequent = vectors.filter((F.col("token") != 0) & (F.col("n") >= MINIMUM)).join(hosts, "host").filter(often("n"))
    vector = ["host", "total", "n", "a", "b"]
    valid = frequent.groupBy(*vector).agg(F.count(F.lit(1)).alias("size"), F.min("kind").alias("least")).filter((F.col("size") >= SIZE) & (F.col("least") == 0))
    template = frequent.join(valid, vector).select("host", "token", F.xxhash64("total", "n", "a", "b").alias("class"), "place")
    rest = vectors.filter("kind = 1").join(template, ["host", "token"], "left_anti")
    texts = rest.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("places")).filter(F.col("places") >= MINIMUM)
    slots = texts.join(hosts, "host").filter(often("places")).select("host", F.col("parent").alias("token"), (F.col("texts") >= VARIES * F.col("places")).alias("varies"))
    return template, slots


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars. pages is read twice, so it should be a stored table."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"))
    vectors = materialise(occurrences(rows.select("host", "html")), "vectors")
    template, slots = deduced(vectors)
    # of one host, a page's tokens and texts divided by SUPPORT at most
    tagged = template.select("host", F.struct("token", "class", "place", F.lit(None).cast("boolean").alias("varies")).alias("entry"))
    tagged = materialise(tagged.unionAll(slots.select("host", F.struct("token", F.lit(None).cast("long").alias("class"), F.lit(None).cast("double").alias("place"), "varies").alias("entry"))), "template")
    by_host = tagged.groupBy("host").agg(F.collect_list("entry").alias("template"))
    small = tagged.count() < BROADCAST_ROWS
    joined = rows.join(F.broadcast(by_host) if small else by_host, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, dict]] = {}  # of the last hosts
        for part in slices(batches, "html"):
            out, hosts, templates = [], part.column("host").to_pylist(), part.column("template")
            for i, source in enumerate(part.column("html").to_pylist()):
                if hosts[i] not in held:
                    if len(held) == HOSTS:
                        held.clear()
                    entries = templates[i].as_py() or []
                    held[hosts[i]] = {e["token"]: (e["class"], e["place"]) for e in entries if e["varies"] is None}, {e["token"]: e["varies"] for e in entries if e["varies"] is not None}
                known, slot = held[hosts[i]]
                out.append(Page(source or "").main(known, slot))
            n = np.fromiter(map(len, out), np.int64, len(out))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(n)], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
