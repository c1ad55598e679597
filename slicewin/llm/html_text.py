"""Operator 6: main text of pages by template deduction from equivalence classes.

A page is a sequence of tokens: its elements, each by its path of tags and class names, and its text blocks, each
with the path it stands in. Tokens of a host that occur equally often on each of its pages (one occurrence vector)
are one equivalence class. A class is valid if it has two tokens at least and is on at least three and on more than
half of the host's different pages. Elements of valid classes that occur once a page are nested by their paths into
the host's template, in the order in which they stand; the regions between them are its slots, whose text differs
from page to page. From the root the template is followed into the part that holds most of the slots' text
outside links (SHARE of it), as long as there is one: that is the host's main slot.

Of each page the blocks in the main slot are the text, but for those of the template itself (texts of the class of
the whole template, unless they are half of the page's text or more: then pages are copies) and those in furniture:
elements whose tag or name says that they are no article text (reader comments and adverts inside an article differ
from page to page, so that no template shows them). If the slot holds an article element that it is not part of, the
text is that element's. Pages of hosts without template are treated alike with the whole page as the main slot.
An element by whose name only it would be furniture is none if it holds the page's h1 or the main slot.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewin.llm.common import ascii_lower, discard, materialize, table
from slicewin.llm.textscan import portions

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|template|noscript|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|</?([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|</?([a-zA-Z][a-zA-Z0-9-]*)([^>]*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside button select menu head svg object dialog".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|cookies?|consent|notice|comments?|sidebar|menu|nav|navbar|navigation|breadcrumbs?|popup|modal|promo|sponsor\w*|newsletter|subscribe|share|social|related|footer|header|masthead)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
CLOSES_ITSELF = ("p", "li", "dt", "dd", "tr", "td", "option")
LEAST, SHARE = 3, 0.7
#: Bytes of templates that go to all tasks; beyond, pages meet them by host and one of SALTS salts.
BROADCAST, SALTS = 32 << 20, 64
#: Kinds of tokens: the page itself, elements, texts.
PAGE, ELEMENT, TEXT = 0, 1, 2


def hashed(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """Elements (tag, parent, path, whether furniture by tag, by name) and blocks (element, text, characters in links)."""

    def __init__(self, source: str):
        self.tags, self.parents, self.paths, self.by_tag, self.by_name = [], [], [], [], []
        self.blocks: list[tuple[int, str, int]] = []
        self.titles: list[int] = []
        stack: list[tuple[str, int]] = []
        text: list[tuple[str, bool]] = []
        path_of: dict[tuple[int, str], int] = {}

        def here() -> int:
            return stack[-1][1] if stack else -1

        def end() -> None:
            if text:
                joined = SPACE.sub(" ", html.unescape("".join(t for t, _ in text))).strip()
                if joined:
                    linked = sum(len(t) for t, link in text if link)
                    self.blocks.append((here(), joined, min(linked, len(joined))))
                text.clear()

        links = 0
        last = source.rfind(">") + 1
        # Behind the last > there is no tag any more, so that no search for one runs to the end again and again.
        for m in TOKEN.finditer(source[:last]):
            token, name, more = m[0], (m[2] or m[4] or "").lower(), m[3] if m[2] else m[5]
            if not name:
                if token[0] != "<" or token == "<":
                    text.append((token, links > 0))
                elif m[1] and m[1].lower() in ("title", "textarea", "template", "iframe"):
                    end()
                continue
            if name == "br":
                text.append((" ", links > 0))
                continue
            if name == "a":
                links = 0 if token[1] == "/" else 1
            if name not in INLINE:
                end()
            if token[1] == "/":
                for i in range(len(stack) - 1, max(-1, len(stack) - 400), -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                continue
            if name in VOID or token.endswith("/>"):
                continue
            if name in INLINE:
                # Inline elements open no block; only one that is named as furniture counts as an element.
                if not more or not NAMES.search(" ".join(a or b or c for _, a, b, c in NAMED.findall(more))):
                    continue
                end()
            while name not in INLINE and stack and (stack[-1][0] in INLINE or (stack[-1][0] == name and name in CLOSES_ITSELF)):
                stack.pop()
            found = [(k.lower(), a or b or c) for k, a, b, c in NAMED.findall(more)] if more and "=" in more else []
            named = " ".join(v for _, v in found)
            kinds = " ".join(sorted(w for k, v in found if k == "class" for w in v.split() if not any(d.isdigit() for d in w)))
            parent = here()
            step = (self.paths[parent] if parent >= 0 else 0, f"{name}.{kinds}")
            if step not in path_of:
                path_of[step] = hashed(f"{step[0]}/{step[1]}")
            stack.append((name, len(self.tags)))
            self.tags.append(name)
            self.parents.append(parent)
            self.paths.append(path_of[step])
            self.by_tag.append(name in FURNITURE or name == "header")
            self.by_name.append(name == "form" or (name not in ("html", "body", "article", "main") and bool(named) and bool(NAMES.search(named))))
            if name == "h1":
                self.titles.append(len(self.tags) - 1)
        if source[last:]:
            text.append((source[last:], False))
        end()

    def above(self, element: int) -> Iterator[int]:
        while element >= 0:
            yield element
            element = self.parents[element]

    def text(self, main: int | None, fixed: frozenset[int]) -> str:
        """The text of the main slot (the path of its element, None for the whole page), without the template's own."""
        spared: set[int] = {e for t in self.titles for e in self.above(t)}
        slot = {i for i, p in enumerate(self.paths) if p == main}
        for e in slot:
            spared.update(self.above(e))
        inner, state = set(slot), []
        article, junk = [], []
        for i, (tag, parent) in enumerate(zip(self.tags, self.parents, strict=True)):
            if parent in inner:
                inner.add(i)
            inside = parent >= 0 and article[parent]
            wrong = parent >= 0 and junk[parent]
            own = (self.by_tag[i] and not (tag == "header" and inside)) or (self.by_name[i] and i not in spared)
            junk.append((wrong or own) and i not in slot)
            article.append(inside or (tag in ("article", "main") and not junk[i]))
            state.append((i in inner, junk[i], article[i]))
        outside = (not slot, False, False)
        held = [(e, t, *(state[e] if e >= 0 else outside)) for e, t, _ in self.blocks]
        held = [b for b in held if (b[2] or not slot) and not b[3]]
        if any(b[4] for b in held):
            held = [b for b in held if b[4]]
        own = [self.text_token(e, t) in fixed for e, t, *_ in held] if fixed else []
        size = sum(len(b[1]) for b in held)
        if own and 2 * sum(len(b[1]) for b, x in zip(held, own, strict=True) if x) < size:
            held = [b for b, x in zip(held, own, strict=True) if not x]
        return "\n\n".join(b[1] for b in held)

    def text_token(self, element: int, text: str) -> int:
        return hashed(f"{self.paths[element] if element >= 0 else 0}|{text}")


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, kind, token, parent, count, place, chars): of each different page; chars: text outside links, by its element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            out: list[tuple] = []
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page, seed = Page(source or ""), hashed(source or "")
                chars: Counter = Counter()
                for e, t, linked in page.blocks:
                    chars[page.paths[e] if e >= 0 else 0] += len(t) - linked
                count, first, parent = Counter(page.paths), {}, {}
                for i, p in enumerate(page.paths):
                    if p not in first:
                        first[p], parent[p] = i, page.paths[page.parents[i]] if page.parents[i] >= 0 else 0
                # An element by tag furniture does not draw the main slot.
                barred = {p for i, p in enumerate(page.paths) if page.by_tag[i]}
                out.append((host, seed, PAGE, 0, 0, 1, 0, 0))
                out += [(host, seed, ELEMENT, p, parent[p], n, first[p], 0 if p in barred else chars[p]) for p, n in count.items()]
                out += [(host, seed, TEXT, t, 0, n, 0, 0) for t, n in Counter(page.text_token(e, t) for e, t, _ in page.blocks).items()]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=["host", "page", "kind", "token", "parent", "count", "place", "chars"])

    return pages.select("host", "html").mapInArrow(run, "host string, page long, kind int, token long, parent long, count int, place int, chars long")


def template(found: list[dict]) -> tuple[int | None, list[int]]:
    """The main slot and the fixed texts of a host, from its frequent tokens; None without a template."""
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in found:
        if t["kind"] != PAGE:
            classes[t["n"], t["vector"]].append(t)
    valid = [c for c in classes.values() if len(c) > 1]
    elements = {t["token"]: t for c in classes.values() for t in c if t["kind"] == ELEMENT}
    skeleton = {t["token"]: t for c in valid for t in c if t["kind"] == ELEMENT and t["once"]}
    if not skeleton:
        return None, []
    # Text of a slot counts for all elements of the template around it.
    held: Counter = Counter()
    inner: dict[int, list[int]] = defaultdict(list)
    for token, t in elements.items():
        up, seen = token, set()
        nearest = None
        while up in elements and up not in seen:
            seen.add(up)
            if up in skeleton:
                held[up] += t["chars"]
                if nearest is None and up != token:
                    nearest = up
            up = elements[up]["parent"]
        if token in skeleton:
            inner[nearest or 0].append(token)
    main, whole = 0, sum(held[t] for t in inner[0])
    while True:
        nested = sorted(inner[main], key=lambda t: (-held[t], skeleton[t]["place"], t))
        if not nested or not held[nested[0]] or held[nested[0]] < SHARE * whole:
            break
        main, whole = nested[0], held[nested[0]]
    everywhere = max(t["n"] for t in found)
    fixed = [t["token"] for c in valid for t in c if t["kind"] == TEXT and t["n"] == everywhere and t["once"]]
    return main or None, sorted(fixed)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, fixed) of the hosts that have a template. Equal pages of a host count once.

    Only tokens that are on at least LEAST and on more than half of a host's pages are brought together, which are
    at most about twice those of a page.
    """
    each = tokens(pages).distinct()
    vector = F.sum((F.pmod(F.col("page"), F.lit((1 << 31) - 1)) * F.col("count")).cast("decimal(38,0)"))
    per = each.groupBy("host", "kind", "token").agg(
        F.count(F.lit(1)).alias("n"), vector.cast("string").alias("vector"), (F.max("count") == 1).alias("once"), F.min("parent").alias("parent"), F.avg("place").alias("place"), F.sum("chars").alias("chars")
    )
    per = materialize(per.where(F.col("n") >= LEAST), "tokens")
    total = per.where(F.col("kind") == PAGE).select(F.col("host").alias("h"), F.col("n").alias("pages"))
    often = per.join(total, F.col("host") == F.col("h")).where("2 * n > pages")
    fields = ["kind", "token", "n", "vector", "once", "parent", "place", "chars"]
    grouped = often.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 64):
            made = [template(f) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m for m, _ in made], pa.int64()), pa.array([f for _, f in made], pa.list_(pa.int64()))], names=["host", "main", "fixed"])

    out = materialize(grouped.mapInArrow(run, "host string, main long, fixed array<long>").where("main IS NOT NULL OR size(fixed) > 0"), "templates")
    discard(per)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row; null or empty html gives empty text.

    Pages without url or host share the host ''. Repeated rows are treated alike. A very long page is read whole, in
    time that grows with its length; markup that is not closed is text. Other columns are not read; an empty table
    gives no rows.
    """
    host = ascii_lower(F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    known = templates(rows)
    size = known.agg(F.sum(F.length("host") + 8 * F.size("fixed") + 40)).first()[0] or 0
    if size <= BROADCAST:
        rows = rows.join(F.broadcast(known), "host", "left")
    else:
        # A host may have a third of all pages: its pages are dealt to several tasks, each with the template.
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)))
        rows = rows.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")
    rows = rows.select("page_id", "url", "html", "main", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            texts = [Page(source or "").text(main, frozenset(fixed or ())) for source, main, fixed in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
