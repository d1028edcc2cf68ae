"""HTML extraction by equivalence-class template deduction.

Tokens are tags in the context of their enclosing containers. Tokens of a host's pages that occur equally often in every
page, that is, share an occurrence vector, are one equivalence class. A class is valid if its tokens stand in one order
in the page and its occurrences nest; valid classes nested in each other are the template, what lies between two of its
tokens is a slot. A slot that holds one text in nearly all pages of a host is furniture, unless it stands in an article. In
the slots that vary, tag names, roles and class words tell what else is; the rest is read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|itemprop|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Containers make a token's context; the other tags only part blocks or mark text.
CONTAINERS = frozenset("html body nav header footer aside article main section div form ul ol dl table figure details dialog menu fieldset button address blockquote".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
#: Words of class names and ids. Those of HEADER_WORDS are furniture outside of articles only.
HEADER_WORDS = frozenset(("header", "masthead"))
MAIN_WORDS = frozenset("article articlebody main maincontent content post postbody entry story".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer notice notices cookie cookies consent gdpr popup modal overlay alert comment comments disqus reply replies discussion related recommended recommendations share sharing social newsletter subscribe subscription signup login search pagination pager toolbar skip copyright legal".split()
)
HIDDEN = "not-shown"
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: A token belongs to the template if so large a share of a host's pages hold it.
SUPPORT = 0.5
#: A slot is fixed if its pages are FIXED_PAGES or more, and so large a share of them hold the same text. On hosts where the
#: other slots have less than VARIED of the text, pages are copies and their template tells nothing.
FIXED_PAGES, FIXED, VARIED = 3, 0.9, 0.2
#: Bytes of templates up to which they are sent to every task; beyond, pages and templates meet in a shuffle join.
BROADCAST_BYTES = 64 << 20


def context(attributes: str) -> str:
    """What a container's attributes add to its tokens: the letters of its class, id and role, and whether it is hidden."""
    label = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            label.append(HIDDEN)
        elif name in ("class", "id", "role", "itemprop"):
            label += sorted(x for x in re.sub(r"[^a-z_ -]", "", value).split() if x != HIDDEN)
    return ".".join(label)


class Page:
    """A page's template candidates and text: events are (token, None) for a tag in context and (None, text) for text."""

    def __init__(self, source: str):
        self.events: list[tuple] = []
        stack: list[tuple[str, str]] = []
        path = ""
        last, forms = 0, {}
        for m in MARKUP.finditer(source):
            if m.start() > last:
                self.events.append((None, source[last : m.start()], path))
            last = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            closing = source[m.start() + 1] == "/"
            if tag not in CONTAINERS:
                if tag not in INLINE:
                    self.events.append((f"{path}<{tag}" if tag not in ("p", "br") else "", "", path))
                continue
            if closing:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
                if depth < 0:
                    continue
                path = stack[depth][1]
                del stack[depth:]
                self.events.append((f"{path}</{tag}", "", path))
            else:
                key = m[3]
                label = forms.get(key)
                if label is None:
                    label = forms[key] = context(key)
                step = tag + ("." + label if label else "")
                token = f"{path}<{step}"
                stack.append((tag, path))
                path = f"{path}/{step}"
                self.events.append((token, "", path))
        if last < len(source):
            self.events.append((None, source[last:], path))

    def tokens(self) -> Counter:
        return Counter(e[0] for e in self.events if e[0])


def host_of(url: Column) -> Column:
    """The host of a url in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, token, vector, support) of each host's template tokens; tokens of one ``vector`` are an equivalence class.

    A token's occurrence vector is kept as a sum, over the host's pages, of a hash of the page and its count there, so
    equal vectors are found by partial sums, whatever the number of a host's pages.
    """

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, row, source in zip(b["host"], b["row"], b["html"]):
                found = Page(source).tokens() if source else {}
                found["*"] = 1  # every page counts
                out += [(host, row, token, n) for token, n in found.items()]
            yield pd.DataFrame(out, columns=["host", "row", "token", "n"])

    seen = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("row"), "html").mapInPandas(occurrences, "host string, row long, token string, n int")
    half = lambda seed: F.sum((F.xxhash64("row", "n", F.lit(seed)) % (1 << 40)).cast("decimal(38,0)"))
    sums = saved(seen.groupBy("host", "token").agg(F.count("*").alias("support"), half(1).alias("a"), half(2).alias("b")), "tokens")
    pages_of = sums.where("token = '*'").select("host", F.col("support").alias("pages"))
    tokens = sums.where("token <> '*'").join(pages_of, "host").where(F.col("support") >= F.greatest(F.lit(1), F.ceil(F.col("pages") * SUPPORT)))
    return tokens.select("host", "token", F.xxhash64("support", "a", "b").alias("vector"), "support", "pages")


def _nests(tokens: list[str]) -> bool:
    """Whether the closing tags of a round close what the round opened: no element ends before it begins, or crosses another."""
    opened, spans = {}, []
    for at, token in enumerate(tokens):
        place, _, tag = token.rpartition("<")
        if not tag.startswith("/"):
            element = place, tag.partition(".")[0]
            opened[element] = None if element in opened else at
    for at, token in enumerate(tokens):
        place, _, tag = token.rpartition("<")
        start = opened.get((place, tag[1:])) if tag.startswith("/") else None
        if start is not None:
            spans.append((start, at))
    return all(s < e for s, e in spans) and not any(s < t < e < f for s, e in spans for t, f in spans)


def _valid(events: list[tuple], classes: dict[str, int]) -> set[str]:
    """The tokens of valid classes in a page: in every round of the class its tokens come in one order, its closing tags
    close what the class opened, and no round crosses one of a class with longer rounds: spans nest or are apart.
    """
    sequences: dict[int, list[tuple[int, str]]] = {}
    for at, (token, _, _) in enumerate(events):
        if token in classes:
            sequences.setdefault(classes[token], []).append((at, token))
    spans: list[tuple[int, int, int]] = []
    sizes: dict[int, int] = {}
    for c, own in sequences.items():
        size = len({t for _, t in own})
        first = [t for _, t in own[:size]]
        if len(own) % size == 0 and all(own[k][1] == first[k % size] for k in range(len(own))) and (size == 1 or _nests(first)):
            sizes[c] = size
            if size > 1:
                spans += [(own[k][0], own[k + size - 1][0], c) for k in range(0, len(own), size)]
    stack: list[tuple[int, int]] = []
    for start, end, c in sorted(spans):
        while stack and stack[-1][0] < start:
            stack.pop()
        if c not in sizes:
            continue
        while stack and stack[-1][0] < end:  # crosses: the class of shorter rounds goes
            other = stack[-1][1]
            if other in sizes and sizes[other] >= sizes[c]:
                del sizes[c]
                break
            sizes.pop(other, None)
            stack.pop()
        if c in sizes:
            stack.append((end, c))
    return {t for c in sizes for _, t in sequences[c]}


def cut(events: list[tuple], classes: dict[str, int]) -> list[tuple[str, list]]:
    """The slots of a page: the key of each slot's place, that is the template token before it with its number in the
    page, and the slot's texts and breaks (None) with their paths.
    """
    template = _valid(events, classes)
    met: Counter = Counter()
    slots: list[tuple[str, list]] = [("#0", [])]
    for token, text, path in events:
        if token is None:
            slots[-1][1].append((path, text))
        elif token in template:
            slots.append((f"{token}#{met[token]}", []))
            met[token] += 1
        else:
            slots[-1][1].append((path, None))  # parts two blocks
    return slots


def fixed_slots(pages: DataFrame) -> DataFrame:
    """(host, slot) of the slots that hold the same text in nearly all pages of their host, from ``pages`` with their
    host's ``template`` and number of ``pages``. Only hashes of the slots' texts are dealt.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, pages, source, template in zip(b["host"], b["pages"], b["html"], b["template"]):
                for slot, own in cut(Page(source).events, dict(template)):
                    text = " ".join("".join(t or " " for _, t in own).split())
                    if text:
                        out.append((host, pages, slot, xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), len(text)))
            yield pd.DataFrame(out, columns=["host", "pages", "slot", "text", "size"])

    many = pages.where((F.col("pages") >= FIXED_PAGES) & F.col("html").isNotNull())
    seen = many.select("host", "pages", "html", "template").mapInPandas(texts, "host string, pages long, slot string, text long, size long")
    same = seen.groupBy("host", "pages", "slot", "text").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    slots = same.groupBy("host", "pages", "slot").agg(F.max("n").alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    fixed = (F.col("n") >= F.greatest(F.lit(FIXED_PAGES), F.ceil(F.col("pages") * SUPPORT))) & (F.col("top") >= F.col("n") * FIXED)
    slots = saved(slots.select("host", "slot", "size", fixed.alias("fixed")), "slots")
    told = slots.groupBy("host").agg(F.sum(F.when(F.col("fixed"), 0).otherwise(F.col("size"))).alias("varied"), F.sum("size").alias("all")).where(F.col("varied") >= F.col("all") * VARIED)
    return slots.where("fixed").join(told.select("host"), "host").select("host", "slot")


def extract(source: str | None, classes: dict[str, int]) -> str:
    """The main text of a page, given its host's template tokens and their classes, and its fixed slots (key: 0).

    The template's tokens cut the page in slots. Outside of main elements a slot is furniture if it is fixed on the host; of other
    slots, what lies in furniture by its path. If any slot left lies in an article or main element, only such slots are read.
    """
    if not source:
        return ""
    slots = cut(Page(source).events, classes)
    roles: dict[str, tuple[bool, bool]] = {}

    def role(path: str) -> tuple[bool, bool]:
        """Whether a path lies in furniture, and in a main element."""
        found = roles.get(path)
        if found is None:
            furniture = main = False
            for step in path.split("/")[1:]:
                tag, _, label = step.partition(".")
                words = set(re.split(r"[^a-z]+", label))
                own = words & FURNITURE_WORDS or words & ROLES or HIDDEN in label.split(".")
                if tag in ("article", "main") or (words & MAIN_WORDS and not own):
                    main = main or not furniture
                # a header within an article is the article's own
                header = (tag == "header" or words & HEADER_WORDS) and not main
                if tag not in ("html", "body", "article", "main") and (tag in FURNITURE_TAGS or own or header):
                    furniture = True
            found = roles[path] = (furniture, main)
        return found

    # a heading that all articles of a host have is their text: a fixed slot is furniture outside of main elements only
    pieces = [(*role(path), text) for slot, own in slots for path, text in [*(x for x in own if slot not in classes or role(x[0]) == (False, True)), ("", None)]]
    main = any(m and not f and t is not None and not t.isspace() for f, m, t in pieces)
    blocks, block = [], []
    for furniture, within, text in pieces:
        if text is None:
            blocks.append("".join(block))
            block = []
        elif not furniture and (within or not main):
            block.append(text)
    blocks.append("".join(block))
    return " ".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``text`` and ``n_chars``.

    Pages are read where they are and the templates sent to them, if their size allows; else both meet by host in a
    shuffle join, which splits a host of many pages.
    """
    found = templates(pages).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("token", "vector"))).alias("template"), F.first("pages").alias("pages"))
    found = saved(found, "templates")

    def joined(templates: DataFrame) -> DataFrame:
        size = templates.agg(F.coalesce(F.sum(F.length(F.to_json("template"))), F.lit(0))).first()[0]
        side = F.broadcast(templates) if size <= BROADCAST_BYTES else templates
        return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(side, "host", "left")

    fixed = fixed_slots(joined(found)).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.lit(0).cast("long")))).alias("fixed"))
    both = found.join(fixed, "host", "left")
    whole = saved(both.select("host", F.when(F.col("fixed").isNull(), F.col("template")).otherwise(F.map_concat("template", "fixed")).alias("template")), "slots")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, maps in batches:
            yield pd.Series([extract(s, dict(m) if m is not None else {}) for s, m in zip(sources, maps)])

    out = joined(whole).select("page_id", "url", read("html", "template").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page. Null and empty pages give empty text; a null or odd url puts a page
    with the others of no host; repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
