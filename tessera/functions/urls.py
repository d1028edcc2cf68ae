"""Scalar functions on addresses."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slugify

#: The generic syntax of RFC 3986, appendix B: scheme 2, authority 4, path 5, query 7.
RFC3986 = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
#: Endings of files that are no pages.
FILE_ENDINGS = r"\.(png|jpg|jpeg|gif|svg|webp|bmp|ico|pdf|zip|md)$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), RFC3986, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 2))


def host(url: Column) -> Column:
    return F.lower(part(url, 4))


def path(url: Column) -> Column:
    return part(url, 5)


def query(url: Column) -> Column:
    return part(url, 7)


def normalize_url(url: Column, aliases: dict[str, str] | None = None) -> Column:
    """Fragment dropped, scheme (https if none) and host in lower case, host aliases resolved, one closing slash removed, query kept."""
    s = F.when(scheme(url) == "", "https").otherwise(scheme(url))
    h = host(url)
    for alias, name in (aliases or {}).items():
        h = F.when(h == alias, name).otherwise(h)
    p = F.when(path(url) == "", "/").otherwise(path(url))
    p = F.when((F.length(p) > 1) & p.endswith("/"), F.left(p, F.length(p) - 1)).otherwise(p)
    q = F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), query(url)))
    return F.concat(s, F.lit("://"), h, p, q)


def is_valid_origin(url: Column, allowed_host: str, root: str = "/docs") -> Column:
    """A page of the documentation: https, the host, under ``root``, plain segments only, no resource and no file."""
    p, low = path(url), F.lower(path(url))
    rest = F.regexp_replace(F.substr(p, F.lit(len(root) + 1)), "^/+|/+$", "")
    return (scheme(url) == "https") & (host(url) == allowed_host) & ((p == root) | p.startswith(root + "/")) & ~p.contains("%") & ~low.contains("/_resources/") & ~low.rlike(FILE_ENDINGS) & ((rest == "") | rest.rlike(r"\A[A-Za-z0-9_-]+(/+[A-Za-z0-9_-]+)*\z"))


def is_allowed(url: Column, hosts: Sequence[str], prefixes: Sequence[str]) -> Column:
    starts = F.lit(False)
    for x in prefixes:
        starts = starts | path(url).startswith(x)
    return scheme(url).isin("http", "https") & host(url).isin(*hosts) & starts


def link_action(url: Column, hosts: Sequence[str], allowed_host: str, root: str = "/docs") -> Column:
    """What to do with a discovered link: ``fetch``, ``resolve`` (a redirect must tell its page) or null."""
    p = path(url)
    odd = F.lower(p).endswith(".md") | p.contains("%") | p.rlike(r"[^\x00-\x7F]")
    return F.when(~host(url).isin(*hosts) | ~p.startswith(root), None).when(odd, "resolve").when(is_valid_origin(url, allowed_host, root), "fetch")


def rest_path(url: Column, root: str = "/docs") -> Column:
    p = path(url)
    return F.regexp_replace(F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).otherwise(p), "^/+|/+$", "")


def slug_path(url: Column, source: str) -> Column:
    """``source/slug-digest.md``, the digest being the first ten digits of the address's md5."""
    raw = F.concat(part(url, 4), path(url), F.when(query(url) == "", "").otherwise(F.concat(F.lit("-"), query(url))))
    return F.concat(F.lit(source + "/"), slugify(raw), F.lit("-"), F.substring(F.md5(url), 1, 10), F.lit(".md"))


def route_path(url: Column, root: str = "/docs") -> Column:
    """``docs/a/b.md`` for a page /docs/a/b; the home page for the root."""
    rest = rest_path(url, root)
    leaf = F.element_at(F.split(rest, "/"), -1)
    named = F.regexp_replace(rest, r"(?<=[^/])\.[^./]+$", "")
    return F.when((rest == "") | (leaf == "home"), "docs/home.md").otherwise(F.concat(F.lit("docs/"), named, F.lit(".md")))


#: Where a page's markdown may lie below the data address, best first. ``page`` is its path, ``name`` the last
#: segment, ``above`` the path of the page above, ``group`` that page's last segment, ``short`` a path that ends in
#: "-started" without its last two letters. A place that needs what the page hasn't is left out.
DATA_PLACES = (
    "{page}/{name}_CN.md",
    "{page}_CN.md",
    "{above}/index_CN.md",
    "{above}/{group}_CN.md",
    "{low_page}/{low_name}_CN.md",
    "{low_page}_CN.md",
    "{short_page}/{short_name}_CN.md",
    "{short_page}_CN.md",
)
ROOT_PLACES = ("home/home_CN.md", "overview/overview_CN.md")
HOME_PLACES = (*ROOT_PLACES, "home_CN.md")


def data_candidates(url: Column, base: str, root: str = "/docs") -> Column:
    """The addresses, best first and each once, under which a page's markdown may lie."""
    rest = rest_path(url, root)
    steps = F.filter(F.split(rest, "/"), lambda x: x != "")
    page, name, nested = F.array_join(steps, "/"), F.element_at(steps, -1), F.size(steps) > 1
    above = F.when(nested, F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), "/"))
    short = F.when(name.endswith("-started"), F.left(name, F.length(name) - 2))
    values = {
        "page": page,
        "name": name,
        "above": above,
        "group": F.when(nested, F.try_element_at(steps, F.greatest(F.size(steps) - 1, F.lit(1)))),
        "low_page": F.when(F.lower(page) != page, F.lower(page)),
        "low_name": F.lower(name),
        "short_page": F.when(nested, F.concat(above, F.lit("/"), short)).otherwise(short),
        "short_name": short,
    }

    def placed(place: str) -> Column:
        parts = re.split(r"\{(\w+)\}", place)
        filled = F.concat(F.lit(f"{base}/"), *(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)))
        return F.when(name == "index", filled) if place.endswith("/index_CN.md") else filled

    fixed = lambda places: F.array_distinct(F.array(*(F.lit(f"{base}/{p}") for p in places)))
    found = F.array_distinct(F.filter(F.array(*map(placed, DATA_PLACES)), lambda x: x.isNotNull()))
    return F.when(rest == "", fixed(ROOT_PLACES)).when(rest == "home", fixed(HOME_PLACES)).otherwise(found)


def route_of_data(url: Column, site: str, root: str = "/docs") -> Column:
    """The page a markdown file belongs to: language endings removed, a/a taken for a; null if it isn't markdown under /dist/."""
    p = path(url)
    rel = F.regexp_replace(F.regexp_extract(p, r"/dist/(.*)$", 1), "^/+|/+$", "")
    parts = F.filter(F.split(rel, "/"), lambda x: x != "")
    stem = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"(?i)\.md$", ""), "_(CN|EN)$", "")
    parent = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    route = F.when((F.size(parent) > 0) & (stem == F.try_element_at(parent, F.lit(-1))), parent).otherwise(F.concat(parent, F.array(stem)))
    joined = F.regexp_replace(F.array_join(route, "/"), "^/+|/+$", "")
    full = F.when(joined == "", site + root).otherwise(F.concat(F.lit(f"{site}{root}/"), joined))
    return F.when(p.contains("/dist/") & F.lower(rel).endswith(".md") & (F.size(parts) > 0), full)


def _join(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as seen from a page; RFC 3986 resolution has no built-in."""
    return pd.Series([_join(b, x) if x is not None else None for b, x in zip(base, link)])


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = next((v for k, v in attrs if k == "href"), None)
            if href and href.strip():
                self.found.append(href.strip())


@F.pandas_udf(T.ArrayType(T.StringType()))
def anchors(html: pd.Series) -> pd.Series:
    """The targets of all anchors, in page order; blank ones are left out. HTML needs a parser, and there is no built-in one."""

    def one(x):
        p = _Anchors()
        p.feed(x)
        p.close()
        return p.found

    return pd.Series([one(x) if x else [] for x in html], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolved_all(base: pd.Series, links: pd.Series) -> pd.Series:
    """Some links as seen from a page."""
    return pd.Series([[_join(b, x) for x in xs] if xs is not None else [] for b, xs in zip(base, links)], dtype=object)
