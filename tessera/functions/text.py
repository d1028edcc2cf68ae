"""Scalar functions on text: columns in, columns out, all of built-in expressions but for the last few."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks

DEFAULT_TOKEN = r"[\p{L}\p{N}]+"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def stripped(c: Column) -> Column:
    """White space of both ends removed, line ends and tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space turned into one space, both ends stripped."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column, pattern: str = DEFAULT_TOKEN) -> Column:
    """Lower-case runs of letters and digits; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(stripped(c)), r"[^a-z0-9._-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-+|-+$", "")
    return F.when(s == "", "index").otherwise(s)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def source_docid(source_url: Column, docdata_url: Column, filename: Column) -> Column:
    """One id for all chunks of a file: by its source address, else its data address, else its name."""
    source = F.coalesce(blank_to_null(source_url), blank_to_null(docdata_url), filename)
    return F.concat(F.lit("doc-"), F.substring(F.sha1(source), 1, 12))


def content_docid(docid: Column, url: Column, index: Column, content: Column) -> Column:
    """The given id if there is one, else an id by address, position and content, white space collapsed."""
    clean = lambda c: collapsed(F.coalesce(c, F.lit("")))
    raw = F.concat_ws("|", clean(url), index.cast("string"), clean(content))
    return F.coalesce(blank_to_null(docid), F.concat(F.lit("doc_"), F.substring(F.sha1(raw), 1, 16)))


def stable_docid(docid: Column, source_url: Column, source_file: Column, position: Column) -> Column:
    """The given id if there is one, else an id by address, file or position."""
    source = F.coalesce(blank_to_null(source_url), blank_to_null(source_file), F.concat(F.lit("doc-"), position.cast("string")))
    return F.coalesce(blank_to_null(docid), F.concat(F.lit("doc-"), F.substring(F.sha1(source), 1, 12)))


def query_key(c: Column) -> Column:
    """A key under which questions count as the same: only digits, latin letters and CJK ideographs, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z一-鿿]+", "")


def normalize_query(c: Column) -> Column:
    return F.replace(normalize_answer(c), F.lit("？？"), F.lit("？"))


def normalize_answer(c: Column) -> Column:
    return collapsed(F.coalesce(c, F.lit("")))


#: Difficulty names and what they count as.
DIFFICULTIES = {"simple": "easy", "easy": "easy", "medium": "medium", "normal": "medium", "hard": "hard", "complex": "hard"}


def normalize_difficulty(value: Column, position: Column, total: Column, inclusive: bool = False) -> Column:
    """A known difficulty, else one by place in the set: 40/40/20, or 50/30/20 with inclusive bounds."""
    val = F.lower(stripped(F.coalesce(value, F.lit(""))))
    ratio = position / total
    easy, medium = (ratio <= 0.5, ratio <= 0.8) if inclusive else (ratio < 0.4, ratio < 0.8)
    by_place = F.when(total <= 0, "easy").when(easy, "easy").when(medium, "medium").otherwise("hard")
    known = F.lit(None).cast("string")
    for name, level in DIFFICULTIES.items():
        known = F.when(val == name, level).otherwise(known)
    return F.coalesce(known, by_place)


def title_from_url(url: Column) -> Column:
    part = F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "/"), -1)
    return F.left(stripped(F.translate(part, "-_", "  ")), F.lit(40))


#: Titles that say nothing.
GENERIC_TITLES = ("", "untitled", "模型概览", "概览", "介绍")


def is_generic_title(title: Column) -> Column:
    return F.lower(stripped(F.coalesce(title, F.lit("")))).isin(*GENERIC_TITLES)


def normalize_title(title: Column, url: Column) -> Column:
    clean = stripped(F.coalesce(title, F.lit("")))
    # fixed values: the title where nothing else is known
    return F.when(is_generic_title(clean), F.coalesce(blank_to_null(title_from_url(url)), blank_to_null(clean), F.lit("文档主题"))).otherwise(clean)


def snippet(c: Column, size: int = 280) -> Column:
    return F.left(stripped(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), F.lit(size))


#: Phrases of questions that are too weak to keep.
WEAK_PHRASES = ("主要介绍了什么", "如何快速理解")


def is_weak_question(c: Column) -> Column:
    out = F.lit(False)
    for phrase in WEAK_PHRASES:
        out = out | F.coalesce(c, F.lit("")).contains(phrase)
    return out


def json_object(c: Column) -> Column:
    """The JSON object within a model's answer: code fences removed, then from the first brace to the last; null if there is none that parses."""
    clean = stripped(F.coalesce(c, F.lit("")))
    clean = F.when(clean.startswith("```"), stripped(F.regexp_replace(stripped(F.regexp_replace(clean, r"^```[a-zA-Z]*", "")), r"```$", ""))).otherwise(clean)
    found = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    return F.when(F.typeof(F.try_parse_json(found)).isNotNull() & F.try_parse_json(found).isNotNull(), found)


def safe_double(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def reference_overlap(answer: Column, reference: Column) -> Column:
    """Share of the reference's distinct words that stand in the answer; null if the reference has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    ref = words(reference)
    return F.when(F.size(ref) > 0, F.size(F.array_intersect(words(answer), ref)) / F.size(ref))


#: What the chat page adds to an answer.
FEEDBACK_MARKUP = r"(?s)<div class='inline-feedback'.*?</div>|<small class='feedback-indicator'.*?</small>"


def clean_message(c: Column) -> Column:
    return F.regexp_replace(c, FEEDBACK_MARKUP, "")


def caption_text(parts: Column, limit: int = 120) -> Column:
    """A caption from a model's parts (type, text): the texts joined by spaces, at most ``limit`` characters."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.left(collapsed(F.array_join(texts, " ")), F.lit(limit))


#: Captions without a model.
CAPTION_OF_ALT, CAPTION = "图片内容与“{alt}”相关。", "文档配图，建议结合上下文理解。"


def fallback_caption(alt: Column) -> Column:
    return F.when(F.coalesce(alt, F.lit("")) != "", F.concat(F.lit(CAPTION_OF_ALT.split("{alt}")[0]), alt, F.lit(CAPTION_OF_ALT.split("{alt}")[1]))).otherwise(CAPTION)


def interleaved(between: Column, put: Column) -> Column:
    """The parts of a text that was split, with what is put between them: one more part than there is to put."""
    pairs = F.arrays_zip(between.alias("part"), put.alias("put"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["part"], F.coalesce(p["put"], F.lit("")))), "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _repaired(runs: pd.Series) -> pd.Series:
    """All of a text's runs that were UTF-8 read as GBK, set right; null if one is none. No built-in encodes GBK."""

    def all_of(own):
        try:
            return [x.encode("gbk").decode("utf-8") for x in own]
        except UnicodeError:
            return None

    return pd.Series([None if own is None else all_of(own) for own in runs], dtype=object)


def repair_mojibake(c: Column) -> Column:
    """Text that was UTF-8 read as GBK, set right; any other text as it is.

    ASCII is the same in both, and no character's bytes go across it, so a text is UTF-8 if each of its other runs is, and
    only those go to Python.
    """
    other = r"[^\x00-\x7F]+"
    found = interleaved(F.split(c, other, -1), _repaired(F.regexp_extract_all(c, F.lit(other), F.lit(0))))
    return F.when(_repaired(F.regexp_extract_all(c, F.lit(other), F.lit(0))).isNull(), c).otherwise(found)


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The order-sensitive ratio of two texts' common blocks (see ``blocks``), once for equal pairs of a batch; nulls count as empty."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.fillna(""), b.fillna("")):
        if pair not in known:
            known[pair] = blocks.ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=float)
