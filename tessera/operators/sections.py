"""Sections of markdown texts in built-in expressions, and splitting them by a table function in a lateral join."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunking import LEVELS, OVERLAP, SIZE, recursive_split

#: White space at the ends of a line, line feeds left out.
BLANK = r"[\t\x0B\f\r \x1c-\x1f\x85\p{Z}]"
#: A fenced block: from a line that opens it to the next line that begins with the same fence, or the text's end.
FENCE = rf"(?dms)^{BLANK}*(```|~~~).*?(?:\n{BLANK}*\1[^\n]*|\z)"


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def marked_lines(text: Column) -> Column:
    """A text's lines as array<struct<fenced, line>>, ends stripped; what stands in fenced code is marked."""
    fences = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    lines = lambda c, fenced: F.transform(F.split(c, "\n", -1), lambda x: F.struct(F.lit(fenced).alias("fenced"), _bare(x).alias("line")))

    def piece(outside: Column, i: Column) -> Column:
        free = lines(outside, False)
        return F.concat(free, F.coalesce(lines(F.get(fences, i), True), F.filter(free, lambda _: F.lit(False))))

    return F.flatten(F.transform(F.split(text, FENCE, -1), piece))


def header_sections(docs: DataFrame, text: str) -> DataFrame:
    """Sections of each text: the columns of ``docs`` but ``text``, section (from 0), h1, h2, h3 and content.

    A header holds until one of its level or a higher one: over a text's lines up to the current one, the last header of a
    level counts if it stands behind the last of each higher level. A section is a run of lines under the same headers; its
    blank lines and header lines go. Null texts, and texts of headers alone, give no section; repeated rows are split each for
    itself. A text's lines meet in one task, as the text did.
    """
    names = list(LEVELS.values())
    keys = [c for c in docs.columns if c != text]
    # numbered before they are taken apart: beside a generator the number would be a line's
    rows = docs.select(F.struct(*keys, F.lit(0).alias("__none")).alias("__doc"), F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"))
    rows = rows.select("__doc", "__row", F.posexplode(marked_lines(F.col("__text"))).alias("__at", "__m")).where("__m.line <> ''").select("__doc", "__row", "__at", "__m.fenced", "__m.line")
    level = F.lit(None).cast("string")
    title = F.lit(None).cast("string")
    for mark, name in LEVELS.items():
        own = ~F.col("fenced") & F.startswith("line", F.lit(mark))
        level, title = F.when(own, name).otherwise(level), F.when(own, _bare(F.substr("line", F.lit(len(mark) + 1)))).otherwise(title)
    rows = rows.select("__doc", "__row", "__at", "line", level.alias("__level"), title.alias("__title"))
    order = Window.partitionBy("__row").orderBy("__at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    of = lambda c, name: F.when(F.col("__level") == name, F.col(c))
    for name in names:
        rows = rows.withColumn(f"__at_{name}", F.max(of("__at", name)).over(so_far)).withColumn(f"__{name}", F.last(of("__title", name), True).over(so_far))
    for k, name in enumerate(names):
        behind = F.lit(True)
        for higher in names[:k]:
            behind &= F.col(f"__at_{name}") > F.coalesce(f"__at_{higher}", F.lit(-1))
        rows = rows.withColumn(name, F.when(behind, F.col(f"__{name}")))
    rows = rows.where("__level is null").select("__doc", "__row", "__at", "line", F.struct(*names).alias("__headers"))
    # headers differ by value: the same names met again right after each other make no new section
    new = F.lag("__at").over(order).isNull() | ~F.col("__headers").eqNullSafe(F.lag("__headers").over(order))
    rows = rows.withColumn("section", F.sum(new.cast("int")).over(so_far) - 1)
    # rows of a text are together already, so its sections are gathered without a second shuffle
    whole = rows.groupBy("__row", "section").agg(F.first("__doc").alias("__doc"), F.first("__headers").alias("__headers"), F.sort_array(F.collect_list(F.struct("__at", "line"))).alias("__lines"))
    return whole.select(*(F.col("__doc")[c].alias(c) for c in keys), F.col("section").cast("int"), "__headers.*", F.array_join(F.col("__lines.line"), "  \n").alias("content"))


@F.udtf(returnType="chunk_index int, chunk string")
class split_text:
    """A table function: (chunk_index, chunk) of a text by ``chunking.recursive_split``; a null text gives no row."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(recursive_split(text, size, overlap) if text is not None else ())


def register(spark: SparkSession) -> None:
    """Make ``split_text`` known to SQL: ``from docs, lateral split_text(text, 1000, 128)``."""
    spark.udtf.register("split_text", split_text)


def split_sections(sections: DataFrame, content: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sections with chunk_index and chunk instead of their content, by a lateral join: nothing is shuffled."""
    return sections.lateralJoin(split_text(F.col(content).outer(), F.lit(size), F.lit(overlap))).drop(content)
