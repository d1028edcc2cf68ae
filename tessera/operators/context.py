"""What a model is given: context text, image placeholders, graded documents and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

PLACEHOLDER = r"\[\[IMG:[^:\]]+:[^\]]+\]\]"


def image_map_of(entries: Column) -> Column:
    """An image map of a list of (idx, url); entries without number or address are left out, of repeated numbers the last counts."""
    ok = F.filter(entries, lambda e: e["idx"].isNotNull() & (F.coalesce(tx.stripped(e["url"]), F.lit("")) != ""))
    pairs = F.transform(ok, lambda e: F.struct(e["idx"].cast("string").alias("key"), e["url"].alias("value")))
    last = F.filter(pairs, lambda p, n: ~F.exists(F.slice(pairs, n + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later["key"] == p["key"]))
    return F.map_from_entries(last)


def filled_images(image_map: Column) -> Column:
    """The entries of a map whose address isn't blank; an empty map for null."""
    return F.coalesce(F.map_filter(image_map, lambda _, v: F.coalesce(tx.stripped(v), F.lit("")) != ""), F.create_map().cast("map<string,string>"))


def context(docs: DataFrame, by: str = "query_id", position: str = "position") -> DataFrame:
    """(by, context, image_registry): the documents of each question in order, each with its source and image placeholders.

    ``docs`` has page_content, source_url, docid and image_map. A question has as many documents as were retrieved for
    it, so its list is small.
    """
    images = filled_images(F.col("image_map"))
    marks = F.transform(F.map_keys(images), lambda k: F.concat(F.lit("[[IMG:"), F.col("docid"), F.lit(":"), k, F.lit("]]")))
    # fixed values: the words of the heading
    part = F.concat(F.lit("【来源】"), F.coalesce("source_url", F.lit("")), F.lit("\n"), "page_content")
    listed = F.array_join(F.transform(marks, lambda m: F.concat(F.lit("- "), m)), "\n")
    part = F.when(F.size(images) > 0, F.concat(part, F.lit("\n\n【图片占位符】\n"), listed)).otherwise(part)
    pairs = F.arrays_zip(marks.alias("key"), F.map_values(images).alias("value"))
    rows = docs.select(by, F.struct(F.col(position).alias("position"), part.alias("part"), pairs.alias("images")).alias("d"))
    ordered = rows.groupBy(by).agg(F.sort_array(F.collect_list("d")).alias("ds"))
    entries = F.array_distinct(F.transform(F.flatten(F.transform("ds", lambda d: d["images"])), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return ordered.select(by, F.array_join(F.transform("ds", lambda d: d["part"]), "\n\n").alias("context"), F.map_from_entries(entries).alias("image_registry"))


def graded_text(docs: DataFrame, by: str = "query_id", position: str = "position", count: int = 3, chars: int = 1200) -> DataFrame:
    """(by, documents): the first documents of each question, cut, under numbered headers: what a grader reads."""
    w = Window.partitionBy(by).orderBy(position)
    first = docs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= count)
    source = F.coalesce("source_url", F.lit(""))
    # fixed values: the words of the heading
    head = F.concat(F.lit("文档"), F.col("__n").cast("string"), F.when(source != "", F.concat(F.lit("（来源: "), source, F.lit("）"))).otherwise(""))
    part = F.concat(head, F.lit(":\n"), F.left(tx.stripped(F.coalesce("page_content", F.lit(""))), F.lit(chars)))
    rows = first.select(by, F.struct("__n", part.alias("part")).alias("d")).groupBy(by).agg(F.sort_array(F.collect_list("d")).alias("ds"))
    return rows.select(by, F.array_join(F.transform("ds", lambda d: d["part"]), "\n\n").alias("documents"))


def rendered(text: Column, registry: Column) -> Column:
    """Placeholders replaced by markdown images of their addresses; those the registry doesn't hold stay. The text is cut
    at its placeholders and put together again, so no address is searched for placeholders.
    """
    marks = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    between = F.split(text, PLACEHOLDER, -1)
    put = F.transform(marks, lambda m: F.coalesce(F.concat(F.lit("![]("), F.try_element_at(registry, m), F.lit(")")), m))
    return F.array_join(F.zip_with(between, put, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")


def history(messages: DataFrame, by: str = "conv_id", turn: str = "turn", keep: int = 8, welcome: str | None = None) -> DataFrame:
    """The messages a model is given of each conversation: drawings dropped, page additions removed, the last ``keep``; if
    the first is the welcome, all after it.
    """
    clean = messages.where(~F.coalesce(F.col("text"), F.lit("")).contains("<svg")).withColumn("text", tx.clean_message(F.coalesce("text", F.lit(""))))
    w = Window.partitionBy(by)
    ranked = clean.withColumn("__last", F.row_number().over(w.orderBy(F.desc(turn)))).withColumn("__first", F.row_number().over(w.orderBy(turn)))
    if welcome is None:
        return ranked.where(F.col("__last") <= keep).drop("__last", "__first")
    greeted = F.max(F.when((F.col("__first") == 1) & (F.col("text") == welcome), True)).over(w)
    return ranked.withColumn("__greeted", F.coalesce(greeted, F.lit(False))).where(F.when(F.col("__greeted"), F.col("__first") > 1).otherwise(F.col("__last") <= keep)).drop("__last", "__first", "__greeted")
