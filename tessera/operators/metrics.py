"""Evaluation: retrieval, answers, judges, feedback and latency, a row for each case and one row of summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def retrieval_items(cases: DataFrame, predicted: str = "predicted", expected: str = "expected_docids", k: int = 10) -> DataFrame:
    """hit, recall and mrr at ``k`` of each case. Repeated expected ids count each time in recall; no expected ids: skipped."""
    best = F.slice(F.coalesce(F.col(predicted), F.array().cast("array<string>")), 1, k)
    want = F.coalesce(F.col(expected), F.array().cast("array<string>"))
    found = F.size(F.filter(want, lambda e: F.array_contains(best, e)))
    first = F.array_min(F.filter(F.transform(want, lambda e: F.array_position(best, e)), lambda p: p > 0))
    skipped = F.size(want) == 0
    return cases.select(
        "*",
        skipped.alias("skipped"),
        F.when(skipped, 0.0).otherwise((found > 0).cast("double")).alias("hit"),
        F.when(skipped, 0.0).otherwise(found / F.size(want)).alias("recall"),
        F.when(skipped | first.isNull(), 0.0).otherwise(1.0 / first).alias("mrr"),
    )


def url_items(cases: DataFrame, predicted_urls: str = "predicted_urls", expected_urls: str = "expected_urls", k: int = 10) -> DataFrame:
    """The same by address: empty addresses go before places are counted, and recall is distinct matches over all expected."""
    filled = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != ""))
    best, want = F.slice(filled(predicted_urls), 1, k), filled(expected_urls)
    common = F.size(F.array_intersect(best, want))
    first = F.array_min(F.filter(F.transform(want, lambda e: F.array_position(best, e)), lambda p: p > 0))
    skipped = F.size(want) == 0
    return cases.select("*", skipped.alias("skipped"), F.when(skipped, 0.0).otherwise((common > 0).cast("double")).alias("hit"), F.when(skipped, 0.0).otherwise(common / F.size(want)).alias("recall"), F.when(skipped | first.isNull(), 0.0).otherwise(1.0 / first).alias("mrr"))


def _mean(c: str) -> Column:
    return F.round(F.coalesce(F.avg(F.when(~F.col("skipped"), F.col(c))), F.lit(0.0)), 6).alias(c)


def retrieval_summary(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over cases that weren't skipped, rounded to 6 digits, and both counts; one row, or one for each group."""
    grouped = items.groupBy(*(by or []))
    return grouped.agg(_mean("hit"), _mean("recall"), _mean("mrr"), F.count_if(~F.col("skipped")).cast("double").alias("evaluated_count"), F.count_if("skipped").cast("double").alias("skipped_count"))


def grouped_summary(items: DataFrame) -> DataFrame:
    """(difficulty, dataset_type, tag, ...): the summary by difficulty, by type, by both, by tag and of all, in one pass.

    An item counts once for each of its tags; a column that a row isn't grouped by is null. Grouping sets are computed from
    one shuffle of partial sums.
    """
    given = F.concat(F.array(F.lit(None).cast("string")), F.filter(F.array_distinct(F.coalesce("tags", F.array())), lambda t: t.isNotNull()))
    rows = items.withColumn("tag", F.explode(given))
    whole = F.col("tag").isNull()
    rows = rows.select(F.when(whole, F.col("difficulty")).alias("difficulty"), F.when(whole, F.col("dataset_type")).alias("dataset_type"), "tag", "skipped", "hit", "recall", "mrr", whole.alias("whole"))
    level, kind, tag, one = (F.col(c) for c in ("difficulty", "dataset_type", "tag", "whole"))
    grouped = rows.groupingSets([[one, level], [one, kind], [one, level, kind], [one], [one, tag]], one, level, kind, tag)
    out = grouped.agg(F.grouping_id().alias("set"), _mean("hit"), _mean("recall"), _mean("mrr"), F.count_if(~F.col("skipped")).cast("double").alias("evaluated_count"), F.count_if("skipped").cast("double").alias("skipped_count"))
    # whole items are grouped by level and kind, their tagged copies by the tag
    by_tag = F.col("set") == 6  # neither level nor kind is grouped by
    return out.where(F.when(by_tag, ~one).otherwise(one)).drop("whole", "set")


def url_summary(items: DataFrame, matched_by: str = "matched_by") -> DataFrame:
    both = items.agg(F.count_if(F.col(matched_by) == "url").alias("url_match_count"), F.count_if(F.col(matched_by) == "docid").alias("docid_fallback_count"))
    return retrieval_summary(items).crossJoin(both)  # a row each


def similarity_summary(items: DataFrame, similarity: str = "similarity", reference: str = "reference_answer") -> DataFrame:
    has = F.coalesce(F.col(reference), F.lit("")) != ""
    return items.agg(F.round(F.coalesce(F.avg(F.when(has, F.col(similarity))), F.lit(0.0)), 6).alias("text_similarity"), F.count_if(has).alias("evaluated_count"), F.count_if(~has).alias("skipped_count"))


JUDGED = ("relevance", "groundedness", "completeness")


def judged(answers: DataFrame, judge: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """The items of answers (query, answer, reference_answer) that a judge, a slot for a model, writes its scores of; a case
    without a reference is judged against an empty one.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return judge_items(answers.withColumn("judge_output", judge(text("query"), text("answer"), text("reference_answer"))))


def judge_items(answers: DataFrame, raw: str = "judge_output") -> DataFrame:
    """A judge's three scores and their mean; an answer that holds no JSON object scores zero, with the reason told."""
    body = tx.json_object(F.col(raw))
    parsed = F.from_json(body, "relevance string, completeness string, groundedness string, reason string")
    scores = [tx.safe_double(parsed[n]).alias(n) for n in JUDGED]
    total = sum((tx.safe_double(parsed[n]) for n in JUDGED[1:]), tx.safe_double(parsed[JUDGED[0]]))
    return answers.select("*", *scores, (total / len(JUDGED)).alias("judge_score"), F.when(body.isNull(), "invalid_json_from_judge").otherwise(F.coalesce(parsed["reason"], F.lit(""))).alias("reason"))


def judge_summary(items: DataFrame) -> DataFrame:
    names = (*JUDGED, "judge_score")
    return items.agg(*(F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(n) for n in names), F.count("*").alias("cases"))


def feedback_summary(items: DataFrame, rating: str = "user_rating", by: list[str] | None = None) -> DataFrame:
    rated = F.col(rating).isNotNull()
    return items.groupBy(*(by or [])).agg(
        F.round(F.coalesce(F.avg(rating), F.lit(0.0)), 6).alias("avg_rating"),
        F.round(F.try_divide(F.count_if(rated), F.count("*")), 6).alias("coverage"),
        F.count_if(rated).alias("rated_count"),
        F.count("*").alias("total_count"),
    )


def latency_items(events: DataFrame, session: list[str], seconds: str, chars: str) -> DataFrame:
    """Time to the first piece, total time and characters per second of each session of timed pieces; of one piece only, the first is the total."""
    grouped = events.groupBy(*session).agg(F.min(seconds).alias("first"), F.max(seconds).alias("last"), F.min(F.when(F.col(chars) > 0, F.col(seconds))).alias("piece"), F.sum(chars).alias("chars"))
    total = F.col("last") - F.col("first")
    ttft = F.coalesce(F.col("piece") - F.col("first"), total)
    return grouped.select(*session, ttft.alias("ttft"), total.alias("total"), F.when(total > 0, F.col("chars") / total).otherwise(0.0).alias("chars_per_second"))


def latency_summary(items: DataFrame) -> DataFrame:
    return items.agg(F.avg("ttft").alias("avg_ttft"), F.avg("total").alias("avg_total"), F.avg("chars_per_second").alias("avg_chars_per_second"))


def merged_summary(**parts: DataFrame) -> DataFrame:
    """One row with a struct of each one-row summary given."""
    out = None
    for name, df in parts.items():
        one = df.select(F.struct("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # a row each
    return out


def answered(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Cases with their answers, by case_id; a case without an answer gets an empty one."""
    return cases.join(answers.select("case_id", "answer"), "case_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def bad_cases(cases: DataFrame, items: DataFrame) -> DataFrame:
    """Cases whose hit or recall is under 1; a missing figure counts as 1."""
    low = items.where((F.coalesce("hit", F.lit(1.0)) < 1) | (F.coalesce("recall", F.lit(1.0)) < 1)).select("case_id")
    return cases.join(low, "case_id", "left_semi")


def new_cases(cases: DataFrame, existing: DataFrame) -> DataFrame:
    """Cases whose id the remote set doesn't hold yet."""
    return cases.join(existing.select("case_id"), "case_id", "left_anti")
