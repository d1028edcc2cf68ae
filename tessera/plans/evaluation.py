"""Queries of evaluation sets, answers, judges, feedback, routing and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context, evalset, metrics
from ..streaming import streams
from . import flow
from .retrieval import WORDS, read


def _raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with all kinds of faults, by the numbers of the labels."""
    l = read(spark, sf_dir, "labels")
    n = F.col("doc_id")
    return l.select(
        F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit("case_"), n.cast("string"))).alias("case_id"),
        F.when(n % 13 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("question "), n.cast("string"))).alias("query"),
        F.array(n.cast("string")).alias("expected_docids"),
        F.lit(None).cast("string").alias("reference_answer"),
        F.when(n % 3 == 0, "answer").alias("bot_answer"),
        F.when(n % 4 == 0, "good").when(n % 4 == 1, "4.5").alias("user_rating"),
        F.lit(None).cast("string").alias("user_feedback"),
        F.when(n % 17 == 0, "other").when(F.col("toxic") == 1, " Feedback").otherwise("qa").alias("dataset_type"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.when(n % 19 == 0, "unknown").when(F.col("quality") == 1, "Easy").otherwise("hard").alias("difficulty"),
        F.lit(None).cast("string").alias("metadata"),
    )


def evalcase_validate(spark, sf_dir):
    out = evalset.validated(_raw_cases(spark, sf_dir))
    return out.select("case_id", "query", "dataset_type", "difficulty", "user_rating", "valid", F.coalesce("error", F.lit("")).alias("error"))


def _judged(spark, sf_dir):
    l = read(spark, sf_dir, "labels")
    n = F.col("doc_id")
    good = F.concat(F.lit('```json\n{"relevance": '), (n % 5 / 4).cast("string"), F.lit(', "completeness": "'), F.col("quality").cast("string"), F.lit('", "groundedness": '), (1 - F.col("toxic")).cast("string"), F.lit(', "reason": "r"}\n```'))
    return l.select("doc_id", F.when(n % 7 == 0, "no object here").otherwise(good).alias("judge_output"))


def judge_parse(spark, sf_dir):
    out = metrics.judge_items(_judged(spark, sf_dir))
    return out.select("doc_id", "relevance", "completeness", "groundedness", F.round("judge_score", 6).alias("judge_score"), "reason")


def judge_summary(spark, sf_dir):
    return metrics.judge_summary(metrics.judge_items(_judged(spark, sf_dir)))


JUDGED = """ju as (select doc_id, case when doc_id % 7 = 0 then 0.0::double else (doc_id % 5) / 4.0::double end relevance, case when doc_id % 7 = 0 then 0.0::double else quality::double end completeness,
case when doc_id % 7 = 0 then 0.0::double else (1 - toxic)::double end groundedness, case when doc_id % 7 = 0 then 'invalid_json_from_judge' else 'r' end reason from labels)"""


def _feedback(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), "user_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("user_rating"))


def feedback_summary(spark, sf_dir):
    return metrics.feedback_summary(_feedback(spark, sf_dir))


def feedback_daily(spark, sf_dir):
    f = _feedback(spark, sf_dir).withColumn("file", F.concat(F.lit("feedback_"), F.date_format("timestamp", "yyyy-MM-dd"), F.lit(".json")))
    return metrics.feedback_summary(f, by=["file"])


FEEDBACK = "fb as (select event_id, ts, event_type, case when event_id % 3 = 0 then value end user_rating from events)"
FEEDBACK_SUMMARY = "round(coalesce(avg(user_rating), 0), 6) avg_rating, round(count(user_rating) / count(*)::double, 6) coverage, count(user_rating) rated_count, count(*) total_count"


def _latency(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return metrics.latency_items(e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("s"), F.length("props").alias("chars")).withColumn("s", F.col("s") / 1e6), ["user_id", "day"], "s", "chars")


def latency_items(spark, sf_dir):
    return _latency(spark, sf_dir).select("user_id", "day", F.round("ttft", 3).alias("ttft"), F.round("total", 3).alias("total"), F.round("chars_per_second", 6).alias("chars_per_second"))


def latency_summary(spark, sf_dir):
    out = metrics.latency_summary(_latency(spark, sf_dir))
    return out.select(*(F.round(c, 3).alias(c) for c in out.columns))


LATENCY = """la as (select user_id, strftime(ts, '%Y-%m-%d') as "day", min(epoch_us(ts)::double / 1e6) f, max(epoch_us(ts)::double / 1e6) l, min(epoch_us(ts)::double / 1e6) filter (length(props) > 0) p, sum(length(props)) chars from events group by 1, 2),
li as (select user_id, "day", coalesce(p - f, l - f) ttft, l - f total, case when l > f then chars / (l - f) else 0.0::double end chars_per_second from la)"""


def _pairs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("reference", F.lag("text").over(w)).where("role = 'assistant' and reference is not null").select("conv_id", "turn", "text", "reference")


def reference_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(tx.reference_overlap(F.col("text"), F.col("reference")), 6).alias("overlap"))


def text_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(tx.text_similarity("text", "reference"), 6).alias("similarity"))


PAIRS = "pr as (select * from (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) reference from conversations where role in ('user', 'assistant')) where role = 'assistant' and reference is not null)"


def upload_antijoin(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").withColumn("case_id", F.col("item_id").cast("string"))
    return metrics.new_cases(b, b.where("item_id % 3 = 0")).select("item_id", "text")


def answers_join(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").withColumn("case_id", F.col("item_id").cast("string"))
    given = b.where("item_id % 2 = 0").select("case_id", F.concat("text", F.lit("!")).alias("answer"))
    return metrics.answered(b, given).select("item_id", F.length("answer").cast("long").alias("n_chars"))


def grade_routing(spark, sf_dir):
    l = read(spark, sf_dir, "labels").withColumn("loop_step", (F.col("doc_id") % 2).cast("int"))
    score = F.when(F.col("quality") == 1, "yes").otherwise("no")
    return l.select("doc_id", "loop_step", flow.grade_route(F.col("doc_id") % 5 != 0, F.col("loop_step"), score).alias("next"), flow.grade_route(F.col("doc_id") % 5 != 0, F.col("loop_step"), score, False).alias("next_lenient"))


def route_router(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", flow.datasource_route(F.when(F.col("role") == "system", "chat").otherwise("docs")).alias("route"))


def route_decompose(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    parts = F.when(F.col("turn") % 3 == 0, F.lit(None).cast("array<string>")).when(F.col("turn") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array("text"))
    return c.select("conv_id", "turn", flow.complexity_route(parts).alias("route"))


def history_tail(spark, sf_dir):
    return context.history(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"))


def message_clean(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    dirty = F.concat("text", F.lit("<div class='inline-feedback' id='x'>rate\nme</div>"), F.when(F.col("turn") % 2 == 0, "<small class='feedback-indicator'>ok</small>").otherwise(""))
    return c.select("conv_id", "turn", F.sha2(tx.clean_message(dirty), 256).alias("text_hash"))


def loop_steps(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 2).alias("rewritten"))
    return streams.conversation_totals(c)


def _placed(spark, sf_dir):
    """The documents, with their number as ``total``."""
    d = read(spark, sf_dir, "documents")
    return d.crossJoin(F.broadcast(d.agg(F.count("*").alias("total"))))  # one row


def difficulty_normalize(spark, sf_dir):
    d = _placed(spark, sf_dir)
    given = F.when(F.col("doc_id") % 4 == 0, " Simple").when(F.col("doc_id") % 4 == 1, "COMPLEX")
    a = tx.normalize_difficulty(given, F.col("doc_id"), F.col("total"))
    b = tx.normalize_difficulty(given, F.col("doc_id"), F.col("total"), inclusive=True)
    return d.select("doc_id", a.alias("difficulty"), b.alias("difficulty_inclusive"))


def _first_words(n):
    return F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, n), " ")


def query_key_dedup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", tx.query_key(_first_words(2)).alias("key"))
    w = Window.partitionBy("key").orderBy("doc_id")
    return d.select("doc_id", "key", (F.row_number().over(w) > 1).alias("is_repeat"))


def template_questions(spark, sf_dir):
    d = _placed(spark, sf_dir)
    level = tx.normalize_difficulty(F.lit(""), F.col("doc_id"), F.col("total"))
    rows = d.select("doc_id", "source", level.alias("level"), tx.snippet(F.col("text"), 320).alias("snippet"))
    question, answer = evalset.template_question_answer(F.col("source"), F.col("snippet"), F.col("level"))
    picked = evalset.template_question(F.col("source"), F.col("level"), F.col("doc_id"))
    return rows.select("doc_id", picked.alias("question"), question.alias("realistic_question"), F.sha2(answer, 256).alias("answer_hash"))


def _case_sql(level, values, make):
    return f"case {level} when 'easy' then {make(values['easy'])} when 'medium' then {make(values['medium'])} else {make(values['hard'])} end"


def diversified_questions(spark, sf_dir):
    d = _placed(spark, sf_dir).select("doc_id", "source", tx.normalize_difficulty(F.lit(""), F.col("doc_id"), F.col("total")).alias("level"))
    rows = d.withColumn("question", F.concat(F.lit("如何使用"), "source", F.lit("？")))
    return evalset.diversified(rows, "question", "source", "level", "doc_id").select("doc_id", "question")


def shuffled_batches(spark, sf_dir):
    order = evalset.shuffled(read(spark, sf_dir, "benchmark").select("item_id"), "item_id", 42)
    out = evalset.cyclic_batches(order, 15, 8)
    return out.select("batch", F.col("place").cast("long").alias("place"), "item_id")


def events_daily_window(spark, sf_dir):
    # decimals add up exactly, in whatever order
    out = streams.daily(read(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,6)")))
    return out.select("day", "event_type", "n", F.col("total").cast("double").alias("total"), (F.col("total").cast("double") / F.col("n")).alias("mean"))


def user_sessions(spark, sf_dir):
    out = streams.sessions(read(spark, sf_dir, "events"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def exact_dedup_documents(spark, sf_dir):
    from ..operators.fusion import keep_first

    d = read(spark, sf_dir, "documents").select("doc_id", tx.stripped(F.coalesce("text", F.lit(""))).alias("t"))
    return keep_first(d.select("doc_id", F.sha2("t", 256).alias("content_hash")), ["content_hash"], ["doc_id"])


def merged_summary(spark, sf_dir):
    out = metrics.merged_summary(judge=judge_summary(spark, sf_dir), feedback=feedback_summary(spark, sf_dir), latency=latency_summary(spark, sf_dir))
    return out.select("judge.judge_score", "feedback.coverage", "latency.avg_total")


QUERIES = {
    f.__name__: f
    for f in (evalcase_validate, judge_parse, judge_summary, feedback_summary, feedback_daily, latency_items, latency_summary, reference_overlap, text_similarity, upload_antijoin, answers_join, grade_routing, route_router, route_decompose, history_tail, message_clean, loop_steps, difficulty_normalize, query_key_dedup, template_questions, diversified_questions, shuffled_batches, events_daily_window, user_sessions, exact_dedup_documents, merged_summary)
}

_LEVEL = "case when doc_id / (select count(*) from documents)::double < 0.4::double then 'easy' when doc_id / (select count(*) from documents)::double < 0.8::double then 'medium' else 'hard' end"
_quote = lambda t, mark, value: "'" + t.replace(mark, f"' || {value} || '") + "'"
_JUDGE_SUMMARY = "select round(avg(relevance), 6) relevance, round(avg(completeness), 6) completeness, round(avg(groundedness), 6) groundedness, round(avg((relevance + completeness + groundedness) / 3), 6) judge_score, count(*) cases from ju"

ORACLES = {
    "evalcase_validate": """with r as (select doc_id n, case when doc_id % 11 = 0 then '' else 'case_' || doc_id end case_id, case when doc_id % 13 = 0 then '' else 'question ' || doc_id end query,
case when doc_id % 17 = 0 then 'other' when toxic = 1 then 'feedback' else 'qa' end dataset_type, case when doc_id % 19 = 0 then 'unknown' when quality = 1 then 'easy' else 'hard' end difficulty,
case when doc_id % 4 = 1 then 4.5::double end user_rating from labels),
e as (select *, case when case_id = '' then 'case_id is required' when query = '' then 'query is required' when dataset_type not in ('qa', 'feedback') then 'dataset_type must be qa or feedback'
when difficulty not in ('easy', 'medium', 'hard') then 'difficulty must be easy, medium or hard' when dataset_type = 'feedback' and n % 3 <> 0 then 'feedback dataset requires bot_answer'
when dataset_type = 'feedback' and n % 4 = 0 then 'user_rating must be numeric when provided' else '' end error from r)
select case_id, query, dataset_type, difficulty, user_rating, error = '' valid, error from e""",
    "judge_parse": f"with {JUDGED} select *, round((relevance + completeness + groundedness) / 3, 6) judge_score from ju",
    "judge_summary": f"with {JUDGED} {_JUDGE_SUMMARY}",
    "feedback_summary": f"with {FEEDBACK} select {FEEDBACK_SUMMARY} from fb",
    "feedback_daily": f"with {FEEDBACK} select 'feedback_' || strftime(ts, '%Y-%m-%d') || '.json' file, {FEEDBACK_SUMMARY} from fb group by 1",
    "latency_items": f'with {LATENCY} select user_id, "day", round(ttft, 3) ttft, round(total, 3) total, round(chars_per_second, 6) chars_per_second from li',
    "latency_summary": f"with {LATENCY} select round(avg(ttft), 3) avg_ttft, round(avg(total), 3) avg_total, round(avg(chars_per_second), 3) avg_chars_per_second from li",
    "reference_overlap": f"with {PAIRS}, w as (select conv_id, turn, {WORDS.format('text')} a, {WORDS.format('reference')} r from (select conv_id, turn, text, reference from pr)) select conv_id, turn, case when len(r) > 0 then round(len(list_intersect(a, r)) / len(r)::double, 6) end overlap from w".replace("lower(text)", "text").replace("lower(reference)", "reference"),
    "upload_antijoin": "select item_id, text from benchmark where item_id % 3 <> 0",
    "answers_join": "select item_id, case when item_id % 2 = 0 then length(text) + 1 else 0 end n_chars from benchmark",
    "grade_routing": """with g as (select doc_id, (doc_id % 2)::int loop_step, doc_id % 5 <> 0 docs, quality = 1 good from labels)
select doc_id, loop_step, case when not docs and loop_step < 1 then 'rewrite' when not docs then 'web' when loop_step < 1 and good then 'generate' when loop_step < 1 then 'rewrite' else 'web' end as next,
case when not docs and loop_step < 1 then 'rewrite' when not docs then 'web' when good then 'generate' when loop_step < 1 then 'rewrite' else 'web' end next_lenient from g""",
    "route_router": "select conv_id, turn, case when role = 'system' then 'chat' else 'docs' end route from conversations",
    "route_decompose": "select conv_id, turn, case when turn % 3 = 0 then 'simple' else 'parallel' end route from conversations",
    "history_tail": "select conv_id, turn, role, sha256(coalesce(text, '')) text_hash from conversations where not contains(coalesce(text, ''), '<svg') qualify row_number() over (partition by conv_id order by turn desc) <= 8",
    "message_clean": "select conv_id, turn, sha256(text) text_hash from conversations",
    "loop_steps": "select conv_id, count(*) turns, sum(turn % 2)::bigint rewrites from conversations group by conv_id",
    "difficulty_normalize": f"""select doc_id, case doc_id % 4 when 0 then 'easy' when 1 then 'hard' else {_LEVEL} end difficulty,
case doc_id % 4 when 0 then 'easy' when 1 then 'hard' else case when doc_id / (select count(*) from documents)::double <= 0.5::double then 'easy' when doc_id / (select count(*) from documents)::double <= 0.8::double then 'medium' else 'hard' end end difficulty_inclusive from documents""",
    "query_key_dedup": "with k as (select doc_id, regexp_replace(lower(array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' ')), '[^0-9a-z一-鿿]+', '', 'g') as \"key\" from documents) select doc_id, \"key\", row_number() over (partition by \"key\" order by doc_id) > 1 is_repeat from k",
    "template_questions": f"""with l as (select doc_id, source, {_LEVEL} lv, left(regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^\\s+|\\s+$', '', 'g'), 320) s from documents)
select doc_id, {_case_sql("lv", evalset.TEMPLATES, lambda t: f"case when doc_id % 2 = 0 then {_quote(t[0], '{title}', 'source')} else {_quote(t[1], '{title}', 'source')} end")} question,
{_case_sql("lv", evalset.ANSWERED, lambda t: _quote(t[0], '{title}', 'source'))} realistic_question,
sha256(case when s = '' then {_case_sql("lv", evalset.ANSWERS, lambda t: _quote(t, '{title}', 'source'))} else {_case_sql("lv", evalset.ANSWERED, lambda t: f"left(s, {t[1]})")} end) answer_hash from l""",
    "diversified_questions": f"""with l as (select doc_id, source, {_LEVEL} lv, row_number() over (partition by regexp_replace(lower('如何使用' || source || '？'), '[^0-9a-z一-鿿]+', '', 'g') order by doc_id) n from documents)
select doc_id, case when n = 1 then '如何使用' || source || '？' else '如何使用' || source || '，针对“' || source || '”' || {_case_sql("lv", evalset.SUFFIXES, lambda t: f"case when doc_id % 2 = 0 then {_quote(t[0], '{n}', 'doc_id')} else {_quote(t[1], '{n}', 'doc_id')} end")} end question from l""",
    "shuffled_batches": """with o as (select item_id, row_number() over (order by sha1('42:' || item_id), item_id) - 1 pos, count(*) over () total from benchmark), s as (select unnest(range(0, 120)) slot)
select slot // 8 batch, slot % 8 place, item_id from s join o on slot % total = pos""",
    "events_daily_window": "select strftime(ts, '%Y-%m-%d') as \"day\", event_type, count(*) n, sum(value::decimal(18,6))::double total, sum(value::decimal(18,6))::double / count(*) mean from events group by 1, 2",
    "user_sessions": """with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end s from events),
c as (select user_id, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from g), n as (select user_id, k, count(*) n from c group by 1, 2)
select user_id, count(*) sessions, max(n) longest from n group by 1""",
    "exact_dedup_documents": "select min(doc_id) doc_id, sha256(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) content_hash from documents group by 2",
    "merged_summary": f"with {JUDGED}, {FEEDBACK}, {LATENCY} select (select round(avg((relevance + completeness + groundedness) / 3), 6) from ju) judge_score, (select round(count(user_rating) / count(*)::double, 6) from fb) coverage, (select round(avg(total), 3) from li) avg_total",
}
