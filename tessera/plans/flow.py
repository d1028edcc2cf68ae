"""The question flow as one plan: a batch of questions goes through all branches, each edge a condition.

Models are slots: functions from columns to a column, with fixed rules as defaults where none is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.context import context, graded_text

MAX_REWRITES = 1


def datasource_route(datasource: Column) -> Column:
    return F.when(datasource == "chat", "chat").otherwise("docs")


def complexity_route(sub_questions: Column) -> Column:
    """Parallel retrieval where the question was taken apart, even in no parts."""
    return F.when(sub_questions.isNotNull(), "parallel").otherwise("simple")


def grade_route(has_docs: Column, loop_step: Column, score: Column, strict: bool = True) -> Column:
    """The next node after grading. After a rewrite documents go to the web whatever their grade; with ``strict`` off, a
    good grade is generated from then too. An absent grade counts as no.
    """
    fresh = F.coalesce(loop_step, F.lit(0)) < MAX_REWRITES
    good = F.coalesce(score == "yes", F.lit(False))
    out = F.when(~has_docs & fresh, "rewrite").when(~has_docs, "web").when(fresh & good, "generate").when(fresh, "rewrite")
    return out.otherwise("web") if strict else out.when(good, "generate").otherwise("web")


#: Messages that are small talk.
GREETINGS = r"(?i)^\s*(hi|hello|hey|thanks?|thank you|bye|你好|您好|谢谢|再见)[\s!.,。！，]*$"
#: What a question says without asking.
STOP_PHRASES = ("请问", "我想知道", "能不能", "可以", "帮我", "please", "could you", "i want to know")


def default_router(message: Column) -> Column:
    greeting = F.coalesce(message, F.lit("")).rlike(GREETINGS) | (F.length(tx.stripped(F.coalesce(message, F.lit("")))) < 2)
    return F.when(greeting, "chat").otherwise("docs")


#: Words that stand for something said before, words with a capital, and those of them that name nothing. A word
#: ends where no ASCII letter, digit or underscore follows, on all versions of Java; a long s counts as an s.
REFERENCES = r"(?i)(?<![A-Za-z0-9_])(it|thi[sſ]|that|they|them)(?![A-Za-z0-9_])|它|这个|那个|该框架"
NAMES = r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_-]*[A-Za-z0-9]"
NO_NAMES = ("How", "What", "Why", "When", "Where", "Who", "Which", "The", "This", "That", "It", "They", "And", "But", "Can", "Could", "Do", "Does", "Is", "Are", "Hello", "Please")


def last_name(message: Column) -> Column:
    """The last name that a message says: a word that begins with a capital, other than those that begin questions; null if there is none."""
    words = F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(NAMES), F.lit(0))
    return F.try_element_at(F.filter(words, lambda w: ~w.isin(*NO_NAMES)), F.lit(-1))


def with_reference(message: Column, name: Column) -> Column:
    """A message with the first word that refers to something replaced by the name; unchanged without either."""
    said = F.coalesce(message, F.lit(""))
    around = F.split(said, REFERENCES, 2)
    return F.when((F.size(around) == 2) & name.isNotNull(), F.concat(F.get(around, 0), name, F.get(around, 1))).otherwise(said)


def standalone(turns: DataFrame, router: Callable[[Column], Column] = default_router, rewrite: Callable[[Column, Column], Column] = with_reference) -> DataFrame:
    """(conv_id, turn, question, datasource) of each user message of conversations (conv_id, turn, role, text): the question that
    can be read without what was said before, and where it goes.

    The name that a message's references stand for is the last one of the turns before it, the user's and the answers'.
    Where a model that rewrites or routes gives no answer (null), the message itself is asked, of the documents.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    named = turns.withColumn("name", F.last(last_name(F.col("text")), ignorenulls=True).over(before)).where("role = 'user'")
    question = rewrite(F.col("text"), F.col("name"))
    whole = question.isNotNull() & router(question).isNotNull()
    out = named.select("conv_id", "turn", F.when(whole, question).otherwise(F.coalesce("text", F.lit(""))).alias("question"), whole.alias("ok"))
    return out.select("conv_id", "turn", "question", F.when(F.col("ok"), datasource_route(router(F.col("question")))).otherwise("docs").alias("datasource"))


def default_decompose(question: Column) -> Column:
    """The parts of a question that asks several; null of one that asks one thing."""
    parts = F.filter(F.transform(F.split(F.coalesce(question, F.lit("")), "[?？;；]"), tx.stripped), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts)


def default_rewrite(question: Column) -> Column:
    out = question
    for phrase in STOP_PHRASES:
        out = F.regexp_replace(out, f"(?i){phrase}", "")
    return F.coalesce(tx.blank_to_null(tx.collapsed(out)), question)


def default_grade(question: Column, documents: Column) -> Column:
    """Yes if a third of the question's words stand in what was retrieved."""
    return F.when(F.coalesce(tx.reference_overlap(F.lower(documents), F.lower(question)), F.lit(0.0)) >= 1 / 3, "yes").otherwise("no")


def default_generate(question: Column, context: Column) -> Column:
    return F.concat(question, F.lit("\n\n"), F.coalesce(context, F.lit("")))


#: Documents that a simple question is answered from.
RETRIEVED = 5


def default_chat(message: Column) -> Column:
    return message


@dataclass
class Models:
    """The slots of a flow. ``retrieve`` takes questions (query_id, query) and gives (query_id, position, docid, page_content, source_url, image_map)."""

    retrieve: Callable[[DataFrame], DataFrame]
    web: Callable[[DataFrame], DataFrame] | None = None
    router: Callable[[Column], Column] = default_router
    decompose: Callable[[Column], Column] = default_decompose
    rewrite: Callable[[Column], Column] = default_rewrite
    grade: Callable[[Column, Column], Column] = default_grade
    generate: Callable[[Column, Column], Column] = default_generate
    chat: Callable[[Column], Column] = default_chat
    rerank: Callable[[Column, Column], Column] = field(default=lambda q, d: F.coalesce(tx.reference_overlap(F.lower(d), F.lower(q)), F.lit(0.0)))
    strict_grade: bool = True


def _texts(docs: DataFrame) -> DataFrame:
    return context(docs).select("query_id", "context", "image_registry")


def answer(questions: DataFrame, models: Models) -> DataFrame:
    """(query_id, query, datasource, path, loop_step, context, image_registry, answer) of a batch (query_id, query).

    What the grader reads is the first documents, cut; what the generator reads is the whole context. Retrieval keeps the
    first RETRIEVED documents of a question.

    The bounded loop, one rewrite at most, is unrolled; branches are filtered before a model sees them and joined by a union.
    """
    from ..operators import fusion

    base = questions.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    routed = base.withColumn("datasource", datasource_route(models.router(F.col("query")))).withColumn("sub_questions", models.decompose(F.col("query")))
    chat = routed.where("datasource = 'chat'").select("query_id", "query", F.lit("chat").alias("path"), F.lit(0).alias("loop_step"), F.lit("").alias("context"), F.create_map().cast("map<string,string>").alias("image_registry"))
    docs = routed.where("datasource = 'docs'").withColumn("path", complexity_route(F.col("sub_questions")))

    parts = docs.where("path = 'parallel'").select("query_id", F.col("query").alias("whole"), F.posexplode("sub_questions").alias("sub_index", "query"))
    keyed = parts.select(F.concat_ws("#", F.col("query_id").cast("string"), "sub_index").alias("query_id"), "query")
    found = models.retrieve(keyed).withColumnRenamed("query_id", "__k").join(parts.select(F.concat_ws("#", F.col("query_id").cast("string"), "sub_index").alias("__k"), "query_id", "sub_index", "whole"), "__k").drop("__k")
    merged = fusion.merge_queries(found.withColumnRenamed("position", "rank"), "page_content")
    ranked = fusion.rerank(merged, models.rerank(F.col("whole"), F.col("page_content"))).withColumn("position", F.col("rerank_rank"))
    parallel = docs.where("path = 'parallel'").select("query_id", "query", "path", F.lit(0).alias("loop_step")).join(_texts(ranked), "query_id", "left")

    def graded(q: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
        got = models.retrieve(q.select("query_id", "query")).where(F.col("position") <= RETRIEVED)
        seen = q.join(_texts(got), "query_id", "left").join(graded_text(got), "query_id", "left")
        score = models.grade(F.col("query"), F.coalesce("documents", F.lit("")))
        return seen.withColumn("next", grade_route(F.col("context").isNotNull(), F.lit(step), score, models.strict_grade)), got

    first, _ = graded(docs.where("path = 'simple'").select("query_id", "query"), 0)
    again = first.where("next = 'rewrite'").select("query_id", models.rewrite(F.col("query")).alias("query"))
    second, _ = graded(again, 1)
    done = [first.where("next = 'generate'").select("query_id", "query", F.lit("simple").alias("path"), F.lit(0).alias("loop_step"), "context", "image_registry"), second.where("next = 'generate'").select("query_id", "query", F.lit("simple").alias("path"), F.lit(1).alias("loop_step"), "context", "image_registry")]
    lost = second.where("next = 'web'").select("query_id", "query", F.lit("web").alias("path"), F.lit(1).alias("loop_step"))
    if models.web is not None:
        lost = lost.join(_texts(models.web(lost.select("query_id", "query"))), "query_id", "left")
    else:
        lost = lost.withColumn("context", F.lit(None).cast("string")).withColumn("image_registry", F.lit(None).cast("map<string,string>"))
    out = chat
    for branch in (parallel, *done, lost):
        out = out.unionByName(branch)
    said = F.when(F.col("path") == "chat", models.chat(F.col("query"))).otherwise(models.generate(F.col("query"), F.col("context")))
    return out.withColumn("answer", said)
