"""BM25 over blocks of postings: a question meets the blocks of its own terms, takes them best first, and stops where the
rest can't reach its k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .topk import top

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Postings of a block. Texts of a shard, at least and at most; between the two there are SHARDS of them. A task holds one
#: shard's postings of a pass's terms at once.
POSTINGS, FEW, MANY, SHARDS = 256, 2_000, 8_000, 64
#: Tokens or postings that a task counts or inverts at once; tokens of a bucket of a group of shards, whose postings a task
#: cuts in blocks at once.
HELD, BUCKETED = 400_000, 1_000_000
#: The columns of blocks, with the type of ids.
BLOCK = "bucket int, term string, block int, df int, slices array<struct<shard:int,first:int,size:int>>, ids array<{}>, tfs array<int>, dls array<int>"
#: Characters of the questions that one pass takes: their weights are held on the driver and sent to the tasks.
PASS_CHARS = 4_000_000
#: Scores are rounded to 6 digits: two that round alike differ by less.
MARGIN = 2e-6


def term_lists(docs: DataFrame, id_col: str, text: str, tokenizer=tokens) -> DataFrame:
    """(id, dl, terms, tfs): the number of a text's terms, its distinct terms in order, and how often each stands there.

    Tasks sort and count the terms of HELD tokens at once, so nothing is shuffled; a text without a term has empty lists. Rows
    of a null id are no documents. Other columns stay.
    """
    others = [c for c in docs.columns if c not in (id_col, text)]
    own = F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), own.alias("ts"), *others)
    made = rows.select("id", F.lit(0).alias("dl"), F.col("ts").alias("terms"), F.array().cast("array<int>").alias("tfs"), *others)
    return rows.mapInArrow(_counted, made.schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, terms, tfs, others) of (id, ts, others)."""
    for b in batches:
        total = np.append(0, np.cumsum(pc.list_value_length(b.column("ts")).to_numpy()))
        at = 0
        while at < b.num_rows:
            end = max(int(np.searchsorted(total, total[at] + HELD, "right")) - 1, at + 1)
            rows = b.slice(at, end - at)
            tokens = rows.column("ts").flatten().dictionary_encode()
            order = pc.sort_indices(tokens.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            sizes = np.diff(total[at : end + 1])
            key = np.sort(np.repeat(np.arange(end - at), sizes) * len(order) + rank[tokens.indices.to_numpy()])
            first = _changes(key)
            owner, word = np.divmod(key[first], max(len(order), 1))
            begins = np.searchsorted(owner, np.arange(end - at))
            terms = tokens.dictionary.take(order.take(pa.array(word)))
            tfs = pa.array(np.diff(np.append(first, len(key))).astype(np.int32))
            others = {c: rows.column(c) for c in b.schema.names if c not in ("id", "ts")}
            yield pa.RecordBatch.from_pydict({"id": rows.column("id"), "dl": pa.array(sizes.astype(np.int32)), "terms": _listed(terms, begins), "tfs": _listed(tfs, begins)} | others)
            at = end


def shard_count(n: int) -> int:
    return max(1, math.ceil(n / min(max(n / SHARDS, FEW), MANY)))


def bucket_count(length: int, shards: int) -> int:
    """Buckets of terms: 16 for a small index, and so many that a bucket has BUCKETED tokens in a group of shards."""
    return max(16, math.ceil(length / math.ceil(shards / SHARDS) / BUCKETED))


def buckets_of(terms: Iterable[str], buckets: int) -> np.ndarray:
    """The bucket of each term, the same in every process."""
    return (pd.util.hash_array(np.array(list(terms), object), categorize=False) % np.uint64(buckets)).astype(np.int64)


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    """The numbers of a column, or those in its lists, one after the other."""
    own = rows.column(column).combine_chunks()
    return (own.flatten() if pa.types.is_list(own.type) else own).to_numpy(zero_copy_only=False)


def _listed(values: pa.Array, begins: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)), pa.int32()), values)


def _changes(key: np.ndarray) -> np.ndarray:
    """The places where another key begins."""
    return np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)


def _runs(kind: pa.DataType, buckets: int) -> Callable:
    """A function from texts (id, dl, shard, terms, tfs) to runs: the postings of a bucket's terms in HELD postings or fewer of a
    task's texts, of one group of shards, by term and shard.
    """
    ints = pa.int32()
    schema = pa.schema([("bucket", ints), ("group", ints), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(ints)), ("shards", pa.list_(pa.int16())), ("ids", pa.list_(kind)), ("tfs", pa.list_(ints)), ("dls", pa.list_(ints))])

    def inverted(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        terms = rows.column("terms").combine_chunks().flatten().dictionary_encode()
        if not len(terms):
            return
        owner = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("terms")).to_numpy())
        shard, words = _numbers(rows, "shard")[owner].astype(np.int64), len(terms.dictionary)
        own = buckets_of(terms.dictionary.to_pylist(), buckets)
        groups = int(shard.max()) // SHARDS + 1
        word = terms.indices.to_numpy()
        key = ((own[word] * groups + shard // SHARDS) * words + word) * SHARDS + shard % SHARDS
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        begins = _changes(key // SHARDS)  # of a term in a group
        cell, word = np.divmod(key[begins] // SHARDS, words)
        first = _changes(cell)  # of a bucket in a group
        bucket, group = np.divmod(cell[first], groups)
        sizes = np.diff(np.append(begins, len(key)))
        values = [pa.array((key % SHARDS).astype(np.int16)), rows.column("id").combine_chunks().take(pa.array(owner)), pa.array(_numbers(rows, "tfs")[order], ints), pa.array(_numbers(rows, "dl")[owner], ints)]
        lists = [_listed(terms.dictionary.take(pa.array(word)), first), _listed(pa.array(sizes, ints), first), *(_listed(v, begins[first]) for v in values)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket, ints), pa.array(group, ints), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            total = np.append(0, np.cumsum(pc.list_value_length(b.column("terms")).to_numpy()))
            at = 0
            while at < b.num_rows:
                end = max(int(np.searchsorted(total, total[at] + HELD - held, "right")) - 1, at + 1)
                parts.append(b.slice(at, end - at))
                held += int(total[end] - total[at])
                at = end
                if at < b.num_rows or held >= HELD:
                    yield from inverted(parts)
                    parts, held = [], 0
        if parts:
            yield from inverted(parts)

    return run


def _blocks(kind: pa.DataType) -> Callable:
    """A function from runs in order (bucket, group) to blocks; the runs of a bucket in a group are gathered and cut at once."""
    ints = pa.int32()
    slices = pa.struct([("shard", ints), ("first", ints), ("size", ints)])
    schema = pa.schema([("bucket", ints), ("term", pa.string()), ("block", ints), ("df", ints), ("slices", pa.list_(slices)), ("ids", pa.list_(kind)), ("tfs", pa.list_(ints)), ("dls", pa.list_(ints))])

    def cut(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        terms = rows.column("terms").combine_chunks().flatten().dictionary_encode()
        by_name = pc.sort_indices(terms.dictionary)
        rank = np.empty(len(by_name), np.int64)
        rank[by_name.to_numpy()] = np.arange(len(by_name))
        key = np.repeat(rank[terms.indices.to_numpy()], _numbers(rows, "sizes")) * SHARDS + _numbers(rows, "shards")
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = _changes(key // SHARDS)
        count = np.diff(np.append(first, len(key)))
        place = np.arange(len(key)) - np.repeat(first, count)
        begins = np.flatnonzero(place % POSTINGS == 0)
        own = key[begins] // SHARDS
        pieces = np.union1d(_changes(key), begins)
        block = np.searchsorted(begins, pieces, "right") - 1
        shard = rows.column("group")[0].as_py() * SHARDS + key[pieces] % SHARDS
        made = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (shard, pieces - begins[block], np.diff(np.append(pieces, len(key))))], fields=list(slices))
        ids = rows.column("ids").combine_chunks().flatten().take(pa.array(order))
        lists = [ids, *(pa.array(_numbers(rows, c)[order], ints) for c in ("tfs", "dls"))]
        names = [pa.array(np.full(len(begins), rows.column("bucket")[0].as_py()), ints), terms.dictionary.take(by_name.take(pa.array(own)))]
        numbers = [pa.array((place[begins] // POSTINGS).astype(np.int32)), pa.array(count[own].astype(np.int32), ints, mask=place[begins] > 0)]
        return pa.RecordBatch.from_arrays([*names, *numbers, _listed(made, np.searchsorted(pieces, begins)), *(_listed(v, begins) for v in lists)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts = None, []
        for b in batches:
            own = np.stack([b.column(c).to_numpy() for c in ("bucket", "group")], axis=1)
            starts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(axis=1))) if b.num_rows else []
            for s, e in zip(starts, np.append(starts[1:], b.num_rows)):
                if parts and tuple(own[s]) != cell:
                    yield cut(parts)
                    parts = []
                cell = tuple(own[s])
                parts.append(b.slice(s, e - s))
        if parts:
            yield cut(parts)

    return run


def runs(lists: DataFrame, shards: int, buckets: int = 16) -> DataFrame:
    """(bucket, group, terms, sizes, shards, ids, tfs, dls) of term lists: a row for a bucket's terms in each HELD postings, neither
    for each term nor for each posting; ``sizes`` are the terms' postings. ``shards`` are numbers within a group of SHARDS shards.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = lists.schema["id"].dataType
    rows = lists.select("id", "dl", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "terms", "tfs")
    return rows.mapInArrow(_runs(to_arrow_type(kind), buckets), f"bucket int, group int, terms array<string>, sizes array<int>, shards array<smallint>, ids array<{kind.simpleString()}>, tfs array<int>, dls array<int>")


def blocks(lists: DataFrame, shards: int, buckets: int) -> DataFrame:
    """The columns BLOCK: the postings of each term in each group of SHARDS shards of texts, by shard, in blocks of POSTINGS, in
    the order of terms within a bucket and group. ``slices`` tells a block's shards and where their postings stand in it.
    ``df`` is of the group and stands in its first block.

    Each task inverts its texts first, so rows of buckets are shuffled and sorted, not rows of terms or postings.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = lists.schema["id"].dataType
    ordered = runs(lists, shards, buckets).repartition("bucket", "group").sortWithinPartitions("bucket", "group")
    return ordered.mapInArrow(_blocks(to_arrow_type(kind)), BLOCK.format(kind.simpleString()))


def with_idf(df: DataFrame, n: int, epsilon: float = EPSILON) -> DataFrame:
    """(term, df, idf) of (term, df) among ``n`` texts. A negative idf is lifted to ``epsilon`` of the mean idf of all terms."""
    raw = df.withColumn("raw", F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row


class Shard:
    """The postings of some terms in one shard of texts, ordered by impact within a term."""

    def __init__(self, words: pa.Array, rows: pa.Table, avgdl: float, k1: float, b: float):
        rows = rows.combine_chunks()
        gone = rows.filter(pc.is_null(rows["term"]))
        rows = rows.filter(pc.is_valid(rows["term"]))
        flat = lambda t, c: pc.list_flatten(t[c]).to_numpy(zero_copy_only=False)
        ids, tf, dl = flat(rows, "ids"), flat(rows, "tfs").astype(np.float64), flat(rows, "dls")
        word = np.repeat(pc.index_in(rows["term"], words).to_numpy(zero_copy_only=False), pc.list_value_length(rows["ids"]).to_numpy(zero_copy_only=False))
        if gone.num_rows:
            there = ~np.isin(ids, flat(gone, "ids"))
            ids, tf, dl, word = ids[there], tf[there], dl[there], word[there]
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(avgdl, 1e-9)))
        self.ids, number = np.unique(ids, return_inverse=True)  # numbers follow the order of ids
        order = np.lexsort((-part, word))
        self.number, self.part = number[order], part[order]
        self.first = np.searchsorted(word[order], np.arange(len(words) + 1))
        self.sum, self.scratch = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        self.met = np.zeros(len(self.ids), bool)
        self.by_number: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.read = 0  # postings that were scored

    def _sorted(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        """A term's texts in order of their numbers, and their impacts."""
        if word not in self.by_number:
            own = slice(self.first[word], self.first[word + 1])
            order = np.argsort(self.number[own])
            self.by_number[word] = self.number[own][order], self.part[own][order]
        return self.by_number[word]

    def _add(self, start: int, end: int, weight: float) -> np.ndarray:
        some = self.number[start:end]
        self.sum[some] += weight * self.part[start:end]
        self.met[some] = True
        self.read += end - start
        return some

    def search(self, words: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` ids and their scores.

        Terms are taken by the most that they can add. A text whose first term this is can't score more than its posting
        and all later terms at their best, so a term's postings are read, best first, while that reaches the k-th score so
        far, and no more terms are read when all together can't. What is left of the read texts is then looked up.
        """
        start, end = self.first[words], self.first[words + 1]
        there = end > start
        words, weights, start, end = words[there], weights[there], start[there], end[there]
        if not len(words):
            return self.ids[:0], np.zeros(0)
        touched, left = [], []
        if (weights <= 0).any():  # no bound holds
            touched = [self._add(s, e, w) for s, e, w in zip(start, end, weights)]
        else:
            most = weights * self.part[start]
            order = np.argsort(-most, kind="stable")
            after = np.append(np.cumsum(most[order][::-1])[::-1], 0)
            least = -np.inf
            for i, t in enumerate(order):
                w, s, e = weights[t], start[t], end[t]
                if after[i] < least - MARGIN:
                    left += [(words[x], weights[x], most[x], None) for x in order[i:]]
                    break
                cut = e
                if after[i + 1] + w * self.part[e - 1] < least - MARGIN:
                    cut = s + np.searchsorted(-self.part[s:e], -(least - MARGIN - after[i + 1]) / w, side="right")
                some = self._add(s, cut, w)
                touched.append(some)
                if cut < e:
                    left.append((words[t], w, w * self.part[cut], some))
                if len(some) >= k:
                    least = max(least, np.partition(self.sum[some], len(some) - k)[len(some) - k])
        found = np.flatnonzero(self.met) if sum(map(len, touched)) > len(self.met) // 8 else np.unique(np.concatenate(touched))
        kept = found
        if left:
            kept = found[self.sum[found] + sum(x[2] for x in left) >= least - MARGIN]
            for word, w, _, done in left:
                texts, part = self._sorted(word)
                at = np.minimum(np.searchsorted(texts, kept), len(texts) - 1)
                hit = texts[at] == kept
                if done is not None:  # the part of this term that was read is in the sums
                    self.scratch[done] = 1
                    hit &= self.scratch[kept] == 0
                    self.scratch[done] = 0
                self.sum[kept[hit]] += w * part[at[hit]]
                self.read += int(hit.sum())
        score = np.round(self.sum[kept], 6)
        self.sum[found], self.met[found] = 0, False
        if len(kept) > k:
            good = score >= np.partition(score, len(score) - k)[len(score) - k]
            kept, score = kept[good], score[good]
        best = np.lexsort((kept, -score))[:k]
        return self.ids[kept[best]], score[best]


def _shard_search(asked: list, words: list[str], avgdl: float, k: int, k1: float, b: float, query_type: pa.DataType, id_type: pa.DataType) -> Callable:
    """A function from the blocks of a shard to (query_id, id, score) of the best ``k`` texts of each question."""
    place = {w: i for i, w in enumerate(words)}
    questions = [q for q, _ in asked]
    own = [(np.array([place[x["term"]] for x in ws], np.int64), np.array([x["w"] for x in ws])) for _, ws in asked]
    schema = pa.schema([("query_id", query_type), ("id", id_type), ("score", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(pa.array(words, pa.string()), rows, avgdl, k1, b)
        found = [shard.search(w, x, k) for w, x in own]
        owner = np.repeat(np.arange(len(found)), [len(i) for i, _ in found])
        ids = np.concatenate([i for i, _ in found]) if found else np.zeros(0)
        return pa.table([pa.array([questions[o] for o in owner], query_type), pa.array(ids, id_type), np.concatenate([s for _, s in found] or [np.zeros(0)])], schema=schema)

    return run


def bm25_topk(queries: DataFrame, query_id: str, query: str, postings: Callable[[list[str]], DataFrame], terms: DataFrame, avgdl: float, id_type, k: int = 5, k1: float = K1, b: float = B, tokenizer=tokens, keep: Callable | None = None) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` texts of each question, by score rounded to 6 digits, then id.

    ``postings(terms)`` gives the blocks (unit, term, ids, tfs, dls) of these terms, a unit for each shard; a
    row without a term holds ids that don't count any more. ``terms`` is (term, idf). A repeated term of a question
    counts each time. Texts that share no term with a question don't appear. Questions are taken in passes of PASS_CHARS
    characters; ``keep`` writes a pass's result down where there are several.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = queries.sparkSession, queries.schema[query_id].dataType
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query).alias("text"))
    passes = math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / PASS_CHARS)
    found = []
    for p in range(passes):
        some = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        counted = some.select("query_id", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        # the terms of one pass have a proven bound
        weighed = terms.join(F.broadcast(counted), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
        rows = weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("ws")).collect()
        words = list({x["term"]: None for r in rows for x in r["ws"]})
        if not words:
            continue
        run = _shard_search([(r["query_id"], r["ws"]) for r in rows], words, avgdl, k, k1, b, to_arrow_type(kind), to_arrow_type(id_type))
        part = postings(words).groupBy("unit").applyInArrow(run, f"query_id {kind.simpleString()}, id {id_type.simpleString()}, score double")
        found.append(keep(part) if keep and passes > 1 else part)
    if not found:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, id {id_type.simpleString()}, score double, rank int")
    return top(reduce(DataFrame.unionByName, found), "query_id", [F.desc("score"), F.asc("id")], k)


def full_scores(lists: pd.DataFrame, questions: dict, k: int, n: int, avgdl: float, idf: dict[str, float], k1: float = K1, b: float = B) -> list[tuple]:
    """(query_id, id, score, rank) by scoring every text for every question, on small tables: what the index must equal."""
    out = []
    for q, ws in questions.items():
        rows = []
        for d in lists.itertuples():
            own = dict(zip(d.terms, d.tfs))
            parts = [idf[w] * own[w] * (k1 + 1) / (own[w] + k1 * (1 - b + b * d.dl / avgdl)) for w in ws if w in own]
            if parts:
                rows.append((-round(sum(parts), 6), d.id))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return out
