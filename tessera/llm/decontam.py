"""Benchmark decontamination: rare gapped seeds join documents to test items, and Smith-Waterman alignment scores them.

Seeds lose nothing. An alignment of m matches and e edits that scores MIN_SCORE of an item of n words has
2m - e >= 2n * MIN_SCORE. Two matches in a row with two or more edits between them cost 2 of the e, so at least
n * MIN_SCORE - 1 matches are followed by the next with one edit at most between them: the pair stands one or two words
apart in the item, and one or two in the text. Of those places of an item half are dropped, the ones whose pairs are the
most frequent in all documents; the other half must still be met, within the length that such an alignment can have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, table

WORD = re.compile(r"\w+")
#: Items of under 2 * NGRAM words leak only with an unbroken run of NGRAM words, or all their words: less is no evidence.
NGRAM = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: An item leaks into a document if its best alignment scores this share of a whole, unchanged copy.
MIN_SCORE = 0.5
#: Characters of benchmark text handled at once; a larger benchmark is taken in blocks of about this size, a pass for each.
BLOCK_CHARS = 4_000_000
#: Characters of documents whose words are looked up at once.
TEXT_CHARS = 1_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Numbers(dict):
    """Words of a block's items by number from 1; other words are 0."""

    def __missing__(self, word: str) -> int:
        return 0


class SeedIndex:
    """The items of one block as word numbers. A place is an item's word but for its last; its seeds are the pairs of that
    word with the next and the next but one. Short items (see NGRAM) have runs instead.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.numbers = Numbers()
        self.ids, self.items = [], []
        for item_id, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text or "")]
            if words:
                self.ids.append(item_id)
                self.items.append(np.array(words, np.int64))
        self.base = len(self.numbers) + 1
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        #: places that every leak of a long item meets
        self.met = np.ceil(self.sizes * MIN_SCORE - 1).astype(np.int64)
        self.long = np.flatnonzero(self.sizes >= 2 * NGRAM)
        self.first = np.concatenate(([0], np.cumsum(self.sizes[self.long] - 1)))
        keys, places = [], []
        for at, k in zip(self.first, self.long):
            x = self.items[k]
            for d in (1, 2):
                keys.append(x[:-d] * self.base + x[d:])
                places.append(at + np.arange(len(x) - d))
        self.keys, self.seed = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.place = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.runs: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k in np.flatnonzero(self.sizes < 2 * NGRAM):
            x, n = self.items[k], min(NGRAM, int(self.sizes[k]))
            for at in range(len(x) - n + 1):
                self.runs.setdefault(n, {}).setdefault(x[at : at + n].tobytes(), []).append((int(k), at))

    def numbered(self, text: str) -> np.ndarray:
        """A text's words as numbers, 0 for words of no item."""
        words = words_of(text)
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbered texts one after the other, with two words of no item after each, and where each begins (and the last ends)."""
        parts = [np.append(self.numbered(t), (0, 0)) for t in texts]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def pairs(self, words: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs of ``keys`` (sorted) in numbered words, and their places in ``keys``, by distance."""
        starts = np.zeros(self.base, bool)
        starts[keys // self.base] = True
        for d in (1, 2):
            at = np.flatnonzero(starts[words[:-d]] & (words[d:] > 0))
            key = words[at] * self.base + words[at + d]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[k] == key
            yield at[same], k[same]

    def rare(self, frequency: np.ndarray) -> np.ndarray:
        """Which places count, from the frequency of each seed in all documents: an item's most frequent ``met // 2`` are dropped."""
        of_place = np.bincount(self.place, frequency[self.seed], self.first[-1])
        keep = np.ones(self.first[-1], bool)
        for at, k in zip(self.first, self.long):
            drop = self.met[k] // 2
            keep[at + np.argsort(-of_place[at : at + self.sizes[k] - 1], kind="stable")[:drop]] = False
        return keep


class RareSeeds:
    """An index with the seeds of the places that count: pairs, and the items that each one names."""

    def __init__(self, index: SeedIndex, keep: np.ndarray):
        self.index = index
        kept = keep[index.place]
        item = index.long[np.searchsorted(index.first, index.place[kept], "right") - 1] if kept.any() else np.zeros(0, np.int64)
        named = np.unique(np.stack([index.seed[kept], item], axis=1), axis=0)
        seeds, begin = np.unique(named[:, 0], return_index=True)
        self.keys, self.item = index.keys[seeds], named[:, 1]
        self.begin = np.append(begin, len(named))
        self.need = index.met - index.met // 2

    def windows(self, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], list[list[int]]]:
        """Spans of words that may hold an item, by (text, item), in order: those with enough places near each other."""
        out: dict[tuple[int, int], list[list[int]]] = {}
        self._runs(words, bounds, out)
        if not len(self.keys):
            return out
        size, codes = len(words), []
        for at, k in self.index.pairs(words, self.keys):
            n = self.begin[k + 1] - self.begin[k]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            codes.append(self.item[np.repeat(self.begin[k], n) + inner] * size + np.repeat(at, n))
        code = np.unique(np.concatenate(codes))
        item, at = code // size, code % size
        last = np.arange(len(code)) + self.need[item] - 1
        inside = np.flatnonzero(last < len(code))
        ends = last[inside]
        text = np.searchsorted(bounds, at, "right") - 1
        near = (item[ends] == item[inside]) & (text[ends] == text[inside]) & (at[ends] - at[inside] < 2 * self.index.sizes[item[inside]])
        for j in inside[near]:
            self._add(out, bounds, int(text[j]), int(item[j]), int(at[j]))
        return out

    def _add(self, out: dict, bounds: np.ndarray, text: int, item: int, at: int) -> None:
        reach = 2 * len(self.index.items[item])
        start, end = max(int(bounds[text]), at - reach), min(int(bounds[text + 1]) - 2, at + reach)
        own = out.setdefault((text, item), [])
        if own and start <= own[-1][1]:
            own[-1][1] = max(own[-1][1], end)
        else:
            own.append([start, end])

    def _runs(self, words: np.ndarray, bounds: np.ndarray, out: dict) -> None:
        """Windows of short items. Each begins with a known word, so runs of known words alone are looked up."""
        for n, runs in self.index.runs.items():
            starts = np.zeros(self.index.base, bool)
            starts[[np.frombuffer(r, np.int64)[0] for r in runs]] = True
            run = starts[words[: len(words) - n + 1]]
            for k in range(1, n):
                run &= words[k : len(words) - n + 1 + k] > 0
            for at in np.flatnonzero(run):
                for item, _ in runs.get(words[at : at + n].tobytes(), ()):
                    self._add(out, bounds, int(np.searchsorted(bounds, at, "right")) - 1, item, int(at))

    def matches(self, texts: list[str]) -> list[list[tuple[int, float, int, int]]]:
        """For each text (item_id, score, first word, end word) of the items that leak into it, best place of each. Windows
        with too few of the item's words for MIN_SCORE, whatever their order, aren't aligned.
        """
        found = [[] for _ in texts]
        words, bounds = self.index.joined(texts)
        for (text, k), own in self.windows(words, bounds).items():
            item, best = self.index.items[k], (0, 0, 0)
            for start, end in own:
                if np.isin(item, words[start:end]).sum() < MIN_SCORE * len(item):
                    continue
                score, first, last = align(item, words[start:end])
                if score > best[0]:
                    best = (score, start + first - int(bounds[text]), start + last - int(bounds[text]))
            share = best[0] / (MATCH * len(item))
            if share >= MIN_SCORE:
                found[text].append((self.index.ids[k], share, best[1], best[2]))
        return [sorted(f, key=lambda m: (m[0] is None, m)) for f in found]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best score, and the places in ``text`` where that alignment begins and ends."""
    width = len(text)
    columns = np.arange(width + 1)
    score, begin = np.zeros(width + 1, np.int64), columns.copy()
    best, best_begin, best_end = 0, 0, 0
    for w in item:
        diagonal = score[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = score[1:] + GAP
        inner = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(diagonal >= up, begin[:-1], begin[1:])
        origin = np.where(inner > 0, origin, columns[1:])
        # gaps within the row: the running maximum of score - GAP * column
        lifted = np.concatenate(([0], inner)) - GAP * columns
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, columns, 0))
        score = np.maximum(top + GAP * columns, 0)
        origins = np.concatenate(([0], origin))
        begin = np.where(score > 0, origins[source], columns)
        end = int(score.argmax())
        if score[end] > best:
            best, best_begin, best_end = int(score[end]), int(begin[end]), end
    return best, best_begin, best_end


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[SeedIndex]:
    """Indexes of the benchmark's items, a block of bounded size at a time."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = int(chars // BLOCK_CHARS) + 1
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()  # about BLOCK_CHARS characters
        yield SeedIndex(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r)))


def portions(texts: pd.Series) -> Iterator[list[str]]:
    """A batch's texts, null as empty, in lists of about TEXT_CHARS characters."""
    out, held = [], 0
    for t in texts:
        out.append(t or "")
        held += len(out[-1])
        if held >= TEXT_CHARS:
            yield out
            out, held = [], 0
    if out:
        yield out


def frequencies(docs: DataFrame, index: SeedIndex, text: str = "text") -> np.ndarray:
    """How often each seed of a block stands in all documents. A task adds up its rows; one number a seed comes back."""
    total = np.zeros(len(index.keys), np.int64)
    if not len(total):
        return total

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(index.keys), np.int64)
        for b in batches:
            for part in portions(b["text"]):
                for _, k in index.pairs(index.joined(part)[0], index.keys):
                    n += np.bincount(k, minlength=len(n))
        met = np.flatnonzero(n)
        yield pd.DataFrame({"seed": met, "n": n[met]})

    counted = docs.select(F.col(text).alias("text")).where("text is not null").mapInPandas(count, "seed long, n long")
    for r in counted.groupBy("seed").agg(F.sum("n").alias("n")).toLocalIterator():  # at most the block's seeds
        total[r["seed"]] = r["n"]
    return total


def passes(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> Iterator[Column]:
    """For each block of the benchmark a column array<struct<item_id, score, first_word, end_word>> of the items that leak
    into each whole text. Ids keep their type; an item of a null id is an item like any other.
    """
    kind = benchmark.schema[item_id].dataType.simpleString()
    for index in blocks(benchmark, item_id, item_text):
        yield _leaks_of(RareSeeds(index, index.rare(frequencies(docs, index, text))), kind)(F.col(text))


def _leaks_of(seeds: RareSeeds, kind: str):
    @F.pandas_udf(f"array<struct<item_id:{kind},score:double,first_word:int,end_word:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "score", "first_word", "end_word")
        for texts in batches:
            yield pd.Series([[dict(zip(names, m)) for m in own] for part in portions(texts) for own in seeds.matches(part)], dtype=object)

    return found


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", found: str = "leak") -> DataFrame:
    """A row of ``docs`` with a struct ``found`` for each item that leaks into it. A benchmark of several blocks takes a
    pass for each, written down before the next, so no plan holds more than one block.
    """
    whole = part = None
    for c in passes(docs, benchmark, text, item_id, item_text):
        if part is not None:
            part = saved(part, "leaks")
            whole = part if whole is None else whole.unionByName(part)
        part = docs.select("*", F.explode(c).alias(found))
    return part if whole is None else whole.unionByName(part)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, first_word and end_word of every benchmark item that leaks into a document, at its best
    place. Null and empty texts and items match nothing; items of a null id are matched and keep it; repeated documents
    give repeated results, repeated items one; among equally good places the first counts; texts of any length are read
    whole; other columns are not read; with an empty benchmark or no documents there are no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leak.item_id", "leak.score", "leak.first_word", "leak.end_word")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks, with their columns; the rest go. Null and empty texts stay; repeated
    rows stay or go together, so there are no ties; an empty benchmark takes nothing, and an empty table gives no rows.
    """
    columns, found, clean = docs.columns, fresh(docs, "leaks"), None
    for c in passes(docs, table(spark, sf_dir, "benchmark"), "text", "item_id", "text"):
        docs = docs if clean is None else saved(clean, "clean")  # one block a plan
        clean = docs.withColumn(found, c).where(F.size(found) == 0).select(columns)
    return clean
