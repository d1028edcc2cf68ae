"""Divergence of sources: terms are counted in byte tries, the tries merged by ranges of their prefixes, and the merged
leaves walked in byte order, piece by piece, for the sums of all pairs of sources and the terms that mark a source.

A trie travels as its leaves in byte order, each with its counters by source; no trie, vocabulary or group of a language is
ever whole in one task.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: A term is kept if it stands in so many documents of its language; so many terms that mark a source are told.
LEAST_DOCUMENTS, TOP = 10, 10
SCALE = 1_000_000_000
#: Bytes of a branch; leaves of a task's tries and counters that aren't added up before they are sent on; rows of a batch.
RADIX, LEAVES, WAITING, SENT = 2, 250_000, 1_500_000, 20_000
#: Terms and counters of a piece of a merged trie; sources of a block, about; parts of a language's pieces in a join.
PIECE_TERMS, PIECE_COUNTERS, BLOCK, SALTS = 256, 2_048, 64, 32
#: Sums of block pairs that a task holds before it sends them on.
HELD = 500
#: Bytes that part terms become blanks (all of ASCII but letters), A-Z become lower case, others stay.
LETTERS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 if b < 128 else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split(b" ") if text else []


class Box(dict):
    """The terms under one node of a trie, with their leaves; a new term gets the trie's next leaf."""

    def __init__(self, numbers: Iterator[int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, term: bytes) -> int:
        self[term] = leaf = next(self.numbers)
        return leaf


class RadixTrie(dict):
    """A byte trie that branches on the first bytes of a term, RADIX at a time; the terms under such a node lie in a box,
    as in a burst trie, and are put in order when the trie is walked. Leaves are numbered as they come.
    """

    def __init__(self):
        super().__init__()
        self.numbers = count()

    def __missing__(self, prefix: bytes) -> Box:
        self[prefix] = box = Box(self.numbers)
        return box

    def __len__(self) -> int:
        return sum(map(len, self.values()))

    def leaves(self, terms: Iterable[bytes]) -> list[int]:
        """The leaf of each term; a new one where the trie hasn't got it."""
        return [self[t[:RADIX]][t] for t in terms]

    def walk(self) -> tuple[list[bytes], list[int]]:
        """All terms in byte order, which is the order of UTF-8 texts, and their leaves."""
        terms, leaves = [], []
        for prefix in sorted(self):
            box = self[prefix]
            own = sorted(box)
            terms += own
            leaves += map(box.__getitem__, own)
        return terms, leaves


class TermCounter:
    """The tries of a task: for each language a leaf for each term, with its documents and its occurrences by source."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.tries: dict[str, RadixTrie] = defaultdict(RadixTrie)
        self.sources: dict[str, int] = {}
        self.found = defaultdict(list)  # language: (leaves, counts, sources, documents)
        self.waiting = 0

    def add(self, lang: str, source: str, text: str | None) -> None:
        counts = Counter(terms_of(text))
        counts.pop(b"", None)
        if counts:
            n = len(counts)
            number = self.sources.setdefault(source, len(self.sources))
            leaves = np.array(self.tries[lang].leaves(counts), np.int64)
            self.found[lang].append((leaves, np.fromiter(counts.values(), np.int64, n), np.broadcast_to(number, n), np.broadcast_to(1, n)))
            self.waiting += n

    def compact(self) -> None:
        """Counters of one leaf and source are added up."""
        self.waiting = 0
        for lang, parts in self.found.items():
            leaf, counts, source, documents = (np.concatenate(c) for c in zip(*parts))
            key = leaf * len(self.sources) + source
            order = np.argsort(key)
            key = key[order]
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            order_cut = order[cut]
            self.found[lang] = [(leaf[order_cut], np.add.reduceat(counts[order], cut), source[order_cut], np.add.reduceat(documents[order], cut))]

    def full(self) -> bool:
        """Whether the tries are to be sent on; counters are added up when many wait."""
        if self.waiting > WAITING:
            self.compact()
        return sum(map(len, self.tries.values())) > LEAVES

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The leaves in byte order, and empty tries again."""
        self.compact()
        names = pa.array([*self.sources], pa.string())
        for lang, ((leaf, counts, source, documents),) in self.found.items():
            terms, order = self.tries[lang].walk()
            order = np.array(order, np.int64)
            own = np.bincount(leaf, minlength=len(order))
            first = np.cumsum(own) - own  # counters lie by leaf
            sizes, ends = own[order], np.cumsum(own[order])
            at = np.arange(len(leaf)) + np.repeat(first[order] - ends + sizes, sizes)
            offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
            met = pa.DictionaryArray.from_arrays(pa.array(source[at], pa.int32()), names).cast(pa.string())
            batch = pa.record_batch({
                "lang": pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(order), np.int32)), pa.array([lang], pa.string())).cast(pa.string()),
                "term": pa.array(terms, pa.binary()),
                "documents": pa.array(np.bincount(leaf, documents, len(order))[order].astype(np.int64)),
                "sources": pa.ListArray.from_arrays(offsets, met),
                "counts": pa.ListArray.from_arrays(offsets, pa.array(counts[at])),
            })
            for s in range(0, len(order), SENT):
                yield batch.slice(s, SENT)
        self.clear()


LEAF = "lang string, term binary, documents long, sources array<string>, counts array<long>"
PIECE = "lang string, terms array<binary>, sizes array<int>, sources array<string>, counts array<long>"


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = TermCounter()
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            counter.add(lang, source, text)
        if counter.full():
            yield from counter.batches()
    yield from counter.batches()


class Pieces:
    """Kept leaves of a merged trie, in order, cut in pieces of one language."""

    schema = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def __init__(self):
        self.lang, self.columns = None, ([], [], [], [])  # terms, sizes, sources, counts

    def closed(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.record_batch([[self.lang], *([c] for c in self.columns)], schema=self.schema)
        self.columns = ([], [], [], [])

    def add(self, lang: str, term: bytes, sources: list[str], counts: list[int]) -> Iterator[pa.RecordBatch]:
        if lang != self.lang or len(self.columns[0]) >= PIECE_TERMS or len(self.columns[2]) + len(sources) > PIECE_COUNTERS:
            yield from self.closed()
            self.lang = lang
        for to, some in zip(self.columns, ((term,), (len(sources),), sources, counts)):
            to.extend(some)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the merged tries, from leaves in order: leaves of one term are one leaf, and kept if enough documents hold it."""
    pieces, rest = Pieces(), None

    def leaves(b: pa.RecordBatch | pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups of rows of one term, which begin at ``cut``."""
        documents = np.add.reduceat(b.column("documents").to_numpy(), cut)
        ends = np.append(cut[1:], b.num_rows)
        kept = np.flatnonzero(documents >= LEAST_DOCUMENTS)
        if not len(kept):
            return
        one = b.combine_chunks().to_batches()[0]
        langs, terms = (one.column(c).take(pa.array(cut[kept])).to_pylist() for c in ("lang", "term"))
        sources, counts = (one.column(c) for c in ("sources", "counts"))
        offsets = sources.offsets.to_numpy() - sources.offsets[0].as_py()
        sources, counts = sources.flatten().to_pylist(), counts.flatten().to_pylist()
        for lang, term, s, e in zip(langs, terms, offsets[cut[kept]].tolist(), offsets[ends[kept]].tolist()):
            own = dict.fromkeys(sources[s:e], 0)
            for name, c in zip(sources[s:e], counts[s:e]):
                own[name] += c
            yield from pieces.add(lang, term, list(own), list(own.values()))

    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([*(rest or []), b]).combine_chunks()
        new = np.ones(rows.num_rows, bool)
        for c in ("lang", "term"):
            values = rows.column(c)
            new[1:] = pc.not_equal(values[1:], values[:-1]).to_numpy() | (new[1:] if c == "term" else False)
        cut = np.flatnonzero(new)
        last = int(cut[-1])
        if last:
            yield from leaves(rows.slice(0, last), cut[:-1])
        rest = rows.slice(last).to_batches()
    if rest:
        yield from leaves(pa.Table.from_batches(rest), np.zeros(1, np.int64))
    yield from pieces.closed()


def share(counts: np.ndarray, whole) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole), exact for wholes under 9 * 10 ** 15: a thousandth of SCALE's factor at a time."""
    rest, out = counts + 2, 0
    for _ in range(3):
        rest = rest * 1_000
        out, rest = out * 1_000 + rest // whole, rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


SCORED = "lang string, source string, part string, item string, value long"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's pieces for pairs of sources, and its best TOP terms of each source."""
    sums: dict[tuple, list] = {}
    best: dict[tuple, list] = defaultdict(list)

    def sent() -> Iterator[pa.RecordBatch]:
        rows = [(lang, s, "pair", t, int(v)) for (lang, _, _), (one, other, m) in sums.items() for s, line in zip(one, m) for t, v in zip(other, line) if s != t]
        rows += [(lang, t, "pair", s, int(v)) for (lang, a, b), (one, other, m) in sums.items() if a != b for s, line in zip(one, m) for t, v in zip(other, line)]
        rows += [(lang, s, "term", term.decode(), -v) for (lang, s), found in best.items() for v, term in heapq.nsmallest(TOP, found)]
        sums.clear()
        best.clear()
        names = ("lang", "source", "part", "item", "value")
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    for batch in batches:
        for row in batch.to_pylist():
            lang, terms, vocabulary = row["lang"], row["terms"], row["vocabulary"]
            key = (lang, row["block_a"], row["block_b"])
            one, other = ([s["source"] for s in row[c]] for c in ("a", "b"))
            total = sums.setdefault(key, [one, other, np.zeros((len(one), len(other)), np.int64)])[2]
            if not terms:
                continue
            term = np.repeat(np.arange(len(terms)), row["sizes"])
            counts = np.array(row["counts"], np.int64)

            def shares(side: str) -> tuple[np.ndarray, np.ndarray]:
                at = {s["source"]: k for k, s in enumerate(row[side])}
                place = np.fromiter((at.get(s, -1) for s in row["sources"]), np.int64, len(counts))
                met = place >= 0
                own = np.zeros((len(terms), len(at)), np.int64)
                own[term[met], place[met]] = counts[met]
                return own, share(own, np.array([s["n"] for s in row[side]], np.int64) + 2 * vocabulary)

            there, p = shares("a")
            q = p if key[1] == key[2] else shares("b")[1]
            for k in range(len(one)):
                total[k] += divergence(p[:, k : k + 1], q).sum(0)
            if key[1] == key[2]:
                whole = np.bincount(term, counts, len(terms)).astype(np.int64) if counts.sum() < 2**53 else np.array([sum(row["counts"][k] for k in np.flatnonzero(term == t)) for t in range(len(terms))])
                expected = share(whole, row["n"] + 2 * vocabulary)[:, None]
                value = divergence(p, expected)
                for t, k in zip(*np.nonzero((there > 0) & (p > expected))):
                    best[lang, one[k]].append((-int(value[t, k]), terms[t]))
                for s in one:
                    if len(best[lang, s]) > 20 * TOP:
                        best[lang, s] = heapq.nsmallest(TOP, best[lang, s])
        if len(sums) > HELD:
            yield from sent()
    yield from sent()


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank of documents (lang, source, text): how far each source of a language is from
    each other one (part ``pair``, all ranks), and the terms that mark it against its language (part ``term``, TOP ranks).

    Null text, lang and source count as ''. A language without a kept term has pairs of value 0. Sources are taken in
    blocks, so a language of very many of them is dealt as pairs of blocks.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    leaves = saved(rows.mapInArrow(_leaves, LEAF), "leaves")
    ordered = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    pieces = saved(ordered.mapInArrow(_merged, PIECE), "pieces")
    counted = pieces.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    groups = saved(rows.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").fillna(0, ["n"]), "groups")
    kept = pieces.groupBy("lang").agg(F.sum(F.size("terms")).alias("vocabulary"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    langs = saved(langs.join(kept, "lang", "left").fillna(0, ["vocabulary"]), "langs")
    dealt = groups.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    blocks = dealt.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("a"))  # about BLOCK sources
    other = blocks.select("lang", F.col("block").alias("block_b"), F.col("a").alias("b"))
    paired = blocks.withColumnRenamed("block", "block_a").join(other, "lang").where("block_a <= block_b").join(langs.drop("blocks"), "lang")
    paired = paired.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    none = langs.select("lang", *(F.array().cast(t).alias(c) for c, t in (("terms", "array<binary>"), ("sizes", "array<int>"), ("sources", "array<string>"), ("counts", "array<long>"))), F.lit(0).alias("salt"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(F.col("terms")[0]), F.lit(SALTS)).cast("int")).unionByName(none)
    scored = saved(salted.join(paired, ["lang", "salt"]).mapInArrow(_scored, SCORED), "scored")
    pairs = scored.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda part: part.withColumn("rank", F.row_number().over(w).cast("int"))
    return ranked(pairs).unionByName(ranked(scored.where("part = 'term'")).where(F.col("rank") <= TOP))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of all sources of ``documents``. Null and empty texts make their group occur and add no term; repeated
    rows count as documents of their own; equal values are ranked by the item's bytes; very long texts are counted whole;
    other columns, of whatever names, are not read; an empty table gives no rows.
    """
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = r"""with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
k as (select lang, term from w group by lang, term having count(distinct r) >= 10),
v as (select lang, count(*) v from k group by lang),
c as (select lang, source, term, count(*) c from w semi join k using (lang, term) group by lang, source, term),
g as (select distinct lang, source from d),
n as (select g.lang, g.source, coalesce(sum(c), 0)::hugeint n from g left join c using (lang, source) group by g.lang, g.source),
l as (select lang, sum(n)::hugeint n from n group by lang),
lt as (select lang, term, 1 + (1000000000::hugeint * (sum(c)::hugeint + 2)) // (any_value(l.n) + 2 * any_value(v)) q from c join l using (lang) join v using (lang) group by lang, term),
p as (select n.lang, n.source, k.term, coalesce(c.c, 0) c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (n.n + 2 * v) p
  from n join v using (lang) join k using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
s as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term where a.source <> b.source group by all),
o as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint "value" from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // (p + q))::bigint from p join lt using (lang, term) where c > 0 and p > q)
select lang, source, part, item, "value", (row_number() over (partition by lang, source, part order by "value" desc, item))::int rank from o qualify part = 'pair' or rank <= 10"""
