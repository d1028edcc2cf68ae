"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut in a ring of four segments. If two fingerprints differ in at most 3 bits, some segment starts
a chain whose first l segments differ in at most floor(3 l / 4) bits, for every l: 0, 1, 2 and 3. Fingerprints meet on the
first segment of a chain and one half of the second, and a pair must hold the budgets of its chain before its whole
distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, fresh, group_runs, saved, spanning, table, words_of

MAX_DISTANCE = 3
SHINGLE = 3
SEED = 42
SEGMENTS, WIDTH = 4, 16
#: Rows of a block: a bucket of more fingerprints is cut in blocks, and each pair of blocks is a group of its own.
BLOCK = 400


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text: 0 for null, empty or blank ones."""
    words = words_of(text)
    if not words:
        return 0
    raw = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(raw, SEED)]
    else:
        # words hold no space, so the joined text's spaces are the bounds
        gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1)).tolist()
        ends = np.concatenate((gaps, [len(raw)])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(raw[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed long of the same bits."""

    @F.pandas_udf("long")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return values(text)


def chain_keys(fp: Column) -> Column:
    """The bucket keys of a fingerprint: for each start of a chain, the first segment with either half of the second."""
    keys = []
    for i in range(SEGMENTS):
        first = F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit(0xFFFF))
        second = F.shiftrightunsigned(fp, (i + 1) % SEGMENTS * WIDTH).bitwiseAND(F.lit(0xFFFF))
        for half in (0, 1):
            part = F.shiftright(second, 8 * half).bitwiseAND(F.lit(0xFF))
            keys.append(F.lit((2 * i + half) << 24).cast("long") + F.shiftleft(first, 8) + part)
    return F.array(*keys)


def linked(a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
    """Which pairs of two uint64 columns hold the chain's budgets from segment ``start`` on, and so differ in 3 bits at most."""
    x = a[:, None] ^ b[None, :]
    ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.uint8)
    for step in range(SEGMENTS):
        total = total + np.bitwise_count((x >> np.uint64((start + step) % SEGMENTS * WIDTH)) & np.uint64(0xFFFF))
        ok &= total <= MAX_DISTANCE * (step + 1) // SEGMENTS
    return ok


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, bounds in group_runs(batches, "key"):
        key, pair, block = part["key"].to_numpy(), part["pair"].to_numpy(), part["block"].to_numpy()
        fps = part["fp"].to_numpy().view(np.uint64)
        out = [np.zeros((0, 2), np.uint64)]
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s < 2:
                continue
            fp, start = fps[s:e], int(key[s]) >> 25
            if e - s == 2:
                if linked(fp[:1], fp[1:], start)[0, 0]:
                    out.append(fp[None, :])
                continue
            adjacent = linked(fp, fp, start)
            np.fill_diagonal(adjacent, False)
            if pair[s] >> 31 != pair[s] & 0x7FFFFFFF:
                adjacent &= block[s:e, None] != block[None, s:e]  # pairs within a block meet in a group of their own
            out.append(fp[spanning(adjacent)])
        edges = np.concatenate(out).view(np.int64)
        yield pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})


def near_edges(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) just as the links of 3 bits or fewer do. Groups emit
    stars, not pairs, so a bucket's edges are fewer than its members.
    """
    keyed = distinct.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    return block_pairs(keyed, "key", "fp", BLOCK).mapInPandas(_edges, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component): each row with its fingerprint and the smallest id of its component.

    Null ids take part, and are never the smallest unless a component has no other.
    """
    rows = saved(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    components = connected_components(near_edges(distinct)).withColumnRenamed("id", "fp")
    named = distinct.join(components, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = saved(named.groupBy("component").agg(F.min("least").alias("least_id")), "least")  # not an aggregate: the join can split a component
    by_fp = named.select("fp", "component").join(least, "component").select("fp", F.col("least_id").alias("component"))
    return rows.join(by_fp, "fp")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document. Null, empty and blank texts have fingerprint zero, and are
    linked like any other; repeated rows give repeated results; an empty table gives no rows.
    """
    found = groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# --- near-copies by similarity of shingles ----------------------------------------------------------------------------

#: Five-word shingles, and the similarity (Jaccard) from which texts are near-copies.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
#: Bands of a text's smallest hashes and hashes of a band: a pair of similarity 0.8 shares a band but for 7 in 100,000.
BANDS, ROWS = 24, 5
MIX = np.random.default_rng(41).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct five-word shingles, sorted; a shorter text is one shingle."""
    words, digest = words_of(text), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + NEAR_SHINGLE]), SEED) for k in range(max(1, len(words) - NEAR_SHINGLE + 1))], dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The MinHash bands of a set of hashes, each as one signed long."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        h = (hashes[k : k + 1024, None] ^ (hashes[k : k + 1024, None] >> np.uint64(31))) * MIX
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        np.minimum(least, h.min(0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def feature_column(text: Column) -> Column:
    """The fingerprint of a text's set of shingles, and the bands that complete the search."""

    @F.pandas_udf("fp long, bands array<long>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(t) for t in texts]
            fps = np.array([majority(h) for h in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"fp": fps, "bands": pd.Series([bands(h) for h in sets], dtype=object)})

    return values(text)


def shingle_column(text: Column) -> Column:
    @F.pandas_udf("binary")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    return values(text)


def near_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that connect sorted sets just as all pairs of Jaccard ``similarity`` or more do. Each set is compared
    with all that no link has reached yet.
    """
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    todo = np.ones(len(sets), bool)
    out = []
    for first in order:
        if not todo[first]:
            continue
        todo[first] = False
        frontier = [first]
        while frontier:
            a = frontier.pop()
            b = np.flatnonzero(todo & (np.minimum(size, size[a]) >= similarity * np.maximum(size, size[a]) - 1e-9))
            for k in range(0, len(b), 256):
                own = b[k : k + 256]
                flat = np.concatenate([sets[x] for x in own])
                at = np.minimum(np.searchsorted(sets[a], flat), size[a] - 1)
                same = np.add.reduceat((sets[a][at] == flat).astype(np.int64), np.cumsum(size[own]) - size[own])
                near = own[same >= similarity * (size[own] + size[a] - same) - 1e-9]
                todo[near] = False
                out += [(a, x) for x in near]
                frontier += near.tolist()
    return out


def _near_edges(similarity: float):
    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, bounds in group_runs(batches, "key"):
            row = part["row"].to_numpy()
            out = [np.zeros((0, 2), np.int64)]
            for s, e in zip(bounds[:-1], bounds[1:]):
                own = np.unique(row[s:e], return_index=True)[1] + s
                links = near_links([np.frombuffer(part["shingles"].iloc[k], np.uint64) for k in own], similarity)
                if links:
                    out.append(row[own][np.array(links)])
            found = np.concatenate(out)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return edges


def near_candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between rows of ``classes`` (row, fp, bands) that may be near-copies: those whose fingerprints are linked
    within MAX_DISTANCE bits by pigeonring, and those that share a band, each as stars.

    At similarity 0.8 fingerprints of 64 bits differ in about 10, far beyond what any filter on segments can afford, so
    the fingerprints find the closest copies and the bands the others.
    """
    first = classes.groupBy("fp").agg(F.min("row").alias("row"))
    same = classes.select("fp", F.col("row").alias("b")).join(first.withColumnRenamed("row", "a"), "fp").where("a <> b").select("a", "b")
    linked = near_edges(first.select("fp")).select(F.col("a").alias("fp"), F.col("b").alias("other"))
    linked = linked.join(first.withColumnRenamed("row", "a"), "fp").join(first.select(F.col("fp").alias("other"), F.col("row").alias("b")), "other").select("a", "b")
    keyed = classes.select("row", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("row").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = keyed.join(hubs, "key").where("row <> hub").select(F.col("hub").alias("a"), F.col("row").alias("b"))
    return stars.union(same).union(linked)


def near_copies_removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """One row of each group of near-copies: the row of the smallest id (nulls last), and one of repeated rows.

    Equal texts are one class. The pairs of one component of candidates are verified by the Jaccard similarity of their
    sets of hashed five-word shingles, ``similarity`` or more. Null texts count as empty, and are copies of each other.
    Groups are the components of the verified links. All columns of ``docs`` stay, whatever their names; an empty table
    gives no rows.
    """
    number = fresh(docs, "number")
    numbered = saved(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")  # from here on a row keeps its number
    whole = F.coalesce(F.col(text), F.lit(""))
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(number).alias("row"))
    rows = numbered.select(F.col(number).alias("row"), rank.alias("rank"), F.md5(whole.cast("binary")).alias("digest"), feature_column(whole).alias("f"))
    rows = saved(rows.select("row", "rank", "digest", "f.fp", "f.bands"), "features")
    best = rows.groupBy("digest").agg(F.min("rank").alias("rank"))
    classes = rows.join(best.select(F.col("rank.row").alias("row")), "row", "left_semi")
    members = saved(connected_components(near_candidates(classes)).withColumnRenamed("id", "row").withColumnRenamed("component", "key"), "candidates")
    sets = numbered.select(F.col(number).alias("row"), whole.alias("text")).join(members.select("row"), "row").select("row", shingle_column(F.col("text")).alias("shingles"))
    dealt = block_pairs(members, "key", "row", BLOCK, sets)
    edges = dealt.mapInPandas(_near_edges(similarity), "a long, b long")
    found = connected_components(edges).withColumnRenamed("id", "row")
    named = classes.select("row", "rank").join(found, "row", "left").withColumn("component", F.coalesce("component", "row"))
    kept = named.groupBy("component").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(number))
    return numbered.join(kept, number, "left_semi").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, with its columns: the one of the smallest id, nulls last, and of
    rows that repeat it one. Near-copies are linked texts of similarity 0.8 or more over five-word shingles. Null and
    empty texts are one group; shorter texts are one shingle; an empty table gives no rows.
    """
    return near_copies_removed(docs)
