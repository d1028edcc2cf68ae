"""Shared pieces of the training-data operators: table readers, hash splits, bounded labelled samples, checkpoints,
bounded worker caches and distributed connected components.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: whole texts can be long, so batches are kept far below Spark's default of 10,000.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table through Spark, with small Arrow batches for the Python stages that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2 and so on that is no column of ``df``, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in chain([name], (f"{name}_{k}" for k in count(1))) if n.lower() not in taken)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, in UTF-8: bytes are parted and lowered by just these rules."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


@lru_cache(4)
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="tessera-ckpt-")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset, a folder of this machine serves a session
    whose tasks all run in this process (tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and context._jsc.sc().getCheckpointDir().isDefined():
        at = context._jsc.sc().getCheckpointDir().get()
    if not at and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return at or _local_root(context.applicationId)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as parquet in the shared folder and read it back; also the folder's path, for ``removed``."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder: lineage ends there, and any executor can be lost. Kept until the folder is cleared."""
    return written(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class BoundedCache(dict):
    """A worker-side memo of ``fn`` that is emptied when it holds ``limit`` entries, so memory stays bounded."""

    def __init__(self, fn: Callable, limit: int = 150_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.fn(key)
        return value


class RecentCache(dict):
    """A worker-side memo of ``fn`` in two generations of ``limit`` entries: what was asked for lately outlives the rest."""

    def __init__(self, fn: Callable, limit: int = 150_000):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = value = self.fn(key) if found is None else found
        return value


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Texts with their label, from rows whose crc32 remainder isn't ``held``: about ``per_class`` rows of each class.

    The sample is a documented bound for fitting a classifier. A row is taken by a hash of its id, so the choice is the
    same on every run. Repeated labels of a document are merged by their maximum; null labels and ids are ignored. Of
    repeated ids the first text by code points counts, so the bound holds however often an id is repeated.
    Returns (doc_id, text, label as ``y``) and the weight of each class that undoes the stratification.
    """
    l = labels.select(F.col("doc_id"), F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    l = l.groupBy("doc_id").agg(F.max("y").cast("int").alias("y")).where(crc_remainder("doc_id", modulus) != held)
    counts = {r["y"]: r["n"] for r in l.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, per_class / n) for y, n in counts.items()}
    slot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000))
    bound = F.lit(False)
    for y, s in share.items():
        bound = bound | ((F.col("y") == y) & (slot < int(s * 1_000_000)))
    chosen = l.where(bound)
    # about 2 * per_class ids at most: a proven bound, so they may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return sample, {y: 1.0 / s for y, s in share.items()}


#: Vertices of more neighbours than HUB are met by a broadcast of their smallest neighbours, for the HUBS greatest of them.
HUB, HUBS = 500, 2_000


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to u's smallest neighbour (u itself, if it is smaller).

    The join on u would bring a hub's rows into one task. The hubs of most neighbours are met where their rows are; with
    HUBS of them gone, no other vertex has more than one in HUBS of the rows.
    """
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    per = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    top = per.where(F.col("n") > HUB).orderBy(F.desc("n"), "u").limit(HUBS).select("u", "m").collect()  # HUBS rows
    linked = lambda rows: rows.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    if not top:
        return linked(both.join(per.drop("n"), "u")).distinct()
    hubs = F.broadcast(e.sparkSession.createDataFrame(top, "u long, m long"))
    rest = both.join(hubs, "u", "left_anti")
    low = rest.groupBy("u").agg(F.min("v").alias("m"))
    return linked(rest.join(low, "u")).union(linked(both.join(hubs, "u"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable id of every vertex of an undirected edge list (a, b): returns (id, component).

    Alternates the two star operations on the edge table; a component shrinks to a star in a few rounds, whatever its
    size. Per-vertex minima are partial aggregates, and each round's table is written to the shared folder, so no group
    is gathered in one task and a lost executor costs only that round. Self loops and repeated edges are harmless; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    e = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    e, path = written(e, "cc")
    signature = None
    for _ in range(max_rounds):
        large = _large_star(e)
        # small star: every smaller neighbour of u, and u itself, are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, (e, path) = path, written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "cc")
        removed(spark, old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(998_244_353)))).first()
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.union(roots.select(F.col("component").alias("id"), "component").distinct())


def block_pairs(members: DataFrame, key: str, by: str, block: int, payload: DataFrame | None = None) -> DataFrame:
    """Deal the members of each key (``key``, a long) in groups of two blocks at most, sorted by group.

    A key of more than ``block`` members is cut in blocks by a hash of ``by``, and every pair of its blocks is a group of
    its own, so that all pairs of members meet, whatever the key's size, and no task holds more than a few blocks. Keys
    of one member are left out. Adds ``block`` and ``pair`` (both blocks' numbers in one long), and the columns of
    ``payload``, which has one row for each ``by``: wide columns join only the members that are left.
    """
    # a table of its own: where an aggregate feeds a join, a key of many members can't be split
    sizes = saved(members.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1"), "sizes")
    cut = members.join(sizes, key).withColumn("__blocks", F.ceil(F.col("__n") / block).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64(by, F.lit(5)), F.col("__blocks")).cast("int"))
    paired = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    paired = paired.withColumn("pair", F.least("block", "__other").cast("long") * (1 << 31) + F.greatest("block", "__other"))
    paired = paired.drop("__n", "__blocks", "__other")
    if payload is not None:
        paired = paired.join(payload, by)
    return paired.repartition(key, "pair").sortWithinPartitions(key, "pair")


def group_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole groups, from rows sorted by (key, pair), with the bounds of their groups; a group that a batch cuts is carried over."""

    def bounds(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        k, p = part[key].to_numpy(), part["pair"].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1])) + 1
        return part, np.concatenate(([0], cut, [len(k)]))

    rest = []
    for batch in batches:
        if not len(batch):
            continue
        if rest:
            same = (batch[key] == rest[-1][key].iloc[-1]) & (batch["pair"] == rest[-1]["pair"].iloc[-1])
            if same.all():
                rest.append(batch)
                continue
            batch = pd.concat([*rest, batch], ignore_index=True)
        last = (batch[key] == batch[key].iloc[-1]) & (batch["pair"] == batch["pair"].iloc[-1])
        rest = [batch[last]]
        if not last.all():
            yield bounds(batch[~last])
    if rest:
        yield bounds(pd.concat(rest, ignore_index=True))


def spanning(adjacent: np.ndarray) -> np.ndarray:
    """A star for each component of a symmetric boolean adjacency matrix: rows of (hub, member)."""
    todo, out = adjacent.any(1), []
    for s in np.flatnonzero(todo):
        if not todo[s]:
            continue
        todo[s] = False
        frontier = np.array([s])
        while len(frontier):
            frontier = np.flatnonzero(adjacent[frontier].any(0) & todo)
            todo[frontier] = False
            out += [(s, m) for m in frontier]
    return np.array(out, dtype=np.int64).reshape(-1, 2)
