"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, group_runs, saved, spanning, table

THRESHOLD = 0.98
#: Six tables of three hashes each, with one more probe for each hash: a pair at the threshold meets in some table in over 0.95 of cases.
TABLES, HASHES = 6, 3
BLOCK = 256
SEED = 31


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, whose width is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """Keys [rows, tables, 1 + hashes] of unit vectors: the bucket, and with each hash in turn at its second choice.

    A hash is the nearest of the 2 d signed axes after three rounds of random signs and a Hadamard transform.
    """
    n, width = unit.shape
    d = max(2, 1 << max(0, width - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :width] = unit
    r = np.random.default_rng([seed, d])
    rows = np.arange(n)
    out = np.zeros((n, tables, 1 + hashes), np.int64)
    for t in range(tables):
        first, second = [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * (r.integers(0, 2, d) * 2 - 1))
            order = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            swap = np.abs(y[rows, order[:, 0]]) < np.abs(y[rows, order[:, 1]])
            a, b = np.where(swap, order[:, 1], order[:, 0]), np.where(swap, order[:, 0], order[:, 1])
            first.append(2 * a + (y[rows, a] < 0))
            second.append(2 * b + (y[rows, b] < 0))
        for probe in range(1 + hashes):
            key = np.full(n, t, np.int64)
            for k in range(hashes):
                key = key * (2 * d) + (second[k] if k + 1 == probe else first[k])
            out[:, t, probe] = key
    return out


def unit(vector) -> np.ndarray | None:
    """The vector at length one in double precision; None if it is null, empty, zero or holds null or non-finite components."""
    if vector is None or not len(vector):
        return None
    x = np.array([np.nan if c is None else c for c in vector], dtype=np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top  # tiny and huge components keep their precision
    return x / np.sqrt(x @ x)


HASHED = "row long, vec_id string, digest binary, keys array<long>"


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each row: its id (as text, which keeps nulls and large numbers whole), and, if it has a label and a proper vector,
    a digest of both and its bucket keys.
    """
    for b in batches:
        digest, vectors, keys = [None] * len(b), {}, [None] * len(b)
        by_width: dict[int, list[int]] = {}
        for k, (v, label) in enumerate(zip(b["embedding"], b["label"])):
            x = unit(v) if label is not None else None
            if x is not None:
                vectors[k] = x
                digest[k] = hashlib.blake2b(x.tobytes() + label.encode(), digest_size=16).digest()
                by_width.setdefault(len(x), []).append(k)
        for rows in by_width.values():
            found = bucket_keys(np.stack([vectors[k] for k in rows]))
            for k, own in zip(rows, found):
                # labels and widths never meet: both are part of the key
                salt = int.from_bytes(hashlib.blake2b(b"%s/%d" % (b["label"].iloc[k].encode(), len(vectors[k])), digest_size=5).digest(), "big")
                keys[k] = np.unique(own ^ (salt << 22))
        yield pd.DataFrame({"row": b["row"], "vec_id": b["vec_id"], "digest": digest, "keys": keys})


def _near(part: pd.DataFrame, s: int, e: int) -> np.ndarray:
    """Which members of a group are linked: one label, one width, cosine at the threshold or over, and not both of one block unless the group is that block."""
    own = part.iloc[s:e]
    adjacent = np.zeros((e - s, e - s), bool)
    label = own["label"].to_numpy()
    widths = own["embedding"].map(len).to_numpy()
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        x = np.stack(own["embedding"].iloc[at].to_list()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)  # as in ``unit``
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        adjacent[np.ix_(at, at)] = (x @ x.T >= THRESHOLD) & (label[at, None] == label[None, at])
    np.fill_diagonal(adjacent, False)
    pair = int(own["pair"].iloc[0])
    if pair >> 31 != pair & 0x7FFFFFFF:
        block = own["block"].to_numpy()
        adjacent &= block[:, None] != block[None, :]
    return adjacent


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, bounds in group_runs(batches, "key"):
        row, out = part["row"].to_numpy(), [np.zeros((0, 2), np.int64)]
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s > 1:
                out.append(row[s:e][spanning(_near(part, s, e))])
        edges = np.concatenate(out)
        yield pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, bounds in group_runs(batches, "component"):
        row, copies = part["row"].to_numpy(), part["copies"].to_numpy()
        rows, links = [], []
        for s, e in zip(bounds[:-1], bounds[1:]):
            rows.append(row[s:e])
            links.append(_near(part, s, e) @ copies[s:e])
        yield pd.DataFrame({"row": np.concatenate(rows), "links": np.concatenate(links)})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Equal vectors of a label are one class. Classes that share a bucket are verified in blocks; their stars give the
    components, and within a component every pair of classes is verified once, which gives the numbers of links. Groups
    emit stars and counts, never all pairs.
    """
    number = F.monotonically_increasing_id().alias("row")
    rows = saved(vectors.select(number, "vec_id", F.col("label").cast("string").alias("label"), "embedding"), "vectors")  # from here on a row keeps its number
    kind = vectors.schema["vec_id"].dataType
    hashed = rows.select("row", F.col("vec_id").cast("string").alias("vec_id"), "label", "embedding").mapInPandas(_hashed, HASHED)
    hashed = saved(hashed.withColumn("vec_id", F.col("vec_id").cast(kind)), "hashed")
    classes = hashed.where("digest is not null").groupBy("digest").agg(F.min("row").alias("row"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    first = hashed.select("row", "keys").join(classes, "row").join(rows.select("row", "label", "embedding"), "row")  # one row of each class
    keyed = first.select("row", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = keyed.join(shared, "key", "left_semi")
    payload = first.select("row", "label", "embedding")
    edges = saved(block_pairs(members, "key", "row", BLOCK, payload).mapInPandas(_edges, "a long, b long").distinct(), "links")
    found = saved(connected_components(edges).withColumnRenamed("id", "row"), "components")
    within = found.select("row", "component")
    counts = first.select("row", "label", "embedding", "copies")
    counted = block_pairs(within, "component", "row", BLOCK, counts).mapInPandas(_links, "row long, links long").groupBy("row").agg(F.sum("links").alias("links"))
    named = classes.join(found, "row", "left").withColumn("component", F.coalesce("component", "row"))
    least = saved(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    by_class = named.join(least, "component").join(counted, "row", "left").select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    # joins with saved tables, not with aggregates, so a component or digest of many rows can be split where it is joined
    out = hashed.select("vec_id", "digest").join(saved(by_class, "classes"), "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each vector of ``embeddings``. Vectors that are null, empty, zero or hold null or non-finite components,
    and those with a null label, link with nothing and are their own component. Repeated rows are linked like other equal
    vectors; of equally small ids none is preferred, all rows of the smallest id are kept; an empty table gives no rows.
    """
    return near_duplicates(table(spark, sf_dir, "embeddings"))
