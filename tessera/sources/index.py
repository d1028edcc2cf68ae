"""A kept lexical index of segments: what changed goes to a new segment, what is gone is marked, and segments are folded.

Below an index's folder, ``segments/NAME`` holds texts' term lists (``docs``) and blocks of postings (``postings``), and
``versions/NAME`` the merged statistics of terms and of all texts, the texts of older segments that don't count any more
(``gone``), and ``manifest``, which is written last and names the segments. Segments and versions never change, so readers
of an older version go on; two sessions that build at once write apart.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import lexical
from ..session import kept, shared_folder
from .files import exists

#: Segments of a version, and the share of texts that are gone, beyond which segments are folded.
SEGMENTS, GONE = 8, 0.5


@dataclass
class Segment:
    path: str
    shards: int
    buckets: int


@dataclass
class Manifest:
    segments: list[Segment]
    files: list[str] = field(default_factory=list)  # of the table that is indexed, where it is one
    generation: int = 0
    gone: int = 0
    n: int = 0
    length: int = 0  # of all texts, in terms


@dataclass
class LexicalIndex:
    spark: SparkSession
    root: str
    version: str
    manifest: Manifest

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/versions/{self.version}/{name}")

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf)"""
        return self._table("terms")

    @property
    def avgdl(self) -> float:
        return self.manifest.length / self.manifest.n if self.manifest.n else 1.0

    @property
    def stats(self) -> DataFrame:
        """One row (n, avgdl); texts without a term count as documents of length zero."""
        return self.spark.createDataFrame([(self.manifest.n, self.avgdl)], "n long, avgdl double")

    @property
    def gone(self) -> DataFrame | None:
        """(segment, shard, id, dl, terms) of texts that don't count any more; None if there are none."""
        return self._table("gone") if self.manifest.gone else None

    def docs(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.manifest.segments[number].path}/docs")

    @property
    def id_type(self):
        return self.docs(0).schema["id"].dataType

    def lists(self) -> DataFrame:
        """(id, dl, terms, tfs, file) of all texts that count."""
        parts = []
        for number in range(len(self.manifest.segments)):
            rows = self.docs(number)
            parts.append(rows.join(self.gone.where(F.col("segment") == number).select("id"), "id", "left_anti") if self.manifest.gone else rows)
        return reduce(DataFrame.unionByName, parts)

    def postings(self, asked: list[str]) -> DataFrame:
        """(unit, term, ids, tfs, dls) of some terms; and each shard's ids that are gone. A file holds few buckets, each in
        the order of terms, so what a scan needn't read shows in the files' statistics.
        """
        words = F.broadcast(self.spark.createDataFrame([(t,) for t in asked], "term string"))  # of one pass of questions
        unit = lambda number: (F.lit(number).cast("long") * (1 << 32) + F.col("shard")).alias("unit")
        parts = []
        for number, s in enumerate(self.manifest.segments):
            rows = _postings(self.spark, s).where(F.col("bucket").isin(sorted(set(lexical.buckets_of(asked, s.buckets).tolist()))))
            rows = rows.where(F.col("term").isin(asked)) if len(asked) <= 10 else rows.join(words, "term", "left_semi")
            rows = rows.select("term", "ids", "tfs", "dls", F.explode("slices").alias("s")).withColumn("shard", F.col("s.shard"))
            parts.append(rows.select(unit(number), "term", *(F.slice(c, F.col("s.first") + 1, F.col("s.size")).alias(c) for c in ("ids", "tfs", "dls"))))
        if self.manifest.gone:
            for number in range(len(self.manifest.segments)):
                rows = self.gone.where(F.col("segment") == number).groupBy("shard").agg(F.collect_list("id").alias("ids"))  # a shard's
                none = F.array().cast("array<int>")
                parts.append(rows.select(unit(number), F.lit(None).cast("string").alias("term"), "ids", none.alias("tfs"), none.alias("dls")))
        return reduce(DataFrame.unionByName, parts)

    def search(self, queries: DataFrame, query_id: str, query: str, k: int = 5) -> DataFrame:
        if not self.manifest.segments:
            return self.spark.createDataFrame([], "query_id string, id string, score double, rank int")
        return lexical.bm25_topk(queries, query_id, query, self.postings, self.terms, self.avgdl, self.id_type, k, keep=self._kept)

    def _kept(self, rows: DataFrame) -> DataFrame:
        at = f"{shared_folder(self.spark)}/pass-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.parquet(at)


def _postings(spark: SparkSession, s: Segment) -> DataFrame:
    """A segment's blocks; its folder has no file where no text has a term."""
    kind = spark.read.parquet(f"{s.path}/docs").schema["id"].dataType.simpleString()
    return spark.read.schema(lexical.BLOCK.format(kind)).parquet(f"{s.path}/postings")


def _versions(spark: SparkSession, root: str) -> dict[str, Manifest]:
    """All finished versions of an index by name."""
    if not exists(spark, f"{root}/versions"):
        return {}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    there = [f"{root}/versions/{n}/manifest" for n in names if exists(spark, f"{root}/versions/{n}/manifest/_SUCCESS")]
    out = {}
    for r in spark.read.text(there, wholetext=True).select("value", "_metadata.file_path").collect() if there else []:  # a row a version
        d = json.loads(r["value"])
        out[r["file_path"].split("/")[-3]] = Manifest([Segment(**s) for s in d.pop("segments")], **d)
    return out


def read_lexical(spark: SparkSession, root: str, version: str | None = None) -> LexicalIndex | None:
    """A version of an index, the last one if none is named; None if there is none, or its writing wasn't finished."""
    found = _versions(spark, root)
    version = version or max(found, key=lambda v: found[v].generation, default=None)
    return LexicalIndex(spark, root, version, found[version]) if version in found else None


def _unique(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """An id names one text: of a repeated id the least row counts. Only ids are shuffled where none is repeated."""
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return docs
    others = [c for c in docs.columns if c != id_col]
    return docs.groupBy(id_col).agg(F.min(F.struct(*others)).alias("r")).select(id_col, "r.*")


def _segment(spark: SparkSession, root: str, lists: DataFrame) -> tuple[list[Segment], int, int]:
    """Write term lists (id, dl, terms, tfs, file) as a segment, none if there is no text; also the number of texts and of terms in them."""
    path = f"{root}/segments/{uuid.uuid4().hex}"
    lists.write.option("compression", "zstd").parquet(f"{path}/docs")
    rows = spark.read.parquet(f"{path}/docs")
    one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
    if not one["n"]:
        return [], 0, 0
    s = Segment(path, lexical.shard_count(one["n"]), lexical.bucket_count(one["length"], lexical.shard_count(one["n"])))
    blocks = lexical.blocks(rows, s.shards, s.buckets)
    blocks.write.option("compression", "zstd").parquet(f"{path}/postings")
    return [s], one["n"], one["length"]


def _version(spark: SparkSession, root: str, version: str, manifest: Manifest, gone: DataFrame | None) -> LexicalIndex:
    """Write a version: the gone texts, the merged statistics of terms, and last the manifest."""
    at = f"{root}/versions/{version}"
    counts = [spark.createDataFrame([], "term string, df long")]
    counts += [_postings(spark, s).where("block = 0").select("term", F.col("df").cast("long").alias("df")) for s in manifest.segments]
    if gone is not None:
        gone.write.mode("overwrite").parquet(f"{at}/gone")
        gone = spark.read.parquet(f"{at}/gone")
        one = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        manifest.gone, manifest.n, manifest.length = one["n"], manifest.n - one["n"], manifest.length - one["length"]
        counts.append(gone.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("df")))
    df = reduce(DataFrame.unionByName, counts).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    lexical.with_idf(df, manifest.n).write.mode("overwrite").parquet(f"{at}/terms")
    spark.createDataFrame([(json.dumps(asdict(manifest)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
    return LexicalIndex(spark, root, version, manifest)


def write_lexical(docs: DataFrame, id_col: str, text: str, root: str, tokenizer=tokens, version: str | None = None, files: list[str] | None = None, generation: int = 0) -> LexicalIndex:
    """Build an index of texts anew, as a version with one segment. A column ``file`` stays with the texts."""
    spark = docs.sparkSession
    rows = docs.select(id_col, text, (F.col("file") if "file" in docs.columns else F.lit(None).cast("string")).alias("file"))
    segment, n, length = _segment(spark, root, lexical.term_lists(_unique(rows, id_col, text), id_col, text, tokenizer))
    if not generation:
        generation = 1 + max((m.generation for m in _versions(spark, root).values()), default=0)
    return _version(spark, root, version or uuid.uuid4().hex, Manifest(segment, files or [], generation, 0, n, length), None)


def updated(old: LexicalIndex, changed: DataFrame, id_col: str, text: str, removed: DataFrame | None = None, tokenizer=tokens, version: str | None = None, files: list[str] | None = None) -> LexicalIndex:
    """The next version: rows of ``changed`` replace texts of the same ids or are new, and texts that ``removed`` picks (rows of
    (id) or, with a column ``file``, of files) are gone.

    Only the changed rows are read and cut in terms; of older segments only their lists of ids, to mark what is gone, and
    the terms of those texts, which leave the statistics.
    """
    spark, root = old.spark, old.root
    rows = changed.select(id_col, text, (F.col("file") if "file" in changed.columns else F.lit(None).cast("string")).alias("file"))
    rows = _unique(rows, id_col, text).where(F.col(id_col).isNotNull())
    segment, n, length = _segment(spark, root, lexical.term_lists(rows, id_col, text, tokenizer))
    fresh = spark.read.parquet(f"{segment[0].path}/docs").select("id") if segment else rows.select(F.col(id_col).alias("id"))
    parts = [old.gone] if old.manifest.gone else []
    for number, s in enumerate(old.manifest.segments):
        docs = old.docs(number)
        if old.manifest.gone:
            docs = docs.join(old.gone.where(F.col("segment") == number).select("id"), "id", "left_anti")
        ids = docs.select("id").join(fresh, "id", "left_semi")
        if removed is not None:
            ids = ids.unionByName(docs.join(removed, "file" if "file" in removed.columns else "id", "left_semi").select("id")).distinct()
        shard = F.pmod(F.xxhash64("id"), F.lit(s.shards)).cast("int").alias("shard")
        parts.append(docs.join(ids, "id", "left_semi").select(F.lit(number).alias("segment"), shard, "id", "dl", "terms"))
    m = old.manifest
    before = 0, 0
    if m.gone:  # ``n`` and ``length`` of a manifest are without the gone texts
        one = old.gone.agg(F.count("*"), F.sum("dl")).first()
        before = one[0], one[1]
    manifest = Manifest([*m.segments, *segment], files or [], m.generation + 1, 0, m.n + before[0] + n, m.length + before[1] + length)
    found = _version(spark, root, version or uuid.uuid4().hex, manifest, reduce(DataFrame.unionByName, parts) if parts else None)
    return folded(found) if len(manifest.segments) > SEGMENTS or manifest.gone > GONE * (manifest.n + manifest.gone) else found


def folded(old: LexicalIndex) -> LexicalIndex:
    """The same texts in one segment: its lists come from those of the segments, so no text is read."""
    segment, n, length = _segment(old.spark, old.root, old.lists())
    manifest = Manifest(segment, old.manifest.files, old.manifest.generation + 1, 0, n, length)
    return _version(old.spark, old.root, f"{old.version}-folded", manifest, None)


def listed(spark: SparkSession, path: str) -> dict[str, str]:
    """All data files below a folder, with a digest of name, size and time: a file that changed has another."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    if not system.exists(at):
        return out
    found = system.listFiles(at, True)
    while found.hasNext():
        f = found.next()
        inner = f.getPath().toString()[len(system.makeQualified(at).toString()) :]
        if not any(p.startswith(("_", ".")) for p in inner.split("/") if "=" not in p):
            out[hashlib.sha256(repr((inner, f.getLen(), f.getModificationTime())).encode()).hexdigest()[:24]] = f.getPath().toUri().toString()
    return out


def table_statistics(spark: SparkSession, path: str, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``stats`` and ``terms`` (term, df, idf) of a parquet table's index. Without a kept version they are counted from the
    texts in one pass, and no postings are made.
    """
    files = listed(spark, path)
    version = hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:24]
    found = _versions(spark, _root(spark, path, id_col, text))
    for name in (f"{version}-folded", version):
        if name in found:
            there = LexicalIndex(spark, _root(spark, path, id_col, text), name, found[name])
            return there.stats, there.terms.select("term", "df", "idf")
    docs = _unique(spark.read.parquet(path).select(id_col, text), id_col, text).where(F.col(id_col).isNotNull())
    words = docs.select(tokens(F.col(text)).alias("ts"))
    words = words.select(F.size("ts").cast("long").alias("dl"), F.posexplode_outer(F.array_distinct("ts")).alias("place", "term"))
    first = F.coalesce(F.col("place") == 0, F.lit(True))  # a text's first row, also of one without a term
    counts = words.groupBy("term").agg(F.count("*").alias("df"), F.sum(first.cast("long")).alias("n"), F.sum(F.when(first, F.col("dl")).otherwise(0)).alias("length"))
    counts = kept(counts, "statistics")
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    stats = spark.createDataFrame([(one["n"], one["length"] / one["n"] if one["n"] else 1.0)], "n long, avgdl double")
    return stats, lexical.with_idf(counts.where("term is not null").select("term", "df"), one["n"])


def _root(spark: SparkSession, path: str, id_col: str, text: str) -> str:
    """An index's folder; its name tells the form of the blocks."""
    return f"{shared_folder(spark)}/lexical3-{hashlib.sha256(repr((path, id_col, text)).encode()).hexdigest()[:20]}"


def kept_lexical(spark: SparkSession, path: str, id_col: str, text: str) -> LexicalIndex:
    """The index of a parquet table's texts, from the shared folder. If the table's files changed since the last version, only
    the new files are read, and the texts of files that are no more are gone; without a version, or where most files are
    new, it is built. Files are told by name, size and time, at any depth.
    """
    files = listed(spark, path)
    version = hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:24]
    root = _root(spark, path, id_col, text)
    found = _versions(spark, root)
    for name in (f"{version}-folded", version):
        if name in found:
            return LexicalIndex(spark, root, name, found[name])
    last = max(found, key=lambda v: found[v].generation, default=None)
    new = {d: f for d, f in files.items() if last is None or d not in found[last].files}
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "")  # noqa: E731 - one and two slashes after the scheme are the same

    def named(of: dict[str, str]) -> DataFrame:
        """Rows of some files with the file's digest."""
        names = F.broadcast(spark.createDataFrame([*of.items()], "file string, path string"))  # of the listing
        rows = spark.read.parquet(*(of or files).values()).select(id_col, text, "_metadata.file_path")
        return (rows if of else rows.where("false")).join(names, bare("file_path") == bare("path")).select(id_col, text, "file")

    if last is None or 2 * len(new) > len(files):
        return write_lexical(named(files), id_col, text, root, version=version, files=list(files), generation=1 + max((m.generation for m in found.values()), default=0))
    lost = [(d,) for d in found[last].files if d not in files]
    return updated(LexicalIndex(spark, root, last, found[last]), named(new), id_col, text, spark.createDataFrame(lost, "file string"), version=version, files=list(files))
