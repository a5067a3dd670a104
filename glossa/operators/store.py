"""Tables of articles and their children as Parquet: upserts, replacement by key, cascading deletes, swaps."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHILDREN = ["analyses", "vocabulary", "collocations", "polysemy", "sentence_patterns"]


def latest(rows: DataFrame, key: Sequence[str], version: Column) -> DataFrame:
    """The row of the highest version for each key; one aggregate, no sort."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), version).alias("r")).select(*key, *[f"r.{c}" for c in others])


def upsert(old: DataFrame, new: DataFrame, key: str, *, keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """New rows replace old ones of the same key, but for the columns in keep, which the first version sets.

    Of several new rows of a key the last one counts: the one with the highest order if new has a column __order, else one
    by a hash of its values, so that the result doesn't depend on how rows are dealt.
    """
    order = F.col("__order").cast("long") if "__order" in new.columns else F.lit(0).cast("long")
    both = old.withColumns({"__v": F.lit(0), "__o": F.lit(0).cast("long")}).unionByName(new.withColumns({"__v": F.lit(1), "__o": order}).drop("__order"), allowMissingColumns=True)
    fresh = [c for c in both.columns if c not in (key, "__v", "__o", *keep)]
    values = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in both.columns if c not in ("__v", "__o")])))
    rank = F.struct("__v", "__o", values)
    out = both.groupBy(key).agg(F.max_by(F.struct(*fresh), rank).alias("r"), *[F.min_by(c, rank).alias(c) for c in keep])
    return out.select(*[key if c == key else F.col(c) if c in keep else F.col(f"r.{c}") for c in both.columns if c not in ("__v", "__o")])


def replace_by_key(old: DataFrame, new: DataFrame, key: str, replaced: DataFrame | None = None) -> DataFrame:
    """All old rows of the replaced keys (new's keys unless given) go, new rows come."""
    keys = (replaced if replaced is not None else new).select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_payload(new: DataFrame, old: DataFrame, key: str, column: str = "llm_json") -> DataFrame:
    """new, with old's non-empty payload where new's is empty."""
    before = old.select(key, F.col(column).alias("__old"))
    empty = F.coalesce(F.col(column), F.lit("{}")).isin("", "{}")
    return new.join(before, key, "left").withColumn(column, F.when(empty, F.coalesce("__old", F.lit("{}"))).otherwise(F.col(column))).drop("__old")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of the given ids."""
    return {name: df.join(ids.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def merge_personal(old: DataFrame, new: DataFrame) -> DataFrame:
    """Personal words by lemma: a null article keeps the old one, an empty example keeps the old one."""
    both = old.alias("o").join(new.alias("n"), "lemma", "full")
    pick = lambda c, e: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")) if e else F.col(f"n.{c}"), F.col(f"o.{c}"))
    return both.select("lemma", pick("word", False).alias("word"), pick("article_id", False).alias("article_id"), F.coalesce(pick("example_sentence", True), F.lit("")).alias("example_sentence"), F.coalesce("o.created_at", "n.created_at").alias("created_at"))


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns are added with their default, given as SQL."""
    return df.withColumns({c: F.expr(e) for c, e in columns.items() if c not in df.columns})


class Store:
    """Tables as versioned Parquet folders below one root, named by a manifest of all tables; numbered pointers name the manifests.

    A commit writes new folders, then a manifest, and adds the next pointer last: several tables change together or not at
    all, also when a job dies in between, and of two commits at once one fails at least. The last ``keep`` manifests stay,
    with the folders that they name, for readers that have begun; older ones are deleted by the commit. Folders and pointers
    go through Spark's file system. That a pointer is created once only is certain where the file system makes new files
    atomically (HDFS, local disks); on object stores a commit that lost can be noticed late, so let one job write there.

    A table is one folder, or a folder for each bucket of its key, of which merge writes only those that a batch touches.
    """

    def __init__(self, spark: SparkSession, root: str, *, keep: int = 20):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep)

    # ---- commits

    def _path(self, text: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _pointers(self) -> list[str]:
        """number_manifest of every kept commit, the oldest first."""
        fs, path = self._path(f"{self.root}/_commits/pointers")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _manifest(self, pointer: str) -> dict[str, dict]:
        fs, path = self._path(f"{self.root}/_commits/{pointer.split('_', 1)[1]}.json")
        return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(fs.open(path))).decode())

    def tables(self) -> dict[str, dict]:
        """What the last commit says: for each table {"folder": name}, or {"buckets": n, "folders": {bucket: name}}."""
        known = self._pointers()
        return self._manifest(known[-1]) if known else {}

    def _commit(self, changes: dict[str, dict]) -> None:
        known = self._pointers()
        number = int(known[-1].split("_")[0]) + 1 if known else 1
        content = {**(self._manifest(known[-1]) if known else {}), **changes}
        name = uuid.uuid4().hex
        fs, path = self._path(f"{self.root}/_commits/{name}.json")
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        pointer = self._path(f"{self.root}/_commits/pointers/{number:012d}_{name}")[1]
        if not fs.createNewFile(pointer) or [p for p in self._pointers() if int(p.split("_")[0]) >= number] != [pointer.getName()]:
            fs.delete(pointer, False)
            fs.delete(path, False)
            raise RuntimeError("the store was written by another job at the same time")
        self._forget(self._pointers()[: -self.keep])

    def _forget(self, pointers: list[str]) -> None:
        """Delete old commits, and folders that no later one names."""
        if not pointers:
            return
        kept = {f for p in self._pointers() if p not in pointers for f in folders_of(self._manifest(p))}
        gone = {f for p in pointers for f in folders_of(self._manifest(p))} - kept
        fs, _ = self._path(self.root)
        for p in pointers:  # first what names the folders, so that nobody begins to read them
            fs.delete(self._path(f"{self.root}/_commits/pointers/{p}")[1], False)
            fs.delete(self._path(f"{self.root}/_commits/{p.split('_', 1)[1]}.json")[1], False)
        for folder in gone:
            fs.delete(self._path(f"{self.root}/{folder}")[1], True)

    def vacuum(self, hours: float = 24.0) -> int:
        """Delete folders of tables that no kept commit names and that are older than that: what jobs left that died. How many."""
        named = {f.split("/__bucket=")[0] for p in self._pointers() for f in folders_of(self._manifest(p))}
        fs, root = self._path(self.root)
        before, n = (time.time() - 3600 * hours) * 1000, 0
        for table in [f for f in (fs.listStatus(root) if fs.exists(root) else []) if f.isDirectory() and f.getPath().getName() != "_commits"]:
            for f in fs.listStatus(table.getPath()):
                if f"{table.getPath().getName()}/{f.getPath().getName()}" not in named and f.getModificationTime() <= before:
                    n += bool(fs.delete(f.getPath(), True))
        return n

    # ---- tables

    def exists(self, name: str) -> bool:
        return name in self.tables()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders_of({name: self.tables()[name]})])

    def write(self, name: str, df: DataFrame) -> None:
        self.write_all({name: df})

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """All folders first, then one commit: a job that fails while it computes changes no table."""
        versions = {name: {"folder": f"{name}/v-{uuid.uuid4().hex}"} for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{versions[name]['folder']}")
        self._commit(versions)

    def upsert(self, name: str, new: DataFrame, key: str, keep: Sequence[str] = ("created_at",)) -> None:
        old = self.read(name) if self.exists(name) else new.drop("__order").limit(0)
        self.write(name, upsert(old, new, key, keep=keep))

    def merge(self, name: str, new: DataFrame, key: str, *, keep: Sequence[str] = (), buckets: int = 64, drop: str | None = None) -> None:
        """upsert for small batches into a large table: only the buckets of the batch's keys are read and written.

        drop: rows for which this holds after the merge go. A table in one folder is dealt into buckets by its first merge.
        """
        known = self.tables().get(name)
        folders = {int(b): f for b, f in known["folders"].items()} if known and "folders" in known else {}
        buckets = known["buckets"] if folders else buckets
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = new.withColumn("__bucket", bucket).persist()
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # at most buckets
        if known and not folders and touched:
            before, touched = [known["folder"]], list(range(buckets))
        else:
            before = [folders[b] for b in touched if b in folders]
        if touched:
            old = self.spark.read.parquet(*[f"{self.root}/{f}" for f in before]) if before else new.drop("__bucket", "__order").limit(0)
            rows = upsert(old, new.drop("__bucket"), key, keep=keep)
            if drop:
                rows = rows.where(~F.coalesce(F.expr(drop), F.lit(False)))
            version = f"{name}/b-{uuid.uuid4().hex}"
            dealt = rows.withColumn("__bucket", bucket).repartition(len(touched), "__bucket").persist()
            there = {r[0] for r in dealt.select("__bucket").distinct().collect()}  # at most buckets
            dealt.write.partitionBy("__bucket").parquet(f"{self.root}/{version}")
            after = {**{b: f for b, f in folders.items() if b not in touched}, **{b: f"{version}/__bucket={b}" for b in there}}
            if after:
                self._commit({name: {"buckets": buckets, "folders": {str(b): f for b, f in after.items()}}})
            else:  # no row is left: an empty table keeps its columns
                self.write(name, rows.limit(0))
            dealt.unpersist()
        new.unpersist()

    def replaced(self, name: str, new: DataFrame, key: str, replaced: DataFrame | None = None) -> DataFrame:
        return replace_by_key(self.read(name), new, key, replaced) if self.exists(name) else new

    def replace(self, name: str, new: DataFrame, key: str, replaced: DataFrame | None = None) -> None:
        self.write(name, self.replaced(name, new, key, replaced))

    def delete(self, ids: DataFrame, key: str = "doc_id", parent: str = "articles", parent_key: str | None = None) -> None:
        """The rows of the ids go from the parent and all children, in one commit."""
        known = self.tables()
        out = {n: cascade_delete({n: self.read(n)}, ids, key)[n] for n in CHILDREN if n in known}
        if parent in known:
            other = parent_key or key
            out[parent] = self.read(parent).join(ids.select(F.col(key).alias(other)).distinct(), other, "left_anti")
        self.write_all(out)


def folders_of(tables: dict[str, dict]) -> list[str]:
    """All folders that a manifest's entries name."""
    return [f for t in tables.values() for f in (t["folders"].values() if "folders" in t else [t["folder"]])]
