"""Readers of the driver tables, of stored patches and of JSON documents; written tables; run tables."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .guard import stamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files at path, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def patches(spark: SparkSession, path: str) -> DataFrame:
    """comparison_id, content (binary) of stored unified patches."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("comparison_id"), "content")


def load_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row for each JSON document at path; a file that holds no object raises an error."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset (tests) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_dir.get() if set_dir.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="diffloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def written_by(spark: SparkSession, df: DataFrame, label: str, by: str, buckets: int) -> DataFrame:
    """As written, in so many buckets by a column: what is then grouped or joined by it, or by it and others, isn't shuffled again."""
    at, name = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", f"diffloom_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, by).option("path", at).saveAsTable(name)
    out = spark.table(name)
    out._written_at = at
    return out


def unwritten(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Store:
    """Tables by key under one folder, in versions.

    Every build goes to a folder of its own. When it is complete, a pointer
    with the next number, its facts and that folder is moved into place, which
    fails if another writer has taken the number; the loser looks again, and
    uses the other's table if its facts are the same. The highest pointer
    counts, so readers see a whole table at any time, and a writer that is
    killed leaves a folder that nothing points at (see vacuum).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._keep_both = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    @staticmethod
    def _safe(key: str) -> str:
        if not key or not all(c.isascii() and c.isalnum() or c in "-_" for c in key):
            raise ValueError(f"unsafe key {key!r}")
        return key

    def _names(self, at: str) -> list[str]:
        path = self._path(at)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _pointers(self, key: str) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.folder}/{key}/pointers") if n.isdigit())

    def _read(self, key: str, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{key}/pointers/{n}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, key: str, n: int, told: dict) -> bool:
        """Whether pointer n is now this one; False if there is one already."""
        new = self._path(f"{self.folder}/{key}/tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(new, False)
        stream.write(bytearray(json.dumps(told, sort_keys=True).encode()))
        stream.close()
        at = self._path(f"{self.folder}/{key}/pointers/{n}")
        self._fs.mkdirs(at.getParent())
        try:
            self._context.rename(new, at, self._keep_both)
        except Exception as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def current(self, key: str) -> dict | None:
        """The facts and the folder of a key's table, None if there is none."""
        found = self._pointers(self._safe(key))
        return self._read(key, found[-1]) if found else None

    def keep(self, key: str, build, **facts) -> DataFrame:
        """The table of this key, built by build() unless it is there with these facts."""
        version, wanted = None, json.loads(json.dumps({"key": self._safe(key), **facts}))
        while True:
            known = self._pointers(key)
            last = self._read(key, known[-1]) if known else None
            if last and last["facts"] == wanted:
                if version:
                    self._fs.delete(self._path(version), True)
                return self.spark.read.parquet(last["data"])
            if version is None:
                version = f"{self.folder}/{key}/versions/{uuid.uuid4().hex}"
                build().write.parquet(version)
            if self._point(key, (known[-1] if known else 0) + 1, {"facts": wanted, "data": version}):
                return self.spark.read.parquet(version)

    def status(self) -> list[dict]:
        """key, facts, bytes and files of what counts, and versions, all that are there, of every key."""
        out = []
        for key in self._names(self.folder):
            last = self.current(key)
            size = self._fs.getContentSummary(self._path(last["data"])) if last else None
            out.append({"key": key, "facts": last and last["facts"], "bytes": size.getLength() if size else 0, "files": size.getFileCount() if size else 0, "versions": len(self._names(f"{self.folder}/{key}/versions"))})
        return out

    def clear(self, key: str | None = None) -> int:
        """Deletes a key's tables, or all; gives how many keys went."""
        gone = self._names(self.folder) if key is None else [self._safe(key)]
        return sum(bool(self._fs.delete(self._path(f"{self.folder}/{k}"), True)) for k in gone)

    def vacuum(self, key: str) -> int:
        """Deletes what no longer counts of a key: older pointers, and versions that the last one doesn't name. Not while others write or read old versions; gives how many versions went."""
        known, gone = self._pointers(self._safe(key)), 0
        data = self._read(key, known[-1])["data"].rpartition("/")[2] if known else None
        for n in known[:-1]:
            self._fs.delete(self._path(f"{self.folder}/{key}/pointers/{n}"), False)
        for name in self._names(f"{self.folder}/{key}/versions"):
            if name != data:
                gone += self._fs.delete(self._path(f"{self.folder}/{key}/versions/{name}"), True)
        return gone


def cache_root(spark: SparkSession) -> str:
    """Where stores are kept: diffloom.cache.dir of the session, else a folder beside the scratch tables."""
    return spark.conf.get("diffloom.cache.dir", None) or f"{shared_dir(spark)}/cache"


def repository_store(spark: SparkSession, repository: str) -> Store:
    """The store of a repository, by its id of 64 hex digits."""
    if not re.fullmatch("[0-9a-f]{64}", repository):
        raise ValueError(f"no repository id: {repository!r}")
    return Store(spark, f"{cache_root(spark)}/{repository}")


class Runs:
    """Runs in two phases: begin() keeps what was analysed and awaits an explanation, finish() adds the report if nothing has changed since.

    A run's artifacts are tables in a folder of its own, written before the row
    that names them; their files are stamped, and a run whose artifacts aren't
    what they were can't be finished. A run is complete with its last row only,
    so one that is killed on the way still awaits its explanation.
    """

    SCHEMA = "run_id string, comparison string, budget long, status string, step int"
    KEPT = "run_id string, name string, path string, files long, bytes long, stamp long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def rows(self) -> DataFrame:
        return self._table("runs", self.SCHEMA)

    def artifacts(self, run: str) -> DataFrame:
        """name, path, files, bytes, stamp of what a run has kept."""
        return self._table("kept", self.KEPT).where(F.col("run_id") == run).drop("run_id")

    def _add(self, *row) -> None:
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")

    def _keep(self, run: str, tables: dict[str, DataFrame]) -> None:
        kept = []
        for name, df in tables.items():
            if not re.fullmatch("[a-z][a-z0-9_]*", name):
                raise ValueError(f"no name of an artifact: {name!r}")
            at = f"{self.folder}/artifacts/{run}/{name}"
            df.write.parquet(at)
            kept.append((run, name, at, *stamp(self.spark, at)))
        if kept:
            self.spark.createDataFrame(kept, self.KEPT).coalesce(1).write.mode("append").parquet(f"{self.folder}/kept")

    def begin(self, comparison: str, budget: int, **tables: DataFrame) -> str:
        run = uuid.uuid4().hex
        self._keep(run, tables)
        self._add(run, comparison, budget, "awaiting_explanation", 1)
        return run

    def read(self, run: str, name: str) -> DataFrame:
        """An artifact of a run; ValueError if it has none of that name."""
        found = self.artifacts(run).where(F.col("name") == name).first()
        if found is None:
            raise ValueError(f"run {run} has no artifact {name!r}")
        return self.spark.read.parquet(found.path)

    def state(self, run: str):
        """The run's latest row, None for an unknown run."""
        return self.rows().where(F.col("run_id") == run).orderBy(F.desc("step")).first()

    def changed(self, run: str) -> list[str]:
        """Names of the artifacts whose files aren't where or what they were."""
        return sorted(a.name for a in self.artifacts(run).collect() if not self._there(a.path) or stamp(self.spark, a.path) != (a.files, a.bytes, a.stamp))

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def finish(self, run: str, comparison: str, **tables: DataFrame) -> None:
        last = self.state(run)
        if last is None or last.status != "awaiting_explanation":
            raise ValueError(f"run {run} awaits no explanation")
        if last.comparison != comparison:
            raise ValueError(f"run {run} is of another comparison")
        if gone := self.changed(run):
            raise ValueError(f"artifacts of run {run} have changed: {', '.join(gone)}")
        self._keep(run, tables)
        self._add(run, comparison, last.budget, "complete", last.step + 1)
