"""Helpers shared by the operators: scratch tables and batch tokenisation."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Separators of words: space and the bytes 0x09 to 0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_L = 0xD6E8FEB86659FD93
_tables: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset (tests) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="diffloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Written tables after which the driver lets go of the shuffle files of finished jobs, and files that a table may have for each core of the cluster.
TIDY, FILES = 1, 4
#: Names that a task remembers at most, so as not to give a thing twice; beyond that it begins anew.
SEEN = 1 << 20
#: Bytes of a batch that goes to or comes from a Python worker, of which several are held at a time.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


class Scratch:
    """Written tables in the shared folder; they cut lineage and survive lost executors.

    Spark removes the shuffle files and broadcasts of a finished job when the
    driver collects its garbage, by default as late as its heap is full. An
    operator of many small jobs asks for that after each table, so that
    disk and driver hold what is in use.
    """

    #: Where scratch folders are noted as they are made (see recorded).
    _noted: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", 0
        if Scratch._noted is not None:
            Scratch._noted.append(self)

    @staticmethod
    @contextlib.contextmanager
    def recorded():
        """Gives the list of scratch folders that are made meanwhile."""
        before, Scratch._noted = Scratch._noted, []
        try:
            yield Scratch._noted
        finally:
            Scratch._noted = before

    def few(self, df: DataFrame) -> DataFrame:
        """df in a few tasks a core, for scans that combine what they find within a task."""
        return df.coalesce(FILES * self.spark.sparkContext.defaultParallelism)

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def tidy(self) -> None:
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a written table. Small partitions share a task, which takes them one after the other, so that a table has few files."""
        at, (name, size) = self.path(), BATCH
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, size)
        try:
            self.few(df).write.parquet(at)
        finally:
            self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)
        if self.n % TIDY == 0:
            self.tidy()
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in frames:
            self._delete(df._scratch_path)

    def release(self) -> None:
        """Deletes all tables of this folder; for when what was made of them is written."""
        self._delete(self.base)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(_U, copy=True)
    shifted = np.empty_like(x)
    x ^= np.right_shift(x, _U(30), out=shifted)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, _U(27), out=shifted)
    x *= _U(0x94D049BB133111EB)
    x ^= np.right_shift(x, _U(31), out=shifted)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number and of its inverse; short tables are kept, those for a very long text aren't."""
    if len(_tables.get("pw", ())) >= n:
        return _tables["pw"], _tables["inv"]
    short = n <= 1 << 19
    n = max(2 * n, 1 << 12) if short else n
    made = np.cumprod(np.full(n, _P), dtype=_U), np.cumprod(np.full(n, _U(pow(int(_P), -1, 1 << 64))), dtype=_U)
    if short:
        _tables["pw"], _tables["inv"] = made
    return made


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty string."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 17):
    """Ranges of rows of about so many bytes each, by default so few that arrays over them stay in the processor's cache."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def counts(mask: np.ndarray) -> np.ndarray:
    """How many entries before each place are true, one more place than entries."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, dtype=np.int32, out=out[1:])
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each row (one more entry than rows)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(data: np.ndarray, starts, ends, width: int | None = None) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand; starts and ends may be slices for ranges of one width."""
    pw, inv = powers(len(data) + 1)
    value = data.astype(_U)
    value += _U(1)
    value *= pw[: len(data)]
    if width is None and len(starts) and (ends > starts).all() and (ends[:-1] <= starts[1:]).all():
        # ranges apart from each other are summed one by one
        sums = np.add.reduceat(np.append(value, _U(0)), np.stack((starts, ends), axis=1).ravel())[::2]
        return mix(sums * inv[starts] + (ends - starts).astype(_U) * _U(_L))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(value, out=total[1:])
    size = (ends - starts).astype(_U) * _U(_L) if width is None else _U(width * _L % (1 << 64))
    out = total[ends] - total[starts]
    out *= inv[starts]
    out += size
    return mix(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


_K = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's word shingles; with fewer words the whole sequence is one shingle."""
    starts, ends, first = word_bounds(data, offsets)
    h = range_hashes(data, starts, ends)
    n = len(h) - width + 1
    grams = mix(sum((h[k : k + n] * _K[k] for k in range(width)), np.zeros(max(n, 0), _U))) if n > 0 else np.zeros(0, _U)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _K[: b - a]).sum(dtype=_U) + _U(b - a)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out
