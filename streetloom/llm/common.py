"""What the training-data operators share: shared folder, row keys, numbering, text buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Internal column names; callers' columns never start so.
FILE, ROW = "__lw_file", "__lw_row"
#: The ASCII white space of the contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

_own_dir: dict[str, str] = {}
#: What this worker keeps from task to task, by the operator that uses it.
_kept: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or an own one where it is unset (local runs only)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = _own_dir.setdefault("at", "file://" + tempfile.mkdtemp(prefix="streetloom-"))
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def with_row_key(df: DataFrame, *cols: Column | str) -> DataFrame:
    """cols of df (all by default) and a key of each row that every scan gives alike: hash of the file's path, row in the file.

    Repeated and null ids so stay apart. What isn't a plain file scan is written to the shared folder first.
    """
    d = stored(df)
    meta = d.metadataColumn("_metadata")
    return d.select(*(cols or ["*"]), F.xxhash64(meta["file_path"]).alias(FILE), meta["row_index"].alias(ROW))


def stored(df: DataFrame) -> DataFrame:
    """df if its rows have places in files, else df written to the shared folder: what reads row keys twice starts here."""
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta["row_index"]).schema  # noqa: B018  resolves the hidden column
        return df
    except (AnalysisException, AttributeError):
        return materialize(df, "rows")


def chunks_of(spark: SparkSession) -> int:
    """Into how many parts a group is dealt for numbering: follows the partitions that the cluster is set to."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def gapless(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with name: 0, 1, 2, ... inside each group, without a task that holds a whole group.

    Rows are dealt to chunks by a hash of `order` (which should tell rows apart); chunks are counted, a running
    sum over the counts (chunks x groups rows) gives each chunk its first number. df is read twice, so it should
    be a written table.
    """
    part = "__lw_part"
    d = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(chunks_of(df.sparkSession))))
    base = d.groupBy(*group, part).agg(F.count("*").alias("__lw_n")).withColumn(
        "__lw_base", F.sum("__lw_n").over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)) - 1
    numbered = d.withColumn("__lw_at", place)
    base = base.select(*(F.col(c).alias(f"__lw_g{i}") for i, c in enumerate([*group, part])), "__lw_base")
    key = [numbered[c] == base[f"__lw_g{i}"] for i, c in enumerate([*group, part])]
    return numbered.join(base, key, "left").withColumn(name, (F.col("__lw_at") + F.coalesce("__lw_base", F.lit(0))).cast("long")).select(*df.columns, name)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(up := root[root], root):
            root = up


class TextBuffer:
    """Words of many texts as arrays over one lower-cased UTF-8 buffer.

    A word is a run of ASCII letters and digits and of bytes over 0x7F; a kana or ideograph (UTF-8 lead bytes 0xE3 to
    0xE9), whose scripts don't put spaces between words, is a word by itself. h(start, end) hashes any stretches of the
    buffer in one step, from running sums of byte x B^place (mod 2^64).
    """

    _BASE = 0x9E3779B97F4A7C15 | 1
    _INV = pow(_BASE, -1, 1 << 64)
    _TABLE = np.zeros(256, bool)
    _TABLE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    _pow = np.ones(1, np.uint64)
    _inv = np.ones(1, np.uint64)

    def __init__(self, texts: list[str]):
        parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        raw = b" " + b" ".join(parts) + b"     "
        self.bytes = x = np.frombuffer(raw, np.uint8)
        self._grow(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self._pow[: len(x)], out=self.sums[1:])
        inside = self._TABLE[x]
        alone = (x >= 0xE3) & (x <= 0xE9)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | alone[1:]
        begins[3:] |= inside[3:] & alone[:-3]
        self.start = np.flatnonzero(begins)
        leaves = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.end = leaves[np.searchsorted(leaves, self.start, "right")] if len(self.start) else self.start
        self.end[:-1] = np.minimum(self.end[:-1], self.start[1:])
        ends = np.cumsum([0, *(len(p) + 1 for p in parts)])
        #: words of text i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, ends)
        self.first[0] = 0

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._pow) < n:
            n = max(n, 1 << 21)
            for name, base in (("_pow", cls._BASE), ("_inv", cls._INV)):
                p = np.ones(n, np.uint64)
                np.cumprod(np.full(n - 1, base, np.uint64), out=p[1:])
                setattr(cls, name, p)

    def h(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        v = (self.sums[end] - self.sums[start]) * self._inv[start]
        v = (v ^ np.uint64(salt * 0x2545F4914F6CDD1D % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
        v ^= v >> np.uint64(29)
        return v * np.uint64(0xC4CEB9FE1A85EC53)


def kept(operator: str) -> dict:
    """What the operator keeps in this worker from task to task, by key."""
    return _kept.setdefault(operator, {})


def begin_task(operator: str) -> None:
    """A worker serves one operator after the other: what others than this one keep in it goes, free memory goes back to the system."""
    others = [_kept.pop(k) for k in [*_kept] if k != operator]
    kept(operator)
    if others:
        others.clear()
        TextBuffer._pow = TextBuffer._inv = np.ones(1, np.uint64)
        gc.collect()
    _trim()


def _trim() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def release_driver(spark: SparkSession) -> None:
    """The driver's free memory goes back to the system, between jobs: Python's, the JVM's heap, and what the JVM's C library holds.

    The last is freed native memory that stays in the arenas of the JVM's hundreds of threads; only HotSpot on Linux can trim it.
    """
    TextBuffer._pow = TextBuffer._inv = np.ones(1, np.uint64)
    gc.collect()
    _trim()
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    try:
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # the last two, arguments and their types, stay null
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # its class is hidden
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # another JVM or system
        pass


def text_groups(texts: list[str], most_chars: int = 400_000):
    """(first, last) of runs of texts of at most so many characters; a longer text is a run by itself."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most_chars:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
