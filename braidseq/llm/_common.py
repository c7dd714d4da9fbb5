"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="braidseq-"))
    return _own_dir[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append(path)
    atexit.register(drop_path, spark, path)
    return spark.read.schema(schema).parquet(path)


def settle(made, spark: SparkSession, name: str) -> tuple[DataFrame, str]:
    """materialise(made()) and its path, once all that was written on the way to it is dropped."""
    mark = len(_written)
    out = materialise(made(), name)
    for path in _written[mark:-1]:
        drop_path(spark, path)
    del _written[mark:-1]
    return out, _written[-1]


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that materialise() wrote; silent when the session is gone."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def once(value: Column, use) -> Column:
    """use(value) with value evaluated once, even where use has lambdas of its own that mention it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash128(col: Column, name: str = "h") -> list[Column]:
    """Two independent 64-bit hashes of a column, as name1 and name2."""
    return [F.xxhash64(col).alias(f"{name}1"), F.xxhash64(F.lit(7919), col).alias(f"{name}2")]


# --- numpy kernels over the UTF-8 bytes of an Arrow string column -------------------------------

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
KEPT_POWERS = 1 << 20  # those for longer texts are made anew, so that a worker does not hold on to them
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n or more of each."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0], have = 1, 1
            while have < size:
                p[have : 2 * have] = p[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            both.append(p)
        if size > KEPT_POWERS:
            return both[0], both[1]
        _powers[0] = (both[0], both[1])
    return _powers[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of powers spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of raw[start:end]."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


def spaces(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the words of all texts of a batch."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~spaces(raw)
    first, last = word.copy(), word.copy()
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    first[1:] &= ~word[:-1]
    first[cut] = word[cut]
    last[:-1] &= ~word[1:]
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ngram_hashes(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first word) of the n-word windows that stay inside one document."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        g *= np.uint64(BASE)
        g += words[j : len(words) - n + 1 + j]
    inside = np.flatnonzero(docs[: len(g)] == docs[n - 1 :])
    return mix64(g[inside]), inside


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs again elsewhere in keys."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


#: What operators keep in a Python worker between tasks, by operator.
worker_memory: dict[str, dict] = {}


def keep_only(operator: str) -> None:
    """Called as an operator's task begins: a reused worker lets go of what other operators have kept."""
    for name, kept in worker_memory.items():
        if name != operator:
            kept.clear()
    give_back()


def give_back() -> None:
    """Have the C library return freed memory to the system, where it can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def small_batches(batches, limit: int = 1_000_000):
    """Cut Arrow batches with a `text` column so that one slice holds about limit bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.diff(utf8(batch.column("text"))[1]))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
