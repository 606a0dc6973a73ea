"""What the corpus operators share: batches, folds, shared storage, bounded id filters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an Arrow batch handed to Python holds at most; texts can be long.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded in rows and bytes, so that a run of long texts fits into a worker."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. The cluster names it in spark.checkpoint.dir; a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, noted for clear()."""
    path = f"{shared_dir(spark).rstrip('/')}/monthloom/{name}-{uuid.uuid4().hex}"
    _scratch.add(path)
    return path


_scratch: set[str] = set()


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage and lets later steps read single columns."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """stored() for small intermediate tables; computes its rows once, where a checkpoint does so twice."""
    return stored(df, "cut", "lz4")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _scratch.discard(path)


def keep(path: str) -> None:
    """Leaves a folder out of what clear() and cleared() delete."""
    _scratch.discard(path)


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of stored tables that nothing will read again."""
    for df in tables:
        if df is not None:
            delete(df.sparkSession, df.scratch_path)


@contextmanager
def cleared(spark: SparkSession):
    """Deletes at its end what was stored within it; for steps whose result has been written by then."""
    before = set(_scratch)
    try:
        yield
    finally:
        for path in set(_scratch) - before:
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has stored; results that have not been read yet are lost."""
    for path in list(_scratch):
        delete(spark, path)


#: A join salts the keys with more rows than HOT_ROWS, the HOT_KEYS largest of them; any other key has under 1 / HOT_KEYS of the rows.
HOT_ROWS, HOT_KEYS = 256, 2000


def joined(rows: DataFrame, one: DataFrame, key: str, spread: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with `one` (a row for each key), where a key may hold any share of rows.

    A hot key's rows are dealt over salts by a hash of the columns `spread`, its row of `one` is repeated for each salt: 4, 16, 64, ...
    salts, for about HOT_ROWS rows or more each. The hot keys are a list in the plan, HOT_KEYS at most. counts (key, n)
    spares a pass over rows.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    hot = counts.select(F.col(key).alias("k"), "n").where(F.col("k").isNotNull() & (F.col("n") > HOT_ROWS)).orderBy(F.desc("n"), "k").limit(HOT_KEYS).collect()
    if not hot:
        return rows.join(one, key, how)
    classes: dict[int, list] = {}
    for r in hot:
        classes.setdefault(4 ** max(1, min(8, ((r.n // HOT_ROWS).bit_length() + 1) // 2)), []).append(r.k)
    salts = F.lit(1)
    for n, keys in sorted(classes.items()):
        salts = F.when(F.col(key).isin(*keys), n).otherwise(salts)
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce(salts, F.lit(1))).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))
    # a null key has no partner, so its salt is no matter
    return left.join(right, [key, "__salt"], how).drop("__salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Longest key that a Memo keeps; what is longer is rare and is computed each time.
KEPT_LENGTH = 64


class Memo(dict):
    """A dict that computes what it lacks, and starts anew when it holds too much; bounded in bytes, as long keys are not kept."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


#: A membership filter has at most so many bits (32 MB), whatever the number of ids; beyond that it only lets more rows through.
FILTER_BITS = 1 << 28
#: Bits of a page. All bits of a key lie on one page, so that a page is made by one task and the driver joins pages end to end.
PAGE = 1 << 19


class KeyFilter:
    """Bloom filter of 64-bit keys with a fixed largest size. No false negatives, so a join may follow it but nothing is lost."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @staticmethod
    def positions(keys: np.ndarray, size: int) -> list[np.ndarray]:
        k = keys.astype(np.uint64)
        width = min(size, PAGE)
        page = (k ^ k >> np.uint64(9) ^ k >> np.uint64(23) ^ k >> np.uint64(41)) & np.uint64(size // width - 1)
        h = mix64(k)
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return [page * np.uint64(width) + ((low + np.uint64(i) * high) & np.uint64(width - 1)) for i in range(4)]

    def test(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for p in self.positions(keys, self.size):
            found &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    @classmethod
    def of(cls, keys: DataFrame) -> "KeyFilter":
        """Built by the executors from a frame with one long column, dealt by page; the driver gets each page once."""
        name = keys.columns[0]
        n = keys.count()
        size = 1 << 13
        while size < min(16 * n, FILTER_BITS):
            size <<= 1
        width = min(size, PAGE)

        def pages(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for p in cls.positions(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), size):
                    at, bit = (p // np.uint64(width)).astype(np.int64), (p % np.uint64(width)).astype(np.int64)
                    for page in np.unique(at).tolist():
                        held.setdefault(page, np.zeros(width, bool))[bit[at == page]] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["page", "bits"])

        k = F.col(name)
        page = k.bitwiseXOR(F.shiftrightunsigned(k, 9)).bitwiseXOR(F.shiftrightunsigned(k, 23)).bitwiseXOR(F.shiftrightunsigned(k, 41)).bitwiseAND(F.lit(size // width - 1))
        bits = np.zeros(size // 8, dtype=np.uint8)
        dealt = keys.where(k.isNotNull()).select(name, page.alias("page")).repartition(max(1, size // width), "page").select(name)
        for row in map_batches(dealt, pages, "page int, bits binary").toLocalIterator():
            part = np.frombuffer(row.bits, dtype=np.uint8)
            bits[row.page * len(part) : (row.page + 1) * len(part)] |= part
        return cls(bits, size)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)
