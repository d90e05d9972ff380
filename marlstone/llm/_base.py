"""What the corpus operators share: session settings, the word rule, and packed exchange.

Packed exchange: operators that must compare every document with every other do not shuffle a row
for each word.  A mapper packs the documents of a few megabytes into one *chunk* row (a compressed
blob), and sends each *bucket* of a hash space one small blob for each chunk.  A key that a third of
all documents hold therefore reaches its bucket once for each chunk, not once for each document, and
the answer comes back as a bitmap or id list in the order of the request.  The number of buckets
follows ``spark.sql.shuffle.partitions``, the setting that a cluster sizes to its input.
"""

from __future__ import annotations

import ctypes
import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import shared_root, spread

#: Words of the contracts: runs of anything but ASCII white space.  bytes.split() follows the same rule.
SPACE = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 4 << 20
ARROW_ROWS = 256


def tune(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch, since one text may be as large as a thousand others."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(tune(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the place that all executors share; a local one only in a session of one machine that names none."""
    return f"{shared_root(spark)}/marlstone-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and from which nothing is read any more, not even by a task that is run again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers each that are broadcast at most.
HELD = 1_000_000


def held(df: DataFrame, limit: int = HELD) -> DataFrame:
    """A written table of a few numbers a row, for broadcast if it has ``limit`` rows at most; beyond, as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def buckets(spark: SparkSession, each: int = 2) -> int:
    return max(8, each * int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(value: object, level: int = 3) -> bytes:
    return zstandard.compress(pickle.dumps(value, 5), level)


def unpack(blob: bytes) -> object:
    return pickle.loads(zstandard.decompress(blob))


def planes(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as byte planes, which compress better when packed: most high bytes are 0."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as byte planes of their differences, which compress."""
    d = np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(d.T).tobytes(), 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def trim() -> None:
    """Give freed memory back: workers outlive their tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


CHUNK = pa.schema([("chunk", pa.string()), ("payload", pa.binary())])


def chunked(make: Callable[[list, list], object], limit: int = CHUNK_BYTES, level: int = 3) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper of (id, text) batches to chunk rows; ``make(ids, texts)`` gives what a chunk holds.

    The chunk's name has the task, its number in the task and a digest, so that a recomputed task
    that saw other rows cannot be mistaken for the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            blob = pack(make(ids, texts), level)
            name = f"{part}-{n}-{hashlib.blake2b(blob, digest_size=8).hexdigest()}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blob], pa.binary())], schema=CHUNK)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                held += 200 + len(text or "")
                if held >= limit:
                    yield row()
                    n, ids, texts, held = n + 1, [], [], 0
        if ids:
            yield row()
        ids, texts = [], []
        trim()

    return run


def flat(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()
