"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a function of map_batches gets at once; a row of more bytes comes alone.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Bytes that one memory of a Python worker may take, about.
MEMORY_BYTES = 16 << 20
TEST_CHECKPOINTS = "/tmp/dossier-checkpoints"
#: What each open scratch() has to delete.
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder; one of our own under a local master alone."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or TEST_CHECKPOINTS


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back with its schema. Within scratch() it is deleted at the end, unless kept."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/dossier-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    if _open and not keep:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, what operators have written on their way within. Results are lazy: write them before the end."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Memory(dict):
    """What a task or worker remembers: it starts anew when asked for room after more than `most` bytes have been noted."""

    def __init__(self, most: int = MEMORY_BYTES) -> None:
        super().__init__()
        self.most, self.used = most, 0

    def room(self) -> None:
        if self.used > self.most:
            self.clear()
            self.used = 0

    def note(self, key, value, size: int) -> None:
        """size: of key and value, without what Python and the dictionary take for any pair."""
        self.used += size + 160
        self[key] = value


#: What a Python worker keeps from task to task.
_held: dict = {}
_asked: set = set()


def held(key, make: Callable):
    """make(), kept by this Python worker for its next tasks, until one begins that does not ask for it."""
    _asked.add(key)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def begun(make: Callable):
    """make() at the start of a task; what earlier tasks of this worker kept and this one does not ask for goes back to the system."""
    _asked.clear()
    each = make()
    if gone := set(_held) - _asked:
        for key in gone:
            del _held[key]
    tidy()
    return each


def tidy() -> None:
    """Gives freed memory back to the system, which a reused worker would hold otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most BATCH_ROWS and, but for single rows, BATCH_BYTES."""
    if batch.num_rows > 1 and (batch.num_rows > BATCH_ROWS or batch.nbytes > BATCH_BYTES):
        half = batch.num_rows // 2
        yield from sliced(batch.slice(0, half))
        yield from sliced(batch.slice(half))
    else:
        yield batch


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session hands Arrow batches of the above size to Python, so that neither side holds more at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict[str, list]]]], schema: str, tail: bool = False) -> DataFrame:
    """mapInArrow whose function is made once a task: it takes a part of a batch and yields columns by name; with tail, None comes after the last one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begun(make)
        for batch in chain(chain.from_iterable(map(sliced, batches)), [None] * tail):
            for columns in each(batch):
                yield pa.RecordBatch.from_arrays([_as(columns[f.name], f.type) for f in arrow], schema=arrow)
        del each
        tidy()

    return bounded(df).mapInArrow(run, kind)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of df, all columns, for which the function, made once a task, says true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begun(make)
        for batch in chain.from_iterable(map(sliced, batches)):
            yield batch.filter(pa.array(each(batch), pa.bool_()))
        del each
        tidy()

    return bounded(df).mapInArrow(run, df.schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array | pa.ChunkedArray) else pa.array(values, kind)


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


__all__ = ["BATCH_ROWS", "F", "Memory", "held", "id_type", "keep_rows", "map_batches", "raw_texts", "scratch", "shared_folder", "sliced", "small_enough", "texts_of", "written"]
