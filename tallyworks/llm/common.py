"""Shared pieces of the corpus operators: scratch tables, Arrow mapping, ASCII words.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``: exactly what
``bytes.split()`` gives, so texts travel to Python as UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch: keeps a batch of long texts within a few tens of MB.
BATCH_ROWS = 512


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tallyworks-scratch")
    return f"{base.rstrip('/')}/tables"


#: Paths of the tables that ``materialize`` wrote and nothing has deleted yet, oldest first.
_OPEN: list[str] = []


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    _OPEN.append(path)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _OPEN:
        _OPEN.remove(path)


def drop_scratch(df: DataFrame | None) -> None:
    """Deletes a table of ``materialize`` that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, written; the tables it left on the way, which only its rows needed, are deleted."""
    before = set(_OPEN)
    out = materialize(make())
    for path in [p for p in _OPEN if p not in before and p != out._scratch_path]:
        _delete(out.sparkSession, path)
    return out


@functools.lru_cache(maxsize=1)
def _malloc_trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def trim() -> None:
    """Gives memory that freed arrays left behind back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts.

    Spark reads the size of a batch when a plan runs, not when it is made, so the session keeps the lower limit; a lower one of its own stays.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: StructType | str) -> DataFrame:
    """Maps each batch, as a dict of Python lists, to a dict of lists of any length."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return map_batches(df, run, struct)


def map_group_streams(df: DataFrame, keys: list[str], fn: Callable[[tuple, Iterator[pa.Table]], Iterator[pa.Table]], schema: StructType | str, order: Sequence[Column] = (), join: Callable[[Iterator[pa.Table]], Iterator[pa.Table]] = iter) -> DataFrame:
    """``fn`` on the rows of each key, one key after another in a sorted partition; a key's rows come piece by piece, in ``order``. ``join`` gets what a partition's keys give, one after another."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                rows = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
                cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
                for a, b in itertools.pairwise(cuts):
                    yield rows[a], table.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in join(out for key, pieces in itertools.groupby(cut(batches), key=lambda p: p[0]) for out in fn(key, (t for _, t in pieces))):
            yield from out.cast(arrow).to_batches()

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys, *order), run, struct)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: StructType | str, join: Callable[[Iterator[pa.Table]], Iterator[pa.Table]] = iter) -> DataFrame:
    """``fn`` on the rows of each key, one after another in a sorted partition: cheap for many small groups."""

    def run(_: tuple, pieces: Iterator[pa.Table]) -> Iterator[pa.Table]:
        if (out := fn(pa.concat_tables(pieces))) is not None:
            yield out

    return map_group_streams(df, keys, run, schema, join=join)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and all others in one column ``rest``, where no name of theirs can meet one of an operator."""
    rest = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in own]
    return df.select(*own, (F.struct(*rest) if rest else F.lit(True)).alias("rest"))


def unpacked(df: DataFrame, columns: list[str], *own: str) -> list[Column]:
    """The columns of what ``packed`` was made from, in their order."""
    return [F.col(c) if c in own else F.col("rest").getField(c).alias(c) for c in columns]


def utf8(text: Column | str = "text") -> Column:
    """The text as UTF-8 bytes; null as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit(b""))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def default_parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
