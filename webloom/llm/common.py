"""Helpers shared by the training-data operators: reading, written intermediates, distributed ranks.

Intermediates go to the folder named by ``spark.checkpoint.dir`` (all executors share it), as Parquet, so that a lost
executor costs a re-read and never a re-run of the stages before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.sources.shared import importable, shared_folder

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at the same six characters.
SPACES = " \t\n\x0b\x0c\r"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/webloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._webloom_path = path
    return back


#: Column of the ids that :func:`with_row_ids` gives.
ROW_ID = "__webloom_row"


def with_row_ids(df: DataFrame, tag: str) -> DataFrame:
    """``df`` with an id of each row, written so that every later read gives a row the same id."""
    return written(df.withColumn(ROW_ID, F.monotonically_increasing_id()), tag)


def released(*frames: DataFrame) -> None:
    """Delete intermediates made by :func:`written` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_webloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bytes and rows of a batch that Python works on at once: bounds a worker's memory.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 2048


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, whole: bool = False) -> DataFrame:
    """Apply ``fn`` (record batch -> columns by name, or None for no rows) to slices of every Arrow batch.

    ``whole``: to whole batches, for functions that return a few rows a batch.
    """
    importable(df.sparkSession)
    target = pa.schema(_arrow_fields(df.sparkSession.createDataFrame([], schema)))
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            step = n if whole else max(1, min(SLICE_ROWS, SLICE_BYTES * n // max(1, batch.nbytes)))
            for at in range(0, n, step or 1):
                out = fn(batch.slice(at, step))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([_array(out[c], target.field(c).type) for c in names], schema=target)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _arrow_fields(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))


def n_buckets(rows: int, per_bucket: int = 50_000, least: int = 64) -> int:
    """Buckets for a two-level rank so that none holds much more than ``per_bucket`` rows."""
    return max(least, -(-rows // per_bucket))


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within ``group``, without ever gathering a group in one task.

    Rows are dealt into hash buckets of the ``order`` columns (``out`` seeds the hash, so that ranks built on ranks stay
    even); each bucket is numbered by itself and shifted by the
    rows of the buckets before it. The order is therefore by (bucket, order columns): fixed, though not sorted.
    """
    d = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(out)), F.lit(buckets)).cast("int"))
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return d.join(offsets, keys).withColumn(out, (F.col("_off") + inside - 1).cast("long")).drop("_bucket", "_off")


#: Bits of the filter of :func:`likely`: two mebibytes, whatever the number of keys.
FILTER_BITS = 1 << 24


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is one of ``keys``, and a few others: a filter in front of a join, so that wide rows that match
    nothing never travel. It is a bitmap of hashes of fixed size, which is broadcast; with very many keys it lets more pass,
    and the join behind it decides.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bits = keys.select(bit.alias("_bit")).distinct().withColumn("_block", F.bitmap_bucket_number("_bit")).repartition("_block")
    bitmap = bits.groupBy("_block").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    found = rows.withColumns({"_block": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)}).join(F.broadcast(bitmap), "_block")
    byte = "CAST(conv(hex(substring(_bits, CAST(_at DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    return found.filter(F.expr(f"{byte} & shiftleft(1, CAST(_at % 8 AS INT)) > 0")).select(*(F.col(f"`{c}`") for c in rows.columns))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0. JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_digest() -> Column:
    """The md5 of a text's bytes; a null text's is that of an empty one."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def core(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names never meet the operator's own."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))
