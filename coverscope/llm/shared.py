"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and \x09 to \x0D.
BLANK = r"[ \t-\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once although body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs on one machine (tests), a new temporary one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc._jsc.sc().getCheckpointDir().get()
    if not where and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="coverscope-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read again: later steps need nothing of its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def schema_of(df: DataFrame) -> str:
    """The columns of df as a schema text."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def chunks(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about size bytes of text, of one row at least."""
    ends = np.cumsum([0, *(n or 0 for n in pc.binary_length(batch[text]).to_pylist())])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
