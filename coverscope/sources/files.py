"""Reading and writing files: CSV, CSV inside archives, pages of feature JSON, GeoJSON, manifests."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RING = "array<array<array<double>>>"


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV table with a header, names as they are; blanks are null, rows that don't fit are an error."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, nullValue="", mode="FAILFAST")


def write_table(df: DataFrame, path: str, fmt: str = "csv", gzip: bool = False) -> None:
    """All or nothing: an existing path is an error, and files appear with the job's commit."""
    w = df.write.mode("errorifexists")
    if gzip:
        w = w.option("compression", "gzip")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the archives of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")


def read_zip_csv(files: DataFrame, schema: str, include: str, exclude: str | None = None) -> DataFrame:
    """path, member and columns of one CSV member of each archive: that with `include` in its name, `exclude` not, and the shortest name (then the first). schema: DDL of the columns.

    An archive is opened by the task that has it and read 10,000 records a time, with line
    breaks inside quotes kept; its records become columns in Spark. Blank lines are left out."""

    def line(record: list[str]) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(record)
        return out.getvalue()

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".csv") and include in n.lower() and not (exclude and exclude in n.lower())]
                    if not names:
                        continue
                    name = min(names, key=lambda n: (len(n), n))
                    with z.open(name) as f:
                        records = csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
                        next(records, None)
                        while part := list(islice(records, 10_000)):
                            yield pd.DataFrame({"path": path, "member": name, "line": [line(r) for r in part if r]})

    text = files.mapInPandas(lines, "path string, member string, line string")
    return text.select("path", "member", F.from_csv("line", schema, {"escape": '"', "multiLine": "true"}).alias("r")).select("path", "member", "r.*")


def read_feature_pages(spark: SparkSession, paths: str | Sequence[str], fields: dict[str, str], geometry: bool = False) -> DataFrame:
    """The attributes of all features of JSON pages, absent ones as null; with point geometry also x and y. fields: name to type."""
    attributes = ", ".join(f"`{k}`: {v}" for k, v in fields.items())
    schema = f"features array<struct<attributes: struct<{attributes}>, geometry: struct<x: double, y: double>>>"
    rows = spark.read.schema(schema).json(paths, multiLine=True).select(F.input_file_name().alias("page"), F.explode("features").alias("f"))
    return rows.select("page", "f.attributes.*", *(["f.geometry.x", "f.geometry.y"] if geometry else []))


def audit_pages(rows: DataFrame, page: str, key: str, page_size: int) -> DataFrame:
    """page, n, expected and passed: all pages but the last are full. One row with page null tells whether keys are unique."""
    per = rows.groupBy(F.col(page).alias("page")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("_t"), F.count_distinct(key).alias("_k"))
    pages = per.crossJoin(F.broadcast(total)).select("page", "n", F.least(F.lit(page_size), F.col("_t") - F.col("page") * page_size).cast("bigint").alias("expected"))
    keys = total.select(F.lit(None).cast("bigint").alias("page"), F.col("_k").alias("n"), F.col("_t").alias("expected"))
    return pages.unionByName(keys).withColumn("passed", F.col("n") == F.col("expected"))


def read_geojson(text: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """The properties and the rings (arrays of x, y: all rings of all parts, holes too) of each Polygon and MultiPolygon in rows of GeoJSON text; other features are an error."""
    properties = ", ".join(f"`{k}`: {v}" for k, v in fields.items())
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    f = text.select(F.explode(F.from_json(column, schema)["features"]).alias("f")).select("f.*")
    kind, raw = F.col("geometry.type"), F.col("geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(raw, RING)).when(kind == "MultiPolygon", F.flatten(F.from_json(raw, f"array<{RING}>"))).otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("no geometry")))).cast(RING))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return f.select("properties.*", F.transform(rings, lambda r: F.transform(r, point)).alias("rings"))


#: Larger files are hashed piece by piece: a value of Spark holds at most 2 GB.
WHOLE_BYTES = 256 << 20


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, bytes and sha256 of files, each read in pieces of 8 MB."""
    for pdf in batches:
        digests = []
        for path in pdf["path"]:
            local = re.match(r"file:/+(?=[^/])", path)
            store, at = (pafs.LocalFileSystem(), "/" + path[local.end() :]) if local else pafs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with store.open_input_stream(at) as f:
                while piece := f.read(8 << 20):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pdf.assign(sha256=digests)


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """path, bytes and sha256 of the files of a folder, whatever their size. A file above whole_bytes is a stream of one task.

    Empty files have no row: Spark's reader leaves them out. A listed empty file is MISSING to verify_manifest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    small = files.where(F.col("length") <= whole_bytes).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select("path", F.col("length").alias("bytes")).repartition("path")
    return small.unionByName(large.mapInPandas(_streamed, "path string, bytes bigint, sha256 string"))


def verify_manifest(expected: DataFrame, found: DataFrame, roles: Sequence[str] | None = None, immutable: bool = False) -> DataFrame:
    """path and status: OK, MISSING, UNLISTED, CHANGED, MUTABLE or DUPLICATE (listed more than once).

    roles: only files listed with one of these roles are judged; files listed with another role aren't unlisted.
    immutable: a file must be marked in the column of that name by yes or true (in any case); without the
    column all are MUTABLE. Hashes are compared in lower case, without blanks around them. A listed null hash is
    CHANGED, a null path is MISSING. An empty manifest leaves every file UNLISTED."""
    marked = F.upper(F.trim(F.col("immutable").cast("string"))).isin("YES", "TRUE") if "immutable" in expected.columns else F.lit(False)
    chosen = F.coalesce(F.col("role").cast("string").isin(list(roles)), F.lit(False)) if roles is not None else F.lit(True)
    listed = expected.groupBy("path").agg(
        F.min(F.lower(F.trim("sha256"))).alias("_e"), F.count("*").alias("_n"), F.every(F.coalesce(marked, F.lit(False))).alias("_fixed"), F.some(chosen).alias("_chosen")
    )
    both = listed.join(found.select("path", F.lower("sha256").alias("_f")), "path", "full").where(F.coalesce("_chosen", F.lit(True)))
    status = (
        F.when(F.col("_n") > 1, "DUPLICATE")
        .when(F.col("_f").isNull(), "MISSING")
        .when(F.col("_n").isNull(), "UNLISTED")
        .when(~F.col("_e").eqNullSafe(F.col("_f")), "CHANGED")
        .when(F.lit(immutable) & ~F.col("_fixed"), "MUTABLE")
        .otherwise("OK")
    )
    return both.select("path", status.alias("status"))
