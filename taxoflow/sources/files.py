"""Files in other formats than Parquet, in and out, with explicit schemas."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, gz_parts: int | None = None, infer: bool = False) -> DataFrame:
    """CSV with header, quoted line breaks and doubled quotes; a byte-order mark before the first name is dropped.

    Without a schema all columns are text, or of the types that a pass over the file finds (``infer``). Compressed files cannot be split: ``gz_parts`` spreads their rows.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", infer)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    first = df.columns[0] if df.columns else None
    if first is not None and first.startswith("\ufeff"):
        df = df.withColumnRenamed(first, first.removeprefix("\ufeff"))
    return df.repartition(gz_parts) if gz_parts else df


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``length``, ``sha256``) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def new_rows(landed: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key has not landed yet: a resumable collection."""
    return incoming.join(landed.select(key).distinct(), key, "left_anti")


def write_csv(df: DataFrame, path: str, compression: str | None = None, fixed: dict[str, int] | None = None) -> None:
    """CSV with header; columns of ``fixed`` get that many decimals."""
    columns = [F.format_string(f"%.{fixed[c]}f", F.col(c)).alias(c) if fixed and c in fixed else F.col(c) for c in df.columns]
    writer = df.select(*columns).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    df.write.json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One file that holds the rows as one JSON array; they stream through one task, which holds none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = []
            for row in batch.column("value").to_pylist():
                lines.append(("[" if first else ",") + row)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], names=["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).mapInArrow(run, "value string").write.text(path)


def npz_archives(df: DataFrame) -> DataFrame:
    """(``content``, ``sha256``): an archive of the arrays ``ids`` and ``vectors`` for every batch of rows, without
    timestamps, so that equal rows in equal order give equal bytes. Vectors of one length are expected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, x in (("ids", np.array(batch.column("ids").to_pylist(), dtype=str)), ("vectors", np.array(batch.column("vectors").to_pylist(), dtype=np.float32))):
                        one = io.BytesIO()
                        np.save(one, x, allow_pickle=False)
                        z.writestr(zipfile.ZipInfo(f"{name}.npy"), one.getvalue(), zipfile.ZIP_DEFLATED)
                yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], names=["content"])

    return df.select("ids", "vectors").mapInArrow(run, "content binary").withColumn("sha256", F.sha2("content", 256))


def vectors_of(archives: DataFrame) -> DataFrame:
    """(``ids``, ``vectors``) of the archives in column ``content``, opened in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as f:
                    ids, x = f["ids"].astype(str), f["vectors"].astype(np.float32)
                for at in range(0, len(ids), 10_000):
                    part = x[at : at + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 10_000].tolist(), pa.string()), lists], names=["ids", "vectors"])

    return archives.select("content").mapInArrow(run, "ids string, vectors array<float>")


def vectors_from_npz(spark: SparkSession, path: str) -> DataFrame:
    """(``ids``, ``vectors``) of archive files with these two arrays; each file is read by a task."""
    return vectors_of(spark.read.format("binaryFile").load(path))
