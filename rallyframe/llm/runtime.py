"""What the operators of this subpackage share: shared storage, code shipping, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..storage import clear, remove, shared_dir, stored

__all__ = ["clear", "columns", "cut", "env_cpu_single", "free_name", "map_batches", "quoted", "remove", "schema_of", "shared_dir", "ship", "stored", "table"]

#: Application ids whose executors already have the package.
_shipped: set[str] = set()


#: Bytes of Arrow data that a function is given at once, where more than one row has them.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or that with as many underscores behind as make it new to the table."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name that stands for itself, whatever marks are in it."""
    return "`" + name.replace("`", "``") + "`"


def columns(names: list[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def schema_of(df: DataFrame, names: list[str], **more: DataType) -> StructType:
    """The table's fields of these names, as they are, and further ones."""
    kinds = {f.name: f for f in df.schema.fields}
    return StructType([*[StructField(n, kinds[n].dataType) for n in names], *[StructField(n, kind) for n, kind in more.items()]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(batch: pa.RecordBatch, rows: int, n_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and, but for single rows, `n_bytes` bytes."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        if part.nbytes > n_bytes and part.num_rows > 1:
            yield from cut(part, -(-part.num_rows // 2), n_bytes)
        else:
            yield part


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = 512) -> DataFrame:
    """mapInArrow with batches of at most `rows` rows and BATCH_BYTES, so that memory follows a few documents and not the partition."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch.rename_columns(names), rows):
                yield from fn(part)

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = StructType([StructField(f"o{i}", f.dataType) for i, f in enumerate(kind.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(plain.names)

    # Spark finds the columns of such a call by name, which marks in a name would break.
    return df.toDF(*[f"i{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*kind.names)


def env_cpu_single() -> None:
    """Native libraries must not start threads of their own inside a task slot."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
