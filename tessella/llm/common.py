"""What the operators of this subpackage share: table reads, durable lineage cuts, row splits and text chunking."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.durable import checkpoint, remove, shared_folder

__all__ = ["CHUNK_CHARS", "Bucketed", "Stored", "bind", "checkpoint", "free_name", "groups", "remainder", "share", "table"]

#: Characters of the text that one numpy step of a Python worker handles at most, unless a single text is longer.
CHUNK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def share(fraction: Column | float, *cols: Column) -> Column:
    """True for about that fraction of the rows, decided by a hash of the columns, so the same rows at each run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < (F.lit(fraction) if isinstance(fraction, float) else fraction) * float(1 << 30)


def groups(lengths: Iterable[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold at most ``limit`` characters together, or one text each."""
    lo = total = i = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n + 1
    if total:
        yield lo, i + 1


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it occurs in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Stored:
    """Rows written to the shared folder: ``rows`` reads them, ``drop`` removes them once nothing reads them any more."""

    def __init__(self, df: DataFrame):
        self.spark, self.folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.folder)
        self.rows = self.spark.read.schema(df.schema).parquet(self.folder)

    def drop(self) -> None:
        remove(self.spark, self.folder)


class Bucketed(Stored):
    """The same, dealt by a column into so many parts: joins by it on as many leave the rows where they are."""

    def __init__(self, df: DataFrame, column: str, parts: int):
        self.spark, self.folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
        self.name = f"spark_catalog.default.{self.folder.rsplit('/', 1)[1].replace('-', '_')}"
        df.write.bucketBy(parts, column).option("compression", "zstd").option("path", self.folder).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        super().drop()
