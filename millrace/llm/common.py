"""What the corpus operators share: shared folders, label folds, bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import lean, release, slices  # noqa: F401


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one stands in for it only where all run in this machine's local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Shuffle files of an execution go when it ends, so disk doesn't add up over steps.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, deleted by freed() or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.parquet(path)
    out.written_at = path
    return out


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def freed(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more."""
    for df in tables:
        files, place = _place(df.sparkSession, df.written_at)
        files.delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, with lean() in force for what reads it."""
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: So many ids are broadcast at most (8 MB); more are joined by a shuffle.
MOST_IDS = 1_000_000


def matching(rows: DataFrame, ids: DataFrame, how: str, column: str = "doc_id") -> DataFrame:
    """Semi or anti join of wide rows with a table of ids, without shuffling the rows where the ids are few."""
    ids = written(ids, "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, column, how)


def unused(name: str, columns: list[str]) -> str:
    """A column name that isn't among these, in any case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column, modulus: int):
    """crc32 of the id's text, modulo."""
    return F.crc32(column.cast("string")) % modulus


class Bounded(dict):
    """A memo of `make` that stops growing at `most` entries, so a worker's memory doesn't follow its input."""

    def __init__(self, make, most: int = 100_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


def tidy(run):
    """The function of a mapInArrow, after which the worker gives back what it has freed: workers are used again, and hold what their largest task held otherwise."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
