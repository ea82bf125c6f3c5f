"""What the corpus operators share: inputs, keys of rows and the shared stage folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the session names for checkpoints. A session that names none
    gets a temporary folder if it runs in one process, and an error if it has executors."""
    root, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not root and not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
    root = root or context._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder and continue from the written table: lineage is
    cut, a lost executor costs nothing, and several readers do not repeat the work upstream."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffles of a finished stage are not read again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound what a Python worker holds of the rows at a time: by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def text_key(text: str = "text") -> Column:
    """Tells apart rows that share an id: 64 bits of the text. Rows equal in id and text have
    equal results, so either may take the result of the other."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\0null")))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where a lambda reads it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
