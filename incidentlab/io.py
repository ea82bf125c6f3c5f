"""Reading declared schemas, stacking yearly files, writing named tables and exports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """Read Parquet or CSV, told apart by the file ending. CSV needs a declared schema:
    inferred types differ between yearly files."""
    first = path if isinstance(path, str) else path[0]
    if first.rstrip("/").lower().endswith(".csv"):
        if schema is None:
            raise ValueError("CSV input needs a declared schema")
        return spark.read.csv(path, schema=schema, header=True)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def union_sources(
    frames: Sequence[DataFrame], casts: Mapping[str, str] | None = None
) -> DataFrame:
    """Stack frames by column name. Columns missing from a frame become NULL; columns in
    ``casts`` are brought to one type first, unparseable text becoming NULL."""
    casts = casts or {}

    def cast(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: df[c].try_cast(t) for c, t in casts.items() if c in df.columns}
        )

    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [cast(f) for f in frames]
    )


def shared_folder(spark: SparkSession) -> str:
    """New folder below the shared location for checkpoints: the setting
    ``spark.checkpoint.dir``, or what ``SparkContext.setCheckpointDir`` was given. A session
    that names neither gets an error: files on one machine's disk are lost to the others."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = named.get() if named.isDefined() else None
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(root, f"incidentlab-{uuid.uuid4().hex}")


def stage(df: DataFrame) -> DataFrame:
    """Write a frame once and continue from the written table.

    For a frame that several later branches read: each branch would otherwise repeat all
    of its upstream joins, and the plan would grow with every stage. The table lies in the
    shared folder, so it outlives any executor. The caller's cluster clears that folder."""
    path = shared_folder(df.sparkSession) + "/stage.parquet"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tables(
    tables: Mapping[str, DataFrame], directory: str, partition_by: Mapping[str, str] | None = None
) -> dict[str, str]:
    """Write each named frame to its own Parquet directory and return the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = os.path.join(directory, name + ".parquet")
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(paths[name])
    return paths


def export_view(
    df: DataFrame,
    columns: Mapping[str, Column],
    order: Sequence[Column] = (),
    out: str | None = None,
) -> DataFrame:
    """Analyst table: chosen columns under display names, sorted, optionally as CSV.

    End ``order`` with a unique column when the leading one can be heavily repeated: the
    sort is by range and only a unique key lets it split a repeated value."""
    view = (df.orderBy(*order) if order else df).select(
        *[c.alias(name) for name, c in columns.items()]
    )
    if out is not None:
        view.write.mode("overwrite").option("header", True).csv(out)
    return view
