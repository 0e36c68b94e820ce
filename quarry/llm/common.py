"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.sources.shared import scratch, shared_dir  # noqa: F401

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this library even if their working folder is another one."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *parts])


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so a lost executor costs no rerun."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def column_or_null(df: DataFrame, name: str, kind: str) -> F.Column:
    """A column cast to kind."""
    return F.col(f"`{name}`").cast(kind)


#: Rows, and about so many bytes, of a batch that are Python objects at one time.
FEW_ROWS, FEW_BYTES = 1000, 4 << 20


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that are small enough to become Python objects."""
    for b in batches:
        step = max(1, min(FEW_ROWS, b.num_rows * FEW_BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def map_columns(df: DataFrame, schema: str | T.StructType, fn: Callable[..., Iterator[tuple]]) -> DataFrame:
    """mapInArrow with plain lists: fn(batches of column lists) yields row lists to be written.

    fn gets an iterator over batches, each a tuple of Python lists (one per column of df),
    and yields lists of row tuples in the order of schema.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = (tuple(c.to_pylist() for c in b.columns) for b in few_rows(batches))
        for rows in fn(lists):
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def each_row(df: DataFrame, schema: str | T.StructType, fn: Callable[..., tuple]) -> DataFrame:
    """One output row for each input row: fn(*values) -> tuple."""

    def run(batches):
        for cols in batches:
            yield [fn(*x) for x in zip(*cols, strict=True)]

    return map_columns(df, schema, run)


def map_groups(df: DataFrame, keys: list[str], schema: str | T.StructType, fn: Callable[..., list[tuple]]) -> DataFrame:
    """fn(*columns as lists) -> rows, for each group of the keys, which must be of bounded size. keys come first in df."""
    rows = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[tuple]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for cols in batches:
            out = []
            for row in zip(*cols, strict=True):
                if held and row[: len(keys)] != held[0][: len(keys)]:
                    out += fn(*map(list, zip(*held, strict=True)))
                    held = []
                held.append(row)
            yield out
        if held:
            yield fn(*map(list, zip(*held, strict=True)))

    return map_columns(rows, schema, run)


def filter_rows(df: DataFrame, id_col: str, text_col: str, make_test: Callable[[], Callable[[int | None, str | None], bool]]) -> DataFrame:
    """The rows of df for which the test made once in each task is true, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make_test()
        for b in few_rows(batches):
            ids, texts = b.column(b.schema.get_field_index(id_col)).to_pylist(), b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([bool(test(i, t)) for i, t in zip(ids, texts, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
