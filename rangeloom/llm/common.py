"""Shared plumbing of the training-text operators.

Only this module touches the shared scratch folder.  Everything written there is Parquet, so a lost
executor costs a re-read and never a recomputation of the lineage behind it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Whether Spark removes the files of a query's shuffles when the query ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows handed to a text function at once; whole texts, so memory is this many texts.
ROWS_AT_ONCE = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _local_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


@lru_cache(1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="rangeloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the JVM is already gone: nothing is left to ask
        return


class Scratch:
    """Tables written to the shared folder, which cut lineage.

    Results are read from them, so they stay till the process ends; clear() removes them earlier, once
    what was made of them has been written elsewhere.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark).rstrip('/')}/rangeloom-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_remove_at_exit, spark, self.root)

    def write(self, df: DataFrame, free: bool = False) -> DataFrame:
        """df written and read again; with free the files of its shuffles go at once, not when the driver collects garbage."""
        self.n += 1
        self.last = f"{self.root}/{self.n}"
        old = self.spark.conf.get(FREE, None)
        if free:
            self.spark.conf.set(FREE, "true")
        try:
            df.write.parquet(self.last)
        finally:
            if free and old is None:
                self.spark.conf.unset(FREE)
            elif free:
                self.spark.conf.set(FREE, old)
        return self.spark.read.schema(df.schema).parquet(self.last)

    def drop(self, path: str) -> None:
        _remove(self.spark, path)

    def clear(self) -> None:
        _remove(self.spark, self.root)


def free_name(taken, stem: str) -> str:
    """A column name that none of those taken has, in any case."""
    low = {c.lower() for c in taken}
    name = f"__{stem}"
    while name.lower() in low:
        name += "_"
    return name


#: Ids that a join broadcasts at most: 32 MB, and some 200 MB in a process that looks them up.
FEW_IDS = 4_000_000


def with_ids(scratch: Scratch, df: DataFrame, key: Column, ids: DataFrame, how: str, most: int = FEW_IDS) -> DataFrame:
    """df's rows whose key is among ids (how="left_semi") or isn't (how="left_anti"); a null key never is.

    ids has one long column.  It is written and counted: up to `most` ids go to where df is, so that
    wide rows stay where they are; more meet df by a shuffle of both.  The rows are the same.
    """
    name = free_name(df.columns, "id")
    known = scratch.write(ids.toDF(name).distinct())
    return df.join(F.broadcast(known) if known.count() <= most else known, key == F.col(name), how)


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: list[tuple[str, T.DataType]],
    fn: Callable[[list[str | None]], dict[str, object]],
    keep: list[str] | None = None,
) -> DataFrame:
    """df's columns (or those in keep) and the new ones that fn makes of each text.

    A kept column whose name clashes with a new one, in any case, is replaced.  fn gets up to
    ROWS_AT_ONCE whole texts, None for null.
    """
    taken = {name.lower() for name, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    source = df.select(F.col(f"`{text_col}`").cast("string").alias(free_name(kept, "text")), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])
    types = [to_arrow_type(t) for _, t in fields]
    names = [*kept, *(n for n, _ in fields)]
    made = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                out = fn(part.column(0).to_pylist())
                arrays = [part.column(i + 1) for i in range(len(kept))]
                arrays += [pa.array(out[n], type=t) for n, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def grouped(
    df: DataFrame, keys: list[str], fn: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None], schema: T.StructType
) -> DataFrame:
    """fn over each group of two rows or more; groups must be of bounded size (see blocked).

    One shuffle on the keys and a sort inside each partition; Python streams the sorted rows, so it
    holds one Arrow batch and one group.  Groups of one row cost nothing but the comparison.
    """
    names = df.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
            n = table.num_rows
            if not n:
                return [], None
            change = np.zeros(n, dtype=bool)
            change[0] = True
            for i in at:
                col = table.column(i).to_numpy()
                change[1:] |= col[1:] != col[:-1]
            starts = np.append(np.flatnonzero(change), n)
            end = len(starts) - 1 if last else len(starts) - 2
            done = []
            for g in np.flatnonzero(np.diff(starts[: end + 1]) > 1):
                part = table.slice(starts[g], starts[g + 1] - starts[g])
                made = fn({c: part.column(i).combine_chunks() for i, c in enumerate(names)})
                if made is not None:
                    done.append(made)
            return done, None if last else table.slice(starts[-2])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carry is not None and carry.num_rows:
                table = pa.concat_tables([carry, table])
            done, carry = groups(table, False)
            yield from done
        if carry is not None:
            yield from groups(carry, True)[0]

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def streamed(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: T.StructType,
    tasks: int | None = None,
) -> DataFrame:
    """fn over tables of many whole buckets on keys, whose rows are ordered by keys and order.

    Buckets must be of bounded size (see blocked): a task holds a batch and a bucket.  Rows are dealt
    over that many tasks, if given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            if carry is not None:
                table = pa.concat_tables([carry, table]).combine_chunks()
            other = np.zeros(table.num_rows, dtype=bool)
            for c in keys:
                x = table.column(c).to_numpy()
                other |= x != x[-1]
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            carry = table.slice(cut)
            made = fn(table.slice(0, cut)) if cut else None
            if made is not None:
                yield made
        made = fn(carry) if carry is not None else None
        if made is not None:
            yield made

    dealt = df.repartition(*keys) if tasks is None else df.repartition(tasks, *keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def bucket_ends(columns: dict[str, np.ndarray], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a table in order of keys whether it is the first of its bucket, and where its bucket ends."""
    n = len(columns[keys[0]])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in keys:
        new[1:] |= columns[c][1:] != columns[c][:-1]
    head = np.flatnonzero(new)
    return new, np.repeat(np.append(head[1:], n), np.diff(np.append(head, n)))


def members(df: DataFrame, keys: list[str], differ: int | None = None) -> DataFrame:
    """Of each bucket on keys the rows that may be near another, with the name of their set: h0, h1.

    df: the integer columns keys and __b, the long column node, and sign if differ is given; then only
    rows count whose sign differs from another's of the bucket in that many bits at most.  Buckets of
    one such row give none.  Buckets must be of bounded size (see blocked).  Streams over rows in
    order of bucket (see streamed); all buckets of a batch are compared at once, neighbours at a
    distance of 1, 2, ...
    """
    names = [f for f in df.schema.fields if f.name != "sign"]
    schema = T.StructType([*names, T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType())])

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        n = table.num_rows
        new, end = bucket_ends(columns, keys)
        if differ is None:
            close = ~new | (end > np.arange(n) + 1)
        else:
            sign, close = columns["sign"].view(np.uint64), np.zeros(n, dtype=bool)
            rows, step = np.flatnonzero(np.arange(n) + 1 < end), 1
            while len(rows):
                hit = rows[np.bitwise_count(sign[rows] ^ sign[rows + step]) <= differ]
                close[hit] = close[hit + step] = True
                step += 1
                rows = rows[rows + step < end[rows]]
        rows = np.flatnonzero(close)
        if not len(rows):
            return None
        group = (np.cumsum(new) - 1)[rows]
        cut = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(rows))
        alike = [c for c in ("node", "__b", "__i", "__j") if c in columns]
        member = np.stack([columns[c][rows].astype(np.int64) for c in alike], 1)
        mark = np.empty((len(rows), 2), dtype=np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            mark[a:b] = np.frombuffer(xxhash.xxh3_128_digest(member[a:b].tobytes()), dtype=np.int64)
        out = [columns[f.name][rows] for f in names] + [mark[:, 0], mark[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(x, type=to_arrow_type(f.dataType)) for x, f in zip(out, schema.fields)], names=schema.names)

    return streamed(df, keys, ["node"], compare, schema)


def once(near: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of members without buckets whose set an earlier bucket, in order of keys, has too."""
    first = near.groupBy("h0", "h1").agg(F.min(F.struct(*keys)).alias("__g"))
    return near.join(first, ["h0", "h1"]).filter(F.struct(*keys) == F.col("__g")).drop("__g", "h0", "h1")


def blocked(df: DataFrame, keys: list[str], by: str, block: int, counted: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """df with __i and __j, so that each group on (*keys, __i, __j) has about 2 * block rows at most.

    A key with more than block rows is dealt into blocks by a hash of the column `by`; every pair of
    blocks becomes a group, so every pair of the key's rows meets in some group.  Rows of small keys
    are not copied.  __b is the row's own block, __g the number of blocks.  With counted over 1 the
    rows of a key are reckoned from one in so many values of `by`; that changes how rows are dealt
    and no result.  With scratch the large keys are written, so that Spark knows their size.
    """
    some = df if counted == 1 else df.filter(F.pmod(F.xxhash64(by, F.lit(11)), F.lit(counted)) == 0)
    large = some.groupBy(*keys).agg((F.count(F.lit(1)) * counted).alias("__n")).filter(F.col("__n") > block)
    if scratch is not None:
        large = scratch.write(large)
    out = df.join(large, keys, "left").withColumn(
        "__g", F.when(F.col("__n").isNull(), F.lit(1)).otherwise(F.ceil(F.col("__n") / block)).cast("int")
    )
    out = out.withColumn("__b", F.pmod(F.xxhash64(by, F.lit(7)), F.col("__g")).cast("int")).drop("__n")
    other = F.explode(
        F.when(F.col("__g") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__g") - 1))
    )
    out = out.withColumn("__o", other).filter((F.col("__g") <= 1) | (F.col("__o") != F.col("__b")))
    return (
        out.withColumn("__i", F.least("__b", "__o")).withColumn("__j", F.greatest("__b", "__o")).drop("__o")
    )
