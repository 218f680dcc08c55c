"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name, read

#: A rate above this is dealt into equal parts whose counts add up, so that tables of thresholds stay short.
PART = 64.0
#: Sources whose rates are broadcast at most: about 1.3 kB each.  Beyond, a source is dealt into SALT parts.
FEW_SOURCES, SALT = 2000, 64


def _uniform(*parts: Column) -> Column:
    """In (0, 1), by the first 32 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0**32)


def _thresholds(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... as far as a 32-bit uniform number can reach."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    last = F.ceil(rate + 8 * F.sqrt(rate) + 24).cast("int")

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rates(df: DataFrame, source_col: str, size: Column, weights: dict[str | None, float] | None, temperature: float, scratch: Scratch) -> tuple[DataFrame, int]:
    """((source, rate, parts, cdf), number of sources): the mean number of copies of a document of each source.

    The rate is target share x total size / size of the source, so the mixture keeps the size of the
    input in the mean.  weights names shares by source (a source it lacks gets 0); without it the
    share goes as size ** temperature.  Null is a source; one without size, and all of a table without
    any, have rate 0.  The input is read once, for sizes by source.
    """
    stats = scratch.write(df.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.coalesce(F.sum(size).cast("double"), F.lit(0.0)).alias("size")))
    if weights is None:
        share = F.pow("size", F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    stats = stats.withColumn("share", F.when(F.col("size") > 0, share).otherwise(F.lit(0.0)))
    whole = stats.agg(F.sum("size"), F.sum("share"), F.count(F.lit(1))).first()
    total, shares = whole[0] or 0.0, whole[1] or 0.0
    rate = F.lit(0.0) if not shares else F.when(F.col("size") > 0, F.col("share") / F.lit(shares) * F.lit(total) / F.col("size")).otherwise(F.lit(0.0))
    out = stats.select("source", rate.alias("rate"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int")))
    return out.withColumn("cdf", _thresholds(F.col("rate") / F.col("parts"))), whole[2]


def mix(
    df: DataFrame,
    source_col: str = "source",
    key_col: str = "doc_id",
    size_col: str | None = "n_chars",
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    seed: int = 17,
    shuffle: bool = True,
) -> DataFrame:
    """df's rows, each as often as its Poisson count says, with replica and shuffle_key, in shuffled order.

    A null source is a source of its own; a null size counts as 0 and a source without size gets no
    copy; repeated keys get equal counts; an empty table stays empty.  A null key hashes as text of
    its own.  Existing columns of the two names are replaced.  The number of copies of a row depends
    on its key, its source's rate and the seed alone.

    The table of rates is broadcast while it has FEW_SOURCES rows at most, which are counted; with more,
    rows are dealt by source and a part of their key, so that a source of any share meets its rate in
    SALT tasks.  Keys of order are hashes, so that their ranges are known and nothing is sampled:
    a row goes to the partition that its key's first digits name, and partitions are sorted.
    """
    size = F.col(f"`{size_col}`").cast("double") if size_col else F.lit(1.0)
    table, sources = rates(df, source_col, size, weights, temperature, Scratch(df.sparkSession))
    kept = [c for c in df.columns if c.lower() not in ("replica", "shuffle_key")]
    name = {n: free_name([*df.columns, "replica", "shuffle_key"], n) for n in ("source", "rate", "parts", "cdf", "salt", "from", "replica")}
    table = table.withColumnsRenamed(name)
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("null"))
    rows = df.withColumn(name["from"], F.col(f"`{source_col}`").cast("string"))
    on = F.col(name["from"]).eqNullSafe(F.col(name["source"]))
    if sources <= FEW_SOURCES:
        rows = rows.join(F.broadcast(table), on)
    else:
        table = table.withColumn(name["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salt = name["from"] + "_salt"
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int")).join(table, on & (F.col(salt) == F.col(name["salt"])))
    cdf, parts = F.col(name["cdf"]), F.col(name["parts"])
    part = lambda j: _let(_uniform(F.lit(seed), key, j), lambda u: F.size(F.filter(cdf, lambda c: c < u)))
    many = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda a, j: a + part(j))
    count = F.when(parts == 1, part(F.lit(0))).otherwise(many)
    # outer, so that Spark doesn't work the count out a second time for a filter ahead; no copy is a null place
    out = rows.select(*[F.col(f"`{c}`") for c in kept], F.posexplode_outer(F.array_repeat(F.lit(True), count)).alias("replica", name["replica"]))
    out = out.filter(F.col("replica").isNotNull()).drop(name["replica"])
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), key, F.col("replica").cast("string")).cast("binary")))
    if not shuffle:
        return out
    partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.conv(F.substring("shuffle_key", 1, 6), 16, 10).cast("long")
    return out.repartitionById(partitions, F.floor(first * F.lit(partitions) / F.lit(1 << 24)).cast("int")).sortWithinPartitions("shuffle_key", "replica")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of all documents by the square root of their sources' sizes; an empty table gives none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mix(docs).select("doc_id", "source", "replica", "shuffle_key")


OP8_SQL = """
WITH s AS (SELECT source, CAST(sum(n_chars) AS DOUBLE) AS size FROM documents GROUP BY source),
r AS (
  SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s),
k AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, (SELECT unnest(range(0, 200)) AS k)),
u AS (
  SELECT doc_id, source, (CAST('0x' || md5('17|' || doc_id || '|0')[1:8] AS BIGINT) + 0.5) / 4294967296.0 AS u
  FROM documents),
c AS (
  SELECT u.doc_id, u.source, count(*) FILTER (WHERE k.cdf < u.u) AS n
  FROM u JOIN k ON u.source = k.source GROUP BY u.doc_id, u.source),
e AS (SELECT doc_id, source, CAST(unnest(range(0, n)) AS INTEGER) AS replica FROM c WHERE n > 0)
SELECT doc_id, source, replica, md5('order17|' || doc_id || '|' || replica) AS shuffle_key FROM e
"""
