"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_columns, blocked, free_name, grouped, read, with_ids
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of one bucket that a task compares at once; larger buckets are dealt into blocks.
BLOCK = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: list[str | None]) -> dict[str, object]:
    return {"fp": np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)}


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; two words that differ in at most radius bits agree under one at least.

    Bit i gets a nonzero vector m(i) of radius+1 bits, dealt in turn.  Mask v keeps the bits whose
    m(i) has an odd inner product with v.  At most radius differing bits leave some nonzero v
    orthogonal to all of their vectors, and that mask hides them all.
    """
    vectors = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(group: dict[str, pa.Array], radius: int) -> pa.RecordBatch | None:
    """Links that connect the group's rows as all pairs within the radius would; under one a row."""
    fp = group["fp"].to_numpy().view(np.uint64)
    node = group["node"].to_numpy()
    left = np.arange(len(fp))
    src, dst = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(fp[left] ^ fp[front.pop()]) <= radius
            found = left[near]
            left = left[~near]
            front += found.tolist()
            src += found.tolist()
            dst += [root] * len(found)
    if not src:
        return None
    return pa.RecordBatch.from_arrays([pa.array(node[src]), pa.array(node[dst])], names=["u", "v"])


def links(spark: SparkSession, classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v) that connect what all pairs within the radius connect; classes: fp, node, one row a fp."""
    masks = covering_masks(radius)
    table = F.explode(
        F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks)])
    )
    rows = classes.select("fp", "node", table.alias("x")).select("fp", "node", "x.t", "x.key")
    dealt = blocked(rows, ["t", "key"], "fp", block).select("t", "key", "__i", "__j", "fp", "node")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    return grouped(dealt, ["t", "key", "__i", "__j"], lambda g: _forest(g, radius), schema)


def near_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """(id_col, fp, component_id): fp a signed long, component_id the smallest id reachable by links.

    Null and empty texts have fingerprint 0 and link like any other.  Rows with equal ids count as
    one node; each row is returned.  A row with a null id links with nothing and has a null
    component.  Other columns are not read.  Documents with one fingerprint collapse before the
    search, so a group of copies costs one row.
    """
    scratch = Scratch(spark)
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = scratch.write(append_columns(ids, "text", [("fp", T.LongType())], _fingerprints, keep=["id"]))
    known = rows.filter("id IS NOT NULL")
    classes = scratch.write(known.groupBy("fp").agg(F.min("id").alias("node")))
    # an id on several rows joins their fingerprints
    same = known.join(classes, "fp").filter("id != node").groupBy("id", "node").agg(F.lit(1).alias("x"))
    several = known.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a != b").select("id")
    same = same.join(several, "id").select(F.col("id").alias("u"), F.col("node").alias("v"))
    least = components(scratch, scratch.write(links(spark, classes, radius, block).union(same)))
    named = classes.join(least, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = rows.join(named, "fp", "left")
    return out.select(
        F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def smallest(scratch: Scratch, docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group in found (id_col, component_id) the row of docs of the smallest id, with all columns.

    Of several rows with that id the one of the smallest text stays, and of those the one of the
    smallest hash of its columns.  Rows with a null id stay, all of them.  An empty table stays empty.
    """
    key = F.col(f"`{id_col}`").cast("long")
    known = scratch.write(found.select(F.col(id_col).alias("i"), F.col("component_id").alias("c")).filter("c IS NOT NULL"))
    left = with_ids(scratch, docs, key, known.filter("i != c").select("i"), "left_anti")
    several = scratch.write(known.filter("i = c").groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("i"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.col(f"`{text_col}`"), F.xxhash64(*[c for c, (_, kind) in zip(columns, docs.dtypes) if not kind.startswith("map")]))
    i = free_name(docs.columns, "i")
    one = with_ids(scratch, left, key, several, "left_semi").groupBy(key.alias(i)).agg(F.min_by(F.struct(*columns), order).alias("r"))
    return with_ids(scratch, left, key, several, "left_anti").unionByName(one.select("r.*"))


def representatives(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates, as smallest keeps them."""
    return smallest(Scratch(spark), docs, near_duplicates(spark, docs, id_col, text_col), id_col, text_col)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts have fingerprint zero and link like any other, repeated rows stay."""
    found = near_duplicates(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
