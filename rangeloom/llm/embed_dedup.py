"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocked, grouped, members, once, read
from .components import components

COSINE = 0.9
#: Vectors the rotations are fitted on at most, drawn by a hash of the id; every vector is indexed.
SAMPLE = 5_000
STEPS = 20
#: Sampled vectors of a length that rotations are fitted on at least, but for the most frequent length.
FEW = 50
#: The chance that a bit agrees at COSINE, as measured for fitted rotations, and that no table agrees.
AGREE, MISS = 0.868, 0.03
#: A signature decides which rows of a bucket are worth their vectors: bits, and how many may differ.
#: At a cosine of 0.9 about 9 of 64 differ, and more than 22 do 2 times in 100,000.
SIGNATURE, DIFFER = 64, 22
#: Rows of a bucket that meet in one task; larger buckets are dealt into pairs of blocks.
BLOCK = 8192
#: Of this many vectors one is counted to find the buckets to deal.
COUNTED = 16


def tables_for(rows: int) -> tuple[int, int]:
    """(bits of a key, tables) for so many vectors: keys as long as tell them apart, and tables for the recall that leaves."""
    bits = max(8, math.ceil(math.log2(max(2, rows))))
    return bits, math.ceil(-math.log(MISS) / AGREE**bits)


def fit_rotations(x: np.ndarray, bits: int, steps: int = STEPS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections): iterative quantisation from several starts; x has a row at least.

    As many starts as `bits` code bits take.  Each alternates between the codes' signs and the orthogonal map that brings the centred
    sample closest to them; every projection has as many columns as the vectors have components.
    """
    mean = x.mean(0)
    c = x - mean
    gen = np.random.default_rng(seed)
    out = []
    for _ in range(-(-bits // x.shape[1])):
        r = np.linalg.qr(gen.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(steps):
            u, _, vt = np.linalg.svd(c.T @ np.where(c @ r >= 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return mean, np.concatenate(out, axis=1)[:, :bits]


def codes(x: np.ndarray, mean: np.ndarray, projections: np.ndarray, key_bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, signature) of unit vectors: a substring of the code for each table, and the bits behind them."""
    bits = (x - mean) @ projections >= 0
    weights = np.int64(1) << np.arange(key_bits, dtype=np.int64)
    cut = tables * key_bits
    keys = bits[:, :cut].reshape(len(x), tables, key_bits) @ weights
    return keys, np.packbits(bits[:, cut : cut + SIGNATURE], axis=1).view(np.int64)[:, 0]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, at length one; rows are finite and not zero."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pairs(group: dict[str, pa.Array], cosine: float, short: type) -> pa.RecordBatch | None:
    """(node, n, root) for the rows with a link whose first table this is: n other vectors linked, and
    a row that its links reach.  Pairs count once: in the first table whose substrings agree, in the
    one group of that table where their blocks meet."""
    node, weight = group["node"].to_numpy(), group["weight"].to_numpy()
    n = len(node)
    x = unit(np.stack([np.frombuffer(v, dtype=np.float32) for v in group["raw"].to_pylist()]))
    code = np.stack([np.frombuffer(v, dtype=short) for v in group["code"].to_pylist()])
    table = int(group["tk"][0].as_py()) >> 40
    block, i, j = group["__b"].to_numpy(), int(group["__i"][0].as_py()), int(group["__j"][0].as_py())
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)

    def top(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    at, many = 0, 1
    while at < n:
        a, b = np.nonzero(x[at : at + many] @ x.T >= cosine)
        a = a + at
        keep = a < b
        a, b = a[keep], b[keep]
        if i != j:
            # rows of one block also meet in the groups of its other pairs; they count in one of those
            same = block[a] == block[b]
            other = np.where(block[a] == i, j, i)
            keep = ~same | (other == np.where(block[a] == 0, 1, 0))
            a, b = a[keep], b[keep]
        for t in range(table):
            keep = code[a, t] != code[b, t]
            a, b = a[keep], b[keep]
            if not len(a):
                break
        links += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
        # rows already together need no chain; few rows at first, so that most are
        apart = root[a] != root[b]
        for p, q in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = top(p), top(q)
            if p != q:
                root[max(p, q)] = min(p, q)
        while (root[root] != root).any():
            root = root[root]
        at, many = at + many, min(256, 2 * many)
    linked = np.flatnonzero(links)
    if not len(linked):
        return None
    return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(links[linked]), pa.array(node[root[linked]])], names=["node", "n", "root"])


def near_duplicates(
    spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
    sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """(id_col, n_links, component_id, kept), a row for each row of df.

    Vectors that are null, zero, or hold a null or a number that is not finite link with nothing; so do
    rows with a null id.  Vectors of each length are indexed on their own, by rotations fitted on the
    sampled ones of that length, or random ones where the sample has few.  Equal vectors collapse
    before the search and count as linked with each other.  Only `cosine` of COSINE or more is searched
    with the stated recall.  Other columns are not read; an empty table gives none.

    Tables shuffle keys, ids and signatures.  Buckets with the same close rows are compared once, in
    the first of their tables, and only their rows get vectors.  No pair is written: groups give sums
    of links and chains to representatives.
    """
    scratch = Scratch(spark)
    v = F.col(f"`{vector_col}`").cast("array<float>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    good = good & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good & F.exists("v", lambda x: x != 0)
    # one row a distinct vector, by 128 bits of hash, named by its smallest id; zeros of either sign are equal
    v = F.when(good, F.transform("v", lambda x: x + F.lit(0.0).cast("float")))
    plain = rows.select("id", v.alias("v")).withColumns({"v0": F.xxhash64("v"), "v1": F.xxhash64(F.lit(1), "v")})
    equal = ["v0", "v1"]
    whole = plain.filter(F.col("v").isNotNull())
    classes = scratch.write(
        whole.groupBy(*equal).agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    )
    total = classes.count()
    share = min(1.0, sample / max(1, total))
    drawn = classes.filter(F.pmod(F.xxhash64("node", F.lit(31)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    got = drawn.select("node", "v").toArrow().sort_by("node")
    if not got.num_rows:
        # nothing to search if there is no vector; a few may all miss the sample, and get random rotations
        got = classes.select("node", "v").orderBy("node").limit(1).toArrow()
    base = rows.select("id")
    if not got.num_rows:
        return base.select(
            F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
        )
    key_bits, tables = tables_for(total)
    every = key_bits * tables + SIGNATURE
    column = got.column("v").combine_chunks()
    lengths = pc.list_value_length(column).to_numpy()
    values = column.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    fitted = {}
    sizes, counts = np.unique(lengths, return_counts=True)
    for size in sizes[(counts >= FEW) | (counts == counts.max())].tolist():
        fitted[size] = fit_rotations(unit(values[starts[lengths == size][:, None] + np.arange(size)]), every)
    short = np.uint16 if key_bits <= 16 else np.uint32 if key_bits <= 32 else np.uint64
    long, plain_int = T.LongType(), T.IntegerType()
    schema = T.StructType(
        [T.StructField("node", long), T.StructField("weight", long), T.StructField("size", plain_int)]
        + [T.StructField(c, T.BinaryType()) for c in ("raw", "code")]
        + [T.StructField("sign", long), T.StructField("tk", T.ArrayType(long))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2)
            length = pc.list_value_length(vectors).to_numpy()
            flat, begin = vectors.flatten().to_numpy(), np.cumsum(length) - length
            for size in np.unique(length).tolist():
                if size not in fitted:
                    fitted[size] = fit_rotations(np.zeros((1, size)), every, steps=0)
                at = np.flatnonzero(length == size)
                raw = np.ascontiguousarray(flat[begin[at][:, None] + np.arange(size)], dtype=np.float32)
                keys, sign = codes(unit(raw), *fitted[size], key_bits, tables)
                tk = keys + (np.arange(tables, dtype=np.int64) << 40)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.full(len(at), size), pa.int32()),
                        pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([k.tobytes() for k in keys.astype(short)], pa.binary()), pa.array(sign),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(tk.ravel())),
                    ],
                    names=schema.names,
                )

    coded = scratch.write(classes.select("node", "weight", "v").mapInArrow(encode, schema))
    spread = coded.select("size", F.explode("tk").alias("tk"), "node", "sign")
    dealt = blocked(spread, ["size", "tk"], "node", block, COUNTED, scratch).select("size", "tk", "__i", "__j", "__b", "node", "sign")
    keys = ["size", "tk", "__i", "__j"]
    chosen = once(scratch.write(members(dealt, keys, DIFFER)), keys)
    full = chosen.join(coded.select("node", "weight", "raw", "code"), "node")
    found = T.StructType([T.StructField("node", long), T.StructField("n", long), T.StructField("root", long)])
    met = scratch.write(grouped(full, keys, lambda g: _pairs(g, cosine, short), found))
    degree = met.groupBy("node").agg(F.sum("n").alias("n"))
    least = components(scratch, met.select("node", "root"))
    ends = (
        classes.select(*equal, "node", "weight")
        .join(degree, "node", "left")
        .join(least, "node", "left")
        .select(*equal, F.coalesce("component", "node").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    )
    out = whole.select("id", *equal).join(ends, equal, "left").select("id", "c", "n")
    out = out.unionByName(plain.filter(F.col("v").isNull()).select("id"), allowMissingColumns=True)
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector of embeddings; vectors that cannot be compared stay, without links, and equal ones are linked."""
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))
