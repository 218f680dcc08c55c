"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, read

#: About this many labelled rows are fitted at most, drawn by a hash of the id; the model is one for all sizes.
SAMPLE = 10_000
BITS = 20
#: Terms among which pairs are looked for; a fit holds a row and a column for each.
PAIRED = 1024
PREFIXES = (4, 6)
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W\d_]+")
_known: dict[str, tuple[int, ...]] = {}


def _of_word(word: str) -> tuple[int, ...]:
    """Hashed terms of a word: itself, and its beginnings."""
    raw = [f"w{word}"] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n]
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) >> (32 - BITS) for x in raw)


def terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a whole text, sorted; none for a null or empty one."""
    if len(_known) > 100_000:
        _known.clear()
    out: set[int] = set()
    for w in set(_WORDS.findall((text or "").lower())):
        found = _known.get(w)
        if found is None:
            found = _of_word(w)
            if len(w) <= 40:
                _known[w] = found
        out.update(found)
    return np.sort(np.fromiter(out, dtype=np.int32, count=len(out)))


def _term_bytes(texts: list[str | None]) -> dict[str, object]:
    return {"__terms": [terms(t).tobytes() for t in texts]}


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms that are in `kept`."""

    kept: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        lookup = _lookup(self)
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            at = lookup[terms(t)]
            at = at[at >= 0]
            v = self.v[at]
            total = v.sum(0)
            out[i] = self.bias + self.w[at].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


_lookups: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(m: Machine) -> np.ndarray:
    key = hash(m.kept.tobytes())
    if key not in _lookups:
        _lookups.clear()
        table = np.full(1 << BITS, -1, dtype=np.int32)
        table[m.kept] = np.arange(len(m.kept))
        _lookups[key] = (m.kept, table)
    return _lookups[key][1]


def pair_terms(flat: np.ndarray, ptr: np.ndarray, labels: np.ndarray, seen: np.ndarray, toxic: np.ndarray, z: float, most: int) -> np.ndarray:
    """Terms of a pair whose share of toxic rows is z standard errors off that of either term alone.

    Pairs are those of the `most` terms that part the rows most evenly: a pair is seen often enough to
    tell only if both its terms are.
    """
    n = len(ptr) - 1
    even = np.minimum(seen, n - seen)
    top = np.sort(np.argsort(-even, kind="stable")[:most])
    top = top[even[top] >= 20]
    if len(top) < 2:
        return top[:0]
    place = np.full(len(seen), -1, dtype=np.int64)
    place[top] = np.arange(len(top))
    x = np.zeros((n, len(top)), dtype=np.float32)
    at = place[flat]
    inside = at >= 0
    x[np.repeat(np.arange(n), np.diff(ptr))[inside], at[inside]] = 1.0
    both, worst = x.T @ x, x[labels > 0.5]
    bad = worst.T @ worst
    share = ((toxic[top] + 0.5) / (seen[top] + 1.0))[:, None]
    spread = share * (1 - share) * both * np.maximum(1 - both / seen[top][:, None], 1e-9)
    off = np.abs(bad - share * both) / np.sqrt(np.maximum(spread, 0.25))
    off[both < 10] = 0.0
    return top[(np.minimum(off, off.T) >= z).any(1)]


def fit(
    rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 80, rate: float = 0.1, decay: float = 1e-4,
    least: int = 4, z: float = 4.0, pair_z: float = 6.0, paired: int = PAIRED, seed: int = 5,
) -> Machine:
    """Adagrad over logistic loss, in mini-batches.

    A term counts if at least `least` rows have it and its share of toxic rows is off the base rate
    by z standard errors, or if one of its pairs is off what either term alone says (see pair_terms);
    this keeps chance words of long texts out of the sums, and words that tell only beside another in.
    Without rows of both labels, or without rows, the machine scores the smoothed base rate.
    """
    n = len(rows)
    base = (float(labels.sum()) + 0.5) / (n + 1.0)
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    flat = np.concatenate(rows) if n else np.zeros(0, dtype=np.int32)
    seen = np.bincount(flat, minlength=1 << BITS).astype(np.float64)
    toxic = np.bincount(flat, weights=np.repeat(labels, np.diff(ptr)), minlength=1 << BITS) if n else seen
    off = np.abs(toxic - base * seen) / np.sqrt(np.maximum(base * (1 - base) * seen, 1e-9))
    alone = (seen >= least) & (off >= z)
    if n and labels.min() != labels.max():
        alone[pair_terms(flat, ptr, labels, seen, toxic, pair_z, paired)] = True
    kept = np.flatnonzero(alone).astype(np.int32)
    bias = float(np.log(base / (1 - base)))
    gen = np.random.default_rng(seed)
    w, v = np.zeros(len(kept)), gen.normal(0, 0.01, (len(kept), factors))
    if not len(kept) or labels.min() == labels.max():
        return Machine(kept[:0], bias, w[:0], v[:0])
    table = np.full(1 << BITS, -1, dtype=np.int32)
    table[kept] = np.arange(len(kept))
    at = table[flat]
    inside = at >= 0
    sizes = np.add.reduceat(np.append(inside, 0).astype(np.int64), ptr[:-1]) * (np.diff(ptr) > 0)
    at = at[inside]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    gw, gv, gb = np.full(len(kept), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = gen.permutation(n)
        for start in range(0, n, 256):
            pick = order[start : start + 256]
            count = sizes[pick]
            cols = at[np.repeat(ptr[pick] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            row = np.repeat(np.arange(len(pick)), count)
            lin = np.bincount(row, weights=w[cols], minlength=len(pick))
            total = np.stack([np.bincount(row, weights=v[cols, k], minlength=len(pick)) for k in range(factors)], 1)
            square = np.bincount(row, weights=(v[cols] ** 2).sum(1), minlength=len(pick))
            y = bias + lin + 0.5 * ((total**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[pick]) / len(pick)
            dw = np.bincount(cols, weights=g[row], minlength=len(kept)) + decay * w
            dv = np.stack(
                [np.bincount(cols, weights=g[row] * (total[row, k] - v[cols, k]), minlength=len(kept)) for k in range(factors)], 1
            ) + decay * v
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= 0.3 * rate * dv / np.sqrt(gv)
            bias -= rate * g.sum() / np.sqrt(gb)
    return Machine(kept, float(bias), w, v)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE
) -> Machine:
    """Fit on labelled rows that are not held out; about `sample` of them, by a hash of the id.

    Rows with a null label or id are left out.  Only the sample's hashed terms reach the driver.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("double").alias("__y"))
    known = known.filter(F.col("__y").isNotNull() & F.col("__id").isNotNull() & ~held_out("__id"))
    count = known.count()
    share = min(1.0, sample / max(1, count))
    drawn = known.filter(F.pmod(F.xxhash64("__id", F.lit(29)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__t"))
    rows = append_columns(texts.join(drawn, "__id"), "__t", [("__terms", T.BinaryType())], _term_bytes, keep=["__id", "__y"])
    got = rows.toArrow().sort_by([("__id", "ascending"), ("__y", "ascending"), ("__terms", "ascending")])
    vectors = [np.frombuffer(x.as_py() or b"", dtype=np.int32) for x in got.column("__terms")]
    return fit(vectors, np.minimum(1.0, got.column("__y").to_numpy()).astype(np.float64))


def score(df: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """df with the score of each whole text, 0 to 1; null texts score as empty ones, the bias alone.

    An existing column of that name is replaced.  One pass, no shuffle.
    """
    return append_columns(df, text_col, [(out, T.DoubleType())], lambda texts: {out: machine.score(texts)}, keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts get the bias alone, a null id is not held out, repeated rows score alike."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, machine, keep=["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
