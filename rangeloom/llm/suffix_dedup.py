"""Removal of repeated passages, byte by byte, with difference-cover suffix sorting.

Sorting every suffix of the corpus would move many times its size.  Here a difference cover sorts
only the suffixes whose order is in doubt:

1. In every 100-byte window the k-gram of least hash is its anchor; equal windows have equal anchors
   at equal places.  Consecutive windows with one anchor make a context, which is hashed as a whole.
2. A context that occurred before repeats wholly; a context whose anchor occurs nowhere else doesn't
   repeat at all.  Both are settled by one shuffle of (anchor, context, place).
3. What is left are the first places of different contexts with one anchor: the rims of repeats.  Their
   bytes are brought together by anchor, and the difference-cover algorithm (sort sampled triples,
   recurse on names, merge the remaining suffixes) orders their suffixes; adjacent ones are compared
   on their first 100 bytes, and of equal ones only the earliest stays.

An anchor with more rims than a sort takes is split.  Its windows fall into classes by the place of the
anchor in them; the windows of a class share a core, longer than the anchor, which becomes their anchor.
Classes narrow till few rims have one core; those of one place have the whole window as their core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, read

LENGTH = 100
#: Bytes of an anchor; LENGTH - ANCHOR + 1 anchors compete in a window.
ANCHOR = 32
#: Bytes that one suffix sort takes, contexts of one anchor that it gets at most (more are split), bytes
#: hashed at once, and bytes of rims that a task sorts, 1 MB after another (more, where tasks would be over MOST_TASKS).
SORT_BYTES, MOST_CONTEXTS, SEGMENT, TASK_BYTES, MOST_TASKS = 1 << 20, 4096, 1 << 20, 8 << 20, 100_000

_LOW = np.uint64((1 << 24) - 1)
_MUL = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MUL, n, 1 << 64))


class Rolling:
    """Polynomial hashes, modulo 2**64, of all substrings of a length, from those of powers of two."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.by = {1: _BYTE[data]}

    def of(self, length: int) -> np.ndarray:
        if length not in self.by:
            half = 1 << ((length - 1).bit_length() - 1)
            left, right = self.of(half), self.of(length - half)
            size = self.n - length + 1
            self.by[length] = left[:size] * _power(length - half) + right[half : half + size]
        return self.by[length]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def contexts(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, width: int | None = None):
    """(core hash, context hash, first window, windows) of the contexts in data, texts end to end.

    A context is a run of windows with one anchor and one class, `width` neighbouring places of the
    anchor in its window.  Its core is what all windows of the class hold: the anchor, if one class
    takes all places (the default), and the whole window, if a class takes one.
    """
    places = length - anchor + 1
    width = width or places
    if len(data) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    roll = Rolling(data)
    grams = _mixed(roll.of(anchor))
    whole = roll.of(length)
    place = np.arange(len(grams), dtype=np.uint64)
    best = _least((grams & ~_LOW) | place, places)
    starts = np.concatenate([[0], ends[:-1]])
    last = np.repeat(ends, ends - starts)[: len(best)] - length
    window = np.flatnonzero(np.arange(len(best)) <= last)
    if not len(window):
        return contexts(data[:0], ends[:0], length, anchor)
    at = (best[window] & _LOW).astype(np.int64)
    band = (at - window) // width
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (band[1:] != band[:-1])]))
    inside = _mixed(whole[window] + (window - at + 1024).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.add.reduceat(inside, first)
    low = band[first] * width
    cores = length - np.minimum(width, places - low) + 1
    core = np.empty(len(first), dtype=np.uint64)
    for size in np.unique(cores).tolist():
        which = np.flatnonzero(cores == size)
        core[which] = _mixed(roll.of(size)[at[first[which]] - low[which]] + band[first[which]].astype(np.uint64))
    return core, total, window[first], np.diff(np.append(first, len(window)))


_ROW = T.StructType([T.StructField(c, T.LongType()) for c in ("akey", "ckey", "doc", "loc")])
_ROW_RAW = T.StructType([*_ROW.fields, T.StructField("raw", T.BinaryType())])
#: loc holds the place of the first window, the number of windows, and whether they are settled repeats.


def _loc(place: np.ndarray, count: np.ndarray, kind: int) -> np.ndarray:
    return (place.astype(np.int64) << 9) | (count.astype(np.int64) << 2) | kind


OPEN, REPEAT, RIM = 0, 1, 2


def _batch(akey, ckey, doc, loc, raw=None) -> pa.RecordBatch:
    arrays = [pa.array(np.asarray(x).astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64)) for x in (akey, ckey, doc, loc)]
    if raw is None:
        return pa.RecordBatch.from_arrays(arrays, names=_ROW.names)
    return pa.RecordBatch.from_arrays([*arrays, pa.array(raw, pa.binary())], names=_ROW_RAW.names)


def _combined(akey, ckey, doc, loc, raw=None) -> pa.RecordBatch:
    """The rows of a batch, in which a context that the batch has earlier counts as settled.

    What is settled here needs no meeting with its key any more, so its key becomes its own place:
    a key sends one open row a batch, however frequent it is.  Bytes, where there are any (raw of a
    row's number), go with open rows only.
    """
    akey, ckey = akey.view(np.int64), ckey.view(np.int64)
    order = np.lexsort((loc, doc, ckey, akey))
    akey, ckey, doc, loc = akey[order], ckey[order], doc[order], loc[order]
    new = np.concatenate([[True], (akey[1:] != akey[:-1]) | (ckey[1:] != ckey[:-1])]) if len(akey) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(akey) else np.zeros(0, int)
    same = (doc == doc[first]) & (loc >> 9 == loc[first] >> 9)
    repeat = ~same
    keep = new | repeat
    spread = _mixed((doc * 1_000_003 + loc).view(np.uint64)).view(np.int64)
    akey = np.where(repeat, spread, akey)
    loc = np.where(repeat, loc | REPEAT, loc)
    if raw is not None:
        raw = [None if again else raw(i) for i, again in zip(order[keep].tolist(), repeat[keep].tolist())]
    return _batch(akey[keep], ckey[keep], doc[keep], loc[keep], raw)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, bytes end to end, their ends, where in its text each starts): pieces of up to SEGMENT bytes."""
    docs, ends, parts, froms, size = [], [], [], [], 0

    def flush():
        return np.array(docs, dtype=np.int64), np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(ends, dtype=np.int64), np.array(froms, dtype=np.int64)

    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        raw = text.as_buffer()
        raw = raw.to_pybytes() if raw is not None else b""
        if doc is None or len(raw) < LENGTH:
            continue
        for at in range(0, len(raw) - LENGTH + 1, SEGMENT):
            part = raw[at : at + SEGMENT + LENGTH - 1]
            if docs and size + len(part) > SEGMENT:
                yield flush()
                docs, ends, parts, froms, size = [], [], [], [], 0
            size += len(part)
            docs.append(doc)
            ends.append(size)
            parts.append(part)
            froms.append(at)
    if docs:
        yield flush()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, data, ends, froms in _texts(batch):
            akey, ckey, first, count = contexts(data, ends)
            own = np.searchsorted(ends, first, side="right")
            place = first - np.concatenate([[0], ends[:-1]])[own] + froms[own]
            rows.append((akey, ckey, doc[own], _loc(place, count, OPEN)))
        if rows:
            yield _combined(*(np.concatenate(x) for x in zip(*rows)))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of anchor, context and place: the repeats, and the rims, with their bytes if the rows have any.

    Streams: it holds a batch, the first row of the current context, and the last first row.
    """
    held = None  # first row of the current context, and whether the anchor has others
    for batch in batches:
        akey, ckey, doc, loc = (batch.column(i).to_numpy() for i in range(4))
        raw = np.array(batch.column(4).to_pylist(), dtype=object) if batch.num_columns > 4 else None
        none = None if raw is None else np.full(len(akey), None, dtype=object)
        done = (loc & 3) == REPEAT
        if done.any():
            yield _batch(akey[done], ckey[done], doc[done], loc[done], None if raw is None else none[done])
            akey, ckey, doc, loc = (x[~done] for x in (akey, ckey, doc, loc))
            raw = None if raw is None else raw[~done]
        if not len(akey):
            continue
        shared = False
        if held is not None:
            akey, ckey, doc, loc = (np.concatenate([[h], x]) for h, x in zip(held, (akey, ckey, doc, loc)))
            shared = held[4]
            raw = None if raw is None else np.concatenate([held[5], raw])
        new = np.concatenate([[True], (akey[1:] != akey[:-1]) | (ckey[1:] != ckey[:-1])])
        heads = np.flatnonzero(new)
        first = heads[np.cumsum(new) - 1]
        again = ~new & ((doc != doc[first]) | (loc >> 9 != loc[first] >> 9))
        if again.any():
            yield _batch(akey[again], ckey[again], doc[again], loc[again] | REPEAT, None if raw is None else np.full(again.sum(), None, dtype=object))
        with_last = np.concatenate([[shared], akey[heads][1:] == akey[heads][:-1]])
        with_next = np.append(akey[heads][1:] == akey[heads][:-1], False)
        rim = (with_last | with_next)[:-1]
        out = heads[:-1][rim]
        if len(out):
            yield _batch(akey[out], ckey[out], doc[out], loc[out] | RIM, None if raw is None else raw[out])
        k = heads[-1]
        held = (akey[k], ckey[k], doc[k], loc[k], bool(with_last[-1]), None if raw is None else raw[k : k + 1])
    if held is not None and held[4]:
        yield _batch(*(np.array([x]) for x in held[:3]), np.array([held[3] | RIM]), held[5])


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffixes of s, nonnegative integers, in order: the difference-cover algorithm for period three."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    s = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    base = np.int64(s.max() + 1)
    pad = np.concatenate([s, np.zeros(4, dtype=np.int64)])
    # sort the sampled triples and name them
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    triple = (pad[sampled] * base + pad[sampled + 1]) * base + pad[sampled + 2]
    names, name = np.unique(triple, return_inverse=True)
    # recurse on the names where they don't tell all sampled suffixes apart
    if len(names) == len(sampled):
        order = np.argsort(name)
    else:
        order = suffix_order(name)
    rank = np.zeros(n + 5, dtype=np.int64)
    rank[sampled[order]] = np.arange(1, len(sampled) + 1)
    # the remaining suffixes by their first symbol and the rank of what follows
    width = np.int64(len(sampled) + 2)
    zeros = np.arange(0, n, 3)
    zero_key = pad[zeros] * width + rank[zeros + 1]
    zeros = zeros[np.argsort(zero_key, kind="stable")]
    # merge: how many sampled suffixes stand before each of the remaining ones
    inside = sampled[order]
    inside = inside[inside < n]
    one, two = inside[inside % 3 == 1], inside[inside % 3 == 2]
    before = np.searchsorted(pad[one] * width + rank[one + 1], pad[zeros] * width + rank[zeros + 1])
    before += np.searchsorted(
        (pad[two] * base + pad[two + 1]) * width + rank[two + 2], (pad[zeros] * base + pad[zeros + 1]) * width + rank[zeros + 2]
    )
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(zeros))
    out[at] = zeros
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[free] = inside
    return out


def repeats(texts: list[bytes], docs: np.ndarray, places: np.ndarray, length: int = LENGTH):
    """(text, window) of the windows of the texts that an earlier place, by (doc, place), has too."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    symbols = data.astype(np.int64) + 1
    symbols[ends - 1] = 0
    order = suffix_order(symbols)
    own = np.searchsorted(ends, order, side="right")
    full = order + length < ends[own]
    order, own = order[full], own[full]
    if len(order) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # adjacent suffixes: equal if their first `length` bytes are
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.zeros(len(order), dtype=bool)
    for at in range(1, len(order), 16_384):
        a = order[at : at + 16_384]
        same[at : at + len(a)] = (windows[a] == windows[order[at - 1 : at - 1 + len(a)]]).all(1)
    run = np.cumsum(~same) - 1
    starts = ends - np.array([len(t) + 1 for t in texts])
    inner = order - starts[own]
    doc, place = docs[own], places[own] + inner
    by = np.lexsort((place, doc, run))
    head = np.concatenate([[True], run[by][1:] != run[by][:-1]])
    first = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
    late = (doc[by] != doc[first]) | (place[by] != place[first])
    return own[by[late]], inner[by[late]]


def _sorted_rims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that repeat, from rims in order of anchor: whole anchors, up to SORT_BYTES at once."""

    def sort(table: pa.Table) -> pa.RecordBatch | None:
        texts = table.column("raw").to_pylist()
        doc, place = table.column("doc").to_numpy(), table.column("place").to_numpy()
        own, inner = repeats(texts, doc, place)
        if not len(own):
            return None
        where = np.lexsort((inner, own))
        own, inner = own[where], inner[where]
        # neighbouring windows of one text make one row of up to 100
        cut = np.concatenate([[True], (own[1:] != own[:-1]) | (inner[1:] != inner[:-1] + 1)])
        head = np.flatnonzero(cut)
        count = np.diff(np.append(head, len(own)))
        own, inner = own[head], inner[head]
        z = np.zeros(len(own), dtype=np.int64)
        return _batch(z, z, doc[own], _loc(place[own] + inner, count, REPEAT))

    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        while waiting.num_rows and waiting.nbytes > 2 * SORT_BYTES:
            akey = waiting.column("akey").to_numpy()
            size = np.cumsum([len(x) for x in waiting.column("raw").to_pylist()])
            edge = np.flatnonzero(akey[1:] != akey[:-1]) + 1
            if not len(edge):
                break
            fit = edge[size[edge - 1] <= SORT_BYTES]
            take = int(fit[-1] if len(fit) else edge[0])
            made = sort(waiting.slice(0, take))
            if made is not None:
                yield made
            waiting = waiting.slice(take).combine_chunks()
    if waiting is not None and waiting.num_rows:
        akey = waiting.column("akey").to_numpy()
        edges = [*np.flatnonzero(np.concatenate([[True], akey[1:] != akey[:-1]])).tolist(), len(akey)]
        at = 0
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in waiting.column("raw").to_pylist()])])
        for a, b in zip(edges[1:], [*edges[2:], None]):
            if b is None or sizes[b] - sizes[at] > SORT_BYTES:
                made = sort(waiting.slice(at, a - at))
                if made is not None:
                    yield made
                at = a


_RIM = T.StructType(
    [T.StructField("akey", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("place", T.LongType()), T.StructField("raw", T.BinaryType())]
)


def _rim_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, rims) to a row a rim with its bytes."""
    for batch in batches:
        akeys, docs, places, raws = [], [], [], []
        for doc, text, rims in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for rim in rims:
                place, count = rim["loc"] >> 9, (rim["loc"] >> 2) & 127
                piece = raw[place : place + count + LENGTH - 1]
                if len(piece) >= LENGTH:
                    akeys.append(rim["akey"])
                    docs.append(doc)
                    places.append(place)
                    raws.append(piece)
            if len(raws) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(akeys, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(raws, pa.binary())], names=_RIM.names)
                akeys, docs, places, raws = [], [], [], []
        if raws:
            yield pa.RecordBatch.from_arrays([pa.array(akeys, pa.int64()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(raws, pa.binary())], names=_RIM.names)


def _split(width: int):
    """Rims (anchor, doc, place, bytes) cut into classes of `width` places, each with its core as its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            raws = batch.column(3).to_pylist()
            ends = np.cumsum([len(x) for x in raws])
            core, ckey, first, count = contexts(np.frombuffer(b"".join(raws), dtype=np.uint8), ends, width=width)
            if not len(core):
                continue
            own = np.searchsorted(ends, first, side="right")
            inner = first - np.concatenate([[0], ends[:-1]])[own]

            def raw(i: int) -> bytes:
                return raws[own[i]][inner[i] : inner[i] + count[i] + LENGTH - 1]

            yield _combined(core, ckey, doc[own], _loc(place[own] + inner, count, OPEN), raw)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, marks in zip(batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            pieces, done, removed, spans = [], 0, 0, 0
            for loc in sorted(marks or ()):
                a = loc >> 9
                b = min(a + ((loc >> 2) & 127) + LENGTH - 1, len(raw))
                if b <= done or a >= len(raw):
                    continue
                if a > done or not spans:
                    pieces.append(raw[done:a])
                    spans += 1
                else:
                    a = done
                removed += b - a
                done = b
            pieces.append(raw[done:])
            kept = b"".join(pieces)
            for c, x in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                out[c].append(x)
        arrays = [batch.column(0), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", *out])


def remove_repeats(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept), a row for each row of docs.

    Every byte that a 100-byte string covers which starts earlier too (at a smaller id, or earlier in
    the same text) is removed.  kept holds the remaining bytes; they may cut a character.  Null texts
    are empty.  Rows with a null id lose nothing and count for nothing.  Rows of one id are one
    document: of equal rows neither comes first.  Hashes of 128 bits stand for anchors and contexts.
    """
    scratch = Scratch(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = ("akey", "ckey", "doc", "loc")
    kind = F.col("loc").bitwiseAND(F.lit(3))
    rows = base.mapInArrow(_anchors, _ROW).repartition("akey").sortWithinPartitions(*order)
    settled = scratch.write(rows.mapInArrow(_settle, _ROW))
    marks = settled.filter(kind == REPEAT).select("doc", "loc")
    lists = settled.filter(kind == RIM).groupBy("doc").agg(F.collect_list(F.struct("akey", "loc")).alias("rims"))
    texts = base.join(lists, base.id == lists.doc).select("id", "text", "rims")
    rims = scratch.write(texts.mapInArrow(_rim_bytes, _RIM))
    width = LENGTH - ANCHOR + 1
    while True:
        hot = scratch.write(rims.groupBy("akey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_contexts).select("akey"))
        # windows of one place and core are equal, so none is left to split
        some = width > 1 and not hot.isEmpty()
        few = rims.join(hot, "akey", "left_anti") if some else rims
        size = few.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
        few = few.repartition(min(size // TASK_BYTES + 1, MOST_TASKS), "akey").sortWithinPartitions("akey", "doc", "place")
        marks = marks.union(few.mapInArrow(_sorted_rims, _ROW).select("doc", "loc"))
        if not some:
            break
        width = (width + 1) // 2
        parts = rims.join(hot, "akey", "left_semi").mapInArrow(_split(width), _ROW_RAW)
        parts = scratch.write(parts.repartition("akey").sortWithinPartitions(*order).mapInArrow(_settle, _ROW_RAW))
        marks = marks.union(parts.filter(kind == REPEAT).select("doc", "loc"))
        place = F.shiftright("loc", 9).alias("place")
        rims = parts.filter(kind == RIM).select("akey", "doc", place, "raw")
    marks = marks.groupBy("doc").agg(F.collect_list("loc").alias("marks"))
    out = base.join(marks, base.id == marks.doc, "left").select("id", "text", "marks")
    schema = T.StructType(
        [T.StructField("id", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    )
    return out.mapInArrow(_kept, schema).withColumnRenamed("id", id_col)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, read(spark, sf_dir, "documents")).drop("kept")
