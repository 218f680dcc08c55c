"""Packing token pieces into sequences by vector best-fit."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, read

END = 2
#: Pieces that a task packs together; more tasks, not larger ones, take a larger input.
GROUP = 4096
#: Bytes of text that are encoded at once, one whole text at least.
TEXT_BYTES = 4 << 20
#: Fixed value: where the byte-level pre-tokenizer breaks a text.
BREAKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than a blank and a line end, and signs that some take for it.
_ODD_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and the weight of each remainder in the choice of a bin."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    by: str = "norm"  # or "dot"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(path: str):
    """An encoder by the file's own vocabulary, if its ids number the bytes and then the merges in order; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, byte = whole["model"], _byte_of()
    pre = whole.get("pre_tokenizer") or {}
    plain = whole.get("normalizer") is None and not model.get("ignore_merges") and not model.get("byte_fallback")
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        return None
    special = {x["content"] for x in whole.get("added_tokens") or ()}
    tokens = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(set(t) - byte.keys() for t in tokens) or sorted(tokens.values()) != list(range(256 + len(merges))):
        return None
    if any(tokens.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in tokens.items()}
    sizes = np.zeros(len(ranks), dtype=np.int64)
    for raw, i in ranks.items():
        sizes[i] = len(raw)
    return tiktoken.Encoding("ranks of the file", pat_str=BREAKS, mergeable_ranks=ranks, special_tokens={}), sizes


class Ids:
    """Token ids of texts, each with END behind it, end to end.

    A text is cut before each blank and line end.  The pre-tokenizer breaks there too, but for runs of
    three or more and for runs of two at the end of a text; so the ids of a text are those of its
    words, and each distinct word of a batch is encoded once, by one call for all.  A text with such
    a run, or with other white space, is encoded whole; one that names a special token, and every
    text where the file's ids don't number its merges, is encoded whole by the file's own library.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        found = _ranked(path)
        self.ranked, self.sizes = found if found else (None, None)
        if found:
            self.space, self.line_end = (self.ranked.encode_ordinary(x)[0] for x in (" ", "\n"))

    def _by_file(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _words(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words end to end, each word with lead before it, and where each word's ids end."""
        if not len(words):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        made = self.ranked.encode_to_numpy(lead + pc.binary_join(one, lead)[0].as_py())
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        reached = np.cumsum(self.sizes[made])
        at = np.searchsorted(reached, ends)
        if not (reached[at] == ends).all():
            raise ValueError("a token crosses a word's edge")
        return made.astype(np.uint32), at + 1

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): those of text i are ids[ends[i - 1]:ends[i]]; null texts are empty."""
        texts = texts.cast(pa.string()).fill_null("")
        n = len(texts)
        special = np.zeros(n, dtype=bool)
        for t in self.special:
            special |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if self.ranked is None:
            special[:] = True
        lines = pc.split_pattern(texts, "\n")
        split = pc.split_pattern(lines.flatten(), " ")
        line_at, unit_at = lines.offsets.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        starts = unit_at[line_at - line_at[0]]  # the first unit of each text, and the end
        units = split.flatten().dictionary_encode()
        code, words = units.indices.to_numpy(), units.dictionary
        # what each distinct word is: empty, odd or plain
        empty = (pc.binary_length(words).to_numpy() == 0) if len(words) else np.zeros(0, bool)
        odd = pc.match_substring_regex(words, _ODD_SPACE).to_numpy(zero_copy_only=False) if len(words) else empty
        head = np.zeros(len(code), dtype=bool)
        head[unit_at[:-1]] = True
        first = starts[:-1]
        hollow = empty[code]
        hollow[first] = False
        owner = np.repeat(np.arange(n), np.diff(starts))
        whole = special.copy()
        whole[owner[odd[code]]] = True
        whole[owner[1:][hollow[1:] & hollow[:-1]]] = True
        # ids of the words: END, a blank, a line end, words behind a blank, words behind a line end, whole texts
        pool = [np.array([END, 0, 0], dtype=np.uint32)]
        where, length = np.zeros((2, len(words)), dtype=np.int64), np.zeros((2, len(words)), dtype=np.int64)
        size = 3
        if self.ranked is not None:
            pool[0][1:] = self.space, self.line_end
            heads = np.zeros(len(words), dtype=bool)
            heads[code[head]] = True
            for kind, lead, chosen in ((0, " ", ~empty & ~odd), (1, "\n", ~empty & ~odd & heads)):
                at = np.flatnonzero(chosen)
                made, ends = self._words(words.take(pa.array(at)), lead)
                where[kind, at] = size + np.concatenate([[0], ends[:-1]]) if len(at) else 0
                length[kind, at] = np.diff(ends, prepend=0)
                where[kind, empty], length[kind, empty] = 1 + kind, 1
                pool.append(made)
                size += len(made)
        kind = head.astype(np.int64)
        begin, count = where[kind, code], length[kind, code]
        # the first word of a text has no line end before it
        begin[first] += 1
        count[first] = np.maximum(count[first] - 1, 0)
        count[whole[owner]] = 0
        for i in np.flatnonzero(whole).tolist():
            made = self._by_file(texts[i].as_py()) if special[i] else self.ranked.encode_to_numpy(texts[i].as_py()).astype(np.uint32)
            begin[first[i]], count[first[i]] = size, len(made)
            pool.append(made)
            size += len(made)
        begin, count = np.insert(begin, starts[1:], 0), np.insert(count, starts[1:], 1)
        ends = np.cumsum(count)
        out = np.concatenate(pool)[np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        return out, ends[starts[1:] + np.arange(n)]


_ids: dict[str | None, Ids] = {}


def encoder(path: str | None) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def ids_of(texts: list[str | None], path: str | None) -> list[bytes]:
    """Each text's ids and END, as little-endian unsigned 32-bit integers."""
    out, ends = encoder(path)(pa.array(texts, pa.string()))
    return [out[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


_PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def cut(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of n tokens: full ones, but for the first."""
    many = -(-n // size)
    doc = np.repeat(np.arange(len(n)), many)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = n[doc] - (many[doc] - 1) * size
    start = np.where(piece > 0, first + (piece - 1) * size, 0)
    return doc, piece, start, np.where(piece > 0, size, first)


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, length) of neighbouring texts of TEXT_BYTES together, one at least."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + TEXT_BYTES, side="right")))
        yield at, end - at
        at = end


def pieces(df: DataFrame, keys: list[str], text_col: str, size: int, path: str | None) -> DataFrame:
    """A row for each piece of each row: keys, piece, start, length, ids_crc32; null texts are empty.

    A key column whose name clashes with one of the others in any case is an error.
    """
    clash = {k.lower() for k in keys} & {n for n, _ in _PIECE}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    source = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").cast("string").alias(free_name(keys, "text")))
    schema = T.StructType([source.schema[k] for k in keys] + [T.StructField(n, t) for n, t in _PIECE])
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for at, many in _portions(whole.column(n_keys)):
                batch = whole.slice(at, many)
                ids, ends = encode(batch.column(n_keys))
                doc, piece, start, length = cut(np.diff(ends, prepend=0), size)
                raw = memoryview(ids.astype("<u4")).cast("B")
                begin = (ends[doc - 1] * (doc > 0) + start) * 4
                crc = [zlib.crc32(raw[a : a + 4 * b]) for a, b in zip(begin.tolist(), length.tolist())]
                arrays = [batch.column(i).take(pa.array(doc)) for i in range(n_keys)]
                arrays += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, cap: Capacity, alike: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and its offset there; items are taken from the longest down.

    An item goes to the open bin that can take it under every constraint and whose remainders are
    then least in weighted norm (by="norm"), or whose remainders have the largest weighted dot
    product with the item's demands (by="dot"); of equal bins, the one opened first.  Neighbouring
    items of one length with equal values in `alike` never share a bin.  No items give no bins.

    Open bins are kept by their room for tokens.  That alone bounds how good a bin can be, so the
    search starts at the best room and ends where no other can win.
    """
    caps = (float(cap.tokens), float(cap.documents), float(cap.attention))
    w = cap.weights
    dot = cap.by == "dot"
    n = len(lengths)
    where, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return where, offset
    if lengths.max() > cap.tokens or float(lengths.max()) ** 2 > cap.attention or cap.documents < 1:
        raise ValueError("a piece is larger than a sequence may be")
    shortest = int(lengths.min())
    by_room: list[list[int]] = [[] for _ in range(cap.tokens + 1)]
    filled = 0  # bit r is set where by_room[r] has bins
    documents: list[int] = []
    attention: list[int] = []
    order = np.argsort(-lengths, kind="stable").tolist()
    last: tuple[int, object] | None = None
    shut: set[int] = set()
    for i in order:
        need = int(lengths[i])
        if alike is not None:
            now = (need, alike[i])
            if now != last:
                last, shut = now, set()
        cost = need * need
        best, best_bin, best_room = None, -1, -1
        left = filled >> need
        while left:
            step = left.bit_length() - 1 if dot else (left & -left).bit_length() - 1
            room = need + step
            if dot:
                bound = -(w[0] * (room / caps[0]) * (need / caps[0]) + w[1] / caps[1] + w[2] * cost / caps[2])
            else:
                bound = w[0] * ((room - need) / caps[0]) ** 2
            if best is not None and bound > best:
                break
            for b in by_room[room]:
                if attention[b] < cost or b in shut:
                    continue
                if dot:
                    score = -(w[0] * (room / caps[0]) * (need / caps[0]) + w[1] * (documents[b] / caps[1]) / caps[1] + w[2] * (attention[b] / caps[2]) * (cost / caps[2]))
                else:
                    score = w[0] * ((room - need) / caps[0]) ** 2 + w[1] * ((documents[b] - 1) / caps[1]) ** 2 + w[2] * ((attention[b] - cost) / caps[2]) ** 2
                if best is None or score < best or (score == best and b < best_bin):
                    best, best_bin, best_room = score, b, room
            left = left & ~(1 << step)
        if best is None:
            best_bin, best_room = len(documents), cap.tokens
            documents.append(cap.documents)
            attention.append(cap.attention)
        else:
            by_room[best_room].remove(best_bin)
            if not by_room[best_room]:
                filled &= ~(1 << best_room)
        where[i], offset[i] = best_bin, cap.tokens - best_room
        if alike is not None:
            shut.add(best_bin)
        documents[best_bin] -= 1
        attention[best_bin] -= cost
        room = best_room - need
        if documents[best_bin] and attention[best_bin] >= shortest * shortest and room >= shortest:
            by_room[room].append(best_bin)
            filled |= 1 << room
    return where, offset


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: Capacity = Capacity(), path: str | None = None, group: int = GROUP,
    apart: bool = False,
) -> DataFrame:
    """A row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end token alone.  Repeated rows are packed each.  Documents over the
    capacity are cut, others never.  A piece as long as a sequence is one by itself.  The others are
    dealt by a hash into groups of about `group` pieces, each packed on its own: the hash of (id,
    piece) also spreads a very long document, and a group leaves one sequence part-filled at most.
    With apart, rows of one id and piece never share a sequence, as copies of a document shouldn't.  Only ids and lengths are written and shuffled.  Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    size = min(cap.tokens, int(cap.attention**0.5))
    made = scratch.write(pieces(df, [id_col], text_col, size, path))
    full = F.col("length") == cap.tokens
    rest = made.filter(~full)
    groups = max(1, -(-rest.count() // group))
    g = free_name(made.columns, "group")
    rest = rest.withColumn(g, F.pmod(F.xxhash64(f"`{id_col}`", "piece"), F.lit(groups)).cast("long"))
    places = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*made.schema.fields, *places])
    by = [("length", "descending"), *[(c, "ascending") for c in (id_col, "piece", "ids_crc32")]]

    def run(table: pa.Table) -> pa.Table:
        base = table.column(g)[0].as_py() << 32
        table = table.drop_columns([g]).sort_by(by)
        alike = list(zip(table.column(id_col).to_pylist(), table.column("piece").to_pylist())) if apart else None
        where, offset = best_fit(table.column("length").to_numpy(), cap, alike)
        return table.append_column("sequence_id", pa.array(base + where)).append_column("offset", pa.array(offset))

    alone = made.filter(full).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return rest.groupBy(g).applyInArrow(run, schema).unionByName(alone)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens of all documents; a null text is its end token, repeated rows are packed each, and no document gives no row."""
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
