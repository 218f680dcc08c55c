"""Packing: the choice of bins against a plain scan of all of them, capacities that bind, copies, and long inputs."""

import random
import time

import numpy as np
import pytest

from rangeloom.llm import packing


def plain_fit(lengths, cap):
    """Every open bin is looked at for every item."""
    where = np.zeros(len(lengths), dtype=np.int64)
    room = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[i], 1, lengths[i] ** 2)
        caps = (cap.tokens, cap.documents, cap.attention)
        best = None
        for b, r in enumerate(room):
            if any(x < y for x, y in zip(r, need)):
                continue
            if cap.by == "dot":
                score = -sum(w * (x / c) * (y / c) for w, x, y, c in zip(cap.weights, r, need, caps))
            else:
                score = sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(cap.weights, r, need, caps))
            if best is None or score < best[0] - 1e-15:
                best = (score, b)
        if best is None:
            room.append(caps)
            best = (0, len(room) - 1)
        room[best[1]] = tuple(x - y for x, y in zip(room[best[1]], need))
        where[i] = best[1]
    return where


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("weights", [(1.0, 1e-3, 1e-3), (1.0, 0.5, 2.0)])
def test_choice_of_bins(by, weights):
    for seed, more in enumerate([{}, {"documents": 3}, {"attention": 40_000}, {"documents": 2, "attention": 50_000}]):
        lengths = np.random.default_rng(seed).integers(1, 200, 300)
        cap = packing.Capacity(tokens=256, weights=weights, by=by, **{"documents": 256, "attention": 65_536} | more)
        where, offset = packing.best_fit(lengths, cap)
        assert where.tolist() == plain_fit(lengths.tolist(), cap).tolist()
        for b in range(where.max() + 1):
            own = sorted(zip(offset[where == b].tolist(), lengths[where == b].tolist()))
            assert [a for a, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()


def test_each_capacity_binds():
    lengths = np.random.default_rng(2).integers(1, 400, 2000)
    plain, _ = packing.best_fit(lengths, packing.Capacity())
    for capacity in (packing.Capacity(documents=3), packing.Capacity(attention=200_000)):
        where, _ = packing.best_fit(lengths, capacity)
        assert np.bincount(where, lengths).max() <= 1024
        assert np.bincount(where).max() <= capacity.documents
        assert np.bincount(where, lengths**2).max() <= capacity.attention
        assert where.max() > plain.max()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([5, 2000]), packing.Capacity())
    assert len(packing.best_fit(np.zeros(0, dtype=int), packing.Capacity())[0]) == 0


def test_many_pieces():
    began = time.process_time()
    for most in (1025, 300):
        lengths = np.random.default_rng(1).integers(1, most, 100_000)
        where, _ = packing.best_fit(lengths, packing.Capacity())
        assert where.max() + 1 <= 1.01 * lengths.sum() / 1024
    assert time.process_time() - began < 60


def test_copies_part(spark):
    gen = random.Random(3)
    texts = [" ".join(["w"] * gen.choice([3, 40, 1500])) for _ in range(120)]
    rows = [(i, t, k) for i, t in enumerate(texts) for k in range(gen.choice([1, 1, 4]))]
    rows += [(None, None, 0), (None, None, 1), (7000, "x", None)]  # replica is an extra column
    df = spark.createDataFrame(rows, "doc_id long, text string, replica int")
    for group in (16, 4096):
        got = packing.pack(df, group=group, apart=True).collect()
        kinds = [(r.doc_id, r.piece, r.sequence_id) for r in got]
        assert len(set(kinds)) == len(kinds)
        assert len(got) == len(rows) + sum(len((t or "").split()) > 1024 for _, t, _ in rows)
    with pytest.raises(ValueError):
        packing.pack(df.withColumnRenamed("doc_id", "Start"), id_col="Start")


def test_white_space_and_special_tokens():
    from tokenizers import Tokenizer
    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    gen = random.Random(1)
    bits = ["a", "word", " ", "  ", "\n", "\n\n", "\t", "é", "'s", "12", "!", "...", "<|endoftext|>", "　", "中文", "\r", "x\x1c", "🙂", "\xa0", "\x85", "the"]
    texts = ["".join(gen.choice(bits) for _ in range(gen.randint(0, 12))) for _ in range(4000)] + ["x" * 100_000, "ab1" * 30_000, None]
    for made, text in zip(packing.ids_of(texts, None), texts):
        assert np.frombuffer(made, "<u4").tolist() == [*own.encode(text or "", add_special_tokens=False).ids, 2]
