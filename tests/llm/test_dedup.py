"""Operators on near and exact repeats, against brute force."""

import hashlib
import random

import numpy as np
import xxhash

from rangeloom.llm import embed_dedup, simhash, suffix_dedup
from rangeloom.llm.common import Scratch
from rangeloom.llm.components import components


def united(nodes, links):
    root = {n: n for n in nodes}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint():
    for t in ["", None, "A b", "É À b c", "one two three four FIVE\n\nsix", "a\x1cb c d e", "x " * 70_000 + "y z"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_masks_cover():
    masks = simhash.covering_masks()
    gen = random.Random(0)
    for _ in range(3000):
        bits = sum(1 << b for b in gen.sample(range(64), gen.randint(0, 3)))
        assert any(not bits & m for m in masks)


def test_components(spark):
    gen = random.Random(3)
    links = [(gen.randrange(300), gen.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)]
    links += [(500, i) for i in range(501, 600)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in components(Scratch(spark), df).collect()}
    wanted = united({n for p in links for n in p}, links)
    assert all(found.get(n, n) == c for n, c in wanted.items())
    assert components(Scratch(spark), df.limit(0)).count() == 0


def simhash_case(spark, docs_of, rows, block):
    got = simhash.near_duplicates(spark, docs_of(rows), block=block).collect()
    assert len(got) == len(rows)
    known = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    links = [(a, b) for a, x in known for b, y in known if (x ^ y).bit_count() <= 3]
    wanted = united({i for i, _ in known}, links)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else wanted[r.doc_id])


def test_simhash_links(spark, docs_of):
    gen = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [gen.choice(words) for _ in range(400)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (3, "same text here"), (3, "same text here"), (4, "same text here"), (None, "same text here")]
    for i in range(60):
        t = list(base)
        for _ in range(gen.randint(0, 6)):
            t[gen.randrange(400)] = gen.choice(words)
        rows.append((10 + i, " ".join(t)))
    rows += [(200 + i, " ".join(gen.choice(words) for _ in range(60))) for i in range(40)]
    rows += [(5, rows[8][1]), (5, "another text of the same id")]
    simhash_case(spark, docs_of, rows, 2048)
    simhash_case(spark, docs_of, rows, 7)


def test_simhash_representatives(spark, docs_of):
    rows = [(3, "same text here"), (3, "same text here"), (4, "same text here"), (None, "same text here"), (9, "other words stand here")]
    got = simhash.representatives(spark, docs_of(rows))
    assert sorted(r.doc_id or -1 for r in got.collect()) == [-1, 3, 9]
    assert got.columns == docs_of(rows).columns
    assert simhash.near_duplicates(spark, docs_of([(1, "a")]).limit(0)).count() == 0


def brute_repeats(rows):
    out, seen = {}, {}
    for i, t in sorted({r for r in rows if r[0] is not None}):
        for p in range(len(t) - 99):
            seen.setdefault(t[p : p + 100], (i, p))
    for i, t in rows:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - 99):
                if seen[t[p : p + 100]] < (i, p):
                    gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i, t] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def suffix_case(spark, docs_of, rows, **more):
    got = suffix_dedup.remove_repeats(spark, docs_of(rows), **more).collect()
    wanted = brute_repeats([(i, (t or "").encode()) for i, t in rows])
    assert len(got) == len(rows)
    left = sorted((repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got))
    assert left == sorted(repr((i, *wanted[i, (t or "").encode()])) for i, t in rows)


def passages():
    gen = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiouéß"]
    word = lambda: "".join(gen.choice(syllables) for _ in range(gen.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    rows = [(900, None), (901, ""), (902, "x" * 99), (903, "x" * 100), (904, "x" * 350), (905, "ab" * 300), (None, shared[0])]
    for i in range(40):
        parts = [text(gen.randint(0, 60)), gen.choice(shared), text(gen.randint(0, 30)), gen.choice(shared)[gen.randint(0, 40) :]]
        rows.append((i, " ".join(parts)))
    rows.append((50, rows[10][1]))
    t = rows[11][1]
    rows += [(60 + k, t[: 40 * k] + "#" + t[40 * k + 1 :]) for k in range(1, 8)]
    rows += [(70, rows[12][1])] * 2
    return rows


def test_suffix_repeats(spark, docs_of):
    suffix_case(spark, docs_of, passages())


def test_suffix_repeats_of_frequent_anchors(spark, docs_of):
    suffix_case(spark, docs_of, passages(), most_contexts=2)


def test_suffix_repeats_of_one_anchor(spark, docs_of):
    gen = random.Random(8)
    word = lambda n: "".join(gen.choice("abcdefghij ") for _ in range(n))
    core, sides = word(40), [word(60) for _ in range(6)]
    rows = [(i, word(20) + gen.choice(sides)[gen.randint(0, 30) :] + core + gen.choice(sides)[: gen.randint(5, 60)] + word(9)) for i in range(150)]
    rows += [(200 + i, word(70) + core + word(70)) for i in range(60)]
    for most in (1, 20, 4096):
        suffix_case(spark, docs_of, rows, most_contexts=most)


def test_classes_of_windows():
    gen = random.Random(9)
    texts = [t.encode() for _, t in passages() if t] + [bytes(gen.choices(b"ab", k=400))]
    data, ends = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])
    windows = {at - 100 for e, t in zip(ends, texts) for at in range(e - len(t) + 100, e + 1)}
    for width in (69, 35, 18, 9, 5, 3, 2, 1):
        core, _, first, count = suffix_dedup.contexts(data, ends, width=width)
        places = [f + i for f, n in zip(first, count) for i in range(n)]
        assert len(places) == len(windows) and set(places) == windows
        of, contents = {}, {}
        for c, f, n in zip(core.tolist(), first.tolist(), count.tolist()):
            for at in range(f, f + n):
                raw = data[at : at + 100].tobytes()
                assert of.setdefault(raw, c) == c
                contents.setdefault(c, set()).add(raw)
    assert all(len(x) == 1 for x in contents.values())


def test_suffix_segments(spark, docs_of, monkeypatch):
    data = [t.encode() for _, t in passages() if t]
    for piece in (1 << 22, 300):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", piece)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(range(len(data))), pa.array([d.decode() for d in data])], names=["a", "b"])
        windows = 0
        for _, raw, ends, _ in suffix_dedup._texts(batch):
            windows += suffix_dedup.contexts(raw, ends)[3].sum()
        assert windows == sum(max(0, len(d) - 99) for d in data)


def test_suffix_order():
    gen = random.Random(1)
    for _ in range(200):
        s = np.array([gen.randint(0, gen.choice([0, 1, 3])) for _ in range(gen.randint(0, 50))], dtype=np.int64)
        assert suffix_dedup.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_empty(spark, docs_of):
    assert suffix_dedup.remove_repeats(spark, docs_of([(1, "a")]).limit(0)).count() == 0


def embedded(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string, kept int")
    got = embed_dedup.near_duplicates(spark, df, **more).collect()
    assert len(got) == len(rows)
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and None not in v:
            x = np.array(v, dtype=np.float32).astype(np.float64)
            if np.isfinite(x).all() and x.any() and len(x) == 8:
                good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    m = np.stack([good[i] for i in ids])
    near = m @ m.T >= 0.9
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a != b]
    return got, links, united({r[0] for r in rows}, links)


def test_embeddings(spark):
    gen = np.random.default_rng(2)
    heads = gen.normal(size=(12, 8))
    rows = [(i, (heads[i % 12] + 0.12 * gen.normal(size=8)).tolist(), "x", 1) for i in range(200)]
    rows += [(300 + i, heads[0].tolist(), "x", 1) for i in range(5)]
    rows += [(400, None, "x", 1), (401, [0.0] * 8, "x", 1), (402, [None] + [1.0] * 7, "x", 1), (403, [float("nan")] * 8, "x", 1), (404, [float("inf")] * 8, "x", 1), (405, [], "x", 1), (406, (2 * heads[0]).tolist(), "x", 1)]
    for block in (1024, 9):
        got, links, wanted = embedded(spark, rows, block=block)
        found = sum(r.n_links for r in got)
        assert 0.9 * len(links) <= found <= len(links)
        assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in got if 400 <= r.vec_id < 406)
        assert sum(r.component_id == wanted[r.vec_id] for r in got) >= 0.9 * len(got)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string, kept int")
    assert embed_dedup.near_duplicates(spark, df.limit(0)).count() == 0
