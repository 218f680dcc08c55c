"""Near-duplicates by word shingles, against brute force over tuples of words."""

import random

import corpus_pipeline as cp
from pyspark.sql import functions as F
from rangeloom.llm import minhash, pii
from rangeloom.llm.common import Scratch, read, with_ids

SF = "/root/testdata/sf0.001"


def plain_groups(rows):
    """Each id's smallest reachable id by links of 0.8 or more on shingles of five words."""
    sets = []
    for i, t in rows:
        words = (t or "").lower().split()
        sets.append((i, {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)} - {()}))
    root = {i: i for i, _ in rows}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for at, (a, x) in enumerate(sets):
        for b, y in sets[:at]:
            if 10 * len(x & y) >= 8 * len(x | y):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in root}


def test_links_of_eight_tenths(spark, docs_of):
    gen = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one"), (None, "one two")]
    rows += [(800, "same id here twice ok"), (800, "another text under that id"), (801, "another text under that id")]
    for family in range(12):
        base = [gen.choice(words) for _ in range(gen.choice([40, 200, 600]))]
        for k in range(5):
            t = list(base)
            for _ in range(round(len(t) * k * 0.007)):
                t[gen.randrange(len(t))] = gen.choice(words)
            rows.append((10 * family + k, " ".join(t)))
    known = [r for r in rows if r[0] is not None]
    wanted = plain_groups(known)
    assert len(set(wanted.values())) < len(wanted) - 15
    for block in (2, minhash.BLOCK):
        got = minhash.near_duplicates(spark, docs_of(rows), block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == (None if r.doc_id is None else wanted[r.doc_id])
    single = minhash.representatives(spark, docs_of(rows)).collect()
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted(set(wanted.values()))
    assert sum(r.doc_id is None for r in single) == 1


def test_stage(spark):
    scratch = Scratch(spark)
    clean = scratch.write(cp.drop_toxic(spark, read(spark, SF, "documents"), SF))
    wanted = plain_groups([(r.doc_id, r.text) for r in clean.collect()])
    single = scratch.write(cp.drop_near_duplicates(spark, clean, SF))
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(wanted.values()))
    assert single.columns == clean.columns
    plain = scratch.write(cp.redact_personal_data(spark, single, SF))
    assert plain.count() == single.count() and all(not pii.base_spans(r.text) for r in plain.collect())
    mixed = scratch.write(cp.mix_sources(spark, plain, SF))
    assert cp.pack_sequences(spark, mixed, SF).filter("piece = 0").count() == mixed.count()


def test_ids_by_shuffle_or_broadcast(spark, docs_of):
    rows = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)]
    ids = spark.createDataFrame([(1,), (1,), (3,), (None,), (9,)], "x long")
    for most in (0, 100):
        for how, wanted in (("left_semi", ["a", "b", None]), ("left_anti", ["c", "d"])):
            got = with_ids(Scratch(spark), docs_of(rows), F.col("doc_id"), ids, how, most)
            assert sorted(r.text or "" for r in got.collect()) == sorted(t or "" for t in wanted)
            assert got.columns == docs_of(rows).columns
