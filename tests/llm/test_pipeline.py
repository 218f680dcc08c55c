"""The pipeline's stages over the smallest tables and over odd rows, against plain readings."""

import hashlib
import math
from collections import Counter

import corpus_pipeline as cp
from rangeloom.llm import packing, pii, toxicity
from rangeloom.llm.common import Scratch, read
from test_minhash import plain_groups

SF = "/root/testdata/sf0.001"


def plain_copies(rows, seed=17):
    """How often each (id, source, size) comes, by the Poisson distribution function at a hashed number."""
    size = Counter()
    for _, source, n in rows:
        size[source] += n or 0
    roots = sum(math.sqrt(x) for x in size.values())
    total = sum(size.values())
    out = Counter()
    for i, source, n in rows:
        if not size[source]:
            continue
        rate = math.sqrt(size[source]) / roots * total / size[source]
        u = (int(hashlib.md5(f"{seed}|{'null' if i is None else i}|0".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        p = reach = math.exp(-rate)
        k = 0
        while reach < u:
            k += 1
            p *= rate / k
            reach += p
        out[i] += k
    return out


def check_packed(rows, mixed, cap):
    """Pieces of every copy, whole, in sequences that hold them, and copies of one apart."""
    wanted = Counter()
    for r in mixed:
        raw = packing.ids_of([r.text], None)[0]
        n = len(raw) // 4
        first = n % cap.tokens or cap.tokens
        for k in range(-(-n // cap.tokens)):
            wanted[r.doc_id, k, 0 if not k else first + (k - 1) * cap.tokens, first if not k else cap.tokens] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == wanted
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= cap.tokens and len(own) <= cap.documents
        assert len({(r.doc_id, r.piece, r.start, r.length) for r in own}) == len(own)


def test_stages(spark):
    scratch = Scratch(spark)
    docs = read(spark, SF, "documents")
    machine = toxicity.train(docs, read(spark, SF, "labels"))
    clean = scratch.write(cp.drop_toxic(spark, docs, SF))
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = list(texts)
    kept = {i for i, p in zip(ids, machine.score([texts[i] for i in ids])) if p < toxicity.THRESHOLD}
    assert {r.doc_id for r in clean.collect()} == kept

    single = scratch.write(cp.drop_near_duplicates(spark, clean, SF))
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(plain_groups([(i, texts[i]) for i in kept]).values()))

    plain = scratch.write(cp.redact_personal_data(spark, single, SF))
    assert plain.columns == docs.columns and plain.count() == single.count()
    assert all(not pii.base_spans(r.text) for r in plain.collect())

    mixed = scratch.write(cp.mix_sources(spark, plain, SF))
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == +plain_copies([(r.doc_id, r.source, r.n_chars) for r in plain.collect()])
    check_packed(cp.pack_sequences(spark, mixed, SF).collect(), mixed.collect(), cp.CAPACITY)


def test_run(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 50


ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13), (3, "another text of that id", "en", "b", 23),
    (4, "ONE  two three", "en", None, 14), (None, "a text without an id", "en", "a", 20), (None, None, None, "a", None), (5, "write to a.b@c.de", None, "b", 17), (6, "w " * 5000, "en", "a", 10000),
]


def odd_folder(spark, folder, rows, labels):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, 1, "x") for r in rows], f"{kind}, replica int, score string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    folder = odd_folder(spark, tmp_path / "a", ODD, [(1, 1, 1), (None, 0, 1), (9, 0, None)])
    docs = read(spark, folder, "documents")
    scratch = Scratch(spark)
    for name, stage in cp.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, folder))
        assert docs.columns[:5] == cp.COLUMNS, name
        if name == "toxicity":
            assert docs.count() == len(ODD)
        if name == "near_duplicates":
            left = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
            assert [i for i, _ in left] == [-1, -1, 1, 3, 5, 6] and (3, "another text of that id") in left
        if name == "pii":
            assert {r.text for r in docs.collect() if r.doc_id == 5} == {"write to <EMAIL>"}
            wanted = plain_copies([(r.doc_id, r.source, r.n_chars) for r in docs.collect()])
    assert Counter(r.doc_id for r in docs.collect()) == +wanted
    check_packed(cp.pack_sequences(spark, docs, folder).collect(), docs.collect(), cp.CAPACITY)
    assert cp.run(spark, folder).count() > 0
    empty = odd_folder(spark, tmp_path / "b", [], [])
    assert cp.run(spark, empty).count() == 0
