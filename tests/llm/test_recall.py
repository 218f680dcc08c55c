"""Recall of the embedding index against brute force, on the real table and at the threshold."""

import numpy as np
import pytest

from rangeloom.llm import embed_dedup
from rangeloom.llm.common import read


def brute_links(ids, x):
    x = embed_dedup.unit(x)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    return {int(i): int(n) for i, n in zip(ids, near.sum(1))}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_real_table(spark, sf):
    df = read(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [r for r in df.collect() if r.embedding]
    wanted = brute_links([r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float32))
    found = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark, df).collect()}
    assert all(found[i] <= n for i, n in wanted.items())
    assert sum(found.values()) >= 0.95 * sum(wanted.values())


def test_at_the_threshold(spark):
    gen = np.random.default_rng(4)
    base = embed_dedup.unit(gen.normal(size=(1500, 32)))
    other = gen.normal(size=base.shape)
    other = embed_dedup.unit(other - (other * base).sum(1, keepdims=True) * base)
    near = 0.905 * base + np.sqrt(1 - 0.905**2) * other
    x = np.concatenate([base, near])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for block in (embed_dedup.BLOCK, 16):
        found = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark, df, block=block).collect()}
        wanted = brute_links(range(len(x)), x)
        assert sum(wanted.values()) >= 3000 and all(found[i] <= n for i, n in wanted.items())
        assert sum(found.values()) >= 0.95 * sum(wanted.values())
