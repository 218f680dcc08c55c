"""Vectors of several lengths in one table."""

import numpy as np

from rangeloom.llm import embed_dedup


def test_each_length_links(spark):
    gen = np.random.default_rng(8)
    rows, wanted = [(0, [1.0, 2.0, 3.0])], {0: 0}  # one short row with the lowest id
    for size, at in ((24, 100), (16, 300)):
        for k in range(30):
            v = gen.normal(size=size)
            for n in range(2):
                rows.append((at + 2 * k + n, (v + n * 1e-4).tolist()))
                wanted[at + 2 * k + n] = at + 2 * k
    got = embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id: r.component_id for r in got} == wanted
