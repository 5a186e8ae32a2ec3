"""All pairs of look-alike vectors come out, however many share a hash."""

from __future__ import annotations

import itertools
import random

from cueline.catalog import collect


def test_pairs_of_vectors_against_all_pairs(spark, tmp_path):
    """also the pairs of one hash, and those between copies of two hashes."""
    r = random.Random(2)
    kinds = [[r.random() for _ in range(64)] for _ in range(3)]
    near = list(kinds[0])
    near[5], near[6] = near[6], near[5]
    kinds.append(near)
    vectors = [(i, i % 2, kinds[i // 2 % 4]) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id bigint, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = {i: [v[j] > v[(j + 1) % 64] for j in range(64)] for i, _, v in vectors}
    want = set()
    for (a, x, _), (b, y, _) in itertools.combinations(vectors, 2):
        apart = sum(p != q for p, q in zip(bits[a], bits[b], strict=True))
        if x == y and apart <= 18:
            want.add((x, a, b, apart))
    assert len({n for *_, n in want}) > 1
    found = [tuple(row) for row in collect()[0]["similar_hashes"](spark, str(tmp_path)).select("session_id", "a", "b", "bits").collect()]
    assert len(found) == len(set(found)) and set(found) == want
