import random

import numpy as np
import xxhash
from skymatch.llm import graph, simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_definition():
    r = random.Random(3)
    for _ in range(50):
        text = " ".join(r.choice(["Ab", "É", "x\ty", "ÄB", "q"]) for _ in range(r.randint(0, 60)))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    for text in ("", None, " \n", "one", "A b\x0bC", " wide "):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("some wörds")).alias("h")).first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest("some wörds".encode(), seed=42)


def roots(n, near):
    label = list(range(n))
    while True:
        new = [min(label[j] for j in range(n) if near[i][j]) for i in range(n)]
        if new == label:
            return label
        label = new


def test_tiles_find_every_link():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 12, dtype="u8")
    fps = np.unique(np.concatenate([base[i % 12] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, k, dtype="u8")) for i, k in enumerate(r.integers(1, 5, 400))] + [base], axis=None))
    by = {}
    for f in fps:
        by.setdefault(int(np.bitwise_count(f)), []).append(f)
    edges = [e for p in by for q in by if p <= q <= p + 4 for e in simhash.compare(np.array(by[p]), np.array(by[q]), p == q, 4, rows=7, cols=11).tolist()]
    at = {int(f): i for i, f in enumerate(fps)}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    linked = np.eye(len(fps), dtype=bool)
    for a, b in edges:
        linked[at[a], at[b]] = linked[at[b], at[a]] = True
    assert roots(len(fps), near) == roots(len(fps), linked)
    assert len(edges) < near.sum() // 2


def test_groups_and_odd_rows(spark, odd, make):
    got = [(r["id"], r["fp"], r["component"]) for r in simhash.near_groups(odd).collect()]
    assert len(got) == odd.count()
    assert {c for i, f, c in got if f == 0} == {2} and sum(f == 0 for _, f, _ in got) == 3
    assert sorted(c for i, _, c in got if i in (1, 6)) == [1, 1, 1]
    assert simhash.near_groups(make([])).count() == 0
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in simhash.keep_one(odd).collect())
    assert kept == [(False, 1), (False, 2), (False, 5), (True, None)]


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = dict(graph.components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
