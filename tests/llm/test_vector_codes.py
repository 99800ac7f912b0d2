import hashlib
import math
import random

import numpy as np
import pytest
from skymatch.llm import vector_codes


def brute(rows, parts, entries, rounds, scale=1024):
    """(id, code, error, label_error, sha) of rows (id, vector, label), by plain integers."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = [near(v, p) for _, v, _ in kept]
            own = [[cut(v, p) for (_, v, _), e in zip(kept, at, strict=True) if e == k] for k in range(len(books[p]))]
            new.append([[sum(c) // len(c) for c in zip(*x, strict=True)] if x else books[p][k] for k, x in enumerate(own)])
        books = new
    codes = [[near(v, p) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(far(cut(v, p), books[p][e]) for p, e in enumerate(c)) for (_, v, _), c in zip(kept, codes, strict=True)]
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in code), e, by[label], sha) for (i, _, label), code, e in zip(kept, codes, errors, strict=True)), key=str)


def table(spark, rows):
    names = ["id", "row", "v", "code", "error", "part", "entry", "n", "s0", "label_error"]
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"vec_id long, embedding array<float>, label int, {', '.join(f'{n} int' for n in names)}").repartition(3)


def vectors(seed, n=200, dims=12, size=1.0):
    r = random.Random(seed)
    f = lambda x: float(np.float32(x))
    rows = [(k, [f(r.gauss(0, size)) for _ in range(dims)], r.choice([None, 1, 1, 2])) for k in range(n)]
    rows += [(1000 + k, rows[3][1], 1) for k in range(40)] + [(5, [f(-0.0005)] * dims, 2), (5, [f(0.25)] * dims, None), (None, [1.0] * dims, 2)]
    broken = [None, [0.1] * (dims - 1) + [None], [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [-math.inf] * dims]
    return rows + [(-1 - k, v, 1) for k, v in enumerate(broken)]


@pytest.mark.parametrize(("entries", "rounds", "block_rows", "size"), [(16, 4, 7, 0.2), (256, 4, 4096, 1.0), (5, 0, 50, 1.0), (20, 2, 64, 20_000.0)])
def test_equals_plain_integers(spark, entries, rounds, block_rows, size):
    rows = vectors(entries, size=size)
    got = vector_codes.compress(table(spark, rows), 4, entries, rounds, block_rows=block_rows)
    assert got.columns == ["id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4, entries, rounds)


def test_empty_tables_and_wrong_shapes(spark):
    assert vector_codes.compress(table(spark, [])).collect() == []
    assert vector_codes.compress(table(spark, [(1, None, 1), (2, [float("nan")] * 4, 2)])).collect() == []
    with pytest.raises(ValueError, match="divide"):
        vector_codes.compress(table(spark, [(1, [0.5] * 6, 1)]))
    for rows in ([(1, [0.5] * 8, 1), (2, [0.5] * 4, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match=r"one length|2 \*\* 28"):
            vector_codes.compress(table(spark, rows)).collect()


def test_blocks_round_trip(spark):
    r = np.random.default_rng(1)
    v = r.integers(-40, 40, (100, 6))
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "row long, v array<long>").repartition(2)
    found = vector_codes.blocks(rows, 6, 16).collect()
    seen = {}
    for b in found:
        block = vector_codes.Block(*map(bytes, b))
        assert len(block.ids) <= 16
        for i, x in zip(block.ids.tolist(), np.stack([d[c] for d, c in zip(block.values, block.codes, strict=True)], axis=1), strict=True):
            seen[i] = x.tolist()
    assert seen == dict(enumerate(v.tolist()))
