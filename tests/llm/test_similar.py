import random

import corpus_pipeline
import numpy as np
import pytest
from skymatch.llm import simhash


def sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def brute(rows):
    held = [(i, sets(t)) for i, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = held[a][1], held[b][1]
            if label[a] != label[b] and 5 * len(x & y) >= 4 * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for v, (i, _) in zip(label, rows, strict=True):
        least[v] = min(least.get(v, i), i)
    return {i: least[v] for v, (i, _) in zip(label, rows, strict=True)}


def corpus(seed):
    """Texts with copies at similarities about 0.6 to 1, one large group of them, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(40)]
    rows = [(k, [word() for _ in range(r.choice([3, 6, 20, 60, 150]))] + (passage if k % 3 == 0 else [])) for k in range(60)]
    for k in range(180):
        text = list(r.choice(rows)[1]) if k % 2 else list(rows[4][1] + rows[7][1])
        for _ in range(r.randint(0, 4)):
            text[r.randrange(len(text))] = word()
        rows.append((100 + k, text))
    return [(i, " ".join(t)) for i, t in rows]


@pytest.mark.parametrize(("tile_rows", "block"), [(20, 300), (10_000, 1_000_000)])
def test_groups_equal_all_pairs(spark, make, tile_rows, block):
    rows = corpus(tile_rows)
    want = brute(rows)
    assert len(set(want.values())) < 0.9 * len(rows)
    got = simhash.similar_groups(make(rows), tile_rows=tile_rows, block=block).collect()
    assert {r["id"]: r["component"] for r in got} == want


def test_sets_at_the_border_differ_within_the_radius():
    """Bits in which sets at a similarity of 0.8 differ, against the radius, for set sizes from the smallest on."""
    r = np.random.default_rng(1)
    for n in (5, 6, 7, 9, 10, 15, 40, 300):
        far = []
        for _ in range(400):
            own = r.integers(0, 1 << 63, n, dtype="u8")
            m = n // 5 if n < 9 else n // 9  # left out, or exchanged
            other = own[m:] if n < 9 else np.concatenate([own[m:], r.integers(0, 1 << 63, m, dtype="u8")])
            d = np.bitwise_count(simhash.wide_fingerprint(own) ^ simhash.wide_fingerprint(other))
            far.append((int(d[:2].sum()), int(d.sum())))
        mean, spread = np.mean(far, axis=0), np.std(far, axis=0)
        reach = simhash.SHORT_RADIUS if n - m < simhash.SHORT else simhash.RADIUS
        assert (mean + 4.5 * spread < np.array(reach)).all(), n


def test_stage_drops_planted_copies_and_leaves_others(spark, make):
    r = random.Random(5)
    rows, copies = [], set()
    for k in range(40):
        text = [f"w{r.randrange(5000)}" for _ in range(204)]
        rows.append((k, " ".join(text)))
        for j, n in enumerate((1, 2, 3, 4, 6)):  # changed words: similarity 0.95 down to 0.74
            other = list(text)
            for x in range(n):
                other[20 + 30 * x] = f"new{k} {j}".replace(" ", "x") + str(x)
            i = 1000 + 10 * k + j
            rows.append((i, " ".join(other)))
            if 5 * len(sets(rows[-1][1]) & sets(" ".join(text))) >= 4 * len(sets(rows[-1][1]) | sets(" ".join(text))):
                copies.add(i)
    assert len(copies) == 160
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, make(rows), "").collect()}
    assert kept == {i for i, _ in rows} - copies == {i for i, c in brute(rows).items() if i == c}


def test_odd_rows(spark, odd, make):
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in simhash.keep_one(odd).collect()) == [(False, 1), (False, 2), (False, 5), (True, None)]
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.similar_groups(make([])).count() == 0 and simhash.keep_one(make([])).count() == 0


def test_one_document_of_each_group_stays(spark):
    a, b, c = "one two three four five six", "another text that is quite unlike", "the third of them all is here"
    names = ["row", "th", "_id", "_th", "id", "n", "first", "_row", "n1"]
    rows = [(3, a), (5, a), (5, b), (5, b), (None, b), (None, c), (None, c), (9, None), (8, "")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"doc_id long, text string, {', '.join(f'{n} int' for n in names)}")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(3, a), (5, b), (None, c), (8, "")], key=repr)
    assert [tuple(r)[2:] for r in got.collect()] == [tuple(range(len(names)))] * 4
