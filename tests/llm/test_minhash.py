import random

import numpy as np
import pytest
from skymatch.llm import minhash


def sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute(rows, least=85):
    held = [(i, sets(t)) for i, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = held[a][1], held[b][1]
            if label[a] != label[b] and x and y and 100 * len(x & y) >= least * len(x | y):
                label = [label[b] if v == label[a] else v for v in label]
    first = {}
    for v, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            first[v] = min(first.get(v, i), i)
    return sorted(((i, len(s), first.get(v)) for v, (i, s) in zip(label, held, strict=True)), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(r.choice([2, 5, 9, 30, 120]))] + passage * (k % 4 == 0) for k in range(50)]
    for k in range(n):
        text = list(r.choice(texts)) if k % 3 else texts[4] + texts[1]
        for _ in range(r.randint(0, 3)):
            text[r.randrange(len(text))] = word()
        texts.append(text)
    return [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, ""), (901, None), (902, " \t\n"), (903, "A b\tC d E"), (904, "a B c\nd e"), (905, "a b"), (906, "a  b"), (907, "a b c d e f")]


@pytest.mark.parametrize(("seed", "block"), [(1, 1_000_000), (2, 400)])
def test_classes_equal_all_pairs(spark, make, seed, block):
    rows = corpus(seed)
    want = brute(rows)
    assert len({c for *_, c in want}) < 0.8 * len(want)
    assert sorted((tuple(r) for r in minhash.near_groups(make(rows), block=block).collect()), key=str) == want


def test_odd_rows(spark, odd, make):
    long = odd.where("doc_id = 5").first()["text"]
    got = sorted((tuple(r) for r in minhash.near_groups(odd).collect()), key=str)
    want = [(1, 1, 1), (1, 1, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, len(sets(long)), 5), (6, 1, 1), (None, 1, None)]
    assert got == sorted(want, key=str)
    assert minhash.near_groups(make([])).collect() == []
    both = make([(None, "x y z"), (7, "x y z"), (8, "p q r s t u v"), (8, "other words under the same id")])
    assert sorted((tuple(r) for r in minhash.near_groups(both).collect()), key=str) == sorted([(None, 1, 7), (7, 1, 7), (8, 3, 8), (8, 2, 8)], key=str)


def test_signature_is_the_least_shifted_value():
    circle, coordinates = 64, 12
    place, value = minhash.circles(circle, coordinates)
    assert sorted(place) == list(range(circle)) and sorted(value[:, 0]) == list(range(circle))
    held = np.array([3, 64, 700, 701, 12345], "u8")
    want = [min(int(value[(int(place[int(h) % circle]) + k) % circle, 0]) for h in held) for k in range(coordinates)]
    assert minhash.signature(held, circle, coordinates).tolist() == want


def test_pairs_at_the_border_share_a_band():
    r = np.random.default_rng(5)
    for n in (7, 20, 100, 2000):
        a, b = r.integers(0, 1 << 63, (2, 600 if n < 1000 else 60, n), dtype="u8")
        m = max(1, int(n * 0.15 / 1.85)) if n > 7 else 0  # exchanged; the smallest sets lack one
        b[:, m:] = a[:, m:]
        if n == 7:
            b = b[:, 1:]
        keys = [minhash.band_keys(np.array([minhash.signature(h) for h in x])) for x in (a, b)]
        agree = (keys[0] == keys[1]).sum(axis=1)
        assert agree.min() > 0 and agree.mean() > 10
