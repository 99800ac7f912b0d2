import random
import re
from collections import Counter

import numpy as np
import pytest
from skymatch.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least_docs=10, ranks=10):
    """Rows of (text, lang, source) to the audit's rows, by plain integers."""
    rows = [tuple(v or "" for v in r) for r in rows]
    words = [[m.translate({c: c + 32 for c in range(65, 91)}) for m in TERM.findall(t)] for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(w, r[2]) for w, r in zip(words, rows, strict=True) if r[1] == lang]
        seen = Counter(t for w, _ in own for t in set(w))
        kept = sorted(t for t, n in seen.items() if n >= least_docs)
        count = {s: Counter(t for w, x in own if x == s for t in w) for s in {x for _, x in own}}
        every = Counter(t for w, _ in own for t in w)

        def prices(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        price, whole = {s: prices(c) for s, c in count.items()}, prices(every)
        cost = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = sorted(((-sum(cost(price[s][t], price[o][t]) for t in kept), o.encode()) for o in count if o != s))
            terms = sorted(((-cost(price[s][t], whole[t]), t.encode()) for t in kept if c[t] and price[s][t] > whole[t]))[:ranks]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("Sol", "mar", "Über", "été", "x", "日") for b in ("a", "E", "ñ", "zz", "q", "Ä")]
    rows = []
    for _ in range(n):
        lang, source = r.choice([("en", "a"), ("en", "b"), ("en", None), ("en", "a")] * 2 + [("de", "a"), ("de", "ü"), (None, "c")])
        text = r.choice(["-", " ", "7", "\n_"]).join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randrange(30)))
        rows.append((r.choice([text] * 20 + [None, "", "12 34"]), lang, source))
    return rows + [("", "fr", "only"), (None, "fr", "other"), ("rare words only", "it", "x"), ("no", "it", "y")]


@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_equals_plain_integers(spark, chunk):
    rows = corpus(chunk)
    docs = spark.createDataFrame([(*r, k, 1, "n") for k, r in enumerate(rows)], "text string, lang string, source string, id int, n int, term string").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(docs, chunk=chunk).collect())
    want = brute(rows)
    assert got == want and {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)


def test_task_passes_counts_on(spark, monkeypatch):
    rows = corpus(3)
    want = brute(rows, 3)
    monkeypatch.setattr(divergence, "HELD", 1)
    assert sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=3).collect()) == want


def test_odd_and_empty_tables(spark, odd, make):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audit(odd, least_docs=2).collect()) == brute(rows, 2)
    assert divergence.audit(make([])).collect() == []


def test_gallop_and_prices():
    r = np.random.default_rng(2)
    for few, many in ((0, 5), (5, 0), (1, 1), (3, 5000), (900, 1000), (1000, 100_000)):
        a, b = np.sort(r.choice(200_000, few, replace=False)), np.sort(r.choice(200_000, many, replace=False))
        assert (divergence.gallop(a, b) == np.searchsorted(b, a)).all()
    n = np.array([0, 1, 7, 10**12, 8 * 10**14], "i8")
    total, kept = int(n.sum()), 10**9
    assert divergence.prices(n, total, kept).tolist() == [1 + 10**9 * (int(x) + 2) // (total + 2 * kept) for x in n]


def test_shares_in_sql_equal_those_in_arrays(spark):
    from pyspark.sql import functions as F

    rows = [(n, total, kept) for total, kept in ((0, 1), (5, 3), (10**15, 10**9)) for n in (0, 1, 5, total) if n <= total]
    got = spark.createDataFrame(rows, "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 2) // (total + 2 * kept) for n, total, kept in rows]
