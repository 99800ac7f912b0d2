import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from skymatch.llm import features, mixing, quality, token_counts
from skymatch.llm.queries import op6_quality

DATA = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = op6_quality(spark, DATA).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97


def test_quality_without_labels_and_odd_rows(spark, odd, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["quality_score"] for r in quality.scored(odd, quality.fit(odd, none)).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1, None), (5, 0, 0), (3, None, 1), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(odd, quality.fit(odd, some)).collect()
    assert len(rows) == odd.count() and all(0 <= r["quality_score"] <= 1 for r in rows) and rows[0]["id"] == "clash"
    assert len({r["quality_score"] for r in rows if r["text"] in (None, "")}) == 1
    assert quality.scored(make([]), quality.fit(odd, some)).count() == 0


def test_rates_meet_targets(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.fit_domains(docs, labels)
    rows = mixing.with_posteriors(docs, model).select("row.doc_id", "n_tokens", "chances").cache()
    targets = {k: (3.0 if k == "fr:1" else 1.0) for k in model.names}
    fit = mixing.fit_rates(rows, model.names, targets)
    got = rows.select("doc_id", "n_tokens", "chances", fit.rate.alias("r")).toPandas()
    assert (got.r >= 0).all()
    p, n = np.array(got.chances.tolist()), got.n_tokens.to_numpy()
    reached = (p * (got.r.to_numpy() * n)[:, None]).sum(axis=0)
    assert np.allclose(reached, fit.reached, rtol=1e-6)
    held = (p * n[:, None]).sum(axis=0)
    aim = np.array([targets[k] for k in model.names]) / sum(targets.values()) * held.sum()
    assert np.allclose(reached, aim, rtol=1e-3)
    assert np.abs(reached - aim).sum() < 0.35 * np.abs(held - aim).sum()


def test_mixing_keeps_documents_with_a_floor(spark, odd, make):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(odd, labels, least=1.0)
    assert got.columns == odd.columns
    assert got.exceptAll(odd).count() == got.count() - odd.count() and odd.exceptAll(got).count() == 0
    assert mixing.rates(make([]), labels).count() == 0
    assert mixing.rates(odd, labels.limit(0)).where("rate >= 0").count() == odd.count()


def brute(word, starts, pieces):
    at, n, known = 0, 0, starts
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1
        at, n, known = end, n + 1, pieces
    return n


def test_automaton_equals_greedy_matching():
    r = np.random.default_rng(4)
    for _ in range(60):
        make = lambda k: {"".join(r.choice(list("abc"), r.integers(1, 6))) for _ in range(k)}
        starts, pieces = make(12), make(12)
        automaton = token_counts.Automaton(starts, pieces)
        for _ in range(60):
            word = "".join(r.choice(list("abcd"), r.integers(1, 14), p=[0.32, 0.32, 0.32, 0.04]))
            assert automaton.count(word) == brute(word, starts, pieces), (word, starts, pieces)


def test_counts_of_whole_texts(odd, make):
    path = public_tokenizers.path("byte_bpe_50k.json")
    starts, pieces = token_counts.vocabulary(path)
    letters = token_counts.byte_alphabet()
    got = token_counts.token_counts(odd, path).collect()
    for row, r in zip(odd.collect(), got, strict=True):
        words = (row["text"] or "").split()
        if len(words) < 1000:
            assert r["n_tokens"] == sum(brute("".join(letters[b] for b in w.encode()), starts, pieces) for w in words)
        assert r["n_words"] == len(words) and r["doc_id"] == row["doc_id"]
    assert token_counts.token_counts(make([]), path).count() == 0


def test_fold_is_the_crc_of_the_text_form(spark):
    row = spark.range(5).select(F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).collect()
    assert [r["c"] for r in row] == [zlib.crc32(str(i).encode()) for i in range(5)]


def test_ranking_equals_an_independent_minimiser():
    """Newton steps on the same pairs end at the same weights; the threshold is what a sort of the scores gives."""
    r = np.random.default_rng(2)
    better, worse = r.standard_normal((80, 6)) + [1, 0.5, 0, 0, 0, 0], r.standard_normal((60, 6))
    got = features.rank_weights(better, worse, pairs=3000, rounds=4000, penalty=1e-2, seed=3)
    draw = np.random.default_rng(3)
    diff = better[draw.integers(0, 80, 3000)] - worse[draw.integers(0, 60, 3000)]
    w = np.zeros(6)
    for _ in range(30):
        p = 1 / (1 + np.exp(diff @ w))
        w += np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / 3000 + 1e-2 * np.eye(6), diff.T @ p / 3000 - 1e-2 * w)
    assert np.allclose(got, w, atol=1e-4)
    short = features.rank_weights(better, worse, pairs=3000, penalty=1e-2, seed=3)  # the rounds that the operator takes
    assert np.corrcoef(short, w)[0, 1] > 0.999


def test_threshold_is_the_quantile_of_the_training_scores(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    held = docs.join(labels.select("doc_id", "quality"), "doc_id").select("text", "quality").collect()
    raw = sorted(float((features.standard(np.array([features.features(r["text"])]), model.mean, model.spread) @ model.weights)[0]) for r in held)
    low = sum(r["quality"] == 0 for r in held)
    assert abs(model.threshold - (raw[low - 1] + raw[low]) / 2) < 1e-3 and sum(x < model.threshold for x in raw) == low


def test_repeated_rows_of_a_labelled_id_are_gathered_once(spark):
    docs = spark.createDataFrame([(1, f"good text {k % 2}") for k in range(500)] + [(2, "bad")] * 500, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    once = docs.where("text <> 'good text 1'").dropDuplicates()
    a, b = (quality.fit(d, labels) for d in (docs, once))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold
    a, b = (mixing.fit_domains(d, labels) for d in (docs, once))
    assert a.names == b.names == ["en:0", "en:1"] and np.array_equal(a.weights, b.weights)
