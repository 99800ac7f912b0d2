import numpy as np
import pytest
from skymatch.llm import mixing


def rows(spark, rare, soft, seed=1):
    """Three domains, the last with a share of about ``rare`` of the tokens."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(3000):
        k = 2 if i < 3 else i % 2
        p = np.full(3, 0.0)
        p[k] = 1.0
        if soft and k < 2:
            x = r.uniform(0, 0.4)
            p[k], p[1 - k] = 1 - x, x
        out.append((max(1, round(1e7 * rare / 3)) if k == 2 else int(r.integers(2000, 5000)), p.tolist()))
    return spark.createDataFrame(out, "n_tokens long, chances array<double>"), out


@pytest.mark.parametrize("soft", [False, True])
@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rare_domains_reach_their_targets(spark, soft, least):
    df, out = rows(spark, 1e-4, soft)
    fit = mixing.fit_rates(df.cache(), ["a", "b", "c"], None, least=least)
    got = df.select("n_tokens", "chances", fit.rate.alias("r")).collect()
    n, p, r = (np.array([x[c] for x in got], "f8") for c in ("n_tokens", "chances", "r"))
    assert (r >= least).all()
    reached = (p * (n * r)[:, None]).sum(axis=0)
    held = (p * n[:, None]).sum(axis=0)
    assert held[2] < 2e-4 * held.sum() and np.allclose(reached, fit.reached)
    aim = np.sqrt(held) / np.sqrt(held).sum()
    aim *= held.sum() if least == 0 else max(held.sum(), (held / aim).max())
    assert np.allclose(reached, aim, rtol=2e-3)
    assert np.allclose(reached, (p * (n * dual(n, p, aim, least))[:, None]).sum(axis=0), rtol=1e-3)
    steps = np.ones(len(n))  # the same projected steps, one after the other
    for m in fit.moves:
        steps = np.maximum(least, steps - p @ np.array(m))
    assert np.allclose(r, steps)


def dual(n, p, aim, least):
    """The rates nearest to 1 that meet ``aim``, by Newton steps on one multiplier a domain: an independent way."""
    u = np.zeros(p.shape[1])
    for _ in range(200):
        r = np.maximum(least, 1 - p @ u)
        free = (1 - p @ u > least)[:, None]
        slope = (p * (n * r)[:, None]).sum(axis=0) - aim
        u = u + np.linalg.solve((p * free * n[:, None]).T @ p + 1e-6 * n.sum() * np.eye(len(u)), slope) * 0.5
    return np.maximum(least, 1 - p @ u)


def test_written_rates_go_on_and_ill_targets_are_met(spark, monkeypatch):
    """Sharp cuts bring many documents to the bound, so that steps are many; they are written after each."""
    r = np.random.default_rng(9)
    p = r.dirichlet([0.3, 0.3, 0.3, 0.3], 2000)
    n = r.integers(1, 4000, 2000)
    df = spark.createDataFrame([(int(a), b) for a, b in zip(n, p.tolist(), strict=True)], "n_tokens long, chances array<double>").cache()
    monkeypatch.setattr(mixing, "WRITTEN", 1)
    fit = mixing.fit_rates(df, list("abcd"), {"a": 0.6, "b": 0.3, "c": 0.09, "d": 0.01}, total=float(n.sum()))
    rate = np.array([x["r"] for x in df.select(fit.rate.alias("r")).collect()])
    reached = (p * (n * rate)[:, None]).sum(axis=0)
    assert len(fit.moves) > 1 and rate.min() == 0 and np.allclose(reached, fit.reached)
    want = (p * (n * dual(n, p, np.array(fit.targets), 0.0))[:, None]).sum(axis=0)
    near = np.abs(want - fit.targets).max() < 1e-3 * n.sum()
    assert not near or max(map(abs, fit.residuals().values())) <= 1e-3


def test_targets_out_of_reach_are_reported(spark):
    df = spark.createDataFrame([(100, [0.5, 0.5]), (50, [0.6, 0.4])], "n_tokens long, chances array<double>")
    with pytest.warns(UserWarning, match="over or missing"):
        fit = mixing.fit_rates(df, ["a", "b"], {"a": 1.0, "b": 0.0})
    assert max(map(abs, fit.residuals().values())) > 0.1


def soft_rows(spark, seed=4):
    r = np.random.default_rng(seed)
    p = np.vstack([r.dirichlet(a, m) for a, m in (([9, 0.2, 0.1], 1500), ([0.2, 4, 0.1], 400), ([0.3, 0.1, 6], 100))])
    n = r.integers(0, 3000, len(p))
    return spark.createDataFrame([(int(a), b) for a, b in zip(n, p.tolist(), strict=True)], "n_tokens long, chances array<double>"), n, p


@pytest.mark.parametrize("least", [1.0, 0.5])
@pytest.mark.parametrize("targets", [None, [0.5, 0.3, 0.2]])
def test_the_least_total_is_met_exactly_and_no_smaller_one_is(spark, least, targets):
    df, n, p = soft_rows(spark)
    total = mixing.least_total(df, 3, targets, least)
    held = (p * n[:, None]).sum(axis=0)
    aim = np.sqrt(held) if targets is None else np.array(targets)
    aim = aim / aim.sum()
    curve = (p * n[:, None]).T @ p
    y = np.linalg.solve(curve, total * aim - least * held)  # by the definition, row by row of the table
    assert y.min() > -1e-6 and abs(y.min()) < 1e-6
    assert np.allclose((p * (n * (least + p @ y))[:, None]).sum(axis=0), total * aim)
    assert np.linalg.solve(curve, 0.999 * total * aim - least * held).min() < 0
    if total >= n.sum():
        fit = mixing.fit_rates(df, list("abc"), None if targets is None else dict(zip("abc", targets, strict=True)), total, least)
        assert len(fit.moves) <= 2 and max(map(abs, fit.residuals().values())) < 1e-4


def test_no_total_for_targets_below_what_leaks_in_and_none_for_empty_tables(spark):
    df, n, p = soft_rows(spark)
    assert mixing.least_total(df, 3, [1e-6, 0.5, 0.5]) is None
    assert mixing.least_total(df.limit(0), 3) is None
    assert mixing.least_total(df, 3, [0.0, 0.0, 0.0]) is None


def test_halvings_in_one_aggregate_equal_single_passes(spark):
    from pyspark.sql import functions as F

    df, n, p = soft_rows(spark)
    move = np.array([0.7, -3.0, 1.5])
    got = mixing._shorter(df, F.lit(1.25), move, 0.5, 3)
    assert sorted(got) == list(range(1, mixing.HALVINGS))
    for h, sums in got.items():
        rate = np.maximum(0.5, 1.25 - p @ (move / 2**h))
        assert np.allclose(sums, (p * (n * rate)[:, None]).sum(axis=0))


def leaking_rows(spark, seed=8):
    """One domain with most tokens, and two small ones that overlap: to repeat the one takes in more of the other than its target."""
    r = np.random.default_rng(seed)
    p = np.vstack([r.dirichlet(a, m) for a, m in (([30, 0.3, 0.3], 3000), ([1, 1, 4], 40), ([1, 2, 2], 20))])
    n = r.integers(1, 3000, len(p))
    return spark.createDataFrame([(int(a), b) for a, b in zip(n, p.tolist(), strict=True)], "n_tokens long, chances array<double>").cache(), n, p


def test_where_no_total_is_met_by_repetition_alone_a_little_more_is_met_in_few_steps(spark):
    df, n, p = leaking_rows(spark)
    held = (p * n[:, None]).sum(axis=0)
    limit = (held / np.sqrt(held)).max() * np.sqrt(held).sum()
    assert mixing.least_total(df, 3) is None
    total = mixing.reachable_total(df, 3)
    assert np.isclose(total, mixing.ROOM * limit)
    fit = mixing.fit_rates(df, list("abc"), None, total, 1.0)
    rate = np.array([x["r"] for x in df.select(fit.rate.alias("r")).collect()])
    assert rate.min() >= 1 and len(fit.moves) <= 15 and max(map(abs, fit.residuals().values())) < 1e-3
    assert np.allclose((p * (n * rate)[:, None]).sum(axis=0), fit.reached)
