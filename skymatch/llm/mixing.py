"""Mixing sources to target weights with soft membership.

1. A classifier learned from the labelled table predicts, for every document,
   the chance of each domain. A domain is a language with a quality label
   ('en:1'); a document may belong to several in part.
2. Document rates r >= 0 are fitted by projected gradient steps from 1, so that the
   expected tokens of each domain, sum of r * tokens * chance, meet the targets in
   the least-squares sense. A step moves each rate against the gradient, which is a
   document's chances times one number a domain, and cuts it at the least rate. The
   numbers are the domains' errors, preconditioned by how their tokens answer to
   moves of the rates that are free; of a step that does not help the best of its
   halves, quarters and so on is taken, all of them tried in one aggregate. Each step
   is two or three aggregates over the whole table; rates are written every few steps.
   Rates move along chances only and so stay near 1. Targets that no rates reach
   are warned of.

The driver holds the model and a matrix of domains by domains.

Defined results: null and empty texts have no tokens, so their rate does not
matter to the fit and follows their chances; without labelled rows there is one
domain, '*'; targets for unknown domains are ignored; a domain without a target
aims at none of the tokens; an id with several quality labels counts for each, and
of several documents under a labelled id the smallest is learned from; rows that
repeat id and text are rated and rounded alike; null ids are rated like others; a
text of any length is taken whole, with the memory of its words; an empty table
gives no rows; other columns stay.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batched, materialise
from .features import WIDTH, class_weights, features, posteriors, scaling, standard

#: Labelled rows to learn from, at most.
SAMPLE = 8_000


@dataclass
class Domains:
    names: list[str]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # (features + 1, domains)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return posteriors(np.hstack([standard(x, self.mean, self.spread), np.ones((len(x), 1))]) @ self.weights)


def fit_domains(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Domains:
    """Learn domains from the documents that ``labels(doc_id, quality)`` lists."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    joined = docs.select("doc_id", F.struct("text", F.coalesce("lang", F.lit("?")).alias("lang")).alias("d")).join(F.broadcast(chosen), "doc_id")
    joined = joined.groupBy("doc_id", "quality").agg(F.min("d").alias("d")).select("d.text", "d.lang", "quality")

    def run(batches):
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.binary())], ["domain", "x"])

    rows = batched(joined.select("text", F.concat_ws(":", "lang", F.col("quality").cast("string")).alias("domain"))).mapInArrow(run, "domain string, x binary").collect()
    rows.sort(key=lambda r: (r["domain"], bytes(r["x"])))
    names = sorted({r["domain"] for r in rows})
    if len(names) < 2:
        return Domains(names or ["*"], np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH + 1, 1)))
    x = np.array([np.frombuffer(r["x"], "f4") for r in rows])
    mean, spread = scaling(x)
    return Domains(names, mean, spread, class_weights(standard(x, mean, spread), np.array([names.index(r["domain"]) for r in rows]), len(names)))


def with_posteriors(docs: DataFrame, model: Domains, text_col: str = "text") -> DataFrame:
    """``(row, key, n_tokens, chances)`` without a shuffle: each document's own row, a hash of its id and text, its words, and a chance a domain."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column(0).flatten()[at].to_pylist()  # the text travels once, inside its row
                p = model.predict(np.array([features(t) for t in texts], "f4").reshape(-1, WIDTH))
                tokens = pa.array([len((t or "").split()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tokens, pa.array(list(p), pa.list_(pa.float64()))], ["row", "key", "n_tokens", "chances"])

    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", text_col).alias("key"))
    return batched(rows).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("chances", T.ArrayType(T.DoubleType()))]))


def rate(moves: list[list[float]], least: float, start: Column | None = None) -> Column:
    """A document's rate after the given moves: a chain of projected steps along its ``chances``, from ``start`` (1)."""
    out = F.lit(1.0) if start is None else start
    for m in moves:
        out = F.greatest(F.lit(float(least)), out - _along(m))
    return out


def _along(m) -> Column:
    return sum((F.get("chances", k) * F.lit(float(v)) for k, v in enumerate(m)), F.lit(0.0))


@dataclass
class Fit:
    names: list[str]
    targets: list[float]
    reached: list[float]
    moves: list[list[float]]
    rate: Column

    def residuals(self) -> dict[str, float]:
        """By domain, how far the reached tokens are from the target, as a share of the target (of one token at least)."""
        return {n: (r - t) / max(1.0, t) for n, r, t in zip(self.names, self.reached, self.targets, strict=True)}


def least_total(rows: DataFrame, k: int, targets: list[float] | None = None, least: float = 1.0) -> float | None:
    """The smallest total of ``rows(n_tokens, chances)`` at which some rates ``least + sum of chances * y``, all y >= 0, meet the weights ``targets``.

    Chances are soft: who repeats one domain adds a little to the others, so that a
    domain cannot stay at its own tokens while others grow. With C the sums of
    chances by chances, the domains have ``least * own + C y`` tokens and, as a
    row's chances add up to 1, C times ones is their own tokens; so y >= 0 means
    ``total * inverse(C) weights >= least``, domain by domain. None if no total
    does it, as where a weight is lower than what leaks into the domain. One
    aggregate. ``targets`` None: the square roots of the domains' tokens.
    """
    curve = _curvature(rows, F.lit(1.0), F.lit(0.0), 0.0, k)
    held = curve.sum(axis=1)
    has = held > 0
    aim = np.sqrt(held) if targets is None else np.maximum(0.0, np.array(targets, "f8"))
    if not has.any() or aim.sum() <= 0 or (aim[~has] > 0).any():
        return None
    root = np.sqrt(held[has])
    a = np.linalg.solve(curve[np.ix_(has, has)] / np.outer(root, root) + 1e-12 * np.eye(len(root)), aim[has] / aim.sum() / root) / root
    return float(least / a.min()) if a.min() > 0 else None


#: How far over the limit a total goes if no total can be met without lowering some rates.
ROOM = 1.02


def reachable_total(rows: DataFrame, k: int, targets: list[float] | None = None, least: float = 1.0) -> float:
    """`least_total`; if there is none, ``ROOM`` times the total at which the domain that weighs least for its tokens stays at its own.

    At that limit itself what leaks into the domain as others grow puts it over its
    target at any rates, so that a fit creeps on without an end; a little more is met in few steps.
    """
    held = _sums(rows, F.lit(1.0), k)
    found = least_total(rows, k, targets, least)
    if found is None:
        aim = np.sqrt(held) if targets is None else np.maximum(0.0, np.array(targets, "f8"))
        found = ROOM * max([0.0, *(least * h * aim.sum() / a for h, a in zip(held, aim, strict=True) if a > 0 and h > 0)])
    return max(float(held.sum()), found)


#: Steps after which the rates are written, and halvings of a step that does not help.
WRITTEN, HALVINGS = 6, 12


def fit_rates(rows: DataFrame, names: list[str], targets: dict[str, float] | None, total: float | None = None, least: float = 0.0, close: float = 1e-3, steps: int = 100) -> Fit:
    """Fit rates over ``rows(n_tokens, chances)``; ``targets`` are weights, scaled to ``total`` tokens.

    None weighs the domains by the square root of their tokens. With ``least``
    over 0 no rate falls below it and, unless ``total`` is given, the total is
    what lets every domain reach its target by repetition. Steps go on until each
    domain is within a tenth of ``close`` of its target, or none helps.
    """
    k = len(names)
    held = _sums(rows, F.lit(1.0), k)
    now = max(1.0, held.sum())
    aim = np.sqrt(held) if targets is None else np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    aim = aim / aim.sum() if aim.sum() > 0 else held / now
    if total is None:
        total = now if least <= 0 else max([now, *(least * h / a for h, a in zip(held, aim, strict=True) if a > 0 and h > 0)])
    aim = aim * total
    worth = np.maximum(held, 1.0)  # errors are weighed by a domain's own tokens
    far = lambda reached: float((np.square(reached - aim) / worth).sum())
    near = lambda reached: bool((np.abs(reached - aim) <= 0.1 * close * np.maximum(1.0, aim)).all())
    state, done, moves, reached = rows.select("n_tokens", "chances"), 0, [], held
    while not near(reached) and len(moves) < steps:
        if len(moves) - done >= WRITTEN:
            state, done = materialise(state.select("n_tokens", "chances", rate(moves[done:], least, F.col("r") if done else None).alias("r")), "rates"), len(moves)
        at = rate(moves[done:], least, F.col("r") if done else None)
        error = reached - aim
        curve = _curvature(state, at, _along(error / worth), least, k)
        root = np.sqrt(worth)  # domains of all sizes alike
        move = np.linalg.solve(curve / np.outer(root, root) + 1e-9 * np.eye(k), error / root) / root
        found = _sums(state, F.greatest(F.lit(float(least)), at - _along(move)), k)
        if far(found) >= far(reached) * (1 - 1e-6):
            tried = _shorter(state, at, move, least, k)
            best = min(tried, key=lambda h: far(tried[h]), default=0)
            found, move = tried.get(best, found), move / 2**best
        if far(found) >= far(reached) * (1 - 1e-6):
            break
        moves, reached = [*moves, move.tolist()], found
    fit = Fit(names, aim.tolist(), reached.tolist(), moves, rate(moves, least))
    over = {n: round(x, 4) for n, x in fit.residuals().items() if abs(x) > close}
    if over:
        warnings.warn(f"mixing: shares of the targets that are over or missing: {over}", stacklevel=2)
    return fit


def _curvature(rows: DataFrame, r: Column, slope: Column, least: float, k: int) -> np.ndarray:
    """How the domains' tokens answer to moves: sums of chances by chances over the rows that are free, not held at ``least`` by their slope."""
    free = (F.col("r") > F.lit(float(least))) | (F.col("slope") < 0)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    seen = rows.select("n_tokens", "chances", r.alias("r"), slope.alias("slope")).where(free)
    row = seen.agg(*[F.sum(F.col("n_tokens") * F.get("chances", i) * F.get("chances", j)).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), x in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = x or 0.0
    return out


def _sums(rows: DataFrame, r: Column, k: int) -> np.ndarray:
    """By domain, the expected tokens at rate ``r``."""
    rated = rows.select("n_tokens", "chances", r.alias("rated"))
    row = rated.agg(*[F.sum(F.col("rated") * F.col("n_tokens") * F.get("chances", i)).alias(f"s{i}") for i in range(k)]).first()
    return np.array([x or 0.0 for x in row])


def _shorter(rows: DataFrame, r: Column, move: np.ndarray, least: float, k: int) -> dict[int, np.ndarray]:
    """The domains' expected tokens after a half, a quarter and so on of ``move``, by the number of halvings: all in one aggregate."""
    at = rows.select("n_tokens", "chances", r.alias("r"), _along(move).alias("move"))
    each = at.select("*", F.explode(F.array(*[F.lit(h) for h in range(1, HALVINGS)])).alias("h"))
    rated = each.select("n_tokens", "chances", "h", F.greatest(F.lit(float(least)), F.col("r") - F.col("move") * F.pow(F.lit(0.5), "h")).alias("rated"))
    sums = rated.groupBy("h").agg(*[F.sum(F.col("rated") * F.col("n_tokens") * F.get("chances", i)).alias(f"s{i}") for i in range(k)])
    return {row[0]: np.array([x or 0.0 for x in row[1:]]) for row in sums.collect()}  # a row a halving


def copies(r: Column, key: Column) -> Column:
    """How often a document is taken: its rate, rounded up or down by a hash of its key (a hash of id and text), right on average."""
    share = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(r + share).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, least: float = 0.0, most: int | None = None) -> DataFrame:
    """``docs`` with every row repeated (or left out) by its rate, ``most`` times at most if given. Columns stay as they are.

    With ``least`` over 0 the total is the smallest at which all targets are met exactly, if there is one (`reachable_total`).
    """
    model = fit_domains(docs, labels)
    rows = materialise(with_posteriors(docs, model), "posteriors")
    weights = None if targets is None else [targets.get(n, 0.0) for n in model.names]
    total = reachable_total(rows, len(model.names), weights, least) if least > 0 else None
    fit = fit_rates(rows, model.names, targets, total, least)
    times = copies(fit.rate, F.col("key"))
    taken = rows.select("row", (times if most is None else F.least(times, F.lit(most))).alias("times")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``(doc_id, n_tokens, domain, chance, rate, copies)`` for every document."""
    model = fit_domains(docs, labels)
    rows = materialise(with_posteriors(docs.select("doc_id", "text"), model).select("row.doc_id", "key", "n_tokens", "chances"), "posteriors")
    fit = fit_rates(rows, model.names, targets)
    best = F.array_position("chances", F.array_max("chances")).cast("int") - 1
    named = F.get(F.array(*[F.lit(n) for n in fit.names]), best)
    return rows.select("doc_id", "n_tokens", named.alias("domain"), F.array_max("chances").alias("chance"), fit.rate.alias("rate"), copies(fit.rate, F.col("key")).alias("copies"))
