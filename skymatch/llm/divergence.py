"""How far the word use of sources lies apart: a divergence audit in whole numbers.

Documents fall into groups, one for each source of a language. A language keeps
the terms that at least ``least_docs`` of its documents hold. A group gives each
kept term a smoothed price, its share in parts of a billion:
``p = 1 + floor(1e9 * (count + 2) / (N + 2 * V))``. Two groups differ at a term by
``floor((p - q) ** 2 / (p + q))``.

1. Each task counts the words of its texts by group before anything is
   shuffled; a marker row stands for the group itself.
2. Kept terms get gapless ids by language. A group's counts become sorted arrays of
   (id, count), cut into chunks of ``CHUNK`` ids, so that no task holds a whole
   vocabulary.
3. For each unordered pair of groups and each chunk, one task co-groups both arrays.
   A galloping search finds the shared terms; they, and those of one side, are
   priced. Terms that neither group has are all alike, so their number times one
   difference is added at the end. The sum counts for both directions.

All arithmetic is on whole numbers: prices are divided digit by digit, in base
1000, so counts up to 9e15 cannot overflow.

The result holds each source's distance to each other source of its language, so it
grows with the square of the number of sources; nothing else does but the copies of
arrays that the pairs read.

Defined results: null texts, languages and sources are empty strings, which are a
language and a source like any other; a text may have any length and is counted
whole, in the memory of its words; rows that repeat count again, whatever their
ids; a group without terms takes part with zero counts; a language that keeps no
term has distances 0; equal values rank by the item's UTF-8 bytes; an empty table
gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, materialise, number_within, small

#: The bytes of terms: Latin letters, small from the start, and all beyond ASCII. Others part terms.
LETTERS = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Counts that a task holds before it passes them on, and ids of a chunk.
HELD, CHUNK = 400_000, 1 << 16
#: Parts in which a share is told, and what is added to each count.
WHOLE, EXTRA = 1_000_000_000, 2


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term by group, and a row with a null term for each group."""

    def run(batches):
        seen: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def passed_on():
            for (lang, source), (n, held) in seen.items():
                terms = list(n)
                for k in range(0, len(terms) + 1, 10_000):
                    some = terms[k : k + 10_000] + [None] * (k + 10_000 > len(terms))
                    columns = [[lang] * len(some), [source] * len(some), some, [n[t] for t in some], [held[t] for t in some]]
                    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n, held = seen.setdefault((lang, source), (Counter(), Counter()))
                words = text.translate(LETTERS).split()
                n.update(words)
                held.update(set(words))
            if sum(len(n) for n, _ in seen.values()) > HELD:
                yield from passed_on()
        yield from passed_on()

    given = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).cast("binary")
    rows = batched(docs.select(given(lang_col).alias("lang"), given(source_col).alias("source"), given(text_col).alias("text")))
    found = rows.mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")
    named = found.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")
    # tasks have summed their rows: what is left to sum comes together by one shuffle, without another pass before it
    return named.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _whole(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers that are not negative."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column, kept: Column) -> Column:
    """The price of a term that occurs ``n`` times in a group of ``total`` occurrences of ``kept`` terms, in three digits of base 1000."""
    whole, out, left = total + EXTRA * kept, F.lit(0).cast("long"), n + EXTRA
    for _ in range(3):
        out = out * 1000 + _whole(left * 1000, whole)
        left = left * 1000 % whole
    return out + 1


def differ(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q))."""
    return _whole((p - q) * (p - q), p + q)


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each of the ascending ``few``, the first place in the ascending ``many`` that is not below it.

    Every 64th value is found by bisection; from there the others double their
    steps until they have passed their place and then halve them.
    """
    if not len(few) or not len(many):
        return np.zeros(len(few), "i8")
    low = np.repeat(np.searchsorted(many, few[::64]), 64)[: len(few)]
    step, high = 1, low.copy()
    open_ = np.arange(len(few))
    while len(open_ := open_[(high[open_] < len(many)) & (many[np.minimum(high[open_], len(many) - 1)] < few[open_])]):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(low[open_] + step, len(many))
        step *= 2
    while (low < high).any():
        middle = (low + high) // 2
        below = (low < high) & (many[np.minimum(middle, len(many) - 1)] < few)
        low, high = np.where(below, middle + 1, low), np.where(below, high, np.minimum(middle, high))
    return low


def prices(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """`share`, for arrays."""
    whole, out, left = total + EXTRA * kept, 0, n + EXTRA
    for _ in range(3):
        digit, left = np.divmod(left * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def apart(ids: np.ndarray, n: np.ndarray, total: int, other_ids: np.ndarray, other_n: np.ndarray, other_total: int, kept: int) -> tuple[int, int]:
    """Sum of differences over the terms that one of two sparse groups has, and their number."""
    if len(ids) > len(other_ids):
        return apart(other_ids, other_n, other_total, ids, n, total, kept)
    at = gallop(ids, other_ids)
    shared = at < len(other_ids)
    shared[shared] = other_ids[at[shared]] == ids[shared]
    p, q = prices(n, total, kept), prices(other_n, other_total, kept)
    none = np.zeros(1, "i8")
    facing = np.full(len(ids), prices(none, other_total, kept)[0])
    facing[shared] = q[at[shared]]
    alone = np.ones(len(other_ids), bool)
    alone[at[shared]] = False
    cost = lambda a, b: int(((a - b) * (a - b) // (a + b)).sum())
    return cost(p, facing) + cost(q[alone], prices(none, total, kept)), len(ids) + int(alone.sum())


class Audit:
    """The written tables of an audit, from which both parts are read."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, chunk: int = CHUNK):
        self.chunk = chunk
        counted = materialise(counts(docs, text_col, lang_col, source_col), "counts")
        words = counted.where(F.col("term").isNotNull())
        kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        kept = materialise(number_within(kept.drop("docs"), "lang", "id", ["term"]), "kept")
        #: ``(lang, source, term, id, n, lang_n)``: the kept terms that a group has.
        self.terms = materialise(words.drop("docs").join(kept, ["lang", "term"]), "terms")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
        own = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counted.where(F.col("term").isNull()).select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.na.fill(0, ["total", "kept", "lang_total"])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        held = F.count(F.lit(1)).over(Window.partitionBy("lang"))
        #: ``(lang, source, total, kept, lang_total, place, held)``: a row a group; its place among the language's ``held`` sources.
        self.groups = materialise(groups.withColumns({"place": place, "held": held}), "groups")
        self.n_groups = self.groups.count()

    def pairs(self) -> DataFrame:
        """``(lang, source, item, value)``: each source's distance to each other source of its language."""
        groups = small(self.groups, self.n_groups)
        sparse = self.terms.groupBy("lang", "source", _whole(F.col("id"), F.lit(self.chunk)).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("terms"))
        sparse = materialise(sparse.join(groups, ["lang", "source"]).select("lang", "chunk", "place", "held", "total", "kept", F.col("terms.id").alias("ids"), F.col("terms.n").alias("counts")), "sparse")
        totals = self.groups.select("lang", F.col("place").alias("other"), F.col("total").alias("other_total"))
        dealt = sparse.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("held") - 1).cast("array<int>"))).where("other <> place").join(small(totals, self.n_groups), ["lang", "other"])
        dealt = dealt.select("lang", "chunk", F.least("place", "other").alias("a"), F.greatest("place", "other").alias("b"), "place", "total", "other_total", "kept", "ids", "counts")
        keys = ["lang", "chunk", "a", "b"]

        def price(left: pa.Table, right: pa.Table) -> pa.Table:
            one = left if left.num_rows else right
            sides = []
            for table in (left, right):  # a side without terms in this chunk has no row
                ids, n = ([np.asarray(x.values, "i8") for x in table.column(c)] for c in ("ids", "counts"))
                sides.append((ids[0] if ids else np.zeros(0, "i8"), n[0] if n else np.zeros(0, "i8")))
            own, facing = one.column("total")[0].as_py(), one.column("other_total")[0].as_py()
            totals = (own, facing) if left.num_rows else (facing, own)
            value, seen = apart(*sides[0], totals[0], *sides[1], totals[1], one.column("kept")[0].as_py())
            row = {c: one.column(c).slice(0, 1).to_pylist() for c in ("lang", "a", "b")} | {"value": [value], "seen": [seen]}
            return pa.table(row, pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64()), ("seen", pa.int64())]))

        other = dealt.where("place = b")
        met = dealt.where("place = a").groupBy(*keys).cogroup(other.toDF(*other.columns).groupBy(*keys))
        priced = met.applyInArrow(price, "lang string, a int, b int, value long, seen long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
        named = lambda end, n: self.groups.select("lang", F.col("source").alias(n), F.col("place").alias(end), F.col("total").alias(f"total_{end}"), "kept")
        every = named("x", "source").join(named("y", "item").drop("kept"), "lang").where("x <> y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
        none = F.lit(0).cast("long")
        absent = differ(share(none, F.col("total_x"), F.col("kept")), share(none, F.col("total_y"), F.col("kept")))
        value = F.when(F.col("kept") > 0, F.coalesce("value", none) + (F.col("kept") - F.coalesce("seen", none)) * absent).otherwise(none)
        return every.join(priced, ["lang", "a", "b"], "left").select("lang", "source", "item", value.alias("value"))

    def over_used(self, ranks: int = 10) -> DataFrame:
        """``(lang, source, item, value, rank)``: the terms whose price in a group most exceeds that in its language."""
        rows = self.terms.join(small(self.groups, self.n_groups), ["lang", "source"])
        rows = rows.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))}).where("p > q")
        rows = rows.select("lang", "source", F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
        return rows.withColumn("rank", _rank()).where(F.col("rank") <= ranks)


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, ranks: int = 10, chunk: int = CHUNK) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: parts ``pair`` (all other sources, farthest first) and ``term`` (the first ``ranks``)."""
    held = Audit(docs, text_col, lang_col, source_col, least_docs, chunk)
    pairs = held.pairs().withColumn("rank", _rank())
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pairs), ("term", held.over_used(ranks)))]
    return parts[0].unionByName(parts[1])
