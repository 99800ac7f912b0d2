"""Line dedup by a segment-partition edit join.

Lines of at least ``min_chars`` characters that were seen before, in the order
of (document id, text hash, line number), are dropped. A line was seen before
if an equal line was, or, from ``near_chars`` characters on, one that is linked
to it by steps of at most ``edits`` edits.

Two lines within t edits, one cut into t + 1 segments, share one segment whole
(pigeonhole), at a place that differs by no more than t. Every distinct line is
indexed by its segments and probes, for each length it may match, the few
substrings that can equal a segment there (the multi-match-aware windows of
Li et al., 2011, "Pass-Join"). Equal keys are candidates, verified by banded
bit-parallel edit distance.

A line's own segments, unmoved, are keys of the index itself, so lines of equal
length that share one meet there and only moved substrings are probed.

Keys with up to ``bucket`` indexed lines give pairs. Larger buckets, as made by
thousands of variants of one line, are compared block by block, without pairs
leaving the task: a block returns a forest over what its links join, and holds a
bounded number of characters.

Texts are split once. That pass writes hashes and keys only; lines at stake are
then fetched from the documents that hold them.

A line is trimmed of blanks, tabs and carriage returns for comparison only.
Equality is decided by 128 bits of hash; candidates are looked for by 64.

Defined results: a null or empty text has one empty line and loses nothing; a
null id sorts first and is an id like any other; rows that repeat id and text
are one document and lose the same lines; documents stay, if need be with an
empty text; an empty table gives no rows; other columns are untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, small
from .edit import points, within
from .graph import components, merge_labels

#: Shortest line that can be dropped, shortest that is matched by edits, edits, and lines in a bucket of pairs.
MIN_CHARS, NEAR_CHARS, EDITS, BUCKET = 24, 48, 2, 16
#: Lines, and characters, on each side of a block of a large bucket; characters of pairs that are verified at once.
BLOCK, BLOCK_CHARS, PAIR_CHARS = 1024, 4_000_000, 4_000_000
#: A line, by 128 bits.
LINE = "struct<h1:long,h2:long>"


def _trimmed() -> Column:
    """``line`` without blanks at its ends; the costly function runs only where there are some."""
    ends = [f(c) for f in (F.col("line").startswith, F.col("line").endswith) for c in " \t\r"]
    blank = ends[0]
    for e in ends[1:]:
        blank = blank | e
    return F.when(blank, F.expr("trim(BOTH ' \t\r' FROM line)")).otherwise(F.col("line"))


def _lines(docs: DataFrame, min_chars: int, near_chars: int, edits: int) -> DataFrame:
    """``(doc_id, th, pos, h1, h2, size, index, probes)`` of the lines that are long enough; keys are null below ``near_chars``."""
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    rows = split.where(F.octet_length("line") >= min_chars).withColumn("line", _trimmed()).withColumn("size", F.char_length("line")).where(F.col("size") >= min_chars)
    near = lambda keys: F.when(F.col("size") >= near_chars, keys)
    return with_cuts(rows, edits).select("doc_id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "size", near(index_keys(edits)).alias("index"), near(probe_keys(edits)).alias("probes"))


def with_cuts(lines: DataFrame, edits: int) -> DataFrame:
    """Add ``_c{less}_{k}``, the starts of the even segments of lines that are 0 to ``edits`` shorter, each computed once."""
    return lines.withColumns({f"_c{less}_{k}": F.expr(f"cast((size - {less}) * {k} div {edits + 1} as int)") for less in range(edits + 1) for k in range(edits + 2)})


def _key(k: int, less: int, shift: int) -> Column:
    start, end = F.col(f"_c{less}_{k}"), F.col(f"_c{less}_{k + 1}")
    return F.xxhash64(F.lit(k), F.col("size") - less, F.substr("line", start + (shift + 1), end - start))


def index_keys(edits: int) -> Column:
    return F.array(*[_key(k, 0, 0) for k in range(edits + 1)])


def probe_keys(edits: int) -> Column:
    """Keys of the substrings that can equal a segment of a line that is 0 to ``edits`` shorter, but for the line's own segments.

    The windows lie inside every line that is long enough to be indexed.
    """
    shifts = lambda k, less: range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1)
    return F.array(*[_key(k, less, shift) for less in range(edits + 1) for k in range(edits + 1) for shift in shifts(k, less) if less or shift])


def near_edges(docs: DataFrame, once: DataFrame, edits: int = EDITS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(src, dst)`` over ``struct(h1, h2)`` that join each class of near-equal lines.

    ``once(doc_id, th, pos, h1, h2, size, index, probes)`` holds each line once, at a place in ``docs``.
    """
    index = once.select(F.explode("index").alias("key"), F.col("h1").alias("id"), "size")
    probe = once.select(F.explode("probes").alias("key"), F.col("h1").alias("id"))
    held = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.max("size").alias("size"))
    # one narrow row a key on the hashed side, so no key is hot there
    met = probe.join(held.hint("shuffle_hash"), "key").where((F.col("low") != F.col("id")) | (F.col("high") != F.col("id")))
    full = held.where("low != high").withColumn("id", F.lit(None).cast("long"))
    met = materialise(met.unionByName(full), "met")
    keys = materialise(met.where("id is null").select("key", "n", "size"), "keys")
    mates = materialise(index.select("key", "id").join(small(keys, keys.count()), "key"), "mates")
    alone = met.where("low = high").select(F.col("id").alias("a"), F.col("low").alias("b"))
    probing = met.where("low != high and id is not null").select("key", "id", "n", "size").unionByName(mates)
    few = probing.where(f"n <= {bucket}").select("key", F.col("id").alias("a")).join(mates.where(f"n <= {bucket}").select("key", F.col("id").alias("b")), "key")
    pairs = alone.unionByName(few.select("a", "b")).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("h1")).unionByName(probing.where(f"n > {bucket}").select(F.col("id").alias("h1"))).distinct(), "ids")
    texts = materialise(_texts(docs, once.join(small(ids, ids.count()), "h1")), "texts")
    left, right = (texts.select(F.col("h1").alias(k), F.struct("h1", "h2").alias(f"line_{k}"), F.col("line").alias(f"text_{k}")) for k in "ab")
    verified = pairs.join(left, "a").join(right, "b").select("line_a", "line_b", "text_a", "text_b").mapInArrow(_verify(edits), f"src {LINE}, dst {LINE}")
    return materialise(verified.unionByName(_blocks(probing.where(f"n > {bucket}"), mates.where(f"n > {bucket}"), texts, edits)), "links")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h1, h2, line)`` of the lines at the ``wanted`` places; only documents that hold one are split."""
    by_doc = materialise(wanted.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("pos", "h1", "h2")).alias("at")), "places")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(small(by_doc, by_doc.count(), 200_000), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    lines = rows.select(F.split("text", "\n").alias("lines"), F.explode("at").alias("at")).select("at.h1", "at.h2", F.get("lines", F.col("at.pos")).alias("line"))
    return lines.withColumn("line", _trimmed()).dropDuplicates(["h1", "h2"])


def _verify(edits: int):
    def run(batches):
        for batch in batches:
            weight = np.cumsum(pa.compute.add(pa.compute.binary_length(batch.column(2)), pa.compute.binary_length(batch.column(3))).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate([[0], np.nonzero(np.diff(weight // PAIR_CHARS))[0] + 1, [batch.num_rows]])).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                good = within([points(t) for t in part.column(2).to_pylist()], [points(t) for t in part.column(3).to_pylist()], edits)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["src", "dst"]).filter(pa.array(good))

    return run


def _blocks(probing: DataFrame, mates: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Links in the large buckets: probing lines against indexed lines in blocks of both."""
    probing = probing.select("key", "id", "n", "size").distinct()
    sizes = probing.groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m"), F.max("size").alias("size"))
    # the lines of a key differ in length by the edits at most
    rows_of = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"int({BLOCK_CHARS} div (size + {edits}))")))
    blocks = lambda c: F.ceil(F.col(c) / rows_of).cast("int")
    own = lambda c: F.pmod(F.xxhash64("id"), blocks(c)).cast("int")
    others = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    indexed = mates.select("key", "id").join(sizes, "key").select("key", "id", own("n").alias("i"), others("m").alias("j"), F.lit(0).alias("side"))
    probes = probing.select("key", "id").join(sizes, "key").select("key", "id", others("n").alias("i"), own("m").alias("j"), F.lit(1).alias("side"))
    rows = indexed.unionByName(probes).join(texts.select(F.col("h1").alias("id"), "h1", "h2", "line"), "id").drop("id")

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        h1, h2, lines = group.column("h1").to_numpy(), group.column("h2").to_numpy(), [points(t) for t in group.column("line").to_pylist()]
        marks = np.array([np.bincount(x & 63, minlength=64) for x in lines], "i4")
        x, y = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        labels = np.arange(len(lines))
        for some in np.array_split(x, max(1, len(x) // 64)) if len(x) and len(y) else []:
            left, right = [], []
            for i in some.tolist():  # an edit changes the counts by 2 at most
                near = y[np.abs(marks[y] - marks[i]).sum(axis=1) <= 2 * edits]
                near = near[labels[near] != labels[i]]
                left.append(np.full(len(near), i))
                right.append(near)
            p, q = np.concatenate(left), np.concatenate(right)
            good = within([lines[i] for i in p.tolist()], [lines[i] for i in q.tolist()], edits)
            labels = merge_labels(labels, p[good], q[good])
        out = np.nonzero(labels != np.arange(len(lines)))[0]
        ends = [pa.StructArray.from_arrays([pa.array(h1[at], pa.int64()), pa.array(h2[at], pa.int64())], ["h1", "h2"]) for at in (out, labels[out])]
        return pa.table(ends, ["src", "dst"])

    return rows.groupBy("key", "i", "j").applyInArrow(compare, f"src {LINE}, dst {LINE}")


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, edits: int = EDITS, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, th, dropped, n_near, first_doc)``: line numbers to drop, for documents that lose any.

    ``n_near`` of them match an earlier line by edits alone; ``first_doc`` is
    the smallest id of a document that keeps one of the lines dropped here.
    """
    lines = materialise(_lines(docs, min_chars, near_chars, edits), "lines")
    seen = lines.select("doc_id", "th", "pos", "h1", "h2")
    again = materialise(seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "repeated")
    n_again = again.count()
    place = F.struct("doc_id", "th", "pos")
    first = materialise(seen.join(small(again, n_again), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min(place).alias("first")), "firsts")
    long = lines.where("index is not null")
    fresh = long.join(small(again, n_again), ["h1", "h2"], "left_anti")
    firsts = long.join(small(first, n_again), ["h1", "h2"]).where(F.col("first").eqNullSafe(place)).drop("first").dropDuplicates(["h1", "h2"])
    once = fresh.unionByName(materialise(firsts, "again"))
    if n_again > BROADCAST_ROWS:
        once = materialise(once, "once")
    linked = materialise(components(near_edges(docs, once, edits, bucket)).select("node.h1", "node.h2", "component"), "classes")
    classes = linked.unionByName(again.join(linked, ["h1", "h2"], "left_anti").select("h1", "h2", F.struct("h1", "h2").alias("component")))
    classes = materialise(classes, "classes")
    found = materialise(seen.join(small(classes, classes.count()), ["h1", "h2"]), "found")
    heads = materialise(found.groupBy("component").agg(F.min_by(F.struct("doc_id", "th", "pos", "h1", "h2"), place).alias("head")), "heads")
    late = found.join(small(heads, heads.count()), "component").where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.struct("head.doc_id", "head.th", "head.pos")))
    late = late.distinct()
    return late.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("pos")).alias("dropped"), F.count_if((F.col("h1") != F.col("head.h1")) | (F.col("h2") != F.col("head.h2"))).alias("n_near"), F.min("head.doc_id").alias("first_doc"))


def _with_drops(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(row, text, dropped, n_near, first_doc)``: ``row`` is the document's own row; the last three are null where nothing is dropped."""
    found = materialise(found, "drops").withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    keyed = docs.select(F.struct("*").alias("row"), "text", F.xxhash64("text").alias("text_hash"))
    return keyed.join(small(found, found.count(), 200_000), F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")), "left").drop("_id", "_th", "text_hash")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, n_near, dropped, first_doc``."""
    narrow = docs.select("doc_id", "text")
    rows = _with_drops(narrow, drops(narrow, **options))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    none = F.array().cast("array<int>")
    return rows.select("row.doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.coalesce("dropped", none).alias("dropped"), F.coalesce("first_doc", "row.doc_id").alias("first_doc"))


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the dropped lines, and ``n_chars``, if there is one, counted anew."""
    rows = _with_drops(docs, drops(docs.select("doc_id", "text"), **options))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("dropped"), i))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    rows = rows.select("row", F.col("dropped").isNull().alias("whole"), text.alias("text"))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.char_length("text").cast("long"))}
    return rows.select(*[fresh[c].alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns])
