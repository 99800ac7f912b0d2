"""SimHash near-dedup by tiled exact comparison.

Fingerprints are made from word shingles; all pairs of distinct fingerprints
are compared in tiles by exclusive-or and bit counts. Each tile pair returns a
forest over what its links join, not the links, so n near copies give fewer than
n rows a pair and every component is whole.

`near_groups` links 64-bit fingerprints within a radius, as such. A tile holds
fingerprints of one population count, so tile pairs whose counts differ by more
than the radius are never formed, and inside a pair only the slice whose
upper-half counts allow the radius is compared.

`similar_groups` and `keep_one` link documents whose sets of shingles have a
Jaccard similarity of ``least`` or more. Fingerprints of 256 bits, of distinct
shingles, are compared in tiles of like set sizes (other sizes cannot be similar
enough), blocks whose population counts differ beyond the radius are skipped, and
what is near is verified on whole sets. `RADIUS` is the mean number of bits in
which two sets at 0.8 differ plus five deviations: a pair at 0.8 is passed over
with a chance of about 5 in 10 million, a closer one with less. Verification runs within
the components of near fingerprints, in blocks of a bounded number of shingles.

Defined results: a null or empty text, or one of white space, has fingerprint 0
(64 bits), or the set of one empty shingle, and is linked like any other; a null
id gets a component but names one only if all ids there are null, and its rows are
kept or dropped like others; repeated rows get the same component, and one of them
stays; of equal ids with different texts each is a document; an empty table gives
no rows; other columns are ignored by groups and untouched by `keep_one`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, materialise, small
from .graph import components, merge_forest, merge_labels, stars

#: Hashes whose bits are summed at once; bounds the memory of a very long text.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of ``text``: words split at ASCII white space, A-Z lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), "<u8", len(shingles))
    counts = np.zeros(64, "i8")
    for k in range(0, len(hashes), CHUNK):
        counts += np.add.reduce(np.unpackbits(hashes[k : k + CHUNK].view("u1"), bitorder="little").reshape(-1, 64), axis=0, dtype="i4")
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, fp)``: the fingerprint as a signed long with the same bits."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], "u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("i8"))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).mapInArrow(run, f"id {kind}, fp long")


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int, rows: int = 512, cols: int = 2048) -> np.ndarray:
    """Edges (n, 2) of a forest that joins what the pairs of ``a`` and ``b`` within ``radius`` bits join.

    Each array has one population count. With d the difference of the counts,
    two values within the radius differ in the count of their upper halves by
    (d - radius) / 2 to (d + radius) / 2, which bounds the slice of ``b``.
    """
    upper = lambda v: np.bitwise_count(v >> np.uint64(32)).astype("i4")
    a = a[np.argsort(upper(a), kind="stable")]
    b = a if same else b[np.argsort(upper(b), kind="stable")]
    high_a, high_b = upper(a), upper(b)
    gap = int(np.bitwise_count(b[:1]).sum()) - int(np.bitwise_count(a[:1]).sum())
    down, up = math.ceil((gap - radius) / 2), math.floor((gap + radius) / 2)
    values = a if same else np.concatenate([a, b])
    labels, shift = np.arange(len(values)), 0 if same else len(a)
    for i in range(0, len(a), rows):
        first = int(np.searchsorted(high_b, high_a[i] + down, "left"))
        last = int(np.searchsorted(high_b, high_a[min(i + rows, len(a)) - 1] + up, "right"))
        for j in range(max(first, i) if same else first, last, cols):
            near = np.bitwise_count(a[i : i + rows, None] ^ b[None, j : min(j + cols, last)]) <= radius
            x, y = np.nonzero(near)
            labels = merge_labels(labels, x + i, y + j + shift)
    out = np.nonzero(labels != np.arange(len(labels)))[0]
    return np.stack([values[out], values[labels[out]]], axis=1)


def tile_pairs(rows: DataFrame, level: Column, levels: int, reach: int, tile_rows: int, payload: Column) -> DataFrame:
    """``(a, b, left, right)``: lists of ``payload`` for each pair of tiles, ``a <= b``, whose levels differ by ``reach`` or less.

    A tile holds about ``tile_rows`` rows of one level (0 to ``levels`` - 1). The only thing gathered is the histogram of levels.
    """
    spark = rows.sparkSession
    levelled = rows.select(level.cast("int").alias("level"), payload.alias("item"))
    by_level = dict(levelled.groupBy("level").count().collect())
    base, plan = 0, []
    for p in range(levels):
        tiles = math.ceil(by_level.get(p, 0) / tile_rows)
        plan.append((base, tiles))
        base += tiles
    last = [sum(plan[min(levels - 1, p + reach)]) - 1 for p in range(levels)]
    starts, sizes, ends = (F.array(*[F.lit(v) for v in x]) for x in ([s for s, _ in plan], [max(1, t) for _, t in plan], last))
    tiled = levelled.withColumn("tile", F.get(starts, "level") + F.pmod(F.xxhash64("item"), F.get(sizes, "level")))
    tiles = materialise(tiled.groupBy("tile").agg(F.first("level").alias("level"), F.collect_list("item").alias("items")), "tiles")
    pairs = tiles.select(F.col("tile").alias("a"), F.col("items").alias("left"), F.explode(F.sequence(F.col("tile"), F.get(ends, "level").cast("long"))).alias("b"))
    n_pairs = sum(t * (last[p] + 1 - s) for p, (s, t) in enumerate(plan))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = pairs.join(tiles.select(F.col("tile").alias("b"), F.col("items").alias("right")), "b")
    return joined.repartition(max(parts, min(n_pairs, 20 * parts)), "a", "b").select("a", "b", "left", "right")


def links(distinct: DataFrame, radius: int = 4, tile_rows: int = 65_536) -> DataFrame:
    """Edges ``(src, dst)`` between distinct fingerprints ``fp``, enough to join each component."""

    def run(batches):
        for batch in batches:
            for a, b, left, right in zip(*(batch.column(k) for k in range(4)), strict=True):
                u, v = (np.asarray(x.values).view("u8") for x in (left, right))
                found = compare(u, v, a.as_py() == b.as_py(), radius).view("i8")
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["src", "dst"])

    return tile_pairs(distinct, F.bit_count("fp"), 65, radius, tile_rows, F.col("fp")).mapInArrow(run, "src long, dst long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, tile_rows: int = 65_536) -> DataFrame:
    """``(id, fp, component)`` for each row; ``component`` is the smallest id reachable by links."""
    marks = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    reps = materialise(marks.groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    of = components(links(reps.select("fp"), radius, tile_rows)).withColumnRenamed("node", "fp")
    labelled = reps.join(of, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component"))
    return marks.join(labelled.join(least, "label").select("fp", "component"), "fp").select("id", "fp", "component")


#: Words of a wide fingerprint, and the bits in which two sets at 0.8 may differ: in the first 128, and in all 256. Sets of under SHORT shingles differ in more.
WORDS, RADIUS, SHORT, SHORT_RADIUS = 4, (42, 72), 8, (47, 82)
#: Rows of a tile of wide fingerprints, step between levels of set size, levels, and shingles on each side of a block of verification.
TILE, STEP, LEVELS, BLOCK = 16_384, 1.1, 300, 1_000_000


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``text``; fewer words are one shingle, none are an empty one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), "u8"))


def wide_fingerprint(held: np.ndarray) -> np.ndarray:
    """256 bits, as four words, of a set of hashes; each word is voted for by the hashes, mixed anew."""
    counts = np.zeros(64 * WORDS, "i8")
    for k in range(0, len(held), CHUNK):
        z = held[k : k + CHUNK, None] + np.arange(1, WORDS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ (z >> np.uint64(31))).view("u1"), bitorder="little").reshape(-1, 64 * WORDS)
        whole = len(bits) // 128 * 128
        counts += np.add.reduce(bits[:whole].reshape(-1, 128, 64 * WORDS), axis=1, dtype="u1").sum(axis=0, dtype="i8") + np.add.reduce(bits[whole:], axis=0, dtype="u1")
    return np.packbits(counts * 2 > len(held), bitorder="little").view("u8")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``(id, th, n1, n2, size, f0 .. f3)`` for each document: hash of its text, 128 bits that name its set, and the set's size and fingerprint."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(2).to_pylist()]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), "i8").reshape(-1, 2)
            marks = np.array([wide_fingerprint(h) for h in sets], "u8").reshape(-1, WORDS).view("i8")
            columns = [*names.T, np.array([len(h) for h in sets], "i4"), *marks.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)], ["id", "th", "n1", "n2", "size", *(f"f{k}" for k in range(WORDS))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")
    return batched(rows).mapInArrow(run, f"id {kind}, th long, n1 long, n2 long, size int, " + ", ".join(f"f{k} long" for k in range(WORDS)))


def _near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(x, y)`` of the near fingerprints of sets of like sizes; ``a`` and ``b`` have a row a word."""
    short = size_a.min() < SHORT or size_b.min() < SHORT
    distance = np.bitwise_count(a[0][:, None] ^ b[0]) + np.bitwise_count(a[1][:, None] ^ b[1])
    x, y = np.nonzero(distance <= (SHORT_RADIUS if short else RADIUS)[0])
    distance = distance[x, y] + sum(np.bitwise_count(a[k][x] ^ b[k][y]) for k in range(2, WORDS))
    low, high = np.minimum(size_a[x], size_b[y]), np.maximum(size_a[x], size_b[y])
    good = (distance <= np.where(low < SHORT, SHORT_RADIUS[1], RADIUS[1])) & (low >= least * high - 1e-9)
    return x[good], y[good]


def compare_wide(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, same: bool, least: float, rows: int = 256, cols: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of a forest of near fingerprints; each array has a row a word."""
    count = lambda v: np.bitwise_count(v).sum(axis=0, dtype="i4")
    order_a = np.argsort(count(a), kind="stable")
    order_b = order_a if same else np.argsort(count(b), kind="stable")
    a, size_a, b, size_b = np.ascontiguousarray(a[:, order_a]), size_a[order_a], np.ascontiguousarray(b[:, order_b]), size_b[order_b]
    count_a, count_b = count(a), count(b)
    reach = SHORT_RADIUS[1] if min(size_a.min(), size_b.min()) < SHORT else RADIUS[1]
    shift = 0 if same else len(size_a)
    labels, found = np.arange(len(size_a) + (0 if same else len(size_b))), []
    for i in range(0, len(size_a), rows):
        s = slice(i, i + rows)
        first = int(np.searchsorted(count_b, count_a[i] - reach, "left"))
        last = int(np.searchsorted(count_b, count_a[s][-1] + reach, "right"))
        for j in range(max(first, i) if same else first, last, cols):
            t = slice(j, min(j + cols, last))
            x, y = _near(a[:, s], b[:, t], size_a[s], size_b[t], least)
            x, y = x + i, y + j
            labels, some = merge_forest(labels, x, y + shift)
            found.append(np.stack([order_a[x[some]], order_b[y[some]]]))
    x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), "i8")
    return x, y


def _near_sets(reps: DataFrame, least: float, tile_rows: int) -> DataFrame:
    """Edges ``(src, dst)`` over ``struct(n1, n2)`` that join the sets whose fingerprints are near."""
    level = F.least(F.lit(LEVELS - 1), F.floor(F.log("size") / math.log(STEP)))
    reach = math.ceil(-math.log(least) / math.log(STEP) + 1e-6)
    words = [f"f{k}" for k in range(WORDS)]

    def run(batches):
        for batch in batches:
            for a, b, left, right in zip(*(batch.column(k) for k in range(4)), strict=True):
                u, v = (dict(zip(["n1", "n2", "size", *words], x.values.flatten(), strict=True)) for x in (left, right))
                at = [np.stack([np.asarray(z[w]).view("u8") for w in words]) for z in (u, v)]
                x, y = compare_wide(*at, np.asarray(u["size"]), np.asarray(v["size"]), a.as_py() == b.as_py(), least)
                yield pa.RecordBatch.from_arrays(_starred(*[np.stack([np.asarray(z[n])[p] for n in ("n1", "n2")], axis=1) for z, p in ((u, x), (v, y))]), ["src", "dst"])

    pairs = tile_pairs(reps, level, LEVELS, reach, tile_rows, F.struct("n1", "n2", "size", *words))
    return pairs.mapInArrow(run, f"src {SET}, dst {SET}")


#: A set of shingles, by 128 bits.
SET = "struct<n1:long,n2:long>"


def _starred(left: np.ndarray, right: np.ndarray) -> list[pa.StructArray]:
    """Links between the sets ``left[i]`` and ``right[i]``, a row ``(n1, n2)`` each, as stars around the smallest sets: these take few rounds to unite."""
    return [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in nodes.T], ["n1", "n2"]) for nodes in stars(left, right)]


def similar_pairs(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest ``(p, q)`` that joins all of ``x`` with all of ``y`` whose sets have a Jaccard similarity of ``least`` or more.

    Sets are compared unless they are joined already or, in larger groups, their fingerprints are not near.
    """
    size = np.array([len(s) for s in sets], "i8")
    marks = np.array([wide_fingerprint(s) for s in sets]) if len(sets) > 16 else None
    y = y[np.argsort(size[y], kind="stable")]
    flat, start = np.concatenate([sets[k] for k in y.tolist()]), np.cumsum(size[y]) - size[y]
    labels, found = np.arange(len(sets)), []
    for i in x.tolist():
        low, high = np.searchsorted(size[y], [least * size[i] - 1e-9, size[i] / least + 1e-9])
        at = low + np.nonzero(labels[y[low:high]] != labels[i])[0]
        if marks is not None:
            reach = np.where(np.minimum(size[y[at]], size[i]) < SHORT, SHORT_RADIUS[1], RADIUS[1])
            at = at[np.bitwise_count(marks[y[at]] ^ marks[i]).sum(axis=1) <= reach]
        if not len(at):
            continue
        some, n = y[at], size[y[at]]
        first = np.cumsum(n) - n
        held = flat[np.repeat(start[at] - first, n) + np.arange(int(n.sum()))]
        place = np.minimum(np.searchsorted(sets[i], held), size[i] - 1)
        shared = np.add.reduceat((sets[i][place] == held).astype("i8"), first)
        good = some[shared >= least * (size[i] + size[some] - shared) - 1e-9]
        labels, picked = merge_forest(labels, np.full(len(good), i), good)
        found.append(np.stack([np.full(len(picked), i), good[picked]]))
    p, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), "i8")
    return p, q


def verified(docs: DataFrame, reps: DataFrame, near: DataFrame, words: int, least: float, block: int) -> DataFrame:
    """Edges ``(src, dst)`` that join each class of similar sets, found within the components of near fingerprints."""
    of = components(near).select("node.n1", "node.n2", F.xxhash64("component").alias("g"))
    asked = materialise(reps.select("n1", "n2", "size", "rep").join(of, ["n1", "n2"]), "asked")
    load = materialise(asked.groupBy("g").agg(F.sum(F.col("size").cast("long")).alias("load")), "loads")
    total = load.agg(F.sum("load")).first()[0] or 0
    blocks, k = F.ceil(F.col("load") / block).cast("int"), F.col("k")
    dealt = asked.join(small(load, load.count()), "g").withColumn("blocks", blocks).withColumn("k", F.pmod(F.xxhash64("n1", "n2"), F.col("blocks")).cast("int"))
    # a small component is whole in its bundle; a large one meets itself in pairs of blocks
    bundle = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("g", F.lit(1)), F.lit(max(1, math.ceil(total / block))))).otherwise(F.col("g"))
    dealt = dealt.select("n1", "n2", "g", bundle.alias("bundle"), "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"), F.col("rep.id").alias("_id"), F.col("rep.th").alias("_th"), F.col("rep.n").alias("n"))
    dealt = materialise(dealt.select("*", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j")), "dealt")
    once = dealt.groupBy("_id", "_th").agg(F.first("n").alias("n"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(small(once, dealt.count(), 200_000), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    rows = materialise(rows.where("n = 1").select("n1", "n2", "text").unionByName(rows.where("n > 1").dropDuplicates(["n1", "n2"]).select("n1", "n2", "text")), "texts")

    def sets_of(batches):
        for batch in batches:
            for c in range(0, batch.num_rows, 256):
                part = batch.slice(c, 256)
                held = [shingle_set(t, words).view("i8") for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(held, pa.list_(pa.int64()))], ["n1", "n2", "h"])

    sets = batched(rows).mapInArrow(sets_of, "n1 long, n2 long, h array<long>")
    grouped = dealt.select("n1", "n2", "g", "bundle", "k", "i", "j").join(sets, ["n1", "n2"])

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        h = group.column("h").chunk(0) if len(group) else None
        sets = [np.asarray(v.values).view("u8") for v in h]
        g, k = group.column("g").to_numpy(), group.column("k").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        order = np.argsort(g, kind="stable")
        found = []
        for part in np.split(order, np.nonzero(np.diff(g[order]))[0] + 1):
            x, y = (part[k[part] == i], part[k[part] == j]) if i != j else (part, part)
            if len(x) and len(y) and len(part) > 1:
                p, q = similar_pairs([sets[m] for m in part.tolist()], np.searchsorted(np.sort(part), x), np.searchsorted(np.sort(part), y), least)
                found.append(np.stack([part[p], part[q]]))
        p, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), "i8")
        names = np.stack([group.column(c).to_numpy() for c in ("n1", "n2")], axis=1)
        return pa.table(_starred(names[p], names[q]), ["src", "dst"])

    return grouped.groupBy("bundle", "i", "j").applyInArrow(verify, f"src {SET}, dst {SET}")


def _classes(docs: DataFrame, words: int, least: float, tile_rows: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``(id, th, n, n1, n2)``, one row a document (an id with a text), and ``(n1, n2, first)`` for the sets of more than one: the first document of their class."""
    numbers = ["n1", "n2", "size", *(f"f{k}" for k in range(WORDS))]
    keys = materialise(_sets(docs, words).groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in numbers]), "documents")
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id", "th", "n")
    reps = materialise(keys.groupBy("n1", "n2").agg(F.min(own).alias("rep"), F.count(F.lit(1)).alias("held"), *[F.first(c).alias(c) for c in numbers[2:]]), "sets")
    near = materialise(_near_sets(reps, least, tile_rows), "near")
    of = components(materialise(verified(docs, reps, near, words, least, block), "similar")).select("node.n1", "node.n2", "component")
    shared = reps.select("n1", "n2", "rep", "held").join(of, ["n1", "n2"], "left").where("held > 1 or component is not null")
    shared = materialise(shared.select("n1", "n2", "rep", F.coalesce("component", F.struct("n1", "n2")).alias("component")), "shared")
    first = shared.groupBy("component").agg(F.min("rep").alias("first"))
    return keys.select("id", "th", "n", "n1", "n2"), materialise(shared.join(first, "component").select("n1", "n2", "first"), "firsts")


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, tile_rows: int = TILE, block: int = BLOCK) -> DataFrame:
    """``(id, th, component)`` for each document (an id with a text, by its hash); ``component`` is the smallest id reachable by links."""
    keys, firsts = _classes(docs, words, least, tile_rows, block)
    return keys.join(small(firsts, firsts.count()), ["n1", "n2"], "left").select("id", "th", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component"))


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, tile_rows: int = TILE, block: int = BLOCK) -> DataFrame:
    """One document of each group: the one of the smallest id, and of those the one of the smallest hash of its text."""
    keys, firsts = _classes(docs, words, least, tile_rows, block)
    firsts = small(firsts, firsts.count())
    late = keys.join(firsts, ["n1", "n2"]).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))))
    late = materialise(late.select(F.col("id").alias("_id"), F.col("th").alias("_th")), "late")
    again = materialise(keys.where("n > 1").select(F.col("id").alias("_id"), F.col("th").alias("_th")), "repeated")
    n_late, n_again = late.count(), again.count()
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    kept = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("th")).join(small(late, n_late), same, "left_anti")
    if n_again:
        once = kept.join(small(again, n_again), same, "left_semi").withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "th"]).drop("id")
        kept = kept.join(small(again, n_again), same, "left_anti").unionByName(once)
    return kept.select("row.*")
