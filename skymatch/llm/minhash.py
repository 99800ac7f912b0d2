"""MinHash near-dedup with signatures from two permutations, one of them shifted in a circle.

1. A text becomes the set of its distinct word shingles, by 64-bit hashes. A
   shingle takes a place on a circle of `CIRCLE` places, shuffled by the first
   permutation. Coordinate k of the signature is the least value that the second
   permutation, moved on by k places, gives to any shingle of the set (circulant
   MinHash, Li and Li, 2022). Shingles that fall on one place make sets more alike,
   never less: sets near the size of the circle only cost more verification.
2. Signatures are cut into ``BANDS`` bands of ``ROWS`` coordinates. Sets that agree
   in a band are candidates; each bucket joins its members to its least one, so
   a bucket of n sets gives n - 1 rows.
3. Within the groups that these rows join, all sets are compared by their exact
   Jaccard similarity, in blocks of a bounded number of shingles; in groups of over
   16 only what is near by a 256-bit fingerprint and not joined yet.

A pair at a similarity of 0.85 shares no band with a chance of
(1 - 0.85 ** 5) ** 32, 7 in a billion; a closer one with less.

Defined results: words are split at ASCII white space, A-Z lower-cased; fewer words
than a shingle are one shingle; a null or empty text, or one of white space, has
the empty set and is linked with nothing; a text of any length is taken whole, its
hashes are held at once (8 bytes a word and the words); rows that repeat id and
text give as many rows with the same class; of equal ids with different texts each
is a document; a null id names a class only if all ids there are null, and is then
the one kept; an empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialise, small
from .graph import components
from .simhash import BLOCK, shingle_set, verified

#: Bands, coordinates of each, places of the circle, and shingles whose values are looked up at once.
BANDS, ROWS, CIRCLE, AT_ONCE = 32, 5, 1 << 20, 2048

_circles: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def circles(circle: int = CIRCLE, coordinates: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations: of places, and of values as a view with a row of ``coordinates`` shifted values for each place."""
    if (circle, coordinates) not in _circles:
        draw = np.random.default_rng(20)
        place, value = (draw.permutation(circle).astype("u4") for _ in range(2))
        _circles[circle, coordinates] = place, np.lib.stride_tricks.sliding_window_view(np.concatenate([value, value[: coordinates - 1]]), coordinates)
    return _circles[circle, coordinates]


def signature(held: np.ndarray, circle: int = CIRCLE, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """All coordinates of a set of hashes that is not empty."""
    place, value = circles(circle, coordinates)
    least = np.full(coordinates, circle, "u4")
    for k in range(0, len(held), AT_ONCE):
        np.minimum(least, value[place[held[k : k + AT_ONCE] % np.uint64(circle)]].min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each row of ``signatures``; it also names the band."""
    cut = np.ascontiguousarray(signatures, "u4").reshape(len(signatures), bands, -1)
    keys = [xxhash.xxh64_intdigest(band, k) for row in cut for k, band in enumerate(row)]
    return np.array(keys, "u8").reshape(len(signatures), bands).view("i8")


def signed(docs: DataFrame, words: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, n1, n2, size, bands)`` for each row: hash of its text, 128 bits that name its set, the set's size and band keys."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                sets = [shingle_set(t, words) if t and t.strip(" \t\n\r\x0b\x0c") else np.zeros(0, "u8") for t in part.column(2).to_pylist()]
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), "i8").reshape(-1, 2)
                keys = band_keys(np.array([signature(h, coordinates=bands * rows) for h in sets], "u4").reshape(-1, bands * rows), bands)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype="i4"), keys.ravel())
                columns = [part.column(0), part.column(1), *map(pa.array, names.T), pa.array([len(h) for h in sets], pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "n1", "n2", "size", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    return batched(asked).mapInArrow(run, f"id {kind}, th long, n1 long, n2 long, size int, bands array<long>")


def candidates(sets: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` over ``struct(n1, n2)``: from each member of a bucket of ``sets(n1, n2, bands)`` to its least one."""
    rows = materialise(sets.select(F.struct("n1", "n2").alias("set"), F.explode("bands").alias("key")), "bands")
    least = rows.groupBy("key").agg(F.min("set").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(least, "key").where(F.col("set") != F.col("dst")).select(F.col("set").alias("src"), "dst").distinct()


def near_groups(docs: DataFrame, words: int = 5, least: float = 0.85, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, component)`` for each row of ``docs``; ``component`` is the smallest id reachable by links of ``least`` or more."""
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    keys = signed(given, words, bands, rows).groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("n1", "n2", "size", "bands")])
    keys = materialise(keys, "signed")
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id", "th", "n")
    reps = keys.where("size > 0").groupBy("n1", "n2").agg(F.min(own).alias("rep"), F.count(F.lit(1)).alias("held"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = materialise(reps, "sets")
    near = materialise(candidates(reps), "near")
    of = components(materialise(verified(given, reps, near, words, least, block), "similar")).select("node.n1", "node.n2", "component")
    shared = reps.select("n1", "n2", "rep", "held").join(of, ["n1", "n2"], "left").where("held > 1 or component is not null")
    shared = materialise(shared.select("n1", "n2", "rep", F.coalesce("component", F.struct("n1", "n2")).alias("component")), "shared")
    first = shared.groupBy("component").agg(F.min("rep").alias("first"))
    classes = materialise(shared.join(first, "component").select("n1", "n2", F.col("first.id").alias("least_id"), F.lit(True).alias("found")), "firsts")
    found = keys.drop("bands").join(small(classes, classes.count()), ["n1", "n2"], "left").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return found.select("id", "size", F.when(F.col("found") & (F.col("size") > 0), F.col("least_id")).otherwise(F.col("id")).alias("component"))
