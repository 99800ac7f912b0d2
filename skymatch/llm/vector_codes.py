"""Compression of vectors to a few bytes by codebooks of their parts, in whole numbers.

A vector's components become the integers floor(scale * x), and the vector is cut
into equal parts. Each part position has a codebook, which starts as that part of
the vectors of the smallest ids; rounds of assigning every part to its nearest
entry and replacing entries by the floored means of their parts follow.

Distances go through dictionaries of values. Vectors are kept in blocks of at most
``BLOCK_ROWS``; a block holds, for each dimension, its distinct integers in order
and a code of two bytes for each vector. To price a block, the squared differences
of every distinct integer to all entries are tabulated once a dimension; a vector's
distances to all entries are then gathered from these tables by its codes and
added up. Blocks are written once and read by every round.

The driver holds the codebooks (parts x entries x dimensions of a part, whatever
the input's size), and tasks return the sums and counts of their entries, which
Spark adds up.

Defined results: vectors that are null or hold null, infinite or undefined
components are dropped; fewer vectors than entries make smaller codebooks; equal
distances go to the lower index; an entry that no part chose stays as it is; null
ids come last among the starting vectors, and rows that repeat an id take part one
by one, in the order of their components; equal labels share one sum, nulls too; an
empty table gives no rows; other columns, of any name, are ignored. Vectors of
different lengths, a length that the parts do not divide, and components that reach
2 ** 28 in absolute value when scaled raise a ValueError: sums could overflow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small

#: Vectors of a block, at most, and the bound on scaled components.
BLOCK_ROWS, BOUND = 4096, 1 << 28

_BLOCK = pa.schema([("ids", pa.binary()), ("values", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])


def integers(vectors: DataFrame, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, v)``: the floored components of each vector that is whole and finite."""
    x = vectors[vector_col].cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    near = F.transform(x, lambda c: F.floor(c * scale))
    return vectors.where(whole).select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), near.cast("array<long>").alias("v"))


def _numbers(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; a row of another length raises."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors must have one length")
    out = np.asarray(column.flatten(), "i8").reshape(len(sizes), int(sizes[0]) if len(sizes) else 0)
    if ((out >= BOUND) | (out <= -BOUND)).any():
        raise ValueError("scaled components must stay under 2 ** 28")
    return out


def blocks(rows: DataFrame, dims: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(ids, values, sizes, codes)``: numbers of up to ``block_rows`` rows of ``rows(row, v)``, by dimension their distinct values in order, how many these are, and the code of each row's value."""

    def packed(numbers: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        v = np.concatenate(parts)
        if v.shape[1] != dims:
            raise ValueError("vectors must have one length")
        found = [np.unique(column, return_inverse=True) for column in v.T]
        held = [np.concatenate(numbers).astype("i8"), np.concatenate([x for x, _ in found]), np.array([len(x) for x, _ in found], "i4"), np.array([at for _, at in found], "u2")]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], schema=_BLOCK)

    def run(batches):
        numbers: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            for k in range(0, batch.num_rows, block_rows):
                piece = batch.slice(k, block_rows)
                if numbers and sum(map(len, numbers)) + len(piece) > block_rows:
                    yield packed(numbers, parts)
                    numbers, parts = [], []
                numbers.append(piece.column(0).to_numpy())
                parts.append(_numbers(piece.column(1)))
        if numbers:
            yield packed(numbers, parts)

    return rows.select("row", "v").mapInArrow(run, "ids binary, values binary, sizes binary, codes binary")


class Block:
    """A decoded block: ``ids``, and by dimension the distinct ``values`` and the rows' ``codes``."""

    def __init__(self, ids: bytes, values: bytes, sizes: bytes, codes: bytes):
        self.ids = np.frombuffer(ids, "i8")
        sizes_ = np.frombuffer(sizes, "i4")
        self.values = np.split(np.frombuffer(values, "i8"), np.cumsum(sizes_)[:-1])
        self.codes = np.frombuffer(codes, "u2").reshape(len(sizes_), -1)

    def nearest(self, part: int, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of ``book`` (entries, dimensions) and its squared distance, by row, for one part."""
        width = book.shape[1]
        inside = range(part * width, (part + 1) * width)
        reach = max([int(np.abs(book).max()), *(int(np.abs(self.values[j]).max()) for j in inside)])
        kind = "i4" if width * (2 * reach) ** 2 < 1 << 31 else "i8"
        total = np.zeros((len(self.ids), len(book)), kind)
        for k, j in enumerate(inside):
            table = (np.square(self.values[j][:, None] - book[None, :, k])).astype(kind)
            total += table[self.codes[j]]
        at = total.argmin(axis=1)
        return at, total[np.arange(len(at)), at].astype("i8")

    def sums(self, part: int, at: np.ndarray, entries: int, width: int) -> np.ndarray:
        """By entry, the sums of its parts' components: each dictionary value times how often an entry meets it."""
        out = np.zeros((entries, width), "i8")
        for k in range(width):
            j = part * width + k
            np.add.at(out[:, k], at, self.values[j][self.codes[j]])
        return out


def _blocks(batches):
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield Block(*row)


def trained(held: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, dimensions of a part) after ``rounds`` rounds over all blocks."""
    parts, entries, width = books.shape

    def run(now: np.ndarray):
        def tasks(batches):
            count, total = np.zeros((parts, entries), "i8"), np.zeros((parts, entries, width), "i8")
            for block in _blocks(batches):
                for p in range(parts):
                    at, _ = block.nearest(p, now[p])
                    count[p] += np.bincount(at, minlength=entries)
                    total[p] += block.sums(p, at, entries, width)
            p, e = np.nonzero(count)
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), *(pa.array(total[p, e, k]) for k in range(width))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *(f"s{k}" for k in range(width))])

        return tasks

    names = ["n", *(f"s{k}" for k in range(width))]
    for _ in range(rounds):
        found = held.mapInArrow(run(books), "part int, entry int, " + ", ".join(f"{c} long" for c in names))
        found = found.groupBy("part", "entry").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names])
        books = books.copy()
        for row in found.collect():  # a row an entry
            n, *s = (int(row[c]) for c in names)
            books[row["part"], row["entry"]] = [x // n for x in s]
    return books


def assigned(held: DataFrame, books: np.ndarray) -> DataFrame:
    """``(row, code, error)``: entries in part order, two hex digits each, and the squared distances summed over parts."""
    parts, entries, _ = books.shape
    if entries > 256:
        raise ValueError("a code of two hex digits tells 256 entries apart")

    def run(batches):
        for block in _blocks(batches):
            found = [block.nearest(p, books[p]) for p in range(parts)]
            codes = np.stack([at for at, _ in found], axis=1).astype("u1")
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]), pa.array(sum(error for _, error in found))], ["row", "code", "error"])

    return held.mapInArrow(run, "row long, code string, error long")


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` for each vector that takes part."""
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("a block holds up to 65,536 vectors: codes have two bytes")
    rows = integers(vectors, scale, id_col, vector_col, label_col).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "integers")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = _numbers(pa.array([r["v"] for r in first], pa.list_(pa.int64())))
    dims = start.shape[1] if len(first) else parts
    if not dims or dims % parts:
        raise ValueError(f"{parts} parts do not divide {dims} dimensions")
    books = np.ascontiguousarray(start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2))
    held = materialise(blocks(rows, dims, block_rows), "blocks")
    books = trained(held, books, rounds if len(first) else 0)
    coded = materialise(rows.select("row", "id", "label").join(assigned(held, books), "row").drop("row"), "codes")
    by_label = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    same = coded["label"].eqNullSafe(by_label["label"])
    found = coded.join(small(by_label, by_label.count()), same)
    return found.select("id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
