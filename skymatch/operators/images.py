"""Spot extraction from pixel tables ``pixels(frame_id, y, x, v)``.

Point operations, statistics, box means and blocks are plain aggregates and
windows over the long table. What has no such form (blob labelling, outlines,
medians, iterated centroids) is a NumPy function over one frame; frames are
bounded, so a group is too.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .scratch import stored


def normalise(pixels: DataFrame) -> DataFrame:
    """Stretch each frame's values to 0..255; a flat frame becomes 0."""
    span = Window.partitionBy("frame_id")
    low, high = F.min("v").over(span), F.max("v").over(span)
    return pixels.withColumn("v", F.when(high > low, (F.col("v") - low) * 255.0 / (high - low)).otherwise(0.0))


def frame_stats(pixels: DataFrame, sigmas: float, most: float | None = None, whole: bool = False) -> DataFrame:
    """``frame_id, mean, std, threshold``: mean + sigmas * population deviation, perhaps cut to ``most`` or to an integer."""
    t = F.col("mean") + sigmas * F.col("std")
    t = t if most is None else F.least(t, F.lit(float(most)))
    stats = pixels.groupBy("frame_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return stats.withColumn("threshold", F.floor(t).cast("double") if whole else t)


def mask(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pixels strictly above their frame's threshold; the threshold table has a row a frame."""
    return pixels.join(thresholds.select("frame_id", "threshold"), "frame_id").where(F.col("v") > F.col("threshold")).drop("threshold")


def _sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def box_mean(pixels: DataFrame, size: int, value: str = "v") -> DataFrame:
    """Add ``local``: the mean of the size x size box around each pixel, the border mirrored with its edge. In tiles."""
    return tiles.filtered(pixels, _half(size), value, lambda grid: _means(grid, size), "symmetric")


def _half(size: int) -> int:
    if size % 2 == 0:
        raise ValueError("the box must be odd")
    return size // 2


def _means(padded: np.ndarray, size: int) -> np.ndarray:
    """Means of all whole boxes."""
    sums = np.pad(padded.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / (size * size)


def mean_filtered(grid: np.ndarray, size: int) -> np.ndarray:
    """`box_mean` of one grid."""
    return _means(np.pad(grid, _half(size), "symmetric"), size)


def median_filtered(grid: np.ndarray, size: int) -> np.ndarray:
    """`median_filter` of one grid."""
    return _medians(np.pad(grid, _half(size), "symmetric"), size)


def background(pixels: DataFrame, mode: str | None, size: int = 25) -> DataFrame:
    """Subtract the local or global mean or median (``local_mean``, ``local_median``, ``global_mean``, ``global_median``, None)."""
    if mode is None:
        return pixels.withColumn("v", F.col("v").cast("double"))
    if mode == "local_mean":
        return box_mean(pixels, size).withColumn("v", F.col("v") - F.col("local")).drop("local")
    if mode == "local_median":
        return median_filter(pixels, size).withColumn("v", F.col("v") - F.col("local")).drop("local")
    if mode not in ("global_mean", "global_median"):
        raise ValueError(f"unknown background mode {mode}")
    level = pixels.groupBy("frame_id").agg((F.avg("v") if mode == "global_mean" else F.median("v")).alias("_level"))
    return pixels.hint("merge").join(level, "frame_id").withColumn("v", F.col("v") - F.col("_level")).drop("_level")


def noise(pixels: DataFrame, mode: str, sigma: float, size: int = 25) -> DataFrame:
    """Add ``threshold``: sigma times the root mean square or 1.48 times the median of absolute values, of the frame or the box."""
    if mode.startswith("global"):
        level = {"global_root_square": F.sqrt(F.avg(F.col("v") * F.col("v"))), "global_median_abs": F.median(F.abs("v")) * 1.48}[mode]
        return pixels.hint("merge").join(pixels.groupBy("frame_id").agg((level * sigma).alias("threshold")), "frame_id")
    if mode == "local_root_square":
        return box_mean(pixels.withColumn("_sq", F.col("v") * F.col("v")), size, "_sq").withColumn("threshold", F.sqrt("local") * sigma).drop("local", "_sq")
    if mode == "local_median_abs":
        return median_filter(pixels.withColumn("_abs", F.abs("v")), size, "_abs").withColumn("threshold", F.col("local") * 1.48 * sigma).drop("local", "_abs")
    raise ValueError(f"unknown noise mode {mode}")


_CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def opening(spots: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Erode and dilate a table of set pixels ``(frame_id, y, x)`` by the 3 x 3 cross.

    Outside the frame nothing is set; with ``sizes(frame_id, h, w)`` the outside does not erode.
    """
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _CROSS])
    spread = spots.select("frame_id", "y", "x", F.explode(shifts).alias("s")).select("frame_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    eroded = spread.groupBy("frame_id", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    if sizes is None:
        eroded = eroded.where("n = 5").drop("n")
    else:
        out = [F.col("y") == 0, F.col("x") == 0, F.col("y") == F.col("h") - 1, F.col("x") == F.col("w") - 1]
        framed = eroded.join(sizes, "frame_id").where(F.col("y").between(0, F.col("h") - 1) & F.col("x").between(0, F.col("w") - 1))
        eroded = framed.where(F.col("n") == F.lit(5) - sum(c.cast("int") for c in out)).select("frame_id", "y", "x")
    grown = eroded.select("frame_id", "y", "x", F.explode(shifts).alias("s")).select("frame_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return grown.distinct() if sizes is None else grown.join(spots.hint("merge"), ["frame_id", "y", "x"], "left_semi").distinct()  # a grown pixel inside was set before


def blob_labels(y: np.ndarray, x: np.ndarray, corners: bool) -> np.ndarray:
    """Each pixel's blob, numbered by first pixels in reading order: neighbours are linked, links merged by halving paths."""
    wide = int(x.max(initial=0)) + 2
    place = y.astype("i8") * wide + x
    order = np.argsort(place, kind="stable")
    held = place[order]
    label = np.arange(len(held))
    a, b = [], []
    for step in (1, wide, *((wide - 1, wide + 1) if corners else ())):  # a free column keeps rows apart
        at = np.minimum(np.searchsorted(held, held + step), len(held) - 1)
        met = np.nonzero(held[at] == held + step)[0]
        a.append(met)
        b.append(at[met])
    a, b = np.concatenate(a), np.concatenate(b)
    while len(a):
        p, q = label[a], label[b]
        open_ = p != q
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        up = np.arange(len(held))
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while not ((far := up[up]) == up).all():
            up = far
        label = up[label]
    out = np.empty(len(held), "i8")
    out[order] = np.searchsorted(np.unique(label), label)
    return out


def components(spots: DataFrame, corners: bool = False) -> DataFrame:
    """Add ``label``: blobs of each frame numbered from 0 by their first pixel in reading order; joined by edges, or corners too. In tiles."""
    return tiles.labelled(spots, corners, blob_labels)


def moments(blobs: DataFrame) -> DataFrame:
    """``frame_id, label, sum, y, x, m2_xx, m2_yy, m2_xy, area, axis_ratio`` of labelled pixels; places are pixel centres (+ 0.5)."""
    at = blobs.groupBy("frame_id", "label").agg(F.sum("v").cast("double").alias("sum"), F.count(F.lit(1)).alias("area"), F.sum(F.col("x") * F.col("v")).alias("_x"), F.sum(F.col("y") * F.col("v")).alias("_y"))
    at = at.withColumn("_x", F.when(F.col("sum") != 0, F.col("_x") / F.col("sum"))).withColumn("_y", F.when(F.col("sum") != 0, F.col("_y") / F.col("sum")))
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    held = blobs.join(at, ["frame_id", "label"]).groupBy("frame_id", "label").agg(
        *[F.first(c).alias(c) for c in ("sum", "area", "_x", "_y")], F.sum(dx * dx * F.col("v")).alias("xx"), F.sum(dy * dy * F.col("v")).alias("yy"), F.sum(dx * dy * F.col("v")).alias("xy")
    )
    m0 = F.when(F.col("sum") != 0, F.col("sum"))
    xx, yy, xy = F.greatest(F.lit(0.0), F.col("xx") / m0), F.greatest(F.lit(0.0), F.col("yy") / m0), F.col("xy") / m0
    rows = held.select("frame_id", "label", "sum", (F.col("_y") + 0.5).alias("y"), (F.col("_x") + 0.5).alias("x"), xx.alias("m2_xx"), yy.alias("m2_yy"), xy.alias("m2_xy"), "area")
    root = F.sqrt(F.pow(F.col("m2_xx") - F.col("m2_yy"), 2) + 4 * F.col("m2_xy") * F.col("m2_xy"))
    both = F.col("m2_xx") + F.col("m2_yy")
    minor = F.sqrt(2 * F.greatest(F.lit(0.0), both - root))
    return rows.withColumn("axis_ratio", F.sqrt(2 * (both + root)) / F.greatest(minor, F.lit(1e-9)))


def gate(spots: DataFrame, min_area: int | None = 5, max_area: int | None = 100, min_sum: float | None = None, max_sum: float | None = None, max_axis_ratio: float | None = None) -> DataFrame:
    """Add ``reject``: the first gate that a spot fails, or null. A limit of None or 0 is off."""
    tests = []
    if min_area:
        tests.append(("min_area", F.col("area") < min_area))
    if max_area:
        tests.append(("max_area", F.col("area") > max_area))
    if min_sum:
        tests.append(("min_sum", F.col("sum") < min_sum))
    if max_sum:
        tests.append(("max_sum", F.col("sum") > max_sum))
    if max_axis_ratio:
        tests.append(("max_axis_ratio", F.col("axis_ratio") > max_axis_ratio))
    out: Column = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(test, F.lit(name)).otherwise(out)
    return spots.withColumn("reject", out)


def brightest(spots: DataFrame, most: int | None, by: str = "sum") -> DataFrame:
    """Number each frame's spots from 0, brightest first, and keep ``most``."""
    order = Window.partitionBy("frame_id").orderBy(F.desc(by), "y", "x")
    rows = spots.withColumn("det_idx", (F.row_number().over(order) - 1).cast("long"))
    return rows if most is None else rows.where(F.col("det_idx") < most)


def boxes(blobs: DataFrame) -> DataFrame:
    """Bounding boxes ``x1, y1, x2, y2`` (ends excluded) and pixel counts of labelled pixels."""
    return blobs.groupBy("frame_id", "label").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count(F.lit(1)).alias("n_pixels"))


def outline_areas(blobs: DataFrame) -> DataFrame:
    """``frame_id, label, polygon_area``: area of the polygon through the outer boundary's pixel centres.

    By Pick's theorem it is (pixels enclosed, holes filled) minus half the
    boundary's lattice points minus 1 plus 1; one pixel has 0 and a 2 x 2 block 1.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, b in pdf.groupby("label"):
            out.append((b.frame_id.iloc[0], label, _outline(b.y.to_numpy(), b.x.to_numpy())))
        return pd.DataFrame(out, columns=["frame_id", "label", "polygon_area"])

    return blobs.select("frame_id", "label", "y", "x").groupBy("frame_id").applyInPandas(run, "frame_id long, label long, polygon_area double")


#: The eight neighbours, clockwise from east in image rows that grow downwards.
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _outline(y: np.ndarray, x: np.ndarray) -> float:
    """Follow the outer boundary once and sum the shoelace terms of its steps."""
    on = set(zip(y.tolist(), x.tolist(), strict=True))
    start = min(on)
    at, side, twice, first = start, 4, 0, None
    for _ in range(8 * len(on) + 8):
        for turn in range(1, 9):
            d = (side + turn) % 8
            nxt = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if nxt in on:
                break
        else:
            return 0.0
        if first is None:
            first = (at, nxt)
        elif (at, nxt) == first:
            break
        twice += at[1] * nxt[0] - nxt[1] * at[0]
        side, at = (d + 4) % 8, nxt
    return abs(twice) / 2


def inside(pixels: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels ``(frame_id, y, x, v)`` with ``keys`` of each rectangle ``(frame_id, x1, y1, x2, y2)`` that holds them, and its corners.

    The rows of a rectangle meet the rows of pixels, so no pixel meets all rectangles of its frame.
    """
    rows = rects.select("frame_id", *keys, "x1", "y1", "x2", "y2").withColumn("y", F.explode(F.sequence(F.col("y1").cast("int"), F.col("y2").cast("int") - 1))).hint("merge")  # copies are not in Spark's estimate of size: it would broadcast them
    return pixels.select("frame_id", "y", "x", "v").join(rows, ["frame_id", "y"]).where("x >= x1 and x < x2")


def ring_centroids(pixels: DataFrame, rects: DataFrame, guard: bool = True) -> DataFrame:
    """Rectangles with ``ring`` (mean of their one-pixel border), ``contrast`` (highest value less ring), ``mass`` and centroid above the ring.

    With ``guard`` rectangles of at most two pixels a side have ring 0.
    """
    held = inside(pixels, rects, ["label"])  # read once: pixels are dealt by row for it
    edge = (F.col("x") == F.col("x1")) | (F.col("x") == F.col("x2") - 1) | (F.col("y") == F.col("y1")) | (F.col("y") == F.col("y2") - 1)
    own = Window.partitionBy("frame_id", "label")
    held = held.select("frame_id", "label", "y", "x", "v", "x1", "y1", "x2", "y2", F.avg(F.when(edge, F.col("v"))).over(own).alias("ring"))
    if guard:
        held = held.withColumn("ring", F.when((F.col("x2") - F.col("x1") <= 2) | (F.col("y2") - F.col("y1") <= 2), 0.0).otherwise(F.col("ring")))
    above = held.withColumn("a", F.greatest(F.col("v") - F.col("ring"), F.lit(0.0)))
    out = above.groupBy("frame_id", "label").agg(F.first("ring").alias("ring"), (F.max("v") - F.first("ring")).alias("contrast"), F.sum("a").alias("mass"), F.sum(F.col("a") * F.col("x")).alias("_x"), F.sum(F.col("a") * F.col("y")).alias("_y"))
    return out.select("frame_id", "label", "ring", "contrast", "mass", *[F.when(F.col("mass") > 0, F.col(f"_{c}") / F.col("mass")).alias(c) for c in "xy"])


def roi_centroids(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """Centroids over whole rectangles after subtracting their mean; rectangles without mass are dropped."""
    held = inside(pixels, rects, ["label"])
    mean = held.groupBy("frame_id", "label").agg(F.avg("v").alias("mean"))
    above = held.select("frame_id", "label", "x", "y", "v").join(mean, ["frame_id", "label"]).withColumn("a", F.greatest(F.col("v") - F.col("mean"), F.lit(0.0)))
    out = above.groupBy("frame_id", "label").agg(F.sum("a").alias("intensity"), F.sum(F.col("a") * F.col("x")).alias("_x"), F.sum(F.col("a") * F.col("y")).alias("_y"), F.max("v").alias("peak"))
    return out.where("intensity > 0").select("frame_id", "label", (F.col("_x") / F.col("intensity")).alias("x"), (F.col("_y") / F.col("intensity")).alias("y"), "intensity", "peak")


def detect(pixels: DataFrame, sigmas: float = 3.0, min_area: float = 2.0, cap: float | None = 255.0) -> DataFrame:
    """Star detector: threshold, eight-connected blobs, outline area, centroid over the bounding box, body vector.

    ``frame_id, det_idx, x, y, intensity, peak, radius, ux, uy, uz``; numbered by intensity.
    """
    from ..functions import geometry as g

    blobs = stored(components(mask(pixels, frame_stats(pixels, sigmas, cap)), corners=True), "blobs")
    areas = outline_areas(blobs).where(F.col("polygon_area") >= min_area)
    rects = boxes(blobs).join(areas, ["frame_id", "label"])
    found = roi_centroids(pixels, rects).join(areas, ["frame_id", "label"])
    u = g.u_body("x", "y")
    rows = found.select("frame_id", "x", "y", "intensity", "peak", F.sqrt(F.col("polygon_area") / math.pi).alias("radius"), *[c.alias(f"u{k}") for c, k in zip(u, "xyz", strict=True)])
    return brightest(rows, None, "intensity")


def extract(
    pixels: DataFrame, sigma: float = 2.0, threshold: float | None = None, size: int = 25, bg_mode: str | None = "local_mean", sigma_mode: str = "global_root_square", binary_open: bool = True, max_area: int | None = 100, min_area: int | None = 5,
    max_sum: float | None = None, min_sum: float | None = None, max_axis_ratio: float | None = None, most: int | None = None, crop: tuple[int, int] | int | None = None, offset: tuple[int, int] = (0, 0), downsample: int | None = None, window: int | None = None,
    rejects: bool = False,
) -> DataFrame:
    """Spot extraction in one chain: window, background, noise, threshold, opening, labels, moments, gates, order by brightness.

    ``crop`` (height and width, or a divisor of both) with ``offset`` (y, x) and
    ``downsample`` choose what is looked at; with ``window`` centroids are taken
    anew in squares of that side. Places are those of the whole frame. With
    ``rejects`` rejected blobs follow, with the gate in ``reject`` and no number.
    """
    at = None
    if crop is not None or downsample:
        at = stored(_sizes(pixels), "sizes")
        height, width, divisor = (None, None, crop) if isinstance(crop, int) else (*(crop or (None, None)), None)
        if crop is not None:
            window_of = _window(height, width, *offset, downsample or 2, divisor)
            pixels = crop_to(pixels, height, width, *offset, multiple=downsample or 2, divisor=divisor)
        at = at.select("frame_id", *[(window_of[k] if crop is not None else F.lit(0)).alias(n) for k, n in ((2, "_oy"), (3, "_ox"))])
        pixels = reduced(pixels, downsample) if downsample else pixels
    flat = stored(background(pixels, bg_mode, size), "flat")
    noisy = flat.withColumn("threshold", F.lit(float(threshold))) if threshold is not None else noise(flat, sigma_mode, sigma, size)
    on = noisy.where(F.col("v") > F.col("threshold")).select("frame_id", "y", "x", "v")
    if binary_open:
        on = flat.select("frame_id", "y", "x", "v").join(opening(on.select("frame_id", "y", "x")), ["frame_id", "y", "x"], "left_semi")
    found = gate(moments(stored(components(on), "blobs")), min_area, max_area, min_sum, max_sum, max_axis_ratio)
    found = stored(found, "found") if rejects else found
    spots = brightest(found.where("reject is null").drop("reject"), most)
    if window is not None:
        spots = stored(spots, "spots")
        again = recentre(flat, spots, window).withColumnsRenamed({"x": "_nx", "y": "_ny"})
        spots = spots.join(again, ["frame_id", "det_idx"], "left").withColumns({"x": F.col("_nx"), "y": F.col("_ny")}).drop("_nx", "_ny")
    if rejects:
        lost = found.where("reject is not null").withColumn("det_idx", F.lit(None).cast("long"))
        spots = spots.withColumn("reject", F.lit(None).cast("string")).unionByName(lost)
    if at is None:
        return spots
    names = spots.columns
    return spots.join(at, "frame_id").withColumns({c: F.col(c) * (downsample or 1) + F.col(f"_o{c}") for c in "xy"}).select(*names)


def downsample(pixels: DataFrame, factor: int, mean: bool = False) -> DataFrame:
    """Sums or means of factor x factor blocks; blocks that the frame cuts are left out."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int")
    rows = pixels.groupBy("frame_id", block("y").alias("y"), block("x").alias("x")).agg((F.avg("v") if mean else F.sum("v")).alias("v"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") == factor * factor).drop("n")


def crop(pixels: DataFrame, height: int | None = None, width: int | None = None, dy: int = 0, dx: int = 0, multiple: int = 2, divisor: int | None = None) -> DataFrame:
    """A centred window moved by (dy, dx): its size is rounded up to ``multiple`` and cut to the frame, as is its place.

    With ``divisor`` the window is that fraction of each frame's height and width.
    """
    rows = pixels.join(_sizes(pixels), "frame_id")
    ch, cw, oy, ox = _window(height, width, dy, dx, multiple, divisor)
    at = rows.withColumns({"y": (F.col("y") - oy).cast("int"), "x": (F.col("x") - ox).cast("int")}).withColumns({"_ch": ch, "_cw": cw})
    return at.where("y >= 0 and x >= 0 and y < _ch and x < _cw").drop("h", "w", "_ch", "_cw")


def _window(height: int | None, width: int | None, dy: int, dx: int, multiple: int, divisor: int | None) -> tuple[Column, Column, Column, Column]:
    """Height, width and corner of a window in a frame of ``h`` by ``w``."""
    part = lambda n, most: F.lit(n) if divisor is None else F.floor(F.col(most) / divisor)
    up = lambda n, most: F.least(F.ceil(part(n, most) / multiple).cast("int") * multiple, F.floor(F.col(most) / multiple).cast("int") * multiple)
    ch, cw = up(height, "h"), up(width, "w")
    oy = F.least(F.greatest(F.floor((F.col("h") - ch) / 2).cast("int") + dy, F.lit(0)), F.col("h") - ch)
    ox = F.least(F.greatest(F.floor((F.col("w") - cw) / 2).cast("int") + dx, F.lit(0)), F.col("w") - cw)
    return ch, cw, oy, ox


#: Names for use where arguments are called like the functions.
crop_to, reduced = crop, downsample


def crop_and_downsample(pixels: DataFrame, factor: int | None = None, mean: bool = False, **window) -> DataFrame:
    """A cropped window (see `crop`; its size becomes a multiple of ``factor``), then blocks of ``factor`` summed or averaged."""
    if window:
        pixels = crop(pixels, multiple=factor or 2, **window)
    return downsample(pixels, factor, mean) if factor else pixels


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to as many tasks as there are shuffle partitions: small rows, much work, not to be put together by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _grid(pdf: pd.DataFrame, value: str) -> np.ndarray:
    grid = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1))
    grid[pdf.y, pdf.x] = pdf[value]
    return grid


#: Values of boxes that are held at once when medians are taken.
BOX_VALUES = 8_000_000


def _medians(padded: np.ndarray, size: int) -> np.ndarray:
    """Medians of all whole boxes, some rows at a time."""
    boxes_of = np.lib.stride_tricks.sliding_window_view(padded, (size, size))
    step = max(1, BOX_VALUES // (boxes_of.shape[1] * size * size))
    return np.concatenate([np.median(boxes_of[y : y + step], axis=(2, 3)) for y in range(0, len(boxes_of), step)])


def median_filter(pixels: DataFrame, size: int, value: str = "v") -> DataFrame:
    """Add ``local``: the median of the box around each pixel, the border mirrored with its edge. In tiles."""
    return tiles.filtered(pixels, _half(size), value, lambda grid: _medians(grid, size), "symmetric")


def _weights(size: int, sigma: float = 0.0) -> np.ndarray:
    """Gaussian weights that sum to 1; sigma 0 is the usual one for ``size``."""
    r, s = size // 2, sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-np.square(np.arange(-r, r + 1)) / (2 * s * s))
    return weights / weights.sum()


def _weighed(padded: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """Gaussian sums of all whole boxes."""
    for _ in range(2):
        padded = (np.lib.stride_tricks.sliding_window_view(padded, size, axis=1) @ _weights(size, sigma)).T
    return padded


def _blurred(grid: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    """Gaussian weights along the last two axes, the border mirrored without its edge; sigma 0 is the usual one for ``size``."""
    r, weights = size // 2, _weights(size, sigma)
    for axis in (-2, -1):
        at = [(0, 0)] * grid.ndim
        at[axis] = (r, r)
        grid = np.pad(grid, at, "reflect") if grid.shape[axis] > 1 else np.repeat(grid, size, axis=axis)
    for _ in range(2):
        grid = np.swapaxes(np.lib.stride_tricks.sliding_window_view(grid, size, axis=-1) @ weights, -1, -2)
    return grid


def gaussian_blur(pixels: DataFrame, size: int = 5, sigma: float = 0.0) -> DataFrame:
    """``v`` weighted by a Gaussian; the border is mirrored without its edge. In tiles."""
    rows = pixels.select("frame_id", "y", "x", F.col("v").cast("double").alias("v"))
    return tiles.filtered(rows, _half(size), "v", lambda grid: _weighed(grid, size, sigma), "reflect").select("frame_id", "y", "x", F.col("local").alias("v"))


def _smaller(grid: np.ndarray, factor: int) -> np.ndarray:
    """Every ``factor``-th pixel, as the nearest-neighbour scaling to 1 / factor picks them."""
    h, w = (max(1, round(n / factor)) for n in grid.shape[-2:])
    at = lambda n, m: np.minimum((np.arange(m) * (n / m)).astype(int), n - 1)
    return grid[..., at(grid.shape[-2], h)[:, None], at(grid.shape[-1], w)]


def _larger(grid: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Linear scaling of the last two axes to ``shape``, pixel centres on pixel centres, the border held."""
    for axis, n in zip((-2, -1), shape, strict=True):
        m = grid.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.minimum(at.astype(int), max(0, m - 2))
        part = (at - low)[:, None] if axis == -2 else at - low
        grid = np.take(grid, low, axis) * (1 - part) + np.take(grid, np.minimum(low + 1, m - 1), axis) * part
    return grid


#: Pixels whose frames are worked on together.
TOGETHER = 200_000


def whole_frames(batches, most: int):
    """Tables of whole frames, of about ``most`` rows or one frame, from batches in which a frame's rows are next to each other."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        ids = table["frame_id"].to_numpy()
        cut = np.flatnonzero(ids != ids[-1])  # the last frame may go on in the next batch
        cut = cut[-1] + 1 if len(cut) else 0
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), len(ids) - cut
    if rows:
        yield pa.Table.from_batches(held)


def _stacks(table: pa.Table, value: str):
    """For the frames of each shape: which rows are theirs, their pixels as (frame, y, x), and where each row's pixel is in them."""
    ids, y, x = (table[c].to_numpy() for c in ("frame_id", "y", "x"))
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    h, w = (np.maximum.reduceat(c, first) + 1 for c in (y, x))
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
    shapes, kind = np.unique(np.stack([h, w], axis=1), axis=0, return_inverse=True)
    for k, (height, width) in enumerate(shapes):
        frames = np.flatnonzero(kind == k)
        rows = np.flatnonzero((kind == k)[of])
        at = np.searchsorted(frames, of[rows]), y[rows], x[rows]
        grid = np.zeros((len(frames), height, width))
        grid[at] = table[value].to_numpy()[rows]
        yield rows, grid, at


def flattened(pixels: DataFrame, whole: bool, factor: int = 16) -> DataFrame:
    """``(frame_id, y, x, smooth, clean)``: a 3 x 3 blur, and that less a background by scaling down, median and scaling up, not below 0.

    With ``whole`` values are rounded to integers at each step, as 8-bit images are.
    Frames of a shape are worked on together, about ``TOGETHER`` pixels at a time; a frame is not divided.
    """
    step = (lambda g: np.floor(g + 0.5)) if whole else (lambda g: g)

    def run(batches):
        for table in whole_frames(batches, TOGETHER):
            smooth, clean = np.zeros(table.num_rows), np.zeros(table.num_rows)
            for rows, grid, at in _stacks(table, "v"):
                blur = step(_blurred(grid, 3, 1.0))
                small = np.pad(np.floor(_smaller(blur, factor)), ((0, 0), (1, 1), (1, 1)), "edge")
                windows = np.lib.stride_tricks.sliding_window_view(small, (3, 3), axis=(-2, -1))
                ground = step(_larger(np.median(windows, axis=(-2, -1)), blur.shape[-2:]))
                smooth[rows], clean[rows] = blur[at], np.maximum(blur - ground, 0)[at]
            yield from pa.table([*table.select(["frame_id", "y", "x"]).columns, pa.array(smooth), pa.array(clean)], ["frame_id", "y", "x", "smooth", "clean"]).to_batches()

    kind = pixels.schema["frame_id"].dataType.simpleString()
    rows = pixels.select("frame_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return _spread(rows, "frame_id").sortWithinPartitions("frame_id").mapInArrow(run, f"frame_id {kind}, y int, x int, smooth double, clean double")


def simple_process(pixels: DataFrame, sigmas: float = 4.0) -> DataFrame:
    """``(frame_id, y, x, blur, clean, binary)``: blur of 5, less its own blur of 51, and what passes mean + sigmas * deviation; 8-bit values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blur = np.floor(_blurred(_grid(pdf, "v"), 5) + 0.5)
        clean = np.maximum(blur - np.floor(_blurred(blur, 51) + 0.5), 0)
        binary = np.where(clean > np.floor(clean.mean() + sigmas * clean.std()), 255, 0)
        return pdf[["frame_id", "y", "x"]].assign(**{name: grid[pdf.y, pdf.x].astype("i4") for name, grid in (("blur", blur), ("clean", clean), ("binary", binary))})

    kind = pixels.schema["frame_id"].dataType.simpleString()
    return pixels.select("frame_id", "y", "x", "v").groupBy("frame_id").applyInPandas(run, f"frame_id {kind}, y int, x int, blur int, clean int, binary int")


#: Two-stage detection: least contrast above the ring, longest side over the shortest, nearness of detections that are one.
CONTRAST, ASPECT, APART = 5.0, 4.0, 10.0


def contour_spots(clean: DataFrame, shown: str, sigmas: float, pad: int, share: float) -> DataFrame:
    """Spots of ``flattened`` frames, which are read several times and so should be stored: ``frame_id, label, x, y, w, h, first``.

    Threshold on the whole part of ``clean``, opening, blobs joined by corners,
    boxes that are not elongated, widened by ``share`` of their longer side (``pad``
    at least), contrast above the ring, centroid above the ring in column ``shown``.
    """
    sizes = _sizes(clean)
    level = F.floor("clean")
    limit = clean.groupBy("frame_id").agg(F.floor(F.avg("clean") + sigmas * F.stddev_pop("clean")).alias("threshold"))
    on = clean.join(limit, "frame_id").where(level > F.col("threshold")).select("frame_id", "y", "x")
    box = boxes(components(opening(on, sizes), corners=True)).withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    box = box.where(F.greatest("w", "h") <= ASPECT * F.least("w", "h")).join(sizes.withColumnsRenamed({"h": "fh", "w": "fw"}), "frame_id")
    wide = F.greatest(F.lit(pad), F.floor(F.greatest("w", "h") * share).cast("int"))
    rects = box.select(
        "frame_id", "label", "w", "h", (F.col("y1") * F.col("fw") + F.col("x1")).alias("first"), F.greatest(F.col("x1") - wide, F.lit(0)).alias("x1"), F.greatest(F.col("y1") - wide, F.lit(0)).alias("y1"),
        F.least(F.col("x2") + wide, F.col("fw")).alias("x2"), F.least(F.col("y2") + wide, F.col("fh")).alias("y2"),
    )
    rects = stored(rects, "rects").hint("merge")
    found = ring_centroids(clean.select("frame_id", "y", "x", F.col(shown).alias("v")), rects, guard=False).where((F.col("contrast") >= CONTRAST) & (F.col("mass") > 0))
    return found.select("frame_id", "label", "x", "y").join(rects.select("frame_id", "label", "w", "h", "first"), ["frame_id", "label"])


def two_stage(pixels: DataFrame) -> DataFrame:
    """``(frame_id, channel, x, y)``: spots of the gray image, and those of the channels B, G and R that are new.

    ``pixels(frame_id, channel, y, x, v)`` holds 8-bit channels. Gray spots have
    iterated centroids. A channel's spot is new if no gray one is within `APART`
    pixels and no new one before it, in order of channel and then from the last
    contour to the first.
    """
    weight = F.when(F.col("channel") == "R", 0.299).when(F.col("channel") == "G", 0.587).otherwise(0.114)
    gray = pixels.groupBy("frame_id", "y", "x").agg(F.floor(F.sum(F.col("v") * weight) + 0.5).alias("v"))
    clean = stored(flattened(gray, True), "gray")
    seeds = contour_spots(clean, "smooth", 2.5, 3, 0.5)
    half = F.greatest(F.lit(3), F.floor(F.greatest("w", "h") * 0.5 + 2).cast("int"))
    seeds = seeds.select("frame_id", F.col("label").alias("det_idx"), "x", "y", half.alias("half"))
    spots = stored(iterate_centroids(clean.select("frame_id", "y", "x", F.col("smooth").alias("v")), seeds, stop_small=False), "spots")
    names = F.array(*map(F.lit, "BGR"))  # each channel of a frame is a frame of its own
    number = (F.array_position(names, F.col("channel")) - 1).cast("int")
    planes = pixels.where(F.col("channel").isin(*"BGR")).select((F.col("frame_id") * 3 + number).alias("frame_id"), "y", "x", "v")
    found = contour_spots(stored(flattened(planes, False), "channels"), "clean", 3.5, 2, 0.4)
    k = F.pmod(F.col("frame_id"), F.lit(3)).cast("int")
    found = stored(found.select(((F.col("frame_id") - k) / 3).cast("long").alias("frame_id"), F.struct(k.alias("k"), (-F.col("first")).alias("last")).alias("order"), "x", "y"), "found")
    fresh = dedup_channels(spots, found, APART, APART)
    return spots.select("frame_id", F.lit("gray").alias("channel"), "x", "y").unionByName(fresh.select("frame_id", F.get(names, F.col("order.k")).alias("channel"), "x", "y"))


def recentre(pixels: DataFrame, spots: DataFrame, window: int) -> DataFrame:
    """Centroids anew in a square window around each spot, kept inside the frame; values are taken as they are."""
    held = spots.select("frame_id", "det_idx", F.col("x").alias("_sx"), F.col("y").alias("_sy")).join(_sizes(pixels), "frame_id")
    side = F.least(F.lit(window), "h", "w")
    low = lambda c, n: F.least(F.greatest(F.floor(F.col(c)).cast("int") - F.floor(side / 2).cast("int"), F.lit(0)), F.col(n) - side)
    held = held.withColumn("_x0", low("_sx", "w")).withColumn("_y0", low("_sy", "h"))
    rects = held.select("frame_id", "det_idx", F.col("_x0").alias("x1"), F.col("_y0").alias("y1"), (F.col("_x0") + side).alias("x2"), (F.col("_y0") + side).alias("y2"))
    near = inside(pixels, rects, ["det_idx"])
    sums = near.groupBy("frame_id", "det_idx").agg(F.sum("v").alias("m"), F.sum(F.col("v") * (F.col("x") + 0.5)).alias("mx"), F.sum(F.col("v") * (F.col("y") + 0.5)).alias("my"))
    return sums.select("frame_id", "det_idx", *[F.when(F.col("m") != 0, F.col(f"m{c}") / F.col("m")).alias(c) for c in "xy"])


def iterate_centroids(pixels: DataFrame, spots: DataFrame, half: int = 4, steps: int = 10, close: float = 0.01, stop_small: bool = True) -> DataFrame:
    """Centroids above the ring of a window that follows them until it moves less than ``close`` pixels. One frame a group.

    A spot's own ``half``, if ``spots`` has that column, takes the place of the
    common one. A window of two pixels a side or less ends the search, or, without
    ``stop_small``, is all ring.
    """
    spots = spots if "half" in spots.columns else spots.withColumn("half", F.lit(half))
    own = _spread(spots.select("frame_id", F.struct("det_idx", "x", "y", "half").alias("s")), "frame_id").groupBy("frame_id").agg(F.collect_list("s").alias("spots"))
    seen = _spread(pixels.select("frame_id", F.struct("y", "x", F.col("v").cast("double").alias("v")).alias("p")), "frame_id").groupBy("frame_id").agg(F.collect_list("p").alias("pixels"))

    def run(batches):
        for batch in batches:
            out = []
            for frame, pixel, found in zip(*(batch.column(k) for k in range(3)), strict=True):
                y, x, v = (pixel.values.field(c).to_numpy(zero_copy_only=False) for c in "yxv")
                grid = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
                grid[y, x] = v
                out += [(frame.as_py(), s["det_idx"], *centred(grid, s["x"], s["y"], s["half"])) for s in found.as_py()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["frame_id", "det_idx", "x", "y"])

    def centred(grid: np.ndarray, cx: float, cy: float, half: int) -> tuple[float, float]:
        h, w = grid.shape
        for _ in range(steps):
            x1, y1 = max(0, int(cx) - half), max(0, int(cy) - half)
            x2, y2 = min(w, int(cx) + half + 1), min(h, int(cy) + half + 1)
            roi = grid[y1:y2, x1:x2]
            tiny = min(roi.shape) <= 2
            if not roi.size or (tiny and stop_small):
                break
            ring = roi.mean() if tiny else np.concatenate([roi[0], roi[-1], roi[1:-1, 0], roi[1:-1, -1]]).mean()
            a = np.maximum(roi - ring, 0)
            total = a.sum()
            if total == 0:
                break
            ys, xs = np.indices(a.shape)
            nx, ny = x1 + (xs * a).sum() / total, y1 + (ys * a).sum() / total
            moved = math.hypot(nx - cx, ny - cy)
            cx, cy = float(nx), float(ny)
            if moved < close:
                break
        return cx, cy

    return seen.join(own, "frame_id").select("frame_id", "pixels", "spots").mapInArrow(run, "frame_id long, det_idx long, x double, y double")


def dedup_channels(gray: DataFrame, colour: DataFrame, near_gray: float = 10.0, near_colour: float = 10.0) -> DataFrame:
    """Colour detections that are new: not within ``near_gray`` of a gray one, nor of an accepted earlier one.

    ``colour(frame_id, order, x, y)`` is taken in ``order``. Spots of a frame
    are few; the greedy pass runs on the frame's array, inside the plan.
    """
    from .joins import frame_join

    left = colour.select("frame_id", "order", F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = gray.select("frame_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    seen = frame_join(left, right, near_gray, near_gray, ["frame_id"]).select("frame_id", "order").distinct()
    fresh = colour.join(seen, ["frame_id", "order"], "left_anti")
    held = fresh.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("order", "x", "y"))).alias("all"))

    def accept(kept, s):
        clash = F.exists(kept, lambda k: F.hypot(k["x"] - s["x"], k["y"] - s["y"]) < near_colour)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    taken = held.select("frame_id", F.aggregate("all", F.slice("all", 1, 0), accept).alias("taken"))
    return taken.select("frame_id", F.explode("taken").alias("s")).select("frame_id", "s.order", "s.x", "s.y")


def annotations(spots: DataFrame, shape: str, colour: str, half: float) -> DataFrame:
    """Overlays as a table: ``frame_id, shape, x, y, half, colour``; drawing is left to a viewer."""
    return spots.select("frame_id", F.lit(shape).alias("shape"), "x", "y", F.lit(half).alias("half"), F.lit(colour).alias("colour"))
