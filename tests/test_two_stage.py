import math

import numpy as np
from skymatch.operators import images
from skymatch.plans import frames as plans
from skymatch.sources import catalogues, frames


def blur(a, size, sigma):
    """Weights by rows and columns, one pixel at a time; the border mirrored without its edge."""
    r = size // 2
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    h, wide = a.shape
    out = np.zeros_like(a, "f8")
    turn = lambda i, n: abs(i) if i < n else 2 * (n - 1) - i
    for y in range(h):
        for x in range(wide):
            out[y, x] = sum(w[i + r] * w[j + r] * a[turn(y + i, h), turn(x + j, wide)] for i in range(-r, r + 1) for j in range(-r, r + 1)) / sum(w) ** 2
    return out


def background(a):
    h, w = a.shape
    small = np.array([[math.floor(a[min(h - 1, y * 16), min(w - 1, x * 16)]) for x in range(max(1, round(w / 16)))] for y in range(max(1, round(h / 16)))], "f8")
    padded = np.pad(small, 1, "edge")
    small = np.array([[np.median(padded[y : y + 3, x : x + 3]) for x in range(small.shape[1])] for y in range(small.shape[0])])
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            fy, fx = (min(max((c + 0.5) * m / n - 0.5, 0), m - 1) for c, m, n in ((y, small.shape[0], h), (x, small.shape[1], w)))
            y0, x0 = int(fy), int(fx)
            y1, x1 = min(y0 + 1, small.shape[0] - 1), min(x0 + 1, small.shape[1] - 1)
            out[y, x] = (small[y0, x0] * (1 - fx + x0) + small[y0, x1] * (fx - x0)) * (1 - fy + y0) + (small[y1, x0] * (1 - fx + x0) + small[y1, x1] * (fx - x0)) * (fy - y0)
    return out


def blobs(on):
    cross = ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))
    h, w = on.shape
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    core = {(y, x) for y in range(h) for x in range(w) if all(on[y + i, x + j] for i, j in cross if inside(y + i, x + j))}
    left = {(y + i, x + j) for y, x in core for i, j in cross if inside(y + i, x + j)}
    out = []
    while left:
        todo, blob = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                blob.add(p)
                todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        out.append(blob)
    return out


def ring_mean(a):
    mask = np.ones(a.shape, bool)
    if min(a.shape) > 2:
        mask[1:-1, 1:-1] = False
    return a[mask].mean()


def above(a, x0, y0):
    a = np.maximum(a - ring_mean(a), 0)
    if a.sum() == 0:
        return None
    ys, xs = np.indices(a.shape)
    return x0 + (a * xs).sum() / a.sum(), y0 + (a * ys).sum() / a.sum()


def spots(on, shown, pad, share, follow):
    h, w = shown.shape
    out = []
    for blob in blobs(on):
        ys, xs = zip(*blob, strict=True)
        bw, bh = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        p = max(pad, int(max(bw, bh) * share))
        x1, y1, x2, y2 = max(0, min(xs) - p), max(0, min(ys) - p), min(w, max(xs) + 1 + p), min(h, max(ys) + 1 + p)
        roi = shown[y1:y2, x1:x2]
        if max(bw, bh) / min(bw, bh) > 4 or roi.max() - ring_mean(roi) < 5:
            continue
        at = above(roi, x1, y1)
        if at is None:
            continue
        for _ in range(10 if follow else 0):
            half = max(3, int(max(bw, bh) * 0.5 + 2))
            x1, y1, x2, y2 = int(max(0, at[0] - half)), int(max(0, at[1] - half)), int(min(w, at[0] + half + 1)), int(min(h, at[1] + half + 1))
            new = above(shown[y1:y2, x1:x2], x1, y1)
            if new is None:
                break
            moved, at = math.hypot(new[0] - at[0], new[1] - at[1]), new
            if moved < 0.01:
                break
        out.append((min(ys) * w + min(xs), at))
    return [at for _, at in sorted(out, reverse=True)]


def plain(channels):
    gray = np.floor(0.299 * channels["R"] + 0.587 * channels["G"] + 0.114 * channels["B"] + 0.5)
    smooth = np.floor(blur(gray, 3, 1.0) + 0.5)
    clean = np.maximum(smooth - np.floor(background(smooth) + 0.5), 0)
    found = [("gray", *at) for at in spots(clean > math.floor(clean.mean() + 2.5 * clean.std()), smooth, 3, 0.5, True)]
    gray_at, taken = [at for _, *at in found], []
    for name in "BGR":
        smooth = blur(channels[name], 3, 1.0)
        clean = np.maximum(smooth - background(smooth), 0)
        for at in spots(np.floor(clean) > math.floor(clean.mean() + 3.5 * clean.std()), clean, 2, 0.4, False):
            if all(math.dist(at, other) >= 10 for other in gray_at + taken):
                taken.append(list(at))
                found.append((name, *at))
    return found


def test_two_stages_equal_the_plain_pipeline(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for f in range(2):
        h, w = (48, 64) if f == 0 else (40, 56)
        y, x = np.indices((h, w))
        shape = lambda cy, cx, top, s=1.6, y=y, x=x: top * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s))
        base = 12 + r.integers(0, 4, (h, w)) + shape(12.3, 20.6, 160) + shape(30.2, 10.4, 120) + (abs(y - 5) <= 1) * (x > 20) * (x < 50) * 90.0
        own = {"B": 0.7 * base, "G": base, "R": base + shape(33.5, 44.4, 160, 1.8)}
        channels = {k: np.minimum(255, np.floor(v)) for k, v in own.items()}
        want[f] = sorted(plain(channels))
        rows += [(f, k, int(a), int(b), int(v[a, b])) for k, v in channels.items() for a in range(h) for b in range(w)]
    pixels = spark.createDataFrame(rows, "frame_id long, channel string, y int, x int, v int")
    got = {0: [], 1: []}
    for row in images.two_stage(pixels).collect():
        got[row["frame_id"]].append((row["channel"], row["x"], row["y"]))
    for f in want:
        mine = sorted(got[f])
        assert [k for k, *_ in mine] == [k for k, *_ in want[f]] and {"gray", "R"} <= {k for k, *_ in mine}
        assert np.allclose([at for _, *at in mine], [at for _, *at in want[f]], atol=1e-6)
    assert images.two_stage(pixels.limit(0)).count() == 0


def test_simple_process_equals_plain_sums(spark):
    a = np.random.default_rng(3).integers(0, 30, (20, 24)).astype("f8")
    a[8:11, 9:12] = 250
    pixels = spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "frame_id long, y int, x int, v int")
    got = images.simple_process(pixels).toPandas().sort_values(["y", "x"])
    smooth = np.floor(blur(a, 5, 1.1) + 0.5)
    assert np.array_equal(got.blur.to_numpy().reshape(a.shape), smooth)
    clean, binary = (got[c].to_numpy().reshape(a.shape) for c in ("clean", "binary"))
    assert set(np.unique(binary)) == {0, 255} and np.array_equal(binary > 0, clean > math.floor(clean.mean() + 4 * clean.std())) and binary[9, 10] == 255


def test_filters_in_bands_and_labels_of_long_snakes(spark, monkeypatch):
    grid = np.random.default_rng(1).random((17, 23))
    whole = images.median_filtered(grid, 5)
    monkeypatch.setattr(images, "BOX_VALUES", 700)
    assert np.array_equal(images.median_filtered(grid, 5), whole)
    snake = [(y, x) for y in range(0, 40, 2) for x in range(40)] + [(y, 39 if y % 4 == 1 else 0) for y in range(1, 39, 2)] + [(60, 3), (61, 4), (63, 7)]
    y, x = (np.array(v) for v in zip(*snake, strict=True))
    assert set(images.blob_labels(y, x, False)[:-3].tolist()) == {0} and images.blob_labels(y, x, False)[-3:].tolist() == [1, 2, 3]
    assert images.blob_labels(y, x, True)[-3:].tolist() == [1, 1, 2]


def test_npz_properties_and_processed_images(spark, tmp_path):
    kind = [("pattern_mode", "U64"), ("max_fov", "f4"), ("catalog_stars_per_fov", "u2"), ("star_min_magnitude", "f4"), ("range_ra", "f4", (2,))]
    np.savez(tmp_path / "old.npz", star_table=np.zeros((1, 6), "f4"), pattern_catalog=np.array([[0, 0, 0, 0], [3, 1, 2, 4]], "u2"), pattern_largest_edge=np.array([0, 250], "f2"), props_packed=np.array(("edge_ratio", 30.0, 20, 7.0, (1.0, 2.0)), kind))
    got = {r["key"]: r["value"] for r in catalogues.read_npz_properties(spark, str(tmp_path / "old.npz")).collect()}
    assert len(got) == 16 and got["verification_stars_per_fov"] == "20" and got["star_max_magnitude"] == "7.0" and got["min_fov"] == got["max_fov"] == "30.0"
    assert got["presort_patterns"] == "False" and got["star_catalog"] == "unknown" and got["pattern_bins"] is None and got["range_ra"] == "[1.0, 2.0]"
    assert [tuple(r) for r in catalogues.read_npz(spark, str(tmp_path / "old.npz"))[1].collect()] == [([3, 1, 2, 4], 0.25)]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "deep.pgm").write_bytes(b"P5 2 1 65535 " + np.array([[1000, 3000]], ">u2").tobytes())
    (tmp_path / "img" / "flat.pgm").write_bytes(b"P5 2 1 255 " + bytes([7, 9]))
    rows = {(r["file"].rsplit("/")[-1], r["x"]): r["v"] for r in frames.load_processed(spark, str(tmp_path / "img")).collect()}
    assert rows == {("deep.pgm", 0): 0.0, ("deep.pgm", 1): 255.0, ("flat.pgm", 0): 7.0, ("flat.pgm", 1): 9.0}


def test_registered_two_stage_query_finds_the_red_spot(spark):
    got = plans.two_stage_detection(spark, "/root/testdata/sf0.001").collect()
    assert {r["channel"] for r in got} >= {"gray", "R"} and all(abs(r["x"] - 8) < 1 and abs(r["y"] - 27) < 1 for r in got if r["channel"] == "R")
