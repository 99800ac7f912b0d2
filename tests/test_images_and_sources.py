import struct

import numpy as np
from pyspark.sql import functions as F
from skymatch.operators import images, kvector
from skymatch.sources import catalogues, frames
from skymatch.streaming import frames as streaming


def pixels(spark, *grids):
    rows = [(f, y, x, int(v)) for f, g in enumerate(grids) for (y, x), v in np.ndenumerate(g)]
    return spark.createDataFrame(rows, "frame_id long, y int, x int, v int")


def grid_of(rows, shape, value="v"):
    out = np.zeros(shape)
    for r in rows:
        out[r["y"], r["x"]] = r[value]
    return out


def test_box_mean_mirrors_the_border(spark):
    g = np.random.default_rng(0).integers(0, 100, (6, 9))
    for size in (3, 7, 15):
        want = np.lib.stride_tricks.sliding_window_view(np.pad(g, size // 2, "symmetric"), (size, size)).mean(axis=(2, 3))
        assert np.allclose(grid_of(images.box_mean(pixels(spark, g), size).collect(), g.shape, "local"), want)


def test_blur_and_medians(spark):
    g = np.random.default_rng(1).integers(0, 100, (7, 8))
    s = 0.3 * (2 - 1) + 0.8
    k = np.exp(-np.arange(-2, 3) ** 2 / (2 * s * s))
    k /= k.sum()
    p = np.pad(g.astype(float), 2, "reflect")
    want = np.lib.stride_tricks.sliding_window_view(p, (5, 5))
    assert np.allclose(grid_of(images.gaussian_blur(pixels(spark, g), 5).collect(), g.shape), np.einsum("ijkl,k,l->ij", want, k, k))
    want = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(g, 1, "symmetric"), (3, 3)), axis=(2, 3))
    assert np.allclose(grid_of(images.median_filter(pixels(spark, g), 3).collect(), g.shape, "local"), want)


def test_components_opening_and_outlines(spark):
    g = np.zeros((9, 12), int)
    g[0:2, 0:2] = 1  # 2 x 2: polygon area 1
    g[3, 3] = 1  # one pixel: 0
    g[4, 4] = 1  # touches it by a corner
    g[5:8, 7:11] = 1
    g[6, 8:10] = 0  # a hole
    on = pixels(spark, g).where("v = 1").select("frame_id", "y", "x")
    assert images.components(on).select("label").distinct().count() == 4 and images.components(on, True).select("label").distinct().count() == 3
    areas = sorted(r["polygon_area"] for r in images.outline_areas(images.components(on, True)).collect())
    assert areas == [0.0, 1.0, 6.0]
    plus = np.zeros((7, 7), int)
    plus[2:5, 1:6] = 1
    opened = {(r["y"], r["x"]) for r in images.opening(pixels(spark, plus).where("v = 1").select("frame_id", "y", "x")).collect()}
    assert opened == {(3, x) for x in range(1, 6)} | {(y, x) for y in (2, 4) for x in (2, 3, 4)}


def test_detector_and_extraction_find_planted_spots(spark):
    y, x = np.indices((40, 50))
    spots = [(10.3, 12.6), (28.0, 35.5)]
    g = 5 + sum(200 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 4) for a, b in spots)
    p = pixels(spark, g.astype(int))
    found = sorted((r["y"], r["x"]) for r in images.detect(p).collect())
    assert np.allclose(found, spots, atol=0.3)
    found = sorted((r["y"] - 0.5, r["x"] - 0.5) for r in images.extract(p).collect())
    assert np.allclose(found, spots, atol=0.3)
    near = images.iterate_centroids(p, spark.createDataFrame([(0, k, b + 1, a - 1) for k, (a, b) in enumerate(spots)], "frame_id long, det_idx long, x double, y double"))
    assert np.allclose(sorted((r["y"], r["x"]) for r in near.collect()), spots, atol=0.1)
    again = images.recentre(images.background(p, "global_median"), images.extract(p), 9)
    assert np.allclose(sorted((r["y"] - 0.5, r["x"] - 0.5) for r in again.collect()), spots, atol=0.2)


def test_dedup_keeps_the_first_of_each_place(spark):
    gray = spark.createDataFrame([(1, 0.0, 0.0)], "frame_id long, x double, y double")
    colour = spark.createDataFrame([(1, 0, 5.0, 0.0), (1, 1, 50.0, 0.0), (1, 2, 55.0, 0.0), (1, 3, 61.0, 0.0), (2, 0, 0.0, 0.0)], "frame_id long, order long, x double, y double")
    assert sorted((r["frame_id"], r["order"]) for r in images.dedup_channels(gray, colour).collect()) == [(1, 1), (1, 3), (2, 0)]


def test_catalogue_files(spark, tmp_path):
    rows = np.array([(1, 0.5, 0.1, 0, 250, 1e-6, 2e-6), (2, 1.5, 0.2, 0, 710, 0, 0), (3, 0, 0, 0, 100, 0, 0)], catalogues.BSC5_RECORD)
    (tmp_path / "bsc").write_bytes(struct.pack("<7i", 0, 1, -3, 1, 1, 1, 32) + rows.tobytes())
    got = catalogues.read_bsc5(spark, str(tmp_path / "bsc"), 6.5, epoch=2010.0).collect()
    assert [r["cat_id"] for r in got] == [1] and abs(got[0]["dec"] - (0.1 + 2e-5)) < 1e-9 and abs(got[0]["ra"] - (0.5 + 1e-5 / np.cos(0.1))) < 1e-9
    (tmp_path / "hip.dat").write_text("H|  11|||| 5.5|||10.0|-20.0|||1.5| |\n\nH|12||||6.5|||11|21|||||\n")
    raw = catalogues.read_pipe(spark, str(tmp_path / "hip.dat")).collect()
    assert [(r["cat_id"], r["mag"], r["ra_deg"], r["pm_ra"], r["pm_dec"]) for r in raw] == [("11", "5.5", "10.0", "1.5", ""), ("12", "6.5", "11", "", "")]
    np.savez(tmp_path / "db.npz", star_table=np.arange(12, dtype="f4").reshape(2, 6), pattern_catalog=np.array([[0, 0, 0, 0], [3, 1, 2, 4]], "u2"), star_catalog_IDs=np.array([[1, 2, 3], [4, 5, 6]], "u2"))
    stars, patterns = catalogues.read_npz(spark, str(tmp_path / "db.npz"))
    assert [r["cat_ids"] for r in stars.collect()] == [[1, 2, 3], [4, 5, 6]] and [r["stars"] for r in patterns.collect()] == [[3, 1, 2, 4]]


def test_centroid_and_image_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# list\n1.5 2.5\n\n3,4\nbad\n")
    got = [(r["det_idx"], r["x"], r["y"]) for r in frames.read_centroids(spark, str(tmp_path / "in")).orderBy("det_idx").collect()]
    assert got == [(0, 1.5, 2.5), (1, 3.0, 4.0), (2, None, None)]
    image = np.arange(12, dtype="u1").reshape(3, 4)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.pgm").write_bytes(b"P5\n# c\n4 3\n255\n" + image.tobytes())
    bmp = np.pad(np.stack([image, image + 1, image + 2], axis=2)[::-1, :, ::-1].reshape(3, 12), ((0, 0), (0, 0)))
    (tmp_path / "img" / "b.BMP").write_bytes(b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 3, 1, 24, 0, 0, 0, 0, 0, 0) + bmp.tobytes())
    (tmp_path / "img" / "c.ppm").write_bytes(b"P6 nonsense")
    rows = frames.read_images(spark, str(tmp_path / "img"))
    assert np.array_equal(grid_of(rows.where("channel = 'gray'").collect(), (3, 4)), image)
    assert np.array_equal(grid_of(rows.where("channel = 'B'").collect(), (3, 4)), image + 2) and rows.where("v is null").count() == 1
    assert frames.to_gray(rows).count() == 24
    out = spark.createDataFrame([(1, 0, 1.234, 5.0), (1, 1, 7.0, 8.0)], "frame_id long, det_idx long, x double, y double")
    frames.write_centroids(out, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out" / "frame_id=1")).collect()] == ["1.23 5.00", "7.00 8.00"]


def test_pair_index_file(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 1, 0.11, 0), (2, 3, 0.31, 2), (1, 3, 0.5, 3)], "i long, j long, dist double, bin int")
    (tmp_path / "k.bin").write_bytes(bytes(frames.pair_index_bytes(pairs, 0.1, 0.5, 4).first()["content"]))
    got = sorted((r["i"], r["j"], r["bin"]) for r in frames.read_pair_index(spark, str(tmp_path / "k.bin")).collect())
    assert got == [(0, 1, 0), (1, 3, 3), (2, 3, 2)]
    upto = [(r["bin"], r["pairs"], r["upto"]) for r in kvector.prefix(pairs, 4).orderBy("bin").collect()]
    assert upto == [(0, 1, 1), (1, 0, 1), (2, 1, 2), (3, 1, 3)]


def test_stream_of_centroid_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("".join(f"{10 * i + k} {20 * i}\n" for i in range(1, 5)))
    files = streaming.centroid_files(spark, str(tmp_path / "in"))
    run = streaming.identify_stream(files, lambda d: d.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [4, 4, 4]
