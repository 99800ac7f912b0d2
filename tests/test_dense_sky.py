import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from skymatch.operators import kvector
from skymatch.plans import registry, sky

DATA = "/root/testdata"


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """The smallest tables with 5,000 rows of part."""
    path = tmp_path_factory.mktemp("dense")
    spark.read.parquet(f"{DATA}/sf0.1/part.parquet").where("p_partkey <= 5000").write.parquet(f"{path}/part.parquet")
    for t in ("lineitem", "customer"):
        (path / f"{t}.parquet").symlink_to(f"{DATA}/sf0.001/{t}.parquet")
    return str(path)


NAMES = "geometric_voting pairs_band kvector_bins kvector_range_lookup thin_stars cosine_pairs ball_query pattern_cliques simplified_patterns edge_ratios pattern_codes"


@pytest.mark.parametrize("name", NAMES.split())
def test_limits_do_not_depend_on_the_size_of_the_table(spark, dense, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{dense}/{t}.parquet{'/*.parquet' if t == 'part' else ''}'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, dense)
    names = sorted(got.columns)
    at = [want.columns.index(c) for c in names]
    rows = sorted(tuple(r[c] for c in names) for r in got.collect())
    other = sorted(tuple(r[k] for k in at) for r in want.fetchall())
    assert len(rows) == len(other) > 0
    assert np.allclose(np.array(rows, "f8"), np.array(other, "f8"), rtol=0, atol=2e-6)


def test_votes_by_blocks_equal_votes_in_one(spark, dense):
    detections = sky.frame(spark, dense, "detections").withColumn("det_idx", F.col("det_idx").cast("long"))
    vote = lambda **k: sorted(map(tuple, kvector.vote(detections, sky._index(spark, dense), sky.X_FOV, 320, 240, sky.LOW, sky.HIGH, sky.BINS, sky.TOLERANCE, **k).collect()))
    assert vote(stars=100, spans=1500) == vote()
