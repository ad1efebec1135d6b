import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellfleet.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def points(spark):
    from cellfleet.plans.small import cut
    from cellfleet.sources.testbed import trajectories

    return cut(trajectories(spark, SMALL))


@pytest.fixture(scope="session")
def hot_points(spark, points):
    """One trajectory with a third of all rows, the rest as they are."""
    from pyspark.sql import functions as F
    from cellfleet.plans.small import cut

    n = points.count() // 2
    i = F.col("id")
    hot = spark.range(n).select(
        F.lit(9999).cast("long").alias("trajectory_id"), F.lit(3).cast("long").alias("family"),
        i.alias("reference_index"), (14.0 * i).alias("reference_day"),
        (1 - i / 1000.0).alias("soh_true"), (1 - i / 1000.0 + ((i * 37) % 11) / 1e4).alias("soh_observed"),
    )
    return cut(points.unionByName(hot))


def rows(df, digits=9):
    """Rows in a fixed column and row order, doubles rounded."""
    cols = sorted(df.columns)
    out = []
    for r in df.select(*cols).collect():
        out.append(tuple(round(v, digits) + 0.0 if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)
