"""Documents for the tests of this folder."""

import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with further columns of clashing names."""

    def make(rows):
        rows = [(i, t, "xx", None, -1, "clash", "clash", 7) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "fp string, root string, part int").repartition(3)

    return make
