"""The best candidates are found without making all of them."""

import pytest
from pyspark.sql import functions as F

from cresthaven.plans import line_queries as Q

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [20, 100000])
def test_best_candidates_are_the_first_of_all(spark, most):
    order = [F.round("d", 9), "first", "second", "k"]
    pick = lambda df: [tuple(r) for r in df.select("first", "second", "k", "k2").collect()]
    got = pick(Q.best_candidates(spark, D, lambda r: F.round("d", 9) < r - 1e-8, order, most))
    assert got and got == pick(Q.candidates(spark, D).orderBy(*order).limit(most))
