"""The one result that is published for the synthetic terraces."""

from cresthaven.functions import lines as L
from cresthaven.plans import pipeline
from cresthaven.plans.config import Config
from cresthaven.sources.frames import terrace


def test_published_lines_and_length(spark):
    """3 crests, 3 toes, no automatic bridge, 548.83 m."""
    found = L.counts(pipeline.lines_of(terrace(spark, wavy=True), Config(link_gap_m=30.0, auto_gap_enabled=True, compat=True))).first()
    assert (found.crest, found.toe, found.auto_gap, found.total_length_m) == (3, 3, 0, 548.83)
