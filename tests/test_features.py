"""The reranker's features look tags up for their candidates only."""

import os
import re

import pytest

from tracklake.plans import learn_queries

DATA = os.environ.get("TRACKLAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_tag_hits_are_joined_by_candidate(spark):
    plan = learn_queries.features(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    on_tag = [x for x in plan.splitlines() if re.search(r"Join Inner.*tag#\d+ = ", x)]
    assert on_tag and all(re.search(r"track_id#\d+ = track_id#\d+", x) for x in on_tag)
