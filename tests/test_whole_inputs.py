"""Queries that must take every track, query and vector, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracklake.session import table

DATA = os.environ.get("TRACKLAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_no_id_is_left_out(spark):
    q = entry.queries()
    t = table(spark, DATA, "tracks").dropDuplicates(["track_id"])
    assert q["merged_features"](spark, DATA).count() == t.where("has_audio").count()
    named = t.where("name IS NOT NULL AND artist IS NOT NULL AND trim(name) <> ''").select(F.concat_ws(" - ", "name", "artist").alias("mention")).distinct()
    assert named.join(q["track_resolve"](spark, DATA), "mention", "left_anti").where("mention RLIKE '^[A-Za-z ]+ - [A-Za-z ]+$'").count() == 0
    seeds = table(spark, DATA, "challenges").select(F.explode("seed_tracks").alias("track_id")).distinct()
    assert q["track_lookup"](spark, DATA).count() == t.join(seeds, "track_id", "left_semi").count()
