"""Command line: ``python -m tracklake VERB ...`` (or ``spark-submit``).

queries                      names of all registered queries
run NAME DATA OUT            runs a query over the tables in DATA and writes Parquet to OUT
explain NAME DATA            prints a query's physical plan
build DATA OUT               builds entries, tags, vocabulary and challenges into OUT
generate DATA TEXT           a playlist for a request in words
scan FOLDER OUT              nested JSON slices to tracks and entries
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tracklake import plans
from tracklake.operators import build as b
from tracklake.plans.generate import Catalog, generate
from tracklake.session import table
from tracklake.sources import playlists_json, store


def build(spark: SparkSession, data: str, out: str, holdout: int = 100) -> None:
    """Everything that evaluation reads is derived without the holdout playlists."""
    inter, playlists = b.interactions(table(spark, data, "entries")), table(spark, data, "playlists")
    held = b.holdout(inter, playlists, holdout)
    tokens = b.playlist_tokens(b.without(playlists, held))
    vocabulary = b.tag_vocabulary(tokens, 5)
    store.write(
        {"entries": b.without(inter, held), "vocabulary": vocabulary, "track_tags": b.track_tags(b.without(inter, held), tokens, vocabulary), "challenges": b.challenges(inter, held)},
        out,
        partition={"challenges": ["k"]},
    )
    store.write_meta(b.provenance(inter, b.once(table(spark, data, "tracks"), "track_id")), f"{out}/build_meta.json")


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("tracklake").getOrCreate()
    match args:
        case ["queries"]:
            print("\n".join(sorted(plans.queries())))
        case ["run", name, data, out]:
            plans.queries()[name](spark, data).write.mode("overwrite").parquet(out)
        case ["explain", name, data]:
            plans.queries()[name](spark, data).explain("formatted")
        case ["build", data, out]:
            build(spark, data, out)
        case ["generate", data, text]:
            generate(spark.createDataFrame([(1, text)], "query_id int, text string"), Catalog.load(spark, data)).orderBy("place").show(100, truncate=False)
        case ["scan", folder, out]:
            es = playlists_json.entries(playlists_json.read(spark, playlists_json.slice_paths(folder)))
            store.write({"tracks": playlists_json.catalog(es, 4), "entries": es}, out)
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
