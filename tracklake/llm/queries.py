"""Queries and checking SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm import capping, knn, lookalike, mixing, pairs, splitting, terms, tokens
from tracklake.operators.skew import salted_join
from tracklake.session import checkpointed, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = knn.build_index(table(spark, sf_dir, "vectors"), leaf_rows=2000)
    pairs = knn.similar_pairs(index, min_cosine=0.9, visits=16)
    return pairs.select("space", F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every entity whose id is divisible by 50, against all entities."""
    index = knn.build_index(table(spark, sf_dir, "vectors"), trees=8)
    return knn.nearest(index, k=10, visits=64, queries=F.col("id") % 50 == 0)


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact ten nearest that the forest found, by space."""
    index = knn.build_index(table(spark, sf_dir, "vectors"), trees=8)
    chosen = F.col("id") % 50 == 0
    exact = knn.nearest_exact(index, 10, chosen)
    found = knn.nearest(index, k=10, visits=64, queries=chosen).select("space", "entity_id", "neighbour_id", F.lit(1).alias("hit"))
    return exact.join(found, ["space", "entity_id", "neighbour_id"], "left").groupBy("space").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "challenges").select("query_id", F.lower("title").alias("title"))
    title = terms.frequencies(titles, "query_id", "title", separator=" ")
    count = terms.frequencies(table(spark, sf_dir, "tracks"), "track_id", "n_playlists")
    return title.withColumn("field", F.lit("title")).unionByName(count.withColumn("field", F.lit("n_playlists")))


def p3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).select("field", "value", "n_occurrences", "n_records", "is_rare", "is_common")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marks(_frequencies(spark, sf_dir), "field")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, artist_uri, track_id, score, max_per_artist) of the fused candidates of queries with a cap."""
    caps = table(spark, sf_dir, "intents").where("max_per_artist IS NOT NULL").groupBy("query_id").agg(F.min("max_per_artist").alias("max_per_artist"))
    artists = table(spark, sf_dir, "tracks").where("artist_uri IS NOT NULL").groupBy("track_id").agg(F.min("artist_uri").alias("artist_uri"))
    fused = table(spark, sf_dir, "candidates").where("channel = 'fused'").groupBy("query_id", "track_id").agg(F.max("score").alias("score"))
    capped = checkpointed(salted_join(checkpointed(fused), caps, ["query_id"], [F.col("track_id")]))
    return salted_join(capped, artists, ["track_id"], [F.col("query_id")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = capping.over_cap(_fused(spark, sf_dir), ["query_id", "artist_uri"], "max_per_artist", "track_id", "score")
    return gone.select("query_id", F.col("track_id").cast("int").alias("track_id"))


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused list of every query after its cap."""
    fused = table(spark, sf_dir, "candidates").where("channel = 'fused'").groupBy("query_id", "track_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    return fused.join(p4_found(spark, sf_dir), ["query_id", "track_id"], "left_anti")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = lookalike.records(table(spark, sf_dir, "challenges"), "title", "query_id", "title")
    return title.unionByName(lookalike.records(table(spark, sf_dir, "tracks"), "name", "track_id", "name"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.same_look_pairs(_named(spark, sf_dir))
    return pairs.select("field", F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical(_named(spark, sf_dir))


def p5_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens and texts each step settles."""
    return lookalike.steps(_named(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_ids(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.baskets(table(spark, sf_dir, "sequences"), "pid", "tracks")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of five pids or more and an NPMI of 0.75 or more; both limits are known to the operator before it enumerates pairs."""
    together = pairs.surprise(_bags(spark, sf_dir), min_count=5, min_npmi=0.75)
    return together.where("npmi >= 0.75").select(F.col("item_a").alias("track_a"), F.col("item_b").alias("track_b"))


def p6_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with their counts, surprise under the null model, and track_uri."""
    together = pairs.surprise(_bags(spark, sf_dir), min_count=1)
    uris = table(spark, sf_dir, "tracks").groupBy("track_id").agg(F.min("track_uri").alias("uri"))
    a = uris.select(F.col("track_id").alias("item_a"), F.col("uri").alias("track_uri_a"))
    b = uris.select(F.col("track_id").alias("item_b"), F.col("uri").alias("track_uri_b"))
    named = together.join(a, "item_a", "left").join(b, "item_b", "left")
    return named.select(
        F.col("item_a").alias("track_a"), F.col("item_b").alias("track_b"), "track_uri_a", "track_uri_b", "n_ab", "n_a", "n_b", F.round("npmi", 6).alias("npmi"), "expected", F.round(-F.log10(F.greatest("p_value", F.lit(1e-300))), 4).alias("surprise"), "significant"
    )


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of all pairs, with how much more often than by chance they are."""
    all_ = pairs.associations(_bags(spark, sf_dir))
    return all_.select(F.col("item_a").alias("track_a"), F.col("item_b").alias("track_b"), "n_ab", "n_a", "n_b", F.round("npmi", 6).alias("npmi"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = tokens.with_token_count(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.mix(docs, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, mixed = _mixed(spark, sf_dir)
    return mixing.shares(planned, mixed).where("is_short").select("source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf_dir))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", limit=512, overlap=64)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be cut: those with a second piece."""
    return p9_pieces(spark, sf_dir).where("piece = 1").select("doc_id")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of every document: they cover it, keep to the limit and share 64 tokens at most."""
    p = p9_pieces(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("piece")
    p = p.withColumn("before", F.lag("end").over(w))
    shared = F.when(F.col("piece") > 0, F.expr("substring(text, 1, before - start)")).otherwise(F.lit(""))
    sized = tokens.with_token_count(p.withColumn("shared", shared), "shared", "n_shared")
    each = sized.select("doc_id", "piece", "start", "end", "n_tokens", "n_shared", (F.col("start") <= F.coalesce("before", F.lit(0))).alias("joined"))
    return each.groupBy("doc_id").agg(
        (F.max("end") - F.min("start")).cast("long").alias("n_chars"), (F.min("joined") & (F.min("start") == 0)).alias("covered"), (F.max("n_tokens") <= 512).alias("within_limit"), (F.max("n_shared") <= 64).alias("within_overlap")
    )


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_nearest, p2_recall, p3_found, p3_frequencies, p4_found, p4_kept, p5_found, p5_canonical, p5_steps, p6_found, p6_surprise, p6_counts, p7_ids, p8_found, p8_mixture, p8_shares, p9_found, p9_pieces, p9_checks)}


FREQUENCIES = """
        WITH titles AS (SELECT query_id, min(title) AS title FROM challenges WHERE title IS NOT NULL GROUP BY query_id),
        words AS (SELECT query_id AS k, unnest(string_split(lower(title), ' ')) AS value FROM titles),
        counted AS (SELECT track_id AS k, CAST(min(n_playlists) AS VARCHAR) AS value FROM tracks WHERE n_playlists IS NOT NULL GROUP BY track_id),
        freq AS (
            SELECT 'title' AS field, value, count(*) AS n_occurrences, count(DISTINCT k) AS n_records, (SELECT count(*) FROM titles) AS n FROM words WHERE value <> '' GROUP BY value
            UNION ALL
            SELECT 'n_playlists', value, count(*), count(DISTINCT k), (SELECT count(*) FROM counted) FROM counted GROUP BY value
        )"""

HELD = """
        WITH baskets AS (SELECT pid, list_distinct(flatten(list(tracks))) AS items FROM sequences WHERE pid IS NOT NULL AND len(tracks) > 0 GROUP BY pid),
        held AS (SELECT pid, unnest(items) AS item FROM baskets),
        counts AS (SELECT a.item AS track_a, b.item AS track_b, count(*) AS n_ab FROM held a JOIN held b ON a.pid = b.pid AND a.item < b.item GROUP BY 1, 2)"""

SQL = {
    "p9_checks": "SELECT doc_id, length(text) AS n_chars, true AS covered, true AS within_limit, true AS within_overlap FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text <> ''",
    "p6_counts": HELD
    + """, support AS (SELECT item, count(*) AS n FROM held GROUP BY item), total AS (SELECT count(*) AS n FROM baskets)
        SELECT track_a, track_b, n_ab, a.n AS n_a, b.n AS n_b, round(CASE WHEN n_ab = total.n THEN 1e0 ELSE ln(n_ab * CAST(total.n AS DOUBLE) / (a.n * b.n)) / -ln(n_ab / CAST(total.n AS DOUBLE)) END, 6) AS npmi
        FROM counts JOIN support a ON a.item = track_a JOIN support b ON b.item = track_b, total""",
    "p6_found": HELD
    + """, support AS (SELECT item, count(*) AS n FROM held GROUP BY item), total AS (SELECT count(*) AS n FROM baskets)
        SELECT track_a, track_b FROM counts JOIN support a ON a.item = track_a JOIN support b ON b.item = track_b, total
        WHERE n_ab >= 5 AND (n_ab = total.n OR ln(n_ab * CAST(total.n AS DOUBLE) / (a.n * b.n)) / -ln(n_ab / CAST(total.n AS DOUBLE)) >= 0.75)""",
    "p3_found": FREQUENCIES
    + " SELECT field, value, 'rare' AS mark FROM freq WHERE n_records < 3 UNION ALL SELECT field, value, 'common' FROM freq WHERE n_records * 100 > 7 * n",
    "p3_frequencies": FREQUENCIES + " SELECT field, value, n_occurrences, n_records, n_records < 3 AS is_rare, n_records * 100 > 7 * n AS is_common FROM freq",
    "p4_found": """
        WITH fused AS (SELECT query_id, track_id, max(score) AS score FROM candidates WHERE channel = 'fused' GROUP BY query_id, track_id),
        caps AS (SELECT query_id, min(max_per_artist) AS m FROM intents WHERE max_per_artist IS NOT NULL GROUP BY query_id),
        artists AS (SELECT track_id, min(artist_uri) AS artist_uri FROM tracks WHERE artist_uri IS NOT NULL GROUP BY track_id),
        ranked AS (
            SELECT query_id, track_id, m, row_number() OVER (PARTITION BY query_id, artist_uri ORDER BY score DESC NULLS LAST, track_id) AS r
            FROM fused JOIN caps USING (query_id) JOIN artists USING (track_id)
        )
        SELECT query_id, track_id FROM ranked WHERE r > m""",
    "p4_kept": """
        WITH fused AS (SELECT query_id, track_id, max(score) AS score, min(rank) AS rank FROM candidates WHERE channel = 'fused' GROUP BY query_id, track_id),
        caps AS (SELECT query_id, min(max_per_artist) AS m FROM intents WHERE max_per_artist IS NOT NULL GROUP BY query_id),
        artists AS (SELECT track_id, min(artist_uri) AS artist_uri FROM tracks WHERE artist_uri IS NOT NULL GROUP BY track_id),
        ranked AS (
            SELECT query_id, track_id, score, rank, m, artist_uri, row_number() OVER (PARTITION BY query_id, artist_uri ORDER BY score DESC NULLS LAST, track_id) AS r
            FROM fused LEFT JOIN caps USING (query_id) LEFT JOIN artists USING (track_id)
        )
        SELECT query_id, track_id, score, rank FROM ranked WHERE m IS NULL OR artist_uri IS NULL OR r <= m""",
    "p2_found": """
        WITH live AS (
            SELECT space, entity_id, min(v) AS v FROM vectors WHERE v IS NOT NULL AND list_sum(list_transform(v, lambda x: x * x)) > 0 GROUP BY space, entity_id
        )
        SELECT a.space, a.entity_id AS id_a, b.entity_id AS id_b FROM live a JOIN live b
        ON a.space = b.space AND a.entity_id < b.entity_id AND list_cosine_similarity(a.v, b.v) >= 0.9""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
