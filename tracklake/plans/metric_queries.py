"""Ranking metrics and exposure audits over the candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.operators import audit as a
from tracklake.operators import metrics as m
from tracklake.operators.model import gate
from tracklake.operators.retrieve import top_per
from tracklake.plans import sql as q
from tracklake.plans.build_queries import tracks
from tracklake.plans.registry import query
from tracklake.plans.retrieve_queries import UNITS, candidates, challenges, vectors
from tracklake.session import table

CUT, DEPTH = 20, 100


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return challenges(spark, sf_dir).select("query_id", F.explode("held_out").alias("track_id"))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, track_id, rank, score) of the fused lists, whole, in order of score."""
    c = candidates(spark, sf_dir).where("channel = 'fused'").select("query_id", "track_id", "score")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("track_id")))
    return c.select("query_id", "track_id", "score", (r - 1).alias("rank"))


TRUTH = f"{q.CHALLENGES}, tr AS (SELECT DISTINCT query_id, unnest(held_out) AS track_id FROM ch), ntr AS (SELECT query_id, count(*) AS g FROM tr GROUP BY 1)"
FUSED = f"{q.CANDIDATES}, fu AS (SELECT query_id, track_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id) - 1 AS rank FROM cand WHERE channel = 'fused')"
_DCG = "list_sum(list_transform(range(1, least(g, n_pred, {k}) + 1), lambda i: 1 / log2(i + 1)))"
BUNDLE = f"""{TRUTH}, {FUSED}, {q.TRACKS}, nm AS (SELECT track_id, coalesce(artist_uri, 'track ' || track_id) AS artist FROM t),
    p AS (SELECT fu.*, g, tr.track_id IS NOT NULL AS hit FROM fu JOIN ntr USING (query_id) LEFT JOIN tr ON tr.query_id = fu.query_id AND tr.track_id = fu.track_id),
    base AS (SELECT query_id, count(*) AS n_pred, sum(CASE WHEN rank < g AND hit THEN 1 ELSE 0 END) AS hr, {", ".join(f"sum(CASE WHEN rank < {k} AND hit THEN 1 / log2(rank + 2) ELSE 0 END) AS d{k}, sum(CASE WHEN rank < {k} AND hit THEN 1 ELSE 0 END) AS h{k}" for k in (100, 500))},
        min(CASE WHEN hit AND rank < 500 THEN rank END) AS first FROM p GROUP BY 1),
    ms AS (SELECT query_id, artist, count(*) AS c FROM p JOIN nm USING (track_id) WHERE rank < g AND NOT hit GROUP BY 1, 2), hl AS (SELECT query_id, artist, count(*) AS c FROM tr JOIN nm USING (track_id) GROUP BY 1, 2),
    cr AS (SELECT query_id, sum(least(ms.c, hl.c)) AS credit FROM ms JOIN hl USING (query_id, artist) GROUP BY 1),
    per AS (SELECT query_id, coalesce(hr, 0) / g AS r_precision, (coalesce(hr, 0) + 0.25e0 * coalesce(credit, 0)) / g AS r_precision_artist,
        {", ".join(f"coalesce(CASE WHEN d{k} > 0 THEN d{k} / {_DCG.format(k=k)} ELSE 0 END, 0) AS ndcg_{k}" for k in (100, 500))},
        CAST(coalesce(first // 10, 51) AS DOUBLE) AS clicks, coalesce(h100, 0) / g AS recall_100, coalesce(h500, 0) / g AS recall_500 FROM ntr LEFT JOIN base USING (query_id) LEFT JOIN cr USING (query_id))"""
METRICS = ["r_precision", "r_precision_artist", "ndcg_100", "ndcg_500", "clicks", "recall_100", "recall_500"]


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.bundle(fused(spark, sf_dir), truth(spark, sf_dir), tracks(spark, sf_dir))


@query(f"WITH {BUNDLE} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in METRICS)} FROM per")
def metrics_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in METRICS])


@query(f"""WITH {BUNDLE} SELECT k, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}, round(coalesce(stddev_samp({c}) / sqrt(count({c})), 0), 6) AS {c}_se" for c in METRICS)} FROM per JOIN ch USING (query_id) GROUP BY k""")
def mean_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and standard error of each metric by number of seeds."""
    per = bundle(spark, sf_dir).join(challenges(spark, sf_dir).select("query_id", "k"), "query_id")
    return m.mean_se(per, METRICS, ["k"])


@query(f"""WITH {BUNDLE} SELECT k, n_seeds_known, count(*) AS n, round(avg(r_precision), 6) AS r_precision FROM (SELECT per.*, ch.k, len(seed_tracks) > 0 AS n_seeds_known FROM per JOIN ch USING (query_id)) GROUP BY CUBE (k, n_seeds_known)""")
def metric_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all combinations of its dimensions."""
    per = bundle(spark, sf_dir).join(challenges(spark, sf_dir).select("query_id", "k", (F.size("seed_tracks") > 0).alias("n_seeds_known")), "query_id")
    return per.cube("k", "n_seeds_known").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r_precision"), 6).alias("r_precision"))


@query(f"""WITH {TRUTH}, {FUSED} SELECT query_id, round(sum(CASE WHEN tr.track_id IS NOT NULL THEN 1 ELSE 0 END) / max(g), 6) AS r_precision_at_cut FROM fu JOIN ntr USING (query_id) LEFT JOIN tr USING (query_id, track_id) WHERE rank < least({CUT}, g) GROUP BY 1""")
def r_precision_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.r_precision_at_cut(fused(spark, sf_dir), truth(spark, sf_dir), CUT).select("query_id", F.round("r_precision_at_cut", 6).alias("r_precision_at_cut"))


FACTS = f"""{q.TRACKS}, cuts AS (SELECT quantile_cont(n_playlists, 0.5) AS lo, quantile_cont(n_playlists, 0.9) AS hi, max(ln(1 + n_playlists)) AS top, min(ln(1 + n_playlists)) AS bottom FROM t),
    facts AS (SELECT track_id, coalesce(artist_uri, 'track ' || track_id) AS artist, n_playlists AS n, n_playlists <= lo AS is_tail, n_playlists >= hi AS is_head, (ln(1 + n_playlists) - bottom) / (top - bottom) AS pop FROM t, cuts WHERE n_playlists IS NOT NULL)"""


def exposure_sql(shown: str, by: str) -> str:
    """SQL of the exposure report of a CTE (by, track_id)."""
    return f"""ec AS (SELECT s.{by}, f.* FROM {shown} s JOIN facts f USING (track_id)), lab AS (SELECT DISTINCT {by} FROM ec),
    tc AS (SELECT lab.{by}, f.track_id, coalesce(c, 0) AS c FROM lab CROSS JOIN facts f LEFT JOIN (SELECT {by}, track_id, count(*) AS c FROM ec GROUP BY 1, 2) x ON x.{by} = lab.{by} AND x.track_id = f.track_id),
    ac AS (SELECT lab.{by}, a.artist, coalesce(c, 0) AS c FROM lab CROSS JOIN (SELECT DISTINCT artist FROM facts) a LEFT JOIN (SELECT {by}, artist, count(*) AS c FROM ec GROUP BY 1, 2) x ON x.{by} = lab.{by} AND x.artist = a.artist),
    tg AS (SELECT {by}, sum(CAST(c > 0 AS INTEGER)) / count(*) AS cov, 2 * sum(c * i) / (count(*) * sum(c)) - (count(*) + 1) / count(*) AS g FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY c) AS i FROM tc) GROUP BY 1),
    ag AS (SELECT {by}, sum(CAST(c > 0 AS INTEGER)) / count(*) AS cov, 2 * sum(c * i) / (count(*) * sum(c)) - (count(*) + 1) / count(*) AS g,
        sum(CASE WHEN n - i < greatest(1, round_even(n * 0.01e0, 0)) THEN c ELSE 0 END) / sum(c) AS top1 FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY c) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM ac) GROUP BY 1),
    su AS (SELECT {by}, count(*) AS n_recommendations, avg(CAST(is_tail AS INTEGER)) AS tail_share, avg(CAST(is_head AS INTEGER)) AS head_share, avg(ln(1 + n)) AS mean_log_popularity FROM ec GROUP BY 1)
    SELECT {by}, n_recommendations, round(tg.cov, 6) AS track_coverage, round(ag.cov, 6) AS artist_coverage, round(tg.g, 6) AS track_gini, round(ag.g, 6) AS artist_gini, round(tail_share, 6) AS tail_share, round(head_share, 6) AS head_share,
    round(tail_share / (SELECT avg(CAST(is_tail AS INTEGER)) FROM facts), 6) AS tail_lift, round(mean_log_popularity, 6) AS mean_log_popularity, round(top1, 6) AS top1pct_artist_share FROM su JOIN tg USING ({by}) JOIN ag USING ({by})"""


@query(f"WITH {FUSED}, {FACTS}, sh AS (SELECT c.cut, track_id FROM fu JOIN (VALUES ({CUT}), ({DEPTH})) c(cut) ON rank < c.cut), {exposure_sql('sh', 'cut')}")
def exposure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is heard: at the cut that is shown and in the whole pool."""
    f = fused(spark, sf_dir).withColumn("cut", F.explode(F.array(F.lit(CUT), F.lit(DEPTH)))).where("rank < cut")
    return a.exposure(f, a.facts(tracks(spark, sf_dir)), ["cut"])


_BY_CHANNEL = f"{q.CANDIDATES}, bc AS (SELECT channel, query_id, track_id, row_number() OVER (PARTITION BY channel, query_id ORDER BY rank, track_id) - 1 AS r FROM cand WHERE rank IS NOT NULL)"


@query(f"WITH {_BY_CHANNEL}, {FACTS}, sh AS (SELECT channel, track_id FROM bc WHERE r < {CUT}), {exposure_sql('sh', 'channel')}")
def channel_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure by each channel's own finds only: a track without a rank in a channel is not its find."""
    c = candidates(spark, sf_dir).where("rank IS NOT NULL").drop("score").withColumnRenamed("rank", "given")
    f = top_per(c, ["channel", "query_id"], [F.col("given"), F.col("track_id")], CUT)
    return a.exposure(f, a.facts(tracks(spark, sf_dir)), ["channel"])


PENALTIES = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 2.0)
_PENALIZED = f"""pn AS (SELECT penalty, query_id, track_id, row_number() OVER (PARTITION BY penalty, query_id ORDER BY round(CASE WHEN nn > 1 THEN 1 - rank / CAST(nn - 1 AS DOUBLE) ELSE 1 END - penalty * coalesce(pop, 0), 9) DESC, rank) - 1 AS r
    FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS nn FROM fu WHERE rank < {DEPTH}) LEFT JOIN facts USING (track_id), (SELECT unnest([{", ".join(f"{p}e0" for p in PENALTIES)}]) AS penalty))"""


@query(f"WITH {FUSED}, {FACTS}, {_PENALIZED}, sh AS (SELECT penalty, track_id FROM pn WHERE r < {CUT}), {exposure_sql('sh', 'penalty')}")
def popularity_penalty_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure under nine strengths of a popularity penalty, in one pass."""
    facts = a.facts(tracks(spark, sf_dir))
    f = a.penalized(fused(spark, sf_dir).where(F.col("rank") < DEPTH), facts, PENALTIES).where(F.col("rank") < CUT)
    return a.exposure(f, facts, ["penalty"])


_CAPPED = f"cp AS (SELECT cap, query_id, track_id, row_number() OVER (PARTITION BY cap, query_id ORDER BY rank) - 1 AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, artist ORDER BY rank) AS nth FROM fu JOIN facts USING (track_id) WHERE rank < {DEPTH}) JOIN (VALUES (1), (2), (3), (5)) c(cap) ON nth <= cap)"


@query(f"WITH {FUSED}, {FACTS}, {_CAPPED}, sh AS (SELECT cap, track_id FROM cp WHERE r < {CUT}), {exposure_sql('sh', 'cap')}")
def artist_cap_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure when each artist may hold 1, 2, 3 or 5 places of a list."""
    facts = a.facts(tracks(spark, sf_dir))
    f = a.capped(fused(spark, sf_dir).where(F.col("rank") < DEPTH), facts, (1, 2, 3, 5)).where(F.col("rank") < CUT)
    return a.exposure(f, facts, ["cap"])


@query(f"WITH {FUSED}, {FACTS}, d AS (SELECT query_id, count(DISTINCT artist) AS n_artists FROM fu JOIN facts USING (track_id) WHERE rank < {CUT} GROUP BY 1) SELECT n_artists, count(*) AS n_queries FROM d GROUP BY 1")
def query_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries show how many different artists."""
    f = fused(spark, sf_dir).where(F.col("rank") < CUT).join(a.facts(tracks(spark, sf_dir)), "track_id")
    return f.groupBy("query_id").agg(F.countDistinct("artist").alias("n_artists")).groupBy("n_artists").agg(F.count(F.lit(1)).alias("n_queries"))


@query(f"""WITH {FUSED}, {UNITS}, l AS (SELECT query_id, entity_id, u FROM fu JOIN u ON entity_id = track_id WHERE rank < {CUT})
    SELECT a.query_id, (SELECT count(*) FROM l c WHERE c.query_id = a.query_id) AS n, round(1 - avg(list_dot_product(a.u, b.u)), 6) AS distance FROM l a JOIN l b ON a.query_id = b.query_id AND a.entity_id < b.entity_id GROUP BY a.query_id""")
def intra_list_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, "collab").withColumnRenamed("entity_id", "track_id")
    d = m.intra_list_distance(fused(spark, sf_dir).where(F.col("rank") < CUT).select("query_id", "track_id"), v)
    return d.select("query_id", "n", F.round("distance", 6).alias("distance"))


_RECALL = f"""rc AS (SELECT channel, avg(r) AS recall FROM (SELECT channel, query_id, sum(CASE WHEN tr.track_id IS NOT NULL THEN 1 ELSE 0 END) / max(g) AS r FROM bc JOIN ntr USING (query_id) LEFT JOIN tr USING (query_id, track_id) WHERE bc.r < 100 GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {TRUTH}, {_BY_CHANNEL}, {_RECALL}, v AS (SELECT max(CASE WHEN channel IN ('cooccurrence', 'collaborative') THEN recall END) AS c, max(CASE WHEN channel = 'popularity' THEN recall END) AS f, max(CASE WHEN channel = 'fused' THEN recall END) AS o FROM rc)
    SELECT round(c, 6) AS content, round(f, 6) AS floor, round(o, 6) AS oracle, round(CASE WHEN f > 0 THEN c / f END, 6) AS floor_multiple, f <= 0 AS floor_vacuous, round(CASE WHEN o > 0 THEN c / o ELSE 0 END, 6) AS oracle_ratio,
    CASE WHEN f > 0 THEN c / f >= 2 ELSE c > 0 END AS beats_floor, CASE WHEN f > 0 THEN c / f >= 2 ELSE c > 0 END AND CASE WHEN o > 0 THEN c / o ELSE 0 END >= 0.25 AS passed FROM v""")
def gate_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over recall@100 of the channels: the better of two against a floor and a ceiling."""
    c = candidates(spark, sf_dir).where("rank IS NOT NULL").drop("score").withColumnRenamed("rank", "given")
    top = top_per(c, ["channel", "query_id"], [F.col("given"), F.col("track_id")], 100)
    hits = m.scored(top, truth(spark, sf_dir)).groupBy("channel", "query_id").agg((F.sum("hit") / F.max("n_truth")).alias("r"))
    recall = hits.groupBy("channel").agg(F.avg("r").alias("recall"))
    one = recall.agg(
        F.max(F.when(F.col("channel").isin("cooccurrence", "collaborative"), F.col("recall"))).alias("content"),
        F.max(F.when(F.col("channel") == "popularity", F.col("recall"))).alias("floor"),
        F.max(F.when(F.col("channel") == "fused", F.col("recall"))).alias("oracle"),
    )
    decided = one.select("*", *gate(F.col("content"), F.col("floor"), F.col("oracle")))
    return decided.select(*[F.round(c, 6).alias(c) if c in ("content", "floor", "oracle", "floor_multiple", "oracle_ratio") else F.col(c) for c in decided.columns])
