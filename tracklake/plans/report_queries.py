"""Reports that put several operators side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import sound as sd
from tracklake.operators import audit as a
from tracklake.operators import coldstart as cs
from tracklake.operators import metrics as m
from tracklake.operators import retrieve as r
from tracklake.operators.loop import uniform
from tracklake.plans import sql as q
from tracklake.plans.build_queries import tracks
from tracklake.plans.metric_queries import CUT, DEPTH, FACTS, FUSED, TRUTH, fused, truth
from tracklake.plans.registry import query
from tracklake.plans.retrieve_queries import TARGETS, candidates, challenges, mood_targets, seeds, vectors
from tracklake.plans.sequence_queries import SHOWN, lists
from tracklake.session import checkpointed, released


@query(f"""WITH {TRUTH}, {q.CANDIDATES}, o AS (SELECT channel, query_id, track_id, row_number() OVER (PARTITION BY channel, query_id ORDER BY rank, track_id) - 1 AS r FROM cand WHERE rank IS NOT NULL),
    h AS (SELECT channel, query_id, sum(CASE WHEN o.r < g AND tr.track_id IS NOT NULL THEN 1 ELSE 0 END) / max(g) AS rp, sum(CASE WHEN o.r < 100 AND tr.track_id IS NOT NULL THEN 1 ELSE 0 END) / max(g) AS rc, coalesce(min(CASE WHEN tr.track_id IS NOT NULL AND o.r < 500 THEN o.r END) // 10, 51) AS cl
    FROM o JOIN ntr USING (query_id) LEFT JOIN tr USING (query_id, track_id) GROUP BY 1, 2)
    SELECT channel, k, count(*) AS n, round(avg(rp), 6) AS r_precision, round(coalesce(stddev_samp(rp) / sqrt(count(*)), 0), 6) AS r_precision_se, round(avg(rc), 6) AS recall_100, round(avg(cl), 6) AS clicks FROM h JOIN ch USING (query_id) GROUP BY 1, 2""")
def system_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel as a system of its own, by number of seeds: the baselines beside the fusion."""
    c = candidates(spark, sf_dir).where("rank IS NOT NULL").drop("score").withColumnRenamed("rank", "given")
    o = r.top_per(c, ["channel", "query_id"], [F.col("given"), F.col("track_id")], 1500)
    s = m.scored(o, truth(spark, sf_dir))
    inside = F.when((F.col("rank") < F.col("n_truth")), F.col("hit")).otherwise(0)
    per = s.groupBy("channel", "query_id").agg(
        (F.sum(inside) / F.max("n_truth")).alias("rp"),
        (F.sum(F.when(F.col("rank") < 100, F.col("hit")).otherwise(0)) / F.max("n_truth")).alias("rc"),
        F.coalesce(F.floor(F.min(F.when((F.col("hit") == 1) & (F.col("rank") < 500), F.col("rank"))) / 10), F.lit(51)).alias("cl"),
    )
    j = per.join(challenges(spark, sf_dir).select("query_id", "k"), "query_id")
    return j.groupBy("channel", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rp"), 6).alias("r_precision"), F.round(F.coalesce(F.stddev_samp("rp") / F.sqrt(F.count(F.lit(1))), F.lit(0.0)), 6).alias("r_precision_se"), F.round(F.avg("rc"), 6).alias("recall_100"), F.round(F.avg("cl"), 6).alias("clicks"))


@query(f"""WITH {SHOWN}, {TARGETS.replace(q.CHALLENGES + ",", q.CHALLENGES + ",")}, {q.TRACKS} SELECT d.dim, count(*) AS n, round(avg(abs(d.v - d.g)), 6) AS mean_error FROM (
    {" UNION ALL ".join(f"SELECT '{c}' AS dim, t.{c} AS v, g.{c} AS g FROM l JOIN targets g USING (query_id) JOIN t USING (track_id)" for c in sd.AUDIO)}) d WHERE v IS NOT NULL AND g IS NOT NULL GROUP BY 1""")
def mood_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of the shown tracks from what their titles ask for, by dimension."""
    t = tracks(spark, sf_dir).select("track_id", *[F.col(c).alias(f"t_{c}") for c in sd.AUDIO])
    j = lists(spark, sf_dir).join(mood_targets(spark, sf_dir), "query_id").join(t, "track_id")
    long = j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.abs(F.col(f"t_{c}") - F.col(c)).alias("e")) for c in sd.AUDIO])).alias("x")).select("x.*").where("e IS NOT NULL")
    return long.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean_error"))


_AFF = " + ".join(f"coalesce(pow((coalesce(t.{c}, m_{c}) - g.{c}) / CASE WHEN s_{c} < 1e-6 THEN 1 ELSE s_{c} END, 2), 0)" for c in sd.AUDIO)
_NA = " + ".join(f"CAST(g.{c} IS NOT NULL AS INTEGER)" for c in sd.AUDIO)


@query(f"""WITH {SHOWN}, {TARGETS}, {q.TRACKS}, mm AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in sd.AUDIO)} FROM t WHERE has_audio),
    x AS (SELECT query_id, track_id, CASE WHEN has_audio THEN exp(-sqrt({_AFF}) / sqrt({_NA})) END AS a FROM l JOIN targets g USING (query_id) JOIN t USING (track_id), mm WHERE ({_NA}) > 0)
    SELECT query_id, track_id, round(coalesce(a, quantile_cont(a, 0.5) OVER (PARTITION BY query_id), 0.5e0), 6) AS affinity FROM x""")
def audio_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness of each shown track to the stated targets; an unmeasured track takes its list's median."""
    return r.affinity(lists(spark, sf_dir).select("query_id", "track_id"), mood_targets(spark, sf_dir), tracks(spark, sf_dir))


@query(f"""WITH {FUSED}, {FACTS}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS nn FROM fu WHERE rank < {DEPTH}), p AS (SELECT query_id, track_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN nn > 1 THEN 1 - rank / CAST(nn - 1 AS DOUBLE) ELSE 1 END - 0.3e0 * coalesce(pop, 0), 9) DESC, rank) - 1 AS r FROM n LEFT JOIN facts USING (track_id))
    SELECT query_id, track_id, CASE WHEN rank < {CUT} THEN 'left' ELSE 'entered' END AS change, CAST(rank AS INTEGER) AS before, CAST(r AS INTEGER) AS after FROM p WHERE (rank < {CUT}) <> (r < {CUT})""")
def rerank_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that a popularity penalty takes out of, or brings into, what is shown."""
    pool = fused(spark, sf_dir).where(F.col("rank") < DEPTH)
    new = a.penalized(pool, a.facts(tracks(spark, sf_dir)), (0.3,)).select("query_id", "track_id", F.col("rank").alias("after"))
    j = pool.select("query_id", "track_id", F.col("rank").alias("before")).join(new, ["query_id", "track_id"])
    changed = (F.col("before") < CUT) != (F.col("after") < CUT)
    return j.where(changed).select("query_id", "track_id", F.when(F.col("before") < CUT, "left").otherwise("entered").alias("change"), "before", "after")


_DESC = " AND ".join(f"t.{c} IS NOT NULL" for c in sd.DESCRIPTORS)


@query(f"""WITH {q.TRACKS}, {q.VECTORS}, lv AS (SELECT entity_id FROM vec WHERE space = 'collab' AND v IS NOT NULL AND list_sum(list_transform(v, lambda x: x * x)) > 0)
    SELECT {_DESC} AS has_descriptors, lv.entity_id IS NOT NULL AS has_vector, count(*) AS n FROM t LEFT JOIN lv ON entity_id = track_id GROUP BY 1, 2""")
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tracks could take part in a content fit, and why the others cannot."""
    v = vectors(spark, sf_dir, "collab").withColumnRenamed("entity_id", "track_id")
    return cs.usable(tracks(spark, sf_dir), v).groupBy("has_descriptors", "has_vector").agg(F.count(F.lit(1)).alias("n"))


@query()
def cold_start_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of cold tracks by their true vectors, by vectors predicted from sound, and by chance."""
    t = tracks(spark, sf_dir)
    v = vectors(spark, sf_dir, "collab")
    is_cold = lambda x: F.pmod(F.xxhash64(x), F.lit(5)) == 0
    cold = t.where(is_cold(F.col("track_id"))).select("track_id")
    _, content = cs.fit(t, v.withColumnRenamed("entity_id", "track_id"), cold)
    # The rule of cold tracks is put to the vectors, too, so that only theirs are joined.
    oracle = v.where(is_cold(F.col("entity_id").cast(t.schema["track_id"].dataType))).join(cold.withColumnRenamed("track_id", "entity_id"), "entity_id", "left_semi")
    dim = v.select(F.size("v")).first()[0]
    chance = cold.select(F.col("track_id").alias("entity_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: uniform(F.col("track_id"), i, seed="chance") - 0.5).alias("v"))
    # Recall counts the queries that withhold a cold track, so only their seeds are summed.
    wanted = checkpointed(truth(spark, sf_dir).distinct().join(cold, "track_id", "left_semi").select("query_id", "track_id"))
    released(spark)
    own = seeds(spark, sf_dir).join(cold, "track_id", "left_anti").join(wanted.select("query_id").distinct(), "query_id", "left_semi")
    asked = r.seed_centroids(own, v)
    return cs.recall(asked, wanted, {"oracle": oracle, "content_ridge": content, "random": chance})


@query(f"WITH {FUSED}, {q.TRACKS}, cold AS (SELECT track_id FROM t WHERE n_playlists <= 5), h AS (SELECT query_id, min(rank + 1) AS best FROM fu WHERE track_id IN (SELECT track_id FROM cold) GROUP BY 1) SELECT count(*) AS n_queries, quantile_cont(best, 0.5) AS median_best_rank FROM h")
def cold_median_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median place of the first rare track, over the lists that have one."""
    from tracklake.operators.loop import cold_ranks

    got = cold_ranks(fused(spark, sf_dir), tracks(spark, sf_dir).where("n_playlists <= 5"), challenges(spark, sf_dir)).where("best_rank > 0")
    return got.agg(F.count(F.lit(1)).alias("n_queries"), F.percentile("best_rank", 0.5).alias("median_best_rank"))
