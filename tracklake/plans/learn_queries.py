"""Association weights, factors, reranking, planning, cold start and the feedback loop over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators import build as b
from tracklake.operators import loop as lp
from tracklake.operators import model as md
from tracklake.operators.retrieve import cooccurrence, exact_tags, fuse, tag_space
from tracklake.plans import sql as q
from tracklake.plans.build_queries import TAGS, inter, tags, tracks
from tracklake.plans.metric_queries import FUSED, TRUTH, fused, truth
from tracklake.plans.registry import query
from tracklake.plans.retrieve_queries import candidates, challenges, query_tags, seeds, titled
from tracklake.session import checkpointed, table


def _sppmi(cells: str, row: str, col: str, value: str, shift: float, damp: str) -> str:
    damped = f"pow(CAST(c AS DOUBLE), {damp})"
    return f"""rs AS (SELECT {row}, sum({value}) AS r FROM {cells} GROUP BY 1), cs AS (SELECT {col}, sum({value}) AS c FROM {cells} GROUP BY 1), tt AS (SELECT CAST(sum({value}) AS DOUBLE) AS total FROM {cells}),
    dc AS (SELECT {col}, {damped} * total / (SELECT sum({damped}) FROM cs) AS c FROM cs, tt), w AS (SELECT {row}, {col}, ln({value} * total / (r * dc.c)) - ln({shift}) AS v FROM {cells} JOIN rs USING ({row}) JOIN dc USING ({col}), tt)"""


@query(f"WITH {q.INTER}, ones AS (SELECT playlist_id, track_id, 1e0 AS w FROM inter), {_sppmi('ones', 'track_id', 'playlist_id', 'w', 5.0, '0.75e0')} SELECT track_id, playlist_id, round(v, 4) AS v FROM w WHERE v > 0")
def sppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track-playlist association, damped on the playlist side."""
    cells = inter(spark, sf_dir).select("track_id", "playlist_id", F.lit(1.0).alias("w"))
    return md.sppmi(cells, "track_id", "playlist_id", "w", 5.0, 0.75).select("track_id", "playlist_id", F.round("v", 4).alias("v"))


@query(f"WITH {TAGS}, {_sppmi('tags', 'track_id', 'tag', 'n', 2.0, '1e0')} SELECT track_id, tag, round(v, 4) AS v FROM w WHERE v > 0")
def tag_sppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.sppmi(tags(spark, sf_dir), "track_id", "tag", "n", 2.0).select("track_id", "tag", F.round("v", 4).alias("v"))


@query()
def tag_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track vectors of the tag space."""
    f = md.factorize(md.sppmi(tags(spark, sf_dir), "track_id", "tag", "n", 2.0), "track_id", "tag", 16)
    return f.rows.select("track_id", F.transform("f", lambda x: F.round(x, 6)).alias("v"))


@query()
def tag_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title phrases to tag vectors to tracks."""
    f = md.factorize(md.sppmi(tags(spark, sf_dir), "track_id", "tag", "n", 2.0), "track_id", "tag", 16)
    got = tag_space(query_tags(spark, sf_dir), f.cols.withColumnRenamed("f", "v"), f.rows.select(F.col("track_id").alias("entity_id"), F.col("f").alias("v")), 50)
    return got.select("query_id", "track_id", "rank", F.round("score", 5).alias("score"))


_CH = ("collaborative", "cooccurrence", "popularity")


def features(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """One row per fused candidate: its channel evidence, catalog facts, tag hits and query facts, and whether it was held out.

    ``base`` is (query_id, track_id, score) where only some of the candidates are asked about.
    """
    c = candidates(spark, sf_dir)
    per = c.where("channel <> 'fused' AND rank IS NOT NULL").groupBy("query_id", "track_id").agg(*[F.max(F.when(F.col("channel") == ch, F.col(x))).alias(f"{ch}_{x}") for ch in _CH for x in ("rank", "score")])
    played = inter(spark, sf_dir)
    if base is None:
        base = fused(spark, sf_dir).select("query_id", "track_id", "score")
    else:
        played = played.join(base.select("track_id").distinct(), "track_id", "left_semi")
    t = tracks(spark, sf_dir).select("track_id", F.log1p(F.coalesce("n_playlists", F.lit(0))).alias("log_popularity"), F.col("has_audio").cast("int").alias("has_audio"), F.col("tempo").isNotNull().cast("int").alias("tempo_known"), (F.col("duration_ms") / 1000).alias("duration_s"))
    # Titles are cut into tokens once, for the vocabulary, the queries and the tracks.
    tokens = checkpointed(b.playlist_tokens(table(spark, sf_dir, "playlists")))
    vocabulary = checkpointed(b.tag_vocabulary(tokens, 5))
    qt = checkpointed(query_tags(spark, sf_dir, vocabulary))
    # Tags are looked up for the candidates only: all tracks of all asked tags would be far more rows.
    told = base.select("query_id", "track_id").join(qt, "query_id")
    hits = told.join(b.track_tags(played, tokens, vocabulary), ["track_id", "tag"]).groupBy("query_id", "track_id").agg(F.count(F.lit(1)).alias("tag_hits"), F.log1p(F.sum("n")).alias("log_tag_mass"))
    facts = challenges(spark, sf_dir).select("query_id", F.size("seed_tracks").alias("n_seeds")).join(qt.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_tag_cols")), "query_id", "left")
    label = truth(spark, sf_dir).distinct().withColumn("label", F.lit(1))
    j = base.join(per, ["query_id", "track_id"], "left").join(t, "track_id", "left").join(hits, ["query_id", "track_id"], "left").join(facts, "query_id", "left").join(label, ["query_id", "track_id"], "left")
    each = []
    for ch in _CH:
        r = F.col(f"{ch}_rank")
        # A rank is null exactly when the channel did not find the track; ``present`` says so.
        each += [F.log1p(r).alias(f"{ch}_rank"), F.coalesce(f"{ch}_score", F.lit(0.0)).alias(f"{ch}_score"), r.isNotNull().cast("int").alias(f"{ch}_present")]
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("tag_hits", "n_seeds", "n_tag_cols", "label")]
    return j.select("query_id", "track_id", "score", *each, F.coalesce("log_popularity", F.lit(0.0)).alias("log_popularity"), "has_audio", F.coalesce("tempo_known", F.lit(0)).alias("tempo_known"), "duration_s", F.coalesce("log_tag_mass", F.lit(0.0)).alias("log_tag_mass"), *zero)


@query(f"""WITH {TAGS}, {TRUTH}, {FUSED}, {q.TRACKS}, {q.tokens("ch", "query_id", "title", name="asked")}, qt AS (SELECT key AS query_id, token AS tag FROM asked WHERE token IN (SELECT token FROM vocab)),
    per AS (SELECT query_id, track_id, {", ".join(f"max(CASE WHEN channel = '{c}' THEN {x} END) AS {c}_{x}" for c in _CH for x in ("rank", "score"))} FROM cand WHERE channel <> 'fused' AND rank IS NOT NULL GROUP BY 1, 2),
    hits AS (SELECT query_id, track_id, count(*) AS tag_hits, ln(1 + sum(n)) AS log_tag_mass FROM qt JOIN tags USING (tag) GROUP BY 1, 2), nt AS (SELECT query_id, count(*) AS n_tag_cols FROM qt GROUP BY 1)
    SELECT query_id, track_id, round(fu.score, 6) AS score, {", ".join(f"round(ln(1 + {c}_rank), 6) AS {c}_rank, round(coalesce({c}_score, 0), 6) AS {c}_score, CAST({c}_rank IS NOT NULL AS INTEGER) AS {c}_present" for c in _CH)},
    round(ln(1 + coalesce(n_playlists, 0)), 6) AS log_popularity, CAST(has_audio AS INTEGER) AS has_audio, CAST(tempo IS NOT NULL AS INTEGER) AS tempo_known, round(duration_ms / 1000.0e0, 6) AS duration_s, round(coalesce(log_tag_mass, 0), 6) AS log_tag_mass,
    coalesce(tag_hits, 0) AS tag_hits, CAST(len(seed_tracks) AS INTEGER) AS n_seeds, coalesce(n_tag_cols, 0) AS n_tag_cols, CAST(tr.track_id IS NOT NULL AS INTEGER) AS label
    FROM fu LEFT JOIN per USING (query_id, track_id) LEFT JOIN t USING (track_id) LEFT JOIN hits USING (query_id, track_id) LEFT JOIN nt USING (query_id) LEFT JOIN ch USING (query_id) LEFT JOIN tr USING (query_id, track_id)""")
def rerank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return f.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


@query()
def reranker_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees over the features, held against ranking by the fused score."""
    # What is learnt from is chosen by labels alone, so features are worked out for the chosen candidates only.
    label = truth(spark, sf_dir).distinct().withColumn("label", F.lit(1))
    labelled = fused(spark, sf_dir).select("query_id", "track_id", "score").join(label, ["query_id", "track_id"], "left").fillna(0, ["label"])
    f = features(spark, sf_dir, checkpointed(md.sampled(labelled).select("query_id", "track_id", "score")))
    columns = [c for c in f.columns if c not in ("query_id", "track_id", "label")]
    _, got, uplift = md.train_reranker(f.fillna(0.0), columns)
    return spark.createDataFrame([(None if got is None else round(float(got), 4), None if uplift is None else round(float(uplift), 4), len(columns))], "auc_valid double, auc_uplift double, n_features int")


@query(f"""WITH {TRUTH}, {FUSED}, y AS (SELECT score, CAST(tr.track_id IS NOT NULL AS INTEGER) AS l FROM fu LEFT JOIN tr USING (query_id, track_id)), r AS (SELECT l, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0e0) AS r FROM y)
    SELECT round((sum(r) FILTER (l = 1) - count(*) FILTER (l = 1) * (count(*) FILTER (l = 1) + 1) / 2.0e0) / (count(*) FILTER (l = 1) * count(*) FILTER (l = 0)), 6) AS auc FROM r""")
def ranking_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the fused score alone tells held-out tracks apart."""
    y = fused(spark, sf_dir).join(truth(spark, sf_dir).distinct().withColumn("label", F.lit(1)), ["query_id", "track_id"], "left").select("score", F.coalesce("label", F.lit(0)).alias("label"))
    return spark.createDataFrame([(round(float(md.auc(y, "score", "label")), 6),)], "auc double")


_COLD = "cold AS (SELECT track_id FROM t WHERE n_playlists <= 5)"


@query(f"WITH {q.INTER}, {q.TRACKS}, {_COLD} SELECT playlist_id, count(*) AS n_tracks, CAST(sum(track_id) AS BIGINT) AS track_sum FROM inter WHERE track_id NOT IN (SELECT track_id FROM cold) GROUP BY 1")
def cold_freeze_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each playlist without its rarest tracks."""
    cold = tracks(spark, sf_dir).where("n_playlists <= 5")
    return lp.frozen(inter(spark, sf_dir), cold).groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n_tracks"), F.sum("track_id").alias("track_sum"))


@query(f"WITH {q.VECTORS}, {q.TRACKS}, {_COLD}, a AS (SELECT entity_id, v FROM vec WHERE space = 'collab' AND v IS NOT NULL), n AS (SELECT entity_id, v FROM vec WHERE space = 'tag_tracks' AND v IS NOT NULL AND entity_id IN (SELECT track_id FROM cold)) SELECT entity_id, len(coalesce(n.v, a.v)) AS dim, round(list_sum(coalesce(n.v, a.v)), 6) AS total FROM a FULL JOIN n USING (entity_id)")
def cold_graft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one space, those of every cold track replaced from another."""
    from tracklake.plans.retrieve_queries import vectors

    cold = tracks(spark, sf_dir).where("n_playlists <= 5").select(F.col("track_id").alias("entity_id"))
    g = lp.grafted(vectors(spark, sf_dir, "collab"), vectors(spark, sf_dir, "tag_tracks").join(cold, "entity_id", "left_semi"))
    return g.select("entity_id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {FUSED}, {q.TRACKS}, {q.CHALLENGES}, {_COLD}, h AS (SELECT query_id, count(*) AS n, min(rank + 1) AS best FROM fu WHERE track_id IN (SELECT track_id FROM cold) GROUP BY 1) SELECT query_id, coalesce(n, 0) AS n_recovered, coalesce(best, 0) AS best_rank FROM ch LEFT JOIN h USING (query_id)")
def cold_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.cold_ranks(fused(spark, sf_dir), tracks(spark, sf_dir).where("n_playlists <= 5"), challenges(spark, sf_dir))


@query(f"WITH {FUSED} SELECT query_id, track_id, CAST(rank AS INTEGER) AS rank FROM fu WHERE rank < 20 AND (CAST(CAST('0x' || md5(query_id || ':' || track_id || ':loop')[1:12] AS BIGINT) AS DOUBLE) + 0.5e0) / 281474976710656e0 < 0.55e0 * exp(-0.12e0 * rank)")
def loop_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listeners keep of the shown lists."""
    return lp.accepted(fused(spark, sf_dir).where("rank < 20").select("query_id", "track_id", "rank"))


@query(f"""WITH {FUSED}, {q.INTER}, kept AS (SELECT query_id, track_id FROM fu WHERE rank < 20 AND (CAST(CAST('0x' || md5(query_id || ':' || track_id || ':loop')[1:12] AS BIGINT) AS DOUBLE) + 0.5e0) / 281474976710656e0 < 0.55e0 * exp(-0.12e0 * rank)),
    al AS (SELECT playlist_id, track_id, 1e0 AS w FROM inter UNION ALL SELECT CAST(query_id + 10000000 AS INTEGER), track_id, 25e0 FROM kept) SELECT track_id, round(sum(w), 6) AS weight FROM al GROUP BY 1""")
def loop_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track weights after one round is folded back in."""
    start = inter(spark, sf_dir).select("playlist_id", "track_id", F.lit(1.0).alias("weight"))
    grown = lp.appended(start, loop_acceptance(spark, sf_dir), 25.0)
    return grown.groupBy("track_id").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query()
def loop_organic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty tracks a query drawn in proportion to popularity."""
    return lp.organic(tracks(spark, sf_dir), challenges(spark, sf_dir), 20)


@query()
def loop_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure over the rounds of each arm, refitted on the grown corpus after every round.

    Every title asks in every round; each is ranked by its tags, exactly and in the refitted tag space, and by the
    neighbourhood of its seeds in the grown interactions.
    """
    asked = checkpointed(titled(spark, sf_dir).select("query_id"))
    qt = checkpointed(query_tags(spark, sf_dir).join(asked, "query_id", "left_semi"))
    sd = checkpointed(seeds(spark, sf_dir).join(asked, "query_id", "left_semi"))

    def refit(state: lp.State) -> lp.Ranker:
        space = md.factorize(md.sppmi(state.tags, "track_id", "tag", "n", 2.0), "track_id", "tag", 64)
        cols = checkpointed(space.cols.withColumnRenamed("f", "v"))
        rows = checkpointed(space.rows.select(F.col("track_id").alias("entity_id"), F.col("f").alias("v")))

        def rank(state: lp.State, queries: DataFrame, k: int) -> DataFrame:
            support = state.inter.groupBy("track_id").agg(F.sum("weight").alias("support"))
            found = tag_space(qt, cols, rows, k).unionByName(exact_tags(qt, state.tags, k)).unionByName(cooccurrence(sd, state.inter, support, k))
            return fuse(checkpointed(found), k)

        return rank

    start = lp.State(inter(spark, sf_dir).select("playlist_id", "track_id", F.lit(1.0).alias("weight")), tags(spark, sf_dir))
    return lp.run(start, tracks(spark, sf_dir), asked, qt, refit)
