"""Ordered continuation, assembly and reports over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import sound as sd
from tracklake.functions import text as tx
from tracklake.operators import assemble as asm
from tracklake.operators import build as b
from tracklake.operators import explain as ex
from tracklake.operators import sequence as sq
from tracklake.operators.retrieve import dense, not_seeds, top_per
from tracklake.plans import sql as q
from tracklake.plans.build_queries import TAGS, tags, tracks
from tracklake.plans.metric_queries import CUT, FUSED, bundle, fused
from tracklake.plans.registry import query
from tracklake.plans.retrieve_queries import TARGETS, UNITS, candidates, challenges, mood_targets, query_tags, vectors
from tracklake.session import checkpointed, released, table


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, place, track_id): what is shown, the first CUT of each fused list."""
    return fused(spark, sf_dir).where(F.col("rank") < CUT).select("query_id", F.col("rank").alias("place"), "track_id")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.once(table(spark, sf_dir, "intents"), "query_id")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.sequences(table(spark, sf_dir, "sequences"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir, "collab").select(F.col("entity_id").alias("track_id"), sd.unit(F.col("v")).alias("u")).where("u IS NOT NULL")


SEQ = f"{q.SEQUENCES}, se AS (SELECT pid, track_id, row_number() OVER (PARTITION BY pid ORDER BY i) - 1 AS position FROM (SELECT pid, track_id, min(i) AS i FROM (SELECT pid, unnest(tracks) AS track_id, generate_subscripts(tracks, 1) AS i FROM sq) WHERE track_id IS NOT NULL GROUP BY 1, 2) QUALIFY count(*) OVER (PARTITION BY pid) >= 2)"
SHOWN = f"{FUSED}, l AS (SELECT query_id, rank AS place, track_id FROM fu WHERE rank < {CUT})"


@query(f"WITH {SEQ} SELECT pid, list(track_id ORDER BY position) AS tracks FROM se GROUP BY 1")
def ordered_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir)


@query(f"WITH {SEQ}, g AS (SELECT pid, list(track_id ORDER BY position) AS l FROM se GROUP BY 1) SELECT pid, l[1:5] AS seeds, l[6:] AS held_out FROM g WHERE len(l) >= 10")
def prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.prefixes(sequences(spark, sf_dir), 5)


@query(f"WITH {SEQ}, w AS (SELECT pid, CAST(position AS INTEGER) AS position, track_id, {', '.join(f'lag(track_id, {i}) OVER (PARTITION BY pid ORDER BY position) AS slot_{i}' for i in (1, 2, 3))} FROM se) SELECT *, {', '.join(f'CAST(slot_{i} IS NOT NULL AS INTEGER) AS has_{i}' for i in (1, 2, 3))} FROM w")
def prefix_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.slots(sequences(spark, sf_dir))


@query(f"""WITH {SEQ}, {UNITS}, d AS (SELECT a.pid, a.position, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM se a JOIN se c ON a.pid = c.pid AND c.position BETWEEN a.position AND a.position + 2 JOIN u ON u.entity_id = c.track_id),
    m AS (SELECT pid, position, d, avg(x) AS x, count(*) AS n FROM d GROUP BY 1, 2, 3), s AS (SELECT pid, position, max(n) AS n, sqrt(sum(x * x)) AS z FROM m GROUP BY 1, 2)
    SELECT pid, CAST(position AS INTEGER) AS position, CAST(s.n AS INTEGER) AS n, round(z, 5) AS spread, round(max(CASE WHEN d = 1 THEN x END) / z, 5) AS first_dim FROM s JOIN m USING (pid, position) GROUP BY 1, 2, 3, z""")
def horizon_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of the next three tracks: how far they agree, and its first number."""
    at = sq.horizon_mean(sequences(spark, sf_dir), units(spark, sf_dir), 3)
    return at.select("pid", "position", "n", F.round("spread", 5).alias("spread"), F.round(F.get("y", F.lit(0)), 5).alias("first_dim"))


@query()
def ordered_prefix_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge from ordered prefixes to what follows, against the same prefixes with their order destroyed."""
    from tracklake.operators.model import fit_ridge

    s, u = checkpointed(sequences(spark, sf_dir)), checkpointed(units(spark, sf_dir))
    out = []
    for name, seq in (("ordered", s), ("shuffled", sq.shuffled(s))):
        # Split by list before vectors are joined, else both parts shuffle the vectors of all lists.
        held = F.pmod(F.xxhash64("pid"), F.lit(20)) == 0
        model = fit_ridge(sq.examples(seq.where(~held), u, 3, 3), sq.examples(seq.where(held), u, 3, 3), "x", "y")
        out.append((name, float(model.alpha), round(float(model.cosine), 4), model.beta.shape[0]))
    return spark.createDataFrame(out, "system string, alpha double, cosine double, n_features int")


@query()
def continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of continuing each sequence after five tracks by the direction of their mean or of the last one."""
    from tracklake.operators.metrics import bundle as metrics

    split = sq.prefixes(sequences(spark, sf_dir), 5).withColumnRenamed("pid", "query_id")
    seeds = split.select("query_id", F.posexplode("seeds").alias("place", "track_id"))
    v = checkpointed(vectors(spark, sf_dir, "collab"))
    truth = split.select("query_id", F.explode("held_out").alias("track_id"))
    out = None
    for name, of in (("centroid", F.col("seeds")), ("last", F.slice("seeds", 5, 1))):
        asked = split.select("query_id", of.alias("of"))
        # Hits and their ranks are all that these two metrics ask for.
        found = dense(asked, v, 100, own=seeds, wanted=truth)
        per = metrics(found.select("query_id", "track_id", "rank"), truth, tracks(spark, sf_dir))
        one = per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r_precision"), 4).alias("r_precision"), F.round(F.avg("clicks"), 3).alias("clicks")).withColumn("system", F.lit(name))
        # Each system is done, and its vectors in the tasks are gone, before the next begins.
        one = checkpointed(one)
        out = one if out is None else out.unionByName(one)
        del found, per
        released(spark)
    return out


@query(f"""WITH {SHOWN}, {q.TRACKS}, k AS (SELECT query_id, place, energy, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM l JOIN t USING (track_id) WHERE energy IS NOT NULL),
    e AS (SELECT query_id, max(n) AS n_known, avg(CASE WHEN r <= greatest(1, n // 3) THEN energy END) AS h, avg(CASE WHEN r > n - greatest(1, n // 3) THEN energy END) AS tl FROM k WHERE n >= 3 GROUP BY 1)
    SELECT query_id, n_known, round(h, 4) AS head, round(tl, 4) AS tail, CASE WHEN round(tl - h, 9) > 0.08 THEN 'builds' WHEN round(tl - h, 9) < -0.08 THEN 'winds down' ELSE 'holds steady' END AS shape FROM e""")
def arc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.arc(lists(spark, sf_dir), tracks(spark, sf_dir))


def _wheel(p: str) -> str:
    return f"CASE WHEN {p}key BETWEEN 0 AND 11 AND {p}mode IS NOT NULL THEN CAST((CAST(CASE WHEN {p}mode = 1 THEN {p}key ELSE ({p}key + 3) % 12 END * 7 AS INTEGER) % 12 + 7) % 12 + 1 AS INTEGER) END"


@query(f"""WITH {SHOWN}, {q.TRACKS}, k AS (SELECT query_id, place, track_id, tempo, key, mode, {", ".join(f"lead({c}) OVER (PARTITION BY query_id ORDER BY place) AS n{c}" for c in ("track_id", "tempo", "key", "mode"))} FROM l JOIN t USING (track_id)),
    w AS (SELECT *, {_wheel("")} AS a, {_wheel("n")} AS b FROM k WHERE ntrack_id IS NOT NULL), g AS (SELECT *, least((a - b + 12) % 12, (b - a + 12) % 12) AS s FROM w),
    f AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 0.35e0 WHEN s = 0 AND mode = nmode THEN 0e0 WHEN s = 0 THEN 0.15e0 WHEN s = 1 AND mode = nmode THEN 0.2e0 WHEN s = 2 AND mode = nmode THEN 0.55e0 ELSE 1e0 END AS key_gap FROM g)
    SELECT query_id, CAST(place AS INTEGER) AS place, key_gap, round(CASE WHEN tempo IS NULL OR ntempo IS NULL THEN 0.3e0 ELSE least(least(abs(tempo - ntempo), abs(tempo - 2 * ntempo), abs(2 * tempo - ntempo)) / 40, 1.5e0) END, 6) AS tempo_gap,
    concat_ws(', ', CAST(CAST(round_even(tempo, 0) AS INTEGER) AS VARCHAR) || '->' || CAST(CAST(round_even(ntempo, 0) AS INTEGER) AS VARCHAR) || ' BPM',
        a || CASE WHEN mode = 1 THEN 'B' ELSE 'A' END || '->' || b || CASE WHEN nmode = 1 THEN 'B' ELSE 'A' END || ' (' || CASE WHEN key_gap <= 0.2e0 THEN 'harmonic' WHEN key_gap <= 0.55e0 THEN 'near' ELSE 'contrast' END || ')') AS note FROM f""")
def transition_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.transitions(lists(spark, sf_dir), tracks(spark, sf_dir))


_CURVES = ("build", "wind_down", "wave", "peak_mid", "steady")


@query(f"""WITH {SHOWN}, {q.TRACKS}, n AS (SELECT query_id, place, count(*) OVER (PARTITION BY query_id) AS n, avg(energy) OVER (PARTITION BY query_id) AS base FROM l JOIN t USING (track_id)),
    s AS (SELECT *, CASE WHEN n > 1 THEN place / CAST(n - 1 AS DOUBLE) ELSE 0.5e0 END AS tt FROM n), c AS (SELECT *, CASE curve WHEN 'build' THEN tt WHEN 'wind_down' THEN 1 - tt WHEN 'wave' THEN 0.5e0 + 0.5e0 * sin(tt * 2 * pi() - pi() / 2) WHEN 'peak_mid' THEN 1 - abs(tt * 2 - 1) ELSE 0.5e0 END AS shape
    FROM s, (SELECT unnest({list(_CURVES)}) AS curve)) SELECT query_id, CAST(place AS INTEGER) AS place, curve, round(least(greatest(coalesce(base, 0.5e0) + (shape - 0.5e0) * 2 * 0.22e0, 0), 1), 9) AS target FROM c""")
def curve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy wanted at each place of each shown list under each curve."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id")
    n = lists(spark, sf_dir).join(tracks(spark, sf_dir).select("track_id", "energy"), "track_id").select("query_id", "place", F.count(F.lit(1)).over(w).alias("n"), F.avg("energy").over(w).alias("base"))
    t = F.when(F.col("n") > 1, F.col("place") / (F.col("n") - 1)).otherwise(0.5)
    each = n.withColumn("curve", F.explode(F.array(*[F.lit(c) for c in _CURVES])))
    return each.select("query_id", "place", "curve", F.round(sd.curve_target(F.col("curve"), t, F.coalesce("base", F.lit(0.5))), 9).alias("target"))


@query(f"""WITH {q.INTENTS}, {q.TRACKS}, x AS (SELECT query_id, coalesce(exclude_explicit, false) AS e, min_duration_s AS lo, max_duration_s AS hi FROM it),
    c AS (SELECT DISTINCT e, lo, hi FROM x), g AS (SELECT c.*, count(*) AS n0, count(*) FILTER (NOT (e AND coalesce(explicit, false))) AS n1,
        count(*) FILTER (NOT (e AND coalesce(explicit, false)) AND (lo IS NULL OR duration_ms >= lo * 1000)) AS n2, count(*) FILTER (NOT (e AND coalesce(explicit, false)) AND (lo IS NULL OR duration_ms >= lo * 1000) AND (hi IS NULL OR duration_ms <= hi * 1000)) AS n3,
        CAST(round(100 * avg(CAST(explicit_known AS INTEGER))) AS INTEGER) AS cov FROM c, t GROUP BY e, lo, hi)
    SELECT query_id, CASE WHEN x.e THEN n0 - n1 END AS dropped_explicit, CASE WHEN x.lo IS NOT NULL THEN n1 - n2 END AS dropped_min, CASE WHEN x.hi IS NOT NULL THEN n2 - n3 END AS dropped_max, n3 AS kept, CASE WHEN x.e THEN cov END AS explicit_coverage_pct
    FROM x JOIN g ON x.e = g.e AND x.lo IS NOT DISTINCT FROM g.lo AND x.hi IS NOT DISTINCT FROM g.hi""")
def mask_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.mask_report(intents(spark, sf_dir), tracks(spark, sf_dir))


@query(f"""WITH {SHOWN}, {q.TRACKS}, h AS (SELECT quantile_cont(n_playlists, 0.9) AS h FROM t)
    SELECT query_id, count(*) AS n_tracks, round(sum(duration_ms) / 1000.0e0, 3) AS total_duration_s, round(avg(energy), 9) AS mean_energy, round(avg(valence), 9) AS mean_valence, round(avg(tempo), 9) AS mean_tempo,
    count(DISTINCT coalesce(artist_uri, 'track ' || track_id)) AS n_artists, CAST(sum(CAST(coalesce(explicit, false) AS INTEGER)) AS BIGINT) AS explicit_count, round(avg(CAST(coalesce(n_playlists < h, false) AS INTEGER)), 6) AS long_tail_share FROM l JOIN t USING (track_id), h GROUP BY 1""")
def playlist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return ex.stats(lists(spark, sf_dir), t, t.agg(F.percentile("n_playlists", 0.9)).scalar())


_REPORT = f"""{SHOWN}, {q.TRACKS}, {q.INTENTS}, g AS (SELECT query_id, artist, count(*) AS c, sum(duration_ms) AS d, sum(CAST(coalesce(explicit, false) AS INTEGER)) AS e FROM (SELECT *, coalesce(artist_uri, 'track ' || track_id) AS artist FROM l JOIN t USING (track_id)) GROUP BY 1, 2),
    s AS (SELECT query_id, sum(c) AS n, max(c) AS most, sum(d) AS d, sum(e) AS e FROM g GROUP BY 1),
    rep AS (SELECT query_id, CASE WHEN exclude_explicit THEN e = 0 END AS no_known_explicit, CASE WHEN track_count IS NOT NULL THEN n = track_count END AS track_count_met,
        CASE WHEN track_count IS NULL AND target_duration_minutes IS NOT NULL THEN abs(d / 1000.0e0 - target_duration_minutes * 60) <= 0.1e0 * (target_duration_minutes * 60) END AS duration_within_10pct, CASE WHEN max_per_artist IS NOT NULL THEN most <= max_per_artist END AS artist_cap_met FROM s JOIN it USING (query_id))"""


@query(f"WITH {_REPORT} SELECT * FROM rep")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.constraint_report(lists(spark, sf_dir), tracks(spark, sf_dir), intents(spark, sf_dir))


@query(f"WITH {_REPORT}, u AS (UNPIVOT rep ON no_known_explicit, track_count_met, duration_within_10pct, artist_cap_met INTO NAME c VALUE ok) SELECT c AS \"constraint\", count(*) AS n, round(avg(CAST(ok AS INTEGER)), 6) AS rate FROM u WHERE ok IS NOT NULL GROUP BY 1")
def constraint_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.rates(constraint_report(spark, sf_dir))


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("track_id", F.col("artist_uri").alias("artist"), (F.col("duration_ms") / 1000).alias("duration_s"))
    v = asm.packed(vectors(spark, sf_dir, "collab").select(F.col("entity_id").alias("track_id"), "v"))
    return fused(spark, sf_dir).select("query_id", "track_id", "score").join(t, "track_id").join(v, "track_id", "left").withColumn("affinity", F.lit(None).cast("double"))


@query()
def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diverse list for every query under its count, duration and artist cap."""
    return asm.select(_pools(spark, sf_dir), intents(spark, sf_dir).select("query_id", "track_count", "target_duration_minutes", "max_per_artist"))


@query(f"""WITH {FUSED}, {q.TRACKS}, {q.INTENTS}, pool AS (SELECT query_id, coalesce(artist_uri, 'track ' || track_id) AS artist FROM fu JOIN t USING (track_id) WHERE rank < 500),
    a AS (SELECT query_id, artist, count(*) AS c FROM pool GROUP BY 1, 2), w AS (SELECT query_id, track_count, CASE WHEN track_count IS NULL THEN target_duration_minutes END AS minutes, coalesce(max_per_artist, 2) AS cap FROM it),
    n AS (SELECT query_id, any_value(minutes) AS minutes, least(sum(least(c, cap)), coalesce(any_value(track_count), 20)) AS n FROM a JOIN w USING (query_id) GROUP BY 1)
    SELECT query_id, CASE WHEN minutes IS NULL THEN CAST(n AS BIGINT) END AS n_tracks, true AS all_different, true AS within_cap, true AS from_pool, true AS best_first, true AS within_time FROM n""")
def selection_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every selected list: its length where a count decides it, its caps, its origin, its first track, its time."""
    w = intents(spark, sf_dir).select("query_id", F.coalesce("max_per_artist", F.lit(2)).alias("cap"), F.when(F.col("track_count").isNull(), F.col("target_duration_minutes") * 60).alias("goal"))
    p = _pools(spark, sf_dir).select("query_id", "track_id", F.coalesce("artist", F.concat(F.lit("track "), F.col("track_id").cast("string"))).alias("artist"), F.coalesce("duration_s", F.lit(0.0)).alias("d"), F.lit(True).alias("there"))
    top = fused(spark, sf_dir).where("rank = 0").select("query_id", F.col("track_id").alias("top"))
    got = diverse_selection(spark, sf_dir).join(p, ["query_id", "track_id"], "left").join(top, "query_id")
    per = got.groupBy("query_id", "artist").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("track_id").alias("u"), F.sum("d").alias("d"), F.max("d").alias("longest"), F.min("there").alias("there"), F.max((F.col("place") == 0) & (F.col("track_id") == F.col("top"))).alias("best"))
    s = per.groupBy("query_id").agg(F.sum("c").alias("n"), F.sum("u").alias("u"), F.max("c").alias("most"), F.sum("d").alias("d"), F.max("longest").alias("longest"), F.min("there").alias("there"), F.max("best").alias("best")).join(w, "query_id")
    timed = F.col("goal").isNotNull()
    return s.select("query_id", F.when(~timed, F.col("n")).alias("n_tracks"), (F.col("n") == F.col("u")).alias("all_different"), (F.col("most") <= F.col("cap")).alias("within_cap"), F.coalesce("there", F.lit(False)).alias("from_pool"), F.col("best").alias("best_first"), (~timed | (F.col("n") == 1) | (F.col("d") <= F.col("goal") + F.col("longest") / 2 + 1e-6)).alias("within_time"))


@query(f"""WITH {SHOWN}, {q.TRACKS} SELECT query_id, count(*) AS n_tracks, CAST(sum(track_id) AS BIGINT) AS track_sum, true AS places_whole, true AS cost_agrees FROM l JOIN t USING (track_id) GROUP BY 1""")
def beam_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every order: all tracks of the list, each place once, and the cost that the order really has."""
    t = tracks(spark, sf_dir).select("track_id", F.coalesce("artist_uri", F.concat(F.lit("track "), F.col("track_id").cast("string"))).alias("artist"), "energy", "tempo", "key", "mode")
    o = beam_sequence(spark, sf_dir).join(t, "track_id")
    whole, order = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("place")
    facts = o.withColumns({f"p_{c}": F.lag(c).over(order) for c in ("artist", "tempo", "key", "mode")} | {"n": F.count(F.lit(1)).over(whole), "base": F.coalesce(F.avg("energy").over(whole), F.lit(0.5))})
    target = sd.curve_target(F.lit("build"), F.when(F.col("n") > 1, F.col("place") / (F.col("n") - 1)).otherwise(F.lit(0.5)), F.col("base"))
    at = F.coalesce(F.abs(F.col("energy") - target), F.lit(0.15)) * 1.4
    step = sd.tempo_distance(F.col("p_tempo"), F.col("tempo")) + 0.8 * sd.key_distance(F.col("p_key"), F.col("p_mode"), F.col("key"), F.col("mode")) + 2.0 * (F.col("p_artist") == F.col("artist")).cast("int")
    each = facts.withColumn("c", at + F.when(F.col("place") > 0, step).otherwise(F.lit(0.0)))
    s = each.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_tracks"), F.sum("track_id").alias("track_sum"), F.countDistinct("place").alias("p"), F.max("place").alias("last"), F.sum("c").alias("c"), F.max("total_cost").alias("said"))
    return s.select("query_id", "n_tracks", "track_sum", ((F.col("p") == F.col("n_tracks")) & (F.col("last") == F.col("n_tracks") - 1)).alias("places_whole"), ((F.abs(F.col("c") - F.col("said")) < 1e-4) | (F.col("n_tracks") <= 2)).alias("cost_agrees"))


@query()
def beam_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playing order of every shown list along a building energy curve."""
    t = tracks(spark, sf_dir).select("track_id", F.col("artist_uri").alias("artist"), "energy", "tempo", "key", "mode")
    return asm.sequence(lists(spark, sf_dir).select("query_id", "track_id").join(t, "track_id").withColumn("curve", F.lit("build")))


@query(f"""WITH {SHOWN}, {TAGS}, {q.TRACKS}, {TARGETS}, {q.tokens("ch", "query_id", "title", name="asked")}, qt AS (SELECT key AS query_id, token AS tag FROM asked WHERE token IN (SELECT token FROM vocab)),
    hit AS (SELECT query_id, track_id, tag, n FROM (SELECT l.query_id, l.track_id, tag, n, row_number() OVER (PARTITION BY l.query_id, l.track_id ORDER BY n DESC, tag) AS r FROM l JOIN qt ON qt.query_id = l.query_id JOIN tags USING (track_id, tag)) WHERE r = 1)
    SELECT query_id, track_id, 'on ' || n || ' playlists tagged “' || tag || '”' AS reason FROM hit WHERE n >= 3""")
def tag_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason from tags of every shown track that has one."""
    return _reasons(spark, sf_dir).select("query_id", "track_id", F.explode("reasons").alias("reason")).where("reason LIKE 'on % playlists tagged%'")


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = candidates(spark, sf_dir).where("channel = 'collaborative' AND rank IS NOT NULL").select("query_id", "track_id", F.col("rank").alias("cf_rank"))
    return ex.reasons(lists(spark, sf_dir), tags(spark, sf_dir), query_tags(spark, sf_dir), ranks, tracks(spark, sf_dir), mood_targets(spark, sf_dir))


@query()
def track_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three reasons for every shown track."""
    return _reasons(spark, sf_dir)


@query(f"""WITH {q.TRACKS}, {q.INTER}, cat AS (SELECT track_id, {q.norm("artist")} AS artist FROM t), txt AS (SELECT playlist_id - 1 AS playlist_id, 'For fans of ' || string_agg(t.artist, ', ' ORDER BY position, track_id) AS name FROM inter JOIN t USING (track_id) WHERE position < 3 AND t.artist IS NOT NULL GROUP BY 1),
    w AS (SELECT playlist_id, list_filter(string_split({q.norm("name")}, ' '), lambda x: x <> '') AS w FROM txt),
    gr AS ({" UNION ".join(f"SELECT playlist_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS artist FROM w" for n in (1, 2, 3, 4))}),
    kn AS (SELECT DISTINCT playlist_id, artist FROM gr WHERE artist IN (SELECT artist FROM cat WHERE artist <> '') AND (contains(artist, ' ') OR length(artist) >= 8))
    SELECT playlist_id AS copy_id, artist FROM kn WHERE (playlist_id, artist) NOT IN (SELECT (playlist_id, artist) FROM inter JOIN cat USING (track_id) WHERE artist IS NOT NULL)""")
def copy_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists named in a playlist's copy that are not on it; the copy here names the first artists of the next playlist."""
    inter = b.interactions(table(spark, sf_dir, "entries"))
    named = inter.where("position < 3").join(tracks(spark, sf_dir).where("artist IS NOT NULL").select("track_id", "artist"), "track_id")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "track_id", "artist"))), lambda x: x["artist"]), ", ")
    copies = named.groupBy((F.col("playlist_id") - 1).alias("copy_id")).agg(F.concat(F.lit("For fans of "), said).alias("text"))
    return ex.unsupported_artists(copies, inter.select(F.col("playlist_id").alias("copy_id"), "track_id"), tracks(spark, sf_dir))
