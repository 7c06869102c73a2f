"""Retrieval channels, fusion and name resolution over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import moods
from tracklake.functions import sound as sd
from tracklake.functions import text as tx
from tracklake.operators import build as b
from tracklake.operators import retrieve as r
from tracklake.plans import sql as q
from tracklake.plans.build_queries import TAGS, inter, tags, tracks
from tracklake.plans.registry import query
from tracklake.session import table

K = 50


def challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.once(table(spark, sf_dir, "challenges"), "query_id")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, place, track_id) of the seeds of every challenge."""
    return challenges(spark, sf_dir).select("query_id", F.posexplode("seed_tracks").alias("place", "track_id")).where("track_id IS NOT NULL")


def vectors(spark: SparkSession, sf_dir: str, space: str) -> DataFrame:
    return b.once(table(spark, sf_dir, "vectors").where((F.col("space") == space) & F.col("v").isNotNull()).select("entity_id", "v"), "entity_id")


def query_tags(spark: SparkSession, sf_dir: str, vocabulary: DataFrame | None = None) -> DataFrame:
    tokens = challenges(spark, sf_dir).select("query_id", F.explode(tx.title_tokens(F.col("title"))).alias("token"))
    vocabulary = b.tag_vocabulary(b.playlist_tokens(table(spark, sf_dir, "playlists")), 5) if vocabulary is None else vocabulary
    return tokens.join(vocabulary, "token", "left_semi").select("query_id", F.col("token").alias("tag"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return challenges(spark, sf_dir).where("trim(title) <> ''").select("query_id", F.col("title").alias("text"))


SEEDS = f"{q.CHALLENGES}, sd AS (SELECT query_id, unnest(seed_tracks) AS track_id, generate_subscripts(seed_tracks, 1) - 1 AS place FROM ch)"


def top(scores: str, k: int = K, positive: bool = True) -> str:
    """SQL: the best k scores of each query of a CTE (query_id, track_id, score)."""
    return (
        f"SELECT query_id, track_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT query_id, track_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id) - 1 AS r"
        f" FROM (SELECT query_id, track_id, round(score, 9) AS score FROM {scores}) {'WHERE score > 0' if positive else ''}) WHERE r < {k}"
    )


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("query_id", "track_id", "rank", F.round("score", digits).alias("score"))


COOC = f"""{SEEDS}, {q.INTER}, {q.SUPPORT},
    near AS (SELECT DISTINCT query_id, playlist_id FROM sd JOIN inter USING (track_id)),
    votes AS (SELECT query_id, track_id, count(*) AS n FROM near JOIN inter USING (playlist_id) GROUP BY 1, 2),
    sc AS (SELECT query_id, track_id, n / pow(CAST(support AS DOUBLE), 0.5) AS score FROM votes JOIN sup USING (track_id) WHERE (query_id, track_id) NOT IN (SELECT (query_id, track_id) FROM sd))"""


@query(f"WITH {COOC} {top('sc')}")
def cooccurrence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inter(spark, sf_dir)
    return shown(r.cooccurrence(seeds(spark, sf_dir), i, b.support(i), K))


@query(f"""WITH {TAGS}, {q.CHALLENGES}, {q.tokens("ch", "query_id", "title", name="asked")}, qt AS (SELECT key AS query_id, token FROM asked WHERE token IN (SELECT token FROM vocab)),
    sc AS (SELECT query_id, track_id, sum(ln(1 + n)) AS score FROM qt JOIN tags ON tag = token GROUP BY 1, 2) {top('sc')}""")
def exact_tag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(r.exact_tags(query_tags(spark, sf_dir), tags(spark, sf_dir), K))


def _words(source: str, key: str, x: str) -> str:
    """SQL of term counts (key, term, tf) of a normalised text."""
    w = f"list_filter(string_split({q.norm(x)}, ' '), lambda v: length(v) >= 2)"
    return f"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT {key}, {w} AS w FROM {source})) GROUP BY 1, 2"


TFIDF = f"""{q.TRACKS}, tf AS ({_words("t", "track_id", "translate(concat_ws(' ', name, artist, album, genre), '|', ' ')")}),
    n AS (SELECT count(*) AS n FROM t), idf AS (SELECT term, ln((1 + any_value(n.n)) / (1 + CAST(count(*) AS DOUBLE))) + 1 AS idf FROM tf, n GROUP BY term HAVING count(*) >= 2),
    raw AS (SELECT track_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
    weights AS (SELECT track_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY track_id)) AS w FROM raw)"""


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    counts = r.terms(t, "track_id", tx.lexical_text(F.col("name"), F.col("artist"), F.col("album"), F.col("genre")))
    return r.tf_idf(counts, "track_id", t.agg(F.count(F.lit(1))).scalar())


@query(f"WITH {TFIDF} SELECT track_id, term, round(w, 6) AS w FROM weights")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf(spark, sf_dir).select("track_id", "term", F.round("w", 6).alias("w"))


@query(f"""WITH {TFIDF}, {q.CHALLENGES}, qs AS (SELECT query_id, title FROM ch WHERE trim(title) <> ''), qtf AS ({_words("qs", "query_id", "title")}),
    qraw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (term)), qw AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS q FROM qraw),
    sc AS (SELECT query_id, track_id, round(sum(w * q), 9) AS score FROM weights JOIN qw USING (term) GROUP BY 1, 2) {top('sc')}""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(r.lexical(titled(spark, sf_dir), tfidf(spark, sf_dir), K))


@query(f"""WITH {SEEDS}, {q.TRACKS}, sc AS (SELECT query_id, t.track_id, CAST(n_playlists AS DOUBLE) AS score FROM ch, t WHERE n_playlists IS NOT NULL AND NOT list_contains(coalesce(seed_tracks, []), t.track_id)) {top('sc')}""")
def popularity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(r.popularity(tracks(spark, sf_dir), challenges(spark, sf_dir), seeds(spark, sf_dir), K))


_MOODS = "moods(phrase, " + ", ".join(sd.AUDIO) + ") AS (VALUES " + ", ".join("('" + p + "', " + ", ".join(f"CAST({v.get(c, 'NULL')} AS DOUBLE)" for c in sd.AUDIO) + ")" for p, v in moods.MOODS.items()) + ")"
TARGETS = f"""{q.CHALLENGES}, {_MOODS}, said AS (SELECT query_id, {q.norm("title")} AS title FROM ch WHERE title IS NOT NULL),
    targets AS (SELECT query_id, {", ".join(f"avg({c}) AS {c}" for c in sd.AUDIO)} FROM said JOIN moods ON regexp_matches(title, '\\b' || phrase || '\\b') GROUP BY 1)"""


def mood_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, audio targets): the mean of what the mood phrases of each title ask for."""
    said = challenges(spark, sf_dir).where("title IS NOT NULL").select("query_id", tx.normalize(F.col("title")).alias("title"))
    # The lexicon is a constant list: each phrase is looked for in the title, then its targets are joined.
    found = F.array_compact(F.array(*[F.when(F.col("title").rlike(rf"\b{p}\b"), F.lit(p)) for p in moods.MOODS]))
    lexicon = spark.createDataFrame([(p, *[v.get(c) for c in sd.AUDIO]) for p, v in moods.MOODS.items()], "phrase string, " + ", ".join(f"{c} double" for c in sd.AUDIO))
    return said.select("query_id", F.explode(found).alias("phrase")).join(F.broadcast(lexicon), "phrase").groupBy("query_id").agg(*[F.avg(c).alias(c) for c in sd.AUDIO])


@query(f"WITH {TARGETS} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in sd.AUDIO)} FROM targets")
def mood_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mood_targets(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in sd.AUDIO])


_D2 = " + ".join(f"coalesce(pow(coalesce((t.{c} - m_{c}) / CASE WHEN s_{c} < 1e-6 THEN 1 ELSE s_{c} END, 0) - (g.{c} - m_{c}) / CASE WHEN s_{c} < 1e-6 THEN 1 ELSE s_{c} END, 2), 0)" for c in sd.AUDIO)
_ND = " + ".join(f"CAST(g.{c} IS NOT NULL AS INTEGER)" for c in sd.AUDIO)


@query(f"""WITH {TARGETS}, {q.TRACKS}, m AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in sd.AUDIO)} FROM t WHERE has_audio),
    sc AS (SELECT query_id, track_id, exp(-sqrt({_D2}) / sqrt({_ND})) AS score FROM targets g, t, m WHERE has_audio AND ({_ND}) > 0) {top('sc')}""")
def audio_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(r.audio(mood_targets(spark, sf_dir), tracks(spark, sf_dir), K))


UNITS = f"{q.VECTORS}, u AS (SELECT entity_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM vec WHERE space = 'collab' AND v IS NOT NULL AND list_sum(list_transform(v, lambda x: x * x)) > 0)"
CENTROIDS = f"""{SEEDS}, {UNITS}, parts AS (SELECT query_id, unnest(u) AS x, generate_subscripts(u, 1) AS d FROM sd JOIN u ON entity_id = track_id),
    dims AS (SELECT query_id, d, sum(x) AS x FROM parts GROUP BY 1, 2), cen AS (SELECT query_id, list(x ORDER BY d) AS c FROM dims GROUP BY 1)"""


@query(f"WITH {CENTROIDS} SELECT query_id, list_transform(c, lambda x: round(x, 5)) AS v FROM cen")
def seed_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = r.seed_centroids(seeds(spark, sf_dir), vectors(spark, sf_dir, "collab"))
    return c.select("query_id", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@query(f"""WITH {CENTROIDS}, sc AS (SELECT query_id, entity_id AS track_id, list_dot_product(c, u) / sqrt(list_dot_product(c, c)) AS score FROM cen, u
    WHERE (query_id, entity_id) NOT IN (SELECT (query_id, track_id) FROM sd)) {top('sc', K, False)}""")
def collaborative_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(r.collaborative(seeds(spark, sf_dir), vectors(spark, sf_dir, "collab"), K))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.once(table(spark, sf_dir, "candidates"), "query_id", "channel", "track_id")


_TRUST = "CASE channel " + " ".join(f"WHEN '{c}' THEN {w}e0" for c, w in r.CHANNEL_WEIGHTS.items()) + " ELSE 1e0 END"


@query(f"""WITH {q.CANDIDATES}, f AS (SELECT query_id, track_id, sum({_TRUST} / (60e0 + rank + 1)) AS score, max(CASE WHEN channel = 'cooccurrence' THEN rank END) AS cooccurrence_rank,
        max(CASE WHEN channel = 'collaborative' THEN rank END) AS collaborative_rank, max(CASE WHEN channel = 'popularity' THEN rank END) AS popularity_rank
        FROM cand WHERE channel <> 'fused' AND rank IS NOT NULL GROUP BY 1, 2)
    SELECT query_id, track_id, CAST(r AS INTEGER) AS rank, round(score, 9) AS score, cooccurrence_rank, collaborative_rank, popularity_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, track_id) - 1 AS r FROM f) WHERE r < 1500""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the channel lists; the rank of a channel that did not find a track is null."""
    live = candidates(spark, sf_dir).where("channel <> 'fused'").select("query_id", "channel", "track_id", "rank", "score")
    fused = r.fuse(live, 1500)
    each = [F.col("ranks")[c].alias(f"{c}_rank") for c in ("cooccurrence", "collaborative", "popularity")]
    return fused.select("query_id", "track_id", "rank", F.round("score", 9).alias("score"), *each)


@query(f"""WITH {q.CANDIDATES}, n AS (SELECT query_id, count(*) AS n FROM cand WHERE channel IN ('cooccurrence', 'collaborative') AND rank IS NOT NULL GROUP BY 1)
    SELECT query_id, channel, count(*) AS n FROM cand WHERE rank IS NOT NULL AND channel <> 'fused' AND (channel <> 'popularity' OR query_id NOT IN (SELECT query_id FROM n WHERE n >= 30)) AND channel IN ('cooccurrence', 'popularity') GROUP BY 1, 2""")
def popularity_backstop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backstop is decided on all channels (here below 30 finds), then the channels are restricted."""
    live = candidates(spark, sf_dir).where("rank IS NOT NULL AND channel <> 'fused'")
    out = r.with_backstop(live.where("channel <> 'popularity'"), live.where("channel = 'popularity'"), 30, ["cooccurrence", "popularity"])
    return out.groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("n"))


_CAT = f"{q.TRACKS}, cat AS (SELECT track_id, {q.norm('name')} AS title, {q.norm('artist')} AS artist, coalesce(n_playlists, 0) AS n FROM t)"


@query(f"""WITH {_CAT}, names AS (SELECT DISTINCT string_split(artist, ' ')[1] AS name FROM t WHERE artist IS NOT NULL), asked AS (SELECT name, {q.norm("name")} AS q FROM names),
    arts AS (SELECT DISTINCT artist FROM cat WHERE artist <> ''), ex AS (SELECT name, artist FROM asked JOIN arts ON q = artist WHERE q <> ''),
    w AS (SELECT name, unnest(list_distinct(string_split(q, ' '))) AS w, len(list_distinct(string_split(q, ' '))) AS need FROM asked WHERE q <> '' AND name NOT IN (SELECT name FROM ex)),
    h AS (SELECT artist, unnest(list_distinct(string_split(artist, ' '))) AS w FROM arts),
    whole AS (SELECT name, artist FROM w JOIN h USING (w) GROUP BY name, artist HAVING count(*) = max(need)),
    best AS (SELECT name, artist FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY len(string_split(artist, ' ')), length(artist), artist) AS r FROM whole) WHERE r = 1),
    hits AS (SELECT * FROM ex UNION ALL SELECT * FROM best)
    SELECT name, track_id, CAST(r AS INTEGER) AS rank FROM (SELECT name, track_id, row_number() OVER (PARTITION BY name ORDER BY n DESC, track_id) - 1 AS r FROM hits JOIN cat USING (artist)) WHERE r < 60""")
def artist_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists meant by the first word of every artist's name."""
    t = tracks(spark, sf_dir)
    return r.resolve_artists(t.where("artist IS NOT NULL").select(F.get(F.split("artist", " "), F.lit(0)).alias("name")), t)


_MENTION = "'^(.+?)(?: - | – | by | — )(.+)$'"


@query(f"""WITH {_CAT}, s AS (SELECT DISTINCT name || ' - ' || artist AS mention FROM t WHERE name IS NOT NULL AND artist IS NOT NULL),
    m AS (SELECT mention, CASE WHEN regexp_matches(mention, {_MENTION}) THEN regexp_extract(mention, {_MENTION}, 1) ELSE mention END AS name, CASE WHEN regexp_matches(mention, {_MENTION}) THEN regexp_extract(mention, {_MENTION}, 2) END AS artist FROM s),
    asked AS (SELECT mention, {q.norm("name")} AS title, {q.norm("artist")} AS want FROM m),
    hits AS (SELECT mention, track_id, n, coalesce(artist = want, false) AS own FROM asked JOIN cat USING (title) WHERE title <> ''), k AS (SELECT *, bool_or(own) OVER (PARTITION BY mention) AS any_own FROM hits)
    SELECT mention, track_id, CAST(row_number() OVER (PARTITION BY mention ORDER BY n DESC, track_id) - 1 AS INTEGER) AS rank FROM k WHERE own OR NOT any_own""")
def track_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks meant by the mention 'Title - Artist' of every track."""
    t = tracks(spark, sf_dir)
    named = t.where("name IS NOT NULL AND artist IS NOT NULL")
    return r.resolve_tracks(named.select(F.concat_ws(" - ", "name", "artist").alias("mention")), t)


@query(f"""WITH {q.PLAYLISTS}, {q.tokens("p", "playlist_id", "name")}, vocab AS (SELECT token FROM tok GROUP BY token HAVING count(DISTINCT key) >= 5), {q.CHALLENGES},
    ph AS (SELECT query_id, title AS phrase, {q.norm("title")} AS n FROM ch WHERE title IS NOT NULL), ex AS (SELECT query_id, phrase, n AS tag FROM ph WHERE n IN (SELECT token FROM vocab)),
    {q.tokens("ch", "query_id", "title", 1000, "qt")}, rest AS (SELECT key AS query_id, token FROM qt WHERE token IN (SELECT token FROM vocab) AND key NOT IN (SELECT query_id FROM ex)),
    part AS (SELECT *, bool_or(contains(token, ' ')) OVER (PARTITION BY query_id) AS any_pair FROM rest)
    SELECT query_id, tag FROM ex UNION ALL SELECT query_id, token FROM part WHERE contains(token, ' ') OR NOT any_pair""")
def tag_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known tags meant by each title: the whole title, else its word pairs, else its words."""
    vocabulary = b.tag_vocabulary(b.playlist_tokens(table(spark, sf_dir, "playlists")), 5)
    phrases = challenges(spark, sf_dir).where("title IS NOT NULL").select("query_id", F.col("title").alias("phrase"))
    return r.resolve_tags(phrases, vocabulary)
