"""Queries over readings: strings, voting, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import FusionRules
from ..functions import text as T
from ..functions.scoring import weighted_confidence
from ..operators import evaluate, fusion, vote
from .bindings import _valid, gate_of, plates_of, view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


READINGS = with_views("readings")
PLATED = with_views("readings", also=plates_of("readings"))
GATED = with_views("readings", also=plates_of("readings") + ",\n" + gate_of("plated"))
TALLY = """, per AS (SELECT track_id, plate, count(*) AS votes, avg(coalesce(confidence, 0)) AS mean_confidence, min(ord) AS first_ord FROM gated WHERE reason IS NULL GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, round(mean_confidence, 9) DESC, first_ord) AS place FROM per)"""
VOTE = TALLY + """, totals AS (SELECT track_id, count(*) AS total, count(*) FILTER (reason IS NULL) AS accepted FROM gated GROUP BY ALL),
    voted AS (SELECT t.track_id, coalesce(r.plate, '') AS plate, coalesce(r.votes, 0) AS votes, t.accepted, t.total, t.total - t.accepted AS rejected,
                     coalesce(r.mean_confidence, 0) AS mean_confidence, coalesce(r.votes, 0) >= 2 AS reliable
              FROM totals t LEFT JOIN ranked r ON t.track_id = r.track_id AND r.place = 1)"""


@query(READINGS + "SELECT track_id, ord, regexp_replace(upper(text), '[^0-9A-Z]', '', 'g') AS cleaned FROM readings")
def str1_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "readings").select("track_id", "ord", T.charset(F.col("text")).alias("cleaned"))


@query(READINGS + """, c AS (SELECT track_id, ord, regexp_replace(upper(text), '[^0-9A-Z]', '', 'g') AS c FROM readings)
    SELECT track_id, ord, CASE WHEN length(c) < 6 THEN c ELSE translate(substr(c, 1, 2), 'OILBS', '01185') || translate(substr(c, 3, 1), '012568', 'OIZSGB') || translate(substr(c, 4), 'OILBS', '01185') END AS one_letter,
           CASE WHEN length(c) < 6 THEN c ELSE translate(substr(c, 1, 2), 'OILBS', '01185') || translate(substr(c, 3, 1), '012568', 'OIZSGB') || substr(c, 4, 1) || translate(substr(c, 5), 'OILBS', '01185') END AS two_letters FROM c""")
def str2_position_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "readings").select("track_id", "ord", T.charset(F.col("text")).alias("c"))
    return c.select("track_id", "ord", T.by_position(F.col("c"), 1).alias("one_letter"), T.by_position(F.col("c"), 2).alias("two_letters"))


@query(READINGS + """, s AS (SELECT track_id, ord, regexp_replace(regexp_replace(upper(text), '[-. _/:\\s]', '-', 'g'), '[^-0-9A-Z]', '', 'g') AS s FROM readings)
    SELECT track_id, ord, CASE WHEN regexp_matches(s, '^-*[0-9A-Z]-*[0-9A-Z]-*[0-9A-Z]-') THEN 1 WHEN regexp_matches(s, '^-*([0-9A-Z]-*){3}[0-9A-Z]-') THEN 2 END AS letters FROM s""")
def str3_series_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "readings").select("track_id", "ord", T.series_letters(F.col("text")).alias("letters"))


@query(PLATED + "SELECT track_id, ord, plate FROM plated")
def str4_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_plate(view(spark, sf_dir, "readings"), "text").select("track_id", "ord", "plate")


@query(PLATED + f"SELECT track_id, ord, {_valid('plate')} AS valid FROM plated")
def str5_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_plate(view(spark, sf_dir, "readings"), "text").select("track_id", "ord", T.valid(F.col("plate")).alias("valid"))


@query(PLATED + f"""SELECT track_id, ord, CASE WHEN NOT {_valid('plate')} THEN plate
        ELSE regexp_extract(plate, '^([0-9]{{2}}[A-Z]{{1,2}})', 1) || '-' || regexp_extract(plate, '([0-9]{{3,6}})$', 1) END AS one_line,
        CASE WHEN NOT {_valid('plate')} THEN plate WHEN length(regexp_extract(plate, '[A-Z]([0-9]{{3,6}})$', 1)) > 4
             THEN substr(plate, 1, 2) || '-' || regexp_extract(plate, '([A-Z]{{1,2}}[0-9])', 1) || ' ' || substr(regexp_extract(plate, '[A-Z]([0-9]{{3,6}})$', 1), 2)
             ELSE regexp_extract(plate, '^([0-9]{{2}}[A-Z]{{1,2}})', 1) || '-' || regexp_extract(plate, '[A-Z]([0-9]{{3,6}})$', 1) END AS two_lines FROM plated""".replace("regexp_extract(plate, '([0-9]{3,6})$', 1)", "regexp_extract(plate, '[A-Z]([0-9]{3,6})$', 1)"))
def str6_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_plate(view(spark, sf_dir, "readings"), "text")
    return rows.select("track_id", "ord", T.display(F.col("plate")).alias("one_line"), T.display(F.col("plate"), True).alias("two_lines"))


@query(with_views("readings", "truth", also=plates_of("readings")) + """
    SELECT p.track_id, ord, CASE WHEN length(plate) = length(truth) THEN hamming(plate, truth) ELSE len(list_filter(generate_series(1, least(length(plate), length(truth))), lambda i: substr(plate, i::INT, 1) <> substr(truth, i::INT, 1))) END AS distance
    FROM plated p JOIN truth t ON p.track_id = t.track_id""")
def str7_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_plate(view(spark, sf_dir, "readings"), "text").join(view(spark, sf_dir, "truth"), "track_id")
    return rows.select("track_id", "ord", T.hamming(F.col("plate"), F.col("truth")).cast("long").alias("distance"))


@query(with_views("readings", "truth", also=plates_of("readings")) + """
    SELECT p.track_id, ord, levenshtein(plate, truth) AS distance, round(CASE WHEN length(truth) = 0 THEN CASE WHEN length(plate) = 0 THEN 0 ELSE 1 END ELSE levenshtein(plate, truth) / length(truth) END, 6) AS cer
    FROM plated p JOIN truth t ON p.track_id = t.track_id""")
def str8_character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_plate(view(spark, sf_dir, "readings"), "text").join(view(spark, sf_dir, "truth"), "track_id")
    p, t = F.col("plate"), F.col("truth")
    return rows.select("track_id", "ord", F.levenshtein(p, t).cast("long").alias("distance"), F.round(T.character_errors(p, t), 6).alias("cer"))


@query()
def str9_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratcliff-Obershelp ratio of each distinct reading and its track's truth."""
    rows = T.with_plate(view(spark, sf_dir, "readings"), "text").join(view(spark, sf_dir, "truth"), "track_id")
    return evaluate.with_ratio(rows.select("track_id", "plate", "truth").distinct(), "plate", "truth")


@query(GATED + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM gated GROUP BY ALL")
def flt5_reading_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vote.gated(view(spark, sf_dir, "readings"))
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


FRAGMENTS = """, frag AS (
        SELECT track_id, ord, coalesce('f' || CAST(frame_index AS STRING), 's' || CAST(ord AS STRING)) AS crop, plate, coalesce(confidence, 0) AS confidence,
               greatest(coalesce(confidence, 0), 0) * greatest(coalesce(score, 1), 0) AS weight
        FROM plated WHERE trim(coalesce(text, '')) <> '' AND coalesce(confidence, 0) >= 0.35 AND length(plate) BETWEEN 6 AND 10)"""
LENGTHS = FRAGMENTS + """, lens AS (SELECT track_id, length(plate) AS n, count(*) AS votes, round(sum(weight), 9) AS mass FROM frag GROUP BY ALL),
    best_len AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, mass DESC, n DESC) AS p FROM lens) WHERE p = 1),
    major AS (SELECT f.* FROM frag f JOIN best_len b ON f.track_id = b.track_id AND length(f.plate) = b.n)"""


@query(PLATED + FRAGMENTS[0:] + "SELECT track_id, ord, plate, round(weight, 6) AS weight FROM frag")
def flt6_fragment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fragments(view(spark, sf_dir, "readings")).select("track_id", "ord", "plate", F.round("weight", 6).alias("weight"))


@query(PLATED + FRAGMENTS + "SELECT track_id, ord, crop, plate, round(confidence, 6) AS confidence, round(weight, 6) AS weight FROM frag")
def agg28_fusion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.fragments(view(spark, sf_dir, "readings"))
    return out.withColumns({"confidence": F.round("confidence", 6), "weight": F.round("weight", 6)})


@query(GATED + VOTE + "SELECT track_id, plate, votes, accepted, total, rejected, round(mean_confidence, 6) AS mean_confidence, reliable FROM voted")
def agg1_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.vote(view(spark, sf_dir, "readings")).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(GATED + TALLY + "SELECT track_id, place, plate, votes FROM ranked WHERE place <= 5")
def win1_vote_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.candidates(view(spark, sf_dir, "readings")).withColumn("place", F.col("place").cast("long"))


@query(GATED + "SELECT track_id, reason, count(*) AS n FROM gated WHERE reason IS NOT NULL GROUP BY ALL")
def agg1_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.rejections(view(spark, sf_dir, "readings"))


@query(READINGS + "SELECT coalesce(CAST(track_id AS STRING), 'unknown') AS track, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM readings GROUP BY ALL")
def agg2_group_by_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = F.coalesce(F.col("track_id").cast("string"), F.lit("unknown")).alias("track")
    return view(spark, sf_dir, "readings").groupBy(track).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query(PLATED + LENGTHS + "SELECT track_id, n, votes FROM best_len")
def agg3_length_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.majority_length(fusion.fragments(view(spark, sf_dir, "readings")))
    return rows.groupBy("track_id", F.length("plate").alias("n")).agg(F.count("*").alias("votes"))


CLUSTERS = LENGTHS + """, pl AS (SELECT track_id, plate, count(*) AS n, sum(weight) AS mass, min(ord) AS first_ord FROM major GROUP BY ALL),
    links AS (SELECT a.track_id, a.plate AS a, b.plate AS b FROM pl a JOIN pl b ON a.track_id = b.track_id AND hamming(a.plate, b.plate) <= 2),
    reach(track_id, a, b) AS (SELECT track_id, a, b FROM links UNION SELECT r.track_id, r.a, l.b FROM reach r JOIN links l ON r.track_id = l.track_id AND r.b = l.a),
    roots AS (SELECT track_id, a AS plate, min(b) AS root FROM reach GROUP BY ALL),
    sizes AS (SELECT r.track_id, r.root, sum(n) AS n, round(sum(mass), 9) AS mass, min(first_ord) AS o FROM roots r JOIN pl ON r.track_id = pl.track_id AND r.plate = pl.plate GROUP BY ALL),
    places AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, mass DESC, o) AS cluster FROM sizes),
    clustered AS (SELECT m.*, p.cluster FROM major m JOIN roots r ON m.track_id = r.track_id AND m.plate = r.plate JOIN places p ON p.track_id = r.track_id AND p.root = r.root)"""
RECURSIVE = PLATED.replace("WITH ", "WITH RECURSIVE ", 1)


@query(RECURSIVE + CLUSTERS + "SELECT track_id, ord, cluster FROM clustered")
def agg4_similarity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.majority_length(fusion.fragments(view(spark, sf_dir, "readings")))
    return fusion.clusters(rows).select("track_id", "ord", "cluster")


@query(RECURSIVE + CLUSTERS + """SELECT track_id, count(*) AS n, max(cluster) AS clusters, count(*) FILTER (cluster = 2) / count(*) >= 0.3 AS mixed FROM clustered GROUP BY ALL""")
def agg5_mixing_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.clusters(fusion.majority_length(fusion.fragments(view(spark, sf_dir, "readings"))))
    return rows.groupBy("track_id").agg(F.count("*").alias("n"), F.max("cluster").alias("clusters"), (F.count_if(F.col("cluster") == 2) / F.count("*") >= FusionRules().second_share).alias("mixed"))


POSITIONS = CLUSTERS + """, shares AS (SELECT *, CASE WHEN sum(weight) OVER w > 0 THEN weight / sum(weight) OVER w ELSE 1e0 / count(*) OVER w END AS share FROM clustered WHERE cluster = 1 WINDOW w AS (PARTITION BY track_id, crop)),
    chars AS (SELECT track_id, share, confidence, i::INT - 1 AS position, substr(plate, i::INT, 1) AS ch FROM (SELECT *, unnest(generate_series(1, length(plate))) AS i FROM shares)),
    sums AS (SELECT track_id, position, ch, sum(share) AS mass, avg(confidence) AS mean FROM chars GROUP BY ALL),
    tops AS (SELECT *, max(mass) OVER (PARTITION BY track_id, position) AS top, mass / sum(mass) OVER (PARTITION BY track_id, position) AS certainty FROM sums),
    wins AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, position ORDER BY round(mean, 9) DESC, ch) AS p FROM tops WHERE top - mass <= 1e-9) WHERE p = 1),
    fused AS (SELECT track_id, string_agg(ch, '' ORDER BY position) AS fused_plate, round(avg(certainty), 6) AS certainty FROM wins GROUP BY ALL)"""


@query(RECURSIVE + POSITIONS + "SELECT track_id, position, ch, round(certainty, 6) AS certainty FROM wins")
def agg6_position_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.clusters(fusion.majority_length(fusion.fragments(view(spark, sf_dir, "readings")))).where("cluster = 1")
    return fusion.position_votes(rows).withColumn("certainty", F.round("certainty", 6))


@query(with_views("readings", also=plates_of("readings")) + """, p AS (SELECT track_id, coalesce(confidence, 0) AS weight, plate FROM plated WHERE length(plate) = 8),
    chars AS (SELECT track_id, weight, i::INT - 1 AS position, substr(plate, i::INT, 1) AS ch FROM (SELECT *, unnest(generate_series(1, 8)) AS i FROM p)),
    probs AS (SELECT track_id, weight, position, ch, 0.9e0 AS p FROM chars UNION ALL SELECT track_id, weight, position, '#', 0.1e0 FROM chars),
    sums AS (SELECT track_id, position, ch, sum(weight * ln(p)) AS score FROM probs GROUP BY ALL),
    e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY track_id, position)) AS e FROM sums),
    c AS (SELECT *, e / sum(e) OVER (PARTITION BY track_id, position) AS certainty, row_number() OVER (PARTITION BY track_id, position ORDER BY round(score, 9) DESC, ch) AS p FROM e)
    SELECT track_id, string_agg(ch, '' ORDER BY position) AS plate, round(avg(certainty), 6) AS certainty FROM c WHERE p = 1 GROUP BY ALL""")
def agg7_probability_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_plate(view(spark, sf_dir, "readings"), "text").where("length(plate) = 8")
    probs = F.transform(F.filter(F.split("plate", ""), lambda c: c != ""), lambda c: F.create_map(c, F.lit(0.9), F.lit("#"), F.lit(0.1)))
    out = fusion.fuse_probabilities(rows.select("track_id", F.coalesce("confidence", F.lit(0.0)).alias("weight"), probs.alias("probs")))
    mean = F.aggregate("certainty", F.lit(0.0), lambda a, x: a + x) / F.size("certainty")
    return out.select("track_id", "plate", F.round(mean, 6).alias("certainty"))


FUSE = POSITIONS + """, rep AS (SELECT c.*, f.fused_plate, row_number() OVER (PARTITION BY c.track_id, crop ORDER BY weight DESC, ord) AS r FROM clustered c JOIN fused f ON c.track_id = f.track_id WHERE cluster = 1),
    support AS (SELECT track_id, count(*) FILTER (r = 1 AND plate = fused_plate) AS support, coalesce(avg(confidence) FILTER (plate = fused_plate), avg(confidence)) AS mean FROM rep GROUP BY ALL)"""


@query(RECURSIVE + FUSE + "SELECT track_id, support, round(mean, 6) AS mean FROM support")
def agg8_supporting_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.clusters(fusion.majority_length(fusion.fragments(view(spark, sf_dir, "readings")))).where("cluster = 1")
    return fusion.supported(rows).withColumn("mean", F.round("mean", 6))


@query(RECURSIVE + ",\n" + gate_of("plated") + VOTE + FUSE + f""", counts AS (SELECT track_id, count(*) AS n, max(cluster) AS clusters, count(*) FILTER (cluster = 1) AS one, count(*) FILTER (cluster = 2) AS two FROM clustered GROUP BY ALL)
    SELECT v.track_id, CASE WHEN fused_plate IS NULL THEN '' WHEN {_valid('fused_plate')} THEN fused_plate ELSE v.plate END AS plate,
           CASE WHEN fused_plate IS NULL THEN false WHEN {_valid('fused_plate')} THEN support >= 2 AND NOT two / n >= 0.3 ELSE v.reliable END AS reliable,
           CASE WHEN fused_plate IS NULL THEN 0 WHEN {_valid('fused_plate')} THEN support ELSE v.votes END AS vote_count,
           CASE WHEN fused_plate IS NULL THEN 0 WHEN {_valid('fused_plate')} THEN one ELSE v.accepted END AS accepted, coalesce(clusters, 0) AS clusters,
           coalesce(two / n >= 0.3, false) AS mixed, fused_plate IS NOT NULL AND NOT {_valid('fused_plate')} AS fallback
    FROM voted v LEFT JOIN fused f ON v.track_id = f.track_id LEFT JOIN support s ON v.track_id = s.track_id LEFT JOIN counts c ON v.track_id = c.track_id""")
def agg9_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(view(spark, sf_dir, "readings")).select("track_id", "plate", "reliable", "vote_count", "accepted", "clusters", "mixed", "fallback")


@query(with_views("readings", "truth", also=plates_of("readings") + ",\n" + gate_of("plated")) + VOTE + """
    SELECT t.track_id, t.split, coalesce(plate, '') AS plate, coalesce(votes, 0) AS votes, coalesce(accepted, 0) AS accepted, coalesce(reliable, false) AS reliable FROM truth t LEFT JOIN voted v ON t.track_id = v.track_id""")
def jn5_tracks_with_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = view(spark, sf_dir, "truth").join(vote.vote(view(spark, sf_dir, "readings")), "track_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("track_id", "split", F.coalesce("plate", F.lit("")).alias("plate"), zero("votes"), zero("accepted"), F.coalesce("reliable", F.lit(False)).alias("reliable"))


@query(GATED + VOTE + "SELECT count(*) AS tracks, count(*) FILTER (plate <> '') AS with_plate, sum(total)::BIGINT AS readings, sum(accepted)::BIGINT AS accepted, count(*) FILTER (reliable) AS reliable FROM voted")
def agg12_pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vote.vote(view(spark, sf_dir, "readings"))
    return out.agg(F.count("*").alias("tracks"), F.count_if(F.col("plate") != "").alias("with_plate"), F.sum("total").alias("readings"), F.sum("accepted").alias("accepted"), F.count_if("reliable").alias("reliable"))


@query(RECURSIVE.replace("readings AS", "truth AS (SELECT o_orderkey AS track_id, " + "(lpad(CAST(o_orderkey % 89 + 11 AS STRING), 2, '0') || chr(CAST(65 + o_orderkey % 26 AS INT)) || lpad(CAST((o_orderkey * 7919) % 100000 AS STRING), 5, '0')) AS truth FROM orders),\nreadings AS", 1) + ",\n" + gate_of("plated") + VOTE + FUSE + f""",
    compared AS (SELECT t.track_id, truth, v.plate AS vote_plate, CASE WHEN fused_plate IS NULL THEN '' WHEN {_valid('fused_plate')} THEN fused_plate ELSE v.plate END AS fusion_plate
             FROM voted v JOIN truth t ON v.track_id = t.track_id LEFT JOIN fused f ON f.track_id = v.track_id),
    methods AS (SELECT 'vote' AS method, truth, vote_plate AS got FROM compared UNION ALL SELECT 'fusion', truth, fusion_plate FROM compared)
    SELECT method, count(*) AS n, count(*) FILTER (got = truth) AS exact, count(*) FILTER (got = '') AS empty, sum(levenshtein(got, truth))::BIGINT AS distance, sum(length(truth))::BIGINT AS characters,
           round(sum(levenshtein(got, truth)) / sum(length(truth)), 6) AS cer, round(count(*) FILTER (got = truth) / count(*), 6) AS accuracy FROM methods GROUP BY ALL""")
def agg16_corpus_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, truth = view(spark, sf_dir, "readings"), view(spark, sf_dir, "truth").select("track_id", "truth")
    old = vote.vote(readings).select("track_id", F.lit("vote").alias("method"), F.col("plate").alias("got"))
    new = fusion.fuse(readings).select("track_id", F.lit("fusion").alias("method"), F.col("plate").alias("got"))
    return evaluate.accuracy(old.unionByName(new).join(truth, "track_id"), "method")


@query(READINGS + """SELECT track_id, round(sum(coalesce(confidence, 0) * greatest(1, length(trim(coalesce(text, ''))))) / sum(greatest(1, length(trim(coalesce(text, ''))))), 9) AS confidence FROM readings GROUP BY ALL""")
def agg22_weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = view(spark, sf_dir, "readings").groupBy("track_id").agg(weighted_confidence(F.coalesce("confidence", F.lit(0.0)), F.col("text")).alias("confidence"))
    return out.withColumn("confidence", F.round("confidence", 9))


@query(READINGS + """SELECT track_id, ord, text, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY coalesce(confidence, 0) DESC, ord) AS p FROM readings) WHERE p = 1""")
def agg25_best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reading of highest confidence per track: one struct per group moves, not the rows."""
    key = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("ord")).alias("o"))
    best = view(spark, sf_dir, "readings").groupBy("track_id").agg(F.max_by(F.struct("ord", "text", "confidence"), key).alias("b"))
    return best.select("track_id", "b.ord", "b.text", F.round("b.confidence", 6).alias("confidence"))


@query(GATED + """, a AS (SELECT * FROM gated WHERE engine = 'first'), b AS (SELECT * FROM gated WHERE engine = 'second'),
    """ + ", ".join(f"""per_{x} AS (SELECT track_id, plate, count(*) AS votes, avg(coalesce(confidence, 0)) AS m, min(ord) AS o FROM {x} WHERE reason IS NULL GROUP BY ALL),
    best_{x} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, round(m, 9) DESC, o) AS p FROM per_{x}) WHERE p = 1),
    tot_{x} AS (SELECT track_id, count(*) AS n FROM {x} GROUP BY ALL)""" for x in "ab") + """
    SELECT ta.track_id, coalesce(ba.plate, '') AS first_plate, coalesce(bb.plate, '') AS second_plate, coalesce(ba.votes, 0) AS first_votes, coalesce(bb.votes, 0) AS second_votes, coalesce(ba.plate, '') = coalesce(bb.plate, '') AS same
    FROM tot_a ta LEFT JOIN best_a ba ON ta.track_id = ba.track_id LEFT JOIN best_b bb ON ta.track_id = bb.track_id""")
def agg26_two_votes_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = view(spark, sf_dir, "readings")
    a = vote.vote(readings.where("engine = 'first'")).select("track_id", F.col("plate").alias("first_plate"), F.col("votes").alias("first_votes"))
    b = vote.vote(readings.where("engine = 'second'")).select("track_id", F.col("plate").alias("second_plate"), F.col("votes").alias("second_votes"))
    out = a.join(b, "track_id", "left").withColumns({"second_plate": F.coalesce("second_plate", F.lit("")), "second_votes": F.coalesce("second_votes", F.lit(0))})
    return out.withColumn("same", F.col("first_plate") == F.col("second_plate"))


@query(PLATED + """, d AS (SELECT DISTINCT track_id, plate FROM plated WHERE plate <> '')
    SELECT a.track_id, a.plate AS plate_a, b.plate AS plate_b, hamming(a.plate, b.plate) AS distance FROM d a JOIN d b ON a.track_id = b.track_id AND length(a.plate) = length(b.plate) AND a.plate < b.plate WHERE hamming(a.plate, b.plate) <= 2""")
def jn4_hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different plates of one track at most two characters apart: an equi-join on track and length."""
    d = T.with_plate(view(spark, sf_dir, "readings"), "text").where("plate <> ''").select("track_id", "plate", F.length("plate").alias("n")).distinct()
    a, b = d.withColumnRenamed("plate", "plate_a"), d.withColumnRenamed("plate", "plate_b")
    out = a.join(b, ["track_id", "n"]).where("plate_a < plate_b").withColumn("distance", T.hamming(F.col("plate_a"), F.col("plate_b")).cast("long"))
    return out.where("distance <= 2").select("track_id", "plate_a", "plate_b", "distance")


@query(READINGS + "SELECT track_id, string_agg(text, ' ' ORDER BY f) AS raw_text FROM (SELECT track_id, text, min(ord) AS f FROM readings WHERE text <> '' GROUP BY ALL) GROUP BY ALL")
def prj8_joined_raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct raw texts of a track in order of arrival, joined by a space."""
    first = view(spark, sf_dir, "readings").where("text <> ''").groupBy("track_id", "text").agg(F.min("ord").alias("f"))
    return first.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "text"))), lambda r: r["text"]), " ").alias("raw_text"))


@query(READINGS + "SELECT track_id, string_agg(text, '' ORDER BY ord) AS joined, count(*) AS items FROM readings WHERE text <> '' GROUP BY ALL HAVING count(*) > 1")
def str13_concatenated_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "readings").where("text <> ''").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return parts.where(F.size("t") > 1).select("track_id", F.array_join(F.transform("t", lambda r: r["text"]), "").alias("joined"), F.size("t").cast("long").alias("items"))


@query(READINGS + """SELECT track_id, ord, coalesce(nullif(text, ''), 'none') AS text, CASE WHEN text = '' THEN 'frame' ELSE engine END AS variant FROM readings""")
def prj3_unpack_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty items of each parent; a parent without one gives a row of its own with variant ``frame``."""
    parents = view(spark, sf_dir, "readings").select("track_id", "ord", F.filter(F.array(F.struct("text", F.col("engine").alias("variant"))), lambda r: r["text"] != "").alias("items"))
    rows = parents.select("track_id", "ord", F.explode_outer("items").alias("r"))
    return rows.select("track_id", "ord", F.coalesce("r.text", F.lit("none")).alias("text"), F.coalesce("r.variant", F.lit("frame")).alias("variant"))


@query(with_views("readings", "truth") + """, keyed AS (SELECT CAST(track_id AS STRING) AS tid, split, truth FROM truth WHERE track_id % 3 = 0),
    based AS (SELECT CAST(track_id AS STRING) AS tid, truth FROM truth WHERE track_id % 3 = 1), bare AS (SELECT CAST(track_id AS STRING) AS tid, truth FROM truth WHERE track_id % 5 <> 0),
    t AS (SELECT DISTINCT CAST(r.track_id AS STRING) AS tid FROM readings r)
    SELECT t.tid AS track, coalesce(k.truth, b.truth, n.truth) AS label FROM t LEFT JOIN keyed k ON t.tid = k.tid LEFT JOIN based b ON t.tid = b.tid LEFT JOIN bare n ON t.tid = n.tid WHERE coalesce(k.truth, b.truth, n.truth) IS NOT NULL""")
def jn6_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys in turn: (video, track), (base name, track), ('', track); tracks without a label go."""
    tracks = view(spark, sf_dir, "readings").select(F.col("track_id").cast("string").alias("track")).distinct().withColumn("video", F.lit("a/b.mp4"))
    truth = view(spark, sf_dir, "truth")
    one = lambda cond, video: truth.where(cond).select(F.lit(video).alias("video"), F.col("track_id").cast("string").alias("track"), F.col("truth").alias("ground_truth"))
    labels = one("track_id % 3 = 0", "a/b.mp4").unionByName(one("track_id % 3 = 1", "b.mp4")).unionByName(one("track_id % 5 <> 0", ""))
    return evaluate.labelled(tracks, labels).select("track", "label")


@query(with_views("readings", "truth") + """, a AS (SELECT track_id, max(text) AS a FROM readings WHERE engine = 'first' GROUP BY ALL), b AS (SELECT track_id, max(text) AS b FROM readings WHERE engine = 'second' GROUP BY ALL)
    SELECT a.track_id, a AS first_text, coalesce(b, '') AS second_text FROM a LEFT JOIN b ON a.track_id = b.track_id""")
def jn11_engine_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "readings")
    side = lambda e, name: r.where(F.col("engine") == e).groupBy("track_id").agg(F.max("text").alias(name))
    return side("first", "first_text").join(side("second", "second_text"), "track_id", "left").withColumn("second_text", F.coalesce("second_text", F.lit("")))


@query(with_views("readings", "frames") + "SELECT r.track_id, r.ord, f.video_id, f.brightness FROM readings r JOIN frames f ON r.track_id = f.frame_index")
def jn14_readings_with_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, f = view(spark, sf_dir, "readings"), view(spark, sf_dir, "frames")
    return r.join(f, r["track_id"] == f["frame_index"]).select("track_id", "ord", "video_id", "brightness")


@query(with_views("readings", also=plates_of("readings") + ",\n" + gate_of("plated")) + VOTE + """
    SELECT r.track_id, r.ord, coalesce(nullif(v.plate, ''), r.text) AS label FROM readings r LEFT JOIN voted v ON r.track_id = v.track_id""")
def jn15_overlay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of drawn labels, each replaced by its track's final plate."""
    r = view(spark, sf_dir, "readings")
    final = vote.vote(r).select("track_id", F.when(F.col("plate") != "", F.col("plate")).alias("plate"))
    return r.join(final, "track_id", "left").select("track_id", "ord", F.coalesce("plate", "text").alias("label"))


@query(GATED + VOTE + "SELECT track_id, plate, votes FROM voted ORDER BY votes DESC, track_id LIMIT 12")
def srt4_top_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: a top-12 report."""
    return vote.vote(view(spark, sf_dir, "readings")).select("track_id", "plate", "votes").orderBy(F.desc("votes"), "track_id").limit(12)


@query(GATED + VOTE + """, t AS (SELECT unnest([1, 2, 3, 4]) AS least)
    SELECT least, count(*) FILTER (votes >= least) AS reliable, count(*) AS tracks FROM voted CROSS JOIN t GROUP BY ALL""")
def udx11_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliable tracks at each of four thresholds: a constant array beside every track, no join."""
    out = vote.vote(view(spark, sf_dir, "readings")).select("votes", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3, 4)])).alias("least"))
    return out.groupBy("least").agg(F.count_if(F.col("votes") >= F.col("least")).alias("reliable"), F.count("*").alias("tracks"))


@query(READINGS + "SELECT track_id, ord, trim(upper(text)) IN (SELECT DISTINCT upper(text) FROM readings WHERE engine = 'first') AS known FROM readings WHERE text <> ''")
def jn12_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "readings").where("text <> ''")
    known = r.where("engine = 'first'").select(F.upper("text").alias("t")).distinct().withColumn("known", F.lit(True))
    return r.withColumn("t", F.trim(F.upper("text"))).join(known, "t", "left").select("track_id", "ord", F.coalesce("known", F.lit(False)).alias("known"))


@query(READINGS + "SELECT text, track_id FROM readings WHERE engine = 'first' INTERSECT SELECT text, track_id FROM readings WHERE engine = 'second'")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "readings")
    return r.where("engine = 'first'").select("text", "track_id").intersect(r.where("engine = 'second'").select("text", "track_id"))


@query(READINGS + "SELECT text, track_id FROM readings WHERE engine = 'first' EXCEPT SELECT text, track_id FROM readings WHERE engine = 'second'")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "readings")
    return r.where("engine = 'first'").select("text", "track_id").subtract(r.where("engine = 'second'").select("text", "track_id"))


@query(READINGS + "SELECT track_id FROM readings WHERE text <> '' UNION SELECT track_id FROM readings WHERE confidence IS NULL")
def set2_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "readings")
    return r.where("text <> ''").select("track_id").union(r.where("confidence is null").select("track_id")).distinct()


