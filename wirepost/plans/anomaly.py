"""Queries of the anomaly operators over embeddings: the first 20 components are features, the label is the capture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anomaly, experiments
from ..tables import stage
from .bridge import table

#: Captures whose sizes the driver deals to folds; more are an error.
MAX_CAPTURES = 200_000


def cells(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode(F.slice("embedding", 1, 20)).alias("feature", "x"))
    hidden = F.col("id") % 7 == F.col("feature") % 7
    return rows.select("id", "label", "feature", F.when(~hidden, F.floor(F.col("x").cast("double") * 64).cast("double")).alias("value"))


C = """WITH c AS (SELECT vec_id AS id, label, f AS feature, CASE WHEN vec_id % 7 <> f % 7 THEN floor(CAST(embedding[f + 1] AS DOUBLE) * 64) END AS value
    FROM (SELECT vec_id, label, embedding, unnest(range(20)) AS f FROM embeddings))"""
HIST = f"""{C}, st AS (SELECT feature, min(value) AS low, max(value) AS high, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM c WHERE value IS NOT NULL GROUP BY feature),
    ed AS (SELECT *, CASE WHEN q3 > q1 THEN greatest(2, least(10, CAST(ceil((high - low) / (2 * (q3 - q1) / cbrt(n))) AS INTEGER))) ELSE 2 END AS bins FROM st WHERE high > low),
    bn AS (SELECT c.id, c.label, c.feature, value, low, high, bins, n, least(CAST(floor((value - low) / (high - low) * bins) AS INTEGER), bins - 1) AS bin FROM c JOIN ed USING (feature) WHERE value IS NOT NULL),
    dn AS (SELECT feature, bin, bins, n, (count(*) + 1.0::DOUBLE) / (n + 1.0::DOUBLE * (bins + 1)) AS density FROM bn GROUP BY feature, bin, bins, n),
    pt AS (SELECT c.id, c.label, c.feature, CASE WHEN c.value IS NULL THEN 0.0::DOUBLE ELSE -ln(dn.density) END AS part
           FROM c LEFT JOIN bn USING (id, feature) LEFT JOIN dn ON dn.feature = bn.feature AND dn.bin = bn.bin),
    sc AS (SELECT id, label, round(sum(part), 6) AS score FROM pt GROUP BY id, label)"""


def parts(s, d):
    return anomaly.contributions(cells(s, d).select("id", "feature", "value"), anomaly.histogram(cells(s, d)))


def scored(s, d):
    """(id, score, label); written once, as the statistics of scores read them several times."""
    rows = anomaly.scores(parts(s, d)).withColumn("score", F.round("score", 6))
    return stage(rows.join(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id"), "scores")


def agg_24(s, d):
    fitted = anomaly.histogram(cells(s, d))
    return fitted.select("feature", "bins", F.explode("densities").alias("bin", "density")).withColumn("density", F.round("density", 9))


def agg_25(s, d):
    scale = anomaly.robust(scored(s, d))
    return scale.select(F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def agg_23(s, d):
    """Share of each value of one feature inside its capture."""
    rows = cells(s, d).where("feature = 0 and value is not null")
    total = rows.groupBy("label").agg(F.count("*").alias("n"))
    shares = rows.groupBy("label", "value").agg(F.count("*").alias("c")).join(total, "label")
    return shares.select("label", "value", F.round(F.col("c") / F.col("n"), 9).alias("share"))


def agg_27(s, d):
    share = 100 * (F.col("below") + 0.5 * F.col("same")) / F.col("total")
    return anomaly.counted_below(scored(s, d), "label", "score").select("id", F.round(share, 6).alias("percentile"))


def win_11(s, d):
    """Conservative ranks: how many of the capture score as high or higher."""
    return anomaly.counted_below(scored(s, d), "label", "score").select("id", (F.col("total") - F.col("below")).alias("rank"))


def mth_06(s, d):
    rows = scored(s, d)
    return anomaly.standardized(rows, anomaly.robust(rows)).select("id", F.round("z", 5).alias("z"))


def mth_07(s, d):
    """The larger of two standardised components, of which one may be silent."""
    rows = scored(s, d)
    one = anomaly.standardized(rows, anomaly.robust(rows))
    other = F.when(F.col("label") % 2 == 0, F.col("score") / 100)
    return one.select("id", F.round(F.greatest(F.col("z"), other), 5).alias("ensemble"))


def agg_29(s, d):
    rows = scored(s, d)
    middle = anomaly.quantiles(anomaly.counted(rows, ["label"], "score"), ["label"], "score", median=0.5)
    return rows.groupBy("label").agg(F.max("score").alias("highest")).join(middle, "label").select("label", F.round("median", 4).alias("median"), "highest")


#: Seeds, and the features that a seed's model looks at.
SEEDS = (1, 2, 3, 4, 5)


def seeded(s, d):
    """(label, seed, id, score): histogram scores over the features that each seed looks at."""
    looked_at = F.filter(F.array(*map(F.lit, SEEDS)), lambda n: (F.col("feature") * 7 + n * 11) % 3 > 0)
    rows = parts(s, d).select("id", "part", F.explode(looked_at).alias("seed")).groupBy("id", "seed").agg(F.round(F.sum("part"), 6).alias("score"))
    return rows.join(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")


def agg_32(s, d):
    """Mean overlap of the ten highest rows of a capture between models of five seeds."""
    return experiments.stability(experiments.tops(seeded(s, d), ["label", "seed"], 10), ["label"]).withColumn("jaccard", F.round("jaccard", 9))


def srt_10(s, d):
    """The five highest rows of each capture for each seed."""
    return experiments.tops(seeded(s, d), ["label", "seed"], 5).groupBy("label", "seed").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def forest_stability(s, d):
    """Mean overlap of the ten rows that forests of five seeds set apart most easily."""
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    scores = experiments.isolation(vectors, experiments.forests(vectors, list(SEEDS)))
    return experiments.stability(experiments.tops(scores.withColumnRenamed("isolation", "score"), ["seed"], 10))


#: What is planted: features set to values far outside, to the edge, or near the rest.
PLANTS = {"far_below": {0: -1e6, 2: -1e6}, "beyond": {f: "high * 16 + 1000" for f in range(0, 20, 3)}, "one_odd": {5: "high + 1"}, "at_the_edge": {1: "high", 4: "high"}, "unchanged": {}}
MASKS = {"even": [0], "odd": [1], "both": [0, 1]}


def dom_15(s, d):
    """Rank of planted rows among test rows, by component mask: models fitted on captures of the first third, scaled by the second, tested on the last."""
    every = cells(s, d)
    third = lambda k: every.where(F.col("label") % 3 == k)
    component = F.col("feature") % 2
    fitted = stage(anomaly.histogram(third(0).select("id", "feature", "value")), "fitted")
    scale = experiments.scales(experiments.component_scores(third(1), fitted, component))
    kinds = {kind: {f: F.expr(str(v)).cast("double") for f, v in settings.items()} for kind, settings in PLANTS.items()}
    plants = experiments.planted(third(2), kinds).withColumnRenamed("kind", "id")
    test = experiments.ensembles(experiments.component_scores(third(2), fitted, component), scale, MASKS)
    found = experiments.recall(test, experiments.ensembles(experiments.component_scores(plants, fitted, component), scale, MASKS))
    return found


def dom_13(s, d):
    """Whole captures to three folds: the largest first, each to the fold that has fewest rows; captures are few."""
    return folds_of(table(s, d, "embeddings").select("vec_id", "label"))


def folds_of(rows):
    s = rows.sparkSession
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_CAPTURES + 1).collect()
    if len(sizes) > MAX_CAPTURES:
        raise ValueError(f"more than {MAX_CAPTURES} captures")
    load, fold = [0, 0, 0], []
    for r in sizes:
        k = min(range(3), key=lambda i: (load[i], i))
        load[k] += r.n
        fold.append((r.label, k))
    folds = s.createDataFrame(fold, "label int, fold int")
    return rows.join(F.broadcast(folds), "label").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("label").alias("captures"))


def _srt_09(s, d):
    return scored(s, d).orderBy(F.desc("score"), "id").limit(10).select("id", "score")


def dom_14(s, d):
    found = anomaly.applied(scored(s, d), "label", F.col("id") % 3 == 0)
    return found.withColumn("percentile", F.round("percentile", 6))


QUERIES = {
    "dom_14": dom_14,
    "dom_15": dom_15,
    "forest_stability": forest_stability,
    "agg_23": agg_23,
    "agg_24": agg_24,
    "agg_25": agg_25,
    "agg_26": lambda s, d: anomaly.quantile_higher(scored(s, d), "label", "score", 0.99),
    "agg_27": agg_27,
    "agg_29": agg_29,
    "agg_32": agg_32,
    "dom_13": dom_13,
    "flt_19": lambda s, d: anomaly.varying(cells(s, d)),
    "mth_04": lambda s, d: parts(s, d).select("id", "feature", F.round("part", 6).alias("part")),
    "mth_05": lambda s, d: scored(s, d).select("id", "score"),
    "mth_06": mth_06,
    "mth_07": mth_07,
    "mth_08": lambda s, d: cells(s, d).where("feature in (0, 7, 14)").groupBy("id").agg((F.count("value") == 0).alias("abstains")),
    "srt_08": lambda s, d: anomaly.top_factors(parts(s, d).withColumn("part", F.round("part", 6))),
    "srt_09": _srt_09,
    "srt_10": srt_10,
    "win_11": win_11,
}
SEEDED = f"{HIST}, se AS (SELECT id, label, seed, round(sum(part), 6) AS score FROM pt, (SELECT unnest({list(SEEDS)}) AS seed) WHERE (feature * 7 + seed * 11) % 3 > 0 GROUP BY ALL)"
_SETTINGS = " ".join(f"WHEN kind = '{kind}' AND feature = {f} THEN {v}" for kind, settings in PLANTS.items() for f, v in settings.items())
PLANTED = f"""{C}, st AS (SELECT feature, min(value) AS low, max(value) AS high, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM c WHERE label % 3 = 0 AND value IS NOT NULL GROUP BY feature),
    ed AS (SELECT *, CASE WHEN q3 > q1 THEN greatest(2, least(10, CAST(ceil((high - low) / (2 * (q3 - q1) / cbrt(n))) AS INTEGER))) ELSE 2 END AS bins FROM st WHERE high > low),
    dn AS (SELECT feature, least(CAST(floor((value - low) / (high - low) * bins) AS INTEGER), bins - 1) AS bin, (count(*) + 1.0::DOUBLE) / (any_value(n) + 1.0::DOUBLE * (any_value(bins) + 1)) AS density
           FROM c JOIN ed USING (feature) WHERE label % 3 = 0 AND value IS NOT NULL GROUP BY ALL),
    base AS (SELECT arg_min(id, (-seen, id)) AS id FROM (SELECT id, count(value) AS seen FROM c WHERE label % 3 = 2 GROUP BY id)),
    hi AS (SELECT feature, max(value) AS high FROM c WHERE label % 3 = 2 GROUP BY feature),
    own AS (SELECT kind, feature, CAST(CASE {_SETTINGS} ELSE value END AS DOUBLE) AS value FROM c JOIN base USING (id) JOIN hi USING (feature), (SELECT unnest({list(PLANTS)}) AS kind)),
    rw AS (SELECT CAST(id AS VARCHAR) AS id, label % 3 AS third, feature, value FROM c UNION ALL SELECT kind, 3, feature, value FROM own),
    pp AS (SELECT rw.id, third, rw.feature % 2 AS component, CASE WHEN value IS NULL THEN 0.0::DOUBLE WHEN value < low OR value > high OR density IS NULL THEN -ln(1.0::DOUBLE / (n + bins + 1)) ELSE -ln(density) END AS part
           FROM rw JOIN ed ON rw.feature = ed.feature LEFT JOIN dn ON dn.feature = rw.feature AND dn.bin = CASE WHEN value BETWEEN low AND high THEN least(CAST(floor((value - low) / (high - low) * bins) AS INTEGER), bins - 1) END),
    cs AS (SELECT id, third, component, round(sum(part), 6) AS score FROM pp GROUP BY ALL),
    md AS (SELECT component, median(score) AS med FROM cs WHERE third = 1 GROUP BY component),
    sd AS (SELECT component, any_value(med) AS med, median(abs(score - med)) * 1.4826 AS mad FROM cs JOIN md USING (component) WHERE third = 1 GROUP BY component),
    zs AS (SELECT mask, id, third, coalesce(max(CASE WHEN mad > 0 THEN round((score - med) / mad, 6) END), 0.0) AS score FROM cs JOIN sd USING (component) JOIN (VALUES ('even', 0), ('odd', 1), ('both', 0), ('both', 1)) m(mask, of) ON of = component GROUP BY mask, id, third)"""
ROB = f"{HIST}, m AS (SELECT median(score) AS med FROM sc), r AS (SELECT any_value(med) AS med, median(abs(score - med)) * 1.4826 AS mad FROM sc, m)"
ORACLES = {
    "agg_23": f"{C}, x AS (SELECT * FROM c WHERE feature = 0 AND value IS NOT NULL) SELECT label, value, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 9) AS share FROM x GROUP BY label, value",
    "agg_24": f"{HIST} SELECT CAST(feature AS INTEGER) AS feature, bins, bin, round(density, 9) AS density FROM dn",
    "agg_25": f"{ROB} SELECT round(med, 6) AS median, round(mad, 6) AS mad FROM r",
    "agg_26": f"{HIST}, k AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM sc) SELECT label, score AS threshold FROM k WHERE i = CAST(ceil(0.99 * (n - 1)) AS BIGINT)",
    "agg_27": f"{HIST} SELECT a.id, round(100.0 * (count(*) FILTER (WHERE b.score < a.score) + 0.5 * count(*) FILTER (WHERE b.score = a.score)) / count(*), 6) AS percentile FROM sc a JOIN sc b ON a.label = b.label GROUP BY a.id",
    "agg_29": f"{HIST} SELECT label, round(median(score), 4) AS median, max(score) AS highest FROM sc GROUP BY label",
    "agg_32": f"""{SEEDED}, k AS (SELECT label, seed, id FROM (SELECT *, row_number() OVER (PARTITION BY label, seed ORDER BY score DESC, id) AS r FROM se) WHERE r <= 10),
        n AS (SELECT label, seed, count(*) AS n FROM k GROUP BY ALL),
        j AS (SELECT a.label, a.n + b.n AS n_both, (SELECT count(*) FROM k x JOIN k y ON x.label = y.label AND x.id = y.id WHERE x.label = a.label AND x.seed = a.seed AND y.seed = b.seed) AS common
              FROM n a JOIN n b ON a.label = b.label AND a.seed < b.seed)
        SELECT label, count(*) AS pairs, round(avg(common / (n_both - common)), 9) AS jaccard FROM j GROUP BY label""",
    "dom_14": f"""{HIST}, k AS (SELECT id, label, score, row_number() OVER (PARTITION BY label ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM sc),
        t AS (SELECT label, score AS threshold FROM k WHERE i = CAST(ceil(0.99 * (n - 1)) AS BIGINT)),
        p AS (SELECT a.id, 100.0 * (count(*) FILTER (WHERE b.score < a.score) + 0.5 * count(*) FILTER (WHERE b.score = a.score)) / count(*) AS percentile FROM sc a JOIN sc b ON a.label = b.label GROUP BY a.id)
        SELECT sc.id, score, score >= threshold AS is_anomaly, round(percentile, 6) AS percentile, score >= threshold AND sc.id % 3 = 0 AS disagrees FROM sc JOIN t USING (label) JOIN p ON sc.id = p.id""",
    "dom_15": f"""{PLANTED}
        SELECT p.mask, p.id AS kind, count(*) FILTER (WHERE t.score >= p.score) + 1 AS rank, count(*) + 1 AS total, count(*) FILTER (WHERE t.score >= p.score) + 1 <= 10 AS in_top
        FROM zs p JOIN zs t ON p.mask = t.mask AND t.third = 2 WHERE p.third = 3 GROUP BY p.mask, p.id""",
    "dom_13": """WITH RECURSIVE s AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS i FROM embeddings GROUP BY label),
        r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, -1 AS fold, CAST(0 AS BIGINT) AS n
            UNION ALL
            SELECT i, a + CASE fold WHEN 0 THEN n ELSE 0 END, b + CASE fold WHEN 1 THEN n ELSE 0 END, c + CASE fold WHEN 2 THEN n ELSE 0 END, fold, n
            FROM (SELECT s.i, s.n, a, b, c, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS fold FROM r JOIN s ON s.i = r.i + 1))
        SELECT fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS captures FROM r WHERE fold >= 0 GROUP BY fold""",
    "flt_19": f"{C} SELECT CAST(feature AS INTEGER) AS feature FROM c GROUP BY feature HAVING count(value) > 1 AND max(value) > min(value)",
    "mth_04": f"{HIST} SELECT id, CAST(feature AS INTEGER) AS feature, round(part, 6) AS part FROM pt",
    "mth_05": f"{HIST} SELECT id, score FROM sc",
    "mth_06": f"{ROB} SELECT id, round((score - med) / mad, 5) AS z FROM sc, r",
    "mth_07": f"{ROB} SELECT id, round(CASE WHEN label % 2 = 0 THEN greatest((score - med) / mad, score / 100) ELSE (score - med) / mad END, 5) AS ensemble FROM sc, r",
    "mth_08": f"{C} SELECT id, count(value) = 0 AS abstains FROM c WHERE feature IN (0, 7, 14) GROUP BY id",
    "srt_08": f"{HIST}, q AS (SELECT id, feature, round(part, 6) AS part FROM pt WHERE part > 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part DESC, feature) AS rank FROM q) SELECT id, CAST(rank AS INTEGER) AS rank, CAST(feature AS INTEGER) AS feature, part FROM k WHERE rank <= 3",
    "srt_09": f"{HIST} SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 10",
    "srt_10": f"{SEEDED} SELECT label, CAST(seed AS INTEGER) AS seed, list(id ORDER BY id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY label, seed ORDER BY score DESC, id) AS r FROM se) WHERE r <= 5 GROUP BY label, seed",
    "win_11": f"{HIST} SELECT a.id, count(*) AS rank FROM sc a JOIN sc b ON a.label = b.label AND b.score >= a.score GROUP BY a.id",
}
