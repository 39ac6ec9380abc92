"""Evaluation summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import evaluate as E
from helixmill.operators import graph, nearest, sketches
from helixmill.plans.registry import R, U, query, r6, table

EVAL = "ev AS (SELECT l_orderkey AS sample, l_linenumber AS idx, l_returnflag AS split, l_partkey % 10 AS len, l_quantity / 50 AS tm, l_discount * 20 AS rmsd, l_tax * 10 AS plddt FROM lineitem)"


def _eval(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("sample"), c("l_linenumber").alias("idx"), c("l_returnflag").alias("split"), (c("l_partkey") % 10).alias("len"), (c("l_quantity") / 50).alias("tm"), (c("l_discount") * 20).alias("rmsd"), (c("l_tax") * 10).alias("plddt"))


def _rounded(df, keys, names):
    return df.select(*keys, *[r6(n).alias(n) if n not in ("n", "n_pass") else F.col(n) for n in names])


@query("AGG01", f"WITH {EVAL} SELECT split, {R('avg(tm)')} AS tm_vq, {R('avg(rmsd)')} AS rmsd_vq, {R('avg(plddt)')} AS exposure FROM ev GROUP BY split")
def eval_means(spark, d):
    return _rounded(E.means(_eval(spark, d), {"tm_vq": "tm", "rmsd_vq": "rmsd", "exposure": "plddt"}, ["split"]), ["split"], ["tm_vq", "rmsd_vq", "exposure"])


@query("AGG02", f"WITH {EVAL} SELECT CAST(sum(CASE WHEN tm >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_pass, {R('avg(CASE WHEN tm >= 0.5 THEN 1 ELSE 0 END)')} AS pass_rate, count(*) AS n, {R('avg(rmsd)')} AS rmsd FROM ev")
def designable_metrics(spark, d):
    return _rounded(E.success(_eval(spark, d), F.col("tm") >= 0.5, {"rmsd": "rmsd"}), [], ["n_pass", "pass_rate", "n", "rmsd"])


@query("AGG03", f"WITH {EVAL} SELECT split, CAST(sum(CASE WHEN tm >= 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS n_pass, {R('avg(CASE WHEN tm >= 0.8 THEN 1 ELSE 0 END)')} AS pass_rate, count(*) AS n, {R('avg(tm)')} AS tm, {R('avg(rmsd)')} AS rmsd FROM ev GROUP BY split")
def reconstruction_metrics(spark, d):
    return _rounded(E.success(_eval(spark, d), F.col("tm") >= 0.8, {"tm": "tm", "rmsd": "rmsd"}, ["split"]), ["split"], ["n_pass", "pass_rate", "n", "tm", "rmsd"])


@query("AGG04", f"WITH {EVAL} SELECT split, {R('avg(CASE WHEN rmsd <= 2.0 THEN 1 ELSE 0 END)')} AS pass_rate, count(*) AS n, {R('avg(plddt)')} AS plddt FROM ev GROUP BY split")
def inverse_folding_metrics(spark, d):
    return _rounded(E.success(_eval(spark, d), F.col("rmsd") <= 2.0, {"plddt": "plddt"}, ["split"]), ["split"], ["pass_rate", "n", "plddt"])


@query("AGG05 SET01", f"WITH {EVAL} SELECT 'a' AS model, len, {R('avg(plddt)')} AS plddt FROM ev WHERE idx = 1 GROUP BY len UNION ALL SELECT 'b', len, {R('avg(plddt)')} FROM ev WHERE idx = 2 GROUP BY len")
def plddt_by_length(spark, d):
    e = _eval(spark, d)
    one = lambda name, i: e.filter(F.col("idx") == i).groupBy("len").agg(r6(F.avg("plddt")).alias("plddt")).select(F.lit(name).alias("model"), "len", "plddt")
    return one("a", 1).unionByName(one("b", 2))


@query("AGG06", f"WITH {EVAL} SELECT len, {R('avg(v)')} AS diversity FROM (SELECT len, sample, avg(tm) AS v FROM ev GROUP BY ALL) GROUP BY len")
def diversity_mean_sim(spark, d):
    return E.two_level(_eval(spark, d), ["len", "sample"], ["len"], F.avg("tm"), "diversity").select("len", r6("diversity").alias("diversity"))


@query("AGG07", f"WITH {EVAL} SELECT len, {R('avg(v)')} AS novelty FROM (SELECT len, sample, max(tm) AS v FROM ev GROUP BY ALL) GROUP BY len")
def novelty_max_sim(spark, d):
    return E.two_level(_eval(spark, d), ["len", "sample"], ["len"], F.max("tm"), "novelty").select("len", r6("novelty").alias("novelty"))


@query("AGG08 JON05", f"WITH {EVAL}, h AS (SELECT len, split, count(*) AS n FROM ev WHERE rmsd < 0.5 AND tm > 0.95 GROUP BY ALL), k AS (SELECT DISTINCT len, split FROM ev) SELECT k.len, k.split, coalesce(h.n, 0) AS n FROM k LEFT JOIN h ON k.len = h.len AND k.split = h.split")
def success_rate_zero_fill(spark, d):
    e = _eval(spark, d)
    hits = e.filter("rmsd < 0.5 AND tm > 0.95").groupBy("len", "split").agg(F.count("*").alias("n"))
    return E.zero_filled(e, hits, ["len", "split"])


@query("AGG09 JON09", f"WITH {EVAL}, p AS (SELECT a.sample, avg(CASE WHEN a.tm > b.tm THEN 1.0 ELSE 0 END) AS m, max(abs(a.tm - b.tm)) AS x FROM ev a JOIN ev b ON a.sample = b.sample AND a.idx < b.idx GROUP BY a.sample) SELECT {R('avg(m)')} AS mean_mean, {R('avg(x)')} AS mean_max, count(*) AS n FROM p")
def sequence_consistency(spark, d):
    e = _eval(spark, d).select("sample", "idx", "tm")
    p = e.join(e.select("sample", F.col("idx").alias("j"), F.col("tm").alias("u")), "sample").filter("idx < j").groupBy("sample").agg(F.avg(F.when(F.col("tm") > F.col("u"), 1.0).otherwise(0.0)).alias("m"), F.max(F.abs(F.col("tm") - F.col("u"))).alias("x"))
    return p.agg(r6(F.avg("m")).alias("mean_mean"), r6(F.avg("x")).alias("mean_max"), F.count("*").alias("n"))


@query("AGG10", f"WITH {EVAL}, g AS (SELECT sample, arg_min(tm, (idx, tm)) AS first_tm, arg_min(tm, (rmsd, idx, tm)) AS best_tm FROM ev GROUP BY sample) SELECT {R('avg(CASE WHEN first_tm > 0.5 THEN 1 ELSE 0 END)')} AS first_rate, {R('avg(CASE WHEN best_tm > 0.5 THEN 1 ELSE 0 END)')} AS best_rate FROM g")
def designability_first_best(spark, d):
    g = _eval(spark, d).groupBy("sample").agg(F.min_by("tm", F.struct("idx", "tm")).alias("a"), F.min_by("tm", F.struct("rmsd", "idx", "tm")).alias("b"))
    return g.agg(r6(F.avg(F.when(F.col("a") > 0.5, 1).otherwise(0))).alias("first_rate"), r6(F.avg(F.when(F.col("b") > 0.5, 1).otherwise(0))).alias("best_rate"))


LETTERS = "c AS (SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(lower(text), '')) AS ch FROM documents) WHERE ch BETWEEN 'a' AND 'z' GROUP BY ALL), p AS (SELECT lang, ch, n / sum(n) OVER (PARTITION BY lang) AS p FROM c), q AS (SELECT ch, sum(n) / (SELECT sum(n) FROM c) AS q FROM c GROUP BY ch)"


def _letters(spark, d):
    rows = E.ngram_counts(table(spark, d, "documents").select("lang", F.lower("text").alias("text")), "lang", "text").withColumnRenamed("gram", "ch").filter(F.col("ch").between("a", "z"))
    return E.distribution(rows, "ch", ["lang"], "n"), E.distribution(rows, "ch", weight="n")


@query("AGG11", f"WITH {LETTERS} SELECT lang, {R('sqrt(greatest(2 - 2 * sum(sqrt(p * q)), 0))')} AS hellinger FROM p JOIN q ON p.ch = q.ch GROUP BY lang")
def composition_hellinger(spark, d):
    p, q = _letters(spark, d)
    return E.hellinger(p, q, "ch", ["lang"]).select("lang", r6("hellinger").alias("hellinger"))


@query("AGG12", f"WITH s AS (SELECT lang, string_split(lower(text), '') AS s FROM documents WHERE length(text) >= 2), g AS (SELECT lang, unnest(list_transform(list_zip(s[1:len(s) - 1], s[2:]), lambda x: x[1] || x[2])) AS gram FROM s), c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT lang, gram, n / sum(n) OVER (PARTITION BY lang) AS p FROM c), q AS (SELECT gram, p AS q FROM p WHERE lang = 'en') SELECT lang, {R('sum(p * ln(p / coalesce(q, 1e-5)))')} AS kl FROM p LEFT JOIN q ON p.gram = q.gram GROUP BY lang")
def ngram_kl(spark, d):
    rows = E.ngram_counts(table(spark, d, "documents").select("lang", F.lower("text").alias("text")), "lang", "text", 2)
    p = E.distribution(rows, "gram", ["lang"], "n")
    return E.kl_divergence(p, p.filter("lang = 'en'"), "gram", ["lang"]).select("lang", r6("kl").alias("kl"))


GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS k, unnest(list_transform(range(1, length(text) - {n - 2}), lambda i: substr(text, i, {n}))) AS gram FROM t" for n in (1, 2, 3, 4))


@query("AGG12", f"WITH t AS (SELECT lang, lower(text) AS text FROM documents), c AS (SELECT lang, k, gram, count(*) AS n FROM ({GRAMS}) GROUP BY ALL) SELECT lang, CAST(k AS INTEGER) AS k, count(*) AS grams, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY lang, k")
def ngram_orders(spark, d):
    """Runs of one to four code points of whole texts."""
    rows = table(spark, d, "documents").select("lang", F.lower("text").alias("text"))
    each = [E.ngram_counts(rows, "lang", "text", k).withColumn("k", F.lit(k)) for k in (1, 2, 3, 4)]
    counts = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    return counts.groupBy("lang", "k").agg(F.count("*").alias("grams"), F.sum("n").alias("total"), F.max("n").alias("most"))


@query("AGG13", f"WITH {EVAL} SELECT CAST(floor(tm / (1.001 / 4)) AS INTEGER) AS bin, {R('avg(rmsd)')} AS loss, count(*) AS n FROM ev GROUP BY 1")
def stratified_loss(spark, d):
    return E.stratified(_eval(spark, d), "tm", "rmsd").select("bin", r6("loss").alias("loss"), "n")


@query("AGG15", f"WITH {EVAL} SELECT split, {R('sum(CASE WHEN idx > 2 THEN tm ELSE 0 END) / nullif(sum(CASE WHEN idx > 2 THEN 1.0 ELSE 0 END), 0)')} AS masked_mean FROM ev GROUP BY split")
def masked_mean(spark, d):
    return E.masked_mean(_eval(spark, d), "tm", F.col("idx") > 2, ["split"]).select("split", r6("masked_mean").alias("masked_mean"))


@query("AGG16", f"WITH {EVAL} SELECT split, {R('quantile_disc(tm, 0.5)')} AS lower_median, {R('quantile_cont(tm, 0.5)')} AS median FROM ev GROUP BY split")
def median_recovery(spark, d):
    return _eval(spark, d).groupBy("split").agg(r6(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY tm)")).alias("lower_median"), r6(F.percentile("tm", F.lit(0.5))).alias("median"))


@query("AGG17", f"SELECT l_orderkey, {R('sum(l_quantity)')} AS sum, {R('avg(l_quantity)')} AS mean, {R('ln(product(l_quantity))')} AS log_product, {R('min(l_quantity)')} AS min, {R('max(l_quantity)')} AS max FROM lineitem GROUP BY l_orderkey")
def scatter_mean(spark, d):
    out = E.scatter(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")
    return out.select("l_orderkey", r6("sum").alias("sum"), r6("mean").alias("mean"), r6(F.log("product")).alias("log_product"), r6("min").alias("min"), r6("max").alias("max"))


@query("AGG22 ML03", f"WITH {EVAL}, r AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY tm) + (count(*) OVER (PARTITION BY split, tm) - 1) / 2 AS a, rank() OVER (PARTITION BY split ORDER BY rmsd) + (count(*) OVER (PARTITION BY split, rmsd) - 1) / 2 AS b FROM ev) SELECT split, {R('corr(a, b)')} AS spearman, count(*) AS n FROM r GROUP BY split")
def spearman_by_group(spark, d):
    return E.spearman(_eval(spark, d), "tm", "rmsd", ["split"]).select("split", r6("spearman").alias("spearman"), "n")


@query("AGG22", f"WITH {EVAL}, b AS (SELECT split, CAST(r AS INTEGER) AS rep, tm, CAST(floor(-ln(1 - CAST(('0x' || substr(md5(CAST(r AS VARCHAR) || ':' || CAST(sample AS VARCHAR) || '-' || CAST(idx AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS INTEGER) AS w FROM ev, range(5) t(r)), m AS (SELECT split, rep, sum(tm * w) / sum(w) AS m FROM b GROUP BY ALL) SELECT split, {R('avg(m)')} AS mean, {R('stddev_samp(m)')} AS std FROM m GROUP BY split")
def bootstrap_mean(spark, d):
    from helixmill.functions import hashing

    rows = _eval(spark, d).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4))))
    w = F.floor(-F.log(1 - hashing.uniform(F.col("rep"), F.concat(F.col("sample").cast("string"), F.lit("-"), F.col("idx").cast("string"))))).cast("int")
    m = rows.withColumn("w", w).groupBy("split", "rep").agg((F.sum(F.col("tm") * F.col("w")) / F.sum("w")).alias("m"))
    return m.groupBy("split").agg(r6(F.avg("m")).alias("mean"), r6(F.stddev_samp("m")).alias("std"))


@query("AGG19", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_min(event_type, (-n, event_type)) AS most FROM c GROUP BY user_id")
def majority_token(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("most"))


@query("JON08", f"WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT q.vec_id, {R('max(list_inner_product(q.e, v.e))')} AS best FROM v q JOIN v ON v.label = q.label AND v.vec_id <> q.vec_id GROUP BY q.vec_id")
def cross_set_similarity(spark, d):
    """The best similarity of every vector to another of its label."""
    v = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("point"))
    best = nearest.nearest(v.withColumnRenamed("id", "q"), v, 1, ["label"], "dot", others=True)
    return best.select(F.col("q").alias("vec_id"), r6("score").alias("best"))


@query("JON08", f"WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM p) SELECT q, CAST(rank AS INTEGER) AS rank, id, {R('d')} AS distance FROM r WHERE rank <= 5")
def nearest_in_group(spark, d):
    v = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("point"))
    return nearest.nearest(v.withColumnRenamed("id", "q"), v, 5, ["label"], others=True).select("q", "rank", "id", r6("score").alias("distance"))


def _labelled(spark, d):
    return nearest.folds(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"), F.col("label").cast("double").alias("y")), "id", 5, "cv")


@query(
    "ML02",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(label AS DOUBLE) AS y, CAST(floor({U('cv', 'vec_id')} * 5) AS INTEGER) AS fold FROM embeddings),
    p AS (SELECT a.vec_id AS q, a.fold, a.y, b.vec_id AS id, b.y AS z, list_distance(a.e, b.e) AS l2, list_sum(list_transform(list_zip(a.e, b.e), lambda t: abs(t[1] - t[2]))) AS l1 FROM v a JOIN v b ON a.fold <> b.fold),
    m AS (SELECT q, fold, y, id, z, 'l1' AS measure, l1 AS d FROM p UNION ALL SELECT q, fold, y, id, z, 'l2', l2 FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY measure, q ORDER BY d, id) AS rank FROM m),
    g AS (SELECT fold, q, any_value(y) AS y, measure, k, avg(z) AS uniform, sum(z / d) / sum(1 / d) AS distance FROM r JOIN (VALUES (5), (10)) s(k) ON rank <= k GROUP BY fold, q, measure, k),
    w AS (SELECT fold, y, measure, k, 'uniform' AS weights, uniform AS p FROM g UNION ALL SELECT fold, y, measure, k, 'distance', distance FROM g),
    f AS (SELECT measure, k, weights, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, count(*) AS n FROM w GROUP BY ALL)
    SELECT measure, k, weights, {R('avg(r2)')} AS r2, {R('stddev_pop(r2)')} AS r2_spread, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY measure, k, weights""",
)
def neighbour_grid(spark, d):
    """Grid over neighbours, distances and weights in five folds, by R squared."""
    predicted = nearest.neighbour_regression(_labelled(spark, d), 5, (5, 10), ("l1", "l2"))
    return nearest.r_squared(predicted, ["measure", "k", "weights"]).select("measure", "k", "weights", r6("r2").alias("r2"), r6("r2_spread").alias("r2_spread"), "n")


@query("ML02")
def forest_grid(spark, d):
    found = nearest.forest_search(_labelled(spark, d).withColumn("fold", F.col("fold") % 2), 2, trees=(8,), depths=(4,), least=(1, 4))
    return found.select("trees", "depth", "features", "least", r6("r2").alias("r2"), "n")


@query(
    "MET20",
    """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_distance(a.e, b.e) <= 0.5),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT v.vec_id, least(v.vec_id, min(r.b)) AS cluster FROM v LEFT JOIN r ON r.a = v.vec_id GROUP BY v.vec_id),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT c.vec_id, coalesce(n.n, 0) AS links, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM c LEFT JOIN n ON n.a = c.vec_id""",
)
def threshold_clusters(spark, d):
    """Vectors within a distance of each other, as connected groups."""
    return graph.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 0.5)


@query("AGG23", "SELECT event_type, count(DISTINCT user_id) AS users, true AS near, true AS same FROM events GROUP BY event_type")
def users_by_sketch(spark, d):
    """Distinct users by kind of event: day by day into stored sketches, against exact counts and one direct sketch."""
    events = table(spark, d, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    stored = sketches.sketched(events, ["event_type", "day"], "user_id")
    days = sketches.merged(stored, ["event_type"]).select("event_type", sketches.estimate("sketch").alias("days"))
    direct = sketches.sketched(events, ["event_type"], "user_id").select("event_type", sketches.estimate("sketch").alias("direct"))
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    rows = exact.join(days, "event_type").join(direct, "event_type")
    off = F.abs(F.col("days") - F.col("users"))
    return rows.select("event_type", "users", (off <= F.greatest(F.lit(1.0), F.col("users") * 0.03)).alias("near"), (F.abs(F.col("days") - F.col("direct")) <= 1 + F.col("users") * 0.01).alias("same"))


@query("ML01")
def pca_components(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("f"))
    out = PCA(k=8, inputCol="f", outputCol="p").fit(v).transform(v)
    return out.select("vec_id", F.transform(vector_to_array("p"), lambda x: r6(x)).alias("components"))


@query("ML02")
def forest_regression(spark, d):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    model = RandomForestRegressor(numTrees=8, maxDepth=4, seed=1).fit(v.filter("vec_id % 5 <> 0"))
    return model.transform(v.filter("vec_id % 5 = 0")).select("vec_id", r6("prediction").alias("prediction"))
