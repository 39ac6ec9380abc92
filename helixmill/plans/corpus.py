"""Filters, projections, samples, windows and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import hashing, numeric, sequence
from helixmill.operators import corpus as C
from helixmill.operators import sampling as S
from helixmill.plans.registry import CORPUS, META, POINTS, R, U, corpus, meta, points, query, r6, table


@query(
    "FLT12 FLT13 JON03 WIN01 SMP01 FN01 AGG01",
    f"""WITH {CORPUS}, good AS (SELECT * FROM corpus WHERE seq IS NOT NULL AND length BETWEEN 20 AND 20000 AND (quality IS NULL OR quality > 0)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(quality, -1) DESC, length DESC, doc_id) AS rn FROM good) WHERE rn = 1)
    SELECT split, count(*) AS n, {R('avg(length)')} AS mean_length, {R('quantile_cont(length, 0.96)')} AS p96_length,
      CAST(sum(length('<seq>' || seq || '</seq><struct>')) AS BIGINT) AS prompt_chars FROM best GROUP BY split""",
)
def corpus_quality_filter(spark, d):
    good = corpus(spark, d).filter(F.col("seq").isNotNull() & F.col("length").between(20, 20000) & (F.col("quality").isNull() | (F.col("quality") > 0)))
    best = C.best_per(good, ["cluster"], [F.coalesce("quality", F.lit(-1)).desc(), F.desc("length"), F.asc("doc_id")])
    return best.groupBy("split").agg(F.count("*").alias("n"), r6(F.avg("length")).alias("mean_length"), r6(F.percentile("length", F.lit(0.96))).alias("p96_length"), F.sum(F.length(F.concat(F.lit("<seq>"), "seq", F.lit("</seq><struct>")))).alias("prompt_chars"))


@query(
    "FLT13 AGG21",
    f"""WITH {CORPUS} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN seq IS NULL THEN 'no_sequence' WHEN length < 100 THEN 'too_short' WHEN length > 10000 THEN 'too_long' WHEN quality = 0 THEN 'low_quality' WHEN toxic = 1 THEN 'toxic' END AS reason FROM corpus) GROUP BY reason""",
)
def reject_reasons(spark, d):
    rules = [("no_sequence", F.col("seq").isNull()), ("too_short", F.col("length") < 100), ("too_long", F.col("length") > 10000), ("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]
    return corpus(spark, d).select(C.reject_reason(rules).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "FLT01 FLT02 FLT04 FLT07 FLT15",
    f"""WITH {META} SELECT k, modeled_seq_len, split FROM meta WHERE split IN ('LARGE', 'SMALL', 'STANDARD') AND modeled_seq_len BETWEEN 5 AND 40 AND helix_percent < 0.9 AND coil_percent < 0.8 AND strand_percent > 0.1 AND lddt_ca IS NOT NULL AND lddt_ca > 0.2""",
)
def metadata_filter(spark, d):
    return C.metadata_scan(meta(spark, d), C.MetadataFilter(splits=("LARGE", "SMALL", "STANDARD"), min_len=5, max_len=40, max_helix=0.9, max_coil=0.8, min_strand=0.1, min_lddt=0.2), "k").select("k", "modeled_seq_len", "split")


@query(
    "FLT05 ML04",
    f"""WITH {META}, q AS (SELECT modeled_seq_len AS x, quantile_cont(radius_gyration, 0.9) AS q FROM meta GROUP BY 1), s AS (SELECT max(x) AS s FROM q), u AS (SELECT x, q, CAST(x AS DOUBLE) / s AS u FROM q, s),
    m AS (SELECT regr_slope(q, u) AS b, regr_intercept(q, u) AS a FROM u)
    SELECT k, modeled_seq_len FROM meta JOIN u ON modeled_seq_len = x, m WHERE radius_gyration < a + b * u + 0.1""",
)
def rog_curve_filter(spark, d):
    return C.below_quantile_curve(meta(spark, d), "modeled_seq_len", "radius_gyration", 0.9, degree=1).select("k", "modeled_seq_len")


@query("FLT05 ML04")
def rog_curve_degree4(spark, d):
    return C.below_quantile_curve(meta(spark, d), "modeled_seq_len", "radius_gyration", 0.96, degree=4).select("k", "modeled_seq_len")


CONF = "SELECT vec_id, list_transform(embedding, lambda x: round((CAST(x AS DOUBLE) + 1) * 50, 4)) AS conf FROM embeddings"


def _conf(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round((x + 1) * 50, 4)).alias("conf"))


PUBLISHED = META + ", pub AS (SELECT k, CASE k % 4 WHEN 0 THEN 'pdb' WHEN 1 THEN 'afdb_swissprot' ELSE 'other' END AS split, CASE WHEN k % 3 = 0 THEN 'monomeric' ELSE 'dimeric' END AS o, modeled_seq_len * 25 AS n FROM meta)"


@query(
    "FLT04b FLT01 FLT02",
    f"""WITH {PUBLISHED} SELECT k, CAST(n AS INTEGER) AS n, 'monomer_128' AS part, CAST(0 AS INTEGER) AS start FROM pub WHERE o = 'monomeric' AND n <= 128
    UNION ALL SELECT k, n, 'monomer_eval', 0 FROM pub WHERE o = 'monomeric' AND n <= 256
    UNION ALL SELECT k, n, 'swissprot_512', CASE WHEN n > 512 THEN CAST(floor({U('pub', 'k')} * (n - 511)) AS INTEGER) ELSE 0 END FROM pub WHERE split IN ('pdb', 'afdb_swissprot') AND n BETWEEN 60 AND 1024""",
)
def published_sets(spark, d):
    """Parts through the two published sets, without the radius curve, and the crops of the second."""
    from dataclasses import replace

    k = F.col("k")
    rows = meta(spark, d).select("k", F.when(k % 4 == 0, "pdb").when(k % 4 == 1, "afdb_swissprot").otherwise("other").alias("split"), F.when(k % 3 == 0, "monomeric").otherwise("dimeric").alias("oligomeric_detail"), (F.col("modeled_seq_len") * 25).alias("modeled_seq_len"))
    alone = replace(C.MONOMER_128, rog_quantile=None)
    n, wide = F.col("modeled_seq_len"), C.PDB_SWISSPROT_512
    cut = lambda df, name, start: df.select("k", n.alias("n"), F.lit(name).alias("part"), start.alias("start"))
    whole = F.lit(0)
    out = cut(C.metadata_scan(rows, alone, "k"), "monomer_128", whole).unionByName(cut(C.evaluation_scan(rows, alone, "k"), "monomer_eval", whole))
    return out.unionByName(cut(C.metadata_scan(rows, wide, "k"), "swissprot_512", S.window_start(n, k, "pub", wide.crop)))


@query(
    "FLT12",
    f"""WITH c AS ({CONF}) SELECT doc_id, n_chars FROM documents JOIN c ON vec_id = doc_id WHERE text IS NOT NULL AND n_chars <= 4000 AND (doc_id % 2 <> 0 OR (list_stddev_pop(conf) < 6.2 AND list_avg(conf) > 49.5))""",
)
def structure_corpus_quality(spark, d):
    """Documents with vectors as confidences, every other one predicted: even and high confidence is asked of these only."""
    rows = table(spark, d, "documents").select("doc_id", "text", "n_chars").join(_conf(spark, d).withColumnRenamed("vec_id", "doc_id"), "doc_id").withColumn("avg", numeric.mean(F.col("conf")))
    return C.corpus_quality(rows, "text", "n_chars", "conf", "avg", F.col("doc_id") % 2 == 0, 4000, 49.5, 6.2).select("doc_id", "n_chars")


@query("FLT06 TOP01 SRT01", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def subset_longest(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("FLT08 FLT18 JON05", "SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.quality > 0.7 AND l.toxic < 0.7")
def high_confidence(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").filter("quality IS NOT NULL AND quality > 0.7 AND toxic < 0.7").select("doc_id", "quality", "toxic")


@query("FLT09", f"WITH c AS ({CONF}) SELECT vec_id, CAST(len(list_filter(conf, lambda x: x > 55)) AS BIGINT) AS kept, {R('coalesce(list_sum(list_filter(conf, lambda x: x > 55)), 0)')} AS total FROM c")
def confidence_mask(spark, d):
    kept = F.filter(C.mask_below(F.col("conf"), F.col("conf"), 55), lambda x: x.isNotNull())
    return _conf(spark, d).select("vec_id", F.size(kept).cast("long").alias("kept"), r6(numeric.total(kept)).alias("total"))


@query(
    "FLT10 FLT11",
    f"""WITH c AS ({CONF}), t AS (SELECT vec_id, conf, list_position(list_transform(conf, lambda x: x > 58), true) AS a, len(conf) - list_position(list_reverse(list_transform(conf, lambda x: x > 58)), true) + 1 AS b FROM c)
    SELECT vec_id, CAST(a AS INTEGER) AS first, CAST(b AS INTEGER) AS last, CAST(CASE WHEN a IS NULL THEN 0 ELSE b - a + 1 END AS BIGINT) AS n, {R('CASE WHEN a IS NULL THEN NULL ELSE list_avg(conf[a:b]) END')} AS mean FROM t""",
)
def confidence_trim(spark, d):
    rows = _conf(spark, d).withColumn("span", C.trim_to(F.col("conf"), lambda x: x > 58)).withColumn("part", C.trimmed(F.col("conf"), F.col("span")))
    return rows.select("vec_id", "span.first", "span.last", F.size("part").cast("long").alias("n"), r6(F.when(F.size("part") > 0, numeric.mean(F.col("part")))).alias("mean"))


@query(
    "FLT11",
    f"""WITH t AS (SELECT doc_id, list_transform(string_split(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ''), lambda x: x <> '' AND contains('ARNDCQEGHILKMFPSTWYV', x)) AS k FROM documents),
    p AS (SELECT doc_id, len(k) AS n, list_position(k, true) AS a, len(k) - list_position(list_reverse(k), true) + 1 AS b FROM t)
    SELECT doc_id, CAST(a AS INTEGER) AS first, CAST(b AS INTEGER) AS last, CAST(CASE WHEN a IS NULL THEN 0 ELSE b - a + 1 END AS BIGINT) AS modeled FROM p""",
)
def modeled_trim(spark, d):
    """Documents as residues by index, cut to what lies between the first and the last known one."""
    index = F.transform(F.split(F.translate(F.coalesce("text", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ""), lambda x: F.when((x != "") & F.contains(F.lit(sequence.RESIDUES), x), F.instr(F.lit(sequence.RESIDUES), x) - 1).otherwise(20))
    rows = table(spark, d, "documents").select("doc_id", index.alias("aatype"))
    rows = rows.withColumn("span", C.trim_to(F.col("aatype"), lambda x: x != 20))
    return rows.select("doc_id", "span.first", "span.last", F.size(C.trimmed(F.col("aatype"), F.col("span"))).cast("long").alias("modeled"))


@query(
    "FLT12 SET01",
    f"""WITH c AS ({CONF}) SELECT vec_id, {R('list_stddev_pop(conf)')} AS spread, {R('list_avg(conf)')} AS mean FROM c WHERE list_stddev_pop(conf) < 6.2 AND list_avg(conf) > 49.5""",
)
def confidence_spread(spark, d):
    c = F.col("conf")
    return _conf(spark, d).filter((numeric.stddev_pop(c) < 6.2) & (numeric.mean(c) > 49.5)).select("vec_id", r6(numeric.stddev_pop(c)).alias("spread"), r6(numeric.mean(c)).alias("mean"))


@query("FLT13", r"SELECT doc_id, NOT regexp_matches(text, '[^A-Za-z .,\n]') AS ok FROM documents")
def alphabet_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", C.alphabet_ok(F.col("text"), r"A-Za-z .,\n").alias("ok"))


@query("FLT14", "SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR x IS NULL)) > 0 AS broken FROM embeddings")
def nan_filter(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: F.isnan(x) | x.isNull()).alias("broken"))


@query("FLT16 JON04", f"WITH {POINTS} SELECT entry, idx, {R('x')} AS x FROM points WHERE idx BETWEEN 3 AND 9 AND idx % 3 = 0 AND entry IN (SELECT vec_id FROM embeddings WHERE label = 1)")
def residue_range(spark, d):
    chosen = table(spark, d, "embeddings").filter("label = 1").select(F.col("vec_id").alias("entry"))
    return points(spark, d).filter("idx BETWEEN 3 AND 9 AND idx % 3 = 0").join(chosen, "entry", "left_semi").select("entry", "idx", r6("x").alias("x"))


@query("FLT17 SET02", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def purge_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("FLT19 AGG19", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS tok FROM documents), c AS (SELECT doc_id, tok, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS total, max(n) > sum(n) * 0.25 AS repetitive FROM c GROUP BY doc_id""")
def repetition_screen(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("tok"))
    counts = words.groupBy("doc_id", "tok").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.max("n").alias("most"), F.sum("n").alias("total")).withColumn("repetitive", F.col("most") > F.col("total") * 0.25)


@query("PRJ01", "SELECT doc_id, list_aggregate(list_transform(string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ''), lambda c: CASE WHEN position(c IN 'ARNDCQEGHILKMFPSTWYV') > 0 THEN c ELSE 'X' END), 'string_agg', '') AS seq FROM documents WHERE length(text) > 0")
def sequence_round_trip(spark, d):
    return table(spark, d, "documents").filter("length(text) > 0").select("doc_id", sequence.sequence_of(sequence.aatype(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("seq"))


@query("PRJ02", f"WITH {POINTS} SELECT entry, {R('coalesce(max(CASE WHEN idx = 4 AND x > 0 THEN x END), max(CASE WHEN idx = 1 THEN x END), 0)')} AS beta_x FROM points GROUP BY entry")
def imputed_beta(spark, d):
    at = lambda t: F.max(F.when(t, F.col("x")))
    return points(spark, d).groupBy("entry").agg(r6(F.coalesce(at((F.col("idx") == 4) & (F.col("x") > 0)), at(F.col("idx") == 1), F.lit(0.0))).alias("beta_x"))


@query("PRJ03", f"WITH {POINTS}, r AS (SELECT entry, CAST(idx // 3 AS INTEGER) AS res, avg(abs(x)) AS b FROM points GROUP BY ALL) SELECT entry, {R('CASE WHEN entry % 2 = 0 THEN avg(b) ELSE 0 END')} AS plddt FROM r GROUP BY entry")
def mean_plddt(spark, d):
    per = points(spark, d).groupBy("entry", F.expr("idx div 3").alias("res")).agg(F.avg(F.abs("x")).alias("b"))
    return per.groupBy("entry").agg(F.avg("b").alias("b")).select("entry", r6(F.when(F.col("entry") % 2 == 0, F.col("b")).otherwise(F.lit(0.0))).alias("plddt"))


@query("PRJ04 AGG18", f"WITH {POINTS} SELECT entry, idx, {R('(x - sum(x) OVER w / (count(x) OVER w + 1e-5)) * 0.1')} AS x_c, {R('(y - sum(y) OVER w / (count(y) OVER w + 1e-5)) * 0.1')} AS y_c, {R('(z - sum(z) OVER w / (count(z) OVER w + 1e-5)) * 0.1')} AS z_c FROM points WINDOW w AS (PARTITION BY entry)")
def centred_points(spark, d):
    return C.centred(points(spark, d), ["entry"], scale=0.1).select("entry", "idx", *[r6(f"{c}_c").alias(f"{c}_c") for c in "xyz"])


@query("PRJ05", "SELECT l_orderkey, l_linenumber, CAST(l_partkey - min(l_partkey) OVER (PARTITION BY l_orderkey) + 1 AS BIGINT) AS residue FROM lineitem")
def renumber_residues(spark, d):
    return C.renumbered(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey").select("l_orderkey", "l_linenumber", "residue")


@query("PRJ06", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'heteromer' ELSE 'homomer' END AS category, count(*) AS chains FROM orders GROUP BY o_custkey")
def quaternary_category(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.countDistinct("o_orderpriority") > 1, "heteromer").otherwise("homomer").alias("category"), F.count("*").alias("chains"))


@query("PRJ07", f"WITH {META} SELECT k, {R('1 - helix_percent - strand_percent')} AS loop_percent FROM meta")
def loop_percent(spark, d):
    return meta(spark, d).select("k", r6(1 - F.col("helix_percent") - F.col("strand_percent")).alias("loop_percent"))


@query("PRJ09 JON03", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(b.text, d.text) = d.text AS own FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def inherit_metadata(spark, d):
    docs, labels, bench = (table(spark, d, t) for t in ("documents", "labels", "benchmark"))
    out = docs.select("doc_id", "text").join(labels, "doc_id", "left").join(bench.select(F.col("item_id").alias("doc_id"), F.col("text").alias("b")), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), (F.coalesce("b", "text") == F.col("text")).alias("own"))


@query("PRJ10", "SELECT CAST(conv_id AS VARCHAR) || '@' || role AS entry, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id, role")
def split_by_chain(spark, d):
    return table(spark, d, "conversations").groupBy(F.concat_ws("@", F.col("conv_id").cast("string"), "role").alias("entry")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("PRJ11 FN44", "SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE -1 END AS code FROM documents")
def split_code(spark, d):
    codes = F.create_map(*[F.lit(x) for pair in {"en": 0, "de": 1, "fr": 2}.items() for x in pair])
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.element_at(codes, F.col("lang")), F.lit(-1)).alias("code"))


@query("SMP01 WIN01", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn = 1")
def cluster_sample_epoch(spark, d):
    return S.one_per_cluster(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query("SMP02", f"SELECT doc_id, CAST(CASE WHEN {U('7-keep', 'doc_id')} < 0.5 OR n_chars <= 60 THEN n_chars ELSE 60 + floor({U('7-len', 'doc_id')} * (n_chars - 60)) END AS INTEGER) AS crop FROM documents")
def length_crop(spark, d):
    return table(spark, d, "documents").select("doc_id", S.crop_length(F.col("n_chars"), F.col("doc_id"), 7).alias("crop"))


@query("SMP03", f"SELECT doc_id, substr(text, CAST(CASE WHEN n_chars - 512 + 1 > 0 THEN floor({U('11', 'doc_id')} * (n_chars - 512 + 1)) ELSE 0 END AS INTEGER) + 1, 512) AS part FROM documents")
def window_crop(spark, d):
    at = S.window_start(F.col("n_chars"), F.col("doc_id"), 11, 512)
    return table(spark, d, "documents").select("doc_id", F.substring("text", at + 1, F.lit(512)).alias("part"))


@query("SMP04", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('5:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 16")
def row_sample(spark, d):
    return S.sample_rows(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 5, 16)


@query("SMP05")
def msa_diverse_select(spark, d):
    return S.diverse_rows(table(spark, d, "documents").select("lang", "doc_id", F.col("text").alias("seq")), ["lang"], "doc_id", "seq", 16)


@query("SMP06", f"SELECT CASE WHEN {U('42', 'doc_id')} < 0.8 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM documents GROUP BY 1")
def hash_split(spark, d):
    return table(spark, d, "documents").groupBy(S.hash_split(F.col("doc_id"), 42, 0.8).alias("part")).agg(F.count("*").alias("n"))


@query("SMP07", "SELECT d.doc_id, d.lang FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id")
def index_subset(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query(
    "FN24 SMP06",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || CAST(doc_id AS VARCHAR)), doc_id) AS place, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN place <= floor(n * 0.3) THEN 'fold' WHEN place <= floor(n * 0.3) + floor(n * 0.25) THEN 'inverse' ELSE 'joint' END AS task FROM r""",
)
def task_mix_split(spark, d):
    return S.task_mix(table(spark, d, "documents").select("doc_id"), "doc_id", 9, {"fold": 0.3, "inverse": 0.25, "joint": 0.45})


@query("WIN02 AGG10", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def top_sample(spark, d):
    return C.best_per(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("WIN05", "WITH r AS (SELECT user_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run, event_id FROM (SELECT DISTINCT user_id, event_id FROM events)) SELECT user_id, min(event_id) AS start, max(event_id) AS \"end\", count(*) AS n FROM r GROUP BY user_id, run")
def gaps_islands(spark, d):
    return C.islands(table(spark, d, "events"), ["user_id"], "event_id")


@query("SRT02", "SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS number FROM customer")
def natural_sort(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).cast("long").alias("number")).orderBy("number", "c_custkey")


@query("SET01", "SELECT 'label' AS kind, doc_id AS id FROM labels UNION ALL SELECT 'bench', item_id FROM benchmark")
def union_frames(spark, d):
    return table(spark, d, "labels").select(F.lit("label").alias("kind"), F.col("doc_id").alias("id")).unionByName(table(spark, d, "benchmark").select(F.lit("bench").alias("kind"), F.col("item_id").alias("id")))


@query("SET02", "SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("k")).subtract(table(spark, d, "labels").select("doc_id"))


@query("SET03", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def keep_first(spark, d):
    return C.best_per(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.asc("event_id")])


@query("SET04", "SELECT doc_id AS k FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("k")).intersect(table(spark, d, "labels").select("doc_id"))


@query("SRC10", "WITH s AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1), e AS (SELECT l_orderkey, unnest(range(a, b + 1)) AS l_linenumber FROM s) SELECT e.l_orderkey, CAST(e.l_linenumber AS INTEGER) AS l_linenumber, l.l_quantity FROM e LEFT JOIN lineitem l ON e.l_orderkey = l.l_orderkey AND e.l_linenumber = l.l_linenumber AND l.l_linenumber <> 2")
def gap_fill(spark, d):
    return C.fill_range(table(spark, d, "lineitem").filter("l_linenumber <> 2").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_linenumber")


@query("SRC12", "SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) > 1 AS doubles FROM orders GROUP BY ALL")
def slot_doubles(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg((F.countDistinct("o_orderstatus") > 1).alias("doubles"))


@query("SRC14", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY o_custkey")
def atoms_by_residue(spark, d):
    wide = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    return wide.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SRC27 FN15", r"SELECT page_id, 'data/' || url AS path, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1) AS INTEGER) AS number FROM pages")
def key_from_path(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.concat_ws("/", F.lit("data"), url).alias("path"), F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1) AS int)").alias("number"))


@query("SRC33", "WITH t AS (SELECT source, greatest(max(length(text)) // 1000, 1) AS top FROM documents GROUP BY source), s AS (SELECT source, unnest(range(1, top + 1)) AS i FROM t) SELECT source, CAST(i AS INTEGER) AS step, CAST(1000 * i AS INTEGER) AS length, CAST(j AS INTEGER) AS copy, md5(repeat('A', CAST(1000 * i AS INTEGER))) AS digest FROM s, range(1, 41) b(j)")
def length_ladder(spark, d):
    """For every source, chains of one letter up to its longest document, forty of each length."""
    top = table(spark, d, "documents").groupBy("source").agg(F.max(F.length("text")).alias("top"))
    return S.length_ladder(top, "top", step=1000, copies=40).withColumn("digest", F.md5("seq")).drop("seq")


@query("SRC34", "WITH t AS (SELECT lang, unnest(range(min(length(text)), max(length(text)) + 1, 64)) AS l FROM documents GROUP BY lang) SELECT lang, CAST(l AS INTEGER) AS length, CAST(s AS INTEGER) AS sample FROM t, range(0, 10) b(s)")
def length_grid(spark, d):
    """Sampling jobs of every language: lengths from its shortest to its longest document, ten draws each."""
    ends = table(spark, d, "documents").groupBy("lang").agg(F.min(F.length("text")).alias("lo"), F.max(F.length("text")).alias("hi"))
    return S.length_grid(ends, "lo", "hi", every=64, samples=10)


@query("SRC28", "WITH e AS (SELECT event_id, user_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM events) SELECT user_id, CAST(section AS BIGINT) AS section, count(*) AS n FROM e GROUP BY ALL")
def section_flags(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w).alias("section")).groupBy("user_id", "section").agg(F.count("*").alias("n"))


@query("FN26", f"SELECT vec_id, CAST(list_position(g, list_max(g)) - 1 AS INTEGER) AS choice FROM (SELECT vec_id, list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * 5 - ln(-ln(CAST(('0x' || substr(md5('g:' || CAST(vec_id AS VARCHAR) || '-' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 * (1 - 2e-12) + 1e-12))) AS g FROM embeddings)")
def gumbel_choice(spark, d):
    logits = F.col("embedding").cast("array<double>")
    g = F.transform(logits, lambda x, i: x * 5 + hashing.gumbel("g", F.concat(F.col("vec_id").cast("string"), F.lit("-"), i.cast("string"))))
    return table(spark, d, "embeddings").select("vec_id", g.alias("g")).select("vec_id", (F.array_position("g", F.array_max("g")) - 1).cast("int").alias("choice"))
