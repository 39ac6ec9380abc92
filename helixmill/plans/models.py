"""Model outputs and backbone geometry: scores of sequences, frames, chain means, merged metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from helixmill.functions import numeric, sequence
from helixmill.operators import evaluate as E
from helixmill.operators import geometry as G
from helixmill.operators.score import scored
from helixmill.plans.registry import MODELS, POINTS, R, models, points, query, r6, table

LETTERS = "ARNDCQEG"
#: Length, angle and torsion of an ideal beta carbon.
BETA = (1.522, 1.927, -2.143)


def _steps(spark, d):
    """Embeddings as eight rows of eight logits, with eight tokens."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(e, i * 8 + 1, F.lit(8))).alias("logits"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("vec_id") + i * 3) % 8).cast("int")).alias("tokens"),
    )


@query(
    "FN40",
    f"""WITH p AS (SELECT vec_id, i, k, CAST(embedding[8 * i + k + 1] AS DOUBLE) AS x FROM embeddings, range(8) a(i), range(8) b(k)), l AS (SELECT vec_id, i, k, x - ln(sum(exp(x)) OVER (PARTITION BY vec_id, i)) AS l FROM p),
    s AS (SELECT vec_id, avg(CASE WHEN i < 7 AND k = (vec_id + 3 * (i + 1)) % 8 THEN l END) AS f, avg(CASE WHEN i > 0 AND k = (vec_id + 3 * (i - 1)) % 8 THEN l END) AS b FROM l GROUP BY vec_id)
    SELECT vec_id, {R('f')} AS forward, {R('(f + b) / 2')} AS both FROM s""",
)
def sequence_likelihood(spark, d):
    rows = _steps(spark, d).withColumn("f", numeric.sequence_log_likelihood(F.col("logits"), F.col("tokens"), 0, 7)).withColumn("b", numeric.sequence_log_likelihood(F.reverse("logits"), F.reverse("tokens"), 0, 7))
    return rows.select("vec_id", r6("f").alias("forward"), r6(numeric.both_ways(F.col("f"), F.col("b"))).alias("both"))


@query("FN16", f"WITH t AS (SELECT vec_id, embedding, vec_id % 7 AS p, (vec_id + 3 * (vec_id % 7)) % 8 AS w, (vec_id + 5) % 8 AS m FROM embeddings) SELECT vec_id, {R('CAST(embedding[8 * (1 + p) + m + 1] AS DOUBLE) - CAST(embedding[8 * (1 + p) + w + 1] AS DOUBLE)')} AS score FROM t")
def mutation_effect(spark, d):
    letter = lambda i: F.substring(F.lit(LETTERS), i.cast("int") + 1, F.lit(1))
    place = F.col("vec_id") % 7
    rows = _steps(spark, d).withColumn("seq", F.array_join(F.transform("tokens", letter), ""))
    code = F.concat(letter((F.col("vec_id") + 3 * place) % 8), (place + 24).cast("string"), letter((F.col("vec_id") + 5) % 8))
    return rows.withColumn("code", code).select("vec_id", r6(sequence.mutation_score(F.col("seq"), F.col("code"), F.col("logits"), LETTERS, 24)).alias("score"))


@query("FN41", f"WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) * 4)) AS e FROM embeddings) SELECT vec_id, {R('list_sum(list_transform(e, lambda x, i: x / list_sum(e) * (i - 0.5) * 0.5))')} AS pae FROM t")
def predicted_aligned_error(spark, d):
    logits = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 4)
    return table(spark, d, "embeddings").select("vec_id", r6(numeric.predicted_error(logits)).alias("pae"))


@query("UDF7", f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n, {R('-length(text) * ln(20)')} AS score FROM documents WHERE text IS NOT NULL")
def injected_scorer(spark, d):
    """A uniform model over twenty letters, as a stand-in for a user's own."""

    def load():
        import pyarrow.compute as pc

        def model(batch):
            n = pc.cast(pc.utf8_length(batch.column(1)), "int64")
            return [n, pc.multiply(pc.cast(n, "double"), -math.log(20))]

        return model

    out = scored(table(spark, d, "documents").filter("text IS NOT NULL"), "uniform-20", load, ["doc_id", "text"], "n long, score double")
    return out.select("doc_id", "n", r6("score").alias("score"))


# SQL of vectors, as lists of three expressions.
def _sub(a, b):
    return [f"({x} - {y})" for x, y in zip(a, b)]


def _dot(a, b):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def _cross(a, b):
    return [f"({a[(i + 1) % 3]} * {b[(i + 2) % 3]} - {a[(i + 2) % 3]} * {b[(i + 1) % 3]})" for i in range(3)]


def _named(name):
    return [f"{name}{c}" for c in "xyz"]


def _as(vector, name):
    return ", ".join(f"{v} AS {n}" for v, n in zip(vector, _named(name)))


def _unit(v, eps):
    return [f"({x} / sqrt({_dot(v, v)} + {eps}))" for x in v]


def _torsion(a, b, c, d):
    u, v, w = _sub(b, a), _sub(c, b), _sub(d, c)
    return f"atan2(sqrt({_dot(v, v)}) * {_dot(u, _cross(v, w))}, {_dot(_cross(u, v), _cross(v, w))})"


#: Embeddings as seven residues of three backbone atoms.
BACKBONE = POINTS + ", bb AS (SELECT entry, CAST(idx // 3 AS INTEGER) AS res, " + ", ".join(f"max(CASE WHEN idx % 3 = {k} THEN {c} END) AS {a}{c}" for k, a in enumerate(("n", "a", "c")) for c in "xyz") + " FROM points GROUP BY ALL)"


def _backbone(spark, d):
    at = lambda k: F.array(*[F.max(F.when(F.col("idx") % 3 == k, F.col(c))) for c in "xyz"])
    return points(spark, d).groupBy("entry", F.expr("CAST(idx div 3 AS INT)").alias("res")).agg(at(0).alias("n"), at(1).alias("ca"), at(2).alias("c"))


def _list(name):
    return [F.get(F.col(name), F.lit(i)) for i in range(3)]


_N, _A, _C = _named("n"), _named("a"), _named("c")
_E, _T = _named("e"), _named("t")


@query(
    "FN38",
    f"WITH {BACKBONE}, f AS (SELECT entry, res, {_as(_unit(_sub(_C, _A), '1e-8'), 'e')}, {_as(_sub(_N, _A), 't')} FROM bb), g AS (SELECT *, {_as(_cross(_E, _T), 'u')} FROM f), "
    f"s AS (SELECT *, {_as(_unit(_named('u'), '1e-8'), 'v')} FROM g) SELECT entry, res, {', '.join(f'{R(x)} AS r{i}' for i, x in enumerate([*_E, *_cross(_named('v'), _E), *_named('v')]))} FROM s",
)
def rotation_frames(spark, d):
    rows = G.frame(_list("n"), _list("ca"), _list("c"))
    return _backbone(spark, d).select("entry", "res", *[r6(x).alias(f"r{3 * i + j}") for i, row in enumerate(rows) for j, x in enumerate(row)])


_B = _named("w")  # BY is a keyword
_COS, _SIN, _TURN = BETA[0] * math.cos(BETA[1]), BETA[0] * math.sin(BETA[1]) * math.cos(BETA[2]), BETA[0] * math.sin(BETA[1]) * math.sin(BETA[2])


@query(
    "FN36",
    f"WITH {BACKBONE}, f AS (SELECT *, {_as(_unit(_sub(_N, _A), '0'), 'w')}, {_as(_sub(_C, _N), 't')} FROM bb), g AS (SELECT *, {_dot(_B, _T)} AS k FROM f), h AS (SELECT *, {_as([f'({t} - k * {b})' for t, b in zip(_T, _B)], 'o')} FROM g), m AS (SELECT *, {_as(_unit(_named('o'), '0'), 'm')} FROM h) "
    f"SELECT entry, res, {', '.join(f'{R(f'{a} + {_COS!r} * {b} + {_SIN!r} * {m} + {_TURN!r} * {p}')} AS beta_{c}' for a, b, p, m, c in zip(_A, _B, _cross(_named('m'), _B), _named('m'), 'xyz'))} FROM m",
)
def ideal_beta(spark, d):
    beta = G.placed_atom(_list("c"), _list("n"), _list("ca"), *BETA)
    return _backbone(spark, d).select("entry", "res", *[r6(x).alias(f"beta_{c}") for x, c in zip(beta, "xyz")])


_BOND = (_sub(_A, _N), _sub(_C, _A))
_CB = [f"(-0.58273431 * {x} + 0.56802827 * {b} - 0.54067466 * {c} + {a})" for x, b, c, a in zip(_cross(*_BOND), *_BOND, _A)]
_P = {k: [f"{s}.{x}" for x in _named(k[0])] for k in ("n1", "a1", "b1", "a2", "b2") for s in ("p" if k[1] == "1" else "q",)}
_GAP = _sub(_P["b1"], _P["b2"])
_U, _V = _sub(_P["a1"], _P["b1"]), _sub(_P["b2"], _P["b1"])


@query(
    "FN37 FN36",
    f"WITH {BACKBONE}, r AS (SELECT *, {_as(_CB, 'b')} FROM bb) SELECT p.entry, p.res AS i, q.res AS j, {R(f'sqrt({_dot(_GAP, _GAP)})')} AS d, "
    f"{R(f'cos({_torsion(_P['a1'], _P['b1'], _P['b2'], _P['a2'])})')} AS omega, {R(f'cos({_torsion(_P['n1'], _P['a1'], _P['b1'], _P['b2'])})')} AS theta, {R(f'acos(greatest(-1, least(1, {_dot(_U, _V)} / sqrt({_dot(_U, _U)} * {_dot(_V, _V)}))))')} AS phi "
    f"FROM r p JOIN r q ON p.entry = q.entry AND p.res <> q.res AND sqrt({_dot(_GAP, _GAP)}) <= 3.0",
)
def pair_orientations(spark, d):
    """Angles as cosines: a torsion of half a turn may come out with either sign."""
    out = G.coordinates_6d(_backbone(spark, d).withColumnRenamed("res", "idx"), 3.0)
    return out.select("entry", "i", "j", r6("d").alias("d"), r6(F.cos("omega")).alias("omega"), r6(F.cos("theta")).alias("theta"), r6("phi").alias("phi"))


@query(
    "MET07",
    f"WITH {MODELS}, q AS (SELECT entry, CAST(idx // 7 AS INTEGER) AS chain, sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)) AS d FROM models), c AS (SELECT entry, chain, avg(1 / (1 + pow(d / greatest(1.24 * cbrt(CAST(4 AS DOUBLE)) - 1.8, 0.5), 2))) AS tm, sqrt(avg(d * d)) AS rmsd FROM q GROUP BY ALL) "
    f"SELECT entry, count(*) AS chains, {R('avg(tm)')} AS tm, {R('avg(rmsd)')} AS rmsd FROM c GROUP BY entry",
)
def chain_wise_scores(spark, d):
    """The superposed deviation has no SQL; tests hold it to arrays."""
    rows = models(spark, d).withColumn("chain", F.expr("CAST(idx div 7 AS INT)"))
    return G.chain_means(rows).select("entry", "chains", r6("tm").alias("tm"), r6("rmsd").alias("rmsd"))


_LEFT = "list_sum(list_transform({v}, lambda x, i: (x - b.e[i]) * (x - b.e[i])))"


@query(
    "FN31",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s1 AS (SELECT v.vec_id, arg_min(b.vec_id, (round({_LEFT.format(v='v.e')}, 9), b.vec_id)) AS c1 FROM v, v b WHERE b.vec_id < 16 GROUP BY v.vec_id),
    r1 AS (SELECT s1.vec_id, c1, list_transform(v.e, lambda x, i: x - b.e[i]) AS e FROM s1 JOIN v ON v.vec_id = s1.vec_id JOIN v b ON b.vec_id = c1),
    s2 AS (SELECT r1.vec_id, arg_min(b.vec_id, (round({_LEFT.format(v='r1.e')}, 9), b.vec_id)) AS c2, min({_LEFT.format(v='r1.e')}) AS d FROM r1, v b WHERE b.vec_id BETWEEN 16 AND 31 GROUP BY r1.vec_id)
    SELECT r1.vec_id, c1, c2, {R('d')} AS "left" FROM r1 JOIN s2 ON r1.vec_id = s2.vec_id""",
)
def residual_codes(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    book = lambda a, b: v.filter(F.col("vec_id").between(a, b)).select(F.col("vec_id").alias("code"), F.col("e").alias("centre"))
    out = E.quantised(v, "vec_id", "e", [book(0, 15), book(16, 31)])
    return out.select("vec_id", F.get("codes", F.lit(0)).alias("c1"), F.get("codes", F.lit(1)).alias("c2"), r6("left").alias("left"))


@query("JON01", f"SELECT a.l_orderkey, a.l_linenumber, {R('a.l_quantity / b.l_extendedprice')} AS ratio FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag = 'R' AND b.l_discount > 0.05")
def two_key_merge(spark, d):
    t = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return t.filter("l_returnflag = 'R'").select(*keys, "l_quantity").join(t.filter("l_discount > 0.05").select(*keys, "l_extendedprice"), keys).select(*keys, r6(F.col("l_quantity") / F.col("l_extendedprice")).alias("ratio"))


@query("AGG20", "WITH u AS (SELECT lang, doc_id AS a, NULL::BIGINT AS b FROM documents UNION ALL SELECT lang, NULL, CAST(n_chars AS BIGINT) FROM documents WHERE n_chars > 500) SELECT lang, count(a) AS n_a, count(b) AS n_b, CAST(coalesce(max(b), -1) AS BIGINT) AS top, min(a) AS first FROM u GROUP BY lang")
def merged_metrics(spark, d):
    docs = table(spark, d, "documents").filter("lang IS NOT NULL")
    out = E.merged([docs.select("lang", F.col("doc_id").alias("a")), docs.filter("n_chars > 500").select("lang", F.col("n_chars").cast("long").alias("b"))], ["lang"])
    return out.select("lang", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.coalesce(F.array_max("b"), F.lit(-1).cast("long")).alias("top"), F.get("a", F.lit(0)).alias("first"))
