"""Tokens, templates, masking, quantisers, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixmill.functions import hashing, numeric, sequence
from helixmill.operators import decoding, tokenizer
from helixmill.operators import evaluate as E
from helixmill.operators import sampling as S
from helixmill.plans.registry import R, U, query, r6, table

ESM_MAP = "map {" + ", ".join(f"'{t}': {i}" for i, t in enumerate(sequence.ESM_TOKENS)) + "}"
CHAR_MAP = "map {" + ", ".join(f"'{t}': {i}" for i, t in enumerate(sequence.CHAR_TOKENS)) + "}"
UP = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
CODES = "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 4096) AS INTEGER))"
IDS = f"list_transform(regexp_extract_all({UP}, '<[a-z_0-9]+>|[^\\s]'), lambda t: CAST(coalesce({ESM_MAP}[t], 3) AS INTEGER))"


def _letters(spark, d):
    up = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return table(spark, d, "documents").select("doc_id", up.alias("seq"))


def _codes(spark, d):
    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.transform(e, lambda x: F.floor((x + 1) * 4096).cast("int")).alias("codes"))


def _groups(spark, d, n):
    """Each vector's components, n at a time."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(64 // n - 1))).alias("k"))
    return rows.select("vec_id", "k", F.slice("embedding", F.col("k") * n + 1, F.lit(n)).alias("part"))


def _joined(ids):
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


J = "array_to_string({}, ',')"
ESM = tokenizer.Alphabet.preset("esm1b")


@query("FN06 FN07 FN08", f"SELECT doc_id, {J.format(f'list_concat([0], {IDS}, [2])')} AS ids FROM documents")
def esm_tokenize(spark, d):
    return _letters(spark, d).select("doc_id", F.array_join(ESM.encoded(F.col("seq"), unknown="unk").cast("array<string>"), ",").alias("ids"))


#: Residue letters of a text, spaced where it is; a letter that is no residue is masked.
SPELLED = r"regexp_replace(regexp_replace({}, '[^A-Z ]', '', 'g'), 'J', '<mask>', 'g')"


@query(
    "FN06 FN07",
    f"""WITH t AS (SELECT doc_id, {SPELLED.format(UP)} AS s FROM documents)
    SELECT doc_id, md5({J.format(f"list_concat([32], list_transform(regexp_extract_all(s, '<mask>|[A-Z]'), lambda t: CASE WHEN t = '<mask>' THEN 33 ELSE {ESM_MAP}[t] END))")}) AS digest FROM t""",
)
def ordered_tokenize(spark, d):
    """Ordered splits that fail on an unknown token, with the marks of the first preset."""
    spelled = F.regexp_replace(F.regexp_replace("seq", "[^A-Z ]", ""), "J", "<mask>")
    return _letters(spark, d).select("doc_id", F.md5(F.array_join(tokenizer.Alphabet.preset("ESM-1").encoded(spelled).cast("array<string>"), ",")).alias("digest"))


@query(
    "FN09 SRC20",
    f"""WITH t AS (SELECT label, vec_id, {CODES} AS c FROM embeddings), a AS (SELECT label, count(*) AS depth FROM t GROUP BY label)
    SELECT vec_id, label, {J.format(f"list_concat([0], list_transform(c, lambda x: {ESM_MAP}[substr('ARNDCQEGHILKMFPSTWYV', x % 20 + 1, 1)]))")} AS ids, CAST(65 AS INTEGER) AS width, depth FROM t JOIN a USING (label)""",
)
def alignment_ids(spark, d):
    """Vectors of a label as rows of an alignment."""
    rows = _codes(spark, d).withColumn("seq", sequence.sequence_of(F.transform("codes", lambda c: c % 20))).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return tokenizer.Alphabet.preset("msa").matrices(rows, "label", "seq").select("vec_id", "label", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "width", "depth")


#: Token arrays of a vector: padding, begin, 20 residues, 44 codes, end; each vector lacks something by its id.
PART = "list_transform(embedding[{}:{}], lambda x: CAST({} + CAST(floor(abs(CAST(x AS DOUBLE)) * 10000) AS BIGINT) % {} AS BIGINT))"
GRAMMAR = decoding.Grammar(1, 0, 2, 3, 4, 5, 6, tuple(range(10, 35)), tuple(range(100, 150)))
TOKENS = f"""SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 15 WHEN vec_id % 11 = 1 THEN 25 ELSE 20 END AS sl, CASE WHEN vec_id % 13 = 2 THEN 30 ELSE 44 END AS cl,
  list_concat(list_transform(range(vec_id % 3), lambda i: 1), [0, 3], {PART.format(1, 20, 10, 25)}, CASE WHEN vec_id % 7 = 1 THEN [] WHEN vec_id % 7 = 2 THEN [99, 4] ELSE [4] END,
    CASE WHEN vec_id % 7 = 5 THEN [60, 12] ELSE [] END, [5], {PART.format(21, 64, 100, 50)}, CASE WHEN vec_id % 7 = 3 THEN [6] WHEN vec_id % 7 = 4 THEN [] ELSE [6, 2] END, list_transform(range(vec_id % 2), lambda i: 1)) AS tok FROM embeddings"""


@query(
    "FN28",
    f"""WITH RECURSIVE t AS ({TOKENS}), k AS (
      SELECT vec_id, sl, cl, list_transform(tok, lambda x: CASE x WHEN 1 THEN 'pad' WHEN 0 THEN 'bos' WHEN 2 THEN 'eos' WHEN 3 THEN 'boseq' WHEN 4 THEN 'eoseq' WHEN 5 THEN 'bostruct' WHEN 6 THEN 'eostruct' ELSE CASE WHEN x BETWEEN 10 AND 34 THEN 'seq' WHEN x BETWEEN 100 AND 149 THEN 'struct' ELSE 'other' END END) AS ks FROM t
    ), r AS (
      SELECT vec_id, sl, cl, ks, 0 AS i, 'initial' AS s, 'none' AS l, 0 AS a, 0 AS b, CAST(NULL AS INTEGER) AS e, CAST(NULL AS INTEGER) AS f,
        CAST('bos' AS VARCHAR) AS may FROM k
      UNION ALL
      SELECT vec_id, sl, cl, ks, i, s, l, a, b, e, f, CASE s WHEN 'initial' THEN 'bos' WHEN 'text' THEN CASE WHEN l = 'eostruct' THEN 'eos' ELSE 'any' END WHEN 'seq' THEN CASE WHEN a = sl THEN 'eoseq' ELSE 'seq' END WHEN 'struct' THEN CASE WHEN b = cl THEN 'eostruct' ELSE 'struct' END WHEN 'terminal' THEN 'pad' ELSE 'none' END FROM (
        SELECT vec_id, sl, cl, ks, i + 1 AS i, ks[i + 1] AS l,
          CASE WHEN s = 'initial' AND ks[i + 1] = 'pad' THEN 'initial' WHEN s = 'initial' AND ks[i + 1] = 'bos' THEN 'text' WHEN s = 'text' AND ks[i + 1] = 'boseq' THEN 'seq' WHEN s = 'text' AND ks[i + 1] = 'bostruct' THEN 'struct'
            WHEN s = 'text' AND ks[i + 1] = 'eos' THEN 'terminal' WHEN s IN ('text', 'terminal') THEN s WHEN s = 'seq' AND ks[i + 1] = 'seq' AND a < sl THEN 'seq' WHEN s = 'struct' AND ks[i + 1] = 'struct' AND b < cl THEN 'struct'
            WHEN s = 'seq' AND ks[i + 1] = 'eoseq' THEN 'text' WHEN s = 'struct' AND ks[i + 1] = 'eostruct' THEN 'text' ELSE 'error' END AS s,
          CASE WHEN s = 'seq' AND ks[i + 1] = 'seq' THEN a + 1 WHEN s = 'seq' AND ks[i + 1] = 'eoseq' THEN 0 ELSE a END AS a,
          CASE WHEN s = 'struct' AND ks[i + 1] = 'struct' THEN b + 1 WHEN s = 'struct' AND ks[i + 1] = 'eostruct' THEN 0 ELSE b END AS b,
          CASE WHEN NOT ((s IN ('text', 'terminal')) OR (s = 'initial' AND ks[i + 1] IN ('pad', 'bos')) OR (s = 'seq' AND (ks[i + 1] = 'eoseq' OR ks[i + 1] = 'seq' AND a < sl)) OR (s = 'struct' AND (ks[i + 1] = 'eostruct' OR ks[i + 1] = 'struct' AND b < cl))) THEN i ELSE e END AS e,
          CASE WHEN f IS NULL AND may <> 'any' AND may <> ks[i + 1] THEN i ELSE f END AS f
        FROM r WHERE i < len(ks) AND s <> 'error')
    )
    SELECT vec_id, s AS state, may AS allowed, e AS error_at, f AS forbidden_at, a AS n_seq, b AS n_struct FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY i DESC) = 1""",
)
def constrained_decoding(spark, d):
    """Token arrays of vectors, with what each lacks, through the transition table."""
    part = lambda a, n, first, most: F.transform(F.slice("e", a, n), lambda x: F.floor(F.abs(x) * 10000) % most + first)
    longs = lambda *x: F.array(*[F.lit(i).cast("long") for i in x]) if x else F.array().cast("array<bigint>")
    by = F.col("vec_id") % 7
    tokens = F.concat(
        F.array_repeat(F.lit(1).cast("long"), (F.col("vec_id") % 3).cast("int")), longs(0, 3), part(1, 20, 10, 25), F.when(by == 1, longs()).when(by == 2, longs(99, 4)).otherwise(longs(4)),
        F.when(by == 5, longs(60, 12)).otherwise(longs()), longs(5), part(21, 44, 100, 50), F.when(by == 3, longs(6)).when(by == 4, longs()).otherwise(longs(6, 2)), F.array_repeat(F.lit(1).cast("long"), (F.col("vec_id") % 2).cast("int")),
    )
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    of = F.col("vec_id") % 11
    rows = rows.select("vec_id", tokens.alias("tokens"), F.when(of == 0, 15).when(of == 1, 25).otherwise(20).alias("seq_length"), F.when(F.col("vec_id") % 13 == 2, 30).otherwise(44).alias("struct_length"))
    return decoding.trace(rows, GRAMMAR, "vec_id")


@query("FN05", f"SELECT doc_id, coalesce({J.format(f'list_filter(list_transform(string_split({UP}, {chr(39)*2}), lambda c: {CHAR_MAP}[c]), lambda i: i IS NOT NULL)')}, '') AS ids FROM documents")
def char_tokenize(spark, d):
    return _letters(spark, d).select("doc_id", _joined(sequence.char_ids(F.col("seq"))).alias("ids"))


@query(
    "FN01 FN02 FN04 FN12",
    f"""SELECT vec_id, '<seq>' || array_to_string(list_transform({CODES}, lambda c: substr('ARNDCQEGHILKMFPSTWYV', c % 20 + 1, 1)), ' ') || '</seq><struct>' || array_to_string(list_transform({CODES}, lambda c: '<|s' || lpad(CAST(c AS VARCHAR), 4, '0') || '|>'), '') || '</struct>' AS text,
    array_to_string(list_transform({CODES}, lambda c: lpad(CAST(c AS VARCHAR), 4, '0')), ',') AS codes FROM embeddings""",
)
def train_template(spark, d):
    rows = _codes(spark, d).withColumn("seq", sequence.sequence_of(F.transform("codes", lambda c: c % 20)))
    return rows.select("vec_id", sequence.train_text(F.col("seq"), F.col("codes")).alias("text"), sequence.codes_text(F.col("codes")).alias("codes"))


@query("FN03 FN12", f"SELECT vec_id, CAST(list_sum({CODES}) AS BIGINT) AS total, CAST(len({CODES}) AS INTEGER) AS n FROM embeddings")
def parse_struct_codes(spark, d):
    parsed = sequence.struct_codes(sequence.train_text(F.lit("A"), F.col("codes")))
    return _codes(spark, d).select("vec_id", parsed.alias("p")).select("vec_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, c: a + c).alias("total"), F.size("p").alias("n"))


@query("COL01 COL02 COL05 FN08", f"WITH t AS (SELECT vec_id, list_filter({CODES}, lambda x: x % 2 = 0) AS c FROM embeddings) SELECT vec_id, {J.format('list_concat(c, list_transform(range(64 - len(c)), lambda i: 1))')} AS input_ids, {J.format('list_concat(c, list_transform(range(64 - len(c)), lambda i: -100))')} AS labels, CAST(len(c) AS INTEGER) AS attended FROM t")
def padded_labels(spark, d):
    even = F.filter("codes", lambda c: c % 2 == 0)  # of each vector's codes, so lengths differ
    return _codes(spark, d).select("vec_id", even.alias("c")).select("vec_id", _joined(sequence.padded(F.col("c"), F.lit(64), sequence.PAD)).alias("input_ids"), _joined(sequence.padded(F.col("c"), F.lit(64), sequence.IGNORE)).alias("labels"), F.size("c").alias("attended"))


@query("FN11", f"WITH t AS (SELECT vec_id, {CODES} AS c FROM embeddings) SELECT vec_id, CAST(len(list_filter(c, lambda x: x % 66 < 33)) AS INTEGER) AS residues, CAST(len(list_filter(c, lambda x: x % 66 >= 33)) AS INTEGER) AS structure FROM t")
def modality_counts(spark, d):
    kinds = F.transform("codes", lambda c: sequence.modality(c % 66))
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    return _codes(spark, d).select("vec_id", count(1).alias("residues"), count(0).alias("structure"))


@query("FN13", r"SELECT conv_id, turn, translate(regexp_replace(regexp_replace('<cls>' || text || '<eos>', '<[^>]*>', '', 'g'), '\s', '', 'g'), 'X', 'G') AS text FROM conversations")
def decode_residues(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sequence.residues_only(F.concat(F.lit("<cls>"), "text", F.lit("<eos>"))).alias("text"))


@query("FN14", "WITH t AS (SELECT page_id, url, least(CASE WHEN position('1' IN substr(url, 2)) > 0 THEN position('1' IN substr(url, 2)) + 1 END, CASE WHEN position('2' IN substr(url, 2)) > 0 THEN position('2' IN substr(url, 2)) + 1 END) AS pos FROM pages) SELECT page_id, CASE WHEN pos IS NULL THEN url ELSE substr(url, 1, pos) END AS cut FROM t")
def truncate_sample(spark, d):
    return table(spark, d, "pages").select("page_id", sequence.truncated(F.col("url")).alias("cut"))


@query("FN16", "WITH m AS (SELECT vec_id, substr('ARNDCQEGHILKMFPSTWYV', CAST(vec_id % 20 AS INTEGER) + 1, 1) || CAST(vec_id % 9 + 1 AS VARCHAR) || 'W' AS code FROM embeddings) SELECT vec_id, regexp_extract(code, '^([A-Z])([0-9]+)([A-Z])$', 1) AS wild, CAST(regexp_extract(code, '^([A-Z])([0-9]+)([A-Z])$', 2) AS INTEGER) AS place, regexp_extract(code, '^([A-Z])([0-9]+)([A-Z])$', 3) AS mutant FROM m")
def mutation_parse(spark, d):
    code = F.concat(F.substring(F.lit(sequence.RESIDUES), (F.col("vec_id") % 20).cast("int") + 1, F.lit(1)), (F.col("vec_id") % 9 + 1).cast("string"), F.lit("W"))
    return table(spark, d, "embeddings").select("vec_id", sequence.mutation(code).alias("m")).select("vec_id", "m.wild", "m.place", "m.mutant")


@query("FN18", "WITH s AS (SELECT event_id, user_id, value, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN nxt IS NOT NULL AND event_id + 5 > nxt THEN 1 ELSE 0 END) AS BIGINT) AS overlaps FROM s GROUP BY user_id")
def interval_overlaps(spark, d):
    from pyspark.sql import Window

    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select("user_id", F.when(F.coalesce(F.col("event_id") + 5 > nxt, F.lit(False)), 1).otherwise(0).alias("o"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("o").alias("overlaps"))


@query("FN19 FN20", f"SELECT doc_id, repeat('#', 10 + CAST(floor({U('sp', 'doc_id')} * 20) AS INTEGER)) || text || repeat('#', 5) AS scaffold FROM documents")
def inpaint_template(spark, d):
    lead = 10 + F.floor(hashing.uniform("sp", F.col("doc_id")) * 20).cast("int")
    return table(spark, d, "documents").select("doc_id", sequence.fill_template(lead + F.length("text") + 5, lead + 1, F.col("text")).alias("scaffold"))


@query(
    "FN21",
    f"""WITH t AS (SELECT doc_id, text AS s, CAST(floor({U('op', 'doc_id')} * length(text)) AS INTEGER) AS p, {U('kind', 'doc_id')} AS k FROM documents)
    SELECT doc_id, CASE WHEN length(s) = 0 THEN '@' WHEN k < 0.6 THEN substr(s, 1, p) || '@' || substr(s, p + 2) WHEN k < 0.8 THEN substr(s, 1, p) || substr(s, p + 2) ELSE substr(s, 1, p) || '@' || substr(s, p + 1) END AS mutated FROM t""",
)
def mutate_sequence(spark, d):
    """One change a text; an empty one can only get an insertion."""
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("s"))
    p, k, s = hashing.below("op", F.col("doc_id"), F.length("s")), hashing.uniform("kind", F.col("doc_id")), F.col("s")
    return rows.select("doc_id", F.when(F.length(s) == 0, F.lit("@")).when(k < 0.6, sequence.substitute(s, p, F.lit("@"))).when(k < 0.8, sequence.delete(s, p)).otherwise(sequence.insert(s, p, F.lit("@"))).alias("mutated"))


def _draw(kind):
    return f"(CAST(('0x' || substr(md5('13-{kind}:' || CAST(vec_id AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0)"


@query(
    "FN22",
    f"""WITH t AS (SELECT vec_id, {CODES} AS c FROM embeddings), m AS (SELECT vec_id, c, list_transform(c, lambda x, i: {_draw('pick')} < 0.15 AND x NOT IN (0, 1, 2)) AS hit, list_transform(c, lambda x, i: CASE WHEN {_draw('how')} < 0.8 THEN 32 WHEN {_draw('how')} < 0.9 THEN CAST(floor({_draw('id')} * 33) AS INTEGER) ELSE x END) AS new FROM t)
    SELECT vec_id, array_to_string(list_transform(c, lambda x, i: CASE WHEN hit[i] THEN new[i] ELSE x END), ',') AS input, array_to_string(list_transform(c, lambda x, i: CASE WHEN hit[i] THEN x ELSE -100 END), ',') AS label FROM m""",
)
def mlm_mask_811(spark, d):
    rows = _codes(spark, d).select("vec_id", S.masked_811(F.col("codes"), F.col("vec_id"), 13, sequence.MASK, 33, (0, 1, 2)).alias("m"))
    return rows.select("vec_id", _joined(F.transform("m", lambda x: x["input"])).alias("input"), _joined(F.transform("m", lambda x: x["label"])).alias("label"))


@query(
    "FN23 FN25",
    f"""WITH t AS (SELECT vec_id, {CODES} AS c, CAST(vec_id % 10 + 1 AS DOUBLE) / 10 AS t FROM embeddings)
    SELECT vec_id, array_to_string(list_transform(c, lambda x, i: CASE WHEN {_draw('x').replace('13-x', '17')} < t AND x NOT IN (0, 1, 2) THEN 32 ELSE x END), ',') AS noised, {R('1 - t')} AS weight FROM t""",
)
def absorbing_noise(spark, d):
    t = (F.col("vec_id") % 10 + 1).cast("double") / 10
    return _codes(spark, d).select("vec_id", _joined(S.absorbed(F.col("codes"), F.col("vec_id"), 17, t, sequence.MASK, (0, 1, 2))).alias("noised"), r6(1 - t).alias("weight"))


@query("FN27 FN40", "WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) * 32)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p, CAST(vec_id % 64 AS INTEGER) AS o FROM t) " f"SELECT vec_id, {R('CASE WHEN p[o + 1] > 0.7 THEN 0.7 ELSE p[o + 1] END')} AS kept, {R('CASE WHEN p[o + 1] > 0.7 THEN list_max(list_filter(p, lambda x: x <> p[o + 1])) / (1 - p[o + 1]) * 0.3 ELSE list_max(list_filter(p, lambda x: x <> p[o + 1])) END')} AS rest, {R('-ln(p[o + 1])')} AS nll FROM p")
def explore_ratio(spark, d):
    logits = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 32)
    old = (F.col("vec_id") % 64).cast("int")
    rows = table(spark, d, "embeddings").select("vec_id", old.alias("o"), numeric.redistribute(numeric.softmax(logits), old, 0.3).alias("p"), numeric.cross_entropy(logits, old).alias("nll"))
    return rows.select("vec_id", r6(F.get("p", F.col("o"))).alias("kept"), r6(F.array_max(F.filter("p", lambda x, i: i != F.col("o")))).alias("rest"), r6("nll").alias("nll"))


@query("FN28", "SELECT vec_id, vec_id % 3 <> 0 AS valid FROM embeddings")
def grammar_check(spark, d):
    body = F.concat(F.array(F.lit("<seq>"), F.lit("A"), F.lit("</seq>"), F.lit("<struct>")), F.transform("codes", sequence.struct_token))
    tokens = F.when(F.col("vec_id") % 3 == 0, F.concat(body, F.array(F.lit("A"), F.lit("</struct>"), F.lit("<eos>")))).otherwise(F.concat(body, F.array(F.lit("</struct>"), F.lit("<eos>"))))
    return _codes(spark, d).select("vec_id", sequence.grammatical(tokens).alias("valid"))


@query("FN29", "WITH t AS (SELECT vec_id, CAST(floor((CAST(embedding[j] AS DOUBLE) + 1) * 4096) AS BIGINT) % 200 AS i, j FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings)) SELECT vec_id, CAST(j - 1 AS INTEGER) AS place, i AS code, CAST(i % 8 AS INTEGER) AS d0, CAST(i // 8 % 5 AS INTEGER) AS d1, CAST(i // 40 % 5 AS INTEGER) AS d2, i AS back, round((i % 8 - 4) / CAST(4 AS DOUBLE), 6) + 0.0 AS c0 FROM t")
def fsq_roundtrip(spark, d):
    """Every component's code to digits and back."""
    levels = (8, 5, 5)
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "v")).withColumn("code", F.floor((F.col("v").cast("double") + 1) * 4096) % 200)
    rows = rows.select("vec_id", "place", "code", numeric.fsq_levels(F.col("code"), levels).alias("g"))
    return rows.select("vec_id", "place", "code", *[F.get("g", F.lit(i)).alias(f"d{i}") for i in range(3)], numeric.fsq_index(F.col("g"), levels).alias("back"), r6(F.get(numeric.fsq_codes(F.col("g"), levels), F.lit(0))).alias("c0"))


@query("FN29", "WITH z AS (SELECT vec_id, k, list_transform(embedding[3 * k + 1:3 * k + 3], lambda x: CAST(x AS DOUBLE) * 10) AS z FROM embeddings, range(21) t(k)) SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(round_even(tanh(z[1] + atanh(0.5 / (7 * 1.001 / 2))) * (7 * 1.001 / 2) - 0.5, 0) + 4 AS INTEGER) AS a, CAST(round_even(tanh(z[2]) * (4 * 1.001 / 2), 0) + 2 AS INTEGER) AS b, CAST(round_even(tanh(z[3]) * (4 * 1.001 / 2), 0) + 2 AS INTEGER) AS c FROM z")
def fsq_quantize(spark, d):
    z = F.transform(F.slice(F.col("embedding").cast("array<double>"), F.col("k") * 3 + 1, F.lit(3)), lambda x: x * 10)
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    return rows.select("vec_id", "k", numeric.fsq_quantise(z, (8, 5, 5)).alias("q")).select("vec_id", "k", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query("FN30", "WITH t AS (SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(list_sum(list_transform(embedding[16 * k + 1:16 * k + 16], lambda x, i: CASE WHEN x > 0 THEN 1 << (16 - i) ELSE 0 END)) AS BIGINT) AS code FROM embeddings, range(4) r(k)) SELECT vec_id, k, code, CAST(bit_count(code) AS INTEGER) AS ones FROM t")
def lfq_bits(spark, d):
    rows = _groups(spark, d, 16).select("vec_id", "k", numeric.lfq(F.col("part")).alias("code"))
    return rows.select("vec_id", "k", "code", F.aggregate(numeric.index_to_bits(F.col("code"), 16), F.lit(0), lambda a, b: a + b).alias("ones"))


@query("AGG14", f"WITH c AS (SELECT CAST(list_sum(list_transform(embedding[8 * k + 1:8 * k + 8], lambda x, i: CASE WHEN x > 0 THEN 1 << (8 - i) ELSE 0 END)) AS BIGINT) AS code, count(*) AS n FROM embeddings, range(8) r(k) GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT {R('exp(-sum(p * ln(p + 1e-10)))')} AS perplexity, {R('count(*) / 256')} AS usage FROM p")
def codebook_perplexity(spark, d):
    out = E.codebook_usage(_groups(spark, d, 8).select(numeric.lfq(F.col("part")).alias("code")), "code", 256)
    return out.select(r6("perplexity").alias("perplexity"), r6("usage").alias("usage"))


@query(
    "FN31",
    f"""WITH b AS (SELECT vec_id AS c, embedding AS e FROM embeddings WHERE vec_id < 16), s AS (SELECT v.vec_id, b.c, list_sum(list_transform(v.embedding, lambda x, i: (CAST(x AS DOUBLE) - CAST(b.e[i] AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(b.e[i] AS DOUBLE)))) AS dist FROM embeddings v, b)
    SELECT vec_id, arg_min(c, (round(dist, 9), c)) AS code, {R('min(dist)')} AS dist FROM s GROUP BY vec_id""",
)
def nearest_codeword(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    book = v.filter("vec_id < 16").select(F.col("vec_id").alias("c"), F.col("e").alias("b"))
    near = v.crossJoin(F.broadcast(book)).withColumn("dist", numeric.total(F.zip_with("e", "b", lambda x, y: (x - y) * (x - y))))  # 16 codewords
    return near.groupBy("vec_id").agg(F.min_by("c", F.struct(F.round("dist", 9), F.col("c"))).alias("code"), r6(F.min("dist")).alias("dist"))


@query("FN33", "SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(63, ceil((l_quantity - 2.3125) / ((21.6875 - 2.3125) / 62)))) AS INTEGER) AS bin FROM lineitem")
def distogram_bins(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.bin_index(F.col("l_quantity"), 2.3125, 21.6875, 64).alias("bin"))


@query("FN34 FN35", f"SELECT event_id, {R('exp(-pow((value / 10 - 0.001) / (22.0 - 0.001) * 16, 2))')} AS first, {R('sin(event_id * pi())')} AS sine FROM events")
def radial_and_sinusoid(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", r6(F.get(numeric.rbf(F.col("value") / 10, 0.001, 22.0, 16), F.lit(0))).alias("first"), r6(F.get(numeric.sinusoid(F.col("event_id"), 8), F.lit(0))).alias("sine"))


@query(
    "FN20",
    f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents), g AS (SELECT doc_id, w, list_transform(range(len(w) - 1), lambda i: i % 3 + CAST(floor((CAST(('0x' || substr(md5('motif:' || CAST(doc_id AS VARCHAR) || '-' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0) * 6) AS INTEGER)) AS g FROM t)
    SELECT doc_id, CAST(coalesce(list_sum(g), 0) AS BIGINT) AS masks, md5(array_to_string(list_transform(w, lambda s, i: CASE WHEN i = 1 THEN s ELSE repeat('#', g[i - 1]) || s END), '')) AS digest FROM g""",
)
def motif_assembly(spark, d):
    """Every word of a document as a motif, with spacers between them drawn from an interval of their own."""
    rows = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), " ", -1).alias("w"))
    gaps = sequence.spacers(F.size("w"), lambda i: (i % 3).cast("int"), lambda i: (i % 3 + 5).cast("int"), "motif", F.col("doc_id"))
    return rows.withColumn("g", gaps).select("doc_id", F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x).alias("masks"), F.md5(sequence.assembled(F.col("w"), F.col("g"), "#")).alias("digest"))


#: A joint vocabulary: marks and residues, then marks and structure codes.
JOINT = ["<pad>", "<cls_aa>", "<eos_aa>", "<unk_aa>", "<mask_aa>", *sequence.RESIDUES, "<cls_struct>", "<eos_struct>", "<unk_struct>", "<mask_struct>", *(f"{i:04d}" for i in range(4096))]


@query(
    "FN10",
    f"""WITH s AS (SELECT vec_id, list_transform({CODES}, lambda c: CASE WHEN c < 4096 THEN c + 29 ELSE 27 END) AS s FROM embeddings)
    SELECT vec_id, CAST(len(s) + 2 AS INTEGER) AS n, CAST(len(list_filter(s, lambda x: x = 27)) AS INTEGER) AS unknown, array_to_string([25] || s || [26], ',') AS ids FROM s""",
)
def joint_structure_ids(spark, d):
    """Structure codes of a joint vocabulary that knows half of them."""
    rows = _codes(spark, d).select("vec_id", F.transform("codes", lambda c: F.lpad(c.cast("string"), 4, "0")).alias("t"))
    ids = rows.select("vec_id", tokenizer.modal_ids(JOINT, "struct")("t").alias("ids"))
    return ids.select("vec_id", F.size("ids").alias("n"), F.size(F.filter("ids", lambda x: x == 27)).alias("unknown"), F.array_join("ids", ",").alias("ids"))


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'"


@query(
    "FN39",
    f"""WITH t AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + 60 * (user_id % 100) AS n FROM events)
    SELECT event_id, CAST(n AS BIGINT) AS number, CASE WHEN n < 62 THEN substr({LETTERS}, n + 1, 1) WHEN n < 3906 THEN substr({LETTERS}, n // 62, 1) || substr({LETTERS}, n % 62 + 1, 1)
      ELSE substr({LETTERS}, (n // 62 - 1) // 62, 1) || substr({LETTERS}, (n // 62 - 1) % 62 + 1, 1) || substr({LETTERS}, n % 62 + 1, 1) END AS name, CAST(n AS BIGINT) AS back FROM t""",
)
def chain_codec(spark, d):
    """Events as chains of their user: numbers to names and back."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select("event_id", (place - 1 + 60 * (F.col("user_id") % 100)).cast("long").alias("number"))
    named = rows.withColumn("name", sequence.chain_name(F.col("number")))
    return named.withColumn("back", sequence.chain_number(F.col("name")).cast("long"))


@query("FN41", f"WITH t AS (SELECT vec_id, list_transform(embedding[1:50], lambda x: exp(CAST(x AS DOUBLE) * 4)) AS e FROM embeddings) SELECT vec_id, {R('list_sum(list_transform(e, lambda x, i: x / list_sum(e) * (0.01 + (i - 1) * 0.02)))')} AS plddt FROM t")
def expected_plddt(spark, d):
    logits = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 50), lambda x: x * 4)
    return table(spark, d, "embeddings").select("vec_id", r6(numeric.expected_bin(logits, 0.01, 0.02)).alias("plddt"))


@query("FN41", f"WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) * 4)) AS e FROM embeddings) SELECT vec_id, {R('list_sum(list_transform(e, lambda x, i: x / list_sum(e) / (1 + pow((i - 0.5) * (31.0 / 62) / (1.24 * cbrt(CAST(100 - 15 AS DOUBLE)) - 1.8), 2))))')} AS ptm FROM t")
def predicted_tm(spark, d):
    logits = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 4)
    return table(spark, d, "embeddings").select("vec_id", r6(numeric.predicted_tm(logits, F.lit(100))).alias("ptm"))


@query("FN42", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type")
def json_fields(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("FN43", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n, CAST(max(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS INTEGER) AS last_day FROM orders GROUP BY ALL")
def date_parts(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy(F.year(at).alias("y"), F.month(at).alias("m")).agg(F.count("*").alias("n"), F.max(F.datediff(at, F.lit("1992-01-01").cast("date"))).alias("last_day"))


@query("WIN07", "WITH t AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings), e AS (SELECT vec_id, i, exp(CAST(x AS DOUBLE) * 8) AS e FROM t), p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e), c AS (SELECT vec_id, i, p, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p AS before FROM p) SELECT vec_id, count(*) FILTER (before <= 0.8) AS kept FROM c GROUP BY vec_id")
def top_p_filter(spark, d):
    logits = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 8)
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter(numeric.top_k_top_p(logits, p=0.8), lambda x: x.isNotNull())).cast("long").alias("kept"))


@query("WIN08", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x < list_sort(embedding)[11])) AS INTEGER) AS masked FROM embeddings")
def lowest_k_mask(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter(numeric.lowest_mask(F.col("embedding"), 10), lambda x: x)).alias("masked"))


@query("ML05", f"SELECT conv_id, CAST(count(*) AS BIGINT) AS n, {R('avg(length(text))')} AS pooled FROM conversations WHERE turn >= 1 GROUP BY conv_id")
def mean_pooling(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").cast("double").alias("x")))).alias("r"))  # one conversation's turns
    kept = F.filter("r", lambda s: s["turn"] >= 1)
    vectors = F.transform(kept, lambda s: F.array(s["x"]))
    return rows.filter(F.size(kept) > 0).select("conv_id", F.size(kept).cast("long").alias("n"), r6(F.get(numeric.mean_pool(vectors, 0, F.size(vectors)), F.lit(0))).alias("pooled"))


@query("FN15", "SELECT p_partkey, regexp_extract('PDB_name_' || p_brand || '_L=' || CAST(p_size AS VARCHAR), '^PDB_name_(.*)_L=([0-9]+)$', 1) AS name, p_size AS length FROM part")
def header_fields(spark, d):
    h = F.concat(F.lit("PDB_name_"), "p_brand", F.lit("_L="), F.col("p_size").cast("string"))
    part = lambda i: F.regexp_extract(h, "^PDB_name_(.*)_L=([0-9]+)$", i)
    return table(spark, d, "part").select("p_partkey", part(1).alias("name"), part(2).cast("int").alias("length"))


@query("FN09 SRC19 SRC20", r"SELECT doc_id, regexp_replace(text, '[a-z.*]', '', 'g') AS aligned, upper(regexp_replace(regexp_replace(text, '-', '', 'g'), '[^A-Za-z]', '', 'g')) AS letters FROM documents")
def a3m_clean(spark, d):
    s = F.col("text")
    return table(spark, d, "documents").select("doc_id", sequence.without_insertions(s).alias("aligned"), F.upper(F.regexp_replace(sequence.clean_alignment(s, keep_gaps=False), "[^A-Za-z]", "")).alias("letters"))


@query("FN17", f"WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: 1 / (1 + exp(-CAST(x AS DOUBLE)))) AS p FROM embeddings) SELECT vec_id, {R('list_sum(list_transform(p, lambda x: ln(x)))')} AS pppl FROM t")
def pseudo_perplexity(spark, d):
    p = F.transform(F.col("embedding").cast("array<double>"), lambda x: 1 / (1 + F.exp(-x)))
    return table(spark, d, "embeddings").select("vec_id", r6(numeric.total(F.transform(p, lambda x: F.log(x)))).alias("pppl"))


@query("MET12", f"WITH t AS (SELECT label, unnest(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS p FROM embeddings) SELECT label, {R('exp(avg(-ln(p + 1e-5)))')} AS perplexity FROM t GROUP BY label")
def clipped_perplexity(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return rows.groupBy("label").agg(r6(F.exp(F.avg(numeric.clipped_nll(F.abs("x"))))).alias("perplexity"))
