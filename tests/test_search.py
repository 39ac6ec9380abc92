"""Tokenizers, the decoding table, clusters, chain assignment, buffered batches, sketches and keyed streams against brute force."""

import collections
import hashlib
import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.operators import batching, chains, decoding, evaluate, graph, sketches, tokenizer
from helixmill.streaming import keyed

# --- tokenizers


def ids_of(spark, alphabet, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", alphabet.encoded(F.col("t"), **kw).alias("x")).orderBy("i").collect()]


def test_golden_ids(spark):
    """Published ids of the preset with begin and end marks."""
    a = tokenizer.Alphabet.preset("ESM-1b")
    rows = spark.createDataFrame([(0, "MKTVRQG"), (0, "KALTA<mask>ISQP"), (0, "K A <mask> I S Q"), (1, "MKTVRQGMKTVRQG")], "b int, t string").repartition(1)
    got = {r.t: r.ids for r in a.batches(rows, "b", "t", truncate=10).collect()}
    assert got["MKTVRQG"] == [0, 20, 15, 11, 7, 10, 16, 6, 2, 1, 1, 1]
    assert got["KALTA<mask>ISQP"] == [0, 15, 5, 4, 11, 5, 32, 12, 8, 16, 14, 2]
    assert got["K A <mask> I S Q"] == [0, 15, 5, 32, 12, 8, 16, 2, 1, 1, 1, 1]
    assert got["MKTVRQGMKTVRQG"] == [0, 20, 15, 11, 7, 10, 16, 6, 20, 15, 11, 2]


def test_presets():
    size = {n: len(tokenizer.Alphabet.preset(n).tokens) for n in ("esm1", "esm1b", "msa", "gvp")}
    assert size == {"esm1": 35, "esm1b": 33, "msa": 33, "gvp": 35}
    assert tokenizer.Alphabet.preset("esm1").tokens[31:] == ("<null_1>", "<cls>", "<mask>", "<sep>")
    assert tokenizer.Alphabet.preset("some_invariant_gvp_model").id_of("<cath>") == 33 and tokenizer.Alphabet.preset("esm1b").id_of("?") == 3
    with pytest.raises(ValueError):
        tokenizer.Alphabet.preset("none")


def test_ordered_splits():
    a = tokenizer.Alphabet(("ab", "b", "abc", "<x>"), ("<pad>", "<eos>", "<unk>"), ("<cls>", "b c"))
    # "ab" goes before "abc", which therefore never is a token; white space beside a token goes with it.
    assert a.split("abc b  <x>\tabq r") == ["ab", "c", "b", "<x>", "ab", "q", "r"]
    assert a.split("  ") == [] and a.split("") == [] and a.split("ab") == ["ab"]


@pytest.mark.parametrize("name", ["esm1b", "esm1"])
def test_unknown_tokens(spark, name):
    a = tokenizer.Alphabet.preset(name)
    with pytest.raises(Exception, match="unknown token: ab"):
        ids_of(spark, a, ["MK", "K ab L"])
    with pytest.raises(Exception, match="unknown token: é"):
        ids_of(spark, a, ["é"])
    assert ids_of(spark, a, [None, "", " \n", "K K"])[1:] == ids_of(spark, a, ["", "", "KK"]) and ids_of(spark, a, [None]) == [None]
    k, unk, mask = a.id_of("K"), 3, a.id_of("<mask>")
    inner = [x[1 : len(x) - (1 if a.end else 0)] for x in ids_of(spark, a, ["KaK é𝄞", "<mask>?K", "a<", "K"], unknown="unk")]
    assert inner == [[k, unk, k, unk, unk], [mask, unk, k], [unk, unk], [k]]


def test_fast_and_slow_paths_agree(spark):
    rnd = random.Random(3)
    a = tokenizer.Alphabet.preset("msa")
    texts = ["".join(rnd.choice([*a.standard, " ", "\n", "<mask>", "<eos>"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    assert ids_of(spark, a, texts) == [[0, *(a.index[t] for t in a.split(x))] for x in texts]


def test_matrices(spark):
    a = tokenizer.Alphabet.preset("msa")
    rows = spark.createDataFrame([("x", 0, "KK-L"), ("x", 1, "K--L"), ("y", 0, "KK")], "k string, b int, t string")
    got = {(r.k, r.t): (r.ids, r.depth, r.width) for r in a.matrices(rows.withColumn("b", F.lit(0)), "k", "t", batch="b").collect()}
    assert got[("y", "KK")] == ([0, 15, 15, 1, 1], 2, 5) and got[("x", "K--L")] == ([0, 15, 30, 30, 4], 2, 5)
    with pytest.raises(Exception, match="unequal lengths in x"):
        a.matrices(spark.createDataFrame([("x", "KK"), ("x", "K")], "k string, t string"), "k", "t").collect()


# --- decoding

G = decoding.Grammar(1, 0, 2, 3, 4, 5, 6, (10, 11), (20, 21))


def walk(tokens, ns, nt):
    """The table, a token at a time."""
    kind = {i: k for k, i in zip(decoding.KINDS, G.marks())} | {10: "seq", 11: "seq", 20: "struct", 21: "struct"}
    state, last, n, error, forbidden = "initial", None, {"seq": 0, "struct": 0}, None, None

    def allowed():
        if state == "text":
            return "eos" if last == "eostruct" else "any"
        if state in n:
            return {"seq": "eoseq", "struct": "eostruct"}[state] if n[state] == {"seq": ns, "struct": nt}[state] else state
        return {"initial": "bos", "terminal": "pad", "error": "none"}[state]

    for t, token in enumerate(tokens):
        k = kind.get(token, "other")
        if forbidden is None and allowed() not in ("any", k):
            forbidden = t
        was, state = state, decoding.MOVES.get((state, k), state if state in decoding.STAYING else "error")
        if was in n and k == was:
            n[was] += 1
            state = "error" if n[was] > {"seq": ns, "struct": nt}[was] else state
        elif was in n and state == "text":
            n = {"seq": 0, "struct": 0}
        last = k
        if state == "error":
            error = t
            break
    return state, allowed(), error, forbidden, n["seq"], n["struct"]


def test_traces(spark):
    rnd = random.Random(1)
    good = [1, 0, 3, 10, 11, 4, 5, 20, 21, 6, 2, 1]
    rows = [(0, good, 2, 2), (1, [], 2, 2), (2, None, 2, 2), (3, good, 1, 2), (4, good, 3, 2), (5, good, None, 2), (6, [0, -5, 999, 3, 10], 2, 2), (7, [0, 2, 2, 1], 2, 2)]
    for i in range(8, 200):
        t = list(good) if i % 2 else [rnd.choice([0, 1, 2, 3, 4, 5, 6, 10, 20, 99]) for _ in range(rnd.randint(0, 15))]
        for _ in range(rnd.randint(0, 2)):
            t.insert(rnd.randrange(len(t) + 1), rnd.choice([2, 4, 6, 10, 20, 99]))
        rows.append((i, t, rnd.randint(0, 3), rnd.randint(0, 3)))
    df = spark.createDataFrame(rows, "i int, tokens array<int>, seq_length int, struct_length int")
    got = {r.i: tuple(r)[1:] for r in decoding.trace(df, G, "i").collect()}
    assert got == {i: walk(t or [], a or 0, b or 0) for i, t, a, b in rows}
    assert got[0] == ("terminal", "pad", None, 0, 0, 0)  # padding before the beginning is a move, though not allowed


def test_masked_logits(spark):
    df = spark.createDataFrame([(i, a, [float(x) for x in range(25)]) for i, a in enumerate(decoding.ALLOWED)], "i int, allowed string, logits array<double>")
    got = {r.allowed: [k for k, x in enumerate(r.x) if x > -math.inf] for r in df.select("allowed", decoding.constrained(F.col("logits"), F.col("allowed"), G, 25).alias("x")).collect()}
    assert got["any"] == list(range(25)) and got["none"] == [] and got["seq"] == [10, 11] and got["struct"] == [20, 21] and got["eoseq"] == [4] and got["pad"] == [1] and got["bos"] == [0]
    with pytest.raises(ValueError):
        decoding.Grammar(1, 0, 2, 3, 4, 5, 6, (10,), (10,))


# --- clusters


@pytest.mark.parametrize("block", [4, 512])
def test_clusters(spark, block):
    rng = np.random.default_rng(block)
    at = np.cumsum(rng.normal(size=(150, 3)) * np.where(np.arange(150) % 9 == 0, 3.0, 0.4)[:, None], axis=0)
    rows = [(200 - i, [float(x) for x in v]) for i, v in enumerate(at)] + [(300, [float(x) for x in at[4]]), (301, None), (302, [1.0, None, 2.0]), (303, [float("nan")] * 3)]
    near = [[j for j, (_, w) in enumerate(rows) if i != j and i < 151 and j < 151 and math.dist(rows[i][1], w) <= 1.0] for i in range(len(rows))]
    got = {r.k: (r.links, r.cluster, r.size) for r in graph.clusters(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 1.0, block).collect()}
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[k] == (len(near[i]), min(rows[j][0] for j in seen), len(seen))


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(rnd.randrange(300, 340), rnd.randrange(300, 340)) for _ in range(25)] + [(5, 5), (9, 8), (9, 8)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- chains


def turned(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def complexes(seed, entries=4):
    """(pred rows, true rows): copies of two entities, predicted in another order, turned and moved, with noise."""
    rng = np.random.default_rng(seed)
    pred, true = [], []
    for e in range(entries):
        shape = {0: rng.normal(size=(6, 3)) * 2, 1: rng.normal(size=(9, 3)) * 2}
        r, s = turned(rng), rng.normal(size=3) * 20
        for entity, copies in ((0, 3), (1, 2 + e % 2)):
            names = [f"{'AB'[entity]}{k}" for k in range(copies)]
            order = rng.permutation(copies)
            for k in range(copies):
                at = shape[entity] @ turned(rng).T + rng.normal(size=3) * 12
                true += [(e, names[k], entity, i, *map(float, x)) for i, x in enumerate(at)]
                moved = at @ r.T + s + rng.normal(size=at.shape) * 0.05
                pred += [(e, names[order[k]], entity, i, *map(float, x)) for i, x in enumerate(moved)]
    return pred, true


ROWS = "entry int, chain string, entity int, idx int, x double, y double, z double"


def by_chain(rows, e):
    out = collections.defaultdict(list)
    for r in sorted(rows):
        if r[0] == e:
            out[r[1], r[2]].append(r[4:])
    return {k: np.array(v) for k, v in out.items()}


def lddt_of(pred, true, m):
    kept = total = 0
    names = sorted(true)
    for x, a in enumerate(names):
        for b in names[x:]:
            t = np.linalg.norm(true[a][:, None] - true[b][None], axis=2)
            p = np.linalg.norm(pred[m[a]][:, None] - pred[m[b]][None], axis=2)
            use = (t < 15) & (np.triu(np.ones_like(t), 1) > 0 if a == b else True)
            kept += sum(((np.abs(t - p) < h) & use).sum() for h in chains.THRESHOLDS) / 4
            total += use.sum()
    return kept / total


def every_order(pred, true):
    by = collections.defaultdict(lambda: ([], []))
    for k in sorted(true):
        by[k[1]][0].append(k)
    for k in sorted(pred):
        by[k[1]][1].append(k)
    for c in itertools.product(*[itertools.permutations(p, len(t)) for t, p in by.values()]):
        yield {a: b for (t, _), o in zip(by.values(), c) for a, b in zip(t, o)}


@pytest.mark.parametrize("exact", [chains.EXACT, 1])
def test_assignment(spark, exact):
    """All orders, or annealing, against brute force over all orders of up to six chains."""
    pred, true = complexes(2)
    parts = chains.contributions(spark.createDataFrame(pred, ROWS), spark.createDataFrame(true, ROWS))
    got = chains.assigned(parts, exact=exact).collect()
    for e in range(4):
        p, t = by_chain(pred, e), by_chain(true, e)
        best = max(lddt_of(p, t, m) for m in every_order(p, t))
        mine = [r for r in got if r.entry == e]
        assert len({r.pred for r in mine}) == len(mine) == len(t) and all(r.exact == (exact > 1) for r in mine)
        assert abs(mine[0].lddt - best) < 1e-9
        kinds = dict(t)
        assert abs(lddt_of(p, t, {k: next(q for q in p if q[0] == r.pred) for r in mine for k in kinds if k[0] == r.true}) - best) < 1e-9


def test_assignment_of_too_few_chains(spark):
    pred, true = complexes(3, 1)
    few = [r for r in pred if r[1] != "A0"]
    assert chains.assigned(chains.contributions(spark.createDataFrame(few, ROWS), spark.createDataFrame(true, ROWS))).count() == 0


def laid(fixed, moving):
    c, d = fixed.mean(axis=0), moving.mean(axis=0)
    u, _, vt = np.linalg.svd((fixed - c).T @ (moving - d))
    u[:, 2] *= np.sign(np.linalg.det(u @ vt))
    r = u @ vt
    return lambda x: (x - d) @ r.T + c


def test_anchored(spark):
    """Against brute force over all anchors; with little noise the true order comes out."""
    pred, true = complexes(5, 5)
    got = chains.anchored(spark.createDataFrame(pred, ROWS), spark.createDataFrame(true, ROWS)).collect()
    for e in range(5):
        p, t = by_chain(pred, e), by_chain(true, e)
        copies = collections.Counter(k[1] for k in t)
        entity = min(copies, key=lambda x: (copies[x], -max(len(t[k]) for k in t if k[1] == x), x))
        first = min(k for k in t if k[1] == entity)
        tried = []
        for a in sorted(k for k in p if k[1] == entity):
            move, free, pairs, apart = laid(t[first], p[a]), set(p), [], []
            for k in sorted(t, key=lambda k: (-len(t[k]), k[0])):
                near = sorted((((move(p[q]).mean(axis=0) - t[k].mean(axis=0)) ** 2).sum(), q) for q in free if q[1] == k[1])
                if near:
                    free.discard(near[0][1])
                    pairs.append((k[0], near[0][1][0]))
                    apart.append(near[0][0])
            tried.append((-len(pairs), round(float(np.mean(apart)), 9), a[0], sorted(pairs)))
        best = min(tried)
        assert sorted((r.true, r.pred) for r in got if r.entry == e) == best[3] and {r.anchor for r in got if r.entry == e} == {best[2]}


def test_symmetric_atoms_identity_first(spark):
    points = [(1, 0, "PHE", a, x, 0.0, 0.0, px, 0.0, 0.0) for a, x, px in (("CA", 0.0, 0.0), ("CD1", 1.0, 2.0), ("CD2", 2.0, 1.0))] + [(1, 1, "ALA", "CA", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    points += [(1, 2, "PHE", a, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0) for a in ("CD1", "CD2")]
    df = spark.createDataFrame(points, "entry int, idx int, resname string, atom string, x double, y double, z double, px double, py double, pz double")
    orders = spark.createDataFrame([("PHE", 1, "CD1", "CD2"), ("PHE", 1, "CD2", "CD1")], "resname string, perm int, atom string, renamed string")
    assert sorted(tuple(r) for r in chains.symmetric(df, orders).collect()) == [(1, 0, 1, 0.0), (1, 1, 0, 1.0), (1, 2, 0, 0.0)]


# --- batches


def brute_buffered(rows, most, replicas, buffer, seed, epoch, shuffle, drop_last):
    h = lambda s, k: hashlib.md5(f"{s}:{k}".encode()).hexdigest()
    order = sorted(rows, key=lambda r: (h(f"{seed}-order", r[0]) if shuffle else "", r[0]))
    made = {}
    for rep in range(replicas):
        mine = [(i + 1, r) for i, r in enumerate(order) if i % replicas == rep]
        heap, held, batches, batch, size = [], 0, [], [], 0

        def take():
            nonlocal held, batch, size
            n, _, k = heapq.heappop(heap)
            held -= n
            if batch and size + n > most:
                batches.append(batch)
                batch, size = [], 0
            batch.append(k)
            size += n

        for place, (k, n) in mine:
            heapq.heappush(heap, (n, place, k))
            held += n
            if held > most * buffer:
                take()
        while heap:
            take()
        if batch and not drop_last:
            batches.append(batch)
        made[rep] = batches
    longest = max(map(len, made.values()))
    out = []
    for rep, batches in made.items():
        turn = sorted(range(len(batches)), key=lambda b: (h(f"{seed}-{epoch}-batch", f"{rep}-{b}") if shuffle else "", b))
        for step in range(min(longest, 2 * len(batches))):
            b = turn[step % len(batches)]
            out += [(k, rep, b, i, step) for i, k in enumerate(batches[b])]
    return sorted(out)


@pytest.mark.parametrize("replicas,buffer,shuffle,drop_last", [(1, 2, True, False), (3, 1, True, True), (2, 100, False, False)])
def test_buffered_batches(spark, replicas, buffer, shuffle, drop_last):
    rnd = random.Random(replicas)
    rows = [(i, rnd.choice([1, 5, 20, 60, 99, 150])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, n int").repartition(5)
    got = batching.buffered_batches(df, "k", "n", 100, replicas, buffer, 7, 2, shuffle, drop_last)
    assert sorted((r.k, r.replica, r.batch, r.place, r.step) for r in got.collect()) == brute_buffered(rows, 100, replicas, buffer, 7, 2, shuffle, drop_last)
    assert batching.buffered_batches(df.limit(0), "k", "n", 100, replicas).count() == 0


# --- counts


def test_ngram_counts(spark):
    rows = [("a", "ab𝄞ab"), ("a", "b"), ("b", None), ("b", ""), ("b", "aba"), (None, "aa")]
    df = spark.createDataFrame(rows, "g string, t string").repartition(2)
    for n in (1, 2, 3, 4):
        want = collections.Counter((g, t[i : i + n]) for g, t in rows if t for i in range(len(t) - n + 1))
        assert {(r.g, r.gram): r.n for r in evaluate.ngram_counts(df, "g", "t", n).collect()} == want


def test_sketches(spark):
    rnd = random.Random(2)
    rows = [(day, rnd.randrange(3), rnd.randrange(20_000)) for day in range(6) for _ in range(4000)]
    df = spark.createDataFrame(rows, "day int, g int, u int")
    stored = None
    for day in range(6):  # a day at a time; a late row of an earlier day is merged, too
        new = df.filter(F.col("day") == day)
        new = new.unionByName(spark.createDataFrame([(0, 0, 99_999)], "day int, g int, u int")) if day == 5 else new
        stored = graph.written(sketches.kept_up(stored, new, ["g", "day"], "u"))
    assert stored.count() == 18 and stored.agg(F.sum("n")).first()[0] == len(rows) + 1
    days = {r.g: r.e for r in sketches.merged(stored, ["g"]).select("g", sketches.estimate("sketch").alias("e")).collect()}
    direct = {r.g: r.e for r in sketches.sketched(df.unionByName(spark.createDataFrame([(0, 0, 99_999)], "day int, g int, u int")), ["g"], "u").select("g", sketches.estimate("sketch").alias("e")).collect()}
    for g in range(3):
        exact = len({u for _, x, u in rows if x == g}) + (g == 0)
        assert abs(days[g] - exact) <= 4 * 0.0065 * exact and abs(days[g] - direct[g]) <= 0.005 * exact


# --- streams


def test_first_rows_of_a_stream(spark, tmp_path):
    """Restarted twice, with keys that were there before; nothing is appended twice."""
    out, check, schema = str(tmp_path / "out"), str(tmp_path / "check"), "k long, v string"
    there = spark.createDataFrame([(1, "old"), (2, "old")], schema)
    for part in ([(1, "a"), (3, "a"), (3, "b")], [(3, "c"), (4, "a")], [(4, "b"), (2, "z"), (5, "a")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        keyed.append_new(spark.readStream.schema(schema).json(str(tmp_path / "in")), "k", out, check, there)
    assert sorted(r.k for r in spark.read.schema(schema).parquet(out).collect()) == [3, 4, 5]


def test_sessions_of_a_stream(spark, tmp_path):
    """Closed sessions equal those of the batch; a row behind the watermark is dropped and counted."""
    rnd = random.Random(5)
    rows = [(rnd.randrange(4), 1_000_000 + rnd.randrange(200_000)) for _ in range(120)]
    first, second = [r for r in rows if r[1] < 1_100_000], [r for r in rows if r[1] >= 1_100_000]
    parts = [first, second, [(k, 9_000_000) for k in range(4)], [(0, 1_000_500)], [(9, 9_500_000)]]
    schema = "u long, ms long"
    (tmp_path / "in").mkdir()
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    late = 0
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = keyed.closed_sessions(read.select("u", F.timestamp_millis("ms").alias("t")), "u", "t", 3000, 5000)
        q = stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        late += keyed.late_rows(q)
    want = []
    for u in range(4):
        for t in sorted(t for k, t in rows if k == u):
            if want and want[-1][0] == u and t - want[-1][2] < 3000:
                want[-1][2:] = [t, want[-1][3] + 1]
            else:
                want.append([u, t, t, 1])
    got = [list(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.start < 9_000_000]
    assert sorted(got) == sorted(want) and late == 1
