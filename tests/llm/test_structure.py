"""Prefix trie, vector near-duplicates and filter audit against brute force, on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from helixmill.llm import filter_audit, prefix_trie, vector_dedup

TURNS = "conv_id long, turn int, role string, text string, d long, owner long, level string"
VECTORS = "vec_id long, embedding array<double>, label int, key string, unit string, node long"


# --- prefix trie


def brute_trie(rows, shared):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    if shared:
        built = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            base = c - int(np.fmod(c, 100))
            built[c] = own.get(base, [])[:h] + v[h:]
        own = built
    members = collections.defaultdict(list)
    for c, v in own.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = sorted(c for c in m if len(own[c]) == len(k))
        out.append(
            (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), sum(not kids[x] for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        )
    return sorted(out, key=str)


def trie_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(12), 100, 101, 203, 204, 305, -5, -100, -107, 1000]:
        for t in range(rnd.choice([1, 2, 3, 6, 8])):
            rows.append((c, t, rnd.choice(["user", "user", None]), rnd.choice(["a", "b", "é𝄞", None, ""])))
    rows += [(50, None, "user", "late"), (50, 1, "user", "a"), (50, 1, "assistant", "z"), (50, 1, "user", "a"), (50, 1, "user", "a"), (None, 0, "user", "gone")]
    rows += [(60, t, "user", "x" * (t % 4)) for t in range(70)] + [(61, t, "user", "x" * (t % 4)) for t in range(50)] + [(62, t, "user", "x" * (t % 4)) for t in range(50)]
    return rows


def of_turns(spark, rows):
    return spark.createDataFrame([(*r, 3, 4, "l") for r in rows], TURNS).repartition(5)


@pytest.mark.parametrize("seed,shared,block", [(1, True, 1024), (2, False, 7)])
def test_trie_equals_brute_force(spark, seed, shared, block):
    rows = trie_rows(seed)
    build = prefix_trie.rebuilt if shared else prefix_trie.sequences
    got = prefix_trie.trie(build(of_turns(spark, rows)), block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows, shared)


def test_trie_of_light_levels(spark):
    """A binary trie: paths hang on paths, in as many rounds as it is deep."""
    rows = [(c, t, "user", "xy"[(c >> t) & 1]) for c in range(16) for t in range(4)]
    got = prefix_trie.trie(prefix_trie.sequences(of_turns(spark, rows))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows, False)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(of_turns(spark, []))).count() == 0
    # All turns of 1 stand before those that it takes from its absent base.
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    got = prefix_trie.trie(prefix_trie.rebuilt(of_turns(spark, [(lone, 0, "user", "a")]))).collect()
    assert [tuple(r) for r in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


# --- vectors


def brute_vectors(rows, cosine=0.9):
    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v) / np.abs(v).max()
        return x / np.sqrt(x @ x)

    units = [unit(v) if i is not None else None for i, v in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is None or rows[i][0] == least))
    return sorted(out, key=str)


def of_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", "u", 9) for i, v in rows], VECTORS).repartition(3)


def vector_rows(seed, n=240, size=6):
    """Chains of near vectors that cross borders between cells, copies, and odd rows."""
    rng = np.random.default_rng(seed)
    rows, v = [], rng.normal(size=size)
    for i in range(n):
        v = v / np.linalg.norm(v) + rng.normal(size=size) * (0.25 if i % 7 else 2.0)
        rows.append((1000 - i, [float(x) for x in v]))
    rows += [(2000 + i, rows[3][1]) for i in range(30)] + [(3000, [2 * x for x in rows[3][1]])]
    rows += [(7, None), (8, []), (9, [0.0] * size), (10, [1.0, None] * 3), (11, [float("nan")] * size), (12, [float("inf")] + [1.0] * 5), (None, rows[3][1]), (None, None)]
    rows += [(13, [1.0, 2.0]), (14, [1.0, 2.1]), (15, [-1.0, 2.0]), (16, [1e300] * size), (17, [1e-300] * size), (18, [5.0]), (18, [6.0]), (19, [-0.0, 1.0]), (20, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize("seed,cell", [(1, 4096), (2, 20)])
def test_vectors_equal_brute_force(spark, seed, cell, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ROWS_A_CELL", 4)
    monkeypatch.setattr(vector_dedup, "BLOCK_BYTES", 48 * 16)  # many blocks a cell
    rows = vector_rows(seed)
    got = vector_dedup.near_duplicates(of_vectors(spark, rows), cell=cell)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_vectors(rows)


def test_vectors_of_nothing(spark):
    assert vector_dedup.near_duplicates(of_vectors(spark, [])).count() == 0
    assert [tuple(r) for r in vector_dedup.near_duplicates(of_vectors(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


def test_vectors_repeated_ids_and_dedup(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.1]), (6, [1.0, 0.1])]
    docs = of_vectors(spark, rows)
    assert sorted((tuple(r) for r in vector_dedup.near_duplicates(docs).collect()), key=str) == brute_vectors(rows)
    kept = vector_dedup.dedup(docs)
    assert kept.columns == docs.columns and sorted(r.vec_id for r in kept.collect()) == [5, 5, 5]


def test_visits_lose_no_pair_at_borders():
    """Every pair close enough meets in exactly one cell, as a resident and a resident or a visitor."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    x = np.repeat(base, 6, axis=0) + rng.normal(size=(240, 8)) * 0.15
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres = vector_dedup.fit(x, 12)
    home = (x @ centres.T).argmax(axis=1)
    least = [min([(x[i] @ centres[c]) for i in np.flatnonzero(home == c)], default=1.0) for c in range(12)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(240)), pa.array([1] * 240), pa.array([v.tobytes() for v in x], pa.binary())], names=["node", "m", "unit"])
    cells = collections.defaultdict(dict)
    for out in vector_dedup._placed({8: centres}, {8: least}, 0.9)([batch]):
        for r in out.to_pylist():
            assert r["node"] not in cells[r["cell"]]
            cells[r["cell"]][r["node"]] = r["home"]
    assert sum(map(len, cells.values())) < 240 * 6  # and not all of them everywhere
    for i, j in itertools.combinations(range(240), 2):
        meet = sum(i in c and j in c and (c[i] or c[j]) for c in cells.values())
        assert meet <= 1 and (meet == 1 or x[i] @ x[j] < 0.9)


# --- filter audit


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    parts = collections.defaultdict(list)
    for i, t, part in rows:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and text in least and least[text] < i]
        parts[part or ""].append(({x for x, y in zip("ABCDE", f) if y}, i))
    out = {}
    for part, docs in parts.items():
        removed_by = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, x in enumerate(order):
                here = [(f, i) for f, i in docs if x in f and not f & set(order[:s])]
                removed_by[x] += len(here)
                out[part, order, s + 1] = [
                    sum(not f & set(order[: s + 1]) for f, _ in docs), len(here), sum(bool(x in f and f & set(order[:s])) for f, _ in docs), sum(f == {x} for f, _ in docs),
                    sum(i in good for _, i in here), sum(i in toxic for _, i in here),
                ]
        for (p, order, s), v in out.items():
            if p == part:
                v.append(removed_by[order[s - 1]])
    return out


def audit_rows():
    rnd = random.Random(4)
    some = [" ".join(rnd.choice(["ab", "Cd", "EF", "é", "x#", "zz%"]) + str(rnd.randint(0, k)) for _ in range(n)) for k in (9, 300, 9000) for n in (3, 99, 100, 130, 400)]
    rows = [(i, rnd.choice(some), rnd.choice(["en", "de", None, ""])) for i in range(120)]
    long = " ".join(f"w{i}" for i in range(50000))
    return rows + [(500, None, "en"), (501, "", None), (502, " \n\t ", "en"), (None, some[0], "en"), (None, None, None), (3, some[1], "en"), (3, some[1], "en"), (600, long, "fr"), (601, long, "fr")]


def test_audit_equals_brute_force(spark):
    rows, labels = audit_rows(), [(i, i % 2, i % 3 == 0) for i in range(0, 100)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)]
    docs = spark.createDataFrame([(i, t, p, "m", 5, 1) for i, t, p in rows], "doc_id long, text string, lang string, part string, mask int, good int").repartition(4)
    said = spark.createDataFrame([(i, None if q is None else int(q), None if x is None else int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    for parts in (1024, 1):
        got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(docs, said, parts=parts).collect()}
        assert got == brute_audit(rows, [(i, q, int(x) if x is not None else None) for i, q, x in labels])
    assert filter_audit.audit(docs.limit(0), said).count() == 0
    assert filter_audit.audit(docs, said.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_first_failures():
    first = filter_audit.first_failures()
    assert first.shape == (32, 120) and (first[0] == 5).all()
    for mask, order in itertools.product(range(32), range(120)):
        fails = [f for f in filter_audit.ORDERS[order] if mask >> "ABCDE".index(f) & 1]
        assert first[mask, order] == (filter_audit.ORDERS[order].index(fails[0]) if fails else 5)


# --- chunks of the language model


def batches_of(texts, at_a_time=7):
    import pyarrow as pa

    for lo in range(0, len(texts), at_a_time):
        part = texts[lo : lo + at_a_time]
        yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(part))), pa.array(part, pa.string())], names=["doc_id", "text"])


@pytest.mark.parametrize("texts", [[""] * 40, [None, "a b"] * 30, ["x"] * 25 + [" ".join(map(str, range(5000)))] + ["y z"] * 9, ["a b c"]])
def test_chunks_hold_their_bounds(texts):
    from helixmill.llm import katz

    chunks = list(katz._chunks(batches_of(texts), most_docs=10, most_tokens=50))
    assert [i for ids, _, _ in chunks for i in ids] == list(range(len(texts)))
    assert all(len(ids) <= 10 and len(ids) == len(lens) and lens.sum() == len(words) for ids, lens, words in chunks)
    assert [n for _, lens, _ in chunks for n in lens] == [len((t or "").split()) + 1 for t in texts]


def test_chunks_fit_their_numbers():
    """A huge text after many short ones gets a chunk of its own where one number would not hold both."""
    from helixmill.llm import katz

    texts = [""] * 1_000_000 + [" ".join(f"{i:x}" for i in range(3_200_000))] + ["a"]
    for ids, lens, words in katz._chunks(batches_of(texts, 10_000)):
        assert len(ids) <= katz.CHUNK_DOCS and (len(words) + 1) ** 2 * len(ids) < 1 << 63


def test_katz_beyond_a_chunk_of_documents(spark):
    """One task with more rows than a chunk may hold: every row has its own sums."""
    from pyspark.sql import functions as F

    from helixmill.llm import katz

    n = katz.CHUNK_DOCS + 12_000
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, F.lit("a b")).otherwise(F.lit("")).alias("text"))
    got = katz.score(docs).groupBy("n_tokens", "n_known").agg(F.count("*").alias("n"), F.countDistinct("score").alias("scores")).collect()
    long = sum(i % 1000 == 7 for i in range(n))
    assert sorted(map(tuple, got)) == [(1, 1, n - long, 1), (3, 3, long, 1)]


# --- spans of secrets


def test_spans_of_a_text_with_very_many(spark):
    """Base spans and runs among each other, over many strides, against a plain pass; and in proportion to the text."""
    import time

    from helixmill.llm import secrets

    rnd = random.Random(6)
    size = len(secrets.ALPHABET)
    model = [1.0] * (size * size)  # every long run is random
    kinds = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "markov": secrets.RUN}
    parts = ["token=abcdef12", "key", "zz" * 12, "AKIA" + "A1" * 9, "deadbeef" * 4, "é", "G" * 25, "secret: ab", "x-" * 11 + "deadbeef" * 3]
    texts = [" ".join(rnd.choice(parts) for _ in range(n)) for n in (0, 1, 2, 255, 256, 257, 513, 1500)] + ["", None]

    def brute(text):
        of = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if k != "assign" or len(m[2]) >= 6] for k, p in kinds.items()}
        base = sorted((a, k, b) for k, x in enumerate(list(kinds)[:3]) for a, b in of[x])
        runs = [(a, 3, b) for a, b in of["markov"] if not any(a < y and x < b for x, _, y in base)]
        return ",".join(f"{list(kinds)[k]}:{a}:{b}" for a, k, b in sorted(base + runs))

    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.spans for r in got} == {i: brute(t) for i, t in enumerate(texts)}

    def seconds(n):
        many = spark.createDataFrame([(0, " ".join(rnd.choice(parts) for _ in range(n)))], "doc_id long, text string")
        secrets.scan(many, model).collect()
        began = time.time()
        secrets.scan(many, model).collect()
        return time.time() - began

    # Planning takes some seconds whatever the text; four times the spans take about four times the rest, not sixteen times.
    plan, some, many = seconds(500), seconds(16_000), seconds(64_000)
    assert many - plan < 10 * max(some - plan, 0.5)
