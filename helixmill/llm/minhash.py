"""MinHash near-dedup with b-bit signatures, confirmed on full shingle sets.

1. Every text becomes its set of 5-word shingles; PERMUTATIONS minima are taken. Whole
   minima make BANDS band keys; of each minimum BITS low bits are retained and packed
   into four longs.
2. Texts of equal sets fall into one class first, so copies cost one row.
3. Classes that share a band key are candidates. A bucket never becomes all its pairs:
   each member is tried against the bucket's smallest id, links are confirmed, and
   linked classes merge. What a mixed bucket leaves in different components goes
   through an exact prefix join on full sets, rarest shingles first: it brings together
   only pairs that may be links, where a large group of edited copies would give the
   square of its size. Parities of the sets, an exact bound, drop nearly all that are
   not before they are a row.
4. A candidate's similarity is estimated from the packed bits, corrected for chance
   agreement, (m - 2^-b) / (1 - 2^-b); pairs over ESTIMATE, six standard deviations
   below the threshold, are confirmed on full sets, which only these texts need.
5. Components by alternating large-star and small-star steps over tables.

With 32 bands of 4 rows a pair of similarity 0.75 shares no band with probability
5e-6; hot keys are split by the engine's skewed-join handling, as both sides of those
joins are plain exchanges.

Edge cases: null text is empty; empty texts have no shingles and link with nothing;
texts of fewer than 5 words are one shingle; rows that share an id are one document
to links; rows with a null id are reported and link with nothing; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._shared import BROADCAST_ROWS, materialise, release, slices, small, trim

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, BANDS, BITS = 128, 32, 2
ESTIMATE = 0.5
#: Earlier shingles in a row of the prefix join; beyond them a pair may meet again, which changes no result.
REMEMBERED = 32
#: Longs of a set's parities: bit b is the parity of its shingles with hash b modulo their number of bits.
WORDS = 8
PARITY = tuple(f"p{i}" for i in range(WORDS))
LISTS = "id long, key binary, hashes array<long>, " + ", ".join(f"{p} long" for p in PARITY)
#: Text that a task takes at a time.
SLICE_BYTES = 4 << 20
SIGNATURE = ("s0", "s1", "s2", "s3")
FEATURES = "doc_id long, n long, key binary, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _mix64(x):
    """Finaliser of a 64-bit hash."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts, size: int = SHINGLE):
    """Arrow strings -> sorted distinct 64-bit shingle hashes of each text."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    real = np.array([w != "" for w in words], dtype=bool)
    codes = np.asarray(coded.indices)
    offsets = np.asarray(lists.offsets)
    base, prime = offsets[0], np.uint64(0x9E3779B97F4A7C15)
    for a, b in zip(offsets[:-1] - base, offsets[1:] - base):
        c = codes[a:b]
        w = hashes[c[real[c]]]
        k = min(size, len(w))
        if not k:
            yield w
            continue
        h = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h = _mix64((h ^ w[i : len(w) - k + 1 + i]) * prime)
        yield np.unique(h)


def _constants():
    import numpy as np

    rng = np.random.default_rng(20240229)
    a = (rng.integers(0, 2**31, PERMUTATIONS, dtype=np.int64) * 2 + 1).astype(np.uint32)
    return a[:, None], rng.integers(0, 2**32, PERMUTATIONS, dtype=np.int64).astype(np.uint32)[:, None]


def minima(values, a, b):
    """PERMUTATIONS minima of a set."""
    import numpy as np

    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (a * x[i : i + 2048] + b).min(axis=1), out=out)
    return out


def signatures(m):
    """(rows, PERMUTATIONS) minima -> (rows, 4) packed low bits, (rows, BANDS) band keys."""
    import numpy as np

    low = _mix64(m.astype(np.uint64) + (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32))) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    packed = (low.reshape(len(m), -1, per) << shifts).sum(axis=2, dtype=np.uint64)
    wide = m.astype(np.uint64).reshape(len(m), BANDS, -1)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), wide.shape[:2]).copy()
    for i in range(wide.shape[2]):
        keys = _mix64((keys << np.uint64(1)) + keys + wide[:, :, i] + np.uint64(0x632BE59BD9B4E019))
    return packed.view(np.int64), keys.view(np.int64)


def _features(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash

    a, b = _constants()
    for part in slices(batches, 1, SLICE_BYTES):
        n, key, found = [], [], []
        for s in shingle_sets(part.column(1)):
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()))
            found.append(minima(s, a, b))
        packed, bands = signatures(np.array(found))
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), *[pa.array(packed[:, i]) for i in range(4)], keys], names=[x.split()[0] for x in FEATURES.split(", ")]
        )
    trim()


def _sets(batches):
    import pyarrow as pa

    for part in slices(batches, 1, SLICE_BYTES):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())], names=["id", "set"])
    trim()


def parities(values):
    """A set -> WORDS longs. Shingles that two sets share cancel out, so they differ in at most as many bits as shingles."""
    import numpy as np

    bits = np.bincount((values >> np.uint64(8)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _lists(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash

    for part in slices(batches, 1, SLICE_BYTES):
        sets = list(shingle_sets(part.column(1)))
        keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        bits = np.array([parities(s) for s in sets])
        yield pa.RecordBatch.from_arrays([part.column(0), keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *[pa.array(bits[:, i]) for i in range(WORDS)]], names=["id", "key", "hashes", *PARITY])
    trim()


def _confirm(percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def estimate(left: str, right: str):
    """Collision-corrected similarity of two packed signatures."""
    differ = F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(any_bit)
    chance = 2.0**-BITS
    return ((1 - differ / PERMUTATIONS) - chance) / (1 - chance)


def _possible(left: str, right: str, percent: int):
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (estimate(left, right) >= ESTIMATE)


def _near_enough(percent: int):
    """No pair of the similarity differs in more shingles than (n + m) (100 - percent) / (100 + percent)."""
    differ = F.lit(0)
    for p in PARITY:
        differ = differ + F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}")))
    return differ * (100 + percent) <= (F.col("x_n") + F.col("y_n")) * (100 - percent)


def _side(table: DataFrame, name: str) -> DataFrame:
    return table.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", *SIGNATURE)])


def confirmed(pairs: DataFrame, classes: DataFrame | None, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) -> the pairs whose full sets are similar enough, as a table. docs: (id, text); no classes: pairs are screened already."""
    if classes is not None:
        pairs = pairs.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b").filter(_possible("a_", "b_", percent)).select("a", "b")
    close = materialise(pairs, "near-close")
    needed = materialise(close.select(F.col("a").alias("id")).distinct().unionByName(close.select(F.col("b").alias("id")).distinct()).distinct(), "near-needed")
    sets = materialise(docs.join(small(needed), "id", "left_semi").mapInArrow(_sets, "id long, set binary"), "near-sets")
    rows = close.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    links = materialise(rows.mapInArrow(_confirm(percent), "a long, b long"), "near-links")
    release(close, needed, sets)
    return links


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) -> (id, component): the smallest id reachable, for ids that have links.

    Settles in about log(n) rounds; beyond `rounds` it raises rather than give a result that is not whole.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # What large-star gives points from larger to smaller ids, as small-star wants it.
        large = large.unionByName(both.filter("v < u").groupBy("u").agg(F.min("v").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        before, edges = edges, materialise(star.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "star")
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def apart_pairs(apart: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of apart in different components that may be similar enough; none that is, is left out.

    apart: id, key, component, n, signature. An exact prefix join: each set's shingles
    are put in one order, rarest in apart first. A pair with n + m shingles needs an
    overlap of t = percent (n + m) / (100 + percent), so its first common shingle has
    place n - t at most in one set and m - t in the other. A much edited copy begins with
    its own edits and meets nobody, where pairs of a bucket would grow with its square.
    A pair meets at its first common shingle only: each row carries up to REMEMBERED
    shingles that stand before its own, and rows that share one of these met there.
    A pair whose parities differ in more bits than a link may have shingles is no row.
    """
    sets = materialise(docs.join(small(materialise(apart.select("id").distinct(), "near-apart-ids")), "id", "left_semi").mapInArrow(_lists, LISTS), "near-apart-sets")
    tokens = sets.select("id", "key", F.explode("hashes").alias("h"))
    often = tokens.groupBy("h").agg(F.count("*").alias("c"))
    ordered = tokens.join(often, "h").groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("c", "h"))).alias("r"))  # one text's shingles
    head = F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    placed = ordered.join(apart, ["id", "key"]).join(sets.select("id", "key", *PARITY).distinct(), ["id", "key"]).select("id", "component", "n", *SIGNATURE, *PARITY, head.alias("head"))
    shared = F.filter("head", lambda t: t["c"] > 1)["h"]  # a shingle of one set has nobody to meet
    rows = placed.select("*", F.slice(shared, 1, REMEMBERED).alias("first"), F.posexplode("head").alias("i", "t")).filter("t.c > 1")
    at = F.array_position("first", F.col("t.h")).cast("int")
    rows = rows.withColumn("before", F.when(at == 0, F.col("first")).otherwise(F.slice("first", F.lit(1), F.greatest(at - 1, F.lit(0)))))
    x, y = (rows.select(F.col("t.h").alias("h"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "component", "n", "i", "before", *SIGNATURE, *PARITY)]) for s in ("x", "y"))
    room = lambda s: (F.col(f"{s}_n") - F.col(f"{s}_i")) * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent
    pairs = x.join(y, "h").filter((F.col("x_id") < F.col("y_id")) & (F.col("x_component") != F.col("y_component")) & room("x") & room("y") & _near_enough(percent) & _possible("x_", "y_", percent) & ~F.arrays_overlap("x_before", "y_before"))
    return pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    features = materialise(rows.mapInArrow(_features, FEATURES), "near-features")
    classes = materialise(
        features.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key", "n", *SIGNATURE, "bands").agg(F.min("doc_id").alias("id")), "near-classes"
    )
    in_bands = classes.select("id", F.explode("bands").alias("band"))
    buckets = in_bands.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c")
    members = materialise(in_bands.join(buckets, "band"), "near-members")
    stars = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = confirmed(stars, classes, rows, percent)
    found = components(links)

    # What the stars left apart: members of one bucket in different components.
    placed = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band")
    apart = materialise(placed.filter("id <> hub").join(mixed, "band").select("id", "component").distinct().join(classes.select("id", "key", "n", *SIGNATURE), "id"), "near-apart")
    more = confirmed(apart_pairs(apart, rows, percent), None, rows, percent)  # these were screened where they met
    if not more.isEmpty():
        links = materialise(links.unionByName(more), "near-links")
        found = components(links)
    of_class = classes.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    out = features.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(of_class, "key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without the documents that do not stay: one of each component does, that with the smallest id."""
    gone = materialise(near_duplicates(docs, id_col, text_col, percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    return docs.join(small(gone, BROADCAST_ROWS), docs[id_col] == gone["_gone"], "left_anti")
