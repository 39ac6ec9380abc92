"""Conversation prefix trie with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first d turns. Its key is d with four sums of 32-bit
hashes of (place, role, text): sums add up in any grouping, so a conversation of any
length is cut into runs that lie in different partitions, and each run only needs the
sums of those before it. A node's name is (its smallest member, d), which is unique.

1. Turns are sorted by range, so that one long conversation spans many partitions;
   runs (conversation, partition) give places. `rebuilt` exchanges first turns.
2. Nodes are keys, aggregated on the map side first; each picks its heavy child, that
   with the most members (ties: smallest member). A light child has at most half of its
   parent's members, so a path meets at most log2(conversations) light edges.
3. A conversation's rows find their nodes, and the nearest light node above each names
   its heavy path; the count of light nodes above is the path's level.
4. Level by level, from the deepest, light paths add their totals to the paths that they
   hang on: logarithmic rounds over one row a path.
5. Each path is cut into arrays of BLOCK depths; totals of later blocks are added to
   suffix sums inside the arrays.

Hashes of members stream in order of their ids, in constant memory, through the task
that holds their node; of a group of equal conversations only ids go there.

Edge cases: null role or text is empty; null turns come first; turns that tie are
ordered by role, then text, so repeated rows are repeated turns; rows with a null conv_id
take no part; a conversation that is left without turns is a member of the root; an
empty table gives an empty table, without a root; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._shared import materialise, release

#: Conversations of one hundred share first turns of its first, at most MOST_SHARED.
HUNDRED, MOST_SHARED = 100, 5
#: Depths of a path in one array.
BLOCK = 1024
NOBODY = hashlib.sha256(b"").hexdigest()
KEY = ("k0", "k1", "k2", "k3")
UP = ("q0", "q1", "q2", "q3")
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _before(value, by: list[str], order: str):
    """Sum of value over earlier rows."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, run, i, a, b, points): i counts up inside a run, which is a conversation's share of a partition."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    ).filter("conv_id IS NOT NULL")
    # Equal rows are interchangeable, and a number of their own lets the ranges cut between them.
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text", "_tie")
    at = ordered.withColumn("at", F.monotonically_increasing_id())
    return at.select("conv_id", F.shiftright("at", 33).alias("run"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("i"), F.xxhash64("role", "text").alias("a"), F.xxhash64("text", "role", F.lit(1)).alias("b"), F.length("text").cast("long").alias("points"))


def _runs(turns: DataFrame) -> DataFrame:
    """(conv_id, run, lo, n, before): a run's first i, its turns, and those of earlier runs."""
    return turns.groupBy("conv_id", "run").agg(F.min("i").alias("lo"), F.count("*").alias("n")).withColumn("before", _before("n", ["conv_id"], "run"))


def sequences(conversations: DataFrame) -> DataFrame:
    """The conversations as they are: (conv_id, run, d, a, b, points, length), and a row with d = 0 for each."""
    turns = materialise(_sorted_turns(conversations), "trie-turns")
    runs = materialise(_runs(turns), "trie-runs")
    lengths = runs.groupBy("conv_id").agg(F.sum("n").alias("length"))
    rows = turns.join(runs.join(lengths, "conv_id"), ["conv_id", "run"])
    rows = rows.select("conv_id", "run", (F.col("i") - F.col("lo") + F.col("before") + 1).alias("d"), "a", "b", "points", "length")
    return rows.unionByName(_tops(lengths))


def rebuilt(conversations: DataFrame, shared=None) -> DataFrame:
    """As `sequences`, of conversations that begin with `shared` (column, 0 to MOST_SHARED) turns of their hundred's first."""
    shared = F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1) if shared is None else shared
    turns = materialise(_sorted_turns(conversations), "trie-turns")
    runs = materialise(_runs(turns), "trie-runs")
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    place = F.col("i") - F.col("lo") + F.col("before") + 1
    first = runs.filter((base == F.col("conv_id")) & (F.col("before") < MOST_SHARED))
    heads = turns.join(first, ["conv_id", "run"]).filter(place <= MOST_SHARED)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct(place.alias("d"), "a", "b", "points"))).alias("head"))
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", base.alias("base"), shared.cast("int").alias("h")).join(heads, "base", "left")
    took = F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast("array<struct<d:long,a:long,b:long,points:long>>")).otherwise(F.slice("head", F.lit(1), F.greatest("h", F.lit(1))))
    convs = convs.select("conv_id", "h", took.alias("took"), (F.size(took) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    convs = materialise(convs, "trie-conversations")
    own = turns.join(runs.join(convs.select("conv_id", "h", F.size("took").alias("took"), "length"), "conv_id"), ["conv_id", "run"])
    own = own.withColumn("place", place).filter("place > h").select("conv_id", "run", (F.col("place") - F.col("h") + F.col("took")).alias("d"), "a", "b", "points", "length")
    theirs = convs.select("conv_id", F.lit(-1).cast("long").alias("run"), F.explode("took").alias("t"), "length").select("conv_id", "run", "t.d", "t.a", "t.b", "t.points", "length")
    return own.unionByName(theirs).unionByName(_tops(convs))


def _tops(lengths: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return lengths.select("conv_id", F.lit(-2).cast("long").alias("run"), zero.alias("d"), zero.alias("a"), zero.alias("b"), zero.alias("points"), "length")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their node's key and, q, that of the node's parent."""
    x, y = F.xxhash64("d", "a"), F.xxhash64("b", "d")
    low = F.lit(0xFFFFFFFF)
    own = [F.shiftrightunsigned(x, 32), x.bitwiseAND(low), F.shiftrightunsigned(y, 32), y.bitwiseAND(low)]
    rows = rows.select("conv_id", "run", "d", "points", "length", *[F.when(F.col("d") > 0, v).otherwise(F.lit(0)).alias(f"o{i}") for i, v in enumerate(own)])
    sums = rows.groupBy("conv_id", "run").agg(*[F.sum(f"o{i}").alias(f"s{i}") for i in range(4)])
    sums = sums.select("conv_id", "run", *[_before(f"s{i}", ["conv_id"], "run").alias(f"c{i}") for i in range(4)])
    inside = Window.partitionBy("conv_id", "run").orderBy("d")
    rows = rows.select("*", *[F.sum(f"o{i}").over(inside).alias(f"s{i}") for i in range(4)]).join(sums, ["conv_id", "run"])
    return rows.select(
        "conv_id", "run", "d", "points", "length", *[(F.col(f"s{i}") + F.col(f"c{i}")).alias(KEY[i]) for i in range(4)], *[(F.col(f"s{i}") + F.col(f"c{i}") - F.col(f"o{i}")).alias(UP[i]) for i in range(4)]
    )


def _nodes(keyed: DataFrame) -> DataFrame:
    """(d, key, owner, n_convs, points, n_children, parent_conv_id, light), one row a node."""
    nodes = materialise(keyed.groupBy("d", *KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("points").alias("points"), *[F.max(q).alias(q) for q in UP]), "trie-bare")
    heavy = F.min(F.struct((-F.col("n_convs")).alias("n"), "owner"))["owner"]
    kids = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), *[F.col(q).alias(k) for q, k in zip(UP, KEY)]).agg(F.count("*").alias("n_children"), heavy.alias("heavy"))
    parents = nodes.join(kids, ["d", *KEY]).select((F.col("d") + 1).alias("d"), *[F.col(k).alias(q) for q, k in zip(UP, KEY)], F.col("owner").alias("parent_conv_id"), "heavy")
    both = nodes.join(kids.drop("heavy"), ["d", *KEY], "left").join(parents, ["d", *UP], "left")
    return both.select("d", *KEY, "owner", "n_convs", "points", F.coalesce("n_children", F.lit(0)).alias("n_children"), "parent_conv_id", (F.col("parent_conv_id").isNull() | (F.col("owner") != F.col("heavy"))).alias("light"))


def _on_paths(rows: DataFrame) -> DataFrame:
    """Nodes with the top of their heavy path and its level; rows: every conversation's nodes."""
    light = F.when(F.col("light"), F.struct("d", "owner"))
    runs = rows.groupBy("conv_id", "run").agg(F.max(light).alias("top"), F.count(light).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", F.max("top").over(earlier).alias("top_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy("conv_id", "run").orderBy("d")
    placed = rows.select("*", F.max(light).over(inside).alias("top"), F.count(light).over(inside).alias("n")).join(runs, ["conv_id", "run"])
    top = F.coalesce("top", "top_before")
    return placed.filter("conv_id = owner").select(
        "conv_id", "d", top["d"].alias("top_d"), top["owner"].alias("top_conv"), (F.col("n") + F.col("n_before") - 1).alias("level"), "n_convs", "n_children", "parent_conv_id",
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
    )


def _attached(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, d, more_leaves, more_saved): totals of the light subtrees that hang on a node."""
    path = ["top_d", "top_conv"]
    at_top = F.when(F.col("d") == F.col("top_d"), F.col("parent_conv_id"))
    paths = nodes.groupBy(*path).agg(F.max("level").alias("level"), F.max(at_top).alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = nodes.select("conv_id", "d", F.col("top_d").alias("up_d"), F.col("top_conv").alias("up_conv"))
    paths = materialise(paths.filter("level > 0").withColumn("d", F.col("top_d") - 1).join(above, ["conv_id", "d"]), "trie-paths")
    made, below = [], None
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = paths.filter(F.col("level") == level)
        if below is not None:
            here = here.join(below, path, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        made.append(materialise(here, "trie-level"))
        below = made[-1].groupBy(F.col("up_d").alias("top_d"), F.col("up_conv").alias("top_conv")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    whole = paths.limit(0)
    for x in made:
        whole = whole.unionByName(x)
    return whole.groupBy("conv_id", "d").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")), [paths, *made]


def _member_hashes(batches):
    """Batches sorted by (owner, d, conv_id), an owner's d in one partition -> one hash a node."""
    import numpy as np
    import pyarrow as pa

    node, digest = None, None

    def row(owner, d, digest):
        return pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([d], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "d", "ends_sha256"])

    for batch in batches:
        owner, d, conv = (np.asarray(batch.column(i)) for i in range(3))
        cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (d[1:] != d[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(owner)]):
            if lo == hi:
                continue
            text = ",".join(map(str, conv[lo:hi].tolist())).encode()
            if node == (owner[lo], d[lo]):
                digest.update(b"," + text)
                continue
            if node is not None:
                yield row(*node, digest)
            node, digest = (owner[lo], d[lo]), hashlib.sha256(text)
    if node is not None:
        yield row(*node, digest)


def _suffix_sums(batches):
    """Arrays of a path's nodes, in order of depth, with what later arrays sum to -> nodes with subtree sums."""
    import numpy as np
    import pyarrow as pa

    names = [x.split()[0] for x in RESULT.split(", ")]
    for batch in batches:
        lists = batch.column(0)
        offsets = np.asarray(lists.offsets)
        items = lists.flatten()
        first, sizes = offsets[0], np.diff(offsets)
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        columns = {f.name: items.field(i) for i, f in enumerate(items.type)}
        for name, rest in (("n_leaves", 1), ("saved_tokens", 2)):
            value = np.asarray(columns[name])
            upto = np.concatenate([[0], np.cumsum(value)])
            ends = upto[offsets[1:] - first]
            columns[name] = pa.array(ends[row_of] - upto[:-1] + np.asarray(batch.column(rest))[row_of])
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def trie(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of `sequences` or `rebuilt`: see RESULT; a subtree includes its top."""
    keyed = materialise(_keyed(rows), "trie-keyed")
    nodes = materialise(_nodes(keyed), "trie-nodes")
    members = materialise(keyed.drop(*UP, "points").join(nodes, ["d", *KEY]).drop(*KEY), "trie-members")
    release(keyed, nodes)
    placed = materialise(_on_paths(members), "trie-placed")
    ends = members.filter("d = length").select("owner", "d", "conv_id").repartition("owner", "d").sortWithinPartitions("owner", "d", "conv_id")
    ends = ends.mapInArrow(_member_hashes, "conv_id long, d long, ends_sha256 string")
    attached, made = _attached(placed)
    whole = placed.join(attached, ["conv_id", "d"], "left").join(ends, ["conv_id", "d"], "left")
    item = F.struct(
        F.col("d").alias("depth"), "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )
    path = ["top_d", "top_conv"]
    whole = whole.select(*path, F.floor((F.col("d") - F.col("top_d")) / block).alias("block"), item.alias("item"))
    arrays = whole.groupBy(*path, "block").agg(F.sort_array(F.collect_list("item")).alias("items"), F.sum("item.n_leaves").alias("l"), F.sum("item.saved_tokens").alias("s"))
    later = Window.partitionBy(*path).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    arrays = arrays.select("items", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("l", "s")])
    out = materialise(arrays.mapInArrow(_suffix_sums, RESULT), "trie")
    release(members, placed, *made)
    return out
