"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a line, or a window of words, within a line or over line ends: a notice may be
wrapped, or stand in a long line. It matches a template T if at least CONTAINMENT of T's
distinct tokens occur in it. A window for T has as many words as T and a SLACK more, and
starts at each of T's words; a line of more words than that is no block of T's, or any long
text without line ends would hold T's words somewhere. Tokens are put in one global order, rarest first, by the number
of documents of the whole table that contain them; only tokens of templates can
overlap, so only these are ranked. Then, for T with a least overlap of a:

* length: a block with fewer than a ranked tokens cannot match;
* prefix: the first |T| - a + 1 tokens of T form an inverted index; a matching block
  has one of them;
* position: a shared token at place i of T and j of the block (both in the global
  order) leaves an overlap of at most 1 + min(|T| - i - 1, |B| - j - 1); less than a
  is no candidate;
* candidates are verified by intersecting the full sets.

Windows go through the same filters in a form of their own. Of the text's words only
those of T are kept, with their places; then, for the window from the j-th of them,

* length: the (j + a - 1)-th must still stand in the window;
* prefix: one of the first |T| - a + 1 tokens of T must stand in it;
* verification counts the distinct tokens of T in it.

Templates are a fixed list, so the index is a constant of the plan and the join
happens inside the row: no shuffle, no row per block, and a hot source or a very
common line costs what any other row costs. All steps are Spark SQL expressions.

Edge cases: null text is ''; a text without words has n_words 0, no labels and score
0; rows that repeat an id are separate rows; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._shared import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.95
#: Further words of a window, as a share of the template's: what stands between a wrapped notice's words.
SLACK = 0.25
#: Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Wording of common licence notices, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


def words_of(text):
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _strings(values):
    """A constant array of plain words."""
    return F.expr("split('" + "|".join(values) + "', '[|]')")


def token_ranks(docs: DataFrame, text_col: str, templates) -> dict[str, int]:
    """Rank of each template token, rarest over all documents first. The result is as small as the templates."""
    vocabulary = sorted({t for _, text in templates for t in text.split()})
    found = docs.select(F.explode(F.array_intersect(words_of(ascii_lower(F.col(f"`{text_col}`"))), _strings(vocabulary))).alias("token"))
    counts = {r.token: r.n for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    blocks holds the matches: array of (block, label, containment), blocks from 0. A window's
    block is the line where it starts; a notice may be listed for its line and for several windows.
    """
    ranks = token_ranks(docs, text_col, templates)
    vocabulary = sorted(ranks, key=ranks.get)
    sets = [sorted({ranks[t] for t in text.split()}) for _, text in templates]
    least = [math.ceil(containment * len(s) - 1e-9) for s in sets]
    index: list[list] = [[] for _ in vocabulary]
    for t, (tokens, a) in enumerate(zip(sets, least)):
        for i, token in enumerate(tokens[: len(tokens) - a + 1]):
            index[token].append((t, i))
    # Constants, written as SQL: one expression each, folded once.
    listed_ = lambda rows: "array(" + ", ".join(rows) + ")"
    postings = F.expr(listed_([f"cast({listed_([f'named_struct("t", {t}, "i", {i})' for t, i in x])} as array<struct<t:int,i:int>>)" for x in index]))
    numbers = F.expr(listed_([listed_(map(str, x)) for x in sets]))
    labels, alphas, sizes = _strings([x for x, _ in templates]), F.expr(listed_(map(str, least))), F.expr(listed_([str(len(x)) for x in sets]))
    known = _strings(vocabulary)
    spans = F.expr(listed_([str(len(text.split()) + math.ceil(SLACK * len(text.split()))) for _, text in templates]))

    def as_ranks(words):
        return F.array_sort(F.transform(F.array_intersect(words, known), lambda t: (F.array_position(known, t) - 1).cast("int")))

    def overlap(block, t):
        return F.size(F.array_intersect(block, F.get(numbers, t)))

    def candidates(block):
        hits = F.flatten(F.transform(block, lambda token, j: F.transform(F.get(postings, token), lambda e: F.struct(e.t.alias("t"), e.i.alias("i"), j.alias("j")))))
        close = F.filter(hits, lambda h: 1 + F.least(F.get(sizes, h.t) - h.i - 1, F.size(block) - h.j - 1) >= F.get(alphas, h.t))
        return F.array_distinct(F.transform(close, lambda h: h.t))

    def matches(block, k, words):
        return F.transform(
            F.filter(candidates(block), lambda t: (overlap(block, t) >= F.get(alphas, t)) & (words <= F.get(spans, t))),
            lambda t: F.struct(k.alias("block"), F.get(labels, t).alias("label"), (overlap(block, t) / F.get(sizes, t)).alias("containment")),
        )

    lower = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), lower.alias("_text")).withColumn("_words", words_of(F.col("_text")))
    rows = rows.withColumn("_all", as_ranks(F.col("_words"))).withColumn("_joined", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))

    # A text whose own set does not reach any template's least overlap has no block that does.
    reached = [F.size(F.array_intersect("_all", F.expr(listed_(map(str, s))))) >= a for s, a in zip(sets, least)]
    possible = F.lit(False)
    for x in reached:
        possible = possible | x
    kind = "array<struct<block:int,label:string,containment:double>>"
    blocks = F.flatten(
        F.transform(
            F.filter(
                F.transform(F.transform(F.split("_text", "\n"), words_of), lambda w, k: F.struct(as_ranks(w).alias("b"), k.alias("k"), F.size(w).alias("n"))),
                lambda x: F.size(x.b) >= min(least, default=1),
            ),
            lambda x: matches(x.b, x.k, x.n),
        )
    ).cast(kind)
    prefixes = F.expr(listed_([listed_(map(str, x[: len(x) - a + 1])) for x, a in zip(sets, least)]))

    def in_windows(seen, t):
        """Windows of T. seen: place, rank and line of each word that any template has."""
        own = F.filter(seen, lambda h: F.array_contains(F.get(numbers, t), h.r))
        starts = F.filter(
            F.transform(own, lambda h, j: F.struct(h.alias("h"), j.alias("j"))),
            lambda x: F.coalesce(F.get(own, x.j + F.get(alphas, t) - 1).i - x.h.i < F.get(spans, t), F.lit(False)),
        )
        windows = F.transform(
            starts, lambda x: F.struct(x.h.k.alias("k"), F.filter(F.slice(own, x.j + 1, F.get(spans, t)), lambda e: e.i - x.h.i < F.get(spans, t)).alias("w"))
        )
        likely = F.filter(windows, lambda x: F.exists(x.w, lambda e: F.array_contains(F.get(prefixes, t), e.r)))
        counted = F.transform(likely, lambda x: F.struct(x.k.alias("k"), F.size(F.array_distinct(F.transform(x.w, lambda e: e.r))).alias("n")))
        return F.array_distinct(
            F.transform(
                F.filter(counted, lambda x: x.n >= F.get(alphas, t)),
                lambda x: F.struct(x.k.alias("block"), F.get(labels, t).alias("label"), (x.n / F.get(sizes, t)).alias("containment")),
            )
        )

    able = F.filter(F.array(*[F.when(x, F.lit(t)) for t, x in enumerate(reached)]), lambda t: t.isNotNull())
    placed = F.flatten(F.transform(F.split("_text", "\n"), lambda b, k: F.transform(words_of(b), lambda w: F.struct(w.alias("w"), k.alias("k")))))
    ranked = F.transform(placed, lambda x, i: F.struct(i.alias("i"), (F.array_position(known, x.w) - 1).cast("int").alias("r"), x.k.alias("k")))
    some = (F.size("_all") >= min(least, default=1)) & possible
    none = F.array().cast(kind)
    rows = rows.withColumn("_seen", F.when(some, F.filter(ranked, lambda x: x.r >= 0)))
    over = F.flatten(F.transform(able, lambda t: in_windows(F.col("_seen"), t))).cast(kind)
    rows = rows.withColumn("blocks", F.when(some, F.array_distinct(F.concat(blocks, over))).otherwise(none))

    places, base = [], []
    for phrase, label in phrases:
        tokens = phrase.split()
        here = F.filter(F.sequence(F.lit(0), F.size("_words") - len(tokens)), _stands(tokens))
        there = F.contains(F.col("_joined"), F.lit(f" {phrase} "))
        places.append(F.when(there, here).otherwise(F.array().cast("array<int>")))
        base.append(F.when(there, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_places", F.concat(*places)).withColumn("_base", F.concat(*base))
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        listed(F.col("_base")).alias("base_labels"),
        listed(F.concat("_base", F.transform("blocks", lambda m: m.label))).alias("labels"),
        F.greatest(F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("blocks", lambda m: m.containment)), F.lit(0.0))).alias("score"),
        "blocks",
    )


def _stands(tokens):
    def at(i):
        same = F.get(F.col("_words"), i) == F.lit(tokens[0])
        for k, token in enumerate(tokens[1:], 1):
            same = same & (F.get(F.col("_words"), i + k) == F.lit(token))
        return same

    return at
