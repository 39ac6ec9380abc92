"""Katz backoff language model: training counts, stored tables, and scores of all documents.

Order 2. A token's probability is the Good-Turing discounted bigram estimate where
training has the bigram, else the history's backoff weight times the unigram estimate,
where words unknown to training share the unigram mass that discounting freed. Backoff
weights are (1 - seen bigram mass) / (1 - unigram mass of the seen words), so each
history's distribution adds up to 1 exactly. Where nothing of a distribution is
discounted, since all its counts are above K, each count is taken as c / (total + 1), which
leaves 1 / (total + 1) for what was not seen; words unknown to training thus always
have a probability.

How counts meet documents: a task gathers its own documents' bigrams first, so each
moves once per task, as packed arrays, with the documents that hold it. Bigrams
are distributed by history; histories above a share of all tokens are distributed
by word instead, so no task gets a hot word's bigrams alone; whether a history is hot
changes where it is counted and nothing else. Unigram counts go only to
the shards that hold the word. Counts of counts are known only when all shards are
counted, so shards write what a document needs besides discounts (sums of logarithms, how
often each small count was met, unseen histories), and a second pass over that table
adds discounts and backoff weights. Everything gathered grows with the corpus. A task
sends a row to a shard only if it has bigrams for it, so rows are never more than
bigrams.

The shards' table is the stored model: `fit` returns it, with `words` (word, count,
probability), `bigrams` (history, word, count, probability) and `histories` (history,
total, backoff) as plain tables over it, and `evaluate` scores any other text by
recursion over these tables, token by token.

Words are told apart by 64-bit hashes.

Edge cases: null or empty text is the end token alone, and any number of such rows may
share a task; a text of any length is taken whole, if need be in a chunk of its own; a null id is hashed as '';
rows that repeat an id are scored one by one; with no training document every token
has the unknown word's probability 1, logarithm 0; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._shared import materialise, release, repeatable, slices, trim

#: Counts up to this one are discounted.
K = 5
CHARS_PER_SHARD, MIN_SHARDS = 16_000_000, 8
#: Documents' tokens that a task gathers at a time, their number, and bytes of text read at a time.
CHUNK_TOKENS, CHUNK_DOCS, SLICE_BYTES = 2_500_000, 1 << 20, 4 << 20
#: A history is hot, and so counted by word, with HOT_COUNT tokens and 1 / (4 * shards) of all: at most 4 * shards are.
HOT_COUNT = 20_000
START, END = 1, 2
BLOBS = [f"b{i}" for i in range(10)]
SHIPPED = "shard int, kind int, unit long, " + ", ".join(f"{b} binary" for b in BLOBS)
UNIGRAMS, BIGRAMS, DOCS, STATE, HISTOGRAM, HOT, MODEL, STIFF = range(8)


def held_out(doc_id) -> bool:
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def discounts(n: list[float], k: int = K) -> list[float]:
    """Factors of counts 1..k from counts of counts n[1..k+1] (n[0] unused); r / (r + 1) where Good-Turing gives none."""
    out = []
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out.append(d if 0 < d < 1 else r / (r + 1))
    return out


def word_hash(word: str) -> int:
    """0: no word; 1 and 2 are START and END."""
    import xxhash

    return 0 if word == "" else max(3, xxhash.xxh3_64_intdigest(word))


def _chunks(batches, most_docs: int = CHUNK_DOCS, most_tokens: int = CHUNK_TOKENS):
    """Tasks' documents in bounded chunks: ids, lengths, word hashes with each text's end.

    A chunk ends before a slice that would give it more documents than it may have, or so
    many words that its (history, word, document) numbers would not fit 63 bits.
    """
    import numpy as np
    import pyarrow.compute as pc

    ids, lens, words, total = [], [], [], 0
    for part in slices(batches, 1, SLICE_BYTES, min(most_docs, 1 << 16)):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column(1), "")))
        coded = lists.flatten().dictionary_encode()
        hashes = np.array([word_hash(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)], dtype=np.uint64)
        h = hashes[np.asarray(coded.indices)] if len(hashes) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
        real = h != 0
        n = np.bincount(owner[real], minlength=part.num_rows)
        out = np.full(int(n.sum()) + part.num_rows, END, dtype=np.uint64)
        inner = np.ones(len(out), dtype=bool)
        inner[np.cumsum(n + 1) - 1] = False
        out[inner] = h[real]
        if ids and (len(ids) + part.num_rows > most_docs or (total + len(out) + 1) ** 2 * (len(ids) + part.num_rows) >= 1 << 63):
            yield ids, np.concatenate(lens), np.concatenate(words)
            ids, lens, words, total = [], [], [], 0
        ids += part.column(0).to_pylist()
        lens.append(n + 1)
        words.append(out)
        total += len(out)
        if total >= most_tokens or len(ids) >= most_docs:
            yield ids, np.concatenate(lens), np.concatenate(words)
            ids, lens, words, total = [], [], [], 0
    if ids:
        yield ids, np.concatenate(lens), np.concatenate(words)


def _shard(hashes, shards: int):
    import numpy as np

    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def _histories(words, lens):
    import numpy as np

    h = np.empty_like(words)
    h[1:] = words[:-1]
    h[np.cumsum(lens) - lens] = START
    return h


def _row(shard, kind, unit, *blobs):
    return (int(shard), kind, int(unit), *[b.tobytes() for b in blobs], *[None] * (len(BLOBS) - len(blobs)))


def _squeezed(array):
    """Small numbers, compressed better than a shuffle does."""
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdCompressor(level=1).compress(array.tobytes()), dtype=np.uint8)


def _unsqueezed(blob: bytes, kind):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _batch(rows):
    import pyarrow as pa

    names = ["shard", "kind", "unit", *BLOBS]
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * len(BLOBS)]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def _cuts(sorted_values):
    """(value, from, to) of each run."""
    import numpy as np

    at = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)
    return zip(sorted_values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_values)])


def _ship_unigrams(shards: int):
    """Per word shard: words, training counts, and in which history shards the words are needed."""

    def run(batches):
        import numpy as np

        for ids, lens, words in _chunks(batches):
            train = np.repeat(~np.array([held_out(i) for i in ids]), lens)
            w, code = np.unique(words, return_inverse=True)
            count = np.bincount(code[train], minlength=len(w)).astype(np.uint32)
            need = np.unique(code.astype(np.int64) * shards + _shard(_histories(words, lens), shards))
            del code, words
            home = _shard(w, shards)
            order = np.argsort(home, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            at = place[need // shards]  # of the word, in order of its shard
            by = np.argsort(at, kind="stable")
            to = (need % shards).astype(_small(shards))[by]
            many = np.bincount(at, minlength=len(w))
            ends = np.r_[0, np.cumsum(many)]
            yield _batch([_row(s, UNIGRAMS, 0, w[order[a:b]], count[order[a:b]], many[a:b].astype(_small(shards)), to[ends[a] : ends[b]]) for s, a, b in _cuts(home[order])])
        trim()

    return run


def _small(shards: int):
    import numpy as np

    return np.uint16 if shards < 65536 else np.uint32


def _join_unigrams(shards: int, hot_count: int):
    """Total counts of a word shard's words, dealt to the shards that need them; counts of counts."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        shard, rows, small = key[0].as_py(), table.to_pylist(), _small(shards)
        w = np.concatenate([np.frombuffer(r["b0"], np.uint64) for r in rows])
        n = np.concatenate([np.frombuffer(r["b1"], np.uint32) for r in rows]).astype(np.int64)
        words, code = np.unique(w, return_inverse=True)
        total = np.bincount(code, weights=n, minlength=len(words)).astype(np.int64)
        base, pairs = 0, []
        for r in rows:
            local = code[base : base + len(r["b0"]) // 8].astype(np.int64)
            pairs.append(np.unique(np.repeat(local, np.frombuffer(r["b2"], small)) * shards + np.frombuffer(r["b3"], small)))
            base += len(local)
        pairs = np.unique(np.concatenate([*pairs, np.arange(len(words)) * shards + shard]))
        at, to = pairs // shards, pairs % shards
        known = total[at] > 0
        at, to = at[known], to[known]
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        out = [_row(s, UNIGRAMS, shard, words[at[a:b]], total[at[a:b]]) for s, a, b in _cuts(to)]
        seen = total > 0
        often = np.flatnonzero(total >= hot_count)
        out.append(_row(shard, MODEL, shard, words[seen], total[seen]))
        out.append(_row(-1, HOT, shard, words[often], total[often]))
        out.append(_row(-1, HISTOGRAM, shard, np.bincount(np.minimum(total[seen], K + 2), minlength=K + 3).astype(np.int64), np.array([total.sum(), seen.sum(), total[words == END].sum()], dtype=np.int64)))
        del rows, w, n, words, code, pairs, at, to, known, order
        out = pa.Table.from_batches([_batch(out)])
        trim()
        return out

    return run


def _hot_words(least: int):
    """Of the shards' frequent words, those with so many tokens at least."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.select(["b0", "b1"]).to_pylist():
                n = np.frombuffer(r["b1"], np.int64)
                keep = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["b0"], np.uint64)[keep].view(np.int64)), pa.array(n[keep])], names=["word", "n"])

    return run


def _hot_profiles(batches):
    """A row per hot history and shard: what the shard holds of its distribution."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for r in batch.select(["b0", "b1"]).to_pylist():
            p = np.frombuffer(r["b1"], np.float64).reshape(-1, K + 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["b0"], np.int64)), *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(K + 3)]], names=["word", *[f"p{i}" for i in range(K + 3)]])


def _ship_bigrams(shards: int, hot: list[int]):
    """Per shard: histories, their words, and the documents of each pair; and the chunk's documents."""

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        part, hot_words = TaskContext.get().partitionId(), np.array(sorted(hot), dtype=np.uint64)
        for chunk, (ids, lens, words) in enumerate(_chunks(batches)):
            unit = part << 20 | chunk
            held = np.array([held_out(i) for i in ids])
            vocabulary = np.unique(np.r_[words, np.array([START], np.uint64)])
            # One number per (history, word, document), sorted in place.
            size, many = len(vocabulary), len(ids)
            assert many <= CHUNK_DOCS and size * size * many < 1 << 63  # _chunks sees to it
            key = np.searchsorted(vocabulary, words)
            before = np.empty_like(key)
            before[1:] = key[:-1]
            before[np.cumsum(lens) - lens] = np.searchsorted(vocabulary, np.uint64(START))
            before *= size
            key += before
            del words, before
            key *= many
            key += np.repeat(np.arange(many, dtype=np.int32), lens)
            key.sort()
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[new, len(key)]).astype(np.uint32)
            key = key[new]
            doc = (key % many).astype(np.int32)
            key //= many
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            docs_of = np.diff(np.r_[first, len(key)]).astype(np.uint32)
            key = key[first]
            del new, first
            ph, pw = vocabulary[key // size], vocabulary[key % size]
            del key
            to = np.where(np.isin(ph, hot_words), _shard(pw, shards), _shard(ph, shards)).astype(np.int32)
            tag = (doc * 2 + held[doc]).astype(np.uint16 if many < 32768 else np.uint32)
            del doc
            by_pair = np.argsort(to, kind="stable").astype(np.int32)
            ends = np.r_[0, np.cumsum(docs_of[by_pair], dtype=np.int64)]
            by_doc = np.argsort(np.repeat(to, docs_of), kind="stable").astype(np.int32)
            valid = np.array([i is not None for i in ids])
            yield _batch([_row(unit % shards, DOCS, unit, np.array([i or 0 for i in ids], dtype=np.int64), valid, lens.astype(np.int64), held)])
            for s, a, b in _cuts(to[by_pair]):
                p, d = by_pair[a:b], by_doc[ends[a] : ends[b]]
                h = ph[p]
                run_start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                yield _batch([_row(s, BIGRAMS, unit, h[run_start], _squeezed(np.diff(np.r_[run_start, len(p)]).astype(np.uint32)), pw[p], _squeezed(docs_of[p]), _squeezed(tag[d]), _squeezed(count[d]))])
        trim()

    return run


def _unigram_share(count, total: int, d1: list[float], unknown: float):
    """Unigram probabilities of counts; 0 is a word unknown to training."""
    import numpy as np

    factor = np.array([0.0, *d1, 1.0])
    room = 0 if any(x < 1 for x in d1) else 1  # nothing is discounted: one more is held for the unknown
    return np.where(count > 0, factor[np.minimum(count, K + 1)] * count / max(total + room, 1), unknown)


def _score_shard(total: int, distinct: int, d1: list[float], unknown: float, hot: dict[int, int]):
    """Counts of one shard's pairs, and what its documents get from them but for bigram discounts."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        out, u, cu, h, w, n, gid, held, count = [], [], [], [], [], [], [], [], []
        shard = key[0].as_py()
        for i in range(table.num_rows):
            r = table.slice(i, 1).to_pylist()[0]
            get = lambda i, kind, r=r: np.frombuffer(r[f"b{i}"], kind)
            if r["kind"] == UNIGRAMS:
                u.append(get(0, np.uint64))
                cu.append(get(1, np.int64))
            elif r["kind"] == DOCS:
                out.append(_row(shard, DOCS, r["unit"], *[get(i, np.uint8) for i in range(4)]))
            else:
                h.append(np.repeat(get(0, np.uint64), _unsqueezed(r["b1"], np.uint32)))
                w.append(get(2, np.uint64))
                n.append(_unsqueezed(r["b3"], np.uint32))
                count.append(_unsqueezed(r["b5"], np.uint32))
                tag = _unsqueezed(r["b4"], np.uint8)
                tag = tag.view(np.uint16 if len(tag) == 2 * len(count[-1]) else np.uint32)
                gid.append((np.int64(r["unit"]) << 20) + (tag >> 1))
                held.append((tag & 1).astype(bool))
        del table
        if h:
            h, w, n, gid, held, count = map(np.concatenate, (h, w, n, gid, held, count))
            order = np.lexsort((w, h)).astype(np.int32 if len(h) < 1 << 31 else np.int64)
            hs, ws = h[order], w[order]
            del h, w
            new = np.r_[True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])]
            number = np.empty(len(hs), dtype=np.int32)
            number[order] = np.cumsum(new, dtype=np.int32) - 1
            hs, ws = hs[new], ws[new]
            at = np.repeat(number, n)  # the pair of each (pair, document)
            del order, new, number, n
            c = np.bincount(at[~held], weights=count[~held], minlength=len(hs)).astype(np.int64)
            del held
            cw = np.zeros(len(ws), dtype=np.int64)
            if u:
                u, cu = np.concatenate(u), np.concatenate(cu)
                order = np.argsort(u)
                u, cu = u[order], cu[order]
                place = np.minimum(np.searchsorted(u, ws), len(u) - 1)
                cw = np.where(u[place] == ws, cu[place], 0)
                del place, order
            p1 = _unigram_share(cw, total, d1, unknown)
            start = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
            hist = np.cumsum(np.r_[True, hs[1:] != hs[:-1]], dtype=np.int32) - 1
            names = hs[start]
            small = [np.bincount(hist[c == r], minlength=len(names)) for r in range(1, K + 1)]
            big = np.bincount(hist, weights=np.where(c > K, c, 0), minlength=len(names))
            mass = np.bincount(hist, weights=np.where(c > 0, p1, 0.0), minlength=len(names))
            ch = np.bincount(hist, weights=c, minlength=len(names))
            is_hot = np.isin(names, np.array(sorted(hot), dtype=np.uint64))
            trained = np.flatnonzero(c > 0)
            runs = np.flatnonzero(np.r_[True, hs[trained][1:] != hs[trained][:-1]]) if len(trained) else trained
            out.append(_row(shard, MODEL, 0, hs[trained][runs], np.diff(np.r_[runs, len(trained)]).astype(np.uint32), ws[trained], c[trained]))
            del trained, runs, ws
            ch[is_hot] = [hot[int(x)] for x in names[is_hot]]
            bare = (sum(small) == 0) & (ch > 0)  # nothing of these is discounted here; for hot ones, elsewhere perhaps
            room = bare & ~is_hot
            with np.errstate(divide="ignore"):
                seen = np.log10(np.maximum(c, 1)) - np.log10(np.maximum(ch + room, 1))[hist]
            value = np.where(c > 0, seen, np.log10(p1))
            base = np.log10((cw + 0.5) / (total + 0.5 * (distinct + 1)))
            docs, g = np.unique(gid, return_inverse=True)
            g = g.astype(np.int32)
            add = lambda x: np.bincount(g, weights=count * x, minlength=len(docs))
            met = np.stack([add(c[at] == r) for r in range(1, K + 1)], 1).astype(np.uint32)
            sums = (docs, add(base[at]), add(value[at]), add(cw[at] > 0).astype(np.uint32), met)
            hist_at = hist[at]
            unsure = np.flatnonzero((bare & is_hot)[hist_at] & (c[at] > 0))
            if len(unsure):
                out.append(_row(shard, STIFF, 0, gid[unsure], names[hist_at[unsure]], count[unsure]))
            miss = (c[at] == 0) & (ch[hist_at] > 0)
            used, hi = np.unique(hist_at[miss], return_inverse=True)
            profile = np.stack([*[s[used] for s in small], big[used], ch[used], mass[used]], 1).astype(np.float64)
            out.append(_row(shard, STATE, 0, *sums, g[miss].astype(np.uint32), hi.astype(np.uint32), count[miss], profile, np.where(is_hot[used], names[used], 0).astype(np.uint64)))
            hots = np.flatnonzero(is_hot)
            out.append(_row(shard, HOT, 0, names[hots], np.stack([*[s[hots] for s in small], big[hots], ch[hots], mass[hots]], 1).astype(np.float64)))
            out.append(_row(shard, HISTOGRAM, 0, np.bincount(np.minimum(c, K + 2), minlength=K + 3).astype(np.int64)))
            del hs, at, c, cw, p1, hist, hist_at, g, gid, count, seen, value, base, sums, met, miss, hi
        out = pa.Table.from_batches([_batch(out)])
        trim()
        return out

    return run


def backoff(profile, d):
    """log10 of backoff weights; profile columns: numbers of seen words with counts 1..K, mass of larger counts, count, unigram mass."""
    import numpy as np

    kept = sum(profile[:, r - 1] * r * d[r - 1] for r in range(1, K + 1)) + profile[:, K]
    ch = profile[:, K + 1]
    free = np.where(profile[:, :K].any(axis=1), 1 - kept / np.maximum(ch, 1), 1 / (ch + 1))
    return np.log10(free / (1 - profile[:, K + 2]))


def _by_unit(kind, gid, *columns):
    """One row per chunk of documents: places in the chunk, and each column's values."""
    import numpy as np

    for unit, a, b in _cuts(gid >> 20):
        yield _row(0, kind, unit, (gid[a:b] & ((1 << 20) - 1)).astype(np.uint32), *[c[a:b] for c in columns])


def _finish(d: list[float], hot: dict[int, tuple[float, float]]):
    """Discounts and backoff weights added to a shard's sums, packed by chunk of documents."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                get = lambda i, kind, r=r: np.frombuffer(r[f"b{i}"], kind)
                if r["kind"] == DOCS:
                    rows = [_row(0, DOCS, r["unit"], *[get(i, np.uint8) for i in range(4)])]
                elif r["kind"] == STATE:
                    docs, met = get(0, np.int64), get(4, np.uint32).reshape(-1, K)
                    weight, name = backoff(get(8, np.float64).reshape(-1, K + 3), d), get(9, np.uint64)
                    weight = np.array([hot[int(x)][0] if x else w for x, w in zip(name, weight)])
                    missed = np.bincount(get(5, np.uint32), weights=get(7, np.uint32) * weight[get(6, np.uint32)], minlength=len(docs)) if len(weight) else 0.0
                    rows = list(_by_unit(STATE, docs, get(3, np.uint32), get(1, np.float64), get(2, np.float64) + met @ np.log10(d) + missed))
                else:
                    names, of = np.unique(get(1, np.uint64), return_inverse=True)
                    each = get(2, np.uint32) * np.array([hot[int(x)][1] for x in names])[of]
                    docs, g = np.unique(get(0, np.int64), return_inverse=True)
                    rows = list(_by_unit(STIFF, docs, np.bincount(g, weights=each, minlength=len(docs))))
                if rows:
                    yield _batch(rows)

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _sum_unit(key, table):
    """Scores of one chunk's documents; a chunk has at most CHUNK_DOCS."""
    import numpy as np
    import pyarrow as pa

    ids = valid = lens = held = None
    sums = []
    for i in range(table.num_rows):
        r = table.slice(i, 1).to_pylist()[0]
        get = lambda i, kind, r=r: np.frombuffer(r[f"b{i}"], kind)
        if r["kind"] == DOCS:
            ids, valid, lens, held = get(0, np.int64), get(1, bool), get(2, np.int64), get(3, bool)
        elif r["kind"] == STATE:
            sums.append((get(0, np.uint32), get(1, np.uint32), get(2, np.float64), get(3, np.float64)))
        else:
            sums.append((get(0, np.uint32), None, None, get(1, np.float64)))
    known, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
    for at, k, b, s in sums:  # each document once in a row
        score[at] += s
        if k is not None:
            known[at] += k
            base[at] += b
    return pa.table({"doc_id": pa.array(ids, mask=~valid), "held_out": pa.array(held), "n_tokens": pa.array(lens), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})


class Model:
    """A trained model: its tables in the shared folder, and a few numbers."""

    def __init__(self, unigrams, state, total, distinct, d1, d2, unknown, hot):
        self.unigrams, self.state, self.total, self.distinct = unigrams, state, total, distinct
        #: Discounts by count, probability of a word unknown to training, hot histories: (log10 backoff, log10 of what a bare one's seen words lose).
        self.d1, self.d2, self.unknown, self.hot = d1, d2, unknown, hot

    def scores(self) -> DataFrame:
        """One row per document that the model was fitted with."""
        sums = self.state.filter(f"kind IN ({DOCS}, {STATE}, {STIFF})").mapInArrow(_finish(self.d2, self.hot), SHIPPED)
        scored = sums.groupBy("unit").applyInArrow(_sum_unit, RESULT)
        return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.total).cast("long").alias("train_tokens"), "base_score", "score")

    def words(self) -> DataFrame:
        """(word, count, p): training words by hash."""
        total, d1, unknown = self.total, self.d1, self.unknown

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for r in batch.select(["b0", "b1"]).to_pylist():
                    n = np.frombuffer(r["b1"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["b0"], np.int64)), pa.array(n), pa.array(_unigram_share(n, total, d1, unknown))], names=["word", "count", "p"])

        return self.unigrams.filter(f"kind = {MODEL}").mapInArrow(run, "word long, count long, p double")

    def _bigrams(self) -> DataFrame:
        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    columns = [np.repeat(np.frombuffer(r["b0"], np.int64), np.frombuffer(r["b1"], np.uint32)), np.frombuffer(r["b2"], np.int64), np.frombuffer(r["b3"], np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["history", "word", "count"])

        return self.state.filter(f"kind = {MODEL}").mapInArrow(run, "history long, word long, count long")

    def histories(self) -> DataFrame:
        """(history, total, room, backoff): the weight of the unigram model after each training history."""
        factor = F.array(*[F.lit(float(x)) for x in (*self.d2, 1.0)])
        kept = F.sum(F.col("count") * F.get(factor, (F.least("count", F.lit(K + 1)) - 1).cast("int")))
        rows = self._bigrams().join(self.words().select("word", "p"), "word")
        rows = rows.groupBy("history").agg(F.sum("count").alias("total"), kept.alias("kept"), F.sum("p").alias("share"), F.min("count").alias("least"))
        room = F.when(F.col("least") > K, 1).otherwise(0)
        free = F.when(room == 1, 1 / (F.col("total") + 1)).otherwise(1 - F.col("kept") / F.col("total"))
        return rows.select("history", "total", room.alias("room"), (free / (1 - F.col("share"))).alias("backoff"))

    def bigrams(self) -> DataFrame:
        """(history, word, count, p)."""
        factor = F.array(*[F.lit(float(x)) for x in (*self.d2, 1.0)])
        p = F.col("count") * F.get(factor, (F.least("count", F.lit(K + 1)) - 1).cast("int")) / (F.col("total") + F.col("room"))
        return self._bigrams().join(self.histories(), "history").select("history", "word", "count", p.alias("p"))

    def evaluate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_tokens, score) of any texts: the bigram's probability, else the history's weight times the word's."""
        rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for ids, lens, words in _chunks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, dtype=object), lens), pa.int64()), pa.array(_histories(words, lens).view(np.int64)), pa.array(words.view(np.int64))], names=["doc_id", "history", "word"])

        tokens = rows.mapInArrow(run, "doc_id long, history long, word long").groupBy("doc_id", "history", "word").agg(F.count("*").alias("n"))
        found = (
            tokens.join(self.bigrams().select("history", "word", F.col("p").alias("p2")), ["history", "word"], "left")
            .join(self.histories().select("history", "backoff"), "history", "left")
            .join(self.words().select("word", F.col("p").alias("p1")), "word", "left")
        )
        p = F.coalesce("p2", F.coalesce("backoff", F.lit(1.0)) * F.coalesce("p1", F.lit(self.unknown)))
        return found.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.log10(p)).alias("score"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_per_shard: int = CHARS_PER_SHARD, hot_count: int = HOT_COUNT) -> Model:
    """Counts of docs' training part, and what their scores need."""
    import numpy as np

    rows = repeatable(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(MIN_SHARDS, math.ceil(chars / chars_per_shard))
    shipped = rows.mapInArrow(_ship_unigrams(shards), SHIPPED).repartition(shards, "shard")
    dealt = materialise(shipped.groupBy("shard").applyInArrow(_join_unigrams(shards, hot_count), SHIPPED), "katz-dealt")
    unigrams = materialise(dealt.filter(f"kind = {MODEL}"), "katz-words")
    n, total, distinct, ends = np.zeros(K + 3), 0, 0, 0
    for r in dealt.filter(f"kind = {HISTOGRAM}").toLocalIterator():  # a few numbers per shard
        n += np.frombuffer(r.b0, np.int64)
        t, v, e = np.frombuffer(r.b1, np.int64)
        total, distinct, ends = total + int(t), distinct + int(v), ends + int(e)
    least = max(hot_count, total // (4 * shards) + 1)
    hot = {r.word % 2**64: r.n for r in dealt.filter(f"kind = {HOT}").mapInArrow(_hot_words(least), "word long, n long").collect()}  # at most 4 * shards
    hot.pop(END, None)
    if ends >= hot_count:
        hot[START] = ends
    d1 = discounts(list(n)) if n[1 : K + 1].any() else [1.0] * K
    kept = sum(d1[r - 1] * r * n[r] for r in range(1, K + 1)) + (total - sum(r * n[r] for r in range(1, K + 1)))
    unknown = 1.0 if not total else 1 - kept / total if n[1 : K + 1].any() else 1 / (total + 1)
    pairs = rows.mapInArrow(_ship_bigrams(shards, list(hot)), SHIPPED).unionByName(dealt.filter(f"kind = {UNIGRAMS}")).repartition(shards, "shard")
    state = materialise(pairs.groupBy("shard").applyInArrow(_score_shard(total, distinct, d1, unknown, hot), SHIPPED), "katz-state")
    release(dealt)
    n2 = np.zeros(K + 3)
    for r in state.filter(f"kind = {HISTOGRAM}").toLocalIterator():  # a few numbers per shard
        n2 += np.frombuffer(r.b0, np.int64)
    columns = [f"p{i}" for i in range(K + 3)]
    profiles = state.filter(f"kind = {HOT}").mapInArrow(_hot_profiles, "word long, " + ", ".join(f"{c} double" for c in columns))
    d2 = discounts(list(n2))
    weights = {}
    for r in profiles.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]).collect():  # at most 4 * shards
        w, p = r["word"] % 2**64, np.array(r[1:])
        p[K + 1] = hot[w]
        lost = 0.0 if p[:K].any() else math.log10(hot[w] / (hot[w] + 1))
        weights[w] = (float(backoff(p[None, :], d2)[0]), lost)
    return Model(unigrams, state, total, distinct, d1, d2, unknown, weights)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_per_shard: int = CHARS_PER_SHARD, hot_count: int = HOT_COUNT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return fit(docs, id_col, text_col, chars_per_shard, hot_count).scores()
