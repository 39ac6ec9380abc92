"""Token ids of whole texts, by tables of words.

Some vocabularies split texts at white space before anything else: a token never
holds a space. There a batch's distinct words are encoded once each, and texts are
put together from them by index arithmetic. Words of plain letters, nearly all
distinct ones, are merged here, all words of one length at a time: each round finds
every word's lowest-ranked pair (the leftmost of equals) and joins it, which is what the
library does word by word. All other words go to the library, and so do whole texts
if the vocabulary is of another kind. Memory is bounded by the batch, as nothing is
remembered between batches.
"""

from __future__ import annotations

import functools
import json
import os

#: Normaliser and splitter of the word-wise kind of vocabulary, as its file states them.
LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Marks that may follow a plain word and are a token run of their own there.
MARKS = ".,;:!?#$%&*"
NO_PAIR = 2**31 - 1


def located(file: str) -> str:
    if os.path.isabs(file):
        return file
    import public_tokenizers

    return public_tokenizers.path(file)


def gather(flat, bounds, picked):
    """Concatenated runs flat[bounds[i]:bounds[i + 1]] of picked, and their bounds."""
    import numpy as np

    lens = np.diff(bounds)[picked]
    out = np.zeros(len(picked) + 1, dtype=np.int64)
    np.cumsum(lens, out=out[1:])
    at = np.repeat(bounds[picked] - out[:-1], lens)
    at += np.arange(len(at))
    return flat[at], out


class Merges:
    """The merge table of a byte-level BPE vocabulary with word ends."""

    def __init__(self, model: dict):
        import numpy as np

        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = np.append(keys[order], np.int64(1) << 62), np.append(order.astype(np.int32), np.int32(0))
        self.joined = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        # Byte-level vocabularies write a byte as itself where it is printable, else as one of the characters from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        names = [chr(b) if b in printable else chr(next(others)) for b in range(256)]
        self.inner = np.array([vocab[x] for x in names], dtype=np.int32)
        self.last = np.array([vocab[x + end] for x in names], dtype=np.int32)

    def ranks(self, left, right):
        import numpy as np

        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], np.int32(NO_PAIR))

    def block(self, ids):
        """(words, n) first ids -> merged ids, -1 after each word's last."""
        import numpy as np

        done = np.full(ids.shape, -1, dtype=np.int32)
        live, rank = np.arange(len(ids)), self.ranks(ids[:, :-1], ids[:, 1:])
        while len(live) and ids.shape[1] > 1:
            row, at = np.arange(len(live)), rank.argmin(1)
            best = rank[row, at]
            ended = best == NO_PAIR
            if ended.any():
                done[live[ended], : ids.shape[1]] = ids[ended]
                go = ~ended
                live, ids, rank, at, best = live[go], ids[go], rank[go], at[go], best[go]
                row = np.arange(len(live))
            width = ids.shape[1] - 1
            cols = np.arange(width)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            ids[row, at] = self.joined[best]
            rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] >= at[:, None]), 1)
            for shift in (1, 0):  # the pairs that the joined token is in
                some = np.flatnonzero((at - shift >= 0) & (at - shift < width - 1))
                j = at[some] - shift
                rank[some, j] = self.ranks(ids[some, j], ids[some, j + 1])
        done[live, : ids.shape[1]] = ids
        return done

    def words(self, data, bounds):
        """Bytes of non-empty words and their bounds -> ids and theirs."""
        import numpy as np

        lens, counts, parts = np.diff(bounds), np.zeros(len(bounds) - 1, dtype=np.int64), []
        order = np.argsort(lens, kind="stable")
        sizes, begins = np.unique(lens[order], return_index=True)
        for n, a, b in zip(sizes, begins, [*begins[1:], len(order)]):
            for k in range(a, b, 50_000):
                rows = order[k : min(b, k + 50_000)]
                letters = data[bounds[rows][:, None] + np.arange(n)]
                ids = self.inner[letters]
                ids[:, -1] = self.last[letters[:, -1]]
                ids = self.block(ids)
                keep = ids >= 0
                counts[rows] = keep.sum(1)
                parts.append((rows, ids, keep))
        out = np.zeros(len(bounds), dtype=np.int64)
        np.cumsum(counts, out=out[1:])
        flat = np.empty(out[-1], dtype=np.uint32)
        for rows, ids, keep in parts:
            flat[(out[rows][:, None] + np.cumsum(keep, 1) - 1)[keep]] = ids[keep]
        return flat, out


def _bytes(strings):
    """Data and bounds of an Arrow string array."""
    import numpy as np

    wide = np.int64 if str(strings.type).startswith("large") else np.int32
    bounds = np.frombuffer(strings.buffers()[1], dtype=wide)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8))[: bounds[-1]], bounds


def plain(strings):
    """Which strings are letters a-z and Latin-1 letters only; their bytes with the latter in lower case, and bounds."""
    import numpy as np

    data, bounds = _bytes(strings)
    after = np.zeros(len(data), dtype=bool)  # second byte of a character from U+00C0 on
    after[1:] = data[:-1] == 0xC3
    letter = (data >= 0x61) & (data <= 0x7A) | (data == 0xC3) & ~after | after & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    upper = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    other = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~letter, out=other[1:])
    return (other[bounds[1:]] == other[bounds[:-1]]) & (bounds[1:] > bounds[:-1]), np.where(upper, data + 0x20, data).astype(np.uint8), bounds


class Encoder:
    """Ids of texts by a vocabulary file."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = located(file)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splits = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and (spec["normalizer"] or {}).get("normalizers") == LOWERED and splits[0].get("pattern") == {"Regex": SPLIT}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = Merges(model) if self.by_word else None

    def library(self, strings: list[str]):
        import numpy as np

        parts, lens = [np.zeros(0, np.uint32)], []
        for i in range(0, len(strings), 5000):
            for e in self.tokenizer.encode_batch_fast(strings[i : i + 5000], add_special_tokens=False):
                parts.append(np.array(e.ids, dtype=np.uint32))
                lens.append(len(parts[-1]))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]).astype(np.int64)

    def table(self, words):
        """Arrow strings without white space -> ids and bounds."""
        import numpy as np
        import pyarrow.compute as pc

        words = pc.if_else(pc.match_substring(words, "<"), words, pc.ascii_lower(words))  # special tokens are matched as written
        coded = pc.ascii_rtrim(words, characters=MARKS).dictionary_encode()
        stems, of = coded.dictionary, np.asarray(coded.indices)
        simple, data, bounds = plain(stems)
        rows = np.flatnonzero(simple)
        letters, ends = gather(data, bounds, rows)
        flat, at = self.merges.words(letters, ends)
        place = np.full(len(stems), -1, dtype=np.int64)
        place[rows] = np.arange(len(rows))
        head = place[of]
        marks = np.asarray(pc.binary_length(words)) - np.asarray(pc.binary_length(stems))[of]
        # Further runs after the stems': words as they are, then marks, then one without ids.
        strange, marked = np.flatnonzero(head < 0), np.flatnonzero((head >= 0) & (marks > 0))
        tails: dict[str, int] = {}
        tail_of = [tails.setdefault(w[-n:], len(tails)) for w, n in zip(words.take(_taken(marked)).to_numpy(zero_copy_only=False), marks[marked])]
        more, more_at = self.library([*words.take(_taken(strange)).to_pylist(), *tails])
        flat, at = np.concatenate([flat, more]), np.concatenate([at, at[-1] + more_at[1:], [at[-1] + more_at[-1]]])
        pair = np.full((len(head), 2), len(at) - 2, dtype=np.int64)
        pair[:, 0] = head
        pair[strange, 0] = len(rows) + np.arange(len(strange))
        if len(marked):
            pair[marked, 1] = len(rows) + len(strange) + np.array(tail_of)
        flat, at = gather(flat, at, pair.ravel())
        return flat, at[::2]

    def encode(self, texts, end: int):
        """Arrow strings -> ids of all texts, each with `end` after it, and bounds."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        if self.by_word:
            lists = pc.ascii_split_whitespace(texts)
            coded = lists.flatten().dictionary_encode()
            offsets = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
            flat, at = gather(*self.table(coded.dictionary.cast(pa.string())), np.asarray(coded.indices))
            at = at[offsets]
        else:
            flat, at = self.library(texts.to_pylist())
        return np.insert(flat, at[1:], np.uint32(end)), at + np.arange(len(at))


def _taken(rows):
    import pyarrow as pa

    return pa.array(rows, type=pa.int64())


@functools.cache
def encoder(file: str) -> Encoder:
    """One per worker and file: the vocabulary is loaded once."""
    return Encoder(file)
