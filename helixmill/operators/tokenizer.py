"""Vocabulary tokenizers: ordered splits, presets, padded batches and alignment matrices.

A text is cut at every vocabulary token in the order of the vocabulary: at the leftmost
places of the first token, then, in what is left, at those of the second, and so on; white
space beside a token goes with it. What is left at last is no token: an error, or, where
asked for, the unknown token for each of its characters that is not white space.

Texts go through Arrow. Where every token of more than one character is one that begins
with '<', rows without that sign are looked up byte by byte in one pass over a batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.sequence import ESM_TOKENS, padded

#: The standard tokens of the presets, in order.
STANDARD = tuple(t for t in ESM_TOKENS if len(t) == 1)
#: Name -> tokens before and after the standard ones, begin and end marks, alignments.
PRESETS = {
    "esm1": (("<null_0>", "<pad>", "<eos>", "<unk>"), ("<cls>", "<mask>", "<sep>"), True, False, False),
    "esm1b": (("<cls>", "<pad>", "<eos>", "<unk>"), ("<mask>",), True, True, False),
    "msa": (("<cls>", "<pad>", "<eos>", "<unk>"), ("<mask>",), True, False, True),
    "gvp": (("<null_0>", "<pad>", "<eos>", "<unk>"), ("<mask>", "<cath>", "<af2>"), True, False, False),
}
#: Other names of the presets.
NAMES = {"ESM-1": "esm1", "protein_bert_base": "esm1", "ESM-1b": "esm1b", "roberta_large": "esm1b", "MSA Transformer": "msa", "msa_transformer": "msa"}


@dataclass(frozen=True)
class Alphabet:
    """A vocabulary: before + standard, filled up to a multiple of eight, + after."""

    standard: tuple[str, ...]
    before: tuple[str, ...] = ("<null_0>", "<pad>", "<eos>", "<unk>")
    after: tuple[str, ...] = ("<cls>", "<mask>", "<sep>")
    begin: bool = True
    end: bool = False
    alignments: bool = False

    @classmethod
    def preset(cls, name: str) -> Alphabet:
        key = NAMES.get(name, "gvp" if "invariant_gvp" in name.lower() else name)
        if key not in PRESETS:
            raise ValueError(f"unknown preset {name}; there are {', '.join([*PRESETS, *NAMES])}")
        return cls(STANDARD, *PRESETS[key])

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        head = (*self.before, *self.standard)
        return (*head, *(f"<null_{i + 1}>" for i in range(-len(head) % 8)), *self.after)

    @cached_property
    def index(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    def id_of(self, token: str) -> int:
        return self.index.get(token, self.index["<unk>"])

    @property
    def plain(self) -> bool:
        """Whether texts without '<' can be read character by character."""
        return all(len(t) == 1 and t.isascii() and not t.isspace() or t.startswith("<") for t in self.tokens)

    def split(self, text: str) -> list[str]:
        """Tokens of a text by ordered splits; what is no token comes out by words."""
        pieces = [(False, text)]
        for token in self.tokens:
            if token not in text:
                continue
            cut = re.compile(rf"\s*({re.escape(token)})\s*")
            pieces = [part for known, piece in pieces for part in ([(True, piece)] if known else [(k % 2 == 1, x) for k, x in enumerate(cut.split(piece)) if x])]
        return [w for known, piece in pieces for w in ([piece] if known else piece.split())]

    def ids(self, text, unknown: str = "error") -> Column:
        """Token ids of a text column. unknown: "error", or "unk" for one unknown token a character. Null stays null."""
        return _encoder(self, unknown)(text)

    def encoded(self, text, truncate: int | None = None, unknown: str = "error") -> Column:
        """Ids, cut after `truncate`, with the begin and end marks of the alphabet."""
        ids = self.ids(text, unknown)
        ids = F.slice(ids, 1, truncate) if truncate else ids
        parts = [*([F.array(F.lit(self.id_of("<cls>")))] if self.begin else []), ids, *([F.array(F.lit(self.id_of("<eos>")))] if self.end else [])]
        return F.concat(*parts)

    def batches(self, rows: DataFrame, batch: str, text: str, truncate: int | None = None, unknown: str = "error") -> DataFrame:
        """rows with `ids`, all as long as the longest of their batch."""
        coded = rows.withColumn("ids", self.encoded(F.col(text), truncate, unknown))
        width = coded.groupBy(batch).agg(F.max(F.size("ids")).alias("_w"))
        return coded.join(width, batch).withColumn("ids", padded(F.col("ids"), F.col("_w"), self.id_of("<pad>"))).drop("_w")

    def matrices(self, rows: DataFrame, key: str, text: str, truncate: int | None = None, batch: str | None = None) -> DataFrame:
        """Rows of alignments with `ids`, and the depth and width that their batch's tensor has.

        An alignment (key) whose texts differ in length is an error. Rows of an alignment
        stay apart: no task holds a whole one. batch: alignments that share a tensor;
        without it each has its own.
        """
        sizes = rows.groupBy(*dict.fromkeys([key, *([batch] if batch else [])])).agg(F.min(F.length(text)).alias("_lo"), F.max(F.length(text)).alias("_hi"), F.count("*").alias("depth"))
        marks = int(self.begin) + int(self.end)
        unequal = F.raise_error(F.concat(F.lit("unequal lengths in "), F.col(key).cast("string")))
        coded = rows.withColumn("ids", self.encoded(F.col(text), truncate)).join(sizes.drop(batch) if batch and batch != key else sizes, key)
        coded = coded.withColumn("ids", F.when(F.col("_lo") != F.col("_hi"), unequal).otherwise(F.col("ids"))).withColumn("width", (F.col("_hi") + marks).cast("int"))
        if batch and batch != key:
            most = sizes.groupBy(batch).agg(F.max("depth").alias("depth"), (F.max("_hi") + marks).cast("int").alias("width"))
            coded = coded.drop("depth", "width").join(most, batch)
        return coded.withColumn("ids", padded(F.col("ids"), F.greatest(F.col("width"), F.size("ids")), self.id_of("<pad>"))).drop("_lo", "_hi")


def _encoder(alphabet: Alphabet, unknown: str):
    if unknown not in ("error", "unk"):
        raise ValueError(f"unknown is {unknown}, neither error nor unk")
    lenient, unk, plain, index = unknown == "unk", alphabet.id_of("<unk>"), alphabet.plain, alphabet.index

    def by_rule(text: str) -> list[int]:
        out = []
        for token in alphabet.split(text):
            if token in index:
                out.append(index[token])
            elif lenient:
                out += [unk] * len(re.sub(r"\s", "", token))
            else:
                raise ValueError(f"unknown token: {token}")
        return out

    @F.arrow_udf("array<int>")
    def encode(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string())
        table = np.full(256, -2, dtype=np.int32)  # -2: not in the vocabulary, -1: nothing
        table[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = -1
        for token, i in index.items():
            if len(token) == 1 and token.isascii():
                table[ord(token)] = i
        if lenient:
            table[table == -2] = unk
            table[128:192] = -1  # the rest of a character
        special = pc.fill_null(pc.match_substring(texts, "<"), False)
        if not lenient:  # white space beyond ASCII is told by the rule
            special = pc.or_(special, pc.invert(pc.fill_null(pc.string_is_ascii(texts), True)))
        slow = np.flatnonzero(np.asarray(special)) if plain else np.arange(len(texts))
        rows = texts if not len(slow) else pc.replace_with_mask(texts, pa.array(np.isin(np.arange(len(texts)), slow)), pa.array([""] * len(slow), pa.large_string()))
        offsets = np.frombuffer(rows.buffers()[1], dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1]
        data = rows.buffers()[2]
        codes = table[np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.empty(0, np.int32)
        if (codes == -2).any():
            at = int(np.flatnonzero(codes == -2)[0]) + offsets[0]
            by_rule(rows[int(np.searchsorted(offsets, at, "right")) - 1].as_py())
        kept = codes >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
        values, lists = codes[kept], None
        if len(slow):
            lists = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for i in slow:
                text = texts[int(i)].as_py()
                lists[int(i)] = np.array(by_rule(text) if text is not None else [], dtype=np.int32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            values = np.concatenate(lists)
        out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))
        missing = np.asarray(pc.is_null(texts))
        return pc.if_else(pa.array(missing), pa.scalar(None, out.type), out) if missing.any() else out

    return encode


#: The marks of both modalities in a joint vocabulary, by what they stand for.
MODAL = {"aa": {"cls": "<cls_aa>", "eos": "<eos_aa>", "unk": "<unk_aa>", "mask": "<mask_aa>"}, "struct": {"cls": "<cls_struct>", "eos": "<eos_struct>", "unk": "<unk_struct>", "mask": "<mask_struct>"}}


def modal_ids(vocabulary: list[str], modality: str, pad: str = "<pad>"):
    """A function from a column of tokens (an array of strings) to ids of one modality of a joint vocabulary, between its cls and eos.

    A token's id is its place in the vocabulary; what it lacks, null included, is the modality's unknown. Null and empty arrays
    give the two marks alone. The vocabulary belongs to a model; it goes to the workers with the function.
    """
    index = {t: i for i, t in enumerate(vocabulary)}
    lacking = [t for t in (*MODAL[modality].values(), pad) if t not in index]
    if lacking:
        raise ValueError(f"the vocabulary lacks {lacking}")
    first, last, unknown = (index[MODAL[modality][n]] for n in ("cls", "eos", "unk"))

    @F.pandas_udf("array<int>")
    def ids(tokens):
        import pandas as pd

        return pd.Series([[first, *(index.get(t, unknown) for t in ([] if x is None else x)), last] for x in tokens])

    return ids
