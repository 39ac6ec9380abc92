"""Constrained decoding as a transition table: states, what each allows next, and traces of token arrays.

A text is begin, blocks of residues and of structure codes with free tokens between them,
end, padding. Rows say how many tokens a residue block and a structure block have. The
table is data: (state, kind of token) -> state; what is not in it is an error. A batch of
rows is run through it side by side, a token of each row at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("initial", "text", "seq", "struct", "terminal", "error")
KINDS = ("pad", "bos", "eos", "boseq", "eoseq", "bostruct", "eostruct", "seq", "struct", "other")
#: Moves that lead to another state or are an error elsewhere; text and terminal stay as they are for all other kinds.
MOVES = {
    ("initial", "pad"): "initial", ("initial", "bos"): "text",
    ("text", "boseq"): "seq", ("text", "bostruct"): "struct", ("text", "eos"): "terminal",
    ("seq", "seq"): "seq", ("seq", "eoseq"): "text",
    ("struct", "struct"): "struct", ("struct", "eostruct"): "text",
}
STAYING = ("text", "terminal")
#: What may come next, by kinds of tokens; "any" is no constraint.
ALLOWED = ("bos", "any", "eos", "seq", "eoseq", "struct", "eostruct", "pad", "none")


@dataclass(frozen=True)
class Grammar:
    """Ids of the marks, and the ids of residues and structure codes, which must not be marks."""

    pad: int
    bos: int
    eos: int
    boseq: int
    eoseq: int
    bostruct: int
    eostruct: int
    seq: tuple[int, ...]
    struct: tuple[int, ...]

    def __post_init__(self):
        every = [*self.marks(), *self.seq, *self.struct]
        if len(set(every)) != len(every):
            raise ValueError("a token has two kinds")

    def marks(self) -> list[int]:
        return [getattr(self, k) for k in KINDS[:7]]

    def ids(self, allowed: str) -> list[int] | None:
        """Ids that an entry of ALLOWED stands for; None: all."""
        return None if allowed == "any" else [] if allowed == "none" else list(getattr(self, allowed)) if allowed in ("seq", "struct") else [getattr(self, allowed)]


def transitions():
    """(states, kinds): the next state."""
    import numpy as np

    out = np.full((len(STATES), len(KINDS)), STATES.index("error"))
    for s in STAYING:
        out[STATES.index(s)] = STATES.index(s)
    for (s, k), to in MOVES.items():
        out[STATES.index(s), KINDS.index(k)] = STATES.index(to)
    return out


TRACE = "state string, allowed string, error_at int, forbidden_at int, n_seq int, n_struct int"


def trace(rows: DataFrame, grammar: Grammar, key: str, tokens: str = "tokens", seq_length: str = "seq_length", struct_length: str = "struct_length") -> DataFrame:
    """(key, TRACE): where a row's tokens lead.

    error_at: the place, from 0, of the first token that the table has no move for or that
    makes a block too long; the row stops there. forbidden_at: of the first that was not
    allowed. n_seq, n_struct: tokens of the block that is open. A null array is empty; a
    null length allows no token.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        move = transitions()
        size = max(*grammar.marks(), *grammar.seq, *grammar.struct) + 2
        kinds = np.full(size, KINDS.index("other"))
        for k, i in zip(range(7), grammar.marks()):
            kinds[i] = k
        kinds[list(grammar.seq)], kinds[list(grammar.struct)] = KINDS.index("seq"), KINDS.index("struct")
        INITIAL, TEXT, SEQ, STRUCT, TERMINAL, ERROR = range(len(STATES))
        names = {a: i for i, a in enumerate(ALLOWED)}

        def allows(state, last, n, most):
            """The entry of ALLOWED for each row."""
            inside = np.where(n == most, names["eoseq"], names["seq"])
            coded = np.where(n == most, names["eostruct"], names["struct"])
            free = np.where(last == KINDS.index("eostruct"), names["eos"], names["any"])
            return np.choose(state, [names["bos"], free, inside, coded, names["pad"], names["none"]])

        #: Whether an entry of ALLOWED holds a kind of token.
        holds = np.array([[a in (k, "any") for k in KINDS] for a in ALLOWED])
        for batch in batches:
            lists = batch.column(1)
            starts = np.asarray(lists.offsets).astype(np.int64)
            flat = np.asarray(lists.values).astype(np.int64)
            missing = np.asarray(lists.is_null())
            lengths = np.where(missing, 0, np.diff(starts))
            flat_kind = np.where((flat >= 0) & (flat < size - 1), kinds[np.clip(flat, 0, size - 1)], KINDS.index("other"))
            most = np.stack([np.asarray(batch.column(i).fill_null(0)) for i in (2, 3)])
            n = len(lengths)
            state, last = np.full(n, INITIAL), np.full(n, -1)
            count, error_at, forbidden_at = np.zeros((2, n), dtype=np.int64), np.full(n, -1), np.full(n, -1)
            order = np.argsort(-lengths, kind="stable")
            longest_first = lengths[order]
            for t in range(int(lengths.max(initial=0))):
                live = order[: np.searchsorted(-longest_first, -t, "left")]
                live = live[state[live] != ERROR]
                if not len(live):
                    break
                k = flat_kind[starts[live] + t]
                was = state[live]
                block = np.where(was == STRUCT, 1, 0)
                may = allows(was, last[live], count[block, live], most[block, live])
                no = ~holds[may, k] & (forbidden_at[live] < 0)
                forbidden_at[live[no]] = t
                to = move[was, k]
                grows = ((was == SEQ) & (k == KINDS.index("seq"))) | ((was == STRUCT) & (k == KINDS.index("struct")))
                count[block[grows], live[grows]] += 1
                to = np.where(grows & (count[block, live] > most[block, live]), ERROR, to)
                closed = ((was == SEQ) | (was == STRUCT)) & (to == TEXT)
                count[:, live[closed]] = 0
                state[live], last[live] = to, k
                error_at[live[to == ERROR]] = t
            block = np.where(state == STRUCT, 1, 0)
            may = allows(state, last, count[block, np.arange(n)], most[block, np.arange(n)])
            place = lambda a: pa.array(a.astype(np.int32), mask=a < 0)
            columns = [batch.column(0), pa.array(np.array(STATES)[state].tolist()), pa.array(np.array(ALLOWED)[may].tolist()), place(error_at), place(forbidden_at), *[pa.array(c.astype(np.int32)) for c in count]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *[x.split()[0] for x in TRACE.split(", ")]])

    wanted = rows.select(key, F.col(tokens).cast("array<long>"), F.col(seq_length).cast("long"), F.col(struct_length).cast("long"))
    return wanted.mapInArrow(run, f"`{key}` {kind}, {TRACE}")


def constrained(logits, allowed, grammar: Grammar, size: int):
    """Logits of the next token, minus infinity where `allowed` (of `trace`) does not hold the id; size: of the vocabulary."""

    def only(ids):
        there = F.lit([i in ids for i in range(size)])
        return F.transform(logits, lambda x, i: F.when(F.get(there, i), x).otherwise(F.lit(float("-inf"))))

    out = logits
    for a in ALLOWED:
        ids = grammar.ids(a)
        if ids is not None:
            out = F.when(allowed == a, only(set(ids))).otherwise(out)
    return out
