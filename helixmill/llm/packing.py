"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

Each input partition is tokenised and packed where it lies, in chunks of a bounded
number of tokens: whole sequences' worth of a document become sequences of their
own; the remainders, longest first, go to the sequence of the lowest cost that has
room, where a piece of n tokens costs LINEAR * n + QUADRATIC * n * n. A remainder
that overflows its sequence goes on in the next cheapest one. As many sequences are
opened as can be filled, so all come out full; the last tokens, fewer than one
sequence holds, move on to the next chunk. What a partition has left over in the
end meets that of up to TAIL_GROUP other partitions and is packed the same way,
so padding is less than one sequence per TAIL_GROUP partitions.

A task holds one slice of texts, one chunk of ids and no table of words (see
`words`), however large its partition is. Texts are not shuffled. The table of pieces is written to the shared folder once, so
a lost executor costs the partitions it had. Sequence ids follow from partition
numbers: a rerun over the same files gives the same ids.

Edge cases: null text is ''; an empty text is the end token alone; a row that
repeats another is packed again; null ids are carried; long documents are cut; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._shared import materialise, repeatable, slices, trim
from helixmill.llm.words import encoder

CAPACITY, END_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
TOKENIZER = "word_bpe_49k.json"
#: Tokens that a task packs at a time, bytes of text that it encodes at a time, and rows of a batch that it gives back.
CHUNK_TOKENS, SLICE_BYTES, PIECES = 2_000_000, 8 << 20, 1000
TAIL_GROUP = 512
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, part long, ids_crc32 long, ids binary"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def pack(lengths, capacity: int = CAPACITY, last: bool = False):
    """Lengths -> (item, start, length, sequence, offset) of each piece, and the items' leftovers (item, start, length).

    last: sequences are opened for the leftovers too.
    """
    pieces, rest, used = [], [], 0
    for i, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((i, k * capacity, capacity, used, 0))
            used += 1
        if n % capacity:
            rest.append((i, whole * capacity, n % capacity))
    total = sum(n for *_, n in rest)
    opened = -(-total // capacity) if last else total // capacity
    heap = [(0.0, used + k, 0) for k in range(opened)]
    left = []
    for i, start, n in sorted(rest, key=lambda x: (-x[2], x[0])):
        while n and heap:
            cost, sequence, filled = heapq.heappop(heap)
            take = min(n, capacity - filled)
            pieces.append((i, start, take, sequence, filled))
            start, n, filled = start + take, n - take, filled + take
            if filled < capacity:
                heapq.heappush(heap, (cost + LINEAR * take + QUADRATIC * take * take, sequence, filled))
        if n:
            left.append((i, start, n))
    return pieces, left, used + opened


class _Bundle:
    """Documents, or parts of documents, to be packed together."""

    def __init__(self, part: int, capacity: int, digest: bool):
        self.part, self.capacity, self.digest, self.items, self.tokens, self.next = part, capacity, digest, [], 0, 0

    def add(self, doc_id, start, total, ids):
        self.items.append((doc_id, start, total, ids))
        self.tokens += len(ids)

    def flush(self, last: bool, base: int):
        """Arrow batches of all full sequences; leftovers stay as items, with ids of their own."""
        found, left, used = pack([len(x[3]) for x in self.items], self.capacity, last)
        for k in range(0, len(found), PIECES):
            yield self.batch([(i, s, n, base + self.next + q, o) for i, s, n, q, o in found[k : k + PIECES]], self.digest)
        self.next += used
        self.items = [(d, a + s, t, ids[s : s + n].copy()) for i, s, n in left for d, a, t, ids in [self.items[i]]]
        self.tokens = sum(len(x[3]) for x in self.items)

    def batch(self, rows, digest: bool):
        """rows: (item, start, length, sequence or None, offset or None). digest: ids become their checksum."""
        import zlib

        import numpy as np
        import pyarrow as pa

        items = [self.items[r[0]] for r in rows]
        ids = [x[3][r[1] : r[1] + r[2]] for x, r in zip(items, rows)]
        long = lambda values: pa.array(values, type=pa.int64())
        if digest:
            blobs = pa.nulls(len(rows), pa.binary())
        else:
            bounds = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([4 * len(x) for x in ids], out=bounds[1:])
            data = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        columns = [
            long([x[0] for x in items]),
            long([x[1] + r[1] for x, r in zip(items, rows)]),
            long([r[2] for r in rows]),
            long([x[2] for x in items]),
            long([r[3] for r in rows]),
            long([r[4] for r in rows]),
            long([self.part] * len(rows)),
            long([zlib.crc32(x) for x in ids]),
            blobs,
        ]
        return pa.RecordBatch.from_arrays(columns, names=COLUMNS)

    def tail(self):
        """What is left, unplaced, with its ids."""
        return self.batch([(i, 0, len(x[3]), None, None) for i, x in enumerate(self.items)], False)


def _first(file: str, capacity: int, chunk: int, digest: bool):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words, bundle = encoder(file), _Bundle(part, capacity, digest)
        base = part << 38
        for batch in slices(batches, 1, SLICE_BYTES):
            flat, at = words.encode(batch.column(1), END_ID)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                bundle.add(doc_id, 0, b - a, flat[a:b])
                if bundle.tokens >= chunk:
                    yield from bundle.flush(False, base)
        yield from bundle.flush(False, base)
        yield bundle.tail()
        trim()

    return run


def _second(capacity: int, digest: bool):
    def run(key, group):
        import numpy as np
        import pyarrow as pa

        number = key[0].as_py()
        bundle = _Bundle(number, capacity, digest)
        rows = group.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).to_pylist()
        for r in rows:
            bundle.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], dtype="<u4"))
        return pa.Table.from_batches(bundle.flush(True, (1 << 62) + (number << 38)), schema=bundle.batch([], digest).schema)

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, chunk: int = CHUNK_TOKENS, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids (binary, little-endian unsigned 32 bits).

    digest: ids are dropped as soon as their checksum is made.
    """
    rows = repeatable(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    first = materialise(rows.mapInArrow(_first(tokenizer, capacity, chunk, digest), SCHEMA), "packed")
    # A partition's tail is less than one sequence, so a group of them is at most TAIL_GROUP sequences.
    tails = first.filter("sequence_id IS NULL")
    second = tails.groupBy(F.expr(f"part div {TAIL_GROUP}").alias("group")).applyInArrow(_second(capacity, digest), SCHEMA)
    return first.filter("sequence_id IS NOT NULL").unionByName(second).drop("part")
