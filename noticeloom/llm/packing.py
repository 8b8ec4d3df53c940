"""Best-fit packing of documents into sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import Encoder
from .shared import give_back, small_batches, staged, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Best fit, longest first, over counts of lengths: runs of slots, and the sequences used.

    A run (length, first rank, items per sequence, first sequence, offset) places the
    pieces of one length from that rank on. Sequences of equal fill are one entry, so the
    work and the runs depend on the number of lengths (at most `capacity`), not on rows.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some sequence has room r
    runs, used = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fits = filled >> length
            if fits:
                r = length + (fits & -fits).bit_length() - 1
                first, n = room[r].pop()
                if not room[r]:
                    filled ^= 1 << r
            else:
                r = capacity
                first, n = used, -(-left // (capacity // length))
                used += n
            each = min(r // length, left)
            take = min(n, left // each)
            runs.append((length, rank, each, first, capacity - r))
            if n > take:
                room[r].append((first + take, n - take))
                filled |= 1 << r
            if r - each * length:
                room[r - each * length].append((first, take))
                filled |= 1 << (r - each * length)
            rank += take * each
            left -= take * each
    return runs, used


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most `capacity` ids, with its number among the task's pieces of that length."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        give_back()
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(text_bytes(batch.column(1)))):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document's ids in sequences of at most `capacity` ids, best fit first.

    Result, one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A document is its ids and then `end_id`; null and empty texts are the end id alone. Only
    longer documents are cut. Repeated rows, repeated ids and null ids are packed like any
    other row. An empty table gives no rows. Columns besides id and text are ignored.

    Shuffles only piece rows (no text, no ids). The histogram has at most `capacity` rows,
    so the plan is bounded; ranks within a length come from counts per task and length, so
    a length that most pieces share is not gathered anywhere.
    """
    pieces = staged(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_slots(histogram, capacity)
    ranked = pieces.join(base, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )

    slots = docs.sparkSession.sparkContext.broadcast(sorted(runs))  # as many as there are lengths and fills: bounded by the capacity

    def place(batches):
        import numpy as np
        import pyarrow as pa

        step = 1 << 48  # more than the ranks of any length
        table = np.array(slots.value, np.int64).reshape(-1, 5)
        keys = table[:, 0] * step + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = table[np.searchsorted(keys, length * step + rank, "right") - 1]
            nth, each = rank - row[:, 1], row[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + nth // each), pa.array(row[:, 4] + nth % each * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
