"""Near-duplicate vectors by an epsilon grid order join.

Cosine at least t means that unit vectors are within epsilon = sqrt(2 - 2 t). Vectors are
projected on leading principal directions, sorted by grid cells of width epsilon there, and
the sequence is cut into blocks. Blocks meet if a cell of one is next to a cell of the other
and their boxes are within epsilon; a meeting halves both sequences again and again and skips
halves whose boxes are farther apart. What remains is compared in double precision.

Equal vectors meet before and count once. Meetings return counts and spanning edges, not
pairs, so a dense group costs its comparisons but never its pairs in rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, staged

#: Leading directions for boxes, and how many of them make grid cells.
DIRECTIONS, CELL_DIRECTIONS = 8, 3
#: Vectors that the directions are fitted on, chosen by hash. They steer speed, not results.
FIT_ROWS = 8_000
#: Vectors in a block, the unit that travels, and in a leaf, the least interval of its sequence.
BLOCK, LEAF = 4096, 128
SLACK = 1e-6

ROWS = "vec_id long, dim int, key_hi long, key_lo long, body binary"
BLOCKS = "block long, dim int, cells array<string>, near array<string>, boxes binary, ids array<long>, copies array<long>, vectors binary"


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Every row with its vector as doubles and a 128-bit name of it; both null where it can't link."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            dims, hi, lo, body = [], [], [], []
            for v in batch.column(1):
                own = None
                if v.is_valid and len(v) and not v.values.null_count:
                    own = v.values.to_numpy().astype("<f8") + 0.0  # minus zero is zero
                    own = own if np.isfinite(own).all() and np.any(own) else None
                name = xxhash.xxh128_digest(own.tobytes()) if own is not None else None
                dims.append(len(own) if own is not None else None)
                hi.append(int.from_bytes(name[:8], "big", signed=True) if name else None)
                lo.append(int.from_bytes(name[8:], "big", signed=True) if name else None)
                body.append(own.tobytes() if own is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(body, pa.binary())], ["vec_id", "dim", "key_hi", "key_lo", "body"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, ROWS)


def _unit(v):
    """Unit vector; scaled first, so that neither huge nor tiny values overflow."""
    import numpy as np

    v = v / np.abs(v).max(-1, keepdims=True)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def principal_directions(reps: DataFrame):
    """(dimension, directions as columns) of the sample's most common dimension."""
    import numpy as np

    n = reps.count()
    if not n:
        return 0, np.zeros((0, 0))
    share = min(1.0, FIT_ROWS / n)
    rows = reps.where(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1_000_000)) < share * 1_000_000).select("dim", "body").limit(2 * FIT_ROWS).collect()
    if not rows:
        return 0, np.zeros((0, 0))
    dims = [r["dim"] for r in rows]
    dim = max(sorted(set(dims)), key=dims.count)
    x = _unit(np.stack([np.frombuffer(r["body"]) for r in rows if r["dim"] == dim]))
    x = x - x.mean(0)
    return dim, np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :DIRECTIONS]


def _spots(units, dim: int, main: int, directions):
    """Projections on the principal directions, of other dimensions on the first coordinates."""
    import numpy as np

    spots = units @ directions if dim == main else units[:, :DIRECTIONS]
    return np.pad(spots, ((0, 0), (0, DIRECTIONS - spots.shape[1])))


def _boxes(spots):
    """Per leaf the least and the greatest projection in each direction."""
    import numpy as np

    at = np.arange(0, len(spots), LEAF)
    return np.stack([np.minimum.reduceat(spots, at), np.maximum.reduceat(spots, at)], 1)


def sequence_blocks(reps: DataFrame, epsilon: float, main: int, directions) -> DataFrame:
    """Representatives in epsilon grid order, cut into blocks with their cells and their leaves' boxes."""
    import itertools

    import numpy as np

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            cells, spots = [], []
            for dim, body in zip(batch.column("dim").to_pylist(), batch.column("body").to_pylist()):
                spot = _spots(_unit(np.frombuffer(body))[None], dim, main, directions)[0]
                spots.append(spot)
                cells.append(np.floor(spot / epsilon).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64())), pa.array(spots, pa.list_(pa.float64()))], [*batch.schema.names, "cell", "spot"])

    order = [F.col("dim"), *(F.element_at("cell", k + 1) for k in range(DIRECTIONS)), F.element_at("spot", 1), F.col("rep")]
    spread = reps.mapInArrow(placed, "rep long, copies long, dim int, body binary, cell array<long>, spot array<double>")
    ordered = staged(spread, "grid-cells").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, nth, held = TaskContext.get().partitionId(), 0, []

        def close():
            spots = np.array([r["spot"] for r in held])
            own = sorted({tuple(r["cell"][:CELL_DIRECTIONS]) for r in held})
            near = sorted({tuple(c + d for c, d in zip(cell, step)) for cell in own for step in itertools.product((-1, 0, 1), repeat=CELL_DIRECTIONS)})
            spell = lambda cells: [",".join(map(str, c)) for c in cells]
            row = {
                "block": part << 32 | nth, "dim": held[0]["dim"], "cells": spell(own), "near": spell(near), "boxes": _boxes(spots).tobytes(),
                "ids": [r["rep"] for r in held], "copies": [r["copies"] for r in held], "vectors": _shorter(b"".join(r["body"] for r in held)),
            }
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == BLOCK or held[-1]["dim"] != r["dim"]):
                    yield close()
                    nth, held = nth + 1, []
                held.append(r)
        if held:
            yield close()

    return staged(ordered.mapInArrow(cut, BLOCKS), "grid-blocks")


def _shorter(body: bytes) -> bytes:
    """Doubles as floats where no bit is lost, after a byte that says which."""
    import numpy as np

    x = np.frombuffer(body)
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return b"f" + small.tobytes() if np.array_equal(small.astype("<f8"), x) else b"d" + body


def _vectors(body: bytes, n: int):
    import numpy as np

    return np.frombuffer(body, "<f4" if body[:1] == b"f" else "<f8", offset=1).astype("<f8").reshape(n, -1)


def _near_leaves(a, b, epsilon: float):
    """Pairs of leaves whose boxes are within epsilon: halves of both sequences, halved again while near."""
    import numpy as np

    def gap(i, j, k, m):
        g = np.maximum(0, np.maximum(a[i:j, 0].min(0) - b[k:m, 1].max(0), b[k:m, 0].min(0) - a[i:j, 1].max(0)))
        return g @ g > (epsilon + SLACK) ** 2

    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if gap(i, j, k, m):
            continue
        if j - i == 1 and m - k == 1:
            found.append((i, k))
            continue
        left = [(i, j)] if j - i == 1 else [(i, (i + j) // 2), ((i + j) // 2, j)]
        right = [(k, m)] if m - k == 1 else [(k, (k + m) // 2), ((k + m) // 2, m)]
        todo += [(*x, *y) for x in left for y in right]
    return found


def meeting_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a <= b) of blocks that may hold links: neighbouring cells, and leaves with boxes within epsilon."""
    import numpy as np

    one = blocks.select(F.col("block").alias("a"), "dim", F.explode("cells").alias("cell"))
    two = blocks.select(F.col("block").alias("b"), "dim", F.explode("near").alias("cell"))
    pairs = one.join(two, ["dim", "cell"]).where("a <= b").select("a", "b").distinct()
    ends = pairs.join(blocks.select(F.col("block").alias("a"), F.col("boxes").alias("x")), "a").join(blocks.select(F.col("block").alias("b"), F.col("boxes").alias("y")), "b")

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = ([np.frombuffer(v).reshape(-1, 2, DIRECTIONS) for v in batch.column(k).to_pylist()] for k in (2, 3))
            keep = [bool(_near_leaves(p, q, epsilon)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return ends.select("a", "b", "x", "y").mapInArrow(near, "a long, b long")


def cosine_links(x, y, threshold: float, ux, uy):
    """Which rows link. Values next to the threshold are decided by the plain formula."""
    import numpy as np

    c = ux @ uy.T
    links = c >= threshold
    for i, j in np.argwhere(np.abs(c - threshold) < 1e-9).tolist():
        s, t = x[i] / np.abs(x[i]).max(), y[j] / np.abs(y[j]).max()
        links[i, j] = s @ t / math.sqrt((s @ s) * (t @ t)) >= threshold
    return links


def _spanning(links, ia, ib) -> list[tuple[int, int]]:
    """Edges that join what `links` joins: labels fall to the least in reach, and members name theirs."""
    import numpy as np

    ids = np.concatenate([ia, ib])
    la, lb = np.arange(len(ia)), np.arange(len(ib)) + len(ia)
    while True:
        ma = np.minimum(la, np.where(links, lb[None], len(ids)).min(1))
        mb = np.minimum(lb, np.where(links, ma[:, None], len(ids)).min(0))
        if (ma == la).all() and (mb == lb).all():
            break
        la, lb = ma, mb
    label = np.concatenate([la, lb])
    return [(u, v) for u, v in zip(ids.tolist(), ids[label].tolist()) if u != v]


def near_duplicates(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other vectors with cosine >= threshold), component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite values, link with
    nothing; so do vectors of different lengths. Equal vectors, and repeated rows, link with
    each other. A null id keeps its row, counts as a link of others, and never names a
    component unless all ids of it are null. An empty table gives no rows. Labels and other
    columns are not read.
    """
    import numpy as np

    epsilon = math.sqrt(2 - 2 * threshold)
    rows = staged(usable(table, id_col, vector_col), "vectors")
    name = ["dim", "key_hi", "key_lo"]
    names = staged(
        rows.where("body is not null").groupBy(*name).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("body").alias("body"))
        .withColumn("rep", F.coalesce("least", -1 - F.pmod(F.xxhash64(*name), F.lit(1 << 62)))),
        "vector-names",
    )
    reps = names.select("rep", "copies", "dim", "body")
    main, directions = principal_directions(reps)
    blocks = sequence_blocks(reps, epsilon, main, directions)
    pairs = staged(meeting_blocks(blocks, epsilon), "meeting-blocks")
    load = ["ids", "copies", "vectors"]
    met = pairs.join(blocks.select(F.col("block").alias("a"), "dim", *(F.col(c).alias(f"{c}_a") for c in load)), "a").join(blocks.select(F.col("block").alias("b"), *(F.col(c).alias(f"{c}_b") for c in load)), "b")

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                ia, ib, ca, cb = (np.array(r[c], np.int64) for c in ("ids_a", "ids_b", "copies_a", "copies_b"))
                xa, xb = _vectors(r["vectors_a"], len(ia)), _vectors(r["vectors_b"], len(ib))
                ua, ub = _unit(xa), _unit(xb)
                same = r["a"] == r["b"]
                na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
                spots = [_boxes(_spots(u, r["dim"], main, directions)) for u in (ua, ub)]
                edges: set = set()
                for p, q in _near_leaves(*spots, epsilon):
                    if same and q < p:
                        continue  # the mirror image
                    at, to = slice(p * LEAF, (p + 1) * LEAF), slice(q * LEAF, (q + 1) * LEAF)
                    links = cosine_links(xa[at], xb[to], threshold, ua[at], ub[to])
                    if same and p == q:
                        np.fill_diagonal(links, False)
                    if not links.any():
                        continue
                    na[at] += links @ cb[to]
                    if not (same and p == q):
                        (na if same else nb)[to] += links.T @ ca[at]
                    edges.update(_spanning(links, ia[at], ib[to]))
                some, any_b = np.flatnonzero(na), np.flatnonzero(nb)
                u, v = zip(*edges) if edges else ((), ())
                n = len(some) + len(any_b)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*ia[some].tolist(), *ib[any_b].tolist(), *u], pa.int64()),
                        pa.array([*na[some].tolist(), *nb[any_b].tolist(), *[0] * len(u)], pa.int64()),
                        pa.array([None] * n + list(v), pa.int64()),
                    ],
                    ["u", "n", "v"],
                )

    found = staged(met.mapInArrow(meet, "u long, n long, v long"), "vector-links")
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    components = connected_components(found.where("v is not null").select("u", "v"), "vector-components").withColumnRenamed("id", "rep")
    # A component whose least member has no id takes the least id among its members that have one.
    told = names.join(components, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    by_name = told.join(counts, "rep", "left").join(least, "component").select(*name, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return (
        rows.drop("body").join(by_name, name, "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
