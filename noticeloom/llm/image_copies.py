"""Cropped or edited copies of images by local descriptors and geometric consensus.

Every image gives corners on several scales, each with the orientation of its surroundings
and 256 brightness tests turned to that orientation. Equal 32-bit words at one place of two
descriptors put them in one entry of a Hamming table. Corners of an entry meet if 128 coarser
tests of their wider surroundings nearly agree. Images of which two corners or more meet with about
the same turn are copies if enough of all their matching corners agree on one shift, turn and scale.

Equal images meet before and count once. First, in half of the tables, an entry's corners meet
those of its first image only, and each image is tried against the one it met most: that joins most
copies. Then, in all tables, corners meet whose images' components still differ. Entries are streams in order: no task holds an entry, and the
tables are worked on a few at a time, so that their entries do not all lie on disk at once.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, give_back, let_go, small_batches, staged, unstage

#: Scales of the pyramid, corners kept on each (the strongest) up to AREA pixels and in proportion beyond, and tests of a descriptor.
SCALES, CORNERS, TESTS = (1.0, 1.41, 2.0), (28, 18, 10), 256
PATCH, AREA = 10, 96 * 96
#: Coarse tests of a corner, how much wider than the descriptor's, over squares of which half side.
WIDE, WIDER, WIDE_BOX = 128, 3.5, 4
#: 32-bit words of a descriptor that make table entries, and the most bits in which matches differ.
WORDS, MOST_BITS = TESTS // 32, 32
#: Coarse tests in which corners that meet may differ; pairs of corners that make two images a candidate by meeting, and the least
#: length of the sum of their turns as unit vectors: two turns of up to 36 degrees apart reach it.
WIDE_BITS, MEETINGS, TURNED = 28, 2, 1.9
#: Steps of a full turn in which entries tell angles.
STEPS = 256
#: Corners of an entry that meet in one block; longer entries meet block by block.
BLOCK = 4096
#: Tables in which images first meet an entry's first one, and tables whose entries are shuffled at a time.
FIRST, AT_A_TIME = WORDS // 2, 2
#: Rows of sorted entries that a task works on at a time.
ROWS = 1 << 18
#: Matches that must agree, and how far (pixels) a match may be off the common motion.
AGREEING, REACH = 8, 4.0

#: A corner, packed: place, scale, angle, tests and coarse tests.
POINT = [("x", "<f4"), ("y", "<f4"), ("size", "<f4"), ("angle", "<f4"), ("bits", "u1", (TESTS // 8,)), ("wide", "u1", (WIDE // 8,))]


def decode(body: bytes | None):
    """Grey values of a binary PGM or PPM; None for null, other or broken content."""
    import re

    import numpy as np

    found = re.match(rb"P([56])(?:\s|#.*\n)+(\d+)(?:\s|#.*\n)+(\d+)(?:\s|#.*\n)+(\d+)\s", body or b"")
    if not found or int(found[4]) > 255:
        return None
    w, h, depth = int(found[2]), int(found[3]), 1 if found[1] == b"5" else 3
    if len(body) - found.end() < w * h * depth or not w or not h:
        return None
    pixels = np.frombuffer(body, np.uint8, w * h * depth, found.end()).astype(np.float32)
    return pixels.reshape(h, w) if depth == 1 else pixels.reshape(h, w, 3).mean(2)


def encode(pixels) -> bytes:
    """A binary PGM of grey values from 0 to 255."""
    import numpy as np

    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def _box(a, r: int):
    """Mean over squares of side 2 r + 1, with edges repeated."""
    import numpy as np

    s = np.pad(a, ((r + 1, r), (r + 1, r)), "edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2


def _shrunk(a, scale: float):
    """The image on a coarser grid, bilinear."""
    import numpy as np

    h, w = (int(n / scale) for n in a.shape)
    y, x = (np.arange(h) + 0.5) * scale - 0.5, (np.arange(w) + 0.5) * scale - 0.5
    y, x = np.clip(y, 0, a.shape[0] - 1.001), np.clip(x, 0, a.shape[1] - 1.001)
    i, j, fy, fx = y.astype(int), x.astype(int), (y % 1)[:, None], (x % 1)[None]
    top = a[i][:, j] * (1 - fx) + a[i][:, j + 1] * fx
    low = a[i + 1][:, j] * (1 - fx) + a[i + 1][:, j + 1] * fx
    return top * (1 - fy) + low * fy


@functools.cache
def _tests():
    """The same pairs of places around a corner everywhere: 256 pairs within the patch."""
    import numpy as np

    r = np.random.default_rng(11)
    return np.clip(r.normal(0, PATCH / 2.2, (2, TESTS, 2)), -(PATCH - 3), PATCH - 3)


def descriptors(pixels) -> list[tuple]:
    """(x, y, size, angle, bits, wide) of an image's corners, in its own pixels."""
    import numpy as np

    tests, out = _tests(), []
    yy, xx = np.mgrid[-7:8, -7:8]
    disc = yy**2 + xx**2 <= 49
    for scale, most in zip(SCALES, CORNERS):
        a = pixels if scale == 1 else _shrunk(_box(pixels, 1), scale)
        if min(a.shape) < 2 * PATCH + 6:
            continue
        soft = _box(a, 1)
        gy, gx = np.gradient(soft)
        xx2, yy2, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx2 * yy2 - xy * xy - 0.05 * (xx2 + yy2) ** 2
        edge = PATCH + 2
        h, w = strength.shape
        rows = strength[edge - 2 : h - edge - 2]
        for k in range(1, 5):
            rows = np.maximum(rows, strength[edge - 2 + k : h - edge - 2 + k])
        peak = rows[:, edge - 2 : w - edge - 2]
        for k in range(1, 5):
            peak = np.maximum(peak, rows[:, edge - 2 + k : w - edge - 2 + k])
        inner = strength[edge : h - edge, edge : w - edge]
        y, x = np.nonzero((inner >= peak) & (inner > 1.0))
        y, x = y + edge, x + edge
        best = np.lexsort((x, y, -strength[y, x]))[: -(-most * max(AREA, pixels.size) // AREA)]
        y, x = y[best], x[best]
        if not len(y):
            continue
        around = soft[y[:, None, None] + yy, x[:, None, None] + xx] * disc
        angle = np.arctan2((around * yy).sum((1, 2)), (around * xx).sum((1, 2)))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def told(image, sides):
            values = []
            for side in sides:
                px, py = side[:, 0][None], side[:, 1][None]
                i, j = np.rint(y[:, None] + s * px + c * py).astype(int), np.rint(x[:, None] + c * px - s * py).astype(int)
                values.append(image[i.clip(0, h - 1), j.clip(0, w - 1)])
            return np.packbits(values[0] < values[1], axis=1)

        bits, wide = told(soft, tests), told(_box(a, WIDE_BOX), WIDER * tests[:, :: TESTS // WIDE])
        out += [((float(i) + 0.5) * scale, (float(j) + 0.5) * scale, scale, float(t), b.tobytes(), v.tobytes()) for i, j, t, b, v in zip(x, y, angle, bits, wide)]
    return out


def table_keys(bits):
    """The table entries of descriptors' packed bits: every word, with its place."""
    import numpy as np

    words = np.ascontiguousarray(bits).reshape(-1, WORDS, TESTS // 8 // WORDS).view("<u4")[:, :, 0]
    return words.astype(np.int64) + (np.arange(WORDS, dtype=np.int64) << 48)


def agreeing(matches) -> int:
    """Most matches that one motion explains. `matches`: x, y, size, angle there and here.

    Every match proposes a shift, turn and scale; proposals count the matches whose place,
    carried along, lands within REACH. A corner counts once on either side.
    """
    import numpy as np

    m = np.array(matches, float).reshape(-1, 8)
    if len(m) < AGREEING:
        return 0
    a, b = m[:, 0] + 1j * m[:, 1], m[:, 4] + 1j * m[:, 5]
    turn = m[:, 6] / m[:, 2] * np.exp(1j * (m[:, 7] - m[:, 3]))
    best = 0
    for k in range(len(m)):
        near = np.abs(b[k] + turn[k] * (a - a[k]) - b) <= REACH * max(1.0, abs(turn[k]))
        best = max(best, min(len(set(a[near].tolist())), len(set(b[near].tolist()))))
    return best


def packed(corners: list[tuple]) -> bytes:
    """Corners of `descriptors` as POINTs."""
    import numpy as np

    out = np.zeros(len(corners), POINT)
    for name, values in zip(("x", "y", "size", "angle", "bits", "wide"), zip(*corners)):
        out[name] = np.frombuffer(b"".join(values), np.uint8).reshape(len(corners), -1) if name in ("bits", "wide") else values
    return out.tobytes()


def runs_of(batches, width: int):
    """Sorted rows as lists of arrays, about ROWS at a time, cut only between runs of rows that are equal in the first `width` columns."""
    import numpy as np

    held: list = []
    n = 0

    def cut(whole: bool):
        nonlocal held, n
        columns = [np.concatenate(c) for c in zip(*held)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:width]], 0)) + 1
        at = n if whole else int(change[-1]) if len(change) else 0
        held, n = [[c[at:] for c in columns]], n - at
        return [c[:at] for c in columns]

    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
        if n >= ROWS:
            yield cut(False)
    if n:
        yield cut(True)


#: Columns of entries: the coarse tests as numbers of 64 bits each.
COARSE = [f"wide_{k}" for k in range(WIDE // 64)]
ENTRY = ["entry", "image", "angle", *COARSE]


def _agree(pairs):
    """Whether coarse tests of two corners differ in few enough. `pairs` has the two's numbers for every column of COARSE."""
    import numpy as np

    return sum(np.bitwise_count((one ^ two).view(np.uint64)).astype(np.uint8) for one, two in pairs) <= WIDE_BITS


MET = "a long, b long, angles int"


def meetings(a, b, one, two):
    """A batch of MET: images of which two corners meet, and the corners' angles."""
    import numpy as np
    import pyarrow as pa

    angles = (one % STEPS * STEPS + two % STEPS).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(angles)], ["a", "b", "angles"])


def turned(met: DataFrame) -> DataFrame:
    """Pairs (a, b, n) of which n corners meet, enough and with turns that agree.

    Corners that meet in several tables count once: they have the same angles.
    """
    turn = F.lit(2 * math.pi / STEPS) * (F.pmod("angles", F.lit(STEPS)) - F.floor(F.col("angles") / STEPS))
    added = met.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.hypot(F.sum(F.cos(turn)), F.sum(F.sin(turn))).alias("length"))
    return added.where((F.col("n") >= MEETINGS) & (F.col("length") >= TURNED)).select("a", "b", "n")


def met_first(entries: DataFrame) -> DataFrame:
    """Meetings (MET) of images with their entry's first image `a`. An entry streams by."""

    def run(batches):
        import numpy as np

        give_back()
        entry, first = None, []  # of the entry at hand: its first row, but for the entry
        for batch in batches:
            if not batch.num_rows:
                continue
            e, *rest = (c.to_numpy() for c in batch.columns)
            start = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            at = np.repeat(start, np.diff(np.r_[start, len(e)]))
            firsts = [c[at] for c in rest]
            if entry is not None and e[0] == entry:
                firsts = [np.where(at == 0, was, c) for was, c in zip(first, firsts)]
            (a, g, *v), (i, h, *w) = firsts, rest
            met = (a != i) & _agree(zip(v, w))
            entry, first = int(e[-1]), [c[-1] for c in firsts]
            yield meetings(a[met], i[met], g[met], h[met])

    return entries.select(ENTRY).repartition("entry").sortWithinPartitions("entry", "image", "angle", *COARSE).mapInArrow(run, MET).distinct()


def met_apart(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Meetings (MET) of images in different components.

    `entries` has ENTRY and component. The corners of an entry of more than `block` fall into blocks that meet two at a
    time, each two in a run of their own. Those of an entry's largest component are in blocks apart, and
    these meet only blocks of the others, so an entry that one component fills stays about as long as it is.
    """
    long_entries = staged(entries.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("entry"), "image-long-entries")
    count = entries.join(long_entries, "entry", "left_semi").groupBy("entry", "component").agg(F.count(F.lit(1)).alias("n"))
    most = count.groupBy("entry").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.col("component").alias("main"))).alias("most"))
    cut = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    blocks = staged(most.select("entry", "most.main", cut(F.col("most.n")).alias("mains"), cut(F.col("all") - F.col("most.n")).alias("others")), "image-blocks")
    spot = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    salt, none = F.xxhash64("image", "angle", *COARSE), F.lit(-1)
    main, mine = F.pmod(salt, F.col("mains")), F.pmod(salt, F.col("others"))
    spots = (
        F.when(F.col("main").isNull(), F.array(spot(none, none, none)))
        .when(F.col("component") == F.col("main"), each("others", lambda k: spot(main, none - k, F.lit(0))))
        .otherwise(F.concat(each("mains", lambda k: spot(k, none - mine, F.lit(1))), each("others", lambda k: spot(F.least(mine, k), F.greatest(mine, k), mine))))
    )
    laid = entries.join(blocks, "entry", "left").withColumn("spot", F.explode(spots)).select("entry", "spot.i", "spot.j", "image", "angle", "component", "spot.side", *COARSE)

    def run(batches):
        import numpy as np

        give_back()
        for e, i, j, image, angle, component, side, *wide in runs_of(batches, 3):
            change = np.flatnonzero((e[1:] != e[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            size = np.diff(np.r_[0, change, len(e)])
            end = np.repeat(np.r_[change, len(e)], size)
            at, step, n, found = np.arange(len(e)), 0, 0, []
            while len(at):
                step += 1
                at = at[at + step < end[at]]
                close = np.flatnonzero(_agree((c[at], c[at + step]) for c in wide))
                p = at[close]
                q = p + step
                # Of two blocks only those of different sides meet.
                met = (component[p] != component[q]) & ((i[p] == j[p]) | (side[p] != side[q]))
                p, q = p[met], q[met]
                p, q = np.where(image[p] < image[q], (p, q), (q, p))
                found.append((image[p], image[q], angle[p], angle[q]))
                n += len(found[-1][0])
                if n and (n >= ROWS or not len(at)):
                    yield meetings(*(np.concatenate(c) for c in zip(*found)))
                    n, found = 0, []

    return (laid.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j").mapInArrow(run, MET).distinct())


def copies(table: DataFrame, id_col: str = "image_id", body_col: str = "body", block: int = BLOCK) -> DataFrame:
    """Per row: image_id, n_points, component_id (smallest id reachable by copies), n_agreeing.

    `n_agreeing` is the most matches that a link of the image rests on, 0 without one. Null,
    broken and flat images have no points; they link only with equal bytes, nulls with
    nothing. Repeated rows are copies of each other; an id on several images links none of them; null ids
    keep their row and component. An empty table gives no rows; other columns are not read.
    """
    import numpy as np

    def described(batches):
        import hashlib

        import pyarrow as pa

        give_back()
        sent: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                names, counts, packs = [], [], []
                for known, body in zip(part.column(0).is_valid().to_pylist(), part.column(1).to_pylist()):
                    own = descriptors(pixels) if (pixels := decode(body)) is not None else []
                    name = hashlib.sha256(body).digest() if body is not None else None
                    names.append(name)
                    counts.append(len(own))
                    packs.append(packed(own) if known and name and name not in sent else None)
                    if known and name and len(sent) < 200_000:  # a task sends an image's corners once
                        sent.add(name)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(packs, pa.binary())], ["image_id", "name", "n_points", "points"])

    rows = small_batches(table.select(F.col(id_col).cast("long").alias("image_id"), F.col(body_col).cast("binary").alias("body")))
    named = staged(rows.mapInArrow(described, "image_id long, name binary, n_points long, points binary"), "image-points")
    told = staged(named.select("image_id", "name", "n_points"), "image-rows")
    # Images are numbered, as an id can stand on several.
    classes = told.where("name is not null and image_id is not null").groupBy("name").agg(F.min("image_id").alias("label"))
    classes = staged(classes.withColumn("image", F.monotonically_increasing_id()), "image-classes")
    sent = named.where("points is not null and n_points > 0").groupBy("name").agg(F.first("points").alias("points"))
    points = staged(sent.join(classes, "name").select("image", "points"), "images")
    del sent
    unstage(named)

    def entered(df, tables):
        """Entries of those tables for the images of `df` (image, points, and more)."""
        names = df.columns[2:]

        def run(batches):
            import pyarrow as pa

            give_back()
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    image, points, *more = (c.to_pylist() for c in batch.slice(at, 256).columns)
                    own = np.frombuffer(b"".join(points), POINT)
                    times = [len(p) // own.itemsize * len(tables) for p in points]
                    angle = np.rint(own["angle"] * (STEPS / 2 / np.pi)).astype(np.int32)
                    wide = np.ascontiguousarray(own["wide"]).view("<i8").T
                    cells = [table_keys(own["bits"])[:, tables].ravel(), np.repeat(image, times), *(np.repeat(c, len(tables)) for c in (angle, *wide)), *(np.repeat(c, times) for c in more)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], [*ENTRY, *names])

        return df.mapInArrow(run, ", ".join(["entry long, image long, angle int", *(f"{c} long" for c in (*COARSE, *names))]))

    def in_turn(met, words, name):
        """Pairs of `met`, a function of tables, over the first `words` tables, a few at a time."""
        parts = []
        for k in range(0, words, AT_A_TIME):
            parts.append(staged(met(list(range(k, min(words, k + AT_A_TIME)))), f"image-{name}-{k}"))
            let_go(table.sparkSession)
        full = staged(turned(functools.reduce(DataFrame.unionByName, parts)), f"image-{name}")
        unstage(*parts)
        return full

    def decided(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3))):
                x, y = np.frombuffer(x, POINT), np.frombuffer(y, POINT)
                rows = max(1, (1 << 20) // len(y))
                near = [np.argwhere(np.bitwise_count(x["bits"][k : k + rows, None] ^ y["bits"][None]).sum(2, np.int32) <= MOST_BITS) + (k, 0) for k in range(0, len(x), rows)]
                p, q = np.concatenate(near).T
                found.append(agreeing(np.stack([side[c] for side in (x[p], y[q]) for c in ("x", "y", "size", "angle")], 1)))
            keep = pa.array([n >= AGREEING for n in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], ["u", "v", "n"]).filter(keep)

    def linked(pairs, name):
        # Written first: its size is then known, and Spark sends a small list of pairs to the points, not points to the pairs.
        pairs = staged(pairs, f"image-{name}-pairs")
        one, two = (points.select(F.col("image").alias(k), F.col("points").alias(p)) for k, p in ("ax", "by"))
        both = pairs.select("a", "b").join(one, "a").join(two, "b")
        return staged(both.select("a", "b", "x", "y").mapInArrow(decided, "u long, v long, n long"), f"image-{name}")

    def in_components(df, found, column):
        own = found.select(F.col("id").alias(column), F.col("component").alias(f"c{column}"))
        return df.join(own, column, "left").withColumn(f"c{column}", F.coalesce(f"c{column}", column))

    best = lambda *keys: lambda df: df.groupBy(*keys).agg(F.max_by(F.struct("a", "b"), F.struct("n", -F.col("a"), -F.col("b"))).alias("p")).select("p.*")
    first = in_turn(lambda tables: met_first(entered(points, tables)), FIRST, "first")
    links = linked(best("b")(first), "links-first")
    unstage(first)
    found = connected_components(links.select("u", "v"), "image-found")
    kept = in_components(points, found, "image").select("image", "points", F.col("cimage").alias("component"))
    met = in_turn(lambda tables: met_apart(entered(kept, tables), block), WORDS, "apart")
    del kept
    # Of two components the pair that met most is tried first, then all pairs of those that still differ.
    for k, choose in enumerate((best("ca", "cb"), lambda df: df.select("a", "b"))):
        apart = in_components(in_components(met, found, "a"), found, "b").where("ca <> cb")
        ordered = apart.withColumns({"ca": F.least("ca", "cb"), "cb": F.greatest("ca", "cb")})
        links = links.union(linked(choose(ordered), f"links-{k}"))
        del apart, ordered
        unstage(found)
        found = connected_components(links.select("u", "v"), f"image-components-{k}")
    rests = links.select(F.col("u").alias("image"), "n").union(links.select(F.col("v").alias("image"), "n")).groupBy("image").agg(F.max("n").alias("n_agreeing"))
    full = in_components(classes, found, "image").join(rests, "image", "left")
    labels = full.groupBy("cimage").agg(F.min("label").alias("component_id"))
    out = staged(full.join(labels, "cimage").select("name", "component_id", "n_agreeing"), "image-labels")
    del rests, full, labels
    unstage(points, met, found, classes)
    zero = F.lit(0).cast("long")
    return told.join(out, "name", "left").select("image_id", "n_points", F.coalesce("component_id", "image_id").alias("component_id"), F.coalesce("n_agreeing", zero).alias("n_agreeing"))


def textures(n: int, side: int):
    """`n` fixed smooth random fields, for pictures of vectors."""
    import numpy as np

    r = np.random.default_rng(5)
    fields = np.stack([_box(_box(r.normal(size=(side, side)), 2), 2) for _ in range(n)])
    return fields / fields.std((1, 2), keepdims=True)


def pictures(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 96) -> DataFrame:
    """A media column for tables without one: each vector as a weighted sum of fixed textures.

    Near vectors have near pictures, so copies can be looked for. Null or unusable vectors
    have a null picture.
    """
    kept: dict = {}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                own = np.array([np.nan if x is None else x for x in v or [np.nan]], float)
                if not np.isfinite(own).all() or not own.any():
                    out.append(None)
                    continue
                if len(own) not in kept:
                    kept[len(own)] = textures(len(own), side)
                out.append(encode(128 + 45 * np.tensordot(own / np.linalg.norm(own), kept[len(own)], 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["image_id", "body"])

    return table.select(F.col(id_col).cast("long").alias("image_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "image_id long, body binary")
