"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors whose cosine is at least ``c`` are at most ``eps = sqrt(2 - 2c)`` apart,
also in every projection.  Vectors are sorted by their grid cells of width
``eps`` on the leading principal dimensions and cut into blocks.  Intervals of
that sequence are joined recursively, coarse to fine: a pair of intervals whose
bounding boxes are further apart than ``eps`` is dropped with all that it holds,
a pair of blocks is joined in a task, which goes on halving it the same way.
Equal vectors are one point with a weight, and tasks return counts and spanning
links, never the pairs within a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch
from cladeframe.llm.components import connected_components

BLOCK, LEAF, FAN, LEVELS, GRID_DIMENSIONS = 1024, 128, 16, 3, 6
#: Blocks on each side of a tile; a block travels once for each tile that it is in.
TILE = 8


def _vectors(column) -> np.ndarray:
    flat = np.asarray(column.values if not hasattr(column, "flatten") else column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, since squares of very small or large numbers have no place in a double."""
    x = x / np.abs(x).max(axis=1, initial=0.0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def principal_axes(points: DataFrame, dims: int) -> dict[int, np.ndarray]:
    """Leading principal axes of the unit vectors for each vector length.

    Each task returns one sum of outer products per length (no more rows than
    lengths), so what reaches the driver grows with neither rows nor labels.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            size = np.asarray(batch.column("size"))
            for d in np.unique(size):
                x = _unit(_vectors(batch.column("embedding").filter(pa.array(size == d))))
                z = np.c_[np.ones(len(x)), x]
                sums[int(d)] = sums.get(int(d), 0) + z.T @ z
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], "int32"), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["d", "m"])

    parts = points.select("size", "embedding").mapInArrow(run, "d int, m array<double>")
    summed = parts.select("d", F.posexplode("m").alias("i", "v")).groupBy("d", "i").agg(F.sum("v").alias("v")) \
        .groupBy("d").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("m"))
    axes = {}
    for d, cells in summed.collect():
        m = np.array([c["v"] for c in cells]).reshape(d + 1, d + 1)
        mean = m[0, 1:] / m[0, 0]
        _, v = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        axes[d] = v[:, ::-1][:, :dims]
    return axes


def _gap(lo_a: str, hi_a: str, lo_b: str, hi_b: str, eps: float):
    """Whether two boxes (arrays of bounds) are at most eps apart."""
    above = F.zip_with(lo_b, hi_a, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    below = F.zip_with(lo_a, hi_b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    square = F.aggregate(F.zip_with(above, below, lambda x, y: x * x + y * y), F.lit(0.0), lambda a, x: a + x)
    return square <= F.lit(eps * eps)


def _blocks(points: DataFrame, axes: dict[int, np.ndarray], eps: float, scratch: Scratch) -> DataFrame:
    """The sequence cut into blocks: ``group, part, seq, n, ids, weights, data, lo, hi``."""
    dims = GRID_DIMENSIONS

    def place(batches):
        for batch in batches:
            size = np.asarray(batch.column("size"))
            for d in np.unique(size):
                rows = batch.filter(pa.array(size == d))
                at = _unit(_vectors(rows.column("embedding"))) @ axes[int(d)]
                at = np.c_[at, np.zeros((len(at), dims - at.shape[1]))]
                cell = np.floor(at / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[rows.column(c) for c in ("label", "size", "id", "weight", "embedding")],
                    pa.array(cell.tolist(), pa.list_(pa.int32())), pa.array(at.tolist(), pa.list_(pa.float64()))],
                    ["label", "size", "id", "weight", "embedding", "cell", "at"])

    kinds = dict(points.dtypes)
    exact = "<f4" if kinds["embedding"] == "array<float>" else "<f8"
    placed = points.mapInArrow(place, f"label {kinds['label']}, size int, id long, weight long, embedding {kinds['embedding']}, "
                                      "cell array<int>, at array<double>")
    order = ["label", "size", "cell", "id"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        part, seq, held, key = TaskContext.get().partitionId(), 0, [], None

        def flush():
            ids = np.concatenate([h[0] for h in held])
            weights = np.concatenate([h[1] for h in held])
            data = np.concatenate([h[2] for h in held])
            at = np.concatenate([h[3] for h in held])
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]], label_type), pa.array([key[1]], "int32"), pa.array([part], "int32"), pa.array([seq], "int32"),
                pa.array([len(ids)], "int64"), pa.array([ids.tobytes()]), pa.array([weights.tobytes()]), pa.array([data.tobytes()]),
                pa.array([at.astype("<f8").tobytes()]),
                pa.array([at.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([at.max(axis=0).tolist()], pa.list_(pa.float64()))],
                ["label", "size", "part", "seq", "n", "ids", "weights", "data", "places", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            label_type = batch.schema.field("label").type
            keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist()))
            bounds = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(bounds, bounds[1:]):
                if held and key != keys[lo]:
                    yield flush()
                    seq, held = seq + 1, []
                key = keys[lo]
                while lo < hi:
                    room = BLOCK - sum(len(h[0]) for h in held)
                    take = batch.slice(lo, min(room, hi - lo))
                    held.append((np.asarray(take.column("id")).astype("<i8"), np.asarray(take.column("weight")).astype("<i8"),
                                 _vectors(take.column("embedding")).astype(exact), _vectors(take.column("at"))))
                    lo += take.num_rows
                    if take.num_rows == room:
                        yield flush()
                        seq, held = seq + 1, []
        if held:
            yield flush()

    return scratch.save(dealt.mapInArrow(cut, f"label {kinds['label']}, size int, part int, seq int, n long, ids binary, weights binary, "
                                              "data binary, places binary, lo array<double>, hi array<double>"))


def _block_pairs(blocks: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """``part, seq`` and ``other_part, other_seq`` of all blocks that may hold a pair (each pair once)."""
    base = blocks.select("label", "size", "part", "seq", "lo", "hi")
    # intervals of the sequence within a partition: FAN blocks, FAN * FAN blocks, ...
    def box(level: int) -> DataFrame:
        span = FAN ** level
        rows = base.select("label", "size", "part", F.floor(F.col("seq") / span).cast("int").alias("iv"), "lo", "hi")
        ends = [F.min(F.col("lo")[k]).alias(f"l{k}") for k in range(GRID_DIMENSIONS)] + [
            F.max(F.col("hi")[k]).alias(f"h{k}") for k in range(GRID_DIMENSIONS)]
        return rows.groupBy("label", "size", "part", "iv").agg(*ends).select(
            "label", "size", "part", "iv", F.array(*[f"l{k}" for k in range(GRID_DIMENSIONS)]).alias("lo"),
            F.array(*[f"h{k}" for k in range(GRID_DIMENSIONS)]).alias("hi"))

    frontier = None
    for level in reversed(range(LEVELS)):
        boxes = box(level)
        a = boxes.select("label", "size", F.col("part").alias("pa"), F.col("iv").alias("ia"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
        b = boxes.select("label", "size", F.col("part").alias("pb"), F.col("iv").alias("ib"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        if frontier is None:
            pairs = a.join(b, ["label", "size"])
        else:
            a = a.withColumn("ua", F.floor(F.col("ia") / FAN).cast("int"))
            b = b.withColumn("ub", F.floor(F.col("ib") / FAN).cast("int"))
            pairs = frontier.join(a, ["label", "size", "pa", "ua"]).join(b, ["label", "size", "pb", "ub"])
        ordered = (F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("ia") <= F.col("ib")))
        pairs = pairs.where(ordered & _gap("la", "ha", "lb", "hb", eps))
        if level:
            frontier = pairs.select("label", "size", "pa", F.col("ia").alias("ua"), "pb", F.col("ib").alias("ub"))
        else:
            frontier = pairs.select("label", "size", "pa", "ia", "pb", "ib")
    return frontier


def _join(a: tuple, b: tuple, eps: float, cosine: float, same: bool, emit) -> None:
    """Recursive join of two intervals (unit vectors, places): halves the larger, skips distant ones."""
    (x, p, i), (y, q, j) = a, b
    gap = np.maximum(0, np.maximum(q.min(axis=0) - p.max(axis=0), p.min(axis=0) - q.max(axis=0)))
    if (gap * gap).sum() > eps * eps:
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        hit = x @ y.T >= cosine
        if same and i[0] == j[0]:
            hit = np.triu(hit, 1)
        if hit.any():
            emit(i[0], j[0], hit)
        return
    if len(x) >= len(y):
        halves = (slice(None, len(x) // 2), slice(len(x) // 2, None))
        for h in halves:
            part = (x[h], p[h], i[h])
            if same and a is b:
                _join(part, part, eps, cosine, True, emit)
            else:
                _join(part, b, eps, cosine, same, emit)
        if same and a is b:
            h, g = halves
            _join((x[h], p[h], i[h]), (x[g], p[g], i[g]), eps, cosine, False, emit)
    else:
        for h in (slice(None, len(y) // 2), slice(len(y) // 2, None)):
            _join(a, (y[h], q[h], j[h]), eps, cosine, same, emit)


def _linked(blocks: DataFrame, pairs: DataFrame, kind: str, eps: float, cosine: float) -> DataFrame:
    """``id, links, other``: per point and block pair its linked weight and one spanning link.

    Neighbours of the sequence, ``TILE`` blocks each, make a side; a task gets both sides
    of a tile and joins what the pairs of blocks in it ask for.
    """
    sided = pairs.select("label", "size", "pa", "ia", "pb", "ib", F.floor(F.col("ia") / TILE).cast("int").alias("ta"), F.floor(F.col("ib") / TILE).cast("int").alias("tb"))
    key = ["label", "size", "pa", "ta", "pb", "tb"]
    left = sided.select(*key, F.col("pa").alias("part"), F.col("ia").alias("seq"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = sided.select(*key, F.col("pb").alias("part"), F.col("ib").alias("seq"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    members = left.union(right).groupBy(*key, "part", "seq").agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right"))
    payload = blocks.select("part", "seq", "ids", "weights", "data", "places")
    rows = members.join(payload, ["part", "seq"]).repartition(*key).sortWithinPartitions(*key, "part", "seq")
    width = "<f4" if kind == "array<float>" else "<f8"

    def block(row: dict) -> tuple:
        ids = np.frombuffer(row["ids"], dtype="<i8")
        x = _unit(np.frombuffer(row["data"], dtype=width).astype(np.float64).reshape(len(ids), -1))
        places = np.frombuffer(row["places"], dtype="<f8").reshape(len(ids), -1)
        return ids, np.frombuffer(row["weights"], dtype="<i8"), x, places

    def joined(a: tuple, b: tuple):
        (ia, wa, xa, pa_), (ib, wb, xb, pb_) = a, b
        same, na = a is b, len(ia)
        ids, weights = (ia, wa) if same else (np.r_[ia, ib], np.r_[wa, wb])
        shift = 0 if same else na
        links = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids))
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def emit(at, to, hit):
            i, j = np.nonzero(hit)
            i, j = i + at, j + to + shift
            links[:] += np.bincount(i, weights=weights[j], minlength=len(ids)).astype(np.int64)
            links[:] += np.bincount(j, weights=weights[i], minlength=len(ids)).astype(np.int64)
            found.append((i, j))

        one = (xa, pa_, np.arange(na))
        _join(one, one if same else (xb, pb_, np.arange(len(ib))), eps, cosine, same, emit)
        if not found:
            return None
        i, j = (np.concatenate(f) for f in zip(*found))
        while True:  # least label in this pair of blocks
            before = root.copy()
            least = np.minimum(root[i], root[j])
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            root = root[root]
            if (root == before).all():
                break
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], ["id", "links", "other"])

    def run(batches):
        tile, held = None, []

        def settle():
            # each pair of blocks once: the left one comes first in the sequence
            for at, (place, is_left, _, a) in enumerate(held):
                for other, _, is_right, b in held[at:] if is_left else ():
                    if is_right:
                        got = joined(a, b)
                        if got is not None:
                            yield got

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in (*key, "part", "seq", "left", "right", "ids", "weights", "data", "places")}
                if tuple(row[c] for c in key) != tile:
                    yield from settle()
                    tile, held = tuple(row[c] for c in key), []
                held.append(((row["part"], row["seq"]), row["left"], row["right"], block(row)))
        yield from settle()

    return rows.mapInArrow(run, "id long, links long, other long")


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = 0.93, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector, one row per input row.

    Rows are compared if their labels are equal and not null and their vectors have
    equal lengths; they are linked if their cosine, in double precision, is at least
    ``cosine`` (between 0 and 1).  Null, empty and zero vectors and those with null or non-finite
    components link with nothing.  Equal vectors with equal labels link with each
    other.  ``component_id`` is the least id reachable by links, ``kept`` says that it is the
    row's own.  Ids are taken to be unique; vectors that repeat an id share its links and component.
    Null ids stay, alone.  Other columns are ignored; an empty table gives an empty result.
    """
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    # 0.0 and -0.0 are one number
    valid = rows.where(sound).withColumn("embedding", F.transform("embedding", lambda v: F.when(v == 0, F.abs(v)).otherwise(v)))
    points = scratch.save(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")).select(
        "label", F.size("embedding").alias("size"), "id", "weight", "embedding"))
    axes = principal_axes(points, GRID_DIMENSIONS)
    blocks = _blocks(points, axes, eps, scratch)
    pairs = scratch.save(_block_pairs(blocks, eps, scratch))
    got = scratch.save(_linked(blocks, pairs, dict(points.dtypes)["embedding"], eps, cosine))
    links = got.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(got.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    known = points.join(links, "id", "left").join(component, points["id"] == component["node"], "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    matched = valid.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return matched.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
