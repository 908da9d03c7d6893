"""Near-duplicates by a signature-coordinate inverted join.

Documents with equal shingle sets form one class.  Every class representative is
posted under the first ``LANES`` (coordinate, value) pairs of its MinHash signature.
Pairs of documents that agree in at least ``MATCHES`` of them are found from
prefixes: in the order "unshared values first, then by coordinate" such a pair
must meet in the first ``LANES - MATCHES + 1`` postings of both, so all later ones
are skipped, as are documents with too few shared values; a pair that meets more
than once counts where it meets first.  Where it does, its collisions are counted
over the whole signature, and it is a candidate with at least ``RETAINED`` of
``COORDINATES``.  Candidates are confirmed on full shingle sets.

No list is expanded into all of its pairs.  Round one compares a list's members
with its hub (least id) only.  A hub and the documents near it form a star.  A task
confirms a star at once from products of its incidence matrix and returns the components
that its links span; a star of more than ``TILE`` documents is dealt out over slices, and
each two of them make a task, so all pairs of a star are settled without being listed.
Round two compares what is left between different components and no common star: per list the
members of the largest component and the others are dealt out over slices, and pairs of
slices (others with others, others with the largest component) form tiles, so no task
holds more than two slices of a list.  Lists that lie within one component are skipped.  Linked documents of one component need no
further pairs, so the components are those of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import chunks, give_back, map_texts, ragged, Scratch
from cladeframe.llm.components import connected_components

#: A pair at the threshold of 0.8 agrees in fewer than 13 of 32 coordinates in about 3 of 10 million cases ...
LANES, MATCHES = 32, 13
#: ... and in fewer than 77 of 128 in about 1 of 10 million; pairs at 0.5 reach that in 1 of 75 cases.
COORDINATES, RETAINED = 128, 77
#: Coordinates that a document shares with a hub to belong to its star (lower, so that stars are whole).
NEAR_HUB = 58
#: Members of a list in one slice; partners of a hub in one slice, where only they and the hub are compared.
SLICE, STAR = 1024, 1024
#: Documents and shingles of a star that a task settles at once.
TILE, STAR_SHINGLES = 2048, 3_000_000
#: Pairs of a hub and a partner for each task that confirms them.
PAIRS_PER_TASK = 256
#: Lists (about 30 bytes each) whose main component may be broadcast; beyond that they are joined by a shuffle.
MAX_BROADCAST_LISTS = 500_000
#: Stars that a document remembers, to skip pairs which a star has settled.
STARS = 4
#: Ids that may be broadcast (8 bytes each); beyond that tables are joined by shuffles.
MAX_BROADCAST_IDS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text.

    Words are runs of bytes other than blanks (0x20, 0x09-0x0D), A-Z lower-cased.  A
    text with fewer than ``width`` words has its whole sequence as the only
    shingle; one without words, or null, has none.
    """
    raws = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)]
    blank = _BLANK[data]
    begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(begin):
        return [np.empty(0, dtype=np.uint64)] * len(texts)
    end = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    length = end - begin
    row, local = ragged(length)
    powers = np.full(int(length.max()), 0xD6E8FEB86659FD93, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    word = np.add.reduceat(_BYTES[data[begin[row] + local]] * powers[local], np.cumsum(length) - length)
    word = _mix(word + length.astype(np.uint64))
    size = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    stops = np.searchsorted(begin, np.cumsum(size + 1), side="left")
    starts = np.r_[0, stops[:-1]]
    n = len(word)
    full = max(n - width + 1, 0)
    joined = np.zeros(full, dtype=np.uint64)
    for k in range(width):
        joined += word[k:k + full] * _PLACES[k]
    joined = _mix(joined)
    out = []
    for a, b in zip(starts.tolist(), stops.tolist()):
        if b - a >= width:
            out.append(np.unique(joined[a:b - width + 1]))
        elif b > a:
            short = (word[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signature(hashes: np.ndarray) -> bytes:
    """Least transformed hash for each coordinate: 32 bits for posted ones, 16 for the others."""
    least = np.empty(COORDINATES, dtype=np.uint64)
    for lo in range(0, len(hashes), 2048):
        part = (hashes[None, lo:lo + 2048] * _A[:, None] + _B[:, None]).min(axis=1)
        least = part if not lo else np.minimum(least, part)
    return (least[:LANES] >> np.uint64(32)).astype("<u4").tobytes() + (least[LANES:] >> np.uint64(48)).astype("<u2").tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, d1, d2, sig, text_hash``: set size, two digests of the set, signature, and a hash of the text."""

    def run(batch):
        sets = shingle_sets(batch.column(1).to_pylist(), width)
        d1 = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
        d2 = np.array([np.bitwise_xor.reduce(_mix(s)) if len(s) else 0 for s in sets], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], "int64"), pa.array(_signed(d1)), pa.array(_signed(d2)),
            pa.array([signature(s) if len(s) else None for s in sets], "binary"), batch.column(2)],
            ["doc_id", "n", "d1", "d2", "sig", "text_hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return map_texts(rows, run, "doc_id long, n long, d1 long, d2 long, sig binary, text_hash long")


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Posted and other coordinates of a binary column of signatures, as rows."""
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 4 * LANES + 2 * (COORDINATES - LANES))
    return np.ascontiguousarray(rows[:, :4 * LANES]).view("<u4"), np.ascontiguousarray(rows[:, 4 * LANES:]).view("<u2")


def _postings(reps: DataFrame) -> DataFrame:
    """``key, id`` for every coordinate of every representative."""

    def run(batches):
        lanes = np.arange(LANES, dtype=np.int64) << 32
        for batch in batches:
            if batch.num_rows:
                keys = _matrix(batch.column("sig"))[0].astype(np.int64) + lanes
                ids = np.repeat(np.asarray(batch.column("id")), LANES)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def _prefixes(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, n, sig, shared``: documents that can have a partner, with their shared values.

    ``shared``: ``(lane, cnt, hub, in_prefix)`` for each coordinate whose value other
    documents have as well (``cnt`` of them and ``hub``, the least id).
    """
    posted = _postings(reps)
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min("id").alias("hub")).where("cnt > 1")
    met = posted.join(lists, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        F.shiftright("key", 32).cast("int").alias("lane"), "cnt", "hub"))).alias("met"))
    enough = met.where(F.size("met") >= MATCHES)
    # unshared values come first in the order, so the prefix ends MATCHES - 1 shared values early
    shared = F.transform("met", lambda x, i: F.struct(
        x["lane"].alias("lane"), x["cnt"].alias("cnt"), x["hub"].alias("hub"),
        (i <= F.size("met") - MATCHES).alias("in_prefix")))
    return scratch.save(reps.join(enough, "id").select("id", "n", "sig", shared.alias("shared")))


def _hub_pairs(prefixed: DataFrame) -> DataFrame:
    """Round one: ``a, b, n`` where b's signature is near that of a list's hub a (n: b's shingles).

    Members go to their list in slices by id; the hub goes to every slice.
    """
    one = prefixed.select("id", "n", "sig", F.explode("shared").alias("s")) \
        .where("s.in_prefix or s.hub = id") \
        .select("id", "n", "sig", "s.lane", "s.cnt", (F.col("s.hub") == F.col("id")).alias("is_hub"),
                F.ceil(F.col("s.cnt") / SLICE).cast("int").alias("slices"))
    slices = F.when(F.col("is_hub"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")))
    # one column of the signature is the list's value, so (lane, value, slice) is the group
    value = F.substring("sig", F.col("lane") * 4 + 1, F.lit(4))
    rows = one.select("id", "n", "sig", "lane", value.alias("value"), "is_hub", F.explode(slices).alias("slice"))
    rows = rows.repartition("lane", "value", "slice").sortWithinPartitions("lane", "value", "slice", F.desc("is_hub"))

    def run(batches):
        key, hub = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            (lanes, rest), ids = _matrix(batch.column("sig")), np.asarray(batch.column("id"))
            keys = list(zip(batch.column("lane").to_pylist(), batch.column("value").to_pylist(), batch.column("slice").to_pylist()))
            is_hub = np.asarray(batch.column("is_hub"))
            hubs = np.flatnonzero(is_hub)
            # the hub of each row: the last hub row at or before it
            at = np.searchsorted(hubs, np.arange(len(ids)), side="right") - 1
            hub_lanes = np.concatenate([hub[0][None] if hub else np.zeros((1, LANES), "<u4"), lanes[hubs]])
            hub_rest = np.concatenate([hub[2][None] if hub else np.zeros((1, COORDINATES - LANES), "<u2"), rest[hubs]])
            hub_ids = np.r_[hub[1] if hub else -1, ids[hubs]]
            own = [key, *[keys[h] for h in hubs]]
            a = hub_ids[at + 1]
            same = np.fromiter((own[k + 1] == q for k, q in zip(at, keys)), dtype=bool, count=len(keys))
            match = (hub_lanes[at + 1] == lanes).sum(axis=1) + (hub_rest[at + 1] == rest).sum(axis=1) >= NEAR_HUB
            take = same & ~is_hub & match
            if take.any():
                n = np.asarray(batch.column("n"))[take]
                yield pa.RecordBatch.from_arrays([pa.array(a[take]), pa.array(ids[take]), pa.array(n)], ["a", "b", "n"])
            if len(hubs):
                key, hub = keys[hubs[-1]], (lanes[hubs[-1]].copy(), int(ids[hubs[-1]]), rest[hubs[-1]].copy())

    return rows.mapInArrow(run, "a long, b long, n long").distinct()


def _cross_pairs(prefixed: DataFrame, label: DataFrame, member: DataFrame, scratch: Scratch) -> DataFrame:
    """Round two: candidate pairs ``a < b`` between different components and without a common star.

    ``label(id, component)`` covers documents that have links so far, ``member(id, stars)``
    those that are in stars (``STARS`` of them each; without one the value is the id).
    """
    named = prefixed.join(label, "id", "left").join(member, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = named.withColumn("stars", F.coalesce("stars", F.array_repeat("id", STARS)))
    value = F.substring("sig", F.col("s.lane") * 4 + 1, F.lit(4))
    one = named.select("id", "n", "sig", "component", "stars", F.explode("shared").alias("s")).where("s.in_prefix") \
        .select("id", "n", "sig", "component", "stars", F.col("s.lane").alias("lane"), value.alias("value"))
    parts = one.groupBy("lane", "value", "component").agg(F.count(F.lit(1)).alias("members"))
    mixed = scratch.save(parts.groupBy("lane", "value").agg(
        F.count(F.lit(1)).alias("components"), F.max(F.struct("members", "component")).alias("top"),
        F.sum("members").alias("members")).where("components > 1").select(
        "lane", "value", F.col("top.component").alias("main"), F.ceil(F.col("top.members") / SLICE).cast("int").alias("main_slices"),
        F.ceil((F.col("members") - F.col("top.members")) / SLICE).cast("int").alias("slices")))
    rows = one.join(F.broadcast(mixed) if mixed.count() <= MAX_BROADCAST_LISTS else mixed, ["lane", "value"])
    rows = rows.withColumn("is_main", F.col("component") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("main_slices")).otherwise(F.col("slices"))).cast("int"))

    def each(n: str, tile) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), tile)

    def tile(kind: int, x: Column, y: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))

    tiles = F.when(F.col("is_main"), each("slices", lambda t: tile(1, F.col("own"), t))).otherwise(F.concat(
        each("slices", lambda t: tile(0, F.least(F.col("own"), t), F.greatest(F.col("own"), t))),
        each("main_slices", lambda t: tile(1, t, F.col("own")))))
    key = ["lane", "value", "kind", "x", "y"]
    rows = rows.select("lane", "value", F.explode(tiles).alias("t"), "is_main", "own", "id", "n", "sig", "component", "stars") \
        .select("lane", "value", "t.kind", "t.x", "t.y", "is_main", "own", "id", "n", "sig", "component", "stars")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "is_main", "id")

    def pairs(lane, a, b):
        """Candidates between two blocks (id, n, lanes, component, rest, stars arrays), each met first in this lane."""
        for lo in range(0, len(a[0]), 256):
            left = [x[lo:lo + 256] for x in a]
            equal = left[2][:, None, :] == b[2][None, :, :]
            ok = (left[3][:, None] != b[3][None, :]) & (equal.sum(axis=2) >= MATCHES) & (equal.argmax(axis=2) == lane)
            small, large = np.minimum(left[1][:, None], b[1][None, :]), np.maximum(left[1][:, None], b[1][None, :])
            i, j = np.nonzero(ok & (10 * small >= 8 * large))
            if len(i):
                count = equal.sum(axis=2)[i, j]
                for at in range(0, len(i), 65536):
                    part = slice(at, at + 65536)
                    count[part] += (left[4][i[part]] == b[4][j[part]]).sum(axis=1)
                i, j = i[count >= RETAINED], j[count >= RETAINED]
                settled = np.zeros(len(i), dtype=bool)
                for k in range(STARS):
                    settled |= (left[5][i, k][:, None] == b[5][j]).any(axis=1)
                i, j = i[~settled], j[~settled]
            if len(i):
                x, y = left[0][i], b[0][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches):
        key, others = None, []

        def among_others():
            """Pairs of two slices of the others, or within one."""
            if key is None or key[2] != 0 or not others:
                return
            every = [np.concatenate([o[k] for o in others]) for k in range(7)]
            left, right = ([c[every[6] == side] for c in every[:6]] for side in key[3:5])
            for lo in range(0, len(right[0]), 1024):
                yield from pairs(key[0], left, [c[lo:lo + 1024] for c in right])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("lane", "value", "kind", "x", "y", "is_main"))))
            cut = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            lanes, rest = _matrix(batch.column("sig"))
            stars = np.asarray(batch.column("stars").flatten()).reshape(-1, STARS)
            ids, n, comp, own = (np.asarray(batch.column(k)) for k in ("id", "n", "component", "own"))
            for lo, hi in zip(cut, cut[1:]):
                if keys[lo][:5] != key:
                    yield from among_others()
                    key = keys[lo][:5]
                    others.clear()
                columns = [ids[lo:hi], n[lo:hi], lanes[lo:hi], comp[lo:hi], rest[lo:hi], stars[lo:hi], own[lo:hi]]
                if not keys[lo][5]:
                    others.append([c.copy() for c in columns])
                    continue
                for other in others:
                    for at in range(0, hi - lo, 1024):
                        yield from pairs(key[0], other[:6], [c[at:at + 1024] for c in columns[:6]])
        yield from among_others()
        give_back()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _with_ids(table: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
    """Join a wide table with a saved table of ids, broadcast if it is small enough."""
    return table.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "doc_id", how)


def _hub_rows(docs: DataFrame, pairs: DataFrame, scratch: Scratch, tiled: bool = False) -> DataFrame:
    """``a, slice, b, text, role`` for a task per hub slice, the hub (role 0) before its partners.

    A hub's text goes once to each slice of its partners, a partner's once to the hub.
    If ``tiled``, a task (``slice``) gets two slices of the partners, and each two slices
    of a hub meet in one; then ``pairs`` has the shingles ``n`` of each partner.
    """
    ids = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = scratch.save(_with_ids(docs.select("doc_id", "text"), ids).dropDuplicates(["doc_id"]))
    count = F.count(F.lit(1))
    if tiled:
        parts = F.greatest(F.ceil(count / TILE), F.ceil(F.sum("n") / STAR_SHINGLES))
        slices = F.when(parts > 1, 2 * parts).otherwise(1)
    else:
        slices = F.ceil(count / STAR)
    hubs = scratch.save(pairs.groupBy("a").agg(count.alias("partners"), slices.cast("long").alias("slices")))
    side = texts.select(F.col("doc_id").alias("b"), "text")
    own = F.pmod(F.xxhash64("b"), F.col("slices"))
    every = F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)
    alone = F.lit(not tiled) | (F.col("slices") == 1)

    def tile(x: Column, y: Column) -> Column:
        return F.least(x, y) * F.col("slices") + F.greatest(x, y)

    places = F.when(alone, F.array("own")).otherwise(F.transform(
        F.filter(every, lambda t: t != F.col("own")), lambda t: tile(F.col("own"), t)))
    partners = pairs.select("a", "b").join(hubs, "a").join(side, "b").withColumn("own", own).select(
        "a", F.explode(places).alias("slice"), "b", "text", F.lit(1).alias("role"))
    later = F.when(alone, F.array("x")).otherwise(F.transform(F.filter(every, lambda t: t > F.col("x")), lambda t: tile(F.col("x"), t)))
    heads = hubs.join(side.withColumnRenamed("b", "a"), "a").withColumn("x", F.explode(every)).select(
        "a", F.explode(later).alias("slice"), F.col("a").alias("b"), "text", F.lit(0).alias("role"))
    # by number and not by bytes: these rows cost far more time than others of their size
    total = hubs.agg(F.sum(F.col("partners") * F.when(alone, 1).otherwise(F.col("slices") - 1))).first()[0] or 0
    tasks = max(1, min(100_000, -(-total // PAIRS_PER_TASK)))
    return heads.union(partners).repartition(tasks, "a", "slice").sortWithinPartitions("a", "slice", "role")


def _similar(both: int, n: int, m: int, percent: int):
    return (both > 0) & (100 * both >= percent * (n + m - both))


def star_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one of its component under links of at least ``percent``."""
    n, size = len(sets), np.array([len(x) for x in sets])
    row = np.repeat(np.arange(n), size)
    _, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = holders[column] > 1
    row, column = row[held], np.unique(column[held], return_inverse=True)[1]
    both = np.zeros((n, n), dtype=np.float32)
    width, order = max(1, 4_000_000 // n), np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    edge = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (lo, hi) in enumerate(zip(edge, edge[1:])):
        part = np.zeros((n, width), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - k * width] = 1
        both += part @ part.T
    label = np.arange(n)
    linked = np.empty((n, n), dtype=bool)
    for k in range(n):
        linked[k] = _similar(both[k], size[k], size, percent)
    while True:
        least = np.array([label[linked[k]].min(initial=label[k]) for k in range(n)])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _confirm_stars(docs: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b, kind``: spanning links of each star (kind 0), and its members a with its number b (kind 1).

    All pairs of a star are settled on full sets.  Where a task has more than
    ``STAR_SHINGLES``, it settles its documents in parts, two of them at a time.
    """

    def run(batches):
        key, hub, held, ids = None, None, [], []

        def settle():
            star = (hash((key[0],)) & 0x3FFFFFFFFFFFFFFF) | 1 << 62
            part = np.cumsum([len(x) for x in held]) // (STAR_SHINGLES // 2)
            parts = np.unique(part)
            for k, x in enumerate(parts):
                for y in parts[k + 1:] if len(parts) > 1 else parts:
                    some = np.flatnonzero((part == x) | (part == y))
                    label = star_components([hub[1], *[held[i] for i in some]], percent)
                    every = np.array([hub[0], *[ids[i] for i in some]])
                    tied = np.flatnonzero(label != np.arange(len(label)))
                    yield made(every[tied], every[label[tied]], 0)
            yield made(np.array([hub[0], *ids]), np.full(len(ids) + 1, star), 1)

        def made(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, "int64"), pa.array(b, "int64"), pa.array(np.full(len(a), kind), "int32")], ["a", "b", "kind"])

        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                columns = (part.column(k).to_pylist() for k in ("a", "slice", "b", "role"))
                for a, piece, b, role, x in zip(*columns, sets):
                    if (a, piece) != key:
                        if held:
                            yield from settle()
                        key, hub, held, ids = (a, piece), None, [], []
                    if role == 0:
                        hub = (b, x)
                        continue
                    held.append(x)
                    ids.append(b)
        if held:
            yield from settle()
        give_back()

    return scratch.save(_hub_rows(docs, pairs, scratch, tiled=True).mapInArrow(run, "a long, b long, kind int"))


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs ``a, b`` whose full sets satisfy 100 * intersection >= percent * union."""

    def run(batches):
        hub, hub_set = None, None
        for batch in batches:
            for part in chunks(batch, "text"):
                a, b, role = (part.column(k).to_pylist() for k in ("a", "b", "role"))
                sets = shingle_sets(part.column("text").to_pylist(), width)
                left, right = [], []
                for x, y, r, s in zip(a, b, role, sets):
                    if r == 0:
                        hub, hub_set = x, s
                        continue
                    if x != hub:
                        raise RuntimeError(f"no hub {x} before its partner {y}")
                    both = len(np.intersect1d(hub_set, s, assume_unique=True))
                    if _similar(both, len(hub_set), len(s), percent):
                        left.append(x)
                        right.append(y)
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, "int64"), pa.array(right, "int64")], ["a", "b"])
        give_back()

    return scratch.save(_hub_rows(docs, pairs, scratch).mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by shingle sets: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their
    distinct ``width``-word shingles (at least 80, for which the candidates are made).
    One row per input row; documents without words (or null) are alone; rows that
    repeat an id share their component and are kept or not together, and the largest
    set among their texts (ties by digest) stands for them all; null ids have null
    components and are kept.  Other columns are ignored; an empty table gives an empty
    result.
    """
    if percent < 80:
        raise ValueError("candidates are made for similarities of 80 percent or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = scratch.save(sketch(docs, width))
    real = sets.where("n > 0 and doc_id is not null")
    classes = ["n", "d1", "d2"]
    repeated = scratch.save(real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct(*classes, "text_hash")).alias("most")).where("rows > 1"))
    if not repeated.isEmpty():
        # one text stands for an id
        keep = repeated.select("doc_id", F.col("most.text_hash").alias("standing"))
        stands = F.col("standing").isNull() | (F.col("standing") == F.col("text_hash"))
        real = real.join(keep, "doc_id", "left").where(stands).drop("standing")
        docs = docs.withColumn("text_hash", F.xxhash64("text")).join(keep, "doc_id", "left").where(stands).select("doc_id", "text")
    reps = scratch.save(real.groupBy(*classes).agg(F.min(F.struct("doc_id", "sig")).alias("r")).select(
        *classes, F.col("r.doc_id").alias("id"), F.col("r.sig").alias("sig")))
    prefixed = _prefixes(reps, scratch)
    first = scratch.save(_hub_pairs(prefixed))
    stars = _confirm_stars(docs, first, width, percent, scratch)
    links = stars.where("kind = 0").select("a", "b")
    label = scratch.save(connected_components(links, scratch).select(F.col("node").alias("id"), "component"))
    # a short list is filled up with its own last star
    own = F.sort_array(F.collect_set("b"))
    member = scratch.save(stars.where("kind = 1").groupBy(F.col("a").alias("id")).agg(own.alias("s")).select(
        "id", F.transform(F.sequence(F.lit(1), F.lit(STARS)), lambda k: F.element_at("s", F.least(k, F.size("s")))).alias("stars")))
    more = scratch.save(_cross_pairs(prefixed, label, member, scratch))
    links = scratch.save(links.union(_confirm(docs, more, width, percent, scratch)))
    scratch.drop(prefixed, first, more, label, member)
    # the copies of one id or one set are linked through their representative
    least = connected_components(links, scratch)
    member = real.join(reps.select(*classes, "id"), classes).select("doc_id", F.col("id").alias("node"))
    doc_label = member.join(least, "node", "left").select(
        "doc_id", F.coalesce("component", "node").alias("component")).groupBy("doc_id").agg(F.min("component").alias("component"))
    return sets.join(doc_label, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component"), F.col("doc_id")).eqNullSafe(F.col("doc_id")).alias("kept"))
