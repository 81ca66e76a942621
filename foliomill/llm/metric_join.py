"""Exact join of shingle sets by Jaccard similarity, as a join in a metric space.

The Jaccard distance 1 - |x & y| / |x | y| is a metric; texts link at a distance of r = 1 - least or less.

1. Nearly all texts share nothing and are at distance 1 of each other, where no pivot text can tell them
   apart.  So the first pivots are single shingles.  With all shingles in one order, x and y at r or less
   share one among the first |x| - ceil(least |x|) + 1 of x and as many of y, so x lies in the regions of these
   shingles and no link leaves them.  Shingles that are frequent in a sketch come last.
2. Where texts meet in a region, a second metric bounds them: |x ^ y|, the size of the symmetric difference,
   is at most (1 - least) / (1 + least) (|x| + |y|) for a link.  The sets of all shingles of one hash class, CLASSES of them,
   are pivots whose distances to x and y give a lower bound of |x ^ y|; pairs beyond the bound are no links.
   The bound tells short sets apart best, so long sets are cut by hash into parts of PART shingles at most: if x and y are
   similar, so is one of their parts at least, as all shared shingles lie in parts and so do those of the union.  Steps 1
   and 2 run on parts.  What is left connects texts into regions without links between them.
3. A region that is too large for one task gets pivots from its own texts.  Each text goes home to the nearest
   pivot's Voronoi region, if its distance is at most RHO, else to the far region.  If x is at home with p and y
   links with x, then d(y, p) <= d(x, p) + r, so y must come to p's region from its own, nearest pivot q, only
   where d(y, p) <= min(RHO, d(y, q) + r) + r.  Texts within r of a pivot are linked with it on the spot; a region
   whose texts are all connected already goes.  What is still too large is split again with new pivots; two
   texts need comparing unless both were guests in the same round;
   after ROUNDS it is dealt into blocks of which every two meet, so that no link is lost.
4. A region that fits one task is joined there exactly.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import ragged_take, shuffle_partitions, sub_batches, text_or_empty, written
from foliomill.llm.shingles import SLICE, bucket, pairs_of, prefixes, shingle_sets, sketch
from foliomill.llm.simhash import components

#: Hash classes; the numbers of a set's shingles in each are kept modulo 16.
CLASSES, CLASS_BITS = 32, 5
#: Shingles of a part, on average.
PART = 160
#: Bits of the filter of texts that are in a region; more texts than bits only let more through.
FILTER_BITS, FILTER_CHUNKS = 1 << 23, 64
#: Runs up to this length are compared by shifting arrays.
SMALL_RUN = 16
#: Texts of one shingle that are compared with each other; more are connected in a chain, which only makes a region larger.
RUN = 8192
#: Bytes of sets (8 a shingle) of a region that one task joins.
LIMIT = 24 << 20
#: Distance up to which texts are at home with a pivot.
RHO = 0.6
#: Rounds of pivots before what is still too large is dealt into blocks.
ROUNDS = 3
#: A text at home in all rounds; bit k is cleared where it is a guest in round k.
ALL_HOME = -1
#: Pivots of a region, at least and at most.
PIVOTS = (8, 64)


def class_counts(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set: how many of its hashes are in each class, modulo 16, as two words."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * CLASSES + (hashes & np.uint64(CLASSES - 1)).astype(np.int64), minlength=n * CLASSES).reshape(n, CLASSES) & 15
    return (counts[:, ::2] | counts[:, 1::2] << 4).astype(np.uint8).view(np.int64)


def _nibbles(words: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), CLASSES // 2)
    return np.concatenate([raw & 15, raw >> 4], 1)


def least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference, from counts modulo 16."""
    apart = (a - b) & 15
    return np.minimum(apart, 16 - apart).sum(-1, dtype=np.int64)


def _may_link(size_a, size_b, counts_a, counts_b, least: float) -> np.ndarray:
    fits = np.minimum(size_a, size_b) >= least * np.maximum(size_a, size_b) - 1e-9
    return fits & (least_difference(counts_a, counts_b) <= (1 - least) / (1 + least) * (size_a + size_b) + 1e-9)


def run_links(key: np.ndarray, size: np.ndarray, counts: np.ndarray, node: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the nodes of each run of equal keys as all pairs that may link would."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
    lengths = np.diff(edges)
    some = np.repeat((lengths > 1) & (lengths <= SMALL_RUN), lengths)
    k, s, c, v = key[some], size[some], _nibbles(counts[some]), node[some]
    for step in range(1, SMALL_RUN):
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        near = _may_link(s[at], s[at + step], c[at], c[at + step], least)
        a.append(v[at][near])
        b.append(v[at + step][near])
    for i in np.flatnonzero(lengths > SMALL_RUN):
        s, v = size[edges[i] : edges[i + 1]], node[edges[i] : edges[i + 1]]
        if len(v) > RUN:
            a.append(v[:-1])
            b.append(v[1:])
            continue
        c, left = _nibbles(counts[edges[i] : edges[i + 1]]), np.arange(len(v))
        while len(left) > 1:  # breadth first: what is reached is held against what isn't reached yet
            frontier, left = [left[0]], left[1:]
            while frontier and len(left):
                p = frontier.pop()
                near = _may_link(s[left], s[p], c[left], c[p], least)
                if near.any():
                    reached, left = left[near], left[~near]
                    a.append(np.full(len(reached), v[p]))
                    b.append(v[reached])
                    frontier.extend(reached.tolist())
    return np.concatenate(a), np.concatenate(b)


def levels(sizes: np.ndarray) -> np.ndarray:
    """A set of this size has 2^level parts."""
    return np.ceil(np.log2(np.maximum(sizes / PART, 1))).astype(np.int64)


def cut(hashes: np.ndarray, offsets: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set in its 2^level parts: values and offsets of the parts, and the set of each."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    base = np.concatenate([[0], np.cumsum(1 << level)])
    doc = np.repeat(np.arange(n), sizes)
    part = base[doc] + ((hashes >> np.uint64(CLASS_BITS)).astype(np.int64) & (1 << level[doc]) - 1)
    order = np.argsort(part, kind="stable")
    return hashes[order], np.concatenate([[0], np.cumsum(np.bincount(part, minlength=base[-1]))]), np.repeat(np.arange(n), 1 << level)


def part_keys(hashes: np.ndarray, offsets: np.ndarray, ranks: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Keys of all parts, and each key's part size, counts and set.

    Similar sets must be cut alike, so a set is also cut as the smallest that may link with it is.
    """
    sizes = np.diff(offsets)
    own, lower = levels(sizes), levels(np.ceil(least * sizes - 1e-9))
    out = []
    for which, level in ((np.arange(len(sizes)), own), (np.flatnonzero(lower < own), lower)):
        values, edges = ragged_take(hashes, offsets, which)
        parts, bounds, owner = cut(values, edges, level[which])
        keys, at = prefixes(parts, bounds, ranks[bucket(parts)], least)
        mixed = keys ^ (level[which][owner[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out.append((mixed.view(np.int64), np.diff(bounds)[at], class_counts(parts, bounds)[at], which[owner[at]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def shingle_regions(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """From (_row, _text): rows (a, b) that connect texts of which a part may link, and rows (a, size) with the number of shingles of each."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(sketch(texts, shingle))  # of a fixed size

    def keys_of(batches):
        for whole in batches:
            for batch in sub_batches(whole, 1, SLICE):
                hashes, offsets = sets_of(batch.column(1), shingle)
                keys, sizes, counts, doc = part_keys(hashes, offsets, shared.value, least)
                rows, n = batch.column(0).to_numpy(), len(batch)
                # A text's own row has its size and no counts; it may stand under any key.
                alone = np.arange(len(keys) + n) >= len(keys)
                columns = [np.concatenate([keys, rows * np.int64(0x9E3779B97F4A7C1)]), np.concatenate([sizes, np.diff(offsets)]).astype(np.int32), np.concatenate([rows[doc], rows])]
                counts = np.concatenate([counts, np.zeros((n, 2), np.int64)])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(counts[:, 0], mask=alone), pa.array(counts[:, 1], mask=alone)], ["key", "size", "node", "c0", "c1"])

    def meet(batches):
        held = np.zeros((5, 0), np.int64)
        for batch in batches:
            own = batch.column(3).is_null()
            sizes = batch.filter(own)
            if sizes.num_rows:
                yield pa.RecordBatch.from_arrays([sizes.column(2), pa.nulls(sizes.num_rows, pa.int64()), sizes.column(1)], ["a", "b", "size"])
            keyed = batch.filter(pc.invert(own))
            held = np.concatenate([held, np.stack([keyed.column(i).to_numpy().astype(np.int64) for i in range(5)])], 1)
            if not held.shape[1]:
                continue
            cut = int(np.searchsorted(held[0], held[0, -1]))  # the last run may go on in the next batch
            if cut:
                yield connect(held[:, :cut])
                held = held[:, cut:]
            if held.shape[1] > 4 * RUN:  # a run that is linked in a chain; its last row joins it to what follows
                yield connect(held)
                held = held[:, -1:]
        yield connect(held)

    def connect(held):
        a, b = run_links(held[0], held[1], held[3:].T, held[2], least)
        links = pairs_of(a, b)
        return pa.RecordBatch.from_arrays([*links.columns, pa.nulls(links.num_rows, pa.int32())], ["a", "b", "size"])

    keyed = texts.mapInArrow(keys_of, "key long, size int, node long, c0 long, c1 long")
    dealt = keyed.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "size", "node")
    return dealt.mapInArrow(meet, "a long, b long, size int")


def sets_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, and where each text's begin; texts without words have none."""
    hashes, offsets = shingle_sets(texts, shingle)
    blank = np.diff(offsets) == 1
    if blank.any():  # shingle_sets gives texts without words one shingle 0
        blank &= hashes[np.minimum(offsets[:-1], len(hashes) - 1)] == 0
        hashes = hashes[~np.repeat(blank, np.diff(offsets))]
        offsets = np.concatenate([[0], np.cumsum(np.where(blank, 0, np.diff(offsets)))])
    return hashes, offsets


def join_region(hashes: np.ndarray, offsets: np.ndarray, known: np.ndarray, home: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the sets of a region as all its links would, where sets of equal `known` are connected already.

    Breadth first: what is reached is held against sets that aren't reached yet and share a value of its prefix.
    home has a bit for each round of pivots; two sets that were both guests in one round needn't be compared.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    values, codes, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    codes = codes.reshape(-1)
    keys, owner = prefixes(codes, offsets, counts[codes], least)
    shared = counts[keys] > 1
    keys, owner = keys[shared], owner[shared]
    own = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    posted = owner[np.argsort(keys, kind="stable")]
    posts = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=len(values)))])
    _, group = np.unique(known, return_inverse=True)
    peers, peer_edges = np.argsort(group.reshape(-1), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group.reshape(-1)))])
    group = group.reshape(-1)
    done, mark = np.zeros(n, bool), np.zeros(len(values), bool)
    seen_group = np.zeros(len(peer_edges) - 1, bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def enter(sets: np.ndarray) -> list[int]:
        """All sets connected already with these."""
        fresh = np.unique(group[sets])
        fresh = fresh[~seen_group[fresh]]
        seen_group[fresh] = True
        found, _ = ragged_take(peers, peer_edges, fresh)
        done[found] = True
        return found.tolist()

    for seed in range(n):
        if done[seed]:
            continue
        frontier = enter(np.array([seed]))
        while frontier:
            p = frontier.pop()
            met, _ = ragged_take(posted, posts, keys[own[p] : own[p + 1]])
            met = np.unique(met[~done[met]])
            met = met[(~(home[met] | home[p]) == 0) & (np.minimum(sizes[met], sizes[p]) >= least * np.maximum(sizes[met], sizes[p]) - 1e-9)]
            if not len(met):
                continue
            mark[codes[offsets[p] : offsets[p + 1]]] = True
            theirs, edges = ragged_take(codes, offsets, met)
            both = np.add.reduceat(mark[theirs], edges[:-1], dtype=np.int64)
            mark[codes[offsets[p] : offsets[p + 1]]] = False
            new = met[both >= least * (sizes[met] + sizes[p] - both) - 1e-9]
            if len(new):
                a.append(np.full(len(new), p))
                b.append(new)
                frontier.extend(enter(new))
    return np.concatenate(a), np.concatenate(b)


def shared_counts(hashes: np.ndarray, offsets: np.ndarray, pivots: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many values each set shares with each pivot."""
    n, k = len(offsets) - 1, len(edges) - 1
    values, codes = np.unique(pivots, return_inverse=True)
    order = np.argsort(codes.reshape(-1), kind="stable")
    posted = np.repeat(np.arange(k), np.diff(edges))[order]
    posts = np.concatenate([[0], np.cumsum(np.bincount(codes.reshape(-1), minlength=len(values)))])
    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
    hit = np.flatnonzero(values[at] == hashes)
    found, runs = ragged_take(posted, posts, at[hit])
    doc = np.repeat(np.arange(n), np.diff(offsets))[hit]
    return np.bincount(np.repeat(doc, np.diff(runs)) * k + found, minlength=n * k).reshape(n, k)


def voronoi(distance: np.ndarray, radius: float, rho: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, region, at home) of all regions a set comes to, from its distances to the pivots; region -1 is the far one."""
    n, k = distance.shape
    nearest = distance.argmin(1)
    near = distance[np.arange(n), nearest]
    home = np.where(near <= rho, nearest, -1)
    window = distance <= (np.minimum(rho, near + radius) + radius + 1e-9)[:, None]
    # Of two homes one suffices: a set is a guest at pivots before its own; a far set is one at all.
    window &= (np.arange(k)[None, :] < home[:, None]) | (home < 0)[:, None]
    guest, region = np.nonzero(window)
    return np.concatenate([np.arange(n), guest]), np.concatenate([home, region]), np.arange(n + len(guest)) < n


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets stored as bytes: their values, and where each begins."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64), np.concatenate([[0], np.cumsum(lengths)])


def _split(large: DataFrame, sizes: DataFrame, seed: int, limit: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The Voronoi regions of large regions, and the links of texts with pivots."""
    spark = large.sparkSession
    wanted = F.greatest(F.lit(PIVOTS[0]), F.least(F.lit(PIVOTS[1]), F.ceil(4 * F.col("_bytes") / limit)))
    plan = sizes.select(F.col("region").alias("_r"), (wanted / F.col("_n")).alias("_share"), F.ceil(4 * F.col("_bytes") / limit).cast("int").alias("_salts"))
    joined = large.join(plan, F.col("region") == F.col("_r"))
    draw = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    columns = ["region", "salt", "first", "node", "known", "home", "set"]
    docs = joined.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(-seed)), F.col("_salts")).cast("int")).withColumn("first", F.lit(1)).select(columns)
    pivots = joined.where((F.col("home") == ALL_HOME) & (draw < F.col("_share"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).withColumn("first", F.lit(0)).select(columns)
    dealt = docs.unionAll(pivots).repartition(shuffle_partitions(spark), "region", "salt").sortWithinPartitions("region", "salt", "first", "node")

    def assign(batches):
        now, nodes, pivots, edges = None, [], [], [0]
        for whole in batches:
            for batch in sub_batches(whole, 6, SLICE):
                region, salt, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                stops = np.flatnonzero((region[1:] != region[:-1]) | (salt[1:] != salt[:-1]) | (first[1:] != first[:-1])) + 1
                for i, j in zip([0, *stops.tolist()], [*stops.tolist(), len(region)]):
                    if (region[i], salt[i]) != now:
                        now, nodes, pivots, edges = (region[i], salt[i]), [], [], [0]
                    part = batch.slice(i, j - i)
                    if not first[i]:
                        nodes += part.column(3).to_pylist()
                        values, bounds = _lists(part.column(6))
                        pivots.append(values)
                        edges += (bounds[1:] + edges[-1]).tolist()
                    else:
                        yield from place(part, np.array(nodes, np.int64), np.concatenate(pivots) if pivots else np.zeros(0, np.uint64), np.array(edges))

    def place(part, nodes, pivots, edges):
        own, was_home = part.column(3).to_numpy(), part.column(5).to_numpy()
        hashes, offsets = _lists(part.column(6))
        if not len(nodes):  # no pivot was drawn: all stays together for the next round
            which, cell, home = np.arange(len(own)), np.full(len(own), -1), np.ones(len(own), bool)
        else:
            both = shared_counts(hashes, offsets, pivots, edges)
            union = np.diff(offsets)[:, None] + np.diff(edges)[None, :] - both
            doc, pivot = np.nonzero(both >= least * union - 1e-9)
            links = pairs_of(own[doc], nodes[pivot])
            m = links.num_rows
            yield pa.RecordBatch.from_arrays([*links.columns, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], ["node", "to", "known", "home", "set"])
            which, cell, home = voronoi(1 - both / union, 1 - least, RHO)
            cell = np.where(cell < 0, -1, nodes[np.maximum(cell, 0)])
        for a in range(0, len(which), 4096):
            w = which[a : a + 4096]
            take = part.take(pa.array(w))
            mixed = (cell[a : a + 4096] * np.int64(0x5851F42D4C957F2D)) ^ take.column(0).to_numpy() * np.int64(31)
            yield pa.RecordBatch.from_arrays([take.column(3), pa.array(mixed), take.column(4), pa.array(was_home[w] & np.where(home[a : a + 4096], ALL_HOME, ~(1 << seed))), take.column(6)], ["node", "to", "known", "home", "set"])

    placed = written(dealt.mapInArrow(assign, "node long, to long, known long, home long, set binary"), "voronoi")
    links = placed.where("set IS NULL").select(F.col("node").alias("a"), F.col("to").alias("b"))
    return placed.where("set IS NOT NULL").select(F.xxhash64("to", F.lit(seed)).alias("region"), "node", "known", "home", "set"), links


def _in_blocks(large: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """Large regions as blocks, each two of which make a region."""
    plan = sizes.select(F.col("region").alias("_r"), F.ceil(2 * F.col("_bytes") / limit).cast("int").alias("_g"))
    mine = F.pmod(F.xxhash64("node"), F.col("_g")).cast("int")
    dealt = large.join(plan, F.col("region") == F.col("_r")).withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    pair = F.xxhash64("region", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    return dealt.select(pair.alias("region"), "node", "known", "home", "set")


def _filter_bits(nodes: np.ndarray) -> np.ndarray:
    return ((nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _node_filter(near: DataFrame) -> np.ndarray:
    """A bit for each node of `near` (_near), of a fixed size."""
    width = FILTER_BITS // FILTER_CHUNKS // 8

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_filter_bits(batch.column(0).to_numpy())] = True
        if bits.any():
            packed = np.packbits(bits).reshape(FILTER_CHUNKS, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(FILTER_CHUNKS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in packed], pa.binary())], ["chunk", "bits"])

    def either(key, table):
        total = np.zeros(width, np.uint8)
        for bits in table.column("bits"):
            total |= np.frombuffer(zlib.decompress(bits.as_py()), np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    schema, out = "chunk int, bits binary", np.zeros((FILTER_CHUNKS, width), np.uint8)
    for row in near.select("_near").mapInArrow(run, schema).groupBy("chunk").applyInArrow(either, schema).collect():  # FILTER_CHUNKS rows of a fixed size
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def region_sets(texts: DataFrame, near: DataFrame, shingle: int, split=sets_of) -> DataFrame:
    """From texts (_row, _text) and their regions (_near, region): (region, node, known, home, set).

    Each text is at home in its region, in all rounds to come, and known by itself.  Texts are filtered where they lie, and only
    the sets of those that may be in a region go to the join.
    """
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(_node_filter(near)))  # of a fixed size

    def run(batches):
        taken = None
        for whole in batches:
            if taken is None:
                taken = np.unpackbits(shared.value).astype(bool)
            some = whole.filter(pa.array(taken[_filter_bits(whole.column(0).to_numpy())]))
            for batch in sub_batches(some, 1, SLICE):
                hashes, offsets = split(batch.column(1), shingle)
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[8 * i : 8 * j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())], ["node", "set"])

    sets = texts.select("_row", "_text").mapInArrow(run, "node long, set binary")
    return sets.join(near, F.col("node") == F.col("_near")).select("region", "node", F.col("node").alias("known"), F.lit(ALL_HOME).cast("long").alias("home"), "set")


def exact_links(regions: DataFrame, least: float, limit: int, rounds: int) -> DataFrame:
    """Links (a, b) that connect the texts of each region as all its links would; regions are (region, node, known, home, set)."""
    spark, links = regions.sparkSession, []
    total = F.sum(F.length("set")).alias("_bytes")
    for step in range(rounds + 1):
        sizes = written(regions.groupBy("region").agg(total, F.count(F.lit(1)).alias("_n")).where(F.col("_bytes") > limit), "large-regions")
        if not sizes.limit(1).count():
            break
        small = regions.join(sizes.select("region"), "region", "left_anti")
        large = regions.join(sizes.select("region"), "region", "left_semi")
        if step == rounds:
            regions = small.unionByName(_in_blocks(large, sizes, limit))
            break
        placed, found = _split(large, sizes, step + 1, limit, least)
        links.append(found)
        # What the pivots have connected needn't be compared any more.
        classes = components(found).select(F.col("node").alias("_n"), F.col("root").alias("_root"))
        placed = placed.join(classes, F.col("node") == F.col("_n"), "left").select("region", "node", F.coalesce("_root", "known").alias("known"), "home", "set")
        open_ = placed.groupBy("region").agg(F.min("known").alias("_a"), F.max("known").alias("_b"), F.bit_or("home").alias("_c")).where((F.col("_a") < F.col("_b")) & (F.col("_c") == ALL_HOME)).select("region")
        regions = written(small.unionByName(placed.join(open_, "region", "left_semi")), "regions")
    dealt = regions.repartition(shuffle_partitions(spark), "region").sortWithinPartitions("region")

    def join(held):
        sets = [x for h in held for x in h[3]]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 8 for x in sets])])
        nodes, known, home = (np.concatenate([h[i] for h in held]) for i in range(3))
        a, b = join_region(np.frombuffer(b"".join(sets), np.uint64), offsets, known, home, least)
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    def compare(batches):
        now, held = None, []
        for whole in batches:
            for batch in sub_batches(whole, 4, 4 * SLICE):
                region = batch.column(0).to_numpy()
                stops = (np.flatnonzero(region[1:] != region[:-1]) + 1).tolist()
                for i, j in zip([0, *stops], [*stops, len(region)]):
                    if region[i] != now and held:
                        yield join(held)
                        held = []
                    now, part = region[i], batch.slice(i, j - i)
                    held.append((part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_pylist()))
        if held:
            yield join(held)

    found = written(dealt.mapInArrow(compare, "a long, b long"), "exact-links")
    for more in links:
        found = found.unionAll(more)
    return found


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, limit: int = LIMIT, rounds: int = ROUNDS) -> DataFrame:
    """id_col, n_shingles (distinct word shingles) and component_id (smallest id reachable by links) of each row.

    A text of fewer words is one shingle; a null, empty or blank one has none, links with nothing and
    has its own id as component_id.  Equal texts are one node, so copies are never compared.  Rows may repeat, ids
    too; a null id is smallest only where there is no other.  Texts of any length count whole; other
    columns are ignored; an empty table gives an empty result.  Shingles are compared by 64-bit hashes.
    """
    text = text_or_empty(F.col(f"`{text_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_sha"), text.alias("_text"))
    # Copies meet here, after partial aggregation.
    nodes = written(rows.groupBy("_sha").agg(F.first("_text").alias("_text"), F.min("_id").alias("_least")).withColumn("_row", F.monotonically_increasing_id()), "texts")
    met = written(shingle_regions(nodes.select("_row", "_text"), shingle, least), "met")
    near = written(components(met.where("b IS NOT NULL").select("a", "b").distinct()).select(F.col("node").alias("_near"), F.col("root").alias("region")), "near")

    regions = written(region_sets(nodes, near, shingle), "sets")
    linked = written(components(exact_links(regions, least, limit, rounds)).select(F.col("node").alias("_node"), F.col("root").alias("_root")), "linked")
    members = nodes.select("_row", "_least").join(linked, F.col("_row") == F.col("_node")).select("_node", "_root", "_least")
    smallest = members.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("_smallest"))
    named = written(linked.join(smallest, F.col("_root") == F.col("_r")).select("_node", "_smallest"), "named")
    sizes = met.where("size IS NOT NULL").select(F.col("a").alias("_a"), F.col("size").cast("long").alias("n_shingles"))
    labels = nodes.select("_row", "_sha", "_least").join(sizes, F.col("_row") == F.col("_a")).join(named, F.col("_row") == F.col("_node"), "left").select(
        F.col("_sha").alias("_of"), "n_shingles", F.coalesce("_smallest", "_least").alias("_component"))
    labels = written(labels, "labels")
    out = rows.select("_id", "_sha").join(labels, F.col("_sha") == F.col("_of"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("_id")).otherwise(F.col("_component")).alias("component_id"))
