"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits in two halves.  Fingerprints that differ in at most 4 (max_bits) bits
differ in at most 2 bits of one half.  In each half, 31 bits lie in the space of the perfect
Hamming code [31, 26]: its 2^26 code words are the anchors, and every point is within the
covering radius R = 1 of one.  Two points that differ in t bits have a point midway that is
within ceil(t / 2) of both, and the anchor that covers it is within R + ceil(t / 2) of both.
So each fingerprint is replicated to every anchor within that radius (16 anchors a half for 4
bits), and comparing what meets at an anchor finds every link.

At an anchor a spanning forest of the links is returned, not all pairs.  Components come from
hooking and pointer jumping over tables in the shared folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import discard, shuffle_partitions, sub_batches, text_or_empty, with_fields, written

SEED = 42
CODE_BITS = 31
#: Fingerprints at one anchor that one task compares; beyond, they are dealt into blocks and all pairs of blocks are compared.
BLOCK = 16_384
#: Share of fingerprints by which large anchors are looked for; missing one costs time, not links.
LOOK = 64
SMALL_RUN = 16


def shingle_hashes(texts: pa.Array, shingle: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of all shingles, text after text, and how many each text has; no words: none."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words = lists.flatten()
    owner = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if (some := lengths > 0).sum() < len(lengths):
        words, owner, lengths = words.filter(pa.array(some)), owner[some], lengths[some]
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    # Words with one space after each lie in one buffer; a shingle is a slice of it.
    spaced = pc.binary_join_element_wise(words, pa.scalar(" "), "")
    data = memoryview(spaced.buffers()[2])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = starts + lengths
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    per_doc = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(n), per_doc)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + first[doc]
    until = np.minimum(at + shingle, first[doc] + count[doc]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[until].tolist())), np.uint64, len(at))
    return hashes, per_doc


def fingerprints_of(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """64-bit fingerprints (uint64) of texts; no words: 0."""
    return majorities(*shingle_hashes(texts, shingle))


def majorities(hashes: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """The bits that over half of each run of hashes have; an empty run: 0."""
    out = np.zeros(len(per_doc), np.uint64)
    if not len(hashes):
        return out
    has = np.flatnonzero(per_doc)
    edges = np.concatenate([[0], np.cumsum(per_doc[has])])
    for a in range(0, len(has), 512):  # the bits of 512 documents at a time
        group = has[a : a + 512]
        own = edges[a : a + len(group) + 1]
        for i, sums in _bit_sums(hashes, own):
            bits = sums * 2 > per_doc[group[i], None]
            out[group[i]] = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _bit_sums(hashes: np.ndarray, edges: np.ndarray, most: int = 1 << 18):
    """For runs of hashes between edges: indices of runs, and how often each bit is set."""
    start = 0
    while start < len(edges) - 1:
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + most, side="right")) - 1)
        if stop == start + 1:  # one run, however long
            sums = np.zeros((1, 64), np.int64)
            for a in range(int(edges[start]), int(edges[stop]), most):
                sums[0] += _bits(hashes[a : min(a + most, int(edges[stop]))]).sum(0, dtype=np.int64)
        else:
            sums = np.add.reduceat(_bits(hashes[edges[start] : edges[stop]]), edges[start:stop] - edges[start], axis=0, dtype=np.int32)
        yield slice(start, stop), sums
        start = stop


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id_col and `fp` (the 64 bits as a long) of each row; null texts count as empty."""

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, 1):
                prints = fingerprints_of(batch.column(1), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], [id_col, "fp"])

    source = df.select(F.col(f"`{id_col}`"), text_or_empty(F.col(f"`{text_col}`")).alias("__sim_text"))
    return source.mapInArrow(run, with_fields(source.select(id_col).schema, "fp long"))


def error_patterns(radius: int) -> list[np.ndarray]:
    """For each syndrome: the patterns of at most `radius` flipped bits that lead to a code word."""
    found: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for weight in range(radius + 1):
        for places in combinations(range(1, CODE_BITS + 1), weight):
            syndrome, pattern = 0, 0
            for p in places:
                syndrome ^= p
                pattern |= 1 << (p - 1)
            found[syndrome].append(pattern)
    return [np.array(p, np.uint64) for p in found]


def syndromes(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    for bit in range(5):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> bit & 1))
        out |= (np.bitwise_count(points & mask).astype(np.int64) & 1) << bit
    return out


def anchors_of(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (anchor, index of the fingerprint) within the radius, for both halves."""
    patterns, mask = error_patterns(radius), np.uint64((1 << CODE_BITS) - 1)
    anchors, index = [], []
    for half in (0, 1):
        points = (prints >> np.uint64(32 * half)) & mask
        syndrome = syndromes(points)
        for s in range(CODE_BITS + 1):
            own = np.flatnonzero(syndrome == s)
            if len(own) and len(patterns[s]):
                anchors.append((points[own, None] ^ patterns[s][None, :] | np.uint64(half << 32)).reshape(-1))
                index.append(np.repeat(own, len(patterns[s])))
    if not anchors:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(anchors), np.concatenate(index)


def forest(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of fingerprints that differ in at most max_bits bits.

    Breadth first: what is reached is held against what isn't reached yet, so a dense group
    costs little more than its size.
    """
    left, parents, children = prints, [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            p = frontier.pop()
            near = np.bitwise_count(left ^ p) <= max_bits
            if near.any():
                reached = left[near]
                left = left[~near]
                parents.append(np.full(len(reached), p, np.uint64))
                children.append(reached)
                frontier.extend(reached)
    if not parents:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(parents), np.concatenate(children)


def compare_runs(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: short runs by shifting the array, long ones by a forest."""
    a, b = [], []
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    for i in np.flatnonzero(sizes > SMALL_RUN):
        x, y = forest(np.unique(prints[edges[i] : edges[i + 1]]), max_bits)
        a.append(x)
        b.append(y)
    some = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
    keys, prints = keys[some], prints[some]
    for k in range(1, SMALL_RUN):
        same = np.flatnonzero(keys[k:] == keys[:-k])
        if not len(same):
            break
        x, y = prints[same], prints[same + k]
        near = (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
        a.append(x[near])
        b.append(y[near])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    x, y = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (column fp) as all links within max_bits would."""
    spark = distinct.sparkSession
    per_half = max_bits // 2  # of two halves, one differs in no more than half the bits
    radius = 1 + -(-per_half // 2)

    def replicate(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                prints = whole.column(0).slice(at, 8192).to_numpy().view(np.uint64)
                anchors, index = anchors_of(prints, radius)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(prints[index].view(np.int64))], ["anchor", "fp"])

    # Anchors with many fingerprints, and into how many blocks theirs are dealt; a table, as there may be many.
    looked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(LOOK)) == 0).mapInArrow(replicate, "anchor long, fp long")
    seen = F.col("n") * LOOK
    hot = written(looked.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(seen > BLOCK).select(
        F.col("anchor").alias("_hot"), F.ceil(seen / BLOCK).cast("long").alias("_g")), "hot-anchors")

    def compare(batches):
        held_keys, held = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            keys, prints = np.concatenate([held_keys, keys]), np.concatenate([held, batch.column(2).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            # the last run may go on in the next batch
            other = np.flatnonzero((keys != keys[-1]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0
            held_keys, held = keys[cut:], prints[cut:]
            yield from _as_links(keys[:cut], prints[:cut])
        yield from _as_links(held_keys, held)

    def _as_links(keys, prints):
        if len(keys):
            run = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
            a, b = compare_runs(run, prints, max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    replicas = distinct.mapInArrow(replicate, "anchor long, fp long")
    if hot.limit(1).count():  # each block of a hot anchor meets each other, and itself
        g = F.coalesce("_g", F.lit(1))
        dealt = replicas.join(hot, F.col("anchor") == F.col("_hot"), "left").select(
            "anchor", "fp", g.alias("_g"), F.pmod(F.xxhash64("fp"), g).alias("_mine"), F.explode(F.sequence(F.lit(0).cast("long"), g - 1)).alias("_other"))
        replicas = dealt.select("anchor", (F.least("_mine", "_other") * F.col("_g") + F.greatest("_mine", "_other")).alias("block"), "fp")
    else:
        replicas = replicas.select("anchor", F.lit(0).cast("long").alias("block"), "fp")
    dealt = replicas.repartition(shuffle_partitions(spark), "anchor", "block").sortWithinPartitions("anchor", "block")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Rounds of hooking roots to smaller neighbours and jumping to the root's root, until nothing
    changes.  Only the number of changes reaches the driver.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = last = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("_n")).agg(F.min("root").alias("_m"))
        seen = labels.join(near, F.col("node") == F.col("_n"), "left").select("node", "root", F.least("root", "_m").alias("low"))
        seen = written(seen, "seen")
        hooks = seen.where("low < root").groupBy(F.col("root").alias("_h")).agg(F.min("low").alias("_to"))
        hooked = written(seen.join(hooks, F.col("node") == F.col("_h"), "left").select("node", F.col("root").alias("_old"), F.least("low", "_to").alias("_up")), "hooked")
        parents = hooked.select(F.col("node").alias("_p"), F.col("_up").alias("root"))
        jumped = written(hooked.join(parents, F.col("_up") == F.col("_p")).select("node", "root", (F.col("root") != F.col("_old")).alias("_new")), "jumped")
        discard(last, seen, hooked)
        labels, last = jumped.select("node", "root"), jumped
        if not jumped.where("_new").limit(1).count():
            discard(both)
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id (smallest id reachable) of each row.

    Texts without words (null, empty, blank) have the fingerprint 0 and link like any other.
    Rows with equal fingerprints are in one component, repeated rows and ids included; null ids
    don't count as smallest unless a component has no other.  Texts of any length count whole; an
    empty table gives an empty result.
    """
    prints = written(fingerprints(df, id_col, text_col, shingle), "fingerprints").withColumnRenamed(id_col, "_id")
    # Copies meet here, after partial aggregation: one row for each distinct fingerprint.
    distinct = written(prints.groupBy("fp").agg(F.min("_id").alias("_least")), "distinct-fingerprints")
    linked = components(links(distinct.select("fp"), max_bits))
    rooted = written(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root")), "rooted")
    least = written(rooted.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("component_id")), "least")
    classes = written(rooted.join(least, F.col("_root") == F.col("_r")).select(F.col("fp").alias("_fp"), "component_id"), "classes")
    return prints.join(classes, F.col("fp") == F.col("_fp")).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
