"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers from 1 to the capacity, so all pieces together are a histogram with
`capacity` entries, however many there are.  The packer works on the histogram: the largest
length left opens a bin, undominated fillings of the rest of the bin are enumerated, and a
branch-and-bound over them prunes by the waste that the incumbent still allows.  Best-fit
decreasing gives the first incumbent.  A filling is used as many times at once as the counts
allow, so a plan has a number of rows that depends on the capacity alone.

Pieces then find their bins by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.bpe import PRE_TOKEN, WHITE_SPACE, byte_alphabet, codec
from foliomill.llm.common import gapless_positions, sub_batches, text_or_empty, tokenizer_path, with_fields, written

CAPACITY = 2048
END_ID = 0
#: Characters of a run of white space beyond which a text goes through this library's own codec.
LONG_BLANK = 20_000
_LONG_BLANK = re.compile(f"[{WHITE_SPACE}]{{{LONG_BLANK}}}")


@dataclass(frozen=True)
class Fill:
    """`times` bins that hold these lengths, largest first."""

    lengths: tuple[int, ...]
    times: int


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the sum's, and for each k the large lengths that can't share."""
    sizes = np.array(sorted(counts), np.int64)
    number = np.array([counts[n] for n in sizes.tolist()], np.int64)
    upto, mass = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(sizes * number)])
    half, total = int(np.searchsorted(sizes, capacity // 2, side="right")), int(mass[-1])
    best = max(-(-total // capacity), int(upto[-1] - upto[half]))
    for k in sorted({min(n, capacity - n) for n in counts if n < capacity} - {0}):
        low, high = int(np.searchsorted(sizes, k)), int(np.searchsorted(sizes, capacity - k, side="right"))
        over, alone = int(upto[-1] - upto[high]), int(upto[high] - upto[half])
        room, rest = alone * capacity - int(mass[high] - mass[half]), int(mass[half] - mass[low])
        best = max(best, over + alone + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Fill]:
    """Each bin opens with the largest length left and takes the largest that still fits, again and again."""
    left, keys, plan = dict(counts), sorted(n for n, c in counts.items() if c), []
    while keys:
        room, fill = capacity, []
        used: Counter[int] = Counter()
        at = len(keys)
        while at:
            at = bisect.bisect_right(keys, room, 0, at)
            if not at:
                break
            n = keys[at - 1]
            take = min(left[n] - used[n], room // n)
            if take <= 0:
                at -= 1
                continue
            if used:  # a bin's later lengths are taken as often as fits; its opener once at a time is enough
                fill += [n] * take
                used[n] += take
                room -= n * take
            else:
                fill, used[n], room = [n], 1, room - n
                continue
            at -= 1
        times = min(left[n] // c for n, c in used.items())
        plan.append(Fill(tuple(fill), times))
        _take(left, keys, used, times)
    return plan


def _take(left: dict[int, int], keys: list[int], used: Counter, times: int) -> None:
    for n, c in used.items():
        left[n] -= c * times
        if not left[n]:
            keys.pop(bisect.bisect_left(keys, n))


def fillings(keys: list[int], left: dict[int, int], opener: int, capacity: int, waste: int, work: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of every undominated filling around `opener` that wastes `waste` at most, larger lengths first.

    A filling is dominated if a length that is left fits beside it, or fits in the place of a
    smaller one, or of several that fill its room.  Each step is taken off work[0]; at 0 it ends.
    """
    used, fill, room = Counter({opener: 1}), [], capacity - opener
    at, fits = [bisect.bisect_right(keys, room)], [False]

    def undominated() -> bool:
        for over in (0, *set(fill)):
            i = bisect.bisect_right(keys, over)
            while i < len(keys) and keys[i] <= over + room:
                if left[keys[i]] > used[keys[i]]:
                    return False
                i += 1
        return True

    while at:
        if at[-1]:
            at[-1] -= 1
            n = keys[at[-1]]
            if left[n] <= used[n]:
                continue
            work[0] -= 1
            if work[0] <= 0:
                return
            fits[-1] = True
            if n == room:
                at[-1] = 0  # it fills the room, so it dominates all smaller ones
            fill.append(n)
            used[n] += 1
            room -= n
            at.append(bisect.bisect_right(keys, min(room, n)))
            fits.append(False)
            continue
        if not fits[-1] and room <= waste and undominated():
            yield room, (opener, *fill)
        at.pop()
        fits.pop()
        if fill:
            n = fill.pop()
            used[n] -= 1
            room += n


#: Steps of the search that a new node costs, as it copies the histogram; fillings that a node sorts by their waste at a time.
NODE_WORK, SORTED = 50, 16


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, work: int = 1_000_000) -> list[Fill]:
    """A plan with as few bins as the search finds; the best-fit plan is the first incumbent.

    The search goes depth first over the undominated fillings around the largest length left and
    prunes by the waste that a better plan may have.  Every branch is walked unless `work` steps
    are used up, in any run alike; the incumbent is taken then, and all lengths are in it.
    """
    counts = {int(n): int(c) for n, c in counts.items() if c > 0}
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("lengths lie between 1 and the capacity")
    best = best_fit_decreasing(counts, capacity)
    bins = sum(f.times for f in best)
    target, total, budget = lower_bound(counts, capacity), sum(n * c for n, c in counts.items()), [work]

    def options(left: dict[int, int], wasted: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        keys = sorted(n for n, c in left.items() if c)
        found = fillings(keys, left, keys[-1], capacity, (bins - 1) * capacity - total - wasted, budget)
        while some := sorted(islice(found, SORTED)):
            yield from some

    # A depth-first walk with its own stack: (counts left, fillings so far, bins, waste so far, fillings to try).
    stack = [(counts, None, 0, 0, options(counts, 0))]
    while stack and bins > target and budget[0] > 0:
        left, chain, used_bins, wasted, tries = stack[-1]
        waste, fill = next(tries, (0, None))
        if fill is None:
            stack.pop()
            continue
        allowed = (bins - 1) * capacity - total - wasted
        if waste > allowed:
            continue
        use = Counter(fill)
        times = min(left[n] // c for n, c in use.items())
        if waste:
            times = min(times, max(1, allowed // waste))
        for k in sorted({1, times}):  # once, and on top, so tried before it, as often as it can be
            after = dict(left)
            for n, c in use.items():
                after[n] -= c * k
            budget[0] -= NODE_WORK
            node = (after, (Fill(fill, k), chain), used_bins + k, wasted + waste * k)
            if not any(after.values()):
                if node[2] < bins:
                    best, bins = _unwound(node[1]), node[2]
            elif node[2] + -(-sum(n * c for n, c in after.items()) // capacity) < bins:
                stack.append((*node, options(after, node[3])))
    return best


def _unwound(chain) -> list[Fill]:
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


@dataclass(frozen=True)
class Segments:
    """For ranks of a length, in order: first key (length, rank), first bin, copies in a bin, offset."""

    keys: np.ndarray
    bins: np.ndarray
    copies: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, plan: list[Fill]) -> Segments:
        next_rank: Counter[int] = Counter()
        rows, first_bin = [], 0
        for fill in plan:
            offset = 0
            for n, copies in sorted(Counter(fill.lengths).items(), reverse=True):
                rows.append((n << 48 | next_rank[n], first_bin, copies, offset))
                next_rank[n] += copies * fill.times
                offset += n * copies
            first_bin += fill.times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(*(np.ascontiguousarray(table[:, i]) for i in range(4)))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << 48 | rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        inside = key - self.keys[at]
        return self.bins[at] + inside // self.copies[at], self.offsets[at] + inside % self.copies[at] * length


@functools.lru_cache(maxsize=2)
def token_encoder(path: str):
    """The public library's fast encoder over the vocabulary of the tokenizer file, and its special tokens."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    encoding = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN.replace("\\Z", "$"), mergeable_ranks=ranks, special_tokens=special)
    return encoding, set(special)


def has_long_blank(text: str) -> bool:
    """Is there a run of white space on which the fast encoder's pattern would run out of stack?"""
    return len(text) >= LONG_BLANK and _LONG_BLANK.search(text) is not None


def ids_of(text: str, path: str) -> np.ndarray:
    """Ids of a whole text; special tokens in it become their own ids."""
    if has_long_blank(text):
        return np.array(codec(path).encode(text), np.uint32)
    encoding, special = token_encoder(path)
    return np.asarray(encoding.encode_to_numpy(text, allowed_special=special, disallowed_special=()), np.uint32)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Cut each document's ids (its text's, then END_ID) into pieces of at most `capacity`.

    All pieces but the first are full, so only the first may be shorter.  Null texts count as
    empty and give one piece of one id; each row is cut for itself, whatever its id.
    Returns id_col, piece, start, length, ids_crc32 and ids (array).
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    names = [id_col, "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches):
        for whole in batches:
            for batch in sub_batches(whole, 1, 8 << 20):
                owner, piece, start, length, crc, flat = [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids = np.append(ids_of(text, path), np.uint32(END_ID))
                    first = (len(ids) - 1) % capacity + 1
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                        owner.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].astype("<u4", copy=False).tobytes()))
                    flat.append(ids)
                values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64()), lists], names)

    source = docs.select(F.col(f"`{id_col}`"), text_or_empty(F.col(f"`{text_col}`")).alias("__pack_text"))
    schema = with_fields(source.select(id_col).schema, "piece int, start long, length long, ids_crc32 long, ids array<int>")
    return source.mapInArrow(run, schema)


def plan_for(cut: DataFrame, capacity: int = CAPACITY) -> list[Fill]:
    """The plan for all pieces; what reaches the driver is one count for each length."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return bin_completion(counts, capacity)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack every piece of every document into sequences of at most `capacity` tokens.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).
    Texts of any length and kind are encoded whole, also long runs of one character.  An empty table
    gives an empty result.
    """
    cut = pieces(docs, id_col, text_col, capacity, path).withColumn("_piece_file", F.spark_partition_id())
    cut = written(cut if with_ids else cut.drop("ids"), "pieces")
    segments = Segments.of(plan_for(cut, capacity))
    order = ["start", "ids_crc32", f"`{id_col}`"]
    ranked = gapless_positions(cut, "length", order, "_rank", "_piece_file").drop("_piece_file")
    names = [c for c in ranked.columns if c != "_rank"]
    shared = docs.sparkSession.sparkContext.broadcast(segments)  # its size depends on the capacity alone

    def place(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            length, rank = (pc.cast(batch.column(at[c]), pa.int64()).to_numpy() for c in ("length", "_rank"))
            sequence, offset = shared.value.place(length, rank) if len(length) else (length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, with_fields(ranked.drop("_rank").schema, "sequence_id long, offset long"))
