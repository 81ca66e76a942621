"""Distinct users over trailing windows, from bitsets of each user's timeline.

A timeline (one key, one user) is cut into chunks of minutes.  A chunk's slot is a bitset of its
own minutes behind those of the longest window before it, so each chunk is exact by itself and a
click reaches a second chunk only from the last minutes of its own.  The slots of a batch lie side by
side in one big integer: shifting it by d moves every timeline by d minutes, and what runs over a
slot's end falls into the minutes before the next one's own.

* A minute has a user in its window of L if one of the L bits up to it is set: shifts by 1, 2, 4, ...
  dilate the bitset by L.
* Hot users: plane k has the minutes whose window holds k clicks or more.  Two adjoining windows
  hold k together if one holds i and the other k - i for some i, so planes of doubled windows come
  from ANDs and ORs of shifted planes.
* Where a dilated bitset's runs begin in a chunk a user is gained, where they end one is lost.  These
  edges are summed over users, and the prefix sum over a chunk's minutes counts the users.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import shuffle_partitions

#: Minutes of a chunk, at least; a day.
CHUNK = 1440
#: Timelines that a worker holds in one integer.
SLOTS = 8192


def dilate(bits: int, length: int) -> int:
    """The bits and those up to length - 1 places above each."""
    span = 1
    while span * 2 <= length:
        bits |= bits << span
        span *= 2
    return bits | bits << (length - span)


def joined_planes(a: list[int], b: list[int], shift: int) -> list[int]:
    """Planes of a window of two parts: `a` its last `shift` minutes, `b` those before them."""
    b = [plane << shift for plane in b]
    out = []
    for k in range(len(a)):
        plane = a[k] | b[k]
        for i in range(k):
            plane |= a[i] & b[k - 1 - i]
        out.append(plane)
    return out


def windowed_planes(planes: list[int], length: int) -> list[int]:
    """Thermometer planes (1 click or more, 2 or more, ...) of minutes, over windows of `length` minutes."""
    out, have, span = None, 0, 1
    while True:
        if length & span:
            out = joined_planes(out, planes, have) if out else planes
            have += span
        if have == length:
            return out
        planes = joined_planes(planes, planes, span)
        span *= 2


def _packed(at: np.ndarray, size: int) -> int:
    out = np.zeros(size, np.uint8)
    np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return int.from_bytes(out.tobytes(), "little")


def _unpacked(bits: int, size: int) -> np.ndarray:
    raw = bits.to_bytes(max(size, (bits.bit_length() + 7) // 8), "little")
    return np.frombuffer(raw, np.uint8, size)


def _places(flags: np.ndarray) -> np.ndarray:
    """Where the bits of a byte array are set."""
    some = np.flatnonzero(flags)
    byte, bit = np.nonzero(np.unpackbits(flags[some, None], axis=1, bitorder="little"))
    return some[byte] * 8 + bit


class Timelines:
    """The slots of one batch: minutes `at` (from the slot's first) of timelines `slot`, with the clicks of each."""

    def __init__(self, slot: np.ndarray, at: np.ndarray, clicks: np.ndarray, before: int, chunk: int):
        self.width = (before + chunk + 7) // 8 * 8
        own = np.zeros(self.width, np.uint8)
        own[before : before + chunk] = 1
        first = np.zeros(self.width, np.uint8)
        first[before] = 1
        self.own, self.first = np.packbits(own, bitorder="little"), np.packbits(first, bitorder="little")
        self.slot, self.place, self.clicks = slot, slot * self.width + at, clicks

    def edges(self, bits: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where runs begin in the own minutes, and places after those where they end there."""
        size = slots * self.width // 8
        now, last = _unpacked(bits, size).reshape(slots, -1), _unpacked(bits << 1, size).reshape(slots, -1)
        begin = now & (~last | self.first) & self.own
        end = ~now & last & self.own & ~self.first
        return _places(begin.reshape(-1)), _places(end.reshape(-1))

    def distinct(self, slots: int, lengths: list[int]):
        bits = _packed(self.place, slots * self.width // 8)
        for length in lengths:
            yield self.edges(dilate(bits, length), slots)

    def hot(self, slots: int, length: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.bincount(self.slot, self.clicks, slots)
        chosen = np.flatnonzero(total >= least)  # fewer clicks in all: never hot
        if not len(chosen):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.full(slots, -1)
        new[chosen] = np.arange(len(chosen))
        mine = new[self.slot] >= 0
        place = new[self.slot[mine]] * self.width + self.place[mine] % self.width
        size = len(chosen) * self.width // 8
        planes = [_packed(place[self.clicks[mine] >= k], size) for k in range(1, least + 1)]
        begin, end = self.edges(windowed_planes(planes, length)[-1], len(chosen))
        back = lambda p: chosen[p // self.width] * self.width + p % self.width
        return back(begin), back(end)


def minute_of(df: DataFrame, time_col: str) -> F.Column:
    """Minutes since 1970, floored; a time without a zone is read as UTC."""
    kind, col = df.schema[time_col].dataType, F.col(f"`{time_col}`")
    if isinstance(kind, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
    else:
        micros = F.unix_micros(col.cast("timestamp"))
    return ((micros - F.pmod(micros, F.lit(60_000_000))) / 60_000_000).cast("long")


def rolling_users(df: DataFrame, windows: dict[str, int], hot: tuple[str, int, int], id_col: str = "click_id", time_col: str = "ts",
                  user_col: str = "client_id", key_col: str = "kind", slots: int = SLOTS) -> DataFrame:
    """For each key and minute that holds a click: key, `minute`, and distinct users in each trailing window.

    `windows` names each window's column and minutes; `hot` is the column, the minutes and the least
    number of clicks of users counted as hot.  Rows without a time or a key take no part.  Of the
    others, rows of one id are one click (where they differ, that with the least time, key and user,
    users before null); rows without an id are clicks of their own.  Clicks without a user make their
    minute appear but count for nobody.  Other columns are ignored whatever their names; an empty table
    gives no rows.  A user's clicks of a minute are counted before they are dealt out, so that no
    timeline's chunk has more rows than minutes.
    """
    (hot_name, hot_length, least), lengths = hot, list(windows.values())
    longest = max(*lengths, hot_length)
    before, chunk = longest - 1, max(CHUNK, longest)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{key_col}`").alias("_key"), F.col(f"`{user_col}`").alias("_user"), minute_of(df, time_col).alias("_minute"))
    rows = rows.where(F.col("_minute").isNotNull() & F.col("_key").isNotNull())
    alone = F.when(F.col("_id").isNull(), F.monotonically_increasing_id())
    clicks = rows.groupBy("_id", alone.alias("_alone")).agg(F.min(F.struct("_minute", "_key", F.col("_user").isNull().alias("_none"), "_user")).alias("_c"))
    per_minute = clicks.groupBy(F.col("_c._key").alias("key"), F.col("_c._user").alias("user"), F.col("_c._minute").alias("minute")).agg(
        F.least(F.count(F.lit(1)), F.lit(least)).cast("int").alias("n"))
    chunk_of = lambda minute: ((minute - F.pmod(minute, F.lit(chunk))) / chunk).cast("long")
    reach = F.when(F.col("user").isNull(), F.col("minute")).otherwise(F.col("minute") + before)
    dealt = per_minute.withColumn("chunk", F.explode(F.sequence(chunk_of(F.col("minute")), chunk_of(reach))))
    dealt = dealt.repartition(shuffle_partitions(df.sparkSession), "key", "user", "chunk").sortWithinPartitions("key", "chunk", "user", "minute")
    measures = [*windows, hot_name]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(["key", "chunk", "user", "minute", "n"])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < slots:
                continue
            starts = _starts(held)
            cut = int(starts[-1])  # the last timeline may go on in the next batch
            if cut:
                yield from _edges(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from _edges(held)

    def _starts(held: pa.Table) -> np.ndarray:
        codes = [held.column("key").combine_chunks().dictionary_encode().indices.to_numpy(), held.column("chunk").to_numpy(),
                 held.column("user").combine_chunks().dictionary_encode("encode").indices.to_numpy()]
        changes = np.zeros(held.num_rows, bool)
        changes[0] = True
        for code in codes:
            changes[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(changes)

    def _edges(held: pa.Table):
        starts = _starts(held)
        for i in range(0, len(starts), slots):
            until = starts[i + slots] if i + slots < len(starts) else held.num_rows
            yield _deltas(held.slice(int(starts[i]), int(until - starts[i])))

    def _deltas(held: pa.Table) -> pa.RecordBatch:
        key = held.column("key").combine_chunks().dictionary_encode()
        starts = _starts(held)
        count = len(starts)
        slot = np.repeat(np.arange(count), np.diff(np.append(starts, held.num_rows)))
        chunks, minutes, clicks = (held.column(c).to_numpy() for c in ("chunk", "minute", "n"))
        known = held.column("user").is_valid().to_numpy()
        lines = Timelines(slot[known], (minutes - chunks * chunk + before)[known], clicks[known], before, chunk)
        steps = [*lines.distinct(count, lengths), lines.hot(count, hot_length, least)]
        own = minutes >= chunks * chunk  # these minutes hold a click
        place = [slot[own] * lines.width + minutes[own] - chunks[own] * chunk + before]
        value, column = [np.ones(len(place[0]), np.int64)], [np.full(len(place[0]), len(measures))]
        for i, (begin, end) in enumerate(steps):
            place += [begin, end]
            value += [np.ones(len(begin), np.int64), np.full(len(end), -1)]
            column += [np.full(len(begin) + len(end), i)]
        place, value, column = np.concatenate(place), np.concatenate(value), np.concatenate(column)
        # Timelines of one key and chunk stand side by side; their edges are summed here.
        codes = key.indices.to_numpy()[starts]
        lead = np.concatenate([[0], np.cumsum((codes[1:] != codes[:-1]) | (chunks[starts][1:] != chunks[starts][:-1]))])
        cell = lead[place // lines.width] * lines.width + place % lines.width
        cells, where = np.unique(cell, return_inverse=True)
        sums = np.zeros((len(measures) + 1, len(cells)), np.int64)
        np.add.at(sums, (column, where.reshape(-1)), value)
        group = starts[np.concatenate([[0], np.flatnonzero(np.diff(lead)) + 1])][cells // lines.width]
        return pa.RecordBatch.from_arrays(
            [key.dictionary.take(key.indices.take(pa.array(group))), pa.array(chunks[group]), pa.array(chunks[group] * chunk - before + cells % lines.width), *map(pa.array, sums)],
            ["key", "chunk", "minute", *[f"d{i}" for i in range(len(measures))], "clicks"])

    steps = [f"d{i}" for i in range(len(measures))]
    key_type = df.schema[key_col].dataType
    schema = T.StructType([T.StructField("key", key_type), *(T.StructField(c, T.LongType()) for c in ["chunk", "minute", *steps, "clicks"])])
    edges = dealt.mapInArrow(run, schema).groupBy("key", "chunk", "minute").agg(*[F.sum(c).alias(c) for c in [*steps, "clicks"]])
    so_far = Window.partitionBy("key", "chunk").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)  # a chunk's minutes at most
    counted = edges.select("key", "minute", "clicks", *[F.sum(c).over(so_far).alias(c) for c in steps])
    return counted.where(F.col("clicks") > 0).select(F.col("key").alias(key_col), "minute", *[F.col(c).alias(name) for c, name in zip(steps, measures)])
