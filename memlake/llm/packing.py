"""Best-fit packing of tokenised documents into sequences of bounded length, in bulk-synchronous rounds.

Pieces of documents and the gaps of open sequences are sorted together by size into ranges, one for a task. A task sweeps its
range: each gap, the smallest first, takes the longest pieces that fit, and what is left of it stays a gap. Gaps that found
nothing look on in the ranges below: runs of such gaps and runs of pieces left over are matched like brackets, and conflicts
within a run are resolved by rank, the n-th gap having the n-th pieces. Gaps are then updated, all is sorted again, and so on
until nothing fits. Then the longest pieces open as many new sequences as the rest needs at least, and the rounds go on.

Only counts reach the driver: of pieces by length (as many as the capacity at most) and of what each range has left over.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.common import U64, bound_batches, cut, lean, mix, release, source_bytes, text_chunks

CAPACITY = 2048
SEPARATOR = 0
#: Slots of a worker's table of units, the most ids that one holds, and the most bytes of its unit.
SLOTS, WIDTH, UNIT = 1 << 20, 6, 16
#: Pieces and gaps of a range, and ranges at most.
SWEEP_ROWS, RANGES = 100_000, 20_000
#: Bytes of a piece or gap in a round's table.
ROW_BYTES = 64
#: Tables of placed pieces that a plan holds before they become one.
PARTS = 6
#: New sequences up to which their pieces are the exact longest ones; beyond it pieces of the last length are drawn by hash.
EXACT_SEEDS = 10_000

_BREAK_AFTER = np.ones(256, dtype=bool)
_BREAK_AFTER[:0x21] = False
_BREAK_AFTER[0x7F] = False
_BREAK_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # may begin white space beyond ASCII
_SPECIAL = "<|endoftext|>"
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


class UnitTokenizer:
    """Ids of whole texts, by units that byte-level BPE never joins: each begins at a space before a visible character.

    The ids of short units are remembered in a direct-mapped table beside the unit's bytes, which a lookup compares (a later unit
    takes the slot if its own has not been asked for since one last tried); units that aren't there are encoded, all different
    ones of a chunk as one text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)  # bytes of each token: a character for each
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        self.first, self.second = np.zeros(SLOTS, dtype=U64), np.zeros(SLOTS, dtype=U64)
        self.size, self.count = np.zeros(SLOTS, dtype=np.uint8), np.zeros(SLOTS, dtype=np.uint8)
        self.kept = np.zeros((SLOTS, WIDTH), dtype=np.uint32 if len(self.sizes) > 1 << 16 else np.uint16)
        self.used = np.zeros(SLOTS, dtype=bool)  # since a unit last wanted the slot

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encoded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some units, in a row, and where each unit's begin (with the end)."""
        # a document's first unit may begin without a space, so those come by themselves
        if all(u[0] == 0x20 for u in units) and _SPECIAL.encode() not in (text := b"".join(units)):
            ids = np.array(self.encode(text.decode("utf-8")), dtype=np.uint32)
            # the token that a unit's first byte begins; units end where tokens end
            return ids, np.searchsorted(np.concatenate([[0], np.cumsum(self.sizes[ids])]), np.cumsum([0, *map(len, units)]))
        each = [self.encode(u.decode("utf-8")) for u in units]
        return np.array([x for ids in each for x in ids], dtype=np.uint32), np.cumsum([0, *map(len, each)])

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids in a row, and how many each has. data has a byte more after each document."""
        begins = np.zeros(len(data), dtype=bool)
        np.logical_and(data[:-1] == 0x20, _BREAK_AFTER[data[1:]], out=begins[:-1])
        begins[start[end > start]] = True
        at = np.flatnonzero(begins)
        if not len(at):
            return np.empty(0, np.uint32), np.zeros(len(start), np.int64)
        to = np.append(at[1:], len(data))
        to = np.minimum(to, end[np.searchsorted(start, at, side="right") - 1])
        size = to - at
        padded = np.concatenate([data, np.zeros(UNIT, np.uint8)])
        word = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
        first = word[at] & _MASK[np.minimum(size, 8)]
        second = np.ndarray((len(data) + 1,), "<u8", buffer=padded, offset=8, strides=(1,))[at] & _MASK[np.clip(size - 8, 0, 8)]
        slot = (mix(first ^ mix(second + size.astype(U64))) & U64(SLOTS - 1)).astype(np.int64)
        hit = (self.first[slot] == first) & (self.second[slot] == second) & (self.size[slot] == size)
        self.used[slot[hit]] = True
        count = np.where(hit, self.count[slot], 0).astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            raw, different = data.tobytes(), {}
            inverse = np.array([different.setdefault(raw[a:b], len(different)) for a, b in zip(at[miss].tolist(), to[miss].tolist(), strict=True)])
            units = list(different)
            spaced = np.array([u[0] == 0x20 for u in units])
            flat, ends = self._encoded([u for u in units if u[0] == 0x20])
            more, more_ends = self._encoded([u for u in units if u[0] != 0x20])
            begin_of, n = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
            begin_of[spaced], n[spaced] = ends[:-1], np.diff(ends)
            begin_of[~spaced], n[~spaced] = more_ends[:-1] + len(flat), np.diff(more_ends)
            flat = np.concatenate([flat, more])
            count[miss] = n[inverse]
        total = np.cumsum(count)
        out = np.empty(total[-1], dtype=np.uint32)
        begin = total - count
        k, own, own_slot, own_count = 0, begin[hit], slot[hit], count[hit]
        while len(own):
            longer = own_count > k
            own, own_slot, own_count = own[longer], own_slot[longer], own_count[longer]
            out[own + k] = self.kept[own_slot, k] if len(own) else 0
            k += 1
        if len(miss):
            m = count[miss]
            stops = np.cumsum(m)
            within = np.arange(stops[-1]) - np.repeat(stops - m, m)
            out[np.repeat(begin[miss], m) + within] = flat[np.repeat(begin_of[inverse], m) + within]
            where = np.full(len(units), -1)
            where[inverse] = miss  # a place of each different unit
            keep = np.flatnonzero((n <= WIDTH) & (n > 0) & (size[where] <= UNIT))
            s = slot[where[keep]]
            _, last = np.unique(s[::-1], return_index=True)
            keep = keep[::-1][last]
            # what has been found since stays once more
            held = self.used[slot[where[keep]]]
            self.used[slot[where[keep[held]]]] = False
            keep = keep[~held]
            place = where[keep]
            s = slot[place]
            self.first[s], self.second[s], self.size[s], self.count[s] = first[place], second[place], size[place], n[keep]
            for k in range(WIDTH):
                longer = n[keep] > k
                self.kept[s[longer], k] = flat[begin_of[keep[longer]] + k]
        total = np.concatenate([[0], total])
        return out, total[np.searchsorted(at, end)] - total[np.searchsorted(at, start)]


_tokenizers: dict[str, UnitTokenizer] = {}


@lean
def pieces_of(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """doc_id, piece, start, length and CRC of the ids of every piece of every document."""
    tokenizer = _tokenizers.get(path) or _tokenizers.setdefault(path, UnitTokenizer(path))
    for batch in batches:
        doc_id = batch.column("doc_id")
        for chunk in text_chunks(batch.column("text")):
            ids, count = tokenizer.ids(chunk.data, chunk.start, chunk.end)
            stop = np.cumsum(count)
            rows: tuple[list, ...] = ([], [], [], [], [])
            for row, a, b in zip(chunk.rows.tolist(), (stop - count).tolist(), stop.tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(SEPARATOR)).astype("<u4")
                n, at, piece = len(own), 0, 0
                while at < n:
                    size = min(n, (n - at - 1) % capacity + 1 if not at else capacity)
                    for column, value in zip(rows, (row, piece, at, size, zlib.crc32(own[at : at + size].tobytes())), strict=True):
                        column.append(value)
                    at, piece = at + size, piece + 1
            yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def fill(gap: int, sizes: list[int], below: list[int]) -> list[int]:
    """Places of the longest pieces, one after the other, that a gap takes; sizes ascend, and below leads on from taken ones."""

    def free(i: int) -> int:  # the last piece left at place i or before it, counted from 1; 0 if there is none
        root = i
        while below[root] != root:
            root = below[root]
        while below[i] != root:
            below[i], i = root, below[i]
        return root

    out = []
    at = free(bisect_right(sizes, gap))
    while at:
        out.append(at - 1)
        below[at] = at - 1
        gap -= sizes[at - 1]
        at = free(min(at - 1, bisect_right(sizes, gap)))
    return out


@lean
def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range's rows (size, kind, id, part), in order: kind, id, size, sequence, before, place, part.

    Kind 2 is a piece that has found a sequence whose gap was `before`. Kind 0 is a piece left over and kind 1 a gap: a gap that has
    taken nothing has a place, as has every piece left over; they count from the smallest.
    """
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    size, kind, ids = (table[c].to_numpy() for c in ("size", "kind", "id"))
    piece = kind == 0
    sizes, names = size[piece].tolist(), ids[piece].tolist()
    below, rows, touched, place = list(range(len(sizes) + 1)), [], [], 0
    gone = np.zeros(len(sizes), dtype=bool)
    for gap, sequence in zip(size[~piece].tolist(), ids[~piece].tolist(), strict=True):
        taken = fill(gap, sizes, below)
        for i in taken:
            rows.append((2, names[i], sizes[i], sequence, gap, -1))
            gap -= sizes[i]
        gone[taken] = True
        if taken:
            touched.append((1, sequence, gap, sequence, gap, -1))
        else:
            touched.append((1, sequence, gap, sequence, gap, place))
            place += 1
    rows += touched
    left = np.flatnonzero(~gone)
    rows += [(0, names[i], sizes[i], 0, 0, n) for n, i in enumerate(left.tolist())]
    columns = list(zip(*rows, strict=True))
    types = (pa.int32(), *(pa.int64(),) * 5)
    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(np.full(len(rows), table["part"][0].as_py()), pa.int32())], names=["kind", "id", "size", "sequence", "before", "place", "part"])


def brackets(runs: dict[tuple[int, int], tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which pieces left over in a range go to which gaps of a range above: (part, first, number, gap part, first gap, pieces of a gap).

    runs: by (part, kind) the number of rows left over, their least and their largest size. Within a range, gaps that found nothing
    are smaller than the pieces left, so the nearest run of pieces below belongs to a run of gaps, the longest pieces first.
    """
    out, stack = [], []
    for part in sorted({p for p, _ in runs}):
        gaps, least, _ = runs.get((part, 1), (0, 0, 0))
        first = 0
        while gaps and stack:
            below, n, longest = stack.pop()
            each = max(1, least // longest)  # as many as any of these gaps holds
            used = min(gaps, -(-n // each))
            taken = min(n, used * each)
            out.append((below, n - taken, taken, part, first, each))
            first, gaps = first + used, gaps - used
            if n > taken:
                stack.append((below, n - taken, longest))
        pieces, _, longest = runs.get((part, 0), (0, 0, 0))
        if pieces:
            stack.append((part, pieces, longest))
    return out


def needed(counts: dict[int, int], capacity: int) -> int:
    """Sequences that pieces (number by length) need at least: by their sum, and by how many of a length go into one."""
    out, more = -(-sum(n * k for n, k in counts.items()) // capacity), 0
    for length in sorted(counts, reverse=True):
        more += counts[length]
        out = max(out, -(-more // (capacity // length)))
    return out


def seeds(pieces: DataFrame, counts: dict[int, int], number: int) -> tuple[DataFrame, DataFrame]:
    """The longest pieces (pid, length), so many of them (about so many beyond EXACT_SEEDS), and the others."""
    if number <= EXACT_SEEDS:
        chosen = pieces.orderBy(F.col("length").desc(), "pid").limit(number)
        last = cut(pieces.sparkSession, chosen)
        return last, pieces.join(F.broadcast(last.select("pid")), "pid", "left_anti")  # EXACT_SEEDS rows at most
    more = 0
    for length in sorted(counts, reverse=True):
        if more + counts[length] >= number:
            break
        more += counts[length]
    share = (number - more) / counts[length]
    drawn = F.pmod(F.xxhash64("pid"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    first = (F.col("length") > length) | ((F.col("length") == length) & drawn)
    return pieces.where(first), pieces.where(~first)


def place_all(spark: SparkSession, pieces: DataFrame, capacity: int, sweep_rows: int) -> DataFrame:
    """(pid, sequence_id, offset) of pieces (pid, length): the rounds."""

    def histogram(rows: DataFrame) -> dict[int, int]:
        return {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # as many as the capacity at most

    placed: list[DataFrame] = []

    def note(rows: DataFrame) -> None:
        placed.append(rows.select("pid", "sequence_id", F.col("offset").cast("long").alias("offset")))
        if len(placed) >= PARTS:  # a plan of all rounds' tables would grow with their number
            placed[:] = [cut(spark, reduce(DataFrame.unionByName, placed), ROW_BYTES * total)]

    gaps = spark.createDataFrame([], "sequence long, gap long")
    counts, n_gaps = histogram(pieces), 0
    total = sum(counts.values())
    while counts:
        # nothing fits: the longest pieces open sequences, which have their names
        number = needed(counts, capacity)
        first, pieces = seeds(pieces, counts, number)
        number = first.count()
        note(first.select("pid", F.col("pid").alias("sequence_id"), F.lit(0).alias("offset")))
        gaps = gaps.unionByName(first.select(F.col("pid").alias("sequence"), (F.lit(capacity) - F.col("length")).alias("gap")))
        left, n_gaps = sum(counts.values()) - number, n_gaps + number
        while left:
            ranges = max(1, min(RANGES, -(-(left + n_gaps) // sweep_rows)))
            both = pieces.select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("pid").alias("id"))
            both = both.unionByName(gaps.select(F.col("gap").alias("size"), F.lit(1).alias("kind"), F.col("sequence").alias("id")))
            dealt = both.repartitionByRange(ranges, "size", "kind", "id") if ranges > 1 else both.coalesce(1)
            dealt = dealt.sortWithinPartitions("size", "kind", "id").withColumn("part", F.spark_partition_id())
            swept = cut(spark, dealt.mapInArrow(sweep, "kind int, id long, size long, sequence long, before long, place long, part int"), ROW_BYTES * (left + n_gaps))
            rows = swept.groupBy("part", "kind", (F.col("place") >= 0).alias("open")).agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).collect()  # five rows a range at most
            runs = {(r["part"], r["kind"]): (r["n"], r["least"], r["most"]) for r in rows if r["open"]}
            found = swept.where("kind = 2").select(F.col("id").alias("pid"), F.col("sequence").alias("sequence_id"), "size", "before")
            pieces = swept.where("kind = 0").select(F.col("id").alias("pid"), F.col("size").alias("length"))
            gaps = swept.where("kind = 1").select("sequence", F.col("size").alias("gap"))
            number = sum(r["n"] for r in rows if r["kind"] == 2)
            if pairs := brackets(runs):
                number += sum(p[2] for p in pairs)
                links = F.broadcast(spark.createDataFrame(pairs, "part int, first long, number long, gap_part int, gap_first long, each long"))  # three rows a range at most
                rank = F.col("place") - F.col("first")
                ranked = swept.where("kind = 0").join(links, "part").where((rank >= 0) & (rank < F.col("number")))
                ranked = ranked.select("id", "size", F.col("gap_part").alias("part"), (F.col("gap_first") + F.floor(rank / F.col("each"))).alias("place"))
                met = ranked.join(swept.where("kind = 1 and place >= 0").select("part", "place", "sequence", F.col("size").alias("gap")), ["part", "place"])
                so_far = F.sum("size").over(Window.partitionBy("sequence").orderBy(F.col("size").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
                met = cut(spark, met.select(F.col("id").alias("pid"), F.col("sequence").alias("sequence_id"), "size", (F.col("gap") - so_far + F.col("size")).alias("before")), ROW_BYTES * left)
                found = found.unionByName(met)
                pieces = pieces.join(met.select("pid"), "pid", "left_anti")
                used = met.groupBy(F.col("sequence_id").alias("sequence")).agg(F.sum("size").alias("used"))
                gaps = gaps.join(used, "sequence", "left").select("sequence", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
            note(found.select("pid", "sequence_id", (F.lit(capacity) - F.col("before")).alias("offset")))
            left -= number
            shortest = min((r["least"] for r in rows if r["kind"] == 0), default=0)
            gaps = gaps.where(F.col("gap") >= shortest)  # no other ever holds a piece again
            n_gaps = sum(r["n"] for r in rows if r["kind"] == 1 and r["most"] >= shortest)
            if not number:
                break
        release(spark)
        counts = histogram(pieces) if left else {}
    return reduce(DataFrame.unionByName, placed) if placed else spark.createDataFrame([], "pid long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `capacity` tokens.

    A null or empty text is one piece of the separator alone; a null doc_id stays null; repeated rows are packed each by itself,
    ties in length by the order of the rows. An empty table gives no rows; other columns are ignored.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    pieces = docs.select("doc_id", "text").mapInArrow(lambda batches: pieces_of(batches, tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = cut(spark, pieces.withColumn("pid", F.monotonically_increasing_id()), source_bytes(docs))
    placed = place_all(spark, pieces.select("pid", "length"), capacity, sweep_rows)
    return pieces.join(placed, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
