"""Benchmark decontamination by pigeonhole edit matching.

Test items and texts are lower-cased (A-Z, À-Þ) with white space made single spaces. A test item that a text holds with at most e
edits, cut into e + 1 pieces, has a piece in it unchanged. One Aho-Corasick pass finds all pieces of all items; around each
hit Myers' bit-parallel algorithm gives the least edit distance of the whole item, and those within its budget are matches.
Short items match exactly, where no word goes on beyond their ends.

Items travel to the tasks in blocks of bounded size, a pass for each block.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import Chunk, bound_batches, lean, rows_where, text_chunks

#: Edits allowed, in hundredths of an item's length.
BUDGET_PERCENT = 6
#: Bytes of items in a block, and bytes below which an item (normalised) has no edits and begins and ends with words.
BLOCK_BYTES, SHORTEST = 8 << 20, 24

#: Scripts that put no spaces between words, so that a word can begin and end anywhere.
UNSPACED = re.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[32, *range(9, 14)]] = 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes, white space as spaces."""
    out = _FOLD[data]
    second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[second] += 32
    return out


def normal(data: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Normalised bytes, and where each came from."""
    folded = fold(data)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    at = np.flatnonzero(keep)
    return folded[at].tobytes(), at


def edge(text: bytes, at: int) -> bool:
    """Whether no word goes on from before `at` to after it."""
    before, after = text[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:], text[at : at + 4].decode("utf-8", "ignore")[:1]
    return not all(c and (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") and not UNSPACED.match(c) for c in (before, after))


class Item:
    __slots__ = ("budget", "item_id", "masks", "pattern", "reverse")

    def __init__(self, item_id: int, pattern: bytes, budget: int):
        self.item_id, self.pattern, self.budget = item_id, pattern, budget
        self.masks, self.reverse = masks(pattern), None


def masks(pattern: bytes) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def myers(peq: dict[int, int], m: int, text: bytes, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern of m bytes to a part of text, and that part's (first) end.

    anchored: parts that begin where the text does.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1 | anchored) & full
        down = (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], budget_percent: int):
        import ahocorasick

        self.items: list[Item] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            pattern = normal(np.frombuffer((text or "").encode(), np.uint8))[0].strip()
            if not pattern:
                continue
            budget = len(pattern) * budget_percent // 100 if len(pattern) >= SHORTEST else 0
            edges = [len(pattern) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                pieces[pattern[a:b].decode("latin-1")].append((len(self.items), a))
            self.items.append(Item(item_id, pattern, budget))
        self.found = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.found.add_word(piece, (len(piece), uses))
        if pieces:
            self.found.make_automaton()

    def matches(self, chunk: Chunk) -> list[tuple[int, int, int, int, int]]:
        """(row in the chunk, item, distance, start, end) of the best match of each item in each text, in bytes of the text."""
        if not len(self.found):
            return []
        data = chunk.data
        folded = fold(data)
        folded[chunk.end] = 10  # documents stay apart
        keep = np.ones(len(data), dtype=bool)
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        at = np.flatnonzero(keep)
        text = folded[at].tobytes()
        begin, stop = np.searchsorted(at, chunk.start), np.searchsorted(at, chunk.end)
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        ends, uses = [], []
        for end, value in self.found.iter(text.decode("latin-1")):
            ends.append(end)
            uses.append(value)
        rows = np.searchsorted(begin, ends, side="right") - 1 if ends else []
        for end, (size, where), row in zip(ends, uses, rows, strict=True):
            for item, offset in where:
                hits[int(row), item].append(end + 1 - size - offset)
        out = []
        for (row, i), starts in hits.items():
            item = self.items[i]
            m, e, a, b = len(item.pattern), item.budget, int(begin[row]), int(stop[row])
            if m < SHORTEST:  # its only piece is the whole item
                exact = next((s for s in sorted(starts) if edge(text, s) and edge(text, s + m)), -1)
                if exact < 0:
                    continue
            else:
                exact = text.find(item.pattern, a, b)
            if exact >= 0:
                best = (0, exact, exact + m)
            else:
                best, starts = None, sorted(set(starts))
                windows: list[list[int]] = []
                for s in starts:
                    if windows and s - e <= windows[-1][1]:
                        windows[-1][1] = s + m + e
                    else:
                        windows.append([s - e, s + m + e])
                for lo, hi in windows:
                    lo, hi = max(lo, a), min(hi, b)
                    if hi - lo < m - e:
                        continue
                    distance, end = myers(item.masks, m, text[lo:hi])
                    if distance <= e and (best is None or distance < best[0]):
                        item.reverse = item.reverse or masks(item.pattern[::-1])
                        _, size = myers(item.reverse, m, text[lo : lo + end][::-1], True)
                        best = (distance, lo + end - size, lo + end)
            if best:
                first = int(at[best[1]] - chunk.start[row])
                last = int(at[best[2] - 1] + 1 - chunk.start[row]) if best[2] > best[1] else first
                out.append((row, i, best[0], first, last))
        return sorted(out)


@lean
def match_batches(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], percent: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(items, percent)
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            found = matcher.matches(chunk)
            rows = pa.array([int(chunk.rows[r]) for r, *_ in found], pa.int64())
            own = [matcher.items[i] for _, i, *_ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array([x.item_id for x in own], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([x.budget for x in own], pa.int32()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                names=["doc_id", "item_id", "distance", "budget", "start_byte", "end_byte"],
            )


def clean(items: list[tuple[int, str]], percent: int) -> Callable[[], Callable[[pa.Array], np.ndarray]]:
    """For rows_where(): whether texts hold none of some items."""

    def make() -> Callable[[pa.Array], np.ndarray]:
        matcher = Matcher(items, percent)

        def good(text: pa.Array) -> np.ndarray:
            keep = np.ones(len(text), dtype=bool)
            for chunk in text_chunks(text):
                for row, *_ in matcher.matches(chunk):
                    keep[chunk.rows[row]] = False
            return keep

        return good

    return make


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items with an id and a text, in blocks of at most `block_bytes` bytes (or one longer item)."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    held, size = [], 0
    for row in rows.toLocalIterator():
        n = len(row["text"].encode())
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = BUDGET_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and test item that it holds within the budget: doc_id, item_id, distance, budget, start_byte, end_byte.

    Null and empty texts hold nothing; items that are null or empty when normalised match nothing, and those shorter than
    SHORTEST bytes match exactly, between words. A
    null doc_id stays null; repeated rows are matched each by itself, repeated items once; of equally near places the first
    counts. Empty tables give no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, distance int, budget int, start_byte long, end_byte long"
    out = None
    for items in blocks(benchmark, block_bytes):
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b, items=items: match_batches(b, items, percent), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = BUDGET_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item.

    Rows with a null or empty text stay, as do all where the benchmark is empty; a null doc_id makes no difference, and repeated
    rows stay or go together. An empty table gives no rows. Columns may have any names.
    """
    bound_batches(docs.sparkSession)
    for items in blocks(benchmark, block_bytes):
        docs = rows_where(docs, clean(items, percent))
    return docs
