"""Exact substring deduplication by longest-previous-factor arrays.

Every byte of a document is removed that a string of `length` bytes covers which also starts in a document with a smaller id.

1. Each window of `length` bytes has an anchor, the least hash of its shorter strings; a run of windows with one anchor is a
   segment. Equal windows have equal anchors wherever they stand, so only segments with one anchor can share a window.
   Tasks combine segments of equal hashes before the shuffle: only those of the smallest id go on, the others claim to repeat it.
2. Segments meet by anchor. Those with the hash of one of a smaller id claim to repeat that one. Where an anchor has different
   segments left, of several documents, their texts are asked for; all other segments are done.
3. A document's claims become runs against one place each, and a run's place is asked for a digest of its bytes: a claim counts
   where it equals the digest of the run's own bytes. A hash alone removes nothing.
4. The texts come from the documents, dealt by id. Anchors with very many segments are split: each window then goes by its own
   hash, combined before the shuffle by comparing bytes.
5. Texts meet by anchor. Their windows are put in suffix order; the previous and the next window of a smaller document in that
   order give each its longest previous factor, and windows where it reaches `length` are covered.
6. Covered intervals meet their documents, which lose those bytes.

What is shuffled is packed by bucket into compressed blobs; buckets grow in number with the bytes of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import U64, Chunk, bound_batches, cut, lean, mix, powers, release, shuffle_partitions, text_chunks

LENGTH = 50
#: Bytes of the strings whose least hash is a window's anchor.
GRAM = 24
#: Bytes of text for which there is a bucket.
BUCKET_BYTES = 4 << 20
#: Bytes of text that a task packs at once.
PACK_BYTES = 2 << 20
#: Segments that a task holds before it sends them on.
HELD = 250_000
#: Segments of one anchor beyond which its windows are dealt by their own hashes.
SPLIT = 2_000

ROW = "bucket int, kind int, blob binary"
_KINDS = ANCHORS, COVERED, ASKED, TEXTS, DOCS, CLAIMED, CHECK, ANSWER = range(8)
_PLACE = [("src", "<i8"), ("src_tag", "<u4"), ("src_start", "<u4")]
_FORM = {
    ANCHORS: [("low", "<u4"), ("seg", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("windows", "<u4")],
    COVERED: [("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4")],
    ASKED: [("home", "<u4"), ("low", "<u4"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("windows", "<u4"), ("split", "u1")],
    TEXTS: [("low", "<u4"), ("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("windows", "<u4")],
    DOCS: [("doc", "<i8"), ("null", "u1"), ("tag", "<u4"), ("size", "<u4")],
    CLAIMED: [("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4"), *_PLACE],
    CHECK: [*_PLACE, ("size", "<u4"), ("home", "<u4")],
    ANSWER: [*_PLACE, ("size", "<u4"), ("first", "<u8"), ("second", "<u8")],
}
Columns = dict[str, np.ndarray]


def to_blob(kind: int, columns: Columns, tail: bytes = b"") -> bytes:
    """Columns by bytes of like significance, which compress well, and some bytes after them."""
    n = len(columns[_FORM[kind][0][0]])
    planes = [np.ascontiguousarray(np.ascontiguousarray(columns[name], dtype=form).view(np.uint8).reshape(n, -1).T).tobytes() for name, form in _FORM[kind]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([n.to_bytes(8, "little"), *planes, tail]))


def from_blob(kind: int, blob: bytes) -> tuple[Columns, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, {}
    for name, form in _FORM[kind]:
        size = np.dtype(form).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(form)
        at += n * size
    return out, raw[at:]


def joined(kind: int, blobs: list[bytes]) -> tuple[Columns, bytes]:
    parts = [from_blob(kind, b) for b in blobs]
    return {name: np.concatenate([p[0][name] for p in parts]) if parts else np.empty(0, form) for name, form in _FORM[kind]}, b"".join(p[1] for p in parts)


def dealt(kind: int, bucket: np.ndarray, columns: Columns) -> list[tuple[int, int, bytes]]:
    """A blob for each bucket."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    cuts = [0, *edge.tolist(), len(order)]
    sorted_ = {k: v[order] for k, v in columns.items()}
    return [(int(bucket[order[a]]), kind, to_blob(kind, {k: v[a:b] for k, v in sorted_.items()})) for a, b in zip(cuts, cuts[1:], strict=False)]


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, kinds, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def of_doc(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U64)) % U64(buckets)).astype(np.int32)


def of_hash(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int32)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position."""
    word = np.ndarray((len(data) - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    h = word[: len(data) - 23] * U64(0x9E3779B97F4A7C15)
    h += word[8 : len(data) - 15] * U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(31)
    h += word[16:] * U64(0x165667B19E3779F9)
    return mix(h)


def segments(chunk: Chunk, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, hash, document (in the chunk), start and number of windows of every segment."""
    data = chunk.data
    long_enough = chunk.end - chunk.start >= length
    if not long_enough.any():
        return (np.empty(0, U64), np.empty(0, U64), *(np.empty(0, np.int64),) * 3)
    h = grams(data)
    least, have, want = h, 1, length - GRAM + 1
    while have * 2 <= want:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < want:
        least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
    change = np.zeros(len(least) + 1, dtype=np.int8)
    change[chunk.start[long_enough]] = 1
    change[chunk.end[long_enough] - length + 1] = -1
    valid = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    differs = np.empty(len(least) + 1, dtype=bool)
    differs[0] = differs[-1] = True
    np.not_equal(least[1:], least[:-1], out=differs[1:-1])
    differs[:-1] |= change[:-1] != 0
    begin = np.flatnonzero(differs[:-1] & valid)
    stop = np.flatnonzero((differs[1:] | (change[1:] != 0)) & valid) + 1
    p, q = powers(len(h))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(h * p)])
    seg = mix((total[stop + length - GRAM] - total[begin]) * q[begin]) & U64((1 << 48) - 1)
    doc = np.searchsorted(chunk.start, begin, side="right") - 1
    return mix(least[begin]), seg, doc, begin - chunk.start[doc], stop - begin


def tags(chunk: Chunk, tagged: bool) -> np.ndarray:
    """What tells texts of one id apart, in a table where ids repeat; else zero."""
    if not tagged:
        return np.zeros(len(chunk.rows), np.uint32)
    return np.array([int.from_bytes(hashlib.blake2b(chunk.data[a:b].tobytes(), digest_size=4).digest(), "little") for a, b in zip(chunk.start, chunk.end, strict=True)], dtype=np.uint32)


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, where each group begins in it, and the group of each in that order."""
    order = np.argsort(key)
    fresh = np.ones(len(order), dtype=bool)
    np.not_equal(key[order][1:], key[order][:-1], out=fresh[1:])
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def earliest(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each: where one of the smallest document with the same key is."""
    if not len(key):
        return np.empty(0, np.int64)
    order = np.lexsort((doc, key))
    fresh = np.ones(len(order), dtype=bool)
    np.not_equal(key[order][1:], key[order][:-1], out=fresh[1:])
    out = np.empty(len(key), dtype=np.int64)
    out[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return out


def claims(columns: Columns, source: np.ndarray, length: int) -> tuple[np.ndarray, Columns]:
    """Which segments claim to repeat one of a smaller document, and their claims."""
    who = columns["doc"] > columns["doc"][source]
    src = source[who]
    start, windows = columns["start"][who], columns["windows"][who]
    return who, {"doc": columns["doc"][who], "tag": columns["tag"][who], "start": start, "end": start + windows + (length - 1), "src": columns["doc"][src], "src_tag": columns["tag"][src], "src_start": columns["start"][src]}


@lean
def map_segments(batches: Iterator[pa.RecordBatch], buckets: int, length: int, tagged: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        anchor, seg, doc, tag, start, windows = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        claimed, own = claims({"doc": doc, "tag": tag, "start": start, "windows": windows}, earliest(mix(anchor + seg * U64(0x9E3779B97F4A7C15)), doc), length)
        rows = dealt(CLAIMED, of_doc(own["doc"], buckets), own)
        keep = ~claimed
        low = (anchor & U64(0xFFFFFFFF)).astype(np.uint32)
        return as_batch(rows + dealt(ANCHORS, of_hash(anchor[keep], buckets), {"low": low[keep], "seg": seg[keep], "doc": doc[keep], "tag": tag[keep], "start": start[keep], "windows": windows[keep]}))

    for batch in batches:
        ids = batch.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for chunk in text_chunks(batch.column("text")):
            anchor, seg, doc, start, windows = segments(chunk, length)
            ok = known[chunk.rows[doc]]
            held.append((anchor[ok], seg[ok], value[chunk.rows[doc]][ok], tags(chunk, tagged)[doc][ok], start[ok], windows[ok]))
            if sum(len(x[0]) for x in held) >= HELD:
                yield flush()
    if held:
        yield flush()


def blobs_of(table: pa.Table, kind: int) -> list[bytes]:
    return [b for k, b in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == kind]


@lean
def meet_anchors(table: pa.Table, buckets: int, length: int) -> pa.Table:
    """Step 2: claims, and questions for the texts of segments that may share windows."""
    rows = [(b, k, x) for b, k, x in zip(*(table[c].to_pylist() for c in ("bucket", "kind", "blob")), strict=True) if k == CLAIMED]
    at = table["bucket"][0].as_py()
    a, _ = joined(ANCHORS, blobs_of(table, ANCHORS))
    if len(a["low"]):
        claimed, own = claims(a, earliest(mix(a["low"].astype(U64) + a["seg"] * U64(0x9E3779B97F4A7C15)), a["doc"]), length)
        rows += dealt(CLAIMED, of_doc(own["doc"], buckets), own)
        a = {k: v[~claimed] for k, v in a.items()}
        order, first, group = groups(a["low"])
        doc = a["doc"][order]
        several = (np.maximum.reduceat(doc, first) > np.minimum.reduceat(doc, first))[group]
        split = (np.diff(np.append(first, len(order))) > SPLIT)[group]
        a = {k: v[order][several] for k, v in a.items()}
        rows += dealt(ASKED, of_doc(a["doc"], buckets), a | {"home": np.full(len(a["low"]), at, np.uint32), "split": split[several].astype(np.uint8)})
    return pa.Table.from_batches([as_batch(rows)])


@lean
def merge_claims(table: pa.Table, buckets: int) -> pa.Table:
    """Step 3: a bucket's claims as runs against one place each, and a question for each different place."""
    at = table["bucket"][0].as_py()
    c, _ = joined(CLAIMED, blobs_of(table, CLAIMED))
    if not len(c["doc"]):
        return pa.Table.from_batches([as_batch([])])
    order = np.lexsort((c["start"], c["tag"], c["doc"]))
    c = {k: v[order] for k, v in c.items()}
    shift = c["src_start"].astype(np.int64) - c["start"]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (np.diff(shift) != 0) | (c["start"][1:] > c["end"][:-1])
    for name in ("doc", "tag", "src", "src_tag"):
        fresh[1:] |= c[name][1:] != c[name][:-1]
    first = np.flatnonzero(fresh)
    runs = {k: v[first] for k, v in c.items()} | {"end": np.maximum.reduceat(c["end"], first)}
    place = np.stack([runs["src"], *(runs[n].astype(np.int64) for n in ("src_tag", "src_start")), (runs["end"] - runs["start"]).astype(np.int64)])
    place = np.unique(place, axis=1)
    asked = {"src": place[0], "src_tag": place[1], "src_start": place[2], "size": place[3], "home": np.full(place.shape[1], at)}
    return pa.Table.from_batches([as_batch(dealt(CLAIMED, np.full(len(first), at), runs) + dealt(CHECK, of_doc(place[0], buckets), asked))])


def digest(raw: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def joined_docs(blobs: list[bytes]) -> tuple[Columns, bytes, pa.Table | None]:
    """Documents of some blobs: their columns, their texts in a row, and the other columns of their rows."""
    columns, texts, others = [], [], []
    for blob in blobs:
        own, tail = from_blob(DOCS, blob)
        size = int(own["size"].sum(dtype=np.int64))
        columns.append(own)
        texts.append(tail[:size])
        others.append(pa.ipc.open_stream(tail[size:]).read_all())
    return {name: np.concatenate([c[name] for c in columns]) if columns else np.empty(0, form) for name, form in _FORM[DOCS]}, b"".join(texts), pa.concat_tables(others) if others else None


@lean
def pack_docs(batches: Iterator[pa.RecordBatch], buckets: int, tagged: bool) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield from pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0], buckets, tagged)
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield from pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0], buckets, tagged)


def pack(batch: pa.RecordBatch, buckets: int, tagged: bool) -> Iterator[pa.RecordBatch]:
    ids = batch.column("doc_id")
    null = ids.is_null().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy(zero_copy_only=False)
    other = batch.select([n for n in batch.schema.names if n not in ("doc_id", "text")])
    if not other.num_columns:
        other = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows)], names=["none"])
    for chunk in text_chunks(batch.column("text"), PACK_BYTES):
        doc, tag, size = value[chunk.rows], tags(chunk, tagged), chunk.end - chunk.start
        bucket = np.where(null[chunk.rows], (chunk.rows + chunk.data.size) % buckets, of_doc(doc, buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        raw, rows = chunk.data.tobytes(), []
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            text = b"".join([raw[a:b] for a, b in zip(chunk.start[part].tolist(), chunk.end[part].tolist(), strict=True)])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, other.schema) as writer:
                writer.write_batch(other.take(pa.array(chunk.rows[part])))
            rows.append((int(bucket[part[0]]), DOCS, to_blob(DOCS, {"doc": doc[part], "null": null[chunk.rows[part]].astype(np.uint8), "tag": tag[part], "size": size[part]}, text + sink.getvalue().to_pybytes())))
        yield as_batch(rows)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether `length` bytes (8 at least) are the same at some places."""
    word = np.ndarray((len(data) - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    same = np.ones(len(a), dtype=bool)
    for s in (*range(0, length - 7, 8), length - 8):
        same &= word[a + s] == word[b + s]
    return same


@lean
def fetch_texts(docs: pa.Table, asked: pa.Table, buckets: int, length: int) -> pa.Table:
    """Steps 3 and 4: digests of places, to the buckets that asked, and the texts of segments, to those of their anchors."""
    a, _ = joined(ASKED, blobs_of(asked, ASKED))
    q, _ = joined(CHECK, blobs_of(asked, CHECK))
    rows: list[tuple[int, int, bytes]] = []
    if len(a["doc"]) or len(q["src"]):
        d, text, _ = joined_docs(blobs_of(docs, DOCS))
        known = np.flatnonzero(d["null"] == 0)
        begin = np.cumsum(d["size"], dtype=np.int64) - d["size"]
    if len(q["src"]):
        at = begin[known][_find(d["doc"][known], d["tag"][known], q["src"], q["src_tag"])] + q["src_start"]
        found = np.array([digest(text[i:j]) for i, j in zip(at.tolist(), (at + q["size"]).tolist(), strict=True)], dtype=U64)
        rows += dealt(ANSWER, q["home"].astype(np.int32), {n: q[n] for n in ("src", "src_tag", "src_start", "size")} | {"first": found[:, 0], "second": found[:, 1]})
    if len(a["doc"]):
        place = _find(d["doc"][known], d["tag"][known], a["doc"], a["tag"])
        at = begin[known][place] + a["start"]
        data = np.frombuffer(text, np.uint8)
        whole = a["split"] == 0
        for home in np.unique(a["home"][whole]).tolist():
            mine = np.flatnonzero(whole & (a["home"] == home))
            cut_ = b"".join([text[i:j] for i, j in zip(at[mine].tolist(), (at[mine] + a["windows"][mine] + length - 1).tolist(), strict=True)])
            rows.append((home, TEXTS, to_blob(TEXTS, {k: a[k][mine] for k in ("low", "doc", "tag", "start", "windows")}, cut_)))
        s = {k: v[~whole] for k, v in a.items()}
        if len(s["doc"]):  # each window by itself
            n = s["windows"].astype(np.int64)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos, doc, tag, start = np.repeat(at[~whole], n) + within, np.repeat(s["doc"], n), np.repeat(s["tag"], n), np.repeat(s["start"], n) + within
            h = np.zeros(len(pos), U64)
            for j in range(0, length):
                h = h * U64(0x9E3779B97F4A7C15) + data[pos + j].astype(U64) + U64(1)
            h = mix(h)
            source = earliest(h, doc)
            covered = doc > doc[source]
            covered[covered] = same_bytes(data, pos[covered], pos[source[covered]], length)
            rows += dealt(COVERED, of_doc(doc[covered], buckets), {"doc": doc[covered], "tag": tag[covered], "start": start[covered], "end": start[covered] + length})
            order = np.argsort(of_hash(h, buckets), kind="stable")
            order = order[~covered[order]]
            home = of_hash(h[order], buckets)
            for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(home)) + 1) if len(order) else ():
                mine = order[part]
                cut_ = data[pos[mine][:, None] + np.arange(length)].tobytes()
                low = (h[mine] & U64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((int(home[part[0]]), TEXTS, to_blob(TEXTS, {"low": low, "doc": doc[mine], "tag": tag[mine], "start": start[mine], "windows": np.ones(len(mine))}, cut_)))
    return pa.Table.from_batches([as_batch(rows)])


def _find(doc: np.ndarray, tag: np.ndarray, want_doc: np.ndarray, want_tag: np.ndarray) -> np.ndarray:
    """Where each wanted document stands; all are there."""
    order = np.lexsort((tag, doc))
    doc, tag = doc[order], tag[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    order, doc, tag = order[fresh], doc[fresh], tag[fresh]
    at = np.searchsorted(doc, want_doc)
    last = np.searchsorted(doc, want_doc, side="right")
    while (wrong := np.flatnonzero((tag[at] != want_tag) & (at + 1 < last))).size:
        at[wrong] += 1
    return order[at]


def longest_previous(doc: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in order: the most bytes that each shares with one of a smaller document.

    common: bytes that a suffix shares with the one before it. The previous and the next smaller document in suffix order give
    the longest earlier match. Pointers to them are found by jumping, each with the least of what is shared on its way.
    """
    n = len(doc)
    out = np.zeros(n, dtype=np.int64)
    index = np.arange(n)
    after = np.append(common[1:], 0)
    for link, shared in ((np.where(common > 0, index - 1, -1), common.copy()), (np.where(after > 0, index + 1, -1), after)):
        active = np.flatnonzero(link >= 0)
        while len(active := active[link[active] >= 0]):
            active = active[doc[link[active]] >= doc[active]]
            if not len(active):
                break
            over = link[active]
            shared[active] = np.minimum(shared[active], shared[over])
            link[active] = link[over]
        out = np.maximum(out, np.where(link >= 0, shared, 0))
    return out


def suffix_order(data: np.ndarray, pos: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of windows by their bytes within each anchor, and the bytes each shares with the one before it (up to length)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", buffer=padded, strides=(1,))
    steps = [*range(0, length - 7, 8)]
    if steps[-1] + 8 < length:
        steps.append(length - 8)
    order = np.lexsort(tuple(words[pos + s].astype(U64) for s in reversed(steps)) + (low,))
    at = pos[order]
    common = np.zeros(len(order), np.int64)
    alike = np.zeros(len(order), bool)
    alike[1:] = low[order][1:] == low[order][:-1]
    for s in steps:
        w = words[at + s].astype(U64)
        x = np.zeros(len(w), U64)
        x[1:] = w[1:] ^ w[:-1]
        same = np.where(x == 0, 8, 7 - (np.floor(np.log2(np.maximum(x, U64(1)).astype(np.float64))).astype(np.int64) >> 3))
        common = np.where(alike, np.maximum(common, s + np.minimum(same, 8)), common)
        alike &= x == 0
    return order, np.minimum(common, length)


@lean
def meet_texts(table: pa.Table, buckets: int, length: int) -> pa.Table:
    """Step 5: suffix order and longest previous factors of a bucket's texts; what is for documents goes through."""
    rows = [(b, k, x) for b, k, x in zip(*(table[c].to_pylist() for c in ("bucket", "kind", "blob")), strict=True) if k in (COVERED, ANSWER)]
    t, text = joined(TEXTS, blobs_of(table, TEXTS))
    if len(t["low"]):
        data = np.frombuffer(text, np.uint8)
        n = t["windows"].astype(np.int64)
        size = n + length - 1
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        order, common = suffix_order(data, begin[owner] + within, t["low"][owner], length)
        hit = order[longest_previous(t["doc"][owner[order]], common) >= length]
        hit.sort()
        # runs of windows of one segment as one interval
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)
        first = hit[fresh]
        last = hit[np.append(fresh[1:], True)] if len(hit) else hit
        o = owner[first]
        rows += dealt(COVERED, of_doc(t["doc"][o], buckets), {"doc": t["doc"][o], "tag": t["tag"][o], "start": t["start"][o] + within[first], "end": t["start"][o] + within[last] + length})
    return pa.Table.from_batches([as_batch(rows)])


@lean
def strip_docs(docs: pa.Table, covered: pa.Table, carried: list[str]) -> pa.Table:
    """Step 6: doc_id, n_bytes, n_removed, n_spans, kept_sha256, what is left of the text, and carried columns."""
    d, text, other = joined_docs(blobs_of(docs, DOCS))
    c, _ = joined(COVERED, blobs_of(covered, COVERED))
    begin = np.cumsum(d["size"], dtype=np.int64) - d["size"]
    known = np.flatnonzero(d["null"] == 0)
    gone = np.zeros(len(text) + 1, dtype=np.int32)
    if len(c["doc"]):
        at = begin[known][_find(d["doc"][known], d["tag"][known], c["doc"], c["tag"])]
        np.add.at(gone, at + c["start"], 1)
        np.add.at(gone, at + c["end"], -1)
    c, _ = joined(CLAIMED, blobs_of(covered, CLAIMED))
    if len(c["doc"]):
        a, _ = joined(ANSWER, blobs_of(covered, ANSWER))
        answers = dict(zip(zip(*(a[n].tolist() for n in ("src", "src_tag", "src_start", "size")), strict=True), zip(a["first"].tolist(), a["second"].tolist(), strict=True), strict=True))
        at = begin[known][_find(d["doc"][known], d["tag"][known], c["doc"], c["tag"])]
        start, stop = (at + c["start"]).tolist(), (at + c["end"]).tolist()
        places = zip(*(x.tolist() for x in (c["src"], c["src_tag"], c["src_start"], c["end"] - c["start"])), strict=True)
        for i, j, place in zip(start, stop, places, strict=True):
            if answers[place] == digest(text[i:j]):  # else two hashes were equal by chance, and nothing goes
                gone[i] += 1
                gone[j] -= 1
    # an interval ends within its document's bytes or at their end, where the next one's may begin
    flag = np.cumsum(gone)[:-1] > 0
    # rows that repeat id and text share their intervals
    order = known[np.lexsort((d["tag"][known], d["doc"][known]))]
    same = np.flatnonzero((d["doc"][order][1:] == d["doc"][order][:-1]) & (d["tag"][order][1:] == d["tag"][order][:-1])) + 1
    for i in same.tolist():
        a, b, size = begin[order[i - 1]], begin[order[i]], int(d["size"][order[i]])
        flag[b : b + size] = flag[a : a + size]
    data = np.frombuffer(text, np.uint8)
    out: tuple[list, ...] = ([], [], [], [], [], [])
    for i, (a, size) in enumerate(zip(begin.tolist(), d["size"].tolist(), strict=True)):
        off = flag[a : a + size]
        removed = int(np.count_nonzero(off))
        spans = int(np.count_nonzero(off[1:] & ~off[:-1])) + int(size > 0 and off[0]) if removed else 0
        kept = text[a : a + size] if not removed else data[a : a + size][~off].tobytes()
        for column, value in zip(out, (None if d["null"][i] else int(d["doc"][i]), size, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), strict=True):
            column.append(value)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    more = [other.column(c).combine_chunks() if other is not None else pa.nulls(0) for c in carried]
    return pa.Table.from_arrays([*(pa.array(x, t) for x, t in zip(out, types, strict=True)), *more], names=[*names, *carried])


MADE = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def _strip(docs: DataFrame, length: int) -> tuple[DataFrame, list[str]]:
    """The columns MADE of each row and docs' other columns as carried_0, carried_1, ...; and the names of those."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = docs.sparkSession
    bound_batches(spark)
    fields = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    carried = [f"carried_{i}" for i in range(len(fields))]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col("`" + f.name.replace("`", "``") + "`").alias(c) for f, c in zip(fields, carried, strict=True)))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-n_bytes // BUCKET_BYTES))
    tagged = bool(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").take(1))

    first = docs.select("doc_id", "text").mapInArrow(lambda b: map_segments(b, buckets, length, tagged), ROW).groupBy("bucket").applyInArrow(lambda t: meet_anchors(t, buckets, length), ROW)
    first = cut(spark, first, n_bytes)
    release(spark)
    packed = docs.mapInArrow(lambda b: pack_docs(b, buckets, tagged), ROW)
    claimed = cut(spark, first.where(F.col("kind") == CLAIMED).groupBy("bucket").applyInArrow(lambda t: merge_claims(t, buckets), ROW), n_bytes)
    asked = first.where(F.col("kind") == ASKED).unionByName(claimed.where(F.col("kind") == CHECK))
    texts = packed.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(lambda a, b: fetch_texts(a, b, buckets, length), ROW)
    second = texts.groupBy("bucket").applyInArrow(lambda t: meet_texts(t, buckets, length), ROW)
    covered = claimed.where(F.col("kind") == CLAIMED).unionByName(second)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string" + "".join(f", {c} {f.dataType.simpleString()}" for c, f in zip(carried, fields, strict=True))
    return packed.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(lambda a, b: strip_docs(a, b, carried), schema), [f.name for f in fields]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, and docs' columns besides.

    Bytes that removal leaves of a cut character are left out of kept_text (not of the hash). A null or empty text has no
    bytes. A row with a null doc_id is returned as it is and never makes another lose bytes. Rows that repeat a doc_id are
    judged each by itself, against smaller ids only. An empty table gives no rows. A column of docs that is named like one of
    the result's is left out (without_repeats() keeps all).
    """
    out, names = _strip(docs, length)
    return out.select(*MADE, *(F.col(f"carried_{i}").alias(n) for i, n in enumerate(names) if n not in MADE))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs, with all their columns whatever they are called, and what remove_repeats() leaves of their texts.

    A null text comes back empty; for other odd rows see there.
    """
    out, names = _strip(docs, length)
    at = {n: f"carried_{i}" for i, n in enumerate(names)} | {"doc_id": "doc_id", "text": "kept_text"}
    return out.select(*(F.col(at[n]).alias(n) for n in docs.columns))
