"""Deduplication, decontamination and packing against brute force, with nulls, empty and long texts, ties and repeated rows."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.llm.common import text_chunks
from memlake.llm.decontaminate import BUDGET_PERCENT, Matcher, drop_leaks, find_leaks, masks, myers, normal
from memlake.llm.neardup import estimate, merge, near_duplicates, registers, remaining_pairs, shingle_sets
from memlake.llm.packing import brackets, fill, needed, pack, place_all
from memlake.llm.queries import tokenizer_path
from memlake.llm.suffixdedup import longest_previous, remove_repeats

DOCS = "doc_id bigint, text string, lang string, n_bytes int"  # n_bytes clashes with a column of a result


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        if i % 4 == 0:
            own[len(own) // 2 : len(own) // 2] = passage.split()[rng.randint(0, 20) : rng.randint(30, 60)]
        texts.append(" ".join(own))
    texts += [texts[0], texts[0] + " tail", None, "", "   ", "one", "x" * 400, "x" * 300, "ab" * 200, texts[3].upper(), " ".join(texts[:40])]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], (None, texts[1], "en", 1)]


def removed(texts: dict[int, bytes]) -> dict[int, tuple]:
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        b = texts[i]
        gone = np.zeros(len(b), bool)
        own = []
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if w in seen:
                gone[p : p + 50] = True
            own.append(w)
        seen.update(own)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("split", [2000, 3])
def test_suffix_dedup_is_exact(spark, monkeypatch, split):
    monkeypatch.setattr("memlake.llm.suffixdedup.SPLIT", split)
    monkeypatch.setattr("memlake.llm.suffixdedup.BUCKET_BYTES", 8000)
    rows = corpus()
    got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    want = removed({i: (t or "").encode() for i, t, *_ in rows if i is not None})
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
    assert any(r["n_removed"] for r in got) and got[0]["lang"] == "en"


def test_suffix_dedup_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


@given(st.lists(st.integers(0, 4), min_size=1, max_size=30), st.data())
@settings(max_examples=60, deadline=None)
def test_longest_previous(docs, data):
    common = data.draw(st.lists(st.integers(0, 60), min_size=len(docs), max_size=len(docs)))
    common[0] = 0
    want = []
    for i, d in enumerate(docs):
        best = 0
        for j, e in enumerate(docs):
            if e < d:
                a, b = min(i, j), max(i, j)
                best = max(best, min(common[a + 1 : b + 1]))
        want.append(best)
    assert longest_previous(np.array(docs), np.array(common)).tolist() == want


def test_equal_hashes_alone_remove_nothing():
    from memlake.llm import suffixdedup

    doc = np.array([1, 2])
    own = {"doc": doc, "tag": np.zeros(2, np.uint32), "start": np.zeros(2, np.uint32), "windows": np.full(2, 31, np.uint32)}
    _, claimed = suffixdedup.claims(own, suffixdedup.earliest(np.array([7, 7]), doc), 50)  # different texts, one hash
    assert claimed["doc"].tolist() == [2] and claimed["src"].tolist() == [1]
    bucket = pa.Table.from_batches([suffixdedup.as_batch(suffixdedup.dealt(suffixdedup.CLAIMED, np.zeros(1, np.int32), claimed))])
    merged = suffixdedup.merge_claims(bucket, 1)
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a" * 80, "b" * 80])], names=["doc_id", "text"])
    docs = pa.Table.from_batches(list(suffixdedup.pack(rows, 1, False)))
    found = suffixdedup.fetch_texts(docs, merged, 1, 50)
    out = suffixdedup.strip_docs(docs, pa.concat_tables([merged, found]), [])
    assert out["n_removed"].to_pylist() == [0, 0]


def word_sets(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near_corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(80)]
    rows = []
    for i in range(60):  # near copies of one text, some of which are linked with others only
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own), "en", 1))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(30)), "en", 1) for i in range(20)]
    rows += [(200, None, "en", 1), (201, "", "en", 1), (202, " \n", "en", 1), (203, "one two", "en", 1), (204, "One  two", "en", 1), (205, rows[0][1], "en", 1), (205, rows[0][1], "en", 1)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates_are_exact(spark):
    rows = near_corpus()
    sets = word_sets(rows)
    want = components(sets)
    got = near_duplicates(spark.createDataFrame([*rows, (None, rows[0][1], "en", 1)], DOCS)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert max(Counter(want.values()).values()) > 20


def test_remaining_pairs_miss_none(spark):
    rows = [r for r in near_corpus() if word_sets([r])[r[0]]]
    sets = word_sets(rows)
    hashed = {}
    for chunk in text_chunks(pa.array([r[1] for r in rows], pa.string())):
        for row, own in zip(chunk.rows.tolist(), shingle_sets(chunk), strict=True):
            hashed[rows[row][0]] = own.tobytes()
    left = spark.createDataFrame([(i, i, bytearray(e)) for i, e in hashed.items()], "id long, component long, elements binary")
    got = {tuple(r) for r in remaining_pairs(spark, left, 75).collect()}
    ids = sorted(hashed)
    linked = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked <= got and len(got) < len(ids) * (len(ids) - 1) / 2


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b, both = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 300, 900))
    x, y = np.concatenate([a, both]), np.concatenate([b, both])
    assert (merge(registers(x), registers(y)) == registers(np.union1d(x, y))).all()
    est = estimate(registers(x)[None], registers(y)[None], np.array([1200]), np.array([1200]))[0]
    assert abs(est - 0.6) < 0.15
    assert estimate(registers(x)[None], registers(x)[None], np.array([1200]), np.array([1200]))[0] > 0.95


@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
@settings(max_examples=100, deadline=None)
def test_myers(pattern, text):
    p, t = pattern.encode(), text.encode()
    row, best = list(range(len(p) + 1)), len(p)
    for c in t:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p[i - 1] != c)))
        row, best = new, min(best, new[-1])
    assert myers(masks(p), len(p), t)[0] == best


def test_leaks(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    item = " ".join(rng.choice(words) for _ in range(25))
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    edited = item[:40] + "zz" + item[45:90] + item[92:]
    docs = [(1, f"{noise(30)} {item} {noise(5)}", "en", 1), (2, f"{noise(9)}\n{item.upper().replace(' ', chr(10) + ' ')}", "en", 1), (3, f"x {edited} y", "en", 1), (4, noise(60), "en", 1), (5, None, "en", 1), (6, "", "en", 1), (7, item[:60] + " " + noise(20), "en", 1), (None, item, "en", 1), (1, f"{noise(30)} {item}", "en", 1)]
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame([(10, item), (10, item), (11, None), (12, "short"), (None, item)], "item_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["distance"] == 0) for r in find_leaks(df, bench).collect()))
    assert got == [(0, 10, True), (1, 10, True), (1, 10, True), (2, 10, True), (3, 10, False)]
    for r in find_leaks(df, bench).where("doc_id = 1").collect():
        assert r["end_byte"] - r["start_byte"] == len(item)
    assert sorted(r["doc_id"] for r in drop_leaks(df, bench).collect()) == [4, 5, 6, 7]
    assert find_leaks(df.limit(0), bench).count() == 0 and find_leaks(df, bench.limit(0)).count() == 0
    assert find_leaks(df, bench.unionByName(spark.createDataFrame([(13, noise(25))], bench.schema)), block_bytes=10).count() == len(got)


def part_distance(item: bytes, text: bytes) -> int:
    """The least edit distance of an item to a part of a text, by the table of all of them."""
    row, best = np.arange(len(item) + 1), len(item)
    own = np.frombuffer(item, np.uint8)
    for c in text:
        new = np.minimum(row[1:] + 1, row[:-1] + (own != c))
        row = np.concatenate([[0], new])
        np.minimum.accumulate(row - np.arange(len(row)), out=row)
        row += np.arange(len(row))
        best = min(best, int(row[-1]))
    return best


def test_leaks_against_all_distances(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(rng.randint(6, 25)) for _ in range(12)] + [say(10)[:40] + " " + say(8)]

    def edited(text, n):
        t = list(text)
        for _ in range(n):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["q"], [t[i], " z"], [t[i].upper()]])
        return "".join(t)

    docs = []
    for i in range(70):
        own = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            own += " " + edited(rng.choice(items), rng.randint(0, 9)) + rng.choice(["\n", "  ", "\t "]) + say(rng.randint(0, 6))
        docs.append((i, own, "en", 1))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    want = {}
    for i, text, *_ in docs:
        own = normal(np.frombuffer(text.encode(), np.uint8))[0] if text else b""
        for j, item in enumerate(items):
            pattern = normal(np.frombuffer(item.encode(), np.uint8))[0].strip()
            d = part_distance(pattern, own)
            if d <= len(pattern) * BUDGET_PERCENT // 100:
                want[i, j] = d
    assert got == want and len(set(want.values())) > 2


def test_short_items_match_between_words(spark):
    items = [(1, "Who is he?"), (2, "今天天气好"), (3, "кто это"), (4, "cat"), (5, "  "), (6, "exactly twenty bytes")]
    docs = [(1, "so. WHO  is he? they said"), (2, "我说今天天气好不好"), (3, "и кто это был"), (4, "concatenate catalog tomcat"), (5, "concat, a cat."), (6, "никто это"), (7, "exactly twenty bytez"), (8, "exactly twenty bytes")]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"], r["budget"], r["start_byte"], r["end_byte"]) for r in find_leaks(df, bench).collect())
    assert [g[:4] for g in got] == [(1, 1, 0, 0), (2, 2, 0, 0), (3, 3, 0, 0), (5, 4, 0, 0), (8, 6, 0, 0)]
    assert got[0][4:] == (4, 15) and got[3][4:] == (10, 13)
    assert sorted(r["doc_id"] for r in drop_leaks(df, bench).collect()) == [4, 6, 7]


def test_every_edit_within_the_budget_is_found():
    rng = random.Random(8)
    pattern = "".join(rng.choice("abcdefghijklmnop ") for _ in range(120)).replace("  ", "xy").strip()
    matcher = Matcher([(1, pattern)], 6)
    budget = matcher.items[0].budget
    for _ in range(60):
        t = list(pattern)
        for _ in range(budget):
            i = rng.randrange(len(t))
            kind = rng.randrange(3)
            t[i : i + 1] = [] if kind == 0 else ["q"] if kind == 1 else [t[i], "q"]
        chunk = next(text_chunks(pa.array([f"zz {''.join(t)} zz"])))
        found = matcher.matches(chunk)
        assert found and found[0][2] <= budget


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    gaps: list[int] = []  # in order
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def mixed_lengths(rng, kind):
    if kind == "one length":
        return [500] * 5
    if kind == "hot":  # a third of the pieces has one length, a third another, and some fill a sequence
        return [1] * 900 + [700] * 900 + [rng.randint(1, 2048) for _ in range(900)] + [2048] * 20
    if kind == "halves":
        return [1025] * 300 + [rng.randint(1, 1100) for _ in range(200)]
    if kind == "small":
        return [rng.randint(1, 40) for _ in range(3000)]
    return [min(2048, int(rng.expovariate(1 / 400)) + 1) for _ in range(2500)]


@pytest.mark.parametrize(("kind", "sweep_rows"), [("one length", 100), ("hot", 150), ("halves", 60), ("small", 400), ("mixed", 200), ("mixed", 100_000)])
def test_rounds_place_all_about_as_best_fit_does(spark, kind, sweep_rows):
    lengths = mixed_lengths(random.Random(7), kind)
    rows = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    got = place_all(spark, rows, 2048, sweep_rows).collect()
    assert sorted(r["pid"] for r in got) == list(range(len(lengths)))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], lengths[r["pid"]]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.01 * best_fit_decreasing(lengths, 2048) + 1
    if kind == "one length":
        assert sorted(len(spans) for spans in by.values()) == [1, 4]


@given(st.lists(st.integers(1, 30), max_size=20), st.lists(st.integers(1, 60), max_size=6))
@settings(max_examples=80, deadline=None)
def test_a_gap_takes_the_longest_that_fit(sizes, gaps):
    sizes.sort()
    below, left = list(range(len(sizes) + 1)), set(range(len(sizes)))
    for gap in gaps:
        want, room = [], gap
        while fits := [i for i in left if sizes[i] <= room]:
            i = max(fits)
            want.append(i)
            left.remove(i)
            room -= sizes[i]
        assert fill(gap, sizes, below) == want


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_runs_match_like_brackets(parts):
    runs = {}
    for p, (gaps, pieces) in enumerate(parts):
        if gaps:
            runs[p, 1] = (gaps, 10 * p + 1, 10 * p + 2)
        if pieces:
            runs[p, 0] = (pieces, 10 * p + 3, 10 * p + 4)
    used, held = Counter(), Counter()
    for part, first, number, gap_part, gap_first, each in brackets(runs):
        assert part < gap_part and 0 <= first and first + number <= runs[part, 0][0] and number > 0
        assert each * runs[part, 0][2] <= runs[gap_part, 1][1]
        for k in range(number):
            used[part, first + k] += 1
            held[gap_part, gap_first + k // each] += 1
    assert not used or max(used.values()) == 1
    assert all(g < runs[p, 1][0] for p, g in held)


def test_needed():
    assert needed({500: 5}, 2048) == 2 and needed({1025: 7}, 2048) == 7 and needed({1: 5000}, 2048) == 3 and needed({700: 5, 10: 1}, 2048) == 3


def test_many_seeds_are_drawn_by_hash(spark, monkeypatch):
    monkeypatch.setattr("memlake.llm.packing.EXACT_SEEDS", 10)
    got = place_all(spark, spark.range(400).select(F.col("id").alias("pid"), F.lit(900).cast("long").alias("length")), 2048, 100)
    assert got.count() == 400 and got.select("sequence_id").distinct().count() <= 215


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = corpus(9, 25)
    rows += [(900, "It's <|endoftext|> here", "en", 1), (901, "中文　x \n\n y  z", "en", 1), (902, "word " * 5000, "en", 1)]
    got = pack(spark.createDataFrame(rows, DOCS), tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for n, a in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[a : first if n == 0 else a + 2048]
            want[i, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= sum(r["length"] for r in got) / 2048 * 1.25 + 2
    assert pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0
