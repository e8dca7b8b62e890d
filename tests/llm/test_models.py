"""Classifiers by held-out accuracy; search, URL rules and license scans by brute force; odd rows everywhere."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from memlake.llm import ann, langid, licenses, quality, toxicity, urlfilter
from memlake.llm.queries import queries

SF = "/root/testdata/sf0.01"
ODD = [(None, "some text here", "en", 9), (7, None, None, 9), (8, "", "en", 9), (8, "", "en", 9), (9, "12 34 !!", "en", 9), (10, "a" * 300_000, "en", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, score int")


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, size=(900, 1))
    x[40:60] = x[40]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] + [1.0] * 11), (1060, [None] + [1.0] * 11), (None, [1.0] * 12), (1080, [float("inf")] * 12)]
    df = spark.createDataFrame([*rows, *bad], "vec_id bigint, vector array<double>")
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in ann.nearest(asked.unionByName(asked), df.unionByName(df.where('vec_id < 5')), k=10, shard_rows=300).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for i in range(0, 900, 20):
        product = x @ x[i]
        product[i] = -np.inf
        want = np.lexsort((np.arange(900), -np.round(product, 12)))[:10].tolist()
        assert [got[i][k] for k in range(1, 11)] == want
    assert set(got) == set(range(0, 900, 20))
    assert ann.nearest(asked.limit(0), df).count() == 0 and ann.nearest(asked, df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert ann.nearest(few.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), few).count() == 2


@pytest.mark.parametrize("values", [(-1, 0, 1), (0, 1)])
def test_ties_of_different_vectors_go_to_the_smaller_id(values):
    rng = np.random.default_rng(5)
    x = np.unique(rng.choice(values, size=(700, 6)).astype(float), axis=0)
    x = x[(x != 0).any(axis=1)]
    x = x[rng.permutation(len(x))]
    ids = np.arange(len(x)) * 3
    asked = np.flatnonzero(ids % 20 == 0)
    found = ann.Shard(ids, x, 20).search(ids[asked], x[asked], 1.0)
    for i in asked:
        product = x @ x[i]
        product[i] = -np.inf
        want = ids[np.lexsort((ids, -product))[:20]].tolist()
        assert found[1][found[0] == ids[i]].tolist() == want


def test_vectors_of_other_lengths_do_not_meet(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0, 0.0]), (4, [0.2, 0.9, 0.0]), (5, [2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df.withColumnRenamed("vec_id", "query_id"), df).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_relaxed_search_visits_less():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 8)) * 4, 100, axis=0) + rng.normal(size=(4000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    points = np.column_stack([x, np.zeros(len(x))])
    tree = ann.Tree(points)
    exact = np.argsort(-(points[::50] @ points.T), axis=1)[:, :20]
    share, recall = {}, {}
    for factor in (1.0, 0.6, 0.3):
        s = ann.Search(tree, points[::50], 20, factor).run()
        share[factor] = s.visited / (len(points) * len(exact))
        recall[factor] = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(s.rows, exact, strict=True)])
    assert recall[1.0] == 1 and share[1.0] < 0.6
    assert recall[0.6] >= 0.9 and share[0.6] < 0.6 * share[1.0]
    assert share[0.3] < share[0.6]


def test_toxicity(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    out = queries()["op5_toxicity"](spark, SF).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    flagged = out["predicted"] == 1
    assert (out.loc[flagged, "toxic"] == 1).mean() > 0.7 and out.loc[out["toxic"] == 1, "score"].mean() > 3 * out.loc[out["toxic"] == 0, "score"].mean()
    scored = toxicity.score_toxicity(odd, model).collect()
    assert len(scored) == len(ODD) and {r["score"] for r in scored if not r["text"]} == {0.0} and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels)["bias"] < 0


def test_toxic_sentences_are_located():
    rng = random.Random(2)
    words = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    texts, labels = [], []
    for i in range(400):
        lines = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(5)]
        if i % 4 == 0:
            lines[rng.randrange(5)] += " nastyterm"
        texts.append(". ".join(lines) + ".")
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(labels))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    out = next(toxicity.score_batches(iter([batch]), model)).to_pydict()
    for text, label, score, a, b in zip(texts, labels, out["score"], out["worst_start"], out["worst_end"], strict=True):
        assert (score >= 0.7) == bool(label)
        assert not label or "nastyterm" in text[a:b]


def test_language(spark, docs, odd):
    out = queries()["op8_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97
    model = langid.train(docs.limit(200))
    got = langid.identify_language(odd, model).collect()
    assert len(got) == len(ODD) and [r["lang_pred"] for r in got if r["doc_id"] in (7, 8, 9)] == ["und"] * 4
    assert langid.identify_language(odd.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify_language(odd, langid.train(docs.limit(0))).collect()} == {"und"}


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries()["op9_quality"](spark, SF).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.93
    model = quality.train(docs, labels)
    got = quality.score_quality(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score_quality(odd, quality.train(docs.limit(0), labels)).collect()} == {0.5}


def test_urls(spark):
    rows = [
        (1, "https://WWW.Example.com/en/a?x=1", "www.example.com", "/en/a", "www.example.com/en/", "allow"), (2, "http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"), (3, "http://a.net/es/x#y", "a.net", "/es/x", "net/es/", "block"),
        (4, "http://a.org/casino", "a.org", "/casino", None, "block"), (5, "http://a.org/casinox", "a.org", "/casinox", None, "allow"), (6, "http://bet-win.org/", "bet-win.org", "/", None, "block"), (7, "http://bet.org/bet", "bet.org", "/bet", None, "allow"),
        (8, None, "", "", None, "allow"), (9, "no scheme", "", "", None, "allow"), (10, "http://x.com", "x.com", "", None, "allow"), (11, "http://x.com/casino", "x.com", "/casino", "com/", "allow"), (12, "http://h?a://b", "h", "", None, "allow"), (None, "http://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"),
    ]
    df = spark.createDataFrame([(r[0], r[1], 1) for r in rows], "page_id bigint, url string, host int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df).collect()}
    assert got == {(r[0], *r[2:]) for r in rows}
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def test_licenses(spark, odd):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = ["Released under the MIT License. And under-the mit  LICENSE again", "Apache License, Version 2.0 (the License)", "CC BY-NC 4.0 license and cc by nc", "licensed under the GNU General Public License v3.0 or later", "mit dem die license", "SPDX-License-Identifier: BSD-3-Clause, licensed under the new BSD license", None, "", "...", "x " * 50_000 + "under the mit license"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = words.findall((t or "").lower() if (t or "").isascii() else t or "")
        at = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert got[3]["labels"] == "gpl-3" and got[4]["labels"] == "" and got[5]["labels"] == "bsd-3" and got[2]["labels"] == "cc-by-nc"
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(odd.limit(0)).count() == 0


def test_licenses_need_no_gate(spark):
    def scan(text):
        """Labels and number of detections by all rules, without any gate."""
        norm = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ", text.lower()).strip()
        norm = f" {norm} "
        spans = [(norm[: m.start()].count(" ") // 2, norm[: m.end()].count(" ") // 2, priority, rule, label, base) for rule, priority, _, pattern, label, _, base in licenses.rules() for m in re.finditer(pattern, norm)]
        if not any(g in norm for g in licenses.GATES):
            spans = [s for s in spans if norm.split()[s[0] : s[1]] != ["in", "mit"]]
        spans.sort(key=lambda s: (s[0], -s[1], s[2], s[3]))
        kept = [s for i, s in enumerate(spans) if s[5] or not any(o[2] <= s[2] and o[1] >= s[1] for o in spans[:i])]
        return ",".join(sorted({s[4] for s in kept})), len(kept)

    stated = [
        ("released under GPLv3", "gpl-3"), ("distributed under the GNU GPL version 2", "gpl-2"), ("under the terms of Apache 2.0", "apache-2"), ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"), ("CC0 1.0", "cc0"),
        ("WTFPL", "wtfpl"), ("GPL 3.0 only", "gpl-3"), ("released under FreeBSD", "bsd-2"), ("released under the Expat license", "mit"), ("released under apache2", "apache-2"),
        ("sie kam in mit dem hund", ""), ("in mit a license", "mit"), ("released under MIT", "mit"),
    ]
    rng = random.Random(6)
    names = sorted({f for _, _, name in licenses.NAMES for f in licenses.forms(name)})
    around = sorted({w for *_, notice in licenses.NOTICES for f in licenses.forms(notice) for w in f.replace("{}", " ").split()})
    mixed = [" ".join(f"{rng.choice(around)} {rng.choice(around)} {rng.choice(names)} {rng.choice(around)}" for _ in range(rng.randint(1, 3))) for _ in range(300)]
    every = [f"released under the {n}" for n in names]
    texts = [t for t, _ in stated] + mixed + every
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert [got[i]["labels"] for i in range(len(stated))] == [label for _, label in stated]
    assert [(got[i]["labels"], got[i]["n_detections"]) for i in range(len(texts))] == [scan(t) for t in texts]


def words_of(text, letters):
    """Maximal runs of letters (bytes) with their places."""
    raw, out, at = text.encode(), [], None
    for i, c in enumerate([*raw, 10]):
        if at is None and c in letters:
            at = i
        elif at is not None and c not in letters:
            out.append((at, i))
            at = None
    return raw, out


def one_hash(raw):
    """The hash of a run of bytes by itself."""
    from memlake.llm.common import run_hashes

    data = np.frombuffer(raw + b"\n", np.uint8)
    return int(run_hashes(data, np.array([0]), np.array([len(raw)]))[0])


def test_toxicity_by_a_plain_scorer(spark, docs):
    """Each sentence by itself, over the same model: logistic of distinct words and stems, then noisy-or."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model["buckets"].tolist(), model["weights"].tolist(), strict=True))
    letters = {*range(65, 91), *range(97, 123), *range(128, 256)}
    some = docs.where("doc_id < 60").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "... 12"), (-4, "one. two! one")], "doc_id bigint, text string"))
    for r in toxicity.score_toxicity(some, model).collect():
        raw, words = words_of(r["text"] or "", letters)
        stops = [i for i, c in enumerate(raw + b"\n") if c in b".!?\n"]
        sentences = {}
        for a, b in words:
            buckets = sentences.setdefault(next(s for s in stops if s >= a), set())
            buckets.add(one_hash(raw[a:b]) >> 44)
            for n in toxicity.STEMS:
                if b - a > n:
                    buckets.add(((one_hash(raw[a : a + n]) + (n << 44)) % (1 << 64)) >> 44)
        clean, best = 1.0, (0.0, 0)
        for stop, buckets in sorted(sentences.items()):
            p = 1 / (1 + np.exp(-(sum(weight.get(k, 0.0) for k in buckets) + model["bias"])))
            clean *= 1 - p
            best = max(best, (p, -stop))
        assert abs(r["score"] - (1 - clean)) < 1e-9
        assert abs(r["worst_score"] - best[0]) < 1e-9 and (not sentences or r["worst_end"] == -best[1])


def test_language_by_a_plain_network(spark, docs):
    """Each window by itself, the convolution as sums over bytes."""
    model = langid.train(docs.limit(400))
    rows = docs.where("doc_id < 12").select("doc_id", "text").collect() + [(900, "Ä é"), (901, "x" * 400)]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.identify_language(df, model).collect()}
    fold = lambda c: 32 if c < 33 else c + 32 if 65 <= c < 91 else c
    for i, text in rows:
        raw = text.encode()
        total, n = np.zeros(len(model["classes"])), 0
        for a in range(0, len(raw), langid.WINDOW):
            x = [fold(c) for c in raw[a : a + langid.WINDOW]]
            x += [32] * (langid.WINDOW - len(x))
            e = model["embed"][x]
            wide = max(langid.WIDTHS)
            top = np.max([e[j : j + wide].reshape(-1) @ model["kernel"] for j in range(langid.WINDOW - wide + 1)], axis=0)
            z = np.maximum(top + model["shift"], 0) @ model["out"] + model["bias"]
            total += z - z.max() - np.log(np.exp(z - z.max()).sum())
            n += 1
        p = np.exp(total / n - (total / n).max())
        p /= p.sum()
        assert got[i]["lang_pred"] == model["classes"][int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-4


def test_every_window_can_be_drawn():
    data = np.frombuffer(b"ab" * 5000 + b"\n", np.uint8)
    first, doc = langid.window_starts(np.array([0]), np.array([10_000]))
    assert len(first) == -(-10_000 // langid.WINDOW) and set(doc) == {0} and langid.window_bytes(data, first, np.full(len(first), 10_000)).shape == (len(first), langid.WINDOW)


def test_quality_by_a_plain_scorer(spark, docs):
    """Statistics by loops and densities by the covariance's inverse."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    rows = [tuple(r) for r in docs.where("doc_id < 40").select("doc_id", "text").collect()] + [(900, ""), (901, None), (902, "one"), (903, "A a a! A a a!\nA a")]
    got = {r["doc_id"]: r for r in quality.score_quality(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    marks = {ord(c) for c in ".,;:'\"!?-"}
    kind = lambda c: 0 if 97 <= c < 123 else 1 if 65 <= c < 91 else 2 if 48 <= c < 58 else 3 if c in marks else 4 if 33 <= c < 127 else 5 if c >= 128 else 6
    for i, text in rows:
        raw, words = words_of(text or "", set(range(256)) - {32, *range(9, 14)})
        x = np.zeros(15)
        if words:
            n, size = len(words), len(raw)
            own = [raw[a:b] for a, b in words]
            low = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in own]
            tri = [tuple(low[j : j + 3]) for j in range(n - 2)]
            length = np.array([len(w) for w in own], float)
            x = np.array(
                [np.log1p(n), *(np.sqrt(sum(kind(c) == k for c in raw) / size) for k in range(6)), np.sqrt(raw.count(b"!") / size), np.log1p(length.mean()), np.log1p(length.std()), np.sqrt(sum(len(w) == 1 and 2 <= kind(w[0]) <= 4 for w in own) / n),
                 np.sqrt(sum(kind(w[-1]) in (2, 4) for w in own) / n), len(set(low)) / n**0.9, np.sqrt((len(tri) - len(set(tri))) / max(n - 2, 1)), np.log1p(n / (raw.count(b"\n") + 1))]
            )
        z = (x - model["centre"]) / model["scale"]
        density = []
        for mean, inverse, log_det, prior in model["classes"]:
            precision = inverse.T @ inverse
            assert abs(np.linalg.slogdet(precision)[1] + log_det) < 1e-6
            density.append(prior - 0.5 * (log_det + (z - mean) @ precision @ (z - mean)))
        want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["predicted"] == int(want >= 0.7)


def test_urls_by_a_plain_loop(spark):
    """Terms found by regular expressions; very long URLs, repeated rows and no host."""
    rng = random.Random(4)
    pieces = [*urlfilter.STRICT, *urlfilter.SOFT, "news", "free-bet", "winbet", "a", "b2", "%20", "-", ".", "/"]
    urls = ["http://" + "".join(rng.choice(pieces) + rng.choice(["", "-", "/", ".", "_"]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    urls += ["http://a.org/" + "x" * 100_000 + "/casino", "http://a.org/" + "free-" * 20_000, "http://", "HTTP://CASINO.org", "://bet/win", urls[0], urls[0]]
    got = sorted((r["page_id"], r["verdict"], r["n_strict"], r["n_soft"]) for r in urlfilter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules=[]).collect())
    for (i, verdict, n_strict, n_soft), url in zip(got, urls, strict=True):
        text = re.split(r"[?#]", url.split("://", 1)[1])[0].lower()
        found = {t for t in (*urlfilter.STRICT, *urlfilter.SOFT) if re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", text)}
        strict, soft = found & set(urlfilter.STRICT), found & set(urlfilter.SOFT)
        block = bool(strict) or (len(soft) >= urlfilter.SOFT_LIMIT and sum(urlfilter.SOFT[t] for t in soft) >= urlfilter.SOFT_WEIGHT)
        assert (verdict, n_strict, n_soft) == ("block" if block else "allow", len(strict), len(soft)), (i, url[:200])
    assert not set(urlfilter.STRICT) & set(urlfilter.SOFT)
