import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlake.config import Config, blend_weight
from memlake.operators import capture, filters, govern, portrait, provenance, recall, render, replay
from memlake.operators import write as writing
from memlake.plans.tables import events, sessions
from memlake.schema import validate

NOW = 1_704_067_200_000
DAY = 86_400_000
CFG = Config()
SF = "/root/testdata/sf0.001"


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_capture_cases(spark):
    said = {
        1: "记住：以后都用 pnpm 管理依赖。",
        2: "你搞错了，这里应该用 workspace 作用域。",
        3: "记住第一条规则要遵守。记住第二条规则要遵守。记住第三条规则要遵守。记住第四条规则要遵守。",
        4: "记住",
        5: "如果以后都这样就好了吧",
        6: "记住：以后都用 pnpm 管理依赖。记住：以后都用 pnpm 管理依赖！",
    }
    m = spark.createDataFrame(list(said.items()), "message_id int, text string")
    got = {}
    for r in capture.candidates(m, CFG).collect():
        got.setdefault(r["message_id"], []).append(r)
    assert [(r["kind"], r["origin"], r["text"][-1]) for r in got[1]] == [("user_profile", "user_explicit", "赖")]
    assert [(r["kind"], r["origin"]) for r in got[2]] == [("agent_self", "user_correction")]
    assert sorted(r["place"] for r in got[3]) == [0, 1, 2] and 4 not in got and 5 not in got and len(got[6]) == 1
    why = {r["reason"]: r["n"] for r in capture.skipped(m, CFG).collect()}
    assert why == {"over-turn-quota": 1, "too-short": 1, "hypothetical": 1, "duplicate-in-turn": 1}


def test_recall_boundaries(spark, rows):
    r = rows(dict(id="a", kind="semantic", text="alpha beta"), dict(id="b", kind="semantic", text="alpha gamma delta epsilon"), dict(id="c", kind="semantic", text="unrelated words", importance=0.9), dict(id="d", kind="semantic", text="alpha beta", status="archived"))
    asked = spark.createDataFrame([(1, "alpha beta gamma"), (2, ""), (3, "é"), (4, "zzz")], "query_id int, query string")
    hits = {(h["query_id"], h["id"]): h for h in recall.recall(r.where(filters.active()), asked, NOW).collect()}
    assert hits[1, "a"]["match"] == pytest.approx(2 / 3) and hits[1, "a"]["rank"] == 1
    assert (1, "d") not in hits and (1, "c") not in hits and not any(k[0] == 4 for k in hits)
    assert hits[2, "c"]["score"] == 0.9 and hits[2, "c"]["rank"] == 1
    assert hits[3, "a"]["match"] == 1.0
    one = spark.createDataFrame([(1, "alpha beta gamma")], "query_id int, query string")
    detail = recall.explain(r.where(filters.active()), one).where("id = 'a'").collect()
    assert sum(d["contribution"] for d in detail) == pytest.approx(detail[0]["score"])


def test_memory_match_is_capped(spark, rows):
    r = rows(dict(id="a", kind="semantic", text="one two three four"))
    q = spark.createDataFrame([(1, "one two three and more words that follow")], "query_id int, query string")
    assert recall.matches(r, q, CFG, "memory").first()["match"] == 0.75


def test_semantic_falls_back_as_a_whole(spark, rows):
    r = rows(dict(id="a", kind="semantic", text="alpha"), dict(id="b", kind="semantic", text="beta"))
    q = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    qv = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    good = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.1])], "id string, vector array<double>")
    out = recall.semantic(r, good, q, qv, NOW).orderBy("rank").collect()
    assert [h["id"] for h in out] == ["b", "a"] and not out[0]["fallback"]
    odd = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0])], "id string, vector array<double>")
    out = recall.semantic(r, odd, q, qv, NOW).collect()
    assert [h["id"] for h in out] == ["a"] and out[0]["fallback"]


def test_hybrid_blends_every_lexical_score(spark, rows):
    # 60 records match better than z; z is far ahead by its vector
    r = rows(*[dict(id=f"a{i:02}", kind="semantic", text="alpha beta gamma", importance=0.9) for i in range(60)], dict(id="z", kind="semantic", text="alpha beta gamma with some more words", importance=0.5), dict(id="y", kind="semantic", text="delta", importance=0.1))
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, ""), (3, "é")], "query_id int, query string")
    qv = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3)], "query_id int, vector array<double>")
    v = spark.createDataFrame([*((f"a{i:02}", [0.0, 1.0]) for i in range(60)), ("z", [1.0, 0.0]), ("y", [1.0, 0.0])], "id string, vector array<double>")
    out = {(h["query_id"], h["id"]): h["score"] for h in recall.semantic(r, v, q, qv, NOW, CFG, "hybrid").collect()}
    weight = blend_weight(CFG)
    alone = recall.recall(r.where("id in ('z', 'y') or id < 'a40'"), q, NOW, CFG, "query", 50, min_match=0.0)
    assert alone.where("id = 'z'").count() == 3
    relevance = recall.matches(r, q).where("id = 'z' and query_id = 1").first()["relevance"]
    age = recall.recency(NOW)
    rec = r.where("id = 'z'").select(age.alias("x")).first()["x"]
    assert out[1, "z"] == pytest.approx(weight + (1 - weight) * (0.6 * relevance + 0.3 * 0.5 + 0.1 * rec), abs=1e-9)
    assert out[1, "y"] == pytest.approx(weight)
    assert out[2, "z"] == pytest.approx(weight + (1 - weight) * 0.5) and out[3, "z"] == pytest.approx(weight + (1 - weight) * (0.15 + 0.1 * rec))


def test_merge_groups_match_a_plain_loop(spark, rows):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    items = [dict(id=f"r{i:02d}", kind="semantic", subject=f"s{i % 2}", text=" ".join(rng.sample(words, rng.randint(2, 5))), observedAt=NOW - rng.randint(0, 5) * DAY) for i in range(40)]
    got = {}
    for g in govern.merge_groups(rows(*items), CFG).collect():
        got.setdefault(g["lead"], set()).add(g["id"])
    want = {}
    for s in ("s0", "s1"):
        pool = sorted((x for x in items if x["subject"] == s), key=lambda x: (x["observedAt"], x["id"]))
        used = set()
        for i, lead in enumerate(pool):
            if lead["id"] in used:
                continue
            a = set(lead["text"].split())
            own = [x["id"] for x in pool[i + 1 :] if x["id"] not in used and len(a & set(x["text"].split())) / min(len(a), len(set(x["text"].split()))) >= 0.7]
            if own:
                want[lead["id"]] = {lead["id"], *own}
                used |= want[lead["id"]]
    assert got == want and got


def test_containment_at_the_threshold_merges(rows):
    a = "one two three four five six seven eight nine ten"
    b = "one two three four five six seven x1 x2 x3"
    r = rows(dict(id="a", kind="semantic", subject="s", text=a), dict(id="b", kind="semantic", subject="s", text=b))
    assert ids(govern.merge_groups(r, CFG)) == ["a", "b"]


def test_conflicts_ignore_values_and_protect_users(rows):
    r = rows(
        dict(id="old", kind="semantic", subject="s", field="f", value="1", text="x", origin="user_explicit", observedAt=1), dict(id="new", kind="semantic", subject="s", field="f", value="1", text="y", observedAt=2),
        dict(id="o2", kind="semantic", subject="t", field="f", value="1", text="x", observedAt=1), dict(id="n2", kind="semantic", subject="t", field="f", value="2", text="y", origin="user_correction", observedAt=2),
    )
    assert sorted(map(tuple, govern.conflicts(r).collect())) == [("n2", "o2", False), ("new", "old", True)]


def test_archive_boundaries(rows):
    at = NOW - 180 * DAY
    base = dict(kind="procedural", text="x", observedAt=at)
    r = rows(dict(base, id="a", importance=0.1499), dict(base, id="b", importance=0.15), dict(base, id="c", importance=0.1, observedAt=at + 1), dict(base, id="d", importance=0.1, pinned=True), dict(base, id="e", importance=0.1, kind="agent_self"))
    assert ids(r.where(govern.archivable(NOW, CFG))) == ["a"]


def test_summary_boundary(rows):
    five = [dict(id=f"a{i}", kind="semantic", subject="s", text=f"t{i}") for i in range(5)]
    assert govern.summaries(rows(*five), CFG).count() == 0
    six = govern.summaries(rows(*five, dict(id="a5", kind="semantic", subject="s", text="t5", importance=0.9)), CFG).first()
    assert six["n"] == 6 and six["absorbed"][0] == "a5" and six["text"].startswith("关于 s 的既有记录（6 条）：t5；t0")


def test_consolidation_in_order(rows):
    r = rows(dict(id="a", kind="semantic", subject="s", text="use pnpm for builds", useCount=2, importance=0.4), dict(id="b", kind="semantic", subject="s", text="use pnpm for builds always", useCount=3, importance=0.8))
    out = {x["id"]: x for x in govern.consolidate(r, NOW, CFG).collect()}
    assert out["a"]["status"] == "active" and out["a"]["useCount"] == 5 and out["a"]["importance"] == 0.8 and out["b"]["status"] == "archived"


def test_mentions_fold_in_order(spark, rows):
    def fold(first, second):
        new = rows(dict(id="n1", kind="semantic", text="same", importance=first), dict(id="n2", kind="semantic", text="same", importance=second)).withColumn("sessionId", F.col("id")).withColumn("arrival", F.col("id"))
        old = rows(dict(id="old", kind="semantic", text="same", importance=0.5))
        r = writing.merge_by_hash(old, new, CFG).collect()
        assert len(r) == 1 and r[0]["id"] == "old" and not r[0]["created"] and r[0]["reinforcement"]["sessions"] == ["n1", "n2"]
        return round(r[0]["importance"], 6)

    assert fold(0.7, 0.5) == 0.9 and fold(0.5, 0.7) == 0.8


def test_write_path(spark, rows):
    existing = rows(dict(id="e", kind="semantic", text="known fact here"), dict(id="p", kind="semantic", text="waiting fact here", status="pending"))
    data = [("1", "user_explicit", "known fact here"), ("2", "user_explicit", "password: hunter22x"), ("3", "model_proposed", "brand new idea"), ("4", "model_proposed", "known fact here"), ("5", "model_proposed", "waiting fact here"), ("6", "user_explicit", "mail alice@example.com"), ("7", "user_explicit", "mail alice@example.com"), ("8", "user_explicit", "refused text")]
    new = spark.createDataFrame([(i, int(i), o, t, "semantic", "s1") for i, o, t in data], "input_id string, arrival int, origin string, text string, kind string, sessionId string")
    from memlake.functions.text import record_hash

    refused = spark.createDataFrame([("refused text",)], "t string").select(record_hash(F.lit("semantic"), F.lit("workspace"), F.lit("*"), F.lit(None), F.col("t")).alias("hash"))
    versions, results = writing.write(existing, new, NOW, CFG.with_(write_policy="ask"), rejected=refused)
    got = {r["input_id"]: r["outcome"] for r in results.collect()}
    assert got == {"1": "merged", "2": "rejected_sensitive", "3": "pending", "4": "already_exists", "5": "already_pending", "6": "created", "7": "merged", "8": "rejected_by_user"}
    texts = {r["text"]: r["status"] for r in versions.collect()}
    assert texts == {"known fact here": "active", "brand new idea": "pending", "mail a***@example.com": "active"}
    none = writing.write(existing, new, NOW, CFG.with_(write_policy="ask", pending_max=1))[1].where("input_id = '3'").first()["outcome"]
    assert none == "pending_queue_full"
    off = writing.write(existing, new, NOW, CFG.with_(write_policy="off"))[1].where("input_id = '3'").first()["outcome"]
    assert off == "rejected_write_policy"


def test_approval(spark, rows):
    r = rows(dict(id="p", kind="semantic", text="waiting", status="pending"), dict(id="own", kind="agent_self", subject="self.persona.voice", text="calm voice", origin="user_explicit"), dict(id="q", kind="agent_self", subject="self.persona.voice", text="loud voice", origin="model_proposed", status="pending"))
    one = spark.createDataFrame([("p",), ("q",)], "id string")
    assert {(x["id"], x["status"]) for x in writing.approve(r, one, NOW, CFG).collect()} == {("p", "active")}
    gone, hashes = writing.reject(r, one, NOW)
    assert ids(gone) == ["p", "q"] and hashes.count() == 2
    assert writing.confirm(r, one, NOW).count() == 0


def test_portrait(spark, rows):
    r = rows(
        dict(id="u", kind="agent_self", facet="persona", subject="self.persona.voice", text="speaks plainly and briefly", origin="user_explicit", confidence=0.9),
        dict(id="m", kind="agent_self", facet="work", subject="self.work.habits", text="writes tests before the code", origin="model_proposed", confidence=0.7),
    )
    c = [("1", "speaks plainly and briefly", "persona", "self.persona.voice", "model_proposed", 0.5), ("2", "speaks plainly and briefly, mostly so", "persona", "self.persona.voice", "model_proposed", 0.5), ("3", "writes tests before the code always", "work", "self.work.habits", "model_proposed", 0.8), ("4", "prefers refactoring in small steps", "work", "self.work.habits", "model_proposed", 0.8), ("5", "short", "work", "self.work.habits", "model_proposed", 0.8), ("6", "小忆", "persona", "self.persona.name", "model_proposed", 0.8)]
    df = spark.createDataFrame(c, "candidate_id string, text string, facet string, subject string, origin string, confidence double")
    got = {x["candidate_id"]: x for x in portrait.converge(df, r, CFG).collect()}
    assert {k: (v["action"], v["reason"]) for k, v in got.items()} == {"1": ("reinforce", "reinforced"), "2": ("skip", "user-owned"), "3": ("reinforce", "reinforced"), "4": ("supersede", "superseded"), "5": ("skip", "too-short"), "6": ("add", "added")}
    assert got["3"]["confidence"] == pytest.approx(0.85) and got["4"]["archive_target"] and got["2"]["text"] == "speaks plainly and briefly"


def test_portrait_meets_every_record(spark, rows, monkeypatch):
    monkeypatch.setattr(portrait, "best_matches", lambda a, b, f=portrait.best_matches: f(a, b, 9, 7))
    rng = random.Random(9)
    words = "red green blue gold grey pink teal navy plum rust sand snow".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    held = [dict(id=str(i), kind="agent_self", facet="work", subject=rng.choice(["en", "de"]), text=some(rng.randint(1, 6)), importance=rng.choice([0.2, 0.5]), confidence=rng.choice([0.6, 0.7]), pinned=rng.random() < 0.1) for i in range(80)]
    said = [(str(i), some(rng.randint(2, 6)), "work", rng.choice(["en", "de", "fr"]), "user_explicit", 0.7) for i in range(60)] + [("null", None, "work", "en", "user_explicit", 0.7), ("none", "nothing here is shared", "work", "en", "user_explicit", 0.7)]
    df = spark.createDataFrame(said, "candidate_id string, text string, facet string, subject string, origin string, confidence double")
    got = {x["candidate_id"]: x for x in portrait.converge(df, rows(*held), CFG).collect()}
    assert set(got) == {c[0] for c in said}
    from memlake.functions.text import token_set

    kept = {t: set(k) for t, k in spark.createDataFrame([(t,) for t in {h["text"] for h in held} | {c[1] for c in said if c[1]}], "t string").select("t", token_set(F.col("t"))).collect()}
    for key, text, _, subject, *_ in said:
        if text is None or subject == "fr" or len(text) < 8:
            assert got[key]["action"] == ("add" if text and len(text) >= 8 else "skip")
            continue
        both = lambda h: len(kept[h["text"]] & kept[text])
        least = lambda h: min(len(kept[h["text"]]), len(kept[text]))
        best = min((h for h in held if h["subject"] == subject), key=lambda h: (h["text"] != text, both(h) < least(h), -both(h) / len(kept[h["text"]] | kept[text]), not h["pinned"], -h["importance"], -h["confidence"], h["id"]))
        assert got[key]["target_id"] == best["id"]


def test_portrait_query_reads_all_records(spark):
    from memlake.plans.queries import QUERIES

    out = QUERIES["portrait_converge"](spark, "/root/testdata/sf0.001")
    assert out.where(F.col("target_id").cast("long") >= 60).count() > 0


def test_history_tolerates_rings(rows):
    a = dict(kind="agent_self", facet="work", subject="s")
    r = rows(dict(a, id="1", text="x", observedAt=1, supersededBy="2"), dict(a, id="2", text="y", observedAt=2), dict(a, id="3", text="z", observedAt=3, supersedes=["2"]), dict(a, id="9", text="w", observedAt=9), dict(a, id="r1", subject="t", text="p", observedAt=5, supersededBy="r2"), dict(a, id="r2", subject="t", text="q", observedAt=6, supersededBy="r1"))
    assert sorted(tuple(x["ids"]) for x in portrait.history(r).collect()) == [("1", "2", "3"), ("r1", "r2")]


def test_blocks_keep_their_budgets(rows):
    r = rows(*[dict(id=f"f{i}", kind="user_profile", text=f"fact number {i} " + "x" * 80, importance=1 - i / 100) for i in range(20)], dict(id="g", kind="project_gist", text="gist text", scope=("workspace", "w")), dict(id="h", kind="user_profile", text="hidden", status="pending"))
    block = render.context_block(r, CFG, "w").collect()
    facts = [b for b in block if b["section"] == "facts"]
    assert [b["id"] for b in facts] == [f"f{i}" for i in range(len(facts))] and 0 < sum(b["cost"] for b in facts) <= 300
    text = render.context_text(r, CFG, "w").first()[0]
    assert text.startswith(render.TEXTS["zh"].facts_header) and "- gist text" in text and "hidden" not in text
    s = rows(dict(id="a", kind="agent_self", facet="work", text="agree on this", origin="user_explicit", confidence=0.9), dict(id="b", kind="agent_self", text="seen once", origin="model_proposed", confidence=0.95))
    assert ids(render.self_block(s, CFG)) == ["a"]


def test_transcript_matches_a_plain_model(spark):
    cfg = CFG.with_(sleep_max_chars_per_session=800, sleep_max_chars_total=6000)
    got = {}
    for r in replay.transcripts(sessions(spark, SF), events(spark, SF), cfg).collect():
        got.setdefault(r["sessionId"], []).append((r["seq"], r["role"]))
    raw = spark.read.parquet(f"{SF}/conversations.parquet").toPandas()
    want = {}
    sizes = []
    for conv, rows_ in raw.groupby("conv_id"):
        if conv % 13 == 0:
            continue
        groups, context = [], []
        for x in rows_.sort_values("turn").itertuples():
            text = " ".join((x.text or "").split())
            text = text if len(text) <= 800 else text[:799] + "…"
            if x.role == "user":
                groups.append(((x.turn * 2, "user", len(text)), context))
                context = []
            elif x.role == "assistant":
                context = [*context, (x.turn * 2, "assistant", len(text))][-3:]
        used, kept = 0, []
        for user, own in reversed(groups):
            full = user[2] + sum(c[2] for c in own)
            if used + full <= 800:
                kept.append([*own, user])
                used += full
            elif used + user[2] <= 800:
                kept.append([user])
                used += user[2]
            else:
                break
        sizes.append((-conv, f"s-{conv}", used, [m[:2] for g in reversed(kept) for m in g]))
    total = 0
    for _, name, used, messages in sorted(sizes):
        if used and total + used <= 6000:
            total += used
            want[name] = messages
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and want


def test_replay_plan(spark, rows):
    said = [("s1", "user/message", 1, 10, '{"role":"user","source":{"kind":"user"},"content":[{"type":"text","text":"记住：以后都用 pnpm 管理依赖。"}]}'), ("s1", "user/message", 2, 20, '{"role":"user","source":{"kind":"host"},"content":[{"type":"text","text":"记住：这句不算数的话。"}]}'), ("s2", "user/message", 1, 30, '{"role":"user","source":{"kind":"user"},"content":[{"type":"text","text":"记住：以后都用 pnpm 管理依赖。 docker electron"}]}')]
    e = spark.createDataFrame(said, "sessionId string, type string, seq bigint, time bigint, data string")
    s = spark.createDataFrame([("s1", "/w", 1, None, None, False, True), ("s2", "/w", 2, None, None, False, True), ("sub", "/w", 3, "subagent", None, False, True)], "sessionId string, cwd string, createdAt bigint, origin string, parentSession string, live boolean, persisted boolean")
    old = rows(dict(id="a", kind="semantic", subject="s", text="old thing", importance=0.01, observedAt=NOW - 400 * DAY))
    plan = replay.plan(old, s, e, NOW, CFG)
    assert [b["text"] for b in plan.backfill.collect()] == ["记住：以后都用 pnpm 管理依赖"] and ids(plan.archive) == ["a"]
    assert [g["text"] for g in plan.gists.collect()] == ["这个工作区看起来涉及：pnpm、electron、docker。"]
    after = replay.apply(old, plan, NOW, CFG)
    assert after.count() == 3 and replay.plan(after, s, e, NOW, CFG).backfill.count() == 0


def test_provenance(spark, rows):
    r = rows(dict(id="a", kind="semantic", text="alpha beta", refs=[("ses-11111111x", 2, 4, "live")]), dict(id="b", kind="semantic", text="gamma", refs=[("ses-22222222y", None, None, "live")]))
    m = spark.createDataFrame([("ses-11111111x", 3, "alpha said"), ("ses-11111111x", 9, "beta said"), ("ses-22222222y", 1, "gamma")], "sessionId string, seq bigint, text string")
    got = {x["id"]: (x["events"], x["coverage"]) for x in provenance.verify(r, m).collect()}
    assert got == {"a": (1, 0.5), "b": (1, 1.0)}
    assert ids(provenance.trace(r, "1111", 4)) == ["a"] and ids(provenance.trace(r, "ses-1", 5)) == []
    with pytest.raises(LookupError):
        provenance.trace(r, "ses-")
    lines = spark.createDataFrame([("alpha",), ("nowhere",)], "line string")
    assert tuple(provenance.shown(lines, m.select("text")).first()) == (2, 1, 1)


def test_filters(spark, rows):
    r = rows(dict(id="a", kind="semantic", text="x", branch="main"), dict(id="b", kind="semantic", text="x"), dict(id="c", kind="semantic", text="x", status="pending"))
    assert ids(r.where(filters.branch_visible("main", CFG))) == ["a", "b", "c"] and ids(r.where(filters.branch_visible(None, CFG))) == ["b", "c"]
    assert ids(r.where(filters.branch_selected([], "main"))) == [] and ids(r.where(filters.branch_selected("current", "main"))) == ["a"]
    assert ids(r.where(filters.clear_selected(everything=True))) == ["a", "b"]
    with pytest.raises(ValueError):
        filters.clear_selected()
    with pytest.raises(LookupError):
        filters.by_prefix(r, "zzz", pending=True)
    assert validate(r.withColumn("kind", F.lit("odd"))).first()["invalid"] == "kind"


def test_results_do_not_depend_on_partitions(spark, rows):
    r = rows(*[dict(id=f"r{i}", kind="semantic", text=f"alpha w{i % 3}", subject="s") for i in range(12)])
    asked = spark.createDataFrame([(1, "alpha w1")], "query_id int, query string")
    before = recall.recall(r, asked, NOW).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        after = recall.recall(r.repartition(5), asked, NOW).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = ["query_id", "rank"]
    pd.testing.assert_frame_equal(before.sort_values(order, ignore_index=True), after.sort_values(order, ignore_index=True))
