"""What a turn sees, reports, the service with its tools and commands, the store under streams and breaks."""

import json

import pytest
from pyspark.sql import functions as F

from memlake.config import Config
from memlake.functions import safety
from memlake.functions.text import fnv1a, fnv1a_short
from memlake.operators import capture, inject, provenance, recall, render, replay, report
from memlake.plans.service import MemoryService
from memlake.plans.tools import Commands, Tools
from memlake.sources import sessions as logs
from memlake.sources.store import ASIDE, Store
from memlake.streaming import turns as streams

NOW = 1_704_067_200_000
DAY = 86_400_000
CFG = Config()
EVENT = "sessionId string, type string, seq bigint, time bigint, data string"


def said(text, kind="user"):
    return json.dumps({"role": "user", "source": {"kind": kind}, "content": [{"type": "text", "text": text}]})


def test_cooldown_counts_from_the_last_showing(spark):
    hits = spark.createDataFrame([("s", "a", t) for t in (1, 3, 5, 6, 8)] + [("s", "b", 3)], "sessionId string, id string, turn bigint")
    got = {(r["id"], r["turn"]): (r["since"], r["cooled"]) for r in provenance.cooled(hits, 3, ["sessionId", "id"]).collect()}
    assert got == {("a", 1): (1000, True), ("a", 3): (2, False), ("a", 5): (4, True), ("a", 6): (1, False), ("a", 8): (3, True), ("b", 3): (1002, True)}


def test_whole_addresses_are_masked(spark):
    long = "x" * 300 + "@example.com"
    texts = ["mail " + long, "a@b.co.x@y.com", "a" * 200_000, "b" * 100_000 + "@c.de", "no mail here", "13812348000 u.v+w@x-y.org!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(safety.mask_pii(F.col("t"), F.col("t"))).collect()]
    assert got == ["mail x***@example.com", "a***@b.co.***@y.com", "a" * 200_000, "b***@c.de", "no mail here", "138****8000 u***@x-y.org!"]


def test_fingerprints_of_odd_texts(spark):
    def plain(text):
        h = 2166136261
        for i in range(0, len(raw := text.encode("utf-16-le")), 2):
            h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 16777619) & 0xFFFFFFFF
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out

    texts = ["", "a", "中文 text", "\U0001F600 smile", "x" * 5000, *(f"t{i}" * i for i in range(30))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string").select("i", fnv1a(F.col("t")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: plain(t) for i, t in enumerate(texts)} | {99: None}
    short = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fnv1a_short(F.col("t")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in short} == {i: plain(t) for i, t in enumerate(texts)}


def turn_of(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, sessionId string, turn bigint, query string, workspace string")


def test_a_turn_in_order(spark, rows):
    r = rows(
        dict(id="a", kind="semantic", text="alpha beta gamma delta", importance=0.9), dict(id="b", kind="semantic", text="alpha beta gamma shown", importance=0.8), dict(id="c", kind="semantic", text="alpha beta gamma elsewhere", scope=("workspace", "other")),
        dict(id="d", kind="agent_self", text="alpha beta gamma self"), dict(id="e", kind="semantic", text="alpha beta gamma recent", importance=0.7), dict(id="f", kind="semantic", text="alpha beta gamma old", status="archived"),
    )
    turns = turn_of(spark, ("q1", "s1", 5, "alpha beta gamma please", "*"), ("q2", "s2", 1, "short", "*"))
    lines = spark.createDataFrame([("s1", "- (semantic) Alpha  beta gamma shown.")], "sessionId string, line string")
    last = spark.createDataFrame([("s1", "e", 3), ("s1", "a", 2), ("gone", "a", 1)], "sessionId string, id string, last_turn bigint")
    gates = spark.createDataFrame([], inject.GATES)
    step = inject.inject(r, turns, lines, last, gates, NOW, CFG)
    got = [(m["query_id"], m["place"], m["section"]) for m in step.messages.orderBy("query_id", "place").collect()]
    assert got == [("q1", 0, "recall"), ("q1", 1, "self-reflect"), ("q1", 2, "self-intro")]
    text = step.messages.where("place = 0").first()["text"].split("\n")
    assert text == [render.TEXTS["zh"].recall_header, "- (semantic) alpha beta gamma delta", render.TEXTS["zh"].recall_footer]
    assert {(x["sessionId"], x["id"], x["last_turn"]) for x in step.last.collect()} == {("s1", "e", 3), ("s1", "a", 5), ("gone", "a", 1)}
    after = {x["sessionId"]: (x["last_reflect_turn"], x["reflections"], x["session_turns"]) for x in step.gates.collect()}
    assert after == {"s1": (5, 1, 5), "s2": (None, 0, 1)} and step.asks == 1
    again = inject.inject(r, turn_of(spark, ("q3", "s1", 6, "alpha beta gamma please", "*")), lines, step.last, step.gates, NOW, CFG, step.asks, step.asked_sessions)
    assert [m["section"] for m in again.messages.collect()] == ["recall"]  # only e is due by then
    assert [h["id"] for h in again.hits.collect()] == ["e"]
    dry = inject.inject(r, turns, lines, last, gates, NOW, CFG, mode="dry")
    assert dry.messages.count() == 0 and dry.hits.count() == 1 and dry.gates.count() == 0
    off = inject.inject(r, turns, lines, last, gates, NOW, CFG, mode="off")
    assert off.hits.count() == 0 and off.last.count() == last.count()


def test_names_are_asked_for_a_few_times(spark, rows):
    r = rows(dict(id="a", kind="semantic", text="alpha"))
    turns = turn_of(spark, *((f"q{i}", f"s{i}", 3, "hello there world", "*") for i in range(5)))
    none = spark.createDataFrame([], "sessionId string, line string")
    last = spark.createDataFrame([], "sessionId string, id string, last_turn bigint")
    step = inject.inject(r, turns, none, last, spark.createDataFrame([], inject.GATES), NOW, CFG)
    assert step.messages.where("section = 'self-intro'").count() == 2 and step.asks == 2
    named = rows(dict(id="n", kind="agent_self", subject="self.persona.name", text="Ada", status="archived"))
    assert inject.inject(named, turns, none, last, spark.createDataFrame([], inject.GATES), NOW, CFG).asks == 0


def test_reflection_keeps_its_distance(spark):
    turns = turn_of(spark, *((f"q{t}", f"s{t}", t, "x", "*") for t in (2, 4, 11, 12)), ("n", "sn", None, "x", "*"))
    gates = spark.createDataFrame([("s11", 0, 1, [0], 11), ("s12", 0, 1, [0], 11)], inject.GATES)
    assert {r["query_id"]: r["reflect"] for r in inject.step_gates(turns, gates, CFG).collect()} == {"q2": False, "q4": True, "q11": False, "q12": True, "n": False}


def test_corrections_inherit_their_slot(spark, rows):
    r = rows(dict(id="a", kind="user_profile", subject="env.shell", field="shell", value="bash", text="用户的默认终端是 bash"), dict(id="b", kind="user_profile", subject="other", text="别的事情"))
    m = spark.createDataFrame([("m1", "不对，用户的默认终端改成 zsh。"), ("m2", "我更喜欢简短的回答方式。")], "message_id string, text string")
    got = {x["message_id"]: x for x in capture.inherit(capture.candidates(m, CFG), r, NOW, CFG).collect()}
    assert (got["m1"]["corrects"], got["m1"]["subject"], got["m1"]["field"], got["m1"]["value"]) == ("a", "env.shell", "shell", "bash")
    assert got["m2"]["corrects"] is None and got["m2"]["subject"].startswith("preference.")


def test_the_last_request_of_the_user_decides(spark):
    rows = [("s", "user/message", 1, 1, said("记住这件事情")), ("s", "user/message", 2, 2, said("something else")), ("s", "user/message", 3, 3, said("记住", "host")), ("t", "user/message", 1, 1, said("please remember this"))]
    got = {r["sessionId"]: r["origin"] for r in logs.last_request(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"s": "model_proposed", "t": "user_explicit"}


def test_texts_of_queues_branches_and_audits(spark, rows):
    r = rows(dict(id="p1", kind="agent_self", facet="persona", text="calm\nvoice", origin="model_proposed", status="pending", observedAt=NOW, refs=[("ses-1", 2, 4, "tool")]), dict(id="x", kind="semantic", text="t", branch="main"), dict(id="y", kind="semantic", text="u", branch="dev"), dict(id="z", kind="semantic", text="v", branch="main"))
    text = report.pending_text(r, CFG).first()[0].split("\n")
    assert text[0] == "[待确认写入 · 共 1 条 · 上限 50]" and text[1] == "  - p1 · agent_self/persona · model_proposed · 2024-01-01 00:00 · 引用 ses-1#2-4 · calm voice" and len(text) == 3
    assert report.pending_text(r.where("id = 'x'"), CFG).first()[0] == "[待确认写入 · 0 条]\n没有待确认的写入。"
    branch = report.branch_text(r, "dev").first()[0].split("\n")
    assert branch == ["[记忆分支 · 当前分支：dev]", "带分支标签的记忆：3 条（库内共 4 条）。", "按分支分组：", "  - main：2 条", "  - dev：1 条（当前分支）"]
    unknown = report.branch_text(r.where("branch is null"), None).first()[0]
    assert "当前分支：unknown" in unknown and "没有任何分支专属记忆" in unknown and unknown.endswith("（fail-closed）。")
    none = spark.createDataFrame([], "at bigint, id string, kind string, origin string, via string, action string, reason string")
    audit = report.audit_text(none, r, CFG).first()[0]
    assert "本轮没有记录到被拒或入队的尝试" in audit and "未做核对" in audit and "共 4 条 · active 3 · pending 1" in audit and "通过" not in audit
    one = spark.createDataFrame([(NOW, None, "semantic", "model_proposed", None, "rejected", "rejected_echo")], none.schema)
    audit = report.audit_text(one, r, CFG, "main", {"checked": 1, "matched": 0, "missing": 1, "gap": "no log"}).first()[0]
    assert "  - （无 id） · rejected · via=（无） · origin=model_proposed · kind=semantic · 2024-01-01 00:00 · 原因：rejected_echo" in audit and "无法核对 —— 原因：no log" in audit
    assert report.list_lines(r.where("id = 'x'")).first()["line"] == "x  semantic      workspace  t"


def test_plans_as_text(spark, rows):
    e = spark.createDataFrame([("s1", "user/message", 1, NOW, said("记住：以后都用 pnpm 管理依赖。"))], EVENT)
    s = spark.createDataFrame([("s1", "/w", 1, None, None, False, True)], "sessionId string, cwd string, createdAt bigint, origin string, parentSession string, live boolean, persisted boolean")
    old = rows(dict(id="a", kind="semantic", subject="s", text="old thing", importance=0.01, observedAt=NOW - 400 * DAY))
    made = replay.plan(old, s, e, NOW, CFG)
    text = report.plan_text(made, old, CFG).first()[0]
    assert "补录 1 条（按时间升序）：" in text and "会话 s1#1 · 2024-01-01 00:00" in text and "归档 1 条：a" in text
    empty = replay.plan(old.where("id = 'none'"), s.limit(0), e, NOW, CFG)
    assert "无需改动" in report.plan_text(empty, old, CFG).first()[0]
    once = replay.apply(old, made, NOW, CFG)
    twice = replay.apply(once, made, NOW, CFG)
    assert once.count() == 2 and sorted(r["id"] for r in twice.collect()) == sorted(r["id"] for r in once.collect())


def test_evaluation_numbers(spark, rows):
    r = rows(dict(id="a", kind="semantic", text="alpha beta gamma"))
    m = spark.createDataFrame([(1, "alpha beta gamma alpha"), (2, "alpha beta"), (3, "nothing of the kind at all")], "query_id int, query string")
    assert {x["bucket"]: (x["total"], x["triggered"]) for x in recall.triggers(r, m, NOW, CFG).collect()} == {"long": (2, 1), "short": (1, 1)}
    t = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 2, 3, 9, 8, 7, 6, 10]] + [(None,)], "ms double")
    assert tuple(recall.latency(t).first()) == (10, 6.0, 10.0, 10.0)
    assert tuple(recall.latency(t.limit(0)).first()) == (0, 0.0, 0.0, 0.0)
    score = recall.legacy_score(r, m, NOW, CFG).where("query_id = 2").first()["score"]
    assert score == pytest.approx(0.6 + 0.3 * 0.5 + 0.1)


def test_both_ways_to_sum_agree(spark, rows, monkeypatch):
    r = rows(*[dict(id=f"r{i}", kind="semantic", text=" ".join(f"w{(i * k) % 7}" for k in range(1, 2 + i % 5))) for i in range(30)])
    q = spark.createDataFrame([(1, "w1 w2 w2 w3"), (2, "w0 w6"), (3, "zzz")], "query_id int, query string")
    table = {(x["query_id"], x["id"]): tuple(x)[2:] for x in recall.matches(r, q).collect()}
    monkeypatch.setattr(recall, "TABLE", 0)
    join = {(x["query_id"], x["id"]): tuple(x)[2:] for x in recall.matches(r, q).collect()}
    monkeypatch.setattr(recall, "BROADCAST_TOKENS", 1)
    large = {(x["query_id"], x["id"]): tuple(x)[2:] for x in recall.matches(r, q).collect()}
    assert table.keys() == join.keys() == large.keys() and table
    for key, value in table.items():
        assert value == pytest.approx(join[key]) and value == pytest.approx(large[key])


def test_streams_write_beside_each_other(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(rows(dict(id="a", kind="semantic", text="there before")))
    closed = spark.createDataFrame([("s1", 1, 9, NOW, "记住：以后都用 pnpm 管理依赖。", 1)], streams.TURN)
    streams.capture_batch(store, "one", closed, 0)
    streams.capture_batch(store, "two", closed.withColumn("text", F.lit("记住：另外一条规则也要遵守。")), 0)
    texts = sorted(r["text"] for r in store.records().collect())
    assert len(texts) == 3 and "there before" in texts
    before = store.versions().count()
    streams.capture_batch(store, "one", closed, 0)  # comes again, having landed
    assert store.versions().count() == before
    # one that was broken off before its mark: it replaces itself and counts once
    broken = Store(spark, str(tmp_path / "b"))
    streams.capture_batch(broken, "one", closed, 0)
    broken.set_mark("stream:one", 0)
    streams.capture_batch(broken, "one", closed, 0)
    assert [(r["text"], r["reinforcement"]["count"]) for r in broken.records().collect()] == [("记住：以后都用 pnpm 管理依赖", 0)]


def test_captured_turns_reach_the_store(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(rows(dict(id="a", kind="semantic", text="there before")))
    spark.createDataFrame([("s1", 1, 9, NOW, "记住：以后都用 pnpm 管理依赖。", 1)], streams.TURN).write.parquet(str(tmp_path / "in"))
    run = streams.capture_into(store, spark.readStream.schema(streams.TURN).parquet(str(tmp_path / "in")), str(tmp_path / "state"))
    assert run.awaitTermination(120)
    assert sorted(r["id"][:1] for r in store.records().collect()) == ["a", "m"]


def test_compaction_loses_nothing(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(rows(dict(id="a", kind="semantic", text="one"), dict(id="b", kind="semantic", text="two")))
    store.append(rows(dict(id="a", kind="semantic", text="uno")))
    store.delete(store.records().where("id = 'b'"))
    store.compact()
    assert [(r["id"], r["text"]) for r in store.records().collect()] == [("a", "uno")] and store.versions().count() == 1
    (tmp_path / "s" / "records").rename(tmp_path / "s" / f"records{ASIDE}")  # broken off between its renames
    assert Store(spark, str(tmp_path / "s")).records().count() == 1
    store.append(rows(dict(id="c", kind="semantic", text="three")))
    assert store.records().count() == 2


@pytest.fixture()
def service(spark, tmp_path):
    return MemoryService(spark, str(tmp_path / "m"), CFG, clock=lambda: NOW, branch="main")


def test_tools(spark, service):
    events = spark.createDataFrame([("s", "user/message", 1, 1, said("请记住这件事")), ("t", "user/message", 1, 1, said("hello"))], EVENT)
    tools = Tools(service, "s", "/w", events)
    made = tools.call("memory_write", kind="semantic", text="the build uses pnpm workspaces", branch=True)
    assert made["ok"] and made["status"] == "created" and made["branch"] == "main"
    record = service.store.records().first()
    assert record["origin"] == "user_explicit" and record["refs"][0]["via"] == "tool" and record["scope"]["level"] == "workspace" and record["branch"] == "main"
    assert tools.call("memory_write", kind="semantic", text="password: hunter22x") == {"ok": False, "error": "rejected_sensitive"}
    assert tools.call("memory_write", kind="odd", text="x")["error"] == "rejected_invalid"
    found = tools.call("memory_recall", query="pnpm build")
    assert found["total"] == 1 and found["items"][0]["refs"] == "s" and found["items"][0]["id"] == made["id"]
    assert service.store.with_usage().first()["useCount"] == 1
    asks = Tools(MemoryService(spark, service.store.path, CFG.with_(write_policy="ask"), lambda: NOW, "main"), "t", "/w", events)
    waits = asks.call("memory_write", kind="semantic", text="a guess of the model itself")
    assert waits["status"] == "pending" and "尚未生效" in waits["notice"]
    assert asks.call("memory_list", status="all")["total"] == 1
    assert asks.call("memory_forget", id=waits["id"])["error"] == "pending_requires_decision"
    assert asks.call("memory_stats")["pending"] == 1 and asks.call("memory_stats")["audit"]["pending"] == 1
    told = tools.call("memory_explain", text="Remember to build with pnpm workspaces.\n这只是一句普通的话而已。")
    assert told["candidates"][0]["signal"] == "explicit-imperative" and told["skipped"] == {"no-signal": 1} and told["matching"][0]["matchedTokens"] == ["build", "pnpm", "workspace"]
    applied = tools.call("memory_explain", text="记住：以后都用 pnpm 管理依赖。", apply=True)
    assert applied["written"][0]["status"] == "created"
    assert tools.call("memory_forget", query="build uses pnpm")["needsConfirm"]
    assert tools.call("memory_forget", query="build uses pnpm", confirm=True)["deleted"] == [made["id"]]
    assert tools.call("memory_maintain")["ok"] and tools.call("nothing") == {"ok": False, "error": "no such tool"}


def test_commands(spark, service, rows, tmp_path):
    service.store.append(rows(dict(id="aaa", kind="semantic", text="one fact"), dict(id="bbb", kind="semantic", text="waiting fact", status="pending", origin="model_proposed"), dict(id="ccc", kind="agent_self", subject="self.work.x", text="an observation", origin="model_proposed")))
    run = Commands(service).run
    state = lambda: {r["id"]: r["status"] for r in service.store.records().collect()}
    assert run("overview").count() == 3 and "approve" in run("help") and run("nonsense") == run("help") and len(run("help")) == 26
    assert [r["id"] for r in run("search fact").collect()] == ["aaa"]
    assert "bbb" in run("admin pending").first()[0]
    run("approve bbb")
    run("archive aaa")
    assert state() == {"aaa": "archived", "bbb": "active", "ccc": "active"}
    run("restore aaa")
    run("pin aaa")
    assert run("show aa").first()["pinned"]
    run("confirm ccc")
    run("refresh bbb")
    run("reject ccc")
    assert state()["ccc"] == "invalid" and service.store.rejected().count() == 1
    run(f"export {tmp_path / 'e'}")
    assert run("branch").first()[0].startswith("[记忆分支") and run("audit").first()[0].startswith("[记忆审计")
    assert run("list").count() == 2 and run("stats")["records"] == 3 and run("trace nothing").count() == 0
    with pytest.raises(LookupError):
        run("approve aaa")
    with pytest.raises(ValueError):
        run("clear", everything=True)
    run("clear", yes=True, everything=True)
    assert state() == {}
    assert {r["outcome"]: r["n"] for r in run(f"import {tmp_path / 'e'}").collect()} == {"imported": 3}
    assert run("consolidate") is True and service.consolidate(force=False) is False


def test_vectors_are_made_once(spark, service, rows):
    service.store.append(rows(dict(id="a", kind="semantic", text="alpha"), dict(id="b", kind="semantic", text="beta"), dict(id="c", kind="semantic", text="Alpha.")))
    q = spark.createDataFrame([("1", "beta")], "query_id string, query string")
    assert service.recall(q, "semantic").first()["fallback"] and service.last_recall()["fallback"] == "no-embedder"
    service.set_embedder(lambda t: t.select("id", F.when(F.col("text") == "beta", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.5))).alias("vector")))
    hits = service.recall(q, "semantic", limit=3).orderBy("rank").collect()
    assert [h["id"] for h in hits] == ["b", "a", "c"] and service.last_recall() == {"mode": "semantic", "used": True, "fallback": None, "candidates": 3, "vectors": 3}
    assert service.counters["embed_calls"] == 1 and service.counters["embed_misses"] == 2  # equal contents are one
    service.recall(q, "hybrid")
    assert service.counters["embed_calls"] == 1
    service.store.append(rows(dict(id="d", kind="semantic", text="delta")))
    service.set_embedder(lambda t: t.select("id", F.array(F.lit(float("nan"))).alias("vector")))
    assert service.recall(q, "semantic").first()["fallback"] and service.last_recall()["fallback"] == "embed-error"


def test_a_service_keeps_the_state_of_turns(spark, service, rows, tmp_path):
    service.store.append(rows(dict(id="a", kind="semantic", text="alpha beta gamma")))
    none = spark.createDataFrame([], "sessionId string, line string")
    first = service.turn(turn_of(spark, ("q", "s", 1, "alpha beta gamma", "*")), none)
    assert first.hits.count() == 1
    assert service.turn(turn_of(spark, ("q", "s", 2, "alpha beta gamma", "*")), none).hits.count() == 0
    assert service.turn(turn_of(spark, ("q", "s", 4, "alpha beta gamma", "*")), none).hits.count() == 1
    assert service.store.with_usage().first()["useCount"] == 2 and service.store.mark("selfIntroAsks") == 1
    assert service.write_report(str(tmp_path / "r")) and not service.write_report(str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0])["records"] == 1


def test_vectors_can_reorder_a_turn(spark, rows, tmp_path):
    service = MemoryService(spark, str(tmp_path / "m"), CFG.with_(embedder_recall_mode="recall", recall_top_k=1), clock=lambda: NOW)
    service.store.append(rows(dict(id="a", kind="semantic", text="alpha beta gamma", importance=0.9), dict(id="b", kind="semantic", text="alpha beta delta", importance=0.1)))
    none = spark.createDataFrame([], "sessionId string, line string")
    ask = lambda s: turn_of(spark, ("q", s, 1, "alpha beta words", "*"))
    assert [h["id"] for h in service.turn(ask("s1"), none).hits.collect()] == ["a"]
    service.set_embedder(lambda t: t.select("id", F.when(F.contains("text", F.lit("gamma")), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("vector")))
    assert [h["id"] for h in service.turn(ask("s2"), none).hits.collect()] == ["b"] and service.last_recall()["used"]


def test_compaction_summaries_are_solidified(spark, service):
    data = json.dumps({"summary": [{"type": "text", "text": "The team chose Spark for all jobs.\nshort\nThe second long sentence stands here."}], "shadowedSeqs": [3, 9, 5]})
    service.solidify(spark.createDataFrame([("s", "compaction/summary", 12, 1, data)], EVENT))
    got = {(r["text"], r["kind"], r["refs"][0]["from"], r["refs"][0]["to"], r["refs"][0]["via"]) for r in service.store.records().collect()}
    assert got == {("The team chose Spark for all jobs.", "episodic", 3, 9, "solidify"), ("The second long sentence stands here.", "episodic", 3, 9, "solidify")}


def test_events_are_noted_and_faults_end_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [("s", "turn/start", 1, 10, None), ("s", "user/message", 2, 20, None), ("t", "user/message", 7, None, None)] + [("u", "user/message", i, 100 + i, None) for i in range(40)]
    e = spark.createDataFrame(rows, EVENT)
    e.write.parquet(str(tmp_path / "in"))
    assert streams.observe(store, spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination(120)
    streams.observe_batch(store, e, 0)  # comes again
    streams.observe_batch(store, spark.createDataFrame([("s", "turn/start", 9, 500, None)], EVENT), 1)
    seen = {r["sessionId"]: (r["last_seq"], r["turn_start"]) for r in store.table("seen", streams.SEEN).collect()}
    assert seen == {"s": (9, 9), "t": (7, None), "u": (39, None)}
    recent = store.table("recent", "sessionId string, type string, seq bigint, time bigint")
    assert recent.count() == streams.RECENT and recent.where("time = 500").count() == 1
    streams.observe_batch(store, e.select("sessionId"), 2)  # no such columns
    assert store.table("faults", "stream string, batch bigint, fault string").first()["batch"] == 2 and store.mark("observed:events") == 3
