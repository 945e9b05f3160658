"""The facade end to end on a small store."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recollect.engine import Memory, NotFound, parse_tool
from recollect.settings import Settings
from recollect.sources import brain, embedding, files, http, sinks
from recollect.streaming import feeds


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    m = Memory(spark, str(tmp_path_factory.mktemp("store")), embedding.HashingEmbedder(64), buckets=2,
               settings=Settings(embed_dimensions=64))
    m.add_batch(spark.createDataFrame([
        ("Team A", "s1", "user", "Alice prefers concise bullet points over paragraphs."),
        ("Team A", "s1", "assistant", "Noted, I will answer Alice with concise bullet points."),
        ("Team A", "s2", "user", "Carol owns the payments service."),
        ("Team A", "s2", "user", "Carol owns the payments service."),
        ("_global", "g", "system", "The office is in Lisbon."),
        ("finance", "f", "user", "Salary list of Alice."),
        ("Team A", "s2", "robot", "bad role")],
        "workspace_id STRING, session_id STRING, role STRING, content STRING"))
    return m


def texts(df):
    return [r["document"] for r in df.collect()]


def test_batch_is_deduplicated_and_validated(memory):
    assert memory.messages("team-a").count() == 3
    assert {r["workspace_id"] for r in memory.workspaces().collect()} == {"team_a", "_global", "finance"}


def test_search_scopes(memory):
    found = texts(memory.search_workspace("team_a", "Where is the office in Lisbon", 10))
    assert "The office is in Lisbon." in found and "Salary list of Alice." not in found
    everywhere = texts(memory.search_all("Alice", 10))
    assert everywhere and "Salary list of Alice." not in everywhere
    assert "Salary list of Alice." in texts(memory.search_workspace("finance", "Alice", 10))
    hit = memory.search("Alice bullet points", "team_a", hybrid=True).orderBy("rank").first()
    assert "bullet points" in hit["document"] and hit["source"] == "hybrid"


def test_update_delete_expire(memory, spark):
    first = memory.add_message("upd", "s", "user", "one two " * 1500)
    assert memory.message("upd", first).count() == 2
    memory.update_message("upd", first, content="intro\n## A\nx\n")
    assert texts(memory.message("upd", first)) == ["intro\n## A\nx\n"]
    memory.update_message("upd", first, sections={"a": "y"})
    assert texts(memory.message("upd", first)) == ["intro\n## A\ny\n"]
    with pytest.raises(NotFound):
        memory.update_message("upd", "nobody", content="x")
    memory.queue_updates(spark.createDataFrame([(first, "upd", "late"), ("ghost", "upd", "x")],
                                               "message_id STRING, workspace_id STRING, content STRING"))
    assert memory.drain() == {"applied": 1, "requeued": 1, "failed": 0}
    assert texts(memory.message("upd", first)) == ["late"]
    assert memory.expire("upd", "2000-01-01T00:00:00Z") == 0
    assert memory.delete_message("upd", first) == 1 and memory.messages("upd").count() == 0


def test_conclusions_and_trace(memory):
    made = memory.create_conclusion("team_a", "alice", "Alice likes bullets.")
    memory.add_reasoning("team_a", "alice", made, ["c0"], ["m0"])
    assert {r["id"] for r in memory.trace("team_a", made).collect()} == {"c0", "m0"}
    assert [r["id"] for r in memory.trace("team_a", "c0", reverse=True).collect()] == [made]
    assert memory.reasoning_chain("team_a", made).count() == 1
    assert memory.representation("team_a") == "- Alice likes bullets."
    assert memory.query_conclusions("team_a", "Alice likes bullets.", 3).first()["id"] == made
    row = memory.brief("team_a").first()
    assert (row["document_count"], row["conclusion_count"]) == (3, 1)
    memory.delete_conclusion("team_a", made)
    assert memory.conclusions("team_a").count() == 0


def test_ask_and_chat(memory):
    assert memory.ask("Who owns the payments service?", "team_a") == "Carol owns the payments service."
    with pytest.raises(NotFound):
        memory.ask("zzz qqq", "finance")
    assert "Carol" in memory.chat("team_a", "Who owns the payments service?")["answer"]
    assert memory.summarize("First fact. Second fact.") == "First fact.\nSecond fact."


def test_scopes_and_peers(memory):
    memory.create_scope("team_a", "main", ["s1"])
    memory.add_to_scope("team_a", "main", ["s2", "s1"])
    assert memory.scopes("team_a", "main").first()["sessions"] == ["s1", "s2"]
    assert memory.scope_messages("team_a", "main").count() == 3
    memory.remove_from_scope("team_a", "main", "s1")
    assert memory.scopes("team_a", "main").first()["sessions"] == ["s2"]
    memory.set_peer_card("team_a", "alice", ["likes tea"])
    assert memory.peer_card("team_a", "alice") == ["likes tea"] and memory.peer_card("team_a", "bob") == []
    key = memory.create_key("team_a")
    assert [r["id"] for r in memory.keys("team_a").collect()] == [key]


def test_claim_restricts_a_caller(memory, spark):
    limited = Memory(spark, memory.tables.root, memory.embedder, buckets=2, only_workspace="team_a")
    with pytest.raises(PermissionError):
        limited.messages("finance")
    assert {r["workspace_id"] for r in limited.workspaces().collect()} == {"team_a", "_global"}


def test_context_and_observation(memory):
    context = memory.session_context("team_a", "s1", 1000)
    assert texts(context["messages"])[0].startswith(("Alice", "Noted")) and context["total_tokens"] > 0
    target = memory.messages("team_a", "s1").first()["message_id"]
    assert memory.observation_context("team_a", "s1", target).count() == 2


def test_vault_and_code(memory, tmp_path):
    notes = tmp_path / "notes"
    (notes / "_shared").mkdir(parents=True)
    (notes / "00-index").mkdir()
    (notes / "a.md").write_text("# Title\nbody about Kafka\n")
    (notes / "_shared" / "b.md").write_text("plain\n")
    (notes / "00-index" / "c.md").write_text("hidden\n")
    registry = memory.index_vault("vault", str(notes), ["Kafka"])
    assert sorted(r["path"] for r in registry.collect()) == ["_shared/b.md", "a.md"]
    row = memory.messages("vault").where("source_path = 'a.md'").first()
    assert row["entities"] == ["Kafka", "Title"] and row["document"] == "# Title\nbody about Kafka\n"
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "node_modules" / "x.js").write_text("function skipped() {}\n")
    (src / ".gitignore").write_text("secret.py\n")
    (src / "secret.py").write_text("def hidden():\n    pass\n")
    (src / "__init__.py").write_text("def helper():\n    return 1\n")
    (src / "main.py").write_text("import os\n\ndef run():\n    return helper()\n")
    (src / "a.bin").write_text("x")
    report = memory.index_code("code", str(src)).first()
    assert (report["files_indexed"], report["symbols"], report["files_skipped_unchanged"]) == (2, 2, 0)
    assert [r["caller"] for r in memory.callers("code", "helper").collect()] == ["run"]
    assert memory.index_code("code", str(src)).first()["files_skipped_unchanged"] == 2
    assert {r["file"]: r["symbols"] for r in memory.symbols("code").collect()} == {"__init__.py": ["helper"], "main.py": ["run"]}
    with pytest.raises(ValueError):
        memory.index_code("code", str(src), [str(notes)])
    (src / "__init__.py").unlink()
    (src / "main.py").write_text("import os\n\ndef run():\n    return fresh()\n")
    (src / "new.py").write_text("def fresh():\n    return run()\n")
    assert memory.index_code("code", str(src)).first()["edges"] == 3
    assert memory.callers("code", "helper").count() == 0
    assert [r["caller"] for r in memory.callers("code", "fresh").collect()] == ["run"]
    assert {r["path"] for r in memory.tables.read("code_files").collect()} == {"main.py", "new.py"}


def test_recall(memory, spark):
    facts = spark.createDataFrame([
        ("eval_ws", "s1", "user", "Dana keeps the release calendar and moves it on Fridays."),
        ("eval_ws", "s2", "user", "The staging cluster runs in Frankfurt with nine nodes."),
        ("eval_ws", "s3", "user", "Backups are tested on the first Monday of each month.")],
        "workspace_id STRING, session_id STRING, role STRING, content STRING")
    queries = spark.createDataFrame([
        ("eval_ws", "Who keeps the release calendar?", "dana"), ("eval_ws", "Where does the staging cluster run?", "Frankfurt"),
        ("eval_ws", "When are backups tested on Monday?", "Monday")], "workspace_id STRING, query STRING, expected STRING")
    assert memory.evaluate(facts, queries) >= 0.8


def test_backup_export_import(memory, spark, tmp_path):
    files.backup(memory.tables, str(tmp_path / "copy"))
    assert {r["status"] for r in files.verify_backup(memory.tables, str(tmp_path / "copy")).collect()} == {"equal"}
    assert files.backup_differences(memory.tables, str(tmp_path / "copy"), "chunks").count() == 0
    copy = memory.spark.read.parquet(str(tmp_path / "copy" / "chunks"))
    hurt = copy.limit(1).select("id").first()["id"]
    copy.withColumn("document", F.when(F.col("id") == hurt, F.concat("document", F.lit("!"))).otherwise(F.col("document"))).write.parquet(
        str(tmp_path / "hurt" / "chunks"))
    found = files.backup_differences(memory.tables, str(tmp_path / "hurt"), "chunks").collect()
    assert [(r["id"], r["status"]) for r in found] == [(hurt, "changed")]
    files.export_workspace(memory.tables.read("chunks"), "team_a", str(tmp_path / "out"))
    again = files.import_workspace(spark, str(tmp_path / "out"), "moved")
    memory.add_batch(again)
    assert sorted(texts(memory.messages("moved"))) == sorted(texts(memory.messages("team_a")))
    memory.delete_workspace("moved")
    assert memory.messages("moved").count() == 0 and memory.messages("team_a").count() == 3


def test_derive_stream_and_session_files(memory, spark, tmp_path):
    feed = tmp_path / "feed"
    rows = spark.createDataFrame([
        ("m1", "team_a", "s1", "user", "Bob likes tea.", "bob"), ("m2", "team_a", "s1", "user", "Bob codes in Go.", "bob")],
        "message_id STRING, workspace_id STRING, session_id STRING, role STRING, content STRING, peer_id STRING"
    ).withColumn("created_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(feed))
    stream = lambda: feeds.parquet_stream(spark, str(feed), rows.schema)
    memory.start_deriver(stream(), str(tmp_path / "ck1"), availableNow=True).awaitTermination()
    made = {r["document"] for r in memory.conclusions("team_a").where("source = 'deriver'").collect()}
    assert made == {"Bob likes tea.", "Bob codes in Go."}
    vault = tmp_path / "vault"
    for run in ("ck2", "ck3"):
        feeds.start_writeback(stream(), str(vault), str(tmp_path / run), availableNow=True).awaitTermination()
    written = (vault / "_shared/knowledge/team_a/vault/10-memory/sessions/s1.md").read_text()
    assert written.count("Bob likes tea.") == 1 and written.count("# Session s1") == 1


def test_ingest_stream_and_compaction(memory, spark, tmp_path):
    rows = spark.createDataFrame([("in", "s", "user", f"streamed fact {i % 5}") for i in range(10)],
                                 "workspace_id STRING, session_id STRING, role STRING, content STRING")
    rows.write.parquet(str(tmp_path / "feed"))
    for run in ("a", "b"):
        memory.start_ingest(feeds.parquet_stream(spark, str(tmp_path / "feed"), rows.schema), str(tmp_path / run),
                            availableNow=True).awaitTermination()
    assert memory.messages("in").count() == 5
    memory.add_message("in", "s", "user", "one more")
    memory.tables.compact("chunks")
    assert memory.messages("in").count() == 6 and memory.messages("team_a").count() == 3


def test_requests_become_usage(memory, spark):
    before = memory.tables.read("usage").count()
    memory.record_requests(spark.createDataFrame(
        [("POST", "/api/v1/messages"), ("GET", "/health"), ("GET", "/api/v1/keys")], "method STRING, path STRING").withColumns({
            "ts": F.lit("2020-01-01 00:00:00").cast("timestamp"), "source": F.lit("mcp"), "agent": F.lit("a"), "workspace": F.lit("w")}))
    assert memory.tables.read("usage").count() == before + 1


def test_usage(memory, spark):
    memory.record_usage(spark.createDataFrame([("search", "mcp", "Bot 1", "w"), ("", "mcp", "x", "w"), ("odd", "", "", "")],
                                              "action STRING, source STRING, agent STRING, workspace STRING"
                                              ).withColumn("ts", F.current_timestamp()))
    today = memory.usage_daily(3).orderBy(F.col("day").desc()).first()
    assert (today["searches"], today["other"], today["total"]) == (1, 1, 2)


def test_http_retries():
    waits, replies = [], [(503, {}, ""), (429, {"Retry-After": "7"}, ""), (200, {}, '{"ok": 1}')]
    send = lambda *_: replies.pop(0)
    assert http.post_json("http://x", {}, send=send, sleep=waits.append) == {"ok": 1}
    assert waits[0] == 2.0 and 7.0 in waits
    with pytest.raises(RuntimeError):
        http.post_json("http://x", {}, send=lambda *_: (400, {}, "no"), sleep=waits.append)
    assert http.parse_retry_after("soon") == 0 and http.next_delay(40, jitter=lambda: 1.0) == 75.0


def test_providers():
    reply = '{"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}'
    model = embedding.OpenAICompatibleEmbedder("http://x", "m", 1)
    assert model.embed(["a", "b"], send=lambda *_: (200, {}, reply)) == [[1], [2]]
    google = embedding.GoogleEmbedder("k", dimensions=1)
    assert google.embed(["a"], send=lambda *_: (200, {}, '{"embeddings": [{"values": [3]}]}')) == [[3]]
    assert brain.bounded_max_tokens(0) == 768 and brain.bounded_max_tokens(100) == 384 and brain.bounded_max_tokens(2000) == 1000
    assert brain.valid_order([1, 0], 2) and not brain.valid_order([0, 0], 2) and not brain.valid_order([0], 2)
    assert parse_tool('x {"tool": "grep_messages", "args": {"q": 1}} y') == ("grep_messages", {"q": 1})
    assert parse_tool("none") == ("", {})


def test_remote_texts_are_sent_once(spark):
    class Counting(embedding.HashingEmbedder):
        remote = True

        def embed(self, batch):
            assert len(set(batch)) == len(batch)
            return super().embed(batch)

    rows = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "id INT, document STRING")
    assert embedding.embed_rows(rows, Counting(8), inflight=1).where("size(embedding) = 8").count() == 30


def test_webhook_guard():
    sinks.check_endpoint("https://example.org/x", lambda host: ["93.184.216.34"])
    for url, addresses in [("ftp://example.org", ["93.184.216.34"]), ("http://a", ["127.0.0.1"]), ("http://a", ["10.0.0.1"]),
                           ("http://a", []), ("nothing", ["93.184.216.34"]), ("http://a", ["169.254.169.254"])]:
        with pytest.raises(ValueError):
            sinks.check_endpoint(url, lambda host, found=addresses: found)


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "type": "doc", "label": "A"}], '
                                     '"edges": [{"from": "a", "to": "b", "relation": "r", "weight": 0.8}]}')
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.json"))
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    again = files.read_graph(spark, str(tmp_path / "g"))
    assert again[0].collect() == nodes.collect() and again[1].select("from", "to", "weight").collect() == [("a", "b", 0.8)]
    assert files.ignored_names("a/\n# c\n*.x\nd/e\n b \n") == {"a", "b"}


def test_usage_log_and_eval_file(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"ts":"2026-01-01T00:00:00Z","action":"search"}\nbroken\n{"action":"x"}\n')
    assert files.usage_log(spark, str(tmp_path / "u.jsonl")).count() == 1
    (tmp_path / "e.jsonl").write_text('{"workspace_id":"w","content":"c"}\n{"workspace_id":"w","query":"q","expected":"e"}\n')
    facts, asked = files.eval_records(spark, str(tmp_path / "e.jsonl"))
    assert facts.count() == 1 and asked.first()["query"] == "q"
