"""Formulas on small texts, against hand-made values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import code, markdown
from recollect.functions import text as tx
from recollect.functions.identifiers import lex_tokens, query_terms, split_identifier


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def each(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r["x"] for r in rows.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_identifiers():
    assert split_identifier("GetMessageChunks") == ["get", "message", "chunks"]
    assert split_identifier("RAG_MIN_SCORE") == ["rag", "min", "score"]
    assert split_identifier("utf8Decoder") == ["utf8", "decoder"]
    assert split_identifier("sha256sum") == ["sha256", "sum"]
    assert split_identifier("RAGMin") == ["rag", "min"]
    assert split_identifier("vec-test-bin") == ["vec", "test", "bin"]


def test_query_tokens():
    assert lex_tokens("GetMessageChunks") == ["getmessagechunks"]
    assert lex_tokens("GetMessageChunks", keep_case=True) == ["getmessagechunks", "get", "message", "chunks"]
    assert lex_tokens("RAG_MIN_SCORE") == ["rag_min_score", "rag", "min", "score"]
    assert lex_tokens("hello123") == ["hello123", "hello", "123"]
    assert query_terms("a the the x1") == ["the", "x1"]


def test_workspace_names(spark):
    names = ["Pilot V4", "pilot-v4", "!!!", "_global", "  Foo  "]
    assert each(spark, tx.canonical_workspace, names) == ["pilot_v4", "pilot_v4", "default", "global", "foo"]
    uuid = "fce1f490-0000-4000-8000-00000000abcd"
    assert each(spark, tx.resolve_workspace, [uuid, "PilotV4", ""]) == [uuid, "pilotv4", "default"]
    again = each(spark, tx.canonical_workspace, each(spark, tx.canonical_workspace, names))
    assert again == each(spark, tx.canonical_workspace, names)


def test_token_estimate(spark):
    assert each(spark, tx.token_estimate, ["", "a", "abcd", "abcde", "é"]) == [0, 1, 1, 2, 1]


@pytest.mark.parametrize("source, sizes", [
    ("a " * 5000, [5999, 4000]), ("x" * 13000, [6000, 6000, 1000]), ("é" * 3500, [3500]),
    ("ab " * 4000, [5999, 6000]), ("", [0]), ("é" * 3000, [3000]),
])
def test_plain_chunks(spark, source, sizes):
    parts = each(spark, tx.chunk_plain, [source])[0]
    assert [len(p) for p in parts] == sizes


def reference_chunks(text, size):
    """The rule of H17 told once more, character by character."""
    if len(text.encode()) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        window = text[at:at + size]
        if at + size >= len(text):
            return [*out, window]
        blank = window.rfind(" ")
        if blank > 0 and len(window[:blank].encode()) > size // 2:
            out.append(window[:blank])
            at += blank + 1
        else:
            out.append(window)
            at += size
    return out


def test_plain_chunks_at_random(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab é€\n   ") for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    got = each(spark, lambda c: tx.chunk_plain(c, 64), texts)
    assert got == [reference_chunks(t, 64) for t in texts]


def test_splice():
    doc = "p\n## A\nx\n\n## B\ny\n"
    out, changed, same = markdown.splice_sections(doc, {" a ": "z"})
    assert (out, changed, same) == ("p\n## A\nz\n\n## B\ny\n", [True, False], False)
    assert markdown.splice_sections(out, {" a ": "z"}) == (out, [False, False], True)
    grown, _, _ = markdown.splice_sections(doc, {"C": "new", "b ##": "w"})
    assert grown == "p\n## A\nx\n\n## B\nw\n## C\nnew\n"
    assert markdown.splice_sections("plain", {"x": "other"})[0] == "other"
    assert markdown.splice_sections("plain", {"x": "1", "y": "2"}) == ("plain", [], True)


def test_markdown_chunks():
    doc = "intro\n# A\none\n```\n# no header\n```\n### C\nthree\n## B\ntwo\n"
    assert markdown.chunk_markdown(doc) == [
        ("", "prose", "intro\n"), ("A", "section_h1", "one\n```\n# no header\n```\n"),
        ("A/C", "section_h2", "three\n"), ("A/B", "section_h2", "two\n")]
    assert markdown.chunk_markdown("") == [("", "prose", "")]
    long = "word " * 2000
    pieces = [b for _, _, b in markdown.chunk_markdown(long)]
    assert all(len(p) <= 4800 for p in pieces) and pieces[0][-200:] == pieces[1][:200]


GO = '''package store

import (
	"fmt"
	"strings"
)

// UpdateMessage changes one.
func (s *Store) UpdateMessage(id string) error {
	if id == "" { return nil }
	getMessageChunks(id)
	return nil
}

func getMessageChunks(id string) {}

type Config struct {
	A int
}
'''


def test_go_symbols():
    found = code.find_symbols(GO, "go")
    assert [(s.kind, s.name) for s in found] == [
        ("func", "UpdateMessage"), ("func", "getMessageChunks"), ("type", "Config")]
    assert code.find_imports(GO, "go") == ["fmt", "strings"]
    assert found[0].doc == "// UpdateMessage changes one." and found[0].body.endswith("}")


def test_code_chunks():
    kinds = [k for k, _, _ in code.chunk_file("a.go", GO)]
    assert kinds == ["file_overview", "symbol"]
    text = "a: 1\n" * 900
    parts = code.chunk_file("deploy/a.yml", text)
    assert {k for k, _, _ in parts} == {"text"} and parts[0][1] == ["a.yml"]
    assert "".join(d for _, _, d in parts) == text
    assert code.chunk_file("a.bin", "x") == [] and code.chunk_file("a.md", "  ") == []


@pytest.mark.parametrize("source", ["a\nbb\n\nccc", "x" * 5000 + "\n" + "y", "", "\n\n"])
def test_split_is_lossless(source):
    assert "".join(code.split_text(source, 4)) == source


def test_code_tokens(spark):
    got = each(spark, tx.code_tokens, ["callGetMessageChunks(my_var, x1)"])[0]
    assert got == ["call", "get", "message", "chunks", "callgetmessagechunks", "my_var", "myvar"]


def test_small_columns(spark):
    assert each(spark, tx.to_number, ["3", "2.5x", "x", None]) == [3.0, 2.5, 0.0, 0.0]
    assert [t is not None for t in each(spark, tx.parse_time, ["2026-01-01T00:00:00Z", "2026-01-01", "x"])] == [
        True, False, False]
    assert each(spark, lambda c: tx.preview(c, 3), ["abc", "abcd", "aaé"]) == ["abc", "abc…", "aa�…"]
    assert each(spark, lambda c: tx.sanitize_agent(c, F.lit("mcp")), [" Ab C!", "", "x" * 40]) == [
        "abc", "mcp", "x" * 32]
    assert each(spark, tx.json_reply, ['```json\n{"a":1}\n```', '{"a":1}']) == ['{"a":1}', '{"a":1}']
    assert each(spark, lambda c: tx.json_field(c, "tags"), ['{"tags": "a,b"}', 'broken "tags": "c", ', "none"]) == [
        "a,b", "c", ""]
    call = each(spark, tx.tool_call, ['I use {"tool":"grep","args":{"q":"x"}} now', "no"])
    assert call[0]["tool"] == "grep" and call[0]["args"] == {"q": "x"} and call[1] is None
    assert each(spark, tx.session_file_name, ["a/b", "..", "x" * 200])[0] == "a_b"
    assert each(spark, lambda c: F.array_join(tx.normal_tags(tx.csv_list(c)), ","), ["A b, ,C"]) == ["a-b,c"]
    title = lambda names, kind: one(spark, tx.chunk_title(F.lit(kind), F.array(*[F.lit(n) for n in names]).cast("array<string>")))  # noqa: E731,E501
    assert title(["a", "b", "c", "d", "e"], "symbol") == "a, b, c (+2)"
    assert title([], "text") == "Content" and title(["a"], "file_overview") == "Overview"
