"""K3, K5: language-model hooks. The default one works offline on the text it is given."""

from __future__ import annotations

import json
import re
from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.identifiers import query_terms
from recollect.functions.text import csv_list
from recollect.sources.http import post_json

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")


def bounded_max_tokens(max_chars: int) -> int:
    """H40."""
    return max(384, max_chars // 2) if max_chars > 0 else 768


class Brain(ABC):
    @abstractmethod
    def chat(self, messages: list[dict], temperature: float = 0.3, max_chars: int = 0) -> str: ...

    def summarize(self, text: str, max_chars: int = 500) -> str:
        return self.chat([
            {"role": "system", "content": f"Summarise in at most {max_chars} characters, one fact per line."},
            {"role": "user", "content": text}], 0.3, max_chars)

    def ask(self, question: str, context: str = "") -> str:
        return self.chat([
            {"role": "system", "content": "Answer from the context only."},
            {"role": "user", "content": f"Context:\n{context}\n\nQuestion: {question}"}])


class ExtractiveBrain(Brain):
    """Deterministic: whole sentences of the input, no generation."""

    def summarize(self, text: str, max_chars: int = 500) -> str:
        lines, used = [], 0
        for sentence in (s.strip() for s in _SENTENCE.findall(text)):
            if sentence and used + len(sentence) <= max_chars:
                lines.append(sentence)
                used += len(sentence) + 1
        return "\n".join(lines[:3])

    def ask(self, question: str, context: str = "") -> str:
        terms = set(query_terms(question))
        sentences = [s.strip() for s in _SENTENCE.findall(context) if s.strip()]
        overlap = lambda s: len(terms & set(query_terms(s)))
        return max(sentences, key=overlap, default="")

    def chat(self, messages: list[dict], temperature: float = 0.3, max_chars: int = 0) -> str:
        last = messages[-1]["content"]
        context, _, question = last.rpartition("\n\nQuestion: ")
        return self.ask(question, context.removeprefix("Context:\n"))


class ChatBrain(Brain):
    """An OpenAI-compatible chat endpoint."""

    def __init__(self, url: str, model: str, key: str = ""):
        self.url, self.model, self.key = url.rstrip("/"), model, key

    def chat(self, messages: list[dict], temperature: float = 0.3, max_chars: int = 0, send=None) -> str:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        reply = post_json(f"{self.url}/chat/completions", {
            "model": self.model, "messages": messages, "temperature": temperature,
            "max_tokens": bounded_max_tokens(max_chars)}, headers, send=send)
        return reply["choices"][0]["message"]["content"].strip()


def _json_reply(reply: str) -> dict:
    body = re.sub(r"^```(json)?|```$", "", reply.strip()).strip()
    try:
        found = json.loads(body)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def tag(brain: Brain, header_path: str, text: str) -> dict[str, str]:
    """K5: tags, summary and entities of a chunk as the model names them; a broken reply still
    gives its tags."""
    reply = brain.chat([{"role": "user", "content":
                         f"Tag this chunk as JSON with tags, summary, entities.\nHeader: {header_path}\n{text}"}], 0.2)
    found = _json_reply(reply)
    if not found:
        loose = re.search(r'"tags"[^:]*:[^"]*"([^"]*)"', reply)
        found = {"tags": loose[1] if loose else ""}
    items = lambda k: [x.strip() for x in str(found.get(k, "")).split(",") if x.strip()]
    return {"tags": ",".join(t.lower().replace(" ", "-") for t in items("tags")),
            "summary": str(found.get("summary", "")).strip(), "entities": ",".join(items("entities"))}


def tagged(rows: DataFrame, brain: Brain) -> DataFrame:
    """K5 on chunk rows: tags, entities and a summary line from the model where a row has none, in Arrow batches."""
    def ask(headers: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tag(brain, h, t) for h, t in zip(headers, texts)], columns=["tags", "summary", "entities"])

    ask.__annotations__ = {"headers": pd.Series, "texts": pd.Series, "return": pd.DataFrame}
    told = F.pandas_udf(ask, "tags string, summary string, entities string")(
        F.coalesce("header_path", F.lit("")), F.coalesce("document", F.lit("")))
    return rows.withColumn("_told", told).withColumns({
        "tags": F.coalesce("tags", csv_list(F.col("_told.tags"))),
        "entities": F.coalesce("entities", csv_list(F.col("_told.entities"))),
        "summary_1line": F.coalesce("summary_1line", F.nullif(F.col("_told.summary"), F.lit("")))}).drop("_told")


def valid_order(order: list, size: int) -> bool:
    """A permutation of the hit positions."""
    return sorted(order) == list(range(size)) if all(isinstance(i, int) for i in order) else False


def reorder(brain: Brain, query: str, hits: list[dict]) -> list[dict]:
    """K5: the model's order of a hit list, or the given order when its reply is unusable."""
    shown = "\n".join(f"{i}: [{h.get('header_path') or ''}] tags={','.join(h.get('tags') or [])} "
                      f"snippet={h['document'][:300]}" for i, h in enumerate(hits))
    order = _json_reply(brain.chat([{"role": "user", "content":
                                     f'Query: {query}\n{shown}\nReply as JSON {{"order": [...]}}'}], 0.2)).get("order", [])
    return [hits[i] for i in order] if isinstance(order, list) and valid_order(order, len(hits)) else hits
