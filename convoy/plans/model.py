"""The boundary to a text model: a pure function of prompt and text, called in Arrow
batches, with retries, usage rows and stored results."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import retry_delay
from ..functions.text import DEFAULT_CATEGORY, KEYWORD_RULES
from ..operators.cache import cache_key
from ..sources.store import ResultStore

PROMPTS = {
    "map": "Describe the recurring subjects of these tickets.",
    "combine": "Join these descriptions into one.",
    "compress": "Shorten this analysis and keep every subject.",
    "classify": "Name up to three categories for each ticket, as JSON {\"categories\": [...], \"confidence\": x}.",
    "classify_batch": "Name up to three categories for each of these tickets, as JSON {\"cat\": [{\"id\": ..., \"cat\": [...]}]}.",
    "summarise": "Give fifteen bullets and a summary, as JSON {\"bullets\": [{\"bullet\": ...}], \"resumo\": ...}.",
    "extract": "Give the taxonomy as JSON.",
}


class Model(Protocol):
    name: str

    def __call__(self, prompt: str, text: str) -> str: ...


class KeywordModel:
    """A deterministic model: the keyword rules, in the form that each prompt asks for. The
    descriptions that it makes are lists of category names, a line each."""

    name = "keywords"

    def __call__(self, prompt: str, text: str) -> str:
        low = (text or "").lower()
        hits = [i for i, (_, words) in enumerate(KEYWORD_RULES) if any(w in low for w in words)]
        kind = next((k for k in ("map", "combine", "compress", "classify_batch", "summarise", "extract") if prompt.startswith(PROMPTS[k])), "classify")
        if kind == "map":
            return "\n".join(KEYWORD_RULES[i][0] for i in hits) or DEFAULT_CATEGORY
        if kind == "classify_batch":
            return json.dumps({"cat": [{"id": i, "cat": self._names(t)[:3]} for i, t in self._blocks(text or "")]}, ensure_ascii=False)
        if kind in ("combine", "compress", "extract", "summarise"):
            lines = {line.strip() for line in (text or "").splitlines()}
            found = [(n, words) for n, words in KEYWORD_RULES if n in lines]
            if kind == "extract":
                return json.dumps({"version": "1.0", "categories": [self._category(i + 1, n, words) for i, (n, words) in enumerate(found)]}, ensure_ascii=False)
            if kind == "summarise":
                every = [n for n, _ in KEYWORD_RULES] + [DEFAULT_CATEGORY]
                bullets = [n for n, _ in found] + [n for n in every if n not in lines]
                return json.dumps({"bullets": [{"bullet": b} for b in (bullets * 2)[:15]], "resumo": "; ".join(n for n, _ in found) or DEFAULT_CATEGORY}, ensure_ascii=False)
            return "\n".join(n for n, _ in found) or DEFAULT_CATEGORY
        known = {n: int(i) for i, n in re.findall(r"(?m)^(\d+)\. (.+?): ", prompt)}  # the taxonomy's lines, if there are any
        ids = [known[KEYWORD_RULES[i][0]] for i in hits if KEYWORD_RULES[i][0] in known] if known else [i + 1 for i in hits]
        names = [KEYWORD_RULES[i][0] for i in hits][:3] or [DEFAULT_CATEGORY]
        return json.dumps({"categories": ids[:3], "confidence": 0.9 if ids else 0.5, "names": "; ".join(names)}, ensure_ascii=False)

    @staticmethod
    def _names(text: str) -> list[str]:
        low = text.lower()
        return [n for n, words in KEYWORD_RULES if any(w in low for w in words)] or [DEFAULT_CATEGORY]

    @staticmethod
    def _blocks(text: str) -> list[tuple[str, str]]:
        parts = re.split(r"(?m)^Ticket (.+?):\n", text)
        return list(zip(parts[1::2], parts[2::2]))

    @staticmethod
    def _category(number: int, name: str, words: list[str]) -> dict:
        technical = re.sub(r"[^a-z0-9]+", "_", name.lower())
        return {"id": number, "technical_name": technical, "display_name": name, "description": f"Tickets: {name}", "keywords": words, "examples": words[:2], "subcategories": []}


class CallableModel:
    """Any function of prompt and text, made on the executor by `build`."""

    def __init__(self, name: str, build: Callable[[], Callable[[str, str], str]]):
        self.name, self.build, self._call = name, build, None

    def __call__(self, prompt: str, text: str) -> str:
        self._call = self._call or self.build()
        return self._call(prompt, text)

    def __getstate__(self):
        return {"name": self.name, "build": self.build, "_call": None}


def with_retry(call: Callable[[], str], attempts: int = 4, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """Result and error; one of them is None."""
    for n in range(attempts):
        try:
            return call(), None
        except Exception as e:  # a bad row must not fail its task
            error = f"{type(e).__name__}: {e}"
            fatal = isinstance(e, ValueError | TypeError)
            if fatal or n == attempts - 1:
                return None, error
            sleep(retry_delay(n, base))
    return None, "no attempt"


def apply_model(df: DataFrame, model: Model, prompt: str, key: str, text_col: str, attempts: int = 4) -> DataFrame:
    """key, result, error, tokens_in, tokens_out: a row for each row, failed ones too."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [with_retry(lambda t=t: model(prompt, t), attempts) for t in pdf["text"]]
            used = [len(t or "") // 4 + len(prompt) // 4 for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "result": [g[0] for g in got], "error": [g[1] for g in got], "tokens_in": used, "tokens_out": [len(g[0] or "") // 4 for g in got]})

    rows = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, result string, error string, tokens_in long, tokens_out long").withColumnRenamed("key", key)


STORED = "key string, result string, tokens_in long, tokens_out long"


def apply_cached(df: DataFrame, model: Model, prompt: str, text_col: str, cache_path: str, buckets: int = 64) -> DataFrame:
    """Results by the hash of text, model and prompt: what the store at `cache_path` (which
    begins with so many buckets) holds is read,
    the rest is computed once for each text and stored, and results are read back, so that
    a repeated task never calls the model for a stored text. Failed calls aren't stored."""
    store = ResultStore(df.sparkSession, cache_path, STORED, buckets)
    store.compact()
    keyed = df.withColumn("key", cache_key(F.coalesce(F.col(text_col), F.lit("")), f"{model.name}:{prompt}"))
    misses = keyed.select("key", text_col).dropDuplicates(["key"]).join(store.get(keyed).select("key"), "key", "left_anti")
    store.put(apply_model(misses, model, prompt, "key", text_col).filter("error is null").drop("error"))
    return keyed.join(store.get(keyed).select("key", "result"), "key", "left")
