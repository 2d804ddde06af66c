"""Translation as a job: providers, ordered fallback, write-back, replies of providers.

A provider is any object with ``name`` and ``translate(text, source, target) -> str``, which raises when it
can't. Calls leave the JVM in batches (mapInArrow) and are made only for rows that still lack a
translation: each provider of the chain sees what the ones before it failed on.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.languages import STYLES
from quillframe.functions.text import is_blank, trim_all

TIMEOUT_S = 120


class Provider(Protocol):
    name: str

    def translate(self, text: str, source: str, target: str) -> str: ...


class ProviderError(RuntimeError):
    """A provider that can't translate a text."""


@dataclass(frozen=True)
class Options:
    temperature: float = 0.3
    max_tokens: int = 4000
    prompt_style: str = "preserve_order"


@dataclass(frozen=True)
class MockProvider:
    """Deterministic: words in reverse order, marked with the target; fails on texts that contain ``refuses``."""

    name: str = "mock"
    refuses: str | None = None

    def translate(self, text: str, source: str, target: str) -> str:
        if self.refuses and self.refuses in text:
            raise ProviderError(f"{self.name} refuses")
        return f"[{target}] " + " ".join(reversed(text.split(" ")))


def shortened(text: str, n: int = 400) -> str:
    """At most n characters of what went wrong, with an ellipsis where something is cut off."""
    return text if len(text) <= n else text[:n] + "…"


def _post(url: str, body: dict, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as reply:
        return json.load(reply)


def _get(url: str, headers: dict[str, str]) -> dict:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_S) as reply:
        return json.load(reply)


def prompt(text: str, source: str, target: str, style: str) -> str:
    return f"Translate from {source} into {target}. {STYLES[style]} Answer with the translation only.\n\n{text}"


@dataclass(frozen=True)
class HttpProvider:
    """Chat completions (kind chat), messages (kind messages) or a local generator (kind generate)."""

    name: str
    kind: str
    url: str
    model: str
    key: str = ""
    options: Options = Options()

    def request(self, text: str, source: str, target: str) -> tuple[str, dict, dict[str, str]]:
        said, o = prompt(text, source, target, self.options.prompt_style), self.options
        if self.kind == "generate":
            return f"{self.url}/api/generate", {"model": self.model, "prompt": said, "stream": False}, {}
        body = {"model": self.model, "max_tokens": o.max_tokens, "temperature": o.temperature, "messages": [{"role": "user", "content": said}]}
        if self.kind == "messages":
            return f"{self.url}/v1/messages", body, {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
        return f"{self.url}/chat/completions", body, {"authorization": f"Bearer {self.key}"}

    def translate(self, text: str, source: str, target: str) -> str:
        try:
            reply = _post(*self.request(text, source, target))
            if self.kind == "generate":
                out = reply["response"]
            elif self.kind == "messages":
                out = next(part["text"] for part in reply["content"] if part["type"] == "text")
            else:
                out = reply["choices"][0]["message"]["content"]
            return out.strip()
        except (OSError, ValueError, KeyError, IndexError, StopIteration, TypeError, AttributeError) as e:
            raise ProviderError(shortened(f"{self.name}: {type(e).__name__} {e}")) from e


    def list_models(self) -> list[tuple[str, str]]:
        """(id, capabilities) of the models that the provider offers, by the same reading as ``list_models`` of replies."""
        path, headers = {"generate": ("/api/tags", {}), "messages": ("/v1/models", {"x-api-key": self.key, "anthropic-version": "2023-06-01"})}.get(self.kind, ("/models", {"authorization": f"Bearer {self.key}"}))
        try:
            reply = _get(self.url + path, headers)
            rows = reply["models"] if self.kind == "generate" else reply["data"]
            out = []
            for m in rows:
                if self.kind == "generate":
                    out.append((m.get("name"), f"{(m.get('details') or {}).get('parameter_size') or '?'} params"))
                elif self.kind == "messages":
                    out.append((m.get("id"), f"Display: {m['display_name']}" if m.get("display_name") else "Available"))
                else:
                    n = m.get("context_window") or m.get("context_length")
                    out.append((m.get("id"), f"ctx: {n}" if n else "Available"))
            return [(i, c) for i, c in out if i]
        except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
            raise ProviderError(shortened(f"{self.name}: {type(e).__name__} {e}")) from e


#: Name, kind of wire, host and path, default model; in the order in which keys are looked for. A key is NAME_API_KEY; without one: ollama.
_HOSTS = """
groq        chat      api.groq.com/openai/v1        llama-3.3-70b-versatile
cerebras    chat      api.cerebras.ai/v1            llama-3.3-70b
openai      chat      api.openai.com/v1             gpt-4o-mini
anthropic   messages  api.anthropic.com             claude-3-5-haiku-latest
together    chat      api.together.xyz/v1           meta-llama/Llama-3.3-70B-Instruct-Turbo
openrouter  chat      openrouter.ai/api/v1          meta-llama/llama-3.3-70b-instruct
nebius      chat      api.studio.nebius.ai/v1       meta-llama/Llama-3.3-70B-Instruct
scaleway    chat      api.scaleway.ai/v1            llama-3.3-70b-instruct
mistral     chat      api.mistral.ai/v1             mistral-small-latest
poe         chat      api.poe.com/v1                GPT-4o-mini
google      chat      generativelanguage.googleapis.com/v1beta/openai  gemini-2.0-flash
"""
REGISTRY = {n: (kind, "https://" + at, f"{n.upper()}_API_KEY", model) for n, kind, at, model in map(str.split, _HOSTS.strip().splitlines())}
REGISTRY["ollama"] = ("generate", "http://localhost:11434", "", "llama3.2")


def providers_from(env: dict[str, str], model: str | None = None, options: Options = Options()) -> list[HttpProvider]:
    """The chain of all providers whose key is set, in the registry's order; ``model`` is for the first only."""
    found = [(n, *r) for n, r in REGISTRY.items() if r[2] and env.get(r[2])]
    return [HttpProvider(n, kind, url, model if model and not k else own, env[key], options) for k, (n, kind, url, key, own) in enumerate(found)]


@dataclass(frozen=True)
class LocalProvider:
    """A model file opened once in each Python worker by ``open_model(path)``, which gives text, source, target to text."""

    name: str
    path: str
    open_model: object

    def translate(self, text: str, source: str, target: str) -> str:
        if (self.name, self.path) not in _MODELS:
            _MODELS[self.name, self.path] = self.open_model(self.path)
        try:
            return _MODELS[self.name, self.path](text, source, target)
        except Exception as e:
            raise ProviderError(shortened(f"{self.name}: {e}")) from e


_MODELS: dict = {}
RESULT = "p_idx int, text string, translated string, provider string, error string"


def translate(paras: DataFrame, providers: Sequence[Provider], source: str, target: str, concurrency: int | None = None) -> DataFrame:
    """``doc_id, p_idx, text, translated, provider, error``, a row for each paragraph.

    The first provider that succeeds on a text counts; where all fail, translated is null and error the
    last one's. Blank and null paragraphs are not sent and have nulls. Rows are told apart by their columns, never by the order of
    arrival; doc_id is of any type. ``concurrency`` bounds the tasks that call at a time, for a provider that
    allows no more: without it there are as many as the rows have partitions.
    """
    if not providers:
        raise ValueError("no providers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names, errors = [], [], []
            for text in batch.column(2).to_pylist():
                done, by, error = None, None, None
                if text is not None and text.strip():
                    for p in providers:
                        try:
                            done, by, error = p.translate(text, source, target), p.name, None
                            break
                        except ProviderError as e:
                            error = str(e)
                out.append(done)
                names.append(by)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(names, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "p_idx", "text", "translated", "provider", "error"])

    rows = paras.select("doc_id", F.col("p_idx").cast("int").alias("p_idx"), F.col("text").cast("string").alias("text"))
    return (rows.repartition(max(1, concurrency)) if concurrency else rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def mock_translation(text: Column, target: str) -> Column:
    """What MockProvider says, as an expression."""
    return F.concat(F.lit(f"[{target}] "), F.array_join(F.reverse(F.split(text, " ")), " "))


def write_back(paras: DataFrame, translated: DataFrame) -> DataFrame:
    """paras: doc_id, p_idx, text. The translation of the same place, else the text as it was."""
    t = translated.select("doc_id", "p_idx", "translated")
    return paras.join(t, ["doc_id", "p_idx"], "left").select("doc_id", "p_idx", F.coalesce("translated", "text").alias("text"), F.col("translated").isNotNull().alias("changed"))


def summary(translated: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.col("translated").isNotNull())
    return translated.groupBy("doc_id").agg(n.alias("n"), ok.alias("n_ok"), F.count_if(~is_blank(F.coalesce("text", F.lit(""))) & F.col("translated").isNull()).alias("n_failed"))


def reply_text(reply: Column, kind: str) -> Column:
    """The translation in a provider's JSON reply, trimmed; null where the reply has another shape."""
    if kind == "generate":
        out = F.get_json_object(reply, "$.response")
    elif kind == "messages":
        parts = F.from_json(reply, "content array<struct<type:string,text:string>>")["content"]
        out = F.get(F.filter(parts, lambda p: p["type"] == "text"), F.lit(0))["text"]
    else:
        out = F.get_json_object(reply, "$.choices[0].message.content")
    return trim_all(out)


def list_models(replies: DataFrame, kind: str) -> DataFrame:
    """replies: provider, reply. ``provider, id, capabilities``; models without an id are left out."""
    j = F.col("reply")
    if kind == "generate":
        models = F.from_json(j, "models array<struct<name:string,details:struct<parameter_size:string>>>")["models"]
        m = replies.select("provider", F.explode(models).alias("m"))
        out = m.select("provider", F.col("m.name").alias("id"), F.concat(F.coalesce("m.details.parameter_size", F.lit("?")), F.lit(" params")).alias("capabilities"))
    elif kind == "messages":
        m = replies.select("provider", F.explode(F.from_json(j, "data array<struct<id:string,display_name:string>>")["data"]).alias("m"))
        out = m.select("provider", F.col("m.id").alias("id"), F.coalesce(F.concat(F.lit("Display: "), "m.display_name"), F.lit("Available")).alias("capabilities"))
    else:
        m = replies.select("provider", F.explode(F.from_json(j, "data array<struct<id:string,context_window:bigint,context_length:bigint>>")["data"]).alias("m"))
        n = F.coalesce("m.context_window", "m.context_length")
        out = m.select("provider", F.col("m.id").alias("id"), F.coalesce(F.concat(F.lit("ctx: "), n.cast("string")), F.lit("Available")).alias("capabilities"))
    return out.where("id is not null and id <> ''")
