"""Text and embedding models behind small protocols, with offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import time
import tomllib
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol


class ChatClient(Protocol):
    def chat(self, system: str, user: str) -> str: ...


class EmbedClient(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


# Where each provider answers, and the variable that holds its key.
PROVIDERS = {
    "lmstudio": ("http://127.0.0.1:1234/v1", None),
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "openrouter": ("https://openrouter.ai/api/v1", "OPENROUTER_API_KEY"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta", "GEMINI_API_KEY"),
    "anthropic": ("https://api.anthropic.com/v1", "ANTHROPIC_API_KEY"),
}


@dataclass
class ModelConfig:
    """From a TOML file's [llm] table, then the environment, then defaults. An
    empty base_url is the provider's own; an empty api_key is looked up as
    FACTWEAVE_API_KEY, then as the provider's variable."""

    provider: str = "lmstudio"
    base_url: str = ""
    model: str = ""
    api_key: str = ""
    embed_model: str = ""
    timeout: float = 30.0
    retries: int = 8
    concurrency: int = 4

    def __post_init__(self) -> None:
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider}")
        self.base_url = (self.base_url or PROVIDERS[self.provider][0]).rstrip("/")

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> ModelConfig:
        env = dict(os.environ) if env is None else env
        got: dict = {}
        if path and os.path.exists(path):
            with open(path, "rb") as f:
                got = tomllib.load(f).get("llm", {})
        for k, kind in {"provider": str, "base_url": str, "model": str, "embed_model": str, "timeout": float, "retries": int, "concurrency": int}.items():
            if v := env.get(f"FACTWEAVE_{k.upper()}"):
                got[k] = kind(v)
        made = cls(**{k: v for k, v in got.items() if k in cls.__dataclass_fields__})
        name = PROVIDERS[made.provider][1]
        made.api_key = made.api_key or env.get("FACTWEAVE_API_KEY", "") or (env.get(name, "") if name else "not needed")
        return made

    def key(self) -> str:
        if not self.api_key:
            raise ValueError(f"no key for {self.provider}: set FACTWEAVE_API_KEY or {PROVIDERS[self.provider][1]}")
        return self.api_key


def backoff(attempt: int, cap: float = 60.0, retry_after: float | None = None, rng: random.Random | None = None) -> float:
    """Seconds to wait before another try: full jitter, or what the server says."""
    if retry_after is not None:
        return min(cap, retry_after)
    return (rng or random).uniform(0, min(cap, 2.0**attempt))


def with_retries(call: Callable[[], dict], retries: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    for attempt in range(retries + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in (408, 429, 500, 502, 503, 504) or attempt == retries:
                raise
            after = e.headers.get("Retry-After") if e.headers else None
            sleep(backoff(attempt, retry_after=float(after) if after and after.isdigit() else None))
        except urllib.error.URLError:
            if attempt == retries:
                raise
            sleep(backoff(attempt))
    raise AssertionError


@dataclass
class HttpClient:
    """OpenAI-compatible chat and embeddings, or Gemini's and Anthropic's chat."""

    config: ModelConfig
    usage: dict[str, int] = field(default_factory=lambda: {"calls": 0, "input": 0, "output": 0})

    def _post(self, url: str, body: dict, headers: dict[str, str]) -> dict:
        def call() -> dict:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
            with urllib.request.urlopen(request, timeout=self.config.timeout) as r:
                return json.load(r)

        self.usage["calls"] += 1
        got = with_retries(call, self.config.retries)
        # each interface has its own names for the same two counts
        said = got.get("usage") or got.get("usageMetadata") or {}
        self.usage["input"] += int(said.get("prompt_tokens") or said.get("input_tokens") or said.get("promptTokenCount") or 0)
        self.usage["output"] += int(said.get("completion_tokens") or said.get("output_tokens") or said.get("candidatesTokenCount") or 0)
        return got

    def chat(self, system: str, user: str) -> str:
        c = self.config
        if c.provider == "gemini":
            body = {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}]}
            got = self._post(f"{c.base_url}/models/{c.model}:generateContent", body, {"x-goog-api-key": c.key()})
            return "".join(p.get("text", "") for p in got["candidates"][0]["content"]["parts"])
        if c.provider == "anthropic":
            body = {"model": c.model, "max_tokens": 4096, "system": system, "messages": [{"role": "user", "content": user}]}
            got = self._post(f"{c.base_url}/messages", body, {"x-api-key": c.key(), "anthropic-version": "2023-06-01"})
            return "".join(p.get("text", "") for p in got["content"])
        body = {"model": c.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        return self._post(f"{c.base_url}/chat/completions", body, {"Authorization": f"Bearer {c.key()}"})["choices"][0]["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        c = self.config
        if c.provider == "anthropic":
            raise ValueError("this provider has no embeddings")
        if c.provider == "gemini":
            body = {"requests": [{"model": f"models/{c.embed_model}", "content": {"parts": [{"text": t}]}} for t in texts]}
            return [e["values"] for e in self._post(f"{c.base_url}/models/{c.embed_model}:batchEmbedContents", body, {"x-goog-api-key": c.key()})["embeddings"]]
        got = self._post(f"{c.base_url}/embeddings", {"model": c.embed_model, "input": texts}, {"Authorization": f"Bearer {c.key()}"})
        return [e["embedding"] for e in sorted(got["data"], key=lambda e: e["index"])]


@dataclass
class FakeChat:
    """Answers by a function of the prompt; for tests and dry runs."""

    answer: Callable[[str, str], str]

    def chat(self, system: str, user: str) -> str:
        return self.answer(system, user)


@dataclass
class HashEmbeddings:
    """Unit vectors that depend on the words of a text only."""

    dims: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % self.dims] += 1 if h[4] & 1 else -1
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out
