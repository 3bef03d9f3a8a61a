"""Providers of vectors: two HTTP services, a model file, and a local one that needs neither model nor network."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from ..errors import LoomError
from .semantic import hashed_words

TIMEOUT_S = 30
LOOPBACK = ("localhost", "127.0.0.1", "::1")
# Vector sizes of models.
VECTOR_SIZES = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}


def request(kind: str, method: str, url: str, body: Any = None, headers: dict[str, str] | None = None) -> tuple[int, str]:
    """Status and text of a JSON request; hosts on this machine are asked without a proxy. No answer is an error of kind."""
    data = None if body is None else json.dumps(body).encode()
    asked = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})}, method=method)  # noqa: S310
    proxies = [urllib.request.ProxyHandler({})] if urllib.parse.urlsplit(url).hostname in LOOPBACK else []
    try:
        with urllib.request.build_opener(*proxies).open(asked, timeout=TIMEOUT_S) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except (OSError, ValueError) as e:
        raise LoomError(kind, str(e)).within(f"{method} {url} failed") from e


class Provider:
    """Gives a vector for each of some texts, in their order."""

    name = ""
    batch = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError

    def embed_all(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            found = self.embed(part)
            if len(found) != len(part):
                raise LoomError("internal", "embedding provider returned wrong count")
            out += found
        return out


def retried(call, retries: int, wait_s: float = 0.2):  # noqa: ANN001, ANN201
    """What call gives; an error of a service is tried again so often, after waits that double."""
    for left in range(retries, -1, -1):
        try:
            return call()
        except LoomError as e:
            if not left or e.kind not in ("embed", "sink"):
                raise
            time.sleep(wait_s * 2 ** (retries - left))


@dataclass(frozen=True)
class LocalProvider(Provider):
    dimension: int = 64
    name: str = "local:hashed-words"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return hashed_words(texts, self.dimension).tolist()


@dataclass(frozen=True)
class OpenAiProvider(Provider):
    """Vectors come in the order of the answer's data array."""

    endpoint: str
    api_key: str
    model: str

    @property
    def name(self) -> str:
        return f"openai:{self.model}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        status, text = request("embed", "POST", self.endpoint, {"model": self.model, "input": texts}, {"Authorization": f"Bearer {self.api_key}"})
        return _vectors(status, text, lambda x: [d["embedding"] for d in x["data"]])


@dataclass(frozen=True)
class HttpProvider(Provider):
    url: str
    model: str

    @property
    def name(self) -> str:
        return f"http:{self.model}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        status, text = request("embed", "POST", self.url, {"model": self.model, "input": texts})
        return _vectors(status, text, lambda x: x["embeddings"])


def _vectors(status: int, text: str, pick) -> list[list[float]]:  # noqa: ANN001
    if not 200 <= status < 300:
        raise LoomError("embed", f"embedding service answered with status {status}")
    try:
        return [[float(x) for x in v] for v in pick(json.loads(text))]
    except (ValueError, KeyError, TypeError) as e:
        raise LoomError("embed", "embedding service gave no vectors") from e


def vector_size(provider: Provider, explicit: int | None = None) -> int:
    """Of a collection for a provider's vectors: as told, or as the model is known to have it."""
    if explicit:
        return explicit
    if isinstance(provider, LocalProvider):
        return provider.dimension
    if isinstance(provider, OpenAiProvider):
        if provider.model in VECTOR_SIZES:
            return VECTOR_SIZES[provider.model]
        raise LoomError("config", f"unknown OpenAI model for collection vector size: {provider.model}; pass --collection-vector-size")
    raise LoomError("config", "http backend requires --collection-vector-size")


@dataclass(frozen=True)
class OnnxProvider(Provider):
    """A sentence model of one's own: an ONNX file and its tokenizer file, at paths that every executor can read.

    The mean of the token vectors, without padding, scaled to length 1. The session is loaded once a process.
    """

    model_path: str
    tokenizer_path: str
    name: str = "fastembed:all-MiniLM-L6-v2"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        session, tokenizer = _onnx(self.model_path, self.tokenizer_path)
        coded = tokenizer.encode_batch(texts)
        mask = np.array([e.attention_mask for e in coded], np.int64)
        feed = {"input_ids": np.array([e.ids for e in coded], np.int64), "attention_mask": mask, "token_type_ids": np.array([e.type_ids for e in coded], np.int64)}
        wanted = {i.name for i in session.get_inputs()}
        tokens = np.asarray(session.run(None, {k: v for k, v in feed.items() if k in wanted})[0], np.float32)
        mean = (tokens * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).tolist()


@lru_cache(maxsize=2)
def _onnx(model_path: str, tokenizer_path: str):  # noqa: ANN202
    try:
        import onnxruntime
        from tokenizers import Tokenizer

        session, tokenizer = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"]), Tokenizer.from_file(tokenizer_path)
    except Exception as e:
        raise LoomError("embed", str(e)).within("local model can't be loaded") from e
    tokenizer.enable_padding()
    tokenizer.enable_truncation(512)
    return session, tokenizer
