"""Configuration from YAML and the command line."""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass
from typing import Any

from .errors import LoomError
from .functions.recursive import RecursiveConfig
from .operators.code import LANGUAGES
from .operators.embedding import HttpProvider, LocalProvider, OnnxProvider, OpenAiProvider, Provider, vector_size
from .operators.routing import ChunkerConfig
from .operators.semantic import SemanticConfig
from .sinks.vector_store import HttpVectorStore

USAGE = """usage: sparkloom --dir DIR --qdrant-url URL --collection NAME [options]
  --config FILE                  YAML with source.root, embed.endpoint, sink.qdrant_url, sink.collection; flags win
  --embed-backend openai|http|local (openai)
  --openai-endpoint URL  --openai-api-key KEY  --openai-model NAME
  --embed-url URL  --embed-model NAME
  --create-collection-if-missing  --collection-vector-size N
  --chunker-mode router|single (router)  --chunker-single recursive|markdown|semantic|code:LANGUAGE
  --chunker-strategy recursive|legacy  --size-metric chars|tokens  --size-max N  --size-min N  --size-overlap N
  --tokenizer byte-bpe-50k|tiktoken-cl100k  --token-ranks FILE    the ranks of the latter, which are not part of this package
  --enable-semantic  --semantic-provider adapter|fastembed|local  --semantic-percentile 1..99 (95)
  --onnx-model FILE  --onnx-tokenizer FILE    the model of the fastembed provider
  --checkpoint DIR  --once  --max-files N (of a batch; 0: all)  --retries N (2)  --ack-path DIR  --ack-failed
  -h, --help  -V, --version"""

# The flags, and what they stand for where they aren't given.
SWITCHES = ("create-collection-if-missing", "enable-semantic", "once", "ack-failed", "help", "version")
SHORT = {"-h": "--help", "-V": "--version"}
DEFAULTS = {
    "config": None, "dir": None, "qdrant-url": None, "collection": None, "collection-vector-size": None,
    "embed-backend": "openai", "embed-url": None, "embed-model": "default",
    "openai-endpoint": "https://api.openai.com/v1/embeddings", "openai-api-key": None, "openai-model": "text-embedding-3-small",
    "chunker-strategy": "recursive", "size-metric": "chars", "size-max": None, "size-min": "0", "size-overlap": "0", "tokenizer": None,
    "chunker-mode": "router", "chunker-single": None, "semantic-provider": "adapter", "semantic-percentile": "95", "onnx-model": None, "onnx-tokenizer": None, "checkpoint": None,
    "token-ranks": None, "max-files": "0", "retries": "2", "ack-path": None,
}
SIZE_MAX = {"chars": 2000, "tokens": 512}


@dataclass(frozen=True)
class PipelineConfig:
    """What a YAML file says."""

    root: str
    endpoint: str
    qdrant_url: str
    collection: str


def load_yaml(text: str) -> PipelineConfig:
    """Reads and checks a YAML configuration; keys that aren't known are passed over."""
    import yaml

    try:
        read: Any = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise LoomError("config", f"invalid yaml: {e}") from e
    values = []
    for section, key in (("source", "root"), ("embed", "endpoint"), ("sink", "qdrant_url"), ("sink", "collection")):
        found = read.get(section, {}) if isinstance(read, dict) else {}
        value = found.get(key) if isinstance(found, dict) else None
        if not isinstance(value, str):
            raise LoomError("config", f"invalid yaml: {section}.{key} is missing or is no text")
        if not value.strip():
            raise LoomError("config", f"{section}.{key} is empty").within("invalid config file")
        values.append(value)
    return PipelineConfig(*values)


@dataclass(frozen=True)
class RunConfig:
    root: str
    store: HttpVectorStore
    provider: Provider
    chunker: ChunkerConfig
    checkpoint: str
    once: bool
    signals: Provider  # of the semantic chunker
    max_files: int = 0
    retries: int = 2
    ack_path: str | None = None
    ack_failed: bool = False
    warnings: tuple[str, ...] = ()


def _flags(args: list[str]) -> dict[str, Any]:
    """Values by flag, both as ``--flag value`` and ``--flag=value``."""
    found: dict[str, Any] = {}
    rest = list(args)
    while rest:
        flag, equals, value = rest.pop(0).partition("=")
        flag = SHORT.get(flag, flag)
        name = flag.removeprefix("--")
        if not flag.startswith("--") or (name not in DEFAULTS and name not in SWITCHES):
            raise LoomError("invalid input", f"unknown argument: {flag}\n{USAGE}")
        if name in SWITCHES:
            if equals:
                raise LoomError("invalid input", f"{flag} takes no value\n{USAGE}")
            found[name] = True
        elif equals or rest:
            found[name] = value if equals else rest.pop(0)
        elif name == "collection-vector-size":
            raise LoomError("invalid input", f"{flag} needs a value\n{USAGE}")
    return found


def _number(given: dict[str, Any], name: str, default: str | int | None, least: int = 0) -> int | None:
    raw = given.get(name, default)
    if raw is None:
        return None
    if not str(raw).isdecimal() or int(raw) < least:
        raise LoomError("invalid input", f"--{name} must be a whole number of at least {least}: {raw}\n{USAGE}")
    return int(raw)


def _one_of(name: str, value: str, *allowed: str) -> str:
    if value not in allowed:
        raise LoomError("invalid input", f"--{name} must be one of {', '.join(allowed)}: {value}\n{USAGE}")
    return value


def parse_args(args: list[str]) -> RunConfig | str:
    """What to run, or ``help`` or ``version``, which come before any check."""
    given = _flags(args)
    for word in ("help", "version"):
        if given.get(word):
            return word
    get = lambda name: given.get(name, DEFAULTS[name])
    file = None
    if get("config") is not None:
        try:
            with open(get("config"), encoding="utf-8") as f:
                text = f.read()
        except OSError as e:
            raise LoomError("i/o", str(e)).within(f"failed to read config file: {get('config')}") from e
        try:
            file = load_yaml(text)
        except LoomError as e:
            raise e.within(f"failed to parse config file: {get('config')}") from None

    def needed(name: str, from_file: str | None = None) -> str:
        value = get(name) or from_file
        if not value or not value.strip():
            raise LoomError("config", f"--{name} is required\n{USAGE}")
        return value

    root = needed("dir", file and file.root)
    url, collection = needed("qdrant-url", file and file.qdrant_url), needed("collection", file and file.collection)
    backend = _one_of("embed-backend", get("embed-backend"), "openai", "http", "local")
    if backend == "openai":
        endpoint = given.get("openai-endpoint") or (file and file.endpoint) or DEFAULTS["openai-endpoint"]
        provider: Provider = OpenAiProvider(endpoint, needed("openai-api-key"), get("openai-model"))
    elif backend == "http":
        provider = HttpProvider(needed("embed-url", file and file.endpoint), get("embed-model"))
    else:
        provider = LocalProvider()

    metric = _one_of("size-metric", get("size-metric"), "chars", "tokens")
    ranks = needed("token-ranks") if _one_of("tokenizer", get("tokenizer") or "byte-bpe-50k", "byte-bpe-50k", "tiktoken-cl100k") == "tiktoken-cl100k" else None
    sizes = RecursiveConfig(_number(given, "size-max", SIZE_MAX[metric]), _number(given, "size-min", "0"), _number(given, "size-overlap", "0"), metric, ranks)
    warnings = []
    if _one_of("chunker-strategy", get("chunker-strategy"), "recursive", "legacy") == "legacy":
        warnings.append("chunker.legacy_alias: the legacy strategy is the recursive one")
    mode = _one_of("chunker-mode", get("chunker-mode"), "router", "single")
    single = get("chunker-single") or "recursive" if mode == "single" else None
    if single is not None:
        _one_of("chunker-single", single, "recursive", "markdown", "semantic", *(f"code:{x}" for x in LANGUAGES))
    if given.get("enable-semantic") and single not in (None, "semantic"):
        raise LoomError("invalid input", f"--enable-semantic can't go with --chunker-single {single}\n{USAGE}")
    signal = _one_of("semantic-provider", get("semantic-provider"), "adapter", "fastembed", "local")
    percentile = _number(given, "semantic-percentile", "95", 1)
    semantic, signals = None, provider
    if given.get("enable-semantic") or single == "semantic":
        if signal == "fastembed":
            signals = OnnxProvider(needed("onnx-model"), needed("onnx-tokenizer"))
        elif signal == "local":
            signals = LocalProvider()
        semantic = SemanticConfig(sizes, percentile, signals.name)

    explicit = _number(given, "collection-vector-size", None, 1)
    size = vector_size(provider, explicit) if given.get("create-collection-if-missing") else None
    checkpoint = get("checkpoint") or os.path.join(root, "..", f".sparkloom-{collection}")
    return RunConfig(root, HttpVectorStore(url, collection, size), provider, ChunkerConfig(sizes, single, semantic), checkpoint, bool(given.get("once")), signals, _number(given, "max-files", "0"), _number(given, "retries", "2"), get("ack-path"), bool(given.get("ack-failed")), tuple(warnings))


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        import json

        said = record.msg if isinstance(record.msg, dict) else {"message": record.getMessage()}
        return json.dumps({"time": self.formatTime(record), "level": record.levelname.lower(), "logger": record.name, **said}, ensure_ascii=False)


def configure_logging(environ: dict[str, str] | None = None, stream=sys.stderr) -> logging.Logger:  # noqa: ANN001
    """The engine's logger: SPARKLOOM_LOG is its level (info), SPARKLOOM_LOG_FORMAT is pretty or json."""
    environ = dict(os.environ) if environ is None else environ
    shape, level = environ.get("SPARKLOOM_LOG_FORMAT", "pretty"), environ.get("SPARKLOOM_LOG", "info")
    if shape not in ("pretty", "json"):
        raise LoomError("config", f"unknown log format: {shape}")
    if not level.strip() or not isinstance(logging.getLevelName(level.strip().upper()), int):
        raise LoomError("config", f"unknown log level: {level!r}")
    logger = logging.getLogger("sparkloom")
    logger.handlers, logger.propagate = [logging.StreamHandler(stream)], False
    logger.handlers[0].setFormatter(_Json() if shape == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logger.setLevel(level.strip().upper())
    return logger
