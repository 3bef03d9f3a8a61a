import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from sparkloom.config import configure_logging, load_yaml, parse_args
from sparkloom.errors import LoomError
from sparkloom.operators.embedding import HttpProvider, LocalProvider, OnnxProvider, OpenAiProvider, Provider, vector_size
from sparkloom.operators.planning import pending_work
from sparkloom.operators.routing import ChunkerConfig
from sparkloom.sinks.vector_store import HttpVectorStore, MemorySink, ParquetSink, checked_id
from sparkloom.sources.dirscan import register, walk
from sparkloom.streaming.ingest import IngestConfig, IngestSummary, start


@pytest.fixture
def server():
    """A local service: answers is a list of (status, body), the last of which is given again; asked holds the requests."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            http.asked.append((self.command, self.path, dict(self.headers), json.loads(body) if body else None))
            status, text = http.answers.pop(0) if len(http.answers) > 1 else http.answers[0]
            if callable(text):
                text = text(http.asked[-1][3])
            raw = text.encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_PUT = do_POST = answer  # noqa: N815

        def log_message(self, *a):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    http.asked, http.answers = [], [(200, '{"status":"ok"}')]
    http.url = f"http://127.0.0.1:{http.server_port}"
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield http
    http.shutdown()


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return path


def test_walk(tmp_path):
    a = write(tmp_path / "b.txt", "1")
    write(tmp_path / "a" / "z.md", "22")
    write(tmp_path / ".hidden" / "_x", "")
    os.symlink(a, tmp_path / "link.txt")
    os.symlink(tmp_path / "a", tmp_path / "linked")
    os.utime(a, (1.9, 1.9))
    found = [(os.path.relpath(p, tmp_path), s) for p, s, _ in walk(str(tmp_path))]
    assert found == [(".hidden/_x", 0), ("a/z.md", 2), ("b.txt", 1)]
    assert [m for p, _, m in walk(str(tmp_path)) if p.endswith("b.txt")] == [1]
    assert list(walk(str(tmp_path / "missing"))) == []


def test_batch_source(spark, tmp_path):
    write(tmp_path / "a.md", "x")
    write(tmp_path / "b.bin", b"\xff\x00")
    register(spark)
    read = spark.read.format("dirscan").option("path", str(tmp_path))
    assert sorted((os.path.basename(r.canonical_path), bytes(r.content)) for r in read.load().collect()) == [("a.md", b"x"), ("b.bin", b"\xff\x00")]
    assert read.option("extensions", "md").load().count() == 1
    assert spark.read.format("dirscan").option("path", str(tmp_path / "none")).load().count() == 0


def test_stream_takes_changes_once(spark, tmp_path):
    root = tmp_path / "in"
    a = write(root / "a.txt", "one two")
    write(root / "bad.txt", b"\xc3(")
    write(root / "e.md", "")
    sink, said = MemorySink(), []
    config = IngestConfig(str(root), str(tmp_path / "cp"), ack_path=str(tmp_path / "acks"))

    def run():
        summary = IngestSummary(said.append)
        query = start(spark, config, sink, LocalProvider(4), summary, once=True)
        query.awaitTermination()
        spark.streams.removeListener(summary)
        summary.flush("test")

    run()
    texts = sorted(r.payload.chunk_text for r in sink.points.values())
    assert texts == ["", "one ", "two"]
    total = {k: sum(s[k] for s in said) for k in ("discovered", "indexed", "failed", "emitted_points")}
    assert total == {"discovered": 3, "indexed": 2, "failed": 1, "emitted_points": 3}
    ids = set(sink.points)
    run()  # nothing has changed; a new reader reports all files, the state takes them out
    assert set(sink.points) == ids and {k: sum(s[k] for s in said) for k in total} == total
    write(a, "one three four")
    os.utime(a, (2_000_000_000, 2_000_000_000))
    write(root / "sub" / "n.py", "def f():\n    pass\n")
    run()
    texts = sorted(r.payload.chunk_text for r in sink.points.values())
    assert "four" in texts and any("def f" in t for t in texts) and "two" not in texts
    acks = spark.read.parquet(str(tmp_path / "acks"))
    assert acks.count() == 4 and pending_work(acks).count() == 0


def test_upserts_over_http(spark, server, tmp_path):
    write(tmp_path / "in" / "a.txt", "one two")
    store = HttpVectorStore(server.url, "docs", 4)
    server.answers = [(404, "{}"), (200, "{}"), (200, '{"status":"ok"}')]
    start(spark, IngestConfig(str(tmp_path / "in"), str(tmp_path / "cp")), store, LocalProvider(4), once=True).awaitTermination()
    methods = [(m, p) for m, p, _, _ in server.asked]
    assert methods[:2] == [("GET", "/collections/docs"), ("PUT", "/collections/docs")] and server.asked[1][3] == {"vectors": {"size": 4, "distance": "Cosine"}}
    sent = [p for m, path, _, body in server.asked[2:] for p in body["points"] if path == "/collections/docs/points?wait=true"]
    assert sorted(p["payload"]["chunk_text"] for p in sent) == ["one ", "two"]
    assert {len(p["vector"]) for p in sent} == {4} and None in {p["payload"]["previous_chunk_id"] for p in sent} and len(sent[0]["payload"]) == 16


def test_a_poison_document_stops_no_other(spark, server, tmp_path):
    import io

    for i in range(10):
        write(tmp_path / "in" / f"{i}.txt", "one venom" if i == 4 else f"text number {i}")
    store, provider = HttpVectorStore(server.url, "docs"), HttpProvider(server.url + "/embed", "m")
    vectors = lambda body: json.dumps({"status": "ok"} if "points" in body else {"embeddings": [[1.0, 2.0] for _ in body["input"]]})
    poisoned = lambda where: lambda body: "no json" if "venom" in json.dumps(body) and where in body else vectors(body)
    for where, kind in (("input", "embed"), ("points", "sink")):
        server.asked.clear()
        server.answers = [(200, poisoned(where))]
        out, said = io.StringIO(), []
        log = configure_logging({"SPARKLOOM_LOG_FORMAT": "json", "SPARKLOOM_LOG": "debug"}, out)
        config = IngestConfig(str(tmp_path / "in"), str(tmp_path / f"cp-{where}"), ChunkerConfig(single="recursive"), ack_path=str(tmp_path / f"acks-{where}"), retries=1)
        summary = IngestSummary(said.append)
        start(spark, config, store, provider, summary, once=True, log=log).awaitTermination()
        spark.streams.removeListener(summary)
        summary.flush("test")
        events = [json.loads(x) for x in out.getvalue().splitlines()]
        failed = [e for e in events if e["event"] == "document.failed"]
        assert len(failed) == 1
        assert failed[0]["error_kind"] == kind and failed[0]["canonical_path"].endswith("4.txt") and failed[0]["error_message"]
        assert sum(e["event"] == "document.indexed" for e in events) == 9 and sum(e["failed"] for e in events if e["event"] == "ingest.batch") == 1
        assert {k: sum(s[k] for s in said) for k in ("discovered", "indexed", "failed")} == {"discovered": 10, "indexed": 9, "failed": 1}
        stored = [p["payload"]["chunk_text"] for _, _, _, body in server.asked if "points" in body for p in body["points"] if where == "input" or "venom" not in p["payload"]["chunk_text"]]
        assert len(set(stored)) >= 9 and not any("venom" in t for t in stored)
        asked = [body for _, _, _, body in server.asked if where in body and "venom" in json.dumps(body)]
        assert len(asked) == 2  # once, and one retry
        assert spark.read.parquet(config.ack_path).count() == 9
    server.answers = [(500, "down")]
    df = spark.createDataFrame([("i", [1.0], ("p", 1, 2))], "id string, vector array<float>, payload struct<canonical_path:string,size_bytes:long,mtime_unix_secs:long>")
    with pytest.raises(LoomError, match="1 documents failed"):
        store.upsert(df)


def test_store_errors(server):
    store = HttpVectorStore(server.url + "/", "c", 3)
    for status, body in ((500, "down"), (400, '{"message":"wrong vector size"}'), (200, '{"status":"error"}'), (200, "no json")):
        server.answers = [(status, body)]
        with pytest.raises(LoomError, match="sink") as e:
            store.put([])
        assert body in str(e.value) or body == "no json"
    server.answers = [(500, "x")]
    with pytest.raises(LoomError, match="status 500"):
        store.prepare()
    server.answers = [(404, ""), (409, "exists"), (200, "{}")]  # another writer made it meanwhile
    store.prepare()
    server.answers = [(404, ""), (500, "no"), (404, "")]
    with pytest.raises(LoomError, match="could not be made"):
        store.prepare()
    HttpVectorStore(server.url, "c").prepare()
    with pytest.raises(LoomError, match="sink: PUT"):
        HttpVectorStore("http://127.0.0.1:1", "c").put([])
    assert checked_id(" a ") == "a"
    with pytest.raises(LoomError, match="invalid input: point id is empty"):
        checked_id("  ")


def test_embedding_services(server):
    server.answers = [(200, '{"data":[{"index":1,"embedding":[1.0,2.0]},{"index":0,"embedding":[3,4]}]}')]
    assert OpenAiProvider(server.url, "key", "m").embed(["a", "b"]) == [[1.0, 2.0], [3.0, 4.0]]
    assert server.asked[-1][2]["Authorization"] == "Bearer key" and server.asked[-1][3] == {"model": "m", "input": ["a", "b"]}
    server.answers = [(200, lambda body: json.dumps({"embeddings": [[float(len(t))] for t in body["input"]]}))]
    provider = HttpProvider(server.url, "m")
    assert provider.embed_all(["x" * i for i in range(150)]) == [[float(i)] for i in range(150)]
    server.answers = [(200, '{"embeddings":[]}')]
    with pytest.raises(LoomError, match="wrong count"):
        provider.embed_all(["a"])
    for answer in ((503, "secret"), (200, "{}"), (200, "[")):
        server.answers = [answer]
        with pytest.raises(LoomError, match="^embed") as e:
            provider.embed(["a"])
        assert "secret" not in str(e.value)
    assert isinstance(provider, Provider) and (provider.name, OpenAiProvider("", "", "n").name) == ("http:m", "openai:n")


def test_model_file(monkeypatch, tmp_path):
    import numpy as np
    import onnxruntime
    import public_tokenizers

    class Session:
        def __init__(self, path, providers):
            assert path == "model.onnx"

        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, feed):
            assert set(feed) == {"input_ids", "attention_mask"}
            return [np.stack([feed["input_ids"] % 7 + 1, feed["input_ids"] % 3], axis=2)]

    monkeypatch.setattr(onnxruntime, "InferenceSession", Session)
    tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    provider = OnnxProvider("model.onnx", tokenizer)
    short, padded = provider.embed(["a b", "a b c d e f g"]), provider.embed(["a b"])
    assert short[0] == pytest.approx(padded[0]) and sum(x * x for x in short[1]) == pytest.approx(1)
    with pytest.raises(LoomError, match="can't be loaded"):
        OnnxProvider("model.onnx", str(tmp_path / "none")).embed(["a"])
    config = parse_args([*BASE, "--enable-semantic", "--semantic-provider", "fastembed", "--onnx-model", "m", "--onnx-tokenizer", "t"])
    assert config.signals == OnnxProvider("m", "t") and "signal=fastembed:all-MiniLM-L6-v2" in config.chunker.semantic.fingerprint


def test_parquet_sink(spark, tmp_path):
    df = spark.createDataFrame([("i", [1.0], ("p",))], "id string, vector array<float>, payload struct<a:string>")
    ParquetSink(str(tmp_path / "out")).upsert(df)
    ParquetSink(str(tmp_path / "out")).upsert(df)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


YAML = "source: {root: /d}\nembed: {endpoint: 'http://e'}\nsink: {qdrant_url: 'http://q', collection: c}\nother: 1\n"


def test_yaml():
    c = load_yaml(YAML)
    assert (c.root, c.endpoint, c.qdrant_url, c.collection) == ("/d", "http://e", "http://q", "c")
    for text, said in (("a: [", "config: invalid yaml"), ("source: {}", "source.root is missing"), (YAML.replace("/d", "' '"), "invalid config file: source.root is empty"), ("- x", "missing")):
        with pytest.raises(LoomError, match=said):
            load_yaml(text)


BASE = ["--dir", "/d", "--qdrant-url=http://q", "--collection", "c", "--openai-api-key", "k"]


def test_command_line(tmp_path):
    c = parse_args(BASE)
    assert c.root == "/d" and c.store == HttpVectorStore("http://q", "c") and c.provider == OpenAiProvider("https://api.openai.com/v1/embeddings", "k", "text-embedding-3-small")
    assert c.chunker == ChunkerConfig(type(c.chunker.sizes)(2000)) and not c.once
    assert parse_args([*BASE, "--size-metric", "tokens"]).chunker.sizes.max_size == 512
    assert parse_args([*BASE, "--create-collection-if-missing"]).store.vector_size == 1536
    assert parse_args(["--help", "--collection", ""]) == "help" and parse_args(["--version"]) == "version"
    assert parse_args(["-h"]) == "help" and parse_args(["-V"]) == "version"
    assert (c.ack_path, c.ack_failed, c.max_files, c.retries) == (None, False, 0, 2)
    told = parse_args([*BASE, "--ack-path", "/a", "--ack-failed", "--max-files", "7", "--retries=0"])
    assert (told.ack_path, told.ack_failed, told.max_files, told.retries) == ("/a", True, 7, 0)
    assert parse_args([*BASE, "--chunker-strategy", "legacy"]).warnings
    single = parse_args([*BASE, "--chunker-mode", "single", "--chunker-single", "code:rust"])
    assert single.chunker.single == "code:rust"
    semantic = parse_args([*BASE, "--enable-semantic", "--semantic-percentile", "60"])
    assert semantic.chunker.semantic.fingerprint == "semantic:v1|signal=openai:text-embedding-3-small|metric=chars|max=2000|min=0|percentile=60"
    path = write(tmp_path / "c.yaml", YAML)
    merged = parse_args(["--config", str(path), "--embed-backend", "http", "--collection", "mine"])
    assert merged.root == "/d" and merged.provider == HttpProvider("http://e", "default") and merged.store.collection == "mine"


@pytest.mark.parametrize(
    "args,said",
    [
        (["--nope"], "unknown argument"),
        ([], "--dir is required"),
        (BASE[:-2], "--openai-api-key is required"),
        ([*BASE, "--size-max", "x"], "whole number"),
        ([*BASE, "--max-files", "-1"], "whole number"),
        ([*BASE, "--tokenizer", "tiktoken-cl100k"], "--token-ranks is required"),
        ([*BASE, "--tokenizer", "p50k"], "must be one of"),
        ([*BASE, "--collection-vector-size"], "needs a value"),
        ([*BASE, "--collection-vector-size", "0"], "at least 1"),
        ([*BASE, "--once=1"], "takes no value"),
        ([*BASE, "--semantic-percentile", "100", "--enable-semantic"], "percentile 100"),
        ([*BASE, "--chunker-mode", "single", "--chunker-single", "code:cobol"], "must be one of"),
        ([*BASE, "--chunker-mode", "single", "--chunker-single", "markdown", "--enable-semantic"], "can't go with"),
        ([*BASE, "--openai-model", "own", "--create-collection-if-missing"], "unknown OpenAI model"),
        ([*BASE, "--embed-backend", "http", "--embed-url", "http://e", "--create-collection-if-missing"], "requires --collection-vector-size"),
        (["--config", "/no/such/file"], "failed to read config file"),
    ],
)
def test_command_line_errors(args, said):
    with pytest.raises(LoomError, match=said):
        parse_args(args)


def test_vector_sizes():
    assert [vector_size(OpenAiProvider("", "", m)) for m in ("text-embedding-3-small", "text-embedding-3-large", "text-embedding-ada-002")] == [1536, 3072, 1536]
    assert vector_size(HttpProvider("", ""), 7) == 7 and vector_size(LocalProvider(9)) == 9


def test_logging(capsys):
    import io

    out = io.StringIO()
    log = configure_logging({"SPARKLOOM_LOG_FORMAT": "json", "SPARKLOOM_LOG": "debug"}, out)
    log.info({"event": "start", "root": "/d"})
    log.debug("plain")
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first["event"] == "start" and first["level"] == "info" and second["message"] == "plain"
    for env in ({"SPARKLOOM_LOG_FORMAT": "xml"}, {"SPARKLOOM_LOG": " "}, {"SPARKLOOM_LOG": "loud"}):
        with pytest.raises(LoomError, match="config"):
            configure_logging(env)


def test_errors_keep_their_contexts():
    assert str(LoomError("config", "a").within("b").within(" ")) == "config: b: a" and str(LoomError("i/o")) == "i/o"
    with pytest.raises(ValueError):
        LoomError("odd")


def test_main(capsys):
    from sparkloom.__main__ import main

    assert main(["--help"]) == 0 and "usage: sparkloom" in capsys.readouterr().out
    assert main(["--version"]) == 0 and main(["-V"]) == 0 and main(["-h"]) == 0
    capsys.readouterr()
    assert main(["--nope"]) == 1 and "fatal: invalid input: unknown argument: --nope" in capsys.readouterr().err
