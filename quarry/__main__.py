"""``python -m quarry --data FOLDER``: questions at a prompt, or over HTTP with ``--serve``."""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .session import MOST_CHARS, TOP_K, Engine
from .sources import loaders

HELP = "a question, or :stats, :clear, :help, :quit"


class Service:
    """The HTTP front's answers as (status, body). Without an engine it isn't ready, and says so."""

    def __init__(self, engine: Engine | None = None, startup_s: float = 0.0):
        self.engine, self.startup_s, self.failed = engine, startup_s, ""

    def start(self, build: Callable[[], Engine]) -> threading.Thread:
        """Builds or opens the index in the background, so that the port answers at once."""

        def run() -> None:
            began = time.time()
            try:
                engine = build()
            except Exception as e:  # told to whoever asks; the front stays up
                self.failed = f"{type(e).__name__}: {e}"
            else:
                self.startup_s = round(time.time() - began, 3)
                self.engine = engine

        thread = threading.Thread(target=run, name="index", daemon=True)
        thread.start()
        return thread

    def answer(self, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
        if (method, path) == ("GET", "/"):
            return 200, {"message": "POST /search, GET /health, GET /stats"}
        if (method, path) not in {("POST", "/search"), ("GET", "/health"), ("GET", "/stats")}:
            return 404, {"detail": "not found"}
        if self.engine is None:
            return 503, {"detail": f"the index could not be built: {self.failed}" if self.failed else "the index is not ready yet"}
        try:
            if path == "/search":
                return self._search(body)
            stats = self.engine.stats()
            if path == "/health":
                stats = {"status": "ok", **{k: stats[k] for k in ("n_chunks", "n_docs", "model")}}
            return 200, stats | {"startup_time_s": self.startup_s}  # fixed interface names
        except Exception as e:  # a front answers, whatever happens behind it
            return 500, {"detail": f"{type(e).__name__}: {e}"}

    def _search(self, body: bytes) -> tuple[int, dict]:
        try:
            asked = json.loads(body or b"null")
            query, k = asked["query"], asked.get("top_k", TOP_K)
            if not isinstance(query, str) or not 0 < len(query.strip()) <= MOST_CHARS or isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= 10:
                raise ValueError(f"query has 1 to {MOST_CHARS} characters, top_k is 1 to 10")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return 422, {"detail": str(e)}
        return 200, self.engine.response(query, k)


def serve(service: Service, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = service.answer(self.command, self.path, body)
            raw = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def respond(engine: Engine, line: str) -> str | None:
    """What the prompt says to a line; None ends it."""
    line = line.strip()
    command = line.lower()
    if command == ":quit":
        return None
    if command == ":stats":
        return "\n".join(f"{k}: {v}" for k, v in engine.stats().items())
    if command == ":clear":
        engine.cache.clear()
        return "cache cleared"
    if command == ":help":
        return HELP
    if not line:
        return ""
    try:
        found = engine.response(line)
    except ValueError as e:
        return f"error: {e}"
    rows = [f"#{r['rank']} {r['doc_title']} [{r['final_score']:.4f}] cosine={r['cosine_score']:.3f} bm25={r['bm25_score']:.3f}\n   {r['text'][:200]}" for r in found["results"]]
    return "\n".join([*rows, f"{len(rows)} results, {found['search_time_ms']:.0f} ms" + ", cached" * found["from_cache"]])


def main(args: list[str] | None = None, lines=sys.stdin) -> int:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("--data", "-d", required=True, help="folder of TXT, JSON and PDF files")
    parser.add_argument("--index", "-i", required=True, help="folder of indexes, in a store that all executors reach")
    parser.add_argument("--reindex", "-r", action="store_true", help="build the index anew")
    parser.add_argument("--serve", type=int, metavar="PORT", help="answer over HTTP instead of at a prompt")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    try:
        loaded = loaders.load_folder(spark, given.data, ordered=False)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    print(loaders.folder_summary(loaded).first().asDict())
    docs = loaded.filter("id IS NOT NULL").select(F.xxhash64("id").alias("doc_id"), "title", F.col("content").alias("text"))
    build = lambda: Engine.open(docs, given.index, given.reindex, title="title")
    if given.serve:
        service = Service()
        server = serve(service, given.serve)
        service.start(build)
        server.serve_forever()
    engine = build()
    for line in lines:
        said = respond(engine, line)
        if said is None:
            break
        print(said)
    return 0


if __name__ == "__main__":
    sys.exit(main())
