"""SPARQL protocol and graph store over HTTP: a thin driver-side front, for small results.

``GET/POST /sparql`` queries, ``POST /update`` updates, ``GET/PUT/POST/DELETE/PATCH /data?default|graph=iri`` graphs
(a patch is an RDF Patch or an update), ``POST /upload`` adds a document, ``POST /reason?regime=rdfs|owl|owl-rl`` adds a closure,
``POST /shacl`` validates, ``GET /stats`` counts, ``GET /`` describes the service.  Updates are one at a time.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from lattica.operators import rules
from lattica.operators.update import State
from lattica.plans.parser import SparqlError, parse_query
from lattica.sources import documents as D
from lattica.sources import results as R
from lattica.sources.text import apply_patch

RESULT_TYPES = {"application/sparql-results+json": R.to_json, "application/json": R.to_json, "application/sparql-results+xml": R.to_xml, "text/csv": R.to_csv, "text/tab-separated-values": R.to_tsv}


def negotiate(accept: str, offered: list[str]) -> str:
    """The best offered media type for an Accept header."""
    wanted = []
    for i, part in enumerate(accept.split(",")):
        kind, *options = [x.strip() for x in part.split(";")]
        q = next((float(o[2:]) for o in options if o.startswith("q=")), 1.0)
        wanted.append((-q, i, kind))
    for _, _, kind in sorted(wanted):
        for o in offered:
            if kind in (o, "*/*") or (kind.endswith("/*") and o.startswith(kind[:-1])):
                return o
    return offered[0]


class Service:
    """The server's state and its answers, apart from HTTP."""

    def __init__(self, state: State):
        self.state, self.lock = state, threading.Lock()

    def query(self, text: str, accept: str = "*/*") -> tuple[str, str]:
        form = parse_query(text)["form"]
        result = self.state.query(text)
        if form == "ask":
            return "application/sparql-results+json", R.ask_json(result.df.first()[0])
        if form in ("construct", "describe"):
            kind = negotiate(accept, ["text/turtle", "application/n-triples", "application/ld+json", "application/rdf+xml", "application/trix"])
            quads = D.collect_quads(result.source)
            if kind == "application/n-triples":
                return kind, "".join(f"{s.n3()} <{p}> {o.n3()} .\n" for s, p, o, _ in quads)
            return kind, D.WRITERS[D.MEDIA[kind]](quads)
        kind = negotiate(accept, list(RESULT_TYPES))
        return kind, RESULT_TYPES[kind](result.terms())

    def update(self, text: str) -> None:
        with self.lock:
            self.state = self.state.update(text)

    def graph(self, name: str | None):
        return self.state.quads.where(F.col("g").isNull() if name is None else F.col("g") == name)

    def put(self, name: str | None, body: str, media: str, replace: bool) -> None:
        rows = D.to_frame(self.state.spark, [(s, p, o, name) for s, p, o, _ in D.PARSERS[D.MEDIA[media]](body)])
        with self.lock:
            base = self.state.removed(self.graph(name)) if replace else self.state
            self.state = base.added(rows)

    def delete(self, name: str | None) -> None:
        with self.lock:
            self.state = self.state.removed(self.graph(name))

    def patch(self, name: str | None, body: str, media: str) -> None:
        if media == "application/sparql-update":
            self.update(body)
            return
        lines = [(x.strip(),) for x in body.splitlines() if x[:2] in ("A ", "D ")]
        with self.lock:
            graph = self.graph(name)
            frame = self.state.spark.createDataFrame(lines, "value string")
            after = apply_patch(graph.select("s", "p", "o"), frame).withColumn("g", F.lit(name).cast("string"))
            self.state = self.state.removed(graph).added(after)

    def reason(self, name: str | None, regime: str) -> None:
        close = {"rdfs": rules.rdfs_closure, "owl": rules.owl_closure, "owl-rl": rules.owl_rl_closure}[regime]
        with self.lock:
            closed = close(self.graph(name).select("s", "p", "o"))
            self.state = self.state.added(closed.withColumn("g", F.lit(name).cast("string")))

    def stats(self) -> dict:
        """Triples of each graph; the default graph has no name."""
        return {r["g"] or "": r["n"] for r in self.state.quads.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}

    def validate(self, shapes: str) -> list[dict]:
        from lattica.operators.shacl import validate

        return [r.asDict() for r in validate(self.graph(None).drop("g"), shapes).collect()]


def serve(state: State, port: int = 3030, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    service = Service(state)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, kind: str = "text/plain", body: str = "") -> None:
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(data)

        def handle_all(self) -> None:
            url = urlsplit(self.path)
            args = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            media = self.headers.get("Content-Type", "").split(";")[0]
            if media == "application/x-www-form-urlencoded":
                args |= {k: v[0] for k, v in parse_qs(body).items()}
            accept = self.headers.get("Accept", "*/*")
            try:
                if url.path == "/":
                    self.answer(200, "application/json", json.dumps({"endpoints": ["/sparql", "/update", "/data", "/upload", "/reason", "/shacl", "/stats"], "graphs": sorted(service.state.names())}))
                elif url.path == "/sparql":
                    self.answer(200, *service.query(args.get("query", body if media == "application/sparql-query" else ""), accept))
                elif url.path == "/update":
                    service.update(args.get("update", body))
                    self.answer(204)
                elif url.path == "/shacl":
                    self.answer(200, "application/json", json.dumps(service.validate(body)))
                elif url.path == "/stats":
                    self.answer(200, "application/json", json.dumps(service.stats()))
                elif url.path == "/upload":
                    service.put(args.get("graph"), body, media or "text/turtle", False)
                    self.answer(204)
                elif url.path == "/reason":
                    service.reason(args.get("graph"), args.get("regime", "rdfs"))
                    self.answer(204)
                elif url.path == "/data":
                    name = args.get("graph")
                    if self.command in ("GET", "HEAD"):
                        self.answer(200, "text/turtle", D.write_turtle([(s, p, o, None) for s, p, o, _ in D.collect_quads(service.graph(name))]))
                    elif self.command == "PATCH":
                        service.patch(name, body, media)
                        self.answer(204)
                    elif self.command == "DELETE":
                        service.delete(name)
                        self.answer(204)
                    else:
                        service.put(name, body, media or "text/turtle", self.command == "PUT")
                        self.answer(204)
                else:
                    self.answer(404)
            except (SparqlError, KeyError, ValueError) as e:
                self.answer(400, body=str(e))

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = handle_all  # noqa: N815

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
