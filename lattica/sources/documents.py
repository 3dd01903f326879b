"""Document formats, parsed and written on the driver: Turtle, TriG, N3 facts, RDF/XML, JSON-LD, TriX.

A document of these has one scope for prefixes and blank nodes and is read as a whole.  Parsers return
``(s, p, o, graph or None)`` tuples of terms; ``to_frame`` makes a frame of them.
"""

from __future__ import annotations

import itertools
import json
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from lattica.namespaces import WELL_KNOWN, NamespaceManager
from lattica.plans.parser import Parser
from lattica.terms import BNODE, IRI, LITERAL, QUADS, RDF, RDF_TYPE, XSD, Term, bnode, iri, literal, triple_term

Quad = tuple[Term, str, Term, "str | None"]


def to_frame(spark, quads: list[Quad]):
    return spark.createDataFrame([(tuple(s), p, tuple(o), g) for s, p, o, g in quads], QUADS).distinct()


# -- Turtle and TriG --------------------------------------------------------------------
class TurtleParser(Parser):
    def __init__(self, text: str, base: str = ""):
        super().__init__(text, base=base)
        self.in_template = True
        self.named: dict = {}

    def directive(self) -> bool:
        if self.kind == "lang" and self.value in ("@prefix", "@base", "@version"):
            word = self.next()[1]
        elif self.word("PREFIX", "BASE", "VERSION"):
            self.prologue()
            return True
        else:
            return False
        if word == "@prefix":
            name = self.next()[1]
            self.prefixes[name.rstrip(":")] = self.resolve(self.next()[1][1:-1])
        elif word == "@base":
            self.base = self.resolve(self.next()[1][1:-1])
        else:
            self.next()
        self.want(".")
        return True

    def ground(self, x) -> Term:
        return x if isinstance(x, Term) else triple_term(*[self.ground(y) for y in x[1:]])

    def document(self) -> list[Quad]:
        out: list[Quad] = []
        while self.kind != "end":
            if self.directive():
                continue
            name = None
            if self.take_word("GRAPH"):
                name = self.graph_name()
            elif not self.at("{") and self.tokens[self.i + 1][1] == "{" and self.kind in ("iri", "pn", "bn"):
                name = self.graph_name()
            if self.take("{"):
                while not self.take("}"):
                    out += [(self.ground(s), self.ground(p).v, self.ground(o), name) for s, p, o in self.triples_block()]
            else:
                rows: list = []
                before = self.node(rows)
                if not (rows and self.at(".")):
                    self.properties(before, rows)
                self.want(".")
                out += [(self.ground(s), self.ground(p).v, self.ground(o), None) for s, p, o in rows]
        return out

    def graph_name(self) -> str:
        return self.iri().v if self.at_iri() else "_:" + self.next()[1][2:]


def parse_turtle(text: str, base: str = "") -> list[Quad]:
    return TurtleParser(text, base).document()


parse_trig = parse_turtle


def _show(t: Term, ns: NamespaceManager) -> str:
    if t.k == IRI:
        return ns.qname(t.v)
    if t.k == LITERAL and t.dt == XSD + "integer" and t.v.lstrip("+-").isdigit():
        return t.v
    if t.k == LITERAL and t.dt == XSD + "boolean" and t.v in ("true", "false"):
        return t.v
    if t.k == LITERAL and t.dt:
        return Term(LITERAL, t.v).n3() + "^^" + ns.qname(t.dt)
    return t.n3()


def write_turtle(quads: list[Quad], ns: NamespaceManager | None = None, long: bool = False) -> str:
    """Turtle, or TriG where quads name graphs; ``long`` puts every predicate and object on a line of its own."""
    ns = ns or NamespaceManager(WELL_KNOWN)
    body = []
    for g, rows in itertools.groupby(sorted(quads, key=lambda q: (q[3] or "", q)), key=lambda q: q[3]):
        block = []
        for s, of_s in itertools.groupby(rows, key=lambda q: q[0]):
            parts = []
            for p, of_p in itertools.groupby(of_s, key=lambda q: q[1]):
                values = [_show(q[2], ns) for q in of_p]
                name = "a" if p == RDF_TYPE else ns.qname(p)
                parts.append(f"{name}\n        " + " ,\n        ".join(values) if long else f"{name} " + ", ".join(values))
            block.append(f"{_show(s, ns)} " + " ;\n    ".join(parts) + " .")
        text = "\n".join(block)
        body.append(text if g is None else f"{ns.qname(g) if not g.startswith('_:') else g} {{\n{text}\n}}")
    text = "\n".join(body)
    used = [f"@prefix {p}: <{b}> ." for p, b in sorted(ns.prefixes.items()) if f"{p}:" in text]
    return "\n".join([*used, text]) + "\n"


# -- RDF/XML ------------------------------------------------------------------------------
_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


def parse_rdfxml(text: str, base: str = "") -> list[Quad]:
    out: list[Quad] = []
    counter = itertools.count()
    new = lambda: bnode(f"x{next(counter)}")
    name = lambda tag: tag[1:].replace("}", "")

    def node(e, base, lang) -> Term:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        if e.get(_R + "about") is not None:
            s = iri(urljoin(base, e.get(_R + "about")))
        elif e.get(_R + "ID") is not None:
            s = iri(urljoin(base, "#" + e.get(_R + "ID")))
        else:
            s = bnode(e.get(_R + "nodeID")) if e.get(_R + "nodeID") else new()
        if e.tag != _R + "Description":
            out.append((s, RDF_TYPE, iri(name(e.tag)), None))
        for k, v in e.attrib.items():
            if k == _R + "type":
                out.append((s, RDF_TYPE, iri(urljoin(base, v)), None))
            elif not k.startswith((_R, _XML)):
                out.append((s, name(k), literal(v, lang=lang), None))
        n = 0
        for p in e:
            tag = name(p.tag)
            if p.tag == _R + "li":
                n += 1
                tag = f"{RDF}_{n}"
            out.append((s, tag, value(p, base, p.get(_XML + "lang", lang)), None))
        return s

    def value(p, base, lang) -> Term:
        kind = p.get(_R + "parseType")
        if p.get(_R + "resource") is not None:
            return iri(urljoin(base, p.get(_R + "resource")))
        if p.get(_R + "nodeID"):
            return bnode(p.get(_R + "nodeID"))
        if kind == "Literal":
            inner = (p.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in p)
            return literal(inner, RDF + "XMLLiteral")
        if kind == "Resource":
            s = new()
            for q in p:
                out.append((s, name(q.tag), value(q, base, lang), None))
            return s
        if kind == "Collection":
            items = [node(c, base, lang) for c in p]
            cells = [new() for _ in items]
            for i, (c, x) in enumerate(zip(cells, items, strict=True)):
                out.append((c, RDF + "first", x, None))
                out.append((c, RDF + "rest", cells[i + 1] if i + 1 < len(cells) else iri(RDF + "nil"), None))
            return cells[0] if cells else iri(RDF + "nil")
        if len(p):
            return node(p[0], base, lang)
        return literal(p.text or "", p.get(_R + "datatype") or "", lang="" if p.get(_R + "datatype") else lang)

    root = ET.fromstring(text)
    base = root.get(_XML + "base", base)
    for e in root if root.tag == _R + "RDF" else [root]:
        node(e, base, root.get(_XML + "lang", ""))
    return out


def write_rdfxml(quads: list[Quad]) -> str:
    root = ET.Element(_R + "RDF")
    for s, rows in itertools.groupby(sorted(quads), key=lambda q: q[0]):
        e = ET.SubElement(root, _R + "Description", {_R + ("about" if s.k == IRI else "nodeID"): s.v})
        for _, p, o, _ in rows:
            cut = max(p.rfind("#"), p.rfind("/")) + 1
            c = ET.SubElement(e, f"{{{p[:cut]}}}{p[cut:]}")
            if o.k == IRI:
                c.set(_R + "resource", o.v)
            elif o.k == BNODE:
                c.set(_R + "nodeID", o.v)
            else:
                c.text = o.v
                if o.lang:
                    c.set(_XML + "lang", o.lang)
                elif o.dt:
                    c.set(_R + "datatype", o.dt)
    return ET.tostring(root, encoding="unicode")


# -- TriX -----------------------------------------------------------------------------------
_TX = "{http://www.w3.org/2004/03/trix/trix-1/}"


def parse_trix(text: str) -> list[Quad]:
    out = []

    def term(e) -> Term:
        kind, v = e.tag.removeprefix(_TX), (e.text or "")
        if kind == "uri":
            return iri(v.strip())
        if kind == "id":
            return bnode(v.strip())
        return literal(v, e.get("datatype") or "", e.get(_XML + "lang") or "")

    for g in ET.fromstring(text).iter(_TX + "graph"):
        names = [c for c in g if c.tag in (_TX + "uri", _TX + "id")]
        name = names[0].text.strip() if names else None
        for t in g.iter(_TX + "triple"):
            s, p, o = map(term, t)
            out.append((s, p.v, o, name))
    return out


def write_trix(quads: list[Quad]) -> str:
    root = ET.Element(_TX + "TriX")
    for g, rows in itertools.groupby(sorted(quads, key=lambda q: (q[3] or "", q)), key=lambda q: q[3]):
        e = ET.SubElement(root, _TX + "graph")
        if g:
            ET.SubElement(e, _TX + "uri").text = g
        for s, p, o, _ in rows:
            t = ET.SubElement(e, _TX + "triple")
            for x in (s, iri(p), o):
                kind = {IRI: "uri", BNODE: "id"}.get(x.k) or ("typedLiteral" if x.dt else "plainLiteral")
                c = ET.SubElement(t, _TX + kind)
                c.text = x.v
                if x.dt:
                    c.set("datatype", x.dt)
                if x.lang:
                    c.set(_XML + "lang", x.lang)
    return ET.tostring(root, encoding="unicode")


# -- JSON-LD ----------------------------------------------------------------------------------
class _Context:
    def __init__(self, old: _Context | None = None):
        self.terms = dict(old.terms) if old else {}
        self.vocab, self.base, self.lang = (old.vocab, old.base, old.lang) if old else ("", "", "")

    def extend(self, c) -> _Context:
        out = _Context(self)
        for part in c if isinstance(c, list) else [c]:
            if part is None:
                out = _Context()
                continue
            if isinstance(part, str):
                continue  # remote contexts are not fetched
            out.vocab, out.base = part.get("@vocab", out.vocab), part.get("@base", out.base) or ""
            out.lang = part.get("@language", out.lang) or ""
            for k, v in part.items():
                if not k.startswith("@"):
                    out.terms[k] = v if isinstance(v, dict) else {"@id": v}
        return out

    def expand(self, name: str, vocab: bool = True) -> str:
        if name.startswith(("@", "_:")):
            return name
        if vocab and name in self.terms and self.terms[name].get("@id"):
            found = self.terms[name]["@id"]
            return found if found == name else self.expand(found)
        prefix, colon, rest = name.partition(":")
        if colon and not rest.startswith("//") and prefix in self.terms and self.terms[prefix].get("@id"):
            return self.expand(self.terms[prefix]["@id"]) + rest
        if colon:
            return name
        return self.vocab + name if vocab and self.vocab else urljoin(self.base, name) if self.base and not vocab else name


def expand_jsonld(doc, context: _Context | None = None) -> list[dict]:
    """Expanded form: full IRIs, every value an object, every property an array."""
    c = context or _Context()
    if isinstance(doc, list):
        return [x for d in doc for x in expand_jsonld(d, c)]
    if "@context" in doc:
        c = c.extend(doc["@context"])
    if set(doc) - {"@context"} == {"@graph"}:
        return expand_jsonld(doc["@graph"], c)
    out: dict = {}
    for k, v in doc.items():
        if k == "@context":
            continue
        key = c.expand(k)
        spec = c.terms.get(k, {})
        if key == "@id":
            out["@id"] = c.expand(v, vocab=False)
        elif key == "@type":
            out["@type"] = [c.expand(x) for x in (v if isinstance(v, list) else [v])]
        elif key == "@graph":
            out["@graph"] = expand_jsonld(v, c)
        elif key == "@reverse":
            out["@reverse"] = {c.expand(p): expand_jsonld(x if isinstance(x, list) else [x], c) for p, x in v.items()}
        elif not key.startswith("@") and ":" in key:
            if spec.get("@container") == "@language" and isinstance(v, dict):
                out[key] = [{"@value": x, "@language": lang} for lang, xs in v.items() for x in (xs if isinstance(xs, list) else [xs])]
            elif spec.get("@container") == "@list":
                out[key] = [{"@list": [_value(x, spec, c) for x in (v if isinstance(v, list) else [v])]}]
            else:
                out.setdefault(key, []).extend(_value(x, spec, c) for x in (v if isinstance(v, list) else [v]) if x is not None)
    return [out]


def _value(x, spec: dict, c: _Context) -> dict:
    if isinstance(x, dict):
        if "@value" in x:
            out = {"@value": x["@value"]}
            if x.get("@type"):
                out["@type"] = c.expand(x["@type"])
            if x.get("@language"):
                out["@language"] = x["@language"].lower()
            return out
        if "@list" in x:
            return {"@list": [_value(y, spec, c) for y in x["@list"]]}
        return expand_jsonld(x, c)[0]
    kind = spec.get("@type")
    if kind in ("@id", "@vocab") and isinstance(x, str):
        return {"@id": c.expand(x, vocab=kind == "@vocab")}
    out = {"@value": x}
    if kind and kind != "@none":
        out["@type"] = c.expand(kind)
    elif isinstance(x, str) and (spec.get("@language") or c.lang):
        out["@language"] = spec.get("@language") or c.lang
    return out


def parse_jsonld(text: str) -> list[Quad]:
    out: list[Quad] = []
    counter = itertools.count()

    def node_term(v: str) -> Term:
        return bnode(v[2:]) if v.startswith("_:") else iri(v)

    def value(x: dict, g) -> Term:
        if "@value" in x:
            v, kind = x["@value"], x.get("@type", "")
            if isinstance(v, bool):
                return literal("true" if v else "false", kind or XSD + "boolean")
            if isinstance(v, int) or (isinstance(v, float) and v == int(v) and not kind):
                return literal(str(int(v)), kind or XSD + "integer")
            if isinstance(v, float):
                return literal(repr(v), kind or XSD + "double")
            return literal(v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True), "" if kind == XSD + "string" else RDF + "JSON" if kind == "@json" else kind, x.get("@language", ""))
        if "@list" in x:
            items = [value(y, g) for y in x["@list"]]
            cells = [bnode(f"j{next(counter)}") for _ in items]
            for i, (c, t) in enumerate(zip(cells, items, strict=True)):
                out.append((c, RDF + "first", t, g))
                out.append((c, RDF + "rest", cells[i + 1] if i + 1 < len(cells) else iri(RDF + "nil"), g))
            return cells[0] if cells else iri(RDF + "nil")
        return node(x, g)

    def node(x: dict, g) -> Term:
        s = node_term(x["@id"]) if "@id" in x else bnode(f"j{next(counter)}")
        for t in x.get("@type", []):
            out.append((s, RDF_TYPE, node_term(t), g))
        for p, vs in x.get("@reverse", {}).items():
            for v in vs:
                out.append((node(v, g), p, s, g))
        for inner in x.get("@graph", []):
            node(inner, s.v if s.k == IRI else "_:" + s.v)
        for p, vs in x.items():
            if not p.startswith("@"):
                for v in vs:
                    out.append((s, p, value(v, g), g))
        return s

    for x in expand_jsonld(json.loads(text)):
        node(x, None)
    return out


def write_jsonld(quads: list[Quad]) -> str:
    """Expanded JSON-LD, one object per subject; named graphs as ``@graph``."""
    graphs: dict = {}
    for s, p, o, g in sorted(quads, key=lambda q: (q[3] or "", q)):
        name = lambda t: "_:" + t.v if t.k == BNODE else t.v
        x = graphs.setdefault(g, {}).setdefault(name(s), {"@id": name(s)})
        if p == RDF_TYPE and o.k != LITERAL:
            x.setdefault("@type", []).append(name(o))
        else:
            v = {"@id": name(o)} if o.k != LITERAL else {"@value": o.v} | ({"@language": o.lang} if o.lang else {"@type": o.dt} if o.dt else {})
            x.setdefault(p, []).append(v)
    out = list(graphs.pop(None, {}).values()) + [{"@id": g, "@graph": list(xs.values())} for g, xs in graphs.items()]
    return json.dumps(out, ensure_ascii=False, indent=1)


def flatten_jsonld(doc) -> list[dict]:
    """One node object per subject, blank nodes named."""
    return json.loads(write_jsonld(parse_jsonld(json.dumps(doc))))


def compact_jsonld(expanded: list[dict], context: dict) -> dict:
    """Terms of the context in place of IRIs, single values without arrays."""
    c = _Context().extend(context)
    short = {c.expand(t): t for t in c.terms}

    def name(v: str, vocab: bool = True) -> str:
        if vocab and v in short:
            return short[v]
        for t, spec in c.terms.items():
            base = c.expand(t)
            if v.startswith(base) and base.endswith(("/", "#", ":")) and len(v) > len(base) and spec.get("@id"):
                return f"{t}:{v[len(base):]}"
        return v[len(c.vocab) :] if vocab and c.vocab and v.startswith(c.vocab) else v

    def value(x: dict, spec: dict):
        if "@value" in x:
            if set(x) == {"@value"} or x.get("@type") == (c.expand(spec["@type"]) if "@type" in spec else None):
                return x["@value"]
            return {k: name(v) if k == "@type" else v for k, v in x.items()}
        if "@list" in x:
            return {"@list": [value(y, spec) for y in x["@list"]]}
        if set(x) == {"@id"} and spec.get("@type") == "@id":
            return name(x["@id"], False)
        return node(x)

    def node(x: dict) -> dict:
        out: dict = {}
        for k, v in x.items():
            if k == "@id":
                out[k] = name(v, False)
            elif k == "@type":
                ts = [name(t) for t in v]
                out[k] = ts[0] if len(ts) == 1 else ts
            elif k == "@graph":
                out[k] = [node(y) for y in v]
            elif not k.startswith("@"):
                key = name(k)
                vs = [value(y, c.terms.get(key, {})) for y in v]
                out[key] = vs[0] if len(vs) == 1 else vs
        return out

    nodes = [node(x) for x in expanded]
    return {"@context": context} | (nodes[0] if len(nodes) == 1 else {"@graph": nodes})


def frame_jsonld(doc, frame: dict) -> dict:
    """Nodes that match the frame's types and properties, with the linked nodes embedded."""
    nodes = {x["@id"]: x for x in flatten_jsonld(doc)}
    c = _Context().extend(frame.get("@context", {}))
    want = expand_jsonld(frame)[0]

    def matches(x: dict, f: dict) -> bool:
        types = f.get("@type")
        if types and not set(types) & set(x.get("@type", [])):
            return False
        return f.get("@id") in (None, x["@id"]) and (bool(types) or all(p in x for p in f if not p.startswith("@")))

    def embed(x: dict, f: dict, seen: tuple) -> dict:
        out = {}
        for k, v in x.items():
            if k.startswith("@"):
                out[k] = v
                continue
            inner = (f.get(k) or [{}])[0]
            out[k] = [embed(nodes[y["@id"]], inner, (*seen, x["@id"])) if "@id" in y and y["@id"] in nodes and y["@id"] not in seen + (x["@id"],) else y for y in v]
        return out

    found = [embed(x, want, ()) for x in nodes.values() if matches(x, want)]
    return compact_jsonld(found, frame.get("@context", {})) if c.terms or c.vocab else {"@graph": found}


# -- one entry for all ---------------------------------------------------------------------------
PARSERS = {"turtle": parse_turtle, "trig": parse_trig, "n3": parse_turtle, "rdfxml": parse_rdfxml, "jsonld": parse_jsonld, "trix": parse_trix}
WRITERS = {"turtle": write_turtle, "trig": write_turtle, "longturtle": lambda q: write_turtle(q, long=True), "rdfxml": write_rdfxml, "jsonld": write_jsonld, "trix": write_trix}
EXTENSIONS = {".ttl": "turtle", ".trig": "trig", ".n3": "n3", ".rdf": "rdfxml", ".xml": "rdfxml", ".jsonld": "jsonld", ".trix": "trix", ".nt": "ntriples", ".nq": "nquads", ".hext": "hextuples", ".ndjson": "hextuples"}
MEDIA = {"text/turtle": "turtle", "application/trig": "trig", "text/n3": "n3", "application/rdf+xml": "rdfxml", "application/ld+json": "jsonld", "application/trix": "trix", "application/n-triples": "ntriples", "application/n-quads": "nquads", "application/x-ndjson": "hextuples"}


def register_format(name: str, parse=None, write=None, extension: str = "", media: str = "") -> None:
    """Add a format of one's own."""
    if parse:
        PARSERS[name] = parse
    if write:
        WRITERS[name] = write
    if extension:
        EXTENSIONS[extension] = name
    if media:
        MEDIA[media] = name


def load(spark, path: str, format: str | None = None):
    """Quads of a file by its format, or by its extension; the file is read by Spark, wherever it lies."""
    from lattica.sources import text as lines

    name = format or next((f for e, f in EXTENSIONS.items() if path.endswith(e)), None)
    if name is None:
        raise ValueError(f"no format for {path}")
    from pyspark.sql import functions as F

    if name in ("ntriples", "nquads", "hextuples"):
        return {"ntriples": lines.read_ntriples, "nquads": lines.read_nquads, "hextuples": lines.read_hextuples}[name](spark, path)
    return parse_files(spark, path, name)


def save(g, path: str, format: str | None = None) -> None:
    """Write quads in a format, or in that of the path's extension: formats by line as a folder of parts, others as one file."""
    from lattica.sources import text as lines

    name = format or next((f for e, f in EXTENSIONS.items() if path.endswith(e)), None)
    if name in ("ntriples", "nquads"):
        lines.write_ntriples(g if name == "nquads" else g.select("s", "p", "o"), path)
    elif name == "hextuples":
        lines.write_hextuples(g, path)
    elif name in WRITERS:
        spark, text = g.sparkSession, WRITERS[name](collect_quads(g))
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
    else:
        raise ValueError(f"no format for {path}")


def parse_files(spark, path: str, format: str):
    """Quads of whole documents, each parsed by a task; blank nodes of several files are kept apart."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema

    parse, kind = PARSERS[format], to_arrow_schema(QUADS)
    files = spark.read.text(path, wholetext=True).select("value", F.sha1(F.input_file_name()).alias("file"))
    several = len(files.inputFiles()) > 1

    def run(batches):
        for b in batches:
            for text, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = lambda t, f=file: t._replace(v=f"f{f[:12]}{t.v}") if several and t.k == BNODE else t
                quads = [{"s": own(s)._asdict(), "p": p, "o": own(o)._asdict(), "g": g} for s, p, o, g in parse(text)]
                for i in range(0, len(quads), 10_000):
                    yield pa.RecordBatch.from_pylist(quads[i : i + 10_000], schema=kind)

    return files.mapInArrow(run, QUADS).distinct()


def collect_quads(g) -> list[Quad]:
    """A graph small enough for a document, on the driver."""
    return [(Term(*r["s"]), r["p"], Term(*r["o"]), r["g"] if "g" in g.columns else None) for r in g.toLocalIterator()]
