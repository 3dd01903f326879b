"""SPARQL 1.1/1.2 queries and updates to a syntax tree of plain tuples and dicts.

Terms are ``Term`` tuples or ``("var", name)``.  Expressions: ``("term", t)``, ``("var", n)``, ``("op", o, args)``,
``("call", NAME, args)``, ``("fn", iri, args)``, ``("agg", NAME, distinct, arg, separator)``, ``("in", e, list, negated)``,
``("exists", group, negated)``.  Group elements: ``("triples", [(s, p, o)])``, ``("filter", e)``, ``("bind", e, v)``,
``("optional" | "minus" | "lateral" | "group", group)``, ``("union", [group])``, ``("values", vars, rows)``,
``("graph", name, group)``, ``("service", name, group, silent, text)``, ``("select", query)``.
Paths: ``("path", op, args)`` with ops ``/ | ^ * + ? !``.
"""

from __future__ import annotations

import itertools
import re
from urllib.parse import urljoin

from lattica.namespaces import WELL_KNOWN
from lattica.terms import RDF, RDF_TYPE, XSD, Term, bnode, iri, literal, unescape


class SparqlError(ValueError):
    """A query or update that is not well formed."""


_TOKEN = re.compile(
    r"""(?P<ws>[\s]+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\s]*>)
  | (?P<str>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<var>[?$]\w+)
  | (?P<bn>_:\w[\w.\-]*)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?)
  | (?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)|\d*\.\d+|\d+)
  | (?P<pn>(?:[A-Za-zÀ-￿][\w.\-]*)?:(?:[\w:%\-]|\\.|\.(?=[\w:%\-\\]))*)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|<<\(|\)>>|<<|>>|\{\||\|\}|[{}()\[\].;,=<>!*/+\-|^?~@])""",
    re.X | re.S,
)

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT", "MEDIAN", "MODE"}


def tokenize(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup != "ws":
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    out.append(("end", "", at))
    return out


def is_var(x) -> bool:
    return isinstance(x, tuple) and not isinstance(x, Term) and len(x) == 2 and x[0] == "var"


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = ""):
        self.text, self.tokens, self.i = text, tokenize(text), 0
        self.prefixes = dict(WELL_KNOWN) | dict(prefixes or {})
        self.base = base
        self.fresh = itertools.count()
        self.in_template = False

    # -- tokens ---------------------------------------------------------------
    @property
    def kind(self):
        return self.tokens[self.i][0]

    @property
    def value(self):
        return self.tokens[self.i][1]

    def fail(self, what: str):
        raise SparqlError(f"expected {what}, found {self.value!r} at {self.tokens[self.i][2]}")

    def next(self):
        t = self.tokens[self.i]
        self.i += 1
        return t

    def at(self, *ops: str) -> bool:
        return self.kind == "op" and self.value in ops

    def take(self, op: str) -> bool:
        if self.at(op):
            self.i += 1
            return True
        return False

    def want(self, op: str) -> None:
        if not self.take(op):
            self.fail(repr(op))

    def word(self, *words: str) -> bool:
        return self.kind == "word" and self.value.upper() in words

    def take_word(self, *words: str) -> str | None:
        if self.word(*words):
            return self.next()[1].upper()
        return None

    def want_word(self, *words: str) -> str:
        return self.take_word(*words) or self.fail(" or ".join(words))

    # -- prologue and terms ---------------------------------------------------
    def prologue(self) -> None:
        while True:
            if self.take_word("PREFIX"):
                name = self.next()[1]
                self.prefixes[name.rstrip(":")] = self.resolve(self.next()[1][1:-1])
            elif self.take_word("BASE"):
                self.base = self.resolve(self.next()[1][1:-1])
            elif self.take_word("VERSION"):
                self.next()
            else:
                return

    def resolve(self, ref: str) -> str:
        ref = unescape(ref)
        if not self.base or re.match(r"[A-Za-z][\w+.-]*:", ref):
            return ref
        whole = urljoin(self.base, ref)
        return whole + "#" if ref.endswith("#") and not whole.endswith("#") else whole  # urljoin drops an empty fragment

    def iri(self) -> Term:
        kind, value, _ = self.next()
        if kind == "iri":
            return iri(self.resolve(value[1:-1]))
        if kind == "pn":
            prefix, _, name = value.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", name))
        self.i -= 1
        self.fail("an IRI")

    def at_iri(self) -> bool:
        return self.kind in ("iri", "pn")

    def var(self) -> str:
        if self.kind != "var":
            self.fail("a variable")
        return self.next()[1][1:]

    def anon(self):
        label = f"_:g{next(self.fresh)}"
        return bnode(label[2:]) if self.in_template else ("var", label)

    def number(self, sign: str = "") -> Term:
        v = self.next()[1]
        kind = "double" if "e" in v.lower() else "decimal" if "." in v else "integer"
        return Term(3, sign + v, XSD + kind)

    def string(self) -> str:
        v = self.next()[1]
        n = 3 if v[:3] in ('"""', "'''") else 1
        return unescape(v[n:-n])

    def literal(self) -> Term:
        v = self.string()
        if self.kind == "lang":
            tag, _, way = self.next()[1][1:].partition("--")
            return literal(v, lang=tag, dir=way)
        if self.take("^^"):
            return literal(v, self.iri().v)
        return literal(v)

    def constant(self):
        """A literal, number, boolean or IRI, or None."""
        if self.at_iri():
            return self.iri()
        if self.kind == "str":
            return self.literal()
        if self.kind == "num":
            return self.number()
        if self.at("+", "-") and self.tokens[self.i + 1][0] == "num":
            return self.number(self.next()[1].replace("+", ""))
        if self.word("TRUE", "FALSE"):
            return literal(self.next()[1].lower() == "true")
        return None

    # -- triples --------------------------------------------------------------
    def node(self, out: list):
        """A term in subject or object place; adds the triples of lists and nested nodes to ``out``."""
        if self.kind == "var":
            return ("var", self.var())
        if self.kind == "bn":
            name = self.next()[1][2:]
            return bnode(name) if self.in_template else ("var", "_:" + name)
        if self.at("<<("):
            self.next()
            s, p, o = self.node(out), self.verb(), self.node(out)
            self.want(")>>")
            return ("tt", s, p, o)
        if self.at("<<"):
            self.next()
            s, p, o = self.node(out), self.verb(), self.node(out)
            reifier = self.node(out) if self.take("~") else self.anon()
            self.want(">>")
            out.append((reifier, iri(RDF + "reifies"), ("tt", s, p, o)))
            return reifier
        if self.take("["):
            me = self.anon()
            if not self.at("]"):
                self.properties(me, out)
            self.want("]")
            return me
        if self.take("("):
            items = []
            while not self.at(")"):
                items.append(self.node(out))
            self.want(")")
            head = tail = iri(RDF + "nil")
            cells = [self.anon() for _ in items]
            for i, (cell, item) in enumerate(zip(cells, items, strict=True)):
                out.append((cell, iri(RDF + "first"), item))
                out.append((cell, iri(RDF + "rest"), cells[i + 1] if i + 1 < len(cells) else tail))
            return cells[0] if cells else head
        t = self.constant()
        if t is None:
            self.fail("a term")
        return t

    def verb(self):
        if self.kind == "var":
            return ("var", self.var())
        if self.word("A") and self.value == "a":
            self.next()
            return iri(RDF_TYPE)
        return self.path()

    def path(self):
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else ("path", "|", parts)

    def path_sequence(self):
        parts = [self.path_elt()]
        while self.take("/"):
            parts.append(self.path_elt())
        return parts[0] if len(parts) == 1 else ("path", "/", parts)

    def path_elt(self):
        if self.take("^"):
            return ("path", "^", [self.path_elt()])
        p = self.path_primary()
        if self.at("*", "+", "?"):
            return ("path", self.next()[1], [p])
        return p

    def path_primary(self):
        if self.take("("):
            p = self.path()
            self.want(")")
            return p
        if self.take("!"):
            members = []
            group = self.take("(")
            while not (group and self.at(")")):
                inverse = self.take("^")
                p = iri(RDF_TYPE) if self.take_word("A") else self.iri()
                members.append(("path", "^", [p]) if inverse else p)
                if not group or not self.take("|"):
                    break
            if group:
                self.want(")")
            return ("path", "!", members)
        if self.word("A") and self.value == "a":
            self.next()
            return iri(RDF_TYPE)
        return self.iri()

    def properties(self, s, out: list) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.node(out)
                out.append((s, p, o))
                reifier = None
                while self.at("~", "{|"):
                    if self.take("~"):
                        reifier = self.node(out) if self.kind in ("var", "iri", "pn", "bn") else self.anon()
                        out.append((reifier, iri(RDF + "reifies"), ("tt", s, p, o)))
                    else:
                        self.next()
                        if reifier is None:
                            reifier = self.anon()
                            out.append((reifier, iri(RDF + "reifies"), ("tt", s, p, o)))
                        self.properties(reifier, out)
                        self.want("|}")
                if not self.take(","):
                    break
            while self.take(";"):
                pass
            if self.kind in ("var", "iri", "pn") or self.at("^", "(", "!") or (self.word("A") and self.value == "a"):
                if self.tokens[self.i - 1][1] == ";":
                    continue
            return

    def triples_block(self) -> list:
        out: list = []
        while True:
            before = len(out)
            s = self.node(out)
            if not (len(out) > before and (self.at(".", "}") or self.kind == "end")):
                self.properties(s, out)
            if not self.take("."):
                break
            if not self.starts_triples():
                break
        return out

    def starts_triples(self) -> bool:
        return self.kind in ("var", "iri", "pn", "bn", "str", "num") or self.at("[", "(", "<<(", "<<", "+", "-") or self.word("TRUE", "FALSE")

    # -- patterns -------------------------------------------------------------
    def group(self) -> list:
        self.want("{")
        if self.word("SELECT"):
            q = self.select_query(sub=True)
            self.want("}")
            return [("select", q)]
        out: list = []
        while not self.at("}"):
            if self.starts_triples():
                out.append(("triples", self.triples_block()))
            elif self.take_word("FILTER"):
                out.append(("filter", self.constraint()))
            elif self.take_word("BIND"):
                self.want("(")
                e = self.expression()
                self.want_word("AS")
                v = self.var()
                self.want(")")
                if v in visible(out):
                    raise SparqlError(f"BIND to ?{v}, which is in use already")
                out.append(("bind", e, v))
            elif self.take_word("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.take_word("MINUS"):
                out.append(("minus", self.group()))
            elif self.take_word("LATERAL"):
                out.append(("lateral", self.group()))
            elif self.take_word("GRAPH"):
                name = ("var", self.var()) if self.kind == "var" else self.iri()
                out.append(("graph", name, self.group()))
            elif self.take_word("SERVICE"):
                silent = bool(self.take_word("SILENT"))
                name = ("var", self.var()) if self.kind == "var" else self.iri()
                start = self.tokens[self.i][2]
                g = self.group()
                out.append(("service", name, g, silent, self.text[start : self.tokens[self.i - 1][2] + 1]))
            elif self.take_word("VALUES"):
                out.append(self.values())
            elif self.at("{"):
                parts = [self.group()]
                while self.take_word("UNION"):
                    parts.append(self.group())
                if len(parts) > 1:
                    out.append(("union", parts))
                elif len(parts[0]) == 1 and parts[0][0][0] == "select":
                    out.append(parts[0][0])
                else:
                    out.append(("group", parts[0]))
            elif not self.take("."):
                self.fail("a pattern")
        self.want("}")
        return out

    def values(self):
        rows: list = []
        if self.kind == "var":
            names, single = [self.var()], True
        else:
            self.want("(")
            names, single = [], False
            while not self.at(")"):
                names.append(self.var())
            self.want(")")
        self.want("{")
        while not self.at("}"):
            if not single:
                self.want("(")
            row = []
            while len(row) < len(names):
                if self.take_word("UNDEF"):
                    row.append(None)
                else:
                    t = self.constant()
                    row.append(t if t is not None else self.fail("a value"))
            if not single:
                self.want(")")
            rows.append(row)
        self.want("}")
        return ("values", names, rows)

    # -- expressions ----------------------------------------------------------
    def constraint(self):
        if self.at("("):
            self.next()
            e = self.expression()
            self.want(")")
            return e
        return self.primary()

    def expression(self):
        args = [self.and_expression()]
        while self.take("||"):
            args.append(self.and_expression())
        return args[0] if len(args) == 1 else ("op", "||", args)

    def and_expression(self):
        args = [self.relation()]
        while self.take("&&"):
            args.append(self.relation())
        return args[0] if len(args) == 1 else ("op", "&&", args)

    def relation(self):
        left = self.sum()
        if self.at("=", "!=", "<", ">", "<=", ">="):
            return ("op", self.next()[1], [left, self.sum()])
        if self.take_word("IN"):
            return ("in", left, self.arguments(), False)
        if self.word("NOT") and self.tokens[self.i + 1][1].upper() == "IN":
            self.i += 2
            return ("in", left, self.arguments(), True)
        return left

    def sum(self):
        e = self.product()
        while self.at("+", "-"):
            e = ("op", self.next()[1], [e, self.product()])
        return e

    def product(self):
        e = self.unary()
        while self.at("*", "/"):
            e = ("op", self.next()[1], [e, self.unary()])
        return e

    def unary(self):
        if self.take("!"):
            return ("op", "!", [self.unary()])
        if self.at("-", "+"):
            o = self.next()[1]
            if self.kind == "num":
                return ("term", self.number("-" if o == "-" else ""))
            return ("op", "neg" if o == "-" else "pos", [self.unary()])
        return self.primary()

    def arguments(self) -> list:
        self.want("(")
        out = []
        while not self.at(")"):
            out.append(self.expression())
            if not self.take(","):
                break
        self.want(")")
        return out

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.want(")")
            return e
        if self.kind == "var":
            return ("var", self.var())
        if self.at("<<("):
            self.next()
            parts = []
            for _ in range(3):
                parts.append(("var", self.var()) if self.kind == "var" else ("term", iri(RDF_TYPE)) if self.take_word("A") else self.primary())
            self.want(")>>")
            return ("call", "TRIPLE", parts)
        if self.kind == "word" and not self.word("TRUE", "FALSE"):
            name = self.next()[1].upper()
            if name == "NOT":
                self.want_word("EXISTS")
                return ("exists", self.group(), True)
            if name == "EXISTS":
                return ("exists", self.group(), False)
            if name in AGGREGATES:
                return self.aggregate(name)
            return ("call", name, self.arguments())
        if self.at_iri():
            t = self.iri()
            if self.at("("):
                return ("fn", t.v, self.arguments())
            return ("term", t)
        t = self.constant()
        if t is None:
            self.fail("an expression")
        return ("term", t)

    def aggregate(self, name: str):
        self.want("(")
        distinct = bool(self.take_word("DISTINCT"))
        arg = None if name == "COUNT" and self.take("*") else self.expression()
        if arg is not None and has_aggregate(arg):
            raise SparqlError("an aggregate within an aggregate")
        separator = " "
        if self.take(";"):
            self.want_word("SEPARATOR")
            self.want("=")
            separator = self.string()
        self.want(")")
        return ("agg", name, distinct, arg, separator)

    # -- queries --------------------------------------------------------------
    def query(self) -> dict:
        self.prologue()
        if self.word("SELECT"):
            q = self.select_query()
        elif self.take_word("ASK"):
            q = self.body({"form": "ask"})
        elif self.take_word("CONSTRUCT"):
            q = {"form": "construct"}
            if self.at("{"):
                q["template"] = self.template()
                q = self.body(q)
            else:
                q = self.datasets(q)
                self.want_word("WHERE")
                here = self.i
                q["where"] = self.group()
                end = self.i
                self.i = here
                q["template"] = self.template()
                self.i = end
                q = self.modifiers(q)
        elif self.take_word("DESCRIBE"):
            q = {"form": "describe", "describe": [], "star": self.take("*")}
            while self.kind == "var" or self.at_iri():
                q["describe"].append(("var", self.var()) if self.kind == "var" else self.iri())
            q = self.datasets(q)
            q["where"] = self.group() if self.take_word("WHERE") or self.at("{") else []
            q = self.modifiers(q)
        else:
            self.fail("a query form")
        if self.kind != "end":
            self.fail("the end of the query")
        return q

    def template(self) -> list:
        self.in_template = True
        self.want("{")
        out = self.triples_block() if self.starts_triples() else []
        self.want("}")
        self.in_template = False
        return out

    def datasets(self, q: dict) -> dict:
        q |= {"from": [], "named": []}
        while self.take_word("FROM"):
            named = bool(self.take_word("NAMED"))
            q["named" if named else "from"].append(self.iri().v)
        return q

    def body(self, q: dict) -> dict:
        q = self.datasets(q)
        self.take_word("WHERE")
        q["where"] = self.group()
        return self.modifiers(q)

    def select_query(self, sub: bool = False) -> dict:
        self.want_word("SELECT")
        q: dict = {"form": "select", "distinct": False, "star": False, "select": []}
        mode = self.take_word("DISTINCT", "REDUCED")
        q["distinct"] = mode == "DISTINCT"
        if self.take("*"):
            q["star"] = True
        else:
            while self.kind == "var" or self.at("("):
                if self.kind == "var":
                    q["select"].append((None, self.var()))
                else:
                    self.next()
                    e = self.expression()
                    self.want_word("AS")
                    v = self.var()
                    self.want(")")
                    q["select"].append((e, v))
            if not q["select"]:
                self.fail("a projection")
        q = self.body(q)
        self.check_scope(q)
        return q

    def check_scope(self, q: dict) -> None:
        names = [v for _, v in q["select"]]
        if len(set(names)) < len(names):
            raise SparqlError("a variable is projected twice")
        inside = visible(q["where"])
        for e, v in q["select"]:
            if e is not None and v in inside:
                raise SparqlError(f"?{v} is in use already")
        grouped = q["group"] or any(e is not None and has_aggregate(e) for e, _ in q["select"]) or q["having"]
        if grouped and q["star"]:
            raise SparqlError("SELECT * with GROUP BY")
        if grouped:
            keys = {v or (e[1] if e[0] == "var" else None) for e, v in q["group"]}
            made = set()
            for e, v in q["select"]:
                if e is None and v not in keys:
                    raise SparqlError(f"?{v} is neither a group key nor an aggregate")
                if e is not None:
                    loose = outside_aggregates(e) - keys - made
                    if loose:
                        raise SparqlError(f"?{sorted(loose)[0]} is neither a group key nor within an aggregate")
                    made.add(v)

    def modifiers(self, q: dict) -> dict:
        q |= {"group": [], "having": [], "order": [], "limit": None, "offset": 0, "values": None}
        if self.take_word("GROUP"):
            self.want_word("BY")
            while True:
                if self.kind == "var":
                    q["group"].append((("var", self.var()), None))
                elif self.at("("):
                    self.next()
                    e = self.expression()
                    v = self.var() if self.take_word("AS") else None
                    self.want(")")
                    q["group"].append((e, v))
                elif (self.kind == "word" and not self.word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES")) or self.at_iri():
                    q["group"].append((self.primary(), None))
                else:
                    break
        if self.take_word("HAVING"):
            while self.at("(") or (self.kind == "word" and not self.word("ORDER", "LIMIT", "OFFSET", "VALUES")):
                q["having"].append(self.constraint())
        if self.take_word("ORDER"):
            self.want_word("BY")
            while True:
                way = self.take_word("ASC", "DESC")
                if way or self.at("("):
                    e = self.constraint()
                elif self.kind == "var":
                    e = ("var", self.var())
                elif (self.kind == "word" and not self.word("LIMIT", "OFFSET", "VALUES")) or self.at_iri():
                    e = self.primary()
                else:
                    break
                q["order"].append((e, way == "DESC"))
        while self.word("LIMIT", "OFFSET"):
            which = self.next()[1].lower()
            q[which] = int(self.next()[1])
        if self.take_word("VALUES"):
            q["values"] = self.values()
        return q

    # -- updates --------------------------------------------------------------
    def update(self) -> list[dict]:
        out = []
        while True:
            self.prologue()
            if self.kind == "end":
                return out
            out.append(self.operation())
            if not self.take(";"):
                if self.kind != "end":
                    self.fail("';'")
                return out

    def quads(self, ground: bool = False) -> list:
        """(s, p, o, graph or None) of a template or data block."""
        self.in_template = True
        self.want("{")
        out: list = []
        while not self.at("}"):
            if self.take_word("GRAPH"):
                name = ("var", self.var()) if self.kind == "var" else self.iri()
                self.want("{")
                if self.starts_triples():
                    out += [(*t, name) for t in self.triples_block()]
                self.want("}")
                self.take(".")
            else:
                out += [(*t, None) for t in self.triples_block()]
        self.want("}")
        self.in_template = False
        if ground and any(is_var(x) for t in out for x in t):
            raise SparqlError("a variable in a data block")
        return out

    def graph_ref(self):
        word = self.take_word("DEFAULT", "NAMED", "ALL")
        if word:
            return word
        self.take_word("GRAPH")
        return self.iri().v

    def operation(self) -> dict:
        if self.take_word("INSERT"):
            if self.take_word("DATA"):
                return {"op": "insert_data", "quads": self.quads(ground=True)}
            return self.modify({"op": "modify", "delete": [], "insert": self.quads(), "with": None})
        if self.take_word("DELETE"):
            if self.take_word("DATA"):
                return {"op": "delete_data", "quads": self.quads(ground=True)}
            if self.take_word("WHERE"):
                here = self.i
                where = self.group()
                end = self.i
                self.i = here
                delete = self.quads()
                self.i = end
                return {"op": "modify", "delete": delete, "insert": [], "with": None, "using": [], "named": [], "where": where}
            delete = self.quads()
            insert = self.quads() if self.take_word("INSERT") else []
            return self.modify({"op": "modify", "delete": delete, "insert": insert, "with": None})
        if self.take_word("WITH"):
            graph = self.iri().v
            op = self.operation()
            op["with"] = graph
            return op
        word = self.want_word("LOAD", "CLEAR", "DROP", "CREATE", "COPY", "MOVE", "ADD").lower()
        silent = bool(self.take_word("SILENT"))
        if word == "load":
            source = self.iri().v
            into = None
            if self.take_word("INTO"):
                self.want_word("GRAPH")
                into = self.iri().v
            return {"op": "load", "source": source, "into": into, "silent": silent}
        if word in ("clear", "drop", "create"):
            return {"op": word, "graph": self.graph_ref(), "silent": silent}
        source = self.graph_ref()
        self.want_word("TO")
        return {"op": word, "source": source, "target": self.graph_ref(), "silent": silent}

    def modify(self, op: dict) -> dict:
        op |= {"using": [], "named": []}
        while self.take_word("USING"):
            named = bool(self.take_word("NAMED"))
            op["named" if named else "using"].append(self.iri().v)
        self.want_word("WHERE")
        op["where"] = self.group()
        return op


def has_aggregate(e) -> bool:
    if e[0] == "agg":
        return True
    if e[0] in ("op", "call", "fn"):
        return any(has_aggregate(x) for x in e[2])
    if e[0] == "in":
        return has_aggregate(e[1]) or any(has_aggregate(x) for x in e[2])
    return False


def outside_aggregates(e) -> set:
    if e[0] == "var":
        return {e[1]}
    if e[0] in ("op", "call", "fn"):
        return set().union(*(outside_aggregates(x) for x in e[2])) if e[2] else set()
    if e[0] == "in":
        return outside_aggregates(e[1]).union(*(outside_aggregates(x) for x in e[2]))
    return set()


def variables(e) -> set:
    """Variables of an expression, those of EXISTS groups included."""
    if e[0] == "var":
        return {e[1]}
    if e[0] in ("op", "call", "fn"):
        return set().union(*(variables(x) for x in e[2])) if e[2] else set()
    if e[0] == "agg":
        return variables(e[3]) if e[3] is not None else set()
    if e[0] == "in":
        return variables(e[1]).union(*(variables(x) for x in e[2]))
    if e[0] == "exists":
        return visible(e[1])
    return set()


def visible(group: list) -> set:
    """Variables that a group can bind."""
    out: set = set()
    for e in group:
        if e[0] == "triples":
            for t in e[1]:
                out |= {v for x in t for v in _vars_of(x)}
        elif e[0] == "bind":
            out.add(e[2])
        elif e[0] in ("optional", "lateral", "group"):
            out |= visible(e[1])
        elif e[0] == "union":
            out |= set().union(*map(visible, e[1]))
        elif e[0] == "values":
            out |= set(e[1])
        elif e[0] in ("graph", "service"):
            out |= visible(e[2]) | ({e[1][1]} if is_var(e[1]) else set())
        elif e[0] == "select":
            q = e[1]
            out |= visible(q["where"]) if q["star"] else {v for _, v in q["select"]}
    return out


def _vars_of(x) -> set:
    if is_var(x):
        return {x[1]}
    if isinstance(x, tuple) and not isinstance(x, Term) and x and x[0] == "tt":
        return set().union(*(_vars_of(y) for y in x[1:]))
    return set()


def parse_query(text: str, prefixes: dict[str, str] | None = None) -> dict:
    return Parser(text, prefixes).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None) -> list[dict]:
    return Parser(text, prefixes).update()
