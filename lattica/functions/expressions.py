"""SPARQL expressions to Spark columns.

Errors are nulls, so ``&``, ``|`` and ``~`` on nullable booleans are SPARQL's three-valued logic as they are.
Typed operands compile to native expressions; terms of unknown type take the general form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import geo
from lattica.functions import values as V
from lattica.functions.values import NUMERIC, Val, lit
from lattica.terms import BNODE, IRI, LITERAL, RDF, TRIPLE, XSD, n3_col, term_col

REGISTRY: dict[str, Callable[..., Val]] = {}


def register_function(uri: str, build: Callable[..., Val]) -> None:
    """Make ``uri`` callable in expressions: ``build`` gets the arguments' values and returns a value."""
    REGISTRY[uri] = build


def null(kind: str = "string", dt: str = "string") -> Val:
    return lit(F.lit(None).cast(kind), dt)


class Expressions:
    """Compiles expressions over the variables of one solution."""

    def __init__(self, variables: dict[str, Val], exists: Callable | None = None, stash: dict | None = None, base: str = ""):
        self.variables, self.exists, self.stash, self.base = variables, exists, stash or {}, base

    def truth(self, e) -> Column:
        return V.truth(self.value(e))

    def value(self, e) -> Val:
        key = repr(e)
        if key in self.stash:
            return self.stash[key]
        tag = e[0]
        if tag == "term":
            return V.constant(e[1])
        if tag == "var":
            return self.variables.get(e[1], null())
        if tag == "op":
            return self.operator(e[1], e[2])
        if tag == "in":
            return self.membership(e)
        if tag == "exists":
            if self.exists is None:
                raise ValueError("EXISTS is not allowed here")
            return lit(self.exists(e), "boolean")
        if tag == "fn":
            return self.named(e[1], [self.value(a) for a in e[2]])
        if tag == "call":
            return self.call(e[1], e[2])
        raise ValueError(f"cannot evaluate {e[0]}")

    # -- operators ------------------------------------------------------------
    def operator(self, o: str, args: list) -> Val:
        if o in ("||", "&&"):
            out = self.truth(args[0])
            for a in args[1:]:
                out = (out | self.truth(a)) if o == "||" else (out & self.truth(a))
            return lit(out, "boolean")
        if o == "!":
            return lit(~self.truth(args[0]), "boolean")
        x = self.value(args[0])
        if o in ("neg", "pos"):
            return arithmetic("*", lit(F.lit(-1 if o == "neg" else 1).cast("bigint"), "integer"), x)
        y = self.value(args[1])
        if o == "=":
            return lit(equals(x, y), "boolean")
        if o == "!=":
            return lit(~equals(x, y), "boolean")
        if o in ("<", ">", "<=", ">="):
            return lit(compare(o, x, y), "boolean")
        return arithmetic(o, x, y)

    def membership(self, e) -> Val:
        x = self.value(e[1])
        out = F.lit(False)
        for item in e[2]:
            out = out | equals(x, self.value(item))
        return lit(~out if e[3] else out, "boolean")

    # -- functions ------------------------------------------------------------
    def named(self, uri: str, args: list[Val]) -> Val:
        if uri in REGISTRY:
            return REGISTRY[uri](*args)
        if uri.startswith(XSD) and len(args) == 1:
            return cast(args[0], uri.removeprefix(XSD))
        if uri.startswith(geo.GEOF):
            return geo.call(uri.removeprefix(geo.GEOF), args)
        return null()

    def call(self, name: str, args: list) -> Val:
        special = getattr(self, f"_{name.lower()}", None)
        if special is not None:
            return special(args)
        f = FUNCTIONS.get(name)
        return f(*[self.value(a) for a in args]) if f else null()

    def _bound(self, args):
        v = self.variables.get(args[0][1])
        return lit(v.col.isNotNull() if v is not None else F.lit(False), "boolean")

    def _if(self, args):
        test = self.truth(args[0])
        a, b = V.unified([self.value(args[1]), self.value(args[2])])
        return a.at(F.when(test, a.col).when(~test, b.col))

    def _coalesce(self, args):
        found = V.unified([self.value(a) for a in args])
        return found[0].at(F.coalesce(*[v.col for v in found]))

    def _iri(self, args):
        v = self.value(args[0])
        if v.kind == "iri":
            return v
        text = V.lexical(v)
        if self.base:
            text = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(self.base), text))
        return Val("iri", text)

    _uri = _iri

    def _bnode(self, args):
        if not args:
            return Val("any", term_col(BNODE, F.uuid()))
        return Val("any", term_col(BNODE, F.concat(F.lit("b"), F.md5(F.concat(V.lexical(self.value(args[0])), F.lit("#"), F.monotonically_increasing_id().cast("string"))))))


def equals(x: Val, y: Val) -> Column:
    """``=``: the same term, or the same value; different values of known types differ; else an error."""
    if x.kind == y.kind == "iri":
        if x.template == y.template:
            return x.col == y.col
        return _template_equal(x, y) if (not x.template or not y.template) else F.when(x.col.isNotNull() & y.col.isNotNull(), F.lit(False))
    if x.kind == y.kind == "lit":
        if x.dt in NUMERIC and y.dt in NUMERIC:
            return _no_nan(x, y, x.col == y.col)
        if x.dt == y.dt:
            return x.col == y.col
        if {x.dt, y.dt} <= {"dateTime", "date"}:
            return F.when(x.col.isNotNull() & y.col.isNotNull(), F.lit(False))
        return F.when(x.col.isNotNull() & y.col.isNotNull(), F.lit(False))
    if "any" not in (x.kind, y.kind):
        return F.when(x.col.isNotNull() & y.col.isNotNull(), F.lit(False))
    a, b = V.to_term(x), V.to_term(y)
    nx, ny, tx, ty = V.number(x), V.number(y), V.moment(x), V.moment(y)
    known = lambda t: (t["k"] != LITERAL) | (t["dt"] == "") | t["dt"].isin([*V.NUMERIC_IRIS, XSD + "boolean", XSD + "dateTime", XSD + "date"])
    bool_of = lambda t: F.when(t["dt"] == XSD + "boolean", t["v"].isin("true", "1"))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None))
        .when(nx.isNotNull() & ny.isNotNull(), F.when(F.isnan(nx) | F.isnan(ny), F.lit(None)).otherwise(nx == ny))
        .when(a == b, True)
        .when(bool_of(a).isNotNull() & bool_of(b).isNotNull(), bool_of(a) == bool_of(b))
        .when(tx.isNotNull() & ty.isNotNull(), tx == ty)
        .when(known(a) & known(b), False)
        .cast("boolean")
    )


def _template_equal(x: Val, y: Val) -> Column:
    return V.iri_text(x) == V.iri_text(y)


def _no_nan(x: Val, y: Val, test: Column) -> Column:
    checks = [F.isnan(v.col) for v in (x, y) if v.dt in ("double", "float", "decimal")]
    for c in checks:
        test = F.when(~c, test)
    return test


_COMPARE = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def compare(o: str, x: Val, y: Val) -> Column:
    f = _COMPARE[o]
    if x.kind == y.kind == "lit":
        if x.dt in NUMERIC and y.dt in NUMERIC:
            return _no_nan(x, y, f(x.col, y.col))
        if x.dt == y.dt or {x.dt, y.dt} <= {"dateTime", "date"}:
            return f(x.col, y.col)
        return F.lit(None).cast("boolean")
    if "iri" in (x.kind, y.kind):
        return F.lit(None).cast("boolean")
    nx, ny, tx, ty = V.number(x), V.number(y), V.moment(x), V.moment(y)
    sx, sy = (F.when(v.col["lang"] == "", V.string(v)) if v.kind == "any" else V.string(v) for v in (x, y))
    return F.coalesce(F.when(~F.isnan(nx) & ~F.isnan(ny), f(nx, ny)), f(sx, sy), f(tx, ty))


def promoted(x: Val, y: Val) -> str:
    return NUMERIC[max(NUMERIC.index(x.dt), NUMERIC.index(y.dt))]


def arithmetic(o: str, x: Val, y: Val) -> Val:
    if x.kind == y.kind == "lit" and x.dt in NUMERIC and y.dt in NUMERIC:
        dt = promoted(x, y)
        if o == "/":
            floating = dt in ("float", "double")
            a, b = x.col.cast("double"), y.col.cast("double")
            zero = F.when(a == 0, float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf")) if floating else F.lit(None).cast("double")
            return lit(F.when(b != 0, F.try_divide(a, b)).when(b == 0, zero), dt if floating else "decimal")
        a, b = (v.col.cast("double" if dt != "integer" else "bigint") for v in (x, y))
        return lit({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[o](a, b), dt)
    if x.kind == "lit" and x.dt == "dateTime" and o in "+-" and y.kind in ("any", "lit"):
        if y.dt in ("dateTime", "date"):
            seconds = x.col.cast("double") - y.col.cast("timestamp").cast("double")
            return Val("any", term_col(LITERAL, duration_text(seconds), XSD + "dayTimeDuration"))
        shift = duration_seconds(y)
        return lit((x.col.cast("double") + (shift if o == "+" else -shift)).cast("timestamp"), "dateTime")
    if "iri" in (x.kind, y.kind):
        return null("double", "double")
    a, b = V.number(x), V.number(y)
    both = V.is_integer(x) & V.is_integer(y)
    r = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[o]()
    dt = F.when(both, XSD + ("decimal" if o == "/" else "integer")).otherwise(XSD + "double")
    return Val("any", term_col(LITERAL, V.double_text(r), dt))


def duration_seconds(v: Val) -> Column:
    """Seconds of an xsd duration; a year counts 365 days and a month 30."""
    t = V.lexical(v)

    def part(rx: str) -> Column:
        return F.coalesce(F.regexp_extract(t, rx, 1).try_cast("double"), F.lit(0.0))

    days = part(r"(\d+)Y") * 365 + part(r"P[^T]*?(\d+)M") * 30 + part(r"(\d+)D")
    seconds = days * 86400 + part(r"(\d+)H") * 3600 + part(r"T.*?(\d+)M") * 60 + part(r"([\d.]+)S")
    return F.when(t.rlike(r"^-?P"), F.when(t.startswith("-"), -seconds).otherwise(seconds))


def duration_text(s: Column) -> Column:
    a = F.abs(s)
    d, h, m, x = F.floor(a / 86400), F.floor(a / 3600) % 24, F.floor(a / 60) % 60, a % 60
    sign = F.when(s < 0, "-").otherwise("")
    time = F.concat(*[F.when(n > 0, F.concat(V.double_text(n.cast("double")), F.lit(u))).otherwise("") for n, u in ((h, "H"), (m, "M"), (x, "S"))])
    day = F.when(d > 0, F.concat(d.cast("string"), F.lit("D"))).otherwise("")
    return F.when(a == 0, "PT0S").otherwise(F.concat(sign, F.lit("P"), day, F.when(time != "", F.concat(F.lit("T"), time)).otherwise("")))


def cast(v: Val, to: str) -> Val:
    """XPath casts; what can't be cast is an error."""
    if to in V.INTEGERS:
        if v.kind == "lit" and v.dt in NUMERIC:
            return lit(F.when(~F.isnan(v.col.cast("double")), v.col.try_cast("bigint")), "integer")
        if v.kind == "lit" and v.dt == "boolean":
            return lit(v.col.cast("bigint"), "integer")
        t = F.trim(V.lexical(v))
        n = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
        if v.kind == "any":
            n = F.coalesce(n, F.when(V.number(v).isNotNull(), V.number(v).try_cast("bigint")))
        return lit(n, "integer")
    if to in ("decimal", "double", "float"):
        if v.kind == "lit" and v.dt in (*NUMERIC, "boolean"):
            return lit(v.col.cast("double"), to)
        t = F.trim(V.lexical(v))
        good = t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)" + ("$" if to == "decimal" else r"([eE][+-]?\d+)?$"))
        if to != "decimal":
            return lit(F.when(good, t.try_cast("double")).when(t == "INF", float("inf")).when(t == "-INF", float("-inf")).when(t == "NaN", float("nan")), to)
        return lit(F.when(good, t.try_cast("double")), to)
    if to == "boolean":
        if v.kind == "lit" and v.dt in NUMERIC:
            return lit((v.col != 0) & ~F.isnan(v.col.cast("double")), "boolean")
        if v.kind == "lit" and v.dt == "boolean":
            return v
        t = F.trim(V.lexical(v))
        return lit(F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False), "boolean")
    if to == "string":
        return lit(V.lexical(v), "string")
    if to == "dateTime":
        return lit(v.col.cast("timestamp") if v.kind == "lit" and v.dt in ("dateTime", "date") else F.try_to_timestamp(V.lexical(v)), "dateTime")
    if to == "date":
        return lit(v.col.cast("date") if v.kind == "lit" and v.dt in ("dateTime", "date") else F.substring(V.lexical(v), 1, 10).try_cast("date"), "date")
    return null()


# -- builtins -------------------------------------------------------------------
def _like(v: Val, col: Column) -> Val:
    """A string result that keeps the language of ``v``."""
    if v.kind == "any":
        return Val("any", F.when(V.string(v).isNotNull(), term_col(LITERAL, col, "", v.col["lang"], v.col["dir"])))
    return lit(col, "string")


def _text(v: Val) -> Column:
    """The text of a string argument; native strings as they are."""
    return V.string(v)


def _str(v):
    return lit(V.lexical(v), "string")


def _concat(*vs):
    return lit(F.concat(*[_text(v) for v in vs]), "string") if vs else lit(F.lit(""), "string")


def _substr(v, start, length=None):
    s = F.rint(V.number(start))
    text = _text(v)
    first = F.greatest(s, F.lit(1.0)).cast("int")
    if length is None:
        return _like(v, F.substring(text, first, F.lit(2**31 - 1)))
    end = s + F.rint(V.number(length))
    return _like(v, F.substring(text, first, F.greatest(F.least(end - first, F.lit(2.0**31 - 1)), F.lit(0.0)).cast("int")))


def _before(v, n):
    t, x = _text(v), _text(n)
    at = F.position(x, t)
    return lit(F.when(at > 0, F.substring(t, F.lit(1), at - 1)).when(t.isNotNull() & x.isNotNull(), ""), "string")


def _after(v, n):
    t, x = _text(v), _text(n)
    at = F.position(x, t)
    return lit(F.when(at > 0, F.substring(t, (at + F.length(x)).cast("int"), F.lit(2**31 - 1))).when(t.isNotNull() & x.isNotNull(), ""), "string")


def _flags(pattern: Column, flags: Val | None) -> Column:
    if flags is None:
        return pattern
    f = flags.col if flags.kind == "lit" else V.lexical(flags)
    kept = F.regexp_replace(f, "[^imsx]", "")
    quoted = F.when(F.contains(f, F.lit("q")), F.concat(F.lit(r"\Q"), pattern, F.lit(r"\E"))).otherwise(pattern)
    return F.when(kept == "", quoted).otherwise(F.concat(F.lit("(?"), kept, F.lit(")"), quoted))


def _regex(v, p, flags=None):
    return lit(F.rlike(_text(v), _flags(_text(p), flags)), "boolean")


def _replace(v, p, r, flags=None):
    return _like(v, F.regexp_replace(_text(v), _flags(_text(p), flags), _text(r)))


def _encode(v):
    t = F.url_encode(_text(v))
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return lit(t, "string")


def _lang(v):
    if v.kind == "iri":
        return null()
    return lit(F.when(v.col["k"] == LITERAL, v.col["lang"]) if v.kind == "any" else F.when(v.col.isNotNull(), F.lit("")), "string")


def _datatype(v):
    if v.kind == "iri":
        return Val("iri", F.lit(None).cast("string"))
    if v.kind == "lit":
        return Val("iri", F.when(v.col.isNotNull(), F.lit(XSD + v.dt)))
    t = v.col
    return Val("iri", F.when(t["k"] == LITERAL, F.when(t["dir"] != "", RDF + "dirLangString").when(t["lang"] != "", RDF + "langString").when(t["dt"] == "", XSD + "string").otherwise(t["dt"])))


def _kind_test(k: int, kinds: str):
    def test(v: Val) -> Val:
        if v.kind == "any":
            return lit(F.coalesce(v.col["k"] == k, F.lit(False)), "boolean")
        return lit(v.col.isNotNull() if v.kind == kinds else F.lit(False), "boolean")

    return test


def _numeric(f, keep: bool = True):
    def apply(v: Val) -> Val:
        if v.kind == "lit" and v.dt in NUMERIC:
            r = f(v.col)
            return lit(r.cast("bigint") if v.dt == "integer" else r.cast("double"), v.dt)
        n = f(V.number(v)).cast("double")
        return Val("any", term_col(LITERAL, V.double_text(n), v.col["dt"])) if v.kind == "any" else null("double", "double")

    return apply


def _part(f):
    def apply(v: Val) -> Val:
        return lit(f(V.moment(v)).cast("bigint"), "integer")

    return apply


def _hash(f):
    return lambda v: lit(f(F.encode(_text(v), "UTF-8")), "string")


def _tz(v):
    t = V.lexical(v)
    return lit(F.when(V.moment(v).isNotNull(), F.regexp_extract(t, r"(Z|[+-]\d\d:\d\d)$", 1)), "string")


def _timezone(v):
    z = V.lexical(_tz(v))
    h, m = F.regexp_extract(z, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(z, r":(\d\d)", 1).try_cast("int")
    text = F.when(z == "Z", "PT0S").when(z != "", F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise("")))
    return Val("any", term_col(LITERAL, text, XSD + "dayTimeDuration"))


def _contains_text(v, q):
    """Every token of the query is a token of the text; ``tok*`` is a prefix."""
    t = F.lower(V.lexical(v))
    tokens = F.split(t, r"[\s\p{Punct}]+")
    wanted = F.filter(F.split(F.lower(_text(q)), r"\s+"), lambda x: x != "")
    return lit(F.forall(wanted, lambda w: F.when(w.endswith("*"), F.exists(tokens, lambda x: F.startswith(x, F.rtrim(w, F.lit("*"))))).otherwise(F.contains(t, w))), "boolean")


def _same_term(x, y):
    if x.like(y):
        return lit(x.col == y.col, "boolean")
    return lit(V.to_term(x) == V.to_term(y), "boolean")


def _triple_part(n: int):
    rx = r'<<\( (<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"\S*|<<.*>>) (<[^>]*>) (.*) \)>>'

    def apply(v: Val) -> Val:
        if v.parts:  # nothing to parse; a triple with an unbound part is none
            whole = F.lit(True)
            for i, x in enumerate(v.parts):
                whole = whole & x.col.isNotNull() if i != n - 1 else whole
            part = v.parts[n - 1]
            return part.at(F.when(whole, part.col))
        if v.kind != "any":
            return null()
        text = let(v.col, lambda t: F.when(t["k"] == TRIPLE, F.regexp_extract(t["v"], rx, n)))
        return Val("any", let(text, parse_n3))

    return apply


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` in which ``x`` stands once, however often ``f`` names it: nested calls would multiply the expression."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def parse_n3(text: Column) -> Column:
    """The TERM of an N-Triples token."""
    lexical = F.regexp_extract(text, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        lexical = F.replace(lexical, F.lit(a), F.lit(b))
    dt, lang = F.regexp_extract(text, r'"\^\^<([^>]*)>$', 1), F.regexp_extract(text, r'"@([A-Za-z0-9-]+?)(?:--(?:ltr|rtl))?$', 1)
    way = F.regexp_extract(text, r'"@[A-Za-z0-9-]+--(ltr|rtl)$', 1)
    return (
        F.when(text.startswith("<<"), term_col(TRIPLE, text))
        .when(text.startswith("<"), term_col(IRI, F.substring(text, F.lit(2), F.length(text) - 2)))
        .when(text.startswith("_:"), term_col(BNODE, F.substring(text, F.lit(3), F.length(text))))
        .when(text.startswith('"'), term_col(LITERAL, lexical, F.when(dt == XSD + "string", "").otherwise(dt), F.lower(lang), way))
    )


def _triple(s, p, o):
    return Val("any", parts=(s, p, o), col=term_col(TRIPLE, F.concat(F.lit("<<( "), n3_col(V.to_term(s)), F.lit(" "), n3_col(V.to_term(p)), F.lit(" "), n3_col(V.to_term(o)), F.lit(" )>>"))))


def _langmatches(tag, rng):
    t, r = F.lower(_text(tag)), F.lower(_text(rng))
    return lit(F.when(r == "*", t != "").otherwise((t == r) | F.startswith(t, F.concat(r, F.lit("-")))), "boolean")


FUNCTIONS: dict[str, Callable[..., Val]] = {
    "STR": _str,
    "STRLEN": lambda v: lit(F.char_length(_text(v)).cast("bigint"), "integer"),
    "UCASE": lambda v: _like(v, F.upper(_text(v))),
    "LCASE": lambda v: _like(v, F.lower(_text(v))),
    "CONCAT": _concat,
    "CONTAINS": lambda v, x: lit(F.contains(_text(v), _text(x)), "boolean"),
    "STRSTARTS": lambda v, x: lit(F.startswith(_text(v), _text(x)), "boolean"),
    "STRENDS": lambda v, x: lit(F.endswith(_text(v), _text(x)), "boolean"),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "SUBSTR": _substr,
    "REPLACE": _replace,
    "ENCODE_FOR_URI": _encode,
    "LANG": _lang,
    "DATATYPE": _datatype,
    "STRDT": lambda v, d: Val("any", term_col(LITERAL, _text(v), F.when(V.lexical(d) == XSD + "string", "").otherwise(V.lexical(d)))),
    "STRLANG": lambda v, g: Val("any", term_col(LITERAL, _text(v), "", F.lower(V.lexical(g)))),
    "STRLANGDIR": lambda v, g, d: Val("any", term_col(LITERAL, _text(v), "", F.lower(V.lexical(g)), V.lexical(d))),
    "LANGDIR": lambda v: lit(v.col["dir"] if v.kind == "any" else F.lit(""), "string"),
    "HASLANG": lambda v: lit(F.coalesce(v.col["lang"] != "", F.lit(False)) if v.kind == "any" else F.lit(False), "boolean"),
    "HASLANGDIR": lambda v: lit(F.coalesce(v.col["dir"] != "", F.lit(False)) if v.kind == "any" else F.lit(False), "boolean"),
    "LANGMATCHES": _langmatches,
    "SAMETERM": _same_term,
    "SAMEVALUE": lambda x, y: lit(equals(x, y), "boolean"),
    "REGEX": _regex,
    "ISIRI": _kind_test(IRI, "iri"),
    "ISURI": _kind_test(IRI, "iri"),
    "ISBLANK": _kind_test(BNODE, "bnode"),
    "ISLITERAL": _kind_test(LITERAL, "lit"),
    "ISTRIPLE": _kind_test(TRIPLE, "triple"),
    "ISNUMERIC": lambda v: lit(V.number(v).isNotNull(), "boolean"),
    "TRIPLE": _triple,
    "SUBJECT": _triple_part(1),
    "PREDICATE": _triple_part(2),
    "OBJECT": _triple_part(3),
    "ABS": _numeric(F.abs),
    "CEIL": _numeric(F.ceil),
    "FLOOR": _numeric(F.floor),
    "ROUND": _numeric(lambda c: F.floor(c + 0.5)),
    "RAND": lambda: lit(F.rand(), "double"),
    "NOW": lambda: lit(F.date_trunc("second", F.current_timestamp()), "dateTime"),
    "YEAR": _part(F.year),
    "MONTH": _part(F.month),
    "DAY": _part(F.dayofmonth),
    "HOURS": _part(F.hour),
    "MINUTES": _part(F.minute),
    "SECONDS": lambda v: lit((F.second(V.moment(v)) + (F.unix_micros(V.moment(v)) % 1_000_000) / 1e6).cast("double"), "decimal"),
    "TZ": _tz,
    "TIMEZONE": _timezone,
    "ADJUST": lambda v, *_: v,
    "MD5": _hash(F.md5),
    "SHA1": _hash(F.sha1),
    "SHA256": _hash(lambda c: F.sha2(c, 256)),
    "SHA384": _hash(lambda c: F.sha2(c, 384)),
    "SHA512": _hash(lambda c: F.sha2(c, 512)),
    "UUID": lambda: Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: lit(F.uuid(), "string"),
    "CONTAINS_TEXT": _contains_text,
}
