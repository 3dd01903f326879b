"""N3 built-in predicates as columns: tests of (subject, object), and functions from a subject to its object.

A subject list arrives as several values.  ``register_builtin`` adds predicates of one's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.functions.expressions import FUNCTIONS, arithmetic, compare, equals
from lattica.functions.values import Val, lit
from lattica.terms import LITERAL, term_col

SWAP = "http://www.w3.org/2000/10/swap/"
MATH, STRING, LOG, CRYPTO, LIST, TIME = (SWAP + x for x in ("math#", "string#", "log#", "crypto#", "list#", "time#"))

TESTS: dict[str, Callable[[Val, Val], Column]] = {}
RESULTS: dict[str, Callable[..., Val]] = {}


def register_builtin(uri: str, build: Callable, test: bool = False) -> None:
    (TESTS if test else RESULTS)[uri] = build


def is_builtin(uri: str) -> bool:
    return uri in TESTS or uri in RESULTS or uri in (LIST + "member", LIST + "in")


def _s(v: Val) -> Column:
    return V.lexical(v)


def _n(v: Val) -> Column:
    return V.number(v)


def _str(c: Column) -> Val:
    return lit(c, "string")


def _num(c: Column) -> Val:
    return lit(c.cast("double"), "double")


def _round_like(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return lambda v: lit(f(_n(v)).cast("bigint"), "integer")


def _fold(o: str):
    def apply(*vs: Val) -> Val:
        out = vs[0]
        for v in vs[1:]:
            out = arithmetic(o, out, v)
        return out

    return apply


def _many(f: Callable[..., Column]):
    return lambda *vs: _num(f(*[_n(v) for v in vs]) if len(vs) > 1 else _n(vs[0]))


for _name, _o in (("greaterThan", ">"), ("lessThan", "<"), ("notGreaterThan", "<="), ("notLessThan", ">=")):
    TESTS[MATH + _name] = lambda a, b, o=_o: compare(o, a, b)
    TESTS[STRING + _name] = lambda a, b, o=_o: {">": _s(a) > _s(b), "<": _s(a) < _s(b), "<=": _s(a) <= _s(b), ">=": _s(a) >= _s(b)}[o]
TESTS |= {
    MATH + "equalTo": lambda a, b: F.abs(_n(a) - _n(b)) < 1e-10,
    MATH + "notEqualTo": lambda a, b: F.abs(_n(a) - _n(b)) >= 1e-10,
    STRING + "contains": lambda a, b: F.contains(_s(a), _s(b)),
    STRING + "startsWith": lambda a, b: F.startswith(_s(a), _s(b)),
    STRING + "endsWith": lambda a, b: F.endswith(_s(a), _s(b)),
    STRING + "matches": lambda a, b: F.rlike(_s(a), _s(b)),
    STRING + "notMatches": lambda a, b: ~F.rlike(_s(a), _s(b)),
    STRING + "containsIgnoringCase": lambda a, b: F.contains(F.lower(_s(a)), F.lower(_s(b))),
    STRING + "equalIgnoringCase": lambda a, b: F.lower(_s(a)) == F.lower(_s(b)),
    STRING + "notEqualIgnoringCase": lambda a, b: F.lower(_s(a)) != F.lower(_s(b)),
    STRING + "containsRoughly": lambda a, b: F.contains(_rough(a), _rough(b)),
    STRING + "notContainsRoughly": lambda a, b: ~F.contains(_rough(a), _rough(b)),
    LOG + "equalTo": lambda a, b: F.coalesce(equals(a, b), F.lit(False)),
    LOG + "notEqualTo": lambda a, b: ~F.coalesce(equals(a, b), F.lit(False)),
    LOG + "bound": lambda a, b: a.col.isNotNull(),
}


def _rough(v: Val) -> Column:
    return F.trim(F.regexp_replace(F.lower(_s(v)), r"\s+", " "))


def _format(*vs: Val) -> Val:
    out = _s(vs[0])
    for v in vs[1:]:
        at = F.instr(out, "%s")
        out = F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), _s(v), F.substring(out, at + 2, F.length(out)))).otherwise(out)
    return _str(out)


RESULTS |= {MATH + n: (lambda v, f=f: _num(f(_n(v)))) for n, f in {"sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "degrees": F.degrees, "radians": F.radians}.items()}
RESULTS |= {
    MATH + "negation": lambda v: arithmetic("*", lit(F.lit(-1).cast("bigint"), "integer"), v),
    MATH + "absoluteValue": FUNCTIONS["ABS"],
    MATH + "floor": _round_like(F.floor),
    MATH + "ceiling": _round_like(F.ceil),
    MATH + "rounded": _round_like(lambda c: F.floor(c + 0.5)),
    MATH + "roundedTo": lambda v, d: _num(F.floor(_n(v) * F.pow(F.lit(10.0), _n(d)) + 0.5) / F.pow(F.lit(10.0), _n(d))),
    MATH + "atan2": lambda y, x: _num(F.atan2(_n(y), _n(x))),
    MATH + "sum": _fold("+"),
    MATH + "product": _fold("*"),
    MATH + "difference": _fold("-"),
    MATH + "quotient": _fold("/"),
    MATH + "remainder": lambda a, b: lit(F.when(_n(b) != 0, _n(a) % _n(b)).cast("bigint"), "integer"),
    MATH + "exponentiation": lambda a, b: _num(F.pow(_n(a), _n(b))),
    MATH + "logarithm": lambda a, b: _num(F.ln(_n(a)) / F.ln(_n(b))),
    MATH + "max": _many(F.greatest),
    MATH + "min": _many(F.least),
    STRING + "length": lambda v: lit(F.char_length(_s(v)).cast("bigint"), "integer"),
    STRING + "upperCase": lambda v: _str(F.upper(_s(v))),
    STRING + "lowerCase": lambda v: _str(F.lower(_s(v))),
    STRING + "concatenation": lambda *vs: _str(F.concat(*[_s(v) for v in vs])),
    STRING + "replace": lambda v, p, r: _str(F.regexp_replace(_s(v), _s(p), _s(r))),
    STRING + "scrape": lambda v, p: _str(F.when(F.rlike(_s(v), _s(p)), F.element_at(F.regexp_extract_all(_s(v), _s(p), F.lit(1)), 1))),
    STRING + "substring": lambda v, a, *n: _str(F.substring(_s(v), (_n(a) + 1).cast("int"), (_n(n[0]) if n else F.lit(2**31 - 1)).cast("int"))),
    STRING + "join": lambda *vs: _str(F.concat_ws("", *[_s(v) for v in vs])),
    STRING + "format": _format,
    STRING + "capitalize": lambda v: _str(F.concat(F.upper(F.substring(_s(v), 1, 1)), F.substring(_s(v), F.lit(2), F.length(_s(v))))),
    STRING + "encodeForURI": lambda v: FUNCTIONS["ENCODE_FOR_URI"](_str(_s(v))),
    STRING + "encodeForFragID": lambda v: FUNCTIONS["ENCODE_FOR_URI"](_str(_s(v))),
    LOG + "uri": lambda v: _str(_s(v)),
    LOG + "langlit": lambda v, g: Val("any", term_col(LITERAL, _s(v), "", F.lower(_s(g)))),
    LOG + "dtlit": lambda v, d: Val("any", term_col(LITERAL, _s(v), _s(d))),
    LOG + "localName": lambda v: _str(F.regexp_extract(_s(v), r"([^/#]*)$", 1)),
    LOG + "namespace": lambda v: _str(F.regexp_extract(_s(v), r"^(.*[/#])", 1)),
    LOG + "racine": lambda v: Val("iri", F.regexp_extract(_s(v), r"^([^#]*)", 1)),
    LOG + "uuid": lambda v: _str(F.uuid()),
    LOG + "skolem": lambda *vs: Val("iri", F.concat(F.lit("http://example.org/.well-known/genid/"), F.sha2(F.concat_ws("\x1f", *[_s(v) for v in vs]), 256))),
    LIST + "first": lambda *vs: vs[0],
    LIST + "last": lambda *vs: vs[-1],
    LIST + "length": lambda *vs: lit(F.lit(len(vs)).cast("bigint"), "integer"),
    TIME + "localTime": lambda v: lit(F.current_timestamp(), "dateTime"),
    TIME + "inSeconds": lambda v: lit(F.unix_timestamp(V.moment(v)), "integer"),
    TIME + "dayOfWeek": lambda v: lit((F.dayofweek(V.moment(v)) - 1).cast("bigint"), "integer"),
    TIME + "timeZone": FUNCTIONS["TZ"],
}
RESULTS |= {CRYPTO + n: FUNCTIONS[f] for n, f in (("sha", "SHA1"), ("sha1", "SHA1"), ("md5", "MD5"), ("sha256", "SHA256"), ("sha512", "SHA512"))}
RESULTS |= {TIME + n: FUNCTIONS[f] for n, f in (("year", "YEAR"), ("month", "MONTH"), ("day", "DAY"), ("hour", "HOURS"), ("minute", "MINUTES"))} | {TIME + "second": lambda v: lit(F.second(V.moment(v)).cast("bigint"), "integer")}
