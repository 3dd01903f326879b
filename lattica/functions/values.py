"""Values of a plan: a Spark column with what is known of its type at compile time.

kind ``iri``  an IRI; ``template`` (``http://.../{}``) says the column is only its key
kind ``lit``  a literal of one datatype, as a native column (long, double, boolean, string, timestamp, date)
kind ``any``  a TERM struct

A null column is an unbound variable and, in expressions, a type error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.terms import IRI, LITERAL, XSD, Term, term_col

NUMERIC = ("integer", "decimal", "float", "double")
#: The integer types derived from xsd:integer.
INTEGERS = ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "nonPositiveInteger", "negativeInteger", "positiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
NUMERIC_IRIS = [XSD + x for x in (*INTEGERS, "decimal", "float", "double")]
NATIVE = {"integer": "bigint", "decimal": "double", "float": "double", "double": "double", "boolean": "boolean", "string": "string", "dateTime": "timestamp", "date": "date"}


@dataclass(frozen=True)
class Val:
    kind: str
    col: Column
    dt: str = ""
    template: str = ""
    parts: tuple = ()  # of a triple term that the plan itself has put together: its subject, predicate and object

    def like(self, other: Val) -> bool:
        """Whether equal columns mean equal terms."""
        return (self.kind, self.dt, self.template) == (other.kind, other.dt, other.template)

    def at(self, col: Column) -> Val:
        return Val(self.kind, col, self.dt, self.template)


def lit(col: Column, dt: str) -> Val:
    return Val("lit", col, dt)


def from_spark(col: Column, kind: T.DataType) -> Val:
    """A native column as a literal."""
    if isinstance(kind, T.BooleanType):
        return lit(col, "boolean")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return lit(col.cast("bigint"), "integer")
    if isinstance(kind, T.DecimalType):
        return lit(col.cast("double"), "decimal")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return lit(col.cast("double"), "double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return lit(col.cast("timestamp"), "dateTime")
    if isinstance(kind, T.DateType):
        return lit(col, "date")
    return lit(col.cast("string"), "string")


def constant(t: Term) -> Val:
    if t.k == IRI:
        return Val("iri", F.lit(t.v))
    if t.k == LITERAL and not t.lang:
        if not t.dt:
            return lit(F.lit(t.v), "string")
        name = t.dt.removeprefix(XSD)
        if t.dt.startswith(XSD):
            if name in INTEGERS and name == "integer":
                return lit(F.lit(int(t.v)), "integer") if _is_int(t.v) else term_val(t)
            if name in ("decimal", "double", "float"):
                try:
                    return lit(F.lit(float(t.v.replace("INF", "inf"))), name)
                except ValueError:
                    return term_val(t)
            if name == "boolean" and t.v in ("true", "false", "1", "0"):
                return lit(F.lit(t.v in ("true", "1")), "boolean")
            if name == "dateTime":
                return lit(F.try_to_timestamp(F.lit(t.v)), "dateTime")
            if name == "date":
                return lit(F.lit(t.v).try_cast("date"), "date")
    return term_val(t)


def _is_int(v: str) -> bool:
    try:
        return abs(int(v)) < 2**63
    except ValueError:
        return False


def term_val(t: Term) -> Val:
    from lattica.terms import lit_term

    return Val("any", lit_term(t))


def iri_text(v: Val) -> Column:
    """The IRI of an ``iri`` value."""
    if v.template:
        head, tail = v.template.split("{}")
        return F.concat(F.lit(head), v.col.cast("string"), F.lit(tail))
    return v.col


def double_text(x: Column) -> Column:
    """Lexical form of a double: integral values without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def lexical(v: Val) -> Column:
    """The lexical form, or the IRI's text."""
    if v.kind == "iri":
        return iri_text(v)
    if v.kind == "any":
        return v.col["v"]
    if v.dt in ("double", "decimal", "float"):
        return double_text(v.col)
    if v.dt == "dateTime":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return v.col.cast("string")


def to_term(v: Val) -> Column:
    """As a TERM struct."""
    if v.kind == "any":
        return v.col
    if v.kind == "iri":
        return term_col(IRI, iri_text(v))
    return term_col(LITERAL, lexical(v), "" if v.dt == "string" else XSD + v.dt)


def number(v: Val) -> Column:
    """As a double; null if not numeric."""
    if v.kind == "lit":
        return v.col.cast("double") if v.dt in NUMERIC else F.lit(None).cast("double")
    if v.kind == "iri":
        return F.lit(None).cast("double")
    t = F.replace(v.col["v"], F.lit("INF"), F.lit("Infinity"))
    return F.when((v.col["k"] == LITERAL) & v.col["dt"].isin(NUMERIC_IRIS), t.try_cast("double"))


def is_integer(v: Val) -> Column:
    if v.kind == "lit":
        return F.lit(v.dt == "integer")
    return F.coalesce(v.col["dt"].isin([XSD + x for x in INTEGERS]), F.lit(False)) if v.kind == "any" else F.lit(False)


def string(v: Val) -> Column:
    """As a simple or language-tagged string; null for anything else."""
    if v.kind == "lit":
        return v.col if v.dt == "string" else F.lit(None).cast("string")
    if v.kind == "iri":
        return F.lit(None).cast("string")
    return F.when((v.col["k"] == LITERAL) & (v.col["dt"] == ""), v.col["v"])


def moment(v: Val) -> Column:
    """As a timestamp; null unless an xsd:dateTime or xsd:date."""
    if v.kind == "lit":
        return v.col.cast("timestamp") if v.dt in ("dateTime", "date") else F.lit(None).cast("timestamp")
    if v.kind == "iri":
        return F.lit(None).cast("timestamp")
    return F.when(v.col["dt"].isin(XSD + "dateTime", XSD + "date"), F.try_to_timestamp(v.col["v"]))


def truth(v: Val) -> Column:
    """Effective boolean value; null is an error."""
    if v.kind == "iri":
        return F.lit(None).cast("boolean")
    if v.kind == "lit":
        if v.dt == "boolean":
            return v.col
        if v.dt in NUMERIC:
            return (v.col != 0) & ~F.isnan(v.col.cast("double"))
        if v.dt == "string":
            return v.col != ""
        return F.lit(None).cast("boolean")
    t = v.col
    n = number(v)
    numeric = t["dt"].isin(NUMERIC_IRIS)
    return (
        F.when(t["k"] != LITERAL, F.lit(None))
        .when(t["dt"] == XSD + "boolean", t["v"].isin("true", "1"))
        .when(numeric, F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))
        .when((t["dt"] == "") & (t["lang"] == ""), t["v"] != "")
        .otherwise(F.lit(None))
        .cast("boolean")
    )


def sort_keys(v: Val) -> list[Column]:
    """Columns whose order is the total order of terms: unbound, blank nodes, IRIs, then literals by kind and value."""
    if v.kind == "lit":
        return [v.col]
    if v.kind == "iri" and not v.template:
        return [v.col]
    if v.kind == "iri":
        return [iri_text(v)]
    t, n, when = v.col, number(v), moment(v)
    group = F.when(t.isNull(), 0).when(t["k"] == 2, 1).when(t["k"] == IRI, 2).when(t["k"] == LITERAL, 3).otherwise(4)
    kind = F.when(t["k"] != LITERAL, 0).when(n.isNotNull(), 1).when((t["dt"] == "") & (t["lang"] == ""), 2).when(t["lang"] != "", 3).when(t["dt"] == XSD + "boolean", 4).when(when.isNotNull(), 5).otherwise(6)
    return [F.struct(group.alias("g"), kind.alias("c"), n.alias("n"), when.alias("m"), F.when(kind == 3, t["lang"]).alias("l"), F.when(kind == 6, t["dt"]).alias("d"), F.when(kind.isin(1, 5), t["dt"]).otherwise(t["v"]).alias("x"), t["v"].alias("v"))]


def unified(values: list[Val]) -> list[Val]:
    """The values in one common representation."""
    first = values[0]
    if all(first.like(v) for v in values):
        return values
    if all(v.kind == "iri" for v in values):
        return [Val("iri", iri_text(v)) for v in values]
    if all(v.kind == "lit" and v.dt in NUMERIC for v in values):  # numbers of several types become the widest
        widest = NUMERIC[max(NUMERIC.index(v.dt) for v in values)]
        return [Val("lit", v.col.cast("double"), widest) for v in values]
    return [Val("any", to_term(v)) for v in values]


def native(v: Val) -> Column:
    """The result column: native for typed values, the IRI or lexical form otherwise."""
    if v.kind == "lit":
        return v.col
    return iri_text(v) if v.kind == "iri" else v.col["v"]
