"""Further registered queries: built-ins by namespace, joins of unbound variables, formats, updates, closures, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import graphs as G
from lattica.queries import _NATION_TRIPLES, _REGION_TRIPLES, _SHAPES, QUERIES, SQL, E, _text, _violations, query, sparql, triples_of
from lattica.terms import OWL, RDF_TYPE, RDFS, iri

_SWAP = "http://www.w3.org/2000/10/swap/"
_RULES = "@prefix v: <http://ex.org/v#> . @prefix e: <http://ex.org/> . " + " ".join(f"@prefix {n}: <{_SWAP}{n}#> ." for n in ("math", "string", "log", "crypto", "list", "time", "graph")) + "\n"


def _derived(spark, folder, table: str, columns: tuple[str, ...], rules: str) -> DataFrame:
    """(s, p, o) as strings of what the rules derive from some columns of a table."""
    from lattica.operators.rules import reason

    g = triples_of(spark, folder, table).where(F.col("p").isin(*[f"{E}v#{c}" for c in columns]))
    out = reason(g, _RULES + rules).where(F.col("p").startswith(f"{E}is-"))
    return out.select(F.col("s.v").alias("s"), F.substring("p", len(f"{E}is-") + 1, 100).alias("p"), F.col("o.v").alias("o"))


def builtin_query(name: str, table: str, key: str, columns: dict[str, str], cases: dict[str, tuple[str, str]], tests: dict[str, tuple[str, str]], numeric: bool = False) -> None:
    """One rule for all functions and one for each test.

    ``cases``: name -> (body that binds ?<name>, SQL value); ``tests``: name -> (body, SQL condition), each giving 1.
    """
    base = " . ".join(f"?s v:{c} ?{x}" for x, c in columns.items())
    rules = f"{{ {base} . " + " . ".join(b for b, _ in cases.values()) + " } => { " + " . ".join(f"?s e:is-{n} ?{n}" for n in cases) + " } .\n" if cases else ""
    rules += "".join(f"{{ {base} . {b} }} => {{ ?s e:is-{n} '1' }} .\n" for n, (b, _) in tests.items())
    value = (lambda v: f"round(CAST({v} AS DOUBLE), 6)") if numeric else (lambda v: f"CAST({v} AS VARCHAR)")
    parts = [f"SELECT '{E}{table}/' || {key} AS s, '{n}' AS p, {value(v)} AS o FROM {table}" for n, (_, v) in cases.items()]
    parts += [f"SELECT '{E}{table}/' || {key}, '{n}', {value('1')} FROM {table} WHERE {c}" for n, (_, c) in tests.items()]

    def run(spark, folder):
        out = _derived(spark, folder, table, tuple(columns.values()), rules)
        return out.withColumn("o", F.round(F.col("o").cast("double"), 6)) if numeric else out

    QUERIES[name] = run
    SQL[name] = " UNION ALL ".join(parts)


_X, _Y, _Q = "p_size", "p_retailprice", "(p_size / 100.0::DOUBLE)"
_ONE = {n: (f"?q math:{n} ?{n}", f"{n}({_Q})") for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh", "degrees", "radians", "sqrt")}
builtin_query("n_math", "part", "p_partkey", {"x": _X, "y": _Y}, {
    "quotient": ("(?x 100.0) math:quotient ?quotient . (?x 100.0) math:quotient ?q", _Q),
    **_ONE,
    "acosh": ("?x math:acosh ?acosh", f"acosh({_X})"),
    "negation": ("?x math:negation ?negation", f"-{_X}"),
    "absoluteValue": ("?x math:negation ?m . ?m math:absoluteValue ?absoluteValue", _X),
    "floor": ("?y math:floor ?floor", f"floor({_Y})"),
    "ceiling": ("?y math:ceiling ?ceiling", f"ceil({_Y})"),
    "rounded": ("?y math:rounded ?rounded", f"floor({_Y} + 0.5)"),
    "roundedTo": ("(?y 1) math:roundedTo ?roundedTo", f"floor({_Y} * 10 + 0.5) / 10"),
    "atan2": ("(?x ?y) math:atan2 ?atan2", f"atan2({_X}, {_Y})"),
    "sum": ("(?x ?y 1) math:sum ?sum", f"{_X} + {_Y} + 1"),
    "product": ("(?x ?y) math:product ?product", f"{_X} * {_Y}"),
    "difference": ("(?x ?y) math:difference ?difference", f"{_X} - {_Y}"),
    "remainder": ("(?x 7) math:remainder ?remainder", f"{_X} % 7"),
    "exponentiation": ("(?x 2) math:exponentiation ?exponentiation", f"{_X} * {_X}"),
    "logarithm": ("(?x 2) math:logarithm ?logarithm", f"ln({_X}) / ln(2)"),
    "max": ("(?x 20) math:max ?max", f"greatest({_X}, 20)"),
    "min": ("(?x 20) math:min ?min", f"least({_X}, 20)"),
}, {
    "greaterThan": ("?x math:greaterThan 25", f"{_X} > 25"),
    "lessThan": ("?x math:lessThan 25", f"{_X} < 25"),
    "notGreaterThan": ("?x math:notGreaterThan 25", f"{_X} <= 25"),
    "notLessThan": ("?x math:notLessThan 25", f"{_X} >= 25"),
    "equalTo": ("?x math:equalTo 25.0", f"{_X} = 25"),
    "notEqualTo": ("?x math:notEqualTo 25", f"{_X} <> 25"),
}, numeric=True)

_N, _M = "c_name", "c_mktsegment"
builtin_query("n_string", "customer", "c_custkey", {"n": _N, "m": _M}, {
    "length": ("?n string:length ?length", f"length({_N})"),
    "upperCase": ("?n string:upperCase ?upperCase", f"upper({_N})"),
    "lowerCase": ("?n string:lowerCase ?lowerCase", f"lower({_N})"),
    "concatenation": ("(?n '-' ?m) string:concatenation ?concatenation", f"{_N} || '-' || {_M}"),
    "replace": ("(?n '0+' 'z') string:replace ?replace", f"regexp_replace({_N}, '0+', 'z', 'g')"),
    "replaceAll": ("(?n ('C' '0+') ('K' '<$1>')) string:replaceAll ?replaceAll", f"regexp_replace(replace({_N}, 'C', 'K'), '(0+)', '<\\1>', 'g')"),
    "scrape": ("(?n '#0*([0-9]+)') string:scrape ?scrape", f"regexp_extract({_N}, '#0*([0-9]+)', 1)"),
    "scrapeAll": ("(?n '[1-9]') string:scrapeAll ?all . ?all list:length ?scrapeAll", f"len(regexp_extract_all({_N}, '[1-9]'))"),
    "substring": ("(?n 2 4) string:substring ?substring", f"substr({_N}, 3, 4)"),
    "join": ("(?m ?m) string:join ?join", f"{_M} || {_M}"),
    "format": ("('%s in %s' ?n ?m) string:format ?format", f"{_N} || ' in ' || {_M}"),
    "capitalize": ("?m string:lowerCase ?low . ?low string:capitalize ?capitalize", f"upper({_M}[1]) || lower({_M}[2:])"),
    "encodeForURI": ("?n string:encodeForURI ?encodeForURI", f"replace({_N}, '#', '%23')"),
    "encodeForFragID": ("?n string:encodeForFragID ?encodeForFragID", f"replace({_N}, '#', '%23')"),
}, {
    "contains": ("?n string:contains '77'", f"contains({_N}, '77')"),
    "startsWith": ("?m string:startsWith 'B'", f"starts_with({_M}, 'B')"),
    "endsWith": ("?n string:endsWith '7'", f"ends_with({_N}, '7')"),
    "matches": ("?n string:matches '[13]7$'", f"regexp_matches({_N}, '[13]7$')"),
    "notMatches": ("?n string:notMatches '[0-8]$'", f"NOT regexp_matches({_N}, '[0-8]$')"),
    "greaterThan": ("?m string:greaterThan 'F'", f"{_M} > 'F'"),
    "lessThan": ("?m string:lessThan 'F'", f"{_M} < 'F'"),
    "notGreaterThan": ("?m string:notGreaterThan 'BUILDING'", f"{_M} <= 'BUILDING'"),
    "notLessThan": ("?m string:notLessThan 'MACHINERY'", f"{_M} >= 'MACHINERY'"),
    "containsIgnoringCase": ("?m string:containsIgnoringCase 'build'", f"contains(lower({_M}), 'build')"),
    "equalIgnoringCase": ("?m string:equalIgnoringCase 'Building'", f"lower({_M}) = 'building'"),
    "notEqualIgnoringCase": ("?m string:notEqualIgnoringCase 'Building'", f"lower({_M}) <> 'building'"),
    "containsRoughly": ("?m string:containsRoughly ' BUILD'", f"contains(lower({_M}), 'build')"),
    "notContainsRoughly": ("?m string:notContainsRoughly ' BUILD'", f"NOT contains(lower({_M}), 'build')"),
})

_D = "o_orderdate"
builtin_query("n_time_crypto", "orders", "o_orderkey", {"d": _D, "t": "o_orderstatus"}, {
    "year": ("?d time:year ?year", f"year({_D})"),
    "month": ("?d time:month ?month", f"month({_D})"),
    "day": ("?d time:day ?day", f"day({_D})"),
    "hour": ("?d time:hour ?hour", f"hour({_D})"),
    "minute": ("?d time:minute ?minute", f"minute({_D})"),
    "second": ("?d time:second ?second", f"second({_D})"),
    "dayOfWeek": ("?d time:dayOfWeek ?dayOfWeek", f"dayofweek({_D})"),
    "inSeconds": ("?d time:inSeconds ?inSeconds", f"CAST(epoch({_D}) AS BIGINT)"),
    "timeZone": ("?d time:timeZone ?timeZone", "'Z'"),
    "sha": ("?t crypto:sha ?sha", "sha1(o_orderstatus)"),
    "sha1": ("?t crypto:sha1 ?sha1", "sha1(o_orderstatus)"),
    "md5": ("?t crypto:md5 ?md5", "md5(o_orderstatus)"),
    "sha256": ("?t crypto:sha256 ?sha256", "sha256(o_orderstatus)"),
    "sha512": ("?t crypto:sha512 ?long . ?long string:length ?sha512", "128"),
}, {})

builtin_query("n_list", "part", "p_partkey", {"x": _X}, {
    "first": ("(?x 7 ?x) list:first ?first", _X),
    "last": ("(7 ?x) list:last ?last", _X),
    "rest": ("(?x 7 8) list:rest ?l1 . ?l1 list:first ?rest", "7"),
    "length": ("(?x 7 8) list:length ?length", "3"),
    "append": ("((?x) (7 8)) list:append ?l2 . ?l2 list:last ?append", "8"),
    "sort": ("(30 ?x 5) list:sort ?l3 . ?l3 list:last ?sort", f"greatest({_X}, 30)"),
    "unique": ("(?x 7 ?x 7) list:unique ?l4 . ?l4 list:length ?unique", f"CASE WHEN {_X} = 7 THEN 1 ELSE 2 END"),
    "removeDuplicates": ("(?x ?x) list:removeDuplicates ?l5 . ?l5 list:length ?removeDuplicates", "1"),
    "remove": ("((?x 7 9) 7) list:remove ?l6 . ?l6 list:length ?remove", f"CASE WHEN {_X} = 7 THEN 1 ELSE 2 END"),
    "removeAt": ("((?x 7 9) 0) list:removeAt ?l7 . ?l7 list:first ?removeAt", "7"),
    "memberAt": ("((5 ?x) 1) list:memberAt ?memberAt", _X),
    "firstRest": ("(?x 7 9) list:firstRest (?f ?l8) . ?l8 list:first ?firstRest", "7"),
    "map": ("((?x 0) math:negation) list:map ?l9 . ?l9 list:first ?map", f"-{_X}"),
}, {
    "in": ("?x list:in (1 2 3)", f"{_X} IN (1, 2, 3)"),
    "member": ("(1 2 3) list:member ?x", f"{_X} IN (1, 2, 3)"),
    "iterate": ("(10 20 30) list:iterate (1 ?x)", f"{_X} = 20"),
    "setEqualTo": ("(?x 7 7) list:setEqualTo (7 3)", f"{_X} = 3"),
    "setNotEqualTo": ("(?x 7 7) list:setNotEqualTo (7 3)", f"{_X} <> 3"),
    "multisetEqualTo": ("(?x 7) list:multisetEqualTo (7 3)", f"{_X} = 3"),
    "multisetNotEqualTo": ("(?x 7) list:multisetNotEqualTo (7 3)", f"{_X} <> 3"),
})

builtin_query("n_log_graph", "part", "p_partkey", {"x": _X}, {
    "graph_length": ("{ ?s e:p ?x . ?s e:p 7 } graph:length ?graph_length", f"CASE WHEN {_X} = 7 THEN 1 ELSE 2 END"),
    "union": ("({ ?s e:p ?x } { ?s e:p 7 }) graph:union ?g1 . ?g1 graph:length ?union", f"CASE WHEN {_X} = 7 THEN 1 ELSE 2 END"),
    "intersection": ("({ ?s e:p ?x } { ?s e:p 7 }) graph:intersection ?g2 . ?g2 graph:length ?intersection", f"CASE WHEN {_X} = 7 THEN 1 ELSE 0 END"),
    "graph_difference": ("({ ?s e:p ?x } { ?s e:p 7 }) graph:difference ?g3 . ?g3 graph:length ?graph_difference", f"CASE WHEN {_X} = 7 THEN 0 ELSE 1 END"),
    "graph_list": ("{ ?s e:p ?x } graph:list ?l1 . ?l1 list:length ?graph_list", "1"),
    "member": ("{ ?s e:p ?x } graph:member { ?s e:p ?member }", _X),
    "conjunction": ("({ ?s e:p ?x } { ?s e:q 8 }) log:conjunction ?g4 . ?g4 log:includes { ?s e:q ?conjunction }", "8"),
    "conclusion": ("{ ?s e:p ?x } log:conclusion ?g5 . ?g5 graph:length ?conclusion", "1"),
    "inferences": ("{ e:a e:p 1 . { ?i e:p ?j } => { ?i e:q ?j } } log:inferences ?g6 . ?g6 log:includes { e:a e:q ?inferences }", "1"),
    "rawType": ("?x log:rawType ?rawType", f"'{_SWAP}log#Literal'"),
    "n3String": ("(?x) log:n3String ?n3String", f"""'("' || {_X} || '"^^<http://www.w3.org/2001/XMLSchema#integer>)'"""),
    "localN3String": ("'a' log:localN3String ?localN3String", "'\"a\"'"),
    "satisfiable": ("{ ?s e:p ?x } log:satisfiable ?satisfiable", "'true'"),
    "uri": ("?s log:uri ?uri", f"'{E}part/' || p_partkey"),
    "localName": ("?s log:localName ?localName", "p_partkey"),
    "namespace": ("?s log:namespace ?namespace", f"'{E}part/'"),
    "racine": ("v:p_size log:racine ?r1 . ?r1 log:uri ?racine", f"'{E}v'"),
    "prefix": ("<http://ex.org/v#> log:prefix ?prefix", "'v'"),
    "langlit": ("('a' 'en') log:langlit ?langlit", "'a'"),
    "dtlit": ("('a' e:dt) log:dtlit ?dtlit", "'a'"),
    "uuid": ("?s log:uuid ?u1 . ?u1 string:length ?uuid", "36"),
    "skolem": ("(?s) log:skolem ?k1 . ?k1 log:rawType ?skolem", f"'{_SWAP}log#Other'"),
    "parsedAsN3": ("'<http://x/a> <http://x/p> 7 .' log:parsedAsN3 ?g7 . ?g7 log:includes { ?a <http://x/p> ?parsedAsN3 }", "7"),
    "callWithOptional": ("{ ?s v:p_size ?again } log:callWithOptional true . (?again 1) math:sum ?callWithOptional", f"{_X} + 1"),
    "callWithCut": ("{ ?s v:p_size ?once } log:callWithCut true . (?once 2) math:sum ?callWithCut", f"{_X} + 2"),
    "collectAllIn": ("(?w { ?s v:p_size ?w } ?l2) log:collectAllIn ?scope . ?l2 list:length ?collectAllIn", "1"),
    "ifThenElseIn": ("({ ?x math:greaterThan 25 } { (?x 100) math:sum ?ifThenElseIn } { (?x 0) math:sum ?ifThenElseIn }) log:ifThenElseIn ?scope2", f"CASE WHEN {_X} > 25 THEN {_X} + 100 ELSE {_X} END"),
}, {
    "log_equalTo": ("?x log:equalTo 7", f"{_X} = 7"),
    "log_notEqualTo": ("?x log:notEqualTo 7", f"{_X} <> 7"),
    "bound": ("?x log:bound true", "true"),
    "hasPrefix": ("v:p_size log:hasPrefix true", "true"),
    "repeat": ("3 log:repeat ?x", f"{_X} IN (0, 1, 2)"),
    "isomorphic": ("{ e:a e:p ?x } log:isomorphic { e:a e:p 7 }", f"{_X} = 7"),
    "includes": ("{ e:a e:p 3 . e:a e:p 4 } log:includes { e:a e:p ?x }", f"{_X} IN (3, 4)"),
    "notIncludes": ("{ e:a e:p 3 } log:notIncludes { e:a e:p ?x }", f"{_X} <> 3"),
    "includesNotBind": ("{ e:a e:p 3 } log:includesNotBind { e:a e:p ?x }", f"{_X} = 3"),
    "supports": ("{ e:a e:p 3 . { ?i e:p ?j } => { ?i e:q ?j } } log:supports { e:a e:q ?x }", f"{_X} = 3"),
    "call": ("{ ?s v:p_size 9 } log:call true", f"{_X} = 9"),
    "callWithCleanup": ("{ ?s v:p_size 9 } log:callWithCleanup { ?s v:p_size ?x }", f"{_X} = 9"),
    "forAllIn": ("({ ?s v:p_size ?w } { ?w math:greaterThan 40 }) log:forAllIn ?scope", f"{_X} > 40"),
    "trace": ("?s log:trace ?x", "true"),
})

# -- variables that may be unbound ----------------------------------------------------------------
_HALF = "?c v:c_name ?n ; v:c_acctbal ?b OPTIONAL { ?c v:c_nationkey ?k FILTER(?b > 5000) }"
sparql("j04_optional_chain", f"SELECT ?n ?m WHERE {{ {_HALF} OPTIONAL {{ ?k v:n_name ?m ; v:n_regionkey <{E}region/1> }} }}",
       "SELECT c_name AS n, n_name AS m FROM customer LEFT JOIN nation ON n_regionkey = 1 AND (c_nationkey = n_nationkey OR c_acctbal <= 5000)")
sparql("j08_minus_after_optional", f"SELECT ?n WHERE {{ {_HALF} MINUS {{ ?k v:n_regionkey <{E}region/1> }} }}",
       "SELECT c_name AS n FROM customer WHERE NOT (c_acctbal > 5000 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
sparql("j09_exists_after_optional", f"SELECT ?n WHERE {{ {_HALF} FILTER EXISTS {{ ?k v:n_regionkey <{E}region/1> }} }}",
       "SELECT c_name AS n FROM customer WHERE c_acctbal <= 5000 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sparql("j09_not_exists_after_optional", f"SELECT ?n WHERE {{ {_HALF} FILTER NOT EXISTS {{ ?k v:n_regionkey <{E}region/1> }} }}",
       "SELECT c_name AS n FROM customer WHERE c_acctbal > 5000 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sparql("j04_optional_both_loose", "SELECT ?n ?m WHERE { ?c v:n_name ?n OPTIONAL { ?c v:n_regionkey ?r FILTER(?n < 'M') } OPTIONAL { ?x v:r_name ?m OPTIONAL { ?r v:r_name ?m FILTER(?m < 'B') } } }",
       "SELECT n_name AS n, r_name AS m FROM nation LEFT JOIN region ON r_name >= 'B' OR n_name >= 'M' OR n_regionkey = r_regionkey")
sparql("j08_minus_loose_inner", "SELECT ?o ?p WHERE { ?o v:o_totalprice ?p ; v:o_custkey ?c MINUS { ?c v:c_mktsegment 'BUILDING' OPTIONAL { ?o v:o_custkey ?c ; v:o_orderstatus 'F' } } }",
       f"SELECT '{E}orders/' || o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_custkey NOT IN (SELECT c.c_custkey FROM customer c WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = c.c_custkey AND f.o_orderstatus = 'F')) AND NOT (o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
sparql("q24_prologue", "BASE <http://ex.org/> PREFIX w: <v#> SELECT ?n WHERE { <nation/3> w:n_name ?n }", "SELECT n_name AS n FROM nation WHERE n_nationkey = 3")
sparql("s05_numeric_order", "SELECT ?c ?b WHERE { ?c v:c_acctbal ?b } ORDER BY ?b LIMIT 20", f"SELECT '{E}customer/' || c_custkey AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal LIMIT 20")
sparql("s06_limit", "SELECT (COUNT(*) AS ?n) WHERE { SELECT ?c WHERE { ?c v:c_name ?x } LIMIT 7 }", "SELECT 7::BIGINT AS n")
sparql("f25_now", "SELECT ?n (NOW() > '2020-01-01T00:00:00Z'^^xsd:dateTime AS ?later) WHERE { ?r v:r_name ?n }", "SELECT r_name AS n, true AS later FROM region")
sparql("f36_lexical", "SELECT ?p (STR(?x) AS ?t) WHERE { ?p v:p_size ?x }", f"SELECT '{E}part/' || p_partkey AS p, CAST(p_size AS VARCHAR) AS t FROM part")


# -- formats ---------------------------------------------------------------------------------------
def round_trip(name: str, format: str) -> None:
    """A graph written in a document format and parsed again."""

    def run(spark, folder):
        from lattica.sources.documents import PARSERS, WRITERS, collect_quads, to_frame

        quads = [(s, p, o, None) for s, p, o, _ in collect_quads(triples_of(spark, folder, "nation"))]
        return _text(to_frame(spark, PARSERS["turtle" if format == "longturtle" else format](WRITERS[format](quads))).select("s", "p", "o"))

    QUERIES[name] = run
    SQL[name] = _NATION_TRIPLES


for _name, _format in {"b03_turtle_round_trip": "turtle", "b04_trig_round_trip": "trig", "b05_rdfxml_round_trip": "rdfxml", "b06_jsonld_round_trip": "jsonld", "b09_trix_round_trip": "trix", "b11_long_turtle_round_trip": "longturtle"}.items():
    round_trip(_name, _format)


@query("b02_nquads_round_trip", f"SELECT s, p, o, '{E}g' AS g FROM ({_NATION_TRIPLES})")
def b02(spark, folder):
    from lattica.sources.text import read_nquads, write_nquads
    from lattica.storage import Tables

    path = Tables(spark, "nquads").path
    write_nquads(triples_of(spark, folder, "nation").withColumn("g", F.lit(f"{E}g")), path)
    q = read_nquads(spark, path)
    return _text(q).withColumn("g", F.lit(f"{E}g")) if "g" not in _text(q).columns else _text(q)


_CUSTOMERS = " UNION ALL ".join(f"""SELECT '<{E}customer/' || c_custkey || '>' AS s, '<{E}v#{c}>' AS p, '"' || {c} || '"' AS o FROM customer""" for c in ("c_name", "c_mktsegment"))


@query("b14_arrow_round_trip", _CUSTOMERS)
def b14_arrow(spark, folder):
    from lattica.sources.arrow import read_arrow, write_arrow
    from lattica.storage import Tables

    path = Tables(spark, "arrow").path
    write_arrow(triples_of(spark, folder, "customer").where(F.col("p").isin(f"{E}v#c_name", f"{E}v#c_mktsegment")), path)
    return _text(read_arrow(spark, path))


@query("v09_simple_graph", f"SELECT '<{E}orders/' || o_orderkey || '>' AS s, '<{E}placed-by>' AS p, '<{E}customer/' || o_custkey || '>' AS o FROM orders")
def v09(spark, folder):
    from lattica.operators.indexed import from_simple_graph, to_simple_graph

    edges, nodes = to_simple_graph(triples_of(spark, folder, "orders").where(F.col("p") == f"{E}v#o_custkey"))
    return _text(from_simple_graph(edges, nodes, f"{E}placed-by"))


# -- updates -----------------------------------------------------------------------------------------
def _state(spark, folder, text: str, *names: str) -> DataFrame:
    """(s, p, o, g) after an update; the default graph is an empty g."""
    from lattica.operators.update import State
    from lattica.terms import n3_col

    q = State.of(spark, triples_of(spark, folder, *names)).update(text, {"v": "http://ex.org/v#", "e": E}).quads
    return q.select(n3_col(F.col("s")).alias("s"), F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), n3_col(F.col("o")).alias("o"), F.coalesce("g", F.lit("")).alias("g"))


_CUSTOMER_NAMES = f"""SELECT '<{E}customer/' || c_custkey || '>' AS s, '<{E}v#c_name>' AS p, '"' || c_name || '"' AS o FROM customer"""


@query("u02_quads", f"SELECT *, '' AS g FROM ({_REGION_TRIPLES}) UNION ALL SELECT '<{E}a>', '<{E}p>', '<{E}c>', '{E}g'")
def u02(spark, folder):
    return _state(spark, folder, "INSERT DATA { GRAPH e:g { e:a e:p e:b , e:c } } ; DELETE DATA { GRAPH e:g { e:a e:p e:b } }", "region")


@query("u04_with", f"SELECT *, '' AS g FROM ({_REGION_TRIPLES}) UNION ALL SELECT s, '<{E}label>', o, '{E}g' FROM ({_REGION_TRIPLES}) WHERE p = '<{E}v#r_name>'")
def u04(spark, folder):
    return _state(spark, folder, "INSERT { GRAPH e:g { ?r v:r_name ?n } } WHERE { ?r v:r_name ?n } ; WITH e:g DELETE { ?r v:r_name ?n } INSERT { ?r e:label ?n } WHERE { ?r v:r_name ?n }", "region")


@query("u06_clear_drop", f"SELECT s, p, o, '{E}h' AS g FROM ({_REGION_TRIPLES})")
def u06(spark, folder):
    return _state(spark, folder, "COPY DEFAULT TO e:g ; ADD e:g TO e:h ; DROP GRAPH e:g ; CLEAR DEFAULT ; CREATE SILENT GRAPH e:k", "region")


@query("u07_move_add", f"SELECT s, p, o, '{E}h' AS g FROM ({_REGION_TRIPLES})")
def u07_move(spark, folder):
    return _state(spark, folder, "MOVE DEFAULT TO e:g ; MOVE e:g TO e:h", "region")


@query("u08_sequence", f"SELECT s, '<{E}called>' AS p, o, '' AS g FROM ({_CUSTOMER_NAMES}) WHERE o < '\"Customer#000000500\"'")
def u08(spark, folder):
    return _state(spark, folder, "INSERT { ?c e:called ?n } WHERE { ?c v:c_name ?n FILTER(?n < 'Customer#000000500') } ; DELETE { ?c ?p ?o } WHERE { ?c ?p ?o FILTER(?p != e:called) }", "customer")


# -- closures ----------------------------------------------------------------------------------------
_LINKS = f"""SELECT '{E}nation/' || n_nationkey AS a, '{E}region/' || n_regionkey AS b FROM nation"""


def _closed(spark, folder, facts: list[tuple[str, str, str]], closure, predicate: str) -> DataFrame:
    g = triples_of(spark, folder, "nation").where(F.col("p") == f"{E}v#n_regionkey")
    g = G.union(g, G.from_triples(spark, [(iri(s), p, iri(o)) for s, p, o in facts]))
    return closure(g).where(F.col("p") == predicate).select(F.col("s.v").alias("a"), F.col("o.v").alias("b"))


@query("i03_inverse", f"SELECT b AS a, a AS b FROM ({_LINKS})")
def i03(spark, folder):
    from lattica.operators.rules import owl_closure

    return _closed(spark, folder, [(f"{E}v#n_regionkey", OWL + "inverseOf", f"{E}has")], owl_closure, f"{E}has")


@query("i03_transitive", f"SELECT * FROM ({_LINKS}) UNION SELECT a, '{E}world' FROM ({_LINKS}) UNION SELECT DISTINCT b, '{E}world' FROM ({_LINKS})")
def i03_transitive(spark, folder):
    from lattica.operators.rules import owl_closure

    facts = [(f"{E}v#n_regionkey", RDF_TYPE, OWL + "TransitiveProperty"), *[(f"{E}region/{i}", f"{E}v#n_regionkey", f"{E}world") for i in range(5)]]
    return _closed(spark, folder, facts, owl_closure, f"{E}v#n_regionkey")


@query("i04_has_value", f"SELECT a, '{E}Asian' AS b FROM ({_LINKS}) WHERE b = '{E}region/2'")
def i04(spark, folder):
    from lattica.operators.rules import owl_rl_closure

    facts = [(f"{E}Asian", OWL + "hasValue", f"{E}region/2"), (f"{E}Asian", OWL + "onProperty", f"{E}v#n_regionkey")]
    return _closed(spark, folder, facts, owl_rl_closure, RDF_TYPE).where(f"b = '{E}Asian'")


@query("i05_domain_range", f"SELECT a, '{E}Nation' AS b FROM ({_LINKS}) UNION SELECT b, '{E}Region' FROM ({_LINKS})")
def i05(spark, folder):
    from lattica.operators.rules import rdfs_closure

    facts = [(f"{E}v#n_regionkey", RDFS + "domain", f"{E}Nation"), (f"{E}v#n_regionkey", RDFS + "range", f"{E}Region")]
    return _closed(spark, folder, facts, rdfs_closure, RDF_TYPE)


@query("i24_shacl_pair", " UNION ALL ".join(f"SELECT '<{E}customer/' || c_custkey || '>' AS focus, '{c}ConstraintComponent' AS component FROM customer WHERE {w}" for c, w in (
    ("LessThan", "c_mktsegment >= c_name"), ("LessThanOrEquals", "c_mktsegment > c_name"), ("Disjoint", "true"), ("Equals", "true"), ("Equals", "true"))))
def i24(spark, folder):
    return _violations(spark, folder, "sh:property [ sh:path v:c_mktsegment ; sh:lessThan v:c_name ; sh:lessThanOrEquals v:c_name ; sh:disjoint v:c_mktsegment ; sh:equals v:c_name ] .", "customer")


@query("i28_shacl_sparql", f"SELECT '<{E}customer/' || c_custkey || '>' AS focus, 'SPARQLConstraintComponent' AS component FROM customer WHERE c_acctbal < 0")
def i28(spark, folder):
    from lattica.operators.shacl import validate

    shape = _SHAPES + 'sh:sparql [ sh:select "SELECT $this ?value WHERE { $this <http://ex.org/v#c_acctbal> ?value FILTER(?value < 0) }" ] .'
    return validate(triples_of(spark, folder, "customer"), shape).select("focus", "component")


# -- geometry ----------------------------------------------------------------------------------------
_POINT = "?p v:p_size ?x BIND(STRDT(CONCAT('POINT(', STR(?x), ' ', STR(?x), ')'), geo:wktLiteral) AS ?w)"
_BOX = "'POLYGON((10 10, 30 10, 30 30, 10 30, 10 10))'^^geo:wktLiteral"
_SEGMENT = "STRDT(CONCAT('LINESTRING(0 0, ', STR(?x), ' ', STR(?x), ')'), geo:wktLiteral)"
_IN = "p_size > 10 AND p_size < 30"
sparql("ge06_touches_crosses", f"SELECT ?p (geof:sfTouches(?w, {_BOX}) AS ?t) (geof:sfCrosses({_SEGMENT}, {_BOX}) AS ?c) WHERE {{ {_POINT} }}",
       f"SELECT '{E}part/' || p_partkey AS p, p_size IN (10, 30) AS t, p_size > 10 AS c FROM part")
sparql("ge07_egenhofer", f"SELECT ?p (geof:ehInside(?w, {_BOX}) AS ?i) (geof:ehMeet(?w, {_BOX}) AS ?m) (geof:ehDisjoint(?w, {_BOX}) AS ?d) WHERE {{ {_POINT} }}",
       f"SELECT '{E}part/' || p_partkey AS p, {_IN} AS i, p_size IN (10, 30) AS m, p_size < 10 OR p_size > 30 AS d FROM part")
sparql("ge09_relate", f"SELECT ?p (geof:relate(?w, {_BOX}, 'T*F**F***') AS ?r) WHERE {{ {_POINT} }}", f"SELECT '{E}part/' || p_partkey AS p, {_IN} AS r FROM part")
sparql("ge13_extent", f"SELECT ?p (geof:minX({_SEGMENT}) AS ?a) (geof:maxX({_SEGMENT}) AS ?b) (geof:minY({_SEGMENT}) AS ?c) (geof:maxY({_SEGMENT}) AS ?d) WHERE {{ {_POINT} }}",
       f"SELECT '{E}part/' || p_partkey AS p, 0.0::DOUBLE AS a, p_size::DOUBLE AS b, 0.0::DOUBLE AS c, p_size::DOUBLE AS d FROM part")
sparql("ge14_kind", f"SELECT ?p (geof:isEmpty(?w) AS ?e) (geof:isSimple({_SEGMENT}) AS ?s) (geof:is3D(?w) AS ?z) WHERE {{ {_POINT} }}",
       f"SELECT '{E}part/' || p_partkey AS p, false AS e, true AS s, false AS z FROM part")
