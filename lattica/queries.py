"""The registered queries: one or more for each operator, with equivalent SQL.

Names begin with the operator's row in the inventory.  SPARQL texts run over the virtual tables of
``operators.mapping.star_schema``; prefix ``v:`` is the vocabulary, entities are ``<http://ex.org/table/key>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import graphs as G
from lattica.operators.mapping import STAR, star_schema, table_map
from lattica.plans.compiler import Dataset
from lattica.terms import iri, n3_col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
E = "http://ex.org/"


def graph(spark: SparkSession, folder: str, names: list[str] | None = None) -> Dataset:
    return Dataset(spark, star_schema(spark, folder, names), prefixes={"v": "http://ex.org/v#", "e": E})


def sparql(name: str, text: str, sql: str | None) -> None:
    """Register a SPARQL query with its SQL."""
    QUERIES[name] = lambda spark, folder: graph(spark, folder).query(text).df
    if sql:
        SQL[name] = sql


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def triples_of(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return Dataset(spark, star_schema(spark, folder, list(names))).triples()


# -- query forms --------------------------------------------------------------------
sparql("j06_flagship_revenue", "SELECT ?m (SUM(?t) AS ?total) (COUNT(*) AS ?n) WHERE { ?o v:o_custkey ?c ; v:o_totalprice ?tt . ?c v:c_mktsegment ?m BIND(ROUND(?tt) AS ?t) } GROUP BY ?m",
       "SELECT c_mktsegment AS m, sum(floor(o_totalprice + 0.5)) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
sparql("q01_bgp_star", "SELECT ?n ?b ?m WHERE { ?c v:c_name ?n ; v:c_acctbal ?b ; v:c_mktsegment ?m }", "SELECT c_name AS n, c_acctbal AS b, c_mktsegment AS m FROM customer")
sparql("q02_select_star", "SELECT * WHERE { ?r v:r_name ?n }", f"SELECT '{E}region/' || r_regionkey AS r, r_name AS n FROM region")
sparql("q03_select_expr", "SELECT ?l (?p * (1 - ?d) AS ?rev) (ROUND(?rev) AS ?whole) WHERE { ?l v:l_extendedprice ?p ; v:l_discount ?d }",
       f"SELECT '{E}lineitem/' || l_orderkey || '-' || l_linenumber AS l, l_extendedprice * (1 - l_discount) AS rev, floor(l_extendedprice * (1 - l_discount) + 0.5) AS whole FROM lineitem")
sparql("q04_distinct", "SELECT DISTINCT ?m WHERE { ?c v:c_mktsegment ?m }", "SELECT DISTINCT c_mktsegment AS m FROM customer")
sparql("q05_reduced", "SELECT REDUCED ?m WHERE { ?c v:c_mktsegment ?m }", "SELECT c_mktsegment AS m FROM customer")
sparql("q06_ask", "ASK { ?o v:o_totalprice ?p FILTER(?p > 1000) }", "SELECT EXISTS(SELECT 1 FROM orders WHERE o_totalprice > 1000) AS result")
sparql("q07_construct", "CONSTRUCT { ?n v:within ?r . ?r v:label ?x } WHERE { ?n v:n_regionkey ?r . ?r v:r_name ?x }",
       f"""SELECT '<{E}nation/' || n_nationkey || '>' AS s, '<{E}v#within>' AS p, '<{E}region/' || n_regionkey || '>' AS o FROM nation
           UNION SELECT '<{E}region/' || r_regionkey || '>', '<{E}v#label>', '"' || r_name || '"' FROM region JOIN nation ON n_regionkey = r_regionkey""")
sparql("q08_construct_where", "CONSTRUCT WHERE { ?n v:n_regionkey ?r }", f"SELECT '<{E}nation/' || n_nationkey || '>' AS s, '<{E}v#n_regionkey>' AS p, '<{E}region/' || n_regionkey || '>' AS o FROM nation")
sparql("q09_describe", f"DESCRIBE <{E}nation/3>",
       f"""SELECT '<{E}nation/3>' AS s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<{E}v#Nation>' AS o
           UNION ALL SELECT '<{E}nation/3>', '<{E}v#n_name>', '"' || n_name || '"' FROM nation WHERE n_nationkey = 3
           UNION ALL SELECT '<{E}nation/3>', '<{E}v#n_regionkey>', '<{E}region/' || n_regionkey || '>' FROM nation WHERE n_nationkey = 3""")
QUERIES["q10_describe_star"] = lambda spark, folder: graph(spark, folder, ["region"]).query("DESCRIBE *").df
SQL["q10_describe_star"] = f"""SELECT '<{E}region/' || r_regionkey || '>' AS s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<{E}v#Region>' AS o FROM region
    UNION ALL SELECT '<{E}region/' || r_regionkey || '>', '<{E}v#r_name>', '"' || r_name || '"' FROM region"""
sparql("q11_subquery_top", "SELECT ?n ?b WHERE { { SELECT ?c ?b WHERE { ?c v:c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 10 } ?c v:c_name ?n }",
       f"SELECT c_name AS n, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, '{E}customer/' || c_custkey LIMIT 10")
sparql("q12_values", "SELECT ?n ?m WHERE { ?c v:c_name ?n ; v:c_mktsegment ?m VALUES ?m { 'BUILDING' 'MACHINERY' } }", "SELECT c_name AS n, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
sparql("q12_values_undef", "SELECT ?n ?rn ?tag WHERE { ?c v:n_name ?n ; v:n_regionkey ?r . ?r v:r_name ?rn } VALUES (?rn ?tag) { ('ASIA' 'a') (UNDEF 'any') }",
       "SELECT n_name AS n, r_name AS rn, t.tag FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('ASIA', 'a'), (NULL, 'any')) t(k, tag) ON t.k = r_name OR t.k IS NULL")
sparql("q13_bind", "SELECT ?n ?half WHERE { ?c v:c_name ?n ; v:c_acctbal ?b BIND(?b / 2 AS ?half) }", "SELECT c_name AS n, c_acctbal / 2 AS half FROM customer")
sparql("q14_filter", "SELECT ?o ?p WHERE { ?o v:o_totalprice ?p ; v:o_orderstatus ?s FILTER(?p > 100000 && ?s = 'O') }", f"SELECT '{E}orders/' || o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
sparql("q15_exists", "SELECT ?n WHERE { ?c v:c_name ?n FILTER EXISTS { ?o v:o_custkey ?c } }", "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sparql("q15_exists_correlated", "SELECT ?n WHERE { ?c v:c_name ?n ; v:c_acctbal ?b FILTER EXISTS { ?o v:o_custkey ?c ; v:o_totalprice ?p FILTER(?p > ?b * 30) } }",
       "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30)")
sparql("q16_graph_iri", f"SELECT ?n WHERE {{ GRAPH <{E}graph/nation> {{ ?s v:n_name ?n }} }}", "SELECT n_name AS n FROM nation")
sparql("q17_graph_var", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?t } } GROUP BY ?g",
       " UNION ALL ".join(f"SELECT '{E}graph/{t}' AS g, count(*) AS n FROM {t}" for t in STAR))
sparql("q20_lateral_top", "SELECT ?n ?p WHERE { ?c v:c_name ?n LATERAL { SELECT ?c ?p WHERE { ?o v:o_custkey ?c ; v:o_totalprice ?p } ORDER BY DESC(?p) LIMIT 2 } }",
       "SELECT c_name AS n, o_totalprice AS p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS k FROM orders) JOIN customer ON o_custkey = c_custkey WHERE k <= 2")
sparql("q21_nested_group", "SELECT ?n ?b WHERE { ?c v:c_name ?n { ?c v:c_acctbal ?b FILTER(?b < 0) } }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal < 0")
sparql("q23_blank_node", "SELECT ?n ?rn WHERE { ?x v:n_name ?n ; v:n_regionkey [ v:r_name ?rn ] }", "SELECT n_name AS n, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey")

# -- joins ----------------------------------------------------------------------------
sparql("j01_join2", "SELECT ?o ?n WHERE { ?o v:o_custkey ?c . ?c v:c_name ?n }", f"SELECT '{E}orders/' || o_orderkey AS o, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey")
sparql("j01_join5", "SELECT ?rn (COUNT(*) AS ?n) WHERE { ?l v:l_orderkey ?o . ?o v:o_custkey ?c . ?c v:c_nationkey ?k . ?k v:n_regionkey ?r . ?r v:r_name ?rn } GROUP BY ?rn",
       "SELECT r_name AS rn, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("j03_optional", "SELECT ?n ?o WHERE { ?c v:c_name ?n OPTIONAL { ?o v:o_custkey ?c } }", f"SELECT c_name AS n, '{E}orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
sparql("j03_optional_filter", "SELECT ?n ?p WHERE { ?c v:c_name ?n ; v:c_acctbal ?b OPTIONAL { ?o v:o_custkey ?c ; v:o_totalprice ?p FILTER(?p < ?b * 10) } }",
       "SELECT c_name AS n, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice < c_acctbal * 10")
sparql("j04_optional_then_join", "SELECT ?n ?s ?rn WHERE { ?k v:n_name ?n OPTIONAL { ?k v:n_regionkey ?r FILTER(?n < 'M') } ?r v:r_name ?rn BIND(BOUND(?r) AS ?s) }",
       "SELECT n_name AS n, true AS s, r_name AS rn FROM nation JOIN region ON CASE WHEN n_name < 'M' THEN n_regionkey = r_regionkey ELSE true END")
sparql("j05_nested_optional", "SELECT ?n ?o ?q WHERE { ?c v:c_name ?n OPTIONAL { ?o v:o_custkey ?c OPTIONAL { ?l v:l_orderkey ?o ; v:l_quantity ?q FILTER(?q > 45) } } }",
       f"SELECT c_name AS n, '{E}orders/' || o_orderkey AS o, l_quantity AS q FROM customer LEFT JOIN (orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45) ON o_custkey = c_custkey")
sparql("j07_star_filter", "SELECT ?l ?q WHERE { ?l v:l_quantity ?q ; v:l_returnflag 'R' ; v:l_discount ?d FILTER(?d >= 0.05 && ?q < 10) }",
       f"SELECT '{E}lineitem/' || l_orderkey || '-' || l_linenumber AS l, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05 AND l_quantity < 10")
sparql("j08_minus", "SELECT ?n WHERE { ?c v:c_name ?n MINUS { ?o v:o_custkey ?c ; v:o_totalprice ?p FILTER(?p > 200000) } }", "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sparql("j08_minus_disjoint", "SELECT ?n WHERE { ?c v:n_name ?n MINUS { ?r v:r_name ?x } }", "SELECT n_name AS n FROM nation")
sparql("j09_not_exists", "SELECT ?n WHERE { ?c v:c_name ?n FILTER NOT EXISTS { ?o v:o_custkey ?c } }", "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sparql("j10_cross", "SELECT ?a ?b WHERE { ?x v:r_name ?a . ?y v:r_name ?b }", "SELECT x.r_name AS a, y.r_name AS b FROM region x CROSS JOIN region y")
sparql("j11_theta", "SELECT ?a ?b WHERE { ?x v:s_name ?a ; v:s_acctbal ?p . ?y v:s_name ?b ; v:s_acctbal ?q FILTER(?p > ?q + 9000) }", "SELECT x.s_name AS a, y.s_name AS b FROM supplier x JOIN supplier y ON x.s_acctbal > y.s_acctbal + 9000")
sparql("j12_graph_join", "SELECT ?g ?n WHERE { GRAPH ?g { ?s v:n_name ?n } }", f"SELECT '{E}graph/nation' AS g, n_name AS n FROM nation")
sparql("j13_repeated_var", "SELECT ?l WHERE { ?l v:l_quantity ?x ; v:l_extendedprice ?p ; v:l_linenumber ?k FILTER(?k = 3) ?m v:l_quantity ?x ; v:l_extendedprice ?p ; v:l_linenumber ?k }",
       f"SELECT '{E}lineitem/' || a.l_orderkey || '-' || a.l_linenumber AS l FROM lineitem a JOIN lineitem b ON a.l_quantity = b.l_quantity AND a.l_extendedprice = b.l_extendedprice AND a.l_linenumber = b.l_linenumber WHERE a.l_linenumber = 3")
sparql("j14_variable_predicate", f"SELECT ?p ?o WHERE {{ <{E}customer/7> ?p ?o }}",
       f"""SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{E}v#Customer' AS o
           UNION ALL SELECT '{E}v#' || p, o FROM (SELECT unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS p,
           unnest([c_name, '{E}nation/' || c_nationkey, c_acctbal::VARCHAR, c_mktsegment]) AS o FROM customer WHERE c_custkey = 7)""")
sparql("s07_union", "SELECT ?n ?k WHERE { { ?c v:n_name ?n } UNION { ?r v:r_name ?n ; a ?k } }", f"SELECT n_name AS n, NULL AS k FROM nation UNION ALL SELECT r_name, '{E}v#Region' FROM region")

# -- aggregates ----------------------------------------------------------------------------
sparql("g01_group_by", "SELECT ?s (COUNT(?o) AS ?n) WHERE { ?o v:o_orderstatus ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
sparql("g02_group_expr", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o v:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
sparql("g03_implicit_group", "SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?t) WHERE { ?c v:c_acctbal ?b FILTER(?b > 1e9) }", "SELECT count(*) AS n, coalesce(sum(c_acctbal), 0.0::DOUBLE) AS t FROM customer WHERE c_acctbal > 1e9")
sparql("g04_group_empty", "SELECT ?m (COUNT(*) AS ?n) WHERE { ?c v:c_acctbal ?b ; v:c_mktsegment ?m FILTER(?b > 1e9) } GROUP BY ?m", "SELECT c_mktsegment AS m, count(*) AS n FROM customer WHERE c_acctbal > 1e9 GROUP BY 1")
sparql("g06_count_bound", "SELECT ?m (COUNT(?o) AS ?n) (COUNT(*) AS ?all) WHERE { ?c v:c_mktsegment ?m OPTIONAL { ?o v:o_custkey ?c ; v:o_orderstatus 'F' } } GROUP BY ?m",
       "SELECT c_mktsegment AS m, count(o_orderkey) AS n, count(*) AS \"all\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
sparql("g07_count_distinct", "SELECT (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o v:o_custkey ?c }", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
sparql("g08_count_distinct_star", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?c v:c_mktsegment ?m ; v:c_nationkey ?k FILTER(?m = 'BUILDING') }", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
sparql("g09_sum", "SELECT ?f (SUM(?k) AS ?t) WHERE { ?l v:l_returnflag ?f ; v:l_linenumber ?k } GROUP BY ?f", "SELECT l_returnflag AS f, CAST(sum(l_linenumber) AS BIGINT) AS t FROM lineitem GROUP BY 1")
sparql("g10_avg", "SELECT ?f (AVG(?k) AS ?a) WHERE { ?l v:l_returnflag ?f ; v:l_linenumber ?k } GROUP BY ?f", "SELECT l_returnflag AS f, avg(l_linenumber) AS a FROM lineitem GROUP BY 1")
sparql("g10_avg_empty", "SELECT (AVG(?b) AS ?a) WHERE { ?c v:c_acctbal ?b FILTER(?b > 1e9) }", "SELECT 0.0::DOUBLE AS a")
sparql("g11_min_max", "SELECT ?m (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (MIN(?n) AS ?first) WHERE { ?c v:c_mktsegment ?m ; v:c_acctbal ?b ; v:c_name ?n } GROUP BY ?m", "SELECT c_mktsegment AS m, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first FROM customer GROUP BY 1")
sparql("g12_sample", "SELECT ?k (SAMPLE(?r) AS ?x) WHERE { ?n v:n_regionkey ?k . ?k v:r_name ?r } GROUP BY ?k", f"SELECT '{E}region/' || r_regionkey AS k, min(r_name) AS x FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("g13_group_concat", "SELECT ?rn (GROUP_CONCAT(?n ; SEPARATOR='|') AS ?all) WHERE { ?k v:n_name ?n ; v:n_regionkey ?r . ?r v:r_name ?rn } GROUP BY ?rn", "SELECT r_name AS rn, string_agg(n_name, '|' ORDER BY n_name) AS \"all\" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("g14_median", "SELECT ?f (MEDIAN(?q) AS ?mid) WHERE { ?l v:l_returnflag ?f ; v:l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, median(l_quantity) AS mid FROM lineitem GROUP BY 1")
sparql("g15_mode", "SELECT (MODE(?m) AS ?most) WHERE { ?c v:c_mktsegment ?m }", "SELECT c_mktsegment AS most FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
sparql("g16_sum_distinct", "SELECT (SUM(DISTINCT ?k) AS ?t) WHERE { ?l v:l_linenumber ?k }", "SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS t FROM lineitem")
sparql("g17_aggregate_expr", "SELECT ?f (SUM(IF(?q > 25, 1, 0)) AS ?many) WHERE { ?l v:l_returnflag ?f ; v:l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, count(*) FILTER (l_quantity > 25) AS many FROM lineitem GROUP BY 1")
sparql("g18_having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o v:o_custkey ?c ; v:o_totalprice ?p } GROUP BY ?c HAVING(COUNT(?o) > 12) HAVING(MAX(?p) > 1000)", f"SELECT '{E}customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000".replace("HAVING(MAX", "HAVING(MAX"))
QUERIES["g18_having"] = lambda spark, folder: graph(spark, folder).query("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o v:o_custkey ?c ; v:o_totalprice ?p } GROUP BY ?c HAVING(COUNT(?o) > 12) (MAX(?p) > 1000)").df
sparql("g19_over_aggregates", "SELECT ?m ((MIN(?b) + MAX(?b)) / 2 AS ?mid) WHERE { ?c v:c_mktsegment ?m ; v:c_acctbal ?b } GROUP BY ?m", "SELECT c_mktsegment AS m, (min(c_acctbal) + max(c_acctbal)) / 2 AS mid FROM customer GROUP BY 1")
sparql("g22_optional_aggregate", "SELECT ?n (COUNT(?o) AS ?k) WHERE { ?c v:c_name ?n OPTIONAL { ?o v:o_custkey ?c } } GROUP BY ?n", "SELECT c_name AS n, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
sparql("g23_star_aggregate", "SELECT ?m ?s (COUNT(*) AS ?n) WHERE { ?o v:o_custkey ?c ; v:o_orderstatus ?s . ?c v:c_mktsegment ?m } GROUP BY ?m ?s", "SELECT c_mktsegment AS m, o_orderstatus AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")

# -- order and slices -------------------------------------------------------------------------
sparql("s01_order_limit", "SELECT ?o ?p WHERE { ?o v:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 20", f"SELECT '{E}orders/' || o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 20")
sparql("s02_order_expr", "SELECT ?n WHERE { ?c v:c_name ?n ; v:c_acctbal ?b } ORDER BY ABS(?b) ?n LIMIT 15", "SELECT c_name AS n FROM customer ORDER BY abs(c_acctbal), c_name LIMIT 15")
sparql("s03_offset", "SELECT ?n WHERE { ?c v:n_name ?n } ORDER BY ?n OFFSET 5 LIMIT 7", "SELECT n_name AS n FROM nation ORDER BY 1 LIMIT 7 OFFSET 5")
sparql("s04_top_k_group", "SELECT ?c (SUM(?q) AS ?t) WHERE { ?l v:l_orderkey ?c ; v:l_quantity ?q } GROUP BY ?c ORDER BY DESC(?t) ?c LIMIT 10", f"SELECT '{E}orders/' || l_orderkey AS c, sum(l_quantity) AS t FROM lineitem GROUP BY l_orderkey ORDER BY t DESC, c LIMIT 10")

# -- expressions and functions ------------------------------------------------------------------
sparql("x01_logic", "SELECT ?n WHERE { ?c v:c_name ?n ; v:c_acctbal ?b ; v:c_mktsegment ?m FILTER(?b < 0 || (?m = 'BUILDING' && !(?b > 500))) }", "SELECT c_name AS n FROM customer WHERE c_acctbal < 0 OR (c_mktsegment = 'BUILDING' AND NOT c_acctbal > 500)")
sparql("x01_error_logic", "SELECT ?n ?b WHERE { ?c v:n_name ?n BIND((?n > 5) || true AS ?b) }", "SELECT n_name AS n, true AS b FROM nation")
sparql("x03_ebv", "SELECT ?n WHERE { ?c v:r_name ?n ; a ?t FILTER(STRLEN(?n) - 4) }", "SELECT r_name AS n FROM region WHERE length(r_name) <> 4")
sparql("x05_compare_dates", "SELECT (COUNT(*) AS ?n) WHERE { ?o v:o_orderdate ?d FILTER(?d >= '1995-01-01T00:00:00Z'^^xsd:dateTime && ?d < '1996-01-01T00:00:00Z'^^xsd:dateTime) }", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
sparql("x07_arithmetic", "SELECT ?k (?x + 2 AS ?a) (?x - 7 AS ?b) (?x * 3 AS ?c) (-?x AS ?d) WHERE { ?k v:p_size ?x }", f"SELECT '{E}part/' || p_partkey AS k, CAST(p_size + 2 AS BIGINT) AS a, CAST(p_size - 7 AS BIGINT) AS b, CAST(p_size * 3 AS BIGINT) AS c, CAST(-p_size AS BIGINT) AS d FROM part")
sparql("x08_divide", "SELECT ?k (?x / 4 AS ?q) (1 / (?x - ?x) AS ?bad) WHERE { ?k v:p_size ?x }", f"SELECT '{E}part/' || p_partkey AS k, p_size / 4.0::DOUBLE AS q, NULL::DOUBLE AS bad FROM part")
sparql("x10_date_difference", "SELECT ?l WHERE { ?l v:l_orderkey ?o ; v:l_shipdate ?s . ?o v:o_orderdate ?d FILTER(?s > ?d + 'P60D'^^xsd:dayTimeDuration) }",
       f"SELECT '{E}lineitem/' || l_orderkey || '-' || l_linenumber AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY")
sparql("x11_in", "SELECT ?n WHERE { ?c v:c_name ?n ; v:c_mktsegment ?m FILTER(?m IN ('BUILDING', 'FURNITURE')) }", "SELECT c_name AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
sparql("x11_not_in", "SELECT ?n WHERE { ?c v:c_name ?n ; v:c_mktsegment ?m FILTER(?m NOT IN ('BUILDING', 'FURNITURE')) }", "SELECT c_name AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE')")
sparql("x12_exists_expr", "SELECT ?n WHERE { ?c v:c_name ?n ; v:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o v:o_custkey ?c ; v:o_totalprice ?p FILTER(?p > 300000) }) }", "SELECT c_name AS n FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sparql("f01_str", "SELECT (STR(?c) AS ?s) WHERE { ?c v:r_name ?n }", f"SELECT '{E}region/' || r_regionkey AS s FROM region")
sparql("f02_strings", "SELECT ?d (STRLEN(?t) AS ?n) (UCASE(?l) AS ?u) (LCASE(?s) AS ?w) (CONCAT(?l, '-', ?s) AS ?c) WHERE { ?d v:text ?t ; v:lang ?l ; v:source ?s }",
       f"SELECT '{E}documents/' || doc_id AS d, length(text) AS n, upper(lang) AS u, lower(source) AS w, lang || '-' || source AS c FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
sparql("f05_contains", "SELECT ?n WHERE { ?c v:n_name ?n FILTER(CONTAINS(?n, 'AN') || STRSTARTS(?n, 'I') || STRENDS(?n, 'A')) }", "SELECT n_name AS n FROM nation WHERE contains(n_name, 'AN') OR starts_with(n_name, 'I') OR ends_with(n_name, 'A')")
sparql("f06_before_after", "SELECT ?n (STRBEFORE(?n, '#') AS ?a) (STRAFTER(?n, '#') AS ?b) (STRBEFORE(?n, '@') AS ?none) WHERE { ?c v:c_name ?n }", "SELECT c_name AS n, split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b, '' AS none FROM customer")
sparql("f07_substr", "SELECT ?n (SUBSTR(?n, 2) AS ?a) (SUBSTR(?n, 2, 3) AS ?b) (SUBSTR(?n, 0, 3) AS ?c) WHERE { ?k v:n_name ?n }", "SELECT n_name AS n, substring(n_name, 2) AS a, substring(n_name, 2, 3) AS b, substring(n_name, 1, 2) AS c FROM nation")
sparql("f08_replace", "SELECT ?n (REPLACE(?n, '[AEIOU]', '_') AS ?x) (REPLACE(?n, 'a(.)', '$1', 'i') AS ?y) WHERE { ?k v:n_name ?n }", r"SELECT n_name AS n, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS x, regexp_replace(n_name, 'a(.)', '\1', 'gi') AS y FROM nation")
sparql("f09_encode", "SELECT (ENCODE_FOR_URI(CONCAT(?n, ' ~*é')) AS ?x) WHERE { ?k v:r_name ?n }", "SELECT replace(r_name, ' ', '%20') || '%20~%2A%C3%A9' AS x FROM region")
sparql("f10_lang_datatype", "SELECT DISTINCT (DATATYPE(?b) AS ?d) (DATATYPE(?n) AS ?e) (LANG(?n) AS ?l) WHERE { ?c v:c_acctbal ?b ; v:c_name ?n }", "SELECT 'http://www.w3.org/2001/XMLSchema#double' AS d, 'http://www.w3.org/2001/XMLSchema#string' AS e, '' AS l")
sparql("f13_strlang", "SELECT ?n (LANG(STRLANG(?n, 'EN')) AS ?l) (STR(STRDT(?n, v:code)) AS ?s) WHERE { ?k v:r_name ?n }", "SELECT r_name AS n, 'en' AS l, r_name AS s FROM region")
sparql("f15_langmatches", "SELECT ?n WHERE { ?k v:r_name ?n FILTER(LANGMATCHES(LANG(STRLANG(?n, 'en-GB')), 'en') && !LANGMATCHES('', '*')) }", "SELECT r_name AS n FROM region")
sparql("f16_sameterm", "SELECT ?a WHERE { ?x v:r_name ?a . ?y v:r_name ?b FILTER(SAMETERM(?x, ?y)) }", "SELECT r_name AS a FROM region")
sparql("f17_regex", "SELECT ?n WHERE { ?k v:p_name ?n FILTER(REGEX(?n, '^[a-m].*e', 'i')) }", "SELECT p_name AS n FROM part WHERE regexp_matches(p_name, '^[a-m].*e', 'i')")
sparql("f18_type_tests", "SELECT (SUM(IF(ISIRI(?o), 1, 0)) AS ?i) (SUM(IF(ISLITERAL(?o), 1, 0)) AS ?l) (SUM(IF(ISNUMERIC(?o), 1, 0)) AS ?n) (SUM(IF(ISBLANK(?o), 1, 0)) AS ?b) WHERE { ?s a v:Nation ; ?p ?o }", "SELECT count(*) * 2 AS i, count(*) AS l, 0::BIGINT AS n, 0::BIGINT AS b FROM nation")
sparql("f19_bound", "SELECT ?n WHERE { ?c v:c_name ?n OPTIONAL { ?o v:o_custkey ?c } FILTER(!BOUND(?o)) }", "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sparql("f21_numeric", "SELECT ?n (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?k v:c_name ?n ; v:c_acctbal ?b }", "SELECT c_name AS n, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r FROM customer")
sparql("f26_date_parts", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) (SECONDS(?d) AS ?s) WHERE { ?o v:ts ?d }",
       f"SELECT '{E}events/' || event_id AS o, year(ts) AS y, month(ts) AS m, day(ts) AS k, hour(ts) AS h, minute(ts) AS mi, (epoch_us(ts) % 60000000) / 1e6 AS s FROM events")
sparql("f28_hashes", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?k v:n_name ?n }", "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation")
sparql("f29_if", "SELECT ?n (IF(?b < 0, 'debt', 'fine') AS ?x) WHERE { ?k v:c_name ?n ; v:c_acctbal ?b }", "SELECT c_name AS n, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS x FROM customer")
sparql("f30_coalesce", "SELECT ?n (COALESCE(?p, -1.0) AS ?x) WHERE { ?c v:c_name ?n OPTIONAL { ?o v:o_custkey ?c ; v:o_totalprice ?p FILTER(?p > 400000) } }", "SELECT c_name AS n, coalesce(o_totalprice, -1.0) AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
sparql("f33_samevalue", "SELECT ?k WHERE { ?k v:p_size ?x FILTER(SAMEVALUE(?x, 7.0)) }", f"SELECT '{E}part/' || p_partkey AS k FROM part WHERE p_size = 7")
sparql("f34_contains_text", "SELECT ?d WHERE { ?d v:text ?t ; v:lang ?l FILTER(CONTAINS_TEXT(?t, 'license work')) }", f"SELECT '{E}documents/' || doc_id AS d FROM documents WHERE lower(text) LIKE '%license%' AND lower(text) LIKE '%work%' AND lang IS NOT NULL")
sparql("f35_casts", "SELECT ?k (xsd:integer(?p) AS ?i) (xsd:string(?z) AS ?s) (xsd:double(?z) AS ?d) (xsd:boolean(?z) AS ?b) (xsd:integer(?n) AS ?bad) WHERE { ?k v:p_retailprice ?p ; v:p_size ?z ; v:p_name ?n }",
       f"SELECT '{E}part/' || p_partkey AS k, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS DOUBLE) AS d, p_size <> 0 AS b, NULL::BIGINT AS bad FROM part")
sparql("f37_unknown_function", "SELECT ?n (<http://example.org/nothing>(?n) AS ?x) WHERE { ?k v:r_name ?n }", "SELECT r_name AS n, NULL::VARCHAR AS x FROM region")

# -- paths ---------------------------------------------------------------------------------------
sparql("p02_sequence", "SELECT ?rn (COUNT(*) AS ?n) WHERE { ?o v:o_custkey/v:c_nationkey/v:n_regionkey/v:r_name ?rn } GROUP BY ?rn",
       "SELECT r_name AS rn, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("p03_alternative", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?x v:c_nationkey|v:s_nationkey ?y . ?y v:n_name ?n } GROUP BY ?n", "SELECT n_name AS n, count(*) AS k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1")
sparql("p04_inverse", "SELECT ?r ?n WHERE { ?r v:r_name ?rn . ?r ^v:n_regionkey ?k . ?k v:n_name ?n }", f"SELECT '{E}region/' || r_regionkey AS r, n_name AS n FROM region JOIN nation ON n_regionkey = r_regionkey")
sparql("p06_one_or_more", f"SELECT ?x WHERE {{ <{E}orders/5> (v:o_custkey|v:c_nationkey|v:n_regionkey)+ ?x }}",
       f"""SELECT '{E}customer/' || o_custkey AS x FROM orders WHERE o_orderkey = 5
           UNION SELECT '{E}nation/' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 5
           UNION SELECT '{E}region/' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 5""")
sparql("p05_zero_or_more", f"SELECT ?x WHERE {{ ?x (v:c_nationkey|v:n_regionkey)* <{E}region/2> }}",
       f"SELECT '{E}region/2' AS x UNION SELECT '{E}nation/' || n_nationkey FROM nation WHERE n_regionkey = 2 UNION SELECT '{E}customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
sparql("p07_zero_or_one", f"SELECT ?x WHERE {{ <{E}nation/4> v:n_regionkey? ?x }}", f"SELECT '{E}nation/4' AS x UNION SELECT '{E}region/' || n_regionkey FROM nation WHERE n_nationkey = 4")
QUERIES["p08_negated_set"] = lambda spark, folder: graph(spark, folder, ["nation", "region"]).query("SELECT ?s ?o WHERE { ?s !(v:n_name|rdf:type|v:r_name) ?o }").df
SQL["p08_negated_set"] = f"SELECT '{E}nation/' || n_nationkey AS s, '{E}region/' || n_regionkey AS o FROM nation"

# -- geometry --------------------------------------------------------------------------------------
sparql("ge02_distance", "SELECT ?n (geof:distance(STRDT(CONCAT('POINT(', STR(?k), ' 3)'), geo:wktLiteral), 'POINT(0 0)'^^geo:wktLiteral) AS ?d) WHERE { ?p v:p_name ?n ; v:p_size ?k }", "SELECT p_name AS n, sqrt(p_size * p_size + 9.0) AS d FROM part")
sparql("ge03_within", "SELECT ?n WHERE { ?p v:p_name ?n ; v:p_size ?k FILTER(geof:sfWithin(STRDT(CONCAT('POINT(', STR(?k), ' 5)'), geo:wktLiteral), 'POLYGON((10 0, 30 0, 30 10, 10 10, 10 0))'^^geo:wktLiteral)) }", "SELECT p_name AS n FROM part WHERE p_size > 10 AND p_size < 30")
sparql("ge12_area", "SELECT DISTINCT ?k (geof:area(STRDT(CONCAT('POLYGON((0 0, ', STR(?k), ' 0, ', STR(?k), ' 4, 0 4, 0 0))'), geo:wktLiteral)) AS ?a) WHERE { ?p v:p_size ?k }", "SELECT DISTINCT CAST(p_size AS BIGINT) AS k, p_size * 4.0::DOUBLE AS a FROM part")


# -- graphs, rules, updates, mapping ------------------------------------------------------------------
def _text(df: DataFrame) -> DataFrame:
    return df.select(n3_col(F.col("s")).alias("s"), F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), n3_col(F.col("o")).alias("o"))


_RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_NATION_TRIPLES = f"""SELECT '<{E}nation/' || n_nationkey || '>' AS s, '{_RDF_TYPE}' AS p, '<{E}v#Nation>' AS o FROM nation
    UNION ALL SELECT '<{E}nation/' || n_nationkey || '>', '<{E}v#n_name>', '"' || n_name || '"' FROM nation
    UNION ALL SELECT '<{E}nation/' || n_nationkey || '>', '<{E}v#n_regionkey>', '<{E}region/' || n_regionkey || '>' FROM nation"""
_REGION_TRIPLES = f"""SELECT '<{E}region/' || r_regionkey || '>' AS s, '{_RDF_TYPE}' AS p, '<{E}v#Region>' AS o FROM region
    UNION ALL SELECT '<{E}region/' || r_regionkey || '>', '<{E}v#r_name>', '"' || r_name || '"' FROM region"""


@query("t01_triples", _NATION_TRIPLES)
def t01(spark, folder):
    return _text(triples_of(spark, folder, "nation"))


@query("t02_default_map", f"""SELECT '<http://data.org/part/' || p_partkey || '>' AS s, '<http://data.org/p_size>' AS p, '"' || p_size || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS o FROM part""")
def t02(spark, folder):
    m = table_map(spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_size"), "part", ["p_partkey"], vocabulary="http://data.org/", entity="http://data.org/{}/{{}}")
    return _text(m.triples().where("p = 'http://data.org/p_size'"))


@query("a01_pattern_scan", f"SELECT * FROM ({_NATION_TRIPLES}) WHERE p = '<{E}v#n_name>'")
def a01(spark, folder):
    return _text(G.match(triples_of(spark, folder, "nation"), p=f"{E}v#n_name"))


@query("a03_subjects", f"SELECT '{E}nation/' || n_nationkey AS node FROM nation WHERE n_regionkey = 1")
def a03(spark, folder):
    return G.subjects(triples_of(spark, folder, "nation"), f"{E}v#n_regionkey", iri(f"{E}region/1")).select(F.col("s.v").alias("node"))


@query("a04_choices", f"SELECT * FROM ({_NATION_TRIPLES}) WHERE s IN ('<{E}nation/1>', '<{E}nation/2>') AND p = '<{E}v#n_name>'")
def a04(spark, folder):
    return _text(G.match_choices(triples_of(spark, folder, "nation"), s=[iri(f"{E}nation/1"), iri(f"{E}nation/2")], p=[f"{E}v#n_name"]))


@query("s08_graph_union", f"SELECT DISTINCT * FROM ({_NATION_TRIPLES} UNION ALL {_REGION_TRIPLES})")
def s08_union(spark, folder):
    n, r = triples_of(spark, folder, "nation"), triples_of(spark, folder, "nation", "region")
    return _text(G.union(n, r))


@query("s08_graph_difference", _REGION_TRIPLES)
def s08_difference(spark, folder):
    return _text(G.difference(triples_of(spark, folder, "nation", "region"), triples_of(spark, folder, "nation")))


@query("s08_graph_intersection", _NATION_TRIPLES)
def s08_intersection(spark, folder):
    return _text(G.intersect(triples_of(spark, folder, "nation", "region"), triples_of(spark, folder, "nation")))


@query("s08_graph_symdiff", _REGION_TRIPLES)
def s08_symdiff(spark, folder):
    return _text(G.symmetric_difference(triples_of(spark, folder, "nation", "region"), triples_of(spark, folder, "nation")))


@query("v02_stats", "SELECT count(*) * 3 AS triples, count(*) AS subjects, 3::BIGINT AS predicates, count(DISTINCT n_name) + count(DISTINCT n_regionkey) + 1 AS objects, count(*) + count(DISTINCT n_regionkey) + 1 + 3 AS uri_refs, 0::BIGINT AS blank_nodes, count(DISTINCT n_name) AS literals FROM nation")
def v02(spark, folder):
    return G.graph_stats(triples_of(spark, folder, "nation"))


@query("v03_components", f"""SELECT '<{E}nation/' || n_nationkey || '>' AS node, min('<{E}nation/' || n_nationkey || '>') OVER (PARTITION BY n_regionkey) AS component FROM nation
    UNION SELECT '<{E}region/' || n_regionkey || '>', min('<{E}nation/' || n_nationkey || '>') OVER (PARTITION BY n_regionkey) FROM nation""")
def v03(spark, folder):
    return G.connected_components(G.match(triples_of(spark, folder, "nation"), p=f"{E}v#n_regionkey"))


@query("v05_transitive_objects", f"SELECT '{E}orders/5' AS node UNION SELECT '{E}customer/' || o_custkey FROM orders WHERE o_orderkey = 5")
def v05(spark, folder):
    return G.transitive(triples_of(spark, folder, "orders"), iri(f"{E}orders/5"), f"{E}v#o_custkey").select(F.col("node.v").alias("node"))


@query("v06_all_nodes", f"SELECT DISTINCT s AS node FROM ({_NATION_TRIPLES}) UNION SELECT DISTINCT o FROM ({_NATION_TRIPLES})")
def v06(spark, folder):
    return G.all_nodes(triples_of(spark, folder, "nation")).select(n3_col(F.col("node")).alias("node"))


@query("v07_void", f"""WITH t AS ({_NATION_TRIPLES}) SELECT 'dataset' AS kind, '' AS item, count(*) AS triples, count(DISTINCT s) AS entities FROM t
    UNION ALL SELECT 'property', p[2:-2], count(*), count(DISTINCT s) FROM t GROUP BY p
    UNION ALL SELECT 'class', o[2:-2], count(*), count(DISTINCT s) FROM t WHERE p = '{_RDF_TYPE}' GROUP BY o""")
def v07(spark, folder):
    return G.void_statistics(triples_of(spark, folder, "nation"))


@query("b01_ntriples_round_trip", _NATION_TRIPLES)
def b01(spark, folder):
    from lattica.sources.text import _statements, ntriples_lines

    return _text(_statements(ntriples_lines(triples_of(spark, folder, "nation"))))


@query("b12_patch", _REGION_TRIPLES)
def b12(spark, folder):
    from lattica.sources.text import apply_patch, patch_lines

    before, after = triples_of(spark, folder, "nation"), triples_of(spark, folder, "region")
    return _text(apply_patch(before, patch_lines(before, after)))


@query("f38_text_index", f"""SELECT DISTINCT '{E}documents/' || doc_id AS d FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[\\s!-/:-@\\[-`{{-~]+') AS t FROM documents)
    WHERE list_contains(t, 'license') AND len(list_filter(t, lambda x: starts_with(x, 'ver'))) > 0""")
def f38(spark, folder):
    from lattica.operators.textsearch import build_index, search

    index = build_index(triples_of(spark, folder, "documents"), [f"{E}v#text"])
    return search(index, "license ver*").select(F.col("s.v").alias("d"))


_ORDER_ROWS = f"""'{E}orders/' || o_orderkey"""


@query("i10_datalog_closure", f"""SELECT DISTINCT '{E}' || a AS a, '{E}' || b AS b FROM (
    SELECT 'customer/' || c_custkey AS a, 'nation/' || c_nationkey AS b FROM customer
    UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation
    UNION SELECT 'customer/' || c_custkey, 'region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def i10(spark, folder):
    from lattica.operators.rules import reason

    g = triples_of(spark, folder, "customer", "nation")
    rules = """@prefix v: <http://ex.org/v#> .
        { ?x v:c_nationkey ?y } => { ?x v:within ?y } . { ?x v:n_regionkey ?y } => { ?x v:within ?y } .
        { ?x v:within ?y . ?y v:within ?z } => { ?x v:within ?z } ."""
    return reason(g, rules).where(f"p = '{E}v#within'").select(F.col("s.v").alias("a"), F.col("o.v").alias("b"))


@query("i11_negation", f"SELECT '{E}customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def i11(spark, folder):
    from lattica.operators.rules import reason

    g = triples_of(spark, folder, "customer", "orders").where(F.col("p").isin(f"{E}v#o_custkey", f"{E}v#c_name"))
    rules = """@prefix v: <http://ex.org/v#> . @prefix e: <http://ex.org/> .
        { ?o v:o_custkey ?c } => { ?c a e:Buyer } . { ?c v:c_name ?n . not { ?c a e:Buyer } } => { ?c a e:Idle } ."""
    return reason(g, rules).where(F.col("o.v") == f"{E}Idle").select(F.col("s.v").alias("c"))


@query("i14_n3_builtins", f"SELECT '{E}customer/' || c_custkey AS c, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 9000")
def i14(spark, folder):
    from lattica.functions.values import Val, number
    from lattica.operators.rules import reason

    g = triples_of(spark, folder, "customer").where(f"p = '{E}v#c_acctbal'")
    rules = """@prefix v: <http://ex.org/v#> . @prefix math: <http://www.w3.org/2000/10/swap/math#> .
        { ?c v:c_acctbal ?b . ?b math:greaterThan 9000 . (?b 2) math:product ?t } => { ?c v:twice ?t } ."""
    out = reason(g, rules).where(f"p = '{E}v#twice'")
    return out.select(F.col("s.v").alias("c"), number(Val("any", F.col("o"))).alias("twice"))


@query("i02_rdfs_closure", f"SELECT '{E}nation/' || n_nationkey AS x, c FROM nation CROSS JOIN (VALUES ('{E}v#Nation'), ('{E}Place'), ('{E}Thing')) t(c)")
def i02(spark, folder):
    from lattica.operators.rules import rdfs_closure
    from lattica.terms import RDF_TYPE, RDFS

    g = G.match(triples_of(spark, folder, "nation"), p=RDF_TYPE)
    schema = G.from_triples(spark, [(iri(f"{E}v#Nation"), RDFS + "subClassOf", iri(f"{E}Place")), (iri(f"{E}Place"), RDFS + "subClassOf", iri(f"{E}Thing"))])
    return rdfs_closure(G.union(g, schema)).where(f"p = '{RDF_TYPE}'").select(F.col("s.v").alias("x"), F.col("o.v").alias("c"))


_SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix v: <http://ex.org/v#> . @prefix e: <http://ex.org/> .
    e:S a sh:NodeShape ; sh:targetClass v:Customer ; """


def _violations(spark, folder, shape: str, *names: str) -> DataFrame:
    from lattica.operators.shacl import validate

    report = validate(triples_of(spark, folder, *names), _SHAPES + shape)
    return report.select("focus", "component")


@query("i22_shacl_mincount", f"SELECT '<{E}customer/' || c_custkey || '>' AS focus, 'MinCountConstraintComponent' AS component FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def i22(spark, folder):
    return _violations(spark, folder, "sh:property [ sh:path [ sh:inversePath v:o_custkey ] ; sh:minCount 1 ] .", "customer", "orders")


@query("i23_shacl_range", f"""SELECT '<{E}customer/' || c_custkey || '>' AS focus, 'MinInclusiveConstraintComponent' AS component FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT '<{E}customer/' || c_custkey || '>', 'InConstraintComponent' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')""")
def i23(spark, folder):
    return _violations(spark, folder, "sh:property [ sh:path v:c_acctbal ; sh:minInclusive 0 ] ; sh:property [ sh:path v:c_mktsegment ; sh:in ('BUILDING' 'MACHINERY' 'FURNITURE') ] .", "customer")


@query("i25_shacl_or", f"SELECT '<{E}customer/' || c_custkey || '>' AS focus, 'OrConstraintComponent' AS component FROM customer WHERE NOT (c_acctbal >= 5000 OR c_mktsegment = 'BUILDING')")
def i25(spark, folder):
    return _violations(spark, folder, "sh:or ( [ sh:property [ sh:path v:c_acctbal ; sh:minInclusive 5000 ] ] [ sh:property [ sh:path v:c_mktsegment ; sh:hasValue 'BUILDING' ] ] ) .", "customer")


def _updated(spark, folder, text: str, *names: str) -> DataFrame:
    from lattica.operators.update import State

    state = State.of(spark, triples_of(spark, folder, *names)).update(text, {"v": "http://ex.org/v#", "e": E})
    return _text(state.quads.where("g is null")) if "GRAPH" not in text else state.quads.where("g is not null").select(n3_col(F.col("s")).alias("s"), "g")


@query("u01_insert_data", f"SELECT * FROM ({_REGION_TRIPLES}) UNION SELECT '<{E}region/9>', '<{E}v#r_name>', '\"NEW\"'")
def u01(spark, folder):
    return _updated(spark, folder, "INSERT DATA { e:region\\/9 v:r_name 'NEW' }", "region")


@query("u03_modify", f"""SELECT s, p, CASE WHEN p = '<{E}v#r_name>' THEN '"' || lower(o[2:-2]) || '"' ELSE o END AS o FROM ({_REGION_TRIPLES})""")
def u03(spark, folder):
    return _updated(spark, folder, "DELETE { ?r v:r_name ?n } INSERT { ?r v:r_name ?m } WHERE { ?r v:r_name ?n BIND(LCASE(?n) AS ?m) }", "region")


@query("u03_delete_where", f"SELECT * FROM ({_REGION_TRIPLES}) WHERE p <> '<{E}v#r_name>'")
def u03_delete(spark, folder):
    return _updated(spark, folder, "DELETE WHERE { ?r v:r_name ?n }", "region")


@query("u07_copy", f"SELECT s, '{E}copy' AS g FROM ({_REGION_TRIPLES})")
def u07(spark, folder):
    return _updated(spark, folder, "COPY DEFAULT TO GRAPH <http://ex.org/copy>", "region")


@query("ext_windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_window(spark, folder):
    from lattica.streaming.events import windowed

    return windowed(spark.read.parquet(f"{folder}/events.parquet")).withColumn("total", F.round("total", 4))


# -- datasets, triple terms, services, builder ------------------------------------------------------------
def _quads(spark, folder) -> Dataset:
    """Nations and regions as two named graphs of one quad table."""
    n = triples_of(spark, folder, "nation").withColumn("g", F.lit(f"{E}graph/nation"))
    r = triples_of(spark, folder, "region").withColumn("g", F.lit(f"{E}graph/region"))
    return Dataset(spark, quads=n.unionByName(r), prefixes={"v": "http://ex.org/v#", "e": E})


def quad_query(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, folder: _quads(spark, folder).query(text).df
    SQL[name] = sql


quad_query("a20_dataset_graphs", "SELECT DISTINCT ?g WHERE { GRAPH ?g { ?s ?p ?o } }", f"SELECT '{E}graph/nation' AS g UNION ALL SELECT '{E}graph/region'")
quad_query("q18_from", f"SELECT ?n FROM <{E}graph/nation> WHERE {{ ?s v:n_name ?n }}", "SELECT n_name AS n FROM nation")
quad_query("q18_from_named", f"SELECT ?g (COUNT(*) AS ?n) FROM NAMED <{E}graph/region> WHERE {{ GRAPH ?g {{ ?s ?p ?o }} }} GROUP BY ?g", f"SELECT '{E}graph/region' AS g, count(*) * 2 AS n FROM region")
quad_query("j12_quads_join", "SELECT ?n ?rn WHERE { GRAPH ?g { ?x v:n_name ?n ; v:n_regionkey ?r } GRAPH ?h { ?r v:r_name ?rn } FILTER(?g != ?h) }", "SELECT n_name AS n, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey")
quad_query("x04_generic_equality", "SELECT ?n WHERE { GRAPH ?g { ?x v:n_name ?n } FILTER(?n = 'CHINA' || ?n = 'PERU') }", "SELECT n_name AS n FROM nation WHERE n_name IN ('CHINA', 'PERU')")
quad_query("s01_generic_order", f"SELECT ?o WHERE {{ GRAPH <{E}graph/nation> {{ ?s ?p ?o }} }} ORDER BY DESC(?o) LIMIT 3", "SELECT n_name AS o FROM nation ORDER BY n_name DESC LIMIT 3")
quad_query("g11_generic_min", f"SELECT (MIN(?o) AS ?lo) (MAX(?o) AS ?hi) WHERE {{ GRAPH <{E}graph/nation> {{ ?s v:n_name ?o }} }}", "SELECT min(n_name) AS lo, max(n_name) AS hi FROM nation")
sparql("f20_triple_terms", "SELECT ?n (STR(SUBJECT(TRIPLE(?r, v:r_name, ?n))) AS ?s) (ISTRIPLE(TRIPLE(?r, v:r_name, ?n)) AS ?t) (OBJECT(TRIPLE(?r, v:r_name, ?n)) = ?n AS ?same) WHERE { ?r v:r_name ?n }",
       f"SELECT r_name AS n, '{E}region/' || r_regionkey AS s, true AS t, true AS same FROM region")
sparql("f11_iri", "SELECT (STR(IRI(CONCAT('http://d.org/', ?n))) AS ?x) WHERE { ?r v:r_name ?n }", "SELECT 'http://d.org/' || r_name AS x FROM region")
sparql("f12_bnode", "SELECT ?n (ISBLANK(BNODE(?n)) AS ?b) WHERE { ?r v:r_name ?n }", "SELECT r_name AS n, true AS b FROM region")
sparql("f14_directions", "SELECT ?n (LANGDIR(STRLANGDIR(?n, 'ar', 'rtl')) AS ?d) (HASLANG(STRLANG(?n, 'ar')) AS ?h) WHERE { ?r v:r_name ?n }", "SELECT r_name AS n, 'rtl' AS d, true AS h FROM region")
sparql("f24_random", "SELECT ?n (RAND() < 1 AS ?a) (STRLEN(STRUUID()) AS ?b) (ISIRI(UUID()) AS ?c) WHERE { ?r v:r_name ?n }", "SELECT r_name AS n, true AS a, 36::BIGINT AS b, true AS c FROM region")
sparql("f27_timezone", "SELECT ?o (TZ(?d) AS ?z) WHERE { ?o v:o_orderdate ?d }", f"SELECT '{E}orders/' || o_orderkey AS o, 'Z' AS z FROM orders")
sparql("x02_not", "SELECT ?n WHERE { ?c v:c_name ?n ; v:c_acctbal ?b FILTER(!(?b < 5000)) }", "SELECT c_name AS n FROM customer WHERE NOT c_acctbal < 5000")
sparql("x09_unary", "SELECT ?n (-?b AS ?m) (+?b AS ?p) WHERE { ?c v:c_name ?n ; v:c_acctbal ?b }", "SELECT c_name AS n, -c_acctbal AS m, c_acctbal AS p FROM customer")
sparql("x06_typed_cast_compare", "SELECT (COUNT(*) AS ?n) WHERE { ?e v:ts ?d FILTER(xsd:date(?d) >= '2024-01-01'^^xsd:date) }", "SELECT count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-01'")
sparql("j02_compatible_join", "SELECT ?n ?m ?b WHERE { { ?c v:c_name ?n ; v:c_mktsegment ?m } { ?c v:c_acctbal ?b FILTER(?b > 9500) } }", "SELECT c_name AS n, c_mktsegment AS m, c_acctbal AS b FROM customer WHERE c_acctbal > 9500")
sparql("p01_predicate", "SELECT ?s ?o WHERE { ?s (v:n_regionkey) ?o }", f"SELECT '{E}nation/' || n_nationkey AS s, '{E}region/' || n_regionkey AS o FROM nation")
sparql("p09_bound_ends", f"ASK {{ <{E}nation/3> v:n_regionkey+ ?r . ?r v:r_name ?n }}", "SELECT true AS result")
sparql("ge05_equals", "SELECT (geof:sfEquals('POINT(1 2)'^^geo:wktLiteral, 'POINT(1 2)'^^geo:wktLiteral) AS ?a) (geof:sfDisjoint('POINT(1 2)'^^geo:wktLiteral, 'POINT(3 4)'^^geo:wktLiteral) AS ?b) WHERE { ?r v:r_name ?n }", "SELECT true AS a, true AS b FROM region")
sparql("ge10_envelope", "SELECT ?n (STR(geof:envelope('LINESTRING(0 0, 2 3)'^^geo:wktLiteral)) AS ?e) WHERE { ?r v:r_name ?n }", "SELECT r_name AS n, 'POLYGON((0 0, 2 0, 2 3, 0 3, 0 0))' AS e FROM region")


@query("q19_service", "SELECT n_name AS n, n_nationkey::BIGINT AS k FROM nation")
def q19(spark, folder):
    data = graph(spark, folder)
    data.services["http://elsewhere.org/sparql"] = lambda text: spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_name").alias("n"), F.col("n_nationkey").cast("bigint").alias("k"))
    return data.query("SELECT ?n ?k WHERE { ?x v:n_name ?n SERVICE <http://elsewhere.org/sparql> { ?y ?p ?n } }").df


@query("q26_builder", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal > 9000 ORDER BY b DESC, n LIMIT 5")
def q26(spark, folder):
    from lattica.plans.builder import select

    return select("?n", "?b").where("?c v:c_name ?n", "?c v:c_acctbal ?b").filter("?b > 9000").order_by("DESC(?b)", "?n").limit(5).run(graph(spark, folder)).df


@query("v01_merge", f"SELECT * FROM ({_NATION_TRIPLES}) UNION SELECT * FROM ({_REGION_TRIPLES})")
def v01(spark, folder):
    return _text(G.merge_graphs(triples_of(spark, folder, "nation"), triples_of(spark, folder, "region")))


@query("v04_description", f"SELECT * FROM ({_REGION_TRIPLES}) WHERE s = '<{E}region/1>'")
def v04(spark, folder):
    from lattica.terms import TERM, term_col

    g = triples_of(spark, folder, "region")
    start = spark.createDataFrame([(f"{E}region/1",)], "v string").select(term_col(1, F.col("v")).cast(TERM).alias("s"))
    return _text(G.bounded_description(g, start))


@query("v08_isomorphic", "SELECT true AS same, false AS other")
def v08(spark, folder):
    g, h = triples_of(spark, folder, "nation"), triples_of(spark, folder, "region")
    return spark.createDataFrame([(G.isomorphic(g, g.orderBy("p")), G.isomorphic(g, h))], "same boolean, other boolean")


@query("a06_add_remove", f"SELECT * FROM ({_REGION_TRIPLES}) WHERE p <> '{_RDF_TYPE}'")
def a06(spark, folder):
    g = triples_of(spark, folder, "region")
    from lattica.terms import RDF_TYPE

    return _text(G.difference(g, G.match(g, p=RDF_TYPE)))


@query("t05_ottr", f"SELECT '{E}nation/' || n_nationkey AS s, n_name AS o FROM nation")
def t05(spark, folder):
    from lattica.operators.ottr import ottr_map, parse_ottr

    text = "@prefix e: <http://ex.org/> . @prefix ottr: <http://ns.ottr.xyz/0.4/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . e:N[ ottr:IRI ?id, xsd:string ?n_name ] :: { ottr:Triple(?id, e:name, ?n_name) } ."
    frame = spark.read.parquet(f"{folder}/nation.parquet").withColumn("id", F.concat(F.lit(f"{E}nation/"), F.col("n_nationkey").cast("string")))
    return ottr_map(frame, parse_ottr(text), f"{E}N").select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))


@query("b10_hextuples_round_trip", _REGION_TRIPLES)
def b10(spark, folder):
    from lattica.sources.text import read_hextuples, write_hextuples
    from lattica.storage import Tables

    path = Tables(spark, "hext").path
    write_hextuples(triples_of(spark, folder, "region"), path)
    return _text(read_hextuples(spark, path).drop("g"))


@query("b14_columnar_round_trip", f"SELECT * FROM ({_NATION_TRIPLES}) WHERE p = '<{E}v#n_name>'")
def b14(spark, folder):
    from lattica.sources.text import read_triples_table, write_triples_table
    from lattica.storage import Tables

    path = Tables(spark, "triples").path
    write_triples_table(triples_of(spark, folder, "nation"), path)
    return _text(G.match(read_triples_table(spark, path).select("s", "p", "o"), p=f"{E}v#n_name"))


@query("b16_result_json", "SELECT '{\"n\":{\"type\":\"literal\",\"value\":\"' || r_name || '\"}}' AS value FROM region")
def b16(spark, folder):
    from lattica.sources.results import json_rows

    return json_rows(graph(spark, folder).query("SELECT ?n WHERE { ?r v:r_name ?n }").terms())
