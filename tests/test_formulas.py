"""N3 built-ins on lists, formulas and goals: one rule each, compared with what it must derive."""

import pytest

from lattica.operators.graphs import from_triples
from lattica.operators.rules import reason
from lattica.terms import iri, literal

E = "http://example.org/"
HEAD = """@prefix : <http://example.org/> . @prefix list: <http://www.w3.org/2000/10/swap/list#> . @prefix graph: <http://www.w3.org/2000/10/swap/graph#> .
@prefix log: <http://www.w3.org/2000/10/swap/log#> . @prefix string: <http://www.w3.org/2000/10/swap/string#> . @prefix math: <http://www.w3.org/2000/10/swap/math#> .
"""
#: name -> (body, head object, what ?o must be)
CASES = {
    "first": ("(1 2 3) list:first ?o", ["1"]),
    "last": ("(1 2 3) list:last ?o", ["3"]),
    "rest": ("(1 2 3) list:rest ?r . ?r list:member ?o", ["2", "3"]),
    "length": ("(1 2 3) list:rest ?r . ?r list:length ?o", ["2"]),
    "append": ("((1 2) (3) ()) list:append ?r . ?r list:length ?o", ["3"]),
    "iterate": ("('a' 'b') list:iterate (?i ?x) . (?x ?i) string:concatenation ?o", ["a0", "b1"]),
    "iterate_var": ("('a' 'b') list:iterate ?p . ?p list:last ?o", ["a", "b"]),
    "sort": ("(10 9 'x' 'b') list:sort ?r . ?r log:n3String ?t . ('%s' ?t) string:format ?o", ['("9"^^<http://www.w3.org/2001/XMLSchema#integer> "10"^^<http://www.w3.org/2001/XMLSchema#integer> "b" "x")']),
    "unique": ("(1 2 1) list:unique ?r . ?r list:length ?o", ["2"]),
    "removeDuplicates": ("(1 2 1) list:removeDuplicates ?r . ?r list:length ?o", ["2"]),
    "remove": ("((1 2 1) 1) list:remove ?r . ?r list:member ?o", ["2"]),
    "remove_list": ("((1 2 3) (1 3)) list:remove ?r . ?r list:member ?o", ["2"]),
    "removeAt": ("((5 6 7) 1) list:removeAt ?r . ?r list:member ?o", ["5", "7"]),
    "memberAt": ("((5 6 7) 1) list:memberAt ?o", ["6"]),
    "memberAt_each": ("((5 6) ?i) list:memberAt ?x . (?i ?x) math:sum ?o", ["5", "7"]),
    "firstRest": ("(1 2 3) list:firstRest (?f ?r) . ?r list:length ?n . (?f ?n) math:sum ?o", ["3"]),
    "setEqualTo": ("(1 2 2) list:setEqualTo (2 1) . 'yes' string:upperCase ?o", ["YES"]),
    "setNotEqualTo": ("(1 2) list:setNotEqualTo (2 1) . 'yes' string:upperCase ?o", []),
    "multisetEqualTo": ("(1 2 2) list:multisetEqualTo (2 1) . 'yes' string:upperCase ?o", []),
    "multisetNotEqualTo": ("(1 2 2) list:multisetNotEqualTo (2 1) . 'yes' string:upperCase ?o", ["YES"]),
    "map": ("(('a' 'b') string:upperCase) list:map ?r . ?r list:member ?o", ["A", "B"]),
    "in": ("?o list:in (1 2)", ["1", "2"]),
    "pattern": ("(1 2) list:append ?none . 'x' string:upperCase ?o", []),
    "graph_length": ("{ :a :p 1 . :a :p 2 } graph:length ?o", ["2"]),
    "graph_member": ("{ :a :p 1 . :a :p 2 } graph:member { :a :p ?o }", ["1", "2"]),
    "graph_union": ("({ :a :p 1 } { :a :p 2 . :a :p 1 }) graph:union ?g . ?g graph:length ?o", ["2"]),
    "graph_intersection": ("({ :a :p 1 } { :a :p 2 . :a :p 1 }) graph:intersection ?g . ?g graph:length ?o", ["1"]),
    "graph_difference": ("({ :a :p 2 . :a :p 1 } { :a :p 1 }) graph:difference ?g . ?g log:includes { :a :p ?o }", ["2"]),
    "graph_list": ("{ :a :p 2 . :a :p 1 } graph:list ?r . ?r list:length ?o", ["2"]),
    "conjunction": ("({ :a :p 1 } { :b :p 2 }) log:conjunction ?g . ?g log:includes { :b :p ?o }", ["2"]),
    "includes_graph": ("{ :a :p 1 . :b :q 2 } log:includes { ?x :p ?y . ?z :q ?o }", ["2"]),
    "includes_known": ("?x log:includes { :n1 :v ?o }", ["1"]),
    "notIncludes": ("?s :v ?o . { :a :p 1 } log:notIncludes { :a :p ?o }", ["2", "3"]),
    "includesNotBind": ("?s :v ?o . { :a :p 1 } log:includesNotBind { :a :p ?o }", ["1"]),
    "supports": ("{ :a :p 1 . { ?x :p ?y } => { ?x :q ?y } } log:supports { :a :q ?o }", ["1"]),
    "conclusion": ("{ :a :p 1 . { ?x :p ?y } => { ?x :q ?y } } log:conclusion ?g . ?g graph:length ?o", ["2"]),
    "inferences": ("{ :a :p 1 . { ?x :p ?y } => { ?x :q ?y } } log:inferences ?g . ?g graph:length ?o", ["1"]),
    "rawType": ("(1) log:rawType ?o", ["http://www.w3.org/1999/02/22-rdf-syntax-ns#List"]),
    "rawType_formula": ("{ :a :p 1 } log:rawType ?o", ["http://www.w3.org/2000/10/swap/log#Formula"]),
    "rawType_literal": ("'x' log:rawType ?o", ["http://www.w3.org/2000/10/swap/log#Literal"]),
    "prefix": ("<http://example.org/> log:prefix ?o", [""]),
    "hasPrefix": (":a log:hasPrefix true . 'y' string:upperCase ?o", ["Y"]),
    "n3String": ("{ :a :p 'x' } log:n3String ?o", ['{ <http://example.org/a> <http://example.org/p> "x" . }']),
    "localN3String": ("(1 'x') log:localN3String ?o", ['("1"^^<http://www.w3.org/2001/XMLSchema#integer> "x")']),
    "repeat": ("3 log:repeat ?o", ["0", "1", "2"]),
    "satisfiable": ("{ :a :p 1 . { :a :p 1 } => false } log:satisfiable ?o", ["false"]),
    "satisfiable_yes": ("{ :a :p 1 } log:satisfiable ?o", ["true"]),
    "isomorphic": ("{ :a :p 1 . :a :p 2 } log:isomorphic { :a :p 2 . :a :p 1 } . 'y' string:upperCase ?o", ["Y"]),
    "trace": ("'x' log:trace 'y' . 'y' string:upperCase ?o", ["Y"]),
    "parsedAsN3": ("'<http://x/a> <http://x/p> 7 .' log:parsedAsN3 ?g . ?g log:includes { ?a <http://x/p> ?o }", ["7"]),
    "collectAllIn": ("(?v { ?s :v ?v } ?l) log:collectAllIn ?scope . ?l list:length ?o", ["3"]),
    "collectAllIn_none": ("(?v { ?s :none ?v } ?l) log:collectAllIn ?scope . ?l list:length ?o", ["0"]),
    "collectAllIn_grouped": ("?k :of ?n . (?v { ?n :v ?v } ?l) log:collectAllIn ?scope . ?l list:length ?o", ["1"]),
    "forAllIn": ("({ ?s :v ?v } { ?v math:greaterThan 0 }) log:forAllIn ?x . 'y' string:upperCase ?o", ["Y"]),
    "forAllIn_not": ("({ ?s :v ?v } { ?v math:greaterThan 1 }) log:forAllIn ?x . 'y' string:upperCase ?o", []),
    "ifThenElseIn": ("?s :v ?v . ({ ?v math:greaterThan 1 } { (?v 10) math:sum ?o } { (?v 20) math:sum ?o }) log:ifThenElseIn ?x", ["12", "13", "21"]),
    "call": ("?s :v ?v . { ?k :of ?s } log:call true . ?s :v ?o", ["1"]),
    "callWithOptional": ("?s :v ?o . { ?k :of ?s } log:callWithOptional true", ["1", "2", "3"]),
    "callWithCut": ("'x' string:upperCase ?z . { ?s :v ?o } log:callWithCut true", ["1"]),
    "callWithCleanup": ("{ ?s :v ?o } log:callWithCleanup { ?k :of ?s }", ["1"]),
    "replaceAll": ("('aXbY' ('X' 'Y') ('1' '<$1>')) string:replaceAll ?o", ["a1b<Y>"]),
    "scrapeAll": ("('k=1 k=2' 'k=([0-9])') string:scrapeAll ?l . ?l list:member ?o", ["1", "2"]),
}


@pytest.fixture(scope="module")
def derived(spark):
    """All cases in one closure."""
    facts = [(iri(E + f"n{i}"), E + "v", literal(i)) for i in (1, 2, 3)] + [(iri(E + "k1"), E + "of", iri(E + "n1"))]
    rules = HEAD + "".join(f"{{ {body} }} => {{ :{name} :is ?o }} .\n" for name, (body, _) in CASES.items() if name != "pattern")
    rows = reason(from_triples(spark, facts), rules).where(f"p = '{E}is'").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["s"]["v"].removeprefix(E), []).append(r["o"]["v"])
    return out


@pytest.mark.parametrize("name", [n for n in CASES if n != "pattern"])
def test_builtin(derived, name):
    assert sorted(derived.get(name, [])) == sorted(CASES[name][1])


def test_documents_outputs_and_changes(spark, tmp_path):
    from lattica.operators.rules import RuleParser, _Engine

    turtle = "<http://example.org/x> <http://example.org/p> 5 ."
    (tmp_path / "a.ttl").write_text(turtle)
    where = f"<file://{tmp_path}/a.ttl>"
    text = HEAD + f"""
    {{ {where} log:semantics ?g . ?g log:includes {{ ?s :p ?o }} }} => {{ :semantics :is ?o }} .
    {{ {where} log:content ?t . ?t string:length ?o }} => {{ :content :is ?o }} .
    {{ <file://{tmp_path}/none.ttl> log:semanticsOrError ?o }} => {{ :error :is 'error' }} .
    {{ :k log:outputString 'told' }} => {{ :out :is 'x' }} .
    {{ ?s :old ?v . {{ ?s :old ?v }} log:becomes {{ ?s :new ?v }} }} => {{ :change :is 'x' }} ."""
    g = from_triples(spark, [(iri(E + "s"), E + "old", literal(4))])
    parser = RuleParser(text)
    _, rules = parser.document()
    engine = _Engine(g)
    rows = {(r["s"]["v"].removeprefix(E), r["p"].removeprefix(E), r["o"]["v"]) for r in engine.close(g, rules, 100).collect()}
    assert {("semantics", "is", "5"), ("content", "is", str(len(turtle))), ("error", "is", "error"), ("out", "is", "x"), ("s", "new", "4")} <= rows
    assert not any(p == "old" for _, p, _ in rows)
    assert [tuple(r) for r in engine.outputs[0].collect()] == [(E + "k", "told")]
