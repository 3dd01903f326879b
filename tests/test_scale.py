"""What keeps larger tables within the limits, and that results stay whole."""

from pyspark.sql import functions as F

from lattica.operators.mapping import table_map
from lattica.plans.compiler import Dataset

BOX = "'POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))'^^geo:wktLiteral"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_geometry_is_dealt_over_tasks(spark):
    one = table_map(spark.range(5).withColumn("x", F.col("id") * 1.0).coalesce(1), "t", ["id"])
    data = Dataset(spark, [one], prefixes={"v": "http://ex.org/v#"})
    point = "?p v:x ?x BIND(STRDT(CONCAT('POINT(', STR(?x), ' 2)'), geo:wktLiteral) AS ?w)"
    for text in (f"SELECT ?x (geof:sfWithin(?w, {BOX}) AS ?i) (geof:sfTouches(?w, {BOX}) AS ?t) WHERE {{ {point} }}", f"SELECT ?x WHERE {{ {point} FILTER(geof:sfWithin(?w, {BOX})) }}"):
        df = data.query(text).df
        assert df.rdd.getNumPartitions() > 1
        assert rows_of(df) == ([(2.0,)] if "FILTER" in text else [(x, x == 2, x in (1, 3)) for x in (0.0, 1.0, 2.0, 3.0, 4.0)])


def test_points_relate_without_samples(monkeypatch):
    from lattica.functions import geo

    box, line = geo.parse_wkt("POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))"), geo.parse_wkt("LINESTRING(0 0, 2 2)")
    slow = [0]
    samples = geo.sample
    monkeypatch.setattr(geo, "sample", lambda *a: slow.__setitem__(0, slow[0] + 1) or samples(*a))
    for text, m in (("POINT(2 2)", "0FFFFF212"), ("POINT(1 2)", "F0FFFF212"), ("POINT(5 5)", "FF0FFF212")):
        p = geo.parse_wkt(text)
        assert geo.relate(p, box) == m and geo.relate(box, p) == "".join(m[i] for i in (0, 3, 6, 1, 4, 7, 2, 5, 8))
    assert slow[0] == 0
    assert geo.crosses(line, box) and geo.crosses(box, line) and slow[0] == 2
    assert not geo.crosses(geo.parse_wkt("LINESTRING(0 0, 1 1)"), box) and not geo.crosses(geo.parse_wkt("LINESTRING(1.5 1.5, 2 2)"), box)


def test_triple_terms_keep_plans_small(spark):
    one = table_map(spark.range(3).select("id", F.concat(F.lit('a"\\\n'), "id").alias("n")), "t", ["id"])
    data = Dataset(spark, [one], prefixes={"v": "http://ex.org/v#"})
    whole = "SELECT ?n (STR(SUBJECT(TRIPLE(?r, v:n, ?n))) AS ?s) (OBJECT(TRIPLE(?r, v:n, ?n)) = ?n AS ?same) WHERE { ?r v:n ?n }"
    bound = "SELECT ?n (STR(SUBJECT(?t)) AS ?s) (OBJECT(?t) = ?n AS ?same) WHERE { ?r v:n ?n BIND(IF(?n = '', ?n, TRIPLE(?r, v:n, ?n)) AS ?t) }"
    for text, limit in ((whole, 10_000), (bound, 200_000)):
        df = data.query(text).df
        assert len(df._jdf.queryExecution().analyzed().toString()) < limit
        assert rows_of(df) == [(f'a"\\\n{i}', f"http://ex.org/t/{i}", True) for i in range(3)]
    gone = data.query("SELECT (SUBJECT(TRIPLE(?r, v:n, ?none)) AS ?s) (OBJECT(TRIPLE(?r, v:n, 'x')) AS ?o) WHERE { ?r v:n ?n } LIMIT 1").df
    assert rows_of(gone) == [(None, "x")]


def test_rule_writes_without_static_broadcasts_and_distinct_of_lone_subjects(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from lattica.operators.graphs import from_triples
    from lattica.operators.rules import _Engine, inferences
    from lattica.terms import iri, literal

    seen, split, write, apart = [], [], DataFrameWriter.parquet, _Engine.heads_apart
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) or write(self, *a, **k))
    monkeypatch.setattr(_Engine, "heads_apart", lambda *a: split.append(apart(*a)) or split[-1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    e = lambda n: iri(f"http://e/{n}")
    g = from_triples(spark, [(e(s), f"http://e/{p}", literal(o)) for s, p, o in (("a", "p", 1), ("a", "p", 2), ("a", "q", 5), ("b", "p", 3), ("b", "q", 5))])
    rule = "@prefix : <http://e/> . { ?s :p ?x . ?s :q ?y } => { ?s :h1 ?x . ?s :h2 ?y . ?s :h3 ?x . ?s :h4 'k' } ."
    found = sorted((r.s.v[-1], r.p[-2:], r.o.v) for r in inferences(g, rule).collect())
    assert found == [("a", "h1", "1"), ("a", "h1", "2"), ("a", "h2", "5"), ("a", "h3", "1"), ("a", "h3", "2"), ("a", "h4", "k"), ("b", "h1", "3"), ("b", "h2", "5"), ("b", "h3", "3"), ("b", "h4", "k")]
    assert [x.count() for x in split[0]] == [4, 8]  # b alone; a twice, with repeats
    assert set(seen) == {"-1"} and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_only_tables_that_can_hold_the_subject_are_read(spark):
    opened = []

    def table(name, rows):
        frame = spark.createDataFrame(rows, "id string, x string")
        return table_map(lambda: opened.append(name) or frame, name, ["id"], schema=frame.schema)

    data = Dataset(spark, [table("a", [("1", "p"), ("2", "q"), ("", "r")]), table("ab", [("1", "z")])], prefixes={"v": "http://ex.org/v#", "e": "http://ex.org/"})
    assert {(r.s, r.o) for r in data.query("DESCRIBE <http://ex.org/a/2>").df.collect()} == {("<http://ex.org/a/2>", "<http://ex.org/v#A>"), ("<http://ex.org/a/2>", '"q"')}
    assert rows_of(data.query("SELECT ?s ?o WHERE { ?s a v:A ; ?p ?o }").df) == [("http://ex.org/a/1", "http://ex.org/v#A"), ("http://ex.org/a/1", "p"), ("http://ex.org/a/2", "http://ex.org/v#A"), ("http://ex.org/a/2", "q")]
    assert len(data.query("DESCRIBE ?s WHERE { ?s a v:A ; v:x 'p' }").df.collect()) == 2
    assert data.query("DESCRIBE <http://ex.org/a/> <http://other/1>").df.collect() == []
    assert set(opened) == {"a"}
    assert len(data.query("DESCRIBE <http://ex.org/a/1> <http://ex.org/ab/1>").df.collect()) == 4 and set(opened) == {"a", "ab"}
    assert len(data.query("DESCRIBE ?s <http://ex.org/ab/1> WHERE { ?s a v:A }").df.collect()) == 6
    assert rows_of(data.query("SELECT ?o WHERE { <http://ex.org/ab/1> ?p ?o }").df) == [("http://ex.org/v#Ab",), ("z",)]


def test_distinct_rows_and_states_are_planned_by_tasks(spark):
    from lattica.operators.graphs import from_triples
    from lattica.operators.shacl import validate
    from lattica.operators.update import State
    from lattica.storage import distinct_rows
    from lattica.terms import RDF_TYPE, iri, literal

    df = spark.range(8).select((F.col("id") % 3).alias("k")).coalesce(1)
    plan = distinct_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange") :]  # none before the shuffle
    assert rows_of(distinct_rows(df)) == [(0,), (1,), (2,)]
    e = lambda n: iri(f"http://e/{n}")
    g = from_triples(spark, [(e("a"), "http://e/p", literal(1)), (e("a"), RDF_TYPE, e("C")), (e("b"), RDF_TYPE, e("C"))])
    state = State.of(spark, g).update("INSERT { ?s <http://e/q> ?o } WHERE { ?s <http://e/p> ?o } ; DELETE { ?s ?p ?o } WHERE { ?s ?p ?o FILTER(?p != <http://e/q>) }")
    assert [(r.s.v, r.p, r.o.v) for r in state.quads.collect()] == [("http://e/a", "http://e/q", "1")]
    report = validate(g, "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/> . e:S a sh:NodeShape ; sh:targetClass e:C ; sh:property [ sh:path e:p ; sh:minCount 1 ] .")
    assert [r.focus for r in report.collect()] == ["<http://e/b>"]
    for out in (state.quads, report):  # written, nothing left to plan
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_without_shared_variables_are_dealt_over_tasks(spark):
    a = table_map(spark.range(6).withColumn("x", F.col("id") * 1.0).coalesce(1), "a", ["id"])
    df = Dataset(spark, [a], prefixes={"v": "http://ex.org/v#"}).query("SELECT ?p ?q WHERE { ?x v:x ?p . ?y v:x ?q FILTER(?p > ?q + 3) }").df
    assert df.rdd.getNumPartitions() > 1
    assert rows_of(df) == [(4.0, 0.0), (5.0, 0.0), (5.0, 1.0)]


def test_tasks_of_written_terms_follow_the_input(spark):
    from lattica.operators.graphs import from_triples
    from lattica.operators.rules import inferences
    from lattica.storage import Tables, distinct_rows, planned_for_terms
    from lattica.terms import iri

    assert distinct_rows(spark.range(1 << 18)).rdd.getNumPartitions() == 16 > distinct_rows(spark.range(8)).rdd.getNumPartitions()
    measured = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(measured, None)
    spark.conf.set(measured, "-1")
    try:
        rows = spark.range(90_000).select(F.when(F.col("id") < 85_000, "one").otherwise(F.col("id").cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
        keys = spark.range(1000).select(F.when(F.col("id") == 0, "one").otherwise(F.col("id").cast("string")).alias("k"), "id")
        out = Tables(spark).keep(rows.join(keys, "k"))
        per_task = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.unset(measured) if before is None else spark.conf.set(measured, before)
    assert sum(per_task) == 85_000 and max(per_task) < 60_000  # one key's rows in several tasks
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes")}
    with planned_for_terms(spark):
        assert all(spark.conf.get(k, None) != v for k, v in kept.items())
    assert {k: spark.conf.get(k, None) for k in kept} == kept
    e = lambda n: iri(f"http://e/{n}")
    g = from_triples(spark, [*((e(f"c{i}"), "http://e/in", e("n")) for i in range(9)), (e("n"), "http://e/in", e("r"))])
    found = inferences(g, "@prefix : <http://e/> . { ?x :in ?y . ?y :in ?z } => { ?x :in ?z } .")
    assert rows_of(found.select("s.v", "o.v")) == [(f"http://e/c{i}", "http://e/r") for i in range(9)]
