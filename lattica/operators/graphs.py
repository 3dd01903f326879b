"""Operators on graphs: access, set operations, statistics, components, descriptions, collections, isomorphism.

A graph is a frame of distinct triples ``s: TERM, p: string, o: TERM``; nothing here is mutable.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.storage import Tables, fixpoint
from lattica.terms import BNODE, IRI, LITERAL, RDF, RDF_TYPE, TERM, TRIPLES, Term, bnode, iri, lit_term, n3_col, term_col


def from_triples(spark, rows) -> DataFrame:
    """A graph from (Term, Term or IRI text, Term) tuples."""
    data = [(tuple(s), p.v if isinstance(p, Term) else p, tuple(o)) for s, p, o in rows]
    return spark.createDataFrame(data, TRIPLES).distinct()


def is_term(c: Column, t: Term | None) -> Column:
    return F.lit(True) if t is None else c == lit_term(t)


# -- access -----------------------------------------------------------------------
def match(g: DataFrame, s: Term | None = None, p: str | None = None, o: Term | None = None) -> DataFrame:
    """Triples of a pattern; None is a wildcard.  Filters reach the scan."""
    return g.where(is_term(F.col("s"), s) & (F.lit(True) if p is None else F.col("p") == p) & is_term(F.col("o"), o))


def match_choices(g: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """Triples whose places hold one of the listed alternatives."""
    for name, choice in (("s", s), ("o", o)):
        if choice is not None:
            test = F.lit(False)
            for t in choice:
                test = test | (F.col(name) == lit_term(t))
            g = g.where(test)
    return g.where(F.col("p").isin(list(p))) if p is not None else g


def subjects(g: DataFrame, p: str | None = None, o: Term | None = None) -> DataFrame:
    return match(g, None, p, o).select("s").distinct()


def predicates(g: DataFrame, s: Term | None = None, o: Term | None = None) -> DataFrame:
    return match(g, s, None, o).select("p").distinct()


def objects(g: DataFrame, s: Term | None = None, p: str | None = None) -> DataFrame:
    return match(g, s, p).select("o").distinct()


def value(g: DataFrame, s: Term | None = None, p: str | None = None, o: Term | None = None) -> Term | None:
    """Some term in the one open place."""
    place = "o" if o is None else "s"
    row = match(g, s, p, o).select(place).first()
    return Term(*row[0]) if row else None


def contains(g: DataFrame, s: Term, p: str, o: Term) -> bool:
    return not match(g, s, p, o).isEmpty()


def all_nodes(g: DataFrame) -> DataFrame:
    return g.select(F.col("s").alias("node")).union(g.select(F.col("o").alias("node"))).distinct()


# -- sets --------------------------------------------------------------------------
def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(a, b).unionByName(difference(b, a))


def graph_diff(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples in both, in the first alone, in the second alone."""
    return intersect(a, b), difference(a, b), difference(b, a)


def relabelled(g: DataFrame, prefix: str) -> DataFrame:
    def new(c):
        t = F.col(c)
        return F.when(t["k"] == BNODE, term_col(BNODE, F.concat(F.lit(prefix), t["v"]))).otherwise(t).cast(TERM).alias(c)

    return g.select(new("s"), "p", new("o"))


def merge_graphs(*graphs: DataFrame) -> DataFrame:
    """Union with the blank nodes of each graph kept apart."""
    parts = [relabelled(g, f"g{i}_") for i, g in enumerate(graphs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# -- statistics --------------------------------------------------------------------
def graph_stats(g: DataFrame) -> DataFrame:
    """One row: triples, subjects, predicates, objects and the numbers of IRIs, blank nodes and literals."""
    counts = g.agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct("o").alias("objects"))
    terms = all_nodes(g).union(g.select(term_col(IRI, F.col("p")).cast(TERM))).distinct()
    kinds = terms.agg(*[F.coalesce(F.sum((F.col("node.k") == k).cast("bigint")), F.lit(0)).alias(n) for k, n in ((IRI, "uri_refs"), (BNODE, "blank_nodes"), (LITERAL, "literals"))])
    return counts.crossJoin(kinds)


def void_statistics(g: DataFrame) -> DataFrame:
    """VoID: (kind, item, triples, entities) for the whole graph, each property and each class."""
    entities = F.count_distinct("s").alias("entities")
    whole = g.agg(F.count(F.lit(1)).alias("triples"), entities).select(F.lit("dataset").alias("kind"), F.lit("").alias("item"), "triples", "entities")
    props = g.groupBy(F.col("p").alias("item")).agg(F.count(F.lit(1)).alias("triples"), entities).select(F.lit("property").alias("kind"), "item", "triples", "entities")
    classes = match(g, p=RDF_TYPE).groupBy(F.col("o.v").alias("item")).agg(F.count(F.lit(1)).alias("triples"), entities).select(F.lit("class").alias("kind"), "item", "triples", "entities")
    return whole.union(props).union(classes)


# -- traversal ---------------------------------------------------------------------
def connected_components(g: DataFrame) -> DataFrame:
    """(node, component): undirected over subjects and objects; the component is named by its least node's text.

    Alternating large-star and small-star steps over written edges: the number of rounds grows with the
    logarithm of the size, not with the diameter, and no node's neighbours are gathered.
    """
    tables = Tables(g.sparkSession, "components")
    a, b = n3_col(F.col("s")), n3_col(F.col("o"))
    e = tables.keep(g.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    alone = e.where("u = v").select("u")
    e, was = tables.keep(e.where("u <> v")), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = tables.keep(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == was:
            break
        was = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    rest = alone.select(F.col("u").alias("node")).join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(rest)


def transitive(g: DataFrame, start: Term, p: str, inverse: bool = False) -> DataFrame:
    """Nodes that ``p`` reaches from ``start`` (or that reach it), the start included."""
    tables = Tables(g.sparkSession, "transitive")
    here, there = ("o", "s") if inverse else ("s", "o")
    edges = tables.keep(match(g, p=p).select(F.col(here).alias("a"), F.col(there).alias("b")).distinct())
    first = g.sparkSession.createDataFrame([(tuple(start),)], "node struct<k:tinyint,v:string,dt:string,lang:string,dir:string>")
    return fixpoint(first, lambda d, _: d.join(edges, d["node"] == edges["a"]).select(F.col("b").alias("node")), ["node"], tables)


def bounded_description(g: DataFrame, start: DataFrame) -> DataFrame:
    """Concise bounded description: the triples of the start nodes, and on through blank objects."""
    tables = Tables(g.sparkSession, "describe")
    step = lambda d, _: d.join(g, "s").where(F.col("o.k") == BNODE).select(F.col("o").alias("s"))
    nodes = fixpoint(start, step, ["s"], tables)
    return g.join(nodes, "s", "left_semi").distinct()


def skolemize(g: DataFrame, base: str = "http://example.org/.well-known/genid/") -> DataFrame:
    def new(c):
        t = F.col(c)
        return F.when(t["k"] == BNODE, term_col(IRI, F.concat(F.lit(base), t["v"]))).otherwise(t).cast(TERM).alias(c)

    return g.select(new("s"), "p", new("o"))


def de_skolemize(g: DataFrame, base: str = "http://example.org/.well-known/genid/") -> DataFrame:
    def new(c):
        t = F.col(c)
        return F.when((t["k"] == IRI) & t["v"].startswith(base), term_col(BNODE, F.substring(t["v"], F.lit(len(base) + 1), F.length(t["v"])))).otherwise(t).cast(TERM).alias(c)

    return g.select(new("s"), "p", new("o"))


# -- collections -------------------------------------------------------------------
def collection_items(g: DataFrame, head: Term) -> DataFrame:
    """(position, item) of an RDF list."""
    spark, tables = g.sparkSession, Tables(g.sparkSession, "list")
    rest = match(g, p=RDF + "rest").select(F.col("s").alias("a"), F.col("o").alias("b"))
    first = spark.createDataFrame([(0, tuple(head))], "position int, cell struct<k:tinyint,v:string,dt:string,lang:string,dir:string>")
    step = lambda d, _: d.join(rest, d["cell"] == rest["a"]).select((F.col("position") + 1).alias("position"), F.col("b").alias("cell"))
    cells = fixpoint(first, step, ["position", "cell"], tables)
    item = match(g, p=RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("item"))
    return cells.join(item, "cell").select("position", "item")


def container_items(g: DataFrame, node: Term) -> DataFrame:
    """(position, item) of a Bag, Seq or Alt."""
    n = F.regexp_extract("p", r"#_(\d+)$", 1)
    return match(g, s=node).where(F.col("p").startswith(RDF + "_")).select(n.cast("int").alias("position"), F.col("o").alias("item"))


def list_triples(items: list[Term], label: str = "list") -> tuple[Term, list]:
    """The head and the triples of an RDF list."""
    cells = [bnode(f"{label}{i}") for i in range(len(items))]
    out = []
    for i, (c, t) in enumerate(zip(cells, items, strict=True)):
        out += [(c, RDF + "first", t), (c, RDF + "rest", cells[i + 1] if i + 1 < len(cells) else iri(RDF + "nil"))]
    return (cells[0] if cells else iri(RDF + "nil")), out


# -- isomorphism and canonical form --------------------------------------------------
def colours(g: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, colour) of the blank nodes: hashes of what stands around them, refined round by round in joins.

    Edges are hashed and the hashes summed, so a node of very many edges needs no list of them.
    """
    tables = Tables(g.sparkSession, "colours")
    nodes = all_nodes(g).where(F.col("node.k") == BNODE)
    c = tables.keep(nodes.select("node", F.lit(0).cast("bigint").alias("colour")))
    for _ in range(rounds):
        a = c.select(F.col("node").alias("s"), F.col("colour").alias("cs"))
        b = c.select(F.col("node").alias("o"), F.col("colour").alias("co"))
        e = g.join(a, "s", "left").join(b, "o", "left")
        name = lambda col, colour: F.coalesce(F.col(colour).cast("string"), n3_col(F.col(col)))
        out = e.where("cs is not null").select(F.col("s").alias("node"), F.xxhash64(F.lit("out"), "p", name("o", "co")).alias("h"))
        into = e.where("co is not null").select(F.col("o").alias("node"), F.xxhash64(F.lit("in"), "p", name("s", "cs")).alias("h"))
        sums = out.union(into).groupBy("node").agg(F.sum(F.col("h").cast("decimal(20,0)")).alias("x"), F.count(F.lit(1)).alias("n"))
        new = tables.keep(c.join(sums, "node").select("node", F.xxhash64("colour", F.col("x").cast("string"), "n").alias("colour")))
        if new.agg(F.count_distinct("colour")).first() == c.agg(F.count_distinct("colour")).first():
            return new
        c = new
    return c


def graph_hash(g: DataFrame) -> str:
    """Equal for isomorphic graphs."""
    c = colours(g)
    a = c.select(F.col("node").alias("s"), F.col("colour").alias("cs"))
    b = c.select(F.col("node").alias("o"), F.col("colour").alias("co"))
    e = g.join(a, "s", "left").join(b, "o", "left")
    h = F.xxhash64(F.coalesce(F.col("cs").cast("string"), n3_col(F.col("s"))), "p", F.coalesce(F.col("co").cast("string"), n3_col(F.col("o"))))
    row = e.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)"))).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def isomorphic(a: DataFrame, b: DataFrame, limit: int = 10_000) -> bool:
    """Whether some renaming of blank nodes makes the graphs equal.

    Colours decide nearly all graphs in joins.  Only triples of nodes whose colour several nodes share are
    searched on the driver, and only up to ``limit`` of them.
    """
    a, b = a.distinct(), b.distinct()
    if a.count() != b.count() or graph_hash(a) != graph_hash(b):
        return False
    ca, cb = colours(a), colours(b)
    tied = ca.groupBy("colour").count().where("count > 1")
    if tied.isEmpty():
        return True
    blank = a.where((F.col("s.k") == BNODE) | (F.col("o.k") == BNODE))
    if blank.count() > limit:
        raise ValueError(f"more than {limit} triples with blank nodes of equal surroundings")
    rows = lambda g: [(Term(*r["s"]), r["p"], Term(*r["o"])) for r in g.where((F.col("s.k") == BNODE) | (F.col("o.k") == BNODE)).collect()]
    return bool(_mapping(rows(a), rows(b), {Term(*r[0]): r[1] for r in ca.collect()}, {Term(*r[0]): r[1] for r in cb.collect()}))


def _mapping(a: list, b: list, ca: dict, cb: dict) -> dict | None:
    want = set(b)
    by_colour: dict = {}
    for n, c in cb.items():
        by_colour.setdefault(c, []).append(n)
    order = sorted(ca, key=lambda n: (len(by_colour.get(ca[n], [])), n))

    def search(i: int, m: dict) -> dict | None:
        if i == len(order):
            return m if {(m.get(s, s), p, m.get(o, o)) for s, p, o in a} == want else None
        for c in by_colour.get(ca[order[i]], []):
            if c not in m.values():
                m2 = m | {order[i]: c}
                if all((m2.get(s, s), p, m2.get(o, o)) in want for s, p, o in a if (s.k != BNODE or s in m2) and (o.k != BNODE or o in m2)):
                    found = search(i + 1, m2)
                    if found is not None:
                        return found
        return None

    return search(0, {})


class _Issuer:
    """Identifiers in the order in which nodes ask for them."""

    def __init__(self, prefix: str, names: dict[Term, str] | None = None):
        self.prefix, self.names = prefix, dict(names or {})

    def issue(self, n: Term) -> str:
        if n not in self.names:
            self.names[n] = f"{self.prefix}{len(self.names)}"
        return self.names[n]

    def copy(self) -> _Issuer:
        return _Issuer(self.prefix, self.names)


class _Canonical:
    """The labelling of RDFC-1.0 for the triples of a small graph, on the driver."""

    def __init__(self, triples: list):
        self.at: dict[Term, list] = {}
        for t in dict.fromkeys(triples):
            for n in {t[0], t[2]}:
                if n.k == BNODE:
                    self.at.setdefault(n, []).append(t)
        self.issued = _Issuer("c14n")
        self.first = {n: self.first_degree(n) for n in self.at}

    @staticmethod
    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def first_degree(self, n: Term) -> str:
        """The hash of a node's own triples, where it is _:a and any other blank node _:z."""
        show = lambda t: ("_:a" if t == n else "_:z") if t.k == BNODE else t.n3()
        return self.digest("".join(sorted(f"{show(s)} <{p}> {show(o)} .\n" for s, p, o in self.at[n])))

    def related(self, other: Term, predicate: str, issuer: _Issuer, place: str) -> str:
        known = self.issued.names.get(other) or issuer.names.get(other)
        return self.digest(f"{place}<{predicate}>" + (f"_:{known}" if known else self.first[other]))

    def n_degree(self, n: Term, issuer: _Issuer) -> tuple[str, _Issuer]:
        """The hash of a node by the paths that lead on from it, and the issuer of the least of them."""
        groups: dict[str, list[Term]] = {}
        for s, p, o in self.at[n]:
            for other, place in ((s, "s"), (o, "o")):
                if other.k == BNODE and other != n:
                    groups.setdefault(self.related(other, p, issuer, place), []).append(other)
        data = ""
        for h in sorted(groups):
            best: tuple[str, _Issuer] | None = None
            for order in itertools.permutations(groups[h]):
                found = self.path(order, issuer.copy(), best and best[0])
                if found is not None and (best is None or found[0] < best[0]):
                    best = found
            data += h + best[0]
            issuer = best[1]
        return self.digest(data), issuer

    def path(self, order: tuple[Term, ...], issuer: _Issuer, best: str | None) -> tuple[str, _Issuer] | None:
        """The path of one order; None once it can't be less than the best one."""
        longer = lambda text: best is not None and len(text) >= len(best) and text > best
        text, deeper = "", []
        for other in order:
            if other in self.issued.names:
                text += f"_:{self.issued.names[other]}"
            else:
                if other not in issuer.names:
                    deeper.append(other)
                text += f"_:{issuer.issue(other)}"
            if longer(text):
                return None
        for other in deeper:
            h, after = self.n_degree(other, issuer)
            text += f"_:{issuer.issue(other)}<{h}>"
            issuer = after
            if longer(text):
                return None
        return text, issuer

    def labels(self) -> dict[Term, str]:
        groups: dict[str, list[Term]] = {}
        for n, h in self.first.items():
            groups.setdefault(h, []).append(n)
        for h in sorted(groups):
            if len(groups[h]) == 1:
                self.issued.issue(groups[h][0])
        for h in sorted(groups):
            if len(groups[h]) == 1:
                continue
            paths = []
            for n in groups[h]:
                if n not in self.issued.names:
                    temporary = _Issuer("b")
                    temporary.issue(n)
                    paths.append(self.n_degree(n, temporary))
            for _, issuer in sorted(paths, key=lambda x: x[0]):
                for n in issuer.names:
                    self.issued.issue(n)
        return self.issued.names


def canonical_labels(triples: list) -> dict[Term, str]:
    """RDFC-1.0 labels ``c14n0``, ... of the blank nodes of a small graph: the same for every renaming of its nodes.

    Nodes that the hashes of their own triples tell apart cost a sort; others are compared by all paths that lead on
    from them, which takes time factorial in the number of alike neighbours of a node.
    """
    return _Canonical(triples).labels()


def canonical_text(triples: list) -> str:
    """Sorted N-Triples with canonical blank node labels."""
    names = canonical_labels(triples)
    new = lambda t: bnode(names[t]) if t in names else t
    return "".join(sorted(f"{new(s).n3()} <{p}> {new(o).n3()} .\n" for s, p, o in triples))


_serial = itertools.count()


class Describer:
    """Builds triples about one resource."""

    def __init__(self, about: Term | None = None):
        self.about = about or bnode(f"d{next(_serial)}")
        self.rows: list = []

    def type(self, cls: str) -> Describer:
        return self.property(RDF_TYPE, iri(cls))

    def label(self, text: str, lang: str = "") -> Describer:
        return self.property("http://www.w3.org/2000/01/rdf-schema#label", Term(LITERAL, text, "", lang))

    def property(self, p: str, o: Term) -> Describer:
        self.rows.append((self.about, p, o))
        return self

    def describe(self, p: str, about: Term | None = None) -> Describer:
        inner = Describer(about)
        inner.rows = self.rows
        self.property(p, inner.about)
        return inner


class Resource:
    """A node of a graph with convenient access."""

    def __init__(self, g: DataFrame, node: Term):
        self.g, self.node = g, node

    def __getitem__(self, p: str) -> Term | None:
        return value(self.g, self.node, p)

    def all(self, p: str) -> list[Term]:
        return [Term(*r[0]) for r in objects(self.g, self.node, p).toLocalIterator()]

    def types(self) -> list[Term]:
        return self.all(RDF_TYPE)

    def follow(self, p: str) -> list[Resource]:
        return [Resource(self.g, t) for t in self.all(p) if t.k != LITERAL]
