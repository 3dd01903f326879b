"""A fluent builder that writes query text."""

from __future__ import annotations


class Query:
    def __init__(self, form: str, head: str):
        self.form, self.head = form, head
        self.parts: list[str] = []
        self.tail: dict[str, str] = {}
        self.prefixes: dict[str, str] = {}

    def prefix(self, name: str, base: str) -> Query:
        self.prefixes[name] = base
        return self

    def where(self, *triples: str) -> Query:
        self.parts += [f"{t} ." for t in triples]
        return self

    def optional(self, *triples: str) -> Query:
        self.parts.append("OPTIONAL { " + " . ".join(triples) + " }")
        return self

    def union(self, *branches: str) -> Query:
        self.parts.append(" UNION ".join("{ " + b + " }" for b in branches))
        return self

    def minus(self, *triples: str) -> Query:
        self.parts.append("MINUS { " + " . ".join(triples) + " }")
        return self

    def filter(self, test: str) -> Query:
        self.parts.append(f"FILTER({test})")
        return self

    def bind(self, expression: str, name: str) -> Query:
        self.parts.append(f"BIND({expression} AS ?{name})")
        return self

    def values(self, name: str, *terms: str) -> Query:
        self.parts.append(f"VALUES ?{name} {{ " + " ".join(terms) + " }")
        return self

    def graph(self, name: str, *triples: str) -> Query:
        self.parts.append(f"GRAPH {name} {{ " + " . ".join(triples) + " }")
        return self

    def group_by(self, *keys: str) -> Query:
        self.tail["1"] = "GROUP BY " + " ".join(keys)
        return self

    def having(self, test: str) -> Query:
        self.tail["2"] = f"HAVING({test})"
        return self

    def order_by(self, *keys: str) -> Query:
        self.tail["3"] = "ORDER BY " + " ".join(keys)
        return self

    def limit(self, n: int) -> Query:
        self.tail["4"] = f"LIMIT {n}"
        return self

    def offset(self, n: int) -> Query:
        self.tail["5"] = f"OFFSET {n}"
        return self

    def distinct(self) -> Query:
        self.head = "DISTINCT " + self.head
        return self

    def text(self) -> str:
        head = "".join(f"PREFIX {p}: <{b}>\n" for p, b in self.prefixes.items())
        return f"{head}{self.form} {self.head} WHERE {{ {' '.join(self.parts)} }} " + " ".join(self.tail[k] for k in sorted(self.tail))

    def run(self, data):
        """The result on a dataset."""
        return data.query(self.text())


def select(*names: str) -> Query:
    return Query("SELECT", " ".join(names) or "*")


def construct(*triples: str) -> Query:
    return Query("CONSTRUCT", "{ " + " . ".join(triples) + " }")


def describe(*names: str) -> Query:
    return Query("DESCRIBE", " ".join(names))


def ask() -> Query:
    return Query("ASK", "")
