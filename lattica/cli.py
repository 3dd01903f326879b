"""Command line: ``python -m lattica.cli convert IN OUT-FORMAT`` and ``csv2rdf FILE SUBJECT BASE``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.mapping import TableMap
from lattica.sources import documents as D
from lattica.sources.text import ntriples_lines


def csv_to_triples(spark: SparkSession, path: str, subject: str, base: str) -> DataFrame:
    """Every column becomes a triple, the subject's as well; missing cells none."""
    frame = spark.read.csv(path, header=True, inferSchema=True)
    m = TableMap("csv", frame, lambda: F.url_encode(F.col(f"`{subject}`").cast("string")), base + "{}", "", {base + c: (c, "") for c in frame.columns})
    return m.triples()


def convert(spark: SparkSession, path: str, to: str) -> str:
    """A file's content in another format."""
    g = D.load(spark, path)
    if to in ("ntriples", "nquads"):
        return "".join(r[0] + "\n" for r in ntriples_lines(g).toLocalIterator())
    return D.WRITERS[to](D.collect_quads(g))


def main(args: list[str]) -> None:
    spark = SparkSession.builder.getOrCreate()
    if args[:1] == ["convert"]:
        print(convert(spark, args[1], args[2]))
    elif args[:1] == ["csv2rdf"]:
        for r in ntriples_lines(csv_to_triples(spark, *args[1:4])).toLocalIterator():
            print(r[0])
    else:
        sys.exit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
