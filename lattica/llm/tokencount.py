"""Token counts of whole texts, huge ones chunk by chunk with resynchronised seams."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.storage import bounded_batches

CHUNK, OVERLAP, LIMIT = 32768, 256, 4096


def count_tokens(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_tokens`` (long) and ``over_limit`` (n_tokens > limit) of each text.

    ``model`` is the path of a sentencepiece BPE model on the executors.  Texts longer than ``chunk +
    overlap`` characters are encoded as overlapping chunks whose seams are spliced at boundaries that both
    chunks have and that the vocabulary proves stable; overlaps without one are widened.  Null and empty
    texts count 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives an empty
    result.  No shuffle takes place.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias("_text"))
    fields = [kept.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_bytes long", "n_tokens long", "over_limit boolean"])
    names = [*keep, "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lattica.llm.tokens import PieceEncoder, count_whole

        encoder = PieceEncoder(model)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            short = [t if len(t) <= chunk + overlap else "" for t in texts]
            n = [x if s == t else count_whole(encoder, t, chunk, overlap) for t, s, x in zip(texts, short, encoder.count_many(short), strict=True)]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names)

    return kept.mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    """A public vocabulary file's place; LATTICA_TOKENIZERS names another folder."""
    folder = os.environ.get("LATTICA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
