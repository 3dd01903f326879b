"""The registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.jaccard import jaccard_groups
from lattica.llm.linededup import deduplicate_lines
from lattica.llm.mixing import mix, topic_and_tokens
from lattica.llm.packing import pack_documents
from lattica.llm.pii import key_of, replace_entities
from lattica.llm.quality import judge_quality
from lattica.llm.simhash import edited_fingerprints, near_classes
from lattica.llm.storage import Scratch
from lattica.llm.tokencount import count_tokens, tokenizer_path
from lattica.llm.urlfilter import judge_urls, rules_frame
from lattica.llm.warc import deduplicated_archives

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SECRET = "surrogates of the public test corpus"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, RULES)).drop("url")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).drop("n_distinct", "n_short", "n_marks", "distance")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100).drop("row")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_archives(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), key_of(SECRET)).select("doc_id", "text", "n_entities")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = edited_fingerprints(table(spark, sf_dir, "documents"))
    prints = Scratch(spark, "op9").write(prints, "prints")
    return near_classes(prints)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(topic_and_tokens(docs)).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_token_counts, op3_quality_rules, op4_jaccard_join, op5_warc_revisits, op6_pii_surrogates, op7_line_dedup, op8_best_fit_packing, op9_simhash, op10_mixing, pipeline)}

_HOST = r"coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"

SQL = {
    "op1_url_filters": f"""
        WITH r(rule_host, rule_path, v) AS (VALUES {", ".join(str(x) for x in RULES)}),
        p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, row_number() OVER () AS i FROM pages),
        hit AS (SELECT i, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(v, length(rule_host || rule_path)) AS v
                FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY i)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN hit USING (i)""",
    "op4_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op5_warc_revisits": """
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM o""",
    "op7_line_dedup": r"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS raw, unnest(range(len(lines))) AS pos FROM d),
        t AS (SELECT doc_id, pos, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
        w AS (SELECT *, len(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) AS w FROM t WHERE line <> ''),
        c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
        v AS (SELECT doc_id, true AS ahead, list(line) OVER x AS content, min(pos) OVER x AS a, max(pos) OVER x AS b, sum(w) OVER x AS n FROM c
              WINDOW x AS (PARTITION BY doc_id ORDER BY upto - w RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
              UNION ALL
              SELECT doc_id, false, list(line) OVER x, min(pos) OVER x, max(pos) OVER x, sum(w) OVER x FROM c
              WINDOW x AS (PARTITION BY doc_id ORDER BY upto DESC RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        r AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY ahead, content ORDER BY doc_id, a) AS k FROM v WHERE n >= 50),
        g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM r WHERE k > 1),
        x AS (SELECT w.doc_id, w.pos FROM w JOIN g USING (doc_id, pos)),
        y AS (SELECT l.doc_id, array_to_string(list(l.raw ORDER BY l.pos) FILTER (x.pos IS NULL), chr(10)) AS kept, count(*) AS n_lines, count(x.pos) AS n_removed
              FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
        SELECT doc_id, CASE WHEN n_removed > 0 THEN coalesce(kept, '') ELSE text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
        FROM d LEFT JOIN y USING (doc_id)""",
}
