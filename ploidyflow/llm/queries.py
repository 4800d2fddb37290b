"""Registered queries of the operators for training data, one for each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_chunks, delta_lloyd, html_text, kneser_ney, language, line_quality, max_tree, prefix_forest, simhash, substring, tiling, token_counts, token_output
from .common import crc_mod

#: The vocabulary file that the contracts name; any other path can be given to the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.train(docs.where(crc_mod("doc_id", 3) != 1))
    return language.predict(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "share")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir), window=50)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = kneser_ney.train(docs.where(crc_mod("doc_id", 7) != 2), order=3)
    held_out = (crc_mod("doc_id", 7) == 2).alias("held_out")
    return kneser_ney.score(docs, model).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir), words=3, radius=2)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_table(_documents(spark, sf_dir), BYTE_BPE, end_id=2)


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = line_quality.train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return line_quality.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_every=50, k=5)


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.bpe_digest(_documents(spark, sf_dir), BYTE_BPE)


def op11_max_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_tree.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=8, entries=16, rounds=6)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), BYTE_BPE, limit=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_substring": op2_substring,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_simhash": op4_simhash,
    "op5_token_output": op5_token_output,
    "op6_line_quality": op6_line_quality,
    "op7_html_text": op7_html_text,
    "op8_prefix_forest": op8_prefix_forest,
    "op9_tiling": op9_tiling,
    "op10_bpe_chunks": op10_bpe_chunks,
    "op11_max_tree": op11_max_tree,
    "op12_delta_lloyd": op12_delta_lloyd,
    "op13_token_counts": op13_token_counts,
}

_REPEATS_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w FROM documents WHERE doc_id IS NOT NULL),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) s FROM d WHERE len(w) >= 50)),
owners AS (SELECT h, min(doc_id) owner FROM windows GROUP BY h),
covered AS (SELECT DISTINCT doc_id, s + unnest(generate_series(0, 49)) i FROM windows JOIN owners USING (h) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(w) x, unnest(generate_series(1, len(w))) i FROM d),
kept AS (SELECT doc_id, count(*) n, string_agg(x, ' ' ORDER BY i) joined FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) n_words, cast(len(w) - coalesce(n, 0) AS bigint) n_removed, sha256(coalesce(joined, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


_RANKED_SQL = """
WITH d AS (SELECT row_number() OVER () rid, doc_id, {terms} w FROM documents WHERE doc_id IS NOT NULL),
total AS (SELECT count(*) n, cast(sum(len(w)) AS bigint) l FROM d WHERE len(w) > 0),
tf AS (SELECT rid, doc_id, size, t, count(*) tf FROM (SELECT rid, doc_id, len(w) size, unnest(w) t FROM d) GROUP BY ALL),
weight AS (SELECT t, cast(floor(1000 * ln((2 * cast(n AS double) + 2) / (2 * cast(df AS double) + 1))) AS bigint) weight FROM (SELECT t, count(*) df FROM tf GROUP BY t) CROSS JOIN total),
i AS (SELECT iid, item_id, t, count(*) times FROM (SELECT row_number() OVER () iid, item_id, unnest({terms}) t FROM benchmark) GROUP BY ALL),
scored AS (SELECT iid, item_id, rid, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * size * n) // l)))) AS bigint) score
 FROM i JOIN weight USING (t) JOIN tf USING (t) CROSS JOIN total GROUP BY iid, item_id, rid, doc_id)
SELECT item_id, cast(rank AS int) "rank", doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) rank FROM scored WHERE score > 0) WHERE rank <= 10""".format(
    terms="regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds written out, each over all vectors."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT rid, p, min(far) far, arg_min(e, far * {entries} + e) e FROM (
 SELECT rid, p, e, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) far FROM cut JOIN b{k} USING (p)) GROUP BY rid, p)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b{k}.c) c FROM b{k} LEFT JOIN (
 SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) c FROM (SELECT p, e, i, cast(sum(x) AS bigint) s, count(*) n FROM (SELECT p, rid, unnest(v) x, unnest(range(len(v))) i FROM cut) JOIN a{k} USING (rid, p) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x AS double)) AS bigint)) q
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT unnest(range({parts})) p),
cut AS MATERIALIZED (SELECT rid, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] v FROM kept CROSS JOIN parts),
seeds AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 e, q FROM (SELECT vec_id, min(q) q FROM kept GROUP BY vec_id ORDER BY vec_id LIMIT {entries})),
b0 AS MATERIALIZED (SELECT p, e, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] c FROM seeds CROSS JOIN parts),
{", ".join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) code, cast(sum(far) AS bigint) error FROM a{rounds} GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) sha FROM b{rounds})
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) label_error, sha codebooks_sha256 FROM kept JOIN coded USING (rid) CROSS JOIN book"""


#: SQL expresses passages that repeat, ranks and rounds of codebooks; fingerprints by XXH64, models, tokens, tiling, regions and forests it does not.
ORACLE_SQL: dict[str, str] = {"op2_substring": _REPEATS_SQL, "op11_max_tree": _RANKED_SQL, "op12_delta_lloyd": _lloyd_sql()}
