"""The subpackage's queries: each operator over its whole table, and the corpus pipeline."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontamination, html_extraction, importance, language_id, lexical_search, license_scan, near_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), sharding.even_tree(16), sharding.even_tree(17))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), n_words=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what a reader recovers from formatted text and loss spans."""
    for b in batches:
        rows = []
        for conv, text, starts, ends in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            turns = chat_format.parse(text)
            under = set(zip(starts, ends, strict=True))
            loss = "".join(t for _, t, a, z in turns if (a, z) in under)
            every = "".join(f"{r}\n{t}\n" for r, t, _, _ in turns)
            rows.append((conv, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(turns.unionByName(more))
    return out.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, size=3)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), width=1024, with_ids=False).drop("ids")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.05)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), folds=3)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, size=1, n_buckets=10_000, least=20, seed="2024")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = [op1_license_scan, op2_html_extraction, op3_sharding, op4_substring_dedup, op5_quality_rules, op6_chat_format, op7_near_dedup, op8_packing, op9_quality_classifier, op10_decontamination, op11_language_id, op12_importance_resampling, op13_lexical_search]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": pipeline}


WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
HARD = r"\### Assistant: </turn> ok"
TERMS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = {
    "op4_substring_dedup": f"""
WITH w AS (SELECT doc_id, {WORDS.format(t="text")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN twice USING (s)),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS t FROM each e LEFT JOIN gone g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op6_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD}' UNION ALL SELECT -7, 1, 'assistant', '{HARD}'),
e AS (
  SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>')
    THEN 1 + len(regexp_replace(text, '[^#:' || chr(92) || chr(92) || ']', '', 'g')) + (len(text) - len(replace(text, '</turn>', ''))) // 7 ELSE 0 END AS extra FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len('### ' || role || ': ' || text || '</turn>') + 1 + extra) AS BIGINT) AS formatted_chars
FROM e GROUP BY 1""",
    "op7_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
low AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)""",
    "op12_importance_resampling": f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i::BIGINT)) AS t),
d AS (SELECT doc_id, unnest({TERMS.format(t="text")}) AS w FROM documents),
b AS (SELECT unnest({TERMS.format(t="text")}) AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM b)),
bytes AS (SELECT w, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bs FROM words),
hashed AS (SELECT w, xor(list_reduce(bs, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS k FROM bytes, crc),
sk AS (SELECT k, count(*) AS n FROM d JOIN hashed USING (w) GROUP BY 1),
tk AS (SELECT k, count(*) AS n FROM b JOIN hashed USING (w) GROUP BY 1),
gain AS (
  SELECT k, CAST(floor(1000 * ln((coalesce(tk.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000) / ((sk.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS g
  FROM sk LEFT JOIN tk USING (k)),
per AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM d JOIN hashed USING (w) JOIN gain USING (k) GROUP BY 1),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN per USING (doc_id)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN placed USING (doc_id)""",
    "op13_lexical_search": f"""
WITH t AS (SELECT doc_id, unnest({TERMS.format(t="text")}) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2),
doc AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM doc),
item AS (SELECT item_id, unnest({TERMS.format(t="text")}) AS w FROM benchmark),
q AS (SELECT item_id, w, count(*) AS times FROM item GROUP BY 1, 2),
df AS (SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, whole GROUP BY w, n_docs),
score AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (w) JOIN df USING (w) JOIN doc USING (doc_id), whole GROUP BY 1, 2),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; tests/llm has plain versions of the others."""
    return dict(SQL)
