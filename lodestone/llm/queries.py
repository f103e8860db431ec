"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(read_table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(read_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import read_token_files, write_token_files

    return read_token_files(write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"), 4, 85, 100)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(read_table(spark, sf_dir, "documents"), 8)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("digest",))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import attribute_tokens

    return attribute_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digests, fill_in_middle

    return digests(fill_in_middle(read_table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Operators that SQL can express, for DuckDB. The others train models, run tokenizers, or find neighbours approximately.
SQL = {
    "op4_jaccard_join": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS own FROM d),
e AS (SELECT doc_id, len(own) AS n, unnest(own) AS h FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(own) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.low, s.doc_id)) AS component_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links
FROM s LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) r ON r.x = s.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) k ON k.x = s.doc_id""",
    "op6_sharding": """WITH b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS text_crc32 FROM b),
p AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM c),
t AS (SELECT *, CAST(least(7, (2 * before + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM t""",
    # crc32 by its table of 256 steps; near words by the words' one-letter deletions.
    "op12_spelling_variants": r"""WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, 3988292384 * (v & 1))) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) x WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, n, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM coded, tab),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, i, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM v) x),
pairs AS (SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.k = b.k AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.k UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.k),
best AS (SELECT x, count(*) AS n_near, arg_min(y, (-n, encode(y))) AS form, max(n) AS form_n FROM pairs JOIN v ON v.word = y GROUP BY x),
told AS (SELECT word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best ON x = word),
chain AS (SELECT word, word AS last, form AS next FROM told UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON t.word = c.next)
SELECT t.word, n, n_near, t.form, form_n, last AS root FROM told t JOIN chain c ON c.word = t.word AND c.next IS NULL""",
    "op13_fill_in_middle": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
h AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1:b], ''), '') AS middle, coalesce(array_to_string(w[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
