"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metrifold.llm.bpe import encode
from metrifold.llm.common import table
from metrifold.llm.decontaminate import digest_columns, scan
from metrifold.llm.fingerprints import fingerprint
from metrifold.llm.lexical import search
from metrifold.llm.near_dedup import near_duplicates
from metrifold.llm.prefix_trie import prefix_trie
from metrifold.llm.quality import classify
from metrifold.llm.secrets import find_secrets
from metrifold.llm.sharding import place
from metrifold.llm.token_counts import count_tokens
from metrifold.llm.token_shards import read_documents, write_shards
from metrifold.llm.toxicity import score
from metrifold.llm.transcripts import as_transcripts, parse


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), shards=24)


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(as_transcripts(table(spark, sf_dir, "conversations")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_scores.content", "quality_scores.metadata", "quality_scores.combined", "accepted")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), best=10)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.7)


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_benchmark_decontamination, op3_document_fingerprints, op4_secret_scans, op5_byte_level_bpe, op6_sharding, op7_token_id_output, op8_token_counts, op9_chat_formatting, op10_quality_classifier, op11_ranked_lexical_search, op12_conversation_prefix_trie, op13_toxicity)}

#: The CRC-32 table as rows of bytes.
_CRC = "t AS (SELECT i, i::BIGINT AS c, 0 AS step FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM t WHERE step < 8), tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE step = 8)"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT a AS doc_id, a AS pt FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.pt),
c AS (SELECT doc_id, min(pt) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op2_benchmark_decontamination": f"""WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iv AS (SELECT DISTINCT item_id, least(len(ws), 13) AS size, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i+12], ' '))) AS win FROM iw WHERE len(ws) > 0),
dv AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS pt, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i+size-1], ' '))) AS win FROM dw, (SELECT DISTINCT size FROM iv) z WHERE len(ws) >= size),
m AS (SELECT doc_id, dv.size, pt, item_id FROM dv JOIN iv ON iv.win = dv.win AND iv.size = dv.size),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pt, pt + size)) AS pos FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op6_sharding": f"""WITH RECURSIVE {_CRC},
b AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(strlen(text), 0) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
z AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) AS text_crc32 FROM b, tab),
s AS (SELECT doc_id, s, ('0x' || substr(md5(doc_id || ':' || s), 1, 12))::BIGINT AS draw FROM documents, range(25) q(s)),
p AS (SELECT doc_id, arg_max(s, struct_pack(a := draw, b := -s)) FILTER (s < 24) AS shard, arg_max(s, struct_pack(a := draw, b := -s)) AS grown_shard FROM s GROUP BY doc_id)
SELECT z.doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(z.doc_id::VARCHAR), 1, 12))::BIGINT, z.doc_id) - 1 AS slot, grown_shard::INT AS grown_shard FROM z JOIN p ON p.doc_id = z.doc_id""",
    "op11_ranked_lexical_search": f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(ws))::BIGINT AS nt FROM w WHERE len(ws) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
p AS (SELECT item_id, doc_id, sum(k * floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score FROM q JOIN df ON df.term = q.term JOIN tf ON tf.term = q.term, s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_conversation_prefix_trie": f"""WITH RECURSIVE {_CRC},
r AS (SELECT conv_id, dg, strlen(tx)::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) - 1 AS i FROM (SELECT conv_id, turn, coalesce(text, '') AS tx, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)])), 4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM r), tab),
q AS (SELECT c, 0 AS part, i, dg, size FROM h JOIN r ON conv_id = c - c % 5 WHERE i < h UNION ALL SELECT c, 1, i, dg, size FROM h JOIN r ON conv_id = c WHERE i >= h),
z AS (SELECT c, dg, size, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM q),
m AS (SELECT c, d, md5(string_agg(dg, '') OVER (PARTITION BY c ORDER BY d)) AS k, size FROM z UNION ALL SELECT c, 0, '', 0 FROM h),
n AS (SELECT c, max(d) AS len FROM m GROUP BY c),
v AS (SELECT k, m.d, min(m.c) AS conv, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (n.len = m.d), '')) AS ends FROM m JOIN n ON n.c = m.c GROUP BY k, m.d),
u AS (SELECT v.k, p.k AS up FROM v JOIN m p ON p.c = v.conv AND p.d = v.d - 1),
kids AS (SELECT up AS k, count(*) AS n_children FROM u GROUP BY up),
a AS (SELECT p.k, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.size)::BIGINT AS saved FROM v LEFT JOIN kids ON kids.k = v.k JOIN m p ON p.c = v.conv AND p.d <= v.d GROUP BY p.k)
SELECT v.conv AS conv_id, v.d::BIGINT AS depth, pv.conv AS parent_conv_id, v.n_convs, coalesce(kids.n_children, 0) AS n_children, a.n_leaves, a.saved AS saved_tokens, v.ends AS ends_sha256 FROM v JOIN a ON a.k = v.k LEFT JOIN kids ON kids.k = v.k LEFT JOIN u ON u.k = v.k LEFT JOIN v pv ON pv.k = u.up""",
}
