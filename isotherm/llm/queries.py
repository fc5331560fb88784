"""The numbered queries, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm import jaccard, licenses, lines, lm, lsh, media, packing, quality, ranked, resample, tokens, warc
from isotherm.llm.common import table


def op1_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.to_media(table(spark, sf_dir, "documents"))
    read = media.probe(stored.select(F.struct("doc_id", "n_bytes").alias("id"), "media"), key="id")
    cuts = F.array_join(F.transform(F.slice("clips", 2, F.greatest(F.size("clips"), F.lit(2)) - 1), lambda c: c["first_frame"].cast("string")), ",")
    feature = F.concat_ws(";", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("clips="), F.size("clips")), F.concat(F.lit("cuts="), cuts))
    return read.select("id.doc_id", "id.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "cut_1024")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.search(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(documents, labels.where(~quality.held_out()))
    scored = quality.score(documents, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op11_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: Records of equal payloads of 100 bytes or more: the smallest page_id is the response.
OP6_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f"""

#: All pairs of documents that share a shingle, and everything that their links reach.
OP9_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1 : i + 5], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a, n"""


#: Windows of lines with 50 words or more, the shortest from each line on and up to each line; what has an equal one before goes.
OP3_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS p, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS through FROM (SELECT doc_id, k, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t, len(regexp_extract_all(line, '\\S+')) AS n FROM l) WHERE n > 0),
runs AS (SELECT a.doc_id, a.p AS s, b.p + 1 AS e FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.through - a.through + a.n >= 50),
windows AS (SELECT doc_id, s, min(e) AS e FROM runs GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM runs GROUP BY doc_id, e),
named AS MATERIALIZED (SELECT w.doc_id, s, e, string_agg(t, chr(10) ORDER BY p) AS name FROM windows w JOIN v ON v.doc_id = w.doc_id AND p >= s AND p < e GROUP BY ALL),
firsts AS (SELECT name, min((doc_id, s, e)) AS f FROM named GROUP BY name),
later AS (SELECT doc_id, s, e FROM named JOIN firsts USING (name) WHERE doc_id <> f[1] OR s >= f[3]),
gone AS (SELECT DISTINCT v.doc_id, k FROM later JOIN v ON v.doc_id = later.doc_id AND p >= s AND p < e),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM l ANTI JOIN gone USING (doc_id, k) GROUP BY l.doc_id),
sizes AS (SELECT v.doc_id, count(*) AS n_lines, count(g.k) AS n_removed FROM v LEFT JOIN gone g USING (doc_id, k) GROUP BY v.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""


#: Words as op12 and op13 have them: only A-Z lower-cased.
WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: All documents scored for all items.
OP12_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 100 - 75 + (75 * len(w)::BIGINT * n_docs) // n_words AS m FROM d, c WHERE len(w) > 0),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({WORDS_SQL}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10"""

#: crc32 by a table that its polynomial gives, byte by byte over each distinct feature.
OP13_SQL = f"""WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
both_ AS (SELECT 1 AS source, doc_id, {WORDS_SQL} AS w FROM documents UNION ALL SELECT 0, item_id, {WORDS_SQL} FROM benchmark),
runs AS MATERIALIZED (SELECT source, doc_id, CASE n WHEN 1 THEN w[i] WHEN 2 THEN w[i] || ' ' || w[i + 1] ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS f FROM (SELECT source, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM both_, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(0, len(h), 2), lambda k: ('0x' || substr(h, k + 1, 2))::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)), t),
n AS MATERIALIZED (SELECT bucket, count(*) FILTER (source = 1) AS s, count(*) FILTER (source = 0) AS t FROM runs JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM n, (SELECT coalesce(sum(s), 0)::BIGINT AS all_s, coalesce(sum(t), 0)::BIGINT AS all_t FROM n)),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM runs JOIN b USING (f) JOIN g USING (bucket) WHERE source = 1 GROUP BY doc_id),
d AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h FROM (SELECT doc_id, w FROM both_ WHERE source = 1) LEFT JOIN w USING (doc_id)),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * able // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can say whole. The tests hold the others against brute force, libraries or round trips."""
    return {"op3_line_dedup": OP3_SQL, "op6_warc": OP6_SQL, "op9_ngram_jaccard": OP9_SQL, "op12_ranked_search": OP12_SQL, "op13_importance_resampling": OP13_SQL}
