"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, language_id, merkle, mixing, near_dup, phrases, quality_knn, quality_rules, secret_scan, simhash, substring_dedup, token_counts

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.whole_conversations(chat_format.rotate_perspectives(_table(spark, sf_dir, "conversations")))
    mask = F.concat_ws(",", F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))))
    return out.select("conv_id", "chunk", "perspective", "n_turns", "rendered", mask.alias("mask"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents")).drop("redacted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("__tag")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.tampered(F.col("doc_id"), F.col("text"))
    out = merkle.manifest(_table(spark, sf_dir, "documents"), check=found)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_token_counts, op3_quality_classifier, op4_quality_rules, op5_chat_formatting, op6_secret_scans, op7_decontamination, op8_language_id, op9_mixing,
        op10_minhash_near_dedup, op11_collocations, op12_simhash_near_dedup, op13_merkle_manifest, pipeline,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws, text FROM d),
pos AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
win AS (SELECT rid, i, word AS a, lead(word, 1) OVER (PARTITION BY rid ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM pos),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS u FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (
  SELECT d.doc_id, d.lang, d.source, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n - lines.u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lines USING (rid)),
t AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars ELSE 0 END AS symbol_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS repeat_share FROM s),
b AS (
  SELECT lang, source, unnest(['symbol_share', 'line_share', 'repeat_share']) AS share, unnest([symbol_share, line_share, repeat_share]) // {quality_rules.SKETCH_STEP} AS bucket
  FROM t WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words),
lv AS (
  SELECT 0 AS level, lang, source, share, bucket FROM b UNION ALL SELECT 1, lang, NULL, share, bucket FROM b UNION ALL SELECT 2, NULL, NULL, share, bucket FROM b),
c AS (SELECT level, lang, source, share, bucket, count(*) AS n FROM lv GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, share) AS total, sum(n) OVER (PARTITION BY level, lang, source, share ORDER BY bucket) AS below FROM c),
q AS (
  SELECT level, lang, source, share, max(total) AS total, min(bucket) FILTER (WHERE below * 100 >= total * 25) AS q1, min(bucket) FILTER (WHERE below * 100 >= total * 75) AS q3,
    min(bucket) FILTER (WHERE below * 100 >= total * (100 - CASE share {" ".join(f"WHEN '{k}' THEN {v}" for k, v in quality_rules.MOST.items())} END)) AS tail FROM r GROUP BY level, lang, source, share),
f AS (SELECT level, lang, source, share, total, greatest((q3 + 3 * greatest(q3 - q1, 1)) * {quality_rules.SKETCH_STEP}, (tail + 1) * {quality_rules.SKETCH_STEP} - 1) AS top FROM q),
fl AS (SELECT l.lang, l.share, (l.total * l.top + {quality_rules.PRIOR} * g.top) // (l.total + {quality_rules.PRIOR}) AS top FROM f l JOIN f g ON g.level = 2 AND g.share = l.share WHERE l.level = 1),
m AS (
  SELECT a.lang, a.source, a.share, (a.total * a.top + {quality_rules.PRIOR} * l.top) // (a.total + {quality_rules.PRIOR}) AS top
  FROM f a JOIN fl l ON l.share = a.share AND l.lang IS NOT DISTINCT FROM a.lang WHERE a.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(symbol_share AS BIGINT) AS symbol_share, CAST(line_share AS BIGINT) AS line_share,
  CAST(repeat_share AS BIGINT) AS repeat_share, base AS base_failed,
  NOT base AND coalesce(symbol_share <= x.top AND line_share <= y.top AND repeat_share <= z.top, FALSE) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base FROM t) t
LEFT JOIN m x ON x.share = 'symbol_share' AND x.lang IS NOT DISTINCT FROM t.lang AND x.source IS NOT DISTINCT FROM t.source
LEFT JOIN m y ON y.share = 'line_share' AND y.lang IS NOT DISTINCT FROM t.lang AND y.source IS NOT DISTINCT FROM t.source
LEFT JOIN m z ON z.share = 'repeat_share' AND z.lang IS NOT DISTINCT FROM t.lang AND z.source IS NOT DISTINCT FROM t.source
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(regexp_replace(role, '[^\p{L}\p{N}_-]+', '_', 'g'), ''), 'unknown') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT t.conv_id, perspective, i, role = perspective AS own, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
    text || '<|im_end|>' AS body FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM s)
SELECT conv_id, CAST(0 AS BIGINT) AS chunk, perspective, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY i) AS rendered,
  coalesce(string_agg(CAST(a AS VARCHAR) || ':' || CAST(a + length(body) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CASE rank % 3 WHEN 0 THEN -0.75::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE 0.75::DOUBLE END AS slope,
  source_size * 2 AS cap, CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100 AS goal FROM r),
l AS (
  SELECT *, (goal - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
g AS (SELECT source, source_size, slope, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.slope, CAST(floor(g.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, least(size, greatest(0, goal - ahead)) AS once, least(size, greatest(0, goal - source_size - ahead)) AS twice FROM p)
SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken,
  CASE WHEN once > 0 THEN round(2 * (ahead / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (ahead / target))), 6) END AS first_position
FROM n
"""

OP11 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM q),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i, (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT u.lang, u.phrase, u.a, l.f AS l, r.f AS r, t.n, cut, (1000::HUGEINT * u.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM u JOIN t ON t.lang = u.lang JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(w[cut + 1:u.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
j AS (SELECT lang, w, a, k, unnest(range(2, k)) AS m FROM c),
jj AS (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM j),
h AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS held FROM jj GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE held IS NULL OR 100 * held < {phrases.COVERED_PERCENT} * a
QUALIFY rank <= {phrases.TOP}
"""


def _tlv(*values: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + "))"


_TEXT = "CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
#: CRC-32 of the id's digits, bit by bit: numbers from 0 on go in, -1 shifts.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT)"
_F = merkle.FANOUT
OP13 = rf"""
WITH RECURSIVE d AS (SELECT *, coalesce({_CRC} % {merkle.TAMPER_EVERY} = 0, FALSE) AS hit, row_number() OVER () AS rid FROM documents),
e AS (SELECT *, {_tlv("doc_id", "source", "lang", "n_chars", "text")} AS leaf, {_tlv("doc_id", "source", "lang", "n_chars", _TEXT)} AS found, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS tree FROM d),
leaves AS (SELECT doc_id, leaf, found, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM e),
nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS digest FROM leaves UNION ALL
  SELECT tree, level + 1, i // {_F}, any_value((n + {_F - 1}) // {_F}), sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // {_F}),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, digest FROM subroots UNION ALL
  SELECT level + 1, i // {_F}, any_value((n + {_F - 1}) // {_F}), sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // {_F}),
path AS (
  SELECT l.tree, l.i, o.level, string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < l.i // CAST(pow({_F}, o.level) AS BIGINT)) AS l, string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > l.i // CAST(pow({_F}, o.level) AS BIGINT)) AS r
  FROM leaves l JOIN nodes o ON o.tree = l.tree AND o.n > 1 AND o.i // {_F} = l.i // CAST(pow({_F}, o.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT l.tree, l.i, 1000 + o.level, string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i < s.i // CAST(pow({_F}, o.level) AS BIGINT)), string_agg(o.digest, '' ORDER BY o.i) FILTER (WHERE o.i > s.i // CAST(pow({_F}, o.level) AS BIGINT))
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN tops o ON o.n > 1 AND o.i // {_F} = s.i // CAST(pow({_F}, o.level + 1) AS BIGINT) GROUP BY ALL),
proof AS (SELECT tree, i, list(struct_pack(l := coalesce(l, ''), r := coalesce(r, '')) ORDER BY level) AS steps FROM path GROUP BY ALL),
fold AS (
  SELECT l.tree, l.i, 1 AS step, found AS digest, coalesce(steps, []) AS steps FROM leaves l LEFT JOIN proof p ON p.tree = l.tree AND p.i = l.i UNION ALL
  SELECT tree, i, step + 1, sha256(concat(steps[step].l, digest, steps[step].r)), steps FROM fold WHERE step <= len(steps))
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(coalesce(array_to_string(list_transform(f.steps, lambda x: x.l || x.r), ''), '')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN tops t ON t.n = 1 JOIN fold f ON f.tree = l.tree AND f.i = l.i AND f.step = len(f.steps) + 1
"""

SQL: dict[str, str] = {"op4_quality_rules": OP4, "op5_chat_formatting": OP5, "op9_mixing": OP9, "op11_collocations": OP11, "op13_merkle_manifest": OP13}
