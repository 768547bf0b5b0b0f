"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import backoff, decontaminate, fertility, hard_negatives, jump_shards, licences, line_dedup, minmax_dedup, piece_sampling, prefix_tokens, prefix_trie, snapshots, toxicity
from kestrel.llm.tables import table

SHARDS = 8
TOKEN_LIMIT = 4096
DIGITS = 6


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of benchmark items into documents, with their tiled coverage."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility measures and verdict of each document."""
    rows = fertility.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *fertility.MEASURES)


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered turns of the conversations that no other one continues."""
    return snapshots.collapse_and_render(table(spark, sf_dir, "conversations"))


def op5_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts from the prefix tables, and the longest prefix within the limit."""
    rows = prefix_tokens.prefix_table(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
                       prefix_tokens.longest_prefix(F.col("changes"), TOKEN_LIMIT).alias("fitting_chars"))


def op6_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and slots of all documents, and their shards with one shard more."""
    rows = jump_shards.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template coverage of each document."""
    return licences.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))


def op8_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, decoded again for a check."""
    return piece_sampling.checked_digest(table(spark, sf_dir, "documents"))


def op9_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_restored")


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    rows = backoff.score(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_backoff", F.round("mean_log_score", DIGITS).alias("mean_log_score"))


def op11_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that many documents share, as digests."""
    rows = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


def op13_hyperplane_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_string_tiling, op2_min_max_hash, op3_fertility, op4_snapshot_collapse, op5_prefix_counts, op6_jump_hash,
    op7_licence_automaton, op8_gumbel_pieces, op9_deobfuscated_toxicity, op10_stupid_backoff, op11_line_bitmaps, op12_prefix_trie, op13_hyperplane_tree, pipeline)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op2_min_max_hash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)""",
    "op4_snapshot_collapse": f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
           FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
c AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY pos) AS l, count(*) AS n FROM t GROUP BY 1),
whole AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, l, n FROM c GROUP BY l, n),
kept AS (SELECT * FROM whole a WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.n > a.n AND b.l[1] = a.l[1] AND b.l[1:a.n] = a.l))
SELECT t.conv_id, pos, n AS n_turns, copies, role,
       '{snapshots.OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{snapshots.CLOSE}' || chr(10) AS rendered
FROM t JOIN kept USING (conv_id)""",
    "op10_stupid_backoff": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, v, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM u),
c1 AS (SELECT v, count(*) AS c FROM g GROUP BY 1), c2 AS (SELECT p, v, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY 1, 2),
o1 AS (SELECT doc_id, v, count(*) AS c FROM g GROUP BY 1, 2), o2 AS (SELECT doc_id, p, v, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY 1, 2, 3),
size AS (SELECT doc_id, len(w) AS n, sum(len(w)) OVER () AS total FROM w),
x AS (SELECT g.doc_id, c1.c - o1.c AS u, coalesce(c2.c - o2.c, 0) AS b, k1.c - q1.c AS k, greatest(total - n, 1) AS rest
      FROM g JOIN c1 ON c1.v = g.v JOIN o1 ON o1.doc_id = g.doc_id AND o1.v = g.v JOIN size ON size.doc_id = g.doc_id
      LEFT JOIN c2 ON c2.p = g.p AND c2.v = g.v LEFT JOIN o2 ON o2.doc_id = g.doc_id AND o2.p = g.p AND o2.v = g.v
      LEFT JOIN c1 k1 ON k1.v = g.p LEFT JOIN o1 q1 ON q1.doc_id = g.doc_id AND q1.v = g.p),
y AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (b = 0) AS n_backoff,
             avg(CASE WHEN b > 0 THEN ln(b) - ln(k) WHEN u > 0 THEN ln({backoff.ALPHA}) + ln(u) - ln(rest) ELSE ln({backoff.ALPHA}) + ln({backoff.UNSEEN}) - ln(rest) END) AS m
      FROM x GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(m, {DIGITS}) AS mean_log_score
FROM documents LEFT JOIN y USING (doc_id)""",
    "op11_line_bitmaps": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (key) GROUP BY doc_id""",
    "op12_prefix_trie": """
WITH RECURSIVE tab(i, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM tab WHERE k < 8),
ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, v) AS (SELECT c, s, 1, 4294967295 FROM ids UNION ALL
    SELECT c, s, crc.i + 1, xor(crc.v // 256, tab.v) FROM crc JOIN tab ON tab.k = 8 AND tab.i = xor(crc.v % 256, ascii(s[crc.i])) WHERE crc.i <= length(s)),
heads AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = length(s) + 1),
own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS l
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
built AS (SELECT o.c, list_concat(coalesce(b.l[1:h], []), o.l[h + 1:]) AS l FROM own o JOIN heads USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 20),
members AS (SELECT c, unnest(range(0, len(l) + 1)) AS d, l FROM built),
nodes AS (SELECT d, CASE WHEN d = 0 THEN [] ELSE l[1:d] END AS p, min(c) AS id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len(l)) AS ends,
                 CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(l[d].t), '[^\\x20\\x09-\\x0D]+')) END AS words FROM members GROUP BY 1, 2),
named AS (SELECT x.*, up.id AS parent FROM nodes x LEFT JOIN nodes up ON up.d = x.d - 1 AND up.p = CASE WHEN x.d = 1 THEN [] ELSE x.p[1:x.d - 1] END),
below AS (SELECT a.d, a.p, count(*) FILTER (b.d = a.d + 1) AS kids, sum((b.n - 1) * b.words) AS saved,
                 count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes k WHERE k.d = b.d + 1 AND CASE WHEN b.d = 0 THEN true ELSE k.p[1:b.d] = b.p END)) AS leaves
          FROM nodes a JOIN nodes b ON b.d >= a.d AND (a.d = 0 OR b.p[1:a.d] = a.p) GROUP BY 1, 2)
SELECT id AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM named JOIN below USING (d, p)""",
    "op13_hyperplane_tree": """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, n.b AS n, p.s AS ps, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank
      FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5""",
}
