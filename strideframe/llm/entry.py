"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import hmm, line_runs, merkle, mixing, piece_fst, pq_dedup, quality_net, quality_rules, secrets_scan, simhash, token_orc, tool_calls, tsqr
from strideframe.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir, "doc_id", "source", "text"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_report(documents(spark, sf_dir))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.embedding_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(documents(spark, sf_dir))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_report(documents(spark, sf_dir))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.piece_report(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(documents(spark, sf_dir))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsqr.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir, *merkle.FIELDS)).drop("path")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_report(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_mixing, op2_secrets, op3_embeddings, op4_quality_net, op5_tool_calls, op6_quality_rules, op7_token_orc, op8_pieces, op9_simhash, op10_hmm, op11_whitening, op12_manifest, op13_line_dedup)
}

#: Sound vectors only: the driver's tables hold no nulls. Links by cosine in double precision, classes by closure.
EMBEDDINGS = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS n, vec_id AS m FROM e UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.m),
c AS (SELECT n, min(m) AS m FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT c.n AS vec_id, coalesce(k.n, 0) AS n_links, c.m AS component_id, c.n = c.m AS kept FROM c LEFT JOIN k ON k.a = c.n"""

#: Plain turns only: the driver's conversations hold no tool calls.
TOOL_CALLS = """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, role = 'system' AS sys FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn - 1 AS turn, min(coalesce(text, '')) AS text, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1, 2), z AS (SELECT DISTINCT conv_id FROM c WHERE turn = 0)
SELECT c.conv_id, c.turn, CAST(0 AS BIGINT) AS place, c.conv_id || ':' || c.turn AS call_id, CASE WHEN sys THEN 'instruct' ELSE 'respond' END AS name,
CAST(CASE WHEN sys OR c.turn = 0 OR z.conv_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS level, c.text <> '' AS valid, CASE WHEN c.text = '' THEN '$.text: minLength' END AS violation, coalesce(r.n, 0) AS n_results,
'{"arguments":{"text":' || to_json(c.text) || CASE WHEN sys THEN '' ELSE ',"turn":' || c.turn END || '},"id":"' || c.conv_id || ':' || c.turn || '","name":"' || CASE WHEN sys THEN 'instruct' ELSE 'respond' END
|| '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS line
FROM c LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn LEFT JOIN z ON c.conv_id = z.conv_id"""

QUALITY_RULES = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM p),
x AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS f FROM x),
h AS (SELECT doc_id, i, max(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h FROM f), n AS (SELECT doc_id, CAST(sum(h) AS BIGINT) AS n FROM h GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d), m AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT l) AS dups FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT p.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
coalesce(dups, 0) AS n_dup_lines, coalesce(lines, 0) AS lines, coalesce(n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS up, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS low
FROM p LEFT JOIN m ON p.doc_id = m.doc_id LEFT JOIN n ON p.doc_id = n.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 4 * n_symbols > greatest(1, n_words) OR 2 * n_dup_lines > lines OR word_chars < 2 * n_words OR word_chars > 30 * n_words OR (up > 2 * low AND up > 20)) AS kept FROM b"""

#: Leaves, trees by language, the tree over them, siblings level by level, and the fold of tampered leaves. crc32 has no
#: function, so that its table is made by rule.
MANIFEST = """WITH RECURSIVE
bits AS (SELECT b, b AS c, 0 AS s FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM bits WHERE s < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE s = 8),
d AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc32,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents, crc),
n AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY tree) AS size, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(text) || ':' || CASE WHEN crc32 % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS fake FROM d),
u AS (SELECT tree, 0 AS lv, i, size, leaf AS node FROM n
  UNION ALL SELECT tree, lv + 1, i // 8, (size + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE size > 1 GROUP BY tree, lv, i // 8, size),
r AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS size, node FROM u WHERE size = 1),
v AS (SELECT 0 AS lv, i, size, node FROM r UNION ALL SELECT lv + 1, i // 8, (size + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM v WHERE size > 1 GROUP BY lv, i // 8, size),
us AS (SELECT a.tree, a.lv, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after
  FROM u a JOIN u b ON a.tree = b.tree AND a.lv = b.lv AND a.i // 8 = b.i // 8 WHERE a.size > 1 GROUP BY 1, 2, 3),
vs AS (SELECT a.lv, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after
  FROM v a JOIN v b ON a.lv = b.lv AND a.i // 8 = b.i // 8 WHERE a.size > 1 GROUP BY 1, 2),
st AS (SELECT doc_id, us.lv AS p, before, after FROM n JOIN us ON n.tree = us.tree AND us.i = CAST(floor(n.i / pow(8, us.lv)) AS BIGINT)
  UNION ALL SELECT doc_id, 1000 + vs.lv, before, after FROM n JOIN r ON n.tree = r.tree JOIN vs ON vs.i = CAST(floor(r.i / pow(8, vs.lv)) AS BIGINT)),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, before, after FROM st),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, fake AS node FROM n UNION ALL SELECT f.doc_id, o.k, sha256(o.before || f.node || o.after) FROM f JOIN o ON f.doc_id = o.doc_id AND o.k = f.k + 1),
e AS (SELECT doc_id, arg_max(node, k) AS folded FROM f GROUP BY 1), p AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM o GROUP BY 1),
t AS (SELECT node AS root FROM v WHERE size = 1)
SELECT n.doc_id, n.leaf, r.node AS subroot, t.root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = t.root AS verified
FROM n JOIN r ON n.tree = r.tree JOIN e ON n.doc_id = e.doc_id LEFT JOIN p ON n.doc_id = p.doc_id, t"""

LINE_DEDUP = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
s AS (SELECT line_key, max(doc_id) AS keeper FROM k WHERE length(line_key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN s ON k.line_key = s.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1"""

ORACLE: dict[str, str] = {"op3_embeddings": EMBEDDINGS, "op5_tool_calls": TOOL_CALLS, "op6_quality_rules": QUALITY_RULES, "op12_manifest": MANIFEST, "op13_line_dedup": LINE_DEDUP}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
