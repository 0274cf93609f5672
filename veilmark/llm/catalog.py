"""Queries and SQL of the training-data operators, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_chat import op1_chat_formatting
from .op2_pii import op2_pii
from .op3_decontaminate import op3_benchmark_decontamination
from .op4_sentencepiece import op4_sentencepiece
from .op5_url_filter import op5_url_filter
from .op6_sharding import op6_sharding
from .op7_language import op7_language_id
from .op8_quality_rules import op8_quality_rules
from .op9_simhash import op9_simhash_near_dedup
from .op10_crf import op10_quality_crf
from .op11_prefix_trie import op11_prefix_trie
from .op12_suffix_dedup import op12_suffix_dedup
from .op13_negatives import op13_hard_negatives

_ALL = [
    op1_chat_formatting,
    op2_pii,
    op3_benchmark_decontamination,
    op4_sentencepiece,
    op5_url_filter,
    op6_sharding,
    op7_language_id,
    op8_quality_rules,
    op9_simhash_near_dedup,
    op10_quality_crf,
    op11_prefix_trie,
    op12_suffix_dedup,
    op13_hard_negatives,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
#: In words of their own: turns by list aggregation, and benchmark windows by listing all windows as texts. The other
#: operators need hashes, models, fixed points or a tokenizer that SQL does not have; tests hold them to brute force.
ORACLES: dict[str, str] = {
    "op1_chat_formatting": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?(?:INST|ANS|SYS|ROLE)\])', '[\\\1', 'g') AS body FROM t),
f AS (SELECT *, CASE role WHEN 'user' THEN '<s>[INST] ' || body || ' [/INST] </s>' WHEN 'assistant' THEN '<s>[ANS] ' || body || ' </s>' WHEN 'system' THEN '<s>[SYS] ' || body || ' </s>' ELSE '<s>[ROLE] ' || role || ' [/ROLE] ' || body || ' </s>' END AS segment FROM e),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars, string_agg(substr(sha256(segment), 1, 32), '' ORDER BY turn) AS path FROM f GROUP BY conv_id),
p AS (SELECT conv_id, turn, length(segment) AS n, row_number() OVER w AS depth, substr(path, 1, 32 * row_number() OVER w) AS prefix, dense_rank() OVER (ORDER BY path) AS leaf,
  CAST(sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS position FROM f JOIN d USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
nodes AS (SELECT prefix, min(leaf) AS chunk, min(n) AS n, min(depth) AS depth FROM p GROUP BY prefix),
placed AS (SELECT *, CAST(sum(n) OVER (ORDER BY chunk, depth ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM nodes),
ways AS (SELECT conv_id, chunk, min(stop - placed.n) AS lo, max(stop) AS hi FROM p JOIN placed USING (prefix) GROUP BY conv_id, chunk),
a AS (SELECT conv_id, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS attends FROM ways GROUP BY conv_id),
o AS (SELECT conv_id, string_agg(CAST(position AS VARCHAR), ',' ORDER BY turn) AS turn_positions FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, turn_positions, attends FROM d JOIN a USING (conv_id) JOIN o USING (conv_id)""",
    "op3_benchmark_decontamination": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_prefix_trie": r"""WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i)),
t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, length(coalesce(text, '')) AS n, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS key, turn, coalesce(role, '') AS role FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, n, key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ord(s))), lambda crc, b: xor(crc >> 8, crcs[(xor(crc, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), tab),
u AS (SELECT c.conv_id, 0 AS own, i, n, key FROM c JOIN o ON o.conv_id = c.base AND i <= h UNION ALL SELECT conv_id, 1, i, n, key FROM c JOIN o USING (conv_id) WHERE i > h),
w AS (SELECT conv_id, string_agg(key, '' ORDER BY own, i) AS path, list(n ORDER BY own, i) AS sizes FROM u GROUP BY conv_id),
f AS (SELECT conv_id, coalesce(path, '') AS path, coalesce(sizes, []) AS sizes FROM c LEFT JOIN w USING (conv_id)),
m AS (SELECT conv_id, path, d, path[1 : 32 * d] AS prefix, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS n FROM (SELECT *, unnest(range(len(sizes) + 1)) AS d FROM f)),
nodes AS (SELECT prefix, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(n) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (prefix = path), '')) AS ends_sha256 FROM m GROUP BY prefix),
kids AS (SELECT prefix[1 : 32 * (depth - 1)] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
v AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix)),
s AS (SELECT prefix[1 : 32 * a] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (prefix) LEFT JOIN nodes p ON v.depth > 0 AND p.prefix = v.prefix[1 : 32 * (v.depth - 1)]""",
    "op13_hard_negatives": r"""WITH r AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS anchor_label, c.id, c.label, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM r a, r c WHERE a.id % 100 = 0 AND c.id <> a.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10""",
}
