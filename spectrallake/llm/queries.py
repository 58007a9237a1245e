"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, embed_dedup, line_dedup, packing, piece_viterbi, prefix_trie, quality, simhash, token_counts, token_store, toxicity, url_filter
from .common import fresh_path, table, written
from .ngram_jaccard import jaccard_components

#: A-Z as a-z, in DuckDB.
LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Links and components of the documents in {docs}; defines sets(doc_id, s) and comp(doc_id, component_id).
JACCARD_CTES = f"""
words AS (SELECT doc_id, list_filter(string_split_regex({LOWERED.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {{docs}}),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS o FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM pairs WHERE 100 * o >= 80 * (nx + ny - o)),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT x AS doc_id, y AS c FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.c = b.x),
comp AS (SELECT d.doc_id, least(d.doc_id, min(r.c)) AS component_id FROM sets d LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id)
"""

OP1_SQL = f"""WITH RECURSIVE {JACCARD_CTES.format(docs="documents")}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id FROM sets s JOIN comp c ON c.doc_id = s.doc_id"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-store")
    manifest = token_store.write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.digest(token_store.read_store(manifest, folder))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).drop("score")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: The sums run in order of the components, in double precision, as they do in the operator's last step.
OP5_SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM v WHERE list_sum(list_transform(e, lambda x: abs(x))) > 0),
linked AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.93),
reach AS (SELECT x AS vec_id, y AS c FROM linked UNION SELECT r.vec_id, l.y FROM reach r JOIN linked l ON r.c = l.x),
comp AS (SELECT d.vec_id, least(d.vec_id, min(r.c)) AS component_id FROM embeddings d LEFT JOIN reach r ON r.vec_id = d.vec_id GROUP BY d.vec_id),
k AS (SELECT x, count(*) AS n_links FROM linked GROUP BY x)
SELECT c.vec_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, CAST(c.component_id AS BIGINT) AS component_id, c.vec_id = c.component_id AS kept
FROM comp c LEFT JOIN k ON k.x = c.vec_id"""


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-weights of all documents, and which of them importance resampling takes."""
    docs = table(spark, sf_dir, "documents")
    scored = written(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), "quality")
    return quality.resample(scored).select("doc_id", "n_features", "log_weight", "advantage", "gumbel_key", "sampled")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and a digest of the text that decoding gives back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_viterbi.digest(piece_viterbi.decode_ids(piece_viterbi.encode_texts(table(spark, sf_dir, "documents"), model), model))


#: The CRC-32 of an ASCII text {0}, by a table `crc_table(t)` that stands beside it.
CRC_TABLE = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) ORDER BY i) AS t FROM range(256) r(i))"""
CRC = "xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295))"


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def _least(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


def _edit(state: str, cost: str, letter: str, out: str = "") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': " + (f"list_append({state}.o, {out})" if out else f"{state}.o") + "}"


def _step(state: int, sources: tuple[int, ...], symbol: str) -> str:
    """The best way into a grammar state over one turn."""
    name = {"u": "user", "a": "assistant"}.get(symbol)
    kept = [_edit(f"f{g}", "CASE WHEN gone OR initial <> '%s' THEN 1000000 ELSE dear END" % symbol, "K", "role || ':' || text") for g in sources]
    changed = [_edit(f"f{g}", "CASE WHEN gone THEN 1000000 ELSE 1 + dear END", "R", f"'{name}:' || text") for g in sources] if name else []
    return _least(_edit(f"f{state}", "2", "D"), *kept, *changed)


_WAYS = {0: ((), ""), 1: ((0,), "s"), 2: ((0, 1, 3), "u"), 3: ((2,), "a")}


def _inserted(states: str) -> str:
    """Grammar states after up to two inserts."""
    return f"""SELECT conv_id, i, f0, f1, g2 AS f2, {_least("f3", _edit("g2", "5", "I", "'assistant:'"))} AS f3
  FROM (SELECT *, {_least("f2", *[_edit(f"f{g}", "5", "I", "'user:'") for g in (0, 1, 3)])} AS g2 FROM {states})"""


_NEXT_TURN = ", ".join(f"{_step(g, *way)} AS f{g}" for g, way in _WAYS.items())

#: The same lattice, turn by turn: the best path into each grammar state, inserts at most twice in a row.
OP11_SQL = f"""WITH RECURSIVE {CRC_TABLE},
planted AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations, crc_table),
rows AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM planted, (SELECT unnest([1, 2]) AS copy) WHERE d <> 0 AND (copy = 1 OR d = 3)),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM rows),
faulty AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
turns AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS dear FROM faulty),
ids AS (SELECT DISTINCT conv_id FROM conversations),
nothing AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}} AS f0, {", ".join(f"{{'c': CAST(1000000 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}} AS f{g}" for g in (1, 2, 3))} FROM ids),
lattice AS ({_inserted("nothing")} UNION ALL {_inserted(f"(SELECT l.conv_id, t.i, {_NEXT_TURN} FROM lattice l JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i + 1)")}),
best AS (SELECT conv_id, {_least("f0", "f3")} AS f FROM lattice QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT b.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, b.f.c AS cost, b.f.a AS audit, sha256(array_to_string(b.f.o, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = f"""WITH {CRC_TABLE},
own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
shares AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h, l FROM own, crc_table),
made AS (SELECT s.conv_id, list_concat(coalesce(b.l[1:s.h], []), s.l[s.h + 1:]) AS l FROM shares s LEFT JOIN own b ON b.conv_id = s.base),
steps AS (SELECT conv_id, unnest(range(0, len(l) + 1)) AS depth, l FROM made),
nodes AS (SELECT depth, l[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(l) = depth), '')) AS ends_sha256 FROM steps GROUP BY ALL),
linked AS (SELECT c.*, p.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (SELECT l.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN l.depth = 0 THEN 0 ELSE (l.n_convs - 1) * strlen(l.path[l.depth].t) END AS saved FROM linked l LEFT JOIN kids k ON k.depth = l.depth AND k.path = l.path),
above AS (SELECT unnest(range(0, depth + 1)) AS up, path, saved, n_children FROM valued),
sums AS (SELECT up AS depth, path[1:up] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY ALL)
SELECT CAST(v.conv_id AS BIGINT) AS conv_id, CAST(v.depth AS BIGINT) AS depth, CAST(v.parent_conv_id AS BIGINT) AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256 FROM valued v JOIN sums s ON s.depth = v.depth AND s.path = v.path"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents")))


OP13_SQL = f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, row, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM docs),
keyed AS (SELECT *, {LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id, row"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_simhash": op2_simhash,
    "op3_token_store": op3_token_store,
    "op4_url_filter": op4_url_filter,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality_resampling": op6_quality_resampling,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_piece_viterbi": op10_piece_viterbi,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL,
    "op5_embedding_dedup": OP5_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
