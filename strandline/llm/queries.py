"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.token_counts import token_report

    return token_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.licenses import find_licenses

    return find_licenses(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op9_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.embedding_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.spellings import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.piece_spans import encoding_report

    return encoding_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_chat_format": op8_chat_format,
    "op9_embedding_dups": op9_embedding_dups,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_sentencepiece": op13_sentencepiece,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _escaped(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g')"


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)"""  # a quote is doubled in SQL
_BASE62 = "0123456789" + _UPPER + _LOWER


def _secret_spans() -> str:
    """Matches of each kind with their places, from the texts between them; a checked token's CRC-32 bit by bit."""
    kinds = [("assign", "l", _ASSIGN), ("access", "x", "AKIA[A-Z0-9]{16,}"), ("hex", "x", "[0-9a-f]{24,}"), ("github", "x", "gh[pousr]_[0-9A-Za-z]+"), ("npm", "x", "npm_[0-9A-Za-z]+")]
    found = "\n  UNION ALL ".join(f"SELECT r, '{kind}' AS kind, {o} AS o, regexp_extract_all({c}, '{e}') AS f, string_split_regex({c}, '{e}') AS p FROM t" for o, (kind, c, e) in enumerate(kinds))
    step = "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(5, 35), lambda i: CAST(ascii(substring(m, i, 1)) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})), CAST(4294967295 AS BIGINT))"
    digits = " || ".join(f"substring('{_BASE62}', CAST((crc // {62**k}) % 62 AS INTEGER) + 1, 1)" for k in range(5, -1, -1))
    return f"""
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS l FROM documents),
f AS (
  {found}),
s AS (
  SELECT r, kind, o, f[i] AS m, CAST(list_sum(list_transform(p[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda q: length(q))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM f)),
k AS (SELECT *, CASE WHEN o > 2 AND length(m) = 40 THEN {crc} END AS crc FROM s),
g AS (
  SELECT r, kind, o, a, kind || ':' || a || ':' || (a + length(m)) AS span FROM k
  WHERE CASE WHEN o = 0 THEN length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6 WHEN o < 3 THEN true ELSE crc IS NOT NULL AND substring(m, 35, 6) = {digits} END)"""


def _spellings() -> str:
    """Words with CRC-32 bit by bit; two are near if they agree without a letter, or one does with the other without one."""
    step = "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END"
    digit = "(strpos('0123456789ABCDEF', substring(x, {0}, 1)) - 1)"
    octets = f"list_transform(range(0, CAST(length(x) // 2 AS BIGINT)), lambda i: CAST({digit.format('2 * i + 1')} * 16 + {digit.format('2 * i + 2')} AS BIGINT))"
    return f"""
WITH RECURSIVE t AS (
  SELECT d, r, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS r FROM documents) GROUP BY ALL),
h AS (
  SELECT r, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {octets}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})), CAST(4294967295 AS BIGINT)) AS h
  FROM (SELECT *, hex(encode(d || ':' || r)) AS x FROM t)),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substring(r, 1, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS MATERIALIZED (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near FROM c a JOIN c b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT c.word, w.word FROM c JOIN w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM c JOIN w ON w.word = c.rest),
b AS (SELECT p.word, count(*) AS n_near, min({{'m': -w.n, 'near': near}}) AS best FROM p JOIN w ON w.word = p.near GROUP BY p.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * w.n THEN best.near END AS form, CASE WHEN -best.m >= 5 * w.n THEN -best.m END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM r JOIN f ON f.form = r.word)
SELECT word, n, n_near, form, form_n, root FROM f JOIN r USING (word)"""


def _clusters(rounds: int = 10, many: int = 8, size: int = 64) -> str:
    """Every round in full: all distances, exact sums, floors of quotients."""
    distance = f"list_sum(list_transform(range(1, {size + 1}), lambda i: CAST((v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) AS HUGEINT)))"
    assign = f"SELECT v.r, min({{{{'d': CAST({distance} AS BIGINT), 'c': c.c}}}}) AS b FROM v, c{{0}} c GROUP BY v.r"
    parts = []
    for k in range(rounds):
        parts.append(f"a{k} AS MATERIALIZED ({assign.format(k)})")
        parts.append(f"s{k} AS (SELECT c, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(x) AS y, unnest(range(1, {size + 1})) AS i FROM a{k} JOIN v USING (r)) GROUP BY c, i)")
        parts.append(f"m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY c)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (c))")
    return f"""
WITH e AS (SELECT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM e),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {many})),
{", ".join(parts)},
z AS MATERIALIZED ({assign.format(rounds)}),
y AS (SELECT b.c AS c, CAST(sum(b.d) AS BIGINT) AS i FROM z GROUP BY b.c)
SELECT v.vec_id, z.b.c AS cluster, z.b.d AS distance, y.i AS cluster_inertia, (SELECT CAST(sum(i) AS BIGINT) FROM y) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM z JOIN v USING (r) JOIN y ON y.c = z.b.c JOIN c{rounds} c ON c.c = z.b.c"""


#: Links by direct comparison of all pairs, WARC roles and chat prefixes straight from the tables.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id AS doc_id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    # a window of 13 tokens with at most two substitutions has four equal tokens in a row
    "op10_decontamination": """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS q FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
a AS (SELECT doc_id, p, w[p + 1:p + 4] AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 3)) AS p FROM t)),
b AS (SELECT item_id, j, q[j + 1:j + 4] AS g FROM (SELECT item_id, q, unnest(range(0, len(q) - 3)) AS j FROM i)),
d AS (SELECT DISTINCT doc_id, item_id, p - j AS o FROM a JOIN b USING (g)),
c AS (SELECT doc_id, item_id, o, w, q FROM d JOIN t USING (doc_id) JOIN i USING (item_id))
SELECT DISTINCT doc_id, item_id FROM c
WHERE CASE WHEN len(q) >= 13 THEN list_contains(list_transform(range(0, len(q) - 12), lambda s: o + s >= 0 AND o + s + 13 <= len(w) AND list_sum(list_transform(range(0, 13), lambda k: CASE WHEN w[o + s + k + 1] = q[s + k + 1] THEN 1 ELSE 0 END)) >= 11), true)
           ELSE len(q) >= 8 AND o >= 0 AND o + len(q) <= len(w) AND list_sum(list_transform(range(0, len(q)), lambda k: CASE WHEN w[o + k + 1] = q[k + 1] THEN 1 ELSE 0 END)) >= len(q) - (len(q) - 7) // 3 END""",
    "op4_secret_scan": f"""
WITH {_secret_spans()},
j AS (
  SELECT r, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
         string_agg(span, ',' ORDER BY a, o) FILTER (WHERE o < 3) AS base, string_agg(span, ',' ORDER BY a, o) AS spans
  FROM g GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN j USING (r)""",
    "op11_spelling_variants": _spellings(),
    "op12_centroid_clustering": _clusters(),
    "op9_embedding_dups": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id AS vec_id, min(root) AS root FROM r GROUP BY id),
c AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(m.root, e.vec_id) AS component_id, coalesce(m.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN m USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op5_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op8_chat_format": f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '' ORDER BY turn NULLS FIRST, role, sha256(text)) OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text) ROWS UNBOUNDED PRECEDING)),
e AS (SELECT k, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY ALL),
m AS (SELECT e.* FROM e ANTI JOIN (SELECT k, prefix FROM p WHERE k < n) q USING (k, prefix))
SELECT m.conv_id, m.k AS n_turns, m.n_copies,
       string_agg('<|' || {_escaped("t.role")} || '|>' || chr(10) || {_escaped("t.text")} || '<|end|>' || chr(10), '' ORDER BY t.turn NULLS FIRST, t.role, sha256(t.text)) AS rendered
FROM m JOIN t USING (conv_id) GROUP BY ALL""",
}
