"""The corpus queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import langid
from lamina.llm.bpe import op5_bpe
from lamina.llm.counts import op6_token_counts
from lamina.llm.flac import op1_flac
from lamina.llm.forest import op7_embedding_dedup
from lamina.llm.kdtree import op9_sharding
from lamina.llm.langid import op8_langid
from lamina.llm.mixing import op3_mixing
from lamina.llm.negatives import op12_negatives
from lamina.llm.secrets import op10_secrets
from lamina.llm.simhash import op2_simhash
from lamina.llm.substrings import op4_substring_dedup
from lamina.llm.suffixes import op13_suffixes
from lamina.llm.turns import op11_turns

QUERIES = {
    "op1_flac": op1_flac,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_langid": op8_langid,
    "op9_sharding": op9_sharding,
    "op10_secrets": op10_secrets,
    "op11_turns": op11_turns,
    "op12_negatives": op12_negatives,
    "op13_suffixes": op13_suffixes,
}


# Parts of results that SQL can express where the whole can't be, each through its operator over the whole table.


def flac_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the media, without the media."""
    return op1_flac(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the mix, and whether what it takes of a document is a whole number of copies, three at most."""
    copies = F.col("taken") / F.greatest("size", F.lit(1))
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), ((copies == F.floor(copies)) & (copies <= 3)).alias("whole"))


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of each document, and whether its text has no letters."""
    return op8_langid(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == langid.UNKNOWN).alias("unknown"))


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law is applied to."""
    return op9_sharding(spark, sf_dir).select("doc_id", "size", "text_crc32", "law", "grown_shard")


def shard_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards, rows, slots that are not as they would be if each shard numbered its rows from 0 without a gap, and whether the shards' bytes are no more than the largest row apart."""
    rows = op9_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.min("slot").alias("first"))
    wrong = (F.col("slots") != F.col("n")) | (F.col("last") != F.col("n") - 1) | (F.col("first") != 0)
    return rows.agg(F.count("*").alias("shards"), F.sum("n").alias("rows"), F.count_if(wrong).alias("wrong"), (F.max("bytes") - F.min("bytes") <= F.max("largest")).alias("even"))


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (flac_payloads, mix_targets, language_folds, shard_rows, shard_numbers)}

# Oracles: SQL that knows nothing of anchors, trees or counts kept along a window.

_SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
win AS (SELECT doc_id, s, sha256(array_to_string(ws[s:s + 19], ' ')) AS h FROM starts),
late AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM late),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS text FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def _spans_sql() -> str:
    """Matches of every kind with their places, from the texts between them; entropies of windows from whole counts."""
    from lamina.llm import secrets

    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, *[p for p, _ in secrets.CLASSES.values()]]
    bits = [None, None, None, *[b for _, b in secrets.CLASSES.values()]]
    allowed = " OR ".join(f"regexp_matches(m, {quoted(p)})" for p in secrets.ALLOWED)
    parts = []
    for kind, (name, pattern, least) in enumerate(zip(secrets.KINDS, patterns, bits, strict=True)):
        group = f"len(regexp_extract(m, {quoted(pattern)}, 2)) >= 6" if name == "assign" else "true"
        if least is not None:
            window = f"list_max(list_transform(range(1, len(m) - {secrets.WINDOW - 2}), lambda i: list_aggregate(string_split(substr(m, i, {secrets.WINDOW}), ''), 'entropy')))"
            group = f"NOT ({allowed}) AND {window} >= {least}"
        parts.append(f"""SELECT doc_id, {kind} AS kind, '{name}' AS name, s AS "start", s + len(m) AS "end" FROM (
SELECT doc_id, m, sum(len(gap)) OVER w + coalesce(sum(len(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (
SELECT doc_id, regexp_extract_all(t, {quoted(pattern)}) AS ms, string_split_regex(t, {quoted(pattern)}) AS gaps FROM d)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {group}""")
    line = lambda where: f"""string_agg(name || ':' || "start"::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY "start", kind) FILTER ({where})"""
    count = lambda k: f"coalesce(count(*) FILTER (kind = {k}), 0) AS n_{secrets.KINDS[k]}"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {count(0)}, {count(1)}, {count(2)}, sha256(coalesce({line('kind < 3')}, '')) AS base_sha256, coalesce({line('kind >= 0')}, '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


#: The table of the CRC-32, from its polynomial, and the bytes of a text.
_CRC_TABLE = """crc_steps(i, c, k) AS (SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""


def _bytes(hexed: str) -> str:
    digit = lambda at: f"(instr('0123456789ABCDEF', substr({hexed}, {at}, 1)) - 1)"
    return f"list_transform(range(1, length({hexed}), 2), lambda i: (16 * {digit('i')} + {digit('i + 1')})::UBIGINT)"


def _crc(data: str) -> str:
    return f"xor(list_reduce({data}, lambda c, b: xor(c // 256, tab[(xor(c, b) % 256)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)"


_PAYLOADS = f"""WITH RECURSIVE {_CRC_TABLE}, t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, h || repeat('00', CASE WHEN h = '' THEN 64 ELSE ((64 - (length(h) // 2) % 64) % 64)::INT END) AS padded FROM t),
q AS (SELECT doc_id, h, padded, right(padded, 128) AS tail FROM p)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, (length(padded) // 2)::BIGINT AS payload_bytes, sha256(unhex(padded)) AS payload_sha256, {_crc(_bytes('tail'))}::BIGINT AS tail_crc32 FROM q, crc_table"""

#: Level by level: sources whose share passes their cap get the cap, and the others share what is left anew.
_TARGETS = r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w FROM d GROUP BY source),
step(k, capped) AS (SELECT 0, [false]::BOOL[] || list_transform(range((SELECT count(*) FROM s) - 1), lambda i: false)
  UNION ALL SELECT k + 1, (SELECT list(c[i] OR w * ((SELECT sum(n) FROM s) - coalesce(below, 0)) / open > 3 * n ORDER BY i) FROM (
    SELECT *, sum(CASE WHEN c[i] THEN 3 * n END) OVER () AS below, sum(CASE WHEN NOT c[i] THEN w END) OVER () AS open FROM (SELECT n, w, row_number() OVER (ORDER BY source NULLS LAST) AS i, capped AS c FROM s)))
  FROM step WHERE k < (SELECT count(*) FROM s)),
last AS (SELECT capped FROM step ORDER BY k DESC LIMIT 1),
r AS (SELECT source, n, w, capped[row_number() OVER (ORDER BY source NULLS LAST)] AS c FROM s, last),
t AS (SELECT source, n, CASE WHEN c THEN 3 * n ELSE w * (sum(n) OVER () - coalesce(sum(CASE WHEN c THEN 3 * n END) OVER (), 0)) / sum(CASE WHEN NOT c THEN w END) OVER () END AS target FROM r)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, round(target, 4) AS target, true AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

_FOLDS = f"""WITH RECURSIVE {_CRC_TABLE}, d AS (SELECT doc_id, text, hex(encode(doc_id::VARCHAR)) AS h FROM documents)
SELECT doc_id, coalesce({_crc(_bytes('h'))} % 4 = 2, false) AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS unknown FROM d, crc_table"""

_SHARD_ROWS = f"""WITH RECURSIVE {_CRC_TABLE}, d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, (length(h) // 2 + 16)::BIGINT AS size, coalesce({_crc(_bytes('h'))}, 0)::BIGINT AS text_crc32, 'bytes' AS law, NULL::INT AS grown_shard FROM d, crc_table"""


def _simhash_sql(k: int = 4, radius: int = 4) -> str:
    """XXH64 with seed 42 of every shingle, in 64-bit arithmetic on numbers of 128; bits by majority; components by reachability."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    two64 = 1 << 64
    mul = lambda a, b: f"(({a})::UHUGEINT * {b}::UHUGEINT % {two64}::UHUGEINT)"
    add = lambda *xs: f"(({' + '.join(f'({x})::UHUGEINT' for x in xs)}) % {two64}::UHUGEINT)"
    rotl = lambda x, r: f"((({x})::UHUGEINT * {1 << r}::UHUGEINT) % {two64}::UHUGEINT + ({x})::UHUGEINT // {1 << 64 - r}::UHUGEINT)"
    lane = lambda pos, n: "(" + " + ".join(f"b[{pos} + {i + 1}]::UHUGEINT * {1 << 8 * i}::UHUGEINT" for i in range(n)) + ")"
    word = "'[^\\x20\\x09-\\x0D]+'"
    start = [add(42, p1, p2), add(42, p2), "42::UHUGEINT", add(42, two64 - p1)]
    v = ", ".join(f"{mul(rotl(f't{i}', 31), p1)} AS v{i}" for i in range(4))
    t = ", ".join(f"{add(f'v{i}', mul(lane(f'pos + {8 * i}', 8), p2))} AS t{i}" for i in range(4))
    merged = f"SELECT id, b, n, 32 * (n // 32) AS pos, CASE WHEN n < 32 THEN {add(42, p5)} ELSE {add(*[rotl(f'v{i}', r) for i, r in enumerate((1, 7, 12, 18))])} END AS h, v0, v1, v2, v3 FROM stripes WHERE pos = 32 * (n // 32)"
    for i in range(4):
        merged = f"SELECT id, b, n, pos, CASE WHEN n < 32 THEN h ELSE {add(mul(f'xor(h, {mul(rotl(mul(f"v{i}", p2), 31), p1)})', p1), p4)} END AS h, v0, v1, v2, v3 FROM ({merged})"
    eight = add(mul(rotl("x", 27), p1), p4)
    four = add(mul(rotl("x", 23), p2), p3)
    one = mul(rotl("x", 11), p1)
    x = f"CASE WHEN n - pos >= 8 THEN xor(h, {mul(rotl(mul(lane('pos', 8), p2), 31), p1)}) WHEN n - pos >= 4 THEN xor(h, {mul(lane('pos', 4), p1)}) ELSE xor(h, {mul('b[pos + 1]', p5)}) END"
    tail = f"SELECT id, b, n, pos + CASE WHEN n - pos >= 8 THEN 8 WHEN n - pos >= 4 THEN 4 ELSE 1 END AS pos, CASE WHEN n - pos >= 8 THEN {eight} WHEN n - pos >= 4 THEN {four} ELSE {one} END AS h FROM (SELECT *, {x} AS x FROM tails WHERE pos < n)"
    done = f"SELECT id, {mul(f'xor(h, h // {1 << 33}::UHUGEINT)', p2)} AS h FROM tails WHERE pos = n"
    done = f"SELECT id, {mul(f'xor(h, h // {1 << 29}::UHUGEINT)', p3)} AS h FROM ({done})"
    done = f"SELECT id, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM ({done})"
    bit = ", ".join(f"sum(h // {1 << i}::UBIGINT % 2) * 2 > count(*) AS b{i}" for i in range(64))
    digits = " || ".join(f"substr('0123456789abcdef', 1 + {' + '.join(f'{1 << j} * b{4 * d + j}::INT' for j in range(4))}, 1)" for d in range(15, -1, -1))
    value = " + ".join(f"{1 << i}::UHUGEINT * b{i}::INT::UHUGEINT" for i in range(64))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {word}) AS ws FROM documents),
sh AS MATERIALIZED (SELECT doc_id, array_to_string(ws[i:i + {k - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
ids AS MATERIALIZED (SELECT s, row_number() OVER () AS id, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM sh)),
raw AS (SELECT id, {_bytes('x')} AS b, (length(x) // 2)::BIGINT AS n FROM ids),
stripes AS (SELECT id, b, n, 0::BIGINT AS pos, {', '.join(f'{s}::UHUGEINT AS v{i}' for i, s in enumerate(start))} FROM raw
  UNION ALL SELECT id, b, n, pos + 32, {v} FROM (SELECT id, b, n, pos, {t} FROM stripes WHERE pos + 32 <= n)),
tails AS (SELECT id, b, n, pos, {add('h', 'n')} AS h FROM ({merged}) UNION ALL {tail}),
hashes AS MATERIALIZED ({done}),
bits AS MATERIALIZED (SELECT doc_id, {bit} FROM sh JOIN ids USING (s) JOIN hashes USING (id) GROUP BY doc_id),
f AS MATERIALIZED (SELECT w.doc_id, coalesce({digits}, '0000000000000000') AS fingerprint, coalesce({value}, 0)::UBIGINT AS f FROM w LEFT JOIN bits USING (doc_id)),
u AS MATERIALIZED (SELECT f, min(doc_id) AS least FROM f GROUP BY f),
near AS MATERIALIZED (SELECT x.f AS a, y.f AS b FROM u x JOIN u y ON bit_count(xor(x.f, y.f)) <= {radius} AND x.f <> y.f),
reach AS (SELECT f AS a, f AS b FROM u UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
c AS (SELECT a, min(least) AS component_id FROM reach JOIN u ON u.f = reach.b GROUP BY a)
SELECT doc_id, fingerprint, component_id FROM f JOIN c ON f.f = c.a"""


#: Damage, faults, and the cheapest audits as strings, state by state ('' at the start, else the last initial) and row by row.
_TURNS = rf"""WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
d AS (SELECT conv_id, turn, role, text, {_crc(_bytes('h'))} % 20 AS harm FROM c, crc_table),
r AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, substr(role, 1, 1) AS ini FROM r),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM n),
step(x, ini, y) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
ins(x, n, y, lines) AS (VALUES ('', 0, '', ''), ('s', 0, 's', ''), ('u', 0, 'u', ''), ('a', 0, 'a', ''), ('', 1, 'u', E'user:\n'), ('s', 1, 'u', E'user:\n'), ('a', 1, 'u', E'user:\n'), ('u', 1, 'a', E'assistant:\n'),
  ('', 2, 'a', E'user:\nassistant:\n'), ('s', 2, 'a', E'user:\nassistant:\n'), ('a', 2, 'a', E'user:\nassistant:\n'), ('u', 2, 'u', E'assistant:\nuser:\n')),
macro AS (SELECT ins.x, 'D' AS edit, NULL::VARCHAR AS ini, ins.y, n, lines, NULL::VARCHAR AS name FROM ins
  UNION ALL SELECT ins.x, 'K', step.ini, step.y, n, lines, NULL FROM ins JOIN step ON ins.y = step.x
  UNION ALL SELECT ins.x, 'R', NULL, step.y, n, lines, CASE step.ini WHEN 'u' THEN 'user' ELSE 'assistant' END FROM ins JOIN step ON ins.y = step.x AND step.ini <> 's'),
dp(conv_id, i, x, best) AS (SELECT DISTINCT conv_id, 0::BIGINT, '', {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} FROM conversations
  UNION ALL SELECT dp.conv_id, dp.i + 1, m.y, min({{'cost': best.cost + 5 * m.n + CASE WHEN edit = 'D' THEN 2 ELSE (edit = 'R')::INT + 5 * (fault = 'truncated')::INT END,
    'audit': best.audit || repeat('I', m.n) || edit, 'lines': best.lines || m.lines || CASE WHEN edit = 'D' THEN '' ELSE coalesce(m.name, f.role) || ':' || text || chr(10) END}})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN macro m ON m.x = dp.x AND (edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR m.ini = f.ini)))
  GROUP BY dp.conv_id, dp.i, m.y),
z AS (SELECT conv_id, count(*) AS n, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
last AS (SELECT ids.conv_id, min({{'cost': best.cost + 5 * ins.n, 'audit': best.audit || repeat('I', ins.n), 'lines': best.lines || ins.lines}}) AS b FROM ids LEFT JOIN z ON ids.conv_id IS NOT DISTINCT FROM z.conv_id
  JOIN dp ON dp.conv_id IS NOT DISTINCT FROM ids.conv_id AND dp.i = coalesce(z.n, 0) JOIN ins ON dp.x = ins.x AND ins.y IN ('', 'a') GROUP BY ids.conv_id)
SELECT last.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.cost AS cost, b.audit AS audit, sha256(CASE WHEN b.lines = '' THEN '' ELSE left(b.lines, length(b.lines) - 1) END) AS repaired_sha256 FROM last LEFT JOIN z ON last.conv_id IS NOT DISTINCT FROM z.conv_id"""


_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""


#: Windows by place in the bytes; in hex a byte is two characters.
_SUFFIXES = """
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS MATERIALIZED (SELECT r, s, md5_number(substr(h, 2 * s + 1, 800)) AS a FROM (SELECT r, h, unnest(range(length(h) // 2 - 399)) AS s FROM t WHERE length(h) >= 800)),
again AS (SELECT a FROM win GROUP BY a HAVING count(*) > 1),
hit AS (SELECT r, s FROM win JOIN again USING (a)),
island AS (SELECT r, s, sum((s - coalesce(before, -1000) > 400)::INT) OVER (PARTITION BY r ORDER BY s) AS i FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM hit)),
span AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM island GROUP BY r, i),
gap AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y, a AS k FROM span UNION ALL SELECT t.r, coalesce(max(b), 0), length(any_value(h)) // 2, 1099511627776 FROM t LEFT JOIN span USING (r) GROUP BY t.r),
kept AS (SELECT r, string_agg(substr(h, (2 * x + 1)::BIGINT, (2 * (y - x))::BIGINT), '' ORDER BY k) AS kept FROM gap JOIN t USING (r) GROUP BY r),
sums AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM span GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM t JOIN kept USING (r) LEFT JOIN sums USING (r)
"""


ORACLES: dict[str, str] = {
    "op2_simhash": _simhash_sql(),
    "op4_substring_dedup": _SUBSTRINGS.strip(),
    "op7_embedding_dedup": _EMBEDDINGS.strip(),
    "op10_secrets": _spans_sql(),
    "op11_turns": _TURNS,
    "op12_negatives": _NEGATIVES.strip(),
    "op13_suffixes": _SUFFIXES.strip(),
    "flac_payloads": _PAYLOADS,
    "mix_targets": _TARGETS,
    "language_folds": _FOLDS,
    "shard_rows": _SHARD_ROWS,
    "shard_numbers": "SELECT least(40, count(*)) AS shards, count(*) AS rows, 0 AS wrong, true AS even FROM documents",
}
