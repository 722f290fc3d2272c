"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, crf_quality, ctph, gru_lm, html_extract, minhash_dedup, mixing, quality_rules, replay, sentencepiece_bpe, substring_dedup, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: CTEs up to ``judged``: every document (rid tells repeated rows apart) with counts, failures and ``kept``.
OP3_CTES = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, text, lang, source, n_chars, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT rid, i, list_slice(ws, i, i + 4) AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM x) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
        100 * n_symbols > 30 * n_words AS symbols_failed, 100 * n_dup_lines > 30 * n_lines AS lines_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS b, count(*) FILTER (WHERE symbols_failed) AS s,
        count(*) FILTER (WHERE lines_failed) AS l FROM f GROUP BY source),
p AS (SELECT avg(b / n) AS mb, var_pop(b / n) AS vb, avg(s / n) AS ms, var_pop(s / n) AS vs, avg(l / n) AS ml, var_pop(l / n) AS vl,
        avg(1 / n) AS one FROM h),
e AS (SELECT mb, ms, ml, vb - mb * (1 - mb) * one AS vb, vs - ms * (1 - ms) * one AS vs, vl - ml * (1 - ml) * one AS vl FROM p),
q AS (SELECT *, least(greatest(mb * (1 - mb) / nullif(vb, 0) - 1, 1.0), 1000.0) AS wb, least(greatest(ms * (1 - ms) / nullif(vs, 0) - 1, 1.0), 1000.0) AS ws,
        least(greatest(ml * (1 - ml) / nullif(vl, 0) - 1, 1.0), 1000.0) AS wl FROM e),
y AS (SELECT *, (b + mb * wb) / (n + wb) AS rb, (s + ms * ws) / (n + ws) AS rs, (l + ml * wl) / (n + wl) AS rl FROM h, q),
v AS (SELECT source, vb > 0 AND rb - 1.645 * sqrt(rb * (1 - rb) / (n + wb + 1)) >= 0.5 AS rejected,
        CASE WHEN vs > 0 THEN rs + 1.645 * sqrt(rs * (1 - rs) / (n + ws + 1)) >= ms ELSE true END AS strict_s,
        CASE WHEN vl > 0 THEN rl + 1.645 * sqrt(rl * (1 - rl) / (n + wl + 1)) >= ml ELSE true END AS strict_l FROM y),
judged AS (SELECT f.*, NOT (base_failed OR rejected OR (symbols_failed AND strict_s) OR (lines_failed AND strict_l)) AS kept
           FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source)"""

OP3_SQL = f"WITH {OP3_CTES}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.linked(table(spark, sf_dir, "documents"))


def near_ctes(width: int) -> str:
    """CTEs up to ``comp`` (doc_id, component_id), comparing all documents of a table ``src`` that share a shingle."""
    return rf"""
nw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM src),
sh AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(list_slice(ws, i, i + {width} - 1), ' '))) END AS s FROM nw),
el AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
sim AS (SELECT p.doc_id AS u, q.doc_id AS v FROM el p JOIN el q ON p.x = q.x AND p.doc_id < q.doc_id
          AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
        GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
both_ways AS (SELECT u, v FROM sim UNION ALL SELECT v, u FROM sim),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sh UNION SELECT b.v, reach.r FROM reach JOIN both_ways b ON b.u = reach.doc_id AND reach.r < b.v),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)"""


OP4_SQL = f"""WITH RECURSIVE src AS (SELECT * FROM documents), {near_ctes(2)}
SELECT sh.doc_id, len(s) AS n_shingles, component_id, sh.doc_id = component_id AS kept FROM sh JOIN comp USING (doc_id)"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


#: CTEs up to ``cut``: every document with its words and, of each, whether it stays. Needs a table ``src``.
OP5_CTES = r"""
a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM src),
wn AS (SELECT doc_id, i, list_slice(ws, i, i + 19) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM a)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(k, ' ')) ORDER BY doc_id, i) AS n FROM wn) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS g FROM late, (SELECT unnest(range(20)) AS j) GROUP BY doc_id),
words AS (SELECT a.doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM a),
marked AS (SELECT w.doc_id, w.w, w.i, g.i IS NULL AS stays FROM words w LEFT JOIN (SELECT doc_id, unnest(g) AS i FROM gone) g ON w.doc_id = g.doc_id AND w.i = g.i),
cut AS (SELECT a.doc_id, len(ws) AS n_words, len(ws) - coalesce(m.n, 0) AS n_removed, coalesce(m.t, '') AS kept
        FROM a LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM marked WHERE stays GROUP BY doc_id) m USING (doc_id))"""

OP5_SQL = f"WITH src AS (SELECT * FROM documents), {OP5_CTES}\nSELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM cut"


def op6_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_quality.score(docs, crf_quality.train(docs, table(spark, sf_dir, "labels")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.against_next(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM g"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def mix_ctes() -> str:
    """CTEs up to ``mixed`` (rid, doc_id, domain, lang, source, tokens, copies). Needs a table ``msrc`` (rid, ...)."""
    mix = mixing.MIX

    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{k}' THEN {v}" for k, v in mix.weights.get(level, {}).items())
        return f"CAST(CASE{cases} ELSE 1 END AS HUGEINT)"

    out = rf"""
mt AS (SELECT rid, doc_id, CASE WHEN right(coalesce(source, ''), 1) IN ('0', '1', '2', '3') THEN 'web'
         WHEN right(coalesce(source, ''), 1) IN ('4', '5', '6') THEN 'books' ELSE 'reference' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM msrc),
lv AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * {mix.max_epochs} AS HUGEINT) AS cap FROM mt GROUP BY ALL),
b0 AS (SELECT *, (SELECT CAST(least(sum(tokens) * {mix.percent} // 100, sum(cap)) AS HUGEINT) FROM lv) AS b FROM lv)"""
    for depth, level in enumerate(mix.levels):
        node = ", ".join(mix.levels[: depth + 1])
        parent = ", ".join(mix.levels[:depth])
        part = f"PARTITION BY {parent}" if parent else ""
        out += f""",
n{depth} AS (SELECT {node}, CAST(sum(cap) AS HUGEINT) AS c, any_value(b) AS b, any_value({weight(level)}) AS w FROM b{depth} GROUP BY {node}),
o{depth} AS (SELECT *, coalesce(sum(c) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
         sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS beh FROM n{depth}
       WINDOW q AS ({part} ORDER BY CAST(c AS DOUBLE) / CAST(w AS DOUBLE), {level})),
f{depth} AS (SELECT *, c * beh <= (b - bef) * w AS isfull FROM o{depth}),
s{depth} AS (SELECT *, b - coalesce(sum(c) FILTER (WHERE isfull) OVER ({part}), 0) AS rest,
         sum(w) FILTER (WHERE NOT isfull) OVER ({part}) AS shared FROM f{depth}),
b{depth + 1} AS (SELECT l.domain, l.lang, l.source, l.tokens, l.cap,
         CAST(CASE WHEN isfull THEN c WHEN shared > 0 THEN rest * w // shared ELSE 0 END AS HUGEINT) AS b
       FROM b{depth} l JOIN s{depth} USING ({node}))"""
    last = f"b{len(mix.levels)}"
    return out + f""",
ep AS (SELECT *, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS epochs FROM {last}),
ky AS (SELECT mt.*, ep.tokens AS have, epochs, b - epochs * ep.tokens AS rest,
         md5(concat_ws(':', '{mix.seed}', CAST(epochs + 1 AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM mt JOIN ep USING (domain, lang, source)),
mixed AS (SELECT rid, doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN have > 0
           AND sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ky)"""


OP9_SQL = f"WITH msrc AS (SELECT row_number() OVER () AS rid, * FROM documents), {mix_ctes()}\nSELECT doc_id, domain, lang, source, tokens AS n_tokens, copies FROM mixed"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.format_chats(chat_format.hostile(table(spark, sf_dir, "conversations")))).drop("history_rewritten", "texts_changed")


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(t, '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE=|\[/ROLE\])', '\1\1\\\2', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE r WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19 ELSE 16 + length(r) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(list_slice(ws, i, i + m - 1), ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 10),
k AS (SELECT lang, phrase, m, a, ws, k, array_to_string(list_slice(ws, 1, k), ' ') AS x, array_to_string(list_slice(ws, k + 1, m), ' ') AS y
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.*, l.a AS l, r.a AS r, CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.x JOIN f r ON r.lang = k.lang AND r.phrase = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, x AS phrase, max(a) AS longer FROM (SELECT lang, array_to_string(list_slice(ws, 1, 2), ' ') AS x, a FROM c WHERE m = 3
      UNION ALL SELECT lang, array_to_string(list_slice(ws, 2, 3), ' '), a FROM c WHERE m = 3) GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
      FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, o.phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return gru_lm.score(table(spark, sf_dir, "documents"), number % 7 == 2)


def op13_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state beyond 63 bits, as a conversation of some 90,000 deliveries has, is null here."""
    found = replay.replay(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", F.expr("try_cast(state AS bigint)").alias("state"))


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, where a column ``crc`` has the 256 remainders of single bytes."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _draw_sql(k: int) -> str:
    return crc32_sql(f"('{k}:' || coalesce(CAST(conv_id AS VARCHAR), '') || ':' || coalesce(CAST(turn AS VARCHAR), ''))")


OP13_SQL = f"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
byte AS (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
h AS (SELECT conv_id, turn, {crc32_sql("coalesce(text, '')")} AS s, [{", ".join(_draw_sql(k) for k in range(9))}] AS h FROM conversations, byte),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) - 1 AS p FROM h),
u AS (SELECT *, 7 * p AS arrival, h[1] % 5 AS back, h[2] % 101 < 50 AS faulty, 7 * p + h[3] % 101 AS repaired FROM t),
r(conv_id, p, found) AS (
  SELECT conv_id, CAST(-1 AS BIGINT), CAST([] AS STRUCT(attempts BIGINT, first_at BIGINT, last_at BIGINT, ok BOOLEAN)[]) FROM u GROUP BY conv_id
  UNION ALL
  SELECT conv_id, p, list_append(found, CASE WHEN blocked THEN {{'attempts': CAST(0 AS BIGINT), 'first_at': NULL, 'last_at': NULL, 'ok': false}}
    ELSE {{'attempts': coalesce(a, 6), 'first_at': f, 'last_at': f + 10 * (CAST(2 ** (coalesce(a, 6) - 1) AS BIGINT) - 1), 'ok': a IS NOT NULL}} END)
  FROM (SELECT *, list_filter([1, 2, 3, 4, 5, 6], lambda a: NOT faulty OR (f + 10 * (CAST(2 ** (a - 1) AS BIGINT) - 1) >= repaired AND h[a + 3] % 3 <> 0))[1] AS a
    FROM (SELECT u.conv_id, u.p, u.faulty, u.repaired, u.h, r.found, has AND NOT r.found[q].ok AS blocked, CASE WHEN has THEN greatest(u.arrival, r.found[q].last_at) ELSE u.arrival END AS f
      FROM (SELECT *, back > 0 AND back <= p AS has, CASE WHEN back > 0 AND back <= p THEN p - back + 1 ELSE 1 END AS q FROM u) u
      JOIN r ON r.conv_id IS NOT DISTINCT FROM u.conv_id AND u.p = r.p + 1))),
o AS (SELECT u.conv_id, u.turn, u.p, u.s, r.found[u.p + 1] AS x FROM u
  JOIN (SELECT conv_id, arg_max(found, p) AS found FROM r GROUP BY conv_id) r ON r.conv_id IS NOT DISTINCT FROM u.conv_id),
n AS (SELECT *, CASE WHEN x.ok THEN row_number() OVER (PARTITION BY conv_id, x.ok ORDER BY x.last_at, turn NULLS FIRST, p) END AS release_no FROM o)
SELECT conv_id, turn, CASE WHEN x.ok THEN 'delivered' WHEN x.attempts > 0 THEN 'dead' ELSE 'blocked' END AS status, CAST(x.attempts AS INTEGER) AS attempts,
  x.first_at AS first_at, x.last_at AS last_at, release_no,
  CASE WHEN x.ok THEN CAST(sum(release_no * s) OVER (PARTITION BY conv_id ORDER BY release_no ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS state FROM n"""


def queries() -> dict[str, Query]:
    return {"op1_html_extract": op1_html_extract, "op2_sentencepiece": op2_sentencepiece, "op3_quality_rules": op3_quality_rules, "op4_minhash_dedup": op4_minhash_dedup, "op5_substring_dedup": op5_substring_dedup, "op6_crf_quality": op6_crf_quality, "op7_fingerprints": op7_fingerprints, "op8_warc": op8_warc, "op9_mixing": op9_mixing, "op10_chat_format": op10_chat_format, "op11_collocations": op11_collocations, "op12_lm_scoring": op12_lm_scoring, "op13_replay": op13_replay}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op4_minhash_dedup": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op8_warc": OP8_SQL, "op9_mixing": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_collocations": OP11_SQL, "op13_replay": OP13_SQL}
