"""DuckDB SQL for the queries of catalog.py, put together from named parts."""

from __future__ import annotations

from ..functions import fixed
from ..operators import datasets

_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.ALIASES.items())
_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
_BREAK = r"'\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
#: White space of words_of(), as far as RE2 can say it.
_WORD = r"'[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"


def index_tokens(t: str) -> str:
    return f"list_transform(regexp_extract_all(lower({t}), '{fixed.TOKEN}'), lambda x: CASE x {_ALIAS} ELSE x END)"


def all_tokens(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, '{fixed.TOKEN}'), lambda x: CASE strip_accents(lower(x)) {_ALIAS} ELSE strip_accents(lower(x)) END)"


def overlap_tokens(t: str) -> str:
    return f"list_filter({all_tokens(t)}, lambda x: length(x) > 1 AND x NOT IN ({_STOP}))"


def token_set(t: str) -> str:
    return f"list_distinct({overlap_tokens(t)})"


def overlap(q: str, c: str) -> str:
    n = f"len(list_intersect({q}, {c}))"
    return f"CASE WHEN len({q}) = 0 OR len({c}) = 0 OR {n} = 0 THEN 0.0 WHEN {n} < 2 THEN {n} / len({q}) ELSE greatest({n} / len({q}), {n} / len({c})) END"


def phrase(p: str, t: str) -> str:
    return f"CASE WHEN len({p}) = 0 OR len({t}) = 0 THEN 0.0 ELSE len(list_intersect({p}, {t})) / len({p}) END"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, {_WORD})"


def normalized(t: str) -> str:
    lines = f"list_transform(regexp_split_to_array(replace({t}, chr(0), ' '), {_BREAK}), lambda x: array_to_string({words('x')}, ' '))"
    return f"array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10))"


def sentences(t: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(trim({t}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def first_sentence(t: str) -> str:
    s = sentences(t)
    return f"CASE WHEN len({s}) = 0 THEN trim({t}) WHEN regexp_matches({s}[1], '[.!?]$') THEN {s}[1] ELSE {s}[1] || '.' END"


def snippet(t: str) -> str:
    s = sentences(t)
    return f"'- ' || rtrim(substr(CASE WHEN len({s}) > 0 THEN array_to_string(list_slice({s}, 1, 2), ' ') ELSE trim({t}) END, 1, 320))"


def bullet(t: str) -> str:
    head = f"trim(split_part({t}, '.', 1))"
    return f"'- ' || CASE WHEN {head} <> '' THEN {head} ELSE trim(substr({t}, 1, 200)) END"


def signature(t: str) -> str:
    return f"substr(array_to_string({words(f'lower({t})')}, ' '), 1, 160)"


def numbers(t: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({t})), '\p{{Nd}}+(?:[.,]\p{{Nd}}+)?')"


def _bounded(t: str, chars: str) -> str:
    """Runs of ``chars``, two and more, that are whole words as Unicode has words."""
    run = r"[\pL\pM\p{Nd}\p{Pc}\x{200C}\x{200D}]+"
    return f"list_filter(regexp_extract_all({t}, '{run}'), lambda x: regexp_full_match(x, '{chars}{{2,}}'))"


def numbers_supported(q: str, evidence: str) -> str:
    """evidence: one text, its parts joined by a space."""
    return f"(len({numbers(q)}) = 0 OR list_has_any({numbers(q)}, {numbers(evidence)}))"


def acronyms_supported(q: str, evidence: str) -> str:
    a = _bounded(q, "[A-Z]")
    return f"(len({a}) = 0 OR list_has_any({a}, {_bounded(f"upper(replace({evidence}, 'ß', 'SS'))", '[A-Z0-9]')}))"


def coverage(q: str, evidence: str, least: int) -> str:
    own = f"list_filter({token_set(q)}, lambda x: length(x) >= {least})"
    return f"CASE WHEN len({own}) = 0 THEN 1.0 WHEN {evidence} IS NULL THEN 0.0 ELSE len(list_intersect({own}, {token_set(evidence)})) / len({own}) END"


def filled(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_DEPARTMENT = "CASE lang WHEN 'en' THEN 'Engineering' WHEN 'de' THEN 'Security' WHEN 'fr' THEN 'HR' ELSE 'General' END"
_VISIBLE = "(level IS NULL OR level IN ('', 'restricted') OR access_level <> 'restricted')"
_SEEN = f"(want IS NULL OR want = department) AND {_VISIBLE}"

#: Parts by name: the parts they need, and their SQL.
PARTS: dict[str, tuple[str, str]] = {
    "ad": ("", f"SELECT 'd' || doc_id AS doc_id, doc_id AS n, 'doc ' || lang || ' ' || source AS title, source || ' > ' || lang AS section_path, {_DEPARTMENT} AS department, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) AS updated_at, CASE WHEN doc_id % 5 = 0 THEN 'restricted' WHEN doc_id % 5 < 3 THEN 'internal' ELSE 'public' END AS access_level, {words('text')} AS ws FROM documents"),
    "st": ("ad", "SELECT *, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 350 THEN [0] ELSE range(0, CAST(ceil((len(ws) - 350) / 270) AS BIGINT) * 270 + 1, 270) END) AS s FROM ad"),
    "cut": ("st", "SELECT doc_id, title, section_path, department, updated_at, access_level, s // 270 AS i, array_to_string(list_slice(ws, s + 1, s + 350), ' ') AS text FROM st"),
    "ck": ("cut", "SELECT doc_id, doc_id || '-' || i || '-' || substr(md5(doc_id || ':' || i || ':' || text), 1, 8) AS chunk_id, text, title, section_path, department, updated_at, access_level FROM cut"),
    "nm": ("", "SELECT DISTINCT lang, source FROM documents"),
    "qs": ("nm", f"SELECT 'b' || item_id AS query_id, text AS query, CASE WHEN item_id % 4 = 0 THEN 'Engineering' END AS want, CASE item_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' END AS level, CAST([] AS VARCHAR[]) AS titles, CAST([] AS VARCHAR[]) AS sections FROM benchmark UNION ALL SELECT 't-' || lang || '-' || source, {filled(datasets.EASY, t='title', s='lang')}, NULL, 'restricted', [title], [lang] FROM (SELECT *, 'doc ' || lang || ' ' || source AS title FROM nm)"),
    "oq": ("qs", "SELECT query_id, query, CAST(NULL AS VARCHAR) AS want, 'restricted' AS level, titles, sections FROM qs"),
    "nq": ("", "SELECT 'n' || printf('%03d', i - 1) AS query_id, x AS query, CAST(NULL AS VARCHAR) AS want, 'restricted' AS level, CAST([] AS VARCHAR[]) AS titles, CAST([] AS VARCHAR[]) AS sections FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT [" + ", ".join("'" + x.replace("'", "''") + "'" for x in fixed.NEGATIVE_QUESTIONS) + "] AS l))"),
    "pr": ("", "SELECT a.doc_id, a.text, b.text AS other FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"),
    "ix": ("ck", f"SELECT chunk_id, department, access_level, {index_tokens(chr(39).join(['title || ', ' ', ' || section_path || ', ' ', ' || text']))} AS tk FROM ck"),
    "po": ("ix", "SELECT chunk_id, department, access_level, len(tk) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(tk) AS term FROM ix) GROUP BY ALL"),
    "sx": ("ix", "SELECT count(*) AS n, avg(len(tk)) AS mean FROM ix"),
    "df": ("po", "SELECT term, count(*) AS df FROM po GROUP BY term"),
    "rw": ("df sx", "SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r, ln((greatest(n, 1) + 1) / (df + 1)) + 1 AS plain FROM df, sx"),
    "mi": ("rw", "SELECT avg(r) AS m FROM rw"),
    "idf": ("rw mi", "SELECT term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf, plain FROM rw, mi"),
    "qh": ("{Q}", "SELECT query_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM (SELECT query_id, md5_number_upper(term) % 384 AS bucket, CAST(count(*) AS DOUBLE) AS w FROM (SELECT query_id, unnest(" + index_tokens("query") + ") AS term FROM {Q}) GROUP BY ALL)"),
    "ch": ("ix", "SELECT chunk_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM (SELECT chunk_id, md5_number_upper(term) % 384 AS bucket, CAST(count(*) AS DOUBLE) AS w FROM (SELECT chunk_id, unnest(tk) AS term FROM ix) GROUP BY ALL)"),
    "dp": ("qh ch", "SELECT query_id, chunk_id, round(sum(qh.w * ch.w), 9) AS score FROM qh JOIN ch USING (bucket) GROUP BY ALL"),
    "da": ("dp ix {Q}", "SELECT q.query_id, q.want, q.level, ix.chunk_id, ix.department, ix.access_level, coalesce(dp.score, 0.0) AS score FROM {Q} q CROSS JOIN ix LEFT JOIN dp ON dp.query_id = q.query_id AND dp.chunk_id = ix.chunk_id"),
    "d4": ("da", "SELECT * FROM da QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 4 * {N}"),
    "dn": ("d4", f"SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d4 WHERE {_SEEN} QUALIFY rank <= {{N}}"),
    "qt": ("{Q}", "SELECT query_id, want, level, term, count(*) AS times FROM (SELECT *, unnest(" + index_tokens("query") + ") AS term FROM {Q}) GROUP BY query_id, want, level, term"),
    "sc": ("po qt idf sx", f"SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM po JOIN qt USING (term) JOIN idf USING (term), sx WHERE {_SEEN} GROUP BY ALL"),
    "bm": ("sc", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {N}"),
    "ps": ("po qt idf", f"SELECT query_id, chunk_id, round(sum(times * plain * tf), 9) AS score FROM po JOIN qt USING (term) JOIN idf USING (term) WHERE {_SEEN} GROUP BY ALL"),
    "pb": ("ps", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ps WHERE score > 0 QUALIFY rank <= {N}"),
    "bn": ("bm", "SELECT *, CASE WHEN max(score) OVER p - min(score) OVER p < 1e-8 THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS norm FROM bm WINDOW p AS (PARTITION BY query_id)"),
    "dm": ("dn", "SELECT *, CASE WHEN max(score) OVER p - min(score) OVER p < 1e-8 THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS norm FROM dn WINDOW p AS (PARTITION BY query_id)"),
    "qw0": ("{Q}", "SELECT query_id, len(ws) AS n, len(list_filter(ws, lambda x: regexp_matches(x, '\\p{Nd}') OR (length(x) >= 2 AND x = upper(x) AND x <> lower(x)))) > 0 AS code FROM (SELECT query_id, " + words("query") + " AS ws FROM {Q})"),
    "qw1": ("qw0", "SELECT query_id, greatest(0.1, 0.62 + CASE WHEN code THEN 0.15 ELSE 0.0 END - CASE WHEN n >= 10 THEN 0.1 ELSE 0.0 END) AS l, greatest(0.1, 0.38 - CASE WHEN code THEN 0.15 ELSE 0.0 END + CASE WHEN n >= 10 THEN 0.1 ELSE 0.0 END) AS d FROM qw0"),
    "qw": ("qw1", "SELECT query_id, CAST(l AS DOUBLE) / (CAST(l AS DOUBLE) + CAST(d AS DOUBLE)) AS l, CAST(d AS DOUBLE) / (CAST(l AS DOUBLE) + CAST(d AS DOUBLE)) AS d FROM qw1"),
    "fp": ("bn dm qw", "SELECT query_id, chunk_id, coalesce(b.score, 0.0) AS bm25_score, coalesce(v.score, 0.0) AS dense_score, round({FUSED}, 9) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round({FUSED}, 9) DESC, b.rank NULLS LAST, v.rank NULLS LAST) AS place FROM bn b FULL JOIN dm v USING (query_id, chunk_id) JOIN qw USING (query_id)"),
    "fu": ("fp", "SELECT * EXCLUDE (place), place AS rank FROM fp WHERE place <= {N}"),
    "qx": ("{Q}", f"SELECT query_id, query, {token_set('query')} AS q, list_transform(titles, lambda p: {token_set('p')}) AS tt, list_transform(sections, lambda p: {token_set('p')}) AS ss, len(titles) + len(sections) > 0 AS reference FROM {{Q}}"),
    "cx": ("ck", f"SELECT *, {token_set('text')} AS xt, {token_set('title')} AS tt, {token_set('section_path')} AS st, {token_set(chr(39).join(['title || ', ' ', ' || section_path']))} AS mt FROM ck"),
    "fl": ("fu cx qx", "SELECT fu.query_id, fu.chunk_id, fused AS score, rank, doc_id, text, title, section_path, updated_at, xt, cx.tt AS title_t, st, mt, q, qx.tt AS qtt, ss, query, reference FROM fu JOIN cx USING (chunk_id) JOIN qx USING (query_id)"),
    "r0": ("fl", "SELECT *, CAST(updated_at AS DATE) - DATE '1970-01-01' AS day FROM fl"),
    "r1": ("r0", "SELECT * EXCLUDE (score, day), CASE WHEN max(day) OVER p > min(day) OVER p THEN round(score + 0.08 * (day - min(day) OVER p) / (max(day) OVER p - min(day) OVER p), 9) ELSE score END AS score FROM r0 WINDOW p AS (PARTITION BY query_id)"),
    "rc": ("r1", "SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM r1"),
    "m0": ("{H}", f"SELECT *, coalesce(list_max(list_transform(qtt, lambda p: {phrase('p', 'title_t')})), 0.0) AS dm, coalesce(list_max(list_transform(ss, lambda p: {phrase('p', 'st')})), 0.0) AS sm FROM {{H}}"),
    "m1": ("m0", "SELECT * EXCLUDE (score, dm, sm), CASE WHEN len(q) = 0 OR len(mt) = 0 THEN score ELSE round(score + 0.22 * len(list_intersect(q, mt)) / greatest(1, len(q)) + 0.198 * dm + 0.242 * sm + least(0.24, 0.08 * len(list_intersect(q, st))) - CASE WHEN len(qtt) > 0 AND dm < 0.2 THEN 0.033 ELSE 0.0 END, 9) END AS score FROM m0"),
    "mb": ("m1", "SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM m1"),
    "t0": ("{H}", f"SELECT *, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0.0 END AS relative, greatest({overlap('q', 'xt')}, {overlap('q', 'mt')}) AS overlap FROM {{H}}"),
    "hit": ("t0", "SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM t0 WHERE score >= {S} AND relative >= {R} AND overlap >= {O} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5"),
    "c0": ("hit", f"SELECT *, {overlap('q', 'xt')} AS o, coalesce(list_max(list_transform(qtt, lambda p: {phrase('p', 'title_t')})), 0.0) AS dm, coalesce(list_max(list_transform(ss, lambda p: {phrase('p', 'st')})), 0.0) AS sm FROM hit"),
    "c1": ("c0", "SELECT *, round(-(0.55 * score + 0.45 * o + 0.65 * dm + 0.75 * sm + CASE WHEN rank <= 3 THEN 0.05 ELSE 0.0 END - CASE WHEN len(qtt) > 0 AND dm < 0.25 THEN 0.20 ELSE 0.0 END - CASE WHEN len(ss) > 0 AND sm < 0.20 THEN 0.10 ELSE 0.0 END), 9) AS minus FROM c0 WHERE score >= 0.18 AND NOT (o < 0.08 AND greatest(dm, sm) < 0.35)"),
    "c2": ("c1", f"SELECT *, {signature('text')} AS sig, count(*) OVER (PARTITION BY query_id) AS n_candidates FROM c1 WHERE minus < 0"),
    "c3": ("c2", "SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY query_id, sig ORDER BY minus, rank) = 1"),
    "sel": ("c3", "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY minus, rank) AS place FROM c3 QUALIFY place <= 3"),
    "ci": ("sel qx", f"SELECT query_id, list(chunk_id ORDER BY place) AS ids, max(n_candidates) AS n_candidates, count(*) / greatest(1, least(3, max(n_candidates))) AS coverage, string_agg(title || ' ' || section_path || ' ' || text, ' ' ORDER BY place) AS evidence, string_agg({snippet('text')}, chr(10) ORDER BY place) AS bullets FROM sel GROUP BY query_id"),
    "hq": ("hit", f"SELECT query_id, count(*) AS n_hits, max(score) FILTER (WHERE rank = 1) AS top_score, max(score) FILTER (WHERE rank = 2) AS second, any_value(doc_id) FILTER (WHERE rank = 1) AS top_doc, any_value(xt) FILTER (WHERE rank = 1) AS txt, any_value(title_t) FILTER (WHERE rank = 1) AS ttt, any_value(st) FILTER (WHERE rank = 1) AS tst, any_value(mt) FILTER (WHERE rank = 1) AS tmt, string_agg(title || ' ' || section_path || ' ' || text, ' ' ORDER BY rank) FILTER (WHERE rank <= 3) AS first3, string_agg({bullet('text')}, chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS draft FROM hit GROUP BY query_id"),
    "sd": ("hit hq", "SELECT query_id, count(*) AS support, string_agg(title || ' ' || section_path || ' ' || text, ' ' ORDER BY rank) AS same_doc FROM hit JOIN hq USING (query_id) WHERE rank <= 5 AND doc_id = top_doc GROUP BY query_id"),
    "f0": ("qx hq ci sd", f"SELECT query_id, query, reference, coalesce(n_hits, 0) AS n_hits, coalesce(top_score, 0.0) AS top_score, coalesce(ids, []) AS ids, coalesce(n_candidates, 0) AS n_candidates, coalesce(coverage, 0.0) AS coverage, CASE WHEN n_hits IS NULL THEN 0.0 ELSE {overlap('q', 'txt')} END AS top_text, CASE WHEN n_hits IS NULL THEN 0.0 ELSE greatest({overlap('q', 'ttt')}, {overlap('q', 'tst')}, {overlap('q', 'tmt')}) END AS top_meta, coalesce(support, 0) AS support, CASE WHEN n_hits >= 2 AND top_score > 0 THEN second / top_score ELSE 0.0 END AS second_ratio, coalesce(evidence, first3) AS evidence, same_doc, draft, bullets, list_contains({all_tokens('query')}, 'co') AND list_contains({all_tokens('query')}, 'khong') AS yes_no FROM qx LEFT JOIN hq USING (query_id) LEFT JOIN ci USING (query_id) LEFT JOIN sd USING (query_id)"),
    "f1": ("f0", f"SELECT *, greatest(top_text, top_meta) AS top_relevance, {coverage('query', 'evidence', 5)} AS open_coverage, {coverage('query', 'same_doc', 4)} AS doc_coverage FROM f0"),
    "g0": ("f1", f"SELECT *, n_hits = 0 AS n1_no_hits, top_score < 0.18 AS n2_low_score, coverage < 0.34 AS n3_low_coverage, top_relevance < 0.08 AS n4_low_relevance, n_hits = 0 AS n5_draft, yes_no AND top_relevance < 0.6 AS n6_yes_no, yes_no AND NOT reference AND top_text < 0.75 AS n7_yes_no_open, NOT reference AND top_relevance < 0.18 AS n8_open_relevance, NOT reference AND top_text <= 0.5 AND top_meta < 0.5 AND support < 2 AND second_ratio < 0.95 AS n9_open_support, NOT {numbers_supported('query', 'coalesce(evidence, chr(32))')} AS n10_numbers, NOT {acronyms_supported('query', 'coalesce(evidence, chr(32))')} AS n11_acronyms, NOT reference AND open_coverage < 0.34 AS n12_open_coverage, NOT reference AND support >= 2 AND doc_coverage < 0.5 AS n13_doc_coverage, len(ids) = 0 AS n14_no_citation FROM f1"),
    "gt": ("g0", "SELECT *, n1_no_hits OR n2_low_score OR n3_low_coverage OR n4_low_relevance OR n5_draft OR n6_yes_no OR n7_yes_no_open OR n8_open_relevance OR n9_open_support OR n10_numbers OR n11_acronyms OR n12_open_coverage OR n13_doc_coverage OR n14_no_citation AS refused FROM g0"),
    "an": ("gt", f"SELECT query_id, CASE WHEN refused THEN '{fixed.REFUSAL.replace(chr(39), chr(39) * 2)}' ELSE bullets END AS answer, CASE WHEN refused THEN [] ELSE ids END AS ids, CASE WHEN refused THEN 'Low' WHEN top_score >= 0.75 AND coverage >= 1 THEN 'High' WHEN top_score >= 0.35 AND coverage >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence, CASE WHEN refused THEN 'NOT_FOUND' ELSE 'ANSWERED' END AS status, CASE WHEN refused THEN {filled(fixed.CLARIFY.replace('{}', '{q}'), q='query')} END AS clarifying_question FROM gt"),
    "bw": ("", f"SELECT 'b' || item_id AS id, array_to_string({words('text')}, ' ') AS question FROM benchmark"),
    "gd": ("bw ck", "SELECT id, list(DISTINCT chunk_id ORDER BY chunk_id) AS gold FROM bw JOIN ck ON contains(ck.text, bw.question) GROUP BY id"),
    "it": ("bw gd", "SELECT id, question, coalesce(gold, []) AS gold FROM bw LEFT JOIN gd USING (id)"),
    "iq": ("it", "SELECT id AS query_id, question AS query, CAST(NULL AS VARCHAR) AS want, 'restricted' AS level, CAST([] AS VARCHAR[]) AS titles, CAST([] AS VARCHAR[]) AS sections FROM it"),
    "hl": ("hit", "SELECT query_id AS id, list(chunk_id ORDER BY rank) AS ids FROM hit GROUP BY query_id"),
    "ev": ("it hl an", "SELECT it.id, gold, coalesce(hl.ids, []) AS retrieved, an.ids AS cited, status, confidence, CASE WHEN len(gold) > 0 THEN 'positive' ELSE 'negative' END AS query_type, 'easy' AS difficulty FROM it LEFT JOIN hl USING (id) JOIN an ON an.query_id = it.id"),
    "fa": ("ev", "SELECT *, unnest(list_filter([CASE WHEN len(gold) > 0 AND NOT list_has_any(retrieved, gold) THEN 'retrieval_miss_positive' END, CASE WHEN len(gold) > 0 AND status = 'NOT_FOUND' THEN 'false_refusal_positive' END, CASE WHEN len(gold) > 0 AND status <> 'NOT_FOUND' AND len(cited) = 0 THEN 'missing_citations_positive' END, CASE WHEN len(gold) > 0 AND status <> 'NOT_FOUND' AND len(cited) > 0 AND NOT list_has_any(cited, gold) THEN 'citation_mismatch_positive' END, CASE WHEN len(gold) = 0 AND status <> 'NOT_FOUND' THEN 'answered_negative_query' END, CASE WHEN len(gold) = 0 AND len(cited) > 0 THEN 'citations_on_negative_query' END], lambda x: x IS NOT NULL)) AS failure FROM ev"),
    "ea": ("ck", f"SELECT chunk_id AS place, {filled(datasets.EASY, t='title', s='split_part(section_path, chr(32) || chr(62) || chr(32), -1)')} AS question, chunk_id AS gold, {first_sentence('text')} AS reference_answer, 'easy' AS difficulty, 'positive_single' AS query_type, department AS domain FROM ck"),
    "mh0": ("ck", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS k FROM ck"),
    "mh": ("mh0", f"SELECT a.doc_id AS place, {filled(datasets.MULTI, t='a.title', s='split_part(a.section_path, chr(32) || chr(62) || chr(32), -1)', s2='split_part(b.section_path, chr(32) || chr(62) || chr(32), -1)')} AS question, a.chunk_id || '|' || b.chunk_id AS gold, trim({first_sentence('a.text')} || ' ' || {first_sentence('b.text')}) AS reference_answer, 'hard' AS difficulty, 'positive_multi' AS query_type, a.department AS domain FROM mh0 a JOIN mh0 b ON a.doc_id = b.doc_id AND a.k = 1 AND b.k = 2"),
    "hd0": ("ck", "SELECT *, row_number() OVER (ORDER BY chunk_id) - 1 AS j FROM ck QUALIFY j < 24"),
    "hd": ("hd0", "SELECT chunk_id AS place, CASE " + " ".join(f"WHEN contains(lower(department), '{k}') AND j % 2 = {i} THEN {filled(t, t='title', s='sec')}" for k, pair in datasets.HARD.items() if k != "general" for i, t in enumerate(pair)) + " " + " ".join(f"WHEN j % 2 = {i} THEN {filled(t, t='title', s='sec')}" for i, t in enumerate(datasets.HARD["general"])) + f" END AS question, chunk_id AS gold, {first_sentence('text')} AS reference_answer, 'hard' AS difficulty, 'positive_single' AS query_type, department AS domain FROM (SELECT *, split_part(section_path, ' > ', -1) AS sec FROM hd0)"),
}


_NORMAL_LINES = f"string_split({normalized('md')}, chr(10))"
#: The stack of open headings is folded anew for each block, from the headings before it.
_SECTION_PATHS = rf"""
WITH m AS (SELECT doc_id, concat_ws(chr(10), '# ' || source, 'Intro ' || doc_id, '### skips', lang, '## ' || lang, text, '#### deep', 'below  ', '##', 'after a blank heading', '###' || source, '#tag',
    CASE WHEN doc_id % 3 = 0 THEN '# second' ELSE '## again' END, source, CASE WHEN doc_id % 2 = 0 THEN '## last' END) AS md FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, {_NORMAL_LINES} AS ls FROM m)),
h AS (SELECT *, starts_with(line, '#') AS is_head, length(line) - length(ltrim(line, '#')) AS lv, trim(ltrim(line, '#')) AS t,
    count(*) FILTER (WHERE starts_with(line, '#')) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
b AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS body FROM h WHERE NOT is_head GROUP BY doc_id, k),
s AS (SELECT b.doc_id, b.k, body, list({{'lv': lv, 't': t}} ORDER BY i) FILTER (WHERE t <> '') AS hs FROM b LEFT JOIN h ON h.doc_id = b.doc_id AND h.is_head AND h.k <= b.k GROUP BY ALL),
p AS (SELECT doc_id, body, list_reduce(hs, lambda st, x: {{'lv': 0, 't': '', 'st': list_append(list_slice(st.st, 1, x.lv - 1), x.t)}}, {{'lv': 0, 't': '', 'st': CAST([] AS VARCHAR[])}}) AS f
    FROM (SELECT doc_id, body, list_transform(coalesce(hs, []), lambda x: {{'lv': x.lv, 't': x.t, 'st': CAST([] AS VARCHAR[])}}) AS hs FROM s))
SELECT doc_id, CASE WHEN len(f.st) = 0 THEN 'General' ELSE array_to_string(f.st, ' > ') END AS section_path, md5(body) AS text_md5 FROM p"""


def sql(final: str, needs: str, q: str = "qs", n: int = 24, h: str = "rc", fused: str = "weighted", limits: tuple[float, float, float] = (0.18, 0.35, 0.05), extra: str = "") -> str:
    """``final`` after the parts that it needs. q: the question table. h: hits that the boost or filter starts from."""
    values = {"{Q}": q, "{N}": str(n), "{H}": h, "{S}": str(limits[0]), "{R}": str(limits[1]), "{O}": str(limits[2])}
    values["{FUSED}"] = "qw.l * coalesce(b.norm, 0.0) + qw.d * coalesce(v.norm, 0.0)" if fused == "weighted" else "qw.l * coalesce(1.0::DOUBLE / (60 + b.rank), 0.0) + qw.d * coalesce(1.0::DOUBLE / (60 + v.rank), 0.0)"
    out: dict[str, str] = {}

    def put(text: str, name: str) -> str:
        for k, v in values.items():
            text = text.replace(k, v)
        # the boost works on dated hits, the filter on boosted ones
        return text.replace("FROM rc", "FROM mb") if name == "t0" and h == "rc" else text

    def need(name: str) -> None:
        if name in out:
            return
        parts, body = PARTS[name]
        for part in parts.split():
            part = values.get(part, part)
            need("mb" if name == "t0" and part == "rc" else part)
        out[name] = put(body, name)

    for name in needs.split():
        need(values.get(name, name))
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in out.items()) + "\n" + put(final, "")


def oracle_sql() -> dict[str, str]:
    r = "round({0}, 6) AS {0}".format
    ranked = f"SELECT query_id, chunk_id, {r('score')}, CAST(rank AS INTEGER) AS rank FROM "
    fused = f"SELECT query_id, chunk_id, {r('bm25_score')}, {r('dense_score')}, {r('fused')}, CAST(rank AS INTEGER) AS rank FROM fu"
    knn = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN sqrt(list_inner_product(e, e)) > 0 THEN x / sqrt(list_inner_product(e, e)) ELSE 0.0 END) AS e FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.e, b.e), 9) AS score FROM u a, u b WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)"""
    modes = " UNION ALL ".join(
        f"SELECT '{mode}' AS mode, CAST(count(*) AS BIGINT) AS n, round(coalesce(avg(CASE WHEN list_has_any(list_slice(coalesce(x.ids, []), 1, 5), gold) THEN 1.0 ELSE 0.0 END), 0), 6) AS recall_at_k, round(coalesce(avg(coalesce(1.0 / x.first, 0)), 0), 6) AS mrr, round(coalesce(avg(CASE WHEN list_has_any(list_slice(coalesce(x.ids, []), 1, 5), gold) THEN 1.0 ELSE 0.0 END), 0), 6) AS evidence_hit_rate FROM it LEFT JOIN (SELECT query_id AS id, list(chunk_id ORDER BY rank) AS ids, min(rank) FILTER (WHERE list_contains(g.gold, chunk_id)) AS first FROM ({source}) s JOIN it g ON g.id = s.query_id GROUP BY query_id) x USING (id) WHERE len(gold) > 0"
        for mode, source in (
            ("bm25", "SELECT * FROM bm WHERE rank <= 5"),
            ("dense", "SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM da) WHERE rank <= 5"),
            ("hybrid", "SELECT query_id, chunk_id, rank FROM hit"),
            ("fused", "SELECT query_id, chunk_id, place AS rank FROM ff WHERE place <= 5"),
        )
    )
    # plain fusion: ten of either list, fixed weights
    ff = """, b10 AS (SELECT * FROM bm WHERE rank <= 10), d10 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM da QUALIFY rank <= 10),
bq AS (SELECT *, CASE WHEN max(score) OVER p - min(score) OVER p < 1e-8 THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS norm FROM b10 WINDOW p AS (PARTITION BY query_id)),
dq AS (SELECT *, CASE WHEN max(score) OVER p - min(score) OVER p < 1e-8 THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS norm FROM d10 WINDOW p AS (PARTITION BY query_id)),
ff AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.62::DOUBLE * coalesce(b.norm, 0.0) + 0.38::DOUBLE * coalesce(v.norm, 0.0), 9) DESC, b.rank NULLS LAST, v.rank NULLS LAST) AS place FROM bq b FULL JOIN dq v USING (query_id, chunk_id))
"""
    recall = sql(modes, "it hit da bm", q="iq")
    recall = recall.replace("\nSELECT 'bm25'", ff + "SELECT 'bm25'", 1)
    gates = ", ".join(f"n{x}" for x in "1_no_hits 2_low_score 3_low_coverage 4_low_relevance 5_draft 6_yes_no 7_yes_no_open 8_open_relevance 9_open_support 10_numbers 11_acronyms 12_open_coverage 13_doc_coverage 14_no_citation".split())
    department = "CASE WHEN contains(lower(url), 'hr') THEN 'HR' WHEN contains(lower(url), 'security') THEN 'Security' WHEN contains(lower(url), 'eng') THEN 'Engineering' ELSE 'General' END"
    access = "CASE WHEN contains(lower(url), 'restricted') THEN 'restricted' WHEN contains(lower(url), 'internal') THEN 'internal' ELSE 'public' END"
    day = r"coalesce(nullif(regexp_extract(url, '(20\d{2}-\d{2}-\d{2})', 1), ''), '1970-01-01')"
    easy = "SELECT place, question, gold, reference_answer, difficulty, query_type, domain FROM "
    head = fixed.PROMPT_HEAD.replace("'", "''")
    prompt = f"SELECT query_id, md5('{head}QUESTION:\n' || query || '\n\nEVIDENCE:\n' || coalesce(e, '') || '\n') AS prompt_md5, {filled(fixed.CLARIFY.replace('{}', '{q}'), q='query')} AS clarify FROM qx LEFT JOIN (SELECT query_id, string_agg('[' || rank || '] title=' || title || ' | section=' || section_path || ' | chunk_id=' || chunk_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS e FROM hit GROUP BY query_id) USING (query_id)"
    negatives = "(SELECT text AS place, text AS question, '' AS gold, 'NOT_FOUND' AS reference_answer, 'hard' AS difficulty, 'negative' AS query_type, 'General' AS domain FROM benchmark)"
    generated = f"SELECT printf('q%03d', row_number() OVER (ORDER BY part, place)) AS id, question, gold, reference_answer, difficulty, query_type, domain FROM (SELECT 0 AS part, * FROM ea UNION ALL SELECT 1, * FROM hd UNION ALL SELECT 2, * FROM (SELECT * FROM mh ORDER BY place LIMIT 12) UNION ALL SELECT 3, * FROM {negatives})"
    return {
        "normalize_text_docs": f"SELECT doc_id, {normalized('text')} AS normalized FROM documents",
        "infer_metadata": f"SELECT page_id, {department} AS department, {access} AS access_level, {day} AS updated_at FROM pages",
        "tokenize_index": f"SELECT doc_id, array_to_string({index_tokens('text')}, ' ') AS tokens FROM documents",
        "tokenize_overlap": f"SELECT doc_id, array_to_string({overlap_tokens('text')}, ' ') AS tokens FROM documents",
        "strip_accents_docs": "SELECT doc_id, strip_accents(text) AS stripped FROM documents",
        "overlap_score_pairs": sql(f"SELECT doc_id, round({overlap('q', 'c')}, 6) AS score FROM (SELECT doc_id, {token_set('text')} AS q, {token_set('other')} AS c FROM pr)", "pr"),
        "phrase_match_pairs": sql(f"SELECT doc_id, round({phrase('q', 'c')}, 6) AS score FROM (SELECT doc_id, {token_set('text')} AS q, {token_set('other')} AS c FROM pr)", "pr"),
        "content_coverage_pairs": sql(f"SELECT doc_id, round({coverage('text', 'other', 5)}, 6) AS coverage FROM pr", "pr"),
        "quoted_targets": sql("SELECT query_id, array_to_string(titles, '|') AS doc_titles, array_to_string(sections, '|') AS sections, array_to_string(list_concat(titles, sections), '|') AS phrases FROM qs", "qs"),
        "question_flags": sql(f"SELECT doc_id, list_contains({all_tokens('text')}, 'co') AND list_contains({all_tokens('text')}, 'khong') AS yes_no, array_to_string({numbers('text')}, ' ') AS numbers, array_to_string({_bounded('text', '[A-Z]')}, ' ') AS acronyms, {numbers_supported('text', 'other')} AS numbers_supported, {acronyms_supported('text', 'other')} AS acronyms_supported FROM pr", "pr"),
        "section_blocks": f"SELECT 'd' || doc_id AS doc_id, source || ' > ' || lang AS section_path, md5({normalized('text')}) AS text_md5 FROM documents WHERE {normalized('text')} <> ''",
        "chunk_windows": sql("SELECT doc_id, chunk_id, title, section_path, department, updated_at, access_level, text FROM ck", "ck"),
        "section_paths": _SECTION_PATHS,
        "chunk_round_trip": sql("SELECT doc_id, chunk_id, title, section_path, department, updated_at, access_level, text FROM ck", "ck"),
        "item_round_trip": sql(f"SELECT id, question, gold, difficulty, CASE WHEN gold <> '' THEN 'positive' ELSE 'negative' END AS query_type FROM ({generated})", "ea hd mh"),
        "negative_answers": sql("SELECT query_id, array_to_string(ids, '|') AS cited, confidence, status, clarifying_question FROM an", "an", q="nq"),
        "ask_debug": sql("SELECT qs.query_id, an.status, coalesce((SELECT string_agg(chunk_id, '|' ORDER BY rank) FROM bm WHERE bm.query_id = qs.query_id AND rank <= 5), '') AS bm25, coalesce((SELECT string_agg(chunk_id, '|' ORDER BY rank) FROM dn WHERE dn.query_id = qs.query_id AND rank <= 5), '') AS dense, round(l, 6) AS lexical_weight, CAST(24 AS BIGINT) AS candidate_size, 0.18::DOUBLE AS min_score, 0.6::DOUBLE AS min_yesno_relevance, 0.5::DOUBLE AS min_doc_coverage FROM qs JOIN qw USING (query_id) JOIN an ON an.query_id = qs.query_id", "qs bm dn qw an"),
        "parse_dates": sql("SELECT chunk_id, updated_at AS day, '1970-01-01' AS fallback FROM ck", "ck"),
        "citation_signatures": sql(f"SELECT chunk_id, {signature('text')} AS signature, substr(text, 1, 250) AS snippet FROM ck", "ck"),
        "term_df_idf": sql("SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * avg(r) OVER () ELSE r END, 6) AS idf, round(plain, 6) AS plain_idf FROM rw", "rw").replace("ix AS (", "ix AS MATERIALIZED (").replace("df AS (", "df AS MATERIALIZED ("),
        "simple_tfidf_topk": sql(ranked + "pb", "pb", q="oq"),
        "bm25_okapi_topk": sql(ranked + "bm", "bm", q="oq"),
        "bm25_filtered_topk": sql(ranked + "bm", "bm"),
        "segmented_bm25_topk": sql(ranked + "bm", "bm", q="oq"),
        "segmented_dense_topk": sql(ranked + "dn", "dn", q="oq"),
        "hash_embed_buckets": sql("SELECT DISTINCT term, CAST(md5_number_upper(term) % 384 AS BIGINT) AS bucket FROM po", "po"),
        "dense_hash_topk": sql(ranked + "dn", "dn", q="oq"),
        "dense_postfilter_topk": sql(ranked + "dn", "dn"),
        "embedding_knn": knn,
        "minmax_norm": sql(f"SELECT 'bm25' AS source, query_id, chunk_id, {r('norm')} FROM bn UNION ALL SELECT 'dense', query_id, chunk_id, {r('norm')} FROM dm", "bn dm"),
        "weighted_fusion": sql(fused, "fu"),
        "rrf_fusion": sql(fused, "fu", fused="rrf"),
        "query_weights": sql("SELECT query_id, round(l, 6) AS lexical, round(d, 6) AS dense FROM qw", "qw"),
        "recency_boost": sql(ranked + "rc", "rc"),
        "metadata_boost": sql(ranked + "mb", "mb", h="fl"),
        "threshold_filter": sql(f"SELECT query_id, chunk_id, {r('score')}, {r('relative')}, {r('overlap')}, CAST(rank AS INTEGER) AS rank FROM hit", "hit", h="fl", limits=(0.3, 0.6, 0.2)),
        "hybrid_search": sql(f"SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, title, section_path, {r('score')}, substr(text, 1, 250) AS snippet FROM hit", "hit"),
        "search_debug_arrays": sql("SELECT query_id, coalesce((SELECT string_agg(chunk_id, '|' ORDER BY rank) FROM bm WHERE bm.query_id = qs.query_id AND rank <= 5), '') AS bm25, coalesce((SELECT string_agg(chunk_id, '|' ORDER BY rank) FROM dn WHERE dn.query_id = qs.query_id AND rank <= 5), '') AS dense, round(l, 6) AS lexical_weight, round(d, 6) AS dense_weight, CAST(24 AS BIGINT) AS candidate_size FROM qs JOIN qw USING (query_id)", "qs bm dn qw"),
        "citation_select": sql("SELECT query_id, array_to_string(ids, '|') AS selected, CAST(n_candidates AS BIGINT) AS n_candidates, round(coverage, 6) AS coverage FROM f0", "f0"),
        "confidence_label": sql("SELECT query_id, CASE WHEN n_hits = 0 THEN 'Low' WHEN top_score >= 0.75 AND coverage >= 1 THEN 'High' WHEN top_score >= 0.35 AND coverage >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM f0", "f0"),
        "refusal_gates": sql(f"SELECT query_id, {', '.join(map(r, 'top_text top_meta top_relevance second_ratio open_coverage doc_coverage'.split()))}, CAST(support AS BIGINT) AS support, {gates}, refused FROM gt", "gt"),
        "ask_pipeline": sql("SELECT query_id, answer, array_to_string(ids, '|') AS cited, confidence, status, clarifying_question FROM an", "an"),
        "heuristic_answer": sql("SELECT query_id, coalesce(draft, 'NOT_FOUND') AS draft FROM qx LEFT JOIN hq USING (query_id)", "qx hq"),
        "sentence_snippets": sql(f"SELECT chunk_id, {snippet('text')} AS snippet, {first_sentence('text')} AS first_sentence, {bullet('text')} AS bullet FROM ck", "ck"),
        "prompt_build": sql(prompt, "qx hit"),
        "recall_mrr_eval": recall,
        "answer_eval_confusion": sql("SELECT tp, fp, fn, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall, round(2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-9, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)), 6) AS f1 FROM (SELECT count(*) FILTER (WHERE len(gold) = 0 AND status = 'NOT_FOUND') AS tp, count(*) FILTER (WHERE len(gold) > 0 AND status = 'NOT_FOUND') AS fp, count(*) FILTER (WHERE len(gold) = 0 AND status <> 'NOT_FOUND') AS fn FROM ev)", "ev", q="iq"),
        "failure_report": sql("SELECT 'failure' AS kind, failure AS name, count(*) AS n FROM fa GROUP BY failure UNION ALL SELECT 'query_type', query_type, count(*) FROM fa GROUP BY query_type UNION ALL SELECT 'difficulty', difficulty, count(*) FROM fa GROUP BY difficulty", "fa", q="iq"),
        "failure_samples": sql("SELECT id, failure, status, confidence, array_to_string(gold, '|') AS gold, array_to_string(cited, '|') AS cited, CAST(row_number() OVER (PARTITION BY failure ORDER BY id) AS INTEGER) AS place FROM fa QUALIFY place <= 3", "fa", q="iq"),
        "failure_rates": sql("SELECT count(*) AS total_items, count(*) FILTER (WHERE len(gold) > 0) AS positive_items, count(*) FILTER (WHERE len(gold) = 0) AS negative_items, round(count(*) FILTER (WHERE len(gold) > 0 AND list_has_any(retrieved, gold)) / greatest(1, count(*) FILTER (WHERE len(gold) > 0)), 6) AS retrieval_recall_at_k, round(count(*) FILTER (WHERE len(gold) > 0 AND status = 'NOT_FOUND') / greatest(1, count(*) FILTER (WHERE len(gold) > 0)), 6) AS false_refusal_rate, round(count(*) FILTER (WHERE len(gold) = 0 AND status <> 'NOT_FOUND') / greatest(1, count(*) FILTER (WHERE len(gold) = 0)), 6) AS negative_hallucination_rate FROM ev", "ev", q="iq"),
        "eval_dataset_easy": sql(easy + "ea", "ea"),
        "eval_dataset_gen": sql(generated, "ea hd mh"),
        "multi_hop_pairs": sql(easy + "mh", "mh"),
        "stratified_split": sql("SELECT id, query_type, difficulty, place <= CASE WHEN n <= 1 THEN 0 ELSE greatest(1, least(n - 1, CAST(round_even(n * 0.2, 0) AS BIGINT))) END AS holdout FROM (SELECT place AS id, query_type, domain AS difficulty, count(*) OVER (PARTITION BY query_type, domain) AS n, row_number() OVER (PARTITION BY query_type, domain ORDER BY md5(place || ':42'), place) AS place FROM ea)", "ea"),
        "dataset_summary": sql("SELECT query_type, difficulty, count(*) AS n FROM (SELECT * FROM ea UNION ALL SELECT * FROM mh) GROUP BY ALL", "ea mh"),
        "chunk_statistics": sql(f"SELECT department, access_level, count(*) AS n, CAST(sum(len({words('text')})) AS BIGINT) AS words FROM ck GROUP BY ALL", "ck"),
    }
