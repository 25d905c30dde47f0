"""SQL that gives the rows of the registered queries, built from the operators' own tables of fixed values.

RE2 has no lookarounds: a word list with Unicode boundaries is compared with the words of a text, other bounded patterns
take the neighbouring character along, and `\\b` means ASCII words in RE2 as it does in the fixed values.
"""

from __future__ import annotations

from inkspan.functions import text as T
from inkspan.operators import match, prep, rewrite, stylometry as S
from inkspan.operators.sequence import Settings

OUT = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ws(pattern: str) -> str:
    return pattern.replace(r"[\s\S]", "(?s:.)").replace(r"\s", T.WS)


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{T.WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"CASE WHEN {norm(x)} = '' THEN [] ELSE string_split({norm(x)}, ' ') END"


def count_words(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '[^{T.WS[1:-1]}]+'))"


def tokens(x: str) -> str:
    """Tokens of a text in normal white space."""
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\s''-]', ' ', 'g'), '\s+'), lambda t: length(t) > 2)"


def clamp(x: str) -> str:
    return f"greatest(0, least(100, coalesce(round({x}), 0)))::INT"


def listed(names) -> str:
    return ", ".join(q(n) for n in names)


def hits(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q('(?i)' + ws(pattern))}))"


def whole_words(x: str, alternatives: str) -> str:
    """How often the words stand in a text, bounded by other characters."""
    return f"len(list_filter(regexp_split_to_array(lower({x}), '{OUT}+'), lambda w: w IN ({listed(alternatives.split('|'))})))"


STOP = listed(T.STOP_WORDS)


def settings(n: str, s: Settings = Settings()) -> str:
    """CTE columns cw, ov, step, most of n words."""
    cw = f"CASE WHEN {n} > 20000 THEN 520 WHEN {n} > 10000 THEN 460 WHEN {n} > 5000 THEN 380 WHEN {n} > 2000 THEN {max(s.chunk_words, 240)} ELSE {s.chunk_words} END"
    return f"({cw})::INT AS cw, least(floor(({cw}) * 0.18), CASE WHEN {n} > 5000 THEN {max(s.overlap_words, 56)} ELSE {max(s.overlap_words, 32)} END)::INT AS ov"


def chunk_ctes(s: Settings = Settings()) -> str:
    return f"""c0 AS MATERIALIZED (SELECT doc_id, {words('text')} AS w FROM documents), c1 AS (SELECT *, len(w) AS n, {settings('len(w)', s)} FROM c0 WHERE len(w) > 0),
c2 AS (SELECT *, greatest(60, cw - ov) AS step, greatest(1, ceil(greatest(1, n - ov) / greatest(60, cw - ov)))::INT AS most, greatest(80, cw) AS size FROM c1),
c3 AS (SELECT *, size - least(ov, size // 2) AS hop FROM c2),
c4 AS (SELECT *, unnest(range(0, least(greatest(0, ceil((n - size) / hop)), most - 1)::INT + 1)) AS k FROM c3),
chunk AS MATERIALIZED (SELECT doc_id, k::INT AS chunk_index, list_slice(w, k * hop + 1, k * hop + size) AS cws FROM c4)"""


def grams(t: str, k: int) -> str:
    return f"CASE WHEN len({t}) >= {k} THEN list_transform(range(1, len({t}) - {k - 2}), lambda i: array_to_string(list_slice({t}, i, i + {k - 1}), ' ')) ELSE [] END"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct({a})) END"


FNV = f"list_reduce(list_prepend({T.FNV_START}::BIGINT, list_transform(string_split(g, ''), lambda x: unicode(x)::BIGINT)), lambda h, c: (xor(h, c) * {T.FNV_PRIME}) & {T.MASK})"


def winnowed(g: str) -> str:
    """Fingerprints of a list of 5-grams: the least of every four neighbours."""
    h = f"list_transform({g}, lambda g: {FNV})"
    return f"CASE WHEN len({g}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, len({g}) - least(4, len({g})) + 2), lambda i: list_min(list_slice({h}, i, i + least(4, len({g})) - 1)))) END"


ITEMS = f"SELECT 'item:' || item_id AS url, CASE WHEN {count_words('text')} >= 18 THEN text ELSE 'item ' || item_id || ' ' || text END AS cand, text <> '' AS page FROM benchmark"


def reuse(s: Settings = Settings(), candidates: str = ITEMS, most: int | None = match.SCANNED) -> str:
    """All pairs that share two neighbouring tokens or three of content, scored; without either a score is 21 at most."""
    first = lambda t: f"list_slice({t}, 1, {most})" if most else t
    return f"""WITH {chunk_ctes(s)},
a0 AS MATERIALIZED (SELECT doc_id, chunk_index, array_to_string(cws, ' ') AS t, array_to_string(list_slice(cws, 1, 48), ' ') AS excerpt FROM chunk),
a AS MATERIALIZED (SELECT *, {tokens('t')} AS sr, list_filter({tokens('t')}, lambda t: t NOT IN ({STOP})) AS st FROM a0),
b0 AS MATERIALIZED ({candidates}),
b AS MATERIALIZED (SELECT *, {first(tokens(norm('cand')))} AS cr, {first(f"list_filter({tokens(norm('cand'))}, lambda t: t NOT IN ({STOP}))")} AS ct FROM b0),
ag AS MATERIALIZED (SELECT doc_id, chunk_index, sr, st, excerpt, {grams('sr', 2)} AS g2, {grams('st', 3)} AS g3, {grams('sr', 5)} AS g5 FROM a),
aw AS MATERIALIZED (SELECT *, {winnowed('g5')} AS ws FROM ag),
bg AS MATERIALIZED (SELECT *, {grams('cr', 2)} AS g2, {grams('ct', 3)} AS g3, {grams('cr', 5)} AS g5 FROM b),
bw AS MATERIALIZED (SELECT *, {winnowed('g5')} AS wc FROM bg),
k AS (SELECT DISTINCT doc_id, chunk_index, url FROM (SELECT doc_id, chunk_index, unnest(list_concat(list_transform(g2, lambda x: 'r' || x), list_transform(g3, lambda x: 'c' || x))) AS x FROM ag) JOIN (SELECT url, unnest(list_concat(list_transform(g2, lambda x: 'r' || x), list_transform(g3, lambda x: 'c' || x))) AS x FROM bg) USING (x)),
p AS MATERIALIZED (SELECT aw.doc_id, aw.chunk_index, bw.url, sr, st, cr, ct, excerpt, page, aw.g3 AS s3, bw.g3 AS c3s, aw.g5 AS s5, bw.g5 AS c5s, ws, wc FROM k JOIN aw USING (doc_id, chunk_index) JOIN bw USING (url)),
x AS (SELECT doc_id, chunk_index, url, unnest(sr) AS t, unnest(range(0, len(sr))) AS s FROM p), y AS (SELECT url, unnest(cr) AS t, unnest(range(0, len(cr))) AS c FROM b),
h AS (SELECT doc_id, chunk_index, url, s, s - c AS d FROM x JOIN y USING (url, t)),
g AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, chunk_index, url, d ORDER BY s) AS k FROM h),
run AS (SELECT doc_id, chunk_index, url, b.n AS longest_run, -b.s AS run_start, -b.c AS cand_start FROM (SELECT doc_id, chunk_index, url, max({{'n': n, 's': -s, 'c': d - s}}) AS b FROM (SELECT doc_id, chunk_index, url, d, k, count(*) AS n, min(s) AS s FROM g GROUP BY ALL) GROUP BY ALL)),
m AS MATERIALIZED (SELECT *, CASE WHEN len(st) = 0 THEN 0 ELSE len(list_filter(st, lambda t: list_contains(ct, t))) / len(st) END AS tok, {overlap('s3', 'c3s')} AS o3, {overlap('s5', 'c5s')} AS o5,
  list_filter(range(1, len(st) + 1), lambda i: list_position(st, st[i]) = i) AS firsts FROM p),
f AS MATERIALIZED (SELECT *, {overlap('ws', 'wc')} AS hash, len(firsts) AS n, list_filter(list_transform(firsts, lambda i: coalesce(list_position(ct, st[i]), 0)), lambda p: p > 0) AS pos FROM m),
z AS (SELECT f.*, coalesce(longest_run, 0) AS longest_run, run_start, cand_start, CASE WHEN n = 0 THEN 0 ELSE least(1.0, len(pos) / n + len(list_filter(range(2, len(pos) + 1), lambda i: abs(pos[i] - pos[i - 1]) <= 18)) / greatest(1, n - 1) * 0.22) END AS ft FROM f LEFT JOIN run USING (doc_id, chunk_index, url)),
scored AS (SELECT doc_id, chunk_index, url, {clamp("(tok * 0.10 + greatest(o3 * 0.75, o5) * 0.30 + least(1.0, longest_run / 15) * 0.24 + hash * 0.26 + ft * 0.10) * 100 * CASE WHEN page THEN 1.0 ELSE 0.72 END")} AS score,
  {clamp('tok * 100')} AS overlap_percent, {clamp('greatest(o3 * 0.75, o5) * 100')} AS ngram_percent, {clamp('hash * 100')} AS hash_percent, {clamp('ft * 100')} AS full_text_rank, longest_run::INT AS longest_run, CASE WHEN page THEN 'page' ELSE 'snippet' END AS confidence, excerpt,
  CASE WHEN longest_run >= 5 THEN array_to_string(list_slice(sr, run_start + 1, run_start + longest_run), ' ') END AS submitted_evidence, CASE WHEN longest_run >= 5 AND page THEN array_to_string(list_slice(cr, cand_start + 1, cand_start + longest_run), ' ') END AS source_evidence FROM z),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, longest_run DESC, chunk_index, url)::INT AS rank FROM scored WHERE score >= {s.threshold} OR longest_run >= 10),
matches AS (SELECT * FROM ranked WHERE rank <= 24)"""


def scan(s: Settings = Settings()) -> str:
    """Both phases: every item as a snippet of thirty words, and as its page; pages count where the snippet comes near."""
    short = f"array_to_string(list_slice({words('text')}, 1, 30), ' ')"
    page = f"CASE WHEN {count_words('text')} >= 18 THEN text ELSE 'item ' || item_id || ' ' || {short} END"
    both = f"SELECT 'item:' || item_id || '|0' AS url, 'item ' || item_id || ' ' || {short} AS cand, false AS page FROM benchmark UNION ALL SELECT 'item:' || item_id || '|1', {page}, true FROM benchmark WHERE text <> ''"
    return f"""{reuse(s, both)},
per AS (SELECT doc_id, any_value(n) AS n, count(*) AS c FROM c4 GROUP BY doc_id),
modes AS (SELECT doc_id, CASE WHEN n > 8000 OR c > 45 THEN 32 WHEN n > 2000 OR c > 18 THEN 48 ELSE 80 END AS page_limit FROM per),
q0 AS (SELECT * EXCLUDE (url), split_part(url, '|', 1) AS url, split_part(url, '|', 2)::INT AS phase FROM scored),
near AS (SELECT q0.doc_id, chunk_index, url, page_limit, row_number() OVER (PARTITION BY q0.doc_id ORDER BY score DESC, longest_run DESC, chunk_index, url) AS place FROM q0 JOIN modes USING (doc_id) WHERE phase = 0 AND (score >= {s.threshold - 10} OR longest_run >= 7)),
every AS (SELECT * FROM q0 WHERE phase = 0 UNION ALL SELECT q0.* FROM q0 SEMI JOIN (SELECT * FROM near WHERE place <= page_limit) USING (doc_id, chunk_index, url) WHERE phase = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, url, chunk_index ORDER BY score DESC, phase) AS z FROM every),
final AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, longest_run DESC, chunk_index, url)::INT AS rank FROM best WHERE z = 1 AND (score >= {s.threshold} OR longest_run >= 10))
SELECT doc_id, chunk_index, url, score, longest_run, confidence, rank FROM final WHERE rank <= 24"""


def searched(candidates: str = ITEMS) -> str:
    """CTEs to `listed`(doc_id, chunk_index, place, url, score): each chunk's candidates, every source scored for every query."""
    terms = lambda x: rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    return f"""pq AS MATERIALIZED ({probes()}),
per AS (SELECT doc_id, any_value(n) AS n, count(*) AS c FROM c4 GROUP BY doc_id),
modes AS MATERIALIZED (SELECT doc_id, n > 2000 OR c > 18 AS long, CASE WHEN n > 8000 OR c > 45 THEN 3 WHEN n > 2000 OR c > 18 THEN 4 ELSE 8 END AS search_limit, CASE WHEN n > 8000 OR c > 45 THEN 1 WHEN n > 2000 OR c > 18 THEN 2 ELSE 3 END AS query_limit, CASE WHEN n > 8000 OR c > 45 THEN 32 WHEN n > 2000 OR c > 18 THEN 48 ELSE 80 END AS page_limit FROM per),
asked AS (SELECT pq.*, search_limit FROM pq JOIN modes USING (doc_id) WHERE place < query_limit),
sl AS MATERIALIZED (SELECT url, {terms('cand')} AS t FROM ({candidates})), st AS (SELECT url, term, count(*) AS tf FROM (SELECT url, unnest(t) AS term FROM sl) GROUP BY ALL),
idf AS (SELECT term, round(ln(1 + (SELECT count(*) FROM sl) / count(*)) * 1000)::BIGINT AS idf FROM st GROUP BY term),
sw AS MATERIALIZED (SELECT url, term, idf * length(bin(tf)) AS w FROM st JOIN idf USING (term)),
ql AS MATERIALIZED (SELECT query, query[1] = '"' AS exact, {terms('query')} AS t FROM (SELECT DISTINCT query FROM asked)),
qs AS (SELECT query, url, sum(w)::BIGINT AS score FROM (SELECT DISTINCT query, unnest(t) AS term FROM ql) JOIN sw USING (term) GROUP BY ALL),
hits AS (SELECT query, url, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, url) AS rank FROM qs JOIN ql USING (query) JOIN sl USING (url)
  WHERE NOT exact OR contains(' ' || array_to_string(sl.t, ' ') || ' ', ' ' || array_to_string(ql.t, ' ') || ' ')),
merged AS (SELECT doc_id, chunk_index, url, any_value(search_limit) AS search_limit, min({{'rank': rank, 'turn': place, 'score': score}}) AS f FROM asked JOIN hits USING (query) WHERE rank <= search_limit GROUP BY ALL),
listed AS MATERIALIZED (SELECT doc_id, chunk_index, (row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY f) - 1)::INT AS place, url, f.score AS score, search_limit FROM merged QUALIFY place < least(10, search_limit))"""


def searched_candidates() -> str:
    return f"WITH {chunk_ctes()}, {searched()} SELECT doc_id, chunk_index, place, url AS source, score FROM listed"


def searched_scan(s: Settings = Settings()) -> str:
    """The scan of each chunk's own candidates: snippets of thirty words, whose pages hold the whole."""
    short = f"array_to_string(list_slice({words('text')}, 1, 30), ' ')"
    page = f"CASE WHEN {count_words('text')} >= 18 THEN text ELSE 'item ' || item_id || ' ' || {short} END"
    both = f"SELECT 'item:' || item_id || '|0' AS url, 'item ' || item_id || ' ' || {short} AS cand, false AS page FROM benchmark UNION ALL SELECT 'item:' || item_id || '|1', {page}, true FROM benchmark WHERE text <> ''"
    only = f"SELECT 'item:' || item_id AS url, 'item ' || item_id || ' ' || {short} AS cand FROM benchmark WHERE text <> ''"
    return f"""{reuse(s, both)}, {searched(only)},
q0 AS (SELECT scored.* EXCLUDE (url), split_part(scored.url, '|', 1) AS url, split_part(scored.url, '|', 2)::INT AS phase FROM scored),
mine AS MATERIALIZED (SELECT q0.*, long, page_limit FROM q0 SEMI JOIN listed USING (doc_id, chunk_index, url) JOIN modes USING (doc_id)),
first AS (SELECT * FROM mine WHERE phase = CASE WHEN long THEN 0 ELSE 1 END),
near AS (SELECT doc_id, chunk_index, url, page_limit, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, longest_run DESC, chunk_index, url) AS turn FROM first WHERE long AND (score >= {s.threshold - 10} OR longest_run >= 7)),
every AS (SELECT * FROM first UNION ALL SELECT mine.* FROM mine SEMI JOIN (SELECT * FROM near WHERE turn <= page_limit) USING (doc_id, chunk_index, url) WHERE phase = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, url, chunk_index ORDER BY score DESC, phase) AS z FROM every),
final AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, longest_run DESC, chunk_index, url)::INT AS rank FROM best WHERE z = 1 AND (score >= {s.threshold} OR longest_run >= 10))
SELECT doc_id, chunk_index, url, score, longest_run, confidence, rank FROM final WHERE rank <= 24"""


def language(length: int = 300) -> str:
    """CTEs to `far`(doc_id, language, distance), by trigrams of whole texts."""
    return f"""l0 AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INT % 5 = 0 AS held_out, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) AS s FROM documents),
lt AS MATERIALIZED (SELECT doc_id, lang, held_out, CASE WHEN s = '' THEN [] ELSE string_split(' ' || s || ' ', '') END AS c FROM l0),
lg AS (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM lt),
ln_ AS MATERIALIZED (SELECT doc_id, lang, held_out, g, count(*) AS n FROM lg GROUP BY ALL),
lp AS (SELECT lang AS language, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS r FROM ln_ WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY r < {length}),
ld AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r FROM ln_ QUALIFY r < {length}),
far AS (SELECT doc_id, language, sum(coalesce(abs(ld.r - lp.r), {length}))::BIGINT AS distance FROM ld CROSS JOIN (SELECT DISTINCT language FROM lp) LEFT JOIN lp USING (language, g) GROUP BY ALL)"""


def breaker(threshold: int = 3, open_s: int = 60) -> str:
    """Each provider's log replayed row by row: a run of failures opens the breaker, a later call closes it."""
    return f"""WITH RECURSIVE log AS MATERIALIZED (SELECT 'p' || (user_id % 7) AS provider, ts, event_id AS seq, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS k FROM events),
go(provider, k, failures, until, allowed) AS (
  SELECT DISTINCT provider, 0::BIGINT, 0, NULL::TIMESTAMP, NULL::BOOLEAN FROM log
  UNION ALL
  SELECT x.provider, x.k, CASE WHEN shut THEN failures WHEN ok THEN 0 ELSE since + 1 END, CASE WHEN shut THEN until WHEN ok THEN NULL WHEN since + 1 >= {threshold} THEN ts + INTERVAL {open_s} SECONDS END, NOT shut
  FROM (SELECT log.provider, log.k, log.ts, log.ok, go.failures, go.until, coalesce(log.ts < go.until, false) AS shut, CASE WHEN go.until IS NULL THEN go.failures ELSE 0 END AS since FROM go JOIN log ON log.provider = go.provider AND log.k = go.k + 1) x)
SELECT provider, ts, seq, ok, allowed FROM go JOIN log USING (provider, k)"""


def extracted() -> str:
    white = T.WS.replace(r"\n", "")
    t = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
    for pattern, to in ((white + "+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")):
        t = f"regexp_replace({t}, '{pattern}', {to}, 'g')"
    return f"SELECT doc_id, trim(regexp_replace({t}, '^{T.WS}+|{T.WS}+$', '', 'g')) AS text FROM documents"


def rich_round_trip() -> str:
    """Paragraphs by blank lines, trimmed; lines without blanks around them and runs of blanks; never two blank lines."""
    lines = "list_transform(string_split(p, chr(10)), lambda x: regexp_replace(trim(x, chr(9) || ' '), '[ \\t]{2,}', ' ', 'g'))"
    parts = f"list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda p: regexp_replace(p, '^{T.WS}+|{T.WS}+$', '', 'g')), lambda p: p <> '')"
    whole = f"array_to_string(list_transform({parts}, lambda p: array_to_string({lines}, chr(10))), chr(10) || chr(10))"
    return f"SELECT conv_id, turn, regexp_replace(regexp_replace({whole}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{T.WS}+|{T.WS}+$', '', 'g') AS text FROM conversations"


def task_outcomes() -> str:
    went = "CASE WHEN allowed THEN 1 ELSE 0 END"
    return f"""WITH b AS ({breaker()}) SELECT provider, seq, ({went})::INT AS attempted, ({went} * ok::INT)::INT AS succeeded, ({went} * (NOT ok)::INT)::INT AS failed,
({went} * (NOT ok)::INT * (seq % 2 = 0)::INT)::INT AS timed_out, ({went} * ok::INT * 3)::INT AS results, CASE WHEN NOT allowed THEN 'тимчасово призупинено після повторних помилок' END AS skipped_reason FROM b"""


def document_texts() -> str:
    """Prose without the title page: two of its marks and a heading of the body in the first 5000 characters."""
    head = "substr(prose, 1, 5000)"
    marks = " + ".join(f"regexp_matches({head}, {q('(?i)' + ws(m))})::INT" for m in prep.TITLE)
    body = f"(?is)^((?:.*?{OUT})?){ws('(?:вступ|розділ' + chr(92) + 's*1|розділ' + chr(92) + 's*i|chapter' + chr(92) + 's*1|introduction)')}(?:$|{OUT})"
    return f"""WITH src AS (SELECT doc_id, text AS raw FROM documents), {prose_ctes('src', 'doc_id')},
t0 AS (SELECT *, {marks} AS marks, regexp_matches({head}, {q(body)}) AS found, length(regexp_extract({head}, {q(body)}, 1)) AS pos FROM prosed),
t1 AS (SELECT *, CASE WHEN marks >= 2 AND found AND pos > 40 AND length(substr(prose, pos + 1)) > 120 THEN substr(prose, pos + 1) ELSE prose END AS body FROM t0)
SELECT doc_id, body AS text, {count_words('substr(prose, 1, length(prose) - length(body))')}::INT AS skipped_title_words, code_words, code_blocks FROM t1"""


def scan_reports() -> str:
    """Scores, verdicts and the summary's sentences for the scan in two phases; all searches count for every document."""
    # The report's sentences.
    said = """CASE verdict WHEN 'insufficient' THEN 'Для локального AI-висновку недостатньо авторського тексту.' WHEN 'mixed' THEN 'Локальний AI-аналіз виявив неоднорідні сегменти; індикатор ризику: ' || probability || '%.' WHEN 'uncertain' THEN 'Локальний AI-аналіз невизначений; індикатор ризику: ' || probability || '%.'
  WHEN 'high' THEN 'Локальний AI-аналіз показує високий ризик; індикатор: ' || probability || '%.' WHEN 'elevated' THEN 'Локальний AI-аналіз показує підвищений ризик; індикатор: ' || probability || '%.' ELSE 'Локальний AI-аналіз показує низький ризик; індикатор: ' || probability || '%.' END"""
    return f"""WITH matches AS MATERIALIZED ({scan()}), verdicts AS MATERIALIZED (WITH {verdict_ctes()} SELECT doc_id, probability, verdict FROM judged), scores AS ({REUSE_SCORE}),
per AS (SELECT doc_id, count(*) AS n_matches, count(*) FILTER (confidence = 'page') AS n_confirmed, arg_min(score, rank) FILTER (confidence = 'page') AS top_score, arg_min('item ' || split_part(url, ':', 2), rank) FILTER (confidence = 'page') AS top_title FROM matches GROUP BY doc_id),
total AS (SELECT count(*) AS attempted, count(*) FILTER (event_type <> 'error') AS succeeded FROM events),
r AS (SELECT doc_id, coalesce(plagiarism_score, 0) AS plagiarism_score, probability, verdict, coalesce(n_matches, 0) AS n_matches, coalesce(n_confirmed, 0) AS n_confirmed, top_score, top_title, attempted, succeeded, {said} AS said FROM verdicts LEFT JOIN per USING (doc_id) LEFT JOIN scores USING (doc_id), total)
SELECT doc_id, plagiarism_score, probability, verdict, n_matches, n_confirmed, CASE
  WHEN n_matches = 0 AND succeeded = 0 AND attempted > 0 THEN 'Вебпошук не завершено: усі ' || attempted || ' запитів завершилися помилкою. Відсутність збігів не підтверджена. ' || said
  WHEN n_matches = 0 THEN 'Сильних збігів у відкритих вебджерелах не знайдено. ' || said
  WHEN n_confirmed = 0 THEN 'Знайдено ' || n_matches || ' можливих джерел у пошукових уривках, але текст сторінок не підтверджено. Вони не впливають на ризик плагіату. ' || said
  ELSE 'Найсильніший підтверджений збіг: ' || top_score || '% з "' || top_title || '". Загальний ризик плагіату: ' || plagiarism_score || '%. ' || said || CASE WHEN n_matches > n_confirmed THEN ' Ще ' || (n_matches - n_confirmed) || ' пошукових підказок потребують підтвердження.' ELSE '' END END AS summary FROM r"""


REUSE_SCORE = f"""SELECT doc_id, {clamp('sum(score * w) / sum(w)')} AS plagiarism_score FROM
(SELECT *, greatest(0.35, 1 - i * 0.08) AS w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS i FROM matches WHERE confidence = 'page') WHERE i < 8) GROUP BY doc_id"""


def style_ctes(source: str, keys: str) -> str:
    """CTEs from source(keys, txt) to `scored`, with every signal's score."""
    heading = f"regexp_matches(trim(regexp_replace(lower(s), '[.!?:;]+$', '')), {q('(?i)' + S.HEADING)}) AND len({tokens('s')}) <= 8"
    group = lambda patterns: clamp(f"least(1.0, ({' + '.join(hits('norm', p) for p in patterns)}) / greatest(1.0, wc / 100) / 2.0) * 100")
    share = lambda names: clamp(f"len(list_filter(words, lambda w: w IN ({listed(names)}))) / greatest(1, wc) * 3500")
    names = S.drafts()
    channel = lambda c: clamp(f"coalesce(t_{c}[1], 0) * 0.55 + coalesce(t_{c}[2], 0) * 0.30 + coalesce(t_{c}[3], 0) * 0.15")
    tops = ", ".join(f"list_reverse_sort(list_filter([{', '.join(f'{n} * {min(1.15, max(0.45, w))}' for n, k, w in names if k == c)}], lambda x: x > 0)) AS t_{c}" for c in S.CHANNELS)
    every = ", ".join(n for n, _, _ in names)
    ranked = ", ".join(f"{{'m': -{n}, 'k': {k}, 'l': {q(S.LABELS[n])}}}" for k, (n, _, _) in enumerate(names))
    return f"""n0 AS MATERIALIZED (SELECT {keys}, {norm('txt')} AS norm FROM {source}),
n1 AS MATERIALIZED (SELECT *, {tokens('norm')} AS words, list_filter(list_transform(string_split(regexp_replace(norm, '([.!?…]) ', '\\1' || chr(31), 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> '') AS sents FROM n0),
n2 AS MATERIALIZED (SELECT *, len(words) AS wc, list_filter(words, lambda w: w NOT IN ({STOP})) AS content, list_filter(sents, lambda s: NOT ({heading})) AS prose FROM n1),
n3 AS MATERIALIZED (SELECT *, list_transform(prose, lambda s: {tokens('s')}) AS pw FROM n2),
n4 AS MATERIALIZED (SELECT *, list_filter(list_transform(pw, lambda w: len(w)::DOUBLE), lambda n: n > 0) AS lens, list_filter(list_transform(pw, lambda w: array_to_string(list_slice(w, 1, 3), ' ')), lambda s: length(s) > 4) AS starts, {grams('content', 4)} AS grams FROM n3),
n5 AS MATERIALIZED (SELECT *, coalesce(list_avg(lens), 0) AS mean, {clamp("(len(grams) - len(list_distinct(grams))) / greatest(1.0, len(content) / 100) * 60")} AS gram_score,
  len(list_distinct(regexp_extract_all(regexp_replace(norm, '--|—|–', '', 'g'), '[;:!?()\\[\\]]'))) AS marks,
  CASE WHEN wc = 0 THEN 0.0 WHEN wc <= 50 THEN len(list_distinct(words)) / wc ELSE list_sum(list_transform(list_append(range(0, wc - 49, 25), wc - 50), lambda i: len(list_distinct(list_slice(words, i + 1, i + 50))) / 50)) / (len(range(0, wc - 49, 25)) + 1) END AS mattr FROM n4),
n6 AS MATERIALIZED (SELECT *, CASE WHEN len(lens) < 2 OR mean = 0 THEN 1.0 ELSE sqrt(list_sum(list_transform(lens, lambda x: (x - mean) * (x - mean))) / len(lens)) / mean END AS cv FROM n5),
n7 AS MATERIALIZED (SELECT *, {clamp("(1 - least(1.0, cv / 0.55)) * 100 * CASE WHEN len(prose) >= 4 THEN 1.0 ELSE 0.6 END")} AS rhythm, {clamp("greatest(0.0, 0.82 - mattr) * 190 + gram_score * 0.45")} AS lexical, {share(S.TRANSITIONS)} AS transition, {share(S.HEDGES)} AS hedge,
  {clamp("len(list_filter(starts, lambda s: len(list_filter(starts, lambda t: t = s)) >= 2)) / greatest(1, len(starts)) * 170")} AS starts_score, {clamp(f"least(1.0, {whole_words('norm', S.IMPERSONAL)} / greatest(1.0, wc / 240) / 2.4) * 100")} AS impersonal,
  CASE WHEN len(sents) >= 6 AND marks <= 1 THEN 25 ELSE 0 END AS punctuation, {', '.join(f"({' + '.join(hits('norm', x) for x in p)}) AS m_{n}, {group(p)} AS {n}" for n, _, _, p in S.GROUPS)},
  regexp_matches(norm, {q('(?i)' + S.PLACEHOLDER)}) AS placeholder, {hits('norm', S.CITATION)} AS n_cite, {hits('norm', S.NUMBER)} AS n_number, {whole_words('norm', S.FIRST_PERSON)} AS n_first, {hits('norm', S.QUOTE)} AS n_quote,
  regexp_matches(norm, {q(f'(?i)(?:^|{OUT})(?:{ws(S.STRUCTURE)})(?:$|{OUT})')}) AS structured FROM n6),
n8 AS MATERIALIZED (SELECT * EXCLUDE (starts), starts_score AS starts FROM n7),
n9 AS MATERIALIZED (SELECT *, {clamp("n_cite * 12 + least(20.0, n_number * 2.5) + least(15.0, n_first * 3.5) + n_quote * 10 + CASE WHEN wc < 180 THEN 15 ELSE 0 END + CASE WHEN placeholder THEN 85 ELSE 0 END + CASE WHEN structured THEN 25 ELSE 0 END")} AS safeguard,
  {tops}, list_reverse_sort(list_filter([{every}], lambda x: x >= 30)) AS strong_list, len(list_filter([{every}], lambda x: x >= 12))::INT AS weak, list_sort(list_filter([{ranked}], lambda x: x.m <= -12)) AS top_list FROM n8),
na AS MATERIALIZED (SELECT *, {', '.join(f'{channel(c)} AS c_{c}' for c in S.CHANNELS)} FROM n9),
nb AS MATERIALIZED (SELECT *, {' + '.join(f'c_{c} * {w}' for c, w in S.CHANNELS.items())} AS weighted, {' + '.join(f'(c_{c} >= 14)::INT' for c in S.CHANNELS)} AS active, coalesce(list_avg(list_slice(strong_list, 1, 3)), 0) AS strong_mean FROM na),
nc AS MATERIALIZED (SELECT *, weighted * CASE WHEN active >= 3 THEN 1.1 WHEN active = 2 THEN 1.0 ELSE 0.78 END * CASE WHEN wc < 60 THEN 0.6 WHEN wc < 120 THEN 0.8 WHEN wc < 200 THEN 0.95 ELSE 1.0 END + greatest(0, len(strong_list) - 1) * 4 + greatest(0, weak - 3) * 1.5 AS raw,
  CASE WHEN leak >= 40 THEN 45.0 WHEN len(strong_list) >= 3 THEN greatest(22.0, strong_mean * 0.5) WHEN weak >= 5 THEN 12.0 WHEN weak >= 2 THEN 5.0 ELSE 0.0 END AS base FROM nb),
scored AS MATERIALIZED (SELECT *, CASE WHEN wc < 10 THEN 0 ELSE {clamp("CASE WHEN placeholder THEN least(10.0, weighted) ELSE greatest(raw, CASE WHEN gram_score > 60 THEN gram_score * 0.6 ELSE 0.0 END, base) END")} END AS probability,
  CASE WHEN wc < 10 THEN [] ELSE list_transform(top_list, lambda x: x.l || ': ' || (-x.m) || '%') END AS ranked FROM nc)"""


def style_units() -> str:
    names = ", ".join(n for n, _, _ in S.drafts())
    return f"WITH src AS (SELECT doc_id, text AS txt FROM documents), {style_ctes('src', 'doc_id')} SELECT doc_id, wc::INT AS word_count, {names}, safeguard, len(strong_list)::INT AS strong, weak, probability, array_to_string(ranked, '; ') AS ranked FROM scored"


def signals() -> str:
    seen = {"rhythm": "len(sents) >= 2", "lexical": "true", "transition": "transition > 0", "hedge": "hedge > 0", "starts": "starts > 0", "impersonal": "impersonal > 0", "punctuation": "marks > 0"}
    fill = lambda t: f"replace(replace({q(t)}, '{{cv}}', printf('%.2f', cv)), '{{mattr}}', round(mattr * 100)::INT::VARCHAR)"
    said = {n: f"CASE WHEN {n} >= {least} THEN {fill(high)} ELSE {fill(low)} END" for n, least, high, low in S.DETAILS}
    said |= {n: f"CASE WHEN m_{n} > 0 THEN replace({q(S.GROUP_DETAIL[0])}, '{{n}}', m_{n}::VARCHAR) ELSE {q(S.GROUP_DETAIL[1])} END" for n, *_ in S.GROUPS}
    rows = ", ".join(f"{{'m': -{n}, 'k': {k}, 'l': {q(S.LABELS[n])}, 'c': '{c}', 'd': {said[n]}, 'seen': {n} >= 5 OR {seen.get(n, f'{n} > 0')}}}" for k, (n, c, _) in enumerate(S.drafts()))
    last = f"{{'m': -safeguard, 'k': 99, 'l': {q(S.LABELS['safeguard'])}, 'c': 'safeguard', 'd': {q(S.SAFEGUARD_DETAIL)}, 'seen': true}}"
    return f"""WITH src AS (SELECT doc_id, text AS txt FROM documents), {style_ctes('src', 'doc_id')},
l AS (SELECT doc_id, list_append(list_sort(list_filter([{rows}], lambda x: x.seen)), {last}) AS xs FROM scored WHERE wc >= 10),
e AS (SELECT doc_id, unnest(xs) AS x, unnest(range(0, len(xs))) AS place FROM l)
SELECT doc_id, place::INT AS place, x.l AS label, x.c AS category, (-x.m)::INT AS score, x.d AS detail FROM e"""


def reasons() -> str:
    """The sentences for the reliability of verdicts."""
    by = " ".join(f"WHEN reason = {q(k)} THEN {q(v)}" for k, v in S.REASONS.items()) + " " + " ".join(f"WHEN percent = {k} THEN {q(v)}" for k, v in S.LANGUAGE_REASONS.items())
    left = "code_words + quoted_words + reference_words"
    return f"WITH {verdict_ctes()} SELECT doc_id, CASE {by} END || CASE WHEN {left} > 0 AND word_count >= 80 THEN replace({q(S.LEFT_OUT)}, '{{n}}', ({left})::VARCHAR) ELSE '' END AS reason FROM judged"


def prose_ctes(source: str, keys: str) -> str:
    """CTEs from source(keys, raw) to `prosed`: prose, code_words, code_blocks."""
    t = "regexp_replace(line, '^" + T.WS + "+|" + T.WS + "+$', '', 'g')"
    dense = rf"len(regexp_extract_all({t}, '[{{}}()\[\];=<>`|]')) / greatest(1, length({t})) > 0.16"
    any_ = " OR ".join(f"regexp_matches(line, {q(ws(p))})" for p in prep.CODE_LINES)
    code = f"{t} <> '' AND ({any_} OR regexp_matches({t}, {q(ws(prep.ASSIGNMENT))}) OR ({dense} AND NOT regexp_matches({t}, '[А-Яа-яІіЇїЄєҐґ]{{3,}}')))"
    out = f"""l0 AS (SELECT {keys}, string_split(replace(coalesce(raw, ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM {source}),
l1 AS MATERIALIZED (SELECT {keys}, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l0),
l2 AS (SELECT *, regexp_matches(line, {q(ws(prep.FENCE))}) AS fence, {code} AS looks FROM l1),
l3 AS (SELECT *, (sum(fence::INT) OVER (PARTITION BY {keys} ORDER BY i)) % 2 = 1 AS inside FROM l2),
l4 AS (SELECT *, looks AND NOT fence AND NOT inside AS code FROM l3),
l5 AS (SELECT *, coalesce(lag(code) OVER w, false) AS before, coalesce(lead(code) OVER w, false) AS after FROM l4 WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
l6 AS (SELECT *, code AND (before OR after OR regexp_matches(line, {q(ws(prep.SURE))})) AS goes FROM l5),
l7 AS (SELECT {keys}, coalesce(string_agg(line, ' ' ORDER BY i) FILTER (NOT fence AND NOT inside AND NOT goes), '') AS p0, coalesce(string_agg(line, ' ' ORDER BY i) FILTER (NOT fence AND (inside OR goes)), '') AS gone,
  count(*) FILTER (goes AND NOT before) + ceil(count(*) FILTER (fence) / 2) AS blocks FROM l6 GROUP BY ALL),
i0 AS (SELECT {keys}, p0, {count_words('gone')} AS w0, blocks FROM l7)"""
    for k, p in enumerate(prep.INLINE):
        found = f"list_transform(regexp_extract_all(p{k}, {q(ws(p))}), lambda x: {count_words('x')})"
        out += f",\ni{k + 1} AS (SELECT {keys}, regexp_replace(p{k}, {q(ws(p))}, ' ', 'g') AS p{k + 1}, w{k} + coalesce(list_sum({found}), 0) AS w{k + 1}, blocks FROM i{k})"
    n = len(prep.INLINE)
    return out + f",\nprosed AS MATERIALIZED (SELECT {keys}, {norm(f'p{n}')} AS prose, w{n}::INT AS code_words, blocks::INT AS code_blocks FROM i{n})"


def prepared_ctes() -> str:
    """CTEs to `ready`(doc_id, lang, text, analyzed_words, code_words, quoted_words, reference_words)."""
    tail = r"(?:список\s+(?:використаних\s+)?джерел|бібліографія|references|bibliography)"
    marker = f"(?is)^(.*?(?:^|{OUT})){ws(tail)}(?:$|{OUT})"
    marker = marker.replace("^(.*?(?:^|", "^((?:.*?" + OUT + ")?").replace(OUT + ")?" + OUT + "))", OUT + ")?)")
    return f"""r0 AS (SELECT doc_id, lang, coalesce(text, '') AS t0, regexp_matches(coalesce(text, ''), {q(marker)}) AS marked, length(regexp_extract(coalesce(text, ''), {q(marker)}, 1)) AS pos FROM documents),
r1 AS MATERIALIZED (SELECT doc_id, lang, t0, CASE WHEN marked AND pos >= length(t0) * 0.45 THEN substr(t0, 1, pos) ELSE t0 END AS t1 FROM r0),
r2 AS (SELECT doc_id, lang, regexp_replace(t1, {q(prep.LONG_QUOTE)}, ' ', 'g') AS raw, coalesce(list_sum(list_transform(regexp_extract_all(t1, {q(prep.LONG_QUOTE)}), lambda x: {count_words('x')})), 0)::INT AS quoted_words, {count_words('substr(t0, length(t1) + 1)')}::INT AS reference_words FROM r1),
{prose_ctes('r2', 'doc_id')},
ready AS MATERIALIZED (SELECT doc_id, lang, prose AS text, {count_words('prose')}::INT AS analyzed_words, code_words, quoted_words, reference_words FROM prosed JOIN r2 USING (doc_id))"""


def verdict_ctes() -> str:
    """CTEs to `judged`, as `stylometry.ensemble` has it."""
    code = "CASE WHEN length(text) < 50 THEN 'limited' WHEN lang IN ('uk', 'en') THEN lang WHEN lang = 'ru' THEN 'limited' WHEN total > 0 AND cyr / total >= 0.18 AND lat / total >= 0.18 THEN 'mixed' ELSE 'limited' END"
    percent = "CASE WHEN length(text) < 50 THEN 0 WHEN lang IN ('uk', 'en') THEN 95 WHEN lang = 'ru' THEN 30 WHEN total > 0 AND cyr / total >= 0.18 AND lat / total >= 0.18 THEN round((cyr + lat) / total * 100) ELSE 35 END"
    return f"""{prepared_ctes()},
v0 AS (SELECT *, len(regexp_extract_all(text, '\\p{{L}}{{2,}}')) AS total, len(regexp_extract_all(text, '\\p{{Cyrillic}}{{2,}}')) AS cyr, len(regexp_extract_all(text, '\\p{{Latin}}{{2,}}')) AS lat FROM ready),
v1 AS MATERIALIZED (SELECT *, {code} AS language, ({percent})::INT AS percent, {words('text')} AS w FROM v0),
v2 AS (SELECT doc_id, w, CASE WHEN len(w) <= 220 THEN [0] ELSE list_append(list_filter(range(0, len(w) + 1, 165), lambda x: x + 220 < len(w)), len(w) - 220) END AS ss FROM v1 WHERE len(w) > 0),
v3 AS (SELECT doc_id, w, unnest(ss) AS st, unnest(range(0, len(ss))) AS i FROM v2),
src AS (SELECT doc_id, -1 AS i, 0 AS st, 0 AS en, text AS txt FROM v1 UNION ALL SELECT doc_id, i, st + 1, least(st + 220, len(w)), array_to_string(list_slice(w, st + 1, st + 220), ' ') FROM v3),
{style_ctes('src', 'doc_id, i, st, en, txt')},
u AS (SELECT *, CASE WHEN length(txt) > 280 THEN rtrim(substr(txt, 1, 277)) || '…' ELSE txt END AS excerpt, i >= 0 AND probability >= 18 AND len(ranked) > 0 AS seen FROM scored),
g AS (SELECT doc_id, max(probability) FILTER (i < 0) AS doc, max(wc) FILTER (i < 0) AS wc, max(len(strong_list)) FILTER (i < 0) AS strong, coalesce(list_sort(list(probability) FILTER (i >= 0)), []) AS ws,
  coalesce(list({{'index': i, 'start_word': st, 'end_word': en, 'score': probability, 'excerpt': excerpt, 'evidence': list_slice(ranked, 1, 4)}} ORDER BY probability DESC, i) FILTER (seen), []) AS segs FROM u GROUP BY doc_id),
j AS (SELECT *, len(ws) AS n, coalesce(ws[1], 0) AS low, coalesce(ws[-1], 0) AS high, coalesce(list_avg(list_slice(list_reverse(ws), 1, 3)), 0) AS mean3 FROM g),
k AS (SELECT *, CASE WHEN n <= 1 THEN doc ELSE {clamp("greatest(doc * 0.36 + ws[greatest(1, ceil(n * 0.5)::INT)] * 0.14 + ws[greatest(1, ceil(n * 0.75)::INT)] * 0.20 + mean3 * 0.22 + len(list_filter(ws, lambda x: x >= 35)) / n * 100 * 0.08, CASE WHEN high >= 35 THEN high * 0.56 WHEN mean3 >= 24 THEN mean3 * 0.48 ELSE 0.0 END)")} END AS p, high - low AS spread FROM j),
m AS (SELECT k.*, language, percent, code_words, quoted_words, reference_words FROM k JOIN v1 USING (doc_id)),
o AS (SELECT *, least({clamp(f"{clamp('least(1.0, greatest(0, wc - 60) / 740) * 100')} * 0.42 + {clamp('least(1.0, n / 6) * 100')} * 0.2 + {clamp('100 - least(100.0, spread * 1.45)')} * 0.23 + {clamp('least(1.0, strong / 4) * 100')} * 0.15")},
  CASE WHEN wc < 80 THEN 18 WHEN wc < 120 THEN 30 WHEN wc < 240 THEN 48 ELSE 100 END, CASE language WHEN 'limited' THEN 28 WHEN 'mixed' THEN 58 ELSE 100 END)::INT AS reliability FROM m),
judged AS (SELECT doc_id, wc::INT AS word_count, p::INT AS probability, CASE WHEN wc < 80 THEN 'insufficient' WHEN language = 'limited' THEN 'uncertain' WHEN coalesce(ws[-1], p) >= 35 AND coalesce(ws[1], p) <= 28 AND coalesce(ws[-1], p) - coalesce(ws[1], p) >= 28 THEN 'mixed' WHEN p >= 70 THEN 'high' WHEN p >= 45 THEN 'elevated'
  WHEN reliability < 45 OR p >= 12 OR len(segs) > 0 THEN 'uncertain' ELSE 'low' END AS verdict, reliability, CASE WHEN reliability >= 72 THEN 'high' WHEN reliability >= 45 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN wc < 80 THEN 'short' WHEN language = 'limited' THEN 'language' WHEN wc < 120 THEN 'unsteady' WHEN spread >= 45 THEN 'mixed-origin' WHEN n < 3 THEN 'few-segments' WHEN reliability >= 72 THEN 'agreed' ELSE 'moderate' END AS reason,
  language, percent, code_words, quoted_words, reference_words, n::INT AS windows, spread::INT AS spread, segs FROM o)"""


def rewritten() -> str:
    """The rules one after the other; those with Unicode boundaries take the neighbouring characters along."""
    a, z = rewrite.A, rewrite.Z
    par = "list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '\\n{2,}'), lambda p: " + norm("p") + "), lambda p: p <> '')"
    out = f"""WITH w0 AS (SELECT doc_id, array_to_string({par}, chr(10) || chr(10)) AS original FROM documents),
x0 AS MATERIALIZED (SELECT doc_id, original, {count_words('original')} AS ow, original AS t FROM w0 WHERE {count_words('original')} >= 20)"""
    k, sums = 0, []
    for name, parts in [*rewrite.RULES, ("transitions", rewrite.SOFT)]:
        cols = []
        for p, to in parts:
            flags = "" if name == "transitions" else "(?i)"
            p = p.replace(a, r"\b").replace(z, r"\b")
            lead, trail = rewrite.L in p, rewrite.R in p
            core = p.replace(rewrite.L, "").replace(rewrite.R, "")
            to2 = to.replace("$", "\\")
            if lead or trail:
                to2 = "\\1" + to.replace("$1", "\\2") + ("\\3" if "$1" in to else "\\2")
                core = f"(^|{OUT})(?:{core})($|{OUT})"
            full = q(flags + (core if lead or trail else f"(?:{core})").replace(r"[.!?\s]", "[.!?" + T.WS[1:-1] + "]").replace(r"\s", T.WS))
            cols.append(f"n{k}")
            carried = "".join(f", {c}" for _, cs in sums for c in cs) + "".join(f", {c}" for c in cols[:-1])
            out += f",\nx{k + 1} AS MATERIALIZED (SELECT doc_id, original, ow{carried}, len(regexp_extract_all(t, {full})) AS n{k}, regexp_replace(t, {full}, {q(to2)}, 'g') AS t FROM x{k})"
            k += 1
        sums.append((name, cols))
    key = rf"{norm(chr(120))}".replace("coalesce(x, '')", rf"regexp_replace(regexp_replace(lower(x), '[0-9]+', '#', 'g'), '[^\p{{L}}\p{{N}}#{T.WS[1:-1]}]', ' ', 'g')")
    trimmed = f"regexp_replace(x, '^{T.WS}+|{T.WS}+$', '', 'g')"
    counts = ", ".join(f"CASE WHEN {' + '.join(cs)} > 0 THEN '{name}:' || ({' + '.join(cs)}) END" for name, cs in sums)
    return out + f""",
s0 AS (SELECT *, regexp_split_to_array(t, '\\n{{2,}}') AS ps FROM x{k}), s1 AS (SELECT *, unnest(ps) AS par, unnest(range(0, len(ps))) AS pi FROM s0),
s2 AS (SELECT *, CASE WHEN len(regexp_extract_all(par, '{rewrite.SENTENCE}')) > 0 THEN list_transform(regexp_extract_all(par, '{rewrite.SENTENCE}'), lambda x: {trimmed}) ELSE [regexp_replace(par, '^{T.WS}+|{T.WS}+$', '', 'g')] END AS ss FROM s1),
s3 AS MATERIALIZED (SELECT *, list_transform(ss, lambda x: {key}) AS ks FROM s2),
s4 AS (SELECT *, list_filter(range(1, len(ss) + 1), lambda i: len(string_split(ks[i], ' ')) < 7 OR list_position(ks, ks[i]) = i) AS keep FROM s3),
s5 AS (SELECT *, array_to_string(list_transform(keep, lambda i: ss[i]), ' ') AS kept, len(ss) - len(keep) AS gone FROM s4),
s6 AS (SELECT *, trim(regexp_replace(regexp_replace({norm('kept')}, '\\s+([,.;:!?])', '\\1', 'g'), ',\\s*,', ',', 'g')) AS tidy FROM s5 WHERE kept <> ''),
s7 AS (SELECT doc_id, coalesce(string_agg(tidy, chr(10) || chr(10) ORDER BY pi) FILTER (tidy <> ''), '') AS revised, sum(gone) AS repeats FROM s6 GROUP BY doc_id)
SELECT doc_id, coalesce(revised, '') AS revised, array_to_string(list_filter([{counts}, CASE WHEN repeats > 0 THEN 'repeats:' || repeats END], lambda x: x IS NOT NULL), ', ') AS changes, ow::INT AS original_words, {count_words("coalesce(revised, '')")}::INT AS revised_words FROM x{k} LEFT JOIN s7 USING (doc_id)"""


def probes(deep: bool = False) -> str:
    from inkspan.operators.probe import SHAPES

    size, phrases, keys = SHAPES[deep]
    bare = lambda x: rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}''-]', '', 'g')"
    tell = lambda x: f"(length({x}) >= 7 OR regexp_matches({x}, '[0-9]'))"
    return f"""WITH {chunk_ctes()},
a AS MATERIALIZED (SELECT doc_id, chunk_index, cws AS w, len(cws) AS n FROM chunk),
s AS (SELECT *, unnest(range(0, greatest(0, n - {size}) + 1, {max(5, size // 2)})) AS st FROM a),
p AS (SELECT *, list_slice(w, st + 1, st + {size}) AS ph, least(3, floor(st / greatest(1, n - {size}) * 4))::INT AS bucket FROM s),
o AS MATERIALIZED (SELECT *, list_filter(list_transform(ph, lambda x: {bare('lower(x)')}), lambda x: x <> '') AS own FROM p WHERE len(ph) >= {min(7, size)}),
c AS (SELECT doc_id, chunk_index, st, bucket, array_to_string(ph, ' ') AS phrase, len(list_distinct(own)) / greatest(1, len(own)) * 10 + len(list_filter(own, lambda x: {tell('x')})) * 1.8 + coalesce(list_sum(list_transform(own, lambda x: length(x))), 0) / greatest(1, len(own)) AS score FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index, bucket ORDER BY score DESC, st) AS k FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index, lower(phrase) ORDER BY score DESC, bucket) AS again FROM b WHERE k = 1),
e AS (SELECT doc_id, chunk_index, list('"' || phrase || '"' ORDER BY score DESC, bucket) AS exact FROM f WHERE again = 1 GROUP BY ALL),
d AS (SELECT doc_id, chunk_index, w, n, list_filter(list_transform(w, lambda x: {bare('x')}), lambda x: {tell('x')}) AS ks FROM a),
d2 AS (SELECT *, list_filter(range(1, len(ks) + 1), lambda i: list_position(ks, ks[i]) = i) AS firsts FROM d),
d3 AS (SELECT *, list_sort(list_transform(firsts, lambda i: {{'m': -length(ks[i]), 'i': i, 'x': ks[i]}})) AS sorted FROM d2),
h AS (SELECT doc_id, chunk_index, list_concat(list_slice(coalesce(exact, []), 1, {phrases}), [array_to_string(list_transform(list_slice(sorted, 1, {keys}), lambda t: t.x), ' '), '"' || array_to_string(CASE WHEN n <= 22 THEN w ELSE list_slice(w, n // 2 - 10, n // 2 + 11) END, ' ') || '"']) AS qs FROM d3 LEFT JOIN e USING (doc_id, chunk_index)),
l AS (SELECT doc_id, chunk_index, list_filter(qs, lambda x: length(trim(replace(x, '"', ''))) > 20) AS qs FROM h),
r AS (SELECT doc_id, chunk_index, list_transform(list_filter(range(1, len(qs) + 1), lambda i: list_position(qs, qs[i]) = i), lambda i: qs[i]) AS qs FROM l)
SELECT doc_id, chunk_index, unnest(range(0, len(qs)))::INT AS place, unnest(qs) AS query FROM r"""
