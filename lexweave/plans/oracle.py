"""The queries as DuckDB SQL over the same tables, written independently of the Spark plans: tokens as rows, k-grams as
window functions. Word lists and character tables are the engine's constants."""

from __future__ import annotations

from lexweave.functions import normalize as N
from lexweave.functions import tokens as T
from lexweave.plans import fixtures, queries


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(text(v) for v in values)


def rows(values, *names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join('NULL' if v is None else text(v) if isinstance(v, str) else str(v) for v in row) + ')' for row in values)}) AS v({', '.join(names)})"


def translate(column: str, source: str, target: str) -> str:
    return f"translate({column}, {text(source)}, {text(target)})"


def letters(column: str) -> str:
    folded = translate(column, N.LATIN + N.YO + N.DIGITS, N.CYRILLIC + N.YO_FOLDED + N.DIGIT_LETTERS)
    return rf"regexp_replace({folded}, '(^|[^\p{{L}}\p{{N}}_])3', '\1З', 'g')"


def accents(column: str) -> str:
    return translate(f"strip_accents({translate(column, 'йЙ', chr(0xE000) + chr(0xE001))})", chr(0xE000) + chr(0xE001), "йЙ")


def invisible(column: str) -> str:
    return translate(column, N.INVISIBLE, "")


def blanked(column: str, chars: str) -> str:
    chars = "".join(dict.fromkeys(chars))
    return translate(column, chars, " " * len(chars))


def norm(column: str) -> str:
    return invisible(letters(accents(f"coalesce({column}, '')")))


def tag(column: str) -> str:
    cases = [f"WHEN regexp_matches({column}, {text(T._SYMBOLS)}) THEN 'SYM'", rf"WHEN NOT regexp_matches({column}, '[\p{{L}}\p{{N}}]') THEN 'PUNCT'", rf"WHEN regexp_matches({column}, '^\p{{N}}+$') THEN 'NUM'"]
    cases += [f"WHEN lower({column}) IN ({listed(words)}) THEN '{name}'" for name, words in T.closed_class().items() if words]
    return f"CASE {' '.join(cases)} ELSE 'NOUN' END"


def key(token: str) -> str:
    return f"lower({translate(token, N.YO, N.YO_FOLDED)})"


def lemma(token: str, pos: str, known: str | None = None) -> str:
    folded = f"lower(coalesce({known}, {translate(token, N.YO, N.YO_FOLDED)}))" if known else key(token)
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in queries.ANALYZER.replacements.items())
    return f"CASE WHEN regexp_matches({token}, {text(T.ALPHA)}) AND {pos} NOT IN ({listed(T.BANNED)}) THEN CASE {folded} {cases} ELSE {folded} END END"


#: A text as rows (doc, segment, block, text) becomes tok: doc, segment, block, i, text, pos, lemma, start, end.
def tokens(source: str, lexicon: bool = False) -> str:
    tagged = f"SELECT tk.*, coalesce(lex.pos, {tag('text')}) AS pos, lex.lemma AS known FROM tk LEFT JOIN lex ON lex.form = {key('text')}" if lexicon else f"SELECT *, {tag('text')} AS pos FROM tk"
    return rf"""{lexicon_clauses() + ',' if lexicon else ''}
src AS ({source}),
pieces AS (SELECT doc, segment, block, regexp_extract_all({norm('text')}, {text(T.PIECE)}) AS l FROM src),
pc AS (SELECT doc, segment, block, unnest(l) AS text, generate_subscripts(l, 1) AS nr FROM pieces),
pe AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY doc, block ORDER BY nr) AS INT) AS "end" FROM pc),
tk AS (SELECT doc, segment, block, text, "end" - length(text) AS start, "end", CAST(row_number() OVER (PARTITION BY doc, block ORDER BY nr) - 1 AS INT) AS i FROM pe WHERE regexp_matches(text, '\S')),
tp AS ({tagged}),
tok AS (SELECT *, {lemma('text', 'pos', 'known' if lexicon else None)} AS lemma, regexp_matches(text, '[{T.HYPHENS}]') AS inner_hyphen,
  coalesce(lag(pos = 'PUNCT' AND text IN ({listed(T.HYPHENS)})) OVER (PARTITION BY doc, block ORDER BY i), false) AS hyph_left,
  coalesce(lead(pos = 'PUNCT' AND text IN ({listed(T.HYPHENS)})) OVER (PARTITION BY doc, block ORDER BY i), false) AS hyph_right,
  sum(CASE WHEN pos <> 'PUNCT' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, block ORDER BY i) AS np FROM tp)"""


WHOLE = "SELECT doc_id AS doc, lang AS segment, 0 AS block, text FROM documents"
BY_SOURCE = "SELECT doc_id AS doc, source AS segment, 0 AS block, text FROM documents"
BLOCKS = "SELECT doc, segment, CAST(block - 1 AS INT) AS block, text FROM (SELECT doc_id AS doc, lang AS segment, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS block FROM documents)"

#: term_id, term, pattern, k.
def patterns(terms=fixtures.TERMS, lexicon: bool = False) -> str:
    lemmas = f"SELECT term_id, term, i, {lemma('x', f'coalesce(lex.pos, {tag('x')})', 'lex.lemma')} AS lemma FROM tu LEFT JOIN lex ON lex.form = {key('x')}" if lexicon else f"SELECT term_id, term, i, {lemma('x', tag('x'))} AS lemma FROM tu"
    return rf"""
tt AS (SELECT term_id, term, regexp_extract_all({norm('term')}, {text(T.TOKEN)}) AS l FROM {rows(terms, 'term_id', 'term')}),
tu AS (SELECT term_id, term, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM tt),
tl AS ({lemmas}),
pat AS (SELECT tt.term_id, tt.term, coalesce(string_agg(lemma, ' ' ORDER BY i), '') AS pattern, CAST(count(lemma) AS INT) AS k FROM tt LEFT JOIN tl USING (term_id, term) GROUP BY tt.term_id, tt.term)"""


PATTERNS = patterns()

#: hits: doc, segment, block, k, pattern, first_tok, last_tok, start, end, hyphen.
def hits(soft: bool = False) -> str:
    def of(k: int) -> str:
        lead = lambda c, j: c if not j else f"lead({c}, {j}) OVER w"
        pattern = " || ' ' || ".join(lead("lemma", j) for j in range(k))
        gap = f"{lead('np', k - 1)} - np" if soft else f"{lead('i', k - 1)} - i"
        return f"SELECT doc, segment, block, {k} AS k, {pattern} AS pattern, i AS first_tok, {lead('i', k - 1)} AS last_tok, start, {lead('\"end\"', k - 1)} AS \"end\", {gap} AS gap, {'hyph_left OR hyph_right OR inner_hyphen' if k == 1 else 'false'} AS hyphen FROM tok WHERE lemma IS NOT NULL WINDOW w AS (PARTITION BY doc, block ORDER BY i)"

    grams = " UNION ALL ".join(of(k) for k in (1, 2, 3))
    return f"grams AS ({grams}), hits AS (SELECT grams.* FROM grams SEMI JOIN pat ON grams.pattern = pat.pattern AND grams.k = pat.k AND pat.pattern <> '' WHERE gap = grams.k - 1)"


def matched(source: str = WHOLE, soft: bool = False, terms=fixtures.TERMS, lexicon: bool = False) -> str:
    return f"WITH {tokens(source, lexicon)}, {patterns(terms, lexicon)}, {hits(soft)}"


def counts(condition: str, source: str = WHOLE, soft: bool = False) -> str:
    return f"{matched(source, soft)} SELECT segment, pattern, count(*) AS cnt FROM hits WHERE {condition} GROUP BY segment, pattern"


def frequency(source: str, segments: str, **options) -> str:
    """segments: SQL of one column, segment."""
    return f"""{matched(source, **options)}, cnt AS (SELECT segment, pattern, count(*) AS c FROM hits GROUP BY ALL),
tot AS (SELECT segment, greatest(1, count(lemma)) AS n FROM tok GROUP BY segment),
freq AS (SELECT term_id, term, pat.pattern, s.segment, coalesce(c, 0) AS cnt, coalesce(c, 0) / CAST(coalesce(tot.n, 1) AS DOUBLE) * 1000000 AS ipm
  FROM pat CROSS JOIN ({segments}) s LEFT JOIN cnt ON cnt.segment = s.segment AND cnt.pattern = pat.pattern LEFT JOIN tot ON tot.segment = s.segment)"""


def named(segments) -> str:
    return f"SELECT unnest([{listed(segments)}]) AS segment"


def wide(source: str, segments) -> str:
    columns = [f"CAST(sum(cnt) FILTER (segment = {text(s)}) AS BIGINT) AS cnt_{s}" for s in segments] + [f"sum(ipm) FILTER (segment = {text(s)}) AS ipm_{s}" for s in segments]
    return f"{frequency(source, named(segments))} SELECT term_id, term, {', '.join(columns)} FROM freq GROUP BY term_id, term"


DOCS = "docs AS (SELECT doc, list(text ORDER BY i) AS l FROM tok GROUP BY doc)"
RANKED = f"ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY segment, pattern ORDER BY doc, first_tok, last_tok) AS INT) AS match_no FROM hits) WHERE match_no <= {queries.CAP})"
SURFACE = "array_to_string(list_slice(l, first_tok + 1, last_tok + 1), ' ')"


def around(first: str, last: str, window: int) -> str:
    return f"array_to_string(list_slice(l, greatest({first} - {window}, 0) + 1, {last} + {window} + 1), ' ')"


TERMS_OF = "terms AS (SELECT pattern, string_agg(term, ' | ' ORDER BY term_id) AS terms FROM pat WHERE pattern <> '' GROUP BY pattern)"
MERGED = """marked AS (SELECT DISTINCT doc, block, start, "end" FROM hits),
m1 AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY doc, block ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS nw FROM marked),
m2 AS (SELECT *, sum(nw) OVER (PARTITION BY doc, block ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isl FROM m1),
merged AS (SELECT doc, block, min(start) AS start, max("end") AS "end" FROM m2 GROUP BY doc, block, isl)"""
RUNS = f"""nt AS (SELECT doc, block, {norm('text')} AS t FROM src),
cutp AS (SELECT doc, block, 0 AS p FROM nt UNION SELECT doc, block, length(t) FROM nt UNION SELECT doc, block, start FROM merged UNION SELECT doc, block, "end" FROM merged),
seg AS (SELECT doc, block, p AS a, lead(p) OVER (PARTITION BY doc, block ORDER BY p) AS b FROM cutp),
runs AS (SELECT seg.doc, seg.block, a, substring(t, a + 1, b - a) AS text, EXISTS (SELECT 1 FROM merged m WHERE m.doc = seg.doc AND m.block = seg.block AND m.start = a) AS is_term FROM seg JOIN nt ON nt.doc = seg.doc AND nt.block = seg.block WHERE b > a)"""

def decision(forms) -> str:
    """id and corrected lemma of (token, lemma, parses, parses of the lemma), as nested list functions."""
    parse = lambda p: f"{{'word': {text(p[0])}, 'nf': {text(p[1])}, 'tags': [{listed(p[2].split())}], 'score': {p[3]}}}"
    array = lambda ps: f"CAST([{', '.join(map(parse, ps))}] AS STRUCT(word VARCHAR, nf VARCHAR, tags VARCHAR[], score DOUBLE)[])"
    source = " UNION ALL ".join(f"SELECT {i} AS id, {text(t)} AS token, {text(le)} AS lemma, {array(a)} AS tp, {array(b)} AS lp" for i, (t, le, a, b) in enumerate(forms))
    has = lambda p, x: f"list_contains({p}.tags, '{x}')"

    def form(ps: str, other: str) -> str:
        full = f"list_filter({ps}, lambda p: ({has('p', 'ADJF')} AND NOT {has('p', 'ADJS')}) OR ({has('p', 'PRTF')} AND NOT {has('p', 'PRTS')}))[1].nf"
        verb = f"list_filter({ps}, lambda p: {has('p', 'VERB')} AND {has('p', 'impf')})[1].nf"
        best = f"{ps}[1]"
        return f"CASE WHEN {has(best, 'ADJS')} OR {has(best, 'PRTS')} THEN coalesce({full}, {best}.nf) WHEN {has(best, 'VERB')} THEN coalesce({verb}, {best}.nf) ELSE {other} END"

    lemma_ = f"CASE WHEN len(lp) = 0 OR lp[1].score < 0 OR lower(lemma) = lower(token) THEN CASE WHEN len(tp) > 0 THEN {form('tp', 'tp[1].nf')} ELSE token END ELSE {form('lp', 'lemma')} END"
    return f"SELECT CAST(id AS BIGINT) AS id, {translate(lemma_, N.YO, N.YO_FOLDED)} AS lemma FROM ({source})"


def lexicon_clauses() -> str:
    """lex: form, pos, lemma of the inline lexicon, and what the first parse of the lemma says: n_parses, score, proper."""
    parses = {form: own for form, _, _, own in fixtures.LEXICON}
    forms = [(form, raw or form, own, parses.get(raw or form, ())) for form, _, raw, own in fixtures.LEXICON]
    first = [(form, len(own), own[0][3] if own else None, int(bool(own) and bool({"Geox", "Name", "Surn"} & {*own[0][2].split()}))) for form, _, _, own in fixtures.LEXICON]
    listing = rows([(i, form, pos) for i, (form, pos, _, _) in enumerate(fixtures.LEXICON)], "id", "form", "pos")
    return f"""
fixed AS ({decision(forms)}),
best AS (SELECT {key(norm('form'))} AS form, n_parses, score, proper FROM {rows(first, 'form', 'n_parses', 'score', 'proper')}),
lex AS (SELECT {key(norm('f.form'))} AS form, pos, {norm('fixed.lemma')} AS lemma, n_parses, score, proper
  FROM (SELECT * FROM {listing}) f JOIN fixed USING (id) LEFT JOIN best ON best.form = {key(norm('fixed.lemma'))})"""


def lists() -> str:
    """lemmas: doc, i and the lemma of each token under three rules, null for tokens left out."""
    clean = blanked(letters(invisible(accents("coalesce(text, '')"))), N.SPECIAL_FULL)
    banned = f"coalesce(lex.pos, {tag('x')}) IN ({listed(T.BANNED)})"
    replaced_ = lambda x: f"CASE {x} {' '.join(f'WHEN {text(k)} THEN {text(v)}' for k, v in queries.ANALYZER.replacements.items())} ELSE {x} END"
    title = "upper(left(lex.lemma, 1)) || lower(substring(lex.lemma, 2))"
    keeps = f"lex.score > 0 AND NOT {banned}"
    return f"""{lexicon_clauses()},
pw AS (SELECT doc_id, regexp_extract_all({clean}, {text(T.TOKEN)}) AS l FROM documents),
px AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM pw),
lemmas AS (SELECT doc_id, i,
  CASE WHEN {keeps} AND proper = 0 THEN {replaced_('lower(lex.lemma)')} END AS standard,
  CASE WHEN {keeps} THEN {replaced_(f"(CASE WHEN proper = 1 THEN {title} ELSE lower(lex.lemma) END)")} END AS titled
  FROM px LEFT JOIN lex ON lex.form = {key('x')}),
lists AS (SELECT doc_id, coalesce(string_agg(standard, ' ' ORDER BY i), '') AS standard, coalesce(string_agg(titled, ' ' ORDER BY i), '') AS titled FROM lemmas GROUP BY doc_id),
every AS (SELECT doc_id, coalesce(standard, '') AS standard, coalesce(titled, '') AS titled FROM documents LEFT JOIN lists USING (doc_id))"""


WORD_CHARS = r"\p{L}\p{N}_"


def filtered(joined: str) -> str:
    """The words that the lemma filter leaves of a text, without word boundaries: each rule blanks whole runs of word
    characters."""
    blank = f"regexp_matches(w, '^[a-zA-Z]+$') OR regexp_matches(w, '^[{WORD_CHARS}]{{1,2}}$') OR regexp_matches(lower(w), '^(?:{N.MONTHS})$')"
    runs = f"list_transform(regexp_extract_all({joined}, '[{WORD_CHARS}]+|[^{WORD_CHARS}]'), lambda w: CASE WHEN {blank} THEN ' ' ELSE regexp_replace(w, '^3', 'З') END)"
    return words(f"array_to_string({runs}, '')")


def words(column: str) -> str:
    return f"regexp_extract_all({column}, '[{WORD_CHARS}]+(?:[-''.][{WORD_CHARS}]+)*|[^\\s{WORD_CHARS}]')"


def simple(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM documents"


SQL: dict[str, str] = {
    "normalize_letters": simple(letters("text")),
    "strip_invisible": simple(invisible("text")),
    "remove_accents": simple(accents("text")),
    "normalize_tokens": simple(invisible(letters(accents("text")))),
    "remove_chars": simple(blanked("text", ".,!aeiou")),
    "remove_special": simple(blanked("text", N.SPECIAL_FULL)),
    "remove_special_soft": simple(blanked("text", N.SPECIAL_SOFT)),
    "filter_latin_months_short": f"SELECT doc_id, array_to_string({filtered("array_to_string(string_split_regex('мая клетка я он 3вук xiv ' || " + letters('text') + ", '\\s+'), ' ')")}, ' ') AS words FROM documents",
    "stopword_filter": f"SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w NOT IN ({listed(fixtures.STOPWORDS)})), ' ') AS words FROM documents",
    "preprocess_tokens": f"SELECT doc_id, array_to_string(list_filter(string_split_regex({blanked(letters(invisible(accents('text'))), N.SPECIAL_FULL)}, '\\s+'), lambda w: w <> ''), ' ') AS words FROM documents",
    "tokens_offsets": f'WITH {tokens(WHOLE)} SELECT doc AS doc_id, i AS tok_idx, text, CAST(start AS INT) AS start, "end" FROM tok',
    "token_flags": f"WITH {tokens(WHOLE)} SELECT segment, pos, count(*) AS n, count(lemma) AS n_words, count(*) FILTER (inner_hyphen) AS n_inner_hyphen FROM tok GROUP BY segment, pos",
    "pos_filter_words": f"WITH {tokens(WHOLE)}, l AS (SELECT doc, count(*) AS n, string_agg(lemma, ' ' ORDER BY i) AS s FROM tok WHERE lemma IS NOT NULL GROUP BY doc) SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(s, '') AS lemmas FROM documents LEFT JOIN l ON doc = doc_id",
    "hyphen_neighbors": f"WITH {tokens(WHOLE)} SELECT doc AS doc_id, i AS tok_idx, lemma, hyph_left, hyph_right, inner_hyphen FROM tok WHERE lemma IS NOT NULL AND (hyph_left OR hyph_right OR inner_hyphen)",
    "hyphen_tokens": f"WITH {tokens(WHOLE)} SELECT doc AS doc_id, count(*) AS n FROM tok WHERE pos = 'PUNCT' AND text IN ({listed(T.HYPHENS)}) GROUP BY doc",
    "lemma_replacements": f"WITH {tokens(WHOLE)} SELECT segment, lower({translate('text', N.YO, N.YO_FOLDED)}) AS raw, lemma, count(*) AS n FROM tok WHERE lemma IS NOT NULL AND lower({translate('text', N.YO, N.YO_FOLDED)}) IN ({listed(queries.ANALYZER.replacements)}) GROUP BY ALL",
    "replacement_lines": f"WITH l AS (SELECT i, trim(line[:instr(line, ':') - 1]) AS key, trim(line[instr(line, ':') + 1:]) AS value FROM {rows(list(enumerate(fixtures.REPLACEMENT_LINES)), 'i', 'line')} WHERE contains(line, ':')) SELECT key, max_by(value, i) AS value FROM l GROUP BY key",
    "stopword_lines": f"SELECT word FROM {rows([(w,) for w in fixtures.STOPWORDS], 'word')} UNION SELECT lang FROM documents",
    "lemma_decision": decision(fixtures.PARSES),
    "lemma_table": f"WITH {lexicon_clauses()} SELECT form, pos, lemma, CAST(n_parses AS INT) AS n_parses FROM lex",
    "lemma_counts": f"{frequency(WHOLE, named(fixtures.SEGMENTS), terms=fixtures.LEMMA_TERMS, lexicon=True)} SELECT CAST(term_id AS BIGINT) AS term_id, term, pattern, segment, cnt, ipm FROM freq",
    "lemmatize_lists": f"WITH {lists()} SELECT doc_id, standard, titled, standard AS without_proper FROM every",
    "preprocess_standard": f"WITH {lists()} SELECT doc_id, array_to_string(list_filter({filtered('standard')}, lambda w: w NOT IN ({listed(N.fold(w) for w in fixtures.PREPROCESS_STOPWORDS)})), ' ') AS words FROM every",
    "preprocess_minimal": f"WITH {lists()} SELECT doc_id, array_to_string({words('standard')}, ' ') AS words FROM every",
    "numeric_or_zero": "SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '([0-9]*)$', 1) AS DOUBLE), 0) AS tail, coalesce(TRY_CAST(url AS DOUBLE), 0) AS url FROM pages",
    "term_patterns": f"WITH {PATTERNS} SELECT CAST(term_id AS BIGINT) AS term_id, term, pattern, k FROM pat",
    "terms_by_pattern": f"WITH {PATTERNS}, {TERMS_OF} SELECT pattern, terms FROM terms",
    "empty_patterns": f"WITH {PATTERNS} SELECT count(*) AS empty_patterns FROM pat WHERE pattern = ''",
    "distinct_patterns": f"WITH {PATTERNS} SELECT DISTINCT pattern, k FROM pat WHERE pattern <> ''",
    "read_terms_dedup": f"SELECT CAST(min(i) AS BIGINT) AS term_id, trim(line) AS term FROM {rows(list(enumerate(fixtures.TERM_LINES)), 'i', 'line')} WHERE trim(line) NOT IN ('', 'nan') GROUP BY trim(line)",
    "unigram_counts": counts("k = 1"),
    "unigram_counts_nohyphen": counts("k = 1 AND NOT hyphen"),
    "kgram_counts_strict": counts("k > 1"),
    "kgram_counts_soft": counts("k > 1", soft=True),
    "kgram_counts_block": counts("k > 1", BLOCKS),
    "word_totals": f"WITH {tokens(WHOLE)} SELECT segment, greatest(1, count(lemma)) AS total FROM tok GROUP BY segment",
    "total_words_priority": f"SELECT path, total, greatest(1, total) AS denom FROM (SELECT path, CAST(coalesce(TRY_CAST(nullif(regexp_extract(path, '_([0-9]+)(?:\\.[\\p{{L}}\\p{{N}}_]+)?$', 1), '') AS BIGINT), nullif(fallback, 0), greatest(1, counted)) AS BIGINT) AS total FROM {rows(fixtures.TOTALS, 'path', 'fallback', 'counted')})",
    "page_totals": "SELECT page_id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(replace(url, '/', '_'), '_([0-9]+)(?:\\.[\\p{L}\\p{N}_]+)?$', 1), '') AS BIGINT), greatest(1, length(url))) AS BIGINT) AS total FROM pages",
    "term_ipm_long": f"{frequency(WHOLE, named(fixtures.SEGMENTS))} SELECT CAST(term_id AS BIGINT) AS term_id, term, segment, cnt, ipm FROM freq",
    "term_dynamics": wide(WHOLE, fixtures.SEGMENTS),
    "term_dynamics_by_source": f"{frequency(BY_SOURCE, 'SELECT DISTINCT source AS segment FROM documents WHERE source IS NOT NULL')} SELECT CAST(term_id AS BIGINT) AS term_id, term, segment, cnt, ipm FROM freq",
    "kwic_topn": f"{matched()}, {RANKED} SELECT segment, pattern, match_no, doc AS doc_id, first_tok, last_tok FROM ranked",
    "kwic_window": f"{matched()}, {RANKED}, {DOCS} SELECT segment, pattern, match_no, {SURFACE} AS surface, {around('first_tok', 'last_tok', queries.WINDOW)} AS context FROM ranked JOIN docs USING (doc)",
    "kwic_log": f"{matched()}, {RANKED}, {DOCS}, {TERMS_OF} SELECT segment, doc AS doc_id, coalesce(terms, pattern) AS term, pattern, match_no, {SURFACE} AS surface, {around('first_tok', 'last_tok', queries.WINDOW)} AS context, first_tok AS start_tok_idx, last_tok AS end_tok_idx FROM ranked JOIN docs USING (doc) LEFT JOIN terms USING (pattern)",
    "kwic_places": f"{matched()}, {RANKED}, firsts AS (SELECT *, min({{'d': doc, 't': first_tok}}) OVER (PARTITION BY segment, pattern) AS f FROM ranked) SELECT segment, pattern, match_no, CAST(row_number() OVER (PARTITION BY segment ORDER BY k, f, pattern, match_no) AS INT) AS place FROM firsts",
    "kwic_chosen": f"{matched()}, {RANKED}, {DOCS}, chosen AS (SELECT pattern FROM (SELECT * FROM pat) p WHERE pattern IN ({listed(N.fold(w).lower() for w in ('the', 'house', 'el'))})) SELECT segment, pattern, match_no, {SURFACE} AS surface, {around('first_tok', 'last_tok', queries.WINDOW)} AS context FROM ranked JOIN docs USING (doc) WHERE pattern IN (SELECT pattern FROM chosen)",
    "highlight_spans": f'{matched(BLOCKS)} SELECT doc AS doc_id, block AS block_id, start, "end" FROM hits',
    "merged_spans": f'{matched(BLOCKS)}, {MERGED} SELECT doc AS doc_id, block AS block_id, start, "end" FROM merged',
    "highlight_runs": f"{matched(BLOCKS)}, {MERGED}, {RUNS} SELECT doc AS doc_id, block AS block_id, row_number() OVER (PARTITION BY doc, block ORDER BY a) - 1 AS run_idx, text, is_term FROM runs",
    "highlight_markup": f"{matched(BLOCKS)}, {MERGED}, {RUNS} SELECT doc AS doc_id, block AS block_id, string_agg(CASE WHEN is_term THEN '<mark>' || text || '</mark>' ELSE text END, '' ORDER BY a) AS text FROM runs GROUP BY doc, block",
    "debug_term_tokens": f"WITH {tokens(WHOLE)}, {DOCS} SELECT doc AS doc_id, i AS tok_idx, text, lemma, pos, {around('i', 'i', queries.WINDOW)} AS context FROM tok JOIN docs USING (doc) WHERE contains(lower(text), {text(N.fold(queries.DEBUG_TERM).split(' ')[0][:5])}) OR contains(coalesce(lemma, ''), {text(N.fold(queries.DEBUG_TERM).split(' ')[0][:5])})",
    "debug_term_counts": f"WITH {tokens(WHOLE)}, g AS (SELECT doc, lemma || ' ' || lead(lemma) OVER w AS p, lead(i) OVER w - i AS gap FROM tok WHERE lemma IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY i)) SELECT doc AS doc_id, count(*) AS cnt FROM g WHERE gap = 1 AND p = {text(N.fold(queries.DEBUG_TERM))} GROUP BY doc",
    "left_merge_fill": "SELECT d.doc_id, d.lang, d.n_chars, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'x' END, '') AS mark FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id",
}
