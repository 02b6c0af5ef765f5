"""The SQL that states the registered queries' results."""

from __future__ import annotations

from quillspark.functions import lexicon as L
from quillspark.functions import markup as M
from quillspark.operators import evidence as E
from quillspark.operators import figures as G
from quillspark.operators import reports as P
from quillspark.plans import fixtures as X
from quillspark.plans import oracle as S
from quillspark.plans import registry as R

# Fixed values of the scores, by their rules.
WEIGHTS = {"abstract": 1.45, "conclusion": 1.35, "results": 1.22, "discussion": 1.15, "methods": 1.05, "introduction": 1.0, "body": 0.95}
UNITS = "nm|μm|um|mm|cm|m|k|K|°C|c|T|mT|Oe|A|mA|uA|μA|V|mV|eV|meV|Hz|kHz|MHz|GHz|s|ms|ns|min|h|Pa|bar|rpm|%|wt%|at%"
CONDITION = ["under", "at", "with", "using", "condition", "parameter", "set to", "fixed", "varied"]
OUTCOME = ["show", "shows", "demonstrate", "demonstrates", "indicate", "suggest", "therefore", "as a result"]
CLAIM = ["we show", "we demonstrate", "we find", "we observe", "the results", "this suggests", "indicating that", "therefore", "however"]

TEXTS = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {S.values([(-1 - i, t) for i, t in enumerate(X.TEXTS)])}) v(doc_id, text))"
OWN = f"texts AS (SELECT * FROM (VALUES {S.values([(-1 - i, t) for i, t in enumerate(X.TEXTS)])}) v(doc_id, text))"
PAGES = (
    "pages_ AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page_number, text AS page_text FROM conversations "
    f"UNION ALL SELECT * FROM (VALUES {S.values(X.PAGES)}) v(doc_id, page_number, page_text))"
)
PAGED = f"""{PAGES}, page_texts AS (SELECT doc_id, page_number, {S.clean('page_text')} AS body FROM pages_),
    texts AS (SELECT doc_id, {S.clean("string_agg(body, chr(10) || chr(10) ORDER BY page_number) FILTER (body <> '')")} AS text FROM page_texts GROUP BY doc_id)"""
SENTENCES = f"{TEXTS}, {S.sentences('s', 'texts', 'doc_id', 'text')}"
CANDIDATES = f"{S.candidates('c', 'texts', 'text', R.ALIASES)}"
QUESTIONS = f"asked AS (SELECT query_id, query FROM (VALUES {S.values(R.QUESTIONS)}) v(query_id, query))"


def located(source: str, column: str) -> str:
    """CTE located: (doc_id, sentence, page_number) of the sentences of a source."""
    return f"""wanted AS (SELECT DISTINCT doc_id, {column} AS sentence, {S.page_key(column)} AS k FROM {source} WHERE {column} IS NOT NULL),
        keyed AS (SELECT doc_id, page_number, {S.page_key('page_text')} AS k FROM pages_),
        located AS (SELECT doc_id, sentence, min(page_number) FILTER (w.k <> '' AND contains(p.k, w.k)) AS page_number FROM wanted w LEFT JOIN keyed p USING (doc_id) GROUP BY ALL)"""


def cited(sentence: str) -> str:
    return f"{sentence} || coalesce(' [p. ' || page_number || ']', '')"


def cells(groups: dict[str, list[str]], column: str) -> str:
    return f"every AS (SELECT doc_id, {column} FROM texts, (VALUES {S.values([(g,) for g in groups])}) g({column}))"


def hints(groups: dict[str, list[str]]) -> str:
    found = " UNION ALL ".join(f"SELECT doc_id, position, sentence, {S.text(g)} AS category FROM s WHERE {S.any_of('sentence', ts)}" for g, ts in groups.items())
    return f"""{cells(groups, 'category')}, found AS ({found}),
        top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY position)::INT AS hint_no FROM found QUALIFY hint_no <= 4),
        hints AS (SELECT doc_id, category, hint_no, sentence AS hint FROM every LEFT JOIN top USING (doc_id, category))"""


def role_scores(chosen: str = "0") -> str:
    """CTEs that end in best: (doc_id, role, score, section, ord, sentence); chosen: a bonus in SQL."""
    parts = []
    for role, terms in R.ROLES.items():
        order = L.ROLE_SECTIONS[role]
        rank = "CASE section " + " ".join(f"WHEN {S.text(s)} THEN {i}" for i, s in enumerate(order)) + f" ELSE {len(order)} END"
        parts.append(f"SELECT doc_id, {S.text(role)} AS role, {S.count_of('sentence', terms)} AS hits, {len(order)} - {rank} AS ahead, position, ord, sentence FROM c")
    return f"""scored AS ({" UNION ALL ".join(parts)}),
        best0 AS (SELECT doc_id, role, round(2.0::DOUBLE * hits + 0.35::DOUBLE * ahead + greatest(0::DOUBLE, 0.25::DOUBLE - 0.03::DOUBLE * position) + {chosen}, 6) AS score, ord, sentence FROM scored WHERE hits > 0),
        best1 AS (SELECT * FROM best0 QUALIFY row_number() OVER (PARTITION BY doc_id, role ORDER BY score DESC, ord) = 1),
        best AS (SELECT b.*, (SELECT arg_min(section, c.ord) FROM c WHERE c.doc_id = b.doc_id AND c.sentence = b.sentence) AS section FROM best1 b)"""


BRIEF = f"""{cells(R.ROLES, 'role')}, {role_scores()},
    brief AS (SELECT doc_id, role, sentence AS evidence, section, sentence IS NOT NULL AS detected, count(sentence) OVER (PARTITION BY doc_id)::INT AS detected_count,
                     round(count(sentence) OVER (PARTITION BY doc_id) / 5, 6) AS coverage FROM every LEFT JOIN best USING (doc_id, role))"""


def summary(k: int) -> str:
    """CTEs that end in picked: (doc_id, ord, section, sentence), from candidates c; needs WITH RECURSIVE."""
    named = " + ".join(f"{S.any_of('sentence', ts)}::INT" for ts in L.ROLES.values())
    hits = " + ".join(S.has("sentence", t) + "::INT" for ts in L.DOMAIN.values() for t in ts)
    weight = "CASE section " + " ".join(f"WHEN {S.text(s)} THEN {w}" for s, w in WEIGHTS.items()) + " ELSE 1.0 END"
    return f"""{S.tfidf('v', 'c', 'doc_id', 'ord', 'sentence', L.STOP_WORDS, 0.9)},
        base AS (SELECT doc_id, ord, sum(w) AS base FROM v GROUP BY ALL),
        score AS (SELECT c.*, coalesce(base, 0) AS base, round(coalesce(base, 0) * ({weight})::DOUBLE * CASE WHEN position <= 2 THEN 1.1::DOUBLE ELSE 1 END
                  + 0.25::DOUBLE * ({named}) + least(0.06::DOUBLE * ({hits}), 0.36::DOUBLE), 9) AS score FROM c LEFT JOIN base USING (doc_id, ord)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r, count(*) OVER (PARTITION BY doc_id) AS n, max(base) OVER (PARTITION BY doc_id) AS most FROM score),
        alike AS (SELECT a.doc_id, a.ord, list(b.ord) AS others FROM (SELECT a.doc_id, a.ord AS ao, b.ord AS bo FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term = b.term AND a.ord <> b.ord
                  GROUP BY ALL HAVING sum(a.w * b.w) > 0.68) x(doc_id, ord, bo), LATERAL (SELECT bo AS ord) b, LATERAL (SELECT x.doc_id, x.ord) a GROUP BY ALL),
        steps AS (SELECT doc_id, r, ord, coalesce(others, []) AS others FROM ranked LEFT JOIN alike USING (doc_id, ord) WHERE n > {k} AND most > 0),
        walk AS (SELECT doc_id, r, [ord] AS got FROM steps WHERE r = 1 UNION ALL
                 SELECT s.doc_id, s.r, CASE WHEN len(got) >= {k} OR list_has_any(got, others) THEN got ELSE list_append(got, s.ord) END FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.r = w.r + 1),
        chosen AS (SELECT doc_id, unnest(arg_max(got, r)) AS ord FROM walk GROUP BY doc_id
                   UNION ALL SELECT doc_id, ord FROM ranked WHERE (n <= {k} OR most = 0) AND ord < {k}),
        picked AS (SELECT doc_id, ord, section, sentence FROM chosen JOIN c USING (doc_id, ord))"""


def summary_markdown(k: int) -> str:
    """CTEs that end in summary_: (doc_id, summary), with pages."""
    labels = {"main_focus": (0, "Main focus"), "method": (1, "Approach / method"), "result": (2, "Key result"), "limitation": (3, "Limitation / future work")}
    rows = S.values([(r, i, f"- **{n}:** ") for r, (i, n) in labels.items()])
    bonus = "CASE WHEN EXISTS (SELECT 1 FROM picked p WHERE p.doc_id = scored.doc_id AND p.sentence = scored.sentence) THEN 0.35::DOUBLE ELSE 0 END"
    return f"""{CANDIDATES}, {summary(k)}, {role_scores(bonus)},
        points AS (SELECT b.doc_id, no, label, sentence FROM best b JOIN (VALUES {rows}) l(role, no, label) USING (role)
                   WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.doc_id = b.doc_id AND p.sentence = b.sentence)
                   QUALIFY row_number() OVER (PARTITION BY b.doc_id, sentence ORDER BY no) = 1),
        said AS (SELECT doc_id, 0 AS block, ord AS no, '' AS label, sentence FROM picked UNION ALL SELECT doc_id, 1, no, label, sentence FROM points),
        {located('said', 'sentence')},
        said2 AS (SELECT doc_id, block, no, label || {cited('sentence')} AS line FROM said LEFT JOIN located USING (doc_id, sentence)),
        parts AS (SELECT doc_id, string_agg(line, ' ' ORDER BY no) FILTER (block = 0) AS overview, string_agg(line, chr(10) ORDER BY no) FILTER (block = 1) AS points FROM said2 GROUP BY doc_id),
        summary_ AS (SELECT doc_id, CASE WHEN overview IS NULL THEN {S.text(E.NO_SUMMARY)} ELSE '### Grounded summary' || chr(10) || chr(10) || overview
                     || coalesce(chr(10) || chr(10) || '### Supporting points' || chr(10) || points, '') || chr(10) || chr(10) || {S.text(E.SUMMARY_NOTE)} END AS summary
                     FROM texts LEFT JOIN parts USING (doc_id))"""


def intents(x: str) -> str:
    """CASE for the question type of a query."""
    score = {}
    for kind, patterns in L.QUESTION_TYPES.items():
        each = []
        for p in patterns:
            cjk = any("㐀" <= c <= "鿿" for c in p)
            hit = f"contains(lower({x}), {S.text(p)})" if cjk else S.matches(f"lower({x})", rf"(^|[^\p{{L}}\p{{N}}_]){p.replace(' ', chr(92) + 's+')}($|[^\p{{L}}\p{{N}}_])")
            each.append(f"{hit}::INT * {100 + 35 * min(len(p.split()) - 1, 2)}")
        score[kind] = "(" + " + ".join(each) + ")"
    every = f"[{', '.join(score.values())}]"
    kinds = ", ".join(S.text(k) for k in score)
    return f"CASE WHEN list_max({every}) = 0 THEN 'general' ELSE ([{kinds}])[list_position({every}, list_max({every}))] END"


EXPANDED = f"""{QUESTIONS}, typed AS (SELECT query_id, query, {intents('query')} AS question_type FROM asked WHERE {S.trim('query')} <> ''),
    expanded AS (SELECT query_id, question_type, query || ' ' || more AS query FROM typed JOIN (VALUES {S.values([(t, ' '.join(ws)) for t, ws in L.QUERY_EXPANSION.items()])}) e(question_type, more) USING (question_type))"""


def bonus(x: str, kind: str) -> str:
    hits = "CASE " + " ".join(f"WHEN {kind} = {S.text(t)} THEN {S.count_of(x, ws)}" for t, ws in L.ANSWER_TERMS.items() if ws) + " ELSE 0 END"
    return f"least(0.08::DOUBLE * ({hits}) + CASE WHEN {S.any_of(x, CLAIM)} THEN 0.15::DOUBLE ELSE 0 END, 0.5::DOUBLE)"


ANSWERS = f"""{PAGES}, {EXPANDED}, {S.sentences('ps', 'pages_', 'doc_id, page_number', 'page_text')}, {S.passages('pp', 'ps', 'doc_id, page_number', 60)},
    passages_ AS (SELECT doc_id, page_number, passage, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, slot) - 1)::INT AS passage_index FROM pp),
    {S.retrieval('r', 'passages_', 'expanded', L.STOP_WORDS, 4)},
    hits AS (SELECT query_id, rank AS evidence_id, doc_id, passage_index, page_number, passage, score AS passage_score FROM r JOIN passages_ USING (doc_id, passage_index)),
    {S.sentences('hs', 'hits', 'query_id, evidence_id', 'passage')},
    fit0 AS (SELECT query_id, evidence_id, position AS sentence_index, {S.uncited('sentence')} AS sentence FROM hs),
    fit AS (SELECT f.*, doc_id, passage_index, page_number, passage_score FROM fit0 f JOIN hits USING (query_id, evidence_id) WHERE NOT {S.bad('sentence')}),
    units AS (SELECT query_id, evidence_id, sentence_index, sentence FROM fit UNION ALL SELECT query_id, -1, -1, query FROM expanded WHERE query_id IN (SELECT query_id FROM fit)),
    {S.tfidf('w', 'units', 'query_id', 'evidence_id, sentence_index', 'sentence', L.STOP_WORDS, 0.95)},
    near AS (SELECT a.query_id, a.evidence_id, a.sentence_index, sum(a.w * q.w) AS cosine FROM w a JOIN w q ON a.query_id = q.query_id AND a.term = q.term AND q.sentence_index = -1 AND a.sentence_index >= 0 GROUP BY ALL),
    graded AS (SELECT f.*, question_type, {S.dedup_key('sentence')} AS key, round(coalesce(cosine, 0) + 0.35::DOUBLE * passage_score + {bonus('sentence', 'question_type')}, 6) AS answer_score
               FROM fit f JOIN expanded USING (query_id) LEFT JOIN near USING (query_id, evidence_id, sentence_index)),
    once AS (SELECT * FROM graded QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY answer_score DESC, evidence_id, sentence_index) = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY answer_score DESC, evidence_id, sentence_index)::INT AS item, max(answer_score) OVER (PARTITION BY query_id) AS top FROM once),
    kept AS (SELECT * FROM placed WHERE item = 1 OR (item <= 4 AND answer_score >= greatest(0.10::DOUBLE, 0.35::DOUBLE * top))),
    items AS (SELECT *, max(answer_score) OVER (PARTITION BY query_id) AS a, max(passage_score) OVER (PARTITION BY query_id) AS p,
              CASE WHEN a >= 0.35 AND p >= 0.08 THEN 'Strong' WHEN a >= 0.18 THEN 'Moderate' ELSE 'Weak' END AS strength FROM kept)"""
NL = "chr(10)"
ANSWER_TEXTS = rf"""{ANSWERS}, names AS (SELECT * FROM (VALUES (-1, 'gauge.pdf'), (-2, ' ')) v(doc_id, name)),
    lines_ AS (SELECT i.*, CASE WHEN trim(coalesce(name, '')) = '' THEN 'Document ' || doc_id ELSE name END AS source,
               sentence || ' [E' || evidence_id || ']' || coalesce(' [p. ' || page_number || ']', '') AS line FROM items i LEFT JOIN names USING (doc_id)),
    by_source AS (SELECT query_id, source, min((doc_id, passage_index, sentence_index)) AS place, string_agg(line, ' ' ORDER BY doc_id, passage_index, sentence_index) AS said FROM lines_ GROUP BY ALL),
    body AS (SELECT query_id, CASE WHEN count(*) = 1 THEN min(said) ELSE string_agg('- **' || source || ':** ' || said, {NL} ORDER BY place) END AS body FROM by_source GROUP BY query_id),
    labels AS (SELECT query_id, source || coalesce(', p. ' || page_number, '') AS label, min(item) AS first FROM lines_ GROUP BY ALL),
    listed AS (SELECT query_id, string_agg('- ' || label, {NL} ORDER BY first) AS listed FROM labels GROUP BY query_id),
    state AS (SELECT query_id, min(strength) AS strength FROM items GROUP BY query_id),
    every AS (SELECT a.query_id, question_type, strength, body, listed, EXISTS (SELECT 1 FROM hits h WHERE h.query_id = a.query_id) AS found,
              CASE strength {" ".join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in E.STRENGTHS.items())} END AS reason
              FROM asked a LEFT JOIN expanded USING (query_id) LEFT JOIN state USING (query_id) LEFT JOIN body USING (query_id) LEFT JOIN listed USING (query_id))
    SELECT query_id, coalesce(question_type, 'general') AS question_type, coalesce(strength, 'Weak') AS strength,
        CASE WHEN question_type IS NULL THEN {S.text(E.NOTHING_ASKED[1])} WHEN NOT found THEN {S.text(E.NOTHING_FOUND[1])} WHEN strength IS NULL THEN {S.text(E.NOTHING_CLEAN[1])} ELSE reason END AS reason,
        CASE WHEN question_type IS NULL THEN {S.text(E.NOTHING_ASKED[0])} WHEN NOT found THEN '### Grounded answer' || {NL} || {NL} || {S.text(E.NOTHING_FOUND[0])}
             WHEN strength IS NULL THEN '### Grounded answer' || {NL} || {NL} || {S.text(E.NOTHING_CLEAN[0])}
             ELSE '### Grounded answer' || {NL} || {NL} || '**Detected question type:** `' || question_type || '`' || {NL} || '**Evidence strength:** `' || strength || '`' || {NL} || '**Why:** ' || reason || {NL} || {NL}
                  || CASE WHEN strength = 'Weak' THEN {S.text(E.ANSWER_WEAK)} || {NL} || {NL} ELSE '' END || '**Answer:**' || {NL} || body || {NL} || {NL} || '**Evidence sources:**' || {NL} || listed || {NL} || {NL} || {S.text(E.ANSWER_NOTE)} END AS answer
    FROM every"""


def dimension(x: str, d: str, terms: list[str]) -> str:
    out = f"{S.count_of(x, terms)}::DOUBLE"
    if d == "Parameters / settings":
        # a mark that is no word sign must be followed by one, to end at a word's edge
        plain, marks = "|".join(u for u in UNITS.split("|") if u[-1].isalnum()), "|".join(u for u in UNITS.split("|") if not u[-1].isalnum())
        out += rf" + 1.5::DOUBLE * len(regexp_extract_all({x}, '\b[0-9]+(\.[0-9]+)?\s?(({plain})\b|({marks})\b)'))"
        out += f" + CASE WHEN {S.any_of(x, CONDITION)} THEN 0.8::DOUBLE ELSE 0 END"
    if d == "Research focus":
        out += f" + CASE WHEN len({S.words(x)}) <= 35 THEN 0.3::DOUBLE ELSE 0 END"
    if d == "Key results / performance":
        out += f" + CASE WHEN {S.any_of(x, OUTCOME)} THEN 0.8::DOUBLE ELSE 0 END"
    return f"round({out}, 6)"


def snippets(dimensions: dict[str, list[str]]) -> str:
    """CTEs that end in snips: (doc_id, dimension, snippet_ord, snippet), from sentences s."""
    parts = " UNION ALL ".join(f"SELECT doc_id, position, sentence, {S.text(d)} AS dimension, {dimension('sentence', d, ts)} AS score FROM told" for d, ts in dimensions.items())
    return f"""told AS (SELECT * FROM (SELECT doc_id, position, {S.uncited('sentence')} AS sentence FROM s) WHERE NOT {S.bad('sentence')}),
        measured AS ({parts}),
        first AS (SELECT * FROM (SELECT *, {S.dedup_key('sentence')} AS key FROM measured WHERE score > 0) QUALIFY row_number() OVER (PARTITION BY doc_id, dimension, key ORDER BY score DESC, position) = 1),
        top3 AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY doc_id, dimension ORDER BY score DESC, position) <= 3),
        {cells(dimensions, 'dimension')},
        snips AS (SELECT doc_id, dimension, CASE WHEN sentence IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, dimension ORDER BY position) - 1 END::INT AS snippet_ord, sentence AS snippet FROM every LEFT JOIN top3 USING (doc_id, dimension))"""


KEYWORDS = f"""{S.terms('t', 'cleaned', 'doc_id', 'body', L.STOP_WORDS)},
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term)::INT AS rank FROM t QUALIFY rank <= 500),
    k AS (SELECT doc_id, rank, term AS keyword, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS score FROM f QUALIFY rank <= 15)"""
CLEANED = f"cleaned AS (SELECT doc_id, {S.clean('text')} AS body FROM texts)"

BOX = f"images AS (SELECT * FROM (VALUES {S.values(R.IMAGES)}) v(doc_id, page_number, image_no, x0, y0, x1, y1, width, height)), blocks AS (SELECT *, replace({S.clean('text')}, chr(10), ' ') AS t FROM (VALUES {S.values(R.BLOCKS)}) v(doc_id, page_number, block_no, x0, y0, x1, y1, text)), sizes AS (SELECT * FROM (VALUES {S.values(R.PAGE_SIZES)}) v(doc_id, page_number, pw, ph))"
CAPTION = rf"(?i)^\s*(fig(ure)?s?\.?\s*[a-z]?\d+|图\s*[a-z]?\d+)"
NEAREST = f"""d AS (SELECT i.doc_id, i.page_number, i.image_no, b.block_no, b.t, CASE WHEN b.y0 >= i.y1 THEN b.y0 - i.y1 WHEN b.y1 <= i.y0 THEN i.y0 - b.y1 + 35 ELSE abs(b.y0 - i.y1) + 15 END AS dist
    FROM placed i LEFT JOIN blocks b ON i.doc_id = b.doc_id AND i.page_number = b.page_number AND {S.matches('b.t', CAPTION)}),
    nearest AS (SELECT doc_id, page_number, image_no, CASE WHEN min(dist) <= 220 THEN arg_min(t, (dist, block_no)) END AS caption FROM d GROUP BY ALL)"""
FIGURES = f"""{BOX}, placed AS (SELECT i.doc_id, i.page_number, image_no, coalesce(x0, 0) AS x0, CASE WHEN x0 IS NULL THEN 0 ELSE y0 END AS y0, coalesce(x1, pw) AS x1, CASE WHEN x0 IS NULL THEN ph ELSE y1 END AS y1, width, height, pw, ph,
        row_number() OVER (PARTITION BY i.doc_id, i.page_number ORDER BY image_no)::INT AS image_index FROM images i JOIN sizes USING (doc_id, page_number) WHERE width >= 80 AND height >= 80 AND width * height >= 12000),
    {NEAREST}, shown AS (SELECT * FROM placed JOIN nearest USING (doc_id, page_number, image_no)),
    beside AS (SELECT s.doc_id, s.page_number, image_no, string_agg(t, ' ' ORDER BY block_no) AS text FROM shown s JOIN blocks b ON s.doc_id = b.doc_id AND s.page_number = b.page_number
               AND b.x0 < pw AND b.x1 > 0 AND b.y0 < least(ph, s.y1 + 260) AND b.y1 > greatest(0, s.y0 - 180) AND t <> '' AND t IS DISTINCT FROM caption GROUP BY ALL),
    {S.sentences('s', 'beside', 'doc_id, page_number, image_no', 'text')},
    near_ AS (SELECT doc_id, page_number, image_no, left(string_agg(sentence, ' ' ORDER BY position), 1600) AS nearby_text FROM s WHERE position < 4 GROUP BY ALL),
    figs AS (SELECT s.*, coalesce(nearby_text, '') AS nearby_text FROM shown s LEFT JOIN near_ USING (doc_id, page_number, image_no))"""


def purpose(x: str) -> str:
    return " ".join(f"WHEN regexp_matches(lower({x}), '{'|'.join(ws)}') THEN '{p}'" for p, ws in L.FIGURE_PURPOSES.items())


def explanations() -> str:
    out = []
    for lang, say in G.SAYINGS.items():
        told = "CASE purpose " + " ".join(f"WHEN {S.text(p)} THEN {S.text(say[p])}" for p in (*L.FIGURE_PURPOSES, "provisional")) + " ELSE '' END"
        out.append(
            f"""SELECT doc_id, page_number, image_no, {S.text(lang)} AS language,
            CASE WHEN caption IS NULL AND nearby = '' THEN {S.text(say['none'])} ELSE concat_ws('|', {S.text(say['caption'])} || caption, CASE WHEN nearby <> '' THEN {S.text(say['nearby'])} || left(nearby, 600) END) END AS direct,
            {told} AS inference, {S.text('|'.join(say['unknown']))} AS unknown FROM seen"""
        )
    return " UNION ALL ".join(out)


def oracle_sql() -> dict[str, str]:
    clean = S.clean("text")
    n_words = f"len({S.words('coalesce(text, chr(32))')})"
    hit_rows = " UNION ALL ".join(f"SELECT doc_id, {S.text(g)} AS term_group, {S.count_of('x', ts)}::BIGINT AS hits FROM (SELECT doc_id, coalesce(text, '') AS x FROM texts)" for g, ts in R.GROUPS.items())
    questions = S.values([(-q, t) for q, t in R.QUESTIONS])
    stem = r"^(.+?)(\.[^.]*)?$"
    localized = "text"
    for a, b in M.CHINESE.items():
        localized = f"replace({localized}, {S.text(a)}, {S.text(b)})"
    aliases = {**L.SECTION_ALIASES, "plain": ["the", "of"]}
    heads = S.sections("h", "all_", "text", aliases).rsplit("h_d AS", 1)[0].rstrip().rstrip(",")
    measured = " UNION ALL ".join(f"SELECT doc_id, position, {S.text(d)} AS dimension, {dimension('sentence', d, ts)} AS score FROM s" for d, ts in R.DIMENSIONS.items())
    compared = {-7: "film.pdf", -9: "Document 2", -3: "buoys.txt"}
    return {
        "clean_text_stats": f"WITH {TEXTS} SELECT doc_id, length({clean}) AS clean_chars, sha256({clean}) AS clean_sha256 FROM texts",
        "word_counts": f"SELECT doc_id, {n_words} AS n_words FROM documents",
        "logical_lines": f"WITH {SENTENCES} SELECT doc_id, (seg - 1)::INT AS line_no, line FROM s_f",
        "sentences": f"WITH {SENTENCES} SELECT doc_id, position, sentence FROM s",
        "sentence_quality": f"""WITH {SENTENCES}, p AS (SELECT doc_id, seg, string_split(regexp_replace(line, '([.!?。！？]) ', '\\1' || chr(57345), 'g'), chr(57345)) AS ps FROM s_f),
            q AS (SELECT doc_id, seg, j, ps[j] AS x FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM p) WHERE ps[j] <> ''), z AS (SELECT *, {S.trim('x')} AS tx FROM q)
            SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg, j) - 1)::INT AS position, {S.noisy('tx')} AS noisy, {S.bad('x')} AS bad_for_summary FROM z""",
        "passages": f"""WITH RECURSIVE {PAGES}, {S.sentences('s', 'pages_', 'doc_id, page_number', 'page_text')}, {S.passages('p', 's', 'doc_id, page_number')}
            SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, slot) - 1)::INT AS passage_index, page_number, passage FROM p""",
        "document_passages": f"WITH RECURSIVE {SENTENCES}, {S.passages('p', 's', 'doc_id', 60)} SELECT doc_id, slot::INT AS passage_index, passage FROM p",
        "term_hits": f"WITH {TEXTS} SELECT * FROM ({hit_rows}) WHERE hits > 0",
        "domain_hints": f"WITH {SENTENCES}, {hints(R.GROUPS)} SELECT * FROM hints",
        "cited_hints": f"WITH {PAGED}, {S.sentences('s', 'texts', 'doc_id', 'text')}, {hints(R.GROUPS)}, {located('hints', 'hint')} SELECT h.*, page_number FROM hints h LEFT JOIN located l ON h.doc_id = l.doc_id AND h.hint = l.sentence",
        "sections": f"WITH {TEXTS}, {S.sections('c', 'texts', 'text', R.ALIASES)} SELECT doc_id, section, section_ord, section_text FROM c",
        "summary_candidates": f"WITH {TEXTS}, {CANDIDATES} SELECT * FROM c",
        "role_evidence": f"WITH {TEXTS}, {CANDIDATES}, {role_scores()} SELECT doc_id, role, score, section, ord, sentence FROM best",
        "research_brief": f"WITH {PAGED}, {CANDIDATES}, {BRIEF}, {located('brief', 'evidence')} SELECT b.*, page_number FROM brief b LEFT JOIN located l ON b.doc_id = l.doc_id AND b.evidence = l.sentence",
        "keywords": f"WITH {TEXTS}, {CLEANED}, {KEYWORDS} SELECT doc_id, rank, keyword, score FROM k",
        "keyword_overlap": f"WITH {TEXTS}, {CLEANED}, {KEYWORDS} SELECT keyword, count(*) AS n_docs, CASE WHEN count(*) = 1 THEN min(doc_id) END AS doc_id FROM k GROUP BY keyword",
        "keyword_table": f"""WITH {TEXTS}, {CLEANED}, {KEYWORDS}, o AS (SELECT keyword, count(*) AS n, min(doc_id) AS doc_id FROM (SELECT DISTINCT doc_id, lower(keyword) AS keyword FROM k) GROUP BY keyword),
            shared AS (SELECT coalesce(string_agg(keyword, ', ' ORDER BY keyword), 'None detected') AS shared FROM o WHERE n = (SELECT count(*) FROM texts)),
            alone AS (SELECT doc_id, string_agg(keyword, ', ' ORDER BY keyword) AS words FROM o WHERE n = 1 GROUP BY doc_id)
            SELECT doc_id, shared, coalesce(words, 'None detected') AS distinctive FROM texts LEFT JOIN alone USING (doc_id), shared""",
        "corpus_keywords": f"""WITH whole AS (SELECT source AS workspace, string_agg({clean}, chr(10) || chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY source),
            {S.terms('t', 'whole', 'workspace', 'body', L.STOP_WORDS)}, f AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY tf DESC, term)::INT AS rank FROM t QUALIFY rank <= 500)
            SELECT workspace, rank, term AS keyword, round(tf / sqrt(sum((tf * tf)::DOUBLE) OVER (PARTITION BY workspace)), 6) AS score FROM f QUALIFY rank <= 15""",
        "corpus_parts": "SELECT doc_id, length(p) AS part_chars, sha256(p) AS part_sha256 FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id < max(doc_id) OVER () THEN chr(10) || chr(10) ELSE '' END AS p FROM documents)",
        "retrieve_multi": f"""WITH RECURSIVE texts AS (SELECT doc_id, text FROM documents), {S.sentences('s', 'texts', 'doc_id', 'text')}, {S.passages('p', 's', 'doc_id')},
            u AS (SELECT doc_id, slot::INT AS passage_index, passage FROM p), a AS (SELECT item_id AS query_id, text AS query FROM benchmark), {S.retrieval('r', 'u', 'a', L.STOP_WORDS, 4)}
            SELECT query_id, doc_id, passage_index, score, rank FROM r""",
        "evidence_pages": f"WITH {PAGES}, {S.sentences('s', 'pages_', 'doc_id, page_number', 'page_text')}, {located('s', 'sentence')} SELECT * FROM located",
        "question_types": f"WITH a AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM (VALUES {questions}) v(query_id, query)) SELECT query_id, {intents('query')} AS question_type FROM a",
        "query_expansion": f"WITH {EXPANDED} SELECT query_id, question_type, query FROM expanded",
        "citation_strip": f"WITH a AS (SELECT doc_id AS id, text AS s FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES {S.values([(-1 - i, t) for i, t in enumerate(X.CITED)])}) v(id, s)), b AS (SELECT id, {S.uncited('s')} AS c FROM a) SELECT id, length(c) AS chars, sha256(c) AS stripped_sha256 FROM b",
        "heading_classes": f"WITH all_ AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, {S.text(chr(10).join(x or ' ' for x in X.LINES))}), {heads} SELECT doc_id, head AS section, count(*) AS n_lines FROM h_c GROUP BY ALL",
        "unique_names": rf"""WITH RECURSIVE u AS (SELECT upload_ord, name, row_number() OVER (ORDER BY upload_ord) AS i FROM (SELECT doc_id AS upload_ord, source AS name FROM documents UNION ALL SELECT * FROM (VALUES {S.values([(i - 1000, n) for i, n in enumerate(X.NAMES)])}) v(upload_ord, name))),
            w AS (SELECT i, upload_ord, name, name AS unique_name, [name] AS used FROM u WHERE i = 1 UNION ALL
                  SELECT u.i, u.upload_ord, u.name, c.n, list_append(w.used, c.n) FROM w JOIN u ON u.i = w.i + 1,
                  LATERAL (SELECT CASE WHEN NOT list_contains(w.used, u.name) THEN u.name ELSE list_filter(list_transform(range(2, w.i + 3),
                      lambda k: regexp_extract(u.name, '{stem}', 1) || ' (' || k || ')' || regexp_extract(u.name, '{stem}', 2)), lambda x: NOT list_contains(w.used, x))[1] END AS n) c)
            SELECT upload_ord, name, unique_name FROM w""",
        "upload_limits": "SELECT source AS workspace, CASE WHEN count(*) > 49 THEN 'too_many_files' WHEN sum(n_chars) > 100000 THEN 'total_size_exceeded' END AS violation FROM documents GROUP BY source",
        "preview": "SELECT doc_id, length(p) AS preview_chars, sha256(p) AS preview_sha256 FROM (SELECT doc_id, CASE WHEN length(text) > 5000 THEN left(text, 5000) || '...' ELSE text END AS p FROM documents)",
        "target_documents": "SELECT doc_id AS target_id, doc_id, n_chars FROM documents UNION ALL SELECT -1, doc_id, n_chars FROM documents",
        "summary_scores": f"WITH RECURSIVE {TEXTS}, {CANDIDATES}, {summary(5)} SELECT doc_id, ord, round(score, 6) AS score FROM score",
        "summaries": f"WITH RECURSIVE {TEXTS}, {CANDIDATES}, {summary(5)} SELECT doc_id, ord, section, sentence FROM picked",
        "summary_texts": f"WITH RECURSIVE {PAGED}, {summary_markdown(3)} SELECT doc_id, summary FROM summary_",
        "answers": f"WITH RECURSIVE {ANSWERS} SELECT query_id, item, evidence_id, doc_id, passage_index, page_number, sentence_index, sentence, passage_score, answer_score, question_type, strength FROM items",
        "answer_texts": f"WITH RECURSIVE {ANSWER_TEXTS}",
        "answer_bonuses": f"""WITH {SENTENCES}, k AS (SELECT * FROM (VALUES {S.values([(t,) for t in L.ANSWER_TERMS])}) v(question_type)), b AS (SELECT doc_id, position, question_type, round({bonus('sentence', 'question_type')}, 6) AS bonus FROM s, k)
            SELECT * FROM b WHERE bonus > 0""",
        "dimension_scores": f"WITH {SENTENCES}, d AS ({measured}) SELECT * FROM d WHERE score > 0",
        "comparison": f"WITH {SENTENCES}, {snippets(R.DIMENSIONS)} SELECT * FROM snips",
        "comparison_cells": f"""WITH {PAGED}, {S.sentences('s', 'texts', 'doc_id', 'text')}, {snippets(R.DIMENSIONS)}, {located('snips', 'snippet')},
            j AS (SELECT n.doc_id, dimension, snippet_ord, {cited('snippet')} AS x FROM snips n LEFT JOIN located l ON n.doc_id = l.doc_id AND n.snippet = l.sentence)
            SELECT doc_id, dimension, coalesce(string_agg(x, ' ' ORDER BY snippet_ord), 'Not clearly detected.') AS cell FROM j GROUP BY ALL""",
        "comparison_table": f"""WITH {OWN}, {S.sentences('s', 'texts', 'doc_id', 'text')}, {snippets(L.DIMENSIONS)},
            j AS (SELECT doc_id, dimension, coalesce(string_agg(snippet, ' ' ORDER BY snippet_ord), 'Not clearly detected.') AS cell FROM snips GROUP BY ALL)
            SELECT dimension AS "Dimension", {", ".join(f'max(cell) FILTER (doc_id = {d}) AS "{n}"' for d, n in compared.items())} FROM j GROUP BY dimension""",
        "comparison_note": f"SELECT CASE WHEN count(*) < 2 THEN {S.text(E.COMPARISON_NOTES[0])} ELSE {S.text(E.COMPARISON_NOTES[1])} END AS note FROM documents",
        "corpus_metrics": f"SELECT count(*) AS n_docs, sum({n_words})::BIGINT AS n_words, 0::BIGINT AS n_figures, CASE WHEN count(*) > 1 THEN 'multi' ELSE 'single' END AS mode FROM documents",
        "caption_candidates": f"""WITH {BOX}, a AS (SELECT -doc_id AS doc_id, page_number, block_no, t FROM blocks UNION ALL SELECT doc_id, 0, 0, replace({clean}, chr(10), ' ') FROM documents)
            SELECT doc_id, page_number, block_no, t AS caption FROM a WHERE {S.matches('t', CAPTION)}""",
        "nearest_captions": f"WITH {BOX}, placed AS (SELECT * FROM images WHERE x0 IS NOT NULL), {NEAREST} SELECT * FROM nearest",
        "figures": f"WITH {FIGURES} SELECT doc_id, page_number, image_no, image_index, width, height, caption, nearby_text, CASE doc_id WHEN 1 THEN 'plans.pdf' ELSE 'nets.pdf' END || ' · page ' || page_number AS label FROM figs",
        "figure_explanations": f"""WITH {FIGURES}, seen0 AS (SELECT *, {S.clean('nearby_text')} AS nearby FROM figs),
            seen AS (SELECT *, CASE WHEN caption IS NULL THEN NULL {purpose("caption || ' ' || nearby")} ELSE 'provisional' END AS purpose FROM seen0) {explanations()}""",
        "figure_purposes": f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN NULL {purpose('text')} ELSE 'provisional' END AS purpose FROM documents",
        "localized_markup": f"WITH a AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {S.values([(-1 - i, t) for i, t in enumerate(R.MARKUP)])}) v(doc_id, text)), b AS (SELECT doc_id, {localized} AS c FROM a) SELECT doc_id, length(c) AS chars, sha256(c) AS localized_sha256 FROM b",
        "unreadable_inputs": f"""WITH f AS (SELECT * FROM (VALUES ('a.pdf', 'OK' || chr(12) || 'One page here.' || chr(12), NULL, 'One'), ('b.pdf', 'junk', 'b.pdf: not a document', ''), ('c.pdf', 'OK' || chr(12) || chr(12) || ' ', 'c.pdf: no readable text or raster figures were found.', '')) v(name, content, error, body))
            SELECT left(sha256(content), 16) AS doc_id, error FROM f
            UNION ALL SELECT doc_id::VARCHAR, CASE WHEN {clean} = '' THEN source || ': no readable text or raster figures were found.' END FROM documents""",
        "recent_questions": "SELECT source AS workspace, doc_id AS asked_ord FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 8",
        "question_reports": rf"""WITH h AS (SELECT a.conv_id * 1000 + a.turn AS asked_ord, {S.trim('a.text')} AS q, CASE WHEN a.turn % 2 = 0 THEN 'a.pdf' ELSE 'All papers' END AS target, {S.trim("'### ' || b.text")} AS t
            FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
            SELECT asked_ord, sha256('### Q' || asked_ord || '. ' || q || chr(10) || chr(10) || '**Target:** ' || target || chr(10) || chr(10) || regexp_replace(t, '^### ', '#### ')) AS part_sha256 FROM h WHERE q <> '' AND t <> ''""",
        "document_reports": f"""WITH RECURSIVE {PAGED}, {summary_markdown(3)}, {CLEANED}, {KEYWORDS}, {S.sentences('s', 'texts', 'doc_id', 'text')}, {hints(R.GROUPS).replace('every AS', 'every2 AS').replace('FROM every ', 'FROM every2 ')},
            {located('hints', 'hint').replace('wanted', 'wanted2').replace('keyed', 'keyed2').replace('located', 'located2')},
            hint_rows AS (SELECT doc_id, category, '#### ' || array_to_string(list_transform(string_split(category, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS head, hint_no, '- ' || {cited('hint')} AS line FROM hints h JOIN located2 l USING (doc_id) WHERE l.sentence = h.hint),
            blocks_ AS (SELECT doc_id, category, head || chr(10) || string_agg(line, chr(10) ORDER BY hint_no) AS b FROM hint_rows GROUP BY doc_id, category, head),
            ev AS (SELECT doc_id, string_agg(b, chr(10) || chr(10) ORDER BY category) AS ev FROM blocks_ GROUP BY doc_id),
            kw AS (SELECT doc_id, string_agg(keyword, ', ' ORDER BY rank) AS kw FROM k GROUP BY doc_id)
            SELECT 0 AS block, 0::BIGINT AS ord, '# Document report' || chr(10) || chr(10) || {S.text(P.HEADER_NOTE)} || chr(10) || chr(10) || 'Documents analyzed: ' || count(*) AS part FROM texts UNION ALL
            SELECT 1, doc_id, array_to_string(['---', '## doc ' || doc_id, summary, '### Keywords', coalesce(kw, {S.text(P.NO_KEYWORDS)}), '### Domain evidence', coalesce(ev, {S.text(P.NO_EVIDENCE)})], chr(10) || chr(10))
            FROM texts JOIN summary_ USING (doc_id) LEFT JOIN kw USING (doc_id) LEFT JOIN ev USING (doc_id)""",
    }
