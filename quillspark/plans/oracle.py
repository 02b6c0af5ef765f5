"""SQL forms of the text rules, written from the rules and not from the Column expressions; RE2 knows no look-around."""

from __future__ import annotations

W = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
END = r"[.!?。！？][\x22\x27”’)\]}]*"
DOT, CUT = "chr(57344)", "chr(57345)"

# Fixed values, as the rules list them.
SECTION_NAMES = "abstract|introduction|background|methods|materials and methods|experimental|results|discussion|conclusion|conclusions|acknowledgements|references|supplementary information"
NOISE_META = "arxiv:|dated:|university|institute|department|copyright|all rights reserved|corresponding author|journal of|published by|downloaded from|accepted manuscript|preprint"
BAD_META = "arxiv:|dated:|university|institute|department|copyright|all rights reserved|corresponding author|email:"
NOISE_MARKS = ["fig.", "figs.", "figure", "eq.", "equation", "appendix", "supplementary", "table"]
BAD_MARKS = ["eq.", "equation", "fig.", "figure", "table", "appendix", "supplementary"]
MATH = r"≈σ∆Δ⊥∥∞∂∑∫αβγθλμπωχ=+/\\<>|"
ARTIFACTS = "�□■▲▶◀◆◇●○¤¼½¾ðþÿ"


def text(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def gsub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {text(pattern)}, {by if by.startswith(('chr', 'concat')) else text(by)}, 'g')"


def trim(x: str) -> str:
    return gsub(x, f"^{W}+|{W}+$", "")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {text(W + '+')}), lambda w: w <> '')"


def clean(x: str) -> str:
    out = f"replace(coalesce({x}, ''), chr(13), chr(10))"
    for _ in range(2):  # matches may share a character
        out = gsub(out, rf"([\p{{L}}\p{{N}}_])-{W}*\n{W}*([\p{{L}}\p{{N}}_])", r"\1\2")
    for pattern, by in ((r"\(cid:\d+\)", " "), (f"[{ARTIFACTS}]+", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (W + "+([,.;:!?])", r"\1"), (rf"\({W}+", "("), (rf"{W}+\)", ")")):
        out = gsub(out, pattern, by)
    return trim(out)


def protect(x: str) -> str:
    out = gsub(x, rf"(?i)\b(figs?|eqs?|refs?|dr|mr|mrs|ms|prof|vs|approx|et{W}+al)\.", r"concat('\1', chr(57344))")
    return gsub(gsub(out, r"(?i)\b(e)\.(g)\.", r"concat('\1', chr(57344), '\2', chr(57344))"), r"(?i)\b(i)\.(e)\.", r"concat('\1', chr(57344), '\2', chr(57344))")


def restore(x: str) -> str:
    return f"replace({x}, {DOT}, '.')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text(pattern)})"


def heading(x: str) -> str:
    number = rf"(?i)^{W}*(\d+(\.\d+)*|[ivxlcdm]+)\.?{W}+"
    bare = gsub(trim(x), "^:+|:+$", "")
    plain = f"regexp_replace({bare}, {text(number)}, '')"
    return (
        f"({matches(f'lower({plain})', f'^({SECTION_NAMES})$')} OR (len({words(plain)}) <= 10 AND upper({plain}) = {plain} AND lower({plain}) <> {plain}) "
        f"OR ({matches(bare, number)} AND len({words(plain)}) <= 12 AND NOT {matches(bare, END + '$')}))"
    )


def quality(x: str, most: int, meta: str, marks: list[str], math: str, most_math: int, alpha: float) -> str:
    cjk = f"len(regexp_extract_all({x}, '[㐀-鿿]'))"
    return f"""(NOT {matches(trim(x), END + '$')} OR ({cjk} BETWEEN 6 AND 7) OR ({cjk} >= 6 AND length({x}) > 450)
        OR ({cjk} < 6 AND len({words(x)}) NOT BETWEEN 4 AND {most}) OR {matches(f'lower({x})', meta)}
        OR {" + ".join(f"contains(lower({x}), {text(m)})::INT" for m in marks)} >= 2
        OR len(regexp_extract_all({x}, {text('[' + math + ']')})) > {most_math} OR len(regexp_extract_all({x}, '\\b\\d+(\\.\\d+)?\\b')) > 8
        OR ({cjk} < 6 AND len(list_filter({words(x)}, lambda w: length(w) = 1)) > 0.22 * greatest(len({words(x)}), 1))
        OR length({gsub(x, r'[^\p{L}]', '')}) < {alpha} * greatest(length({x}), 1))"""


def noisy(x: str) -> str:
    artifacts = f"len(regexp_extract_all({x}, {text(f'[{ARTIFACTS}]')}))"
    return f"({quality(x, 90, NOISE_META, NOISE_MARKS, MATH + 'η±√∇', 6, 0.48)} OR {artifacts} > 1 OR {matches(x, '^[0-9]{5,}-[0-9]+')})"


def bad(x: str) -> str:
    return quality(x, 85, BAD_META, BAD_MARKS, MATH, 7, 0.45)


def uncited(x: str) -> str:
    return trim(gsub(gsub(gsub(trim(x), r"\[[\d,\-\s]+\]", ""), W + "+", " "), W + "+([,.;:!?])", r"\1"))


def page_key(x: str) -> str:
    return trim(gsub(gsub(f"lower({x})", r"\[[\d,\-\s]+\]", " "), "[^a-z0-9㐀-鿿]+", " "))


def dedup_key(x: str) -> str:
    return trim(gsub(f"lower({x})", "[^a-zA-Z0-9]+", " "))


def has(x: str, term: str) -> str:
    if any("㐀" <= c <= "鿿" for c in term):
        return f"contains(lower({x}), {text(term.lower())})"
    body = "".join(r"\s+" if c == " " else c if c.isalnum() else "\\" + c for c in term.lower())
    return matches(f"lower({x})", rf"(^|[^a-z0-9]){body}($|[^a-z0-9])")


def any_of(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(has(x, t) for t in terms) + ")"


def count_of(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(has(x, t) + "::INT" for t in terms) + ")"


def lines(p: str, source: str, key: str) -> str:
    """{p}_l: (key, i, line) of the lines of {source}'s cleaned text t that are not blank."""
    return rf"""
        {p}_r AS (SELECT {key}, regexp_split_to_array(t, '\n|\x0b|\x0c|[\x1c-\x1e]|\x{{85}}|\x{{2028}}|\x{{2029}}') AS ls FROM {source}),
        {p}_l AS (SELECT * FROM (SELECT {key}, i, {trim('ls[i]')} AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM {p}_r)) WHERE line <> '')"""


def sentences(p: str, source: str, key: str, x: str) -> str:
    """CTEs that end in {p}: (key, position, sentence), of the text x of {source}."""
    bullet = rf"^([-•·]|\d+[.)]){W}+"
    return rf"""
        {p}_a AS (SELECT {key}, string_split({protect(clean(x))}, chr(10) || chr(10)) AS ps FROM {source}),
        {p}_b AS (SELECT {key}, k, ps[k] AS t FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM {p}_a)),
        {lines(p + '_b2', p + '_b', key + ', k')},
        {p}_c AS (SELECT *, {heading(restore('line'))} AS h, {matches('line', bullet)} AS b, {matches('line', END + '$')} AS e FROM {p}_b2_l),
        {p}_d AS (SELECT *, h OR b OR coalesce(lag(h OR e) OVER (PARTITION BY {key}, k ORDER BY i), true) AS opens FROM {p}_c),
        {p}_e AS (SELECT *, sum(opens::INT) OVER (PARTITION BY {key} ORDER BY k, i ROWS UNBOUNDED PRECEDING) AS seg FROM {p}_d),
        {p}_f AS (SELECT {key}, seg, {restore(f"string_agg(CASE WHEN b AND NOT h THEN regexp_replace(line, {text(bullet)}, '') ELSE line END, ' ' ORDER BY i)")} AS line FROM {p}_e GROUP BY {key}, seg),
        {p}_g AS (SELECT {key}, seg, {gsub(gsub(protect('line'), f'({END})({W}|$)', r"concat('\1', chr(57345), '\2')"), f'({END})([㐀-鿿])', r"concat('\1', chr(57345), '\2')")} AS line
                  FROM {p}_f WHERE NOT {heading('line')}),
        {p}_h AS (SELECT {key}, seg, j, {restore(gsub(trim('ss[j]'), W + '+', ' '))} AS s
                  FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS j FROM (SELECT *, string_split(line, {CUT}) AS ss FROM {p}_g))),
        {p} AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY seg, j) - 1)::INT AS position, s AS sentence FROM {p}_h WHERE s <> '' AND NOT {noisy('s')})"""


def sections(p: str, source: str, x: str, aliases: dict[str, list[str]]) -> str:
    """CTEs that end in {p}: (doc_id, section, section_ord, section_text)."""
    name = trim(gsub(gsub(gsub(f"lower({trim('line')})", rf"^{W}*(\d+|[ivxlcdm]+)\.?{W}+", ""), rf"[^a-z\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]", ""), W + "+", " "))
    cases = " ".join(f"WHEN name = {text(a)} OR starts_with(name, {text(a + ' ')}) THEN {text(s)}" for s, ts in aliases.items() for a in ts)
    return rf"""
        {p}_a AS (SELECT doc_id, {clean(x)} AS t FROM {source}),
        {lines(p + '_b', p + '_a', 'doc_id')},
        {p}_c AS (SELECT *, CASE WHEN len({words('line')}) > 8 THEN NULL {cases} END AS head FROM (SELECT *, {name} AS name FROM {p}_b_l)),
        {p}_d AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'body') AS section FROM {p}_c),
        {p}_e AS (SELECT doc_id, section, min(i) AS first, string_agg(line, chr(10) ORDER BY i) FILTER (head IS NULL) AS section_text FROM {p}_d WHERE section <> 'references' GROUP BY ALL),
        {p} AS (SELECT doc_id, section, (row_number() OVER (PARTITION BY doc_id ORDER BY section <> 'body', first) - 1)::INT AS section_ord, section_text FROM {p}_e WHERE section_text IS NOT NULL)"""


def candidates(p: str, source: str, x: str, aliases: dict[str, list[str]]) -> str:
    """CTEs that end in {p}: (doc_id, section, position, ord, sentence)."""
    return f"""{sections(p + '_s', source, x, aliases)}, {sentences(p + '_t', p + '_s', 'doc_id, section, section_ord', 'section_text')},
        {p}_u AS (SELECT doc_id, section, section_ord, position, {uncited('sentence')} AS sentence FROM {p}_t),
        {p} AS (SELECT doc_id, section, position, (row_number() OVER (PARTITION BY doc_id ORDER BY section_ord, position) - 1)::INT AS ord, sentence FROM {p}_u WHERE NOT {bad('sentence')})"""


def passages(p: str, source: str, key: str, most: int = 120) -> str:
    """CTEs that end in {p}: (key, slot, passage), from sentences (key, position, sentence); needs WITH RECURSIVE."""
    keys = [k.strip() for k in key.split(",")]
    same = " AND ".join(f"s.{k} IS NOT DISTINCT FROM r.{k}" for k in keys)
    return f"""
        {p}_s AS (SELECT {key}, position, sentence, len({words('sentence')}) AS n FROM {source}),
        {p}_r AS (SELECT {key}, position, sentence, n AS held, 0 AS slot FROM {p}_s WHERE position = 0 UNION ALL
                  SELECT {", ".join(f"s.{k}" for k in keys)}, s.position, s.sentence, CASE WHEN r.held + s.n > {most} THEN s.n ELSE r.held + s.n END, r.slot + (r.held + s.n > {most})::INT
                  FROM {p}_r r JOIN {p}_s s ON {same} AND s.position = r.position + 1),
        {p} AS (SELECT {key}, slot, string_agg(sentence, ' ' ORDER BY position) AS passage FROM {p}_r GROUP BY {key}, slot)"""


def terms(p: str, source: str, key: str, x: str, stop: list[str]) -> str:
    """CTEs that end in {p}: (key, term, tf)."""
    ws = rf"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({', '.join(map(text, stop))}))"
    return f"""
        {p}_w AS (SELECT {key}, {ws} AS ws FROM {source}),
        {p}_t AS (SELECT {key}, unnest(ws) AS term FROM {p}_w UNION ALL SELECT {key}, ws[i] || ' ' || ws[i + 1] FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM {p}_w)),
        {p} AS (SELECT {key}, term, count(*) AS tf FROM {p}_t GROUP BY ALL)"""


def tfidf(p: str, source: str, group: str, unit: str, x: str, stop: list[str], max_df: float) -> str:
    """CTEs that end in {p}: (group, unit, term, w), L2-normalized within each unit."""
    return f"""{terms(p + '_tf', source, f'{group}, {unit}', x, stop)},
        {p}_n AS (SELECT {group}, count(*) AS n FROM {source} GROUP BY ALL),
        {p}_df AS (SELECT {group}, term, count(*) AS df FROM {p}_tf GROUP BY ALL),
        {p}_raw AS (SELECT {group}, {unit}, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM {p}_tf JOIN {p}_df USING ({group}, term) JOIN {p}_n USING ({group}) WHERE df <= {max_df} * n),
        {p} AS (SELECT {group}, {unit}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {group}, {unit})) AS w FROM {p}_raw)"""


def retrieval(p: str, source: str, queries: str, stop: list[str], top: int) -> str:
    """CTEs that end in {p}: (query_id, doc_id, passage_index, score, rank), from (doc_id, passage_index, passage) and (query_id, query)."""
    return f"""{terms(p + '_d', source, 'doc_id, passage_index', 'passage', stop)}, {terms(p + '_q', queries, 'query_id', 'query', stop)},
        {p}_n AS (SELECT count(*) AS n FROM {source}), {p}_df AS (SELECT term, count(*) AS df FROM {p}_d GROUP BY term),
        {p}_v AS (SELECT query_id, term, q.tf AS qtf, ln((2 + n) / (2 + coalesce(df, 0))) + 1 AS idf, ln((2 + n) / (1 + df)) + 1 AS plain FROM {p}_q q LEFT JOIN {p}_df USING (term), {p}_n),
        {p}_qn AS (SELECT query_id, sqrt(sum((qtf * idf) * (qtf * idf))) AS qn FROM {p}_v GROUP BY query_id),
        {p}_sq AS (SELECT doc_id, passage_index, sum((tf * (ln((2 + n) / (1 + df)) + 1)) ** 2) AS sq FROM {p}_d JOIN {p}_df USING (term), {p}_n GROUP BY ALL),
        {p}_m AS (SELECT query_id, doc_id, passage_index, sum(tf * idf * qtf * idf) AS dot, sum((tf * idf) ** 2 - (tf * plain) ** 2) AS more FROM {p}_d JOIN {p}_v USING (term) GROUP BY ALL),
        {p}_x AS (SELECT query_id, doc_id, passage_index, round(dot / (qn * sqrt(sq + more)), 6) AS score FROM {p}_m JOIN {p}_sq USING (doc_id, passage_index) JOIN {p}_qn USING (query_id)),
        {p} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC, passage_index DESC)::INT AS rank FROM {p}_x QUALIFY rank <= {top} AND score > 1e-9)"""
