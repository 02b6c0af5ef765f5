"""Text rewrites, predicates and sentence splitting as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

# The artifact characters, heading names, metadata phrases, figure markers and symbols of the rules.
ARTIFACTS = "�□■▲▶◀◆◇●○¤¼½¾ðþÿ"
HEADINGS = ["abstract", "introduction", "background", "methods", "materials and methods", "experimental", "results", "discussion", "conclusion", "conclusions", "acknowledgements", "references", "supplementary information"]
METADATA = ["arxiv:", "dated:", "university", "institute", "department", "copyright", "all rights reserved", "corresponding author"]
NOISE_METADATA = [*METADATA, "journal of", "published by", "downloaded from", "accepted manuscript", "preprint"]
SUMMARY_METADATA = [*METADATA, "email:"]
NOISE_MARKERS = ["fig.", "figs.", "figure", "eq.", "equation", "appendix", "supplementary", "table"]
SUMMARY_MARKERS = ["eq.", "equation", "fig.", "figure", "table", "appendix", "supplementary"]
SUMMARY_SYMBOLS = "≈σ∆Δ⊥∥∞∂∑∫αβγθλμπωχ=+/\\<>|"
NOISE_SYMBOLS = SUMMARY_SYMBOLS + "η±√∇"
# A class looks up characters below U+0100 in one bitmap, but tries ranges and others one by one: these stand behind a test
# that most characters fail.
FEW = "[\u0100-\uffff&&[{}]]"
CLOSERS = "[\"'" + FEW.format("”’") + ")\\]}]*"
END = "[.!?" + FEW.format("。！？") + "]"
ENDED = END + CLOSERS + "$"
CJK = "[㐀-鿿]"
WHITE = r"(?U)[\s\x1c-\x1f]"
SPACED = r"(?U)[\s\x1c-\x1f]{2,}|[[\s\x1c-\x1f]&&[^ ]]"  # white space other than a single blank
LINE_ENDS = "\n|\x0b|\x0c|[\x1c-\x1e]|\x85|\u2028|\u2029"
MARK = ""  # stands where a sentence ends; private use, never in cleaned text
BLANKS = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f"
ALL_BLANKS = BLANKS + r"\x85\xa0" + FEW.format("\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")


def lit_class(chars: str) -> str:
    low, high = ("".join("\\" + c if c in "\\[]^-&" else c for c in chars if (c < "\u0100") == is_low) for is_low in (True, False))
    return f"[{low}{FEW.format(high) if high else ''}]"


_PLAIN: ContextVar[bool | None] = ContextVar("plain", default=None)


def by_script(c: Column, build: Callable[[Column], Column], again: bool = False) -> Column:
    """build(c), built twice: once for texts of ASCII alone, whose patterns need no Unicode tables. Both give the same.

    again: c is a part of a text, which may be of ASCII alone where the text is not.
    """
    if _PLAIN.get() or (_PLAIN.get() is False and not again):
        return build(c)

    def built(x: Column, plain: bool) -> Column:
        token = _PLAIN.set(plain)
        try:
            return build(x)
        finally:
            _PLAIN.reset(token)

    return once(c, lambda x: F.when(F.octet_length(x) == F.length(x), built(x, True)).otherwise(built(x, False)))


def _p(pattern: str) -> str:
    """The pattern, for texts of ASCII alone without its Unicode flag and characters beyond ASCII (but for U+E000)."""
    pattern = pattern.replace(r"\s\x1c-\x1f", BLANKS if _PLAIN.get() else ALL_BLANKS)
    if not _PLAIN.get():
        return pattern
    pattern = re.sub("\\[\u0100-\uffff&&\\[[^]]*]]", "", pattern)
    out = re.sub("[\x80-\ud7ff\uf900-\uffff]", "", re.sub("[㐀-鿿]-?[㐀-鿿]", "", pattern))
    return out.replace("(?U)", "").replace("(?iU)", "(?i)")


def strip(c: Column) -> Column:
    if _PLAIN.get():
        return F.trim(c, F.lit(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"))
    return F.regexp_replace(c, _p(r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"), "")


def once(c: Column, then) -> Column:
    """A predicate or value of c, which is evaluated one time however often `then` names it."""
    return F.transform(F.array(c), then)[0]


def tokens(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.regexp_extract_all(c, F.lit(_p(r"(?U)[^\s\x1c-\x1f]+")), F.lit(0))


def term_pattern() -> str:
    return "[a-z0-9_]{2,}" if _PLAIN.get() else r"(?U)\b\w\w+\b"  # of a case-folded text


def word_count(c: Column) -> Column:
    return F.size(tokens(F.coalesce(c, F.lit(""))))


def clean_text(c: Column) -> Column:
    """Line ends, hyphen breaks, extraction artifacts, blanks and spaces before punctuation; null becomes empty."""
    steps = [
        (r"\r", "\n"),
        (r"(?U)(?<=\w)-[\s\x1c-\x1f]*\n[\s\x1c-\x1f]*(?=\w)", ""),
        (r"\(cid:\d+\)", " "),
        *([] if _PLAIN.get() else [(lit_class(ARTIFACTS) + "+", " ")]),
        (r"[ \t]{2,}|\t", " "),
        (r"\n{3,}", "\n\n"),
        (WHITE + r"+([,.;:!?])", "$1"),
        (r"(?U)\([\s\x1c-\x1f]+", "("),
        (r"(?U)[\s\x1c-\x1f]+\)", ")"),
    ]
    out = F.coalesce(c, F.lit(""))
    for pattern, by in steps:
        out = F.regexp_replace(out, _p(pattern), by)
    return strip(out)


def protect(c: Column) -> Column:
    """Dots of abbreviations become U+E000, so that they end no sentence."""
    out = F.regexp_replace(c, _p(r"(?iU)\b(figs?|eqs?|refs?|dr|mr|mrs|ms|prof|vs|approx|et[\s\x1c-\x1f]+al)\."), "$1\ue000")
    for a, b in (("e", "g"), ("i", "e")):
        out = F.regexp_replace(out, _p(rf"(?iU)\b({a})\.({b})\."), "$1\ue000$2\ue000")
    return out


def restore(c: Column) -> Column:
    return F.replace(c, F.lit(""), F.lit("."))


def is_heading(line: Column) -> Column:
    """A known section name; few words all in capitals; or a short numbered line without a final mark and its closers."""
    numbered = r"(?iU)^[\s\x1c-\x1f]*(\d+(\.\d+)*|[ivxlcdm]+)\.?[\s\x1c-\x1f]+"

    def judged(s: Column) -> Column:
        bare, plain = s["bare"], s["plain"]
        n = word_count(plain)
        capitals = (F.upper(plain) == plain) & (F.lower(plain) != plain)
        return F.lower(plain).isin(HEADINGS) | (capitals & (n <= 10)) | ((bare != plain) & ~bare.rlike(_p(ENDED)) & (n <= 12))

    bare = F.regexp_replace(strip(line), "^:+|:+$", "")
    return once(once(bare, lambda b: F.struct(b.alias("bare"), F.regexp_replace(b, _p(numbered), "").alias("plain"))), judged)


def is_complete(c: Column) -> Column:
    return strip(c).rlike(_p(ENDED))


def text_lines(c: Column) -> Column:
    """Array of the stripped lines that are not blank."""
    ends = "[\n\x0b\x0c\x1c-\x1e]" if _PLAIN.get() else LINE_ENDS
    return F.filter(F.transform(F.split(c, ends), strip), lambda x: x != "")


def logical_lines(c: Column) -> Column:
    """Array of lines: hard-wrapped lines joined, headings and finished sentences on their own.

    A line begins a new one if it is a heading or a bullet, or if the line before it is a heading or ends a sentence
    (abbreviations do not). So each line looks at its neighbour only, and no text is built up step by step.
    """
    return by_script(c, _logical_lines)


def _logical_lines(c: Column) -> Column:
    bullet = _p(r"(?U)^([-•·]|\d+[.)])[\s\x1c-\x1f]+")

    def marked(x: Column) -> Column:
        heading = is_heading(restore(x))
        return once(
            heading,
            lambda h: F.struct(
                F.when(h, x).otherwise(strip(F.regexp_replace(x, bullet, ""))).alias("line"),
                (h | x.rlike(bullet)).alias("opens"),
                (h | x.rlike(_p(ENDED))).alias("ends"),
            ),
        )

    def joined(rows: Column) -> Column:
        starts = F.filter(
            F.transform(rows, lambda r, i: F.when((i == 0) | r["opens"] | F.get(rows, i - 1)["ends"], i)), lambda i: i.isNotNull()
        )
        return once(
            starts,
            lambda at: F.transform(
                at,
                lambda i, k: restore(F.array_join(F.transform(F.slice(rows, i + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - i), lambda r: r["line"]), " ")),
            ),
        )

    paragraphs = F.split(protect(clean_text(c)), "\n\n")
    return F.flatten(F.transform(paragraphs, lambda p: once(F.transform(text_lines(p), marked), joined)))


def _quality(s: Column, most_words: int, metadata: list[str], markers: list[str], symbols: str, most_symbols: int, least_alpha: float) -> Column:
    """True for a sentence that a filter rejects; the two filters differ in the arguments."""

    def marked(low: Column) -> Column:
        out = sum((F.contains(low, F.lit(m)).cast("int") for m in markers), F.lit(0)) >= 2
        for m in metadata:
            out = out | F.contains(low, F.lit(m))
        return out

    letters = F.length(F.regexp_replace(s, r"\P{Alpha}+" if _PLAIN.get() else r"\P{L}+", ""))
    common = (
        (letters / F.greatest(F.length(s), F.lit(1)) < least_alpha)
        | (F.regexp_count(s, F.lit(_p(lit_class(symbols)))) > most_symbols)
        | (s.rlike(r"\p{Nd}") & (F.regexp_count(s, F.lit(_p(r"(?U)\b\d+(\.\d+)?\b"))) > 8))
        | once(F.lower(s), marked)
    )

    def by_words(words: Column) -> Column:
        n = F.size(words)
        singles = F.size(F.filter(words, lambda w: F.length(w) == 1))
        return (n < 4) | (n > most_words) | (singles / F.greatest(n, F.lit(1)) > 0.22)

    if _PLAIN.get():
        return ~is_complete(s) | once(tokens(s), by_words) | common
    cjk = F.regexp_count(s, F.lit(CJK))
    return ~is_complete(s) | once(cjk, lambda n: F.when(n >= 6, (n < 8) | (F.length(s) > 450)).otherwise(once(tokens(s), by_words))) | common


def is_noisy(c: Column) -> Column:
    def judged(s: Column) -> Column:
        out = _quality(s, 90, NOISE_METADATA, NOISE_MARKERS, NOISE_SYMBOLS, 6, 0.48) | s.rlike(r"^\d{5,}-\d+")
        if _PLAIN.get():
            return out
        return out | (F.regexp_count(s, F.lit(lit_class(ARTIFACTS))) + F.regexp_count(s, F.lit("�")) > 1)

    return by_script(F.coalesce(c, F.lit("")), lambda x: once(strip(x), judged), again=True)


def is_bad_for_summary(c: Column) -> Column:
    return by_script(F.coalesce(c, F.lit("")), lambda s: _quality(s, 85, SUMMARY_METADATA, SUMMARY_MARKERS, SUMMARY_SYMBOLS, 7, 0.45), again=True)


def sentences(c: Column) -> Column:
    """Array of the text's sentences in order: cut at end marks, headings and noisy sentences dropped."""
    return by_script(c, _sentences)


def _sentences(c: Column) -> Column:
    body = F.filter(logical_lines(c), lambda x: ~is_heading(x))
    ends = rf"(?U)({END}" + CLOSERS + r")(?=[\s\x1c-\x1f]|$|" + CJK + ")"
    if _PLAIN.get():
        ends = r"([.!?][\"')\]}]*)(?=[\s\x1c-\x1f]|$)"
    cut = F.flatten(F.transform(body, lambda x: F.split(F.regexp_replace(protect(x), ends, "$1" + MARK), MARK)))
    neat = F.transform(cut, lambda x: restore(F.regexp_replace(strip(x), _p(SPACED), " ")))
    return F.filter(neat, lambda x: (x != "") & ~is_noisy(x))


def passages(found: Column, max_words: int = 120) -> Column:
    """Sentences packed in order into passages of max_words at most; a longer sentence stands alone."""
    empty = F.struct(F.lit("").alias("held"), F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        n = word_count(x)
        return F.when(
            (s["n"] > 0) & (s["n"] + n > max_words), F.struct(x.alias("held"), n.alias("n"), F.concat(s["out"], F.array(s["held"])).alias("out"))
        ).otherwise(F.struct(F.when(s["held"] == "", x).otherwise(F.concat(s["held"], F.lit(" "), x)).alias("held"), (s["n"] + n).alias("n"), s["out"].alias("out")))

    return F.aggregate(found, empty, step, lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))


def _escaped(term: str) -> str:
    return "".join(r"\s+" if ch == " " else ch if ch.isalnum() else "\\" + ch for ch in term.lower().strip())


def _has_cjk(term: str) -> bool:
    return any("㐀" <= ch <= "鿿" for ch in term)


def _one_word(term: str) -> bool:
    return term.isascii() and term.isalnum()


def _found(low: Column, term: str) -> Column:
    if not term.strip():
        return F.lit(False)
    if _has_cjk(term):
        return F.contains(low, F.lit(term.lower().strip()))
    return low.rlike(r"(?U)(?<![a-z0-9])" + _escaped(term) + r"(?![a-z0-9])")


def contains_term(c: Column, term: str) -> Column:
    """Term in text, case-folded, not inside a longer run of ASCII letters or digits; CJK terms as plain substrings."""
    return _found(F.lower(c), term)


def contains_intent(c: Column, term: str) -> Column:
    """As contains_term, but no letter, digit or underscore of any script may touch the term."""
    if _has_cjk(term):
        return F.contains(F.lower(c), F.lit(term.lower()))
    return F.lower(c).rlike(r"(?U)(?<!\w)" + _escaped(term) + r"(?!\w)")


def _runs(term: str) -> list[str]:
    """The runs of ASCII letters and digits that a text with the term has as whole words; CJK terms have none for certain."""
    return [] if _has_cjk(term) else re.findall("[a-z0-9]+", term.lower().strip())


def term_words(c: Column, terms: list[str] | None = None) -> Column:
    """(low, words) of a text: the case-folded text and its distinct runs of ASCII letters and digits, for the lookups below.

    With terms only runs that one of them has are kept, which is all that lookups of these terms need.
    """

    def of(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
        if terms is not None:
            words = F.filter(words, _among(sorted({"", *(r for t in terms for r in _runs(t))})))
        return F.struct(low.alias("low"), F.coalesce(F.array_distinct(words), F.expr("cast(array() as array<string>)")).alias("words"))

    return once(F.lower(c), of)


def _seen(seen: Column, term: str) -> Column:
    """Whether a term_words value has a term that is not one word; the pattern is tried only where its longest word is."""
    runs = _runs(term)
    found = _found(seen["low"], term)
    return F.when(F.array_contains(seen["words"], max(runs, key=len)), found).otherwise(False) if runs else found


def _among(words: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(words)


def words_have_any(seen: Column, terms: list[str]) -> Column:
    """Whether a term_words value has one of the terms: words by lookup, other terms by pattern."""
    words = sorted({t.lower().strip() for t in terms if _one_word(t.strip())})
    found = [F.exists(seen["words"], _among(words))] if words else []
    found += [_seen(seen, t) for t in terms if not _one_word(t.strip())]
    return F.coalesce(*[F.when(f, F.lit(True)) for f in found], F.lit(False))


def words_count(seen: Column, terms: list[str]) -> Column:
    """How many of the terms a term_words value has; a term listed twice counts twice."""
    left = [t.lower().strip() for t in terms if _one_word(t.strip())]
    out = F.lit(0)
    while left:
        words = sorted(set(left))
        out = out + F.size(F.filter(seen["words"], _among(words)))
        for w in words:
            left.remove(w)
    return sum((_seen(seen, t).cast("int") for t in terms if not _one_word(t.strip())), out)


def any_term(c: Column, terms: list[str]) -> Column:
    return once(term_words(c, terms), lambda s: words_have_any(s, terms))


def count_terms(c: Column, terms: list[str]) -> Column:
    return once(term_words(c, terms), lambda s: words_count(s, terms))


CITATION = r"(?U)\[[\d,\-\s\x1c-\x1f]+\]"


def strip_citations(c: Column) -> Column:
    """Without marks such as [1], [2,3] and [4-6], repeated white space and blanks before punctuation."""
    out = F.regexp_replace(strip(c), _p(CITATION), "")
    return strip(F.regexp_replace(F.regexp_replace(out, _p(SPACED), " "), r" +([,.;:!?])", "$1"))


def normalize_heading(c: Column) -> Column:
    out = F.regexp_replace(F.lower(strip(c)), _p(r"(?U)^[\s\x1c-\x1f]*(\d+|[ivxlcdm]+)\.?[\s\x1c-\x1f]+"), "")
    return strip(F.regexp_replace(F.regexp_replace(out, _p(r"(?U)[^a-z\s\x1c-\x1f]+"), ""), _p(WHITE + "+"), " "))


def section_of(line: Column, aliases: dict[str, list[str]]) -> Column:
    """The first section in table order one of whose aliases a line of eight words at most is or begins with."""

    def match(name: Column) -> Column:
        return F.coalesce(*[F.when((name == a) | name.startswith(a + " "), F.lit(section)) for section, terms in aliases.items() for a in terms])

    return F.when(word_count(line) <= 8, once(normalize_heading(line), match))


def dedup_key(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z0-9]+"), F.lit(0)), " ")


def page_key(c: Column) -> Column:
    out = F.regexp_replace(F.lower(c), CITATION, " ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9㐀-鿿]+", " "))


def cite(sentence: Column, page: Column) -> Column:
    return F.when(page.isNull(), sentence).otherwise(F.concat(sentence, F.lit(" [p. "), page.cast("string"), F.lit("]")))


def preview(c: Column, limit: int = 5000) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)
