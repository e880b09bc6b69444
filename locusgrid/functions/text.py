"""Expressions over text lines: trimming, tokens, citations, phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Characters treated as white space when trimming, by code point.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# A line ends at any of these.
LINE_BREAKS = r"\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x85\u2028\u2029]"

OTHER_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")

# (?U): word, digit and space classes and \b follow Unicode on every Java version.
# The look-ahead keeps the costly Unicode \b off most positions.
WORD_START = r"(?U)^\w"
RSID = r"(?U)(?=rs[0-9])\brs[0-9]+\b"
GENOTYPE_TOKEN = (
    r"(?<![A-Za-z0-9])([ACGT]{2}|[ACGT][/|][ACGT]|[DI]{2}|--)(?![A-Za-z0-9])"
)
TRIPLE = r"(?U)`(rs\d+)\s+[0-9XYMT]+:[\d,]+\s+(--|[ACGTDI]{1,2})`"
FENCE = r"(?U)^\s*```"
QUOTE = r"(?U)^\s*>"
HEADING = r"(?U)^\s*#+([^#\s]|\s.*\S)"
TABLE_RULE = r"(?U)^\s*\|?\s*:?-{3,}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def split_lines(text: Column) -> Column:
    """Array of lines; a line break at the very end leaves one empty last element, which
    ``drop_last_empty`` removes. Plain ``\n`` text takes the quick path."""
    odd = F.lit(False)
    for c in OTHER_BREAKS:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.split(text, LINE_BREAKS)).otherwise(F.split(text, "\n"))


def drop_last_empty(lines: Column) -> Column:
    """A final line break does not open another line."""
    return F.when(
        F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)
    ).otherwise(lines)


def word_alternation(words) -> str:
    return "|".join(re.escape(w) for w in words)


def may_contain(line: Column, literals) -> Column:
    """Cheap superset test for case-insensitive matches of any literal: a byte search in the
    lower-cased line, or any of the letters outside ASCII that fold to an ASCII letter but
    lower-case to something else. The one-element array makes the lower-casing happen once."""

    def any_of(low):
        hit = F.lit(False)
        for x in literals:
            hit = hit | F.contains(low, F.lit(x.lower()))
        return hit

    unusual = F.contains(line, F.lit("\u0130")) | F.contains(line, F.lit("\u0131")) | F.contains(
        line, F.lit("\u017f"))
    return F.exists(F.array(F.lower(line)), any_of) | unusual


def extract_rsids(text: Column) -> Column:
    """Distinct rsIDs in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(RSID), F.lit(0)))


def all_rsids(text: Column) -> Column:
    """Every rsID occurrence in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(RSID), F.lit(0))


def word_runs(text: Column) -> Column:
    """A text as its runs of word characters and of other characters, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?sU)\w+|\W+"), F.lit(0))


def token_count(text: Column, token: Column) -> Column:
    """Whole-word occurrences of a token made of word characters."""
    words = F.split(text, r"(?U)\W+")
    return F.size(F.filter(words, lambda w: w == token))


def citation_pattern(url_roots) -> str:
    return "(?iuU)" + "|".join(list(K.CITATION_MARKERS) + [re.escape(r) for r in url_roots])


def has_citation(line: Column, url_roots=tuple(s[2] for s in K.CITATION_SOURCES)) -> Column:
    stems = [m.replace(r"\d+", "") for m in K.CITATION_MARKERS] + list(url_roots)
    return may_contain(line, stems) & line.rlike(citation_pattern(url_roots))


def gene_hit(line: Column, genes=K.GENE_LEXICON) -> Column:
    first = "".join(sorted({g[0] for g in genes}))
    return line.rlike(rf"(?U)(?=[{re.escape(first)}])\b({word_alternation(genes)})\b")


def clinical_hit(line: Column, nouns=K.CLINICAL_LEXICON) -> Column:
    return may_contain(line, nouns) & line.rlike(rf"(?iuU)\b({word_alternation(nouns)})\b")


def genotype_tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(GENOTYPE_TOKEN), F.lit(1))


def genotype_triples(text: Column) -> Column:
    """Array of ``struct<rsid, genotype>`` for every backticked rsID/position/genotype."""
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(TRIPLE), F.lit(1)).alias("rsid"),
        F.regexp_extract_all(text, F.lit(TRIPLE), F.lit(2)).alias("genotype"),
    )


def strip_inline_code(line: Column) -> Column:
    return F.regexp_replace(line, "`[^`]*`", " ")


def stable_class_cited(line: Column) -> Column:
    return line.rlike(word_alternation(K.STABLE_CLASS_MARKERS))


def phrase_literal(phrase: str) -> str | None:
    """The fixed text a phrase pattern requires, or None for a pattern that is not plain text
    between word boundaries."""
    text = phrase.replace(r"\b", "").replace(r"\.", ".")
    return None if re.search(r"[\\^$*+?{}\[\]|()]", text) else text


def may_hold_phrase(line: Column, phrases=K.HEDGE_PHRASES) -> Column:
    literals = [phrase_literal(p) for p in phrases]
    return F.lit(True) if None in literals else may_contain(line, literals)


def share_no_word(phrases) -> bool:
    """True when all phrases are plain text and no word is in two of them, so that no two
    matches can overlap and one alternation finds what separate searches would."""
    literals = [phrase_literal(p) for p in phrases]
    if None in literals:
        return False
    words = [w for x in literals for w in set(x.lower().split())]
    return len(words) == len(set(words))


def _searches(phrases, cited: bool) -> list[str]:
    """The patterns to run on a line; a cited line lets the stable ``likely-*`` classes stand."""
    # The exemption is for a match that begins with ``likely``; it looks on from there.
    stable = r"(?!likely-(?:pathogenic|benign))"
    parts = [f"{stable}(?:{p})" if cited else p for p in phrases]
    if share_no_word(phrases):
        parts = ["|".join(f"(?:{p})" for p in parts)]
    return ["(?iuU)" + p for p in parts]


def phrase_matches(line: Column, phrases=K.HEDGE_PHRASES) -> Column:
    """All matches of all phrases in one line, stable ``likely-*`` classes left out when
    the line is cited. Line-state exemptions are applied by the caller."""

    def search(scan):
        def run(cited):
            return F.concat(*[
                F.regexp_extract_all(scan, F.lit(p), F.lit(0)) for p in _searches(phrases, cited)
            ])

        return F.when(stable_class_cited(line), run(True)).otherwise(run(False))

    return F.when(may_hold_phrase(line, phrases), let(strip_inline_code(line), search)).otherwise(
        no_strings()
    )


def narrow_hit(line: Column) -> Column:
    return line.rlike("(?iu)" + word_alternation(K.NARROW_PHRASES))


def section_exempt(heading: Column) -> Column:
    low = F.lower(heading)
    return low.contains("glossary") | low.contains("appendix")


def term_hits(line: Column, terms) -> Column:
    """Sorted distinct project terms present as whole words, any case."""
    terms = sorted(set(terms))
    if not terms:
        return no_strings()
    flags = [
        F.when(line.rlike(rf"(?iuU)\b{re.escape(t)}\b"), F.lit(t)) for t in terms
    ]
    return F.array_compact(F.array(*flags))


def fixed_round(value: Column, digits: int) -> Column:
    """Round for display, half to even on the binary value. For values of one and more; a tie
    below the first kept digit (0.0005 at three digits) goes to zero."""
    return F.regexp_replace(F.format_number(value, digits), ",", "").cast("double")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def slug(heading: Column) -> Column:
    """Heading to anchor: lower case, punctuation dropped, spaces to hyphens."""
    kept = F.regexp_replace(F.lower(strip(heading)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(kept, r"(?U)\s", "-")
