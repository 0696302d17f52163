"""Cleanup and speech rewriting of text columns, as SQL expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPACE, SPACES, bind, jvm
from .speech_rules import GENERAL, MEDICAL, ROMAN, STATS, SYMBOLS, UNITS

#: Spacing accents and their combining forms.
ACCENTS = {
    "¨": "̈", "´": "́", "`": "̀", "ˆ": "̂", "˜": "̃", "˚": "̊",
    "¸": "̧", "¯": "̄", "ˇ": "̌", "˘": "̆", "˙": "̇", "˝": "̋",
}
#: Ligatures of one character and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
ACCENTED = r"(\p{L})[ \t]?([" + "".join(ACCENTS) + r"])[ \t]?"


def _replace(c: Column, pattern: str, to: str = "", ignore_case: bool = False) -> Column:
    return F.regexp_replace(c, jvm(pattern, ignore_case), to)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def spaced(c: Column) -> Column:
    """Runs of white space as one space, none at the ends. Texts with single spaces only are left at one look."""
    other = SPACE.replace(" ", "", 1)
    return trimmed(bind(c, lambda x: F.when(x.rlike(f"[{other}]|  "), _replace(x, r"\s+", " ")).otherwise(x)))


def _composites() -> dict[str, str]:
    """A letter and a combining mark, and the character that they make: all such pairs of the basic plane, by rule."""
    out = {}
    for code in range(0xC0, 0x10000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.combining(pair[1]) and unicodedata.normalize("NFC", pair) == chr(code):
                out[pair] = chr(code)
    return out


COMPOSITES = _composites()
#: Of the marks of these, their classes: a mark reaches its letter over marks of lower ones.
CLASSES = {pair[1]: unicodedata.combining(pair[1]) for pair in COMPOSITES}


def composed(c: Column) -> Column:
    """Letters and the combining marks after them as one character where there is one: canonical composition of texts whose
    marks stand in canonical order."""
    group = r"\p{L}\p{Mn}+"
    pairs, classes = (F.from_json(F.lit(json.dumps(x)), f"map<string,{t}>") for x, t in ((COMPOSITES, "string"), (CLASSES, "int")))

    def step(s: Column, mark: Column) -> Column:
        rank = F.coalesce(F.try_element_at(classes, mark), F.lit(0))
        both = F.when((s["rest"] == "") | (rank > s["rank"]), F.try_element_at(pairs, F.concat(s["letter"], mark)))
        left = F.struct(s["letter"].alias("letter"), F.concat(s["rest"], mark).alias("rest"), rank.alias("rank"))
        return F.when(both.isNotNull(), F.struct(both.alias("letter"), s["rest"].alias("rest"), s["rank"].alias("rank"))).otherwise(left)

    def single(m: Column) -> Column:
        start = F.struct(F.substr(m, F.lit(1), F.lit(1)).alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("rank"))
        marks = F.array_remove(F.split(F.substr(m, F.lit(2), F.length(m)), ""), "")
        return F.aggregate(marks, start, step, lambda s: F.concat(s["letter"], s["rest"]))

    def rebuilt(x: Column) -> Column:
        new = F.transform(F.regexp_extract_all(x, F.lit(group), F.lit(0)), single)
        gaps = F.split(x, group, -1)
        return bind(new, lambda n: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(n, i), F.lit("")))), ""))

    return F.when(c.rlike(group), bind(c, rebuilt)).otherwise(c)


def refit_accents(c: Column) -> Column:
    """Put spacing accents back on their letters."""
    # An accent that follows no letter stays a spacing one.
    kept_of = lambda x: F.aggregate(
        F.split(x, f"(?<=\\p{{L}})(?=[ \\t]?[{''.join(ACCENTS)}])"),
        F.lit(""),
        lambda out, part: F.concat(
            out,
            F.when(
                (out != "") & part.rlike(f"^[ \\t]?[{''.join(ACCENTS)}]"),
                F.concat(
                    F.translate(F.regexp_extract(part, f"^[ \\t]?([{''.join(ACCENTS)}])", 1), "".join(ACCENTS), "".join(ACCENTS.values())),
                    F.regexp_replace(part, f"^[ \\t]?[{''.join(ACCENTS)}][ \\t]?", ""),
                ),
            ).otherwise(part),
        ),
    )
    return bind(c, lambda x: F.when(x.rlike(ACCENTED), composed(kept_of(x))).otherwise(x))


def clean_characters(c: Column) -> Column:
    """All of :func:`normalize` but the accents."""
    for glyph, letters in LIGATURES.items():
        c = F.replace(c, F.lit(glyph), F.lit(letters))
    c = F.regexp_replace(c, "[\\u00AD\\u200B-\\u200D\\u2060\\uFEFF]", "")
    c = F.translate(c, "   ‘’‛ʼ“”„″‐‑−", "   ''''\"\"\"\"---")
    c = F.replace(c, F.lit("…"), F.lit("..."))
    return bind(spaced(c), lambda x: F.when(x.rlike("[–—]"), _replace(x, r"\s+[–—]\s+", ", ")).otherwise(x))


def normalize(c: Column) -> Column:
    """Repair what source formats leave in text; null becomes empty."""
    return clean_characters(refit_accents(F.coalesce(c, F.lit(""))))


#: Repairs of punctuation, in the order in which they apply.
REPAIRS = (
    (r"\s+([,;:.!?])", "$1"), (r"([(\[])\s+", "$1"), (r"\s+([)\]])", "$1"), (r"\(\s*\)|\[\s*\]", ""),
    (r"([,;:])\s*([,;:.])", "$2"), (r"\.{2,}(?!\.)", "."), (r"\s{2,}", " "), (r"^\s*[,;:]\s*", ""), (r"^\s+|\s+$", ""),
)


def tidy(c: Column) -> Column:
    """Repair punctuation after something was removed. Texts in which no repair finds anything are left at one look."""

    def repaired(x: Column) -> Column:
        for pattern, to in REPAIRS:
            x = _replace(x, pattern, to)
        return x

    return bind(c, lambda x: F.when(x.rlike(jvm("|".join(f"(?:{p})" for p, _ in REPAIRS))), repaired(x)).otherwise(x))


def strip_addresses(c: Column) -> Column:
    return tidy(bind(c, lambda x: F.when(x.rlike("(?i)doi|http|www|@"), _without_addresses(x)).otherwise(x)))


def _without_addresses(c: Column) -> Column:
    c = _replace(c, r"\bdoi:?\s*10\.\d{4,9}/[^\s\"'<>]+", "", True)
    c = _replace(c, r"\b(?:https?://|www\.)[^\s<>\"']+", "", True)
    return _replace(c, r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "", True)


#: What makes the inside of a parenthesis a quantity, words that lead in a source, names, years after names.
QUANTITY = (
    r"\b(?:p\s*[<>=≤≥]|n\s*=|CI\b|SD\b|SEM\b|IQR|df\s*=|r\s*=|R2|χ2|chi|HR\s*[=:]|OR\s*[=:]|RR\s*[=:]|AUC|mean|median|range"
    r"|SE\s*=|β|beta\s*=|%|\d+\s*(?:mg|kg|mL|ml|µg|mcg|mmol|mmHg|years?|months?|weeks?|days?|hours?|patients?|participants?)\b)"
)
LEAD_WORDS = r"^(?:e\.?g\.?|i\.?e\.?|see(?:\s+also)?|cf\.?|reviewed\s+in|adapted\s+from|data\s+from|refs?\.?|but\s+see)[,:;]?\s*"
NAME = r"[A-Z][a-zA-ZÀ-ɏ'’-]{2,}"
NAMED_YEAR = r",\s*(?:see\s+)?[A-Z][\w'’-]+(?:\s+(?:et\s+al\.?|and\s+[A-Z][\w'’-]+))?,?\s*\((?:1[5-9]|20)\d{2}\)\s*(?=[.;]|$)"


def looks_like_citation(inner: Column) -> Column:
    """Whether the inside of a parenthesis is an author and a year and little else."""
    return bind(trimmed(_replace(inner, LEAD_WORDS, "", True)), _is_citation)


def _is_citation(body: Column) -> Column:
    words = F.split(body, jvm(r"\s+"), -1)
    prose = F.filter(words, lambda w: w.rlike(jvm(r"^[a-z]{3,}$")) & ~w.isin("and", "et", "al", "see", "in", "of", "the"))
    return (
        (body != "") & (F.length(body) <= 160) & ~body.rlike(jvm(QUANTITY, True)) & body.rlike(jvm(r"\b(?:1[5-9]|20)\d{2}[a-z]?\b"))
        & body.rlike(jvm(rf"\bet\s+al\b|\b{NAME}\s*(?:&|\band\b)\s*[A-Z]|^{NAME}"))
        & (F.size(prose) <= F.greatest(F.lit(1.0), F.size(words) * 0.3))
    )


def strip_citations(c: Column) -> Column:
    return tidy(bind(c, lambda x: F.when(x.rlike(r"[\[(]"), _without_citations(x)).otherwise(x)))


def _without_citations(c: Column) -> Column:
    c = _replace(c, r"\[\s*\d{1,3}(?:\s*[–—,;-]\s*\d{1,3})*\s*\]", "")
    group = r"\(([^()]{2,180})\)"

    def rebuilt(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(group), F.lit(0))
        kept = F.transform(found, lambda m: F.when(looks_like_citation(F.substr(m, F.lit(2), F.length(m) - 2)), "").otherwise(m))
        gaps = F.split(x, group, -1)
        return bind(kept, lambda k: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(k, i), F.lit("")))), ""))

    c = bind(c, lambda x: F.when(x.rlike(group), rebuilt(x)).otherwise(x))
    return _replace(c, NAMED_YEAR, "")


#: What a sentence of single spaces needs at least for one of the repairs, addresses or citations to find a place.
#: The first character decides, so that most places cost one look.
UNTIDY = (
    r"[SP,;:.\[(@dDhHwW](?:(?<=[\[(@])|(?<=[SP])[SP,;:.!?)\]]|(?<=[,;:])[SP]*[,;:.]|(?<=\.)\.|(?<=^[SP,;:])|(?<=[SP])\z|(?i:(?<=d)oi|(?<=h)ttp|(?<=w)ww))"
).replace("SP", SPACE)


def spoken(c: Column, skip_citations: bool = True, full: bool = True) -> Column:
    """A sentence as it is to be spoken: without addresses (and citations), in words. One look tells that nothing is to be
    removed or repaired."""

    def cleaned(x: Column) -> Column:
        x = strip_addresses(x)
        return tidy(strip_citations(x) if skip_citations else x)

    return expand_for_speech(bind(c, lambda x: F.when(x.rlike(UNTIDY), cleaned(x)).otherwise(x)), full)


#: What each rule needs at least: a digit, one of these signs, two capitals, or one of these at the start of a word. Most
#: sentences have none, and one look saves them all rules.
NOTATION = (
    r"[0-9/°µμ<>=≤≥±≈≃≠×αβγΔ∆κχ~]|[A-Z](?:[A-Z]|(?<=U)\.?[SK]|(?<=N)aCl)|(?<![A-Za-z0-9_])(?i:qol|cmho|mmhg|et[^a-z]+al|e\.[^a-z]?g|i\.[^a-z]?e"
    r"|vs(?![a-z])|cf\.|etc(?![a-z])|viz(?![a-z])|approx(?![a-z])|suppl|dr\.|prof\.|(?:phase|grade|class|stage|type|factor|trial)[^a-z]+[ivx])"
)
#: Rules that follow one another and share a look at what they need.
TOGETHER = 6


def expand_for_speech(c: Column, full: bool = True) -> Column:
    """Rewrite notation as words; ``full`` false takes the symbols only."""
    tidied = lambda x: trimmed(_replace(_replace(x, r"\s{2,}", " "), r"\s+([,;:.!?])", "$1"))
    untidy = jvm(r"\s(?=[\s,;:.!?])")
    out = bind(c, lambda x: F.when(x.rlike(NOTATION), _rewritten(x, full)).otherwise(x))
    return trimmed(bind(out, lambda x: F.when(x.rlike(untidy), tidied(x)).otherwise(x)))


def required(pattern: str) -> list[str]:
    """Literals of which a text must hold one for the pattern to find a place: of each alternative at the top the rarest run of
    plain characters that nothing makes optional, or else the members of a small class."""
    if len(parts := _top_alternatives(pattern)) > 1:
        return [x for p in parts for x in required(p)]
    runs, classes, run, i = [], [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "(":
            end = i + _group(pattern[i:])
        elif c == "[":
            end = pattern.index("]", i) + 1
        else:
            end = i + 1 + (c == "\\")
        atom = pattern[i:end]
        quantifier = re.match(r"[?*+]|\{\d+(?:,\d*)?\}", pattern[end:])
        literal = atom if len(atom) == 1 else atom[1] if len(atom) == 2 and not atom[1].isalnum() else ""
        if literal and not quantifier:
            run += literal
        else:
            runs, run = [*runs, run], ""
            if c == "[" and not quantifier and not re.search(r"[\\^]|.-.", atom[1:-1]):
                classes.append(list(atom[1:-1]))
        i = end + (quantifier.end() if quantifier else 0)
    weigh = lambda r: sum(0 if x == "." else 9 if not x.isascii() or not x.isalnum() and x not in " -" else 3 if x.isupper() or x.isdigit() else 1 for x in r)
    return max([*([r] for r in (*runs, run) if r), *classes], key=lambda x: min(map(weigh, x)), default=[""])


def _group(pattern: str) -> int:
    """The length of the group that a pattern begins with."""
    depth, i = 0, 0
    while True:
        depth += {"(": 1, ")": -1}.get(pattern[i], 0)
        i += 2 if pattern[i] == "\\" else 1
        if not depth:
            return i


def _top_alternatives(pattern: str) -> list[str]:
    out, start, i = [], 0, 0
    while i < len(pattern):
        if pattern[i] == "|":
            out.append(pattern[start:i])
            start = i + 1
        i += _group(pattern[i:]) if pattern[i] == "(" else 2 if pattern[i] == "\\" else 1
    return [*out, pattern[start:]]


def _rewritten(c: Column, full: bool) -> Column:
    """All rules in their order. Rules are indexed by the literals that they need: a few neighbours run only where the text
    holds what one of them needs, so a sentence pays for the rules that it has notation for."""
    rules = [(p.replace("{m}", "[µμ]"), to, "i" in flags) for p, to, flags in ((*UNITS, *STATS, *MEDICAL, *GENERAL, *SYMBOLS) if full else SYMBOLS)]
    if full:
        rules += [(rf"\b(phase|grade|class|stage|type|factor|trial)\s+{number}\b", f"$1 {word}", False) for number, word in ROMAN]
    for k in range(0, len(rules), TOGETHER):
        c = bind(c, _neighbours(rules[k : k + TOGETHER]))
    return c


def _neighbours(rules: list[tuple[str, str, bool]]) -> Callable[[Column], Column]:
    needs = dict.fromkeys((x.lower() if i else x, i) for p, _, i in rules for x in required(p))

    def rewritten(x: Column) -> Column:
        out, found = x, F.lit(False)
        for literal, ignore_case in needs:
            found = found | F.contains(F.lower(x) if ignore_case else x, F.lit(literal))
        for pattern, to, ignore_case in rules:
            out = _replace(out, pattern, to, ignore_case)
        return F.when(found, out).otherwise(x)

    return rewritten


#: Labels of front matter.
LABELS = (
    r"citation|published|copyright|received|accepted|submitted|revised|editor|academic\s+editor|data\s+availability|funding"
    r"|competing\s+interests?|conflicts?\s+of\s+interest|correspondence|reprints?|peer\s+review|article\s+history|keywords?"
    r"|abbreviations?|orcid|how\s+to\s+cite|licen[cs]e"
)


#: A word of letters with at most one sign after it, and what else the tests look for.
WORDLIKE = r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ'’-]{2,}[.,;:)]?"
NUMBERS_ONLY, LICENCE = jvm(r"^[\d\s.,;:|/–—-]+$"), jvm(r"^(this\s+article|open\s+access|creative\s+commons)\b", True)
CLOSED, BULLET, SIX = jvm(r"[.!?:]$"), "^[•\\-–]", r"(.)\1{5,}"
#: A text with single spaces that is one token again and again.
ONE_TOKEN = r"^([^ ]++)(?: \1){2,}+\z"


def _noise_tests(t: Column, single: Column, kind: Column) -> dict[str, Column]:
    """The tests over a trimmed text, and over the same with single spaces: those of tokens count places of patterns in it."""
    n, heading = F.length(t), kind == "heading"
    count = lambda pattern: F.regexp_count(single, F.lit(pattern))
    n_tokens = F.length(single) - F.length(F.translate(single, " ", "")) + 1
    wordlike = count(f"(?<![^ ]){WORDLIKE}(?![^ ])")
    return {
        "short": n < 3,
        "numbers": t.rlike(NUMBERS_ONLY),
        "front_matter": t.rlike(jvm(rf"^({LABELS})\s*[:.]", True)),
        "licence": (n < 300) & t.rlike(LICENCE),
        "no_vowel": ~t.rlike("[aeiouyAEIOUY]"),
        "fragment": ~heading & (n < 17) & ~t.rlike(CLOSED) & ~t.rlike(BULLET),
        "digits": (n > 12) & ((n - F.length(F.translate(t, "0123456789.,%", ""))) / n > 0.55),
        "few_words": (n > 16) & bind(n_tokens, lambda k: (k >= 4) & (wordlike / k < 0.4)),
        "one_word": F.lower(single).rlike(ONE_TOKEN),
        "numbered_heading": heading & (count("[^ ]*[0-9][^ ]*") >= 2),
        "repeated": t.rlike(SIX),
    }


def noise_reasons(text: Column, kind: Column) -> dict[str, Column]:
    """The tests for noise by name; a block is noise if one holds."""
    return _noise_tests(trimmed(text), spaced(text), kind)


def is_noise(text: Column, kind: Column) -> Column:
    """Whether one of the tests holds; the text is trimmed once for all of them."""

    def judged(t: Column, single: Column) -> Column:
        out = F.lit(False)
        for test in _noise_tests(t, single, kind).values():
            out = out | F.coalesce(test, F.lit(False))
        return out

    return bind(trimmed(text), lambda t: bind(spaced(t), lambda single: judged(t, single)))


#: A short word of capitals and digits.
LOUD = "[A-Z0-9][A-Z0-9.%-]{1,6}"


def is_acronym_soup(c: Column) -> Column:
    """At least three words, over 70 % of them short and of capitals and digits."""

    def judged(single: Column) -> Column:
        words = F.regexp_count(single, F.lit(r"[^ ]*\w[^ ]*"))
        return bind(F.regexp_count(single, F.lit(f"(?<![^ ]){LOUD}(?![^ ])")), lambda loud: (loud >= 3) & (loud / words > 0.7))

    return bind(spaced(c), judged)


def is_speakable(c: Column) -> Column:
    words = F.regexp_extract_all(c, F.lit("[A-Za-zÀ-ɏ]{2,}"), F.lit(0))
    return bind(words, lambda w: (F.length(F.array_join(w, "")) >= 4) & ((F.size(w) >= 2) | (F.length(F.get(w, 0)) >= 4)))


def looks_like_reference(c: Column) -> Column:
    year = c.rlike(jvm(r"\b(19|20)\d{2}[a-z]?[.;)]"))
    initials = c.rlike(jvm(r"\b[A-Z][a-z]+,?\s+[A-Z]{1,3}[.,]"))
    journal = c.rlike(jvm(r"\b(J|Am|Br|Eur|N\s?Engl|Lancet|BMJ|JAMA|Nature|Science|Proc|Ann|Arch|Int)\b\.?\s"))
    pages = c.rlike(jvm(r"\b\d+\s*[:(]\s*\d+")) | c.rlike(jvm(r"\b\d+[–-]\d+\b\s*\.?\s*$"))
    return (F.length(c) >= 25) & ((year & (initials | journal)) | (initials & pages))
