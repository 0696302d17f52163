"""Sentence splitting with one pattern over a whole text.

A sentence ends at a terminator that none of the cases of KEPT claims and after which a sentence can start. All of them are
assertions around the terminator, so the pattern engine judges every terminator of a text in one pass, within the JVM.
Sentences over the limit are cut at the best of their inner breaks: each class of breaks offers at most one place, the first
in its favoured part or else the last before that, and the best class with a place wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import SPACE, SPACES, bind, jvm
from ..functions.text import trimmed

LIMIT = 300
#: Words whose period ends no sentence.
ABBREVIATIONS = (
    "dr mr mrs ms prof st jr sr rev hon vs etc al cf ca approx viz ibid eg ie fig figs tab tabs eq eqs ref refs no nos pp p vol "
    "ed eds chap sect sec suppl appx inc ltd co corp dept univ est min max i.e e.g et mg ml kg cm mm jan feb mar apr jun jul aug "
    "sep sept oct nov dec gen col lt capt sgt gov sen messrs mt ave blvd rd assn natl kb mb gb hr hrs secs wk wks yr yrs"
).split()
#: Letters, opening and closing signs, and labels of captions.
LETTER, OPENERS, CLOSERS = r"A-Za-zÀ-ɏ", r"\"'“‘(\[{", r"\"'”’)\]}"
LABELS = r"fig(?:ure)?|table|chart|scheme|box|exhibit|panel|eq(?:uation)?|ref(?:erence)?|supplementary \w{1,60}"
#: What stands after a terminator if a sentence can start there; a digit needs a space.
START = rf"(?=[{SPACE}]+[{OPENERS}]*(?:[A-Z0-9•—–]|\z)|[{OPENERS}]*(?:[A-Z•—–]|\z))"
#: Cases in which a period ends no sentence, each as an assertion just after it.
KEPT = {
    "decimal": r"(?!(?<=[0-9]\.)[0-9])",
    "initial": rf"(?<!(?<![{LETTER}])[A-Z]\.)",
    "abbreviation": rf"(?<!(?<![A-Za-z.])\.{{0,9}}(?i:{'|'.join(x.replace('.', chr(92) + '.') for x in ABBREVIATIONS)})\.)",
    "letter after a period": r"(?<!(?<![A-Za-z.])\.{1,9}[A-Za-z]\.)",
    "inner period of an abbreviation": rf"(?!(?<=[{LETTER}]\.)[A-Za-z]{{1,2}}\.)",
    "list number": r"(?<!^[0-9. ]{0,80}[0-9]\.)",
    "caption": rf"(?<!^(?i:{LABELS})\.? ?[0-9]{{1,9}}\.)",
}
END = rf"(?:[!?]|(?<!\.)\.(?!\.){''.join(KEPT.values())}{START}|(?<=\.)\.(?=[{SPACE}]){START})[{CLOSERS}]*[.!?]*"
#: Marks the ends that were found; no character of any text.
MARK = "\uffff"
#: Where a long sentence may be cut, best first, each with its length.
BREAKS = (
    (rf"[{SPACE}][—–-][{SPACE}](?=[^{SPACE}])", 3), (rf";[{SPACE}](?=[^{SPACE}])", 2), (rf":[{SPACE}](?=[^{SPACE}])", 2),
    (
        rf",[{SPACE}](?=(?i:and|but|or|nor|yet|so|which|while|whereas|although|though|because|since|before|after|unless|whether|if)(?![A-Za-z0-9_]))",
        2,
    ),
    (rf",[{SPACE}](?=[^{SPACE}])", 2), (rf"[{SPACE}](?=[^{SPACE}])", 1),
)
#: The shares of the limit from which a break is favoured, and before which it isn't taken.
FAVOURED, LEAST = 0.45, 0.35
#: Long sentences are cut in stretches of this many limits.
STRETCH = 16


def _cut_length(head: Column, limit: int) -> Column:
    """How much of the first ``limit`` characters of a longer sentence to cut off."""
    favoured, least = int(limit * FAVOURED) + 1, int(limit * LEAST) + 1
    offers = []
    for pattern, n in BREAKS:
        first, last = rf"(?s)^.{{{favoured},}}?{pattern}", rf"(?s)^.{{{max(0, least - n)},{favoured - 1}}}{pattern}"
        offers += [F.nullif(F.length(F.regexp_extract(head, p, 0)), F.lit(0)) for p in (first, last)]
    word = F.nullif(F.length(F.regexp_extract(head, "(?s)^.+ ", 0)), F.lit(0))
    return F.coalesce(*offers, word, F.lit(limit))


def _within(piece: Column, limit: int) -> Column:
    """A sentence with single spaces as an array of parts within the limit.

    It is cut stretch by stretch, with what the last one left in front, so that a cut copies a stretch and not the whole rest.
    """
    size = limit * STRETCH
    left = lambda x: F.ltrim(x, F.lit(SPACES))

    def cuts(rest: Column, most: Column) -> Column:
        """Parts and rest of a text from which parts are cut while it is longer than ``most``."""

        def step(s: Column, _: Column) -> Column:
            def cut(n: Column) -> Column:
                part = trimmed(F.substr(s["rest"], F.lit(1), n))
                return F.struct(F.concat(s["parts"], F.array(part)).alias("parts"), left(F.substr(s["rest"], n + 1, F.length(s["rest"]))).alias("rest"))

            return F.when(F.length(s["rest"]) > most, bind(_cut_length(F.substr(s["rest"], F.lit(1), F.lit(limit)), limit), cut)).otherwise(s)

        # A cut takes LEAST of the limit or more, but before a word that is longer than the rest of it; the cut after that does.
        steps = F.sequence(F.lit(1), F.ceil(F.length(rest) / max(1, int(limit * LEAST))).cast("int") * 2 + 1)
        return F.aggregate(steps, F.struct(F.array().cast("array<string>").alias("parts"), rest.alias("rest")), step)

    def stretches(all_of: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            # Before the last stretch, one more character must follow: the space that a cut may leave in front.
            most = F.when(i == F.size(all_of) - 1, limit).otherwise(limit + 1)
            return bind(
                bind(F.concat(s["rest"], F.get(all_of, i)), lambda rest: cuts(left(rest), most)),
                lambda x: F.struct(F.concat(s["parts"], F.array(x["parts"])).alias("parts"), x["rest"].alias("rest")),
            )

        start = F.struct(F.array().cast("array<array<string>>").alias("parts"), F.lit("").alias("rest"))
        return F.aggregate(F.sequence(F.lit(0), F.size(all_of) - 1), start, step, lambda s: F.concat(F.flatten(s["parts"]), F.array(s["rest"])))

    return bind(F.regexp_extract_all(piece, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), stretches)


def sentences(text: Column, limit: int = LIMIT) -> Column:
    """Array of the sentences of a text column, none longer than ``limit``; empty for null."""
    flat = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), jvm(r"\s+"), " "))
    marked = bind(flat, lambda x: F.when(x.rlike("[.!?]"), F.regexp_replace(x, END, f"$0{MARK}")).otherwise(x))
    pieces = F.filter(F.transform(F.split(marked, MARK, -1), trimmed), lambda p: p != "")
    return bind(
        pieces,
        lambda ps: F.when(~F.exists(ps, lambda p: F.length(p) > limit), ps).otherwise(
            F.filter(F.flatten(F.transform(ps, lambda p: _within(p, limit))), lambda p: p != "")
        ),
    )
