r"""Format-preserving Feistel pseudonyms for private values in texts.

A private value is found by its pattern, checked by the rules of its kind (check digits, number ranges, calendar dates),
and then permuted by a keyed Feistel network within its own format: digits become digits, letters letters, a card number
stays a valid card number, a date a date of the same century block. The permutation depends on the key and the value
alone, so equal values get equal pseudonyms in every document, and different values of a kind and format never collide.

Two networks are used. Numbers of a fixed range (dates, addresses, social security numbers) run over residues of two
factors of that range. All other values run over their characters: the halves of the string take turns in shifting each
other, digits modulo 10, letters modulo 26 in their case, hexadecimal secrets modulo 16; other characters stay.

Defined results: a null text stays null; a text without private values is returned as it is; values that fail their check
(a 16-digit number with a wrong check digit) are left alone, and so are addresses whose local part is over 64 characters;
repeated rows and extra columns pass through; an extra column named ``n_private`` is replaced; an empty table gives an empty
one. Work is row by row on whole texts of any length: no shuffle, no state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 6
#: Kinds and their patterns, tried in this order at each place of a text. Possessive and bounded, so linear in the text.
KINDS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,8}[A-Za-z]{2,24}"),
    ("secret", r"(?<![A-Za-z0-9])(?:(?i:password|passwd|pwd|secret|token|api_key)\s?[=:]\s?\"?[A-Za-z0-9]{8,}+\"?|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"),
    ("date", r"(?<![0-9\-/])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-/])"),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\- ])[0-9]{3}[.\- ][0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"),
)
PATTERN = "|".join(p for _, p in KINDS)
#: Only texts with one of these can hold a private value.
GATE = r"[0-9@]|(?i:password|passwd|pwd|secret|token|api_key)\s?[=:]"
#: The shape that tells the kind of a matched value; what has none of these is a phone number.
SHAPES = (
    ("email", "@"), ("secret", r"^(?:(?i:password|passwd|pwd|secret|token|api_key)\s?[=:]|AKIA|ASIA)"), ("iban", r"^[A-Z]{2}[0-9]{2}"),
    ("ip", r"^(?:[0-9]{1,3}\.){3}"), ("date", r"^[0-9]{4}-[0-9]{2}-"), ("ssn", r"^[0-9]{3}-[0-9]{2}-"), ("card", r"^[0-9](?:[ \-]?[0-9]){12,18}$"),
)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _chars(s: Column) -> Column:
    return F.array_remove(F.split(s, "", -1), "")


def _rest(s: Column, start: Column | int) -> Column:
    """``s`` from its ``start``-th character on."""
    return F.substr(s, F.lit(start) if isinstance(start, int) else start, F.length(s))


def _rounds(a: Column, b: Column, change: Callable[[Column, Column, str, int], Column], done: Callable[[Column, Column], Column]) -> Column:
    """Feistel rounds: ``b`` changes by ``a``, then ``a`` by ``b``, and so on. ``change(half, other, label, which)``."""

    def odd(r: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(change(s["a"], s["b"], str(r), 0).alias("a"), s["b"].alias("b"))

    def even(r: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["a"].alias("a"), change(s["b"], s["a"], str(r), 1).alias("b"))

    state = F.struct(a.alias("a"), b.alias("b"))
    for r in range(ROUNDS):
        state = let(state, odd(r) if r % 2 else even(r))
    return let(state, lambda s: done(s["a"], s["b"]))


def _permuted_number(a: Column, b: Column, sizes: tuple, key: str, kind: str, done) -> Column:
    """Network over pairs of residues of ``sizes``; ``done`` gets the new pair."""

    def change(half: Column, other: Column, label: str, which: int) -> Column:
        digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind + label), other.cast("string")), 256)
        return (half + F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long")) % sizes[which]

    return _rounds(a.cast("long"), b.cast("long"), change, done)


def permuted(value: Column, key: str, kind: str, hexa: bool = False) -> Column:
    """Network over the characters of ``value``, each moved within its class."""
    classes = (("[0-9a-f]", DIGITS + "abcdef"),) if hexa else (("[0-9]", DIGITS), ("[a-z]", LOWER), ("[A-Z]", UPPER))

    def change(half: Column, other: Column, label: str, which: int) -> Column:
        stream = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind + label), other), 512)

        def moved(c: Column, i: Column, st: Column) -> Column:
            # Two hexadecimal digits of the stream for each character; longer halves go round it with another offset.
            at = (i * 2 % 126 + 1).cast("int")
            by = F.conv(F.substr(st, at, F.lit(2)), 16, 10).cast("int") + F.floor(i / 63).cast("int") * 7
            out = c
            for test, alphabet in classes:
                to = (F.instr(F.lit(alphabet), c) - 1 + by) % len(alphabet) + 1
                out = F.when(c.rlike(test), F.substr(F.lit(alphabet), to.cast("int"), F.lit(1))).otherwise(out)
            return out

        return let(stream, lambda st: F.array_join(F.transform(_chars(half), lambda c, i: moved(c, i, st)), ""))

    half = F.floor(F.length(value) / 2).cast("int")
    return _rounds(F.substr(value, F.lit(1), half), _rest(value, half + 1), change, F.concat)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    weighed = F.transform(
        F.reverse(_chars(digits)),
        lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10


def _refilled(shape: Column, chars: Column, slots: str) -> Column:
    """Put ``chars`` one by one in the places of ``shape`` that match ``slots``; separators stay where they are."""
    return F.aggregate(
        _chars(shape),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda a, c: F.when(
            c.rlike(slots),
            F.struct(F.concat(a["s"], F.substr(chars, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i")),
        ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))),
        lambda a: a["s"],
    )


def _within(v: Column, valid: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """Change the whole of ``v`` if it is valid, else the longest valid part of it that begins and ends with a group."""
    n, group = F.length(v), "[ \\-]"
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | F.substr(v, i - 1, F.lit(1)).rlike(group))
    ends = F.filter(F.sequence(F.lit(1), n), lambda j: (j == n) | F.substr(v, j + 1, F.lit(1)).rlike(group))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(ends, lambda j: F.struct((j - i + 1).alias("n"), (-i).alias("at")))))
    part = lambda p: F.substr(v, -p["at"], p["n"])
    found = F.array_max(F.filter(parts, lambda p: (p["n"] > 12) & valid(part(p))))
    bounds = F.when(valid(v), F.struct(n.alias("n"), F.lit(-1).alias("at"))).otherwise(found)

    def replaced(p: Column) -> Column:
        new = let(part(p), change)
        return F.concat(F.substr(v, F.lit(1), -p["at"] - 1), new, _rest(v, p["n"] - p["at"]))

    return let(bounds, lambda p: F.when(p.isNull(), v).otherwise(replaced(p)))


def _card(v: Column, key: str) -> Column:
    """The first digit stays, the check digit is computed anew."""

    def renewed(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))

    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    valid = lambda x: let(digits(x), lambda d: F.length(d).between(13, 19) & (_luhn(d) == 0))
    return _within(v, valid, lambda x: let(let(digits(x), renewed), lambda n: _refilled(x, n, "[0-9]")))


def _mod97(s: Column) -> Column:
    """Remainder modulo 97 of an account number, its first four characters moved to the end, letters as 10 to 35."""
    return F.aggregate(
        _chars(F.concat(_rest(s, 5), F.substr(s, F.lit(1), F.lit(4)))),
        F.lit(0),
        lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _iban(v: Column, key: str) -> Column:
    """The country stays, the check digits are computed anew."""

    def renewed(d: Column) -> Column:
        land = F.substr(d, F.lit(1), F.lit(2))
        check = lambda b: F.lpad((98 - _mod97(F.concat(land, F.lit("00"), b))).cast("string"), 2, "0")
        return let(permuted(_rest(d, 5), key, "iban"), lambda b: F.concat(land, check(b), b))

    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    valid = lambda x: x.rlike("^[A-Z]{2}[0-9]{2}") & let(plain(x), lambda d: F.length(d).between(15, 34) & (_mod97(d) == 1))
    return _within(v, valid, lambda x: let(let(plain(x), renewed), lambda n: _refilled(x, n, "[A-Z0-9]")))


def _date(v: Column, key: str) -> Column:
    """A date moves within its block of 100 years, which starts at a year 30.

    A block has 36525 = 487 * 75 days, or 36524 = 397 * 92 if its century year is no leap year.
    """

    def renewed(d: Column) -> Column:
        first = (F.floor((F.year(d) - 30) / 100) * 100 + 30).cast("int")
        start, after = (F.make_date(y, F.lit(1), F.lit(1)) for y in (first, first + 100))
        leap = F.datediff(after, start) == 36525
        p, q = F.when(leap, 487).otherwise(397), F.when(leap, 75).otherwise(92)
        n = F.datediff(d, start)
        done = lambda a, b: F.date_format(F.date_add(start, (b * p + a).cast("int")), "yyyy-MM-dd")
        return _permuted_number(n % p, F.floor(n / p), (p, q), key, "date", done)

    day = F.when(F.substr(v, F.lit(1), F.lit(4)).between("0130", "9829"), v.try_cast("date"))
    return let(day, lambda d: F.coalesce(F.when(d.isNotNull(), renewed(d)), v))


def _ip(v: Column, key: str) -> Column:
    def renewed(p: Column) -> Column:
        done = lambda a, b: F.concat_ws(".", *[(F.floor(x / d).cast("long") % 256).cast("string") for x in (a, b) for d in (256, 1)])
        return _permuted_number(F.get(p, 0) * 256 + F.get(p, 1), F.get(p, 2) * 256 + F.get(p, 3), (65536, 65536), key, "ip", done)

    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    return let(parts, lambda p: F.when(F.forall(p, lambda x: x <= 255), renewed(p)).otherwise(v))


def _ssn(v: Column, key: str) -> Column:
    """Area 000, 666 and 9xx, group 00 and serial 0000 are never issued; the others move among themselves."""
    area, group, serial = (F.substr(v, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)

    def done(a: Column, b: Column) -> Column:
        k = F.floor(a / 99).cast("long")
        number = ((k + 1 + F.when(k >= 665, 1).otherwise(0), 3), (a % 99 + 1, 2), (b + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in number])

    return F.when(valid, _permuted_number(rank * 99 + group - 1, serial - 1, (898 * 99, 9999), key, "ssn", done)).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    """The ten national digits move; the country code and the shape stay."""
    head = F.regexp_extract(v, r"^\+[0-9]{1,3}(?:[ .\-]|(?=\())", 0)
    rest = _rest(v, F.length(head) + 1)
    new = let(F.regexp_replace(rest, "[^0-9]", ""), lambda d: permuted(d, key, "phone"))
    return F.concat(head, let(new, lambda n: _refilled(rest, n, "[0-9]")))


def _email(v: Column, key: str) -> Column:
    """The local part moves; the domain stays."""
    local = F.substring_index(v, "@", 1)
    return F.concat(let(local, lambda x: permuted(x, key, "email")), _rest(v, F.length(local) + 1))


def _secret(v: Column, key: str) -> Column:
    """What stands after the sign (or after the four letters of an access key) moves; hexadecimal stays hexadecimal."""
    head = F.regexp_extract(v, r"^(?:[^=:]*[=:]\s?\"?|AKIA|ASIA)", 0)
    body = F.regexp_extract(_rest(v, F.length(head) + 1), r"^[A-Za-z0-9]+", 0)
    tail = _rest(v, F.length(head) + F.length(body) + 1)
    new = let(
        body,
        lambda b: F.when(b.rlike("^[0-9a-f]+$"), permuted(b, key, "hex", True))
        .when(b.rlike("^[0-9A-F]+$"), F.upper(let(F.lower(b), lambda x: permuted(x, key, "hex", True))))
        .otherwise(permuted(b, key, "secret")),
    )
    return F.concat(head, new, tail)


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def kind_of(v: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, shape in SHAPES:
        out = out.when(v.rlike(shape), F.lit(kind))
    return out.otherwise(F.lit("phone"))


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one matched value; the value itself if it fails the check of its kind."""

    def by_kind(kind: Column) -> Column:
        out = F.when(F.lit(False), v)
        for name, maker in MAKERS.items():
            out = out.when(kind == name, maker(v, key))
        return out

    return let(kind_of(v), by_kind)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace the private values of ``text``; append ``n_private`` (long), how many values were replaced.

    ``key`` is a secret: who has it can turn pseudonyms back.
    """
    if not key:
        raise ValueError("a key is needed")
    t = F.col(text)
    found = F.when(t.rlike(GATE), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    changed = lambda m: F.transform(m, lambda v: let(v, lambda x: pseudonym(x, key)))

    def rebuilt(m: Column) -> Column:
        return let(
            changed(m),
            lambda new: F.struct(
                F.array_join(
                    F.transform(F.split(t, PATTERN, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(new, i), F.lit("")))), ""
                ).alias("text"),
                F.size(F.filter(F.zip_with(m, new, lambda a, b: a != b), lambda x: x)).cast("long").alias("n"),
            ),
        )

    out = let(found, lambda m: F.when(F.size(m) > 0, rebuilt(m)))
    return (
        docs.withColumn("_private", out)
        .withColumns({text: F.coalesce("_private.text", t), "n_private": F.coalesce("_private.n", F.lit(0).cast("long"))})
        .drop("_private")
    )
