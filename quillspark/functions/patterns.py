r"""Write patterns once, in the usual script dialect, and get them in that of the JVM.

``\b`` means a border of ASCII word characters, ``\s`` covers all Unicode spaces, ``$`` is the very end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: The same characters as a string.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def jvm(pattern: str, ignore_case: bool = False) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two == r"\b" and not inside:
            out.append(BORDER)
        elif two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
        elif c == "\\":
            out.append(two)
        elif c == "$" and not inside:
            out.append(r"\z")
            i -= 1
        else:
            # A bracket inside a class is plain; the JVM would start a nested class.
            if c == "[" and inside:
                out.append("\\")
            elif c == "[":
                inside = True
            elif c == "]":
                inside = False
            out.append(c)
            i -= 1
        i += 2
    return ("(?iu)" if ignore_case else "") + "".join(out)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, also where that uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unfolded(df: DataFrame, array: Column | str, place: str, item: str, *kept: str) -> DataFrame:
    """A row for each item of an array, with its place, beside these columns.

    The generator is an outer one with a filter behind it: of an inner one Catalyst derives a filter over the array's size and
    moves that below, where the expression that makes the array is computed again.
    """
    return df.select(*kept, F.posexplode_outer(array).alias(place, item)).filter(F.col(place).isNotNull())
