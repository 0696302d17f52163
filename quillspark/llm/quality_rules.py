"""Quality rules as a bitmask ledger.

Every rule runs once per document. The ledger keeps the measurements and one bit per failed rule; policies are versioned
masks over those bits, so a new policy or an ablation needs no text at all.

Defined results: a null, empty or blank text has zero words, fails ``few_words`` and is not kept. Repeated rows are judged
one by one. Extra columns pass through unless they bear the name of a ledger column, which replaces them. No shuffle
takes place, so neither hot sources nor copies matter; one text is one row and is never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words

#: Bit number, name and failure test over the measurements. Bits are never reused for another meaning.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "100 * n_symbols > 30 * n_words"),
    (3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 20 * n_words"),
    (6, "shouting", "100 * n_upper > 60 * word_chars"),
)

#: Version to the names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def policy_mask(version: str) -> int:
    bits = {name: bit for bit, name, _ in RULES}
    return sum(1 << bits[name] for name in POLICIES[version])


def _repeat_words(hashes: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, given the hash of the window at each word."""

    def covered(h: Column) -> Column:
        # Sorted (hash, place) pairs put equal windows side by side.
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(
            pairs,
            lambda p: F.sort_array(
                F.filter(
                    F.transform(
                        p,
                        lambda x, k: F.when(
                            F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
                            x["i"],
                        ),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        )
        # A window covers three words, less those that the next repeated window covers as well.
        return let(
            places,
            lambda s: F.aggregate(
                F.transform(s, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - i, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )


def _word_measures(text: Column) -> Column:
    def measure(w: Column) -> Column:
        n = F.size(w)
        windows = F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            ),
        ).otherwise(F.array().cast("array<bigint>"))
        return F.struct(n.cast("long").alias("n_words"), _repeat_words(windows).alias("n_repeat_words"))

    return let(words(text), measure)


def _line_measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the measurements and ``failed_bits`` (long, one bit per rule of RULES) to each document."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(*[c for c in docs.columns if c in (*MEASURES, "failed_bits", "_w", "_l")])
    out = out.withColumns({"_w": _word_measures(t), "_l": _line_measures(t)})
    out = out.withColumns(
        {
            "n_words": F.col("_w.n_words"),
            "n_repeat_words": F.col("_w.n_repeat_words"),
            "n_lines": F.col("_l.n_lines"),
            "n_dup_lines": F.col("_l.n_dup_lines"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_upper": (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        }
    ).drop("_w", "_l")
    bits = F.lit(0).cast("long")
    for bit, _, test in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failed_bits", bits)


def apply_policy(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """Append ``base_failed`` and ``kept`` for a policy version; only ``failed_bits`` is read."""
    fails = lambda v: F.col("failed_bits").bitwiseAND(F.lit(policy_mask(v)).cast("long")) != 0
    return ledger_df.withColumn("base_failed", fails("base")).withColumn(
        "kept", ~fails("base") & ~fails(version)
    )


def ablation(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents it fails, fails alone, and that would be kept without it.

    The ledger is first summed by its bit pattern (at most 2 to the number of rules rows), then tested bit by bit.
    """
    mask = policy_mask(version)
    patterns = ledger_df.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    own = [(bit, name) for bit, name, _ in RULES if mask >> bit & 1]
    rules = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("rule")) for b, n in own]))
    rows = patterns.select("failed_bits", "n", rules.alias("r")).select("failed_bits", "n", "r.bit", "r.rule")
    one = F.expr("shiftleft(1L, bit)")
    hit = F.col("failed_bits").bitwiseAND(one) != 0
    others = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long").bitwiseXOR(one))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("bit", "rule").agg(
        count(hit).alias("n_failed"),
        count(hit & (others == 0)).alias("n_failed_alone"),
        count(others == 0).alias("n_kept_without"),
    )
