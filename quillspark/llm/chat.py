r"""Format conversations for training in budgeted windows.

Prefix sums of turn tokens choose the windows: turns are taken in order while the last system turn before the window, ``HISTORY``
tokens kept free, and the window's fresh turns stay within ``BUDGET``; the turn that would pass it begins the next window. So
windows always begin and end with whole turns. A window is written as its system turn, then the turns before its first
fresh one that fit in what is left of the budget (at most HISTORY tokens, none from before the system turn), then its fresh
turns. Only fresh assistant turns count for the loss; repeated ones are masked. A window passes the budget only if it is one
fresh turn, without history, which is too long beside its system turn. A window is named by the place of its first fresh turn.

A turn is written ``<|role|>\n`` text ``<|end|>\n``. Inside roles and texts, backslash, ``<`` and ``|`` are written
``\b``, ``\l`` and ``\p``, so no text can forge a marker, and :func:`unescape` restores it exactly.

Defined results: null texts and roles are empty strings; turns of equal number are ordered by role, then text, and nulls
come first; repeated rows are turns of their own; a null conv_id is a conversation of its own; an empty table gives an
empty result; other columns are ignored.

Prefix sums run in two levels (runs of turn numbers within a conversation, then over the runs), and windows start anew with
each CHUNK tokens of a conversation, so one with a large share of all rows isn't ordered or cut in one task. History and
system turns meet their windows by joins on narrow keys. Only :func:`digest` gathers a whole conversation, since its hash is
of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

BUDGET, HISTORY = 512, 128
#: Turn numbers to a run, and tokens after which windows start anew.
RUN, CHUNK = 4096, 8192


def escape(x: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("|", "\\p")):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for plain, code in (("|", "\\p"), ("<", "\\l"), ("\\", "\\b")):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def tokens(text: Column) -> Column:
    """Estimated tokens of a turn: four for its markers and one for every four code points."""
    return (F.lit(4) + F.ceil(F.length(text) / 4)).cast("long")


def _placed(conv: DataFrame) -> DataFrame:
    """Turns with their place (ord), the tokens before them (pre), and place and tokens of the last system turn before them."""
    t = conv.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    t = t.withColumns({"tok": tokens(F.col("text")), "run": F.coalesce(F.expr(f"turn div {RUN}"), F.lit(-(2**62)))})
    key = [F.coalesce("conv_id", F.lit(0)).alias("_c"), F.col("conv_id").isNull().alias("_n")]
    t = t.select("*", *key)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inner = W.partitionBy("_c", "_n", "run").orderBy(*order)
    before = inner.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns(
        {"ord": F.row_number().over(inner).cast("long") - 1, "pre": F.coalesce(F.sum("tok").over(before), F.lit(0)).cast("long")}
    )
    system = F.when(F.col("role") == "system", F.struct("ord", "tok"))
    t = t.withColumn("sys", F.last(system, ignorenulls=True).over(before))
    runs = t.groupBy("_c", "_n", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("run_tok"), F.max(system).alias("run_sys"))
    over = W.partitionBy("_c", "_n").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumns({"n0": F.coalesce(F.sum("n").over(over), F.lit(0)), "pre0": F.coalesce(F.sum("run_tok").over(over), F.lit(0))})
    moved = lambda s: F.when(s.isNotNull(), F.struct((s["ord"] + F.col("n0")).alias("ord"), s["tok"].alias("tok")))
    runs = runs.withColumn("run_sys", moved(F.col("run_sys"))).withColumn("sys0", F.last("run_sys", ignorenulls=True).over(over))
    t = t.join(runs.select("_c", "_n", "run", "n0", "pre0", "sys0"), ["_c", "_n", "run"]).withColumn("sys", F.coalesce(moved(F.col("sys")), F.col("sys0")))
    return t.select(
        "conv_id", "_c", "_n", "role", "text", "tok", (F.col("ord") + F.col("n0")).alias("ord"), (F.col("pre") + F.col("pre0")).alias("pre"),
        F.coalesce("sys.ord", F.lit(-1)).alias("sys_ord"), F.coalesce("sys.tok", F.lit(0)).alias("sys_tok"),
    )


def _begins(turns: Column, budget: int, history: int) -> Column:
    """Of the turns of a chunk (structs ord, pre, tok, sys_ord, sys_tok), the windows: structs ord and pre of the first fresh
    turn, last (the ord of the last one), sys_ord, and room for history."""
    none = F.array().cast("array<struct<ord:bigint,pre:bigint,last:bigint,sys_ord:bigint,sys_tok:bigint,fresh:bigint>>")

    def step(done: Column, t: Column) -> Column:
        own = F.struct(t["ord"].alias("ord"), t["pre"].alias("pre"), t["ord"].alias("last"), t["sys_ord"].alias("sys_ord"), t["sys_tok"].alias("sys_tok"), t["tok"].alias("fresh"))
        w = F.try_element_at(done, F.lit(-1))
        fits = w["fresh"] + t["tok"] + w["sys_tok"] + history <= budget
        more = F.struct(w["ord"].alias("ord"), w["pre"].alias("pre"), t["ord"].alias("last"), w["sys_ord"].alias("sys_ord"), w["sys_tok"].alias("sys_tok"), (w["fresh"] + t["tok"]).alias("fresh"))
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more))
        return F.when(F.coalesce(fits, F.lit(False)), longer).otherwise(F.concat(done, F.array(own)))

    room = lambda w: F.greatest(F.lit(0), F.least(F.lit(history), budget - w["sys_tok"] - w["fresh"]))
    return F.transform(
        F.aggregate(turns, none, step),
        lambda w: F.struct(w["ord"].alias("ord"), w["pre"].alias("pre"), w["last"].alias("last"), w["sys_ord"].alias("sys_ord"), room(w).cast("long").alias("room")),
    )


def windows(conv: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss_spans (start from 1, len), n_system, n_history, n_fresh, tokens."""
    if not 0 < history <= budget // 2:
        raise ValueError("history may take at most half of the budget")
    key = ["_c", "_n"]
    t = saved(_placed(conv).withColumn("chunk", F.expr(f"(pre + tok - 1) div {CHUNK}")))
    # Which turns stand in which windows is settled on numbers; the texts join once.
    numbers = t.drop("conv_id", "role", "text")
    chunks = numbers.groupBy(*key, "chunk").agg(F.sort_array(F.collect_list(F.struct("ord", "pre", "tok", "sys_ord", "sys_tok"))).alias("turns"))
    w = chunks.select(*key, "chunk", F.explode(_begins(F.col("turns"), budget, history)).alias("w")).select(*key, "chunk", "w.*")
    w = saved(w.withColumnsRenamed({"ord": "window", "pre": "begin"}))
    # A turn's own window is in its chunk; windows that repeat it begin within ``history`` tokens after its start.
    fresh = numbers.select(*key, "chunk", "ord").join(w.select(*key, "chunk", "window", "last"), [*key, "chunk"]).filter("ord BETWEEN window AND last")
    near = F.explode(F.array(F.expr(f"begin div {history}"), F.expr(f"begin div {history} - 1"))).alias("near")
    later = w.filter("room > 0").select(*key, "window", "begin", "room", F.col("sys_ord").alias("from"), near)
    again = numbers.select(*key, "ord", "pre", F.expr(f"pre div {history}").alias("near")).join(later, [*key, "near"])
    again = again.filter("ord < window AND ord > from AND pre >= begin - room")
    system = w.filter("sys_ord >= 0").select(*key, "window", F.col("sys_ord").alias("ord"))
    parts = [df.select(*key, "ord", "window", F.lit(kind).alias("kind")) for kind, df in enumerate((system, again, fresh))]
    t = t.select("conv_id", *key, "ord", "role", "text", "tok").join(parts[0].unionByName(parts[1]).unionByName(parts[2]), [*key, "ord"])
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    t = t.select("conv_id", *key, "window", F.struct("kind", "ord", "role", head.alias("head"), escape(F.col("text")).alias("body"), "tok").alias("m"))
    g = t.groupBy(*key, "window").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("m")).alias("parts"))
    lens = F.transform("parts", lambda x: F.length(x["head"]) + F.length(x["body"]) + 8)
    sums = F.aggregate(
        lens, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    )
    g = g.withColumn("at", sums)
    spans = F.filter(
        F.transform(
            "parts",
            lambda x, i: F.when(
                (x["kind"] == 2) & (x["role"] == "assistant"),
                F.struct((F.get("at", i) + F.length(x["head"]) + 1).alias("start"), F.length(x["body"]).alias("len")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    n = lambda kind: F.size(F.filter("parts", lambda x: x["kind"] == kind))
    return g.select(
        "conv_id", "window", F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit("<|end|>\n"))), "").alias("formatted"),
        spans.alias("loss_spans"), n(0).alias("n_system"), n(1).alias("n_history"), n(2).alias("n_fresh"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["tok"]).alias("tokens"),
    )


def turns_of(formatted: Column) -> Column:
    """Read a formatted window back: array of (role, text)."""
    parts = F.split(formatted, "<\\|end\\|>\n", -1)

    def turn(x: Column) -> Column:
        return F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(3)), "|>\n", 1)).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, "|>\n", 1)) + 4)).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def digest(formatted: DataFrame) -> DataFrame:
    """Read :func:`windows` back and digest each conversation: its turns once each, and the text under the loss mask."""
    fresh = F.slice(
        turns_of(F.col("formatted")), F.col("n_system") + F.col("n_history") + 1, F.col("n_fresh")
    )
    text = F.array_join(F.transform(fresh, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"], s["len"]))), ""
    )
    w = formatted.select("conv_id", "n_fresh", F.length("formatted").alias("chars"), F.struct("window", text.alias("t"), loss.alias("l")).alias("w"))
    g = w.groupBy("conv_id").agg(
        F.sum("n_fresh").cast("long").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.count(F.lit(1)).cast("long").alias("n_windows"),
    )
    whole = lambda k: F.array_join(F.transform("w", lambda x: x[k]), "")
    return g.select(
        "conv_id", "n_turns", F.sha2(whole("t"), 256).alias("turns_sha256"),
        F.length(whole("l")).cast("long").alias("loss_chars"), F.sha2(whole("l"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )
