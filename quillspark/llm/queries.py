"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, fill_middle, filter_audit, language, mixing, ngram_join, pieces, pseudonyms, quality_model, quality_rules, suffix_dedup, toxicity
from .common import read, saved
from .labels import fold


#: The session setting that holds the secret of the pseudonyms; the registered queries run without one, so that they can be
#: repeated, on a key that protects nothing.
KEY_SETTING, OPEN_KEY = "spark.quillspark.pseudonyms.key", "an open key, for queries that anyone may repeat"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, OPEN_KEY)


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(read(spark, sf_dir, "documents"), pseudonym_key(spark))
    return out.select("doc_id", "text", "n_private")


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, said)
    return chat.digest(chat.windows(conv.unionByName(more)))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = saved(quality_model.describe(read(spark, sf_dir, "documents")))
    scored = quality_model.score(described, quality_model.fit(described, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_bits",
    )


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """A public model file, read where the plan is made."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    coded = pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    coded = coded.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"), "ids", _span_bytes().alias("span_bytes"))
    out = pieces.decode(coded, model)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("span_bytes") == F.col("n_bytes")).alias("spans_cover"),
    )


def _span_bytes() -> Column:
    """The bytes under the spans of the pieces, which follow one another."""
    spans = F.zip_with("begins", "ends", lambda a, b: (b - a).cast("long"))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(filter_audit.measured(read(spark, sf_dir, "documents")))
    rows = filter_audit.with_labels(filter_audit.with_copies(rows), read(spark, sf_dir, "labels"))
    return filter_audit.audit(filter_audit.bitmap_index(rows))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": op1_pseudonyms,
    "op2_chat_windows": op2_chat_windows,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_toxicity": op6_toxicity,
    "op7_source_mix": op7_source_mix,
    "op8_language": op8_language,
    "op9_quality_model": op9_quality_model,
    "op10_quality_rules": op10_quality_rules,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_middle": op13_fill_middle,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE: dict[str, str] = {
    "op2_chat_windows": r"""
        WITH RECURSIVE t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 4 + CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tok,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ord
          FROM (SELECT conv_id, turn, role, text FROM conversations
                UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        p AS (
          SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY ord) - tok AS pre,
                 length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '|', '')) AS body,
                 length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '|', '')) + 5 + 8 AS marks,
                 coalesce(last_value(CASE WHEN role = 'system' THEN ord END IGNORE NULLS)
                   OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sys
          FROM t),
        q AS (SELECT p.*, coalesce(s.tok, 0) AS sys_tok, floor((p.pre + p.tok - 1) / 8192) AS chunk
              FROM p LEFT JOIN p s ON s.conv_id = p.conv_id AND s.ord = p.sys),
        -- Turn by turn: the first fresh turn of its window, and the tokens that the window has by then.
        g AS (
          SELECT conv_id, ord, chunk, ord AS w, sys AS w_sys, sys_tok AS w_sys_tok, tok AS fresh FROM q WHERE ord = 1
          UNION ALL
          SELECT q.conv_id, q.ord, q.chunk, CASE WHEN more THEN g.w ELSE q.ord END, CASE WHEN more THEN g.w_sys ELSE q.sys END,
                 CASE WHEN more THEN g.w_sys_tok ELSE q.sys_tok END, CASE WHEN more THEN g.fresh ELSE 0 END + q.tok
          FROM g JOIN (SELECT q.*, b.chunk AS b_chunk FROM q JOIN q b ON b.conv_id = q.conv_id AND b.ord = q.ord - 1) q
                 ON q.conv_id = g.conv_id AND q.ord = g.ord + 1,
               LATERAL (SELECT q.chunk = g.chunk AND g.fresh + q.tok + g.w_sys_tok + 128 <= 512 AS more)),
        w AS (SELECT conv_id, w, any_value(w_sys) AS w_sys, any_value(w_sys_tok) AS w_sys_tok, max(fresh) AS fresh FROM g GROUP BY conv_id, w),
        x AS (SELECT w.*, p.pre AS begin, greatest(0, least(128, 512 - w_sys_tok - fresh)) AS room FROM w JOIN p ON p.conv_id = w.conv_id AND p.ord = w.w),
        m AS (
          SELECT g.conv_id, g.w, p.body + p.marks AS chars FROM g JOIN p ON p.conv_id = g.conv_id AND p.ord = g.ord
          UNION ALL
          SELECT x.conv_id, x.w, p.body + p.marks FROM x JOIN p ON p.conv_id = x.conv_id AND p.ord = x.w_sys
          UNION ALL
          SELECT x.conv_id, x.w, p.body + p.marks FROM x JOIN p
            ON p.conv_id = x.conv_id AND p.ord < x.w AND p.ord > x.w_sys AND x.room > 0 AND p.pre >= x.begin - x.room),
        f AS (SELECT conv_id, sum(chars) AS chars, count(DISTINCT w) AS n_windows FROM m GROUP BY conv_id)
        SELECT t.conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY ord), '')) AS loss_sha256,
               CAST(any_value(f.chars) AS BIGINT) AS formatted_chars, any_value(f.n_windows) AS n_windows
        FROM t JOIN f USING (conv_id) GROUP BY t.conv_id""",
    "op10_quality_rules": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {words} AS w FROM documents),
        g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM w),
        i AS (SELECT doc_id, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM i),
        c AS (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS c FROM r WHERE n > 1),
        s AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM c GROUP BY doc_id),
        m AS (
          SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words,
                 CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
          FROM g LEFT JOIN s USING (doc_id)),
        b AS (
          SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
                 + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
                 + 32 * (word_chars > 20 * n_words)::INT + 64 * (100 * n_upper > 60 * word_chars)::INT AS BIGINT) AS failed_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
               failed_bits = 0 AS kept, failed_bits
        FROM b""".replace("{words}", _WORDS),
    "op12_filter_audit": r"""
        WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {words} AS w, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM documents d LEFT JOIN l USING (doc_id)),
        f AS (SELECT part, good, toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                     100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
                     coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM d),
        g AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, f),
        v AS (SELECT unnest([1, 2, 3, 4, 5]) AS v),
        o AS (SELECT [a.v, b.v, c.v, d.v, e.v] AS o FROM v a, v b, v c, v d, v e
              WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
        s AS (SELECT o, CAST(step AS INT) AS step FROM o, (SELECT unnest(range(1, 6)) AS step)),
        x AS (SELECT part, o, step, n, good, toxic, f[o[step]] AS own, list_bool_or(list_prepend(false, list_transform(o[1:step - 1], lambda i: f[i]))) AS before,
                     len(list_filter(f, lambda y: y)) = 1 AS alone FROM g, s),
        r AS (SELECT part, o, step, CAST(coalesce(sum(n) FILTER (NOT own AND NOT before), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT before), 0) AS BIGINT) AS removed,
                     CAST(coalesce(sum(n) FILTER (own AND before), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (own AND alone), 0) AS BIGINT) AS unique_fails,
                     CAST(coalesce(sum(good) FILTER (own AND NOT before), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (own AND NOT before), 0) AS BIGINT) AS toxic_lost
              FROM x GROUP BY part, o, step)
        SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley FROM r""".replace("{words}", _WORDS),
    "op13_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                     list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h FROM d),
        c AS (SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                          WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p""",
}
