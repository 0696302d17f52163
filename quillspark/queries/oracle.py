"""SQL for DuckDB that gives the rows of the queries."""

from __future__ import annotations

#: White space as scripts have it, spelled for a character class.
S = r"\t\n\x0b\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _replaced(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern.replace('SP', S)}', '{to}', 'g')"


def _trimmed(x: str) -> str:
    return _replaced(x, "^[SP]+|[SP]+\\z")


def _tidied(x: str) -> str:
    for pattern, to in (
        ("[SP]+([,;:.!?])", "\\1"), ("([(\\[])[SP]+", "\\1"), ("[SP]+([)\\]])", "\\1"), ("\\([SP]*\\)|\\[[SP]*\\]", ""),
        ("([,;:])[SP]*([,;:.])", "\\2"), ("\\.{2,}", "."), ("[SP]{2,}", " "), ("^[SP]*[,;:][SP]*", ""),
    ):
        x = _replaced(x, pattern, to)
    return _trimmed(x)


def _normalized(x: str) -> str:
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        x = f"replace({x}, '{a}', '{b}')"
    x = _replaced(x, "[\\x{00AD}\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]")
    x = _replaced(_replaced(_replaced(x, "[\\x{00A0}\\x{2007}\\x{202F}]", " "), "[‘’‛ʼ]", "''"), "[“”„″]", '"')
    x = _replaced(_replaced(x, "…", "..."), "[‐‑−]", "-")
    return _replaced(_trimmed(_replaced(x, "[SP]+", " ")), "[SP]+[–—][SP]+", ", ")


def _unescaped(x: str) -> str:
    """The character references of this table; as in pages, their semicolon may be missing."""
    for name, to in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{to}', 'g')"
    return x


_ADDRESSES = "coalesce(text, '')"
for _p in (
    "(?i)\\bdoi:?[SP]*10\\.\\d{4,9}/[^SP\"''<>]+", "(?i)\\b(?:https?://|www\\.)[^SP<>\"'']+", "(?i)\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b",
):
    _ADDRESSES = _replaced(_ADDRESSES, _p)

_TURNS = """turns AS (SELECT conv_id AS doc_id, turn AS i, CASE WHEN role = 'user' THEN 'heading' ELSE 'para' END AS type, text,
                  length(text) < 60 AS skip FROM conversations)"""

_SPANS = f"""{_TURNS}, b AS (
            SELECT doc_id, unnest(range(CAST(max(i) // 3 + 2 AS BIGINT))) AS block_idx FROM turns GROUP BY doc_id),
          n AS (SELECT b.doc_id, CAST(b.block_idx AS INT) AS block_idx, count(t.i) AS n, ['body', 'references', 'backmatter'][b.block_idx % 3 + 1] AS zone
                FROM b LEFT JOIN turns t ON t.doc_id = b.doc_id AND t.i // 3 = b.block_idx GROUP BY ALL),
          spans AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY block_idx) - n AS BIGINT) AS first,
                           CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY block_idx) - 1 AS BIGINT) AS last FROM n)"""
#: The texts of this table have no blank lines, headings, captions or items: each is one paragraph.
_PARAGRAPHS = rf"""
          SELECT doc_id, {_trimmed(_replaced("x", "[SP]+", " "))} AS text FROM (
            SELECT doc_id, list_reduce(list_prepend('', list_filter(list_transform(
                     string_split(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), ' ', ' '), chr(10)), lambda l: {_trimmed("l")}), lambda l: l <> '')),
                     lambda a, p: CASE WHEN a = '' THEN p WHEN regexp_matches(a, '\pL-$') AND regexp_matches(p, '^\p{{Ll}}') THEN a[:-2] || p ELSE a || ' ' || p END) AS x FROM documents)
          WHERE x <> ''"""
#: Lines of texts (t: trimmed), their letters, and the blocks (k: kind, p: trimmed lines) to which a pattern over the letters cuts them.
_CUT = rf"""d AS (SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), chr(10)) AS l FROM documents),
        e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
        t AS (SELECT *, {_trimmed("line")} AS t, length({_replaced("line", "[SP]+$")}) AS w FROM e),
        m AS (SELECT doc_id, avg(w) AS mean, count(*) AS n, count(*) FILTER (NOT regexp_matches(line, '[.!?:;"'')\]][{S}]*$')) / count(*) > 0.5 AS free FROM t WHERE length(t) > 20 GROUP BY doc_id),
        v AS (SELECT doc_id, n >= 6 AND free AND mean BETWEEN 40 AND 110 AND count(*) FILTER (abs(w - mean) < mean * 0.22) / n > 0.55 AS wrapped
              FROM t JOIN m USING (doc_id) WHERE length(t) > 20 GROUP BY doc_id, n, free, mean),
        a AS (SELECT t.*, coalesce(wrapped, false) AND w < 62 AND regexp_matches(line, '[.!?]["'')\]]?[{S}]*$') AS early,
                     lag(t, 1, '') OVER (PARTITION BY doc_id ORDER BY i) = '' AND lead(t, 1, '') OVER (PARTITION BY doc_id ORDER BY i) = '' AND length(t) <= 78 AND NOT regexp_matches(t, '[.!?]$')
                     AND (regexp_matches(t, '^[^a-z]{{4,}}$') OR regexp_matches(t, '^\d+(\.\d+)*\.?[{S}]+[^{S}]')
                          OR regexp_matches(t, '(?i)^(abstract|introduction|methods?|results?|discussion|conclusions?|references?)\b')) AS isolated FROM t LEFT JOIN v USING (doc_id)),
        s AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '^(-([{S}]*-){{2,}}|\*([{S}]*\*){{2,}}|_([{S}]*_){{2,}})$') THEN 'B' WHEN regexp_matches(t, '^#{{1,6}}[{S}]+.*[^{S}][{S}]*#*$') THEN 'H'
                             WHEN regexp_matches(t, '^(=|-){{3,}}$') THEN CASE WHEN isolated THEN 'X' ELSE 'U' END WHEN regexp_matches(t, '(?i)^(fig(ure)?\.?[{S}]*\d|table[{S}]*\d)') THEN 'C'
                             WHEN regexp_matches(line, '^[{S}]*([-*+•]|\d{{1,3}}[.)])[{S}]+') THEN 'I' WHEN isolated THEN 'X' WHEN early THEN 'E' ELSE 'O' END AS x FROM a),
        g AS (SELECT doc_id, string_agg(CASE WHEN t <> '' AND x <> 'I' AND regexp_matches(line, '^[{S}]{{2,}}') THEN lower(x) ELSE x END, '' ORDER BY i) AS word FROM s GROUP BY doc_id),
        h AS (SELECT doc_id, regexp_extract_all(word, 'I[a-z]*|[BbHhCcXx]|[OoUu][Uu]|[OoUu]+[Ee]?|[Ee]') AS kinds FROM g),
        c AS (SELECT doc_id, unnest(kinds) AS kind, unnest(range(len(kinds))) AS j FROM h),
        o AS (SELECT *, CAST(sum(length(kind)) OVER (PARTITION BY doc_id ORDER BY j) AS BIGINT) AS ends FROM c),
        r AS (SELECT doc_id, j, kind, unnest(range(ends - length(kind), ends)) AS i FROM o WHERE upper(kind) <> 'B'),
        b AS (SELECT doc_id, j, upper(kind[1]) AS k, regexp_matches(kind, '^[OoUu][Uu]$') AS under, list(t ORDER BY i) AS p FROM r JOIN t USING (doc_id, i) GROUP BY doc_id, j, kind)"""
_JOINED = rf"""list_reduce(list_prepend('', list_prepend(CASE WHEN k = 'I' THEN regexp_replace(p[1], '^[{S}]*([-*+•]|\d{{1,3}}[.)])[{S}]+', '• ') ELSE p[1] END, p[2:])),
                    lambda a, q: CASE WHEN a = '' THEN q WHEN regexp_matches(a, '\pL-$') AND regexp_matches(q, '^\p{{Ll}}') THEN a[:-2] || q ELSE a || ' ' || q END)"""
_DOCS = """docs AS (
            SELECT doc_id, concat_ws(' ', lang, source) AS title, concat_ws(', ', lang, CASE WHEN doc_id % 2 = 0 THEN source END) AS author, n_chars // 100 AS minutes, n_chars * 97 AS bytes,
                   make_timestamp((1700000000 + doc_id * 3600 % 900000) * 1000000) AS added_at FROM documents)"""

#: Lines of documents as pages of their source, with spliced heads and feet; band: of lines in a margin.
_HEADED = r"""d AS (SELECT coalesce(source, '') AS doc_id, doc_id AS page, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, page, unnest(l) AS t, unnest(range(len(l))) AS i, len(l) AS m FROM d),
        b AS (SELECT doc_id, page, t, CASE WHEN i = 0 THEN 'T:' WHEN i = m - 1 THEN 'B:' ELSE '' END AS band FROM e
              UNION ALL SELECT doc_id, page, 'The Journal of ' || doc_id || ', No. ' || page, 'T:' FROM d WHERE page % 5 < 3
              UNION ALL SELECT doc_id, page, 'Page ' || page || ' - of - 900', 'B:' FROM d WHERE page % 5 > 0),
        k AS (SELECT doc_id, page, t, band, CASE WHEN band <> '' THEN band || trim(regexp_replace(regexp_replace(lower(t), '\d+', '#', 'g'), '[^A-Za-z0-9_#]+', ' ', 'g')) END AS key FROM b),
        n AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM d GROUP BY doc_id)"""

ORACLE: dict[str, str] = {
    # No letter of this table is followed by a spacing accent.
    "normalize_text": f"SELECT doc_id, {_normalized("coalesce(text, '')")} AS text FROM documents",
    "strip_addresses": f"SELECT doc_id, {_tidied(_ADDRESSES)} AS text FROM documents",
    "line_shape": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), ' ', ' '), chr(10))) AS line FROM documents),
        t AS (SELECT doc_id, line, length({_trimmed("line")}) AS n, length({_replaced("line", "[SP]+$")}) AS w FROM l),
        m AS (SELECT doc_id, avg(w) AS mean, count(*) AS k FROM t WHERE n > 20 GROUP BY doc_id),
        s AS (SELECT t.doc_id, count(*) FILTER (abs(w - mean) < mean * 0.22) / any_value(k) AS near,
                     count(*) FILTER (NOT regexp_matches(line, '[.!?:;"'')\]][{S}]*$')) / any_value(k) AS free,
                     any_value(k) AS k, any_value(mean) AS mean
              FROM t JOIN m USING (doc_id) WHERE n > 20 GROUP BY t.doc_id)
        SELECT t.doc_id, count(*) AS n_lines, count(*) FILTER (n > 0) AS n_solid,
               coalesce(any_value(s.k >= 6 AND s.mean BETWEEN 40 AND 110 AND s.near > 0.55 AND s.free > 0.5), false) AS wrapped
        FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id""",
    "block_noise": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, {_trimmed("line")} AS t FROM l),
        w AS (SELECT *, length(t) AS n, list_filter(string_split_regex(t, '[{S}]+'), lambda x: x <> '') AS w FROM t)
        SELECT doc_id, count(*) FILTER (n < 3) AS short,
          count(*) FILTER (regexp_matches(t, '^[\d{S}.,;:|/–—-]+$')) AS numbers,
          count(*) FILTER (regexp_matches(t, '(?i)^(citation|published|copyright|received|accepted|submitted|revised|editor|academic[{S}]+editor|data[{S}]+availability|funding|competing[{S}]+interests?|conflicts?[{S}]+of[{S}]+interest|correspondence|reprints?|peer[{S}]+review|article[{S}]+history|keywords?|abbreviations?|orcid|how[{S}]+to[{S}]+cite|licen[cs]e)[{S}]*[:.]')) AS front_matter,
          count(*) FILTER (n < 300 AND regexp_matches(t, '(?i)^(this[{S}]+article|open[{S}]+access|creative[{S}]+commons)\b')) AS licence,
          count(*) FILTER (len(list_filter(range(1, n - 4), lambda i: t[i:i + 5] = repeat(t[i:i], 6))) > 0) AS repeated,
          count(*) FILTER (NOT regexp_matches(t, '[aeiouyAEIOUY]')) AS no_vowel,
          count(*) FILTER (n < 17 AND NOT regexp_matches(t, '[.!?:]$') AND NOT regexp_matches(t, '^[•\-–]')) AS fragment,
          count(*) FILTER (n > 12 AND length(regexp_replace(t, '[^\d.,%]', '', 'g')) / n > 0.55) AS digits,
          count(*) FILTER (n > 16 AND len(w) >= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ''’-]{{2,}}[.,;:)]?$'))) / len(w) < 0.4) AS few_words,
          count(*) FILTER (len(w) >= 3 AND len(list_distinct(list_transform(w, lambda x: lower(x)))) = 1) AS one_word,
          CAST(0 AS BIGINT) AS numbered_heading
        FROM w GROUP BY doc_id""",
    "next_playable": f"""
        WITH {_TURNS}
        SELECT doc_id, i,
          min(CASE WHEN NOT skip THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_playable,
          max(CASE WHEN NOT skip THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_playable,
          min(CASE WHEN NOT skip AND type = 'heading' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_heading,
          max(CASE WHEN NOT skip AND type = 'heading' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_heading
        FROM turns""",
    "time_left": f"""
        WITH {_TURNS}, w AS (
          SELECT doc_id, i, CAST(sum(CASE WHEN skip THEN 0 ELSE len(string_split_regex(text, '[{S}]+')) END)
                   OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS words_left FROM turns)
        SELECT doc_id, i, words_left, CAST(floor(words_left / 165.0 + 0.5) AS BIGINT) AS minutes_left FROM w""",
    "look_ahead": f"""
        WITH {_TURNS}
        SELECT doc_id, i, array_to_string(list(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), ',') AS ahead
        FROM turns WHERE NOT skip""",
    "html_title": rf"""
        WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS a,
                          url FROM pages),
        e AS (SELECT page_id, {_unescaped("a")} AS a FROM t)
        SELECT page_id, CASE WHEN trim(regexp_replace(a, '\s*[|–—-]\s*[^|–—-]{{2,40}}$', '')) = '' THEN a
                             ELSE trim(regexp_replace(a, '\s*[|–—-]\s*[^|–—-]{{2,40}}$', '')) END AS title FROM e""",
    "library_view": """
        SELECT d.doc_id, d.lang, d.n_chars, CASE WHEN l.doc_id IS NOT NULL AND least(100.0, 100.0 * (quality * 40 + toxic * 7) / 100) > 0.5
               THEN CAST(least(100.0, 100.0 * (quality * 40 + toxic * 7) / 100) AS DOUBLE) END AS percent
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "progress_latest": """
        SELECT user_id, arg_max(value, (ts, event_id)) AS position, max(ts) AS at, count(*) AS n_events FROM events GROUP BY user_id""",
    "progress_debounced": """
        WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
        SELECT user_id, ts, event_id, value AS position, CASE WHEN event_type = 'purchase' THEN ts ELSE ts + INTERVAL 1 HOUR END AS written_at FROM e
        WHERE event_type = 'purchase' OR next IS NULL OR next >= ts + INTERVAL 1 HOUR""",
    "section_jumps": f"""
        WITH {_TURNS}, h AS (SELECT doc_id, i FROM turns WHERE type = 'heading'),
        l AS (SELECT doc_id, i, (SELECT max(h.i) FROM h WHERE h.doc_id = t.doc_id AND h.i < t.i) AS l,
                     (SELECT min(h.i) FROM h WHERE h.doc_id = t.doc_id AND h.i > t.i) AS n FROM turns t)
        SELECT doc_id, i, CASE WHEN i - l <= 2 THEN coalesce((SELECT max(h.i) FROM h WHERE h.doc_id = l.doc_id AND h.i < l.l), 0) ELSE coalesce(l, 0) END AS back,
               coalesce(n, max(i) OVER (PARTITION BY doc_id)) AS forward FROM l""",
    "turn_stats": f"""
        WITH {_TURNS}, s AS (
          SELECT doc_id, CAST(coalesce(sum(CASE WHEN NOT skip THEN len(string_split_regex(text, '[{S}]+')) END), 0) AS BIGINT) AS words, count(*) AS sentences,
                 count(*) FILTER (NOT skip) AS playable FROM turns GROUP BY doc_id)
        SELECT *, CAST(greatest(1, floor(words / 165.0 + 0.5)) AS BIGINT) AS minutes FROM s""",
    "block_spans": f"""
        WITH {_SPANS} SELECT doc_id, block_idx, first, last, CAST(n AS INT) AS n FROM spans""",
    "zone_labels": f"""
        WITH {_SPANS}, z AS (SELECT doc_id, block_idx, zone, lag(zone, 1, 'body') OVER (PARTITION BY doc_id ORDER BY block_idx) AS p FROM spans WHERE n > 0)
        SELECT doc_id, block_idx, CASE WHEN zone <> p THEN CASE zone WHEN 'references' THEN 'References' WHEN 'backmatter' THEN 'Back matter' END END AS label FROM z""",
    "current_section": f"""
        WITH {_TURNS}
        SELECT doc_id, i, (SELECT arg_max(h.text, h.i) FROM turns h WHERE h.doc_id = t.doc_id AND h.type = 'heading' AND h.i <= t.i) AS section FROM turns t""",
    "reanchor": f"""
        WITH {_TURNS}, s AS (SELECT *, i // 3 AS b FROM turns WHERE i % 4 <> 1), a AS (SELECT DISTINCT doc_id, i // 3 AS b, text FROM turns)
        SELECT doc_id, CAST(b AS INT) AS block_idx, text, coalesce((SELECT min(i) FROM s WHERE s.doc_id = a.doc_id AND s.b = a.b AND s.text = a.text),
               (SELECT min(i) FROM s WHERE s.doc_id = a.doc_id AND s.b >= a.b), 0) AS i FROM a""",
    "audio_plan": f"""
        WITH {_TURNS}, d AS (SELECT DISTINCT doc_id, text AS speak FROM turns WHERE NOT skip),
        h AS (SELECT *, list_reduce(list_transform(string_split(speak, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS h FROM d)
        SELECT doc_id, doc_id || ':' || lower(to_base(h, 36)) || ':default' AS key, speak FROM h""",
    "audio_pending": f"""
        WITH {_TURNS}, d AS (SELECT doc_id, text AS speak FROM turns WHERE NOT skip GROUP BY doc_id, text HAVING count(*) FILTER (i % 3 = 0) = 0),
        h AS (SELECT *, list_reduce(list_transform(string_split(speak, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS h FROM d)
        SELECT doc_id, doc_id || ':' || lower(to_base(h, 36)) || ':default' AS key, speak FROM h""",
    "audio_index": f"""
        WITH {_TURNS}
        SELECT doc_id, count(*) AS n_audio, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE count(*) END AS n_left FROM turns WHERE NOT skip GROUP BY doc_id""",
    "audio_rendered": f"""
        WITH {_TURNS} SELECT doc_id || ':' || i AS key, NOT skip AS has FROM turns""",
    "heading_noise": rf"""
        WITH l AS (SELECT l_orderkey, concat_ws(' ', l_returnflag, CASE WHEN l_quantity > 20 THEN l_partkey END, CASE WHEN l_tax > 0.03 THEN l_suppkey END,
                          CASE WHEN l_linenumber > 2 THEN 'done.' END) AS t, l_linenumber % 2 = 0 AS heading FROM lineitem),
        w AS (SELECT *, length(t) AS n, string_split(t, ' ') AS w FROM l),
        r AS (SELECT *, n < 3 AS short, regexp_matches(t, '^[\d .,;:|/–—-]+$') AS numbers, NOT heading AND n < 17 AND NOT regexp_matches(t, '[.!?:]$') AS fragment,
                     NOT regexp_matches(t, '[aeiouyAEIOUY]') AS no_vowel, n > 12 AND length(regexp_replace(t, '[^\d.,%]', '', 'g')) / n > 0.55 AS digits,
                     len(w) >= 3 AND len(list_distinct(w)) = 1 AS one_word, heading AND len(list_filter(w, lambda x: regexp_matches(x, '\d'))) >= 2 AS numbered_heading,
                     n > 16 AND len(w) >= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ''’-]{{2,}}[.,;:)]?$'))) / len(w) < 0.4 AS few_words,
                     len(list_filter(range(1, n - 4), lambda i: t[i:i + 5] = repeat(t[i:i], 6))) > 0 AS repeated FROM w)
        SELECT l_orderkey, count(*) FILTER (short) AS short, count(*) FILTER (numbers) AS numbers, count(*) FILTER (fragment) AS fragment, count(*) FILTER (no_vowel) AS no_vowel,
               count(*) FILTER (digits) AS digits, count(*) FILTER (one_word) AS one_word, count(*) FILTER (numbered_heading) AS numbered_heading,
               count(*) FILTER (short OR numbers OR fragment OR no_vowel OR digits OR one_word OR numbered_heading OR few_words OR repeated) AS noise FROM r GROUP BY l_orderkey""",
    "line_tests": rf"""
        WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, CASE WHEN k % 5 = 1 THEN translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN k % 7 = 2 THEN line || ' Smith, AB. Lancet 2019; 12: 33-40.' ELSE line END AS t FROM d),
        w AS (SELECT *, regexp_extract_all(t, '[A-Za-zÀ-ɏ]{{2,}}') AS s, list_filter(string_split_regex(t, '[{S}]+'), lambda x: regexp_matches(x, '\w')) AS w FROM l),
        r AS (SELECT *, length(array_to_string(s, '')) >= 4 AND (len(s) >= 2 OR length(s[1]) >= 4) AS speakable,
                     len(w) >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z0-9][A-Z0-9.%-]{{1,6}}$'))) / len(w) > 0.7 AS soup,
                     regexp_matches(t, '\b(19|20)\d{{2}}[a-z]?[.;)]') AS year, regexp_matches(t, '\b[A-Z][a-z]+,?[{S}]+[A-Z]{{1,3}}[.,]') AS initials,
                     regexp_matches(t, '\b(J|Am|Br|Eur|N[{S}]?Engl|Lancet|BMJ|JAMA|Nature|Science|Proc|Ann|Arch|Int)\b\.?[{S}]') AS journal,
                     regexp_matches(t, '\b\d+[{S}]*[:(][{S}]*\d+') OR regexp_matches(t, '\b\d+[–-]\d+\b[{S}]*\.?[{S}]*$') AS pages FROM w)
        SELECT doc_id, count(*) FILTER (speakable) AS speakable, count(*) FILTER (soup) AS soup,
               count(*) FILTER (length(t) >= 25 AND ((year AND (initials OR journal)) OR (initials AND pages))) AS reference FROM r GROUP BY doc_id""",
    "sentence_chars": rf"""SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[{S}]+', '', 'g')) AS digest, true AS within FROM documents""",
    "blocks": f"""
        WITH {_CUT}
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS INT) AS ord,
               CASE WHEN k IN ('H', 'X') OR under THEN 'heading' WHEN k = 'C' THEN 'caption' ELSE 'para' END AS type,
               CASE WHEN k = 'H' THEN regexp_extract(p[1], '^#{{1,6}}[{S}]+(.*[^{S}])[{S}]*#*$', 1) WHEN k = 'X' OR under THEN p[1] WHEN k = 'C' THEN {_trimmed(_replaced("p[1]", "[SP]+", " "))}
                    ELSE {_trimmed(_replaced(_JOINED, "[SP]+", " "))} END AS text,
               CAST(CASE WHEN k = 'H' THEN CASE WHEN length(regexp_extract(p[1], '^#+')) <= 2 THEN 1 ELSE 2 END WHEN k = 'X' THEN 2 WHEN under THEN CASE WHEN starts_with(p[2], '=') THEN 1 ELSE 2 END END AS INT) AS level
        FROM b""",
    "zones": f"""
        SELECT doc_id, CAST(0 AS INT) AS block_idx, 'para' AS type, {_normalized("text")} AS text, CAST(NULL AS INT) AS level, CAST(NULL AS VARCHAR) AS furniture, 'body' AS zone,
               CAST(NULL AS VARCHAR) AS section FROM ({_PARAGRAPHS})""",
    "run_atoms": """
        WITH x AS (SELECT *, CASE WHEN abs(l_quantity / 4 - 1) = 0 THEN 10 ELSE abs(l_quantity / 4 - 1) END AS size, l_returnflag || '-' || l_partkey AS text FROM lineitem
                   WHERE abs(atan2(l_tax * 100, l_quantity)) <= 0.12)
        SELECT l_orderkey AS doc_id, l_linenumber AS ord, text, round(l_discount * 1000, 3) AS x0,
               round(l_discount * 1000 + CASE WHEN l_linenumber > 3 THEN l_quantity * 2 ELSE length(text) * size * 0.5 END, 3) AS x1, round(l_suppkey - 0.86 * size, 3) AS top,
               round(l_suppkey + 0.26 * size, 3) AS bot, round(CAST(l_suppkey AS DOUBLE), 3) AS base, round(size, 3) AS size, l_tax > 0.04 AS bold, false AS italic
        FROM x WHERE size BETWEEN 1 AND 300""",
    "word_atoms": """
        WITH x AS (SELECT *, l_linenumber * 4 - 6 AS h FROM lineitem WHERE l_quantity * 2 >= 40 AND l_linenumber * 4 - 6 > 0 AND l_linenumber * 5 - 10 > 0)
        SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_returnflag || '-' || l_partkey AS text, round(l_suppkey / 2.0, 3) AS x0, round((l_suppkey + l_linenumber * 5 - 10) / 2.0, 3) AS x1,
               round(l_quantity / 2, 3) AS top, round((l_quantity + h) / 2, 3) AS bot, round((l_quantity + h - 0.2 * h) / 2, 3) AS base, round(0.78 * h / 2, 3) AS size FROM x""",
    "needs_ocr": """
        WITH p AS (SELECT coalesce(source, '') AS source, 500.0 + doc_id % 9 * 50 AS width, length(replace(text, chr(10), '')) AS chars FROM documents),
        g AS (SELECT source AS doc_id, count(*) AS n_pages, count(*) FILTER (coalesce(chars, 0) < greatest(80.0, 2.5 * width / 72 * 800.0 / 72)) AS n_scanned FROM p GROUP BY source)
        SELECT *, n_scanned >= greatest(1, ceil(n_pages * 0.6)) AS needs_ocr FROM g""",
    "running_lines": rf"""
        WITH {_HEADED}
        SELECT doc_id, key, count(DISTINCT page) AS n FROM k JOIN n USING (doc_id) WHERE key IS NOT NULL GROUP BY doc_id, key, n_pages
        HAVING n_pages >= 3 AND count(DISTINCT page) >= greatest(2, ceil(n_pages * 0.34))""",
    "stripped_lines": rf"""
        WITH {_HEADED},
        h AS (SELECT doc_id, key FROM k JOIN n USING (doc_id) WHERE key IS NOT NULL GROUP BY doc_id, key, n_pages HAVING n_pages >= 3 AND count(DISTINCT page) >= greatest(2, ceil(n_pages * 0.34)))
        SELECT doc_id, page, count(*) AS n_lines, CAST(sum(length(t)) AS BIGINT) AS n_chars, count(*) FILTER (band <> '') AS n_margin FROM k ANTI JOIN h USING (doc_id, key)
        WHERE NOT (band <> '' AND (regexp_matches(t, '^[{S}]*\d{{1,4}}[{S}]*$') OR regexp_matches(t, '(?i)^[{S}]*[ivxlcdm]{{1,7}}[{S}]*$') OR regexp_matches(t, '(?i)^page[{S}]+\d+([{S}]+of[{S}]+\d+)?$')
               OR regexp_matches(t, '(?i)downloaded[{S}]+from|this[{S}]+content[{S}]+downloaded|all[{S}]+rights?[{S}]+reserved|^[{S}]*(https?://|www\.)[^{S}]+[{S}]*$|^[{S}]*doi:?[{S}]*10\.\d{{4,}}')
               OR regexp_matches(t, '©[{S}]*\d{{4}}|^[{S}]*\d{{1,4}}[{S}]+[A-Z][a-z]+[{S}]+\d{{4}}[{S}]*$') OR regexp_matches(t, '(?i)jstor|springer nature|elsevier ltd|wolters kluwer')))
        GROUP BY doc_id, page""",
    "body_size_mode": """
        WITH l AS (SELECT l_orderkey AS doc_id, (l_linenumber * 10000000 + l_partkey) * 100000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS k, floor(l_quantity / 5 * 2 + 0.5) / 2 AS size, length(concat_ws(' ', l_returnflag, l_partkey, l_suppkey, CASE WHEN l_tax > 0.04 THEN 'more of it' END)) AS n FROM lineitem),
        s AS (SELECT doc_id, size, sum(n) AS w, min(k) AS f FROM l GROUP BY doc_id, size)
        SELECT doc_id, size FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, f) = 1""",
    "library_shelf": f"""
        WITH {_DOCS}, l AS (
          SELECT d.* EXCLUDE (added_at), CASE WHEN labels.doc_id IS NOT NULL THEN least(100.0, 100.0 * (quality * 40 + toxic * 7) / 100) END AS pct, floor((1700900000 - epoch(added_at)) / 86400) AS days,
                 strftime(added_at, '%b ') || day(added_at) AS date FROM docs d LEFT JOIN labels ON labels.doc_id = d.doc_id)
        SELECT doc_id, title, author, minutes, bytes, string_split(author, ',')[1] || CASE WHEN contains(author, ',') THEN ' et al.' ELSE '' END AS by,
               CASE WHEN minutes = 0 THEN '' WHEN minutes < 60 THEN minutes || ' min listen' WHEN minutes % 60 = 0 THEN minutes // 60 || ' h listen'
                    ELSE minutes // 60 || ' h ' || minutes % 60 || ' min listen' END AS length,
               CASE WHEN days <= 0 THEN 'Today' WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN CAST(days AS BIGINT) || ' days ago' ELSE date END AS when,
               CASE WHEN bytes = 0 THEN '' WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN CAST(floor(bytes / 1024 + 0.5) AS BIGINT) || ' KB'
                    ELSE printf('%.1f MB', bytes / 1048576) END AS size,
               CASE WHEN pct > 0.5 THEN pct END AS percent FROM l""",
    "library_counts": "SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM labels) AS n_audio",
    "opened_documents": f"""
        WITH {_DOCS}, c AS (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents WHERE text IS NOT NULL AND doc_id % 3 > 0)
        SELECT doc_id, title, CAST(len(b) AS INT) AS n_blocks, CAST(CASE WHEN quality * 40 + toxic * 7 < len(b) THEN quality * 40 + toxic * 7 ELSE 0 END AS BIGINT) AS start
        FROM docs JOIN c USING (doc_id) LEFT JOIN labels USING (doc_id)""",
}
