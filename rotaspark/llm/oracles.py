"""DuckDB statements of the registered queries that SQL can express."""

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
    SELECT doc_id, pos, lines[pos] AS line, translate(trim(lines[pos], {BLANK}), '{_UPPER}', '{_LOWER}') AS key
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM split)
),
frequent AS (
    SELECT key, max(doc_id) AS last FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
    SELECT line.*, frequent.key IS NOT NULL AND line.doc_id <> frequent.last AS lost
    FROM line LEFT JOIN frequent ON line.key = frequent.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE lost))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORD = "[^\\x20\\x09-\\x0D]+"
_METRICS = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "long_words": ("word_chars", "n_words")}
_WIDTH = {"symbols": 1000, "dup_lines": 1500, "repeats": 1500, "long_words": 8000}


def _valley(counts: str, groups: str) -> str:
    """Median and limit of each group of counts: the middle of the first two quantiles that are far apart."""
    return f"""
    SELECT {groups}, metric, min(b) AS centre, arg_min(coalesce((b + next) // 2, b + width), b) FILTER (WHERE next IS NULL OR next - b >= width) AS top
    FROM (
        SELECT *, min(b) OVER (PARTITION BY {groups}, metric ORDER BY share RANGE BETWEEN 2000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next,
            CASE metric {" ".join(f"WHEN '{m}' THEN {w}" for m, w in _WIDTH.items())} END AS width
        FROM (
            SELECT *, ((sum(n) OVER (PARTITION BY {groups}, metric ORDER BY b))::HUGEINT * 1000000000
                // (sum(n) OVER (PARTITION BY {groups}, metric))::HUGEINT)::BIGINT AS share
            FROM {counts}
        )
    )
    WHERE share >= 500000000 GROUP BY {groups}, metric"""


QUALITY = f"""
WITH doc AS (
    SELECT doc_id, coalesce('s' || lang, 'n') AS lk, coalesce('s' || source, 'n') AS sk, coalesce(text, '') AS t FROM documents
),
word AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, string_split(t, chr(10)) AS raw_lines FROM doc),
line AS (SELECT *, list_filter(raw_lines, lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM word),
gram AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM word)
),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM gram) WHERE n > 1),
covered AS (
    SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (SELECT unnest(range(0, 3)) AS d) GROUP BY doc_id
),
base AS (
    SELECT line.doc_id, lk, sk, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM line LEFT JOIN covered ON line.doc_id = covered.doc_id
),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
metric AS (
    {" UNION ALL ".join(f"SELECT lk, sk, '{m}' AS metric, ({a} * 10000) // {b} AS v FROM failed WHERE NOT base_failed" for m, (a, b) in _METRICS.items())}
),
own AS (
    SELECT lk, sk, metric, v - v % (2 ** greatest(length(bin(v)) - 6, 0))::BIGINT AS b, count(*) AS n FROM metric GROUP BY ALL
),
lang AS (SELECT lk, metric, b, sum(n) AS n FROM own GROUP BY ALL),
merged AS (
    SELECT lk, sk, metric, b, sum(n) AS n FROM (
        SELECT o.lk, o.sk, o.metric, o.b, o.n * t.total AS n
        FROM own o JOIN (SELECT lk, metric, sum(n) AS total FROM lang GROUP BY ALL) t ON o.lk = t.lk AND o.metric = t.metric
        UNION ALL
        SELECT g.lk, g.sk, g.metric, l.b, l.n * 100
        FROM (SELECT DISTINCT lk, sk, metric FROM own) g JOIN lang l ON g.lk = l.lk AND g.metric = l.metric
    ) GROUP BY ALL
),
bound AS ({_valley("lang", "lk")}),
mark AS ({_valley("merged", "lk, sk")}),
cap AS (
    SELECT m.lk, m.sk, m.metric, least(m.top, m.centre + 2 * (b.top - b.centre)) AS top
    FROM mark m JOIN bound b ON m.lk = b.lk AND m.metric = b.metric
),
caps AS (
    SELECT lk, sk, {", ".join(f"max(top) FILTER (WHERE metric = '{m}') AS max_{m}" for m in _METRICS)} FROM cap GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {" AND ".join(f"coalesce(({a} * 10000) // nullif({b}, 0) <= max_{m}, true)" for m, (a, b) in _METRICS.items())} AS kept
FROM failed LEFT JOIN caps ON failed.lk = caps.lk AND failed.sk = caps.sk
"""


def _rendered(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '')"


def _mask(turns: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform({turns}, lambda t: '0x' || (length(coalesce(t.role, '')) + 5) || ' ' || "
        "CASE WHEN t.role = 'assistant' THEN '1x' ELSE '0x' END || (length(coalesce(t.text, '')) + 8)), ' '), '')"
    )


PREFERENCES = f"""
WITH conv AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id
),
reply AS (
    SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS pos FROM conv
),
next AS (
    SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS other_id, turns[pos].text AS mine
    FROM reply WHERE pos IS NOT NULL
),
pair AS (
    SELECT r.conv_id, n.other_id, len(r.turns) AS n_turns, CASE WHEN pos IS NULL THEN turns ELSE turns[1:pos] END AS chosen,
        CASE WHEN pos IS NULL THEN turns ELSE list_concat(turns[1:pos - 1], [{{'role': turns[pos].role, 'text': o.mine}}]) END AS rejected
    FROM reply r LEFT JOIN next n ON r.conv_id = n.conv_id LEFT JOIN next o ON n.other_id = o.conv_id
),
cut AS (
    SELECT *, coalesce(
        list_min(list_filter(range(1, len(chosen) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1, len(chosen)
    ) AS n FROM pair
)
SELECT conv_id, other_id, n_turns::INTEGER AS n_turns, n::INTEGER AS n_prompt_turns, {_rendered("chosen[1:n]")} AS prompt,
    {_rendered("chosen[n + 1:]")} AS chosen, {_rendered("rejected[n + 1:]")} AS rejected,
    {_mask("chosen[n + 1:]")} AS chosen_mask, {_mask("rejected[n + 1:]")} AS rejected_mask
FROM cut
"""


_KEY = {
    "assign": "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])",
    "login": "(?:[uU][sS][eE][rR](?:_?[nN][aA][mM][eE]|_?[iI][dD])?|[lL][oO][gG][iI][nN]|[aA][cC][cC][oO][uU][nN][tT](?:_?[iI][dD])?"
    "|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY]_?[iI][dD])",
    "loose": "(?:[pP][wW][dD]|[pP][aA][sS][sS]|[pP][aA][sS][sS][pP][hH][rR][aA][sS][eE]|[cC][rR][eE][dD][eE][nN][tT][iI][aA][lL][sS]?"
    "|[pP][rR][iI][vV][aA][tT][eE]_?[kK][eE][yY]|[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY]|[aA][uU][tT][hH])",
    "host": "(?:[hH][oO][sS][tT](?:_?[nN][aA][mM][eE])?|[eE][nN][dD][pP][oO][iI][nN][tT]|[sS][eE][rR][vV][eE][rR])",
}
_SET = "[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?"
#: name, place in the order, role, base, pattern, least length of the value
_PARTS = [
    ("assign", 0, 2, True, _KEY["assign"] + _SET + "([A-Za-z0-9+/_.=-]+)", 6),
    ("access", 1, 1, True, "(AKIA[A-Z0-9]{16,})", 1),
    ("hex", 2, 2, True, "([0-9a-f]{24,})", 1),
    ("login", 3, 1, False, _KEY["login"] + _SET + "([A-Za-z0-9@._+-]+)", 3),
    ("email", 4, 1, False, "([A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+){1,20})", 1),
    ("loose", 6, 2, False, _KEY["loose"] + _SET + "([A-Za-z0-9+/_.=-]+)", 4),
    ("opaque", 7, 2, False, "([A-Za-z0-9+/_=-]{20,})", 1),
    ("url", 8, 3, False, "((?:https?|ftps?|sftp|ssh|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\\x00-\\x20\"\'\'<>\\x7F]+)", 1),
    ("host", 9, 3, False, _KEY["host"] + _SET + "([A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+){1,20})", 1),
    ("break", 10, 0, False, "(\\n[\\x20\\t\\r]*\\n)", 1),
]

SECRETS = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (
    {" UNION ALL ".join(f"SELECT doc_id, '{name}' AS kind, {n} AS place, {role} AS role, {base} AS base, {least} AS least, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', 1) AS v FROM doc WHERE regexp_matches(t, '{p}')" for name, n, role, base, p, least in _PARTS)}
),
hit AS (
    SELECT doc_id, kind, place, role, base, least, i, length(b[i]) + length(m[i]) AS step, m[i] AS whole, length(v[i]) AS size
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)
),
placed AS (
    SELECT *, sum(step) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS stop FROM hit
),
part AS (
    SELECT doc_id, CASE WHEN kind = 'assign' AND size < 6 THEN 'short' ELSE kind END AS kind,
        CASE WHEN kind = 'assign' AND size < 6 THEN 5 ELSE place END AS place, role, base AND size >= least AS base,
        stop - length(whole) AS start, stop
    FROM placed
    WHERE (size >= least OR kind = 'assign')
        AND (kind <> 'opaque' OR regexp_matches(whole, '[a-z]') AND regexp_matches(whole, '[A-Z]') AND regexp_matches(whole, '[0-9]'))
),
scoped AS (
    SELECT p.*, (SELECT count(*) FROM part b WHERE b.doc_id = p.doc_id AND b.kind = 'break' AND b.start <= p.start) AS scope
    FROM part p WHERE kind <> 'break'
),
seen AS (
    SELECT * FROM scoped p
    WHERE base OR kind IN ('url', 'host') OR NOT EXISTS (
        SELECT 1 FROM scoped o WHERE o.doc_id = p.doc_id AND o.start < p.stop AND o.stop > p.start
            AND CASE WHEN p.kind = 'opaque' THEN o.kind <> 'opaque' ELSE o.base END
    )
),
near AS (
    SELECT w.doc_id, w.place, w.start
    FROM seen w JOIN seen o ON w.doc_id = o.doc_id AND w.scope = o.scope AND w.role <> o.role AND abs(w.start - o.start) <= 200
    WHERE NOT w.base GROUP BY ALL HAVING bool_or(o.base) OR count(DISTINCT o.role) = 2
),
told AS (
    SELECT s.*, s.kind || ':' || s.start || ':' || s.stop AS span FROM seen s
    LEFT JOIN near n ON s.doc_id = n.doc_id AND s.place = n.place AND s.start = n.start WHERE s.base OR n.doc_id IS NOT NULL
)
SELECT doc.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (WHERE base), '')) AS base_sha256,
    coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM doc LEFT JOIN told ON doc.doc_id = told.doc_id GROUP BY doc.doc_id
"""
