"""DuckDB SQL counterparts of the registered queries.

They follow the plain definitions with joins, windows and RE2 patterns, and share
nothing with the Spark expressions but the fixed values.  RE2 knows no look-ahead
and no back-reference, so three patterns are spelled differently here.
"""

from __future__ import annotations

from promptward.operators.events import BLOCK_MESSAGE
from promptward.plans.planted import COUNT, PLANTED
from promptward.rules import (
    ATTACK_ORDER,
    BOOST_TERMS,
    DEFAULT_MODEL,
    ID_CHECK_CHARS,
    ID_WEIGHTS,
    KEYWORDS,
    PII_PATTERNS,
    PII_TYPES,
    RISK_LEVELS,
    RULES,
    SEEDS,
    STOPWORDS,
)


def q(value: str) -> str:
    parts = value.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _list(values) -> str:
    return "[" + ", ".join(f"({q(v)})" for v in values) + "]"


def planted_cte(name: str = "corpus") -> str:
    def pick(field: int) -> str:
        return f"({_list(p[field] for p in PLANTED)})[CAST(doc_id % {COUNT} AS INT) + 1]"

    return f"""{name} AS MATERIALIZED (
        SELECT doc_id, text || ' ' || {pick(1)} AS text, lang, source,
               {pick(0)} AS payload_id, {pick(2)} AS expected_risk
        FROM documents)"""


RAW_CTE = "corpus AS MATERIALIZED (SELECT doc_id, text, lang, source FROM documents)"

# --- personal data ----------------------------------------------------------

_RE2_PII = {
    **PII_PATTERNS,
    # The character after the number is consumed; group 1 leaves it out.
    "PHONE_CN": r"((?:(?:\+|00)86[\s\-]?)?1[3-9]\d[\s\-]?\d{4}[\s\-]?\d{4})(?:[^0-9]|$)",
    "PASSWORD_KV": (
        r"(?i)(?:password|passwd|pwd|pass|密码|口令)\s*(?:[:=]|是|为|\s+is)\s*"
        r"""(?:'\S+'|"\S+"|\S+)"""
    ),
}

_MASK = {
    "PHONE_CN": r"""regexp_extract(v, '^(?:\+86|0086)[\s\-]?')
        || left(regexp_replace(regexp_replace(v, '^(?:\+86|0086)[\s\-]?', ''), '[\s\-]', '', 'g'), 3)
        || '****' || right(v, 4)""",
    "ID_CARD_CN": "left(v, 6) || '********' || substr(v, 15, 3) || '*'",
    "EMAIL": """(CASE WHEN strpos(v, '@') <= 3 THEN repeat('*', strpos(v, '@') - 1)
        ELSE left(v, 2) || repeat('*', least(strpos(v, '@') - 3, 4)) END) || substr(v, strpos(v, '@'))""",
    "API_KEY_OPENAI": """(CASE WHEN starts_with(v, 'sk-proj-') THEN 'sk-proj-' || repeat('*', greatest(length(v) - 12, 0))
        ELSE 'sk-' || repeat('*', length(v) - 7) END) || right(v, 4)""",
    "API_KEY_AWS": "'AKIA************' || right(v, 4)",
    "API_KEY_GOOGLE": "'AIza' || repeat('*', length(v) - 8) || right(v, 4)",
    "CREDIT_CARD": "'**** **** **** ' || right(regexp_replace(v, '[ \\-]', '', 'g'), 4)",
    "IP_ADDRESS": "split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.***.***'",
    "PASSWORD_KV": r"""regexp_replace(v,
        '(?is)^((?:password|passwd|pwd|pass|密码|口令)\s*(?:[:=]|是|为|\s+is)\s*)(["'']?).*$', '\1\2[REDACTED]\2')""",
}


def _checksum(v: str) -> str:
    total = " + ".join(f"CAST(substr({v}, {i}, 1) AS INT) * {w}" for i, w in enumerate(ID_WEIGHTS, 1))
    return f"substr('{ID_CHECK_CHARS}', CAST(({total}) % 11 AS INT) + 1, 1) = upper(substr({v}, 18, 1))"


def _hits_of(kind: str, corpus: str = "corpus", key: str = "doc_id") -> str:
    group = 1 if kind == "PHONE_CN" else 0
    regex = q(_RE2_PII[kind])
    valid = f"WHERE {_checksum('v')}" if kind == "ID_CARD_CN" else ""
    return f"""
        SELECT {key}, '{kind}' AS type, {PII_TYPES.index(kind)} AS prio, pos,
               CAST(s AS INT) AS start, CAST(s + length(v) AS INT) AS "end", v AS value, {_MASK[kind]} AS masked
        FROM (SELECT {key}, pos, v,
                     sum(gap) OVER w + coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
              FROM (SELECT {key}, unnest(range(1, len(vs) + 1)) AS pos, unnest(vs) AS v,
                           length(unnest(ms)) AS len, length(unnest(gs[1:len(vs)])) AS gap
                    FROM (SELECT {key}, regexp_extract_all(text, {regex}, {group}) AS vs,
                                 regexp_extract_all(text, {regex}, 0) AS ms,
                                 string_split_regex(text, {regex}) AS gs
                          FROM {corpus} WHERE regexp_matches(text, {regex})))
              WINDOW w AS (PARTITION BY {key} ORDER BY pos))
        {valid}"""


def hits_cte(kinds=PII_TYPES, corpus: str = "corpus", key: str = "doc_id") -> str:
    union = " UNION ALL ".join(_hits_of(k, corpus, key) for k in kinds)
    return f"""hits AS MATERIALIZED (
        SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY prio, pos) AS INT) AS ord FROM ({union}))"""


def masked_cte(corpus: str = "corpus", key: str = "doc_id") -> str:
    """Overlapping hits form an island; each shows the mask of its longest hit."""
    return f"""
    islands AS (
        SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY start, "end", prio) AS island
        FROM (SELECT *, CASE WHEN start < max("end") OVER (
                  PARTITION BY {key} ORDER BY start, "end", prio
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits)),
    marks AS (
        SELECT {key}, island, min(start) AS s, max("end") AS e,
               arg_max(masked, ("end" - start) * 100 - prio) AS m
        FROM islands GROUP BY ALL),
    parts AS (
        SELECT {key}, island, m, s, e, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY island), 0) AS after
        FROM marks),
    masks AS (
        SELECT {key}, max(e) AS last,
               string_agg(substr(text, CAST(after AS INT) + 1, CAST(s - after AS INT)) || m, '' ORDER BY island) AS head
        FROM parts JOIN {corpus} USING ({key}) GROUP BY {key}),
    masked AS (
        SELECT {key}, CASE WHEN head IS NULL THEN text ELSE head || substr(text, CAST(last AS INT) + 1) END AS masked_text
        FROM {corpus} LEFT JOIN masks USING ({key}))"""


# --- injection --------------------------------------------------------------

_FETCH = RULES[5].patterns[1]
_FETCH_BASE = _FETCH[: _FETCH.index("(?!")]
_FETCH_HOSTS = "(?:openai|anthropic|zhipuai|bigmodel)"


def _first_match(pattern: str) -> str:
    if pattern == _FETCH:
        return (
            f"CASE WHEN NOT regexp_matches(text, {q(_FETCH_BASE + _FETCH_HOSTS)}) "
            f"THEN nullif(regexp_extract(text, {q(_FETCH_BASE)}), '') END"
        )
    return f"nullif(regexp_extract(text, {q(pattern)}), '')"


def signals_cte(corpus: str = "corpus", key: str = "doc_id", keywords_only: bool = False) -> str:
    rank = {level: i for i, level in enumerate(RISK_LEVELS, 1)}
    rows = []
    if not keywords_only:
        for i, r in enumerate(RULES):
            found = ", ".join(_first_match(p) for p in r.patterns)
            rows.append(
                f"SELECT {key}, 'RULE' AS layer, '{r.name}' AS rule_name, {q(r.description)} AS description, "
                f"'{r.severity}' AS severity, {rank[r.severity]} AS rank, {i} AS decl, "
                f"left(coalesce({found}), 100) AS matched FROM {corpus}"
            )
    for i, k in enumerate(KEYWORDS, start=len(RULES)):
        at = f"strpos(lower(text), {q(k.text.lower())})"
        rows.append(
            f"SELECT {key}, 'KEYWORD' AS layer, '{k.name}' AS rule_name, {q(k.description)} AS description, "
            f"'{k.severity}' AS severity, {rank[k.severity]} AS rank, {i} AS decl, "
            f"CASE WHEN {at} > 0 THEN substr(text, {at}, {len(k.text)}) END AS matched FROM {corpus}"
        )
    return f"""signals AS MATERIALIZED (
        SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY rank DESC, decl) AS INT) AS ord
        FROM ({' UNION ALL '.join(rows)}) WHERE matched IS NOT NULL)"""


# --- similarity -------------------------------------------------------------


def similarity_cte(corpus: str = "corpus", key: str = "doc_id") -> str:
    words = (
        "SELECT {k}, w, count(*) * CASE WHEN w IN (" + ", ".join(q(b) for b in BOOST_TERMS) + ") THEN 3 ELSE 1 END AS f "
        "FROM (SELECT {k}, unnest(string_split_regex(lower({t}), '[^a-z0-9]+')) AS w FROM {s}) "
        "WHERE length(w) > 1 AND w NOT IN (" + ", ".join(q(s) for s in STOPWORDS) + ") GROUP BY {k}, w"
    )
    seeds = ", ".join(f"({i}, {q(label)}, {q(text)})" for i, (label, text) in enumerate(SEEDS.items()))
    return f"""
    seeds(seed_ord, seed, seed_text) AS (VALUES {seeds}),
    seed_words AS ({words.format(k="seed_ord", t="seed_text", s="seeds")}),
    seed_norms AS (SELECT seed_ord, sum(f * f) AS n2 FROM seed_words GROUP BY seed_ord),
    doc_words AS MATERIALIZED ({words.format(k=key, t="text", s=corpus)}),
    doc_norms AS (SELECT {key}, sum(f * f) AS n2 FROM doc_words GROUP BY {key}),
    dots AS (SELECT {key}, seed_ord, sum(d.f * s.f) AS dot
             FROM doc_words d JOIN seed_words s USING (w) GROUP BY {key}, seed_ord),
    scores AS MATERIALIZED (
        SELECT c.{key}, s.seed_ord, s.seed,
               coalesce(CAST(dot AS DOUBLE) / (sqrt(CAST(dn.n2 AS DOUBLE)) * sqrt(CAST(sn.n2 AS DOUBLE))), 0.0) AS score
        FROM {corpus} c CROSS JOIN seeds s
        LEFT JOIN dots d ON d.{key} = c.{key} AND d.seed_ord = s.seed_ord
        LEFT JOIN doc_norms dn ON dn.{key} = c.{key}
        LEFT JOIN seed_norms sn ON sn.seed_ord = s.seed_ord),
    vector AS MATERIALIZED (
        SELECT {key}, score >= 0.85 AS triggered, floor(score * 1000 + 0.5) / 1000.0 AS similarity_score,
               CASE WHEN score > 0 THEN seed ELSE '' END AS closest_seed
        FROM scores QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, seed_ord) = 1)"""


# --- verdict ----------------------------------------------------------------


def verdict_cte(key: str = "doc_id", corpus: str = "corpus") -> str:
    """Needs the corpus; gives one row per text with the whole verdict."""
    return ",".join(
        [
            hits_cte(corpus=corpus, key=key),
            masked_cte(corpus, key),
            signals_cte(corpus, key),
            similarity_cte(corpus, key),
            f"""
    n_hits AS (SELECT {key}, CAST(count(*) AS INT) AS n_pii,
                      list('PII:' || type ORDER BY ord) AS pii_rules FROM hits GROUP BY {key}),
    n_signals AS (SELECT {key}, CAST(count(*) AS INT) AS n_signals, max(rank) AS top,
                         list(rule_name ORDER BY ord) AS names FROM signals GROUP BY {key}),
    findings AS (
        SELECT c.*, v.triggered, v.similarity_score, v.closest_seed, m.masked_text AS masked_prompt,
               coalesce(h.n_pii, 0) AS n_pii, coalesce(s.n_signals, 0) AS n_signals, coalesce(s.top, 0) AS top,
               coalesce(s.names, []) AS names, coalesce(h.pii_rules, []) AS pii_rules
        FROM {corpus} c JOIN vector v USING ({key}) JOIN masked m USING ({key})
        LEFT JOIN n_hits h USING ({key}) LEFT JOIN n_signals s USING ({key})),
    levels AS (
        SELECT *, CASE
            WHEN n_signals = 0 AND n_pii = 0 AND NOT triggered THEN 'LOW'
            WHEN top = 4 OR (n_pii > 0 AND (triggered OR top = 3)) THEN 'CRITICAL'
            WHEN triggered OR top = 3 OR (top = 2 AND n_pii > 0) THEN 'HIGH'
            ELSE 'MEDIUM' END AS risk_level
        FROM findings),
    verdicts AS MATERIALIZED (
        SELECT *,
            CASE WHEN n_signals = 0 AND n_pii = 0 AND NOT triggered THEN 'NONE'
                 WHEN n_signals > 0 AND n_pii = 0 AND NOT triggered THEN 'PROMPT_INJECTION'
                 WHEN n_signals = 0 AND n_pii > 0 AND NOT triggered THEN 'PII_DETECTED'
                 WHEN n_signals = 0 AND n_pii = 0 THEN 'VECTOR_SIMILARITY'
                 ELSE 'COMBINED' END AS attack_type,
            risk_level IN ('HIGH', 'CRITICAL') AND (n_signals > 0 OR triggered) AS blocked,
            list_concat(list_concat(names, pii_rules),
                        CASE WHEN triggered THEN ['VECTOR:' || closest_seed] ELSE [] END) AS triggered_rules
        FROM levels)""",
        ]
    )


def with_ctes(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# --- conversations ----------------------------------------------------------


def _planted_conversations() -> str:
    texts = _list(p[1] for p in PLANTED)
    return f"""planted AS MATERIALIZED (
        SELECT conv_id, turn, role, CASE WHEN role = 'user'
            THEN text || ' ' || ({texts})[CAST((conv_id * 7 + turn) % {COUNT} AS INT) + 1] ELSE text END AS text
        FROM conversations)"""


_LATEST = """latest AS MATERIALIZED (
        SELECT conv_id, turn, text FROM {source} WHERE role = 'user' AND text IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)"""

# --- similarity to a table --------------------------------------------------


def _table_pairs(seeds: str, corpus: str, threshold: float) -> str:
    """All pairs with a common word, scored; ``seeds`` yields item_id and text."""
    words = (
        "SELECT {k}, w, count(*) * CASE WHEN w IN (" + ", ".join(q(b) for b in BOOST_TERMS) + ") THEN 3 ELSE 1 END AS f "
        "FROM (SELECT {k}, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM {s}) "
        "WHERE length(w) > 1 AND w NOT IN (" + ", ".join(q(s) for s in STOPWORDS) + ") GROUP BY {k}, w"
    )
    return f"""
    item_words AS ({words.format(k="item_id", s=seeds)}),
    item_norms AS (SELECT item_id, sum(f * f) AS n2 FROM item_words GROUP BY item_id),
    text_words AS MATERIALIZED ({words.format(k="doc_id", s=corpus)}),
    text_norms AS (SELECT doc_id, sum(f * f) AS n2 FROM text_words GROUP BY doc_id),
    pairs AS (
        SELECT doc_id, item_id, CAST(dot AS DOUBLE) / (sqrt(CAST(t.n2 AS DOUBLE)) * sqrt(CAST(i.n2 AS DOUBLE))) AS score
        FROM (SELECT doc_id, item_id, sum(d.f * s.f) AS dot FROM text_words d JOIN item_words s USING (w) GROUP BY ALL)
        JOIN text_norms t USING (doc_id) JOIN item_norms i USING (item_id) WHERE score >= {threshold})"""


# --- audit ------------------------------------------------------------------

_SCANNED = f"""scanned AS MATERIALIZED (
    SELECT e.*, v.* EXCLUDE (doc_id, source, lang), sha256(v.text) AS prompt_hash,
           sha256(CASE WHEN e.session_id IS NULL THEN '' ELSE e.session_id || ':' END
                  || CAST(epoch_us(e.ts) AS VARCHAR) || ':' || sha256(v.text)) AS id
    FROM (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, event_id, ts,
                 CASE WHEN event_type <> 'error' THEN 'User-' || user_id END AS session_id,
                 CAST(trunc(value) AS INT) AS latency_ms FROM events) e
    JOIN verdicts v ON v.doc_id = e.doc_id),
audit AS (
    SELECT id, ts AS timestamp, prompt_hash, left(masked_prompt, 2000) AS masked_prompt, risk_level, attack_type,
           latency_ms AS latency, '{DEFAULT_MODEL}' AS model_used, blocked,
           to_json(triggered_rules)::VARCHAR AS triggered_rules,
           CASE WHEN triggered THEN similarity_score END AS similarity_score, session_id
    FROM scanned),
now AS (SELECT max(ts) AS t FROM events),
recent AS (SELECT * FROM audit, now WHERE timestamp BETWEEN t - INTERVAL 24 HOUR AND t)"""

_BREAKDOWN = (
    "types(ord, name) AS (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(ATTACK_ORDER))
    + """),
breakdown AS (SELECT ord, name, CAST(count(r.attack_type) AS BIGINT) AS value
              FROM types LEFT JOIN recent r ON r.attack_type = name GROUP BY ord, name)"""
)

_LABEL = """CASE WHEN {s} LIKE 'Sim-%' OR {s} LIKE 'User-%' THEN {s}
    WHEN regexp_matches({s}, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-') THEN 'User-' || left(replace({s}, '-', ''), 4)
    WHEN length({s}) <= 22 THEN {s} ELSE left({s}, 8) || '…' || right({s}, 4) END"""

_RANKING = f"""ranking AS (
    SELECT CAST(row_number() OVER (ORDER BY threat_count DESC, session_id) AS INT) AS rank, session_id,
           {_LABEL.format(s='session_id')} AS session_label, threat_count, blocked_count, total, rate_pct,
           CASE WHEN rate_pct >= 70 THEN 'high' WHEN rate_pct >= 40 THEN 'mid' ELSE 'low' END AS severity_band
    FROM (SELECT *, CAST(floor(threat_count / total * 100 + 0.5) AS INT) AS rate_pct
          FROM (SELECT session_id, count(*) FILTER (attack_type <> 'NONE') AS threat_count,
                       count(*) FILTER (blocked) AS blocked_count, count(*) AS total
                FROM audit WHERE session_id IS NOT NULL GROUP BY session_id)
          WHERE threat_count > 0 ORDER BY threat_count DESC, session_id LIMIT 5))"""

_SUMMARY = """summary AS (
    SELECT count(*) AS total_24h, count(*) FILTER (blocked) AS blocked_24h,
           count(*) FILTER (attack_type IN ('PII_DETECTED', 'COMBINED')) AS pii_detected,
           CAST(coalesce(floor(avg(latency) + 0.5), 0) AS INT) AS avg_latency_ms,
           (SELECT count(*) FROM audit) AS all_time_total,
           CAST(CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (blocked) / count(*) * 100 + 0.5) ELSE 0 END AS INT)
               AS block_rate_24h
    FROM recent)"""


_ACTIVITY = """
    SELECT session_id, min(timestamp) AS started, max(timestamp) AS ended, count(*) AS total,
           count(*) FILTER (blocked) AS blocked
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS island
          FROM (SELECT *, CASE WHEN timestamp <= lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp)
                                               + INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS fresh
                FROM audit WHERE session_id IS NOT NULL))
    GROUP BY session_id, island"""

_ALERTS = """
    SELECT session_id, window_start, window_start + INTERVAL 1 HOUR AS window_end,
           count(*) FILTER (blocked) AS blocked, count(*) AS total
    FROM (SELECT session_id, blocked,
                 time_bucket(INTERVAL 10 MINUTE, timestamp) - to_minutes(CAST(10 * unnest(range(6)) AS INT)) AS window_start
          FROM audit WHERE session_id IS NOT NULL)
    GROUP BY session_id, window_start HAVING count(*) FILTER (blocked) >= 2"""

_HORIZON = """
    SELECT prompt_hash, date_trunc('day', timestamp)::TIMESTAMP AS horizon_start, min(timestamp) AS timestamp,
           min(id) FILTER (earliest) AS id, count(*) AS times
    FROM (SELECT *, timestamp = min(timestamp) OVER (PARTITION BY prompt_hash, date_trunc('day', timestamp)) AS earliest FROM audit)
    GROUP BY prompt_hash, date_trunc('day', timestamp)"""


def _audit(sql: str, *more: str) -> str:
    return with_ctes(planted_cte(), verdict_cte(), _SCANNED, *more) + sql


def _past(sql: str, *more: str) -> str:
    """The same with an instant 30 hours before the newest event."""
    return _audit(sql, *more).replace("SELECT max(ts) AS t", "SELECT max(ts) - INTERVAL 30 HOUR AS t")


def _verdicts(sql: str, *more: str) -> str:
    return with_ctes(planted_cte(), verdict_cte(), *more) + sql


def _events_sql() -> str:
    hits = """coalesce((SELECT list({'type': type, 'masked': masked, 'start': start, 'end': "end"} ORDER BY ord)
              FROM hits WHERE hits.doc_id = s.doc_id), [])"""
    sigs = """coalesce((SELECT list({'ruleName': rule_name, 'description': description, 'severity': severity} ORDER BY ord)
              FROM signals WHERE signals.doc_id = s.doc_id), [])"""
    return f"""
    SELECT id AS request_id, ts AS timestamp, CAST(1 AS INT) AS ord, 'metadata' AS event_type,
        to_json({{'type': 'metadata', 'scanResult': {{
            'riskLevel': risk_level, 'attackType': attack_type, 'blocked': blocked, 'piiMatches': {hits},
            'maskedPrompt': masked_prompt, 'injectionSignals': {sigs},
            'vectorCheck': {{'triggered': triggered, 'similarityScore': similarity_score, 'closestSeed': closest_seed}},
            'triggeredRules': triggered_rules, 'latencyMs': latency_ms}},
          'model': CASE WHEN blocked THEN 'BLOCKED' ELSE '{DEFAULT_MODEL}' END,
          'requestId': id, 'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')}})::VARCHAR AS event
    FROM scanned s
    UNION ALL
    SELECT id, ts, 2, 'error',
        to_json({{'type': 'error', 'message': '{BLOCK_MESSAGE}', 'code': 'BLOCKED_' || risk_level}})::VARCHAR
    FROM scanned WHERE blocked"""


def _report_sql() -> str:
    from promptward.operators import report as rep

    def fixed(section: int, lines, start: int = 0) -> str:
        rows = ", ".join(f"({section}, {i}, {q(line)})" for i, line in enumerate(lines, start))
        return f"SELECT * FROM (VALUES {rows}) AS t(section, ord, line)"

    stamp = "strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ')"
    head = ["# Prompt security compliance report", "", None, "> **Report version**: v1.0.0",
            "> **Standard**: GDPR Article 5(1)(c) · Article 5(1)(f)", "", "---", ""]
    parts = [
        fixed(1, [h for h in head[:2]]),
        f"SELECT 1, 2, '> **Generated**: ' || {stamp} FROM now",
        fixed(1, head[3:], 3),
        fixed(2, ["## Summary", "", "| Metric | Value |", "|---|---|"]),
        *[
            f"SELECT 2, {i}, '| {label} | **' || {column} || '{unit}** |' FROM summary"
            for i, (label, column, unit) in enumerate(
                (
                    ("Scanned requests (all time)", "all_time_total", ""),
                    ("Scanned requests (24 h)", "total_24h", ""),
                    ("Blocked requests (24 h)", "blocked_24h", ""),
                    ("Block rate (24 h)", "block_rate_24h", "%"),
                    ("PII events", "pii_detected", ""),
                    ("Mean scan latency", "avg_latency_ms", " ms"),
                ),
                4,
            )
        ],
        fixed(2, ["", "---", ""], 10),
        fixed(3, ["## Threats by type (24 h)", "", "| Attack type | Count |", "|---|---|"]),
        "SELECT 3, ord + 100, '| ' || name || ' | ' || value || ' |' FROM breakdown",
        fixed(4, ["", "---", "", "## Sessions at risk", "", "| Rank | Session | Threats | Requests | Rate |", "|---|---|---|---|---|"]),
        "SELECT 4, rank + 100, '| ' || rank || ' | `' || session_label || '` | ' || threat_count || ' | ' || total || ' | ' || rate_pct || '% |' FROM ranking",
        "SELECT 4, 101, '| - | no sessions at risk | - | - | - |' WHERE NOT EXISTS (FROM ranking)",
        fixed(5, ["", "---", "", *rep._PRINCIPLES]),
        fixed(6, rep._SPECS),
        f"SELECT 7, 0, '*Generated automatically · ' || {stamp} || '*' FROM now",
    ]
    return "SELECT CAST(section AS INT) AS section, CAST(ord AS INT) AS ord, line FROM (" + " UNION ALL ".join(parts) + ")"


def oracle_sql() -> dict[str, str]:
    corpus = planted_cte()
    hit_columns = 'doc_id, type, ord, start, "end", masked, value'
    scan_columns = (
        "doc_id, risk_level, attack_type, blocked, n_pii, n_signals, triggered, similarity_score, "
        "closest_seed, masked_prompt"
    )
    sql = {
        f"pii_matches_{name}": with_ctes(RAW_CTE, hits_cte([kind])) + f"SELECT {hit_columns} FROM hits"
        for name, kind in (("email", "EMAIL"), ("ip", "IP_ADDRESS"), ("card", "CREDIT_CARD"))
    }
    sql |= {
        "pii_matches": with_ctes(corpus, hits_cte()) + f"SELECT {hit_columns} FROM hits",
        "pii_counts": with_ctes(RAW_CTE, hits_cte())
        + "SELECT type, lang, count(*) AS hits, count(DISTINCT doc_id) AS texts FROM hits JOIN corpus USING (doc_id) GROUP BY ALL",
        "pii_counts_planted": with_ctes(corpus, hits_cte())
        + "SELECT type, source, count(*) AS hits, count(DISTINCT doc_id) AS texts FROM hits JOIN corpus USING (doc_id) GROUP BY ALL",
        "mask_pii": with_ctes(RAW_CTE, hits_cte(), masked_cte()) + "SELECT doc_id, masked_text FROM masked",
        "masked_corpus": with_ctes(corpus, hits_cte(), masked_cte())
        + """SELECT doc_id, masked_text AS text, coalesce(kinds, '') AS pii_types, coalesce(n, 0) AS pii_count
             FROM masked LEFT JOIN (
                 SELECT doc_id, CAST(sum(n) AS INT) AS n, string_agg(type, ',' ORDER BY prio) AS kinds
                 FROM (SELECT doc_id, type, prio, count(*) AS n FROM hits GROUP BY ALL) GROUP BY doc_id)
             USING (doc_id)""",
        "id_checksum": with_ctes(corpus)
        + f"""SELECT doc_id, CAST(pos - 1 AS INT) AS pos, v AS value, {_checksum('v')} AS valid
              FROM (SELECT doc_id, unnest(range(1, len(vs) + 1)) AS pos, unnest(vs) AS v
                    FROM (SELECT doc_id, regexp_extract_all(text, {q(PII_PATTERNS['ID_CARD_CN'])}, 0) AS vs FROM corpus))""",
        "prompt_hashes": "SELECT doc_id, sha256(text) AS prompt_hash FROM documents",
        "injection_signals": with_ctes(corpus, signals_cte())
        + "SELECT doc_id, layer, rule_name, description, severity, matched, ord FROM signals",
        "injection_signals_raw": with_ctes(RAW_CTE, signals_cte())
        + "SELECT doc_id, layer, rule_name, description, severity, matched, ord FROM signals",
        "keyword_hits": with_ctes(corpus, signals_cte(keywords_only=True))
        + "SELECT doc_id, rule_name, description, severity, matched FROM signals",
        "rule_prevalence": with_ctes(corpus, signals_cte())
        + "SELECT lang, rule_name, severity, count(*) AS texts FROM signals JOIN corpus USING (doc_id) GROUP BY ALL",
        "max_severity": with_ctes(corpus, signals_cte())
        + """SELECT doc_id, CAST(coalesce(max(rank), 0) AS INT) AS max_severity
             FROM corpus LEFT JOIN signals USING (doc_id) GROUP BY doc_id""",
        "seed_similarity": with_ctes(corpus, similarity_cte()) + "SELECT doc_id, seed, score FROM scores",
        "vector_check": with_ctes(corpus, similarity_cte())
        + "SELECT doc_id, triggered, similarity_score, closest_seed FROM vector",
        "similarity_histogram": with_ctes(corpus, similarity_cte())
        + """SELECT CAST(least(floor(similarity_score * 10), 9) AS INT) AS bucket, closest_seed, count(*) AS texts
             FROM vector GROUP BY ALL""",
        "verdicts": _verdicts(f"SELECT {scan_columns} FROM verdicts"),
        "verdicts_raw": with_ctes(RAW_CTE, verdict_cte())
        + """SELECT doc_id, risk_level, attack_type, blocked, triggered, similarity_score, closest_seed, masked_prompt
             FROM verdicts""",
        "risk_level": _verdicts(
            "SELECT risk_level, attack_type, blocked, count(*) AS texts FROM verdicts GROUP BY ALL"
        ),
        "triggered_rules": _verdicts(
            """SELECT doc_id, CAST(unnest(range(0, len(triggered_rules))) AS INT) AS pos, unnest(triggered_rules) AS rule
               FROM verdicts"""
        ),
        "stage_status": _verdicts(
            """SELECT v.doc_id, CASE WHEN n_pii > 0 THEN 'masked' ELSE 'clean' END AS pii_status,
                   CASE WHEN blocked OR n_signals > 0 THEN 'blocked' ELSE 'passed' END AS injection_status,
                   CASE WHEN triggered THEN 'triggered' ELSE 'safe' END AS vector_status,
                   CASE WHEN n_pii = 0 THEN '0 items detected' ELSE n_pii || ' item(s) masked' END AS pii_detail,
                   CASE WHEN n_signals = 0 THEN '0 signals detected' ELSE n_signals || ' signal(s) fired' END
                       AS injection_detail,
                   'similarity: ' || printf('%.3f', similarity_score) AS vector_detail,
                   coalesce(kinds, '') AS pii_tags, array_to_string(names[1:4], '|') AS injection_tags,
                   CASE WHEN triggered THEN left(closest_seed, 36) ELSE '' END AS vector_tags
               FROM verdicts v LEFT JOIN (
                   SELECT doc_id, array_to_string((list(type ORDER BY prio))[1:5], '|') AS kinds
                   FROM (SELECT DISTINCT doc_id, type, prio FROM hits) GROUP BY doc_id) k ON k.doc_id = v.doc_id"""
        ),
        "badge_columns": _verdicts(
            """SELECT doc_id, n_pii AS pii_badge,
                   CASE WHEN blocked THEN 'BLOCKED · ' || risk_level || ' RISK · ' || attack_type END AS blocked_badge,
                   CASE WHEN attack_type = 'NONE' THEN 'CLEAN' ELSE attack_type END AS attack_label
               FROM verdicts"""
        ),
        "latest_user_prompt": with_ctes(_LATEST.format(source="conversations"))
        + "SELECT conv_id, turn, text FROM latest",
        "rejected_messages": "SELECT conv_id, turn, role FROM conversations WHERE role = 'assistant'",
        "sanitize_conversation": with_ctes(
            _planted_conversations(),
            "turns AS (SELECT conv_id * 1000000 + turn AS turn_id, text FROM planted WHERE role = 'user')",
            hits_cte(corpus="turns", key="turn_id"),
            masked_cte("turns", "turn_id"),
        )
        + """SELECT conv_id, turn, role, coalesce(masked_text, text) AS text
             FROM planted LEFT JOIN masked ON role = 'user' AND turn_id = conv_id * 1000000 + turn""",
        "sanitize_latest": with_ctes(
            _planted_conversations(),
            _LATEST.format(source="planted"),
            hits_cte(corpus="latest", key="conv_id"),
            masked_cte("latest", "conv_id"),
        )
        + """SELECT p.conv_id, p.turn, p.role,
                    CASE WHEN p.role = 'user' AND p.text = l.text THEN m.masked_text ELSE p.text END AS text
             FROM planted p LEFT JOIN latest l ON l.conv_id = p.conv_id LEFT JOIN masked m ON m.conv_id = p.conv_id""",
        "forwardable": with_ctes(
            _planted_conversations(), _LATEST.format(source="planted"), verdict_cte("conv_id", "latest")
        )
        + """SELECT conv_id, turn, role, text FROM planted
             WHERE conv_id IN (SELECT conv_id FROM verdicts WHERE NOT blocked)""",
        "audit_rows": _audit("SELECT * FROM audit"),
        "recent_audit": _audit("SELECT timestamp, blocked, risk_level, attack_type, latency, session_id FROM recent"),
        "recent_audit_past": _past(
            "SELECT timestamp, blocked, risk_level, attack_type, latency, session_id FROM recent"
        ),
        "summary_metrics_past": _past("SELECT * FROM summary", _SUMMARY),
        "not_forwardable": with_ctes(
            _planted_conversations().replace("planted AS", "given AS", 1),
            "planted AS MATERIALIZED (SELECT * REPLACE (CASE WHEN conv_id % 10 = 7 THEN 'assistant' ELSE role END AS role) FROM given)",
            _LATEST.format(source="planted"),
            verdict_cte("conv_id", "latest"),
        )
        + """SELECT conv_id, turn, role, text FROM planted
             WHERE conv_id NOT IN (SELECT conv_id FROM verdicts WHERE NOT blocked)""",
        "threats": _audit(
            "SELECT id, session_id, attack_type FROM audit WHERE attack_type <> 'NONE' AND session_id IS NOT NULL"
        ),
        "hourly_timeline": _audit(
            """SELECT CAST(slot AS INT) AS slot, h AS hour, CASE WHEN slot % 4 = 0 THEN h ELSE '' END AS label,
                   count(timestamp) AS total, count(*) FILTER (blocked) AS blocked
               FROM (SELECT slot, strftime(t - to_hours(CAST(23 - slot AS INT)), '%H:00') AS h
                     FROM range(24) r(slot), now) s
               LEFT JOIN recent ON strftime(timestamp, '%H:00') = h GROUP BY slot, h"""
        ),
        "attack_breakdown": _audit("SELECT * FROM breakdown", _BREAKDOWN),
        "attack_share": _audit(
            """SELECT ord, name, value, share, CAST(floor(share * 100 + 0.5) AS INT) || '%' AS label,
                   share >= 0.06 AS show_label
               FROM (SELECT *, value / sum(value) OVER () AS share FROM breakdown WHERE value > 0)""",
            _BREAKDOWN,
        ),
        "risk_distribution": _audit("SELECT risk_level, count(*) AS rows FROM recent GROUP BY ALL"),
        "session_ranking": _audit("SELECT * FROM ranking", _RANKING),
        "summary_metrics": _audit("SELECT * FROM summary", _SUMMARY),
        "all_time_metrics": _audit("SELECT count(*) AS rows, avg(latency) AS avg_latency FROM audit"),
        "pii_rows": _audit("SELECT count(*) FILTER (n_pii > 0) AS pii_rows FROM scanned"),
        "audit_page": _audit(
            """SELECT id, timestamp, risk_level, attack_type, session_id FROM audit
               ORDER BY timestamp DESC, id LIMIT 20 OFFSET 40"""
        ),
        "audit_page_filtered": _audit(
            """SELECT id, timestamp, risk_level, attack_type, session_id FROM audit WHERE risk_level = 'CRITICAL'
               ORDER BY timestamp DESC, id LIMIT 25 OFFSET 25"""
        ),
        "page_info": _audit(
            """SELECT CAST(2 AS INT) AS page, CAST(20 AS INT) AS "limit", count(*) AS total,
                   CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages FROM audit WHERE risk_level = 'HIGH'"""
        ),
        "risk_counts": _audit("SELECT risk_level, count(*) AS rows FROM audit GROUP BY ALL"),
        "risk_counts_wide": _audit(
            "SELECT "
            + ", ".join(f"count(*) FILTER (risk_level = '{r}') AS {r.lower()}" for r in RISK_LEVELS)
            + " FROM audit"
        ),
        "recent_scans": _audit(
            """SELECT session_id, id, timestamp, risk_level, CAST(position AS INT) AS position
               FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id) AS position
                     FROM audit WHERE session_id IS NOT NULL) WHERE position <= 8"""
        ),
        "prompt_repeats": _audit(
            """SELECT prompt_hash, count(*) AS times, count(DISTINCT session_id) AS sessions,
                   min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM audit GROUP BY prompt_hash"""
        ),
        "distinct_prompts": _audit(
            """SELECT prompt_hash, id, timestamp, risk_level, masked_prompt FROM audit
               QUALIFY row_number() OVER (PARTITION BY prompt_hash ORDER BY timestamp, id) = 1"""
        ),
        "session_labels": f"""
            SELECT event_id, session_id, {_LABEL.format(s='session_id')} AS label
            FROM (SELECT event_id, CASE event_type
                      WHEN 'click' THEN 'User-' || user_id
                      WHEN 'view' THEN substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4)
                          || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12)
                      WHEN 'error' THEN 'Sim-' || d WHEN 'purchase' THEN 's' || event_id ELSE d END AS session_id
                  FROM (SELECT *, sha256(CAST(event_id AS VARCHAR)) AS d FROM events))""",
        "scan_events": _audit(
            f"SELECT request_id, timestamp, ord, event_type, event FROM ({_events_sql()})"
        ),
        "scan_history": _audit(
            """SELECT id, timestamp, risk_level, attack_type, latency AS latency_ms,
                   CASE WHEN blocked THEN 'BLOCKED' ELSE model_used END AS model, blocked FROM audit"""
        ),
        "compliance_report": _audit(_report_sql(), _BREAKDOWN, _RANKING, _SUMMARY),
        "detector_eval": _verdicts(
            """SELECT doc_id, payload_id, expected_risk, risk_level, risk_level = expected_risk AS matches
               FROM verdicts"""
        ),
        "confusion_matrix": _verdicts(
            "SELECT expected_risk, risk_level AS actual_risk, count(*) AS texts FROM verdicts GROUP BY ALL"
        ),
        "stream_scan": _verdicts(
            """SELECT doc_id, risk_level, attack_type, blocked, triggered, similarity_score, closest_seed, masked_prompt
               FROM verdicts"""
        ),
        "route_stream": _verdicts(
            """SELECT 'passed' AS output, count(*) FILTER (NOT blocked) AS rows FROM verdicts
               UNION ALL SELECT 'blocked', 2 * count(*) FILTER (blocked) FROM verdicts
               UNION ALL SELECT 'audit', count(*) FROM verdicts"""
        ),
        # The last hours stay open until the watermark, one hour behind, has passed them.
        "stream_timeline": _audit(
            """SELECT hour_start, count(*) AS total, count(*) FILTER (blocked) AS blocked
               FROM (SELECT date_trunc('hour', timestamp) AS hour_start, blocked FROM audit)
               WHERE hour_start + INTERVAL 2 HOUR <= (SELECT t FROM now) GROUP BY hour_start"""
        ),
        "stream_session_threats": _audit(
            "SELECT session_id, threat_count, blocked_count, total FROM ranking", _RANKING
        ),
        "stream_dedup": _audit("SELECT DISTINCT prompt_hash, risk_level FROM audit"),
        "seed_table_check": with_ctes(_table_pairs("benchmark", "documents", 0.3))
        + """SELECT doc_id, item_id, score FROM pairs
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1""",
        "seed_table_pairs": with_ctes(
            corpus,
            "items(item_id, text) AS (SELECT CAST(item_id AS VARCHAR), text FROM benchmark UNION ALL VALUES "
            + ", ".join(f"({q(label)}, {q(text)})" for label, text in SEEDS.items())
            + ")",
            _table_pairs("items", "corpus", 0.25),
        )
        + "SELECT doc_id, item_id, score FROM pairs",
        "rule_cooccurrence": with_ctes(
            corpus.replace("corpus AS", "given AS", 1),
            f"""corpus AS MATERIALIZED (SELECT doc_id, text || ' ' ||
                ({_list(p[1] for p in PLANTED)})[CAST((doc_id // 3 + 11) % {COUNT} AS INT) + 1] AS text FROM given)""",
            signals_cte(),
            "fired AS (SELECT DISTINCT doc_id, rule_name FROM signals)",
            "single AS (SELECT rule_name, count(*) AS n FROM fired GROUP BY rule_name)",
        )
        + """SELECT a.rule_name AS rule_a, b.rule_name AS rule_b, count(*) AS texts, any_value(x.n) AS texts_a,
                    any_value(y.n) AS texts_b,
                    count(*) * (SELECT count(*) FROM corpus) / (any_value(x.n) * any_value(y.n)) AS lift
             FROM fired a JOIN fired b ON a.doc_id = b.doc_id AND a.rule_name < b.rule_name
             JOIN single x ON x.rule_name = a.rule_name JOIN single y ON y.rule_name = b.rule_name
             GROUP BY a.rule_name, b.rule_name""",
        "pii_density": with_ctes(corpus, hits_cte())
        + """SELECT CAST(grouping(source, lang) AS INT) AS level, source, lang, CAST(coalesce(sum(n), 0) AS BIGINT) AS hits,
                    CAST(sum(length(text)) AS BIGINT) AS chars,
                    CASE WHEN sum(length(text)) > 0 THEN CAST(coalesce(sum(n), 0) AS BIGINT) * 1000 / CAST(sum(length(text)) AS BIGINT)
                         ELSE 0 END AS per_1000_chars
             FROM corpus LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id) USING (doc_id)
             GROUP BY CUBE (source, lang)""",
        "label_eval": with_ctes(corpus, similarity_cte())
        + """, graded AS (SELECT similarity_score AS s, toxic FROM vector JOIN labels USING (doc_id) WHERE toxic IN (0, 1))
             SELECT cut, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
                    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall
             FROM (SELECT i / 100 AS cut, (SELECT count(*) FROM graded WHERE toxic = 1 AND floor(s * 100) >= i) AS tp,
                          (SELECT count(*) FROM graded WHERE toxic = 0 AND floor(s * 100) >= i) AS fp,
                          (SELECT count(*) FROM graded WHERE toxic = 1 AND floor(s * 100) < i) AS fn
                   FROM range(101) r(i))""",
        "audit_page_after": _audit(
            """SELECT id, timestamp, risk_level, attack_type, session_id FROM audit
               ORDER BY timestamp DESC, id LIMIT 20 OFFSET 40"""
        ),
        "session_activity": _audit(f"SELECT * FROM ({_ACTIVITY})"),
        "session_alerts": _audit(f"SELECT * FROM ({_ALERTS})"),
        "first_in_horizon": _audit(f"SELECT * FROM ({_HORIZON})"),
        # Closed is what ends before the watermark, one hour behind the newest event.
        "stream_session_activity": _audit(
            f"SELECT * FROM ({_ACTIVITY}) WHERE ended + INTERVAL 150 MINUTE <= (SELECT t FROM now)"
        ),
        "stream_alerts": _audit(f"SELECT * FROM ({_ALERTS}) WHERE window_end + INTERVAL 1 HOUR <= (SELECT t FROM now)"),
        "stream_first_in_horizon": _audit(
            f"SELECT * FROM ({_HORIZON}) WHERE horizon_start + INTERVAL 25 HOUR <= (SELECT t FROM now)"
        ),
        "stream_session_ranking": _audit(
            "SELECT session_id, threat_count, blocked_count, total FROM ranking", _RANKING
        ),
        "stream_latest_prompt": with_ctes(_LATEST.format(source="conversations")) + "SELECT conv_id, turn, text FROM latest",
    }
    return sql


