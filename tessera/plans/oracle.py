"""Literals of the SQL that queries are held against, written down by themselves: nothing here is read from the rule tables."""

from __future__ import annotations

#: (capability, rule, severity, pattern, second pattern, bits); a rule with bits measures group 1.
PLAIN = (
    ("security.scan/secret", "aws-access-key", 4, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "", 0),
    ("security.scan/secret", "github-token", 4, r"\bgh[pousr]_[0-9A-Za-z]{36}\b", "", 0),
    ("security.scan/secret", "stripe-key", 4, r"\bsk_(?:live|test)_[0-9A-Za-z]{16,}\b", "", 0),
    ("security.scan/secret", "google-api-key", 3, r"\bAIza[0-9A-Za-z_\-]{35}\b", "", 0),
    ("security.scan/secret", "jwt", 2, r"\beyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\b", "", 0),
    ("security.scan/secret", "gitlab-token", 4, r"\bglpat-[0-9A-Za-z_\-]{20,}", "", 0),
    ("security.scan/secret", "slack-token", 4, r"\bxox[abposr]-[0-9A-Za-z\-]{10,}\b", "", 0),
    ("security.scan/secret", "sendgrid-key", 4, r"\bSG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}\b", "", 0),
    ("security.scan/secret", "npm-token", 4, r"\bnpm_[0-9A-Za-z]{36}\b", "", 0),
    ("security.scan/secret", "twilio-sid", 3, r"\bAC[0-9a-f]{32}\b", "", 0),
    ("security.scan/secret", "twilio-auth-token", 3, r"(?i)twilio[^0-9a-f]{0,40}\b[0-9a-f]{32}\b|auth[_-]?token[^0-9a-f]{0,8}\b[0-9a-f]{32}\b", "", 0),
    ("security.scan/secret", "azure-account-key", 4, r"(?i)AccountKey=[0-9A-Za-z+/=]{40,}", "", 0),
    ("security.scan/secret", "aws-secret-key", 3, r"""(?i)\baws.{0,20}["'][0-9A-Za-z/+]{40}["']""", "", 0),
    ("security.scan/secret", "llm-api-key", 4, r"\bsk-[A-Za-z0-9_\-]{20,}\b|\bhf_[A-Za-z0-9]{30,}\b", "", 0),
    ("security.scan/secret", "digitalocean-token", 4, r"\bdop_v1_[0-9a-f]{64}\b", "", 0),
    ("security.scan/secret", "mailgun-key", 4, r"\bkey-[0-9a-f]{32}\b", "", 0),
    ("security.scan/secret", "mapbox-secret-token", 3, r"\bsk\.[A-Za-z0-9._-]{40,}\b", "", 0),
    ("security.scan/secret", "sentry-dsn", 3, r"(?i)\bhttps?://[0-9a-f]{16,}(?::[0-9a-f]+)?@[\w.-]*sentry[\w.-]*/\d+\b", "", 0),
    ("security.scan/secret", "firebase-fcm-key", 3, r"\bAAAA[A-Za-z0-9_\-]{7}:[A-Za-z0-9_\-]{140,}\b", "", 0),
    ("security.scan/secret", "db-uri-password", 3, r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^:@/\s]+:[^@/\s]+@", "", 0),
    ("security.scan/secret", "private-key", 4, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", "", 0),
    ("security.scan/secret", "gcp-private-key", 4, r'(?i)"private_key"\s*:\s*"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----', "", 0),
    ("security.scan/secret", "generic-secret", 3, r"""(?i)\b(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|auth[_-]?token|token)\b\s*[:=]\s*["']([^"'\s]{12,31})["']""", "", 3.5),
    ("security.scan/secret", "generic-secret-long", 3, r"""(?i)\b(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|auth[_-]?token|token)\b\s*[:=]\s*["']([^"'\s]{32,})["']""", "", 3.0),
    ("security.scan/secret", "generic-passphrase", 2, r"""(?i)\b(?:password|passwd|passphrase|secret)\b\s*[:=]\s*["']([^"']{16,})["']""", "", 2.8),
    ("security.scan/secret", "generic-secret-unquoted", 3, r"(?i)^\s*(?:export\s+)?[A-Za-z0-9_.\-]*(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|auth[_-]?token|token)[A-Za-z0-9_.\-]*\s*[:=]\s*([A-Za-z0-9_+/=\-]{16,})\s*$", "", 3.5),
    ("security.scan/secret", "generic-secret-plist", 3, r"(?i)<key>\s*[A-Za-z0-9_.\-]*(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|auth[_-]?token|token)[A-Za-z0-9_.\-]*\s*</key>\s*<(?:string|value)>([^<\s]{16,})</", "", 3.2),
    ("security.scan/secret", "generic-secret-xml", 3, r"""(?i)<(?:string|value)\s+name\s*=\s*["'][A-Za-z0-9_.\-]*(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|auth[_-]?token|token)[A-Za-z0-9_.\-]*["']\s*>([^<\s]{16,})</""", "", 3.2),
    ("security.scan/pii", "ssn-us", 3, r"\b\d{3}-\d{2}-\d{4}\b", "", 0),
    ("security.scan/pii", "credit-card", 2, r"\b(?:\d{4}[ -]){3}\d{4}\b|\b\d{16}\b", "", 0),
    ("security.scan/pii", "pii-in-log", 2, r"(?i)console\.log|print\(|println|logger\.|log\.info|log\.debug", r"(?i)password|email|ssn|token|secret", 0),
    ("security.scan/pii", "email-literal", 0, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "", 0),
    ("quality.check/smell", "debt-marker", 0, r"TODO|FIXME|XXX", "", 0),
)

LINES = r"""lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, i AS line_no, regexp_replace(l[i], '\r$', '') AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) t, unnest(range(1, len(t.l) + 1)) AS r(i)
  WHERE NOT (i = len(t.l) AND l[i] = '')
)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bits(v: str) -> str:
    share = f"(len(list_filter(string_split({v}, ''), lambda d: d = c)) / CAST(length({v}) AS DOUBLE))"
    return f"-list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: {share} * log2({share})))"


def _findings() -> str:
    order = {c: i for i, c in enumerate(dict.fromkeys(r[0] for r in PLAIN))}
    parts = []
    for cap, rule, severity, pattern, also, least in PLAIN:
        head = f"SELECT path, line_no, line, '{rule}' AS rule, {severity} AS severity, '{cap}' AS cap, {order[cap]} AS cap_ord FROM lines WHERE "
        if least:
            parts.append(head + f"len(list_filter(regexp_extract_all(line, {quoted(pattern)}, 1), lambda v: {bits('v')} >= {least})) > 0")
        else:
            whole = "private-key" in rule
            parts.append(head + ("" if whole else "strlen(line) <= 2000 AND ") + f"regexp_matches(line, {quoted(pattern)})" + (f" AND regexp_matches(line, {quoted(also)})" if also else ""))
    return f"WITH {LINES}, found AS (" + " UNION ALL ".join(parts) + ")"


FINDINGS = _findings()

SCORE = """
, kept AS (SELECT *, row_number() OVER (PARTITION BY rule, path, line_no ORDER BY cap_ord) AS k FROM found),
b AS (SELECT *, CASE WHEN severity >= 3 THEN 'blocking' WHEN rule IN ('debt-marker', 'email-literal', 'ssn-us', 'credit-card') THEN 'advisory' ELSE 'warning' END AS bucket FROM kept WHERE k = 1)
SELECT count(*) FILTER (WHERE bucket = 'blocking') AS blocking, count(*) FILTER (WHERE bucket = 'warning') AS warning,
       count(*) FILTER (WHERE bucket = 'advisory') AS advisory, CAST(0 AS BIGINT) AS dropped,
       CAST(greatest(0, least(100, 100 - coalesce(sum(CASE WHEN bucket <> 'advisory' THEN list_extract([0, 1, 4, 12, 25], severity + 1) END), 0))) AS BIGINT) AS score,
       count(*) FILTER (WHERE bucket = 'blocking') = 0 AS passed
FROM b"""

VERIFIED = r"""
, v AS (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS above FROM lines),
c AS (SELECT f.path, f.line_no, f.rule, f.severity, f.cap, f.line, coalesce(v.above, '') AS above,
  coalesce(CASE f.rule
    WHEN 'aws-secret-key' THEN nullif(regexp_extract(f.line, '(?i)\baws.{0,20}["'']([0-9A-Za-z/+]{40})["'']', 1), '')
    WHEN 'generic-secret' THEN nullif(regexp_extract(f.line, '(?i)\b(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|auth[_-]?token|token)\b\s*[:=]\s*["'']([^"''\s]{12,})["'']', 1), '')
    WHEN 'twilio-sid' THEN nullif(regexp_extract(f.line, '\bAC[0-9a-f]{32}\b'), '')
    WHEN 'jwt' THEN nullif(regexp_extract(f.line, '\beyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\b'), '')
  END, nullif(regexp_extract(f.line, '["'']([^"'']{1,200})["'']', 1), ''), nullif(trim(regexp_extract(f.line, '^[^=:]*[=:](.*)$', 1)), ''), f.line) AS value
  FROM found f JOIN v ON f.path = v.path AND f.line_no = v.line_no),
s AS (SELECT *, cap IN ('security.scan/secret', 'security.scan/pii') AS security,
  rule IN ('aws-access-key', 'llm-api-key', 'github-token', 'stripe-key', 'gitlab-token', 'slack-token', 'sendgrid-key', 'npm-token', 'azure-account-key', 'google-api-key', 'private-key') AS strict,
  rule IN ('aws-secret-key', 'generic-secret', 'twilio-sid', 'jwt') AS critical,
  regexp_matches(line, '\(\?[imsx]\)|\(\?:|Regex::new\(|regexp\.MustCompile\(|re\.compile\(') AS sure,
  greatest(6, CAST(ceil(length(value) / 2.0) AS BIGINT)) AS need FROM c)
SELECT path, line_no, rule, severity, why IS NULL AS verified, why AS refuted_by FROM (SELECT *, CASE
  WHEN contains(line, 'tessera:ignore') OR contains(above, 'tessera:ignore') THEN 'ignored'
  WHEN NOT strict AND (sure OR regexp_matches(line, '^\s*(?:FORBID|REQUIRE) |\.(?:contains|ends_with|starts_with|find)\("')) AND (NOT critical OR sure) THEN 'rule-definition'
  WHEN security AND regexp_matches(line, '^ *(//|#|\*|/\*|<!--)') THEN 'comment'
  WHEN security AND NOT strict AND regexp_matches(lower(value), 'changeme|change-me|change me|your_|your-|<your|example|placeholder|todo|dummy|fake|sample|xxxxxxxx|смени|замени|вставь|измени') THEN 'placeholder'
  WHEN security AND NOT strict AND len(list_filter(range(1, greatest(1, length(value) - need + 2)), lambda i: regexp_matches(substr(value, i, need), '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') OR contains('0123456789', substr(value, i, need)))) > 0 THEN 'number'
  END AS why FROM s)"""

BRANCHES = (" if ", " elif ", " for ", " while ", " case ", " match ", " when ", "catch", " and ", " or ", "&&", "||")
_TOKENS = " + ".join(f"(length(line) - length(replace(line, '{t}', ''))) // {len(t)}" for t in BRANCHES)
METRICS = f"WITH {LINES}, m AS (SELECT path, count(*) AS n_lines, CAST(1 + sum({_TOKENS}) AS BIGINT) AS complexity FROM lines GROUP BY path)"

CATEGORIES = """c AS (SELECT * FROM (VALUES ('A01', 'permissive-authz'), ('A01', 'cors-wildcard'), ('A01', 'cors-reflect-origin'), ('A01', 'idor-direct-ref'), ('A02', 'weak-hash'), ('A02', 'weak-cipher'), ('A02', 'ecb-mode'),
  ('A02', 'hardcoded-crypto-material'), ('A02', 'insecure-random'), ('A02', 'tls-verify-off'), ('A03', 'sql-injection'), ('A03', 'dangerous-exec'), ('A03', 'xss-sink'), ('A03', 'ssti'), ('A04', ''), ('A05', 'debug-enabled'), ('A06', ''),
  ('A07', 'jwt-none'), ('A07', 'jwt-alg-confusion'), ('A07', 'weak-pw-hash'), ('A08', 'insecure-deser'), ('A09', 'pii-in-log'), ('A10', 'ssrf'), ('A10', 'ssrf-internal-host')) AS t(category, rule))"""

AXES = """a AS (SELECT * FROM (VALUES ('Конституция', 'quality.check/constitution', true), ('Тесты', 'verify/test', true), ('Секреты', 'security.scan/secret', true), ('OWASP HIGH', 'security.scan/owasp', true),
  ('SAST (AST)', 'security.scan/sast', true), ('Taint-поток', 'security.scan/taint', true), ('Запахи кода', 'quality.check/smell', false), ('Недоделанное', 'quality.check/completeness', true),
  ('Анти-паттерны', 'quality.check/antipattern', false), ('Циклы зависимостей', 'quality.check/cycles', false), ('Мёртвый код', 'quality.check/dead-code', false), ('Доки/Спека актуальны', 'spec.check/drift', true),
  ('Контракт API не сломан', 'verify/api-break', true)) AS t(axis, source, hard)),
g AS (SELECT * FROM found WHERE verified AND (severity >= 3 OR rule NOT IN ('debt-marker', 'ssn-us', 'panic-path', 'credit-card', 'email-literal'))),
states AS (SELECT a.axis, a.hard, CASE WHEN (SELECT count(*) FROM checks WHERE id = a.source AND state = 'ran') = 0 THEN 'not run'
  WHEN (SELECT count(*) FROM g WHERE cap = a.source AND (a.source <> 'security.scan/owasp' OR severity >= 3)) > 0 THEN 'failed' ELSE 'confirmed' END AS state,
  (SELECT count(*) FROM g WHERE cap = a.source) AS n, (SELECT count(*) FROM g WHERE cap = a.source AND severity >= 3) AS n_high FROM a)"""
