"""Deterministic redaction and credential shapes, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"

# The shapes that are masked at the boundary, in order.
_WORD = r"(?:passwords?|passwd|passphrase|secrets?|tokens?|api[-_]?keys?|access[-_]?key|secret[-_]?key|private[-_]?key|credentials?|auth[-_]?token|mysql_pwd)"
_NAME = rf"[A-Za-z0-9_.-]*{_WORD}"
_QUALIFIED = rf"[A-Za-z0-9_.-]*[_.-]{_WORD}"
#: A reference such as $NAME or "${NAME}" is no secret.
_REFERENCE = r"(?![\"']*\$\$?\{?[A-Za-z_][A-Za-z0-9_]*\}?[\"']*(?:\s|$))"
_REFERENCE_USER = r"(?!\$\$?\{?[A-Za-z_][A-Za-z0-9_]*\}?(?:@|\s|$))(?!\d+(?:@|\s|$))"
RULES = (
    (r"-----BEGIN[^-]*PRIVATE KEY-----[\s\S]*?-----END[^-]*PRIVATE KEY-----", r"[REDACTED]"),
    (r"-----BEGIN[^-]*PRIVATE KEY-----[\s\S]*", r"[REDACTED]"),
    (rf"(?i)(authorization\s*:\s*(?:(?:bearer|basic|token)\s+)?)(?!(?:bearer|basic|token)\s){_REFERENCE}([^\"'\s]+)", r"$1[REDACTED]"),
    (r"(?i)\b((?:bearer|basic)\s+)([A-Za-z0-9._~+/=-]{8,})", r"$1[REDACTED]"),
    (rf"(://[^/\s:@]+:){_REFERENCE_USER}([^/\s@]+)@", r"$1[REDACTED]@"),
    (rf"(?i)((?:(?:^|\s)-u\s+|--user[= ])[^\s:]+:){_REFERENCE_USER}(\S+)", r"$1[REDACTED]"),
    (rf"(?i)\b({_NAME}\s*=\s*){_REFERENCE}(\"[^\"]*\"|'[^']*'|\S+)", r"$1[REDACTED]"),
    (rf"(?i)(--{_NAME}\s+){_REFERENCE}(\"[^\"]*\"|'[^']*'|[^-\s]\S*)", r"$1[REDACTED]"),
    (rf"(?i)(?<![\w./$-])({_QUALIFIED}\s+)(?!https?://){_REFERENCE}(\"[^\"]*\"|'[^']*'|[^-/~.\s]\S{{7,}})", r"$1[REDACTED]"),
    (
        r"\b(?:gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abposr]-[A-Za-z0-9-]{10,}|sk-ant-[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9]{20,}"
        r"|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|AIza[0-9A-Za-z_-]{35}|npm_[A-Za-z0-9]{36}|(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16})\b",
        r"[REDACTED]",
    ),
    (r"\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}", r"[REDACTED]"),
)
#: What a text needs for any rule to match; all others are passed through after one look.
GATE = r"(?i)passw|passph|secret|token|api[-_]?key|access[-_]?key|private[-_ ]?key|credential|mysql_pwd|authorization|bearer|basic|://[^/\s:@]+:|-u\s|--user[= ]|gh[pousr]_|github_pat_|glpat-|xox|sk-|[sr]k_|aiza|npm_|a3t|akia|asia|abia|acca|eyj"
# The shapes whose rows an import leaves out.
CREDENTIALS = (
    r"(?i)\b(?:pass|passwd|password|token|secret|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?token|client[_-]?secret|credential)\b\s*[=:]\s*[\"']?[^\s\"']{6,}",
    r"(?i)--(?:pass|password|token|secret|api-?key|access-?key|auth)\s+[\"']?[^\s\"']{6,}",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}",
    r"\bgh[pousr]_[A-Za-z0-9]{16,}",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}",
    r"\bsk-[A-Za-z0-9_-]{16,}",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    r"\bglpat-[A-Za-z0-9_-]{16,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{20,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"://[^\s/:@]+:[^\s/@]{4,}@",
)


def redact(text: Column) -> Column:
    """``text`` with every known secret shape masked; doing it twice changes nothing more."""
    masked = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), RULES, text)
    return F.when(F.rlike(text, F.lit(GATE)), masked).otherwise(text)


def redact_all(texts: Column) -> Column:
    return F.transform(texts, redact)


def looks_like_credential(command: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.rlike(command, F.lit(p)) for p in CREDENTIALS])


def is_sensitive(command: Column) -> Column:
    return looks_like_credential(command) | (redact(command) != command)
