"""Problem 2: credentials embedded in commands and configuration, found and masked in place."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlore.llm.bpe import VOCABULARY, Tokenizer, split_pattern, tokenizer, vocabulary_path

#: Characters per subword below which a string is unnatural.
UNNATURAL = 2.4
#: The same for values whose place already says that they are secret.
LOOSE = 3.4
#: The same for a string whose place says nothing, and the characters it must have: shorter ones cannot be told from
#: ids. It must mix cases and digits, which digests and ids in hexadecimal do not.
ALONE, ALONE_CHARS = 2.0, 20
#: Characters of a value whose place is no proof by itself, and of one in a place that only a secret has: shorter
#: ones cannot be told from words and counts.
BARE_CHARS, SURE_CHARS = 8, 4

#: Words that end the name of a secret.
_WORD = r"pass(?:word|wd|phrase|wort|code)?|pwd|pw|secret|token|tok|api[_-]?key|access[_-]?key(?:[_-]?id)?|secret[_-]?key|auth[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|apikey|accesskey|secretkey|credentials?|auth"
_VALUE = r"(?P<v>(?!\.\*)[^\s'\"`;&|<>,)}\]\\]+)"
_QUOTED = r"(?:\\?\"(?P<q>[^\"\\\n]+)\\?\"|'(?P<s>[^'\n]+)')"
_ASSIGNED = rf"(?:{_QUOTED}|{_VALUE})"

#: White space in gates: all but visible ASCII, so never less than what ``\s`` of a rule matches.
_GAP = r"[^!-~]"
#: The words of ``_WORD``; short ones only with what may follow them in a rule.
_WORD_GATE = (
    r"pass|pwd|secret|credential|auth|(?:api|access|private|signing|encryption)[_-]?key"
    rf"|(?:pw|tok(?:en)?)(?:\\?['\"]?{_GAP}{{0,3}}[=:]|{_GAP})"
)

# Every rule is worked off in time that grows with the text's length: none can begin at a place that another try of it
# has already passed over, or what it passes over is bounded. "sure" values are secret unless they are no literal;
# "named" ones must not be natural words; "bare" ones must be unnatural. A gate is a list of cheap patterns all of which
# a text with a match contains.

#: Places that one pattern describes: (pattern, how sure the place is, gate).
PLACES: tuple[tuple[re.Pattern, str, tuple[str, ...]], ...] = tuple(
    (re.compile(p, re.I), sure, gate)
    for p, sure, gate in (
        # private keys, from their first line on
        (r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?P<v>(?:\s|\\n)*[A-Za-z0-9+/=]{8,}(?:(?:\s|\\n)+[A-Za-z0-9+/=]{4,})*)", "sure", (r"private key-----",)),
        # issuers' prefixes
        (r"(?<![A-Za-z0-9])(?P<v>(?:gh[pousr]_|github_pat_|glpat-|npm_|hf_|dop_v1_|sk-|sk_live_|rk_live_|pypi-|shpat_)[A-Za-z0-9_\-]{16,})", "bare", (r"gh[pousr]_|github_pat_|glpat-|npm_|hf_|dop_v1_|sk-|sk_live_|rk_live_|pypi-|shpat_",)),
        (r"(?<![A-Za-z0-9])(?P<v>xox[a-z]-[A-Za-z0-9\-]{10,})", "bare", (r"xox[a-z]-",)),
        (r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{12,}+)(?![A-Za-z0-9])", "bare", (r"akia|asia",)),
        (r"(?<![A-Za-z0-9])(?P<v>AIza[A-Za-z0-9_\-]{20,})", "bare", (r"aiza",)),
        # headers
        (r"authorization['\"]?\s*+[:=]\s*+['\"]?(?:basic|bearer|token|digest|apikey)\s++" + _VALUE, "sure", (r"auth",)),
        (r"\bbearer\s++(?P<v>[A-Za-z0-9_\-.=+/]{12,})", "named", (r"bearer",)),
        (r"(?:cookie:\s*+|;\s*+)(?:session|sid|jwt|auth)[a-z_]*+=" + _VALUE, "bare", (rf"cookie|;{_GAP}*+(?:session|sid|jwt|auth)",)),
        (r"\bsshpass\s++-p\s*+" + _ASSIGNED, "sure", (r"pass",)),
        (r"\bpass(?:in|out|word)?(?:\s*+=\s*+|\s++)['\"]?pass:(?P<v>[^\s'\"]+)", "sure", (r"pass",)),
        # --name value, set name value, key: value
        (r"(?<!\S)--?(?:[a-z0-9]++-)*?(?:" + _WORD + r")\s++" + _ASSIGNED, "named", (_WORD_GATE,)),
        (r"\bset\s++(?:-\w++\s++)*+[A-Za-z0-9_.\-/:]*(?:" + _WORD + r")\s++" + _ASSIGNED, "named", (_WORD_GATE,)),
        (r"(?<![A-Za-z])keys?\s{0,2}[=:]\s{0,2}" + _ASSIGNED, "bare", (rf"keys?{_GAP}{{0,2}}[=:]",)),
        # an unnatural string that is piped into a login
        (r"\b(?:echo|printf|print)\s++(?:-\w++\s++)?['\"]?(?P<v>[^\s'\"|]{12,}+)['\"]?\s*+\|[^\n|]*(?:login|auth|passw|token|secret)", "bare", (r"\|[^\n|]*(?:login|auth|passw|token|secret)",)),
    )
)

#: NAME=value, name: value, "name": "value", name == value: from the last word of the name on.
_NAMED = re.compile(r"(?:" + _WORD + r")\\?['\"]?\s{0,3}(?:==?|:=|:)\s{0,3}" + _ASSIGNED, re.I)

#: Programs that take a password as an argument: (program, where the argument is, gate). A command ends at a line
#: end, pipe, semicolon or ampersand.
PROGRAMS: tuple[tuple[re.Pattern, re.Pattern, tuple[str, ...]], ...] = tuple(
    (re.compile(program, re.I), re.compile(argument, re.I), gate)
    for program, argument, gate in (
        (r"\bcurl\b", r"\s(?:-u|--user)[\s=]?['\"]?[^\s:'\"]+:(?P<v>[^\s'\"]+)", (r"curl", rf"{_GAP}-(?:u|-user)")),
        (r"\bsmbclient\b", r"\s-U\s*+['\"]?[^\s%'\"]+%(?P<v>[^\s'\"]+)", (r"smbclient",)),
        (r"\b(?:docker|podman|helm)\b(?:\s++registry)?\s++login\b", r"\s(?:-p|--password)[\s=]['\"]?(?P<v>[^\s'\"]+)", (rf"{_GAP}login",)),
        (r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b", r"\s-p(?P<v>(?!\d++(?:\s|$))[^\s'\"\-][^\s'\"]*)", (r"mysql|mariadb",)),
        (r"\bldap(?:search|modify|add|delete|whoami)\b", r"\s-w\s*+['\"]?(?P<v>[^\s'\"]+)", (r"ldap(?:search|modify|add|delete|whoami)",)),
        (r"\bredis-cli\b", r"\s-a\s*+['\"]?(?P<v>[^\s'\"]+)", (r"redis-cli",)),
        (r"\b(?:zip|7z|unzip|rar|unrar)\b", r"\s-P\s*+['\"]?(?P<v>[^\s'\"\-][^\s'\"]*)", (r"zip|7z|rar", rf"{_GAP}-p")),
        (r"\bopenssl\b", r"\s-k\s++['\"]?(?P<v>[^\s'\"\-][^\s'\"]*)", (r"openssl", rf"{_GAP}-k{_GAP}")),
    )
)
_END = re.compile(r"[\n|;&]")
_HTPASSWD = re.compile(r"\bhtpasswd\b", re.I)
_TERM = re.compile(r"\S+")
#: What an address goes on to; a secret hook's path segments come after one of these.
_ADDRESS = re.compile(r"[^\s'\"]*")
_HOOK = re.compile(r"(?:web)?hooks?", re.I)
_SEGMENT = re.compile(r"[A-Za-z0-9_\-]{16,}")
_SIGNED_RUN = re.compile(r"[A-Za-z0-9_\-.]+")
_SIGNED_START = re.compile(r"(?<![A-Za-z0-9])eyJ", re.I)
#: A string that mixes cases and digits, from its start.
_MIXED = rf"(?<![A-Za-z0-9_\-])(?=[A-Za-z_\-]*+[0-9])(?=[a-z0-9_\-]*+[A-Z])(?=[A-Z0-9_\-]*+[a-z])[A-Za-z0-9_\-]{{{ALONE_CHARS},}}+"
_STRING = re.compile(_MIXED)

#: Of all rules, what a text needs; texts without it hold no secret that the rules find. Letters that are equal to i,
#: k and s but for their case stand for themselves.
GATES: tuple[tuple[str, ...], ...] = tuple(
    dict.fromkeys([*(g for *_, g in PLACES), *(g for *_, g in PROGRAMS), (_WORD_GATE,), (r"htpasswd",), (r"://", r"@"), (r"://", r"hook"), (r"eyj",)])
)


def gate(text: Column) -> Column:
    """Whether a text may hold a secret, inside the JVM and in time that grows with its length."""
    single = "(?i:" + "|".join(g[0] for g in GATES if len(g) == 1) + ")|[İıſK]|" + _MIXED
    several = [reduce(lambda a, b: a & b, [F.rlike(text, F.lit(f"(?i){p}")) for p in g]) for g in GATES if len(g) > 1]
    return reduce(lambda a, b: a | b, several, F.rlike(text, F.lit(single)))


_SLOT = re.compile(
    r"\$|`|%[A-Za-z_]+%\Z|<.*>?\Z|\{\{|\[|\(|[*xX.•#_\-]{3,}\Z|@|(?:your|my|the|some|example|changeme|redacted|masked|hidden|placeholder|none|null|true|false|yes|no|prompt|stdin|required|optional|todo|env|file|vault|kv)(?:\b|[_\-])",
    re.I,
)
_PATH = re.compile(r"(?:~|\.{1,2})?/[\w.~@+\-]+(?:/|\Z)(?![^/]*[+=])|[\w./~\-]+\.(?:pem|key|crt|cer|pub|txt|tok|json|ya?ml|env|conf|cfg|ini|toml|gpg|asc|sh|py|js|ts|go|rs|md|sql|tgz|gz|zip|csv|git|html?)\Z", re.I)
_WORDS = re.compile(r"[a-z]+(?:[-_./:][a-z]+)*")
_COUNT = re.compile(r"[\d.]+\w?")
#: A string in a path, an address or an assignment that names no secret is an id of something.
_AFTER_ID = re.compile(r"[/=:@.#%$~]")


class Finder:
    """Spans of secrets in a text: unnatural strings and named values, told from harmless ones by their place."""

    def __init__(self, tok: Tokenizer) -> None:
        self.tok = tok

    def per_subword(self, text: str) -> float:
        return len(text) / max(1, len(self.tok.encode(text)))

    def unnatural(self, text: str) -> list[tuple[int, int]]:
        """The strings of a text that the vocabulary knows only in small pieces, wherever they stand."""
        return [m.span() for m in _STRING.finditer(text) if self.per_subword(m[0]) < ALONE]

    @staticmethod
    def _is_slot(v: str) -> bool:
        return bool(_SLOT.match(v)) or "$(" in v or "${" in v or set(v) <= {"*", "x", "X", "."} or v.startswith("-")

    def literal(self, v: str) -> bool:
        """Whether a value stands for itself: no reference, substitution, slot, mask, path or flag."""
        return len(v) >= SURE_CHARS and not self._is_slot(v) and not (_PATH.match(v) and self.per_subword(v) >= UNNATURAL)

    def secret(self, v: str, sure: str) -> bool:
        """Characters per subword and place together: the less the place says, the less natural a value must be."""
        if not self.literal(v):
            return False
        if sure == "sure":
            return True
        rate = self.per_subword(v)
        varied = any(c.isdigit() for c in v) and any(c.isalpha() for c in v) or any(not c.isalnum() and c not in "-_./:" for c in v)
        if sure == "named":
            return (rate < UNNATURAL and not _WORDS.fullmatch(v)) or (varied and rate < LOOSE and not _COUNT.fullmatch(v)) or (len(v) >= 8 and varied)
        return len(v) >= BARE_CHARS and rate < UNNATURAL and varied

    def places(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Values in places where secrets are: (start, end, how sure the place is)."""
        for rule, sure, _ in PLACES:
            for m in rule.finditer(text):
                yield *_value(m), sure
        for m in _NAMED.finditer(text):
            a = m.start()
            while a and text[a - 1].isascii() and text[a - 1].isalnum():
                a -= 1
            if not a or text[a - 1] not in "${":
                yield *_value(m), "named"
        for program, argument, _ in PROGRAMS:
            done = 0
            for m in program.finditer(text):
                if m.start() >= done:
                    end = _END.search(text, m.end())
                    done = end.start() if end else len(text)
                    for x in argument.finditer(text, m.end(), done):
                        yield *_value(x), "sure"
        yield from _htpasswd(text)
        yield from _addresses(text)
        yield from _signed(text)

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = [(a, b) for a, b in self.unnatural(text) if self._alone(text, a, b)]
        found += [(a, b) for a, b, sure in self.places(text) if self.secret(text[a:b], sure)]
        found.sort()
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    @staticmethod
    def _alone(text: str, a: int, b: int) -> bool:
        """Whether an unnatural string is a secret where no place speaks for it: as a word of its own, not as part of a
        path, address, assignment or reference, which would be an id."""
        v = text[a:b]
        if any(len(w) >= 4 and w.isalpha() for w in re.split("[-_]", v)):
            return False  # a name made of words
        return not (a and _AFTER_ID.match(text[a - 1])) and text[b : b + 1] not in ("/", ".", "@", ":", "=", "%") and "--" not in v and v[0] != "-" and v[-1] != "-"


def _value(m: re.Match) -> tuple[int, int]:
    groups = m.re.groupindex
    return next(m.span(g) for g in ("v", "q", "s") if g in groups and m[g] is not None)


def _htpasswd(text: str) -> Iterator[tuple[int, int, str]]:
    """htpasswd with -b: the third of its arguments."""
    done = 0
    for m in _HTPASSWD.finditer(text):
        if m.start() < done:
            continue
        end = _END.search(text, m.end())
        done = end.start() if end else len(text)
        batch, at = False, 0
        for t in _TERM.finditer(text, m.end(), done):
            if t[0].startswith("-") and at == 0:
                batch = batch or "b" in t[0].lower()
            else:
                at += 1
                if at == 3:
                    if batch:
                        a, b = t.span()
                        quoted = text[a] in "'\"" and b - a > 1
                        yield a + quoted, b - (quoted and text[b - 1] == text[a]), "sure"
                    break


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """Passwords and tokens before the host, and the segments of a secret hook's path."""
    at = text.find("://")
    while at >= 0:
        end = _ADDRESS.match(text, at + 3).end()
        stop = text.find("@", at + 3, end)
        if stop >= 0:
            colon = text.find(":", at + 3, stop)
            slash = text.find("/", at + 3, stop)
            if colon >= 0 and not 0 <= slash < colon:
                if not re.match(r"\d+(?:/|\Z)", text[colon + 1 : stop]):
                    yield colon + 1, stop, "sure"
            elif slash < 0 and stop - at - 3 >= 16:
                yield at + 3, stop, "bare"
        if text[max(0, at - 5) : at].lower().endswith(("http", "https")):
            path, hooked = at + 3, False
            for k, segment in enumerate(text[at + 3 : end].partition("?")[0].split("/")):
                if hooked and (m := _SEGMENT.match(segment)):
                    yield path, path + m.end(), "bare"
                hooked = hooked or bool(_HOOK.fullmatch(segment) if k else re.match(r"hooks?\.", segment, re.I))
                path += len(segment) + 1
        at = text.find("://", max(end, at + 3) if stop < 0 else stop)


def _signed(text: str) -> Iterator[tuple[int, int, str]]:
    """Signed session tokens: three stretches joined by dots, the first of which begins as its header does."""
    if "eyj" not in text.lower():
        return
    for run in _SIGNED_RUN.finditer(text):
        parts, at = run[0].split("."), run.start()
        for k, part in enumerate(parts):
            first = _SIGNED_START.search(part)
            if first and len(part) - first.start() >= 9 and k + 2 < len(parts) and len(parts[k + 1]) >= 6 and len(parts[k + 2]) >= 6:
                yield at + first.start(), at + len(".".join(parts[k : k + 3])), "sure"
            at += len(part) + 1


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """Spans overwritten character by character (line ends stay), so every other offset is unchanged."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"\S", "*", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, ids: list[str], text_col: str, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """Rows whose text holds a literal secret: ids, masked, starts array<int>, ends array<int>.

    One narrow pass: a JVM gate lets through what any rule could match, an Arrow task judges it. Characters per subword
    under a public vocabulary show the unnatural strings of a text; with what their place says they are taken or left.
    Values in a place that only a secret has are taken unless they are references, slots, masks or paths, natural
    words among them. Null and empty texts hold nothing; very long ones are searched whole, in time that grows with
    their length.
    """
    path, pattern = vocabulary_path(vocabulary), pattern or split_pattern()
    picked = df.where(gate(F.col(text_col))).select(*ids, F.col(text_col).alias("__text"))
    schema = picked.drop("__text").schema.add("masked", "string").add("starts", T.ArrayType(T.IntegerType())).add("ends", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(tokenizer(path, pattern))
        for b in batches:
            keep, masked, starts, ends = [], [], [], []
            for i, text in enumerate(b.column("__text").to_pylist()):
                spans = finder.spans(text)
                if spans:
                    keep.append(i)
                    masked.append(mask(text, spans))
                    starts.append([a for a, _ in spans])
                    ends.append([e for _, e in spans])
            kept = b.select(ids).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(masked, pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=schema.names
            )

    return picked.mapInArrow(run, schema)
