"""Expressions over command texts and repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shell variables that are never parameters of a saved command. Fixed values.
SHELL_VARIABLES = ("HOME", "USER", "PATH", "PWD", "OLDPWD", "SHELL", "TERM", "EDITOR", "VISUAL", "LANG", "LC_ALL", "DISPLAY", "HOSTNAME", "LOGNAME", "MAIL", "SHLVL", "TMPDIR", "XDG_CONFIG_HOME", "XDG_DATA_HOME", "XDG_CACHE_HOME")
#: Programs, and programs with a subcommand, that only look. Fixed values.
LOOKERS = (
    "ls", "ll", "la", "cd", "pwd", "clear", "cat", "bat", "less", "more", "head", "tail", "tree", "which", "whoami", "whereis", "type", "file", "stat", "man", "tldr", "history",
    "echo", "printf", "exit", "logout", "df", "du", "top", "htop", "ps", "env", "printenv", "date", "uptime", "open", "code", "vim", "nvim", "vi", "nano", "emacs", "fzf",
)
LOOKING_PAIRS = ("git status", "git log", "git diff", "git show", "git blame", "git remote", "docker ps", "docker images", "brew list", "npm ls", "pip list")
#: Marks of pipes, redirections, lists and substitutions.
GRAMMAR = r"[|><;`&]|\$\("
HOLE, OPAQUE = "\u0000", "\u0001"
#: A token with its quotes. Fixed value.
TOKEN = r"""(?:[^\s"']|"[^"]*"|'[^']*'|["'])+"""


def words(text: Column) -> Column:
    """White-space words without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def tool(command: Column) -> Column:
    return F.try_element_at(words(command), F.lit(1))


def contains_all(lower: Column, terms: list[str]) -> Column:
    """Every term occurs in a lower-case text, in any order; no terms match nothing."""
    out = None
    for t in terms:
        hit = F.contains(lower, F.lit(t.lower()))
        out = hit if out is None else out & hit
    return F.lit(False) if out is None else out


def let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value computed once a row, however often it is named."""
    return F.transform(F.array(value), use)[0]


def tokens(command: Column) -> Column:
    """Tokens with balanced quotes kept as written."""
    return F.regexp_extract_all(command, F.lit(TOKEN), F.lit(0))


def pieces(command: Column) -> Column:
    """Tokens and the white space between them, in turn; joined they are the command."""
    return F.regexp_extract_all(command, F.lit(TOKEN + r"|\s+"), F.lit(0))


def is_flag(token: Column) -> Column:
    return (F.length(token) > 1) & F.startswith(token, F.lit("-"))


def bare(toks: Column) -> Column:
    """Tokens after any leading sudo or doas."""
    first = F.array_position(F.transform(toks, lambda t: ~t.isin("sudo", "doas")), True)
    return F.when(first > 0, F.slice(toks, first.cast("int"), F.greatest(F.size(toks), F.lit(1)))).otherwise(F.slice(toks, 1, 0))


def is_inspection(command: Column, own: tuple[str, ...] = ()) -> Column:
    """Whether a command only looks; anything with shell grammar does not, nothing at all does. ``own`` are further
    programs that only look, such as the caller's."""

    def looks(t: Column) -> Column:
        first, second = F.try_element_at(t, F.lit(1)), F.try_element_at(t, F.lit(2))
        return first.isNull() | first.isin(*LOOKERS, *own) | F.coalesce(F.concat_ws(" ", first, second).isin(*LOOKING_PAIRS) & second.isNotNull(), F.lit(False))

    return ~F.rlike(command, F.lit(GRAMMAR)) & let(tokens(command), lambda t: let(bare(t), looks))


def shape(command: Column) -> Column:
    """Tokens with what may vary replaced by holes; a command with grammar stands for itself."""

    def entry(tok: Column, i: Column, lead: Column) -> Column:
        valued = F.concat(F.substring_index(tok, "=", 1), F.lit("=" + HOLE))
        return F.when(i < lead, tok).when(is_flag(tok), F.when(F.contains(tok, F.lit("=")), valued).otherwise(tok)).otherwise(F.lit(HOLE))

    holed = let(tokens(command), lambda t: let(F.size(t) - F.size(bare(t)) + 2, lambda lead: F.transform(t, lambda x, i: entry(x, i, lead))))
    return F.when(F.rlike(command, F.lit(GRAMMAR)), F.array(F.concat(F.lit(OPAQUE), command))).otherwise(holed)


def variables(command: Column) -> Column:
    """Distinct $NAME parameters in order, without escaped ones and the shell's own."""
    found = F.array_distinct(F.regexp_extract_all(command, F.lit(r"(?<!\$)\$([A-Z][A-Z0-9_]+)"), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(v) for v in SHELL_VARIABLES]))


def unescape_variables(command: Column) -> Column:
    return F.regexp_replace(command, r"\$\$([A-Z][A-Z0-9_]+)", r"\$$1")


def variable_name(text: Column) -> Column:
    """UPPER_SNAKE form of any spelling, camel case included."""
    snake = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")
    return F.upper(F.trim(F.regexp_replace(snake, "_+", "_"), F.lit("_")))


def slug(repo: Column) -> Column:
    return F.trim(F.regexp_replace(repo, "[^a-zA-Z0-9-]", "-"), F.lit("-"))


def repo_key(repo: Column) -> Column:
    """Injective partition key of a repository path; rows outside any go to _global."""
    digest = F.substring(F.sha2(repo, 256), 1, 8)
    return F.when(repo.isNull() | (repo == ""), "_global").otherwise(F.when(slug(repo) == "", digest).otherwise(F.concat_ws("-", slug(repo), digest)))


def repo_id(repo: str = "repo") -> Column:
    """What tells histories apart within a query, without the cost of the storage key: no repository is the empty text."""
    return F.coalesce(F.col(repo), F.lit(""))


def iso(ts: Column) -> Column:
    """ISO-8601 in UTC, whatever the session's time zone."""
    at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=ts.cast("decimal(18,6)"))
    return F.concat(F.regexp_replace(F.substring(at.cast("string"), 1, 19), " ", "T"), F.lit("Z"))


def relative_time(ts: Column, now: int) -> Column:
    age = F.greatest(F.lit(now) - ts, F.lit(0))
    unit = lambda s, u: F.concat(F.floor(age / s).cast("string"), F.lit(u))
    return F.when(age < 60, "just now").when(age < 3600, unit(60, "m ago")).when(age < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def signature(pattern: Column) -> Column:
    return F.regexp_replace(pattern, "<[^>]*>", "<>")


def confidence(n: Column, strong: int, moderate: int) -> Column:
    return F.when(n >= strong, "strong").when(n >= moderate, "moderate").otherwise("weak")


def think_seconds(ts: Column, duration_ms: Column, before: Column) -> Column:
    """Idle time before a command: its own run time is not idle."""
    return ts - F.floor(F.coalesce(duration_ms, F.lit(0)) / 1000) - before
