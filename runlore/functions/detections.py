"""Values that a detector proposes as secrets of a command: quick test, clean-up and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlore.functions.text import variable_name, words

# Words that always call for a look, and the length from which a word could be a secret.
KEYWORDS = ("bearer", "authorization", "password", "token", "secret", "api_key", "apikey", "private_key", "access_key")
LONG_WORD, MIN_VALUE = 16, 8


def may_hold_credential(command: Column) -> Column:
    """Whether a detector should look at a command at all."""
    low = F.lower(command)
    named = F.lit(False)
    for k in KEYWORDS:
        named = named | F.contains(low, F.lit(k))
    return named | F.exists(words(command), lambda w: F.length(F.regexp_replace(w, "[\"']", "")) >= LONG_WORD)


def is_host(value: Column) -> Column:
    """A host name or IPv4 address, with or without a port."""
    return F.rlike(value, F.lit(r"^(?:\d{1,3}(?:\.\d{1,3}){3}|(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})(?::\d+)?$"))


def bare_value(value: Column, command: Column) -> Column:
    """A value without the flag, assignment or name in front of it, where what remains occurs in the command."""
    rest = F.regexp_extract(value, r"^(?:--?[A-Za-z][\w-]*[= ]|[A-Za-z_]\w*\s*[=:]\s*(?!//))(.+)$", 1)
    return F.when((rest != "") & F.contains(command, rest), rest).otherwise(value)


def detections(found: Column, command: Column) -> Column:
    """Array of structs (name, value) as it may be offered: values that occur in the command, no addresses or short
    ones, each once (its first), none that is part of another; names as UPPER_SNAKE."""
    clean = F.transform(found, lambda d: F.struct(variable_name(d["name"]).alias("name"), bare_value(d["value"], command).alias("value")))
    ok = F.filter(clean, lambda d: F.contains(command, d["value"]) & (F.length(d["value"]) >= MIN_VALUE) & ~F.contains(d["value"], F.lit("://")) & ~is_host(d["value"]))
    first = F.filter(ok, lambda d, i: F.array_position(F.transform(ok, lambda x: x["value"]), d["value"]) == i + 1)
    return F.filter(first, lambda d: ~F.exists(first, lambda o: (o["value"] != d["value"]) & F.contains(o["value"], d["value"])))
