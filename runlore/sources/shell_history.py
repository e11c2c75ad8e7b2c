"""Shell history files of zsh, bash and fish as entries with failure counts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHELLS = ("zsh", "bash", "fish")
_STAMPED = re.compile(r":[ \t]*\d")
_ZSH = re.compile(r":[ \t]*(\d+):\d*;(.*)\Z", re.S)


def shell_of(path: str) -> str | None:
    """The shell a history file belongs to, by its name."""
    name = os.path.basename(path).lower()
    return next((s for s in SHELLS if s in name), None)


def default_paths(home: str) -> dict[str, str]:
    return {"zsh": f"{home}/.zsh_history", "bash": f"{home}/.bash_history", "fish": f"{home}/.local/share/fish/fish_history"}


def _continues(line: str) -> bool:
    return (len(line) - len(line.rstrip("\\"))) % 2 == 1


def parse_zsh(lines: list[str]) -> Iterator[tuple[int, str | None, int | None]]:
    """(line number, command, ts); a null command is a line that cannot be read."""
    i = 0
    while i < len(lines):
        start, parts = i, [lines[i]]
        while _continues(parts[-1]) and i + 1 < len(lines):
            parts[-1] = parts[-1][:-1]
            i += 1
            parts.append(lines[i])
        i += 1
        record = "\n".join(parts)
        if not record.strip():
            continue
        if not _STAMPED.match(record):
            yield start + 1, record, None
            continue
        m = _ZSH.match(record)
        good = m is not None and m[2].strip()
        yield start + 1, m[2] if good else None, int(m[1]) if good else None


def parse_bash(lines: list[str]) -> Iterator[tuple[int, str | None, int | None]]:
    """A ``#`` line of eight or more digits dates the next command only."""
    ts = None
    for n, line in enumerate(lines, 1):
        if re.fullmatch(r"#\d{8,}", line):
            ts = int(line[1:])
        elif line.strip():
            yield n, line, ts
            ts = None


def parse_fish(lines: list[str]) -> Iterator[tuple[int, str | None, int | None]]:
    """Blocks of ``- cmd:`` with an indented ``when:``; other lines that are not indented cannot be read."""
    held: list | None = None
    for n, line in enumerate(lines, 1):
        if line.startswith("- cmd:"):
            if held:
                yield tuple(held)
            text = re.sub(r"\\(.)", lambda m: {"n": "\n", "\\": "\\"}.get(m[1], m[0]), line[6:].strip())
            held = [n, text or None, None]
        elif m := re.match(r"\s+when:\s*(\d+)\s*\Z", line):
            if held:
                held[2] = int(m[1])
        elif line.strip() and not line[0].isspace():
            yield n, None, None
    if held:
        yield tuple(held)


_PARSERS = {"zsh": parse_zsh, "bash": parse_bash, "fish": parse_fish}


def parse_files(files: DataFrame, shell: str | None = None) -> DataFrame:
    """Files (path, content binary) as file, line_no, command, ts; rows with a null command are failed lines.

    Bytes that are no UTF-8 become replacement characters and only line feeds end a line. One file is parsed by
    one task; files are spread over the cluster.
    """
    if shell is not None and shell not in _PARSERS:
        raise ValueError(f"unsupported shell {shell}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                parser = _PARSERS.get(shell or shell_of(path))
                if parser is None:
                    continue
                rows = list(parser([x.removesuffix("\r") for x in bytes(content).decode("utf-8", "replace").split("\n")]))
                out = pd.DataFrame(rows, columns=["line_no", "command", "ts"])
                out.insert(0, "file", path)
                yield out.astype({"line_no": "int32", "ts": "Int64", "command": object})

    return files.select("path", "content").mapInPandas(run, "file string, line_no int, command string, ts long")


def read_shell_history(spark: SparkSession, path: str, shell: str | None = None) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").load(path), shell)


def failed_lines(parsed: DataFrame) -> DataFrame:
    """Entries and failed lines per file."""
    return parsed.groupBy("file").agg(F.count("command").alias("n_entries"), F.count(F.when(F.col("command").isNull(), 1)).alias("failed_lines"))
