"""Problem 1: records apart from damaged ones."""

import pytest

from runlore.operators.bad_rows import assemble, failed_lines, parse_record, parse_records, physical_records, split_records

GOOD = [
    ("zsh", ": 1712345678:0;git push", ("git push", 1712345678)),
    ("zsh", ":1712345678:;a\\\nb\r", ("a\\\nb", 1712345678)),
    ("zsh", ":w", (":w", None)),
    ("zsh", ": note 5", (": note 5", None)),
    ("fish", "- cmd: ls\\na\n  when: 1712345678 \n  paths:\n    - x", ("ls\na", 1712345678)),
    ("fish", "- cmd: ls", ("ls", None)),
    ("jsonl", ' {"command": "x", "ts": "1712345678", "dir": "", "k": [1]} ', ("x", 1712345678)),
    ("jsonl", '{"command": "x", "ts": 1712345678, "dir": "/", "exit_code": null, "duration_ms": 0}', ("x", 1712345678)),
    ("csv", '1,"1712345678",,,/a,"echo ""x"",\ny"\r', ('echo "x",\ny', 1712345678)),
    ("csv", "1,1712345678,0,5,,ls", ("ls", 1712345678)),
]
BAD = [
    ("zsh", ": 171234567:0;git"), ("zsh", ": 1712345678:0"), ("zsh", ": 1712345678:0; "), ("zsh", ": 1712345678:5s;x"),
    ("fish", "cmd: x"), ("fish", "- cmd: x\nwhen: 1712345678"), ("fish", "- cmd: x\n  when:"), ("fish", "- cmd:  "), ("fish", "- cmd: x\n  when: 1712345678.5"),
    ("jsonl", "[]"), ("jsonl", "{} {}"), ("jsonl", '{"command": "x", "dir": "/"}'), ("jsonl", '{"command": 1, "ts": 1712345678, "dir": "/"}'), ("jsonl", '{"command": "x", "ts": 1712345678.0, "dir": "/"}'),
    ("jsonl", '{"command": "x", "ts": 1712345678, "dir": null}'), ("jsonl", '{"command": "x", "ts": 1712345678, "dir": "/", "duration_ms": -1}'), ("jsonl", '{"command": "x", "ts": 1712345678, "dir": "/", "exit_code": true}'),
    ("jsonl", '{"command": "x", "ts": NaN, "dir": "/"}'), ("csv", "1,1712345678,,,/a,b,c"), ("csv", '1,1712345678,,,/a,echo "x"'), ("csv", '1,1712345678,,,/a,"x'), ("csv", "1,1712345678,,,/a,x\ny"),
    ("csv", '1,1712345678,,,"/a"b,x'), ("csv", "1,1712345678,-1,,/a,x"), ("csv", "x,1712345678,,,/a,x"), ("csv", "1,1712345678,,,/a, "), ("tcsh", "x"), (None, "x"),
]


@pytest.mark.parametrize("fmt,raw,want", GOOD)
def test_good(fmt, raw, want):
    assert parse_record(fmt, raw) == (*want, None)


@pytest.mark.parametrize("fmt,raw", BAD)
def test_bad(fmt, raw):
    rec = parse_record(fmt, raw)
    assert rec[:2] == (None, None) and rec[2]


def test_blank_is_no_case():
    assert all(parse_record("csv", r) is None for r in (None, "", " \t", "\r", " \r"))


def test_assemble_quotes():
    assert list(assemble(iter(['a,"b', 'c"', "d", '"e""', '"']))) == ['a,"b\nc"', "d", '"e""\n"']


def test_table_with_clashing_names_and_empty(spark):
    rows = [(1, "f", "csv", "1,1712345678,,,/a,x", "q"), (2, "f", "csv", "bad", None), (3, None, None, None, None), (1, "f", "csv", "1,1712345678,,,/a,x", "q")]
    df = spark.createDataFrame(rows, "line_id long, file_name string, fmt string, raw string, command string")
    good, bad = split_records(df)
    assert sorted(map(tuple, good.collect())) == [(1, "x", 1712345678)] * 2
    assert [tuple(r) for r in bad.collect()] == [(2, "csv has 1 fields")]
    assert {tuple(r) for r in failed_lines(df).collect()} == {("f", "csv", "ok", 2), ("f", "csv", "csv has 1 fields", 1)}
    assert parse_records(df.limit(0)).count() == 0


def test_very_long_text(spark):
    big = "x" * 2_000_000
    assert parse_record("csv", f'1,1712345678,,,/a,"{big}"') == (big, 1712345678, None)
    assert parse_record("csv", f"1,1712345678,,,{big},x")[2] is None
    assert parse_record("zsh", f": 1712345678:0;{big}")[0] == big


def brute_records(lines):
    """(first line, number of lines) of each record: a quote left open goes on until a line that is a record by itself."""
    import re

    from runlore.operators.bad_rows import WHOLE_LINE

    out, is_open = [], False
    for at, text in lines:
        if re.match(WHOLE_LINE, text):
            out.append([at, 1])
            is_open = False
            continue
        if is_open:
            out[-1][1] += 1
        else:
            out.append([at, 1])
        is_open ^= text.count('"') % 2 == 1
    return sorted(map(tuple, out))


def test_a_damaged_quote_ends_at_the_next_whole_line(spark):
    import random

    r = random.Random(3)
    pool = ["1,1712345678,0,5,/a,ls", '2,1712345678,,,/a,"echo ""x"""', '3,1712345678,,,/a,"two', 'lines"', '"', "x", "", 'a"b']
    lines = [("f", k, r.choice(pool)) for k in range(300)] + [("g", k, t) for k, t in enumerate(['1,1712345678,,,/a,"open', pool[0], pool[1], "rest"])] + [(None, 0, None)]
    df = spark.createDataFrame(lines, "file_name string, line_no int, text string")
    for block in (1, 7, 1000):
        got = physical_records(df, block=block).collect()
        for f in ("f", "g"):
            assert sorted((x.line_no, x.n_lines) for x in got if x.file_name == f) == brute_records([(k, t) for g, k, t in lines if g == f]), (f, block)
        good = [parse_record("csv", x.raw) for x in got if x.file_name == "g"]
        assert sorted(x[0] for x in good if x[2] is None) == ['echo "x"', "ls"]
    assert physical_records(df.limit(0)).count() == 0
