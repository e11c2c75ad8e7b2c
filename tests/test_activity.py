"""Problem 4 against a plain loop, with every block length."""

import random

from runlore.operators.activity import history_sessions

SCHEMA = "seq long, device string, command string, ts long, dir string, repo string, exit_code int, duration_ms long, session string, imported boolean, block long"


def brute(rows):
    seen, streams = set(), {}
    for r in sorted(rows):
        seq, device, command, ts, d, repo, code, dur, session, imported, _ = r
        key = r[1:10]
        if imported or ts is None or key in seen:
            continue
        seen.add(key)
        streams.setdefault((device, repo), []).append((ts, seq, (dur or 0) // 1000, session or None))
    out = []
    for ev in streams.values():
        ev.sort()
        cur = None
        for k, (ts, seq, dur, s) in enumerate(ev):
            if k:
                pts, _, _, ps = ev[k - 1]
                new = s != ps if s and ps else ts - dur - pts > 300
            if k == 0 or new:
                cur = [seq, ts, ts, 0]
                out.append(cur)
            cur[2], cur[3] = ts, cur[3] + 1
    return sorted(map(tuple, out))


def history(r, n=300):
    rows = []
    for seq in range(n):
        row = (seq, r.choice("ab"), r.choice(["x", "y"]), r.choice([None] + [1000 + r.randrange(6000) for _ in range(9)]), "/", r.choice([None, "", "r"]), r.choice([0, None]), r.choice([None, 0, 900, 400_000]), r.choice([None, None, "", "s", "t"]), r.choice([False, False, None, True]), 7)
        rows.append(row)
        if r.random() < 0.1:
            rows.append((seq + 10_000, *row[1:]))
    return rows


def test_matches_loop(spark):
    r = random.Random(3)
    for block_s in (None, 1, 97, 1000):
        rows = history(r)
        got = history_sessions(spark.createDataFrame(rows, SCHEMA), block_s=block_s).collect()
        assert sorted(map(tuple, got)) == brute(rows), block_s


def test_empty(spark):
    assert history_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
