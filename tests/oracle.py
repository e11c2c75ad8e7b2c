"""Run registered queries beside their SQL: python tests/oracle.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.append(str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings history import_entries history_lines pick_events agent_audit runbook_steps eval_items".split()


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(columns: list[str], data: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, sf: str) -> tuple[bool | None, int, str]:
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None, len(got), ""
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, len(got), f"columns {sorted(df.columns)} against {sorted(cols)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return False, len(got), f"{len(got)} against {len(want)}; only here {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return True, len(got), ""


def session(cores: int = 8, **conf: str):
    from pyspark.sql import SparkSession

    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import traceback

    import __spark_entry__ as e

    spark, (sf, *names) = session(), sys.argv[1:]
    for name in names or e.queries():
        began = time.time()
        try:
            ok, n, why = compare(spark, name, sf)
        except Exception:
            ok, n, why = False, -1, traceback.format_exc()[-1500:]
        print({True: "ok", False: "DIFF", None: "rows"}[ok], name, n, f"{time.time() - began:.1f}s", why, flush=True)
