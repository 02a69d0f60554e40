"""Run registered queries next to their DuckDB oracles and report differences.

    python tests/compare.py [--dir DIR] [--hot N] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, int):
        return value
    return str(value)


def differences(frame, con, sql: str) -> list[str]:
    columns = sorted(frame.columns)
    rel = con.sql(sql)
    problems = []
    if sorted(rel.columns) != columns:
        return [f"columns {columns} against {sorted(rel.columns)}"]
    odd = [f"{c}:{t}" for c, t in zip(rel.columns, rel.types) if "HUGEINT" in str(t) or "DECIMAL" in str(t)]
    if odd:
        problems.append(f"oracle types {odd}")
    got = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect()))
    order = [rel.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        problems.append(f"{len(got)} rows against {len(want)}; {columns}; only here {extra}; only there {missing}")
    return problems


def main() -> None:
    from cadencekit.checks import registry
    from cadencekit.session import HOT_ROWS_CONF, build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--hot", type=int)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.hot:
        spark.conf.set(HOT_ROWS_CONF, str(args.hot))
    con = connect(args.dir)
    bad = 0
    for name, check in registry().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            frame = check.run(spark, args.dir)
            if check.sql is None:
                problems, note = [], f"{frame.count()} rows, no oracle"
            else:
                problems = differences(frame, con, check.sql)
                note = ""
        except Exception as error:  # noqa: BLE001 - a report, every failure counts
            problems, note = [str(error)[:700]], ""
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}")
        for p in problems:
            print("     ", p[:900])
    print("bad:", bad)


if __name__ == "__main__":
    main()
