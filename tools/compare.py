"""Run registered queries in Spark and their SQL in DuckDB and compare all rows.

    python tools/compare.py /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from docfields.catalog.registry import all_oracles, all_queries  # noqa: E402
from docfields.catalog.views import BASE_TABLES  # noqa: E402
from docfields.session import build_session  # noqa: E402


def normal(value):
    """A comparable, sortable form of one cell."""
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan") if math.isnan(value) else (2, format(value, ".9g"))
    if isinstance(value, int):
        return (2, format(float(value), ".9g") if abs(value) < 2**53 else str(value))
    if hasattr(value, "isoformat"):
        return (3, value.isoformat())
    if isinstance(value, (list, tuple)):
        return (4, str([normal(v) for v in value]))
    return (3, str(value))


def main(sf_dir: str, parts: list[str]) -> int:
    spark = build_session(master=f"local[{os.environ.get('BENCH_CPUS', '8')}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    oracles, bad = all_oracles(), []
    for name, fn in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            columns = sorted(df.columns)
            rows = [tuple(r) for r in df.select(*columns).collect()]
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: spark: {str(error)[:1500]}", flush=True)
            continue
        spent = time.time() - started
        if name not in oracles:
            print(f"rows {name}: {len(rows)} rows, no SQL, {spent:.1f}s", flush=True)
            continue
        try:
            result = con.execute(oracles[name])
            names = [c[0] for c in result.description]
            got = result.fetchall()
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: duckdb: {str(error)[:1500]}", flush=True)
            continue
        if sorted(names) != columns:
            bad.append(name)
            print(f"FAIL {name}: columns {columns} vs {sorted(names)}", flush=True)
            continue
        order = [names.index(c) for c in columns]
        left = sorted(tuple(normal(v) for v in r) for r in rows)
        right = sorted(tuple(normal(r[i]) for i in order) for r in got)
        if left == right:
            print(f"ok   {name}: {len(rows)} rows, {spent:.1f}s", flush=True)
        else:
            bad.append(name)
            only_left, only_right = set(left) - set(right), set(right) - set(left)
            print(f"FAIL {name}: {len(left)} vs {len(right)} rows; {columns}", flush=True)
            for tag, side in (("spark ", only_left), ("duckdb", only_right)):
                for row in sorted(side)[:4]:
                    print("   ", tag, [v[1] for v in row], flush=True)
    print("failed:", bad or "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
