"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

    python -m workload.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from workload.oracle import ORACLE_SQL
from workload.queries import QUERIES
from workload.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, nulls as None."""
    pdf = pdf[sorted(pdf.columns)]
    pdf = pdf.astype(object).where(pdf.notna(), None)
    order = pdf.apply(lambda row: repr(tuple(row)), axis=1).sort_values().index if len(pdf) else pdf.index
    return pdf.loc[order].reset_index(drop=True)


def differences(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[str | None, int, float, float]:
    """A description of the first difference or None, the row count, and both times."""
    t0 = time.time()
    mine = QUERIES[name](spark, sf_dir).toPandas()
    t1 = time.time()
    theirs = con.execute(ORACLE_SQL[name]).df()
    t2 = time.time()
    problem = None
    if sorted(mine.columns) != sorted(theirs.columns):
        problem = f"columns {sorted(mine.columns)} / {sorted(theirs.columns)}"
    elif len(mine) != len(theirs):
        problem = f"rows {len(mine)} / {len(theirs)}"
    else:
        kinds = {c: (str(mine[c].dtype), str(theirs[c].dtype)) for c in mine.columns}
        uneven = {c: k for c, k in kinds.items() if k[0] != k[1] and len(mine)}
        a, b = canonical(mine), canonical(theirs)
        if not a.equals(b):
            bad = next(i for i in range(len(a)) if not a.iloc[i].equals(b.iloc[i]))
            problem = f"row {bad}: {a.iloc[bad].to_dict()} / {b.iloc[bad].to_dict()}"
        elif uneven:
            problem = f"types {uneven}"
    return problem, len(mine), t1 - t0, t2 - t1


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(QUERIES)
    spark, con, failed = local_session(), duck(sf_dir), 0
    for name in names:
        try:
            problem, n, mine, theirs = differences(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            problem, n, mine, theirs = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0, 0.0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:24s} rows={n:<8d} spark={mine:6.2f}s duckdb={theirs:6.2f}s "
              f"{(problem or '')[:700]}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree at {sf_dir}")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
