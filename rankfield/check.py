"""Compare registered queries with their oracles: python -m rankfield.check [sf] [name-prefix ...]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from .catalog import load
from .session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype == object and pdf[c].map(lambda v: isinstance(v, (bool, type(None)))).all():
            pdf[c] = pdf[c].map(lambda v: None if v is None else float(v))
        elif pdf[c].dtype != object and str(pdf[c].dtype) not in ("str", "string"):
            pdf[c] = pdf[c].astype("float64")
        pdf[c] = pdf[c].map(lambda v: "null" if v is None or v != v else repr(v + 0.0) if isinstance(v, float) else str(v))
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    queries, oracles = load()
    names = [n for n in queries if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    spark = local_session()
    bad = 0
    for n in names:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        t0 = time.time()
        try:
            got = queries[n](spark, folder).toPandas()
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL {n}: spark {type(e).__name__} {str(e)[:700]}", flush=True)
            continue
        t1 = time.time()
        if n not in oracles:
            print(f"rows {n}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = con.execute(oracles[n]).df()
        except Exception as e:
            bad += 1
            print(f"FAIL {n}: oracle {str(e)[:700]}", flush=True)
            continue
        t2 = time.time()
        a, b = canonical(got), canonical(want)
        if len(a) == len(b) and list(a.columns) == list(b.columns) and a.equals(b):
            print(f"ok   {n}: {len(a)} rows {t1 - t0:.1f}s / {t2 - t1:.1f}s", flush=True)
        else:
            bad += 1
            print(f"DIFF {n}: {len(a)} vs {len(b)} rows; {t1 - t0:.1f}s / {t2 - t1:.1f}s", flush=True)
            if list(a.columns) == list(b.columns):
                m = a.merge(b, how="outer", indicator=True)
                print(m[m["_merge"] != "both"].head(8).to_string(), flush=True)
            else:
                print(list(a.columns), list(b.columns))
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
