"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row),
    )


def type_family(text: str) -> str:
    text = text.lower()
    for family, words in {
        "int": ("bigint", "int", "hugeint"), "double": ("double", "float"), "text": ("string", "varchar"),
        "date": ("date",), "bool": ("boolean",),
    }.items():
        if any(text.startswith(word) for word in words):
            return family
    return text


def compare(spark, con, sf_dir, name, function, sql) -> str:
    """Empty text when results agree, otherwise what differs."""
    df = function(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: type_family(str(d[1])) for d in result.description}
    want = canonical(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine = {c: type_family(t) for c, t in df.dtypes}
    kinds = {c: (mine[c], types[c]) for c in names if mine[c] != types[c] and types[c] != "number"}
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; types {kinds}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ: {sorted(names)} {wrong[:3]}"
    return f"types {kinds}" if kinds else ""


def main(argv):
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from duelframe.session import build_session

    sf_dir = argv[1]
    pattern = argv[2:] or [""]
    spark = build_session("oracle", master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if not any(name.startswith(p) for p in pattern):
            continue
        start = time.time()
        try:
            if name in sql:
                verdict = compare(spark, con, sf_dir, name, function, sql[name])
            else:
                df = function(spark, sf_dir)
                rows = df.collect()
                verdict = "" if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(verdict)
        kind = "sql" if name in sql else "rows"
        print(f"{'FAIL' if verdict else 'ok  '} {kind:4} {time.time() - start:6.2f}s {name} {verdict}", flush=True)
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
