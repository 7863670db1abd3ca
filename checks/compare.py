"""Compare the registered queries with their SQL on DuckDB: ``python -m checks.compare DIR [name …]``."""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    """An in-process DuckDB with the driver tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    """A comparable form of a cell."""
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, build, sql: str | None) -> str:
    """'' when equal (or when there is no SQL but rows), else what differs."""
    df = build(spark, sf_dir)
    left = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if left else "no rows"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    right = rows_of(columns, result.fetchall())
    if left != right:
        ours, theirs = set(left), set(right)
        extra = [r for r in left if r not in theirs][:2]
        missing = [r for r in right if r not in ours][:2]
        return f"{len(left)} vs {len(right)} rows; {sorted(columns)} spark {extra} sql {missing}"
    spark_kinds = dict(df.dtypes)
    odd = [f"{c}: {spark_kinds[c]} vs {kinds[c]}" for c in columns
           if _family(spark_kinds[c]) != _family(kinds[c])]
    return f"types {odd}" if odd else ("" if left else "EMPTY")


def _family(kind: str) -> str:
    kind = kind.lower()
    if kind in ("bigint", "int", "integer", "hugeint", "smallint", "number", "tinyint"):
        return "int"
    if kind in ("double", "float", "real"):
        return "double"
    if kind in ("string", "varchar"):
        return "string"
    return kind


def main(argv: list[str]) -> int:
    """Run and print one line per query."""
    from checks import ORACLES, QUERIES
    from sparkcurate import build_session

    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark = build_session("compare", "local[8]", 8, {
        "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            found = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # keep going: the list of failures is the result
            found = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(found)
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok ' if not found else 'BAD'} {kind:4} {time.time() - start:6.2f}s {name} {found}",
              flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
