"""Command line: ``python -m tarnlake [--data DIR] [--explain] [--strict] [SQL ...]``.

With SQL it prints the result as a table and the elapsed time on stderr; with --explain the
logical plan before and after optimization instead. Without SQL it is a prompt, left by exit,
quit or the end of input; errors are printed and the prompt goes on.
"""

from __future__ import annotations

import argparse
import sys
import time

from tarnlake.errors import EngineError, translated
from tarnlake.plans import describe, run_sql
from tarnlake.session import make_session
from tarnlake.sources import Catalog

#: Rows that are fetched and printed at a time.
SHOWN = 1000


def show(df) -> None:
    """All rows, as one table for each SHOWN of them; the driver holds few partitions at a time."""
    line, first = [], True

    def table() -> None:
        cells = [["NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in row] for row in line]
        widths = [max(len(name), *(len(c[i]) for c in cells)) if cells else len(name) for i, name in enumerate(df.columns)]
        rule = "+" + "+".join("-" * w for w in widths) + "+"
        print(rule, "|" + "|".join(n.rjust(w) for n, w in zip(df.columns, widths, strict=True)) + "|", rule, sep="\n")
        for c in cells:
            print("|" + "|".join(v.rjust(w) for v, w in zip(c, widths, strict=True)) + "|")
        print(rule)

    for row in df.toLocalIterator():
        line.append(row)
        if len(line) == SHOWN:
            table()
            line, first = [], False
    if line or first:
        table()


def answer(spark, catalog: Catalog, sql: str, explain: bool, strict: bool) -> None:
    began = time.perf_counter()
    df = run_sql(spark, sql, catalog, strict)
    if explain:
        print(describe(df))
        return
    with translated():
        show(df)
    print(f"elapsed: {time.perf_counter() - began:.3f} s", file=sys.stderr)


def main(args: list[str] | None = None, lines=None) -> int:
    parser = argparse.ArgumentParser(prog="tarnlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--data", default="data", help="folder of NAME.parquet tables")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--strict", action="store_true", help="refuse query forms outside the core dialect")
    parser.add_argument("--master", default=None)
    parser.add_argument("sql", nargs="*")
    given = parser.parse_args(args)
    spark = make_session(given.master or "local[*]", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        catalog = Catalog(spark, given.data)
        if given.sql:
            answer(spark, catalog, " ".join(given.sql), given.explain, given.strict)
            return 0
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print("> ", end="", flush=True)
    for line in sys.stdin if lines is None else lines:
        line = line.strip()
        if line in ("exit", "quit"):
            break
        if line:
            try:
                answer(spark, catalog, line, given.explain, given.strict)
            except EngineError as e:
                print(f"{type(e).__name__}: {e}")
        print("> ", end="", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
