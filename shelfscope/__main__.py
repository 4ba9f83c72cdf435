"""Command line: the two everyday uses of the library, run as Spark jobs.

    python -m shelfscope analyze INPUT OUT_DIR [--key COL ...] [--no-models]
    python -m shelfscope ask INPUT "question" ["question" ...]

INPUT is a CSV file or folder (or Parquet). ``analyze`` writes every insight
to its own folder under OUT_DIR; ``ask`` prints each question's answer.
On a cluster, run it through spark-submit so the cluster's session is used.
"""

from __future__ import annotations

import argparse
import sys

from shelfscope.operators import ask
from shelfscope.plans.insights import insights
from shelfscope.session import get_session
from shelfscope.sources.files import read_table, write_insights


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfscope")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="compute every insight and write it out")
    a.add_argument("input")
    a.add_argument("out_dir")
    a.add_argument("--key", action="append", default=None,
                   help="row-key column for the random draws (repeatable)")
    a.add_argument("--no-models", action="store_true", help="skip the forest models")
    a.add_argument("--format", default="json", choices=["json", "parquet", "csv"])
    q = sub.add_parser("ask", help="answer questions about a table")
    q.add_argument("input")
    q.add_argument("questions", nargs="+")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = get_session()
    df = read_table(spark, args.input)
    if args.command == "analyze":
        out = insights(df, key_cols=args.key, fit_models=not args.no_models)
        for path in write_insights(out, args.out_dir, args.format):
            print(path)
        return 0
    questions = spark.createDataFrame([(q,) for q in args.questions], "question string")
    for row in ask.answer_questions(df, questions).collect():  # one row per question asked
        print(f"Q: {row.question}\n{row.answer}\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
