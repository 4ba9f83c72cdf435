"""Print the formatted physical plan of registered queries.

Usage: python scripts/show_plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfscope.plans import registry  # noqa: E402
from shelfscope.session import get_session  # noqa: E402


def main(argv: list[str]) -> None:
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")] or ["association_rules"]
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    for name in names:
        print(f"===== {name}")
        registry.QUERIES[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main(sys.argv)
