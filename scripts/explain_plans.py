"""Print the physical plans of chosen queries (formatted) for review.

usage: python scripts/explain_plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ranklab.plans.catalog import REGISTRY  # noqa: E402
from ranklab.session import build_session  # noqa: E402


def main(argv: list[str]) -> None:
    sf_dir, names = (argv[0], argv[1:]) if argv and argv[0].startswith("/") else ("/root/testdata/sf0.1", argv)
    spark = build_session()
    for name in names:
        df = REGISTRY[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # final (AQE) plan
        print(f"===== {name}")
        print(df._jdf.queryExecution().executedPlan().toString())


if __name__ == "__main__":
    main(sys.argv[1:])
