"""Command line: ``reindex``, ``search`` and ``eval`` over a folder of notes."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from .plans.engine import MODES, Engine
from .plans.evaluate import format_report, load_queries
from .session import get_spark
from .streaming.snapshots import SnapshotStore
from .streaming.sync import Indexer


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmill", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("reindex")
    a.add_argument("vault")
    a.add_argument("index")
    a.add_argument("--full", action="store_true")
    a = sub.add_parser("search")
    a.add_argument("index")
    a.add_argument("query")
    a.add_argument("--limit", type=int, default=8)
    a.add_argument("--mode", choices=MODES, default="hybrid")
    a = sub.add_parser("eval")
    a.add_argument("index")
    a.add_argument("queries")
    a.add_argument("-k", type=int, default=5)
    a.add_argument("--json", action="store_true")
    given = parser.parse_args(args)
    spark = get_spark()
    store = SnapshotStore(spark, given.index)
    if given.command == "reindex":
        print(json.dumps(asdict(Indexer(store, given.vault).run(given.full))))
    elif given.command == "search":
        for row in Engine.open(store).search(given.query, given.limit, given.mode).toJSON().toLocalIterator():
            print(row)
    else:
        with open(given.queries, encoding="utf-8") as f:
            rows = load_queries(f.read())
        table = spark.createDataFrame([(r["qid"], r["query"], r["relevant"], r["lang"]) for r in rows], "qid bigint, query string, relevant array<string>, lang string")
        metrics = Engine.open(store).evaluate(table, given.k)
        print(json.dumps({m: [r.asDict() for r in x] for m, x in metrics.items()}) if given.json else format_report(metrics))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
