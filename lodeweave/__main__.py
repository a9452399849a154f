"""``python -m lodeweave VERB [SYMBOL] [options]``: one verb over one tree."""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from lodeweave.functions.envelope import Envelope, plural
    from lodeweave.operators.fusion import counts_by, coverage_totals
    from lodeweave.plans.engine import MOST_USED, Engine
    from lodeweave.sources import ledger, store, tree
    from lodeweave.sources.diff import changed_lines

    verbs = "refs callers defs graph effects tests describe inputs mock-targets hierarchy deadcode canonical imports index trace".split()
    p = argparse.ArgumentParser(prog="lodeweave")
    p.add_argument("verb", choices=verbs)
    p.add_argument("symbol", nargs="?")
    p.add_argument("--root", default=".")
    p.add_argument("--reverse", action="store_true")
    p.add_argument("--cycles", action="store_true")
    p.add_argument("--depth", type=int)
    p.add_argument("--base")
    p.add_argument("--suite", action="store_true", help="run the tests once and fuse what they show")
    p.add_argument("--store", help="folder of stored facts and of the last test run")
    p.add_argument("--python", help="interpreter that runs the tests")
    p.add_argument("--clean", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--pretty", action="store_true")
    a, rest = p.parse_known_args(argv)
    if rest and a.verb != "trace":
        p.error(f"unrecognized arguments: {' '.join(rest)}")
    if a.verb in ("refs", "callers", "defs", "graph", "hierarchy", "describe") and not (a.symbol or "").strip():
        p.exit(1, "lodeweave: a symbol is required\n")
    if a.verb == "tests" and not a.symbol and not a.base:
        p.exit(1, "lodeweave: tests needs a symbol or --base\n")
    spark = SparkSession.builder.master(
        os.environ.get("LODEWEAVE_MASTER", "local[*]")
    ).config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root = os.path.realpath(a.root)
    if a.verb == "index" and a.clean:
        store.clean(spark, a.store)
        return 0
    if a.verb == "trace":
        arguments = [a.symbol, *rest] if a.symbol else rest
        run = ledger.run_suite(spark, root, arguments, a.python)
        df = ledger.events(run) if run.events is not None else spark.createDataFrame([], "owner_fqn string")
        answer = Envelope.of("lodeweave", {"verb": a.verb, "arguments": arguments, "root": root}, df, "event", run.warnings)
        print(answer.json(a.pretty) if a.json or a.pretty else answer.text())
        return 0
    engine = store.engine(spark, root, a.store) if a.store else Engine.of_tree(spark, root)
    run = None
    if a.suite and a.verb in ("effects", "tests", "describe"):
        run = (
            ledger.stored_run(spark, root, a.store, store.fingerprint(engine.files), a.python)
            if a.store
            else ledger.run_suite(spark, root, python=a.python)
        )
    warnings, notes = list(run.warnings) if run else [], []
    query = {"verb": a.verb, "symbol": a.symbol, "root": root}
    if a.symbol and a.verb in ("graph", "tests", "effects", "describe", "hierarchy", "callers") and not engine.exists(a.symbol):
        warnings.append(f"no definition matches {a.symbol}")
    if a.verb in ("callers", "tests", "graph") and a.symbol and (a.verb != "graph" or a.reverse):
        caveats = engine.dispatch_caveat(a.symbol).collect()
        query["exhaustive"] = not caveats
        warnings += [f"{r['fqn']} may be called from outside the tree ({r['why']})" for r in caveats]
    if a.verb == "tests" and a.base:
        df, what = engine.change_coverage(changed_lines(spark, tree.git_diff(root, a.base)), run.coverage if run else None), "line"
    elif a.verb == "imports":
        df, what = (engine.import_cycles(), "cycle") if a.cycles else (engine.imports(a.symbol, a.reverse), "edge")
    elif a.verb == "index":
        df, what = spark.createDataFrame([(engine.edges.count(), engine.resolver.uses.count())], "edges long, uses long"), "index"
    else:
        table = {
            "refs": lambda: (engine.refs(a.symbol), "reference"), "callers": lambda: (engine.callers(a.symbol), "caller"), "defs": lambda: (engine.defs_of(a.symbol), "definition"),
            "graph": lambda: (engine.graph(a.symbol, a.reverse, a.depth), "node"), "effects": lambda: (
                engine.effects(a.symbol, run.effects if run else None), "effect",
            ),
            "tests": lambda: (engine.tests(a.symbol), "test"), "describe": lambda: (
                engine.describe(a.symbol, run.shapes if run else None), "row",
            ), "inputs": lambda: (engine.inputs(a.symbol), "input"),
            "mock-targets": lambda: (engine.mock_targets(), "target"), "hierarchy": lambda: (engine.hierarchy(a.symbol), "row"), "deadcode": lambda: (engine.deadcode(), "dead callable"),
            "canonical": lambda: (engine.canonical(), "row"),
        }
        df, what = table[a.verb]()
        if a.verb == "inputs" and not a.symbol:
            scripts = [r["path"] for r in engine.input_scripts().limit(7).collect()]
            if scripts:
                notes.append("scripts with inputs of their own: " + ", ".join(scripts[:6]) + (" ..." if len(scripts) > 6 else ""))
        if a.verb == "deadcode":
            warnings.append("names reached only by reflection or from outside the tree are listed too")
    if a.verb == "effects":
        counts = counts_by(df, "confidence", "category").orderBy("confidence").collect()
        notes += [f"{r['n']} {r['confidence']}: {', '.join(r['category'])}" for r in counts]
    if a.verb == "tests" and a.base and run:
        totals = coverage_totals(df).orderBy("path").collect()
        notes.append(f"{sum(r['covered'] for r in totals)} changed lines covered, {sum(r['uncovered'] for r in totals)} uncovered in {len(totals)} files")
        bare = [r["path"] for r in totals if not r["covered"]]
        warnings += [f"no covered changed line in {', '.join(bare)}"] if bare else []
    if a.verb == "mock-targets":
        drifted = df.where("verdict = 'drifted'").count()
        warnings += [f"{drifted} drifted {plural('target', drifted)}"] if drifted else []
    if a.verb == "deadcode":
        notes.append(f"among {engine.population.count()} callables")
    if a.verb == "canonical" and df.where("section = 'most-used'").count() == MOST_USED:
        warnings.append(f"most-used shows the first {MOST_USED} by use at most")
    answer = Envelope.of("lodeweave", query, df, what, warnings, notes)
    print(answer.json(a.pretty) if a.json or a.pretty else answer.text())
    return 0


if __name__ == "__main__":
    sys.exit(main())
