"""Command line: demo, analyze, triage, inject, eval, ablate, noref. python -m spanwright.cli COMMAND ...

Under spark-submit the session of the cluster serves, else a local one."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from .functions.paths import PathError
from .operators import corpus, diagnosis, evaluation, recommend, signals, triage
from .operators import simulator as M
from .session import current_session
from .sources import ingest, store


def _traces(spark, path: str, field_map: str | None):
    lines = ingest.read_documents(spark, path) if path.endswith(".json") else ingest.read_lines(spark, path)
    fields = json.load(open(field_map)) if field_map else None
    out = ingest.ingest(lines, fields)
    return out.withColumn("row_no", F.monotonically_increasing_id())


def _report(traces):
    return diagnosis.diagnose(signals.missing_others(signals.black_signals(signals.tokens(traces))))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanwright")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "triage"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--field-map")
        s.add_argument("--top", type=int, default=10, help="rows to print; 0 prints all")
        s.add_argument("--json", action="store_true")
    for name in ("demo", "eval", "ablate", "noref"):
        s = sub.add_parser(name)
        s.add_argument("--seeds", type=int, default=2)
    s = sub.add_parser("inject")
    s.add_argument("out")
    s.add_argument("--seeds", type=int, default=4)
    a = p.parse_args(argv)
    spark = current_session()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if a.command in ("analyze", "triage"):
            rows = _traces(spark, a.path, a.field_map)
            bad = rows.where("error IS NOT NULL")
            reports = _report(rows.where("error IS NULL"))
            if a.command == "triage":
                ranked, total = triage.clusters(reports), triage.summary(reports)
                print(triage.render(ranked, total, a.top) if not a.json else "\n".join(r[0] for r in store.to_lines(triage.top(ranked, a.top)).collect()))
            else:
                cols = ["id", "primary_mode", "headline", "confidence", "bucket"]
                lines = store.to_lines(reports.select(*cols))
                for r in (lines.limit(a.top) if a.top > 0 else lines).toLocalIterator():
                    print(r[0])
            for r in bad.select("id", "error").limit(triage.FAILURES).collect():
                print(f"unread {r['id']}: {r['error']}", file=sys.stderr)
        elif a.command == "inject":
            store.write_lines(corpus.build(corpus.facts(spark), a.seeds).select("id", "prompt", "question", "generated_answer", "labels", "injection_recipe"), a.out)
        else:
            rows = corpus.build(corpus.facts(spark), a.seeds)
            if a.command == "noref":
                logged = rows.select("row_no", "id", "prompt", "question", "generated_answer", "retrieved_context", "ground_truth", F.lit(None).cast("string").alias("meta"), "source", "labels")
                base, bare = (diagnosis.diagnose(signals.log_signals(x)) for x in (logged, evaluation.strip_reference(logged)))
                evaluation.no_reference_delta(base, bare).orderBy("metric").show(truncate=False)
            elif a.command == "ablate":
                evaluation.family_ablation(rows).show(truncate=False)
            else:
                reports = diagnosis.diagnose(rows)
                if a.command == "eval":
                    evaluation.metrics(reports).show(truncate=False)
                    evaluation.mode_scores(reports).show(truncate=False)
                else:
                    recommend.recommend(M.with_hints(reports)).select("id", "primary_mode", "headline", "confidence", "recommendations").show(12, truncate=False)
    except (PySparkException, PathError, OSError, ValueError) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
