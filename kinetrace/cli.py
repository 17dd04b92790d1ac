"""Command line over the operators (section 2.12): ``python -m kinetrace.cli VERB ...``."""

from __future__ import annotations

import argparse
import json
import platform
import sys
from functools import reduce

from pyspark.sql import functions as F

from .drivers import cache, prediction, training
from .functions.vocabulary import DEPRECATED, EVENTS, RATE_PER_HOUR, STATES, events_table
from .models import boosting
from .operators import features, mining, reports, splits
from .session import build
from .sources import recordings, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinetrace")
    p.add_argument("--master", default="local[8]")
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("plan-storage")
    v.add_argument("--cows", type=int, required=True)
    v.add_argument("--days", type=int, required=True)
    verbs.add_parser("check-env")
    v = verbs.add_parser("check-data", help="the checks of an annotation table and of what is given beside it; exit code 1 on FAIL")
    v.add_argument("annotations")
    v.add_argument("--sessions")
    v.add_argument("--caches")
    v.add_argument("--folds")
    v.add_argument("--features")
    v = verbs.add_parser("diagnose", help="audit, evaluability and balance of an annotation table, and of what is given beside it, as Markdown, or as JSON below a folder too")
    v.add_argument("annotations")
    v.add_argument("--out")
    for name in ("segments", "coverage", "folds", "points"):
        v.add_argument(f"--{name}")
    v = verbs.add_parser("build-cache", help="recordings (JSON documents, named by session) to a labelled session cache")
    v.add_argument("recordings")
    v.add_argument("annotations")
    v.add_argument("calibration")
    v.add_argument("out")
    v.add_argument("--coverage")
    v.add_argument("--tail-policy", default="derive", choices=("derive", "exclude", "legacy"))
    v = verbs.add_parser("train-gbdt", help="features and labels, joined by session, segment and centre, to a bundle")
    v.add_argument("features")
    v.add_argument("labels")
    v.add_argument("out")
    v.add_argument("--trees", type=int, default=400)
    v = verbs.add_parser("predict", help="a signal and a bundle to scores and event intervals; offline unless --causal")
    v.add_argument("signal")
    v.add_argument("bundle")
    v.add_argument("out")
    v.add_argument("--causal", action="store_true")
    v.add_argument("--threshold", type=float)
    v.add_argument("--no-postprocess", action="store_true")
    verbs.add_parser("train", help="networks are trained outside; an exported one is scored by kinetrace.models.onnx")
    v = verbs.add_parser("make-splits")
    v.add_argument("sessions")
    v.add_argument("out")
    v.add_argument("--folds", type=int, default=5)
    v = verbs.add_parser("build-features", help="causal unless --offline")
    v.add_argument("signal")
    v.add_argument("out")
    v.add_argument("--offline", action="store_true")
    v.add_argument("--version", type=int, default=2)
    v = verbs.add_parser("mine")
    v.add_argument("predictions", nargs="+")
    v.add_argument("out")
    v.add_argument("--event", required=True)
    v.add_argument("--budget", type=int, default=40)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build(a.master)
    if a.verb == "plan-storage":
        row = spark.range(1).select(*reports.storage(F.lit(a.cows), F.lit(a.days))).first()
        print(json.dumps(row.asDict()))
    elif a.verb == "check-env":
        print(json.dumps({"python": platform.python_version(), "spark": spark.version, "cores": spark.sparkContext.defaultParallelism}))
    elif a.verb == "check-data":
        more = {k: sinks.read_table(spark, p) for k, p in (("sessions", a.sessions), ("caches", a.caches), ("folds", a.folds), ("numbers", a.features)) if p}
        rows = reports.data_checks(sinks.read_table(spark, a.annotations), (*STATES, *EVENTS, *DEPRECATED), **more).collect()
        print(sinks.markdown([r.asDict() for r in rows]))
        return int(rows[0]["verdict"] == "FAIL")
    elif a.verb == "diagnose":
        d = sinks.read_table(spark, a.annotations)
        given = [sinks.read_table(spark, p) if p else None for p in (a.segments, a.coverage, a.folds, a.points)]
        tables = reports.diagnostics(d, events_table(spark), *given)
        found = {k: [r.asDict() for r in t.collect()] for k, t in tables.items()}
        print("\n\n".join(f"## {k}\n\n{sinks.markdown(rows)}" for k, rows in found.items()))
        if a.out:
            sinks.write_json(spark, found, f"{a.out}/diagnostics")
    elif a.verb == "build-cache":
        raw = recordings.read_json(spark, a.recordings).withColumn("cache_key", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
        marks = sinks.read_table(spark, a.annotations).withColumnsRenamed({"session_id": "cache_key", "t_start_rel_ms": "start_t", "t_end_rel_ms": "end_t"})
        manifest = sinks.read_table(spark, a.calibration).withColumnRenamed("session_id", "cache_key")
        seen = sinks.read_table(spark, a.coverage).withColumnsRenamed({"session_id": "cache_key", "t_start_rel_ms": "start_t", "t_end_rel_ms": "end_t"}) if a.coverage else None
        done = cache.build_cache(raw, marks, manifest, seen, a.tail_policy)
        done.write(a.out)
        print(json.dumps(done.summary.first().asDict(), default=str))
    elif a.verb == "train-gbdt":
        told = sinks.read_json(spark, f"{a.features.rstrip('/')}.manifest")
        rows = sinks.read_table(spark, a.features).join(sinks.read_table(spark, a.labels), ["cache_key", "segment_id", "center_index"])
        columns = features.names(told["feature_version"])
        tasks, summary = training.train_tasks(rows, "cow_id", columns, boosting.Settings(trees=a.trees), told["feature_version"])
        training.save_bundle(spark, tasks, summary, a.out)
        print(json.dumps({k: summary[k] for k in ("trained", "skipped", "thresholds")}))
    elif a.verb == "predict":
        tasks, summary = training.load_bundle(spark, a.bundle)
        d = sinks.read_table(spark, a.signal)
        about = d.groupBy("cache_key", "segment_id").agg(*[F.first(c).alias(c) if c in d.columns else F.lit("").alias(c) for c in ("cow_id", "device_mac", "session_id")], F.min("t_ms").alias("_t"), F.min("frame_index").alias("_i"))
        made = features.build(d, causal=a.causal, version=summary["feature_version"]).join(about, ["cache_key", "segment_id"])
        made = made.withColumn("center_time_ms", recordings.frame_time(F.col("_t"), F.col("center_index"), F.col("_i"))).drop("_t", "_i")
        prediction.run(made, tasks, a.out, a.threshold, not a.no_postprocess, {"causal": a.causal, "feature_version": summary["feature_version"]})
    elif a.verb == "train":
        print("networks are trained outside; export one and score it with kinetrace.models.onnx", file=sys.stderr)
        return 2
    elif a.verb == "make-splits":
        d = sinks.read_table(spark, a.sessions)
        d = d.filter("status = 'included'") if "status" in d.columns else d
        sinks.write_table(splits.grouped_folds(d, "cow_id", a.folds), a.out, {"folds": a.folds, "validation": 0.2})
    elif a.verb == "build-features":
        d = sinks.read_table(spark, a.signal)
        sinks.write_table(features.build(d, causal=not a.offline, version=a.version), a.out, {"causal": not a.offline, "feature_version": a.version})
    elif a.verb == "mine":
        d = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [sinks.read_table(spark, p) for p in a.predictions])
        rate = RATE_PER_HOUR.get(a.event)
        queue = mining.review_queue(d.withColumnRenamed("center_time_ms", "t"), ["device_mac", "session_id"], "cow_id", "t", f"prob_{a.event}", a.budget, rate)
        sinks.write_table(mining.numbered(queue, ["selection_strategy", "device_mac", "session_id", "start_t"]), a.out, {"event": a.event, "budget": a.budget}, "csv")
    return 0


if __name__ == "__main__":
    sys.exit(main())
