"""python -m cohortgeo COMMAND: audit, validate, groups, splits, candidates, phases, extract, release. Exit 0: done; 2: failed closed."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from cohortgeo.functions import hashing
from cohortgeo.functions.predicates import csv_values
from cohortgeo.operators import components, phases, pooling, segments, splits, validation
from cohortgeo.session import with_package
from cohortgeo.sources import inventory, release, store, tables


def _report(path: str | None, value: dict) -> None:
    if path:
        hashing.write_json(path, value)
    print(json.dumps(value, indent=2, sort_keys=True, default=str))


def audit(spark, a) -> int:
    """File census, and with --coco the integrity census; orphans, bad boxes and partial downloads are blockers."""
    files = {("cache" if r["cached"] else "payload"): {"files": r["files"], "bytes": r["bytes"], "partials": r["partials"]} for r in inventory.census(spark, a.root).collect()}
    blockers = ["partial files in the cache"] if files.get("cache", {}).get("partials") else []
    coco = {p: tables.coco_summary(spark, p).first().asDict() for p in a.coco}
    blockers += [f"{p}: annotations without image" for p, c in coco.items() if c["missing_images"]]
    _report(a.report, {"files": files, "coco": coco, "blockers": blockers})
    return 2 if blockers else 0


def validate(spark, a) -> int:
    """V6."""
    frame = tables.read_table(spark, a.input)
    if a.stage == "curated":
        errors = validation.validate_curated(frame, not a.no_boxes)
    elif a.stage == "analysis":
        errors = validation.validate_analysis(frame)
    else:
        errors = validation.validate_feature_inputs(frame, hashing.allowlist(a.allowlist))
    _report(a.report, {"stage": a.stage, "rows": frame.count(), "errors": errors})
    return 2 if errors else 0


def groups(spark, a) -> int:
    frame = tables.read_table(spark, a.input)
    components.dependency_groups(frame, csv_values(a.fields), a.observation).write.mode("errorifexists").parquet(a.output)
    return 0


def split(spark, a) -> int:
    frame = tables.read_table(spark, a.input)
    if "dependency_group_id" not in frame.columns:
        frame = frame.join(components.dependency_groups(frame, csv_values(a.fields), "observation_id"), "observation_id")
    made = splits.assign_splits(frame, [float(x) for x in csv_values(a.ratios)], csv_values(a.names), csv_values(a.stratify), csv_values(a.multilabel), a.seed)
    made.mapping.write.mode("errorifexists").parquet(a.output)
    written = spark.read.parquet(a.output)
    crossing = splits.split_violations(written).count()
    counts = {r["split"]: {"observations": r["n"], "groups": r["g"]} for r in written.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("dependency_group_id").alias("g")).collect()}
    _report(a.report, {"seed": a.seed, "realized": counts, "groups_in_two_splits": crossing})
    return 2 if crossing else 0


def candidates(spark, a) -> int:
    """Windows of label files that a curator may look at."""
    runs = segments.label_runs(tables.read_labels(spark, a.labels))
    segments.candidates(segments.centred_windows(runs, a.window), a.revision).write.mode("errorifexists").parquet(a.output)
    return 0


def phase(spark, a) -> int:
    """C3, from a table of observations with phase, keys, frame, hash and reason."""
    made = phases.build(tables.read_table(spark, a.input), a.least, a.canonicalize)
    for name in ("observations", "triplets", "exclusions"):
        getattr(made, name).write.mode("errorifexists").parquet(f"{a.output}/{name}.parquet")
    _report(a.report, {f"{r['kind']}:{r['name']}": r["n"] for r in phases.summary(made).collect()})
    return 0


def extract(spark, a) -> int:
    """E6, from a table of the frozen encoder's tokens (row_index, observation_id, embedding, occupancy): pools, a run and its catalog rows."""
    if a.layer != 11:
        raise SystemExit("only layer 11 is extracted")
    tokens = tables.read_table(spark, a.tokens)
    pools = pooling.region_pools(tokens, "observation_id", least_mass=a.least_mass)
    lost = pools.where("reason is not null")
    names = F.array(*[F.struct(F.lit(n).alias("pool"), F.col(c).cast("array<float>").alias("features")) for n, c in (("box", "box"), ("full", "full"), ("context_tokens", "context"))])
    index = tokens.groupBy("observation_id").agg(F.min("row_index").alias("row_index"))
    rows = pools.where("reason is null").join(index, "observation_id").select("row_index", "observation_id", F.inline(names))
    made = store.write_run(rows, a.output, a.run_id or store.new_run_id(), a.prefix, a.layer)
    store.append_catalog(spark, a.catalog, made)
    _report(a.report, {"keys": [r["feature_key"] for r in made], "rows": made[0]["rows"], "excluded": {r["reason"]: r["n"] for r in lost.groupBy("reason").agg(F.count("*").alias("n")).collect()}})
    return 0


def release_views(spark, a) -> int:
    """C7; the safety flag is mandatory."""
    if not a.seal_test:
        raise SystemExit("--seal-test is mandatory")
    found = release.release(tables.read_table(spark, a.observations), tables.read_table(spark, a.triplets), a.output, hashing.allowlist(a.allowlist), a.report)
    print(json.dumps(found, indent=2, sort_keys=True))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cohortgeo", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name, run, *arguments):
        p = sub.add_parser(name, help=run.__doc__)
        p.add_argument("--report")
        for flags, options in arguments:
            p.add_argument(*flags, **options)
        p.set_defaults(run=run)

    need = lambda *flags, **o: (flags, {"required": True} | o)
    may = lambda *flags, **o: (flags, o)
    flag = lambda name: ((name,), {"action": "store_true"})
    command("audit", audit, need("--root"), may("--coco", nargs="*", default=[]))
    command("validate", validate, need("--input"), need("--stage", choices=["curated", "analysis", "feature-inputs"]), may("--allowlist"), flag("--no-boxes"))
    command("groups", groups, need("--input"), need("--output"), need("--fields"), may("--observation", default="observation_id"))
    command(
        "splits", split, need("--input"), need("--output"), may("--fields", default=""), may("--ratios", default="0.70,0.15,0.15"), may("--names", default="train,validation,test"),
        may("--stratify", default=""), may("--multilabel", default=""), may("--seed", type=int, default=20260820),
    )
    command("candidates", candidates, need("--labels", nargs="+"), need("--output"), need("--revision"), may("--window", type=int, default=segments.WINDOW))
    command("phases", phase, need("--input"), need("--output"), may("--least", type=int, default=2), flag("--canonicalize"))
    command(
        "extract", extract, need("--tokens"), need("--output"), need("--catalog"), need("--prefix"), may("--run-id"), may("--layer", type=int, default=11), may("--least-mass", type=float, default=1.0)
    )
    command("release", release_views, need("--observations"), need("--triplets"), need("--output"), need("--allowlist"), flag("--seal-test"))
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = with_package(SparkSession.builder.appName("cohortgeo").getOrCreate())
    try:
        return a.run(spark, a)
    except validation.ManifestError as e:
        print(e, file=sys.stderr)
        return 2
