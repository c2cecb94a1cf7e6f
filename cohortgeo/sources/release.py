"""Release views with a sealed test part, and the one-shot access protocol."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from cohortgeo.functions.hashing import hash_json, write_json
from cohortgeo.operators.validation import raise_on_errors, validate_feature_inputs

SPLITS = ("train", "validation", "test")


def views(observations: DataFrame, triplets: DataFrame, columns: list[str]) -> dict[str, tuple[DataFrame, bool]]:
    """K6: name -> (rows, sealed). Any split outside the three raises; null counts as outside."""
    for name, frame, needed in (("observations", observations, {"observation_id", "split", *columns}), ("triplets", triplets, {"triplet_id", "split"})):
        if missing := sorted(needed - set(frame.columns)):
            raise ValueError(f"{name} lack release columns: {missing}")
        if not frame.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).isEmpty():
            raise ValueError(f"{name} have an invalid split")
    test = F.col("split") == "test"
    return {
        "analysis_trainval": (observations.where(~test), False),
        "feature_inputs": (observations.select(*columns), False),
        "triplets_trainval": (triplets.where(~test), False),
        "sealed_test_targets": (observations.where(test), True),
        "sealed_test_triplets": (triplets.where(test), True),
    }


def digest(frame: DataFrame) -> str:
    """The same for any order of the rows."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(frame.columns)]), {"ignoreNullFields": "false"}), 256)
    r = frame.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)").alias("a"), F.conv(F.substring(row, 16, 15), 16, 10).cast("decimal(20,0)").alias("b"))
    s = r.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return hash_json([int(s["n"]), int(s["a"] or 0), int(s["b"] or 0)])


def release(observations: DataFrame, triplets: DataFrame, out: str, columns: list[str], manifest: str | None = None) -> dict:
    """K6: writes the five views and returns (and writes to `manifest`, a driver's file) their digests; rows of sealed views stay untold."""
    made = views(observations, triplets, columns)
    raise_on_errors(validate_feature_inputs(made["feature_inputs"][0], columns), "feature-input view")
    artifacts = {}
    spark = observations.sparkSession
    for name, (frame, sealed) in made.items():
        path = f"{out.rstrip('/')}/{name}.parquet"
        frame.write.mode("errorifexists").parquet(path)
        written = spark.read.parquet(path)
        artifacts[name] = {"digest": digest(written), "rows": None if sealed else written.count()}
    found = {"schema_version": 1, "feature_input_columns": list(columns), "test_summaries_suppressed": True, "artifacts": artifacts}
    if manifest:
        write_json(manifest, found)
    return found


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def begin_test_access(marker: str | Path, provenance: dict) -> dict:
    """K7: creates the marker, which stays whatever follows; a second call raises FileExistsError. Driver only."""
    marker = Path(marker)
    marker.parent.mkdir(parents=True, exist_ok=True)
    record = {"accessed_at": _now(), "provenance": provenance}
    handle = os.open(marker, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o444)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")
        f.flush()
        os.fsync(f.fileno())
    return record


def complete_test_access(marker: str | Path, completion: str | Path, result: dict) -> dict:
    """K8: needs the marker; never overwrites a completion."""
    if not Path(marker).exists():
        raise FileNotFoundError("test access has not begun")
    if Path(completion).exists():
        raise FileExistsError("test access is complete already")
    record = {"completed_at": _now(), "access": json.loads(Path(marker).read_text(encoding="utf-8")), "result": result}
    write_json(completion, record)
    return record


def resolve_component(selected: bool, skipped: bool) -> bool:
    """An optional component is either selected or skipped."""
    if selected == skipped:
        raise ValueError("exactly one of selected and skipped must hold")
    return selected


def freeze_selection(path: str | Path, selection: dict, components: dict[str, tuple[bool, bool]]) -> dict:
    """Writes what validation has chosen, once: which optional components are selected, and a digest of it all. Driver only."""
    if Path(path).exists():
        raise FileExistsError("a selection is frozen already")
    body = {"selection": selection, "components": {n: resolve_component(*c) for n, c in sorted(components.items())}}
    record = {**body, "digest": hash_json(body)}
    write_json(path, record)
    return record


def locked_evaluation(frozen: str | Path, out: str | Path, marker: str | Path, completion: str | Path, evaluate) -> dict:
    """One evaluation of a frozen selection. A selection that was changed raises before the marker is made; the marker is made before
    `evaluate(folder)` first runs and stays whatever follows; its files stand in a temporary sibling folder until all are there, and the
    folder is then renamed. Driver only."""
    record = json.loads(Path(frozen).read_text(encoding="utf-8"))
    if hash_json({k: v for k, v in record.items() if k != "digest"}) != record["digest"]:
        raise RuntimeError("the frozen selection was changed")
    out = Path(out)
    if out.exists():
        raise FileExistsError(f"{out} is there already")
    begin_test_access(marker, {"selection": record["digest"]})
    out.parent.mkdir(parents=True, exist_ok=True)
    part = Path(tempfile.mkdtemp(prefix=f".{out.name}.", dir=out.parent))
    result = evaluate(part)
    os.rename(part, out)
    return complete_test_access(marker, completion, result)
