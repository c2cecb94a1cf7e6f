"""Commands on small tables."""

import json

import pytest

from cohortgeo import cli
from cohortgeo.sources import config, store


def test_splits_and_validate(spark, tmp_path):
    rows = [(f"o{i:02d}", f"v{i // 2}", "x") for i in range(12)]
    spark.createDataFrame(rows, "observation_id string, video string, kind string").write.parquet(str(tmp_path / "in.parquet"))
    run = lambda *a: cli.main([str(x) for x in a])
    assert run("groups", "--input", tmp_path / "in.parquet", "--output", tmp_path / "g.parquet", "--fields", "video") == 0
    assert spark.read.parquet(str(tmp_path / "g.parquet")).select("dependency_group_id").distinct().count() == 6
    assert run("splits", "--input", tmp_path / "in.parquet", "--output", tmp_path / "s.parquet", "--fields", "video", "--stratify", "kind", "--report", tmp_path / "s.json") == 0
    assert sum(v["observations"] for v in json.loads((tmp_path / "s.json").read_text())["realized"].values()) == 12
    assert run("validate", "--input", tmp_path / "in.parquet", "--stage", "curated", "--report", tmp_path / "v.json") == 2
    with pytest.raises(SystemExit):
        run("release", "--observations", "x", "--triplets", "y", "--output", "z", "--allowlist", "w")


def test_candidates_and_audit(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/sequence.3.txt").write_text("a\n" * 32 + "b\n" * 3)
    assert cli.main(["candidates", "--labels", str(tmp_path / "d/sequence.3.txt"), "--output", str(tmp_path / "c.parquet"), "--revision", "r"]) == 0
    row = spark.read.parquet(str(tmp_path / "c.parquet")).first()
    assert (row["start_frame"], row["end_frame"]) == (1, 30)
    assert cli.main(["audit", "--root", str(tmp_path / "d")]) == 0


def test_extract(spark, tmp_path):
    rows = [(k, f"o{k}", [float(k + j), 1.0], 0.5) for k in range(3) for j in range(4)] + [(9, "small", [1.0, 1.0], 0.1)]
    spark.createDataFrame(rows, "row_index long, observation_id string, embedding array<double>, occupancy double").write.parquet(str(tmp_path / "tokens.parquet"))
    run = lambda name, *a: cli.main(["extract", "--tokens", str(tmp_path / "tokens.parquet"), "--output", str(tmp_path / name), "--catalog", str(tmp_path / "catalog"), "--prefix", name, "--run-id", name, "--report", str(tmp_path / "r.json"), *a])
    assert run("first") == 0
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["rows"] == 3 and report["excluded"] == {"region_below_minimum_mass": 1} and len(report["keys"]) == 3
    box = {r["observation_id"]: r["features"] for r in store.load_feature(spark, str(tmp_path / "catalog"), "first/layer11/box/none/all").collect()}
    assert box["o1"] == pytest.approx([2.5, 1.0]) and set(box) == {"o0", "o1", "o2"}
    with pytest.raises(SystemExit):
        run("second", "--layer", "10")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        run("first")


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"root": "data", "n": 2}')
    assert config.read_config(tmp_path / "a.json") == {"root": "data", "n": 2}
    assert config.workspace_path("/w/", "data/x") == "/w/data/x" and config.workspace_path("/w", "/abs") == "/abs" and config.workspace_path("/w", "s3://b/x") == "s3://b/x"
    (tmp_path / "b.json").write_text("[1]")
    for bad in ("b.json", "c.toml"):
        (tmp_path / "c.toml").write_text("")
        with pytest.raises(ValueError):
            config.read_config(tmp_path / bad)
    (tmp_path / "d.yaml").write_text("root: data\n")
    try:
        assert config.read_config(tmp_path / "d.yaml") == {"root": "data"}
    except RuntimeError as e:
        assert "YAML" in str(e)
