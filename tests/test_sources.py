"""Sources, the feature store, release views, locks and streams on small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from cohortgeo.sources import inventory, release, store, tables
from cohortgeo.streaming import jobs


def box(kind: bytes, body: bytes, wide: bool = False) -> bytes:
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if wide else struct.pack(">I4s", 8 + len(body), kind) + body


def mp4(samples: int = 90, version: int = 0) -> bytes:
    tkhd = box(b"tkhd", bytes(76) + struct.pack(">II", 1408 << 16, 1408 << 16))
    mdhd = box(b"mdhd", bytes([version, 0, 0, 0]) + (bytes(16) + struct.pack(">IQ", 30, 90) if version else bytes(8) + struct.pack(">II", 30, 90)))
    hdlr = box(b"hdlr", bytes(8) + b"vide" + bytes(12))
    stbl = box(b"stbl", box(b"stsd", bytes(12) + b"avc1" + bytes(8)) + box(b"stsz", bytes(8) + struct.pack(">I", samples)))
    return box(b"ftyp", b"isom") + box(b"moov", box(b"trak", tkhd + box(b"mdia", hdlr + mdhd + box(b"minf", stbl)), wide=True))


def test_probe(spark, tmp_path):
    for v in (0, 1):
        p = inventory.probe(mp4(90, v))
        assert (p.codec, p.width, p.height, p.sample_count, p.duration_seconds, p.fps) == ("avc1", 1408, 1408, 90, 3.0, 30.0)
    (tmp_path / "sequence_1.mp4").write_bytes(mp4())
    (tmp_path / "sequence_2.mp4").write_bytes(b"\0\0\0\x04moov")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in inventory.probe_videos(spark, str(tmp_path)).collect()}
    assert rows["sequence_1.mp4"]["fps"] == 30.0 and rows["sequence_2.mp4"]["error"]


def test_census_sees_hidden_files(spark, tmp_path):
    (tmp_path / ".cache/a").mkdir(parents=True)
    (tmp_path / ".cache/a/x.lock").write_text("ab")
    (tmp_path / ".cache/a/y.metadata").write_text("rev1\nz")
    (tmp_path / "data").mkdir()
    (tmp_path / "data/v.lock").write_text("abc")
    rows = {r["cached"]: r for r in inventory.census(spark, str(tmp_path)).collect()}
    assert (rows[True]["files"], rows[True]["bytes"], rows[True]["partials"]) == (2, 8, 1)
    assert (rows[False]["files"], rows[False]["partials"]) == (1, 0)
    assert [tuple(r) for r in tables.metadata_revisions(spark, [str(tmp_path / ".cache/a/y.metadata")]).collect()] == [("rev1", 1)]


def test_coco(spark, tmp_path):
    big = 2**70
    doc = {
        "images": [{"id": 1, "file_name": "a_1.jpg", "width": 10, "height": 20}, {"id": big, "file_name": "b_2.jpg"}, {"id": 1, "file_name": "c_3.jpg"}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 2, "bbox": [0, 0, 2, 2], "segmentation": [[0, 0, 1, 0, 1, 1], [0, 0]]},
            {"id": 2, "image_id": 9, "category_id": 1, "bbox": [0, 0, 0, 2], "segmentation": [[0, 0, 1]]},
            {"id": 3, "image_id": big, "category_id": 2, "bbox": [1, 2, 3], "segmentation": None},
        ],
        "categories": [{"id": 1}],
    }
    path = tmp_path / "coco.json"
    path.write_text(json.dumps(doc))
    r = tables.coco_summary(spark, str(path)).first()
    assert (r["images"], r["annotations"], r["categories"], r["missing_images"], r["bad_boxes"], r["bad_components"], r["no_valid_component"]) == (3, 3, 2, 1, 2, 2, 1)
    images, annotations = tables.read_coco(spark, str(path))
    assert {x["id"]: x["file_name"] for x in images.collect()} == {"1": "c_3.jpg", str(big): "b_2.jpg"}
    assert [len(x["polygons"]) for x in annotations.orderBy("id").collect()] == [1, 0, 0]
    flat = spark.createDataFrame([("[0,0,1,0,1,1]",), ("nope",), (None,)], "s string")
    assert [len(x[0]) for x in flat.select(tables.polygons(F.col("s"))).collect()] == [1, 0, 0]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"observations": {"o1": {"boxes_xywh": [[1, 2, 3, 4]]}, "o2": {"polygons_by_frame": [[[0, 0, 1, 0, 1, 1]]]}}}')
    (tmp_path / "b.json").write_text("[[5, 6, 7, 8], [1, 1, 1, 1]]")
    (tmp_path / "c.json").write_text('{"boxes_xywh": [[9, 9, 9, 9]]}')
    got = {(r["path"].rsplit("/", 1)[1], r["observation_id"]): r for r in tables.read_annotations(spark, str(tmp_path / "*.json")).collect()}
    assert got["a.json", "o1"]["boxes_xywh"] == [[1.0, 2.0, 3.0, 4.0]] and got["a.json", "o2"]["polygons_by_frame"] == [[[0.0, 0.0, 1.0, 0.0, 1.0, 1.0]]]
    assert len(got["b.json", None]["boxes_xywh"]) == 2 and got["c.json", None]["boxes_xywh"] == [[9.0] * 4]
    two = spark.createDataFrame([(None, [[1.0] * 4] * 2), ([2.0] * 4, None)], "own array<double>, file array<array<double>>")
    assert two.where("file is not null").select(tables.boxes_of(F.col("own"), F.col("file"), 2)).first()[0] == [[1.0] * 4] * 2
    with pytest.raises(Exception, match="boxes of four"):
        two.select(tables.boxes_of(F.col("own"), F.col("file"), 2)).collect()


def test_labels(spark, tmp_path):
    (tmp_path / "sequence.7.txt").write_text("a\na\nb\n")
    (tmp_path / "sequence.8.txt").write_text("")
    got = [tuple(r) for r in tables.read_labels(spark, str(tmp_path / "sequence.*.txt")).orderBy("frame").collect()]
    assert got == [("7", 0, "a"), ("7", 1, "a"), ("7", 2, "b")]


def test_read_table(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    assert tables.read_table(spark, str(tmp_path / "x.csv")).first()["b"] == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.txt")


def features(spark, n=2):
    rows = [(i, f"o{i}", p, [float(i), 1.0]) for p in ("box", "full") for i in range(n)]
    return spark.createDataFrame(rows, "row_index long, observation_id string, pool string, features array<float>")


def test_store(spark, tmp_path):
    run, catalog = str(tmp_path / "run"), str(tmp_path / "catalog")
    rows = store.write_run(features(spark), run, "r1", "emb", 11)
    assert [r["feature_key"] for r in rows] == ["emb/layer11/box/none/all", "emb/layer11/full/none/all"]
    store.append_catalog(spark, catalog, rows)
    assert store.load_feature(spark, catalog, rows[0]["feature_key"]).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.write_run(features(spark), run, "r2", "emb", 11)
    with pytest.raises(FileExistsError):
        store.append_catalog(spark, catalog, rows[:1])
    with pytest.raises(ValueError):
        store.append_catalog(spark, catalog, [rows[0] | {"feature_key": "n", "run_id": "n"}] * 2)
    with pytest.raises(KeyError):
        store.load_feature(spark, catalog, "none")
    features(spark, 1).write.mode("append").partitionBy("pool").parquet(run)
    with pytest.raises(RuntimeError):
        store.load_feature(spark, catalog, rows[0]["feature_key"])
    assert [(r["ok"], r["error"] is None) for r in store.sanity(spark, catalog).collect()] == [(False, False)] * 2
    bad = features(spark).withColumn("features", F.array(F.lit(float("nan")).cast("float")))
    with pytest.raises(ValueError):
        store.write_run(bad, str(tmp_path / "bad"), "r", "emb", 1)


def test_release(spark, tmp_path):
    obs = spark.createDataFrame([("a", "train", "open", 1.0), ("b", "test", "shut", 2.0), ("c", "validation", "open", 3.0)], "observation_id string, split string, state_label string, fps double")
    trip = spark.createDataFrame([("t1", "train"), ("t2", "test")], "triplet_id string, split string")
    m = release.release(obs, trip, str(tmp_path / "out"), ["observation_id", "fps"], str(tmp_path / "m.json"))
    assert m["artifacts"]["sealed_test_targets"]["rows"] is None and m["artifacts"]["analysis_trainval"]["rows"] == 2
    assert spark.read.parquet(str(tmp_path / "out/feature_inputs.parquet")).columns == ["observation_id", "fps"]
    assert spark.read.parquet(str(tmp_path / "out/analysis_trainval.parquet")).where("split = 'test'").isEmpty()
    with pytest.raises(ValueError):
        release.views(obs.withColumn("split", F.lit(None).cast("string")), trip, ["fps"])


def test_lock(tmp_path):
    marker, done = tmp_path / "m", tmp_path / "d"
    with pytest.raises(FileNotFoundError):
        release.complete_test_access(marker, done, {})
    release.begin_test_access(marker, {"a": 1})
    with pytest.raises(FileExistsError):
        release.begin_test_access(marker, {})
    release.complete_test_access(marker, done, {"x": 1})
    with pytest.raises(FileExistsError):
        release.complete_test_access(marker, done, {})


def test_stream_matches_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 7, "view" if i % 2 else "buy", float(i)) for i in range(60)], "s long, user_id long, event_type string, value double")
    e = e.select(F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value")
    e.write.parquet(str(tmp_path / "in"))
    stream = jobs.chunk_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("chunks").start()
    q.processAllAvailable()
    q.stop()
    want = e.groupBy(F.window("ts", "4 seconds", "3 seconds"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, spark.table("chunks").collect())) == sorted(map(tuple, want.collect()))


def test_stream_catalog(spark, tmp_path):
    rows = store.write_run(features(spark), str(tmp_path / "run"), "r1", "emb", 11)
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in store.CATALOG.split(", ")) for r in rows], store.CATALOG)
    frame.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run sees the same rows again, as after a restart without its checkpoint
        q = jobs.guarded_catalog(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cat"), str(tmp_path / f"cp{_}")).start()
        q.processAllAvailable()
        q.stop()
    assert store.read_catalog(spark, str(tmp_path / "cat")).count() == 2


def test_frozen_selection_is_evaluated_once(tmp_path):
    frozen, marker, done, out = (tmp_path / n for n in ("frozen.json", "started.lock", "completed.lock", "locked"))
    with pytest.raises(ValueError):
        release.freeze_selection(frozen, {"key": "a"}, {"mask": (True, True)})
    release.freeze_selection(frozen, {"key": "a"}, {"mask": (False, True), "adapter": (True, False)})
    with pytest.raises(FileExistsError):
        release.freeze_selection(frozen, {"key": "b"}, {})
    text = frozen.read_text()
    frozen.write_text(text.replace('"a"', '"b"'))
    with pytest.raises(RuntimeError):
        release.locked_evaluation(frozen, out, marker, done, lambda folder: {})
    assert not marker.exists()
    frozen.write_text(text)

    def fails(folder):
        (folder / "part.txt").write_text("x")
        raise OSError("metric failure")

    with pytest.raises(OSError):
        release.locked_evaluation(frozen, out, marker, done, fails)
    assert marker.exists() and not out.exists() and not done.exists()
    with pytest.raises(FileExistsError):
        release.locked_evaluation(frozen, out, marker, done, lambda folder: {})
    marker.unlink()
    record = release.locked_evaluation(frozen, out, marker, done, lambda folder: (folder / "r.txt").write_text("1") and {"ok": True})
    assert record["result"] == {"ok": True} and (out / "r.txt").read_text() == "1" and done.exists()
