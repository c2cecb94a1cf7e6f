"""Immutable feature runs and their append-only catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortgeo.functions.predicates import is_finite
from cohortgeo.sources.shared import materialize

CATALOG = "feature_key string, run_id string, pool string, layer int, control string, subset string, features_path string, features_digest string, rows long, dimension int"


def _row_digest() -> Column:
    return F.sha2(F.concat_ws("|", F.col("row_index").cast("string"), "observation_id", "pool", F.to_json("features")), 256)


def _share(row: Column, start: int) -> Column:
    return F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(20,0)")


def content_digest(features: DataFrame) -> str:
    """Digest of a run's rows, the same for any order and partitioning: the sum of a 128-bit share of each row's SHA-256 and the count."""
    row = _row_digest()
    r = features.agg(F.count("*").alias("n"), F.sum(_share(row, 1)).alias("a"), F.sum(_share(row, 16)).alias("b")).first()
    return f"{r['n']}-{r['a'] or 0}-{r['b'] or 0}"


def write_run(features: DataFrame, path: str, run_id: str, prefix: str, layer: int, control: str = "none", subset: str = "all") -> list[dict]:
    """K4: features (row_index long, observation_id string, pool string, features array<float>) written once; catalog rows, one per pool.

    Ids must be there and unique in each pool, all pools must hold the same rows, vectors must be finite floats of one width per pool.
    A path that holds anything raises.
    """
    if features.schema["features"].dataType.simpleString() != "array<float>":
        raise ValueError("features must be array<float>")
    v = F.col("features")
    checks = features.groupBy("pool").agg(
        F.count("*").alias("n"), F.count_distinct("observation_id").alias("ids"), F.count_distinct("row_index").alias("indices"), F.count_if(F.coalesce(F.col("observation_id"), F.lit("")) == "").alias("blank"),
        F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high"), F.count_if(v.isNull() | F.exists(v, lambda x: ~is_finite(x))).alias("bad"),
        F.sum(F.xxhash64("row_index", "observation_id").cast("decimal(38,0)")).alias("order"),
    ).collect()
    if not checks:
        raise ValueError("a run needs a pool")
    for c in checks:
        if c["blank"] or c["ids"] != c["n"] or c["indices"] != c["n"]:
            raise ValueError(f"pool {c['pool']}: observation ids and row indices must be unique and not empty")
        if c["bad"] or c["low"] != c["high"] or c["low"] < 1:
            raise ValueError(f"pool {c['pool']}: vectors must be finite and of one width")
    if len({(c["n"], c["order"]) for c in checks}) != 1:
        raise ValueError("all pools must hold the same rows")
    features.write.mode("errorifexists").partitionBy("pool").parquet(path)
    digests = {c["pool"]: content_digest(load_path(features.sparkSession, path).where(F.col("pool") == c["pool"])) for c in checks}
    return [
        {
            "feature_key": f"{prefix}/layer{layer}/{c['pool']}/{control}/{subset}", "run_id": run_id, "pool": c["pool"], "layer": layer, "control": control,
            "subset": subset, "features_path": path, "features_digest": digests[c["pool"]], "rows": c["n"], "dimension": c["low"],
        }
        for c in sorted(checks, key=lambda c: c["pool"])
    ]


def load_path(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row_index long, observation_id string, features array<float>, pool string").parquet(path)


def conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """K5: (kind, value) of incoming keys that are repeated or blank, and of keys and runs that the catalog has."""
    repeated = incoming.groupBy("feature_key").count().where("count > 1 or coalesce(feature_key, '') = ''").select(F.lit("incoming_key").alias("kind"), F.col("feature_key").alias("value"))
    known = lambda c, kind: incoming.select(c).distinct().join(existing, c, "left_semi").select(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    return repeated.unionByName(known("feature_key", "known_key")).unionByName(known("run_id", "known_run"))


def append_catalog(spark: SparkSession, path: str, rows: list[dict] | DataFrame) -> DataFrame:
    """K5: adds rows; any conflict raises and nothing is written. One writer at a time."""
    incoming = rows if isinstance(rows, DataFrame) else spark.createDataFrame([tuple(r[c.split()[0]] for c in CATALOG.split(", ")) for r in rows], CATALOG)
    if incoming.isEmpty():
        raise ValueError("no catalog row was given")
    found = conflicts(read_catalog(spark, path), incoming).limit(10).collect()
    if any(r["kind"] == "incoming_key" for r in found):
        raise ValueError(f"incoming keys must be unique and not empty: {found}")
    if found:
        raise FileExistsError(f"the catalog is append-only: {found}")
    incoming.coalesce(1).write.mode("append").parquet(path)
    return read_catalog(spark, path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(CATALOG).parquet(path)
    return spark.createDataFrame([], CATALOG)


def load_feature(spark: SparkSession, catalog: str, key: str) -> DataFrame:
    """Rows of one feature key, after its digest, count and width are found right."""
    rows = read_catalog(spark, catalog).where(F.col("feature_key") == key).limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"feature key must resolve exactly once: {key}")
    r = rows[0]
    found = load_path(spark, r["features_path"]).where(F.col("pool") == r["pool"])
    if content_digest(found) != r["features_digest"]:
        raise RuntimeError("feature content doesn't match its digest")
    shape = found.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b")).first()
    if (shape["n"], shape["a"], shape["b"]) != (r["rows"], r["dimension"], r["dimension"]):
        raise RuntimeError("feature shape doesn't match the catalog")
    return found


def sanity(spark: SparkSession, catalog: str) -> DataFrame:
    """(feature_key, ok, error) of each key of the catalog: whether its rows are there, as many, as wide and of the digest that the
    catalog says. One plan reads all runs once; a key that stands twice is an error of each."""
    rows = materialize(read_catalog(spark, catalog))
    paths = [r["features_path"] for r in rows.select("features_path").distinct().collect()]  # a row for each run
    seen = None
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            run = load_path(spark, path).withColumn("features_path", F.lit(path))
            seen = run if seen is None else seen.unionByName(run)
    if seen is None:
        found = rows.withColumns({"found": F.lit(None).cast("string"), "n": F.lit(None).cast("long"), "low": F.lit(None).cast("int"), "high": F.lit(None).cast("int")})
    else:
        row, share = _row_digest(), _share
        sums = seen.groupBy("features_path", "pool").agg(
            F.count("*").alias("n"), F.sum(share(row, 1)).alias("a"), F.sum(share(row, 16)).alias("b"), F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high")
        )
        digest = F.concat_ws("-", F.col("n").cast("string"), F.coalesce(F.col("a"), F.lit(0)).cast("string"), F.coalesce(F.col("b"), F.lit(0)).cast("string"))
        found = rows.join(sums.withColumn("found", digest), ["features_path", "pool"], "left")
    times = rows.groupBy("feature_key").agg(F.count("*").alias("times"))
    error = (
        F.when(F.col("times") > 1, "feature key must resolve exactly once")
        .when(F.col("found").isNull(), "no rows")
        .when(F.col("found") != F.col("features_digest"), "feature content doesn't match its digest")
        .when((F.col("n") != F.col("rows")) | (F.col("low") != F.col("dimension")) | (F.col("high") != F.col("dimension")), "feature shape doesn't match the catalog")
    )
    return found.join(times, "feature_key").select("feature_key", error.isNull().alias("ok"), error.alias("error"))


def new_run_id() -> str:
    return uuid.uuid4().hex


def order_hash(ids: Column) -> Column:
    """Digest of an ordered list of ids: SHA-256 of its compact JSON."""
    return F.sha2(F.to_json(ids), 256)
