"""Tables, COCO documents and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortgeo.functions.boxes import valid_polygons

#: Ids are text: some exceed 64 bits.
COCO = (
    "images array<struct<id:string,file_name:string,width:double,height:double>>, "
    "annotations array<struct<id:string,image_id:string,category_id:string,bbox:array<double>,segmentation:string,isincontact:string,solo_instance_id:string>>, "
    "categories array<struct<id:string>>"
)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix, .parquet or .csv; others raise."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    raise ValueError(f"unsupported table type: {path}")


def read_coco(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Images (of a repeated id the last stands) and annotations with valid polygon components. lines: a document on each line."""
    doc = spark.read.schema(COCO).json(path, multiLine=not lines)
    images = doc.select(F.posexplode("images").alias("pos", "i")).select("pos", "i.*")
    last = Window.partitionBy("id").orderBy(F.desc("pos"))
    images = images.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "pos")
    annotations = doc.select(F.explode("annotations").alias("a")).select("a.*")
    return images, annotations.withColumn("polygons", polygons(F.col("segmentation")))


def polygons(text: Column) -> Column:
    """Valid components of a JSON text, nested lists or one flat list."""
    nested = F.from_json(text, "array<array<double>>")
    flat = F.from_json(text, "array<double>")
    nested = F.when(nested.isNotNull() & ~F.exists(nested, lambda c: c.isNull()), nested)
    return valid_polygons(F.coalesce(nested, F.when(flat.isNotNull() & ~F.exists(flat, lambda c: c.isNull()), F.array(flat)), F.array().cast("array<array<double>>")))


def coco_summary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """S3: one row of counts: images, annotations, categories, annotations without image, bad boxes, bad components and annotations
    that have components but no valid one."""
    doc = spark.read.schema(COCO).json(path, multiLine=not lines)
    images = doc.select(F.explode("images.id").alias("id"))
    a = doc.select(F.explode("annotations").alias("a")).select("a.*")
    raw = F.from_json("segmentation", "array<string>")
    part = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda c: F.from_json(c, "array<double>"))
    bad = lambda c: c.isNull() | (F.size(c) < 6) | (F.size(c) % 2 != 0)
    box = F.coalesce((F.size("bbox") == 4) & (F.col("bbox")[2] > 0) & (F.col("bbox")[3] > 0), F.lit(False))
    counts = a.agg(
        F.count("*").alias("annotations"), F.count_distinct("category_id").alias("categories"), F.count_if(~box).alias("bad_boxes"),
        F.coalesce(F.sum(F.size(F.filter(part, bad))), F.lit(0)).alias("bad_components"),
        F.count_if((F.size(part) > 0) & (F.size(F.filter(part, lambda c: ~bad(c))) == 0)).alias("no_valid_component"),
    )
    lost = a.join(images.distinct(), a.image_id == images.id, "left_anti").agg(F.count("*").alias("missing_images"))
    return images.agg(F.count("*").alias("images")).crossJoin(counts).crossJoin(lost)  # one row each


def read_labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sequence_id, frame, label) of files `sequence.<id>.txt`, a label per line."""
    # A file is one row, so that its lines keep their order; a file is a few hundred lines.
    text = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"sequence\.(\d+)\.txt$", 1).alias("sequence_id"), "value")
    clean = F.regexp_replace("value", r"(\r\n|[\n\r])$", "")
    return text.where(F.length("value") > 0).select("sequence_id", F.posexplode(F.split(clean, r"\r\n|[\n\r]")).alias("frame", "label"))


def metadata_revisions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """First line of each file, counted; an empty one is `<empty>`."""
    first = F.trim(F.split("value", r"\r\n|[\n\r]")[0])
    rows = spark.read.text(paths, wholetext=True).select(F.when(first == "", "<empty>").otherwise(first).alias("revision"))
    return rows.groupBy("revision").agg(F.count("*").alias("files")).orderBy("revision")


def boxes_of(row_box: Column, file_boxes: Column, frames: int) -> Column:
    """The row's own box, else those of its file; exactly `frames` boxes of four numbers, else it raises."""
    boxes = F.coalesce(F.when(row_box.isNotNull(), F.array(row_box)), file_boxes)
    sound = (F.size(boxes) == frames) & F.forall(boxes, lambda b: F.size(b) == 4)
    return F.when(F.coalesce(sound, F.lit(False)), boxes).otherwise(F.raise_error(F.lit(f"{frames} boxes of four numbers are asked for")).cast("array<array<double>>"))


def read_annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, observation_id, boxes_xywh, polygons_by_frame) of annotation files: `{"observations": {id: ...}}`, one object, or a bare
    list of boxes; of the last two the id is null and holds for any observation of the file."""
    one = "struct<boxes_xywh:array<array<double>>,polygons_by_frame:array<array<array<double>>>>"
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    many = F.from_json("value", f"struct<observations:map<string,{one}>>")["observations"]
    parsed = text.select("path", many.alias("many"), F.from_json("value", one).alias("one"), F.from_json("value", "array<array<double>>").alias("bare"), F.ltrim("value").startswith("[").alias("list"))
    named = parsed.where("many is not null").select("path", F.explode("many").alias("observation_id", "a")).select("path", "observation_id", "a.*")
    rest = parsed.where("many is null").select(
        "path", F.lit(None).cast("string").alias("observation_id"), F.when(F.col("list"), F.col("bare")).otherwise(F.col("one.boxes_xywh")).alias("boxes_xywh"), F.when(~F.col("list"), F.col("one.polygons_by_frame")).alias("polygons_by_frame")
    )
    return named.unionByName(rest)
