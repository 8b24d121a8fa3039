"""Detection documents, image files and the training-set writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DETECTION_DOCUMENT = (
    "entry_id string, total_checkboxes_detected int, checkboxes array<struct<det_no:bigint,name:string,state:string,"
    "confidence:double,anchor_text:string,bbox:struct<top:double,left:double,bottom:double,right:double,width:double,height:double>>>"
)


def read_detections(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per checkbox of the nested JSON documents.

    A file is one document, or one a line with ``lines``. The entry is named in the document, else by its parent folder;
    checkboxes are numbered in the document, else by position.
    """
    documents = (
        spark.read.schema(_DETECTION_DOCUMENT).option("multiLine", not lines)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        .withColumn("entry_id", F.coalesce("entry_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))
    )
    return documents.select("entry_id", F.posexplode("checkboxes").alias("_at", "c")).select(
        "entry_id", F.coalesce("c.det_no", "_at").alias("det_no"), "c.name", "c.state", "c.confidence",
        F.when(F.col("c.bbox").isNotNull(), F.struct(
            F.col("c.bbox.top").alias("top"), F.col("c.bbox.left").alias("left"),
            F.col("c.bbox.bottom").alias("bottom"), F.col("c.bbox.right").alias("right"))).alias("box"),
        "c.anchor_text",
    )


def detection_documents(detections: DataFrame, per_document: int = 10_000) -> DataFrame:
    """The nested documents that ``read_detections`` reads back (confidence to 3 digits).

    One for each entry; an entry with detections numbered beyond ``per_document`` has several, so that no document
    grows with it.
    """
    box = F.col("box")
    item = F.struct(
        "det_no", "name", "state", F.round("confidence", 3).alias("confidence"), "anchor_text",
        F.when(box.isNotNull(), F.struct(
            box["top"].alias("top"), box["left"].alias("left"), box["bottom"].alias("bottom"),
            box["right"].alias("right"), (box["right"] - box["left"]).alias("width"),
            (box["bottom"] - box["top"]).alias("height"))).alias("bbox"),
    )
    part = F.floor(F.col("det_no") / per_document).alias("_part")
    return detections.groupBy("entry_id", part).agg(F.array_sort(F.collect_list(item)).alias("checkboxes")).select(
        "entry_id", F.size("checkboxes").alias("total_checkboxes_detected"), "checkboxes")


def write_detections(detections: DataFrame, path: str, folders: int = 64) -> None:
    """Write the documents of all entries, one a line, into a fixed number of folders rather than a file for each."""
    documents = detection_documents(detections)
    documents.withColumn("bucket", F.pmod(F.xxhash64("entry_id"), F.lit(folders))).write.partitionBy("bucket").json(path)


def mime_from_magic(content: Column) -> Column:
    """MIME type from the first bytes: PNG, JPEG, PDF, else octet-stream."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head == "89504E47", F.lit("image/png"))
        .when(F.substring(head, 1, 4) == "FFD8", F.lit("image/jpeg"))
        .when(head == "25504446", F.lit("application/pdf"))
        .otherwise(F.lit("application/octet-stream"))
    )


def describe_images(files: DataFrame) -> DataFrame:
    """Columns (path, content) to the image catalogue; keys look like forms/{year}/{month}/{id}/{file}."""
    key = r"forms/(\d{4})/(\d{1,2})/([^/]+)/[^/]+$"
    part = lambda group: F.regexp_extract("path", key, group)
    return files.select(
        "path",
        F.nullif(part(3), F.lit("")).alias("entry_id"),
        F.md5("content").alias("md5"),
        F.octet_length("content").cast("bigint").alias("length"),
        mime_from_magic(F.col("content")).alias("mime"),
        F.expr(f"try_cast(regexp_extract(path, r'{key}', 1) AS int)").alias("year"),
        F.expr(f"try_cast(regexp_extract(path, r'{key}', 2) AS int)").alias("month"),
    )


def catalog_images(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue the binary files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return describe_images(files)


def export_training_data(export: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the nested training set (see ``reports.training_export``), one folder per template."""
    export.write.mode("overwrite").partitionBy("template_id").format(fmt).save(path)
