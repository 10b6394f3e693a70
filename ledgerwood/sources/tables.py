"""Parquet tables, live rows, and the other formats that documents arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lazy relation over one parquet table; columns and predicates reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def live(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    """Rows without a tombstone; a table without the column has none."""
    return df.where(F.col(deleted_at).isNull()) if deleted_at in df.columns else df


PAGE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
RECORD = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("page_count", T.IntegerType()), T.StructField("pages", T.ArrayType(PAGE)),
    T.StructField("clause_index", T.ArrayType(T.StringType())), T.StructField("ocr_method", T.StringType()), T.StructField("uploaded_at", T.StringType()),
])
SECTIONS = T.StructType([T.StructField(s, T.MapType(T.StringType(), RECORD)) for s in ("contracts", "claims")])


def id_map_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of id -> record maps, flattened to a row per document with its section."""
    raw = spark.read.schema(SECTIONS).json(path, multiLine=True)
    parts = [raw.select(F.lit(s).alias("section"), F.explode(s).alias("document_id", "r")) for s in ("contracts", "claims")]
    return parts[0].unionByName(parts[1]).select("section", "document_id", "r.*")


def text_files(spark: SparkSession, path: str, size: int = 3500) -> DataFrame:
    """(path, page_number, text): whole text files, their paragraphs packed into pages of about ``size``."""
    from ..operators.documents import pack_paragraphs

    return pack_paragraphs(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")), "path", size)


def sniffed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, kind): a file's kind by its content first, by its name for text only."""
    raw = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 8))
    name = F.lower("path")
    zipped = F.when(name.endswith(".docx"), "docx").when(name.endswith(".xlsx"), "xlsx").otherwise("zip")
    kind = (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), zipped).when(head.startswith("89504E47"), "png")
        .when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(name.rlike(r"\.(txt|md|csv)$"), "text").otherwise("unknown")
    )
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), kind.alias("kind"))
