"""Sources: workbooks, TIFF pages, stored extractions and gold tables.

Files are read by Spark's binaryFile source, so any store that Spark knows will
do. The name decides before the content is read: select by name first and
Spark prunes the content of the rest.
"""

from __future__ import annotations

import io
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.functions.text import document_id
from docsift.sources import workbooks

EXTRACTION = "doc_id string, field_key string, raw_value string, raw_label string, page int, confidence double, parser string, source_locator string, note string"


def named_files(files: DataFrame) -> DataFrame:
    """(doc_id, path, extension, content) of rows of the binaryFile source; formats are told by extension."""
    return files.select(document_id(F.col("path")).alias("doc_id"), "path", F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("extension"), "content")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The files below a path."""
    return named_files(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def workbook_parts(files: DataFrame) -> DataFrame:
    """Sheets, cells, merged ranges and faults of xlsx and xlsm files, each file read once; also in a stream.

    Spark's binaryFile source leaves out files of no bytes, which the format ``workbook`` gives as errors.
    """

    def read(found):
        for batch in found:
            for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from workbooks.batches(workbooks.parts(io.BytesIO(content or b""), doc), "doc_id")

    return files.where(F.col("extension").isin("xlsx", "xlsm")).select("doc_id", "content").mapInArrow(read, f"doc_id string, {workbooks.PART}")


def workbook_cells(files: DataFrame) -> DataFrame:
    """One row for each non-empty cell of xlsx and xlsm files; a broken file gives none."""
    return workbook_parts(files).where("kind = 'cell'").select("doc_id", "page", "sheet", "row", "col", "value", "is_string")


def workbook_merges(files: DataFrame) -> DataFrame:
    """One row for each merged range."""
    ends = [F.col(a).alias(b) for a, b in (("row", "r0"), ("col", "c0"), ("row_end", "r1"), ("col_end", "c1"))]
    return workbook_parts(files).where("kind = 'merge'").select("doc_id", "page", *ends)


def merged_index(merges: DataFrame) -> DataFrame:
    """Every coordinate of a merged range with its anchor and extent."""
    return merges.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))


def page_texts(cells: DataFrame) -> DataFrame:
    """A sheet's non-empty cells as lines, in row and column order."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "col", "value")))
    return cells.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda c: c["value"]), "\n").alias("text"))


def tiff_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page, width, height) of each frame of TIFF files, by their directory chain; pixels aren't decoded."""

    def frames_of(raw: bytes):
        order = {b"II": "<", b"MM": ">"}.get(raw[:2])
        if not order or len(raw) < 8:
            return
        at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
        while at and at not in seen and at + 2 <= len(raw):
            seen.add(at)
            tags = {}
            n = struct.unpack_from(order + "H", raw, at)[0]
            if at + 6 + 12 * n > len(raw):
                return
            for k in range(n):
                tag, kind, _, value = struct.unpack_from(order + "HHI4s", raw, at + 2 + 12 * k)
                tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
            yield tags.get(256, 0), tags.get(257, 0)
            at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]

    def read(frames):
        for frame in frames:
            rows = [(doc, k, w, h) for doc, raw in zip(frame["doc_id"], frame["content"], strict=True) for k, (w, h) in enumerate(frames_of(bytes(raw)), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "width", "height"])

    return files.where(F.col("extension").isin("tif", "tiff")).select("doc_id", "content").mapInPandas(read, "doc_id string, page int, width int, height int")


def stored_extractions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of extractions; unknown columns are dropped, missing ones are null."""
    return spark.read.schema(EXTRACTION).json(path)


def gold_from_cells(cells: DataFrame, info: dict[int, str], group_row: int = 1, head_row: int = 2) -> DataFrame:
    """Long gold rows from a wide sheet with two header rows: (doc_id, row, group, head, value) and the columns of ``info``.

    ``cells`` has doc_id, row, col, value. Group names in the first header row
    are carried right; rows with one non-empty cell or less are left out.
    """
    heads = cells.where(F.col("row") == head_row).select("doc_id", "col", F.col("value").alias("head"))
    groups = cells.where(F.col("row") == group_row).select("doc_id", "col", F.col("value").alias("group"))
    columns = heads.join(groups, ["doc_id", "col"], "left")
    carried = F.last("group", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0))
    columns = columns.withColumn("group", carried)
    body = cells.where(F.col("row") > head_row).withColumn("filled", F.count("value").over(Window.partitionBy("doc_id", "row"))).where("filled > 1")
    about = body.groupBy("doc_id", "row").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(n) for c, n in info.items()])
    return body.where(~F.col("col").isin(*info)).join(columns, ["doc_id", "col"]).join(about, ["doc_id", "row"]).select("doc_id", "row", *info.values(), "group", "head", "value")


def write_extractions(extractions: DataFrame, path: str) -> None:
    extractions.write.mode("overwrite").partitionBy("parser").parquet(path)


def export_table(records: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Attributes as rows and fields as columns, in the order of ``keys``, for each document.

    A document's attributes are gathered in one group and become rows after it, so rows aren't multiplied before the shuffle.
    """
    at = lambda k: F.first(F.when(F.col("field_key") == k, F.struct(*attributes)), ignorenulls=True)
    wide = records.groupBy("doc_id").agg(*[at(k).alias(f"field{i}") for i, k in enumerate(keys)])
    rows = [F.struct(F.lit(a).alias("attribute"), *[F.col(f"field{i}")[a].alias(k) for i, k in enumerate(keys)]) for a in attributes]
    return wide.select("doc_id", F.inline(F.array(*rows)))
