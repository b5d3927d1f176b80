"""Index of image files, over files that Spark makes of documents: JPEG with EXIF, BMP, and broken or refused ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query
from proofgrid.sources import images as im

_SOFTWARE = "CASE doc_id % 3 WHEN 0 THEN 'Adobe Photoshop 25' WHEN 1 THEN 'Camera ' || coalesce(source, 'x') ELSE 'gimp 2.10' END"
_WIDTH, _HEIGHT = "(1 + doc_id % 3000)", "(1 + coalesce(n_chars, 0) % 2000)"


def _files(spark, d):
    """Eight kinds of files by id: 0 to 3 JPEG, 4 BMP, 5 JPEG cut off, 6 SVG, 7 JPEG beyond the limit of a side."""
    docs = b.read(spark, d, "documents").select("doc_id", F.col("source").alias("contributor"), F.expr(_SOFTWARE).alias("sw"), F.expr(_WIDTH).alias("w"), F.expr(_HEIGHT).alias("h"))
    wide = lambda x, n: F.lpad(F.hex(x), n, "0")
    kind, n = F.col("doc_id") % 8, F.octet_length("sw") + 1
    little = lambda x: F.concat(F.substring(wide(x, 8), 7, 2), F.substring(wide(x, 8), 5, 2), F.substring(wide(x, 8), 3, 2), F.substring(wide(x, 8), 1, 2))
    tags = F.concat(F.lit("49492A0008000000" + "0100" + "31010200"), little(n), F.lit("1A000000" + "00000000"), F.hex("sw"), F.lit("00"))
    app = F.concat(F.lit("FFE1"), wide(n + 34, 4), F.lit("457869660000"), tags)
    table = "FFDB004300" + "".join(f"{x:02X}" for x in [16] * 64)
    side = F.when(kind == 7, F.lit(20_000)).otherwise(F.col("w"))
    frame = F.concat(F.lit("FFC0001108"), wide(F.col("h"), 4), wide(side, 4), F.lit("03011100021101031101"))
    scan = F.when(kind == 5, "FFDA000C03010002110311003F0012").otherwise("FFDA000C03010002110311003F0012FFD9")
    bitmap = F.concat(F.lit("424D1A00000000000000" + "1A000000" + "28000000"), little(F.col("w")), little(F.col("h")))
    body = F.when(kind == 4, F.unhex(bitmap)).when(kind == 6, F.encode(F.lit("<?xml version='1.0'?><svg/>"), "utf-8")).otherwise(F.unhex(F.concat(F.lit("FFD8"), app, F.lit(table), frame, scan)))
    return docs.select("doc_id", "contributor", body.alias("content"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 8 = 6 THEN NULL WHEN doc_id % 8 = 4 THEN 'BMP' ELSE 'JPEG' END AS format, CASE WHEN doc_id % 8 < 5 THEN {_WIDTH} END::BIGINT AS width, CASE WHEN doc_id % 8 < 5 THEN {_HEIGHT} END::BIGINT AS height,
  CASE WHEN doc_id % 8 < 4 THEN 86 END::INT AS jpeg_quality, CASE WHEN doc_id % 8 < 4 THEN {_SOFTWARE} END AS software, CASE doc_id % 8 WHEN 5 THEN 'unreadable' WHEN 6 THEN 'unsafe' WHEN 7 THEN 'unsafe' END AS error_kind FROM documents""")
def image_index(spark, d):
    out = im.probe(_files(spark, d))
    return out.select("doc_id", "format", "width", "height", "jpeg_quality", F.element_at("exif", "Software").alias("software"), "error_kind")


@query("SELECT source AS contributor, count(*) AS n FROM documents WHERE doc_id % 8 < 4 AND doc_id % 3 <> 1 GROUP BY 1")
def exif_editing_software(spark, d):
    return im.edited(im.probe(_files(spark, d))).groupBy("contributor").agg(F.count("*").alias("n"))
