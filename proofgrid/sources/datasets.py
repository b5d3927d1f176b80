"""Readers of annotated datasets. Each gives ``samples`` and ``issues``; a bad value becomes an issue, not a failure.

samples: id, file, label, boxes (category, x, y, w, h), contributor, batch, source, sensor, timestamp, split,
declared_digest, width, height. issues: location, message, sample_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.columns import is_unsafe_path, normal_path, safe_text

BOX = "struct<category:string,x:double,y:double,w:double,h:double>"
TEXTS = ("label", "contributor", "batch", "source", "sensor", "timestamp", "split")
COLUMNS = ("id", "file", "label", "boxes", "contributor", "batch", "source", "sensor", "timestamp", "split", "declared_digest", "width", "height")
MOST_BOXES = 512
IMAGE = r"(?i)\.(png|jpe?g|bmp|tiff?|webp)$"


@dataclass(frozen=True)
class Dataset:
    format: str
    samples: DataFrame
    issues: DataFrame

    def classes(self) -> DataFrame:
        """Distinct labels and box categories, sorted."""
        boxes = self.samples.select(F.explode(F.transform("boxes", lambda b: b["category"])).alias("name"))
        return self.samples.select(F.col("label").alias("name")).union(boxes).filter("name IS NOT NULL").distinct().orderBy("name")


def _complete(df: DataFrame) -> DataFrame:
    """All sample columns, absent ones as nulls, and the label of the boxes where none is given and they agree."""
    kinds = {"boxes": f"array<{BOX}>", "width": "double", "height": "double"}
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kinds.get(c, "string")))
    own = F.array_distinct(F.transform("boxes", lambda b: b["category"]))
    df = df.withColumn("boxes", F.coalesce("boxes", F.array().cast(kinds["boxes"])))
    return df.withColumn("label", F.coalesce("label", F.when(F.size(own) == 1, own[0]))).select(*COLUMNS)


def _path(c: Column) -> Column:
    return normal_path(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def _listing(spark: SparkSession, root: str, pattern: str = IMAGE) -> DataFrame:
    """(file): paths below ``root`` that match, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("_metadata.file_path").alias("path"))
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return files.select(_path(F.substring_index("path", f"{base}/", -1)).alias("file")).filter(F.col("file").rlike(pattern))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [(s.getPath().getName(), s.isDirectory()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]


def detect_format(spark: SparkSession, root: str) -> str:
    """manifest, coco, yolo, voc, imagefolder or plain, tried in this order."""
    for names, kind in ((("manifest.jsonl", "manifest.csv"), "manifest"), (("annotations.json", "annotations/instances.json"), "coco"), (("data.yaml",), "yolo"), (("Annotations",), "voc")):
        if any(_exists(spark, f"{root}/{n}") for n in names):
            return kind
    here = _children(spark, root)
    folders = [n for n, is_dir in here if is_dir and not n.startswith(".")]
    return "imagefolder" if len(folders) >= 2 and not any(__import__("re").search(IMAGE, n) for n, d in here if not d) else "plain"


def _issue(df: DataFrame, message: str, location: str = "file", sample: str = "id") -> DataFrame:
    return df.select(F.col(location).cast("string").alias("location"), F.lit(message).alias("message"), F.col(sample).cast("string").alias("sample_id"))


def _as_box(category: Column, numbers: Column) -> Column:
    return F.struct(category.alias("category"), *(numbers[i].alias(n) for i, n in enumerate("xywh"))).cast(BOX)


def _finite(numbers: Column, n: int = 4) -> Column:
    """Four numbers, none of them null, NaN or infinite."""
    return F.coalesce((F.size(numbers) == n) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def manifest(spark: SparkSession, root: str) -> Dataset:
    """manifest.jsonl or manifest.csv. An id that occurs twice is an error."""
    if _exists(spark, f"{root}/manifest.jsonl"):
        raw = spark.read.text(f"{root}/manifest.jsonl").filter(F.trim("value") != "")
        get = lambda k: F.get_json_object("value", f"$.{k}")
        bad = F.json_object_keys("value").isNull()
    else:
        raw = spark.read.option("header", "true").csv(f"{root}/manifest.csv")
        get = lambda k: F.col(k) if k in raw.columns else F.lit(None).cast("string")
        bad = F.lit(False)
    rows = raw.select(F.coalesce(get("file"), get("path"), get("file_name")).alias("file"), get("id").alias("_id"), get("bbox").alias("_bbox"), get("boxes").alias("_boxes"), get("sha256").alias("declared_digest"), get("width").alias("_w"), get("height").alias("_h"), bad.alias("_bad"), *(safe_text(get(c)).alias(c) for c in TEXTS))
    rows = rows.withColumn("file", normal_path(F.col("file"))).withColumn("id", F.coalesce("_id", "file"))
    unsafe = F.col("_bad") | is_unsafe_path(F.col("file"))
    good = rows.filter(~unsafe)
    one = F.transform(F.split(F.regexp_replace("_bbox", r"[\[\]\s]", ""), ","), lambda v: F.try_cast(v, "double")) if hasattr(F, "try_cast") else F.transform(F.split(F.regexp_replace("_bbox", r"[\[\]\s]", ""), ","), lambda v: v.try_cast("double"))
    many = F.from_json("_boxes", "array<struct<category:string,bbox:array<double>>>")
    good = good.withColumn("_one", one)
    boxes = F.when(F.col("_boxes").isNotNull(), F.transform(F.filter(F.slice(many, 1, MOST_BOXES), lambda b: _finite(b["bbox"])), lambda b: _as_box(b["category"], b["bbox"]))).when(F.col("_bbox").isNotNull() & _finite(F.col("_one")), F.array(_as_box(F.col("label"), F.col("_one"))))
    lost = F.when(F.col("_boxes").isNotNull(), F.exists(F.coalesce(many, F.array().cast("array<struct<category:string,bbox:array<double>>>")), lambda b: ~_finite(b["bbox"])) | many.isNull()).otherwise(F.col("_bbox").isNotNull() & ~_finite(F.col("_one")))
    issues = _issue(rows.filter(unsafe), "unreadable row or unsafe path").unionByName(_issue(good.filter(lost), "box is not four finite numbers"))
    twice = good.groupBy("id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids occur twice: {', '.join(str(r.id) for r in twice)}")
    samples = good.withColumn("boxes", boxes).withColumn("width", F.col("_w").try_cast("double")).withColumn("height", F.col("_h").try_cast("double"))
    return Dataset("manifest", _complete(samples), issues)


def coco(spark: SparkSession, root: str, file: str = "annotations.json") -> Dataset:
    """images, annotations and categories of one JSON document. The first of images with the same id counts."""
    schema = "images array<struct<id:string,file_name:string,width:double,height:double,date_captured:string,contributor:string,batch:string,source:string,sensor:string>>, annotations array<struct<image_id:string,category_id:string,bbox:array<double>>>, categories array<struct<id:string,name:string>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(f"{root}/{file}")
    images = doc.select(F.posexplode("images").alias("n", "i")).select("n", "i.*")
    first = images.groupBy("id").agg(F.min("n").alias("n"))
    kept = images.join(first, ["id", "n"])
    categories = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    notes = doc.select(F.posexplode("annotations").alias("n", "a")).select("n", "a.*").join(categories, "category_id", "left").join(kept.select(F.col("id").alias("image_id"), F.lit(True).alias("known")), "image_id", "left")
    good = F.col("known") & F.col("category").isNotNull() & _finite(F.col("bbox"))
    boxes = notes.filter(good).groupBy(F.col("image_id").alias("id")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("n", _as_box(F.col("category"), F.col("bbox")).alias("box")))), 1, MOST_BOXES), lambda x: x["box"]).alias("boxes"))
    samples = kept.withColumnRenamed("file_name", "file").withColumnRenamed("date_captured", "timestamp").join(boxes, "id", "left")
    issues = (
        _issue(images.join(first, ["id", "n"], "left_anti"), "image id occurs twice", "file_name")
        .unionByName(_issue(notes.filter("known IS NULL"), "annotation of an unknown image", "n", "image_id"))
        .unionByName(_issue(notes.filter("known AND category IS NULL"), "annotation of an unknown category", "n", "image_id"))
        .unionByName(_issue(notes.filter(F.col("known") & F.col("category").isNotNull() & ~_finite(F.col("bbox"))), "box is not four finite numbers", "n", "image_id"))
    )
    return Dataset("coco", _complete(samples), issues)


def yolo_to_pixels(boxes: str, width: str, height: str) -> Column:
    """Boxes of relative centres and sizes as pixels from the top left."""
    w, h = F.col(width), F.col(height)
    return F.transform(boxes, lambda b: F.struct(b["category"].alias("category"), ((b["x"] - b["w"] / 2) * w).alias("x"), ((b["y"] - b["h"] / 2) * h).alias("y"), (b["w"] * w).alias("w"), (b["h"] * h).alias("h")))


def yolo(spark: SparkSession, root: str) -> Dataset:
    """labels/**.txt beside images/**; boxes stay relative until `yolo_to_pixels`."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(f"{root}/data.yaml").collect())
    names = yaml.safe_load(text).get("names", [])
    names = [names[k] for k in sorted(names)] if isinstance(names, dict) else list(names)
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{root}/labels").select(F.col("_metadata.file_path").alias("path"), "value")
    stem = F.regexp_replace(_path(F.substring_index("path", "/labels/", -1)), r"\.txt$", "")
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value") != "").select(stem.alias("stem"), F.transform(parts, lambda v: v.try_cast("double")).alias("v"))
    cls = F.col("v")[0]
    good = _finite(F.col("v"), 5) & (cls >= 0) & (cls < len(names))
    category = F.element_at(F.array(*map(F.lit, names)), F.least(cls, F.lit(len(names) - 1)).cast("int") + 1)
    boxes = rows.filter(good).groupBy("stem").agg(F.slice(F.collect_list(_as_box(category, F.slice("v", 2, 4))), 1, MOST_BOXES).alias("boxes"))
    images = _listing(spark, f"{root}/images").withColumn("stem", F.regexp_replace("file", r"\.[^.]+$", ""))
    split = F.when(F.contains("file", F.lit("/")), F.substring_index("file", "/", 1))
    samples = images.join(boxes, "stem", "left").withColumn("id", F.col("file")).withColumn("split", split)
    return Dataset("yolo", _complete(samples), _issue(rows.filter(~good), "label row is malformed", "stem", "stem"))


def voc(spark: SparkSession, root: str) -> Dataset:
    """Annotations/*.xml, one annotation each."""
    schema = "filename string, size struct<width:double,height:double>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>, _corrupt_record string"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").load(f"{root}/Annotations")
    bad = F.col("filename").isNull() | F.col("_corrupt_record").isNotNull()
    corners = lambda o: F.array(o["bndbox"]["xmin"], o["bndbox"]["ymin"], o["bndbox"]["xmax"] - o["bndbox"]["xmin"], o["bndbox"]["ymax"] - o["bndbox"]["ymin"])
    good = rows.filter(~bad).withColumn("file", normal_path(F.col("filename"))).withColumn("id", F.col("file"))
    boxes = F.transform(F.filter(F.slice("object", 1, MOST_BOXES), lambda o: _finite(corners(o))), lambda o: _as_box(o["name"], corners(o)))
    samples = good.select("id", "file", boxes.alias("boxes"), F.col("size.width").alias("width"), F.col("size.height").alias("height"))
    lost = good.filter(F.exists("object", lambda o: ~_finite(corners(o))))
    issues = _issue(rows.filter(bad).withColumn("id", F.col("filename")), "annotation is malformed", "filename").unionByName(_issue(lost, "box is not four finite numbers"))
    return Dataset("voc", _complete(samples), issues)


def imagefolder(spark: SparkSession, root: str) -> Dataset:
    files = _listing(spark, root).filter(F.contains("file", F.lit("/")))
    samples = files.withColumn("id", F.col("file")).withColumn("label", F.substring_index("file", "/", 1))
    return Dataset("imagefolder", _complete(samples), _issue(samples.limit(0), ""))


def plain(spark: SparkSession, root: str) -> Dataset:
    samples = _listing(spark, root).withColumn("id", F.col("file"))
    return Dataset("plain", _complete(samples), _issue(samples.limit(0), ""))


def join_sidecar(ds: Dataset, sidecar: DataFrame) -> Dataset:
    """Non-empty values of a metadata table (file, contributor, batch, source, sensor, timestamp) replace the samples'.
    Rows that match no sample become issues; a manifest brings its own metadata."""
    if ds.format == "manifest":
        return ds
    fields = [c for c in ("contributor", "batch", "source", "sensor", "timestamp") if c in sidecar.columns]
    side = sidecar.select(normal_path(F.col("file")).alias("file"), *(F.nullif(F.trim(c), F.lit("")).alias(f"_{c}") for c in fields)).dropDuplicates(["file"])
    out = ds.samples.join(side, "file", "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    lost = _issue(side.join(ds.samples, "file", "left_anti").withColumn("id", F.lit(None).cast("string")), "metadata of no sample")
    return Dataset(ds.format, out.select(*COLUMNS), ds.issues.unionByName(lost))


READERS = {"manifest": manifest, "coco": coco, "yolo": yolo, "voc": voc, "imagefolder": imagefolder, "plain": plain}


def open_dataset(spark: SparkSession, root: str) -> Dataset:
    """The reader that `detect_format` names, with metadata.csv joined if there is one. An empty dataset is an error."""
    ds = READERS[detect_format(spark, root)](spark, root.rstrip("/"))
    if _exists(spark, f"{root}/metadata.csv"):
        ds = join_sidecar(ds, spark.read.option("header", "true").csv(f"{root}/metadata.csv"))
    if ds.samples.isEmpty():
        raise ValueError(f"no samples below {root}")
    return ds


def index_files(spark: SparkSession, ds: Dataset, root: str) -> DataFrame:
    """Samples with digest, size_bytes and error_kind (missing, unsafe or null); files that are missing keep their row."""
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(_path(F.substring_index("path", f"{base}/", -1)).alias("file"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.col("length").alias("size_bytes"))
    out = ds.samples.join(files, "file", "left")
    return out.withColumn("error_kind", F.when(is_unsafe_path(F.col("file")), "unsafe").when(F.col("digest").isNull(), "missing"))


def dataset_digest(samples: DataFrame) -> DataFrame:
    """(n, digest): a digest of all rows, from row digests in 65,536 buckets by their own prefix, ordered by id in each."""
    row = F.sha2(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}), 256)
    blocks = samples.select("id", row.alias("d")).groupBy(F.substring("d", 1, 4).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("id", "d"))), lambda x: x["d"])), 256).alias("d"))
    return blocks.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])), 256).alias("digest"))
