"""Page-text sources and dataset sinks.

The input contract starts at page text (PDF decoding is out of scope). Two
page sources:

* whole-text files, one per document, pages separated by form feeds: read
  with ``wholetext`` (one row per file), recursive folder lookup and a glob
  filter, then split into pages with ``posexplode`` (narrow);
* a page table (parquet / JSON lines) with (vendor, file, page_idx, text).

The folder walk reads nested folders correctly (the reference joins nested
names to the root folder and so cannot read them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import GT_SCHEMA, PAGES_SCHEMA
from ..operators.rules import nonempty_guard

c = F.col
PAGE_BREAK = "\f"


def read_text_pages(spark: SparkSession, path: str, vendor: str, glob: str = "*.txt") -> DataFrame:
    """Every file under ``path`` (recursively) matching ``glob``.

    Files not matching the suffix glob are never read (``ineligible_files``
    lists them); an empty vendor tag fails before any job runs."""
    if not vendor:
        raise ValueError("vendor tag is empty")
    raw = (spark.read.option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).text(path, wholetext=True))
    df = raw.select(c("_metadata.file_path").alias("file"), c("value"))
    return df.select(F.lit(vendor).alias("vendor"), "file",
                     F.posexplode_outer(F.split("value", PAGE_BREAK)).alias("page_idx", "text")) \
        .withColumn("page_idx", c("page_idx").cast("int"))


def read_vendor_folders(spark: SparkSession, folders: dict[str, str], glob: str | None = None) -> DataFrame:
    """S4/S5 + P8/P9: one folder per vendor, unioned; pass fewer folders for a
    subset run. Each vendor's file pattern comes from its registry entry
    unless ``glob`` overrides it."""
    from ..operators.vendors import REGISTRY
    out = None
    for vendor, path in folders.items():
        pattern = glob or (REGISTRY[vendor].glob if vendor in REGISTRY else "*.txt")
        df = read_text_pages(spark, path, vendor, pattern)
        out = df if out is None else out.unionByName(df)
    return out


def read_page_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored pages table with the declared schema."""
    reader = spark.read.schema(PAGES_SCHEMA) if fmt == "json" else spark.read
    return reader.format(fmt).load(path).select(*PAGES_SCHEMA.fieldNames())


def write_documents(files: DataFrame, path: str) -> None:
    """A document table: JSON lines (file, text with form-feed page breaks),
    one folder per vendor (``vendor=<tag>/``)."""
    docs = files.select("vendor", "file", F.array_join("pages", PAGE_BREAK).alias("text"))
    docs.write.mode("overwrite").partitionBy("vendor").json(path)


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """S1-S3 over a document table: one folder per vendor, suffix filter, page split.

    ``vendor`` is the partition column of the ``vendor=`` folders, so that an
    extractor's filter on it reads that vendor's folder only."""
    raw = (spark.read.schema("file string, text string, vendor string").option("pathGlobFilter", glob).json(path))
    return raw.select("vendor", "file", F.posexplode_outer(F.split("text", PAGE_BREAK)).alias("page_idx", "text")) \
        .withColumn("page_idx", c("page_idx").cast("int"))


def ineligible_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """S3: quarantine list of the files under ``path`` that the suffix glob leaves out (path, reason)."""
    return list_files(spark, path).join(list_files(spark, path, glob), "path", "left_anti") \
        .withColumn("reason", F.lit("suffix"))


def write_metadata(meta: DataFrame, path: str, only_written_splits: bool = False) -> None:
    """JSON lines (file_name, ground_truth) under split=train / split=validation.

    Overwrite replaces the previous build (no own recursive delete); with
    ``only_written_splits`` only the split folders present in ``meta`` are
    replaced (dynamic partition overwrite). An empty result is refused
    before anything is replaced (V10)."""
    nonempty_guard(meta, "metadata")
    w = meta.select("split", "file_name", "ground_truth").write.mode("overwrite")
    if only_written_splits:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy("split").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The page manifest (src, dest, page_number) as parquet (V10 guard first)."""
    nonempty_guard(manifest, "manifest")
    manifest.write.mode("overwrite").parquet(path)


def read_metadata(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read a split back, parse ground_truth; ``gt_ok`` is true where it holds
    a gt_parse object (V11) and false, never NULL, for everything else."""
    df = spark.read.schema("file_name string, ground_truth string, split string").json(path)
    if split:
        df = df.filter(c("split") == split)  # partition pruning on split=
    return parse_targets(df)


def parse_targets(df: DataFrame) -> DataFrame:
    """Adds ``gt`` (the parsed gt_parse) and ``gt_ok`` to rows with ground_truth."""
    gt = F.from_json("ground_truth", f"gt_parse {GT_SCHEMA.simpleString()}")
    return df.withColumn("gt", gt.getField("gt_parse")).withColumn("gt_ok", holds_object("ground_truth", "gt_parse"))


def holds_object(text: str, field: str) -> Column:
    """Whether a JSON text is an object whose ``field`` is an object, by the types of its
    variant (a string that starts with a brace is a string); false for NULL or broken JSON."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), f"$.{field}", "variant"))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def quarantined_targets(metadata: DataFrame) -> DataFrame:
    """The rows whose ground_truth is no valid target, with the reason."""
    reason = F.when(c("ground_truth").isNull(), F.lit("absent")) \
        .when(F.try_parse_json("ground_truth").isNull(), F.lit("not_json")).otherwise(F.lit("no_gt_parse_object"))
    return metadata.filter(~c("gt_ok")).select("split", "file_name", "ground_truth", reason.alias("reason"))


def plain_path(path: Column) -> Column:
    """A path as listings and manifests share it: no scheme or authority, one slash between names."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", ""), r"/{2,}", "/")


def missing_outputs(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose destination is not in a file listing (left anti join).

    Listings hold URIs; both sides are compared as plain paths. A relative
    destination is looked up under any folder of the listing that ends so."""
    have = listing.select(plain_path(c("path")).alias("_path"))
    rooted = plain_path(c("dest"))
    tail = lambda p: F.substring_index(p, "/", -1)  # the join key; names are unique by page key
    man = manifest.withColumn("_dest", rooted).withColumn("_name", tail(rooted))
    have = have.withColumn("_name", tail(c("_path")))
    same = (man["_name"] == have["_name"]) & ((c("_path") == c("_dest")) | c("_path").endswith(F.concat(F.lit("/"), c("_dest"))))
    return man.join(have, same, "left_anti").drop("_dest", "_name")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A file listing (path only) from the binary-file source; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(path).select("path"))
