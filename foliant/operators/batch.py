"""Admission of files and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes of admitted files.
PDF, IMAGES, OFFICE = ["pdf"], ["png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp"], ["docx", "pptx", "xlsx", "odt", "odp", "ods", "csv"]
#: Limits of a file and of a batch.
MOST_BYTES, MOST_PAGES, MOST_CANVAS, MOST_PIXELS = 200 << 20, 500, 4_000_000, 40_000_000
BATCH_FILES, BATCH_BYTES, BATCH_WORKERS = 20, 1 << 30, 6
#: Strategies that call a model with a key, and messages before a batch starts.
AI_STRATEGIES = ("ai", "docling_ai", "pdf_inspector_ai")
NO_ENGINE, TOO_MANY, TOO_LARGE = "Choose one processing engine.", "Choose no more than {} files.", "Combined upload size exceeds 1 GiB."
PDF_ONLY, NO_VISION = "PDF Inspector strategies accept PDF files only.", "Choose a vision-capable Ollama model."
#: Media types of office files.
OFFICE_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "odt": "application/vnd.oasis.opendocument.text",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "csv": "text/csv",
}


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))


def media_type(ext: Column) -> Column:
    out = F.when(ext.isin(PDF), "application/pdf").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("tif", "tiff"), "image/tiff").when(ext.isin(IMAGES), F.concat(F.lit("image/"), ext))
    for e, t in OFFICE_TYPES.items():
        out = out.when(ext == e, t)
    return out


def admitted(files: DataFrame, most_bytes: int = MOST_BYTES, most_pages: int = MOST_PAGES) -> DataFrame:
    """Files with ``error`` (the first guard that they fail, or null), ``mime_type`` and ``pages``.

    ``files``: ``filename, size`` and, as far as a reader found them, ``encrypted, page_count, canvas_area, pixels, readable``."""
    ext = suffix(F.col("filename"))
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in files.columns else F.lit(default)
    pdf, image, office = ext.isin(PDF), ext.isin(IMAGES), ext.isin(OFFICE)
    pages = F.when(office, 1).otherwise(has("page_count", 1))
    error = (
        F.when(F.col("size") > most_bytes, "too_large").when(pdf & ~has("readable", True), "invalid_pdf").when(pdf & has("encrypted", False), "encrypted_pdf").when(pdf & (pages < 1), "empty_document")
        .when(pdf & (has("canvas_area", 0.0) > MOST_CANVAS), "canvas_too_large").when((pdf | image) & (pages > most_pages), "too_many_pages").when(~(pdf | image | office), "unsupported_type")
        .when(image & (has("pixels", 0) > MOST_PIXELS), "image_too_large").when(image & ~has("readable", True), "invalid_image")
    )
    return files.withColumns({"error": error, "mime_type": F.when(error.isNull(), media_type(ext)), "pages": F.when(error.isNull(), pages)})


def selected_pages(docs: DataFrame) -> DataFrame:
    """``doc_id, page`` of each selected page; a range out of order or beyond the document selects none."""
    last = F.coalesce("last_page", "page_count")
    good = docs.where((F.col("first_page") >= 1) & (F.col("first_page") <= last) & (last <= F.col("page_count")))
    return good.select("doc_id", F.explode(F.sequence(F.col("first_page").cast("int"), last.cast("int"))).alias("page"))


def file_id(index: Column, name: Column, data: Column) -> Column:
    """Deterministic id of an uploaded file."""
    return F.concat(index.cast("string"), F.lit("-"), F.substring(F.sha2(F.concat(F.encode(name, "utf-8"), F.unhex(F.lit("00")), data), 256), 1, 16))


def batch_violations(files: DataFrame) -> DataFrame:
    """Batches with too many files or bytes."""
    g = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return g.withColumn("violation", F.when(F.col("files") > BATCH_FILES, "too many files").when(F.col("bytes") > BATCH_BYTES, "too many bytes")).where("violation is not null")


def preflight(batches: DataFrame, files: DataFrame) -> DataFrame:
    """``batch_id, message``: everything that keeps a batch from starting.

    ``batches``: ``batch_id, engine, strategy, key_name`` (the key that the model needs), ``has_key, local_ready``; ``files``: ``batch_id, filename, size`` and ``error``, what
    admission found (null for files that it can't read yet)."""
    ext = suffix(F.col("filename"))
    g = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(ext != "pdf").alias("others"))
    b = batches.join(g, "batch_id", "left")
    ai = F.col("strategy").isin(*AI_STRATEGIES)
    said = F.array(
        F.when(F.col("engine").isNull(), NO_ENGINE), F.when(F.col("files") > BATCH_FILES, F.lit(TOO_MANY.format(BATCH_FILES))), F.when(F.col("bytes") > BATCH_BYTES, TOO_LARGE),
        F.when(F.col("strategy").startswith("pdf_inspector") & (F.col("others") > 0), PDF_ONLY), F.when(F.col("engine").isNotNull() & ai & ~F.col("has_key"), F.concat("key_name", F.lit(" is required."))),
        F.when((F.col("engine") == "ollama") & ~F.col("local_ready"), NO_VISION),
    )
    own = b.select("batch_id", F.explode(F.array_compact(said)).alias("message"))
    return own.unionByName(files.where("error is not null").select("batch_id", F.concat("filename", F.lit(": "), "error").alias("message")))


def workers(files: Column, most: int = BATCH_WORKERS) -> Column:
    """How many files of a batch are worked on at once."""
    return F.least(F.greatest(files, F.lit(1)), F.lit(most))


def outcomes(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Every request with its result or error, in the order asked (Q9)."""
    met = requests.join(results, "file_id", "left")
    return met.withColumn("status", F.when(F.col("error").isNotNull() | F.col("result").isNull(), "failed").otherwise("completed")).orderBy("seq")


def progress(events: DataFrame, keys: list[str], order: list[str], done: Column, total: Column, files_done: Column | None = None, files: Column | None = None) -> DataFrame:
    """Percent done, never falling: 5 to 90 over pages, then to 99 over files."""
    value = 5 + F.bround(85.0 * done / F.greatest(total, F.lit(1)))
    if files_done is not None and files is not None:
        value = F.when(done >= total, 90 + F.bround(9.0 * files_done / F.greatest(files, F.lit(1)))).otherwise(value)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("percent", F.max(value.cast("int")).over(w))


def integrity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected files with whether they exist and their hash or size holds."""
    met = expected.join(actual.withColumnsRenamed({"sha256": "found_sha256", "size": "found_size"}), "path", "left")
    return met.withColumn("state", F.when(F.col("found_sha256").isNull(), "missing").when(~F.col("found_sha256").eqNullSafe(F.col("sha256")) | ~F.col("found_size").eqNullSafe(F.col("size")), "differs").otherwise("verified"))
