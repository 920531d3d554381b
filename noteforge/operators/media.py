"""Media as rows: similarity of pixels, scanned documents, sizes after a resize, samples of pages, savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def ssim(pixels: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Global structural similarity of x and y by key: a closed form over means, variances and a covariance, which one
    aggregation gives."""
    m = pixels.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    value = (2 * F.col("mx") * F.col("my") + C1) * (2 * F.col("c") + C2) / ((F.col("mx") ** 2 + F.col("my") ** 2 + C1) * (F.col("vx") + F.col("vy") + C2))
    return m.select(*keys, F.round(value, 9).alias("ssim"))


def sampled_pages(pages: DataFrame) -> DataFrame:
    """First, middle and last page of each document (pdf, page, n_pages)."""
    p, n = F.col("page"), F.col("n_pages")
    return pages.where((p == 0) | (p == n - 1) | ((n > 2) & (p == F.floor(n / 2))))


def quality(scores: DataFrame, threshold: float = 0.92, failed: str | None = None, at: list[str] | None = None) -> DataFrame:
    """Mean similarity of each document's sampled pages and whether it passes; 1 and true where no page could be
    compared (null scores). failed: a column that tells that the check itself failed; such a document has 0 and false.
    at: columns that order a document's pages, which are few; doubles are then added in that order and not as tasks come
    by, since a mean next to the threshold may fall to either side."""
    broken = F.bool_or(F.coalesce(F.col(failed), F.lit(False))) if failed else F.lit(False)
    known = F.filter(F.array_sort(F.collect_list(F.struct(*at, "ssim"))), lambda p: p["ssim"].isNotNull()) if at else None
    mean = F.avg("ssim") if known is None else F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, p: s + p["ssim"]), F.size(known))
    by = scores.groupBy("pdf").agg(F.when(broken, 0.0).otherwise(F.coalesce(mean, F.lit(1.0))).alias("ssim"))
    return by.withColumn("passed", F.col("ssim") >= threshold)


def compression_totals(files: DataFrame, results: DataFrame, threshold_kb: float, threshold: float = 0.92) -> DataFrame:
    """One row: documents (pdf, size), those above the threshold, and of these, by results (pdf, compressed, ssim; a pdf
    once), those compressed, rejected for their quality, and failed, with the megabytes saved. Failed are all that aren't
    compressed, the rejected among them; a null ssim is a failed check, which rejects."""
    large = F.col("size") > F.lit(threshold_kb * 1024)
    rows = files.where(large).join(results, "pdf", "left")
    smaller = F.coalesce(F.col("compressed") < F.col("size"), F.lit(False))
    good = F.coalesce(F.col("ssim"), F.lit(0.0)) >= threshold
    saved = F.coalesce(F.sum(F.when(smaller & good, F.col("size") - F.col("compressed"))), F.lit(0)) / F.lit(1024.0 * 1024.0)
    one = rows.agg(F.count("*").alias("large_pdfs_found"), F.count_if(smaller & good).alias("pdfs_compressed"), F.count_if(smaller & ~good).alias("quality_rejected"), F.count_if(~(smaller & good)).alias("compression_failed"), F.round(saved, 9).alias("space_saved_mb"))
    return files.agg(F.count("*").alias("pdfs_scanned")).crossJoin(F.broadcast(one))


def scanned(pages: DataFrame) -> DataFrame:
    """Whether documents are scans, by characters and images a page: of all pages up to 20, else of the first and last 10."""
    p, n = F.col("page"), F.col("n_pages")
    by = pages.where((n <= 20) | (p < 10) | (p >= n - 10)).groupBy("pdf").agg(F.avg("text_len").alias("text"), F.avg("n_images").alias("images"))
    ratio = F.col("images") / (F.col("text") + 1)
    t, i = F.col("text"), F.col("images")
    return by.select("pdf", F.round("text", 6).alias("avg_text"), F.round("images", 6).alias("avg_images"), F.round(ratio, 9).alias("ratio"), (((t < 200) & (i >= 0.5)) | ((i >= 0.8) & (t < 300)) | ((i > 0) & (ratio > 0.005))).alias("is_scanned"))


def encoder_settings(is_scanned: Column) -> list[Column]:
    return [F.when(is_scanned, 120).otherwise(150).alias("dpi"), F.when(is_scanned, 60).otherwise(50).alias("quality"), F.when(is_scanned, 1600).otherwise(1024).alias("longest"), is_scanned.alias("grayscale")]


def resized(width: Column, height: Column, longest: int = 1440) -> tuple[Column, Column]:
    """Width and height with the longer side (the height of squares) cut to longest, the other truncated."""
    wide, most = width > height, F.lit(float(longest))
    w = F.when(wide & (width > longest), F.lit(longest)).when(~wide & (height > longest), (width * (most / height)).cast("int")).otherwise(width)
    h = F.when(wide & (width > longest), (height * (most / width)).cast("int")).when(~wide & (height > longest), F.lit(longest)).otherwise(height)
    return w, h


#: Pixels of an image that its colours are judged by.
SAMPLED_PIXELS = 1000


def sampled_pixels(pixels: DataFrame, keys: list[str], at: str, n: int = SAMPLED_PIXELS) -> DataFrame:
    """n pixels of each image, or all, by the smallest hashes of `at`, which tells an image's pixels apart: a uniform
    sample, the same each time. Each task keeps its n smallest of an image before anything is shuffled (Spark's limit
    inside a window's groups), so a large image moves n pixels for each task."""
    key = F.conv(F.left(F.md5(F.col(at).cast("string")), F.lit(15)), 16, 10).cast("long")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(key, at))
    return pixels.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def is_gray(pixels: DataFrame, keys: list[str], at: str | None = None) -> DataFrame:
    """Mean difference of the channels r, g, b below 30; of sampled_pixels() if `at` is given."""
    spread = F.abs(F.col("r") - F.col("g")) + F.abs(F.col("g") - F.col("b")) + F.abs(F.col("r") - F.col("b"))
    pixels = sampled_pixels(pixels, keys, at) if at else pixels
    return pixels.groupBy(*keys).agg(F.round(F.sum(spread) / (3 * F.count("*")), 9).alias("variance")).withColumn("is_gray", F.col("variance") < 30)


def transparent(pixels: DataFrame, keys: list[str], at: str, alpha: str, step: int = 100) -> DataFrame:
    """Whether an image has a pixel that is not opaque: among every step-th (at, from 0) of images of more pixels than
    that, among all of others."""
    clear = F.col(alpha) < 255
    by = pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(clear).alias("any"), F.bool_or(clear & (F.col(at) % step == 0)).alias("some"))
    return by.select(*keys, F.when(F.col("n") > step, F.col("some")).otherwise(F.col("any")).alias("transparent"))


#: What an image is written as, by its extension.
FORMATS = {"jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "webp": "WEBP", "bmp": "JPEG", "tiff": "JPEG", "tif": "JPEG", "heic": "JPEG", "heif": "JPEG", "gif": "GIF"}


def target_format(ext: Column) -> Column:
    keys, values = F.lit(list(FORMATS)), F.lit(list(FORMATS.values()))
    return F.when(F.array_contains(keys, ext), F.element_at(values, F.array_position(keys, ext).cast("int")))


def savings(results: DataFrame) -> DataFrame:
    """One row: files, those that got smaller, bytes saved, and the ratio in percent."""
    better = F.col("compressed") < F.col("original")
    sums = results.agg(F.count("*").alias("files"), F.count_if(better).alias("compressed_files"), F.count_if(~better).alias("kept_files"), F.coalesce(F.sum(F.when(better, F.col("original") - F.col("compressed"))), F.lit(0)).alias("saved"), F.coalesce(F.sum("original"), F.lit(0)).alias("original"))
    return sums.withColumn("saved_pct", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("saved"), F.col("original")), F.lit(0.0)), 6)).drop("original")


def transcription_totals(files: DataFrame) -> DataFrame:
    """Audio files, megabytes, and seconds to transcribe them at two for a megabyte."""
    mb = F.coalesce(F.sum("size"), F.lit(0)) / F.lit(1024.0 * 1024.0)
    return files.agg(F.count("*").alias("files"), F.round(mb, 9).alias("megabytes"), F.round(2 * mb, 9).alias("eta_seconds"))
