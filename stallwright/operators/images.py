"""Issues of a snapshot's images, from what a health check found out about each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.listing_copy import IMAGE_WORDS

#: Least sizes of any and of the main image, and the least number of images (fixed values).
LEAST_SIDE, LEAST_MAIN_SIDE, LEAST_IMAGES = 200, 500, 3
CLAIM_CONFIDENCE = 0.6
ISSUE = "struct<type:string,severity:string,confidence:double,images:array<int>>"


def _issue(found: Column, type_: str, severity: Column | str, images: Column, confidence: float = 1.0) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(found, F.struct(F.lit(type_).alias("type"), severity.alias("severity"), F.lit(confidence).alias("confidence"), images.alias("images")))


def _groups(images: Column, field: str, type_: str, severity: str) -> Column:
    """An issue for each value of a field that several images have, in the order of the
    first of them."""
    at = lambda h: F.transform(F.filter(images, lambda x: x[field] == h), lambda x: x.image_index)
    values = F.array_distinct(F.filter(F.transform(images, lambda x: x[field]), lambda h: h.isNotNull()))
    return F.filter(F.transform(values, lambda h: _issue(F.size(at(h)) > 1, type_, severity, at(h))), lambda i: i.isNotNull())


def image_issues(images: DataFrame, snapshot: str) -> DataFrame:
    """images(snapshot, image_index, url_hash, content_hash, loaded, width, height, is_main,
    ocr_text) -> (snapshot, type, severity, confidence, images): broken, without a main
    image, too small, a weak main image, too few, repeated by address or by content, and
    risky claims in their text. A snapshot has a bounded number of images."""
    row = F.struct("image_index", "url_hash", F.when(F.col("loaded"), F.col("content_hash")).alias("content_hash"), "loaded", "width", "height", "is_main", "ocr_text")
    one = images.groupBy(snapshot).agg(F.array_sort(F.collect_list(row)).alias("i"))
    every = F.col("i")
    pick = lambda keep: F.transform(F.filter(every, keep), lambda x: x.image_index)
    broken, loaded = pick(lambda x: ~x.loaded), F.size(F.filter(every, lambda x: x.loaded))
    main_broken = pick(lambda x: ~x.loaded & x.is_main)
    small = pick(lambda x: x.loaded & F.coalesce((x.width < LEAST_SIDE) | (x.height < LEAST_SIDE), F.lit(False)))
    main = F.slice(F.filter(every, lambda x: x.is_main), 1, 1)
    weak = F.transform(F.filter(main, lambda x: x.loaded & F.coalesce((x.width < LEAST_MAIN_SIDE) | (x.height < LEAST_MAIN_SIDE), F.lit(False))), lambda x: x.image_index)
    has_main = F.size(main_broken) > 0
    whole = F.array(
        _issue(F.size(broken) > 0, "broken_image_url", F.when(has_main, "critical").otherwise("high"), broken),
        _issue(has_main, "missing_main_image", "critical", main_broken),
        _issue(F.size(small) > 0, "image_low_resolution", "medium", small),
        _issue(F.size(weak) > 0, "weak_main_image", "high", weak),
        _issue(loaded < LEAST_IMAGES, "image_count_low", F.when(loaded == 0, "critical").when(loaded == 1, "high").otherwise("medium"), pick(lambda x: F.lit(True))),
    )
    claims = F.transform(F.filter(every, lambda x: F.coalesce(F.lower(x.ocr_text).rlike(IMAGE_WORDS["claim"]), F.lit(False))), lambda x: _issue(F.lit(True), "forbidden_claims", "medium", F.array(x.image_index), CLAIM_CONFIDENCE))
    found = F.concat(F.array_compact(whole), _groups(every, "url_hash", "duplicate_url", "medium"), _groups(every, "content_hash", "duplicate_content", "low"), claims)
    return one.select(snapshot, F.inline(found))
