"""Evaluation of detectors: tallies, recall and precision, coverage, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tally(dets: DataFrame, key: str = "cls") -> DataFrame:
    """AGG-1: detections for each token."""
    return dets.groupBy(key).agg(F.count("*").alias("n"))


def class_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """AGG-2: ``(image, bucket, cls)`` and ``(image, cls)`` -> tp, fn, fp, recall and precision by bucket and class.

    Classes of an image count once; what a bucket has none of is left out.
    """
    own = truth.select("image", "cls").distinct().withColumn("t", F.lit(True))
    got = found.select("image", "cls").distinct().withColumn("f", F.lit(True))
    both = own.join(got, ["image", "cls"], "full").join(truth.select("image", "bucket").distinct(), "image")
    tp, fn, fp = F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()), F.count_if(F.col("f").isNull()), F.count_if(F.col("t").isNull())
    scores = both.groupBy("bucket", "cls").agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"))
    return scores.withColumns({"recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "precision": F.try_divide("tp", F.col("tp") + F.col("fp"))})


def micro_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """AGG-2: the same over all classes of a bucket, with images and those whose set of classes is right."""
    scores = class_scores(truth, found).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])
    sets = truth.groupBy("image", "bucket").agg(F.sort_array(F.collect_set("cls")).alias("own"))
    got = found.groupBy("image").agg(F.sort_array(F.collect_set("cls")).alias("got"))
    exact = sets.join(got, "image", "left").groupBy("bucket").agg(F.count("*").alias("images"), F.count_if(F.col("own") == F.col("got")).alias("exact"))
    return scores.join(exact, "bucket").withColumns({"recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "precision": F.try_divide("tp", F.col("tp") + F.col("fp"))})


def compared(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``image, bucket, cls, t, f``: each class that an image has or was given, of the images with a truth."""
    own = truth.select("image", "cls").distinct().withColumn("t", F.lit(True))
    got = found.select("image", "cls").distinct().withColumn("f", F.lit(True))
    no = F.lit(False)
    both = own.join(got, ["image", "cls"], "full").join(truth.select("image", "bucket").distinct(), "image")
    return both.select("image", "bucket", "cls", F.coalesce("t", no).alias("t"), F.coalesce("f", no).alias("f"))


def evaluation(truth: DataFrame, found: DataFrame) -> DataFrame:
    """AGG-2 in full: the scores of each bucket's classes, of each bucket, and of all, by one grouping.

    ``level`` ('class', 'bucket' or 'all'), ``bucket`` and ``cls`` (NULL above their level), tp, fn, fp, recall,
    precision; for buckets and all also ``images`` and ``exact``, those whose set of classes is right.
    """
    rows = compared(truth, found)
    # an image's first class tells of the image, so that one grouping counts both
    by_image = rows.groupBy("image").agg(F.min("cls").alias("__first"), F.bool_and(F.col("t") & F.col("f")).alias("__exact"))
    rows = rows.join(by_image, "image").withColumns({"__image": F.col("cls") == F.col("__first"), "__right": (F.col("cls") == F.col("__first")) & F.col("__exact")})
    sums = rows.groupingSets([["bucket", "cls"], ["bucket"], []], "bucket", "cls").agg(
        F.grouping_id().alias("__level"),
        F.count_if(F.col("t") & F.col("f")).alias("tp"),
        F.count_if(~F.col("f")).alias("fn"),
        F.count_if(~F.col("t")).alias("fp"),
        F.count_if("__image").alias("images"),
        F.count_if("__right").alias("exact"),
    )
    level = F.when(F.col("__level") == 0, "class").when(F.col("__level") == 1, "bucket").otherwise("all")
    whole = F.col("__level") > 0
    out = sums.where("tp + fn + fp > 0").withColumns({"level": level, "images": F.when(whole, F.col("images")), "exact": F.when(whole, F.col("exact"))})
    return out.select("level", "bucket", "cls", "tp", "fn", "fp", F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), "images", "exact")


def misses(truth: DataFrame, found: DataFrame) -> DataFrame:
    """AGG-2: images whose set of classes is not right: ``image, bucket, own, got``, sorted."""
    sets = lambda flag: F.sort_array(F.collect_list(F.when(F.col(flag), F.col("cls"))))
    return compared(truth, found).groupBy("image", "bucket").agg(sets("t").alias("own"), sets("f").alias("got")).where("own <> got")


def coverage(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """AGG-3: labels for each class of the list, zeros too."""
    return classes.join(labels.groupBy("cls").agg(F.count("*").alias("n")), "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"))


def word_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-4: ``doc_id, page, ord, text`` before and after: words added and edited on a page."""
    both = after.select("doc_id", "page", "ord", F.col("text").alias("new"), F.lit(True).alias("a")).join(before.select("doc_id", "page", "ord", F.col("text").alias("old"), F.lit(True).alias("b")), ["doc_id", "page", "ord"], "full")
    n_after, n_before = F.count("a"), F.count("b")
    return both.groupBy("doc_id", "page").agg(F.greatest(F.lit(0), n_after - n_before).alias("added"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("new") != F.col("old"))).alias("edited"))


def any_text(pages: DataFrame) -> DataFrame:
    """AGG-8: whether some page of a drawing has text."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.trim("text") != ""), F.lit(False)).alias("any_text"))
