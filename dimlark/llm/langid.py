"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of hashed byte n-grams (two and three bytes, letters only, lower
case), scaled to length one. Each language has up to ``clusters`` centroids, from spherical
k-means over a bounded sample of its labelled rows; centroids of very few rows are left out. A
text gets the language of the centroid with the highest cosine. Short texts have few n-grams and
so low cosines: a text is rejected when its cosine is below the floor for its number of distinct
n-grams, which the sample gives for each power of two.

Fitting is bounded: at most ``fit_rows`` labelled rows for each language (those with the lowest
hashes of the id), of which only n-gram counts are gathered. Prediction covers every row and
every byte of its text, in one pass without a shuffle.

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected. Without any
training row every text is ``und``. Ties go to the language that sorts first. Repeated rows
are judged alike. Input columns of the same names as the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, hash01, table, written

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of ASCII non-letters become spaces.
ONLY_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: A text is hashed in pieces of so many bytes.
PIECE = 1 << 22
#: Rows whose dense vectors are held at once.
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class LangModel:
    """``centroids[i]`` stands for ``languages[i]``; ``floors[b]``: the least cosine of texts of 2**b distinct n-grams or more."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray


def ngram_counts(text: str, buckets: int) -> np.ndarray:
    """Counts of the hashed 2- and 3-byte n-grams of the lower-cased letters."""
    data = b" ".join(b" %s " % w for w in text.lower().encode("utf-8", "replace").translate(ONLY_LETTERS).split())
    counts = np.zeros(buckets, dtype=np.int64)
    for at in range(0, len(data), PIECE):
        b = np.frombuffer(data[at : at + PIECE + 2], dtype=np.uint8).astype(np.uint32)
        if b.size < 3:
            break
        two = (b[:-2] << np.uint32(8)) | b[1:-1]
        three = (two << np.uint32(8)) | b[2:]
        for grams, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
            counts += np.bincount((grams * np.uint32(salt)) >> np.uint32(32 - int(buckets).bit_length() + 1), minlength=buckets)
    return counts


def unit_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def spherical_kmeans(x: np.ndarray, clusters: int, rounds: int = 12, least: float = 0.01) -> np.ndarray:
    """Centroids of length one, without those that own less than ``least`` of the rows.

    Starts are spread evenly from the most to the least typical row.
    """
    typical = np.argsort(-(x @ x.mean(axis=0)), kind="stable")
    k = min(clusters, len(x))
    centroids = x[typical[[int((i + 0.5) * len(x) / k) for i in range(k)]]].copy()
    for _ in range(rounds):
        owner = np.argmax(x @ centroids.T, axis=1)
        for i in range(k):
            if (mine := x[owner == i]).size:
                mean = mine.mean(axis=0)
                centroids[i] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    owned = np.bincount(np.argmax(x @ centroids.T, axis=1), minlength=k)
    return centroids[owned >= max(1, least * len(x))]


def size_bands(counts: np.ndarray) -> np.ndarray:
    """For each row of counts: the power of two of its distinct n-grams."""
    return np.log2(np.maximum(1, np.count_nonzero(counts, axis=1))).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return at.astype("<i4").tobytes() + counts[at].astype("<i4").tobytes()


def unpacked(rows: list[bytes], buckets: int) -> np.ndarray:
    out = np.zeros((len(rows), buckets), np.int64)
    for i, row in enumerate(rows):
        at, n = np.frombuffer(row, "<i4").reshape(2, -1)
        out[i, at] = n
    return out


def fit(
    train: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    buckets: int = 4096,
    clusters: int = 4,
    fit_rows: int = 1500,
    low: float = 0.01,
    slack: float = 0.6,
) -> LangModel:
    """Fit on at most ``fit_rows`` rows of each language; ``buckets`` is a power of two.

    The floor of a size is ``slack`` times the ``low`` quantile of the cosines of the sample's rows
    of that size with their own language, and no higher than that of larger sizes.
    """
    rows = train.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "langid-sizes")
    empty = LangModel((), np.zeros((0, buckets), np.float32), np.zeros(32), np.ones(buckets, np.float32))
    share = 1.3 * fit_rows / F.col("n") + 20 / F.col("n")
    order = Window.partitionBy("lang").orderBy(hash01(F.col("id")), "id", "version")
    sample = rows.withColumn("version", F.xxhash64("text")).join(sizes, "lang").where(hash01(F.col("id")) <= share)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [packed(ngram_counts(t, buckets)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary())], names=["lang", "id", "version", "grams"])

    kind = rows.schema["id"].dataType.simpleString()
    sample = sample.select("lang", "id", "version", "text").mapInArrow(counted, f"lang string, id {kind}, version long, grams binary")
    sample = written(sample.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fit_rows).select("lang", "id", "version", "grams"), "langid-sample")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(buckets, np.int64), 0
        for pdf in batches:
            for row in pdf["grams"]:
                seen[np.frombuffer(row, "<i4").reshape(2, -1)[0]] += 1
                n += 1
        yield pd.DataFrame({"bucket": np.r_[np.arange(buckets), -1], "n": np.r_[seen, n]})

    df = {r["bucket"]: r["n"] for r in sample.select("grams").mapInPandas(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = df.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + df.get(i, 0))) + 1 for i in range(buckets)], dtype=np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = unpacked(pdf.sort_values(["id", "version"])["grams"].tolist(), buckets)
        counts = counts[counts.any(axis=1)]
        if not len(counts):
            return pd.DataFrame({"lang": [], "centroid": [], "lows": []})
        x, bands = unit_rows(counts, idf), size_bands(counts)
        found = spherical_kmeans(x, clusters)
        cosines = (x @ found.T).max(axis=1)
        lows = [float(np.quantile(cosines[bands == b], low)) if (bands == b).any() else 1.0 for b in range(32)]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(found), "lows": [lows] * len(found)})

    got = sample.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>, lows array<double>").collect()
    got.sort(key=lambda r: (r["lang"], r["centroid"]))
    if not got:
        return empty
    lows = np.min([r["lows"] for r in got], axis=0)
    floors = slack * np.minimum.accumulate(lows[::-1])[::-1]
    return LangModel(tuple(r["lang"] for r in got), np.array([r["centroid"] for r in got], np.float32), floors, idf)


def judge(texts: list[str | None], model: LangModel) -> tuple[list[str], np.ndarray, list[bool]]:
    """Language, cosine and rejection of each text."""
    langs, scores, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [True] * len(texts)
    known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model.languages else []
    for at in range(0, len(known), ROWS_AT_ONCE):
        part = known[at : at + ROWS_AT_ONCE]
        counts = np.stack([ngram_counts(texts[i], len(model.idf)) for i in part])
        cosines = unit_rows(counts, model.idf) @ model.centroids.T
        best, bands = np.argmax(cosines, axis=1), size_bands(counts)
        for i, k, row, band in zip(part, best, cosines, bands, strict=True):
            langs[i], scores[i] = model.languages[k], min(1.0, max(0.0, float(row[k])))
            rejected[i] = bool(scores[i] < model.floors[band])
    return langs, scores, rejected


OUTPUTS = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType()))


def predict(docs: DataFrame, model: LangModel, *, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    names = {n.lower() for n, _ in OUTPUTS}
    kept = docs.select(*[col(c) for c in docs.columns if c.lower() not in names or c == text_col])
    place = kept.columns.index(text_col)
    fields = [f for f in kept.schema.fields if f.name.lower() not in names]
    places = [i for i, f in enumerate(kept.schema.fields) if f.name.lower() not in names]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.centroids, model.floors, model.idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LangModel(*shared.value)
        for batch in batches:
            langs, scores, rejected = judge(batch.column(place).to_pylist(), own)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in places], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*[f.name for f in fields], *[n for n, _ in OUTPUTS]],
            )

    return kept.mapInArrow(run, T.StructType([*fields, *[T.StructField(n, t) for n, t in OUTPUTS]]))


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept out of training; one without an id is not."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
