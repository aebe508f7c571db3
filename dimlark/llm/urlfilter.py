"""URL filters: listed rules first, else naive Bayes over segmented host and path words.

Names such as ``cheappills`` are split by a unigram Viterbi search: the split whose words have
the highest product of probabilities, counted over the words of all pages; an unknown piece
costs more the longer it is. A multinomial naive Bayes model then scores the host's and the
path's words. It learns from all pages: those whose host or path has a seed word count as
blocked, the others as allowed, so words that keep company with the seeds count against a URL.

The dictionary of the splits holds the ``vocabulary`` most frequent words, ties in alphabetical
order, and the seeds: a model of bounded size. The Bayes model is a table with a row for each
feature that any page has, none left out; the features of distinct hosts and paths meet it by a
join, and their log odds are summed.

Cases: a URL that is null or has no ``://`` has an empty host and path and no words, and so the
verdict of the larger class. Equal rules: block wins. Repeated rows are judged alike. Without
blocked pages everything that no rule blocks is allowed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, table, written

#: Words that mark a page as blocked while the model learns.
SEEDS = frozenset("adult ads bets betting bonus casino escort gambling lottery malware nude phishing pills poker porn sex slots spam track tracker viagra warez xxx".split())
#: Fixed values: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ALLOW, BLOCK = "allow", "block"
LETTERS = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")
LONGEST_WORD = 24


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class UrlModel:
    """``words``: log probabilities; ``odds(feature, odds)``: log odds of block for each feature; ``prior`` likewise."""

    words: dict[str, float]
    unknown: float
    odds: DataFrame
    prior: float


def segment(name: str, words: dict[str, float], unknown: float) -> list[str]:
    """The most probable split of a run of letters; an unknown piece costs a tenth for each letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            piece = name[start:end]
            cost = words.get(piece, unknown - math.log(10) * len(piece))
            options.append((best[start][0] + cost, -start))
        score, start = max(options)
        best.append((score, -start))
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


class Segmenter:
    """Words of hosts and paths; splits are remembered within a task, up to a bound."""

    def __init__(self, words: dict[str, float], unknown: float, remembered: int = 100_000):
        self.words, self.unknown, self.remembered, self.seen = words, unknown, remembered, {}

    def __call__(self, text: str) -> list[str]:
        if (known := self.seen.get(text)) is None:
            known = []
            for run in LETTERS.findall(text.lower()):
                known += ["#"] if run[0].isdigit() else segment(run, self.words, self.unknown)
            if len(self.seen) < self.remembered:
                self.seen[text] = known
        return known


def features(host: list[str], path: list[str]) -> list[str]:
    return [f"h:{w}" for w in host] + [f"p:{w}" for w in path]


def most_frequent(counts: DataFrame, most: int) -> list:
    """The ``most`` rows of ``counts(word, n)`` with the largest ``n``, ties by word.

    A histogram of eighths of powers of two tells which steps fit whole; only the step that does
    not is sorted. What comes to the driver is what is kept, and a row for each step.
    """
    counts = written(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "counts")
    steps = sorted((r["step"], r["rows"]) for r in counts.groupBy("step").agg(F.count("*").alias("rows")).collect())
    kept, room = [], most
    for step, rows in reversed(steps):
        if rows > room:
            part = counts.where(F.col("step") == step).orderBy(F.desc("n"), "word").limit(room)
            return counts.where(F.col("step").isin(kept)).collect() + part.collect()
        kept.append(step)
        room -= rows
    return counts.collect()


def word_counts(pages: DataFrame, text_col: str, vocabulary: int) -> dict[str, int]:
    """The most frequent words of all pages, markup left out, and the seeds."""
    plain = F.regexp_replace(F.lower(col(text_col)), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.split(plain, r"[^a-z\x{80}-\x{10ffff}]+")).alias("word")).where((F.length("word") > 1) & (F.length("word") <= LONGEST_WORD))
    counts = {r["word"]: r["n"] for r in most_frequent(words.groupBy("word").agg(F.count("*").alias("n")), vocabulary)}
    least = max(1, sum(counts.values()) // 100_000)
    return counts | {w: max(least, counts.get(w, 0)) for w in SEEDS}


def fit(pages: DataFrame, *, url_col: str = "url", text_col: str = "html", vocabulary: int = 50_000) -> UrlModel:
    counts = word_counts(pages, text_col, vocabulary)
    total = sum(counts.values())
    words, unknown = {w: math.log(n / total) for w, n in counts.items()}, -math.log(total)
    shared = pages.sparkSession.sparkContext.broadcast((words, unknown))
    urls = pages.select(host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = Segmenter(*shared.value), Counter()

        def told() -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_pydict({"blocked": [k[0] for k in keys], "feature": [k[1] for k in keys], "n": [found[k] for k in keys]})

        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, p = split(host), split(path)
                blocked = not SEEDS.isdisjoint(h) or not SEEDS.isdisjoint(p)
                found[blocked, ""] += 1
                found.update((blocked, f) for f in features(h, p))
            if len(found) > 200_000:
                yield told()
                found.clear()
        if found:
            yield told()

    tallies = urls.mapInArrow(run, "blocked boolean, feature string, n long").groupBy("feature").agg(F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
    tallies = written(tallies, "url-tallies")
    own = tallies.where("feature <> ''")
    bad, n, kinds = own.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pages_of = tallies.where("feature = ''").first()
    if not bad:
        return UrlModel(words, unknown, own.limit(0).select("feature", F.lit(0.0).alias("odds")), -1.0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 0.5 * kinds)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad + 0.5 * kinds))
    prior = math.log(pages_of["bad"] + 0.5) - math.log(pages_of["n"] - pages_of["bad"] + 0.5)
    return UrlModel(words, unknown, own.select("feature", odds.alias("odds")), prior)


def rule_index(rules: tuple[tuple[str, str, str], ...]) -> dict[str, list[tuple[str, str]]]:
    """host -> (path, verdict), longest path first, block before allow."""
    index: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        index.setdefault(host, []).append((path, verdict))
    return {h: sorted(x, key=lambda r: (-len(r[0]), r[1] != BLOCK)) for h, x in index.items()}


def ruled(host: str, path: str, index: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    best, at = None, 0
    while at >= 0 and host:
        own = host[at:]
        for start, verdict in index.get(own, ()):
            if path.startswith(start) and (best is None or len(own + start) > len(best[0])):
                best = (own + start, verdict)
                break
        at = host.find(".", at) + 1 or -1
    return best


def judged(pages: DataFrame, model: UrlModel, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``id, host, path, rule, verdict, score`` (log odds of block, to nine places) and ``words`` for each row."""
    shared = pages.sparkSession.sparkContext.broadcast((model.words, model.unknown, rules))
    rows = pages.select(col(id_col).alias("id"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, unknown, listed = shared.value
        split, index = Segmenter(words, unknown), rule_index(listed)
        for batch in batches:
            rule, verdict, told, found = [], [], [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, p = split(host), split(path)
                hit = ruled(host, path, index) or (None, None)
                rule.append(hit[0])
                verdict.append(hit[1])
                told.append(" ".join(h))
                found.append(features(h, p))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(told, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["id", "host", "path", "rule", "listed", "words", "features"])

    kind = rows.schema["id"].dataType.simpleString()
    split = written(rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, listed string, words string, features array<string>").withColumn("key", F.xxhash64("host", "path")), "url-words")
    held = split.select("key", "features").dropDuplicates(["key"]).select("key", F.explode("features").alias("feature"))
    scores = held.join(model.odds, "feature").groupBy("key").agg(F.round(F.sum("odds") + model.prior, 9).alias("score"))
    score = F.coalesce("score", F.lit(model.prior))
    found = split.join(scores, "key", "left").withColumn("score", score)
    return found.select("id", "host", "path", "rule", F.coalesce("listed", F.when(score > 0, BLOCK).otherwise(ALLOW)).alias("verdict"), "score", "words")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = judged(pages, fit(pages))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score", "words")
