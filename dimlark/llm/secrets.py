"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: an AND of clauses, each
an OR of alternatives, each an AND of trigrams that any match must hold (in lower case). The
index has a posting (trigram, document) for the trigrams that the rules ask for. Postings are
intersected by document, the queries choose candidates, and a rule's expression runs over its
candidates' whole texts only. Rules without a mandatory trigram, such as hex strings, run
over every text.

A posting's document is a hash of its id, so a collision or a repeated id only adds a
candidate, which is then verified. Texts stay where they are read: the candidates, a number and
a bit mask each, go to them by broadcast as long as there are ``BROADCAST_CANDIDATES`` at most;
only beyond that are texts shuffled to meet them. Spans are [start, end) in code points.

Cases: a null text is an empty one and has no spans. Null ids are scanned like others. Matches
of one kind never overlap; spans of several kinds may, and order by start, then by rule. A
column ``spans`` of the input is replaced. Very many matches in one text cost their number to
the power of one and a half at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, table, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java's syntax; a match counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order in which they are listed, then the added ones.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Clauses of alternatives of trigrams.
Query = list[list[frozenset[str]]]
#: So many literal strings are followed side by side.
STRINGS = 64
#: Candidates of 16 bytes that are broadcast, some 100 MB as Spark's hashed relation.
BROADCAST_CANDIDATES = 2_000_000
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def trigram_query(pattern: str) -> Query:
    """The clauses that every match of ``pattern`` meets, on lower-cased text; none: scan fully."""
    from re import _parser as parser

    clauses: Query = []

    def close(strings: set[str]) -> set[str]:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((a for a in sets if not any(b < a for b in sets)), key=sorted))
        return {""}

    def literals(node) -> set[str] | None:
        """All strings that the node matches, if they are few."""
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN" and all(str(x[0]) in ("LITERAL", "RANGE") for x in arg):
            found = {chr(c).lower() for x in arg for c in ([x[1]] if str(x[0]) == "LITERAL" else range(x[1][0], x[1][1] + 1))}
            return found if len(found) <= 4 else None
        if op == "SUBPATTERN":
            return sequence(arg[3])
        if op == "BRANCH":
            each = [sequence(x) for x in arg[1]]
            return None if any(x is None for x in each) else set().union(*each)
        if op == "MAX_REPEAT" and arg[1] == 1 and (inner := sequence(arg[2])) is not None:
            return inner | {""} if arg[0] == 0 else inner
        return {""} if op == "AT" else None

    def sequence(nodes) -> set[str] | None:
        strings = {""}
        for node in nodes:
            more = literals(node)
            if more is None or len(strings) * len(more) > STRINGS:
                return None
            strings = {a + b for a, b in product(strings, more)}
        return strings

    strings = {""}
    for node in parser.parse(pattern):
        more = literals(node)
        if more is None or len(strings) * len(more) > STRINGS:
            strings = close(strings)
            continue
        strings = {a + b for a, b in product(strings, more)}
    close(strings)
    return clauses


def holds(query: Query, grams: Column) -> Column:
    """Whether an array of trigrams meets the query."""
    met = F.lit(True)
    for clause in query:
        any_of = F.lit(False)
        for alternative in clause:
            all_of = F.lit(True)
            for gram in sorted(alternative):
                all_of &= F.array_contains(grams, gram)
            any_of |= all_of
        met &= any_of
    return met


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """``docs(doc, text)`` -> ``(gram, doc)`` for each of ``grams`` that a text holds."""
    low = docs.select("doc", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select(F.explode(found).alias("gram"), "doc")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it: within blocks, then over blocks, as each append copies its array."""

    def fold(items: Column, amount) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct((a["sum"] + amount(x)).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")))

    def of(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(xs)), width), lambda at: fold(F.slice(xs, at, width), lambda x: x))
        return let(blocks, lambda parts: F.flatten(F.zip_with(parts, fold(parts, lambda p: p["sum"])["out"], lambda p, base: F.transform(p["out"], lambda x: x + base))))

    return let(numbers, of)


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches: structs of start, order, end and kind."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )

    def spans(found: Column) -> Column:
        before = sums_before(F.transform(found, lambda p: p["gap"] + F.coalesce(p["size"], F.lit(0))))
        placed = F.zip_with(found, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), p["size"].alias("size"), p["part"].alias("part")))
        counted = F.filter(placed, lambda p: p["part"] >= max(1, rule.least))
        return F.transform(counted, lambda p: F.struct(p["start"].alias("start"), F.lit(order).alias("rank"), (p["start"] + p["size"]).alias("end"), F.lit(rule.kind).alias("kind")))

    return let(parts, spans).cast(SPANS)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each row its id, the columns ``keep``, and ``spans``: structs of start, rank, end and kind."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for clause in q for a in clause for g in a})
    indexed = [r.kind for r in rules if queries[r.kind]]
    names = list(dict.fromkeys((id_col, *keep)))
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(col(id_col)).alias("doc"), F.struct(*[col(c) for c in names if c.lower() != "spans"]).alias("row"), text.alias("text"))
    if indexed:
        index = postings(docs.select(F.xxhash64(col(id_col)).alias("doc"), text.alias("text")), grams)
        met = index.groupBy("doc").agg(F.collect_set("gram").alias("grams"))
        bits = [F.when(holds(queries[k], F.col("grams")), F.lit(1 << i)).otherwise(0) for i, k in enumerate(indexed)]
        candidates = written(met.select(F.col("doc").alias("candidate"), sum(bits[1:], bits[0]).alias("kinds")).where(F.col("kinds") > 0), "secret-candidates")
        near = F.broadcast(candidates) if candidates.count() <= BROADCAST_CANDIDATES else candidates
        rows = rows.join(near, F.col("doc") == F.col("candidate"), "left")
    else:
        rows = rows.withColumn("kinds", F.lit(0))
    none = F.array().cast(SPANS)
    found = []
    for order, rule in enumerate(rules):
        chosen = F.coalesce("kinds", F.lit(0)).bitwiseAND(F.lit(1 << indexed.index(rule.kind))) > 0 if rule.kind in indexed else F.lit(True)
        found.append(F.when(chosen & F.col("text").rlike(rule.pattern), rule_spans(F.col("text"), rule, order)).otherwise(none))
    spans = F.array_sort(F.concat(*found))
    return rows.select(*[F.col("row")[c].alias(c) for c in names if c.lower() != "spans"], spans.alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def without_secrets(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` in place of its spans; spans that overlap share one."""
    whole = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def leave(a: Column, s: Column) -> Column:
        gap = F.struct(a["at"].alias("start"), s["start"].alias("end"))
        return F.struct(F.when(s["start"] >= a["at"], F.array_append(a["out"], gap)).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    left = F.aggregate(spans, whole, leave, lambda a: F.array_append(a["out"], F.struct(a["at"].alias("start"), F.length(text).alias("end"))))
    return F.array_join(F.transform(left, lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"])), mark)


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "<SECRET>", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``mark`` in place of secrets; other rows stay as they are.

    ``chars_col``, if it is a column, becomes the new length of changed texts.
    """
    names = docs.columns
    inner = docs.select(*[col(c).alias(f"__in_{i}") for i, c in enumerate(names)])
    of = {n: f"__in_{i}" for i, n in enumerate(names)}
    found = scan(inner, id_col=of[id_col], text_col=of[text_col], keep=tuple(of.values()), rules=rules)
    text = F.col(of[text_col])
    hit = F.size("spans") > 0
    found = found.withColumn("__new", F.when(hit, without_secrets(text, F.col("spans"), mark)).otherwise(text)).withColumn("__hit", hit)
    out = {n: F.col(of[n]) for n in names} | {text_col: F.col("__new")}
    if chars_col in names:
        out[chars_col] = F.when(F.col("__hit"), F.length("__new").cast(docs.schema[chars_col].dataType)).otherwise(F.col(of[chars_col]))
    return found.select(*[out[n].alias(n) for n in names])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_RULES))
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(told(base), 256).alias("base_sha256"), told(spans).alias("spans"))


def oracle() -> str:
    """DuckDB SQL of the query: positions from the lengths of gaps and matches."""
    parts = []
    for order, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT row_id, {order} AS rank, '{rule.kind}' AS kind, i,
  CAST(list_sum([length(x) FOR x IN gap[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i-1]]), 0) AS BIGINT) AS s, length(hits[i]) AS n
  FROM (SELECT row_id, regexp_split_to_array(t, '{p}') AS gap, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {rule.group}) AS part
        FROM d WHERE regexp_matches(t, '{p}')), LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)
  WHERE length(part[i]) >= {max(1, rule.least)}"""
        )
    text = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row_id FROM documents),
m AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts}, sha256(coalesce({text} FILTER (rank < {len(BASE_RULES)}), '')) AS base_sha256, coalesce({text}, '') AS spans
FROM d LEFT JOIN m USING (row_id) GROUP BY row_id, doc_id
"""


OP9_SQL = oracle()
