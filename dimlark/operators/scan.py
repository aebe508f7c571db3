"""Callout scanning: ordered rules claim spans of a text.

A rule's matches and their places come from ``split`` and ``regexp_extract_all``: the lengths
of the gaps and matches before a match add up to its start. All rules' matches, in rule order,
then pass a fold that drops what overlaps a claimed span. Both are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# Fixed values.
FITS = ("H", "G", "F", "E", "D", "C", "JS", "J", "K", "M", "N", "P", "R", "S", "T", "U")
MODIFIER = r"(?:\s*(?:\(\s*([MLS])\s*\)|(MMC|LMC|RFS|[ⓂⓁⓈ])))?"
MODIFIERS = {"Ⓜ": "M", "Ⓛ": "L", "Ⓢ": "S", "MMC": "M", "LMC": "L", "RFS": "S"}
NUM = r"(\d+(?:[.,]\d+)?)"
DEV = r"[+\-]\s*\d*[.,]?\d+"

Groups = Callable[[int], Column]


@dataclass(frozen=True)
class RuleSpec:
    """A rule: ``value`` and ``tol`` build the hit's text and tolerance from the match's groups (0 is all of it)."""

    tp: str
    sb: str | None
    pattern: str
    value: Callable[[Groups], Column]
    tol: Callable[[Groups], Column] = lambda g: F.lit(None).cast("string")
    groups: int = 1


def bare(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def unspaced(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit(""))


def found(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def whole(g: Groups) -> Column:
    return bare(g(0))


def frame(name: str, pattern: str, sign: str = "") -> RuleSpec:
    """A control frame: zone, and the material modifier as a letter."""

    def value(g: Groups) -> Column:
        raw = F.upper(F.coalesce(found(g(2)), found(g(3))))
        mod = F.coalesce(*[F.when(raw == F.upper(F.lit(k)), v) for k, v in MODIFIERS.items()], raw)
        return F.concat(F.lit(f"{name} {sign}"), g(1), F.coalesce(F.concat(F.lit(" "), mod), F.lit("")))

    return RuleSpec("GDT", name, pattern + r"\s*" + ("Ø?" + r"\s*" if sign else "") + r"([\d.,]+)" + MODIFIER, value, lambda g: g(1), 3)


def fit_value(g: Groups) -> Column:
    code = unspaced(g(3))
    known = F.upper(F.regexp_replace(F.substring(code, 1, 2), "[0-9]+$", "")).isin(*FITS)
    return F.when(known, F.concat(g(1), g(2), F.lit(" "), code))


def plus_minus(k: int) -> Callable[[Groups], Column]:
    return lambda g: F.concat(F.lit("±"), found(g(k)))


#: Fixed values, in this order: earlier rules claim first.
RULES = (
    RuleSpec("THREAD", None, r"(?<![A-Za-z])M\s*\d+(?:[.,]\d+)?(?:\s*[xX×]\s*\d+(?:[.,]\d+)?)?(?:\s*-\s*[4-8][gGhH])?", whole),
    RuleSpec("THREAD", None, r"(?:\d+/\d+|#\d+)\s*-\s*\d+\s*(?:UNC|UNF|UNEF|NPT|NPTF|BSP)?", whole),
    frame("POSITION", r"(?:TRUE\s*POS(?:ITION)?|T\.P\.)", "Ø"),
    frame("FLATNESS", "FLATNESS"),
    frame("STRAIGHTNESS", "STRAIGHTNESS"),
    frame("CIRCULARITY", "(?:CIRCULARITY|ROUNDNESS)"),
    frame("CYLINDRICITY", "CYLINDRICITY"),
    frame("PARALLELISM", "PARALLELISM"),
    frame("PERPENDICULARITY", "PERP(?:ENDICUL(?:ARITY)?)?"),
    frame("ANGULARITY", "ANGULARITY"),
    frame("RUNOUT", r"(?:CIRCULAR\s*)?(?:RUNOUT|TIR|FIM)"),
    frame("CONCENTRICITY", "(?:CONCENTRICITY|COAXIALITY)"),
    frame("PROFILE", r"PROFILE\s*(?:OF\s*A?\s*(?:LINE|SURFACE))?"),
    RuleSpec("SURFACE", None, r"(?:Rmax|Rsm|Ra|Rz|Rq|Rt|Rp|Rv)\s*(?:=\s*)?([\d.,]+)\s*(?:[µu]m|micron)?", whole),
    RuleSpec("FIT", None, r"(Ø?)[ \t]*" + NUM + r"[ \t]*((?:[A-Z]{1,2}|[a-z]{1,2})[ ]?\d{1,2}(?:\s*/\s*(?:[A-Z]{1,2}|[a-z]{1,2})[ ]?\d{1,2})?)(?![\w°])", fit_value, lambda g: unspaced(g(3)), 3),
    RuleSpec("DIAMETER", "CBORE", r"(?:C'?BORE|CBORE)\s*Ø?\s*" + NUM, lambda g: F.concat(F.lit("CBORE Ø"), g(1))),
    RuleSpec("DIAMETER", "CSINK", r"(?:C'?SINK|CSK)\s*Ø?\s*" + NUM + r"(?:\s*[xX×]\s*" + NUM + r"\s*°)?", lambda g: F.concat(F.lit("CSINK Ø"), g(1), F.coalesce(F.concat(F.lit(" X"), found(g(2)), F.lit("°")), F.lit(""))), groups=2),
    RuleSpec("DEPTH", None, r"\bDEEP\b\.?\s*Ø?\s*" + NUM, lambda g: F.concat(F.lit("DEEP "), g(1))),
    RuleSpec(
        "DIAMETER", None, r"(?:(\d+)\s*[Xx×]\s*)?Ø\s*" + NUM + r"\s*((?:(?<![\d.,])0(?=\s*/)|[+\-±]\s*\d*[.,]?\d+)(?:\s*/\s*(?:0(?:[.,]\d+)?(?![\d.,])|" + DEV + r"))?)?",
        lambda g: F.concat(F.coalesce(F.concat(found(g(1)), F.lit("X ")), F.lit("")), F.lit("Ø"), g(2)), lambda g: found(unspaced(g(3))), 3,
    ),
    RuleSpec("RADIUS", None, r"(?:^|[\s,(])R\s*" + NUM + r"(?:\s*±\s*([\d.,]+))?", lambda g: F.concat(F.lit("R"), g(1)), plus_minus(2), 2),
    RuleSpec("CHAMFER", None, NUM + r"\s*[xX×]\s*45(?:[.,]0{1,2})?\s*°", lambda g: unspaced(g(0))),
    RuleSpec("CHAMFER", None, r"\bC[ \t]?" + NUM + r"(?![\d.,])(?![ \t]*[A-Za-z])", lambda g: F.concat(F.lit("C"), g(1))),
    RuleSpec("ANGLE", None, NUM + r"\s*(?:°|DEG(?:REES?)?\b)(?:\s*±\s*([\d.,]+)\s*(?:°|DEG(?:REES?)?\b)?)?", lambda g: F.concat(g(1), F.lit("°")), plus_minus(2), 2),
    RuleSpec("LINEAR", "BASIC", r"\[\s*" + NUM + r"\s*\]", lambda g: g(1), lambda g: F.lit("BASIC")),
    RuleSpec("LINEAR", "REF", r"\(\s*" + NUM + r"\s*\)", lambda g: g(1), lambda g: F.lit("REF")),
    RuleSpec("LINEAR", None, NUM + r"\s*±\s*(\d*[.,]?\d+)", lambda g: g(1), plus_minus(2), 2),
    RuleSpec("LINEAR", None, NUM + r"\s*((?:(?<![\d.,])0(?:[.,]\d+)?(?=\s*/)|" + DEV + r")\s*/\s*(?:0(?:[.,]\d+)?(?![\d.,])|" + DEV + r"))", lambda g: g(1), lambda g: unspaced(g(2)), 2),
    RuleSpec("LINEAR", None, NUM + r"\s*([+\-]\d+[.,]\d+)(?![\d.,/%])", lambda g: g(1), lambda g: g(2), 2),
)

#: For each rule, what stands in the upper-cased text wherever it matches: one of these (none: no such text).
#: Letters whose cases Java's patterns take more freely than ``upper``, I and K, are left out of them.
TRIGGERS: tuple[tuple[str, ...], ...] = (
    ("M",), ("-",),
    ("TRUE", "T.P."), ("FLATNESS",), ("STRA",), ("RCULAR", "ROUNDNESS"), ("CYL",), ("PARALLEL",), ("PERP",), ("ANGULAR",), ("R", "M"), ("CONCENTR", "COAX"), ("PROF",),
    ("R",), (), ("BORE",), ("CS", "C'S"), ("DEEP",), ("Ø",), ("R",), ("45",), ("C",), ("°", "DEG"), ("[",), ("(",), ("±",), ("/",), ("+", "-"),
)

#: Some rule can match only where this is found: a digit, or the word of a frame or finish rule.
HOPEFUL = r"(?iuU)\d|POS|T\.P\.|NESS|ITY|PARALLELISM|PERP|RUNOUT|TIR|FIM|PROFILE|R(?:max|sm|[azqtpv])\s*(?:=\s*)?[.,]"
HIT = "struct<tp:string,sb:string,v:string,t:string,raw:string,start:int,end:int>"


def rule_matches(text: Column, rule: RuleSpec, flags: str) -> Column:
    """Array of HIT: the rule's matches that have a value, outer white space left off."""
    pattern = F.lit(f"(?{flags})" + rule.pattern)
    arrays = [F.split(text, f"(?{flags})" + rule.pattern, -1).alias("gap")]
    arrays += [F.regexp_extract_all(text, pattern, F.lit(k)).alias(f"g{k}") for k in range((rule.groups if "(" in rule.pattern else 0) + 1) if k == 0 or rule.value is not whole]

    def add(acc: Column, m: Column) -> Column:
        raw = m["g0"]
        at = acc["at"] + F.length(m["gap"])
        start = at + F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
        groups = lambda k: m[f"g{k}"]
        hit = F.struct(
            F.lit(rule.tp).alias("tp"), F.lit(rule.sb).cast("string").alias("sb"), rule.value(groups).alias("v"), rule.tol(groups).alias("t"),
            bare(raw).alias("raw"), start.alias("start"), (start + F.length(bare(raw))).alias("end"),
        )
        return F.struct((at + F.coalesce(F.length(raw), F.lit(0))).alias("at"), F.when(F.coalesce(hit["v"], F.lit("")) != "", F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{HIT}>").alias("out"))
    empty = F.array().cast(f"array<{HIT}>")
    return F.when(text.rlike(f"(?{flags})" + rule.pattern), F.aggregate(F.arrays_zip(*arrays), start, add, lambda a: a["out"])).otherwise(empty)


def greedy_keep(items: Column, clash: Callable[[Column, Column], Column], none: Column | None = None) -> Column:
    """Items in order, each kept unless it clashes with one kept before: spans, dedup and suppression alike.

    ``none``: an empty array of the items' type, for items that are not a plain column.
    """
    return F.aggregate(items, F.slice(items, 1, 0) if none is None else none, lambda kept, x: F.when(F.exists(kept, lambda k: F.coalesce(clash(k, x), F.lit(False))), kept).otherwise(F.array_append(kept, x)))


def hit_key(h: Column) -> Column:
    """What makes two hits of a text the same: kind, value without its count, tolerance."""
    v = F.regexp_replace(h["v"], r"(?U)^\d+[Xx×]\s*", "")
    return unspaced(F.lower(F.concat(h["tp"], F.lit(":"), v, F.lit(":"), F.coalesce(h["t"], F.lit("")))))


def claimed(text: Column, rules: tuple[RuleSpec, ...] = RULES, lines: bool = True, once: bool = True, upper: Column | None = None) -> Column:
    """Array of HIT. ``lines``: ``^`` is the start of any line. ``once``: a hit's key may occur once.

    With the text in ``upper`` case at hand, only the rules run whose trigger stands in it.
    """
    flags = "iumU" if lines else "iuU"
    none = F.array().cast(f"array<{HIT}>")
    matches = [rule_matches(text, r, flags) for r in rules]
    if rules is RULES and upper is not None:
        some = lambda needs: reduce(Column.__or__, [F.contains(upper, F.lit(n)) for n in needs])
        matches = [F.when(some(needs), m).otherwise(none) if needs else m for needs, m in zip(TRIGGERS, matches, strict=True)]
    every = F.concat(*matches)
    if rules is RULES:
        every = F.when(text.rlike(HOPEFUL), every).otherwise(none)
    overlap = lambda k, x: (x["end"] > k["start"]) & (x["start"] < k["end"])
    return greedy_keep(every, (lambda k, x: overlap(k, x) | (hit_key(k) == hit_key(x))) if once else overlap, none)


class Built(dict):
    """Columns by what they were built for; functions that go to the executors by value take it along empty."""

    def __reduce__(self):
        return dict, ()


#: Scans of fixed columns, built once for each Spark context: the columns of 28 rules take seconds to put together.
BUILT: dict[tuple, Column] = Built()


def scan_of(text: str, upper: str, lines: bool, once: bool) -> Column:
    """``claimed`` by all rules of the columns named ``text`` and ``upper``."""
    context = SparkContext._active_spark_context
    key = (context.applicationId if context else None, text, upper, lines, once)
    if key not in BUILT:
        BUILT[key] = claimed(F.col(text), lines=lines, once=once, upper=F.col(upper))
    return BUILT[key]


def is_thru(text: Column) -> Column:
    return text.rlike(r"(?iuU)\bTHRU\b")


def scan_parse(df: DataFrame, text: Column, keys: tuple[str, ...], rules: tuple[RuleSpec, ...] = RULES) -> DataFrame:
    """SCAN-2: ``keys, ord, tp, sb, v, t, raw, thru, start, end`` of each hit in a healed text."""
    rows = df.select(*keys, text.alias("__text")).withColumn("__upper", F.upper("__text"))
    rows = rows.withColumn("hits", scan_of("__text", "__upper", True, True) if rules is RULES else claimed(F.col("__text"), rules))
    # the outer form keeps Spark from testing the array's size first, by computing it once more
    out = rows.select(*keys, is_thru(F.col("__text")).alias("__thru"), F.posexplode_outer("hits").alias("ord", "h")).where("h IS NOT NULL")
    thru = F.when((F.col("h.tp") == "DIAMETER") & F.col("h.sb").isNull() & F.col("__thru"), True)
    return out.select(*keys, "ord", "h.tp", "h.sb", "h.v", "h.t", "h.raw", thru.alias("thru"), "h.start", "h.end")


def union_rect(rects: Column) -> Column:
    """GEO-1."""
    edge = lambda f, c: f(F.transform(rects, lambda r: r[c]))
    return F.when(F.size(rects) > 0, F.struct(edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1")))


def is_bare_number(token: Column) -> Column:
    """FIL-17: up to five digits with decimals, not 0 and not like a year."""
    return token.rlike(r"(?U)^\d{1,5}(?:[.,]\d+)?$") & (token != "0") & ~token.rlike(r"(?U)^(19|20)\d\d$")


def parse_lines(lines: DataFrame, include_bare: bool = False) -> DataFrame:
    """SCAN-3: ``lines(doc_id, page, cg, toks array<struct<t, r>>)`` -> hits with the rectangles of their words."""
    joined = F.array_join(F.transform("toks", lambda t: t["t"]), " ")
    ends = F.aggregate("toks", F.array().cast("array<int>"), lambda a, t: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)) + 1, F.lit(0)) + F.length(t["t"])))
    rows = lines.select("doc_id", "page", "cg", "toks", joined.alias("s"), ends.alias("ends"))
    rows = rows.withColumn("__upper", F.upper("s")).withColumn("hits", scan_of("s", "__upper", False, False))
    spots = F.zip_with("toks", "ends", lambda t, e: F.struct((e - F.length(t["t"])).alias("from"), e.alias("to"), t["r"].alias("r"), t["t"].alias("t")))
    rows = rows.withColumn("spots", spots)
    inside = lambda h: F.filter("spots", lambda p: (p["to"] > h["start"]) & (p["from"] < h["end"]))
    thru = lambda h: F.when((h["tp"] == "DIAMETER") & h["sb"].isNull() & is_thru(F.col("s")), True)
    shaped = F.transform("hits", lambda h: F.struct(h["tp"].alias("tp"), h["sb"].alias("sb"), h["v"].alias("v"), h["t"].alias("t"), h["raw"].alias("raw"), thru(h).alias("thru"), union_rect(F.transform(inside(h), lambda p: p["r"])).alias("rect")))
    if include_bare:
        free = F.filter("spots", lambda p: is_bare_number(p["t"]) & ~F.exists("hits", lambda h: (p["to"] > h["start"]) & (p["from"] < h["end"])))
        none = F.lit(None).cast("string")
        numbers = F.transform(free, lambda p: F.struct(F.lit("LINEAR").alias("tp"), F.lit("BARE").alias("sb"), p["t"].alias("v"), none.alias("t"), p["t"].alias("raw"), F.lit(None).cast("boolean").alias("thru"), p["r"].alias("rect")))
        shaped = F.concat(shaped, numbers)
    out = rows.select("doc_id", "page", "cg", F.posexplode_outer(shaped).alias("i", "h")).where("h IS NOT NULL")
    return out.select("doc_id", "page", "cg", "i", "h.*")


def dedup_hits(hits: DataFrame, tol: float = 8.0) -> DataFrame:
    """LIN-11: of equal hits within ``tol`` points of a page, or without a place, the first stays."""
    fields = ["cg", "i", "tp", "sb", "v", "t", "raw", "thru", "rect"]
    pages = hits.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("h"))
    mid = lambda h, a, b: (h["rect"][a] + h["rect"][b]) / 2
    near = lambda k, x: F.coalesce((F.abs(mid(k, "x0", "x1") - mid(x, "x0", "x1")) <= tol) & (F.abs(mid(k, "y0", "y1") - mid(x, "y0", "y1")) <= tol), F.lit(True))
    same = lambda k, x: k["tp"].eqNullSafe(x["tp"]) & k["sb"].eqNullSafe(x["sb"]) & k["v"].eqNullSafe(x["v"]) & k["t"].eqNullSafe(x["t"]) & near(k, x)
    return pages.select("doc_id", "page", F.posexplode_outer(greedy_keep(F.col("h"), same)).alias("ord", "h")).where("h IS NOT NULL").select("doc_id", "page", "ord", "h.*").drop("i")


def fallback(region: Column, placed: Column, plain: Column, bare_: Column) -> Column:
    """SCAN-9: the first of four hit arrays that is not empty."""
    full = lambda a: F.when(F.size(a) > 0, a)
    return F.coalesce(full(region), full(placed), full(plain), full(bare_))


def first_bare_number(text: Column) -> Column:
    """SCAN-9: the last resort: the first number of the text."""
    return found(F.regexp_extract(text, r"(?U)\d+(?:[.,]\d+)?", 0))


def differential(old: DataFrame, new: DataFrame) -> DataFrame:
    """AGG-5: ``doc_id, page, key, side`` of hits that only one of two scans found."""
    key = F.concat(F.col("tp"), F.lit(":"), F.col("v")).alias("key")
    a, b = old.select("doc_id", "page", key), new.select("doc_id", "page", key)
    on = ["doc_id", "page", "key"]
    return a.join(b, on, "left_anti").withColumn("side", F.lit("old")).union(b.join(a, on, "left_anti").withColumn("side", F.lit("new")))


