"""Reading callout texts: healing of glyphs and words, tolerances, counts. Patterns are Java's, with Unicode classes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pyfmt import py_float

# What the text layer writes for a sign -> the sign.
GLYPHS = {"ø": "Ø", "⌀": "Ø", "∅": "Ø", "": "Ø", "": "Ø", "": "±", "": "±", "": "°", "−": "-", "–": "-", "‑": "-"}
HOLE_MARKS = {"⌴": "CBORE", "⊔": "CBORE", "⌵": "CSINK", "∨": "CSINK", "⋁": "CSINK", "↧": "DEEP", "⤓": "DEEP", "▽": "DEEP", "▿": "DEEP", "▼": "DEEP", "∇": "DEEP"}
FRAME_SYMBOLS = {
    "⌖": "TRUE POSITION", "⊕": "TRUE POSITION", "⨁": "TRUE POSITION", "⌭": "CYLINDRICITY", "▱": "FLATNESS", "◎": "CONCENTRICITY", "◯": "CIRCULARITY", "⌒": "PROFILE OF A LINE",
    "⌓": "PROFILE OF A SURFACE", "⌰": "RUNOUT", "↗": "CIRCULAR RUNOUT", "⟂": "PERPENDICULARITY", "⊥": "PERPENDICULARITY", "∥": "PARALLELISM", "∠": "ANGULARITY",
}
# Rewrites in their order, (any case?, pattern, replacement).
LEADING_ZERO = (False, r"(?<![\w.])\.(?=\d)", "0.")
LOOKALIKES = (
    (False, r"[Ææ](?=\s*\d)", "Ø"),
    (False, r"(?<![A-Za-z0-9.,])[OoQΦφΘθ](?=\d)", "Ø"),
    (False, r"(?<![\dA-Za-z.,/+\-])0(?=\d{1,3}(?:[.,]\d+)?(?![\d.,\-]))", "Ø"),
    (False, r"([+\-]\d+[.,]\d+)(?=[+\-]\d+[.,]\d+)", "$1/"),
)
WORDS = (
    (True, r"\bDIAM?\b\.?(?=\s*[\d.])", "Ø"),
    (False, r"([0-9.])±", "$1 ±"),
    (False, r"±([0-9.])", "± $1"),
    (False, r"(\d)\s+\.\s*(\d)", "$1.$2"),
    (False, r"(\d)\s*\.\s+(\d)", "$1.$2"),
    (True, r"\bTHROUGH\b", "THRU"),
    (True, r"\bPRZELOT(?:OWY|OWE)?\b|\bPRZEJŚCIOW[YEA]\b", "THRU"),
    (True, r"\bDURCHGANGS(?:LOCH|BOHRUNG)?\b|\bDURCHGE(?:HEND|BOHRT)\b|\bDURCHBOHR(?:EN|UNG|T)?\b|\bDURCHGANG\b|\bDURCH\b", "THRU"),
    (True, r"\bGŁĘB\.?\b|\bGŁ\.?\b", "DEEP"),
    (True, r"\bTIEFE?\b", "DEEP"),
    (True, r"\bDP\.?(?=\s*[\d.])", "DEEP "),
    (True, r"\bDURCHMESSER\b|\bDMR\.?\b(?=\s*[\d.])", "Ø"),
    (True, r"\bŚREDNICA\b|\bŚR\.?\b(?=\s*[\d.])", "Ø"),
    (True, r"\b(?:RADIUS|PROMIEŃ)\b\s*(?=[\d.])", "R"),
    (True, r"\b(?:FASE|FAZA|FAZOWANIE)\b\s*(?=[\d.])", "C"),
    (True, r"(\d+(?:[.,]\d+)?)\s*(?:\"|mm)?\s*(?:CHAMFER|CHAM\b\.?)", "C$1"),
    (True, r"\bPOGŁĘBIENIE\s+WALCOWE\b|\bFLACHSENKUNG\b|\bSPOTFACE\b|\bSF\.?\b(?=\s*[Ø\d.])", " CBORE "),
    (True, r"\bPOGŁĘBIENIE\s+STOŻKOWE\b|\bANSENKUNG\b|\bSENKUNG\b", " CSINK "),
    (True, r"(\d+)\s*(?:PLACES|PLCS|OTWOR(?:Y|ÓW)|OTW|STK|STÜCK|MAL)\.?", "$1X"),
)
ENDINGS = (
    (False, r"[ \t]{2,}", " "),
    (False, r"(\d)[\s&&[^\n]]+(\.[\d]{2,4})(?!\d)", "$1$2"),
    (False, r"(\+[\s&&[^\n]]*[\d.]+)[\s&&[^\n]]*(-[\s&&[^\n]]*[\d.]+)", "$1/$2"),
)
# Source words for a healed word, for text search.
SOURCE_WORDS = {
    "THRU": ("THROUGH", "PRZELOT", "PRZELOTOWY", "DURCH", "DURCHGANG", "DURCHGEHEND"),
    "DEEP": ("GŁ.", "GŁĘB.", "TIEF", "TIEFE", "DP"),
    "CBORE": ("C'BORE", "SPOTFACE", "FLACHSENKUNG", "POGŁĘBIENIE WALCOWE", "⌴"),
    "CSINK": ("CSK", "C'SINK", "ANSENKUNG", "SENKUNG", "POGŁĘBIENIE STOŻKOWE", "⌵"),
}
PLACES = {"ONE": 1, "TWO": 2, "THREE": 3, "FOUR": 4}
REPEAT = r"(?U)^\s*(\d+)\s*[Xx×](?=\s|Ø|$)"


def rewritten(text: Column, rules) -> Column:
    for any_case, pattern, new in rules:
        text = F.regexp_replace(text, ("(?iuU)" if any_case else "(?U)") + pattern, new)
    return text


def glyphs(text: Column) -> Column:
    return F.translate(text, "".join(GLYPHS), "".join(GLYPHS.values()))


def spelled(text: Column, table: dict[str, str]) -> Column:
    """Each sign as its word between spaces."""
    for sign, word in table.items():
        text = F.replace(text, F.lit(sign), F.lit(f" {word} "))
    return text


DEVIATION_PATTERN = r"(?:[+\-]\s*[\d.,]+|0(?:[.,]\d+)?)$"
DEVIATION, COUNT_PATTERN = re.compile(DEVIATION_PATTERN), r"(?U)^\d+[Xx×]$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def swept(lines: Column, width: int, rule: Callable[..., Column]) -> Column:
    """Let ``rule`` join windows of lines from the top; a joined window is a line and blanks.

    A window that was joined has blanked the next ``width`` - 1 lines, which the state counts.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("blank"))
    empty = F.lit("")

    def step(ls: Column) -> Callable[[Column, Column], Column]:
        def one(a: Column, i: Column) -> Column:
            own = F.when(a["blank"] > 0, empty).otherwise(F.get(ls, i))
            window = [own, *[F.when(a["blank"] > k, empty).otherwise(F.get(ls, i + k)) for k in range(1, width)]]
            joined = F.when(i <= F.size(ls) - width, rule(*[bare(w) for w in window]))
            return bound(joined, lambda j: F.struct(F.array_append(a["out"], F.coalesce(j, own)).alias("out"), F.when(j.isNotNull(), width - 1).otherwise(F.greatest(a["blank"] - 1, F.lit(0))).alias("blank")))

        return one

    return bound(lines, lambda ls: F.aggregate(F.sequence(F.lit(0), F.size(ls) - 1), start, step(ls), lambda a: a["out"]))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_deviation(text: Column) -> Column:
    return text.rlike("(?U)^" + DEVIATION_PATTERN)


def join_stack(value: Column, first: Column, second: Column) -> Column:
    """A value and two deviations under it, one of them signed."""
    signed = first.rlike(r"^[+\-]") | second.rlike(r"^[+\-]")
    ok = value.rlike(r"\p{Nd}$") & is_deviation(first) & is_deviation(second) & signed
    return F.when(ok, F.concat(value, F.lit(" "), F.replace(first, F.lit(" "), F.lit("")), F.lit("/"), F.replace(second, F.lit(" "), F.lit(""))))


def join_lower(value: Column, deviation: Column) -> Column:
    """A value with its upper deviation, and the lower one under it."""
    half = value.rlike(r"(?U)\d\s*[+\-][\d.,]*\d$") & ~F.contains(F.regexp_extract(value, r"(?U)(\S+)$", 1), F.lit("/"))
    return F.when(half & is_deviation(deviation), F.concat(value, F.lit("/"), F.replace(deviation, F.lit(" "), F.lit(""))))


def join_count(one: Column, other: Column) -> Column:
    """A count alone on its line, above or below what it counts."""
    above = one.rlike(COUNT_PATTERN) & other.rlike(r"(?U)^[.\d]")
    below = one.rlike(r"(?U)^[.\d]+$") & other.rlike(COUNT_PATTERN)
    return F.when(above, F.concat(one, F.lit(" "), other)).when(below, F.concat(other, F.lit(" "), one))


def lines_joined(text: Column) -> Column:
    """Stacked tolerances and lone counts brought onto the line of their value; blank lines left out."""
    lines = F.split(text, "\n", -1)
    for width, rule in ((3, join_stack), (2, join_lower), (2, join_count)):
        lines = swept(lines, width, rule)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def normalized(text: Column) -> Column:
    """SCAN-1: a text layer's words healed before it is scanned."""
    t = rewritten(glyphs(text), (LEADING_ZERO, *LOOKALIKES, *WORDS))
    t = spelled(t, HOLE_MARKS)
    t = F.regexp_replace(t, r"(?U)//(?=\s*[\d.,])", " PARALLELISM ")
    t = rewritten(spelled(t, FRAME_SYMBOLS), ENDINGS)
    return bound(t, lambda x: F.when(F.contains(x, F.lit("\n")), lines_joined(x)).otherwise(x))


def normalized_token(token: Column) -> Column:
    """LIN-3: the same for one word. Words without a digit or a sign of the tables stay as they are."""
    signs = "".join((*GLYPHS, *HOLE_MARKS, *FRAME_SYMBOLS))
    t = spelled(spelled(glyphs(token), HOLE_MARKS), FRAME_SYMBOLS)
    t = F.regexp_replace(t, r"(?iuU)(\d+)\s*(?:PLACES|PLCS|OTWORY|OTWORÓW|OTW|STK|STÜCK|MAL)\.?$", "$1X")
    t = F.regexp_replace(t, r"(?iuU)\bDIAM?\.?(?=[\d.])", "Ø")
    return F.when(token.rlike(rf"(?iuU)[\d{signs}]|DIAM?\."), rewritten(t, LOOKALIKES)).otherwise(token)


def parse_tol_string(t: Column) -> Column:
    """SCAN-12: struct ``sym, max, min``; BASIC, REF and what is no tolerance give NULLs. One deviation stands against zero."""
    s = F.regexp_replace(F.replace(t, F.lit(","), F.lit(".")), "[° ]", "")
    num = lambda p, g: py_float(F.nullif(F.regexp_extract(s, p, g), F.lit("")))
    pair, single = r"^([+\-]?[\d.]+)/([+\-]?[\d.]+)$", r"^([+\-])([\d.]+)$"
    a, b, v = num(pair, 1), num(pair, 2), num(single, 2)
    both, plus = a.isNotNull() & b.isNotNull(), s.startswith("+")
    plain = F.coalesce(~t.isin("BASIC", "REF"), F.lit(False))
    symmetric = s.startswith("±")
    return F.struct(
        F.when(plain & symmetric, py_float(F.substring(s, F.lit(2), F.length(s)))).alias("sym"),
        F.when(plain & ~symmetric, F.when(both, F.greatest(a, b)).when(v.isNotNull(), F.when(plus, v).otherwise(0.0))).alias("max"),
        F.when(plain & ~symmetric, F.when(both, F.least(a, b)).when(v.isNotNull(), F.when(plus, 0.0).otherwise(F.lit(0.0) - v))).alias("min"),
    )


def general_tols(text: Column) -> Column:
    """SCAN-5: map of decimal places ('1' to '4') and 'ang' to ±. Words go before X forms, which fill gaps; later words and earlier X forms win."""
    t = rewritten(F.coalesce(text, F.lit("")), (LEADING_ZERO,))
    value = lambda s: F.when(py_float(F.replace(s, F.lit(","), F.lit("."))) != 0, py_float(F.replace(s, F.lit(","), F.lit("."))))
    word = F.lit(r"(?iuU)\b(ONE|TWO|THREE|FOUR)\s+PLACE\s+DECIMAL\s*[:=]?\s*±?\s*([\d.,]+)")
    cross = F.lit(r"(?iuU)\.(X{1,4})\s*[:=]?\s*±?\s*([\d.,]+)")
    angular = r"(?iuU)\bANGULAR\b[^0-9±]{0,16}±?\s*([\d.,]+)"
    pairs = lambda p, key: F.filter(F.zip_with(F.regexp_extract_all(t, p, F.lit(1)), F.regexp_extract_all(t, p, F.lit(2)), lambda k, v: F.struct(key(k).alias("key"), value(v).alias("value"))), lambda e: e["value"].isNotNull())
    place = lambda w: F.coalesce(*[F.when(F.upper(w) == name, str(n)) for name, n in PLACES.items()])
    by_word, by_cross = F.reverse(pairs(word, place)), pairs(cross, lambda w: F.length(w).cast("string"))
    ang = value(F.regexp_extract(t, angular, 1))
    every = F.concat(by_word, by_cross, F.filter(F.array(F.struct(F.lit("ang").alias("key"), ang.alias("value"))), lambda e: e["value"].isNotNull()))
    first = F.aggregate(every, F.slice(every, 1, 0), lambda a, e: F.when(F.exists(a, lambda x: x["key"] == e["key"]), a).otherwise(F.array_append(a, e)))
    return F.map_from_entries(first)


def dp_of_value(v: Column) -> Column:
    """SCAN-6: decimals of the last number in the text."""
    last = F.try_element_at(F.regexp_extract_all(v, F.lit(r"(?U)\d+(?:[.,]\d+)?"), F.lit(0)), F.lit(-1))
    return F.when(last.isNotNull(), F.length(F.regexp_extract(last, r"[.,](.*)$", 1)))


def repeat_count(feature: Column) -> Column:
    """SCAN-11: the count of a leading ``N×``, within 1 and 26."""
    n = F.regexp_extract(feature, REPEAT, 1)
    return F.when(n == "", 1).when(F.length(F.ltrim(n)) > 9, 26).otherwise(F.greatest(F.lit(1), F.least(F.lit(26), n.try_cast("int"))))


def strip_repeat(feature: Column) -> Column:
    return F.when(feature.rlike(REPEAT), F.regexp_replace(F.regexp_replace(feature, REPEAT, ""), r"(?U)^\s+", "")).otherwise(feature)


def search_needles(text: Column, limit: int = 12) -> Column:
    """SCAN-7: spellings of a healed text that a drawing may hold, without repeats, itself first."""
    up = F.upper(text)
    variants = [F.when(F.contains(up, F.lit(canon)), F.regexp_replace(text, f"(?iu){canon}", w)) for canon, words in SOURCE_WORDS.items() for w in words]
    out = F.array_distinct(F.array_compact(F.array(text, *variants)))
    signs = F.filter(out, lambda v: F.contains(v, F.lit("Ø")))
    other = F.flatten(F.transform(signs, lambda v: F.array(F.replace(v, F.lit("Ø"), F.lit("ø")), F.replace(v, F.lit("Ø"), F.lit("⌀")))))
    return F.slice(F.array_distinct(F.concat(out, other)), 1, limit)


def bilingual(label: Column, second: bool) -> Column:
    """SCAN-10: one half of ``EN / PL``; labels of another form stay."""
    parts = F.split(label, " / ", -1)
    return F.when(F.size(parts) == 2, parts[1 if second else 0]).otherwise(label)


def reading_text(words):
    """SCAN-8: ``doc_id, page, text``: words by block, line and number, a line of text for each line."""
    lines = words.groupBy("doc_id", "page", "block", "line").agg(F.array_sort(F.collect_list(F.struct("word", "x0", "text"))).alias("w"))
    lines = lines.select("doc_id", "page", "block", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("l"))
    return pages.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
