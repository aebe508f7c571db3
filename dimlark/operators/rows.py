"""From classified callouts to ledger rows: classes, tolerances, gages, expansion, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pyfmt import dp_of_text, dp_tol, fnum, py_float, py_g
from ..functions.standards import general_tol, is_fit_code, with_fit_limits
from ..functions.text import dp_of_value, parse_tol_string, repeat_count, strip_repeat
from ..schema import GAGES, GROUP_OF, GROUPS, EngineConf
from .ledger import clockwise, letter

# Fixed values.
HOLE, THRU, THREAD, DEPTH, POSITION, FINISH = "hole / otwór", "thru / przelot", "thread / gwint", "depth / głębokość", "position / pozycja", "finish / wykończenie"
HOLES, POSITIONS, THREADS, OTHER = GROUPS[2], GROUPS[1], GROUPS[3], GROUPS[6]
FALLBACK = {
    "CMM": ("height gauge", "micrometer", "caliper"),
    "micrometer": ("caliper",),
    "pin / bore gauge": ("caliper",),
    "GO gauge": ("screw test / wkręt",),
    "height gauge": ("caliper",),
}
NUM = r"(\d+(?:[.,]\d+)?)"


def number_in(text: Column) -> Column:
    """The number left when all but digits and points is dropped."""
    return py_float(F.replace(F.regexp_replace(text, r"[^\d.,]", ""), F.lit(","), F.lit(".")))


def first_number(text: Column, before: str = "") -> Column:
    return number_in(F.nullif(F.regexp_extract(text, before + NUM, 1), F.lit("")))


def rows_of_hits(hits: DataFrame) -> DataFrame:
    """ROW-1: ``hits`` with the columns of a ledger row: type, group, feature, nominal, tolerances.

    A single fit code takes its limits from the ISO 286 table by a broadcast join.
    """
    tp, v, t = F.col("tp"), F.col("v"), F.coalesce("t", F.lit(""))
    code = F.replace(t, F.lit(" "), F.lit(""))
    fit = tp == "FIT"
    fit_nominal = number_in(F.nullif(F.regexp_extract(v, r"^\s*Ø?\s*" + NUM, 1), F.lit("")))
    nominal = (
        F.when(tp.isin("THREAD", "SURFACE"), F.lit(None))
        .when(tp.isin("DEPTH", "CHAMFER"), first_number(v))
        .when(tp == "GDT", F.lit(0.0))
        .when(tp == "DIAMETER", F.coalesce(first_number(v, r"Ø\s*"), number_in(v)))
        .when(fit, fit_nominal)
        .otherwise(number_in(v))
    )
    thru = F.coalesce("thru", F.lit(False)) & (tp == "DIAMETER")
    is_hole = fit & code.rlike(r"^\p{Lu}")
    kind = (
        F.when(tp == "DEPTH", DEPTH).when(tp == "THREAD", THREAD).when(tp == "GDT", "GD&T").when(tp == "SURFACE", FINISH)
        .when(thru, THRU).when((tp == "DIAMETER") | is_hole, HOLE).otherwise("dim")
    )
    group = (
        F.when(tp.isin("DEPTH", "DIAMETER") | is_hole, HOLES).when(tp == "THREAD", THREADS).when(tp.isin("GDT", "ANGLE"), "GD&T")
        .when(tp == "SURFACE", FINISH).when(tp == "CHAMFER", OTHER).otherwise("LWH")
    )
    feature = F.when(thru, F.concat(v, F.lit(" THRU"))).when(fit, F.concat(v, F.lit(" (fit "), t, F.lit(")"))).otherwise(v)
    tol = parse_tol_string(F.col("t"))
    gdt = tp == "GDT"
    rows = hits.withColumns(
        {
            "type": kind,
            "group": group,
            "feature": feature,
            "nominal": nominal,
            "tol_sym": F.when(~gdt, tol["sym"]),
            "tol_max": F.when(gdt, number_in(t)).otherwise(tol["max"]),
            "tol_min": F.when(gdt, F.lit(0.0)).otherwise(tol["min"]),
            "__code": F.when(fit & ~F.contains(code, F.lit("/")), code),
        }
    )
    rows = with_fit_limits(rows, F.col("nominal"), F.col("__code"))
    fits = F.col("upper").isNotNull()
    rows = rows.withColumns({"tol_max": F.when(fits, F.col("upper")).otherwise(F.col("tol_max")), "tol_min": F.when(fits, F.col("lower")).otherwise(F.col("tol_min"))})
    return rows.drop("upper", "lower", "__code").withColumns({"pin": F.lit(None).cast("double"), "offset": F.lit(None).cast("double"), "measured": F.lit(None).cast("string"), "tier": F.lit("")})


def expanded(rows: DataFrame, conf: EngineConf = EngineConf(), repeat: Column | None = None) -> DataFrame:
    """ROW-2: holes become Ø, X and Y rows, ``N×`` rows N copies of them without the prefix; ``part`` gives their order.

    With ``repeat`` false for a row the prefix stays and so does the single copy. The pin goes to
    the X and Y rows: the row's own, else the nominal.
    """
    again = F.lit(True) if repeat is None else F.coalesce(repeat, F.lit(True))
    feature = F.coalesce("feature", F.lit(""))
    n = F.when(again, repeat_count(feature)).otherwise(1)
    bare = F.upper(F.regexp_replace(F.when(again, strip_repeat(feature)).otherwise(feature), r"(?U)^\s+", ""))
    hole = F.coalesce(F.col("type").rlike("^(hole|thru)"), F.lit(False)) & ~bare.rlike("^(CBORE|CSINK)") & F.lit(conf.hole_position_rows)
    kinds = F.when(hole, F.array(F.lit("D"), F.lit("X"), F.lit("Y"))).otherwise(F.array(F.lit("D")))
    copies = rows.withColumns({"__n": n, "__hole": hole, "__kinds": kinds, "__again": again}).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    parts = copies.select("*", F.posexplode("__kinds").alias("__k", "__kind"))
    own, pin = F.col("__kind") == "D", F.coalesce("pin", F.col("nominal")) if conf.hole_pin_auto else F.col("pin")
    none = lambda c, kind="double": F.when(own, F.col(c)).otherwise(F.lit(None).cast(kind))
    return parts.withColumns(
        {
            "part": (F.col("__copy") - 1) * 3 + F.col("__k"),
            "pin": F.when(~own, pin).when(~F.col("__hole"), F.col("pin")),
            "type": F.when(own, F.col("type")).otherwise(POSITION),
            "group": F.when(own, F.col("group")).otherwise(POSITIONS),
            "feature": F.when(~own, F.col("__kind")).when(F.col("__again"), strip_repeat(F.coalesce("feature", F.lit("")))).otherwise(F.col("feature")),
            **{c: none(c) for c in ("nominal", "tol_sym", "tol_max", "tol_min", "offset")},
            "measured": none("measured", "string"),
        }
    ).drop("__n", "__hole", "__kinds", "__copy", "__k", "__kind", "__again")


def with_general_tols(rows: DataFrame, gtols: DataFrame, conf: EngineConf = EngineConf()) -> DataFrame:
    """ROW-4: ``gtols(doc_id, page, tols map)``: rows without a tolerance take their page's, by decimals or for angles."""
    known = F.col("tol_sym").isNotNull() | F.col("tol_max").isNotNull() | F.col("tol_min").isNotNull()
    apt = ~known & F.col("nominal").isNotNull() & ~F.col("tp").isin("GDT", "SURFACE", "THREAD")
    dp = dp_of_value(F.col("v"))
    tols = F.coalesce("tols", F.create_map().cast("map<string,double>"))
    by_dp = F.coalesce(F.try_element_at(tols, F.when(dp.isNotNull(), F.least(dp, F.lit(4)).cast("string"))), dp_tol(dp, conf.dp_on, conf.dp_tols))
    tol = F.when(F.col("tp") == "ANGLE", F.try_element_at(tols, F.lit("ang"))).otherwise(by_dp)
    return rows.join(gtols, ["doc_id", "page"], "left").withColumn("tol_sym", F.when(apt & (tol != 0), tol).otherwise(F.col("tol_sym"))).drop("tols")


def suggest_gage(kind: Column, group: Column, sym: Column, tmax: Column, tmin: Column, conf: EngineConf = EngineConf()) -> Column:
    """ROW-5: the ideal gage, else the first enabled one behind it, else a caliper. A negative ± counts as tight."""
    kind, group = F.coalesce(kind, F.lit("")), F.coalesce(group, F.lit(""))
    both = tmax.isNotNull() & tmin.isNotNull()
    tol = F.coalesce(sym, F.when(both, (F.greatest(tmax, tmin) - F.least(tmax, tmin)) / 2.0))
    ideal = (
        F.when(kind.startswith("thread"), "GO gauge").when(group.startswith("GD&T") | kind.startswith("position") | group.startswith("positions"), "CMM")
        .when(tol <= conf.cmm_tol, "CMM").when(tol <= conf.mic_tol, "micrometer").when(kind.startswith("hole") | kind.startswith("thru"), "pin / bore gauge").otherwise("caliper")
    )
    if conf.enabled_gages is None:
        return ideal
    usable = lambda g: g in conf.enabled_gages or g not in GAGES
    best = {g: next((x for x in (g, *FALLBACK.get(g, ())) if usable(x)), "caliper") for g in GAGES}
    out = F.lit("caliper")
    for gage, chosen in best.items():
        out = F.when(ideal == gage, chosen).otherwise(out)
    return out


def captured(rows: DataFrame, kind: str, tier: str) -> DataFrame:
    """ROW-6: rows of bare numbers take the sticky type, group and tier."""
    bare = F.col("sb").eqNullSafe("BARE")
    rows = rows.withColumns({"type": F.when(bare, kind).otherwise(F.col("type")), "tier": F.when(bare, tier).otherwise(F.col("tier")), "group": F.when(bare, GROUP_OF.get(kind, "LWH")).otherwise(F.col("group"))})
    if kind.startswith(("hole", "thru")):
        rows = rows.withColumn("feature", F.when(bare & F.col("nominal").isNotNull(), F.format_string("Ø%.3f", F.col("nominal"))).otherwise(F.col("feature")))
    return rows


def prefilled(rows: DataFrame) -> DataFrame:
    """ROW-6: rows of bare numbers keep only the nominal and ±."""
    bare = F.col("sb").eqNullSafe("BARE")
    return rows.withColumns({c: F.when(~bare, F.col(c)) for c in ("type", "group", "feature", "tol_max", "tol_min")})


def resolved_tol(df: DataFrame, nominal: Column, tsym: Column, tmax: Column, tmin: Column, source: Column, iso_on: bool, conf: EngineConf = EngineConf()) -> DataFrame:
    """ROW-7: ``tol_sym, tol_max, tol_min, error`` of typed entries.

    A fit code goes first, then upper or lower, then ±, then ISO 2768, then decimal places.
    What the application would refuse gives ``error`` and no tolerance.
    """
    code = is_fit_code(tsym)
    rows = with_fit_limits(df.withColumn("__code", F.when(code, F.trim(tsym))), nominal, F.col("__code"))
    typed_max, typed_min, typed = fnum(tmax), fnum(tmin), fnum(tsym)
    sides = typed_max.isNotNull() | typed_min.isNotNull()
    blank = F.coalesce(F.trim(tsym), F.lit("")) == ""
    iso = general_tol("linear", nominal, F.lit(conf.iso_class)) if iso_on else F.lit(None).cast("double")
    by_dp = F.lit(None).cast("double") if iso_on else dp_tol(dp_of_text(source), conf.dp_on, conf.dp_tols)
    error = F.when(code & F.col("upper").isNull(), "ISO 286").when(~code & ~sides & ~blank & typed.isNull(), "bad tolerance").when(~code & ~sides & blank & F.lit(iso_on) & iso.isNull(), "ISO 2768")
    sym = F.when(~code & ~sides, F.when(~blank, typed).otherwise(F.coalesce(iso, by_dp)))
    return rows.withColumns(
        {"tol_sym": sym, "tol_max": F.when(code, F.col("upper")).when(sides, typed_max), "tol_min": F.when(code, F.col("lower")).when(sides, typed_min), "error": error}
    ).drop("__code", "upper", "lower")


def quick_rows(df: DataFrame, kind: str, iso_on: bool, conf: EngineConf = EngineConf()) -> DataFrame:
    """MUT-2: ``nominal, source, tsym, tmax, tmin`` -> rows from sticky settings; a row with ``error`` is not to be inserted."""
    hole = kind.startswith(("hole", "thru"))
    shown = F.format_string("Ø%.2f" if hole else "%.2f", F.col("nominal"))
    rows = resolved_tol(df, F.col("nominal"), F.col("tsym"), F.col("tmax"), F.col("tmin"), F.col("source"), iso_on, conf)
    fit = is_fit_code(F.col("tsym"))
    feature = F.when(fit, F.trim(F.concat(F.coalesce(shown, F.lit("")), F.lit(" "), F.trim("tsym")))).otherwise(F.coalesce(shown, F.lit("")))
    rows = rows.withColumns({"type": F.lit(kind), "group": F.lit(GROUP_OF.get(kind, "")), "feature": feature})
    return rows.withColumn("gage", suggest_gage(F.col("type"), F.col("group"), F.col("tol_sym"), F.col("tol_max"), F.col("tol_min"), conf))


def inverse_dimension(reference: Column, nominal: Column, feature: Column) -> Column:
    """ROW-9: struct ``nominal, feature`` of the distance from the other end."""
    note = F.concat(F.lit("(inv "), py_g(nominal), F.lit(" z/of "), py_g(reference), F.lit(")"))
    shown = F.when(F.coalesce(feature, F.lit("")) != "", F.concat(feature, F.lit(" "), note)).otherwise(note)
    return F.struct(F.round(reference - nominal, 4).alias("nominal"), shown.alias("feature"))


def extras(holes: DataFrame) -> DataFrame:
    """ROW-10: ``depth, cbore, cbore_depth`` of holes -> their rows, ``ord`` in that order; ``error`` where a depth lacks its Ø."""
    kinds = ((DEPTH, "depth", "depth"), (HOLE, "cbore Ø", "cbore"), (DEPTH, "cbore depth", "cbore_depth"))
    each = [F.struct(F.lit(i).alias("ord"), F.lit(t).alias("type"), F.lit(HOLES).alias("group"), F.concat(F.lit(f), F.coalesce("tag", F.lit(""))).alias("feature"), F.col(c).alias("nominal")) for i, (t, f, c) in enumerate(kinds)]
    error = F.when(F.col("cbore_depth").isNotNull() & F.col("cbore").isNull(), "CBore depth needs CBore Ø")
    rows = holes.withColumn("error", error).withColumn("e", F.explode(F.filter(F.array(*each), lambda e: e["nominal"].isNotNull())))
    return rows.select(*[c for c in rows.columns if c not in ("e", "depth", "cbore", "cbore_depth", "tag")], "e.*")


def pattern_rows(patterns: DataFrame, share: str | None = None) -> DataFrame:
    """ROW-8: ``holes array<struct<x,y>>, nominal, feature`` -> X, Y and Ø rows of each hole, with tags and letters.

    With ``share`` 'x' or 'y' all holes take that coordinate of the first. Coordinates after the
    first hole's are rounded to four places, half up.
    """
    first = F.element_at("holes", 1)
    many = F.size("holes") > 1
    rows = patterns.select("*", F.posexplode("holes").alias("k", "at"))
    x = F.when(F.col("k") > 0, F.round(first["x"] if share == "x" else F.col("at.x"), 4)).otherwise(F.col("at.x"))
    y = F.when(F.col("k") > 0, F.round(first["y"] if share == "y" else F.col("at.y"), 4)).otherwise(F.col("at.y"))
    tag = F.when(many, F.concat(F.lit(" H"), (F.col("k") + 1).cast("string"))).otherwise("")
    part = lambda i, t, g, f, n, p: F.struct(F.lit(i).alias("i"), F.lit(t).alias("type"), F.lit(g).alias("group"), F.concat(f, tag).alias("feature"), n.alias("nominal"), p.cast("double").alias("pin"))
    name = F.coalesce(F.nullif(F.col("feature"), F.lit("")), F.lit("Ø"))
    parts = F.array(part(0, POSITION, POSITIONS, F.lit("X pos"), x, F.col("nominal")), part(1, POSITION, POSITIONS, F.lit("Y pos"), y, F.col("nominal")), part(2, HOLE, HOLES, name, F.col("nominal"), F.lit(None)))
    others = [c for c in patterns.columns if c not in ("holes", "nominal", "feature")]
    out = rows.select(*others, "k", F.explode(parts).alias("p")).select(*others, (F.col("k") * 3 + F.col("p.i")).alias("ord"), "p.type", "p.group", "p.feature", "p.nominal", "p.pin")
    return out.withColumn("suffix", letter(F.col("ord")))


def used(sb: Column, tol_sym: Column) -> Column:
    """ROW-11: whether a scanned row starts in use: not if basic or for reference, and bare numbers only with a tolerance."""
    kind = F.coalesce(sb, F.lit(""))
    return ~kind.isin("BASIC", "REF", "BARE") | ((kind == "BARE") & tol_sym.isNotNull())


def reviewed(rows: DataFrame, overrides: DataFrame, keys: tuple[str, ...] = ("doc_id", "ord")) -> DataFrame:
    """ROW-11: ``overrides(keys, include?, any row columns)``: rows not included go, given cells replace.

    Where ``include`` is not given, rows with ``sb`` and ``tol_sym`` are in if ``used`` says so, others
    are in. A given type brings its group, unless that is given too.
    """
    fields = [c for c in overrides.columns if c not in (*keys, "include")]
    over = overrides.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields], *([F.col("include").alias("__include")] if "include" in overrides.columns else []))
    joined = rows.join(over, list(keys), "left")
    start = used(F.col("sb"), F.col("tol_sym")) if {"sb", "tol_sym"} <= set(rows.columns) else F.lit(True)
    joined = joined.where(F.coalesce("__include", start) if "__include" in over.columns else start)
    cells = {c: F.coalesce(f"__{c}", c) for c in fields}
    if "type" in fields and "group" in rows.columns and "group" not in fields:
        own = F.coalesce(*[F.when(F.col("__type") == t, F.lit(g)) for t, g in GROUP_OF.items()])
        cells["group"] = F.coalesce(own, "group")
    return joined.withColumns(cells).select(*rows.columns)


def accepted(rows: DataFrame, first_uid: Column, iso_on: bool = False, conf: EngineConf = EngineConf()) -> DataFrame:
    """ROW-12: reviewed rows (``doc_id, page, cg, ord, ax, ay, anchored``, row columns) as ledger rows.

    Items go clockwise around their page; those of one callout group share a balloon, which sits
    at the anchor of the group's first item and has the next uid from ``first_uid`` on. Plain
    dimensions without tolerance take ISO 2768's if asked for. Then holes are expanded.
    """
    rows = clockwise(rows)
    key = F.coalesce(F.concat_ws("/", F.col("page").cast("string"), F.col("cg").cast("string")), F.lit(""))
    rows = rows.withColumn("__key", F.when(F.col("cg").isNull(), F.concat(F.lit("_"), F.col("ord").cast("string"))).otherwise(key))
    group = Window.partitionBy("doc_id", "__key").orderBy("cw_ord")
    rows = rows.withColumns({"x": F.first("ax").over(group), "y": F.first("ay").over(group), "__first": F.min("cw_ord").over(Window.partitionBy("doc_id", "__key"))})
    rows = rows.withColumn("uid", first_uid - 1 + F.dense_rank().over(Window.partitionBy("doc_id").orderBy("__first")))
    if iso_on:
        bare = (F.col("type") == "dim") & F.col("tol_sym").isNull() & F.col("tol_max").isNull() & F.col("tol_min").isNull()
        rows = rows.withColumn("tol_sym", F.when(bare, general_tol("linear", F.col("nominal"), F.lit(conf.iso_class))).otherwise(F.col("tol_sym")))
    rows = expanded(rows, conf, F.col("expand") if "expand" in rows.columns else None)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("cw_ord", "part")).cast("long")
    rows = rows.withColumn("seq", place).withColumn("gage", suggest_gage(F.col("type"), F.col("group"), F.col("tol_sym"), F.col("tol_max"), F.col("tol_min"), conf))
    return rows.drop("__key", "__first", "angle")
