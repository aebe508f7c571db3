"""Numbering, ordering, editing and history of ledgers.

A ledger table holds many drawings; ``(doc_id, seq)`` names a row and gives the list order
within its drawing, and ``uid`` a balloon. All windows are partitioned by drawing, whose rows
are few, so a large table spreads evenly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pyfmt import LETTERS, base_of

IDENTITY = ("bubble", "uid", "page", "x", "y", "sheet_row", "measured", "bx", "by", "lexit")


def ordered_uids(ledger: DataFrame) -> DataFrame:
    """WIN-1: ``doc_id, uid, first_page, first_seq, num``: balloons by page of their first row, then place."""
    firsts = ledger.groupBy("doc_id", "uid").agg(F.min("seq").alias("first_seq"), F.min_by(F.coalesce("page", F.lit(0)), "seq").alias("first_page"))
    num = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_page", "first_seq"))
    return firsts.withColumn("num", num)


def letter(place: Column) -> Column:
    """The letter of a place from 0, starting over after z."""
    return F.substring(F.lit(LETTERS), F.pmod(place, F.lit(26)).cast("int") + 1, F.lit(1))


def renumber(ledger: DataFrame) -> DataFrame:
    """WIN-2: ``bubble`` anew: the balloon's number, and a letter where it has several rows.

    One sort of each drawing's rows: the number is a dense rank of (first page, first place).
    """
    kept = [c for c in ledger.columns if c != "bubble"]
    own = Window.partitionBy("doc_id", "uid").orderBy("seq")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ledger.select(
        *kept,
        F.first(F.coalesce("page", F.lit(0))).over(whole).alias("__page"),
        F.first("seq").over(whole).alias("__first"),
        F.count(F.lit(1)).over(whole).alias("__n"),
        F.row_number().over(own).alias("__i"),
    )
    num = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("__page", "__first"))
    label = F.concat(num.cast("string"), F.when(F.col("__n") > 1, letter(F.col("__i") - 1)).otherwise(""))
    return rows.withColumn("bubble", label).select(*kept, "bubble")


def next_bubble_number(ledger: DataFrame, page: Column) -> DataFrame:
    """WIN-3: for each drawing the number that a new balloon on ``page`` gets."""
    return ordered_uids(ledger).groupBy("doc_id").agg((F.count_if(F.col("first_page") <= page) + 1).alias("next_number"))


def set_number(ledger: DataFrame, moves: DataFrame) -> DataFrame:
    """WIN-4: ``moves(doc_id, uid, target)``, one for a drawing at most: the balloon goes to that number.

    The target is held within the balloon's page; rows are put together by balloon.
    """
    order = ordered_uids(ledger)
    page = Window.partitionBy("doc_id", "first_page")
    order = order.withColumns({"lo": F.min("num").over(page), "hi": F.max("num").over(page)})
    moved = order.join(moves, ["doc_id", "uid"]).select("doc_id", F.col("num").alias("was"), F.greatest("lo", F.least("hi", "target")).alias("now"))
    shifted = order.join(moved, "doc_id", "left").select(
        "doc_id",
        "uid",
        F.coalesce(
            F.when(F.col("num") == F.col("was"), F.col("now"))
            .when((F.col("was") < F.col("num")) & (F.col("num") <= F.col("now")), F.col("num") - 1)
            .when((F.col("now") <= F.col("num")) & (F.col("num") < F.col("was")), F.col("num") + 1),
            F.col("num"),
        ).alias("__num"),
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("__num", "seq")).cast("long")
    has = moved.select("doc_id", F.lit(True).alias("__moved"))
    rows = ledger.join(shifted, ["doc_id", "uid"]).join(has, "doc_id", "left")
    return rows.withColumn("seq", F.when(F.col("__moved"), place).otherwise(F.col("seq"))).select(*ledger.columns)


def remove_bubble(ledger: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """WIN-5: ``removed(doc_id, uid)`` -> the rows kept, numbered anew, and the rows gone."""
    return renumber(ledger.join(removed, ["doc_id", "uid"], "left_anti")), ledger.join(removed, ["doc_id", "uid"], "left_semi")


def migrate_uids(ledger: DataFrame) -> DataFrame:
    """WIN-6: rows without ``uid`` get one for each (page, base of bubble), in order of first place."""
    doc = Window.partitionBy("doc_id")
    key = Window.partitionBy("doc_id", "__key")
    missing = F.col("uid").isNull()
    rows = ledger.withColumn("__key", F.when(missing, F.struct(F.coalesce("page", F.lit(0)), F.coalesce(base_of(F.col("bubble")), F.lit(0)))))
    rows = rows.withColumn("__first", F.when(missing, F.min("seq").over(key))).withColumn("__top", F.coalesce(F.max("uid").over(doc), F.lit(0)))
    new = F.col("__top") + F.dense_rank().over(doc.orderBy(F.col("__first").asc_nulls_last()))
    return rows.withColumn("uid", F.when(missing, new).otherwise(F.col("uid"))).select(*ledger.columns)


def new_uids(ledger: DataFrame) -> DataFrame:
    """WIN-7: ``doc_id, uid_seq``: the counter from which new balloons count on."""
    return ledger.groupBy("doc_id").agg(F.coalesce(F.max("uid"), F.lit(0)).alias("uid_seq"))


def panel_order(number: Column, text: Column, descending: bool = False) -> list[Column]:
    """WIN-9: numbers first, by value, then texts; empty first."""
    keys = [F.when(F.coalesce(text, F.lit("")) == "", 0).when(number.isNotNull(), 1).otherwise(2), number, F.lower(text)]
    return [k.desc() for k in keys] if descending else [k.asc() for k in keys]


def walk_order(ledger: DataFrame) -> DataFrame:
    """WIN-10 and WIN-11: ``place`` in the measuring walk, the neighbours' ``seq``, and the first unmeasured."""
    by = Window.partitionBy("doc_id").orderBy(F.coalesce(base_of(F.col("bubble")), F.lit(0)), "bubble", "seq")
    doc = Window.partitionBy("doc_id")
    rows = ledger.withColumns({"place": F.row_number().over(by), "next_seq": F.lead("seq").over(by), "prev_seq": F.lag("seq").over(by)})
    unmeasured = F.coalesce("measured", F.lit("")) == ""
    return rows.withColumn("first_unmeasured", F.min(F.when(unmeasured, F.col("place"))).over(doc))


def jump_to(ledger: DataFrame) -> DataFrame:
    """WIN-11: ``doc_id, base, place``: where a jump to a balloon lands in the walk."""
    return walk_order(ledger).groupBy("doc_id", base_of(F.col("bubble")).alias("base")).agg(F.min("place").alias("place"))


def first_on_page(ledger: DataFrame) -> DataFrame:
    """FIL-12: the first row of each balloon number on a page; ``bx, by`` default to ``x, y``."""
    rank = F.row_number().over(Window.partitionBy("doc_id", F.coalesce("page", F.lit(0)), base_of(F.col("bubble"))).orderBy("seq"))
    rows = ledger.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return rows.withColumns({"bx": F.coalesce("bx", "x"), "by": F.coalesce("by", "y")})


def balloon_at(ledger: DataFrame, x: Column, y: Column, radius: float = 9.0) -> DataFrame:
    """FIL-13: the balloon drawn last whose square around its centre holds the point; one row for each page hit."""
    near = (F.abs(F.col("bx") - x) <= radius + 3) & (F.abs(F.col("by") - y) <= radius + 3)
    return first_on_page(ledger).where(near).groupBy("doc_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.max_by(base_of(F.col("bubble")), "seq").alias("base"))


def anchor_at(ledger: DataFrame, x: Column, y: Column, zoom: float = 1.0) -> DataFrame:
    """FIL-14: the same for anchors; balloons that sit on their anchor don't count."""
    reach = max(4.0, 5.0 / zoom)
    near = (F.abs(F.col("x") - x) <= reach) & (F.abs(F.col("y") - y) <= reach) & ~((F.col("bx") == F.col("x")) & (F.col("by") == F.col("y")))
    return first_on_page(ledger).where(near).groupBy("doc_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.max_by(base_of(F.col("bubble")), "seq").alias("base"))


def marquee(ledger: DataFrame, rect: tuple[float, float, float, float], selected: DataFrame | None = None) -> DataFrame:
    """FIL-15: ``doc_id, page, base`` of balloons whose centre is in the rectangle, added to ``selected``."""
    x0, y0, x1, y1 = rect
    hit = first_on_page(ledger).where(F.col("bx").between(x0, x1) & F.col("by").between(y0, y1)).select("doc_id", F.coalesce("page", F.lit(0)).alias("page"), base_of(F.col("bubble")).alias("base"))
    return (hit if selected is None else hit.union(selected)).distinct()


def toggled(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """SET-4: what is in one of the two selections but not in both."""
    return selected.exceptAll(clicked).union(clicked.exceptAll(selected)).distinct()


def status(ledger: DataFrame) -> DataFrame:
    """FIL-16, IO-16, AGG-7: rows, saved, unsaved, measured, and the first unmeasured row of a drawing."""
    empty = F.coalesce("measured", F.lit("")) == ""
    return ledger.groupBy("doc_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("sheet_row").isNotNull()).alias("n_saved"),
        F.count_if(F.col("sheet_row").isNull()).alias("n_unsaved"),
        F.count_if(~empty).alias("n_measured"),
        F.min(F.when(empty, F.col("seq"))).alias("next_unmeasured"),
    )


def clockwise(items: DataFrame) -> DataFrame:
    """WIN-12: ``items(doc_id, page, ord, ax, ay, anchored)`` with ``cw_ord``: by page and angle around its centre.

    The centre is the mean of the anchored items, or of all if none is; angles fall from 225°. Angles that
    agree to nine decimals are equal, and ``ord`` decides.
    """
    page = Window.partitionBy("doc_id", "page")
    centre = lambda c: F.coalesce(F.avg(F.when(F.col("anchored"), F.col(c))).over(page), F.avg(c).over(page))
    turn = F.degrees(F.atan2(F.col("__cy") - F.col("ay"), F.col("ax") - F.col("__cx")))
    rows = items.withColumns({"__cx": centre("ax"), "__cy": centre("ay")})
    # a whole turn more takes the last bits off, so what a rounded centre puts just below 0 is 0 and not 360
    within = lambda a: F.pmod(F.pmod(a, F.lit(360.0)) + 360.0, F.lit(360.0))
    rows = rows.withColumn("angle", within(F.lit(225.0) - within(turn)))
    order = Window.partitionBy("doc_id").orderBy("page", F.round("angle", 9), "ord")
    return rows.withColumn("cw_ord", F.row_number().over(order)).drop("__cx", "__cy")


def group_anchor(items: DataFrame) -> DataFrame:
    """WIN-13: ``gx, gy``: the anchor of the first item of each (page, cg) in ``cw_ord``."""
    by = Window.partitionBy("doc_id", "page", "cg").orderBy("cw_ord")
    return items.withColumns({"gx": F.first("ax").over(by), "gy": F.first("ay").over(by)})


def margin_slots(items: DataFrame, height: float, x: float = 16.0, top: float = 20.0, step: float = 24.0) -> DataFrame:
    """WIN-14: ``mx, my`` for unanchored items of a page, downwards from the top, starting over near the bottom."""
    slots = max(1, int((height - 20.0 - top) // step) + 1)
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")) - 1
    return items.withColumns({"mx": F.lit(x), "my": F.lit(top) + F.pmod(place, F.lit(slots)) * F.lit(step)})


def distribute(selected: DataFrame, axis: str) -> DataFrame:
    """WIN-15: three or more balloons of a page at even distances along ``axis``; else unchanged."""
    page = Window.partitionBy("doc_id", "page")
    place = F.row_number().over(page.orderBy(axis, "seq")) - 1
    n, low, high = F.count("*").over(page), F.min(axis).over(page), F.max(axis).over(page)
    rows = selected.withColumns({"__k": place, "__n": n, "__lo": low, "__hi": high})
    even = F.col("__lo") + F.col("__k") * ((F.col("__hi") - F.col("__lo")) / F.greatest(F.col("__n") - 1, F.lit(1)))
    return rows.withColumn(axis, F.when(F.col("__n") >= 3, even).otherwise(F.col(axis))).drop("__k", "__n", "__lo", "__hi")


def align(selected: DataFrame, axis: str) -> DataFrame:
    """WIN-16: two or more balloons of a page on their mean along ``axis``, leaving to the side that half their anchors lie on."""
    page = Window.partitionBy("doc_id", "page")
    anchor, far, near = ("y", "s", "n") if axis == "by" else ("x", "e", "w")
    rows = selected.withColumns({"__n": F.count("*").over(page), "__mean": F.avg(axis).over(page)})
    beyond = F.count_if(F.col(anchor) > F.col(axis)).over(page)
    rows = rows.withColumn("__far", beyond * 2 >= F.col("__n"))
    return rows.withColumns(
        {axis: F.when(F.col("__n") >= 2, F.col("__mean")).otherwise(F.col(axis)), "lexit": F.when(F.col("__n") >= 2, F.when(F.col("__far"), far).otherwise(near)).otherwise(F.col("lexit"))}
    ).drop("__n", "__mean", "__far")


def moved(ledger: DataFrame, selected: DataFrame, dx: float, dy: float) -> DataFrame:
    """WIN-17, MUT-10: rows of the selected ``(doc_id, page, base)`` shifted by the same way."""
    mark = selected.select(F.col("doc_id").alias("__doc"), F.col("page").alias("__page"), F.col("base").alias("__base")).distinct().withColumn("__hit", F.lit(True))
    on = (F.col("doc_id") == F.col("__doc")) & (F.coalesce("page", F.lit(0)) == F.col("__page")) & (base_of(F.col("bubble")) == F.col("__base"))
    rows = ledger.join(mark, on, "left")
    shift = lambda c, d, o: F.when(F.col("__hit"), F.coalesce(c, o) + d).otherwise(F.col(c))
    return rows.withColumns({"bx": shift("bx", dx, "x"), "by": shift("by", dy, "y")}).select(*ledger.columns)


def inserted(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """MUT-1, MUT-3: ``rows`` (no uid, seq or sheet_row) as one new balloon at the end of each drawing, numbered anew."""
    ends = ledger.groupBy("doc_id").agg(F.max("seq").alias("__seq"), F.max("uid").alias("__uid"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    new = rows.join(ends, "doc_id", "left").withColumns(
        {"seq": F.coalesce("__seq", F.lit(0)) + place, "uid": F.coalesce("__uid", F.lit(0)) + 1, "sheet_row": F.lit(None).cast("int")}
    )
    return renumber(ledger.unionByName(new.drop("__seq", "__uid", "ord"), allowMissingColumns=True))


def with_subrow(ledger: DataFrame, subrows: DataFrame) -> DataFrame:
    """MUT-4: ``subrows(doc_id, uid, ...)`` go behind the last row of their balloon, at its page and place."""
    own = ledger.groupBy("doc_id", "uid").agg(F.max("seq").alias("__last"), *[F.min_by(c, "seq").alias(c) for c in ("page", "x", "y", "bx", "by")])
    new = subrows.drop("page", "x", "y", "bx", "by").join(own, ["doc_id", "uid"]).withColumns({"seq": F.col("__last"), "__late": F.lit(1)}).drop("__last")
    both = ledger.withColumn("__late", F.lit(0)).unionByName(new, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "__late")).cast("long")
    return renumber(both.withColumn("seq", place).drop("__late"))


def without_rows(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    """MUT-5: without the rows ``gone(doc_id, seq)``; their sheet rows are free with them."""
    return renumber(ledger.join(gone, ["doc_id", "seq"], "left_anti"))


def without_bases(ledger: DataFrame, bases: DataFrame) -> DataFrame:
    """MUT-6: without all rows of balloons that have a row of ``bases(doc_id, base)``."""
    uids = ledger.withColumn("base", base_of(F.col("bubble"))).join(bases, ["doc_id", "base"], "left_semi").select("doc_id", "uid").distinct()
    return renumber(ledger.join(uids, ["doc_id", "uid"], "left_anti"))


def edited(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """MUT-7: ``edits(doc_id, seq, ...)`` replace the rows' columns but those of identity.

    ``leader`` goes to every row of the balloon.
    """
    fields = [c for c in edits.columns if c not in ("doc_id", "seq", *IDENTITY)]
    new = edits.select("doc_id", "seq", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__edit"))
    rows = ledger.join(new, ["doc_id", "seq"], "left")
    plain = {c: F.when(F.col("__edit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in fields if c != "leader"}
    if "leader" in fields:
        own = Window.partitionBy("doc_id", "uid")
        plain["leader"] = F.coalesce(F.max(F.when(F.col("__edit"), F.col("__leader"))).over(own), F.col("leader"))
    return rows.withColumns(plain).select(*ledger.columns)


def cell_edited(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """MUT-8, MUT-9: ``edits(doc_id, seq, field, value, ts)`` of measured, tier and gage; the latest counts.

    Values are trimmed, and empty ones become NULL.
    """
    last = edits.groupBy("doc_id", "seq").pivot("field", ["measured", "tier", "gage"]).agg(F.max_by(F.struct("value"), "ts"))
    last = last.select("doc_id", "seq", *[F.col(c).alias(f"__{c}") for c in ("measured", "tier", "gage")])
    rows = ledger.join(last, ["doc_id", "seq"], "left")
    new = lambda c: F.when(F.col(f"__{c}").isNotNull(), F.nullif(F.trim(F.col(f"__{c}.value")), F.lit(""))).otherwise(F.col(c))
    return rows.withColumns({c: new(c) for c in ("measured", "tier", "gage")}).select(*ledger.columns)


def migrated(ledger: DataFrame) -> DataFrame:
    """MUT-11: a loaded session: ``attr`` rows become finishes or GD&T by their group, missing uids are filled, all is numbered anew."""
    new = F.when(F.coalesce("group", F.lit("")).startswith("finish"), "finish / wykończenie").otherwise("GD&T")
    rows = ledger.withColumn("type", F.when(F.col("type") == "attr", new).otherwise(F.col("type")))
    return renumber(migrate_uids(rows))


def snapshot(history: DataFrame | None, ledger: DataFrame, version: int, depth: int = 50) -> DataFrame:
    """HIST-1: ``history`` with ``ledger`` as ``version``; later versions are forgotten and ``depth`` are kept."""
    new = ledger.withColumn("version", F.lit(version))
    old = [] if history is None else [history.where((F.col("version") < version) & (F.col("version") > version - depth))]
    return reduce(DataFrame.unionByName, [*old, new])


def at_version(history: DataFrame, steps: int) -> DataFrame:
    """HIST-2: the ledger ``steps`` versions back from the latest; the earliest kept if there are fewer."""
    versions = history.select("version").distinct().orderBy(F.desc("version")).limit(steps + 1)
    return history.join(F.broadcast(versions.agg(F.min("version").alias("version"))), "version", "left_semi").drop("version")


def restored(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HIST-3: after going from ``old`` to ``new``: the ledger numbered anew, and the sheet rows to clear."""
    keys = ["doc_id", "sheet_row"]
    gone = old.where("sheet_row IS NOT NULL").select(*keys).join(new.where("sheet_row IS NOT NULL").select(*keys), keys, "left_anti")
    return renumber(new), gone.distinct()


def panel_filter(ledger: DataFrame, needle: str, cells: list[Column]) -> DataFrame:
    """FIL-1, FIL-2: rows in which a visible cell's text holds the trimmed needle, in any case; an empty one finds all."""
    wanted = needle.strip().lower()
    return ledger.where(F.exists(F.array(*[F.coalesce(c, F.lit("")) for c in cells]), lambda c: F.contains(F.lower(c), F.lit(wanted)))) if wanted else ledger
