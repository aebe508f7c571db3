"""Queries over ledgers, with DuckDB SQL for each: numbering, verdicts, selection, edits, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pyfmt, verdict
from ..operators import history as H
from ..operators import ledger as L
from ..operators import rows as R
from ..schema import FIRST_ROW, LAST_ROW
from ..sources import scratch, sheet
from . import fixtures as X
from .fixtures import on_judged, on_ledger

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.renumber(X.ledger(spark, sf_dir))


def limit_args() -> tuple:
    return F.col("nominal"), F.col("tol_sym"), F.col("tol_max"), F.col("tol_min")


def judged(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "oot": verdict.out_of_tol(*limit_args(), F.col("measured")),
            "result": verdict.sheet_verdict(*limit_args(), F.col("offset"), F.col("pin"), F.col("measured")),
        }
    )


@query(
    "verdict_summary",
    on_judged("""SELECT doc_id, CAST(max(num) AS BIGINT) AS n_bubbles, count(*) AS n_rows, count(measured) AS n_measured, count(*) FILTER (result = 'PASS') AS n_pass, count(*) FILTER (result = 'FAIL') AS n_fail,
      count(*) FILTER (oot) AS n_out, CASE WHEN count(*) FILTER (result IN ('PASS', 'FAIL')) > 0 THEN CAST(count(*) FILTER (result = 'PASS') AS DOUBLE) / count(*) FILTER (result IN ('PASS', 'FAIL')) END AS yield
      FROM judged GROUP BY doc_id"""),
)
def verdict_summary(spark, sf_dir):
    """Slice 0: balloons numbered, measurements judged, counts and yield for each drawing."""
    rows = judged(numbered(spark, sf_dir)).withColumn("num", pyfmt.base_of(F.col("bubble")))
    return rows.groupBy("doc_id").agg(
        F.max("num").cast("long").alias("n_bubbles"),
        F.count("*").alias("n_rows"),
        F.count("measured").alias("n_measured"),
        F.count_if(F.col("result") == "PASS").alias("n_pass"),
        F.count_if(F.col("result") == "FAIL").alias("n_fail"),
        F.count_if("oot").alias("n_out"),
        F.try_divide(F.count_if(F.col("result") == "PASS").cast("double"), F.count_if(F.col("result").isin("PASS", "FAIL"))).alias("yield"),
    )


@query("WIN-1", on_ledger("SELECT doc_id, uid, first_page, first_seq, CAST(num AS INTEGER) AS num FROM ranks"))
def win_1(spark, sf_dir):
    return L.ordered_uids(X.ledger(spark, sf_dir)).select("doc_id", "uid", "first_page", "first_seq", "num")


@query("WIN-2", on_ledger("SELECT doc_id, seq, bubble FROM nled"))
def win_2(spark, sf_dir):
    return numbered(spark, sf_dir).select("doc_id", "seq", "bubble")


@query("WIN-3", on_ledger("SELECT doc_id, count(*) FILTER (first_page <= 1) + 1 AS next_number FROM firsts GROUP BY doc_id"))
def win_3(spark, sf_dir):
    return L.next_bubble_number(X.ledger(spark, sf_dir), F.lit(1))


@query(
    "WIN-4",
    on_ledger(
        "SELECT nled.doc_id, nled.uid, nled.seq AS old_seq, row_number() OVER (PARTITION BY nled.doc_id ORDER BY m.num, nled.seq) AS seq FROM nled JOIN moved m USING (doc_id, uid)",
        """, block AS (SELECT *, min(num) OVER (PARTITION BY doc_id, first_page) AS lo, max(num) OVER (PARTITION BY doc_id, first_page) AS hi FROM ranks),
        mv AS (SELECT doc_id, num AS was, greatest(lo, least(hi, 3)) AS now FROM (SELECT *, min(uid) OVER (PARTITION BY doc_id) AS u FROM block) WHERE uid = u),
        moved AS (SELECT r.doc_id, r.uid, CASE WHEN r.num = was THEN now WHEN was < r.num AND r.num <= now THEN r.num - 1 WHEN now <= r.num AND r.num < was THEN r.num + 1 ELSE r.num END AS num FROM ranks r JOIN mv USING (doc_id))""",
    ),
)
def win_4(spark, sf_dir):
    """The balloon with the lowest uid of each drawing goes to number 3."""
    led = X.ledger(spark, sf_dir)
    moves = led.groupBy("doc_id").agg(F.min("uid").alias("uid")).withColumn("target", F.lit(3))
    out = L.set_number(led.withColumn("old_seq", F.col("seq")), moves)
    return out.select("doc_id", "uid", "old_seq", "seq")


@query(
    "WIN-5",
    on_ledger(
        "SELECT k.doc_id, k.seq, r.num || CASE WHEN r.n > 1 THEN substr('abcdefghijklmnopqrstuvwxyz', CAST((row_number() OVER (PARTITION BY k.doc_id, k.uid ORDER BY k.seq) - 1) % 26 + 1 AS INTEGER), 1) ELSE '' END AS bubble FROM led k JOIN r USING (doc_id, uid)",
        ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_page, first_seq) AS num FROM firsts WHERE uid <> 2)",
    ),
)
def win_5(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    kept, _ = L.remove_bubble(led, led.where("uid = 2").select("doc_id", "uid").distinct())
    return kept.select("doc_id", "seq", "bubble")


@query(
    "WIN-6",
    on_ledger(
        "SELECT doc_id, seq, CASE WHEN gone THEN top + dense_rank() OVER (PARTITION BY doc_id ORDER BY first_gone NULLS LAST) ELSE uid END AS uid FROM c",
        """, a AS (SELECT *, uid % 2 = 0 AS gone FROM nled),
        b AS (SELECT *, CASE WHEN gone THEN page || '/' || num END AS key, coalesce(max(CASE WHEN NOT gone THEN uid END) OVER (PARTITION BY doc_id), 0) AS top FROM a),
        c AS (SELECT *, CASE WHEN gone THEN min(seq) OVER (PARTITION BY doc_id, key) END AS first_gone FROM b)""",
    ),
)
def win_6(spark, sf_dir):
    """Even uids forgotten and filled in again."""
    led = numbered(spark, sf_dir)
    return L.migrate_uids(led.withColumn("uid", F.when(F.col("uid") % 2 == 1, F.col("uid")))).select("doc_id", "seq", "uid")


@query("WIN-7", on_ledger("SELECT doc_id, max(uid) AS uid_seq FROM led GROUP BY doc_id"))
def win_7(spark, sf_dir):
    return L.new_uids(X.ledger(spark, sf_dir))


@query("WIN-8", on_ledger("SELECT doc_id, seq, num + CASE WHEN n > 1 THEN (ascii(substr(bubble, -1)) - 96) / 1000.0::DOUBLE ELSE 0 END AS sort_key FROM nled"))
def win_8(spark, sf_dir):
    return numbered(spark, sf_dir).select("doc_id", "seq", pyfmt.bubble_sortkey(F.col("bubble")).alias("sort_key"))


@query(
    "WIN-9",
    on_judged("""SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN coalesce(measured, '') = '' THEN 0 WHEN mnum IS NOT NULL THEN 1 ELSE 2 END, mnum NULLS FIRST, lower(measured) NULLS FIRST, seq) AS INTEGER) AS place FROM judged"""),
)
def win_9(spark, sf_dir):
    """Rows by what was measured: numbers by value, then words."""
    order = L.panel_order(pyfmt.fnum(F.col("measured")), F.col("measured"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order, "seq"))
    return X.ledger(spark, sf_dir).select("doc_id", "seq", place.alias("place"))


@query(
    "WIN-10",
    on_ledger("SELECT doc_id, seq, CAST(row_number() OVER w AS INTEGER) AS place, lead(seq) OVER w AS next_seq, lag(seq) OVER w AS prev_seq FROM nled WINDOW w AS (PARTITION BY doc_id ORDER BY num, bubble, seq)"),
)
def win_10(spark, sf_dir):
    return L.walk_order(numbered(spark, sf_dir)).select("doc_id", "seq", "place", "next_seq", "prev_seq")


@query(
    "WIN-11",
    on_ledger(
        "SELECT doc_id, CAST(num AS INTEGER) AS base, CAST(min(place) AS INTEGER) AS place, CAST(any_value(fu) AS INTEGER) AS first_unmeasured FROM v GROUP BY doc_id, num",
        """, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY num, bubble, seq) AS place FROM nled),
        v AS (SELECT *, min(CASE WHEN coalesce(measured, '') = '' THEN place END) OVER (PARTITION BY doc_id) AS fu FROM w)""",
    ),
)
def win_11(spark, sf_dir):
    """Where a jump to each balloon lands, and where the walk begins."""
    led = numbered(spark, sf_dir)
    begins = L.walk_order(led).groupBy("doc_id").agg(F.min("first_unmeasured").alias("first_unmeasured"))
    return L.jump_to(led).join(begins, "doc_id").select("doc_id", "base", "place", "first_unmeasured")


ITEMS_CTE = """, items AS (SELECT doc_id, page, seq AS ord, x AS ax, y AS ay, seq % 5 <> 0 AS anchored, CAST(uid % 3 AS INTEGER) AS cg FROM led),
 centred AS (SELECT *, coalesce(avg(CASE WHEN anchored THEN ax END) OVER p, avg(ax) OVER p) AS cx, coalesce(avg(CASE WHEN anchored THEN ay END) OVER p, avg(ay) OVER p) AS cy FROM items WINDOW p AS (PARTITION BY doc_id, page)),
 turned AS (SELECT *, degrees(atan2(cy - ay, ax - cx)) AS t FROM centred),
 angled AS (SELECT *, fmod(fmod(225.0::DOUBLE - fmod(fmod(t, 360) + 360, 360), 360) + 360, 360) AS angle FROM turned),
 cw AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, round(angle, 9), ord) AS cw_ord FROM angled)"""


def items(spark, sf_dir) -> DataFrame:
    return X.ledger(spark, sf_dir).select("doc_id", "page", F.col("seq").alias("ord"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("seq") % 5 != 0).alias("anchored"), (F.col("uid") % 3).cast("int").alias("cg"))


@query("WIN-12", on_ledger("SELECT doc_id, page, ord, round(angle, 6) AS angle FROM cw", ITEMS_CTE))
def win_12(spark, sf_dir):
    return L.clockwise(items(spark, sf_dir)).select("doc_id", "page", "ord", F.round("angle", 6).alias("angle"))


@query("WIN-13", on_ledger("SELECT doc_id, page, cg, ord, first(ax) OVER w AS gx, first(ay) OVER w AS gy FROM cw WINDOW w AS (PARTITION BY doc_id, page, cg ORDER BY cw_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", ITEMS_CTE))
def win_13(spark, sf_dir):
    return L.group_anchor(L.clockwise(items(spark, sf_dir))).select("doc_id", "page", "cg", "ord", "gx", "gy")


@query("WIN-14", on_ledger("SELECT doc_id, page, ord, 16.0::DOUBLE AS mx, 20.0::DOUBLE + (row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1) % 3 * 24.0::DOUBLE AS my FROM items WHERE NOT anchored", ITEMS_CTE))
def win_14(spark, sf_dir):
    return L.margin_slots(items(spark, sf_dir).where("NOT anchored"), 100.0).select("doc_id", "page", "ord", "mx", "my")


@query(
    "WIN-15",
    on_ledger("SELECT doc_id, page, seq, CASE WHEN n3 >= 3 THEN lo + (r - 1) * ((hi - lo) / greatest(n3 - 1, 1)) ELSE bx END AS bx FROM (SELECT *, count(*) OVER p AS n3, min(bx) OVER p AS lo, max(bx) OVER p AS hi, row_number() OVER (PARTITION BY doc_id, page ORDER BY bx, seq) AS r FROM led WINDOW p AS (PARTITION BY doc_id, page))"),
)
def win_15(spark, sf_dir):
    return L.distribute(X.ledger(spark, sf_dir), "bx").select("doc_id", "page", "seq", "bx")


@query(
    "WIN-16",
    on_ledger("""SELECT doc_id, page, seq, CASE WHEN n2 >= 2 THEN m ELSE "by" END AS "by", CASE WHEN n2 >= 2 THEN CASE WHEN below * 2 >= n2 THEN 's' ELSE 'n' END END AS lexit
      FROM (SELECT *, count(*) OVER p AS n2, avg("by") OVER p AS m, count(*) FILTER (y > "by") OVER p AS below FROM led WINDOW p AS (PARTITION BY doc_id, page))"""),
)
def win_16(spark, sf_dir):
    return L.align(X.ledger(spark, sf_dir), "by").select("doc_id", "page", "seq", "by", "lexit")


@query(
    "WIN-17",
    on_ledger('SELECT nled.doc_id, seq, CASE WHEN s.num IS NULL THEN bx ELSE bx + 5 END AS bx, CASE WHEN s.num IS NULL THEN "by" ELSE "by" - 3 END AS "by" FROM nled LEFT JOIN s ON s.doc_id = nled.doc_id AND s.page = nled.page AND s.num = nled.num', ", s AS (SELECT DISTINCT doc_id, page, num FROM nled WHERE bx < 100)"),
)
def win_17(spark, sf_dir):
    led = numbered(spark, sf_dir)
    chosen = led.where("bx < 100").select("doc_id", "page", pyfmt.base_of(F.col("bubble")).alias("base"))
    return L.moved(led, chosen, 5.0, -3.0).select("doc_id", "seq", "bx", "by")


CELLS_SQL = "concat_ws('|', bubble, type, feature, coalesce(measured, ''), tier)"


@query("FIL-1", on_ledger("SELECT doc_id, seq FROM nled WHERE contains(lower(bubble), 'ot') OR contains(lower(type), 'ot') OR contains(lower(feature), 'ot') OR contains(lower(coalesce(measured, '')), 'ot') OR contains(lower(tier), 'ot')"))
def fil_1(spark, sf_dir):
    led = numbered(spark, sf_dir)
    return L.panel_filter(led, " OT ", [F.col(c) for c in ("bubble", "type", "feature", "measured", "tier")]).select("doc_id", "seq")


@query("FIL-2", on_ledger("SELECT doc_id, seq, bubble, tier FROM nled WHERE contains(lower(tier), 're') OR contains(bubble, 're')"))
def fil_2(spark, sf_dir):
    """With other columns hidden, only the visible ones are shown and searched."""
    visible = ("bubble", "tier")
    return L.panel_filter(numbered(spark, sf_dir), "re", [F.col(c) for c in visible]).select("doc_id", "seq", *visible)


TOL_SQL = """CASE WHEN tol_sym IS NOT NULL THEN '±' || printf('%g', tol_sym) WHEN tol_max IS NULL AND tol_min IS NULL THEN ''
  WHEN tol_max IS NOT NULL AND tol_min IS NOT NULL THEN printf('%+g', greatest(tol_max, tol_min)) || '/' || printf('%+g', least(tol_max, tol_min)) ELSE printf('%+g', coalesce(tol_max, tol_min)) || '/?' END"""


@query("FIL-3", on_ledger(f"SELECT doc_id, seq, printf('%.2f', nominal) AS nominal, CASE WHEN pin IS NULL THEN '' ELSE printf('%g', pin) END AS pin, {TOL_SQL} AS tol, coalesce(measured, '') AS measured FROM nled"))
def fil_3(spark, sf_dir):
    cells = sheet.cell_texts()
    return X.ledger(spark, sf_dir).select("doc_id", "seq", *[cells[c].alias(c) for c in ("nominal", "pin", "tol", "measured")])


FIRST_CTE = ", fop AS (SELECT * FROM nled QUALIFY row_number() OVER (PARTITION BY doc_id, page, num ORDER BY seq) = 1)"


@query("FIL-12", on_ledger("SELECT doc_id, page, CAST(num AS INTEGER) AS base, seq FROM fop", FIRST_CTE))
def fil_12(spark, sf_dir):
    return L.first_on_page(numbered(spark, sf_dir)).select("doc_id", "page", pyfmt.base_of(F.col("bubble")).alias("base"), "seq")


@query("FIL-13", on_ledger('SELECT doc_id, page, CAST(arg_max(num, seq) AS INTEGER) AS base FROM fop WHERE abs(bx - 300) <= 62 AND abs("by" - 400) <= 62 GROUP BY doc_id, page', FIRST_CTE))
def fil_13(spark, sf_dir):
    return L.balloon_at(numbered(spark, sf_dir), F.lit(300.0), F.lit(400.0), radius=59.0)


@query("FIL-14", on_ledger('SELECT doc_id, page, CAST(arg_max(num, seq) AS INTEGER) AS base FROM fop WHERE abs(x - 300) <= 50 AND abs(y - 400) <= 50 AND NOT (bx = x AND "by" = y) GROUP BY doc_id, page', FIRST_CTE))
def fil_14(spark, sf_dir):
    return L.anchor_at(numbered(spark, sf_dir), F.lit(300.0), F.lit(400.0), zoom=0.1)


@query("FIL-15", on_ledger('SELECT DISTINCT doc_id, page, CAST(num AS INTEGER) AS base FROM fop WHERE bx BETWEEN 100 AND 300 AND "by" BETWEEN 100 AND 500', FIRST_CTE))
def fil_15(spark, sf_dir):
    return L.marquee(numbered(spark, sf_dir), (100.0, 100.0, 300.0, 500.0))


@query("FIL-16", on_ledger("SELECT doc_id, count(*) AS n_rows, count(sheet_row) AS n_saved, count(*) - count(sheet_row) AS n_unsaved, count(*) FILTER (coalesce(measured, '') <> '') AS n_measured, min(CASE WHEN coalesce(measured, '') = '' THEN seq END) AS next_unmeasured FROM led GROUP BY doc_id"))
def fil_16(spark, sf_dir):
    return L.status(X.ledger(spark, sf_dir))


@query("AGG-7", on_ledger("SELECT count(*) AS n_rows, count(sheet_row) AS n_saved, count(*) - count(sheet_row) AS n_unsaved FROM led"))
def agg_7(spark, sf_dir):
    return L.status(X.ledger(spark, sf_dir)).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_saved", "n_unsaved")])


@query("IO-16", on_ledger("SELECT doc_id, count(*) AS n_rows, count(sheet_row) AS n_saved, count(sheet_row) > 0 AS sheet_exists FROM led GROUP BY doc_id"))
def io_16(spark, sf_dir):
    return L.status(X.ledger(spark, sf_dir)).select("doc_id", "n_rows", "n_saved", (F.col("n_saved") > 0).alias("sheet_exists"))


@query("NUM-1", on_judged("SELECT doc_id, seq, mnum AS number, mnum IS NULL AND coalesce(trim(measured), '') <> '' AS garbage FROM judged"))
def num_1(spark, sf_dir):
    m = F.col("measured")
    return X.ledger(spark, sf_dir).select("doc_id", "seq", pyfmt.fnum(m).alias("number"), pyfmt.is_garbage(m).alias("garbage"))


@query(
    "NUM-2",
    on_judged("""SELECT doc_id, seq, CAST(CASE WHEN coalesce(trim(measured), '') = '' THEN NULL WHEN contains(replace(measured, ',', '.'), '.') THEN length(trim(measured)) - strpos(replace(trim(measured), ',', '.'), '.') ELSE 0 END AS INTEGER) AS dp_text,
      CAST(CASE WHEN tol_sym IS NULL THEN NULL WHEN contains(printf('%g', tol_sym), '.') THEN length(printf('%g', tol_sym)) - strpos(printf('%g', tol_sym), '.') ELSE 0 END AS INTEGER) AS dp_number FROM judged"""),
)
def num_2(spark, sf_dir):
    return X.ledger(spark, sf_dir).select("doc_id", "seq", pyfmt.dp_of_text(F.col("measured")).alias("dp_text"), pyfmt.dp_of_number(F.col("tol_sym")).alias("dp_number"))


@query("NUM-3", on_judged("SELECT doc_id, seq, CASE WHEN coalesce(trim(measured), '') = '' THEN NULL WHEN contains(replace(measured, ',', '.'), '.') THEN CASE length(trim(measured)) - strpos(replace(trim(measured), ',', '.'), '.') WHEN 0 THEN 0.5 WHEN 1 THEN 0.2 WHEN 2 THEN 0.1 ELSE 0.05 END ELSE 0.5 END::DOUBLE AS tol FROM judged"))
def num_3(spark, sf_dir):
    tols = {"0": 0.5, "1": 0.2, "2": 0.1, "3": 0.05}
    return X.ledger(spark, sf_dir).select("doc_id", "seq", pyfmt.dp_tol(pyfmt.dp_of_text(F.col("measured")), True, tols).alias("tol"))


@query("NUM-4", on_judged("SELECT doc_id, seq, lo, hi FROM judged"))
def num_4(spark, sf_dir):
    lim = verdict.limits(*limit_args())
    return X.ledger(spark, sf_dir).select("doc_id", "seq", lim["lo"].alias("lo"), lim["hi"].alias("hi"))


@query("NUM-5", on_judged("SELECT doc_id, seq, oot FROM judged"))
def num_5(spark, sf_dir):
    return judged(X.ledger(spark, sf_dir)).select("doc_id", "seq", "oot")


@query("NUM-6", on_ledger("SELECT doc_id, seq, CAST(num AS INTEGER) AS base FROM nled"))
def num_6(spark, sf_dir):
    return numbered(spark, sf_dir).select("doc_id", "seq", pyfmt.base_of(F.col("bubble")).alias("base"))


@query("FMT-1", on_ledger(f"SELECT doc_id, seq, {TOL_SQL} AS tol FROM nled"))
def fmt_1(spark, sf_dir):
    return X.ledger(spark, sf_dir).select("doc_id", "seq", verdict.tol_text(F.col("tol_sym"), F.col("tol_max"), F.col("tol_min")).alias("tol"))


@query("SHT-1", on_judged("SELECT doc_id, seq, k AS target FROM judged"))
def sht_1(spark, sf_dir):
    return X.ledger(spark, sf_dir).select("doc_id", "seq", verdict.bench_target(F.col("nominal"), F.col("offset"), F.col("pin")).alias("target"))


@query("SHT-2", on_judged("SELECT doc_id, seq, result FROM judged"))
def sht_2(spark, sf_dir):
    return judged(X.ledger(spark, sf_dir)).select("doc_id", "seq", "result")


SUMMARY_SQL = "count(*) AS n_rows, count(measured) AS n_measured, count(*) FILTER (result = 'PASS') AS n_pass, count(*) FILTER (result = 'FAIL') AS n_fail, CASE WHEN count(*) FILTER (result <> '') > 0 THEN CAST(count(*) FILTER (result = 'PASS') AS DOUBLE) / count(*) FILTER (result <> '') END AS yield"


@query("SHT-3", on_judged(f"SELECT doc_id, {SUMMARY_SQL} FROM judged GROUP BY doc_id"))
def sht_3(spark, sf_dir):
    return sheet.summary(judged(X.ledger(spark, sf_dir)), "doc_id")


@query("AGG-6", on_judged(f"SELECT type, {SUMMARY_SQL} FROM judged GROUP BY type"))
def agg_6(spark, sf_dir):
    return sheet.summary(judged(X.ledger(spark, sf_dir)), "type")


@query("SHT-4", on_judged("SELECT doc_id, seq, CASE result WHEN 'PASS' THEN 'green' WHEN 'FAIL' THEN 'red' ELSE '' END AS sheet_style, CASE WHEN oot THEN 'red' ELSE '' END AS panel_style FROM judged"))
def sht_4(spark, sf_dir):
    rows = judged(X.ledger(spark, sf_dir))
    return rows.select("doc_id", "seq", sheet.sheet_style(F.col("result")).alias("sheet_style"), sheet.panel_style(F.col("oot")).alias("panel_style"))


@query("SHT-5", on_ledger(f"SELECT column_name, value, n FROM (SELECT 'type' AS column_name, type AS value, count(*) AS n FROM led WHERE type NOT IN ({', '.join(repr(t) for t in sheet.TYPE_LIST)}) GROUP BY type UNION ALL SELECT 'tier', tier, count(*) FROM led WHERE tier NOT IN ('red', 'blue', 'green') GROUP BY tier)"))
def sht_5(spark, sf_dir):
    """Values outside the template's drop-down lists; rows are never refused."""
    return sheet.outside_lists(X.ledger(spark, sf_dir))


@query(
    "IO-11",
    on_ledger(
        "SELECT t.doc_id, t.seq, f.slot AS sheet_row FROM todo t LEFT JOIN free f ON t.doc_id = f.doc_id AND t.r = f.r",
        f""", todo AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM led WHERE sheet_row IS NULL),
        slots AS (SELECT doc_id, slot FROM (SELECT DISTINCT doc_id FROM todo), (SELECT CAST(unnest(range({FIRST_ROW}, {LAST_ROW + 1})) AS INTEGER) AS slot)),
        free AS (SELECT doc_id, slot, row_number() OVER (PARTITION BY doc_id ORDER BY slot) AS r FROM slots WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.doc_id = slots.doc_id AND led.sheet_row = slots.slot))""",
    ),
)
def io_11(spark, sf_dir):
    return sheet.allocated(X.ledger(spark, sf_dir)).where("is_new").select("doc_id", "seq", "sheet_row")


@query("IO-12", on_judged("SELECT doc_id, seq, bubble AS a_text, nominal AS e_num, tol_sym AS f_num, mnum AS l_num, CASE WHEN mnum IS NULL THEN nullif(measured, '') END AS l_text FROM judged"))
def io_12(spark, sf_dir):
    return sheet.cells(numbered(spark, sf_dir)).select("doc_id", "seq", "a_text", "e_num", "f_num", "l_num", "l_text")


@query("IO-9", on_ledger("SELECT doc_id, count(*) AS n_rows, 0::BIGINT AS n_before FROM led GROUP BY doc_id"))
def io_9(spark, sf_dir):
    """A sheet made empty, filled, and left alone by being made once more."""
    path, led = scratch.new_folder(spark, "sheet"), numbered(spark, sf_dir)
    sheet.ensure_sheet(led, path)
    before = sheet.read_sheet(spark, path).count()
    sheet.write_sheet(led, path)
    sheet.ensure_sheet(led, path)
    return sheet.read_sheet(spark, path).groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.lit(before).cast("long").alias("n_before"))


@query("IO-14", on_judged("SELECT doc_id, seq, bubble AS a_text, nominal AS e_num, mnum AS l_num, sheet_row FROM judged"))
def io_14(spark, sf_dir):
    """A whole sheet saved over an earlier one and read back."""
    path, led = scratch.new_folder(spark, "sheet"), numbered(spark, sf_dir)
    sheet.write_sheet(led.where("page = 0"), path)
    sheet.write_sheet(led, path)
    return sheet.read_sheet(spark, path).select("doc_id", "seq", "a_text", "e_num", "l_num", "sheet_row")


@query("IO-13", on_ledger("SELECT doc_id, sheet_row FROM led WHERE sheet_row IS NOT NULL AND uid <> 1"))
def io_13(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    written = led.where("sheet_row IS NOT NULL").select("doc_id", "sheet_row", "uid")
    return sheet.cleared(written, written.where("uid = 1").select("doc_id", "sheet_row")).select("doc_id", "sheet_row")


@query(
    "IO-15",
    on_ledger(
        """SELECT doc_id, page, CAST(num AS INTEGER) AS base, bx, "by", CASE WHEN d > 0 THEN bx + (x - bx) / d * 9 ELSE bx END AS sx, CASE WHEN d > 0 THEN "by" + (y - "by") / d * 9 ELSE "by" END AS sy, x, y FROM (SELECT *, sqrt((x - bx) * (x - bx) + (y - "by") * (y - "by")) AS d FROM fop)""",
        FIRST_CTE,
    ),
)
def io_15(spark, sf_dir):
    return sheet.draw_list(numbered(spark, sf_dir)).select("doc_id", "page", "base", "bx", "by", "sx", "sy", "x", "y")


@query("ROW-5", on_ledger("""SELECT doc_id, seq, CASE WHEN starts_with(type, 'thread') THEN 'GO gauge' WHEN starts_with("group", 'GD&T') OR starts_with(type, 'position') OR starts_with("group", 'positions') THEN 'CMM'
  WHEN coalesce(tol_sym, (greatest(tol_max, tol_min) - least(tol_max, tol_min) + 0 * (tol_max + tol_min)) / 2) <= 0.01 THEN 'CMM' WHEN coalesce(tol_sym, (greatest(tol_max, tol_min) - least(tol_max, tol_min) + 0 * (tol_max + tol_min)) / 2) <= 0.03 THEN 'micrometer'
  WHEN starts_with(type, 'hole') OR starts_with(type, 'thru') THEN 'pin / bore gauge' ELSE 'caliper' END AS gage FROM led"""))
def row_5(spark, sf_dir):
    return X.ledger(spark, sf_dir).select("doc_id", "seq", R.suggest_gage(F.col("type"), F.col("group"), F.col("tol_sym"), F.col("tol_max"), F.col("tol_min")).alias("gage"))


@query("ROW-9", on_ledger("SELECT doc_id, seq, round(100 - nominal, 4) AS nominal, feature || ' (inv ' || printf('%g', nominal) || ' z/of ' || printf('%g', 100.0) || ')' AS feature FROM led"))
def row_9(spark, sf_dir):
    new = R.inverse_dimension(F.lit(100.0), F.col("nominal"), F.col("feature"))
    return X.ledger(spark, sf_dir).select("doc_id", "seq", new["nominal"].alias("nominal"), new["feature"].alias("feature"))


@query(
    "MUT-1",
    on_ledger("SELECT doc_id, CAST(max(seq) + 1 AS BIGINT) AS seq, max(uid) + 1 AS uid, CAST(count(DISTINCT uid) + 1 AS VARCHAR) AS bubble FROM led GROUP BY doc_id"),
)
def mut_1(spark, sf_dir):
    """A new balloon of one row on the last page of each drawing."""
    led = X.ledger(spark, sf_dir)
    new = led.select("doc_id").distinct().select("doc_id", F.lit(1).alias("ord"), F.lit(9).alias("page"), F.lit("dim").alias("type"), F.lit("7").alias("feature"))
    return L.inserted(led, new).where("page = 9").select("doc_id", "seq", "uid", "bubble")


@query(
    "MUT-3",
    on_ledger("SELECT doc_id, max(uid) + 1 AS uid, (count(DISTINCT uid) + 1) || unnest(['a', 'b', 'c']) AS bubble FROM led GROUP BY doc_id"),
)
def mut_3(spark, sf_dir):
    """Three rows as one balloon."""
    led = X.ledger(spark, sf_dir)
    new = led.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ord")).select("doc_id", "ord", F.lit(9).alias("page"), F.lit("dim").alias("type"))
    return L.inserted(led, new).where("page = 9").select("doc_id", "uid", "bubble")


@query(
    "MUT-4",
    on_ledger(
        """SELECT doc_id, uid, seq, feature, page FROM (SELECT doc_id, uid, row_number() OVER (PARTITION BY doc_id ORDER BY seq, late) AS seq, feature, page, late FROM b) WHERE late = 1""",
        """, own AS (SELECT doc_id, uid, max(seq) AS last, arg_min(page, seq) AS page FROM led GROUP BY doc_id, uid),
        b AS (SELECT doc_id, uid, seq, feature, page, 0 AS late FROM led UNION ALL SELECT doc_id, uid, last, 'sub', page, 1 FROM own WHERE uid = 1)""",
    ),
)
def mut_4(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    subs = led.where("uid = 1").select("doc_id", "uid").distinct().withColumn("feature", F.lit("sub"))
    return L.with_subrow(led, subs).where("feature = 'sub'").select("doc_id", "uid", "seq", "feature", "page")


@query(
    "MUT-5",
    on_ledger(
        "SELECT k.doc_id, k.seq, r.num || CASE WHEN r.n > 1 THEN substr('abcdefghijklmnopqrstuvwxyz', CAST((row_number() OVER (PARTITION BY k.doc_id, k.uid ORDER BY k.seq) - 1) % 26 + 1 AS INTEGER), 1) ELSE '' END AS bubble FROM kept k JOIN r USING (doc_id, uid)",
        """, kept AS (SELECT * FROM led WHERE seq <> 1), f2 AS (SELECT doc_id, uid, min(seq) AS fs, arg_min(page, seq) AS fp, count(*) AS n FROM kept GROUP BY doc_id, uid),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fp, fs) AS num FROM f2)""",
    ),
)
def mut_5(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    return L.without_rows(led, led.where("seq = 1").select("doc_id", "seq")).select("doc_id", "seq", "bubble")


@query("MUT-6", on_ledger("SELECT doc_id, count(*) AS n_rows, count(DISTINCT uid) AS n_bubbles FROM nled WHERE num NOT IN (1, 3) GROUP BY doc_id"))
def mut_6(spark, sf_dir):
    led = numbered(spark, sf_dir)
    bases = led.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("base"))
    return L.without_bases(led, bases).groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.countDistinct("uid").alias("n_bubbles"))


@query("MUT-7", on_ledger("SELECT doc_id, seq, CASE WHEN seq = 2 THEN 'edited' ELSE feature END AS feature, measured, CASE WHEN uid = eu THEN true ELSE false END AS leader FROM (SELECT *, max(CASE WHEN seq = 2 THEN uid END) OVER (PARTITION BY doc_id) AS eu FROM led)"))
def mut_7(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    edits = led.where("seq = 2").select("doc_id", "seq", F.lit("edited").alias("feature"), F.lit("ignored").alias("measured"), F.lit(True).alias("leader"))
    return L.edited(led, edits).select("doc_id", "seq", "feature", "measured", "leader")


@query("MUT-8", on_ledger("SELECT doc_id, seq, CASE WHEN seq = 1 THEN '9,99' WHEN seq = 2 THEN NULL ELSE measured END AS measured, CASE WHEN seq = 1 THEN 'caliper' END AS gage FROM led"))
def mut_8(spark, sf_dir):
    """Measurements typed in, the latest counting; an empty one clears the cell."""
    led = X.ledger(spark, sf_dir)
    typed = F.array(*[F.struct(F.lit(s).alias("at"), F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(t).alias("ts")) for s, f, v, t in ((1, "measured", "1", 1), (1, "measured", " 9,99 ", 2), (2, "measured", " ", 1), (1, "gage", "caliper", 1))])
    edits = led.where("seq <= 2").select("doc_id", "seq", F.explode(typed).alias("e")).where("e.at = seq").select("doc_id", "seq", "e.field", "e.value", "e.ts")
    return L.cell_edited(led, edits).select("doc_id", "seq", "measured", "gage")


@query("MUT-9", on_ledger("SELECT doc_id, seq, CASE WHEN coalesce(measured, '') = '' AND seq % 2 = 1 THEN CAST(CAST(nominal AS INTEGER) AS VARCHAR) ELSE measured END AS measured, CASE WHEN seq % 3 = 0 THEN 'CMM' END AS gage FROM led"))
def mut_9(spark, sf_dir):
    """A walk that measures every other unmeasured row, the last entry counting, and overrides gages."""
    led = X.ledger(spark, sf_dir)
    todo = led.where("coalesce(measured, '') = '' AND seq % 2 = 1")
    first = todo.select("doc_id", "seq", F.lit("measured").alias("field"), F.lit("0").alias("value"), F.lit(1).alias("ts"))
    last = todo.select("doc_id", "seq", F.lit("measured").alias("field"), F.col("nominal").cast("int").cast("string").alias("value"), F.lit(2).alias("ts"))
    gages = led.where("seq % 3 = 0").select("doc_id", "seq", F.lit("gage").alias("field"), F.lit(" CMM ").alias("value"), F.lit(1).alias("ts"))
    return L.cell_edited(led, first.union(last).union(gages)).select("doc_id", "seq", "measured", "gage")


@query("MUT-10", on_ledger("SELECT nled.doc_id, seq, CASE WHEN page = 0 AND num = 1 THEN bx + 40 ELSE bx END AS bx, CASE WHEN page = 0 AND num = 1 THEN \"by\" - 7 ELSE \"by\" END AS \"by\" FROM nled"))
def mut_10(spark, sf_dir):
    led = numbered(spark, sf_dir)
    return L.moved(led, led.where("page = 0").select("doc_id", "page", F.lit(1).alias("base")), 40.0, -7.0).select("doc_id", "seq", "bx", "by")


@query("MUT-11", on_ledger("""SELECT doc_id, seq, CASE WHEN uid IN (2, 8) THEN CASE WHEN starts_with("group", 'finish') THEN 'finish / wykończenie' ELSE 'GD&T' END ELSE type END AS type, bubble FROM nled"""))
def mut_11(spark, sf_dir):
    old = numbered(spark, sf_dir).withColumn("type", F.when(F.col("uid").isin(2, 8), "attr").otherwise(F.col("type")))
    return L.migrated(old).select("doc_id", "seq", "type", "bubble")


def versions(spark, sf_dir) -> DataFrame:
    led = X.ledger(spark, sf_dir).select("doc_id", "seq", "uid", "page", "measured", "sheet_row")
    history = None
    for v in range(1, 4):
        history = L.snapshot(history, led.withColumn("measured", F.when(F.col("seq") <= 4 - v, F.col("measured"))), v, depth=2)
    return history


@query("HIST-1", on_ledger("SELECT v AS version, count(*) AS n FROM led, (SELECT unnest([2, 3])::INTEGER AS v) GROUP BY v"))
def hist_1(spark, sf_dir):
    return versions(spark, sf_dir).groupBy("version").agg(F.count("*").alias("n"))


@query("HIST-2", on_ledger("SELECT doc_id, seq, CASE WHEN seq <= 2 THEN measured END AS measured FROM led"))
def hist_2(spark, sf_dir):
    return L.at_version(versions(spark, sf_dir), 1).select("doc_id", "seq", "measured")


@query("HIST-3", on_ledger("SELECT doc_id, sheet_row FROM led WHERE sheet_row IS NOT NULL AND seq > 2"))
def hist_3(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    return L.restored(led, led.where("seq <= 2"))[1]


# a drawing's commands: sixteen, by its number and their place; every edit changes, deletes and inserts some rows
N_COMMANDS, UNDO_DEPTH = 16, 4
COMMANDS_CTE = f"""docs AS (SELECT DISTINCT doc_id, CAST(doc_id AS BIGINT) AS d FROM led),
commands AS (SELECT doc_id, CAST(n AS BIGINT) AS version, CASE (d * 7 + n * n * 5 + n // 3) % 7 WHEN 0 THEN 'undo' WHEN 1 THEN 'undo' WHEN 2 THEN 'undo' WHEN 3 THEN 'redo' WHEN 4 THEN 'redo' ELSE 'edit' END AS op FROM docs, (SELECT unnest(range(1, {N_COMMANDS + 1})) AS n)),
told AS (SELECT doc_id, list(op ORDER BY version) AS ops FROM commands GROUP BY doc_id)"""
POINTERS_SQL = f"""fold AS (
  SELECT doc_id, ops, 0 AS n, CAST([] AS BIGINT[]) AS applied, CAST([] AS BIGINT[]) AS undone, 0 AS undoable FROM told
  UNION ALL
  SELECT doc_id, ops, n + 1,
    CASE WHEN ops[n + 1] = 'edit' THEN list_append(applied, n + 1) WHEN ops[n + 1] = 'undo' AND undoable > 0 THEN applied[1 : len(applied) - 1] WHEN ops[n + 1] = 'redo' AND len(undone) > 0 THEN list_append(applied, undone[len(undone)]) ELSE applied END,
    CASE WHEN ops[n + 1] = 'edit' THEN [] WHEN ops[n + 1] = 'undo' AND undoable > 0 THEN list_append(undone, applied[len(applied)]) WHEN ops[n + 1] = 'redo' AND len(undone) > 0 THEN undone[1 : len(undone) - 1] ELSE undone END,
    CASE WHEN ops[n + 1] = 'edit' THEN least(undoable + 1, {UNDO_DEPTH}) WHEN ops[n + 1] = 'undo' AND undoable > 0 THEN undoable - 1 WHEN ops[n + 1] = 'redo' AND len(undone) > 0 THEN undoable + 1 ELSE undoable END
  FROM fold WHERE n < {N_COMMANDS}
), state AS (SELECT doc_id, applied, undone, undoable FROM fold WHERE n = {N_COMMANDS})"""
#: what version n does to a row; rows of odd sequence numbers above 1000 are such as an edit inserts
EDITS_CTE = """keyed AS (SELECT doc_id, seq AS rid, measured, sheet_row FROM led), slots AS (SELECT doc_id, rid, true AS base FROM keyed UNION ALL SELECT doc_id, rid + 1000, false FROM keyed),
acts AS (SELECT s.doc_id, rid, version, (rid + version) % 5 = 0 AS drops FROM slots s JOIN commands c ON c.doc_id = s.doc_id AND op = 'edit' AND CASE WHEN base THEN (rid + version) % 5 < 2 ELSE (rid + version) % 4 = 0 END)"""


def history_commands(spark, sf_dir) -> DataFrame:
    docs = X.ledger(spark, sf_dir).select("doc_id").distinct()
    n, d = F.col("version"), F.col("doc_id").cast("long")
    k = (d * 7 + n * n * 5 + F.floor(n / 3)) % 7
    rows = docs.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N_COMMANDS).cast("long"))).alias("version"))
    return rows.withColumn("op", F.when(k <= 2, "undo").when(k <= 4, "redo").otherwise("edit"))


def history_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base ledgers, the log of all edits, and the commands."""
    base = X.ledger(spark, sf_dir).select("doc_id", F.col("seq").alias("rid"), "measured", "sheet_row")
    commands = history_commands(spark, sf_dir)
    slots = base.select("doc_id", "rid", "sheet_row", F.lit(True).alias("base")).unionByName(base.select("doc_id", F.col("rid") + 1000, F.lit(None).cast("int"), F.lit(False)).toDF("doc_id", "rid", "sheet_row", "base"))
    k = F.col("rid") + F.col("version")
    acts = slots.join(commands.where("op = 'edit'").select("doc_id", "version"), "doc_id").where(F.when(F.col("base"), k % 5 < 2).otherwise(k % 4 == 0))
    row = F.struct(F.concat(F.lit("v"), F.col("version").cast("string")).alias("measured"), "sheet_row")
    return base, acts.select("doc_id", "rid", "version", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("struct<measured:string,sheet_row:int>").alias("before"), F.when(k % 5 != 0, row).alias("after")), commands


@query("HIST-1-log", on_ledger("""SELECT doc_id, seq, CASE WHEN del THEN 'deleted' WHEN ins THEN 'inserted' ELSE 'changed' END AS kind, CASE WHEN NOT ins THEN measured END AS old, CASE WHEN del THEN NULL WHEN ins THEN measured ELSE coalesce(measured, '-') || '!' END AS new
  FROM (SELECT *, seq % 3 = 0 AS del, seq % 3 = 1 AND page = 1 AS ins FROM led) WHERE del OR ins OR uid % 2 = 0"""))
def hist_1_log(spark, sf_dir):
    """Rows that differ between two states of every ledger: some dropped, some new, some measured again."""
    led = X.ledger(spark, sf_dir).select("doc_id", F.col("seq").alias("rid"), "uid", "page", "measured")
    ins = (F.col("rid") % 3 == 1) & (F.col("page") == 1)
    after = led.where("rid % 3 <> 0").withColumn("measured", F.when(~ins & (F.col("uid") % 2 == 0), F.concat(F.coalesce("measured", F.lit("-")), F.lit("!"))).otherwise(F.col("measured")))
    log = H.logged(None, led.where(~ins), after, 1)
    return log.select("doc_id", F.col("rid").alias("seq"), "kind", F.col("before.measured").alias("old"), F.col("after.measured").alias("new"))


@query("HIST-2-pointers", on_ledger("SELECT doc_id, array_to_string(applied, ',') AS applied, array_to_string(undone, ',') AS undone, undoable FROM state", f", {COMMANDS_CTE}, {POINTERS_SQL}").replace("WITH ", "WITH RECURSIVE ", 1))
def hist_2_pointers(spark, sf_dir):
    """Versions in effect after sixteen edits, undos and redos, of which four can be undone."""
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return H.pointers(history_commands(spark, sf_dir), UNDO_DEPTH).select("doc_id", shown("applied"), shown("undone"), "undoable")


REPLAY_SQL = f"""{COMMANDS_CTE}, {POINTERS_SQL}, {EDITS_CTE}, last AS (SELECT a.doc_id, rid, arg_max(drops, version) AS drops, max(version) AS version FROM acts a JOIN state s ON s.doc_id = a.doc_id AND list_contains(s.applied, a.version) GROUP BY a.doc_id, rid)"""


@query("HIST-2-replay", on_ledger("SELECT coalesce(k.doc_id, l.doc_id) AS doc_id, coalesce(k.rid, l.rid) AS rid, CASE WHEN l.rid IS NULL THEN k.measured ELSE 'v' || l.version END AS measured, k.sheet_row FROM keyed k FULL JOIN last l ON k.doc_id = l.doc_id AND k.rid = l.rid WHERE NOT coalesce(l.drops, false)", f", {REPLAY_SQL}").replace("WITH ", "WITH RECURSIVE ", 1))
def hist_2_replay(spark, sf_dir):
    """Every ledger after its commands: rows changed, deleted and inserted by the versions in effect."""
    base, log, commands = history_tables(spark, sf_dir)
    return H.replayed(base, log, H.pointers(commands, UNDO_DEPTH)).select("doc_id", "rid", "measured", "sheet_row")


@query("HIST-3-sheet", on_ledger("SELECT doc_id, count(*) FILTER (gone) AS n_clear, count(*) FILTER (NOT gone) AS n_write FROM (SELECT k.doc_id, coalesce(l.drops, false) AS gone FROM keyed k LEFT JOIN last l ON k.doc_id = l.doc_id AND k.rid = l.rid WHERE sheet_row IS NOT NULL) GROUP BY doc_id", f", {REPLAY_SQL}").replace("WITH ", "WITH RECURSIVE ", 1))
def hist_3_sheet(spark, sf_dir):
    """Sheet rows to clear and to write again once the commands have run."""
    base, log, commands = history_tables(spark, sf_dir)
    rows = H.sheet_rows(base, H.replayed(base, log, H.pointers(commands, UNDO_DEPTH)))
    return rows.groupBy("doc_id").agg(F.count_if("clear").alias("n_clear"), F.count_if(~F.col("clear")).alias("n_write"))


@query("SET-3", on_ledger("SELECT DISTINCT doc_id, page FROM led EXCEPT SELECT doc_id, page FROM led WHERE uid = 1"))
def set_3(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    return led.select("doc_id", "page").distinct().join(led.where("uid = 1").select("doc_id", "page"), ["doc_id", "page"], "left_anti")


@query("SET-4", on_ledger("(SELECT DISTINCT doc_id, page, num::INTEGER AS base FROM nled WHERE (num <= 3) <> (num >= 3))"))
def set_4(spark, sf_dir):
    led = numbered(spark, sf_dir).select("doc_id", "page", pyfmt.base_of(F.col("bubble")).alias("base")).distinct()
    return L.toggled(led.where("base <= 3"), led.where("base >= 3"))


@query("SORT-1", on_ledger('SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nominal DESC, "by", seq) AS INTEGER) AS place FROM led'))
def sort_1(spark, sf_dir):
    """Stable order by several keys: the list place breaks ties."""
    return X.ledger(spark, sf_dir).select("doc_id", "seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("nominal"), "by", "seq")).alias("place"))


