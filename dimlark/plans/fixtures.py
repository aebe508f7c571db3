"""Inspection tables derived from the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import GROUP_OF, TIERS, TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], place):
    """The value at a place from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), place.cast("int") + 1)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order is one drawing, one line item one row; line numbers serve as balloons, so sub-rows occur."""
    # numbered by the key that all that follows goes by, so rows are dealt out once
    li = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey").cast("string"))
    order = Window.partitionBy("doc_id").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    words = pick(("GO", "NOGO", "nok", "TAK", "NO-GO"), F.floor(F.col("l_partkey") / 10) % 5)
    value = (F.col("l_quantity") + F.col("l_tax") - 0.04).cast("decimal(12,2)").cast("string")
    measured = F.when(F.col("l_linestatus") == "O", F.lit(None)).when(F.col("l_partkey") % 10 == 0, words).when(F.col("l_partkey") % 2 == 0, F.replace(value, F.lit("."), F.lit(","))).otherwise(value)
    groups = tuple(GROUP_OF[t] for t in TYPES)
    n = F.col("l_linenumber")
    rows = li.select(
        "doc_id",
        F.row_number().over(order).cast("long").alias("seq"),
        n.cast("long").alias("uid"),
        (F.col("l_suppkey") % 3).cast("int").alias("page"),
        pick(TYPES, n % 9).alias("type"),
        pick(groups, n % 9).alias("group"),
        pick(TIERS, F.col("l_partkey") % 4).alias("tier"),
        F.lit(None).cast("string").alias("gage"),
        F.col("l_quantity").cast("int").cast("string").alias("feature"),
        F.col("l_quantity").cast("double").alias("nominal"),
        F.when(F.col("l_returnflag") == "A", F.col("l_discount")).alias("tol_sym"),
        F.when(F.col("l_returnflag").isin("N", "R"), F.col("l_discount")).alias("tol_max"),
        F.when(F.col("l_returnflag") == "N", F.lit(0.0) - F.col("l_tax")).alias("tol_min"),
        F.when(n % 3 == 0, F.lit(0.02)).alias("pin"),
        F.when(n % 4 == 0, F.lit(0.01)).alias("offset"),
        measured.alias("measured"),
        (F.col("l_partkey") % 600).cast("double").alias("x"),
        (F.col("l_suppkey") * 7 % 800).cast("double").alias("y"),
        F.col("l_linestatus").alias("__status"),
    )
    odd = F.col("uid") % 2 == 1
    return rows.select(
        *[c for c in rows.columns if c != "__status"],
        F.when(odd, F.col("x") + 20).otherwise(F.col("x")).alias("bx"),
        F.when(odd, F.col("y") - 20).otherwise(F.col("y")).alias("by"),
        F.lit(False).alias("leader"),
        F.lit(None).cast("string").alias("lexit"),
        F.when(F.col("__status") == "F", (F.col("seq") + 10).cast("int")).alias("sheet_row"),
    )


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LEDGER_CTE = f"""base_led AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) AS seq,
    CAST(l_linenumber AS BIGINT) AS uid, CAST(l_suppkey % 3 AS INTEGER) AS page,
    ({quoted(TYPES)})[l_linenumber % 9 + 1] AS type, ({quoted(GROUP_OF[t] for t in TYPES)})[l_linenumber % 9 + 1] AS "group",
    ({quoted(TIERS)})[l_partkey % 4 + 1] AS tier,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS feature, CAST(l_quantity AS DOUBLE) AS nominal,
    CASE WHEN l_returnflag = 'A' THEN l_discount END AS tol_sym,
    CASE WHEN l_returnflag IN ('N', 'R') THEN l_discount END AS tol_max,
    CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE - l_tax END AS tol_min,
    CASE WHEN l_linenumber % 3 = 0 THEN 0.02::DOUBLE END AS pin, CASE WHEN l_linenumber % 4 = 0 THEN 0.01::DOUBLE END AS "offset",
    CASE WHEN l_linestatus = 'O' THEN NULL
         WHEN l_partkey % 10 = 0 THEN (['GO', 'NOGO', 'nok', 'TAK', 'NO-GO'])[CAST(l_partkey // 10 AS INTEGER) % 5 + 1]
         WHEN l_partkey % 2 = 0 THEN replace(CAST(CAST(l_quantity + l_tax - 0.04::DOUBLE AS DECIMAL(12, 2)) AS VARCHAR), '.', ',')
         ELSE CAST(CAST(l_quantity + l_tax - 0.04::DOUBLE AS DECIMAL(12, 2)) AS VARCHAR) END AS measured,
    CAST(l_partkey % 600 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 800 AS DOUBLE) AS y, l_linestatus AS status
  FROM lineitem
), led AS (
  SELECT * EXCLUDE (status), CASE WHEN uid % 2 = 1 THEN x + 20 ELSE x END AS bx, CASE WHEN uid % 2 = 1 THEN y - 20 ELSE y END AS "by",
    CASE WHEN status = 'F' THEN CAST(seq + 10 AS INTEGER) END AS sheet_row
  FROM base_led
), firsts AS (
  SELECT doc_id, uid, min(seq) AS first_seq, arg_min(page, seq) AS first_page, count(*) AS n FROM led GROUP BY doc_id, uid
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_page, first_seq) AS num FROM firsts
), nled AS (
  SELECT led.*, r.num, r.first_page, r.first_seq, r.n,
    r.num || CASE WHEN r.n > 1 THEN substr('abcdefghijklmnopqrstuvwxyz', CAST((row_number() OVER (PARTITION BY led.doc_id, led.uid ORDER BY led.seq) - 1) % 26 + 1 AS INTEGER), 1) ELSE '' END AS bubble
  FROM led JOIN ranks r USING (doc_id, uid)
)"""

#: verdict columns over ``led`` or ``nled``
VERDICT_SQL = """
  TRY_CAST(replace(trim(measured), ',', '.') AS DOUBLE) AS mnum,
  CASE WHEN tol_sym IS NOT NULL THEN nominal + (0.0::DOUBLE - abs(tol_sym)) WHEN tol_max IS NOT NULL AND tol_min IS NOT NULL THEN nominal + least(tol_max, tol_min) END AS lo,
  CASE WHEN tol_sym IS NOT NULL THEN nominal + abs(tol_sym) WHEN tol_max IS NOT NULL AND tol_min IS NOT NULL THEN nominal + greatest(tol_max, tol_min) END AS hi,
  nominal + coalesce("offset", 0.0::DOUBLE) - coalesce(pin, 0.0::DOUBLE) / 2 AS k
"""
JUDGED_CTE = f""", lim AS (SELECT *, {VERDICT_SQL} FROM nled), judged AS (
  SELECT *,
    CASE WHEN coalesce(trim(measured), '') = '' THEN false
         WHEN mnum IS NULL THEN upper(trim(measured)) IN ('NOGO', 'NO-GO', 'NO GO', 'NOK', 'FAIL', 'NIE')
         ELSE coalesce(NOT (mnum >= lo - 1e-9::DOUBLE AND mnum <= hi + 1e-9::DOUBLE), false) END AS oot,
    CASE WHEN mnum IS NULL THEN CASE WHEN upper(coalesce(measured, '')) IN ('GO', 'OK', 'PASS', 'TAK') THEN 'PASS'
                                     WHEN upper(coalesce(measured, '')) IN ('NOGO', 'NO GO', 'FAIL', 'NIE') THEN 'FAIL' ELSE '' END
         WHEN NOT (nominal IS NOT NULL AND ((tol_max IS NOT NULL AND tol_min IS NOT NULL) OR tol_sym IS NOT NULL)) THEN ''
         WHEN mnum >= k + CASE WHEN tol_max IS NOT NULL AND tol_min IS NOT NULL THEN least(tol_max, tol_min) WHEN tol_min IS NOT NULL THEN tol_min ELSE 0.0::DOUBLE - abs(tol_sym) END
          AND mnum <= k + CASE WHEN tol_max IS NOT NULL AND tol_min IS NOT NULL THEN greatest(tol_max, tol_min) WHEN tol_max IS NOT NULL THEN tol_max ELSE abs(tol_sym) END THEN 'PASS'
         ELSE 'FAIL' END AS result
  FROM lim
)"""


def on_ledger(select: str, more: str = "") -> str:
    """SQL over ``led``, ``ranks`` and ``nled`` (numbered)."""
    return f"WITH {LEDGER_CTE}{more} {select}"


def on_judged(select: str, more: str = "") -> str:
    return f"WITH {LEDGER_CTE}{JUDGED_CTE}{more} {select}"


FIT_CODES = ("H7", "h6", "g6", "k6", "JS9", "js7", "N9", "P7", "M6", "K9", "c11", "r6")
CLASSES = ("f", "m", "c", "v")


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nominal size, a fit code and a class for each part and scale."""
    part = table(spark, sf_dir, "part")
    size = F.array(F.col("p_size").cast("double"), F.col("p_size") * F.lit(10.0), F.col("p_retailprice"))
    return part.select(F.col("p_partkey").alias("id"), F.posexplode(size).alias("scale", "nominal"), pick(FIT_CODES, F.col("p_partkey") % 12).alias("code"), pick(CLASSES, F.col("p_partkey") % 4).alias("cls"))


FITS_CTE = f"""fits AS (
  SELECT p_partkey AS id, scale, CASE scale WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size * 10.0::DOUBLE ELSE p_retailprice END AS nominal,
    ({quoted(FIT_CODES)})[p_partkey % 12 + 1] AS code, ({quoted(CLASSES)})[p_partkey % 4 + 1] AS cls
  FROM part, (SELECT unnest([0, 1, 2])::INTEGER AS scale)
)"""


def callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callout's text for each part."""
    n = F.col("p_size").cast("string")
    texts = F.array(
        F.concat(F.lit("Ø"), n, F.lit(" H7")),
        F.concat(F.lit("4X Ø "), n, F.lit(" THRU")),
        F.concat(F.lit("M"), n, F.lit("x1 - 6H")),
        F.concat(n, F.lit(",5 ±0.1")),
        F.concat(F.lit("R"), n),
        F.lit("2x45°"),
        F.lit("⌖ Ø0.1 (M) A B"),
        F.lit("Ra 1.6"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(texts, (F.col("p_partkey") % 8).cast("int") + 1).alias("text"))


CALLOUTS_CTE = """callouts AS (
  SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'Ø' || p_size || ' H7' WHEN 1 THEN '4X Ø ' || p_size || ' THRU' WHEN 2 THEN 'M' || p_size || 'x1 - 6H'
    WHEN 3 THEN p_size || ',5 ±0.1' WHEN 4 THEN 'R' || p_size WHEN 5 THEN '2x45°' WHEN 6 THEN '⌖ Ø0.1 (M) A B' ELSE 'Ra 1.6' END AS text
  FROM part
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as placed words: ten lines to a block, a wide gap after every seventh word."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    rows = lines.select("doc_id", "line", F.posexplode(F.split("s", " ", -1)).alias("word", "text")).where("text <> ''")
    gap = F.when(F.col("word") % 7 == 6, 200).otherwise(0)
    x0 = (F.col("word") * 48 + gap).cast("double")
    return rows.select(
        "doc_id", F.lit(0).alias("page"), x0.alias("x0"), (F.col("line") * 12).cast("double").alias("y0"), (x0 + F.length("text") * 6).alias("x1"), (F.col("line") * 12 + 10).cast("double").alias("y1"),
        "text", F.floor(F.col("line") / 10).alias("block"), F.col("line").cast("long").alias("line"), F.col("word").cast("long").alias("word"),
    )


def word_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words where a row is a page: ``doc_id, page, ws``. Texts are dealt out by document, words are not."""
    texts = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.collect_list("text").alias("texts"))

    def word(text, line, n):
        x0 = (n * 48 + F.when(n % 7 == 6, 200).otherwise(0)).cast("double")
        y0 = (line * 12).cast("double")
        fields = {"block": F.floor(line / 10), "line": line.cast("long"), "word": n.cast("long"), "x0": x0, "y0": y0, "x1": x0 + F.length(text) * 6, "y1": y0 + 10, "text": text}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    told = lambda s, line: F.filter(F.transform(F.split(s, " ", -1), lambda t, n: word(t, line, n)), lambda w: w["text"] != "")
    ws = F.flatten(F.transform("texts", lambda text: F.flatten(F.transform(F.split(text, "\n", -1), told))))
    # a test of the size would build all words once more
    some = texts.where(F.exists("texts", lambda text: text.rlike(r"[^ \n]")))
    return some.select("doc_id", F.lit(0).alias("page"), ws.alias("ws"))


WORDS_CTE = """doc_lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), doc_words AS (
  SELECT doc_id, line, generate_subscripts(ws, 1) - 1 AS word, unnest(ws) AS text FROM (SELECT doc_id, line, string_split(s, ' ') AS ws FROM doc_lines)
), words AS (
  SELECT doc_id, 0 AS page, CAST(word * 48 + CASE WHEN word % 7 = 6 THEN 200 ELSE 0 END AS DOUBLE) AS x0, CAST(line * 12 AS DOUBLE) AS y0,
    CAST(word * 48 + CASE WHEN word % 7 = 6 THEN 200 ELSE 0 END + length(text) * 6 AS DOUBLE) AS x1, CAST(line * 12 + 10 AS DOUBLE) AS y1,
    text, CAST(line // 10 AS BIGINT) AS block, CAST(line AS BIGINT) AS line, CAST(word AS BIGINT) AS word
  FROM doc_words WHERE text <> ''
)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each vector: its first eight components score eight classes, the next four place it; 64 to a drawing."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.floor(F.col("vec_id") / 64).cast("string").alias("doc_id"), e.alias("e"))
    scores = F.slice("e", 1, 8)
    cx, cy, w, h = F.col("e")[8] * 640 + 320, F.col("e")[9] * 640 + 320, F.abs(F.col("e")[10]) * 200 + 10, F.abs(F.col("e")[11]) * 200 + 10
    return rows.select(
        "ord", "doc_id", F.lit(0).alias("page"), (cx - w / 2).alias("x0"), (cy - h / 2).alias("y0"), (cx + w / 2).alias("x1"), (cy + h / 2).alias("y1"),
        F.array_max(scores).alias("conf"), (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("cls"),
    )


DETECTIONS_CTE = """dets AS (
  SELECT ord, doc_id, 0 AS page, cx - w / 2 AS x0, cy - h / 2 AS y0, cx + w / 2 AS x1, cy + h / 2 AS y1, list_max(e[1:8]) AS conf, CAST(list_position(e[1:8], list_max(e[1:8])) - 1 AS INTEGER) AS cls
  FROM (SELECT vec_id AS ord, CAST(vec_id // 64 AS VARCHAR) AS doc_id, e, e[9] * 640 + 320 AS cx, e[10] * 640 + 320 AS cy, abs(e[11]) * 200 + 10 AS w, abs(e[12]) * 200 + 10 AS h
        FROM (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings))
)"""


#: a form for each part, by its number modulo 8: words (``#`` for the part's size, two digits) with x, y, block, line and word
SPLIT_FORMS = (
    (("#", 0, 6, 0, 0, 0), ("+0.1", 20, 0, 1, 0, 0), ("-0.2", 20, 12, 2, 0, 0)),
    (("Ø#", 0, 0, 0, 0, 0), ("THROUGH", 0, 12, 0, 1, 0)),
    (("#", 0, 0, 0, 0, 0), ("H7", 20, 0, 1, 0, 0)),
    (("4X", 0, 0, 0, 0, 0), ("Ø#", 0, 12, 0, 1, 0)),
    (("#", 0, 0, 0, 0, 0), (".", 13, 0, 0, 0, 1), ("5", 20, 0, 0, 0, 2), ("±0.1", 30, 0, 0, 0, 3)),
    (("#", 0, 0, 0, 0, 0), ("+0.3", 14, 0, 0, 0, 1), ("-0.1", 30, 12, 1, 0, 0)),
    (("DURCHMESSER", 0, 0, 0, 0, 0), ("#", 70, 0, 0, 0, 1)),
    (("R#", 0, 0, 0, 0, 0), ("NOTE", 200, 0, 0, 0, 1)),
)


def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callout for each part whose words lie apart: 20 to a drawing, one under the other."""
    word = lambda w: F.struct(F.lit(w[0]).alias("text"), *[F.lit(v).alias(c) for c, v in zip(("dx", "dy", "b", "line", "word"), w[1:], strict=True)])
    forms = F.array(*[F.array(*[word(w) for w in form]) for form in SPLIT_FORMS])
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 10).cast("string").alias("n"), F.explode(F.element_at(forms, (F.col("p_partkey") % 8).cast("int") + 1)).alias("w"))
    k = F.col("id") % 20
    text = F.replace(F.col("w.text"), F.lit("#"), F.col("n"))
    x0, y0 = F.col("w.dx").cast("double"), (k * 100 + F.col("w.dy")).cast("double")
    return part.select(F.floor(F.col("id") / 20).cast("string").alias("doc_id"), F.lit(0).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.length(text) * 6).alias("x1"), (y0 + 10).alias("y1"), text.alias("text"), (k * 4 + F.col("w.b")).alias("block"), F.col("w.line").cast("long").alias("line"), F.col("w.word").cast("long").alias("word"))


#: pieces of callout texts, one for each scanning rule and some that are no callout: text, kind, sub-kind, value, tolerance; ``#`` is the part's number
PIECES = (
    ("M#x1.5 - 6g", "THREAD", None, "M#x1.5 - 6g", None),
    ("1/4-# UNC", "THREAD", None, "1/4-# UNC", None),
    ("TRUE POSITION Ø0.# (M)", "GDT", "POSITION", "POSITION Ø0.# M", "0.#"),
    ("FLATNESS 0.#", "GDT", "FLATNESS", "FLATNESS 0.#", "0.#"),
    ("STRAIGHTNESS 0,#", "GDT", "STRAIGHTNESS", "STRAIGHTNESS 0,#", "0,#"),
    ("ROUNDNESS 0.#", "GDT", "CIRCULARITY", "CIRCULARITY 0.#", "0.#"),
    ("CYLINDRICITY 0.#", "GDT", "CYLINDRICITY", "CYLINDRICITY 0.#", "0.#"),
    ("PARALLELISM 0.# MMC", "GDT", "PARALLELISM", "PARALLELISM 0.# M", "0.#"),
    ("PERP 0.#", "GDT", "PERPENDICULARITY", "PERPENDICULARITY 0.#", "0.#"),
    ("ANGULARITY 0.#", "GDT", "ANGULARITY", "ANGULARITY 0.#", "0.#"),
    ("TIR 0.#", "GDT", "RUNOUT", "RUNOUT 0.#", "0.#"),
    ("COAXIALITY 0.#", "GDT", "CONCENTRICITY", "CONCENTRICITY 0.#", "0.#"),
    ("PROFILE OF A SURFACE 0.#", "GDT", "PROFILE", "PROFILE 0.#", "0.#"),
    ("Ra 1.# µm", "SURFACE", None, "Ra 1.# µm", None),
    ("Ø# H7/g6", "FIT", None, "Ø# H7/g6", "H7/g6"),
    ("CBORE Ø#", "DIAMETER", "CBORE", "CBORE Ø#", None),
    ("CSK Ø# x 90°", "DIAMETER", "CSINK", "CSINK Ø# X90°", None),
    ("DEEP #", "DEPTH", None, "DEEP #", None),
    ("4X Ø# +0.1/-0.2", "DIAMETER", None, "4X Ø#", "+0.1/-0.2"),
    ("R# ±0.5", "RADIUS", None, "R#", "±0.5"),
    ("# x 45°", "CHAMFER", None, "#x45°", None),
    ("C#", "CHAMFER", None, "C#", None),
    ("#° ±1°", "ANGLE", None, "#°", "±1"),
    ("[#]", "LINEAR", "BASIC", "#", "BASIC"),
    ("(#)", "LINEAR", "REF", "#", "REF"),
    ("# ±0.05", "LINEAR", None, "#", "±0.05"),
    ("# +0.2/-0.1", "LINEAR", None, "#", "+0.2/-0.1"),
    ("# +0.25", "LINEAR", None, "#", "+0.25"),
    ("NOTE", None, None, None, None),
    ("REV B", None, None, None, None),
    ("SEE SHEET #", None, None, None, None),
)
MOST_PIECES = 5
#: what a piece holds for later rules when it stands in a text again and so claims nothing itself: number, text, kind, value, tolerance
INNER = (
    (2, "Ø0.#", "DIAMETER", "Ø0.#", None),
    (14, "Ø#", "DIAMETER", "Ø#", None),
    (15, "Ø#", "DIAMETER", "Ø#", None),
    (16, "Ø#", "DIAMETER", "Ø#", None),
    (16, "90°", "ANGLE", "90°", None),
    (18, "# +0.1/-0.2", "LINEAR", "#", "+0.1/-0.2"),
    (19, "# ±0.5", "LINEAR", "#", "±0.5"),
    (20, "45°", "ANGLE", "45°", None),
)


def pieces_of(id_):
    """Numbers of a text's pieces, two to five of them, the same one perhaps twice: ``(id * (2 j + 3) + 7 j j) % pieces``."""
    every = F.transform(F.sequence(F.lit(0), F.lit(MOST_PIECES - 1)), lambda j: (id_ * (2 * j + 3) + 7 * j * j) % len(PIECES))
    return F.slice(every, 1, (id_ % (MOST_PIECES - 1) + 2).cast("int"))


def grammar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of several callouts for each part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 10).cast("string").alias("n"))
    said = F.array(*[F.lit(p[0]) for p in PIECES])
    return part.select("id", F.replace(F.array_join(F.transform(pieces_of(F.col("id")), lambda k: F.element_at(said, (k + 1).cast("int"))), " | "), F.lit("#"), F.col("n")).alias("text"))


def _sql(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


GRAMMAR_CTE = f"""pieces(k, said, tp, sb, v, t) AS (VALUES {", ".join(f"({k}, {', '.join(map(_sql, p))})" for k, p in enumerate(PIECES))}
), chosen AS (
  SELECT p_partkey AS id, CAST(p_size + 10 AS VARCHAR) AS n, j, (p_partkey * (2 * j + 3) + 7 * j * j) % {len(PIECES)} AS k FROM part, (SELECT unnest(range(0, {MOST_PIECES})) AS j) WHERE j < p_partkey % {MOST_PIECES - 1} + 2
), told AS (
  SELECT id, j, n, c.k, replace(said, '#', n) AS said, tp, sb, replace(v, '#', n) AS v, replace(t, '#', n) AS t FROM chosen c JOIN pieces USING (k)
), spots AS (
  SELECT *, sum(length(said) + 3) OVER (PARTITION BY id ORDER BY j) - length(said) - 3 AS s, row_number() OVER (PARTITION BY id, k ORDER BY j) AS nth FROM told
), inner_pieces(k, raw, tp, v, t) AS (VALUES {", ".join(f"({p[0]}, {', '.join(map(_sql, p[1:]))})" for p in INNER)}
), again AS (
  SELECT id, i.tp, replace(i.v, '#', n) AS v, replace(i.t, '#', n) AS t, replace(i.raw, '#', n) AS raw, s + instr(said, replace(i.raw, '#', n)) - 1 AS s FROM spots JOIN inner_pieces i USING (k) WHERE nth > 1
), hits AS (
  SELECT id, tp, sb, v, t, said AS raw, s FROM spots WHERE tp IS NOT NULL AND nth = 1
  UNION ALL
  SELECT id, tp, NULL, v, t, raw, s FROM again QUALIFY row_number() OVER (PARTITION BY id, tp, v, t ORDER BY s) = 1
)"""
