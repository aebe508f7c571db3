r"""Chat formatting into windows of a token budget.

A turn is written as ``### role``, its text and ``</turn>``, each on lines of their own. Inside a
text every control string gets a backslash in front, which reading back takes away again; in a
role, percent signs and line ends are percent-encoded. So only the template itself has a control
string that follows a line end.

Windows hold whole turns. A conversation's tokens are added up turn by turn (``places``, whatever
its length), and these prefix sums tell which turns fit: each turn is new in one window; a window
starts with the system turn and as many of the turns before its first new one as fit into
``history`` tokens, which are repeated. Only new assistant texts stand under the loss mask. Sums are
cut into spans of ``SPANS`` budgets, at which windows end, and one group holds a span's turns and
what of the span before is within ``history``, so no group grows with a conversation.

Cases: turns stand by ``turn``, nulls first, then by role and the digest of role and text. Null
texts and roles are empty. Repeated rows are turns of their own; rows with a null id are one conversation. The system
turn is the first one if its role is ``system``, others follow, and it takes half the budget at
most; a longer one, or one alone, is a turn like others. A turn over the budget has a window for itself and the
system turn, so no text is cut. An empty table has no windows. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, table, written
from .merkle import digest
from .places import placed

BEGIN, END = "### ", "</turn>"
CONTROL = r"(###|</turn>)"
#: Runs of letters and digits, and single other marks, count as tokens; so many more for a turn's template.
TOKEN, TEMPLATE_TOKENS = r"[\p{L}\p{M}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]", 4
BUDGET, HISTORY, SPANS = 1024, 256, 16


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def header(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("\n"))


def role_of(told: Column) -> Column:
    return F.replace(F.replace(F.substring(told, len(BEGIN) + 1, 2**31 - 1), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """``turns(key, ...)`` in groups: ``key``, ``conv_id``, ``turns`` by place, and the system turn, null if there is none."""
    opens = (F.col("place") == 0) & (F.col("of") > 1) & (F.col("role") == "system") & (F.col("tokens") <= budget // 2)
    turns = turns.withColumns({"before": F.col("upto") - F.col("tokens"), "opens": opens})
    system = turns.where("opens").select("key", F.struct("tokens", "shown").alias("system"))
    wide = budget * SPANS
    span = F.floor(F.col("before") / wide)
    near = F.col("before") >= (span + 1) * wide - history
    rows = turns.where(~F.col("opens")).select("*", F.explode(F.when(near, F.array(span, span + 1)).otherwise(F.array(span))).alias("span"))
    turn = F.struct("place", "before", "tokens", (F.col("span") == span).alias("fresh"), (F.col("role") == "assistant").alias("target"), "shown", F.length(header(F.col("role"))).alias("lead"))
    rows = rows.groupBy("key", "span").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.join(system, "key", "left")


def starts(turns: Column, room: Column, history: int) -> Column:
    """Where windows begin: structs of ``at``, tokens before the first new turn, and ``since``, tokens before the first repeated one."""
    begins = F.struct(F.lit(-1).cast("long").alias("limit"), F.array().cast("array<struct<at:bigint,since:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        spare = F.greatest(F.lit(0).cast("long"), F.least(F.lit(history).cast("long"), room - x["tokens"]))
        since = F.array_min(F.filter(F.transform(turns, lambda y: y["before"]), lambda p: p >= x["before"] - spare))
        begun = F.struct(F.greatest(since + room, x["before"] + x["tokens"]).alias("limit"), F.array_append(a["out"], F.struct(x["before"].alias("at"), since.alias("since"))).alias("out"))
        return F.when(~x["fresh"] | (x["before"] + x["tokens"] <= a["limit"]), a).otherwise(begun)

    return F.aggregate(turns, begins, step, lambda a: a["out"])


def formatted(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, token: str = TOKEN) -> DataFrame:
    """A row for each window.

    ``conv_id``; ``first_turn``: the number of its first new turn; ``n_turns``; ``n_repeated``: how
    many of these, at its front, stand elsewhere too; ``tokens``; ``text``; ``loss``: [start, end) in code
    points of the texts to learn.
    """
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("s"), col(id_col).cast("string")), F.lit("n")).alias("key"),
        col(id_col).alias("conv_id"),
        col(turn_col).alias("turn"),
        role.alias("role"),
        digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.concat(header(role), escaped(text), F.lit(f"\n{END}\n")).alias("shown"),
        (F.regexp_count(text, F.lit(token)) + TEMPLATE_TOKENS).cast("long").alias("tokens"),
    )
    turns = written(placed(rows, "key", ("turn", "role", "digest"), {"upto": ("tokens", "sum")}, tag="chat-order").drop("digest", "turn"), "chat-turns")
    groups = spans(turns, budget, history)
    own = F.coalesce("system.tokens", F.lit(0).cast("long"))
    groups = groups.withColumn("room", budget - own).withColumn("starts", starts(F.col("turns"), F.col("room"), history))
    ends = F.transform("starts", lambda s, i: F.struct(s["at"].alias("at"), s["since"].alias("since"), F.coalesce(F.get("starts", i + 1)["at"], F.lit(2**63 - 1)).alias("end")))
    groups = groups.select("conv_id", "turns", "system", own.alias("own"), F.explode_outer(ends).alias("window")).where(F.col("window").isNotNull())
    w = F.col("window")
    held = F.filter("turns", lambda x: (x["before"] >= w["since"]) & (x["before"] < w["end"]))
    groups = groups.select("conv_id", "system", "own", "window", held.alias("turns"))
    opening = F.coalesce("system.shown", F.lit(""))
    first = F.struct(F.length(opening).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def mask(a: Column, x: Column) -> Column:
        size = F.length(x["shown"])
        body = F.struct((a["at"] + x["lead"]).alias("start"), (a["at"] + size - len(END) - 2).alias("end"))
        return F.struct((a["at"] + size).alias("at"), F.when(x["target"] & (x["before"] >= w["at"]), F.array_append(a["out"], body)).otherwise(a["out"]).alias("out"))

    fresh = F.filter("turns", lambda x: x["before"] >= w["at"])
    opened = F.col("system").isNotNull().cast("int")
    return groups.select(
        "conv_id",
        fresh[0]["place"].alias("first_turn"),
        (F.size("turns") + opened).alias("n_turns"),
        (F.size("turns") - F.size(fresh) + F.when(fresh[0]["place"] > 1, opened).otherwise(0)).alias("n_repeated"),
        F.aggregate("turns", F.col("own"), lambda a, x: a + x["tokens"]).alias("tokens"),
        F.concat(opening, F.array_join(F.transform("turns", lambda x: x["shown"]), "")).alias("text"),
        F.aggregate("turns", first, mask, lambda a: a["out"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """``windows`` with ``said``, structs of ``role`` and ``text`` of the turns that are new in them, and ``learnt``, the texts under the mask."""
    pieces = F.split("text", f"\n{END}\n", -1)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    said = F.transform(own, lambda p: F.struct(role_of(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))
    learnt = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.withColumns({"said": said, "learnt": learnt})


def op11_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = [F.struct(F.lit(-7).cast("long"), F.lit(i).cast("long"), F.lit(role), F.lit(trap)) for i, role in enumerate(("user", "assistant"))]
    rows = rows.union(spark.range(1).select(F.inline(F.array(*extra))))
    back = read_back(formatted(rows))
    told = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    window = F.struct("first_turn", F.size("said").alias("n"), F.array_join(F.transform("said", told), "").alias("said"), F.array_join("learnt", "").alias("learnt"), F.length("text").alias("chars"))
    convs = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(window)).alias("w"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[name])
    convs = convs.select("conv_id", total("n").alias("n_turns"), digest(joined("said")).alias("turns_sha256"), joined("learnt").alias("learnt"), total("chars").alias("formatted_chars"))
    return convs.select("conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"), digest(F.col("learnt")).alias("loss_sha256"), "formatted_chars")


OP11_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         len(regexp_extract_all(text, '{TOKEN}')) + {TEMPLATE_TOKENS} AS tokens,
         length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + length(text) + len(regexp_extract_all(text, '{CONTROL}')) + {len(BEGIN) + len(END) + 3} AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text))
), p AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) - tokens AS BIGINT) AS before, i = 0 AND n > 1 AND role = 'system' AND tokens <= {BUDGET // 2} AS opens FROM t
), s AS (
  SELECT conv_id, max(CASE WHEN opens THEN tokens ELSE 0 END) AS own, max(CASE WHEN opens THEN chars ELSE 0 END) AS own_chars,
         list(before ORDER BY i) FILTER (WHERE NOT opens) AS ps, list(tokens ORDER BY i) FILTER (WHERE NOT opens) AS ns, list(chars ORDER BY i) FILTER (WHERE NOT opens) AS ls,
         count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS told, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS learnt
  FROM p GROUP BY conv_id
), w AS (
  SELECT conv_id, unnest(list_filter(range(1, len(ps) + 1), lambda j: j = 1 OR ps[j] // {BUDGET * SPANS} > ps[j - 1] // {BUDGET * SPANS})) AS k FROM s
  UNION ALL
  SELECT conv_id, nxt FROM (
    SELECT s.conv_id, list_min(list_filter(range(w.k + 1, len(ps) + 1), lambda j: ps[j] // {BUDGET * SPANS} = ps[w.k] // {BUDGET * SPANS} AND ps[j] + ns[j] > greatest(ps[w.k] + ns[w.k],
      {BUDGET} - own + list_min(list_filter(ps, lambda b: b >= ps[w.k] - greatest(0, least({HISTORY}, {BUDGET} - own - ns[w.k]))))))) AS nxt
    FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
  ) WHERE nxt IS NOT NULL
), e AS (
  SELECT conv_id, k, coalesce(lead(k) OVER (PARTITION BY conv_id ORDER BY k) - 1, 1000000) AS last FROM w
), f AS (
  SELECT e.conv_id, own_chars + list_sum(ls[list_min(list_filter(range(1, len(ps) + 1), lambda j: ps[j] >= ps[k] - greatest(0, least({HISTORY}, {BUDGET} - own - ns[k])))) : last]) AS chars
  FROM e JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
), g AS (
  SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id
)
SELECT s.conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id
"""
