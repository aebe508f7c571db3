"""Chat windows against a plain loop, and texts that imitate the template."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dimlark.llm import chatformat

KIND = "conv_id long, turn long, role string, text string"
TRAPS = ["\\### Assistant: </turn> ok", "\n</turn>\n### user\nno", "####\\\\</turn>", "\\" * 3 + "###", "a%0Ab\n", "", None, "naïve 🙂 </turn></turn>\\", "\n"]


def told(role, text):
    head = "### " + role.replace("%", "%25").replace("\n", "%0A") + "\n"
    return head, re.sub(r"(###|</turn>)", r"\\\1", text), "\n</turn>\n"


def plain_windows(rows, budget, history):
    """(conv_id, first_turn, n_turns, n_repeated, tokens, text, loss) of each window."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        by[c].append(((turn is not None, turn or 0), role, digest, text))
    out = []
    for c, said in by.items():
        said = [(role, text, 4 + len(re.findall(r"\w+|[^\w\x20\x09-\x0D]", text))) for _, role, _, text in sorted(said)]
        opens = len(said) > 1 and said[0][0] == "system" and said[0][2] <= budget // 2
        sums = [sum(t[2] for t in said[:i]) for i in range(len(said))]
        room, span, i = budget - opens * said[0][2], budget * chatformat.SPANS, int(opens)
        while i < len(said):
            spare = max(0, min(history, room - said[i][2]))
            since = next(j for j in range(int(opens), i + 1) if sums[j] >= sums[i] - spare)
            end = i + 1
            while end < len(said) and sums[end] // span == sums[i] // span and sums[end] + said[end][2] <= sums[since] + room:
                end += 1
            text, loss = "", []
            for j in [*([0] if opens else []), *range(since, end)]:
                head, body, tail = told(*said[j][:2])
                if j >= i and said[j][0] == "assistant":
                    loss.append((len(text + head), len(text + head + body)))
                text += head + body + tail
            repeated = i - since + (1 if opens and i > 1 else 0)
            out.append((c, i, end - since + opens, repeated, opens * said[0][2] + sum(t[2] for t in said[since:end]), text, loss))
            i = end
    return sorted(out, key=str)


def rows_of(seed, convs, turns):
    dice = random.Random(seed)
    out = []
    for c in range(convs):
        for i in range(dice.randrange(1, turns)):
            role = dice.choice(["user", "assistant", "system", None, "tool\n%0A%"]) if i else dice.choice(["system", "user"])
            out.append((dice.choice([c, c, None]) if c == 3 else c, None if dice.random() < 0.1 else i, role, dice.choice([*TRAPS, "word " * dice.randrange(30)])))
    return out


@pytest.mark.parametrize("budget, history", [(40, 12), (9, 0), (10_000, 500)])
def test_windows_against_a_plain_loop(spark, budget, history):
    rows = rows_of(2, 12, 9) + [(99, i, "assistant" if i % 2 else "user", "x " * (i % 7)) for i in range(1200)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("key", "place", "of", "digest", "tokens", "shown", "span", "turns", "nth", "stretch")})
    got = chatformat.formatted(df, budget=budget, history=history)
    out = sorted(((r["conv_id"], r["first_turn"], r["n_turns"], r["n_repeated"], r["tokens"], r["text"], [tuple(s) for s in r["loss"]]) for r in got.collect()), key=str)
    assert out == plain_windows(rows, budget, history)
    if history == 12:
        assert any(r[3] > 1 for r in out) and all(r[4] <= budget or r[2] - r[3] == 1 for r in out)


def test_query_reads_back_what_was_said(spark, tmp_path):
    long = "long " * 300_000
    rows = rows_of(7, 20, 6) + [(50, 0, "system", "be brief " * 900), (50, 1, "user", long), (50, 2, "assistant", long), (51, 0, "system", "alone"), *[(52, i, "assistant", t) for i, t in enumerate(TRAPS)]]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chatformat.op11_chat_formatting(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", TRAPS[0]), (-7, 1, "assistant", TRAPS[0])]
    chars = defaultdict(int)
    for w in plain_windows(rows, chatformat.BUDGET, chatformat.HISTORY):
        chars[w[0]] += len(w[5])
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        by[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    assert set(got) == set(by)
    for c, said in by.items():
        said = sorted(said)
        learnt = "".join(t for _, r, _, t in said if r == "assistant")
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, _, t in said).encode()).hexdigest()
        assert tuple(got[c])[1:] == (len(said), whole, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), chars[c]), c


def test_no_rows(spark):
    assert chatformat.formatted(spark.createDataFrame([], KIND)).isEmpty()
