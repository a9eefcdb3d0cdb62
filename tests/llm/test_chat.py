"""Chat logs folded and formatted, against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.llm import chat

LOG = "conv_id long, message long, seq long, kind string, role string, text string, turn int, at string, place int"
TURNS = "conv_id long, turn long, role string, text string, formatted string, pos int"


def folded(events):
    """{conv_id: [(role, text)]}, an event at a time."""
    null_first = lambda v: (v is not None, v if v is not None else 0)
    out, convs = {}, {}
    for e in {e[:6] for e in events}:
        convs.setdefault(e[0], []).append(e)
    for c, log in convs.items():
        messages, cuts = {}, {}
        for _, m, seq, kind, role, text in sorted(log, key=lambda e: (null_first(e[2]), null_first(e[3]), (e[4] is not None, e[4] or ""), (e[5] is not None, e[5] or ""))):
            x = messages.setdefault(m, {"place": null_first(seq), "role": "", "text": "", "alive": True})
            x["role"] = x["role"] if role is None else role
            if kind in ("open", "edit", "regenerate"):
                x["text"], x["alive"] = text or "", True
            elif kind == "delta" and x["alive"]:
                x["text"] += text or ""
            elif kind == "delete":
                x["text"], x["alive"] = "", False
            if kind == "regenerate":
                cuts[m] = null_first(seq)
        order = sorted(messages, key=lambda m: (messages[m]["place"], m))
        out[c] = []
        for k, m in enumerate(order):
            if messages[m]["alive"] and not any(cuts.get(b, (False,)) > messages[m]["place"] for b in order[:k]):
                out[c].append((messages[m]["role"], messages[m]["text"]))
    return out


def read(df):
    out = {}
    for r in sorted(chat.read_back(df).collect(), key=lambda r: (r.pos is not None, r.pos)):
        out.setdefault(r.conv_id, [])
        if r.pos is not None:
            out[r.conv_id].append((r.role, r.text, r.loss))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", "a", "é\U0001F600", "###", "####", "</turn>", "</turn>\n", "\\", "\\e", "\\\\h", "### assistant: ", "</tur", "n>", "#"]
    log = []
    for c in [*range(12), None]:
        for s in range(rng.choice([1, 5, 40])):
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            log.append((c, rng.randrange(8), rng.choice([s, s, s, s // 2]), kind, rng.choice([None, "user", "assistant", "a: ###"]), rng.choice(texts), 1, "x", 9))
    log += rng.choices(log, k=30)  # delivered again
    df = spark.createDataFrame(log, LOG).repartition(7)
    want = folded(log)
    out = chat.format_chats(df).cache()
    assert read(out) == {c: [(r, t, t if r == "assistant" else "") for r, t in turns] for c, turns in want.items()}
    for r in out.collect():
        for (role, _), span in zip(want[r.conv_id], r.loss_mask):
            if role == "assistant":
                assert "###" not in r.formatted[span.start:span.end] and r.formatted[span.end:].startswith("</turn>\n")
        assert r.formatted.count("</turn>\n") == len(want[r.conv_id]) == len(r.loss_mask)


def test_tables_become_logs_and_come_back(spark):
    """Null, empty and long texts, ties, repeated rows, null ids and roles; clashing columns; nothing."""
    long = "word ### \\ </turn> é\U0001F600\n" * 40_000
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "user", "again"), (1, 3, "user", "again"), (1, 3, "assistant", long), (1, None, "user", "first"),
            (2, 5, "assistant", "alone"), (None, 0, "user", "nobody's"), (3, 0, None, "no role"), (3, 1, "tool", "a: b"), (4, 0, "assistant", long)]
    df = spark.createDataFrame([(*r, "f", 3) for r in rows], TURNS)
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or "", (text or "") if role == "assistant" else ""))
    log = chat.streamed(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate", "delete"}
    assert log.filter(F.length("text") > chat.PIECE).count() == 0
    assert read(chat.format_chats(log)) == want
    assert chat.format_chats(chat.streamed(df.limit(0))).count() == 0


def test_all_deleted(spark):
    log = spark.createDataFrame([(1, 1, 1, "open", "user", "x", 1, "", 1), (1, 1, 2, "delete", None, None, 1, "", 1), (1, 1, 3, "delta", None, "late", 1, "", 1)], LOG)
    out = chat.format_chats(log)
    assert [tuple(r) for r in out.collect()] == [(1, "", [])] and read(out) == {1: []}


def test_main_path_is_native(spark, sf_dir):
    df = chat.op11_event_sourced_chat(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # one shuffle from the table to the digests
