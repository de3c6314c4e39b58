"""Folding of logs, the template's escapes, and what is read back."""

from __future__ import annotations

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import chat

LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def test_fold(spark):
    rows = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", None), (1, 2, 2, "delta", None, "He"), (1, 3, 2, "delta", None, "llo"),
        (1, 4, 2, "regenerate", None, None), (1, 5, 2, "delta", None, "Bye"), (1, 6, 1, "edit", None, "hi there"), (1, 7, 3, "message", "user", "x"), (1, 8, 3, "delete", None, None),
        (1, 9, 2, "delta", None, "!"), (None, 0, 1, "message", None, None),
    ]
    got = {(r["conv_id"], r["role"]): r["text"] for r in chat.fold_events(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {(1, "user"): "hi there", (1, "assistant"): "Bye!", (None, ""): ""}


def test_order_of_rows_does_not_matter(spark):
    rows = [(1, k, k // 3, ["message", "delta", "delta"][k % 3], "user", f"t{k}") for k in range(12)]
    a = chat.render(chat.fold_events(spark.createDataFrame(rows, LOG))).first()["formatted"]
    b = chat.render(chat.fold_events(spark.createDataFrame(rows[::-1], LOG).repartition(4))).first()["formatted"]
    assert a == b and a.count(chat.START) == 4


texts = st.text(alphabet=st.sampled_from("ab\\<|>\n[]é😀 "), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|start|>", "\\"]), texts), min_size=1, max_size=4), min_size=1, max_size=6))
def test_read_back(spark, convs):
    rows = [(c, t, role, text) for c, turns in enumerate(convs) for t, (role, text) in enumerate(turns)]
    out = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in out.select("*", chat.read_back(F.col("formatted")).alias("t"), chat.learned(F.col("formatted"), F.col("loss_spans")).alias("l")).collect():
        assert [tuple(x) for x in r["t"]] == convs[r["conv_id"]]
        assert r["l"] == "".join(x for role, x in convs[r["conv_id"]] if role == "assistant")


def test_digests_and_edge_cases(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (2, 0, None, None), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, None, "assistant", "first"), (4, 1, "user", "x" * 50000)]
    d = {r["conv_id"]: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1)))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert d[-1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and d[-1]["loss_chars"] == len(said) and d[-1]["loss_sha256"] == sha(said)
    assert (d[2]["n_turns"], d[2]["turns_sha256"], d[2]["loss_sha256"]) == (1, sha("\n\n"), sha(""))
    assert d[3]["n_turns"] == 2 and d[4]["turns_sha256"] == sha("assistant\nfirst\nuser\n" + "x" * 50000 + "\n")
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_there_is_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_turns(d))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
