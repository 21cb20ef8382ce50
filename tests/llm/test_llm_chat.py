"""Chat formatting: round trips, merged turns and the loss runs."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tillscope.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, turns int, formatted string"
ODD = r"<turn user>a</turn>" + "\n" + r"<\turn x<\\/turn><next><\next>\n &lt; <b> é🙂"
ROWS = [
    (1, 2, "assistant", "c"), (1, 0, "system", "a"), (1, 1, "user", ODD), (1, 3, "assistant", ODD), (1, 4, "user", None),
    (2, 0, "we<ird>&amp;", "x"), (2, 1, None, "y"), (2, 2, "", "z"), (3, 0, "assistant", "<"), (3, 1, "assistant", "next>"),
    (3, 1, "assistant", "next>"), (3, 1, "user", "tie"), (3, None, "assistant", "first"), (None, 0, "user", "no id"),
    (4, 0, "user", ""), (5, 0, "assistant", "word " * 100_000 + ODD), (6, 0, "Assistant", "other role"),
]


def plain(rows):
    """conv_id: turns in order, as (role, text)."""
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(role, text) for _, _, role, text in sorted(own)] for conv, own in turns.items()}


@pytest.fixture(scope="module")
def formatted(spark):
    table = spark.createDataFrame([(*r, 1, "clash") for r in ROWS], SCHEMA)
    return chat_format.format_conversations(table.repartition(4))


def test_texts_are_read_back(formatted):
    read = formatted.select("conv_id", chat_format.read_back(F.col("formatted")).alias("blocks")).collect()
    found = {r["conv_id"]: [(b["role"], t) for b in r["blocks"] for t in b["texts"]] for r in read}
    assert found == plain(ROWS)
    for row in read:
        roles = [b["role"] for b in row["blocks"]]
        assert all(a != b for a, b in zip(roles, roles[1:], strict=False))


def test_form_of_a_conversation(formatted):
    text = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    assert text[4] == "<turn user></turn>\n"
    assert text[3] == "<turn assistant>first<next><<next>next><next>next></turn>\n<turn user>tie</turn>\n"
    assert text[2].startswith("<turn we&lt;ird&gt;&amp;amp;>x</turn>\n<turn >y<next>z</turn>\n")


def test_runs_cover_the_text_and_mark_the_answers(formatted):
    for row in formatted.collect():
        at, masked = 0, []
        for run in row["loss_runs"]:
            if run["loss"]:
                masked.append(row["formatted"][at : at + run["chars"]])
            at += run["chars"]
        assert at == len(row["formatted"])
        own = [text for role, text in plain(ROWS)[row["conv_id"]] if role == "assistant"]
        import re

        assert [re.sub(chat_format.QUOTED, r"<\1\2", m) for m in masked] == own


def test_digests(spark):
    table = spark.createDataFrame([(*r, 1, "clash") for r in ROWS], SCHEMA)
    found = {r["conv_id"]: r for r in chat_format.chat_digests(table).collect()}
    extra = [(-7, 0, "user", chat_format.EXTRA_TEXT), (-7, 1, "assistant", chat_format.EXTRA_TEXT)]
    expected = plain(ROWS + extra)
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        row, under = found[conv], "".join(t for r, t in turns if r == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(under), sha256(under.encode()).hexdigest())
    assert [r["conv_id"] for r in chat_format.chat_digests(table.limit(0)).collect()] == [-7]
    assert chat_format.format_conversations(table.limit(0)).collect() == []


def test_a_conversation_of_many_turns(spark):
    many = spark.range(60_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 5 < 2, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"),
    )
    row = chat_format.conversation_digests(chat_format.format_conversations(many)).first()
    under = "".join(str(i) for i in range(60_000) if i % 5 >= 2)
    assert (row["n_turns"], row["n_blocks"]) == (60_000, 24_000)
    assert row["loss_sha256"] == sha256(under.encode()).hexdigest()


def test_no_python_workers(spark):
    table = spark.createDataFrame([(*r, 1, "clash") for r in ROWS], SCHEMA)
    plan = chat_format.chat_digests(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
