from hypothesis import given, settings
from hypothesis import strategies as st

from saldo.llm import chat, registry

SF = "/root/testdata/sf0.01"
pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", ">", "[", "]", "/", "a", "\n", "<\\/s>", "<\\\\s>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|end|>", ""]), pieces), max_size=6))
def test_examples_hold_every_turn_and_reply_once(turns):
    got = list(chat.expand(turns))
    assert [r for r in (chat.unescape(f[a:b]) for k, f, a, b in got if turns[k][0] == "assistant")] == [t for r, t in turns if r == "assistant"]
    for k, f, a, b in got:
        assert chat.parse(f) == turns[: k + 1]
    assert not turns or chat.parse(got[-1][1]) == turns


def test_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["op9_chat"]).fetchall())
    assert sorted(tuple(r) for r in registry.op9_chat(spark, SF).collect()) == want


def test_nulls_ties_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(1, None, None, None, "z"), (1, 0, "assistant", None, "z"), (1, 0, "assistant", None, "z"), (None, 1, "user", "hi", "z")]
    got = chat.examples(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["conv_id"] or 0, r["example"], len(chat.parse(r["formatted"]))) for r in got) == [(0, 0, 1), (1, 0, 2), (1, 1, 3)]
    assert chat.examples(spark.createDataFrame([], kind)).count() == 0


def test_long_conversation(spark):
    rows = [(5, k, ["user", "assistant"][k % 2], "x" * 50) for k in range(600)]
    got = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.count() == 300
