from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.llm import chat

PIECES = ["</s>", "[INST]", "<s>", "\\", "<<SYS>>", "\\\\<", "/s>", "a", "\n", "é", "<<TEXT>>", "<</TURN>>", "<\\/s>", "[", "$1", ""]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 5), st.sampled_from(["user", "assistant", "system", "tool", "[INST]\\", "", None]), st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=9).map("".join))), min_size=1, max_size=40))
def test_formatting_is_reversible(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select("conv_id", "segments", "formatted", chat.parse_chats(F.col("formatted")).alias("turns"), chat.loss_text("segments").alias("loss")).collect()
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    assert sorted(r.conv_id for r in out) == sorted({r[0] for r in rows})
    for r in out:
        want = [(x[2], x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=key)]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        for s in r.segments[1::3]:
            assert not any(c in s.text for c in chat.LLAMA.controls)


def test_turn_order_and_defined_cases(spark):
    orders = {1: "user assistant", 2: "system user", 3: "assistant user", 4: "user user", 5: "system user assistant user assistant", 6: "user tool", 7: "system", 8: "user assistant system"}
    rows = [(c, i, r, "x") for c, o in orders.items() for i, r in enumerate(o.split())]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    assert {r.conv_id for r in chat.format_chats(df).where("valid").collect()} == {1, 2, 5}
    lone = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (9, None, "user", "long " * 30000)], "conv_id long, turn long, role string, text string")
    assert sorted((str(r.conv_id), len(r.segments)) for r in chat.format_chats(lone).collect()) == [("9", 3), ("None", 3), ("None", 3)]
    assert chat.format_chats(df.limit(0)).collect() == []
