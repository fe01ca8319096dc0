import hashlib

import pytest

from rollcall.llm import chat_format as cf

from .data import with_clashes

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi \\ <s> there"), (1, 2, "assistant", "[INST]</s>\\[/INST]\n"),
    (2, 1, "assistant", "b"), (2, 0, "user", None), (2, 2, "user", "left open"),
    (3, 0, "assistant", "first"), (4, 0, "tool", "[ROLE]x[/ROLE]\\"), (4, 1, None, "no role"), (4, None, "user", "no turn"),
    (5, 0, "user", ""), (5, 1, "assistant", ""), (5, 1, "assistant", ""), (None, 0, "user", "q"), (None, 1, "assistant", "é😀" * 3000),
    (6, 0, "user", "<<SYS>><</SYS>>[/TURN]\\\\[INST"), (6, 1, "assistant", "\\"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_columns_that_clash(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    more = with_clashes(rows, "segments", "State", "valid", "turns", "formatted", "a.b")
    out = cf.format_conversations(more)
    assert out.columns == cf.format_conversations(rows).columns
    assert sorted(map(str, out.collect())) == sorted(map(str, cf.format_conversations(rows).collect()))


def test_round_trip(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in cf.query(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    groups = {-7: [("user", said), ("assistant", said)]}
    for c, t, role, text in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0)):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    valid = {c: c in (-7, 1, None, 6) for c in groups}
    for c, turns in groups.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["valid"] == valid[c], c


def test_no_control_string_is_left(spark):
    out = cf.format_conversations(spark.createDataFrame(ROWS, SCHEMA)).collect()
    for r in out:
        texts = [s["text"] for s in r["segments"][1::3]]
        assert not [(x, c) for x in texts for c in cf.TEMPLATE.all_controls() if c in x]


@pytest.mark.parametrize("turns,state", [(["user", "assistant"], "assistant"), (["system", "user"], "user"), (["user", "user"], "error"), (["user", "system"], "error"), (["user", "assistant", "user", "assistant"], "assistant")])
def test_machine(spark, turns, state):
    rows = spark.createDataFrame([(1, k, r, "x") for k, r in enumerate(turns)], SCHEMA)
    out = cf.format_conversations(rows).first()
    assert (out["state"], out["valid"]) == (state, state == "assistant")


def test_another_template(spark):
    template = cf.Template({"human": cf.Role("<|h|>", "<|e|>"), "bot": cf.Role("<|b|>", "<|x|>", True)}, {"start": ["human"], "human": ["bot"], "bot": ["human"]}, ["bot"])
    rows = spark.createDataFrame([(1, 0, "human", "<|b|>"), (1, 1, "bot", "<|x|>\\")], SCHEMA)
    out = cf.format_conversations(rows, template).select(cf.joined("segments").alias("f"), "valid")
    row = out.select("f", cf.read_turns(out["f"], template).alias("t"), "valid").first()
    assert row["f"] == "<|h|><\\|b|><|e|><|b|><\\|x|>\\\\<|x|>" and row["valid"]
    assert [tuple(t) for t in row["t"]] == [("human", "<|b|>"), ("bot", "<|x|>\\")]


def test_plan_is_native(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    plan = cf.query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_empty(spark):
    assert cf.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
