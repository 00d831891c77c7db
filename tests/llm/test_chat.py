"""Chat formatting: round trips, masks, typed parts."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import chat, entry

MESSAGE = "conv_id long, turn long, role string, text string"
TEXTS = st.text(alphabet=st.sampled_from("\\<>/\"turn part=role\n aeé\U0001f600"), max_size=30)


def formatted(df):
    return chat.format_chunks(df.withColumn("parts", chat.text_part(F.col("text"))))


def read_back(df):
    chunks = formatted(df).select("conv_id", "chunk", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m"))
    out = {}
    for r in chunks.orderBy("conv_id", "chunk").collect():
        turns, mask = out.get(r.conv_id, ([], ""))
        out[r.conv_id] = (turns + [(t.role, t.text) for t in r.t], mask + r.m)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXTS), TEXTS), min_size=1, max_size=40))
def test_any_turns_come_back(spark, turns):
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], MESSAGE)
    assert read_back(df) == {1: (turns, "".join(t for r, t in turns if r == "assistant"))}


def test_many_turns_nulls_ties_and_repeats(spark):
    long = [(7, k, "assistant" if k % 2 else "user", f"text {k} </turn>") for k in range(300)]
    odd = [(8, None, "user", "first"), (8, 1, None, None), (8, 1, "assistant", "b"), (8, 1, "assistant", "b"), (None, 0, "user", "x")]
    got = read_back(spark.createDataFrame(long + odd, MESSAGE))
    assert got[7] == ([(r, t) for _, _, r, t in long], "".join(t for _, _, r, t in long if r == "assistant"))
    assert got[8] == ([("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")], "bb")
    assert got[None] == ([("user", "x")], "")


def test_turns_without_numbers_or_with_equal_ones_fill_bounded_chunks(spark):
    rows = [(1, None, "user", f"text {k:04}") for k in range(500)] + [(2, 5, "assistant", "the same")] * 300
    df = spark.createDataFrame(rows, MESSAGE)
    chunks = formatted(df).select("conv_id", F.size(chat.read_turns(F.col("formatted"))).alias("n")).collect()
    assert max(r.n for r in chunks) <= chat.CHUNK
    assert read_back(df) == {1: ([("user", f"text {k:04}") for k in range(500)], ""), 2: ([("assistant", "the same")] * 300, "the same" * 300)}


def test_a_very_long_text_and_many_parts(spark):
    long = "<turn \\ é " * 60_000
    assert read_back(spark.createDataFrame([(1, 0, "assistant", long)], MESSAGE)) == {1: ([("assistant", long)], long)}
    part = "named_struct('type',if(id % 3 = 0,'text','image'),'text',concat('t',id),'ref',string(id),'width',1,'height',1,'seconds',null,'pages',null)"
    df = spark.sql(f"select 1L conv_id, 0L turn, 'user' role, cast(transform(sequence(0, 8999), id -> {part}) as array<{chat.PART_TYPE}>) parts")
    row = chat.format_chunks(df).first()
    want, n = "", 0
    for k in range(9000):
        n += k % 3 > 0
        want += f"<part image {n}>" if k % 3 else f"t{k}"
    assert want in row.formatted and len(row.attachments) == n


def test_parts_become_ordered_placeholders(spark):
    parts = "array(named_struct('type','text','text','see <part image 1>','ref',null,'width',null,'height',null,'seconds',null,'pages',null), " + ", ".join(
        f"named_struct('type','{t}','text',null,'ref','{r}','width',{w},'height',{h},'seconds',{s},'pages',{p})"
        for t, r, w, h, s, p in (("image", "a.png", 56, 57, "null", "null"), ("audio", "b.wav", "null", "null", "2.5d", "null"), ("document", "c.pdf", "null", "null", "null", 3), ("image", "d.png", "null", "null", "null", "null"))
    ) + ")"
    df = spark.sql(f"select 1L conv_id, 0L turn, 'user' role, cast({parts} as array<{chat.PART_TYPE}>) parts, 'clash' formatted, 'clash' chunk")
    row = chat.format_chunks(df).first()
    assert "see <\\part image 1><part image 1><part audio 2><part document 3><part image 4>" in row.formatted
    assert [(a.attachment.ordinal, a.attachment.ref, a.attachment.tokens) for a in row.attachments] == [(1, "a.png", 6), (2, "b.wav", 63), (3, "c.pdf", 1536), (4, "d.png", 1)]
    assert chat.format_conversations(df.where("false")).count() == 0


def test_query_reads_back_every_conversation(spark):
    got = {r.conv_id: r for r in entry.op1_chat(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    probe = "\\### Assistant: </turn> ok"
    turns = {-7: [("user", probe), ("assistant", probe)]}
    for r in rows:
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert set(got) == set(turns)
    for c, ts in turns.items():
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss))
