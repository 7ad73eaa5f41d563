import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm.chat_format import CONTROLS, PLACEHOLDER, PartVisitor, escape, format_chat, format_turn, parse, read_back, unescape

PIECES = st.lists(st.one_of(st.sampled_from([*CONTROLS, "<|im_start|>", "<|im_end|>\n", "\\", "\\.", "\\n", "<", "|", "\n", "<<s>", "[[INST]"]), st.text(max_size=4)), max_size=8).map("".join)


@given(PIECES)
def test_escape_round_trip_without_controls(text):
    shown = escape(text)
    assert unescape(shown) == text and not any(c in shown for c in CONTROLS)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_turns_round_trip(turns):
    assert parse("".join(format_turn(r, t, PartVisitor())[0] for r, t in turns)) == turns


def test_parts_are_flattened_in_order():
    parts = [{"type": "text", "text": "see <|image_9|> "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, None, {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": None}]
    text, start, end, attachments, tokens = format_turn("assistant", parts, PartVisitor())
    assert PLACEHOLDER.findall(text) == ["<|image_1|>", "<|audio_2|>", "<|document_3|>"]
    assert [(a["ref"], a["tokens"]) for a in attachments] == [("a.png", 4), ("b.wav", 50), ("c.pdf", 1536)] and tokens == 1590
    assert text[start:end].startswith("see ")
    with pytest.raises(ValueError, match="part type"):
        format_turn("user", [{"type": "video"}], PartVisitor())


def test_odd_rows(spark):
    data = [(1, 0, "user", None, 5), (1, 1, "assistant", "a</s>", 5), (1, 1, "assistant", "a</s>", 5), (None, None, None, "x", 5), (2, 0, "us\ner", "", 5), (3, 0, "assistant", "long " * 50000, 5)]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r.conv_id: r for r in read_back(format_chat(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1, 3: 1}
    assert got[1].loss_chars == 10 and got[1].loss_sha256 == hashlib.sha256(b"a</s>a</s>").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"us\ner\n\n").hexdigest() and got[3].loss_chars == 250000
    assert read_back(format_chat(df.limit(0))).count() == 0


def test_turns_of_equal_number_are_ordered_by_role_and_text(spark):
    data = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "user", "first")]
    want = hashlib.sha256(b"user\nfirst\nassistant\nz\nuser\na\nuser\nb\n").hexdigest()
    for deal in (1, 2, 4):
        df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").repartition(deal, "text")
        assert [r.turns_sha256 for r in read_back(format_chat(df)).collect()] == [want]


def test_struct_parts_through_spark(spark):
    df = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array(named_struct('type','image','text',null,'ref','p','width',14,'height',14), named_struct('type','text','text','hi','ref',null,'width',null,'height',null)) AS text")
    row = format_chat(df).collect()[0]
    assert row.formatted == "<|im_start|>user\n<|image_1|>hi<|im_end|>\n" and row.attachment_tokens == 1 and row.attachments[0].ref == "p"
