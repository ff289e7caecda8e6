"""Chat formatting: exact round trips and masks."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from bandweave.llm import chat
from bandweave.llm.queries import op6_chat_formatting
from bandweave.llm.tokens import byte_level_offsets

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trips():
    draw = random.Random(7)
    parts = ["<|", "|>", "\\", "<", "|", ">", "\n", "a", "é🎉", "<|end|>\n", "<|user|>\n", "</s>[INST]", "\\\\", "<\\|"]
    for _ in range(2000):
        turns = [("".join(draw.choice(parts) for _ in range(draw.randint(0, 3))), "".join(draw.choice(parts) for _ in range(draw.randint(0, 8)))) for _ in range(draw.randint(0, 4))]
        formatted, _ = chat.render(turns)
        assert chat.parse(formatted) == turns


def test_masks_cover_each_learnt_text_once():
    library = Tokenizer.from_file(BYTE)
    turns = [("user", "hé🎉"), ("assistant", "日本🎉 <|end|> x"), ("assistant", ""), ("user", "b"), ("assistant", "c\n")]
    formatted, spans = chat.render(turns)
    encoded = library.encode(formatted, add_special_tokens=False)
    mask, pieces = chat.masked_tokens(encoded.offsets, spans)
    assert chat.unescape("".join(formatted[a:b] for a, b in pieces)) == "".join(t for r, t in turns if r == "assistant")
    assert len(mask) == len(encoded.ids) and 0 < sum(mask) < len(mask)
    for on, (a, b) in zip(mask, encoded.offsets):
        assert bool(on) == any(a < e and s < b for s, e in spans)


def rows_want(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    out = {}
    for i, turns in by.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        out[i] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got_of(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_all_conversations(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert got_of(op6_chat_formatting(spark, data)) == rows_want([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_messy_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 200_000), (1, 1, "assistant", "a tie"), (1, 1, "assistant", "a tie"), (2, 0, None, "no role"), (3, 5, "assistant", ""), (None, 0, "assistant", "lost")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string, spans string").repartition(3)
    formatted = chat.formatted_conversations(df, BYTE)
    assert got_of(chat.digests(formatted)) == got_of(chat.conversation_digests(df, BYTE)) == rows_want(rows)
    assert sorted(map(repr, chat.digests(formatted).collect())) == sorted(map(repr, chat.conversation_digests(df, BYTE).collect()))
    assert chat.digests(chat.formatted_conversations(df.limit(0), BYTE)).count() == chat.conversation_digests(df.limit(0), BYTE).count() == 0


def test_a_long_conversation(spark):
    """Many turns of one conversation, which is a unit and comes out whole."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <|end|> " * (k % 5)) for k in range(4000)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert got_of(chat.conversation_digests(df, BYTE)) == rows_want(rows)


def test_offsets_are_the_library_s():
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    encode = byte_level_offsets(BYTE)
    draw = random.Random(5)
    texts = ["".join(draw.choice("aé ßñ—€x'12\n\t 日🎉<|endoftext|>") for _ in range(draw.randint(0, 30))) for _ in range(1500)] + ["", "<|endoftext|>", "naïve — “quoted” €5"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False)
        ids, offsets = encode(t)
        assert ids.tolist() == want.ids and [tuple(x) for x in offsets.tolist()] == want.offsets, t
