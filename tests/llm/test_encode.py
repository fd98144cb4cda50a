import os
import random

import pytest

from strandwise.llm import bpe, encode

FOLDER = os.environ.get("TOKENIZERS", encode.TOKENIZERS)
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/byte_bpe_50k.json"), reason="public tokenizers aren't here")

TEXTS = [
    "", " ", "\n\n  x", "Hello world, it's 3.14!", "naïve café — ½ Ⅷ ²", "日本語のテキスト、テスト。", "Привет, мир!", "👨‍🍳 🌿🏽", "a" * 3000, "<|endoftext|> <|startoftext|>",
    " ​ x　y", "don't I'LL we'Ve", "\t\ttabs   and   spaces   ", "x" * 17 + " " * 40 + "y", "ﬁ ß İ ı", "�", "0123456789" * 5,
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def noise(rnd):
    return "".join(rnd.choice(["e", "th", " the", "ing", " ", "  ", "\n", "é", "ж", "中", "🙂", "'s", "9", "_", "-", "A", "zq"]) for _ in range(rnd.randint(0, 60)))


def test_ids_and_streaming_decode(reference):
    t = bpe.Transducer(bpe.load_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken"))
    rnd = random.Random(1)
    for x in TEXTS + [noise(rnd) for _ in range(400)]:
        ids = t.encode(x)
        assert ids == reference(x), x
        assert "".join(bpe.decode(ids, t.spelling)) == x


def test_tables_are_bounded(reference):
    t = bpe.Transducer(bpe.load_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken"), max_states=50, max_words=5)
    rnd = random.Random(2)
    for _ in range(60):
        x = noise(rnd)
        assert t.encode(x) == reference(x)
        assert len(t.words) <= 7


def test_broken_bytes_decode_as_the_standard_advises():
    rnd = random.Random(3)
    for _ in range(500):
        data = bytes(rnd.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xED, 0xA0, 0xF0, 0x90, 0xF4, 0xFF]) for _ in range(rnd.randint(0, 12)))
        machine = bpe.Utf8Machine()
        assert machine.feed(data) + machine.close() == data.decode("utf-8", "replace")


def test_rows_nulls_and_clashing_columns(spark, reference):
    rows = [(i, x, [1]) for i, x in enumerate(TEXTS)] + [(99, None, None), (0, "again", None), (None, "no id", None), (100, "long text. " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = sorted(((r[0], r[1]) for r in encode.encoded(df, folder=FOLDER).collect()), key=str)
    assert got == sorted(((i, reference(x or "")) for i, x, _ in rows), key=str)
    assert encode.round_trips(df, folder=FOLDER).where("not same").count() == 0
    assert {(r[0], r[1]) for r in encode.token_counts(df, folder=FOLDER).collect()} == {(i, len(reference(x or ""))) for i, x, _ in rows}
    assert encode.encoded(df.limit(0), folder=FOLDER).count() == 0


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        encode.encoded(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "piece_bpe_32k")
