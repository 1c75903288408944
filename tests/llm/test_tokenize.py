import os
import random

import pyarrow as pa
import pytest

from ravand.llm import tokenize as tok

PATH = os.environ.get("RAVAND_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer file")


def encode(texts, encoder):
    ids, offs = encoder.encode(pa.array(texts, pa.string()))
    return [ids[offs[i] : offs[i + 1]].tolist() for i in range(len(texts))]


def test_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    rng = random.Random(1)
    pool = list("aab's'tred lvmS  \n\t1２。é‌́سلام ") + ["'ll", "'re ", "  ", "<|endoftext|>", "'", "\xa0", "🎙️", "語"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", " ", "aaaaaaaaaaaaa", "x" * 50_000]
    encoder = tok.Encoder(tok.load_vocabulary(PATH))
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        assert encode(part, encoder) == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_forgetting_changes_nothing(monkeypatch):
    vocab = tok.load_vocabulary(PATH)
    texts = ["one two three", "four five", "one two"]
    whole = encode(texts, tok.Encoder(vocab))
    monkeypatch.setattr(tok, "REMEMBERED", 2)
    small = tok.Encoder(vocab)
    assert [encode([t], small)[0] for t in texts] == whole


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "  "), (1, "Hello world")], "doc_id bigint, text string").selectExpr("*", "'clash' as ids")
    rows = [(r["doc_id"], list(r["ids"])) for r in tok.encode_corpus(df, "doc_id", "text", PATH).collect()]
    assert sorted(rows) == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, []), (4, [220, 220])]
    assert tok.encode_corpus(df.where("false"), "doc_id", "text", PATH).count() == 0
