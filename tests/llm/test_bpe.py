import base64
import random

import tiktoken
from tokenizers import Tokenizer

from quoin.llm.bpe import PATTERN, TOKENIZER_DIR, ByteBpe, encode_corpus, encoder

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


def peer():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_has_its_merge():
    e = encoder(PATH).bpe
    assert len(e.ids) == 50256 and len(e.halves) == 50000


def test_other_vocabulary():
    e = ByteBpe.load(f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken")
    assert len(e.halves) == len(e.ids) - 256


def test_against_two_libraries():
    e, a = encoder(PATH), peer()
    b = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    b.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = list("abc XYZ  \n\t'éñ漢字ひ　\x85\x1c​\xa0😀½²1٣ـ́'ll")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("abehlnostrui") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", " ", "a" * 50_000, " " * 5000 + "x", "漢" * 3000, "I'll don't 'S"]
    for t in texts:
        assert e.bpe.encode_ordinary(t) == a.encode_ordinary(t)
        packed = e.packed(t)
        assert [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)] == a.encode_ordinary(t)
    got = [x.ids for x in b.encode_batch(texts[:500] + texts[-6:], add_special_tokens=False)]
    assert got == [a.encode_ordinary(t) for t in texts[:500] + texts[-6:]]


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, " ", "x"), (4, "word " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()]
    a = peer()
    assert sorted(got, key=str) == sorted([(i, a.encode_ordinary(t or "")) for i, t, _ in rows], key=str)
    assert encode_corpus(df.limit(0)).count() == 0
