import hashlib

import public_tokenizers as P
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorespark.llm.bpe import WordBpe, bpe_decode, bpe_encode, loaded
from lorespark.llm.queries import op2_bpe

PATH = P.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)
HARD = ["", " ", "aaaaaaaaaaaaaaaaaaaaaaa", "ΑΣΣ ΟΔΟΣ", "İstanbul", "é é", "a<|endoftext|>b <|startoftext|>", "<|EndOfText|>", "it's we'll I'D 'S", "x\x1cy\x85z w　v", "日本語 テスト", "🙂🙂🙂", "don’t", "1234567890", "́", "ababababab mississippi", "KK ﬁ ß ẞ", "\x00\x01"]


def check(bpe, texts):
    ids, ends = bpe.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == REAL.encode(t, add_special_tokens=False).ids, t


def test_hard_texts():
    check(WordBpe(PATH), HARD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=40), st.text(alphabet="abcinthe 'sÀéÉß|<>!", max_size=60)), max_size=5))
def test_any_text(texts):
    check(loaded(PATH), [t.encode("utf-8", "replace").decode() for t in texts])


def test_corpus_texts():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    check(WordBpe(PATH), texts)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr("lorespark.llm.bpe.REMEMBERED", 5)
    bpe = WordBpe(PATH)
    for k in range(20):
        check(bpe, [f"word{k} other{k * 7} thing"])
    assert len(bpe.chunks) + len(bpe.older) < 20


def test_frames(spark):
    rows = [(k, t, "x") for k, t in enumerate(HARD)] + [(90, None, "x"), (None, "the", "x"), (1, "the", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe_decode(bpe_encode(df, PATH), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == REAL.decode(r.ids, skip_special_tokens=False)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_decode(bpe_encode(empty, PATH), PATH).count() == 0
    odd = spark.createDataFrame([(1, [5, 10**6, -1, 320]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe_decode(odd, PATH).collect()} == {1: REAL.decode([5, 320]), 2: ""}


def test_query(spark):
    out = {r.doc_id: r for r in op2_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist():
        ids = REAL.encode(r["text"], add_special_tokens=False).ids
        x = out[r["doc_id"]]
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(REAL.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_words():
    """Words of many letters, alone and among others, against the library; time grows with the length."""
    import random
    import time

    r = random.Random(3)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    check(WordBpe(PATH), [word(201, "abcdefghij"), f"the {word(5000, 'abcdefghijklmnopqrstuvwxyz')} cat {word(300, 'ab')} {word(150, 'etaoin')}", "a" * 3001, word(2000, "éßab")])
    bpe, seconds = WordBpe(PATH), []
    for n in (50_000, 400_000):
        began = time.process_time()
        bpe.encode([word(n, "abcdefghijklmnopqrstuvwxyz").encode()])
        seconds.append(time.process_time() - began)
    assert seconds[1] < 24 * seconds[0] + 1


def test_word_of_a_million_letters():
    import random

    r = random.Random(4)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    check(WordBpe(PATH), [text])
