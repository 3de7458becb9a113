import hashlib
import random
import tracemalloc
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillage.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


def ids(v, text):
    return [i for w in next(iter(v.encode([text]))) for i in w[3]]


def texts():
    rng = random.Random(4)
    yield from ["", " ", "Don't we'll 'sample I'M", "ΟΔΟΣ ΣΑΣ", "İstanbul ẞ ǅ", "é Å ﬁ", "a\x1cb\x85c\xa0d e​f", "x<|startoftext|>Y <|ENDOFTEXT|><|endoftext|>", "１２３ ½ ٣", "👩‍👩‍👧 日本語のテキスト ไทย", "a" * 3000, "ab" * 500, "=" * 200, "\x00\x01"]
    for _ in range(300):
        yield "".join(rng.choice("aeioutnrs '’.,0é\n\tß日🙂-ΣЖ") for _ in range(rng.randint(1, 200)))
    for _ in range(300):
        yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 33, 40, 64, 65, 130])))


def test_ids_and_text_are_the_library_s(library, vocabulary):
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = ids(vocabulary, t)
        assert got == want, t
        assert vocabulary.decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_character(library, vocabulary):
    """Each character twice between letters, unassigned ones too."""
    chars = [c for c in [*range(0x20000), *range(0x2A000, 0x34000), *range(0x34000, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}{chr(c)}b" for c in chars]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    got = [[i for w in words for i in w[3]] for at in range(0, len(texts), 5000) for words in vocabulary.encode(texts[at : at + 5000])]
    assert [hex(c) for c, x, y in zip(chars, got, want) if x != y] == []


def test_sequences_of_marks(library, vocabulary):
    """Sequences rich in combining marks, of every Unicode version, in any order."""
    rng = random.Random(12)
    marks = [chr(c) for c in range(0x1FFFF) if unicodedata.combining(chr(c))]
    bases = [*"aeiouAnE ", *map(chr, [0xE9, 0x1E9E, 0x3B1, 0x3A3, 0x3C2, 0x5D0, 0x627, 0x915, 0x9C7, 0xE01, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x304B, 0x1F600, 0x11935, 0x1D158])]
    texts = ["".join(rng.choice(bases if rng.random() < 0.4 else marks) for _ in range(rng.randint(1, 12))) for _ in range(8000)]
    texts += ["".join(chr(c) for c in (rng.randrange(0x20, 0x1FFFF) for _ in range(rng.randint(1, 12))) if not 0xD800 <= c < 0xE000) for _ in range(4000)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    got = [[i for w in words for i in w[3]] for words in vocabulary.encode(texts)]
    assert [ascii(t) for t, x, y in zip(texts, got, want) if x != y][:5] == []


def test_both_trees_agree(vocabulary):
    rng = random.Random(9)
    words = [vocabulary.symbols("".join(rng.choice("etaoin shrdlu".replace(" ", "")) for _ in range(rng.randint(1, 32)))) for _ in range(500)]
    assert vocabulary.merge_many([list(w) for w in words], 32) == [vocabulary.merge_one(list(w)) for w in words]


def test_operator(spark, library):
    rows = [(1, "Hello  World", 5), (1, "Hello  World", 5), (2, None, 6), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = bpe.encode(df, PATH, digests=True).collect()
    want = library.encode("Hello World", add_special_tokens=False).ids
    assert sorted((r.id, r.n_tokens) for r in got) == [(1, len(want)), (1, len(want)), (2, 0), (3, 0)]
    row = next(r for r in got if r.id == 1)
    assert row.tokens == want and row.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert {r.id: r.decoded for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}[1] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a text", 0.5)], "doc_id long, text string, n_tokens double")
    with pytest.raises(ValueError, match="n_tokens"):
        bpe.encode(df, PATH, extra=["n_tokens"])
    assert bpe.encode(df.withColumnRenamed("n_tokens", "tokens"), PATH, extra=["tokens"], ids=False).columns == ["id", "n_tokens", "tokens"]
    with pytest.raises(ValueError, match="decoded"):
        bpe.decode(bpe.encode(df, PATH).withColumn("decoded", F.lit(1)), PATH)


def test_the_character_tables_take_little_memory():
    tracemalloc.start()
    bpe.newer_characters()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20
