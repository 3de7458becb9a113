import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tillage.llm import tokencount as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces):
    """The same vocabulary in a unigram tokenizer with byte fallback."""
    vocabulary = [("<unk>", 0.0), *pieces, *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    low = min(s for _, s in pieces)
    t = Tokenizer(models.Unigram([(p, s if s else 0.0) for p, s in vocabulary], 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=T.SPACE, prepend_scheme="always", split=True)
    assert low < 0
    return t


def test_counts_are_the_library_s(spark):
    rng = random.Random(6)
    pieces = T.pieces_of(PATH)
    assert len(pieces) > 31000
    t, counter = library(pieces), T.Counter(pieces)
    texts = ["a", "Hello  world", "\n\nx", "日本語 ☃ 🙂🙂", "aaaaaaaaaaaaaaaa", T.SPACE + "x", "x" + T.SPACE * 3, " lead", "trail "]
    texts += ["".join(rng.choice("etaoinshrdlu  \nÉß日🙂.") for _ in range(rng.randint(1, 120))) for _ in range(500)]
    for x in texts:
        assert counter.text(x)[0] == len(t.encode(x, add_special_tokens=False).ids), x
    df = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (4, "x" * 200000)], "doc_id long, text string").withColumn("n_tokens", F.lit(0))
    got = sorted((r.id, r.n_tokens, r.n_words) for r in T.count_tokens(df, pieces).collect())
    n = counter.text("Hello world")[0]
    assert got[:4] == [(1, n, 2), (1, n, 2), (2, 0, 0), (3, 0, 0)] and got[4][1] > 1000


def test_ties_take_the_earliest_start():
    pieces = [("ab", -1.0), ("c", -1.0), ("a", -1.0), ("bc", -1.0), ("b", -1.0), (T.SPACE, 0.0), ("d", -5.0), ("abc", -2.0)]
    t, counter = library([*pieces, ("zz", -3.0)]), T.Counter([*pieces, ("zz", -3.0)])
    for x in ("abc", "abcabc", "abcd", "dabc", "zzabc", "qqabc", "bcabc"):
        assert counter.text(x)[0] == len(t.encode(x, add_special_tokens=False).ids), x
