import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillage.llm import language as L

D = "/root/testdata/sf0.001"


def plain_bits(text, counts):
    """PPM by its definition, one byte at a time."""
    data, total = b"\0" * L.ORDER + text, 0.0
    for i in range(L.ORDER, len(data)):
        for k in range(L.ORDER, -1, -1):
            here = counts[k].get(data[i - k : i])
            if not here:
                continue
            n, d = sum(here.values()), len(here)
            if data[i] in here:
                total += math.log2((n + d) / here[data[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_are_exact(spark):
    rows = [(1, "the cat and the hat, then", "en"), (2, "le chat et la tête", "fr"), (3, "that then", "en"), (4, "là", "fr"), (5, None, "en"), (6, "zz", None)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    for j, lang in enumerate(model.languages):
        counts = [{} for _ in range(L.ORDER + 1)]
        for _, text, own in rows:
            if own == lang and text:
                data = b"\0" * L.ORDER + text.encode()
                for i in range(L.ORDER, len(data)):
                    for k in range(L.ORDER + 1):
                        counts[k].setdefault(data[i - k : i], Counter())[data[i]] += 1
        for text in ("the tête", "chat then unknown ÿ", "x", "thethe hat là" * 30):
            assert model.code_lengths(text.encode())[j] == pytest.approx(plain_bits(text.encode(), counts), rel=1e-5)


def test_held_out_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = L.train(docs.where(~L.held_out(F.col("doc_id"))))
    got = L.identify(docs.where(L.held_out(F.col("doc_id"))), model, extra=["lang"]).collect()
    assert all(zlib.crc32(str(r.id).encode()) % 4 == 2 for r in got) and len(got) > 30
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 %%"), (4, "a"), (None, "é" * 300000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = {r.id: r.lang_pred for r in L.identify(odd, model).collect()}
    assert [found[i] for i in (1, 2, 3)] == ["und"] * 3 and found[4] in model.languages and found[None] in model.languages
    assert sorted(r.id for r in L.identify(odd.union(odd), model).collect() if r.id) == [1, 1, 2, 2, 3, 3, 4, 4] and L.identify(odd.limit(0), model).count() == 0
    nothing = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs.limit(3), nothing).collect()} == {"und"}


def test_many_languages(spark):
    """The sample of each shrinks as languages come in; the model stays within the broadcast bound."""
    words = [[chr(97 + (7 * i + j) % 26) + chr(97 + (3 * i + 5 * j) % 26) + "aeiou"[(i + j) % 5] for j in range(12)] for i in range(30)]
    rows = [(i * 100 + k, " ".join(words[i][(k * m) % 12] for m in range(1, 40)), f"l{i:02}") for i in range(30) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df, all_docs=300)
    assert len(model.languages) == 30
    got = L.identify(df, model, extra=["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a text", 0.5)], "doc_id long, text string, score double")
    with pytest.raises(ValueError, match="score"):
        L.identify(df, L.Model([], {}), extra=["score"])
