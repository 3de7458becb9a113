import random
import re

import pytest
from pyspark.sql import functions as F

from tillage.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    few = [f"w{i}" for i in range(6)] + ["É", "ñ9"]
    items = [(k, " ".join(rng.choice(few) for _ in range(rng.randint(1, 40) if k % 4 else rng.randint(5, 9)))) for k in range(30)] + [(90, None), (91, " ... "), (92, "Uno, dos; TRES")]
    docs = []
    for k in range(80):
        words = [rng.choice([*few, "out"]) for _ in range(rng.randint(0, 120))]
        if k % 2:
            at, item = rng.randint(0, len(words)), split(rng.choice(items)[1])
            words[at:at] = item[rng.randint(0, 3) :]
        docs.append((k, rng.choice([" ", "-\n", "`"]).join(words).upper()))
    docs += [(900, None), (901, ""), (902, "uno dos [tres] cuatro"), (903, "ÉÑ x"), (903, "ÉÑ x")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0))
    for few_items in (items, [(i, t) for i, t in items if i % 4 != 0 and t and len(split(t)) >= 10], []):
        got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in D.contamination(d, spark.createDataFrame(few_items, "item_id long, text string")).collect()}
        assert got == brute(docs, few_items)


def test_cleaning_and_limits(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Before it. {item.upper()}! After it"), (2, item), (3, "clean  text\n")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.id: r.cleaned for r in D.contamination(docs, items, max_cover=0.8).collect()}
    assert got == {1: "Before it.! After it", 2: None, 3: "clean  text\n"}


def test_blocks(spark, monkeypatch):
    """Items in many automata, one after the other, give what one gives; cut texts are matched again."""
    rng = random.Random(3)
    items = [(k, " ".join(f"a{k}x{i}" for i in range(12))) for k in range(9)] + [(20, None), (21, "--")]
    words = [split(t) for _, t in items[:9]]
    docs = [(k, f"zz {t} zz") for k, t in items if t] + [(100 + k, " ".join(words[k % 9][:6] + words[(k + 1) % 9] + words[k % 9][6:] + ["tail"] * rng.randint(0, 30))) for k in range(20)]
    docs += [(300, None), (301, ""), (302, "clean  text")] + docs[:2]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    of = lambda **more: sorted(map(str, D.contamination(d, i, extra=["row"], **more).collect()))
    want = of(max_cover=0.7)
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    found = D.contamination(d, i, extra=["row"], max_cover=0.7).collect()
    assert len(D._blocks(i)) > 2 and sorted(map(str, found)) == want
    assert {r.id: (r.n_words, r.n_hit, r["items"]) for r in found} == brute(docs, items)


def test_repeated_items_are_listed_once_whatever_the_blocks(spark, monkeypatch):
    items = [(7, "one two three four"), (7, "five six seven"), (7, "one two three four"), (8, "eight nine")]
    docs = [(1, "x one two three four y five six seven z eight nine"), (2, "five six seven"), (2, "five six seven")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (D.BLOCK_BYTES, 16):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = sorted((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.contamination(d, b).collect())
        assert got == [(1, 12, 9, ("7", "8")), (2, 3, 3, ("7",)), (2, 3, 3, ("7",))]
    with pytest.raises(ValueError, match="n_words"):
        D.contamination(d.withColumn("n_words", F.lit(1)), b, extra=["n_words"])
