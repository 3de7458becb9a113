"""The audit against plain Python on whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillage.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs=3, top=200):
    """{(lang, source, part, item): (value, rank)}."""
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = {}
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        total = sum(own.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept))

        f = lambda p, q: (p - q) ** 2 // q
        for s, c in own.items():
            pairs = {o: sum(f(share(c, t), share(own[o], t)) for t in kept) for o in own if o != s}
            found = {t: f(share(c, t), share(total, t)) for t in kept if c[t] and share(c, t) > share(total, t)}
            for part, values, last in (("pair", pairs, len(pairs)), ("term", found, top)):
                for rank, item in enumerate(sorted(values, key=lambda i: (-values[i], i.encode()))[:last], 1):
                    out[lang, s, part, item] = (values[item], rank)
    return out


def rows_of(df):
    got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["Été", "été", "DER", "der", "x1y", "日本", "a_b", "ÀÉ", "it's", "🙂", "K"] + ["w" + chr(97 + i % 26) * (1 + i // 26) for i in range(60)]
    made = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ü", "Z", None])) for i in range(150)]
    # a language of one source, a source without terms, a language without kept terms, repeated rows, a very long text
    made += [(900, "one two one", "solo", "only")] * 3 + [(901, None, "en", "silent"), (902, "", "few", "p"), (903, "rare", "few", "q"), (903, "rare", "few", "q"), (904, "der " * 50_000, "en", "a")]
    return made


@pytest.mark.parametrize("groups", [D.BROADCAST_GROUPS, 0])
def test_audit(spark, rows, groups):
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.lit(1) for c in ("term", "n", "documents", "rank", "value", "item", "n_terms", "part")})
    assert rows_of(D.audit(clashing, broadcast_groups=groups)) == brute(rows)
    assert rows_of(D.audit(df, min_docs=1, top=2, broadcast_groups=groups)) == brute(rows, 1, 2)


def test_small_batches_of_counts(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "HELD", 3)
    df = spark.createDataFrame(rows, SCHEMA).select("text", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    found = [b.to_pylist() for b in D._count(iter(df.toArrow().to_batches()))]
    total = Counter()
    for part in found:
        for r in part:
            total[r["lang"], r["term"]] += r["documents"]
    assert total["solo", "one"] == 3 and total["few", "rare"] == 2 and len(found) > 10


def test_empty_and_void(spark, rows):
    assert D.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    void = spark.createDataFrame([(1,), (2,)], "doc_id long").withColumns({c: F.lit(None) for c in ("text", "lang", "source")})
    assert D.audit(void).count() == 0  # one language, one source, no term


def test_shares_are_exact_beyond_long(spark):
    cases = [(0, 1), (9_223_372_032, 10**13 + 7), (9_223_372_034, 10**13 + 7), (10**15 + 3, 3 * 10**15 + 1), (5, 7)]
    df = spark.createDataFrame(cases, "c long, t long")
    assert [r[0] for r in df.select(F.expr(D._share("c", "t"))).collect()] == [1 + 10**9 * (c + 1) // t for c, t in cases]
