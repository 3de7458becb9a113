"""The registered queries by contract: columns, types, digests, null, empty and repeated rows, empty tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_divergence import brute as brute_divergence, rows_of as divergence_of
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_prefixtrie import brute as brute_trie, rows_of as nodes_of
from tests.llm.test_simhash import brute as brute_groups
from tillage.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string"
COLUMNS = {
    "op1_licenses": {"doc_id": "bigint", "path": "string", "license": "string", "score": "double", "origin": "string", "licensed_by": "bigint"},
    "op2_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_tokens": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op4_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_secrets": {"doc_id": "bigint", "begin": "bigint", "end": "bigint", "value_sha256": "string", "is_secret": "boolean"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_lines": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "text_sha256": "string"},
    "op10_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op11_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op12_lattice": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op13_trie": {**dict.fromkeys(["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], "bigint"), "ends_sha256": "string"},
}
ITEM = " ".join(f"bench{i}" for i in range(12))
ROWS = [
    (0, "the cat and the hat sat there\nLicensed under the Apache License, Version 2.0.", "en", "s0"), (50, "Released under the MIT License.\nthe house of the cat and more", "en", "s0"),
    (1, "le chat et la maison de la rue\nune phrase que tout le monde lit", "fr", "s0"), (2, f"some words before {ITEM} and some after", "en", "s1"), (3, None, "en", None), (4, "", None, "s1"),
    (5, 'the token = "97ffa88d7c5f5655e365004e29bd123cdabd722a" of the house', "en", "s1"), (6, "la rue et le chat de la maison\nune phrase que tout le monde lit", "fr", "s1"),
    (7, "12 %%", None, "s1"), (8, "the cat and the hat sat there\nLicensed under the Apache License, Version 2.0.", "en", "s1"), (None, "the hat of the cat", "en", "s0"),
]

TALKS = [(c, t, "user" if t % 2 else None, f"turn {t}" if c % 2 else None) for c in range(12) for t in range(c % 4 + 1)] + [(3, None, "x", "first"), (None, 1, "x", "y")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in [*ROWS, ROWS[2]]], DOCS)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "zz")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(1, "http://a.org/1", "<nav>menu</nav><article><h1>T</h1><p>a&amp;b</p></article>"), (2, None, None), (2, None, None), (3, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0, float(-i)]) for i in range(45)] + [(60, None)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: f(spark, tables) for name, f in Q.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, name):
    types = dict(results[name].dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    if "doc_id" in types and name != "op5_secrets":
        assert sorted(r.doc_id if r.doc_id is not None else -1 for r in results[name].select("doc_id").collect()) == sorted([i if i is not None else -1 for i, *_ in ROWS] + [1])


def test_digests_and_answers(spark, results):
    got = {name: {r.doc_id: r for r in results[name].collect()} for name in COLUMNS if name not in ("op2_html", "op10_neighbours", "op11_divergence", "op13_trie")}
    texts = [(i, t) for i, t, *_ in ROWS if i is not None]
    for i, (n, hit, items) in brute_hits(texts, [(1, ITEM), (2, "zz")]).items():
        r = got["op4_decontaminate"][i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), sha(",".join(items)), hit > 0)
    t = Tokenizer.from_file(Q.WORD_BPE)
    t.no_truncation()
    t.no_padding()
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got["op6_bpe"][i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    for i, r in got["op7_language"].items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (i in (3, 4, 7)) and r.lang_pred in ("en", "fr", "und")
    for i, (fp, component) in brute_groups(texts).items():
        assert got["op8_simhash"][i].component_id == component and (got["op8_simhash"][i].fingerprint in (fp, f"{fp:016x}" if isinstance(fp, int) else fp))
    lines = brute_lines([(-1, ROWS[-1][1]), *texts])
    assert all(got["op9_lines"][i].text_sha256 == (None if lines[i] is None else sha(lines[i])) for i, _ in texts)
    assert got["op1_licenses"][50].license == "MIT" and got["op1_licenses"][0].license == "Apache-2.0" and (got["op1_licenses"][1].license, got["op1_licenses"][3].license) == (None, None)
    secret = got["op5_secrets"][5]
    assert secret.is_secret and secret.value_sha256 == sha("97ffa88d7c5f5655e365004e29bd123cdabd722a") and got["op3_tokens"][3].n_tokens == 0
    pages = sorted((r.page_id, r.url, r.text, r.n_chars) for r in results["op2_html"].where("page_id <> 2").collect())
    assert pages == [(1, "http://a.org/1", "T a&b", 5), (3, "u", "", 0)] and [r.text for r in results["op2_html"].where("page_id = 2").collect()] == ["", ""]
    assert divergence_of(results["op11_divergence"]) == brute_divergence([*[(i, t, lang, s) for i, t, lang, s in ROWS], ROWS[2]])
    assert nodes_of(results["op13_trie"]) == brute_trie(TALKS)
    learnt = [r for r in [*ROWS, ROWS[2]] if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    for i, text, *_ in ROWS:
        r = got["op12_lattice"][i]
        assert (r.n_tokens, r.held_out) == (1 + len((text or "").encode().split()), i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.train_tokens == sum(1 + len((t or "").encode().split()) for _, t, *_ in learnt) and r.score < 0 and r.base_score < 0 and (r.held_out or r.n_known == r.n_tokens)
    near = results["op10_neighbours"].collect()
    assert {r.query_id for r in near} == {0, 20, 40} and all(sorted(x["rank"] for x in near if x.query_id == q) == list(range(1, 21)) for q in (0, 20, 40))


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{tables}/{name}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert {name: f(spark, str(tmp_path)).count() for name, f in Q.QUERIES.items()} == dict.fromkeys(Q.QUERIES, 0)
