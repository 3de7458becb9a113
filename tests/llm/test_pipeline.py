"""The pipeline's stages against plain Python on a small table."""

import hashlib
import random

import corpus_pipeline as C
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import split
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute as brute_groups


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    spell = {"en": ["the", "and", "with", "thing", "tion", "house"], "fr": ["les", "des", "eaux", "été", "mais", "où"]}
    prose = lambda lang, n: " ".join(rng.choice(spell[lang]) + rng.choice(spell[lang]) for _ in range(n))
    item = " ".join(f"bench{i}" for i in range(14))
    rows = [(i, "\n".join(prose(lang, rng.randint(8, 30)) for _ in range(4)), lang) for i, lang in enumerate(["en", "fr"] * 15)]
    rows += [(50, rows[3][1], "fr"), (51, rows[4][1] + "\n" + prose("en", 20), "en"), (52, prose("en", 40) + f" {item} " + prose("en", 10), "en"), (53, item, "en"), (54, None, "en"), (55, "%% 123", None), (56, "", "fr")]
    rows += [rows[0]]
    docs = spark.createDataFrame([(i, t, lang, "src1", len(t or ""), "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES:
        before, docs = docs, C.cut(stage(spark, docs, str(tmp_path)))
        seen[name] = (before.collect(), docs.collect())
        if name != C.STAGES[-1][0]:
            assert docs.columns == before.columns and all(r.n_chars == len(r.text or "") for r in seen[name][1])
    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {54, 55, 56} and all(r.lang == "fr" for r in after if r.doc_id < 30 and r.doc_id % 2)
    before, after = seen["line_dedup"]
    want = brute_lines([(r.doc_id, r.text) for r in {(r.doc_id, r.text): r for r in before}.values()])
    assert {r.doc_id: r.text for r in after} == {i: t for i, t in want.items() if t.strip()}
    before, after = seen["near_duplicates"]
    groups = brute_groups([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in groups.values()})
    before, after = seen["decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {53} and not any("bench" in r.text for r in after)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.tokens for r in seen["tokens"][1]} == {r.doc_id: t.encode(r.text, add_special_tokens=False).ids for r in after}
    for r in seen["tokens"][1]:
        assert r.decoded_sha256 == hashlib.sha256(t.decode(r.tokens, skip_special_tokens=False).encode()).hexdigest()
    assert C.run(spark, str(tmp_path)).count() == len(after) and split(item)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
