"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tillage.llm import ann, bpe, decontaminate, divergence, html, language, lattice, licenses, linededup, prefixtrie, secrets, simhash, tokencount
from tillage.llm.common import table

#: Where the tokenizers' files are; a parameter of every operator that needs one.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_licenses(spark, d):
    """documents as files: source/lang/thousand/number, of which every fiftieth is its directory's licence file."""
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.col("doc_id").cast("string"))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), name)
    found = licenses.inherit(licenses.scan(table(spark, d, "documents").select(path.alias("path"), "text")))
    doc_id = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("long")
    return found.select(doc_id("path").alias("doc_id"), "path", "license", F.round("score", 6).alias("score"), "origin", doc_id("licensed_by").alias("licensed_by"))


def op2_html(spark, d):
    pages = html.extract(table(spark, d, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_removed")


def op3_tokens(spark, d):
    return tokencount.count_tokens(table(spark, d, "documents"), tokencount.pieces_of(PIECES)).withColumnRenamed("id", "doc_id")


def op4_decontaminate(spark, d):
    found = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"), window=10)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_secrets(spark, d):
    made, words = secrets.made_findings(spark), secrets.dictionary_of(WORD_BPE)
    labelled = secrets.findings(made, path_col="path", dictionary=words).join(made.select(F.col("doc_id").alias("id"), "label"), "id")
    found = secrets.scan(table(spark, d, "documents"), secrets.train(labelled), path_col="source", dictionary=words)
    return found.select(F.col("id").alias("doc_id"), "begin", "end", "kind", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op6_bpe(spark, d):
    found = bpe.encode(table(spark, d, "documents"), WORD_BPE, ids=False, digests=True)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op7_language(spark, d):
    docs = table(spark, d, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~held))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(F.col("id").alias("doc_id"), language.held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"), distance=4, shingle=4, seed=42)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_lines(spark, d):
    found = linededup.dedup_lines(table(spark, d, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_neighbours(spark, d):
    return ann.nearest(table(spark, d, "embeddings"), F.col("id") % 20 == 0, k=20)


def op11_divergence(spark, d):
    return divergence.audit(table(spark, d, "documents"), min_docs=3, top=200)


def op12_lattice(spark, d):
    return lattice.score(table(spark, d, "documents"), lattice.vocabulary(PIECES)).withColumnRenamed("id", "doc_id")


def op13_trie(spark, d):
    return prefixtrie.prefix_trie(table(spark, d, "conversations"), family=5, most=9)


QUERIES = {f.__name__: f for f in (op1_licenses, op2_html, op3_tokens, op4_decontaminate, op5_secrets, op6_bpe, op7_language, op8_simhash, op9_lines, op10_neighbours, op11_divergence, op12_lattice, op13_trie)}

ORACLE: dict[str, str] = {
    "op4_decontaminate": r"""
with recursive d as materialized (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as materialized (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
g as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select g.doc_id, g.n, g.i, win.item_id from g join win on g.n = win.n and g.t = win.t),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from hits group by doc_id)
select d.doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join items using (doc_id)""",
    "op10_neighbours": """
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where vec_id is not null and embedding is not null),
ok as (select * from e where len(v) = len(list_filter(v, lambda x: x is not null and isfinite(x))) and len(list_filter(v, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, c.vec_id, list_reduce(list_prepend(0.0::double, list_transform(q.v, lambda x, i: x * c.v[i])), lambda a, b: a + b) as score
  from ok q join ok c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 20""",
    "op11_divergence": r"""
with d as materialized (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
tok as (select id, lang, source, t, count(*) as n from (select id, lang, source, unnest(w) as t from d) group by all),
kept as (select lang, t from tok group by lang, t having count(*) >= 3),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source from d),
cells as (select lang, source, t, sum(n) as c from tok join kept using (lang, t) group by all),
n as (select lang, source, sum(c) as n from cells group by all),
p as materialized (select g.lang, g.source, kept.t, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0)::hugeint + 1)) // (coalesce(n, 0)::hugeint + v) as p
  from g join kept using (lang) join v using (lang) left join n using (lang, source) left join cells using (lang, source, t)),
q as (select lang, t, 1 + (1000000000::hugeint * (c + 1)) // (n + v) as q from (select lang, t, sum(c)::hugeint as c from cells group by all) join (select lang, sum(c)::hugeint as n from cells group by lang) using (lang) join v using (lang)),
pairs as (select g.lang, g.source, h.source as item, coalesce(value, 0) as value from g join g h on g.lang = h.lang and g.source <> h.source
  left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all) x
  on g.lang = x.lang and g.source = x.source and h.source = x.item),
found as (select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', t, (p - q) * (p - q) // q from p join q using (lang, t) where c > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found) where part = 'pair' or rank <= 200""",
    "op13_trie": """
with t as (select conv_id, turn, octet_length(encode(coalesce(text, ''))) as b,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as x from conversations where conv_id is not null),
own as (select conv_id, list(struct_pack(x := x, b := b) order by turn nulls first, x) as ts from t group by conv_id),
h as (select conv_id, cast(xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::bigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, i: xor(v >> 1, case when v % 2 = 1 then 3988292384 else 0 end)))) % 9 as bigint) as h from own),
paths as (select o.conv_id, list_concat(coalesce(first.ts, [])[1:h], o.ts[h + 1:]) as p from own o join h using (conv_id) left join own first on first.conv_id = o.conv_id - o.conv_id % 5),
pre as materialized (select conv_id, len(p) as size, d, array_to_string(list_transform(p[1:d], lambda e: e.x), '') as k, array_to_string(list_transform(p[1:d - 1], lambda e: e.x), '') as up, case when d > 0 then p[d].b else 0 end as b
  from (select conv_id, p, unnest(range(0, len(p) + 1)) as d from paths)),
node as materialized (select k, d, any_value(up) as up, any_value(b) as b, min(conv_id) as conv_id, count(*) as n,
  coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where size = d), '') as ends from pre group by k, d),
kids as (select up as k, d - 1 as d, count(*) as n from node where d > 0 group by all),
below as (select k[1:64 * a] as k, a as d, sum((n - 1) * b) as saved, count(*) filter (where leaf) as leaves
  from (select node.k, node.n, b, kids.n is null as leaf, unnest(range(0, node.d + 1)) as a from node left join kids on node.k = kids.k and node.d = kids.d) group by all)
select node.conv_id, node.d as depth, parent.conv_id as parent_conv_id, node.n as n_convs, coalesce(kids.n, 0) as n_children, cast(below.leaves as bigint) as n_leaves, cast(below.saved as bigint) as saved_tokens, sha256(node.ends) as ends_sha256
from node join below on node.k = below.k and node.d = below.d left join kids on node.k = kids.k and node.d = kids.d left join node parent on node.d > 0 and parent.k = node.up and parent.d = node.d - 1""",
}
