"""Divergence of the sources of a language: every kept term as a wide vector of counts over the language's sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillage.llm.common import bytes_of, cut, drop_cut, in_arrow, whole_text

#: Parts of a whole by which shares are counted, so that all arithmetic is on whole numbers.
SCALE = 1_000_000_000
#: (language, source) groups up to which the languages' totals are broadcast, some hundred bytes each; beyond, terms are
#: dealt out and meet a copy of them in each part.
BROADCAST_GROUPS = 100_000
#: Counts of a task that it holds before it hands them on.
HELD = 1_000_000

# Bytes of a term: letters of ASCII, in lower case, and all that is beyond ASCII; any other byte ends it.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, repeats included: runs of ASCII letters and characters beyond ASCII; only A-Z are
    lower-cased."""
    return text.translate(_TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents with it), summed over what a task holds at a time."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in held.items():  # both in the order in which terms came first
            n = len(counts)
            columns = [pa.repeat(lang, n), pa.repeat(source, n), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array(list(documents.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "documents"])
        held.clear()

    for b in batches:
        for text, lang, source in zip(bytes_of(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
            found = terms(text)
            counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(counts)
            counts.update(found)
            documents.update(dict.fromkeys(found).keys())
            size += len(counts)
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def _share(count: str, total: str) -> str:
    """1 + floor(SCALE * (count + 1) / total) as SQL, exact: in decimals where a long would overflow."""
    plain = f"(({count}) + 1) * {SCALE}L div ({total})"
    wide = f"cast((cast(({count}) + 1 as decimal(20,0)) * {SCALE}BD) div cast({total} as decimal(20,0)) as bigint)"
    return f"1L + if(({count}) < {(1 << 63) // SCALE - 2}L, {plain}, {wide})"


def _excess(p: str, q: str) -> str:
    """floor((p - q)^2 / q) as SQL; shares are at most SCALE + 1, so that the square is a long."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def vectors(docs: DataFrame, min_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(languages, terms, counts), all cut. languages: lang, n_terms, sources (ascending), totals (one for each source),
    total. terms: lang, term, n, cells (a map from source to occurrences) of the terms that at least min_docs of a
    language's documents have. counts: lang, source, n and how many kept terms the source has n times."""
    rows = docs.select(whole_text(text_col).alias("text"), *[F.coalesce(whole_text(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))])
    cells = in_arrow(rows, _count, "lang string, source string, term string, n long, documents long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    by_term = cells.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("cells"), F.sum("documents").alias("documents"))
    kept = cut(by_term.where(F.col("documents") >= min_docs).drop("documents"))
    counts = cut(kept.select("lang", F.explode("cells").alias("source", "n")).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("n_terms")))
    zero = F.lit(0).cast("long")
    totals = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("n_terms")).alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", zero))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    languages = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"), F.sum("total").alias("total")).join(sizes, "lang", "left")
    return cut(languages.select("lang", F.coalesce("n_terms", zero).alias("n_terms"), F.col("groups.source").alias("sources"), F.col("groups.total").alias("totals"), "total")), kept, counts


def audit(docs: DataFrame, *, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """How each source of a language differs from its other sources (part "pair") and in which terms it exceeds the
    language (part "term", the first `top`): lang, source, part, item, value, rank.

    A share is 1 + floor(SCALE * (n + 1) / (N + V)): n a term's occurrences, N those of all V kept terms, in the source
    or the language. An item's value is f(p, q) = floor((p - q)^2 / q) for the source's share p against the other's q,
    for a pair summed over all kept terms.

    Each kept term is one row with an array by source, and higher-order functions make its contributions to pairs,
    which are summed on the map side by (lang, source, source). With z the share of a term that a source hasn't,
    f(p, q) = f(z, z) + [f(p, z) - f(z, z)] + [f(z, q) - f(z, z)] + rest: the first is the same for all terms, the
    brackets depend on one source's count and are made once for each count that occurs, and the rest is 0 unless both
    sources have the term. So a term of k out of S sources makes k * (k - 1) rows and not S * S, and the sums are equal.

    Null text, lang and source are empty ones. Rows that repeat count as documents of their own; ids aren't read. A
    source without terms is compared too, and a language with a single source has no pairs. A language without a kept
    term has pairs of value 0. Equal values are ranked by item, by its UTF-8 bytes. An empty table gives no rows, and
    further columns have no effect. Texts are read whole; a task holds the counts of HELD terms or of one text.
    """
    languages, kept, counts = vectors(docs, min_docs, text_col, lang_col, source_col)
    languages = languages.withColumn("zeros", F.expr(f"if(n_terms = 0, transform(totals, n -> 1L), transform(totals, n -> {_share('0L', 'n + n_terms')}))"))
    n_groups = languages.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(rows: DataFrame, by: str) -> DataFrame:
        """rows with the columns of their language, however many rows a language has."""
        if n_groups <= broadcast_groups:
            return rows.join(F.broadcast(languages), "lang")
        copies = languages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).join(copies, ["lang", "part"])

    wide = meet(kept.withColumnRenamed("n", "n_all"), "term")
    wide = wide.withColumn("vector", F.transform("sources", lambda s: F.coalesce(F.try_element_at("cells", s), F.lit(0).cast("long"))))
    present = "filter(transform(vector, (c, i) -> struct(i, c)), x -> x.c > 0)"
    wide = wide.withColumn("shares", F.expr(f"transform({present}, x -> struct(x.i as i, {_share('x.c', 'totals[x.i] + n_terms')} as p))"))

    # pairs: what terms give that both sources have, then what counts of one source give, beyond terms that neither has
    both = wide.select("lang", "zeros", "shares", F.posexplode_outer("shares").alias("at", "own"))  # outer: else a filter on the array's size would make it twice
    both = both.select("lang", "zeros", F.col("own.i").alias("i"), F.col("own.p").alias("p"), F.inline(F.expr("transform(filter(shares, x -> x.i > own.i), x -> struct(x.i as j, x.p as q))")))
    both = both.select("lang", "i", "j", "p", "q", F.expr("zeros[i]").alias("y"), F.expr("zeros[j]").alias("z"))
    rest = lambda p, y, q, z: F.expr(f"{_excess(p, q)} - {_excess(p, z)} - {_excess(y, q)} + {_excess(y, z)}")
    given = both.groupBy("lang", "i", "j").agg(F.sum(rest("p", "y", "q", "z")).alias("there"), F.sum(rest("q", "z", "p", "y")).alias("back"))
    given = given.select("lang", F.inline(F.expr("array(struct(i, j, there as f), struct(j as i, i as j, back as f))")))
    single = meet(counts.withColumnRenamed("n_terms", "times"), "n").withColumn("s", F.expr("array_position(sources, source) - 1").cast("int"))
    single = single.withColumn("p", F.expr(_share("n", "totals[s] + n_terms")))
    ways = f"""flatten(transform(zeros, (z, k) -> array(struct(s as i, k as j, times * ({_excess('p', 'z')} - {_excess('zeros[s]', 'z')}) as f),
      struct(k as i, s as j, times * ({_excess('z', 'p')} - {_excess('z', 'zeros[s]')}) as f))))"""
    single = single.select("lang", F.inline(F.expr(ways))).where("i <> j")
    sums = given.unionByName(single).groupBy("lang", "i", "j").agg(F.sum("f").alias("beyond"))
    every = languages.select("lang", "n_terms", "sources", "zeros", F.posexplode("sources").alias("i", "source"))
    every = every.select("lang", "n_terms", "zeros", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    alike = F.expr(f"n_terms * ({_excess('zeros[i]', 'zeros[j]')})")
    pairs = every.select("lang", "i", "source", "j", "item", alike.alias("alike")).join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("alike") + F.coalesce("beyond", F.lit(0).cast("long"))).alias("value"))

    # terms: a source's share against the language's
    own = wide.withColumn("q", F.expr(_share("n_all", "total + n_terms")))
    own = own.select("lang", "term", F.inline(F.expr(f"transform(filter(shares, x -> x.p > q), x -> struct(sources[x.i] as source, {_excess('x.p', 'q')} as value))")))
    found = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(found).where(F.col("rank") <= top))
