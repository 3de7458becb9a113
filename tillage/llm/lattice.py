"""Subword lattice likelihood: every segmentation of a text into a vocabulary's pieces, summed in log space."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import broadcast, bytes_of, cut, in_arrow, whole_text

SPACE = "▁"
#: Stands for the end of a text among words, none of which is empty.
END = ""
#: Rounds of expected counts that move the existing weights towards the training words.
ROUNDS = 1
#: Occurrences that the existing weights stand for beside the training words, for each piece.
PRIOR = 1.0
#: Expected counts are whole numbers of this part, so that their sums don't depend on the order of adding.
PART = 1_000_000
#: Words with over one in so many of all tokens are looked up in each task, the others in a join; so there are no more
#: of them than this, and none is longer than WORD_BYTES.
FREQUENT, WORD_BYTES = 200_000, 64
#: Distinct words of a task that it holds before it hands their counts on.
HELD = 500_000
#: Rows that a task hands on at a time.
SENT = 20_000
#: What a task makes of a document: a row with the sums of its frequent words, and one for each of its other words.
PARTS = {"id": pa.int64(), "row": pa.int64(), "held": pa.bool_(), "word": pa.string(), "k": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "weight": pa.float64()}


def vocabulary(model_path: str) -> dict[str, float]:
    """Natural logarithms of the weights that a SentencePiece file's ordinary and byte pieces have, summing to 1.

    A BPE file's scores are ranks, 0 and then ever lower, and no logarithms: rank r weighs 1 / (1 + r), as frequencies by
    Zipf's law. Byte pieces, which stand for characters without a piece, rank after all others."""
    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    scores = {p.id_to_piece(i): p.get_score(i) for i in ids if not p.is_byte(i)}
    last = min(scores.values(), default=0.0)
    if all(s == int(s) <= 0 for s in scores.values()):
        scores, last = {x: -math.log1p(-s) for x, s in scores.items()}, -math.log1p(len(scores))
    scores |= {p.id_to_piece(i): last for i in ids if p.is_byte(i)}
    total = math.log(sum(map(math.exp, scores.values())))
    return {x: s - total for x, s in scores.items()}


def _log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    if len(values) == 2:
        a, b = values
        return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values]))


#: (start, weight, number of the piece; -1 for a character spelled by bytes)
Arc = tuple[int, float, int]


@dataclass
class Lattice:
    """The lattice of a word over weighted pieces (natural logarithms). A character that is no piece by itself can also
    be spelled by the pieces of its UTF-8 bytes; a byte without a piece weighs as the least piece does."""

    weights: dict[str, float]
    end: float

    def __post_init__(self) -> None:
        self.pieces = list(self.weights)
        self.machine = ahocorasick.Automaton()
        for k, (piece, w) in enumerate(self.weights.items()):
            if piece:
                self.machine.add_word(piece, (len(piece), w, k))
        self.machine.make_automaton()
        least = min(self.weights.values(), default=-math.log(256))
        self.byte_pieces = [f"<0x{b:02X}>" for b in range(256)]
        self.byte_weights = [self.weights.get(x, least) for x in self.byte_pieces]

    def __reduce__(self):
        return Lattice, (self.weights, self.end)

    def arcs(self, word: str) -> list[list[Arc]]:
        """The arcs that end at each place; at an end the automaton gives the longest piece first."""
        out: list[list[Arc]] = [[] for _ in range(len(word) + 1)]
        if len(self.machine):
            for last, (size, w, k) in self.machine.iter(word):
                out[last + 1].append((last + 1 - size, w, k))
        for end in range(1, len(word) + 1):
            own = out[end]
            if not own or own[-1][0] != end - 1:
                own.append((end - 1, sum([self.byte_weights[b] for b in word[end - 1].encode("utf-8", "surrogatepass")]), -1))
        return out

    def forward(self, arcs: list[list[Arc]]) -> list[float]:
        """The logarithm of the summed weight of all ways to each place."""
        before = [0.0]
        for own in arcs[1:]:
            before.append(_log_sum([before[s] + w for s, w, _ in own]))
        return before

    def log_weight(self, word: str) -> float:
        """Of all segmentations of the space sign and the word; of the end, for END."""
        return self.forward(self.arcs(SPACE + word))[-1] if word else self.end

    def expect(self, word: str, times: int, found: dict[str, int]) -> None:
        """Add to found how often each piece stands in the word's segmentations, by their weights, in PARTs."""
        word = SPACE + word
        arcs = self.arcs(word)
        before = self.forward(arcs)
        through = [0.0] * len(arcs)  # the share of the ways that go through each place
        through[-1] = 1.0
        for end in range(len(word), 0, -1):
            if own := through[end]:
                for start, w, k in arcs[end]:
                    share = own * math.exp(before[start] + w - before[end])
                    through[start] += share
                    if n := times * round(share * PART):
                        for x in (self.pieces[k],) if k >= 0 else [self.byte_pieces[b] for b in word[start].encode("utf-8", "surrogatepass")]:
                            found[x] = found.get(x, 0) + n


def words_of(text: bytes) -> list[bytes]:
    """A UTF-8 text's words, A-Z in lower case: what stands between ASCII white space (space, tab to carriage return)."""
    return text.lower().split()


def held_out(id_col: Column, parts: int = 7, part: int = 2) -> Column:
    """Documents that nothing is learned from: CRC-32 of the id's digits leaves `part` by `parts`. A null id isn't one."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def word_counts(docs: DataFrame, text: Column, held: Column) -> DataFrame:
    """word, n (in all texts), c (in training texts); each text also has one END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = {False: Counter(), True: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            for held, counts in counted.items():
                n = list(counts.values())
                columns = [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.repeat(pa.scalar(0, pa.int64()), len(n)) if held else pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "c"])
                counts.clear()

        for b in batches:
            for t, held in zip(bytes_of(b.column(0)), b.column(1).to_pylist()):
                found = words_of(t)
                found.append(END.encode())
                counted[held].update(found)
                if len(counted[held]) > HELD:
                    yield from flush()
        yield from flush()

    counts = in_arrow(docs.select(text.alias("text"), held.alias("held")), run, "word string, n long, c long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit(words: DataFrame, weights: dict[str, float], rounds: int = ROUNDS, prior: float = PRIOR) -> Lattice:
    """The lattice's weights, and that of the end: the existing ones weigh the segmentations of the training words, whose
    expected counts of pieces are added to the existing weights, which stand for `prior` occurrences a piece. Runs a job
    a round over distinct words; the driver gets a row for each piece. Without rounds or training words the weights stay
    as they are, less the share of one end among the prior occurrences."""
    spark, trained = words.sparkSession, words.where(F.col("c") > 0)
    ends = (trained.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]) + 1
    strength = prior * len(weights)
    start = {x: strength * math.exp(w) for x, w in weights.items()}

    def made(counts: dict[str, float]) -> Lattice:
        total = math.log(sum(counts.values()) + ends)
        return Lattice({x: math.log(n) - total for x, n in counts.items() if n > 0}, math.log(ends) - total)

    if rounds < 1:
        ends = 1
    lattice = made(start)
    for _ in range(rounds):
        model = broadcast(spark, lattice, "the vocabulary's weights")

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            found: dict[str, int] = {}
            for b in batches:
                for word, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    model.value.expect(word, c, found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(map(str, found.values())), pa.string())], names=["piece", "n"])

        sums = in_arrow(trained.where(F.col("word") != END).select("word", "c"), run, "piece string, n string").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        counts = dict(start)
        for r in sums.collect():
            if r.piece in counts:  # else a byte that the vocabulary lacks
                counts[r.piece] += int(r.n) / PART
        lattice = made(counts)
        model.unpersist()
    return lattice


def score(docs: DataFrame, weights: dict[str, float], *, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, prior: float = PRIOR, frequent: int = FREQUENT) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score, both in log10.

    Tokens are words, A-Z in lower case, and one end. score is the marginal probability of the text: over all its
    segmentations into the vocabulary's pieces, the sum of the products of the pieces' weights, times that of the end. No
    piece spans words, so the forward recursion over a text is that over each word, one after another; a word's sum is
    made once for the whole corpus. base_score is that of words counted in training texts, one added to each count.

    Words are counted in one pass (all, and in training texts), `fit` learns the weights from the distinct training
    words, and a second pass over the texts sums what a document's words weigh: frequent words, of which there are at most
    `frequent`, are looked up in each task, and only the rest are sent, by (word, document), to meet their weights.

    A null text is empty: its one token is the end. A null id is no held-out one. Rows that repeat are scored one by one
    and count as often. Long texts are read whole; a task holds HELD distinct words or those of a text. Without training
    texts base_score is 0 for the one token and the existing weights stay. An empty table gives no rows. Only id and text
    are read, so further columns may have any names. Sums are of doubles, and their last digits depend on the order.
    """
    spark, held = docs.sparkSession, held_out(F.col(id_col)) if held is None else held
    words = cut(word_counts(docs, whole_text(text_col), held))
    size = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "c")], F.count_if(F.col("c") > 0).alias("v")).first()
    known = math.log10(size.c + size.v + 1)
    model = broadcast(spark, fit(words, weights, rounds, prior), "the vocabulary's weights")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(0).to_pylist()
            counts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([math.log10(c + 1) - known for c in counts], pa.float64()), pa.array([model.value.log_weight(w) / math.log(10) for w in found], pa.float64())], names=["word", "n", "c", "base", "weight"])

    weighed = cut(in_arrow(words, weigh, "word string, n long, c long, base double, weight double"))
    often = (F.col("n") * frequent > size.n) & (F.octet_length("word") <= WORD_BYTES)
    near = broadcast(spark, {r.word.encode(): (r.c > 0, r.base, r.weight) for r in weighed.where(often).collect()}, "frequent words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = near.value
        columns: list[list] = [[] for _ in PARTS]
        for b in batches:
            for i, row, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), bytes_of(b.column(3))):
                found = words_of(text)
                found.append(END.encode())
                known, base, weight = 0, 0.0, 0.0
                words, times = [None], [0]
                for w, k in Counter(found).items():
                    at = table.get(w)
                    if at is None:
                        words.append(w)
                        times.append(k)
                    else:
                        known += k * at[0]
                        base += k * at[1]
                        weight += k * at[2]
                more = len(words) - 1
                none, nil = [None] * more, [0.0] * more
                for column, values in zip(columns, ([i] * (more + 1), [row] * (more + 1), [held] * (more + 1), words, times, [len(found), *none], [known, *none], [base, *nil], [weight, *nil])):
                    column += values
                if len(columns[0]) > SENT:
                    yield batch(columns)
                    columns = [[] for _ in PARTS]
        yield batch(columns)

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, kind) if kind != pa.string() else pa.array(values, pa.binary()).cast(kind) for values, kind in zip(columns, PARTS.values())], names=list(PARTS))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), held.alias("held"), whole_text(text_col).alias("text"))
    parts = in_arrow(rows, run, "id long, row long, held boolean, word string, k long, n_tokens long, n_known long, base double, weight double")
    # a document's own row has no word: it is dealt out by a key that no word is, as words have no space
    parts = parts.withColumn("key", F.coalesce("word", F.concat(F.lit(" "), "row"))).drop("word")
    seldom = weighed.where(~often).select(F.col("word").alias("key"), (F.col("c") > 0).cast("long").alias("is_known"), F.col("base").alias("word_base"), F.col("weight").alias("word_weight"))
    zero = F.lit(0.0)
    parts = parts.join(seldom, "key", "left").select(
        "id", "row", "held", "n_tokens", (F.coalesce("n_known", F.lit(0)) + F.col("k") * F.coalesce("is_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.col("k") * F.coalesce("word_base", zero)).alias("base"), (F.col("weight") + F.col("k") * F.coalesce("word_weight", zero)).alias("weight"),
    )
    # a row has one id and one held_out, so these are keys at no cost
    found = parts.groupBy("row", "id", "held").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "weight")])
    return found.select("id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(size.c).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("weight").alias("score"))
