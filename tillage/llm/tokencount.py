"""Token counts of a unigram tokenizer by count-only Viterbi over Aho-Corasick matches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.common import broadcast, in_arrow, texts_of, whole_text

SPACE = "▁"
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 300_000


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file's ordinary pieces; control, unknown and byte pieces are left out."""
    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


@dataclass
class Counter:
    """Counts the pieces of the best segmentation of each word; unknown characters fall back to their UTF-8 bytes.

    Ties go as in the tokenizer's forward pass: at each place the best path comes from the earliest start among those
    of equal score, and a one-character unknown is tried only where no piece of one character begins.
    """

    pieces: list[tuple[str, float]]
    cache: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.machine = ahocorasick.Automaton()
        for piece, score in self.pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), float(score)))
        self.machine.make_automaton()
        self.unknown = min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY

    def __reduce__(self):
        return Counter, (self.pieces,)

    def word(self, word: str) -> int:
        n = len(word)
        best, count, single = [0.0] * (n + 1), [0] * (n + 1), False
        matches = self.machine.iter(word) if len(self.machine) else iter(())
        at = next(matches, None)
        for end in range(1, n + 1):
            top, own, begin, single = None, 0, n, False
            while at is not None and at[0] == end - 1:
                size, score = at[1]
                single |= size == 1
                start = end - size
                s = best[start] + score
                if top is None or s > top or (s == top and start < begin):
                    top, own, begin = s, count[start] + 1, start
                at = next(matches, None)
            if not single:
                s = best[end - 1] + self.unknown
                if top is None or s > top:
                    top, own = s, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, own
        return count[n]

    def text(self, text: str) -> tuple[int, int]:
        """(pieces, words). Spaces become the space sign, one is put in front, and each begins a word."""
        if not text:
            return 0, 0
        text = text.replace(" ", SPACE)
        words = (text[1:] if text[0] == SPACE else text).split(SPACE)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.word(SPACE + w)
        return sum(map(cache.__getitem__, words)), len(words)


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, n_words of the whole text. Null and empty texts have none; rows stay repeated.

    The vocabulary is broadcast, its size is fixed. A word's count doesn't depend on its neighbours, so a task
    remembers the words it has met, up to CACHE_WORDS.
    """
    counter = broadcast(docs.sparkSession, Counter(pieces), "the vocabulary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([counter.value.text(t) for t in texts_of(b.column(1))], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["id", "n_tokens", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col)).transform(in_arrow, run, "id long, n_tokens long, n_words long")
