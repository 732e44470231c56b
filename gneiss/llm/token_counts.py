"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming keeps
the best score and the number of pieces of the best path there, and nothing else. Ties are broken as the
tokenizer does it: candidates reach an end in the order of their starts, and a later one wins only if its score
is greater, so the longest last piece stays. A character without a piece of its own may be unknown, at the lowest
score of the vocabulary less ten; it counts as its UTF-8 bytes (byte fallback) or, with ``bytes_for_unknown``
off, a run of unknown characters counts once.

No piece reaches over a space that follows something else, so the best path of a text is that of its words; word
counts are remembered, in bounded memory. A vocabulary with pieces that do, or whose scores are not whole
numbers (sums then depend on what stands before), is run over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model file with their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not odd(i)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter(dict):
    """word -> (pieces, unknown characters) under a vocabulary; holds ``limit`` words at most."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_for_unknown: bool = True, limit: int = 500_000):
        super().__init__()
        self.limit, self.fallback = limit, bytes_for_unknown
        self.trie = ahocorasick.Automaton()
        for p, score in pieces:
            if p:
                self.trie.add_word(p, (len(p), score))
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.empty = not len(self.trie)
        if not self.empty:
            self.trie.make_automaton()
        self.by_word = all(s == int(s) for _, s in pieces) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.by_line = self.by_word and not any("\n" in p for p, _ in pieces) and bytes_for_unknown

    def best(self, s: str) -> int:
        """Pieces of the best path over ``s``, where spaces are written as the vocabulary does."""
        n = len(s)
        score, count, blank = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        unknown = self.unknown

        def skip(p: int) -> None:
            c = score[p - 1] + unknown
            if not count[p] or c > score[p]:
                score[p] = c
                count[p] = count[p - 1] + (len(s[p - 1].encode("utf-8", "surrogatepass")) if self.fallback else not blank[p - 1])
                blank[p] = True

        at, single = 0, True
        for end, (length, value) in () if self.empty else self.trie.iter(s):
            end += 1
            if end != at:
                if not single:
                    skip(at)
                for p in range(at + 1, end):
                    skip(p)
                at, single = end, False
            c = score[end - length] + value
            if not count[end] or c > score[end]:
                score[end], count[end], blank[end] = c, count[end - length] + 1, False
            if length == 1:
                single = True
        if not single:
            skip(at)
        for p in range(at + 1, n + 1):
            skip(p)
        return count[n]

    def __missing__(self, word: str) -> int:
        n = self[word] = self.best(SPACE + word)
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > self.limit:
            self.clear()
        if not self.by_word:
            return self.best(SPACE + text.replace(" ", SPACE))
        if not self.by_line or "  " in text or SPACE in text:
            return sum(map(self.best, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))))
        lines = text.split("\n")
        total = len(lines) - 1  # a line end is one byte
        for i, line in enumerate(lines):
            words = line.split(" ")
            if i:
                if words[0]:
                    total += self.best(words[0])
                del words[0]
            total += sum(map(self.__getitem__, words))
        return total


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | list[tuple[str, float]] | None = None, bytes_for_unknown: bool = True) -> DataFrame:
    """(doc_id, n_tokens, n_chars) for each row of ``docs``.

    ``vocabulary``: pieces with scores, or the path of a sentencepiece model file, read on the driver (its size
    is that of a vocabulary, whatever the corpus). Text is taken as it is, with one space mark put before it.
    Null and empty texts have no tokens; a null id stays null; repeated rows are counted each; other columns are
    ignored; texts are counted whole.
    """
    pieces = vocabulary if isinstance(vocabulary, list) else load_pieces(vocabulary or default_vocabulary())
    shared = docs.sparkSession.sparkContext.broadcast((pieces, bytes_for_unknown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = pa.array([counter.of(t) for t in texts], pa.int64())
            chars = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, chars], ["doc_id", "n_tokens", "n_chars"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_tokens long, n_chars long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
