"""Token counts without tokens: Viterbi over a unigram vocabulary that carries a score and a count.

An Aho-Corasick automaton lists the pieces that end at each character. For each end the best
score over the pieces' starts is kept with its number of pieces; no path is stored. Rules of
ties and unknown characters are those of the unigram tokenizers: starts are tried in
ascending order and only a higher score replaces; a character that is no piece itself may be
unknown, at the least score of the vocabulary less 10, and counts as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Words a Python worker remembers, and how long they may be.
WORDS, LONGEST = 400_000, 32


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, in the order of their ids; control, unknown, unused and byte pieces never match text and are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    other = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(is_(i) for is_ in other)]


class Counter:
    """Counts pieces of normalised text: a space mark before the text, and one for each space.

    If no piece has a mark after another character, or a line end, every best path passes each
    point before a mark and around a line end, so texts are cut there. Sums of whole numbers
    are exact in any order: then a word's count does not depend on what is before it, and words
    of up to LONGEST characters are remembered. Sums of fractions are carried from word to word, so that
    they round as over the whole text. Where pieces cross those points, a text is one stretch.
    """

    def __init__(self, pieces: Sequence[tuple[str, float]], fallback: bool = True):
        """fallback: unknown characters count as their bytes; else each run of them counts once."""
        import ahocorasick

        self.whole = all(s == int(s) for _, s in pieces)
        self.unknown, self.fallback = min(s for _, s in pieces) - UNKNOWN_PENALTY, fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}
        cut = "[\\s\\S]+" if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p, _ in pieces) else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"
        self.cut = re.compile(cut).findall

    def best(self, text: str, before: float = 0.0, unknown: bool = False) -> tuple[int, float, bool]:
        """Number of pieces of one stretch of normalised text, and the score and whether the last piece is unknown, from those before it on."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.automaton.iter(text):
            ends[last + 1].append((length, score))
        scores, counts, unknowns = [before] * (n + 1), [0] * (n + 1), [unknown] * (n + 1)
        for end in range(1, n + 1):
            at, single = None, False
            for length, score in sorted(ends[end], reverse=True):  # longest first: starts ascend
                total = scores[end - length] + score
                if at is None or total > scores[end]:
                    at, scores[end], counts[end], unknowns[end] = length, total, counts[end - length] + 1, False
                single |= length == 1
            if not single:
                total = scores[end - 1] + self.unknown
                if at is None or total > scores[end]:
                    new = len(text[end - 1].encode()) if self.fallback else 1 - unknowns[end - 1]
                    scores[end], counts[end], unknowns[end] = total, counts[end - 1] + new, True
        return counts[n], scores[n], unknowns[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        words, known = self.cut(SPACE + text.replace(" ", SPACE)), self.known
        if not (self.whole and self.fallback):
            total, score, unknown = 0, 0.0, False
            for word in words:
                n, score, unknown = self.best(word, score, unknown)
                total += n
            return total
        missing = set(words).difference(known)
        if len(known) > WORDS and missing:
            known.clear()
            missing = set(words)
        new = {w: self.best(w)[0] for w in missing}
        known.update((w, n) for w, n in new.items() if len(w) <= LONGEST)
        return sum(known[w] if w in known else new[w] for w in words)


@cache
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_chars, n_tokens. Null and empty texts have none of either; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_chars bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(count, texts), pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
