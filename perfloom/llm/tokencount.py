"""Token counts of a unigram vocabulary without making tokens: best segmentation score and number of pieces only.

An Aho-Corasick automaton lists all pieces that end at a place, longest first; the best path to that place takes a piece only
where its score is greater than the best so far, so of equal scores the longest piece stands, as in the public tokenizers
that walk from each start to growing ends. A character without a piece costs the least score less 10 and becomes its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.llm.common import ship

MARK = "▁"  # stands for a blank
UNKNOWN_PENALTY = 10.0
#: Chunks a worker remembers, and the longest such chunk in characters.
CACHED, CACHED_CHARS = 500_000, 32


class Counter:
    """Counts pieces of texts under (piece, score) pairs."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        # No piece crosses from another character to a mark, and sums of whole numbers are exact: chunks can be told apart.
        self.chunked = all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) and float(s).is_integer() for p, s in vocabulary)
        self.known: dict[str, tuple[int, float]] = {}

    def path(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path; keeps only as many places as the longest piece has characters."""
        size = self.longest + 1
        best, count = [0.0] * size, [0] * size
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        end, found = next(matches, (len(text), None))
        for at, char in enumerate(text):
            top, pieces, single = float("-inf"), 0, False
            while end == at:
                n, score = found
                score += best[(at + 1 - n) % size]
                if score > top:
                    top, pieces = score, count[(at + 1 - n) % size] + 1
                single |= n == 1
                end, found = next(matches, (len(text), None))
            if not single and best[at % size] + self.unknown > top:
                top, pieces = best[at % size] + self.unknown, count[at % size] + len(char.encode("utf-8", "surrogatepass"))
            best[(at + 1) % size], count[(at + 1) % size] = top, pieces
        return count[len(text) % size], best[len(text) % size]

    def __call__(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = MARK + text.replace(" ", MARK)
        if not self.chunked:
            return self.path(text)
        pieces, total, known = 0, 0.0, self.known
        for chunk in _CHUNK.findall(text):
            got = known.get(chunk)
            if got is None:
                got = self.path(chunk)
                if len(chunk) <= CACHED_CHARS:
                    if len(known) >= CACHED:
                        known.clear()
                    known[chunk] = got
            pieces += got[0]
            total += got[1]
        return pieces, total


_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """Counter of a sentencepiece model file: its normal pieces with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rest = (sp.is_unknown, sp.is_control, sp.is_byte, sp.is_unused)
    return Counter([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()) if not any(f(i) for f in rest)])


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_pieces, score. Null and empty texts have no pieces and score 0. Other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for b in batches:
            got = [count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())],
                                             ["id", "n_pieces", "score"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_pieces long, score double")
    return rows.withColumnRenamed("id", id_col)
