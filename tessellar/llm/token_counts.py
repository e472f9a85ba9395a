"""Token counts of a unigram vocabulary without producing the tokens.

Text is cut where the vocabulary's pre-tokeniser cuts it: before each space,
which becomes the mark U+2581, also put before the first word. A chunk's best
segmentation is found by dynamic programming over the matches that an
Aho-Corasick automaton enumerates; only the best score and its piece count are
carried. Ties follow the tokeniser: starts are visited from left to right, and
a later candidate replaces an earlier one only if its score is strictly higher;
a character that no one-character piece covers gets an unknown piece at the
lowest score less 10; neighbouring unknown pieces count as one, or as their
UTF-8 bytes where the vocabulary has byte pieces for all of them.

Scale: no shuffle, one pass. Each batch is dictionary-encoded first, so the
automaton runs once per distinct chunk and batch; chunks seen before come from
a table of at most `cache` entries.

Defined cases: null and empty texts have no tokens; repeated rows give equal
counts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MARK = "▁"
CACHE = 400_000
WIDE = 16 << 20  # bytes of text dictionary-encoded together
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a vocabulary file in order of ids; control and unknown pieces score lowest and never match text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Counter:
    """Piece counts of chunks under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        scores = dict(pieces)
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.empty = not len(self.automaton)

    def count(self, chunk: str) -> tuple[int, int]:
        """(tokens, tokens that stand for unknown characters)."""
        n = len(chunk)
        by_start: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if not self.empty:
            for end, (length, score) in self.automaton.iter(chunk):
                by_start[end - length + 1].append((length, score))
        best: list[float | None] = [None] * (n + 1)
        pieces, lost, tail = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            base, single = best[i], False
            for length, score in sorted(by_start[i]):
                single |= length == 1
                j, s = i + length, base + score
                if best[j] is None or s > best[j]:
                    best[j], pieces[j], lost[j], tail[j] = s, pieces[i] + 1, lost[i], False
            if not single:
                j, s = i + 1, base + self.unknown
                if best[j] is None or s > best[j]:
                    more = len(chunk[i].encode()) if self.byte_fallback else int(not tail[i])
                    best[j], pieces[j], lost[j], tail[j] = s, pieces[i] + more, lost[i] + more, True
        return pieces[n], lost[n]


@lru_cache(maxsize=2)
def _counter(path: str, byte_fallback: bool) -> tuple[Counter, dict]:
    return Counter(read_pieces(path), byte_fallback), {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, byte_fallback: bool = True, cache: int = CACHE) -> DataFrame:
    """Per row: doc_id, n_chars, n_chunks, n_tokens, n_unknown."""
    path = vocabulary or default_vocabulary()
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = _counter(path, byte_fallback)
        for part in K.slices(batches, "text", WIDE):
            whole = pc.fill_null(part.column("text"), "")
            some = pc.not_equal(whole, "")
            # marks and spaces are the same; a text that starts with one gets no other: every chunk has exactly one
            texts = pc.replace_substring_regex(pc.replace_substring(whole, MARK, " "), "^ ", "")
            lists = pc.split_pattern(texts, " ")
            sizes = np.where(some.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(), 0)
            codes = pc.list_flatten(lists.filter(some)).dictionary_encode()
            chunks = codes.dictionary.to_pylist()
            tokens, unknown = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
            for i, chunk in enumerate(chunks):
                if (known := seen.get(chunk)) is None:
                    known = counter.count(MARK + chunk)
                    if len(seen) < cache:
                        seen[chunk] = known
                tokens[i], unknown[i] = known
            index = codes.indices.to_numpy()
            ends = np.cumsum(sizes)

            def total(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate(([0], np.cumsum(values[index])))
                return sums[ends] - sums[ends - sizes]

            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pc.utf8_length(whole).to_numpy().astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(total(tokens)), pa.array(total(unknown))], ["doc_id", "n_chars", "n_chunks", "n_tokens", "n_unknown"])

    return source.mapInArrow(kernel, "doc_id bigint, n_chars bigint, n_chunks bigint, n_tokens bigint, n_unknown bigint")
