"""Token counts by trie-shared dynamic programming.

A text's pre-tokens are its white-space separated words, each with the word
mark in front. Their tokens are those of the best segmentation under a unigram
model of public pieces: the forward score of a prefix is the best over the
pieces that end there. Words with a common beginning share the forward scores
of that beginning, so the distinct new words of a batch form a trie that is
walked depth first (that is, in sorted order), each node scored once; terminal
nodes store their word's count and score, which later batches of the task reuse.

Piece probabilities follow the pieces' published order (Zipf): the vocabulary
file gives pieces and ranks, nothing is trained. A character that no piece
covers is spelt in its UTF-8 bytes, at a score below any piece's. Equal scores
prefer fewer tokens.

Defined results: a null text counts as empty, which has no words and no tokens;
very long texts and words are read whole; bytes that are no UTF-8 are spelt as
they are; repeated rows each get a row; an empty table gives none; extra columns
are ignored, whatever their names; ids keep their type.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, map_arrow, slices, text_bytes

MARK = "▁"
ZIPF_SHIFT = 2.7
#: A byte's score below the rarest piece's.
BYTE_GAP = 5.0
#: Bytes of words that a worker remembers before it starts anew, and their cost besides.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 200


class Pieces:
    """Scores of the pieces of a vocabulary, and what it has counted so far."""

    _loaded: dict[str, "Pieces"] = {}

    def __init__(self, ranks: dict[str, float]) -> None:
        total = sum(1 / (r + ZIPF_SHIFT) for r in ranks.values())
        self.scores = {piece: -math.log((r + ZIPF_SHIFT) * total) for piece, r in ranks.items()}
        self.byte_score = min(self.scores.values(), default=0.0) - BYTE_GAP
        self.lengths: dict[str, list[int]] = {}  # by last character, shortest first
        for piece in ranks:
            self.lengths.setdefault(piece[-1], []).append(len(piece))
        self.lengths = {c: sorted(set(n)) for c, n in self.lengths.items()}
        self.known: dict[bytes, tuple[int, float]] = {}
        self.held = 0

    @classmethod
    def of(cls, path: str) -> "Pieces":
        """The pieces of a SentencePiece file, loaded once a worker."""
        if path not in cls._loaded:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
            ranks = {model.id_to_piece(i): -model.get_score(i) for i in ids}
            cls._loaded[path] = cls({p: r for p, r in ranks.items() if p.rfind(MARK) <= 0})
        return cls._loaded[path]

    def count_words(self, words: Iterable[str]) -> Iterator[tuple[str, int, float]]:
        """(word, tokens, score) of distinct words, walking their trie."""
        scores, lengths, byte_score = self.scores.get, self.lengths, self.byte_score
        best, count = [0.0], [0]  # forward values along the trie's current path
        before = ""
        for word in sorted(words):
            path = MARK + word
            shared, most = 0, min(len(before), len(path))
            while shared < most and before[shared] == path[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for j in range(shared + 1, len(path) + 1):
                char = path[j - 1]
                n = len(char.encode("utf-8", "surrogateescape"))
                top, tokens, found = -math.inf, 0, False
                for size in lengths.get(char, ()):
                    if size > j:
                        break
                    score = scores(path[j - size : j])
                    if score is not None:
                        score += best[j - size]
                        found = found or size == 1
                        if score > top or score == top and count[j - size] + 1 < tokens:
                            top, tokens = score, count[j - size] + 1
                if not found:
                    score = best[j - 1] + n * byte_score
                    if score > top:
                        top, tokens = score, count[j - 1] + n
                best.append(top)
                count.append(tokens)
            yield word, count[-1], best[-1]
            before = path

    def count(self, texts: list[bytes]) -> tuple[list[int], list[int], list[float]]:
        """Words, tokens and scores of each text."""
        split = [text.split() for text in texts]
        new = set().union(*split) - self.known.keys()
        for word, tokens, score in self.count_words(w.decode("utf-8", "surrogateescape") for w in new):
            key = word.encode("utf-8", "surrogateescape")
            self.known[key] = (tokens, score)
            self.held += len(key) + ENTRY_BYTES
        get = self.known.__getitem__
        tokens, scores = [], []
        for words in split:
            values = list(map(get, words))
            tokens.append(sum(v[0] for v in values))
            scores.append(math.fsum(v[1] for v in values))
        if self.held > CACHE_BYTES:  # go on with what is in use now
            self.known = {word: self.known[word] for word in set().union(*split)}
            self.held = sum(map(len, self.known)) + ENTRY_BYTES * len(self.known)
        return [len(w) for w in split], tokens, scores


CACHES["token_counts"] = Pieces._loaded.clear


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, log_score of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(vocabulary)
        for batch in slices(batches, "text"):
            words, tokens, scores = pieces.count(text_bytes(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "log_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_arrow(rows, run, f"doc_id {kind}, n_words bigint, n_tokens bigint, log_score double", "token_counts")
