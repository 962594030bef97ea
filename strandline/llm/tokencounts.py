"""Unigram token counts with a trie shared by all distinct pre-tokens.

A pre-token is a word with a mark for the blank before it.  Its best segmentation into
pieces of a vocabulary is found by forward scores: the best score of each prefix.  The
distinct pre-tokens of a part are visited in sorted order, which walks their trie depth first;
the scores of a shared prefix are kept on the stack and computed once.  Each pre-token's count
is stored, and documents add up the counts of their words.

The vocabulary file has ranks, no probabilities: a piece of rank r gets the score of a Zipf law,
in thousandths of a nat as whole numbers, so that sums are exact.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
#: Score of a byte of a character that no piece covers.
BYTE_SCORE = -14_000
#: Counts remembered between parts of a task's rows.
REMEMBERED = 500_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def zipf_scores(pieces: Iterable[str]) -> dict[str, int]:
    return {p: -round(1000 * math.log(r + 2)) for r, p in enumerate(pieces) if p}


def read_pieces(path: str) -> list[str]:
    """Pieces of a vocabulary file in order, without control and byte pieces."""
    import sentencepiece
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class PieceScores:
    """Scores of pieces in a tree read from a piece's last character to its first; an empty key holds the score."""

    def __init__(self, scores: dict[str, int]):
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    def counts(self, tokens: Iterable[str]) -> dict[str, int]:
        """Tokens of the best segmentation of each pre-token; of equal scores the one with fewer tokens.

        ``best[i]`` is the (score, -tokens) of the first i characters on the path from the root.
        """
        out: dict[str, int] = {}
        root, nothing = self.root, {}
        before, best = "", [(0, 0)]
        for token in sorted(tokens):
            shared = len(os.path.commonprefix((before, token)))
            del best[shared + 1:]
            for end in range(shared + 1, len(token) + 1):
                c = token[end - 1]
                n = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                s, k = best[end - 1]
                top, tokens_less = s + n * BYTE_SCORE, k - n
                node, at = root.get(c, nothing), end - 1
                while node:                     # pieces that end here, from the shortest; most walks stop early
                    if "" in node:
                        s, k = best[at]
                        s += node[""]
                        if s > top or (s == top and k - 1 > tokens_less):
                            top, tokens_less = s, k - 1
                    if not at:
                        break
                    at -= 1
                    node = node.get(token[at])
                best.append((top, tokens_less))
            out[token] = -best[-1][1]
            before = token
        return out


def token_counts(docs: DataFrame, scores: dict[str, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every document.

    Words are split at ASCII blanks and each is marked as following a blank.  Null and empty texts have no
    tokens; rows keep their number.  The vocabulary is broadcast: its size is that of the file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceScores(scores))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for whole in batches:
            for batch in slices(whole, 1):
                words = [(t.as_py() or b"").split() for t in batch.column(1)]
                new = set().union(*words) - known.keys()
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, set().union(*words)
                named = {MARK + w.decode("utf-8", "replace"): w for w in new}
                known.update((named[t], n) for t, n in model.counts(named).items())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(w) for w in words], pa.int64()),
                     pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64())],
                    ["doc_id", "n_pretokens", "n_tokens"])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")) \
        .mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
