"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch form a trie. A walk in sorted order visits every trie node
once and computes the best unigram score of the prefix that ends there from the scores on the
path above it; words with a common prefix share that work. The count and score at a word's last
node are stored for the word, and texts add up the stored counts of their words. There is no
shuffle; memory follows one slice of a batch.

Pieces and scores come from a sentencepiece model file. A pre-token is a run of other than white
space (as ``str.split`` sees it) with the word mark before it. A letter that no piece covers
costs ten less than the least score and counts one token per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

#: The mark before a word, and what an uncovered letter costs below the least score.
MARK, PENALTY = "▁", 10.0
TOGETHER = 1 << 22
SCORE = ""


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    """The pieces of a model file as a trie of characters; a node's score is under ``SCORE``."""

    def __init__(self, pieces: dict[str, float]):
        self.root: dict = {}
        self.missing = min(pieces.values(), default=0.0) - PENALTY
        for piece, score in pieces.items():
            node = self.root
            for letter in piece:
                node = node.setdefault(letter, {})
            node[SCORE] = score

    @classmethod
    def from_file(cls, path: str) -> "Unigram":
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def count(self, words: list[str]) -> list[tuple[int, float]]:
        """(tokens, score) of the best segmentation of each word; of equal scores the one whose
        last piece starts first. ``words`` must be sorted and distinct."""
        root, out, before = self.root, [], ""
        best, tokens, open_at = [0.0], [0], [[]]  # by depth of the current path in the trie
        for word in words:
            depth = len(commonprefix((before, word)))
            del best[depth + 1:], tokens[depth + 1:], open_at[depth + 1:]
            for at in range(depth, len(word)):
                letter = word[at]
                here = [(i, node[letter]) for i, node in open_at[at] if letter in node]
                if letter in root:
                    here.append((at, root[letter]))
                top, n, alone = None, 0, False
                for i, node in here:
                    score = node.get(SCORE)
                    if score is not None:
                        alone = alone or i == at
                        if top is None or best[i] + score > top:
                            top, n = best[i] + score, tokens[i] + 1
                if not alone and (top is None or best[at] + self.missing > top):
                    top = best[at] + self.missing
                    n = tokens[at] + len(letter.encode("utf-8", "replace"))
                best.append(top)
                tokens.append(n)
                open_at.append(here)
            out.append((tokens[len(word)], best[len(word)]))
            before = word
        return out

    def count_texts(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, score) of each text."""
        rows = [t.split() for t in texts]
        words = sorted(set().union(*rows))
        found = self.count([MARK + w for w in words])
        number = dict(zip(words, (n for n, _ in found)))
        score = dict(zip(words, (s for _, s in found)))
        return [(len(r), sum(map(number.__getitem__, r)), float(sum(map(score.__getitem__, r)))) for r in rows]


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """One per worker process and file."""
    return Unigram.from_file(path)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score) per row of ``docs``.

    Null, empty and blank texts count 0 with score 0. Repeated rows are kept, other columns are
    ignored, an empty table gives an empty result. ``path`` is a file every executor can read.
    """
    file = path

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(file or default_file())
        for b in batches:
            at = 0
            while at < b.num_rows:
                part, size = [], 0
                while at + len(part) < b.num_rows and (not part or size < TOGETHER):
                    part.append(b.column(1)[at + len(part)].as_py() or "")
                    size += len(part[-1])
                grid = model.count_texts(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), *[pa.array(list(c), t) for c, t in zip(
                        zip(*grid), (pa.int64(), pa.int64(), pa.float64()))]],
                    ["doc_id", "n_pretokens", "n_tokens", "score"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        each, "doc_id long, n_pretokens long, n_tokens long, score double")
