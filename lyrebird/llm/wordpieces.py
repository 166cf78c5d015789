"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Each node knows where to go on when no child fits
(its failure link) and how many pieces are then complete, so that a word is read
once, letter by letter, and its greedy word pieces are counted without being
built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lyrebird.llm.words import PLAIN, word_blocks
from lyrebird.staging import table

#: the vocabulary, read on the driver
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: marks a piece that starts a word
START = "▁"


class LongestMatch:
    """Counts the greedy longest-match pieces of words; a word that cannot be matched is one unknown piece.

    With by_bytes no word is unknown: a letter where no piece fits is as many
    byte pieces as it has bytes in UTF-8.
    """

    def __init__(self, pieces: Iterable[str], start: str = START, by_bytes: bool = False):
        self.start, self.by_bytes = start, by_bytes
        children: list[dict[str, int]] = [{}]
        size = [0]  # pieces that a node stands for, 0 if it is none

        def add(word: str, pieces_of: int) -> None:
            node = 0
            for letter in word:
                if letter not in children[node]:
                    children[node][letter] = len(children)
                    children.append({})
                    size.append(0)
                node = children[node][letter]
            size[node] = size[node] or pieces_of * bool(word)

        letters = set()
        for piece in pieces:
            add(piece, 1)
            letters.update(piece)
        for letter in sorted(letters) if by_bytes else ():
            add(letter, len(letter.encode()))
        self.children = children
        self.link = [-1] * len(children)
        self.popped = [0] * len(children)
        line = [0]
        for node in line:  # by breadth, so that shorter strings are done
            for letter, child in children[node].items():
                if size[child]:
                    self.link[child], self.popped[child] = 0, size[child]
                else:
                    to, n = self.link[node], self.popped[node]
                    while to >= 0 and letter not in children[to]:
                        n += self.popped[to]
                        to = self.link[to]
                    if to >= 0:
                        self.link[child], self.popped[child] = children[to][letter], n
                line.append(child)

    def count(self, word: str) -> int:
        """Pieces of a word, 0 if it cannot be matched."""
        children, link, popped = self.children, self.link, self.popped
        node = n = 0
        for letter in self.start + word:
            while letter not in children[node]:
                n += popped[node]
                node = link[node]
                if node < 0:
                    break
            if node >= 0:
                node = children[node][letter]
            elif self.by_bytes:
                n, node = n + len(letter.encode()), 0
            else:
                return 0
        while node > 0:
            n += popped[node]
            node = link[node]
        return n if node == 0 else 0


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def load_pieces(path: str) -> list[str]:
    """Pieces of a model file, without control, byte and unknown ones, and without those that have the mark after the first place (runs of blanks)."""
    model = _model(path)
    special = lambda i: model.is_control(i) or model.is_byte(i) or model.is_unknown(i)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
    return [p for p in pieces if START not in p[1:]]


def has_bytes(path: str) -> bool:
    """Whether a model file has a piece for every byte."""
    model = _model(path)
    return sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256


_KNOWN_WORDS = 200_000


def token_counts(docs: DataFrame, pieces: list[str], by_bytes: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each row of docs, which has doc_id and text.

    Words are [^\\x20\\x09-\\x0D]+; n_tokens counts the pieces of all words, an
    unknown word as one; with by_bytes letters without a piece are counted as their
    bytes, and no word is unknown.  A null or empty text has none.  Words may be of any
    length.  Repeated rows and null ids are counted each; an empty table gives no
    rows; other columns are left alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = next(f for f in docs.schema.fields if f.name == "doc_id").dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = LongestMatch(shared.value, by_bytes=by_bytes), {}
        for batch in batches:
            for block in word_blocks(batch["text"], PLAIN):
                distinct, first, place = np.unique(block.ids, return_index=True, return_inverse=True)
                data, counts = block.data.tobytes(), np.empty(len(distinct), np.int64)
                if len(known) > _KNOWN_WORDS:
                    known.clear()
                for i, (word, at) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
                    n = known.get(word)
                    if n is None:
                        n = known[word] = automaton.count(data[block.starts[at] : block.ends[at]].decode("utf-8", "replace"))
                    counts[i] = n
                own = counts[place]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (np.maximum(own, 1), own == 0)]
                tokens, unknown = (s[block.bounds[1:]] - s[block.bounds[:-1]] for s in sums)
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].slice(block.first_row, block.rows).cast(to_arrow_type(kind)), "n_words": pa.array(block.counts),
                    "n_tokens": pa.array(tokens), "n_unknown": pa.array(unknown),
                })

    columns = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_tokens long, n_unknown long")


def op5_token_counts(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), load_pieces(pieces), has_bytes(pieces))
