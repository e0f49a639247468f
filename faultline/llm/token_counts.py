"""Greedy word-piece lengths by a linear longest-match automaton.

Method. The vocabulary is a trie. Every node has a failure link, the node at which matching goes
on after the longest pieces at the front of the node's string are popped, and the count of those
pieces. A word is read once, character by character; where the trie has no way on, the count of
the node is added and its link followed. So the number of pieces that greedy longest-match-first
would cut comes out in linear time, and no piece is ever built. Words are blank-separated and begin
with ``mark``; each different word of a batch is read once.

Defined results. A word that greedy matching cannot finish is one unknown token. Null and empty
texts have no words and no tokens. Null identifiers and repeated rows pass as they are, a word of
any length is read whole, no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batches, texts

NOWHERE = -1


class LongestMatch:
    """Trie with failure links and popped-token counts."""

    def __init__(self, vocabulary: Iterable[str]):
        self.ways: list[dict[str, int]] = [{}]
        ends = {0: False}
        for piece in vocabulary:
            node = 0
            for c in piece:
                nxt = self.ways[node].get(c)
                if nxt is None:
                    nxt = self.ways[node][c] = len(self.ways)
                    self.ways.append({})
                node = nxt
            if node:
                ends[node] = True
        self.link = [NOWHERE] * len(self.ways)
        self.popped = [0] * len(self.ways)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.ways[parent].items():
                queue.append(node)
                if ends.get(node):
                    self.link[node], self.popped[node] = 0, 1
                    continue
                back, count = self.link[parent], self.popped[parent]
                while back != NOWHERE and c not in self.ways[back]:
                    count += self.popped[back]
                    back = self.link[back]
                if back != NOWHERE:
                    self.link[node], self.popped[node] = self.ways[back][c], count

    def length(self, word: str) -> int:
        """Number of pieces of a word; 0 if it cannot be cut into pieces."""
        ways, link, popped = self.ways, self.link, self.popped
        node = count = 0
        for c in word:
            nxt = ways[node].get(c)
            while nxt is None:
                count += popped[node]
                node = link[node]
                if node == NOWHERE:
                    return 0
                nxt = ways[node].get(c)
            node = nxt
        while node > 0:
            count += popped[node]
            node = link[node]
        return count if node == 0 else 0


def word_lists(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The blank-separated words of all texts, each different one held once, and each text's offsets.

    Empty words stand where a text begins or ends with blanks.
    """
    split = pc.ascii_split_whitespace(column.cast(pa.large_string()))
    flat = split.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    return flat.dictionary_encode(), ends.astype(np.int64)


def _counted(vocabulary: Callable[[], Iterable[str]], mark: str) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(vocabulary())
        for batch in batches(source):
            words, ends = word_lists(batch.column(1))
            distinct = words.dictionary.to_pylist()
            lengths = np.fromiter((automaton.length(mark + w) if w else -1 for w in distinct), np.int64, len(distinct))
            own = lengths[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)

            def total(values: np.ndarray, ends: np.ndarray = ends) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
                return pa.array(sums[ends[1:]] - sums[ends[:-1]])

            yield pa.RecordBatch.from_arrays(
                [batch.column(0), total(own >= 0), total(np.where(own >= 0, np.maximum(own, 1), 0)), total(own == 0)],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return run


def token_counts(
    docs: DataFrame,
    vocabulary: Callable[[], Iterable[str]],
    mark: str = "",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_tokens (unknown words count as one), n_unknown.

    ``vocabulary`` is called in each Python worker and gives the pieces.
    """
    return texts(docs, id_col, text_col).mapInArrow(
        _counted(vocabulary, mark), "doc_id long, n_words long, n_tokens long, n_unknown long"
    )


def sentencepiece_vocabulary(model_path: str) -> list[str]:
    """The ordinary pieces of a model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
