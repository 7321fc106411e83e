"""Token counts under a unigram vocabulary by dynamic programming over a trie of distinct pre-tokens.

The vocabulary file's pieces get the score -log(rank + 2); a character outside it counts as its UTF-8
bytes at ``BYTE_SCORE`` each. A pre-token is a word with the mark of the space before it. Distinct
pre-tokens are inserted in a trie; a node's forward score (best score of the text up to it, then fewest
tokens) is computed once for all pre-tokens that share the prefix, and the node that ends a pre-token
holds its count. A document's count is the sum over its words. Tries live in tasks; when one exceeds
``max_nodes`` it is begun anew, which changes no count. Of a very long word only the first ``SHARED``
characters are in the trie; the scores of the rest need no more than the longest piece's length of them at
a time. Nothing is shuffled.

Null or empty texts have no tokens; repeated rows count alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import batch_of, text_slices

MARK = "▁"
BYTE_SCORE = -14.0
SHARED = 1024
_LOADED: dict[str, TrieCounter] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the normal pieces of a vocabulary file, by rank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(rank + 2) for rank, p in enumerate(pieces)}


class TrieCounter:
    """Counts of pre-tokens. A node is [children, depth, score, tokens, character, parent]."""

    def __init__(self, scores: dict[str, float], max_nodes: int = 250_000, max_words: int = 500_000):
        self.max_nodes, self.max_words = max_nodes, max_words
        self.longest = max(map(len, scores), default=1)
        self.backward: dict = {}  # pieces from their last character to their first; None: score
        for piece, score in scores.items():
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[None] = score
        self.terminal: dict[bytes, int] = {}
        self.clear()

    @classmethod
    def load(cls, path: str) -> TrieCounter:
        if path not in _LOADED:
            _LOADED[path] = cls(vocabulary(path))
        return _LOADED[path]

    def clear(self) -> None:
        self.root = [{}, 0.0, 0, None, None]  # children, score, tokens, character, parent
        self.nodes = 1

    def _child(self, parent: list, c: str) -> list:
        """The forward score of one more character, from the nodes on the way to the root."""
        width = len(c.encode("utf-8", "surrogatepass"))
        best, fewest = parent[1] + BYTE_SCORE * width, parent[2] + width
        node, at, walk = self.backward, c, parent
        while (node := node.get(at)) is not None:
            score = node.get(None)
            if score is not None:
                total = walk[1] + score
                if total > best or total == best and walk[2] + 1 < fewest:
                    best, fewest = total, walk[2] + 1
            if walk[4] is None:
                break
            at, walk = walk[3], walk[4]
        child = parent[0][c] = [{}, best, fewest, c, parent]
        self.nodes += 1
        return child

    def _rest(self, node: list, rest: str) -> int:
        """Tokens of a word whose front ends at ``node``: forward scores of the last few characters only."""
        recent: list[tuple[float, int, str | None]] = []  # score, tokens, character; the last one is the newest
        while node is not None and len(recent) < self.longest:
            recent.append((node[1], node[2], node[3]))
            node = node[4]
        recent.reverse()
        for c in rest:
            width = len(c.encode("utf-8", "surrogatepass"))
            best, fewest = recent[-1][0] + BYTE_SCORE * width, recent[-1][1] + width
            found, at, back = self.backward, c, len(recent) - 1
            while (found := found.get(at)) is not None:
                score = found.get(None)
                if score is not None:
                    total = recent[back][0] + score
                    if total > best or total == best and recent[back][1] + 1 < fewest:
                        best, fewest = total, recent[back][1] + 1
                at, back = recent[back][2], back - 1
                if back < 0 or at is None:
                    break
            recent.append((best, fewest, c))
            if len(recent) > 4 * self.longest:
                del recent[: -self.longest - 1]
        return recent[-1][1]

    def insert(self, words: set[bytes]) -> None:
        for word in words:
            if self.nodes > 2 * self.max_nodes:
                self.clear()
            node = self.root
            text = MARK + word.decode("utf-8", "surrogatepass")
            for c in text[:SHARED]:
                node = node[0].get(c) or self._child(node, c)
            self.terminal[word] = node[2] if len(text) <= SHARED else self._rest(node, text[SHARED:])

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        if len(self.terminal) > self.max_words:
            self.terminal.clear()
        if self.nodes > self.max_nodes:
            self.clear()
        self.insert(set().union(*cut).difference(self.terminal))
        get = self.terminal.__getitem__
        return [sum(map(get, words)) for words in cut]


def token_counts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens)."""
    path = vocabulary_path or default_path()
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        counter = TrieCounter.load(path)
        for part in text_slices(batches, max_bytes=1 << 20):
            texts = part.column("text").to_pylist()
            sizes = [len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in texts]
            yield batch_of(out, list(zip(part.column("doc_id").to_pylist(), sizes, counter.count(texts))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
