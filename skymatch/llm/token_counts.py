"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links: when no child matches, the
longest match read so far is popped and the link leads to the state of what is
left, so a word is read once (Song et al., 2021, "Fast WordPiece
Tokenization"). Each link carries how many pieces it pops; only counts are
added up, no piece is built.

Words are runs without Unicode white space. The first piece of a word comes
from the vocabulary of word starts and later ones from that of continuations;
a word that cannot be covered counts as one unknown piece.

Defined results: a null, empty or white text has 0 words and 0 pieces; repeated
rows are counted each; an empty table gives no rows; a null id stays; other
columns are ignored. A word of any length is read in linear time.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batched

#: Words whose counts a worker remembers.
CACHE = 500_000


def vocabulary(path: str, start_mark: str = "Ġ") -> tuple[set[str], set[str]]:
    """Word-start and continuation pieces from a byte-level BPE file: those with and without the space mark.

    Only the vocabulary is used, not its merges. Bytes are read in the file's
    own alphabet of printable characters.
    """
    with open(path, encoding="utf-8") as file:
        pieces = json.load(file)["model"]["vocab"]
    return {p[1:] for p in pieces if p.startswith(start_mark) and len(p) > 1}, {p for p in pieces if start_mark not in p}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Automaton:
    """Trie over word starts and continuations (two roots) with failure links and popped-piece counts."""

    def __init__(self, starts: set[str], pieces: set[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        self.fail, self.popped = [-1, -1], [0, 0]
        ends = [set(), set()]
        for root, words in ((0, starts), (1, pieces)):
            for word in sorted(words):
                node = root
                for c in word:
                    node = self.child[node].setdefault(c, len(self.child))
                    if node == len(self.child):
                        self.child.append({})
                ends[root].add(node)
        terminal = ends[0] | ends[1]
        self.fail += [-1] * (len(self.child) - 2)
        self.popped += [0] * (len(self.child) - 2)
        todo = deque((root, c, node) for root in (0, 1) for c, node in self.child[root].items())
        while todo:
            parent, c, node = todo.popleft()
            if node in terminal:
                self.fail[node], self.popped[node] = 1, 1
            else:
                back, popped = self.fail[parent], self.popped[parent]
                while back >= 0 and c not in self.child[back]:
                    popped += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[node], self.popped[node] = self.child[back][c], popped
            todo.extend((node, d, below) for d, below in self.child[node].items())

    def count(self, word: str) -> int:
        """Pieces of ``word``; 1 (unknown) if greedy matching cannot cover it."""
        node, pieces = 0, 0
        for c in word:
            below = self.child[node].get(c)
            while below is None:
                pieces += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return 1
                below = self.child[node].get(c)
            node = below
        while node != 1:
            pieces += self.popped[node]
            node = self.fail[node]
            if node < 0:
                return 1
        return pieces


class Counts(dict):
    """From a word to its number of pieces; what is missing is read by the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.letters = automaton, byte_alphabet()

    def __missing__(self, word: str) -> int:
        n = self.automaton.count("".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass"))))
        if len(self) < CACHE:
            self[word] = n
        return n


_made: dict[str, Counts] = {}


def counts_of(path: str) -> Counts:
    if path not in _made:
        _made[path] = Counts(Automaton(*vocabulary(path)))
    return _made[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every whole text. ``path``: the vocabulary file, on every executor."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counts = counts_of(path)
        for batch in batches:
            words = [(t or "").split() for t in batch.column(1).to_pylist()]
            found = [sum(map(counts.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array(found, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return batched(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
