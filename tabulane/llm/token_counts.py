"""Token counts without tokens: greedy longest-match pieces counted by a linear automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of pieces that are complete once
the link is taken, so a word costs one pass over its bytes and no piece is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulane.llm.common import as_bytes, over_batches, read_ranks

MEMO_WORDS = 200_000  # counted words a task remembers; it forgets all of them beyond that
MEMO_LENGTH = 64  # longer words are counted each time


class PieceCounter:
    """Counts the pieces of a word under greedy longest match, in time linear in its length.

    goto[node << 8 | byte] is the trie. For a node whose string is s, popped[node] counts the pieces that
    greedy matching takes off the front of s when the next byte does not continue it, and link[node] is
    the node of what is left. A byte outside the vocabulary counts as one piece.
    """

    def __init__(self, pieces):
        goto, ends = {}, {0}
        for piece in {bytes(p) for p in pieces if p} | {bytes([b]) for b in range(256)}:
            node = 0
            for byte in piece:
                node = goto.setdefault(node << 8 | byte, len(goto) + 1)
            ends.add(node)
        size = len(goto) + 1
        link, popped = [0] * size, [0] * size
        below: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for key, child in goto.items():
            below[key >> 8].append((key & 255, child))
        row = [0]
        while row:  # breadth first: links of shorter strings are known
            following = []
            for node in row:
                for byte, child in below[node]:
                    following.append(child)
                    if child in ends:
                        link[child], popped[child] = 0, 1
                        continue
                    rest, count = link[node], popped[node]
                    while rest << 8 | byte not in goto:  # ends at the root, which has every byte
                        count += popped[rest]
                        rest = link[rest]
                    link[child], popped[child] = goto[rest << 8 | byte], count
            row = following
        self.goto, self.link, self.popped = goto, link, popped

    def count(self, word: bytes) -> int:
        goto, link, popped = self.goto, self.link, self.popped
        node = total = 0
        for byte in word:
            step = goto.get(node << 8 | byte)
            while step is None:
                total += popped[node]
                node = link[node]
                step = goto.get(node << 8 | byte)
            node = step
        while node:
            total += popped[node]
            node = link[node]
        return total


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", mark: bytes = b" ") -> DataFrame:
    """(id, n_words, n_tokens) of every text: words are runs of bytes other than ASCII white space, each matched as mark + word.

    `vocabulary` is the path of a rank file, read on the driver. Null and empty texts have no words and no
    tokens; repeated rows and null ids give one row each; an empty table gives none; other columns are not read.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(list(read_ranks(vocabulary)))  # as large as the vocabulary

    def work(batches):
        counter, memo = PieceCounter(pieces.value), {}
        for batch in batches:
            words_of, tokens_of = [], []
            for text in as_bytes(batch.column(1)):
                words, total = text.split(), 0
                for word in words:
                    n = memo.get(word)
                    if n is None:
                        n = counter.count(mark + word)
                        if len(word) <= MEMO_LENGTH:
                            if len(memo) >= MEMO_WORDS:
                                memo.clear()
                            memo[word] = n
                    total += n
                words_of.append(len(words))
                tokens_of.append(total)
            yield {"id": batch.column(0), "n_words": words_of, "n_tokens": tokens_of}

    kind = docs.schema[id_col].dataType.simpleString()
    counted = over_batches(docs.select(F.col(id_col), F.col(text_col)), work, f"id {kind}, n_words long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)
