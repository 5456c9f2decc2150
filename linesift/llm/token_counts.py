"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a run of documents are put in sorted order, which walks their trie depth first: the stack
holds the path from the root to the current node.  Each node holds the best forward score to its prefix, the number
of pieces on that path, and the piece-trie states of the suffixes that may still grow into pieces.  A prefix shared by
many pre-tokens is computed once; the count at a pre-token's terminal node is stored, and a document's count is the
sum over its pre-tokens.

Ties between equal scores go to fewer pieces.  Defined results: a null or empty text has no tokens; repeated rows are
counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesift.llm.packing import text_batches
from linesift.llm.unigram import Unigram, marked, pretokens, unigram

#: Characters whose pre-tokens share a trie; bytes of the counts kept from one run to the next, and of an entry's own objects.
TRIE_CHARS, CACHE, ENTRY = 4_000_000, 192 << 20, 250


def terminal_counts(words: Iterable[str], model: Unigram) -> dict[str, tuple[int, float]]:
    """Pieces and score of the best segmentation of each word, prefix by prefix along the trie of all words."""
    trie, score, byte_score = model.trie, model.score, model.byte_score
    out = {}
    # One entry for each character of the current path, and one for the root: (score, pieces, open suffixes).
    path: list[tuple[float, int, list]] = [(0.0, 0, [])]
    last = ""
    for word in sorted(words):
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del path[shared + 1 :]
        for c in word[shared:]:
            s0, n0, open_ = path[-1]
            best, count, still = -1e300, 0, []
            for s, n, node in open_:
                node = node.get(c)
                if node is not None:
                    still.append((s, n, node))
            node = trie.get(c)
            if node is not None:
                still.append((s0, n0, node))
            if node is None or "" not in node:
                k = len(c.encode())
                best, count = s0 + k * byte_score, n0 + k
            for s, n, node in still:
                i = node.get("")
                if i is not None:
                    t = s + score[i]
                    if t > best or (t == best and n + 1 < count):
                        best, count = t, n + 1
            path.append((best, count, still))
        s, n, _ = path[-1]
        out[word] = (n, s)
        last = word
    return out


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, log_score``: one pass over the texts, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]):
        model, known, held = unigram(path), {}, 0
        for batch in batches:
            for lo, texts in text_batches(batch, "text", TRIE_CHARS):
                cut = [pretokens(marked(t)) for t in texts]
                distinct = set()
                for words in cut:
                    distinct.update(words)
                if held > CACHE:
                    known = {w: known[w] for w in distinct if w in known}
                    held = sum(ENTRY + 2 * len(w) for w in known)
                new = terminal_counts(distinct.difference(known), model)
                held += sum(ENTRY + 2 * len(w) for w in new)
                known.update(new)
                rows = [[known[w] for w in words] for words in cut]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), pa.array([len(r) for r in rows], pa.int64()), pa.array([sum(n for n, _ in r) for r in rows], pa.int64()), pa.array([sum((s for _, s in r), 0.0) for r in rows], pa.float64())],
                    names=["doc_id", "n_pretokens", "n_tokens", "log_score"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, log_score double")
