"""A unigram model over the pieces of a SentencePiece file, and how a text is cut into independent pre-tokens.

Tokenizers are not trained here: the pieces come from the file.  Its scores are ranks, so a piece of rank r gets the
log probability of Zipf's law, ``-log(r + 2.7)`` less the log of the sum.  A character that is no piece falls back to its
UTF-8 bytes, each as unlikely as the rarest piece and a penalty.

Blanks become the mark U+2581, with one in front of the text.  No piece has a mark behind another character, so the
best segmentation of a text is that of its pre-tokens (marks and what follows up to the next mark), one by one.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

MARK = "▁"
PENALTY = 10.0
pretokens = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


def marked(text: str) -> str:
    """The text as the pieces spell it; an empty text has no pieces.

    A mark in the text itself counts as a blank, as in the file's own rule.
    """
    return MARK + text.replace(" ", MARK) if text else ""


class Unigram:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        usual = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        usual.sort(key=lambda i: (-sp.get_score(i), i))
        if any(MARK in self.text[i].lstrip(MARK) for i in usual):
            raise ValueError("a piece has a mark behind another character: pre-tokens would not be independent")
        total = math.log(sum(1 / (r + 2.7) for r in range(len(usual))))
        self.score = {i: -math.log(r + 2.7) - total for r, i in enumerate(usual)}
        #: A piece that begins with a mark, or else any piece.
        self.first_mark = next((i for i in usual if self.text[i] == MARK), usual[0] if usual else 0)
        self.byte_score = min(self.score.values(), default=0.0) - PENALTY
        #: Trie of the pieces: nested dicts by character; the piece's id is under the empty string.
        self.trie: dict = {}
        for i in usual:
            node = self.trie
            for c in self.text[i]:
                node = node.setdefault(c, {})
            node[""] = i
        #: Whether the first mark is a mark alone, which a decoded text loses.
        self.mark_first = bool(usual) and self.text[self.first_mark] == MARK
        #: The same pieces by character as (next steps, score, id as 4 bytes); score and id are None where no piece ends.
        self.steps = self._steps(self.trie)
        #: What texts begin with, as far as it was looked up.
        self.starts: dict = {}

    def _steps(self, node: dict) -> dict:
        ends = ((c, below, below.get("")) for c, below in node.items() if c)
        return {c: (self._steps(below), None if i is None else self.score[i], None if i is None else i.to_bytes(4, "little")) for c, below, i in ends}

    def fallback(self, c: str) -> list[int]:
        """Byte pieces of a character that is no piece."""
        return [self.bytes[b] for b in c.encode()]

    def decode(self, ids: list[int]) -> str:
        """The text that the pieces spell."""
        out, raw, held = [], self.byte_of, bytearray()
        for i in ids:
            if i in raw:
                held.append(raw[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")[1:]


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(path)
