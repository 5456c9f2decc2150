"""Token ids of whole texts by the tokenizers library, with a bounded cache of chunks.

Pre-tokenisation never joins certain neighbours (a word and the next, where single blanks or line ends stand between),
so a text's ids are its chunks' ids one after the other.  Chunks repeat, so each distinct one is encoded once per
worker and generation of the cache.  Which cuts are safe is read from the tokenizer itself; a text outside the safe
form, or a tokenizer of an unknown kind, is encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np

#: Bytes in one generation of the cache, as far as strings, ids and table entries take them; two are kept.
GENERATION, ENTRY = 160 << 20, 220
#: A run of Latin letters up to white space or a sign: both kinds of tokenizer always cut between a letter and a sign.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^ \\t-\\r.,;:!?|*#$%&])"
#: Chunks encoded in one call.
RUN = 400


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in shown)
    return {b: chr(256 + i) for i, b in enumerate(other)}


_BYTES = _byte_letters()


def _white_space() -> tuple[list[str], list[str]]:
    """White space other than blanks and line ends, as ``\\s`` has it: in ASCII, and beyond it (there is none above U+FFFF)."""
    found = re.findall(r"[^\S \n]", "".join(map(chr, range(1 << 16))))
    return [c for c in found if c.isascii()], [c for c in found if not c.isascii()]


_ODD_ASCII, _ODD_OTHER = _white_space()
_ODD_ASCII += ["  ", "\n\n", " \n", "\n "]


def _odd_space(text: str) -> bool:
    """Whether a text has white space that does not stand alone between two words, or is neither blank nor line end.

    Each kind is looked for by itself: that reads a text far faster than a class of characters does.
    """
    if text.startswith((" ", "\n")) or text.endswith((" ", "\n")) or any(c in text for c in _ODD_ASCII):
        return True
    return not text.isascii() and any(c in text for c in _ODD_OTHER)


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # their strings in a text are ordinary text
        self.parting = Tokenizer.from_file(path)
        spec = json.loads(self.plain.to_str())
        special = [t for t in spec["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.mark = (special[0]["content"], special[0]["id"]) if special else None
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        self.whole = self.word = None
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            # A blank before a word belongs to it and a single line end stands alone; other white space is left whole.
            self.cut = re.compile(rf" ?{LETTERS}|" r" ?[^ \n]+|\n").findall
            self.word = re.compile(rf" ?{LETTERS}").fullmatch
            self.whole = _odd_space
        elif pre.get("type") == "Sequence" and (first := pre["pretokenizers"][0]).get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s" in first["pattern"].get("Regex", ""):
            self.cut = re.compile(rf"{LETTERS}|" r"[^ \t-\r]+").findall  # white space parts tokens and is dropped
        else:
            self.cut = None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes in ``new``

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        if self.word:
            # A run of letters is one pre-token: the library's model takes it as it is, in the byte-level alphabet.
            tokenize, blank = self.plain.model.tokenize, _BYTES[32]
            words = [c for c in chunks if self.word(c)]
            spelt = (c.replace(" ", blank) if c.isascii() else c.encode().decode("latin-1").translate(_BYTES) for c in words)
            found, ends = [], []
            for w in spelt:
                found += [t.id for t in tokenize(w)]
                ends.append(4 * len(found))
            raw, at = np.array(found, "<u4").tobytes(), 0
            for c, end in zip(words, ends, strict=True):
                self.new[c] = raw[at:end]
                at = end
            chunks = [c for c in chunks if c not in self.new]
        if not self.mark:
            self.new.update(zip(chunks, self._direct(chunks), strict=True))
            return
        mark, mark_id = self.mark
        odd = [c for c in chunks if "<" in c or c == "\n" or c.isspace()]
        self.new.update(zip(odd, self._direct(odd), strict=True))
        usual = [c for c in chunks if not ("<" in c or c == "\n" or c.isspace())]
        runs = [usual[i : i + RUN] for i in range(0, len(usual), RUN)]
        for run, e in zip(runs, self.parting.encode_batch_fast([mark.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == mark_id), len(ids)) * 4
            if len(ends) != len(run):
                self.new.update(zip(run, self._direct(run), strict=True))
                continue
            raw, at = ids.tobytes(), 0
            for c, end in zip(run, ends.tolist(), strict=True):
                self.new[c] = raw[at:end]
                at = end + 4

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return self._direct(texts)
        whole = [bool(self.whole and self.whole(t)) for t in texts]
        cuts = [[] if w else self.cut(t) for t, w in zip(texts, whole, strict=True)]
        if self.held > GENERATION:
            self.new, self.old, self.held = {}, self.new, 0
        missing = []
        new, old = self.new, self.old
        unknown = set(filterfalse(new.__contains__, chain.from_iterable(cuts)))
        for c in unknown:
            if c in old:
                new[c] = old[c]
            else:
                missing.append(c)
        self._learn(missing)
        self.held += sum(ENTRY + len(c) + len(new[c]) for c in unknown)
        out = [b"".join(map(new.__getitem__, c)) for c in cuts]
        if any(whole):
            at = [i for i, w in enumerate(whole) if w]
            for i, ids in zip(at, self._direct([texts[i] for i in at]), strict=True):
                out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
