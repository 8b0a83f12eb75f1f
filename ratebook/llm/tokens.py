"""Token ids of whole texts as the tokenizers library gives them, with a memory of words.

Both vocabularies split a text into pieces before merging, and a piece's ids don't depend on its neighbours.
A text is cut where a piece surely ends: at single white space, and before a full stop or comma that stands
alone. What lies between is encoded by the library once and looked up afterwards. Texts in which such a cut
isn't certain (runs of white space or punctuation, odd control characters, special token strings) are
encoded whole by the library.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Pieces remembered per Python worker; further ones are encoded at each meeting. A matter of memory only.
REMEMBERED = 300_000
_LONGEST_REMEMBERED = 48
_RUNS = ("..", ".,", ",.", ",,")
_BROKEN_RUN = re.compile(r"(?:[^\w\s]|_)[.,]")
_ODD_SPACE = re.compile(r"[\x00\x1c-\x1f\x85]")
#: Stands before what follows no space.
_TIGHT = "\x00"


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class WordEncoder:
    def __init__(self, path: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.byte_level = byte_level
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.guarded: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _piece(self, w: str) -> bytes:
        """Ids of one cut; words of letters only are one piece and go straight to the merges."""
        if self.byte_level:
            text = w[1:] if w[0] == _TIGHT else " " + w
            if not text.removeprefix(" ").isalpha():
                return self._whole(text)
        else:
            if not w.isalpha() or "Σ" in w:
                return self._whole(w)
            text = unicodedata.normalize("NFC", w).lower()
            if not text.isalpha():
                return self._whole(w)
        letters = _byte_letters()
        text = "".join([letters[b] for b in text.encode()])
        return np.array([t.id for t in self.model.tokenize(text)], self.kind).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of ``kind``; none for a null or empty text."""
        if not text:
            return b""
        if "<|" in text or _ODD_SPACE.search(text) or any(run in text for run in _RUNS):
            return self._whole(text)
        if self.byte_level:
            words = (text.replace("\n", " \x00\n \x00").replace(".", " \x00.").replace(",", " \x00,")).split(" ")
            if "" in words:
                return self._whole(text)
            if words[0][0] != _TIGHT:
                words[0] = _TIGHT + words[0]
        elif "İ" in text:  # its lower case ends in a combining mark
            return self._whole(text)
        else:
            words = text.replace(".", " .").replace(",", " ,").split()
        got = list(map(self.known.get, words))
        at, checked = -1, False
        for _ in range(got.count(None)):
            at = got.index(None, at + 1)
            w = words[at]
            core = w.removeprefix(_TIGHT)
            if not core or core != "\n" and (core[0].isspace() or core[-1].isspace()):
                return self._whole(text)
            sure = core in (".", ",", "\n") or core[-1].isalnum()
            if not sure and not checked:  # such a word may run on into a full stop or comma
                if _BROKEN_RUN.search(text):
                    return self._whole(text)
                checked = True
            memory = self.known if sure else self.guarded
            ids = memory.get(w)
            if ids is None:
                ids = self._piece(w)
                if len(w) <= _LONGEST_REMEMBERED and len(memory) < REMEMBERED:
                    memory[w] = ids
            got[at] = ids
        return b"".join(got)


@lru_cache(maxsize=4)
def encoder(name: str, byte_level: bool) -> WordEncoder:
    """The worker's encoder for a vocabulary: a file path, or a name among the public tokenizers."""
    if os.sep not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return WordEncoder(name, byte_level)
