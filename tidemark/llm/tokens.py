"""Token ids by the ``tokenizers`` library, with the ids of words kept.

A text's pieces between blanks are encoded by themselves wherever that gives the ids of the whole text: the
tokenizers used here begin a new word there in any case. Words repeat, so most pieces are looked up. The store is
one dict per Python worker, of bounded size, that fills up with the words seen first - the frequent ones.
"""

from __future__ import annotations

import array
import re
import sys

from tidemark.llm.common import LOWER, UPPER, only_store, ship

KEEP = 400_000
#: A blank that other white space or the end makes part of a run.
BESIDE = re.compile(r"[^\S ] (?!\S)")
#: ASCII punctuation but the apostrophe, which may begin a word.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    store = only_store("encoders")
    if path not in store:
        store[path] = Encoder(path)
    return store[path]


class Encoder:
    def __init__(self, path: str, keep: int = KEEP):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.keep = keep
        # the tokenizer that keeps white space: a word takes the blank before it along
        self.blank_joins = self.whole("a b") != self.whole("a") + self.whole("b")
        self.line_end = self.whole("\n")
        # where it holds for all ASCII letters, they can go to the model in lower case, or straight after the blank's own sign
        letters = UPPER + LOWER
        t = self.tokenizer
        normal = t.normalizer.normalize_str(letters) if t.normalizer else letters
        self.folds = normal == letters.lower()
        self.blank = t.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1] if self.blank_joins else ""
        lead = " " if self.blank_joins else ""
        self.plain = [x for x, _ in t.pre_tokenizer.pre_tokenize_str(lead + letters)] == [self.blank + letters]
        self.whole_only = any(" " in s or "\n" in s for s in self.special)

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _bytes(ids) -> bytes:
        a = array.array("I", ids)
        if sys.byteorder != "little":
            a.byteswap()
        return a.tobytes()

    def _steps(self, piece: str) -> bytes:
        """The ids of a piece by the library's own steps, so that words beside other punctuation share."""
        t = self.tokenizer
        if self.plain and piece.isascii() and piece.lstrip(" ").isalpha() and (self.folds or not t.normalizer):
            word = piece.lower() if self.folds else piece
            return self._bytes([x.id for x in t.model.tokenize(word.replace(" ", self.blank))])
        text = t.normalizer.normalize_str(piece) if t.normalizer else piece
        return b"".join([self._bytes([x.id for x in t.model.tokenize(part)]) for part, _ in t.pre_tokenizer.pre_tokenize_str(text)])

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self._steps(part)
            if len(self.parts) < 2 * self.keep and len(part) <= 64:
                self.parts[part] = ids
        return ids

    def _ends_in_letter(self, core: str) -> bool:
        """Whether letters stay letters when normalised: one that gains a mark would take the punctuation along."""
        t = self.tokenizer
        return (t.normalizer.normalize_str(core) if t.normalizer else core).strip(" ").isalpha()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece between blanks. Letters and the punctuation after them are words of their own, and so is a line end
        between two words."""
        core = piece.rstrip(TAIL)
        if (core.isalpha() or core[:1] == " " and core[1:].isalpha()) and (core.isascii() or self._ends_in_letter(core)):
            ids = self._part(core.lower() if self.folds and core.isascii() else core)
            if len(core) < len(piece):
                ids += self._part(piece[len(core):])
        elif self.blank_joins and "\n" in piece and all(w and w == w.rstrip() and (not i or w == w.lstrip()) for i, w in enumerate(piece.split("\n"))):
            return self.line_end.join([self.known.get(w) or self._piece(w) for w in piece.split("\n")])
        elif any(s in piece for s in self.special):
            return self.whole(piece)
        else:
            ids = self._steps(piece)
        if len(self.known) < self.keep and len(piece) <= 64:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of the text, as little-endian unsigned 32-bit integers."""
        if self.whole_only:
            return self.whole(text)
        if self.blank_joins:
            if "  " in text or BESIDE.search(text):  # runs of white space are tokens of their own
                return self.whole(text)
            first, *rest = text.split(" ")
            pieces = [" " + w for w in rest]
            if first:
                pieces.insert(0, first)
        else:
            pieces = text.replace("\n", " ").split(" ")
        get, piece = self.known.get, self._piece
        return b"".join([get(p) or piece(p) for p in pieces])


ship(__name__)
