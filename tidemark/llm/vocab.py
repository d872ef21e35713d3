"""Public tokenizers as units: parts of a text that are encoded one by one.

A unit is a substring on which a tokenizer's result depends on nothing around
it, so that what is known of a unit once holds wherever it stands. Vocabulary
files are read by path on each machine and nothing of them is copied here.
"""

from __future__ import annotations

import os
import re
from itertools import batched

import regex

#: Ranges of code points on which the byte-level pattern of the tokenizer library
#: and that of the ``regex`` package agree (newer letters and digits lie outside;
#: a test compares both over all of these). A text with any other code point is
#: cut by the library itself.
AGREED = r"\x00-\u0557\u0590-\u088e\u0900-\u0c5b\u0d00-\u208e\u20a0-\ua7cd\uac00-\ud7ff\uf900-\uffff\U0001f000-\U0001ffff"
OUTSIDE = re.compile(f"[^{AGREED}]")

#: A space (or its stand-in in pieces) after another character opens a unit of a piece model.
PIECE_CUT = re.compile("(?<=[^ ▁])(?=[ ▁])")


#: Units that are encoded in one call.
BATCH = 4_096


class ByteLevel:
    """A byte-level BPE file (``.json``); units are its pre-tokens.

    With ``plain`` the strings of special tokens are plain text; else each is one
    token, as the library has it, and never part of a unit.
    """

    def __init__(self, path: str, plain: bool = False):
        # Tasks have one core each; the library reads this when it first encodes.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        added = self.library.get_added_tokens_decoder()
        kind = type(self.library.pre_tokenizer).__name__
        # Asked of the library, not of its file: a space is neither added nor kept apart.
        probe = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str("a b")]
        if kind != "ByteLevel" or probe != ["a", "Ġb"] or self.library.normalizer is not None or any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        longest_first = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.special = None if plain or not added else re.compile("|".join(map(re.escape, longest_first)))

    def units(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and its number of special tokens."""
        if self.special is None or not (cuts := self.special.findall(text)):
            return self._cut(text), 0
        return [u for part in self.special.split(text) for u in self._cut(part)], len(cuts)

    def _cut(self, text: str) -> list[str]:
        if OUTSIDE.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def ids(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit, or of any texts in which special strings are plain."""
        return [e.ids for some in batched(units, BATCH) for e in self.library.encode_batch_fast(list(some), add_special_tokens=False)]

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id, special tokens as they are written."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = self.library.get_added_tokens_decoder()
        size = max(self.library.get_vocab_size(with_added_tokens=True), max(added, default=-1) + 1)
        return [added[i].content.encode() if i in added else bytes(byte_of[c] for c in self.library.id_to_token(i) or "") for i in range(size)]


class Pieces:
    """A SentencePiece model (``.model``) that puts a space before each text; units open at spaces.

    No piece may hold a space after another character; then no merge reaches over
    the start of a unit, and units are encoded by themselves.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.pieces = self.library.id_to_piece(list(range(size)))
        if any(PIECE_CUT.search(p) for p in self.pieces) or self.library.encode("a b", out_type=str) != ["▁a", "▁b"]:
            raise ValueError(f"pieces reach over spaces: {path}")
        self.space = self.library.piece_to_id("▁")

    def units(self, text: str) -> tuple[list[str], int]:
        """Units of the text, each with the space before it, and no special token."""
        return (PIECE_CUT.split(" " + text) if text else []), 0

    def ids(self, units: list[str]) -> list[list[int]]:
        # The model adds the first space itself; of a lone space nothing would be left to encode.
        found = self.library.encode([u[1:] for u in units], num_threads=1)
        return [ids if len(u) > 1 else [self.space] for u, ids in zip(units, found)]

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id; control and unknown pieces have none."""
        lib, out = self.library, []
        for i, piece in enumerate(self.pieces):
            silent = lib.is_control(i) or lib.is_unknown(i)
            out.append(b"" if silent else bytes([int(piece[1:-1], 16)]) if lib.is_byte(i) else piece.replace("▁", " ").encode())
        return out


def load(path: str, plain: bool = False) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path, plain)
