"""Pre-tokens of texts, and the pieces of single pre-tokens, with the tokenizers library.

Special strings are cut out first, as the library does. A stretch of text whose characters all lie in a
known range is cut into pre-tokens by an expression for that range, if the tokenizer's file states one
of the two known ways of pre-tokenising; any other stretch (other scripts, unusual white space, other
files) is cut by the library's own normaliser and pre-tokeniser. The model runs on distinct pre-tokens
only. A tokenizer whose added strings are matched in other ways than by plain text encodes texts whole.
"""

from __future__ import annotations

import json
import os
import re

from hemicycle.llm._shared import Cache

# The letters and numbers among the Latin-1 characters, and ASCII white space.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = r"\t-\r "
#: Characters whose handling is left to the library.
_UNKNOWN = re.compile("[^\\t-\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\xff‐-‧‰-⁞]")
# The pre-token patterns of the two public tokenizers, for the range above.
_BYTE_PATTERN = f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_WORD_PATTERN = f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"
# How the files of these two state their normaliser and pre-tokeniser.
_WORD_FILE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_BYTE_FILE = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})


def byte_alphabet() -> dict[int, str]:
    """The usual printable stand-ins of bytes: visible Latin-1 characters keep their own, others follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PreTokens:
    """Pre-tokens as the model sees them (in the byte alphabet where there is one) and their pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        added = stated.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self.whole_only = self.tokenizer.pre_tokenizer is None or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        way = (stated.get("normalizer"), stated.get("pre_tokenizer"))
        self.lower = way == _WORD_FILE
        self.split = re.compile(_WORD_PATTERN).findall if self.lower else re.compile(_BYTE_PATTERN).findall if way == _BYTE_FILE else None
        self.alphabet = byte_alphabet()

    def _stretch(self, text: str) -> list[str]:
        if self.split and not _UNKNOWN.search(text):
            return self.split(text.lower() if self.lower else text)
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        # in the byte alphabet: marked by a leading NUL, which no pre-token of the known range has
        return ["\0" + t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[list[str] | int]:
        """Lists of pre-tokens, and the ids of special strings between them."""
        if self.cut is None or not self.cut.search(text):
            return [self._stretch(text)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._stretch(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, self._stretch(text[at:])]

    def pieces(self, token: str) -> list[int]:
        """The ids of one pre-token of parts()."""
        if token.isascii() and token.isprintable():  # of these only the blank has a stand-in
            shown = token.replace(" ", self.alphabet[32])
        else:
            shown = token[1:] if token[:1] == "\0" else token.encode().decode("latin-1").translate(self.alphabet)
        return [x.id for x in self.model.tokenize(shown)]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """pieces of texts: make(ids) of each pre-token, from a bounded memo, to be joined."""

    def __init__(self, path: str, make, most: int = 250_000):
        self.pre, self.make = PreTokens(path), make
        self.tokenizer = self.pre.tokenizer
        self.cache = Cache(lambda t: make(self.pre.pieces(t)), most)

    def of(self, text: str) -> list:
        """What make() gives for the text's stretches, in order."""
        if self.pre.whole_only:
            return [self.make(self.pre.whole(text))]
        out = []
        for part in self.pre.parts(text):
            if isinstance(part, int):
                out.append(self.make([part]))
            else:
                out += map(self.cache.__getitem__, part)
        return out
