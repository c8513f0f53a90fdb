"""Token ids of whole texts, by the tokenizers library.

The library takes microseconds for each word, and words repeat. Its pre-tokenizers cut
a text at certain white space whatever stands around it, so ids of the pieces between
such cuts are those of the whole. Pieces are encoded once and kept in a bounded
dictionary; the ids of a text are then a join of byte strings. Tokenizers of another
kind than the two known ones encode every text as it is.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np

from rankloom.llm.common import kept

#: Words kept per Python worker and dictionary: about 250 MB at most.
KEPT_WORDS = 1_000_000
#: Marks that may end a word. The apostrophe is left out: it opens contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space for Python but not for the tokenizers' patterns.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Ids are handed out as little-endian unsigned 32-bit integers.
IDS = np.dtype("<u4")


class Odd(ValueError):
    """A word with white space in it, or an empty one."""


class Kept(dict):
    """Values by key, made on demand. When full, one older generation stays at hand."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """ids(text) gives the bytes of the text's ids; no special tokens are put around it.

    The file's added tokens are single ids where a text holds their strings, as in the
    library: such a text is encoded as a whole. With ``plain_added`` they are ordinary text.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS, plain_added: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_added
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.symbols = {
            b: pre_tokenizers.ByteLevel(False, use_regex=False).pre_tokenize_str(chr(b))[0][0][-1]
            for b in range(128)}
        self.symbols |= _upper_symbols(pre_tokenizers.ByteLevel(False, use_regex=False))
        self.marks = Kept(self._encoded, 10_000)
        self.bare = Kept(functools.partial(self._word, ""), kept_words)
        self.spaced = Kept(functools.partial(self._word, " "), kept_words)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        added = [] if plain_added else rules.get("added_tokens") or []
        before, after = rules.get("normalizer"), rules.get("pre_tokenizer") or {}
        if any(token.get("normalized") for token in added):  # they may arise in the normaliser
            by_words = self._encoded
        elif before is None and after.get("type") == "ByteLevel" and after.get("use_regex", True) \
                and not after.get("add_prefix_space"):
            self.line_break = self._encoded("\n")
            by_words = self._of_spaced_words
        elif _drops_blanks(before, after):
            by_words = self._of_separate_words
        else:
            by_words = self._encoded
        self.by_words = by_words
        self.added = re.compile("|".join(re.escape(token["content"]) for token in added) or r"(?!)")

    def ids(self, text: str) -> bytes:
        return self._encoded(text) if self.added.search(text) else self.by_words(text)

    def _encoded(self, text: str) -> bytes:
        return np.asarray(
            self.tokenizer.encode(text, add_special_tokens=False).ids, IDS).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Letters, perhaps with a space before them, are one piece: straight to the model."""
        if self.normalizer is not None:
            piece = piece.lower() if piece.isascii() else self.normalizer.normalize_str(piece)
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols))
        return struct.pack(f"<{len(tokens)}I", *[token.id for token in tokens])

    def _word(self, space: str, word: str) -> bytes:
        """A word without white space. Letters and the marks behind them are separate pieces."""
        if word.isalpha():
            if _stays_letters(word):
                return self._piece(space + word)
        else:
            core = word.rstrip(MARKS)
            if core.isalpha() and _stays_letters(core):
                return (self.spaced if space else self.bare)[core] + self.marks[word[len(core):]]
            if word.split() != [word]:
                raise Odd(word)
        return self._encoded(space + word)

    def _of_separate_words(self, text: str) -> bytes:
        if any(c in text for c in SEPARATORS):
            return self._encoded(text)
        return b"".join(map(self.bare.__getitem__, text.split()))

    def _of_spaced_words(self, text: str) -> bytes:
        """A space belongs to the word behind it, and a single line break stands alone."""
        try:
            return self.line_break.join(map(self._line, text.split("\n")))
        except Odd:
            first, *rest = SINGLE_SPACE.split(text)
            return self._encoded(first) + b"".join(map(self._spaced_or_odd, rest))

    def _line(self, line: str) -> bytes:
        words = line.split(" ")
        return self.bare[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))

    def _spaced_or_odd(self, piece: str) -> bytes:
        try:
            return self.spaced[piece]
        except Odd:
            return self._encoded(" " + piece)


def _stays_letters(core: str) -> bool:
    """Whether composing and lower-casing leave letters only."""
    return core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha()


def _upper_symbols(as_bytes) -> dict[int, str]:
    """The symbols of bytes above 127, taken from characters of two bytes and their leads."""
    found = {}
    for point in [*range(0x80, 0x800), *range(0x800, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000)]:
        if 0xD800 <= point < 0xE000:
            continue
        for byte, symbol in zip(chr(point).encode(), as_bytes.pre_tokenize_str(chr(point))[0][0], strict=True):
            found[byte] = symbol
    return found


def _drops_blanks(normalizer: dict | None, pre_tokenizer: dict) -> bool:
    """Composition, white space to single spaces, lower case; then only what is no white space."""
    kinds = [x.get("type") for x in (normalizer or {}).get("normalizers", [])]
    steps = pre_tokenizer.get("pretokenizers", [])
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and "\\s" in steps[0]["pattern"].get("Regex", "")
        and not steps[1].get("use_regex")
    )


def encoder(path: str, kept_words: int = KEPT_WORDS) -> Encoder:
    """One encoder per Python worker, vocabulary and bound, kept while Spark reuses the worker, until
    tasks of an operator that keeps nothing give it back."""
    encoders, key = kept(), f"{path}:{kept_words}"
    if key not in encoders:
        encoders[key] = Encoder(path, kept_words)
    return encoders[key]
