"""Pre-tokens and pieces of the byte-pair encoding in word_bpe_49k.json, as its library gives them.

Pre-tokens never span white space, so most texts need no more than splitting and a look-up for each run of other
characters.  Texts with characters or strings for which that might differ from the library are handed to the library's
own normaliser and pre-tokeniser.  Pieces always come from the library's model.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"

#: The pre-tokeniser's pattern, a fixed value of the vocabulary file.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters whose normalisation, case and class are beyond doubt: ASCII, Latin-1, Latin Extended-A, common marks.
_UNSAFE = re.compile("[^\t\n\r -~¡-¬®-įı-ž‘’“”–—•…€]")


def _byte_alphabet() -> list[str]:
    """Bytes as characters: printable ones as themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return [table[b] for b in range(256)]


_BYTES = _byte_alphabet()
#: Marks that make a pre-token of their own after letters and at a run's end.
_MARKS = frozenset(".,!?;:)")


def in_bytes(word: str) -> str:
    """A word in the byte alphabet."""
    return word if word.isascii() else "".join(map(_BYTES.__getitem__, word.encode()))


class WordBpe:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.sentence_ends = sorted(i for t, i in self.library.get_vocab().items() if re.fullmatch(r".*[.!?]</w>", t))

    def runs(self, text: str) -> list[str] | None:
        """A safe text's runs of characters without white space, lower-cased; None for other texts."""
        if _UNSAFE.search(text) or ("<|" in text and self._special.search(text)):
            return None
        return text.lower().split()

    def pretokens(self, run: str) -> list[str]:
        """A run's pre-tokens, in the byte alphabet."""
        return [in_bytes(w) for w in _PATTERN.findall(run)]

    def library_pretokens(self, text: str) -> list[str]:
        """Any text's pre-tokens by the library; special strings are pre-tokens of their own."""
        out: list[str] = []
        for k, part in enumerate(self._special.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def ids(self, pretoken: str) -> list[int]:
        if pretoken in self.special:
            return [self.special[pretoken]]
        return [t.id for t in self.tokenize(pretoken)]


@cache
def word_bpe(path: str | None = None) -> WordBpe:
    """The process's tokenizer; without a path that of the public vocabulary file."""
    return WordBpe(path or public_tokenizers.path(WORD_BPE))


class Generations:
    """A table of two generations: what is asked for outlives those that aren't; at most ``2 * limit`` entries."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.new) >= self.limit:
            self.new, self.old = {}, self.new
        self.new[key] = value
        return value


class IdCache:
    """Ids of runs and of pre-tokens as packed little-endian 32-bit numbers."""

    def __init__(self, bpe: WordBpe, limit: int = 120_000) -> None:
        self.bpe = bpe
        self.of_run, self.of_pretoken = Generations(limit), Generations(limit)

    def pretoken(self, pretoken: str) -> bytes:
        kept = self.of_pretoken
        packed = kept.new.get(pretoken)
        if packed is None:
            packed = kept.put(pretoken, kept.old.get(pretoken) or array("I", self.bpe.ids(pretoken)).tobytes())
        return packed

    def run(self, run: str) -> bytes:
        """Ids of a run that isn't in the new generation; letters, or letters before one mark, need no pattern."""
        packed = self.of_run.old.get(run)
        if packed is None:
            if run.isalpha():
                packed = self.pretoken(in_bytes(run))
            elif run[-1] in _MARKS and run[:-1].isalpha():
                packed = self.pretoken(in_bytes(run[:-1])) + self.pretoken(run[-1])
            else:
                packed = b"".join(map(self.pretoken, self.bpe.pretokens(run)))
        return self.of_run.put(run, packed)

    def text(self, text: str) -> bytes:
        """All ids of a text."""
        runs = self.bpe.runs(text)
        if runs is None:
            return b"".join(map(self.pretoken, self.bpe.library_pretokens(text)))
        packed = list(map(self.of_run.new.get, runs))
        if None in packed:
            packed = [self.of_run.new.get(run) or self.run(run) if p is None else p for p, run in zip(packed, runs, strict=True)]
        return b"".join(packed)
