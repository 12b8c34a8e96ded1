"""Token ids of whole texts from remembered words.

A text is cut at single blanks between two non-blank characters. Byte-level pre-tokenization always
starts a new piece there, and a sentence-piece vocabulary in which no piece holds a blank after
another character never merges across it, so the tokens of the text are the tokens of its words,
one after the other. Each word is encoded once per worker until the memory is full; then the memory
is emptied. The words a text adds are encoded in one call and told apart by their byte lengths.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

from landwatch.llm.tokens import PATTERN

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Runs of blanks that are cut by hand.
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
#: Remembered words and their characters, at most, between two texts.
MAX_WORDS, MAX_CHARS = 500_000, 8_000_000


class Ragged:
    """Rows of numbers of any length, appended at the end of one array."""

    def __init__(self, dtype: type = np.int64):
        self.flat, self.used = np.empty(1 << 12, dtype), 0
        self.start, self.size, self.rows = np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64), 0

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of the given sizes, their values one after the other."""
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.rows + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(values)] = values
        at = slice(self.rows, self.rows + len(sizes))
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.used, self.rows = self.used + len(values), self.rows + len(sizes)

    def gather(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        if not len(ends):
            return self.flat[:0]
        return self.flat[np.repeat(self.start[rows] - ends + sizes, sizes) + np.arange(ends[-1])]


def is_loose(word: str) -> bool:
    """Whether a blank beside the word has a blank on its other side too, and is no place to cut."""
    return not word or word[0].isspace() or word[-1].isspace()


class Words:
    """Numbers of words. ``learn(words, joined)`` is told each new word once, in the order of its number.

    ``joined``: the words may be encoded as one text with blanks between them.
    """

    def __init__(self, learn: Callable[[list[str], bool], None], forget: Callable[[], None]):
        self.learn, self.forget = learn, forget
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.loose: set[str] = set()
        self.chars = 0
        self.forget()

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of each text; numbers of earlier calls may have changed their meaning."""
        if len(self.number) > MAX_WORDS or self.chars > MAX_CHARS:
            self.clear()
        cut = [text.split(" ") for text in texts]
        new = set(chain.from_iterable(cut)) - self.number.keys()
        loose = self.loose | set(filter(is_loose, new))
        if loose and (again := [k for k, words in enumerate(cut) if not loose.isdisjoint(words)]):
            for k in again:
                cut[k] = CUT.split(texts[k])
            new = set(chain.from_iterable(cut)) - self.number.keys()
        alone = set(filter(is_loose, new))
        for words in (sorted(new - alone), sorted(alone)):
            if words:
                self.learn(words, words[0] not in alone)
                self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
                self.chars += sum(map(len, words))
        self.loose |= alone
        get = self.number.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in cut]


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level encoder from its JSON file: the bytes of each token, and the ids of whole texts.

    The file lists merges, the encoder used here ranks; both give the same ids if every token is the
    encoding of its own bytes, which tests check for the vocabulary.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("not a plain byte-level vocabulary")
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in special}
        self.lengths = np.zeros(1 + max(*ranks.values(), *special.values(), 0), np.int64)
        for token, k in [*ranks.items(), *((t.encode(), k) for t, k in special.items())]:
            self.lengths[k] = len(token)
        self.encoding = tiktoken.Encoding("table", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text in which special tokens' strings are ordinary text."""
        if BLANKS.search(text):
            return self._with_long_blanks(text)
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def parsed(self, text: str) -> np.ndarray:
        """Ids of a text in which special tokens' strings are those tokens."""
        special = self.encoding.special_tokens_set
        if not any(x in text for x in special):
            return self.plain(text)
        parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text)
        return np.concatenate([np.array([self.encoding.encode_single_token(p)], np.uint32) if p in special else self.plain(p) for p in parts])

    def _with_long_blanks(self, text: str) -> np.ndarray:
        """The same ids without matching long blank runs by pattern, whose depth is limited.

        Of a run before another character all but the last blank are one piece, at the end of the text all of it.
        """
        out, done = [], 0
        for run in BLANKS.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out.append(self.encoding.encode_to_numpy(text[done : run.start()], disallowed_special=()))
            out.append(np.array(self.encoding._encode_single_piece(text[run.start() : stop]), np.uint32))
            done = stop
        out.append(self.encoding.encode_to_numpy(text[done:], disallowed_special=()))
        return np.concatenate(out)


def word_sizes(ends: np.ndarray, word_ends: np.ndarray) -> np.ndarray:
    """Tokens of each word, where every word ends with a token."""
    at = np.searchsorted(ends, word_ends)
    if (at >= len(ends)).any() or (ends[at] != word_ends).any():
        raise ValueError("a token crosses a word")
    return np.diff(np.concatenate(([0], at + 1)))


def byte_lengths(words: Iterable[str]) -> np.ndarray:
    return np.array([len(w.encode()) for w in words], np.int64)
