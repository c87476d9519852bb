"""Token ids of whole texts by the tokenizers library, with a memory of words that were encoded before.

The tokenizer drops white space and never merges across it, so a text's ids are those of its words in a row. The distinct
words of a batch are cut into a core of letters in lower case and the signs after it; each distinct core and run of signs goes
through the library once and is remembered in a bounded memory. Cores of plain letters are one part of the tokenizer file's
own pattern and are given to the library's BPE model directly; any other word goes through the library's whole pipeline.
"""

from __future__ import annotations

import codecs
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

END_ID = 2
#: Cores that a worker remembers; others are encoded anew in each batch.
MEMORY_WORDS = 800_000

#: Characters that keep their meaning under NFC and have one lower-case form in every library, and the letters of them.
_PLAIN = regex.compile("[!-~¡-įĲ-ňŊ-ɏ]+")
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ƺƼ-ƿǄ-ɏ]+$"

_SIGNS = ".,;:!?#$%&*|)"
_BEFORE_SIGNS = f"^(?s:.*)[^{_SIGNS}]"


def _byte_letters() -> str:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(letters[b] for b in range(256))


_LETTER_OF = _byte_letters()
#: The same for lists of words, with a line feed between them.
_LETTER_OF_LIST = _LETTER_OF[:10] + "\n" + _LETTER_OF[11:]


class WordEncoder:
    """Ids of texts; ``path`` is a tokenizer file whose normaliser lower-cases and whose pattern drops white space."""

    def __init__(self, path: str, memory_words: int = MEMORY_WORDS):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(cut[0]["pattern"]["Regex"])
        #: Numbers of cores, signs and other words; ids of number k are pool[starts[k] : starts[k + 1]]. Number 0 has no id.
        self.known: dict[str, int] = {"": 0}
        self.starts, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.used = 1
        self.memory_words = memory_words

    def word(self, word: str) -> list[int]:
        """Ids of a word that is more than plain letters."""
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.whole.encode(word, add_special_tokens=False).ids
        return [t.id for part in self.pattern.findall(word.lower()) for t in self.model.tokenize(codecs.charmap_decode(part.encode(), "strict", _LETTER_OF)[0])]

    def _encoded(self, cores: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cores of plain letters in lower case, and then of other words, in a row; and how many each has."""
        tokenize, ids, sizes = self.model.tokenize, [], []
        spelled = codecs.charmap_decode("\n".join(cores).encode(), "strict", _LETTER_OF_LIST)[0]
        for c in spelled.split("\n") if cores else []:
            tokens = tokenize(c)
            sizes.append(len(tokens))
            ids += [t.id for t in tokens]
        for w in others:
            own = self.word(w)
            sizes.append(len(own))
            ids += own
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def _numbers(self, keys: list[str], plain: np.ndarray) -> np.ndarray:
        """Numbers of distinct keys. Keys beyond the memory get numbers that hold until the next call."""
        out = list(map(self.known.get, keys))
        fresh = np.array([k for k, n in enumerate(out) if n is None], np.int64)
        if not len(fresh):
            return np.array(out, np.int64)
        cores, others = fresh[plain[fresh]].tolist(), fresh[~plain[fresh]].tolist()
        ids, sizes = self._encoded([keys[k] for k in cores], [keys[k] for k in others])
        filled = int(self.starts[self.used])
        while self.used + len(fresh) + 1 > len(self.starts):
            self.starts = np.append(self.starts, np.zeros_like(self.starts))
        while filled + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[filled : filled + len(ids)] = ids
        self.starts[self.used + 1 : self.used + 1 + len(fresh)] = filled + np.cumsum(sizes)
        for n, k in enumerate(cores + others, self.used):
            out[k] = n
            if n < self.memory_words:
                self.known[keys[k]] = n
        self.used += len(fresh)
        return np.array(out, np.int64)

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct word the numbers of its core, or of all of it, and of the signs after the core."""
        core = pc.utf8_rtrim(words, _SIGNS)
        plain = pc.match_substring_regex(core, _LETTERS)
        keys = pc.if_else(plain, pc.utf8_lower(core), words).dictionary_encode()
        index, letters = np.asarray(keys.indices), np.asarray(plain)
        is_core = np.zeros(len(keys.dictionary), bool)
        is_core[index] = letters
        first = self._numbers(np.asarray(keys.dictionary).tolist(), is_core)[index]
        second = np.zeros(len(words), np.int64)
        signed = np.flatnonzero(letters & (np.asarray(pc.binary_length(core)) < np.asarray(pc.binary_length(words))))
        if len(signed):
            signs = pc.replace_substring_regex(words.take(pa.array(signed)), _BEFORE_SIGNS, "").dictionary_encode()
            second[signed] = self._numbers(np.asarray(signs.dictionary).tolist(), np.zeros(len(signs.dictionary), bool))[np.asarray(signs.indices)]
        return first, second

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text closed by ``end_id``, and the bounds of the texts in them. Null counts as empty."""
        self.used = min(self.used, len(self.known))
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        parts = np.stack(self._parts(words.dictionary), 1).reshape(-1)
        # A list of ids for each distinct word, and a last one for the end of a text.
        halves = pa.ListArray.from_arrays(pa.array(self.starts[: self.used + 1].astype(np.int32)), pa.array(self.pool[: self.starts[self.used]])).take(pa.array(parts))
        offsets = np.asarray(halves.offsets)
        lists = pa.ListArray.from_arrays(pa.array(np.append(offsets[::2], offsets[-1] + 1).astype(np.int32)), pa.array(np.append(np.asarray(halves.values), np.uint32(end_id))))
        ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        units = np.insert(np.asarray(words.indices), ends, len(words.dictionary))
        taken = lists.take(pa.array(units))
        bounds = np.asarray(taken.offsets)[np.append(0, ends + np.arange(1, len(ends) + 1))]
        return np.asarray(taken.values), bounds.astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file; it keeps its memory from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
