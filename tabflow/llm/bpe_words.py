"""Word-by-word encoding with a public ``tokenizers`` vocabulary, equal to encoding the whole text.

The vocabulary of ``word_bpe_49k.json`` drops white space, never merges across it and matches no
special token across it, so a text's ids are the ids of its white-space separated words in order.
A bounded table keeps the ids of words seen before; plain words (ASCII or Latin-1 letters, digits,
punctuation) go straight to the merge table of the library, any other word through its full encode.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: words kept per worker; when half of them are new since the last time, those not met since then are dropped
WORD_TABLE = 600_000

# The split pattern of the vocabulary file, on lower-case ASCII and Latin-1 words.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
# the same for words joined by spaces, the spaces being parts of their own
_PLAIN_WORDS = re.compile(r"[ -~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(keep))
    return [shown[b] for b in range(256)]


class WordTable(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = WORD_TABLE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.limit = limit
        self.packed = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab(True).values()))]
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        out = self.before.get(word)
        if out is None:
            out = self.encode_word(word)
        if 2 * len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[word] = out
        return out

    def encode_word(self, word: str) -> bytes:
        """Ids of a word; those of its lower-case pre-tokens come from the table as well."""
        if word.isalpha() if word.isascii() else _LETTERS.fullmatch(word):
            low = word.lower()
            return self.merged(low) if low == word else self[low]
        if self.plain(word):
            parts = _PRE_TOKEN.findall(word.lower())
            if len(parts) == 1 and parts[0] == word:
                return self.merged(word)
            return b"".join([self[p] for p in parts])
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, word: str) -> bool:
        return _PLAIN.fullmatch(word) is not None and not ("<|" in word and any(s in word for s in self.special))

    def merged(self, part: str) -> bytes:
        """Ids of one lower-case pre-token, merged by the library."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.alphabet)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(part)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as bytes of little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, split_words(text)))

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, the n + 1 bounds of the texts in them); a null text is empty.  Each distinct
        word is cut and looked up once, by its lower-case pre-tokens."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        known = split.flatten().dictionary_encode()
        n = len(known.dictionary)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), known.dictionary), " ")[0].as_py()
        odd = {}
        if "<|" in joined or not _PLAIN_WORDS.fullmatch(joined):
            words = joined.split(" ")
            odd = {i: self.encode_word(w) for i, w in enumerate(words) if not self.plain(w)}
            joined = " ".join(["" if i in odd else w for i, w in enumerate(words)])
        parts = _PARTS.findall(joined.lower())
        pieces = list(map(self.__getitem__, parts))
        of = np.cumsum(np.fromiter(map(" ".__eq__, parts), dtype=bool, count=len(parts)))
        size = np.bincount(of, np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)), n).astype(np.int64) // 4
        start = np.cumsum(size) - size
        held = int(size.sum())
        for i, piece in odd.items():
            start[i], size[i] = held, len(piece) // 4
            held += len(piece) // 4
        ids = np.frombuffer(b"".join([*pieces, *odd.values()]), dtype="<u4")
        word = known.indices.to_numpy(zero_copy_only=False)
        own = size[word]
        end = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(start[word] - end[:-1], own) + np.arange(end[-1])
        words_to = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return ids[at], end[words_to]


_SPACE = re.compile(r"[\x20\x09-\x0d]+")


def split_words(text: str) -> list[str]:
    """Words between white space.  str.split() also cuts at four control characters that the vocabulary
    does not take for white space; texts that hold one are cut at ASCII white space only."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The worker's table for a vocabulary file; kept while the worker lives."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]
