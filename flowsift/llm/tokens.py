"""Token ids of whole texts by a public word-level BPE tokenizer, with known chunks looked up."""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Chunks whose pre-tokens the pattern below gives exactly as the tokenizer does; all others go to the tokenizer.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# The tokenizer's own split, over those characters and lower case.
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Beyond these characters lower case and composed forms may depend on each other.
_ODD = re.compile(r"[^\x00-\xff]")


class _Numbers(dict):
    """Numbers keys in order of arrival and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.new.append(key)
        return number


class _Rows:
    """Growing list of id rows in one flat array."""

    def __init__(self):
        self.flat = np.empty(1 << 16, np.uint32)
        self.begin, self.size, self.used = array("q"), array("q"), 0

    def add(self, ids) -> None:
        n = len(ids)
        if self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.empty(max(n, len(self.flat)), np.uint32)])
        self.flat[self.used:self.used + n] = ids
        self.begin.append(self.used)
        self.size.append(n)
        self.used += n

    def get(self, k: int) -> list[int]:
        return self.flat[self.begin[k]:self.begin[k] + self.size[k]].tolist()


#: What a known chunk takes beside its bytes and ids: two dictionary slots, the bytes object, the list entries.
_CHUNK_BYTES = 160
_STRETCH = 1 << 20


class CachedEncoder:
    """ids(texts): the tokenizer's ids without special tokens.

    The tokenizer never joins across white space, so a text is cut there, and each different chunk is encoded
    once. Chunks of plain characters are cut into the tokenizer's words and go to its merges directly; any other
    chunk goes to the whole tokenizer. At most about ``most`` chunks are known at a time.
    """

    def __init__(self, path: str, most_bytes: int = 96 << 20):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.most_bytes = most_bytes
        self.vocabulary = self.tokenizer.get_vocab_size()
        # The byte alphabet of the merges: printable bytes stand for themselves, the others follow from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: 256 + n for n, b in enumerate(others)}
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.chunk_ids, self.held_bytes = _Numbers(), _Rows(), 0

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        known = self.chunks.get(word.encode())  # a word may be a chunk that has been learned
        if known is not None and known < len(self.chunk_ids.begin):
            return self.chunk_ids.get(known)
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.merge(spelled)]

    def _learn(self) -> None:
        new, self.chunks.new = self.chunks.new, []
        add, word, merge = self.chunk_ids.add, self._word, self.merge
        self.held_bytes += sum(map(len, new)) + _CHUNK_BYTES * len(new)
        for chunk in new:
            if chunk.isalpha():  # letters of ASCII
                add([t.id for t in merge(chunk.decode("ascii").lower())])
                continue
            if chunk[-1] in b".," and chunk[:-1].isalpha():
                add(word(chunk[:-1].decode("ascii").lower()) + word(chr(chunk[-1])))
                continue
            text = chunk.decode("utf-8", "replace")
            if b"<|" in chunk or not _PLAIN.fullmatch(text):
                add(self._direct(text))
            else:
                add([i for w in _PRE.findall(text.lower()) for i in word(w)])

    def _numbered(self, raw: bytes) -> np.ndarray:
        """Numbers of the chunks; a long text is cut at blanks, so that its chunks are never all held as objects."""
        parts, at = [np.empty(0, np.int32)], 0
        while at < len(raw):
            stop = raw.find(b" ", at + _STRETCH)
            stop = len(raw) if stop < 0 else stop
            chunks = raw[at:stop].split()
            parts.append(np.fromiter(map(self.chunks.__getitem__, chunks), np.int32, len(chunks)))
            at = stop
        return np.concatenate(parts) if len(parts) > 2 else parts[-1]

    def _gathered(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        begin, size = np.array(self.chunk_ids.begin, np.int64), np.array(self.chunk_ids.size, np.int64)
        out = []
        for row in numbers:
            at = np.asarray(row, np.int64)
            n = size[at] if len(at) else at
            total = int(n.sum())
            first = np.cumsum(n) - n
            place = np.repeat(begin[at] - first, n) + np.arange(total) if total else np.empty(0, np.int64)
            out.append(self.chunk_ids.flat[place])
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        waiting: list[np.ndarray] = []
        for text in texts:
            raw = text.encode("utf-8", "replace")
            if b"<|" not in raw and not _ODD.search(text):
                raw = raw.lower()
            waiting.append(self._numbered(raw))
        self._learn()
        out = self._gathered(waiting)
        if self.held_bytes + 4 * self.chunk_ids.used > self.most_bytes:
            self._forget()
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def shared_encoder(path: str) -> CachedEncoder:
    """One encoder for all tasks of a Python worker, so what it knows is not learned again by each task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]
