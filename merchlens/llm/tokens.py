"""Whole-text tokenising with a public vocabulary file, one worker-local word cache.

The pre-tokenisers of these files never join characters across a single space
(or a single line end) between two non-blank characters, so a text's ids are
the concatenation of its words' ids.  A word is encoded once per worker and then
looked up; words are found per Arrow batch with a dictionary encoding, so the cost
of a frequent word is one hash lookup per batch.  Texts in which blanks touch
each other, or that hold a control string of the vocabulary or one of the two marker
characters used here, go through the library whole.
"""

from __future__ import annotations

import os
import re
import string
import threading
import time
from array import array
from sys import byteorder

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from merchlens.llm.common import give_back

#: Words kept per worker; a full cache is dropped and refilled from the next batch.
CACHE_WORDS = 700_000
#: A worker that has not encoded for so long gives its cache back.
IDLE_SECONDS = 3.0
#: Characters of text encoded at once: bounds the scratch arrays.
_SLICE_BYTES = 4 << 20
_FIRST, _LINE, _MORE = "\x02", "\x01", "\x03"
_ODD = r"[\s\v\p{Z}\x85\x{1c}-\x{1f}]{2}|[\x01\x02]"
_PUNCT = string.punctuation


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file (installed with the runtime, never copied here)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def _le(ids: list[int]) -> bytes:
    """Little-endian uint32 bytes of a short id list."""
    a = array("I", ids)
    if byteorder == "big":
        a.byteswap()
    return a.tobytes()


class TextEncoder:
    """Encodes Arrow string arrays to token ids with the tokenizers library.

    A control string of the vocabulary inside a text gets its control id, as the library's plain
    call gives it; with ``controls_as_text`` it is ordinary text."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, controls_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = controls_as_text
        self.limit = cache_words
        self.cache: dict[str, bytes] = {}
        # vocabularies with word-end marks drop blanks; the others keep them as tokens
        self.drops_blanks = bool(self.lib.model.end_of_word_suffix)
        self.odd = r"[\x01\x02]" if self.drops_blanks else _ODD
        controls = [] if controls_as_text else [t.content for t in self.lib.get_added_tokens_decoder().values()]
        if controls:  # in any case: some vocabularies look for them in lower-cased text
            self.odd += "|(?i:" + "|".join(map(re.escape, controls)) + ")"
        self.alphabet = _byte_alphabet()
        self.space = "" if self.drops_blanks else self.alphabet[32]
        self.tokenize = self.lib.model.tokenize
        self.runs: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_le(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str, lead: str) -> bytes | None:
        """Ids of a word of letters: one pre-token, straight to the library's model."""
        if word.isascii():
            if not word.isalpha():
                return None
            body = word.lower() if self.drops_blanks else word
        else:
            if not word.isalpha() or max(word) >= "ɐ" or "İ" in word:
                return None
            a = self.alphabet
            body = "".join([a[b] for b in (word.lower() if self.drops_blanks else word).encode()])
        return _le([t.id for t in self.tokenize(lead + body)])

    def _run(self, marks: str) -> bytes:
        """Ids of a run of ASCII punctuation: one pre-token."""
        ids = self.runs.get(marks)
        if ids is None:
            if len(self.runs) > 10_000:
                self.runs.clear()
            ids = self.runs[marks] = self._whole([marks])[0]
        return ids

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks: plain = blank + word, _LINE = line end + word, _FIRST = word."""
        out: list[bytes | None] = []
        whole: list[str] = []
        for w in words:
            mark = w[:1]
            if mark == _FIRST:
                word, lead, text = w[1:], "", w[1:]
            elif mark == _LINE:
                word, lead, text = w[1:], None, "\n" + w[1:]
            else:
                word, lead, text = w, self.space, w if self.drops_blanks else " " + w
            ids = None
            if lead is not None and word:
                stem = word.rstrip(_PUNCT)
                if len(stem) == len(word):
                    ids = self._letters(word, lead)
                elif stem:  # letters, then one run of punctuation
                    ids = self.cache.get(stem) if lead == self.space and stem.isalpha() else None
                    if ids is None:
                        ids = self._letters(stem, lead)
                        if ids is not None and lead == self.space:
                            self.cache[stem] = ids
                    ids = ids and ids + self._run(word[len(stem):])
            if ids is None:
                whole.append(text)
            out.append(ids)
        rest = iter(self._whole(whole) if whole else ())
        return [next(rest) if x is None else x for x in out]

    # a worker outlives its tasks: words that nobody asked for lately are given back
    _busy, _used = False, 0.0
    _watcher: threading.Thread | None = None

    def forget(self) -> None:
        """Drop the word cache and hand free memory back to the system."""
        self.cache = {}
        give_back()

    def _watch(self) -> None:
        while self._busy or time.monotonic() - self._used < IDLE_SECONDS:
            time.sleep(0.5)
        self._watcher = None
        self.forget()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32, offsets int64): text i has ids[offsets[i]:offsets[i + 1]].  Null is empty."""
        self._busy = True
        try:
            return self._encode(texts)
        finally:
            self._busy, self._used = False, time.monotonic()
            if self._watcher is None:
                self._watcher = threading.Thread(target=self._watch, daemon=True)
                self._watcher.start()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64,
                                      len(texts) + 1, texts.offset * (4 if pa.types.is_string(texts.type) else 8))) if len(
            texts) else np.zeros(0, np.int64)
        parts, counts, start, total = [], [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            total += n
            if total >= _SLICE_BYTES or i == len(sizes) - 1:
                ids, c = self._slice(texts.slice(start, i + 1 - start))
                parts.append(ids)
                counts.append(c)
                start, total = i + 1, 0
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offsets.astype(np.int64)

    def _mark(self, texts: pa.Array) -> pa.Array:
        """Texts whose blanks part the chunks that :meth:`_words` reads."""
        if self.drops_blanks:
            return pc.replace_substring(texts, "\n", " ")
        return pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts, "\n", " " + _LINE), "")

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd)
        marked = self._mark(texts)
        n_odd = pc.sum(odd).as_py() or 0
        if n_odd:
            marked = pc.if_else(odd, "", marked)
        split = pc.split_pattern(marked, " ")
        chunk_counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        known = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        at = np.cumsum(n) - n
        ix = coded.indices.to_numpy()
        lens = n[ix]
        ends = np.cumsum(lens)
        ids = flat[np.repeat(at[ix] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(chunk_counts)])]
        counts = np.diff(bounds)
        if n_odd:
            where = np.nonzero(odd.to_numpy(zero_copy_only=False))[0]
            whole = dict(zip(where.tolist(), self._whole([texts[i].as_py() for i in where.tolist()])))
            pieces = [np.frombuffer(whole[i], "<u4") if i in whole else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return ids, counts

    def _lookup(self, words: list[str]) -> list[bytes]:
        get = self.cache.get
        known = [get(w) for w in words]
        missing = [i for i, k in enumerate(known) if k is None]
        if missing:
            if len(self.cache) + len(missing) > self.limit:
                self.cache.clear()
            new = [words[i] for i in missing]
            for i, w, ids in zip(missing, new, self._words(new)):
                known[i] = self.cache[w] = ids
        return known


_ENCODERS: dict[tuple, TextEncoder] = {}


def encoder(path: str, kind: type[TextEncoder] = TextEncoder, **options) -> TextEncoder:
    """The worker's encoder for a vocabulary file: Python workers are reused, so its
    word cache stays warm from task to task."""
    key = (path, kind, *sorted(options.items()))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = kind(path, **options)
    return _ENCODERS[key]


def lists_to_bytes(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary array of the little-endian uint32 ids between neighbouring offsets."""
    raw = np.ascontiguousarray(ids, "<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets * 4, np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
