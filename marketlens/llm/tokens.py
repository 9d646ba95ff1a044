"""Token ids of texts, by a public tokenizer, with a cache of words.

The tokenizer lower-cases, drops white space and never joins across it, so the ids of a
text are those of its lower-cased words.  Most words recur, so a worker encodes a word once
and then copies its ids.  Signs behind a letter or digit are a token group of their own, so
such a word has the ids of what is before them and those of the signs.  What counts is the
last character that the tokenizer sees, after composition (NFC) and lower-casing: a few
letters end in a combining mark then, which joins the signs.  Words of
plain letters go straight to the tokenizer's merges, many in one call, without its normaliser
and splitter; a probe at the start makes sure that both ways give the same ids.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in the younger half of the cache; there are at most twice as many in memory.
CACHE_WORDS = 200_000
#: Words of letters that are merged together.
TOGETHER = 256
#: Texts that are encoded together.
TEXTS = 2048
#: Bytes of text that are split into words at a time.
CHUNK = 1 << 23
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: ASCII signs that never join a letter; the apostrophe does, in contractions.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: First bytes of the combining marks that join ASCII letters; composition goes before lower-casing, so texts
#: with one keep their capitals in the cache.
MARKS = (b"\xcc", b"\xcd")
#: A text with this is left to the tokenizer as a whole, as its special tokens are not lower-cased.
SPECIAL = b"<|"

PROBES = ["the", "straße", "extraordinarily", "é", "œuvre", "thntstble", "ñandú", "übergänge", "x", "antidisestablishment"]

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about CHUNK bytes, cut at white space."""
    at = 0
    while len(text) - at > CHUNK:
        cut = SPACE.search(text, at + CHUNK)
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def ends_plain(word: bytes) -> bool:
    """Whether a word ends in a letter or digit once it is composed and then lower-cased."""
    return unicodedata.normalize("NFC", word.decode("utf-8")).lower()[-1].isalnum()


class WordTokenizer:
    """Encodes texts with the tokenizer file at ``path``; ids are packed little-endian unsigned integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        probed = [self.pack(e.ids) for e in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        self.direct = self.merged([w.encode() for w in PROBES]) == probed

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of words of letters, by the tokenizer's merges alone."""
        encoded = self.merges.encode(b" ".join(words).decode("utf-8").lower(), add_special_tokens=False)
        packed, size = self.pack(encoded.ids), self.dtype.itemsize
        ends = (np.cumsum(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(words))) * size).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, which are in the younger half of the cache then."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young = self.young
        found = list(map(young.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if not new:
            return found
        new = self.refresh(new)
        alone = [w for w in new if w.isalpha()]
        ended, cores, signs = [], [], []
        for w in new:
            if w.isalpha():
                continue
            core = w.rstrip(SIGNS)
            if core and len(core) < len(w) and (core[-1:].isalnum() or core[-1] > 127 and ends_plain(core)):
                ended.append(w)
                cores.append(core)
                signs.append(w[len(core):])
            else:
                alone.append(w)
        self.tokenise(alone)
        self.tokenise(self.refresh([w for w in {*cores, *signs} if w not in young]))
        young.update(zip(ended, map(add, map(young.__getitem__, cores), map(young.__getitem__, signs))))
        return list(map(young.__getitem__, words))

    def refresh(self, words: list[bytes]) -> list[bytes]:
        """Copy what the older half of the cache has of ``words`` to the younger one; the words that it has not."""
        found = list(map(self.old.get, words))
        self.young.update((w, ids) for w, ids in zip(words, found) if ids is not None)
        return [w for w, ids in zip(words, found) if ids is None]

    def tokenise(self, words: list[bytes]) -> None:
        """Put the ids of distinct words that are not known into the cache."""
        easy, hard = [], []
        for w in words:
            (easy if self.direct and (w.isalpha() or self.letters(w)) else hard).append(w)
        for at in range(0, len(easy), TOGETHER):
            some = easy[at:at + TOGETHER]
            self.young.update(zip(some, self.merged(some)))
        encoded = self.tokenizer.encode_batch([w.decode("utf-8") for w in hard], add_special_tokens=False)
        self.young.update(zip(hard, (self.pack(e.ids) for e in encoded)))

    @staticmethod
    def letters(word: bytes) -> bool:
        """Whether a word has nothing but letters below U+0130, which all ways of lower-casing treat alike."""
        text = word.decode("utf-8")
        return text.isalpha() and max(text) < "\u0130"

    def lookup(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of texts without special tokens, lower-cased as far as they may be."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        words = split.values.dictionary_encode()
        known = pa.array(self.learn(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()), pa.binary())
        ids = known.take(words.indices)
        if not len(ids):
            return [b""] * len(texts)
        # the ids of neighbouring words lie side by side
        _, places, packed = ids.buffers()
        at = np.frombuffer(places, np.int32)[ids.offset:][split.offsets.to_numpy()].tolist()
        view = memoryview(packed) if packed else b""
        return [bytes(view[a:b]) for a, b in zip(at, at[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of each text."""
        out: list[bytes] = []
        waiting: list[bytes] = []
        self.waiting_bytes = 0

        def flush() -> None:
            out.extend(self.lookup(waiting))
            waiting.clear()
            self.waiting_bytes = 0

        for text in texts:
            if SPECIAL in text:
                flush()
                out.append(self.pack(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids))
                continue
            if not any(lead in text for lead in MARKS):
                text = text.lower()
            if len(text) > CHUNK:
                flush()
                out.append(b"".join(self.lookup([part])[0] for part in chunks(text)))
                continue
            waiting.append(text)
            self.waiting_bytes += len(text)
            if self.waiting_bytes > CHUNK:
                flush()
        flush()
        return out


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker process, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
