"""Encoding whole texts with a public tokenizer, a distinct word at a time."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from reliefspark.llm.common import held

#: The default vocabulary: its tokens never cross white space, so a text's ids are its words' ids in a row.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words, and words without closing marks, that a worker keeps in each of two generations (results don't depend on it).
WORDS, CORES = 150_000, 250_000
#: Marks that the vocabulary never joins with a letter before them.
MARKS = ".,!?;:%$&*#|"
#: Characters at which Python splits words, but which the tokenizers take for marks.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class Memory:
    """A dictionary of bounded size: when the young generation is full, it becomes the old one and the old one goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def age(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young

    def known(self, word: str) -> bool:
        if word in self.young:
            return True
        if (ids := self.old.get(word)) is not None:
            self.young[word] = ids
            return True
        return False


class WordEncoder:
    """Ids of texts by a tokenizer that folds case and drops white space; a repeated word costs a look-up."""

    def __init__(self, path: str = VOCABULARY):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words, self.cores = Memory(WORDS), Memory(CORES)

    def _encode(self, words: list[str]) -> None:
        """Puts the ids of words into cores; words of letters alone are encoded in one go."""
        plain = [w for w in words if w.isalpha()]
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            at = np.array(e.word_ids, dtype=np.int64)
            ends = np.flatnonzero(np.diff(at, append=-1)) + 1
            if len(ends) != len(part):  # letters that the tokenizer's rules take apart
                plain = plain[:k]
                break
            data = np.array(e.ids, "<u4").tobytes()
            start = 0
            for word, end in zip(part, (ends * 4).tolist()):
                self.cores.young[word] = data[start:end]
                start = end
        rest = [w for w in words if w not in self.cores.young]
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.cores.young[word] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        odd = {k: t for k, t in enumerate(texts) if any(c in t for c in SEPARATORS)}
        if odd:
            plain = iter(self.encode([t for k, t in enumerate(texts) if k not in odd]))
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if k in odd else next(plain) for k, t in enumerate(texts)]
        # capital sigma and dotted capital I lower-case by context in Python, but not in the tokenizer
        split = [(t if "Σ" in t or "İ" in t else t.lower()).split() for t in texts]
        self.words.age()
        self.cores.age()
        new = [w for w in set().union(*split) if not self.words.known(w)]
        parts = []
        for w in new:
            core = w.rstrip(MARKS)
            # small letters of a dotted capital I end in a combining dot, which marks may join
            parts.append((core, w[len(core) :]) if core and core[-1].isalpha() and "İ" not in w else (w, ""))
        self._encode(list({p for pair in parts for p in pair if p and not self.cores.known(p)}))
        cores, get = self.cores.young, self.words.young
        for w, (core, marks) in zip(new, parts):
            get[w] = cores[core] + cores[marks] if marks else cores[core]
        return [b"".join([get[w] for w in words]) for words in split]


def encoder(path: str = VOCABULARY) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    return held(f"encoder {path}", lambda: WordEncoder(path))
