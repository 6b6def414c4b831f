"""Token ids of whole texts, by the pieces of a text between spaces and line ends.

The tokenizers this is for drop white space, never merge over it, and mark the end of a word in its last token, so
a piece's ids don't depend on its neighbours; a piece is encoded once and its ids are kept as bytes in a cache of
bounded size."""

from __future__ import annotations

import json

import numpy as np

#: Bytes of pieces, and of words, with their ids, that one generation keeps (ENTRY is what an entry costs besides them); what
#: the last generation had is taken over when it is met again. Longer pieces than LONG bytes are not kept: text without
#: blanks is one piece.
PIECE_BYTES, WORD_BYTES, ENTRY, LONG, TOGETHER = 120_000_000, 60_000_000, 160, 128, 500
MARKS = ".,;:!?"

_OPEN: dict = {}


class Encoder:
    """ids as bytes of little-endian unsigned integers of `width` bytes.

    Pieces of simple letters (below U+0250, whose lower case is one letter and which are composed), with one mark after
    them or none, are a word and a mark for the tokenizer. Such words are put in lower case here and encoded many at
    once by the same model without its normalizer and patterns, and told apart by the ids whose token ends a word. All
    other pieces are encoded each by the tokenizer itself."""

    def __init__(self, path: str, width: int = 4):
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.kind = Tokenizer.from_file(path), width, np.dtype(f"<u{width}")
        form = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "added_tokens": []}
        form["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.model = Tokenizer.from_str(json.dumps(form))
        if hasattr(self.model.model, "_resize_cache"):  # its own cache only costs time, as no word comes twice
            model = self.model.model
            model._resize_cache(0)
            self.model.model = model
        self.cache, self.old, self.words, self.old_words = {}, {}, {}, {}
        self.cache_bytes = self.word_bytes = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.marks = {m.encode(): ids.tobytes() for m, ids in zip(MARKS, self.many(self.tokenizer, list(MARKS)), strict=True)}

    def many(self, by, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in by.encode_batch_fast(texts, add_special_tokens=False)]

    def met(self, pieces: set) -> dict[bytes, bytes]:
        """ids of these pieces, which the cache didn't have; it keeps those that aren't long."""
        if self.cache_bytes > PIECE_BYTES:
            self.old, self.cache, self.cache_bytes = self.cache, {}, 0
        if self.word_bytes > WORD_BYTES:
            self.old_words, self.words, self.word_bytes = self.words, {}, 0
        out, old, words, old_words, marks = {}, self.old, self.words, self.old_words, self.marks
        waiting, new, odd = [], {}, []
        for piece in pieces:
            ids = old.get(piece)
            if ids is not None:
                out[piece] = ids
                continue
            word, mark = piece, b""
            if piece[-1:] in marks:
                word, mark = piece[:-1], marks[piece[-1:]]
            if word.isalpha():
                word = word.lower()
            else:
                letters = word.decode()
                if not letters.isalpha() or max(letters) > "\u024f" or "\u0130" in letters:
                    odd.append(piece)
                    continue
                word = letters.lower().encode()
            ids = words.get(word)
            if ids is None:
                ids = old_words.get(word)
                if ids is None:
                    new[word] = None
                    waiting.append((piece, word, mark))
                    continue
                words[word] = ids
                self.word_bytes += len(word) + len(ids) + ENTRY
            out[piece] = ids + mark
        words_now = list(new)
        for at in range(0, len(words_now), 64 * TOGETHER):
            parts = [words_now[i : i + TOGETHER] for i in range(at, min(len(words_now), at + 64 * TOGETHER), TOGETHER)]
            for part, got in zip(parts, self.many(self.model, [b" ".join(p).decode() for p in parts]), strict=True):
                ends = np.flatnonzero(self.ends[got]) + 1
                if len(ends) != len(part) or ends[-1] != len(got):
                    raise ValueError("this tokenizer doesn't mark the end of each word")
                raw, begin = got.tobytes(), 0
                for word, end in zip(part, (ends * self.width).tolist(), strict=True):
                    new[word] = raw[begin:end]
                    begin = end
        for piece, word, mark in waiting:
            out[piece] = new[word] + mark
        for at in range(0, len(odd), 4096):
            for piece, got in zip(odd[at : at + 4096], self.many(self.tokenizer, [p.decode() for p in odd[at : at + 4096]]), strict=True):
                out[piece] = got.tobytes()
        self.word_bytes += self._keep(words, new)
        self.cache_bytes += self._keep(self.cache, out)
        return out

    def _keep(self, cache: dict, found: dict) -> int:
        """Puts what isn't long into a cache; bytes that it takes at most, as each id stands for a byte or more."""
        if max(map(len, found), default=0) > LONG:
            found = {k: ids for k, ids in found.items() if len(k) <= LONG}
        cache.update(found)
        return (1 + self.width) * sum(map(len, found)) + ENTRY * len(found)

    def encode(self, texts: list) -> list[bytes]:
        """ids of each text (UTF-8 bytes or a string); null is empty."""
        out = []
        for at in range(0, len(texts), 128):
            pieces, ends = [], [0]
            for t in texts[at : at + 128]:
                if t:
                    pieces += (t if isinstance(t, bytes) else t.encode()).split()  # at ASCII white space
                ends.append(len(pieces))
            got = list(map(self.cache.get, pieces))
            missing = [i for i, ids in enumerate(got) if ids is None]
            if missing:
                found = self.met({pieces[i] for i in missing})
                for i in missing:
                    got[i] = found[pieces[i]]
            out += [b"".join(got[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        return out


def encoder(path: str, width: int = 4) -> Encoder:
    """One for each worker."""
    if (path, width) not in _OPEN:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _OPEN[path, width] = Encoder(path, width)
    return _OPEN[path, width]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
