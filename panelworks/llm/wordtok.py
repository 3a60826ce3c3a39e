"""Word-level cache in front of a tokenizer whose words never span white space."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

GENERATION = 100_000  # two of them take about 50 MB of each Python worker
END = "\x01"
ODD_SPACE = re.compile(r"[^\S\n]")
_TOKENIZERS: dict = {}


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and moves the rest, in order, to U+0100 and up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Merger:
    """The tokenizer's own merges run by tiktoken, for words not seen lately.

    The end-of-word suffix becomes the byte 1, glued to the last byte before any other merge.
    """

    def __init__(self, spec: dict):
        import regex
        import tiktoken

        model, letters = spec["model"], _byte_of_letter()
        suffix = model["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or model["type"] != "BPE" or not suffix:
            raise KeyError("another kind of tokenizer")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(letters[c] for c in (token[: -len(suffix)] if ends else token)) + b"\x01" * ends

        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b, 1]): 256 + b for b in range(256)}
        for pair in model["merges"]:
            token = raw("".join(pair.split(" ") if isinstance(pair, str) else pair))
            ranks.setdefault(token, len(ranks))
        self.to_id = np.zeros(len(ranks), np.uint32)
        self.newline = ranks[b"\n"]
        for token, i in model["vocab"].items():
            if (r := ranks.get(raw(token) if all(c in letters for c in token.removesuffix(suffix)) else None)) is not None:
                self.to_id[r] = i
        self.bpe = tiktoken.Encoding("words", pat_str=r"[^\x01\n]+\x01|\n", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words joined by line ends, and each word's bounds among them (a line end takes one place).

        The words hold no other white space, no END and no capital sigma (whose lower case depends on its neighbours).
        """
        ranks = self.bpe.encode_to_numpy(self.words.sub("\\g<0>\x01", unicodedata.normalize("NFC", words).lower()))
        return self.to_id[ranks], np.concatenate(([-1], np.flatnonzero(ranks == self.newline), [len(ranks)]))


class CachedTokenizer:
    """Encodes texts as little-endian 16-bit ids (32-bit for larger vocabularies).

    Texts are cut at ASCII white space, which the tokenizer drops and never merges across; each distinct
    piece is encoded once while it stays in one of two cache generations, so memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.young, self.old = {b"": b""}, {}
        try:
            self.merger = _Merger(json.loads(self.tokenizer.to_str()))
        except (KeyError, TypeError):
            self.merger = None

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            text = b"\n".join(part).decode()
            if self.merger and END not in text and "Σ" not in text and not ODD_SPACE.search(text):
                ids, bounds = self.merger.encode(text)
                raw, at = ids.astype(self.dtype).tobytes(), (bounds * self.dtype.itemsize).tolist()
                step = self.dtype.itemsize
                self.young.update(zip(part, [raw[a + step : b] for a, b in zip(at, at[1:])]))
            else:
                for w in part:
                    word = w.decode()
                    # here only lower-casing can have made an added token; in capitals the library sees none and lower-cases it itself
                    self.young[w] = self._whole(word.upper() if self.added and self.added.search(word) else word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as the library gives them; texts that hold an added token go to the library as a whole."""
        odd = {i: self._whole(t) for i, t in enumerate(batch) if self.added and self.added.search(t)}
        if odd:
            batch = ["" if i in odd else t for i, t in enumerate(batch)]
        split = [(t.encode().lower() if t.isascii() else t.encode()).split() for t in batch]
        wanted = set().union(*split)
        new = [w for w in wanted if w not in self.young]
        self.young.update((w, self.old[w]) for w in new if w in self.old)
        self._learn([w for w in new if w not in self.young])
        get = self.young.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {b"": b""}
        return [odd.get(i, raw) for i, raw in enumerate(out)]


def tokenizer(path: str) -> CachedTokenizer:
    """One per Python worker and vocabulary file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]
