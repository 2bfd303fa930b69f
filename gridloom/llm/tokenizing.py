"""Token ids of whole texts, equal to those of the ``tokenizers`` library, fast enough for a corpus.

``Encoder`` cuts a text at white space where no token can cross, and keeps the ids of the words it has met; words it
has not met are encoded by the library. The cache is bounded, by the number of words and by their length, and has two
generations: when the younger is full, it becomes the elder, so words that keep turning up stay.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Words that a worker keeps in a generation, and the letters of the longest one that is kept.
CACHE_WORDS, CACHE_LETTERS = 200_000, 64
#: White space to the library, and what only Python takes for it. A cut is before white space after something else.
WHITE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
ODD = re.compile("[\x1c-\x1f᠎​﻿]")
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Encoder:
    """``ids(text)``: the library's ids as little-endian bytes of the narrowest type that holds the vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # Where words are split at white space that is dropped, the space before a word doesn't count.
        self.drops_space = not self.library.encode(" \n ", add_special_tokens=False).ids
        self.model = self.library.model if self._plain_words(path) else None
        self.letters = dict(enumerate(byte_letters()))
        self.kept = Kept(self, {})
        # Only special tokens with white space inside could cross a cut.
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = [s for s in specials if re.search(r"\s", s)]

    #: The one split that ``word`` knows, and the same for words of ASCII letters in lower case.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ASCII_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

    def _plain_words(self, path: str) -> bool:
        """Whether the file is a word BPE: lower-cased NFC, split as above, words merged as bytes with an end mark."""
        import json

        spec = json.loads(open(path, encoding="utf-8").read())
        steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": self.SPLIT} and cuts[-1].get("use_regex") is False and self.drops_space

    def word(self, word: str) -> list[int] | None:
        """Ids of a word by the library's merge model alone, where what comes before it is sure: ASCII, or Latin letters."""
        if "<|" in word:
            return None
        if word.isascii():
            parts = self.ASCII_SPLIT.findall(word.lower())
            if not word.isprintable():
                parts = [p.translate(self.letters) for p in parts]
        elif max(word) < "\u0250" and "\u0130" not in word and (alpha := word.rstrip(".,")).isalpha():
            tail = word[len(alpha) :]
            parts = [alpha.lower().encode().decode("latin-1").translate(self.letters), *([tail] if tail else [])]
        else:
            return None
        return [t.id for p in parts for t in self.model.tokenize(p)]

    def whole_text(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def pieces(self, text: str) -> list[str] | None:
        if ODD.search(text) or any(s in text for s in self.whole):
            return None
        return text.split() if self.drops_space else PIECE.findall(text)

    def many(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            cut = self.pieces(text)
            out.append(self.whole_text(text) if cut is None else b"".join(map(self.kept.__getitem__, cut)))
        return out


class Kept(dict):
    """Ids of the words met: a word that isn't here comes from the elder generation, or is encoded."""

    def __init__(self, encoder: Encoder, elder: dict[str, bytes]):
        super().__init__()
        self.encoder, self.elder = encoder, elder

    def __missing__(self, word: str) -> bytes:
        found = self.elder.get(word)
        if found is None:
            ids = self.encoder.word(word) if self.encoder.model is not None else None
            found = self.encoder.whole_text(word) if ids is None else np.array(ids, self.encoder.dtype).tobytes()
        if len(word) <= CACHE_LETTERS:
            if len(self) >= CACHE_WORDS:
                self.elder = dict(self)
                self.clear()
            self[word] = found
        return found


class RankEncoder:
    """Ids of a byte-level BPE file of the library, from its vocabulary and split pattern, by tiktoken's merge loop.

    The file's merges must be in the order of its ids (checked), so merging by lowest id is merging by first rule. Special
    strings in a text are taken as the library's default takes them: each is its own token. Texts with runs of white
    space that the loop's pattern can't go back over are left to the library.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import json

        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        level = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or level["type"] != "ByteLevel" or level["add_prefix_space"] or spec["normalizer"] or spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.engine = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        merges = [rule.split(" ") if isinstance(rule, str) else rule for rule in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"{path}: its merges are not in the order of its ids")
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.special = frozenset(special)
        self.path = path

    LONG_GAP = re.compile(r"\s{20000}")

    def one(self, text: str) -> np.ndarray:
        if len(text) > 20_000 and self.LONG_GAP.search(text):
            return np.frombuffer(encoder(self.path).whole_text(text), encoder(self.path).dtype).astype(np.uint32)
        return self.engine.encode_to_numpy(text, allowed_special=self.special)


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself where it prints, else the next from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
    return Encoder(path)


@lru_cache(4)
def rank_encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
