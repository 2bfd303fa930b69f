"""Token counts by compiled finite-state transducers.

A byte-level BPE file is compiled to two deterministic transducers. The first marks where pre-tokens start; its rules
look at bounded neighbourhoods of character classes, so it runs over a whole block at once. The second reads bytes and
is reset at each mark. Its state is what decides the future: the candidates for a token that began at some earlier
byte (trie node, token before it, tokens up to there). A byte moves all candidates on; exactly one of those that
complete a token continues the only valid encoding (adjacent tokens of a valid encoding are those that merging their
own bytes leaves apart), and the transition is annotated with the tokens that the prefix gained. States are
determinised as texts need them and kept in a table of bounded size, which starts over when it is full.

A block is cut into chunks of equal length. A chunk's state map takes the state before it to the state after it and the
tokens gained on the way. With a mark in the chunk the map is a constant from there on; all such chunks run at once.
Maps of chunks without a mark are tabulated by content and entry state as the scan asks for them, all chunks of a
round at once: the scan composes what it has, guesses the exit of a chunk whose map lacks an entry, and goes on from
there; states forget their past after some bytes, so that a few rounds settle a long text without a mark, and chunks of
equal content share a map. Heads, the bytes before a chunk's first mark, then run from the exits of the chunks before.

Null or empty text: no bytes, no tokens. A very long text is a block of its own. Ties can't arise. Repeated rows are
counted each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import cut, documents, map_arrow, table, text_bytes
from gridloom.llm.tokenizing import byte_letters, tokenizer_path

LIMIT = 1024
CHUNK = 256
#: States that a worker keeps; a state takes about half a kilobyte.
MOST_STATES = 150_000
LETTER, NUMBER, SPACE, WHITE, OTHER = range(5)
UNKNOWN, ROOT = 0, 1


@lru_cache(1)
def class_runs() -> bytes:
    """The classes of all code points as the library's own patterns see them, by run: first code points, then classes.
    Planes without assigned characters, and those for private use, hold others alone."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(sys.maxunicode + 1) if c >> 16 in (0, 1, 2, 3, 14) and not 0xD800 <= c < 0xE000]
    text, code = "".join(map(chr, points)), np.array(points)
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[code[a:b]] = kind
    out[0x20] = SPACE
    first = np.flatnonzero(np.append(True, out[1:] != out[:-1]))
    return first.astype("<i4").tobytes() + out[first].tobytes()


def classes(runs: bytes) -> np.ndarray:
    """The class of every code point."""
    n = len(runs) // 5
    first = np.frombuffer(runs, "<i4", n)
    return np.repeat(np.frombuffer(runs, np.uint8, n, 4 * n), np.diff(np.append(first, sys.maxunicode + 1)))


def marks(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, by byte."""
    lead = (raw & 0xC0) != 0x80
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes[points]
    n = len(points)
    at = np.flatnonzero(lead)
    edge = np.zeros(n + 1, bool)  # the first of a text, or past the last text
    edge[np.searchsorted(at, offsets)] = True
    blank = (kind == SPACE) | (kind == WHITE)
    start = edge[:n].copy()
    before, here = kind[:-1], kind[1:]
    inner = ~edge[1:n]
    word = ~blank[1:] & inner
    start[1:] |= word & (before != SPACE) & (before != here)
    gap = blank[1:] & inner
    next_word = np.zeros(n, bool)  # something other than white space follows in the same text
    next_word[:-1] = ~blank[1:] & ~edge[1:n]
    start[1:] |= gap & (~blank[:-1] | next_word[1:])
    quote = np.flatnonzero((points == ord("'")) & start)
    if len(quote):
        padded = np.append(points, [0, 0])
        one = padded[quote + 1]
        two = padded[quote + 2]
        end = np.append(edge, [True, True])
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~end[quote + 1]
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        pair &= ~end[quote + 1] & ~end[quote + 2]
        start[quote[short | pair] + 1] = False
        for then in (quote[short] + 2, quote[pair] + 3):
            start[then[then < n]] = True
    out = np.zeros(len(raw), bool)
    out[at[start]] = True
    return out


class Transducer:
    def __init__(self, path: str, runs: bytes):
        self.classes = classes(runs)
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        spell = {t: bytes(back[c] for c in t) for t in vocab}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: its two parts and the rule's rank
        self.rank: dict[tuple[int, int], int] = {}
        for r, rule in enumerate(model["merges"]):
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            self.rank.setdefault((vocab[a], vocab[b]), r)
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.move: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, i in vocab.items():
            if len(spell[t]) > 1 and i not in self.parts:
                continue  # no rule makes it
            node = 0
            for byte in spell[t]:
                if byte not in self.move[node]:
                    self.move[node][byte] = len(self.move)
                    self.move.append({})
                    self.token.append(-1)
                node = self.move[node][byte]
            self.token[node] = i
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_bytes = [s.encode() for s in self.special]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.apart: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(), ((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.states[1]: ROOT}
        self.columns = np.full(256, -1, np.int64)
        self.wide = 128
        self.used = 0
        self.next = np.full(4096 * self.wide, -1, np.int32)
        self.next[: self.wide] = UNKNOWN << 8 | 128

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols at one end of a token while it is merged, and the rank that ends each."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.parts[token][2]
            token = self.parts[token][side]

    def valid(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens leaves the two apart."""
        known = self.apart.get((a, b))
        if known is None:
            left = self.spine(b, 0)
            known = not any((r := self.rank.get((x, y))) is not None and r < x_ends and r <= y_ends for x, x_ends in self.spine(a, 1) for y, y_ends in left)
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            self.apart[a, b] = known
        return known

    def compile(self, state: int, byte: int) -> int:
        """The transition as ``next state << 8 | tokens gained + 128``."""
        moved, done = [], None
        for node, before, count in self.states[state]:
            node = self.move[node].get(byte)
            if node is None:
                continue
            token = self.token[node]
            if token >= 0 and (before < 0 or self.valid(before, token)):
                if done is not None:
                    raise AssertionError("two encodings of one prefix")
                done = (0, token, count + 1)
            if self.move[node]:
                moved.append((node, before, count))
        gained = done[2]
        key = tuple(sorted((n, b, c - gained) for n, b, c in [*moved, done]))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            if len(self.states) * self.wide > len(self.next):
                self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
        return number << 8 | gained + 128

    def column(self, raw: np.ndarray) -> np.ndarray:
        """The table's column of each byte; columns are given out as bytes turn up."""
        for b in np.flatnonzero(np.bincount(raw, minlength=256)):
            if self.columns[b] < 0:
                if self.used == self.wide:
                    grown = np.full((len(self.next) // self.wide, 256), -1, np.int32)
                    grown[:, : self.wide] = self.next.reshape(-1, self.wide)
                    grown[UNKNOWN] = UNKNOWN << 8 | 128
                    self.next, self.wide = grown.reshape(-1), 256
                self.columns[b] = self.used
                self.used += 1
        return self.columns[raw]

    def step(self, state: np.ndarray, column: np.ndarray, byte: np.ndarray) -> np.ndarray:
        at = state * self.wide + column
        got = self.next[at]
        missing = np.flatnonzero(got < 0)
        if len(missing):
            for where in np.unique(at[missing]).tolist():
                made = self.compile(where // self.wide, self.byte_of[where % self.wide])  # may move the table
                self.next[where] = made
            got = self.next[at]
        return got

    def gains(self, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Tokens gained at each byte."""
        if len(self.states) > MOST_STATES:
            self.reset()
        column = self.column(raw)
        self.byte_of = {int(c): b for b, c in enumerate(self.columns) if c >= 0}
        n = len(raw)
        lanes = -(-n // CHUNK)
        fill = lanes * CHUNK - n
        shape = lambda x: np.ascontiguousarray(np.append(x, np.zeros(fill, x.dtype)).reshape(lanes, CHUNK).T)
        columns, bytes_, fresh = shape(column), shape(raw), shape(start)
        gained = np.zeros((CHUNK, lanes), np.int16)
        state = np.zeros(lanes, np.int64)
        for k in range(CHUNK):
            state[fresh[k]] = ROOT
            got = self.step(state, columns[k], bytes_[k])
            gained[k] = (got & 255) - 128
            state = (got >> 8).astype(np.int64)
        marked = fresh.any(0)
        self._compose(np.flatnonzero(~marked), state, gained, columns, bytes_)
        head = np.where(marked, fresh.argmax(0), 0)
        lane = np.flatnonzero(head)
        now = state[lane - 1]  # a block begins with a mark
        for k in range(int(head.max(initial=0))):
            going = head[lane] > k
            lane, now = lane[going], now[going]
            got = self.step(now, columns[k][lane], bytes_[k][lane])
            gained[k][lane] = (got & 255) - 128
            now = (got >> 8).astype(np.int64)
        return gained.T.reshape(-1)[:n]

    def _compose(self, lanes: np.ndarray, state: np.ndarray, gained: np.ndarray, columns: np.ndarray, bytes_: np.ndarray) -> None:
        """Exits and gains of the chunks without a mark, from the exits of those with one."""
        number: dict[bytes, int] = {}
        content = {lane: number.setdefault(bytes_[:, lane].tobytes(), len(number)) for lane in lanes.tolist()}
        maps: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        state[lanes] = ROOT
        while True:
            asked: dict[tuple[int, int], int] = {}
            entry = {}
            for lane in content:
                key = entry[lane] = content[lane], int(state[lane - 1])
                if key in maps:
                    state[lane] = maps[key][0]
                else:
                    asked.setdefault(key, lane)
            if not asked:
                break
            at, now = np.array(list(asked.values())), np.array([e for _, e in asked])
            gains = np.zeros((len(at), CHUNK), np.int16)
            for k in range(CHUNK):
                got = self.step(now, columns[k][at], bytes_[k][at])
                gains[:, k] = (got & 255) - 128
                now = (got >> 8).astype(np.int64)
            for key, to, gain in zip(asked, now.tolist(), gains):
                maps[key] = to, gain
        for lane, key in entry.items():
            gained[:, lane] = maps[key][1]

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        if not len(raw):
            return np.zeros(len(offsets) - 1, np.int64)
        text = raw.tobytes()
        if any(s in text for s in self.special_bytes):
            return self._with_specials(text, offsets)
        sums = np.concatenate([[0], np.cumsum(self.gains(raw, marks(raw, offsets, self.classes)), dtype=np.int64)])
        return np.diff(sums[offsets])

    def _with_specials(self, text: bytes, offsets: np.ndarray) -> np.ndarray:
        """Special strings are tokens of their own; what is between them is counted apart."""
        parts, owner = [], []
        extra = np.zeros(len(offsets) - 1, np.int64)
        for r in range(len(offsets) - 1):
            pieces = self.cut.split(text[offsets[r] : offsets[r + 1]].decode())
            extra[r] = len(pieces) - 1
            parts += [p.encode() for p in pieces]
            owner += [r] * len(pieces)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        if not len(raw):
            return extra
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        sums = np.concatenate([[0], np.cumsum(self.gains(raw, marks(raw, ends, self.classes)), dtype=np.int64)])
        return extra + np.bincount(owner, np.diff(sums[ends]), len(extra)).astype(np.int64)


@lru_cache(2)
def transducer(path: str, runs: bytes) -> Transducer:
    return Transducer(path, runs)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    runs = class_runs()

    def run(batch: pa.RecordBatch):
        raw, offsets = text_bytes(batch.column("text"))
        yield {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(offsets), "n_tokens": transducer(path, runs).counts(raw, offsets)}

    return map_arrow(documents(docs), run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
