"""A byte-level BPE vocabulary file read once a worker, and exact token counts at every prefix.

The encoding of a prefix ends in exactly one token ``t`` such that ``t`` fits what the shorter prefix
ends in: two tokens fit if encoding their joined bytes gives them back. So one pass over a word's
bytes, keeping for each prefix its last token and its count, gives every prefix's exact count. New
words of a run of texts take this pass together, one prefix length after the other.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import islice

import numpy as np
import regex

#: The split pattern of this family of tokenizers (fixed value); white space as Unicode defines it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words remembered by a worker at most, and pairs of tokens; beyond it the older half goes (results stay exact).
MEMO_WORDS, MEMO_PAIRS = 300_000, 2_000_000
#: Bytes of words that take the pass together, and of one long word handled at a time.
LONG, SLICE = 48, 1 << 16


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in such vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones((2, 1), np.uint64)


def _sums(text: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes, modulo 2**64."""
    global _powers
    if _powers.shape[1] <= len(text):
        both = np.repeat(np.array([[_R], [pow(int(_R), -1, 1 << 64)]], np.uint64), len(text) + SLICE, axis=1)
        both[:, 0] = 1
        _powers = np.cumprod(both, axis=1, dtype=np.uint64)
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers[0, : len(text)], dtype=np.uint64, out=out[1:])
    return out


def _windows(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes (not 0) of the bytes from start to end; windows of equal bytes have equal ones."""
    h = (sums[end] - sums[start]) * _powers[1][start]
    return h + (h == 0)


def _steps(word: str) -> np.ndarray:
    """Where the word's characters end in its bytes."""
    if word.isascii():
        return np.arange(1, len(word) + 1)
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))


class Table:
    """A map of 64-bit keys (not 0) to small numbers, asked and filled by whole arrays."""

    def __init__(self, bits: int = 18):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is unknown."""
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not in it."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(max(self.bits, int(4 * len(keys)).bit_length()))
        self.n += len(keys)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = keys[free]  # of several that want one place one gets it
            won = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)


class Vocabulary:
    """Ids by token bytes, merge ranks by pair of ids, and the special strings of a vocabulary file."""

    def __init__(self, path: str):
        self.read(path)
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.letters = [self.ids[bytes([b])] for b in range(256)]
        self.words, self.blanks = regex.compile(WORDS), regex.compile(r"\p{White_Space}*")
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # only tokens that their own bytes encode to can stand in an encoding
        self.reachable = {t: i for t, i in self.ids.items() if self.encode(t) == [i]}
        self.longest = max(map(len, self.reachable))
        self.parts = {new: (a, b, rank) for (a, b), (rank, new) in self.merges.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs = Table()
        self.counts: dict[str, bytes] = {}
        self.totals: dict[str, int] = {}
        self.tokens = Table()
        text = np.frombuffer(b"".join(self.reachable), np.uint8)
        ends = np.cumsum([len(t) for t in self.reachable])
        starts = np.concatenate([[0], ends[:-1]])
        self.tokens.put(_windows(_sums(text), starts, ends), np.array(list(self.reachable.values()), np.int32))

    def read(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in self.special}
        self.merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = raw(a), raw(b)
            self.merges[self.ids[a], self.ids[b]] = rank, self.ids[a + b]

    def blank(self, word: str) -> int:
        """How many characters of white space, as Unicode defines it, a word begins with."""
        return self.blanks.match(word).end()

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word by merging the pair of least rank first."""
        ids = [self.letters[b] for b in word]
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 40, 0)) + (i,) for i, p in enumerate(zip(ids, ids[1:]))), key=lambda x: (x[0], x[2]))
            if best[0] == 1 << 40:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The parts of a token that stand at its right or left end while it is built, each with the rank that ends it."""
        known = self.edges[right].get(token)
        if known is None:
            known, part = [(token, float("inf"))], token
            while part in self.parts:
                left, other, rank = self.parts[part]
                part = other if right else left
                known.append((part, rank))
            self.edges[right][token] = known
        return known

    def fit(self, a: int, b: int) -> bool:
        """Whether encoding the joined bytes of two tokens gives them back.

        Until a merge crosses the border each side is built as it is alone. One crosses if two parts
        that stand at the border at one time have a merge that comes before either is merged inwards;
        of equal ranks the left place comes first.
        """
        get = self.merges.get
        for x, x_end in self.edge(a, True):
            for y, y_end in self.edge(b, False):
                merge = get((x, y))
                if merge is not None and merge[0] < x_end and merge[0] <= y_end:
                    return False
        return True

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`fit` of arrays of tokens; each pair is worked out once and remembered."""
        keys = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)
        found = self.pairs.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            pairs = (fresh - np.uint64(1)).tolist()
            values = np.array([self.fit(k >> 32, k & 0xFFFFFFFF) for k in pairs], np.int32)
            found[new] = values[back]
            if self.pairs.n + len(fresh) > MEMO_PAIRS:
                self.pairs = Table()
            self.pairs.put(fresh, values)
        return found > 0

    def word_counts(self, word: bytes) -> np.ndarray:
        """Exact token count of every byte prefix of one word, entry 0 being 0."""
        n, fit = len(word), lru_cache(1 << 16)(self.fit)
        last, count = [0] * (n + 1), [0] * (n + 1)
        sums = _sums(np.frombuffer(word, np.uint8))
        for lo in range(0, n, SLICE):
            stop = np.arange(lo + 1, min(lo + SLICE, n) + 1)
            met = []
            for length in range(1, min(self.longest, int(stop[-1])) + 1):
                ends = stop[stop >= length]
                token = self.tokens.get(_windows(sums, ends - length, ends))
                hit = np.flatnonzero(token >= 0)
                met.append(np.stack([ends[hit], np.full(len(hit), length), token[hit]]))
            rows = np.concatenate(met, axis=1)
            # longer tokens first: they are the likelier ones, and just one can stand at each end
            rows = rows[:, np.lexsort((-rows[1], rows[0]))]
            for end, length, token in zip(*rows.tolist(), strict=True):
                if not count[end] and (end == length or fit(last[end - length], token)):
                    last[end], count[end] = token, count[end - length] + 1
        return np.array(count, np.int64)

    def _together(self, words: list[str]) -> None:
        """Prefix counts of words of at most LONG bytes: for every prefix length, all words at a time."""
        data = [w.encode() for w in words]
        order = sorted(range(len(words)), key=lambda i: -len(data[i]))
        size = np.array([len(data[i]) for i in order])
        sums = _sums(np.frombuffer(b"".join(data[i] for i in order), np.uint8))
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        longest, n = int(size[0]), len(words)
        last, count = np.full((longest + 1, n), -1, np.int32), np.zeros((longest + 1, n), np.uint8)
        active = n - np.searchsorted(size[::-1], np.arange(longest + 1))  # words of at least so many bytes come first
        for end in range(1, longest + 1):
            m = int(active[end])
            at, open_ = base[:m], np.arange(m)
            for start in range(max(0, end - self.longest), end):  # longer tokens first
                token = self.tokens.get(_windows(sums, at[open_] + start, at[open_] + end))
                hit = np.flatnonzero(token >= 0)
                if start and len(hit):
                    hit = hit[self.fits(last[start, open_[hit]], token[hit])]
                if len(hit):
                    who = open_[hit]
                    last[end, who], count[end, who] = token[hit], count[start, who] + 1
                    open_ = np.delete(open_, hit)
                    if not len(open_):
                        break
        flat, width = np.ascontiguousarray(count.T).tobytes(), longest + 1
        for k, i in enumerate(order):
            c = flat[k * width : k * width + len(data[i]) + 1]
            self.counts[words[i]], self.totals[words[i]] = c, c[-1]

    def learn(self, words) -> None:
        """Prefix counts of new words; longer ones are not remembered."""
        if len(self.totals) + len(words) > MEMO_WORDS:
            self.totals = dict(islice(self.totals.items(), len(self.totals) // 2, None))
            self.counts = {w: self.counts[w] for w in self.totals}
        words = [w for w in words if len(w) <= LONG and len(w.encode()) <= LONG]
        for lo in range(0, len(words), 1 << 15):
            self._together(words[lo : lo + (1 << 15)])

    def of_word(self, word: str) -> np.ndarray:
        """Counts of a word's byte prefixes."""
        known = self.counts.get(word)
        return self.word_counts(word.encode()) if known is None else np.frombuffer(known, np.uint8).astype(np.int64)

    def pieces(self, text: str) -> list[str]:
        """The text cut at special strings, those included."""
        return [x for x in self.splitter.split(text) if x] if self.splitter and any(s in text for s in self.special) else [text] if text else []

    def totals_of(self, texts: list[str]) -> list[tuple[int, list[str] | None, np.ndarray | None]]:
        """(tokens, words, tokens of each word) of texts; words are None where special strings stand in a text."""
        found = [[(None if x in self.special else self.words.findall(x)) for x in self.pieces(t)] for t in texts]
        every = {w for pieces in found for words in pieces if words is not None for w in words}
        self.learn(every.difference(self.totals))
        self.learn(every.difference(self.totals))  # what went with the older half
        other = {w: int(self.of_word(w)[-1]) for w in every.difference(self.totals)}  # long words
        get = (self.totals if not other else {**{w: self.totals[w] for w in every if w in self.totals}, **other}).__getitem__
        out = []
        for pieces in found:
            sizes = [np.fromiter(map(get, words), np.int64, len(words)) for words in pieces if words is not None]
            n = sum(int(x.sum()) for x in sizes) + sum(words is None for words in pieces)
            plain = len(pieces) == 1 and pieces[0] is not None
            out.append((n, pieces[0], sizes[0]) if plain else (n, None, None))
        return out

    def total(self, text: str) -> int:
        """Token count of the whole text."""
        return self.totals_of([text])[0][0]

    def table(self, text: str) -> np.ndarray:
        """Exact token count of every code-point prefix of the text (length + 1 entries)."""
        out, base = [np.zeros(1, np.int64)], 0
        held = ""  # what stands before a special string since the last cut
        for piece in self.pieces(text):
            if piece in self.special:
                # a prefix ending inside a special string is ordinary text together with what precedes it
                start = base - self.total(held)
                inside = [start + self.total(held + piece[:k]) for k in range(1, len(piece))]
                base += 1
                out.append(np.array([*inside, base], np.int64))
                held = ""
                continue
            held, pos = piece, 0
            run, run_at, run_base = None, 0, base  # counts of the white space run that the prefix ends in
            for w in self.words.findall(piece):
                counts = self.of_word(w)
                own = base + counts[_steps(w)]
                blank = self.blank(w)
                if blank:
                    if run is None:
                        # a prefix that ends inside a run of white space has all of it so far as one word
                        space = piece[pos : self.blanks.match(piece, pos).end()]
                        run, run_at, run_base = self.of_word(space)[_steps(space)], pos, base
                    own[:blank] = run_base + run[pos - run_at : pos - run_at + blank]
                if blank < len(w):
                    run = None
                if len(w) == 3 and w in ("'re", "'ve", "'ll"):
                    own[1] = base + 2  # without its last letter it is a mark and a letter
                out.append(own)
                base += int(counts[-1])
                pos += len(w)
        return np.concatenate(out)

    def within(self, text: str, budget: int) -> int:
        """The most code points of the text whose prefix takes at most *budget* tokens, without encoding again."""
        return int(np.flatnonzero(self.table(text) <= budget)[-1])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One a worker and file."""
    return Vocabulary(path)
