"""A public BPE vocabulary with word ends, as read from its file, and the text preparation that its file names."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import regex

#: Results that a memory of results keeps in each of two generations, and the longest key that it keeps one for: both bound its bytes.
REMEMBERED, LONGEST = 200_000, 64
#: Pre-tokens up to this many letters are merged by rescanning, longer ones through a heap.
SHORT = 24
#: What counts as white space to the file's patterns. str.split() also takes \x1c to \x1f.
_WHITE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ODD_WHITE = regex.compile("[\\x1c-\\x1f]")
#: The pattern that the vocabulary's file gives for pre-tokens.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(free)) for b in range(256)]


LETTERS = byte_letters()


class Vocabulary:
    """ids by token, merge ranks by pair of ids, the pair that each token was merged from, and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = max(*self.ids.values(), *self.special.values()) + 1
        self.tokens = [""] * n
        for t, i in (*self.ids.items(), *self.special.items()):
            self.tokens[i] = t
        self.pairs: dict[tuple[int, int], int] = {}
        self.split = [(i, i) for i in range(n)]
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            key, made = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.pairs.setdefault(key, made)
            if self.split[made] == (made, made):
                self.split[made] = key
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def segments(self, text: str):
        """Pieces of the text as (piece, id of the special string that it is, or None)."""
        if not any(s in text for s in self.special):
            yield text, None
            return
        for piece in self.cut.split(text):
            if piece:
                yield piece, self.special.get(piece)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The runs between white space of a text without special strings, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case goes character by character, whatever stands at a word's end
                text = text.replace("Σ", "σ")
        text = text.lower()
        return [c for c in _WHITE.split(text) if c] if _ODD_WHITE.search(text) else text.split()

    @staticmethod
    def parts(chunk: str) -> list[str]:
        return _PARTS.findall(chunk)

    @staticmethod
    def spelled(part: str) -> str:
        """The part's bytes as letters of the vocabulary."""
        return "".join(map(LETTERS.__getitem__, part.encode("utf-8", "surrogatepass")))

    def merged(self, spelled: str) -> list[int]:
        """The ids of one pre-token by its merges: lowest rank first, leftmost on ties."""
        ids, pairs, never = self.ids, self.pairs, 1 << 30
        row = [ids[c] for c in spelled[:-1]] + [ids[spelled[-1] + self.end]]
        if len(row) > SHORT:
            return self._merged_long(row)
        while len(row) > 1:
            ranks = [pairs.get(p, never) for p in zip(row, row[1:])]
            rank = min(ranks)
            if rank == never:
                break
            at = ranks.index(rank)
            row[at : at + 2] = [rank]
        return row

    def _merged_long(self, row: list[int]) -> list[int]:
        """The same merges over a linked list and a heap: n log n in the length."""
        pairs, n = self.pairs, len(row)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p], i) for i, p in enumerate(zip(row, row[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if row[i] < 0 or j == n or pairs.get((row[i], row[j])) != rank:
                continue  # one of the two has been merged since
            row[i], row[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (made := pairs.get((rank, row[k]))) is not None:
                    heapq.heappush(heap, (made, i))
            h = before[i]
            if h >= 0 and (made := pairs.get((row[h], rank))) is not None:
                heapq.heappush(heap, (made, h))
        return [x for x in row if x >= 0]

    @functools.cached_property
    def singles(self) -> dict[str, int]:
        """The spelled pre-tokens that are proven to encode as one token, by running the merges of each such vocabulary string."""
        whole = ((t.removesuffix(self.end), i) for t, i in self.ids.items() if t.endswith(self.end))
        return {t: i for t, i in whole if self.merged(t) == [i]}


class Memory(dict):
    """Results by key, made when first asked for. Of two generations the older one is forgotten; results of long keys are not kept."""

    def __init__(self, make, most: int = REMEMBERED, longest: int = LONGEST):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > self.longest:
                return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
