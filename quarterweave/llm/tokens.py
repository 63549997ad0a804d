"""Public tokenizers over documents: token counts by field, byte-level encoding by merge replay, coded id files.

Texts are cut where no token can reach across, and what a piece encodes to is remembered in a table that forgets
everything when it is full, so memory is bounded whatever the corpus.
"""

from __future__ import annotations

import base64
import gc
import heapq
from array import array
from functools import cache
from operator import attrgetter

import numpy as np
import public_tokenizers
import regex

WORD_BPE, BYTE_RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS_REMEMBERED = 700_000
#: Unicode white space; libraries differ on U+001C..1F, which are none.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]")
_ODD_SPACE = regex.compile(r"[\t\x0b\x0c\r\x85\xa0  -     　]")


@cache
def byte_alphabet() -> dict[int, str]:
    """Byte to the character that stands for it in byte-level vocabularies: printable ones are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe(dict):
    """Piece without blanks to its ids as little-endian unsigned 32-bit integers, by the tokenizers library."""

    def __init__(self, path: str = WORD_BPE):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.table = byte_alphabet()
        self.before: dict[str, bytes] = {}
        self.limit = WORDS_REMEMBERED

    def forget(self) -> None:
        self.clear()
        self.before = {}

    def __missing__(self, piece: str) -> bytes:
        value = self.before.get(piece)
        if value is None:
            # Below U+0250 nothing composes or changes length, so plain lower-casing is the vocabulary's normal form.
            # What may hold `<|endoftext|>` or its like goes to the library, which has ids of their own for them.
            plain = "<|" not in piece and (piece.isascii() or max(piece) < "\u0250" and "\u0130" not in piece)
            if plain and piece.isalpha():
                low = piece.lower()
                value = self[low] if low != piece else self._merged(piece)
            elif plain and len(piece) > 1 and piece[-1] in ".,!?;:" and piece[:-1].isalpha():
                value = self[piece[:-1]] + self[piece[-1]]
            elif plain and piece.isprintable():
                value = b"".join(map(self._merged, self.split(piece.lower())))
            else:
                value = array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(self) > self.limit:  # what was asked for since the last time stays at hand
            self.before = self.copy()
            self.clear()
        self[piece] = value
        return value

    def _merged(self, word: str, id_of=attrgetter("id")) -> bytes:
        form = word if word.isascii() else word.encode().decode("latin1").translate(self.table)
        return array("I", map(id_of, self.model.tokenize(form))).tobytes()

    def ids(self, text: str) -> bytes:
        """Blanks separate tokens and make none, so what lies between them is encoded by itself."""
        return b"".join([self[p] for p in text.replace("\n", " ").split(" ") if p])


@cache
def word_bpe(path: str = WORD_BPE) -> WordBpe:
    """One for each Python worker and vocabulary. Its tables hold no cycles, so the collector need not walk them often."""
    gc.set_threshold(200_000, 20, 100)
    return WordBpe(path)


def read_ranks(path: str = BYTE_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pieces_of(text: str, pattern=regex.compile(PATTERN)) -> list[str]:
    return pattern.findall(text)


class MergeReplay:
    """Byte-level BPE by replaying merges over many words at once.

    An inverted index holds, for each pair of neighbouring tokens that merges, the positions where it stands. Ranks
    are taken in ascending order from a heap; all positions of a rank merge together, and only their neighbours' pairs
    enter the index anew. A word in which a merge makes a pair of lower rank than its own is encoded by itself.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():  # every way to make a token of two
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged token, -1 where the pair merges to none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def one(self, word: bytes) -> list[int]:
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray | None] = [None if (r := self.ranks.get(w)) is None else np.array([r], np.uint32) for w in words]
        todo = [k for k, ids in enumerate(out) if ids is None and words[k]]
        if not todo:
            return [np.zeros(0, np.uint32) if x is None else x for x in out]
        sizes = np.array([len(words[k]) for k in todo])
        token = self.of_byte[np.frombuffer(b"".join([words[k] for k in todo]), np.uint8)]
        n = len(token)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(todo), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = n
        before[ends - sizes] = -1
        alive = np.ones(n, bool)
        odd = np.zeros(len(todo), bool)
        index: dict[int, tuple[list[np.ndarray], list[int]]] = {}  # places of a rank, by the array and one by one
        heap: list[int] = []
        pairs = self.pairs

        def of(rank: int) -> tuple[list[np.ndarray], list[int]]:
            if (at := index.get(rank)) is None:
                at = index[rank] = ([], [])
                heapq.heappush(heap, rank)
            return at

        def enter(places: np.ndarray, current: int) -> None:
            rank = self.rank_of(token[places], token[after[places]])
            odd[word[places[(rank >= 0) & (rank < current)]]] = True
            places, rank = places[rank >= 0], rank[rank >= 0]
            if len(rank):
                order = np.argsort(rank, kind="stable")
                places, rank = places[order], rank[order]
                first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
                for r, group in zip(rank[first].tolist(), np.split(places, first[1:]), strict=True):
                    of(r)[0].append(group)

        def enter_one(p: int, q: int, current: int) -> None:
            rank = pairs.get(int(token[p]) << 32 | int(token[q]))
            if rank is not None:
                if rank < current:
                    odd[word[p]] = True
                of(rank)[1].append(p)

        enter(np.flatnonzero(after < n), -1)
        while heap:
            rank = heapq.heappop(heap)
            groups, single = index.pop(rank)
            if len(single) + sum(map(len, groups)) <= 24:  # few places: arrays cost more than they save
                for p in sorted({*single, *(p for g in groups for p in g.tolist())}):
                    q = int(after[p])
                    if not alive[p] or q >= n or pairs.get(int(token[p]) << 32 | int(token[q])) != rank:
                        continue
                    r, left = int(after[q]), int(before[p])
                    token[p], alive[q], after[p] = rank, False, r
                    if r < n:
                        before[r] = p
                        enter_one(p, r, rank)
                    if left >= 0:
                        enter_one(left, p, rank)
                continue
            at = np.unique(np.concatenate([*groups, np.array(single, np.int64)]))
            at = at[alive[at] & (after[at] < n)]
            at = at[self.rank_of(token[at], token[after[at]]) == rank]
            if not len(at):
                continue
            if (after[at[:-1]] == at[1:]).any():  # runs of one token merge from the left
                taken, free = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != free:
                        taken.append(p)
                        free = q
                at = np.array(taken)
            gone = after[at]
            token[at] = rank
            alive[gone] = False
            after[at] = after[gone]
            open_ = at[after[at] < n]
            before[after[open_]] = open_
            left = before[at]
            enter(np.unique(np.concatenate([left[left >= 0], open_])), rank)
        kept = np.flatnonzero(alive)
        cuts = np.searchsorted(word[kept], np.arange(1, len(todo)))
        for k, ids, strange in zip(todo, np.split(token[kept].astype(np.uint32), cuts), odd.tolist(), strict=True):
            out[k] = np.array(self.one(words[k]), np.uint32) if strange else ids
        return [np.zeros(0, np.uint32) if x is None else x for x in out]


class ByteBpe:
    """Encodes texts in batches; pieces of a text that recur are looked up, all new ones of a batch are replayed together."""

    def __init__(self, path: str = BYTE_RANKS):
        self.replay = MergeReplay(read_ranks(path))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @staticmethod
    def keys(text: str) -> list[str]:
        """A text as parts that encode alone. A cut before a blank that follows a word is safe, as no match of the
        pattern goes from a word into a blank. A part that starts with a line feed, or with NUL, stands for itself without
        that NUL; every other part for itself after a blank."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n") or "\0" in text or _ODD_SPACE.search(text):
            return ["\0" + p for p in pieces_of(text)]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    @staticmethod
    def literal(key: str) -> str:
        return key[1:] if key.startswith("\0") else key if key.startswith("\n") else " " + key

    def learn(self, texts: list[str]) -> None:
        """Encodes all parts of these texts that are not known yet, together. When the table is full, parts that these texts
        and those before them did not ask for are forgotten."""
        if len(self.known) > WORDS_REMEMBERED:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new: set[str] = set()
        for text in texts:
            new.update([k for k in self.keys(text) if k not in known])
        known.update([(k, before[k]) for k in new if k in before])
        todo = [k for k in new if k not in before]
        for at in range(0, len(todo), 300_000):
            keys = todo[at : at + 300_000]
            split = [[p.encode() for p in pieces_of(self.literal(k))] for k in keys]
            words = list(dict.fromkeys(p for parts in split for p in parts))
            ids = {w: x.astype("<u4").tobytes() for w, x in zip(words, self.replay.encode(words), strict=True)}
            known.update((k, b"".join([ids[p] for p in parts])) for k, parts in zip(keys, split, strict=True))

    def ids(self, text: str) -> bytes:
        """Ids of a text that has been learnt, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.keys(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def byte_bpe(path: str = BYTE_RANKS) -> ByteBpe:
    gc.set_threshold(200_000, 20, 100)
    return ByteBpe(path)
