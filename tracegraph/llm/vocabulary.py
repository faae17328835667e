"""A fixed public SentencePiece vocabulary, and the lattices of its pieces over strings.

The vocabulary file is a parameter; by default it is the one that the ``public_tokenizers`` package names. It has merge
ranks and no probabilities, so a piece of rank r gets a Zipf weight, 1 / (r + 2.7).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = "▁"
#: A literal SPACE of a text, which no piece may match, so that decoding is exact.
LITERAL = 0x110000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """Pieces by their characters: a table of children for each node that has any, over the characters of longer pieces."""

    def __init__(self, words: dict[str, int]):
        lone = {ord(w): v for w, v in words.items() if len(w) == 1}
        self.lone = np.full(LITERAL + 1, -1, np.int32)
        self.lone[list(lone)] = list(lone.values())
        longer = {w: v for w, v in words.items() if len(w) > 1}
        codes = {c: i + 1 for i, c in enumerate(sorted({c for w in longer for c in w}))}
        self.code = np.zeros(LITERAL + 1, np.int16)
        for c, i in codes.items():
            self.code[ord(c)] = i
        child: dict[tuple[int, int], int] = {}
        value = [-1]
        for word, v in longer.items():
            node = 0
            for c in word:
                key = (node, codes[c])
                if key not in child:
                    child[key] = len(value)
                    value.append(-1)
                node = child[key]
            value[node] = v
        parents = {n: i + 1 for i, n in enumerate(sorted({n for n, _ in child}))}
        self.value = np.array(value, np.int32)
        self.row = np.zeros(len(value), np.int64)
        self.row[list(parents)] = list(parents.values())
        self.width = len(codes) + 1
        self.table = np.zeros((len(parents) + 1) * self.width, np.uint16 if len(value) < 1 << 16 else np.int32)
        for (n, c), to in child.items():
            self.table[parents[n] * self.width + c] = to

    def edges(self, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, value) of every occurrence in ``chars`` that stays below ``end`` of its start, by start and stop.

        A position where no single character matches gets one with value -1 - character.
        """
        code = self.code[chars].astype(np.int64)
        at = np.arange(len(chars), dtype=np.int32)
        alone = self.lone[chars]
        found = [(at, at + 1, np.where(alone >= 0, alone, -1 - chars.astype(np.int32)))]
        row = np.full(len(chars), self.row[0])
        depth = 0
        while len(at):
            node = self.table[row * self.width + code[at + depth]]
            hit = np.flatnonzero(node)
            at, node = at[hit], node[hit]
            depth += 1
            if depth > 1:
                v = self.value[node]
                is_piece = np.flatnonzero(v >= 0)
                start = at[is_piece]
                found.append((start, start + depth, v[is_piece]))
            row = self.row[node]
            more = np.flatnonzero((row > 0) & (at + depth < end[at]))
            at, row = at[more], row[more]
        start, stop, v = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], stop[order], v[order]


class Vocabulary:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.size, self.names = n, names
        self.normal = {names[i]: i for i in range(n) if not special[i] and not byte[i]}
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if byte[i]}
        rank = np.array([n if byte[i] else -sp.get_score(i) for i in range(n)], float)
        weight = np.where(special, 0.0, 1 / (np.maximum(rank, 0) + 2.7))
        with np.errstate(divide="ignore"):
            self.log = np.log(weight / weight.sum())
        self.raw = [b"" if special[i] else bytes([int(names[i][1:-1], 16)]) if byte[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
        #: Log probability of any one byte.
        self.byte_log = float(self.log[next(iter(self.bytes.values()))])

    def fallback(self, char: int) -> list[int]:
        """The byte pieces of a character that has no piece."""
        return [self.bytes[b] for b in (SPACE if char == LITERAL else chr(char)).encode("utf-8", "surrogatepass")]


@lru_cache(4)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def firsts(start: np.ndarray, n: int) -> np.ndarray:
    """Where the edges of each of n positions begin among sorted starts, and the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(start, minlength=n))])


def log_sums(start: np.ndarray, stop: np.ndarray, log: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Backward sums: for each position, the log of the total weight of all paths from it to ``end``.

    ``start`` is sorted and has every position. Positions at one distance from their end are handled together.
    """
    n = len(end)
    out = np.zeros(n + 1)
    first = firsts(start, n)
    away = end - np.arange(n)
    order = np.argsort(away, kind="stable")
    cuts = np.flatnonzero(np.diff(away[order])) + 1
    last = stop == end[start]
    for group in np.split(order, cuts):
        lo, count = first[group], first[group + 1] - first[group]
        offset = np.cumsum(count) - count
        e = np.arange(int(count.sum())) + np.repeat(lo - offset, count)
        v = log[e] + np.where(last[e], 0.0, out[np.where(last[e], 0, stop[e])])
        top = np.maximum.reduceat(v, offset)
        out[group] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count)), offset))
    return out[:n]
