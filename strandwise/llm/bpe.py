"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the encoding of its text if every token encodes to itself
and every two neighbours are what their joined bytes encode to.  So encodings
are the paths of a nondeterministic transducer: a configuration is the last
whole token, a place in the trie of tokens, and the tokens not yet emitted.  The
deterministic transducer's states are sets of configurations with what all have
in common emitted; states and transitions are made when a text first needs them.
A token is thereby emitted as soon as no continuation can change it, which is at
most one longest token later.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import regex

#: Fixed value: the split into pieces that byte_bpe_50k is defined over; merges never cross it.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROOT = 0


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Lazily determinised transducer from the bytes of a piece to token ids.

    At most ``max_states`` states and ``max_words`` whole pieces are kept; beyond
    that the tables are dropped and built anew, so memory is bounded.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES, max_states: int = 150_000, max_words: int = 150_000):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.max_states, self.max_words = max_states, max_words
        self.spelling = {i: t for t, i in ranks.items()}
        self.children: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                nxt = self.children.get(key)
                if nxt is None:
                    nxt = self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((-1, ROOT, ()),)
        self.numbers = {start: 0}
        self.states = [start]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, text: bytes) -> list[int]:
        """Encode by the merge rule itself: always the pair of least rank, leftmost first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last`` (after nothing: by itself)."""
        key = (last, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * self.max_states:
                self.pairs.clear()
            if last < 0:
                known = self.merge(self.spelling[token]) == [token]
            else:
                known = self.merge(self.spelling[last] + self.spelling[token]) == [last, token]
            self.pairs[key] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one transition: advance all configurations, emit what they agree on."""
        after = []
        for last, node, pending in self.states[state]:
            nxt = self.children.get(node << 8 | byte)
            if nxt is None:
                continue
            after.append((last, nxt, pending))
            token = self.token_at[nxt]
            if token >= 0 and self._follows(last, token):
                after.append((token, ROOT, (*pending, token)))
        common = after[0][2]
        for _, _, pending in after[1:]:
            n = 0
            while n < len(common) and n < len(pending) and common[n] == pending[n]:
                n += 1
            common = common[:n]
        reached = tuple(sorted((last, node, pending[len(common) :]) for last, node, pending in after))
        number = self.numbers.get(reached)
        if number is None:
            number = self.numbers[reached] = len(self.states)
            self.states.append(reached)
        move = self.moves[state << 8 | byte] = (number, common)
        return move

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if len(self.states) > self.max_states:
            self._reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
                moves = self.moves
            state, emitted = move
            if emitted:
                out += emitted
        # Exactly one configuration stands between two tokens.
        out += next(pending for _, node, pending in self.states[state] if node == ROOT)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special tokens' strings being ordinary text."""
        out: list[int] = []
        words = self.words
        for piece in self.split(text):
            ids = words.get(piece)
            if ids is None:
                if len(words) > self.max_words:
                    words.clear()
                ids = self.encode_piece(piece.encode("utf-8", "replace"))
                if len(piece) <= 32:
                    words[piece] = ids
            out += ids
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))


class Utf8Machine:
    """Incremental UTF-8 decoding: bytes in, characters out as soon as they are whole.

    The state is how many continuation bytes are due, the range allowed for the
    next, and the bits so far.  What can't be decoded gives U+FFFD, one for each
    longest broken part, as the Unicode standard advises.
    """

    def __init__(self) -> None:
        self.due, self.bits, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: Iterable[int]) -> str:
        out: list[str] = []
        for byte in data:
            if self.due:
                if self.low <= byte <= self.high:
                    self.bits, self.low, self.high = self.bits << 6 | byte & 0x3F, 0x80, 0xBF
                    self.due -= 1
                    if not self.due:
                        out.append(chr(self.bits))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.due, self.bits = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.due, self.bits = 2, byte & 0x0F
                self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.due, self.bits = 3, byte & 0x07
                self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        broken = self.due > 0
        self.due, self.low, self.high = 0, 0x80, 0xBF
        return "�" if broken else ""


def decode(ids: Iterable[int], spelling: dict[int, bytes]) -> Iterator[str]:
    """The text of a stream of ids, piece by piece; a character split over tokens comes with its last byte."""
    machine = Utf8Machine()
    for i in ids:
        text = machine.feed(spelling[i])
        if text:
            yield text
    rest = machine.close()
    if rest:
        yield rest
