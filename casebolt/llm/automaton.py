"""A minimal acyclic transducer: words as UTF-8 bytes in, their number out, with shared prefixes and suffixes.

Built by adding sorted words one after another and merging each finished suffix with an equal state. Every transition carries
the number of words that come before it, so the sum along a path is the word's number; the number selects the word's token ids.
The whole lexicon is one byte string of flat arrays which readers map into memory without copying.
"""

from __future__ import annotations

import numpy as np

_MAGIC = 0x4C455832


def build(words: list[bytes], ids: list[list[int]]) -> bytes:
    """Serialised lexicon of distinct words and the token ids of each."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...)), children have smaller numbers

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
        return at

    path: list[list] = [[False, []]]  # open states of the last word: [final, [(byte, target)]]
    last = b""
    for k in order:
        w = words[k]
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        for depth in range(len(last), common, -1):
            done = close(path.pop())
            path[-1][1].append((last[depth - 1], done))
        path.extend([False, []] for _ in range(common, len(w)))
        path[-1][0] = True
        last = w
    for depth in range(len(last), 0, -1):
        done = close(path.pop())
        path[-1][1].append((last[depth - 1], done))
    root = close(path.pop())

    below = np.zeros(len(states), np.int64)
    keys, targets, before = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for byte, to in edges:
            keys.append(s << 8 | byte)
            targets.append(to)
            before.append(n)
            n += int(below[to])
        below[s] = n
    flat = [i for k in order for i in ids[k]]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(ids[k]) for k in order], out=starts[1:])
    final = np.array([f for f, _ in states], np.int64)
    parts = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(before, np.int64), final, starts, np.array(flat, np.int64)]
    head = np.array([_MAGIC, root, *map(len, parts)], np.int64)
    return b"".join([head.tobytes(), *(p.tobytes() for p in parts)])


class Lexicon:
    """Reads a serialised lexicon from a buffer, such as a mapped file."""

    def __init__(self, buffer):
        a = np.frombuffer(buffer, np.int64) if not isinstance(buffer, np.ndarray) else buffer.view(np.int64)
        if len(a) < 8 or a[0] != _MAGIC:
            raise ValueError("not a lexicon")
        self.root, sizes, at, parts = int(a[1]), a[2:8], 8, []
        for n in sizes:
            parts.append(a[at : at + int(n)])
            at += int(n)
        self.keys, self.targets, self.before, self.final, self.starts, self.flat = parts

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.int64, "r"))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it. All words step through the automaton together."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            if len(self.final) and self.final[self.root]:
                out[[i for i, w in enumerate(words) if not w]] = 0
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        alive = np.arange(len(words))
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            ended = lengths[alive] == step
            done = alive[ended]
            hit = done[self.final[state[done]] == 1]
            out[hit] = number[hit]
            alive = alive[~ended]
            if not len(alive):
                break
            want = state[alive] << 8 | data[offsets[alive] + step]
            at = np.searchsorted(self.keys, want)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == want
            alive, at = alive[ok], at[ok]
            number[alive] += self.before[at]
            state[alive] = self.targets[at]
            step += 1
        return out

    def ids(self, number: int) -> list[int]:
        return self.flat[self.starts[number] : self.starts[number + 1]].tolist()
