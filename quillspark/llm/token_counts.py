"""Token counts by a finite-state compilation of a byte-level BPE tokenizer.

The vocabulary becomes a deterministic transducer over bytes. A state holds, for each start
position from which a token may still grow, the trie node reached, the last token of the
encoding up to that start, and that encoding's length relative to the present one; equal
states are one. A transition is annotated with the number of tokens it adds to the encoding
of the text read so far (it may be negative, when a longer token replaces shorter ones).
States are made when first met and kept in a table of bounded size, which is emptied when
full. That the last token of each prefix determines the rest holds for BPE vocabularies
whose tokens encode to themselves; others are left out of the transducer.

A batch of texts is cut into chunks that run side by side. A chunk's state map is constant
behind its first word boundary, so it is kept as (head, count, end state); maps compose by a
scan in which every head runs from the end state of the chunk before it.

Defined cases: null text counts as empty, 0 bytes and 0 tokens. Rows repeat as they come. An
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a chunk, and characters of texts run together.
CHUNK, BATCH_CHARS = 512, 6_000_000
#: States held at most. A state takes 5 bytes for each different byte met so far, and about 0.4 KB besides.
MOST_STATES = 250_000
LIMIT = 512
#: Above a trie node with more tokens than this, states are not compared by what may follow.
MANY = 24

COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = 0, 1, 2, 3, 255
_DEAD, _START = 0, 1


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """The lazily built transducer: `next` and `adds` by state * width + column of the byte."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, symbol = described["model"], byte_symbols()
        # Own ids: the bytes, then one for each merge in order, so that a lower id is merged earlier.
        self.token = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            left, right = (bytes(symbol[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            made = self.token.setdefault(left + right, len(self.halves))
            if made == len(self.halves):
                self.halves.append((self.token[left], self.token[right]))
            self.merged[(self.token[left], self.token[right])] = made
        self.spelled = {i: b for b, i in self.token.items()}
        #: Special strings, which the library by default reads as one token wherever they stand.
        self.special = [t["content"] for t in described.get("added_tokens") or []]
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.stands: dict[tuple[int, int], int | None] = {}
        self.first: dict[tuple[int, tuple], int] = {}
        self._trie()
        self.rows, self.width = 4096, 64
        self.column, self.byte_of = np.full(256, -1, np.int64), []
        self.next = np.full(self.rows * self.width, -1, np.int32)
        self.adds = np.zeros(self.rows * self.width, np.int8)
        self._reset()
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)

    # The vocabulary.

    def encode(self, data: bytes) -> list[int]:
        """Plain BPE of one word, by the merge ranks."""
        ids = [self.token[data[k : k + 1]] for k in range(len(data))]
        while len(ids) > 1:
            made = min((self.merged[p] for p in zip(ids, ids[1:], strict=False) if p in self.merged), default=None)
            if made is None:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and self.merged.get((ids[k], ids[k + 1])) == made:
                    out.append(made)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def _trie(self) -> None:
        self.child: dict[tuple[int, int], int] = {}
        self.ends: list[int] = [-1]
        self.grows: list[bool] = [False]
        for data, token in self.token.items():
            node = 0
            for b in data:
                self.grows[node] = True
                got = self.child.get((node, b))
                if got is None:
                    got = self.child[(node, b)] = len(self.ends)
                    self.ends.append(-1)
                    self.grows.append(False)
                node = got
            self.ends[node] = token
        # Of nodes above few tokens, those tokens; None above many.
        self.above: list[tuple | None] = [()] * len(self.ends)
        for (parent, _), node in sorted(self.child.items(), key=lambda x: -x[1]):
            below, own = self.above[node], self.above[parent]
            if own is not None:
                more = None if below is None else own + below + ((self.ends[node],) if self.ends[node] >= 0 else ())
                self.above[parent] = more if more is not None and len(more) <= MANY else None

    def _follows(self, last: int, token: int) -> bool:
        """Whether `token` may stand right behind `last` (-1: at the start) in an encoding."""
        key = (last, token)
        got = self.pair_ok.get(key)
        if got is None:
            if len(self.pair_ok) > 1_000_000:
                self.pair_ok.clear()
            got = self.pair_ok[key] = self.encode(self.spelled[token]) == [token] if last < 0 else self._stays_apart(last, token)
        return got

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the seam of two tokens: undo their merges, latest first, and look for a pair across the seam that would have been merged before the one just undone."""
        before = len(self.halves)
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            if left > right or right < 256:
                if left < 256:
                    return True
                before, left = left, self.halves[left][1]
            else:  # of equal ids the right one is undone first: its merge would come after the pair's
                before, right = right + 1, self.halves[right][0]

    def _standing_for(self, node: int, before: int) -> int | None:
        """A token for `before` that may be followed by the same tokens through this trie node; None where there are none.

        This is what makes states equal. Above many tokens it is `before` itself.
        """
        tokens = self.above[node]
        if tokens is None:
            return before
        key = (node, before)
        got = self.stands.get(key, -2)
        if got == -2:
            if len(self.stands) > 1_000_000:
                self.stands.clear()
            allowed = tuple(t for t in tokens if self._follows(before, t))
            got = self.stands[key] = self.first.setdefault((node, allowed), before) if allowed else None
        return got

    # States.

    def _reset(self) -> None:
        self.next[:] = -1
        self.next[: self.width] = _DEAD
        self.keys: list[tuple] = [(), ((0, -1, 0),)]
        self.index = {k: i for i, k in enumerate(self.keys)}

    def _intern(self, key: tuple) -> int:
        got = self.index.get(key)
        if got is None:
            got = self.index[key] = len(self.keys)
            self.keys.append(key)
            if got >= self.rows:
                self.rows *= 2
                self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
                self.adds = np.concatenate([self.adds, np.zeros(len(self.adds), np.int8)])
        return got

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """Columns of the bytes; bytes not met before get new ones."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                self.column[b] = len(self.byte_of)
                self.byte_of.append(b)
        if len(self.byte_of) > self.width:
            wider = min(256, 1 << (len(self.byte_of) - 1).bit_length())
            for name, fill in (("next", -1), ("adds", 0)):
                old = getattr(self, name).reshape(self.rows, self.width)
                new = np.full((self.rows, wider), fill, old.dtype)
                new[:, : self.width] = old
                setattr(self, name, new.reshape(-1))
            self.width = wider
            self.next[:wider] = _DEAD
        return self.column[data]

    def _step(self, state: int, column: int) -> None:
        """Make the transition of `state` on a byte: entries are (trie node, last token before it, tokens before it less the tokens now)."""
        byte, child, ends = self.byte_of[column], self.child, self.ends
        moved, last, adds = [], None, 0
        for node, before, count in self.keys[state]:
            node = child.get((node, byte))
            if node is None:
                continue
            moved.append((node, before, count))
            token = ends[node]
            if last is None and token >= 0 and self._follows(before, token):
                last, adds = token, count + 1
        if last is None:
            raise ValueError("the vocabulary cannot spell this byte")
        entries = []
        for n, b, c in moved:
            if self.grows[n] and (b := self._standing_for(n, b)) is not None:
                entries.append((n, b, c - adds))
        entries.append((0, last, 0))
        made = self._intern(tuple(entries))
        self.next[state * self.width + column] = made
        self.adds[state * self.width + column] = adds

    def advance(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for every lane: the states after it and the tokens added."""
        at = states * self.width + columns
        after = self.next[at]
        if after.min(initial=0) < 0:
            todo = np.unique(at[after < 0])
            if len(self.keys) + len(todo) > MOST_STATES:
                states = self._flush(states)
                at = states * self.width + columns
                todo = np.unique(at[self.next[at] < 0])
            for k in todo.tolist():
                self._step(*divmod(k, self.width))
            after = self.next[at]
        return after.astype(np.int64), self.adds[at]

    def _flush(self, states: np.ndarray) -> np.ndarray:
        """Empty the table, but for the states the lanes are in."""
        live, back = np.unique(states, return_inverse=True)
        kept = [self.keys[s] for s in live.tolist()]
        self._reset()
        self.flushes = getattr(self, "flushes", 0) + 1
        return np.asarray([self._intern(k) for k in kept], np.int64)[back]

    # Word boundaries.

    def _classify(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points; new ones are asked of the library's own pre-tokenizer."""
        got = self.classes[points]
        if (got == _UNKNOWN).any():
            split = self.library.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[got == _UNKNOWN]).tolist():
                c = chr(p)
                if len(split(f"x{c}x")) == 1:
                    kind = _LETTER
                elif len(split(f"0{c}0")) == 1:
                    kind = _NUMBER
                elif len(split(f"-{c}-")) == 1:
                    kind = _OTHER
                else:
                    kind = _SPACE
                self.classes[p] = kind
            got = self.classes[points]
        return got

    def boundaries(self, points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Where words start in the run-together texts; `fresh` marks the first character of each text."""
        n = len(points)
        kind = self._classify(points)
        before = np.empty(n, np.uint8)
        before[0], before[1:] = _UNKNOWN, kind[:-1]
        before[fresh] = _UNKNOWN
        space = kind == _SPACE
        blank = np.zeros(n, bool)
        blank[1:] = points[:-1] == 32
        blank[fresh] = False
        ends = np.zeros(n, bool)  # the last character of its text
        ends[:-1], ends[-1] = fresh[1:], True
        then_space = np.zeros(n, bool)
        then_space[:-1] = space[1:]
        start = np.where(space, (before != _SPACE) | (~then_space & ~ends), (kind != before) & ~blank)
        start |= fresh
        # Contractions: a quote that starts a word, with the letters that belong to it.
        quote = np.flatnonzero((points == 39) & ((before == _UNKNOWN) | (before == _LETTER) | (before == _NUMBER) | ((before == _SPACE) & ~blank)))
        if len(quote):
            own = np.cumsum(fresh)
            far = lambda k: np.where((quote + k < n) & (own[np.minimum(quote + k, n - 1)] == own[quote]), points[np.minimum(quote + k, n - 1)], 0)
            one, two = far(1), far(2)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for mask, size in ((short, 2), (long, 3)):
                at = quote[mask]
                for k in range(1, size):
                    start[at + k] = False
                at = at + size
                start[at[at < n]] = True
        return start

    # Counting.

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        sizes, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if self.special and any(x in t for t in texts for x in self.special):
            cutter = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
            parts = [cutter.split(t) for t in texts]
            owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
            _, found = self.count([x for p in parts for x in p])
            tokens = np.bincount(owner, found, len(texts)).astype(np.int64) + [len(p) - 1 for p in parts]
            return np.asarray([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64), tokens
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= BATCH_CHARS):
                chars += len(texts[hi])
                hi += 1
            if chars:
                sizes[lo:hi], tokens[lo:hi] = self._count(texts[lo:hi])
            lo = hi
        return sizes, tokens

    def _count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.asarray([len(t) for t in texts])
        fresh = np.zeros(len(points), bool)
        begins = np.cumsum(lengths) - lengths
        fresh[begins[lengths > 0]] = True
        start = self.boundaries(points, fresh)
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        head = (data & 0xC0) != 0x80
        edge = np.zeros(len(data), bool)
        edge[np.flatnonzero(head)[start]] = True
        wide = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        upto = np.concatenate([[0], np.cumsum(wide)])
        sizes = upto[begins + lengths] - upto[begins]
        offsets = np.cumsum(sizes) - sizes
        added = self._run(data, edge)
        total = np.concatenate([[0], np.cumsum(added, dtype=np.int64)])
        return sizes, total[offsets + sizes] - total[offsets]

    def _run(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Tokens added by each byte, from all chunks' state maps composed."""
        lanes = -(-len(data) // CHUNK)
        room = lanes * CHUNK - len(data)
        grid = np.concatenate([self._columns(data), np.zeros(room, np.int64)]).reshape(lanes, CHUNK).T.copy()
        cuts = np.concatenate([edge, np.ones(room, bool)]).reshape(lanes, CHUNK).T.copy()
        added = np.zeros((CHUNK, lanes), np.int8)
        # Each chunk from its first boundary on, whatever came before it.
        states = np.full(lanes, _DEAD, np.int64)
        for k in range(CHUNK):
            states[cuts[k]] = _START
            states, added[k] = self.advance(states, grid[k])
        # Heads: what stands before the first boundary runs from the end of the chunk before.
        first = np.where(cuts.any(0), cuts.argmax(0), CHUNK)
        known = first < CHUNK
        todo = np.flatnonzero(first > 0)
        while len(todo):
            ready = todo[known[todo - 1]]
            run, here = states[ready - 1], ready
            for k in range(int(first[ready].max(initial=0))):
                on = first[here] > k
                if not on.all():
                    here, run = here[on], run[on]
                run, added[k, here] = self.advance(run, grid[k, here])
                done = first[here] == CHUNK
                if k == CHUNK - 1 and done.any():
                    states[here[done]] = run[done]
                    known[here[done]] = True
            todo = np.setdiff1d(todo, ready, assume_unique=True)
        return added.T.reshape(-1)[: len(data)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, in its scan task, without a shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes, tokens = machine.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(counted, COUNT_SCHEMA)
