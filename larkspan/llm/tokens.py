"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer (a ``tokenizers`` JSON file) is compiled into two deterministic transducers:

* The *piece* transducer reads classes of characters and emits a mark where a piece begins. It has a few
  states. A text is cut into chunks; each chunk is run from every state at once, which gives a map
  from its first to its last state; maps are composed by a parallel prefix scan, which gives each chunk its
  true first state and thereby its marks. Chunks of all texts of a batch run side by side.
* The *token* transducer reads the bytes of a piece. A merge list splits a string into tokens of which each neighbouring
  pair stays as it is when merged alone, and no other split has that property. So the last token of a prefix
  follows from the last tokens of shorter prefixes: it is the token that ends there and goes with the last
  token of what is before it. A state holds what that needs and no more: the longest end of the prefix that begins
  some token, and for each place in it the last token there and the number of tokens since. Token lengths are
  bounded, so states are finite in number. A transition's output is the change in the number of tokens; a piece's
  count is the sum along its path. States and transitions are compiled when a text first needs them, by the rule above,
  not by merging texts; merging serves to decide which pairs of tokens stay as they are.

Counts equal the library's, without begin, end or added special tokens; strings of special tokens inside
texts are single tokens, the library's default. Nothing is truncated.
"""

from __future__ import annotations

import gc
import json
import sys
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.shipping import ship

LETTER, NUMBER, BLANK, SPACE, QUOTE, OTHER, END = range(7)
#: Letters of the contractions 's 't 're 've 'm 'll 'd have classes of their own: they end or go on after a quote.
CONTRACTION = "strevmld"
_FIRST_LETTER = END + 1
CLASSES = _FIRST_LETTER + len(CONTRACTION)
#: Characters of a chunk.
CHUNK = 256
#: Characters of texts that are worked on at a time.
BATCH = 1 << 20
#: Bytes of pieces, states and transitions that a worker keeps, about; beyond, it begins anew.
KEPT_BYTES = 256 << 20
#: Longer pieces aren't kept.
_LONG = 64
_NEVER = (1 << 62, -1)


def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    #: The code points of Unicode's White_Space.
    blank = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[blank] = BLANK
    out[0x20], out[ord("'")] = SPACE, QUOTE
    for k, c in enumerate(CONTRACTION):
        out[ord(c)] = _FIRST_LETTER + k
    return out


class PieceTransducer:
    """Where pieces begin, for the pattern of byte-level BPE.

    The pattern: contractions; letters, numbers or other characters, each run with one space before it
    if there is one; white space. White space before another piece keeps its last character out: that
    is a space for the next piece, or a piece of its own.

    A state says what the current piece is. A mark can depend on the character after it (a quote may
    begin a contraction; the last white space of a run stands apart), so a transition emits two bits:
    1: a piece begins here; 2: a piece begins one character back; 4: two back.
    """

    def __init__(self) -> None:
        #: 0 start; 1 letters; 2 numbers; 3 others; 4 one space; 5 one other blank; 6 run of blanks ending in a space; 7 run of blanks ending in another;
        #: 8 quote that may begin a contraction; 9 such quote and r or v; 10 such quote and l; 11 after a whole contraction.
        self.states = 12
        self.next = np.zeros((CLASSES, self.states), np.uint8)
        self.emit = np.zeros((CLASSES, self.states), np.uint8)
        for kind in range(CLASSES):
            for state in range(self.states):
                self.next[kind, state], self.emit[kind, state] = self._step(state, kind)

    def _step(self, state: int, kind: int) -> tuple[int, int]:
        letter = CONTRACTION[kind - _FIRST_LETTER] if kind >= _FIRST_LETTER else ""
        plain = LETTER if letter else kind
        if kind == END:
            # The end of the text comes as one character; white space before it is one piece.
            return 0, 1
        if state == 8:
            if letter and letter in "stmd":
                return 11, 0
            if letter and letter in "rv":
                return 9, 0
            if letter == "l":
                return 10, 0
            return self._enter(3, plain)
        if state == 9:
            # After r or v an e completes the contraction; else the quote stands alone and letters began one back.
            if letter == "e":
                return 11, 0
            to, out = self._enter(1, plain)
            return to, out | 2
        if state == 10:
            if letter == "l":
                return 11, 0
            to, out = self._enter(1, plain)
            return to, out | 2
        return self._enter(state, plain)

    def _enter(self, state: int, kind: int) -> tuple[int, int]:
        blank = kind in (BLANK, SPACE)
        if blank:
            if state in (4, 5, 6, 7):
                return (6 if kind == SPACE else 7), 0
            return (4 if kind == SPACE else 5), 1
        run = {LETTER: 1, NUMBER: 2, OTHER: 3, QUOTE: 3}[kind]
        if state == 4:
            # A space joins the piece after it; so does its quote, which then begins no contraction.
            return run, 0
        if state == 6:
            return run, 2
        if state == 5:
            return (8 if kind == QUOTE else run), 1
        if state == 7:
            return (8 if kind == QUOTE else run), 3
        if state == run:
            # A quote after other characters goes on with them.
            return run, 0
        return (8 if kind == QUOTE else run), 1

    def begins(self, kinds: np.ndarray) -> np.ndarray:
        """For the classes of texts, each followed by END, whether a piece begins at each place (END marks itself)."""
        size = len(kinds)
        rows = -(-size // CHUNK)
        grid = np.full(rows * CHUNK, END, np.uint8)
        grid[:size] = kinds
        steps = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.int16) * self.states
        table = self.next.ravel()
        # Every chunk from every state.
        at = np.tile(np.arange(self.states, dtype=np.uint8), (rows, 1))
        for step in steps:
            at = table[step[:, None] + at]
        first = scan(at)
        out = np.empty((CHUNK, rows), np.uint8)
        emit, state = self.emit.ravel(), first
        for k, step in enumerate(steps):
            index = step + state
            out[k], state = emit[index], table[index]
        marks = np.ascontiguousarray(out.T).ravel()[:size]
        begins = (marks & 1).astype(bool)
        begins[:-1] |= (marks[1:] & 2) > 0
        begins[:-2] |= (marks[2:] & 4) > 0
        return begins


def scan(maps: np.ndarray) -> np.ndarray:
    """The state before each chunk, if the first begins in state 0: an exclusive prefix scan of maps (chunks x states) under composition, in log2(chunks) rounds."""
    total, step = maps.copy(), 1
    while step < len(total):
        # map[k - step] comes first, then map[k].
        total[step:] = np.take_along_axis(total[step:], total[:-step].astype(np.int64), axis=1)
        step *= 2
    return np.concatenate([np.zeros(1, np.uint8), total[:-1, 0]])


def _byte_letters() -> dict[str, int]:
    """The byte of each letter that stands for it in the file: printable Latin-1 for itself, the others from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenTransducer:
    """Counts of tokens over the bytes of a piece, by a deterministic transducer whose states are compiled on demand."""

    def __init__(self, merges: list[list[str]]) -> None:
        letters = _byte_letters()
        names: dict[str, int] = dict(letters)
        #: (left, right) -> rank and result of a merge; a number below 256 is a byte.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        #: The rank and the halves that a token is merged by and from.
        self.made: dict[int, tuple[int, tuple[int, int]]] = {}
        self.borders: tuple[dict[int, tuple[tuple[int, int], ...]], ...] = ({}, {})
        spelled: dict[int, bytes] = {b: bytes([b]) for b in range(256)}
        for rank, (left, right) in enumerate(merges):
            made = names.setdefault(left + right, 256 + rank)
            self.merges.setdefault((names[left], names[right]), (rank, made))
            if self.made.setdefault(made, (rank, (names[left], names[right])))[0] != rank:
                raise ValueError("a token that is merged in two ways can't be compiled")
            spelled.setdefault(made, spelled[names[left]] + spelled[names[right]])
        self.spelled = spelled
        self._automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sums: dict[bytes, int] = {}
        self._restart()

    def _automaton(self) -> None:
        """The tokens' prefixes as nodes: children by byte, the longest proper end that is a node too, depth, and the tokens that end at a node, longest first."""
        self.child: list[dict[int, int]] = [{}]
        self.depth, self.fall = [0], [0]
        token: list[int] = [-1]
        for made, spelling in self.spelled.items():
            # A token that its own spelling isn't merged into never stands in a text.
            if len(spelling) > 1 and self.merged(spelling) != [made]:
                continue
            node = 0
            for byte in spelling:
                to = self.child[node].get(byte)
                if to is None:
                    to = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.fall.append(0)
                    token.append(-1)
                node = to
            token[node] = made
        #: (token, length) by node: its own and those of its ends.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.child)
        level = [0]
        while level:
            for node in level:
                if node:
                    own = ((token[node], self.depth[node]),) if token[node] >= 0 else ()
                    self.ends[node] = own + self.ends[self.fall[node]]
                for byte, to in self.child[node].items():
                    self.fall[to] = self._go(self.fall[node], byte) if node else 0
            level = [to for node in level for to in self.child[node].values()]

    def _go(self, node: int, byte: int) -> int:
        while True:
            to = self.child[node].get(byte)
            if to is not None or not node:
                return to or 0
            node = self.fall[node]

    def merged(self, spelling: bytes) -> list[int]:
        """What the merges, lowest rank first, leave of a short string. Used to compile, not to count."""
        parts, merges = list(spelling), self.merges
        while len(parts) > 1:
            best = min(((merges[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges), default=None)
            if best is None:
                break
            (_, made), at = best
            left, right = parts[at], parts[at + 1]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == left and parts[k + 1] == right:
                    out.append(made)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def stays(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are what the merges make of their common string.

        Each token grows at its side of the border by merges of its own, in the order of their ranks. If the symbols at
        the border can merge before either of them goes into a larger one, that happens instead.
        """
        found = self.pairs.get((left, right))
        if found is None:
            a, b, i, j = self._border(left, 1), self._border(right, 0), 0, 0
            while True:
                (x, goes), (y, comes) = a[i], b[j]
                rank = self.merges.get((x, y), _NEVER)[0]
                # Of equal merges the leftmost comes first: that within the left token before this one, this one before that within the right.
                if rank < goes and rank <= comes and rank < _NEVER[0]:
                    found = False
                    break
                if goes == comes == _NEVER[0]:
                    found = True
                    break
                if goes < comes:
                    i += 1
                else:
                    j += 1
            self.pairs[left, right] = found
        return found

    def _border(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The symbols at a side of a token from its byte to the whole, each with the rank of the merge that takes it in."""
        found = self.borders[side].get(token)
        if found is None:
            made = self.made.get(token)
            if made is None:
                found = ((token, _NEVER[0]),)
            else:
                rank, halves = made
                inner = self._border(halves[side], side)
                found = (*inner[:-1], (inner[-1][0], rank), (token, _NEVER[0]))
            self.borders[side][token] = found
        return found

    def _restart(self) -> None:
        """Only the first state: an empty prefix."""
        #: state << 8 | byte -> next state << 16 | change of the count + 2 ** 15.
        self.steps: dict[int, int] = {}
        #: A state's node and, from the place of the node's depth back up to the prefix's end, (last token, count there less the count at the end).
        self.known: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ((-1, 0),))]
        self.numbers = {self.known[0]: 0}
        self.held = 0

    def compile_step(self, state: int, byte: int) -> int:
        """The transition out of a state by a byte. The last token of the longer prefix is the one that ends there and goes with the last token before it."""
        node, tail = self.known[state]
        node = self._go(node, byte)
        # tail[-1] is the end of the prefix, tail[-1 - k] is k bytes earlier.
        for token, length in self.ends[node]:
            last, count = tail[-length]
            if last < 0 or self.stays(last, token):
                break
        else:
            raise AssertionError("a single byte always goes with something before it")
        change = count + 1
        moved = tuple([(t, c - change) for t, c in tail[len(tail) - self.depth[node] :]] + [(token, 0)])
        known = (node, moved)
        to = self.numbers.get(known)
        if to is None:
            to = self.numbers[known] = len(self.known)
            self.known.append(known)
            self.held += 200 + 80 * len(moved)
        self.held += 150
        found = self.steps[state << 8 | byte] = to << 16 | change + (1 << 15)
        return found

    def run(self, piece: bytes) -> int:
        """The sum of the outputs along a piece's path."""
        steps, state, total = self.steps.get, 0, -(len(piece) << 15)
        for byte in piece:
            found = steps(state << 8 | byte)
            if found is None:
                found = self.compile_step(state, byte)
            state = found >> 16
            total += found & 0xFFFF
        return total

    def count(self, piece: bytes) -> int:
        """``run``, kept for whole pieces, as pieces recur."""
        found = self.sums.get(piece)
        if found is None:
            if self.held + 150 * len(self.pairs) > KEPT_BYTES:
                self.sums.clear()
                self.pairs.clear()
                self._restart()
            found = self.run(piece)
            if len(piece) <= _LONG:
                self.sums[piece] = found
                self.held += 150 + len(piece)
        return found


class Tokenizer:
    """The compiled form of a tokenizer file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and not model.get("ignore_merges") and not model.get("dropout")
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not plain:
            raise ValueError("only byte-level BPE without normalisation and prefix space can be compiled")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in their surroundings can't be compiled")
        self.special.sort(key=len, reverse=True)
        self.pieces, self.tokens, self.kinds = PieceTransducer(), TokenTransducer(merges), _classes()

    def _cut(self, text: str) -> tuple[list[str], int]:
        """Stretches between strings of special tokens, and how many of those there are."""
        parts, found = [text], 0
        for special in self.special:
            cut = [p.split(special) for p in parts]
            found += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        return parts, found

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        out = [0] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            parts, out[k] = self._cut(text) if self.special else ([text], 0)
            for part in parts:
                if part:
                    held.append((k, part))
                    size += len(part)
            if size >= BATCH:
                self._add(held, out)
                held, size = [], 0
        if held:
            self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, str]], out: list[int]) -> None:
        joined = "\0".join([p for _, p in held]) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points]
        ends = np.cumsum([len(p) + 1 for _, p in held]) - 1
        kinds[ends] = END
        begins = self.pieces.begins(kinds)
        raw = joined.encode()
        # Where each character begins in the bytes.
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        offset = np.cumsum(width) - width
        places = np.flatnonzero(begins)
        first, last = offset[places], np.append(offset[places[1:]], len(raw))
        real = kinds[places] != END
        owner = np.searchsorted(ends, places[real])
        get, count = self.tokens.sums.get, self.tokens.count
        found = [get(p) or count(p) for p in [raw[a:b] for a, b in zip(first[real].tolist(), last[real].tolist(), strict=True)]]
        sums = np.bincount(owner, weights=found, minlength=len(held)).astype(np.int64)
        for (k, _), n in zip(held, sums.tolist(), strict=True):
            out[k] += n


_loaded: dict[str, Tokenizer] = {}


def compiled(text: str) -> Tokenizer:
    """One compilation per worker and file."""
    if text not in _loaded:
        _loaded.clear()
        _loaded[text] = Tokenizer(text)
        # The tables live as long as the worker: the garbage collector needn't go through them.
        gc.freeze()
    return _loaded[text]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text)``, by the tokenizer file at ``path``.

    The file is read on the driver and sent along, as its size doesn't depend on the data. Null text counts
    as empty: no bytes, no tokens. Repeated rows and null ids each keep their row. Other columns don't
    matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(Path(path).read_text())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = compiled(spec.value)
        for part in parts:
            texts = [t or "" for t in part["text"]]
            n = np.array(tokenizer.counts(texts), np.int64)
            sizes = np.array([len(t.encode()) for t in texts], np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": sizes, "n_tokens": n, "over_limit": n > limit})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
