"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks of ``BLOCK`` that are coded side by side, one numpy lane each; a block starts with empty models
and carries a checksum, so it can be read, and fails, by itself.

Each id is first coded as one of three kinds: what followed the last two ids before (order 2), what followed the last id
(order 1), or neither.  The kinds' probabilities mix two adaptive counts: given how often the order-2 and the order-1 guess
held, and without context.  An id that was not guessed is coded by its order-0 probability: a tree of four levels of 16, each
node with adaptive cumulative probabilities that move towards what comes, fast at first and more slowly with every visit.

Symbols that are no ids but places in a list, such as the words of a chunk, may be millions: ``encode_mixed`` codes them by the same
kinds, guesses and adaptive counts, which its small blocks share (``Mixture``), so that they are read together.  ``encode_counted`` is for
symbols without an order: it codes them by how often each comes, with the counts in front.

All arithmetic is in integers, so a file reads the same on any machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 16_384
SLOTS = 1024  # contexts of a lane's order-1 and order-2 guesses
NONE = 0xFFFF
WORD, ONE = np.uint64(16), np.uint64(1)
WIDTH = np.uint64(1 << 60)  # the coder's interval; words of 16 bits leave at its top
TOP, BOTTOM = np.uint64(1 << 44), np.uint64(1 << 28)
KINDS = 3
STEP = 24  # added to the count of a kind that came
MOST, EVERY = 1500, 16  # rows of counts beyond this sum are halved, every so many ids
LONGER = np.array([1, 2, 3, 3], np.int32)
ADDED = np.array([[STEP * (j > k) for j in range(KINDS + 1)] for k in range(KINDS)], np.uint64)
LEVELS = ((12, 0), (8, 1), (4, 17), (0, 273))  # of the order-0 tree: shift, first node
NODES = 273 + (1 << 12)
UNIT_BITS = 12
UNIT = 1 << UNIT_BITS  # what a node's probabilities sum up to
LEAST = 2  # of them stay with every symbol
EVEN = np.arange(17, dtype=np.int16) * (UNIT // 16)
TOWARDS = np.array([[i * LEAST if i <= s else UNIT - (16 - i) * LEAST for i in range(17)] for s in range(16)], np.int16)
SLOWEST = 5  # a node moves by 1 / 2, 1 / 4, ... of the way, and by 1 / 32 from then on
PAIR = np.uint64(2 * UNIT_BITS)
MAGIC = b"TKR2"
HEAD, ENTRY = "<4sQII", "<II"


class Model:
    """Guesses and counts of all lanes, in flat arrays.

    A row of counts is kept as its running sums, 0 first, so a kind's bounds are two neighbours of the row.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.slots, self.contexts, self.ends_at = lane * SLOTS, lane * 16, lane * (KINDS + 1)
        self.one = np.full(lanes * SLOTS, NONE << 2, np.int32)  # id << 2 | times it held
        self.two = np.full(lanes * SLOTS, NONE << 2, np.int32)
        self.given = np.tile(np.arange(KINDS + 1, dtype=np.uint64), (lanes * 16, 1))  # by how often both guesses held
        self.plain = np.tile(np.arange(KINDS + 1, dtype=np.uint64), (lanes, 1))
        self.hash_one = self.hash_two = np.zeros(lanes, np.int32)
        self.done = 0

    def guess(self) -> None:
        self.at_one = self.slots + (self.hash_one >> 3 & (SLOTS - 1))
        self.at_two = self.slots + ((self.hash_one ^ self.hash_two) >> 2 & (SLOTS - 1))
        one, two = self.one.take(self.at_one), self.two.take(self.at_two)
        self.held_one, self.held_two = one & 3, two & 3
        self.guess_one, self.guess_two = one >> 2, two >> 2
        self.context = self.contexts + (self.held_two << 2 | self.held_one)
        self.row = self.given.take(self.context, axis=0)
        self.ends = self.row + self.plain
        self.total = self.ends[:, KINDS]

    def bounds(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and size of a kind in the counts."""
        at, flat = self.ends_at + kinds, self.ends.ravel()
        first = flat.take(at)
        return first, flat.take(at + 1) - first

    def learn(self, ids: np.ndarray, kinds: np.ndarray) -> None:
        shifted = ids << 2
        self.one[self.at_one] = shifted | np.where(self.guess_one == ids, LONGER.take(self.held_one), 0)
        self.two[self.at_two] = shifted | np.where(kinds == 0, LONGER.take(self.held_two), 0)
        more = ADDED.take(kinds, axis=0)
        self.given[self.context] = self.row + more
        self.plain += more
        self.hash_two, self.hash_one = self.hash_one * 5, ids * 40503
        self.done += 1
        if self.done % EVERY == 0:
            for sums in (self.given, self.plain):
                full = np.flatnonzero(sums[:, KINDS] > MOST)
                sums[full] = (sums[full] >> np.uint64(1)) + np.arange(KINDS + 1, dtype=np.uint64)


class Tree:
    """Order-0 probabilities of all lanes: cumulative, by node."""

    def __init__(self, lanes: int):
        self.rows = np.tile(EVEN, (lanes * NODES, 1))
        self.speed = np.ones(lanes * NODES, np.int16)

    def open(self, lanes: np.ndarray, level: int, before: np.ndarray) -> None:
        """Look at the lanes' nodes of a level; ``before``: the digits so far as one number."""
        self.at = lanes * NODES + (LEVELS[level][1] + before)
        self.row = self.rows.take(self.at, axis=0)
        self.row_at = np.arange(len(lanes)) * 17

    def find(self, value: np.ndarray) -> np.ndarray:
        """The digit whose bounds hold the value."""
        return (self.row[:, 1:] <= value.astype(np.int16)[:, None]).sum(axis=1)

    def use(self, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and size of the digit; the nodes move towards it."""
        at, flat = self.row_at + digit, self.row.ravel()
        first = flat.take(at)
        size = flat.take(at + 1) - first
        speed = self.speed.take(self.at)
        self.row += (TOWARDS.take(digit, axis=0) - self.row) >> speed[:, None]
        self.rows[self.at] = self.row
        self.speed[self.at] = np.minimum(speed + 1, SLOWEST)
        return first.astype(np.uint64), size.astype(np.uint64)


class Coder:
    """The interval of every lane; ``narrow`` is the same for writing and reading."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.width = np.full(lanes, WIDTH, np.uint64)

    def narrow(self, at: np.ndarray, part: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Lanes ``at`` go on with ``size`` parts from the ``first`` one."""
        low, width = self.low[at] + part * first, part * size
        self.low[at], self.width[at] = low, width
        self.renew(at[(width < BOTTOM) | ((low ^ (low + width)) < TOP)])

    def narrow_all(self, part: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """``narrow`` of every lane."""
        self.low += part * first
        self.width = part * size
        self.renew(np.flatnonzero((self.width < BOTTOM) | ((self.low ^ (self.low + self.width)) < TOP)))

    def renew(self, go: np.ndarray) -> None:
        """Shift words out of the lanes ``go`` until their intervals are wide enough."""
        while go.size:
            low, width = self.low[go], self.width[go]
            # an interval that straddles a boundary is cut there
            straddles = (low ^ (low + width)) >= TOP
            width = np.where(straddles, (BOTTOM - (low & (BOTTOM - ONE))) & (BOTTOM - ONE), width) << WORD
            self.shift(go, low)
            low = low << WORD & (WIDTH - ONE)
            self.low[go], self.width[go] = low, width
            go = go[(width < BOTTOM) | ((low ^ (low + width)) < TOP)]


class Writer(Coder):
    def __init__(self, lanes: int, words: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, words), np.uint16)
        self.at = np.zeros(lanes, np.int64)

    def shift(self, go: np.ndarray, low: np.ndarray) -> None:
        at = self.at[go]
        if int(at.max()) >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[go, at] = (low >> np.uint64(44)).astype(np.uint16)
        self.at[go] = at + 1

    def close(self) -> list[bytes]:
        for _ in range(4):
            self.shift(np.arange(len(self.low)), self.low)
            self.low = self.low << WORD & (WIDTH - ONE)
        return [self.out[i, :n].astype("<u2").tobytes() for i, n in enumerate(self.at.tolist())]


class Reader(Coder):
    def __init__(self, blocks: list[bytes]):
        super().__init__(len(blocks))
        self.words = np.zeros((len(blocks), max(map(len, blocks)) // 2 + 4), np.uint16)
        for i, b in enumerate(blocks):
            self.words[i, : len(b) // 2] = np.frombuffer(b, "<u2")
        w = self.words[:, :4].astype(np.uint64)
        # 60 bits: three words and the first 12 bits of the fourth, whose last four are not of the interval yet
        self.code = w[:, 0] << np.uint64(44) | w[:, 1] << np.uint64(28) | w[:, 2] << np.uint64(12) | w[:, 3] >> np.uint64(4)
        self.at = np.full(len(blocks), 3)

    def value(self, at: np.ndarray, part: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which part of the interval the code is in; within bounds also in a damaged block."""
        return np.minimum((self.code[at] - self.low[at]) // part, most)

    def shift(self, go: np.ndarray, _: np.ndarray) -> None:
        at = np.minimum(self.at[go], self.words.shape[1] - 2)  # past the end only in a damaged block
        low, high = self.words[go, at].astype(np.uint64), self.words[go, at + 1].astype(np.uint64)
        more = (low & np.uint64(15)) << np.uint64(12) | high >> np.uint64(4)
        self.code[go] = (self.code[go] << WORD | more) & (WIDTH - ONE)
        self.at[go] = at + 1


UNIT_64, LAST_PAIR = np.uint64(UNIT), np.uint64((1 << 2 * UNIT_BITS) - 1)


def _write_literals(writer: Writer, tree: Tree, lanes: np.ndarray, ids: np.ndarray) -> None:
    """Two digits at a time."""
    for level in (0, 2):
        first, size = [], []
        for l in (level, level + 1):
            shift = LEVELS[l][0]
            tree.open(lanes, l, ids >> (shift + 4))
            f, s = tree.use(ids >> shift & 15)
            first.append(f)
            size.append(s)
        writer.narrow(lanes, writer.width[lanes] >> PAIR, first[0] * UNIT_64 + size[0] * first[1], size[0] * size[1])


def _read_literals(reader: Reader, tree: Tree, lanes: np.ndarray) -> np.ndarray:
    ids = np.zeros(len(lanes), np.int64)
    for level in (0, 2):
        part = reader.width[lanes] >> PAIR
        value = reader.value(lanes, part, LAST_PAIR)
        tree.open(lanes, level, ids)
        digit = tree.find(value >> np.uint64(UNIT_BITS))
        first, size = tree.use(digit)
        ids = ids << 4 | digit
        tree.open(lanes, level + 1, ids)
        digit = tree.find((value - first * UNIT_64) // size)
        inner, share = tree.use(digit)
        ids = ids << 4 | digit
        reader.narrow(lanes, part, first * UNIT_64 + size * inner, size * share)
    return ids


def encode(ids: np.ndarray) -> bytes:
    """Ids below 65535 as a self-describing run of blocks; others raise ValueError."""
    n = len(ids)
    if n and not 0 <= int(ids.min()) <= int(ids.max()) < NONE:
        raise ValueError(f"ids must be from 0 to {NONE - 1}, found {ids.min()} to {ids.max()}")
    steps, lanes = min(BLOCK, n), -(-n // BLOCK)
    head = struct.pack(HEAD, MAGIC, n, BLOCK, lanes)
    if not lanes:
        return head
    grid = np.zeros((lanes, steps), np.int32)
    grid.ravel()[:n] = ids
    model, tree, writer, every = Model(lanes), Tree(lanes), Writer(lanes, steps // 2 + 64), np.arange(lanes)
    for now in np.ascontiguousarray(grid.T):
        model.guess()
        kinds = np.where(now == model.guess_two, 0, np.where(now == model.guess_one, 1, 2))
        writer.narrow(every, writer.width // model.total, *model.bounds(kinds))
        lit = np.flatnonzero(kinds == 2)
        if len(lit):
            _write_literals(writer, tree, lit, now[lit])
        model.learn(now, kinds)
    blocks = writer.close()
    grid = grid.astype("<u4")
    table = b"".join(struct.pack(ENTRY, len(b), zlib.crc32(grid[i])) for i, b in enumerate(blocks))
    return head + table + b"".join(blocks)


def decode(data: bytes) -> np.ndarray:
    """The ids of ``encode``; a block that does not match its checksum raises ValueError."""
    magic, n, block, lanes = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    if not lanes:
        return np.zeros(0, np.uint32)
    at, width = struct.calcsize(HEAD), struct.calcsize(ENTRY)
    entries = [struct.unpack_from(ENTRY, data, at + width * i) for i in range(lanes)]
    at += width * lanes
    blocks = []
    for size, _ in entries:
        blocks.append(data[at : at + size])
        at += size
    columns = np.zeros((min(block, n), lanes), np.int32)
    model, tree, reader, every = Model(lanes), Tree(lanes), Reader(blocks), np.arange(lanes)
    for now in columns:
        model.guess()
        part = reader.width // model.total
        count, ends = reader.value(every, part, model.total - ONE), model.ends
        kinds = (count >= ends[:, 1]).astype(np.int64) + (count >= ends[:, 2])
        reader.narrow(every, part, *model.bounds(kinds))
        now[:] = np.where(kinds == 0, model.guess_two, model.guess_one)
        lit = np.flatnonzero(kinds == 2)
        if len(lit):
            now[lit] = _read_literals(reader, tree, lit)
        model.learn(now, kinds)
    grid = np.ascontiguousarray(columns.T).astype("<u4")
    for i, (_, checksum) in enumerate(entries):
        if zlib.crc32(grid[i]) != checksum:
            raise ValueError(f"block {i} is damaged")
    return grid.ravel()[:n].astype(np.uint32)


COUNTED_BLOCK = 2048
MOST_COUNTED = 1 << 24  # what counts sum up to, unless there are more symbols
COUNTED_MAGIC = b"TKC1"
COUNTED_HEAD = "<4sQIII"


def _bounds(counts: np.ndarray) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """Total, first and size of every symbol."""
    sizes = counts.astype(np.uint64)
    ends = np.cumsum(sizes)
    return ends[-1], ends - sizes, sizes


def encode_counted(symbols: np.ndarray) -> bytes:
    """Symbols from 0 as their counts and a run of blocks; negative ones raise ValueError."""
    n = len(symbols)
    counts = np.bincount(symbols) if n else np.zeros(0, np.int64)
    while counts.sum() > MOST_COUNTED and counts.max() > 1:
        counts = (counts + 1) >> 1
    if counts.sum() >= int(BOTTOM):
        raise ValueError(f"too many symbols: {len(counts)}")
    table = zlib.compress(counts.astype("<u4").tobytes())
    steps, lanes = min(COUNTED_BLOCK, n), -(-n // COUNTED_BLOCK)
    head = struct.pack(COUNTED_HEAD, COUNTED_MAGIC, n, COUNTED_BLOCK, lanes, len(table)) + table
    if not lanes:
        return head
    total, firsts, sizes = _bounds(counts)
    grid = np.full((lanes, steps), symbols[0], np.int32)
    grid.ravel()[:n] = symbols
    writer = Writer(lanes, steps + 8)
    for now in np.ascontiguousarray(grid.T):
        writer.narrow_all(writer.width // total, firsts.take(now), sizes.take(now))
    blocks = writer.close()
    grid = grid.astype("<u4", copy=False)
    entries = b"".join(struct.pack(ENTRY, len(b), zlib.crc32(grid[i])) for i, b in enumerate(blocks))
    return head + entries + b"".join(blocks)


def decode_counted(data: bytes) -> np.ndarray:
    """The symbols of ``encode_counted``; damage raises ValueError."""
    magic, n, block, lanes, size = struct.unpack_from(COUNTED_HEAD, data)
    if magic != COUNTED_MAGIC:
        raise ValueError("not a run of counted symbols")
    if not lanes:
        return np.zeros(0, np.int32)
    at, width = struct.calcsize(COUNTED_HEAD), struct.calcsize(ENTRY)
    try:
        counts = np.frombuffer(zlib.decompress(data[at : at + size]), "<u4")
    except zlib.error as e:
        raise ValueError("the counts are damaged") from e
    at += size
    entries = [struct.unpack_from(ENTRY, data, at + width * i) for i in range(lanes)]
    at += width * lanes
    blocks = []
    for size, _ in entries:
        blocks.append(data[at : at + size])
        at += size
    total, firsts, sizes = _bounds(counts)
    held = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    columns = np.zeros((min(block, n), lanes), np.int32)
    reader = Reader(blocks)
    for now in columns:
        part = reader.width // total
        held.take(np.minimum((reader.code - reader.low) // part, total - ONE).view(np.int64), out=now, mode="clip")
        reader.narrow_all(part, firsts.take(now), sizes.take(now))
    grid = np.ascontiguousarray(columns.T).astype("<u4", copy=False)
    for i, (_, checksum) in enumerate(entries):
        if zlib.crc32(grid[i]) != checksum:
            raise ValueError(f"block {i} is damaged")
    return grid.ravel()[:n]


MIXED_BLOCK = 1024
MIXED_MAGIC = b"TKM1"
MIXED_HEAD = "<4sQQII"
MOST_SYMBOLS = 1 << 23
LONG, LONG_WORD, LOW_WORD = np.uint64(1 << 32), np.uint64(32), np.uint64((1 << 32) - 1)
PAIRS = 1 << 20  # places of guesses after the last two symbols
CONTEXTS = 32  # how often each guess held, and whether both are the same
KIND_BITS = 12
GAIN, FADE = 64, 4  # a kind that came adds 64 to its count, and a step takes 1 / 16 of all counts
PLAIN = 12  # the counts of all contexts join those of one by 1 / 4096


class Mixture:
    """What the symbols of all lanes have shown so far, for the next symbol of each.

    All lanes learn together, step by step: what followed a symbol, or two, in one lane (the last of several) is the guess of all from the next step on.  The kinds'
    probabilities are adaptive counts given how often the guesses held.  A symbol that was not guessed has an order-0 probability, by adaptive
    counts that are taken up whenever the number of steps has doubled; before, the n-th symbol counts 1 / n times as much as the first.
    """

    def __init__(self, symbols: int, lanes: int):
        self.symbols = symbols
        # by the last symbol: what followed << 2 | times it held; at first a guess of none, which comes only in a damaged block
        self.one = np.full(symbols + 1, symbols << 2, np.int32)
        self.two = np.full(PAIRS, symbols << 2, np.int32)
        self.last, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.kinds = np.full((CONTEXTS, KINDS), GAIN, np.int64)
        self.bits = max(16, symbols.bit_length() + 2)
        # an interval of 2 ** 32 can be cut into the kinds' parts, and each of them into those of all symbols
        self.kind_bits = min(KIND_BITS, 32 - self.bits)
        self.counts, self.done = np.zeros(symbols + 1, np.int64), 0
        self.missed: list[np.ndarray] = []
        self._take_up()

    def _take_up(self) -> None:
        whole = 1 << self.bits
        weights = self.counts[: self.symbols] * 64 + 8 * self.symbols // np.arange(1, self.symbols + 1) + 1
        sizes = weights * (whole - self.symbols) // int(weights.sum()) + 1
        sizes[0] += whole - int(sizes.sum())
        self.sizes = sizes
        # first << 32 | size; a symbol that was guessed is the one after the last, which takes the interval whole
        self.spans = np.append((np.cumsum(sizes) - sizes) << 32 | sizes, whole).astype(np.uint64)
        self.held = None

    def guess(self) -> None:
        self.at_two = (self.last * np.int32(40503) ^ self.before * np.int32(30011)) & np.int32(PAIRS - 1)
        one, two = self.one.take(self.last), self.two.take(self.at_two)
        self.held_one, self.held_two = one & 3, two & 3
        self.guess_one, self.guess_two = one >> 2, two >> 2
        self.context = (self.held_two << 2 | self.held_one) << 1 | (self.guess_one == self.guess_two)
        self.row = self.context * np.int32(KINDS)
        mixed = self.kinds + (self.kinds.sum(axis=0) >> PLAIN)
        # 1 at least for each kind
        sizes = mixed * ((1 << self.kind_bits) - KINDS) // mixed.sum(axis=1, keepdims=True) + 1
        sizes[:, 2] += (1 << self.kind_bits) - sizes.sum(axis=1)
        self.kind_firsts = (np.cumsum(sizes, axis=1) - sizes).astype(np.uint64)
        self.kind_spans = self.kind_firsts << LONG_WORD | sizes.astype(np.uint64)

    def learn(self, now: np.ndarray, kinds: np.ndarray, missed: np.ndarray) -> None:
        """``kinds``: places of the symbols' kinds in the counts, by context."""
        shifted = now << 2
        self.one[self.last] = shifted | np.minimum(self.held_one + 1, 3) * (self.guess_one == now)
        self.two[self.at_two] = shifted | np.minimum(self.held_two + 1, 3) * (self.guess_two == now)
        came = np.bincount(kinds, minlength=CONTEXTS * KINDS).reshape(CONTEXTS, KINDS)
        self.kinds += came * GAIN - (self.kinds >> FADE) + 1
        self.before, self.last = self.last, now
        self.missed.append(missed)
        self.done += 1
        if self.done & (self.done - 1) == 0:
            self.counts += np.bincount(np.concatenate(self.missed), minlength=self.symbols + 1)
            self.missed = []
            self._take_up()

    def find(self, value: np.ndarray) -> np.ndarray:
        """The symbols whose bounds hold the values; within bounds also in a damaged block."""
        if self.held is None:
            self.held = np.repeat(np.arange(self.symbols, dtype=np.int32), self.sizes)
        return self.held.take(value.view(np.int64), mode="clip")


class LongCoder:
    """Intervals of 64 bits, of which words of 32 bits leave at the top; each is 2 ** 32 wide at least between symbols."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.width = np.full(lanes, LOW_WORD << LONG_WORD, np.uint64)

    def narrow(self, bits: int, spans: np.ndarray) -> None:
        """Of 2 ** ``bits`` parts, all lanes go on with those of their span (first << 32 | size)."""
        part = self.width >> np.uint64(bits)
        self.low += part * (spans >> LONG_WORD)
        self.width = part * (spans & LOW_WORD)

    def renew(self) -> None:
        go = np.flatnonzero((self.width < LONG) | ((self.low ^ (self.low + self.width)) < LONG))
        if go.size:
            low, width = self.low[go], self.width[go]
            # an interval that straddles a boundary is cut there
            width = np.where((low ^ (low + width)) >= LONG, LONG - (low & LOW_WORD), width)
            self.shift(go, low)
            self.low[go], self.width[go] = low << LONG_WORD, width << LONG_WORD


class LongWriter(LongCoder):
    def __init__(self, lanes: int, words: int):
        super().__init__(lanes)
        self.out, self.at, self.most = np.zeros((lanes, words), "<u4"), np.arange(lanes) * words, 0

    def shift(self, go: np.ndarray, low: np.ndarray) -> None:
        lanes, words = self.out.shape
        if self.most == words:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
            self.at += np.arange(lanes) * words
        at = self.at[go]
        self.out.ravel()[at] = low >> LONG_WORD
        self.at[go] = at + 1
        self.most += 1  # words of a lane at most

    def close(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(2):
            self.shift(every, self.low)
            self.low = self.low << LONG_WORD
        sizes = self.at - every * self.out.shape[1]
        return [self.out[i, :n].tobytes() for i, n in enumerate(sizes.tolist())]


class LongReader(LongCoder):
    def __init__(self, blocks: list[bytes]):
        super().__init__(len(blocks))
        words = max(map(len, blocks)) // 4 + 2
        self.words = np.zeros((len(blocks), words), np.uint64)
        for i, b in enumerate(blocks):
            self.words[i, : len(b) // 4] = np.frombuffer(b, "<u4", len(b) // 4)
        self.code = self.words[:, 0] << LONG_WORD | self.words[:, 1]
        self.at = np.arange(len(blocks)) * words + 1

    def shift(self, go: np.ndarray, _: np.ndarray) -> None:
        at = self.at[go] + 1
        self.code[go] = self.code[go] << LONG_WORD | self.words.ravel().take(at, mode="clip")  # past the end only in a damaged block
        self.at[go] = at


def encode_mixed(symbols: np.ndarray) -> bytes:
    """Symbols from 0, at best in the order of their counts, as a self-describing run of blocks that are read together."""
    n, most = len(symbols), int(symbols.max()) + 1 if len(symbols) else 0
    if n and (int(symbols.min()) < 0 or most > MOST_SYMBOLS):
        raise ValueError(f"symbols must be from 0 to {MOST_SYMBOLS - 1}, found {symbols.min()} to {symbols.max()}")
    steps, lanes = min(MIXED_BLOCK, n), -(-n // MIXED_BLOCK)
    head = struct.pack(MIXED_HEAD, MIXED_MAGIC, n, most, MIXED_BLOCK, lanes)
    if not lanes:
        return head
    grid = np.full((lanes, steps), symbols[0], np.int32)
    grid.ravel()[:n] = symbols
    model, writer = Mixture(most, lanes), LongWriter(lanes, steps // 2 + 4)
    for now in np.ascontiguousarray(grid.T):
        model.guess()
        # 0 if the order-2 guess is right, 1 if only the order-1 guess is, 2 if neither
        not_two = now != model.guess_two
        not_both = not_two & (now != model.guess_one)
        kinds = model.row + not_two + not_both
        missed = np.where(not_both, now, np.int32(most))
        writer.narrow(model.kind_bits, model.kind_spans.ravel().take(kinds))
        writer.narrow(model.bits, model.spans.take(missed))
        writer.renew()
        model.learn(now, kinds, missed)
    blocks = writer.close()
    grid = grid.astype("<u4", copy=False)
    entries = b"".join(struct.pack(ENTRY, len(b), zlib.crc32(grid[i])) for i, b in enumerate(blocks))
    return head + entries + b"".join(blocks)


def decode_mixed(data: bytes) -> np.ndarray:
    """The symbols of ``encode_mixed``; damage raises ValueError."""
    magic, n, most, block, lanes = struct.unpack_from(MIXED_HEAD, data)
    if magic != MIXED_MAGIC:
        raise ValueError("not a run of mixed symbols")
    if not lanes:
        return np.zeros(0, np.int32)
    at, width = struct.calcsize(MIXED_HEAD), struct.calcsize(ENTRY)
    entries = [struct.unpack_from(ENTRY, data, at + width * i) for i in range(lanes)]
    at += width * lanes
    blocks = []
    for size, _ in entries:
        blocks.append(data[at : at + size])
        at += size
    columns = np.zeros((min(block, n), lanes), np.int32)
    model, reader = Mixture(most, lanes), LongReader(blocks)
    for now in columns:
        model.guess()
        part, inside = reader.width >> np.uint64(model.kind_bits), reader.code - reader.low
        not_two = inside >= part * model.kind_firsts[:, 1].take(model.context)
        not_both = inside >= part * model.kind_firsts[:, 2].take(model.context)
        kinds = model.row + not_two + not_both
        reader.narrow(model.kind_bits, model.kind_spans.ravel().take(kinds))
        found = model.find((reader.code - reader.low) // (reader.width >> np.uint64(model.bits)))
        missed = np.where(not_both, found, np.int32(most))
        now[:] = np.where(not_both, found, np.where(not_two, model.guess_one, model.guess_two))
        reader.narrow(model.bits, model.spans.take(missed))
        reader.renew()
        model.learn(now, kinds, missed)
    grid = np.ascontiguousarray(columns.T).astype("<u4", copy=False)
    for i, (_, checksum) in enumerate(entries):
        if zlib.crc32(grid[i]) != checksum:
            raise ValueError(f"block {i} is damaged")
    return grid.ravel()[:n].astype(np.int32)
