"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The texts of a batch become one flat array of symbols.  Two neighbouring characters that stand side by side in no piece
can never be merged, so texts fall into words there; equal words are encoded once per batch.  In a round every word finds
the lowest rank among its pairs (a segmented minimum), merges all its pairs of that rank at once, leftmost first
where they overlap, and the arrays are compacted.  Words without a pair leave; rounds go on until none is left.

The library merges one pair at a time.  Merging all pairs of the lowest rank at once gives the same result unless a merge
brings forth a pair that ranks no worse than itself; where it does, the word merges its leftmost pair only in that round.

Characters outside the vocabulary become byte pieces.  Decoding gathers the pieces' bytes by id; runs of byte pieces
that are not UTF-8 become U+FFFD, byte by byte.

Models: BPE with byte fallback and without a normalisation table or unused pieces; others raise.  User-defined pieces are not
told apart from learned ones.

Defined results: a null or empty text is the end id alone (nothing, without an end id) and decodes to an empty text; bytes
that are not UTF-8 count as U+FFFD each; rows that share a document id are encoded row by row; a null id stays null; an empty
table gives an empty result; other columns are ignored.  A text of any length is encoded whole, in one task.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .ship import map_arrow, resident
from .words import slices, text_bytes

SPACE = "▁"
NEVER = np.iinfo(np.int32).max  # the rank of a pair that is no piece
CODE_POINTS = 0x110000
SLICE = 1 << 21  # bytes of text encoded at once
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: text on which a model that changes more than spaces gives itself away
PROBE = " ﬁ  Ａ　b\téé​ "


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("shiftboard-each-byte", _each_byte)


class PairTable:
    """Rank and result of each pair of symbols that forms a piece: open addressing, looked up in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, symbols: int):
        self.symbols = np.uint64(symbols)
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NEVER, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        keys = self._key(left, right)
        for key, at, r, m in zip(keys.tolist(), self._home(keys).tolist(), rank.tolist(), merged.tolist()):
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) & self.mask
            self.keys[at], self.rank[at], self.merged[at] = key, r, m

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) * self.symbols + right.astype(np.uint64)).astype(np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair is in the table, or an empty place, whose rank is ``NEVER``."""
        keys = self._key(left, right)
        at = self._home(keys)
        held = self.keys[at]
        seek = np.flatnonzero((held != keys) & (held >= 0))
        while len(seek):
            at[seek] = (at[seek] + 1) & self.mask
            held = self.keys[at[seek]]
            seek = seek[(held != keys[seek]) & (held >= 0)]
        return at


class Model:
    """A vocabulary as arrays.  Symbols are piece ids; a character that is no piece is ``size`` + its code point."""

    def __init__(self, content: bytes):
        own = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size, self.end = own.vocab_size(), own.eos_id()
        every = range(self.size)
        if own.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("only models without normalisation and with a leading space")
        if any(own.is_unused(i) for i in every):
            raise ValueError("unused pieces are not supported")
        byte = np.array([own.is_byte(i) for i in every])
        if byte.sum() != 256:
            raise ValueError("only models with byte fallback")
        self.control = np.array([own.is_control(i) for i in every])
        self.byte, self.byte_ids = byte, np.flatnonzero(byte)
        plain = [i for i in every if not (byte[i] or self.control[i] or own.is_unknown(i))]
        names = {own.id_to_piece(i): i for i in plain}
        scores = {i: own.get_score(i) for i in plain}
        level = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}

        def symbol(part: str) -> int | None:
            return names.get(part, self.size + ord(part) if len(part) == 1 else None)

        pairs, beside = [], set()
        for name, i in names.items():
            beside.update(zip(name, name[1:]))
            for cut in range(1, len(name)):
                left, right = symbol(name[:cut]), symbol(name[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right, level[scores[i]], i))
        columns = np.array(pairs, np.int64).reshape(-1, 4).T
        self.pairs = PairTable(*columns, self.size + CODE_POINTS)
        self.symbol_of = np.arange(self.size, self.size + CODE_POINTS, dtype=np.int32)
        for name, i in names.items():
            if len(name) == 1:
                self.symbol_of[ord(name)] = i
        # characters beside another one in some piece have a class of their own, all others share class 0
        chars = sorted({c for pair in beside for c in pair})
        self.class_of = np.zeros(CODE_POINTS, np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in beside:
            self.beside[self.class_of[ord(a)], self.class_of[ord(b)]] = True
        texts = [own.id_to_piece(i).replace(SPACE, " ").encode() for i in every]
        for n, i in enumerate(self.byte_ids.tolist()):
            texts[i] = bytes([n])
        unknown = own.decode([own.unk_id()]).encode()
        texts = [b"" if self.control[i] else unknown if own.is_unknown(i) else x for i, x in enumerate(texts)]
        self.leads = np.array([not byte[i] and own.id_to_piece(i).startswith(SPACE) for i in every])
        self.texts = pa.array(texts, pa.large_binary())
        self.decimals = pa.array([b"%d " % i for i in every], pa.large_binary())


def read_model(content: bytes) -> Model:
    """One model per worker process and content."""
    return resident(f"pieces-{hashlib.sha256(content).hexdigest()}", lambda: Model(content))


def merge_rounds(symbols: np.ndarray, bounds: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each word after all merges, and their bounds.  ``bounds``: words + 1, no word is empty."""
    words = len(bounds) - 1
    symbols, word = symbols.astype(np.int64), np.repeat(np.arange(words), np.diff(bounds))
    rank = np.full(len(symbols), NEVER, np.int32)

    def rerank(at: np.ndarray) -> None:
        """The rank of the pairs that begin at these places."""
        at = at[at >= 0]
        next_ = np.minimum(at + 1, len(symbols) - 1)
        found = pairs.rank[pairs.places(symbols[at], symbols[next_])]
        rank[at] = np.where((word[at] == word[next_]) & (next_ > at), found, NEVER)

    rerank(np.arange(len(symbols)))
    out_word, out_symbol = [], []
    while len(symbols):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        sizes = np.diff(starts, append=len(symbols))
        low = np.minimum.reduceat(rank, starts)
        done = low == NEVER
        if done.any():
            leaves = np.repeat(done, sizes)
            out_word.append(word[leaves])
            out_symbol.append(symbols[leaves])
            symbols, word, rank = symbols[~leaves], word[~leaves], rank[~leaves]
            low, sizes = low[~done], sizes[~done]
            if not len(symbols):
                break
        lows = np.repeat(low, sizes)
        at = np.flatnonzero(rank == lows)
        # of pairs that overlap, every other one from the left
        number = np.arange(len(at))
        fresh = np.diff(at, prepend=-2) != 1
        at = at[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]
        made = pairs.merged[pairs.places(symbols[at], symbols[at + 1])].astype(np.int64)
        # pairs that a merge brings forth before the next one happens
        left = np.maximum(at - 1, 0)
        before = symbols[left]
        joined = np.flatnonzero(np.diff(at, prepend=-9) == 2)
        before[joined] = made[joined - 1]
        right = np.minimum(at + 2, len(symbols) - 1)
        new_left = np.where((at > 0) & (word[left] == word[at]), pairs.rank[pairs.places(before, made)], NEVER)
        new_right = np.where((at + 2 < len(symbols)) & (word[right] == word[at]), pairs.rank[pairs.places(made, symbols[right])], NEVER)
        early = np.minimum(new_left, new_right) <= lows[at]
        if early.any():
            single = np.isin(word[at], word[at[early]])
            first = np.diff(word[at], prepend=-1) != 0
            at, made = at[~single | first], made[~single | first]
        symbols[at] = made
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, word, rank = symbols[stays], word[stays], rank[stays]
        now = at - np.arange(len(at))  # one symbol went for each merge before
        rerank(np.union1d(now, now - 1))
    if not out_word:
        return np.zeros(0, np.int64), np.zeros(words + 1, np.int64)
    flat_word, flat = np.concatenate(out_word), np.concatenate(out_symbol)
    ends = np.concatenate([[0], np.cumsum(np.bincount(flat_word, minlength=words))])
    return flat[np.argsort(flat_word, kind="stable")], ends


def byte_pieces(symbols: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids: symbols that are no piece become the byte pieces of their character."""
    point = symbols - model.size
    outside = point >= 0
    if not outside.any():
        return symbols, bounds
    wide = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
    size = np.where(outside, wide, 1)
    ends = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(np.arange(len(symbols)), size)
    place = np.arange(ends[-1]) - ends[source]
    point, wide = point[source], size[source]
    bits = np.maximum(point, 0) >> (6 * (wide - 1 - place))
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide] | bits
    value = np.where(place == 0, np.where(wide == 1, bits, lead), 0x80 | (bits & 0x3F))
    return np.where(outside[source], model.byte_ids[value & 0xFF], symbols[source]), ends[bounds]


def _gather(values: pa.Array, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The chosen values' bytes in a row, and their bounds."""
    taken = values.take(pa.array(at))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
    data = taken.buffers()[2]
    return memoryview(data if data is not None else b""), offsets


def _valid(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Texts as valid UTF-8."""
    whole = data.tobytes()
    try:
        whole.decode()
        return whole, offsets
    except UnicodeDecodeError:
        texts = [whole[a:b].decode("utf-8", "shiftboard-each-byte").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return b"".join(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def encode_slice(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts in a row, without end ids, and their bounds."""
    whole, offsets = _valid(data, offsets)
    n = len(offsets) - 1
    begins = np.frombuffer(whole, np.uint8) & 0xC0 != 0x80
    chars = np.concatenate([[0], np.cumsum(begins)])[offsets]
    points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
    points = np.where(points == 0x20, np.uint32(ord(SPACE)), points)
    filled = np.diff(chars) > 0
    points = np.insert(points, chars[:-1][filled], np.uint32(ord(SPACE)))
    chars = chars + np.concatenate([[0], np.cumsum(filled)])
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    kind = model.class_of[points]
    cut = np.ones(len(points), bool)
    cut[1:] = ~model.beside[kind[:-1], kind[1:]]
    cut[chars[:-1][filled]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts, len(points))
    # equal words are encoded once
    buffers = [None, pa.py_buffer((4 * ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(points))]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    which = coded.indices.to_numpy()
    _, at, held = coded.dictionary.buffers()
    bounds = np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1] // 4
    symbols = model.symbol_of[np.frombuffer(held, np.uint32)[: bounds[-1]]]
    ids, bounds = byte_pieces(*merge_rounds(symbols, bounds, model.pairs), model)
    packed = [None, pa.py_buffer((4 * bounds).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]
    flat, word_ends = _gather(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, packed), which)
    flat = np.frombuffer(flat, "<u4").astype(np.int64)
    return flat, (word_ends // 4)[np.searchsorted(starts, chars)]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """One end id after each text."""
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))


def decode_flat(ids: np.ndarray, bounds: np.ndarray, model: Model) -> list[bytes]:
    """The text of each run of ids, as UTF-8."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < model.size:
        raise ValueError(f"ids must be from 0 to {model.size - 1}")
    data, ends = _gather(model.texts, ids)
    real = np.flatnonzero(~model.control[ids])
    at = np.searchsorted(real, bounds)
    byte_before = np.concatenate([[0], np.cumsum(model.byte[ids])])
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        start, stop = int(ends[a]), int(ends[b])
        if at[i] < at[i + 1] and model.leads[ids[real[at[i]]]]:
            start += 1  # the space that encoding put before the text
        text = bytes(data[start:stop])
        if byte_before[b] > byte_before[a]:
            # a control piece ends a run of byte pieces
            cuts = [start, *(int(ends[c]) for c in a + np.flatnonzero(model.control[ids[a:b]])), stop]
            runs = [text[max(x - start, 0) : max(y - start, 0)] for x, y in zip(cuts, cuts[1:])]
            text = "".join(x.decode("utf-8", "shiftboard-each-byte") for x in runs).encode()
        out.append(text)
    return out


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))


def _encoded(column: pa.Array, model: Model, end: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, bounds) of slices of a text column."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, SLICE):
        part = offsets[a : b + 1]
        ids, bounds = encode_slice(data[part[0] : part[-1]], part - part[0], model)
        yield a, b, *(with_end(ids, bounds, model.end) if end else (ids, bounds))


def encode(documents: DataFrame, model: bytes, *, end: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = read_model(model)
        for batch in batches:
            for a, b, ids, bounds in _encoded(batch.column("text"), own, end):
                packed = [None, pa.py_buffer((4 * bounds).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, packed).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(np.diff(bounds)), rows], ["id", "n_tokens", "ids"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return map_arrow(_texts(documents, doc_id, text), step, f"id {kind}, n_tokens bigint, ids binary", keeps=True)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Per row of ``encode``: id, text.  A null list of ids is an empty text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = read_model(model)
        for batch in batches:
            data, offsets = text_bytes(batch.column("ids").fill_null(b""))
            for a, b in slices(offsets, SLICE):
                ids = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), "<u4").astype(np.int64)
                texts = decode_flat(ids, (offsets[a : b + 1] - offsets[a]) // 4, own)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return map_arrow(encoded.select("id", "ids"), step, f"id {kind}, text string", keeps=True)


def round_trip(documents: DataFrame, model: bytes, *, end: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, n_tokens, ids_sha256 (of the ids in decimal, joined by spaces), decoded_sha256.

    Ids are encoded and decoded again in one pass.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = read_model(model)
        for batch in batches:
            for a, b, ids, bounds in _encoded(batch.column("text"), own, end):
                digits, ends = _gather(own.decimals, ids)
                spans = ends[bounds].tolist()
                coded = [hashlib.sha256(digits[x : max(x, y - 1)]).hexdigest() for x, y in zip(spans, spans[1:])]
                decoded = [hashlib.sha256(x).hexdigest() for x in decode_flat(ids, bounds, own)]
                columns = [batch.column("id").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(coded), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return map_arrow(_texts(documents, doc_id, text), step, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", keeps=True)
