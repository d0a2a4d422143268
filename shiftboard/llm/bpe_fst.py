"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Three facts carry the transducer.  Any run of tokens in a BPE result is itself the BPE result of its bytes; a row of
tokens is a BPE result exactly if each neighbouring pair is; so each prefix of a text has one last token
that continues a valid row.  A state holds what a byte further on may still change: the pending bytes and the
last token of each of their prefixes.  Reading a byte finds the new prefix's last token; tokens that every
possible continuation shares are emitted.  States and arcs are made when first met; when there are ``MOST_STATES``, those
where no two ways part are thrown away, so memory stays bounded on any text.

Texts are cut by the pattern first; each match is encoded by itself.  A match that is a token as a whole is that token.

Defined results: a null text is empty and has no tokens; repeated rows are encoded each; other columns are ignored; an
empty table gives an empty result.  Texts of any length are encoded whole, in time that grows with their length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pieces import Splitter
from .ship import map_arrow, resident

MOST_STATES = 120_000
MOST_PAIRS = 300_000
MOST_PIECES = 150_000  # remembered matches of each of two generations
LONGEST_PIECE = 64  # characters of a match worth remembering


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class State:
    """Pending bytes, and for each of their prefixes its last token and where its tokens end (``rows``: one bit per place).

    ``open``: the places from where on the pending bytes begin a longer token.

    Entry 0 stands for the token before the pending bytes, which is the transducer's one register: states
    that differ in it alone are the same state.  The tokens alone tell states apart, as they spell the bytes.
    """

    __slots__ = ("pending", "tokens", "rows", "open", "arcs", "final")

    def __init__(self, pending: bytes, tokens: tuple[int, ...], rows: tuple[int, ...], open: tuple[int, ...]):
        self.pending, self.tokens, self.rows, self.open = pending, tokens, rows, open
        # byte -> step, a pair (state, decided tokens); or, where a token spans all pending bytes and this one,
        # [that token, step if it may follow the token before, step if not]
        self.arcs: dict[int, tuple | list] = {}
        self.final: tuple[int, ...] | None = None  # tokens of a text that ends here, when first met


def path(tokens, row: int) -> tuple[int, ...]:
    """Tokens that end at the places of a row, but place 0."""
    return tuple([tokens[i] for i in range(1, row.bit_length()) if row >> i & 1])


class Transducer:
    def __init__(self, ranks: dict[bytes, int], less: int = 1):
        self.ranks, self.less = ranks, less
        # of tokens and their beginnings: the token + 1 (0: none) and, as last bit, whether a longer token begins so
        self.known = dict.fromkeys((t[:k] for t in ranks for k in range(1, len(t))), 1)
        self.known |= {t: r + 1 << 1 | self.known.get(t, 0) for t, r in ranks.items()}
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token_bytes[r] = t
        # every byte is a token, and none has a higher rank than longer ones
        single = [ranks.get(bytes([i]), 1 << 30) for i in range(256)]
        self.ordered = max(single) < min((r for t, r in ranks.items() if len(t) > 1), default=1 << 30)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state(b"", (-1,), (1,), ())

    def state(self, pending: bytes, tokens: tuple[int, ...], rows: tuple[int, ...], open: tuple[int, ...]) -> State:
        found = self.states.get(tokens)
        if found is None:
            found = self.states[tokens] = State(pending, tokens, rows, open)
        return found

    def merges(self, piece: bytes, until: int = 1) -> list[bytes]:
        """BPE of a few bytes by its definition: join the neighbours of lowest rank, leftmost first, down to ``until`` parts."""
        none, rank = 1 << 30, self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(ranks) >= until and (least := min(ranks)) < none:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that BPE joins last to make this one, if it does and both are of lower rank; a byte: itself twice."""
        if token not in self.parts:
            b = self.token_bytes[token]
            made = [self.ranks.get(x, -1) for x in ((b, b) if len(b) == 1 else self.merges(b, 2))]
            regular = len(made) == 2 and min(made) >= 0 and (len(b) == 1 or max(made) < token)
            self.parts[token] = tuple(made) if regular else None
        return self.parts[token]

    def apart(self, left: int, right: int) -> bool | None:
        """Whether BPE leaves two tokens side by side; None: not to be told from their halves.

        Merges of both are undone, the latest first.  Before each is undone, the tokens at the boundary stood side by side until
        ``limit``: they would have been joined, if their union is a token of lower rank.
        """
        limit, names, rank = 1 << 30, self.token_bytes, self.ranks.get
        while True:
            union = rank(names[left] + names[right])
            if union is not None and union < limit:
                return False
            sides = (True, False) if left > right else (False, True)  # equal ones: the left one was made first
            for undo_left in sides:
                token = left if undo_left else right
                made = self.halves(token)
                if made is None:
                    return None
                if made[0] == token:  # a byte
                    continue
                if undo_left:
                    limit, left = token, made[1]
                else:
                    limit, right = token + 1, made[0]  # what is further left goes first among equal ranks
                break
            else:
                return True

    def stands(self, left: int, right: int) -> bool:
        """Whether a BPE result may have ``left`` and ``right`` side by side (left -1: ``right`` first)."""
        known = self.pairs.get((left, right))
        if known is None:
            if left >= 0 and self.ordered:
                known = self.apart(left, right)
            if known is None:
                b = self.token_bytes[right]
                row = [b] if left < 0 else [self.token_bytes[left], b]
                known = self.merges(b"".join(row)) == row
            if len(self.pairs) >= MOST_PAIRS // self.less:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def forget(self) -> None:
        """Drop the states that were left by less than two bytes, and steps to them; if too many are left, all."""
        kept = {k: x for k, x in self.states.items() if len(x.arcs) > 1}
        if 2 * len(kept) > MOST_STATES // self.less:
            kept = {}
        for k, x in self.states.items():
            if k not in kept:
                x.arcs.clear()  # no cycles stay
        for x in kept.values():
            for byte, arc in list(x.arcs.items()):
                if type(arc) is list:
                    arc[1:] = [y if y and y[0].tokens in kept else None for y in arc[1:]]
                    gone = arc[1] is arc[2] is None
                else:
                    gone = arc[0].tokens not in kept
                if gone:
                    del x.arcs[byte]
        self.states = kept
        self.start = self.state(b"", (-1,), (1,), ())

    def step(self, s: State, byte: int, whole_stands: bool) -> tuple[State, tuple[int, ...]]:
        """The next state and the tokens that are decided."""
        text, known = s.pending + bytes([byte]), self.known.get
        n, old, old_rows, token, start, open = len(text), s.tokens, s.rows, -1, 0, []
        for p in (*s.open, n - 1):
            found = known(text[p:])
            if found:
                if token < 0 and found > 1 and (self.stands(old[p], (found >> 1) - 1) if p else whole_stands):
                    token, start = (found >> 1) - 1, p
                if found & 1:
                    open.append(p)
        # boundaries that every continuation passes: later tokens start at n or where a longer token may be under way
        row = shared = old_rows[start] | 1 << n
        for p in open:
            shared &= old_rows[p]
        cut = shared.bit_length() - 1
        if cut == 0:
            return self.state(text, (*old, token), (*old_rows, row), tuple(open)), ()
        tokens, rows = (*old, token), (*old_rows, row)
        moved = tuple([x >> cut for x in rows[cut + 1 :]])
        return self.state(text[cut:], (-1, *tokens[cut + 1 :]), (1, *moved), tuple([p - cut for p in open])), path(tokens, rows[cut])

    def arc(self, s: State, byte: int) -> tuple | list:
        if len(self.states) > MOST_STATES // self.less:
            self.forget()
        whole = self.ranks.get(s.pending + bytes([byte]))
        s.arcs[byte] = found = self.step(s, byte, False) if whole is None else [whole, None, None]
        return found

    def follow(self, s: State, byte: int, before: int) -> tuple[State, tuple[int, ...]]:
        """The step of a state that read a byte, after the token ``before``."""
        arc = s.arcs.get(byte)
        if arc is None:
            arc = self.arc(s, byte)
        if type(arc) is not list:
            return arc
        stands = self.pairs.get((before, arc[0]))
        if stands is None:
            stands = self.stands(before, arc[0])
        following = arc[1 if stands else 2]
        if following is None:
            following = arc[1 if stands else 2] = self.step(s, byte, stands)
        return following

    def encode(self, piece: bytes) -> list[int]:
        return next(self.encode_each([piece]))

    def encode_each(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of each piece.  What it begins with like the piece before is not read again, so sorted ones take less time."""
        last, ways = b"", [(self.start, -1, 0)]  # after each byte: state, token before, number of tokens
        out: list[int] = []
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                yield [whole]
                continue
            n = 0
            for x, y in zip(last, piece):
                if x != y:
                    break
                n += 1
            del ways[n + 1 :]
            s, before, made = ways[n]
            del out[made:]
            arcs_of, follow = s.arcs, self.follow
            for byte in piece[n:] if n else piece:
                following = arcs_of.get(byte)
                if type(following) is not tuple:
                    following = follow(s, byte, before)
                s, emitted = following
                arcs_of = s.arcs
                if emitted:
                    out += emitted
                    before = emitted[-1]
                ways.append((s, before, len(out)))
            last = piece
            if s.final is None:
                s.final = path(s.tokens, s.rows[-1])
            yield [*out, *s.final]


class Spelling:
    """The bytes of all tokens in one array, so that a run of ids is spelt by one gathering."""

    def __init__(self, token_bytes: list[bytes]):
        self.sizes = np.array([len(x) for x in token_bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(token_bytes), np.uint8)

    def of(self, ids: bytes) -> bytes:
        """The bytes that ids (little-endian 32-bit) stand for."""
        found = np.frombuffer(ids, "<u4")
        sizes = self.sizes[found]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.data[np.arange(ends[-1]) + np.repeat(self.starts[found] - ends + sizes, sizes)].tobytes()


class Tokenizer:
    """Whole texts to ids and back; what it remembers, ``less`` times less of it, decides time and memory only."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, less: int = 1):
        self.machine, self.less = Transducer(ranks, less), less
        self.pieces = Splitter(pattern)
        self.spelling = Spelling(self.machine.token_bytes)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece_ids(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of matches that are not remembered; short ones are from now on."""
        found = {x: self.older[x] for x in pieces if x in self.older}
        # a match that is longer than can be remembered is read by itself
        short = sorted(x.encode() for x in pieces if x not in found and len(x) <= LONGEST_PIECE)
        found |= {x.decode(): array("I", ids).tobytes() for x, ids in zip(short, self.machine.encode_each(short))}
        if len(self.known) + len(found) > MOST_PIECES // self.less:  # matches not met again since the last change go
            self.older, self.known = self.known, {}
        self.known |= found
        long = (x for x in pieces if len(x) > LONGEST_PIECE)
        return found | {x: array("I", self.machine.encode(x.encode())).tobytes() for x in long}

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit integers."""
        pieces, known = [self.pieces.split(x) for x in texts], self.known
        new = self.piece_ids(set().union(*pieces).difference(known))
        return [b"".join([new[x] if x in new else known[x] for x in row]) for row in pieces]

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def text_bytes(self, ids: bytes) -> bytes:
        return self.spelling.of(ids)


class Utf8Stream:
    """UTF-8 in pieces: a state machine over the bytes awaited holds back an unfinished character.

    Its state is the bytes of the character under way, at most three.  Bytes that cannot be part of any
    character become U+FFFD, as in one call of ``bytes.decode``.
    """

    def __init__(self) -> None:
        self.held = b""

    def feed(self, more: bytes) -> str:
        data = self.held + more
        cut = len(data) - self._unfinished(data[-3:])
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(tail: bytes) -> int:
        """How many of the last bytes begin a character that is not complete."""
        for at, byte in enumerate(tail):
            awaited = 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else 0
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            have = len(tail) - at - 1
            if awaited > have and (have < 1 or low <= tail[at + 1] <= high) and (have < 2 or 0x80 <= tail[at + 2] <= 0xBF):
                return have + 1
        return 0


def decode_stream(chunks: Iterator[bytes], spelling: Spelling) -> Iterator[str]:
    """Text of chunks of ids (little-endian 32-bit), as soon as its characters are complete."""
    stream = Utf8Stream()
    for chunk in chunks:
        yield stream.feed(spelling.of(chunk))
    yield stream.close()


def tokenizer(content: bytes, pattern: str, less: int = 1) -> Tokenizer:
    """One tokenizer per worker process and vocabulary."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest() + f"-{less}"
    return resident(key, lambda: Tokenizer(read_ranks(content), pattern, less))


CHUNK = 1 << 16  # bytes of ids the decoder takes at once


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def encode(documents: DataFrame, ranks: bytes, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = t.ids_of(part.column("text").to_pylist())
                sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return map_arrow(_texts(documents, doc_id, text), step, f"id {kind}, n_tokens bigint, ids binary", keeps=True)


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Per row of ``encode``: id, text; decoded as a stream of ``CHUNK`` bytes of ids at a time."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(ranks, pattern).spelling
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = (x or b"" for x in part.column("ids").to_pylist())
                texts = ["".join(decode_stream((x[i : i + CHUNK] for i in range(0, len(x), CHUNK)), table)) for x in rows]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return map_arrow(encoded.select("id", "ids"), step, f"id {kind}, text string", keeps=True)


def round_trip(documents: DataFrame, ranks: bytes, pattern: str, *, doc_id: str = "doc_id", text: str = "text", less: int = 1) -> DataFrame:
    """Per document row: id, n_tokens, ids_sha256, decoded_sha256; ids are encoded and decoded again in one pass.

    ``less``: workers remember so many times fewer matches and states, where memory is shared with other steps.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks, pattern, less)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sizes, coded, decoded = [], [], []
                for ids in t.ids_of(part.column("text").to_pylist()):
                    digest = hashlib.sha256()
                    for piece in decode_stream((ids[i : i + CHUNK] for i in range(0, len(ids), CHUNK)), t.spelling):
                        digest.update(piece.encode())
                    sizes.append(len(ids) // 4)
                    coded.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(digest.hexdigest())
                columns = [part.column("id"), pa.array(sizes, pa.int64()), pa.array(coded), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return map_arrow(_texts(documents, doc_id, text), step, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", keeps=True)
