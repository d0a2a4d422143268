"""Token files: ids of whole documents in id order, in range-coded blocks.

Documents are dealt into ranges of their id and encoded in that order; each task writes chunks of whole documents.
A chunk is one binary value in a parquet file: a list of document ids and lengths, then the coded ids.  Where the splitting pattern is given, they
are coded as words (``pack_words``): their places in a list of the chunk's distinct matches, and the list's ids.  Otherwise ids are coded one by one
(``pack``).  Either way each symbol is coded by what followed the last two, the last one, and by adaptive counts; see ``range_coder``.  Parquet gives the files every store that Spark can write, and a committed, retryable write.
Where a document starts among all ids follows from the chunks' sizes alone.

Defined results: a null or empty text is the end id alone; rows that share a document id follow each other, ordered by a hash of
their text, so that they may span ranges; a null id comes first; an empty table gives no chunks and an empty result; other columns are ignored; a text of any
length is encoded whole, in a chunk of its own if need be.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from . import range_coder
from .pieces import RUNS, Runs, Splitter
from .ship import map_arrow, resident
from .words import slices, text_bytes

#: coded side by side: the more blocks a chunk has, the fewer steps an id takes; a worker holds one chunk
CHUNK_IDS = 1 << 24
TEXTS, TEXT_BYTES = 1024, 1 << 21  # taken at a time: so many texts or bytes, or one text
MOST_CODES = 1 << 24  # characters cut by arrays, which take more memory than one text's list of matches
ROWS_PER_RANGE = 8192
MOST_RANGES = 100_000
MOST_WORDS = 1 << 21  # remembered by a worker, about; they end a chunk, and half of them are dropped before one
MOST_WORD_IDS = 1 << 24  # of remembered words, likewise
MOST_ID = 1 << 24
NO_ID = -(1 << 63)


def byte_symbols(content: str) -> str | None:
    """The characters that stand for bytes 0 to 255, if the library maps a match to bytes and does nothing else before its model."""
    parts = json.loads(content)
    before = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or parts["model"].get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        return None
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [c for c in range(256) if c not in plain]
    return "".join(chr(c) if c in plain else chr(256 + others.index(c)) for c in range(256))


class Vocabulary(dict):
    """Words that a worker has met, numbered as they came, and their ids.

    A word is a match of the pattern, or a single id.
    """

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str | int] = []
        self.ids = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int32)

    def __missing__(self, word: str | int) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def learn(self, lengths: list[int], ids: list[int]) -> None:
        """Take up the ids of new words, in their order."""
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
        self.lengths = np.concatenate([self.lengths, np.array(lengths, np.int32)])

    def holds(self, share: float) -> bool:
        """Whether it has reached a share of what a worker remembers."""
        return len(self) >= share * MOST_WORDS or len(self.ids) >= share * MOST_WORD_IDS

    def spell(self, numbers: np.ndarray) -> np.ndarray:
        """The words' ids, one after the other."""
        return spans(self.ids, np.cumsum(self.lengths, dtype=np.int64) - self.lengths, self.lengths, numbers)


class Encoder:
    """Ids of texts by the tokenizers library.

    The library splits a text by its pattern and encodes each match by itself.  With that pattern given, matches are
    found here, each distinct one goes to the library's model once, and its ids are remembered (``Vocabulary``).
    A text that holds one of the library's added tokens goes to it whole, since those are found before the split.
    """

    def __init__(self, content: str, pattern: str | None):
        self.library = Tokenizer.from_str(content)
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.splitter = Splitter(pattern) if pattern else None
        self.runs = Runs() if pattern == RUNS else None
        self.symbols = byte_symbols(content)
        self.vocabulary = Vocabulary()

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        done = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in done]

    def _model_ids(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Number of ids of each match, and all ids."""
        if self.symbols is None:
            found = [np.frombuffer(x, "<u4").tolist() for x in self._library_ids(pieces)]
            return list(map(len, found)), list(chain.from_iterable(found))
        mapped = "\0".join(pieces).encode().decode("latin-1").translate(self.symbols).split(self.symbols[0])
        if len(mapped) != len(pieces):  # some hold that character
            mapped = [x.encode().decode("latin-1").translate(self.symbols) for x in pieces]
        found = list(map(self.library.model.tokenize, mapped))
        return list(map(len, found)), [t.id for x in found for t in x]

    def numbers(self, known: Vocabulary, words: list[str | int]) -> np.ndarray:
        """The words' numbers in a vocabulary, which learns new ones."""
        numbers = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        new, known.new = known.new, []
        for single, run in groupby(new, key=lambda x: isinstance(x, int)):
            run = list(run)
            known.learn(*(([1] * len(run), run) if single else self._model_ids(run)))
        return numbers

    def words(self, texts: list[str]) -> tuple[list[str | int], np.ndarray, np.ndarray]:
        """Distinct words of the texts, every word's place among them, and each text's range of words.

        Words are a text's matches, or its ids where it holds an added token.
        """
        whole = [i for i, x in enumerate(texts) if self.added and self.added.search(x)]
        small = sum(map(len, texts)) <= MOST_CODES
        done = self.runs.distinct(texts) if self.runs and small and not whole else None
        if done:
            return done
        held = dict(zip(whole, self._library_ids([texts[i] for i in whole]))) if whole else {}
        found = [np.frombuffer(held[i], "<u4").tolist() if i in held else self.splitter.split(x) for i, x in enumerate(texts)]
        every = list(chain.from_iterable(found))
        place = {x: i for i, x in enumerate(dict.fromkeys(every))}
        return list(place), np.fromiter(map(place.__getitem__, every), np.int32, len(every)), np.cumsum([0, *map(len, found)])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if self.splitter is None:
            return self._library_ids(texts)
        words = Words(self)
        at = np.cumsum([0, *words.add(texts)]).tolist()
        flat = words.known.spell(words.all()).astype("<u4")
        return [flat[a:b].tobytes() for a, b in zip(at, at[1:])]


def encoder(content: str, pattern: str | None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(f"{pattern}\n{content}".encode()).hexdigest()
    return resident(key, lambda: Encoder(content, pattern))


class Words:
    """A chunk's texts as numbers of words in a worker's vocabulary."""

    def __init__(self, own: Encoder, end_id: int | None = None):
        if own.vocabulary.holds(0.5):
            own.vocabulary = Vocabulary()
        self.own, self.known, self.end = own, own.vocabulary, end_id
        self.numbers: list[np.ndarray] = []

    def add(self, texts: list[str]) -> list[int]:
        """Take texts up; the number of ids of each."""
        distinct, places, at = self.own.words(texts)
        numbers = self.own.numbers(self.known, distinct).take(places)
        if self.end is not None:
            numbers = np.insert(numbers, at[1:], self.own.numbers(self.known, [self.end])[0])
            at = at + np.arange(len(at))
        self.numbers.append(numbers)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.known.lengths.take(numbers), dtype=np.int64)])
        return np.diff(upto.take(at)).tolist()

    def all(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *self.numbers])


def spans(flat: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The ids of words, one after the other."""
    sizes = lengths.take(numbers)
    total = int(sizes.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((firsts.take(numbers) - (np.cumsum(sizes, dtype=np.int64) - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat.take(at)


BY_ID, BY_WORD = b"I", b"W"


def _documents_head(kind: bytes, doc_ids: list[int], sizes: np.ndarray) -> bytes:
    return kind + struct.pack("<I", len(doc_ids)) + np.array(doc_ids, "<i8").tobytes() + sizes.astype("<u4").tobytes()


def pack(doc_ids: list[int], ids: list[bytes]) -> bytes:
    """One chunk: the number of documents, their ids and lengths, the coded ids."""
    sizes = np.array([len(x) // 4 for x in ids], "<u4")
    return _documents_head(BY_ID, doc_ids, sizes) + range_coder.encode(np.frombuffer(b"".join(ids), "<u4"))


def pack_words(doc_ids: list[int], sizes: list[int], words: Words) -> bytes:
    """One chunk: the documents as in ``pack``, the places of their words in the list of words, the list's ids.

    The list holds words that come again by falling counts and as they come, then the others as they come.  These share place 0, which
    says that the next of them follows.  In the list, an id is doubled, and one more where a word ends; its symbols are the places of these
    numbers among those that occur.  Places and symbols are both coded by the adaptive model (``range_coder.encode_mixed``).
    """
    known, lengths, numbers = words.known, words.known.lengths, words.all()
    if not lengths.all():
        numbers = numbers[lengths.take(numbers) > 0]
    counts = np.bincount(numbers, minlength=len(lengths))
    first = np.zeros(len(lengths), np.int64)
    first[numbers[::-1]] = np.arange(len(numbers))[::-1]
    again = np.flatnonzero(counts > 1)
    again = again[np.lexsort([first.take(again), -counts.take(again)])]
    places = np.zeros(len(lengths), np.int32)
    places[again] = np.arange(1, len(again) + 1)
    coded = places.take(numbers)
    listed = np.concatenate([again, numbers[coded == 0]])
    marked = known.spell(listed).astype(np.int64) << 1
    if len(marked) and int(marked.max()) >= 2 * MOST_ID:
        raise ValueError(f"ids must be from 0 to {MOST_ID - 1}, found {marked.max() >> 1}")
    marked[np.cumsum(lengths.take(listed)) - 1] |= 1
    occur = np.zeros(int(marked.max()) + 1 if len(marked) else 0, bool)
    occur[marked] = True
    listed_ids = range_coder.encode_mixed((np.cumsum(occur, dtype=np.int32) - 1).take(marked))
    parts = [range_coder.encode_mixed(coded), zlib.compress(np.packbits(occur).tobytes()), listed_ids]
    return _documents_head(BY_WORD, doc_ids, np.array(sizes)) + struct.pack("<3Q", *map(len, parts)) + b"".join(parts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a chunk."""
    kind, (n,) = data[:1], struct.unpack_from("<I", data, 1)
    doc_ids = np.frombuffer(data, "<i8", n, 5)
    sizes = np.frombuffer(data, "<u4", n, 5 + 8 * n)
    at = 5 + 12 * n
    if kind == BY_ID:
        return doc_ids, sizes, range_coder.decode(data[at:])
    if kind != BY_WORD:
        raise ValueError("not a chunk of ids")
    ends = at + 24 + np.cumsum([0, *struct.unpack_from("<3Q", data, at)])
    body, bits, listed_ids = (data[a:b] for a, b in zip(ends, ends[1:]))
    places = range_coder.decode_mixed(body)
    try:
        occur = np.frombuffer(zlib.decompress(bits), np.uint8)
    except zlib.error as e:
        raise ValueError("the list of ids is damaged") from e
    marked = np.flatnonzero(np.unpackbits(occur)).take(range_coder.decode_mixed(listed_ids))
    ends = np.flatnonzero(marked & 1) + 1
    firsts = np.concatenate([np.zeros(1, np.int64), ends])[:-1]
    once = np.flatnonzero(places == 0)
    numbers = places - 1
    numbers[once] = np.arange(len(ends) - len(once), len(ends))
    return doc_ids, sizes, spans(marked.astype(np.uint32) >> 1, firsts, ends - firsts, numbers)


def write(
    documents: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Write all documents' ids to ``path``, ascending by document id.

    ``tokenizer``: the content of the library's JSON file.  ``pattern``: the pattern by which it splits texts,
    if it has one and matches are encoded by themselves.
    """
    end = struct.pack("<I", end_id)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, chunk = encoder(tokenizer, pattern), TaskContext.get().partitionId(), 0
        names, sizes, held = [], [], []
        words = Words(own, end_id)

        def row() -> pa.RecordBatch:
            data = pack_words(names, sizes, words) if pattern else pack(names, held)
            columns = [pa.array([x], pa.int64()) for x in (part, chunk, sum(sizes))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], ["part", "chunk", "n_ids", "data"])

        total = 0
        for batch in batches:
            for a, b in slices(text_bytes(batch.column("text"))[1], TEXT_BYTES, TEXTS):
                piece = batch.slice(a, b - a)
                texts = piece.column("text").to_pylist()
                names += [NO_ID if x is None else x for x in piece.column("id").to_pylist()]
                if pattern:
                    more = words.add(texts)
                else:
                    got = [x + end for x in own.ids(texts)]
                    held += got
                    more = [len(x) // 4 for x in got]
                sizes += more
                total += sum(more)
                if total >= CHUNK_IDS or words.known.holds(1):
                    yield row()
                    names, sizes, held, words, total, chunk = [], [], [], Words(own, end_id), 0, chunk + 1
        if names:
            yield row()

    ranges = max(1, min(MOST_RANGES, documents.count() // ROWS_PER_RANGE))
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # with the text's hash, as one id, or none, may be that of very many rows
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(ranges, "id", "hash").sortWithinPartitions("id", "hash", "text")
    map_arrow(rows.drop("hash"), step, "part bigint, chunk bigint, n_ids bigint, data binary", keeps=True).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            doc_ids, sizes, ids = unpack(row["data"])
            ends = np.cumsum(sizes.astype(np.int64))
            starts = ends - sizes
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(sizes)
            columns = [
                pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["chunk"])), pa.array(doc_ids, mask=doc_ids == NO_ID),
                pa.array(starts), pa.array(sizes.astype(np.int64)), pa.array(sums, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "id", "first", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    chunks = spark.read.parquet(path)
    docs = map_arrow(
        chunks.select("part", "chunk", "data"),
        _documents,
        "part bigint, chunk bigint, id bigint, first bigint, n_tokens bigint, ids_crc32 bigint",
    )
    # one row per chunk, then one row per range: neither holds ids
    before = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = chunks.select("part", "chunk", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("inside"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = docs.join(inside, ["part", "chunk"]).join(parts, "part")
    return placed.select("id", (F.col("base") + F.col("inside") + F.col("first")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per chunk: part, chunk, ids (array, with each document's end id)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = pa.array([unpack(row["data"])[2].astype(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]]), pa.array([row["chunk"]]), ids], ["part", "chunk", "ids"])

    return map_arrow(spark.read.parquet(path).select("part", "chunk", "data"), step, "part bigint, chunk bigint, ids array<bigint>")
