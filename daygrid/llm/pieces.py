"""SentencePiece encoding and decoding over a lattice of pieces.

Texts are cut into words where no piece can reach across: before a run of the
space mark, at line ends, and before punctuation that no piece of the vocabulary
joins to what stands before it. The distinct words of many chunks are dealt by hash
and grouped, so that each is encoded once per group of chunks. Words of like length
are taken together: a walk through the trie of the pieces finds all edges (word,
place, length) of their lattice, and a fold over all of them at once picks the
paths: Viterbi for unigram models, the best merge first for BPE models, whose
pieces Viterbi would not reproduce. Characters without a piece become byte pieces.

A chunk is a stretch of one input partition, bounded in characters and in distinct
words. Its texts come in small groups; what stands between two spaces is told apart
in Arrow for a group at once, and cut once per chunk. Documents travel once, as compressed word numbers of their chunk; words
travel packed by chunk and bucket, and their ids come back packed alike, so that
documents and words of a chunk meet in one bounded group. Both passes over the
input number words alike; a word that is missing raises.

Defined results: null and empty texts have no ids; repeated rows are encoded each;
a word of more than ``LONG_WORD`` characters is encoded by the library in place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.llm.common import giving_back, giving_back_at_end, small_batches, texts_of

MARK = "▁"
CHUNK_CHARS = 20_000_000
CHUNK_WORDS = 250_000
GROUP_CHARS, GROUP_TEXTS = 1 << 20, 1000  # of texts whose stretches are told apart at once
# Words meet over a group of at most 32 partitions x 16 chunks, dealt to this many buckets.
PARTITIONS_IN_GROUP, CHUNKS_IN_GROUP, BUCKETS = 32, 16, 256
LONG_WORD = 48
CELLS_AT_ONCE = 60_000  # characters of a lattice
_LOADED: dict[str, Vocabulary] = {}


class Lattice:
    """The trie of the pieces in arrays, to find and fold the edges of many words at once."""

    def __init__(self, pieces: list[tuple[str, int, float]], longest: int, first_byte: int, unknown: int):
        self.longest, self.first_byte, self.unknown = longest, first_byte, unknown
        ranked = sorted(pieces, key=lambda p: (p[2], p[1]))
        self.ids = np.array([i for _, i, _ in ranked], np.int32)
        self.scores = np.array([score for _, _, score in ranked])
        node_of, rank_of = {}, {}
        for rank, (piece, _, _) in enumerate(ranked):
            node = 0
            for c in piece:
                node = node_of.setdefault(node << 21 | ord(c), len(node_of) + 1)
            rank_of[node] = rank
        keys = np.fromiter(node_of.keys(), np.int64, len(node_of))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], (order + 1).astype(np.int64)
        self.ranks = np.full(len(keys) + 1, -1, np.int32)
        self.ranks[list(rank_of)] = list(rank_of.values())

    def edges(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rank of the piece of each (word, place, length), -1 where there is none."""
        width = codes.shape[1]
        out = np.full((codes.size, self.longest + 1), -1, np.int32)
        left = np.maximum(n[:, None] - np.arange(width), 0).ravel()
        start = np.flatnonzero(left)
        left, node, codes = left[start], np.zeros(len(start), np.int64), codes.ravel()
        for length in range(1, self.longest + 1):
            key = node << 21 | codes[start + length - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            start, left, node = start[on], left[on], self.nodes[at[on]]
            out[start, length] = self.ranks[node]
            on = left > length
            start, left, node = start[on], left[on], node[on]
        return out.reshape(len(n), width, self.longest + 1)

    def merged(self, edges: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Length of the piece that starts at each place, 0 inside: the adjacent pair of the best score merges first, the leftmost of equals."""
        width = edges.shape[1]
        size = (np.arange(width) < n[:, None]).astype(np.int64)
        before = np.tile(np.arange(width) - 1, (len(n), 1))
        joined = edges[:, :, 2].copy() if self.longest > 1 else np.full(size.shape, -1)
        rows = np.arange(len(n))

        def rate(r: np.ndarray, p: np.ndarray) -> None:
            q = p + size[r, p]
            both = size[r, p] + np.where(q < n[r], size[r, np.minimum(q, width - 1)], self.longest)
            joined[r, p] = np.where(both <= self.longest, edges[r, p, np.minimum(both, self.longest)], -1)

        while len(rows):
            p = joined[rows].argmax(axis=1)
            more = joined[rows, p] >= 0
            rows, p = rows[more], p[more]
            q = p + size[rows, p]
            size[rows, p] += size[rows, q]
            size[rows, q], joined[rows, q] = 0, -1
            after = p + size[rows, p]
            inner = after < n[rows]
            before[rows[inner], after[inner]] = p[inner]
            rate(rows, p)
            inner = before[rows, p] >= 0
            rate(rows[inner], before[rows, p][inner])
        return size

    def best(self, edges: np.ndarray, n: np.ndarray, unknown_score: float = -1e6) -> np.ndarray:
        """Like ``merged``, by the best path (Viterbi); of equal paths that with the shortest last piece."""
        width = edges.shape[1]
        score, last = np.zeros((len(n), width + 1)), np.zeros((len(n), width + 1), np.int64)
        for end in range(1, width + 1):
            score[:, end] = -np.inf
            for length in range(min(self.longest, end), 0, -1):
                rank = edges[:, end - length, length]
                path = score[:, end - length] + np.where(rank >= 0, self.scores[rank], unknown_score if length == 1 else -1e18)
                better = path >= score[:, end]
                score[better, end], last[better, end] = path[better], length
        size = np.zeros((len(n), width), np.int64)
        rows, end = np.flatnonzero(n), n[n > 0]
        while len(rows):
            length = last[rows, end]
            end = end - length
            size[rows, end] = length
            rows, end = rows[end > 0], end[end > 0]
        return size

    def encode(self, words: list[str], fold: str = "bpe") -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids of all."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        order, lengths, ids, i = np.argsort(n, kind="stable"), [np.empty(0, np.int64)], [np.empty(0, np.int32)], 0
        while i < len(words):
            part = order[i : i + max(1, CELLS_AT_ONCE // max(1, int(n[order[i]])))]
            part = part[: max(1, int(np.searchsorted(n[part], 2 * max(1, int(n[part[0]])), side="right")))]
            i += len(part)
            codes = np.zeros((len(part), max(1, int(n[part[-1]]))), np.int64)
            codes[np.arange(codes.shape[1]) < n[part, None]] = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le", "surrogatepass"), np.uint32)
            edges = self.edges(codes, n[part])
            size = self.merged(edges, n[part]) if fold == "bpe" else self.best(edges, n[part])
            row, p = np.nonzero(size)
            rank = edges[row, p, size[row, p]]
            own = np.where(rank >= 0, self.ids[rank], self.unknown).astype(np.int32)
            if self.first_byte >= 0 and (rank < 0).any():
                raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[row, p][rank < 0]]
                times = np.ones(len(row), np.int64)
                times[rank < 0] = [len(x) for x in raw]
                own, row, rank = np.repeat(own, times), np.repeat(row, times), np.repeat(rank, times)
                own[rank < 0] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + self.first_byte
            lengths.append(np.bincount(row, minlength=len(part)))
            ids.append(own)
        lengths, ids = np.concatenate(lengths), np.concatenate(ids)
        back = np.argsort(order)
        return lengths[back], ids[slices((np.cumsum(lengths) - lengths)[back], lengths[back])]


def slices(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each slice, one after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(first, length)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, compressed byte by byte of their places."""
    return zlib.compress(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


class Vocabulary:
    """Pieces of a model file and the rules for cutting texts that follow from them."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.pieces = [(model.id_to_piece(i), i, model.get_score(i)) for i in range(n) if not special[i]]
        self.longest = max(len(p) for p, _, _ in self.pieces)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in self.pieces):
            raise ValueError("a piece reaches across words")
        self.first_byte = model.piece_to_id("<0x00>") if model.is_byte(model.piece_to_id("<0x00>")) else -1
        self.unknown = model.unk_id()
        self.prefixed = model.encode("a", out_type=str)[0].startswith(MARK)
        self.bytes_of = [
            b"" if model.is_control(i) else bytes([i - self.first_byte]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(n)
        ]
        self.word = self._word_pattern()
        self.lattice = Lattice(self.pieces, self.longest, self.first_byte, self.unknown)

    def _word_pattern(self) -> re.Pattern:
        """Words; ``tails`` are signs that no piece joins to a sign that is no tail, but for the space mark."""
        pairs = {(a, b) for p, _, _ in self.pieces for a, b in zip(p, p[1:], strict=False)}
        tails = {c for p, _, _ in self.pieces for c in p if c != MARK and not c.isalnum()}
        while bad := {b for a, b in pairs if b in tails and a != MARK and a not in tails}:
            tails -= bad
        t = "".join(map(re.escape, sorted(tails)))
        if not tails:
            return re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        return re.compile(f"\n|{MARK}*(?:[^{MARK}\n{t}]+|[{t}]+[^{MARK}\n{t}]*)|{MARK}+")

    def words(self, text: str) -> list[str]:
        return self.word.findall(self.model.normalize(text)) if text else []

    def plain(self, text: str) -> bool:
        """Whether each space of the text just starts a word."""
        if not self.prefixed or not text or "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return False
        return self.model.normalize(text) == MARK + text.replace(" ", MARK)

    def decode(self, ids: list[int]) -> bytes:
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return out[1:] if self.prefixed and out[:1] == b" " else out


def vocabulary(path: str) -> Vocabulary:
    """The model of this worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class Stretches(dict):
    """Word numbers of what stands between two spaces, each cut once per chunk; letters and digits alone are one word, for no piece's cut lies in them."""

    def __init__(self, cut: Callable[[str], list[str]], numbers: dict[str, int]):
        self.cut, self.numbers = cut, numbers

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        numbers, word = self.numbers, MARK + stretch
        if stretch.isalnum():
            found = (numbers.setdefault(word, len(numbers)),)
        else:
            found = tuple([numbers.setdefault(w, len(numbers)) for w in self.cut(word)])
        self[stretch] = found
        return found


class Chunks:
    """Numbers the chunks of a task and the words of a chunk, alike in every pass."""

    def __init__(self, known: Vocabulary):
        self.known, self.part, self.count = known, TaskContext.get().partitionId(), 0
        self.start()

    def start(self) -> None:
        self.chars, self.numbers = 0, {}
        self.between_spaces = Stretches(self.known.word.findall, self.numbers)

    @property
    def chunk(self) -> int:
        return self.part << 20 | self.count

    def numbered(self, words: list[str]) -> tuple[int, ...]:
        return tuple([self.numbers.setdefault(w, len(self.numbers)) for w in words])

    def add(self, texts: list[str]) -> tuple[pa.ListArray, pa.DictionaryArray, list[tuple[int, ...]], list[int], dict[int, tuple[int, ...]]]:
        """Numbers the words of a group of texts, those of the distinct stretches of all plain texts first.

        Returns the stretches of the plain texts, these told apart, the word numbers of each, the places of
        the plain texts, and the word numbers of the other texts.
        """
        self.chars += sum(map(len, texts))
        plain = [i for i, t in enumerate(texts) if self.known.plain(t)]
        stretches = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        coded = stretches.values.dictionary_encode()
        found = [*map(self.between_spaces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False))]
        others = {i: self.numbered(self.known.words(texts[i])) for i in sorted({*range(len(texts))}.difference(plain))}
        return stretches, coded, found, plain, others

    def numbers_of(self, texts: list[str]) -> list[np.ndarray]:
        """Word numbers of each text of a group."""
        stretches, coded, found, plain, others = self.add(texts)
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
        at = coded.indices.to_numpy()
        numbers = flat[slices((np.cumsum(count) - count)[at], count[at])]
        stops = np.concatenate(([0], np.cumsum(count[at])))[stretches.offsets.to_numpy()]
        out = {i: np.array(w, np.int32) for i, w in others.items()}
        out.update((i, numbers[a:b]) for i, a, b in zip(plain, stops, stops[1:], strict=False))
        return [out[i] for i in range(len(texts))]

    def full(self) -> bool:
        return self.chars > CHUNK_CHARS or len(self.numbers) > CHUNK_WORDS

    def next(self) -> None:
        self.count += 1
        self.start()


def groups_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Array, list[str]]]:
    """The first column and the texts of stretches of rows that the texts' lengths alone cut, however the batches are cut."""
    most, firsts, held, chars = min(GROUP_CHARS, CHUNK_CHARS // 16), [], [], 0
    for batch, texts in texts_of(batches, column):
        start = 0
        for i, t in enumerate(texts):
            held.append(t)
            chars += len(t)
            if chars > most or len(held) == GROUP_TEXTS:
                yield pa.concat_arrays([*firsts, batch.column(0).slice(start, i + 1 - start)]), held
                start, firsts, held, chars = i + 1, [], [], 0
        firsts.append(batch.column(0).slice(start))
    if held:
        yield pa.concat_arrays(firsts), held


def chunk_words(docs: DataFrame, path: str) -> DataFrame:
    """(chunk, bucket, numbers, lengths, letters): the distinct words of each chunk by bucket, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(vocabulary(path))

        def out() -> pa.RecordBatch:
            chunks.between_spaces.clear()  # the chunk ends here
            words = list(chunks.numbers)
            bucket = np.fromiter([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words], np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            stops = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = [p for p in np.split(order, stops) if len(p)]
            mine = [[words[i] for i in p] for p in parts]
            columns = [
                pa.array(np.full(len(parts), chunks.chunk)),
                pa.array([int(bucket[p[0]]) for p in parts], pa.int64()),
                pa.array([packed(np.diff(p, prepend=0)) for p in parts], pa.binary()),
                pa.array([packed(np.fromiter(map(len, w), np.int32, len(w))) for w in mine], pa.binary()),
                pa.array([zlib.compress("".join(w).encode("utf-8", "surrogatepass"), 1) for w in mine], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "numbers", "lengths", "letters"])

        for _, texts in groups_of(batches, "cut_text"):
            chunks.add(texts)
            if chunks.full():
                yield out()
                chunks.next()
        yield out()

    return docs.select("cut_text").mapInArrow(giving_back_at_end(run), "chunk long, bucket long, numbers binary, lengths binary, letters binary")


def chunk_documents(docs: DataFrame, path: str) -> DataFrame:
    """(chunk, doc, check, words): each document as compressed word numbers of its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(vocabulary(path))
        for ids, texts in groups_of(batches, "cut_text"):
            lists = [packed(x) for x in chunks.numbers_of(texts)]
            checks = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), chunks.chunk)), ids, pa.array(checks, pa.int64()), pa.array(lists, pa.binary())],
                names=["chunk", "doc", "check", "words"],
            )
            if chunks.full():
                chunks.next()

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "cut_text").mapInArrow(giving_back_at_end(run), f"chunk long, doc {kind}, check long, words binary")


def encoded_words(words: DataFrame, known: Vocabulary, spark: SparkSession, fold: str = "bpe", keys: tuple[str, ...] = ("word",)) -> DataFrame:
    """``keys``, any other columns, and ids of the rows of ``words``, by the lattice."""
    small_batches(spark)
    parts = (known.pieces, known.longest, known.first_byte, known.unknown)
    rest = [c for c in words.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*parts)
        for batch in batches:
            lengths, ids = lattice.encode(batch.column(batch.schema.get_field_index("word")).to_pylist(), fold)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "ids"])

    kinds = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in [*keys, *rest])
    return words.select(*keys, *rest).mapInArrow(run, f"{kinds}, ids array<int>")


def encoded_bucket(rows: pa.Table, path: str, fold: str) -> pa.Table:
    """(chunk, numbers, lengths, ids) of the words of one bucket of a group of chunks, packed; each distinct word is encoded once."""
    known, words, counts = vocabulary(path), [], []
    for lengths, letters in zip(rows.column("lengths").to_pylist(), rows.column("letters").to_pylist(), strict=True):
        stops, text = np.cumsum(unpacked(lengths)).tolist(), zlib.decompress(letters).decode("utf-8", "surrogatepass")
        words += [text[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        counts.append(len(stops))
    numbers = {}
    own = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words))
    words = list(numbers)
    lengths, ids = known.lattice.encode([w if len(w) <= LONG_WORD else "" for w in words], fold)
    long = [(k, encode_long(known.model, w)) for k, w in enumerate(words) if len(w) > LONG_WORD]
    first = np.cumsum(lengths) - lengths
    if long:
        at, given = zip(*long, strict=True)
        added = np.array([len(x) for x in given])
        first[list(at)], lengths[list(at)] = len(ids) + np.cumsum(added) - added, added
        ids = np.concatenate((ids, np.concatenate(given).astype(np.int32)))
    lists, sizes = [], []
    for mine in np.split(own, np.cumsum(counts)[:-1]):
        sizes.append(packed(lengths[mine]))
        lists.append(packed(ids[slices(first[mine], lengths[mine])]))
    return pa.table({"chunk": rows.column("chunk"), "numbers": rows.column("numbers"), "lengths": pa.array(sizes, pa.binary()), "ids": pa.array(lists, pa.binary())})


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", fold: str = "bpe") -> DataFrame:
    """(id, n_pieces, ids, round_trip) of every row; ``path`` is the model file on driver and workers."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("cut_text"))
    # A chunk's name is its partition and, in 20 bits, its count there.
    group = F.expr(f"shiftright(chunk, 20) DIV {PARTITIONS_IN_GROUP}"), F.expr(f"(chunk & {(1 << 20) - 1}L) DIV {CHUNKS_IN_GROUP}")
    words = chunk_words(own, path).groupBy(group[0].alias("part"), group[1].alias("stretch"), "bucket")
    encoded = words.applyInArrow(giving_back(lambda rows: encoded_bucket(rows, path, fold)), "chunk long, numbers binary, lengths binary, ids binary")
    id_kind = docs.schema[id_col].dataType.simpleString()

    def join(words: pa.Table, rows: pa.Table) -> pa.Table:
        known = vocabulary(path)
        spot, length, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for numbers, lengths, part in zip(*(words.column(c).to_pylist() for c in ("numbers", "lengths", "ids")), strict=True):
            spot.append(np.cumsum(unpacked(numbers)))
            length.append(unpacked(lengths))
            ids.append(unpacked(part))
        spot, length, ids = (np.concatenate(x) for x in (spot, length, ids))
        first = np.full(int(spot.max(initial=-1)) + 1, -1, np.int64)
        sizes = np.zeros(len(first), np.int64)
        first[spot], sizes[spot] = np.cumsum(length) - length, length
        lists, trips = [], []
        for raw, check in zip(rows.column("words").to_pylist(), rows.column("check").to_pylist(), strict=True):
            numbers = unpacked(raw)
            if len(numbers) and (numbers.max() >= len(first) or (first[numbers] < 0).any()):
                raise RuntimeError("a word of a chunk was not encoded")
            mine = ids[slices(first[numbers], sizes[numbers])]
            lists.append(mine)
            trips.append(zlib.crc32(known.decode(mine.tolist())) == check)
        lengths = np.array([len(x) for x in lists], np.int32)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int32), *lists])
        return pa.table(
            {"doc": rows.column("doc"), "n_pieces": pa.array(lengths.astype(np.int64)), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "round_trip": pa.array(trips, pa.bool_())}
        )

    texts = chunk_documents(own, path)
    out = encoded.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(
        giving_back(join), f"doc {id_kind}, n_pieces long, ids array<int>, round_trip boolean"
    )
    return out.withColumnRenamed("doc", id_col)


def encode_long(model: sentencepiece.SentencePieceProcessor, word: str) -> list[int]:
    """Ids of a word that stands in a text, without the mark that the library puts before a text."""
    probe = "\n"  # cuts before the word, so that the library's mark joins nothing of it
    head = model.encode(probe)
    return model.encode(probe + word.replace(MARK, " "))[len(head) :]


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row; bytes that are no UTF-8 become replacement characters, null ids no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = vocabulary(path)
            texts = [known.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(F.col(id_col).alias("doc"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc {kind}, text string")
    return out.withColumnRenamed("doc", id_col)
