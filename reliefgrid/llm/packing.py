"""Packing along a space-filling curve: neighbouring documents share training sequences.

A document's token ids are hashed into a vector of ``BUCKETS`` signed counts, which is scaled to length one and
projected to ``DIMS`` numbers; the Hilbert curve through that space gives its key. The rows (key, length) are
range-sorted by key, running totals give every document its place in one long stream of ids, and sequences are
the stream's windows of ``capacity`` ids: only the last one is not full. It is cut into sequences whose lengths
are powers of two, which need no padding. Documents are cut at borders, so every id lies in exactly one piece.

Ids are kept in one written table from tokenizing to cutting; the sort moves keys only, and one join brings each
document's place to its ids. Texts are encoded word by word: the tokenizer never looks across a blank
or line break (its patterns stop at white space), so equal words have equal ids, held in a bounded cache.

Results: null and empty texts are one id, the end mark; repeated rows are documents of their own, next to each
other; a null id is kept; an empty table gives an empty one; other columns are not looked at. Equal texts
have equal keys; ties are ordered by a hash of the id, so a crowd of copies is spread over partitions.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.order import running
from reliefgrid.llm.tables import saved

CAPACITY = 4096
END = 2
#: Signed counts of a document vector, dimensions it is projected to, bits per dimension of the curve.
BUCKETS, DIMS, BITS = 256, 4, 15
#: Words whose ids a task holds, and their ids, at most before they are forgotten (about 60 MB).
CACHE_WORDS, CACHE_IDS = 1_000_000, 8_000_000
#: Characters of texts that a task encodes together, about.
BATCH_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_DIGITS = np.random.Generator(np.random.PCG64(49)).integers(0, 1 << 64, 256, np.uint64)
_GAPS, _LETTERS, _STOPS = (np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in (b" \n", bytes(range(97, 123)), b".,;:!?"))
_PROJECTION = np.random.Generator(np.random.PCG64(12)).choice([-1.0, 1.0], (BUCKETS, DIMS))


class WordIds:
    """Token ids of texts, word by word, for tokenizers that drop white space and lower-case.

    Blanks and line breaks part words, a stop between an ASCII letter and white space is a word of its own, and A-Z
    are lower-cased before words are looked up; none of these changes an id. Words are found, hashed (64 bits) and
    looked up for a whole batch at a time. Unknown words made of letters are encoded in one run: each is one
    pre-token, and its last id carries the vocabulary's mark of a word's end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.powers = np.ones(1, np.uint64)
        self.back = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and their numbers."""
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        plain = [w for w, yes in zip(words, letters) if yes]
        runs = self.encode([" ".join(plain[i : i + 500]) for i in range(0, len(plain), 500)])
        one = np.concatenate([*runs, np.zeros(0, np.uint32)])
        stops = np.nonzero(self.ends[one])[0] + 1
        if len(stops) != len(plain) or (len(one) and stops[-1] != len(one)):
            letters[:] = False
            one, stops = one[:0], stops[:0]
        rest = self.encode([w for w, yes in zip(words, letters) if not yes])
        sizes = np.zeros(len(words), np.int64)
        sizes[letters] = np.diff(stops, prepend=0)
        sizes[~letters] = list(map(len, rest))
        flat = np.zeros(sizes.sum(), np.uint32)
        of_plain = np.repeat(letters, sizes)
        flat[of_plain] = one
        flat[~of_plain] = np.concatenate([*rest, np.zeros(0, np.uint32)])
        return flat, sizes

    def _hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A 64-bit hash of ``data[start:stop]``: the bytes' random numbers as digits to an odd base."""
        if len(data) > len(self.powers):
            size = max(len(data), 1 << 22)
            self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]))
            self.back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE_INVERSE, np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_DIGITS[data] * self.powers[: len(data)], dtype=np.uint64)])
        return (sums[stops] - sums[starts]) * self.back[starts]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a batch of texts is looked up at once."""
        lowered = [t.encode().lower() for t in texts]
        # markers of the tokenizer depend on their case, so texts that may hold one are encoded as they are
        odd = {i: self.encode([t])[0] for i, (t, b) in enumerate(zip(texts, lowered)) if any(m in b for m in self.special)}
        parts = [b"" if i in odd else b for i, b in enumerate(lowered)]
        data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
        gap = _GAPS[data]
        lone = _STOPS[data[1:-1]] & _LETTERS[data[:-2]] & gap[2:]  # at 1 + index
        word = ~gap
        begins = word[1:] & gap[:-1]
        begins[:-1] |= lone
        over = word[:-1] & gap[1:]
        over[:-1] |= lone  # a word ends before its stop
        over[0] = False
        starts, stops = np.nonzero(begins)[0] + 1, np.nonzero(over)[0] + 1
        found, first, each = np.unique(self._hashes(data, starts, stops), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, found)
        new = np.nonzero(np.append(self.known, 0)[place] != found if len(self.known) else np.ones(len(found), bool))[0]
        if len(self.known) + len(new) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self.clear()
            new = np.arange(len(found))
        if len(new):
            whole = data.tobytes()
            flat, sizes = self._encoded([whole[a:b].decode() for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist())])
            known = np.concatenate([self.known, found[new]])
            order = np.argsort(known, kind="stable")
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])[order]
            self.sizes = np.concatenate([self.sizes, sizes])[order]
            self.flat = np.concatenate([self.flat, flat])
            self.known = known[order]
        place = np.searchsorted(self.known, found)[each]
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[place] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        borders = np.cumsum([0] + [len(b) + 1 for b in parts[:-1]]) + 1
        words_before = np.searchsorted(starts, borders)
        cut = np.concatenate([[0], ends])[words_before]
        return [odd.get(i, a) for i, a in enumerate(np.split(ids, cut[1:]))] if texts else []


def vector(ids: np.ndarray) -> np.ndarray:
    """Signed bucket counts of hashed ids, scaled to length one."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.bincount((h >> np.uint64(56)).astype(np.int64) % BUCKETS, 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float), BUCKETS)
    size = np.sqrt((counts * counts).sum())
    return counts / size if size else counts


def cells(vectors: np.ndarray) -> np.ndarray:
    """Vectors projected to ``DIMS`` whole numbers of ``BITS`` bits; three standard deviations fill the range."""
    spread = vectors @ _PROJECTION / 6.0 + 0.5
    return np.clip(spread * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below ``2**bits``.

    Level by level from the top bit, a cube's frame is one axis order and one mirror per axis; the corner of the
    child cube, seen in that frame, is a Gray code word, and its rank is the next digit. The child's frame follows
    from the rank: entry corner and direction of the curve (Hamilton and Rau-Chaplin, 2008).
    """
    dims = points.shape[1]
    mask = (1 << dims) - 1
    entry = np.zeros(len(points), np.int64)
    turn = np.zeros(len(points), np.int64)
    key = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        corner = sum(((points[:, d] >> level) & 1) << d for d in range(dims))
        seen = corner ^ entry
        # rotate right by turn + 1 within dims bits
        by = (turn + 1) % dims
        seen = ((seen >> by) | (seen << (dims - by))) & mask
        rank = seen.copy()
        for s in range(1, dims):
            rank ^= seen >> s
        key = (key << dims) | rank
        # entry corner and direction of the child with that rank
        low = np.where(rank == 0, 0, ((rank - 1) // 2) * 2)
        start = low ^ (low >> 1)
        ahead = np.where(rank == 0, 0, np.where(rank % 2 == 0, _ones(rank - 1), _ones(rank)))
        entry ^= ((start << by) | (start >> (dims - by))) & mask
        turn = (turn + ahead + 1) % dims
    return key


def _ones(number: np.ndarray) -> np.ndarray:
    """Trailing one bits."""
    low = ~number & (number + 1)
    return np.bitwise_count((low - 1).astype(np.uint64)).astype(np.int64)


def encoded(docs: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``doc_id``, ``key``, ``n`` and ``ids`` (packed, 16 or 32 bits each) of every row; written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batches):
        words = WordIds(tokenizer)
        kind = np.uint16 if max(words.tokenizer.get_vocab_size(), end) < 1 << 16 else np.uint32
        for b in batches:
            sizes = np.cumsum([len(t) for t in b.column("_text").to_pylist()]) // BATCH_CHARS
            for part in np.split(np.arange(len(b)), np.nonzero(np.diff(sizes))[0] + 1):
                if not len(part):
                    continue
                rows = b.slice(part[0], len(part))
                found = words.ids(rows.column("_text").to_pylist())
                keys = hilbert_key(cells(np.stack([vector(f) for f in found])))
                found = [np.append(f, np.uint32(end)) for f in found]
                packed = [f.astype(kind).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(keys), pa.array([len(f) for f in found], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "key", "n", "ids"])

    made = rows.mapInArrow(run, "doc_id bigint, key bigint, n bigint, ids binary")
    return saved(made.withColumn("row", F.monotonically_increasing_id()), "ids")


def pieces(ids: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of :func:`encoded` rows: ``doc_id``, ``start``, ``length``, ``ids`` (packed as before), ``ids_crc32`` (of
    32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset``."""
    placed = running(ids.select("row", "key", "n", F.xxhash64("doc_id").alias("tie")), None, ["key", "tie", "row"], {"end": F.col("n")})
    placed = saved(placed.select("row", (F.col("end") - F.col("n")).alias("at")), "places")
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = total // capacity
    rest = [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> k & 1]
    # borders of the last sequences, by powers of two
    tail = whole * capacity + np.cumsum([0, *rest])

    def run(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for row, (n, at) in enumerate(zip(b.column("n").to_pylist(), b.column("at").to_pylist())):
                data = b.column("ids")[row].as_buffer()
                width = data.size // n
                view, lo = memoryview(data), at
                while lo < at + n:
                    if lo < whole * capacity:
                        seq = lo // capacity
                        begin, stop = seq * capacity, (seq + 1) * capacity
                    else:
                        k = int(np.searchsorted(tail, lo, "right")) - 1
                        seq, begin, stop = whole + k, int(tail[k]), int(tail[k + 1])
                    hi = min(stop, at + n)
                    part = bytes(view[(lo - at) * width : (hi - at) * width])
                    crc = zlib.crc32(np.frombuffer(part, f"<u{width}").astype("<u4").tobytes())
                    for column, value in zip(out, (row, lo - at, hi - lo, part, crc, n, seq, lo - begin)):
                        column.append(value)
                    lo = hi
            rows, starts, lengths, parts, crcs, sizes, seqs, offsets = out
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    met = ids.select("row", "doc_id", "n", "ids").join(placed, "row").select("doc_id", "n", "ids", "at")
    return met.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as pieces of sequences of ``capacity`` ids, neighbours on the curve together."""
    return pieces(encoded(docs, tokenizer, end, id_col, text_col), capacity)
