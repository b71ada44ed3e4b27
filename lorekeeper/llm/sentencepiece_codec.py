"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
#: Words up to this length are merged many at a time, longer ones with a heap.
WIDE = 32
#: Words whose undropped merges a task remembers before it forgets all, words that are cut
#: at once, and words of one length that are merged in step.
REMEMBERED, AT_ONCE, IN_STEP = 500_000, 200_000, 20_000

#: Runs of spaces go with what follows.  No piece has a Latin letter beside another
#: character; a model in which one has is cut at spaces and line ends only.
_LATIN = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u1e00-\u1eff"
_FINE = re.compile(rf" *[{_LATIN}]+| *[^ \n{_LATIN}]+| +|\n")
_COARSE = re.compile(r" *[^ \n]+| +|\n")
_MASK = (1 << 64) - 1
#: What a copy adds to the key of its document.
_COPY = 0xD6E8FEB86659FD93
_K = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _mix(x):
    """A bijection of 64-bit numbers, for arrays and plain integers alike."""
    if isinstance(x, int):
        x = ((x ^ (x >> 32)) * _K[3]) & _MASK
        x = ((x ^ (x >> 32)) * _K[3]) & _MASK
        return x ^ (x >> 32)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_K[3])
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_K[3])
    return x ^ (x >> np.uint64(32))


#: The rank of what is no merge.
_NONE = np.int32(2**31 - 1)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + sizes[i] - 1`` of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _joined(parts: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all parts one after the other, and how many each part has."""
    data = np.frombuffer(b"".join(parts), dtype=kind)
    return data, np.fromiter(map(len, parts), np.int64, len(parts)) // data.itemsize


class Codec:
    """The pieces of a byte-fallback BPE model and the merges that they allow."""

    def __init__(self, model_file: str, dropout: float, seed: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.dropout, self.seed = int(dropout * 2**53), seed
        size = sp.vocab_size()
        self.size = size
        pieces, self.bytes_of = {}, [b""] * size
        self.byte_id = [0] * 256
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                # A space is the mark in the model; a mark in a text is spelled in bytes.
                pieces[piece.replace("▁", " ")] = i
                self.bytes_of[i] = piece.replace("▁", " ").encode()
        self.words = _FINE if all(len(_FINE.findall(p)) == 1 for p in pieces) else _COARSE
        self.single = {p: i for p, i in pieces.items() if len(p) == 1}
        pairs = {}
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = (i, sp.get_score(i))
        # Pairs in a hash table with open places, and their ranks: the best score is the lowest.
        keys = np.array(list(pairs), dtype=np.int64)
        self.pair_piece = np.array([i for i, _ in pairs.values()], dtype=np.int32)
        self.pair_rank = np.unique([-x for _, x in pairs.values()], return_inverse=True)[1].astype(np.int32)
        self.shift = np.uint64(64 - max(4, len(pairs).bit_length() + 3))
        self.table_key = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.table_pair = np.zeros(len(self.table_key), dtype=np.int32)
        left = np.arange(len(keys))
        spot = self._spot(keys)
        while len(left):
            free = np.flatnonzero(self.table_key[spot] < 0)
            first = free[np.unique(spot[free], return_index=True)[1]]
            self.table_key[spot[first]], self.table_pair[spot[first]] = keys[left[first]], left[first]
            wait = np.delete(np.arange(len(left)), first)
            left, spot = left[wait], (spot[wait] + 1) & (len(self.table_key) - 1)
        self.pairs = pairs
        table = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.single.items():
            table[ord(c)] = i
        self.char_piece = table

    def _salt(self, doc: int, place: int = 0) -> int:
        """The key of the draws of a document's word at ``place``."""
        return _mix((_mix((self.seed * _K[0] + (doc + 1) * _K[1]) & _MASK) + place * _K[0]) & _MASK)

    def _salts(self, docs: list[int], sizes: list[int]) -> np.ndarray:
        """``_salt`` of all words of documents with so many words."""
        n = np.array(sizes, dtype=np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.array([_mix((self.seed * _K[0] + (d + 1) * _K[1]) & _MASK) for d in docs], dtype=np.uint64)
        return _mix(np.repeat(first, n) + place.astype(np.uint64) * np.uint64(_K[0]))

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        """Where the search for each pair begins in the hash table."""
        return ((keys.astype(np.uint64) * np.uint64(_K[0])) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of pairs of symbols that merge, -1 for all others, and the pairs as keys."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        spot = self._spot(key)
        found = self.table_key[spot]
        pair = np.where(found == key, self.table_pair[spot], -1)
        more = np.flatnonzero((found != key) & (found >= 0))
        spot = spot[more]
        while len(more):
            spot = (spot + 1) & (len(self.table_key) - 1)
            found = self.table_key[spot]
            hit = found == key[more]
            pair[more[hit]] = self.table_pair[spot[hit]]
            go = ~hit & (found >= 0)
            more, spot = more[go], spot[go]
        return pair, key

    def _draw(self, salts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which merges are skipped, by the keyed hash of place and pair."""
        return (_mix(salts ^ codes) >> np.uint64(11)) < np.uint64(self.dropout)

    def _merge(self, points: np.ndarray, salts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best-scored, leftmost merges of words of one length in step, until no word has one left.

        Each merge is drawn as it is offered, unless ``salts`` is None.  Gives the symbols of
        all words one after the other, their number in each word, and the codes of all merges
        offered with the number of their word.
        """
        n, width = points.shape
        symbols = self.char_piece[points]
        # Characters without a piece are negative: their code point, to be spelled in bytes.
        symbols = np.where(symbols < 0, (-2 - points).astype(np.int32), symbols).ravel()
        after = np.tile(np.arange(1, width + 1, dtype=np.int8), (n, 1)).ravel()
        before = np.tile(np.arange(-1, width - 1, dtype=np.int8), (n, 1)).ravel()
        rank = np.full((n, width), _NONE, dtype=np.int32)
        flat = rank.ravel()
        offered: list[tuple[np.ndarray, np.ndarray]] = []

        def offer(rows: np.ndarray, places: np.ndarray) -> None:
            """The merges of places with the next symbol of their words, which all have one."""
            at = rows * width + places
            pair, key = self._pairs(symbols[at], symbols[rows * width + after[at]])
            flat[at] = _NONE
            hit = np.flatnonzero(pair >= 0)
            codes = places[hit].astype(np.uint64) * np.uint64(_K[1]) + key[hit].astype(np.uint64) * np.uint64(_K[2])
            if salts is None:
                offered.append((rows[hit], codes))
            else:
                hit = hit[~self._draw(salts[rows[hit]], codes)]
            flat[at[hit]] = self.pair_rank[pair[hit]]

        if width > 1:
            offer(np.repeat(np.arange(n), width - 1), np.tile(np.arange(width - 1), n))
        live = np.arange(n)
        gone = np.zeros(n * width, dtype=bool)
        while len(live):
            best = (rank if len(live) == n else rank[live]).argmin(axis=1)
            at = live * width + best
            can = flat[at] < _NONE
            live, best, at = live[can], best[can], at[can]
            right = after[at].astype(np.int64)
            other = live * width + right
            pair, _ = self._pairs(symbols[at], symbols[other])
            symbols[at] = self.pair_piece[pair]
            gone[other], flat[other] = True, _NONE
            then = after[other]
            after[at] = then
            more = then < width
            before[(live * width + then)[more]] = best[more]
            flat[at[~more]] = _NONE
            offer(live[more], best[more])
            prior = before[at].astype(np.int64)
            some = prior >= 0
            offer(live[some], prior[some])
        rows, codes = (np.concatenate(c) for c in zip(*offered, strict=True)) if offered else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        keep = ~gone
        return symbols[keep], keep.reshape(n, width).sum(axis=1), codes, rows

    def _by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word numbers and code points of words of one length, a bounded number of words at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, edges) if len(order) else ():
            for a in range(0, len(group), IN_STEP):
                rows = group[a : a + IN_STEP]
                text = "".join([words[i] for i in rows.tolist()]).encode("utf-32-le", "surrogatepass")
                yield rows, np.frombuffer(text, dtype=np.uint32).astype(np.int64).reshape(len(rows), -1)

    def _learn(self, words: list[str], memory: dict) -> None:
        """Remember each word's undropped symbols and the merges that are offered on the way, as codes."""
        for rows, points in self._by_length(words):
            symbols, counts, codes, owner = self._merge(points, None)
            codes = codes[np.argsort(owner, kind="stable")].tobytes()
            data = symbols.tobytes()
            ends, code_ends = np.cumsum(counts) * 4, np.cumsum(np.bincount(owner, minlength=len(rows))) * 8
            starts, code_starts = [0, *ends.tolist()], [0, *code_ends.tolist()]
            for i, a, b, c, d in zip(rows.tolist(), starts, ends.tolist(), code_starts, code_ends.tolist(), strict=False):
                memory[words[i]] = (data[a:b], codes[c:d])

    def _segment(self, words: list[str], keys: np.ndarray, memory: dict) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of all words, each under its own key, one after the other, and their number in each word.

        A word none of whose undropped merges is skipped under its key has the undropped
        segmentation, which is remembered; all others are merged one by one with their draws.
        """
        place = dict.fromkeys(words)
        distinct = list(place)
        place.update(zip(distinct, range(len(distinct)), strict=True))
        number = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        wide = np.fromiter(map(len, distinct), np.int64, len(distinct)) > WIDE
        nothing = (b"", b"")
        for i in np.flatnonzero(wide).tolist():
            memory.setdefault(distinct[i], nothing)
        self._learn([w for w in distinct if w not in memory], memory)
        known = list(map(memory.__getitem__, distinct))
        ids, id_counts = _joined([k[0] for k in known], np.int32)
        codes, code_counts = _joined([k[1] for k in known], np.uint64)
        long = wide[number]

        counts = id_counts[number]
        odd: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if self.dropout:
            offers = code_counts[number]
            drawn = self._draw(np.repeat(keys, offers), codes[_spans(np.cumsum(code_counts)[number] - offers, offers)])
            hits = np.flatnonzero(drawn)
            again = np.unique(np.searchsorted(np.cumsum(offers), hits, side="right"))
            for rows, points in self._by_length([words[i] for i in again.tolist()]):
                rows = again[rows]
                symbols, n, _, _ = self._merge(points, keys[rows])
                odd.append((rows, symbols, n))
        for i in np.flatnonzero(long).tolist():
            symbols = np.array(self._merge_long(words[i], int(keys[i])), dtype=np.int32)
            odd.append((np.array([i]), symbols, np.array([len(symbols)])))
        plain = ~long
        for rows, _, n in odd:
            counts[rows], plain[rows] = n, False
        ends = np.cumsum(counts)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.int32)
        which = number[plain]
        out[_spans((ends - counts)[plain], counts[plain])] = ids[_spans((np.cumsum(id_counts) - id_counts)[which], id_counts[which])]
        for rows, symbols, n in odd:
            out[_spans((ends - counts)[rows], n)] = symbols
        return self._spelled(out, counts)

    def _spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes, and the new numbers of pieces in each word."""
        at = np.flatnonzero(symbols < 0)
        if not len(at):
            return symbols, counts
        spelled = [[self.byte_id[b] for b in chr(-2 - s).encode("utf-8", "surrogatepass")] for s in symbols[at].tolist()]
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[at] = [len(x) for x in spelled]
        out = np.repeat(symbols, sizes)
        out[_spans((np.cumsum(sizes) - sizes)[at], sizes[at])] = np.concatenate([np.array(x, dtype=np.int32) for x in spelled])
        extra = np.bincount(np.searchsorted(np.cumsum(counts), at, side="right"), sizes[at] - 1, len(counts))
        return out, counts + extra.astype(np.int64)

    def _cut(self, words: list[str], keys: np.ndarray, memory: dict) -> list[bytes]:
        """The piece ids of each word under its own key."""
        ids, counts = self._segment(words, keys, memory)
        ends = np.cumsum(counts).tolist()
        return [ids[b - n : b].tobytes() for b, n in zip(ends, counts.tolist(), strict=True)]

    def encode_words(self, words: list[str], doc: int) -> list[bytes]:
        """The piece ids of each word as the first of a document; a word has a space at most at its start."""
        return self._cut(words, np.full(len(words), self._salt(doc), dtype=np.uint64), {})

    def _encode_long(self, word: str, salt: int) -> bytes:
        """The piece ids of one word, by ``_merge_long``."""
        symbols = np.array(self._merge_long(word, salt), dtype=np.int32)
        return self._spelled(symbols, np.array([len(symbols)]))[0].tobytes()

    def _merge_long(self, word: str, salt: int) -> list[int]:
        """The same merges for one long word, with a heap as agenda."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        symbols = [int(self.char_piece[p]) if self.char_piece[p] >= 0 else -2 - p for p in points.tolist()]
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        agenda: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i < 0 or j >= len(symbols) or symbols[i] < 0 or symbols[j] < 0:
                return
            pair = symbols[i] * self.size + symbols[j]
            if pair in self.pairs:
                draw = _mix((salt ^ ((i * _K[1] + pair * _K[2]) & _MASK)) & _MASK)
                if not draw >> 11 < self.dropout:
                    heapq.heappush(agenda, (-self.pairs[pair][1], i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i)
        gone = [False] * len(symbols)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or j >= len(symbols) or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], gone[j], after[i] = self.pairs[left * self.size + right][0], True, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def encode(self, texts: list[str], docs: list[int], memory: dict) -> list[bytes]:
        """Piece ids of each text as little-endian 32-bit integers; ``memory`` has cuts done before."""
        cut = [self.words.findall(f" {t}") if t else [] for t in texts]
        sizes = [len(words) for words in cut]
        keys = self._salts(docs, sizes)
        flat = [w for words in cut for w in words]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(flat), AT_ONCE):
            if len(memory) > REMEMBERED:
                memory.clear()
            parts.append(self._segment(flat[at : at + AT_ONCE], keys[at : at + AT_ONCE], memory))
        if not parts:
            return [b""] * len(texts)
        data = np.concatenate([ids for ids, _ in parts]).tobytes()
        word_ends = np.concatenate([[0], *[counts for _, counts in parts]]).cumsum() * 4
        ends = word_ends[np.cumsum([0, *sizes])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: bytes) -> str:
        """The text of piece ids, without the space that encoding puts first."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))
        return data[1:].decode("utf-8", "surrogatepass")


def _encoded(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[tuple[pa.RecordBatch, list[str], list[bytes]]]:
    """Rows, texts and ids of runs of about a million characters."""
    memory: dict = {}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        docs = [-1 if i is None else i for i in batch.column("doc_id").to_pylist()]
        if "copy" in batch.schema.names:
            docs = [i + c * _COPY for i, c in zip(docs, batch.column("copy").to_pylist(), strict=True)]
        at = 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) <= 1_000_000):
                n += len(texts[to])
                to += 1
            yield batch.slice(at, to - at), texts[at:to], codec.encode(texts[at:to], docs[at:to], memory)
            at = to


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def encode_documents(docs: DataFrame, model_file: str = MODEL, dropout: float = DROPOUT, seed: int = 0, copy: Column | None = None, position: Column | None = None) -> DataFrame:
    """doc_id, ids (piece ids) and decoded (their text) for every row of ``docs``.

    Words are merged best score first, leftmost among equals, as the model's BPE does, but
    each candidate merge is skipped with probability ``dropout`` by a hash of the seed, the
    doc_id, the copy, the word's position in the text, the place in the word and the pair; so reruns
    agree, and every occurrence of a word has draws of its own.  Every cut decodes to the text itself: what
    has no piece is spelled in bytes.  A null text counts as empty and has no ids; a null
    doc_id counts as -1; rows that repeat are encoded alike, unless ``copy`` numbers them
    from 0; further columns are ignored.  ``copy`` and ``position`` are in the result where they are given.
    The model file is read where the tokenizers are installed, on each executor.
    """
    given = {n: c.cast("long").alias(n) for n, c in (("copy", copy), ("position", position)) if c is not None}
    more = list(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file, dropout, seed)
        for rows, _, ids in _encoded(batches, codec):
            lists = pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32()))
            decoded = pa.array([codec.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, decoded, *[rows.column(n) for n in more]], ["doc_id", "ids", "decoded", *more])

    return _texts(docs, *given.values()).mapInArrow(run, ", ".join(["doc_id long, ids array<int>, decoded string", *[f"{n} long" for n in more]]))


def encoding_digests(docs: DataFrame, model_file: str = MODEL, dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """``encode_documents`` with n_pieces, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 and lossless.

    The digests are taken where the ids are made, so that ids are not moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file, dropout, seed)
        for rows, texts, ids in _encoded(batches, codec):
            decoded = [codec.decode(x) for x in ids]
            arrays = [
                rows.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded]),
                pa.array([x == t for x, t in zip(decoded, texts, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "lossless"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean")
