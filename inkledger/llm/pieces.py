"""Sampled segmentations over the piece lattice of a given vocabulary, and lossless decoding.

A text, with a space before it, falls into chunks: spaces and what follows up
to the next space. No piece of the vocabulary goes from a non-space to a space (checked
on loading), so the lattice is a chain of chunk lattices. Forward filtering
sums the weights of all segmentations up to each position; backward sampling
then picks the last piece, the one before it and so on, each in proportion. A
piece of rank r weighs (r + RANK_SHIFT)^-sharpness. Characters without a piece
are their bytes' pieces. The random numbers are hashes of seed, row key, place of the chunk
in the text and step, so a row's segmentation depends on nothing else.

All distinct chunks of one length are filtered at once, and all their
occurrences are sampled at once.

Cases: null and empty texts have no pieces; texts keep every character, the
space sign U+2581 included (spelt by bytes); null row keys draw like key 0;
repeated rows get the same pieces; an empty table gives no rows; other
columns are ignored by `encode`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import mix, slices

SPACE = "▁"
CHUNK = re.compile(r" *[^ ]+| +")
SHARPNESS = 0.3
RANK_SHIFT = 10.0
#: Longer chunks are filtered one by one.
LONGEST_AT_ONCE = 24
#: A character without a piece is this plus its code point until its bytes are written.
OUTSIDE = 1 << 24
OUTSIDE_WEIGHT = -25.0
#: First bits of a hash, by which pieces are looked up.
HASH_BITS = 20
TEXT_BYTES = 2 << 20
ID_BYTES = 4


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = [b""] * n
        self.ids: dict[str, int] = {}
        self.weight = np.zeros(n)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                spaced = piece.replace(SPACE, " ")
                if " " in spaced.lstrip(" "):
                    raise ValueError(f"piece {i} goes from a non-space to a space")
                self.ids[spaced] = i
                self.bytes_of[i] = spaced.encode()
                self.weight[i] = -sharpness * np.log(i + RANK_SHIFT)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.longest = max(map(len, self.ids))
        keys = np.array([fold(np.frombuffer(p.encode("utf-32-le"), np.uint32)[None, :])[0] for p in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.fromiter(self.ids.values(), np.int64, len(self.ids))[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        place = (self.keys >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        first, count = np.unique(place, return_index=True, return_counts=True)[1:]
        self.first = np.zeros(1 << HASH_BITS, np.int32)
        self.first[place[first]] = first
        self.crowd = int(count.max())
        #: By first bits of a hash: 1 if it may be a piece, 2 if a longer piece may begin so.
        self.kind = np.zeros(1 << HASH_BITS, np.uint8)
        self.kind[place] = 1
        begins = sorted({p[:k] for p in self.ids for k in range(1, len(p))})
        by_size: dict[int, list[str]] = {}
        for p in begins:
            by_size.setdefault(len(p), []).append(p)
        for size, own in by_size.items():
            codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), size)
            self.kind[fold(codes) >> np.uint64(64 - HASH_BITS)] |= 2

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, and their ids; and places of those that longer pieces may begin with."""
        place = (keys >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        kind = self.kind[place]
        likely = np.flatnonzero(kind & 1)
        own, at = keys[likely], self.first[place[likely]]
        found = np.full(len(likely), -1, np.int64)
        for k in range(self.crowd):
            near = np.minimum(at + k, len(self.keys) - 1)
            found = np.where(self.keys[near] == own, near, found)
        good = found >= 0
        return likely[good], self.key_ids[found[good]], np.flatnonzero(kind & 2)


@lru_cache(maxsize=2)
def vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


def fold(codes: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    h = np.zeros(codes.shape[0], np.uint64)
    for k in range(codes.shape[1]):
        h = step_hash(h, codes[:, k])
    return h


def step_hash(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix((h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + code.astype(np.uint64))


def draw(row: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) of row keys, places and a step."""
    h = mix(mix(row + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) + np.uint64(step * 0xE7037ED1A0B428DB % (1 << 64)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def filter_chunks(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chunks of one length: of each end and piece length, the cumulative chance of that last piece, and its id."""
    n, length = codes.shape
    most = min(length, v.longest)
    flat = np.ascontiguousarray(codes.T).ravel()  # character k of chunk i stands at k * n + i
    ids = np.full((length, most, n), -1, np.int32)
    ids[:, 0] = OUTSIDE + flat.reshape(length, n)
    weight = np.full((length, most, n), -np.inf)
    weight[:, 0] = OUTSIDE_WEIGHT
    live = np.arange(length * n)
    h = np.zeros(length * n, np.uint64)
    for size in range(1, most + 1):
        inside = np.searchsorted(live, (length - size + 1) * n)
        live = live[:inside]
        h = step_hash(h[:inside], flat[live + (size - 1) * n])
        at, of, longer = v.find(h)
        begin = live[at]
        cell = ((begin // n + size - 1) * most + size - 1) * n + begin % n
        ids.reshape(-1)[cell] = of
        weight.reshape(-1)[cell] = v.weight[of]
        live, h = live[longer], h[longer]
    total = np.zeros((length + 1, n))
    chance = np.ones((length, most, n))
    for end in range(1, length + 1):
        k = min(end, most)
        # total before a piece of size s that ends here stands at end - s
        own = weight[end - 1, :k]
        own += total[end - k : end][::-1]
        top = own.max(axis=0)
        own -= top
        np.exp(own, out=own)
        sums = np.cumsum(own, axis=0, out=chance[end - 1, :k])
        total[end] = top + np.log(sums[-1])
        sums /= sums[-1].copy()
    return np.ascontiguousarray(chance.transpose(2, 0, 1)), np.ascontiguousarray(ids.transpose(2, 0, 1))


def filter_long(v: Vocabulary, text: str) -> tuple[list[np.ndarray], list[list[int]]]:
    """The same of one long chunk, by its ends."""
    total, chances, ids = [0.0], [], []
    for end in range(1, len(text) + 1):
        of, at = [], []
        for size in range(1, min(end, v.longest) + 1):
            i = v.ids.get(text[end - size : end], -1)
            i = OUTSIDE + ord(text[end - 1]) if i < 0 and size == 1 else i
            of.append(i)
            at.append(-np.inf if i < 0 else total[end - size] + (OUTSIDE_WEIGHT if i >= OUTSIDE else v.weight[i]))
        w = np.array(at)
        top = w.max()
        e = np.exp(w - top)
        total.append(top + np.log(e.sum()))
        c = np.cumsum(e)
        chances.append(c / c[-1])
        ids.append(of)
    return chances, ids


def sample(v: Vocabulary, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray]:
    """Piece ids of each text; keys: the random key of each row."""
    parts = [CHUNK.findall(" " + t) if t else [] for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = pa.array([c for p in parts for c in p], pa.string()).dictionary_encode()
    chunk = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.dictionary.to_pylist()
    row = np.repeat(keys, sizes)
    place = np.arange(len(chunk)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = np.array([len(c) for c in values], np.int64)
    of = length[chunk] if len(chunk) else chunk
    taken: list[tuple[np.ndarray, int, np.ndarray]] = []  # occurrences, step, ids
    for n in np.unique(of[of <= LONGEST_AT_ONCE]):
        kinds = np.flatnonzero(length == n)
        codes = np.frombuffer("".join(values[k] for k in kinds).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(kinds), n).astype(np.int64)
        chance, ids = filter_chunks(v, codes)
        local = np.zeros(len(values), np.int64)
        local[kinds] = np.arange(len(kinds))
        live = np.flatnonzero(of == n)
        end, step = np.full(len(live), n), 0
        while len(live):
            kind = local[chunk[live]]
            u = draw(row[live], place[live], step)
            size = (chance[kind, end - 1] > u[:, None]).argmax(axis=1)  # the last one is 1
            taken.append((live, step, ids[kind, end - 1, size]))
            end = end - size - 1
            more = end > 0
            live, end, step = live[more], end[more], step + 1
    for occurrence in np.flatnonzero(of > LONGEST_AT_ONCE):
        chances, ids = filter_long(v, values[chunk[occurrence]])
        end, step = len(ids), 0
        while end:
            u = draw(row[occurrence : occurrence + 1], place[occurrence : occurrence + 1], step)[0]
            size = int((u >= chances[end - 1]).sum())
            taken.append((np.array([occurrence]), step, np.array([ids[end - 1][size]])))
            end, step = end - size - 1, step + 1
    count = np.zeros(len(chunk) + 1, np.int64)
    for live, _, _ in taken:
        count[live + 1] += 1
    ends = np.cumsum(count)
    out = np.zeros(ends[-1], np.int64)
    for live, step, ids in taken:
        out[ends[live + 1] - 1 - step] = ids
    bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
    return [spell(v, out[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def spell(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Write characters without a piece as their bytes' pieces."""
    outside = np.flatnonzero(ids >= OUTSIDE)
    if not len(outside):
        return ids
    pieces, at = [], 0
    for k in outside:
        pieces += [ids[at:k], v.byte[list(chr(ids[k] - OUTSIDE).encode("utf-8", "surrogatepass"))]]
        at = k + 1
    return np.concatenate([*pieces, ids[at:]])


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of some piece ids, in UTF-8, without the space put before it."""
    return b"".join(map(v.bytes_of.__getitem__, ids.tolist()))[1:]


def row_keys(doc_ids: list[int | None], seed: int) -> np.ndarray:
    ids = np.array([d or 0 for d in doc_ids], np.int64).astype(np.uint64)
    return mix(ids * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))


def encoder(path: str | None, sharpness: float, seed: int, digest: bool):
    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_vocabulary(), sharpness)
        for whole in batches:
            for batch in slices(whole, most=TEXT_BYTES):
                doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                ids = sample(v, texts, row_keys(doc_ids, seed))
                counts = pa.array([len(x) for x in ids], pa.int64())
                if not digest:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n_pieces", "piece_ids"])
                    continue
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                back = [decode(v, x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), counts, pa.array([len(b) for b in raw], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                        pa.array([a == b for a, b in zip(raw, back, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "n_bytes", "pieces_sha256", "decoded_sha256", "lossless"],
                )

    return encode_batches


def encode(docs: DataFrame, text: str = "text", path: str | None = None, sharpness: float = SHARPNESS, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, piece_ids: one sampled segmentation of each whole text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    return docs.mapInArrow(encoder(path, sharpness, seed, False), "doc_id long, n_pieces long, piece_ids array<int>")


def decoded(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of doc_id, piece_ids."""

    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_vocabulary(), SHARPNESS)
        for batch in batches:
            texts = [decode(v, np.array(x or [], np.int64)).decode("utf-8", "surrogatepass") for x in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(decode_batches, "doc_id long, text string")


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, sharpness: float = SHARPNESS, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, n_bytes, pieces_sha256 (of the ids as 32-bit little-endian), decoded_sha256, lossless."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    return docs.mapInArrow(encoder(path, sharpness, seed, True), "doc_id long, n_pieces long, n_bytes long, pieces_sha256 string, decoded_sha256 string, lossless boolean")
