"""BPE encoding and decoding with chunks that documents share encoded once.

A rolling hash over bytes cuts texts at places that depend on the content alone, so copies and shared
passages give the same chunks. Chunks in more than one document are shared: the document with the
least key publishes their ids, the others take them. All other text is encoded where it is. A join of
two pieces is repaired by encoding the words around it again: from a place left of it to one right of
it at which no token can cross, further out until both sides' own tokens agree with those places.

Places no token can cross are those where a blank or line feed follows a printable ASCII character, or
a sign follows a letter: the pattern that splits words ends a word there whatever surrounds it, and no
special token of the vocabulary has such a place, which is checked. Letters here are ASCII and those of
scripts written without blanks. Inside a long run of the latter there is no such place. There the bytes
around a join are encoded again from one token border to another; if the first new token is the old one
there and the last one too, all neighbours are as merging leaves them, which makes the whole run exact.
What a document takes for a chunk is decoded and compared with the chunk first, so a hash
that repeats costs work and changes nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import slices, small_batches, whole_text
from taxaflow.llm.vocabulary import Codec, codec, tokenizer_path
from taxaflow.session import settle

LEAST, MASK_BITS, MOST = 256, 10, 8192  # bytes of a chunk: least, power of the mean beyond it, most
WINDOW = 16  # bytes the rolling hash sees
GEAR = np.random.default_rng(1).integers(0, 2**32, 256, np.uint32)
BROADCAST_OWNERS = 500_000  # documents that publish, a key and a few hashes each; beyond it their texts are shuffled
REPAIR = 64  # bytes first looked at either side of a join

# Fixed values, UTF-8: letters of scripts without blanks (Thai consonants, kana, ideographs, Hangul), and signs.
LETTER = rb"(?:\xe0\xb8[\x81-\xae]|\xe3\x81[\x81-\xbf]|\xe3\x82[\x80-\x96\xa1-\xbf]|\xe3\x83[\x80-\xba]|\xe4[\xb8-\xbf][\x80-\xbf]|[\xe5-\xe8][\x80-\xbf]{2}|\xe9[\x80-\xbd][\x80-\xbf]|\xe9\xbe[\x80-\xa5]|\xea[\xb1-\xbf][\x80-\xbf]|[\xeb-\xec][\x80-\xbf]{2}|\xed[\x80-\x9d][\x80-\xbf])"
SIGN = rb"(?:[\x00-\x20!-&(-,.:;?@~{}]|\xe3\x80[\x80-\x82\x88-\x91]|\xef\xbc[\x81-\x8f\x9a-\xa0])"
SAFE = re.compile(rb"[\x21-\x7e](?=[ \n])|(?:[A-Za-z]|" + LETTER + rb")(?=" + SIGN + rb")")
LETTERS = re.compile(LETTER + rb"+")


def is_safe(raw: bytes, place: int) -> bool:
    return any(m is not None and m.end() == place for m in (SAFE.match(raw, max(0, place - width)) for width in (1, 3)))


def rolling_cuts(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash asks for a cut, at starts of characters only."""
    total, seen = GEAR[data], 1
    while seen < min(WINDOW, len(data)):  # a window's sum from those of its halves
        wider = total.copy()
        wider[seen:] += total[:-seen] << np.uint32(seen)
        total, seen = wider, 2 * seen
    asked = (total >> np.uint32(WINDOW - 1)) & np.uint32((1 << MASK_BITS) - 1) == 0
    asked[:-1] &= (data[1:] & 0xC0) != 0x80
    return np.flatnonzero(asked) + 1


def chunk_bounds(raw: bytes) -> list[int]:
    """Ends of a text's chunks."""
    bounds, last, size = [], 0, len(raw)
    cuts = rolling_cuts(np.frombuffer(raw, np.uint8)).tolist() if size > LEAST else []
    for cut in [*cuts, size]:
        while cut - last > MOST:
            last += MOST
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            bounds.append(last)
        if cut - last >= LEAST or (cut == size and cut > last):
            bounds.append(cut)
            last = cut
    return bounds


def chunk_hash(chunk: bytes) -> int:
    return xxhash.xxh64_intdigest(chunk) - (1 << 63)


def chunks_of(raw: bytes) -> tuple[list[int], list[int]]:
    bounds = chunk_bounds(raw)
    return bounds, [chunk_hash(raw[a:b]) for a, b in zip([0, *bounds], bounds, strict=False)]


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            keys, hashes = [], []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = set(chunks_of(text.encode())[1])
                keys += [key] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], names=["key", "chunk"])


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffle."""
    squeezer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch):
            raw = [squeezer.compress(text.encode()) for text in part.column("text").to_pylist()]
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(raw, pa.binary())], names=[*kept, "raw"])


class Tape:
    """Tokens of a growing text, exact for what has been added so far."""

    def __init__(self, coder: Codec, raw: bytes):
        self.coder, self.raw = coder, raw
        self.parts: list[np.ndarray] = []
        self.starts: list[int] = []
        self.end = 0

    def tokens_before(self, place: int) -> tuple[int, int] | None:
        """Part and token that start at ``place``, or None if a token crosses it."""
        at = len(self.parts) - 1
        while at >= 0 and self.starts[at] > place:
            at -= 1
        if at < 0:
            return 0, 0
        ends = np.cumsum(self.coder.lengths[self.parts[at]])
        offset = place - self.starts[at]
        token = int(np.searchsorted(ends, offset, side="right"))
        return (at, token) if offset == 0 or (token and ends[token - 1] == offset) else None

    def add(self, ids: np.ndarray, end: int) -> None:
        """Append the tokens of the bytes from here to ``end``, encoded on their own."""
        here = self.end
        if here and len(ids):
            ids = self.repaired(ids, here, end)
        else:
            self.starts.append(here)
        self.parts.append(ids)
        self.end = end

    def repaired(self, ids: np.ndarray, here: int, end: int) -> np.ndarray:
        raw = self.raw
        if is_safe(raw, here):
            self.starts.append(here)
            return ids
        reach = REPAIR
        ends = np.cumsum(self.coder.lengths[ids])
        while True:
            left_most, right_most = max(0, here - reach), min(end, here + reach)
            lefts = [m.end() for m in SAFE.finditer(raw, left_most, here)]
            rights = [m.end() for m in SAFE.finditer(raw, here, min(end, right_most + 1))]
            left = lefts[-1] if lefts else 0 if not left_most else None
            right = rights[0] if rights else end if right_most == end else None
            if left is not None and right is not None:
                before = self.tokens_before(left)
                token = int(np.searchsorted(ends, right - here, side="left"))
                if before is not None and token < len(ends) and ends[token] == right - here:
                    between = self.coder.encode(raw[left:right].decode())
                    return self.spliced(before, left, np.concatenate([between, ids[token + 1 :]]))
            agreed = self.agreed(ids, ends, here, reach)
            if agreed is not None:
                return self.spliced(*agreed)
            reach *= 2


    def agreed(self, ids: np.ndarray, ends: np.ndarray, here: int, reach: int) -> tuple[tuple[int, int], int, np.ndarray] | None:
        """Where to go on and with what, if letters on both sides agree with the bytes between encoded again."""
        raw = self.raw
        first = next((m.start() for m in LETTERS.finditer(raw, max(0, here - reach), here) if m.end() == here), None)
        after = LETTERS.match(raw, here, min(here + int(ends[-1]), here + reach))
        if first is None or after is None:
            return None
        last = after.end()
        whole = (p for p in range(first, here) if raw[p] & 0xC0 != 0x80)
        found = next(((p, at) for p in whole if (at := self.tokens_before(p)) is not None), None)
        right = next((here + int(e) for e in ends[: np.searchsorted(ends, last - here, side="right")][::-1] if here + e == len(raw) or raw[here + e] & 0xC0 != 0x80), None)
        if found is None or right is None:
            return None
        left, (part, count) = found
        token = int(np.searchsorted(ends, right - here, side="left"))
        between = self.coder.encode(raw[left:right].decode())
        if count == len(self.parts[part]) or between[0] != self.parts[part][count] or between[-1] != ids[token]:
            return None
        return (part, count), left, np.concatenate([between, ids[token + 1 :]])

    def spliced(self, before: tuple[int, int], left: int, ids: np.ndarray) -> np.ndarray:
        """Drop the tokens from ``left`` on, where ``ids`` will stand instead."""
        part, count = before
        del self.parts[part + 1 :], self.starts[part + 1 :]
        self.parts[part] = self.parts[part][:count]
        self.starts.append(left)
        return ids


def assemble(coder: Codec, raw: bytes, ready: dict[int, np.ndarray]) -> np.ndarray:
    """Ids of a text, taking the ids of chunks that ``ready`` has."""
    if any(SAFE.search(token.encode()) for token in coder.special):
        raise ValueError("a special token of this vocabulary can cross a join")
    bounds, hashes = chunks_of(raw)
    tape, pending = Tape(coder, raw), 0
    for start, end, name in zip([0, *bounds], bounds, hashes, strict=False):
        ids = ready.get(name)
        if ids is None or coder.decode_bytes(ids) != raw[start:end]:
            continue
        if pending < start:
            tape.add(coder.encode(raw[pending:start].decode()), start)
        tape.add(ids, end)
        pending = end
    if pending < len(raw):
        tape.add(coder.encode(raw[pending:].decode()), len(raw))
    return np.concatenate(tape.parts) if tape.parts else np.empty(0, np.uint32)


def publish(path: str):
    """Function that encodes the chunks a document owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            names, ids = [], []
            for text, owned in zip(batch.column("text").to_pylist(), batch.column("owned").to_pylist(), strict=True):
                raw, wanted = text.encode(), set(owned)
                bounds, hashes = chunks_of(raw)
                for start, end, name in zip([0, *bounds], bounds, hashes, strict=False):
                    if name in wanted:
                        wanted.discard(name)
                        names.append(name)
                        ids.append(coder.encode(raw[start:end].decode()).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    return run


def encode_rows(path: str, with_ids: bool):
    """Function that encodes documents and decodes the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, opener = codec(path), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, "raw", 1 << 20):
                counts, id_digests, text_digests, kept = [], [], [], []
                for packed, ready in zip(part.column("raw").to_pylist(), part.column("ready").to_pylist(), strict=True):
                    known = {r["chunk"]: np.frombuffer(r["ids"], np.uint32) for r in ready or []}
                    ids = assemble(coder, opener.decompress(packed), known).astype("<u4")
                    data = ids.tobytes()
                    counts.append(len(ids))
                    id_digests.append(hashlib.sha256(data).hexdigest())
                    text_digests.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                    kept.append(data)
                arrays = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def shared_chunks(docs: DataFrame) -> DataFrame:
    """Rows (key, chunk, owner, copies) of chunks that several documents hold, one per key and chunk.

    ``owner`` marks the document that publishes, ``copies`` counts the rows that repeat the key.
    """
    chunks = docs.select("key", "text").mapInArrow(cut, "key long, chunk long")
    owners = chunks.groupBy("chunk").agg(F.min("key").alias("first"), F.max("key").alias("last")).where(F.col("first") != F.col("last"))
    owners = settle(owners.select("chunk", "first"))
    marks = chunks.join(owners, "chunk").groupBy("key", "chunk", (F.col("key") == F.col("first")).alias("owner"))
    return settle(marks.agg(F.count(F.lit(1)).alias("copies")))


def ready_chunks(texts: DataFrame, marks: DataFrame, path: str) -> DataFrame:
    """Per key, the ids of the chunks it shares, each chunk once."""
    owned = settle(marks.where("owner").groupBy("key").agg(F.collect_list("chunk").alias("owned"), F.max("copies").alias("copies")))
    few = owned.count() <= BROADCAST_OWNERS
    once, repeated = (owned.where(c).drop("copies") for c in ("copies = 1", "copies > 1"))
    published = texts.join(F.broadcast(once) if few else once, "key").select("text", "owned")
    if repeated.limit(1).count():
        copies = texts.join(F.broadcast(repeated) if few else repeated, "key", "left_semi").select("key", "text")
        published = published.union(copies.dropDuplicates(["key"]).join(repeated, "key").select("text", "owned"))
    published = published.mapInArrow(publish(path), "chunk long, ids binary")
    return marks.join(published, "chunk").groupBy("key").agg(F.collect_list(F.struct("chunk", "ids")).alias("ready"))


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: ``n_tokens``, digests of the ids and of the decoded text, and the ids.

    ``ids`` is binary, little-endian unsigned 32-bit integers (left out on request). A null text
    counts as empty and has no tokens. Rows that repeat an id and text are encoded each; other
    columns of ``docs`` are left out.
    """
    path = path or tokenizer_path()
    texts = small_batches(docs).select("doc_id", whole_text("text").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    marks = shared_chunks(texts)
    kind = texts.schema["doc_id"].dataType.simpleString()
    packed = texts.mapInArrow(squeeze, f"doc_id {kind}, key long, raw binary")
    taken = ready_chunks(texts, marks, path)
    ids = ", ids binary" if with_ids else ""
    rows = packed.join(taken, "key", "left").select("doc_id", "raw", "ready")
    return rows.mapInArrow(encode_rows(path, with_ids), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Texts of rows that have ``doc_id`` and binary ``ids``."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = [coder.decode(np.frombuffer(ids or b"", "<u4")) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
