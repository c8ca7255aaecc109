"""SentencePiece encoding and decoding with byte spans of the original text.

A text is normalised by longest prefixes through the model's compiled character map, and every normalised byte keeps the
place of its source bytes. The library's segmenter then splits the normalised text, and piece lengths laid end to end are
projected through that alignment: each piece gets a span of the original UTF-8 bytes. The registered query takes its ids,
digests and covered bytes from these ids and spans.

The library normalises what it is given once more; on text that has been through the map already this changes nothing
(the maps are idempotent), and `encode_one` falls back to the library's reading of the original where the pieces do not add
up to our normalised text.

Defined cases: a null or empty text has the end id only and decodes to an empty text. Whole texts are encoded, long or not.
Characters the model does not know get its unknown id. Repeated rows are encoded one by one, an empty table gives no rows. Extra
columns pass through, but for those named as a result, which it replaces, and the text. Python runs in Arrow batches; nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁".encode()
CHUNKS = re.compile(" +[^ ]*").findall
#: Bytes of chunks and their ids kept by a process, in two halves: when the younger is full, it becomes the older, whose chunks
#: are dropped but for those met since. ENTRY is what a chunk takes beside its letters. Longer chunks than LONG are not kept.
CACHED, ENTRY, LONG = 24 * 2**20, 180, 200


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[i : i + size]
            i += size


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, and the null-ended strings its values point to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if size else []
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of text[at:] in the map, and what replaces it."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = k + 1 - at, value
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Normaliser:
    """What the model's normaliser specification says, with source alignment."""

    def __init__(self, model: bytes):
        spec = dict(fields(next((v for n, v in fields(model) if n == 3), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text without the dummy prefix, and the source byte of each of its bytes, with the end's."""
        if not self.map.units and not self.squeeze:
            source = np.frombuffer(text, np.uint8)
            if not self.escape:
                return text, np.arange(len(text) + 1)
            wide = np.where(source == 32, 3, 1)
            return text.replace(b" ", SPACE), np.append(np.repeat(np.arange(len(text)), wide), len(text))
        out, at, i, after_space = bytearray(), [], 0, self.squeeze
        while i < len(text):
            found = self.map.longest(text, i) if self.map.units else None
            if found is None:
                step = 1 if text[i] < 0x80 else 2 if text[i] < 0xE0 else 3 if text[i] < 0xF0 else 4
                found = step, text[i : i + step]
            step, piece = found
            if self.squeeze:
                while after_space and piece.startswith(b" "):
                    piece = piece[1:]
            if piece:
                new = piece.replace(b" ", SPACE) if self.escape else piece
                out += new
                at += [i] * len(new)
                after_space = self.squeeze and piece.endswith(b" ")
            i += step
        end = len(text)
        if self.squeeze:
            blank = SPACE if self.escape else b" "
            while out.endswith(blank):
                end = at[len(out) - len(blank)]
                del out[-len(blank) :], at[-len(blank) :]
        return bytes(out), np.array([*at, end], dtype=np.int64)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.normalise = Normaliser(f.read())
        self.end = self.model.eos_id()
        n = self.model.get_piece_size()
        self.sizes = np.array([1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).encode()) for i in range(n)], dtype=np.int64)
        self.unknown = self.model.unk_id()
        # Where no piece has a space after another character, merges never cross into a run of spaces: the text may be
        # encoded from one run of spaces to the next, and equal chunks once.
        inner = any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(n))
        plain = not self.normalise.map.units and not self.normalise.squeeze and self.normalise.prefix and self.normalise.escape
        self.by_chunks = plain and not inner
        self.cache: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.held = 0
        self.lengths, self.space = self.sizes.tolist(), self.model.piece_to_id("▁")
        self.decimals = [*map(str, range(n))]

    def project(self, ids: np.ndarray, at: np.ndarray, lead: int) -> np.ndarray:
        """The spans of pieces whose sizes add up to the normalised text, `lead` bytes of which are the dummy prefix."""
        edges = at[np.maximum(np.append(0, np.cumsum(self.sizes[ids])) - lead, 0)]
        return np.column_stack([edges[:-1], edges[1:]])

    def encode_one(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids without the end id, and an array (ids, 2) of the byte spans in the original text."""
        source = text.encode()
        bare, at = self.normalise(source)
        ids = np.array(self.model.encode(bare.decode(), num_threads=1), dtype=np.int32)
        lead = len(SPACE if self.normalise.escape else b" ") if self.normalise.prefix and bare else 0
        if self.unknown in ids or int(self.sizes[ids].sum()) != len(bare) + lead:  # an unknown piece's size is not that of its symbol
            found = self.model.encode(text, return_type="proto", num_threads=1).pieces
            return np.array([p.id for p in found], dtype=np.int32), np.array([(p.begin, p.end) for p in found], dtype=np.int64).reshape(-1, 2)
        return ids, self.project(ids, at, lead)

    def look_up(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of each chunk, a run of spaces and what follows up to the next, as 32-bit numbers.

        None stands for a chunk whose pieces do not add up to it, as it holds characters that the model does not know.
        """
        young, older = self.cache, self.older
        missing = {p for p in pieces if p not in young}
        if not missing:
            return [young[p] for p in pieces]
        found = {p: older[p] for p in missing if p in older}
        new = [p for p in missing if p not in found]
        all_ids = self.model.encode([p[1:] for p in new], num_threads=1)  # the first space is what the dummy prefix stands for
        for p, ids in zip(new, all_ids):
            if p == " ":
                ids = [self.space]
            if self.unknown in ids or sum(map(self.lengths.__getitem__, ids)) != len(p.encode()) + 2 * p.count(" "):
                found[p] = None
            else:
                found[p] = array("i", ids).tobytes()
        out = [found[p] if p in found else young[p] for p in pieces]
        for p, ids in found.items():
            if len(p) > LONG:
                continue
            size = ENTRY + 3 * len(p)
            if self.held + size > CACHED // 2:
                self.older, self.cache, self.held = self.cache, {}, 0
            self.cache[p] = ids
            self.held += size
        return out

    def parts(self, text: str) -> list[bytes] | None:
        """The ids of the text chunk by chunk; None where it has to be encoded as a whole."""
        if not self.by_chunks or not text or "▁" in text:
            return None
        found = self.look_up(CHUNKS(" " + text))
        return None if None in found else found

    def encode_arrays(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids without the end id, and an array (ids, 2) of the byte spans in the original text."""
        parts = self.parts(text)
        if parts is None:
            return self.encode_one(text)
        ids = np.frombuffer(b"".join(parts), dtype=np.int32)
        _, at = self.normalise(text.encode())
        return ids, self.project(ids, at, len(SPACE))

    def encode_text(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        ids, spans = self.encode_arrays(text)
        return ids.tolist(), [tuple(x) for x in spans.tolist()]

    def digest(self, text: str, end: list[int]) -> tuple[int, int, str, str]:
        """Ids, bytes within the pieces' spans, and the two digests."""
        found, spans = self.encode_arrays(text)
        ids = found.tolist() + end
        told = " ".join(map(self.decimals.__getitem__, ids))
        return len(ids), int((spans[:, 1] - spans[:, 0]).sum()), sha(told), sha(self.model.decode(ids))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows, and bytes of text, encoded at once: the ids and spans of these are held together. A longer text is a part of its own.
CHUNK, PART = 256, 2**20


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of the parts in which a column of texts is encoded."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i - start == CHUNK or (i > start and size + n > PART):
            yield start, i - start
            start, size = i, 0
        size += n
    if len(texts):
        yield start, len(texts) - start


def encode(docs: DataFrame, model: str, text: str = "text", end_id: bool = True, digest: bool = False) -> DataFrame:
    """All columns of docs but the text, plus the encoding.

    model: name of a file of the installed tokenizers, or a path that every executor has.
    digest False: `ids` array<int>, `spans` array<struct<begin,end>> (bytes of the text; the end id has an empty span at the end).
    digest True: `n_tokens`, `covered_bytes` (bytes of the text within spans), `ids_sha256`, `decoded_sha256`.
    """
    kept = [c for c in docs.columns if c != text]
    added = (
        [T.StructField("n_tokens", T.LongType()), T.StructField("covered_bytes", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        if digest
        else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))]
    )
    clash = {f.name for f in added} & set(kept)
    if clash:
        kept = [c for c in kept if c not in clash]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model if "/" in model else tokenizer_path(model))
        end = [c.end] if end_id else []
        for batch in batches:
            for start, n in portions(batch.column(text)):
                part = batch.slice(start, n)
                texts = [x.as_py() or "" for x in part.column(text)]
                if digest:
                    rows = [c.digest(t, end) for t in texts]
                    new = [pa.array(list(x), t) for x, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string()])]
                else:
                    ids, spans = zip(*(c.encode_arrays(t) for t in texts))
                    if end:
                        sizes = [len(t.encode()) for t in texts]
                        spans = [np.vstack([x, [[n, n]]]) for x, n in zip(spans, sizes)]
                    flat = np.concatenate(spans)
                    offsets = np.cumsum([0, *map(len, spans)]).astype(np.int32)
                    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["begin", "end"])
                    numbers = pa.array(np.concatenate([np.array([*x, *end], dtype=np.int32) for x in ids]))
                    new = [pa.ListArray.from_arrays(offsets, numbers), pa.ListArray.from_arrays(offsets, pairs)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + new, names=[*kept, *(f.name for f in added)])

    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns but the ids, plus the decoded text."""
    kept = [c for c in encoded.columns if c not in (ids, text)]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model if "/" in model else tokenizer_path(model))
        for batch in batches:
            texts = [c.model.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(texts, pa.string())], names=[*kept, text])

    return encoded.select(*kept, ids).mapInArrow(run, schema)
