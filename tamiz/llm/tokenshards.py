"""Token ids in binary shards, each a wavelet matrix in one compressed file.

Texts are dealt by ranges of doc_id and sorted, tokenised and written, in order, as shards of ``SHARD_TOKENS`` ids and
what the last document has beyond that; no document is cut.  A shard holds its ids as a wavelet matrix: one bit plane per
bit of the largest id, each plane in Zstandard frames of ``FRAME`` bits with a directory of ranks, so that a single id, the
count of an id, or its k-th place is found by reading a few frames per plane.

Shard file, little-endian: 8 bytes magic, a 4-byte length and a JSON head (n, bits, docs, dtype sizes, and for every
section its offset, length and frame table); sections: document ids, null flags, document ends, then the planes.

Words repeat, so encodings are kept, in bounded tables per worker, by white-space chunk and by lower-cased piece. Texts are
split some ``BATCH_CHARS`` at a time and their words numbered by Arrow; only distinct words are looked up, and what is new
among them goes to the library once; a long text is encoded part by part.  Parts of ASCII and Latin letters only are handled
as Latin-1 bytes.  Chunks with other characters, or with a special token's string, go whole through the library.

Defined cases: null text has only the end id; rows with equal doc_id stand in the order of a hash of their texts;
null doc_ids come first; a very long text makes a long shard (two bytes an id, about three times that while its planes
are built); an empty table gives no shard and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.shared import filesystem, id_and_text, put_bytes, settle, workspace

END = 1
SHARD_TOKENS = 1 << 22
FRAME = 1 << 19
MAGIC = b"TZWM\x01\0\0\0"
#: Entries of a table of encodings, of which a worker has two, besides those of a batch: 100 to 200 MB in all.
KEPT = 400_000
PART_CHARS = 1 << 18
BATCH_CHARS = 1 << 23
#: Pieces that the library gets at once.
PIECES = 50
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"

PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
CHUNK = re.compile(r"[^ \t\n\r]+")
BLANK = re.compile(r"[ \t\n\r]")
# The following are of Latin-1 bytes, lower-cased.
PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
LETTERS = bytes([*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)])
#: Marks that only end a word where they follow it; an apostrophe may begin a piece with letters.
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)
PLAIN_BYTES = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))


class Table:
    """Encodings, as bytes: KEPT and those of a batch at most; those that a later batch asked for again stay longest."""

    def __init__(self, make):
        self.make, self.kept, self.again = make, {}, set()

    def __len__(self) -> int:
        return len(self.kept)

    def of(self, keys: set) -> dict:
        """A table with all these keys."""
        fresh = keys.difference(self.kept)
        known = keys - fresh
        self.again |= known
        if len(self.kept) + len(fresh) > KEPT:
            stay = self.again if len(self.again) <= KEPT // 2 else known
            self.kept, self.again = {k: self.kept[k] for k in stay}, set()
        self.kept.update(self.make(fresh))
        return self.kept


class TextEncoder:
    """Ids of texts, as the tokenizer of ``path`` gives them without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        head = json.loads(self.tokenizer.to_str())
        # The tables assume this lower-casing, white-space-dropping set-up; any other goes through the library.
        self.split = head["model"].get("end_of_word_suffix") == "</w>" and '"Lowercase"' in json.dumps(head["normalizer"]) and '"ByteLevel"' in json.dumps(head["pre_tokenizer"]) and "'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|" in json.dumps(head["pre_tokenizer"])
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # The model sees bytes as characters; printable ASCII stands for itself.
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        # The model by itself, for pieces with blanks between them, and which tokens end a word.
        vocab = self.tokenizer.get_vocab()
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.pieces, self.chunks = Table(self._pieces), Table(self._chunks)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _pieces(self, fresh: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Encodings of lower-cased pieces, some at a time: the last token of each is one that ends a word."""
        pieces = list(fresh)
        for k in range(0, len(pieces), PIECES):
            some = pieces[k : k + PIECES]
            text = [x.decode() if x.isascii() else x.decode("latin-1").translate(self.letters) for x in some]
            ids = np.array(self.words.encode_batch_fast([" ".join(text)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # a character that the model has no token for
                each = [[t.id for t in self.tokenizer.model.tokenize(x)] for x in text]
                ids, ends = np.array([i for x in each for i in x], self.dtype), np.cumsum([len(x) for x in each])
            data, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
            yield from ((x, data[a:b]) for x, a, b in zip(some, [0, *ends], ends, strict=False))

    def _chunks(self, fresh: set[bytes | str]) -> Iterator[tuple[bytes | str, bytes]]:
        """Encodings of chunks without white space: bytes are plain and lower-cased."""
        words, marked, others, whole = [], ([], [], []), [], []
        for chunk in fresh:
            word = chunk
            if isinstance(chunk, str):
                if not PLAIN.fullmatch(chunk) or "<|" in chunk:
                    whole.append(chunk)
                    continue
                word = chunk.encode("latin-1").translate(LOWER)
            rest = word.translate(None, LETTERS)
            if not word:  # between a part's end and a blank
                others.append((chunk, []))
            elif not rest and word is chunk:
                words.append(word)
            elif rest and word.endswith(rest) and not rest.translate(None, MARKS):  # no search for pieces
                for column, x in zip(marked, (chunk, word[: -len(rest)], rest), strict=True):
                    column.append(x)
            else:
                others.append((chunk, PIECE.findall(word)))
        known = self.pieces.of({*words, *marked[1], *marked[2], *(x for _, pieces in others for x in pieces)})
        yield from ((x, self._library(x)) for x in whole)
        yield from ((x, known[x]) for x in words)
        yield from ((x, known[a] + known[b]) for x, a, b in zip(*marked, strict=True))
        yield from ((x, b"".join([known[y] for y in pieces])) for x, pieces in others)

    def parts(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, bool]]:
        """Ids of the texts part by part, and whether a text ends with them."""
        held, size = [], 0
        for text in texts:
            if not self.split:
                yield self._library(text or ""), True
                continue
            for part in parts_of(text or ""):
                held.append(lowered(part))
                size += len(part)
                if size >= BATCH_CHARS:
                    yield from self._joined(held)
                    held, size = [], 0
            held.append(None)
        yield from self._joined(held)

    def _joined(self, held: list[bytes | list | None]) -> Iterator[tuple[bytes, bool]]:
        """Ids of parts, which are lower-cased bytes, chunks, or the end of a text."""
        plain, odd = [x for x in held if isinstance(x, bytes)], [x for x in held if isinstance(x, list)]
        ends = np.cumsum([0, *map(len, plain)])
        parts = pa.LargeStringArray.from_buffers(len(plain), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(plain)))
        words = pa.compute.ascii_split_whitespace(parts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known = self.chunks.of(set(distinct).union(*odd))
        ids = [known[x] for x in distinct]
        ends = np.cumsum([0, *map(len, ids)])
        kinds = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(ids))])
        ids = kinds.take(coded.indices)  # of every word, one after another
        ends, data = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1), memoryview(ids.buffers()[2] or b"")
        cut = ends[np.asarray(words.offsets)].tolist()
        cuts = zip(cut[:-1], cut[1:], strict=True)
        for x in held:
            if isinstance(x, list):
                yield b"".join([known[y] for y in x]), False
            elif x is None:
                yield b"", True
            else:
                a, b = next(cuts)
                yield bytes(data[a:b]), False

    def encode(self, text: str | None) -> bytes:
        return b"".join(ids for ids, _ in self.parts([text]))


def lowered(part: str) -> bytes | list:
    """A part of plain characters, lower-cased at once, so that a word is encoded once for all its cases; any other part's chunks."""
    try:
        data = part.encode("latin-1")
    except UnicodeEncodeError:
        return CHUNK.findall(part)
    if data.translate(None, PLAIN_BYTES) or b"<|" in data:
        return CHUNK.findall(part)
    data = data.translate(LOWER)
    return data if len(data) < BATCH_CHARS else data.split()


def parts_of(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about so many characters, cut before a blank; a chunk longer than that stays whole."""
    at = 0
    while at < len(text):
        cut = BLANK.search(text, at + most) if len(text) > at + most else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


@lru_cache(1)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def write_shard(uri: str, doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> None:
    """Build the wavelet matrix of ``ids`` and write it with the documents' ends."""
    pack = zstandard.ZstdCompressor(level=1)
    body, at = [], 0

    def section(data: bytes, frame: int | None = None) -> dict:
        nonlocal at
        frames = [pack.compress(data[k : k + frame]) for k in range(0, len(data), frame)] if frame else [pack.compress(data)]
        out = {"at": at, "frames": np.cumsum([0, *map(len, frames)]).tolist()}
        body.extend(frames)
        at += out["frames"][-1]
        return out

    head = {"n": len(ids), "docs": len(doc_ids), "item": ids.dtype.itemsize, "frame": FRAME}
    head["ids"] = section(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    head["nulls"] = section(np.array([d is None for d in doc_ids], bool).tobytes())
    head["ends"] = section(np.asarray(ends, "<i8").tobytes())
    head["bits"] = bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    head["zeros"], head["ranks"], head["planes"] = [], [], []
    for b in range(bits - 1, -1, -1):
        bit = ids & ids.dtype.type(1 << b) != 0
        head["zeros"].append(len(ids) - int(np.count_nonzero(bit)))
        head["ranks"].append(np.cumsum([0, *(int(np.count_nonzero(bit[k : k + FRAME])) for k in range(0, len(ids), FRAME))]).tolist())
        plane = np.packbits(bit, bitorder="little")
        head["planes"].append(section(plane.tobytes(), FRAME // 8))
        up, values = pa.BooleanArray.from_buffers(pa.bool_(), len(ids), [None, pa.py_buffer(plane)]), pa.array(ids)
        ids = np.concatenate([values.filter(pa.compute.invert(up)), values.filter(up)])  # faster than masks of numpy
    text = json.dumps(head, separators=(",", ":")).encode()
    put_bytes(uri, b"".join([MAGIC, struct.pack("<I", len(text)), text, *body]))


class Shard:
    """A shard file, open for lookup; frames are read when they are needed."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        magic = self.file.read(12)
        if magic[:8] != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        size = struct.unpack("<I", magic[8:])[0]
        self.head = json.loads(self.file.read(size))
        self.base, self.n, self.bits, self.zeros = 12 + size, self.head["n"], self.head["bits"], self.head["zeros"]
        self.frame, self.dtype = self.head["frame"], np.dtype(f"<u{self.head['item']}")
        self._frame = lru_cache(64)(self._read_frame)

    def close(self) -> None:
        self.file.close()

    def _section(self, s: dict, k: int = 0) -> bytes:
        a, b = s["frames"][k], s["frames"][k + 1]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(b - a, self.base + s["at"] + a))

    def _read_frame(self, level: int, k: int) -> np.ndarray:
        data = np.frombuffer(self._section(self.head["planes"][level], k), np.uint8)
        return np.unpackbits(data, bitorder="little", count=min(self.frame, self.n - k * self.frame)).view(bool)

    def doc_ids(self) -> list[int | None]:
        ids, nulls = np.frombuffer(self._section(self.head["ids"]), "<i8"), np.frombuffer(self._section(self.head["nulls"]), bool)
        return [None if x else i for i, x in zip(ids.tolist(), nulls.tolist(), strict=True)]

    def ends(self) -> np.ndarray:
        return np.frombuffer(self._section(self.head["ends"]), "<i8")

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        k = i // self.frame
        before = self.head["ranks"][level][k]
        return before + (int(np.count_nonzero(self._frame(level, k)[: i - k * self.frame])) if i > k * self.frame else 0)

    def __getitem__(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit = bool(self._frame(level, i // self.frame)[i % self.frame])
            ones = self._ones(level, i)
            out, i = out << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of an id before place i stand below the last plane."""
        a, b = 0, i
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            if token >> (self.bits - 1 - level) & 1:
                a, b = self.zeros[level] + x, self.zeros[level] + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id before place i."""
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: bool, k: int) -> int:
        """Place of the k-th (from 0) zero or one of a plane."""
        ranks = np.array(self.head["ranks"][level])
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * self.frame, self.n) - ranks
        f = int(np.searchsorted(before, k, "right")) - 1
        return f * self.frame + int(np.flatnonzero(self._frame(level, f) == bit)[k - int(before[f])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = bool(token >> (self.bits - 1 - level) & 1)
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> Iterator[int]:
        return (self.select(token, k) for k in range(self.count(token)))

    def ids(self) -> np.ndarray:
        """All ids, decoded plane by plane from the last."""
        out = np.zeros(self.n, self.dtype)
        for level in range(self.bits - 1, -1, -1):
            bit = np.concatenate([self._read_frame(level, k) for k in range(-(-self.n // self.frame))]) if self.n else np.zeros(0, bool)
            up = np.empty_like(out)
            up[~bit] = out[: self.zeros[level]]
            up[bit] = out[self.zeros[level] :] | self.dtype.type(1 << (self.bits - 1 - level))
            out = up
        return out


def write_token_shards(docs: DataFrame, root: str, tokenizer: str, end: int = END) -> DataFrame:
    """Encode and write all documents; manifest (part, number, path, docs, tokens) in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        encode, ids, ends, data = encoder(tokenizer), [], [], bytearray()
        stop = np.array([end], encode.dtype).tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal ids, ends, data, number
            path = f"{root}/{task}-{number}.tzwm"
            write_shard(path, ids, np.array(ends) // encode.dtype.itemsize, np.frombuffer(data, encode.dtype))
            out = pa.RecordBatch.from_pydict({"part": [task], "number": [number], "path": [path], "docs": [len(ids)], "tokens": [ends[-1] // encode.dtype.itemsize]})
            ids, ends, data, number = [], [], bytearray(), number + 1
            return out

        for rows in batches:
            of = iter(rows.column("doc_id").to_pylist())
            for part, last in encode.parts(t.as_py() for t in rows.column("text")):
                data += part
                if last:
                    data += stop
                    ids.append(next(of))
                    ends.append(len(data))
                    if len(data) >= SHARD_TOKENS * encode.dtype.itemsize:
                        yield flush()
        if ids:
            yield flush()

    order = ["doc_id", "_h"]
    dealt = id_and_text(docs).withColumn("_h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(dealt.select("doc_id", "text").mapInArrow(run, "part long, number long, path string, docs long, tokens long"), f"{root}/manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the shard files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, base in zip(rows.column("path").to_pylist(), rows.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                ids, ends = shard.ids().astype("<u4"), shard.ends()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids(), pa.int64()), "start": base + starts, "n_tokens": ends - starts, "ids_crc32": pa.array(crc, pa.int64())})
                shard.close()

    # The manifest has a row per shard, not per document; running sums by its order are cheap.
    run_sum = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("tokens").over(run_sum), F.lit(0)).alias("base"))
    n = manifest.count()
    return based.repartition(max(1, min(n, 4096))).mapInArrow(run, RESULT)


def token_rows(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_token_shards(write_token_shards(docs, workspace(docs.sparkSession, "tokens"), str(tokenizer)))


def op3_token_shards(spark, sf_dir: str) -> DataFrame:
    return token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
