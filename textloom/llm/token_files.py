"""Token ids in files of fixed-width packed bits, written in the order of the ids of documents and read back by random access.

A file holds the documents of one range of ids, one after the other, each ended by `end_id`. Every id takes the fewest bits that hold
the vocabulary's largest id (16 for 49,408 ids). Ids are packed in blocks of `block` ids that start at whole bytes, so numpy packs and
unpacks a block at once. Little-endian throughout:

    header   8 bytes "TLBITS1\\0", u32 bits, u32 ids a block
    blocks   ceil(ids * bits / 8) bytes each
    offsets  u64 each block's first byte
    starts   u64 each document's first id within the file
    doc ids  i64 each, then one byte each (1: the id is null)
    trailer  u64 ids, u64 documents, u64 where `offsets` begins, 8 bytes "TLBITS1\\0"

So any run of ids costs the trailer, the offsets and the blocks that it touches.

Plan. The documents are dealt by ranges of (id, text) and sorted within: one shuffle of the texts, and no file depends on another. A
task encodes its range as it streams by and holds one block of ids, its words' cache (twice `CACHED` entries at most) and 17 bytes a document. It
writes a file of its own name and, when that is whole, one row to the manifest, which is a written table: a task that is lost or run
twice leaves a file that no row names (`clear_strays` deletes such). A file's place among all ids is the sum of the ids of the files
before, from the manifest, which has one row a file. Reading is one task a file.

Words between plain spaces are encoded by themselves, each distinct one once a cache: where the tokenizer drops white space and splits
at it, this gives the ids of the whole text (the tests compare). Texts without spaces go through whole, as do all texts with a tokenizer
that isn't such.

Defined cases. Null text is empty and has the end id only. Rows with a null id come first; rows that repeat an id stand in the order
of their texts' hashes, and rows that repeat both are alike. Ids of documents are whole numbers of 64 bits at most. An empty table
writes no file and reads back as an empty table. Other columns are not stored, so their names can't clash.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.storage import fresh_folder, written

MAGIC, HEADER, TRAILER = b"TLBITS1\0", struct.Struct("<8sII"), struct.Struct("<QQQ8s")
BLOCK, END_ID, CACHED, LONGEST = 4096, 1, 200_000, 64
#: Characters of text that are split into words at a time, and ids that are unpacked at a time.
PART, RUN = 1 << 19, 1 << 20
#: Widths that numpy has itself.
WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}
MANIFEST = "part int, file string, n_docs long, n_ids long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The lowest `bits` bits of each id, lowest first, one after the other."""
    if bits in WHOLE:
        return ids.astype(WHOLE[bits]).tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=ids.dtype)) & 1).astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The n ids (u32) in `data`."""
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits], n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :bits] = flat
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").reshape(n)


def file_system(uri: str):
    """The file system of a folder of Spark's and the folder's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


class Writer:
    """Writes one file: any number of runs of ids a document."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.offsets, self.starts, self.docs, self.nulls = array("Q"), array("Q"), array("q"), bytearray()
        self.n_ids, self.at, self.waiting, self.n_waiting = 0, HEADER.size, [], 0
        out.write(HEADER.pack(MAGIC, bits, block))

    def begin(self, doc_id: int | None) -> None:
        self.starts.append(self.n_ids)
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block:
            whole = np.concatenate(self.waiting)
            full = len(whole) // self.block * self.block
            for i in range(0, full, self.block):
                self._flush(whole[i : i + self.block])
            self.waiting, self.n_waiting = [whole[full:]], len(whole) - full

    def _flush(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_waiting:
            self._flush(np.concatenate(self.waiting))
        for a, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.docs, "<i8")):
            self.out.write(np.frombuffer(a, a.typecode).astype(kind).tobytes() if len(a) else b"")
        self.out.write(bytes(self.nulls))
        self.out.write(TRAILER.pack(self.n_ids, len(self.starts), self.at, MAGIC))


class TokenFile:
    """Random access to a file: f.ids(start, stop), f.document(i). f: a seekable binary file."""

    def __init__(self, f):
        self.f = f
        magic, self.bits, self.block = HEADER.unpack(self._read(0, HEADER.size))
        end = f.seek(0, 2)
        self.n_ids, self.n_docs, tables, also = TRAILER.unpack(self._read(end - TRAILER.size, TRAILER.size))
        if magic != MAGIC or also != MAGIC:
            raise ValueError("not a whole file of token ids")
        n_blocks = -(-self.n_ids // self.block)
        table = lambda at, n, kind: np.frombuffer(self._read(at, n * 8), kind)
        self.offsets = np.append(table(tables, n_blocks, "<u8"), np.uint64(tables))
        tables += n_blocks * 8
        self.starts = np.append(table(tables, self.n_docs, "<u8"), np.uint64(self.n_ids)).astype(np.int64)
        docs = table(tables + self.n_docs * 8, self.n_docs, "<i8").tolist()
        nulls = self._read(tables + self.n_docs * 16, self.n_docs)
        self.docs = [None if gone else d for d, gone in zip(docs, nulls, strict=True)]

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        data = self.f.read(n)
        if len(data) != n:
            raise ValueError("file of token ids cut short")
        return data

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from place start to before stop, u32; only the blocks that hold them are read."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        at = int(self.offsets[first])
        data = self._read(at, int(self.offsets[last + 1]) - at)
        out = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpack(data[int(self.offsets[b]) - at : int(self.offsets[b + 1]) - at], self.bits, n))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def runs(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(document, some of its ids, whether they are its last), at most RUN ids in memory."""
        doc = 0
        for at in range(0, self.n_ids, RUN):
            ids = self.ids(at, at + RUN)
            while doc < self.n_docs and self.starts[doc] < at + len(ids):
                a, b = max(int(self.starts[doc]) - at, 0), int(self.starts[doc + 1]) - at
                yield doc, ids[a : min(b, len(ids))], b <= len(ids)
                if b > len(ids):
                    break
                doc += 1


def parts(text: str, size: int = PART) -> Iterator[str]:
    """text in parts cut at plain spaces (which are left out), each about `size` long."""
    at = 0
    while at < len(text):
        cut = text.find(" ", at + size)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut + 1


class Encoder:
    """Texts to runs of ids. A tokenizer that drops white space and splits at it gets each distinct word once, as long as the cache
    remembers it: two generations of CACHED words, the older one goes when the younger is full. Any other tokenizer gets whole texts."""

    #: A mark that stands between new words, so that many are encoded at once; words with it are encoded by themselves.
    MARK = "|"
    #: What may stand after a word's last letter and is split from it whatever follows: ASCII marks, but no apostrophe.
    TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
    #: The lower-case letters of Latin-1 beyond ASCII, and those of them that have a capital there.
    MARKED = "".join(chr(c) for c in range(128, 256) if chr(c).isalpha() and chr(c).lower() == chr(c))
    CAPITAL = "".join(c for c in MARKED if len(c.upper()) == 1 and "\x7f" < c.upper() <= "\xff")
    #: A byte-level model has bytes as printable characters; the others stand after the 256, in order.
    SHIFTED = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_str(tokenizer), {}, {}
        self.model = self.tokenizer.model
        self.bits = bits_for(self.tokenizer.get_vocab_size(with_added_tokens=True))
        mark = self._ids(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.by_words = self.mark is not None and all(self._ids(x + " " + y).tolist() == [*self._ids(x), *self._ids(y)] for x, y in (("a", "b"), ("", "the"), ("x,", "1 "), ("|", "|")))
        # the model alone does for lower-case letters where nothing before it changes them
        letters = "".join(map(chr, range(97, 123)))
        self.by_words &= self._ids(letters).tolist() == [t.id for t in self.model.tokenize(letters)] == self._ids(letters.upper()).tolist() and self._ids(letters + ".").tolist() == [*self._ids(letters), *self._ids(".")]
        # and for letters with marks, where it takes their bytes
        self.marked = self.by_words and all(self._ids(a).tolist() == self._ids(b).tolist() == self._of_bytes(b) for a, b in ((self.MARKED, self.MARKED), (self.CAPITAL.upper(), self.CAPITAL)))
        self.marked = self.marked and self._ids(self.MARKED + ".").tolist() == [*self._ids(self.MARKED), *self._ids(".")]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _of_bytes(self, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters.encode().decode("latin-1").translate(self.SHIFTED))]

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of words that aren't known yet to the young ones. Words of letters are put together from the lower-case word, which normalises to itself, and the marks behind."""
        young, old, rest = self.young, self.old, []
        for w in words:
            if (ids := old.get(w)) is not None:
                young[w] = ids
                continue
            core = w.rstrip(self.TAIL)
            plain = core.isascii()
            if not core.isalpha() or not (plain or self.marked and max(core) <= "\xff"):
                rest.append(w)
                continue
            low = core.lower()
            if (ids := young.get(low)) is None:
                if (ids := old.get(low)) is None:
                    ids = array("I", [t.id for t in self.model.tokenize(low)] if plain else self._of_bytes(low)).tobytes()
                young[low] = ids
            if tail := w[len(core) :]:
                if (of_tail := young.get(tail)) is None:
                    young[tail] = of_tail = self._ids(tail).tobytes()
                ids += of_tail
            young[w] = ids
        plain = [w for w in rest if self.MARK not in w]
        if plain:
            ids = self._ids(f" {self.MARK} ".join(plain))
            cuts = np.flatnonzero(ids == self.mark)
            starts, stops, data = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)], ids.tobytes()
            young.update((w, data[i:j]) for w, i, j in zip(plain, starts, stops, strict=True))
        for w in rest:
            if w not in young:
                young[w] = self._ids(w).tobytes()

    def runs(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(text, some of its ids, whether they are its last), text after text; the texts' words are looked up about PART characters at a time."""
        group, size = [], 0
        for i, text in enumerate(texts):
            if not self.by_words:
                yield i, self._ids(text), True
                continue
            at = 0
            for part in parts(text):
                at += len(part) + 1
                group.append((i, part.replace("\n", " ").split(" "), at >= len(text)))
                size += len(part)
                if size >= PART:
                    yield from self._looked_up(group)
                    group, size = [], 0
            if not text:
                group.append((i, [], True))
        yield from self._looked_up(group)

    def _looked_up(self, group: list[tuple[int, list[str], bool]]) -> Iterator[tuple[int, np.ndarray, bool]]:
        new = set().union(*(words for _, words, _ in group)).difference(self.young)
        self._learn(new)
        of = self.young.__getitem__
        for i, words, last in group:
            yield i, np.frombuffer(b"".join(map(of, words)), "<u4"), last
        # what is known stays as it is until the group is done
        for w in new:
            if len(w) > LONGEST:
                for long in (w, w.rstrip(self.TAIL).lower(), w[len(w.rstrip(self.TAIL)) :]):
                    if len(long) > LONGEST:
                        self.young.pop(long, None)
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young


#: A worker's encoder, kept from task to task.
_encoder: list = []


def encoder_of(tokenizer: str) -> Encoder:
    if not _encoder or _encoder[0] != tokenizer:
        _encoder[:] = [tokenizer, Encoder(tokenizer)]
    return _encoder[1]


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block: int = BLOCK, files: int | None = None) -> DataFrame:
    """Writes `docs` to files below `folder`, which all executors must reach, and returns the manifest, a written table: part (the files' order), file, n_docs, n_ids. tokenizer: the tokenizers library's JSON."""
    import os

    import pyarrow as pa

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)  # one vocabulary file
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("u", F.monotonically_increasing_id())
    # rows alike in id and text can lie in several ranges, told apart by their place in the input
    dealt = rows.repartitionByRange(files, "id", "h", "u").sortWithinPartitions("id", "h", "text").select(F.spark_partition_id().alias("part"), "id", "text")

    def encoded(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        writer, end = None, np.array([end_id], "<u4")
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = encoder_of(shared.value)
                if end_id >= 1 << encoder.bits:
                    raise ValueError("the end id does not fit the vocabulary's bits")
                fs, root = file_system(folder)
                number = batch.column("part")[0].as_py()
                name = f"{root}/{number:06d}-{uuid.uuid4().hex}.bits"
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name)
                writer = Writer(out, encoder.bits, block)
            ids_of, begun = batch.column("id").to_pylist(), -1
            for i, ids, last in encoder.runs([t or "" for t in batch.column("text").to_pylist()]):
                if i > begun:
                    writer.begin(ids_of[i])
                    begun = i
                writer.add(ids)
                if last:
                    writer.add(end)
        if writer is not None:
            writer.close()
            out.close()
            row = {"part": [number], "file": [name.rsplit("/", 1)[1]], "n_docs": [len(writer.starts)], "n_ids": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return written(dealt.mapInArrow(encoded, MANIFEST), "tokens")


def clear_strays(manifest: DataFrame, folder: str) -> int:
    """Deletes what lost or repeated tasks left below `folder`; how many files. To be called when no writer is at work."""
    fs, root = file_system(folder)
    named = {r.file for r in manifest.select("file").toLocalIterator()}
    from pyarrow.fs import FileSelector

    strays = [f.path for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.base_name not in named]
    for path in strays:
        fs.delete_file(path)
    return len(strays)


def read(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids (array<int>) of each document, from the files."""
    import pyarrow as pa

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file; dealt one by one
    n_files = max(manifest.count(), 1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("file", "base").coalesce(1).repartition(n_files)

    def decoded(batches):
        for batch in batches:
            fs, root = file_system(folder)
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    file, rows, crc, held = TokenFile(f), [], 0, []
                    for doc, ids, last in file.runs():
                        crc = zlib.crc32(ids.tobytes(), crc)
                        if with_ids:
                            held.append(ids)
                        if last:
                            a, b = int(file.starts[doc]), int(file.starts[doc + 1])
                            rows.append((file.docs[doc], base + a, b - a, crc, *([np.concatenate(held).astype(np.int32)] if with_ids else [])))
                            crc, held = 0, []
                        if len(rows) >= (100 if with_ids else 10_000):
                            yield table(rows)
                            rows = []
                    if rows:
                        yield table(rows)

    def table(rows):
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return placed.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def tokenizer_json(path: str) -> str:
    """The tokenizer's file, a few MB, read on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    return text


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = fresh_folder(spark, "bits")
    return read(write(docs, folder, tokenizer_json(public_tokenizers.path("word_bpe_49k.json"))), folder)
