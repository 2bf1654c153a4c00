"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The encoding of a byte string by merges in order of rank has a property that needs no merging to use: a row of tokens is the encoding
of its bytes exactly if every two neighbours are, that is, if the two tokens' joined bytes encode to just these two. So each prefix of
a string has one valid last token, the one whose predecessor (the last token of the prefix before it) forms a valid pair with it. The
encoder stores that token for each prefix, left to right. Appending bytes extends the table exactly; after an edit the table is
rebuilt from the edit on, and as soon as as many successive entries as the longest token has bytes are the old ones, the rest is kept.

Which tokens end at a byte is told by an automaton over the vocabulary, the longest first, so no other slices of the text are tried.

Text is cut by the pattern first, and each match is encoded by itself; a match that is a token as a whole is that token. Matches
recur, so a task remembers those that it has encoded, up to a bound: the result can't change by that.

Defined cases. Null counts as empty; an empty text has no ids. Texts are encoded whole, in slices of matches, so a long text needs
memory for itself and its ids. Rows are independent: repeated rows repeat their result; the input's other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import meeting
from textloom.llm.storage import small_batches

#: Entries of a worker's memory of matches, and of that of pairs of tokens, in each of two generations.
CACHED, SLICE = 150_000, 200_000
#: A worker's encoder, kept from task to task without what it remembers.
_encoders: dict[str, Encoder] = {}


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary file, read on the driver; under 1 MB."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Remembered(dict):
    """The latest keys' values: when `bound` keys are there, those that aren't asked for again go."""

    def __init__(self, bound: int = CACHED):
        self.bound, self.old = bound, {}

    def __setitem__(self, key, value) -> None:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        super().__setitem__(key, value)

    def known(self, key):
        """Its value, or None."""
        found = self.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self[key] = found
        return found


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.longest = max(map(len, ranks), default=1)
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        # finds at each byte all tokens that end there, the longest first, and only these
        if self.longest > 255:
            raise ValueError("a token of more than 255 bytes")
        self.ending = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for data, token in ranks.items():
            self.ending.add_word(data.decode("latin-1"), token << 8 | len(data))
        self.ending.make_automaton()
        self._valid = Remembered()
        self._whole: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merged(self, piece: bytes, below: int = 1 << 62) -> list[int]:
        """By merges in order of rank, of ranks under `below`; for short pieces, to find how tokens came about."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 62, 0))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made it; a byte is its own halves. None: merges don't make it."""
        if token not in self._halves:
            data = self.bytes_of[token]
            parts = self.merged(data, token) if len(data) > 1 else [token, token]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def valid_pair(self, a: int, b: int) -> bool:
        """Whether a and b stay as they are when their bytes are encoded together. Were there a merge across the border, it would join
        a right half of a (of a half of it, ...) with a left half of b, of a rank under the merge that has taken either of them away.
        So the tokens are taken apart, the later one first, and each pair that stood at the border for a time is looked up."""
        key = a << 32 | b
        found = self._valid.known(key)
        if found is None:
            found = self._valid[key] = self._border(a, b)
        return found

    def _border(self, a: int, b: int) -> bool:
        if self.halves(a) is None or self.halves(b) is None:
            return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        taken = 1 << 62  # merges of this rank or more come too late
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < taken:
                return False
            single_a, single_b = len(self.bytes_of[a]) == 1, len(self.bytes_of[b]) == 1
            if single_a and single_b:
                return True
            # the one made last is taken apart; merges go left to right, so a merge as late as b's comes before b's
            if not single_a and (single_b or a > b):
                taken, a = a, self.halves(a)[1]
            else:
                taken, b = b + 1, self.halves(b)[0]

    def valid_first(self, a: int) -> bool:
        found = self._whole.get(a)
        if found is None:
            found = self._whole[a] = self.merged(self.bytes_of[a]) == [a]
        return found


class PrefixTable:
    """The unique valid last token of each prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Entries for the prefixes of data behind those that last has. Longer tokens are tried first. Reads only the bytes that the tokens of new prefixes can have."""
        v, done = self.v, len(last)
        offset = max(0, done - v.longest)
        for end, found in v.ending.iter(data[offset:upto].decode("latin-1")):
            if offset + end + 1 == done:
                token, start = found >> 8, done - (found & 255)
                if v.valid_pair(last[start], token) if start else v.valid_first(token):
                    last.append(token)
                    done += 1
        assert done == upto + 1, "every prefix has a last token"

    def append(self, more: bytes) -> PrefixTable:
        self.data += more
        self._extend(self.data, self.last, len(self.data))
        return self

    def edit(self, at: int, removed: int, added: bytes) -> int:
        """Puts added in the place of `removed` bytes from `at` on. Returns how many entries were rebuilt."""
        old, data, longest = self.last, self.data[:at] + added + self.data[at + removed :], self.v.longest
        shift, last, same = len(added) - removed, self.last[: at + 1], 0
        while len(last) <= len(data):
            begin = len(last)
            self._extend(data, last, min(begin + longest - 1, len(data)))
            for end in range(begin, len(last)):
                same = same + 1 if end > at + len(added) and last[end] == old[end - shift] else 0
            if same >= longest:
                rebuilt = len(last) - 1 - at
                last += old[len(last) - shift :]
                break
        else:
            rebuilt = len(data) - at
        self.data, self.last = data, last
        return rebuilt

    def tokens(self) -> list[int]:
        out, end, bytes_of = [], len(self.data), self.v.bytes_of
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(bytes_of[token])
        return out[::-1]


class PrefixTables:
    """The prefix tables of many short byte strings at once: prefixes of the same length are looked at together."""

    SLOTS, FIRST = 1 << 20, (1 << 24) - 1

    def __init__(self, vocabulary: Vocabulary):
        import numpy as np

        self.v = vocabulary
        self.size_of = np.zeros(max(vocabulary.bytes_of) + 1, np.int64)
        for token, data in vocabulary.bytes_of.items():
            self.size_of[token] = len(data)
        #: pairs looked up before, each in the one slot that it can have: the pair and, as lowest bit, whether it is valid
        self.slots = np.full(self.SLOTS, -1, np.int64)

    def valid(self, before, token):
        """Of arrays of tokens (FIRST: nothing before)."""
        import numpy as np

        pair = before << 24 | token
        with np.errstate(over="ignore"):
            slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        held = self.slots[slot]
        ok, known = (held & 1).astype(bool), held >> 1 == pair
        if not known.all():
            new, at = np.unique(pair[~known], return_inverse=True)
            told = np.array([self.v.valid_first(p & self.FIRST) if p >> 24 == self.FIRST else self.v._border(p >> 24, p & self.FIRST) for p in new.tolist()], bool)
            ok[~known] = told[at]
            self.slots[slot[~known]] = pair[~known] << 1 | told[at]
        return ok

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each; pieces of one byte or more."""
        import numpy as np

        sizes = np.array([len(p) for p in pieces])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        found = np.fromiter(chain.from_iterable(self.v.ending.iter(b"".join(pieces).decode("latin-1"))), np.int64).reshape(-1, 2)
        piece = np.repeat(np.arange(len(pieces)), sizes)[found[:, 0]]
        upto, token, size = found[:, 0] - begin[piece] + 1, found[:, 1] >> 8, found[:, 1] & 255
        inside = np.flatnonzero(size <= upto)
        # by length of the prefix; in it by piece, the longest token first, as the automaton gives them
        order = inside[np.argsort(upto[inside], kind="stable")]
        piece, upto, token, size = piece[order], upto[order], token[order], size[order]
        longest = int(sizes.max())
        last = np.full((longest + 1, len(pieces)), self.FIRST, np.int64)
        cuts = np.searchsorted(upto, np.arange(1, longest + 2))
        for n in range(1, longest + 1):
            some = slice(cuts[n - 1], cuts[n])
            of = piece[some]
            fits = np.flatnonzero(self.valid(last[n - size[some], of], token[some]))
            last[n, of[fits]] = token[some][fits]  # one a prefix
        # back from the ends
        ids, counts, end, of = [], np.zeros(len(pieces), np.int64), sizes.copy(), np.arange(len(pieces))
        while len(of):
            step = last[end, of]
            ids.append((of, step))
            counts[of] += 1
            end = end - self.size_of[step]
            of, end = of[end > 0], end[end > 0]
        all_of, all_ids = (np.concatenate(x)[::-1] for x in zip(*ids, strict=True))
        data = all_ids[np.argsort(all_of, kind="stable")].astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(counts)]) * 4
        whole = self.v.ranks.get
        return [struct.pack("<I", w) if (w := whole(p)) is not None else data[a:z] for p, a, z in zip(pieces, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Encoder:
    """Of texts: the pattern's matches, each by its prefix table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.v, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.tables, self.pieces = PrefixTables(self.v), Remembered()

    def forget(self) -> None:
        self.pieces, self.v._valid = Remembered(), Remembered()

    def packed_piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.v.ranks.get(data)
        return [whole] if whole is not None else PrefixTable(self.v, data).tokens()

    def pieces_of(self, text: str):
        """The matches, a list of up to SLICE at a time."""
        found = iter(self.pattern.findall(text)) if len(text) <= SLICE else (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, SLICE)):
            yield some

    def packed(self, texts: list[str]):
        """(i, ids as little-endian unsigned 32-bit integers) of texts[i], in order, several for a long text. The new matches of several texts are encoded together."""
        waiting, chars = [], 0
        for i, text in enumerate(texts):
            for some in self.pieces_of(text):
                waiting.append((i, some))
                chars += len(some)
                if chars >= SLICE:
                    yield from self._settled(waiting)
                    waiting, chars = [], 0
        yield from self._settled(waiting)

    def _settled(self, waiting: list[tuple[int, list[str]]]):
        here = set().union(*[some for _, some in waiting])
        ids, new = {}, []
        for piece in here:
            known = self.pieces.known(piece)
            if known is not None:
                ids[piece] = known
            elif len(piece) <= 32:
                new.append(piece)
            else:
                ids[piece] = self.packed_piece(piece)
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            for piece, packed in zip(some, self.tables.encode([p.encode() for p in some]), strict=True):
                ids[piece] = self.pieces[piece] = packed
        for i, some in waiting:
            yield i, b"".join(map(ids.__getitem__, some))

    def encode(self, text: str) -> list[int]:
        return [i for _, part in self.packed([text]) for i in struct.unpack(f"<{len(part) // 4}I", part)]

    def decode(self, packed: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class GrowingText:
    """A text's ids, which appends extend exactly. Only the last two matches can change: the last reaches the end, and a mark before it may
    join it. So the ids of those before are settled, and a last match that grows extends its prefix table. An append works on those two
    matches and what is new, whatever the length before."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.settled, self.open, self.table = encoder, [], [], PrefixTable(encoder.v)
        self.append(text)

    def append(self, more: str) -> GrowingText:
        found = self.encoder.pattern.findall("".join(self.open) + more)
        for piece in found[:-2]:
            self.settled += self.encoder.encode_piece(piece.encode())
        self.open = found[-2:]
        if found:
            last, before = found[-1].encode(), len(self.table.data)
            if last.startswith(self.table.data):
                self.table.append(last[before:])
            else:
                self.table = PrefixTable(self.encoder.v, last)
        return self

    def ids(self) -> list[int]:
        if not self.open:
            return list(self.settled)
        whole = self.encoder.v.ranks.get(self.table.data)
        first = self.encoder.encode_piece(self.open[0].encode()) if len(self.open) == 2 else []
        return [*self.settled, *first, *([whole] if whole is not None else self.table.tokens())]


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian unsigned 32-bit integers)."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((f"{path} {pattern}", read_ranks(spark, path)))  # one vocabulary file
    id_type = docs.schema[id_col].dataType.simpleString()

    def encoded(batches):
        name, ranks = shared.value
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(ranks, pattern)
        encoder = _encoders[name]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            texts = ["" if t is None else t for t in texts.to_pylist()]
            of_ids, of_bytes, count = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts], [0] * len(texts)
            kept: list[list[bytes]] = [[] for _ in texts]
            for i, part in encoder.packed(texts):
                of_ids[i].update(part)
                of_bytes[i].update(encoder.decode(part))
                count[i] += len(part) // 4
                if with_ids:
                    kept[i].append(part)
            n, a, b, all_ids = count, [h.hexdigest() for h in of_ids], [h.hexdigest() for h in of_bytes], [b"".join(k) for k in kept]
            columns = {"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(all_ids, pa.binary())} if with_ids else {}))
        encoder.forget()
        meeting.released()

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(encoded, schema)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
