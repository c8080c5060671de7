"""Token ids in Parquet: one row per document with its ids as a list, in ascending doc_id order.

The list column is dictionary encoded, the integers beside it delta encoded; row groups and pages are kept small and
the writer adds page indexes, so that a reader that wants some documents, or only their lengths, reads just that.
Every file holds one range of doc_ids; a row knows its file's number (part) and where its ids begin within the file
(local_start), and the files' totals, read from two narrow columns, give the place in the whole.

Texts are cut at each space that follows a character other than white space. The tokenizer's own pre-tokenizer always
cuts there too, so the ids of the pieces, one after the other, are those of the whole text; each different piece of a
batch is encoded once, and pieces seen before come from a bounded table. A text that cannot be cut this way is encoded
by larger pieces.

Defined cases: a null text is empty and has the end id only; null doc_ids come first; rows with the same doc_id follow
each other ordered by text; an empty table gives files without rows.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, scratch_path, text_of
from .idtable import IdTable

END_ID = 0
#: Pieces whose ids an encoder keeps, at most.
KNOWN_PIECES = 1_000_000
#: Words at line starts whose ids an encoder keeps beside that, at most.
ATOMS = 100_000
#: Bytes of text that are encoded at once, about.
BATCH_BYTES = 8 << 20
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
}

_struct = functools.cache(struct.Struct)
#: The byte level's alphabet: printable Latin-1 characters stand for themselves, the other bytes for those from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE = chr(_ALPHABET[ord(" ")])

_CUT = re.compile(r"(?<!\s) ")
#: A sign that ends a word: the pre-tokenizer parts them when white space or nothing follows. MARK stands before the sign
#: when it has become a piece of its own.
MARK = "\ue000"
_SIGN = r"([\pL\pN])([.,;:!?])( |\n|\z)"
#: White space behind a line break of which the pre-tokenizer makes something else than one token for each character.
_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = rf" \n|\n{_BLANK}({_BLANK}|\z)|\n[\t\r\f\x0b]"


class Encoder:
    """Ids of texts as unsigned 32-bit integers.

    Texts come as Arrow arrays: they are split at spaces, before line breaks and before signs at the ends of words, and
    the pieces dictionary encoded, so that each different piece of a batch is looked up once, all at a time; numpy puts
    the ids together. Only pieces that are not in the table are taken to the tokenizer.
    """

    def __init__(self, path: str, known: int = KNOWN_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = t = Tokenizer.from_file(path)
        self._table = IdTable(known)
        #: What is said here about pieces holds for byte-level tokenizers; a text is one piece for the others.
        level = t.pre_tokenizer
        self._level = type(level).__name__ == "ByteLevel" and level.use_regex and not level.add_prefix_space and t.normalizer is None
        self._model = t.model
        #: Texts with one of these are encoded by larger pieces.
        special = [re.escape(x.content) for x in t.get_added_tokens_decoder().values()]
        self._out = "|".join([_RUN, MARK, *special])
        self._atoms: dict[str, bytes] = {}  # ids of words at line starts
        self._newline = self._bytes(["\n"])[0]

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _word(self, letters: str, mark: str = _SPACE) -> bytes:
        """The ids of a word after a space, or without one (mark "")."""
        spelt = mark + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(_ALPHABET))
        ids = [t.id for t in self._model.tokenize(spelt)]
        return _struct(f"<{len(ids)}I").pack(*ids)

    def _made(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: signs and those beginning with a line break as they are, the others after a space."""
        out: list[bytes | None] = []
        others, word, atoms = [], self._word, self._atoms
        for x in pieces:
            if x.isalpha():
                out.append(word(x))
            elif x[0] == "\n" and x[1:].isalpha():
                found = atoms.get(x)
                if found is None:
                    if len(atoms) > ATOMS:
                        atoms.clear()
                    found = atoms[x] = self._newline + word(x[1:], "")
                out.append(found)
            else:
                others.append(x[1:] if x[0] == MARK else x if x[0] == "\n" else f" {x}")
                out.append(None)
        made = iter(self._bytes(others))
        return [next(made) if b is None else b for b in out]

    def _odd(self, text: str) -> bytes:
        """For texts with white space before a space."""
        first, *rest = _CUT.split(text)
        return b"".join(self._bytes([x for x in [first, *[f" {y}" for y in rest]] if x]))

    def encode_all(self, texts: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other and each followed by ``end``, and how many each text has."""
        n = len(texts)
        if not n or not self._level:
            made = [b + struct.pack(f"<{len(end)}I", *end) for b in self._bytes(texts.to_pylist())]
            return np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, n) // 4
        signed = pc.replace_substring_regex(texts, _SIGN, rf"\1 {MARK}\2\3")
        split = pc.split_pattern(pc.replace_substring(signed, "\n", " \n"), " ")
        bounds = split.offsets.to_numpy()
        flat = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds[:-1] - bounds[0]
        at, words = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        last = pc.utf8_slice_codeunits(words, -1)
        bad = (pc.or_(pc.equal(words, ""), pc.and_(pc.utf8_is_space(last), pc.not_equal(words, "\n")))).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, self._out).to_numpy(zero_copy_only=False) | (np.add.reduceat(bad[at], bounds) > 0)
        table = self._table.find(words, ~bad, self._made)
        # First pieces have no space before them; texts that can't be cut are one piece. Both follow the table's own.
        heads = iter(self._bytes(words.take(pa.array(at[bounds[~odd]])).to_pylist()))
        wholes = iter([self._odd(t) for t in texts.filter(pa.array(odd)).to_pylist()])
        own = [next(wholes if o else heads) for o in odd]
        own.append(struct.pack(f"<{len(end)}I", *end))
        at = table[at]
        at[bounds] = len(self._table) + np.arange(n)
        size = np.diff(np.append(bounds, len(at)))
        stays = np.repeat(~odd, size)
        stays[bounds] = True
        at, row = at[stays], np.repeat(np.arange(n), size)[stays]
        ends = np.cumsum(np.bincount(row, minlength=n))
        at, row = np.insert(at, ends, len(self._table) + n), np.insert(row, ends, np.arange(n))
        ids, counts = self._table.ids(at, own)
        return ids, np.bincount(row, counts, n).astype(np.int64)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """docs in order as rows of token files; tokenizer: path of a tokenizer file that every executor has."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = encoder(tokenizer).encode_all, 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
            begin = 0
            while begin < batch.num_rows:
                done = sizes[begin - 1] if begin else 0
                n = max(1, int(np.searchsorted(sizes, done + BATCH_BYTES, "right")) - begin)
                parts, doc_ids, texts = (c.slice(begin, n) for c in batch.columns)
                ids, counts = encode(texts, (end_id,))
                ends = counts.cumsum()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([parts, doc_ids, pa.array(at + ends - counts), pa.array(counts), lists], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                at += int(ends[-1])
                begin += n

    return ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(work, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    encoded(docs, tokenizer, end_id).write.options(**WRITE_OPTIONS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; select what is needed and only those columns are read."""
    return spark.read.schema(SCHEMA).parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): where each file's ids begin in the whole, from two columns. One row per file."""
    totals = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def checksums(rows: DataFrame) -> DataFrame:
    """(part, doc_id, local_start, n_tokens, ids_crc32): CRC-32 over each row's ids as unsigned 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *plain, ids = batch.columns
            ends = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(crcs, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])

    return rows.select("part", "doc_id", "local_start", "n_tokens", "ids").mapInArrow(work, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the files and gives, per document and from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write(docs, path, tokenizer)
    starts = maybe_broadcast(cut(index(spark, path), "token-index"))
    rows = checksums(read(spark, path)).join(starts, "part")
    return rows.select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
