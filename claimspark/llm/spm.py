"""SentencePiece encoding and decoding as a streaming lattice search.

Pieces ending at each boundary of the text are looked up in a window no longer than the longest piece; every boundary
keeps a back pointer to the piece that ends its best path. When the back pointers of all boundaries that can still be
reached from the right end of the window meet in one boundary, the ids up to it are final and are handed out: what the
search holds does not grow with the text, which it takes from an iterator.

Which piece is best depends on the kind of model. For a unigram model it is the highest sum of scores (Viterbi). A BPE
model's scores are merge ranks, whose highest sum is not what the library encodes, so there a boundary's back pointer
is the one piece that byte-pair merging keeps beside the piece that ends where it begins: whether two pieces stay apart
is decided by merging the two alone, and remembered. This gives the library's own ids for either kind.

No piece of the usual models holds the space mark behind another character, so all paths meet before each space mark,
and likewise at line breaks where no piece holds one. The words between such boundaries are dictionary encoded a batch at
a time, searched once each, and remembered in a bounded table; texts with spaces in a row or marks of their own, and
models without these properties, go through the search whole.

Normalisation is the library's, whatever the model's rules. Models with user-defined symbols are refused.

Defined cases: a null text is empty and has no ids; characters that no piece covers become their UTF-8 bytes' pieces,
or the unknown id in models without those; null ids and repeated rows are encoded like any other; an empty table gives
no rows. Columns to keep that bear the name of a result column are replaced by it.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .idtable import IdTable, places

SPACE = "▁"
KNOWN_WORDS = 1_000_000
#: Parts of words beside that.
KNOWN_PARTS = 100_000
#: Words longer than this are not kept in the table.
LONG_WORD = 48
#: Bytes of text that are encoded at once, about.
BATCH_BYTES = 4 << 20
#: Stands before a word that no space stands before. Texts that hold it are not cut into words.
MARK = "\ue000"
SIGNS = ".,;:!?)]}"
#: What an unknown id decodes to.
UNKNOWN = " \u2047 "
#: Shows whether a model changes texts before it looks for pieces.
PROBE = " \ufb01  \uff21b\t\u2460e\u0301\n \u00a0Z  "


_NONE = object()
_struct = functools.cache(struct.Struct)
#: Parts of normalised text before each of which all paths meet: marks and what follows them.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Model:
    """Pieces and normalisation of a model file."""

    def __init__(self, path: str, unigram: bool | None = None, known: int = KNOWN_WORDS) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        try:
            from sentencepiece import sentencepiece_model_pb2 as proto
        except ImportError:
            raise ValueError("the types of pieces cannot be read without protobuf, so user-defined symbols cannot be ruled out") from None
        read = proto.ModelProto.FromString(sp.serialized_model_proto())
        if any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in read.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        as_bytes = lambda i: bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else UNKNOWN.encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode()
        self._bytes = [as_bytes(i) for i in range(n)]
        self._control = np.array([sp.is_control(i) for i in range(n)], bool)
        self._marked = np.array([sp.id_to_piece(i).startswith(SPACE) for i in range(n)], bool)
        self._size = np.fromiter(map(len, self._bytes), np.int64, n)
        self._start = np.cumsum(self._size) - self._size
        self._all_bytes = np.frombuffer(b"".join(self._bytes), np.uint8)
        self._inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = sp.unk_id()
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        low = min(self.scores.values(), default=0.0)
        #: Scores of BPE models are 0, -1, -2, ...; those of unigram models are log probabilities.
        self.unigram = any(s != int(s) for s in self.scores.values()) if unigram is None else unigram
        self.unknown_score = low - 10.0
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._apart: dict[tuple[str, str], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._table = IdTable(known)
        #: Whether all that is done to a text is that spaces become marks and one is put in front.
        self.plain = sp.normalize(PROBE) == SPACE + PROBE.replace(" ", SPACE)
        self._breaks = not any("\n" in pair for pair in self._inside)
        #: Ends of pieces, with the score of those that are pieces themselves.
        self._ends: dict[str, float | None] = {p[k:]: None for p in self.ids for k in range(1, len(p))} | self.scores
        #: Signs that no piece holds behind a letter: words end before them.
        self._signs = "".join(c for c in SIGNS if not any(pair[1] == c and pair[0].isalpha() for pair in self._inside))

    def normalised(self, text: str) -> str:
        if self.plain:
            return SPACE + text.replace(" ", SPACE) if text else ""
        return self.sp.normalize(text)

    # Byte-pair merging of a short text; used on single pieces and pairs of pieces.

    def _merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging leaves right as one piece beside left, the piece before it ("" at the start of the text)."""
        if len(self._apart) > 500_000:
            self._apart.clear()
        found = self._apart[left, right] = self._merged(left + right) == ([left, right] if left else [right])
        return found

    def _apart_from(self, left: str, right: str) -> bool:
        found = self._apart.get((left, right))
        return self._fits(left, right) if found is None else found

    def pieces_of(self, characters: Iterable[str], window: list[int] | None = None) -> Iterator[str]:
        """The pieces of normalised text, as soon as they are final. window: gets the number of boundaries held each
        time pieces are handed out (for tests)."""
        unigram, longest, known_ends, apart = self.unigram, self.longest, self._ends, self._apart
        text = ""  # what is not yet final; boundary k lies before its character k
        back: list[int] = [0]  # back[k]: where the piece ending at boundary k begins
        best: list[float] = [0.0]
        ends: list[str] = [""]  # that piece
        for character in characters:
            text += character
            i = len(text)
            winner, start, piece = None, i - 1, character
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                p = text[j:i]
                score = known_ends.get(p, _NONE)
                if score is _NONE or score is None:
                    if j == i - 1 and unigram:
                        winner = best[j] + self.unknown_score
                    elif j == i - 1 and self._apart_from(ends[j], p):
                        break
                    if score is _NONE:
                        break
                elif unigram:
                    total = best[j] + score
                    if winner is None or total >= winner:
                        winner, start, piece = total, j, p
                else:
                    fit = apart.get((ends[j], p))
                    if self._fits(ends[j], p) if fit is None else fit:
                        start, piece = j, p
                        break
            back.append(start)
            best.append(winner if winner is not None else 0.0)
            ends.append(piece)
            if i >= 2 * longest:
                # Boundaries that later pieces can begin at; where their paths meet is final.
                meet = set(range(i - longest + 1, i + 1))
                while len(meet) > 1:
                    last = max(meet)
                    meet.remove(last)
                    meet.add(back[last])
                final = meet.pop()
                if final:
                    if window is not None:
                        window.append(i)
                    yield from self._path(final, back, ends)
                    text = text[final:]
                    keep = ends[final]
                    back = [max(0, x - final) for x in back[final:]]
                    best = [x - best[final] for x in best[final:]]
                    ends = ends[final:]
                    ends[0], back[0] = keep, 0
        yield from self._path(len(text), back, ends)

    @staticmethod
    def _path(end: int, back: list[int], ends: list[str]) -> list[str]:
        out = []
        while end:
            out.append(ends[end])
            end = back[end]
        return out[::-1]

    def _ids_of(self, pieces: Iterable[str]) -> Iterator[int]:
        after_unknown = False
        for p in pieces:
            found = self.ids.get(p)
            if found is not None:
                after_unknown = False
                yield found
            elif self.byte_ids:
                yield from (self.byte_ids[b] for b in p.encode())
            elif not after_unknown:  # a run of unknown characters has one id
                after_unknown = True
                yield self.unknown

    def stream(self, characters: Iterable[str]) -> Iterator[int]:
        """The ids of normalised text, as soon as they are final."""
        return self._ids_of(self.pieces_of(characters))

    def encode(self, text: str) -> list[int]:
        normal = self.normalised(text)
        if not self._by_words():
            return list(self.stream(normal))
        # Before a space mark that follows another character all paths meet. Marks in a row stay in one part.
        out: list[int] = []
        for m in _WORDS.finditer(normal):
            out += self._word(m[0])
        return out

    def _by_words(self) -> bool:
        return self.splits and not (self.unigram and not self.byte_ids)

    def _made(self, words: list[str]) -> list[bytes]:
        found = [() if w == MARK else self._word(w[1:] if w[:1] == MARK else SPACE + w) for w in words]
        return [_struct(f"<{len(ids)}I").pack(*ids) for ids in found]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        n = len(texts)
        if not n or not (self.plain and self._by_words()):
            made = [np.array(self.encode(t), "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *made]), np.fromiter(map(len, made), np.int64, n)
        odd = pc.or_(pc.match_substring_regex(texts, f"{SPACE}|{MARK}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        parted = pc.replace_substring(texts, "\n", f" {MARK}\n {MARK}") if self._breaks else texts
        parted = pc.replace_substring_regex(parted, rf"(\pL)([{re.escape(self._signs)}])", rf"\1 {MARK}\2") if self._signs else parted
        split = pc.split_pattern(parted, " ")
        bounds = split.offsets.to_numpy()
        flat = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds[:-1] - bounds[0]
        at, words = flat.indices.to_numpy(), flat.dictionary
        # A space before a space: an empty word before one that has a space before it.
        empty, spaced = pc.equal(words, "").to_numpy(zero_copy_only=False)[at], ~pc.starts_with(words, MARK).to_numpy(zero_copy_only=False)[at]
        spaced[bounds] = False
        twice = empty & np.append(spaced[1:], False)
        odd = odd | (np.add.reduceat(twice, bounds) > 0)
        at = self._table.find(words, np.ones(len(words), bool), self._made)[at]
        own = [np.array(self.encode(t), "<u4").tobytes() for t in texts.filter(pa.array(odd)).to_pylist()]
        size = np.diff(np.append(bounds, len(at)))
        at[bounds[odd]] = len(self._table) + np.arange(len(own))
        stays = np.repeat(~odd, size)
        stays[bounds] = True
        ids, counts = self._table.ids(at[stays], own)
        return ids, np.bincount(np.repeat(np.arange(n), size)[stays], counts, n).astype(np.int64)

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a word that isn't in the table. Characters that no piece has next to each other part it too."""
        if word[1:].isalpha():
            return tuple(self.stream(word))
        known, inside, parts, begin = self._words, self._inside, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                parts.append(word[begin:i])
                begin = i
        parts.append(word[begin:])
        out: list[int] = []
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = tuple(self._ids_of(self.pieces_of(part)))
                if len(known) >= KNOWN_PARTS:
                    known.clear()
                if len(part) <= LONG_WORD:
                    known[part] = ids
            out += ids
        return tuple(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text: bytes in a row are joined as UTF-8, marks become spaces, the one put in front goes, control pieces
        are nothing."""
        ids = [i for i in ids if not self._control[i]]
        text = b"".join([self._bytes[i] for i in ids]).decode(errors="replace")
        return text[1:] if ids and self._marked[ids[0]] else text

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids that lie one after the other, so many for each text."""
        ends = np.cumsum(counts)
        firsts = (ends - counts)[counts > 0]
        if not self._control[ids].any():
            starts, sizes = self._start[ids], self._size[ids]
            fronts = firsts[self._marked[ids[firsts]]]
            starts[fronts] += 1
            sizes[fronts] -= 1
            upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
            if upto[-1] < 1 << 31:
                out = pa.StringArray.from_buffers(len(counts), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(self._all_bytes[places(starts, sizes)]))
                try:
                    out.validate(full=True)
                    return out
                except pa.ArrowInvalid:  # bytes that are not UTF-8
                    pass
        return pa.array([self.decode(ids[e - c : e].tolist()) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.string())


_models: dict[tuple, Model] = {}


def model(path: str) -> Model:
    """One model for each Python worker and file."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BATCH_BYTES bytes in a column of texts."""
    upto, begin = np.cumsum(pc.binary_length(batch.column(column)).to_numpy()), 0
    while begin < batch.num_rows:
        n = max(1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + BATCH_BYTES, "right")) - begin)
        yield batch.slice(begin, n)
        begin += n


def encoded(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """keep (columns of docs) with ids and decoded_ok (whether decoding the ids gives back the text, as the model
    normalises it; marks in a text count as spaces). path: of a model file that every executor has."""
    names = [c for c in keep if c not in ("ids", "decoded_ok", "__text")]
    rows = docs.select(*names, text_of().alias("__text"))
    schema = T.StructType([*docs.select(*names).schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_ok", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in _batches(batch, batch.num_columns - 1):
                *plain, texts = part.columns
                ids, counts = m.encode_all(texts)
                want = pc.replace_substring(texts, SPACE, " ") if m.plain else pa.array([m.normalised(t).replace(SPACE, " ").removeprefix(" ") for t in texts.to_pylist()], pa.string())
                right = pc.equal(m.decode_all(ids, counts), want)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([*plain, lists, right], names=[*batch.schema.names[:-1], "ids", "decoded_ok"])

    return rows.mapInArrow(work, schema)


def decoded(rows: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """keep (columns of rows) with the text of the column ids; null ids give a null text."""
    names = [c for c in keep if c != "text"]
    schema = T.StructType([*rows.select(*names).schema, T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            *plain, ids = batch.columns
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
            texts = m.decode_all(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            texts = pc.if_else(pc.is_valid(ids), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*plain, texts], names=[*names, "text"])

    return rows.select(*names, F.col("ids").alias("__ids")).mapInArrow(work, schema)
