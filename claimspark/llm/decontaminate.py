"""Benchmark decontamination with a generalised suffix automaton over words.

The words of the test items are put into one automaton, which knows every run of words that any item holds. The words of
a training text go through it once; it keeps the length of the longest run that ends at each word and is part of an item.
Where that length reaches the window, the window's words are hit and the items that hold it are named. Items shorter than
the window count whole.

Items are cut into parts of PART_WORDS words that overlap by a window less one word, and the parts dealt to automata of
about SHARD_WORDS words each, which bounds what an executor is sent. Texts pass all automata in one stage, without a
shuffle; up to SHARD_WORDS benchmark words there is just one.

Before the automaton steps through a text, whole Arrow arrays of words are looked up in the items' vocabulary: a word that
no item holds, or a pair of neighbours that no item holds, ends every run, so that only runs as long as a window, or that
hold the last word of a short item, are stepped through.

Defined cases: a null or empty text has no words and is not hit; items without words are no items; items with the same
item_id are one; an item without an id hits words but is not named; repeated documents are judged each; an empty benchmark
hits nothing; an empty table gives no rows. Columns to keep that bear the name of a result column are replaced by it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_of

WINDOW = 10
#: Words of one automaton, about.
SHARD_WORDS = 250_000
#: Words of an item that stay in one part.
PART_WORDS = 20_000
#: Bytes of text that are looked up at once, about.
BATCH_BYTES = 8 << 20
#: So many automata follow each other in one stage.
CHAIN = 8
SPAN = ("first_word", "end_word", "start", "end")
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in SPAN]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])

#: What each byte of UTF-8 becomes: 0 where it is no part of a word, small letters for capitals.
_LETTERS = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LETTERS[_b] = _b
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as one array, where each begins and ends (bytes from the first text's begin), the number
    of the first word of each text (and of all words at the end), and where the texts begin."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    letters = _LETTERS[data]
    inside = letters != 0
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    ends_at = bounds[1:] - 1
    after[ends_at[ends_at >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters[inside]))
    return words, starts, ends, np.searchsorted(starts, bounds), bounds


class Automaton:
    """A generalised suffix automaton of word lists. States are numbers, 0 the empty run."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[str, int] = {}
        self.items: list[str | None] = []
        self._lists: list[tuple[int, bool, list[int]]] = []

    def _state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _copy_for(self, state: int, word: int, target: int) -> int:
        """The state of the run that state and word make, split off from target, whose runs are longer."""
        twin = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = twin
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def _extended(self, last: int, word: int) -> int:
        """The state after word behind last, new runs added."""
        held = self.next[last].get(word)
        if held is not None:
            return held if self.length[held] == self.length[last] + 1 else self._copy_for(last, word, held)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._copy_for(state, word, target)
        return new

    def add(self, item: str | None, words: list[str], whole: bool) -> None:
        """whole: the words are an item shorter than the window."""
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self._lists.append((len(self.items), whole, ids))
        self.items.append(item)
        last = 0
        for word in ids:
            last = self._extended(last, word)

    def finish(self) -> Automaton:
        """Notes which items hold each window and which short items end where."""
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        #: The state whose runs include the last words of a state's runs, as many as a window has.
        self.top = list(range(n))
        for v in order:
            if self.length[self.link[v]] >= self.window:
                self.top[v] = self.top[self.link[v]]
        self.holders: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        pairs, last_words = set(), set()
        for number, whole, ids in self._lists:
            pairs.update(zip(ids, ids[1:], strict=False))
            state = 0
            for i, word in enumerate(ids):
                state = self.next[state][word]
                if i + 1 >= self.window:
                    self.holders.setdefault(self.top[state], set()).add(number)
            if whole:
                self.short.setdefault(state, []).append((len(ids), number))
                last_words.add(ids[-1])
        #: The nearest state, from each on by links, at which a short item ends; 0: none.
        self.marked = [0] * n
        for v in order:
            self.marked[v] = v if v in self.short else self.marked[self.link[v]]
        self.size = max(len(self.vocabulary), 1)
        self.pairs = np.array(sorted(a * self.size + b for a, b in pairs), np.int64)
        self.ends_short = np.zeros(self.size, bool)
        self.ends_short[list(last_words)] = True
        self._lists = []
        return self

    def words(self) -> pa.Array:
        return pa.array(list(self.vocabulary), pa.string())

    def longest(self, ids: list[int]) -> list[int]:
        """The length of the longest run of items that ends at each word (-1: a word that no item has)."""
        return [length for _, length in self._walk(ids)]

    def _walk(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        state, length, following, link, lengths = 0, 0, self.next, self.link, self.length
        for word in ids:
            while state and word not in following[state]:
                state = link[state]
                length = lengths[state]
            to = following[state].get(word)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length

    def hits(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """The hit stretches of a run of words (from, to; joined, in order) and the numbers of the items found."""
        found: set[int] = set()
        stretches: list[list[int]] = []
        for i, (state, length) in enumerate(self._walk(ids)):
            reach = 0
            if length >= self.window:
                reach = self.window
                found |= self.holders[self.top[state]]
            at = self.marked[state]
            while at:
                for k, number in self.short[at]:
                    if k <= length:
                        found.add(number)
                        reach = max(reach, k)
                at = self.marked[self.link[at]]
            if reach:
                begin = i + 1 - reach
                while stretches and stretches[-1][1] >= begin:
                    begin = min(begin, stretches.pop()[0])
                stretches.append([begin, i + 1])
        return [(a, b) for a, b in stretches], found

    def candidates(self, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs begin and end that may hold a window or a short item. firsts: numbers of first words of texts."""
        known = ids >= 0
        joined = np.zeros(len(ids), bool)
        joined[1:] = known[1:] & known[:-1]
        joined[firsts[firsts < len(ids)]] = False
        at = np.flatnonzero(joined)
        if len(self.pairs):
            keys = ids[at - 1] * self.size + ids[at]
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[at[self.pairs[place] != keys]] = False
        else:
            joined[at] = False
        begins = np.flatnonzero(known & ~joined)
        follows = np.zeros(len(ids) + 1, bool)
        follows[:-1] = joined
        ends = np.flatnonzero(known & ~follows[1:]) + 1
        wanted = ends - begins >= self.window
        if self.short:
            upto = np.concatenate([[0], np.cumsum(known & self.ends_short[np.maximum(ids, 0)])])
            wanted |= upto[ends] > upto[begins]
        return begins[wanted], ends[wanted]


def _joined(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans in order, overlapping and touching ones joined."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, start, end in sorted(spans):
        if out and a <= out[-1][1]:
            p = out.pop()
            a, b, start, end = p[0], max(p[1], b), p[2], max(p[3], end)
        out.append((a, b, start, end))
    return out


def parts(items: DataFrame, window: int) -> DataFrame:
    """(item, words, whole) of the items' parts; item: the item_id as a string."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for item, text in zip(frame["item"], frame["text"], strict=True):
                words = words_of(pa.array([text], pa.string()))[0].to_pylist()
                if words:
                    step = max(PART_WORDS, window)
                    out += [(item, words[i : i + step + window - 1], len(words) < window) for i in range(0, max(1, len(words) - window + 1), step)]
            yield pd.DataFrame(out, columns=["item", "words", "whole"])

    return items.select(F.col("item_id").cast("string").alias("item"), text_of().alias("text")).mapInPandas(work, "item string, words array<string>, whole boolean")


def automata(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(shard, automaton) of the items, a written table; the automata are pickled."""
    held = cut(parts(items, window).distinct(), "decontaminate-parts")
    total = held.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = Automaton(window)
        for item, words, whole in frame[["item", "words", "whole"]].sort_values(["item", "whole"]).itertuples(index=False):
            made.add(None if item is None or item != item else str(item), list(words), bool(whole))
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "automaton": [pickle.dumps(made.finish())]})

    dealt = held.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("shard").applyInPandas(build, "shard int, automaton binary"), "decontaminate-automata")


class _Scan:
    """What the words of a batch of texts hit in one automaton."""

    def __init__(self, automaton: Automaton) -> None:
        self._automaton, self._words = automaton, automaton.words()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
        """The number of words of each text, and spans and items of those that are hit."""
        auto = self._automaton
        words, starts, ends, firsts, bounds = words_of(texts)
        ids = pc.fill_null(pc.index_in(words, value_set=self._words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hit: dict[int, tuple[list, set]] = {}
        begins, stops = auto.candidates(ids, firsts)
        owners = np.searchsorted(firsts, begins, "right") - 1
        for a, b, row in zip(begins.tolist(), stops.tolist(), owners.tolist(), strict=True):
            stretches, found = auto.hits(ids[a:b].tolist())
            if stretches:
                spans, items = hit.setdefault(row, ([], set()))
                spans += [(a + x, a + y) for x, y in stretches]
                items |= {auto.items[k] for k in found}
        return np.diff(firsts), {row: (self._placed(texts[row].as_py(), spans, starts, ends, int(firsts[row]), int(bounds[row])), items) for row, (spans, items) in hit.items()}

    @staticmethod
    def _placed(text: str, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray, first: int, at: int) -> list[tuple[int, int, int, int]]:
        """Spans with word numbers within the text and code points, the end exclusive."""
        data, out, done, points = text.encode(), [], 0, 0
        for a, b in spans:
            edges = []
            for byte in (int(starts[a]) - at, int(ends[b - 1]) - at):
                points += len(data[done:byte].decode())
                done = byte
                edges.append(points)
            out.append((a - first, b - first, *edges))
        return out


def matches(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """keep (columns of docs) with n_words, spans (word numbers and code points of the stretches that are hit, ends
    exclusive) and items (ids, as strings, of the items found, sorted)."""
    spark = docs.sparkSession
    names = [c for c in keep if c not in ADDED.names]
    rows = docs.select(*names, text_of().alias("__text"))
    made = automata(items, window)
    numbers = sorted(r[0] for r in made.select("shard").collect())  # one for SHARD_WORDS benchmark words
    for done, number in enumerate(numbers or [None], 1):
        bytes_of = made.filter(F.col("shard") == number).first()["automaton"] if number is not None else pickle.dumps(Automaton(window).finish())
        rows = _passed(rows, spark.sparkContext.broadcast(bytes_of))
        if done % CHAIN == 0:
            rows = cut(rows, "decontaminate-pass")
    return rows.drop("__text")


def _passed(rows: DataFrame, shipped) -> DataFrame:
    """rows with what one more automaton finds."""
    first = "spans" not in rows.columns
    plain = [c for c in rows.columns if c not in ADDED.names and c != "__text"]
    rows = rows.select(*plain, *([] if first else ADDED.names), "__text")
    schema = T.StructType([*rows.select(*plain).schema, *ADDED, T.StructField("__text", T.StringType())])
    types = pa.list_(pa.struct([(n, pa.int32()) for n in SPAN])), pa.list_(pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(pickle.loads(shipped.value))
        for whole in batches:
            for batch in _slices(whole, whole.num_columns - 1):
                counts, hit = scan(batch.column(batch.num_columns - 1))
                spans, found = [[]] * batch.num_rows, [[]] * batch.num_rows
                if not first:
                    spans = [[tuple(s.values()) for s in x] for x in batch.column(len(plain) + 1).to_pylist()]
                    found = batch.column(len(plain) + 2).to_pylist()
                for row, (more, names) in hit.items():
                    spans[row] = _joined([*spans[row], *more])
                    found[row] = sorted({*found[row], *(n for n in names if n is not None)})
                as_rows = [[dict(zip(SPAN, s, strict=True)) for s in x] for x in spans]
                columns = [*batch.columns[: len(plain)], pa.array(counts.astype(np.int64)), pa.array(as_rows, types[0]), pa.array(found, types[1]), batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[*plain, *ADDED.names, "__text"])

    return rows.mapInArrow(work, schema)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    upto, begin = np.cumsum(pc.binary_length(batch.column(column)).to_numpy().astype(np.int64)), 0
    while begin < batch.num_rows:
        n = max(1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + BATCH_BYTES, "right")) - begin)
        yield batch.slice(begin, n)
        begin += n


def n_hit(spans: Column | str = "spans") -> Column:
    """The number of words in the spans."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end_word"] - s["first_word"]).cast("long"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = 0, coverage: float = 0.5) -> DataFrame:
    """docs without the documents of whose words more than ``coverage`` is hit; from the texts of the others the spans of
    more than ``longest`` words are taken out. All columns of docs stay; a null text stays null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = matches(docs.select(row, "text"), items, ["__row"], window)
    rows = rows.filter(n_hit() <= F.lit(coverage) * F.col("n_words"))
    gone = F.filter("spans", lambda s: s["end_word"] - s["first_word"] > longest)
    text = F.col("__row.text")
    # What stays lies between the end of one span and the begin of the next.
    begins = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s["end"]))
    ends = F.concat(F.transform(gone, lambda s: s["start"]), F.array(F.length(text)))
    left = F.array_join(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda p: F.substr(text, p["a"] + 1, p["b"] - p["a"])), "")
    cleaned = F.when(F.size(gone) > 0, left).otherwise(text)
    return rows.select(*[(cleaned if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
