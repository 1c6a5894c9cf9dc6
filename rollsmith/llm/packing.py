"""Packing token sequences by bounded-space online best-fit.

Texts become token ids of a public tokenizer plus an end id; documents longer than
a sequence are cut into full pieces, the last of which may be shorter. Pieces arrive
in an order fixed by hash and go into the open bin with the least free space that
still holds them. A fixed number of bins is open; a bitset keyed by free space finds
the bin, and when a new one is needed at the limit the fullest closes first. Bins
still open at the end of a partition are packed again, bin by bin, by the same rule
in a tree of ever fewer partitions, so that partitioning costs almost nothing.

Defined results: a null or blank text has only the end id; a null id is kept as it
is; repeated rows are packed each for itself; an empty table gives an empty result.
Very long texts are tokenized whole and cut into pieces; equal bins are taken by their
number; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.llm.common import LOWER, TextBuffer, frugal, materialize, slices, tidy

CAPACITY, OPEN_BINS, END_ID = 4096, 512, 1
#: Pieces that one packing task takes, bins of earlier tasks that a merging task takes, and words whose ids a worker remembers.
PIECES_PER_TASK, BINS_PER_TASK, REMEMBERED = 400_000, 131_072, 200_000
#: Bytes of a text that are tokenized at once.
SLICE = 4 << 20
#: Runs that one call of the tokenizer takes.
CALL = 16_384


class Memory:
    """A bounded table of what was seen lately: two generations, the older one dropped when the newer is full."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: Iterable[bytes]) -> list[bytes]:
        """Distinct keys that are not known; known ones are in ``new`` afterwards."""
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for key in keys:
            if key not in new:
                if key in old:
                    new[key] = old[key]
                else:
                    out.append(key)
        return out


#: The longest run of letters or marks that is told apart in numbers, and the kinds of bytes: white
#: space, letters of Latin-1 in lower case, ASCII marks but the apostrophe, and all else.
LONGEST = 32
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = _MARK


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capital letters of Latin-1 in lower case, as the vocabulary itself folds them."""
    out = LOWER[data]
    capital = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[capital] += 32
    return out


#: Byte-level vocabularies spell the bytes that are no printable character of Latin-1 by characters from U+0100 on, in order.
_SPELLED = {byte: 256 + 33 + k for k, byte in enumerate([*range(0x7F, 0xA1)])} | {0xAD: 256 + 67}


class Encoder:
    """Token ids of whole texts.

    The tokenizer drops white space and never joins across it, nor across a letter and
    a mark, so a text's ids are those of its runs in order, and a run's those of its
    letters and of its marks (tests hold this against whole texts). Runs are found and
    told apart in numbers; only what differs reaches the tokenizer, and what was seen
    lately is remembered. New runs of letters are encoded many at a time, and split
    again by the tokens that end a word.

    With ``added_tokens`` the ids are those of the tokenizer as its file has it: a text
    that holds an added token such as ``<|endoftext|>``, in whatever case, is encoded
    whole. Without, what spells such a token is text like any other.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.added = [x for x in dict.fromkeys(folded(np.frombuffer(t.encode(), np.uint8)).tobytes() for t in added) if x]
        self.runs, self.letters = Memory(REMEMBERED), Memory(REMEMBERED)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            # The same model without normalizer and pattern, for letters that are lower case already.
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def learn_letters(self, keys: list[bytes]) -> dict[bytes, bytes]:
        new = self.letters.missing(keys)
        new.sort(key=bytes.isascii)  # what needs no other spelling comes together
        for a in range(0, len(new), CALL):
            part = new[a : a + CALL]
            spelled = [b" ".join(part[i : i + 64]) for i in range(0, len(part), 64)]
            spelled = [x.decode("ascii") if x.isascii() else x.decode("latin-1").translate(_SPELLED) for x in spelled]
            ids = np.array([i for e in self.plain.encode_batch_fast(spelled, add_special_tokens=False) for i in e.ids], np.uint32)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(part) and ends[-1] == 4 * len(ids):
                whole, ends = ids.tobytes(), ends.tolist()
                self.letters.new.update(zip(part, [whole[x:y] for x, y in zip([0, *ends], ends)]))
            else:
                self.letters.new.update(zip(part, self.encode(part)))
        return self.letters.new

    def learn_runs(self, keys: list[bytes]) -> dict[bytes, bytes]:
        new = self.runs.missing(set(keys))
        self.runs.new.update(zip(new, self.encode(new)))
        return self.runs.new

    def marked(self, buffer: TextBuffer) -> list[int]:
        """The texts that hold an added token, told in lower case."""
        text, starts = folded(buffer.data).tobytes(), buffer.offsets[:-1]
        found = set()
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                row = int(np.searchsorted(starts, at, side="right")) - 1
                if at + len(token) <= buffer.offsets[row + 1]:
                    found.add(row)
                    at = int(buffer.offsets[row + 1]) - 1
                at = text.find(token, at + 1)
        return sorted(found)

    def batch(self, buffer: TextBuffer) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a buffer end to end, and where each text's begin (and the last ends)."""
        marked = self.marked(buffer) if len(buffer.data) else []
        if not marked:
            return self.by_runs(buffer)
        data, at = buffer.data.tobytes(), buffer.offsets.tolist()
        whole = dict(zip(marked, self.encode([data[at[i] : at[i + 1]] for i in marked])))
        texts = [b"" if i in whole else data[a:b] for i, (a, b) in enumerate(zip(at, at[1:]))]
        ids, bounds = self.by_runs(TextBuffer(pa.array(texts, pa.large_binary())))
        parts = [np.frombuffer(whole[i], "<u4") if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(list(map(len, parts)))))

    def by_runs(self, buffer: TextBuffer) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without an added token."""
        data = np.concatenate((folded(buffer.data), np.zeros(LONGEST + 8, np.uint8)))
        inside = data[: len(buffer.data)]
        kind = _KIND[inside]
        lead = np.flatnonzero(inside == 0xC3)
        after = data[lead + 1]
        kind[lead[(after == 0x97) | (after == 0xB7)]] = _OTHER
        if self.ends is None:
            kind[kind != _SPACE] = _OTHER
        change = np.empty(len(inside), bool)
        change[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change[buffer.offsets[:-1][np.diff(buffer.offsets) > 0]] = True
        starts = np.flatnonzero(change)
        kinds, sizes = kind[starts], np.diff(starts, append=len(inside))
        # A run of non-space with a byte of another kind, or with a piece that is too long, is encoded as a whole.
        odd = (kinds == _OTHER) | (sizes > LONGEST) & (kinds != _SPACE)
        text = inside.tobytes()
        units = [b""]
        places, numbers = [], []
        if odd.any():
            new_run = kinds == _SPACE
            new_run[np.searchsorted(starts, buffer.offsets[:-1][np.diff(buffer.offsets) > 0])] = True
            run = np.cumsum(new_run)
            bad = np.unique(run[odd])
            within = np.isin(run, bad) & (kinds != _SPACE)
            first = np.flatnonzero(within & np.concatenate(([True], (run[1:] != run[:-1]) | (kinds[:-1] == _SPACE))))
            ends = np.concatenate((starts, [len(inside)]))
            stop = np.searchsorted(run, run[first], side="right")
            words = [text[a:b] for a, b in zip(starts[first].tolist(), ends[stop].tolist())]
            known = self.learn_runs(words)
            number = {w: len(units) + i for i, w in enumerate(dict.fromkeys(words))}
            units += map(known.__getitem__, number)
            places.append(starts[first])
            numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            kinds = np.where(within, _OTHER, kinds)
        for which, learn in ((_LETTER, self.learn_letters), (_MARK, self.learn_runs)):
            some = np.flatnonzero(kinds == which)
            at, n = starts[some], sizes[some]
            pick, owner, loose = _distinct(data, at, n)
            words = [text[a : a + k] for a, k in zip(at[pick].tolist(), n[pick].tolist())]
            alone = [text[a : a + k] for a, k in zip(at[loose].tolist(), n[loose].tolist())]
            owner = owner + len(units)
            owner[loose] = len(units) + len(words) + np.arange(len(alone))
            words += alone
            known = learn(words)
            units += map(known.__getitem__, words)
            places.append(at)
            numbers.append(owner)
        values = np.frombuffer(b"".join(units), "<u4")
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units))))) // 4
        place, unit = np.concatenate(places), np.concatenate(numbers)
        order = np.argsort(place, kind="stable")
        place, unit = place[order], unit[order]
        lengths = bounds[unit + 1] - bounds[unit]
        reached = np.concatenate(([0], np.cumsum(lengths)))
        index = np.repeat((bounds[unit] - reached[:-1]).astype(np.int32), lengths)
        index += np.arange(len(index), dtype=np.int32)
        return values[index], reached[np.searchsorted(place, buffer.offsets)]

    def ids(self, text: bytes) -> Iterator[bytes]:
        """The ids of one text, in runs, so that a very long one needs little memory."""
        rest = b""
        for at in range(0, len(text) or 1, SLICE):
            piece = rest + text[at : at + SLICE]
            rest = b""
            if at + SLICE < len(text):
                cut = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
                piece, rest = piece[:cut], piece[cut:]
            yield self.batch(TextBuffer(pa.array([piece], pa.large_binary())))[0].tobytes()


def _distinct(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of each distinct byte range, which of them each range is, and ranges left over by a hash collision.

    Ranges are up to ``LONGEST`` bytes; their content is compared exactly.
    """
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    key, chunks = n.astype(np.uint64), []
    with np.errstate(over="ignore"):
        for k in range(0, int(n.max(initial=0)), 8):
            some = np.flatnonzero(n > k) if k else slice(None)
            rest = np.minimum(n[some] - k, 8).astype(np.uint64)
            chunk = view[at[some] + k] & (full >> (np.uint64(8) * (np.uint64(8) - rest)))
            chunks.append((some, chunk))
            mixed = (key[some] ^ chunk) * np.uint64(0x9E3779B97F4A7C15)
            key[some] = mixed ^ (mixed >> np.uint64(29))
    _, pick, owner = np.unique(key, return_index=True, return_inverse=True)
    differs = n != n[pick][owner] if len(n) else np.zeros(0, bool)
    for k, (some, chunk) in enumerate(chunks):
        whole = np.zeros(len(n), np.uint64)
        whole[some] = chunk
        differs[some] |= chunk != whole[pick][owner[some]]
    return pick, owner, np.flatnonzero(differs)


@functools.cache
def encoder(path: str, added_tokens: bool = False) -> Encoder:
    """This worker's encoder; what it remembers serves all tasks that the worker runs."""
    return Encoder(path, added_tokens)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, added_tokens: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` for each piece of each document.

    ``tokenizer`` is the path of the vocabulary file, present on every machine.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"]
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, added_tokens)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                buffer = TextBuffer(part.column("text"))
                if len(buffer.data) <= SLICE:
                    ids, bounds = coder.batch(buffer)
                    whole, bounds = ids.tobytes(), (4 * bounds).tolist()
                    encoded = ([whole[a:b]] for a, b in zip(bounds, bounds[1:]))
                else:
                    data, at = buffer.data.tobytes(), buffer.offsets.tolist()
                    encoded = (coder.ids(data[a:b]) for a, b in zip(at, at[1:]))
                row, number, start, length, crc = array("q"), array("q"), array("q"), array("q"), array("q")
                for i, runs in enumerate(encoded):
                    held, done = b"", 0
                    for ids in itertools.chain(runs, (None,)):
                        held += end if ids is None else ids
                        # Full pieces go out; what may still grow is held back, unless the text has ended.
                        ready = len(held) if ids is None else (len(held) - 1) // (4 * capacity) * 4 * capacity
                        for k in range(0, max(ready, 0), 4 * capacity):
                            head = held[k : k + 4 * capacity]
                            for column, value in ((row, i), (number, done), (start, done * capacity), (length, len(head) // 4), (crc, zlib.crc32(head))):
                                column.append(value)
                            done += 1
                        held = held[max(ready, 0) :]
                ids = part.column("id").take(pa.array(np.frombuffer(row, np.int64)))
                columns = [np.frombuffer(x, np.int64) for x in (number, start, length, crc)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], names=names)

    return kept.mapInArrow(frugal(run), f"id {kept.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins in a bitset: bit f is set while some open bin has f tokens of free space."""

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.next = capacity, most, first
        self.bits, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for an item."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most and self.bits:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(number)
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def left(self) -> Iterator[tuple[int, int]]:
        """The bins still open and the tokens in each."""
        for free, numbers in enumerate(self.by_free):
            for number in numbers:
                yield number, self.capacity - free


def _pack(capacity: int, most: int):
    """Best-fit over a partition of ``number, length``; rows of open bins follow with ``number`` null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = Bins(capacity, most, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("length"), pa.array([x[0] for x in placed], pa.int64()), pa.array([x[1] for x in placed], pa.int64())], names=["item", "length", "bin", "offset"])
        rest = list(bins.left())
        item = pa.nulls(len(rest), batch.column("item").type) if rest else None
        if rest:
            yield pa.RecordBatch.from_arrays([item, pa.array([x[1] for x in rest], pa.int64()), pa.array([x[0] for x in rest], pa.int64()), pa.nulls(len(rest), pa.int64())], names=["item", "length", "bin", "offset"])

    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with a column ``length`` (1 to ``capacity``).

    ``items`` is read once for each level of the tree and should be a written table.
    """
    columns = items.columns
    count = items.count()
    tasks = max(1, -(-count // PIECES_PER_TASK))
    rows = items.select(F.struct(*columns).alias("item"), F.col("length").cast("long").alias("length"), F.xxhash64(*columns).alias("at"))
    rows = rows.repartition(tasks, "at").sortWithinPartitions("at", "item").select("item", "length")
    shape = f"item {rows.schema['item'].dataType.simpleString()}, length long, bin long, offset long"
    placed = materialize(rows.mapInArrow(_pack(capacity, open_bins), shape))
    found = placed.where("item is not null").select("item.*", "bin", "offset")
    rest, level = placed.where("item is null").select(F.col("bin").alias("item"), "length"), 0
    waiting = rest.count()
    parts = placed.where("item is null").select(F.expr("shiftright(bin, 40)")).distinct().count() if waiting else 0
    while parts > 1:
        level += 1
        groups = max(1, -(-waiting // BINS_PER_TASK))
        groups = groups if groups < parts else max(1, parts // 2)
        spread = rest.withColumn("at", F.xxhash64("item", F.lit(level)))
        spread = (spread.repartition(groups, F.pmod("at", F.lit(groups))) if groups > 1 else spread.coalesce(1)).sortWithinPartitions("at").select("item", "length")
        merged = materialize(spread.mapInArrow(_pack(capacity, open_bins), "item long, length long, bin long, offset long"))
        moved = merged.where("item is not null").select(F.col("item").alias("old"), (F.col("bin") + F.lit(level << 56)).alias("new"), F.col("offset").alias("shift"))
        found = found.join(moved, found["bin"] == moved["old"], "left").select(*columns, F.coalesce("new", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
        rest = merged.where("item is null").select((F.col("bin") + F.lit(level << 56)).alias("item"), "length")
        waiting, parts = rest.count(), groups
    return found.withColumnRenamed("bin", "sequence_id")


@tidy
def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, added_tokens: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    found = materialize(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, added_tokens=added_tokens))
    return pack(found, capacity=capacity, open_bins=open_bins).withColumnRenamed("id", id_col)
