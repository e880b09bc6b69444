"""Best-fit packing of tokenised documents into sequences of fixed capacity.

The plan is made on the histogram of piece lengths (at most ``capacity`` numbers, whatever the
corpus): pieces above a third of the capacity are matched greedily, at most two in a sequence; then
smaller ones, longest first, go to the tightest gap. Runs of the plan say where the k-th piece of a
length goes, so the pieces only need a number among those of their length. Each task numbers its own,
and the counts of (task, length) give where they start. No piece is shuffled for its length, and a
length that a third of all pieces has is nothing special.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

CAPACITY = 2048
HELD_WORDS = 200_000
PLAIN_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
ASCII_SPACE = re.compile(r"[ \t\n\r]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: visible Latin-1 characters stand for
    themselves, the others for those from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    return letters | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}


class WordIds(dict):
    """Words between white space -> their ids as little-endian unsigned 32-bit bytes.

    White space parts tokens of this kind of vocabulary anyway. A word of Latin letters, digits and
    marks is parted by the vocabulary's own rule and looked up by part; any other goes to the tokenizer
    as it is. Both tables are emptied when they are full, so memory stays bounded.
    """

    def __init__(self, path: str, held: int = HELD_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.held, self.parts = Tokenizer.from_file(path), held, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.held:
            self.clear()
        if PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join([self.parts.get(p) or self.part(p) for p in PLAIN_PARTS.findall(word.lower())])
        else:
            ids = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def part(self, part: str) -> bytes:
        if len(self.parts) >= self.held:
            self.parts.clear()
        spelled = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        ids = self.parts[part] = self.packed([t.id for t in self.model.tokenize(spelled)])
        return ids

    @staticmethod
    def packed(ids) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def of(self, text: str) -> bytes:
        words = ASCII_SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.__getitem__, filter(None, words)))


_HELD: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table a Python worker, which its tasks share."""
    if path not in _HELD:
        _HELD[path] = WordIds(path)
    return _HELD[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
           keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]): documents cut at the capacity.
    ``nth`` numbers the pieces of a length within a task, from 0."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = end_id.to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]):
        words, task, seen = word_ids(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                data = words.of(text.as_py() or "") + end
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    length = len(part) // 4
                    row = (doc.as_py(), i, at // 4, length, zlib.crc32(part), task, seen[length])
                    yield (*row, part) if keep_ids else row
                    seen[length] += 1

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return map_rows(picked, rows, ddl + (", ids binary" if keep_ids else ""), 512 if keep_ids else 4096)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, count, sequence, each, offset): pieces ``first`` to ``first + count - 1`` of
    a length go to the sequences from ``sequence`` on, ``each`` in one, from ``offset`` there.

    A run is shared by all sequences of a kind, and filling a gap leaves less than half of it, so the
    number of runs depends on the capacity only.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    assert all(0 < n <= capacity for n in left)
    runs, used, opened = [], Counter(), 0
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> [first sequence, how many]

    def put(length: int, bins: int, each: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], bins * each, sequence, each, offset))
        used[length] += bins * each
        left[length] -= bins * each

    def gap(size: int, sequence: int, bins: int) -> None:
        if size and bins:
            gaps[size].append([sequence, bins])

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            b = next((x for x in reversed(large[:bisect_right(large, min(a, capacity - a))])
                      if left[x] > (x == a)), None)
            if b is None:
                bins, n = left[a], a
                put(a, bins, 1, opened, 0)
            elif b == a:
                bins, n = left[a] // 2, 2 * a
                put(a, bins, 2, opened, 0)
            else:
                bins, n = min(left[a], left[b]), a + b
                put(a, bins, 1, opened, 0)
                put(b, bins, 1, opened, a)
            gap(capacity - n, opened, bins)
            opened += bins
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for size in sorted(g for g in gaps if g >= s):
            kinds, gaps[size] = gaps[size], []
            for first, bins in kinds:
                each = size // s
                full = min(bins, left[s] // each)
                if full:
                    put(s, full, each, first, capacity - size)
                    gap(size - each * s, first, full)
                rest = left[s] if full < bins and left[s] < each else 0
                if rest:
                    put(s, 1, rest, first + full, capacity - size)
                    gap(size - rest * s, first + full, 1)
                gap(size, first + full + bool(rest), bins - full - bool(rest))
            if not left[s]:
                break
        each = capacity // s
        for bins, n in ((left[s] // each, each), (1, left[s] % each)):
            if bins and n:
                put(s, bins, n, opened, 0)
                gap(capacity - n * s, opened, bins)
                opened += bins
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
         keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A null or empty text is the end id alone. A repeated row is packed again. A null doc_id stays null.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col), "pieces")
    counts = stored(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(
        plan(lengths, capacity),
        "length long, first long, count long, sequence long, each long, place long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "task"]).withColumn("k", F.col("before") + F.col("nth"))
    k = F.col("k") - F.col("first")
    placed = ranked.alias("p").join(
        F.broadcast(runs).alias("r"),
        (F.col("p.length") == F.col("r.length")) & (k >= 0) & (k < F.col("count")))
    return placed.select(
        "doc_id", "piece", "start", "p.length", "ids_crc32",
        (F.col("sequence") + F.expr("(k - first) div each")).alias("sequence_id"),
        (F.col("place") + (k % F.col("each")) * F.col("p.length")).alias("offset"),
        *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from ``pack(..., keep_ids=True)``. The ids
    are little-endian unsigned 32-bit bytes; a group is one sequence, so its size is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))
