"""Benchmark decontamination by a positional inverted index over the training tokens.

The index is a table of segments. A segment holds the postings of a bounded number of documents: for
each term the ascending positions of its tokens in the segment, with a gap between documents that no
phrase can bridge. Each segment is one row, written to the shared folder, so looking up a phrase needs
no shuffle: every task reads its segments, takes the rarest term of a phrase there, and intersects its
positions with those of the other terms, shifted by their offsets, rarest first. The index holds every
term of every document and doesn't depend on the benchmark.

Benchmark items are looked up in blocks of bounded size, each against all segments.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

WINDOW = 13
SEGMENT_TOKENS = 500_000
BLOCK_BYTES = 4 << 20
#: Empty positions between documents; phrases and spans are shorter.
GAP = 1024
#: Bytes to terms: A-Z lower-cased, what isn't part of a word made a space (fixed by the contract).
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8: runs of ASCII letters and digits and all other characters
    from U+0080 on, with A-Z lower-cased. A null text has none."""
    return (text or "").encode().translate(WORD_BYTES).split()


def _segment(name: str, docs: list, sizes: list[int], tokens: list[bytes]) -> tuple:
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
    starts = np.zeros(len(sizes), np.int64)
    starts[1:] = np.cumsum(np.asarray(sizes[:-1], np.int64) + GAP)
    at = np.arange(len(ids), dtype=np.int64) + np.repeat(np.arange(len(sizes), dtype=np.int64) * GAP, sizes)
    order = np.argsort(ids, kind="stable")
    ends = np.cumsum(np.bincount(ids, minlength=len(numbers)))
    return (name, docs, starts.astype("<i8").tobytes(), np.asarray(sizes, "<i8").tobytes(), b" ".join(numbers),
            ends.astype("<i8").tobytes(), at[order].astype("<i4").tobytes())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The segments of ``docs``: (docs, starts, sizes, terms, ends, positions). A segment ends with the
    document that fills it, so a very long one fills its own. Not stored yet; see ``stored``."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]):
        ids, sizes, tokens = [], [], []
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = words(text.as_py())
                ids.append(doc.as_py())
                sizes.append(len(found))
                tokens += found
                if len(tokens) + GAP * len(ids) >= segment_tokens:
                    yield _segment(f"{task}-{made}", ids, sizes, tokens)
                    made += 1
                    ids, sizes, tokens = [], [], []
        if ids:
            yield _segment(f"{task}-{made}", ids, sizes, tokens)

    return map_rows(picked, rows, "segment string, docs array<long>, starts binary, sizes binary, terms binary, "
                                  "ends binary, positions binary", 1)


class Segment:
    def __init__(self, row: dict):
        self.name, self.docs = row["segment"], row["docs"]
        self.starts, self.sizes, self.ends = (np.frombuffer(row[k], "<i8") for k in ("starts", "sizes", "ends"))
        self.positions = np.frombuffer(row["positions"], "<i4")
        terms = row["terms"].split()
        self.number = dict(zip(terms, range(len(terms))))

    def posting(self, term: bytes) -> np.ndarray:
        n = self.number.get(term)
        if n is None:
            return self.positions[:0]
        return self.positions[self.ends[n - 1] if n else 0:self.ends[n]]

    def phrase(self, phrase: tuple[bytes, ...], posting=None) -> np.ndarray:
        """Where ``phrase`` begins: the lists of its terms, shifted by their offsets, intersected from
        the rarest on."""
        posting = posting or self.posting
        lists = sorted(((posting(t), k) for k, t in enumerate(phrase)), key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for other, k in lists[1:]:
            if not len(found):
                break
            wanted = found + k
            i = np.searchsorted(other, wanted)
            hit = i < len(other)
            hit[hit] = other[i[hit]] == wanted[hit]
            found = found[hit]
        return found

    def near(self, terms: tuple[bytes, ...], within: int) -> np.ndarray:
        """Where spans begin that hold every term, the last of them at most ``within`` words behind the
        first. Only places near a posting of the rarest term are looked at, but each term may be the first."""
        lists = sorted((self.posting(t) for t in set(terms)), key=len)
        rarest = lists[0]
        if not len(rarest):
            return rarest
        begins = [rarest]
        for other in lists[1:]:
            # The rarest term must follow within the span.
            i = np.searchsorted(rarest, other)
            hit = i < len(rarest)
            hit[hit] = rarest[i[hit]] <= other[hit] + within
            begins.append(other[hit])
        found = np.unique(np.concatenate(begins))
        for other in lists:
            i = np.searchsorted(other, found)
            hit = i < len(other)
            hit[hit] = other[i[hit]] <= found[hit] + within
            found = found[hit]
        return found

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment({name: batch.column(name)[i].as_py() for name in batch.schema.names})


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
    """Lists of (item_id, words) whose texts have at most ``block_bytes``, one at a time; an item that
    is longer makes its own."""
    block, size = [], 0
    for item, text in items.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        found = words(text)
        if item is None or not found:
            continue
        if block and size + len(text) * 4 > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, found))
        size += len(text) * 4
    if block:
        yield block


def phrase_runs(index: DataFrame, block: list[tuple[str, list[bytes]]], window: int = WINDOW) -> DataFrame:
    """(segment, nth, doc_id, n_words, runs) for each indexed document, the ``nth`` of its segment: ``runs``
    are the stretches of words, as (item, start, end), where windows of the items occur; overlapping
    occurrences of an item are one run."""
    broadcast = index.sparkSession.sparkContext.broadcast(block)

    def rows(batches: Iterator[pa.RecordBatch]):
        by_window: dict[tuple, list[str]] = defaultdict(list)
        for item, found in broadcast.value:
            size = min(window, len(found))
            for w in dict.fromkeys(tuple(found[i:i + size]) for i in range(len(found) - size + 1)):
                by_window[w].append(item)
        for segment in segments(batches):
            held: dict[bytes, np.ndarray] = {}

            def posting(term):
                if term not in held:
                    held[term] = segment.posting(term)
                return held[term]

            starts = defaultdict(list)  # (item, window length) -> begins; a repeated item may have two lengths
            for w, of in by_window.items():
                if all(t in segment.number for t in w) and len(found := segment.phrase(w, posting)):
                    for item in of:
                        starts[item, len(w)].append(found)
            runs = defaultdict(list)
            for (item, size), several in starts.items():
                begins = np.sort(np.concatenate(several))
                first = np.concatenate([[True], begins[1:] > begins[:-1] + size])
                last = np.concatenate([first[1:], [True]])
                for a, z, doc in zip(begins[first], begins[last] + size, segment.doc_of(begins[first])):
                    runs[int(doc)].append((item, int(a - segment.starts[doc]), int(z - segment.starts[doc])))
            for n, doc in enumerate(segment.docs):
                yield segment.name, n, doc, int(segment.sizes[n]), [dict(zip(("item", "start", "end"), r)) for r in runs.get(n, ())]

    return map_rows(index, rows, "segment string, nth int, doc_id long, n_words long, "
                                 "runs array<struct<item:string,start:int,end:int>>")


def proximity(index: DataFrame, block: list[tuple[str, list[bytes]]], within: int = 2 * WINDOW) -> DataFrame:
    """(doc_id, item): documents with a span that holds all words of an item, in any order, the last of them at
    most ``within`` words behind the first. Documents alone decide, not the segments they are in. A null doc_id
    is given back as null."""
    if within >= GAP:
        raise ValueError(f"within has to be less than {GAP}, the gap between documents of a segment")
    broadcast = index.sparkSession.sparkContext.broadcast(block)

    def rows(batches: Iterator[pa.RecordBatch]):
        for segment in segments(batches):
            for item, found in broadcast.value:
                for n in np.unique(segment.doc_of(segment.near(tuple(found), within))):
                    yield segment.docs[n], item

    return map_rows(index, rows, "doc_id long, item string")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs) for each row of ``docs``.

    A null text has no words; such a document is clean, as is one that no window occurs in. Items with
    a null id or without words are left out; items with equal texts all count. Rows that repeat an item_id
    are one item with the windows of all its texts, each text by its own window length. A repeated row is
    repeated in the result, a null doc_id stays null. Other columns are ignored. Empty tables give no
    rows, or rows without hits.
    """
    index = stored(build_index(docs, id_col, text_col), "positional-index")
    parts = [phrase_runs(index, block, window) for block in blocks(items, item_id, item_text)]
    found = parts[0] if parts else phrase_runs(index, [], window)
    if len(parts) > 1:
        found = reduce(DataFrame.unionByName, parts).groupBy("segment", "nth", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("runs")).alias("runs"))
    return judged(found)


def judged(found: DataFrame) -> DataFrame:
    """Counts from the runs of each document. Runs of several items may overlap; their words count once."""
    spans = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(spans, zero, lambda acc, r: F.struct(
        (acc["n"] + F.greatest(r["end"] - F.greatest(r["start"], acc["upto"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(acc["upto"], r["end"]).alias("upto")))["n"]
    items = F.array_sort(F.array_distinct(F.transform("runs", lambda r: r["item"])))
    hit = F.when(F.size("runs") > 0, covered).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "runs",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that the benchmark contaminates; the columns stay. Rows with a null doc_id
    can't be named and stay."""
    bad = decontaminate(docs, items, id_col=id_col, text_col=text_col).filter("contaminated").select("doc_id")
    # The row is carried as one column, so its names can't clash with those used here.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return rows.join(stored(bad.distinct(), "contaminated"), "doc_id", "left_anti").select("row.*")
