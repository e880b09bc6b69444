"""Ranked lexical search by presence masks.

The index is a table of segments, each the postings (document, frequency) of every term of a bounded
number of documents; it depends on no query. For each item a task marks in a bitmap which of the item's
terms each document of a segment has. Documents with the same mask are a group, and a mask's highest
possible score follows from the largest frequency of its terms in the segment and the shortest document of
the group. Groups are scored by falling highest score until none left can reach the item's k-th score so
far, which a task carries on from segment to segment. Scores are integers, so the result is exact.

Items are read in blocks of bounded size; each block is looked up in all segments.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import map_rows, stored

SEGMENT_TOKENS = 500_000
BLOCK_BYTES = 4 << 20
#: Documents that are scored before the k-th score is looked at again.
BATCH = 64
#: Saturation in thousandths, of which the document's length makes up 8 of 10 (fixed by the contract).
SCALE, PER_TF, PER_M = 1_000_000_000, 1000, 8
#: Bytes to terms: A-Z lower-cased, what isn't part of a term made a space (fixed by the contract).
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INT64 = 2 ** 63 - 1


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8. A null text has none."""
    return (text or "").encode().translate(TERM_BYTES).split()


def _segment(docs: list, sizes: list[int], tokens: list[bytes]) -> tuple:
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    term = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    doc = np.repeat(np.arange(len(docs), dtype=np.int64), sizes)
    pairs, tf = np.unique(term * len(docs) + doc, return_counts=True)
    df = np.bincount(pairs // len(docs), minlength=len(numbers))
    return (docs, np.asarray(sizes, "<i8").tobytes(), b" ".join(numbers), np.cumsum(df).astype("<i8").tobytes(),
            (pairs % len(docs)).astype("<i4").tobytes(), tf.astype("<i4").tobytes())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The segments of the documents with a term: (docs, sizes, terms, ends, at, tf). A segment ends with the
    document that fills it, so a very long one fills its own. Not stored yet; see ``stored``."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]):
        ids, sizes, tokens = [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = terms(text.as_py())
                if not found:
                    continue
                ids.append(doc.as_py())
                sizes.append(len(found))
                tokens += found
                if len(tokens) >= segment_tokens:
                    yield _segment(ids, sizes, tokens)
                    ids, sizes, tokens = [], [], []
        if ids:
            yield _segment(ids, sizes, tokens)

    return map_rows(picked, rows, "docs array<long>, sizes binary, terms binary, ends binary, at binary, tf binary", 1)


class Segment:
    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.sizes, self.ends = (np.frombuffer(row[k], "<i8") for k in ("sizes", "ends"))
        self.at, self.tf = (np.frombuffer(row[k], "<i4") for k in ("at", "tf"))
        names = row["terms"].split()
        self.number = dict(zip(names, range(len(names))))

    def part(self, number: int) -> slice:
        return slice(int(self.ends[number - 1]) if number else 0, int(self.ends[number]))


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment({name: batch.column(name)[i].as_py() for name in batch.schema.names})


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Lists of (item, {term: times}) of items with a term, with at most about ``block_bytes`` of text each.
    ``items`` (item, text) has the rows of an item one after the other; their terms count together."""
    block: list[tuple] = []
    size = 0
    for item, text in items.toLocalIterator():
        found = terms(text)
        if not found:
            continue
        if block and block[-1][0] == item:
            block[-1][1].update(found)
            size += len(text) * 4
            continue
        if block and size + len(text) * 4 > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, Counter(found)))
        size += len(text) * 4
    if block:
        yield block


def document_frequencies(index: DataFrame, wanted: frozenset) -> dict[bytes, int]:
    """In how many documents each of the wanted terms is. The result is as large as the wanted terms."""
    held = index.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]):
        sums: Counter = Counter()
        for batch in batches:
            for names, ends in zip(batch.column(0), batch.column(1)):
                df = np.diff(np.frombuffer(ends.as_py(), "<i8"), prepend=0)
                for term, n in zip(names.as_py().split(), df.tolist()):
                    if term in held.value:
                        sums[term] += n
        yield from sums.items()

    counted = map_rows(index.select("terms", "ends"), rows, "term binary, df long")
    return {bytes(r["term"]): r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class Statistics:
    """What scores depend on: the documents with a term (``n``), all their terms (``total``), weights."""

    def __init__(self, n: int, total: int, df: dict[bytes, int]):
        self.n, self.total = n, total
        self.weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}

    def length(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents with so many terms; exact also where a product passes 64 bits."""
        if int(sizes.max()) * self.n * 75 <= INT64:
            return 25 + 75 * sizes * self.n // self.total
        return np.array([25 + 75 * int(s) * self.n // self.total for s in sizes], np.int64)


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (PER_TF * tf + PER_M * m)


class Best:
    """The k best (score, id, tie) of one item so far: higher scores first, then smaller ids, nulls last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """A score below this can't enter."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, found: list[tuple]) -> None:
        ordered = sorted(self.rows + found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        self.rows = ordered[:self.k]


def masks(segment: Segment, names: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, masks, frequencies): each document that has one of the terms, by its number; bit i of its
    mask, a row of 64-bit words, says that it has term i, ``frequencies[i]`` times."""
    tf = np.zeros((len(names), len(segment.docs)), np.int64)
    mask = np.zeros((len(segment.docs), -(-len(names) // 64)), np.uint64)
    for i, number in enumerate(names):
        part = segment.part(number)
        at = segment.at[part]
        tf[i, at] = segment.tf[part]
        mask[at, i // 64] |= np.uint64(1 << (i % 64))
    docs = np.flatnonzero(mask.any(axis=1))
    return docs, mask[docs], tf[:, docs]


def search(segment: Segment, m: np.ndarray, wanted: list[tuple[bytes, int]], weight: dict[bytes, int], best: Best) -> int:
    """Adds the segment's documents that enter the item's best; returns how many were scored. ``wanted``:
    the item's terms and how often it has each."""
    held = [(segment.number[t], times * weight[t]) for t, times in wanted if t in segment.number and weight[t] > 0]
    if not held:
        return 0
    worth = np.array([w for _, w in held], np.int64)
    docs, mask, tf = masks(segment, [n for n, _ in held])
    groups, group = np.unique(mask, axis=0, return_inverse=True)
    group = group.reshape(-1)
    shortest = np.full(len(groups), INT64 // 16)
    np.minimum.at(shortest, group, m[docs])
    highest = np.zeros(len(groups), np.int64)
    for i, w in enumerate(worth):
        has = (groups[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) > 0
        highest[has] += w * saturated(tf[i].max(), shortest[has])
    by_group = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by_group], np.arange(len(groups) + 1))
    order = np.argsort(-highest, kind="stable")
    scored, at = 0, 0
    while at < len(order) and highest[order[at]] >= best.least():
        batch = [order[at]]  # a large group is a batch of its own, small ones share one
        at += 1
        size = starts[batch[0] + 1] - starts[batch[0]]
        while at < len(order) and highest[order[at]] >= best.least():
            size += starts[order[at] + 1] - starts[order[at]]
            if size > BATCH:
                break
            batch.append(order[at])
            at += 1
        rows = np.concatenate([by_group[starts[g]:starts[g + 1]] for g in batch])
        score = (worth[:, None] * saturated(tf[:, rows], m[docs[rows]])).sum(axis=0)
        scored += len(rows)
        enter = np.flatnonzero(score >= best.least())
        if len(enter) > 4 * best.k:  # equal scores go by id, so all at the k-th score stay
            cut = np.partition(score[enter], -best.k)[-best.k]
            enter = enter[score[enter] >= cut]
        best.add([(int(score[i]), segment.docs[docs[rows[i]]]) for i in enter])
    return scored


def search_block(index: DataFrame, block: list[tuple], statistics: Statistics, k: int) -> DataFrame:
    """(nth, doc_id, score): each task's best documents for each item of the block, by its place there."""
    held = index.sparkSession.sparkContext.broadcast(([sorted(found.items()) for _, found in block], statistics))

    def rows(batches: Iterator[pa.RecordBatch]):
        wanted, known = held.value
        best = [Best(k) for _ in wanted]
        for segment in segments(batches):
            m = known.length(segment.sizes)
            for own, item in zip(best, wanted):
                search(segment, m, item, known.weight, own)
        for nth, own in enumerate(best):
            for score, doc in own.rows:
                yield nth, doc, score

    return map_rows(index, rows, "nth int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
           segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    Each row of ``docs`` is a document; rows that repeat an id rank one by one. Equal scores go to the smaller
    doc_id, a null one last. A null or empty text has no terms: such a document counts nowhere, and such an
    item has no rows. Rows that repeat an item_id, also a null one, are one item with all their terms. A term
    in all documents can have weight 0; it adds nothing. Other columns are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    index = stored(build_index(docs, id_col, text_col, segment_tokens), "lexical-index")

    def totals(batches: Iterator[pa.RecordBatch]):
        n = total = 0
        for batch in batches:
            for sizes in batch.column(0):
                held = np.frombuffer(sizes.as_py(), "<i8")
                n, total = n + len(held), total + int(held.sum())
        yield n, total

    both = map_rows(index.select("sizes"), totals, "docs long, terms long").agg(
        F.sum("docs"), F.sum("terms")).first()
    out = scratch_path(spark, "lexical-best")
    kind = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    spark.createDataFrame([], schema).write.parquet(out)
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter("text is not null").sort("item", "text")
    for block in blocks(asked, block_bytes):
        wanted = frozenset(t for _, found in block for t in found)
        known = Statistics(both[0] or 0, both[1] or 0, dict.fromkeys(wanted, 0) | document_frequencies(index, wanted))
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)],
                                      T.StructType([T.StructField("nth", T.IntegerType()), T.StructField("item_id", kind)]))
        # As many rows as the block has items, which its bytes bound.
        found = search_block(index, block, known, k).join(F.broadcast(names), "nth")
        found.select("item_id", "doc_id", "score").write.mode("append").parquet(out)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = spark.read.schema(schema).parquet(out).withColumn("rank", F.row_number().over(order))
    return best.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
