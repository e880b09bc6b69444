"""SimHash near-duplicates by a grid over segment bit counts.

A fingerprint of 64 bits is cut into 16 segments of 4 bits. The vector of their bit counts lies on a
grid, and its Manhattan distance to another vector never exceeds the Hamming distance of the two
fingerprints. Two vectors at distance 2 or less have a grid point between them that is at most one
step from either, so each fingerprint enters its own cell and those one step away (33 at most), and
every linked pair meets in a cell. Pairs that meet are verified on the fingerprints themselves.

A cell with more than ``HOT_CELL`` fingerprints isn't expanded into pairs. Its fingerprints are linked
through the 64 values that differ in one bit and themselves: two fingerprints differ in at most two
bits exactly if they share such a value. That is exact and linear, at most 65 rows for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

SEED = 42
BITS = 64
HOT_CELL = 128
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a text; 0 without words.

    Only A-Z are lower-cased and only space and 0x09-0x0D part words, so both work on UTF-8 bytes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = np.fromiter(hashes, np.uint64, count=min(CHUNK, n - at))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, fp) of every row; ``fp`` is the fingerprint as a signed long, ``tie`` a hash of the
    text. A null text has no words."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for doc, text, tie in zip(*batch.columns):
                yield doc.as_py(), tie.as_py(), fingerprint(text.as_py())

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                         F.xxhash64(text_col).alias("tie"))
    return map_rows(picked, rows, "doc_id long, tie long, fp long")


def cell_of(fp) -> F.Column:
    """The bit counts of the 16 segments, each in four bits of a long."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(1, 4)), fp.bitwiseAND(ones))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cells(nodes: DataFrame) -> DataFrame:
    """(cell, fp, off): each fingerprint in its own cell (off 0) and those one step away (off 1)."""
    home = F.col("home")
    entries = [F.struct(home.alias("cell"), F.lit(0).alias("off"))]
    for i in range(16):
        step = F.lit(1 << (4 * i))
        count = F.shiftrightunsigned(home, 4 * i).bitwiseAND(F.lit(15))
        for moved, room in ((home + step, count < 4), (home - step, count > 0)):
            entries.append(F.when(room, F.struct(moved.alias("cell"), F.lit(1).alias("off"))))
    return (nodes.select("fp", cell_of(F.col("fp")).alias("home"))
            .select("fp", F.explode(F.array(*entries)).alias("e"))
            .filter("e is not null").select("e.cell", "fp", "e.off"))


def close(a, b, bits: int = 2) -> F.Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def star_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that join exactly what fingerprints at two bits or less join, without pairs.
    A one-bit neighbour is shared by at most 65 fingerprints, which bounds the lists."""
    fp = F.col("fp")
    near = [fp, *(fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS))]
    shared = (nodes.select("fp", F.explode(F.array(*near)).alias("at"))
              .groupBy("at").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1"))
    return (shared.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
            .filter("u < v"))


def links(nodes: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """Links (u, v), u < v, between different fingerprints; every pair at two bits or less is joined
    by them, directly or through others. ``nodes``: distinct ``fp``, in files."""
    entered = cells(nodes)
    met = stored(entered.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"), "simhash-cells")
    twos = met.filter("n = 2").filter(close(F.col("u"), F.col("v"))).select("u", "v")

    some = stored(entered.join(met.filter(f"n > 2 and n <= {hot_cell}").select("cell"), "cell", "left_semi"),
                  "simhash-members")
    a, b = some.alias("a"), some.alias("b")
    # Fingerprints with equal bit counts share all their cells: they count in their own only.
    once = (F.col("a.off") == 0) | (F.col("b.off") == 0) | (cell_of(F.col("a.fp")) != cell_of(F.col("b.fp")))
    pairs = (a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
                    & close(F.col("a.fp"), F.col("b.fp")) & once)
             .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")))

    hot = (entered.join(met.filter(f"n > {hot_cell}").select("cell"), "cell", "left_semi")
           .select("fp").distinct())
    return stored(twos.unionByName(pairs).unionByName(star_links(hot)).distinct(), "simhash-links")


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): the smallest node of its component.

    Large-star and small-star steps alternate until nothing moves: each links the neighbours of a
    node to the smallest of them, so the number of rounds grows with the logarithm of the size. A
    node's minimum is aggregated before the shuffle, and the join that follows may split hot nodes.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = stored(now, "components")
    before = _summary(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u > v").distinct())
        large = stored(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
        now = stored(small, "components")
        after = _summary(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, fp, root, component_id) for each row of ``docs``; ``root`` is one fingerprint of the
    component, also where no row of it has an id."""
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    known = stored(roots(links(nodes)), "simhash-roots")
    named = known.join(nodes, known.node == nodes.fp).groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = known.join(named, "root").select(F.col("node").alias("fp"), "root", "component_id")
    classes = stored(nodes.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id")), "simhash-classes")
    return rows.join(classes, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    Equal fingerprints are one node; nodes at two bits or less are linked; ``component_id`` is the
    smallest doc_id that links reach. Texts that are null, empty or white space have fingerprint 0.
    A repeated row is repeated in the result. A null doc_id never names a component: a component of
    such rows alone has a null component_id. Other columns are ignored. An empty table gives no rows.
    """
    return classified(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; the columns stay.

    It is the row with the smallest doc_id, a null one after all others; of rows that repeat it in the component,
    the one with the smallest text hash, and of rows that repeat both, the one with the smallest hash of
    the whole row. An id that repeats with texts of several components has a row in each that it names.
    """
    none = F.col("doc_id").isNull().alias("none")
    first = F.min(F.struct(none, F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")).alias("first")
    keep = stored(classified(docs, id_col, text_col).groupBy("root").agg(first).select("first.*"), "simhash-kept")
    # The row is carried as one column, so its names can't clash with those used here.
    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.isNull().alias("none"), F.coalesce(doc, F.lit(0)).alias("id"), F.xxhash64(text_col).alias("tie"),
                       F.xxhash64(*docs.columns).alias("all"), F.struct("*").alias("row"))
    # The group limit of this window works before the shuffle, so repeated rows don't gather in one task.
    order = F.row_number().over(Window.partitionBy("none", "id", "tie").orderBy("all"))
    single = rows.withColumn("nth", order).filter("nth = 1")
    return single.join(keep, ["none", "id", "tie"]).select("row.*")
