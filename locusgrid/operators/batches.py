"""Work over Arrow batches where an expression would make a row or an array element of each character.

What leaves a task is a table of counts, a few numbers for each text, or a text of the same size; Spark
aggregates and shuffles these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

#: Characters that are counted at once.
CHARACTERS = 1 << 21
#: Cells (cycle, character) that a task holds before it hands its counts on.
CELLS = 1 << 23
#: Characters below this have a dense table; others are counted by sorting.
DENSE = 128


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, one after the other; lengths). A null text has none."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if sizes.sum() == lengths.sum():
        _, offsets, data = texts.buffers()
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        first = np.frombuffer(offsets, wide)[texts.offset] if len(texts) else 0
        return (np.frombuffer(data, np.uint8)[first:first + sizes.sum()] if sizes.sum() else np.zeros(0, np.uint8)), lengths
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


class Counts:
    """Counts by (cycle, code) of the groups of a task."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.held = schema, {}

    def add(self, group, cycles: np.ndarray, codes: np.ndarray, inside: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows that are counted by sorting, or a full table, leave at once."""
        dense = (codes < DENSE) & (cycles < CELLS // DENSE)
        if not dense.all():
            rare = ~dense
            yield from self.sorted(group, cycles[rare], codes[rare], inside[rare])
            cycles, codes, inside = cycles[dense], codes[dense], inside[dense]
        if not len(cycles):
            return
        size = (int(cycles.max()) + 1) * DENSE
        key = cycles * DENSE + codes
        table = self.held.get(group)
        if table is None or table.shape[1] < size:
            grown = np.zeros((2, size), np.int64)
            if table is not None:
                grown[:, :table.shape[1]] = table
            table = self.held[group] = grown
        table[0, :size] += np.bincount(key, minlength=size)
        table[1, :size] += np.bincount(key[inside], minlength=size)
        if sum(t.shape[1] for t in self.held.values()) > CELLS:
            yield from self.flush()

    def sorted(self, group, cycles, codes, inside) -> Iterator[pa.RecordBatch]:
        key, where = np.unique(cycles.astype(np.int64) << 21 | codes.astype(np.int64), return_inverse=True)
        yield self.batch(group, key >> 21, key & 0x1FFFFF, np.bincount(where, minlength=len(key)),
                         np.bincount(where[inside], minlength=len(key)))

    def flush(self) -> Iterator[pa.RecordBatch]:
        for group, table in self.held.items():
            key = np.flatnonzero(table[0])
            yield self.batch(group, key // DENSE, key % DENSE, table[0, key], table[1, key])
        self.held = {}

    def batch(self, group, cycles, codes, n, n_inside) -> pa.RecordBatch:
        numbers = [np.asarray(x) for x in (cycles, codes, n, n_inside)]
        fields = [pa.array([group] * len(cycles), self.schema.field(0).type)]
        fields += [pa.array(x).cast(self.schema.field(i + 1).type) for i, x in enumerate(numbers)]
        return pa.RecordBatch.from_arrays(fields, schema=self.schema)


def character_histogram(df: DataFrame, group: str, text: str, length: str | None = None) -> DataFrame:
    """``group, cycle (0-based), code, n, n_inside``: the characters of ``text`` by place, and those of them before
    the row's ``length``. A task hands on its counts, not its characters; the table has as many rows as there
    are different (group, cycle, code). Null texts have no characters; a null ``length`` has none inside."""
    kind = df.schema[group].dataType
    limit = F.col(length).cast("bigint") if length else F.lit((1 << 62))
    picked = df.select(F.col(group).alias("group"), F.col(text).alias("text"), F.coalesce(limit, F.lit(0).cast("bigint")).alias("limit"))
    schema = pa.schema([("group", to_arrow_type(kind)), ("cycle", pa.int32()), ("code", pa.int32()), ("n", pa.int64()),
                        ("n_inside", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(schema)
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            names, of = groups.dictionary.to_pylist(), groups.indices.to_numpy(zero_copy_only=False)
            of = np.where(np.isnan(of), len(names), of).astype(np.int64) if of.dtype.kind == "f" else of
            names = [*names, None]
            codes, lengths = code_points(batch.column(1))
            limits = batch.column(2).to_numpy()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            for at in range(0, len(codes), CHARACTERS):
                stop = min(len(codes), at + CHARACTERS)
                a, z = np.searchsorted(ends, at, "right"), np.searchsorted(starts, stop, "left")
                held = np.minimum(ends[a:z], stop) - np.maximum(starts[a:z], at)
                row = np.repeat(np.arange(a, z), held)
                cycles = np.arange(at, stop) - starts[row]
                inside, part = cycles < limits[row], codes[at:stop]
                present = np.unique(of[a:z])
                if len(present) == 1:
                    yield from counts.add(names[present[0]], cycles, part, inside)
                    continue
                for g in present:
                    own = of[row] == g
                    yield from counts.add(names[g], cycles[own], part[own], inside[own])
        yield from counts.flush()

    out = picked.mapInArrow(rows, f"group {kind.simpleString()}, cycle int, code int, n bigint, n_inside bigint")
    return out.groupBy(F.col("group").alias(group), "cycle", "code").agg(F.sum("n").alias("n"), F.sum("n_inside").alias("n_inside"))


RANGE = T.StructType([T.StructField("total", T.LongType()), T.StructField("n", T.LongType()),
                      T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])


@F.arrow_udf(RANGE)
def character_range(texts: pa.Array) -> pa.Array:
    """Of each text the sum, number, least and largest of its code points; the last two are null without any."""
    codes, lengths = code_points(texts)
    some = np.flatnonzero(lengths > 0)
    starts = (np.cumsum(lengths) - lengths)[some]
    out = np.zeros((3, len(lengths)), np.int64)
    if len(some):
        out[0, some] = np.add.reduceat(codes, starts, dtype=np.int64)
        out[1, some] = np.minimum.reduceat(codes, starts)
        out[2, some] = np.maximum.reduceat(codes, starts)
    empty = lengths == 0
    ends = [pa.array(x.astype(np.int32), mask=empty) for x in out[1:]]
    return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(lengths), *ends], ["total", "n", "low", "high"])


# --- codons ------------------------------------------------------------------------------

#: Bases by number; any other character is number 4, and a codon with one is unknown.
BASES = "ACGT"
UNKNOWN = "X"


def codon_numbers(table: dict[str, str]) -> np.ndarray:
    """The amino acid, as a byte, of each of 5 x 5 x 5 codons of base numbers."""
    out = np.full(125, ord(UNKNOWN), np.uint8)
    for codon, amino in table.items():
        a, b, c = (BASES.index(x) for x in codon)
        out[25 * a + 5 * b + c] = ord(amino)
    return out


def base_numbers() -> np.ndarray:
    out = np.full(256, 4, np.uint8)
    for i, base in enumerate(BASES):
        out[[ord(base), ord(base.lower())]] = i
    out[[ord("U"), ord("u")]] = BASES.index("T")
    return out


def proteins(codes: np.ndarray, numbers: np.ndarray, aminos: np.ndarray, frames=(0, 1, 2)) -> list[bytes]:
    """The proteins of one strand from each of its first bases, trailing partial codons dropped."""
    base = numbers[codes] if codes.dtype == np.uint8 else numbers[np.where(codes < 256, codes, 255)]
    out = []
    for f in frames:
        n = max(0, len(base) - f) // 3
        part = base[f:f + 3 * n].reshape(n, 3)
        out.append(aminos[25 * part[:, 0] + 5 * part[:, 1] + part[:, 2]].tobytes())
    return out


#: Bytes of strands that are translated at once.
STRANDS = 1 << 20


def strand_slices(strands: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of a batch that hold about ``STRANDS`` bytes, or one row."""
    sizes = sum(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in strands)
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + STRANDS, "right")))
        yield at, stop - at
        at = stop


def frame_rows(df: DataFrame, forward: str, reverse: str, frames, table: dict[str, str]) -> DataFrame:
    """The other columns of ``df`` with ``frame`` and ``protein``, a row for each of ``frames``, from the strands ``forward``
    and ``reverse``; the proteins of a null strand are null. A task hands on the proteins of a stretch of its batch
    before it makes the next, so it never holds those of a whole batch, nor an array of codons."""
    numbers, aminos = base_numbers(), codon_numbers(table)
    frames = [int(f) for f in frames]
    keep = [c for c in df.columns if c not in (forward, reverse)]
    kind = T.StructType([*[df.schema[c] for c in keep], T.StructField("frame", T.IntegerType()), T.StructField("protein", T.StringType())])
    schema = to_arrow_schema(kind)

    def strand(text: str | None, offsets: list[int]) -> list[str | None]:
        if text is None:
            return [None] * len(offsets)
        if not text.isascii():
            text = text.upper()  # may change the number of characters
        return [p.decode("ascii") for p in proteins(code_points(pa.array([text]))[0], numbers, aminos, offsets)]

    sides = [[abs(f) - 1 for f in frames if (f > 0) == up] for up in (True, False)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in strand_slices(batch.columns[-2:]):
                part, found = batch.slice(at, n), []
                for texts in zip(*part.columns[-2:]):
                    made = [iter(strand(x.as_py(), side)) if side else iter(()) for x, side in zip(texts, sides)]
                    found += [next(made[f < 0]) for f in frames]
                each = pa.array(np.repeat(np.arange(n), len(frames)))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(each) for c in part.columns[:-2]], pa.array(frames * n, pa.int32()), pa.array(found, schema.field("protein").type)],
                    schema=schema)

    return df.select(*keep, forward, reverse).mapInArrow(rows, kind)


def frame_chunks(table: dict[str, str], forward: bool):
    """Translates chunks of a sequence. Column function of (bases, start, length of the sequence): an array of
    (frame, protein) with the codons that begin in the chunk; ``bases`` has two more than the chunk where the sequence goes on.
    On the reverse strand a codon counts to the chunk in which it ends, read from the forward strand's start. The chunks of
    a stretch of the batch are translated as one text: codons that run over the end of a chunk are left out."""
    numbers, aminos = base_numbers(), codon_numbers(table)
    kind = T.ArrayType(T.StructType([T.StructField("frame", T.IntegerType()), T.StructField("protein", T.StringType())]))
    turned = np.array([3, 2, 1, 0, 4], np.uint8)

    def codons(base: np.ndarray) -> np.ndarray:
        """The amino acid of the codon at each place but the last two."""
        b = base if forward else turned[base]
        low, mid, high = b[:-2], b[1:-1], b[2:]
        return aminos[25 * low + 5 * mid + high] if forward else aminos[25 * high + 5 * mid + low]

    def stretch(bases: pa.Array, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Frames and proteins of some chunks, three of each."""
        codes, sizes = code_points(bases)
        begin = np.cumsum(sizes) - sizes
        base = numbers[codes if codes.dtype == np.uint8 else np.where(codes < 256, codes, 255)]
        amino = codons(np.concatenate([base, np.full(2, 4, np.uint8)]))
        # A row for each (chunk, first base): its codons stand at every third place.
        first = np.repeat(begin, 3) + np.tile(np.arange(3), len(sizes))
        n = np.maximum(0, np.repeat(sizes, 3) - np.tile(np.arange(3), len(sizes))) // 3
        ends = np.cumsum(n)
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        if not forward:
            step = np.repeat(n, n) - 1 - step
        text = amino[np.repeat(first, n) + 3 * step]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        proteins = pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(text.tobytes()))
        offset = np.tile(np.arange(3), len(sizes))
        start, length = np.repeat(starts, 3), np.repeat(lengths, 3)
        return ((start + offset) % 3 + 1 if forward else -((length - start - offset) % 3 + 1)), proteins

    @F.arrow_udf(kind)
    def translated(bases: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
        frames, proteins = [], []
        begin, whole = starts.to_numpy(zero_copy_only=False), lengths.to_numpy(zero_copy_only=False)
        for at, n in strand_slices([bases]):
            frame, protein = stretch(bases.slice(at, n), begin[at:at + n], whole[at:at + n])
            frames.append(frame)
            proteins.append(protein)
        each = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(frames).astype(np.int32) if frames else np.zeros(0, np.int32)),
             pa.chunked_array(proteins, pa.string()).combine_chunks()], ["frame", "protein"])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(bases) + 1, 3), pa.int32()), each)

    return translated
