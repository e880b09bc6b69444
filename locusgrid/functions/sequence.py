"""Expressions over nucleotide sequences and quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def count_of(s: Column, chars: str) -> Column:
    return F.length(s) - F.length(F.translate(s, chars, ""))


def gc_count(seq: Column) -> Column:
    return count_of(seq, "GCgc")


def gc_percent(seq: Column) -> Column:
    """Unrounded; 0 for an empty sequence. Round at the edge with ``fixed_round``."""
    return F.when(F.length(seq) == 0, F.lit(0.0)).otherwise(
        F.lit(100.0) * gc_count(seq) / F.length(seq)
    )


def ambiguous_bases(seq: Column) -> Column:
    return F.length(F.translate(seq, "ACGTUacgtu", ""))


def n_count(seq: Column) -> Column:
    return count_of(seq, "Nn")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTUNacgtun", "TGCAANtgcaan")


def codon_table(table_id: str = "1") -> dict:
    table_id = str(table_id)
    if table_id not in K.CODON_OVERRIDES:
        raise ValueError(f"unknown genetic code {table_id}; known: {sorted(K.CODON_OVERRIDES)}")
    b = K.CODON_BASES
    codons = (x + y + z for x in b for y in b for z in b)
    return {**dict(zip(codons, K.STANDARD_AMINO_ACIDS)), **K.CODON_OVERRIDES[table_id]}


def genetic_code(table_id: str = "1") -> Column:
    """Literal ``map<string,string>`` codon -> amino acid."""
    pairs = [F.lit(x) for kv in sorted(codon_table(table_id).items()) for x in kv]
    return F.create_map(*pairs)


def translate(seq: Column, table_id: str = "1") -> Column:
    """Frame-1 protein: unknown codon ``X``, trailing partial codon dropped."""
    code = genetic_code(table_id)
    # One pass cuts the codons; a substring per codon would rescan the sequence each time.
    codons = F.regexp_extract_all(F.translate(F.upper(seq), "U", "T"), F.lit("(?s).{3}"), F.lit(0))
    aa = F.transform(codons, lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X")))
    return F.array_join(aa, "")


def frame_sequence(seq: Column, frame: int) -> Column:
    """The strand and offset that a reading frame (1..3 or -1..-3) starts from."""
    if frame not in (1, 2, 3, -1, -2, -3):
        raise ValueError("frame must be one of 1, 2, 3, -1, -2, -3")
    strand = seq if frame > 0 else reverse_complement(seq)
    return F.substr(strand, F.lit(abs(frame)))


def translate_frame(seq: Column, frame: int, table_id: str = "1") -> Column:
    return translate(frame_sequence(seq, frame), table_id)


def quality_codes(qual: Column) -> Column:
    """Character codes of a quality string."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c))


def phred_scores(qual: Column, offset: Column) -> Column:
    return F.transform(quality_codes(qual), lambda c: c - offset)


def quality_sum(qual: Column) -> Column:
    return F.aggregate(quality_codes(qual), F.lit(0).cast("bigint"), lambda a, c: a + c)


def phred_offset(min_code: Column, max_code: Column) -> Column:
    """33 or 64 from the observed character range; the overlap counts as 33."""
    return F.when(max_code > 74, F.lit(64)).otherwise(F.lit(33))


def phred_ambiguous(min_code: Column, max_code: Column) -> Column:
    return (max_code <= 74) & (min_code >= 59)


def wrap_fixed(s: Column, width: int = 70) -> Column:
    return F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n")


def aligned_length(cigar: Column) -> Column:
    """Query bases inside the alignment: M, I, = and X operations."""
    return _cigar_sum(cigar, "MI=X")


def reference_span(cigar: Column) -> Column:
    return _cigar_sum(cigar, "MDN=X")


def _cigar_sum(cigar: Column, ops: str) -> Column:
    runs = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, n: a + n.cast("bigint"))


def is_unmapped(flag: Column) -> Column:
    return flag.bitwiseAND(0x4) != 0


def is_duplicate(flag: Column) -> Column:
    return flag.bitwiseAND(0x400) != 0
