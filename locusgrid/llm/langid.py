"""Language identification by cross-parsing.

For each language a suffix automaton holds labelled text. A document is parsed against it: from left to
right, each phrase is the longest stretch that occurs in the labelled text, found by walking the
automaton until no transition is left. Phrases for each symbol of the document, times log2 of the labelled
symbols, is the cross-entropy estimate of Ziv and Merhav; the language with the lowest one wins. The
factor is that of the largest sample for all, so a language with little labelled text doesn't win by it.

Text is parsed as symbols: lower-cased letters, with one separator for each run of anything else. The
labelled text is a sample of bounded size; each document is parsed as a whole, long ones in stretches of
``STRETCH`` symbols at whose borders phrases end for every language alike. Stretches of many documents
walk the automata of all languages side by side, one symbol a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, stored

#: The labelled sample: so many different texts of a language, so many leading characters of each.
TRAIN_DOCS = 200
TRAIN_CHARS = 200
#: Texts of all languages together; past 100 languages each has fewer, but MIN_DOCS at least. Automata of
#: this many take about 4 GB with full alphabets; four languages in Latin letters take 35 MB.
ALL_DOCS = 20_000
MIN_DOCS = 10
#: Symbols of a stretch, and symbols of all stretches that walk side by side.
STRETCH = 2048
WALK = 1 << 22
#: Characters of a long text that are turned into symbols at once.
PART = 1 << 20
#: Letters that have symbols of their own, by frequency in the sample; all others share one that matches nothing.
LETTERS = 253
UNKNOWN, SEPARATOR, FIRST = 0, 1, 2
UNDETERMINED = "und"


@cache
def lowered() -> np.ndarray:
    """For each code point the lower-case letter it stands for; 0 for what is no letter."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(text: str) -> np.ndarray:
    """Letters of a text, with one 0 for each run of other characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = lowered()[points]
    keep = found > 0
    keep[:1] = True
    keep[1:] |= found[:-1] > 0
    return found[keep]


class Automaton:
    """The suffix automaton of a sequence of symbols: ``next[state]`` maps symbols to states; 0 is the start."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(length)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def steps(self, width: int, base: int) -> np.ndarray:
        """A row of ``width`` entries for each state. An entry is where the symbol leads, as the offset of
        that state's row from ``base`` on; the complement of it if the symbol begins a new phrase."""
        start = np.full(width, ~np.int32(base), np.int32)
        for c, state in self.next[0].items():
            start[c] = ~np.int32(base + state * width)
        table = np.tile(start, (len(self.next), 1))
        for row, moves in zip(table[1:], self.next[1:]):
            for c, state in moves.items():
                row[c] = base + state * width
        return table.ravel()


class Languages:
    """Automata of all languages in one table. ``sample``: (language, texts) pairs, in order."""

    def __init__(self, sample: tuple[tuple[str, tuple[str, ...]], ...]):
        self.names = [name for name, _ in sample]
        held = [np.concatenate([letters(" " + t + " ") for t in texts] or [np.zeros(0, np.int32)]) for _, texts in sample]
        seen, counts = np.unique(np.concatenate(held or [np.zeros(0, np.int32)]), return_counts=True)
        order = np.lexsort((seen, -counts))
        alphabet = [int(c) for c in seen[order] if c][:LETTERS]
        self.symbol = np.zeros(0x110000, np.uint8)
        self.symbol[alphabet] = np.arange(FIRST, FIRST + len(alphabet))
        self.symbol[0] = SEPARATOR
        self.width = FIRST + len(alphabet)
        tables, self.start, base = [], [], 0
        for symbols in held:
            codes = self.symbol[symbols]
            # An unknown letter ends a match in the sample, as it does in a document.
            automaton = Automaton(int(c) if c else -1 - i for i, c in enumerate(codes))
            for moves in automaton.next:
                for c in [c for c in moves if c < 0]:
                    del moves[c]
            tables.append(automaton.steps(self.width, base))
            self.start.append(base)
            base += len(tables[-1])
        self.table = np.concatenate(tables or [np.zeros(0, np.int32)])
        self.bits = float(np.log2(max([2, *map(len, held)])))

    def codes(self, text: str) -> np.ndarray:
        """The symbols of a text. Long ones are taken part by part, as code points are four times as large."""
        parts = [self.symbol[letters(text[k:k + PART])] for k in range(0, len(text), PART)]
        for k in range(1, len(parts)):  # a run of other characters over a border has one separator
            if parts[k - 1].size and parts[k - 1][-1] == parts[k][0] == SEPARATOR:
                parts[k - 1] = parts[k - 1][:-1]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def phrases(self, stretches: list[np.ndarray]) -> np.ndarray:
        """Phrases of each stretch (columns) for each language (rows)."""
        order = sorted(range(len(stretches)), key=lambda i: -len(stretches[i]))
        sizes = np.array([len(stretches[i]) for i in order])
        symbols = np.zeros((len(order), sizes[0] if len(sizes) else 0), np.uint8)
        for row, i in zip(symbols, order):
            row[:len(stretches[i])] = stretches[i]
        symbols = np.ascontiguousarray(symbols.T)
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(order), axis=1)
        counts = np.zeros(state.shape, np.int32)
        lanes = np.searchsorted(-sizes, -np.arange(len(symbols)), side="left")
        for n, row in zip(lanes, symbols):
            step = self.table[state[:, :n] + row[:n]]
            begins = step >> 31
            counts[:, :n] -= begins
            np.bitwise_xor(step, begins, out=state[:, :n])
        out = np.empty_like(counts)
        out[:, order] = counts
        return out


@lru_cache(maxsize=2)
def languages(sample) -> Languages:
    """Built once in a Python worker, from the broadcast sample."""
    return Languages(sample)


def sample_of(docs: DataFrame, learn_from, text_col: str, lang_col: str, train_docs: int = TRAIN_DOCS,
              train_chars: int = TRAIN_CHARS) -> tuple:
    """((language, texts), ...): of each language the ``train_docs`` different texts with the smallest hash
    among the rows that ``learn_from`` allows, languages with more different texts first. Copies count once,
    however many there are; all rows are looked at."""
    h = F.xxhash64("text")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), learn_from.alias("ok"))
    rows = rows.filter("ok and lang is not null and text is not null")
    hashes = stored(rows.select("lang", h.alias("h")).distinct(), "language-hashes")
    sizes = sorted((-r["n"], r["lang"]) for r in hashes.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return ()
    most = max(MIN_DOCS, min(train_docs, ALL_DOCS // len(sizes)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    wanted = hashes.withColumn("nth", nth).filter(F.col("nth") <= most).select("lang", "h")
    cut = F.substring("text", 1, train_chars).alias("text")
    # Aggregated before the shuffle: a task hands on one short text for each chosen hash.
    picked = (rows.select("lang", h.alias("h"), cut).join(wanted, ["lang", "h"])
              .groupBy("lang", "h").agg(F.min("text").alias("text")))
    found: dict[str, list] = {name: [] for _, name in sizes}
    for r in sorted(picked.collect(), key=lambda r: r["h"]):
        found[r["lang"]].append(r["text"])
    return tuple((name, tuple(texts)) for name, texts in found.items())


def held_out(id_col: str):
    """Whether a document's label is kept out of learning: crc32 of the id, as text, modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from=None,
             train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, phrases) for each row of ``docs``.

    ``learn_from`` is the condition of rows whose label may be learnt, by default those that aren't
    ``held_out``. ``score`` is the winner's share when each language weighs 2 to the power of minus its
    estimate in bits. ``phrases`` is the number of phrases for each language.
    A null text and one without a letter are ``und`` with score 0 and null phrases, as is any text when there
    is no labelled text. Equal estimates go to the language with more different labelled texts, then to the
    first by name. A null label teaches nothing; a null doc_id stays null and isn't held out. A repeated row is
    repeated in the result. Other columns are ignored. An empty table gives no rows.
    """
    known = ~held_out(id_col) if learn_from is None else learn_from
    sample = docs.sparkSession.sparkContext.broadcast(sample_of(docs, known, text_col, lang_col, train_docs, train_chars))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]):
        model = languages(sample.value)
        waiting, stretches, size = [], [], 0

        def flush():
            counts = model.phrases(stretches)
            at = 0
            for doc, out, n, pieces in waiting:
                own = counts[:, at:at + pieces].sum(axis=1)
                at += pieces
                if not n or not model.names:
                    yield doc, out, UNDETERMINED, 0.0, None
                    continue
                bits = own * model.bits / n
                best = int(np.argmin(bits))
                yield doc, out, model.names[best], float(1 / np.exp2(bits[best] - bits).sum()), list(zip(model.names, own.tolist()))

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                codes = model.codes(text or "")
                n = len(codes) if (codes != SEPARATOR).any() else 0
                pieces = [codes[k:k + STRETCH] for k in range(0, n, STRETCH)]
                waiting.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), n, len(pieces)))
                stretches += pieces
                size += n
                if size >= WALK or len(waiting) >= 4096:
                    yield from flush()
                    waiting, stretches, size = [], [], 0
        yield from flush()

    return map_rows(picked, rows, "doc_id long, held_out boolean, lang_pred string, score double, phrases map<string,int>")
