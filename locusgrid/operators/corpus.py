"""Documents and their lines.

A document is one row. The state a line depends on (code fence, heading, quote run, front
matter) is worked out inside that row as arrays of flags, in time linear in the text, and the
lines are exploded afterwards. No line is shuffled to learn its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.genotype import norm_genotype
from .keyed import prefilter, unnest

LINE_FLAGS = ("fenced", "code", "front_matter", "exempt_section", "archive_quote", "heading")


def doc_lines(docs: DataFrame, key: str = "doc") -> DataFrame:
    """``key, lineno, line`` with 1-based line numbers."""
    lines = unnest(_split(docs, key), [key], F.col("_lines"), "line", "_p")
    return lines.select(key, (F.col("_p") + 1).alias("lineno"), "line")


def _split(docs: DataFrame, key: str, keep=()) -> DataFrame:
    """``key``, the ``keep`` columns and ``_lines`` per document."""
    raw = docs.select(key, *keep, T.split_lines(F.col("text")).alias("_raw"))
    return raw.select(key, *keep, T.drop_last_empty(F.col("_raw")).alias("_lines"))


def _positions(lines: Column, test) -> Column:
    """0-based positions of the lines that pass a test."""
    return F.array_compact(F.transform(lines, lambda l, i: F.when(test(l), i)))


def _spread(starts: Column, n: Column, before: Column, per_run) -> Column:
    """One value per line from the positions where runs start: ``before`` up to the first run,
    then the array ``per_run(start, run_no, length)`` for every run."""
    def run(p, j):
        return per_run(p, j, F.coalesce(F.get(starts, j + 1), n) - p)

    head = F.array_repeat(before, F.coalesce(F.get(starts, F.lit(0)), n))
    return F.concat(head, F.flatten(F.transform(starts, run)))


def _toggled(starts: Column, n: Column) -> Column:
    """Fence flags: the fence line itself, and every line after an odd number of fences."""
    def run(p, j, length):
        return F.concat(F.array(F.lit(True)), F.array_repeat(j % 2 == 0, length - 1))

    return _spread(starts, n, F.lit(False), run)


def line_states(docs: DataFrame, flags, key: str = "doc") -> DataFrame:
    """``key, lineno, line`` plus the requested flags of ``LINE_FLAGS``:

    ``fenced``          inside a code fence or on a fence line
    ``code``            the same, counting only fences after the front matter
    ``front_matter``    the leading ``---`` block, to the end of the text if unclosed
    ``exempt_section``  under a glossary or appendix heading (headings in fences count)
    ``archive_quote``   in a run of ``>`` lines that carries the archive marker
    ``heading``         text of the latest heading, empty before the first
    """
    d = _line_flags(docs, flags, key)
    return unnest(d, [key], F.col("_z"), "_z", "_p").select(
        key, (F.col("_p") + 1).alias("lineno"), "_z.line", *[f"_z.{f}" for f in flags]
    )


def _line_flags(docs: DataFrame, flags, key: str, keep=()) -> DataFrame:
    """One row per document: ``key``, the ``keep`` columns and ``_z``, an array of one struct
    per line with its text and flags."""
    unknown = set(flags) - set(LINE_FLAGS)
    if unknown:
        raise ValueError(f"unknown line flags: {sorted(unknown)}")
    lines, n = F.col("_lines"), F.col("_n")
    d = _split(docs, key, keep)
    d = d.withColumn("_n", F.size(lines))
    if {"fenced", "code"} & set(flags):
        d = d.withColumn("_fences", _positions(lines, lambda l: l.rlike(T.FENCE)))
    if {"front_matter", "code"} & set(flags):
        rule = F.transform(F.slice(lines, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda l: T.strip(l) == "---")
        closed = F.array_position(rule, F.lit(True)).cast("int")
        last = F.when(
            T.strip(F.get(lines, F.lit(0))) == "---", F.when(closed > 0, closed).otherwise(n - 1)
        ).otherwise(F.lit(-1))
        d = d.withColumn("_fm", last)
    if {"exempt_section", "heading"} & set(flags):
        d = d.withColumn("_heads", _positions(lines, lambda l: l.rlike(T.HEADING)))
    if "archive_quote" in flags:
        d = d.withColumn("_q", F.transform(lines, lambda l: l.rlike(T.QUOTE)))
        d = d.withColumn("_turns", F.array_compact(F.transform(
            F.col("_q"),
            lambda q, i: F.when((i == 0) | (q != F.get(F.col("_q"), i - 1)), i),
        )))
    made = {}
    for flag in flags:
        if flag == "fenced":
            made[flag] = _toggled(F.col("_fences"), n)
        elif flag == "code":
            d = d.withColumn("_after", F.filter("_fences", lambda p: p > F.col("_fm")))
            made[flag] = _toggled(F.col("_after"), n)
        elif flag == "front_matter":
            made[flag] = F.concat(
                F.array_repeat(F.lit(True), F.col("_fm") + 1),
                F.array_repeat(F.lit(False), n - F.col("_fm") - 1),
            )
        elif flag == "exempt_section":
            made[flag] = _spread(
                F.col("_heads"), n, F.lit(False),
                lambda p, j, length: F.array_repeat(T.section_exempt(F.get(lines, p)), length),
            )
        elif flag == "heading":
            made[flag] = _spread(
                F.col("_heads"), n, F.lit(""),
                lambda p, j, length: F.array_repeat(_heading_text(F.get(lines, p)), length),
            )
        elif flag == "archive_quote":
            marked = lambda p, length: F.exists(
                F.slice(lines, p + 1, length), lambda l: l.contains(K.ARCHIVE_MARKER)
            )
            made[flag] = _spread(
                F.col("_turns"), n, F.lit(False),
                lambda p, j, length: F.array_repeat(F.get(F.col("_q"), p) & marked(p, length), length),
            )
    d = d.select(key, *keep, "_lines", *[c.alias(f) for f, c in made.items()])
    zipped = F.arrays_zip(F.col("_lines").alias("line"), *[F.col(f) for f in made])
    return d.select(key, *keep, zipped.alias("_z"))


def _heading_text(line: Column) -> Column:
    return T.strip(F.ltrim(line, F.lit("#")))


def fence_state(docs: DataFrame, key: str = "doc") -> DataFrame:
    return line_states(docs, ["fenced"], key)


def current_heading(docs: DataFrame, key: str = "doc") -> DataFrame:
    return line_states(docs, ["heading"], key)


def quote_runs(docs: DataFrame, key: str = "doc") -> DataFrame:
    return line_states(docs, ["archive_quote"], key)


def front_matter_span(docs: DataFrame, key: str = "doc") -> DataFrame:
    return line_states(docs, ["front_matter"], key)


def front_matter(text: Column) -> Column:
    """Map of the leading block's ``name: value`` lines, last one wins; empty without the block.
    Built from ``let`` bindings: a filter on the result must not multiply the steps below it."""
    def is_rule(line):
        return T.strip(line) == "---"

    def entry(line):
        return F.struct(
            T.strip(F.substring_index(line, ":", 1)).alias("key"),
            T.strip(F.substr(line, F.locate(":", line) + 1)).alias("value"),
        )

    def as_map(pairs):
        def build(names):
            return F.map_from_arrays(names, F.transform(
                names, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"]
            ))

        return T.let(F.array_distinct(F.transform(pairs, lambda e: e["key"])), build)

    def block(body):
        end = F.array_position(F.transform(body, is_rule), F.lit(True)).cast("int")
        inside = F.when(end > 0, F.slice(body, F.lit(1), end - 1)).otherwise(body)
        return T.let(F.transform(F.filter(inside, lambda l: F.contains(l, F.lit(":"))), entry), as_map)

    def from_lines(lines):
        rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        opened = F.coalesce(is_rule(F.get(lines, F.lit(0))), F.lit(False))
        return T.let(F.when(opened, rest).otherwise(T.no_strings()), block)

    return T.let(T.split_lines(text), lambda raw: T.let(T.drop_last_empty(raw), from_lines))


def front_matter_map(docs: DataFrame, key: str = "doc") -> DataFrame:
    return docs.select(key, front_matter(F.col("text")).alias("front_matter"))


def declared_hash(text: Column) -> Column:
    return F.try_element_at(front_matter(text), F.lit("source_genome_sha256"))


def hash_status(declared: Column, live_hash: str | Column) -> Column:
    """``ok``, ``drift`` or ``undeclared``; ``ok`` as well where there is no live hash to compare with."""
    live = live_hash if isinstance(live_hash, Column) else F.lit(live_hash)
    return (
        F.when(live.isNull(), F.lit("ok")).otherwise(
            F.when(F.coalesce(declared, F.lit("")) == "", F.lit("undeclared"))
            .when(F.lower(declared) == F.lower(live), F.lit("ok"))
            .otherwise(F.lit("drift"))))


def doc_findings(docs: DataFrame, phrases=K.HEDGE_PHRASES, live_hash: str | None = None,
                 key: str = "doc", live_column: str | None = None) -> DataFrame:
    """Everything the corpus checks look for, in one pass over the documents:
    ``key, kind, lineno, value, detail`` with kind ``phrase``, ``narrow``, ``no_summary``,
    ``hash`` (drift or undeclared), ``rsid`` (distinct on live lines) or ``triple``. The live hash is one for all
    documents or stands in a column of theirs."""
    kept = ["text"] if live_column is None else ["text", live_column]
    d = _line_flags(docs, ["fenced", "exempt_section", "archive_quote"], key, kept)

    def found(kind, value, lineno=None, detail=None):
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("kind"),
            (none if lineno is None else lineno).cast("int").alias("lineno"),
            value.alias("value"),
            (none if detail is None else detail).cast("string").alias("detail"),
        )

    def live(z):
        return ~z["archive_quote"] & ~F.contains(z["line"], F.lit(K.ARCHIVE_MARKER))

    blank = F.lit("")
    nothing = F.filter(F.array(found("", blank)), lambda x: F.lit(False))

    def on_line(z, i):
        scan = live(z) & ~z["fenced"]
        hits = F.when(
            scan & ~z["exempt_section"] & T.may_hold_phrase(z["line"], phrases),
            F.transform(T.phrase_matches(z["line"], phrases), lambda t: found("phrase", t, i + 1)),
        ).otherwise(nothing)
        narrow = F.when(scan & T.narrow_hit(z["line"]), F.array(found("narrow", blank, i + 1)))
        return F.concat(hits, F.coalesce(narrow, nothing))

    rsids = F.array_distinct(F.flatten(F.transform(
        F.filter("_z", live), lambda z: T.extract_rsids(z["line"])
    )))
    parts = [
        F.flatten(F.transform("_z", on_line)),
        F.transform(rsids, lambda r: found("rsid", r)),
        F.transform(T.genotype_triples(F.col("text")), lambda t: found("triple", t["rsid"], None, t["genotype"])),
        F.when(F.contains("text", F.lit(K.PROVENANCE_HEADING)), nothing).otherwise(
            F.array(found("no_summary", blank))),
    ]
    live_value = live_hash if live_column is None else F.col(live_column)
    if live_value is not None:
        status = T.let(declared_hash(F.col("text")), lambda h: hash_status(h, live_value))
        parts.append(F.filter(F.array(found("hash", status)), lambda x: x["value"] != "ok"))
    return unnest(d, [key], F.concat(*parts), "_f").select(key, "_f.*")


def first_seen_pool(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Every cited rsID with the place it is first cited: ``rsid, first_doc, first_pos``.
    Pool order is ``(first_doc, first_pos)``; sort by the two where an order is needed."""
    cited = doc_tokens(docs, key).groupBy("rsid").agg(
        F.min(F.struct(F.col(key).alias("d"), F.col("pos").alias("p"))).alias("_m")
    )
    return cited.select("rsid", F.col("_m.d").alias("first_doc"), F.col("_m.p").alias("first_pos"))


def doc_tokens(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Distinct rsIDs per document in first-seen order: ``key, pos, rsid``."""
    return unnest(docs, [key], T.extract_rsids(F.col("text")), "rsid", "pos")


def citing_docs(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Distinct ``rsid, doc`` pairs. One row per pair, so a much-cited id is no large group."""
    return doc_tokens(docs, key).select("rsid", F.col(key).alias("doc"))


def token_counts(docs: DataFrame) -> DataFrame:
    """Whole-word occurrences of every rsID over all documents."""
    return unnest(docs, [], T.all_rsids(F.col("text")), "rsid").groupBy("rsid").agg(
        F.count(F.lit(1)).alias("occurrences")
    )


def literal_counts(docs: DataFrame, ids: DataFrame, column: str = "rsid") -> DataFrame:
    """``column, occurrences`` of ids of any shape that occur between word borders, over all documents.

    A text falls into runs of word characters and runs of others, in turn. A border lies between two
    runs or at an edge beside a word, so an id of ``m`` runs occurs where ``m`` runs in a row spell it.
    Only the numbers of runs that the ids have are tried, and only where a run begins with the first character of an
    id of that many (one row, sent to all tasks). What is no id
    is dropped before anything is shuffled while the ids are small enough to broadcast; else equal
    strings are counted within each task first. Occurrences of an id in itself (``a-a`` in ``a-a-a``)
    count each. Null and empty ids occur nowhere; without ids the documents aren't read.
    """
    keys = ids.select(column).distinct().filter(F.length(column) > 0)
    first = F.collect_set(F.substring(column, 1, 1)).alias("first")
    by_size = keys.groupBy(F.size(T.word_runs(F.col(column))).alias("m")).agg(first)
    shapes = by_size.agg(F.sort_array(F.collect_list(F.struct("m", "first"))).alias("_shapes")).filter(
        F.size("_shapes") > 0).withColumn("_k", F.pmod(F.size("_shapes"), F.lit(1)))
    # A key that is 0 everywhere, but no literal: those would be folded into a nested loop.
    cut = docs.select(T.word_runs(F.col("text")).alias("_runs"), F.pmod(F.length("text"), F.lit(1)).alias("_k")).join(
        F.broadcast(shapes), "_k")
    runs, n = F.col("_runs"), F.size("_runs")

    def spelled(shape):
        m = shape["m"]

        def begins(i):
            return F.array_contains(shape["first"], F.substring(F.get(runs, i), 1, 1))

        def whole(i):  # the edges of the text are borders beside a word only
            return ((i > 0) | F.get(runs, i).rlike(T.WORD_START)) & ((i + m < n) | F.get(runs, i + m - 1).rlike(T.WORD_START))

        places = F.filter(F.sequence(F.lit(0), n - m), lambda i: begins(i) & whole(i))
        return F.when(n >= m, F.transform(places, lambda i: F.array_join(F.slice(runs, i + 1, m), "")))

    grams = F.flatten(F.array_compact(F.transform("_shapes", spelled)))
    found = unnest(cut, [], grams, column)
    return prefilter(found, keys, column).groupBy(column).agg(F.count(F.lit(1)).alias("occurrences")).join(
        keys, column, "left_semi")


def sections(docs: DataFrame, key: str = "doc") -> DataFrame:
    """``key, section_no, heading, body`` split at ``## `` lines; text before the first is left
    out, bodies are trimmed."""
    lines = F.col("_lines")
    d = _split(docs, key)
    d = d.withColumns({
        "_at": _positions(lines, lambda l: l.startswith("## ")),
        "_n": F.size(lines),
    })

    def section(p, j):
        after = F.coalesce(F.get(F.col("_at"), j + 1), F.col("_n"))
        return F.struct(
            T.strip(F.substr(F.get(lines, p), F.lit(4))).alias("heading"),
            T.strip(F.array_join(F.slice(lines, p + 2, after - p - 1), "\n")).alias("body"),
        )

    d = unnest(d, [key], F.transform("_at", section), "_s", "_p")
    return d.select(key, (F.col("_p") + 1).alias("section_no"), "_s.heading", "_s.body")


def project_context(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Per document: body of the first section named like a timeline (empty if none). A section
    name that comes back later keeps its place and takes the later body."""
    s = sections(docs, key)
    named = s.groupBy(key, "heading").agg(
        F.min("section_no").alias("section_no"), F.max_by("body", "section_no").alias("body")
    ).filter(F.lower("heading").contains("timeline"))
    timeline = named.groupBy(key).agg(F.min_by("body", "section_no").alias("timeline"))
    return docs.select(key).join(timeline, key, "left").select(
        key, F.coalesce("timeline", F.lit("")).alias("timeline")
    )


def canonical_docs(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Documents at the top level that are not report artefacts. ``key`` is a relative path."""
    name = F.col(key)
    keep = ~name.contains("/") & name.endswith(".md") & ~name.isin(*K.NON_CANONICAL_NAMES)
    for prefix in K.NON_CANONICAL_PREFIXES:
        keep = keep & ~name.startswith(prefix)
    return docs.filter(keep)


def live_lines(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Lines outside archive quotes and without the archive marker."""
    s = line_states(docs, ["archive_quote"], key)
    return s.filter(~F.col("archive_quote") & ~F.col("line").contains(K.ARCHIVE_MARKER)).drop("archive_quote")


def phrase_hits(docs: DataFrame, phrases=K.HEDGE_PHRASES, key: str = "doc") -> DataFrame:
    """``key, lineno, token``: every phrase match that no exemption covers."""
    s = line_states(docs, ["fenced", "exempt_section", "archive_quote"], key)
    open_line = ~(
        F.col("fenced") | F.col("exempt_section") | F.col("archive_quote")
        | F.col("line").contains(K.ARCHIVE_MARKER)
    )
    s = s.filter(open_line & T.may_hold_phrase(F.col("line"), phrases))
    return unnest(s, [key, "lineno"], T.phrase_matches(F.col("line"), phrases), "token")


def narrow_hits(docs: DataFrame, key: str = "doc") -> DataFrame:
    """``key, lineno`` of narrow phrases outside fences and archive quotes."""
    s = line_states(docs, ["fenced", "archive_quote"], key)
    skip = F.col("fenced") | F.col("archive_quote") | F.col("line").contains(K.ARCHIVE_MARKER)
    return s.filter(~skip & T.narrow_hit(F.col("line"))).select(key, "lineno")


def claim_lines(docs: DataFrame, phrases=K.HEDGE_PHRASES, project_terms=(), key: str = "doc",
                url_roots=tuple(s[2] for s in K.CITATION_SOURCES)) -> DataFrame:
    """Lines that make a claim: outside front matter, fences, blanks and table rules, and with
    an rsID, a lexicon gene, a clinical noun or a phrase hit."""
    line = F.col("line")
    s = line_states(
        docs, ["front_matter", "code", "fenced", "exempt_section", "archive_quote"], key
    )
    s = s.filter(
        ~F.col("front_matter") & ~F.col("code") & ~T.is_blank(line) & ~line.rlike(T.TABLE_RULE)
    )
    exempt = (
        F.col("fenced") | F.col("exempt_section") | F.col("archive_quote")
        | line.contains(K.ARCHIVE_MARKER)
    )
    # A one-row inline: the filter below then reads the matches instead of repeating them.
    s = s.select(key, "lineno", "line", F.inline(F.array(F.struct(
        T.extract_rsids(line).alias("rsids"),
        T.gene_hit(line).alias("gene"),
        T.clinical_hit(line).alias("noun"),
        F.when(exempt, T.no_strings()).otherwise(
            F.sort_array(T.phrase_matches(line, phrases))).alias("tokens"),
    ))))
    clinical = (F.size("rsids") > 0) | F.col("gene") | F.col("noun")
    s = s.filter(clinical | (F.size("tokens") > 0))
    stated = F.array_distinct(F.transform(T.genotype_tokens(line), norm_genotype))
    one = (F.size("rsids") == 1) & (F.size(stated) == 1)
    return s.select(
        key, "lineno", T.strip(line).alias("text"), "rsids", "tokens",
        clinical.alias("clinical"),
        T.has_citation(line, url_roots).alias("has_citation"),
        T.term_hits(line, project_terms).alias("project_terms"),
        F.when(one, F.get(stated, F.lit(0))).alias("stated_genotype"),
    )

