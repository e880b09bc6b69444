"""Personal data: fixed patterns, and boosted trees over further candidates. Expressions only.

Two generators propose spans beside the four fixed kinds, with high recall and free to overlap them:
numbers of seven digits or more with separators, and long words of letters and digits. Trees score a
candidate by its format and the characters before it. They are boosted on the candidates of all
documents, counted by features, with histogram aggregations: the teacher's labels are the fixed patterns and a phone's, card's
or account's name before it for numbers, and an assignment to a credential's name for words. The fixed
patterns' own marks (the plus sign, the checksum) are no features. Held-out candidates outside fixed spans,
which are those that can be added, give each generator the lowest threshold that keeps its precision;
unlabelled ones count against it. What is chosen and overlaps no fixed span is added.

Everything happens inside a document's row: no text is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

# Fixed values (the contract's kinds). Possessive repeats and the look-behinds only spare Java's
# matcher retries that can't succeed: they find the same matches, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("number", "secret")
NUMBER = r"[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+"
WORD = r"(?<![A-Za-z0-9])[A-Za-z0-9]{12,}+"
NAMED = (r"(?<![a-z])(?:(?:tele)?(?:phone|fax)|tel|mobile?|call|card|visa|iban|account|konto)"
         r"(?:\s*(?:number|nummer|no|nr))?\.?\s*[:=#]?\s*\(?$|(?<![a-z])iban\s*[:=#]?\s*[a-z]{2}$")
LEFT = 24
TRAIN_DOCS = 4000
UNIT = 1 << 30
ROUNDS = 12
RATE = 0.5
PRECISION = 0.98
CAP = 40
BLOCK = 64

Lambda = Callable[[Column], Column]


def matches(text: Column, pattern: str, must_hold: str | None = None) -> Column:
    """All matches from left to right: array of (start, end, value, left), in code points; ``left`` are
    the characters before, back to the last match. What lies between the matches gives their places;
    its lengths are summed by blocks, so a text with very many matches stays cheap."""
    nothing = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")
    regex = F.lit(pattern)

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))

        def by_steps(gaps: Column) -> Column:
            steps = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m))
            return let(steps, lambda step: let(block_sums(step), lambda sums: F.transform(
                found, lambda m, i: span(m, gaps[i], before(step, sums, i)))))

        return let(between, by_steps)

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)

    def block_sums(step: Column) -> Column:
        last = F.floor((F.size(step) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(step, b * BLOCK + 1, BLOCK)))

    def before(step: Column, sums: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return total(F.slice(sums, F.lit(1), block)) + total(F.slice(step, block * BLOCK + 1, i % BLOCK))

    def span(m: Column, gap: Column, at: Column) -> Column:
        return let(at + F.length(gap), lambda start: F.struct(
            start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"),
            F.substring(gap, -LEFT, LEFT).alias("left")))

    found = F.regexp_extract_all(text, regex, F.lit(0))
    placed_or_none = let(found, lambda m: F.when(F.size(m) == 0, nothing).otherwise(placed(m)))
    if must_hold:
        placed_or_none = F.when(F.contains(text, F.lit(must_hold)), placed_or_none).otherwise(nothing)
    return placed_or_none


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum: every second digit from the right counts double,
    less 9 over 9."""
    def part(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    each = F.transform(F.sequence(F.lit(0), F.length(number) - 1), part)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_card(value: Column) -> Column:
    n = digits(value)
    return F.when(F.length(n).between(14, 19), luhn(n)).otherwise(False)


def is_ip(value: Column) -> Column:
    # Leading zeros don't count; what is longer than three digits after them is over 255.
    return F.forall(F.split(value, r"\."), lambda p: let(
        F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def is_phone(value: Column) -> Column:
    return F.length(digits(value)).between(10, 15)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": matches(text, EMAIL, "@"),
        "ip": F.filter(matches(text, IP, "."), lambda m: is_ip(m["value"])),
        "card": F.filter(matches(text, CARD), lambda m: is_card(m["value"])),
        "phone": F.filter(matches(text, PHONE, "+"), lambda m: is_phone(m["value"])),
    }


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the arrays ``_email``, ``_ip``, ``_card``, ``_phone`` of matches, and ``_number``
    and ``_secret`` of candidates. A null text has none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    arrays = base_spans(text) | {"number": matches(text, NUMBER), "secret": matches(text, WORD)}
    return docs.withColumns({f"_{k}": v for k, v in arrays.items()})


def format_features(kind: str, c: Column) -> dict[str, Column]:
    """Format and context of a candidate as small numbers."""
    value, left = c["value"], F.lower(c["left"])

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(value, pattern, ""))

    def says(pattern: str) -> Column:
        return left.rlike(pattern).cast("int")

    n = digits(value)
    own = {
        "digits": F.length(n), "letters": count("[^A-Za-z]"), "marks": count("[A-Za-z0-9]"),
        "dots": count(r"[^.]"), "hex": value.rlike("^[0-9a-f]+$").cast("int"),
        "assigned": says(r"[=:]\s*[\"']?$"),
        "credential": says("passw|token|secret|api|key|auth"), "phone_word": says("tel|phone|call|fax|mobil"),
        "card_word": says("card|visa|iban|account|konto"), "kind": F.lit(ADDED_KINDS.index(kind)),
    }
    return {k: F.least(v, F.lit(CAP)).cast("int") for k, v in own.items()}


FEATURES = ("digits", "letters", "marks", "dots", "hex", "assigned", "credential", "phone_word", "card_word", "kind")


def candidates(spanned: DataFrame) -> DataFrame:
    """A row for each candidate: features, the teacher's ``label``, a ``fold`` of five, and whether it is
    ``free``, outside all fixed spans. A word is only a candidate with digits and letters, which spares the rest."""
    def labelled(kind: str, c: Column) -> Column:
        base = [F.exists(f"_{k}", lambda b: (b["start"] - (1 if k == "phone" else 0) <= c["start"])
                         & (b["end"] >= c["end"])) for k in ("ip", "card", "phone")]
        free = reduce(lambda a, b: a & b, [~F.exists(f"_{k}", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
                                           for k in BASE_KINDS])
        teacher = (reduce(lambda a, b: a | b, base) | F.lower(c["left"]).rlike(NAMED) if kind == "number"
                   else F.lower(c["left"]).rlike(r"(?:password|token|secret|key)\s*[=:]\s*[\"']?$"))
        return F.struct(*[v.alias(k) for k, v in format_features(kind, c).items()],
                        teacher.cast("int").alias("label"), (F.xxhash64(c["value"]) % 5).alias("fold"),
                        free.alias("free"))

    both = F.concat(
        F.transform("_number", lambda c: labelled("number", c)),
        F.transform(F.filter("_secret", worth), lambda c: labelled("secret", c)))
    return spanned.select(F.explode(both).alias("c")).select("c.*")


def worth(c: Column) -> Column:
    return c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]")


Split = tuple[str, int]
#: A tree: its splits (of all, of the left side, of the right side; None: none) and its four leaves.
Tree = tuple[Split | None, Split | None, Split | None, tuple[float, float, float, float]]


def tree_value(tree: Tree, feature: Callable[[str], Column]) -> Column:
    def low(split: Split | None) -> Column:
        return F.lit(True) if split is None else feature(split[0]) <= split[1]

    root, left, right, leaves = tree
    a, b, c, d = map(F.lit, leaves)
    return F.when(low(root), F.when(low(left), a).otherwise(b)).otherwise(F.when(low(right), c).otherwise(d))


def margin(trees: list[Tree], feature: Callable[[str], Column]) -> Column:
    return reduce(lambda s, t: s + tree_value(t, feature), trees, F.lit(0.0))


def best_split(rows: list, node: int) -> tuple[Split | None, float, float, float, float]:
    """The split of a node with the highest gain, and (gradient, Hessian) on both sides of it."""
    mine = [r for r in rows if r["node"] == node]
    first = [r for r in mine if r["feature"] == FEATURES[0]]
    g, h = sum(r["g"] for r in first), sum(r["h"] for r in first)
    best, gain = (None, g, h, 0.0, 0.0), 1e-6
    for name in FEATURES:
        left_g = left_h = 0.0
        for r in sorted((r for r in mine if r["feature"] == name), key=lambda r: r["value"]):
            left_g, left_h = left_g + r["g"], left_h + r["h"]
            right_g, right_h = g - left_g, h - left_h
            now = left_g ** 2 / (left_h + 1) + right_g ** 2 / (right_h + 1) - g ** 2 / (h + 1)
            if now > gain and min(left_h, right_h) > 0.5:
                gain, best = now, ((name, r["value"]), left_g, left_h, right_g, right_h)
    return best


def _count(found: DataFrame) -> Column:
    return F.col("n") if "n" in found.columns else F.lit(1)


def boost(sample: DataFrame, rounds: int = ROUNDS) -> list[Tree]:
    """Trees of depth two for the logistic loss. Each level is one aggregation to (node, feature, value),
    at most 2 x features x ``CAP`` rows whatever the sample's size. A column ``n`` says how many candidates a row stands for."""
    trees: list[Tree] = []
    n = _count(sample)

    def histogram(node: Column) -> list:
        p = 1 / (1 + F.exp(-margin(trees, F.col)))
        stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("value")) for k in FEATURES]))
        # Whole numbers of this unit add up to the same sum in any order, so partitions don't decide ties.
        whole = [(F.round(x * UNIT).cast("long") * n).alias(name) for x, name in ((p - F.col("label"), "g"), (p * (1 - p), "h"))]
        return (sample.select(node.alias("node"), *whole, stacked.alias("x")).groupBy("node", "x.feature", "x.value")
                .agg((F.sum("g") / UNIT).alias("g"), (F.sum("h") / UNIT).alias("h")).collect())

    def leaf(g: float, h: float) -> float:
        return -RATE * g / (h + 1)

    for _ in range(rounds):
        root = best_split(histogram(F.lit(0)), 0)[0]
        if root is None:
            break
        rows = histogram(F.when(F.col(root[0]) <= root[1], 0).otherwise(1))
        left, lg1, lh1, lg2, lh2 = best_split(rows, 0)
        right, rg1, rh1, rg2, rh2 = best_split(rows, 1)
        trees.append((root, left, right, (leaf(lg1, lh1), leaf(lg2, lh2), leaf(rg1, rh1), leaf(rg2, rh2))))
    return trees


def thresholds(held_out: DataFrame, trees: list[Tree], precision: float = PRECISION) -> dict[str, float]:
    """For each generator the lowest margin at which held-out candidates keep the precision; infinite
    where none does. The trees have few leaves, so there are few margins."""
    got = (held_out.select("kind", "label", _count(held_out).alias("n"), F.round(margin(trees, F.col), 6).alias("m"))
           .groupBy("kind", "m").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect())
    cuts = {}
    for number, kind in enumerate(ADDED_KINDS):
        n = good = 0
        cuts[kind] = math.inf
        for r in sorted((r for r in got if r["kind"] == number), key=lambda r: -r["m"]):
            n, good = n + r["n"], good + r["good"]
            if good >= precision * n and good:
                cuts[kind] = r["m"] - 1e-6
    return cuts


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(_id, text) of ``train_docs`` documents, the first by a hash of the id; of rows that repeat an id the
    smallest text stands for it. Rows with a null id teach nothing."""
    ids = docs.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct()
    chosen = ids.orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
            .groupBy("_id").agg(F.min("text").alias("text")))


def counted(found: DataFrame) -> DataFrame:
    """``candidates`` with equal features, label, side of the split (``fold`` 0 or 1) and freedom as one row, ``n`` of them."""
    held_out = F.when(F.col("fold") == 0, 0).otherwise(1).alias("fold")
    return found.groupBy(*FEATURES, "label", held_out, "free").agg(F.count(F.lit(1)).alias("n"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train_docs: int | None = None) -> tuple[list[Tree], dict[str, float]]:
    """Trees and thresholds from the candidates of all rows. Equal ones are counted before anything is shuffled, so
    what the rounds of boosting read grows with the kinds of candidates, not with the documents. With ``train_docs``
    only a ``sample`` of that many documents teaches."""
    texts = docs.select(F.col(text_col).alias("text")) if train_docs is None else sample(docs, id_col, text_col, train_docs).select("text")
    found = stored(counted(candidates(with_spans(texts))), "pii-candidates")
    trees = boost(found.filter("fold != 0"))
    return trees, thresholds(found.filter("fold = 0 and free"), trees)


def chosen_spans(spanned: DataFrame, trees: list[Tree], cuts: dict[str, float]) -> DataFrame:
    """``spanned`` with ``_spans``: the fixed spans and the chosen candidates that overlap none of them
    and none that is chosen before, as (start, kind number, end, kind), in that order."""
    def as_span(kind: str, number: int) -> Lambda:
        return lambda c: F.struct(c["start"].alias("start"), F.lit(number).alias("rank"), c["end"].alias("end"),
                                  F.lit(kind).alias("kind"))

    kinds = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
    base = F.concat(*[F.transform(f"_{k}", as_span(k, kinds[k])) for k in BASE_KINDS])

    def good(kind: str) -> Lambda:
        def test(c: Column) -> Column:
            free = ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
            high = free & (margin(trees, format_features(kind, c).__getitem__) >= cuts[kind])
            return worth(c) & high if kind == "secret" else high

        return test

    added = [F.transform(F.filter(f"_{kind}", good(kind)), as_span(kind, kinds[kind]))
             for kind in ADDED_KINDS if trees and not math.isinf(cuts[kind])]
    out = spanned.withColumn("_base", base)
    if not added:
        return out.withColumn("_spans", F.array_sort("_base"))
    if len(added) == 2:  # words may lie in numbers' spans
        added[1] = F.filter(added[1], lambda c: ~F.exists(
            added[0], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return out.withColumn("_spans", F.array_sort(F.concat("_base", *added)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of ``docs``.

    Places are code points, ends exclusive. The counts and the hash are of the fixed kinds; added spans
    have the kinds ``number`` and ``secret``. A null or empty text has no spans. A repeated row is
    repeated, a null doc_id stays null. Other columns are ignored. An empty table gives no rows.
    """
    trees, cuts = learn(docs, id_col, text_col)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = chosen_spans(with_spans(picked), trees, cuts)
    return found.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(written(F.array_sort("_base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, such as ``[EMAIL]``; the columns stay
    and ``length_col`` is the new length. Of overlapping spans the stretch they cover is replaced once,
    by the kind of the first. A null text stays null."""
    trees, cuts = learn(docs, id_col, text_col)
    # The row is carried as one column, so its names can't clash with those used here.
    rows = docs.select(F.col(text_col).alias("text"), F.struct("*").alias("row"))
    found = chosen_spans(with_spans(rows), trees, cuts)
    text = F.col("text")
    none = F.struct(F.lit(0).alias("upto"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["upto"] + 1, F.greatest(s["start"] - acc["upto"], F.lit(0)))
        mark = F.when(s["start"] >= acc["upto"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), F.concat(acc["out"], kept, mark).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["upto"] + 1, F.length(text)))

    changed = F.when(F.size("_spans") > 0, F.aggregate("_spans", none, step, finish)).otherwise(text)
    new = {text_col: F.col("_new")}
    if length_col in docs.columns:
        new[length_col] = F.length("_new").cast(docs.schema[length_col].dataType)
    return found.withColumn("_new", changed).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
