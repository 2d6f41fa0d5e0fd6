"""Quality rules: a decision list learned by sequential covering.

Every document gets statistics of its words and lines.  From the statistics of a bounded sample
of labelled documents an ordered list of rules is learned, each a conjunction of thresholds
("symbols_per_word >= 0.61 and n_words >= 52") that marks documents as bad:

* grow: on two thirds of the sample, thresholds are added to a rule, each the one with the
  highest information gain, until the rule covers no good document or nothing helps;
* prune: on the other third, last conditions are dropped while (bad - good) / (bad + good) of
  what the rule covers does not fall;
* the rule joins the list if on that third it is right often enough, the documents that it
  covers leave both parts, and the next rule is grown, until no rule qualifies.

The list is emitted as a nested Spark conditional expression.  Statistics, rules and verdicts
are DataFrame functions only; the learner handles the sample's numbers on the driver in plain
Python (at most ``Settings.max_train`` rows of seven numbers).

Repeated three-word windows are found within the row by sorting: window hash (44 bits) and
position (20 bits) share a long, so the array sorts as primitives; equal neighbours are compared
again by their whole 64-bit hash.  A text of more than 2**20 words, or one in which the short
hashes clash, takes the same path over (whole hash, position) pairs.

Defined cases: a null text has no words and all counts 0; such documents fail the base rule; ties
between thresholds go to the first feature and lowest threshold; repeated rows are each judged,
and learned from once; without labelled rows the list is empty and only the base rule rejects;
columns besides the named ones are ignored by ``query`` and kept by ``keep``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_ftrl import labelled_sample
from .store import fold

# Fixed values of the base statistics: separators of words, and the symbols counted.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

POS_BITS = 20
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "capitals_per_word", "dup_line_share", "repeat_share", "words_per_line")


@dataclass(frozen=True)
class Settings:
    max_train: int = 6000  # bound of the labelled sample
    min_precision: float = 0.8  # of a rule, on the part that it was not grown on
    min_cover: int = 3


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.value if self.at_least else row[self.feature] < self.value

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.at_least else F.col(self.feature) < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:g}"


Rule = tuple[Condition, ...]


def _covered(starts: Column) -> Column:
    """Number of words in three-word windows with these sorted, distinct starts."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.element_at(starts, -1) + 3))
    gaps = F.zip_with(starts, ends, lambda a, b: F.least(b - a, F.lit(3)))
    return F.when(F.size(starts) > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(0).cast("long")


def _starts(ordered: Column, same, start) -> Column:
    """Sorted starts of the elements that equal a neighbour."""
    n = F.size(ordered) - 1
    a, b = F.slice(ordered, 1, n), F.slice(ordered, 2, n)
    left = F.zip_with(a, b, lambda x, y: F.when(same(x, y), start(x)))
    right = F.zip_with(a, b, lambda x, y: F.when(same(x, y), start(y)))
    return F.sort_array(F.array_compact(F.array_distinct(F.concat(left, right))))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` besides the text, the base counts, and ``FEATURES``."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c != text]
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*kept, t.alias("_t"), F.array_remove(F.split(t, SPACES, -1), "").alias("_w"), lines.alias("_l"))
    windows = F.when(
        F.size("_w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("_capitals"),
        F.size("_l").cast("long").alias("_lines"),
        windows.alias("_h"),
    )
    repeats = F.size("_h") > F.size(F.array_distinct("_h"))
    df = df.withColumn("_repeats", repeats)
    low = (1 << POS_BITS) - 1
    short = F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    df = df.withColumn("_o", F.when(F.col("_repeats") & (F.size("_h") <= low), F.sort_array(short)))

    def near(x: Column, y: Column) -> Column:
        return F.shiftright(x, POS_BITS) == F.shiftright(y, POS_BITS)

    def start(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low))

    def whole(x: Column) -> Column:
        return F.get("_h", start(x).cast("int"))

    n = F.size("_o") - 1
    clash = F.exists(F.zip_with(F.slice("_o", 1, n), F.slice("_o", 2, n), lambda x, y: near(x, y) & (whole(x) != whole(y))), lambda x: x)
    df = df.withColumn("_fast", F.when(F.col("_o").isNotNull(), ~clash).otherwise(False))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    df = df.withColumn("_pairs", F.when(F.col("_repeats") & ~F.col("_fast"), pairs))
    starts = F.when(F.col("_fast"), _starts(F.col("_o"), near, start)).when(F.col("_repeats"), _starts(F.col("_pairs"), lambda x, y: x["h"] == y["h"], lambda x: x["i"]))
    df = df.withColumn("_starts", starts)
    # The condition on the row's number always holds; as it isn't deterministic to the optimizer, no
    # filter above is rewritten into copies of the expressions below.
    covered = F.when(F.col("_repeats"), _covered(F.col("_starts"))).otherwise(F.lit(0).cast("long"))
    df = df.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, covered))
    words, rows = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("_lines"), F.lit(1))
    return df.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("word_chars") / words).alias("chars_per_word"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("_capitals") / words).alias("capitals_per_word"),
        (F.col("n_dup_lines") / rows).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_words") / rows).alias("words_per_line"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(rows: list[dict]) -> Condition | None:
    """The condition with the highest gain, among all cuts between two values of a feature."""
    p0 = sum(r["bad"] for r in rows)
    n0 = len(rows) - p0
    best, out = 1e-9, None
    for f in FEATURES:
        ordered = sorted((r[f], r["bad"]) for r in rows)
        bad = 0
        for i in range(1, len(ordered)):
            value, y = ordered[i - 1]
            bad += y
            if ordered[i][0] == value:
                continue
            for at_least, p, k in ((False, bad, i), (True, p0 - bad, len(ordered) - i)):
                g = _gain(p0, n0, p, k - p)
                if g > best:
                    cut = (ordered[i][0] + value) / 2
                    best, out = g, Condition(f, at_least, cut if cut > value else ordered[i][0])
    return out


def _covers(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _worth(rule: Rule, rows: list[dict]) -> float:
    own = _covers(rule, rows)
    bad = sum(r["bad"] for r in own)
    return (2 * bad - len(own)) / len(own) if own else -1.0


def learn(rows: list[dict], s: Settings = Settings()) -> list[Rule]:
    """Rules for bad rows, in order.  A row holds ``FEATURES``, ``bad`` (0 or 1) and ``part``:
    rules are grown on the rows whose part is not 0 and pruned on the others."""
    grow, check = [r for r in rows if r["part"]], [r for r in rows if not r["part"]]
    rules: list[Rule] = []
    while any(r["bad"] for r in grow):
        rule: Rule = ()
        own = grow
        while any(not r["bad"] for r in own):
            c = _best(own)
            if c is None:
                break
            rule, own = (*rule, c), _covers((c,), own)
        while len(rule) > 1 and _worth(rule[:-1], check) >= _worth(rule, check):
            rule = rule[:-1]
        covered = _covers(rule, check) if rule else []
        if len(covered) < s.min_cover or sum(r["bad"] for r in covered) < s.min_precision * len(covered):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        check = [r for r in check if not all(c.holds(r) for c in rule)]
    return rules


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings()) -> list[Rule]:
    """Rules from the labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    few = statistics(labelled_sample(docs, labels, label, fold(5) != 0, s.max_train))
    got = few.select(*FEATURES, base_failed().alias("failed"), (F.col("label") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part")).collect()
    return learn(sorted((r.asDict() for r in got if not r.failed), key=lambda r: [r[f] for f in (*FEATURES, "bad", "part")]), s)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column()
        for c in rule[1:]:
            holds &= c.column()
        out = F.when(holds, F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` without the text, with the statistics, ``base_failed``, ``rule`` and ``kept``."""
    return (
        statistics(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return statistics(own, "_text").where(~base_failed() & (verdict(rules) == 0)).select("_row.*")


def query(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"), train(docs, labels, s=s))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
