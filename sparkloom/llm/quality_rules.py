"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the
table of vote patterns estimates how often each rule is right on good and on bad documents, and how many are good; no
label is read. A document's posterior probability of quality then follows from its votes, and replaces a filter that
every rule would have to pass. The pattern table has at most 3 ** rules rows, whatever the corpus, and only it reaches
the driver; counts cover all documents.

Repeated five-word windows are found inside each row by sorting their 64-bit hashes, so there is no shuffle. Two
different windows of a text of n words collide with a chance of about n * n / 2 ** 65.

Nulls: a null text has no words and fails the base rule, as does an empty one. All columns of the input pass through;
computed columns that clash with them are named with underscores before, see ``annotate``. Repeated rows are judged
each for itself, alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, table, unused_name, written

WINDOW = 5
#: Base rule: fewer words, or a larger share of words in repeated windows, and a document is not judged further.
LEAST_WORDS, MOST_REPEATED = 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_letters", "n_upper", "n_shouts", "n_distinct", "n_alphabetic")


def _share(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _rule(x: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(c: dict[str, Column]) -> dict[str, Column]:
    """Votes by name, over the counts of a text. Between the two bounds of a rule it abstains."""
    length, symbols = _share(c["word_chars"], c["n_words"]), _share(c["n_symbols"], c["n_words"])
    again, lines = _share(c["n_repeat_words"], c["n_words"]), _share(c["n_dup_lines"], c["n_lines"])
    letters, upper = _share(c["n_letters"], c["word_chars"]), _share(c["n_upper"], c["n_letters"])
    shouts, alphabetic = _share(c["n_shouts"], c["n_words"]), _share(c["n_alphabetic"], c["n_words"])
    distinct = c["n_distinct"] / F.sqrt(F.greatest(c["n_words"], F.lit(1)))  # which hardly depends on the length of a text
    return {
        "word_length": _rule(length, length.between(3, 10), (length < 2) | (length > 14)),
        "symbols": _rule(symbols, symbols < 0.02, symbols > 0.1),
        "repeated_windows": _rule(again, again < 0.05, again > 0.15),
        "repeated_lines": _rule(lines, lines < 0.1, lines > 0.3),
        "letters": _rule(letters, letters > 0.85, letters < 0.7),
        "upper_case": _rule(upper, upper < 0.2, upper > 0.4),
        "shouting": _rule(shouts, shouts < 0.02, shouts > 0.2),
        "vocabulary": _rule(distinct, distinct > 4, distinct < 1),
        "alphabetic": _rule(alphabetic, alphabetic > 0.95, alphabetic < 0.8),
    }


def _pick(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return df.select(*(df[f"`{c}`"] for c in columns), *(e.alias(n) for n, e in new.items()))


def annotate(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """df (its columns keep, or all) with the counts of its texts, and the names that the counts got in it."""
    keep = df.columns if keep is None else keep
    clash = df.select(*(f"`{c}`" for c in keep))
    name = {c: unused_name(clash, c) for c in (*COUNTS, *EXTRA)}
    tmp = {c: unused_name(clash, f"tmp_{c}") for c in ("t", "w", "h", "s")}
    col = lambda x: F.col(f"`{tmp[x]}`")
    chars = lambda pattern: F.length(F.regexp_replace(col("t"), pattern, "")).cast("long")

    trimmed = F.btrim(col("t"), F.lit(" \t\n\x0b\x0c\r"))
    step = _pick(df, keep, **{tmp["t"]: F.coalesce(F.col(f"`{text}`"), F.lit(""))})
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    step = _pick(step, [*keep, tmp["t"]], **{tmp["w"]: words})

    w = col("w")
    window = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    hashes = F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window))
    lines = F.filter(F.split(col("t"), "\n"), lambda x: x.rlike(WORD))
    made = {
        tmp["h"]: hashes,
        "_lines": lines,
        name["n_words"]: F.size(w).cast("long"),
        name["word_chars"]: F.length(F.array_join(w, "")).cast("long"),
        name["n_symbols"]: chars(r"[^#*$%&|<>]+"),
        name["n_letters"]: chars(r"\P{L}+"),
        name["n_upper"]: chars(r"\P{Lu}+"),
        name["n_shouts"]: chars(r"[^!]+"),
        name["n_distinct"]: F.size(F.array_distinct(w)).cast("long"),
        name["n_alphabetic"]: F.length(F.regexp_replace(F.regexp_replace(col("t"), r"\p{L}[^\x20\x09-\x0D]*", "a"), "[^a]+", "")).cast("long"),  # a word from its first letter on, as one letter
    }
    line_name = unused_name(clash, "tmp_lines")
    made[line_name] = made.pop("_lines")
    step = _pick(step, keep, **made)

    done = [*keep, *(name[c] for c in ("n_words", "word_chars", "n_symbols", "n_letters", "n_upper", "n_shouts", "n_distinct", "n_alphabetic"))]
    h, ln = col("h"), F.col(f"`{line_name}`")
    found_twice = F.size(F.array_distinct(h)) < F.size(h)
    ordered = F.when(found_twice, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    step = _pick(step, done, **{tmp["s"]: ordered, name["n_lines"]: F.size(ln).cast("long"), name["n_dup_lines"]: (F.size(ln) - F.size(F.array_distinct(ln))).cast("long")})

    s = col("s")
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    done += [name["n_lines"], name["n_dup_lines"]]
    return _pick(step, done, **{name["n_repeat_words"]: F.when(s.isNull(), F.lit(0).cast("long")).otherwise(covered)}), name


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


@dataclass(frozen=True)
class LabelModel:
    """prior: of quality; right: by rule, how often it votes good on good and bad on bad documents, when it votes."""

    prior: float
    right: dict[str, tuple[float, float]]

    def posterior(self, votes: dict[str, Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, vote in votes.items():
            on_good, on_bad = self.right[rule]
            total = total + F.when(vote == 1, math.log(on_good / (1 - on_bad))).when(vote == -1, math.log((1 - on_good) / on_bad)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200, told: float = 1e-9) -> LabelModel:
    """Two classes, rules independent given the class, abstaining tells nothing. patterns: votes and how many rows have them.

    The start takes a row with a bad vote as bad. The accuracies have a weak prior (as of 20 rows at 0.9 on good and 5 at
    0.6 on bad documents), which names the classes and keeps rules that never vote bad from becoming certain.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return LabelModel(0.5, {r: (0.9, 0.6) for r in names})
    good = [0.1 if -1 in v else 0.9 if 1 in v else 0.5 for v, _ in patterns]
    prior, right, last = 0.5, {}, None
    for _ in range(rounds):
        prior = (1 + sum(g * n for g, (_, n) in zip(good, patterns, strict=True))) / (2 + total)
        for j, rule in enumerate(names):
            hits, seen = [18.0, 3.0], [20.0, 5.0]
            for g, (v, n) in zip(good, patterns, strict=True):
                if v[j]:
                    seen[0] += g * n
                    seen[1] += (1 - g) * n
                    hits[v[j] < 0] += (g if v[j] > 0 else 1 - g) * n
            right[rule] = tuple(min(max(a / b, 1e-6), 1 - 1e-6) for a, b in zip(hits, seen, strict=True))
        likely = 0.0
        for k, (v, n) in enumerate(patterns):
            p, q = math.log(prior), math.log(1 - prior)
            for j, rule in enumerate(names):
                on_good, on_bad = right[rule]
                if v[j] > 0:
                    p, q = p + math.log(on_good), q + math.log(1 - on_bad)
                elif v[j] < 0:
                    p, q = p + math.log(1 - on_good), q + math.log(on_bad)
            top = max(p, q)
            both = math.exp(p - top) + math.exp(q - top)
            good[k] = math.exp(p - top) / both
            likely += n * (top + math.log(both))
        if last is not None and abs(likely - last) <= told * max(1.0, abs(last)):
            break
        last = likely
    return LabelModel(prior, dict(right))


def fit(counted: DataFrame, name: dict[str, str]) -> LabelModel:
    """The label model of all rows that pass the base rule; counted should be a written table, it is read once."""
    c = {k: F.col(f"`{v}`") for k, v in name.items()}
    votes = rules(c)
    rows = counted.where(~base_failed(c)).groupBy(*(v.alias(r) for r, v in votes.items())).count().collect()
    return expectation_maximisation(sorted((tuple(r[x] for x in votes), r["count"]) for r in rows), list(votes))


def judged(counted: DataFrame, name: dict[str, str], model: LabelModel, threshold: float = 0.5) -> tuple[Column, Column, Column]:
    """Columns base_failed, quality (the posterior) and kept over the table that annotate made."""
    c = {k: F.col(f"`{v}`") for k, v in name.items()}
    failed, quality = base_failed(c), model.posterior(rules(c))
    return failed, quality, ~failed & (quality >= threshold)


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that pass the base rule and whose posterior probability reaches the threshold."""
    counted, name = annotate(docs, text)
    counted = written(counted, "quality-counts")
    _, _, kept = judged(counted, name, fit(counted, name), threshold)
    return counted.where(kept).select(*(f"`{c}`" for c in docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, name = annotate(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counted = written(counted, "quality-counts")
    failed, quality, kept = judged(counted, name, fit(counted, name))
    return counted.select("doc_id", *COUNTS, failed.alias("base_failed"), kept.alias("kept"), quality.alias("quality"))
