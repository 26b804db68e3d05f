"""Quality rules: statistics as SQL expressions, and a learned decision list over them.

Sequential covering grows conjunctions of thresholds for the low-quality class on two thirds of a labelled sample,
prunes each on the rest, and emits them as one ordered conditional expression of Spark. The only work outside SQL is
the choice of thresholds on the driver, from at most `sample` collected rows of numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklens.llm.shared import Scratch

#: White space, and the characters that count as symbols.
_SPACE = r" \t\n\u000B\u000C\r"
_SYMBOLS = "#*$%&|<>"

#: Ratios that rules may test, over the statistics' columns; all are finite.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row of docs(doc_id, text, ...); a null or empty text has zeros.

    Words of a text with 3-word windows found twice are counted from the sorted window hashes. In texts of less than
    65 536 words the low 16 bits of each hash give way to its position and neighbours are compared; if any have equal
    high bits and different hashes, and in longer texts, whole hashes are sorted with their positions. The found
    positions, sorted again, give the covered words. Write the result before filtering it: the optimizer would copy
    these expressions into a filter.
    """
    one = docs.select(
        "doc_id",
        F.expr("coalesce(text, '') as text"),
        F.expr(f"trim(BOTH '{_SPACE}' FROM coalesce(text, ''))").alias("inner"),
    )
    two = one.select(
        "doc_id",
        "text",
        F.expr(r"if(inner = '', cast(array() as array<string>), split(inner, '[\\x20\\x09-\\x0D]+')) as words"),
        F.expr(f"filter(split(text, '\\n'), x -> trim(BOTH '{_SPACE}' FROM x) <> '') as lines"),
    )
    three = two.select(
        "doc_id",
        F.expr("cast(size(words) as bigint) as n_words"),
        F.expr(f"cast(length(translate(text, '{_SPACE}', '')) as bigint) as word_chars"),
        F.expr(f"cast(length(text) - length(translate(text, '{_SYMBOLS}', '')) as bigint) as n_symbols"),
        F.expr("cast(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as bigint) as n_upper"),
        F.expr("cast(size(lines) as bigint) as n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines"),
        F.expr("cast(size(array_distinct(words)) as bigint) as n_distinct"),
        F.expr(
            "if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))) as grams"
        ),
    )
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_distinct"]
    four = three.select(*counts, "grams", F.expr("size(array_distinct(grams)) < size(grams) as again"))
    five = four.select(
        *counts,
        "grams",
        "again",
        F.expr("if(again and size(grams) < 65536, sort_array(transform(grams, (h, i) -> shiftleft(shiftright(h, 16), 16) | cast(i as bigint))), cast(array() as array<bigint>)) as keys"),
    )
    near, same = "shiftright(x, 16) = shiftright(keys[{0}], 16)", "grams[cast(x & 65535L as int)] = grams[cast(keys[{0}] & 65535L as int)]"
    before, after = "greatest(i - 1, 0)", "least(i + 1, size(keys) - 1)"
    unlike = f"exists(transform(keys, (x, i) -> {near.format(before)} and not ({same.format(before)})), y -> y)"
    pairs = five.select(
        *counts,
        "grams",
        "keys",
        F.expr(f"if(again and (size(grams) >= 65536 or {unlike}), sort_array(transform(grams, (h, i) -> struct(h, i))), cast(array() as array<struct<h:bigint,i:int>>)) as pairs"),
    )
    whole = "(i > 0 and x.h = pairs[greatest(i - 1, 0)].h) or (i < size(pairs) - 1 and x.h = pairs[least(i + 1, size(pairs) - 1)].h)"
    short = " or ".join(f"({edge} and {near.format(at)} and {same.format(at)})" for edge, at in (("i > 0", before), ("i < size(keys) - 1", after)))
    six = pairs.select(
        *counts,
        F.expr(f"""sort_array(if(size(pairs) > 0, transform(filter(pairs, (x, i) -> {whole}), x -> x.i),
            transform(filter(keys, (x, i) -> {short}), x -> cast(x & 65535L as int)))) as found"""),
    )
    return six.select(*counts, F.expr("cast(aggregate(found, struct(0 as n, -3 as at), (a, x) -> struct(a.n + least(3, x - a.at) as n, x as at)).n as bigint) as n_repeat_words"))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _covers(rule: list[tuple[str, str, float]], row: dict) -> bool:
    return all(row[f] >= cut if side == ">=" else row[f] <= cut for f, side, cut in rule)


def _grow(rows: list[dict], most: int = 4) -> list[tuple[str, str, float]]:
    """Add the threshold of the greatest information gain until no good row is covered, or none gains."""
    rule: list[tuple[str, str, float]] = []
    while len(rule) < most:
        p0 = sum(r["low"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f in FEATURES:
            order = sorted(((r[f], r["low"]) for r in rows))
            p = n = 0
            for i, (value, low) in enumerate(order):
                p, n = p + low, n + 1 - low
                if i + 1 < len(order) and order[i + 1][0] > value:
                    cut = (value + order[i + 1][0]) / 2
                    best = max(best, (_gain(p, n, p0, n0), (f, "<=", cut)), (_gain(p0 - p, n0 - n, p0, n0), (f, ">=", cut)), key=lambda x: x[0])
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if _covers(rule[-1:], r)]
    return rule


def learn(rows: list[dict], precision: float = 0.9, support: int = 3, most: int = 12) -> list[list[tuple[str, str, float]]]:
    """An ordered list of conjunctions for low quality, from rows of FEATURES with low (0 or 1) and fold (0 to 2).

    A rule stays if at least `support` rows of the pruning fold are covered with at least this precision there; its
    last conditions go while (p - n) / (p + n) does not fall. No rows, or rows of one class, give no rules.
    """
    grow, prune, rules = [r for r in rows if r["fold"]], [r for r in rows if not r["fold"]], []
    while len(rules) < most:
        rule = _grow(grow)

        def worth(x: list) -> float:
            own = [r["low"] for r in prune if _covers(x, r)]
            return (2 * sum(own) - len(own)) / len(own) if own else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        own = [r["low"] for r in prune if _covers(rule, r)]
        if not rule or sum(own) < max(1, support) or sum(own) < precision * len(own):
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not _covers(rule, r)], [r for r in prune if not _covers(rule, r)]
    return rules


def expression(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The rules as one conditional over the statistics: the number (from 1) of the first that holds, 0 if none."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = " and ".join(f"({FEATURES[f]}) {side} {cut!r}D" for f, side, cut in rule)
        out = F.when(F.expr(holds), i) if out is None else out.when(F.expr(holds), i)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """(doc_id, statistics, base_failed, rule, kept) of each row of docs(doc_id, text, ...).

    labels(doc_id, quality: 1 good, 0 low, ...); the list is learned from the `sample` labelled ids of the least hash
    (so few at most are sent to the tasks and collected, of rows of one id the least). base_failed: fewer than min_words words, or more than
    repeat_percent percent of them in repeated 3-word windows. rule is the first learned rule that holds, 0 if none;
    kept: neither. Rows with null doc_id or quality are not learned from; an empty labels table gives no rules.
    """
    stats = Scratch(docs.sparkSession, "quality").keep(statistics(docs), "statistics")
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = stats.join(F.broadcast(chosen), "doc_id").select("doc_id", *(F.expr(e).alias(f) for f, e in FEATURES.items()), F.expr("cast(quality = 0 as int) as low"), F.expr("cast(pmod(xxhash64(doc_id, 7), 3) as int) as fold"))
    # One row of each id, the least, however often an id is repeated.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "low", "fold")).alias("x")).select("x.*")
    rules = learn([r.asDict() for r in rows.collect()])
    failed = F.expr(f"n_words < {int(min_words)} or 100 * n_repeat_words > {int(repeat_percent)} * n_words")
    return stats.withColumn("base_failed", failed).withColumn("rule", expression(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
