import random
import re
from collections import Counter

from chunklens.llm.quality_rules import FEATURES, expression, learn, quality_rules, statistics

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, quality string"


def brute(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    pick = random.Random(1)
    own = [None, "", " \t\n\x0b\f\r", "one", "a b", "a b c", "a a a", "a a a a", "x y z\nx y z\nx y", "é ü ß x\x85y " * 9, "#*$%&|<> a\n\n \nb\n \n", "ab c d a bc d", "f ffoff\nf\n f"]
    own += [" ".join(pick.choice("abcde") for _ in range(pick.randrange(1, 60))) for _ in range(60)]
    own += ["\n".join(pick.choice(["l1 a", "l2 b", "", " "]) for _ in range(30)), "w" * 200_000, "a b c d " * 25_000, " ".join(str(i % 50_021) for i in range(70_000))]
    return own


def test_statistics_match_brute_force(spark):
    own = texts() + texts()[:5]
    docs = spark.createDataFrame([(i if i else None, t, "extra") for i, t in enumerate(own)], SCHEMA)
    found = {r.doc_id or 0: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in statistics(docs).collect()}
    assert found == {i: brute(t) for i, t in enumerate(own)}


def test_rules_are_learned_and_emitted(spark):
    pick = random.Random(2)
    rows = []
    for i in range(600):
        low = int(i % 4 == 0)
        row = dict.fromkeys(FEATURES, 0.0) | {"symbol_share": pick.uniform(0.2, 0.5) if low else pick.uniform(0, 0.1), "words": float(pick.randrange(60, 900))}
        rows.append(row | {"low": low, "fold": i % 3})
    rules = learn(rows)
    assert len(rules) == 1 and rules[0][0][:2] == ("symbol_share", ">=") and 0.1 <= rules[0][0][2] <= 0.2
    assert learn([]) == [] and learn([r for r in rows if r["low"]]) == []
    docs = spark.createDataFrame([(1, "#### #### a", ""), (2, "clean words here", "")], SCHEMA)
    assert [r[0] for r in statistics(docs).select(expression(rules)).collect()] == [1, 0]


def test_held_out_accuracy_and_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    found = quality_rules(docs, labels.where("doc_id % 2 = 0"))
    held = found.join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select((found.rule == 0).cast("int").alias("good"), "quality").collect()
    low, good = [r.good for r in held if r.quality == 0], [r.good for r in held if r.quality == 1]
    assert sum(good) >= 0.97 * len(good) and sum(low) <= 0.45 * len(low)
    empty = quality_rules(docs.limit(0), labels)
    assert empty.count() == 0 and not quality_rules(docs.limit(50), labels.limit(0)).where("rule > 0").count()
    odd = spark.createDataFrame([(None, 0), (1, None)], "doc_id bigint, quality int")
    assert quality_rules(docs.limit(5), odd).count() == 5
