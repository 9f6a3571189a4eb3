import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import lines, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "one two", "a b c d e f g h i " * 3, "x " * 40, "line\nline\n \nline", "word " * 7 + "\n" + "# $ % & | < > *", " ".join(f"w{k}" for k in range(500)), "É é x\x0by", " ".join("abcdefgh"[k % 8] for k in range(30)) + " tail of other words here", "ok\r\nok\r\n"]


def brute(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    with_word = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(with_word) - len(set(with_word)), len(covered)


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "r") for k, t in enumerate(TEXTS)], "doc_id long, text string, row string")
    for r in quality.judge(docs).collect():
        want = brute(TEXTS[r["doc_id"]])
        assert tuple(r)[1:6] == want, r
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_order_changes_no_verdict(spark):
    docs = spark.createDataFrame([(k, (t or "") + " plain words of a good text" * 9 + f" {k}" * 2) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    features, rules = quality.base_features(docs), quality.rules()
    verdict = lambda order: sorted((r[0], r[1] is None) for r in features.select("doc_id", quality.cascade(order, rules)).collect())
    assert verdict(list(rules)) == verdict(list(rules)[::-1])
    assert set(quality.order_rules(docs, rules)) == set(rules)


def test_order_is_by_rejections_per_cost(spark):
    good = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(k, good + ("!" if k % 3 == 0 else "")) for k in range(300)], "doc_id long, text string")
    slow = F.exists(F.sequence(F.lit(1), F.lit(20000)), lambda i: F.sqrt(i) < 0) | F.col("text").contains("!")
    named = {"slow": slow, "idle": F.col("n_words") < 0, "quick": F.col("text").contains("!")}
    orders = {tuple(quality.order_rules(docs, named)) for _ in range(4)}
    assert orders == {("quick", "idle", "slow")} or orders == {("quick", "slow", "idle")}
    costs = {r["rule"]: r for r in quality.rule_costs(docs, named).collect()}
    assert costs["slow"]["nanoseconds"] > 10 * costs["quick"]["nanoseconds"]
    assert costs["slow"]["rejected"] == costs["quick"]["rejected"] > 0 == costs["idle"]["rejected"]


def test_keep_good_has_the_rows_as_they_are(spark):
    good = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, good, "k", 5), (1, good, "k", 5), (2, "%%% " * 40, "k", 5), (None, None, None, None)], "doc_id long, text string, kept string, n_words int")
    assert sorted(map(tuple, quality.keep_good(docs).collect())) == [(1, good, "k", 5)] * 2


def test_quality_of_an_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_lines_match_brute_force(spark):
    rows = [(k, f"Common Line \nown {k}\n\nSecond\n" + "é É\n" * (k % 3)) for k in range(12)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "common line\ncommon line"), (103, "common line\ncommon line"), (None, "x\nCOMMON LINE"), (104, "\n".join(["keep"] * 70 + ["second"] + ["keep"] * 70))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, dropped int").drop("dropped")
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    want = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not key(x) or seen[key(x)] < 5]
        want.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    marked = lines.with_dropped(docs, lines.line_bitmaps(docs, min_docs=5))
    got = marked.select("doc_id", F.size(lines.split_lines(F.col("text"))), lines.n_dropped(F.col("dropped")), F.sha2(lines.kept_text(F.col("text"), F.col("dropped")), 256))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_first_occurrence_stays(spark):
    docs = spark.createDataFrame([(2, "a\nb"), (1, "a\nc"), (3, "b\na\na")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.drop_lines(docs, min_docs=2, keep_first=True).collect()}
    assert out == {1: "a\nc", 2: "b", 3: ""}


def test_lines_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lines.drop_lines(docs).collect() == []
