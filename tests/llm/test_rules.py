import math
import re
from collections import Counter

import pytest

from tests.compare import assert_same
from verbascope.llm import rules

WORD = r"[^\x20\x09-\x0D]+"


def test_query(spark, small, oracle):
    assert_same(rules.op3_distribution_rules(spark, small), oracle, rules.ORACLE_SQL)


def test_no_python_in_the_plan(spark, small):
    plan = rules.op3_distribution_rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def base(text):
    words = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


PLAIN = " ".join(f"word{i % 90} and the of" for i in range(400))
TEXTS = [
    None, "", "one", "a b a b a b", "x\ny\nx\n\n \n", "### $$$ |", "a\xa0b c\x1cd", "l\r\nl\r\nl\n", "same " * 60, PLAIN, PLAIN, " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)),
    " ".join(f"k{i}%%%" for i in range(80)), "日本 😀 " * 30 + " ".join(f"v{i}" for i in range(100)), " ".join(f"z{i % 7000}" for i in range(20000)),
]


@pytest.mark.parametrize("limit", [0, 2000])
def test_base_and_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(rules, "BROADCAST_LANGUAGES", limit)
    docs = spark.createDataFrame([(None if i == 2 else i, t, None if i == 9 else "en", "s", True, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, kept boolean, words int")
    rows = {r["doc_id"]: r for r in rules.judged(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[None if i == 2 else i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(t)
        assert not (r["kept"] and r["base_failed"])
    assert rules.judged(docs.limit(0)).collect() == []


def test_distance(spark):
    from pyspark.sql import functions as F

    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
        return math.sqrt((kl(p) + kl(q)) / 2)

    cases = [([1, 2, 3], [3, 2, 1]), ([1, 0], [0, 1]), ([5, 5], [1, 1]), ([0, 4, 9], [7, 0, 1])]
    rows = spark.createDataFrame(cases, "p array<long>, q array<long>")
    got = rows.select(rules.distance(F.col("p"), F.col("q"), rules.total(F.col("p")), rules.total(F.col("q")))).collect()
    assert [r[0] for r in got] == pytest.approx([js(*c) for c in cases], abs=1e-6)
    empty = spark.createDataFrame([([0, 0], [1, 1])], "p array<long>, q array<long>")
    assert empty.select(rules.distance(F.col("p"), F.col("q"), rules.total(F.col("p")), rules.total(F.col("q")))).first()[0] is None


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    rows = rules.op3_distribution_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / max(1, len(bad)) < 0.2


def test_ties_between_common_words(spark):
    """Of thirty words of one frequency the first by code point are common ones; rows of one text are judged alike."""
    from verbascope.llm.common import Shelf

    words = [f"w{i:02}" for i in range(30)]
    text = " ".join(words[::-1] * 10)
    docs = spark.createDataFrame([(i, text, "en", 0) for i in range(10)] + [(99, text, None, 0)], "doc_id long, text string, lang string, common int")
    with Shelf(spark, "t") as shelf:
        rows = {r["of"]: r for r in rules.common_words(docs, shelf).collect()}
    assert [x["word"] for x in rows["en"]["common"]] == words[: rules.COMMON_WORDS] == [x["word"] for x in rows[None]["common"]]
    assert rows["en"]["reference_total"] == 3000 and rows[None]["reference_total"] == 300
    judged = rules.judged(docs).collect()
    assert len({tuple(r)[1:] for r in judged if r["doc_id"] != 99}) == 1


def test_a_language_without_words(spark):
    docs = spark.createDataFrame([(1, "", "xx"), (2, None, "xx"), (3, PLAIN, "en")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in rules.judged(docs).collect()}
    assert len(rows) == 3 and not rows[1]["kept"] and not rows[2]["kept"] and rows[1]["char_distance"] is None
