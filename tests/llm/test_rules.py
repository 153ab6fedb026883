import random
import re

from pyspark.sql import functions as F

from meadowlark.llm import rules
from tests.llm.conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def _check(rows):
    for r in rows:
        n, chars, symbols, dups, repeats = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and not (r["base_failed"] and r["kept"])


def test_counts_equal_brute_force(spark, odd_docs):
    r = random.Random(4)
    line = prose(r, 12)
    made = ["a " * 30, f"{line}\n{line}\n{line}", prose(r, 50) + "\x0b" + prose(r, 9), (prose(r, 8) + " ") * 2, "\U0001f600 #* " * 9, prose(r, 200) + " " + line + " x " + line]
    made += [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(30)]
    docs = spark.createDataFrame([(t,) for t in made], "text string")
    _check(rules.apply_rules(docs).collect())
    _check(rules.apply_rules(odd_docs).collect())
    _check(rules.apply_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.apply_rules(docs).join(labels, "doc_id")
    good = judged.where("quality = 1 and not base_failed")
    assert good.where("kept").count() == good.count()
    bad = judged.where("quality = 0")
    assert bad.where("not kept").count() >= 0.95 * bad.count()


def test_only_native_nodes_and_clashing_names(spark, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kept", F.lit("mine")).withColumn("a.b", F.lit(1))
    out = rules.apply_rules(docs)
    assert dict(out.dtypes)["kept"] == "boolean" and "a.b" in out.columns and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert rules.apply_rules(no_docs).collect() == []
