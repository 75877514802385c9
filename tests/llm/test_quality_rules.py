import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from hopscope.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(grams)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeats), len(lines))


def test_measures_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 30, "é\x0bß\xa0z #|", "l\n" * 5, "\n\n a \n a\na "]
    texts += ["".join(rng.choice(["ab ", "c ", "d\n", "é*", "  ", "\t$"]) for _ in range(rng.randint(0, 150))) for _ in range(120)]
    texts.append(" ".join(f"w{rng.randrange(50)}" for _ in range(30_000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: tuple(r[m] for m in qr.MEASURES) for r in qr.measure(docs).collect()}
    assert got == {k: measures(t) for k, t in enumerate(texts)}


def test_bound_is_the_exact_binomial(spark):
    def allowed(n, risk, delta):
        total, k = 0.0, -1
        for i in range(int(n * risk) + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk))
            k = i if total <= delta else k
        return k

    sizes = [0, 1, 10, 700, 3000, 5000, 20_000, 100_000]
    frame = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = {r.n: r.k for r in frame.select("n", qr._allowed("n", 0.002, "ln(0.01D)").alias("k")).collect()}
    assert got == {n: allowed(n, 0.002, 0.01) for n in sizes}


def test_cutoffs_keep_the_risk(spark):
    rng = random.Random(9)

    def text(bad):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(20, 60))]
        return " ".join(w + "$$" * bad for w in words)

    rows = [(k, text(k % 5 == 0), None if k % 4 == 0 else "en", int(k % 5 != 0)) for k in range(12_000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(k, q) for k, _, _, q in rows if k < 9000] + [(None, 1), (5, None)], "doc_id long, quality int")
    measured = qr.measure(docs).drop("text").checkpoint()
    cutoffs = qr.learn_cutoffs(measured, labels, risk=0.02).checkpoint()
    assert {r.stratum for r in cutoffs.collect()} == {None, "en"}
    kept = {r.doc_id: r.kept for r in qr.judge(measured, cutoffs).collect()}
    held = [(k, q) for k, _, _, q in rows if k >= 9000]
    assert sum(not kept[k] for k, q in held if q) <= 0.02 * sum(q for _, q in held)
    assert sum(not kept[k] for k, q in held if not q) >= 0.9 * sum(not q for _, q in held)


def test_few_labels_reject_nothing_beyond_the_base(spark):
    docs = spark.createDataFrame([(1, "w " * 12, "en"), (1, "a b c d e f g h i j k", None), (None, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    measured = qr.measure(docs).withColumn("kept", F.lit("clash"))
    for some in (labels, labels.limit(0)):
        cutoffs = qr.learn_cutoffs(measured, some)
        assert cutoffs.count() == 0
        assert sorted((r.n_words, r.base_failed, r.kept) for r in qr.judge(measured, cutoffs).collect()) == [(0, True, False), (11, False, True), (12, True, False)]
    assert qr.judge(measured.limit(0), cutoffs).count() == 0
