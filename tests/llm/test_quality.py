import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteflow.llm import quality
from tests.llm.cases import documents, nothing


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {s for s in spans if spans.count(s) > 1}
    covered = {k for i, s in enumerate(spans) if s in twice for k in range(i, i + 8)}
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    worded = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), worded


def test_statistics_match_brute_force(spark):
    rnd = random.Random(1)
    texts = ["", " \n\t", "a", "é한😀 #x\x0b<b>\u2003c\x85d"]
    texts += ["".join(rnd.choice(["a", "b", " ", " ", "\n", "\t", "é", "#", "|", "a b a b "]) for _ in range(rnd.randint(1, 150))) for _ in range(200)]
    for text in texts:
        assert quality.statistics(text.encode()) == plain(text), text
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    got = quality.with_statistics(docs).select("text", "stats.*").collect()
    assert all(tuple(r)[1:] == plain(r.text) for r in got)


def test_estimate_recovers_clean_groups(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((4, 4)) + 2 * np.eye(4)
    clean = rng.standard_normal((3000, 4)) @ mix.T + [5, -3, 0, 2]
    junk = rng.standard_normal((600, 4)) * 0.5 + [60, 40, -50, 30]
    frame = spark.createDataFrame([(1, *map(float, r)) for r in np.vstack([clean, junk])] + [(2, *map(float, r)) for r in clean[:500]] + [(3, 0.0, 0.0, 0.0, 0.0)] * 200, "g long, x0 double, x1 double, x2 double, x3 double")
    found = {r.g: r.e for r in quality.estimate(frame).collect()}
    for g, tolerance in ((1, 0.2), (2, 0.4)):
        covariance = np.zeros((4, 4))
        for (i, j), v in zip(quality.PAIRS, found[g].inverse):
            covariance[i, j] = covariance[j, i] = v
        covariance = np.linalg.inv(covariance)
        assert np.abs(np.array(found[g].centre) - [5, -3, 0, 2]).max() < 0.5
        assert np.abs(covariance - mix @ mix.T - np.eye(4)).max() < tolerance * np.abs(mix @ mix.T).max()
    assert found[3].centre == [0, 0, 0, 0] and abs(found[3].logdet) < 1e-9
    far = frame.join(quality.estimate(frame), "g").withColumn("d", quality.distance([F.col(f"x{i}") for i in range(4)], "e"))
    limit = quality.chi2_point(1e-9, 2)
    assert far.where(F.col("g") == 1).where(F.col("d") > limit).count() == 600


def plain_estimate(x):
    """The estimate of one group by the words of its definition, in numpy."""
    p = x.shape[1]
    quantile = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]
    median = np.array([quantile(c, 0.5) for c in x.T])
    spread = np.array([max(1.0, 1.4826 * quantile(np.abs(c - m), 0.5)) for c, m in zip(x.T, median)])
    z = (x - median) / spread
    size = np.sqrt(np.maximum((z * z).sum(axis=1), 1e-12))[:, None]

    def solve(rows, widen=1.0):
        covariance = widen * np.cov(rows.T, bias=True) + np.eye(p)
        return rows.mean(axis=0), np.linalg.inv(covariance), np.linalg.slogdet(covariance)[1]

    def far(e):
        return np.einsum("ni,ij,nj->n", x - e[0], e[1], x - e[0])

    def step(e, widen=1.0):
        d = far(e)
        return solve(x[d <= quantile(d, quality.COVER)], widen)

    best = None
    for rows in (np.tanh(z), z / size, z[size[:, 0] <= 2]):
        e = (median, *solve(rows * spread)[1:])
        for _ in range(quality.FIRST_STEPS):
            e = step(e)
        best = e if best is None or e[2] < best[2] else best
    while True:
        further = step(best)
        change, best = best[2] - further[2], further
        if change <= quality.STILL:
            break
    best = step(best, quality.COVER / (1 - quality.chi2_tail(quality.chi2_point(1 - quality.COVER, 2), 3)))
    within = quality.chi2_point(0.01, 2)
    return solve(x[far(best) <= within], 0.99 / (1 - quality.chi2_tail(within, 3)))


@pytest.mark.parametrize("few", [True, False])
def test_estimates_equal_plain_ones(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(quality, "FEW", 0)
    rng = np.random.default_rng(8)
    groups = {g: rng.standard_normal((n, 4)) @ (rng.standard_normal((4, 4)) + 2 * np.eye(4)) + g for g, n in ((1, 40), (2, 101), (3, 300))}
    groups[3][:60] += [30, -20, 10, 5]
    frame = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g long, x0 double, x1 double, x2 double, x3 double")
    for row in quality.estimate(frame).collect():
        centre, inverse, logdet = plain_estimate(groups[row.g])
        assert np.allclose(row.e.centre, centre, atol=1e-6) and abs(row.e.logdet - logdet) < 1e-6
        assert np.allclose(row.e.inverse, inverse[tuple(zip(*quality.PAIRS))], atol=1e-6)


def test_small_groups_are_judged_by_larger_ones(spark):
    """A document of a small group has the distance that its language's, or the corpus's, estimate gives it, in a table of any size."""
    def prose(k):
        return " ".join(f"w{(k * j * j + j) % 89}" + ("," if (k + j) % 6 == 0 else "") for j in range(40 + k % 50))

    large = [(k, prose(k), "en", "big") for k in range(150)]
    small = [(200 + k, prose(k + 7), "en", f"tiny{k % 4}") for k in range(12)] + [(300 + k, prose(k + 3), "fr", "x") for k in range(5)]
    probe = [(999, "word " + "### $$$ ||| " * 30 + prose(1), "en", "tiny0"), (998, "### $$$ ||| " * 30 + prose(1), "fr", "x")]
    schema = "doc_id long, text string, lang string, source string"
    for rows in (large + small + probe, large[:60] + small + probe):
        got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}
        assert all(r.distance is not None for r in got.values())
        assert not got[999].kept and not got[998].kept and all(got[i].kept == (not got[i].base_failed) for i in got if i < 998)


def test_chi_square():
    # textbook values of the upper points
    assert abs(quality.chi2_point(0.05, 2) - 9.488) < 1e-3 and abs(quality.chi2_point(0.05, 3) - 12.592) < 1e-3


def test_junk_goes_and_labelled_prose_stays(spark):
    base = "/root/testdata/sf0.1"
    judged = quality.judge(spark.read.parquet(f"{base}/documents.parquet")).where("NOT base_failed")
    rows = judged.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.995 and kept[0] < 0.6


def test_odd_rows(spark):
    docs = documents(spark)
    got = quality.judge(docs).collect()
    assert len(got) == docs.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in got if r.doc_id in (3, 4, 5))
    assert quality.judge(nothing(spark)).collect() == []
    more = [(100 + k, " ".join(f"w{(k * j) % 97}" for j in range(60)), None, None, 1) for k in range(150)]
    kept = quality.passing(documents(spark, more))
    assert kept.columns == docs.columns and kept.where("lang IS NULL").count() > 100
    assert quality.passing(nothing(spark)).count() == 0
