import os
import random

from pyspark.sql import functions as F

from folioscope.functions.sequences import ratio
from folioscope.operators import classify, overlap
from folioscope.storage import settled


def texts(rng, n):
    return [" ".join(f"w{rng.randint(0, 12)}" for _ in range(rng.choice([0, 1, 2, 3, 6, 9, 30, 45]))) for _ in range(n)]


def brute(olds, news, least):
    return {(i, j, ratio(a, b)) for i, a in enumerate(olds) for j, b in enumerate(news) if a and b and ratio(a, b) >= least}


def test_alike_is_every_pair_compared():
    rng = random.Random(5)
    for least in (0.6, 0.35, 1.0):
        for _ in range(5):
            olds, news = texts(rng, 60), texts(rng, 50)
            assert set(overlap.alike(olds, news, least)) == brute(olds, news, least)


def test_hits_are_counted_in_parts(monkeypatch):
    rng = random.Random(6)
    olds, news = texts(rng, 60), texts(rng, 50)
    monkeypatch.setattr(overlap, "HITS", 7)
    assert sorted(overlap.alike(olds, news, 0.6)) == sorted(brute(olds, news, 0.6))


def test_a_shared_word_or_two_is_no_candidate(monkeypatch):
    # Texts as the queries have them: each number stands in many others, few texts share three.
    text = lambda k: f"key{k} grants ${k}99 to account{k} plan{k % 97} part{k % 89} under item{k % 83} list{k % 79} box{k % 73} and expenses"
    full: list[int] = []
    monkeypatch.setattr(overlap, "ratio", lambda a, b: full.append(1) or ratio(a, b))
    found = list(overlap.alike([text(k) for k in range(0, 3000, 2)], [text(k) for k in range(1, 3000, 2)] + [text(0)], 0.6))
    assert (0, 1500, 1.0) in found and len(full) < 100


def test_tiles_find_the_same_moves(spark):
    rng = random.Random(7)
    olds, news = texts(rng, 80), texts(rng, 70)
    gone = spark.createDataFrame([("p", i, a) for i, a in enumerate(olds)] + [("q", 1, "a b c")], "pair_id string, oi int, a string")
    come = spark.createDataFrame([("p", i, a) for i, a in enumerate(news)] + [("q", 2, "a b c")], "pair_id string, ni int, b string")
    want = {("p", i, j) for i, j, _ in brute(olds, news, 0.6)} | {("q", 1, 2)}
    for tile in (50, 1 << 19):
        got = [(r.pair_id, int(r.oi), int(r.ni)) for r in classify.move_candidates(gone, come, tile=tile).collect()]
        got = [x for x in got if x[0] == "q" or olds[x[1]]]
        assert len(got) == len(set(got)) and set(got) == want


def test_settled_drops_what_led_to_it(spark):
    sc = spark.sparkContext
    shuffles = lambda: sc._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = shuffles()
    first = settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    place = first.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(place)
    second = settled(first.groupBy("n").agg(F.count("*").alias("m")), first)
    assert not os.path.exists(place) and second.agg(F.sum("m")).first()[0] == 7
    assert settled(second).count() == 2 and shuffles() <= before + 2
