"""Many few-shot episodes against one at a time; merged sketches against the whole table."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowloom.operators import episodes as ep, models, sketches as sk
from flowloom.streaming import replace


@pytest.fixture(scope="module")
def vectors(spark):
    random.seed(11)
    rows = [(k, f"c{min(k % 9, 6)}", [random.gauss(k % 9, 1.5), random.gauss(0, 1)]) for k in range(300)]
    rows += [(900, None, [0.0, 0.0]), (901, "few", [50.0, 0.0]), (902, "few", [51.0, 0.0])]
    return spark.createDataFrame(rows, "id long, label string, v array<double>").cache()


def plain_episode(rows, seed, n_way, k_shot, n_query):
    def key(*parts):
        return hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()

    labels = sorted({r.label for r in rows if r.label is not None}, key=lambda c: (key("class", c), c))[:n_way]
    drawn = {c: sorted((r for r in rows if r.label == c), key=lambda r: (key(r.id), r.id))[: k_shot + n_query] for c in labels}
    return {c: (d[:k_shot], d[k_shot:]) for c, d in drawn.items()}


def test_episodes_are_scored_by_their_own_centroids(vectors):
    rows = vectors.collect()
    drawn = ep.draw_episodes(vectors, "label", ["id"], 6, 4, 3, 5, seed=7).cache()
    scored = {(r.episode, r.id): r for r in ep.score_episodes(drawn, "v", "label", ["id"]).collect()}
    seen, expected, accuracy = set(), 0, {}
    for e in range(6):
        plain = plain_episode(rows, 7 + e, 4, 3, 5)
        seen |= set(plain)
        got = {(r.id, r.role) for r in drawn.where(F.col("episode") == e).collect()}
        assert got == {(r.id, role) for pair in plain.values() for role, part in zip(("support", "query"), pair) for r in part}
        centres = {c: [statistics.fmean(x) for x in zip(*(r.v for r in s))] for c, (s, _) in plain.items()}
        hits = []
        for c, (_, queries) in plain.items():
            for q in queries:
                far, best = min((math.dist(q.v, centre), k) for k, centre in centres.items())
                r = scored[e, q.id]
                assert (r.label, r.pred) == (c, best) and r.score == pytest.approx(-far)
                hits.append(best == c)
                expected += 1
        accuracy[e] = (len(hits), pytest.approx(statistics.fmean(hits)))
    assert len(scored) == expected and len(seen) > 4
    per_episode = ep.episode_accuracy(ep.score_episodes(drawn, "v", "label", ["id"]), "label")
    found = {r.episode: (r.queries, r.accuracy) for r in per_episode.collect()}
    assert found == accuracy
    total = ep.accuracy_over_episodes(per_episode).first()
    values = [a for _, a in found.values()]
    assert (total.episodes, total["mean"]) == (6, pytest.approx(statistics.fmean(values)))
    assert total.half_width == pytest.approx(1.96 * statistics.stdev(values) / math.sqrt(6))


def test_first_episode_is_the_single_one(vectors):
    many = ep.draw_episodes(vectors, "label", ["id"], 2, 5, 3, 4, seed=42).where("episode = 0").select("id", "role")
    one = models.few_shot_episode(vectors, "label", ["id"], 5, 3, 4, seed=42).select("id", "role")
    assert sorted(many.collect()) == sorted(one.collect())


def test_small_classes_and_empty_tables(vectors):
    drawn = ep.draw_episodes(vectors.where("label = 'few' OR label IS NULL"), "label", ["id"], 3, 5, 1, 9)
    assert sorted((r.episode, r.role) for r in drawn.collect()) == [(e, role) for e in range(3) for role in ("query", "support")]
    assert {r.pred for r in ep.score_episodes(drawn, "v", "label", ["id"]).collect()} == {"few"}
    nothing = ep.draw_episodes(vectors.limit(0), "label", ["id"], 3)
    assert ep.score_episodes(nothing, "v", "label", ["id"]).count() == 0
    assert ep.accuracy_over_episodes(ep.episode_accuracy(ep.score_episodes(nothing, "v", "label", ["id"]), "label")).first().episodes == 0
    with pytest.raises(ValueError):
        ep.draw_episodes(vectors, "label", ["id"], 0)


def test_draws_trim_before_the_shuffle(vectors):
    plan = ep.draw_episodes(vectors, "label", ["id"], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


COLUMNS = "SourceFile string, x double, n long, empty double, t string"


def captures(seed):
    random.seed(seed)
    rows = []
    for k in range(6000):
        x = None if k % 10 == 0 else 1e9 + random.gauss(0, 1) * (k % 3 + 1)
        rows.append((f"f{k % 4 * (k % 7 > 0)}.csv", x, k % 1500, None, random.choice(["a", "b", None, f"t{k % 50}"])))
    return rows


def test_merged_sketches_equal_one_pass(spark):
    rows = captures(3)
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    per_file = sk.file_sketches(df, "SourceFile", ["x", "n", "empty"], ["t"])
    assert per_file.count() == 16
    merged = {r["column"]: r for r in sk.merged_profile(per_file, (0.1, 0.5, 0.99)).collect()}
    once = {r["column"]: r for r in sk.merged_profile(sk.file_sketches(df.withColumn("SourceFile", F.lit("all")), "SourceFile", ["x", "n", "empty"], ["t"])).collect()}
    for k, c in enumerate(("x", "n", "empty", "t"), 1):
        values = sorted(r[k] for r in rows if r[k] is not None)
        m = merged[c]
        assert (m["rows"], m["count"], m["missing"]) == (6000, len(values), 6000 - len(values))
        for found in (m, once[c]):  # merged registers are estimated in another way, within the same error
            assert abs(found["distinct"] - len(set(values))) <= sk.DISTINCT_ERROR * len(set(values))
        if c in "xn":
            assert (m["min"], m["max"]) == (values[0], values[-1])
            assert m["mean"] == pytest.approx(statistics.fmean(values), rel=1e-12)
            assert m["std"] == pytest.approx(statistics.stdev(values), rel=1e-6)  # also far from zero
            for p, q in zip((0.1, 0.5, 0.99), m["quantiles"]):
                below, up_to = (sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values))
                assert below - sk.RANK_ERROR <= p <= up_to + sk.RANK_ERROR
        else:
            assert [m[x] for x in ("mean", "std", "min", "max", "quantiles")] == [None] * 5


def test_names_and_empty_input(spark):
    df = spark.createDataFrame([("f", 1.0)], "`the file` string, `a.b` double")
    found = sk.merged_profile(sk.file_sketches(df, "the file", ["a.b"])).first()
    assert (found["column"], found["mean"], found["std"], found["quantiles"]) == ("a.b", 1.0, None, [1.0] * 3)
    assert sk.merged_profile(sk.file_sketches(df.limit(0), "the file", ["a.b"])).collect() == []
    with pytest.raises(ValueError):
        sk.file_sketches(df, "the file")


def test_added_file_is_sketched_alone(spark, tmp_path):
    folder, out, seen = str(tmp_path / "in"), str(tmp_path / "sketches"), []
    rows = spark.createDataFrame(captures(5), COLUMNS).drop("SourceFile", "empty")

    def read(session, paths):
        seen.append(len(paths))
        return session.read.parquet(*paths)

    for part in (rows.where("n < 700").coalesce(2), rows.where("n >= 700").coalesce(1)):
        part.write.mode("append").parquet(folder)
        replace.refresh(spark, folder, out, read, lambda df: sk.file_sketches(df, replace.FILE, ["x", "n"], ["t"]), "*.parquet")
    assert seen == [2, 1]
    merged = {r["column"]: r for r in sk.merged_profile(replace.read_rows(spark, out)).collect()}
    whole = rows.agg(F.count("x"), F.avg("x"), F.stddev_samp("x")).first()
    assert (merged["x"]["count"], merged["n"]["rows"]) == (whole[0], 6000)
    assert (merged["x"]["mean"], merged["x"]["std"]) == (pytest.approx(whole[1], rel=1e-12), pytest.approx(whole[2], rel=1e-6))
