import numpy as np
from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.operators import model, similarity


def unit_rows(n, dim=8, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, extra=()):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + list(extra), "id bigint, v array<double>")


def test_top_k_equals_brute_force(spark):
    v = unit_rows(300)
    v[10] = v[20] = v[30]  # ties
    rows = frame(spark, v, [(900, None)])
    q = rows.where("id % 100 = 0 or id = 30")
    for block in (64, 2048):
        similarity.BLOCK = block
        got = {(r["qid"], r["rank"]): (r["id"], round(r["sim"], 9)) for r in similarity.top_k(q, rows, 5, drop_self=True).collect()}
        want = {}
        for i in (0, 100, 200, 30):
            s = np.round(v @ v[i], 12)
            order = [j for j in sorted(range(300), key=lambda j: (-s[j], j)) if j != i][:5]
            want |= {(i, k + 1): (j, round(float(s[j]), 9)) for k, j in enumerate(order)}
        assert got == want
    similarity.BLOCK = 2048
    assert similarity.top_k(q.limit(0), rows, 5).count() == 0 and similarity.top_k(q, rows.limit(0), 5).count() == 0


def test_band_pairs(spark):
    df = spark.createDataFrame([(1, "a", -7), (2, "a", 0), (3, "a", 9), (4, "b", 9), (5, "a", 19), (6, "a", None), (7, "a", 9)], "id int, k string, at int")
    got = {(r["id_a"], r["id_b"]) for r in similarity.band_pairs(df, "at", 10, ["k"]).collect()}
    assert got == {(1, 2), (2, 3), (2, 7), (3, 5), (7, 5)}


def test_suppress(spark):
    v = unit_rows(60, 3, 4)
    rows = frame(spark, v).withColumn("g", F.col("id") % 3).withColumn("t", F.col("id") * 10)

    def want(cutoff, cap=None, width=None):
        out = set()
        for g in range(3):
            kept = []
            for i in range(g, 60, 3):
                near = [j for j in kept if width is None or i * 10 - j * 10 <= width]
                if (cap is None or len(kept) < cap) and all(v[i] @ v[j] < cutoff for j in near):
                    kept.append(i)
            out |= set(kept)
        return out

    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(similarity.suppress(rows, ["g"], ["id"], 0.5)) == want(0.5)
    assert ids(similarity.suppress(rows, ["g"], ["id"], 0.5, cap=3)) == want(0.5, cap=3)
    assert ids(similarity.suppress(rows, ["g"], ["id"], 0.5, window=("t", 90))) == want(0.5, width=90)
    assert ids(similarity.suppress(rows.limit(0), ["g"], ["id"], 0.5)) == set()


def test_vector_expressions(spark):
    one = spark.createDataFrame([([1.0, 2.0], ["a", "b"])], "v array<double>, n array<string>")
    r = one.select(vectors.softmax(F.col("v")).alias("s"), vectors.dot(F.col("v"), F.col("v")).alias("d"), vectors.unit(F.col("v")).alias("u"), vectors.top_labels(F.col("n"), vectors.softmax(F.col("v")), 1, 0.5).alias("t"), vectors.bit_distance(F.lit(7), F.lit(0)).alias("b"), vectors.clamp(F.lit(9.0), 0, 5).alias("c")).first()
    e = np.exp([1, 2]) / np.exp([1, 2]).sum()
    assert np.allclose(r["s"], e) and r["d"] == 5 and np.allclose(r["u"], np.array([1, 2]) / 5**0.5) and r["t"][0]["name"] == "b" and r["b"] == 3 and r["c"] == 5


def test_preference_equals_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400)) > 0.7
    rows = spark.createDataFrame([(i, i % 20, [float(z) for z in x[i]], bool(y[i])) for i in range(400)], "id bigint, grp bigint, v array<double>, label boolean")
    fit = model.fit_preference(rows)
    w = np.where(y, 400 / (2 * y.sum()), 400 / (2 * (~y).sum()))
    b = np.zeros(5)
    a = np.hstack([x, np.ones((400, 1))])
    pen = np.diag([1.0, 1, 1, 1, 0]) / (0.5 * w.sum()) * w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        g = a.T @ (w * (p - y)) + pen @ b
        b -= np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + pen, g)
    assert np.allclose([*fit.model.coefficients, fit.model.intercept], b, atol=1e-4)
    held = fit.held_out.collect()
    assert len(held) == 400
    from framelake.operators.scoring import auc

    assert auc(fit.held_out, "p", "label").first()["auc"] > 0.7
    assert fit.score(rows).count() == 400
    assert model.fit_preference(rows.where("id < 20")) is None


def _labelled(spark, groups, seed):
    """Twenty rows of each group, about half of them positive (none where the group's flag is false)."""
    rng = np.random.default_rng(seed)
    return [(20 * k + i, g, [float(z) for z in rng.normal(size=3)], bool(flag and (i % 2 == 0))) for k, (g, flag) in enumerate(groups) for i in range(20)]


def test_every_training_row_is_held_out_once(spark):
    schema = "id bigint, grp bigint, v array<double>, label boolean"
    alike = [r["id"] for r in spark.range(100).where(F.pmod(F.xxhash64("id"), F.lit(5)) == 2).limit(6).collect()]
    rows = spark.createDataFrame(_labelled(spark, [(g, True) for g in alike] + [(1000, False)], 3), schema)
    held = model.fit_preference(rows).held_out.collect()
    assert sorted(r["id"] for r in held) == list(range(120)) and all(0 < r["p"] < 1 for r in held)
    one = model.fit_preference(rows.where(F.col("grp") == alike[0]), least_positives=1, least_groups=1)
    assert [r["p"] for r in one.held_out.collect()] == [None] * 20 and one.score(rows).count() == 140


def test_taste_model_scores_all_vectors(spark, tmp_path):
    from framelake.plans.catalog import QUERIES

    rng = np.random.default_rng(6)
    labels = [0 if i < 40 else i % 10 for i in range(200)]  # ids below 40: four groups of ten without a positive
    spark.createDataFrame([(i, labels[i], [float(z) for z in rng.normal(size=4)]) for i in range(200)], "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["id"]: r for r in QUERIES["taste_model"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(200)) and all(0 < r["score"] < 1 for r in got.values())
    assert all((r["p"] is None) == (i < 40) for i, r in got.items())


def test_search_in_several_passes_and_hot_groups(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", similarity.BLOCK_BYTES)
    v = np.random.default_rng(1).normal(size=(300, 4)).round(2)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else "b", [float(x) for x in v[i]]) for i in range(300)] + [(900, "hot", None)], "id bigint, g string, v array<double>")
    q = rows.where("id % 4 = 0")
    sim = np.round(v @ v.T, 9)
    got = {(r["qid"], r["rank"]): r["id"] for r in similarity.top_k(q, rows, 2, drop_self=True).collect()}
    for i in range(0, 300, 4):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-round(float(v[i] @ v[j]), 12), j))
        assert [got[i, 1], got[i, 2]] == order[:2]
    group = lambda i: "hot" if i % 3 else None if i % 2 else "b"
    for earlier in (False, True):
        want = {}
        for i in range(0, 300, 4):
            can = [j for j in range(300) if group(i) is not None and group(j) == group(i) and (j < i if earlier else j != i)]
            if can:
                want[i] = min(can, key=lambda j: (-sim[i, j], j))
        assert {r["id"]: r["other"] for r in similarity.most_similar(q, rows, ["g"], earlier).collect()} == want
    assert similarity.top_k(q.limit(0), rows, 2).count() == 0 and similarity.most_similar(q, rows.limit(0), ["g"]).count() == 0
