import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.functions.significance import incomplete_beta, p_value
from palaver.operators import similarity as sim

ANSWERS = "question_id string, author string, vec_id int, embedding array<float>"
STYLES = "author string, embedding array<float>"


def _data(seed=1, sizes=(2, 1, 40, 7, 23), d=6, e=4, odd=True):
    """Answers and styles; ``odd`` plants NaN, infinity, zero vectors, an unknown author and a null question."""
    rng = np.random.default_rng(seed)
    styles = {f"a{i}": rng.normal(size=e).astype(np.float32) for i in range(30)}
    rows, n = [], 0
    for q, size in enumerate(sizes):
        for _ in range(size):
            rows.append([None if q == 3 else f"q{q}", f"a{rng.integers(30)}", n, rng.normal(size=d).astype(np.float32)])
            n += 1
    if odd:
        rows[4][3][0] = np.nan
        rows[5][3][1] = np.inf
        rows[6][3][:] = 0
        rows[7][1] = "nobody"
        styles["a3"][0] = -np.inf
        styles["a4"][:] = 0
    return rows, styles


def _frames(spark, rows, styles):
    answers = spark.createDataFrame([(q, a, i, v.tolist()) for q, a, i, v in rows], ANSWERS)
    return answers.repartition(3), spark.createDataFrame([(a, v.tolist()) for a, v in styles.items()], STYLES)


def _unit(v):
    v = np.where(np.isnan(v), 0.0, v.astype(np.float64))
    with np.errstate(invalid="ignore"):
        return v / max(np.sqrt((v * v).sum()), 1e-8)


def _brute(rows, styles):
    """question -> (all pairs, finite x, finite y)"""
    out = {}
    known = [r for r in rows if r[1] in styles]
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if a[0] == b[0]:
                with np.errstate(invalid="ignore"):
                    x = float(_unit(a[3]) @ _unit(b[3]))
                    y = float(_unit(styles[a[1]]) @ _unit(styles[b[1]]))
                total, xs, ys = out.setdefault(a[0], [0, [], []])
                out[a[0]][0] += 1
                if math.isfinite(x) and math.isfinite(y):
                    xs.append(x)
                    ys.append(y)
    return out


def _plan(spark, rows, styles, max_pairs=10**9):
    return sim.plan_pairs(*_frames(spark, rows, styles), max_pairs, ("author", "vec_id"))


def _flat(brute, questions=None):
    chosen = [v for q, v in brute.items() if questions is None or q in questions]
    return np.array([x for v in chosen for x in v[1]]), np.array([y for v in chosen for y in v[2]])


@pytest.mark.parametrize("block", [4, 16, 1024])
def test_pair_similarity_against_brute_force(spark, block):
    rows, styles = _data()
    brute = _brute(rows, styles)
    got = {r["question_id"]: r for r in sim.pair_similarity(_plan(spark, rows, styles), block).collect()}
    assert set(got) == {q for q, v in brute.items() if v[1]}
    for q, row in got.items():
        x, y = np.array(brute[q][1]), np.array(brute[q][2])
        assert row["pairs"] == len(x)
        expected = [x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum(), x.min(), x.max(), y.min(), y.max()]
        assert np.allclose([row[c] for c in sim._SUMMARY_FIELDS[1:]], expected, atol=1e-9)
        assert row["max_x"] <= 1 + 1e-9 and row["min_y"] >= -1 - 1e-9


@pytest.mark.parametrize("large,block", [(1024, 1024), (5, 3), (5, 1000), (1, 8)])
def test_sums_need_no_pairs(spark, large, block):
    rows, styles = _data(2)
    x, y = _flat(_brute(rows, styles))
    row = sim.pair_sums(_plan(spark, rows, styles), large, block).first()
    assert row["pairs"] == len(x)
    expected = [x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()]
    assert np.allclose([row[c] for c in sim._SUMS], expected, atol=1e-8)


def test_sums_at_real_widths(spark):
    """Vectors of 1,024 and 768 numbers: questions of one block, of several, and small ones; bands of a stated size."""
    rng = np.random.default_rng(17)
    sizes = {"one block": 1300, "several": 2600, "small": 90}
    rows = [(f"a{i % 700}", q, i, rng.normal(size=1024).astype(np.float32).tolist()) for q, n in sizes.items() for i in range(n)]
    styles = [(f"a{i}", rng.normal(size=768).astype(np.float32).tolist()) for i in range(700)]
    answers = spark.createDataFrame(rows, "author string, question_id string, vec_id int, embedding array<float>").repartition(6)
    plan = sim.plan_pairs(answers.cache(), spark.createDataFrame(styles, "author string, embedding array<float>"), None, ("author", "vec_id"))
    assert sim._width(plan) == 1024
    tiles = sim.pair_sums(plan, large=10**6).first()
    bands = sim.pair_sums(plan, sum_block_rows=1500).first()
    assert bands["pairs"] == tiles["pairs"] == sum(n * (n - 1) // 2 for n in sizes.values())
    assert np.allclose([bands[c] for c in sim._SUMS], [tiles[c] for c in sim._SUMS], rtol=1e-9, atol=1e-6)


def test_no_long_list_leaves_a_task(spark):
    rng = np.random.default_rng(18)
    s, t = rng.normal(size=(50, 40)), rng.normal(size=(50, 30))

    def sent(blocks):
        columns = {"question_id": pa.array([7] * 50), "block": [0] * 50, "blocks": [blocks] * 50, "embedding": s.tolist(), "style": t.tolist()}
        return pa.Table.from_batches(list(sim._outer_sums(100)(iter([pa.RecordBatch.from_pydict(columns)]))))

    sums = sent(3)
    assert max(len(x) for x in sums.column("sums").to_pylist()) <= 100 and sums.num_rows > 40
    assert [len(x) for x in sent(1).column("sums").to_pylist()] == [6] and sums.schema.field("question_id").type == pa.int64()


@pytest.mark.parametrize("large,block", [(1024, 1024), (5, 3)])
def test_question_ids_may_be_numbers_or_null(spark, large, block):
    rows, styles = _data(2)
    named, numbered = _plan(spark, rows, styles), _plan(spark, rows, styles)
    numbered = sim.plan_pairs(named.answers.withColumn("question_id", F.substring("question_id", 2, 9).cast("bigint")), named.styles, None, ("author", "vec_id"))
    assert numbered.id_type() == "bigint"
    a, b = (sim.pair_sums(p, large, block).first() for p in (named, numbered))
    assert a["pairs"] == b["pairs"] and np.allclose(list(a)[1:], list(b)[1:])


def test_a_plan_passes_over_the_pairs_twice(spark, monkeypatch):
    rows, styles = _data(8, sizes=(25, 20))
    plan = _plan(spark, rows, styles)
    passes = []
    tiled = sim._tiled
    monkeypatch.setattr(sim, "_tiled", lambda *a: passes.append(a) or tiled(*a))
    sums = plan.extent()
    sim.similarity_correlation(sums).collect(), sim.confidence_ellipse(sums).collect(), sim.regression_grid(sums).collect()
    histograms, hexagons = sim.pair_density(plan)
    assert len(passes) == 2
    pairs = sums.first()["pairs"]
    assert hexagons.agg(F.sum("n")).first()[0] == pairs and histograms.agg(F.sum("n")).first()[0] == 2 * pairs
    assert hexagons.exceptAll(sim.hexbin_density(plan)).count() == 0 and histograms.exceptAll(sim.marginal_histograms(plan)).count() == 0


def test_counts_without_pairs(spark):
    rows, styles = _data(3)
    brute = _brute(rows, styles)
    sizes = sim.question_sizes(*_frames(spark, rows, styles))
    for r in sizes.where("n >= 2").collect():
        assert r["pairs"] == r["n"] * (r["n"] - 1) // 2 == brute[r["question_id"]][0]
        assert r["finite_pairs"] == len(brute[r["question_id"]][1])
    quality = sim.pair_quality(sizes).first()
    assert quality["n_pairs"] == sum(v[0] for v in brute.values())
    assert quality["n_removed"] == quality["n_pairs"] - len(_flat(brute)[0]) > 0


@pytest.mark.parametrize("budget", [1, 2, 700, 900, 10**9])
def test_budget_keeps_whole_questions(spark, budget):
    rows, styles = _data(4, sizes=(2, 1, 40, 7, 23, 9, 3))
    brute = _brute(rows, styles)
    order = sorted(brute, key=lambda q: (q is not None, q or ""))
    kept, before = [], 0
    for q in order:
        if before >= budget:
            break
        kept.append((q, before))
        before += brute[q][0]
    sizes = sim.question_sizes(*_frames(spark, rows, styles))
    got = sorted(((r["question_id"], r["pairs_before"]) for r in sim.pair_budget(sizes, budget).collect()), key=lambda t: t[1])
    assert got == kept
    row = sim.pair_extent(_plan(spark, rows, styles, budget)).first()
    assert row["pairs"] == len(_flat(brute, {q for q, _ in kept})[0])


@pytest.mark.parametrize("large", [1024, 5])
def test_correlation(spark, large):
    rows, styles = _data(5, sizes=(30, 25, 12, 7))
    x, y = _flat(_brute(rows, styles))
    row = sim.similarity_correlation(sim.pair_sums(_plan(spark, rows, styles), large, 4)).first()
    slope, intercept = np.polyfit(x, y, 1)
    r = np.corrcoef(x, y)[0, 1]
    assert row["n_pairs"] == len(x) and row["sufficient"]
    assert np.allclose([row["r"], row["slope"], row["intercept"], row["r2"]], [r, slope, intercept, r * r], atol=1e-8)
    assert math.isclose(row["p_value"], p_value(r, len(x)), rel_tol=1e-6)


def test_too_few_pairs(spark):
    rows, styles = _data(6, sizes=(5, 4), odd=False)
    row = sim.similarity_correlation(sim.pair_sums(_plan(spark, rows, styles))).first()
    assert row["n_pairs"] == 16 and row["sufficient"] is False
    assert row["r"] is None and row["p_value"] is None and row["slope"] is None
    plan = _plan(spark, rows, styles)
    for few in (99, 17):
        assert sim.confidence_ellipse(sim.pair_sums(plan), min_pairs=few).count() == 0
        assert sim.regression_grid(plan.extent(), min_pairs=few).count() == 0
        assert sim.marginal_histograms(plan, min_pairs=few).count() == 0 and sim.hexbin_density(plan, min_pairs=few).count() == 0
    assert sim.hexbin_density(plan, min_pairs=16).agg(F.sum("n")).first()[0] == 16 and sim.regression_grid(plan.extent(), min_pairs=0).count() == 100


def test_no_pairs_at_all(spark):
    rows, styles = _data(6, sizes=(1, 1), odd=False)
    plan = _plan(spark, rows, styles)
    assert sim.similarity_correlation(sim.pair_sums(plan)).first()["n_pairs"] == 0
    assert sim.marginal_histograms(plan).collect() == [] and sim.hexbin_density(plan).collect() == []
    assert sim.confidence_ellipse(sim.pair_sums(plan)).collect() == []


def test_constant_similarity_gives_null(spark):
    rows, styles = _data(7, sizes=(40,), odd=False)
    for v in styles.values():
        v[:] = 1.0
    row = sim.similarity_correlation(sim.pair_sums(_plan(spark, rows, styles))).first()
    assert row["sufficient"] and row["r"] is None and row["p_value"] is None
    plan = _plan(spark, rows, styles)
    y = [r for r in sim.marginal_histograms(plan).collect() if r["axis"] == "y" and r["n"]]
    assert sum(r["n"] for r in y) == 780 and sum(r["n"] for r in sim.hexbin_density(plan).collect()) == 780


def test_ellipse_and_line(spark):
    rows, styles = _data(8, sizes=(25, 20))
    x, y = _flat(_brute(rows, styles))
    plan = _plan(spark, rows, styles)
    cov = np.cov(x, y)
    r = cov[0, 1] / math.sqrt(cov[0, 0] * cov[1, 1])
    for row, k in zip(sorted(sim.confidence_ellipse(sim.pair_sums(plan)).collect(), key=lambda r: r["n_std"]), (1, 2, 3)):
        expected = [x.mean(), y.mean(), math.sqrt(1 + r), math.sqrt(1 - r), math.sqrt(cov[0, 0]) * k, math.sqrt(cov[1, 1]) * k, 45]
        assert np.allclose(list(row)[1:], expected, atol=1e-8)
    line = sorted(sim.regression_grid(sim.pair_extent(plan)).collect(), key=lambda r: r["k"])
    grid = np.linspace(x.min(), x.max(), 100)
    assert np.allclose([r["x"] for r in line], grid)
    assert np.allclose([r["y_hat"] for r in line], np.polyval(np.polyfit(x, y, 1), grid), atol=1e-8)


@pytest.mark.parametrize("block", [6, 1024])
def test_histograms(spark, block):
    rows, styles = _data(9, sizes=(40, 30))
    x, y = _flat(_brute(rows, styles))
    got = sim.marginal_histograms(_plan(spark, rows, styles), block_rows=block).collect()
    for axis, values in (("x", x), ("y", y)):
        mine = sorted((r for r in got if r["axis"] == axis), key=lambda r: r["bin"])
        counts, edges = np.histogram(values, bins=50)
        assert [r["n"] for r in mine] == counts.tolist()
        assert np.allclose([r["lo"] for r in mine], edges[:-1]) and np.allclose([r["hi"] for r in mine], edges[1:])


@pytest.mark.parametrize("block", [6, 1024])
def test_hexagons(spark, block):
    rows, styles = _data(10, sizes=(40, 30))
    x, y = _flat(_brute(rows, styles))
    got = sim.hexbin_density(_plan(spark, rows, styles), block_rows=block).collect()
    assert sum(r["n"] for r in got) == len(x)
    assert all(r["n"] >= 1 and math.isclose(r["log10_n"], math.log10(r["n"])) for r in got)
    # Each pair belongs to the nearest cell centre of either lattice.
    pad = 1e-9 * (x.max() - x.min())
    sx, sy = (x.max() - x.min() + 2 * pad) / 60, (y.max() - y.min()) / 34
    expected = {}
    for a, b in zip((x - x.min() + pad) / sx, (y - y.min()) / sy):
        whole = (round(a), round(b))
        half = (math.floor(a) + 0.5, math.floor(b) + 0.5)
        cell = min((half, whole), key=lambda c: (a - c[0]) ** 2 + 3 * (b - c[1]) ** 2)
        expected[cell] = expected.get(cell, 0) + 1
    assert {(r["cell_i"], r["cell_j"]): r["n"] for r in got} == expected


def test_duplicate_styles_are_found(spark):
    styles = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("a", [2.0])], STYLES)
    assert [r["author"] for r in sim.duplicate_authors(styles).collect()] == ["a"]


def _tail(t, df, steps=200_000):
    """Two-sided tail of Student's t by the midpoint rule on the angle atan(t / sqrt(df))."""
    start = math.atan(abs(t) / math.sqrt(df))
    h = (math.pi / 2 - start) / steps
    density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    angles = start + (np.arange(steps) + 0.5) * h
    return 2 * density * h * float((np.cos(angles) ** (df - 1)).sum())


@pytest.mark.parametrize("r,n", [(0.1, 100), (0.5, 10), (-0.3, 40), (0.01, 50_000), (0.0, 9), (0.9, 5)])
def test_p_value(r, n):
    t = r * math.sqrt((n - 2) / (1 - r * r))
    assert math.isclose(p_value(r, n), _tail(t, n - 2), rel_tol=2e-6, abs_tol=1e-12)


def test_p_value_limits():
    assert p_value(1.0, 50) == 0.0 and p_value(None, 5) is None and p_value(0.4, 2) is None
    assert p_value(0.0, 2_000_000) == 1.0 and 0 <= p_value(0.2, 2_000_000) < 1e-300
    assert math.isclose(incomplete_beta(2, 3, 0.4), 0.5248, abs_tol=1e-12)


@pytest.mark.parametrize("chunk", [1, 3, 7, 512])
def test_chunks_of_a_tile_cover_each_pair_once(chunk):
    rng = np.random.default_rng(4)
    block = np.array([0, 1, 0, 0, 1, 1, 0, 1, 0])
    vectors = rng.normal(size=(9, 5)).astype(np.float32)
    table = pa.table({"block": block, "embedding": vectors.tolist(), "style": vectors[:, ::-1].tolist()})
    unit = [_unit(v) for v in vectors]
    for key, wanted in (
        (("q", 0, 0), [(i, j) for i in range(9) for j in range(i + 1, 9)]),
        (("q", 0, 1), [(i, j) for i in range(9) for j in range(9) if block[i] == 0 and block[j] == 1]),
    ):
        got = np.concatenate([x for x, _ in sim.tile_cosines(key, table, chunk)])
        assert np.allclose(sorted(got), sorted(unit[i] @ unit[j] for i, j in wanted))


def test_no_pair_is_left_out_by_default(spark):
    from palaver.operators.similarity import MAX_PAIRS, plan_pairs

    ids = spark.range(3 * 1500)
    answers = ids.selectExpr("concat('q', id % 3) as question_id", "concat('a', id) as author", "array(1.0f, float(id)) as embedding")
    styles = ids.selectExpr("concat('a', id) as author", "array(float(id), 1.0f) as embedding")
    plan = plan_pairs(answers, styles)
    assert plan.n_questions == 3 and plan.left_out == {"questions": 0, "pairs": 0}
    assert plan.questions.agg({"pairs": "sum"}).first()[0] == 3 * 1500 * 1499 // 2
    cut = plan_pairs(answers, styles, MAX_PAIRS)
    assert cut.n_questions == 2 and cut.left_out == {"questions": 1, "pairs": 1500 * 1499 // 2}


def test_p_value_of_many_pairs():
    import math

    from palaver.functions.significance import p_value

    for n in (10**7, 10**10, 10**13):
        for z in (0.5, 1.0, 2.0):
            r = z / math.sqrt(n - 2 + z * z)
            density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            wanted = math.erfc(z / math.sqrt(2)) + density * (z**3 + z) / (2 * (n - 2))
            assert abs(p_value(r, n) / wanted - 1) < 1e-9
    assert abs(p_value(0.001, 999_999) / p_value(0.001, 1_000_003) - 1) < 1e-5
