"""Semantic against style similarity over all pairs of answers to the same question.

``answers`` holds (question_id, author, embedding), ``styles`` holds (author, embedding).
For every unordered pair of answers, x is the cosine of their embeddings and y the cosine of
their authors' style vectors. Pairs never become rows. Two exact routes lead to the results:

* sums (for the correlation, the fit and the ellipse): a question with more answers than its
  vectors are wide is reduced to sums of outer products, in time linear in its answers. A question of one
  block gives its sums in one task; of larger ones, tasks send on the matrices in bands of rows, of
  a bounded size each, which are added up band by band and reduced to a number each;
* tiles (for extremes, histograms and hexagons): answers are cut into blocks, each pair of
  blocks is one matrix product, and a task sends on only its counts and extremes. A plan makes one pass
  for the extremes and sums, and one more that fills the grids of all layers.

Question ids may be of any type, null counts as a question. Layers of fewer than ``MIN_PAIRS`` pairs are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from palaver.functions.significance import correlation_p_value
from palaver.functions.vectors import PAIR_EPS
from palaver.operators.running import running_total
from palaver.session import small_side, stage

# Pair budget (for callers that want one), least number of pairs, bins and hexagons of the plots.
MAX_PAIRS = 2_000_000
MIN_PAIRS = 100
HISTOGRAM_BINS = 50
HEX_COLUMNS = 60
GRID_POINTS = 100

#: Answers per block; two blocks make a tile.
BLOCK_ROWS = 4096
#: Rows of a tile that are multiplied at once, which bounds the memory of a task.
CHUNK_ROWS = 512
#: Answers per block when only sums of outer products are kept, and numbers of a band of rows of their matrices.
SUM_BLOCK_ROWS = 16_384
BAND_NUMBERS = 1 << 16


# --- which questions ------------------------------------------------------------------------


def _has_infinity(vec: Column) -> Column:
    return F.exists(vec, lambda v: F.abs(v) == F.lit(float("inf")))


def _pair_count(n: Column) -> Column:
    """n(n-1)/2 without forming n(n-1)."""
    return F.when(n % 2 == 0, F.floor(n / 2) * (n - 1)).otherwise(n * F.floor((n - 1) / 2)).cast("bigint")


def question_sizes(answers: DataFrame, styles: DataFrame) -> DataFrame:
    """Per question: answers with a styled author, how many are finite, and pairs of each.

    A vector with an infinite element makes every pair it is in non-finite, so finite pairs
    can be counted without forming them. Vectors are reduced to a flag before the join.
    """
    left = answers.select("question_id", "author", (~_has_infinity(F.col("embedding"))).alias("_a"))
    right = styles.select("author", (~_has_infinity(F.col("embedding"))).alias("_s"))
    return (
        left.join(right, "author")
        .groupBy("question_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_a") & F.col("_s")).alias("n_finite"))
        .select(
            "question_id",
            "n",
            "n_finite",
            _pair_count(F.col("n")).alias("pairs"),
            _pair_count(F.col("n_finite")).alias("finite_pairs"),
        )
    )


def pair_budget(sizes: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Whole questions in id order until their pairs reach ``max_pairs``; the crossing one stays."""
    eligible = sizes.where(F.col("n") >= 2).withColumn("_pairs", F.col("pairs").cast("decimal(20,0)"))
    return (
        running_total(eligible, "question_id", "_pairs")
        .where(F.col("before") < max_pairs)
        .withColumn("pairs_before", F.col("before").cast("bigint"))
        .drop("before", "grand_total", "_pairs")
    )


def pair_quality(sizes: DataFrame) -> DataFrame:
    """Pairs formed, finite pairs, and pairs removed for not being finite."""
    return sizes.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.sum("finite_pairs"), F.lit(0)).alias("n_finite"),
    ).select("*", (F.col("n_pairs") - F.col("n_finite")).alias("n_removed"))


def duplicate_authors(styles: DataFrame) -> DataFrame:
    """Authors with more than one style vector; there must be none."""
    return styles.groupBy("author").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


@dataclass
class PairPlan:
    """The questions that are compared, and the answers and styles they draw on.

    ``left_out`` tells how many questions and pairs a budget has cut off; without one, none.
    """

    answers: DataFrame
    styles: DataFrame
    questions: DataFrame
    n_questions: int
    largest: int
    row_key: tuple[str, ...]
    left_out: dict[str, int] = field(default_factory=lambda: {"questions": 0, "pairs": 0})
    _stored: DataFrame | None = field(default=None, repr=False)
    _extents: dict[int, DataFrame] = field(default_factory=dict, repr=False)

    def rows(self) -> DataFrame:
        """Answers of kept questions with both vectors and the size of their question.

        The budget cuts the answers before their vectors meet the styles.
        """
        kept = small_side(
            self.questions.select(F.col("question_id").alias("_q"), "n", "n_finite"), self.n_questions
        )
        styles = self.styles.select("author", F.col("embedding").alias("style"))
        return (
            self.answers.join(kept, F.col("question_id").eqNullSafe(F.col("_q")))
            .drop("_q")
            .join(styles, "author")
            .select("question_id", "n", "n_finite", *self.row_key, "embedding", "style")
        )

    def stored_rows(self) -> DataFrame:
        """The same, written once for work that passes over them twice."""
        if self._stored is None:
            self._stored = stage(self.rows(), "pair-rows")
        return self._stored

    def extent(self, block_rows: int | None = None) -> DataFrame:
        """:func:`pair_extent`, found by one pass over the pairs and stored, whichever layers ask for it."""
        size = block_rows or BLOCK_ROWS
        if size not in self._extents:
            self._extents[size] = stage(pair_extent(self, size, stored=True), "extent")
        return self._extents[size]

    def id_type(self) -> str:
        return self.answers.schema["question_id"].dataType.simpleString()


def plan_pairs(
    answers: DataFrame, styles: DataFrame, max_pairs: int | None = None, row_key: tuple[str, ...] = ("author",)
) -> PairPlan:
    """Decide from counts which questions are compared: all, unless a budget is named.

    More than one style vector for an author is an error, as it would multiply that author's pairs.

    Both tables are read twice, for counting (no vectors leave the scan) and for comparing, so
    they should be stored ones.

    ``row_key`` names the columns that tell the answers to one question apart.
    """
    repeated = duplicate_authors(styles).limit(1).collect()
    if repeated:
        raise ValueError(f"more than one style vector for author {repeated[0]['author']!r}")
    sizes = stage(question_sizes(answers, styles).where(F.col("n") >= 2), "question-sizes")

    def measure(questions: DataFrame) -> Row:
        pairs = F.sum(F.col("pairs").cast("decimal(20,0)"))
        return questions.agg(
            F.count(F.lit(1)).alias("questions"),
            F.coalesce(pairs, F.lit(0)).alias("pairs"),
            F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
        ).first()

    found, questions, left_out = measure(sizes), sizes, {"questions": 0, "pairs": 0}
    if max_pairs is not None and found["pairs"] > max_pairs:
        questions = stage(pair_budget(sizes, max_pairs), "question-budget")
        every, found = found, measure(questions)
        left_out = {k: int(every[k] - found[k]) for k in left_out}
    return PairPlan(answers, styles, questions, found["questions"], found["largest"], row_key, left_out)


# --- tiles ----------------------------------------------------------------------------------


def _tiled(rows: DataFrame, row_key: tuple[str, ...], block_rows: int) -> DataFrame:
    """Send each answer to every pair of blocks that its own block is part of."""
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64(*row_key), blocks.cast("bigint"))).otherwise(F.lit(0)).cast("int")
    keys = ["question_id", "tile_i", "tile_j"]
    return (
        rows.withColumn("block", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "question_id",
            F.least("block", "_other").alias("tile_i"),
            F.greatest("block", "_other").alias("tile_j"),
            "block",
            "embedding",
            "style",
        )
        .repartition(*keys)
        .sortWithinPartitions(*keys)
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Cut key-sorted batches into one table per key."""
    current, parts = None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        # Numbers stand for the values, so that nulls are equal and every type of key will do.
        columns = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for values in columns:
            changed |= values[1:] != values[:-1]
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            if parts and key != current:
                yield current, pa.Table.from_batches(parts)
                parts = []
            current = key
            parts.append(batch.slice(start, end - start))
    if parts:
        yield current, pa.Table.from_batches(parts)


def _unit_rows(table: pa.Table, name: str) -> np.ndarray:
    """A vector column as a matrix of unit rows; NaN counts as zero."""
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype(np.float64).reshape(table.num_rows, -1)
    matrix[np.isnan(matrix)] = 0.0
    with np.errstate(invalid="ignore"):
        return matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)), PAIR_EPS)


def tile_cosines(key: tuple, table: pa.Table, chunk: int = CHUNK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All finite (x, y) of one tile, some rows at a time; within one block each pair counts once."""
    semantic, style = _unit_rows(table, "embedding"), _unit_rows(table, "style")
    within = key[1] == key[2]
    first = np.ones(table.num_rows, dtype=bool) if within else table.column("block").to_numpy() == key[1]
    left, right = (semantic[first], style[first]), (semantic[~first], style[~first])
    for at in range(0, len(left[0]), chunk):
        # Within a block, rows meet the rows after them.
        others = (left[0][at:], left[1][at:]) if within else right
        with np.errstate(invalid="ignore"):
            x = left[0][at : at + chunk] @ others[0].T
            y = left[1][at : at + chunk] @ others[1].T
        wanted = np.isfinite(x) & np.isfinite(y)
        if within:
            wanted &= ~np.tri(*x.shape, dtype=bool)
        yield x[wanted], y[wanted]


_TILE_KEYS = ["question_id", "tile_i", "tile_j"]
_SUMS = ["sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy"]
_SUMMARY_FIELDS = ["pairs", *_SUMS, "min_x", "max_x", "min_y", "max_y"]


def _summaries(plan: PairPlan, rows: DataFrame, block_rows: int) -> DataFrame:
    """The summary of each tile, some rows at a time."""
    schema = ", ".join([f"question_id {plan.id_type()}", "pairs bigint", *(f"{c} double" for c in _SUMMARY_FIELDS[1:])])
    return _tiled(rows, plan.row_key, block_rows).mapInArrow(_summarize_tiles, schema)


def _summarize_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, kind = [], None

    def flush():
        data = {"question_id": pa.array([r[0] for r in rows], kind)}
        data["pairs"] = pa.array([r[1] for r in rows], pa.int64())
        for at, name in enumerate(_SUMMARY_FIELDS[1:], start=2):
            data[name] = pa.array([r[at] for r in rows], pa.float64())
        rows.clear()
        return pa.RecordBatch.from_pydict(data)

    for key, table in _runs(batches, _TILE_KEYS):
        kind = table.schema.field("question_id").type
        for x, y in tile_cosines(key, table):
            if len(x):
                sums = (x.sum(), y.sum(), x @ x, y @ y, x @ y)
                rows.append((key[0], len(x), *map(float, sums), *map(float, (x.min(), x.max(), y.min(), y.max()))))
        if len(rows) >= 4096:
            yield flush()
    if rows:
        yield flush()


def _merge_summaries(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        *(F.sum(c).alias(c) for c in _SUMS),
        F.min("min_x").alias("min_x"),
        F.max("max_x").alias("max_x"),
        F.min("min_y").alias("min_y"),
        F.max("max_y").alias("max_y"),
    )


def pair_similarity(plan: PairPlan, block_rows: int = BLOCK_ROWS, stored: bool = False) -> DataFrame:
    """Per question: finite pairs, sums, products and extremes of both similarities, over all pairs."""
    rows = plan.stored_rows() if stored else plan.rows()
    return _merge_summaries(_summaries(plan, rows, block_rows), "question_id")


def pair_extent(plan: PairPlan, block_rows: int = BLOCK_ROWS, stored: bool = False) -> DataFrame:
    """The same for all questions together: one row."""
    rows = plan.stored_rows() if stored else plan.rows()
    return _merge_summaries(_summaries(plan, rows, block_rows))


# --- sums without pairs ---------------------------------------------------------------------


#: What a row of partial sums holds: sizes, the vectors' sums, bands of the matrices s's, t't and s't, or a question's own pair sums.
_SIZES, _SUM_S, _SUM_T, _SS, _TT, _ST, _DONE = range(7)


def _bands(left: np.ndarray, right: np.ndarray, numbers: int) -> Iterator[np.ndarray]:
    """The product of two blocks' transposed and plain vectors, in bands of rows."""
    rows = max(1, numbers // right.shape[1])
    for at in range(0, left.shape[1], rows):
        yield left[:, at : at + rows].T @ right


def _outer_sums(numbers: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: sizes, vector sums and outer products, in rows of a bounded size; of a question's only block, its pair sums."""
        for key, table in _runs(batches, ["question_id", "block"]):
            s, t = _unit_rows(table, "embedding"), _unit_rows(table, "style")
            ss, tt = (s * s).sum(axis=1), (t * t).sum(axis=1)
            sizes = [len(s), ss.sum(), tt.sum(), ss @ ss, tt @ tt, ss @ tt]
            products = ((_SS, s, s), (_TT, t, t), (_ST, s, t))
            kind = table.schema.field("question_id").type

            def row(what: int, band: int, values: np.ndarray) -> pa.RecordBatch:
                lists = pa.array([np.asarray(values, dtype=np.float64).ravel()], pa.list_(pa.float64()))
                return pa.RecordBatch.from_arrays(
                    [pa.array([key[0]], kind), pa.array([what], pa.int32()), pa.array([band], pa.int32()), lists],  # noqa: B023
                    ["question_id", "what", "band", "sums"],
                )

            if table.column("blocks")[0].as_py() == 1:
                whole = [(v.sum(axis=0) ** 2).sum() for v in (s, t)]
                whole += [sum((band * band).sum() for band in _bands(x, y, numbers)) for _, x, y in products]
                yield row(_DONE, 0, [len(s) * (len(s) - 1) // 2, *((w - z) / 2 for w, z in zip(whole, sizes[1:]))])
                continue
            yield row(_SIZES, 0, sizes)
            yield row(_SUM_S, 0, s.sum(axis=0))
            yield row(_SUM_T, 0, t.sum(axis=0))
            for what, x, y in products:
                for at, band in enumerate(_bands(x, y, numbers)):
                    yield row(what, at, band)

    return sums


def _large_question_sums(plan: PairPlan, rows: DataFrame, block_rows: int, numbers: int) -> DataFrame:
    """Pair sums of large questions from their vectors' sums and outer products.

    Over all ordered pairs the sum of s_i.s_j is |sum s|^2, that of its square is the squared
    size of the matrix sum s s', and that of (s_i.s_j)(t_i.t_j) is the squared size of
    sum s t'. Taking off the diagonal and halving leaves each unordered pair once.
    """
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    finite = rows.where(~_has_infinity(F.col("embedding")) & ~_has_infinity(F.col("style")))
    parts = (
        finite.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64(*plan.row_key), F.col("blocks").cast("bigint")).cast("int"))
        .select("question_id", "block", "blocks", "embedding", "style")
        .repartition("question_id", "block")
        .sortWithinPartitions("question_id", "block")
        .mapInArrow(_outer_sums(numbers), f"question_id {plan.id_type()}, what int, band int, sums array<double>")
    )
    keys = ["question_id", "what", "band"]
    added = parts.groupBy(*keys).agg(Summarizer.sum(array_to_vector("sums")).alias("_v")).select(*keys, vector_to_array("_v").alias("v"))
    squared = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    plain = F.col("what").isin(_SIZES, _DONE)
    one = added.select("question_id", "what", F.when(plain, F.col("v")).alias("v"), F.when(~plain, squared).alias("square"))

    def size(at: int) -> Column:
        return F.max(F.when(F.col("what") == _SIZES, F.col("v")[at]))

    def done(at: int) -> Column:
        return F.max(F.when(F.col("what") == _DONE, F.col("v")[at]))

    def total(what: int) -> Column:
        return F.sum(F.when(F.col("what") == what, F.col("square")))

    kinds = (_SUM_S, _SUM_T, _SS, _TT, _ST)
    sums = [F.coalesce(done(i + 1), (total(what) - size(i + 1)) / 2).alias(c) for i, (what, c) in enumerate(zip(kinds, _SUMS))]
    pairs = F.coalesce(done(0), size(0) * (size(0) - 1) / 2).cast("bigint").alias("pairs")
    return one.groupBy("question_id").agg(pairs, *sums).drop("question_id")


def _width(plan: PairPlan) -> int:
    """The width of the wider of both kinds of vectors; it decides the route, not the result."""
    rows = [df.select(F.size("embedding").alias("w")).first() for df in (plan.answers, plan.styles)]
    return max((r["w"] for r in rows if r is not None), default=1)


def pair_sums(
    plan: PairPlan, large: int | None = None, sum_block_rows: int = SUM_BLOCK_ROWS, band_numbers: int = BAND_NUMBERS
) -> DataFrame:
    """One row: finite pairs and the sums and products of x and y over them.

    Work is linear in the answers: a question above ``large`` answers goes by outer products,
    the others take one small matrix product each. Unless it is named, ``large`` is the width of the vectors, where
    both routes cost the same.
    """
    rows = plan.rows()
    limit = max(1, _width(plan) if large is None else large)
    parts = _summaries(plan, rows.where(F.col("n") <= limit), limit).select("pairs", *_SUMS)
    if plan.largest > limit:
        parts = parts.unionByName(_large_question_sums(plan, rows.where(F.col("n") > limit), sum_block_rows, band_numbers))
    return parts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), *(F.sum(c).alias(c) for c in _SUMS))


# --- statistics -----------------------------------------------------------------------------


def _moments(sums: DataFrame) -> DataFrame:
    """Means, sample variances and covariance; a variance within rounding of zero is zero."""
    n = F.col("pairs").cast("double")

    def spread(square: str, a: str, b: str) -> Column:
        return (F.col(square) - F.col(a) * F.col(b) / n) / (n - 1)

    def variance(square: str, a: str) -> Column:
        raw = spread(square, a, a)
        return F.when(raw > F.col(square) / n * 1e-13, raw).otherwise(F.lit(0.0))

    enough = sums.where(F.col("pairs") >= 2)
    return enough.select(
        "*",
        (F.col("sum_x") / n).alias("mean_x"),
        (F.col("sum_y") / n).alias("mean_y"),
        variance("sum_xx", "sum_x").alias("var_x"),
        variance("sum_yy", "sum_y").alias("var_y"),
        spread("sum_xy", "sum_x", "sum_y").alias("cov"),
    )


def _fit(moments: DataFrame) -> DataFrame:
    r = F.try_divide(F.col("cov"), F.sqrt("var_x") * F.sqrt("var_y"))
    bounded = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return moments.withColumn("r", bounded).withColumn("slope", F.try_divide("cov", "var_x")).withColumn(
        "intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x")
    )


def similarity_correlation(sums: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Pearson r, its p-value, and the least-squares line; NULL below ``min_pairs`` pairs."""
    head = sums.select(F.col("pairs").alias("n_pairs"), (F.col("pairs") >= min_pairs).alias("sufficient"), F.lit(1).alias("_one"))
    fit = _fit(_moments(sums.where(F.col("pairs") >= min_pairs)))
    fitted = fit.select(
        F.lit(1).alias("_one"),
        "r",
        correlation_p_value("r", "pairs").alias("p_value"),
        "slope",
        "intercept",
        (F.col("r") * F.col("r")).alias("r2"),
    )
    return head.join(fitted, "_one", "left").drop("_one")


def confidence_ellipse(
    sums: DataFrame, n_stds: tuple[float, ...] = (1.0, 2.0, 3.0), min_pairs: int = MIN_PAIRS
) -> DataFrame:
    """Covariance ellipse per number of deviations: centre, radii, scales, angle in degrees; none below ``min_pairs`` pairs."""
    fit = _fit(_moments(sums.where(F.col("pairs") >= min_pairs))).withColumn("n_std", F.explode(F.array(*(F.lit(float(s)) for s in n_stds))))
    return fit.select(
        "n_std",
        "mean_x",
        "mean_y",
        F.sqrt(1 + F.col("r")).alias("radius_x"),
        F.sqrt(1 - F.col("r")).alias("radius_y"),
        (F.sqrt("var_x") * F.col("n_std")).alias("scale_x"),
        (F.sqrt("var_y") * F.col("n_std")).alias("scale_y"),
        F.lit(45.0).alias("angle"),
    )


def regression_grid(extent: DataFrame, points: int = GRID_POINTS, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """The fitted line at evenly spaced x from the least to the greatest: (k, x, y_hat); none below ``min_pairs`` pairs."""
    fit = _fit(_moments(extent.where(F.col("pairs") >= min_pairs))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("min_x") + (F.col("max_x") - F.col("min_x")) * F.col("k") / (points - 1)
    return fit.withColumn("x", x).select("k", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y_hat"))


# --- binned densities -----------------------------------------------------------------------


def _histogram_range(lo: float, hi: float) -> tuple[float, float]:
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def _hexagon_range(lo: float, hi: float) -> tuple[float, float]:
    """Widen an empty range by a tenth, as plotting does."""
    if hi - lo <= max(abs(lo), abs(hi)) * 1e-15:
        if lo == 0 and hi == 0:
            return -0.1, 0.1
        return lo - 0.1 * abs(lo), hi + 0.1 * abs(hi)
    return lo, hi


@dataclass(frozen=True)
class HexGrid:
    """Two interleaved lattices of ``nx`` by ``ny`` cells over the given ranges."""

    x0: float
    y0: float
    sx: float
    sy: float
    nx: int
    ny: int

    @staticmethod
    def over(extent: Row, columns: int = HEX_COLUMNS) -> HexGrid:
        rows = int(columns / 3**0.5)
        xmin, xmax = _hexagon_range(extent["min_x"], extent["max_x"])
        ymin, ymax = _hexagon_range(extent["min_y"], extent["max_y"])
        pad = 1e-9 * (xmax - xmin)
        xmin, xmax = xmin - pad, xmax + pad
        return HexGrid(xmin, ymin, (xmax - xmin) / columns, (ymax - ymin) / rows, columns, rows)

    def cells(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Flat cell number of each point: the nearer of the two lattices' closest centres."""
        u, v = (x - self.x0) / self.sx, (y - self.y0) / self.sy
        i1, j1, i2, j2 = np.rint(u), np.rint(v), np.floor(u), np.floor(v)
        near = (u - i1) ** 2 + 3 * (v - j1) ** 2 < (u - i2 - 0.5) ** 2 + 3 * (v - j2 - 0.5) ** 2
        i = np.clip(np.where(near, i1, i2), 0, self.nx).astype(np.int64)
        j = np.clip(np.where(near, j1, j2), 0, self.ny).astype(np.int64)
        return (np.where(near, 0, 1) * (self.nx + 1) + i) * (self.ny + 1) + j


def _one_extent(plan: PairPlan, block_rows: int, min_pairs: int) -> Row | None:
    row = plan.extent(block_rows).first()
    return row if row["pairs"] >= max(1, min_pairs) else None


_AXES = ("x", "y")


def _grid_counts(
    plan: PairPlan, block_rows: int, ranges: dict[str, tuple[float, float]] | None, bins: int, grid: HexGrid | None
) -> DataFrame:
    """(layer, cell, n) of the layers that are asked for, from one pass over the tiles: a bin of an axis, or a hexagon."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {axis: np.zeros(bins, dtype=np.int64) for axis in ranges or ()}
        if grid is not None:
            totals["hex"] = np.zeros(2 * (grid.nx + 1) * (grid.ny + 1), dtype=np.int64)
        for key, table in _runs(batches, _TILE_KEYS):
            for x, y in tile_cosines(key, table):
                for axis, values in zip(_AXES, (x, y)):
                    if ranges:
                        lo, hi = ranges[axis]
                        at = np.clip(np.floor((values - lo) / (hi - lo) * bins), 0, bins - 1).astype(np.int64)
                        totals[axis] += np.bincount(at, minlength=bins)
                if grid is not None:
                    totals["hex"] += np.bincount(grid.cells(x, y), minlength=len(totals["hex"]))
        for layer, counted in totals.items():
            cells = np.flatnonzero(counted) if layer == "hex" else np.arange(bins)
            yield pa.RecordBatch.from_pydict(
                {"layer": pa.array([layer] * len(cells), pa.string()), "cell": pa.array(cells, pa.int64()), "n": pa.array(counted[cells], pa.int64())}
            )

    tiles = _tiled(plan.stored_rows(), plan.row_key, block_rows)
    counted = tiles.mapInArrow(count, "layer string, cell bigint, n bigint")
    return counted.groupBy("layer", "cell").agg(F.sum("n").alias("n"))


_HISTOGRAM_DDL = "axis string, bin int, lo double, hi double, n bigint"
_HEXAGON_DDL = "cell_i double, cell_j double, x double, y double, n bigint, log10_n double"


def pair_density(
    plan: PairPlan,
    bins: int | None = HISTOGRAM_BINS,
    columns: int | None = HEX_COLUMNS,
    block_rows: int = BLOCK_ROWS,
    min_pairs: int = MIN_PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """Histograms and hexagons of the pairs; a layer whose size is None is left empty.

    The plan's first pass finds the ranges (one row); a second one fills the grids of both layers, and a task sends only
    its counts.
    """
    spark = plan.answers.sparkSession
    histograms, hexagons = (spark.createDataFrame([], x) for x in (_HISTOGRAM_DDL, _HEXAGON_DDL))
    extent = _one_extent(plan, block_rows, min_pairs)
    if extent is None:
        return histograms, hexagons
    ranges = {a: _histogram_range(extent[f"min_{a}"], extent[f"max_{a}"]) for a in _AXES} if bins else None
    grid = HexGrid.over(extent, columns) if columns else None
    counted = _grid_counts(plan, block_rows, ranges, bins or 0, grid)
    if ranges and grid:
        counted = stage(counted, "density")
    if ranges:

        def edge(k: Column) -> Column:
            on = {axis: F.lit(lo) + F.lit(hi - lo) * k / bins for axis, (lo, hi) in ranges.items()}
            return F.when(F.col("layer") == "x", on["x"]).otherwise(on["y"])

        histograms = counted.where(F.col("layer").isin(*_AXES)).select(
            F.col("layer").alias("axis"), F.col("cell").cast("int").alias("bin"), edge(F.col("cell")).alias("lo"), edge(F.col("cell") + 1).alias("hi"), "n"
        )
    if grid:
        lattice, rest = F.floor(F.col("cell") / ((grid.nx + 1) * (grid.ny + 1))), F.col("cell") % ((grid.nx + 1) * (grid.ny + 1))
        centres = counted.where("layer = 'hex'").select(
            (F.floor(rest / (grid.ny + 1)) + lattice * 0.5).cast("double").alias("cell_i"), (rest % (grid.ny + 1) + lattice * 0.5).cast("double").alias("cell_j"), "n"
        )
        hexagons = centres.select(
            "cell_i",
            "cell_j",
            (F.col("cell_i") * grid.sx + grid.x0).alias("x"),
            (F.col("cell_j") * grid.sy + grid.y0).alias("y"),
            "n",
            F.log10(F.col("n").cast("double")).alias("log10_n"),
        )
    return histograms, hexagons


def marginal_histograms(
    plan: PairPlan, bins: int = HISTOGRAM_BINS, block_rows: int = BLOCK_ROWS, min_pairs: int = MIN_PAIRS
) -> DataFrame:
    """Equal-width counts of x and of y: (axis, bin, lo, hi, n), empty bins included."""
    return pair_density(plan, bins, None, block_rows, min_pairs)[0]


def hexbin_density(
    plan: PairPlan, columns: int = HEX_COLUMNS, block_rows: int = BLOCK_ROWS, min_pairs: int = MIN_PAIRS
) -> DataFrame:
    """Hexagonal density of (x, y): (cell_i, cell_j, x, y, n, log10_n) for cells that hold a pair."""
    return pair_density(plan, None, columns, block_rows, min_pairs)[1]
