"""Weighted linear learning from distributed sufficient statistics.

A row's weight depends only on its own trajectory's row count and its own family's trajectory
count, so the statistics of any leave-families-out training set are sums of per-family blocks.
One aggregation per data set yields all blocks; the k x k solves are microseconds on the driver;
heads go back as a small table and scoring is a broadcast join of plain arithmetic.

Training rows have ``horizon``, ``family``, ``trajectory_id``, the z columns and ``y_delta``
(or ``rul_days``, ``rul_lower_bound_days`` and ``censored``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfleet.functions.space import dot
from cellfleet.operators.windows import budget_shares
from cellfleet.plans import wide
from cellfleet.plans.scan import KEY
from cellfleet.plans.small import SMALL_ROWS, collect_bounded, cut, each_case, grid, settle

# Grids in the order in which ties are resolved.
ALPHAS = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
TRANSFER_ALPHAS = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
LAMBDAS = (0.0, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1e4)
# Shares of a family's trajectories, rounded up.
BUDGETS = (("10pct", 0.10), ("25pct", 0.25), ("50pct", 0.50), ("100pct", 1.0))
MAX_ITERATIONS = 50
MAX_FAMILIES = 256


# ---------------------------------------------------------------- weights and statistics


def equal_weights(df: DataFrame, strata: Sequence[str] = ("horizon",)) -> DataFrame:
    """Rows with weight 1 / rows(trajectory) / trajectories(family), inside each stratum.

    The trajectory table (one row per trajectory and stratum) is counted by partial aggregation.
    It is joined without a hint: AQE broadcasts it when small and splits a hot trajectory when not.
    """
    s = list(strata)
    per = df.groupBy(*s, "family", KEY).agg(F.count("*").alias("_n"))
    fam = settle(per.groupBy(*s, "family").agg(F.count("*").alias("_m")))
    w = per.join(fam, [*s, "family"]).select(*s, "family", KEY, (1.0 / F.col("_n") / F.col("_m")).alias("weight"))
    return df.join(w, [*s, "family", KEY])


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _moment_columns(z: Sequence[str], y: str) -> dict[str, str]:
    """Products whose sums make up the normal equations, as SQL: parsing is quicker than building."""
    out = {f"g{i}_{j}": f"`{z[i]}` * `{z[j]}`" for i, j in _pairs(len(z))}
    out |= {f"s{i}": f"`{c}`" for i, c in enumerate(z)}
    out |= {f"b{i}": f"`{c}` * `{y}`" for i, c in enumerate(z)}
    return out | {"sy": f"`{y}`", "syy": f"`{y}` * `{y}`"}


def gram(df: DataFrame, z: Sequence[str], y: str = "y_delta", keys: Sequence[str] = ("horizon",),
         weighted: bool = True) -> DataFrame:
    """Sufficient statistics per (keys, family), with weights summing to 1 in each family.

    Sums are taken per trajectory first, so weights are applied on the trajectory table and a
    hot trajectory is combined in the map tasks. No row is joined or shuffled.
    """
    k, m = list(keys), _moment_columns(z, y)
    per = df.groupBy(*k, "family", KEY).agg(
        F.count("*").alias("_n"), *[F.expr(f"sum({e}) AS `_{n}`") for n, e in m.items()]
    )
    share = "sum(`_{0}` / `_n`) / count(1)" if weighted else "sum(`_{0}`)"
    return per.groupBy(*k, "family").agg(
        F.sum("_n").alias("n_rows"), F.count("*").alias("n_trajectories"),
        *[F.expr(f"{share.format(n)} AS `{'sw' if n == 'n' else n}`") for n in ("n", *m)],
    )


@dataclass
class Moments:
    """Normal-equation sums of one training set; instances add up."""

    g: np.ndarray
    b: np.ndarray
    s: np.ndarray
    sy: float
    syy: float
    sw: float
    n: int
    n_traj: int

    def __add__(self, o: "Moments") -> "Moments":
        return Moments(self.g + o.g, self.b + o.b, self.s + o.s, self.sy + o.sy, self.syy + o.syy,
                       self.sw + o.sw, self.n + o.n, self.n_traj + o.n_traj)

    def __sub__(self, o: "Moments") -> "Moments":
        return Moments(self.g - o.g, self.b - o.b, self.s - o.s, self.sy - o.sy, self.syy - o.syy,
                       self.sw - o.sw, self.n - o.n, self.n_traj - o.n_traj)

    @staticmethod
    def zero(k: int) -> "Moments":
        return Moments(np.zeros((k, k)), np.zeros(k), np.zeros(k), 0.0, 0.0, 0.0, 0, 0)

    @staticmethod
    def of(row, k: int) -> "Moments":
        g = np.zeros((k, k))
        for i, j in _pairs(k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
        vec = lambda p: np.array([row[f"{p}{i}"] or 0.0 for i in range(k)])
        return Moments(g, vec("b"), vec("s"), row["sy"] or 0.0, row["syy"] or 0.0, row["sw"] or 0.0,
                       row["n_rows"] or 0, row["n_trajectories"] or 0)


def moments(table: DataFrame, k: int, keys: Sequence[str] = ("horizon",)) -> dict[tuple, dict]:
    """Collected family blocks: stratum -> family -> `Moments`; at most families x strata rows."""
    rows = collect_bounded(table, SMALL_ROWS, "family statistics")
    out: dict[tuple, dict] = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in keys), {})[r["family"]] = Moments.of(r, k)
    for fams in out.values():
        if len(fams) > MAX_FAMILIES:
            raise ValueError(f"more than {MAX_FAMILIES} families cannot be left out one by one")
    return out


def total(blocks: dict, without: Iterable = ()) -> Moments:
    """Statistics of all families but some."""
    skip = set(without)
    parts = [m for f, m in sorted(blocks.items()) if f not in skip]
    if not parts:
        raise ValueError("no training family is left")
    out = parts[0]
    for m in parts[1:]:
        out = out + m
    return out


# ---------------------------------------------------------------- solves


def fit_ridge(m: Moments, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge without an intercept column on weights of mean 1; the intercept is set afterwards."""
    return fit_l2sp(m, np.zeros(len(m.b)), alpha, 0.0)


def fit_l2sp(m: Moments, prior: np.ndarray, alpha: float, lam: float) -> tuple[np.ndarray, float]:
    """Ridge pulled towards a source head: lambda 0 is plain ridge, a large one the source head."""
    scale = m.n / m.sw
    a = m.g * scale + (alpha + lam) * np.eye(len(m.b))
    coef = np.linalg.solve(a, m.b * scale + lam * np.asarray(prior, dtype=float))
    return coef, float(m.sy / m.sw - m.s @ coef / m.sw)


def fit_joint(m: Moments, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge with jointly optimal intercept, by weighted centring; weights are used as they are."""
    a = m.g - np.outer(m.s, m.s) / m.sw + alpha * np.eye(len(m.b))
    coef = np.linalg.solve(a, m.b - m.s * m.sy / m.sw)
    return coef, float(m.sy / m.sw - m.s @ coef / m.sw)


# ---------------------------------------------------------------- folds and heads


def lofo(df: DataFrame) -> DataFrame:
    """Leave-one-family-out pairs (held, inner)."""
    fams = settle(df.select("family").distinct(), MAX_FAMILIES)
    held, inner = fams.select(F.col("family").alias("held")), fams.select(F.col("family").alias("inner_family"))
    return held.join(inner, F.col("held") != F.col("inner_family"))


@dataclass
class Prior:
    """A source head per horizon, in z space. Horizons outside its support are refused."""

    coef: dict[int, Sequence[float]]
    intercept: dict[int, float] = field(default_factory=dict)

    def at(self, h: int) -> np.ndarray:
        if h not in self.coef:
            raise ValueError(f"horizon {h} is outside the source support {sorted(self.coef)}")
        return np.asarray(self.coef[h], dtype=float)


@dataclass
class Heads:
    """Candidate heads of one protocol: inner folds for selection, outer fits for evaluation.

    ``inner``: (stratum, inner family) -> held-out families and their heads, an array of held family x candidate x
    (coefficients, intercept).
    """

    inner: dict[tuple, tuple[list, np.ndarray]]
    outer: list[tuple]
    grid: list[tuple]
    k: int


def strength_path(m: Moments, prior: np.ndarray, alphas: np.ndarray, lambdas: np.ndarray) -> np.ndarray:
    """`fit_l2sp` at every strength from one eigen-decomposition: candidate x (coefficients, intercept).

    A strength only adds to the eigenvalues, so in the eigenbasis each solve is a division.
    """
    scale = m.n / m.sw
    d, v = np.linalg.eigh(m.g * scale)
    b, p = v.T @ (m.b * scale), v.T @ np.asarray(prior, dtype=float)
    coef = ((b + lambdas[:, None] * p) / (d + (alphas + lambdas)[:, None])) @ v.T
    return np.column_stack([coef, m.sy / m.sw - coef @ m.s / m.sw])


def candidate_heads(blocks: dict[tuple, dict], alphas: Sequence[float], lambdas: Sequence[float] = (0.0,),
                    prior: Prior | None = None, horizon_at: int = 0) -> Heads:
    """Fit every (stratum, held, inner, lambda, alpha) from family blocks.

    Leaving out (a, b) and (b, a) is the same training set, so half of the inner fits are shared, and one
    `strength_path` gives all strengths of a set. Lambda is the outer loop of the grid order, alpha the inner one.
    """
    cells = [(i, float(lam), float(a)) for i, (lam, a) in enumerate((l, a) for l in lambdas for a in alphas)]
    strengths = np.array([c[2] for c in cells]), np.array([c[1] for c in cells])
    found: dict[tuple, dict] = {}
    outer, k = [], 0
    for stratum, fams in sorted(blocks.items()):
        names = sorted(fams)
        k = len(next(iter(fams.values())).b)
        src = prior.at(stratum[horizon_at]) if prior else np.zeros(k)
        for held in names if len(names) > 1 else ():
            path = strength_path(total(fams, {held}), src, *strengths)
            outer += [(*stratum, held, c, *map(float, head)) for (c, _, _), head in zip(cells, path)]
        if len(names) < 3:
            continue
        whole = total(fams)
        for i, one in enumerate(names):
            for two in names[i + 1:]:
                # Few families are added up anew; with many, taking two off the whole spares their sums.
                m = total(fams, {one, two}) if len(names) <= 32 else whole - fams[one] - fams[two]
                path = strength_path(m, src, *strengths)
                found.setdefault((*stratum, two), {})[one] = path
                found.setdefault((*stratum, one), {})[two] = path
    inner = {place: (sorted(by), np.stack([by[h] for h in sorted(by)])) for place, by in found.items()}
    return Heads(inner, outer, cells, k)


def _head_schema(df: DataFrame, keys: Sequence[str], fams: Sequence[str], k: int) -> str:
    kinds = dict(df.dtypes)
    cols = [f"{c} {kinds[c]}" for c in keys]
    cols += [f"{c} {kinds['family']}" for c in fams]
    return ", ".join([*cols, "cand int", *[f"c{i} double" for i in range(k)], "c_b double"])


#: Numbers of heads that tasks get in one pass over the rows, and errors held at once by a task.
HEAD_VALUES, ERRORS = 1 << 22, 1 << 21


def _head_passes(heads: Heads) -> list[list[tuple]]:
    """(place, held families, heads) in parts of bounded size; a place with many held families is cut."""
    parts, size = [[]], 0
    for place, (held, a) in sorted(heads.inner.items()):
        step = max(1, HEAD_VALUES // max(1, a[0].size))
        for at in range(0, len(held), step):
            piece = a[at:at + step]
            if size + piece.size > HEAD_VALUES and parts[-1]:
                parts.append([])
                size = 0
            parts[-1].append((place, held[at:at + step], piece))
            size += piece.size
    return [p for p in parts if p]


def _error_sums(rows: DataFrame, z: Sequence[str], y: str, heads: list[np.ndarray]) -> DataFrame:
    """Rows (``_p``, z, y) -> ``_p``, ``pos`` and the sum of absolute errors and rows of each head of the place.

    A task multiplies blocks of rows by its place's heads as one matrix and keeps one sum per head.
    """
    k, matrices = len(z), [h.reshape(-1, h.shape[-1]).T for h in heads]

    def run(batches):
        sums = [np.zeros(m.shape[1]) for m in matrices]
        counts = [0] * len(matrices)
        for p, x in wide.blocks(batches, list(range(len(matrices))), k + 1):
            use = np.flatnonzero((p >= 0) & ~np.isnan(x).any(axis=1))
            use = use[np.argsort(p[use], kind="stable")]
            cuts = np.flatnonzero(np.diff(p[use], prepend=-1))
            for mine in np.split(use, cuts[1:]) if len(use) else ():
                i = p[mine[0]]
                m = matrices[i]
                step = max(1, ERRORS // m.shape[1])
                for at in range(0, len(mine), step):
                    v = x[mine[at:at + step]]
                    sums[i] += np.abs(v[:, :k] @ m[:k] + m[k] - v[:, k:]).sum(axis=0)
                counts[i] += len(mine)
        for i, n in enumerate(counts):
            if n:
                yield pa.RecordBatch.from_pydict({"_p": [i], "_n": [n], "_s": [sums[i].tolist()]})

    each = rows.select("_p", *z, y).mapInArrow(run, "_p long, _n long, _s array<double>")
    return each.select("_p", "_n", F.posexplode("_s")).groupBy("_p", "pos").agg(F.sum("col").alias("_e"), F.sum("_n").alias("n_rows"))


def score_candidates(df: DataFrame, z: Sequence[str], heads: Heads, y: str = "y_delta",
                     keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Mean absolute error of every inner candidate on its inner family: keys, held, inner_family, cand, score, n_rows.

    No row is joined to heads or multiplied by them: a row carries the number of its (stratum, family), and tasks
    score blocks of rows against that place's heads (`_error_sums`). The shuffle carries one sum per head and task.
    Rows with a missing feature or target count nowhere. Heads beyond `HEAD_VALUES` numbers take further passes.
    """
    spark, kinds, out = df.sparkSession, dict(df.dtypes), None
    key_types = ", ".join(f"{c} {kinds[c]}" for c in keys)
    fam = kinds["family"]
    for part in _head_passes(heads):
        cands = part[0][2].shape[1]
        places = sorted({place for place, _, _ in part})
        number = grid(spark, [(*place, i) for i, place in enumerate(places)], f"{key_types}, family {fam}, _p long")
        # Pieces of one place are put together again.
        pieces: dict[tuple, list] = {}
        for place, held, a in part:
            pieces.setdefault(place, []).append((held, a))
        helds = [[h for held, _ in pieces[place] for h in held] for place in places]
        sums = _error_sums(df.join(number, [*keys, "family"]), z, y, [np.concatenate([a for _, a in pieces[place]]) for place in places])
        names = [(i, j, *place, h) for i, place in enumerate(places) for j, h in enumerate(helds[i])]
        named = grid(spark, names, f"_p long, _h int, {key_types}, inner_family {fam}, held {fam}")
        found = sums.withColumn("_h", F.expr(f"pos div {cands}").cast("int")).join(named, ["_p", "_h"])
        found = found.select(*keys, "held", "inner_family", (F.col("pos") % cands).alias("cand"), (F.col("_e") / F.col("n_rows")).alias("score"), "n_rows")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return grid(spark, [], f"{key_types}, held {fam}, inner_family {fam}, cand int, score double, n_rows long")
    return out


def select_hparam(scores: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Candidate with the lowest mean inner score; the first grid entry wins ties.

    ``scores`` (keys, held, inner_family, cand, score) may come from any model. It has one row
    per fold and candidate, so its ranking window is small.
    """
    per = scores.groupBy(*keys, "held", "cand").agg(F.avg("score").alias("mean_score"))
    w = Window.partitionBy(*keys, "held").orderBy(F.round("mean_score", 15), "cand")
    return per.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def selected_heads(df: DataFrame, z: Sequence[str], heads: Heads, y: str = "y_delta",
                   keys: Sequence[str] = ("horizon",), score_on: DataFrame | None = None) -> DataFrame:
    """The selected outer head per (keys, held), as a broadcast table with its grid values."""
    spark = df.sparkSession
    chosen = select_hparam(score_candidates(score_on if score_on is not None else df, z, heads, y, keys), keys)
    outer = grid(spark, heads.outer, _head_schema(df, keys, ("held",), heads.k))
    values = grid(spark, heads.grid, "cand int, lam double, alpha double")
    return settle(chosen.join(outer, [*keys, "held", "cand"]).join(values, "cand"))


def attach_heads(df: DataFrame, heads: DataFrame, z: Sequence[str], keys: Sequence[str] = ("horizon",),
                 anchor: str | None = "anchor_soh_observed", out: str = "pred_delta") -> DataFrame:
    """Out-of-family prediction of every row by the head that never saw its family.

    ``keys`` found only on the heads (a budget, say) multiply the rows by their values.
    """
    k = len(z)
    cols = [*[f"c{i}" for i in range(k)], "c_b"]
    use = heads.withColumnRenamed("held", "family").select(*keys, "family", "alpha", "lam", *cols)
    # Heads that were checked to be few carry their own hint; others are left to a shuffle join.
    joined = df.join(use, [c for c in [*keys, "family"] if c in df.columns])
    scored = joined.withColumn(out, F.col("c_b") + dot(z, cols[:k])).drop(*cols)
    if anchor is None:
        return scored
    return scored.withColumn("pred_soh", F.col(anchor) + F.col(out))


def lofo_fit(df: DataFrame, z: Sequence[str], alphas: Sequence[float] = ALPHAS, lambdas: Sequence[float] = (0.0,),
             prior: Prior | None = None, y: str = "y_delta", keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Nested leave-one-family-out: statistics, inner selection and outer heads."""
    blocks = moments(gram(df, z, y, keys), len(z), keys)
    return selected_heads(df, z, candidate_heads(blocks, alphas, lambdas, prior), y, keys)


def lofo_predict(df: DataFrame, z: Sequence[str], **kw) -> DataFrame:
    return attach_heads(df, lofo_fit(df, z, **kw), z)


def lofo_evaluate(df: DataFrame, z: Sequence[str], heads: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Errors on each held-out family by the head selected without it."""
    scored = attach_heads(df, heads, z, keys)
    e = F.col("pred_delta") - F.col("y_delta")
    return scored.groupBy(*keys, F.col("family").alias("held")).agg(
        F.first("alpha").alias("alpha"), F.first("lam").alias("lam"),
        F.count("*").alias("n_test_rows"), F.avg(F.abs(e)).alias("mae_delta"),
        F.sqrt(F.avg(e * e)).alias("rmse_delta"),
        F.avg(F.abs(F.col("pred_soh") - F.col("target_soh_true"))).alias("mae_absolute_soh"),
    ).withColumn("selector_saw_outer_test", F.lit(False))


def fixed_heads(df: DataFrame, z: Sequence[str], alphas: dict[int, float], per_family: bool,
                blocks: dict[tuple, dict] | None = None, y: str = "y_delta", min_rows: int = 0) -> DataFrame:
    """Heads at given strengths: one per horizon on all families, or one per (horizon, held).

    Cells with fewer training rows than ``min_rows`` are skipped.
    """
    spark, k = df.sparkSession, len(z)
    blocks = blocks or moments(gram(df, z, y), k)
    rows = []
    for (h,), fams in sorted(blocks.items()):
        if h not in alphas:
            continue
        for held in sorted(fams) if per_family else [None]:
            if held is not None and len(fams) < 2:
                continue
            m = total(fams, {held})
            if m.n < min_rows:
                continue
            coef, b = fit_ridge(m, alphas[h])
            lead = (h, held) if per_family else (h,)
            rows.append((*lead, float(alphas[h]), 0.0, m.n, m.n_traj, *map(float, coef), b))
    kinds = dict(df.dtypes)
    cols = [f"horizon {kinds['horizon']}", *([f"held {kinds['family']}"] if per_family else []), "alpha double",
            "lam double", "n_train_rows long", "n_train_trajectories long",
            *[f"c{i} double" for i in range(k)], "c_b double"]
    return grid(spark, rows, ", ".join(cols))


def deploy_heads(df: DataFrame, z: Sequence[str], alphas: dict[int, float]) -> DataFrame:
    """One head per horizon on all families at fixed strengths."""
    return fixed_heads(df, z, alphas, per_family=False)


def replay(df: DataFrame, z: Sequence[str], alphas: dict[int, float], stored: str, atol: float = 1e-12) -> DataFrame:
    """Refit at stored strengths and compare with stored predictions, per (horizon, held family)."""
    heads = fixed_heads(df, z, alphas, per_family=True, min_rows=20)
    diff = F.abs(F.col("pred_delta") - F.col(stored))
    facts = heads.select("horizon", "held", "n_train_rows", "n_train_trajectories")
    return (
        attach_heads(df, heads, z)
        .groupBy("horizon", F.col("family").alias("held"), "alpha")
        .agg(F.count("*").alias("n_test_rows"), F.max(diff).alias("max_abs_diff"))
        .join(facts, ["horizon", "held"])
        .withColumn("within_atol", F.col("max_abs_diff") <= atol)
    )


def adaptation_curve(df: DataFrame, z: Sequence[str], budgets: Sequence[tuple[str, float]] = BUDGETS,
                     alphas: Sequence[float] = TRANSFER_ALPHAS, lambdas: Sequence[float] = LAMBDAS,
                     prior: Prior | None = None) -> tuple[DataFrame, DataFrame]:
    """The protocol at growing shares of the trajectories of each family, as one keyed pass.

    Training and inner folds use the budget's trajectories; outer tests use all rows. Returns
    the cells and the curve.
    """
    members = each_case(budget_shares(df), budgets, "budget string, budget_share double")
    wanted = F.ceil(F.col("budget_share") * F.col("n_trajectories") - 1e-9)
    inside = members.where(F.col("budget_rank") <= wanted).select("budget", "family", KEY)
    # One row per trajectory and budget: a shuffle join, unless it is measured to be small.
    train = df.join(cut(inside), ["family", KEY])
    keys = ["budget", "horizon"]
    blocks = moments(gram(train, z, keys=keys), len(z), keys)
    heads = selected_heads(train, z, candidate_heads(blocks, alphas, lambdas, prior, horizon_at=1), keys=keys)
    cells = lofo_evaluate(df, z, heads, keys)
    per = cells.groupBy("budget", "held").agg(
        F.avg("mae_absolute_soh").alias("_a"), F.avg("mae_delta").alias("_d"),
        F.count("*").alias("_n"), F.count_if(F.col("lam") == 0).alias("_z"),
    )
    curve = per.groupBy("budget").agg(
        F.sum("_n").alias("n_cells"), F.avg("_a").alias("family_macro_mae_absolute_soh"),
        F.max("_a").alias("worst_family_mae_absolute_soh"), F.stddev_pop("_a").alias("across_family_std"),
        F.avg("_d").alias("family_macro_mae_delta"), F.sum("_z").alias("n_cells_lambda_zero"),
    )
    return cells, curve.withColumn("share_lambda_zero", F.col("n_cells_lambda_zero") / F.col("n_cells"))


def fit_diagnostics(df: DataFrame, z: Sequence[str], heads: DataFrame, prior: Prior | None = None,
                    y: str = "y_delta") -> DataFrame:
    """Objective, condition number, prior retention and a coefficient bound of outer heads.

    The objective of a quadratic model follows from the sufficient statistics, so one pass
    serves every head: sum w (y - z.b)^2 = syy - 2 b.zy + b.G.b.
    """
    spark, k = df.sparkSession, len(z)
    blocks = moments(gram(df, z, y), k)
    rows = []
    for r in collect_bounded(heads, SMALL_ROWS, "heads"):
        m = total(blocks[(r["horizon"],)], {r["held"]})
        coef = np.array([r[f"c{i}"] for i in range(k)])
        src = prior.at(r["horizon"]) if prior else np.zeros(k)
        scale, gap, norm = m.n / m.sw, coef - src, float(np.linalg.norm(src))
        fit = scale * (m.syy - 2 * coef @ m.b + coef @ m.g @ coef)
        strength = r["alpha"] + r["lam"]
        a = m.g * scale + strength * np.eye(k)
        retention = max(0.0, 1.0 - float(np.linalg.norm(gap)) / norm) if norm else None
        objective = float(fit + r["alpha"] * coef @ coef + r["lam"] * gap @ gap)
        rows.append((r["horizon"], r["held"], objective, float(np.linalg.cond(a)), retention,
                     float(np.linalg.norm(coef)), norm, float(4.0 * np.sqrt(1e-6 * abs(objective) / strength)) if strength > 0 else None))
    kinds = dict(df.dtypes)
    return grid(spark, rows, f"horizon {kinds['horizon']}, held {kinds['family']}, objective double, "
                "condition_number double, prior_retention double, coef_norm double, prior_norm double, coef_bound double")


# ---------------------------------------------------------------- censoring-aware fits


def _censored_fits(names: list, alphas: Sequence[float], inner: bool) -> list[tuple]:
    """(fit, left-out families, alpha) for all outer and inner training sets."""
    sets = [(f,) for f in names]
    if inner:
        sets += [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    return [(i, s, float(a)) for i, (s, a) in enumerate((s, a) for s in sets for a in alphas)]


def fit_censored(df: DataFrame, z: Sequence[str], alphas: Sequence[float] = ALPHAS,
                 inner: bool = True) -> tuple[list[dict], list]:
    """All censoring-aware fits at once: every fold and strength advances together.

    Uncensored rows enter by their family blocks, once. In each round the open fits are dealt out in blocks of bounded
    size; a task keeps one vector of sums per fit over the censored rows predicted below their bound
    (`_active_sums`), and no row is joined to fits or multiplied by them. A fit is frozen when its set repeats.
    """
    k = len(z)
    unc = df.where(F.col("censored") == 0).withColumn("horizon", F.lit(0))
    blocks = moments(gram(unc, z, "rul_days"), k).get((0,), {})
    keep = ["family", KEY, "reference_day", "rul_lower_bound_days", *z]
    rows = df.where(F.col("censored") == 1).select(*keep)
    # Weights count the rows that are here: the anchors may have been filtered since they were cut.
    counts = cut(rows.groupBy("family", KEY).agg(F.count("*").alias("n_censored_rows")))
    # Read once per round: the narrow censored rows are kept, not their lineage. Marks are parts of one hash.
    hashed = F.xxhash64(KEY, "reference_day")
    marks = [F.shiftrightunsigned(hashed, 20 * i).bitwiseAND(F.lit(0xFFFFF).cast("long")).cast("double").alias(f"_m{i}") for i in range(3)]
    cen = cut(rows.join(counts, ["family", KEY]).select("family", *z, "rul_lower_bound_days", (1.0 / F.col("n_censored_rows")).alias("_w"), *marks))
    per_family = collect_bounded(
        counts.groupBy("family").agg(F.count("*").alias("m"), F.sum("n_censored_rows").alias("n")), MAX_FAMILIES, "families"
    )
    n_traj = {r["family"]: r["m"] for r in per_family}
    n_cen = {r["family"]: r["n"] for r in per_family}
    names = sorted(set(blocks) | set(n_traj))
    fits = _censored_fits(names, alphas, inner)
    sets = {s for _, s, _ in fits}
    without = {s: total(blocks, set(s)) for s in sets}
    base = {i: without[s] for i, s, _ in fits}
    state = {i: dict(active=None, moments=Moments.zero(k), done=False, iters=0) for i, _, _ in fits}
    for round_ in range(1, MAX_ITERATIONS + 1):
        todo = [(i, s, a) for i, s, a in fits if not state[i]["done"]]
        if not todo:
            break
        for i, s, a in todo:
            coef, b = fit_joint(base[i] + state[i]["moments"], a)
            state[i].update(coef=coef, intercept=b, iters=round_)
        heads = np.array([[*state[i]["coef"], state[i]["intercept"]] for i, _, _ in todo])
        found = _active_sums(cen, z, heads, [s for _, s, _ in todo], n_traj) if n_traj else np.zeros((len(todo), 4))
        for (i, _, _), sums in zip(todo, found):
            active = tuple(int(v) for v in sums[:4])
            if active == (state[i]["active"] or (0, 0, 0, 0)):
                state[i].update(done=True, active=active)
                continue
            state[i].update(active=active, moments=_active_moments(sums, k))
    out = []
    for i, s, a in fits:
        st = state[i]
        e = base[i] + st["moments"]
        coef, b = st["coef"], st["intercept"]
        objective = (e.syy - 2 * (coef @ e.b + b * e.sy) + coef @ e.g @ coef + 2 * b * (coef @ e.s) + b * b * e.sw
                     + a * coef @ coef)
        out.append(dict(left_out=s, alpha=a, coef=coef, intercept=b, converged=st["done"], iters=st["iters"],
                        n_uncensored=base[i].n, n_active=st["active"][0] if st["active"] else 0, objective=float(objective),
                        n_censored=sum(n for f, n in n_cen.items() if f not in s)))
    return out, names


def _active_moments(sums: np.ndarray, k: int) -> Moments:
    """`Moments` from a vector of `_active_sums`: rows, three marks, then weighted products of (1, z, bound)."""
    m = np.zeros((k + 2, k + 2))
    m[np.triu_indices(k + 2)] = sums[4:]
    m = m + np.triu(m, 1).T
    z = slice(1, k + 1)
    return Moments(m[z, z], m[z, -1], m[0, z], m[0, -1], m[-1, -1], m[0, 0], 0, 0)


def _active_sums(cen: DataFrame, z: Sequence[str], heads: np.ndarray, left_out: list[tuple], n_traj: dict) -> np.ndarray:
    """Per fit: number, marks and weighted products of the censored rows of its families that lie below their bound.

    Fits go in blocks, so that neither a task's sums nor what comes back exceeds `HEAD_VALUES` and `SMALL_ROWS`.
    """
    k, fams = len(z), sorted(n_traj)
    upper = np.triu_indices(k + 2)
    width = 4 + len(upper[0])
    step = max(1, min(SMALL_ROWS, HEAD_VALUES) // width)
    share = np.array([1.0 / n_traj[f] for f in fams])
    out = np.zeros((len(heads), width))
    for at in range(0, len(heads), step):
        block = heads[at:at + step]
        inside = np.array([[f not in s for s in left_out[at:at + step]] for f in fams])

        def run(batches, block=block, inside=inside):
            sums = np.zeros((len(block), width))
            for g, x in wide.blocks(batches, fams, k + 5):
                use = np.flatnonzero((g >= 0) & ~np.isnan(x).any(axis=1))
                use = use[np.argsort(g[use], kind="stable")]
                for mine in np.split(use, np.flatnonzero(np.diff(g[use])) + 1) if len(use) else ():
                    f = g[mine[0]]
                    rows = max(1, ERRORS // len(block))
                    for a in range(0, len(mine), rows):
                        v = x[mine[a:a + rows]]
                        below = (v[:, :k] @ block[:, :k].T + block[:, k] < v[:, k:k + 1]) & inside[f]
                        p = np.column_stack([np.ones(len(v)), v[:, :k + 1]])
                        products = p[:, upper[0]] * p[:, upper[1]] * (v[:, k + 1] * share[f])[:, None]
                        sums += below.T.astype(float) @ np.column_stack([np.ones(len(v)), v[:, k + 2:], products])
            yield pa.RecordBatch.from_pydict({"_s": [sums.ravel().tolist()]})

        src = cen.select("family", *z, "rul_lower_bound_days", "_w", "_m0", "_m1", "_m2")
        each = src.mapInArrow(run, "_s array<double>").select(F.posexplode("_s"))
        rows = collect_bounded(each.groupBy("pos").agg(F.sum("col").alias("s")), max(SMALL_ROWS, width), "active sets")
        flat = np.zeros(len(block) * width)
        flat[[r["pos"] for r in rows]] = [r["s"] for r in rows]
        out[at:at + len(block)] = flat.reshape(-1, width)
    return out


def with_censored_rows(anchors: DataFrame) -> DataFrame:
    """Count each trajectory's censored anchors, which its weights need, on filtered anchors.

    `windows.rul_anchors` already carries the number for whole trajectories.
    """
    anchors = anchors.drop("n_censored_rows")
    n = anchors.where(F.col("censored") == 1).groupBy("family", KEY).agg(F.count("*").alias("n_censored_rows"))
    return anchors.join(n, ["family", KEY], "left").withColumn(
        "n_censored_rows", F.coalesce(F.col("n_censored_rows"), F.lit(1))
    )


def censored_heads(df: DataFrame, z: Sequence[str], alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Censoring-aware head per held-out family, its strength chosen on the inner folds."""
    spark, k = df.sparkSession, len(z)
    fits, names = fit_censored(df, z, alphas)
    kind = dict(df.dtypes)["family"]
    order = {float(a): i for i, a in enumerate(alphas)}
    found: dict[tuple, dict] = {}
    for f in fits:
        if len(f["left_out"]) == 2:
            for held, other in (f["left_out"], f["left_out"][::-1]):
                by = found.setdefault((0, other), {}).setdefault(held, np.empty((len(alphas), k + 1)))
                by[order[f["alpha"]]] = [*f["coef"], f["intercept"]]
    inner = {place: (sorted(by), np.stack([by[h] for h in sorted(by)])) for place, by in found.items()}
    unc = df.where(F.col("censored") == 0).withColumn("horizon", F.lit(0))
    scores = score_candidates(unc, z, Heads(inner, [], [], k), "rul_days")
    outer = [
        (0, f["left_out"][0], order[f["alpha"]], f["alpha"], 0.0, f["iters"], f["converged"], f["n_active"],
         f["n_uncensored"], f["n_censored"], f["objective"], *map(float, f["coef"]), f["intercept"])
        for f in fits if len(f["left_out"]) == 1
    ]
    schema = ", ".join(["horizon int", f"held {kind}", "cand int", "alpha double", "lam double", "iters int",
                        "converged boolean", "n_active long", "n_uncensored long", "n_censored long",
                        "objective double", *[f"c{i} double" for i in range(k)], "c_b double"])
    return settle(select_hparam(scores).join(grid(spark, outer, schema), ["horizon", "held", "cand"]))


def rul_predict(df: DataFrame, z: Sequence[str], heads: DataFrame) -> DataFrame:
    """Out-of-family remaining life of every anchor."""
    rows = df.withColumn("horizon", F.lit(0))
    return attach_heads(rows, heads, z, anchor=None, out="pred_rul").drop("horizon")


# ---------------------------------------------------------------- source pretraining


def pretrain(windows: DataFrame, z: Sequence[str], alpha: float, prior: Prior | None = None, horizon: int = 8) -> DataFrame:
    """Unweighted ridge on source windows: coefficients, in-sample error, cosine to a prior head.

    As the head is used without an intercept, the error is measured without one too.
    """
    spark, k = windows.sparkSession, len(z)
    rows = windows.withColumn("horizon", F.lit(horizon)).withColumn("family", F.lit(0)).withColumn(KEY, F.col("cell_id"))
    m = moments(gram(rows, z, weighted=False), k)[(horizon,)][0]
    coef, _ = fit_ridge(m, alpha)
    err = F.avg(F.abs(dot(z, list(coef)) - F.col("y_delta")))
    src = prior.at(horizon) if prior else np.zeros(k)
    norm = float(np.linalg.norm(coef) * np.linalg.norm(src))
    cosine = float(coef @ src) / norm if norm else None
    return windows.agg(F.count("*").alias("n_windows"), F.count_distinct("cell_id").alias("n_cells"), err.alias("mae_in_sample")).select(
        "*", F.lit(float(alpha)).alias("alpha"), F.lit(cosine).cast("double").alias("cosine_to_prior"),
        *[F.lit(float(c)).alias(f"c{i}") for i, c in enumerate(coef)],
    )
