"""Turning posteriors into 2-D commands.

Every mapping adds ``ux`` and ``uy`` to a table that has a ``posterior``
column.  Stateless ones are column expressions; the accumulating one folds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.functions import vectors as V
from kymora.operators import asof, series
from kymora.operators.trace import DIRECTIONS
from kymora.session import stored

MIN_DISTANCE = 1e-6
Table = Sequence[tuple[float, float]]

# Default parameters.
V_MAX = 0.15
EVIDENCE = {"gamma": 0.8, "theta": -1.0, "hold_s": 0.5, "epsilon": 1e-6}
SHARED = {
    "alpha": 0.5, "alpha_mode": "fixed", "alpha_min": 0.0, "alpha_max": 0.9, "intent_mode": "aware",
    "entropy_scaling": False, "k_rep": 0.02, "d0": 0.35, "angular_window_deg": 60.0,
}
OBSTACLES = ((0.3512, 0.5303), (-0.3512, -0.5303), (0.5303, -0.3512))
MAPPING_PARAMS = {
    "s1_argmax": ("v_max",),
    "s2_weighted": ("v_max", "entropy_scaling"),
    "s2_weighted_entropy": ("v_max", "entropy_scaling"),
    "s3_evidence": ("v_max", *EVIDENCE),
    "s4_shared": ("v_max", *SHARED),
}


def _xs(table: Table) -> list[float]:
    return [x for x, _ in table]


def _ys(table: Table) -> list[float]:
    return [y for _, y in table]


def blend(p: Column, table: Table = DIRECTIONS) -> tuple[Column, Column]:
    """Probability-weighted sum of the class directions, not normalised.

    The table is short and constant, so the sum is spelled out and compiled.
    """
    total = lambda ws: sum((F.get(p, F.lit(i)).cast("double") * w for i, w in enumerate(ws) if w != 0), F.lit(0.0))
    return total(_xs(table)), total(_ys(table))


def decoded_direction(p: Column, table: Table = DIRECTIONS) -> tuple[Column, Column]:
    """Unit vector of the blend, zero if the blend is zero."""
    return V.unit(*blend(p, table), eps=0.0)


def argmax_command(p: Column, v_max: float = V_MAX, table: Table = DIRECTIONS) -> tuple[Column, Column]:
    k = V.argmax_class(p)
    return F.lit(v_max) * V.pick_const(k, _xs(table)), F.lit(v_max) * V.pick_const(k, _ys(table))


def weighted_command(
    p: Column, v_max: float = V_MAX, entropy_scaling: bool = False, table: Table = DIRECTIONS
) -> tuple[Column, Column]:
    x, y = blend(p, table)
    s = (1.0 - V.normalised_entropy(p)) if entropy_scaling else F.lit(1.0)
    return x * s * v_max, y * s * v_max


def attractive_target(
    x: Column, y: Column, p: Column, targets: Table, window_deg: float, table: Table = DIRECTIONS
) -> Column:
    """Target best aligned with the decoded intent, null outside the angular window.

    Targets are a handful of constants per episode layout, so they are folded
    into the expression rather than joined.
    """
    return _best_within(_alignments(x, y, *blend(p, table), targets), window_deg)


def _alignments(x: Column, y: Column, bx: Column, by: Column, targets: Table) -> Column:
    """Cosine between the intent and the way to each target; -2 where there is no way or no intent."""
    norm = V.hypot(bx, by)
    scores = []
    for tx, ty in targets:
        dx, dy = F.lit(tx) - x, F.lit(ty) - y
        d = V.hypot(dx, dy)
        scores.append(F.when((d > MIN_DISTANCE) & (norm > MIN_DISTANCE), (dx * bx + dy * by) / (d * norm)).otherwise(F.lit(-2.0)))
    return F.array(*scores)


def _best_within(alignments: Column, window_deg: float) -> Column:
    return F.when(F.array_max(alignments) >= math.cos(math.radians(window_deg)), V.argmax_class(alignments))


def repulsion(x: Column, y: Column, obstacles: Table, k_rep: float, d0: float) -> tuple[Column, Column]:
    """Sum of pushes away from every obstacle nearer than ``d0``."""
    px, py = F.lit(0.0), F.lit(0.0)
    for ox, oy in obstacles:
        dx, dy = x - ox, y - oy
        d = F.greatest(V.hypot(dx, dy), F.lit(MIN_DISTANCE))
        m = F.when(d < d0, F.lit(k_rep) * (1.0 / d - 1.0 / d0) / d).otherwise(0.0)
        px, py = px + dx * m, py + dy * m
    return px, py


def autonomy_command(
    x: Column, y: Column, tx: Column, ty: Column, obstacles: Table, v_max: float, k_rep: float, d0: float
) -> tuple[Column, Column]:
    """Pull to the target at ``(tx, ty)``, if any, plus pushes from obstacles, shortened to the speed limit."""
    dx, dy = tx - x, ty - y
    n = V.hypot(dx, dy)
    pull = lambda c: F.when(n > MIN_DISTANCE, c / n * v_max).otherwise(0.0)
    rx, ry = repulsion(x, y, obstacles, k_rep, d0)
    return pull(dx) + rx, pull(dy) + ry


def effective_alpha(p: Column, alpha: Column | float, mode: str, alpha_min: float, alpha_max: float) -> Column:
    if mode == "fixed":
        return alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    if mode == "adaptive":
        return F.lit(alpha_min) + (alpha_max - alpha_min) * V.normalised_entropy(p)
    raise ValueError(f"unknown alpha mode {mode!r}, expected fixed or adaptive")


def shared_command(
    steps: DataFrame, targets: Table, obstacles: Table = OBSTACLES, *, alpha: Column | float = 0.5, v_max: float = V_MAX,
    table: Table = DIRECTIONS, alpha_mode: str = "fixed", alpha_min: float = 0.0, alpha_max: float = 0.9,
    intent_mode: str = "aware", entropy_scaling: bool = False, k_rep: float = 0.02, d0: float = 0.35,
    angular_window_deg: float = 60.0,
) -> DataFrame:
    """Blend of the weighted user command and the autonomy; weight zero is the user command itself.

    Needs ``posterior``, ``x``, ``y`` and, for the blind mode, ``target_idx``.
    """
    if intent_mode not in ("aware", "blind"):
        raise ValueError(f"unknown intent mode {intent_mode!r}, expected aware or blind")
    p, x, y = F.col("posterior"), F.col("x"), F.col("y")
    bx, by = blend(p, table)
    ready = steps.select(
        "*", bx.alias("_bx"), by.alias("_by"), effective_alpha(p, alpha, alpha_mode, alpha_min, alpha_max).alias("alpha_used")
    )
    scale = (1.0 - V.normalised_entropy(p)) * v_max if entropy_scaling else F.lit(v_max)
    # Each stage is a column of its own, so the compiled expressions stay small.
    if intent_mode == "blind":
        ready = ready.withColumn("aim", F.col("target_idx"))
    else:
        ready = ready.withColumn("_al", _alignments(x, y, F.col("_bx"), F.col("_by"), targets))
        ready = ready.withColumn("aim", _best_within(F.col("_al"), angular_window_deg)).drop("_al")
    ready = ready.select(
        "*", (F.col("_bx") * scale).alias("_wx"), (F.col("_by") * scale).alias("_wy"),
        V.pick_const(F.col("aim"), _xs(targets)).alias("_tx"), V.pick_const(F.col("aim"), _ys(targets)).alias("_ty"),
    ).drop("_bx", "_by")
    fx, fy = autonomy_command(x, y, F.col("_tx"), F.col("_ty"), obstacles, v_max, k_rep, d0)
    ready = ready.withColumn("_fx", fx).withColumn("_fy", fy)
    ax, ay = V.clip_to(F.col("_fx"), F.col("_fy"), v_max)
    ready = ready.withColumn("_ax", ax).withColumn("_ay", ay)
    a = F.col("alpha_used")
    both = V.clip_to(a * F.col("_ax") + (1 - a) * F.col("_wx"), a * F.col("_ay") + (1 - a) * F.col("_wy"), v_max)
    return (
        ready.withColumn("ux", F.when(a == 0, F.col("_wx")).otherwise(both[0]))
        .withColumn("uy", F.when(a == 0, F.col("_wy")).otherwise(both[1]))
        .drop("_wx", "_wy", "_tx", "_ty", "_fx", "_fy", "_ax", "_ay")
    )


# --- evidence accumulation ---


def evidence_step(gamma: float, theta: float, epsilon: float) -> Callable:
    """One decoder update: leak, add log probability, emit and clear past the threshold."""

    def step(state, row):
        e = [gamma * s + math.log(float(v) + epsilon) for s, v in zip(state, row[0], strict=True)]
        top = max(e)
        if top > theta:
            return [0.0] * len(e), (e.index(top), top)
        return e, (-1, top)

    return step


def accumulate_evidence(
    updates: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, n_classes: int = 4,
    gamma: float = 0.8, theta: float = -1.0, epsilon: float = 1e-6, chunk_rows: int = series.CHUNK_ROWS,
) -> DataFrame:
    """Leaky evidence per series of decoder updates; ``emitted`` is a class or -1."""
    if not 0.0 <= gamma <= 1.0 or epsilon <= 0:
        raise ValueError("gamma must be in [0, 1] and epsilon positive")
    placed = series.dense_index(updates, keys, order, bucket, "update_no")
    return series.ordered_fold(
        placed, keys, "update_no", ["posterior"], n_classes,
        [("emitted", T.IntegerType()), ("evidence_max", T.DoubleType())],
        evidence_step(gamma, theta, epsilon), chunk_rows,
    )


def held_emission(
    emissions: DataFrame, steps: DataFrame, keys: Sequence[str], at: str, now: str, hold_s: float, step_columns: Sequence[str]
) -> DataFrame:
    """Class held at every step: the last emission stays active for ``hold_s``; -1 otherwise."""
    if hold_s <= 0:
        raise ValueError("hold_s must be positive")
    # Stored: the fold behind the emissions would otherwise run for each branch of the scan.
    fired = stored(emissions.where(F.col("emitted") >= 0).select(*keys, at, "emitted", F.col(at).alias("_fired")))
    out = asof.latest_available(fired, steps, keys, at, now, 0.0, ["emitted", "_fired"], step_columns)
    live = F.coalesce(F.col(now) - F.col("_fired") < hold_s, F.lit(False))
    return out.withColumn("held_class", F.when(live, F.col("emitted")).otherwise(-1)).drop("emitted", "_fired")


def class_command(k: Column, v_max: float = V_MAX, table: Table = DIRECTIONS) -> tuple[Column, Column]:
    """Command toward a class, zero for class -1."""
    safe = F.greatest(k, F.lit(0))
    return tuple(F.when(k >= 0, F.lit(v_max) * V.pick_const(safe, c)).otherwise(0.0) for c in (_xs(table), _ys(table)))


# --- registry ---

STATELESS: dict[str, Callable[..., tuple[Column, Column]]] = {
    "s1_argmax": argmax_command,
    "s2_weighted": lambda p, v_max=V_MAX, table=DIRECTIONS: weighted_command(p, v_max, False, table),
    "s2_weighted_entropy": lambda p, v_max=V_MAX, table=DIRECTIONS: weighted_command(p, v_max, True, table),
}


def apply_mapping(name: str, steps: DataFrame, v_max: float = V_MAX, table: Table = DIRECTIONS, **params) -> DataFrame:
    """Add ``ux, uy`` by mapping name.  Rows without a posterior get a zero command.

    ``s3_evidence`` expects ``held_class``; ``s4_shared`` expects positions and ``targets=``.
    """
    if name not in MAPPING_PARAMS:
        raise KeyError(f"unknown mapping {name!r}, available: {sorted(MAPPING_PARAMS)}")
    if name in STATELESS:
        ux, uy = STATELESS[name](F.col("posterior"), v_max=v_max, table=table)
        out = steps.withColumn("ux", ux).withColumn("uy", uy)
    elif name == "s3_evidence":
        ux, uy = class_command(F.col("held_class"), v_max, table)
        out = steps.withColumn("ux", ux).withColumn("uy", uy)
    else:
        out = shared_command(steps, v_max=v_max, table=table, **params)
    seen = F.col("posterior").isNotNull()
    return (
        out.withColumn("ux", F.when(seen, F.col("ux")).otherwise(0.0))
        .withColumn("uy", F.when(seen, F.col("uy")).otherwise(0.0))
        .withColumn("has_command", seen)
    )


def override_problems(cells: DataFrame) -> DataFrame:
    """Cells that set a parameter their mapping does not have; nulls are ignored."""
    has = lambda param: F.col("mapping").isin([m for m, ps in MAPPING_PARAMS.items() if param in ps])
    bad = F.array_compact(
        F.array(*[F.when(F.col(p).isNotNull() & ~has(p), F.lit(p)) for p in ("alpha", "intent_mode")])
    )
    return cells.withColumn("bad_params", F.array_join(bad, ",")).where(F.col("bad_params") != "")
