"""Column expressions over fixed-length vectors. Dimensions are unpacked, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def at(v: Column, i: int) -> Column:
    """Element i (from 0) as double; null if the vector is shorter."""
    return F.get(v, F.lit(i)).cast("double")


def dims(v: Column, n: int) -> list[Column]:
    return [at(v, i) for i in range(n)]


def norm(v: Column, which: Sequence[int]) -> Column:
    """L2 norm over some dimensions; those the vector lacks are ignored, none give 0."""
    parts = [F.coalesce(at(v, i) * at(v, i), F.lit(0.0)) for i in which]
    return F.sqrt(sum(parts, F.lit(0.0)))


def normalize(v: Column, stats: dict[str, Sequence[float]], mode: str, inverse: bool = False, eps: float = EPS) -> Column:
    """Normalize by the mode mean_std, min_max, quantiles (q01, q99), quantile10 (q10, q90) or identity; no clipping.

    A range of zero counts as eps. mean_std divides by std + eps and comes back by std alone.
    """
    if mode == "identity":
        return v
    if mode == "mean_std":
        mean, std = stats["mean"], stats["std"]
        if inverse:
            return F.array(*[at(v, i) * s + m for i, (m, s) in enumerate(zip(mean, std))])
        return F.array(*[(at(v, i) - m) / (s + eps) for i, (m, s) in enumerate(zip(mean, std))])
    low, high = {"min_max": ("min", "max"), "quantiles": ("q01", "q99"), "quantile10": ("q10", "q90")}[mode]
    out = []
    for i, (a, b) in enumerate(zip(stats[low], stats[high])):
        span = b - a if b != a else eps
        out.append((at(v, i) + 1.0) * span / 2.0 + a if inverse else 2.0 * (at(v, i) - a) / span - 1.0)
    return F.array(*out)


def normalize_clipped(v: Column, stats: dict[str, Sequence[float]], mode: str, eps: float = EPS) -> Column:
    """The variant for action tokens: divides by at least eps, and clips to the range in the quantile modes."""
    if mode == "identity":
        return v
    if mode == "mean_std":
        return F.array(*[(at(v, i) - m) / max(s, eps) for i, (m, s) in enumerate(zip(stats["mean"], stats["std"]))])
    low, high = {"min_max": ("min", "max"), "quantiles": ("q01", "q99"), "quantile10": ("q10", "q90")}[mode]
    out = []
    for i, (a, b) in enumerate(zip(stats[low], stats[high])):
        x = at(v, i) if mode == "min_max" else F.greatest(F.lit(a), F.least(F.lit(b), at(v, i)))
        out.append(2.0 * (x - a) / max(b - a, eps) - 1.0)
    return F.array(*out)


def min_max_masked(v: Column, low: Sequence[float], high: Sequence[float], width: int) -> tuple[Column, Column]:
    """(values, mask): min-max to [-1, 1] with 0 where the range is zero, padded or cut to width; the mask tells real dimensions."""
    out = [F.lit(0.0) if a == b else 2.0 * (at(v, i) - a) / (b - a) - 1.0 for i, (a, b) in enumerate(zip(low, high))][:width]
    n = len(out)
    return F.array(*out, *[F.lit(0.0)] * (width - n)), F.array(*[F.lit(True)] * n, *[F.lit(False)] * (width - n))


def pad(v: Column, width: int, cut: bool = False) -> Column:
    """Zeros up to width; a longer vector is cut only if asked for."""
    padded = F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(width) - F.size(v), F.lit(0))))
    return F.slice(padded, 1, width) if cut else padded


def digitize(x: Column, bins: int = 256) -> Column:
    """Bin of x among ``bins`` equal ones over [-1, 1): -1 below, the last one above; x is compared as float."""
    f = x.cast("float").cast("double")
    # the edges are floats: multiples of 2 / bins are exact for powers of two
    return F.when(f.isNull(), None).when(f < -1.0, -1).otherwise(F.least(F.lit(bins - 1), F.floor((f + 1.0) * (bins / 2.0)))).cast("int")


def two_hot(x: Column, bins: int, low: float, high: float) -> Column:
    """x as weights of the two bin centres around it: struct(low_bin, low_weight, high_bin, high_weight)."""
    step = (high - low) / (bins - 1)
    pos = F.greatest(F.lit(0.0), F.least(F.lit(float(bins - 1)), (x.cast("double") - low) / step))
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    w = pos - lo
    return F.struct(lo.alias("low_bin"), F.when(lo == hi, 1.0).otherwise(1.0 - w).alias("low_weight"), hi.alias("high_bin"), F.when(lo == hi, 0.0).otherwise(w).alias("high_weight"))


def expected_value(logits: Column, low: float, high: float) -> Column:
    """Expectation of evenly spaced bin centres under softmax(logits)."""
    top = F.array_max(logits).cast("double")
    n = F.size(logits)
    parts = F.transform(logits, lambda x, i: F.struct(F.exp(x.cast("double") - top).alias("e"), (F.lit(low) + i * (high - low) / F.greatest(n - 1, F.lit(1))).alias("c")))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    return F.aggregate(parts, zero, lambda a, p: F.struct((a["s"] + p["e"] * p["c"]).alias("s"), (a["w"] + p["e"]).alias("w")), lambda a: a["s"] / a["w"])


def soft_cross_entropy(logits: Column, target: Column) -> Column:
    """-sum(target * log softmax(logits)); target holds weights of the same length."""
    top = F.array_max(logits).cast("double")
    log_sum = F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))) + top
    return F.aggregate(F.zip_with(logits, target, lambda x, t: t.cast("double") * (log_sum - x.cast("double"))), F.lit(0.0), lambda a, x: a + x)


def subtract_dims(v: Column, base: Column, which: Sequence[int], n: int) -> Column:
    """v minus base on some dimensions only."""
    return F.array(*[at(v, i) - at(base, i) if i in set(which) else at(v, i) for i in range(n)])


# --- rotations: quaternions are (x, y, z, w), matrices are rows of length 3 ---


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x bound once: composed rotations would otherwise repeat their arguments exponentially."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def quat_to_axis_angle(q: Column) -> Column:
    """Axis times angle; zero if the rotation is (nearly) none."""

    def run(q: Column) -> Column:
        w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at(q, 3)))
        den = F.sqrt(F.greatest(F.lit(0.0), 1.0 - w * w))
        k = F.when(den > 1e-10, 2.0 * F.acos(w) / F.when(den > 1e-10, den))
        return F.array(*[F.coalesce(at(q, i) * k, F.lit(0.0)) for i in range(3)])

    return let(q, run)


def rotvec_to_quat(v: Column) -> Column:
    """Quaternion of a rotation vector; for tiny angles by the series of sin(a/2)/a."""

    def run(v: Column) -> Column:
        a = norm(v, range(3))
        s = F.when(a < 1e-8, 0.5 - a * a / 48.0).otherwise(F.sin(a / 2.0) / F.when(a >= 1e-8, a))
        return F.array(*[at(v, i) * s for i in range(3)], F.cos(a / 2.0))

    return let(v, run)


def quat_to_rotvec(q: Column) -> Column:
    """Rotation vector of a quaternion, angle in [0, pi]."""

    def run(q: Column) -> Column:
        flip = F.when(at(q, 3) < 0, -1.0).otherwise(1.0)
        s = norm(q, range(3))
        k = F.when(s < 1e-8, 2.0).otherwise(2.0 * F.atan2(s, at(q, 3) * flip) / F.when(s >= 1e-8, s))
        return F.array(*[at(q, i) * flip * k for i in range(3)])

    return let(q, run)


def quat_multiply(p: Column, q: Column) -> Column:
    """Rotation q first, then p."""

    def run(p: Column, q: Column) -> Column:
        (a, b, c_, d), (e, f, g, h) = dims(p, 4), dims(q, 4)
        return F.array(d * e + a * h + b * g - c_ * f, d * f - a * g + b * h + c_ * e, d * g + a * f - b * e + c_ * h, d * h - a * e - b * f - c_ * g)

    return let(p, lambda p: let(q, lambda q: run(p, q)))


def quat_inverse(q: Column) -> Column:
    return F.transform(q, lambda x, i: F.when(i < 3, -x).otherwise(x))


def quat_to_matrix(q: Column) -> Column:
    """Nine elements, row by row."""

    def run(q: Column) -> Column:
        x, y, z, w = dims(q, 4)
        return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))

    return let(q, run)


def quat_apply(q: Column, v: Column) -> Column:
    """The vector turned by the quaternion."""
    turn = lambda m, v: F.array(*[at(m, 3 * i) * at(v, 0) + at(m, 3 * i + 1) * at(v, 1) + at(m, 3 * i + 2) * at(v, 2) for i in range(3)])
    return let(quat_to_matrix(q), lambda m: let(v, lambda v: turn(m, v)))


def matrix_to_quat(m: Column) -> Column:
    """Quaternion of a matrix of nine, by the largest of the four diagonal sums."""

    def run(m: Column) -> Column:
        d = dims(m, 9)
        sums = F.array(d[0] - d[4] - d[8], d[4] - d[0] - d[8], d[8] - d[0] - d[4], d[0] + d[4] + d[8])

        def by(sums: Column) -> Column:
            top = F.array_max(sums)

            def case(s: Column) -> Column:
                x = F.array(s / 4, (d[1] + d[3]) / s, (d[2] + d[6]) / s, (d[7] - d[5]) / s)
                y = F.array((d[1] + d[3]) / s, s / 4, (d[5] + d[7]) / s, (d[2] - d[6]) / s)
                z = F.array((d[2] + d[6]) / s, (d[5] + d[7]) / s, s / 4, (d[3] - d[1]) / s)
                w = F.array((d[7] - d[5]) / s, (d[2] - d[6]) / s, (d[3] - d[1]) / s, s / 4)
                return F.when(top == at(sums, 3), w).when(top == at(sums, 0), x).when(top == at(sums, 1), y).otherwise(z)

            return let(2.0 * F.sqrt(1.0 + top), case)

        return let(sums, by)

    return let(m, run)


def _unit(v: Column) -> Column:
    return let(v, lambda v: let(norm(v, range(3)), lambda n: F.array(*[at(v, i) / n for i in range(3)])))


def six_d_to_axis_angle(v: Column) -> Column:
    """The first two columns of a rotation matrix, made orthonormal by Gram-Schmidt, as axis times angle."""
    dot = lambda a, b: sum((at(a, i) * at(b, i) for i in range(3)), F.lit(0.0))
    cross = lambda a, b: F.array(at(a, 1) * at(b, 2) - at(a, 2) * at(b, 1), at(a, 2) * at(b, 0) - at(a, 0) * at(b, 2), at(a, 0) * at(b, 1) - at(a, 1) * at(b, 0))
    rows = lambda x, y, z: F.array(*[at(k, i) for i in range(3) for k in (x, y, z)])

    def run(v: Column) -> Column:
        b = F.slice(v, 4, 3)

        def with_x(x: Column) -> Column:
            rest = let(dot(x, b), lambda d: F.array(*[at(b, i) - d * at(x, i) for i in range(3)]))
            return let(_unit(rest), lambda y: let(cross(x, y), lambda z: rows(x, y, z)))

        return let(_unit(F.slice(v, 1, 3)), with_x)

    return quat_to_rotvec(matrix_to_quat(let(v, run)))


# --- control steps ---


def delta_to_target(dx: Column, dy: Column, dz: Column, gripper: Column, scale: float = 1.0, noise: float = 1e-3) -> Column:
    """Target of a delta command: enabled if its length is above the noise; scaled positions, zero rotations, gripper speed."""
    size = F.sqrt(dx * dx + dy * dy + dz * dz)
    zero = F.lit(0.0)
    return F.struct((size > noise).alias("enabled"), (dx * scale).alias("target_x"), (dy * scale).alias("target_y"), (dz * scale).alias("target_z"), zero.alias("target_wx"), zero.alias("target_wy"), zero.alias("target_wz"), gripper.cast("double").alias("gripper_vel"))


def gripper_penalty(state: Column, action: Column, penalty: float = -0.01, most: float = 30.0) -> Column:
    """The penalty where a closed gripper is closed or an open one opened, else 0."""
    s, a = state / most, action / most
    return F.when(((s < 0.5) & (a > 0.5)) | ((s > 0.75) & (a < 0.5)), penalty).otherwise(penalty * 0)


def gripper_position(pos: Column, speed: Column, gain: float = 1.0, low: float = 0.0, high: float = 100.0, discrete: bool = False) -> Column:
    """Position after a speed command, clipped; a discrete command 0, 1, 2 is closing, staying, opening."""
    v = (speed - 1.0) * high if discrete else speed
    return F.greatest(F.lit(low), F.least(F.lit(high), pos + v * gain))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def phone_to_target(enabled: Column, pos: Column, rot: Column, up: Column, down: Column) -> Column:
    """Robot target of a phone's pose: axes swapped and turned, gripper by two buttons."""
    on = lambda x: F.when(enabled, x).otherwise(0.0)
    return F.struct(enabled.alias("enabled"), on(-at(pos, 1)).alias("target_x"), on(at(pos, 0)).alias("target_y"), on(at(pos, 2)).alias("target_z"), on(at(rot, 1)).alias("target_wx"), on(at(rot, 0)).alias("target_wy"), on(-at(rot, 2)).alias("target_wz"), (up.cast("double") - down.cast("double")).alias("gripper_vel"))


def image_to_chw(pixels: Column, height: int, width: int, channels: int, mean: Sequence[float] | None = None, std: Sequence[float] | None = None) -> Column:
    """Bytes of height x width x channels as numbers in [0, 1], channel by channel; normalized if mean and std are given."""

    def one(k: Column) -> Column:
        channel = F.floor(k / (height * width)).cast("int")
        x = F.element_at(pixels, ((k % (height * width)) * channels + channel + 1).cast("int")).cast("double") / 255.0
        if mean is None or std is None:
            return x
        pick = lambda values: F.element_at(F.array(*[F.lit(float(m)) for m in values]), channel + 1)
        return (x - pick(mean)) / pick(std)

    return F.transform(F.sequence(F.lit(0), F.lit(height * width * channels - 1)), one)


def crop(pixels: Column, height: int, width: int, channels: int, top: int, left: int, h: int, w: int) -> Column:
    """A rectangle of an image of height x width x channels, cut to what the image has."""
    bottom, right = min(height, top + h), min(width, left + w)
    rows = [F.slice(pixels, (y * width + left) * channels + 1, max(0, right - left) * channels) for y in range(top, bottom)]
    return F.concat(*rows)



def resize(pixels: Column, height: int, width: int, channels: int, h: int, w: int) -> Column:
    """An image of height x width x channels at h x w, each value bilinear between the four around its place."""

    def place(k: Column, own: int, to: int) -> tuple[Column, Column, Column]:
        x = F.greatest(F.lit(0.0), F.least(F.lit(own - 1.0), (k + 0.5) * own / to - 0.5))
        low = F.floor(x).cast("int")
        return low, F.least(low + 1, F.lit(own - 1)), x - low

    def one(k: Column) -> Column:
        y0, y1, fy = place(F.floor(k / (w * channels)), height, h)
        x0, x1, fx = place(F.floor(k / channels) % w, width, w)
        get = lambda y, x: F.element_at(pixels, (y * width + x) * channels + (k % channels).cast("int") + 1).cast("double")
        row = lambda y: get(y, x0) * (1.0 - fx) + get(y, x1) * fx
        return row(y0) * (1.0 - fy) + row(y1) * fy

    return F.transform(F.sequence(F.lit(0), F.lit(h * w * channels - 1)), one)
