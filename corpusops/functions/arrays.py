"""Row-wise kernels on token-id arrays and numeric vectors, all inside Catalyst.

Null arrays give null. Vectors are array<double>; arithmetic follows array order, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusops.functions.answers import let


def pad_or_cut(ids: Column, size: int, pad: int) -> Column:
    """Exactly ``size`` ids: cut at the right or filled with ``pad``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), size)), 1, size)


def effective_length(ids: Column, condition: Column, condition_cap: int, most: int) -> Column:
    return F.least(F.size(ids) + F.least(F.size(condition), F.lit(condition_cap)), F.lit(most))


def joined(condition: Column, ids: Column, condition_cap: int) -> Column:
    return F.concat(F.slice(condition, 1, condition_cap), ids)


def before_first(ids: Column, mark: int) -> Column:
    """1 up to and with the first ``mark``, 0 after it; all 1 without one."""
    at = F.array_position(ids, mark)
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def shift_left(ids: Column, by: Column, pad: int) -> Column:
    """Drops ``by`` ids at the left and fills at the right."""
    n = F.size(ids)
    k = F.least(F.greatest(by, F.lit(0)), n)
    return F.concat(F.slice(ids, k + 1, n), F.array_repeat(F.lit(pad), k))


def extract_response(ids: Column, condition_length: Column, cap: int, eos: int, pad: int) -> Column:
    """(ids, eos, length): after the prompt, at most ``cap`` ids, ended at the first eos; length counts it, the tail is pad."""
    tail = F.slice(ids, F.greatest(condition_length, F.lit(0)) + 1, cap)
    at = F.array_position(tail, eos)
    kept = F.when(at > 0, F.slice(tail, 1, (at - 1).cast("int"))).otherwise(tail)
    length = F.when(at > 0, at).otherwise(F.size(tail)).cast("int")
    return F.struct(F.slice(F.concat(kept, F.array_repeat(F.lit(pad), cap)), 1, cap).alias("ids"), (at > 0).alias("eos"), length.alias("length"))


def content_mask(ids: Column, special: list[int]) -> Column:
    return F.transform(ids, lambda x: F.when(x.isin(special), 0).otherwise(1))


def find_unique(ids: Column, wanted: Column) -> Column:
    """1-based place of the only occurrence of a sub-array; null for none, several or an empty one."""
    n, k = F.size(ids), F.size(wanted)
    hits = F.filter(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: (F.slice(ids, i, k) == wanted))
    return F.when((k > 0) & (k <= n) & (F.size(hits) == 1), F.element_at(hits, 1))


def condition_mask(condition_length: Column, length: Column, size: int) -> Column:
    """0 padding, 1 condition, 2 response."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.when(i <= condition_length, 1).when(i <= length, 2).otherwise(0))


def attention_mask(condition_length: Column, length: Column, size: int, kind: str) -> Column:
    """size x size mask of what row i may see: 'full' all real places, 'causal' none later, 'directional' the condition only itself, the response all."""
    place = F.sequence(F.lit(1), F.lit(size))

    def cell(i: Column, j: Column) -> Column:
        real = (i <= length) & (j <= length)
        if kind == "causal":
            real = real & (j <= i)
        elif kind == "directional":
            real = real & ((i > condition_length) | (j <= condition_length))
        return F.when(real, 1).otherwise(0)

    return F.transform(place, lambda i: F.transform(place, lambda j: cell(i, j)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def standardise(v: Column, eps: float = 1e-6) -> Column:
    """(x - mean) / sqrt(unbiased variance + eps)."""

    def scaled(centred: Column) -> Column:
        return let(F.sqrt(dot(centred, centred) / (F.size(v) - 1) + F.lit(eps)), lambda scale: F.transform(centred, lambda x: x / scale))

    return let(let(mean(v), lambda m: F.transform(v, lambda x: x - m)), scaled)


def cosine_distance(a: Column, b: Column) -> Column:
    """max(0, 1 - cosine); null where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), 1 - dot(a, b) / norm))


def smooth_l1(a: Column, b: Column, beta: float = 0.05) -> Column:
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return mean(F.transform(d, lambda x: F.when(x < beta, 0.5 * x * x / beta).otherwise(x - 0.5 * beta)))


def interpolate(clean: Column, noise: Column, t: Column, scale: float) -> Column:
    return F.zip_with(clean, noise, lambda x, e: t * x + (1 - t) * e * scale)


def velocity(clean: Column, z: Column, t: Column, eps: float) -> Column:
    return F.zip_with(clean, z, lambda x, y: (x - y) / F.greatest(1 - t, F.lit(eps)))


def uniform(*key: Column, seed: int = 0) -> Column:
    """A uniform draw in (0, 1) that depends on the key only, never on partitions."""
    return ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11)).cast("double") + 0.5) / F.lit(float(2**53))


def normal(*key: Column, seed: int = 0) -> Column:
    """A standard normal draw from two uniforms of the key."""
    return F.sqrt(-2 * F.log(uniform(*key, seed=seed))) * F.cos(2 * F.pi() * uniform(*key, seed=seed + 1))


def valid_mask(condition_length: Column, generated: int | None, size: int) -> Column:
    """1 for the places of the condition and ``generated`` more, 0 after them; all 1 without a bound."""
    place = F.sequence(F.lit(0), F.lit(size - 1))
    return F.transform(place, lambda i: F.lit(1) if generated is None else F.when(i < condition_length + generated, 1).otherwise(0))


def drop_condition(mask: Column, dropped: Column) -> Column:
    """A condition mask (1 condition, 2 response) whose condition counts as padding where ``dropped`` holds."""
    return F.when(dropped, F.transform(mask, lambda x: F.when(x == 1, 0).otherwise(x))).otherwise(mask)


def averaged(values: Column, decay: float) -> Column:
    """The exponential average of an array in order, started at its first value: d * average + (1 - d) * value. Null for an empty one."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.element_at(values, 1), lambda s, x: s * decay + x * (1 - decay)))


def masked_mean(values: Column, mask: Column) -> Column:
    """(mean, valid): the mean of the values whose mask is not 0, 0 without one, and the share of those."""
    n = F.aggregate(mask, F.lit(0.0), lambda s, x: s + x)
    held = total(F.zip_with(values, mask, lambda x, m: x * m))
    return F.struct((held / F.greatest(n, F.lit(1.0))).alias("mean"), (n / F.greatest(F.size(mask), F.lit(1))).alias("valid"))


def chat_positions(prefix: int, condition: Column, bridge: int, ids: Column) -> Column:
    """Where, counted from 0, the ids of condition and response stand in prefix + condition + bridge + response + suffix."""
    n = F.size(condition)
    run = lambda start, size: F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: start + i - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(run(F.lit(prefix), n).alias("condition"), run(n + prefix + bridge, F.size(ids)).alias("response"))
