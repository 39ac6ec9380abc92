"""Array arithmetic: probabilities, quantisers, bins, embeddings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F


def let(value, then):
    """then(value), with value computed once a row: inside a lambda, an outer expression would be computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(xs):
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs):
    return total(xs) / F.size(xs)


def stddev_pop(xs):
    """Population deviation; null for an empty array."""
    return F.when(F.size(xs) > 0, F.sqrt(let(mean(xs), lambda m: total(F.transform(xs, lambda x: (x - m) * (x - m)))) / F.size(xs)))


def softmax(logits):
    e = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(e, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_softmax(logits):
    moved = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: x - top))
    return let(moved, lambda m: let(F.log(total(F.transform(m, lambda x: F.exp(x)))), lambda s: F.transform(m, lambda x: x - s)))


def cross_entropy(logits, target):
    """Negative log-likelihood of class `target` (from 0)."""
    return -F.get(log_softmax(logits), target)


def entropy(p, eps: float = 1e-10):
    return -total(F.transform(p, lambda x: x * F.log(x + eps)))


def clipped_nll(p, eps: float = 1e-5):
    return -F.log(p + eps)


def top_k_top_p(logits, k: int = 0, p: float = 1.0):
    """logits with null where sampling may not go: all but the k largest, and the tail after probability p is reached.

    Ties are kept in array order; the entry that crosses p stays.
    """
    order = F.sort_array(F.transform(softmax(logits), lambda x, i: F.struct((-x).alias("np"), i.alias("i"))))
    ranked = F.aggregate(
        order,
        F.struct(F.lit(0.0).alias("cum"), F.array().cast("array<int>").alias("keep")),
        lambda acc, s: F.struct((acc["cum"] - s["np"]).alias("cum"), F.when(acc["cum"] <= p, F.concat(acc["keep"], F.array(s["i"]))).otherwise(acc["keep"]).alias("keep")),
        lambda acc: acc["keep"],
    )
    keep = F.slice(ranked, 1, k) if k else ranked
    return let(keep, lambda keep: F.transform(logits, lambda x, i: F.when(F.array_contains(keep, i), x)))


def lowest_mask(scores, n):
    """True where a score is below the score in place n of the ascending order."""
    return let(F.get(F.sort_array(scores), n), lambda cut: F.transform(scores, lambda s: s < cut))


def redistribute(p, old, ratio: float):
    """Probabilities with at most 1 - ratio left at index old; the rest grows in proportion."""

    def dealt(p):
        capped = let(1 - F.get(p, old), lambda rest: F.transform(p, lambda x, i: F.when(i == old, F.lit(1 - ratio)).otherwise(x / rest * ratio)))
        return F.when(F.get(p, old) > 1 - ratio, capped).otherwise(p)

    return let(p, dealt)


def bits_to_index(bits):
    """Bits, most significant first, to an integer."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("long"))


def index_to_bits(index, n: int):
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: (F.floor(index / F.pow(F.lit(2.0), i)) % 2).cast("int"))


def lfq(values):
    """Lookup-free quantisation: the index of the signs."""
    return bits_to_index(F.transform(values, lambda v: F.when(v > 0, 1).otherwise(0)))


def fsq_levels(index, levels):
    """Mixed-radix digits of an index, least significant first."""
    out, basis = [], 1
    for n in levels:
        out.append((F.floor(index / basis) % n).cast("int"))
        basis *= n
    return F.array(*out)


def fsq_index(digits, levels):
    basis, out = 1, F.lit(0).cast("long")
    for i, n in enumerate(levels):
        out = out + F.get(digits, F.lit(i)) * basis
        basis *= n
    return out


def fsq_codes(digits, levels):
    """Digits to codes in [-1, 1]."""
    return F.array(*[(F.get(digits, F.lit(i)) - n // 2) / F.lit(float(n // 2)) for i, n in enumerate(levels)])


def fsq_quantise(z, levels, eps: float = 1e-3):
    """Bounded and rounded digits of a vector."""
    out = []
    for i, n in enumerate(levels):
        half = (n - 1) * (1 + eps) / 2
        offset = 0.0 if n % 2 else 0.5
        out.append((F.rint(F.tanh(F.get(z, F.lit(i)) + math.atanh(offset / half)) * half - offset) + n // 2).cast("int"))
    return F.array(*out)


def coarse(x, per_octave: int = 256):
    """A whole number whose order agrees with that of a number: so many steps to each doubling. 0 for 0, null for null, the largest for nan."""
    step = lambda v: F.greatest(F.floor(F.log2(v) * per_octave) + 2000 * per_octave, F.lit(1).cast("long"))
    x = x.cast("double")
    top = F.lit(1 << 40)
    return F.when(F.isnan(x), top + 1).when(x == float("inf"), top).when(x == float("-inf"), -top).when(x > 0, step(x)).when(x < 0, -step(-x)).when(x == 0, F.lit(0).cast("long"))


def bin_index(x, low: float, high: float, bins: int):
    """Of bins - 1 equally spaced edges from low to high, how many x exceeds."""
    step = (high - low) / (bins - 2)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((x - low) / step))).cast("int")


def rbf(x, low: float, high: float, n: int):
    """Gaussian bumps at n centres."""
    centres = [low + (high - low) * i / (n - 1) for i in range(n)]
    width = (high - low) / n
    return F.array(*[F.exp(-F.pow((x - c) / width, 2)) for c in centres])


def sinusoid(index, size: int, longest: float = 2056.0):
    """Sine then cosine of index * pi / longest ** (2k / size)."""
    half = range(size // 2)
    args = [index * math.pi / longest ** (2 * k / size) for k in half]
    return F.array(*[F.sin(a) for a in args], *[F.cos(a) for a in args])


def expected_bin(logits, centre0: float, step: float):
    """Probability-weighted mean of equally spaced bin centres."""
    return F.aggregate(F.transform(softmax(logits), lambda p, i: p * (centre0 + i * step)), F.lit(0.0), lambda a, x: a + x)


def error_centre(i, bins, max_bin: float = 31.0):
    """Centre of error bin i (from 0): bins - 1 edges from 0 to max_bin, the last bin beyond the last edge."""
    return (i + 0.5) * (F.lit(max_bin) / (bins - 2))


def predicted_error(logits, max_bin: float = 31.0):
    """Aligned error expected from bin logits."""
    return total(F.transform(softmax(logits), lambda p, i: p * error_centre(i, F.size(logits), max_bin)))


def predicted_tm(logits, length, max_bin: float = 31.0):
    """TM-score expected from error-bin logits of one alignment."""
    d0 = tm_d0(F.greatest(length, F.lit(19)))
    return total(F.transform(softmax(logits), lambda p, i: p / (1 + F.pow(error_centre(i, F.size(logits), max_bin) / d0, 2))))


def sequence_log_likelihood(logits, tokens, first: int, last: int, terminals=(), mean: bool = True):
    """Log-likelihood of tokens 1.. of a sequence, each from the logits one place before, among classes first .. last.

    A terminal token at the end is not scored; one elsewhere after the start is an error.
    """
    ends = F.element_at(tokens, -1).isin(*terminals) if terminals else F.lit(False)
    n = F.size(tokens) - 1 - F.when(ends, 1).otherwise(0)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    score = lambda i: F.get(log_softmax(F.slice(F.get(logits, i - 1), first + 1, last - first + 1)), F.get(tokens, i) - first)
    checked = lambda i: F.when(F.get(tokens, i).isin(*terminals), F.raise_error(F.lit("terminal token inside a sequence")).cast("double")).otherwise(score(i)) if terminals else score(i)
    whole = total(F.transform(places, checked))
    return whole / F.nullif(F.size(places), F.lit(0)) if mean else whole


def both_ways(forward, backward):
    """Mean of a sequence's score read from left to right and reversed."""
    return (forward + backward) / 2


def tm_d0(length):
    return 1.24 * F.cbrt(length.cast("double") - 15) - 1.8


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_pool(rows, first: int, last):
    """Element-wise mean of rows[first..last] (from 0, end exclusive) of an array of vectors."""
    part = F.slice(rows, F.lit(first + 1), last - first)
    n = F.size(part)
    zero = F.transform(F.get(rows, F.lit(0)), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(part, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)), lambda x: x / n)
