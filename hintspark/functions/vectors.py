"""Column functions on arrays of numbers, and lexical features of text pairs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hintspark.functions import text as X


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def alignment(a: Column, b: Column) -> Column:
    """Cosine, then 8 times each product, then each absolute difference, of two vectors."""
    return F.concat(F.array(cosine(a, b)), F.zip_with(a, b, lambda x, y: x.cast("double") * y * 8), F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def layer_norm(values: Column, epsilon: float = 1e-5) -> Column:
    """(x - mean) / sqrt(variance + epsilon) of an array."""
    mean = _sum(values) / F.size(values)
    bound = F.transform(F.array(F.struct(values.alias("v"), mean.alias("m"))), lambda s: F.struct(s["v"].alias("v"), s["m"].alias("m"), (_sum(F.transform(s["v"], lambda x: (x - s["m"]) * (x - s["m"]))) / F.size(s["v"])).alias("q")))
    return F.transform(bound, lambda s: F.transform(s["v"], lambda x: (x - s["m"]) / F.sqrt(s["q"] + epsilon)))[0]


def quantize_int8(values: Column) -> Column:
    """struct(codes, scale): whole numbers from -127 to 127, scale being the largest size / 127."""
    scale = F.array_max(F.transform(values, lambda x: F.abs(x.cast("double")))) / 127
    code = lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int")))
    return F.struct(F.when(scale > 0, F.transform(values, code)).otherwise(F.transform(values, lambda x: F.lit(0))).alias("codes"), scale.alias("scale"))


def quantize_ternary(values: Column, keep: float = 0.7) -> Column:
    """struct(codes, scale): -1, 0 or 1; values below keep times the mean size are 0, scale is the mean size of the others."""
    size = F.transform(values, lambda x: F.abs(x.cast("double")))
    least = _sum(size) / F.size(values) * keep
    kept = F.filter(size, lambda x: x >= least)
    return F.struct(F.transform(values, lambda x: F.when(F.abs(x.cast("double")) >= least, F.signum(x).cast("int")).otherwise(0)).alias("codes"), F.coalesce(F.try_divide(_sum(kept), F.size(kept).cast("double")), F.lit(0.0)).alias("scale"))


def mean_pooled(vectors: Column, width: int) -> Column:
    """The mean of an array of vectors, scaled to length one; zeros without vectors."""
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(F.array(total), lambda t: F.transform(t, lambda x: F.coalesce(F.try_divide(x, F.sqrt(_sum(F.transform(t, lambda y: y * y)))), F.lit(0.0))))[0]


def softmax(logits: Column) -> Column:
    shifted = F.transform(F.array(F.array_max(logits)), lambda m: F.transform(logits, lambda x: F.exp(x - m)))[0]
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / _sum(e)))[0]


def lexical_features(query: Column, code: Column, with_length: bool = True) -> Column:
    """Sixteen overlap measures of a text pair: words, word pairs, trigrams, declared name, lengths."""
    q, d = X.identifier_tokens(query), X.identifier_tokens(code)
    name = X.identifier_tokens(X.declared_name(code))
    words = X.token_overlap(q, d)
    pairs = X.token_overlap(X.adjacent(q, "\x01"), X.adjacent(d, "\x01"))
    grams = X.token_overlap(X.char_trigrams(q), X.char_trigrams(d))
    names = X.token_overlap(q, name)
    name_grams = X.token_overlap(X.char_trigrams(q), X.char_trigrams(name))
    nq, nd = F.size(q), F.size(d)
    one, zero = F.lit(1.0), F.lit(0.0)
    lengths = [F.log1p(nq) / 8, F.log1p(nd) / 8, F.least(nq, nd) / F.greatest(nq, nd, F.lit(1)), F.log1p(nq) / 8 * F.log1p(nd) / 8] if with_length else [zero] * 4
    return F.array(
        one, words["recall"], words["jaccard"], words["cosine"], pairs["recall"], pairs["jaccard"], grams["dice"], names["recall"], name_grams["dice"],
        words["recall"] * words["recall"], pairs["recall"] * pairs["recall"], words["recall"] * names["recall"], *lengths,
    )
