"""Scalar and vector expressions as Columns: all run inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scales of the structure and composite distortions, and the share of the structure term in the composite one.
STRUCTURE_SCALE, COMPOSITE_SCALE, STRUCTURE_SHARE = 0.05, 0.1, 0.7
#: Residue names by one-letter code.
RESIDUES = "ALA A ARG R ASN N ASP D CYS C GLN Q GLU E GLY G HIS H ILE I LEU L LYS K MET M PHE F PRO P SER S THR T TRP W TYR Y VAL V"


def stable_bucket(key: Column, buckets: int = 100) -> Column:
    """The first eight hex digits of the key's md5, modulo buckets: the same on every machine and in every release."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets


def split_of(bucket: Column, test: int = 10, valid: int = 20) -> Column:
    return F.when(bucket < test, "test").when(bucket < valid, "val").otherwise("train")


def pair_split(key1: Column, key2: Column) -> Column:
    """The split of both sides if they agree, else 'discard'."""
    one, other = split_of(stable_bucket(key1)), split_of(stable_bucket(key2))
    return F.when(one == other, one).otherwise("discard")


def valid_id(key: Column) -> Column:
    return F.coalesce((F.trim(key) != "") & (F.lower(F.trim(key)) != "nan"), F.lit(False))


def tm_d0(length: Column) -> Column:
    root = F.pow(F.greatest(length.cast("double") - 15, F.lit(0.0)), F.lit(1 / 3))
    return F.when(length <= 21, 0.5).otherwise(F.greatest(F.lit(0.5), F.lit(1.24) * root - 1.8))


def tm_term(distance: Column, d0: Column) -> Column:
    return 1 / (1 + F.pow(distance / d0, 2))


def similarity(raw: Column, scale: float = STRUCTURE_SCALE) -> Column:
    """exp(-raw / scale): 1 without distortion, falling strictly."""
    return F.exp(-raw.cast("double") / scale)


def unit_clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def target(kind: str, gw_raw: Column, fgw_raw: Column, tm: Column) -> Column:
    """The regression target by name."""
    known = {"structure": similarity(gw_raw), "composite": similarity(fgw_raw, COMPOSITE_SCALE), "tm_term": unit_clip(tm)}
    if kind not in known:
        raise ValueError(f"unknown target {kind!r}; known: {', '.join(known)}")
    return known[kind]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-9) -> Column:
    """a over its length; keep it in a column of its own if it is used often."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + eps))


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return F.least(F.greatest(dot(a, b) / ((norm(a) + eps) * (norm(b) + eps)), F.lit(-1.0)), F.lit(1.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0), lambda s, x: s + x))


def rigid(a: Column, rotation: list[list[float]], shift: list[float]) -> Column:
    """rotation times a, plus shift."""
    return F.array(*(sum((F.get(a, k) * r for k, r in enumerate(row)), F.lit(float(t))) for row, t in zip(rotation, shift, strict=True)))


def encode_numbers(a: Column) -> Column:
    """An array as text, six decimals each."""
    return F.array_join(F.transform(a, lambda x: F.format_string("%.6f", x.cast("double"))), " ")


def decode_numbers(text: Column, size: int = 12) -> Column:
    """Text of `size` numbers as an array; another size raises."""
    parts = F.split(F.trim(text), r"\s+")
    return F.when(F.size(parts) == size, F.transform(parts, lambda x: x.cast("double"))).otherwise(F.raise_error(F.concat(F.lit(f"expected {size} numbers: "), text)).cast("array<double>"))


def radial_basis(x: Column, centres: int = 16, most: float = 20.0) -> Column:
    """Gaussian bumps at evenly spaced centres, each as wide as their spacing."""
    step = most / (centres - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(centres - 1)), lambda k: F.exp(-F.pow((x - k * step) / step, 2)))


def calibrated(cos: Column) -> Column:
    return 0.5 * cos + 0.5


def log_length(length: Column) -> Column:
    return F.log1p(length.cast("double")) / math.log(1001)


def position_code(position: Column, width: int) -> Column:
    """Sine and cosine of the position at falling frequencies, in turn."""
    angle = lambda k: position / F.pow(F.lit(10000.0), 2 * F.floor(k / 2) / width)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k % 2 == 0, F.sin(angle(k))).otherwise(F.cos(angle(k))))


def pair_features(a: Column, b: Column) -> Column:
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def padded(a: Column, size: int, fill: Column) -> Column:
    return F.concat(a, F.array_repeat(fill, F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def residue_letter(name: Column) -> Column:
    words = RESIDUES.split()
    return F.create_map(*(F.lit(x) for x in words))[name]


def hierarchy(path: Column, levels: int) -> Column:
    """The first levels of a dotted path."""
    return F.substring_index(path, ".", levels)


def method_name(path: Column) -> Column:
    """A file's base name without its known endings, outermost first."""
    name = F.element_at(F.split(path, "/"), -1)
    for ending in (".gz", ".tsv", ".m8", ".ent", ".pdb", ".cif"):
        name = F.regexp_replace(name, ending.replace(".", r"\.") + "$", "")
    return name


def clock(seconds: Column) -> Column:
    """Hours, minutes and seconds of a duration, without leading zero units."""
    s = seconds.cast("bigint")
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
