"""Quantisation and companding of signals already scaled to a known range."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantize(col, bits: int = 8, epsilon: float = 0.01) -> Column:
    """[0, 1] to whole levels 0 .. 2**bits - 1."""
    return F.floor(_c(col) * ((1 << bits) - epsilon) + epsilon / 2).cast("int")


def dequantize(col, bits: int = 8) -> Column:
    return _c(col) / F.lit(float((1 << bits) / 2)) - 1


def zero_level(bits: int = 8) -> int:
    """Level that stands for 0.0."""
    return 1 << (bits - 1)


def mu_law_encode(col, bits: int = 8, variant: str = "quantize") -> Column:
    """[-1, 1] to whole levels by mu-law. ``quantize`` rounds through ``quantize``; ``round`` adds one half and cuts;
    ``round_shifted`` does the same with the tiny shift that ``quantize`` has too."""
    mu = float((1 << bits) - 1)
    x = _c(col)
    shifted = x if variant == "round" else x + 1e-8
    level = F.signum(x) * F.log1p(mu * F.abs(shifted)) / F.log1p(F.lit(mu))
    unit = (level + 1) / 2
    if variant == "quantize":
        return quantize(unit, bits)
    if variant not in ("round", "round_shifted"):
        raise ValueError(f"unknown variant {variant!r}")
    return F.floor(unit * mu + 0.5).cast("int")


def mu_law_decode(col, bits: int = 8, variant: str = "quantize") -> Column:
    mu = float((1 << bits) - 1)
    x = dequantize(col, bits) if variant == "quantize" else _c(col) / mu * 2 - 1
    return F.signum(x) * (F.pow(F.lit(1 + mu), F.abs(x)) - 1) / mu
