"""Quantised storage and back: affine maps between whole numbers and measured values, with a sentinel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of storage types by name.
LIMITS = {
    "bool": (0, 1), "uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767),
    "uint32": (0, 2**32 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1),
}
FLOATS = {"float32": 3.4028234663852886e38, "float64": 1.7976931348623157e308}


def representable(value, dtype: str) -> bool:
    """Whether a storage type can hold a value exactly enough to be compared with."""
    if dtype.startswith("complex"):
        return True
    if isinstance(value, complex):
        return value.imag == 0 and representable(value.real, dtype)
    if dtype in FLOATS:
        return value != value or abs(value) in (float("inf"),) or abs(value) <= FLOATS[dtype]
    low, high = LIMITS[dtype]
    return value == value and abs(value) != float("inf") and value == int(value) and low <= value <= high


@dataclass(frozen=True)
class Quantization:
    """What a stored number stands for."""

    quant_max: float
    quant_min: float = 0
    orig_min: float = 0.0
    orig_max: float = 1.0
    nodata: float | None = None
    orig_dtype: str = "float32"
    quant_dtype: str | None = None

    @staticmethod
    def of(value) -> Quantization | None:
        if value is None or isinstance(value, Quantization):
            return value
        return Quantization(**{k: v for k, v in value.items() if k in Quantization.__dataclass_fields__})

    @property
    def factor(self) -> float:
        extent = self.quant_max - self.quant_min
        return 0.0 if extent == 0 else (self.orig_max - self.orig_min) / extent

    def dequantize(self, value: Column, missing: str = "nan") -> Column:
        """Measured value; the sentinel is missing unless the stored type couldn't hold it. NULL stays NULL."""
        out = (value.cast("double") - F.lit(float(self.quant_min))) * F.lit(self.factor) + F.lit(float(self.orig_min))
        if self.nodata is None or (self.quant_dtype and not representable(self.nodata, self.quant_dtype)):
            return out
        none = F.lit(float("nan")) if missing == "nan" else F.lit(None).cast("double")
        return F.when(value == F.lit(self.nodata), none).otherwise(out)


def quantize_float01(value: Column, old_min: float = 0.0, old_max: float = 1.0, dtype: str = "int16") -> tuple[Column, Quantization]:
    """Clip, scale, truncate; NaN and NULL become the sentinel. Returns the column and how to read it."""
    low, high = LIMITS[dtype]
    quant_min, nodata = (0, max(-9999, low)) if low < 0 else (1, 0)
    factor = (high - quant_min) / (old_max - old_min)
    clipped = F.greatest(F.least(value.cast("double"), F.lit(float(old_max))), F.lit(float(old_min)))
    whole = ((clipped - F.lit(float(old_min))) * F.lit(factor) + F.lit(float(quant_min))).cast("bigint")
    stored = F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(nodata).cast("bigint")).otherwise(whole)
    return stored, Quantization(high, quant_min, old_min, old_max, nodata, "float32", dtype)
