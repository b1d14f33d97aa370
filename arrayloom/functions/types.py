"""Element types and conversions between them, as a static cast in C converts: no scaling, no clipping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from arrayloom.errors import UnsupportedError

#: Logical element type -> (bytes, Spark type); unsigned types go one step wider.
TYPES = {
    "boolean": (1, "boolean"), "int8": (1, "tinyint"), "int16": (2, "smallint"), "int32": (4, "int"), "int64": (8, "bigint"),
    "uint8": (1, "smallint"), "uint16": (2, "int"), "uint32": (4, "bigint"), "uint64": (8, "decimal(20,0)"),
    "float16": (2, "float"), "float32": (4, "float"), "float64": (8, "double"),
    "complex_float16": (4, "struct<re:float,im:float>"), "complex_float32": (8, "struct<re:float,im:float>"), "complex_float64": (16, "struct<re:double,im:double>"),
}
#: NumPy's names of types that are called otherwise here.
ALIASES = {"bool": "boolean", "complex64": "complex_float32", "complex128": "complex_float64"}
BITS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64, "uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}


def numerical_type(name: object) -> str:
    """The logical type's name for a name or a NumPy type; None is refused."""
    if name is None:
        raise TypeError("an element type is needed")
    text = name if isinstance(name, str) else np.dtype(name).name
    text = ALIASES.get(text, text)
    if text not in TYPES:
        raise ValueError(f"unknown element type: {name!r}")
    return text


def numpy_type(name: str) -> np.dtype:
    if name == "complex_float16":
        raise UnsupportedError("NumPy has no half complex type")
    return np.dtype({"boolean": "?", "complex_float32": "c8", "complex_float64": "c16"}.get(name, name))


def spark_type(name: str) -> str:
    return TYPES[name][1]


def convert(value: Column, source: str, target: str) -> Column:
    """A value of logical type ``source`` as ``target``.

    Fractions are cut off, integers keep their low bits, anything but 0 is true (NaN, too). Complex to real is
    refused; real to complex has no imaginary part.
    """
    source, target = numerical_type(source), numerical_type(target)
    if source.startswith("complex"):
        if not target.startswith("complex"):
            raise UnsupportedError(f"{source} can't become {target}")
        return value.cast(spark_type(target))
    if target.startswith("complex"):
        part = spark_type(target).split(":")[1].split(",")[0]
        return F.when(value.isNotNull(), F.struct(value.cast(part).alias("re"), F.lit(0).cast(part).alias("im")))
    if target == "boolean":
        return value if source == "boolean" else ~(value == 0)
    if target not in BITS:
        return value.cast("int").cast(spark_type(target)) if source == "boolean" else value.cast(spark_type(target))
    whole = value.cast("int") if source == "boolean" else value.cast("decimal(38,0)") if source in BITS else F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("decimal(38,0)")
    whole, span = whole.cast("decimal(38,0)"), F.lit(str(1 << BITS[target])).cast("decimal(38,0)")
    low = F.pmod(whole, span)
    if not target.startswith("u"):
        low = F.when(low >= F.lit(str(1 << BITS[target] - 1)).cast("decimal(38,0)"), low - span).otherwise(low)
    return low.cast(spark_type(target))
