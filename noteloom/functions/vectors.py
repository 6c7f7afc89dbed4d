"""Vector functions over arrays of numbers and packed bits, as Spark columns, and as SQL functions after register().

Float and integer vectors are arrays; bit vectors are binaries, eight dimensions a byte, the lowest
bit first. Operands of unequal size raise an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERSION = "v0.1.9"


def checked(a: Column, b: Column, value: Column) -> Column:
    """value, if a and b have the same number of dimensions."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension"))).otherwise(value)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda t, y: t + y)


def _wide(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def _some(v: Column, text: Column) -> Column:
    """v, if it is a vector with parts, all of them there; a null text is a null vector."""
    bad = text.isNotNull() & (v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull()))
    return F.when(bad, F.raise_error(F.lit("no vector, or an empty one"))).otherwise(v)


def vec_f32(text: Column) -> Column:
    return _some(F.from_json(text, "array<float>"), text)


def vec_int8(text: Column) -> Column:
    wide = F.from_json(text, "array<int>")
    return F.when(F.exists(wide, lambda x: (x < -128) | (x > 127)), F.raise_error(F.lit("value outside int8"))).otherwise(_some(wide, text).cast("array<tinyint>"))


def vec_bit(v: Column) -> Column:
    """A binary as a bit vector."""
    return F.when(F.octet_length(v) == 0, F.raise_error(F.lit("no vector, or an empty one"))).otherwise(v)


def vec_f32_blob(v: Column) -> Column:
    """Little-endian singles, one after another, as a vector."""
    @F.pandas_udf("array<float>")
    def read(column: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            if not b or len(b) % 4:
                raise ValueError("no vector, or an empty one")
            return np.frombuffer(b, "<f4")

        return column.map(one)

    return read(v)


def vec_int8_blob(v: Column) -> Column:
    """Bytes with signs as a vector."""
    return F.when(F.octet_length(v) == 0, F.raise_error(F.lit("no vector, or an empty one"))).otherwise(F.transform(_bytes(v), lambda x: F.when(x > 127, x - 256).otherwise(x).cast("tinyint")))


def vec_length(v: Column) -> Column:
    return F.size(v)


def vec_length_bits(v: Column) -> Column:
    return F.octet_length(v) * 8


def vec_distance_l2(a: Column, b: Column) -> Column:
    return checked(a, b, F.sqrt(_sum(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y)))))


def vec_distance_l1(a: Column, b: Column) -> Column:
    return checked(a, b, _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: F.abs(x - y))))


def vec_distance_cosine(a: Column, b: Column) -> Column:
    """NaN beside a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return checked(a, b, F.when(size == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / F.nullif(size, F.lit(0.0))))


def _bytes(v: Column) -> Column:
    digits = F.hex(v)
    return F.transform(F.sequence(F.lit(1), F.octet_length(v)), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def vec_distance_hamming(a: Column, b: Column) -> Column:
    same = F.zip_with(_bytes(a), _bytes(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(F.octet_length(a) != F.octet_length(b), F.raise_error(F.lit("vectors differ in dimension"))).otherwise(F.aggregate(same, F.lit(0), lambda t, x: t + x))


def hamming_booleans(a: Column, b: Column) -> Column:
    return checked(a, b, F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)))


def vec_add(a: Column, b: Column) -> Column:
    return checked(a, b, F.zip_with(a, b, lambda x, y: x + y))


def vec_sub(a: Column, b: Column) -> Column:
    return checked(a, b, F.zip_with(a, b, lambda x, y: x - y))


def vec_add_int8(a: Column, b: Column) -> Column:
    """Sums that leave the range come round again."""
    return checked(a, b, F.zip_with(a.cast("array<int>"), b.cast("array<int>"), lambda x, y: (F.pmod(x + y + 128, F.lit(256)) - 128).cast("tinyint")))


def vec_sub_int8(a: Column, b: Column) -> Column:
    return checked(a, b, F.zip_with(a.cast("array<int>"), b.cast("array<int>"), lambda x, y: (F.pmod(x - y + 128, F.lit(256)) - 128).cast("tinyint")))


def vec_slice(v: Column, start: int, end: int) -> Column:
    """From start to end, which is not part of it; both from 0."""
    if not 0 <= start < end:
        raise ValueError("a slice needs 0 <= start < end")
    return F.when(F.size(v) < end, F.raise_error(F.lit("slice beyond the vector"))).otherwise(F.slice(v, start + 1, end - start))


def vec_normalize(v: Column) -> Column:
    """Parts of a zero vector become NaN."""
    size = F.sqrt(dot(v, v))
    return F.transform(_wide(v), lambda x: F.when(size == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, size)))


@F.arrow_udf(StringType())
def _json(v: pa.Array) -> pa.Array:
    def one(x: list | None) -> str | None:
        if x is None:
            return None
        x = [y for y in x if y is not None]
        return f"[{','.join(['%.6f'] * len(x)) % tuple(x)}]".replace("nan", "null")

    return pa.array(map(one, v.to_pylist()), pa.string())


def vec_to_json(v: Column) -> Column:
    """Six decimals of what each part is exactly, ties to the even digit, as C's printf has them: the JVM's formatter rounds ties up, and from the shortest form."""
    return _json(_wide(v))


def vec_to_json_int8(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def vec_to_json_bit(v: Column) -> Column:
    """A bit vector as zeros and ones, the lowest bit of each byte first."""
    bits = F.flatten(F.transform(_bytes(v), lambda x: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(x, k).cast("string"))))
    return F.concat(F.lit("["), F.array_join(bits, ","), F.lit("]"))


def vec_debug() -> str:
    import pyspark

    return f"version: {VERSION}\nengine: Spark {pyspark.__version__}"


def vec_quantize_binary(v: Column) -> Column:
    """Which parts are above 0."""
    return F.when(F.size(v) % 8 != 0, F.raise_error(F.lit("dimensions must be a multiple of 8"))).otherwise(F.transform(v, lambda x: x > 0))


def pack_bits(bits: Column) -> Column:
    """Booleans as a bit vector, the lowest bit first."""
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda t, k: t + F.when(F.get(bits, i * 8 + k), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), k).cast("int")).otherwise(0))
    digits = F.transform(F.sequence(F.lit(0), (F.size(bits) / 8).cast("int") - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def vec_quantize_int8(v: Column) -> Column:
    """Parts from -1 to 1 in 255 steps, cut towards zero; NaN is the highest."""
    step = lambda x: F.when(F.isnan(x), F.lit(127.0)).otherwise(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), (x + 1) / F.lit(2.0 / 255.0) - 128)))
    return F.transform(_wide(v), lambda x: step(x).cast("tinyint"))


def vec_type(kind: str) -> str:
    return {"array<float>": "float32", "array<tinyint>": "int8", "binary": "bit"}[kind]


METRICS = {"l2": vec_distance_l2, "l1": vec_distance_l1, "cosine": vec_distance_cosine, "hamming": hamming_booleans}


def register(spark: SparkSession) -> None:
    """SQL functions of the same names, as SQL bodies that Catalyst inlines; vec_to_json, which no SQL rounds exactly, is an Arrow function."""
    zero = "CAST(0 AS DOUBLE)"
    fold = lambda x: f"aggregate({x}, {zero}, (t, y) -> t + y)"
    pairs = "zip_with(CAST(a AS ARRAY<DOUBLE>), CAST(b AS ARRAY<DOUBLE>), (x, y) -> {})".format
    two = "a ARRAY<FLOAT>, b ARRAY<FLOAT>"
    size = f"(sqrt({fold('transform(CAST(a AS ARRAY<DOUBLE>), x -> x * x)')}) * sqrt({fold('transform(CAST(b AS ARRAY<DOUBLE>), x -> x * x)')}))"
    same = lambda value, a="size(a)", b="size(b)": f"CASE WHEN {a} <> {b} THEN raise_error('vectors differ in dimension') ELSE {value} END"
    some = lambda value, text: f"CASE WHEN {text} IS NOT NULL AND ({value} IS NULL OR size({value}) = 0 OR exists({value}, x -> x IS NULL)) THEN raise_error('no vector, or an empty one') ELSE {value} END"
    ints = "from_json(j, 'array<int>')"
    octets = "transform(sequence(1, octet_length({0})), i -> CAST(conv(substring(hex({0}), 2 * i - 1, 2), 16, 10) AS INT))".format
    squares = fold("transform(CAST(v AS ARRAY<DOUBLE>), z -> z * z)")
    made = {
        "vec_version() RETURNS STRING": f"'{VERSION}'",
        "vec_debug() RETURNS STRING": f"'{vec_debug()}'",
        "vec_f32(j STRING) RETURNS ARRAY<FLOAT>": some("from_json(j, 'array<float>')", "j"),
        "vec_int8(j STRING) RETURNS ARRAY<TINYINT>": f"CASE WHEN exists({ints}, x -> x < -128 OR x > 127) THEN raise_error('value outside int8') ELSE CAST({some(ints, 'j')} AS ARRAY<TINYINT>) END",
        "vec_bit(b BINARY) RETURNS BINARY": "CASE WHEN octet_length(b) = 0 THEN raise_error('no vector, or an empty one') ELSE b END",
        "vec_type(kind STRING) RETURNS STRING": "CASE kind WHEN 'array<float>' THEN 'float32' WHEN 'array<tinyint>' THEN 'int8' WHEN 'binary' THEN 'bit' ELSE raise_error('no type of vectors') END",
        "vec_length(v ARRAY<FLOAT>) RETURNS INT": "size(v)",
        f"vec_distance_l2({two}) RETURNS DOUBLE": same(f"sqrt({fold(pairs('(x - y) * (x - y)'))})"),
        f"vec_distance_l1({two}) RETURNS DOUBLE": same(fold(pairs("abs(x - y)"))),
        f"vec_distance_cosine({two}) RETURNS DOUBLE": same(f"coalesce(1 - try_divide({fold(pairs('x * y'))}, {size}), double('NaN'))"),
        "vec_distance_hamming(a BINARY, b BINARY) RETURNS INT": same(f"aggregate(zip_with({octets('a')}, {octets('b')}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)", "octet_length(a)", "octet_length(b)"),
        f"vec_add({two}) RETURNS ARRAY<FLOAT>": same("zip_with(a, b, (x, y) -> x + y)"),
        f"vec_sub({two}) RETURNS ARRAY<FLOAT>": same("zip_with(a, b, (x, y) -> x - y)"),
        "vec_slice(v ARRAY<FLOAT>, s INT, e INT) RETURNS ARRAY<FLOAT>": "CASE WHEN s < 0 OR s >= e THEN raise_error('a slice needs 0 <= start < end') WHEN e > size(v) THEN raise_error('slice beyond the vector') ELSE slice(v, s + 1, e - s) END",
        "vec_normalize(v ARRAY<FLOAT>) RETURNS ARRAY<DOUBLE>": f"transform(CAST(v AS ARRAY<DOUBLE>), x -> coalesce(try_divide(x, sqrt({squares})), double('NaN')))",
        "vec_quantize_binary(v ARRAY<FLOAT>) RETURNS ARRAY<BOOLEAN>": "CASE WHEN size(v) % 8 <> 0 THEN raise_error('dimensions must be a multiple of 8') ELSE transform(v, x -> x > 0) END",
        "vec_quantize_int8(v ARRAY<FLOAT>) RETURNS ARRAY<TINYINT>": "transform(CAST(v AS ARRAY<DOUBLE>), x -> CAST(if(isnan(x), 127D, greatest(-128D, least(127D, (x + 1) / (2D / 255D) - 128))) AS TINYINT))",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("vec_to_json", _json)
