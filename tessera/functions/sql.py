"""The engine's maps and scores as SQL functions of a session. They are SQL themselves, so plans with them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
_TOP = "array_max(transform(v, x -> abs(x)))"
FUNCTIONS = {
    "bank_dot": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", _DOT),
    "bank_l2": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x)"),
    "bank_unit": ("v ARRAY<FLOAT>", "ARRAY<FLOAT>", "transform(v, x -> float(x * float(1D / sqrt(bank_dot(v, v)))))"),
    "bank_scale": ("v ARRAY<FLOAT>", "FLOAT", f"float({_TOP} / 127F)"),
    "bank_q8": ("v ARRAY<FLOAT>", "ARRAY<TINYINT>", f"CASE WHEN {_TOP} = 0 THEN transform(v, x -> 0Y) ELSE transform(v, x -> tinyint(rint(x * float(127F / {_TOP})))) END"),
    "bank_lanes": ("q8 ARRAY<TINYINT>, scale FLOAT", "ARRAY<FLOAT>", "transform(q8, x -> float(x) * scale)"),
    "bank_part": ("v ARRAY<FLOAT>, offset INT, length INT", "ARRAY<FLOAT>", "slice(v, offset + 1, length)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
