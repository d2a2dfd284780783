"""Predicates shared by the contract rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

NUMERIC = r"(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\([0-9, ]*\))"
NUMERIC_ARRAY = f"^ARRAY<{NUMERIC}>$"


def relative_path(path: Column) -> Column:
    """Not absolute and without a parent component."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def non_empty(text: Column) -> Column:
    return text.isNotNull() & (F.length(text) > 0)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def kind_at(variant: Column, path: str) -> Column:
    """JSON kind found at a path: OBJECT<..>, ARRAY<..>, STRING, BIGINT, BOOLEAN, ..."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def number_at(variant: Column, path: str) -> Column:
    """Finite number at a path, NULL when absent, boolean, text or not finite."""
    value = F.try_variant_get(variant, path, "double")
    # Text and booleans also convert to a double, so their kinds are excluded.
    return F.when(finite(value) & ~kind_at(variant, path).isin("STRING", "BOOLEAN"), value)


def vector_ok(variant: Column, path: str, length: int) -> Column:
    """A JSON array of exactly ``length`` finite numbers.

    The merged element kind is read once; a text, boolean or mixed array has another.
    """
    values = F.try_variant_get(variant, path, "array<double>")
    numeric = kind_at(variant, path).rlike(NUMERIC_ARRAY)
    return F.coalesce(numeric & (F.size(values) == length) & F.forall(values, finite), F.lit(False))


def finite_vector(values: Column, length: int) -> Column:
    """A typed array of exactly ``length`` finite numbers."""
    return F.coalesce((F.size(values) == length) & F.forall(values, finite), F.lit(False))


def finite_matrix3(rows: Column) -> Column:
    """A typed 3x3 matrix of finite numbers, NULL when it is anything else."""
    return F.when((F.size(rows) == 3) & F.forall(rows, lambda r: finite_vector(r, 3)), rows)


def variant_keys(variant: Column, path: str = "$") -> Column:
    """Sorted keys of the JSON object at a path (NULL when not an object)."""
    return F.array_sort(F.map_keys(F.try_variant_get(variant, path, "map<string,variant>")))


def same_keys(found: Column, expected: Sequence[str]) -> Column:
    return F.coalesce(found == F.array(*[F.lit(k) for k in sorted(expected)]), F.lit(False))


def object_keys(raw: Column, path: str) -> Column:
    """Sorted distinct keys of the JSON object at a path (NULL when not an object)."""
    return F.array_sort(F.array_distinct(F.json_object_keys(F.get_json_object(raw, path))))


def missing_keys(raw: Column, path: str, expected: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in sorted(expected)])
    found = F.coalesce(object_keys(raw, path), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(wanted, found))


def unexpected_keys(raw: Column, path: str, expected: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in sorted(expected)])
    found = F.coalesce(object_keys(raw, path), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(found, wanted))


def exact_keys(raw: Column, path: str, expected: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in sorted(expected)])
    return F.coalesce(object_keys(raw, path) == wanted, F.lit(False))


def positive_definite3(m: Column) -> Column:
    """Symmetric 3x3 (relative 1e-7, absolute 1e-15) with three positive leading minors."""
    a = [[m[i][j] for j in range(3)] for i in range(3)]
    scale = F.greatest(*[F.abs(a[i][j]) for i in range(3) for j in range(3)])
    tolerance = F.greatest(scale * F.lit(1e-7), F.lit(1e-15))
    symmetric = (
        (F.abs(a[0][1] - a[1][0]) <= tolerance)
        & (F.abs(a[0][2] - a[2][0]) <= tolerance)
        & (F.abs(a[1][2] - a[2][1]) <= tolerance)
    )
    second = a[0][0] * a[1][1] - a[0][1] * a[1][0]
    third = determinant3(m)
    return F.coalesce(symmetric & (a[0][0] > 0) & (second > 0) & (third > 0), F.lit(False))


def determinant3(m: Column) -> Column:
    """Sarrus expansion of a 3x3 array column."""
    forward = [m[0][i] * m[1][(i + 1) % 3] * m[2][(i + 2) % 3] for i in range(3)]
    backward = [m[0][i] * m[1][(i + 2) % 3] * m[2][(i + 1) % 3] for i in range(3)]
    return forward[0] + forward[1] + forward[2] - backward[0] - backward[1] - backward[2]


def close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
