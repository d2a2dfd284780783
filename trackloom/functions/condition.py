"""Physical-condition features of one dynamic object (struct columns).

Objects are ``STRUCT<object_id, mass_kg, inertia_tensor_camera_kg_m2, friction,
restitution, rolling_friction, spinning_friction, linear_damping, angular_damping,
initial_state STRUCT<...>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trackloom.contracts import MAX_OBJECTS

INERTIA_ENTRIES = ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))


def controls(obj: Column) -> Column:
    return F.array(obj["mass_kg"], obj["friction"], obj["restitution"])


def dynamics(obj: Column) -> Column:
    inertia = obj["inertia_tensor_camera_kg_m2"]
    return F.array(
        *[inertia[i][j] for i, j in INERTIA_ENTRIES],
        obj["rolling_friction"],
        obj["spinning_friction"],
        obj["linear_damping"],
        obj["angular_damping"],
    )


def initial_state(obj: Column, gravity: Column) -> Column:
    state = obj["initial_state"]
    return F.concat(
        state["linear_velocity_camera_m_s"], state["angular_velocity_camera_rad_s"], gravity
    )


def unit_range(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def state_features(state: Column) -> Column:
    """asinh(v), asinh(w / 5) and g / 9.81 of a nine-vector."""
    return F.transform(
        state,
        lambda x, i: F.when(i < 3, F.asinh(x))
        .when(i < 6, F.asinh(x / F.lit(5.0)))
        .otherwise(x / F.lit(9.81)),
    )


def direct_condition(objects: Column, slots: int = MAX_OBJECTS) -> Column:
    """Twelve values per slot, zero for empty slots.

    ``objects`` is an array of ``STRUCT<controls ARRAY, state ARRAY>``.
    """
    per_object = F.flatten(
        F.transform(
            objects,
            lambda o: F.concat(
                F.array(
                    F.log(F.greatest(o["controls"][0], F.lit(1e-6))),
                    F.log(F.greatest(o["controls"][1], F.lit(1e-4))),
                    F.lit(2.0) * unit_range(o["controls"][2]) - F.lit(1.0),
                ),
                state_features(o["state"]),
            ),
        )
    )
    padding = F.array_repeat(F.lit(0.0), F.lit(12 * slots) - F.size(per_object))
    return F.concat(per_object, padding)


def encoder_controls(c: Column) -> Column:
    return F.array(
        F.log(F.greatest(c[0], F.lit(1e-6))),
        F.log1p(F.greatest(c[1], F.lit(0.0))),
        unit_range(c[2]),
    )


def encoder_dynamics(values: Column) -> Column:
    return F.transform(
        values,
        lambda x, i: F.when(i < 6, F.signum(x) * F.log1p(F.abs(x) * F.lit(1000.0))).otherwise(
            F.log1p(F.greatest(x, F.lit(0.0)))
        ),
    )


def rescale_inertia(values: Column, old_mass: Column, new_mass: Column) -> Column:
    """Scale the six inertia entries by the mass ratio; NULL new mass changes nothing."""
    ratio = F.coalesce(new_mass / old_mass, F.lit(1.0))
    return F.transform(values, lambda x, i: F.when(i < 6, x * ratio).otherwise(x))


def control_value(obj: Column, axis: Column) -> Column:
    """The control an axis varies."""
    return (
        F.when(axis == "mass_kg", obj["mass_kg"])
        .when(axis == "contact_friction", obj["friction"])
        .when(axis == "contact_restitution", obj["restitution"])
    )


def scene_features(
    xyz: tuple[Column, Column, Column],
    normal: tuple[Column, Column, Column],
    body: Column,
    friction: Column,
    restitution: Column,
    intrinsics: Column,
) -> Column:
    """Twelve numeric features per scene point; materials only for the environment (body 0)."""
    zero = F.lit(0.0)
    return F.concat(
        F.array(*[F.asinh(c) for c in xyz]),
        F.array(*normal),
        F.array(
            F.when(body == 0, F.log1p(F.greatest(friction, zero))).otherwise(zero),
            F.when(body == 0, unit_range(restitution)).otherwise(zero),
        ),
        intrinsics,
    )


def collider_aliases(collider: Column, solid_wedge: Column) -> Column:
    """Array of (alias, reason) under which a collider may be represented."""
    def pair(alias: Column, reason: str) -> Column:
        return F.struct(alias.alias("alias"), F.lit(reason).alias("reason"))

    mesh = "environment_mesh_"
    return F.array_compact(
        F.array(
            pair(collider, "direct_collider_id"),
            F.when(
                solid_wedge, pair(F.lit("solid_ramp_wedge"), "solid_wedge_visual_replacement")
            ),
            F.when(
                collider == "support",
                pair(F.lit("support_visual_mesh"), "reviewed_support_mesh_replacement"),
            ),
            F.when(
                collider.startswith(mesh),
                pair(
                    F.concat(F.lit("scene_mesh_"), F.substr(collider, F.lit(len(mesh) + 1))),
                    "reviewed_environment_mesh_replacement",
                ),
            ),
        )
    )


def prompt_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
