"""Small payloads shared by the tests."""

import copy
import io
import json
import struct
import zlib

import numpy as np

AXES = ("mass_kg", "contact_friction", "contact_restitution")


def record(sample="s0", scene="scene0", split="train", mode="base", axis=None, level=2):
    return {
        "schema": "acme.video_condition_sample.v4",
        "sample_id": sample,
        "base_scene_id": scene,
        "split": split,
        "conditioning": {
            "first_frame": f"frames/{sample}.png",
            "scene": f"scenes/{scene}.npz",
            "scene_source": "simulation_gt",
            "text": "a box slides",
            "physics": {
                "source": "simulation_gt",
                "coordinate_frame": "camera_right_up_forward",
                "object": {
                    "object_id": "box",
                    "mass_kg": 1.5,
                    "inertia_tensor_camera_kg_m2": [[0.1, 0.0, 0.0], [0.0, 0.2, 0.0], [0.0, 0.0, 0.3]],
                    "friction": 0.4,
                    "restitution": 0.5,
                    "rolling_friction": 0.0,
                    "spinning_friction": 0.0,
                    "linear_damping": 0.01,
                    "angular_damping": 0.02,
                    "initial_state": {
                        "linear_velocity_camera_m_s": [1.0, 0, 0],
                        "angular_velocity_camera_rad_s": [0, 0, 2.5],
                    },
                },
                "world": {"gravity_camera_m_s2": [0, -9.81, 0]},
            },
        },
        "target": {"video": f"videos/{sample}.mp4", "metadata": f"meta/{sample}.json"},
        "sweep": {
            "mode": mode,
            "axis": axis,
            "source_axis": axis or "mass_kg",
            "level_count": 5,
            "level_index": level,
            "base_level_index": 2,
            "base_level_indices": {a: 2 for a in AXES},
        },
    }


def sweep_group(scene="scene0"):
    """Base plus three axes with levels 0, 1, 3, 4: thirteen records."""
    out = [record(f"{scene}-base", scene)]
    for axis in AXES:
        out += [record(f"{scene}-{axis}-{lv}", scene, mode="one_factor", axis=axis, level=lv) for lv in (0, 1, 3, 4)]
    return out


def edited(path, value, base=None):
    """Copy of a record with one dotted field changed (``...`` removes it)."""
    out = copy.deepcopy(base or record())
    keys = path.split(".")
    node = out
    for key in keys[:-1]:
        node = node[key]
    if value is ...:
        node.pop(keys[-1])
    else:
        node[keys[-1]] = value
    return out


def track_payload(frames=2, slots=1, points=2048, depth=1.0):
    """Declared payload: camera y axis flipped, all points at pixel (4, 4) of an 8 x 8 image."""
    camera = np.zeros((frames, slots, points, 3), np.float32)
    camera[..., 2] = depth
    m = np.diag([1.0, -1.0, 1.0, 1.0])
    world = camera * np.array([1, -1, 1], np.float32)
    k = np.array([[1.0, 0, 4], [0, 1.0, 4], [0, 0, 1]])
    ids = [f"o{i}" for i in range(slots)]
    meta = {
        "schema": "acme.point_trajectories.v1",
        "coordinate_frame_camera": "camera_right_up_forward",
        "coordinate_frame_world": "pybullet_world_xyz",
        "point_count": points,
        "object_count": slots,
        "object_ids": ids,
        "track_definition": "perspective_projection_of_fixed_material_points",
        "visibility_definition": "in_frame_and_clip_validity;_not_a_z_buffer",
        "clip_start_m": 0.03,
        "clip_end_m": 100.0,
    }
    return {
        "time_s": np.arange(frames) / 24.0,
        "object_ids": np.array(ids),
        "points_world_m": world,
        "points_camera_m": camera,
        "tracks_xy_px": np.full((frames, slots, points, 2), 4.0, np.float32),
        "depth_m": camera[..., 2].copy(),
        "valid": np.ones((frames, slots, points), np.uint8),
        "initial_points_camera_m": camera[0].copy(),
        "camera_from_world": m,
        "camera_intrinsics": k,
        "image_size_px": np.array([8, 8]),
        "metadata_json": np.array(json.dumps(meta)),
    }


def save_npz(path, arrays):
    path.parent.mkdir(parents=True, exist_ok=True)
    np.savez(path, **arrays)


def safetensors(arrays):
    kinds = {"float32": "F32", "float64": "F64", "int64": "I64"}
    header, body = {}, b""
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        header[name] = {"dtype": kinds[str(a.dtype)], "shape": list(a.shape), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    text = json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + body


def png(array):
    """PNG bytes of a uint8 array: H x W grey, H x W x 3 RGB or H x W x 4 RGBA."""
    a = np.asarray(array, np.uint8)
    if a.ndim == 2:
        a = a[..., None]
    height, width, channels = a.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\0" + row.tobytes() for row in a)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def npz_bytes(arrays):
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()
