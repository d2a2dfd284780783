"""Fixed values of the dataset contracts.

Fixed values (must equal the published data contracts for right results).
Version strings are matched by their suffix, so any producer namespace in front
of the first dot is accepted; pass a stricter pattern where one is wanted.
"""

from __future__ import annotations

SAMPLE_SCHEMA_PATTERN = r"^[a-z0-9_]+\.video_condition_sample\.v4$"
TRACK_SCHEMA_PATTERN = r"^[a-z0-9_]+\.point_trajectories\.v1$"
CACHE_SCHEMA_PATTERN = r"^[a-z0-9_]+\.wan_ti2v_cache\.v[34]$"

SPLITS = ("test", "train", "validation")
SWEEP_AXES = ("mass_kg", "contact_friction", "contact_restitution")
RESPONSE_AXIS_CYCLE = (
    "contact_friction",
    "contact_restitution",
    "contact_friction",
    "contact_restitution",
    "mass_kg",
)
LEVEL_COUNT = 5

CONDITIONING_KEYS = ("first_frame", "physics", "scene", "scene_source", "text")
PHYSICS_KEYS = ("coordinate_frame", "object", "source", "world")
OBJECT_KEYS = (
    "angular_damping",
    "friction",
    "inertia_tensor_camera_kg_m2",
    "initial_state",
    "linear_damping",
    "mass_kg",
    "object_id",
    "restitution",
    "rolling_friction",
    "spinning_friction",
)
STATE_KEYS = ("angular_velocity_camera_rad_s", "linear_velocity_camera_m_s")
WORLD_KEYS = ("gravity_camera_m_s2",)
SCENE_SOURCES = ("image_reconstruction", "simulation_gt")
PHYSICS_SOURCES = ("simulation_gt", "user")
CAMERA_FRAME = "camera_right_up_forward"
WORLD_FRAME = "pybullet_world_xyz"

POINTS_PER_OBJECT = 2048
MAX_OBJECTS = 3
TRACK_DEFINITION = "perspective_projection_of_fixed_material_points"
VISIBILITY_DEFINITION = "in_frame_and_clip_validity;_not_a_z_buffer"
TRACK_FIELDS = (
    "camera_from_world",
    "camera_intrinsics",
    "depth_m",
    "image_size_px",
    "initial_points_camera_m",
    "metadata_json",
    "object_ids",
    "points_camera_m",
    "points_world_m",
    "time_s",
    "tracks_xy_px",
    "valid",
)
CLIP_START_M = 0.03
CLIP_END_M = 100.0

SHARD_INVARIANTS = (
    "dataset_root",
    "source_manifest",
    "source_manifest_sha256",
    "source_dataset_summary",
    "source_dataset_summary_sha256",
    "checkpoint",
    "preprocess",
    "source_point_trajectory_manifest",
    "source_point_trajectory_manifest_sha256",
    "point_track_preprocess",
)

GATE_REASONS = (
    "mesh-mask",
    "depth",
    "environment-hole",
    "environment-coverage",
    "depthlab-missing",
    "depthlab-scale",
    "environment-seam",
    "support",
)
ENVIRONMENT_REASONS = (
    "environment-hole",
    "environment-coverage",
    "depthlab-missing",
    "depthlab-scale",
    "environment-seam",
)
GATE_THRESHOLDS = {
    "aligned_mask_iou": 0.65,
    "relative_depth_error": 0.03,
    "environment_completion_fraction": 0.80,
    "environment_surface_coverage": 0.95,
    "positive_completion_fraction": 0.99,
    "known_depth_error": 0.08,
    "seam_p90_error": 0.10,
}

CURRENT_CACHE_PATTERN = r"^[a-z0-9_]+\.wan_ti2v_cache\.v4$"
TRACK_MANIFEST_PATTERN = r"^[a-z0-9_]+\.point_trajectory_manifest\.v1$"

# The preprocessing that a cache header states for its track maps. Sizes and the name of the
# source schema are added from the header; the last two tables hold for the current cache schema only.
PREPROCESS_DENSE = {
    "channels_per_object": 6,
    "max_objects": 3,
    "frame_selection": "evenly_spaced_from_first_to_last",
    "spatial_grid": "Wan_latent_grid",
    "spatial_transform": "cover_then_center_crop_to_preprocess_size",
}
PREPROCESS_CURRENT = {
    "pixel_center_convention": "opencv_half_pixel",
    "geometry_compute_dtype": "float64_after_source_decode_until_integer_rasterization",
}
PREPROCESS_IDENTITY = {
    "representation": "das_3d_tracks",
    "channels_per_object": 4,
    "channels": ["identity_r", "identity_g", "identity_b", "visibility"],
    "max_objects": 3,
    "frame_selection": "same_evenly_spaced_indices_as_preprocessed_video",
    "source_frame_alignment": "trajectory_count_equals_source_video_count",
    "spatial_grid": "Wan_VAE_grid_after_full_resolution_visibility",
    "spatial_transform": "cover_then_center_crop_to_preprocess_size",
    "point_identity": "first_frame_camera_xyz_with_reciprocal_z_rgb",
    "color_normalization": "shared_xy_minmax_inverse_z_2_98_percentile",
    "visibility": "full_resolution_dynamic_and_static_nearest_depth_z_buffer",
    "visibility_depth_range": "source_camera_clip_start_end",
    "spatial_reduction": "visible_point_identity_mean_and_binary_occupancy",
    "temporal_encoding": "conditioner_first_frame_plus_learned_stride4_windows",
    "point_splat_radius_px": 1,
}
LATENT_CHANNELS, TEXT_WIDTH, TEXT_TOKENS = 48, 4096, 512

PACKAGE_SCHEMA_PATTERN = r"^[a-z0-9_]+\.structured_scene_package\.v1$"
COLLISION_PROXY = "object_collision_proxy.obj"
SCENE_MAP_ARRAYS = (
    "pixel_body_id",
    "object_mask",
    "aligned_object_mask",
    "aligned_object_depth",
    "environment_mask",
    "reliable_environment_mask",
    "environment_completion_mask",
    "environment_dense_mask",
    "environment_completion_depth",
    "environment_depthlab_mask",
    "environment_depthlab_raw_depth",
    "content_mask",
)
SCENE_ARRAYS = (
    "xyz",
    "rgb",
    "source",
    "body_id",
    "intrinsic",
    "extrinsic",
    "point_map_world",
    "depth",
    "confidence",
    *SCENE_MAP_ARRAYS,
    "object_transform_world",
    "object_transform_camera",
    "collision_proxy_vertices",
    "collision_proxy_faces",
    "support_plane_valid",
    "support_plane_index",
    "support_plane_equation_world",
    "support_plane_distance_threshold",
    "source_labels",
    "body_labels",
)

SECRET_PATTERNS = {
    "token": r"hf_[A-Za-z0-9]{20,}",
    "private_key": r"-----BEGIN (?:OPENSSH |RSA |EC )?PRIVATE KEY-----",
}
OVERSIZE_BYTES = 95 * 1024 * 1024
