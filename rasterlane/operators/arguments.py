"""What arguments operators take: types from their annotations, and ranges by the field's name.

Checked when an operator is made, also from a spec; an error names the operator and the field.
"""

from __future__ import annotations

from dataclasses import fields
from math import inf

#: Name -> (least, most) of a number, or of every number of a tuple.
WITHIN = {
    **dict.fromkeys(("p", "min_visibility", "erosion_rate", "erosion_factor", "dropout_prob", "alpha_coef", "crop_left", "crop_right", "crop_top", "crop_bottom"), (0, 1)),
    **dict.fromkeys(("threshold_range", "blend_ratio", "fraction_range", "amount", "salt_vs_pepper", "p_replace", "shadow_intensity_range", "snow_point_range", "fog_coef_range", "center_range", "shadow_roi", "flare_roi", "gravel_roi", "max_part_shift"), (0, 1)),
    **dict.fromkeys(("height", "width", "max_size", "grid", "grid_yx", "target_size", "tile_grid_size", "num_grid_xy", "num_steps", "nb_rows", "nb_cols", "n_segments", "num_holes_range", "num_shadows_limit", "channel_drop_range", "iterations", "max_delta", "kernel_size", "num_output_channels", "min_max_height", "waves", "size"), (1, inf)),
    **dict.fromkeys(("sigma_limit", "sigma_x_limit", "sigma_y_limit", "std_range", "hole_height_range", "hole_width_range", "hole_depth_range", "mask_x_length", "mask_y_length", "num_masks_x", "num_masks_y", "blur_limit", "clip_limit", "x_min", "y_min", "compactness", "roughness"), (0, inf)),
    "num_bits": (0, 8), "quality_range": (1, 100), "gamma_limit": (1, inf), "temperature_limit": (1, inf), "max_pixel_value": (1e-9, inf), "num_control_points": (2, inf), "max_factor": (1, inf), "step_factor": (1e-9, inf), "hue": (-0.5, 0.5), "w2h_ratio": (1e-9, inf), "max_value": (1e-9, inf),
}
#: Name -> what a text may be.
CHOICES = {
    "border": ("constant", "mirror"),
    "interpolation": ("nearest", "linear", "cubic", "area", "lanczos"),
    "operation": ("dilation", "erosion"),
    "rotate_method": ("largest_box", "ellipse"),
    "position": ("center", "top_left", "top_right", "bottom_left", "bottom_right", "random"),
    "transform_type": ("pca", "standard", "minmax"),
    "space": ("lab", "ycrcb", "hsv", "luma"),
    "noise_type": ("uniform", "gaussian", "laplace", "beta"),
    "spatial_mode": ("constant", "per_pixel", "shared"),
    "normalization": ("standard", "image", "image_per_channel", "min_max", "min_max_per_channel"),
}
TYPES = {"int": int, "float": (int, float), "bool": bool, "str": str, "tuple": tuple}


def fits(value, kind: str) -> bool:
    if kind == "None":
        return value is None
    if kind not in TYPES:  # frames, relations and what else an operator refers to
        return True
    return isinstance(value, TYPES[kind]) and (kind == "bool" or not isinstance(value, bool))


def checked(op) -> None:
    """Fails on the first argument that is not as its field says; lists become tuples."""
    for f in fields(op):
        value, where = getattr(op, f.name), f"{op.name}: {f.name}"
        if isinstance(value, list):
            value = tuple(value)
            object.__setattr__(op, f.name, value)
        kinds = [k.strip() for k in str(f.type).split("|")]
        if not any(fits(value, k) for k in kinds):
            raise ValueError(f"{where} = {value!r} is not {' or '.join(kinds)}")
        numbers = [v for v in (value if isinstance(value, tuple) else (value,)) if isinstance(v, (int, float)) and not isinstance(v, bool)]
        if any(v != v for v in numbers):
            raise ValueError(f"{where} = {value!r} is not a number")
        low, high = WITHIN.get(f.name, (-inf, inf))
        if any(not low <= v <= high for v in numbers):
            raise ValueError(f"{where} = {value!r} is not within {low} and {high}")
        if isinstance(value, tuple) and len(value) == 2 == len(numbers) and f.name.endswith(("_range", "_limit")) and value[0] > value[1]:
            raise ValueError(f"{where} = {value!r} does not ascend")
        if isinstance(value, str) and f.name in CHOICES and value not in CHOICES[f.name]:
            raise ValueError(f"{where} = {value!r} is none of {CHOICES[f.name]}")
