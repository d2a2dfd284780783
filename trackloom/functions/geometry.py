"""Camera, rigid-body and raster arithmetic as column expressions.

Camera axes are right/up/forward while image rows grow downward, so y changes
sign on the way into and out of the intrinsic matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Vec = tuple[Column, Column, Column]


def d(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def rotate(m: Column, p: Vec) -> Vec:
    """Upper-left 3x3 of a matrix column times a vector."""
    return tuple(m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] for i in range(3))


def rotate_back(m: Column, p: Vec) -> Vec:
    """Transpose of the upper-left 3x3 times a vector."""
    return tuple(m[0][i] * p[0] + m[1][i] * p[1] + m[2][i] * p[2] for i in range(3))


def apply_rigid(m: Column, p: Vec) -> Vec:
    """Homogeneous 4x4 transform of a point."""
    r = rotate(m, p)
    return tuple(r[i] + m[i][3] for i in range(3))


def inverse3(m: Column) -> list[list[Column]]:
    """Inverse by cofactors of the upper-left 3x3 (NULL entries when singular)."""
    det = (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        + m[0][1] * (m[1][2] * m[2][0] - m[1][0] * m[2][2])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )
    safe = F.when(det != 0, det)

    def cofactor(i: int, j: int) -> Column:
        a, b = (i + 1) % 3, (i + 2) % 3
        c, e = (j + 1) % 3, (j + 2) % 3
        return m[a][c] * m[b][e] - m[a][e] * m[b][c]

    return [[cofactor(j, i) / safe for j in range(3)] for i in range(3)]


def invert_rigid(m: Column, p: Vec) -> Vec:
    """Point whose image under the 4x4 transform ``m`` is ``p``."""
    inv = inverse3(m)
    q = tuple(p[i] - m[i][3] for i in range(3))
    return tuple(inv[i][0] * q[0] + inv[i][1] * q[1] + inv[i][2] * q[2] for i in range(3))


def project(k: Column, p: Vec) -> tuple[Column, Column, Column]:
    """Pixel (u, v) and the homogeneous weight; 0 where the weight vanishes."""
    q = (p[0], -p[1], p[2])
    u, v, w = rotate(k, q)
    usable = F.abs(w) > 1e-12
    safe = F.when(usable, w)
    return F.coalesce(u / safe, F.lit(0.0)), F.coalesce(v / safe, F.lit(0.0)), w


def unproject(u: Column, v: Column, depth: Column, k: Column) -> Vec:
    """Camera point of a pixel and its metric depth, stored in single precision."""
    inv = inverse3(k)
    ray = [inv[i][0] * u + inv[i][1] * v + inv[i][2] for i in range(3)]
    return (
        (ray[0] * depth).cast("float"),
        (-(ray[1] * depth)).cast("float"),
        (ray[2] * depth).cast("float"),
    )


def depth_to_world(x: Column, y: Column, depth: Column, k: Column, extrinsic: Column) -> Vec:
    """World point along the pixel ray; ``extrinsic`` maps world to camera (3x4 or 4x4)."""
    inv = inverse3(k)
    ray = tuple((inv[i][0] * x + inv[i][1] * y + inv[i][2]) * depth for i in range(3))
    return invert_rigid(extrinsic, ray)


def quaternion_matrix(q: tuple[Column, Column, Column, Column]) -> list[list[Column]]:
    """Rotation rows of a (w, x, y, z) quaternion, normalised first."""
    size = norm(*q)
    w, x, y, z = (c / size for c in q)
    two = F.lit(2.0)
    one = F.lit(1.0)
    return [
        [one - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y)],
        [two * (x * y + w * z), one - two * (x * x + z * z), two * (y * z - w * x)],
        [two * (x * z - w * y), two * (y * z + w * x), one - two * (x * x + y * y)],
    ]


def cover_crop(
    u: Column, v: Column, source: tuple[Column, Column], target: tuple[int, int]
) -> tuple[Column, Column]:
    """Cover-resize and centre-crop with half-pixel centres (doubles throughout)."""
    tw, th = F.lit(float(target[0])), F.lit(float(target[1]))
    sw, sh = source[0].cast("double"), source[1].cast("double")
    scale = F.greatest(tw / sw, th / sh)
    rw = F.greatest(tw, F.rint(sw * scale))
    rh = F.greatest(th, F.rint(sh * scale))
    half = F.lit(0.5)
    x = (u + half) * (rw / sw) - half - F.floor((rw - tw) / 2)
    y = (v + half) * (rh / sh) - half - F.floor((rh - th) / 2)
    return x, y


def cover_crop_corner(
    u: Column, v: Column, source: tuple[Column, Column], target: tuple[int, int]
) -> tuple[Column, Column]:
    """Corner-aligned variant: one scale for both axes and a fractional crop."""
    tw, th = F.lit(float(target[0])), F.lit(float(target[1]))
    sw, sh = source[0].cast("double"), source[1].cast("double")
    scale = F.greatest(tw / sw, th / sh)
    return u * scale - (sw * scale - tw) / 2, v * scale - (sh * scale - th) / 2


def pixel_cell(x: Column, pixels: int, cells: int) -> Column:
    """Grid cell of a pixel centre, clamped to the grid."""
    raw = F.floor((x.cast("double") + 0.5) * F.lit(float(cells)) / F.lit(float(pixels)))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(cells - 1)).cast("int")


def crop_to_image(px: Column, py: Column, box: tuple[Column, Column, Column, Column], size: Column):
    """Crop-square pixels back to image pixels; box is (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = box
    return x0 + px / size * (x1 - x0), y0 + py / size * (y1 - y0)


def display_axes(x: Column, y: Column, z: Column) -> Vec:
    """Viewer orientation (x, z, -y), rounded half-even to five digits."""
    return F.bround(x, 5), F.bround(z, 5), F.bround(-y, 5)


def normalise_point(u: Column, v: Column, width: Column, height: Column, valid: Column):
    """Image-relative coordinates; NULL where the point is not valid."""
    one = F.lit(1)
    return (
        F.when(valid, u / F.greatest(width, one)),
        F.when(valid, v / F.greatest(height, one)),
    )


def latent_frame(frame: Column) -> Column:
    """Frame 0 stays alone; later frames fall into windows of four."""
    return F.when(frame == 0, F.lit(0)).otherwise(F.floor((frame - 1) / 4) + 1).cast("int")


def window_start(latent: Column) -> Column:
    """First video frame of a latent window."""
    return F.when(latent == 0, F.lit(0)).otherwise(4 * (latent - 1) + 1).cast("int")
