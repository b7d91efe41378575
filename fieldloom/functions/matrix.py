"""4x4 matrices on the driver; operators take their coefficients as literals."""

from __future__ import annotations

import numpy as np


def identity() -> np.ndarray:
    return np.eye(4)


def translate(x: float, y: float, z: float) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = x, y, z
    return m


def scale(x: float, y: float | None = None, z: float | None = None) -> np.ndarray:
    return np.diag([x, x if y is None else y, x if z is None else z, 1.0])


def rotate(axis: int, radians: float) -> np.ndarray:
    """About x (0), y (1) or z (2)."""
    m = np.eye(4)
    a, b = (axis + 1) % 3, (axis + 2) % 3
    c, s = np.cos(radians), np.sin(radians)
    m[a, a], m[a, b], m[b, a], m[b, b] = c, -s, s, c
    return m


def world(origin, x, y, z) -> np.ndarray:
    """From axes x, y, z at origin to the world."""
    m = np.eye(4)
    m[:3, 0], m[:3, 1], m[:3, 2], m[:3, 3] = x, y, z, origin
    return m


def view(eye, at, up) -> np.ndarray:
    """World to camera looking down -z."""
    eye, at, up = (np.asarray(v, float) for v in (eye, at, up))
    f = (at - eye) / np.linalg.norm(at - eye)
    s = np.cross(f, up)
    s /= np.linalg.norm(s)
    m = np.eye(4)
    m[0, :3], m[1, :3], m[2, :3] = s, np.cross(s, f), -f
    return m @ translate(*-eye)


def perspective(fov: float, near: float, far: float, aspect: float) -> np.ndarray:
    t = 1 / np.tan(fov / 2)
    m = np.zeros((4, 4))
    m[0, 0], m[1, 1], m[2, 2], m[2, 3], m[3, 2] = t / aspect, t, -(far + near) / (far - near), -2 * far * near / (far - near), -1
    return m


def orthographic(size: float, near: float, far: float, aspect: float) -> np.ndarray:
    return np.array([[2 / (size * aspect), 0, 0, 0], [0, 2 / size, 0, 0], [0, 0, -2 / (far - near), -(far + near) / (far - near)], [0, 0, 0, 1.0]])


def trackball(x1: float, y1: float, x2: float, y2: float, radius: float = 0.8) -> np.ndarray:
    """Rotation that takes the point under (x1, y1) of a ball to (x2, y2)."""

    def on_ball(x, y):
        d = np.hypot(x, y)
        z = np.sqrt(radius**2 - d**2) if d < radius / np.sqrt(2) else radius**2 / 2 / d
        return np.array([x, y, z])

    a, b = on_ball(x1, y1), on_ball(x2, y2)
    axis = np.cross(a, b)
    n = np.linalg.norm(axis)
    if not n:
        return np.eye(4)
    k = axis / n
    angle = np.arctan2(n, a @ b)
    kx = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    m = np.eye(4)
    m[:3, :3] += np.sin(angle) * kx + (1 - np.cos(angle)) * kx @ kx
    return m


def invert(m: np.ndarray) -> np.ndarray:
    return np.linalg.inv(m)


def determinant(m: np.ndarray) -> float:
    return float(np.linalg.det(m))


def legendre(i: int, x):
    """Scaled Legendre polynomials of order 0 to 2."""
    p = (1.0 + 0 * x, x, (3 * x * x - 1) / 2)[i]
    return p * (2 * i + 1) ** 0.5
