"""Ed25519 signatures (RFC 8032) in plain Python, for checking signed mutations in batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Curve constants; fixed values.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
BASE_Y = 4 * pow(5, P - 2, P) % P
IDENTITY = (0, 1, 1, 0)


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if x * x % P != square:
        x = x * pow(2, (P - 1) // 4, P) % P
    if x * x % P != square or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


def _add(a: tuple, b: tuple) -> tuple:
    """Sum in extended coordinates."""
    u, v = (a[1] - a[0]) * (b[1] - b[0]), (a[1] + a[0]) * (b[1] + b[0])
    t, z = 2 * a[3] * b[3] * D, 2 * a[2] * b[2]
    e, f, g, h = v - u, z - t, z + t, v + u
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, point: tuple) -> tuple:
    out = IDENTITY
    while n:
        if n & 1:
            out = _add(out, point)
        point = _add(point, point)
        n >>= 1
    return out


def _same(a: tuple, b: tuple) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _pack(point: tuple) -> bytes:
    inverse = pow(point[2], P - 2, P)
    x, y = point[0] * inverse % P, point[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> tuple | None:
    n = int.from_bytes(raw, "little")
    y = n & (1 << 255) - 1
    x = _x_of(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


BASE = _unpack(BASE_Y.to_bytes(32, "little"))


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    scalar, prefix = _secret(seed)
    r = _number(prefix, message)
    point = _pack(_times(r, BASE))
    return point + ((r + _number(point, public_key(seed), message) * scalar) % ORDER).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(key), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    return _same(_times(s, BASE), _add(r, _times(_number(signature[:32], key, message), a)))


@F.pandas_udf(BooleanType())
def signature_valid(agent: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    """agent and signature in hex; anything malformed is invalid."""

    def one(a, m, s) -> bool:
        try:
            return m is not None and verify(bytes.fromhex(a), bytes(m), bytes.fromhex(s))
        except (TypeError, ValueError):
            return False

    return pd.Series([one(a, m, s) for a, m, s in zip(agent, message, signature, strict=True)])
