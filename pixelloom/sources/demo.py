"""A tile provider for trying the tile source out."""


def ramp(rect: tuple[int, int, int, int]) -> bytes:
    """RGBA bytes whose red is the column and whose green is the row, modulo 256."""
    x, y, w, h = rect
    return bytes(v for j in range(y, y + h) for i in range(x, x + w) for v in (i & 255, j & 255, 0, 255))
