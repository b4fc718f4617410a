"""A baseline JPEG encoder in numpy: full-size colour planes, Huffman tables made for each image."""

from __future__ import annotations

import struct

import numpy as np

# The example quantisation tables of the JPEG standard, row by row (the second one's
# remaining values are 99).
LUMA_STEPS = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA_CORNER = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]

#: Places of a block by diagonals, every other one upwards.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
#: Symbols packed into bits at a time.
CHUNK = 1 << 20


def _steps(quality: float) -> list[np.ndarray]:
    """Quantisation steps of luma and chroma for a quality from 0 to 1."""
    q = min(100, max(1, round(quality * 100)))
    scale = 5000 / q if q < 50 else 200 - 2 * q
    chroma = np.full((8, 8), 99)
    chroma[:4, :4] = CHROMA_CORNER
    return [np.clip(np.floor((table * scale + 50) / 100), 1, 255).astype(int) for table in (np.array(LUMA_STEPS).reshape(8, 8), chroma)]


def _planes(width: int, height: int, data: bytes, background: tuple[int, int, int]) -> np.ndarray:
    """(3, h, w) luma and colour differences, edges repeated to whole blocks."""
    rgba = np.frombuffer(data, np.uint8).reshape(height, width, 4).astype(float)
    alpha = rgba[..., 3:] / 255
    rgb = np.floor(rgba[..., :3] * alpha + np.array(background, float) * (1 - alpha) + 0.5)
    red, green, blue = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    luma = 0.299 * red + 0.587 * green + 0.114 * blue
    planes = np.stack([luma - 128, (blue - luma) / 1.772, (red - luma) / 1.402])
    return np.pad(planes, ((0, 0), (0, -height % 8), (0, -width % 8)), mode="edge")


def _coefficients(planes: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """(blocks, 64) quantised coefficients, zigzag; the three planes of a block follow each other."""
    _, h, w = planes.shape
    k = np.arange(8)
    wave = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, 0.125**0.5, 0.5)[:, None]
    blocks = planes.reshape(3, h // 8, 8, w // 8, 8).transpose(1, 3, 0, 2, 4)  # block row, block column, plane
    step = np.stack([steps[0], steps[1], steps[1]])
    return np.rint((wave @ blocks @ wave.T) / step).astype(np.int32).reshape(-1, 64)[:, ZIGZAG]


def _events(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, symbol, extra bits, their number) of everything that is written, in order."""

    def sizes(v: np.ndarray) -> np.ndarray:
        return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)

    n = len(coefficients)
    first = coefficients[:, 0].reshape(-1, 3)
    delta = np.diff(first, axis=0, prepend=np.zeros((1, 3), first.dtype)).reshape(-1)
    block, place = np.nonzero(coefficients[:, 1:])
    value, place = coefficients[block, place + 1], place + 1
    before = np.zeros(len(place), np.int64)
    before[1:] = np.where(block[1:] == block[:-1], place[:-1], 0)
    run = place - before - 1
    size = sizes(value)
    long_run, last = run // 16, np.zeros(n, np.int64)
    np.maximum.at(last, block, place)
    short = np.flatnonzero(last < 63)
    skip = np.repeat(np.arange(len(run)), long_run)
    at = np.concatenate([np.arange(n) * 1024, block[skip] * 1024 + place[skip] * 8, block * 1024 + place * 8 + 4, short * 1024 + 1000])
    table = np.concatenate([np.zeros(n, int), np.ones(len(skip) + len(run) + len(short), int)])
    symbol = np.concatenate([sizes(delta), np.full(len(skip), 0xF0), (run % 16) * 16 + size, np.zeros(len(short), int)])
    raw = np.concatenate([delta, np.zeros(len(skip), int), value, np.zeros(len(short), int)])
    count = np.concatenate([sizes(delta), np.zeros(len(skip), int), size, np.zeros(len(short), int)])
    extra = np.where(raw < 0, raw + (1 << count) - 1, raw)
    order = np.argsort(at, kind="stable")
    return table[order], symbol[order], extra[order], count[order]


def _lengths(weights: dict[int, int], most: int = 16) -> dict[int, int]:
    """Lengths of an optimal prefix code with none over ``most``, by package-merge."""
    leaves = sorted((w, (s,)) for s, w in weights.items())
    row = leaves
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = sorted(leaves + pairs)
    out = dict.fromkeys(weights, 0)
    for _, symbols in row[: 2 * len(leaves) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def _code(symbols: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(definition, codes, lengths) of the Huffman code for some symbols."""
    values, counts = np.unique(symbols, return_counts=True)
    none = 256  # takes the code of ones only, which must not be used
    lengths = _lengths({**dict(zip(values.tolist(), counts.tolist(), strict=True)), none: 0})
    codes, sizes, code, used = np.zeros(257, np.int64), np.zeros(257, np.int64), 0, []
    for length in range(1, 17):
        for s in sorted(x for x, n in lengths.items() if n == length):
            codes[s], sizes[s] = code, length
            code += 1
            used.append(s)
        code <<= 1
    used.remove(none)
    by_length = [sum(lengths[s] == n for s in used) for n in range(1, 17)]
    return bytes(by_length) + bytes(used), codes, sizes


def encode_jpeg(width: int, height: int, data: bytes, quality: float = 0.92, background: tuple[int, int, int] = (255, 255, 255)) -> bytes:
    """RGBA bytes, flattened onto a colour, as a JPEG file."""
    steps = _steps(quality)
    table, symbol, extra, count = _events(_coefficients(_planes(width, height, data, background), steps))
    defined, codes, lengths = zip(*(_code(symbol[table == k]) for k in (0, 1)), strict=True)
    codes, lengths = np.stack(codes), np.stack(lengths)
    body, left = [], np.zeros(0, np.uint8)
    for at in range(0, len(symbol), CHUNK):
        part = slice(at, at + CHUNK)
        t, s, c = table[part], symbol[part], count[part]
        value, size = (codes[t, s] << c) | extra[part], lengths[t, s] + c
        ends = np.cumsum(size)
        back = np.repeat(ends, size) - 1 - np.arange(ends[-1])
        bits = np.concatenate([left, ((np.repeat(value, size) >> back) & 1).astype(np.uint8)])
        whole = len(bits) // 8 * 8
        body.append(np.packbits(bits[:whole]).tobytes())
        left = bits[whole:]
    body.append(np.packbits(np.concatenate([left, np.ones(-len(left) % 8, np.uint8)])).tobytes())

    def segment(mark: int, content: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(content) + 2) + content

    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        *(segment(0xDB, bytes([k]) + bytes(s.reshape(-1)[ZIGZAG].tolist())) for k, s in enumerate(steps)),
        segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])),
        *(segment(0xC4, bytes([k << 4]) + d) for k, d in enumerate(defined)),
        segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])), b"".join(body).replace(b"\xff", b"\xff\0"), b"\xff\xd9",
    ])
