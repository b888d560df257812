"""A plain baseline JPEG writer for thumbnails: workers have no image library, and thumbnails are small."""

from __future__ import annotations

import struct

import numpy as np

from shelfmark.functions.pixels import dct_matrix

#: Code words of equal length for every symbol keep the tables a rule: 4 bits for sizes of constant terms, 8 for (run, size) of the others.
_DC = list(range(12))
_AC = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]


def zigzag(n: int = 8) -> np.ndarray:
    """Places of an n x n block along its diagonals, the direction changing from one to the next."""
    cells = [(i, j) for i in range(n) for j in range(n)]
    cells.sort(key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([i * n + j for i, j in cells])


def quantisers(step: int) -> np.ndarray:
    """8 x 8 divisors that grow with the frequency."""
    i, j = np.mgrid[0:8, 0:8]
    return np.clip(step + (i + j) * step, 1, 255)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, length: int, symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind, *(len(symbols) if k == length else 0 for k in range(1, 17)), *symbols]))


def _size(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def encode(rgb: np.ndarray, step: int = 3) -> bytes:
    """JPEG bytes of (height, width, 3) values from 0 to 255; a greater step is a smaller file."""
    h, w = rgb.shape[:2]
    x = rgb.astype(np.float64)
    y = x @ [0.299, 0.587, 0.114]
    planes = [y - 128, (x[:, :, 2] - y) / 1.772, (x[:, :, 0] - y) / 1.402]
    d, q, order = dct_matrix(8), quantisers(step), zigzag()
    blocks = []
    for p in planes:
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge")
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        blocks.append(np.rint(d @ b @ d.T / q).astype(np.int64).reshape(-1, 64)[:, order])
    coded = np.stack(blocks, axis=1)
    coded[:, :, 0] = np.diff(coded[:, :, 0], axis=0, prepend=0)
    coded = np.clip(coded, -1023, 1023)
    sizes = _size(coded)
    extra = np.where(coded < 0, coded + (1 << sizes) - 1, coded)
    place = {s: k for k, s in enumerate(_AC)}
    bits: list[str] = []
    for values, size, more in zip(coded.reshape(-1, 64), sizes.reshape(-1, 64), extra.reshape(-1, 64)):
        bits.append(f"{size[0]:04b}" + (f"{more[0]:0{size[0]}b}" if size[0] else ""))
        last = 0
        for k in np.flatnonzero(values[1:]) + 1:
            run = k - last - 1
            bits.append(f"{place[0xF0]:08b}" * (run // 16) + f"{place[(run % 16) << 4 | size[k]]:08b}{more[k]:0{size[k]}b}")
            last = k
        if last < 63:
            bits.append(f"{place[0x00]:08b}")
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    data = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00")
    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes(v for c in (1, 2, 3) for v in (c, 0x11, 0))
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    parts = [_segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xDB, bytes([0, *q.reshape(-1)[order].tolist()])), _segment(0xC0, frame), _table(0x00, 4, _DC), _table(0x10, 8, _AC), _segment(0xDA, scan)]
    return b"\xff\xd8" + b"".join(parts) + data + b"\xff\xd9"
