"""Image measures over raw pixels (binary rows x columns x 3 with height and width), in Arrow batches.

Images reach these functions decoded, e.g. by Spark's ``image`` source; nothing here reads files.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Luma weights, the noise kernel, the mean of the standard luminance table at quality 50.
LUMA = np.array([0.299, 0.587, 0.114])
NOISE = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]], float)
TABLE_MEAN = 57.625
AXES = ("brightness", "contrast", "saturation", "sharpness", "entropy", "colour_temperature", "blur", "noise", "exposure_clipping")


def area_weights(n: int, m: int) -> np.ndarray:
    """m rows of weights that average n samples into m equal areas."""
    edges = np.linspace(0, n, m + 1)
    at = np.arange(n)
    cover = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, 1)
    return cover / cover.sum(1, keepdims=True)


def bilinear_weights(n: int, m: int) -> np.ndarray:
    x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(x).astype(int)
    out = np.zeros((m, n))
    out[np.arange(m), low] = 1 - (x - low)
    out[np.arange(m), np.minimum(low + 1, n - 1)] += x - low
    return out


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average when shrinking, linear interpolation when growing, by one matrix for each side."""
    pick = lambda n, m: area_weights(n, m) if m <= n else bilinear_weights(n, m)
    rows = np.tensordot(pick(img.shape[0], height), img.astype(float), (1, 0))
    return np.moveaxis(np.tensordot(pick(img.shape[1], width), rows, (1, 1)), 0, 1)


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    out = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


_DCT = dct_matrix(32)[:8]


def pack(bits: np.ndarray) -> int:
    """64 bits, the first lowest, as a signed long."""
    return int(np.packbits(bits.ravel()[:64], bitorder="little").view("<i8")[0])


def gradient_hash(img: np.ndarray) -> int:
    small = resize(img @ LUMA, 8, 9)
    return pack(small[:, 1:] > small[:, :-1])


def frequency_hash(img: np.ndarray) -> int:
    block = (_DCT @ resize(img @ LUMA, 32, 32) @ _DCT.T).ravel()
    return pack(block > np.median(block[1:]))


def hashes(img: np.ndarray) -> tuple[int, int, int, int]:
    """phash, dhash and those of the mirrored image."""
    flip = img[:, ::-1]
    return frequency_hash(img), gradient_hash(img), frequency_hash(flip), gradient_hash(flip)


def filtered(y: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a small symmetric kernel, edges mirrored."""
    r, s = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = np.pad(y, ((r, r), (s, s)), mode="symmetric")
    view = np.lib.stride_tricks.sliding_window_view(p, kernel.shape)
    return np.einsum("ijkl,kl->ij", view, kernel)


def gaussian(y: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    g /= g.sum()
    return filtered(filtered(y, g[:, None]), g[None, :])


def statistics(img: np.ndarray) -> tuple[float, ...]:
    """The nine axes of an image."""
    rgb = img.astype(float) / 255
    y = rgb @ LUMA
    top, low = rgb.max(-1), rgb.min(-1)
    h, w = y.shape
    share = np.bincount((y * 255).astype(int).ravel(), minlength=256) / y.size
    share = share[share > 0]
    power = np.abs(np.fft.fft2(y - y.mean())) ** 2
    near = np.hypot(np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)[None, :]) < 0.125
    edges = filtered(y, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float))
    grain = np.abs(filtered(y * 255, NOISE)[1:-1, 1:-1]).sum() * np.sqrt(np.pi / 2) / (6 * max(w - 2, 1) * max(h - 2, 1))
    clipped = (img.max(-1) <= 3) | (img.min(-1) >= 252)
    return (
        float(y.mean()), float(y.std()), float(np.where(top > 0, (top - low) / np.maximum(top, 1e-8), 0).mean()), float(np.log10(edges.var() + 1e-8)), float(-(share * np.log2(share)).sum()),
        float(rgb[..., 0].mean() - rgb[..., 2].mean()), float(power[near].sum() / max(power.sum(), 1e-12)), float(grain), float(clipped.mean()),
    )


def window_energy(img: np.ndarray, win: int = 8, stride: int = 4, sigma: float = 1.0) -> np.ndarray:
    """Energy of the high-pass residual in each window, row by row, from a summed-area table."""
    y = img @ LUMA
    area = np.pad(((y - gaussian(y, sigma)) ** 2).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r, c = np.arange(0, y.shape[0] - win + 1, stride), np.arange(0, y.shape[1] - win + 1, stride)
    corner = lambda dy, dx: area[np.ix_(r + dy, c + dx)]
    return (corner(win, win) - corner(0, win) - corner(win, 0) + corner(0, 0)).ravel()


def photometric(img: np.ndarray) -> np.ndarray:
    """Each channel brought to mean 118 and deviation 48."""
    x = img.astype(float)
    m, s = x.mean((0, 1)), np.maximum(x.std((0, 1)), 1.0)
    return np.clip((x - m) / s * 48 + 118, 0, 255).astype(np.uint8)


def patch_template(patches: np.ndarray) -> np.ndarray:
    """The patch (rows of unit norm and zero mean) that is most like all others."""
    x = patches.reshape(len(patches), -1).astype(float)
    x = x - x.mean(1, keepdims=True)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x[(x @ x.mean(0)).argmax()]


def best_match(img: np.ndarray, template: np.ndarray, row: int, column: int, win: int, reach: int = 2) -> float:
    """The greatest similarity of the template to windows within ``reach`` pixels."""
    y = img @ LUMA
    out = -1.0
    for r in range(max(0, row - reach), min(y.shape[0] - win, row + reach) + 1):
        for c in range(max(0, column - reach), min(y.shape[1] - win, column + reach) + 1):
            p = y[r : r + win, c : c + win].ravel()
            p = p - p.mean()
            out = max(out, float(p @ template / max(np.linalg.norm(p), 1e-9)))
    return out


def region(row: float, column: float, height: int, width: int) -> str:
    """A name in a 3 by 3 grid."""
    v, h = ("upper", "middle", "lower")[min(2, int(3 * row / height))], ("left", "centre", "right")[min(2, int(3 * column / width))]
    return "centre" if (v, h) == ("middle", "centre") else f"{v} {h}"


def jpeg_quality(data: bytes) -> tuple[int | None, str | None]:
    """Quality estimated from the luminance quantisation table, and a digest of all tables; nulls if it is no JPEG."""
    if data[:2] != b"\xff\xd8":
        return None, None
    tables, at = {}, 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xDB:
            p, end = at + 4, at + 2 + size
            while p < end:
                wide, number = data[p] >> 4, data[p] & 15
                n = 64 * (wide + 1)
                tables[number] = np.frombuffer(data[p + 1 : p + 1 + n], ">u2" if wide else "u1").astype(np.uint16)
                p += 1 + n
        at += 2 + size
    if not tables:
        return None, None
    scale = float(tables[min(tables)].mean()) / TABLE_MEAN * 100
    quality = round((200 - scale) / 2) if scale <= 100 else round(5000 / scale)
    return max(1, min(100, quality)), sha256(b"".join(tables[k].tobytes() for k in sorted(tables))).hexdigest()[:16]


def measure(images: DataFrame, id_col: str, data: str = "data", height: str = "height", width: str = "width") -> DataFrame:
    """(id, phash, dhash, phash_flip, dhash_flip, the nine axes, energies) of each image; images that don't fit their size are left out."""
    names = ["phash", "dhash", "phash_flip", "dhash_flip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, raw, h, w in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if raw is not None and h and w and len(raw) == 3 * h * w:
                    img = np.frombuffer(raw, np.uint8).reshape(h, w, 3)
                    ids.append(i)
                    rows.append((*hashes(img), *statistics(img), window_energy(img).tolist()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 14
            types = [pa.int64()] * 4 + [pa.float64()] * 9 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *names, *AXES, "energies"])

    kind = dict(images.dtypes)[id_col]
    schema = ", ".join([f"{id_col} {kind}", *(f"{n} long" for n in names), *(f"{a} double" for a in AXES), "energies array<double>"])
    return images.select(id_col, data, height, width).mapInArrow(run, schema)
