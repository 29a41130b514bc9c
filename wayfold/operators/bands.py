"""All eigenvalues of a symmetric matrix that is held in tiles, in memory or in a file, never whole.

Blocks of Householder reflections leave a band, single ones chase the band down to
three diagonals, and counts of signs find all eigenvalues of these at once by
bisection.  Each reduction is an orthogonal similarity, so the eigenvalues are those
of the matrix up to rounding of its norm.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
from numpy.lib.stride_tricks import as_strided

#: Side of a tile, a multiple of the band's width; bytes of tiles that are held in memory, more go to a file.
TILE, BAND, MEMORY = 512, 32, 1 << 28


class Tiles:
    """The lower triangle's tiles (whole ones on the diagonal)."""

    def __init__(self, n: int) -> None:
        self.n, self.count = n, -(-n // TILE)
        whole = self.count * (self.count + 1) // 2
        self.held: dict | None = {} if whole * TILE * TILE * 8 <= MEMORY else None
        self.file = tempfile.TemporaryFile(buffering=0) if self.held is None else None

    def rows(self, i: int) -> slice:
        return slice(i * TILE, min(self.n, (i + 1) * TILE))

    def at(self, i: int, j: int) -> int:
        return (i * (i + 1) // 2 + j) * TILE * TILE * 8

    def get(self, i: int, j: int) -> np.ndarray:
        if self.held is not None:
            return self.held[i, j]
        out = np.empty([r.stop - r.start for r in (self.rows(i), self.rows(j))])
        to, done = memoryview(out).cast("B"), 0
        self.file.seek(self.at(i, j))
        while done < len(to):
            done += self.file.readinto(to[done:])
        return out

    def put(self, i: int, j: int, tile: np.ndarray) -> None:
        if self.held is not None:
            self.held[i, j] = tile
            return
        some, done = memoryview(np.ascontiguousarray(tile)).cast("B"), 0
        self.file.seek(self.at(i, j))
        while done < len(some):
            done += self.file.write(some[done:])

    def close(self) -> None:
        self.held = {}
        if self.file is not None:
            self.file.close()


def blocked(panel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, t, r): panel = (1 - v t v') r."""
    h, tau = np.linalg.qr(panel, mode="raw")
    k = len(tau)
    v, r = np.tril(h.T[:, :k], -1), np.triu(h.T[:k])
    v[np.arange(k), np.arange(k)] = 1
    t, common = np.diag(tau), v.T @ v
    for i in range(1, k):
        t[:i, i] = -tau[i] * (t[:i, :i] @ common[:i, i])
    return v, t, r


def band_of(tiles: Tiles, put: Callable[[int, int, float | np.ndarray], None]) -> None:
    """Gives put(row, column, block) the blocks on and below the diagonal of a matrix of BAND diagonals on either side."""
    n, left, right = tiles.n, None, None
    for k in range(0, n, BAND):
        j, end = k // TILE, min(n, k + BAND)
        columns = []
        for i in range(j, tiles.count):
            piece = tiles.get(i, j)[:, k - j * TILE : end - j * TILE]
            columns.append(piece - left[tiles.rows(i)] @ right[k:end].T if left is not None else piece)
        column = np.concatenate(columns)[k - j * TILE :]
        put(k, k, column[: end - k])
        if end == n:
            return
        some, t, r = blocked(column[end - k :])
        put(end, k, r)
        v, y = np.zeros((n, len(t))), np.zeros((n, len(t)))
        v[end:] = some
        for b in range(end // TILE, tiles.count):
            for a in range(b, tiles.count):
                tile, rows, under = tiles.get(a, b), tiles.rows(a), tiles.rows(b)
                if left is not None:
                    tile -= left[rows] @ right[under].T
                    tiles.put(a, b, tile)
                y[rows] += tile @ v[under]
                if a != b:
                    y[under] += tile.T @ v[rows]
        y[:end] = 0
        p = y @ t
        w = p - 0.5 * v @ (t.T @ (v.T @ p))
        left, right = np.hstack([v, w]), np.hstack([w, v])


def reflected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, tau, first) of each row: (1 - tau v v') x = (first, 0, ...)."""
    head, rest = x[:, 0], (x[:, 1:] ** 2).sum(axis=1)
    turn = rest > 0
    size = np.where(turn, -np.copysign(np.sqrt(head * head + rest), head), head)
    v = x / np.where(turn, head - size, 1)[:, None]
    v[:, 0] = 1
    return v, np.where(turn, (size - head) / np.where(turn, size, 1), 0), size


def turned(here: np.ndarray, after: np.ndarray, mirror: np.ndarray, v: np.ndarray, tau: np.ndarray) -> None:
    """Reflections from both sides of the blocks on the diagonal, from the right of those below; mirror is the transposed place of these."""
    p = tau[:, None] * (here @ v[:, :, None])[:, :, 0]
    p -= 0.5 * (tau * (p * v).sum(axis=1))[:, None] * v
    both = v[:, :, None] * p[:, None, :]
    here -= both
    here -= both.transpose(0, 2, 1)
    after -= (after @ v[:, :, None]) * (tau[:, None] * v)[:, None, :]
    mirror[...] = after.transpose(0, 2, 1)


def windows(a: np.ndarray, row: int, column: int, many: int) -> np.ndarray:
    """Blocks of BAND rows and columns from (row, column) on, each 3 BAND - 1 further down the diagonal."""
    down, right = a.strides
    return as_strided(a[row:, column:], (many, BAND, BAND), ((3 * BAND - 1) * (down + right), down, right))


def three_diagonals(n: int, reduce: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal and the one below it; reduce(put) fills the band."""
    wide, whole = 4 * BAND + 1, n + 3 * BAND  # zeros beyond n, so that no window is cut
    flat = np.zeros(whole * (wide + 1) + wide)
    # element (i, j) of the matrix, where they differ by 2 BAND at most
    a = as_strided(flat[2 * BAND :], (whole, whole), (wide * 8, 8))

    def put(i: int, j: int, block: np.ndarray) -> None:
        a[i : i + len(block), j : j + block.shape[1]] = block
        a[j : j + block.shape[1], i : i + len(block)] = block.T

    reduce(put)
    for time in range(3 * n):
        # column k is begun at time 3 k and chased a block further at each time, without touching what the others do then
        k, older = divmod(time, 3)
        if not older and k < n - 2:
            v, tau, first = reflected(a[k + 1 : k + 1 + BAND, k].copy()[None])
            a[k + 1 : k + 1 + BAND, k] = a[k, k + 1 : k + 1 + BAND] = 0
            a[k + 1, k] = a[k, k + 1] = first[0]
            turned(windows(a, k + 1, k + 1, 1), windows(a, k + 1 + BAND, k + 1, 1), windows(a, k + 1, k + 1 + BAND, 1), v, tau)
        newest, oldest = min(n - 3, (time - 1) // 3), max(0, (time * BAND + 2 - n) // (3 * BAND - 1) + 1)
        many = newest - oldest + 1
        if many <= 0:
            continue
        begin = newest + 1 + (time - 3 * newest) * BAND
        before = windows(a, begin, begin - BAND, many)
        v, tau, first = reflected(before[:, :, 0].copy())
        before -= (tau[:, None] * v)[:, :, None] * (v[:, None, :] @ before)
        before[:, :, 0] = 0
        before[:, 0, 0] = first
        windows(a, begin - BAND, begin, many)[...] = before.transpose(0, 2, 1)
        turned(windows(a, begin, begin, many), windows(a, begin + BAND, begin, many), windows(a, begin, begin + BAND, many), v, tau)
    return flat[2 * BAND :: wide + 1][:n].copy(), flat[2 * BAND + wide :: wide + 1][: n - 1].copy()


def bisected(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """All eigenvalues, ascending, of three diagonals."""
    n = len(d)
    size = np.abs(d)
    size[1:] += np.abs(e)
    size[:-1] += np.abs(e)
    reach = float(size.max()) or 1.0
    least = np.finfo(float).tiny + np.finfo(float).eps ** 2 * reach
    square, k = np.append(0.0, e * e), np.arange(n)
    low, high = np.full(n, -reach * (1 + 1e-12)), np.full(n, reach * (1 + 1e-12))
    q, small, count = np.empty(n), np.empty(n, bool), np.empty(n, np.int32)
    for _ in range(56):
        middle = (low + high) / 2
        q.fill(1.0)
        count.fill(0)
        for i in range(n):
            np.divide(square[i], q, out=q)
            np.subtract(d[i], q, out=q)
            q -= middle
            np.less(q, least, out=small)
            count += small
            if small.any():
                np.copyto(q, -least, where=small & (q > -least))
        above = count > k
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return (low + high) / 2


def eigenvalues(tiles: Tiles) -> np.ndarray:
    """All of the matrix, ascending; the tiles are used up."""
    try:
        return bisected(*three_diagonals(tiles.n, lambda put: band_of(tiles, put)))
    finally:
        tiles.close()
