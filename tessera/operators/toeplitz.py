"""Systems of the background's covariance, by conjugate gradients and no matrix of a template's square.

The covariance of a template of rows x cols cells is block Toeplitz: the block of two cells
depends on their offset only. So its product with a vector is a convolution, done by FFT
on a grid of twice the sides, and what is kept is a block for each frequency. A worker
makes it from the background's blocks by offset, which are all that is sent.
"""

from __future__ import annotations

import functools

import numpy as np

from tessera.sources.models import Background

TOLERANCE = 1e-12


class NotPositiveError(ArithmeticError):
    """The matrix isn't positive definite, or too near to that."""


class Toeplitz:
    """The covariance of rows x cols cells of a background, plus ridge times the identity; vectors are cells row by row."""

    def __init__(self, background: Background, rows: int, cols: int, ridge: float = 0.0) -> None:
        n = len(background.mean)
        self.rows, self.cols, self.n, self.ridge = rows, cols, n, ridge
        self.size = (2 * rows, 2 * cols)
        kernel, known = np.zeros((*self.size, n, n)), set()
        for (dx, dy), c in zip(np.asarray(background.offsets).tolist(), np.asarray(background.cov, float), strict=True):
            for x, y, block in ((dx, dy, c), (-dx, -dy, c.T)):
                if abs(x) < cols and abs(y) < rows:
                    kernel[-y % self.size[0], -x % self.size[1]] = block
                    known.add((x, y))
        if len(known) < (2 * rows - 1) * (2 * cols - 1):
            raise ValueError("the template is larger than the offsets allow")
        kernel[0, 0] = (kernel[0, 0] + kernel[0, 0].T) / 2 + ridge * np.eye(n)
        self.block = kernel[0, 0].copy()
        self.spectrum = np.fft.rfft2(kernel, axes=(0, 1))

    def product(self, v: np.ndarray) -> np.ndarray:
        """The matrix times each row of v."""
        x = np.fft.rfft2(v.reshape(-1, self.rows, self.cols, self.n), self.size, axes=(1, 2))
        y = np.matmul(self.spectrum, np.moveaxis(x, 0, -1))
        return np.fft.irfft2(np.moveaxis(y, -1, 0), self.size, axes=(1, 2))[:, : self.rows, : self.cols].reshape(v.shape)

    def solve(self, b: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
        """The solution for each row of b, all at once; preconditioned by the block of one cell."""
        b = np.atleast_2d(np.asarray(b, float))
        try:
            inverse = np.linalg.inv(np.linalg.cholesky(self.block))
        except np.linalg.LinAlgError:
            raise NotPositiveError from None
        inverse = inverse.T @ inverse

        def precondition(r: np.ndarray) -> np.ndarray:
            return (r.reshape(-1, self.n) @ inverse).reshape(r.shape)

        x, wanted = np.zeros_like(b), tolerance * np.linalg.norm(b, axis=1)
        rest = b.copy()
        z = precondition(rest)
        p, rho = z.copy(), np.einsum("ij,ij->i", rest, z)
        live = np.flatnonzero(np.linalg.norm(rest, axis=1) > wanted)
        for _ in range(20 * b.shape[1] + 100):
            if not len(live):
                return x
            q = self.product(p[live])
            curve = np.einsum("ij,ij->i", p[live], q)
            if (curve <= 0).any() or not np.isfinite(curve).all():
                raise NotPositiveError
            step = (rho[live] / curve)[:, None]
            x[live] += step * p[live]
            rest[live] -= step * q
            z = precondition(rest[live])
            now = np.einsum("ij,ij->i", rest[live], z)
            p[live] = z + (now / rho[live])[:, None] * p[live]
            rho[live] = now
            live = live[np.linalg.norm(rest[live], axis=1) > wanted[live]]
        raise NotPositiveError


class Solver:
    """A Toeplitz system whose diagonal grows by `ridge` whenever the iteration finds it not positive definite; it starts with `least`."""

    def __init__(self, background: Background, rows: int, cols: int, ridge: float = 0.01, least: float = 0.0) -> None:
        self.of, self.ridge = (background, rows, cols), ridge
        self.matrix = Toeplitz(*self.of, least)

    def __call__(self, b: np.ndarray) -> np.ndarray:
        while True:
            try:
                return self.matrix.solve(b)
            except NotPositiveError:
                self.matrix = Toeplitz(*self.of, self.matrix.ridge + self.ridge)


class Solvers:
    """Solvers of one background by size of template, the last few of which a worker keeps."""

    def __init__(self, background: Background, ridge: float = 0.01, least: float = 0.0) -> None:
        self.background, self.ridge, self.least = background, ridge, least

    def __call__(self, rows: int, cols: int) -> Solver:
        if "_kept" not in self.__dict__:
            self._kept = functools.lru_cache(8)(lambda r, c: Solver(self.background, r, c, self.ridge, self.least))
        return self._kept(rows, cols)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}
