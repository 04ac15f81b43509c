"""Numpy work on the families of one bucket, as stacks of matrices of equal size; called in tasks only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Stack:
    """All blocks of one size: members, blocks x size places in the sorted bucket, and a matrix for each block."""

    members: np.ndarray
    k: np.ndarray


#: Right-hand sides that are solved at once for a large block.
COLUMNS = 64
#: Residual, as a share of the right-hand side, at which a solution stands.
RESIDUAL = 1e-12
#: Numbers ahead of a large block's row of entries: a mark (NaN), whether the target is known, and the variances.
_HEAD = 8


@dataclass
class Sparse:
    """A block too large for dense matrices: members, places in the sorted bucket; entries by row, their places counted within the block. Nothing is
    inverted: products with inverses come from conjugate gradients."""

    members: np.ndarray
    row: np.ndarray
    column: np.ndarray
    k: np.ndarray

    def times(self, x: np.ndarray) -> np.ndarray:
        """K x."""
        out = np.zeros(x.shape)
        if len(self.row):
            first = runs(self.row)[0]
            out[self.row[first]] = np.add.reduceat(self.k[:, None] * x[self.column], first)
        return out

    def rows(self, seen: np.ndarray, v: Variances) -> list[np.ndarray]:
        """For each person _HEAD numbers, then place and value of each entry: all that quadratics needs."""
        numbers = [x for pair in (v.s, v.t, v.ts) for x in (pair or (0.0, 0.0))]
        cut = np.searchsorted(self.row, np.arange(1, len(self.members)))
        entries = np.split(np.column_stack((self.column.astype(float), self.k)), cut)
        return [np.concatenate(([np.nan, float(known), *numbers], own.ravel())) for known, own in zip(seen, entries)]

    def solved(self, v: Variances, seen: np.ndarray, s: np.ndarray, t: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The surrogate's covariance inverted, times the columns of s. With t, whose rows are 0 where the target is unknown, the covariance of surrogate
        and known targets inverted, times s over t: both parts."""
        n = len(self.members)
        if t is None:
            return conjugate(lambda x: v.s[0] * self.times(x) + v.s[1] * x, s), None

        def both(x: np.ndarray) -> np.ndarray:
            kx = self.times(np.concatenate((x[:n], x[n:]), axis=1))
            ks, kt = kx[:, : x.shape[1]], kx[:, x.shape[1] :]
            top = v.s[0] * ks + v.s[1] * x[:n] + v.ts[0] * kt + v.ts[1] * x[n:]
            low = v.ts[0] * ks + v.ts[1] * x[:n] + v.t[0] * kt + v.t[1] * x[n:]
            return np.concatenate((top, low * seen[:, None]))

        found = conjugate(both, np.concatenate((s, t)))
        return found[:n], found[n:]

    def weights(self, z: np.ndarray, seen: np.ndarray, v: Variances, p: int) -> np.ndarray:
        """The columns of families.weights."""
        x, none = z[:, :p], np.zeros((len(z), p))
        own = self.solved(v, seen, np.concatenate((z[:, p : p + 1], x), axis=1))[0]
        if v.t is None:
            return own
        known = z * seen[:, None]
        # by the inverse of a matrix in blocks: V where the target meets itself, -H where it meets the surrogate
        s = np.concatenate((z[:, p : p + 1], none, x), axis=1)
        t = np.concatenate((known[:, p + 1 : p + 2], known[:, :p], none), axis=1)
        top, low = self.solved(v, seen, s, t)
        return np.concatenate((own, low[:, : 1 + p], -low[:, 1 + p :], -top[:, 1 : 1 + p]), axis=1)

    def quadratics(self, g: np.ndarray, seen: np.ndarray, v: Variances) -> np.ndarray:
        """g'Qg, and for two responses g'Vg and g'Hg (columns), for each row of g."""
        out = []
        for at in range(0, len(g), COLUMNS):
            own = g[at : at + COLUMNS].T
            columns = [(own * self.solved(v, seen, own)[0]).sum(axis=0)]
            if v.t is not None:
                top, low = self.solved(v, seen, np.zeros(own.shape), own * seen[:, None])
                columns += [(own * low).sum(axis=0), -(own * top).sum(axis=0)]
            out.append(np.stack(columns, axis=1))
        return np.concatenate(out) if out else np.zeros((0, 1 if v.t is None else 3))


def conjugate(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray) -> np.ndarray:
    """x with times(x) = b, for each column of b, by conjugate gradients; raises where the matrix isn't positive definite."""
    x = np.zeros(b.shape)
    open_ = np.flatnonzero((b != 0).any(axis=0))
    enough = RESIDUAL**2 * (b**2).sum(axis=0)
    r = b[:, open_].astype(float)
    d, rr = r.copy(), (r**2).sum(axis=0)
    for _ in range(2 * len(b) + 100):
        if not len(open_):
            return x
        kd = times(d)
        curve = (d * kd).sum(axis=0)
        if not (curve > 0).all():
            raise np.linalg.LinAlgError("a covariance is not positive definite")
        step = rr / curve
        x[:, open_] += step * d
        r = r - step * kd
        before, rr = rr, (r**2).sum(axis=0)
        d = r + (rr / before) * d
        left = rr > enough[open_]
        if not left.all():
            open_, r, d, rr = open_[left], r[:, left], d[:, left], rr[left]
    raise np.linalg.LinAlgError("a covariance is too close to singular")


def runs(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values."""
    if not len(block):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return first, np.diff(np.concatenate((first, [len(block)])))


def stacks(iid: np.ndarray, block: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray] | None, most: int | None = None) -> list[Stack | Sparse]:
    """People sorted by block, then id. entries: i, j, k within blocks, both triangles; None for unrelated people. Blocks of more than `most` people are
    Sparse."""
    first, sizes = runs(block)
    found = []
    if entries is not None:
        by_id = np.argsort(iid)
        a, b = (by_id[np.searchsorted(iid[by_id], side)] for side in entries[:2])
        start, size_of = np.repeat(first, sizes), np.repeat(sizes, sizes)
    for size in np.unique(sizes):
        starts = first[sizes == size]
        if most is not None and entries is not None and size > most:
            for at in starts:
                own = np.flatnonzero(start[a] == at)
                own = own[np.lexsort((b[own], a[own]))]
                found.append(Sparse(at + np.arange(size), a[own] - at, b[own] - at, entries[2][own]))
            continue
        k = np.zeros((len(starts), size, size))
        if entries is None:
            k[:] = np.eye(size)
        else:
            own = size_of[a] == size
            at = start[a[own]]
            k[np.searchsorted(starts, at), a[own] - at, b[own] - at] = entries[2][own]
        found.append(Stack(starts[:, None] + np.arange(size), k))
    return found


def inverse(matrices: np.ndarray) -> np.ndarray:
    """Raises where a matrix isn't positive definite."""
    np.linalg.cholesky(matrices)
    return np.linalg.inv(matrices)


def moment_sums(found: list[Stack | Sparse], z: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """n, trace, squares off the diagonal, z'z and z'Kz without K's diagonal: of all people, then of those seen."""
    out = []
    for z_, w in ((z, np.ones(len(z))), (z * seen[:, None], seen.astype(float))):
        trace = squares = 0.0
        quad = np.zeros((z.shape[1], z.shape[1]))
        for s in found:
            if isinstance(s, Sparse):
                own, same = w[s.members], s.row == s.column
                trace += float((s.k * own[s.row])[same].sum())
                squares += float((s.k**2 * own[s.row] * own[s.column])[~same].sum())
                zs = z_[s.members]
                quad += zs.T @ Sparse(s.members, s.row, s.column, np.where(same, 0.0, s.k)).times(zs)
                continue
            k, own = s.k.copy(), w[s.members]
            diagonal = np.einsum("bii->bi", k)
            trace += float((diagonal * own).sum())
            diagonal[:] = 0
            squares += float((k**2 * own[:, :, None] * own[:, None, :]).sum())
            zs = z_[s.members]
            quad += zs.reshape(-1, z.shape[1]).T @ (k @ zs).reshape(-1, z.shape[1])
        out += [[w.sum(), trace, squares], (z_.T @ z_).ravel(), quad.ravel()]
    return np.concatenate([np.asarray(o, float) for o in out])


@dataclass
class Moments:
    """moment_sums taken apart again."""

    n: float
    trace: float
    squares: float
    zz: np.ndarray
    zkz: np.ndarray

    @staticmethod
    def of(sums: np.ndarray, columns: int) -> tuple[Moments, Moments]:
        half = 3 + 2 * columns**2
        return tuple(
            Moments(*part[:3], part[3 : 3 + columns**2].reshape(columns, columns), part[3 + columns**2 :].reshape(columns, columns))
            for part in (sums[:half], sums[half:])
        )

    def pair(self, a: np.ndarray, b: np.ndarray, floor: float | None = None) -> tuple[float, float]:
        """tau and sigma of the residuals z a and z b."""
        if not self.squares:
            raise ValueError("the relatedness matrix has no entries off its diagonal: use covariance='diag'")
        tau = float(a @ self.zkz @ b) / self.squares
        sigma = (float(a @ self.zz @ b) - tau * self.trace) / self.n
        return tau, sigma if floor is None else max(sigma, floor)


def residual(zz: np.ndarray, p: int, column: int) -> np.ndarray:
    """Weights of the columns of z whose sum is the residual of one column on the first p."""
    weights = np.zeros(len(zz))
    weights[:p] = -np.linalg.solve(zz[:p, :p], zz[:p, column])
    weights[column] = 1
    return weights


@dataclass
class Variances:
    """(tau, sigma) of the target, the surrogate and between them. Single responses have `s` only."""

    s: tuple[float, float]
    t: tuple[float, float] | None = None
    ts: tuple[float, float] | None = None


def forms(k: np.ndarray, seen: np.ndarray, v: Variances) -> list[np.ndarray]:
    """q, and for two responses v and h: the inverse covariance of the surrogate, of the target given it, and v times the
    regression of one on the other. Rows of people whose target is unknown are 0 in v and h."""
    eye = np.eye(k.shape[-1])
    q = inverse(v.s[0] * k + v.s[1] * eye)
    if v.t is None:
        return [q]
    both = seen[:, :, None] * seen[:, None, :]
    cross = (v.ts[0] * k + v.ts[1] * eye) * seen[:, :, None]
    d = cross @ q
    own = (v.t[0] * k + v.t[1] * eye - d @ np.swapaxes(cross, 1, 2)) * both
    own[:, np.arange(len(eye)), np.arange(len(eye))] += ~seen
    inner = inverse(own) * both
    return [q, inner, inner @ d]


def weights(found: list[Stack | Sparse], z: np.ndarray, seen: np.ndarray, v: Variances, p: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """A row of linear weights per person, and the forms of each stack. z: p covariates, then the surrogate's residual, and the
    target's. Columns: Qs, Qx, and for two responses Vt - Hs, Vx, Hx, H'x."""
    x, s = z[:, :p], z[:, p : p + 1]
    joint = v.t is not None
    out, all_forms = np.zeros((len(z), 1 + p + (1 + 3 * p if joint else 0))), []
    for stack in found:
        m = stack.members
        if isinstance(stack, Sparse):
            out[m] = stack.weights(z[m], seen[m], v, p)
            all_forms.append(stack.rows(seen[m], v))
            continue
        parts = forms(stack.k, seen[m], v)
        q, xs = parts[0], x[m]
        columns = [q @ s[m], q @ xs]
        if joint:
            _, vv, h = parts
            columns += [vv @ z[m][:, :, p + 1 : p + 2] - h @ s[m], vv @ xs, h @ xs, np.swapaxes(h, 1, 2) @ xs]
        out[m] = np.concatenate(columns, axis=2)
        all_forms.append(parts)
    return out, all_forms


def flat_rows(found: list[Stack | Sparse], all_forms: list[list[np.ndarray]], n: int) -> pa.ListArray:
    """For each person the person's rows of the forms, one after another, or in a large block the person's Sparse.rows."""
    lengths = np.zeros(n, np.int64)
    for stack, parts in zip(found, all_forms):
        lengths[stack.members] = [len(r) for r in parts] if isinstance(stack, Sparse) else len(parts) * stack.members.shape[1]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    values = np.zeros(offsets[-1])
    for stack, parts in zip(found, all_forms):
        if isinstance(stack, Sparse):
            values[offsets[stack.members[0]] : offsets[stack.members[-1] + 1]] = np.concatenate(parts)
            continue
        rows = np.concatenate(parts, axis=2)
        values[offsets[stack.members][:, :, None] + np.arange(rows.shape[2])] = rows
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def from_flat(block: np.ndarray, rows: pa.ListArray, n_forms: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Members (blocks x size) and forms (forms x blocks x size x size) of each size; people are sorted by block, then id. Large blocks are left out."""
    first, sizes = runs(block)
    offsets, values = rows.offsets.to_numpy(), rows.values.to_numpy()
    dense = ~np.isnan(values[offsets[first]])
    first, sizes = first[dense], sizes[dense]
    found = []
    for size in np.unique(sizes):
        members = first[sizes == size][:, None] + np.arange(size)
        own = values[offsets[members][:, :, None] + np.arange(n_forms * size)]
        found.append((members, own.reshape(*members.shape, n_forms, size).transpose(2, 0, 1, 3)))
    return found


def large_from_flat(block: np.ndarray, rows: pa.ListArray, joint: bool) -> list[tuple[Sparse, np.ndarray, Variances]]:
    """The large blocks of flat_rows, who has a target, and the variances."""
    first, sizes = runs(block)
    offsets, values = rows.offsets.to_numpy(), rows.values.to_numpy()
    found = []
    for at, size in zip(first, sizes):
        head = values[offsets[at] : offsets[at] + _HEAD]
        if not np.isnan(head[0]):
            continue
        members = np.arange(at, at + size)
        counts = (offsets[members + 1] - offsets[members] - _HEAD) // 2
        flat = values[offsets[at] : offsets[at + size]]
        heads = (offsets[members] - offsets[at])[:, None] + np.arange(_HEAD)
        entries = np.delete(flat, heads.ravel()).reshape(-1, 2)
        s, t, ts = ((float(a), float(b)) for a, b in head[2:].reshape(3, 2))
        block_ = Sparse(members, np.repeat(np.arange(size), counts), entries[:, 0].astype(np.int64), entries[:, 1])
        found.append((block_, flat[heads[:, 1]], Variances(s, t, ts) if joint else Variances(s)))
    return found


def quadratic(g: np.ndarray, members: np.ndarray, form: np.ndarray) -> np.ndarray:
    """g'Fg over the blocks of one size, for each row of g (variants x people)."""
    own = np.ascontiguousarray(g[:, members].transpose(1, 0, 2))
    return ((own @ form) * own).sum(axis=(0, 2))


def solve_sums(xw: np.ndarray, p: int) -> dict[str, np.ndarray]:
    """What a score needs of x'w, w being all weights' columns. Leading axes are replicates."""
    part = lambda at, n: xw[..., at : at + n]
    arrays = {"bx": xw[..., 0], "a22": np.linalg.inv(part(1, p))}
    if xw.shape[-1] > 1 + p:
        arrays |= {"vr": xw[..., 1 + p], "c": np.linalg.inv(part(2 + p, p)), "vdx": part(2 + 2 * p, p)}
    return arrays


def finish(sums: np.ndarray, arrays: dict[str, np.ndarray], p: int) -> np.ndarray:
    """num, info, var of each variant (columns). sums: a row per variant of g'w for all weights, then the quadratic forms; arrays
    as of solve_sums, for all variants or with a leading axis of variants. A variant that the covariates explain has NaN."""
    times = lambda m, v: np.einsum("...ij,...j->...i", m, v)
    dot = lambda a, b: (a * b).sum(axis=-1)
    b, a = sums[:, 0], sums[:, 1 : 1 + p]
    am = times(arrays["a22"], a)
    if "c" not in arrays:
        info = sums[:, 1 + p] - dot(a, am)
        num, var = b - dot(am, arrays["bx"]), info
    else:
        w = sums[:, 1 + p]
        c, ell, z = (sums[:, 2 + p + k * p : 2 + p + (k + 1) * p] for k in range(3))
        q_gg, v_gg, h_gg = sums[:, 2 + 4 * p : 5 + 4 * p].T
        gamma = times(arrays["c"], c)
        own, info, dg = q_gg - dot(a, am), v_gg - dot(c, gamma), h_gg - dot(gamma, z)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = (b - dot(am, arrays["bx"])) / own
            dx = ell - times(np.swapaxes(arrays["vdx"], -1, -2), gamma)
            fitted = times(arrays["a22"], arrays["bx"]) - am * alpha[:, None]
            # v'A v = v for the exact inverse, so the target's own part of the variance is info
            num = w - dot(gamma, arrays["vr"]) + dg * alpha + dot(dx, fitted)
            var = info + dot(dx, times(arrays["a22"], dx)) + (dg - dot(dx, am)) ** 2 / own
        info = np.where(own > 1e-9, info, np.nan)
    good = (info > 1e-9) & (var > 1e-9)
    return np.where(good[:, None], np.stack((num, info, var), axis=1), np.nan)
