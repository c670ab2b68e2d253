"""Image-to-court homography from visible keypoints: normalised direct linear transform inside a seeded RANSAC.

The court plane is (across, along) in feet, so the inlier threshold is in feet as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid import court

THRESHOLD_FEET = 5.0
LEAST_POINTS = 4
TRIALS = 400
TRIALS_AT_ONCE = 16
#: Frames of a first fit, and of RANSAC, that are done together.
FRAMES_AT_ONCE, SAMPLED_AT_ONCE = 2000, 200
#: Samples end once the chance that none of them held inliers alone is below this.
MISSED = 1e-4
#: Samples by number of points; a functools cache would be pickled by its module's name, which workers may not have.
_DRAWN: dict[int, np.ndarray] = {}
#: Least share of the second least eigenvalue in the greatest, from which the products of the rows are exact enough.
CLEAR = 1e-9
SOLVED = "struct<homography:array<array<double>>,used_keypoint_ids:array<string>>"


def _fit_samples(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homographies (k, 3, 3) through samples of four points (k, 4, 2), all at once, and which of them are no degenerate ones."""
    triples = np.array(list(combinations(range(4), 3)))

    def spread(p: np.ndarray) -> np.ndarray:
        u, v = p[:, triples[:, 1]] - p[:, triples[:, 0]], p[:, triples[:, 2]] - p[:, triples[:, 0]]
        return np.abs(u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]).min(1)

    good = (spread(src) >= 1e-9) & (spread(dst) >= 1e-9)

    def basis(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first three points as columns, their adjugate, and how much of each makes the fourth."""
        q = np.concatenate([p, np.ones(p.shape[:2] + (1,))], 2)
        adjugate = np.stack([np.cross(q[:, 1], q[:, 2]), np.cross(q[:, 2], q[:, 0]), np.cross(q[:, 0], q[:, 1])], 1)
        return q[:, :3].transpose(0, 2, 1), adjugate, (adjugate @ q[:, 3, :, None])[..., 0]

    _, back, share = basis(src)
    to, _, shown = basis(dst)
    scale = np.divide(shown, share, out=np.ones_like(share), where=good[:, None])
    return (to * scale[:, None, :]) @ back, good


def _samples(n: int) -> np.ndarray:
    """The samples of n points, the same for every frame: all of few points, else TRIALS drawn from a seed."""
    if n not in _DRAWN:
        _DRAWN[n] = np.array(list(combinations(range(n), 4))) if n <= 9 else np.argsort(np.random.default_rng(0).random((TRIALS, n)), 1)[:, :4]
    return _DRAWN[n]


def _consensus(src: np.ndarray, dst: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """RANSAC of frames of n points each, together: src and dst (k, n, 2) -> the points of the best sample's homography (k, n), and how many.

    A frame is done once a sample without outliers has hardly been missed; the others go on.
    """
    n, picks, frames = src.shape[1], _samples(src.shape[1]), np.arange(len(src))
    ones = np.ones(src.shape[:2])
    ts, td = _normalisers(src, ones), _normalisers(dst, ones)
    s, d, back = _moved(ts, src), _moved(td, dst), np.linalg.inv(td)
    best, most, least = np.zeros(src.shape[:2], bool), np.zeros(len(src), np.int64), np.full(len(src), np.inf)
    for done in range(0, len(picks), TRIALS_AT_ONCE):
        at = picks[done : done + TRIALS_AT_ONCE]
        h, good = _fit_samples(s[frames][:, at].reshape(-1, 4, 2), d[frames][:, at].reshape(-1, 4, 2))
        h = back[frames, None] @ h.reshape(-1, len(at), 3, 3) @ ts[frames, None]
        moved = np.stack([_moved(h[:, k], src[frames]) for k in range(len(at))], 1)
        err = np.nan_to_num(np.sqrt(((moved - dst[frames, None]) ** 2).sum(3)), nan=np.inf)
        inside = (err <= threshold) & good.reshape(-1, len(at), 1)
        count, total = inside.sum(2), np.where(inside, err, 0).sum(2)
        here = np.where(count == count.max(1, keepdims=True), total, np.inf).argmin(1)
        row = np.arange(len(frames))
        count, total, inside = count[row, here], total[row, here], inside[row, here]
        better = (count > most[frames]) | ((count == most[frames]) & (total < least[frames]) & (count > 0))
        to = frames[better]
        best[to], most[to], least[to] = inside[better], count[better], total[better]
        clean = (most[frames] / n) ** 4  # chance that a sample holds inliers alone
        with np.errstate(divide="ignore"):
            over = (clean >= 1) | ((clean > 0) & ((done + len(at)) * np.log1p(-np.minimum(clean, 1)) < np.log(MISSED)))
        frames = frames[~over]
        if not len(frames):
            break
    return best, most


def _normalisers(p: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """_normaliser of the seen points of every frame: p (k, n, 2), seen (k, n) as 0 and 1 -> (k, 3, 3)."""
    count = np.maximum(seen.sum(1), 1)
    centre = (p * seen[..., None]).sum(1) / count[:, None]
    spread = (np.sqrt(((p - centre[:, None]) ** 2).sum(2)) * seen).sum(1) / count
    s = np.divide(np.sqrt(2), spread, out=np.ones_like(spread), where=spread > 0)
    out = np.zeros((len(p), 3, 3))
    out[:, 0, 0] = out[:, 1, 1] = s
    out[:, :2, 2] = -s[:, None] * centre
    out[:, 2, 2] = 1
    return out


def _moved(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points (k, n, 2) through the homographies (k, 3, 3)."""
    q = p @ h[:, :, :2].transpose(0, 2, 1) + h[:, None, :, 2]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return q[..., :2] / q[..., 2:]


def fit_all(src: np.ndarray, dst: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares homographies (k, 3, 3) of k frames at once from their seen points, and which of them there are.

    An unseen point's equations are rows of zeros, which change no singular vector, so frames
    of any points share one stack. The vector is that of the least eigenvalue of the 9 x 9
    products; where the next one is small too, the products are too coarse, and the rows are
    made nine by QR and decomposed.
    """
    weight = seen.astype(float)
    src = np.where(seen[..., None], src, 0.0)
    planes = np.broadcast_to(dst, src.shape)
    ts, td = _normalisers(src, weight), _normalisers(planes, weight)
    s, d = _moved(ts, src), _moved(td, planes)
    x, y, u, v = s[..., 0], s[..., 1], d[..., 0], d[..., 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([
        np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], 2) * weight[..., None], np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], 2) * weight[..., None],
    ], 1)
    squares, vectors = np.linalg.eigh(rows.transpose(0, 2, 1) @ rows)
    null, full = vectors[:, :, 0], squares[:, 1] >= CLEAR * squares[:, 8]
    if not full.all():
        close = ~full
        _, sizes, vt = np.linalg.svd(np.linalg.qr(rows[close], mode="r"))
        null[close], full[close] = vt[:, -1], sizes[:, 7] >= 1e-9 * sizes[:, 0]
    h = np.linalg.inv(td) @ null.reshape(-1, 3, 3) @ ts
    last = h[:, 2, 2]
    good = (seen.sum(1) >= LEAST_POINTS) & full & (np.abs(last) > 1e-12)
    return h / np.where(good, last, 1.0)[:, None, None], good


def solve_all(src: np.ndarray, dst: np.ndarray, seen: np.ndarray, threshold: float = THRESHOLD_FEET) -> list[np.ndarray | None]:
    """Of every frame the homography with most seen points within the threshold, fitted to those points: src (k, n, 2), dst (n, 2), seen (k, n).

    Frames whose first fit leaves no seen point beyond the threshold are done, as no sample can
    hold more; RANSAC sees the others, frames of equally many points together. Equal input
    gives equal output. Fewer than four points, a number that is not finite, or points that no
    homography fits: null.
    """
    src = np.where(seen[..., None], src, 0.0)
    usable = (seen.sum(1) >= LEAST_POINTS) & np.isfinite(src).all((1, 2))
    out: list[np.ndarray | None] = [None] * len(src)
    for at in range(0, len(src), FRAMES_AT_ONCE):
        which = at + np.flatnonzero(usable[at : at + FRAMES_AT_ONCE])
        if not len(which):
            continue
        h, good = fit_all(src[which], dst, seen[which])
        err = ((_moved(h, src[which]) - dst) ** 2).sum(2)
        good &= ((err <= threshold**2) | ~seen[which]).all(1)
        for i, whole in zip(which[good], h[good], strict=True):
            out[i] = whole
        left = which[~good]
        count = seen[left].sum(1)
        for n in np.unique(count):
            for lo in range(0, int((count == n).sum()), SAMPLED_AT_ONCE):
                some = left[count == n][lo : lo + SAMPLED_AT_ONCE]
                points = np.nonzero(seen[some])[1].reshape(-1, n)
                best, most = _consensus(src[some[:, None], points], dst[points], threshold)
                held = np.zeros((len(some), seen.shape[1]), bool)
                np.put_along_axis(held, points, best, 1)
                h, good = fit_all(src[some], dst, held)
                for i, fits, whole in zip(some, good & (most >= LEAST_POINTS), h, strict=True):
                    out[i] = whole if fits else None
    return out


def solve(src: np.ndarray, dst: np.ndarray, threshold: float = THRESHOLD_FEET) -> np.ndarray | None:
    """solve_all of one frame's points."""
    return solve_all(src[None], dst, np.ones((1, len(src)), bool), threshold)[0]


def homography(points: Column, template: str) -> Column:
    """Canonical points -> struct of the 3 x 3 matrix and the ids of all visible points; fewer than four: null and none."""
    feet = court.template(template)
    plane = np.array([(feet[i][1], feet[i][0]) for i in court.IDS])
    ids = np.array(list(court.IDS))
    n = len(ids)

    @F.pandas_udf(SOLVED)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = np.zeros((len(batch), n * 3))  # a frame of other than n points has no homography by them
            for k, points in enumerate(batch):
                if points is not None and len(points) == n * 3:
                    flat[k] = points
            rows = flat.reshape(-1, n, 3)
            seen = rows[..., 2] > 0
            solved = solve_all(rows[..., :2], plane, seen)
            yield pd.DataFrame({
                "homography": pd.Series([None if h is None else h.tolist() for h in solved], dtype=object),
                "used_keypoint_ids": pd.Series([[] if h is None else ids[on].tolist() for h, on in zip(solved, seen, strict=True)], dtype=object),
            })

    # plain numbers reach the workers as arrays, structs as a dictionary each
    return apply(F.flatten(F.transform(points, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"), p["v"].cast("double")))))


def with_homography(frames: DataFrame, template: str, points: str = "keypoints") -> DataFrame:
    """Adds `solved`. Frames are independent: no shuffle."""
    return frames.withColumn("solved", homography(F.col(points), template))
