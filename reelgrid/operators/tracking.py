"""Multi-object tracking per shot: Kalman prediction and two-stage association by overlap.

After the published ByteTrack method (Zhang et al., arXiv 2110.06864): detections of high
confidence are matched to predicted tracks first, those of low confidence to what is left.
Ids never cross shots. A shot is streamed, so memory does not grow with its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

HIGH, LOW, NEW = 0.25, 0.1, 0.35
MATCH, SECOND_MATCH = 0.2, 0.5  # least overlap in the two stages
LOST_SECONDS = 1.0


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(hi - lo, 0, None).prod(2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(1)
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths."""
    if not cost.size:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            now = c[i0 - 1] - u[i0] - v[1:]
            better = free & (now < least[1:])
            least[1:][better] = now[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _measure(boxes: np.ndarray) -> np.ndarray:
    """Centre x, y, aspect, height."""
    w, h = boxes[:, 2] - boxes[:, 0], np.maximum(boxes[:, 3] - boxes[:, 1], 1e-6)
    return np.stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2, w / h, h], 1)


def _scaled(height: np.ndarray, share: float, aspect: float) -> np.ndarray:
    out = np.repeat((height * share)[:, None], 4, 1)
    out[:, 2] = aspect
    return out**2


class Tracker:
    """State of one shot. All noise is diagonal, so each of the four measures has a filter of its own over place and speed."""

    def __init__(self, frame_rate: float):
        self.place = self.speed = self.pp = self.pv = self.vv = np.zeros((0, 4))
        self.number, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keep = max(1, round(max(1.0, frame_rate) * LOST_SECONDS))
        self.frame = self.last = 0

    ARRAYS = ("place", "speed", "pp", "pv", "vv", "number", "seen")

    def dump(self) -> str:
        """All there is to go on with, as text; numbers come back as they were."""
        return json.dumps({"keep": self.keep, "frame": self.frame, "last": self.last, **{n: getattr(self, n).tolist() for n in self.ARRAYS}})

    @classmethod
    def load(cls, text: str) -> Tracker:
        stored, out = json.loads(text), cls(1.0)
        out.keep, out.frame, out.last = stored["keep"], stored["frame"], stored["last"]
        for n in cls.ARRAYS:
            whole = n in ("number", "seen")
            setattr(out, n, np.array(stored[n], np.int64 if whole else float).reshape((-1,) if whole else (-1, 4)))
        return out

    def _predict(self) -> np.ndarray:
        h = self.place[:, 3]
        self.place = self.place + self.speed
        self.pp = self.pp + 2 * self.pv + self.vv + _scaled(h, 1 / 20, 1e-2)
        self.pv = self.pv + self.vv
        self.vv = self.vv + _scaled(h, 1 / 160, 1e-5)
        x, y, a, h = self.place.T
        return np.stack([x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2], 1)

    def _correct(self, at: np.ndarray, boxes: np.ndarray) -> None:
        off = _measure(boxes) - self.place[at]
        total = self.pp[at] + _scaled(self.place[at, 3], 1 / 20, 1e-1)
        gp, gv = self.pp[at] / total, self.pv[at] / total
        self.place[at] += gp * off
        self.speed[at] += gv * off
        self.vv[at] -= gv * self.pv[at]
        self.pv[at] *= 1 - gp
        self.pp[at] *= 1 - gp
        self.seen[at] = self.frame

    def _open(self, boxes: np.ndarray) -> np.ndarray:
        m = _measure(boxes)
        ids = self.last + 1 + np.arange(len(m))
        self.last += len(m)
        join = lambda old, new: np.concatenate([old, new])
        self.place, self.speed = join(self.place, m), join(self.speed, np.zeros_like(m))
        self.pp, self.pv = join(self.pp, _scaled(m[:, 3], 1 / 10, 1e-2)), join(self.pv, np.zeros_like(m))
        self.vv = join(self.vv, _scaled(m[:, 3], 1 / 16, 1e-5))
        self.number, self.seen = join(self.number, ids), join(self.seen, np.full(len(m), self.frame))
        return ids

    def update(self, boxes: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """Track number of each detection, 0 where it is not tracked. No detection still moves the state on."""
        self.frame += 1
        out = np.zeros(len(boxes), np.int64)
        predicted = self._predict()
        free = np.ones(len(predicted), bool)
        strong, weak = np.flatnonzero(conf >= HIGH), np.flatnonzero((conf >= LOW) & (conf < HIGH))
        for dets, least, tracks in ((strong, MATCH, np.flatnonzero(free)), (weak, SECOND_MATCH, None)):
            if tracks is None:
                tracks = np.flatnonzero(free & (self.seen == self.frame - 1))
            if not len(tracks) or not len(dets):
                continue
            similar = overlaps(predicted[tracks], boxes[dets])
            pairs = [(tracks[r], dets[c]) for r, c in _pairs(similar, least)]
            if pairs:
                at, d = (np.array(x) for x in zip(*pairs, strict=True))
                self._correct(at, boxes[d])
                out[d] = self.number[at]
                free[at] = False
        new = strong[(out[strong] == 0) & (conf[strong] >= NEW)]
        if len(new):
            out[new] = self._open(boxes[new])
        alive = self.frame - self.seen <= self.keep
        if not alive.all():
            for name in self.ARRAYS:
                setattr(self, name, getattr(self, name)[alive])
        return out


def _pairs(similar: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Best assignment among pairs of at least this overlap; where no track or box has a choice, the pairs themselves."""
    near = similar >= least
    if near.sum(0).max(initial=0) <= 1 and near.sum(1).max(initial=0) <= 1:
        return list(zip(*np.nonzero(near), strict=True))
    return [(r, c) for r, c in assign(1 - similar) if near[r, c]]


#: Fewer shots than this are tracked one after the other.
TOGETHER = 6


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each range of n numbers, one range after the other."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """overlaps of boxes pair by pair."""
    side = np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None)
    inter = side.prod(1)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(1)
    union = area(a) + area(b) - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


class _Shots(Tracker):
    """Many shots' trackers as one, a frame of each at a time; tracks are kept by shot, in the order in which they were opened."""

    def __init__(self, trackers: list[Tracker]):
        super().__init__(1.0)
        for name in self.ARRAYS:
            setattr(self, name, np.concatenate([getattr(t, name) for t in trackers]))
        self.shot = np.repeat(np.arange(len(trackers)), [len(t.number) for t in trackers])
        self.frames, self.lasts, self.keeps = (np.array([getattr(t, n) for t in trackers]) for n in ("frame", "last", "keep"))
        self.ended: list[dict] = []

    def _only(self, kept: np.ndarray, put_by: bool = False) -> None:
        if put_by:
            self.ended.append({n: getattr(self, n)[~kept] for n in (*self.ARRAYS, "shot")})
        for name in (*self.ARRAYS, "shot"):
            setattr(self, name, getattr(self, name)[kept])

    def give_back(self, trackers: list[Tracker]) -> None:
        whole = {n: np.concatenate([e[n] for e in self.ended] + [getattr(self, n)]) for n in (*self.ARRAYS, "shot")}
        order = np.argsort(whole["shot"], kind="stable")
        whole = {n: x[order] for n, x in whole.items()}
        at = np.searchsorted(whole["shot"], np.arange(len(trackers) + 1))
        for k, t in enumerate(trackers):
            t.frame, t.last = int(self.frames[k]), int(self.lasts[k])
            for n in self.ARRAYS:
                setattr(t, n, whole[n][at[k] : at[k + 1]].copy())

    def _matched(self, predicted: np.ndarray, tracks: np.ndarray, boxes: np.ndarray, shot: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """_pairs of each shot's tracks and boxes: places in `tracks` and in `boxes`."""
        of = self.shot[tracks]
        lo = np.searchsorted(shot, of)
        n = np.searchsorted(shot, of, "right") - lo
        rows, cols = np.repeat(np.arange(len(tracks)), n), _ranges(lo, n)
        similar = _similar(predicted[tracks[rows]], boxes[cols])
        near = similar >= least
        r, c = rows[near], cols[near]
        twice = np.concatenate([of[np.bincount(r, minlength=len(tracks)) > 1], shot[np.bincount(c, minlength=len(boxes)) > 1]])
        if len(twice):
            plain = ~np.isin(of[r], twice)
            rs, cs, by_pair = [r[plain]], [c[plain]], of[rows]
            for s in np.unique(twice):
                here = slice(np.searchsorted(by_pair, s), np.searchsorted(by_pair, s, "right"))
                width = int(n[rows[here.start]])
                pairs = np.array(_pairs(similar[here].reshape(-1, width), least), np.int64).reshape(-1, 2)
                rs.append(rows[here.start] + pairs[:, 0])
                cs.append(cols[here.start] + pairs[:, 1])
            r, c = np.concatenate(rs), np.concatenate(cs)
        return r, c

    def step(self, active: np.ndarray, boxes: np.ndarray, conf: np.ndarray, shot: np.ndarray) -> np.ndarray:
        """Tracker.update of one frame of each active shot: its boxes, by shot."""
        there = active[self.shot]
        if not there.all():
            self._only(there, put_by=True)
        self.frames[active] += 1
        out = np.zeros(len(boxes), np.int64)
        predicted = self._predict()
        free = np.ones(len(predicted), bool)
        strong, weak = np.flatnonzero(conf >= HIGH), np.flatnonzero((conf >= LOW) & (conf < HIGH))
        for dets, least in ((strong, MATCH), (weak, SECOND_MATCH)):
            tracks = np.flatnonzero(free if dets is strong else free & (self.seen == self.frames[self.shot] - 1))
            if not len(tracks) or not len(dets):
                continue
            r, c = self._matched(predicted, tracks, boxes[dets], shot[dets], least)
            if len(r):
                at, d = tracks[r], dets[c]
                self._correct(at, boxes[d])
                self.seen[at] = self.frames[self.shot[at]]
                out[d] = self.number[at]
                free[at] = False
        new = strong[(out[strong] == 0) & (conf[strong] >= NEW)]
        if len(new):
            of = shot[new]
            self._open(boxes[new])
            ids = self.lasts[of] + 1 + np.arange(len(of)) - np.searchsorted(of, of)
            out[new] = self.number[-len(of) :] = ids
            self.seen[-len(of) :] = self.frames[of]
            self.lasts += np.bincount(of, minlength=len(self.lasts))
            self.shot = np.concatenate([self.shot, of])
            self._only(np.argsort(self.shot, kind="stable"))
        alive = self.frames[self.shot] - self.seen <= self.keeps[self.shot]
        if not alive.all():
            self._only(alive)
        return out


def advance(trackers: list[Tracker], frames: np.ndarray, starts: np.ndarray, boxes: np.ndarray, conf: np.ndarray) -> np.ndarray:
    """Track number of each box. trackers: one a shot; frames: how many of the frames, which lie shot by shot, are each shot's; starts: where each frame's boxes begin, and the end.

    The k-th frames of all shots are done together, as long as several shots have one: the same
    numbers and states as shot by shot, and much less work where shots are short.
    """
    out, first = np.zeros(len(boxes), np.int64), np.concatenate([[0], np.cumsum(frames)[:-1]]).astype(np.int64)
    common = int(np.sort(frames)[-TOGETHER]) if len(frames) >= TOGETHER else 0
    if common:
        many = _Shots(trackers)
        for k in range(common):
            active = frames > k
            at = first[active] + k
            n = starts[at + 1] - starts[at]
            d = _ranges(starts[at], n)
            out[d] = many.step(active, boxes[d], conf[d], np.repeat(np.flatnonzero(active), n))
        many.give_back(trackers)
    for s in np.flatnonzero(frames > common):
        for f in range(first[s] + common, first[s] + frames[s]):
            lo, hi = starts[f], starts[f + 1]
            out[lo:hi] = trackers[s].update(boxes[lo:hi], conf[lo:hi])
    return out


COLUMNS = ("run_id", "shot_id", "frame_index", "det_no", "x1", "y1", "x2", "y2", "conf")
TRACKED = "run_id string, shot_id int, frame_index long, det_no int, track_id long"


def track(detections: DataFrame, frame_rate: float, carry: tuple[int, str] | None = None, states: bool = False, state_of: int | None = None) -> DataFrame:
    """(run_id, shot_id, frame_index, det_no, x1, y1, x2, y2, conf; one row of null det_no for a frame without any) -> tracked rows with track_id.

    Shots are dealt to tasks and streamed in frame order: a task holds one Arrow batch, the
    frame at its edge and the tracks in sight, however long a shot is. A shot whose earlier
    frames were tracked before goes on from carry, its shot_id and the tracker's state; with
    `states` a row of null det_no and track_id follows each shot's last frame, whose `state` is
    that of its tracker then; with `state_of` after that shot alone.
    """
    rate = float(max(1, round(frame_rate)))
    types = pa.schema([("run_id", pa.string()), ("shot_id", pa.int32()), ("frame_index", pa.int64()), ("det_no", pa.int32()), ("track_id", pa.int64())] + [("state", pa.string())] * states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shot, tracker, last = None, Tracker(rate), None

        def ended() -> Iterator[pa.RecordBatch]:
            if states and shot is not None and state_of in (None, shot[1]):
                yield pa.RecordBatch.from_pylist([{"run_id": shot[0], "shot_id": shot[1], "frame_index": last, "state": tracker.dump()}], types)

        def done(rows: pa.Table, keys: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal shot, tracker, last
            begins = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]  # of frames
            opens = [k for k, i in enumerate(begins) if not k or keys[i][:2] != keys[begins[k - 1]][:2]]  # of shots, by frame
            det = rows["det_no"].to_numpy(zero_copy_only=False).astype(float)
            there = np.flatnonzero(~np.isnan(det))
            numbers = np.stack([rows[c].to_numpy(zero_copy_only=False).astype(float) for c in COLUMNS[4:]], 1)[there]
            trackers = []
            for k in opens:
                here = keys[begins[k]][:2]
                trackers.append(tracker if here == shot else Tracker.load(carry[1]) if carry is not None and here[1] == carry[0] else Tracker(rate))
            starts = np.searchsorted(there, np.append(begins, len(keys)))
            frames = np.diff(np.append(opens, len(begins)))
            if keys[0][:2] != shot:
                yield from ended()
            ids = np.zeros(len(keys), np.int64)
            ids[there] = advance(trackers, frames, starts, numbers[:, :4], numbers[:, 4])
            for k, (own, n) in enumerate(zip(trackers, frames, strict=True)):
                at = keys[begins[opens[k] + n - 1]]
                shot, tracker, last = at[:2], own, at[2]
                if k + 1 < len(trackers):
                    yield from ended()
            kept = np.flatnonzero(ids > 0)
            out = rows.select(COLUMNS[:4]).take(kept).append_column("track_id", pa.array(ids[kept]))
            out = out.append_column("state", pa.nulls(len(kept), pa.string())) if states else out
            yield from out.cast(types).combine_chunks().to_batches()

        rest = None  # rows of the frame that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            keys = list(zip(*(rows[c].to_pylist() for c in COLUMNS[:3]), strict=True))
            cut = len(keys)
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            rest = rows.slice(cut)
            if cut:
                yield from done(rows.slice(0, cut), keys[:cut])
        if rest is not None:
            yield from done(rest, list(zip(*(rest[c].to_pylist() for c in COLUMNS[:3]), strict=True)))
        yield from ended()

    # a stated number: few bytes make much work here, so tasks are not to be merged by size
    tasks = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return detections.select(*COLUMNS).repartition(tasks, "run_id", "shot_id").sortWithinPartitions(*COLUMNS[:4]).mapInArrow(run, TRACKED + (", state string" if states else ""))
