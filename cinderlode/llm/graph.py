"""A robust-pruned directed graph over unit vectors, and its beam search for groups of near queries.

Queries are ordered by their nearest pivot and searched in groups that share a frontier: each step opens the best unopened points of
every query of the group, and one matrix product compares all its queries with all points that are new to it. A point is so read
once a group, and a query profits from what its neighbours opened. The work of a group depends on beam, degree and group size only.

Points are inserted in batches of doubling size: the beam search on the graph so far proposes neighbours, relaxed distance pruning
keeps diverse ones (a proposal is dropped if a kept one is closer to it than 1/alpha of its distance to the point), and reverse
edges are added, with the same pruning where a point gets more than room times degree. Pruned edges are not put back.
"""

from __future__ import annotations

import numpy as np


class Graph:
    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 40, alpha: float = 1.2, group: int = 128, room: int = 4, seed: int = 5):
        self.x, self.n, self.degree, self.group, self.alpha = x, len(x), degree, group, alpha
        self.edges = np.full((self.n, degree * room), -1, np.int32)
        self._new, self._shut = np.ones(self.n + 1, bool), np.ones(self.n + 1, bool)
        self._new[self.n] = False  # the place of -1
        order = np.random.default_rng(seed).permutation(self.n).astype(np.int32)
        self.pivots = order[:max(1, min(self.n, int(self.n ** 0.5)))]
        done = min(self.n, 2 * degree)
        first = order[:done]
        self.edges[first, :degree] = self._pruned(first, np.broadcast_to(first, (done, done)), x[first] @ x[first].T)
        while done < self.n:
            new = order[done:done + min(done, 1 + self.n // 8)]
            self.pivots = order[:max(1, int(min(done, self.n ** 0.5)))]
            ids, sims = self.search(x[new], beam, among=new)
            by = np.argsort(ids[:, 0], kind="stable")  # points with near proposals are pruned together
            for at in range(0, len(new), group):
                s = by[at:at + group]
                self.edges[new[s], :degree] = self._pruned(new[s], ids[s], sims[s])
            self._back(new)
            done += len(new)

    def _pruned(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """At most degree out-neighbours of each point among proposals ids (-1: none), most similar first."""
        sim = np.where((ids < 0) | (ids == points[:, None]), -np.inf, sims)
        by = np.argsort(-sim, axis=1)
        own, sim = np.take_along_axis(ids, by, 1), np.take_along_axis(sim, by, 1)
        alive = np.isfinite(sim)
        alive[:, 1:] &= own[:, 1:] != own[:, :-1]
        named, place = np.unique(own, return_inverse=True)
        place = place.reshape(own.shape)
        if len(named) <= 4 * own.shape[1] + len(points):  # proposals shared by the points: one product for all of them
            v = self.x[named]
            between = (v @ v.T)[place[:, :, None], place[:, None, :]]
        else:
            v = self.x[own]
            between = np.matmul(v, v.transpose(0, 2, 1))
        # Squared distances are 2 - 2 sim; a is kept, b is dropped if alpha^2 (2 - 2 sim(a, b)) <= 2 - 2 sim(p, b).
        drops = self.alpha ** 2 * (1 - between) <= (1 - sim)[:, None, :]
        out, rows = np.full((len(points), self.degree), -1, np.int32), np.arange(len(own))
        for k in range(self.degree):
            pick = alive.argmax(axis=1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            out[ok, k] = own[rows[ok], pick[ok]]
            alive &= ~(drops[rows, pick] & ok[:, None])
            alive[rows, pick] = False
        return out

    def _back(self, new: np.ndarray) -> None:
        """Edges back to the new points, from those they point to."""
        to = self.edges[new, :self.degree]
        src, dst = np.repeat(new, self.degree)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        points, start, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(start, count)
        used = (self.edges[points] >= 0).sum(axis=1)
        easy = used + count <= self.edges.shape[1]
        fits = np.repeat(easy, count)
        self.edges[dst[fits], (np.repeat(used, count) + place)[fits]] = src[fits]
        hard = np.flatnonzero(~easy)
        hard = hard[np.argsort(count[hard])]
        for at in range(0, len(hard), 96):
            h = hard[at:at + 96]
            extra = np.full((len(h), int(count[h].max())), -1, np.int32)
            member = np.repeat(np.arange(len(h)), count[h])
            within = np.arange(len(member)) - np.repeat(np.cumsum(count[h]) - count[h], count[h])
            extra[member, within] = src[np.repeat(start[h], count[h]) + within]
            ids = np.concatenate([self.edges[points[h]], extra], axis=1)
            sims = np.matmul(self.x[ids], self.x[points[h]][:, :, None])[:, :, 0]
            kept = self._pruned(points[h], ids, sims)
            self.edges[points[h]] = -1
            self.edges[points[h], :self.degree] = kept

    def search(self, queries: np.ndarray, beam: int, width: int = 4, starts: int = 2, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam most similar points found for each query: ids (-1 where fewer) and similarities, best first.

        among: the queries' own ids, where they are points; each is then an entry of its group, whether edges lead to it or not.
        """
        ids, sims = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -np.inf, np.float32)
        if not len(queries):
            return ids, sims
        enter = np.empty((len(queries), min(starts, len(self.pivots))), np.int32)
        for at in range(0, len(queries), 4096):
            near = queries[at:at + 4096] @ self.x[self.pivots].T
            best = np.argsort(-near, axis=1)[:, :enter.shape[1]]
            enter[at:at + 4096] = self.pivots[best]
        order = np.lexsort((*enter.T[1:], enter[:, 0]))
        for at in range(0, len(order), self.group):
            s = order[at:at + self.group]
            fresh = enter[s].ravel() if among is None else np.concatenate([enter[s].ravel(), among[s]])
            ids[s], sims[s] = self._search(queries[s], beam, np.unique(fresh), width)
        return ids, sims

    def _search(self, q: np.ndarray, beam: int, fresh: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(q)
        ids, sims = np.full((m, beam), self.n, np.int32), np.full((m, beam), -np.inf, np.float32)
        new, shut = self._new, self._shut  # shut: points that need no opening; True but for those seen and not opened yet
        touched = [fresh]
        new[fresh], shut[fresh] = False, False
        while True:
            if len(fresh):
                near = q @ self.x[fresh].T
                # Only points that enter some beam are merged.
                enters = (near > sims.min(axis=1)[:, None]).any(axis=0)
                fresh, near = fresh[enters], near[:, enters]
                every, each = np.concatenate([sims, near], axis=1), np.concatenate([ids, np.broadcast_to(fresh, near.shape)], axis=1)
                if every.shape[1] > beam:
                    best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
                    ids, sims = np.take_along_axis(each, best, 1), np.take_along_axis(every, best, 1)
            ranked = np.where(shut[ids], -np.inf, sims)
            pick = np.argpartition(-ranked, width - 1, axis=1)[:, :width] if beam > width else np.broadcast_to(np.arange(beam), ranked.shape)
            chosen = np.take_along_axis(ids, pick, 1)[np.isfinite(np.take_along_axis(ranked, pick, 1))]
            if not len(chosen):
                break
            shut[chosen] = True
            fresh = self.edges[np.unique(chosen)].ravel()
            fresh = np.unique(fresh[new[fresh]])
            new[fresh], shut[fresh] = False, False
            touched.append(fresh)
        for t in touched:
            new[t], shut[t] = True, True
        by = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        return np.where(np.isfinite(sims), ids, -1), sims
