"""A hierarchical navigable small-world graph over the vectors of one shard.

Beams of many queries advance together: a round expands the new members of all beams, so its cost is a few
array operations however many queries take part.  Vectors are inserted in batches in the same way; the members
of a batch see the graph before them and each other.
"""

from __future__ import annotations

import io

import numpy as np

M = 8
BUILD_BEAM = 24
#: Links per node on the lowest level and above it; lists are pruned back to these when they are full.
ROOM, KEPT = (24, 16), (16, 8)
#: Queries whose beams advance together, and vectors inserted together.
TOGETHER = 256
#: Nearest vectors of its own batch that an inserted one considers.
PEERS = 16


class Hnsw:
    """Unit vectors in rows; similarity is the dot product."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.links, self.entry = links if links is not None else [], entry

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 5) -> Hnsw:
        """Insert the vectors in a fixed shuffled order, so that runs of copies do not come first, in batches no larger than the graph."""
        graph = cls(vectors)
        n = len(graph.x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 6)
        order = rng.permutation(n)
        graph.links = [np.full((n, ROOM[min(1, k)]), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        graph.used = [np.zeros(n, np.int32) for _ in graph.links]
        at, top = 0, -1
        while at < n:
            batch = order[at:at + max(16, min(TOGETHER, at))]
            graph._insert(batch, level[batch], top)
            best = batch[np.argmax(level[batch])]
            if level[best] > top:
                graph.entry, top = int(best), int(level[best])
            at += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, level: np.ndarray, top: int) -> None:
        q, n = self.x[batch], len(batch)
        among = q @ q.T
        np.fill_diagonal(among, -2.0)
        owner, ids = np.arange(n), np.full(n, self.entry)
        for k in range(max(top, int(level.max())), -1, -1):
            stays = level >= k
            found = None
            if k <= top:
                width = np.where(stays, BUILD_BEAM, 1)
                owner, ids, sims = self.beams(q, owner, ids, width, k)
                found = np.searchsorted(owner, np.arange(n + 1))
            members = np.flatnonzero(stays)
            chosen = []
            for i in members.tolist():
                peers = members[np.argpartition(-among[i, members], min(PEERS, len(members)) - 1)[:PEERS]]
                peers = peers[among[i, peers] > -2.0]
                near, to = batch[peers], among[i, peers]
                if found is not None:
                    near = np.concatenate([ids[found[i]:found[i + 1]], near])
                    to = np.concatenate([sims[found[i]:found[i + 1]], to])
                chosen.append(self._diverse(q[i], near[np.argsort(-to, kind="stable")], M))
            for i, near in zip(members.tolist(), chosen):
                self._link(int(batch[i]), near, k)
            for i, near in zip(members.tolist(), chosen):
                for j in near.tolist():
                    self._link(j, np.array([batch[i]]), k)

    def _link(self, j: int, new: np.ndarray, level: int) -> None:
        """Add links to a node; a full list is pruned to diverse ones."""
        links, used = self.links[level], self.used[level]
        old = links[j, :used[j]]
        new = new[~(new[:, None] == old).any(1)]
        total = used[j] + len(new)
        if total <= links.shape[1]:
            links[j, used[j]:total] = new
            used[j] = total
            return
        every = np.concatenate([old, new])
        every = self._diverse(self.x[j], every[np.argsort(-(self.x[every] @ self.x[j]), kind="stable")], KEPT[min(1, level)])
        links[j] = -1
        links[j, :len(every)] = every
        used[j] = len(every)

    def _diverse(self, q: np.ndarray, found: np.ndarray, room: int) -> np.ndarray:
        """Of nodes by falling similarity, those nearer to q than to any taken before; then the nearest others."""
        if len(found) <= room:
            return found
        x = self.x[found]
        to_q, among = x @ q, x @ x.T
        blocked, taken = np.zeros(len(found), bool), []
        for k in range(len(found)):
            if not blocked[k]:
                taken.append(k)
                if len(taken) == room:
                    break
                blocked |= among[k] > to_q
        if len(taken) < room:
            chosen = set(taken)
            taken += [k for k in range(len(found)) if k not in chosen][:room - len(taken)]
        return found[taken]

    def beams(self, q: np.ndarray, owner: np.ndarray, start: np.ndarray, width: np.ndarray | int, level: int,
              keep: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, node and similarity of all beams, by query and best first.

        A beam holds a query's best ``width`` nodes and all others of at least ``keep``.  Each round looks at the
        neighbours of all members not looked at before.
        """
        n, links = len(self.x), self.links[level]
        width = np.broadcast_to(width, len(q))
        seen = np.zeros(len(q) * n, bool)
        code = np.unique(owner.astype(np.int64) * n + start)
        seen[code] = True
        owner, ids = np.divmod(code, n)
        sims, fresh = np.einsum("ij,ij->i", self.x[ids], q[owner]), np.ones(len(ids), bool)
        while True:
            near = links[ids[fresh]]
            code = (owner[fresh][:, None] * n + near)[near >= 0]
            code = np.unique(code[~seen[code]])
            if not len(code):
                break
            seen[code] = True
            o, i = np.divmod(code, n)
            owner, ids = np.concatenate([owner, o]), np.concatenate([ids, i])
            sims = np.concatenate([sims, np.einsum("ij,ij->i", self.x[i], q[o])])
            fresh = np.concatenate([np.zeros(len(fresh), bool), np.ones(len(i), bool)])
            order = np.lexsort((-sims, owner))
            owner, ids, sims, fresh = owner[order], ids[order], sims[order], fresh[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            stays = (rank < width[owner]) | (sims >= keep)
            owner, ids, sims, fresh = owner[stays], ids[stays], sims[stays], fresh[stays]
        order = np.lexsort((-sims, owner))
        return owner[order], ids[order], sims[order]

    def search(self, queries: np.ndarray, width: int, keep: float, starts: int = 1) -> list[np.ndarray]:
        """Nodes of at least ``keep`` for each query; ``starts`` spreads further starting points over the lowest level."""
        out = []
        more = np.linspace(0, len(self.x) - 1, starts).astype(np.int64) if starts > 1 else np.zeros(0, np.int64)
        # all beams' marks together take at most as many bytes as those of TOGETHER queries over 65,536 nodes
        step = max(1, min(TOGETHER, TOGETHER * 65_536 // max(1, len(self.x) + len(more))))
        for at in range(0, len(queries), step):
            q = np.ascontiguousarray(queries[at:at + step], np.float32)
            owner, ids = np.arange(len(q)), np.full(len(q), self.entry)
            for level in range(len(self.links) - 1, 0, -1):
                owner, ids, _ = self.beams(q, owner, ids, 1, level)
            owner = np.concatenate([owner, np.repeat(np.arange(len(q)), len(more))])
            ids = np.concatenate([ids, np.tile(more, len(q))])
            owner, ids, sims = self.beams(q, owner, ids, width, 0, keep)
            owner, ids = owner[sims >= keep], ids[sims >= keep]
            out += np.split(ids, np.searchsorted(owner, np.arange(1, len(q))))
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, entry=self.entry, **{f"l{k}": v for k, v in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Hnsw:
        z = np.load(io.BytesIO(data))
        return cls(z["x"], [z[f"l{k}"] for k in range(len(z.files) - 2)], int(z["entry"]))
