"""SentencePiece encoding and decoding, with Gumbel top-k sampling of distinct segmentations.

No piece has a space mark after another character, so the lattice of a text falls apart at each run of
space marks: it is a chain of word lattices, and a worker keeps those of the words it has met (see Store).
A forward pass gives every node's total weight, hence the exact probability of each last piece; the
segmentations of a text are the leaves of a tree whose branches are these choices, word by word.

The search is A* over that tree with perturbed log-probabilities (Kool et al., 2019): the root draws a
Gumbel value, the children of a node draw Gumbels conditioned on their maximum being the node's value, and
an agenda expands the highest value first. A node's value is the exact maximum over its leaves, so leaves
come out in order of perturbed log-probability: k draws without replacement, all distinct. With kappa the
value of the next best agenda entry, a leaf's inclusion score is log(1 - exp(-exp(log p - kappa))).

All noise is a counter-based hash of the row's key, the word's place, the step, the edge and the draw, so a
row's samples do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import contextlib
import re
from itertools import chain, compress, pairwise, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Log-weight of a piece: its score in the model times this.
SCALE = 0.0005
SAMPLES = 2
#: Characters of the texts sampled together.
GROUP_CHARS = 500_000
#: Edges of the word lattices that a worker keeps; a word has 20 or so.
MAX_EDGES = 7_000_000
#: New words whose lattices are made together.
FRESH_WORDS = 16_384
#: Entropy of the words of a text whose untaken choices are looked at first.
NEAR_NATS = 40.0
UNKNOWN_PENALTY = 10.0
CHUNKS = re.compile(f"{SPACE}+[^{SPACE}]*")

_models: dict = {}
_stores: dict = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Model:
    def __init__(self, path: str, scale: float):
        import numpy as np
        import pyarrow as pa
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in normal}
        if any(SPACE in t.lstrip(SPACE) for t in text.values()):
            raise ValueError("pieces across words: the lattice does not fall apart at spaces")
        self.longest = max(map(len, text.values()))
        self.mult = np.uint64(0x9E3779B97F4A7C15)
        score = np.array([sp.get_score(i) for i in range(n)])
        self.unknown = scale * (min(score[normal]) - UNKNOWN_PENALTY)
        self.logw = scale * score
        #: by length, which hashes (by 18 bits of their product with mult) begin a piece of that length or more
        self.begins = {k: np.zeros(1 << 18, bool) for k in range(1, self.longest + 1)}
        #: the pieces' hashes and ids by the same bits, or at the next free place
        self.keys, self.ids, self.lengths = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int32), set()
        for i in normal:
            h = 0
            for k, c in enumerate(text[i]):
                h = (h * int(self.mult) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                at = (h * int(self.mult) & 0xFFFFFFFFFFFFFFFF) >> 46
                self.begins[k + 1][at] = True
            while self.ids[at] >= 0:
                if int(self.keys[at]) == h:
                    raise ValueError("two pieces share a hash")
                at = (at + 1) & 0x3FFFF
            self.keys[at], self.ids[at] = h, i
            self.lengths.add(len(text[i]))
        surface = [b""] * n
        for i, t in text.items():
            surface[i] = t.encode()
        for b, i in self.byte.items():
            surface[i] = bytes([b])
        self.surfaces = pa.array(surface, pa.large_binary())
        #: characters of each piece; taken with clipping, so that the unknown ones (below 0) have 1
        self.chars = np.array([len(text.get(i, "x")) for i in range(n)], np.int32)
        self.marked = np.array([text.get(i, "").startswith(SPACE) for i in range(n)])


def model(path: str, scale: float) -> Model:
    if (path, scale) not in _models:
        _models[path, scale] = Model(path, scale)
    return _models[path, scale]


def words_of(text: str) -> list[str]:
    """The chain of word lattices, each without its first space mark."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and SPACE not in text:
        return text.split(" ")
    return [c[1:] for c in CHUNKS.findall(SPACE + text.replace(" ", SPACE))]


def _spread(starts, counts):
    """All indices of the ranges starts .. starts + counts, one after the other."""
    import numpy as np

    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Lattices:
    """Word lattices of a group of texts, in one set of arrays; edges are in order of their end node.

    An edge's start is its end less its piece's characters; it is not stored.
    """

    def __init__(self, m: Model, words: list[str]):
        import numpy as np

        full = SPACE + SPACE.join(words) if words else ""
        self.code = code = np.frombuffer(full.encode("utf-32-le", "surrogatepass"), np.uint32)
        if full.count(SPACE) == len(words):
            lens = np.diff(np.flatnonzero(code == ord(SPACE)), append=len(code))
        else:
            lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.lens = lens
        offs = np.cumsum(lens) - lens
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        left = np.repeat((offs + lens).astype(np.int32), lens) - np.arange(len(code), dtype=np.int32)
        base = offs + np.arange(len(words))  # node of each word's start
        here = np.arange(len(code), dtype=np.int32)
        h = np.zeros(len(code), np.uint64)
        unit = code.astype(np.uint64) + np.uint64(1)
        single = np.zeros(len(code), bool)
        start, length, piece = [], [], []
        for n in range(1, m.longest + 1):
            if n > 1:
                keep = np.flatnonzero(left[here] >= n)
                here, h = here[keep], h[keep]
            if not len(here):
                break
            h = h * m.mult + unit[here + np.int32(n - 1)]
            slot = (h * m.mult >> np.uint64(46)).astype(np.int32)
            keep = np.flatnonzero(m.begins[n][slot])
            here, h, slot = here[keep], h[keep], slot[keep]
            if n not in m.lengths:
                continue
            open_ = None
            while True:  # a hash's place or, while other hashes hold it, the next
                own = m.keys[slot] == (h if open_ is None else h[open_])
                hit = np.flatnonzero(own) if open_ is None else open_[own]
                if len(hit):
                    start.append(here[hit])
                    length.append(n)
                    piece.append(m.ids[slot[own]])
                    if n == 1:
                        single[here[hit]] = True
                more = np.flatnonzero(~own & (m.ids[slot] >= 0))
                if not len(more):
                    break
                open_ = more if open_ is None else open_[more]
                slot = (slot[more] + 1) & 0x3FFFF
        rest = np.flatnonzero(~single).astype(np.int32)  # a character that is no piece: its bytes, as one edge
        start.append(rest)
        length.append(1)
        piece.append(-code[rest].astype(np.int32) - 1)
        # the longest piece of a node first: the likeliest, so that a draw by running sums ends soon
        length = np.repeat(np.array(length[::-1], np.int32), list(map(len, start[::-1])))
        start, piece = (np.concatenate(x[::-1]) for x in (start, piece))
        head = start + word[start] + length  # node id: one more node than characters in each word
        nodes = len(code) + len(words)
        # a counting sort by end node: each length has a node at most once, so its edges go to the next free places
        degree = np.bincount(head, minlength=nodes)
        self.ptr = np.concatenate([[0], np.cumsum(degree)])
        free = self.ptr[:-1].astype(np.int32)
        order = np.empty(len(head), np.int32)
        cuts = np.flatnonzero(np.diff(length)) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(head)]):
            to = free[head[a:b]]
            order[to] = np.arange(a, b, dtype=np.int32)
            free[head[a:b]] = to + np.int32(1)
        self.piece, head, length = piece[order], head[order], length[order]
        tail = head - length
        logw = np.where(self.piece >= 0, m.logw.take(self.piece, mode="clip"), m.unknown)
        self.first, self.last = base, base + lens
        total = np.full(nodes, -np.inf)
        total[base] = 0.0
        # nodes by their place in the word, each with its edges in a row: one step for all words
        place = np.arange(nodes) - np.repeat(base, lens + 1)
        by = np.argsort(place.astype(np.int16) if lens.max(initial=0) < 32767 else place, kind="stable")
        for here in np.split(by, np.flatnonzero(np.diff(place[by])) + 1)[1:]:
            n = degree[here]
            e = _spread(self.ptr[here], n)
            w = total[tail[e]] + logw[e]
            begin = np.cumsum(n) - n
            top = np.maximum.reduceat(w, begin)
            total[here] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, n)), begin))
        self.logp = total[tail] + logw - total[head]
        # running sums over a node's edges, for draws of one edge without its siblings
        upto = np.exp(self.logp)
        at_last, n_last = self.ptr[self.last], degree[self.last]
        e = _spread(at_last, n_last)
        self.entropy = np.add.reduceat(-upto[e] * self.logp[e], np.cumsum(n_last) - n_last) if len(e) else np.zeros(0)
        for r in range(1, int(degree.max(initial=0))):
            at = self.ptr[:-1][degree > r] + r
            upto[at] += upto[at - 1]
        self.upto = upto.astype(np.float32)


class Store:
    """Lattices and best ids of words met so far, side by side in arrays with room to grow.

    A worker keeps one across groups and tasks. Past ``max_edges`` it keeps only the words that several groups
    had, under half of that; so it is bounded by them and the words of one group, whatever the input.
    A word's lattice and its ids do not depend on what else is held.
    """

    EDGES = {"piece": "int32", "logp": "float64", "upto": "float32"}
    WORDS = {"first": "int64", "last": "int64", "entropy": "float64", "best_at": "int64", "best_n": "int64", "uses": "int32"}

    def __init__(self, m: Model, max_edges: int):
        import numpy as np

        self.m, self.chars, self.index, self.max_edges = m, m.chars, {}, max_edges
        self.n = {"word": 0, "node": 0, "edge": 0, "id": 0}
        # pages of an empty array take no memory until they are written
        rooms = dict.fromkeys(self.EDGES, max_edges) | dict.fromkeys(self.WORDS, 1024) | {"ptr": max_edges // 2, "best": 1024}
        for k, t in (self.EDGES | self.WORDS | {"ptr": "int64", "best": "int32"}).items():
            setattr(self, k, np.empty(rooms[k], t))

    def _put(self, name: str, at: int, values) -> None:
        import numpy as np

        held = getattr(self, name)
        if at + len(values) > len(held):
            room = np.empty(max(len(held) * 3 // 2, at + len(values)), held.dtype)
            room[:at] = held[:at]
            setattr(self, name, room)
            held = room
        held[at : at + len(values)] = values

    def _append(self, words, first, last, ptr, entropy, piece, logp, upto, best, sizes, uses) -> None:
        """Words whose nodes, edges and ids are numbered from 0."""
        import numpy as np

        w, nodes, edges, n_ids = self.n.values()
        for name, at, values in (
            ("first", w, first + nodes), ("last", w, last + nodes), ("entropy", w, entropy), ("best_at", w, np.cumsum(sizes) - sizes + n_ids), ("best_n", w, sizes), ("uses", w, uses),
            ("ptr", nodes, ptr + edges), ("piece", edges, piece), ("logp", edges, logp), ("upto", edges, upto), ("best", n_ids, best),
        ):
            self._put(name, at, values)
        self.index.update(zip(words, range(w, w + len(words)), strict=True))
        self.n = {"word": w + len(words), "node": nodes + len(ptr) - 1, "edge": edges + len(piece), "id": n_ids + len(best)}

    def _shrink(self) -> None:
        import numpy as np

        n = self.n["word"]
        cost = self.ptr[self.last[:n] + 1] - self.ptr[self.first[:n]]
        order = np.argsort(-self.uses[:n], kind="stable")
        order = np.sort(order[(self.uses[order] > 1) & (np.cumsum(cost[order]) <= self.max_edges // 2)])
        # in place, one array after the other: what is kept moves towards the front, and no second store is made
        first, size, cost = self.first[order], (self.last - self.first)[order] + 1, cost[order]
        n_ids, best_at = self.best_n[order], self.best_at[order]
        edges = _spread(self.ptr[first], cost).astype(np.int32)
        for k in self.EDGES:
            held = getattr(self, k)
            held[: len(edges)] = held[edges]
        del edges
        node_at, edge_at = np.cumsum(size) - size, np.cumsum(cost) - cost
        ptr = self.ptr[_spread(first, size)]
        ptr -= np.repeat(self.ptr[first] - edge_at, size)
        self.ptr[: len(ptr)] = ptr
        self.ptr[len(ptr)] = n_edges = int(cost.sum())
        best = self.best[_spread(best_at, n_ids)]
        self.best[: len(best)] = best
        words = len(order)
        self.entropy[:words], self.uses[:words], self.best_n[:words] = self.entropy[order], self.uses[order] // 2, n_ids
        self.first[:words], self.last[:words], self.best_at[:words] = node_at, node_at + size - 1, np.cumsum(n_ids) - n_ids
        kept = np.zeros(n, bool)
        kept[order] = True
        self.index = dict(zip(compress(self.index, kept.tolist()), range(words)))  # words are in order of their numbers
        self.n = {"word": words, "node": len(ptr), "edge": n_edges, "id": len(best)}

    def numbers(self, words: list[str]):
        """Number of each of a group's distinct words, after adding the new ones."""
        import numpy as np

        find = lambda: np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        at = find()
        if self.n["edge"] > self.max_edges and (at < 0).any():
            self._shrink()
            at = find()
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            at[new] = np.arange(len(fresh)) + self.n["word"]
            for some in (fresh[i : i + FRESH_WORDS] for i in range(0, len(fresh), FRESH_WORDS)):
                best, sizes = best_ids(self.m, some)
                lat = Lattices(self.m, some)
                self._append(some, lat.first, lat.last, lat.ptr, lat.entropy, lat.piece, lat.logp, lat.upto, best, sizes, np.zeros(len(some), np.int32))
        self.uses[at] += 1
        return at

    def head(self, edge):
        """The end node of each edge."""
        import numpy as np

        return np.searchsorted(self.ptr[: self.n["node"] + 1], edge, side="right") - 1


def store(m: Model, max_edges: int | None = None) -> Store:
    size = max_edges or MAX_EDGES
    if (m, size) not in _stores:
        _stores.clear()  # a worker has room for one
        _stores[m, size] = Store(m, size)
    return _stores[m, size]


def split_words(texts: list[str]):
    """Distinct words of a group of texts, the number of each word in turn, and where each text's words begin."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = [(t if t[0] != " " and "  " not in t and SPACE not in t else " ".join(words_of(t))) if t else None for t in texts]
    lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
    coded = lists.values.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)


def mix64(x):
    """splitmix64's finaliser on an array of unsigned integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gumbel(bits):
    import numpy as np

    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(-np.log(u))


GOLD = 0x9E3779B97F4A7C15


def walk(lat: Store, node, first, place, step, seed, near):
    """Choose last pieces from each occurrence's node back to its word's start.

    Yields for each round occurrences, steps and chosen edges; and, for the occurrences that are ``near``,
    occurrence, step, edge, perturbed log-probability and the choice's maximum of every edge not taken.
    Elsewhere an edge is drawn by its running sum, which has the same distribution.
    """
    import numpy as np

    # steps of a word are unbounded, so places are mixed first
    own_seed = mix64(seed + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + step.astype(np.uint64) * np.uint64(GOLD)
    todo = node > first
    for live, draw in ((np.flatnonzero(todo & ~near), _draw_far), (np.flatnonzero(todo & near), _draw_near)):
        at, own, begin, steps = node[live], own_seed[live], first[live], step[live]
        while len(live):
            edge, found = draw(lat, at, mix64(own))
            yield live, steps, edge, found and (live[found[0]], steps[found[0]], *found[1:])
            at = at - lat.chars.take(lat.piece[edge], mode="clip")
            more = np.flatnonzero(at > begin)
            live, at, begin, steps, own = live[more], at[more], begin[more], steps[more] + 1, own[more] + np.uint64(GOLD)


def _draw_far(lat, node, mark):
    import numpy as np

    u = ((mark >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    edge = lat.ptr[node]
    open_ = np.flatnonzero(u >= lat.upto[edge])
    at, last, u = edge[open_], lat.ptr[node[open_] + 1] - 1, u[open_]
    while True:
        on = np.flatnonzero(at < last)
        if not len(on):
            return edge, None
        open_, at, last, u = open_[on], at[on] + 1, last[on], u[on]
        edge[open_] = at
        on = np.flatnonzero(u >= lat.upto[at])
        open_, at, last, u = open_[on], at[on], last[on], u[on]


def _draw_near(lat, node, mark):
    import numpy as np

    begin = lat.ptr[node]
    n = lat.ptr[node + 1] - begin
    edges = _spread(begin, n)
    own = np.repeat(np.arange(len(node)), n)
    at = np.cumsum(n) - n
    rank = np.arange(len(edges)) - at[own]
    a = lat.logp[edges] + gumbel(mix64(mark[own] + rank.astype(np.uint64) * np.uint64(GOLD) + np.uint64(1)))
    top = np.maximum.reduceat(a, at)
    hits = np.flatnonzero(a == top[own])
    if len(hits) > len(node):
        hits = hits[np.concatenate([[True], np.diff(own[hits]) > 0])]
    others = np.ones(len(edges), bool)
    others[hits] = False
    others = np.flatnonzero(others)
    o = own[others]
    return edges[hits], (o, edges[others], a[others], top[o])


def _log1mexp(x):
    """log(1 - exp(x)) for x < 0."""
    import numpy as np

    return np.where(x > -0.6931471805599453, np.log(-np.expm1(np.minimum(x, -1e-300))), np.log1p(-np.exp(x)))


def conditioned(value, phi, a, top):
    """Gumbel value of a sibling with log-probability part phi + (a - noise), given the best one has ``value``."""
    import numpy as np

    v = value - (phi + a) + _log1mexp(np.minimum(a - top, -1e-300))
    return value - np.maximum(0.0, v) - np.log1p(np.exp(-np.abs(v)))


class Sampler:
    """k distinct segmentations for each text of a group."""

    def __init__(self, lat: Store, occ, bounds, seeds, k: int, near_nats: float = NEAR_NATS):
        import numpy as np

        self.lat, self.occ, self.bounds, self.seeds, self.k = lat, occ, bounds, seeds, k
        # Words of each text whose untaken choices are looked at first: as many as leave so little mass
        # open, going by the entropy of their last choice, that a later one can hardly matter.
        run = np.concatenate([[0.0], np.cumsum(lat.entropy[occ])])
        self.near = np.searchsorted(run, run[bounds[:-1]] + near_nats) - bounds[:-1] + 1

    def run(self):
        """For each draw: alive texts, and of all texts' choices, by occurrence from its end on, the number for each occurrence, edges and log-probabilities."""
        import numpy as np

        lat, occ, bounds = self.lat, self.occ, self.bounds
        docs = len(bounds) - 1
        doc = np.repeat(np.arange(docs), np.diff(bounds))
        place = np.arange(len(occ)) - bounds[doc]
        first = lat.first[occ]
        value = gumbel(mix64(self.seeds ^ np.uint64(0xD1B54A32D192ED03)))
        node, step = lat.last[occ].copy(), np.zeros(len(occ), np.int64)
        base = np.zeros(docs)  # log-probability of what a path has before its new part
        agenda: list[list] = [[] for _ in range(docs)]
        alive = np.ones(docs, bool)
        paths: list[tuple] = []  # of each draw: choices of each occurrence, edges, log-probabilities, place of each occurrence's first choice
        fresh = np.ones(len(occ), bool)
        n_kept = np.zeros(docs, np.int64)
        branch = bounds[:-1]  # the first occurrence with new choices
        for draw in range(self.k + 1):
            if draw:
                # take the best agenda entry of each text; a text whose agenda is empty is done
                picks = [max(range(len(q)), key=lambda i, q=q: q[i][0]) if q else None for q in agenda]
                best = [q.pop(i) if i is not None else None for q, i in zip(agenda, picks, strict=True)]
                value = np.array([b[0] if b else -np.inf for b in best])
                self.kappa = value
                if draw == self.k:
                    break
                alive = value > -np.inf
                d = np.flatnonzero(alive)
                o, s, e, src = (np.array([best[i][j] for i in d.tolist()], np.int64) for j in range(1, 5))
                # what a path keeps: its choices before the branch, and the other choice there
                node = np.where(np.repeat(alive, np.diff(bounds)), lat.last[occ], first)
                step = np.zeros(len(occ), np.int64)
                fresh = np.zeros(len(occ), bool)
                fresh[_spread(o, bounds[d + 1] - o)] = True
                node[~fresh] = first[~fresh]
                node[o] = lat.head(e) - lat.chars.take(lat.piece[e], mode="clip")
                step[o] = s + 1
                n_kept = np.zeros(docs, np.int64)
                branch = bounds[:-1].copy()
                branch[d] = o
                held = np.zeros(len(occ), np.int64)
                held[o] = s + 1
                kept = []
                for n, (own, pe, pl, at) in enumerate(paths):
                    mine = np.flatnonzero(src == n)
                    dm, om = d[mine], o[mine]
                    begin = at[bounds[dm]]
                    count = at[om] + s[mine] - begin
                    whole = _spread(bounds[dm], om - bounds[dm])
                    held[whole] = own[whole]
                    run = np.concatenate([[0.0], np.cumsum(pl)])
                    base[dm] = run[begin + count] - run[begin] + lat.logp[e[mine]]
                    n_kept[dm] = count + 1
                    i = _spread(begin, count)
                    kept.append((dm, count, pe[i], pl[i]))
            seed = mix64(self.seeds + np.uint64((draw + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))[doc]
            start = np.where(fresh, node, first)
            near = self.near.copy()
            got = list(walk(lat, start, first, place, step, seed, place < near[doc]))
            while True:
                size = np.zeros(len(occ), np.int64)
                for live, *_ in got:
                    size[live] += 1
                begin = np.cumsum(size) - size - step  # an occurrence's choices stand by step
                pe = np.empty(int(size.sum()), np.int64)
                for live, steps, edge, _ in got:
                    pe[begin[live] + steps] = edge
                pl = lat.logp[pe]
                text_at = np.concatenate([[0], np.cumsum(size)])[bounds]
                run = np.concatenate([[0.0], np.cumsum(pl)])
                phi = lambda i, d, run=run, text_at=text_at: run[i] - run[text_at[d]] + base[d]  # noqa: E731  log-probability before a choice
                again = self._siblings([x[3] for x in got if x[3]], begin, phi, doc, value, agenda, draw, near, size, branch)
                if not len(again):
                    break
                # the first words leave too much open: look at all words of these texts
                near[again] = 1 << 40
                redo = np.zeros(docs, bool)
                redo[again] = True
                redo = redo[doc]
                got = [self._without(x, redo) for x in got] + list(walk(lat, np.where(redo, start, first), first, place, step, seed, redo))
            if draw:
                n_new = np.diff(text_at)
                to = np.concatenate([[0], np.cumsum(n_kept + n_new)])
                whole = np.empty(int(to[-1]), np.int64), np.empty(int(to[-1]))
                for dm, count, ke, kl in kept:
                    i = _spread(to[dm], count)
                    whole[0][i], whole[1][i] = ke, kl
                i = to[d] + n_kept[d] - 1
                whole[0][i], whole[1][i] = e, lat.logp[e]
                i = np.arange(len(pe)) + np.repeat(to[:-1] + n_kept - text_at[:-1], n_new)
                whole[0][i], whole[1][i] = pe, pl
                pe, pl = whole
                size = size + held
            paths.append((size, pe, pl, np.concatenate([[0], np.cumsum(size)])))
            yield alive.copy(), size, pe, pl

    @staticmethod
    def _without(part, gone):
        live, steps, edge, found = part
        keep = ~gone[live]
        return live[keep], steps[keep], edge[keep], found and tuple(x[~gone[found[0]]] for x in found)

    def _siblings(self, rounds, begin, phi, doc, value, agenda, draw, near, size, branch):
        """Put each text's best k + 1 - draw siblings of the new path on its agenda.

        Returns the texts where a sibling beyond the first ``near`` words might be among them; then nothing
        is put. What is beyond has a total mass of exp(phi), so a leaf of it passes the floor with a chance
        of about exp(phi - floor); under e^-25 that is nothing.
        """
        import numpy as np

        docs = len(agenda)
        so, ss, se, a, top = (np.concatenate(x) for x in zip(*rounds, strict=True)) if rounds else (np.zeros(0, np.int64),) * 5
        d = doc[so]
        before = phi(begin[so] + ss, d) if len(so) else a
        part = before + a
        want = self.k - draw
        # A sibling's value is at most part + log(2 / min(1, top - a)); the agenda and the siblings of a text's
        # first new choices give a floor for its best ones, and only siblings that can reach it are worked out.
        floor = np.array([sorted((x[0] for x in q), reverse=True)[want - 1] if len(q) >= want else -np.inf for q in agenda])
        early = np.flatnonzero(so - branch[d] < 12)
        if len(early):
            v = conditioned(value[d[early]], before[early], a[early], top[early])
            order = np.lexsort((-v, d[early]))
            de, ve = d[early][order], v[order]
            nth = np.searchsorted(de, np.arange(docs)) + want - 1
            ok = (nth < len(de)) & (de[np.minimum(nth, len(de) - 1)] == np.arange(docs))
            floor[ok] = np.maximum(floor[ok], ve[nth[ok]])
        beyond = np.flatnonzero(np.diff(self.bounds) > near)
        if len(beyond):
            at = self.bounds[beyond] + near[beyond]
            seen = size[at] > 0
            open_ = beyond[seen][phi(begin[at[seen]], beyond[seen]) + 25.0 >= floor[beyond[seen]]]
            if len(open_):
                return open_
        able = np.flatnonzero((part + 20.0 >= floor[d]) | (top - a < 1e-8))
        v = conditioned(value[d[able]], before[able], a[able], top[able])
        good = v >= floor[d[able]]
        able, v = able[good], v[good]
        order = np.lexsort((se[able], -v, d[able]))
        able, v = able[order], v[order]
        lead = np.searchsorted(d[able], np.arange(docs + 1))
        for t in range(docs):
            for i in range(lead[t], min(lead[t] + want, lead[t + 1])):
                x = able[i]
                agenda[t].append((float(v[i]), int(so[x]), int(ss[x]), int(se[x]), draw))
        return np.zeros(0, np.int64)


def _ids(m: Model, size, pieces, bounds):
    """Ids in reading order and where each text's begin, from choices made end to start in each occurrence."""
    import numpy as np

    ends = np.cumsum(size)
    out = pieces[np.repeat(2 * ends - size - 1, size) - np.arange(len(pieces))]
    at = np.concatenate([[0], ends])[bounds]
    low = np.flatnonzero(out < 0)
    if not len(low):
        return out, at
    # characters that are no pieces: their bytes
    codes, which = np.unique(-out[low] - 1, return_inverse=True)
    own = [[m.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
    counts = np.ones(len(out), np.int64)
    counts[low] = np.fromiter(map(len, own), np.int64, len(own))[which]
    run = np.concatenate([[0], np.cumsum(counts)])
    flat = np.repeat(out, counts)
    for j in range(4):
        has = np.array([len(x) > j for x in own])[which]
        flat[run[low[has]] + j] = np.array([x[min(j, len(x) - 1)] for x in own])[which[has]]
    return flat, run[at]


def best_ids(m: Model, words: list[str]):
    """Deterministic ids of the words, flat, with their counts."""
    import numpy as np

    sizes, flat = np.zeros(len(words), np.int64), []
    odd = [i for i, w in enumerate(words) if not w or SPACE in w]
    plain = words
    if odd:  # a mark of the text itself, or a space mark alone; the library gives an empty text none
        lists = [m.sp.encode(words[i].replace(SPACE, " ")) or [m.sp.piece_to_id(SPACE)] for i in odd]
        sizes[odd] = list(map(len, lists))
        flat = [np.array(x, np.int64) for x in lists]
        gone = set(odd)
        plain = [w for i, w in enumerate(words) if i not in gone]
    # no piece goes across a blank: some words at a time, told apart by the mark that begins each
    parts = m.sp.encode_as_numpy([" ".join(plain[i : i + 16]) for i in range(0, len(plain), 16)], num_threads=1)
    ids = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    own = np.diff(np.flatnonzero(m.marked[ids]), append=len(ids))
    if not odd:
        return ids, own
    rest = np.ones(len(words), bool)
    rest[odd] = False
    sizes[rest] = own
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    out[_spread(at[rest], own)] = ids
    out[_spread(at[odd], sizes[odd])] = np.concatenate(flat)
    return out, sizes


def give_back() -> None:
    """Return freed memory to the system: a worker stays, idle, beside the executor's other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def digest(ids, bounds):
    """XXH64 of each range of ids, as 32-bit little-endian integers, signed."""
    import numpy as np
    import xxhash

    data = memoryview(ids.astype("<i4")).cast("B")
    h64 = xxhash.xxh64_intdigest
    return np.array([h64(data[4 * a : 4 * b]) for a, b in pairwise(bounds.tolist())], np.uint64).view(np.int64)


def decoded(m: Model, ids, bounds) -> list[str]:
    """The text of each range of ids, as the library's decode gives it for ids of encoded text."""
    import pyarrow as pa

    joined = m.surfaces.take(pa.array(ids, pa.int32()))
    if not len(ids):
        return [""] * (len(bounds) - 1)
    ends, data = joined.buffers()[1:]
    ends = memoryview(ends).cast("q")[joined.offset :]
    data = memoryview(data) if data else b""
    texts = [str(data[ends[a] : ends[b]], "utf-8", "replace").replace(SPACE, " ") for a, b in pairwise(bounds.tolist())]
    return [t[1:] if t[:1] == " " else t for t in texts]


def spells(m: Model, ids, bounds, texts: list[str], wanted: bytes, ends) -> list[bool]:
    """Whether each range of ids decodes to its text; wanted are the texts as pieces spell them, ends where each ends."""
    import numpy as np
    import pyarrow as pa

    joined = m.surfaces.take(pa.array(ids, pa.int32()))
    at, data = joined.buffers()[1:] if len(ids) else (None, None)
    at = np.frombuffer(at, np.int64)[joined.offset : joined.offset + len(ids) + 1][bounds] if len(ids) else np.zeros(len(bounds), np.int64)
    if np.array_equal(at, ends) and (not len(ids) or data.slice(0, int(ends[-1])).equals(pa.py_buffer(wanted))):
        return [SPACE not in t for t in texts]  # a mark of the text itself comes back as a blank
    return [a == b for a, b in zip(decoded(m, ids, bounds), texts, strict=True)]


def encode_group(m: Model, texts: list[str], seeds, k: int, near_nats: float = NEAR_NATS, max_edges: int | None = None):
    """For each text: best ids, round trip, and k samples as ``(alive, ids, bounds, log p, log inclusion)``.

    The best ids and those of every sample are decoded; the round trip holds if all give the text.
    """
    import numpy as np

    words, occ, bounds = split_words(texts)
    held = store(m, max_edges)
    occ = held.numbers(words)[occ] if words else np.zeros(0, np.int64)
    n = held.best_n[occ]
    ids = held.best[_spread(held.best_at[occ], n)]
    cut = np.concatenate([[0], np.cumsum(n)])[bounds]
    drawn = _sample(m, held, occ, bounds, seeds, k, near_nats) if k and len(occ) else []
    spelt = [(SPACE + t.replace(" ", SPACE)).encode() if t else b"" for t in texts]
    wanted, ends = b"".join(spelt), np.cumsum([0, *map(len, spelt)])
    same = np.array(spells(m, ids, cut, texts, wanted, ends), bool)
    for alive, got, at, _, _ in drawn:
        same &= np.array(spells(m, got, at, texts, wanted, ends), bool) | ~alive
    return (ids, cut, same), drawn


def _sample(m, lat: Store, occ, bounds, seeds, k, near_nats=NEAR_NATS):
    import numpy as np

    if not len(occ):
        none = np.zeros(len(seeds))
        return [(np.zeros(len(seeds), bool), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64), none, none)] * k
    sampler = Sampler(lat, occ, bounds, seeds, k, near_nats)
    drawn = []
    for alive, size, e, lp in sampler.run():
        got, cut = _ids(m, size, lat.piece[e], bounds)
        at = np.concatenate([[0], np.cumsum(size)])[bounds]
        drawn.append((alive & (np.diff(bounds) > 0), got, cut, np.diff(np.concatenate([[0.0], np.cumsum(lp)])[at])))
    kappa = sampler.kappa
    out = []
    for alive, got, cut, total in drawn:
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            # below e^-30 the score is log p - kappa to the last bit
            inc = np.where(np.isinf(kappa), 0.0, np.where(total - kappa < -30, total - kappa, np.log(-np.expm1(-np.exp(np.minimum(total - kappa, 50.0))))))
        out.append((alive, got, cut, total, inc))
    return out


def encode(docs: DataFrame, samples: int = SAMPLES, ids: bool = True, path: str | None = None, scale: float = SCALE, id_col: str = "doc_id", text_col: str = "text", group_chars: int = GROUP_CHARS, max_edges: int = MAX_EDGES, near_nats: float = NEAR_NATS) -> DataFrame:
    """``doc_id, n_tokens, digest, round_trip, samples`` and, with ids, ``ids``: a row for each row of docs.

    samples is an array of ``n_tokens, digest, log_p, log_inclusion`` (and ``ids``) in order of the draw; a
    text with fewer segmentations has fewer, and then each inclusion score is 0 (certain). Null and empty
    texts have no ids, round_trip true and no samples. The best ids and all samples are decoded; round_trip is
    false where one gives another text: texts that hold the space mark itself. Rows with equal ids draw alike, so
    repeated rows give equal rows; null ids share a seed. Words may have any number of pieces. Columns besides
    the id and the text are not read; an empty table gives none.

    ``group_chars``, the characters worked on together, and ``max_edges``, the edges of the lattices that a worker
    keeps, set its memory (some 0.5 GB by default) against time; results do not depend on them.

    Choices in words beyond the first ``near_nats`` of entropy become branches only if the text's branches so far
    leave them a chance over e^-25 to matter; with ``math.inf`` every choice of every word does.
    """
    path = path or model_path()
    if samples and samples >= 4096:
        raise ValueError("too many samples")
    one = "struct<n_tokens:long,digest:long,log_p:double,log_inclusion:double" + (",ids:array<int>>" if ids else ">")
    schema = "doc_id long, n_tokens long, digest long, round_trip boolean" + (", ids array<int>" if ids else "") + f", samples array<{one}>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = model(path, scale)

        def group(doc_ids, texts):
            key = np.array([d if d is not None else -(1 << 62) for d in doc_ids], np.int64).view(np.uint64)
            (flat, cut, same), drawn = encode_group(m, texts, mix64(key + np.uint64(0x2545F4914F6CDD1D)), samples, near_nats, max_edges)
            lists = lambda x, b: pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(x, pa.int32()))
            n = len(texts)
            fields = {"n_tokens": [], "digest": [], "log_p": [], "log_inclusion": []}
            owner, parts = [], []
            for alive, got, at, total, inc in drawn:
                a = np.flatnonzero(alive)
                owner.append(a)
                fields["n_tokens"].append(np.diff(at)[a])
                fields["digest"].append(digest(got, at)[a])
                fields["log_p"].append(total[a])
                fields["log_inclusion"].append(inc[a])
                parts.append((got, at, a))
            owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            order = np.argsort(owner, kind="stable")
            cols = [pa.array((np.concatenate(v) if v else np.zeros(0))[order], pa.int64() if k in ("n_tokens", "digest") else pa.float64()) for k, v in fields.items()]
            names = list(fields)
            if ids:
                each = [got[at[i] : at[i + 1]] for got, at, a in parts for i in a]
                each = [each[i] for i in order]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]) if each else np.zeros(1)
                cols.append(lists(np.concatenate(each) if each else np.zeros(0, np.int64), ends.astype(np.int64)))
                names.append("ids")
            struct = pa.StructArray.from_arrays(cols, names=names)
            drawn_at = np.searchsorted(owner[order], np.arange(n + 1))
            out = [pa.array(doc_ids, pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(digest(flat, cut), pa.int64()), pa.array(same, pa.bool_())]
            if ids:
                out.append(lists(flat, cut))
            out.append(pa.ListArray.from_arrays(pa.array(drawn_at, pa.int32()), struct))
            return pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "digest", "round_trip", *(["ids"] if ids else []), "samples"])

        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            held, size = [], 0
            for i in range(len(doc_ids)):
                t = texts[i].as_py() or ""
                if held and size + len(t) > group_chars:
                    yield group(doc_ids[i - len(held) : i], held)
                    held, size = [], 0
                held.append(t)
                size += len(t)
            if held:
                yield group(doc_ids[len(doc_ids) - len(held) :], held)
            give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids, a row for each row. Null ids give null; an id outside the vocabulary raises an error."""
    path = path or model_path()

    def run(batches):
        import pyarrow as pa

        sp = model(path, SCALE).sp
        for b in batches:
            texts = [None if x is None else sp.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op10(spark, sf_dir):
    return encode(dealt(table(spark, sf_dir, "documents")))


QUERIES = {"op10_sentencepiece": op10}
SQL: dict[str, str] = {}
