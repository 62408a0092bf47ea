"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text is written as SentencePiece does (a mark before it and for each space); its lattice has an
edge for every piece of the vocabulary, and the UTF-8 bytes of a character that is no piece.
Pieces never reach from a word over the mark of the next one, nor over a line end, so the lattice
of a text is a chain of lattices of units; equal units share one, built once for a Python worker.

A segmentation's probability is proportional to the product of its pieces' weights,
(rank + 10) ** -ALPHA, normalised exactly by a backward pass over each unit.

Perturbed A-star search: a queue holds subtrees of segmentations by their perturbed score, the
maximum of Gumbel variables in them.  The best one is followed to its end, where the maximum stays
on the sampled edge while every edge not taken becomes a subtree with a truncated Gumbel score.
The first k ends are a sample without replacement.  The score of the next best subtree is the
threshold: log_inclusion is the log probability of exceeding it.  An edge so far down that no
64-bit uniform number could bring it into the queue's first k is not looked at.

Random numbers are hashes of the seed, the row key, the sample and the place, so results do not
depend on partitions or retries.

Defined results: a null or empty text has one segmentation, the empty one; a text with fewer than
k segmentations gives all of them (its last log_inclusion values are 0); rows with equal doc_id
and text get equal samples; a mark in the text decodes as a space; null ids use key 0; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm import common

SAMPLES = 2
ALPHA = 1.0
SEED = 20240101
MARK = "▁"
#: Units whose lattices a Python worker keeps.
UNITS_KEPT = 200_000
#: Text bytes handled at a time by a Python worker.
PORTION = 2_000_000
#: -log of the smallest exponential variable that draws can give.
_REACH = 37.5
_FIRST_LOOK = 96
#: Log-probabilities are multiples of one over this, so their sums are exact in any order.
_GRID = 2.0**24
_LEAST = -127.0
_SLOTS = 19
_P = np.uint64(0x9E3779B97F4A7C15)
_C = [np.uint64(x) for x in (0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7)]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def units_of(text: str) -> list[str]:
    """Pieces of a text between which no vocabulary piece reaches."""
    if not text:
        return []
    spaced = MARK + text.replace(MARK, " ").replace(" ", " " + MARK)
    units = spaced.replace("\n", " \n ").split(" ")
    if "" in units:
        units = [u for u in units if u]
    if MARK in units:  # a run of marks belongs to the word after it
        joined, run = [], ""
        for unit in units:
            if unit == MARK:
                run += unit
            elif run and unit[0] == MARK:
                joined.append(run + unit)
                run = ""
            else:
                joined += [run] if run else []
                joined.append(unit)
                run = ""
        units = [*joined, run] if run else joined
    return units


def _ranges(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each stretch, one after the other."""
    return np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit keys."""
    return ((common.mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattices:
    """Vocabulary and the lattices of all units met, as flat arrays of nodes and edges."""

    def __init__(self, model: str, alpha: float) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.processor.get_piece_size()
        self.byte_ids = np.array([self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        pieces = {}
        self.decoded: list[bytes] = []
        for i in range(size):
            piece = self.processor.id_to_piece(i)
            special = self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i)
            if not special:
                pieces[piece] = i
            self.decoded.append(b"" if special else piece.replace(MARK, " ").encode())
        for b, i in enumerate(self.byte_ids):
            self.decoded[i] = bytes([b])
        self.spelled = pa.array(self.decoded, pa.binary())
        ordinary = min(pieces.values(), default=0)
        self.log_weight = -alpha * np.log(np.arange(size) - ordinary + 10.0, where=np.arange(size) >= ordinary, out=np.zeros(size))
        self.byte_weight = -alpha * (np.log(size) + 2.0)
        prefixes: dict[int, int] = {}
        self.longest = max(map(len, pieces), default=1)
        mask = (1 << 64) - 1
        for piece, i in pieces.items():
            h = 0
            for j, ch in enumerate(piece, 1):
                h = (h * int(_P) + ord(ch) + 1) & mask
                if j == len(piece):
                    prefixes[h] = i
                else:
                    prefixes.setdefault(h, -1)
        self.prefix = np.array(sorted(prefixes), np.uint64)
        self.prefix_id = np.array([prefixes[int(h)] for h in self.prefix], np.int32)
        self.slot = np.full(1 << _SLOTS, -1, np.int32)  # one prefix of those that fall there
        with np.errstate(over="ignore"):
            falls = (self.prefix * _P) >> np.uint64(64 - _SLOTS)
        self.slot[falls] = np.arange(len(self.prefix))
        self.crowded = np.bincount(falls, minlength=1 << _SLOTS) > 1
        self.reset()

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are beginnings of pieces, and the ids of those that are pieces (else -1)."""
        falls = (h * _P) >> np.uint64(64 - _SLOTS)
        place = self.slot[falls]
        known = (place >= 0) & (self.prefix[place] == h)
        again = np.flatnonzero(~known & self.crowded[falls])
        if len(again):
            place[again] = np.minimum(np.searchsorted(self.prefix, h[again]), len(self.prefix) - 1)
            known[again] = self.prefix[place[again]] == h[again]
        return known, np.where(known, self.prefix_id[place], -1)

    def reset(self) -> None:
        self.types: dict[str, int] = {}
        self.uses = np.zeros(0, np.int32)  # of each type: how many portions of text held it
        self.first = np.zeros(0, np.int64)  # of each type: its first node
        self.offset = np.zeros(1, np.int64)  # of each node: its first edge
        self.start = np.zeros(0, np.int32)  # of each edge: the node it leaves
        self.end = np.zeros(0, np.int32)  # and the node it leads to
        self.out = np.zeros(0, np.int32)  # piece id, or minus the code point written as bytes
        self.log_p = np.zeros(0, np.int32)  # on the grid
        self.upto = np.zeros(0, np.float32)  # cumulative probability among the edges of a node

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(characters, piece ids or minus code points, scores) of the edges of each length."""
        found = []
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(1, self.longest + 1):
            fits = left[at] >= n
            at, h = at[fits], h[fits]
            h = h * _P + codes[at + n - 1] + np.uint64(1)
            known, ids = self.look_up(h)
            whole = ids >= 0
            starts, outs, scores = at[whole], ids[whole], self.log_weight[ids[whole]]
            if n == 1:
                alone = at[~whole]
                code = codes[alone].astype(np.int64)
                width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                starts = np.concatenate([starts, alone])
                outs = np.concatenate([outs, np.where(width == 1, self.byte_ids[np.minimum(code, 255)], -code)])
                scores = np.concatenate([scores, width * self.byte_weight])
            found.append((starts, outs, scores))
            at, h = at[known], h[known]
            if not len(at):
                break
        return found

    def add(self, units: list[str]) -> None:
        """Build the lattices of new units, all at once; a node's longest pieces come first."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(units)), sizes)
        left = np.cumsum(sizes)[owner] - np.arange(len(codes))
        found = self._edges(codes, left)
        degree = np.zeros(len(codes) + len(units), np.int64)  # a unit has one node more than characters
        for starts, _, _ in found:
            degree[starts + owner[starts]] += 1
        offset = np.cumsum(degree)
        slot, total = offset - degree, int(degree.sum())
        node, end, out, score = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total)
        for n in range(len(found), 0, -1):
            starts, outs, scores = found[n - 1]
            own = starts + owner[starts]
            at = slot[own]
            slot[own] += 1
            node[at], end[at], out[at], score[at] = own, own + n, outs, scores
        distance = left[node - np.repeat(np.arange(len(units)), np.add.reduceat(degree, np.cumsum(sizes + 1) - sizes - 1))]
        order = np.argsort(distance.astype(np.uint16) if len(distance) and distance.max() < 1 << 16 else distance, kind="stable")
        cuts = np.searchsorted(distance[order], np.arange(1, left.max() + 2))
        beta = np.zeros(len(degree))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # from the ends of the units back
            some = order[a:b]
            value, own = score[some] + beta[end[some]], node[some]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            top = np.maximum.reduceat(value, heads)
            spread = np.diff(np.r_[heads, len(some)])
            beta[own[heads]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, spread)), heads))
        log_p = np.maximum(score + beta[end] - beta[node], _LEAST)
        share = np.cumsum(np.rint(np.exp(log_p) * 2.0**30).astype(np.int64))
        upto = (share - np.repeat(np.concatenate([[0], share])[offset - degree], degree)) * 2.0**-30
        upto[(offset - 1)[degree > 0]] = 2.0  # the last edge takes what rounding leaves
        nodes, edges = len(self.offset) - 1, len(self.end)
        self.types.update(zip(units, range(len(self.types), len(self.types) + len(units)), strict=True))
        for name, new in (
            ("uses", np.zeros(len(units))),
            ("first", nodes + np.cumsum(sizes + 1) - sizes - 1),
            ("offset", edges + offset),
            ("start", nodes + node),
            ("end", nodes + end),
            ("out", out),
            ("log_p", np.rint(log_p * _GRID)),
            ("upto", upto),
        ):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, new.astype(old.dtype)]))

    def keep(self, units: list[str]) -> None:
        """Forget all types but these."""
        old = np.fromiter(map(self.types.__getitem__, units), np.int64, len(units))
        counts = np.diff(np.r_[self.first, len(self.offset) - 1])[old]
        nodes = _ranges(self.first[old], counts)
        degree = self.offset[nodes + 1] - self.offset[nodes]
        edges = _ranges(self.offset[nodes], degree)
        moved = np.repeat(np.arange(len(nodes)) - nodes, degree).astype(np.int32)
        self.types = dict(zip(units, range(len(units)), strict=True))
        self.uses, self.first = self.uses[old], np.cumsum(counts) - counts
        self.offset = np.concatenate([[0], np.cumsum(degree)])
        self.start, self.end = self.start[edges] + moved, self.end[edges] + moved
        self.out, self.log_p, self.upto = self.out[edges], self.log_p[edges], self.upto[edges]

    def _numbers(self, units: list[str]) -> np.ndarray:
        """Types of distinct units; when too many are kept, those that one portion held only go."""
        fresh = [u for u in units if u not in self.types]
        if len(self.types) + len(fresh) > UNITS_KEPT and self.types:
            here = set(units)
            often = [u for u, i in self.types.items() if self.uses[i] > 1]
            self.keep(often if len(often) <= UNITS_KEPT // 2 else [u for u in often if u in here])
            fresh = [u for u in units if u not in self.types]
        for i in range(0, len(fresh), 50_000):
            self.add(fresh[i : i + 50_000])
        found = np.fromiter(map(self.types.__getitem__, units), np.int64, len(units))
        self.uses[found] += 1
        return found

    def types_of(self, texts: list[str]) -> list[np.ndarray]:
        """Types of the units of each text, as ``units_of`` cuts them.

        Arrow cuts all texts but those with a mark of its own, which belongs to the word after it.
        """
        spaced = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.string()), MARK, " "), " ", f" {MARK}")
        spaced = pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise(MARK, spaced, ""))
        split = pc.split_pattern(pc.replace_substring(spaced, "\n", " \n "), " ")
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        coded = split.flatten().dictionary_encode()
        which, units = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        place = {u: i for i, u in enumerate(units)}
        apart = np.unique(owner[which == place[MARK]]) if MARK in place else owner[:0]
        own = {int(i): units_of(texts[i]) for i in apart}
        filled = ~np.isin(owner, apart)
        if "" in place:
            filled &= which != place[""]
        which, owner = which[filled], owner[filled]
        used = np.zeros(len(units), bool)
        used[which] = True
        names = [u for u, here in zip(units, used.tolist(), strict=True) if here]
        names += list(dict.fromkeys(u for cut in own.values() for u in cut if not (u in place and used[place[u]])))
        types = self._numbers(names)
        number = np.zeros(len(units), np.int64)
        number[used] = types[: used.sum()]
        found = np.split(number[which], np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
        for i, cut in own.items():
            found[i] = np.fromiter(map(self.types.__getitem__, cut), np.int64, len(cut))
        return found

    def straight(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample from each node to the end of its unit: edges one unit after the other, and how many."""
        at = np.flatnonzero(self.offset[node + 1] > self.offset[node])
        node = node.copy()
        who, which, step = [], [], 0
        count = np.zeros(len(node), np.int64)
        while len(at):
            here = node[at]
            u = uniform(key[at] + np.uint64(step) * _C[2])
            edge = self.offset[here]
            behind = np.flatnonzero(u > self.upto[edge])
            while len(behind):
                edge[behind] += 1
                behind = behind[u[behind] > self.upto[edge[behind]]]
            who.append(at)
            which.append(edge)
            count[at] += 1
            node[at] = there = self.end[edge]
            at = at[self.offset[there + 1] > self.offset[there]]
            step += 1
        begin = np.cumsum(count) - count
        path = np.zeros(count.sum(), np.int64)
        for step, (units, edges) in enumerate(zip(who, which, strict=True)):
            path[begin[units] + step] = edges
        return path, count

    def ids_of(self, paths: list[np.ndarray]) -> pa.ListArray:
        """Piece ids along each path of edges; a character that is no piece has one for each byte."""
        flat = np.concatenate([np.zeros(0, np.int64), *paths])
        out, sizes = self.out[flat], np.ones(len(flat), np.int64)
        bare = np.flatnonzero(out < 0)
        if len(bare):
            written = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (-out[bare]).tolist()]
            sizes[bare] = list(map(len, written))
            out = np.repeat(out, sizes)
            out[out < 0] = np.concatenate(written)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, paths)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out.astype(np.int32)))

    def spell(self, ids: pa.ListArray) -> pa.Array:
        """UTF-8 text of each list of piece ids, a space before it for the mark at the beginning."""
        bounds = ids.offsets.to_numpy()
        pieces = self.spelled.take(ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds - bounds[0]), pieces), b"")


class _Path:
    """A sample: its edges, and for the part after the branch how many edges each unit has."""

    __slots__ = ("edges", "begin", "parent", "first", "ends", "score", "log_prob")

    def __init__(self, edges: np.ndarray, begin: int, parent: _Path | None, first: int, ends: np.ndarray, score: float) -> None:
        self.edges, self.begin, self.parent, self.first, self.ends, self.score = edges, begin, parent, first, ends, score
        self.log_prob = 0.0

    def unit(self, position: int) -> int:
        if position >= self.begin:
            return self.first + int(np.searchsorted(self.ends, position - self.begin, side="right"))
        return self.first if position == self.begin - 1 else self.parent.unit(position)


class _Text:
    """The search over one text: its samples and the queue of subtrees (score, sample, position, edge)."""

    __slots__ = ("types", "seed", "paths", "queue", "threshold")

    def __init__(self, types: np.ndarray, seed: np.uint64) -> None:
        self.types, self.seed = types, seed
        self.paths: list[_Path] = []
        self.queue: list[tuple] = []
        self.threshold = -np.inf


def _siblings(lattices: Lattices, texts: list[_Text], turn: int, want: int) -> None:
    """Put the subtrees beside the newest path of each text, after its branch, into its queue.

    All texts are looked at together, a stretch of positions at a time; ``want`` subtrees are kept.
    """
    sizes = np.fromiter((len(t.paths[-1].edges) for t in texts), np.int64, len(texts))
    flat = np.concatenate([np.zeros(0, np.int64), *(t.paths[-1].edges for t in texts)])
    total = np.concatenate([[0], np.cumsum(lattices.log_p[flat], dtype=np.int64)]) / _GRID
    base = np.cumsum(sizes) - sizes
    for text, lo, n in zip(texts, base.tolist(), sizes.tolist(), strict=True):
        text.paths[-1].log_prob = float(total[lo + n] - total[lo])
    seeds = np.array([t.seed for t in texts], np.uint64)
    scores = np.array([t.paths[-1].score for t in texts])
    begin = np.array([t.paths[-1].begin for t in texts], np.int64)
    worst = np.array([t.queue[want - 1][0] if len(t.queue) >= want else -np.inf for t in texts])
    look = _FIRST_LOOK
    at = np.flatnonzero(begin < sizes)
    while len(at):
        at = at[total[base[at] + begin[at]] - total[base[at]] + _REACH >= worst[at]]
        length = np.minimum(sizes[at] - begin[at], look)
        which = np.repeat(at, length)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + begin[which]
        taken = flat[base[which] + place]
        node = lattices.start[taken]
        lo = lattices.offset[node]
        degree = lattices.offset[node + 1] - lo
        many = degree > 1
        which, place, taken, lo, degree = which[many], place[many], taken[many], lo[many], degree[many]
        row = np.repeat(np.arange(len(which)), degree)
        rank = np.arange(len(row)) - (np.cumsum(degree) - degree)[row]
        edge = lo[row] + rank
        other = edge != taken[row]
        row, rank, edge = row[other], rank[other], edge[other]
        who, where = which[row], place[row]
        phi = total[base[who] + where] - total[base[who]] + lattices.log_p[edge] / _GRID
        near = phi + _REACH >= worst[who]
        rank, edge, who, where, phi = rank[near], edge[near], who[near], where[near], phi[near]
        key = seeds[who] + np.uint64(turn + 1) * _C[0] + where.astype(np.uint64) * _C[1] + rank.astype(np.uint64) * _P + np.uint64(7)
        perturbed = phi - np.log(np.exp(np.minimum(phi - scores[who], 700.0)) - np.log(uniform(key)))
        order = np.lexsort((-perturbed, who))
        heads = np.flatnonzero(np.r_[True, who[order][1:] != who[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        spread = np.diff(np.r_[heads, len(order)])
        order = order[np.arange(len(order)) - np.repeat(heads, spread) < want]
        changed = set()
        for i, score, position, e in zip(who[order].tolist(), perturbed[order].tolist(), where[order].tolist(), edge[order].tolist(), strict=True):
            texts[i].queue.append((score, turn, position, e))
            changed.add(i)
        for i in changed:
            queue = texts[i].queue
            queue.sort(key=lambda q: (-q[0], q[1], q[2], q[3]))
            del queue[want:]
            worst[i] = queue[want - 1][0] if len(queue) >= want else -np.inf
        begin[at] += length
        at = at[begin[at] < sizes[at]]
        look *= 4


def sample(lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> list[_Text]:
    """Top-k segmentations of each text; all texts advance together from sample to sample."""
    found = [_Text(types, seed) for types, seed in zip(lattices.types_of(texts), seeds, strict=True)]
    top = -np.log(-np.log(uniform(seeds + np.uint64(1))))
    live: list[tuple] = [(text, score, None) for text, score in zip(found, top.tolist(), strict=True)]
    for turn in range(k):
        starts, firsts, sizes = [], [], []
        for text, _, branch in live:
            if branch is None:
                firsts.append(0)
                starts.append(lattices.first[text.types])
            else:
                _, parent, position, edge = branch
                firsts.append(text.paths[parent].unit(position))
                starts += [lattices.end[edge : edge + 1], lattices.first[text.types[firsts[-1] + 1 :]]]
            sizes.append(len(text.types) - firsts[-1])
        size = np.array(sizes, np.int64)
        which = np.repeat(np.arange(len(live)), size)
        unit = np.arange(size.sum()) - (np.cumsum(size) - size)[which] + np.array(firsts, np.int64)[which]
        own_seeds = np.array([text.seed for text, _, _ in live], np.uint64)
        keys = own_seeds[which] + np.uint64(turn + 1) * _C[0] + unit.astype(np.uint64) * _C[1]
        edges, count = lattices.straight(np.concatenate([np.zeros(0, np.int64), *starts]), keys)
        unit_ends, edge_ends = np.cumsum([0, *sizes]), np.concatenate([[0], np.cumsum(count)])
        for i, (text, score, branch) in enumerate(live):
            a, b = unit_ends[i], unit_ends[i + 1]
            own = edges[edge_ends[a] : edge_ends[b]]
            ends = edge_ends[a + 1 : b + 1] - edge_ends[a]
            if branch is None:
                text.paths.append(_Path(own, 0, None, 0, ends, score))
            else:
                _, parent, position, edge = branch
                before = text.paths[parent]
                whole = np.concatenate([before.edges[:position], [edge], own])
                text.paths.append(_Path(whole, position + 1, before, firsts[i], ends, score))
        _siblings(lattices, [text for text, _, _ in live], turn, k - turn)
        if turn + 1 < k:
            live = [(text, text.queue[0][0], text.queue.pop(0)) for text, _, _ in live if text.queue]
    for text in found:
        text.threshold = text.queue[0][0] if text.queue else -np.inf
    return found


def log_inclusion(log_prob: float, threshold: float) -> float:
    """log(1 - exp(-exp(log_prob - threshold))), the chance to exceed the threshold."""
    x = log_prob - threshold
    if x > 3.7:
        return 0.0 if x > 50 else float(np.log1p(-np.exp(-np.exp(x))))
    return float(x if x < -35 else np.log(-np.expm1(-np.exp(x))))


def _seeds(ids: list, seed: int) -> np.ndarray:
    keys = np.array([0 if i is None else int(i) for i in ids], np.int64).astype(np.uint64)
    return common.mix(common.mix(keys + np.uint64(seed)) + _P)


def _portions(sizes: list[int]) -> Iterator[slice]:
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > PORTION:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def lattices_for(model: str, alpha: float) -> Lattices:
    return common.tenant(f"lattices {model} {alpha}", lambda: Lattices(model, alpha))


def _rows(lattices: Lattices, keys: list, texts: list[str], k: int, seed: int) -> dict:
    """Columns of the samples of some texts."""
    found = sample(lattices, texts, _seeds(keys, seed), k)
    paths = [path for search in found for path in search.paths]
    spread = [len(search.paths) for search in found]
    ids = lattices.ids_of([path.edges for path in paths])
    ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
    expected = [f" {t.replace(MARK, ' ')}".encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    again = pa.array([e for e, n in zip(expected, spread, strict=True) for _ in range(n)], pa.binary())
    return {
        "doc_id": pa.array([key for key, n in zip(keys, spread, strict=True) for _ in range(n)], pa.int64()),
        "sample": pa.array([i for n in spread for i in range(n)], pa.int32()),
        "ids": ids,
        "n_pieces": pa.array(np.diff(ends).astype(np.int64)),
        "ids_crc32": pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
        "log_prob": pa.array([path.log_prob for path in paths], pa.float64()),
        "perturbed": pa.array([path.score for path in paths], pa.float64()),
        "log_inclusion": pa.array([log_inclusion(path.log_prob, search.threshold) for search in found for path in search.paths], pa.float64()),
        "round_trip": pc.equal(lattices.spell(ids), again),
    }


def encode(docs: DataFrame, k: int = SAMPLES, *, model: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """k rows for each document: sampled ids, their scores, and whether they decode to the text.

    Columns: doc_id, sample, ids, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), log_prob, perturbed, log_inclusion, round_trip.
    """
    common.ship(docs.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_for(model, alpha)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for part in _portions([len(t) for t in texts]):
                with np.errstate(over="ignore"):
                    rows = _rows(lattices, keys[part], texts[part], k, seed)
                yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))

    schema = "doc_id long, sample int, ids array<int>, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` (doc_id, sample, ids) with the text that the ids spell; null ids spell null."""
    common.ship(rows.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_for(model, ALPHA)
        for batch in batches:
            given = batch.column("ids")
            whole = lattices.spell(pc.if_else(pc.is_valid(given), given, pa.scalar([], given.type))).to_pylist()
            texts = [t.removeprefix(b" ").decode("utf-8", "replace") if ok else None for t, ok in zip(whole, given.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())], ["doc_id", "sample", "text"])

    plain = rows.select(F.col("doc_id").cast("long"), F.col("sample").cast("int"), F.col("ids").cast("array<int>"))
    return plain.mapInArrow(run, "doc_id long, sample int, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
