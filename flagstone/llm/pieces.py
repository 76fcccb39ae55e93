"""SentencePiece segmentations sampled without replacement, and their decoding.

A text is a row of words, each a run of marks for blanks and the characters up to the next blank; pieces
may hold several marks or one before characters, but none has a character before a mark, so no piece
crosses from a word to the next and a text's lattice is its words' lattices in a row. A piece of
merge rank r weighs 1 / (r + ``FLATTEN``); characters without a piece of their own fall back to their
bytes. A segmentation's probability is the product of its pieces' weights over the lattice's total.

Gumbel top-k: every segmentation's log probability gets Gumbel noise, and the k largest are a sample of k
without replacement. They are found without listing: a set of segmentations (all that share a prefix and
leave it by an edge not yet taken) has a perturbed maximum, drawn top-down as a Gumbel truncated at the
maximum of the set it was cut from. The search opens the set of largest maximum, draws the path on which
it is reached and puts the sets that branch off it back. The k+1-st maximum gives each sample its chance of
being included. Far branches of a long path (beyond ``OPEN`` edges) are one set until one is asked for.

Noise comes from a hash of seed, row key and place, so a row gives the same samples in any task.
Defined cases. A null or empty text has one empty segmentation. Texts with fewer than k segmentations
give all they have. Rows of one key get the same noise. The mark itself decodes to a blank, as in the
library. An empty table gives no rows. Other columns are not read by ``sample_pieces``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import ragged_starts
from flagstone.llm.hashing import mix
from flagstone.llm.words import Growing, WordTable, chunks, gather_runs

MARK = "▁"
FLATTEN = 10.0
OPEN = 40
WORDS_AT_ONCE, BYTES_AT_ONCE, TEXT_AT_ONCE = 5_000, 50_000, 500_000
#: Edges a worker keeps between runs of text, of 13 bytes each; a mark in a long run of them has up to sixteen.
EDGES = 6_000_000
_SAMPLE, _WORD, _PIECE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def _times(n: int, step: np.uint64) -> np.uint64:
    return np.uint64(n * int(step) & 0xFFFFFFFFFFFFFFFF)


def unit(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashed keys."""
    return ((mix(keys) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def truncated_gumbel(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel noise at a location, given that it does not exceed ``most``; sets of no mass get none."""
    some = location > -np.inf
    at = np.where(some, location, 0.0)
    return np.where(some, at - np.log(np.exp(at - most) - np.log(u)), -np.inf)


class Vocabulary:
    """The pieces as a trie in arrays, their log weights and their bytes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_at = np.zeros(256, np.int32)
        texts, weights, trie, found = [], np.zeros(size), {}, {}
        fresh = 1
        self.chars: dict[str, int] = {}
        for i in range(size):
            piece, score = model.id_to_piece(i), model.get_score(i)
            weights[i] = -np.log(FLATTEN - min(score, 0.0))
            if model.is_byte(i):
                self.bytes_at[int(piece[1:-1], 16)] = i
                texts.append(bytes([int(piece[1:-1], 16)]))
                weights[i] = -np.log(FLATTEN + size)
                continue
            plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            texts.append(piece.replace(MARK, " ").encode() if plain else b"")
            if plain:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {i} crosses from a word to the next")
                node = 0
                for c in piece:
                    key = (node, self.chars.setdefault(c, len(self.chars)))
                    if key not in trie:
                        trie[key], fresh = fresh, fresh + 1
                    node = trie[key]
                found[node] = i
        self.weights, self.n_chars = weights, len(self.chars) + 1
        keys = np.array([n * self.n_chars + c for n, c in trie], np.int64)
        order = np.argsort(keys)
        keys, children = keys[order], np.array([*trie.values()], np.int64)[order]
        self.roots = np.full(self.n_chars + 1, -1, np.int64)  # the last is for characters the vocabulary lacks
        first = keys < self.n_chars
        self.roots[keys[first]] = children[first]
        self.inner = np.zeros(fresh, bool)
        self.inner[keys // self.n_chars] = True
        self._spread(keys, children)
        self.piece_at = np.full(fresh, -1, np.int64)
        self.piece_at[[*found]] = [*found.values()]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts, self.data = ragged_starts(self.lengths)[:-1], np.frombuffer(b"".join(texts), np.uint8)
        self.code = np.full(0x110000, -1, np.int32)
        for c, i in self.chars.items():
            self.code[ord(c)] = i

    def _spread(self, keys: np.ndarray, children: np.ndarray) -> None:
        """Lay the trie's edges out by a hash, each in the next free place; -1 stands in empty ones."""
        bits = max(len(keys), 1).bit_length() + 1
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.children = np.full(1 << bits, -1), np.full(1 << bits, -1)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            laid = self.keys[at] == keys
            self.children[at[laid]] = children[laid]
            keys, children, at = keys[~laid], children[~laid], (at[~laid] + 1) & self.last

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _WORD >> self.shift).astype(np.int64)

    def child(self, keys: np.ndarray) -> np.ndarray:
        """The node that each edge of the trie leads to, -1 where there is none."""
        at = self._place(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.children[at], -1)
        on = np.flatnonzero((met != keys) & (met >= 0))
        while len(on):
            at[on] = (at[on] + 1) & self.last
            met, own = self.keys[at[on]], keys[on]
            out[on] = np.where(met == own, self.children[at[on]], -1)
            on = on[(met != own) & (met >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids, the first blank being the one that every text is given."""
        return gather_runs(self.data, self.starts[ids], self.lengths[ids]).tobytes()


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_of_text(text: bytes) -> list[bytes]:
    """The words of a text, each without its first blank; a mark in the text is a blank."""
    text = b" " + text.replace(MARK.encode(), b" ")
    return re.findall(rb" ( *[^ ]*)", text) if b"  " in text else text[1:].split(b" ")


class Lattices(WordTable):
    """The lattice of each word: nodes between characters, edges for pieces, likeliest first at each node."""

    def __init__(self, path: str, limit: int = 150_000) -> None:
        super().__init__(limit)
        self.vocabulary = vocabulary(path)
        self.reset()

    def reset(self) -> None:
        self.base, self.last = Growing(np.int64, self.limit), Growing(np.int64, self.limit)
        self.first, self.degree = Growing(np.int32, EDGES), Growing(np.uint8, EDGES)
        self.length, self.piece, self.logp, self.upto = (Growing(t, EDGES) for t in (np.uint8, np.int32, np.float32, np.float32))
        self.met = Growing(np.uint16, self.limit)

    def index(self, words: list[bytes]) -> np.ndarray:
        if self.length.size > EDGES:
            self.forget()
        slots = super().index(words)
        self.met.extend(np.zeros(self.base.size - self.met.size, np.uint16))
        again = np.zeros(self.base.size, bool)
        again[slots] = True
        met = self.met.data[: self.met.size]
        met += again & (met < 0xFFFF)
        return slots

    def forget(self) -> None:
        """Keep the words met in most runs of text, half as many and with half as many edges as may be kept, and halve their counts."""
        met = self.met.data[: self.met.size]
        ranked = np.argsort(-met.astype(np.int32), kind="stable")[: self.limit // 2]
        ranked = ranked[met[ranked] > 1]
        begin, end = self.first.data[self.base.data[ranked]], self.first.data[self.last.data[ranked]]
        stay = np.sort(ranked[np.cumsum(end.astype(np.int64) - begin) <= EDGES // 2])
        words = list(self.slot)
        self.slot = {words[i]: j for j, i in enumerate(stay.tolist())}
        base, nodes = self.base.data[stay], self.last.data[stay] - self.base.data[stay] + 1
        begin = self.first.data[base].astype(np.int64)
        spans = self.first.data[self.last.data[stay]] - begin
        counts = met[stay] // 2
        for store in (self.length, self.piece, self.logp, self.upto):
            store.keep(begin, spans)
        for store in (self.first, self.degree):
            store.keep(base, nodes)
        self.first.data[: self.first.size] -= np.repeat((begin - ragged_starts(spans)[:-1]).astype(np.int32), nodes)
        at = ragged_starts(nodes)[:-1]
        for store, values in ((self.base, at), (self.last, at + nodes - 1), (self.met, counts)):
            store.size = 0
            store.extend(values)

    def add(self, words: list[bytes]) -> None:
        s, total = 0, 0
        for i, w in enumerate(words):
            if i > s and (i - s == WORDS_AT_ONCE or total + len(w) > BYTES_AT_ONCE):
                self._add(words[s:i])
                s, total = i, 0
            total += len(w)
        self._add(words[s:])

    def _add(self, words: list[bytes]) -> None:
        v = self.vocabulary
        texts = [MARK + w.decode("utf-8", "replace").replace(" ", MARK) for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = v.code[points]
        end = np.repeat(np.cumsum(sizes), sizes)
        at, node, depth = np.arange(len(points)), v.roots[codes], 1
        edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        degree = np.zeros(len(points), np.int64)
        while len(at):
            on = np.flatnonzero(node >= 0)
            at, node = at[on], node[on]
            pieces = v.piece_at[node]
            found = np.flatnonzero(pieces >= 0)
            own = at[found]
            edges.append((own, np.full(len(found), depth), pieces[found], degree[own]))
            degree[own] += 1  # a place has one piece of each length at most
            far = at + depth
            inside = np.flatnonzero((far < end[at]) & v.inner[node])
            at, node, code = at[inside], node[inside], codes[far[inside]]
            node = v.child(np.where(code >= 0, node * v.n_chars + code, -1))
            depth += 1
        single = np.zeros(len(points), bool)
        single[edges[0][0]] = True
        bare = np.flatnonzero(~single)
        edges.append((bare, np.ones(len(bare), np.int64), -1 - points[bare], degree[bare]))
        degree[bare] += 1
        start, length, piece, nth = (np.concatenate(x) for x in zip(*edges, strict=True))
        # node numbers: a word of n characters has n + 1, the last without edges
        nodes = len(points) + len(words)
        # edges by distance to the word's end and place, those of a place together: each has its row by counting
        left = end - np.arange(len(points))
        ranked = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 0x10000 else left, kind="stable")
        row = np.empty(len(points), np.int64)
        row[ranked] = ragged_starts(degree[ranked])[:-1]
        order = np.empty(len(start), np.int64)
        order[row[start] + nth] = np.arange(len(start))
        start, length, piece = start[order], length[order], piece[order]
        point, distance = points[start], left[start]
        node_of = start + np.repeat(np.arange(len(words)), sizes)[start]
        width = 1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)
        weight = np.where(piece >= 0, v.weights[np.maximum(piece, 0)], width * v.weights[v.bytes_at[0]])
        # from the words' ends backwards: nodes at the same distance at once, the edges of a node together
        beyond, onto = np.zeros(nodes), node_of + length
        runs = np.flatnonzero(np.diff(node_of, prepend=-1))
        spans, heads = np.diff(np.append(runs, len(node_of))), node_of[runs]
        cuts = np.append(np.flatnonzero(np.diff(distance[runs], prepend=-1)), len(runs))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = runs[x], runs[y] if y < len(runs) else len(node_of)
            value, own = weight[a:b] + beyond[onto[a:b]], runs[x:y] - a
            top = np.maximum.reduceat(value, own)
            beyond[heads[x:y]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, spans[x:y])), own))
        logp = weight + beyond[onto] - beyond[node_of]
        p = np.exp(logp)
        order = np.argsort(node_of - 0.5 * p)
        length, piece, logp, p, node_of = length[order], piece[order], logp[order], p[order], node_of[order]
        degree = np.bincount(node_of, minlength=nodes)
        first = ragged_starts(degree)[:-1]
        total = np.cumsum(p)
        upto = total - np.repeat(np.concatenate([[0], total])[first], degree)
        ends = (first + degree - 1)[degree > 0]
        upto[ends] = np.inf
        logp[ends[degree[degree > 0] == 1]] = 0.0
        base = self.first.size + ragged_starts(sizes + 1)[:-1]
        self.base.extend(base)
        self.last.extend(base + sizes)
        self.first.extend(first + self.length.size)
        self.degree.extend(degree)
        for store, values in ((self.length, length), (self.piece, piece), (self.logp, logp), (self.upto, upto)):
            store.extend(values)

    def draw(self, node: np.ndarray, last: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word a path from a node to its last: edges and their nodes, word after word, and counts per word."""
        node, counts, steps = node.copy(), np.zeros(len(node), np.int64), []
        on = np.flatnonzero(node != last)
        while len(on):
            u = unit(keys[on] + _times(len(steps), _PIECE))
            edge = self.first.data[node[on]].astype(np.int64)
            wait = np.flatnonzero(u > self.upto.data[edge])
            while len(wait):
                edge[wait] += 1
                wait = wait[u[wait] > self.upto.data[edge[wait]]]
            steps.append((on, edge, node[on]))
            counts[on] += 1
            node[on] += self.length.data[edge]
            on = on[node[on] != last[on]]
        starts = ragged_starts(counts)
        edges, nodes = np.empty(starts[-1], np.int64), np.empty(starts[-1], np.int64)
        for s, (on, edge, at) in enumerate(steps):
            edges[starts[on] + s], nodes[starts[on] + s] = edge, at
        return edges, nodes, counts


@functools.lru_cache(maxsize=1)
def lattices(path: str) -> Lattices:
    return Lattices(path)


class Paths:
    """One sample of each text: edges laid one after the other, with node and word, and running log probabilities."""

    def __init__(self, edges: np.ndarray, nodes: np.ndarray, words: np.ndarray, offsets: np.ndarray, table: Lattices) -> None:
        self.edges, self.nodes, self.words, self.offsets = edges, nodes, words, offsets
        self.logp = table.logp.data[edges].astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(self.logp)])
        self.before = total[:-1] - np.repeat(total[offsets[:-1]], np.diff(offsets)) if len(edges) else total[:0]
        self.whole = total[offsets[1:]] - total[offsets[:-1]]

    def branches(self, begin: np.ndarray, bound: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Perturbed maxima of the sets that leave each path at its edges from ``begin`` on; the last column is all from ``OPEN`` further on."""
        place = begin[:, None] + np.arange(OPEN)
        inside = place < np.diff(self.offsets)[:, None]
        flat = np.where(inside, self.offsets[:-1, None] + place, 0)
        location = np.full((len(begin), OPEN + 1), -np.inf)
        if len(self.edges):
            with np.errstate(divide="ignore"):
                location[:, :OPEN] = np.where(inside, self.before[flat] + np.log(-np.expm1(np.minimum(self.logp[flat], 0.0))), -np.inf)
                far = begin + OPEN
                more = far < np.diff(self.offsets)
                reach = self.before[np.where(more, self.offsets[:-1] + far, 0)]
                location[:, OPEN] = np.where(more, reach + np.log(-np.expm1(np.minimum(self.whole - reach, 0.0))), -np.inf)
        u = unit(keys[:, None] + np.arange(OPEN + 1, dtype=np.uint64) * _PIECE)
        return truncated_gumbel(location, bound[:, None], u)


class Search:
    """The sets still open, for each text of a run, and the samples taken so far."""

    def __init__(self, table: Lattices, texts: list[bytes | None], seeds: np.ndarray, k: int) -> None:
        self.table, self.seeds, self.k, n = table, seeds, k, len(texts)
        words, counts = [], np.zeros(n, np.int64)
        for i, text in enumerate(texts):
            own = words_of_text(text) if text else []
            counts[i] = len(own)
            words += own
        self.slots, self.offsets = table.index(words), ragged_starts(counts)
        self.text_of = np.repeat(np.arange(n), counts)
        self.place = np.arange(len(words)) - self.offsets[self.text_of]
        self.base, self.last = table.base.data[self.slots], table.last.data[self.slots]
        edges, nodes, steps = table.draw(self.base, self.last, self._keys(0))
        at = ragged_starts(steps)
        self.paths = [Paths(edges, nodes, np.repeat(np.arange(len(words)), steps), at[self.offsets], table)]
        self.values = [-np.log(-np.log(unit(mix(seeds ^ _WORD))))]
        self.begin = [np.zeros(n, np.int64)]
        self.open = np.full((n, k * (OPEN + 1)), -np.inf)
        self.open[:, : OPEN + 1] = self.paths[0].branches(self.begin[0], self.values[0], self._noise(0))
        self.taken: dict[tuple[int, int, int], list[int]] = {}
        self.extra: dict[int, list[tuple[float, int, int]]] = {}
        for s in range(1, k):
            self._next(s)

    def _keys(self, sample: int) -> np.ndarray:
        return mix(self.seeds + _times(sample + 1, _SAMPLE))[self.text_of] + self.place.astype(np.uint64) * _WORD

    def _noise(self, sample: int) -> np.ndarray:
        return mix((self.seeds ^ _PIECE) + _times(sample + 1, _SAMPLE))

    def _left(self, i: int, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The edges at a path's node not taken yet, and their probabilities."""
        path = self.paths[s]
        at = path.offsets[i] + t
        taken = self.taken.setdefault((i, s, t), [int(path.edges[at])])
        node = path.nodes[at]
        begin = int(self.table.first.data[node])
        edges = [e for e in range(begin, begin + int(self.table.degree.data[node])) if e not in taken]
        return np.array(edges), np.exp(self.table.logp.data[edges].astype(np.float64))

    def _open_far(self, i: int, s: int, value: float, u: np.ndarray) -> int:
        """Split the far branches of a path: the one that holds the maximum is returned, the others go on as sets of their own."""
        path, far = self.paths[s], self.begin[s][i] + OPEN
        a, b = path.offsets[i] + far, path.offsets[i + 1]
        with np.errstate(divide="ignore"):
            location = path.before[a:b] + np.log(-np.expm1(np.minimum(path.logp[a:b], 0.0)))
        mass = np.cumsum(np.exp(location - location.max()))
        won = int(np.searchsorted(mass, u[0] * mass[-1]))
        rest = truncated_gumbel(location, np.float64(value), unit(np.arange(len(location), dtype=np.uint64) * _PIECE + self.seeds[i]))
        rest[won] = -np.inf
        # no more than k sets can still be opened or be the threshold, so the largest k of these are enough
        top = np.argsort(-rest)[: self.k].tolist()
        self.extra.setdefault(i, []).extend((float(rest[j]), s, int(far + j)) for j in top if rest[j] > -np.inf)
        self.open[i, s * (OPEN + 1) + OPEN] = -np.inf
        return int(far + won)

    def _next(self, sample: int) -> None:
        """Open the best set of every text that has one, and draw the path on which its maximum is reached."""
        table, n = self.table, len(self.seeds)
        best = self.open.argmax(1)
        value = self.open[np.arange(n), best]
        noise = unit(self._noise(sample)[:, None] + np.arange(1, 4, dtype=np.uint64) * _WORD)
        start, heads = np.full(n, -1, np.int64), [np.empty(0, np.int64)] * n
        head_nodes, head_words, begin, first_node = heads.copy(), heads.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n):
            s, m = divmod(int(best[i]), OPEN + 1)
            own = self.extra.get(i)
            top = max(own) if own else None
            if top and top[0] > value[i]:
                own.remove(top)
                value[i], s, t = top
            elif value[i] == -np.inf:
                continue
            elif m == OPEN:
                t = self._open_far(i, s, value[i], noise[i])
            else:
                t = int(self.begin[s][i]) + m
                self.open[i, best[i]] = -np.inf
            edges, p = self._left(i, s, t)
            upto = np.cumsum(p)
            won = min(int(np.searchsorted(upto, noise[i, 1] * upto[-1])), len(edges) - 1)
            path = self.paths[s]
            a = path.offsets[i]
            self.taken[i, s, t].append(int(edges[won]))
            if len(edges) > 1:
                location = path.before[a + t] + np.log(max(upto[-1] - p[won], 1e-300))
                again = float(truncated_gumbel(np.float64(location), np.float64(value[i]), noise[i, 2]))
                self.extra.setdefault(i, []).append((again, s, t))
            start[i] = path.words[a + t]
            heads[i] = np.append(path.edges[a : a + t], edges[won])
            head_nodes[i] = path.nodes[a : a + t + 1]
            head_words[i] = path.words[a : a + t + 1]
            first_node[i] = path.nodes[a + t] + table.length.data[edges[won]]
            begin[i] = t + 1
        on = np.flatnonzero(start >= 0)
        counts = np.where(start >= 0, self.offsets[1:] - start, 0)
        words = gather_runs(np.arange(len(self.slots)), start[on], counts[on])
        node = self.base[words]
        node[ragged_starts(counts[on])[:-1]] = first_node[on]
        edges, nodes, steps = table.draw(node, self.last[words], self._keys(sample)[words])
        at = ragged_starts(steps)[np.concatenate([[0], np.cumsum(counts)])]
        of = np.repeat(words, steps)
        parts = [(heads[i], edges[at[i] : at[i + 1]], head_nodes[i], nodes[at[i] : at[i + 1]], head_words[i], of[at[i] : at[i + 1]]) for i in range(n)]
        join = lambda x, y: np.concatenate([z for part in parts for z in (part[x], part[y])]) if parts else np.empty(0, np.int64)
        sizes = np.array([len(p[0]) + len(p[1]) for p in parts], np.int64)
        path = Paths(join(0, 1), join(2, 3), join(4, 5), ragged_starts(sizes), table)
        self.paths.append(path)
        self.values.append(np.where(start >= 0, value, -np.inf))
        self.begin.append(begin)
        branches = path.branches(begin, value, self._noise(sample) ^ _SAMPLE)
        self.open[:, sample * (OPEN + 1) : (sample + 1) * (OPEN + 1)] = np.where((start >= 0)[:, None], branches, -np.inf)

    def threshold(self) -> np.ndarray:
        """The largest perturbed value not taken."""
        out = self.open.max(1) if self.open.shape[1] else np.full(len(self.seeds), -np.inf)
        for i, own in self.extra.items():
            if own:
                out[i] = max(out[i], max(own)[0])
        return out

    def pieces(self, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sample of every text, bytes spelt out, and where each text's start."""
        path, v = self.paths[sample], self.table.vocabulary
        ids, offsets = self.table.piece.data[path.edges], path.offsets
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, offsets
        spelt = {c: v.bytes_at[np.frombuffer(chr(-1 - c).encode("utf-8", "replace"), np.uint8)] for c in np.unique(ids[bare]).tolist()}
        widths = np.ones(len(ids), np.int64)
        widths[bare] = [len(spelt[c]) for c in ids[bare].tolist()]
        starts = ragged_starts(widths)
        out = np.repeat(ids, widths)
        for c, own in spelt.items():
            at = starts[bare[ids[bare] == c]]
            for j, b in enumerate(own):
                out[at + j] = b
        return out, starts[offsets]


def log_inclusion(log_prob: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(log_prob - threshold))), exact for small chances too."""
    x = np.where(threshold > -np.inf, log_prob - threshold, np.inf)
    chance = -np.expm1(-np.exp(np.minimum(x, 50.0)))
    return np.where(x < -30, x, np.log(np.maximum(chance, 1e-300)))


SCHEMA = "doc_id long, copy int, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, log_inclusion double, decoded boolean"


class Copies:
    """Numbers rows of one seed and text that follow each other, from batch to batch."""

    def __init__(self) -> None:
        self.last: tuple[int, bytes | None] | None = None
        self.count = 0

    def numbers(self, seeds: np.ndarray, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, (seed, text) in enumerate(zip(seeds.tolist(), texts, strict=True)):
            self.count = self.count + 1 if self.last is not None and self.last[0] == seed and self.last[1] == text else 0
            self.last = (seed, text)
            out[i] = self.count
        return out


def decode_pieces(df: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the text of each row's ids in column ``into``.

    The blank that every text is given in front is taken off; bytes that are no UTF-8 become replacement
    characters; control ids have no text. Null ids give null, no ids the empty text. Ids that the model does not
    know are an error."""
    path = path or default_model()
    others = [f"`{c}`" for c in df.columns if c not in (ids, into)]
    rows = df.select(F.struct(*others).alias("row") if others else F.lit(0).alias("row"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts: list[str | None] = []
            for own in batch.column(1):
                flat = own.values.to_numpy(zero_copy_only=False) if own.is_valid else None
                if flat is not None and len(flat) and not ((flat >= 0) & (flat < len(v.lengths))).all():
                    raise ValueError(f"ids outside 0..{len(v.lengths) - 1}")
                text = None if flat is None else v.decode(flat.astype(np.int64))
                texts.append(None if text is None else (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["row", "ids", "text"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, ids array<int>, text string")
    return out.select(*([F.col("row.*")] if others else []), F.col("ids").alias(ids), F.col("text").alias(into))


def sample_pieces(
    docs: DataFrame, k: int = 2, key: Column | None = None, seed: int = 1, path: str | None = None, copies: bool = False
) -> DataFrame:
    """Up to k distinct segmentations of every row: ids, log probability, perturbed value, log of the chance of
    being included, and whether the ids decode to the text again.

    With ``copies`` rows of one key and text that follow each other are copies, as mixing writes them, numbered from 0
    by ``copy``; each has samples of its own (a copy that a file split parts from its twin is numbered 0 again).
    Otherwise equal rows have equal samples, wherever they stand."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Copies()
        for batch in batches:
            for part in chunks(batch, most=TEXT_AT_ONCE):
                texts = part.column(1).to_pylist()
                seeds = part.column(2).to_numpy().view(np.uint64)
                number = counter.numbers(seeds, texts) if copies else np.zeros(len(texts), np.int64)
                seeds = np.where(number > 0, mix(seeds + number.astype(np.uint64)), seeds)
                search = Search(lattices(path), texts, seeds, k)
                limit = search.threshold()
                wanted = [b" " + t.replace(MARK.encode(), b" ") if t else b"" for t in texts]
                for s, paths in enumerate(search.paths):
                    on = np.flatnonzero(search.values[s] > -np.inf)
                    ids, starts = search.pieces(s)
                    text = search.table.vocabulary.decode(ids)
                    ends = np.concatenate([[0], np.cumsum(search.table.vocabulary.lengths[ids])])[starts]
                    same = np.array([text[ends[i] : ends[i + 1]] == wanted[i] for i in on], bool)
                    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                    some = len(on) < len(texts)
                    yield pa.record_batch(
                        [part.column(0).take(pa.array(on)), pa.array(number[on], pa.int32()), pa.array(np.full(len(on), s + 1), pa.int32()), lists.take(pa.array(on)) if some else lists,
                         pa.array(np.diff(starts)[on], pa.int32()), paths.whole[on], search.values[s][on],
                         log_inclusion(paths.whole[on], limit[on]), same],
                        names=["doc_id", "copy", "sample", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "decoded"],
                    )

    own = key if key is not None else F.col("doc_id")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.xxhash64(F.lit(seed), own).alias("seed")
    )
    return rows.mapInArrow(run, SCHEMA)
