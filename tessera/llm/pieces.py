"""Operator 9 — sampled SentencePiece segmentations, and lossless decoding.

A text's segmentations are the paths of its piece lattice; a path's weight is the product of its
pieces' probabilities to the power ``alpha``.  Forward filtering sums the weights of all paths into
each position, backward sampling walks from the end and draws each arc by its share of that sum, so a
path comes with exactly its probability.  Draws come from a counter hash of (seed, row key, position
of the arc's end in the text): the same row gives the same segmentation on any machine, in any batch.
``alpha = None`` takes the best path instead.

The vocabulary file is a merge model: scores are minus the merge rank, so a piece's probability is
taken as Zipf's, 1 / (rank + 10), up to a constant.  A character without a piece of its own has one
arc, the fallback to its UTF-8 bytes.

The lattice falls apart wherever no piece crosses (before a blank, around a line feed), so it is
filtered once for each distinct unit; a worker keeps at most ``CACHE`` units, until its task ends, and
works on runs of texts of about ``RUN`` characters, with any one text whole.

Escapes keep decoding lossless: a blank is written as U+2581, a U+2581 of the text itself as its bytes,
and one blank is put in front of a text that isn't empty.

Defined results: null and empty texts have no pieces and decode to the empty text; a null key is a
key of its own; repeated rows have equal segmentations; further columns pass through
``segmented`` and ``decoded``; null pieces decode to null; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

MARK = "▁"
OWN_MARK = "\ud800"  # stands for a U+2581 of the text; no valid text holds it
ALPHA = 0.5
SEED = 17
RUN = 1 << 17
CACHE = 150_000
LONG = 48
SPREAD = 30.0  # each character's factor, equal on all paths, that keeps products in range
ODD = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: counters -> independent bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_key(key: object, seed: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(repr(key), seed))


def draw(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Uniform in [0, 1) for (row key, position)."""
    return (mix(keys + at.astype(np.uint64) * ODD) >> np.uint64(11)) * 2.0**-53


class Table:
    """Keys -> values by open addressing, looked up for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):  # all that are left try their next place; the first to come stays
            free = self.keys[at[left]] < 0
            spot, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[spot], self.values[spot] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = np.where(self.keys[at[left]] >= 0, (at[left] + 1) & self.mask, at[left])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * ODD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where there is none."""
        at = self._home(keys)
        held = self.keys.take(at)
        out = np.where(held == keys, self.values.take(at), -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            spot = (at[left] + 1) & self.mask
            at[left], held = spot, self.keys[spot]
            hit = held == keys[left]
            out[left[hit]] = self.values[spot[hit]]
            left = left[~hit & (held >= 0)]
        return out


class Store:
    """A flat array that grows."""

    def __init__(self, kind: type):
        self.held, self.size = np.empty(1 << 12, kind), 0

    def __len__(self) -> int:
        return self.size

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.size]

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.held):
            grown = np.empty(max(need, len(self.held) * 3 // 2), self.held.dtype)
            grown[: self.size] = self.values
            self.held = grown
        self.held[self.size : need] = more
        self.size = need


class Lattice:
    """The vocabulary, and the filtered lattices of the units met so far, end to end in flat arrays."""

    def __init__(self, path: str, alpha: float | None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.alpha = 1.0 if alpha is None else alpha
        self.best = alpha is None
        own, ranks = {}, {}
        self.bytes_at = np.zeros(256, np.int32)
        self.decode_table: list[bytes] = [b""] * self.size
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.decode_table[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                own[piece], ranks[piece] = i, -sp.get_score(i)
                self.decode_table[i] = piece.replace(MARK, " ").encode()
        inner = any(MARK in p[1:] and set(p) != {MARK} for p in own)
        feed = any("\n" in p for p in own)
        self.units_of = re.compile(r"(?s).+" if inner or feed else rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+").findall
        # trie by (state, character)
        child: dict[tuple[int, int], int] = {}
        ends: dict[int, str] = {}
        for piece in own:
            state = 0
            for c in map(ord, piece):
                state = child.setdefault((state, c), len(child) + 1)
            ends[state] = piece
        self.child = child
        self.table = Table(np.array([(s << 21) | c for s, c in child], np.int64), np.array(list(child.values()), np.int64))
        self.piece = np.full(len(child) + 1, -1, np.int32)
        self.weight = np.zeros(len(child) + 1)
        for state, piece in ends.items():
            self.piece[state] = own[piece]
            self.weight[state] = ((ranks[piece] + 10.0) ** -self.alpha) * SPREAD ** (len(piece) * self.alpha)
        self.deepest = max(map(len, own), default=1)
        self.other = (self.size + 10.0) ** -self.alpha * SPREAD**self.alpha
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.last, self.sizes = Store(np.int32), Store(np.int32)  # unit -> its end node, its characters
        self.first = Store(np.int32)  # node -> first of the arcs that end in it
        self.share = Store(np.float64)  # arc -> cumulative share among the arcs of its end node
        self.back = Store(np.int32)  # arc -> start node
        self.code = Store(np.int32)  # arc -> piece, or size + character for the byte fallback
        self.width = Store(np.int32)  # arc -> characters

    def keep(self, units: list[str], sizes: np.ndarray, inbound: np.ndarray, share: np.ndarray, back: np.ndarray, code: np.ndarray, width: np.ndarray) -> None:
        """Append units laid end to end: ``inbound`` is the number of arcs of each node, ``back`` counts nodes from the first unit's start."""
        nodes, arcs, n = len(self.first), len(self.share), len(self.last)
        self.known.update(zip(units, range(n, n + len(units))))
        self.last.extend(nodes + np.cumsum(sizes + 1) - 1)
        self.sizes.extend(sizes)
        self.first.extend(arcs + np.cumsum(inbound) - inbound)
        self.share.extend(share)
        self.back.extend(back + nodes)
        self.code.extend(code)
        self.width.extend(width)

    def add(self, units: list[str]) -> None:
        """Filter the lattices of new units."""
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        total = len(chars)
        limit = np.repeat(np.cumsum(sizes), sizes)  # end of the unit of each position
        unit = np.repeat(np.arange(len(units)), sizes)
        # arcs by trie walk from every position at once
        at, state = np.arange(total), np.zeros(total, np.int64)
        arcs, single = [], np.zeros(total, bool)
        for depth in range(1, self.deepest + 1):
            inside = at + depth <= limit[at]
            at, state = at[inside], state[inside]
            if not len(at):
                break
            state = self.table.find((state << 21) | chars.take(at + depth - 1))
            hit = state >= 0
            at, state = at[hit], state[hit]
            is_piece = self.piece[state] >= 0
            start, s = at[is_piece], state[is_piece]
            if depth == 1:
                single[start] = True
            arcs.append((start, start + depth, self.piece[s].astype(np.int64), self.weight[s]))
        bare = np.flatnonzero(~single)
        arcs.append((bare, bare + 1, self.size + chars[bare], np.full(len(bare), self.other)))
        start, end, code, weight = map(np.concatenate, zip(*arcs))
        # node of position p of unit u: p + u (each unit has one node more than characters)
        a, b = start + unit[start], end + unit[start]
        order = np.lexsort((a, b))
        a, b, code, weight, width = a[order], b[order], code[order], weight[order], (end - start)[order]
        first = np.cumsum(sizes + 1) - (sizes + 1)
        depth = end[order] - np.repeat(np.cumsum(sizes) - sizes, sizes)[start[order]]
        value = np.zeros(total + len(units))
        value[first] = 1.0
        flow = np.empty(len(a))
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, depth.max(initial=0) + 2))
        for d in range(len(cuts) - 1):
            own = by_depth[cuts[d] : cuts[d + 1]]
            if not len(own):
                continue
            f = value[a[own]] * weight[own]
            heads = np.flatnonzero(np.r_[True, b[own][1:] != b[own][:-1]])
            if self.best:
                peak = np.maximum.reduceat(f, heads)
                value[b[own][heads]] = peak
                tops = np.repeat(peak, np.diff(np.r_[heads, len(f)]))
                won = f == tops  # of equals, the first (the longest piece)
                rank = np.cumsum(won) - np.repeat((np.cumsum(won) - won)[heads], np.diff(np.r_[heads, len(f)]))
                flow[own] = (won & (rank == 1)) * 1.0
            else:
                value[b[own][heads]] = np.add.reduceat(f, heads)
                flow[own] = f / value[b[own]]
        inbound = np.bincount(b, minlength=total + len(units))
        place = np.arange(len(b)) - (np.cumsum(inbound) - inbound)[b]
        share = flow
        for k in range(1, int(place.max(initial=0)) + 1):  # added up node by node: the same in any company
            at = np.flatnonzero(place == k)
            share[at] += share[at - 1]
        share[place == inbound[b] - 1] = 1.0
        if self.best:  # all of the share to the chosen arc
            share = np.where(share >= 1.0, 1.0, 0.0)
        self.keep(units, sizes, inbound, share, a, code, width)

    def split(self, text: str) -> list[str]:
        """Units of a text, none of them longer than needed for whole pieces."""
        if not text:
            return []
        return self.units_of(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK))

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text."""
        lists = [self.split(t) for t in texts]
        flat = [u for x in lists for u in x]
        if not flat:
            return [np.empty(0, np.int32) for _ in texts]
        fresh = set(flat).difference(self.known)
        if fresh and len(self.known) + len(fresh) > CACHE:
            self.clear()
            fresh = set(flat)
        if fresh:
            if short := [u for u in fresh if len(u) <= LONG]:
                self.add(short)
            for u in fresh:
                if len(u) > LONG:
                    self.add_long(u)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sizes = self.sizes.values[which].astype(np.int64)
        ends = np.cumsum(sizes)
        starts_of_doc = np.r_[0, ends][np.cumsum(counts) - counts]
        doc = np.repeat(np.arange(len(lists)), counts)
        pos = ends - starts_of_doc[doc]  # end of the unit in its text
        key = keys[doc]
        node, active = self.last.values[which], np.argsort(which)  # in order of the arcs, which keeps the walk in cache
        floor = node - sizes
        firsts, shares, codes, widths, backs = (x.values for x in (self.first, self.share, self.code, self.width, self.back))
        steps, n = [], np.zeros(len(flat), np.int64)
        while len(active):
            u = draw(key[active], pos[active])
            arc = firsts[node[active]]
            low = np.flatnonzero(shares[arc] <= u)
            while len(low):  # on to the arc whose share holds the draw; the last one's is 1
                arc[low] += 1
                low = low[shares[arc[low]] <= u[low]]
            code = codes[arc]
            steps.append((active, code))
            n[active] += 1
            pos[active] -= widths[arc]
            node[active] = backs[arc]
            active = active[node[active] > floor[active]]
        offset = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        for k, (who, code) in enumerate(steps):
            out[offset[who] + n[who] - 1 - k] = code
        ids, sizes_out = self._expand(out)
        total = np.r_[0, np.cumsum(sizes_out)]
        doc_first = np.r_[offset, len(out)][np.r_[np.cumsum(counts) - counts]]
        doc_last = np.r_[offset, len(out)][np.cumsum(counts)]
        return [ids[total[a] : total[b]] for a, b in zip(doc_first.tolist(), doc_last.tolist())]

    def _expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte fallbacks -> byte pieces; how many pieces each code has."""
        odd = np.flatnonzero(codes >= self.size)
        sizes = np.ones(len(codes), np.int64)
        if not len(odd):
            return codes, sizes
        raw = [(MARK if c == ord(OWN_MARK) else chr(c)).encode() for c in (codes[odd] - self.size).tolist()]
        sizes[odd] = [len(x) for x in raw]
        ids = np.repeat(codes, sizes)
        first = np.cumsum(sizes) - sizes
        spots = np.repeat(first[odd], sizes[odd]) + np.concatenate([np.arange(len(x)) for x in raw])
        ids[spots] = self.bytes_at[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, sizes

    def add_long(self, unit: str) -> None:
        """A unit too long for products of plain floats: filter it position by position, rescaled where values leave the range."""
        n = len(unit)
        values, arcs = [1.0] + [0.0] * n, [[] for _ in range(n + 1)]
        for i in range(n):
            state, single = 0, False
            for j in range(i, min(n, i + self.deepest)):
                state = self.child.get((state, ord(unit[j])), -1)
                if state < 0:
                    break
                if self.piece[state] >= 0:
                    single |= j == i
                    arcs[j + 1].append((i, int(self.piece[state]), values[i] * self.weight[state]))
            if not single:
                arcs[i + 1].append((i, self.size + ord(unit[i]), values[i] * self.other))
            inbound = [x[2] for x in arcs[i + 1]]
            values[i + 1] = max(inbound) if self.best else sum(inbound)
            # keep what is ahead in range: values and pending arcs share one scale, as only ratios matter
            scale = values[i + 1]
            if not 1e-100 < scale < 1e100:
                for j in range(max(0, i + 2 - self.deepest), i + 2):
                    values[j] /= scale
                arcs[i + 2 : i + 1 + self.deepest] = [[(s, c, w / scale) for s, c, w in x] for x in arcs[i + 2 : i + 1 + self.deepest]]
        share, back, code, width = [], [], [], []
        for j in range(1, n + 1):
            total, so_far = sum(x[2] for x in arcs[j]), 0.0
            top = max(x[2] for x in arcs[j])
            chosen = next(k for k, x in enumerate(arcs[j]) if x[2] == top)
            for k, (i, c, w) in enumerate(arcs[j]):
                so_far += w
                share.append((1.0 if k >= chosen else 0.0) if self.best else 1.0 if k == len(arcs[j]) - 1 else so_far / total)
                back.append(i)
                code.append(c)
                width.append(j - i)
        self.keep([unit], np.array([n]), np.array(list(map(len, arcs))), np.array(share), np.array(back, np.int64), np.array(code), np.array(width))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.decode_table[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def lattice(path: str, alpha: float | None) -> Lattice:
    return Lattice(path, alpha)


def _runs(texts: list[str]):
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _segment(path: str, alpha: float | None, seed: int):
    def run(batches):
        lat = lattice(path, alpha)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for s, e in _runs(texts):
                ids = lat.encode(texts[s:e], np.array([row_key(k, seed) for k in keys[s:e]], np.uint64))
                n = pa.array([len(x) for x in ids], pa.int64())
                whole = pa.array([lat.decode(x) == t for x, t in zip(ids, texts[s:e])])
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])]
                pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids)))
                rest = [b.column(i).slice(s, e - s) for i in range(2, b.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pieces, n, whole], [*b.schema.names[2:], "pieces", "n_pieces", "lossless"])
        lat.clear()  # the worker lives on and serves other operators

    return run


def segmented(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, alpha: float | None = ALPHA, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default), then pieces array<int>, n_pieces long, lossless boolean."""
    keep = df.columns if keep is None else keep
    rows = df.select(F.col(id_col).alias("_key"), F.col(text_col).cast("string").alias("_t"), *[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(tidy(_segment(path or vocabulary_path(), alpha, seed)), f"{fields}{', ' if fields else ''}pieces array<int>, n_pieces long, lossless boolean")


def _decoded(path: str, pieces_at: int):
    def run(batches):
        lat = lattice(path, None)
        for b in batches:
            texts = [None if x is None else lat.decode(np.array(x, np.int64)) for x in b.column(pieces_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "_decoded"])

    return run


def decoded(df: DataFrame, pieces_col: str = "pieces", name: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with column ``name`` (replaced if there) decoded from its piece ids: the text that was segmented, whichever way; null stays null."""
    keep = [c for c in df.columns if c != name]
    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(tidy(_decoded(path or vocabulary_path(), keep.index(pieces_col))), f"{fields}, _decoded string")
    return out.withColumnRenamed("_decoded", name)


def _digests(batches):
    for b in batches:
        ids, cuts = b.column(1).flatten().to_numpy().astype("<u4"), np.r_[0, np.cumsum(b.column(1).value_lengths().to_numpy())].tolist()
        crc = [zlib.crc32(ids[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(crc, pa.int64()), b.column(3)], ["doc_id", "n_pieces", "ids_crc32", "lossless"])


def query(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless): digests of the piece ids that the operator gives for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    found = segmented(docs, keep=["doc_id"]).select("doc_id", "pieces", "n_pieces", "lossless")
    return found.mapInArrow(tidy(_digests), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
