"""Operator 4 — repeated passages by longest-previous-factor arrays over a sparse, bucketed suffix order.

A byte is repeated if a string of ``LEAST`` bytes that covers it also starts somewhere else.  Sorting
every suffix of a corpus costs several times the corpus; the order is built only where repeats can be:

1. *Anchors.*  In each ``LEAST``-byte window the ``GRAM``-byte string with the smallest hash is the
   anchor (the last one on ties).  The choice depends on the window's bytes alone, so two equal
   windows have equal anchors at equal places.  About one position in 170 is an anchor, with the
   *context* that all windows around it can reach, at most 336 bytes before and 400 from its start.
2. *Buckets.*  Suffixes that start with the same gram are one bucket of the suffix order.  A bucket
   of one suffix has no repeat.  Suffixes whose whole contexts are equal (by 128-bit hashes) are repeats of
   each other throughout and are settled by counting (copies cost one representative).
3. *Suffix order.*  In the buckets that are left, contexts are sorted by what follows the gram's start,
   with LCPs, and by what precedes it.  Suffixes that start o bytes before the gram agree on those
   bytes if they are in one run of the second order; within a run their suffix order is the first
   order.  So for each o the previous and next smaller positions in suffix order give the
   longest earlier factor (LPF) of each suffix; where every copy counts, the nearest positions on either side
   give the longer of the earlier and the later factor at once.
4. A bucket of more than ``BUCKET`` distinct contexts is not gathered: its windows are dealt out one
   by one under their 128-bit hashes and settled by counting, so no task holds an unbounded bucket.

``keep="first"`` removes later copies and keeps the first in order of (id, hash of text, position);
``keep="none"`` removes every copy.  Matches never cross documents.

With ``words`` a text stands for its words' hashes of ``WORD`` bytes, so the same order finds runs of words,
however many bytes they have and whatever white space is between them; its spans count words.

Defined results: a null text is empty; texts shorter than ``LEAST`` bytes keep everything; a null id
is an id that comes first; rows equal in id and text are two documents under ``keep="none"`` and one
under ``keep="first"``; further columns pass through ``deduplicated``; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, shuffle_partitions, texts_of, tidy

LEAST = 400
GRAM = 64
BUCKET = 1 << 16
WORD = 8
#: Words of the shortest passage by words, however few bytes they have.
PASSAGE = 50
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
RUN = 1 << 21
#: Tables of at most this many rows (some tens of MB) are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000
BATCH_BYTES = 1 << 22
#: Spark's setting that frees an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
NULL_ID = np.iinfo(np.int64).min
AT = np.uint64((1 << 30) - 1)
ANCHOR = "id long, h long, pos long, right int, gram long, ctx long, ctx2 long"


# ---------------------------------------------------------------- anchors


def codes(text: bytes) -> bytes:
    """``WORD`` bytes for each word: equal runs of words are equal runs of bytes."""
    return b"".join(map(xxhash.xxh3_64_digest, text.split()))  # at the bytes that ``WORDS`` leaves out


def anchors_of(texts: list[bytes], least: int, gram: int) -> list[np.ndarray]:
    """Anchor positions of each text, ascending."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    run: list[tuple[int, int, bytes]] = []  # text, offset, part of it

    def flush():
        sizes = np.fromiter((len(p) for _, _, p in run), np.int64, len(run))
        flat = np.frombuffer(b"".join(p for _, _, p in run) + bytes(8), np.uint8)
        n = len(flat) - 8
        word = np.ndarray((n,), "<u8", flat, 0, (1,))
        key = (word * np.uint64(0x9E3779B97F4A7C15)) & ~AT
        key ^= key >> np.uint64(29) & ~AT
        key |= AT - np.arange(n, dtype=np.uint64)
        width, reach = 1, least - gram + 1
        while width * 2 <= reach:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < reach:
            key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
        firsts = np.cumsum(sizes) - sizes
        for (i, offset, _), s, size in zip(run, firsts.tolist(), sizes.tolist()):
            at = (AT - (key[s : s + size - least + 1] & AT)).astype(np.int64)
            at = at[np.r_[True, at[1:] != at[:-1]]]
            found[i].append(at - s + offset)

    size = 0
    for i, t in enumerate(texts):
        if len(t) < least:
            continue
        for s in range(0, len(t) - least + 1, RUN):
            part = t[s : s + RUN + least - 1]
            run.append((i, s, part))
            size += len(part)
            if size >= RUN:
                flush()
                run, size = [], 0
    if run:
        flush()
    return [np.unique(np.concatenate(x)) if len(x) > 1 else x[0] if x else np.empty(0, np.int64) for x in found]


def _wide(parts: list[bytes]) -> np.ndarray:
    """(n x 2) 128-bit hashes: what is told equal by them is equal, at any size of the corpus."""
    return np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)


def _anchors(least: int, gram: int, words: bool):
    def run(batches):
        digest, wide = xxhash.xxh3_64_digest, xxhash.xxh3_128_digest
        for b in batches:
            ids, hs, texts = b.column(0), b.column(1).to_numpy(), texts_of(b.column(2))
            if words:
                texts = [codes(t) for t in texts]
            who, pos, right, grams, ctx = [], [], [], [], []
            for t, at in zip(texts, anchors_of(texts, least, gram)):
                for p in at.tolist():
                    pos.append(p)
                    right.append(min(least, len(t) - p))
                    grams.append(digest(t[p : p + gram]))
                    ctx.append(wide(t[max(0, p - least + gram) : p + least], min(p, least - gram)))
                who.append(len(at))
            at, both = pa.array(np.repeat(np.arange(b.num_rows), who), pa.int64()), _wide(ctx)
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(np.repeat(hs, who)), pa.array(pos, pa.int64()), pa.array(right, pa.int32()), pa.array(np.frombuffer(b"".join(grams), np.int64)), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["id", "h", "pos", "right", "gram", "ctx", "ctx2"])

    return run


# ---------------------------------------------------------------- suffix order


def _sorted_with_lcp(bucket: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket and text, LCP of each with the one before in its bucket, else -1)."""
    order = np.array(sorted(range(len(texts)), key=lambda i: (bucket[i], texts[i])), np.int64)
    sizes = np.fromiter((len(texts[i]) for i in order), np.int64, len(order))
    width = int(sizes.max(initial=0)) + 1
    lcp = np.full(len(order), -1, np.int64)
    for s in range(0, len(order), 4096):  # rows of bytes, compared with the row before
        part = order[max(0, s - 1) : s + 4096]
        if len(part) < 2:
            continue
        rows = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        at = np.arange(max(0, s - 1) + 1, max(0, s - 1) + len(part))
        lcp[at] = np.minimum(first, np.minimum(sizes[at], sizes[at - 1]))
    lcp[np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])] = -1
    return order, lcp


def _previous_smaller(key: np.ndarray, lcp: np.ndarray, need: int) -> np.ndarray:
    """LCP with the previous smaller key in suffix order, 0 where it is under ``need``; lcp: with the one before."""
    at, got = np.arange(len(key)) - 1, lcp.copy()
    at[got < need] = -1
    while True:
        todo = np.flatnonzero((at >= 0) & (key[np.maximum(at, 0)] > key))
        if not len(todo):
            return np.where(at >= 0, got, 0)
        over = at[todo]  # skip with what the skipped one has skipped
        got[todo] = np.minimum(got[todo], got[over])
        at[todo] = at[over]
        at[todo[got[todo] < need]] = -1


def longest_factors(bucket: np.ndarray, before: list[bytes], after: list[bytes], keys: np.ndarray | None, least: int):
    """For each o: (o, contexts, LPF) of the suffixes o bytes before the gram, 0 where under ``least``.

    before, after: bytes up to the gram's start, and from it; keys: what earlier means.  Without keys the longer of
    the earlier and the later factor, which is the longer LCP with a neighbour in suffix order.
    """
    n = len(after)
    order, lcp = _sorted_with_lcp(bucket, after)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    table = [lcp]  # sparse table of range minima
    while 2 << (len(table) - 1) <= n:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    left_order, left_lcp = _sorted_with_lcp(bucket, [x[::-1] for x in before])
    left_size = np.fromiter(map(len, before), np.int64, n)
    right_size = np.fromiter(map(len, after), np.int64, n)
    # the most that a context can share on either side bounds the columns it takes part in
    most_right, most_left = np.empty(n, np.int64), np.empty(n, np.int64)
    most_right[order] = np.maximum(lcp, np.r_[lcp[1:], -1])
    most_left[left_order] = np.maximum(left_lcp, np.r_[left_lcp[1:], -1])
    live = most_left + most_right >= least
    run = np.empty(n, np.int64)
    for o in range(int(left_size.max(initial=0)) + 1):
        need = least - o
        run[left_order] = np.cumsum(left_lcp < o)
        own = np.flatnonzero(live & (most_left >= o) & (most_right >= need) & (left_size >= o) & (right_size >= need))
        if len(own) < 2:
            continue
        own = own[np.argsort(run[own] * n + rank[own])]
        a, b = rank[own[:-1]] + 1, rank[own[1:]] + 1
        same = run[own[1:]] == run[own[:-1]]
        shared = np.full(len(own), -1, np.int64)
        a, b, at = a[same], b[same], np.flatnonzero(same) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level):
            here = level == k
            shared[at[here]] = np.minimum(table[k][a[here]], table[k][b[here] - (1 << int(k))])
        met = shared >= need
        met[:-1] |= met[1:]
        own, shared = own[met], shared[met]
        if not len(own):
            continue
        ahead = np.r_[shared[1:], -1]
        if keys is None:
            factor = np.maximum(shared, ahead)
        else:
            own_keys = keys[own]
            factor = np.maximum(_previous_smaller(own_keys, shared, need), _previous_smaller(own_keys[::-1], ahead[::-1], need)[::-1])
        yield o, own, np.where(factor >= need, factor + o, 0)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs, ascending."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]]


def _matches(least: int, keep: str):
    def solve(rows: list[tuple]):
        """rows: (bucket, id, h, first byte of the context in its text, context, where in it the gram starts)."""
        docs = {d: i for i, d in enumerate(sorted({(r[1], r[2]) for r in rows}))}
        pos = np.array([r[3] + r[5] for r in rows], np.int64)
        keys = (np.array([docs[r[1], r[2]] for r in rows], np.int64) << 40) + pos
        bucket = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        start, end = pos.copy(), pos.copy()
        for o, own, length in longest_factors(bucket, [r[4][: r[5]] for r in rows], [r[4][r[5] :] for r in rows], keys if keep == "first" else None, least):
            own, length = own[length > 0], length[length > 0]
            start[own] = np.minimum(start[own], pos[own] - o)  # all of a context's repeats hold its gram: their union is one span
            end[own] = np.maximum(end[own], pos[own] - o + length)
        for i in np.flatnonzero(end > start).tolist():
            yield rows[i][1], rows[i][2], int(start[i]), int(end[i])

    def batch(rows):
        out = list(solve(rows))
        a, b, c, d = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array([None if x == NULL_ID else x for x in a], pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["id", "h", "start", "end"])

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for gram, i, h, first, body, at in zip(*(b.column(k).to_pylist() for k in range(6))):
                if gram != last and size >= BATCH_BYTES:  # whole buckets only
                    yield batch(rows)
                    rows, size = [], 0
                rows.append((gram, NULL_ID if i is None else i, h, first, body, at))
                size += len(body)
                last = gram
        if rows:
            yield batch(rows)

    return run


def _contexts(least: int, gram: int, words: bool):
    def run(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for i, h, t, spots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), b.column(3).to_pylist()):
                if words:
                    t = codes(t)
                for x in spots:
                    first = max(0, x["pos"] - least + gram)
                    for k, v in enumerate((x["gram"], i, h, first, t[first : x["pos"] + least], x["pos"] - first)):
                        out[k].append(v)
                    if len(out[0]) >= 4096:
                        yield _context_batch(out)
                        out = [[] for _ in range(6)]
            if out[0]:
                yield _context_batch(out)

    return run


CONTEXT = "gram long, id long, h long, first long, body binary, at int"


def _context_batch(out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["gram", "id", "h", "first", "body", "at"])


def _windows(least: int):
    """Contexts of crowded buckets -> every window, by hash."""

    def run(batches):
        for b in batches:
            for i, h, first, body in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                n = len(body) - least + 1
                key = _wide([xxhash.xxh3_128_digest(body[w : w + least]) for w in range(n)])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array([i] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())], ["key", "key2", "id", "h", "start"])

    return run


# ---------------------------------------------------------------- the operator


def _spans_of_text(unit: int):
    def run(batches):
        for b in batches:
            out = []
            for spans in b.column(2).to_pylist():
                s, e = merged(np.array([x["start"] for x in spans], np.int64), np.array([x["end"] for x in spans], np.int64))
                s, e = -(-s // unit), e // unit  # whole units; a match may go on into a part of the next one
                out.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], ["id", "h", "spans"])

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, keep: str = "first", gram: int = GRAM, bucket: int = BUCKET, words: bool = False) -> DataFrame:
    """(id, h, spans array<struct<start,end>>): maximal byte runs to remove; h is xxhash64 of the text.

    Texts with nothing to remove have no row.  With ``words`` the runs are of words, and ``least`` and ``gram``
    are bytes of their codes (``WORD`` for each).
    """
    scratch = Scratch(df.sparkSession, "repeats")
    parts = shuffle_partitions(df.sparkSession)
    first = keep == "first"
    texts = _keyed(df, id_col, text_col)
    long_enough = texts.where(F.octet_length("t") >= (2 * -(-least // WORD) - 1 if words else least))
    found = long_enough.mapInArrow(tidy(_anchors(least, gram, words)), ANCHOR)
    found = scratch.save(found.distinct() if first else found, "anchors")

    # buckets: which grams occur again, and whether in more than one context
    again = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ctx", "ctx2")).alias("a"), F.max(F.struct("ctx", "ctx2")).alias("b")).where("n > 1")
    again = scratch.save(again.select("gram", (F.col("a") != F.col("b")).alias("mixed")), "grams")
    kept = again.count()
    met = scratch.save(found.join(F.broadcast(again) if kept <= BROADCAST_ROWS else again, "gram"), "met")
    me = F.struct("id", "h", "pos")
    contexts = met.groupBy("gram", "ctx", "ctx2").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("least"), F.first("mixed").alias("mixed"))
    contexts = scratch.save(contexts, "contexts")
    span = (F.greatest(F.col("pos") - (least - gram), F.lit(0)).alias("start"), (F.col("pos") + F.col("right")).alias("end"))

    # whole contexts that occur again
    copies = contexts.where("n > 1").select("gram", "ctx", "ctx2", "least")
    n_copies = copies.count()
    settled = met.join(F.broadcast(copies) if n_copies <= BROADCAST_ROWS // 4 else copies, ["gram", "ctx", "ctx2"])
    settled = (settled.where(~me.eqNullSafe(F.col("least"))) if first else settled).select("id", "h", *span)

    # distinct contexts of one bucket, by suffix order
    mixed = contexts.where("mixed").select("gram", "least.*")
    per_text = scratch.save(mixed.groupBy("id", "h").agg(F.collect_list(F.struct("gram", "pos")).alias("spots")), "asked")
    asked = per_text.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "spots")
    same = F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))
    once = long_enough.join(asked, same).select("id", "h", "t", "spots")
    # rows equal in id and text bring each context once
    bodies = once.mapInArrow(tidy(_contexts(least, gram, words)), CONTEXT).dropDuplicates(["gram", "id", "h", "first", "at"])
    bodies = scratch.save(bodies, "bodies")
    crowd = scratch.save(mixed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("gram"), "crowd")
    crowded = crowd.count()
    calm = bodies.join(crowd, "gram", "left_anti") if crowded else bodies
    matched = calm.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(tidy(_matches(least, keep)), "id long, h long, start long, end long")
    spans = settled.union(matched)
    if crowded:
        windows = scratch.save(bodies.join(crowd, "gram", "left_semi").mapInArrow(tidy(_windows(least)), "key long, key2 long, id long, h long, start long").distinct(), "windows")
        own = F.struct("id", "h", "start")
        repeated = windows.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("least")).where("n > 1").select("key", "key2", "least")
        again_there = windows.join(scratch.save(repeated, "repeated"), ["key", "key2"])
        again_there = again_there.where(~own.eqNullSafe(F.col("least"))) if first else again_there
        spans = spans.union(again_there.select("id", "h", "start", (F.col("start") + least).alias("end")))
    gathered = spans.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = scratch.save(gathered.mapInArrow(tidy(_spans_of_text(WORD if words else 1)), "id long, h long, spans array<struct<start:long,end:long>>"), "spans")
    scratch.drop("anchors", "grams", "met", "contexts", "asked", "bodies", "crowd", "windows", "repeated")
    return out


def _with_spans(df: DataFrame, id_col: str, text_col: str, spans: DataFrame, columns: list[str]) -> DataFrame:
    n = spans.agg(F.sum(F.size("spans") + 1)).first()[0] or 0
    side = spans.select(F.col("id").alias("_i"), F.col("h").alias("_h"), "spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)]  # whatever they are called
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text.alias("_t"), *carried).withColumn("_key", F.xxhash64("_t"))
    on = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_h"))
    return rows.join(F.broadcast(side) if n <= BROADCAST_ROWS else side, on, "left").select("_id", "_t", "spans", *[f"_c{i}" for i in range(len(columns))])


def cut(text: bytes, spans: list[dict] | None) -> bytes:
    out, at = [], 0
    for x in spans or []:
        out.append(text[at : x["start"]])
        at = x["end"]
    out.append(text[at:])
    return b"".join(out)


def whole_characters(text: bytes, spans: list[dict] | None) -> list[dict]:
    """Spans drawn in to character boundaries, so that what is left is text."""
    out = []
    for x in spans or []:
        s, e = x["start"], x["end"]
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append({"start": s, "end": e})
    return out


def in_bytes(text: bytes, spans: list[dict] | None) -> list[dict]:
    """Spans of bytes, and of words where they say so, as maximal spans of bytes."""
    if not any(x["words"] for x in spans or []):
        return spans or []
    at = [m.span() for m in WORDS.finditer(text)]
    own = [(at[x["start"]][0], at[x["end"] - 1][1]) if x["words"] else (x["start"], x["end"]) for x in spans]
    s, e = merged(*np.array(own, np.int64).T)
    return [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())]


def _cut_rows(batches):
    for b in batches:
        texts = [cut(t, whole_characters(t, in_bytes(t, s))).decode() for t, s in zip(texts_of(b.column(1)), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *b.columns[3:]], ["_text", *b.schema.names[3:]])


def _told(spans: DataFrame, words: bool) -> DataFrame:
    return spans.select("id", "h", F.transform("spans", lambda x: F.struct(x.start, x.end, F.lit(words).alias("words"))).alias("spans"))


def passage_spans(df: DataFrame, id_col: str, text_col: str, words: int, **options) -> DataFrame:
    """(id, h, spans array<struct<start,end,words>>): the runs of bytes and, with ``words``, those of so many words."""
    conf = df.sparkSession.conf
    cleanup = conf.get(CLEANUP, None)
    if words:  # else the files of one order would lie beside those of the other
        conf.set(CLEANUP, "true")
    try:
        spans = _told(repeated_spans(df, id_col, text_col, **options), False)
        if words:
            by_word = repeated_spans(df, id_col, text_col, **options | {"least": words * WORD, "words": True})
            both = spans.union(_told(by_word, True)).groupBy("id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))
            spans = Scratch(df.sparkSession, "repeats").save(both, "both")
    finally:
        conf.unset(CLEANUP) if cleanup is None else conf.set(CLEANUP, cleanup)
    return spans


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 0, **options) -> DataFrame:
    """``df`` with the repeated passages cut out of ``text_col``; only whole characters are cut.

    With ``words``, runs of so many words are passages too, of however few bytes.  Both are judged on the input.
    """
    spans = passage_spans(df, id_col, text_col, words, **options)
    rest = [c for c in df.columns if c != text_col]
    fields = ", ".join(["_text string", *(f"_c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))])
    out = _with_spans(df, id_col, text_col, spans, rest).mapInArrow(tidy(_cut_rows), fields)
    return out.select(*[F.col("_text" if c == text_col else f"_c{rest.index(c)}").alias(c) for c in df.columns])


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long"


def _digests(batches):
    for b in batches:
        rows = []
        for i, t, spans in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()):
            of_bytes, of_words = ([x for x in spans or [] if x["words"] == w] for w in (False, True))
            left = cut(t, of_bytes)
            rows.append((i, len(t), len(t) - len(left), len(of_bytes), hashlib.sha256(left).hexdigest(), len(of_words), sum(x["end"] - x["start"] for x in of_words)))
        names, kinds = zip(*(c.split() for c in DIGESTS.split(", ")))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], list(names))


def query(spark, sf_dir: str) -> DataFrame:
    """Bytes are removed by windows of ``LEAST`` bytes alone; the runs of ``PASSAGE`` words that start elsewhere too are told beside them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = passage_spans(docs, "doc_id", "text", PASSAGE, keep="none")
    return _with_spans(docs, "doc_id", "text", spans, []).mapInArrow(tidy(_digests), DIGESTS)
