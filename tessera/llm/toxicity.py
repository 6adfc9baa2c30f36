"""Operator 8 — toxicity of text restored by a noisy-channel decoder.

A writer's word passes a channel that swaps letters for look-alikes (``LOOKALIKES``), repeats them, and
puts separators between them.  ``Decoder.restore`` finds the likeliest source by Viterbi search over
the lattice of what each seen character may stand for, under a character trigram model of the
words of all texts; runs of single characters (``i d i o t``) are joined first.  Plain words pass as they
are; tokens of more than ``LONG`` characters are read part by part between their separators, and without
any the search runs over the whole token.  Features are the restored words and their first three to five letters; a logistic regression
on the most telling ones gives the score.

The logistic fit uses only labelled rows of the training part: at most ``TRAIN_ROWS`` of them, those with
the smallest hash of their id.  The trigrams need no labels and are counted over all texts.  All texts
are scored, whole.

Defined results: a null or empty text has no features and scores the base rate; a null id is never
a training row and takes the crc of the empty text; rows repeated in either table count as often as they are there;
labels outside 0 and 1 or null teach nothing; without training rows every score is 0; clashing or
further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, tidy

TRAIN_ROWS = 20_000
FEATURES = 3_000
LEAST_DOCS = 5
LEAST_GAIN = 6.0  # log likelihood that a feature's own rate gains over the base rate
CACHE = 400_000
LONG = 200  # tokens of more characters are read part by part and not remembered
THRESHOLD = 0.7
#: fixed values: what a seen character may stand for besides itself
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SWAP, KEEP_ODD, REPEAT, SKIP, SKIP_ODD = math.log(0.3), math.log(0.02), math.log(0.1), math.log(0.05), math.log(0.0005)
BETWEEN = " .-_*~,/\\'`"
SPACED = re.compile(r"(?<![^\W_])[^\W_@$!|][ .\-_*~][^\W_][ .\-_*~][^\W_](?:[ .\-_*~][^\W_])*(?![^\W_])|(?<![\w@$!|])[\w@$!|](?:[ .\-_*~][\w@$!|]){2,}(?![\w@$!|])")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"
LEAD = "".join(c for c in EDGE if c not in "@$!|+(€")
JOINTS = re.compile(r"(?:[^\w@$!|+*#%(€£¡]|_)+")
TRIPLE = re.compile(r"(.)\1\1")


class Decoder:
    """Character trigram model (interpolated with its lower orders) and the Viterbi search over it."""

    def __init__(self, trigrams: dict[str, int]):
        self.three = trigrams
        self.two, self.pair, self.one = Counter(), Counter(), Counter()
        for g, n in trigrams.items():
            self.two[g[:2]] += n
            self.pair[g[1:]] += n
            self.one[g[2]] += n
        self.mid = Counter()
        for g, n in self.pair.items():
            self.mid[g[0]] += n
        self.total = sum(self.one.values())
        self.letters = len(self.one) + 1
        self.memo: dict[str, float] = {}

    def log_p(self, before: str, c: str) -> float:
        g = before + c
        got = self.memo.get(g)
        if got is None:
            p1 = (self.one[c] + 0.1) / (self.total + 0.1 * self.letters)
            p2 = (self.pair[g[1:]] + 5 * p1) / (self.mid[before[1]] + 5)
            got = self.memo[g] = math.log((self.three.get(g, 0) + 5 * p2) / (self.two[before] + 5))
        return got

    def restore(self, seen: str) -> str:
        """The likeliest source word of a run of characters; every state is kept."""
        # (last two source characters, last seen character) -> (score, source so far as a chain of characters)
        states = {("^^", ""): (0.0, None)}
        for c in seen:
            new: dict[tuple[str, str], tuple[float, tuple | None]] = {}

            def put(key, score, text):
                if key not in new or new[key][0] < score:
                    new[key] = (score, text)

            for (before, last), (score, text) in states.items():
                if c == last:
                    put((before, c), score + REPEAT, text)
                if not c.isalnum():
                    put((before, last), score + (SKIP_ODD if c in LOOKALIKES else SKIP), text)
                for s in LOOKALIKES.get(c, ""):
                    put((before[1] + s, c), score + SWAP - math.log(len(LOOKALIKES[c])) + self.log_p(before, s), (text, s))
                own = 0.0 if c.isalpha() else KEEP_ODD
                put((before[1] + c, c), score + own + self.log_p(before, c), (text, c))
            states = new
        ends = [(score + self.log_p(before, "$"), text) for (before, _), (score, text) in states.items()]
        best = max(score for score, _ in ends)
        return max(_source(text) for score, text in ends if score == best)


def _source(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, c = chain
        out.append(c)
    return "".join(reversed(out))


def word_of(token: str) -> str:
    """A token without the punctuation around it; signs that may stand for a first letter stay."""
    return token.rstrip(EDGE).lstrip(LEAD)


def parts_of(word: str) -> list[str]:
    """The parts between a long token's separators; single characters in a row make one part."""
    out, letters = [], ""
    for p in filter(None, JOINTS.split(word)):
        if len(p) == 1:
            letters += p
            continue
        out += [letters, p] if letters else [p]
        letters = ""
    return [*out, letters] if letters else out


class Reader:
    """Text -> features (only those of ``wanted``, if given), with a bounded memory of tokens."""

    def __init__(self, decoder: Decoder, wanted: Collection[str] | None = None):
        self.decoder, self.wanted, self.known = decoder, wanted, {}

    def of_token(self, token: str) -> tuple[str, ...]:
        found = self.of_word(token)
        return found if self.wanted is None else tuple(f for f in found if f in self.wanted)

    def of_word(self, token: str) -> tuple[str, ...]:
        word = word_of(token)
        if not word or word.isdigit():
            return ()
        if len(word) > LONG and len(parts := parts_of(word)) > 1:  # joined without blanks: each part is a word
            return tuple(dict.fromkeys(f for p in dict.fromkeys(parts) for f in self.of_word(p)))
        forms = set()
        if not word.isalpha() or TRIPLE.search(word):
            # hyphens and the like join words as well as letters: the parts count too
            forms.update(p for p in re.split(r"[^\w@$!|+*#%]+", word) if p.isalpha() and not TRIPLE.search(p))
            if any(c.isalpha() or c in LOOKALIKES for c in word):
                forms.add(self.decoder.restore(word))
        else:
            return (word + "$", *(word[:k] for k in (3, 4, 5) if len(word) >= k)) if len(word) >= 3 else ()
        out = []
        for w in forms:
            if len(w) >= 3:
                out += [w + "$", *(w[:k] for k in (3, 4, 5) if len(w) >= k)]
        return tuple(out)

    def features(self, text: str) -> set[str]:
        text = text.lower()
        tokens = set(text.split())
        for m in SPACED.findall(text):
            tokens.add("".join(c for c in m if c not in BETWEEN))
        known, found = self.known, set()
        if len(known) > CACHE:
            known.clear()
        for t in tokens:
            got = known.get(t)
            if got is None:
                got = self.of_token(t)
                if len(t) <= LONG:
                    known[t] = got
            if got:
                found.update(got)
        return found


def _trigrams(batches):
    """Character trigrams of the plain words of all texts; what is held is bounded."""
    seen: Counter = Counter()

    def flush():
        plain = [(w, n) for w, n in zip(map(word_of, seen), seen.values()) if w.isalpha() and not TRIPLE.search(w)]
        seen.clear()
        sizes = np.fromiter((len(w) + 1 for w, _ in plain), np.int64, len(plain))  # trigrams of ^^word$
        flat = np.frombuffer("".join([f"^^{w}$" for w, _ in plain]).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(len(plain)), sizes)
        code = flat[at] << 42 | flat[at + 1] << 21 | flat[at + 2]
        kinds, back = np.unique(code, return_inverse=True)
        total = np.bincount(back, np.repeat(np.fromiter((n for _, n in plain), np.float64, len(plain)), sizes), len(kinds))
        grams = [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in kinds.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(total.astype(np.int64))], ["g", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            seen.update((t or "").lower().split())
            if len(seen) > CACHE:
                yield flush()
    if seen:
        yield flush()


def _feature_counts(shared):
    def run(batches):
        reader, seen = Reader(Decoder(shared.value)), defaultdict(lambda: [0, 0])
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in reader.features(t or ""):
                    seen[f][0] += 1
                    seen[f][1] += y
        items = list(seen.items())
        for s in range(0, len(items), 100_000):
            part = items[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], ["f", "n", "bad"])

    return run


def _present(shared, chosen):
    def run(batches):
        place = chosen.value
        reader = Reader(Decoder(shared.value), place)
        for b in batches:
            at = [sorted(place[f] for f in reader.features(t or "")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.list_(pa.int32()))], ["y", "at"])

    return run


def logistic(rows: list[list[int]], y: np.ndarray, width: int, penalty: float = 0.02, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by descent with momentum on sparse binary rows, each weight in steps of its own curvature bound."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
    who = np.repeat(np.arange(len(rows)), sizes)
    curve = 0.25 * np.bincount(at, minlength=width) * (1 + sizes.max(initial=0)) + penalty
    w, v, bias, vb = np.zeros(width), np.zeros(width), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), 0.0
    for _ in range(steps):
        z = bias + np.bincount(who, w[at], len(rows))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        v = 0.95 * v - (np.bincount(at, e[who], width) + penalty * w) / curve
        vb = 0.95 * vb - 4 * e.mean() / (1 + sizes.max(initial=0))
        w, bias = w + v, bias + vb
    return w, bias


class Model:
    def __init__(self, trigrams: dict[str, int], weights: dict[str, float], bias: float):
        self.trigrams, self.weights, self.bias = trigrams, weights, bias


def crc_part(id_col: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> Model | None:
    """Trigrams of all of ``docs`` and a fit on at most ``most`` labelled rows; None without any."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col(id_col).alias("_l"), F.col(label_col).cast("int").alias("y")).where("_l IS NOT NULL AND y IN (0, 1)")
    if train is not None:
        known = known.withColumnRenamed("_l", id_col).where(train).withColumnRenamed(id_col, "_l")
    picked = known.orderBy(F.xxhash64("_l"), "_l", "y").limit(most)
    sample = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), F.col("_d") == F.col("_l")).select("t", "y")
    sample = scratch.save(sample, "sample")
    total, bad = sample.agg(F.count("y"), F.sum("y")).first()
    if not total or not bad or bad == total:
        return None
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    grams = texts.mapInArrow(tidy(_trigrams), "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast({r.g: r.n for r in grams.collect()})  # no more than the alphabet cubed
    counts = sample.mapInArrow(tidy(_feature_counts(shared)), "f string, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    base = bad / total
    rate = F.col("bad") / F.col("n")
    gain = F.col("bad") * F.log(F.greatest(rate, F.lit(1e-9)) / base) + (F.col("n") - F.col("bad")) * F.log(F.greatest(1 - rate, F.lit(1e-9)) / (1 - base))
    telling = counts.where(F.col("n") >= LEAST_DOCS).select("f", gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "f").limit(FEATURES)  # of either sign
    names = [r.f for r in telling.collect()]
    chosen = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    rows = sample.mapInArrow(tidy(_present(shared, chosen)), "y int, at array<int>").collect()  # at most ``most`` rows
    w, bias = logistic([r.at for r in rows], np.array([r.y for r in rows], float), len(names))
    return Model(shared.value, dict(zip(names, w.tolist())), bias)


def _scores(shared):
    def run(batches):
        model = shared.value
        weights = model.weights
        reader = Reader(Decoder(model.trigrams), weights)
        for b in batches:
            z = np.array([model.bias + sum(weights[f] for f in sorted(reader.features(t or ""))) for t in b.column(1).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["id", "score"])

    return run


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    if model is None:
        return rows.select("id", F.lit(0.0).alias("score"))
    return rows.mapInArrow(tidy(_scores(docs.sparkSession.sparkContext.broadcast(model))), "id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels, train=crc_part("doc_id", 3) != 1)
    out = scored(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (crc_part("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
