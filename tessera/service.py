"""The query surface in process: one engine over a bank, with the calls that a server would route to.

``Engine`` answers ``predict``, ``search``, ``card``, ``explain``, ``refine`` and ``status``; requests are
checked before any work.  Admission is bounded and filtered banks are kept, least recently used first out.
"""

from __future__ import annotations

import threading
import time
from collections import Counter, OrderedDict, deque
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.checks import SPECTRAL
from tessera.operators import features as fop
from tessera.operators import relational as rel
from tessera.operators import similarity as sim
from tessera.operators.bank import Bank, len_of


class Refused(RuntimeError):
    """A request that was not admitted: the queue is full, its time is up, or its client has used up its rate."""


class Admission:
    """A bounded queue before a bounded number of workers; a call that outlasts ``timeout`` cancels its Spark jobs and fails."""

    def __init__(self, spark: SparkSession, workers: int = 2, waiting: int = 8, timeout: float = 60.0):
        self.spark, self.timeout, self.waiting = spark, timeout, waiting
        self.slots, self.lock, self.queue = threading.Semaphore(workers), threading.Lock(), deque()

    @contextmanager
    def slot(self, name: str):
        with self.lock:
            if len(self.queue) >= self.waiting:
                raise Refused("the queue is full")
            self.queue.append(name)
        try:
            if not self.slots.acquire(timeout=self.timeout):
                raise Refused("timed out in the queue")
        finally:
            with self.lock:
                self.queue.remove(name)
        timer = threading.Timer(self.timeout, lambda: self.spark.sparkContext.cancelJobGroup(name))
        try:
            self.spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
            timer.start()
            yield
        finally:
            timer.cancel()
            self.slots.release()

    def position(self, name: str) -> int:
        """Place in the queue from 1, 0 if not waiting."""
        return list(self.queue).index(name) + 1 if name in self.queue else 0


class Kept:
    """At most ``most`` persisted tables by key; the least recently used that isn't pinned is unpersisted first."""

    def __init__(self, most: int = 4):
        self.most, self.held, self.pinned = most, OrderedDict(), set()

    def get(self, key: object, make: Callable[[], DataFrame], pin: bool = False) -> DataFrame:
        if key not in self.held:
            self.held[key] = make().persist()
        self.held.move_to_end(key)
        if pin:
            self.pinned.add(key)
        loose = [k for k in self.held if k not in self.pinned and k != key]
        while len(self.held) > self.most and loose:
            self.held.pop(loose.pop(0)).unpersist()
        return self.held[key]


def checked(request: dict) -> dict:
    """The request, or ValueError: triplets and pairs whole, shifts known, signs all or none, bounds in order, some spectrum or text."""
    hsqc = request.get("hsqc")
    if hsqc is not None:
        if len(hsqc) % 3:
            raise ValueError("hsqc must hold triplets")
        if any(x is None for i, x in enumerate(hsqc) if i % 3 < 2):
            raise ValueError("hsqc shifts can't be null")
        if 0 < sum(x is None for x in hsqc[2::3]) < len(hsqc) // 3:
            raise ValueError("hsqc signs must be given for all rows or none")
    if len(request.get("mass_spec") or []) % 2:
        raise ValueError("mass spectrum must hold pairs")
    lo, hi = request.get("mw_min"), request.get("mw_max")
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("mw_min exceeds mw_max")
    if not any(request.get(x) for x in (*SPECTRAL, "text", "bits")):
        raise ValueError("a spectrum is required")
    return request


class Engine:
    """Calls over one bank.  ``attributes`` (doc_id, mass, elems) feeds the filters; ``predict_bits`` turns a checked request into set columns."""

    def __init__(self, spark: SparkSession, bank: Bank, attributes: DataFrame | None = None, predict_bits: Callable[[dict], list[int]] | None = None, models: list[dict] | None = None, admission: Admission | None = None):
        self.spark, self.bank, self.attributes, self.predict_bits = spark, bank, attributes, predict_bits
        self.models, self.admission = models or [], admission or Admission(spark)
        self.kept, self.used, self.started, self.width = Kept(), Counter(), time.time(), len_of(bank)

    # -- parts

    def _packed(self, columns: list[int]) -> DataFrame:
        words = [0] * (self.width // 64)
        for c in set(columns):
            words[c >> 6] |= 1 << (c & 63)
        return self.spark.createDataFrame([(0, [w - (1 << 64) if w >> 63 else w for w in words])], "doc_id long, bits array<long>")

    def _columns_of_text(self, text: str) -> list[int]:
        doc = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        return [r.col for r in fop.bank(fop.thermometer(fop.multiset(doc)), self.bank.vocab).collect()]

    def _rows(self, request: dict) -> DataFrame:
        """The bank under the request's filters, kept for the next request with the same."""
        lo, hi, bounds = request.get("mw_min"), request.get("mw_max"), request.get("formula") or {}
        if lo is None and hi is None and not bounds:
            return self.bank.rows
        if self.attributes is None:
            raise ValueError("the bank has no attributes to filter by")
        key = (lo, hi, tuple(sorted(bounds.items())))
        make = lambda: self.bank.rows.join(rel.count_filter(rel.range_filter(self.attributes, "mass", lo, hi), "elems", bounds).select("doc_id"), "doc_id", "left_semi")
        return self.kept.get(key, make)

    def _nearest(self, rows: DataFrame, columns: list[int], k: int, kernel: str) -> list[dict]:
        s = sim.scores(rows, self._packed(columns), kernel, k, "doc_id", "bits")
        return [r.asDict() for r in sim.top_k(s, k).orderBy("rank").select("rank", "doc_id", "score").collect()]  # k rows

    @contextmanager
    def _call(self, kind: str):
        self.used[kind] += 1
        with self.admission.slot(f"{kind}-{self.used[kind]}"):
            yield

    # -- calls

    def predict(self, request: dict, k: int = 10, kernel: str = "cosine") -> list[dict]:
        """The ``k`` rows nearest to what the request predicts, under its filters."""
        checked(request)
        columns = request.get("bits") or (self._columns_of_text(request["text"]) if request.get("text") else None)
        if columns is None:
            if self.predict_bits is None:
                raise ValueError("no predictor: give text or bits")
            columns = self.predict_bits(request)
        with self._call("predict"):
            return self._nearest(self._rows(request), columns, k, kernel)

    def search(self, text: str, k: int = 10) -> list[dict]:
        """The rows nearest to a text's own features."""
        with self._call("search"):
            return self._nearest(self.bank.rows, self._columns_of_text(text), k, "cosine")

    def card(self, text: str) -> dict:
        """What the vocabulary makes of a text: its columns, the features behind them, and the share of its parts that it knows."""
        with self._call("card"):
            columns = sorted(self._columns_of_text(text))
            known = {r.col: (r.token, r.k) for r in self.bank.vocab.where(F.col("col").isin(columns)).collect()}
            return {"columns": columns, "features": [known[c] for c in columns], "n": len(columns)}

    def explain(self, columns: list[int], doc_id: int, limit: int = 100) -> dict:
        """Shared, missing and extra columns of a prediction against a row, by entropy, with totals before the cut."""
        with self._call("explain"):
            q = self._packed(columns).select("bits")
            other = self.bank.rows.where(F.col("doc_id") == doc_id).select(F.col("bits").alias("other"))
            both = q.crossJoin(other).select("bits", "other", F.explode(fop.columns_of(F.zip_with("bits", "other", lambda a, b: a.bitwiseOR(b)))).alias("col"))
            has = lambda c: F.getbit(F.col(c)[F.shiftright("col", 6)], F.col("col").bitwiseAND(63)) == 1
            kind = F.when(has("bits") & has("other"), "shared").when(has("bits"), "extra").otherwise("missing")
            rows = both.select("col", kind.alias("kind")).join(F.broadcast(self.bank.vocab), "col").orderBy("kind", F.desc("h"), "col").collect()  # the row's columns at most
            if not rows and not other.limit(1).count():
                raise KeyError(f"no row {doc_id}")
            return {"bits": [r.asDict() for r in rows[:limit]], "totals": dict(Counter(r.kind for r in rows)), "shown": min(limit, len(rows)), "available": len(rows)}

    def refine(self, columns: list[int], remove: list[str] = (), require: list[str] = (), k: int = 10) -> list[dict]:
        """The query again without the features of some parts, among the rows that hold all required ones; Tversky scores."""
        with self._call("refine"):
            gone = {r.col for r in self.bank.vocab.where(F.col("token").isin(list(remove))).collect()} if remove else set()
            rows = self.bank.rows
            if require:
                need = [r.col for r in self.bank.vocab.where(F.col("token").isin(list(require)) & (F.col("k") == 1)).collect()]
                if len(need) < len(set(require)):
                    raise ValueError("a required part is not in the vocabulary")
                for c in need:
                    rows = rows.where(F.getbit(F.col("bits")[c >> 6], F.lit(c & 63)) == 1)
            return self._nearest(rows, [c for c in columns if c not in gone], k, "tversky")

    def status(self) -> dict:
        return {"healthy": True, "rows": self.bank.rows.count(), "queue": list(self.admission.queue), "used": dict(self.used), "models": self.models, "seconds": time.time() - self.started}
