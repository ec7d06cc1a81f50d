"""Personal data, and the terms around it that give it away.

Fixed patterns find addresses, numbers and cards.  What they miss is context: a name or a code that stands by the same
address again and again tells a reader whose address was removed.  How much a term tells is estimated from the
whole corpus.  With p(e|t) the share of a term's places that lie in the window of an entity e, and p(e) the share of all
places that do, a reader of t gains PMI(t; e) = log2(p(e|t) / p(e)) of the IC(e) = -log2 p(e) bits that
name the entity, and log2(1 / p(e|t)) bits are left.  A term that gives at least ``SHARE`` of the bits and leaves at
most ``LEFT_REMOVED`` is removed wherever it stands, one that leaves at most ``LEFT_GENERALISED`` is generalised to
its kind.  A term counts only with ``SUPPORT`` different windows of the entity, so copies of one passage prove nothing.

Three passes over the texts, none of which keeps a table that grows with the corpus in a worker or in the driver.
The first emits (entity, term, window) of the few texts with an entity.  The second counts the places of candidate terms:
workers know the candidates from a filter of fixed size (``BITS``) and hand on sums per block; the exact join follows, so
a filter that is too full costs rows, not results.  The third emits the places of terms that
pass the filter of the disclosing terms, and joins them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ROWS, broadcast_if_small, fresh, per_batch
from tessera.session import stable_copy

KINDS = ("email", "ip", "card", "phone", "removed", "generalised")  # order of spans with the same start
BASE = 4  # of them are fixed patterns

WINDOW = 8  # terms on either side of an entity
SUPPORT = 3  # different windows of one entity that a term has to stand in
SHARE = 0.5  # of an entity's bits that a term gives
LEFT_REMOVED = 1.0  # bits a reader of the term still lacks
LEFT_GENERALISED = 2.0
LEAST_TERM = 2  # code points
BITS = 1 << 22  # of the filter of terms, 512 KB
SEED = 42  # of XXH64
KEPT = 200_000  # terms whose answer of the filter a worker remembers
COUNTED = 100_000  # different terms of a block of counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_UPPER = {c: c + 32 for c in range(65, 91)}

# Fixed patterns.  The local part of an address is read backwards from its @ sign, and numbers start where a run of
# digits does: the same matches as reading on from every character, in one pass.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end; code points


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans in order of start, then kind."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(spans)


def _hash(value: bytes) -> int:
    """XXH64 as a signed long, as Spark's own function gives it."""
    h = xxhash.xxh64_intdigest(value, SEED)
    return h - (1 << 64) if h >> 63 else h


def entity(kind: int, value: str) -> int:
    """One entity, however it is written: case of addresses and marks within numbers do not matter."""
    plain = value.translate(_UPPER) if kind < 2 else _NOT_DIGIT.sub("", value)
    return _hash(f"{KINDS[kind]}:{plain}".encode())


def windows(text: str, spans: list[Span], window: int = WINDOW) -> list[tuple[int, str, int, int]]:
    """(entity, term, window, places) of the terms around the spans; a place counts once for an entity."""
    ends = [b for _, _, b in spans]
    starts = [a for a, _, _ in spans]
    reach = np.maximum.accumulate(ends).tolist()
    words = []
    for m in TERM.finditer(text):
        k = bisect_left(starts, m.end()) - 1  # the last span that starts ahead of the term's end
        if k < 0 or reach[k] <= m.start():
            words.append((m.start(), m[0].translate(_UPPER)))
    at = [a for a, _ in words]
    seen, out = set(), Counter()
    for start, kind, end in spans:
        of = entity(kind, text[start:end])
        lo, hi = bisect_left(at, start), bisect_right(at, end - 1)
        near = [*range(max(0, lo - window), lo), *range(hi, min(len(words), hi + window))]
        context = _hash(" ".join(words[i][1] for i in near).encode())
        for i in near:
            if len(words[i][1]) >= LEAST_TERM and (of, i) not in seen:
                seen.add((of, i))
                out[of, words[i][1], context] += 1
    return [(*key, n) for key, n in out.items()]


class Filter:
    """Terms that may be listed; remembers its answers for common terms."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size, self.known = bits, len(bits) * 64, {}

    def __call__(self, term: bytes) -> bool:
        answer = self.known.get(term)
        if answer is None:
            h = _hash(term)
            answer = all(int(self.bits[p >> 6]) >> (p & 63) & 1 for p in (h % self.size, (h >> 24) % self.size))
            if len(self.known) < KEPT:
                self.known[term] = answer
        return answer


def filter_bits(terms: DataFrame, bits: int = BITS) -> np.ndarray:
    """The filter of ``term``; its size does not depend on the number of terms."""
    h = F.xxhash64("term")
    places = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 24), F.lit(bits)))).alias("p")
    words = terms.select(places).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("m"))
    out = np.zeros(bits // 64, np.int64)
    for row in words.collect():  # at most bits / 64 rows
        out[row["w"]] = row["m"]
    return out.view(np.uint64)


def _folded(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _pairs(documents: DataFrame, text: str) -> DataFrame:
    """``entity, term, context, n``; the row without an entity holds the number of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["entity", "term", "context", "n"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                rows, total = [], 0
                for value in whole.column(0).slice(start, ROWS).to_pylist():
                    value = value or ""
                    total += len(_folded(value))
                    spans = base_spans(value)
                    if spans:
                        rows += windows(value, spans)
                rows.append((None, None, None, total))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    found = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "entity long, term string, context long, n long")
    return found.groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))


def _places(documents: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """``term, n``: sums per block of the terms that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, sums = Filter(bits), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t.decode() for t in sums]), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                for value in whole.column(0).slice(start, ROWS).to_pylist():
                    sums.update(filter(passes, _folded(value or "")))
                    if len(sums) >= COUNTED:
                        yield out()
                        sums.clear()
        if sums:
            yield out()

    return documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term string, n long")


def disclosing_terms(documents: DataFrame, text: str = "text") -> DataFrame:
    """``term, kind, given, left``: terms of the whole corpus that give an entity away, with the entity they tell most of."""
    pairs = stable_copy(_pairs(documents, text))
    total = pairs.where("entity is null").agg(F.sum("n")).first()[0] or 0
    near = pairs.where("entity is not null")
    sizes = near.groupBy("entity").agg(F.sum("n").alias("of_entity"))
    together = near.groupBy("entity", "term").agg(F.count("*").alias("windows"), F.sum("n").alias("both")).where(F.col("windows") >= SUPPORT)
    candidates = stable_copy(together.join(sizes, "entity"))
    counts = _places(documents, text, filter_bits(candidates.select("term"))).groupBy("term").agg(F.sum("n").alias("of_term"))
    share = F.col("both") / F.col("of_term")
    left, bits = -F.log2(share), -F.log2(F.col("of_entity") / F.lit(float(total)))
    told = candidates.join(counts, "term").select("term", left.alias("left"), F.when(bits > 0, (bits - left) / bits).otherwise(F.lit(0.0)).alias("given"))
    telling = told.where((F.col("given") >= SHARE) & (F.col("left") <= LEFT_GENERALISED))
    kind = F.when(F.col("left") <= LEFT_REMOVED, F.lit(4)).otherwise(F.lit(5))
    return telling.groupBy("term").agg(F.min("left").alias("left"), F.max_by("given", -F.col("left")).alias("given")).withColumn("kind", kind)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_SPAN = "struct<start:int,kind:int,end:int>"


def with_spans(documents: DataFrame, text: str = "text", keep: list[str] | None = None, terms: DataFrame | None = None) -> DataFrame:
    """``keep`` and ``n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    ``terms`` are the disclosing terms, by default those of ``documents`` themselves.  A term inside a fixed
    pattern's span is left to it.  Null and empty texts have no spans and the digest of nothing; repeated rows stay;
    columns of ``keep`` (all, by default) with names made here are replaced.
    """
    terms = stable_copy((disclosing_terms(documents, text) if terms is None else terms).select("term", "kind"))
    bits = filter_bits(terms)
    nothing = not bits.any()

    def worker() -> Callable:
        passes = Filter(bits)

        def one(value: str | None) -> tuple:
            value = value or ""
            base = base_spans(value)
            found = []
            if not nothing and any(map(passes, _folded(value))):
                starts, reach = [a for a, _, _ in base], np.maximum.accumulate([b for _, _, b in base]).tolist() if base else []
                for m in TERM.finditer(value):
                    word = m[0].translate(_UPPER)
                    if passes(word.encode()):
                        k = bisect_left(starts, m.end()) - 1
                        if k < 0 or reach[k] <= m.start():
                            found.append({"term": word, "start": m.start(), "end": m.end()})
            counts = [sum(kind == k for _, kind, _ in base) for k in range(BASE)]
            return *counts, sha256(_joined(base).encode()).hexdigest(), [{"start": a, "kind": k, "end": b} for a, k, b in base], found

        def work(values):
            rows = [one(v) for v in values]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(7)]

        return work

    span = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end")])
    place = T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    names = [f"n_{KINDS[k]}" for k in range(BASE)]
    kept = [c for c in (documents.columns if keep is None else keep) if c.lower() not in {*names, "base_sha256", "spans"}]
    rid, base, found = fresh(documents, "_rid", "_base", "_found")
    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField("base_sha256", T.StringType())]
    fields += [T.StructField(base, T.ArrayType(span)), T.StructField(found, T.ArrayType(place))]
    rows = per_batch(documents, text, fields, worker, kept).withColumn(rid, F.monotonically_increasing_id())
    rows = rows if nothing else stable_copy(rows)  # row numbers hold from here on; texts are left behind unless kept
    if nothing:
        added = rows.withColumn("_all", F.col(base))
    else:
        each = rows.select(rid, F.explode(found).alias("_f")).select(rid, "_f.*")
        hits = each.join(broadcast_if_small(terms), "term")
        lists = hits.groupBy(rid).agg(F.collect_list(F.struct("start", "kind", "end").cast(_SPAN)).alias("_more"))
        added = rows.join(lists, rid, "left").withColumn("_all", F.array_sort(F.concat(base, F.coalesce("_more", F.array().cast(f"array<{_SPAN}>")))))
    label = F.array(*map(F.lit, KINDS))
    text_of = lambda s: F.concat_ws(":", F.element_at(label, s["kind"] + 1), s["start"], s["end"])
    return added.select(*kept, *names, "base_sha256", F.array_join(F.transform("_all", text_of), ",").alias("spans"))


def generalised(term: str) -> str:
    """The kind of a term, in its place."""
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[WORD]"


def cleaned(text: str | None, spans: str) -> str | None:
    """A text with its spans taken out: fixed patterns and removed terms by a mark, generalised terms by their kind."""
    if not spans:
        return text
    out, at = [], 0
    for part in spans.split(","):
        kind, start, end = part.split(":")
        start, end = int(start), int(end)
        if start >= at:
            mark = generalised(text[start:end]) if kind == "generalised" else "" if kind == "removed" else f"[{kind.upper()}]"
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(documents: DataFrame, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """The rows of ``documents`` with personal data and disclosing terms taken out of ``text``; null texts stay null."""
    renamed, both, clean = fresh(documents, "_text", "_both", "_clean")
    others = [c for c in documents.columns if c != text]
    carried = documents.select(F.col(text).alias(renamed), F.struct(*others).alias(both) if others else F.lit(None).alias(both))
    found = with_spans(carried, renamed, [renamed, both], terms)
    pair = fresh(found, "_pair")[0]
    made = per_batch(
        found.withColumn(pair, F.struct(F.col(renamed).alias("t"), "spans")),
        pair,
        [T.StructField(clean, T.StringType())],
        lambda: lambda values: [[cleaned(v["t"], v["spans"]) for v in values]],
        [both],
    )
    return made.select(*[F.col(clean).alias(text) if c == text else F.col(f"{both}.`{c}`").alias(c) for c in documents.columns])


def op12(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    return with_spans(documents, keep=["doc_id"])
