"""Secret scans: fixed patterns, and strings in a sensitive context that do not compress.

A candidate is a run of 16 or more credential characters that mixes letters and digits, and stands within
``CONTEXT`` characters of a sensitive word, before or behind it.  Runs with nothing but white space, quotes,
backslashes and comment marks between them (keys over several lines) share the context of any of them; a
short last line before an END mark belongs to the run above it.  Its marginal cost is what the zstandard frame of its
surroundings grows by when the candidate is appended, under a compressor primed with a dictionary of
identifiers.  Names, paths and repeats of other surroundings cost little; a random key costs nearly its full
entropy and is reported.  Its own other places are blanked before it is measured, and a string reported once
is reported wherever it stands in the text.

Runs of 8 or more credential characters and symbols are candidates too if their letters do not read as words: in random
strings the pieces between changes of case, digits and symbols are short (``PIECE``), in names, paths and compounds long.
That is how passwords, keys without digits and dotted tokens are told from prose; a key of lower-case letters alone is
not.  Everything is row-local; memory is bounded by the texts of one Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, per_batch

KINDS = ("assign", "access", "hex", "novel")  # order of spans with the same start

# Fixed patterns.  The last two ask for the least length at once: a longest run that is too short has no
# shorter match in it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
SENSITIVE = re.compile(r"key|secret|token|passw|pwd|auth|credential|bearer|private|access|signature", re.I | re.A)
CONTEXT = 64  # characters before and behind a candidate that may hold the sensitive word
GAP = re.compile(r"""[\s"'\\#>*|]*""")  # between the lines of one key
TAIL = re.compile(r"""[\s"'\\#>*|]+[A-Za-z0-9+/=]{1,15}(?=(?:[\s"'#>*|]|\\[nr]?)+-----END)""")  # its last line, too short for a candidate
AROUND = 512  # characters on either side that it is compressed against
NOVELTY = 0.6  # marginal bytes per character from which it is reported

# Plain words ahead of thin surroundings where only a word behind speaks for a candidate: without them a path
# costs as much as a key (0.86 bytes a character in the tests, 0.54 with them; random keys stay above NOVELTY).
PLAIN = "A line of plain words stands here, so that common letters are known before the run is measured. "

# Words of code and configuration that prime the compressor (own choice).
IDENTIFIERS = (
    "abstract access account address algorithm allow application argument array assert attribute auth author "
    "authorization base64 bearer boolean branch buffer bucket build bytes cache callback catch certificate char "
    "class client cluster code column comment commit config configuration connect connection const container "
    "content context continue cookie copy count create credential current data database date debug decode default "
    "define delete description digest directory disable document domain double driver element email enable encode "
    "endpoint environment error event example except execute export extends false fetch field file filter final "
    "float folder format from function generate global group handler hash header height hostname html http https "
    "identifier image import include index init input insert instance integer interface internal item iterator json "
    "kernel key label language length level library license list listener load local localhost lock log login long "
    "main manager map master match memory message metadata method model module name namespace network node none "
    "null number object offset open option order output package page parameter parent parse password path pattern "
    "permission pointer policy port position prefix print private process profile project property protected "
    "protocol provider proxy public query queue random range read record refresh region register release remote "
    "remove replace repository request resource response result return role root router row schema scope script "
    "search secret section select self sequence server service session setting signature size socket source "
    "start state static status storage stream string struct style submit suffix sum switch system table target "
    "task template test text thread throw time timeout timestamp token total trace transaction true type undefined "
    "unique update upload url user username util uuid valid value variable vector version view virtual void volume "
    "warning web while width window worker write xml yaml zone"
)


RUN = re.compile(r"[A-Za-z0-9+/_=!@#$%^&*~-]{8,}(?:\.[A-Za-z0-9+/_=!@#$%^&*~-]{8,})*")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Mean length of the letter pieces from which a run reads as words; without digits, and then of 24 or more
# characters, there are more pieces to take the mean of and names have longer ones.
PIECE, PIECE_NO_DIGITS, PIECE_LONG, LONG = 3, 3.3, 4, 24


def broken(run: str) -> bool:
    """Whether at least a third of a run are letters and they do not read as words."""
    pieces = PIECES.findall(run)
    letters = sum(map(len, pieces))
    limit = PIECE if any(c in "0123456789" for c in run) else PIECE_NO_DIGITS if len(run) < LONG else PIECE_LONG
    return letters * 3 >= len(run) and letters < limit * len(pieces)


def core(run: str) -> str:
    """A candidate without a name and equals sign ahead and marks at its ends, if that leaves a candidate."""
    value = run.rstrip("=").rpartition("=")[2].strip("-_/+")
    return value if CANDIDATE.fullmatch(value) else run


class Novelty:
    """Marginal compressed size under a primed dictionary."""

    def __init__(self, dictionary: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)

    def marginal(self, text: str, start: int, end: int, ahead: str = "") -> int:
        own = core(text[start:end])
        blank = " " * len(own)  # of the same length, as places count
        before = text[max(0, start - AROUND - len(own)) : start].replace(own, blank)[-AROUND:]
        behind = text[end : end + AROUND + len(own)].replace(own, blank)[:AROUND]
        around = (ahead + before + behind).encode()
        return len(self.compressor.compress(around + text[start:end].encode())) - len(self.compressor.compress(around))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; offsets are code points."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of credential characters, (start, end), those of one key together."""
    run: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        if run and not GAP.fullmatch(text, run[-1][1], m.start()):
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Spans that the fixed patterns do not touch and that are new against their surroundings."""
    spans, others, k = [], [], 0
    for run in chains(text):
        inside = []  # fixed patterns that touch each candidate
        for start, end in run:
            while k < len(base) and base[k][2] <= start:
                k += 1
            # from here on base spans end after the candidate starts; later ones start no sooner
            inside.append(base[k][1] if k < len(base) and base[k][0] < end else None)
        open_ = [place for place, kind in zip(run, inside, strict=True) if kind is None]
        before = any(kind in (0, 1) for kind in inside) or any(SENSITIVE.search(text, max(0, a - CONTEXT), a) for a, _ in run)
        if not before and not any(SENSITIVE.search(text, b, b + CONTEXT) for _, b in run):
            others += open_
            continue
        for start, end in open_:
            word = text[start:end]
            if not MIXED.match(word):
                continue  # left to broken_spans
            if novelty.marginal(text, start, end, "" if before else PLAIN) >= NOVELTY * (end - start):
                spans.append((start, 3, end))
            else:
                others.append((start, end))
        tail = TAIL.match(text, run[-1][1])
        if tail and spans and spans[-1][2] == run[-1][1]:
            spans[-1] = (spans[-1][0], 3, tail.end())
    known = {core(m.group()) for m in (CANDIDATE.match(text, start) for start, _, _ in spans)}
    if known:  # what is a secret in one place is one in every place
        spans += [(start, 3, end) for start, end in others if core(text[start:end]) in known]
    return spans


def broken_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Spans of runs that do not read as words, in a sensitive context and new, outside the ``taken`` ones (sorted by start)."""
    if not SENSITIVE.search(text):
        return []
    spans, others, k, reach = [], [], 0, 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][0] < end:
            reach, k = max(reach, taken[k][2]), k + 1
        if reach > start or not broken(m.group()):
            continue
        before = SENSITIVE.search(text, max(0, start - CONTEXT), start)
        if not before and not SENSITIVE.search(text, end, end + CONTEXT):
            others.append((start, 3, end))
        elif novelty.marginal(text, start, end, "" if before else PLAIN) >= NOVELTY * (end - start):
            spans.append((start, 3, end))
        else:
            others.append((start, 3, end))
    known = {text[a:b] for a, _, b in spans}
    return spans + [span for span in others if text[span[0] : span[2]] in known]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: str | None, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    text = text or ""
    base = base_spans(text)
    spans = sorted(base + novel_spans(text, base, novelty))
    return base, sorted(spans + broken_spans(text, spans, novelty))


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def with_spans(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` for every row.

    Null and empty texts have no spans and the digest of nothing; repeated rows stay; columns of ``df`` outside
    ``keep`` are dropped, and those of ``keep`` may not bear the names made here.
    """

    def worker() -> Callable:
        novelty = Novelty()

        def work(values):
            found = [scan(v, novelty) for v in values]
            counts = [[sum(kind == k for _, kind, _ in base) for base, _ in found] for k in range(3)]
            return [*counts, [sha256(_joined(base).encode()).hexdigest() for base, _ in found], [_joined(spans) for _, spans in found]]

        return work

    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    fields += [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    return per_batch(df, text, fields, worker, keep)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``df`` with every secret in ``text`` replaced by ``mark``; null texts stay null."""

    def worker() -> Callable:
        novelty = Novelty()
        return lambda values: [[redacted(v, scan(v, novelty)[1], mark) for v in values]]

    (clean,) = fresh(df, "_clean")
    others = [c for c in df.columns if c != text]
    cleaned = per_batch(df, text, [T.StructField(clean, T.StringType())], worker, others)
    return cleaned.select(*[F.col(clean).alias(text) if c == text else F.col(c) for c in df.columns])


def op5(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    return with_spans(documents, keep=["doc_id"])
