"""Ranked search, disclosing terms and infilling against brute force and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import bpe, disclosure, infill, lexical, secret_scan, simhash, token_counts
from tessera.session import ship_package

SF = "/root/testdata/sf0.001"
PROSE = "The quick brown fox jumps over the lazy dog and runs into the deep green wood again."
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000)) + "."
ODD = [None, "", " \n\t ", "x", PROSE, PROSE, PROSE + "\n\n" + PROSE, LONG, "İK ſ ß é 日本語   🙂!! ??", "a" * 50_000, "\x00\x1c\x85 end.", "in <P> text", "<S", "-" * 17]
DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
OWN_NAMES = ["item_id", "rank", "score", "n", "id", "tf", "terms", "rid", "form", "stored", "output", "spans", "base_sha256", "_rid", "_raw", "term", "kind"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated and null ids, and columns named like the operators' own."""
    rows = [(None if i == 3 else i % 9, t, None, None, None) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, DOC_COLUMNS).withColumns({c: F.lit("mine") for c in OWN_NAMES})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def counted(rows):
    return Counter(tuple(r) for r in rows)


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(documents, items, k):
    """Every score of every item, by the formula."""
    docs = [(i, Counter(w), len(w)) for i, t in documents if (w := words(t))]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, tf, _ in docs for t in tf)
    out = Counter()
    for item, text in items:
        scores = []
        for i, tf, n in docs:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
                for t, times in Counter(words(text)).items()
                if t in tf
            )
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        for rank, (score, known, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, i if known else None, -score] += 1
    return out


@pytest.mark.parametrize("postings", [lexical.BLOCK_POSTINGS, 40])
def test_search_is_a_full_scan(spark, documents, odd, postings):
    items = [(1, PROSE), (2, "and AND and日本語 word3"), (3, ""), (4, None), (5, "nowhere2found"), (None, "fox the"), (1, "the the")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("mine")).withColumn("rid", F.lit("mine"))
    given = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert counted(lexical.search(odd, asked, block_postings=postings).collect()) == ranked(given, items, lexical.K)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    given = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = ranked(given, [tuple(r) for r in bench.select("item_id", "text").collect()], 3)
    assert counted(lexical.search(documents, bench, k=3, block_postings=postings).collect()) == want


def test_search_in_chunks_of_items(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = counted(lexical.op11(documents, bench).collect())
    assert counted(lexical.search(documents, bench, chunk_chars=3_000).collect()) == whole
    assert lexical.op11(documents, bench.limit(0)).count() == 0
    assert lexical.op11(documents.limit(0), bench).count() == 0
    assert lexical.op11(documents, bench).columns == lexical.op11(documents, bench.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_pieces_of_a_text_hold_its_terms(monkeypatch):
    whole = [t.encode() for t in words(LONG)]
    monkeypatch.setattr(lexical, "PIECE", 1000)
    assert sum(lexical.term_lists(LONG.encode()), []) == whole


def test_copies_tie_by_id_and_pruning_keeps_them():
    """Thousands of equal scores: the smallest ids win, whichever interval they stand in."""
    rnd = np.random.default_rng(5)
    n, v = 3000, 12
    sizes = np.full(n, 3)
    terms = np.concatenate([np.sort(rnd.choice(v, 3, replace=False)) for _ in range(n)]).astype(np.int32)
    tf = rnd.integers(1, 3, 3 * n).astype(np.int32)
    terms[: 3 * 2000], tf[: 3 * 2000] = np.tile([1, 4, 9], 2000), 2  # copies
    ids, norm, weight = rnd.permutation(n).astype(np.int64), np.full(n, 100), rnd.integers(1, 4000, v + 1)
    block = lexical.Block(ids, np.ones(n, bool), norm, sizes, terms, tf, weight)
    impact = weight[terms] * (1_000_000_000 * tf.astype(np.int64) // (1000 * tf + 1200))
    for asked in ([1, 4, 9], [1], [0, 2, 3, 5, 6, 7, 8, 10, 11]):
        top = lexical.Top(20)
        times = np.arange(1, len(asked) + 1)
        block.search(np.array(asked), times, top)
        score = np.where(terms[:, None] == np.array(asked)[None, :], impact[:, None] * times, 0).sum(axis=1).reshape(n, 3).sum(axis=1)
        want = sorted(zip(-score, ids))[:20]
        assert list(zip(-top.score, top.id)) == [w for w in want if w[0] < 0]


# --- personal data ---


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_base(text):
    """The patterns as they are written."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_spans_are_the_patterns():
    rnd = random.Random(8)
    texts = [t for t in ODD if t and len(t) < 10_000]
    texts += ["a@b@c.de.@x.y a.b@c.d@e.f", "1.2.3.4.5.6.7.8.9", "0300.2.3.4 256.1.1.1 0001.0.0.255", "+1 (555) 010-99 88. +12345678901234567", "4111 1111-1111 1111 4111111111111111"]
    texts += ["".join(rnd.choice(p) for _ in range(rnd.randint(0, 60))) for p in ("a@.b", "ab@.-c ", "0123456789. ", "+1234 ()-.", "49 -", "a@b.c+1 2-3") for _ in range(400)]
    for text in texts:
        assert disclosure.base_spans(text) == plain_base(text), text


def test_base_spans_take_one_pass():
    for text in ("a" * 400_000 + " a@b", "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "@a" * 200_000):
        disclosure.base_spans(text)


def disclosing(texts):
    """Terms and kinds by the definition, pair by pair."""
    term_places, both, contexts, of_entity, total = Counter(), Counter(), {}, Counter(), 0
    for text in texts:
        text = text or ""
        spans = plain_base(text)
        every = [(m.start(), m.end(), words(m[0])[0]) for m in TERM.finditer(text)]
        total += len(every)
        term_places.update(w for _, _, w in every)
        free = [(a, b, w) for a, b, w in every if not any(a < e and s < b for s, _, e in spans)]
        near = {}
        for s, kind, e in spans:
            value = text[s:e].lower() if kind < 2 else re.sub("[^0-9]", "", text[s:e])
            ahead = [i for i, (a, _, _) in enumerate(free) if a < s][-disclosure.WINDOW :]
            behind = [i for i, (a, _, _) in enumerate(free) if a >= e][: disclosure.WINDOW]
            context = tuple(free[i][2] for i in ahead + behind)
            for i in ahead + behind:
                if len(free[i][2]) > 1:
                    near.setdefault((kind, value, i), context)
        for (kind, value, i), context in near.items():
            pair = (kind, value), free[i][2]
            both[pair] += 1
            of_entity[kind, value] += 1
            contexts.setdefault(pair, set()).add(context)
    out = {}
    for (e, t), n in both.items():
        left, bits = -math.log2(n / term_places[t]), -math.log2(of_entity[e] / total)
        if len(contexts[e, t]) >= disclosure.SUPPORT and bits > 0 and (bits - left) / bits >= disclosure.SHARE and left <= disclosure.LEFT_GENERALISED:
            out[t] = min(out.get(t, 9), 4 if left <= disclosure.LEFT_REMOVED else 5)
    return out


def all_spans(text, kinds):
    spans = plain_base(text or "")
    own = [(m.start(), kinds[w], m.end()) for m in TERM.finditer(text or "") if (w := words(m[0])[0]) in kinds and not any(m.start() < e and s < m.end() for s, _, e in spans)]
    return ",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans + own))


def speaking():
    """Zorblatt stands by one address in different sentences, Quimby often, common words everywhere; copies of one passage."""
    rnd = random.Random(4)
    common = "the of and to in that is for was with on as by at from this have not are but".split()
    said = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    texts = [f"{said(6)} Zorblatt {said(2)} z.b@mail.example.com {said(9)}." for _ in range(5)]
    texts += [f"{said(5)} Quimby {said(1)} +1 (212) 555-0123 {said(8)}" for _ in range(4)] + [f"{said(9)} quimby {said(9)}" for _ in range(9)]
    texts += [f"Copied Vexley asks {'who'} v@w.example.org at once."] * 6
    texts += [f"{said(30)} ZORBLATT {said(5)}"] + [said(60) for _ in range(200)]
    return texts + [None, "", "z.b@mail.example.com", f"Zorblatt{LONG}"]


def test_disclosing_terms_by_definition(spark, documents, odd):
    texts = speaking()
    kinds = disclosing(texts)
    assert kinds == {"zorblatt": 4, "quimby": 5}
    mine = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("mine") for c in OWN_NAMES})
    for docs in (mine, odd, documents):
        given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        kinds = disclosing([t for _, t in given])
        want = Counter((i, all_spans(t, kinds), hashlib.sha256(all_spans(t, {}).encode()).hexdigest()) for i, t in given)
        assert counted(disclosure.op12(docs).select("doc_id", "spans", "base_sha256").collect()) == want


def test_sanitised_texts(spark):
    texts = speaking()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("mine"))
    clean = disclosure.sanitise(docs)
    assert clean.columns == docs.columns
    out = dict(clean.select("doc_id", "text").collect())
    assert out[len(texts) - 4] is None and out[len(texts) - 3] == ""
    assert not any(re.search(r"@mail|555-|(?i:\bzorblatt\b|\bquimby\b)", t or "") for t in out.values())
    assert out[0].count("[EMAIL]") == 1 and "[PHONE]" in out[5] and "[NAME]" in out[5] and "[WORD]" in out[9]
    assert all(a == b for i, (a, b) in enumerate(zip(texts, map(out.get, range(len(texts))))) if 24 < i < 224)


def test_a_full_filter_costs_rows_not_results(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(speaking())), "doc_id long, text string")
    want = counted(disclosure.op12(docs).collect())
    monkeypatch.setattr(disclosure.filter_bits, "__defaults__", (64,))
    assert counted(disclosure.op12(docs).collect()) == want


# --- infilling ---


def by_hand(key, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    hexed = hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


@pytest.mark.parametrize("size", [1, 7, infill.FRAME])
def test_frames_of_any_size_give_the_same_cuts(size):
    rnd = random.Random(size)
    texts = ["".join(rnd.choice(p) for _ in range(rnd.randint(0, 40))) for p in ("ab ", "é日🙂a", "<P<S<M>> a", "\r\n\tZ") for _ in range(60)]
    texts += [t for t in ODD if t and (size > 1 or len(t) < 1000)]
    compressor = zstandard.ZstdCompressor()
    forms = Counter()
    for key, text in enumerate(texts):
        store = infill.stored(text.encode(), compressor, size)
        n, form, prefix, middle, out = by_hand(key, text)
        got = infill.transformed(key, store, compressor)
        assert (store["n_units"], store["n_chars"]) == (n, len(text))
        assert (*got[:3], b"".join(infill.opened(got[3])).decode()) == (form, prefix, middle, out)
        assert b"".join(infill.restored(form, got[3], compressor)).decode() == text
        # marks may be cut by the frames of an output written elsewhere
        for step in (1, 2, 1000):
            recut = [compressor.compress(out.encode()[i : i + step]) for i in range(0, len(out.encode()), step)]
            if len(recut) < 2000:
                assert b"".join(infill.restored(form, recut, compressor)).decode() == text
        forms[form] += 1
    assert set(forms) == {"plain", "psm", "spm"}


def test_infill_through_a_written_store(spark, odd, documents, tmp_path):
    for k, docs in enumerate((odd, documents)):
        want = Counter()
        for key, text in [tuple(r) for r in docs.select("doc_id", "text").collect()]:
            n, form, prefix, middle, out = by_hand(key, text or "")
            want[key, n, form, prefix, middle, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
        assert counted(infill.op13(docs).collect()) == want
        infill.store(docs, keep=["doc_id"]).write.parquet(f"{tmp_path}/{k}")
        back = infill.restore(infill.infill(spark.read.parquet(f"{tmp_path}/{k}")))
        assert counted(back.select("doc_id", "text").collect()) == counted((r["doc_id"], r["text"] or "") for r in docs.collect())


def test_no_rows(spark):
    none = spark.createDataFrame([], DOC_COLUMNS)
    assert infill.op13(none).count() == disclosure.op12(none).count() == disclosure.sanitise(none).count() == 0


# --- names that clash ---


def test_clashing_columns_are_replaced(odd):
    docs = odd.select("doc_id", "text").withColumns({c: F.lit("mine") for c in ("ids", "N_tokens", "spans", "n_hex", "fp", "fingerprint", "n_bytes", "over_limit", "decoded")})
    for made, own in (
        (bpe.encode(docs), "ids"),
        (bpe.round_trip(docs), "n_tokens"),
        (secret_scan.with_spans(docs), "spans"),
        (token_counts.with_token_counts(docs), "n_bytes"),
        (simhash.with_fingerprint(docs), None),
        (disclosure.with_spans(docs), "spans"),
        (infill.infill(infill.store(docs)), None),
    ):
        assert made.count() == len(ODD) and len({c.lower() for c in made.columns}) == len(made.columns)
        if own:
            assert made.where(F.col(own).cast("string") == "mine").count() == 0
