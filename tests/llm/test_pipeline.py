"""The pipeline against the stages done by hand."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, mixing, quality, secret_scan, similar_sets
from tests.llm.test_operators import DOC_COLUMNS, PROSE, wrapped_key

SF = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_heads(texts):
    """The smallest id of each group of texts linked at a Jaccard similarity of 0.8 on five words; all pairs compared."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    todo, heads = set(sets), set()
    while todo:
        front = [min(todo)]
        todo -= set(front)
        heads |= set(front)
        while front:
            s = sets[front.pop()]
            near = {j for j in todo if s == sets[j] or 5 * len(s & sets[j]) >= 4 * len(s | sets[j])}
            todo -= near
            front += near
    return heads


def by_hand(spark, folder):
    judged = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).where("kept").select("doc_id", "source", "clean").collect()
    heads = plain_heads({r["doc_id"]: r["clean"] for r in judged})
    novelty = secret_scan.Novelty()
    rows = {}
    for r in judged:
        if r["doc_id"] in heads:
            rows[r["doc_id"]] = (r["source"], secret_scan.redacted(r["clean"], secret_scan.scan(r["clean"], novelty)[1], "[SECRET]"))
    frame = spark.createDataFrame([(d, t, s) for d, (s, t) in rows.items()], "doc_id long, text string, source string")
    epochs = {r["doc_id"]: r["epochs"] for r in mixing.mix(frame).collect()}
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(file.read()), special_tokens={})
    want = Counter()
    for doc, (_, text) in rows.items():
        if epochs[doc]:
            want[doc, len(library.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest()] = epochs[doc]
    return want


def test_pipeline_by_hand(spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == by_hand(spark, SF)


def test_pipeline_on_odd_rows(spark, tmp_path):
    text = "The quick brown fox jumps over the lazy dog and runs into the deep green wood again."
    rows = [(1, text, "en", None, 1), (None, text, None, "a", None), (1, text, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0)]
    for name, data in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(data, DOC_COLUMNS).withColumns({c: F.lit("x") for c in ("n_tokens_", "fp", "key", "size", "_fp", "clean")})
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        stages = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            stages = stage(spark, stages, "")
            assert stages.columns == docs.columns
        assert len(corpus_pipeline.run(spark, f"{tmp_path}/{name}").select("doc_id").distinct().collect()) == (1 if data else 0)


def test_no_line_of_a_wrapped_key_is_left(spark):
    lines, key = wrapped_key(random.Random(9), tail="aZ3=")
    docs = spark.createDataFrame([(1, f"{PROSE}\n{key}\n{PROSE}", "en", "a", 1)], DOC_COLUMNS)
    (row,) = corpus_pipeline.secret_scans(spark, docs, "").collect()
    assert not any(line in row["text"] for line in lines)
    assert row["n_chars"] == len(row["text"]) < 500


def changed(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.random()}"
    return out


def test_near_copies_go_and_false_ones_stay(spark):
    rnd = random.Random(17)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=60)
    texts = []
    for k in range(6):  # copies with one to twelve words of 150 changed: on both sides of 0.8
        base = rnd.choices(vocabulary, k=150)
        texts += [" ".join(base), " ".join(base).upper()] + [" ".join(changed(rnd, base, n)) for n in (1, 2, 3, 4, 5, 8, 12)]
    base = rnd.choices(vocabulary, k=150)
    texts += [" ".join(changed(rnd, base, rnd.choice((1, 1, 2, 3)))) for _ in range(80)]  # a large group without its base
    texts += [" ".join(passage + rnd.choices(vocabulary, k=40)) for _ in range(40)]  # a passage shared, texts different
    texts += ["", None, "one two", "one  two", "one two three", "the same five words here", "the same five words there"]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOC_COLUMNS)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == plain_heads(dict(enumerate(texts)))
    assert len(got) < len(texts) - 80


def test_only_texts_within_reach_are_held_as_whole_sets(spark, monkeypatch):
    rnd = random.Random(23)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = " ".join(rnd.choices(vocabulary, k=5))
    texts = [shared + " " + " ".join(rnd.choices(vocabulary, k=int(10 * 1.5**i))) for i in range(12)]  # one shingle in common, lengths too far apart
    base = rnd.choices(vocabulary, k=120)
    texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    named = []
    whole = similar_sets.whole_sets
    monkeypatch.setattr(similar_sets, "whole_sets", lambda t, sids, words: (named.append(sids.count()), whole(t, sids, words))[1])
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOC_COLUMNS)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == plain_heads(dict(enumerate(texts))) and named == [2]


def test_no_posting_of_a_similar_pair_is_left_out(spark):
    rnd = random.Random(29)
    texts = []
    for _ in range(40):
        base = rnd.choices([f"w{i}" for i in range(60)], k=rnd.randint(8, 60))
        texts += [" ".join(base)] + [" ".join(base[: len(base) - rnd.randint(0, len(base) // 4)] + rnd.choices("xyz", k=rnd.randint(0, 3))) for _ in range(4)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = {(r["h"], r["sid"]) for r in similar_sets.with_partners(similar_sets.postings(df)).collect()}
    sets = {similar_sets.sequence_hash(t): plain_shingles(t) for t in texts}
    met = {}
    for h, sid in rows:
        met.setdefault(h, set()).add(sid)
    together = {(a, b) for group in met.values() for a in group for b in group if a < b}
    similar = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert similar and similar <= together
