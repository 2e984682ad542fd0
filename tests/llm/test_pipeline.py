"""The whole pipeline against plain Python on the smallest tables."""

import hashlib
from collections import Counter

import corpus_pipeline
from conftest_helpers import plain_words
from test_dedup import plain_components, plain_exact
from test_tables import plain_quality, plain_targets
from test_tokens import crc, ids_of

SF_DIR = "/root/testdata/sf0.001"


def plain_copies(rows):
    """How often each of ``(doc_id, text, source)`` is taken."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(plain_words(text))
    copies = {}
    for source, target in plain_targets(dict(sizes)).items():
        base = int(target >= sizes[source])
        rest = target - base * sizes[source]
        draws = sorted(
            (int(hashlib.md5(f"{d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16), d, len(plain_words(t)))
            for d, t, s in rows
            if s == source
        )
        total, open_ = 0, True
        for _, doc_id, n in draws:
            passes = total + n > rest
            if open_ and passes:
                open_ = False
                nearer = total + n - rest < rest - total
                copies[doc_id] = base + int(nearer)
            else:
                copies[doc_id] = base + int(open_)
            total += n
    return copies


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    good = {r[0] for r in plain_quality(rows, 25) if r[7]}
    rows = [r for r in rows if r[0] in good]
    single = {r[0] for r in plain_exact([r[:2] for r in rows]) if r[3]}
    rows = [r for r in rows if r[0] in single]
    heads = {r[2] for r in plain_components([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in heads]
    copies = plain_copies(rows)
    wanted = Counter()
    for doc_id, text, _ in rows:
        ids = ids_of(text, 1)
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            wanted[doc_id, s, len(part), crc(part), len(ids)] += copies[doc_id]
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(tuple(r)[:5] for r in got) == +wanted
    filled = Counter()
    for r in got:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def test_stages_keep_the_columns(spark, odd_documents, no_documents):
    for frame in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SF_DIR).columns == frame.columns
        corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR).collect()
