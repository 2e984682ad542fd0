"""Exact and near deduplication against plain Python."""

import hashlib
import random
import re

import pytest
import xxhash
from conftest_helpers import SCHEMA, documents, plain_words

from pyspark.sql import functions as F

from trailframe.llm.common import without_listed
from trailframe.llm.components import components
from trailframe.llm.exact_dedup import exact_dedup, keep_first
from trailframe.llm.simhash import near_dedup, one_per_group
from trailframe.operators.skew import marked_by_bitmap


def plain_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, len(text or "")))
    out = []
    for plain, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        sha, stays = hashlib.sha256(plain.encode()).hexdigest(), True
        for m in members:
            kept = stays and m == best
            stays = stays and not kept
            out.append((m[0], best[0], len(members), kept, sha))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("bucket_rows", [256, 1])
def test_exact_dedup(spark, odd_documents, bucket_rows):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(7))) for _ in range(300)]
    random_documents = documents(spark, texts)
    for frame in (odd_documents, random_documents):
        rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
        got = [tuple(r)[:5] for r in exact_dedup(frame, bucket_rows).collect()]
        assert sorted(got, key=key) == sorted(plain_exact(rows), key=key)
        kept = keep_first(frame)
        assert kept.columns == frame.columns
        assert sorted(key((r["doc_id"],)) for r in kept.collect()) == sorted(
            key((r[0],)) for r in plain_exact(rows) if r[3]
        )


def test_exact_dedup_of_nothing(no_documents):
    assert exact_dedup(no_documents).collect() == [] and keep_first(no_documents).collect() == []


def plain_fingerprint(text):
    words = plain_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    smallest = {}
    for g, (doc_id, _) in zip(group, rows):
        smallest[g] = min([d for d in (smallest.get(g), doc_id) if d is not None], default=None)
    return [(d, format(p, "016x"), smallest[g]) for (d, _), p, g in zip(rows, prints, group)]


@pytest.mark.parametrize("options", [{}, {"key_bits": 10, "block_rows": 25}, {"key_bits": 6, "block_rows": 3}])
def test_near_dedup(spark, odd_documents, options):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(500)}" for _ in range(200)] for _ in range(6)]
    texts = []
    for words in base:
        for _ in range(12):
            changed = list(words)
            for _ in range(rng.randrange(6)):
                changed[rng.randrange(len(changed))] = f"W{rng.randrange(500)}"
            texts.append(" ".join(changed))
    for frame in (odd_documents, documents(spark, texts)):
        rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
        wanted = plain_components(rows)
        got = [tuple(r) for r in near_dedup(frame, **options).collect()]
        assert sorted(got, key=key) == sorted(wanted, key=key)


def test_one_document_of_each_group_stays(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    heads = {r[2] for r in plain_components(rows)}
    got = one_per_group(odd_documents)
    assert got.columns == odd_documents.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(heads) and set(ids) == heads
    assert one_per_group(no_documents).collect() == [] and near_dedup(no_documents).collect() == []


def test_unlike_texts_under_one_id_or_none_all_stay(spark):
    rng = random.Random(3)
    unlike = [" ".join(f"u{rng.randrange(9000)}" for _ in range(80)) for _ in range(6)]
    ids = [None, None, None, 5, 5, 3]
    # The longer text of id 5 is a copy of the head 3; a copy of a null row and a full repetition go.
    rows = list(zip(ids, unlike)) + [(5, unlike[5]), (None, unlike[0]), (3, unlike[5])]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in one_per_group(frame).collect()]
    assert sorted(got, key=key) == sorted(zip(ids, unlike), key=key)


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 101 + i) for i in range(30)] + [(7, 7)]
    roots = {r["v"]: r["root"] for r in components(spark.createDataFrame(chain + hub, "u bigint, v bigint")).collect()}
    assert len({roots[v] for v in range(41)}) == 1 and len({roots[v] for v in range(100, 131)}) == 1
    assert roots[0] != roots[100] and len(roots) == 72


def test_no_exchange_carries_texts_of_rows_that_stay(spark):
    """Only listed rows, and the few that share a bit, leave their place to be compared."""
    frame = documents(spark, [f"text {i}" for i in range(400)])
    listed = spark.createDataFrame([(i, f"text {i}") for i in range(0, 400, 4)], "i bigint, t string")
    match = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text") == F.col("t"))
    left = without_listed(frame, listed, match, [F.col("doc_id"), F.col("text")], [F.col("i"), F.col("t")])
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(400) if i % 4]
    marked = marked_by_bitmap(frame, listed, [F.col("doc_id"), F.col("text")], [F.col("i"), F.col("t")], "m")
    assert 100 <= marked.where("m").count() < 110
