"""Quality rules, sharding and mixing against plain Python, and the SQL twins."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from compare import differences
from conftest_helpers import SCHEMA, documents, plain_words

from trailframe.llm import mixing, quality, sharding
from trailframe.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), ORACLES[name], SF_DIR) is None


def plain_quality(rows, limit):
    """``rows``: (doc_id, text, source)."""
    def normal(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()

    texts = {(s, t or "") for _, t, s in rows}
    lines_of = {st: [x for x in map(normal, st[1].split("\n")) if x] for st in texts}
    holders, documents_of = {}, {}
    for st, lines in lines_of.items():
        for line in lines:
            holders.setdefault((st[0], line), set()).add(st)
    shingles, found = {}, Counter()
    for st, lines in lines_of.items():
        words = plain_words(st[1])
        if 100 * sum(len(x.split(" ")) for x in lines if len(holders[st[0], x]) > limit) > 70 * len(words):
            shingles[st] = {" ".join(words[i : i + 5]).lower() for i in range(len(words) - 4)}
            found.update((st[0], w) for w in shingles[st])
    names = {}
    for (source, text), own in shingles.items():
        shared = [w for w in own if found[source, w] > 1]
        rare = [w for w in shared if found[source, w] <= limit]
        common = [w for w in shared if found[source, w] > limit]
        if own and 9 * len(shared) >= 8 * len(own):
            among = rare if 9 * len(rare) >= len(own) else common
            names[source, text] = min(hashlib.md5(w.encode()).hexdigest()[:15] for w in among)
    for where, of in holders.items():
        documents_of[where] = len({names.get(st, st) for st in of})
    out = []
    for doc_id, text, source in rows:
        text = text or ""
        words = plain_words(text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if plain_words(x)]
        lost = sum(
            len(normal(x).split(" ")) for x in text.split("\n") if normal(x) and documents_of[source, normal(x)] > limit
        )
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                    len(lines) - len(set(lines)), len(covered), failed,
                    not failed and 100 * lost <= 70 * len(words), lost))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def boilerplate(spark):
    rng = random.Random(5)
    common = "all rights reserved by the owner of this page and nobody else at all in this world of ours"
    texts = []
    for _ in range(40):
        own = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, 30))) for _ in range(4)]
        own.insert(rng.randrange(5), common)
        if rng.random() < 0.5:
            own += [f"{common} {k}" for k in (1, 2, 3)] * rng.randrange(1, 3)
        texts.append("\n".join(own))
    texts += ["a b c " * 40, "# x | y <z> " + " ".join(f"v{i}" for i in range(60)), "one\n\none\n two"]
    return documents(spark, texts)


def test_quality(spark, odd_documents):
    for frame in (odd_documents, boilerplate(spark)):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]
        for limit in (2, 10):
            wanted = plain_quality(rows, limit)
            assert sorted(map(tuple, quality.quality(frame, limit).collect()), key=key) == sorted(wanted, key=key)
        kept = quality.kept_documents(frame, 2)
        assert kept.columns == frame.columns
        assert sorted(key((r["doc_id"],)) for r in kept.collect()) == sorted(
            key((r[0],)) for r in plain_quality(rows, 2) if r[7]
        )


def test_many_repeated_windows_take_the_sorted_way(spark):
    rng = random.Random(6)
    phrases = [" ".join(f"p{rng.randrange(300)}" for _ in range(6)) for _ in range(60)]
    frame = documents(spark, [" x ".join(rng.choices(phrases, k=90))])
    row = quality.quality(frame).first()
    assert tuple(row) == plain_quality([(0, frame.first()["text"], "s")], 25)[0]


def agrees_with_plain(frame, limit=25):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]
    got = quality.quality(frame, limit).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_quality(rows, limit), key=key)
    kept = sorted(r["doc_id"] for r in got if r["kept"])
    assert sorted(r["doc_id"] for r in quality.kept_documents(frame, limit).collect()) == kept
    return got


def with_footer(n, own_copies=1):
    footer = "\n".join(" ".join(f"f{i}w{j}" for j in range(9)) for i in range(10))
    for i in range(n):
        for k in range(own_copies):
            yield " ".join(f"d{i}w{j}" for j in range(24)) + "\n" + footer + f"\ncopy{k}" * (own_copies > 1)


@pytest.mark.parametrize("own_copies", [1, 2])
def test_every_line_of_a_footer_is_charged(spark, own_copies):
    got = agrees_with_plain(documents(spark, list(with_footer(200, own_copies))))
    assert {r["lost_words"] for r in got} == {90 + (own_copies > 1)} and not any(r["kept"] for r in got)


@pytest.mark.parametrize("n", [26, 28, 50, 400])
def test_near_copies_stay(spark, n):
    rng = random.Random(n)
    words = [f"w{j}" for j in range(240)]
    texts = []
    for i in range(n):
        mine = list(words)
        for at in rng.sample(range(240), 3):
            mine[at] = f"e{i}x{at}"
        texts.append("\n".join(" ".join(mine[k : k + 12]) for k in range(0, 240, 12)))
    got = agrees_with_plain(documents(spark, texts))
    assert len(got) == n and all(r["kept"] for r in got)


def test_copies_do_not_make_a_line_frequent(spark):
    text = "\n".join(" ".join(f"l{i}w{j}" for j in range(20)) for i in range(4))
    frame = documents(spark, [text] * 50)
    assert {r["kept"] for r in quality.quality(frame, 5).collect()} == {True}


def test_one_text_makes_no_line_frequent(spark):
    refrain = " ".join(f"r{i}" for i in range(45))
    song = "\n".join(f"{refrain}\n" + " ".join(f"v{i}x{k}" for k in range(8)) for i in range(30))
    frame = documents(spark, [song, refrain + "\n" + " ".join(f"o{i}" for i in range(10))])
    # The song itself fails by its repeated windows; the text that only shares the refrain stays.
    assert [r["doc_id"] for r in quality.kept_documents(frame).collect()] == [1]
    got = {r["doc_id"]: r["text"] for r in quality.without_frequent_lines(frame).collect()}
    assert got == {r["doc_id"]: r["text"] for r in frame.collect()}


def test_frequent_lines_are_removed(spark):
    frame = documents(spark, [f"own {i}\nsame line\nmore {i}" for i in range(8)])
    got = {r["doc_id"]: r["text"] for r in quality.without_frequent_lines(frame, 4).collect()}
    assert got == {i: f"own {i}\nmore {i}" for i in range(8)}


def check_shards(rows, got, shards=16):
    size = {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows}
    assert len(got) == len(rows) and {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == size
    assert {r["law"] for r in got} <= {"bytes"} and all(r["grown_shard"] is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by.get(k, [])) - total / shards) <= 2 * largest


@pytest.mark.parametrize("ranges", [2048, 4])
def test_shards(spark, odd_documents, ranges):
    rng = random.Random(7)
    texts = ["x" * rng.randrange(200) for _ in range(700)] + ["copy " * 20] * 400
    for frame in (odd_documents, documents(spark, texts)):
        rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
        check_shards(rows, sharding.assign_shards(frame, ranges=ranges).collect())


def test_shards_agree_between_runs(spark, no_documents):
    frame = documents(spark, [f"text {i}" for i in range(300)])
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(frame).collect()}
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(frame.repartition(7)).collect()}
    assert first == again and sharding.assign_shards(no_documents).collect() == []


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in order if s not in full]
        for s in open_:
            target[s] = left * weight[s] / sum(weight[o] for o in open_)
        over = [s for s in open_ if target[s] > 2 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            full.add(s)


def test_mix(spark, odd_documents):
    rng = random.Random(8)
    rows = [
        (i, "w " * rng.randrange(1, 60), "en", rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]), 1)
        for i in range(800)
    ]
    for frame in (odd_documents, spark.createDataFrame(rows, SCHEMA)):
        source = {r["doc_id"]: r["source"] for r in frame.collect()}
        sizes, got = Counter(), mixing.mix_sources(frame).collect()
        for r in frame.collect():
            sizes[r["source"]] += len(plain_words(r["text"]))
        target, taken = plain_targets(dict(sizes)), Counter()
        assert len(got) == frame.count()
        for r in got:
            s = source[r["doc_id"]] if r["doc_id"] is not None else None
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            if r["doc_id"] is not None:
                assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s]
                taken[s] += r["taken"]
        if frame is not odd_documents:
            for s, wanted in target.items():
                assert abs(taken[s] - wanted) <= 60
        copies = mixing.mixed_documents(frame)
        assert copies.columns == frame.columns
        again = Counter(r["doc_id"] for r in copies.collect())
        wanted = Counter()
        for r in got:
            wanted[r["doc_id"]] += r["copies"]
        assert again == +wanted


def test_documents_without_an_id_meet_the_target(spark):
    rng = random.Random(3)
    rows = [(None if i % 2 else 5, f"{i} " + "w " * rng.randrange(40), "en", "ab"[i % 3 == 0], 1) for i in range(900)]
    taken, target = Counter(), {}
    for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect():
        target[r["source_size"]] = r["target"]
        taken[r["source_size"]] += r["taken"]
    assert len(target) == 2 and all(abs(taken[s] - target[s]) <= 41 for s in target)


def test_mix_of_nothing(no_documents):
    assert mixing.mix_sources(no_documents).collect() == [] and mixing.mixed_documents(no_documents).collect() == []
