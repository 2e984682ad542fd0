"""Token operators against the libraries, language and page text on small cases."""

import io
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_helpers import SCHEMA, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailframe.llm import html_text, language_id, packing, token_binary, token_counts
from trailframe.llm.encoding import Encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(9)
    made = ["".join(rng.choice("ab' \n\t\x1c\x85  é.1s<|▁日👍") for _ in range(rng.randrange(60))) for _ in range(800)]
    return made + ["", " ", "x" * 3000, "ab" * 2000, " " * 50 + "x", "a<|endoftext|> b", "one\ntwo three\nfour", "</s><unk>"]


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(BPE)
    wanted = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(odd_texts(), add_special_tokens=False)]
    assert list(Encoder(BPE).encode(odd_texts())) == wanted


def test_the_library_gets_few_characters_at_once():
    """It holds some hundred bytes per token, so a batch of new words must not go to it whole."""
    encoder = Encoder(BPE)
    library, given = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            given.append(sum(map(len, texts)))
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    text = " ".join(f"w{k * 7919 % 1_000_003}x" for k in range(150_000))
    wanted = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert list(encoder.encode([text])) == [wanted]
    assert max(given) <= 1 << 16


def test_counts_equal_the_library(spark, odd_documents, no_documents):
    counter = token_counts.MergeCounter.of(PIECES)
    assert counter.texts(odd_texts()) == [len(x) for x in counter.library.encode(odd_texts())]
    got = token_counts.token_counts(odd_documents, PIECES).collect()
    rows = odd_documents.select("doc_id", "text").collect()
    wanted = [(r["doc_id"], len((r["text"] or "").encode()), len(counter.library.encode(r["text"] or ""))) for r in rows]
    assert [tuple(r) for r in got] == [(*w, w[2] > 4096) for w in wanted]
    assert token_counts.token_counts(no_documents, PIECES).collect() == []


@pytest.mark.parametrize("kind", ["letters", "base64", "mixed"])
def test_counts_of_long_texts_without_blanks(kind):
    rng = random.Random(4)
    alphabet = {"letters": [chr(c) for c in range(0x4E00, 0x9FFF)], "base64": list(string.ascii_letters + string.digits + "+/")}
    alphabet = alphabet.get(kind) or [*"aeinrst ", "▁", "日", "\U0001f600", "th", "ing", "\x00", "é"]
    text = "".join(rng.choice(alphabet) for _ in range(2_000_000 if kind == "letters" else 500_000))
    counter = token_counts.MergeCounter(PIECES)
    started = time.monotonic()
    assert counter.texts([text, text[:100_000]]) == [len(counter.library.encode(t)) for t in (text, text[:100_000])]
    assert time.monotonic() - started < 60
    # Long pre-tokens are not kept, whatever their number.
    assert max(map(len, counter.seen)) <= token_counts.LONG_WORD


def ids_of(text, end):
    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("bits", [False, True])
def test_planes_come_back(bits):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (token_binary.from_planes(token_binary.to_planes(ids, bits), n, bits) == ids).all()
    out = io.BytesIO()
    writer = token_binary.PlaneWriter(out, bits, block_ids=64)
    texts = [(None, []), (5, list(range(300))), (-1, [7]), (6, [1 << 31] * 63)]
    for doc_id, ids in texts:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    writer.close()

    class Source:
        def size(self):
            return len(out.getvalue())

        def read_at(self, n, at):
            return out.getvalue()[at : at + n]

    assert [(d, i.tolist()) for d, i in token_binary.PlaneReader(Source()).documents()] == texts


def test_token_files(spark, odd_documents, no_documents):
    got = [tuple(r) for r in token_binary.token_files(odd_documents, BPE).collect()]
    rows = odd_documents.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("m")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["m"]))
    wanted, start = [], 0
    for r in rows:
        ids = ids_of(r["text"], 2)
        wanted.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == wanted
    assert token_binary.token_files(no_documents, BPE).collect() == []


def test_fullest_is_the_best_fill():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        capacity = rng.randrange(1, 60)
        counts = {x: lengths.count(x) for x in lengths}
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= capacity}
        used = packing.fullest(counts, capacity)
        assert all(n <= counts[x] for x, n in used.items()) and sum(x * n for x, n in used.items()) == max(sums)


@pytest.mark.parametrize("group_pieces", [20_000, 3])
def test_pack(spark, odd_documents, no_documents, group_pieces):
    got = packing.pack(odd_documents, BPE, window=64, group_pieces=group_pieces).collect()
    rows = odd_documents.select("doc_id", "text").collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id in {r["doc_id"] for r in rows}:
        wanted = []
        for r in rows:
            if r["doc_id"] == doc_id:
                ids = ids_of(r["text"], 1)
                wanted += [(s, len(ids[s : s + 64]), crc(ids[s : s + 64]), len(ids)) for s in range(0, len(ids), 64)]
        found = [(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc_id]]
        assert sorted(found) == sorted(wanted)
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(no_documents, BPE).collect() == []


def test_packing_leaves_little_room():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 2048, 5000))
    sequence, _ = packing.place(lengths, 2048)
    assert len(np.unique(sequence)) <= lengths.sum() / 2048 * 1.01 + 1


def test_language(spark, odd_documents, no_documents):
    rng = random.Random(6)
    parts = {"en": ["th", "he", "ing", "er"], "de": ["sch", "ei", "ung", "zu"], "xx": ["qa", "wo", "ka", "io"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30))
        rows.append((i, text, lang, None, 1))
    got = language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in got if r["held_out"])
    odd = language_id.identify(odd_documents).collect()
    assert len(odd) == odd_documents.count()
    by = {r["doc_id"]: r for r in odd if r["doc_id"] is not None}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (3, 4, 5, 8))
    assert by[7]["lang_pred"] != "und"
    assert language_id.identify(no_documents).collect() == []


def plain_bundle(profiles, text):
    """The sum over a Counter of 3-grams."""
    shown = "".join(c if c.isalpha() else "\0" for c in "\0" + text.lower() + "\0")
    shown = re.sub("\0+", "\0", shown)
    total = np.zeros(profiles.dimensions)
    for gram, n in Counter(shown[i : i + 3] for i in range(len(shown) - 2)).items():
        a, b, c = (profiles.vector(ord(x)).astype(int) for x in gram)
        total += n * np.roll(a, 2) * np.roll(b, 1) * c
    return total


@pytest.mark.parametrize("chars, kinds", [(1 << 19, 16_000), (37, 11), (1, 1)])
def test_bundles_in_pieces_and_slices(monkeypatch, chars, kinds):
    monkeypatch.setattr(language_id, "_BATCH_CHARS", chars)
    monkeypatch.setattr(language_id, "_SLICE_KINDS", kinds)
    rng = random.Random(9)
    texts = ["", "a", "12 3", "ab  c" * 9, " ,. " * 30 + "ab", " " * 99 + "q" + " " * 60, "Ünïcode 語言 ΣΑΣ mixed"]
    texts += ["".join(rng.choices("abcde ,.\n", k=150)) for _ in range(5)]
    profiles = language_id.Profiles(64)
    got = np.zeros((len(texts), 64))
    for pieces, owners in language_id._batched(iter(texts)):
        own, row = np.unique(owners, return_inverse=True)
        got[own] += profiles.bundles(pieces, row, len(own))[1]
    assert (got == np.stack([plain_bundle(profiles, t) for t in texts])).all()


def test_language_of_a_long_text_with_many_letters(spark):
    rng = random.Random(10)
    rare = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    rows = [(1, "plain words " * 50, "en", "s", 1), (3, rare(2_000_000), "zh", "s", 1)]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert learned == rows
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, SCHEMA), 64).collect()}
    assert got == {1: "en", 3: "zh"}


def test_vectors_are_bound_by_place():
    profiles = language_id.Profiles(64)
    _, counts, vectors = profiles.grams(["ab"])
    gap, a, b = profiles.vector(0), profiles.vector(ord("a")), profiles.vector(ord("b"))
    wanted = np.roll(gap, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * gap
    assert (counts @ vectors == wanted).all()


PAGES = {
    "": "",
    "<p>a<p>b</p>c": "a b c",
    "foo<b>bar</b> baz": "foobar baz",
    "<div class='ad top'>x</div><p>y &amp; z&nbsp;w</p>": "y & z w",
    "<article><p>one<section id='comments'>no</section>two</article>out": "one two",
    "<script>var a='</p>'</script>t<!-- c -->u": "tu",
    "<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>": "a b 1 2 3",
    "<article><header><h1>T</h1></header>x<footer>f</footer></article>": "T x",
    "<body class='has-sidebar'><header>h</header><nav>n</nav><p title='a>b'>q</p><form>f</form>": "q",
    "a < b &lt;i&gt; c": "a < b <i> c",
}


def test_main_text(spark, no_documents):
    schema = "page_id bigint, url string, html string, host string"
    rows = [(i, None, html, "x") for i, html in enumerate(PAGES)] + [(None, "http://h/", None, None)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(spark.createDataFrame(rows, schema)).collect()}
    wanted = {i: (text, len(text)) for i, text in enumerate(PAGES.values())} | {None: ("", 0)}
    assert got == wanted
    assert html_text.main_text(spark.createDataFrame([], schema)).collect() == []


def test_site_templates_go(spark):
    page = "<div><p>Welcome to the shop</p></div><div><p>text {}</p></div><p>Shared by two</p>"
    rows = [(i, f"https://user@Shop.example:80/{i}", page.format(i)) for i in range(9)]
    # Copies of one page do not make its text a template.
    rows += [(100 + i, "http://copies.example/", "<p>only text</p>") for i in range(9)]
    rows += [(200, "http://other.example/", page.format(0))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    assert got == {
        **{i: f"text {i}" for i in range(9)},
        **{100 + i: "only text" for i in range(9)},
        200: "Welcome to the shop text 0 Shared by two",
    }


def main_texts(spark, pages):
    """Texts of ``pages`` on one host, in order."""
    rows = [(i, "http://one.example/", html) for i, html in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()}
    return [got[i] for i in range(len(rows))]


def test_templates_with_children_go_whole(spark):
    page = "<div>Call us: <b>123</b> any time</div><p>Share via <a>mail</a> or post</p><ul>In <li>x<p>y</p></ul><p>own {}</p>"
    assert main_texts(spark, [page.format(i) for i in range(9)]) == [f"own {i}" for i in range(9)]


def test_recurring_parts_of_articles_stay(spark):
    own = "<h2>Summary</h2><p><b>Note:</b> text {0} is <i>not</i> <a>here</a></p><ul><li>Salt<li>n{0}</ul>"
    table = "<table><tr><th>Name<td>Yes<td>{0}</table><p>Yes</p>"
    legal = "<p>All rights to this text are with the people who wrote it</p>"
    body = "<article>" + own + table + legal + "</article>"
    wanted = ["Summary Note: text {0} is not here Salt n{0} Name Yes {0} Yes".format(i) for i in range(9)]
    assert main_texts(spark, [body.format(i) for i in range(9)]) == wanted
    # The same without an article element.
    assert main_texts(spark, [(own + table + legal).format(i) for i in range(9)]) == wanted


def test_a_sections_menu_goes(spark):
    menu = "<div>" + " ".join(f"<a>entry{k}</a>" for k in range(12)) + "</div>"
    pages = [(menu if i % 4 == 0 else "") + f"<p>own text of {i}</p>" for i in range(240)]
    assert main_texts(spark, pages) == [f"own text of {i}" for i in range(240)]


def test_slots_with_differing_texts_go_without_the_lists(spark):
    page = (
        "<title>t</title><nav><ul><li><a>go {0}</a><li><a>to {1}</a></ul></nav><div class='x{0}'>Buy {1} now {0}</div>"
        "<article><h1>Title {0}</h1><div class='lead'>Lead {0}</div><p>" + STORY + "{0}</p></article><footer>By {1}</footer>"
    )
    rows = [(i, "http://one.example/", page.format(i, 7 * i)) for i in range(9)]
    rows.append((9, "http://few.example/", page.format(9, 63)))
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame, lists=False).collect()}
    wanted = {i: f"Title {i} Lead {i} {STORY}{i}" for i in range(10)}
    # One page of a host is no evidence; there the lists decide.
    assert got == {**wanted, 9: f"go 9 to 63 Buy 63 now 9 {wanted[9]} By 63"}
    assert {r["page_id"]: r["text"] for r in html_text.main_text(frame).collect()} == wanted


def test_a_slot_that_holds_the_page_stays(spark):
    # A page of links, an article without an article element, and a short text in a named block.
    links = "<div class='list'>" + "".join(f"<a>entry{{0}} {k}</a> " for k in range(9)) + "</div>"
    blocks = "<div class='lead'>Lead {0}</div><div class='text'>" + STORY + "{0}</div>"
    wanted = [" ".join(f"entry{i} {k}" for k in range(9)) for i in range(9)]
    assert main_texts(spark, [links.format(i) for i in range(9)]) == wanted
    assert main_texts(spark, [blocks.format(i) for i in range(9)]) == [f"Lead {i} {STORY}{i}" for i in range(9)]


STORY = "A long story of many words is told here for all who read it. " * 4


@pytest.mark.parametrize(
    "html",
    [
        "<article class='post comments-open'>{}</article>",
        "<div class='content with-sidebar'>{}</div>",
        "<div id='no-sidebar'>{}</div>",
        "<p class='social-science'>{}</p>",
        "<div class='search-results-item'>{}</div><div class='product-notice'>{}</div>",
        "<div class='search'>{}<p class='share-buttons'>no</p></div><div class='top-nav'>no</div>",
        "<div class='comment'>{}</div><div class='comment'>{}</div>",
        "<form action='/'>{}</form>",
        "<main>{}</main><div>out</div>",
        "<body><article class='cookie'>{}</article><div id='cookie-banner'>no</div></body>",
    ],
)
def test_marks_do_not_drop_articles(html):
    assert html_text.Page().read(html.replace("{}", STORY)) == " ".join([STORY.strip()] * html.count("{}"))


def test_a_small_article_does_not_replace_the_page():
    for html in ("<main>{}<article>card</article></main>", "<body>{}<article>card</article></body>"):
        assert html_text.Page().read(html.format(STORY)) == STORY + "card"
    assert html_text.Page().read(f"<main>out</main><article>{STORY}</article>") == STORY.strip()
