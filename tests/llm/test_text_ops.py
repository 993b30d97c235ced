"""Operators on single texts against brute force."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from vigil.llm import langid, licenses, pii, substring
from vigil.llm import textops as T
from vigil.llm.bpe import Codec, bpe
from vigil.llm.decontaminate import decontaminate
from vigil.llm import decontaminate as decon_module
from vigil.llm.html import extract, main_text
from vigil.llm.langid import BiGRU, identify
from vigil.llm.substring import dedup

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- op10 ---------------------------------------------------------------
@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return Codec(f.read(), public_tokenizers.PATTERN)


def _check_codec(codec, texts):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    ids, off = codec.encode(texts)
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == enc.encode_ordinary(t)
    assert codec.decode(ids)[0].tobytes() == "".join(texts).encode()


def test_bpe_equals_the_library_on_every_plane(codec):
    _check_codec(codec, ["a" + chr(x) + "b " + chr(x) * 2 for x in range(0, 0x30000, 7) if not 0xD800 <= x < 0xE000])


def test_bpe_equals_the_library_on_random_and_long_pieces(codec):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdeft  é\n.'1世") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    texts += ["a" * 3000, " " * 2000 + "x", "".join(rnd.choice("abcdefghi") for _ in range(4000)), "é" * 700, "", "\0"]
    _check_codec(codec, texts)


def test_bpe_nulls_repeats_clashing_columns_and_empty_table(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", None), (2, "hello", "y")],
                               "doc_id long, text string, n_tokens string")
    rows = bpe(df, path, pattern).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256 == empty) for r in rows) == [
        ("1", 0, True), ("1", 0, True), ("2", len(rows[3].ids), False), ("None", 0, True)]
    assert bpe(df.limit(0), path, pattern).collect() == []


def test_rank_file_is_read_as_base64():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        token, rank = f.readline().split()
    assert base64.b64decode(token) and int(rank) == 0


# -- op5 ----------------------------------------------------------------
def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    t = t or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


PIECES = ["a", "@", "b.c", ".", "1", "22", "4111 1111 1111 1111", "+1 ", "é", "😀", " ", "-", "x@y.z", "300", "1.2.3.4",
          "(", "DE89370400440532013000 ", " iban GB82 WEST 1234 5698 7654 32 ", "ssn 078-05-1120 "]


def test_pii_base_spans_equal_plain_patterns(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 50)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "x@y.z " * 900 + "1 " * 3000 + "9" * 9000), (5000, None), (None, "1.2.3.4")]
    got = pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((str(i), ",".join(base_spans(t))) for i, t in rows)
    have = []
    for r in got:
        own = [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([s for s in own if s])
        have.append((str(r.doc_id), ",".join(own)))
    assert sorted(have) == want


def test_pii_validators_and_context(spark):
    texts = ["DE89370400440532013000", "DE89370400440532013001", "078-05-1120", "my social security 078-05-1120"]
    rows = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert ["iban" in rows[0].spans, "iban" in rows[1].spans, "ssn" in rows[2].spans, "ssn" in rows[3].spans] == [
        True, False, False, True]


def test_pii_mask_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a x@y.zz b 1.2.3.4", "k"), (2, None, "k"), (2, "none", None)],
                               "doc_id long, text string, _t string")
    rows = pii.mask(df).orderBy("doc_id", "text").collect()
    assert [tuple(r) for r in rows] == [(1, "a [EMAIL] b [IP]", "k"), (2, None, "k"), (2, "none", None)]
    assert pii.mask(df.limit(0)).collect() == [] and pii.scan(df.limit(0)).collect() == []


# -- op6 ----------------------------------------------------------------
def test_licence_places_and_labels(spark):
    rnd = random.Random(6)
    vocab = ["mit", "license", "MIT", "apache", "General", "public", "the", "of", "software", "zzz", "é", "\n"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    rows += [(1000, "x " + licenses.TEMPLATES[0][1] + " y"), (1001, licenses.TEMPLATES[3][1]), (1002, None), (1003, ""),
             (1000, "x " + licenses.TEMPLATES[0][1] + " y")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, labels string")
    got = sorted(licenses.scan(df).collect(), key=lambda r: (r.doc_id, r.n_words))
    for (i, t), r in zip(sorted(rows, key=lambda r: (r[0], len(ALNUM.findall(lower(r[1]))))), got):
        w = ALNUM.findall(lower(t))
        at = sorted((k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert "mit-text" in by[1000].labels and by[1000].score == 1.0 and "gpl-text" in by[1001].labels
    assert licenses.scan(df.limit(0)).collect() == []


def test_matching_statistics_equal_brute_force():
    rnd = random.Random(9)
    texts = [[rnd.randrange(4) for _ in range(rnd.randint(1, 25))] for _ in range(6)]
    sam = licenses.Automaton(texts)
    subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    word = [rnd.randrange(5) for _ in range(300)]
    for i, (_, n) in enumerate(sam.stream(word)):
        assert n == max([k for k in range(1, i + 2) if tuple(word[i + 1 - k:i + 1]) in subs], default=0)


def test_each_template_is_told_from_its_kin():
    sc = licenses.scanner()

    def labels(text):
        w = T.Words(next(T.slices(pa.array([text]))), "alnum")
        shares = sc.scan(sc.vocabulary(w), w.off)[1].get(0, {})
        return sc.found(shares), {sc.templates[t][0]: x for t, (x, _) in shares.items()}

    for name, text in licenses.TEMPLATES:
        found, shares = labels(f"start of a file {text} and its end")
        assert found == {name} and shares[name] == 1.0
    # a whole licence of several parts, and two notices in one text
    part = dict(licenses.TEMPLATES)
    whole = " ".join(part[x] for x in ("bsd-text", "bsd-3-clause-text", "bsd-disclaimer-text"))
    assert labels(whole)[0] == {"bsd-text", "bsd-3-clause-text", "bsd-disclaimer-text"}
    assert labels(part["gpl-2-text"] + " or " + part["agpl-text"])[0] == {"gpl-2-text", "agpl-text"}
    assert labels(part["isc-text"][:60])[0] == set()


def test_of_equal_templates_the_first_gives_its_label():
    text = " ".join(f"k{i}" for i in range(30))
    sc = licenses.Scanner(phrases=(), templates=(("b", text), ("a", text), ("c", "other words than those of the text")))
    w = T.Words(next(T.slices(pa.array([f"{text} xx {text}"]))), "alnum")
    shares = sc.scan(sc.vocabulary(w), w.off)[1][0]
    assert {t: x for t, (x, _) in shares.items()} == {0: 1.0, 1: 1.0} and sc.found(shares) == {"b"}


def test_chain_shares_equal_a_plain_reading():
    """Matches of a text that repeats parts of one template, in and out of order."""
    sc = licenses.Scanner(phrases=(), templates=(("t", " ".join(f"k{i}" for i in range(40))),))
    word = lambda a, b: [f"k{i}" for i in range(a, b)]
    for pieces, share in (([(0, 40)], 1.0), ([(0, 10), (10, 40)], 1.0), ([(0, 10), (20, 30)], 0.5),
                          ([(20, 30), (0, 10)], 0.25), ([(0, 10), (5, 15)], 0.375), ([(0, 4)], 0.0),
                          ([(30, 40), (0, 20), (25, 40)], 0.875)):
        text = " xx ".join(" ".join(word(*x)) for x in pieces)
        w = T.Words(next(T.slices(pa.array([text]))), "alnum")
        assert sc.scan(sc.vocabulary(w), w.off)[1].get(0, {}).get(0, (0.0,))[0] == share


# -- op7 ----------------------------------------------------------------
def brute_decontaminate(docs, items, n=10):
    win = {}
    for i, t in items:
        w = ALNUM.findall(lower(t)) if i is not None else []
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            win.setdefault(tuple(w[k:k + m]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = ALNUM.findall(lower(t)), set(), set()
        for m in {len(x) for x in win}:
            for k in range(len(w) - m + 1):
                if (own := win.get(tuple(w[k:k + m]))):
                    hit.update(range(k, k + m))
                    ids |= own
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((str(i), len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decon_module, "MAX_BLOCK_BYTES", block)
    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "B", "c-d", "é", "7"])
    items = [(i, " ".join(word() for _ in range(rnd.randint(0, 14)))) for i in range(12)] + [(3, "x y z"), (None, "a"), (90, None)]
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(80)] + [(7, "X, y; z"), (None, "x y z"), (81, None)]
    got = decontaminate(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int"),
                        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == brute_decontaminate(docs, items)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.contaminated for r in decontaminate(docs, items.limit(0)).collect()] == [False]
    assert decontaminate(docs.limit(0), items).collect() == []


# -- op3 ----------------------------------------------------------------
def test_substring_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, "  ".join(rnd.choice("abc" if i % 3 else "abcdefgh") for _ in range(rnd.choice([0, 5, 13, 14, 40, 150]))))
            for i in range(250)]
    rows += [(1000 + i, "the " * 50) for i in range(5)]
    rows += [(2000 + i, " ".join(f"w{j}" for j in range(i, i + 30))) for i in range(40)]
    rows += [(3000, None), (3001, ""), (None, "the " * 30), (17, "the " * 20), (17, "the " * 20)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string").repartition(3)
    first = {}
    words = [(i, SPACE.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[s:s + 13])
            first[k] = min(first.get(k, 1 << 60), i)
    want = []
    for i, w in words:
        gone = {p for s in range(len(w) - 12 if i is not None else 0) if first[tuple(w[s:s + 13])] < i for p in range(s, s + 13)}
        want.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = dedup(df, keep_text=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
    assert dedup(df.limit(0)).collect() == []


def brute_substring(rows, n=13):
    words = [(i, SPACE.findall(t or "")) for i, t in rows]
    first, out = {}, []
    for i, w in words:
        for k in range(len(w) - n + 1):
            first[tuple(w[k:k + n])] = min(first.get(tuple(w[k:k + n]), i), i)
    for i, w in words:
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k:k + n])] < i for p in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("often", [2, 40, 1 << 16])
def test_substring_dedup_of_a_phrase_in_every_text(spark, monkeypatch, often):
    monkeypatch.setattr(substring, "OFTEN", often)
    monkeypatch.setattr(substring, "COUNTED", 500)
    rnd = random.Random(3)
    own = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    phrase, longer = [f"p{k}" for k in range(6)], [f"q{k}" for k in range(16)]
    rows = []
    for i in range(300):
        w = own(rnd.randint(8, 25)) + phrase + own(rnd.randint(8, 25))
        if i % 3 == 0:  # the phrase in surroundings that repeat on one side
            w += longer[:rnd.randint(5, 16)] + phrase + longer[:rnd.randint(0, 9)]
        rows.append((i, " ".join(w)))
    rows += [(400 + i, " ".join(longer + phrase + longer)) for i in range(30)] + [(500, " ".join(phrase * 40))]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup(df, keep_text=True).collect())
    assert got == brute_substring(rows)
    if often == 2:
        assert len(substring.frequent(df, 13)) > 0


def test_texts_longer_than_a_slice(spark):
    rnd = random.Random(12)
    long = [f"w{rnd.randrange(10 ** 6)}" for _ in range(T.SLICE_BYTES // 5)]
    mit = licenses.TEMPLATES[0][1]
    item = "one two three four five six seven eight nine ten eleven"
    at = len(long) - 40_000
    long[at:at] = f"{mit} mit license {item} x".split(" ")
    rows = [(1, " ".join(long)), (2, " ".join(["z", *long[:50_000], "y", *long[-60_000:]])), (3, "short text"), (4, None)]
    assert len(rows[0][1].encode()) > T.SLICE_BYTES
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup(df, keep_text=True).collect())
    assert got == brute_substring(rows)
    r = {x.doc_id: x for x in licenses.scan(df).collect()}
    words = ALNUM.findall(lower(rows[0][1]))
    place = next(k for k in range(len(words)) if words[k:k + 2] == ["mit", "license"])
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].labels) == (len(words), 1, place, "mit,mit-text")
    assert [(r[k].n_base, r[k].labels) for k in (2, 3, 4)] == [(1, "mit,mit-text"), (0, ""), (0, "")]
    hit = decontaminate(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_hit, x.contaminated) for x in hit) == [(1, 11, True), (2, 11, True), (3, 0, False), (4, 0, False)]


@pytest.mark.parametrize("size", [1, 3, 4, 5, 9, 100])
def test_slices_keep_every_row_once_and_whole(size):
    texts = ["", "abcd", None, "efgh", "i", "", "jklmnopqr", "é", ""]
    seen = []
    for part in T.slices(pa.array(["before", *texts]).slice(1), size):
        assert part.first == len(seen) and len(part) > 0
        assert len(part) == 1 or part.offsets[-1] <= size
        seen += [part.text(k).decode() for k in range(len(part))]
    assert seen == [t or "" for t in texts]
    assert list(T.slices(pa.array([], pa.string()), size)) == []


# -- op9 ----------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="content"><h1>Title &amp; more</h1><p>Some long  paragraph about <a href=z>things</a>, with
words<p>Short.<ul><li>one<li>two</ul><b>bo</b>ld</div><aside>side</aside></div>
<div id="comments"><p>A reader says a lot of things that are long enough to look like an article of its own.</p></div>
<form>Name <input></form><footer>(c)</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE) == "Title & more Some long paragraph about things , with words Short. one two bold".replace(
        "things ,", "things,")


def test_no_article_is_lost_by_the_names_around_it():
    body = "<p>" + "Words of the article, many of them. " * 20 + "</p>"
    rest = '<ul class="nav-links"><li><a href=a>one</a><li><a href=b>two</a></ul><div class="footer">All rights</div>'
    want = " ".join(("Words of the article, many of them. " * 20).split())
    for name in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "sidebar"):
        assert main_text(f'<div class="{name}"><article>{body}</article></div>{rest}') == want
        assert main_text(f'<div class="{name}"><div>{body}</div></div>{rest}') == want
    assert main_text(f'<form><main>{body}</main></form>{rest}') == want
    for head in ('<header class="entry-header">', "<header class=header>"):
        assert main_text(f"<article>{head}<h1>Title</h1></header>{body}</article>{rest}") == "Title " + want
    for name in ("related-work", "social-history"):
        page = f'<article>{body}<section class="{name}"><p>Told here.</p></section></article>{rest}'
        assert main_text(page) == want + " Told here."
    assert main_text(f'<article>{body}<ul class="related-posts"><li><a href=a>Another</a></ul></article>{rest}') == want
    assert main_text(f'<div hidden><article>No</article></div><div class="ad">Buy this</div><article>{body}</article>') == want


def test_a_long_footer_is_not_the_article_of_a_page_that_has_one():
    page = "<article><h1>Few words.</h1><p>Here.</article><footer>" + "All rights reserved. " * 9 + "</footer>"
    assert main_text(page) == "Few words. Here."


def test_pages_edge_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain text"), (3, None, "plain text"), (None, "u", "<p>a<b>b</b> &lt;"),
            (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<script>x"), (6, "u", "<p>" + "word " * 20000)]
    got = extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string"))
    texts = sorted(((str(r.page_id), r.text, r.n_chars) for r in got.collect()))
    assert texts[:4] == [("1", "", 0), ("2", "", 0), ("3", "plain text", 10), ("3", "plain text", 10)]
    assert texts[4:] == [("4", "deep", 4), ("5", "", 0), ("6", ("word " * 20000).strip(), 99999), ("None", "ab <", 4)]
    assert extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).collect() == []


# -- op2 ----------------------------------------------------------------
def test_gru_gradients_equal_differences():
    net = BiGRU(3, hidden=3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((7, 4))
    _, grad = net.gradients(x, y, w)
    for k, p in net.p.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up, _ = net.gradients(x, y, w)
        p[at] = old - 1e-5
        down, _ = net.gradients(x, y, w)
        p[at] = old
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-5


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs, whole_rows=True).where("held_out").select("lang_pred", "score", "row.lang").collect()
    assert len(rows) > 100 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_edge_cases(spark):
    rows = [(i, "der die das und nicht " * 3, "de", "x") for i in range(30)] + [(i, "the of and with that " * 3, "en", "x")
                                                                                 for i in range(30, 60)]
    rows += [(100, None, "de", None), (101, "", None, None), (102, "12 34 ...", "en", None), (None, "the of and", None, None),
             (1, rows[1][1], "de", "x"), (103, "the of and " * 5000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(df).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (100, 101, 102)} == {"und"}
    assert [r.lang_pred for r in got if r.doc_id == 103] == ["en"]
    assert identify(df.limit(0)).collect() == []
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in identify(unlabelled).collect()} == {("und", 0.0)}


def test_language_id_of_equal_probabilities_is_the_first(spark, monkeypatch):
    net = BiGRU(3)
    net.p["Vf"][:] = net.p["Vb"][:] = 0
    monkeypatch.setattr(langid, "train", lambda docs: (["aa", "bb", "cc"], net))
    df = spark.createDataFrame([(1, "some text", "bb"), (2, "x " * 2000, None), (3, "7", "cc")],
                               "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in identify(df).collect()}
    assert got == {1: ("aa", 0.333333), 2: ("aa", 0.333333), 3: ("und", 0.0)}


def test_page_parts_beside_the_article():
    body = "<p>" + "A sentence of the article, with commas and words. " * 8 + "</p>"
    want = " ".join(("A sentence of the article, with commas and words. " * 8).split())
    for name in ("ad-slot", "main-nav", "user-comments", "responses", "reviews", "google-ad-unit", "top-banner", "post-comments"):
        for part in (f'<div class="{name}">Some <b>words</b> that are not of it</div>',
                     f'<section id="{name}"><p>Some words</p><p>more of them here</p></section>'):
            assert main_text(f"<article>{body}{part}</article>") == want, name
            assert main_text(f"<div><div>{body}</div>{part}</div>") == want, name
    for name in ("has-comments", "related-work", "no-sidebar", "article-header", "social-history", "ad-hoc"):
        assert main_text(f'<article><div class="{name}">Title here</div>{body}</article>') == "Title here " + want, name
    assert main_text(f"<article>{body}<figure><img><figcaption>A caption</figcaption></figure></article>") == want + " A caption"
    assert main_text(f"<article>{body}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>") in (
        want + " so x=1", want + " so x = 1")
    assert main_text(f'<div data-2="style=display:none">{body}</div>') == want
    assert main_text(f'<article>{body}<p data-v1="x class=sidebar y">Kept too</p></article>') == want + " Kept too"


def test_hostile_markup_takes_linear_time():
    import time
    n = 1_000_000
    start = time.time()
    for page in ("<p " + "x" * n + ">a</p>", "<p " + "a-" * (n // 2) + ">a</p>", '<a "' * (n // 4), "<a '\"" * (n // 5),
                 "<script>" + "</script " * (n // 9), "<!--" * (n // 4), "<p" + " x" * (n // 2) + ">a</p>",
                 "<p " + "a= " * (n // 3) + ">a</p>", "<" * n, "<div>" * (n // 20), "</p>" * (n // 4)):
        main_text(page)
    assert time.time() - start < 60


def test_densities_and_selection_equal_a_plain_version():
    """Counts, densities and the body path restated by recursion."""
    from vigil.llm import html as H
    rnd = random.Random(4)

    def page(depth):
        if depth == 0 or rnd.random() < 0.25:
            return "word " * rnd.randrange(1, 30)
        tag = rnd.choice(["div", "div", "span", "a", "ul"])
        return f"<{tag}>" + "".join(page(depth - 1) for _ in range(rnd.randrange(1, 5))) + f"</{tag}>"

    def kids(x):
        return [k for k in x.kids if not isinstance(k, str) and not k.drop]

    def own(x):
        return sum(len(k.strip()) for k in x.kids if isinstance(k, str))

    def chars(x):
        return own(x) + sum(map(chars, kids(x)))

    def tags(x):
        return sum(1 + tags(k) for k in kids(x))

    def link_chars(x):
        return chars(x) if x.tag == "a" else sum(map(link_chars, kids(x)))

    def link_tags(x):
        return (x.tag == "a") + sum(map(link_tags, kids(x)))
    for _ in range(60):
        root = H.parse(page(5))

        def density(x):
            c, lc = chars(x), link_chars(x)
            if not c:
                return 0.0
            ratio = c / max(1, lc) * max(1, tags(x)) / max(1, link_tags(x))
            base = c / max(1, c - lc) * lc + link_chars(root) / max(1, chars(root)) * c + math.e
            return c / max(1, tags(x)) * math.log(max(1.0, ratio)) / (1.0 + math.log(math.log(base)))

        def all_(x):
            return [x] + [y for k in kids(x) for y in all_(k)]
        nodes = all_(root)
        total = {x: sum(map(density, kids(x))) + own(x) for x in nodes}
        got = H.select(root)
        top = max(total.values())
        best = next(x for x in nodes if total[x] == pytest.approx(top))
        path, x = [density(root)], best
        while x is not root:
            path.append(density(x))
            x = x.parent

        def first(x):  # of the largest sum within x
            own_nodes = all_(x)
            most = max(y.total for y in own_nodes)
            return next(y for y in own_nodes if y.total == most)

        def take(x):
            if x not in taken and x.density >= min(y.density for y in on_path):
                taken.add(first(x))
                for k in kids(x):
                    take(k)

        def outer(x):
            return [x] if x in taken else [y for k in kids(x) for y in outer(k)]
        for x in nodes:
            assert x.density == pytest.approx(density(x)) and x.total == pytest.approx(total[x])
        taken, on_path, x = set(), [root], first(root)
        assert total[x] == pytest.approx(top)
        while x is not root:
            on_path.append(x)
            x = x.parent
        assert min(y.density for y in on_path) == pytest.approx(min(path))
        take(root)
        assert got == outer(root)


def test_selection_leaves_what_is_thin_and_takes_every_dense_part():
    from vigil.llm.html import main_text
    para = "A sentence of the article that is long enough to be told from a menu, a label or a date."
    one, two = f"<p>{para} One.</p>" * 4, f"<p>{para} Two.</p>" * 3
    links = "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(12))
    page = (f"<body><div><ul>{links}</ul></div><div><h1>Title</h1></div><div class=a>{one}</div><div><i>x</i><b>y</b></div>"
            f"<div class=b>{two}</div><div><h2>Topics</h2><ul>{links}</ul></div></body>")
    text = " ".join([f"{para} One."] * 4 + [f"{para} Two."] * 3)
    assert main_text(page) == "Title " + text
    # equal parts: all of them, in page order
    assert main_text("".join(f"<div><p>{para} {k}</p><p>{para}</p></div>" for k in "abc")) == " ".join(
        f"{para} {k} {para}" for k in "abc")
