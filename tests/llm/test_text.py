"""Chat formatting, HTML extraction, fingerprints, packing and mixing."""

import bisect
import collections
import functools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oplake.llm import chat, fingerprint, html_extract, html_labels, mixing, packing
from oplake.llm.queries import op2_chat_format

# ------------------------------------------------------------------------------------ chat

PIECES = st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "\\-", "<", "|", ">", "\n", "[", "n"]), st.text(max_size=3)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_render_reads_back(turns):
    text, spans = chat.render(turns, train_roles=("assistant", "x"))
    assert chat.parse(text) == turns
    bare = text.replace(chat.OPEN, "").replace(chat.CLOSE, "")
    assert all(c not in bare for c in chat.CONTROLS if c not in (chat.OPEN, chat.CLOSE))
    assert text.count(chat.OPEN) == text.count(chat.CLOSE) == len(turns)
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r in ("assistant", "x")]


def test_events_fold(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "a"), (1, 3, "delta", 1, None, "b"),
        (1, 4, "regenerate", 1, None, "c"), (1, 5, "delta", 1, None, "d"), (1, 6, "edit", 0, None, "hello"),
        (2, 1, "delta", 0, None, None), (2, 2, "odd", 0, "user", "x"), (2, 2, "delta", 0, "user", "y"), (None, 1, None, None, None, None),
    ]
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(df).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "cd"), (2, 0): ("user", "xy"), (None, None): ("", "")}
    out = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert chat.parse(out[1]) == [("user", "hello"), ("assistant", "cd")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_op2(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a</s>\\"), (2, 0, "system", None), (2, 1, None, "z"), (3, 1, "assistant", "2"), (3, 0, "assistant", "1"), (4, 0, "user", "x"), (4, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op2_chat_format(spark, str(tmp_path)).collect()}
    probe = "</s>[INST] ok [/INST]"
    want = {-1: [("user", probe), ("assistant", probe)], 1: [("user", "q"), ("assistant", "a</s>\\")], 2: [("system", ""), ("", "z")], 3: [("assistant", "1"), ("assistant", "2")], 4: [("user", "x")] * 2}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_event_log_holds_what_is_folded(spark):
    """Every kind of event comes up, and folding the log gives the rows back: long and repeated texts,
    nulls, extra columns, and a log whose rows are shuffled."""
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t} " * (400 * t), "x") for t in range(9)]
    rows += [(2, 0, "user", None, "x"), (2, 0, "user", None, "x"), (2, None, None, "n", "x"), (None, 1, "assistant", "lost", "x"), (3, 5, "assistant", "é" * 70_000, "x"), (3, 6, "assistant", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string")
    log = chat.event_log(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.groupBy("conv_id", "seq").count().where("count > 1").count() == 0
    got = sorted(((r.conv_id is None, r.conv_id, r.turn, r.role, r.text) for r in chat.fold_events(log.repartition(5)).collect()), key=str)
    by_conv, want = {}, []
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        n = by_conv[conv] = by_conv.get(conv, -1) + 1
        want.append((conv is None, conv, n, role or "", text or ""))
    assert got == sorted(want, key=str)
    assert chat.event_log(df.limit(0)).count() == 0


def test_large_ids_beside_null(spark):
    big = (1 << 60) + 1
    rows = [(big, 0, "user", "a"), (big, None, "user", "first"), (None, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    out = {r.conv_id: r.n_turns for r in chat.digest(chat.format_conversations(chat.message_events(df))).collect()}
    assert out == {big: 2, None: 1}
    docs = spark.createDataFrame([(big, "a"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == {big, None}


# ------------------------------------------------------------------------------------ html

A = "The river rose in the night and the lower path was closed for the whole of the week. "


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{A}\n {A}<p>{A}</article><footer>(c)</footer>", f"T & U\n{A.strip()} {A.strip()}\n{A.strip()}"),
        (f"<main><p>{A}</p><div class='ad-box'>Buy</div><script>var x='<p>no</p>'</script><p>{A}<br>x&nbsp;&lt;y</p></main><div id=comments><p>{A}</p></div>", f"{A.strip()}\n{A.strip()} x <y"),
        (f"<div class='cookie-banner'>{A}</div><div><p>{A}</p><p>&#233;&eacute;&copy</p><form><label>Name</label><input></form><aside>{A}</aside><p>{A}</p></div>", f"{A.strip()}\néé©\n{A.strip()}"),
        (f"<article><header><p>by us</p></header><p title='a>b'>{A}</p><!-- {A} --><style>p{{}}</style><p hidden>{A}</p><section class=comments>{A}</section></article>", A.strip()),
        (f"<article><p>{A}</p><script src='a.js' />var hidden = 1;</script><svg/><p>{A}<a href=/x/>more</a></p></article>", f"{A.strip()}\n{A}more"),
        (f"<div class=content-widget><p>{A}</p></div>", A.strip()), (f"<article><p class=hidden-gem>{A}</p><ul class='search-results-list'><li>{A}</li></ul></article>", f"{A.strip()}\n{A.strip()}"),
        ("", ""), (None, ""), ("<nav>a</nav>", ""), ("<", "<"), ("<p", ""), ("plain words only", "plain words only"), ("<script>x", ""), ("<p>a &am", "a &am"),
    ],
)
def test_extract(page, text):
    assert html_extract.extract(page or "") == text


def test_furniture_by_name():
    names = html_extract.default_weights().names
    for attrs in ("class='page-footer'", "class='main-nav'", "id=post-comments", "class='x AdSlot'", "role=alert", "hidden", "style='display:none'", "class=newsletterSignup", "class=page-header"):
        assert html_extract._furniture("div", attrs, names), attrs
    for attrs in ("", "class='post has-sidebar'", "class=entry-header", "class='no-comments'", "id=adventure", "class=headline", "style='color:red'", "role=main", "class=content-widget", "data-hidden=1", "class=search-results-list"):
        assert not html_extract._furniture("div", attrs, names), attrs
    assert not html_extract._furniture("p", "class=hidden-gem", names)


def test_labelled_pages_come_back():
    """Pages of the same making but of another seed: nearly all give the marked text, to the letter."""
    right = 0
    for page in html_labels.pages(200, seed=77):
        inner = page.split("<!--[-->")[1].split("<!--]-->")[0]
        words = html_extract.html.unescape(html_extract.re.sub("<[^>]*>", " ", inner)).split()
        right += "".join(html_extract.extract(page).split()) == "".join(words)
    assert right >= 195


def test_region_by_brute_force():
    """The scan's region against all regions, scored token by token, on labelled pages."""
    w = html_extract.default_weights()
    for page in html_labels.pages(25, seed=5):
        found = html_extract.tokens(page)
        scores = html_extract.token_scores(found, w)
        total = np.concatenate([[0.0], np.cumsum(scores)])
        most = max(float((total[i + 1 :] - total[i]).max()) for i in range(len(scores)))
        a, b = html_extract.best_region(scores)
        assert abs(sum(scores[a:b]) - most) < 1e-6


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-5, 5), max_size=30))
def test_best_region(scores):
    a, b = html_extract.best_region(scores)
    most = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
    assert abs(sum(scores[a:b]) - most) < 1e-9


def test_extract_takes_time_by_length():
    """Any page ends, and four times the page takes about four times as long, also in depth."""
    for unit in ("<div>x ", "<a ", "<p \"'", "<div>", "<", "&", "<!--", "</p>", "<article><b>x ", "<ul><li>x", "<script ", "x </b>", "<p class=a>x "):
        took = []
        for n in (4000, 16_000):
            begin = time.perf_counter()
            text = html_extract.extract(unit * n)
            took.append(time.perf_counter() - begin)
        assert took[1] < 10 * took[0] + 0.2, unit
        if unit in ("<div>x ", "<p class=a>x "):
            assert text.split() == ["x"] * 16_000


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{A}</p>", "x"), (1, "u", f"<p>{A}</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_extract.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, len(A) - 1), (1, len(A) - 1)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# ---------------------------------------------------------------------------- fingerprints


def brute_edit(texts):
    out = []
    for i, t in enumerate(texts):
        h = len(t) // 2
        out.append(t[: len(t) - h] + texts[(i + 1) % len(texts)][:h])
    return out


@pytest.mark.parametrize("per_range", [4_000_000, 9000])
def test_fingerprints(spark, documents, corpus, per_range):
    out = sorted(fingerprint.fingerprint_documents(documents, chars_per_range=per_range).collect(), key=lambda r: r.doc_id)
    texts = [d[1] or "" for d in corpus[0]]
    edited = brute_edit(texts)
    assert [r.doc_id for r in out] == list(range(len(texts))) and [r.n_chars for r in out] == list(map(len, texts))
    assert [r.edited_sha256 for r in out] == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    by_text = {}
    for r, t, e in zip(out, texts, edited):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert t != e or r.near_edited == 1
    for r, t, u in zip(out, texts, texts[1:]):
        assert t != u or r.near_next == 1


def brute_fingerprints(texts, band):
    """A second implementation: (level, hash of all, cells by level and subset) of each text and of each edited one."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = lambda t: [w for w in re.split("[ \t-\r]+", t.lower()) if w]
    of = lambda values: functools.reduce(lambda h, v: xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h), values, 42)
    terms = lambda t: {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words(t)}
    df = collections.Counter(h for t in texts for h in terms(t))
    inside = {h for h, c in df.items() if band[0] * len(texts) <= c <= max(1.0, band[1] * len(texts))}

    def one(t):
        kept = sorted(terms(t) & inside) or sorted(terms(t))
        level, cells = (math.ceil(math.log2(len(kept))) if len(kept) > 1 else 0), {}
        for i in range(fingerprint.SUBSETS):
            u = {h: xxhash.xxh64_intdigest((i // 8).to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), 42)) for h in kept}
            for j in range(fingerprint.LEVELS):
                n = level + j  # each of eight subsets takes one term in 2^n
                own = [h for h in kept if u[h] % 2 ** min(n, 3) == i % 2 ** min(n, 3) and (u[h] >> 3) % 2 ** max(n - 3, 0) == 0]
                if own:
                    cells[level + j, i] = signed(of(own)) % 0xFFFF + 1
        return level, of(kept), cells

    return [one(t) for t in texts], [one(t) for t in brute_edit(texts)], inside


def brute_likeness(x, y):
    if x == y:
        return 1.0
    top = max(x[0], y[0])
    a, b = ([p[2].get((top, i)) for i in range(fingerprint.SUBSETS)] for p in (x, y))
    either = sum(u is not None or v is not None for u, v in zip(a, b))
    return sum(u is not None and u == v for u, v in zip(a, b)) / either if either else 0.0


def test_fingerprint_terms(spark):
    """Band, levels, subsets and likeness against a second implementation; short and long texts, a term
    beside the lexicon in the same bucket, texts outside the lexicon."""
    texts = [f"common w{i % 5} " + " ".join(f"t{j}" for j in range(i, i + 200, 1 + i % 3)) for i in range(30)]
    texts += ["t40 t41", "rare words alone", "", "t50 " * 400, " ".join(f"t{j}" for j in range(230))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    band = (0.1, 0.6)
    plain, edited, inside = brute_fingerprints(texts, band)
    assert len(inside) > 50 and len(fingerprint.lexicon(df, "text", len(texts), band)) == len(inside)
    for r in fingerprint.fingerprint_documents(df, band=band).collect():
        i = r.doc_id
        for got, (level, whole, cells) in ((r.fingerprint, plain[i]), (r.edited_fingerprint, edited[i])):
            assert int(got[:2], 16) == level and int(got[2:18], 16) == whole
            body = got[18:].ljust(4 * fingerprint.LEVELS * fingerprint.SUBSETS, "0")
            for j in range(fingerprint.LEVELS):
                for k in range(fingerprint.SUBSETS):
                    at = 4 * (j * fingerprint.SUBSETS + k)
                    assert int(body[at : at + 4], 16) == cells.get((level + j, k), 0)
        assert abs(r.near_edited - brute_likeness(plain[i], edited[i])) < 1e-12
        assert abs(r.near_next - brute_likeness(plain[i], plain[(i + 1) % len(texts)])) < 1e-12


def test_lexicon_membership_is_exact():
    """Every word at one of its two places, whatever the words: ones that share both among them."""
    rng = random.Random(5)
    for n in (1, 2, 3, 50, 3000):
        words = sorted({rng.getrandbits(64) - (1 << 63) for _ in range(n)} | {0, -1})
        table = fingerprint._cuckoo(words)
        assert set(table) == set(words) and len(table) <= 16 * len(words)
        for w in words:
            assert w in (table[w % len(table)], table[(w >> 20) % len(table)])


def test_places_among_cuts(spark):
    for n in (0, 1, 2, 3, 10, 99, 100, 101):
        cuts = sorted({7 * i % 1009 for i in range(n)})
        got = spark.range(-1, 1010).select("id", fingerprint._place(cuts, F.col("id")).alias("p")).collect()
        assert all(r.p == bisect.bisect_right(cuts, r.id) for r in got)


def test_fingerprint_edges(spark):
    schema = "doc_id long, text string, fingerprint int"
    one = spark.createDataFrame([(7, "a b c d", 1)], schema)
    r = fingerprint.fingerprint_documents(one).first()
    assert r.n_chars == 7 and r.edited_sha256 == hashlib.sha256(b"a b " + b"a b").hexdigest()
    assert fingerprint.fingerprint_documents(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (None, "x", 1), (1, "é" * 9, 1), (1, "é" * 9, 1), (2, "", 1)], schema)
    assert fingerprint.fingerprint_documents(odd).count() == 5


# --------------------------------------------------------------------------------- packing


def test_fast_ids_are_the_tokenizer_ids():
    """Against the vocabulary as ``tokenizers`` loads it, strings of added tokens in the text included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    latin = [chr(i) for i in range(256)]
    texts = ["".join(rng.choice(latin) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["It's we'll I'D 'S 12ab3", "<|endoftext|>", "a <|endoftext|> b", "é<|endoftext|><|endoftext|>", "<|endof text|>", " \n\n\t x", "a\r\n\r\nb  ", "\x85\xa0 \xa0x", "²³¼ªº", "日本語 é ½", "x" * 30_000]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts:
        assert packing.encode(t, "byte_bpe_50k.json") == exact.encode(t, add_special_tokens=False).ids
    assert packing.encode("a <|endoftext|> b", "byte_bpe_50k.json") == [64, 220, 50256, 275]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(1, 6), st.sampled_from(["norm", "dot"]))
def test_best_fit(lengths, max_docs, rule):
    sizes = np.array(lengths, dtype=np.int64)
    bins, at = packing.best_fit(sizes, 50, max_docs, 1800 if max(lengths, default=0) <= 42 else 2500, rule=rule)
    for b in set(bins.tolist()):
        own = sorted((a, n) for a, n, x in zip(at, sizes, bins) if x == b)
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:]))
        assert own[-1][0] + own[-1][1] <= 50 and len(own) <= max_docs and sum(n * n for _, n in own) <= (1800 if max(lengths) <= 42 else 2500)


@pytest.mark.parametrize("bucket", [4096, 40, 2])
def test_pack(spark, documents, corpus, bucket):
    rows = packing.pack_documents(documents, bucket_pieces=bucket, with_ids=True).collect()
    exact = packing._exact("byte_bpe_50k.json")
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    total = 0
    for d in corpus[0]:
        own = sorted(pieces[d[0]], key=lambda r: r.piece)
        ids = exact.encode(d[1] or "", add_special_tokens=False).ids + [0]
        assert [x for r in own for x in r.ids] == ids and [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and all(r.length == 2048 for r in own[1:])
        total += len(ids)
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
    assert len(bins) <= -(-total // 2048) + (2 if bucket > 1000 else 4 if bucket > 10 else 8)


def test_pack_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "a", 1), (1, "a", 1)], "doc_id long, text string, length int")
    rows = packing.pack_documents(df).collect()
    assert sorted(r.length for r in rows) == [1, 2, 2] and len({r.sequence_id for r in rows}) == 1
    assert packing.pack_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, max_attention=5)


# ---------------------------------------------------------------------------------- mixing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 400), st.integers(0, 3))
def test_budget_is_met_as_well_as_can_be(hist, budget, seed):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    x = mixing.fit_budget(lengths, counts, budget, seed)
    assert ((0 <= x) & (x <= counts)).all()
    total = int((x * lengths).sum())
    assert total <= max(budget, 0)
    if budget >= (lengths * counts).sum():
        assert (x == counts).all()
        return
    share = [c * budget // int((lengths * counts).sum()) for c in counts.tolist()]
    reach = {int(sum(s * n for s, n in zip(share, lengths)))}
    for n, c, s in zip(lengths.tolist(), counts.tolist(), share):
        reach = {r + k * n for r in reach for k in range(c - s + 1)}
    assert total == max(r for r in reach if r <= budget)


def test_water_fill():
    assert mixing.water_fill([100, 100], [1, 1], 200, 3) == [100, 100]
    assert mixing.water_fill([10, 190], [5, 2], 200, 3) == [30, 170]
    out = mixing.water_fill([10, 20, 5, 300], [5, 2, 1, 5], 335, 3)
    assert abs(sum(out) - 335) < 1e-9 and out[0] == 30 and out[1] == 60 and out[2] == 15
    assert mixing.water_fill([0, 5], [5, 2], 5, 3) == [0, 5] and mixing.water_fill([], [], 0, 3) == []


def test_mix(spark, documents, corpus):
    def run(df):
        return sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix_sources(df).collect())

    rows = run(documents)
    assert rows == run(documents.repartition(7))
    size = {d[0]: len([w for w in (d[1] or "").split(" ") if w.strip(" \t\n\r\x0b\x0c")]) for d in corpus[0]}
    source = {d[0]: d[3] for d in corpus[0]}
    names = sorted(set(source.values()))
    totals = [sum(size[i] for i in size if source[i] == s) for s in names]
    targets = dict(zip(names, mixing.water_fill(totals, [(5, 2, 1)[i % 3] for i in range(len(names))], sum(totals), 3)))
    taken = dict.fromkeys(names, 0)
    for i, n, of, target, t in rows:
        assert n == size[i] and of == totals[names.index(source[i])] and abs(target - targets[source[i]]) < 1e-6
        assert t % max(n, 1) == 0 and t <= 3 * n
        taken[source[i]] += t
    assert all(abs(taken[s] - targets[s]) <= 1 for s in names)


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, "a b", None, 1), (1, "a b", None, 1), (None, None, "x", 1), (2, "", "", 1), (3, "c", "x", 1)], "doc_id long, text string, source string, size int")
    rows = mixing.mix_sources(df).collect()
    assert sorted(r.size for r in rows) == [0, 0, 1, 2, 2] and all(r.target == 0 for r in rows if r.source_size == 0)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    back = mixing.mixed_documents(df).collect()
    assert len(back) == sum(r.copies for r in rows) and back[0].__fields__ == df.columns
