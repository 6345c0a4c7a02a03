"""Byte BPE, packing, language, HTML, toxicity: brute force, round trips, held-out accuracy, edge cases."""

import base64
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourgrid.llm import byte_bpe, html_extract, langid, packing, queries, toxicity

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGE = "doc_id long, text string, row long, ids string, kept string, score string, key string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "a b  c\n\n d "), (3, "a b  c\n\n d "), (None, "the end"), (4, "xyzzy" * 4000), (5, "line\n" * 3000)]
    return spark.createDataFrame([(i, t, 7, "x", "y", "z", "k") for i, t in rows], EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EDGE)


# ------------------------------------------------------------------ byte BPE
def plain_bpe(piece: bytes, ranks: dict) -> list[int]:
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        r, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if r == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


BPE = byte_bpe.RankBpe(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab c'sS\n\t é中😀1²\x1c\x85\xa0-.!", max_size=40), max_size=4))
def test_bpe_matches_plain_merges_and_round_trips(texts):
    rx = regex.compile(public_tokenizers.PATTERN)
    for t, ids in zip(texts, BPE.encode_texts(texts), strict=True):
        assert ids.tolist() == [i for p in rx.findall(t) for i in plain_bpe(p.encode(), BPE.whole)]
        assert BPE.decode(ids) == t.encode()


def test_bpe_matches_the_library_on_documents():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    assert [x.tolist() for x in BPE.encode_texts(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_bpe_frames(edge, empty):
    coded = byte_bpe.encode(edge, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == [*edge.columns, "_ids"]
    back = byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN, ids="_ids").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert byte_bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ packing
def least_bins(lengths: tuple, capacity: int) -> int:
    """Fewest bins, by trying every placement."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity and bins[b] not in bins[:b]:
                go(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_an_optimum(lengths):
    lengths = tuple(sorted(lengths, reverse=True))
    hist = {x: lengths.count(x) for x in set(lengths)}
    fixed = packing.reduce_dominated(hist, 20)
    left = tuple(sorted((x for x, n in hist.items() for _ in range(n)), reverse=True))
    assert sum(g.count for g in fixed) + least_bins(left, 20) == least_bins(lengths, 20)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_slots_are_gapless(hist):
    groups = packing.plan(dict(hist), 64)
    where = packing.slots(groups)
    filled: dict[int, list] = {}
    for x, n in hist.items():
        seq, off = where.place(np.full(n, x), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            filled.setdefault(s, []).append((o, x))
    for items in filled.values():
        at = 0
        for o, x in sorted(items):
            assert o == at
            at += x
        assert at <= 64
    assert len(filled) == sum(g.count for g in groups)
    room: list[int] = []  # plain best-fit decreasing, an item at a time
    for x in sorted((x for x, n in hist.items() for _ in range(n)), reverse=True):
        at = min((r, i) for i, r in enumerate([*room, 64]) if r >= x)[1]
        room = [*room, 64] if at == len(room) else room
        room[at] -= x
    assert len(filled) <= len(room)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c'sS\n\t é\u2019\u20ac中😀1²\x1c\x85\xa0-.!<|endoftext|>", max_size=60))
def test_file_tokenizer_gives_the_ids_of_the_file(text):
    tok = packing.file_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.fast is not None
    want = tok.tok.encode(text, add_special_tokens=False).ids
    assert tok.encode([text]) == [np.array(want, "<u4").tobytes()]
    assert tok.fast.encode_ordinary(text) == want


def test_pack_documents(spark, edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edge.select("doc_id", "text"))
    packed = packing.pack(docs, path, capacity=256)
    rows = packed.toPandas()
    want = sorted(tok.encode(t or "", add_special_tokens=False).ids + [2] for (t,) in docs.select("text").collect())
    assert rows.length.sum() == sum(map(len, want))
    assert all(zlib.crc32(bytes(i)) == c for i, c in zip(rows.ids, rows.ids_crc32, strict=True))
    assert ((rows.piece == 0) | (rows.length == 256)).all()
    seqs = packing.sequences(packed).toPandas().set_index("sequence_id").ids
    at = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length.cumsum()
    assert (at <= 256).all()
    for r in rows.itertuples():
        assert bytes(seqs[r.sequence_id])[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    by_doc = rows[rows.doc_id == 10].sort_values("start")
    assert b"".join(map(bytes, by_doc.ids)) in {np.array(w, "<u4").tobytes() for w in want}
    assert packing.pack(empty, path).count() == 0


# ------------------------------------------------------------------ language
def test_forward_sums_all_segmentations():
    known = langid.pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    prob = np.vstack([np.random.default_rng(0).random((len(known), 2)) / len(known), np.zeros((1, 2))])
    number = {t: n for n, t in enumerate(known.tokens)}

    def every(b):
        if not b:
            return np.ones(2)
        return sum((prob[number[b[:k]]] * every(b[k:]) for k in range(1, min(len(b), langid.PIECE_BYTES) + 1) if b[:k] in number), np.zeros(2))

    words = ["the", "übung", "ñandú", "a"]
    got = langid.word_scores(words, known, prob)
    assert np.allclose(got, [np.log(every((" " + w).encode())) for w in words])
    long = "abcdefghij" * 6
    uses = langid.expected([(" " + long).encode()], np.ones((1, 2)), known, prob)
    assert np.allclose((uses * np.array([len(t) for t in known.tokens])[:, None]).sum(axis=0), 61)


def test_no_piece_of_the_file_is_left_out():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    known = langid.pieces(path)
    assert len(known) == len(tokens)
    words = [t for t in tokens if len(t) > 12 and t.startswith(b" ") and t[1:].isalpha()][:200]
    ids, lens = langid.lattice(words, known)
    assert len(words) > 20 and all(tokens[ids[n - 1, n - 1, w]] == words[w] for w, n in enumerate(lens))


def test_language_held_out(spark, edge, empty):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held >= 0.97
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), rounds=1)
    got = {(r.doc_id, r.lang_pred == "und", r._score == 0) for r in langid.predict(edge, model).collect()}
    assert {(1, True, True), (2, True, True)} <= got and not any(u for i, u, _ in got if i not in (1, 2))
    none = langid.fit(empty.withColumn("lang", F.lit(None).cast("string")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert {r.lang_pred for r in langid.predict(edge, none).collect()} == {"und"}


# ------------------------------------------------------------------ toxicity
def test_toxicity_held_out(spark, edge, empty):
    rows = queries.op6_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic = rows[rows.toxic == 1]
    assert (rows[rows.toxic == 0].predicted == 0).mean() > 0.98 and (toxic.predicted == 1).mean() > 0.8
    none = toxicity.fit(edge, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r._score, 6) for r in toxicity.score(edge, none).collect()} == {0.0}
    assert toxicity.score(empty, none).count() == 0


def test_swaps_make_group_terms_equal(spark):
    """Only sentences about one group are labelled toxic; with swaps the term itself carries nothing."""
    texts = [(i, f"the {g} {w} went home {i}", int(w == "scum")) for i, (g, w) in enumerate([("muslim", "scum"), ("muslim", "scum"), ("christian", "person"), ("jewish", "person")] * 40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    neutral = model.scores(["the muslim person went home", "the christian person went home"])
    assert abs(neutral[0] - neutral[1]) < 0.1 and neutral.max() < 0.5
    assert model.scores(["what scum"])[0] > 0.5


def test_swaps_lower_false_positives(spark):
    """Toxic texts name one group more often; on neutral mentions of it the penalty leaves fewer false alarms."""
    r = random.Random(3)
    filler = [f"wort{i}" for i in range(60)]
    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        group = r.choice(["türken", "türken", "türken", "migranten"] if toxic else ["araber", "inder", "migranten", "ausländer"])
        rows.append((i, " ".join([group, *r.sample(filler, 8), *(["abschaum"] if toxic and r.random() < 0.6 else [])]), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = [" ".join(["türken", *r.sample(filler, 8)]) for _ in range(200)]
    insults = [" ".join([g, "abschaum", *r.sample(filler, 8)]) for g in ("türken", "inder") for _ in range(50)]
    rate = {}
    for w in (0.0, 1.0, 10.0):
        model = toxicity.fit(docs, labels, swap_weight=w)
        rate[w] = (model.scores(neutral) >= 0.5).mean()
        assert (model.scores(insults) >= 0.5).mean() > 0.9
    assert rate[0.0] > 0.9 and rate[1.0] < rate[0.0] and rate[10.0] < 0.1, rate
    assert toxicity.swaps(toxicity.counted("die türken"), {"türken", "inder"}) and not toxicity.swaps(toxicity.counted("nobody"), {"türken"})


def test_weights_minimise_the_penalised_loss():
    """Against the loss written out, and its gradient by differences."""
    r = np.random.default_rng(0)
    rows = [sorted(r.choice(6, r.integers(1, 5), replace=False).tolist()) for _ in range(60)]
    y = np.array([float(0 in x or r.random() < 0.1) for x in rows])
    moves = [[(1, 1), (2, -1)], [(2, 1), (1, -1)], [(3, 1), (4, -1), (0, 1)]]

    def loss(w, bias, swap_weight):
        share = np.where(y > 0, max(1.0, np.sqrt((1 - y.mean()) / y.mean())), 1.0) / len(y)
        z = np.array([bias + sum(w[c] for c in x) for x in rows])
        change = np.array([sum(s * w[c] for c, s in m) for m in moves])
        return float((share * (np.log1p(np.exp(z)) - y * z)).sum() + (w**2).sum() / 2 / len(y) + swap_weight * (change**2).mean())

    for swap_weight in (0.0, 1.0, 20.0):
        w, bias = toxicity.fit_weights(rows, moves, y, 6, swap_weight, rounds=3000)
        best = loss(w, bias, swap_weight)
        for i in range(7):
            for d in (-1e-3, 1e-3):
                u, b = w.copy(), bias
                if i < 6:
                    u[i] += d
                else:
                    b += d
                assert loss(u, b, swap_weight) > best - 1e-7, (swap_weight, i)
    assert abs(sum(s * w[c] for c, s in moves[0])) < 0.05


# ------------------------------------------------------------------ HTML
PAGES = [
    ("<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>One <b>two</b>&amp; three.<p>Four<br>five &eacute;&#233;.</article><footer>&copy; x</footer>", "Title One two& three. Four five éé."),
    ("<article><p>Body text.</p><div class='ad'>Buy now</div><aside>Side</aside><form><input>Name</form><script>var t='</p>';</script><style>p{}</style></article>", "Body text."),
    ("<main><header><h1>Head</h1><p>by A</p></header><p>Text one.</p><section id=comments><article>Nice post!</article></section></main>", "Head Text one."),
    ("<div class=cookie-notice>We use cookies</div><article class='post sidebar-layout'><p>Short.</p><ul><li>a<li>b</ul></article>", "Short. a b"),
    ("<article><p>Unclosed <i>text", "Unclosed text"),
    ("<p>" + "the cat and the dog of the house went to the sea. " * 3 + "</p><p>Short tail.</p><div>" + "buy cheap watches online today " * 5 + "</div>", " ".join(["the cat and the dog of the house went to the sea."] * 3) + " Short tail."),
    ("a < b <!-- gone", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_unmatched_closing_tags_are_linear():
    import time

    t = time.perf_counter()
    text = "the story of the house and the sea " * 6
    assert html_extract.main_text(f"<article><p>{text}</p>" + "<span>" * 60_000 + "</b>" * 60_000 + f"</span><p>{text}</p></article>") == f"{text}{text}".strip()
    assert time.perf_counter() - t < 20


PROSE = "the cat and the dog of the house went to the sea with a friend and came back. "
ADVERT = "buy cheap watches online today " * 5
BY_STOP_WORDS = [
    # cards are articles, the story is not in one
    (f"<article><h3>Card one</h3></article><article><p>Card two</p></article><div><p>{PROSE * 3}</p><p>{PROSE}</p><p>Short tail.</p></div>", f"{PROSE * 4}Short tail."),
    # an advert without a class within the article
    (f"<article><p>{PROSE * 2}</p><div>{ADVERT * 2}</div><p>{PROSE}</p></article>", (PROSE * 3).strip()),
    # a notice beside the article, and a language without listed stop words
    (f"<div>{PROSE}</div><article><p>{PROSE * 4}</p></article>", (PROSE * 4).strip()),
    (f"<article><p>{'слово за словом ' * 10}</p><p><a href=x>дальше</a></p></article>", ("слово за словом " * 10).strip()),
    (f"<p>\N{COPYRIGHT SIGN} {PROSE}</p>", f"\N{COPYRIGHT SIGN} {PROSE}".strip()),
]


@pytest.mark.parametrize(("page", "want"), BY_STOP_WORDS)
def test_stop_words_decide(page, want):
    assert html_extract.main_text(page) == want


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGES[0][0], "mine"), (1, "u", PAGES[0][0], "mine"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "_text"]
    assert [r._text for r in got.orderBy(F.col("page_id").desc_nulls_last()).collect()] == [PAGES[0][1], PAGES[0][1], ""]
    assert html_extract.extract(pages.limit(0)).count() == 0
    assert html_extract.main_text("<p>" * 20000 + "x" * 200000) == ""
