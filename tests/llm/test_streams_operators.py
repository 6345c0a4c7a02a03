"""Token output, whitening, collocations: brute force, exact round trips and edge cases."""

import random
import struct
import zlib
from collections import Counter
from decimal import Decimal
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hourgrid.llm import collocations, feast, for_blocks, queries, token_output, whitening
from hourgrid.llm.oracle import ORACLE
from tools.oracle_check import digest, duck

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ blocks
@pytest.mark.parametrize("size,percentile", [(32, 100), (64, 50), (1024, 90), (96, 1)])
@pytest.mark.parametrize("kind", ["small", "wide", "one", "outliers"])
def test_blocks_round_trip(size, percentile, kind):
    r = np.random.default_rng(len(kind) + size)
    for n in (0, 1, 31, size, size + 1, 3 * size + 7):
        ids = {
            "small": r.integers(5, 40, n),
            "wide": r.integers(0, 2**32, n, dtype=np.uint64),
            "one": np.full(n, 77),
            "outliers": np.where(r.random(n) < 0.05, 2**32 - 1, r.integers(0, 16, n)),
        }[kind].astype(np.uint32)
        blocks = for_blocks.encode(ids, size, percentile)
        assert len(blocks) == -(-n // size)
        assert (for_blocks.decode(blocks, size) == ids).all() and len(for_blocks.decode(blocks, size)) == n


def test_width_is_the_percentile_and_outliers_are_exceptions():
    ids = np.array([10] * 57 + [17] * 4 + [1_000_000] * 3, np.uint32)  # differences 0, 7, 999990
    (block,) = for_blocks.encode(ids, 64, 95)
    base, count, exceptions, width = for_blocks.HEAD.unpack_from(block)
    assert (base, count, exceptions, width) == (10, 64, 3, 3)
    assert struct.unpack_from("<3H", block, for_blocks.HEAD.size + 4 * 3 * 2) == (61, 62, 63)
    (block,) = for_blocks.encode(ids, 64, 100)
    assert for_blocks.HEAD.unpack_from(block)[2:] == (0, 20)
    with pytest.raises(ValueError):
        for_blocks.encode(ids, 33)
    with pytest.raises(ValueError):
        for_blocks.encode(ids, 32, 0)


def test_pack_by_bits():
    r = np.random.default_rng(3)
    for width in (0, 1, 5, 17, 31, 32):
        x = r.integers(0, 1 << width, (3, 64), dtype=np.uint64).astype(np.uint32)
        words = for_blocks.pack(x, width)
        assert words.shape == (3, width, 2) and (for_blocks.unpack(words, width, 64) == x).all()
    lane = for_blocks.pack(np.arange(32, dtype=np.uint32).reshape(1, 32), 5)[0, :, 0]
    assert sum(int(w) << (32 * i) for i, w in enumerate(lane)) == sum(i << (5 * i) for i in range(32))


def test_file_is_read_by_index_and_broken_ones_raise(tmp_path):
    path = str(tmp_path / "a" / "x.pfr")
    w = for_blocks.Writer(path, 64, 90)
    r = np.random.default_rng(0)
    docs = [r.integers(0, 50_000, n).astype("<u4") for n in (0, 5, 40_000, 1, 300)]
    for k, d in zip((None, 3, 3, 7, 9), docs):
        w.add(k, d.tobytes())
    w.close()
    f = for_blocks.Reader(path)
    assert [d.tolist() for d in f.documents()] == [d.tolist() for d in docs] and f.null.tolist() == [True] + [False] * 4
    whole = np.concatenate(docs)
    reads = []
    inner = f.file
    f.file = type("F", (), {"read_at": lambda _, n, at: reads.append(n) or inner.read_at(n, at)})()
    for a, n in ((0, 1), (63, 2), (20_001, 100), (len(whole) - 1, 1), (5, 0)):
        assert (f.ids(a, n) == whole[a : a + n]).all()
    assert max(reads) < 2000
    with pytest.raises(ValueError):
        f.ids(len(whole), 1)
    data = open(path, "rb").read()
    for bad in (data[:-1], data[:50] + bytes([data[50] ^ 1]) + data[51:], data[:-60] + bytes([data[-60] ^ 1]) + data[-59:], b""):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            list(for_blocks.Reader(str(tmp_path / "bad")).documents())


ODD = [
    "a  b", "  lead", "trail  ", "\t\n x\x0by\x0cz", "don't we'll, THEY'RE!! 's 'S ''s it's,", "x" * 200 + ",,", "²³¼ 12a3 a1 ªº µm ſſ",
    "İstanbul ıI", "naïve café éx", "a\xa0b c\x85d e\x1cf", "日本語 テスト", "<|endoftext|> y <|startoftext|>z", "--- ... ,a,b,c. a.b",
    "", "   ", "ÀÉÎ ßẞ ŉ Ǆǅ", "‘q’ “w” – — € …", "a'S b'Ll. c'", "ab" + "." * 100, "é ́x",
]


def test_words_are_encoded_as_by_the_library(monkeypatch):
    lib, ours = Tokenizer.from_file(WORDS), token_output.WordTokenizer(WORDS)
    assert ours.by_word
    want = [lib.encode(t, add_special_tokens=False).ids for t in ODD]
    got = lambda: [np.frombuffer(x, "<u4").tolist() for x in ours.encode(ODD)]
    assert got() == want == got()
    monkeypatch.setattr(token_output, "CACHED_WORDS", 4)  # what is known is dropped again and again
    assert got() == want == got() and len(ours.older) < 200
    assert ours.encode([None, "one " * 50_000])[1] == ours._whole("one ") * 50_000


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["ab", "Cd.", "ef,", "gh"]) for _ in range(r.randrange(60)))) for i in range(150)]
    rows += [(7, t) for t in ODD] + [(None, None), (None, "x"), (3, None), (500, "long " * 9000)] + [(8, "same text")] * 90
    r.shuffle(rows)
    return spark.createDataFrame([(i, t, 1, "k", "p", 2) for i, t in rows], "doc_id long, text string, start long, key string, path string, row int")


@pytest.mark.parametrize("file_ids", [token_output.FILE_IDS, 400])
def test_token_files_by_brute_force(spark, texts, file_ids):
    """Every row comes back, in the order of the ids, with the ids of the library; files of any size."""
    lib = Tokenizer.from_file(WORDS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = token_output.write(texts, WORDS, file_ids=file_ids, block_ids=64).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert files.count() > (3 if file_ids > 400 else 10) and files.select("path").distinct().count() == files.count()
    got = token_output.read(files).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in texts.select("doc_id", "text").collect()]
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids + [2]
    assert Counter((r.key, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == Counter((k, tuple(ids(t))) for k, t in rows)
    assert [r.key for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    at = 0
    for r in got:
        assert (r.start, len(r.ids)) == (at, 4 * r.n_tokens)
        at += r.n_tokens
    stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    for a, n in ((0, 5), (390, 30), (len(stream) - 9000, 9000), (100, 0)):
        assert (token_output.ids_at(spark, files, a, n) == stream[a : a + n]).all()
    sums = {(r.start, r.key): r.ids_crc32 for r in token_output.checksums(files).collect()}
    assert sums == {(r.start, r.key): zlib.crc32(r.ids) for r in got}


def test_token_files_of_no_rows(texts):
    files = token_output.write(texts.limit(0), WORDS)
    assert files.count() == 0 and token_output.read(files).count() == 0


def test_op11(spark):
    lib, rows, at = Tokenizer.from_file(WORDS), [], 0
    for i, t in duck(SF).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        rows.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.op11_token_output(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, got.collect())) == rows


# ------------------------------------------------------------------ whitening
def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [np.linspace(1, 5, 30), [7.0] * 4 + [2.0] * 20, 10.0 ** -np.arange(12.0), [3.0], [1.0, 1.0 + 1e-9, 1.0 - 1e-9, 0.5, 0.1], [2.0, 2.0]])
def test_feast(values):
    v = spectrum(np.array(values, float))
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    for k in (1, 3, len(values), len(values) + 5):
        e, u = feast.largest(v, k)
        m = min(k, len(values))
        assert e.shape == (m,) and np.abs(e - want[:m]).max() < 1e-14 * 8 * want[0]
        assert np.abs(v @ u - u * e).max() < 1e-12 * want[0] and np.abs(u.T @ u - np.eye(m)).max() < 1e-12
    for a, b, n in feast.intervals(v, len(values)):
        assert n == ((want > a) & (want <= b)).sum()


@pytest.mark.parametrize("seed", range(4))
def test_inertia_counts(seed):
    r = np.random.default_rng(seed)
    v = r.standard_normal((17, 17))
    v = v + v.T
    e = np.linalg.eigvalsh(v)
    for s in np.append(r.uniform(-9, 9, 12), 0.0):
        assert feast.below(v, s) == (e < s).sum()
    zero = np.zeros((4, 4))
    zero[0, 1] = zero[1, 0] = 1  # a pivot of two rows
    assert feast.below(zero, 0.0) == 1


VECTORS = "vec_id long, embedding array<float>, key string, x int, n int, component string"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    m = r.standard_normal((300, 6)) * [3, 1, 1, 0.5, 0.2, 0.1]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(400 + i, m[3].tolist()) for i in range(200)] + [(5, m[9].tolist()), (None, m[9].tolist())]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0]), (906, [3.0, 2.5]), (907, [1.0, 2.0])]
    return spark.createDataFrame([(i, v, "k", 1, 2, "c") for i, v in rows], VECTORS)


def check_whitened(got, rows, components=16):
    """Against whole numbers, fractions and a dense eigensolver."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in enumerate(rows)}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    mean = [Fraction(s, n) for s in sums]
    z = [[c - m for c, m in zip(v, mean)] for v in fit]
    v = np.array([[float(sum(a[i] * a[j] for a in z) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    for i, row in x.items():
        if i not in rows.wanted:
            continue
        mine = sorted((r for r in got if r["row"] == i), key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, min(components, d) + 1))
        want = np.array([float(c - m) for c, m in zip(row, mean)]) @ u / np.sqrt(e)
        for r in mine:
            k = r["component"] - 1
            assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(row, sums))
            assert abs(abs(r["whitened"]) - abs(want[k])) < 1e-9 and r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    # one sign a component, for all rows
    for k in range(min(components, d)):
        signs = {np.sign(r["whitened"]) * np.sign((np.array([float(c - m) for c, m in zip(x[r["row"]], mean)]) @ u)[k]) for r in got if r["component"] == k + 1 and abs(r["whitened"]) > 1e-6}
        assert len(signs) == 1


def test_whitening_by_fractions(vectors):
    out = [r.asDict() for r in whitening.whiten(vectors).collect()]
    six = [r for r in vectors.collect() if r.embedding and len(r.embedding) == 6 and all(c is not None and np.isfinite(c) for c in r.embedding)]
    ids = [r.vec_id for r in six]
    assert Counter(r["vec_id"] for r in out) == Counter(ids * 6) + Counter({905: 1, 906: 1, 907: 1})
    once = [dict(r, row=i) for i, k in enumerate(ids) for r in out if r["vec_id"] == k and ids.count(k) == 1]
    rows = {i: r.embedding for i, r in enumerate(six)}
    check_whitened(once, Rows(rows, {r["row"] for r in once}))
    two = {r["vec_id"]: r for r in out if (r["vec_id"] or 0) > 904}
    assert two[905]["whitened"] == two[907]["whitened"] == -two[906]["whitened"] and two[905]["n"] == 2 and two[905]["explained"] == 1


class Rows(list):
    """All vectors for the fit; only the rows of ``wanted`` are held against the result."""

    def __init__(self, rows, wanted):
        super().__init__(rows[i] for i in sorted(rows))
        self.wanted = wanted


def test_whitening_of_little(spark, vectors):
    assert whitening.whiten(vectors.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    far = spark.createDataFrame([(i, [1e15 + 4096.0 * i, float(i % 3), 1e300]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(far).collect()
    # the third column is held at one value, and sums near 2**63 stay exact
    assert len(got) == 18 and all(r.identity_error < 1e-4 for r in got)
    want = np.linalg.eigvalsh(np.cov(64.0 * np.array([[4096.0 * i, i % 3] for i in range(9)]).T, bias=True))
    assert {r.component: r.explained for r in got} == pytest.approx({1: want[1] / want.sum(), 2: want[0] / want.sum()}, rel=1e-4)
    wide = spark.createDataFrame([(i, [1e13 * (i % 5)]) for i in range(10)], "vec_id long, embedding array<double>")
    assert {r.deviation is None for r in whitening.whiten(wide).collect()} == {True, False}


def test_products_are_exact():
    z = np.array([[2**40, -3], [2**40 + 1, 5]], np.int64)
    assert whitening.products(z).tolist() == [[2**80 + (2**40 + 1) ** 2, -3 * 2**40 + 5 * (2**40 + 1)], [-3 * 2**40 + 5 * (2**40 + 1), 34]]
    assert whitening.products(z[:, 1:]).tolist() == [[34]]
    assert Decimal(int(whitening.products(z)[0, 0])) > 2**63


def test_op12(spark):
    got = queries.op12_whitening(spark, SF).toPandas()
    rows = dict(duck(SF).execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(got) == 16 * len(rows)
    ids = sorted(rows)
    place = {k: i for i, k in enumerate(ids)}
    check_whitened([dict(r, row=place[r["vec_id"]]) for r in got.to_dict("records") if r["vec_id"] % 25 == 0], Rows({place[k]: rows[k] for k in ids}, {place[k] for k in ids if k % 25 == 0}))


# ------------------------------------------------------------------ collocations
def plain_phrases(rows, top=2000, least=10, share=50):
    import re

    n, f = Counter(), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in often.items():
        lang, *w = p
        if any(100 * b >= share * a for q, b in often.items() if q[0] == lang and len(q) == 4 and len(w) == 2 and tuple(w) in (q[1:3], q[2:4])):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    words = ["new", "York", "CITY", "of", "the", "a", "é", "Ä", "naïve", "\x01x", "\x1fy", "日本", "z-1", "<|>"]
    rows = []
    for _ in range(700):
        t = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " New york City "]) for _ in range(r.randrange(14)))
        rows.append((r.choice(["en", "en", "de", None]), t))
    return rows + [("en", None), ("fr", ""), ("fr", "only once here"), (None, "of the " * 3000), ("und", "the of the of " * 9), ("xx", "le la " * 12), ("yy", "p q r " * 15)] + [("en", "copy of the text")] * 40


@pytest.mark.parametrize("slices", [1 << 19, 50])
def test_collocations_by_brute_force(spark, corpus, monkeypatch, slices):
    monkeypatch.setattr(collocations, "SLICE_WORDS", slices)
    docs = spark.createDataFrame([(i, l, t, 1, 2, "w", "p", 3) for i, (l, t) in enumerate(corpus)], "doc_id int, lang string, text string, a int, f int, w1 string, phrase string, run int")
    want = plain_phrases(corpus)
    got = [tuple(r) for r in collocations.mine(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {p.count(" ") for _, _, p, *_ in got} == {1, 2}
    few = {tuple(r) for r in collocations.mine(docs, top=5).collect()}
    assert few == plain_phrases(corpus, top=5) and few < want
    odd = {tuple(r) for r in collocations.mine(docs, least=25, share=90).collect()}
    assert odd == plain_phrases(corpus, least=25, share=90)


def test_the_bit_field_changes_no_count(spark, corpus):
    """A field so small that it lets nearly all pass."""
    docs = spark.createDataFrame(corpus, "lang string, text string")
    assert {tuple(r) for r in collocations.mine(docs, field_bits=1 << 6).collect()} == plain_phrases(corpus)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).count() == 0
    rare = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert collocations.mine(rare).count() == 0


def test_many_words_in_one_slice():
    codes = np.array([3_000_000, 1, 3_000_000, -1, 1, 3_000_000, 1], np.int64)
    got, n = collocations.counted(codes, 3, 3_000_001)
    assert got.tolist() == [[1, 3_000_000, 1], [3_000_000, 1, 3_000_000]] and n.tolist() == [1, 1]


def test_op13(spark):
    df = queries.op13_collocations(spark, SF)
    cur = duck(SF).execute(ORACLE["op13_collocations"])
    cols = [d[0] for d in cur.description]
    assert df.count() > 0 and digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, cur.fetchall())[0]
