"""Each operator on odd rows, on empty tables, and against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from barloom.llm import chat, hmm, html, jaccard, langid, line_dedup, mixing, near_vectors, packing, tiff
from barloom.llm.common import components
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {n: n for e in edges[:-1] for n in e}
    for _ in range(200):
        for a, b in edges[:-1]:
            part[a] = part[b] = min(part[a], part[b])
    assert got == {n: c for n, c in part.items() if any(n in e and e[0] != e[1] for e in edges)}


# -- 1 -----------------------------------------------------------------------------------------------------


def test_html_lines():
    page = "<html><head><title>T</title></head><body><header>H</header><div class='cookie-notice'>C</div><main><h1>A &amp; B</h1><p>x<br>y<span class=ad>no</span> z<p>q</main><aside>s</aside><script>'</p>'</script>"
    lines, zones = html.text_lines(page)
    assert html.main_text(lines, zones, None, 0.5)[0] == ["A & B", "x y", "z", "q"]
    assert html.text_lines("") == ([], []) and html.text_lines("<<>< a")[0]


def test_lcs_against_table():
    random.seed(2)
    for _ in range(300):
        a, b = ([random.choice("abcde") for _ in range(random.randrange(9))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html.shared_lines(a, b)
        rest = iter(b)
        assert sum(found) == best[-1][-1] and all(x in rest for x, f in zip(a, found, strict=True) if f)


def test_html_differencing_and_odd_rows(spark):
    frame = "<div>Shop</div><div>{}</div><div>Contact</div>"
    rows = [(1, "http://h.com/a/1", frame.format("alpha beta gamma delta epsilon")), (2, "http://h.com/a/2", frame.format("eta theta iota kappa lambda")), (3, None, None), (4, "nonsense", "<p>x"), (4, "nonsense", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("id", "host", "lines", "text")})
    got = sorted((r["page_id"], r["text"]) for r in html.extract(df).collect())
    assert got == [(1, "alpha beta gamma delta epsilon"), (2, "eta theta iota kappa lambda"), (3, ""), (4, "x"), (4, "x")]
    assert html.extract(df.where("false")).count() == 0


def test_html_differencing_inside_articles(spark):
    word = lambda i: " ".join(f"{c}{i}{c}" for c in "abcdefghijklmno")
    page = "<body><div>Shop</div><article><h1>{0}</h1><div class=x1>Win a car</div><p>{0} body</p>{1}<p>Tell a friend</p></article></body>"
    # the passage stands twice in neighbouring articles only, so it is text; the other two lines are on every page
    rows = [(i, f"http://h.com/a/{i}", page.format(word(i), "<p>a quoted passage</p>" if i in (3, 4) else "")) for i in range(10)]
    rows += [(20 + i, f"http://t.com/{i}", f"<div>Shop</div><article>teaser {i}</article><div>{word(i)}</div><div>{word(i + 50)}</div>") for i in range(2)]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(10):
        assert got[i] == ("\n\n".join([word(i), f"{word(i)} body", *["a quoted passage"] * (i in (3, 4))]), 3)
    for i in range(2):
        assert got[20 + i] == (f"teaser {i}\n\n{word(i)}\n\n{word(i + 50)}", 1)


def test_html_pairs_across_ranges_and_past_copies(spark):
    word = lambda i: " ".join(f"{c}{i}{c}" for c in "abcdefghijklmno")
    # sections of two pages with a menu of their own on a host of many ranges, and copies beside their only other page
    rows = [(i, f"http://h.com/{i // 2:03}/{i}", f"<div>menu {i // 2}</div><div>{word(i)}</div>") for i in range(120)]
    rows += [(200 + i, f"http://c.com/a/{i}", f"<div>Shop</div><div>{word(7 if i else 8)}</div>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for block in (8, 2000):
        got = {r["page_id"]: r["text"] for r in html.extract(df, block=block).collect()}
        assert got == {i: word(i) for i in range(120)} | {200 + i: word(7 if i else 8) for i in range(6)}


def test_html_near_copies_keep_their_articles(spark):
    par = [" ".join(f"p{k}w{i}" for i in range(20 + k)) for k in range(6)]
    word = lambda i: " ".join(f"{c}{i}{c}" for c in "abcdefghijklmno")
    page = lambda lines, i, tag="article": "<nav>Home</nav><{0}>{1}<p>edition {2}</p></{0}>".format(tag, "".join(f"<p>{x}</p>" for x in lines), i)
    whole = lambda lines, i: "\n\n".join([*lines, f"edition {i}"])
    rows = [(i, f"http://four.com/{i}", page(par, i), whole(par, i)) for i in range(4)]
    rows += [(10 + i, f"http://div.com/{i}", page(par, i, "div"), whole(par, i)) for i in range(4)]
    # a third of a host, a hot host with hundreds of edited copies, and one frame line that all its pages have
    rows += [(20 + i, f"http://third.com/{i}", page(par, i), whole(par, i)) for i in range(4)] + [(30 + i, f"http://third.com/x/{i}", page([word(i)], i), whole([word(i)], i)) for i in range(8)]
    for i in range(400):
        own = [x if (i * 7 + k) % 10 else f"{x} edited {i}" for k, x in enumerate(par)]
        rows.append((100 + i, f"http://hot.com/a/{i:04}", page(own, i), whole(own, i)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r["page_id"]: r["text"] for r in html.extract(df, block=100).collect()}
    assert [r[0] for r in rows if got[r[0]] != r[3]] == []


def test_html_hostile_pages_take_linear_time():
    import time

    n = 250_000
    pages = ['<a "' * n, "<a b" * n, "<svg>" * (n // 5 * 4), "<div>" * (n // 2) + "</ul>" * (n // 2), "<" * 4 * n, "<!-- " * n, "<a '" * n + ">", "<p>" * n, "</svg" * n, "<style>" * n]
    for page in pages:
        began = time.process_time()
        html.text_lines(page)
        assert time.process_time() - began < 6, page[:20]  # a second or two on an idle machine
    assert html.text_lines("a<b>c</b> 1 < 2 <!-- x")[0] == ["ac 1 < 2"] and html.text_lines("x > y <i")[0] == ["x > y <i"]


# -- 2 -----------------------------------------------------------------------------------------------------


def test_vectors_recall_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    near = base[rng.integers(0, 20, 250)] + 0.02 * rng.normal(size=(250, 32))
    x = np.vstack([base, near]).astype(np.float32).astype(float)
    label = rng.integers(0, 2, len(x))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    odd = [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] + [1.0] * 31, 0), (903, x[0].tolist(), None), (904, [None] + [1.0] * 31, 0), (905, [1.0, 2.0], 0), (906, [float("inf")] + [1.0] * 31, 0), (907, x[1].tolist(), int(label[1]))]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(0) for c in ("id", "v", "near", "w")})
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, pivots=32, block=64).collect()}
    everything = np.vstack([x, x[1:2]])
    labels = np.append(label, label[1])
    unit = everything / np.linalg.norm(everything, axis=1)[:, None]
    link = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    want, ids = link.sum(axis=1), [*range(len(x)), 907]
    have = np.array([got[i]["n_links"] for i in ids])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 903, 904, 905, 906))
    assert got[907]["component_id"] == got[1]["component_id"]
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def test_vectors_of_extreme_size_and_sparse_candidates(spark):
    rows = [(i, [10.0 ** (e) * c for c in (1.0, 2.0, -3.0, 0.5)], 1) for i, e in enumerate((200, -200, 0, 307, -300))] + [(9, [1e200, -1e200, 1e200, 1e200], 1), (10, [float("inf"), 1.0, 1.0, 1.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), pivots=4).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {9: (0, 9), 10: (0, 10)}
    rng = np.random.default_rng(8)
    x, y = near_vectors.unit(rng.normal(size=(90, 8))), near_vectors.unit(rng.normal(size=(70, 8)))
    for share in (0, 0.01, 0.1, 0.9, 1):
        candidate = rng.random((90, 70)) < share
        assert (near_vectors.similar(x, y, candidate, 0.3) == (candidate & (x @ y.T >= 0.3))).all()


# -- 3 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [{"frequent": 4}, {"one_in": 1, "frequent": 3, "bucket": 1500, "centres": 1}])  # the second: many frequent tokens in many lots
def test_jaccard_against_sets(spark, odd, sizes):
    random.seed(4)
    base = [[f"t{random.randrange(4000)}" for _ in range(60)] for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(base[i % 25])
        for _ in range(random.randrange(5)):
            w[random.randrange(60)] = f"u{random.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    df = odd.select("doc_id", "text", "id", "n", "h", "token").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = jaccard.similar_texts(df, group=8, queries=4, **sizes).collect()
    data = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in data]
    part = {i: i for i, _ in sets if i is not None}
    for _ in range(12):
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and abs(len(x) - len(y)) < 60 and 100 * len(x & y) >= 75 * len(x | y):
                    part[a] = part[b] = min(part[a], part[b])
    assert len(got) == len(data)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(s), part.get(i)) for i, s in sets)
    assert jaccard.similar_texts(df.where("false")).count() == 0


def test_near_copies_beside_short_quotes_have_a_star(spark, monkeypatch):
    """Two short texts quote all of a passage but its seam: its near copies are held against one of their own size."""
    random.seed(5)
    passage = [f"p{i}" for i in range(150)]
    rows = [(1, " ".join(passage[:87])), (2, " ".join(passage[87:]))]
    for i in range(31):
        w = list(passage)
        for j in range(1 + (i > 0)):
            w[random.randrange(10, 140)] = f"u{i}x{j}"
        rows.append((10 + i, " ".join(w)))
    stars = []
    monkeypatch.setattr(jaccard, "components", lambda edges: (stars.append(edges.distinct().count()), components(edges))[1])
    got = jaccard.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), one_in=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2} | {10 + i: 10 for i in range(31)}
    assert stars[0] >= 30


# -- 4 -----------------------------------------------------------------------------------------------------


def test_line_dedup_odd_rows(spark, odd):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == odd.count() and all(r["n_dropped"] == 0 for r in got)
    many = spark.createDataFrame([(i, f"Shared \n own {i}\n\n  SHARED") for i in range(10)] + [(10, " shared"), (10, " shared"), (11, None)], "doc_id long, text string")
    by = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(many).collect())
    assert by == Counter([*((i, f" own {i}\n", 4, 2) for i in range(10)), (10, "", 1, 1), (10, "", 1, 1), (11, "", 1, 0)])
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0


def test_repeated_ids_count_as_documents(spark, tmp_path):
    """Rows are documents, in the operator as in its SQL: a line of ten rows goes, whatever their ids."""
    import duckdb

    rows = [(i // 4, f"Ten rows\nown {i}\n nine rows " if i < 9 else f"TEN rows\nown {i}") for i in range(10)] + [(3, "own 3"), (3, "own 3"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, line_dedup.op4_line_dedup(spark, str(tmp_path)).collect()), key=str)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.execute(line_dedup.ORACLE).fetchall(), key=str)
    assert sum(r[2] for r in got) == 10 and len(got) == len(rows)


# -- 5 -----------------------------------------------------------------------------------------------------


def test_targets_against_loop(spark):
    sizes = {"a": 100, "b": 4000, "c": 50, None: 900, "d": 0}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, size long, n long")).collect()}
    names = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9:
        share = left / sum(weight[k] for k in open_)
        for k in list(open_):
            target[k] += share * weight[k]
        left = 0.0
        for k in list(open_):
            if target[k] > 2 * sizes[k]:
                left += target[k] - 2 * sizes[k]
                target[k] = 2.0 * sizes[k]
                open_.discard(k)
    assert all(math.isclose(got[k], target[k], abs_tol=1e-6) for k in names)


def test_mix_near_targets_and_repeatable(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (mixing.mix(x).toPandas().sort_values(["doc_id", "copy"]).reset_index(drop=True) for x in (d, d.repartition(7)))
    assert a.equals(b) and (a.taken <= 2 * a["size"]).all()
    per = a.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), most=("size", "max"))
    assert ((per.k - per.t).abs() <= 0.5 * per.most).all()
    o = mixing.mix(odd).collect()
    assert len(o) == odd.count() and all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in o)
    assert mixing.mix(odd.where("false")).count() == 0


# -- 6 -----------------------------------------------------------------------------------------------------


def test_forward_against_all_paths():
    rng = np.random.default_rng(5)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))).T.copy())
    m.emit /= m.emit.sum(axis=0)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 2, 6)]

    def brute(s):
        total = {q: m.start[q] * m.emit[s[0], q] for q in range(3)}
        for x in s[1:]:
            total = {q: sum(total[r] * m.move[r, q] for r in range(3)) * m.emit[x, q] for q in range(3)}
        return math.log(sum(total.values()))

    counts = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    n = np.array([len(s) for s in seqs])
    assert np.allclose(hmm._in_batches(m, np.concatenate(seqs), np.cumsum(n) - n, n, counts), [brute(s) for s in seqs])
    assert np.isclose(counts[2].sum(), 13) and np.isclose(counts[1].sum(), 9) and np.isclose(counts[0].sum(), 4)


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def test_hmm_scores(spark, odd):
    d = docs(spark).select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    d = d.withColumns({c: F.lit(0) for c in ("id", "t", "row", "ids", "tail", "trains", "h", "c", "word")})
    trains = langid.remainder("doc_id", 10) != 0
    made = hmm.score_texts(d, trains, head=500, vocabulary=200, classes=64, warm_docs=100, warm_rounds=8, rounds=2, segment=50)
    got = made.toPandas()
    c, n = Counter(), 0
    for r in d.where(trains).collect():
        c.update(plain_words(r["text"]))
        n += 1
    total, v = sum(c.values()) + n, len(c) + 1
    want = {r["doc_id"]: (len(w := plain_words(r["text"])) + 1, sum(x in c for x in w) + 1, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w) + math.log10((n + 0.1) / (total + 0.1 * (v + 1)))) for r in d.collect()}
    assert Counter(got.doc_id.fillna(-1)) == Counter(-1 if r["doc_id"] is None else r["doc_id"] for r in d.collect())  # repeated rows and the null id come back
    for r in got.itertuples():
        have = want[None if r.doc_id != r.doc_id else r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*have[:2], total) and math.isclose(r.base_score, have[2], rel_tol=1e-9)
    held = got[got.doc_id.map(lambda i: i == i and zlib.crc32(str(int(i)).encode()) % 10 == 0) & (got.doc_id < 100_000)]
    assert held.score.sum() > held.base_score.sum()
    assert hmm.score_texts(d.where("false"), trains).count() == 0
    assert hmm.score_texts(d.limit(3), F.lit(False)).where("train_tokens = 0 and n_known = 0 and score < 0").count() == 3


def test_hmm_probabilities_sum_to_one(spark):
    """One-word texts, known and unknown alike, and longer ones share one unit of probability."""
    d = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "a d e")], "doc_id long, text string")
    ask = spark.createDataFrame([(10, ""), *((10 + i, w) for i, w in enumerate("abcde", 1))], "doc_id long, text string")
    got = hmm.score_texts(d.unionByName(ask), F.col("doc_id") < 10, states=2, vocabulary=2, classes=4, warm_docs=10, warm_rounds=1, rounds=2).where("doc_id >= 10").collect()
    total = sum(10 ** r["score"] for r in got)
    assert 0.1 < total < 1 and all(r["n_known"] == r["n_tokens"] for r in got)


# -- 7 -----------------------------------------------------------------------------------------------------


def test_language_held_out(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", langid.remainder("doc_id", 4) == 2)
    profiles = langid.train_profiles(d.where("not held"), "text", "lang", 300, 10_000, 11)
    held = langid.predict_language(d.where("held").select("doc_id", "lang", "text"), profiles).toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.98 and held.score.between(0, 1).all()
    got = langid.predict_language(odd, profiles).collect()
    assert len(got) == odd.count() and {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {0, 1, 2}
    assert langid.predict_language(odd.where("false"), profiles).count() == 0
    assert {r["lang_pred"] for r in langid.predict_language(odd, {}).collect()} == {"und"}


# -- 8 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trips(compression):
    rng = np.random.default_rng(6)
    pages = [rng.integers(0, 255, (37, 53), dtype=np.uint8), (rng.integers(0, 9, (20, 31, 3)) * 7000).astype(np.uint16)]
    for predictor in (1, 2):
        for tile in (None, (16, 16)):
            for order in "<>":
                back = [a for _, a in tiff.read_pages(tiff.write_pages(pages, compression, predictor, 10, tile, order))]
                assert (back[0][:, :, 0] == pages[0]).all() and (back[1] == pages[1]).all()


def test_byte_codecs():
    random.seed(7)
    for n in (0, 1, 2, 127, 128, 129, 500, 9000):
        for data in (random.randbytes(n), bytes(random.choice(b"ab ") for _ in range(n)), bytes(n)):
            assert tiff.packbits_decode(tiff.packbits_encode(data)) == data and tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_tiff_pages_odd_rows(spark, odd):
    two = tiff.write_pages([np.zeros((3, 4), np.uint8), np.ones((2, 2), np.uint8)])
    df = spark.createDataFrame([(1, bytearray(two)), (2, None), (3, bytearray(b"")), (4, bytearray(b"junk")), (5, bytearray(two[:60]))], "k long, content binary").withColumn("page", F.lit(9))
    got = tiff.tiff_pages(df, "content", ["k"]).collect()
    assert [(r["k"], r["page"], r["width"]) for r in got if r["error"] is None] == [(1, 0, 4), (1, 1, 2)] and {r["k"] for r in got if r["error"]} == {2, 3, 4, 5}
    stored = tiff.text_to_tiff(odd)
    back = tiff.tiff_pages(stored, "content", ["doc_id", "n_bytes"]).collect()
    want = Counter(hashlib.sha256((b := (r["text"] or "").encode()).ljust(max(1, -(-len(b) // 64)) * 64, b"\0")).hexdigest() for r in odd.collect())
    assert Counter(hashlib.sha256(r["pixels"]).hexdigest() for r in back) == want


def test_a_strip_that_inflates_without_end_gives_its_page():
    import resource

    bomb = zlib.compress(b"\0" * (1 << 28), 9)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert tiff._unpack(bomb, tiff.DEFLATE, 640) == bytes(640)
    assert tiff._unpack(b"\x81\x07" * 500_000, tiff.PACKBITS, 640)[:640] == b"\7" * 640
    assert tiff._unpack(tiff.lzw_encode(b"ab" * 100_000), tiff.LZW, 640)[:640] == b"ab" * 320
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kilobytes
    with pytest.raises(zlib.error):
        tiff._unpack(b"no deflate data", tiff.DEFLATE, 640)
    assert len(tiff._unpack(b"", tiff.LZW, 5)) == 0


# -- 9 -----------------------------------------------------------------------------------------------------


def test_tokenizer_agrees():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = packing.tokenizer("byte_bpe_50k.tiktoken")
    random.seed(8)
    texts = ["", " ", "a ", "  a", "a\n\nb", "\n a", "x\ty", "it's I'll", "<|endoftext|> hi", "a <|endoftext|><|endoftext|>\n b <|endoftext|", "<|endoftext|>", "日本 語\n", "a\x1cb"] + ["".join(random.choice("ab 1.,'\n\té ") for _ in range(30)) for _ in range(300)]
    for x in texts:
        assert np.frombuffer(ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_bins_against_brute_force():
    def brute(items, cap):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for j in {b: j for j, b in enumerate(bins)}.values():
                if bins[j] + items[i] <= cap:
                    go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    random.seed(9)
    for _ in range(60):
        cap = random.choice([20, 50, 100])
        items = sorted((random.randrange(1, cap + 1) for _ in range(random.randrange(1, 9))), reverse=True)
        found, bound = packing.bin_completion(Counter(items), cap)
        used = Counter(x for times, p in found for x in p for _ in range(times))
        assert used == Counter(items) and all(sum(p) <= cap for _, p in found)
        assert bound <= sum(n for n, _ in found) == brute(items, cap)


def test_bins_reach_the_bound_where_one_dive_does_not(spark):
    for seed in (54, 56, 95):
        random.seed(seed)
        cap = random.choice((60, 100, 150))
        items = Counter([random.randrange(cap // 6, cap // 2 + 5) for _ in range(random.choice((30, 45)))])
        found, bound = packing.bin_completion(items, cap)
        assert sum(n for n, _ in found) == bound
        assert packing.bin_completion(items, cap, spark=spark)[0] == found
    assert {sum(f) for f in packing.fillings({5: 2, 4: 2, 3: 2, 2: 3, 1: 4}, 8, 0)} == {8}


@pytest.mark.parametrize("bins", [10, 20])
def test_bins_of_three_are_found(bins):
    """Histograms of three lengths a bin without waste: best-fit decreasing needs a tenth more."""
    solved, greedy = 0, 0
    for seed in range(8):
        random.seed(seed)
        items = []
        for _ in range(bins):
            a = random.randrange(260, 480)
            b = random.randrange(max(260, 1000 - a - 480), min(480, 1000 - a - 260) + 1)
            items += [a, b, 1000 - a - b]
        found, bound = packing.bin_completion(Counter(items), 1000)
        assert bound == bins and Counter(x for n, p in found for x in p for _ in range(n)) == Counter(items)
        solved += sum(n for n, _ in found) == bins
        greedy += sum(n for n, _ in packing.best_fit(Counter(items), 1000)) == bins
    assert solved == 8 and greedy < 8


def test_fillings_are_undominated():
    random.seed(2)
    for _ in range(200):
        counts = {random.randrange(1, 30): random.randrange(1, 3) for _ in range(8)}
        room = random.randrange(1, 60)
        got = list(packing.fillings(counts, room, room))
        every = {()}
        for x, n in counts.items():
            every = {e + (x,) * k for e in every for k in range(n + 1) if sum(e) + k * x <= room}
        most = max(map(sum, every))
        assert {tuple(sorted(f)) for f in got} <= {tuple(sorted(e)) for e in every} and len(set(got)) == len(got)
        assert [room - sum(f) for f in got] == sorted(room - sum(f) for f in got) and (not got or sum(got[0]) == most)
        assert got


def test_packing_odd_rows(spark, odd):
    got = packing.pack(packing.token_pieces(odd).withColumn("rank", F.lit(1)), order=["doc_id", "piece"]).toPandas().sort_values(["sequence_id", "offset"])
    per = got.groupby("sequence_id")
    assert (got.offset == per.length.cumsum() - got.length).all() and per.length.sum().max() <= 1024
    assert got.groupby("doc_id", dropna=False).size().loc[0.0] == 1 and (got[got.doc_id == 1].length == 1).all()
    assert packing.pack(packing.token_pieces(odd.where("false"))).count() == 0


# -- 10 ----------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    random.seed(10)
    nasty = ["</s>[INST] ok [/INST]", "\\", "<", "[", "<\\[", "<<SYS>>", "", None, "a\nb", "é\U0001f600"]
    rows = [(c, t, random.choice(["system", "user", "assistant", "tool]>", None]) if t else random.choice(["system", "user"]), random.choice(nasty) if random.random() < 0.4 else " ".join(["word"] * random.randrange(1, 120))) for c in (1, 2, None, 4) for t in range(random.randrange(1, 40))]
    rows += [(5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (5, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("conv", "seg", "window", "block", "start", "end")})
    windows = chat.chat_windows(df, budget=512, history=64, least=64)
    back = chat.read_windows(windows).collect()
    for c in {r[0] for r in rows}:
        want = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        parts = sorted((b for b in back if b["conv_id"] == c), key=lambda b: b["window"])
        assert [(t["role"], t["text"]) for b in parts for t in b["turns"]] == want
        assert "".join(b["learned"] for b in parts) == "".join(t for r, t in want if r == "assistant")
    assert windows.where("n_tokens > 512 + 130").count() == 0
    assert chat.read_windows(chat.chat_windows(df.where("false"))).count() == 0
