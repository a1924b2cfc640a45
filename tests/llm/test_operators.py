"""The operators against brute force, on tables with nulls, empty and long
texts, ties, repeated rows, no rows, and extra columns whose names clash."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalyte.llm import common, media, mixing, packing, quality, queries, simhash, suffix_dedup, token_output, topk, toxicity, url_filter

from . import brute
from ..conftest import TINY

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["sequence_id", "fingerprint", "fp", "block", "score", "predicted", "piece", "start", "length", "shard", "blob", "media", "head", "k1", "marks", "u", "v", "rank"]


def awkward(seed: int = 5) -> list[tuple]:
    """Nulls, empty and white texts, copies, near copies, shared passages, a long
    text, every other column null somewhere."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghiéß", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, short, copy = prose(70), prose(45), prose(130)
    texts = [None, "", "  \t\n ", "One", "one two three", copy, copy, copy, copy.upper(), short + " " + prose(30), prose(20) + "\n" + short, prose(8000)]
    texts += [f"{prose(rng.randint(0, 60))} {passage}\n{prose(rng.randint(0, 40))}" for _ in range(6)]
    near = prose(400).split(" ")
    for k in range(8):
        w = list(near)
        w[rng.randrange(400)] = f"x{k}"
        texts.append(" ".join(w))
    texts += [prose(rng.randint(1, 200)) + rng.choice([".", "!\n\nEnd", "  gap", " \x1c x", " 東京。"]) for _ in range(25)]
    return [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(awkward(), DOCS)
    return df.repartition(3).withColumns({c: F.lit("x") for c in CLASH}).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ---------------------------------------------------------------- helpers


def test_encoder_equals_the_tokenizer():
    e = common.encoder(queries.tokenizer_path())
    rng = random.Random(1)
    bits = [" ", "  ", "\n", ".", ",", "a", "Zb", "é", "1", "\t", "\x1c", "\x85", "\xa0", "the", "ing", "!?", "'s", "-", "<|endoftext|>", "<|", "\r", "東", "🙂", "\u0301"]
    texts = ["", " ", "a ", "  b", "it's 'tis\n's", "x" * 3000, *("".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(1500)), *(r[1] or "" for r in awkward())]
    got = e.encode(texts)
    small = common.PieceEncoder(queries.tokenizer_path(), limit=50)
    for k in range(0, len(texts), 100):
        assert small.encode(texts[k : k + 100]) == got[k : k + 100]
    for text, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60) if k % 13] + [(100, k) for k in range(200, 240)] + [(5, 5), (70, 71), (70, 71)]
    edges += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        assert got[node] == min(seen)
    assert set(got) == set(near)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_follow_content():
    a, b = common.word_hashes("x  one two\tthree"), common.word_hashes("one two three y")
    assert a[1:].tolist() == b[:3].tolist() and len(common.word_hashes(" ")) == 0
    assert common.window_hashes(a, 3)[1] == common.window_hashes(b, 3)[0] and len(common.window_hashes(a, 5)) == 0


# ---------------------------------------------------------------- op1


def test_perplexity_is_textbook_kneser_ney(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}x" for k in range(90)]
    make = lambda: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(90)], k=rng.randint(0, 120)))
    trusted = [(k, make()) for k in range(60)]
    other = [*trusted, (100, None), (101, ""), (102, "W1X w2x neverseen"), (103, "w5x"), *((200 + k, make()) for k in range(20))]
    t = spark.createDataFrame(trusted, "doc_id long, text string").repartition(3)
    for head in (0, 50, 1 << 19):
        model, counts, shards = quality.fit(t, head=head)
        d = spark.createDataFrame([(i, x, "en") for i, x in other], "doc_id long, text string, lang string").repartition(3)
        got = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(d, model, counts, shards, flush=500, group_bytes=1 << 30 if head else 100).collect()}
        perplexity = brute.kneser_ney([quality.symbols(x, model.words).tolist() for _, x in trusted], quality.SIZE, quality.discounts)
        for i, x in other:
            want = perplexity(quality.symbols(x or "", model.words).tolist())
            assert got[i] == want if want is None else got[i] == pytest.approx(want, rel=1e-4)


def test_quality_thresholds(spark, docs, none):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(12, 40)] + [(39, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and not got[0]["keep"] and got[0]["perplexity"] is None
    assert sum(got[k]["keep"] for k in range(12, 39)) >= 24
    assert all(r["keep"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"]) for r in got.values())
    assert quality.classify(none, labels).count() == 0
    untrained = quality.classify(docs, labels.where("false")).collect()
    assert {r["keep"] for r in untrained if r["n_tokens"]} == {True}


def test_tidy_drops_what_encoders_keep(spark):
    """On the worker too, where functions arrive by value."""

    def kept(batches):
        import pyarrow as pa

        from catalyte.llm import common

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._ENCODERS)] * b.num_rows, pa.int64())], names=["n"])

    for encodes, want in ((False, 0), (True, 1)):
        tidied = common.tidy(kept, encodes=encodes)

        def work(batches, tidied=tidied):
            from catalyte.llm import common

            common._ENCODERS.clear()
            common._ENCODERS["x"] = None
            yield from tidied(batches)
            common._ENCODERS.clear()

        assert [r["n"] for r in spark.range(2).coalesce(1).mapInArrow(work, "n long").collect()] == [want, want]


def test_quality_alphabet_covers_whole_texts(spark):
    """The most frequent word stands past the first 50,000 characters of one
    text; ties go by the words' bytes."""
    text = " ".join(f"filler{k:05}" for k in range(6000)) + " Late" * 3
    df = spark.createDataFrame([(1, text), (2, None), (3, "late\u00a0x \x0bß")], "doc_id long, text string")
    got = quality.choose_words(df, distinct=700)
    want = ["late", *(f"filler{k:05}" for k in range(quality.WORDS - 1))]
    assert got.tolist() == sorted(int(common.word_hashes(w)[0]) for w in want)
    assert quality.fit(df)[0].words.tolist() == got.tolist()


def naive_symbols(text: str | None, sample: list[str]) -> list[int]:
    """Symbols by the module's words: the 1,023 most frequent words of the sample
    by the order of their hashes, other words by the hash of their last three
    bytes."""
    split = lambda t: [w for w in brute.words((t or "").lower())]
    tally = Counter(w.decode() for t in sample for w in split(t))
    code = lambda b: int(common.range_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    kept = sorted(code(w.encode()) for w, _ in sorted(tally.items(), key=lambda x: (-x[1], x[0]))[:1023])
    place = {h: k + 1 for k, h in enumerate(kept)}
    return [place.get(code(w)) or 1024 + code(w[-3:]) % 1024 for w in split(text)]


def naive_discounts(counts: list[int]) -> list[float]:
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [0.0, *(d if 0 < d < k else 0.5 for k, d in enumerate(raw, 1))]


def test_quality_against_brute_force(spark):
    """Every perplexity, threshold and decision, from the texts on."""
    rng = random.Random(12)
    vocabulary = [f"{rng.choice('abcdef')}{k}{rng.choice(['ing', 'ed', 's'])}" for k in range(1500)]
    make = lambda: " ".join(rng.choices(vocabulary, weights=[1 / (k + 3) for k in range(1500)], k=rng.randint(5, 90)))
    rows = [(k, make(), rng.choice(["en", "fr", "xx"] if k > 150 else ["en", "fr"])) for k in range(190)] + [(200, " ".join(rng.choices(vocabulary, k=60)), "en"), (201, None, "en"), (202, "", None)]
    labels = [(k, 1) for k in range(150)] + [(k, 0) for k in range(140, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int"), quantile=0.9, least=1).collect()}
    out = {r["d"] for r in spark.range(140).select(F.col("id").alias("d"), F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(10)).alias("m")).where("m = 0").collect()}
    texts = {d: t for d, t, _ in rows}
    train = [texts[d] for d in range(140) if d not in out]
    assert 5 < len(out) < 30
    perplexity = brute.kneser_ney([naive_symbols(t, train) for t in train], 2048, naive_discounts)
    want = {d: perplexity(naive_symbols(t, train)) for d, t in texts.items()}
    cut = lambda values: sorted(values)[max(1, int(np.ceil(0.9 * len(values)))) - 1]
    limits = {lang: cut([want[d] for d, _, own in rows if d in out and own == lang]) for lang in ("en", "fr")}
    for d, _, lang in rows:
        limit = limits.get(lang) or cut([want[x] for x in out])
        r = got[d]
        assert r["threshold"] == pytest.approx(limit, rel=1e-4)
        if want[d] is None:
            assert r["perplexity"] is None and not r["keep"]
        else:
            assert r["perplexity"] == pytest.approx(want[d], rel=1e-4)
            if abs(want[d] / limit - 1) > 1e-3:
                assert r["keep"] == (want[d] < limit)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    for n, q in ((1, 0.99), (7, 0.5), (30_000, 0.99), (5000, 1.0)):
        values = rng.normal(size=n).round(3)  # ties
        df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0)] * 3, "k string, v double").repartition(4)
        got = {r["k"]: (r["n"], r["limit"]) for r in quality.exact_quantiles(df, "k", "v", q).collect()}
        assert got == {"a": (n, float(np.sort(values)[max(1, int(np.ceil(q * n))) - 1])), "b": (3, 1.0)}


def test_quality_of_the_test_table(spark):
    scored = queries.op1_quality(spark, TINY).join(spark.read.parquet(f"{TINY}/labels.parquet"), "doc_id")
    assert scored.where("quality = 1").agg(F.avg(F.col("keep").cast("int"))).first()[0] > 0.9


# ---------------------------------------------------------------- op2


INSULTS = ["idiot", "moron", "worthless", "pathetic"]


def _toxic_texts(n: int, seed: int):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioulnrstdm", k=rng.randint(2, 8))) for _ in range(600)]
    out = []
    for k in range(n):
        w = rng.choices(vocabulary, k=rng.randint(20, 300))
        if k % 2:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        out.append((" ".join(w), k % 2))
    return out


def test_toxicity_learns_and_shares_ngrams(spark, docs, none):
    texts, labels = zip(*_toxic_texts(400, 1), strict=True)
    model = toxicity.train(list(texts), np.array(labels))
    held, want = zip(*_toxic_texts(300, 2), strict=True)
    scorer = toxicity.Scorer(model)
    assert ((scorer(list(held)) >= 0.7) == np.array(want)).mean() > 0.95
    assert (scorer(["you idiott and moronn", "utterly worthles patheticc"]) > 0.5).all()
    few = toxicity.Scorer(model, limit=10)
    assert np.allclose(few(list(held[:20])), scorer(list(held[:20])))
    text = held[1]
    sums, counts = model.word_sums(toxicity.words_of(text))
    half = model.window // 2
    averages = [sums[s : s + model.window].sum() / counts[s : s + model.window].sum() for s in range(0, max(1, len(sums) - half), half)]
    assert scorer([text])[0] == pytest.approx(1 / (1 + np.exp(-(max(averages) + model.bias))))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] <= 0.5 and got[0]["predicted"] == 0
    assert got[5]["score"] == got[6]["score"]
    assert toxicity.score(none, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()) == sorted(d for d, r in got.items() if r["score"] < 0.7)


def naive_score(model, text: str | None) -> float:
    """The score of a text by the words of the docstring, one subword at a time."""
    mask = (1 << 64) - 1

    def spread(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & mask
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 33

    bags = []
    for word in toxicity.WORD.findall((text or "").lower()):
        codes = [ord(c) for c in f"<{word}>"]
        ids = []
        for n in (3, 4, 5):
            for at in range(len(codes) - n + 1):
                value = n
                for c in codes[at : at + n]:
                    value = (value * 0x100000001B3 + c) & mask
                ids.append(spread(value))
        ids.append(spread(sum((c + 1) * pow(common.BASE, k, 1 << 64) for k, c in enumerate(codes)) + len(codes) & mask))
        bags.append([float(model.value[i % len(model.value)]) for i in ids])
    best = []
    for at in range(0, max(1, len(bags) - model.window // 2), model.window // 2):
        some = [x for bag in bags[at : at + model.window] for x in bag]
        best.append(sum(some) / max(1, len(some)) + model.bias)
    margin = max(best) if bags else min(model.bias, 0.0)
    return 1 / (1 + np.exp(-margin))


def test_toxicity_query_against_naive_scores(spark):
    docs, labels = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~queries.held_out()))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op2_toxicity(spark, TINY).collect():
        assert r["score"] == pytest.approx(naive_score(model, texts[r["doc_id"]]), abs=1e-6)


def test_toxicity_trains_on_all_of_a_word(spark):
    """Words that differ after forty characters have buckets of their own; long
    documents do not use up the places of others."""
    a, b = toxicity.subwords(["x" * 60 + "a", "x" * 60 + "b"], 1 << 30)
    assert a[: b[0]][-1] != a[b[0] :][-1]
    rows = [(k, "long " * 20_000 if k < 40 else f"word{k} here") for k in range(60)]
    labels = spark.createDataFrame([(k, 0) for k in range(60)], "doc_id long, toxic int")
    texts, _ = toxicity.labelled_texts(spark.createDataFrame(rows, "doc_id long, text string"), labels, per_class=20)
    assert sorted(texts) == sorted(t for _, t in rows[40:])


def test_held_out_of_a_null_id(spark):
    assert spark.createDataFrame([(None,)], "doc_id long").select(queries.held_out().alias("h")).first()["h"] is False


def test_toxicity_of_one_class(spark, docs):
    labels = spark.createDataFrame([(3, 0), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).where("predicted = 1").count() == 0
    assert toxicity.labelled_texts(docs, labels)[0] == ["One"]


def test_toxicity_query(spark):
    got = queries.op2_toxicity(spark, TINY).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert len(got) == spark.read.parquet(f"{TINY}/documents.parquet").count()


# ---------------------------------------------------------------- op3


def check_packing(placed, docs, capacity):
    """Right pieces, gapless sequences, as few as best-fit decreasing makes."""
    e = common.encoder(queries.tokenizer_path())
    want = []
    for doc, text in docs:
        ids = np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in placed), key=key) == sorted(want, key=key)
    bins: dict = {}
    for r in placed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in bins.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == brute.best_fit([w[3] for w in want], capacity)


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_packing(docs, capacity):
    check_packing(packing.pack(docs, queries.tokenizer_path(), capacity).collect(), [r[:2] for r in awkward()], capacity)


def test_packing_of_repeated_rows(spark, docs, none):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]
    check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path()).collect(), rows, 2048)
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_packing_keeps_large_ids(spark):
    """Ids beyond 2**53 beside a null one in the same bucket."""
    rows = [(None, "a"), *((9007199254740993 + k, "b c") for k in range(6)), (-(1 << 63), "x"), ((1 << 63) - 1, None)]
    check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path()).collect(), rows, 2048)


def test_packing_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(queries.op3_packing(spark, TINY).collect(), rows, 2048)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 16, 100, 257])
    sizes = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice([1, 2, capacity // 2 or 1, capacity]) for _ in range(rng.randint(1, 400))]
    counts = {s: sizes.count(s) for s in sizes}
    plan, rooms, done = packing.best_fit_plan(counts, capacity), {}, {}
    for size, rank, items, per, first, offset in plan.tolist():
        assert rank == done.get(size, 0)
        done[size] = rank + items
        for k in range(items):
            spot = (first + k // per, offset + k % per * size)
            assert rooms.get(spot[0], 0) == spot[1]
            rooms[spot[0]] = spot[1] + size
    assert done == counts and max(rooms.values()) <= capacity and len(rooms) == brute.best_fit(sizes, capacity)
    assert sorted(rooms) == list(range(len(rooms)))


# ---------------------------------------------------------------- op4


URLS = [
    None, "", "no scheme", "https://Sub.EXAMPLE.net/en/1?a=1", "https://example.net/en", "https://example.net/EN/", "http://x.org/fr/2#t", "http://x.org/fr", "http://org/fr/", "http://notorg/fr/",
    "https://example.com/de/x", "https://badexample.com/de/x", "https://net/", "https://a.net", "https://a.net?q=/", "x://y://z.net/", "http://é.ORG/fr/ü", "http://u@example.com:80/de/", "a\nb://h.net/\np",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r, _ in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def check_urls(judged, urls):
    verdicts = dict(url_filter.RULES)
    assert len(judged) == len(urls)
    for r in judged:
        host, path, rule = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdicts[rule] if rule else r["verdict"] in ("allow", "block")


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    check_urls(url_filter.judge(pages).collect(), URLS)
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert url_filter.judge(pages.union(pages)).count() == 2 * len(URLS)


def naive_trees(x, y, rounds, depth, rate, bins, ridge):
    """Boosted trees, each split by trying every cut of every feature."""
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    base = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    trees = []

    def grow(rows, g, h, left):
        best, most = None, 1e-9
        if left and len(rows) > 1:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
            for j, own in enumerate(cuts):
                for cut in own:
                    low, high = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    gain = sum(g[part].sum() ** 2 / (h[part].sum() + ridge) for part in (low, high)) - whole
                    if gain > most + 1e-12:
                        best, most = (j, cut), gain
        if best is None:
            return -rate * g[rows].sum() / (h[rows].sum() + ridge)
        j, cut = best
        return j, cut, grow(rows[x[rows, j] <= cut], g, h, left - 1), grow(rows[x[rows, j] > cut], g, h, left - 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(rows):
        return np.array([base + sum(value(t, r) for t in trees) for r in rows])

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin(x)))
        trees.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-12), depth))
    return lambda rows: 1 / (1 + np.exp(-margin(rows)))


def test_trees_against_exhaustive_splits():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 4)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] + 0.3 * rng.normal(size=150) < -0.2)).astype(np.float64)
    trees = url_filter.BoostedTrees(rounds=6, depth=3, bins=8).fit(x, y)
    naive = naive_trees(x, y, 6, 3, 0.3, 8, 1.0)
    assert np.allclose(trees.probability(x), naive(x)) and np.allclose(trees.probability(x[::-1] + 0.05), naive(x[::-1] + 0.05))


def test_verdicts_without_a_rule(spark):
    """Every URL that no rule decides gets what the trees, trained again here, say."""
    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    judged = url_filter.judge(pages)
    decided = judged.where("rule IS NOT NULL").join(pages, "page_id").select("url", F.expr("CAST(verdict = 'block' AS INT)").alias("label"))
    statistics, trees = url_filter.train(decided)
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rest = judged.where("rule IS NULL").collect()
    want = trees.probability(url_filter.features([urls[r["page_id"]] or "" for r in rest], statistics))
    assert len(rest) and all(r["probability"] == pytest.approx(p, abs=1e-6) and r["verdict"] == ("block" if p >= 0.5 else "allow") for r, p in zip(rest, want, strict=True))


def test_parts_of_urls():
    assert url_filter.parts("http://A.b?x=1/y#z") == ("A.b", "", "x=1/y", "#z")
    assert url_filter.parts("http://a.b/c#d?e") == ("a.b", "/c", "", "#d?e") and url_filter.parts("a.b/c") == ("", "", "", "")
    assert url_filter.suffixes("http://A.b.c#x") == ["c", "b.c", "a.b.c"]


def test_url_query(spark):
    check_urls(queries.op4_url_filter(spark, TINY).collect(), {r[0]: r[1] for r in spark.read.parquet(f"{TINY}/pages.parquet").select("page_id", "url").collect()})


def test_trees_learn_labelled_urls(spark):
    rng = random.Random(4)
    make = lambda bad: f"http://{'cheap-' * bad}{rng.choice('abcd')}{rng.randint(0, 9)}.{'biz' if bad and rng.random() < 0.8 else 'com'}/{'/'.join(str(rng.randint(0, 9999)) for _ in range(1 + 4 * bad))}{'?a=1&b=2' * bad}"
    rows = [(make(k % 2), k % 2) for k in range(1200)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[800:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules=(), labelled=spark.createDataFrame(rows[:800], "url string, label int")).collect()}
    assert sum((got[k] == "block") == bool(y) for k, (_, y) in enumerate(rows[800:])) > 380


# ---------------------------------------------------------------- op5


def check_spans(spans, docs, n=50):
    """Spans cover exactly the repeated stretches, with their first documents."""
    live = [(d, t) for d, t in docs if d is not None]
    want = brute.repeated(live, n)
    by_text: dict = {}
    for d, t in live:
        by_text.setdefault(t or "", []).append(d)
    copied = {d: min(ds) for t, ds in by_text.items() if len(set(ds)) > 1 and len(brute.words(t)) >= n for d in ds}
    got: dict = {}
    for r in spans:
        starts = got.setdefault(r["doc_id"], {})
        assert r["is_first"] == (r["first_doc_id"] == r["doc_id"])
        for k in range(r["start"], r["start"] + r["n_words"] - n + 1):
            starts[k] = min(r["first_doc_id"], starts.get(k, r["first_doc_id"]))
    assert {d: set(s) for d, s in got.items()} == {d: set(s) for d, s in want.items()}
    for d, starts in got.items():
        for k, first in starts.items():
            # a later copy names the first copy, which names what came before it
            assert first == (copied[d] if d in copied and copied[d] != d else want[d][k])


def test_spans(docs):
    check_spans(suffix_dedup.repeated_spans(docs).collect(), [r[:2] for r in awkward()])


def test_spans_of_odd_tables(spark, none):
    w = [f"w{k}" for k in range(120)]
    at = lambda a, b: " ".join(w[a:b])
    rows = [(9, at(0, 49)), (8, at(0, 49) + " z"), (3, at(0, 50)), (4, "y " + at(0, 50)), (5, at(20, 90)), (6, at(25, 120)), (None, at(0, 120)), (7, at(0, 60)), (7, at(0, 60)), (2, None), (1, ("r " * 300))]
    check_spans(suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert suffix_dedup.repeated_spans(none).count() == 0 and suffix_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_spans_at_random(spark, seed):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(200)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(pool))
            parts += pool[a : a + rng.randint(5, 80)]
            parts += [f"u{rng.random()}" for _ in range(rng.randint(0, 5))]
        rows.append((d, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_spans(suffix_dedup.repeated_spans(df).collect(), rows)
    check_spans(suffix_dedup.repeated_spans(df, hot=3).collect(), rows)  # nearly every head is hot
    small = [(d, t) for d, t in rows if d < 30]
    few = spark.createDataFrame(small, "doc_id long, text string")
    for hot in (32_768, 6):
        check_spans(suffix_dedup.repeated_spans(few, 12, 5, hot).collect(), small, 12)


def test_words_of_equal_hash_are_told_apart(spark):
    """The polynomial hash is blind to this pair of words (Thue-Morse)."""
    one = "".join("ab"[k.bit_count() & 1] for k in range(1 << 11))
    other = one.translate(str.maketrans("ab", "ba"))
    assert common.word_hashes(one) == common.word_hashes(other)
    w = [f"w{k}" for k in range(120)]
    rows = [(1, " ".join([*w[:60], one, *w[60:]])), (2, " ".join([*w[:60], other, *w[60:]])), (3, " ".join([*w[20:60], one, *w[60:100]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (32_768, 1):
        check_spans(suffix_dedup.repeated_spans(df, hot=hot).collect(), rows)


def test_runs_of_many_suffixes(spark, monkeypatch):
    """Groups that span batches, and more rows than are compared at a time."""
    w = [f"w{k}" for k in range(70)]
    rows = [(d, " ".join([f"u{d}", *w, f"v{d}"])) for d in range(40)] + [(100 + d, " ".join(["again"] * (60 + d))) for d in range(5)]
    monkeypatch.setattr(suffix_dedup, "ROWS", 8)
    check_spans(suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect(), rows)


def test_one_id_for_two_texts(spark):
    w = [f"w{k}" for k in range(200)]
    at = lambda a, b: " ".join(w[a:b])
    rows = [(7, at(0, 60)), (7, "x " + at(100, 160)), (3, at(0, 55)), (4, "y z " + at(105, 160))]
    left = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in left.collect()) == [(3, at(0, 55)), (4, "y z " + at(105, 160)), (7, at(55, 60)), (7, "x " + at(100, 105))]


def test_without_repeats_takes_clashing_names(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(60)) + f" u{k}") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("DOC", "key", "marks", "marks_", "copy", "__marks", "__copy", "k1")})
    left = suffix_dedup.without_repeats(df)
    assert left.columns == df.columns and rows_of(left, "doc_id", "text") == [(0, rows[0][1]), (1, "u1")]


def brute_without(rows, n=50):
    """What is left of (doc, text) rows."""
    first: dict = {}
    for d, t in rows:
        first[t or ""] = min(d, first.get(t or "", d))
    want, out = brute.repeated(rows, n), {}
    for d, t in rows:
        if first[t or ""] != d and len(brute.words(t)) >= n:
            continue
        starts = [k for k, f in want.get(d, {}).items() if f != d]
        left = brute.cut(t, starts, n) if starts else t
        if not starts or left.strip():
            out[d] = left
    return out


def test_without_repeats(docs):
    rows = [r[:2] for r in awkward()]
    left = suffix_dedup.without_repeats(docs)
    assert left.schema == docs.schema
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    want = brute_without(rows)
    assert {d: t for d, (t, _) in got.items()} == want
    assert all(n == (None if t is None else len(t)) for t, n in got.values())


def test_suffix_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    check_spans(queries.op5_suffix_dedup(spark, TINY).collect(), rows)


# ---------------------------------------------------------------- op6


def check_tokens(got, docs):
    e = common.encoder(queries.tokenizer_path())
    at, want = 0, []
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_token_output(spark, docs, none):
    check_tokens(token_output.token_output(docs, queries.tokenizer_path()).collect(), [r[:2] for r in awkward()])
    assert token_output.token_output(none, queries.tokenizer_path()).count() == 0
    rows = [(None, "x"), (2, "b"), (2, "b"), (1, None)]
    check_tokens(token_output.token_output(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path()).collect(), rows)


def test_dictionary_of_long_texts(spark, tmp_path):
    """A table of long texts alone still trains one; shards follow the size."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(6000))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    token_output.write_token_blocks(df, str(tmp_path), queries.tokenizer_path(), block_bytes=10_000, shard_bytes=40_000)
    assert len(spark.read.parquet(f"{tmp_path}/dictionary").first()["dictionary"]) > 1000
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    assert blocks.select("shard").distinct().count() > 1 and blocks.count() > 4
    check_tokens(token_output.read_token_blocks(spark, str(tmp_path)).collect(), rows)


def test_sample_of_repeated_keys(spark):
    """One key holds nearly all rows: the sample still has as many as asked for."""
    df = spark.createDataFrame([(7, "x")] * 300 + [(k, "y") for k in range(100, 130)], "k long, t string")
    got = [r["k"] for r in common.lowest_by_hash(df, "k", 20, "t").collect()]
    full = [r["k"] for r in df.distinct().orderBy(F.xxhash64("k"), "k").limit(20).collect()]
    assert got == full and len(set(got)) == 20


def test_token_query(spark):
    check_tokens(queries.op6_token_output(spark, TINY).collect(), [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()])


def test_short_document_access():
    import zstandard

    rng = np.random.default_rng(0)
    rows = [(k, rng.integers(0, 60_000, n).astype("<u4").tobytes()) for k, n in enumerate([0, 1, 5000, 3, 40])]
    for width, data in ((2, rows), (4, [(None, np.array([1 << 20], "<u4").tobytes())])):
        dictionary = token_output.train_dictionary([token_output.serialize(r, width) for _, r in data])
        squeeze, sha = token_output.compressor(dictionary), hashlib.sha256(dictionary).digest()
        block = token_output.write_block([(d, len(r) // 4, squeeze.compress(token_output.serialize(r, width))) for d, r in data], width, sha)
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        assert [token_output.read_document(block, k, expand) for k in range(len(data))] == [r for _, r in data]
        assert token_output.block_index(block)[1] == sha
    with pytest.raises(ValueError):
        token_output.block_index(b"JUNK")


# ---------------------------------------------------------------- op7


def test_raking_meets_the_marginals(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    cells: dict = {}
    for r in got:
        cell = (r["source"], r["lang"], r["topic"])
        cells[cell] = cells.get(cell, 0) + r["n_tokens"]
    targets = []
    for axis in range(3):
        sums: dict = {}
        for c, v in cells.items():
            sums[c[axis]] = sums.get(c[axis], 0.0) + v
        targets.append(mixing.tempered(sums))
    factor = brute.rake(cells, targets)
    most = max(factor.values())
    for r in got:
        f = factor[r["source"], r["lang"], r["topic"]]
        assert r["factor"] == pytest.approx(f, rel=1e-6) and r["probability"] == pytest.approx(f / most, rel=1e-6)
        assert r["sampled"] == (brute.unit(r["doc_id"]) < f / most)
    texts = {r[0]: r[1] for r in awkward()}
    assert all(r["n_tokens"] == len((texts[r["doc_id"]] or "").encode().split()) for r in got)
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["sampled"])


def test_sample_shares(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randint(5, 60), rng.choice("ef"), "big" if rng.random() < 0.6 else rng.choice(["s", "t"]), None) for k in range(4000)]
    targets = {"source": {"big": 0.3, "s": 0.4, "t": 0.3}, "lang": {"e": 0.7, "f": 0.3}}
    got = [r for r in mixing.mix(spark.createDataFrame(rows, DOCS), targets).collect() if r["sampled"]]
    total = sum(r["n_tokens"] for r in got)
    for axis, shares in targets.items():
        for name, share in shares.items():
            assert sum(r["n_tokens"] for r in got if r[axis] == name) / total == pytest.approx(share, abs=0.03)
    key = lambda r: (r["source"], r["lang"], r["topic"])
    few = spark.createDataFrame(rows[:300], DOCS)
    for goal in (targets, None):
        near, far = ({key(r): r["factor"] for r in mixing.mix(few, goal, driver_cells=cells).collect()} for cells in (1000, 2))
        assert near.keys() == far.keys() and all(far[k] == pytest.approx(near[k], rel=1e-6) for k in near)


def test_sample_takes_clashing_names(docs):
    names = ["probability", "CELL_source", "cell_lang", "cell_topic", "cell_probability", "factor", "__source"]
    kept = mixing.sample(docs.withColumns({c: F.lit(1) for c in names}))
    assert kept.columns == [*docs.columns, *names]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in mixing.sample(docs).collect())


# ---------------------------------------------------------------- op8


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(0, rng.choice([0.1, 1, 3]), 24)]) for k in range(600)]
    rows += [(600 + k, [0.5] * 24) for k in range(60)]  # ties
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 24), (703, [float("inf")] * 24), (800, []), (801, [2.0]), (900, [0.0] * 24), (3, rows[3][1]), (200, rows[7][1]), (300, rows[300][1])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, score int, rank int").repartition(3)
    for options in ({}, {"seeds": 5, "block": 100, "chunk": 3}, {"seeds": 1, "block": 20, "ranges": 7, "chunk": 2}):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **options).collect())
        assert got == sorted(brute.top_k(rows))
    assert topk.top_k(df.limit(0)).count() == 0
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id IN (100, 5)")).collect()) == sorted(brute.top_k([rows[100], rows[5]]))


def test_top_k_of_large_products(spark):
    rows = [(100, [3e5, -3e5]), (1, [3e5, -3e5 + 0.001]), (2, [3e5, -3e5]), (3, [-1.0, 1.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == sorted(brute.top_k(rows))


def test_top_k_does_not_drop_or_clamp(spark):
    near = [(100, [3e6] * 2), (1, [9e5] * 2), (2, [-1e6] * 2)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(near, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == sorted(brute.top_k(near))
    for rows in ([(100, [1.0]), (1, [1e18])], [(100, [5e15]), (1, [5e15])]):
        with pytest.raises(Exception, match="does not fit a long"):
            topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_top_k_oracle(spark):
    from ..oracle import same

    same(spark, TINY, queries.op8_topk, queries.OP8)


# ---------------------------------------------------------------- op9


def check_media(got, docs):
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_media(docs, none):
    got = media.media_columns(docs).collect()
    check_media(got, [r[:2] for r in awkward()])
    by = {r["doc_id"]: r for r in got}
    assert by[5]["media_sha256"] == by[6]["media_sha256"] and by[5]["feature"] == by[6]["feature"]
    assert media.media_columns(none).count() == 0


def test_malformed_media_do_not_stop_a_job(spark):
    good = bytearray(media.encode_payload(bytes(range(64)) * 3))
    rng = random.Random(7)
    rows = [(0, 0, good)]
    frame = good.index(b"\xff\xc0")
    zero = bytearray(good)
    zero[frame + 11] = 0  # sampling factors
    rows.append((1, 0, zero))
    for k in range(2, 400):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.choice([0, 1, 0x7F, 0xC1, 0xFF, rng.randrange(256)])
        rows.append((k, 0, bad if k % 3 else bad[: rng.randrange(len(bad))]))
    got = media.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    assert len(got) == len(rows) and sum(r["payload_sha256"] is None for r in got) > 100


def test_media_digests(spark, docs):
    """What is reported of the stored form is what ``with_media`` stores."""
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.with_media(docs).collect()}
    for r in media.media_columns(docs).collect():
        data = stored[r["doc_id"]]
        image = media.Jpeg(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        grey, step = image._decode_any()[0][:, :, 0], int(image.quant[0][0])  # bit by bit, not by the fast path
        small = np.array([[min(255, max(0, round(int(v) * step / 8 + 128))) for v in row] for row in grey], np.uint8)
        assert r["feature"] == f"{image.width}x{image.height}:{media.thumbnail_hash(small)}:{zlib.crc32(small.tobytes()):08x}"


def test_media_query(spark):
    check_media(queries.op9_media(spark, TINY).collect(), [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()])


def test_broken_media_gives_nulls(spark):
    good = media.encode_payload(bytes(64))
    rows = [(1, 0, None), (2, 0, bytearray(b"junk")), (3, 0, bytearray(good[:-40])), (4, 0, bytearray(good))]
    got = {r["doc_id"]: r for r in media.media_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["media_bytes"] is None and got[2]["payload_sha256"] is None and got[3]["payload_sha256"] is None and got[2]["media_bytes"] == 4
    assert got[4]["payload_bytes"] == 64


@pytest.mark.parametrize("blocks", [1, 2, 3, 17, 400])
def test_payload_round_trip(blocks):
    data = np.random.default_rng(blocks).integers(0, 256, 64 * blocks, np.uint8).tobytes()
    for payload in (data, b"\xff" * len(data), bytes(len(data))):
        image = media.Jpeg(media.encode_payload(payload))
        fast, slow = image.decode(), image._decode_any()
        assert np.array_equal(fast[0], slow[0]) and media.payload_of(image, fast) == payload
        small = image.luminance_thumbnail(fast)
        assert small.reshape(-1)[:blocks].tolist() == list(payload[::64]) and (8 * small.shape[0], 8 * small.shape[1]) == (image.height, image.width)


def _encode_any(components, width, height, restart):
    """A plain baseline writer: runs, end-of-block, sampling, restarts."""
    sizes = list(range(12))
    ac = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
    counts = bytes([0] * 7 + [len(ac) - 1 if len(ac) <= 255 else 0, 0] + [0] * 7)
    counts = bytes([0] * 7 + [len(ac)] + [0] * 8)
    dc_codes = {s: (n, c) for n, c, s in media.huffman_codes(bytes([0, 0, 0, 12] + [0] * 12), bytes(sizes))}
    ac_codes = {s: (n, c) for n, c, s in media.huffman_codes(counts, bytes(ac))}
    most_h, most_v = max(c[1] for c in components), max(c[2] for c in components)
    out, bits = [], []

    def put(value, n):
        bits.extend(value >> (n - 1 - k) & 1 for k in range(n))

    def amplitude(v):
        n = abs(v).bit_length()
        return n, v if v > 0 else v + (1 << n) - 1

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        out.append(np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00"))
        bits.clear()

    mcu_w, mcu_h = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    last = [0] * len(components)
    for unit in range(mcu_w * mcu_h):
        if restart and unit and unit % restart == 0:
            flush()
            out.append(bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]))
            last = [0] * len(components)
        for k, (_, h, v, blocks) in enumerate(components):
            for part in range(h * v):
                b = blocks[unit // mcu_w * v + part // h, unit % mcu_w * h + part % h].tolist()
                n, a = amplitude(b[0] - last[k])
                last[k] = b[0]
                put(dc_codes[n][1], dc_codes[n][0])
                put(a, n)
                run = 0
                for x in b[1:]:
                    if not x:
                        run += 1
                        continue
                    while run > 15:
                        put(ac_codes[0xF0][1], ac_codes[0xF0][0])
                        run -= 16
                    n, a = amplitude(x)
                    put(ac_codes[run << 4 | n][1], ac_codes[run << 4 | n][0])
                    put(a, n)
                    run = 0
                if run:
                    put(ac_codes[0][1], ac_codes[0][0])
    flush()
    s = media._segment
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(components)]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v, _ in components)
    scan = bytes([len(components)]) + b"".join(bytes([i, 0x00]) for i, *_ in components) + bytes([0, 63, 0])
    return b"\xff\xd8" + s(0xDB, b"\0" + bytes([4] * 64)) + s(0xC0, frame) + s(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(sizes)) + s(0xC4, b"\x10" + counts + bytes(ac)) + (s(0xDD, restart.to_bytes(2, "big")) if restart else b"") + s(0xDA, scan) + b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize(("layout", "restart"), [([(1, 1, 1)], 0), ([(1, 1, 1)], 3), ([(1, 2, 2), (2, 1, 1), (3, 1, 1)], 0), ([(1, 2, 1), (2, 1, 1), (3, 1, 1)], 2)])
def test_general_decoder(layout, restart):
    rng = np.random.default_rng(1)
    width, height = 45, 37
    most_h, most_v = max(x[1] for x in layout), max(x[2] for x in layout)
    mcu_w, mcu_h = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    parts = []
    for name, h, v in layout:
        b = rng.integers(-200, 200, (mcu_h * v, mcu_w * h, 64)).astype(np.int16)
        b[rng.random(b.shape) < 0.85] = 0
        parts.append((name, h, v, b))
    image = media.Jpeg(_encode_any(parts, width, height, restart))
    got = image.decode()
    assert (image.width, image.height, len(got)) == (45, 37, len(layout))
    for g, (_, _, _, b) in zip(got, parts, strict=True):
        assert np.array_equal(g, b)
    assert np.array_equal(image.luminance_thumbnail(got), np.clip(np.round(parts[0][3][:, :, 0] * 4 / 8 + 128), 0, 255))


# ---------------------------------------------------------------- op10


def check_classes(got, docs, size=4):
    prints = {d: brute.simhash(t, size) for d, t in docs}
    ids = sorted(prints)
    roots = brute.components([prints[d] for d in ids])
    want = sorted((d, f"{prints[d]:016x}", ids[r]) for d, r in zip(ids, roots, strict=True))
    assert sorted(tuple(r) for r in got) == want


def test_near_duplicates(docs, none):
    check_classes(simhash.near_duplicates(docs).collect(), [r[:2] for r in awkward()])
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_query(spark):
    check_classes(queries.op10_simhash(spark, TINY).collect(), [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()])


@pytest.mark.parametrize("chunk", [4096, 8])
def test_links_join_all_close_fingerprints(spark, chunk):
    rng = random.Random(9)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        now = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            for _ in range(rng.randint(0, 5)):
                now ^= 1 << rng.randrange(64)
            fps.add(now)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long").repartition(3), chunk=chunk)
    assert all((a ^ b).bit_count() <= 4 for a, b in ((r["a"] & common.MASK64, r["b"] & common.MASK64) for r in links.collect()))
    got = {r["node"]: r["root"] for r in common.connected_components(links).collect()}
    classes: dict = {}
    for k, r in enumerate(brute.components(fps)):
        classes.setdefault(r, set()).add(signed[k][0])
    assert {frozenset(c) for c in classes.values()} == {frozenset(x for x in (s[0] for s in signed) if got.get(x, x) == root) for root in {got.get(s[0], s[0]) for s in signed}}


def similar_classes(texts):
    return brute.similar(texts)


def test_long_fingerprint_is_a_majority():
    hashes = simhash.shingle_set("a B c d e f g h i j" + " z" * 600 + " y x w v u")
    want = []
    for k in range(8):
        for byte in range(8):
            for bit in reversed(range(8)):
                votes = sum(int(common.mix(hashes + np.uint64(k))[x]) >> (8 * byte + bit) & 1 for x in range(len(hashes)))
                want.append(2 * votes > len(hashes))
    assert np.unpackbits(np.frombuffer(simhash.long_fingerprint(hashes), np.uint8)).tolist() == want
    assert simhash.long_fingerprint(simhash.shingle_set(" ")) == bytes(64)
    assert (simhash.shingle_set("A b") == simhash.shingle_set("a  B")).all()


def test_blocks_widen_with_the_rows():
    small, large = simhash.sampled_blocks(1000, 0.8), simhash.sampled_blocks(1 << 34, 0.8)
    assert small.shape[1] == 16 and large.shape[1] == 24 and len(small) < len(large)
    for blocks in (small, large):
        assert all(len(set(b)) == len(b) for b in blocks.tolist())
        assert (1 - simhash.agreement(0.8) ** blocks.shape[1]) ** len(blocks) <= simhash.MISSED
    for rows, many in ((1, 6), (1 << 30, 6), (1 << 34, 7), (1 << 40, 8)):
        cut = simhash.pieces(rows)
        assert len(cut) == many and sum(w for _, w in cut) == 64 and [a for a, _ in cut] == [sum(w for _, w in cut[:k]) for k in range(many)]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_similar_documents(docs, chunk):
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs, chunk=chunk).collect()}
    assert got == similar_classes({r[0]: r[1] for r in awkward()})
    assert len({got[k] for k in range(18, 26)}) == 1 and got[5] == got[6] == got[7]
    assert len({got[k] for k in range(26, 51)}) == 25


def test_one_of_each(spark, docs, none):
    left = simhash.one_of_each(docs)
    classes = similar_classes({r[0]: r[1] for r in awkward()})
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(classes.values()))
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b")]
    assert rows_of(simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")), "text") == [("a",), ("a",), ("b",)]
    # two texts of one id: each is judged by itself
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (5, "q r s t u v"), (3, "a b c d e f"), (6, "Q r s t u v"), (7, None), (7, " ")]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("DOC", "key", "root", "row", "stays", "a", "b", "node")}))
    assert rows_of(left.where("doc_id < 7"), "doc_id", "text") == [(3, "a b c d e f"), (5, "q r s t u v")] and left.where("doc_id = 7").count() == 1
    assert simhash.one_of_each(none).count() == 0
