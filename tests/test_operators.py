"""Operators on small tables: routers, matcher, keyed tables, gate, sources."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from catalyte.functions import text as T
from catalyte.operators import keyed as K
from catalyte.operators import linkage as L
from catalyte.operators import pages as P
from catalyte.operators import quality as Q
from catalyte.operators import search as S
from catalyte.operators.trees import tree_paths
from catalyte.sources import readers as R
from catalyte.sources import writers as W
from catalyte.streaming import incremental as I


# ---------------------------------------------------------------- linkage


def test_carriers_write_no_row_for_each_word_and_title(spark, monkeypatch):
    rng, written = random.Random(3), []
    data = [(k, rng.choice([None, "one", "two", f"t{k}", f"t{k}"]), rng.choice(["a", "b", None]), rng.sample([f"w{i}" for i in range(40)] + ["7"], 20)) for k in range(150)]
    df = spark.createDataFrame(data, "k long, t string, th string, w array<string>").repartition(3)
    monkeypatch.setattr(L, "durable", lambda x, f=L.durable: written.append(f(x)) or written[-1])
    want = {}
    for w in {w for r in data for w in r[3] if w != "7"}:
        own = [r for r in data if w in r[3]]
        by = {x: [r[0] for r in own if r[2] == x] for x in {r[2] for r in own}}
        top = max(by, key=lambda x: (len(by[x]), -min(by[x])))
        want[w] = len(own), len({r[1] for r in own} - {None}), top if len(by[top]) >= len(own) / 2 else None, round(len(by[top]) / len(own), 3)
    want = {w: x for w, x in want.items() if x[0] >= 70}
    for size in (1 << 20, 0):
        got = L.token_carriers(df, "k", "t", "th", "w", floor=70, broadcast_bytes=size).collect()
        assert len(got) == len(want) > 5
        assert {r["token"]: (r["series"], r["titles"], r["theme"], r["theme_share"]) for r in got} == want
    assert max(x.count() for x in written) == 2


def test_rare_words_of_carriers_are_dealt_once(spark):
    """Words in one row alone are counted, but not dealt out by theme and by title
    as well."""
    rng = random.Random(4)
    data = [(k, f"t{k % 50}", f"th{k % 5}", ["common", *("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=16)) for _ in range(300))]) for k in range(200)]
    df = spark.createDataFrame(data, "k long, t string, th string, w array<string>").repartition(3)
    dealt = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    df.write.format("noop").mode("overwrite").save()
    before = dealt()
    df.write.format("noop").mode("overwrite").save()
    start = dealt()
    rows = [tuple(r) for r in L.token_carriers(df, "k", "t", "th", "w").collect()]
    assert rows == [("common", 200, 50, "th0", 0.2)] or rows == [("common", 200, 50, None, 0.2)]
    own = (start - before) * 4  # ``df`` is dealt out anew each time that it is read
    assert dealt() - start - own < 2 * 16 * 300 * 200


def test_long_shared_titles_do_not_deal_words_out(spark):
    """Shared titles of more text than may be broadcast: their hashes may be, so
    the words of their rows stay where they are."""
    rng, word = random.Random(6), lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=16))
    long = [" ".join(word() for _ in range(60)) for _ in range(20)]
    data = [(k, long[k % 20], "th", ["common", *(word() for _ in range(300))]) for k in range(200)]
    df = spark.createDataFrame(data, "k long, t string, th string, w array<string>")
    dealt = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    start = dealt()
    got = [tuple(r) for r in L.token_carriers(df, "k", "t", "th", "w", broadcast_bytes=8 << 10).collect()]
    assert got == [("common", 200, 20, "th", 1.0)]
    assert dealt() - start < 1.5 * 16 * 300 * 200


def test_carriers_leave_known_words_out(spark):
    data = [(k, f"t{k}", "a", ["both", "new"] if k % 2 else ["new", "old"], k == 4) for k in range(20)] + [(20, "t", "a", ["new", "void"], None)]
    df = spark.createDataFrame(data, "k long, t string, th string, w array<string>, f boolean")
    for size in (1 << 20, 0):
        got = L.token_carriers(df, "k", "t", "th", "w", floor=1, broadcast_bytes=size, known=F.col("f")).collect()
        assert {(r["token"], r["series"], r["titles"]) for r in got} == {("both", 10, 10), ("void", 1, 1)}


def test_containment_against_brute_force(spark):
    random.seed(3)
    words = [f"w{k}" for k in range(30)]
    q = [(k, random.sample(words, random.randint(0, 3))) for k in range(40)]
    e = [(k, random.sample(words, random.randint(0, 12))) for k in range(120)]
    got = {(r["q"], r["e"], r["extra"]) for r in L.containment_pairs(spark.createDataFrame(q, "q long, q_tokens array<string>"), spark.createDataFrame(e, "e long, e_tokens array<string>"), "q", "e").collect()}
    assert got == {(a, b, len(set(y) - set(x))) for a, x in q for b, y in e if x and set(x) <= set(y)}


def _family(spark, query, titles, unit=None):
    q = spark.createDataFrame([(query, unit)], "title string, unit string")
    t, u = F.col("title"), F.col("unit")
    q = q.select(F.lit(1).alias("q"), T.content_words(t).alias("q_tokens"), T.derivation_markers(t).alias("q_derivation"), F.when(u.isNotNull(), T.unit_markers(u)).alias("q_units"), T.negations(t).alias("q_negations"))
    e = R.series_features(spark.createDataFrame([(x,) for x in titles], "title string"))
    pairs = L.containment_pairs(q, e.select(F.col("title").alias("e"), "e_tokens"), "q", "e")
    full = pairs.join(q, "q").join(e.withColumnRenamed("title", "e"), "e")
    return {r["e"] for r in full.where(L.family_filters()).select("e").collect()}


@pytest.mark.parametrize(
    ("query", "titles", "unit", "want"),
    [
        ("Despesa das famílias", ["Despesa das famílias (€)", "Despesa das empresas"], None, {"Despesa das famílias (€)"}),
        ("População residente", ["Tempo de acesso da população residente"], None, set()),
        ("Médicos", ["Médicos (N.º)", "Médicos por mil habitantes"], None, {"Médicos (N.º)"}),
        ("Resíduos", ["Resíduos não clássicos"], None, set()),
        ("Taxa de desemprego", ["Taxa de desemprego (%)", "Taxa de desemprego (N.º)"], "Proporção - %", {"Taxa de desemprego (%)"}),
        ("Casamentos", ["Casamentos (%)", "Casamentos (N.º)"], "Casamento", {"Casamentos (N.º)"}),
        ("Casamentos", ["Casamentos (%)", "Casamentos (N.º)"], None, {"Casamentos (%)", "Casamentos (N.º)"}),
        ("População com 16 a 64 anos", ["População com menos de 15 anos"], None, set()),
    ],
)
def test_family_filters(spark, query, titles, unit, want):
    assert _family(spark, query, titles, unit) == want


def test_share_is_withheld_under_half(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 2), (2, "y", 1)], "k long, v string, p long")
    got = {r["k"]: (r["m"], r["m_share"]) for r in L.mode_share(rows, ["k"], "v", "p", "m").collect()}
    assert got == {1: (None, 0.333), 2: ("y", 0.5)}


def test_summary_covers_the_whole_family(spark):
    family = spark.createDataFrame([(1, k, k, False, "t" if k > 25 else f"s{k}") for k in range(1, 61)], "q long, m long, rank int, exact boolean, theme string")
    row = L.family_summary(spark.createDataFrame([(1,), (2,)], "q long"), family, "q", "m", ["theme"]).orderBy("q").collect()
    assert row[0]["theme"] == "t" and row[0]["n_candidates"] == 60 and row[0]["truncated"] and len(row[0]["candidates"].split(",")) == 25
    assert row[1]["candidates"] is None and row[1]["confidence"] is None


def test_silence_never_vetoes(spark):
    q = spark.createDataFrame([(1, "h", []), (2, "h", ["a"]), (3, "g", ["a"])], "k long, head string, tail array<string>")
    e = spark.createDataFrame([("x", "h", ["b"])], "code string, head string, tail array<string>")
    got = {r["k"]: (r["outcome"], r["confidence"]) for r in L.route_by_head(q, e, "k", "code").collect()}
    assert got == {1: ("matched", "single"), 2: ("vetoed", None), 3: ("no head", None)}


POOL = ["Alunos do ensino superior", "Taxa de risco após transferências", "Número de empresas total geral", "Densidade de empresas", "Índice de envelhecimento", "Casamentos", "Casamentos dissolvidos por morte"]


@pytest.mark.parametrize(
    ("names", "want"),
    [
        (["Alunos do ensino não superior"], {}),
        (["Taxa de risco antes transferências"], {}),
        (["Empresas"], {"Empresas": 2}),
        (["Índice de envelhecimento — idosos por jovem"], {"Índice de envelhecimento — idosos por jovem": 4}),
        (["Casamentos", "Casamento"], {"Casamentos": 5}),
    ],
)
def test_injective(spark, names, want):
    pool = spark.createDataFrame([(k, k, n) for k, n in enumerate(POOL)], "id long, pos long, pool_name string")
    edges = L.candidate_edges(spark.createDataFrame([(n,) for n in names], "name string"), pool)
    got = {r["name"]: r["id"] for r in L.injective_match(edges).collect()}
    assert got == want and len(set(got.values())) == len(got)
    assert {r["id"] for r in L.injective_match(edges, {names[0]: 99}).where(F.col("name") == names[0]).collect()} == {99}


def test_synonyms_join_the_first_host(spark):
    concepts = spark.createDataFrame([("a", 10, 20), ("b", 9, 20), ("c", 5, 5)], "token string, titles long, series long")
    overlaps = spark.createDataFrame([("b", "a", 9), ("a", "b", 9), ("c", "b", 5), ("c", "a", 4)], "token string, host string, shared long")
    assert {(r["token"], r["also"]) for r in L.collapse_synonyms(concepts, overlaps).collect()} == {("a", "b"), ("c", "")}


def test_collapse_synonyms_is_the_ranked_walk_without_a_limit(spark):
    rng = random.Random(3)
    ranked = [(f"w{k:05}", 6000 - k // 3, 7000 - k // 2) for k in range(5_200)]
    near = {(a, b) for _ in range(9_000) for a, b in [rng.sample(range(60) if rng.random() < 0.2 else range(5_200), 2)]}
    order = sorted(ranked, key=lambda r: (-r[1], -r[2], r[0]))
    kept: dict[str, list[str]] = {}
    hosts: dict[str, set[str]] = {}
    for a, b in near:
        hosts.setdefault(ranked[a][0], set()).add(ranked[b][0])
    for token, _, _ in order:
        host = next((k for k in kept if k in hosts.get(token, ())), None)
        if host is None:
            kept[token] = []
        else:
            kept[host].append(token)
    concepts = spark.createDataFrame(ranked, "token string, titles long, series long")
    overlaps = spark.createDataFrame([(ranked[a][0], ranked[b][0], ranked[a][1]) for a, b in near], "token string, host string, shared long")
    assert {r["token"]: r["also"] for r in L.collapse_synonyms(concepts, overlaps).collect()} == {k: ",".join(v) for k, v in kept.items()}


# ---------------------------------------------------------------- keyed


def test_snapshot_diff_is_antisymmetric(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, s string")
    new = spark.createDataFrame([("a", "2"), ("c", "1"), ("n", "1")], "k string, s string")
    kinds = lambda a, b: {(r["k"], r["kind"]) for r in K.snapshot_diff(a, b, "k", "s").collect()}
    assert kinds(old, new) == {("a", "updated"), ("b", "removed"), ("n", "added")}
    assert kinds(new, old) == {("a", "updated"), ("b", "added"), ("n", "removed")}
    assert kinds(old, old) == set()


def test_agreement_is_required(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("b", "x", 2)], "k string, theme string, v long")
    c = K.collapse_agreeing(rows, "k", "theme", ["v"])
    assert {r["k"]: (r["themes"], r["agrees"]) for r in c.collect()} == {"a": (["x", "y"], True), "b": (["x"], False)}
    with pytest.raises(ValueError):
        K.require_agreement(c)


@pytest.mark.parametrize(("n", "size"), [(0, 3), (1, 3), (10, 3), (100, 7)])
def test_systematic_sample(spark, n, size):
    got = sorted(r["id"] for r in K.systematic_sample(spark.range(n), ["id"], size).collect())
    step = max(1, n // size)
    assert got == list(range(0, n, step))[:size]


def test_stream_upsert_keeps_good_records(spark, tmp_path):
    schema = "url string, v string, error string, position long"
    empty = lambda: spark.createDataFrame([], "url string, v string, error string")
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "1", None, 1), ("b", "1", None, 2)], schema).coalesce(1).write.json(source)
    run = lambda: I.upsert_stream(spark.readStream.schema(schema).json(source), str(tmp_path / "t"), "url", str(tmp_path / "c"), empty).awaitTermination()
    run()
    spark.createDataFrame([("a", None, "timeout", 1), ("b", "2", None, 2), ("c", None, "gone", 3)], schema).coalesce(1).write.mode("append").json(source)
    run()
    got = {r["url"]: (r["v"], r["error"]) for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()}
    assert got == {"a": ("1", None), "b": ("2", None), "c": (None, "gone")}


def test_tree_paths(spark):
    rows = [(0, 0, "R", "folder"), (1, 1, "A", "folder"), (2, 4, "t1", "table"), (3, 2, "B", "folder"), (4, 2, "t2", "dataset"), (5, 1, "C", "folder"), (6, 2, "t3", "table")]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, pos int, depth int, name string, kind string")
    got = {r["name"]: r["path"] for r in tree_paths(df, "g", "pos", "depth", "name", "kind").collect()}
    assert (got["t1"], got["t2"], got["t3"], got["R"]) == ("A", "A / B", "C", "R")


# ---------------------------------------------------------------- search


ROWS = [(3, "municipios", "Médicos", ""), (2, "europa", "Índice de Gini", "2025-05-05"), (5, "europa", "Zona euro", ""), (1, "portugal", "Taxa de natalidade", "2026-01-01"), (4, "portugal", "Empregados", "2025-05-05")]


def _rows(spark):
    df = spark.createDataFrame([(i, a, n, "", "", d, None, None) for i, a, n, d in ROWS], "id long, area string, name string, name_en string, description string, updated string, sources array<string>, featured array<string>")
    return S.prepare(df, "name", ["name_en", "description"], ["sources"])


@pytest.mark.parametrize(("mode", "want"), [("az", [4, 2, 3, 1, 5]), ("za", [5, 1, 3, 2, 4]), ("new", [1, 4, 2, 3, 5]), ("old", [4, 2, 1, 3, 5])])
def test_orders(spark, mode, want):
    assert [r["id"] for r in S.search(_rows(spark), mode=mode).collect()] == want


def test_random_order_survives_a_filter(spark):
    whole = [r["id"] for r in S.search(_rows(spark), mode="random").collect()]
    some = [r["id"] for r in S.search(_rows(spark), areas=["europa", "portugal"], mode="random").collect()]
    assert some == [i for i in whole if i in some] and len(some) == 4


@pytest.mark.parametrize(("query", "want"), [("medicos", {3}), ("natalidad", {1}), ("natalidda", {1}), ("gini", {2}), ("gino", set()), ("taxa gini", set()), ("empregdos", {4})])
def test_terms(spark, query, want):
    assert {r["id"] for r in S.scored(_rows(spark), query).collect()} == want


# ---------------------------------------------------------------- gate


def test_gate(spark):
    m = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.9), ("b", None, 3.0)], "metric string, area string, value double")
    t = spark.createDataFrame([("a", "min", 0.6, "x"), ("a", "min", 0.6, "y"), ("a", "min", 0.1, "z"), ("b", "max", 2.0, None), ("c", "min", 1.0, None)], "metric string, op string, limit double, area string")
    found = Q.breaches(m, t)
    assert {(r["metric"], r["area"]) for r in found.collect()} == {("a", "x"), ("a", "z"), ("b", None)}
    assert [r["metric"] for r in Q.unmeasured(m, t).collect()] == ["c"]
    with pytest.raises(Q.QualityGateError):
        Q.gate(found)
    assert Q.gate(found, strict=False).count() == 3
    with pytest.raises(Q.QualityGateError):
        Q.require(spark.range(3), {"rows": (F.count("*"), lambda n: n >= 4)})


def test_coverage_counts_empty_as_missing(spark):
    df = spark.createDataFrame([("a", "x"), ("a", ""), ("b", None)], "g string, v string")
    got = {r["g"]: (r["n"], r["v"]) for r in Q.coverage_by(df, "g", {"v": T.present(F.col("v"))}).collect()}
    assert got == {"a": (2, 0.5), "b": (1, 0.0), "ALL": (3, 0.3333)}


# ---------------------------------------------------------------- pages


def test_windows_overlap_and_stop_at_three():
    text = "Fontes " * 5
    assert [len(s) for s in P.windows_of(text, ["Fontes"])["Fontes"]] == [35, 35, 35]
    assert P.windows_of("nothing", ["Fontes"]) == {} and P.windows_of(None) == {}


def test_units_are_never_joined_over_slices(one):
    units = P.unit_candidates(F.array(F.lit("ampliado Euro (a partir de 1/1"), F.lit("tir de 1/1/1999) ver tabela completa")))
    assert one(P.first_mode(units)) == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Os valores de 2021 foram revistos pelo organismo.", "Os valores de 2021 foram revistos pelo organismo."),
        ("Quantas revistas foram revistas neste ano em Lisboa?", ""),
        ("Despesa imprevista em jornais e revistas semanais do ano.", ""),
        ("foram revistos.", ""),
        ("Última actualização: 2024-01-05 Os valores foram revistos em alta.", "Os valores foram revistos em alta."),
    ],
)
def test_revision(one, text, want):
    assert one(P.revision_of(F.lit(text))) == want


def test_record_fields(spark):
    html = (
        "<title>Portugal: Nome | Site</title><meta name=\"description\" content=\"D\"><h2>Quantas pessoas vivem em CO<sub>2</sub> ?</h2>"
        '<p>Fontes/Entidades: ABC, DEF Carregue aqui</p><p>Última actualização: 2026-02-31</p><option x value="1999"><option y value="2004">'
    )
    r = P.record_of(spark.createDataFrame([("u", html), ("v", "<title>x</title>")], "url string, html string"), "url", "html", "Site", ["Portugal"], "2026-09-15").orderBy("url").collect()
    assert (r[0]["name"], r[0]["description"], r[0]["fontes"], r[0]["question"], tuple(r[0]["period"])) == ("Nome", "D", "ABC, DEF", "Quantas pessoas vivem em CO₂?", (1999, 2004))
    assert r[0]["ultima_atualizacao"] == "" and r[0]["parse_warnings"] == ["date_shape"]
    assert r[1]["name"] == "" and r[1]["parse_warnings"] == ["title_template"] and r[1]["period"] is None


def test_featured_names():
    name, sub = "População residente", "em milhares de pessoas"
    assert P.featured_names([name + " (1)", name, "12"]) == [name]
    assert P.featured_names([name, sub, name, sub, "x"]) == [f"{name} — {sub}"]
    assert P.featured_names([name, "(6)", name, "(6)", "10"]) == [name]  # a footnote mark is no subtitle
    assert P.featured_names([name, "km2", name, "km2"]) == [name]  # nor is a short unit
    assert P.featured_names(["Simbologia", "Simbologia", "Exportar dados", "Exportar dados"]) == []
    assert P.featured_names(["valor médio mensal", "valor médio mensal", "Área total", "Área total"]) == ["Área total"]
    assert P.featured_names(["Índice", "Índice"]) == []  # under ten characters
    assert P.featured_names([name, "a", "b", name]) == [] and P.featured_names([]) == []
    assert P.featured_names([name, name, name, name]) == [name]


def test_inventory(spark):
    html = "<div class='a b'>x <b>12</b><script>no<b>1</b></script><br>y</div>"
    take = lambda h: [(r["holder"], r["text"]) for r in P.page_inventory(spark.createDataFrame([(1, h)], "k long, h string"), "k", "h").collect()]
    assert take(html) == [("b", "##"), ("div.a", "x ## y")]
    assert take("<h2>Quanto <code>CO<sub>2</sub></code> há?</h2>") == [("sub", "#"), ("code", "CO #"), ("h2", "Quanto CO # há?")]
    assert take("<p>a<param name=x>b<div>c</p>d") == [("div", "c"), ("p", "a b")]
    assert take(f"<p>{'x' * 401}</p><p>{'y' * 400}</p></i>z") == [("p", "y" * 400)]
    assert take("<svg><p>q</p></svg><p>z") == [("p", "z")] and take("") == []


def test_a_date_of_another_shape_warns(spark):
    html = "<title>Portugal: N | Site</title><p>Última atualização: hoje mesmo</p>"
    r = P.record_of(spark.createDataFrame([("u", html)], "url string, html string"), "url", "html", "Site", ["Portugal"], "2026-09-15").first()
    assert r["ultima_atualizacao"] == "" and r["parse_warnings"] == ["date_shape"]


def test_entities(spark):
    import html as html_lib

    texts = ["a &eacute;&#233;&#xE9; &euro; &lt;b&gt; &amp;amp; &quot;&#39;&apos;", "&#128; &#x95; &#0; &#1114112; &#99999999; &bogus; & &; &#; &amp", "plain", "", "&hellip;&mdash;&Omega;&hearts;"]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(T.unescape(F.col("t")).alias("x")).collect()]
    want = [html_lib.unescape(t) for t in texts]
    want[1] = want[1].replace("& &; &#; &", "& &; &#; &amp").replace("\ufffd &bogus;", "&#99999999; &bogus;")  # no semicolon, over seven digits: left alone
    assert got == want
    assert spark.range(1).select(T.unescape(F.lit("a&nbsp;b")).alias("x"), T.unescape(F.lit(None).cast("string")).alias("n")).first()[:] == ("a b", None)


# ---------------------------------------------------------------- partitioned plans


def test_sample_over_many_ranges(spark):
    """Without coalescing, ranges are several, and the sample is the same."""
    rng = random.Random(4)
    rows = [(rng.randrange(300), k) for k in range(5000)]
    want = sorted(rows)[:: 5000 // 40][:40]
    df = spark.createDataFrame(rows, "a int, b int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert sorted((r["a"], r["b"]) for r in K.systematic_sample(df, ["a", "b"], 40).collect()) == want
        assert sorted((r["rn"], r["a"], r["b"]) for r in K.numbered(df, ["a", "b"]).collect()) == [(n, *r) for n, r in enumerate(sorted(rows), 1)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_baselines(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, s string")
    none, bare = new.limit(0), spark.createDataFrame([("a", None), ("c", None)], "k string, s string")
    kinds = lambda old: {(r["k"], r["kind"]) for r in K.snapshot_changes(old, new, "k", "s").collect()}
    assert kinds(none) == set() and kinds(bare) == {("b", "added"), ("c", "removed")}
    assert kinds(spark.createDataFrame([("a", "0")], "k string, s string")) == {("a", "updated"), ("b", "added")}


def test_clamp(one):

    assert one(F.length(W.clamped(F.lit("x" * 70_000)))) == 60_000 and one(W.clamped(F.lit("x"))) == "x"
    assert one(W.clamped(F.lit("x" * 70_000))).endswith("truncated to fit)_\n")


def test_replacement_survives_a_crash(spark, tmp_path):

    df, path = spark.range(3), str(tmp_path / "t")
    df.write.json(path + ".n1")
    W.replace_path(df, path + ".n1", path)
    os.rename(path, path + ".old")  # broken off between the two renames
    W.recover(spark, path)
    assert spark.read.json(path).count() == 3 and not os.path.exists(path + ".old")
    spark.range(5).write.json(path + ".n2")
    W.replace_path(df, path + ".n2", path)
    assert spark.read.json(path).count() == 5 and not os.path.exists(path + ".old")


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {k}" + "x" * (k % 50) for k in range(3000)]
    (tmp_path / "l.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = R.numbered_lines(spark, str(tmp_path / "l.txt"))
        assert R.ordered_lines(spark, str(tmp_path / "l.txt")).select("block").distinct().count() > 3
        assert [r["line"] for r in got.orderBy("line_no").collect()] == lines and got.agg(F.max("line_no")).first()[0] == 2999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("seed", range(3))
def test_matching_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(25)}", rng.randrange(25)): (rng.randrange(-2, 3), rng.randrange(5)) for _ in range(120)}
    rows = [(n, i, x, p) for (n, i), (x, p) in edges.items()]
    fixed = {"n3": 7}
    want, used = dict(fixed), {7}
    place = {n: k for k, n in enumerate(sorted({r[0] for r in rows}, reverse=True))}
    for n, i, _, _ in sorted(rows, key=lambda r: (r[2], place[r[0]], r[3], r[1])):
        if n not in want and i not in used:
            want[n] = i
            used.add(i)
    got = L.injective_match(spark.createDataFrame(rows, "name string, id long, extra int, pos int"), fixed)
    assert {r["name"]: r["id"] for r in got.collect()} == want


# ---------------------------------------------------------------- files


def test_records_count_bad_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"url":"a","id":1}\nnot json\n\nnull\n5\n{"url":null}\n{"url":"a","id":2}\n{"url":" "}\n{"url":"b","bytes":3}\n')
    good, bad = R.records(spark, str(tmp_path / "r.jsonl"))
    assert {r["url"]: r["id"] for r in good.collect()} == {"a": 2, "b": None} and bad.count() == 5


def test_lists_and_stamps(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n\n  x  \ny\n")
    (tmp_path / "s.tsv").write_text("u\t2024-01-01\nv\t\nw\ta\tb\n")
    (tmp_path / "u.txt").write_text("https://h.org/a/x-1\nhttps://h.org/a/x\nhttp://h.org/a/y-2\n")
    assert {r["url"] for r in R.commented_list(spark, str(tmp_path / "a.txt")).collect()} == {"x", "y"}
    assert R.commented_list(spark, str(tmp_path / "none.txt")).count() == 0
    assert {r["url"]: r["lastmod"] for r in R.stamps(spark, str(tmp_path / "s.tsv")).collect()} == {"u": "2024-01-01", "v": "", "w": "a\tb"}
    assert [r["url"] for r in R.url_list(spark, str(tmp_path / "u.txt"), "h.org", ["a"]).collect()] == ["https://h.org/a/x-1"]


def test_documents_and_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a/1": {"n": 1}, "a/2": null}')
    (tmp_path / "i.tsv").write_text("Code\tU\n abc \tx\n \ty\n")
    (tmp_path / "c.csv").write_text('id,title\n1,"a ""b""\nc"\n')
    (tmp_path / "x.xml").write_text('<r><indicator id="1"><title><![CDATA[ a  b ]]></title></indicator></r>')
    assert {r["key"]: r["value"] and r["value"]["n"] for r in R.json_map(spark, str(tmp_path / "m.json"), "struct<n:int>").collect()} == {"a/1": 1, "a/2": None}
    assert [(r["Code"], r["U"]) for r in R.inventory(spark, str(tmp_path / "i.tsv")).collect()] == [("ABC", "x")]
    assert R.csv_table(spark, str(tmp_path / "c.csv"), "id int, title string").first()["title"] == 'a "b"\nc'
    assert R.xml_records(spark, str(tmp_path / "x.xml"), "indicator").first()["title"] == "a b"
    assert R.json_document(spark, str(tmp_path / "m.json"), "`a/1` struct<n:int>").first()[0]["n"] == 1


def test_toc(spark, tmp_path):
    body = 'title\tcode\ttype\n"ALL"\troot\tfolder\n"    Economy"\tec\tfolder\n"        GDP"\tgdp\tdataset\n"        short"\n"    Society"\tso\tfolder\n"        Pop"\tpop\ttable\n"        odd"\todd\tmap\n'
    (tmp_path / "toc.tsv").write_text(body)
    got = {r["code"]: r["path"] for r in R.toc(spark, str(tmp_path / "toc.tsv"), ["title", "code", "type"]).collect()}
    assert got == {"GDP": "Economy", "POP": "Society"}
    with pytest.raises(ValueError):
        R.toc(spark, str(tmp_path / "toc.tsv"), ["name", "code", "type"])


def test_conformance(spark):
    df = spark.createDataFrame([("A", "https://h/A"), ("B", "https://h/x")], "k string, u string")
    assert R.conforming(df.where("k = 'A'"), "u", "k", "https://h/{key}").count() == 1
    for bad in (df, df.limit(0)):
        with pytest.raises(ValueError):
            R.conforming(bad, "u", "k", "https://h/{key}")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", ["x", "y"], True, None), ("a", [], False, "é")], "k string, l array<string>, f boolean, n string")
    for _ in range(2):
        W.sorted_json_lines(df, str(tmp_path / "j"), "k")
    assert [r["k"] for r in spark.read.json(str(tmp_path / "j")).orderBy("k").collect()] == ["a", "b"]
    assert [r["value"] for r in W.compact_json(df.orderBy("k")).collect()] == ['{"k":"a","l":[],"f":false,"n":"é"}', '{"k":"b","l":["x","y"],"f":true}']
    W.flat_csv(df, str(tmp_path / "c"), compression="gzip")
    rows = spark.read.csv(str(tmp_path / "c"), header=True).orderBy("k").collect()
    assert (rows[1]["l"], rows[1]["f"], rows[0]["f"]) == ("x | y", "yes", None)
    for _ in range(2):
        W.append_log(df.select("k"), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 4
    first = W.write_changed(df, None, "k", F.col("k"), str(tmp_path / "w")).persist()
    assert first.count() == 2 and W.write_changed(df, first, "k", F.col("k"), str(tmp_path / "w")).count() == 0
    site = W.sitemap_document(spark.createDataFrame([("h/a&b", "2024-01-01"), ("h/c", "soon")], "u string, d string"), "u", "d").first()["value"]
    assert site == "<urlset><url><loc>h/a&amp;b</loc><lastmod>2024-01-01</lastmod></url><url><loc>h/c</loc></url></urlset>"
    assert W.markdown_table(df.select("k").orderBy("k")) == "| k |\n|---|\n| a |\n| b |"


def test_snapshot_reader(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, snapshot_date string").write.partitionBy("snapshot_date").parquet(str(tmp_path / "s"))
    assert [r["v"] for r in R.snapshot(spark, str(tmp_path / "s"), "2024-01-02").collect()] == [2]
