"""Record linkage: containment joins, family routers, matchers, gap mining.

A frequent word would make an equi-join on words quadratic. The containment join
is therefore anchored: a query meets only the entries that hold its rarest word,
and full containment is verified on the arrays.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .durability import durable
from .keyed import numbered

MAX_STORED, MIN_SHARE = 25, 0.5


def postings(entries: DataFrame, key: str, words: str) -> DataFrame:
    """The inverted index (token, key)."""
    return entries.select(F.explode(F.array_distinct(words)).alias("token"), F.col(key))


def containment_pairs(queries: DataFrame, entries: DataFrame, query_key: str, entry_key: str, query_words: str = "q_tokens", entry_words: str = "e_tokens") -> DataFrame:
    """(query_key, entry_key, extra): entries whose words hold all the query's,
    with the number of words beyond them. Queries without words have none."""
    wanted = queries.select(F.col(query_key), F.col(query_words).alias("__q")).where(F.size("__q") > 0)
    spread = wanted.select(query_key, F.explode("__q").alias("token"))
    index = postings(entries, entry_key, entry_words).join(spread.select("token").distinct(), "token", "left_semi")
    counts = index.groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy(query_key).orderBy(F.coalesce("n", F.lit(0)), "token")
    anchors = spread.join(counts, "token", "left").withColumn("r", F.row_number().over(rarest)).where("r = 1").select(query_key, "token")
    met = anchors.join(index, "token").select(query_key, entry_key)
    full = met.join(wanted, query_key).join(entries.select(entry_key, F.col(entry_words).alias("__e")), entry_key)
    return full.where(F.size(F.array_except("__q", "__e")) == 0).select(query_key, entry_key, F.size(F.array_except("__e", "__q")).alias("extra"))


def geography_ok(area: Column, level: Column, local_area: str, levels: list[str]) -> Column:
    return (area != local_area) | F.coalesce(level.isin(levels), F.lit(False))


def family_filters(q: str = "q", e: str = "e") -> Column:
    """What a contained entry must also meet: equal derivation and negation
    sets, equal unit symbols if the query has a unit, and a first word the query
    holds (or none)."""
    same = lambda name: F.array_sort(F.col(f"{q}_{name}")) == F.array_sort(F.col(f"{e}_{name}"))
    unit = F.col(f"{q}_units").isNull() | F.coalesce(same("units"), F.lit(False))
    head = F.col(f"{e}_head").isNull() | F.array_contains(f"{q}_tokens", F.col(f"{e}_head"))
    return same("derivation") & same("negations") & unit & head


def without_category(df: DataFrame, phrase: str, floor: int = 2) -> DataFrame:
    """``df`` with its phrase cut of a leading category, and that category (else
    ""). A head before a colon is a category if ``floor`` rows have it and words
    are left after it."""
    heads = df.select(T.category_head(F.col(phrase)).alias("__head")).where("__head IS NOT NULL").groupBy("__head").agg(F.count("*").alias("__n")).where(F.col("__n") >= floor)
    tail = T.category_tail(F.col(phrase))
    j = df.withColumn("__head", T.category_head(F.col(phrase))).join(heads, "__head", "left")
    cut = F.col("__n").isNotNull() & (F.size(T.content_words(tail)) > 0)
    named = F.when(cut, F.trim(F.regexp_extract(phrase, T.CATEGORY, 1))).otherwise("")
    return j.withColumns({phrase: F.when(cut, tail).otherwise(F.col(phrase)), "category": named}).drop("__head", "__n")


def described(df: DataFrame, phrase: str, unit: Column, side: str) -> DataFrame:
    """``df`` with what the family filters compare, columns prefixed ``side``:
    words, normal title, derivation, negations, units (null where none is
    given), and the first word."""
    c = F.col(phrase)
    return df.withColumns(
        {
            f"{side}_tokens": T.content_words(c),
            f"{side}_norm": T.norm_title(T.strip_unit(c)),
            f"{side}_derivation": T.derivation_markers(c),
            f"{side}_negations": T.negations(c),
            f"{side}_units": F.when(F.coalesce(unit, F.lit("")) != "", T.unit_markers(unit)),
            f"{side}_head": T.head_word(c),
        }
    )


def filtered_families(queries: DataFrame, entries: DataFrame, key: str, member: str, local_area: str, levels: list[str]) -> DataFrame:
    """The ranked family of each query: entries that hold all its words, agree in
    derivation, negations, unit (if it names one) and first word, and reach its
    area; exact titles first, then the fewest words beyond. ``queries`` and
    ``entries`` come from ``described``, with q_area and e_geo."""
    pairs = containment_pairs(queries, entries, key, member)
    full = pairs.join(queries, key).join(entries, member)
    # An entry without a unit disagrees with a query that has one.
    kept = full.withColumn("e_units", F.coalesce("e_units", F.array().cast("array<string>"))).where(family_filters() & geography_ok(F.col("q_area"), F.col("e_geo"), local_area, levels))
    return ranked_family(kept.withColumn("exact", F.col("q_norm") == F.col("e_norm")), key, [F.col("exact").desc(), F.col("extra"), F.col("e_norm"), F.col(member)])


def ranked_family(pairs: DataFrame, query_key: str, order: list[Column]) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(*order)))


def mode_share(rows: DataFrame, keys: list[str], value: str, position: str, name: str) -> DataFrame:
    """Per key the most frequent value (of equals the one seen first) and its
    share; the value is withheld under half."""
    return _mode(rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("p")), keys, value, name)


def _mode(counts: DataFrame, keys: list[str], value: str, name: str, **more: Column) -> DataFrame:
    out = counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("p"))).alias("v"), F.max("n").alias("n"), F.sum("n").alias("all"), *(c.alias(k) for k, c in more.items()))
    share = F.bround(F.col("n") / F.col("all"), 3)
    return out.select(*keys, F.when(F.col("n") / F.col("all") >= MIN_SHARE, F.col("v")).alias(name), share.alias(f"{name}_share"), *more)


def family_summary(scope: DataFrame, families: DataFrame, key: str, member: str, facets: list[str], labels: str | None = None, stored: int = MAX_STORED) -> DataFrame:
    """One row for every query in ``scope``, with nulls where nothing was found.

    ``families`` has key, member, rank, exact (boolean) and the facets. Facts
    cover the whole family; only the list of members is cut at ``stored``.
    """
    kept = F.array_sort(F.collect_list(F.when(F.col("rank") <= stored, F.struct("rank", F.col(member).cast("string").alias("m")))))
    extra = [F.array_join(F.slice(F.array_sort(F.collect_set(labels)), 1, 10), ",").alias(f"{labels}s")] if labels else []
    base = families.groupBy(key).agg(
        F.array_join(F.transform(kept, lambda s: s["m"]), ",").alias("candidates"),
        F.count("*").alias("n_candidates"),
        (F.count("*") > stored).alias("truncated"),
        F.count_if("exact").alias("n_exact"),
        *extra,
    )
    for facet in facets:
        base = base.join(mode_share(families, [key], facet, "rank", facet), key)
    base = base.withColumn("confidence", F.when(F.col("n_exact") > 0, "exact").otherwise("family"))
    return scope.select(key).distinct().join(base, key, "left")


def head_matches(queries: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Exact head join with a veto by tails: rows key, entry columns, vetoed.
    ``queries`` and ``entries`` have head and tail (sorted array); a tail that
    says nothing never vetoes."""
    q = queries.select(key, F.col("head"), F.col("tail").alias("q_tail"))
    e = entries.withColumnRenamed("tail", "e_tail")
    veto = (F.size("q_tail") > 0) & (F.size("e_tail") > 0) & ~F.arrays_overlap("q_tail", "e_tail")
    return q.join(e, "head").withColumn("vetoed", veto)


def route_by_head(queries: DataFrame, entries: DataFrame, key: str, member: str) -> DataFrame:
    """key, outcome (no head, vetoed, matched), n_candidates, n_vetoed,
    confidence (single, family or null)."""
    met = head_matches(queries, entries, key).groupBy(key).agg(F.count_if(~F.col("vetoed")).alias("n_candidates"), F.count_if("vetoed").alias("n_vetoed"))
    n = F.coalesce("n_candidates", F.lit(0))
    v = F.coalesce("n_vetoed", F.lit(0))
    return queries.select(key).join(met, key, "left").select(
        key,
        F.when(n > 0, "matched").when(v > 0, "vetoed").otherwise("no head").alias("outcome"),
        n.alias("n_candidates"),
        v.alias("n_vetoed"),
        F.when(n == 1, "single").when(n > 1, "family").alias("confidence"),
    )


def head_summary(queries: DataFrame, entries: DataFrame, key: str, member: str, stored: int = MAX_STORED) -> DataFrame:
    """One row for every query: its family by exact head and unopposed tail, in
    catalogue order. ``queries`` has head, tail (array), norm and filter,
    ``entries`` head, tail, position, norm, themes (array), start and end.

    Theme, periods and counts cover the whole family, only the list of members is
    cut at ``stored``. The filter is what the query asks for and nobody checked:
    filter_resolved is false.
    """
    met = head_matches(queries, entries.withColumnRenamed("norm", "e_norm"), key).where("NOT vetoed").join(queries.select(key, "norm"), key)
    exact = F.col("norm") == F.col("e_norm")
    periods = F.when(F.coalesce(F.col("start").cast("string"), F.lit("")) != "", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    base = met.groupBy(key).agg(F.count("*").alias("n_candidates"), F.count_if(exact).alias("n_exact"), F.array_join(F.array_sort(F.collect_set(periods)), ",").alias("period"))
    first = met.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("position", member))).where(F.col("rank") <= stored)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["m"]), ",")
    entry = F.struct("rank", F.col(member).cast("string").alias("m"))
    lists = first.groupBy(key).agg(listed(entry).alias("candidates"), listed(F.when(exact, entry)).alias("exact_title"))
    named = met.select(key, "position", F.posexplode("themes").alias("at", "theme")).where("theme <> ''").groupBy(key, "theme").agg(F.count("*").alias("n"), F.min(F.struct("position", "at")).alias("p"))
    themes = named.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "p", "theme")).alias("t"))
    j = queries.select(key, "filter").join(base, key, "left").join(lists, key, "left").join(themes, key, "left")
    found = F.col("n_candidates").isNotNull()
    return j.select(
        key,
        "candidates",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce(F.col("n_candidates") > stored, F.lit(False)).alias("truncated"),
        "exact_title",
        F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
        F.when(found, F.coalesce("t.theme", F.lit(""))).alias("theme"),
        F.when(found, F.bround(F.coalesce(-F.col("t.n"), F.lit(0)) / F.col("n_candidates"), 3)).alias("theme_share"),
        "period",
        "filter",
        F.when(found, False).alias("filter_resolved"),
        F.when(F.col("n_exact") > 0, "exact").when(F.col("n_candidates") == 1, "single").when(found, "family").alias("confidence"),
    )


def best_containment(queries: DataFrame, entries: DataFrame, query_key: str, entry_key: str) -> DataFrame:
    """Per query the entries with the largest share of its words, ties kept:
    query_key, entry_key, shared, share."""
    q = queries.select(query_key, F.size("q_tokens").alias("n"), F.explode("q_tokens").alias("token"))
    counts = q.join(postings(entries, entry_key, "e_tokens"), "token").groupBy(query_key, "n", entry_key).agg(F.count("*").alias("shared"))
    best = Window.partitionBy(query_key)
    return counts.withColumn("top", F.max("shared").over(best)).where("shared = top").select(query_key, entry_key, "shared", F.bround(F.col("shared") / F.col("n"), 3).alias("share"))


def candidate_edges(names: DataFrame, pool: DataFrame, max_extra: int = 2) -> DataFrame:
    """Edges (name, id, pos, extra) of the injective matcher: exact names first
    (extra -2), then exact heads before a dash (extra -1), then containment with
    few extra words, none of which turns the meaning, and equal negations."""
    n = names.select("name", T.norm_name(F.col("name")).alias("full"), T.norm_name(T.before_dash(F.col("name"))).alias("head"), T.name_tokens(T.before_dash(F.col("name"))).alias("q_tokens"))
    p = pool.select("id", "pos", F.col("pool_name"), T.norm_name(F.col("pool_name")).alias("p_full"), T.name_tokens(F.col("pool_name")).alias("e_tokens"))
    full = n.join(p, n["full"] == p["p_full"]).select("name", "id", "pos", F.lit(-2).alias("extra"))
    head = n.join(p, n["head"] == p["p_full"]).select("name", "id", "pos", F.lit(-1).alias("extra"))
    pairs = containment_pairs(n.select("name", "q_tokens"), p.select("id", "e_tokens"), "name", "id")
    joined = pairs.where(F.col("extra") <= max_extra).join(n.select("name", "q_tokens"), "name").join(p.select("id", "pos", "e_tokens"), "id")
    beyond = F.array_except("e_tokens", "q_tokens")
    contrast, no = F.array(*map(F.lit, T.CONTRAST)), F.array(F.lit("nao"), F.lit("sem"))
    fine = ~F.arrays_overlap(beyond, contrast) & (F.array_sort(F.array_intersect("q_tokens", no)) == F.array_sort(F.array_intersect("e_tokens", no)))
    near = joined.where(fine).select("name", "id", "pos", "extra")
    return full.union(head).union(near).groupBy("name", "id").agg(F.min("pos").alias("pos"), F.min("extra").alias("extra"))


def injective_match(edges: DataFrame, overrides: dict[str, int] | None = None) -> DataFrame:
    """(name, id): each name and each id at most once. Overrides first, then
    edges by fewest extra words, then name descending, then position, then id.

    Greedy: an edge that comes first among all those of its name and of its id is
    taken whatever the rest do. Each round takes all such edges and drops what
    they exclude; the first edge of all is one, so the rounds end, with the result
    of walking the edges one by one.
    """
    spark = edges.sparkSession
    fixed = spark.createDataFrame(sorted((overrides or {}).items()), "name string, id long")
    open_edges = edges.join(F.broadcast(fixed.select("name")), "name", "left_anti").join(F.broadcast(fixed.select("id")), "id", "left_anti")
    # A name counts backwards: its place among the names is what is compared.
    names = numbered(open_edges.select("name").distinct(), [F.desc("name")], "place")
    place = F.struct("extra", "place", "pos", "id")
    now, taken = durable(open_edges.select("name", "id", "extra", "pos").join(names, "name").withColumn("at", place)), []
    while now.head(1):
        by_name, by_id = (now.groupBy(c).agg(F.min("at").alias(f"{c}_first")) for c in ("name", "id"))
        both = now.join(by_name, "name").join(by_id, "id").where("at = name_first AND at = id_first").select("name", "id")
        taken.append(durable(both))
        now = durable(now.join(taken[-1].select("name"), "name", "left_anti").join(taken[-1].select("id"), "id", "left_anti"))
    out = fixed
    for some in taken:
        out = out.union(some)
    return out


def scoped_edges(names: DataFrame, pool: DataFrame, scope: str, max_extra: int = 2) -> DataFrame:
    """``candidate_edges`` within groups: a name keeps the edges to the pool of its
    ``scope``."""
    found = candidate_edges(names.select("name").distinct(), pool.select("id", "pos", "pool_name"), max_extra)
    return found.join(names.select("name", scope).distinct(), "name").join(pool.select("id", scope), ["id", scope], "left_semi").select("name", "id", "pos", "extra")


def nearest(names: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` pool entries that share the largest part of a name's words."""
    q = names.select("name", F.size("q_tokens").alias("n"), F.explode("q_tokens").alias("token"))
    shared = q.join(postings(pool, "id", "e_tokens"), "token").groupBy("name", "n", "id").agg(F.count("*").alias("shared"))
    sized = shared.join(pool.select("id", F.size("e_tokens").alias("size")), "id")
    extra = F.col("size") - F.col("shared")
    rank = Window.partitionBy("name").orderBy(F.desc(F.col("shared") / F.col("n")), F.desc(extra), "id")
    return sized.withColumn("extra", extra).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("name", "rank", "id", F.bround(F.col("shared") / F.col("n"), 3).alias("share"))


def token_carriers(rows: DataFrame, key: str, title: str, theme: str, words: str, floor: int = 8, broadcast_bytes: int = 32 << 20, known: Column | None = None) -> DataFrame:
    """Per word the rows and distinct titles that carry it and the dominant
    theme; digits and rare words left out, and words of rows that are ``known``.
    ``rows`` needs a unique, ordered ``key`` and has each word of a row once; it is
    read four times.

    Words are counted first; only what is left of them is spread by theme and by
    title, as numbers. A title of one row counts once for each of its words, so
    rows are summed up by word and theme where they lie, and only rows whose title
    others have are spread by word and title, to take off what was counted again.
    The words left and hashes of the shared titles are broadcast up to
    ``broadcast_bytes`` each (a counted size); more words are summed up with the
    others, and what has more shared titles is joined by shuffle."""

    def spread(some: DataFrame, *columns: Column | str) -> DataFrame:
        return some.select(*columns, F.explode(words).alias("token")).where(~F.col("token").rlike("^[0-9]+$"))

    fits = lambda some, text: (some.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0) <= broadcast_bytes
    knows = F.lit(False) if known is None else F.coalesce(known, F.lit(False))
    often = spread(rows, knows.alias("known")).groupBy("token").agg(F.count("*").alias("n"), F.bool_or("known").alias("known"))
    left = numbered(often.where((F.col("n") >= floor) & ~F.col("known")).select("token"), ["token"], "word")
    few = fits(left, "token")
    left = left if few else left.select("token", F.col("token").alias("word"))

    def kept(some: DataFrame) -> DataFrame:
        return some.join(F.broadcast(left), "token").drop("token") if few else some.withColumnRenamed("token", "word")

    seen = kept(spread(rows, F.col(key).alias("__k"), F.col(title).alias("__t").isNotNull().alias("named"), F.col(theme).alias("theme")))
    counts = seen.groupBy("word", "theme").agg(F.count("*").alias("n"), F.count_if("named").alias("titled"), F.min("__k").alias("p"))
    carried = _mode(counts, ["word"], "theme", "theme", series=F.sum("n"), titled=F.sum("titled"))
    titles = rows.select(F.col(title).alias("__t")).where("__t IS NOT NULL").groupBy("__t").count()
    for salt in count():  # a title's hash stands for it; where two have the same, other hashes are taken
        number = lambda t: F.xxhash64(t, F.lit(salt)).alias("number")  # noqa: E731, B023
        shared = durable(titles.groupBy(number("__t")).agg(F.count("*").alias("titles"), F.max("count").alias("most")).where("titles > 1 OR most > 1"))
        if not shared.where("titles > 1").head(1):
            break
    titled = rows.where(F.col(title).isNotNull()).select(number(title), F.col(words).alias(words))
    if shared.count() * 16 <= broadcast_bytes:
        pairs = kept(spread(titled.join(F.broadcast(shared.select("number")), "number", "left_semi"), "number"))
    else:  # numbers are dealt out, not words
        pairs = kept(spread(titled, "number")).join(shared.select("number"), "number", "left_semi")
    again = pairs.groupBy("word", "number").count().groupBy("word").agg(F.sum(F.col("count") - 1).alias("again")).where("again > 0")
    return left.join(carried, "word").join(again, "word", "left").select("token", "series", (F.col("titled") - F.coalesce("again", F.lit(0))).alias("titles"), "theme", "theme_share")


def absent_concepts(carriers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Carriers whose word the other catalogue's ``vocabulary`` (token) lacks."""
    return carriers.join(vocabulary.select("token").distinct(), "token", "left_anti")


def title_overlaps(concepts: DataFrame, rows: DataFrame, title: str, words: str) -> DataFrame:
    """(token, host, shared): how many distinct titles two concepts share; a
    frequent title is counted once."""
    titles = rows.select(F.col(title).alias("t"), F.explode(words).alias("token")).join(concepts.select("token"), "token", "left_semi").distinct()
    other = titles.select("t", F.col("token").alias("host"))
    return titles.join(other, "t").where("token <> host").groupBy("token", "host").agg(F.count("*").alias("shared"))


def collapse_synonyms(concepts: DataFrame, overlaps: DataFrame, share: float = 0.9) -> DataFrame:
    """(token, also): in order of titles, series and word, a concept joins the
    first kept one that holds ``share`` of its titles.

    Only concepts before it can be a concept's host. Each round settles those
    whose hosts before the first kept one are all settled, the first open one
    among them, so that the rounds end with the walk's result."""
    facts = concepts.select("token", "titles", "series")
    place = F.struct((-F.col("titles")).alias("t"), (-F.col("series")).alias("s"), F.col("token").alias("token"))
    places = facts.select("token", place.alias("place"))
    strong = overlaps.join(facts, "token").where(F.col("shared") >= share * F.col("titles")).select("token", "host")
    near = strong.join(places, "token").join(places.select(F.col("token").alias("host"), F.col("place").alias("at")), "host").where("at < place")
    near = durable(near.select("token", "host", "at"))
    state = durable(places.select("token", "place", F.lit(None).cast("string").alias("joins")).withColumn("done", F.lit(False)))
    while state.where("NOT done").head(1):
        hosts = near.join(state.select(F.col("token").alias("host"), "done", F.col("joins").isNull().alias("stays")), "host")
        found = hosts.groupBy("token").agg(
            F.min(F.when(F.col("done") & F.col("stays"), F.col("at"))).alias("kept"),
            F.min(F.when(~F.col("done"), F.col("at"))).alias("open"),
        )
        ready = F.col("open").isNull() | F.coalesce(F.col("kept") < F.col("open"), F.lit(False))
        state = durable(
            state.join(found, "token", "left").select("token", "place", F.coalesce("joins", F.when(ready, F.col("kept.token"))).alias("joins"), (F.col("done") | ready).alias("done"))
        )
    also = state.where("joins IS NOT NULL").groupBy(F.col("joins").alias("token")).agg(F.array_sort(F.collect_list("place")).alias("places"))
    kept = state.where("joins IS NULL").select("token").join(also, "token", "left")
    return kept.select("token", F.coalesce(F.array_join(F.transform("places", lambda p: p["token"]), ","), F.lit("")).alias("also"))
