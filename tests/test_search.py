from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfwise import spec
from shelfwise.functions.text import Term, match_tokens, text_match, text_match_tokens, tokenise
from shelfwise.operators import filters, index, joins, search, similar
from shelfwise.operators.similar import find_similar

NOTES = [
    (1, "Nyanserad smak med inslag av tobak, körsbär och choklad.", "Syrah"),
    (2, "Smak med tydlig ek och vanilj.", "ek"),
    (3, None, None),
    (4, "svarta vinbär, inte vinbär svarta", "röd"),
    (5, "körsbär och TOBAK. Ek-fat", "x"),
    (6, "vinbär. Svarta bär", "y"),
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(NOTES, "id INT, taste STRING, color STRING")


CASES = [
    ((Term("tobak") & Term("körsbär")).in_columns("taste").without(Term("ek").in_columns("taste")), {1}),
    ((Term("tobak") & Term("korsbar")).in_columns("taste"), {1, 5}),
    (Term("svarta vinbär"), {4}),
    (Term("SMAK") & Term("syrah"), {1}),
    (Term("ek"), {2, 5}),
    (Term("ek").in_columns("color"), {2}),
    (Term("smak").without(Term("vanilj")), {1}),
    (Term("tobak") | Term("röd"), {1, 4, 5}),
    (Term("bär"), {6}),
    (Term("!!"), set()),
    (Term("smak").in_columns("nowhere"), set()),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_boolean_text(notes, case):
    expr, want = CASES[case]
    assert {r.id for r in text_match(notes, expr, ("taste", "color")).collect()} == want
    stored = notes.select("*", tokenise(F.col("taste")).alias("tt"), tokenise(F.col("color")).alias("tc"))
    assert {r.id for r in text_match_tokens(stored, expr, {"taste": "tt", "color": "tc"}).collect()} == want


def test_nothing_negated_on_missing_text(notes):
    out = notes.filter(~match_tokens(Term("ek"), {"taste": tokenise(F.col("taste"))}))
    assert {r.id for r in out.collect()} == {1, 3, 4, 6}


def test_patterns_and_tokens_agree(spark):
    rng = random.Random(3)
    alphabet = "aAáÅo\u0301öÖnñK\u212aİiIßẞ1é \t-,.'_\u0300\u0323sΣσςeE²"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id INT, t STRING")
    stored = df.withColumn("tok", tokenise(F.col("t")))
    for word in ("a", "o", "ao", "k", "i", "n a", "e1", "ß", "o o", "σ", "as", "1", "a-o"):
        got = {r.id for r in text_match(df, Term(word), ("t",)).collect()}
        want = {r.id for r in text_match_tokens(stored, Term(word), {"t": "tok"}).collect()}
        assert got == want, (word, [rows[i] for i in sorted(got ^ want)][:5])
        assert got or word in ("e1", "as"), word


def test_index_answers_like_the_scan(spark, notes, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(index.inverted_index(notes, "id", ("taste", "color")), path, 8)
    stored = index.read_index(spark, path, 8)
    assert {r.id for r in index.search_all(stored, "id", "smak syrah").collect()} == {1}
    assert {r.id for r in index.search_any(stored, "id", "rod ek", ("color",)).collect()} == {2, 4}
    assert {r.id for r in index.search_without(stored, "id", "och", "choklad").collect()} == {2, 5}


def _products(rng, n, cats, hot):
    rows = []
    for i in range(n):
        cat = "hot" if rng.random() < hot else rng.choice(cats)
        clocks = [rng.choice([None, *range(13)]) if rng.random() < 0.5 else 5 for _ in range(4)]
        rows.append((i, cat, rng.choice([None, *[float(p) for p in range(50, 60)]]), *clocks, rng.choice([1, 1, 2]), rng.random() < 0.1))
    return rows


def _brute(rows, grapes, k, cheaper, rank):
    of = {}
    for i, g in grapes:
        of.setdefault(i, set()).add(g)
    out = {}
    defaults = (6, 6, 0, 6)
    fill = lambda r: [d if c is None else c for c, d in zip(r[3:7], defaults)]
    for r in rows:
        found = []
        for c in rows:
            if c[0] == r[0] or c[1] != r[1] or c[7] > rank or c[8]:
                continue
            if cheaper and r[2] is not None and not (c[2] is not None and c[2] < r[2]):
                continue
            shared = len(of.get(r[0], set()) & of.get(c[0], set()))
            dist = sum(abs(a - b) for a, b in zip(fill(r), fill(c)))
            found.append((-shared, dist, (0, 0.0) if c[2] is None else (1, c[2]), c[0]))
        for n, (s, d, _, i) in enumerate(sorted(found)[:k], 1):
            out[(r[0], n)] = (i, -s, d)
    return out


@pytest.mark.parametrize("seed,k,cheaper,rank,hot", [(1, 3, True, 1, 0.5), (2, 5, False, 2, 0.3), (3, 2, True, 2, 0.9), (4, 1, False, 1, 0.0)])
def test_similar_equals_brute_force(spark, seed, k, cheaper, rank, hot):
    rng = random.Random(seed)
    rows = _products(rng, 160, ["a", None], hot)
    grapes = [(i, g) for i in range(160) for g in rng.sample(["g1", "g2", "g3", "g4"], rng.choice([0, 1, 1, 2]))]
    df = spark.createDataFrame(rows, "product_id INT, cat2 STRING, price DOUBLE, clock_body INT, clock_tannin INT, "
                                     "clock_sweetness INT, clock_fruitacid INT, availability_rank INT, is_discontinued BOOLEAN")
    gdf = spark.createDataFrame(grapes, "product_id INT, grape STRING")
    got = {(r.ref_id, r["rank"]): (r.product_id, r.shared_grapes, r.distance)
           for r in find_similar(df, df, gdf, k, cheaper, rank).collect()}
    want = _brute(rows, grapes, k, cheaper, rank)
    assert got == want
    if k == 3:
        paged = find_similar(df, df, gdf, 2, cheaper, rank, offset=1).collect()
        assert {(r.ref_id, r["rank"]): (r.product_id, r.shared_grapes, r.distance) for r in paged} == {
            key: value for key, value in want.items() if key[1] > 1}


def test_candidate_counts(spark):
    rng = random.Random(9)
    rows = _products(rng, 200, ["a", None], 0.4)
    df = spark.createDataFrame([r[:3] for r in rows], "product_id INT, cat2 STRING, price DOUBLE")
    for cheaper in (True, False):
        got = {r.product_id: r.candidates for r in joins.cheaper_counts(df, df, cheaper_only=cheaper).collect()}
        want = {r[0]: sum(c[1] == r[1] and c[0] != r[0] and (not cheaper or r[2] is None or (c[2] is not None and c[2] < r[2]))
                          for c in rows) for r in rows}
        assert got == want


def test_following_next_offset_yields_every_record_once(spark):
    df = spark.range(47).selectExpr("id AS product_id", "cast(id % 5 AS double) AS price")
    seen, offset = [], 0
    while offset is not None:
        page = search.page(df, search.sort_order("price_asc"), 10, offset)
        seen += [r.product_id for r in page.items.collect()]
        meta = page.meta.first()
        assert (meta.total, meta.has_more) == (47, meta.next_offset is not None)
        offset = meta.next_offset
    assert sorted(seen) == list(range(47)) and len(seen) == 47
    past = search.page(df, search.sort_order("price_asc"), 10, 60).meta.first()
    assert (past["count"], past.has_more, past.next_offset) == (0, False, None)
    with pytest.raises(ValueError):
        search.page(df, [], 0)
    with pytest.raises(ValueError):
        search.page(df, [], 101)


def test_stock_readings(spark):
    readings = spark.createDataFrame(
        [("1001", "7116", datetime(2026, 9, 1), 200, 3), ("1001", "7116", datetime(2026, 9, 2), 404, None),
         ("1001", "20034", datetime(2026, 9, 1), 503, None), ("1001", "3", datetime(2026, 9, 1), 200, None)],
        "site_id STRING, product_id STRING, ts TIMESTAMP, status INT, stock INT")
    asked = spark.createDataFrame([("1001", p) for p in ("7116", "20034", "3", "4")], "site_id STRING, product_id STRING")
    names = spark.createDataFrame([("7116", "A")], "product_id STRING, full_name STRING")
    got = {r.product_id: (r.full_name, r.stock, r.error, r.checked) for r in search.latest_stock(readings, asked, names).collect()}
    assert got == {"7116": ("A", 0, None, True), "20034": (None, None, "stock lookup failed with status 503", True),
                   "3": (None, 0, None, True), "4": (None, None, None, False)}


def test_absence_says_nothing_before_the_launch(spark):
    pairs = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "c"), ("2", "b")], "site_id STRING, product_id STRING")
    held = spark.createDataFrame([("1", "a")], "site_id STRING, product_id STRING")
    products = spark.createDataFrame([("a", None), ("b", "2026-08-01T00:00:00"), ("c", "2026-09-11T00:00:00")], "product_id STRING, launch_date STRING")
    got = [r.carried for r in search.carried_or_unknown(pairs, held, products, datetime(2026, 8, 25)).orderBy("site_id", "product_id").collect()]
    assert got == [True, False, None, None]


def test_release_window(spark):
    rows = [("1", "2026-09-01T00:00:00", "TSE", True, False), ("2", "2026-09-15T00:00:00", "tsls", False, False),
            ("3", "2026-09-16T00:00:00", "TSE", False, False), ("4", "2026-09-05T00:00:00", "FS", False, False),
            ("5", "2026-09-05T00:00:00", "TSV", False, True)]
    df = spark.createDataFrame(rows, "product_id STRING, launch_date STRING, assortment_code STRING, is_web_launch BOOLEAN, "
                                     "is_discontinued BOOLEAN").withColumn("availability_rank", F.lit(3)).withColumn("price", F.lit(1.0))
    ids = lambda **kw: {r.product_id for r in search.releases(df, date(2026, 9, 1), **kw).collect()}
    assert ids() == {"1", "2", "4"} and ids(limited_only=True) == {"1", "2"}
    assert ids(web_launches="only") == {"1"} and ids(web_launches="exclude", end=date(2026, 9, 5)) == {"4"}
    with pytest.raises(ValueError):
        ids(end=date(2026, 8, 1))
    assert [(r.launch_day, r.products) for r in search.nearest_release_days(df, date(2026, 9, 2)).collect()] == [
        ("2026-09-05", 2), ("2026-09-15", 1), ("2026-09-16", 1)]


def test_listings_and_not_enriched(spark):
    df = spark.createDataFrame([(1, True, None), (2, True, True), (3, False, True)], "product_id INT, is_organic BOOLEAN, is_vegan BOOLEAN")
    assert [r.product_id for r in filters.dietary(df, organic=True, vegan=True).collect()] == [2]
    child = spark.createDataFrame([(1, "x"), (None, "x")], "product_id INT, v STRING")
    assert {r.product_id for r in filters.having_not(df, child, "product_id", "v", "x").collect()} == {2, 3}
    assert len(spec.LIST_COLUMNS) == 18


def test_plans_push_filters_and_prune_columns(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["profile_by"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan.split("ReadSchema")[1]
    paged = entry.queries()["sort_price_asc"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in paged
    for name in ("find_similar", "candidate_counts", "dedupe_run", "coverage_audit", "upsert"):
        text = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_patterns_and_tokens_agree(spark):
    """Searching the text and searching its tokens give the same rows, whatever marks and scripts."""
    rng = random.Random(9)
    words = ["ek", "Ek", "EK", "xek", "e\u0301k", "x" + "\u0301" * 9 + "ek", "\u0301ek", "ekar", "körsbär", "KÖRSBÄR", "korsbar", "ԲԱՐԵՎ", "բարև", "ﬁek", "ｅｋ", "ＥＫ", "𐐀", "𐐨", "7ek", "ek7"]
    texts = [rng.choice(["", " ", "-", "."]).join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(400)] + words + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").withColumn("tok", tokenise(F.col("t")))
    for term in ("ek", "körsbär", "korsbar ek", "ԲԱՐԵՎ", "ｅｋ", "𐐀", "xek"):
        by_pattern = {r.i for r in text_match(df, Term(term), ("t",)).collect()}
        assert by_pattern == {r.i for r in text_match_tokens(df, Term(term), {"t": "tok"}).collect()}, term
        assert by_pattern


def test_similarity_sorts_no_lists_with_references_and_no_undealt_entries(spark, sf_dir):
    import __spark_entry__ as entry

    for name in ("find_similar", "find_similar_any_price"):
        execution = entry.queries()[name](spark, sf_dir)._jdf.queryExecution()
        plan = execution.optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Project [" in line and "near#" in line and " id#" in line.replace("[", " ")]
        assert "REPARTITION_BY_COL" in execution.executedPlan().toString()


def test_similarity_sends_no_rows_per_product_to_the_driver(spark):
    """Files are small where products repeat: by their estimate the grape sets, the references and the cells of many products are broadcast."""
    products = spark.createDataFrame(_products(random.Random(3), 60, ["a", None], 0.4), "product_id INT, cat2 STRING, price DOUBLE, clock_body INT, "
                                     "clock_tannin INT, clock_sweetness INT, clock_fruitacid INT, availability_rank INT, is_discontinued BOOLEAN")
    grapes = spark.createDataFrame([(i, f"g{i % 3}") for i in range(60)], "product_id INT, grape STRING")
    plans = [similar._cells(products, similar.grape_sets(grapes), "product_id", "cat2")] + [
        find_similar(products, products, grapes, 3, cheaper) for cheaper in (True, False)]
    for df in plans:
        joins_of = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line]
        per_product = [line for line in joins_of if "_gkey#" in line or "s_set#" in line]
        assert per_product and not [line for line in per_product if "SortMergeJoin" not in line]
