"""Golden cases of operators that the given tables don't reach."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewheel.functions import text as T
from tidewheel.functions import urls as U
from tidewheel.operators import enrich, normalize, reconcile
from tidewheel.plans import catalog


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_canonical_url(spark):
    get = lambda u: one(spark, U.canonical(F.lit(u)))
    assert get("webcal://WWW.Example.org/a/?utm_source=x&b=1#f") == "https://example.org/a/?b=1"
    assert get("https://example.org/") == "https://example.org"
    assert get("ftp://example.org/") is None


def test_scrub(spark):
    s = one(spark, U.scrub(F.lit("at https://us02.zoom.us/j/1 and https://zoom.us/pricing.")))
    assert s.join_url == "https://us02.zoom.us/j/1" and s.text == f"at {U.SHARED_LATER} and https://zoom.us/pricing."


def test_description(spark):
    assert one(spark, T.clean_description(F.lit('<p>Hi <b>you</b></p><p><a href="http://x.y">z</a></p>'))) == "Hi **you**\n\n[z](http://x.y)"


def test_normalize(spark):
    schema = "external_id string, name string, start string, end string, tz string, all_day boolean, description string, location string, url string, tags array<string>"
    raw = spark.createDataFrame(
        [
            ("a", "Jazz night", "2026-07-01T19:00:00", "2026-07-01T18:00:00", None, False, "Join https://zoom.us/j/9", "Hall", None, ["Music", " "]),
            ("b", "Fair", "2026-03-08", None, "America/Denver", True, None, None, "https://www.x.org/f/", None),
            ("c", " ", "2026-03-08", None, None, False, None, None, None, None),
            ("d", "Talk", "soon", None, None, False, None, None, None, None),
        ],
        schema,
    )
    good, bad = normalize.normalize(raw, "America/Denver")
    g = {r.external_id: r for r in good.collect()}
    assert str(g["a"].starts_at) == "2026-07-02 01:00:00" and g["a"].ends_at is None and g["a"].mode == "hybrid" and g["a"].tags == ["music"] and g["a"].tz_inferred
    assert str(g["b"].starts_at) == "2026-03-08 07:00:00" and str(g["b"].ends_at) == "2026-03-09 06:00:00" and g["b"].source_url == "https://x.org/f"
    assert sorted(r.external_id for r in bad.collect()) == ["c", "d"]


def test_address(spark):
    a = one(spark, enrich.address(F.lit("Grange Hall, 123 Main St, Boulder, CO 80302")))
    assert (a.street, a.locality, a.region, a.postal_code, a.venue) == ("123 Main St", "Boulder", "CO", "80302", "Grange Hall")
    assert one(spark, enrich.address(F.lit("TBA"))) is None


def test_numbers_of_five_digits(spark):
    """Those of houses and names are no postal codes."""
    lines = {
        "Hall 12345": (None, None, None, None, "Hall 12345"), "12345 N Main St, Lyons": ("12345 N Main St", "Lyons", None, None, None), "Hall 12345, 67890 N Main St, Lyons, CO 80540": ("67890 N Main St", "Lyons", "CO", "80540", "Hall 12345"),
        "The Center • 12345 Walnut St": ("12345 Walnut St", None, None, None, "The Center"), "12345 Arapahoe Ave Boulder CO": ("12345 Arapahoe Ave", "Boulder", "CO", None, None), "12345 Main St, Boulder, CO 80302-1234": ("12345 Main St", "Boulder", "CO", "80302", None),
        "Hall 12345, Lyons": (None, "Lyons", None, None, "Hall 12345"), "Library, Boulder, 80302": (None, "Boulder", None, "80302", "Library"), "1001 Arapahoe Ave Boulder 80302": ("1001 Arapahoe Ave", "Boulder", None, "80302", None),
        "Grange - Boulder 80302": (None, "Boulder", None, "80302", "Grange"), "Library Boulder 80302": (None, "Boulder", None, "80302", "Library"), "Boulder Colorado 80302": (None, "Boulder", "CO", "80302", None), "Boulder 80302-1234": (None, "Boulder", None, "80302", None), "Boulder Hall 12345": (None, None, None, None, "Boulder Hall 12345"),
    }
    rows = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    towns = spark.createDataFrame([("Boulder",), ("Lyons",)], "name string")
    got = {r.line: tuple(r.a) for r in enrich.with_towns(rows, "n", "line", towns).select("line", enrich.address(F.col("line"), F.col("town")).alias("a")).collect()}
    assert got == lines
    alone = {r.line: tuple(r.a) for r in rows.filter("n < 4 or n in (5, 6)").select("line", enrich.address(F.col("line")).alias("a")).collect()}
    assert alone == {k: lines[k] for k in alone} and len(alone) == 6


def test_plan_is_idempotent(spark):
    old = spark.range(20).selectExpr(
        "1 source", "cast(id as int) key", "3 level", "'h' hash", "'t' title", "timestamp_ntz'2030-01-01' starts_at", "cast(null as timestamp_ntz) ends_at", "'live' state", "true published", "false from_signal",
        "cast(null as int) widen_to", "0 missing_runs", "0 missing_hours", "0 cancelled_days",
    )
    new, now = old.select("source", "key", "level", "hash", "title", "starts_at", "ends_at"), F.lit("2024-01-01").cast("timestamp_ntz")
    assert {r.action for r in reconcile.plan(old, new, now).collect()} == {"touch"}
    assert {r.action for r in reconcile.plan(old, new.limit(0), now, F.lit(False)).collect()} == {"leave"}


def test_quantiles(spark):
    """Dense cells, ties, one value, few values and none: what sorting gives."""
    import random

    from tidewheel.operators import directory

    rng = random.Random(5)
    for values in ([40 + rng.random() * 1e-9 for _ in range(3000)], [rng.choice([1.0, 1.0, 2.0, -5.0]) for _ in range(500)], [7.5] * 30, [float(n) for n in range(19)], [1e300 * rng.random() for _ in range(200)] + [5e-324]):
        rows = spark.createDataFrame([(v, -v) for v in values] + [(None, float("nan"))], "lat double, lon double")
        up, n = sorted(values), len(values)
        ranks = {"a": 1, "b": n, "c": n // 2, "d": int(0.95 * (n - 1)) + 1}
        got = directory.quantiles(rows, {k: ("lat", lambda m, k=k: ranks[k]) for k in ranks} | {"e": ("lon", lambda m: 1)}, bins=16)
        assert got == {k: up[r - 1] for k, r in ranks.items()} | {"e": -up[-1]}
    assert tuple(directory.map_frame(rows.limit(0)).first()) == (None,) * 4


def test_search_of_any_script(spark):
    from tidewheel.operators import search

    names = ["Café Über", "cafe", "Cafe\u0301 ouvert", "東京タワー", "Фестиваль музыки", "ข้าวผัด", "naïve ÅNGSTRÖM"]
    entries = search.index(spark.createDataFrame(list(enumerate(names)), "id long, name string"), ["name"])
    find = lambda q: {r.id for r in search.search(entries, q).collect()}
    assert find("cafe") == find("CAFÉ") == {0, 1, 2} and find("uber") == {0} and find("東京") == {3} and find("музыки") == {4} and find("angstrom naive") == {6} and find("ข้าว") == {5} and find("!?") == set()
    assert search.tokens("Cafe\u0301 東京, Über-Straße") == ["cafe", "東", "京", "uber", "straße"]


def test_address_with_towns(spark):
    lines = {
        "Boulder Public Library, 1001 Arapahoe Ave, Boulder, CO 80302": ("1001 Arapahoe Ave", "Boulder", "CO", "80302", "Boulder Public Library"), "The Dairy Arts Center • 2590 Walnut St": ("2590 Walnut St", None, None, None, "The Dairy Arts Center"),
        "1001 Arapahoe Ave Boulder CO": ("1001 Arapahoe Ave", "Boulder", "CO", None, None), "Online": None, "Stanley Hotel, 333 E Wonderview Ave Estes Park CO 80517-1234": ("333 E Wonderview Ave", "Estes Park", "CO", "80517", "Stanley Hotel"),
        "in person at 1535 Spruce St, Suite 200, Boulder": ("1535 Spruce St", "Boulder", None, None, None), "1898 S Flatiron Ct": ("1898 S Flatiron Ct", None, None, None, None), "boulder": (None, "Boulder", None, None, None), "12345 Main St": ("12345 Main St", None, None, None, None),
        "Park, 12 Elm Rd Apt 4, estes park, Colorado": ("12 Elm Rd", "Estes Park", "CO", None, "Park"), "to be announced": None, "80302": None, "": None, "Chautauqua Park": (None, None, None, None, "Chautauqua Park"),
    }
    rows = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    towns = spark.createDataFrame([("Boulder",), ("Estes Park",), ("Park City",), (None,)], "name string")
    got = {r.line: None if r.a is None else tuple(r.a) for r in enrich.with_towns(rows, "n", "line", towns).select("line", enrich.address(F.col("line"), F.col("town")).alias("a")).collect()}
    assert got == lines


def test_rules_against_a_plain_loop(spark):
    """Random rules of several hosts with all conditions, short and odd phrases, repeated and empty ones, against a loop over the rules."""
    import random

    from tidewheel.operators import classify

    rng, pick = random.Random(7), lambda *x: rng.choice(x)
    words = ["Jazz", "night", "ÄRGER", "a", "Kit 1", "%_", "İ", "x.y"]
    events = [
        (n, pick(1, 2, 3, None), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), pick("Main", "main", "", None), pick("music", "Music", None), [x for x in ("music", "Food", "b") if rng.random() < 0.4],
         pick("home", "venue", "online"), [x for x in ("private", "membersOnly", "conference") if rng.random() < 0.3])
        for n in range(300)
    ]
    rules = [
        (n, pick(1, 2, 3, None), pick("jazz", "NIGHT", "A", "kit 1", "%", "i̇", "x.", "", None, None), pick("MAIN", "", None, None), pick("music", "Food", "B", None, None), pick("home", "venue", None, None), pick("private", "conference", None, None), pick("public", "held"), None, None)
        for n in range(200) if n % 50
    ]
    def holds(r, e):
        _, _, title, cal, cat, place, flag, *_ = r
        _, _, name, own_cal, own_cat, tags, own_place, flags = e
        return ((not title or title.lower() in name.lower()) and (not cal or (own_cal or "").lower() == cal.lower()) and (not cat or own_cat == cat or cat.lower() in tags)
                and (not place or own_place == place) and (not flag or flag in flags))
    want = {e[0]: next((r[0] for r in rules if r[1] == e[1] and e[1] is not None and holds(r, e)), None) for e in events}
    e = spark.createDataFrame(events, "id long, host long, name string, calendar string, category string, tags array<string>, place_type string, flags array<string>")
    r = spark.createDataFrame(rules, "position long, host long, title_contains string, calendar string, category string, location_type string, flag string, level string, audience string, gated_fields array<string>")
    out = classify.first_rule(e, r, "id")
    assert {x.id: x.rule_position for x in out.collect()} == want and len({*want.values()}) > 10
    assert {x.rule_position for x in classify.first_rule(e, r.limit(0), "id").collect()} == {None}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["address_split", "address_towns"])
def test_users_of_five_digits(spark, duck, tmp_path, name):
    """House numbers and halls of five digits, against the SQL."""
    spark.range(240).selectExpr("id as event_id", "7 * id + 12340 as user_id").write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    own = duck.cursor()
    own.execute(f"create schema {name}")
    own.execute(f"create view {name}.events as select * from '{tmp_path}/events.parquet/*.parquet'")
    own.execute(f"set search_path = '{name}'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    found = own.execute(catalog.ORACLE[name])
    cols = [c[0] for c in found.description]
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, found.fetchall()))
