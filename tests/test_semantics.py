"""Published sample figures, rule texts and brute-force twins."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from stakeflow.functions import rules as RU
from stakeflow.functions import text as X
from stakeflow.functions.semantics import confidence_level, kelly, ratio, roi, win_rate
from stakeflow.operators import aggregates as A
from stakeflow.operators import betting as B
from stakeflow.operators import filters as S
from stakeflow.operators import fold as L
from stakeflow.operators import projections as P
from stakeflow.operators import quality as Q
from stakeflow.operators import reports as R
from stakeflow.operators import sets as U


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_sample_figures(spark):
    L_ = F.lit
    r = one(spark, wr=F.round(win_rate(L_(115), L_(75)), 1), roi=roi(L_(6250.0), L_(5000.0)), acc=F.round(ratio(L_(175), L_(245), 100), 1),
            zero=ratio(L_(1), L_(0)), level=confidence_level(L_(70.0)), low=confidence_level(L_(59.9)), k=kelly(L_(0.4), L_(2.0)))
    assert (r.wr, r.roi, r.acc, r.zero, r.level, r.low, r.k) == (60.5, 25.0, 71.4, 0.0, "high", "low", 0.0)
    hedge = one(spark, lay=B.hedge_stakes(L_(100.0), L_(3.0), L_(2.0))[0])
    assert hedge.lay == 150.0


def test_event_weighted_total(spark):
    rows = [("a", 22.3, 89), ("b", 15.8, 78), ("c", 17.4, 67)]
    d = spark.createDataFrame(rows, "s string, roi double, n long")
    assert d.agg(F.round(F.sum(F.col("roi") * F.col("n")) / F.sum("n"), 1)).first()[0] == 18.7


def test_periods(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 29),)], "ts timestamp")
    assert S.period_filter(d, "ts", "7d", "2024-01-31").count() == 1
    assert S.period_filter(d, "ts", "no such period", "2024-01-31").count() == 2
    with pytest.raises(ValueError):
        S.admin_period_filter(d, "ts", "1y", "2024-01-31")
    with pytest.raises(ValueError):
        S.bet_search(d, min_stake=5, max_stake=1)


def test_totals_add_up(spark, tables):
    b = A.settle_bets(tables.bet)
    whole = b.agg(F.round(F.sum("profit"), 4)).first()[0]
    parts = b.groupBy("market").agg(F.sum("profit").alias("p")).agg(F.round(F.sum("p"), 4)).first()[0]
    assert whole == pytest.approx(parts)


def test_arbitrage_stakes_sum(spark, tables):
    bad = B.arbitrage_finder(tables.quote).filter(F.abs(F.col("stake_home") + F.col("stake_draw") + F.col("stake_away") - 1000) > 0.001)
    assert bad.count() == 0


def test_ensemble_sums_to_one(tables):
    assert B.ensemble(tables.prob, "soft").filter(F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1) > 1e-5).count() == 0


def test_elo_matches_loop(spark, tables):
    m = tables.match.filter("status = 'finished'").orderBy("match_date", "match_id").collect()
    want = {}
    for r in m:
        h, a = want.get((r.league, r.home_team), 1500.0), want.get((r.league, r.away_team), 1500.0)
        x = 1.0 if r.home_score > r.away_score else 0.5 if r.home_score == r.away_score else 0.0
        d = 20.0 * (x - 1 / (1 + 10 ** ((a - h - 60.0) / 400)))
        want[r.league, r.home_team], want[r.league, r.away_team] = h + d, a - d
    got = {(r.league, r.team): r.rating for r in L.rating_elo(tables.match).collect()}
    assert got == pytest.approx(want)
    # two runs with stored ratings equal one run
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    first = L.rating_elo(tables.match.filter(F.col("match_date") < cut))
    second = L.rating_elo(tables.match.filter(F.col("match_date") >= cut), initial=first)
    assert {(r.league, r.team): r.rating for r in second.collect()} == pytest.approx(want)


def test_token_bucket_bound(spark, tables):
    req = tables.events.withColumnRenamed("event_id", "request_id").withColumn("all", F.lit("x"))
    n = L.token_bucket(req, "all", L.TokenBucket(0.01, 5)).filter("allowed").count()
    assert n <= 5 + 30 * 86400 * 0.01 / 60
    assert L.TokenBucket(60, 1).take(0.5, 0.0, 0.0) == (0.5, False, 1)


def test_fixed_window_rejects_after_limit():
    w = L.FixedWindow(2, 60)
    start, n, ok, wait = w.hit(None, 0, 100.0)
    start, n, ok, wait = w.hit(start, n, 110.0)
    assert ok
    start, n, ok, wait = w.hit(start, n, 130.5)
    assert not ok and wait == 29
    assert w.hit(start, n, 160.0)[2]


RULE_CASES = [
    ("email", "a.b@mail.example.com", True), ("email", ".a@x.com", False), ("email", "a..b@x.com", False), ("email", "a@x", False),
    ("url", "https://x.example/a?b=1", True), ("url", "ftp://x.example", False), ("url", "http://", False),
    ("uuid", "123e4567-e89b-12d3-a456-426614174000", True), ("uuid", "{123e4567e89b12d3a456426614174000}", True), ("uuid", "123", False),
    ("date", "2024-2-29", True), ("date", "2023-02-29", False), ("phone", "+33 6 12-34.56 78", True), ("phone", "12345", False),
    ("ip", "192.168.0.1", True), ("ip", "256.1.1.1", False), ("ip", "2001:db8::1", True), ("ip", "::ffff:1.2.3.4", True), ("ip", "1::2::3", False),
    ("json", '{"a": [1]}', True), ("json", "{a", False), ("postal_code", "12345-6789", True), ("postal_code", "1234", False),
    ("username", "good_name", True), ("username", "_bad", False), ("username", "a__b", False), ("not_empty", "  ", False),
]


@pytest.mark.parametrize("rule,value,ok", RULE_CASES)
def test_rules(spark, rule, value, ok):
    got = one(spark, x=F.coalesce(RU.resolve(rule)(F.lit(value)), F.lit(False)))
    assert got.x is ok


def test_unknown_rule_is_an_error():
    with pytest.raises(ValueError):
        RU.resolve("no_such_rule")


def test_null_fails_every_rule(spark):
    d = spark.createDataFrame([(None,)], "s string")
    res = Q.dq_rules(d, {"s": ["email", "url", "uuid", "date", "phone", "ip", "json", "postal_code", "username", "not_empty", ("length", 0, 9)]})
    assert res.filter("failed <> 1").count() == 0


def test_texts(spark):
    r = one(
        spark, clean=X.clean_text(F.lit("<p onclick='x()'>Hi\x00 <SCRIPT>a\nb</script>javascript:<b>you</b></p> ")),
        slug=X.slugify(F.lit("Él  Niño -- wins_2-1!")), cut=X.truncate_words(F.lit("one two three four"), 12), same=X.truncate_words(F.lit("one"), 12),
        card=F.size(X.cards(F.lit("pay 4111 1111 1111 1111 or 4111111111111112"))), h=X.row_hash(F.lit("a"), "sha512"),
        eur=X.currency_text(F.lit(1234.5), F.lit("EUR")), usd=X.currency_text(F.lit(1234.5), F.lit("usd")), pct=X.percent_text(F.lit(0.5)),
        big=X.percent_text(F.lit(12.345)), dur=X.duration_text(F.lit(90061)), nil=X.duration_text(F.lit(0)), size=X.size_text(F.lit(1500000)),
        flag=X.parse_flag(F.lit(" Yes ")), off=X.parse_flag(F.lit("maybe")), b=X.parse_size(F.lit("1.5 mb")), bad=X.parse_size(F.lit("x")),
        q=X.query_params(F.lit("http://x/?a=1&b=two%20words&a=3&empty=#f")))
    assert r.clean == "Hi you" and r.slug == "él-niño-wins-2-1" and r.cut == "one two..." and r.same == "one" and r.card == 1
    assert r.h.startswith("1f40fc92") and r.eur == "1,234.50 €" and r.usd == "$1,234.50" and r.pct == "50.00%"
    assert r.big in ("12.35%", "12.34%") and r.dur == "1d 1h" and r.nil == "0s" and r.size == "1.50 MB"
    assert r.flag is True and r.off is False and r.b == 1572864 and r.bad is None
    assert r.q == {"a": ["1", "3"], "b": ["two words"]}


def test_attack_flags(spark):
    d = spark.createDataFrame([("x = 1 or 1=1",), ("reorder the list",), ("<img onerror = 'a'>",)], "t string")
    f = [r.asDict() for r in Q.attack_scan(d.withColumn("id", F.col("t")), "t").collect()]
    by = {r["id"]: r for r in f}
    assert by["x = 1 or 1=1"]["sql_or"] and not by["reorder the list"]["sql_injection"] and by["<img onerror = 'a'>"]["xss_handler"]


def test_naming_and_nesting(spark):
    d = spark.sql("SELECT 1 AS userId, named_struct('firstName', 'a', 'inner', named_struct('x', 2)) AS profileInfo")
    snake = P.rename_columns(d, "snake")
    assert snake.columns == ["user_id", "profile_info"]
    assert snake.schema["profile_info"].dataType.fieldNames() == ["first_name", "inner"]
    flat = P.flatten_df(d)
    assert flat.columns == ["userId", "profileInfo.firstName", "profileInfo.inner.x"]
    assert P.unflatten_df(flat).first() == d.first()
    assert P.NAMING["kebab"]("HTTPServerName") == "http-server-name" and P.NAMING["pascal"]("user_name") == "UserName"


def test_merge_priority(spark):
    a = spark.createDataFrame([(1, "x", None)], "id int, a string, b string")
    b = spark.createDataFrame([(1, "y", "z"), (2, "w", None)], "id int, a string, b string")
    assert {tuple(r) for r in U.merge_records("id", a, b).collect()} == {(1, "y", "z"), (2, "w", None)}
    assert {tuple(r) for r in U.merge_records("id", a, b, priority="first").collect()} == {(1, "x", "z"), (2, "w", None)}


def test_pages_are_disjoint_and_cover(spark, tables):
    from stakeflow.operators.ranking import paginate
    from stakeflow.operators.scan import time_block
    e = tables.events.select("event_id", "ts")
    seen = []
    for page in (1, 2, 3, 4, 99):
        seen.append([r.event_id for r in paginate(e, ["ts", "event_id"], time_block("ts"), page, 300).orderBy("position").collect()])
    assert sum(len(s) for s in seen[:4]) == e.count() == len({x for s in seen[:4] for x in s})
    assert seen[4] == seen[3]


def test_standings_sample(spark):
    rows = [("L", i, dt.datetime(2024, 1, i + 1), "A", f"B{i}", 2, 0, "finished") for i in range(18)]
    rows += [("L", 50 + i, dt.datetime(2024, 2, i + 1), "A", f"B{i}", 1, 1, "finished") for i in range(4)]
    d = spark.createDataFrame(rows, "league string, match_id int, match_date timestamp, home_team string, away_team string, home_score int, away_score int, status string")
    top = R.league_standings(A.team_sides(d)).filter("team = 'A'").first()
    assert (top.points, top.position, top.goal_difference) == (58, 1, 36)


def test_approximate_report_is_close(tables):
    exact = {r.column: r.distinct_values for r in Q.quality_report(tables.lineitem, ["l_partkey", "l_suppkey"], exact=True).collect()}
    near = {r.column: r.distinct_values for r in Q.quality_report(tables.lineitem, ["l_partkey", "l_suppkey"]).collect()}
    assert all(math.isclose(near[c], exact[c], rel_tol=0.15) for c in exact)


def test_schema_issues(spark):
    d = spark.sql("SELECT 1 AS a, named_struct('b', 'x') AS s")
    assert Q.schema_issues(d.schema, {"a": "int", "s": {"b": "string"}}) == []
    assert Q.schema_issues(d.schema, {"z": "int", "a": "string", "s": {"b": "int"}}) == [
        "missing root.z", "expected string at root.a, got int", "expected int at root.s.b, got string"]


def test_batch_predict_refuses_long_lists(spark):
    from stakeflow.models.training import batch_predict
    scored = spark.createDataFrame([(1, 0.5)], "match_id long, p double")
    assert batch_predict(spark.range(2).withColumnRenamed("id", "match_id"), scored).filter("error IS NULL").count() == 1
    with pytest.raises(Exception, match="at most 50"):
        batch_predict(spark.range(60).withColumnRenamed("id", "match_id"), scored).collect()


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_scan_entity_formats(spark, tables, fmt):
    from stakeflow.session import shared_dir
    from stakeflow.sources.sinks import TEXT_TIMES
    from stakeflow.sources.tables import scan_entity
    out = shared_dir(spark, f"scan-{fmt}")
    options = {"header": "true", "escape": '"', **TEXT_TIMES} if fmt in ("csv", "json") else {}
    tables.events.write.format(fmt).options(**options).save(out)
    back = scan_entity(spark, out, "event_row", fmt, **options)
    assert back.schema.simpleString() == tables.events.schema.simpleString()
    assert back.exceptAll(tables.events).count() == 0


def test_export_keeps_values(spark, tables):
    from stakeflow.session import shared_dir
    from stakeflow.sources.sinks import TEXT_TIMES, export_report
    for fmt in ("csv", "json"):
        out = shared_dir(spark, "export-test")
        r = export_report(tables.bet, out, fmt).first()
        assert r.record_count == 1000 and r["size"] > 10000
        back = spark.read.schema(tables.bet.schema).format(fmt).options(header=True, **TEXT_TIMES).load(out)
        assert back.exceptAll(tables.bet).count() == 0


def test_poisson_shares_add_to_one(spark):
    rates = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(0.1, 0.2), (1.4, 1.1), (100.0, 98.0), (30.0, 0.1), (800.0, 790.0), (0.0, 1.2)])], "match_id int, lh double, la double")
    got = {r.match_id: r for r in B.poisson_grid(rates).collect()}
    assert all(abs(r.p_home + r.p_draw + r.p_away - 1) < 3e-6 for r in got.values())
    assert abs(got[1].over_2_5 - 0.456187) < 1e-6 and got[2].over_2_5 == 1.0
    assert 0.4 < got[2].p_away < got[2].p_home < 0.6 and got[3].p_home > 0.999
    # far beyond where exp(-rate) is 0: the difference is nearly normal with mean 10 and variance 1590
    assert abs(got[4].p_home - 0.5941) < 2e-3 and abs(got[4].p_draw - 0.0097) < 2e-4
    assert (got[5].p_home, got[5].p_draw) == (0.0, pytest.approx(0.301194, abs=2e-6))


def test_null_groups_and_values_stay(spark):
    from stakeflow.operators import quality as Q
    from stakeflow.operators.scan import ranked

    d = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 2.0), (4, None, 6.0), (5, "a", None)], "id int, g string, v double")
    assert Q.normalize(d.filter("v IS NOT NULL"), ["g"], "v", "minmax").count() == 4
    got = {r.id: (r["rank"], r.percentile) for r in ranked(d, ["g"], "v").collect()}
    assert got == {2: (1, 1.0), 1: (2, 0.0), 5: (3, 0.0), 4: (1, 1.0), 3: (2, 0.0)}


def test_late_request_takes_no_tokens():
    from stakeflow.operators.fold import TokenBucket

    assert TokenBucket(60, 10).take(1.0, 1000, 900) == (0.0, True, 0)


def test_similar_matches_beyond_one_block(spark):
    from stakeflow.models.training import similar_matches

    vs = [(i, [float(i % 17 + 1), float(i % 5), 1.0]) for i in range(300)]
    q, c = spark.createDataFrame(vs, "q int, v array<double>"), spark.createDataFrame(vs, "c int, v array<double>")
    out = similar_matches(q, c, "q", "c", "v", 1).collect()
    assert len(out) == 300 and all(r.similarity == 1.0 for r in out)


def test_match_detail_lists_every_injury(spark):
    from stakeflow.operators.joins import match_detail

    m = spark.createDataFrame([(1, "x", "A", "B", "2024-01-01", "finished", 1, 0)],
                              "match_id long, league string, home_team string, away_team string, match_date string, status string, home_score long, away_score long")
    st = spark.createDataFrame([("A", 1), ("B", 1)], "team string, played int")
    inj = spark.createDataFrame([("A", f"p{i}", "2024-01-01", f"2024-01-1{i}") for i in range(5)], "team string, player string, injury_date string, expected_return string")
    row = match_detail(m, st, inj).first()
    assert [p.player for p in row.home.injuries] == ["p4", "p3", "p2", "p1", "p0"] and row.home.injured == 5 and row.away.injured == 0


def test_backtest_strategies(spark, tables):
    bets = tables.bet.withColumn("confidence", (F.col("bet_id") % 41 + 40).cast("double"))
    run = lambda s: {r.user_id: r.staked for r in B.backtest(bets, "2024-01-08", "2024-01-29", 1000.0, s).collect()}
    flat = run("flat")
    assert flat and all(v % 10 == 0 for v in flat.values())
    assert run(lambda confidence, odds, bankroll: F.lit(10.0)) == flat and run("value_only") != flat
    with pytest.raises(ValueError):
        B.backtest(bets, "2024-01-08", "2024-01-29", 1000.0, "martingale")


def test_calibration_lookback(tables):
    whole = A.calibration(tables.prediction).agg(F.sum("n")).first()[0]
    part = A.calibration(tables.prediction, "2000-12-31", 30).agg(F.sum("n")).first()[0]
    assert 0 < part < whole
    for days in (6, 366):
        with pytest.raises(ValueError):
            A.calibration(tables.prediction, "2000-12-31", days)


def test_cards_and_phones(spark):
    from stakeflow.functions import text as X

    cases = [
        ("3782 822463 10005", ["378282246310005"], []), ("4111-1111-1111-1111", ["4111111111111111"], []),
        ("4111 1111 1111 1111 123", ["4111111111111111"], []), ("4111 1111 1111 1111 5555 5555 5555 4444", ["4111111111111111", "5555555555554444"], []),
        ("555-123-4567 555-987-6543", [], ["5551234567", "5559876543"]), ("+1 (555) 123-4567", [], ["+15551234567"]),
        ("call 01 23 45 67 89 now", [], ["0123456789"]), ("4111 1111 1111 1112", [], []), ("no. 12 of 345", [], []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    got = {r.i: (r.c, r.p) for r in df.select("i", X.cards(F.col("t")).alias("c"), X.phones(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [(c, p) for _, c, p in cases]


def test_broken_escape_in_a_parameter_name(spark):
    from stakeflow.functions.text import query_params

    df = spark.createDataFrame([("http://x/?a%zz=1&b=2&a%zz=3&%41=4",)], "u string")
    assert df.select(query_params(F.col("u")).alias("m")).first().m == {"a%zz": ["1", "3"], "b": ["2"], "A": ["4"]}


def test_names_keep_their_underscores(spark):
    from stakeflow.operators.projections import NAMING, rename_columns

    assert [NAMING["snake"](n) for n in ("_id", "id", "a__b", "matchID", "HTTPServer", "kick off-time")] == ["_id", "id", "a__b", "match_id", "http_server", "kick_off_time"]
    assert [NAMING[c]("_match_date") for c in ("camel", "kebab")] == ["MatchDate", "-match-date"]
    df = spark.createDataFrame([(1, 2)], "_id int, id int")
    assert rename_columns(df, "snake").columns == ["_id", "id"] and rename_columns(df, "camel").columns == ["Id", "id"]


def test_match_detail_with_form(spark):
    from stakeflow.operators.joins import match_detail

    m = spark.createDataFrame([(1, "x", "A", "B", "2024-01-01", "finished", 1, 0)],
                              "match_id long, league string, home_team string, away_team string, match_date string, status string, home_score long, away_score long")
    st = spark.createDataFrame([("A", 1), ("B", 1)], "team string, played int")
    inj = spark.createDataFrame([], "team string, player string, injury_date string, expected_return string")
    row = match_detail(m, st, inj, form=spark.createDataFrame([("A", "WDL")], "team string, form string")).first()
    assert row.home.form == ["W", "D", "L"] and row.away.form is None


def test_leaderboard_ranks_ties_nulls_and_the_asking_user(spark):
    from stakeflow.operators.windows import leaderboard

    d = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([5, 9, 9, 7, 1, 1, 0, None, 3, 9])], "user_id int, roi double")
    got = {r.user_id: (r["rank"], round(r.percentile, 6)) for r in leaderboard(d, "roi", 5, me=6).collect()}
    assert got == {1: (1, 0.75), 2: (1, 0.75), 9: (1, 0.75), 3: (4, 0.625), 0: (5, 0.5), 6: (9, 0.0)}
    assert {r.user_id: r["rank"] for r in leaderboard(d, "roi", 5, me=7).filter("user_id = 7").collect()} == {7: 10}
    assert leaderboard(d.limit(0), "roi", 5).count() == 0


def test_confidence_calibration_reads_every_decided_prediction(spark, tables):
    from stakeflow.plans import QUERIES

    from .conftest import SF

    whole = tables.prediction.filter(F.col("status").isin("won", "lost") & (F.col("confidence") >= 60)).count()
    assert QUERIES["confidence_calibration"](spark, SF).agg(F.sum("n")).first()[0] == whole


def test_match_detail_writes_a_team_s_injuries_once(spark):
    from stakeflow.operators.joins import match_detail

    m = spark.createDataFrame([(i, "x", "A", "B", "2024-01-01", "finished", 1, 0) for i in range(3)],
                              "match_id long, league string, home_team string, away_team string, match_date string, status string, home_score long, away_score long")
    st = spark.createDataFrame([("A", 1), ("B", 1)], "team string, played int")
    inj = spark.createDataFrame([("A", "p", "2024-01-01", "2024-01-03"), ("A", "q", "2024-01-01", "2024-01-05")],
                                "team string, player string, injury_date string, expected_return string")
    out = match_detail(m, st, inj).select("match_id", "home.injury_text", "away.injury_text")
    assert [tuple(r) for r in out.orderBy("match_id").collect()] == [(i, "q:4 p:2", None) for i in range(3)]


def test_match_detail_is_written_with_each_team_s_injuries_once(spark, tmp_path):
    from stakeflow.operators.joins import match_detail

    teams = [f"T{i:02}" for i in range(16)]
    m = spark.range(800).select(F.col("id").alias("match_id"), F.concat(F.lit("T"), F.lpad((F.col("id") * 7 % 16).cast("string"), 2, "0")).alias("home_team"),
                                F.concat(F.lit("T"), F.lpad(((F.col("id") * 7 + 1) % 16).cast("string"), 2, "0")).alias("away_team"), F.lit("finished").alias("status"),
                                F.current_date().alias("match_date"), (F.col("id") % 3).alias("home_score"), (F.col("id") % 2).alias("away_score"))
    st = spark.createDataFrame([(t, 1) for t in teams], "team string, played long")
    inj = spark.range(16 * 2000).select(F.concat(F.lit("T"), F.lpad((F.col("id") % 16).cast("string"), 2, "0")).alias("team"), F.sha2(F.col("id").cast("string"), 256).alias("player"),
                                        F.current_date().alias("injury_date"), F.current_date().alias("expected_return"))
    match_detail(m, st, inj).select("match_id", "home.injury_text").write.parquet(str(tmp_path / "out"))
    lists = 16 * 2000 * 67  # each list, once; beside every match it would be 50 times as much
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 800 and back.agg(F.sum(F.length("injury_text"))).first()[0] == 50 * (lists - 16)
    assert sum(p.stat().st_size for p in (tmp_path / "out").iterdir()) < 4 * lists
