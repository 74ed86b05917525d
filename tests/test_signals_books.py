"""Ladder, evaluation and books against plain loops, with keys cut into many chunks."""

from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from quoteflow.operators import books, ranking, signals
from quoteflow.plans import evaluation as ev
from tests.series_data import collect, frame, to_spark

BUYS, SELLS = (-60.0, -75.0, -90.0), (60.0, 75.0, 90.0)


@pytest.fixture(scope="module")
def scored():
    pdf = frame(7, (("HOT", 1500), ("B", 120), ("C", 2))).sort_values(["symbol", "date"]).reset_index(drop=True)
    rng = np.random.default_rng(2)
    pdf["score"] = 100 * np.sin(np.arange(len(pdf)) / 3) * rng.random(len(pdf)) ** 0.3
    return pdf.drop(columns="x")


def walk(scores):
    """One decision per row: (delta, steps, buy mask, sell mask)."""
    steps, bought, sold, out, prev = 0, set(), set(), [], None
    for s in scores:
        prev = s if prev is None else prev
        hits = [i for i, level in enumerate(BUYS) if prev > level >= s and i not in bought][: 3 - steps]
        ups = [i for i, level in enumerate(SELLS) if prev < level <= s and i not in sold][:steps]
        delta = 0
        if hits:
            bought |= set(hits)
            delta = len(hits)
        elif ups:
            sold |= set(ups)
            delta = -len(ups)
        steps += delta
        if delta < 0 and steps == 0:
            bought, sold = set(), set()
        out.append((delta, steps, sum(1 << i for i in bought), sum(1 << i for i in sold)))
        prev = s
    return out


@pytest.mark.parametrize("size", [50, 100_000])
def test_ladder(spark, scored, size):
    got = collect(signals.ladder(to_spark(spark, scored), size=size))
    want = [(k, d, *w) for k, g in scored.groupby("symbol") for d, w in zip(g.date, walk(g.score)) if w[0]]
    assert [tuple(r) for r in got[["symbol", "date", "delta", "steps", "buy_mask", "sell_mask"]].itertuples(index=False)] == want
    assert len(want) > 100


def run(g, bps):
    cash, units, basis, waiting, steps = 1.0, 0.0, 0.0, 0, 0
    equity, trades = [], []
    for row, (delta, after, _, _) in zip(g.itertuples(), walk(g.score)):
        if waiting:
            total = cash + units * row.open
            trade = total * steps / 3 - units * row.open
            cost = abs(trade) * bps / 1e4
            pnl = 0.0
            if trade > 0:
                basis += trade + cost
            elif units > 0:
                part = min(1.0, abs(trade / row.open) / units)
                pnl = abs(trade) - cost - basis * part
                basis -= basis * part
            cash -= trade + cost
            units += trade / row.open
            trades.append((trade, pnl))
        equity.append(cash + units * row.close)
        waiting, steps = delta, after
    return equity, trades


@pytest.mark.parametrize("size", [50, 100_000])
def test_evaluation(spark, scored, size):
    curve, trades = ev.evaluate(to_spark(spark, scored), bps=15, size=size)
    got = collect(curve)
    want = [run(g, 15) for k, g in scored.groupby("symbol") if len(g) >= 3]
    np.testing.assert_allclose(got["equity"], np.concatenate([w[0] for w in want]), rtol=1e-9)
    made = collect(trades)
    np.testing.assert_allclose(made["realized_pnl"], [p for w in want for _, p in w[1]], rtol=1e-7, atol=1e-12)
    assert set(got["symbol"]) == {"HOT", "B"}  # two rows are too few


def test_sweep_is_the_same_in_many_chunks(spark, scored):
    bars = to_spark(spark, scored)
    pairs = ev.sweep_pairs()[::21]
    one, many = (ev.sweep(bars, pairs, (5, 30), size=n).toPandas().sort_values(["symbol", "fold", "run", "friction"]).reset_index(drop=True) for n in (100_000, 50))
    pd.testing.assert_frame_equal(one, many, rtol=1e-8, atol=1e-10)
    assert set(one["symbol"]) == {"HOT"} and set(one["fold"]) == {0, 1, 2, 3}


def test_sweep_levels_are_clamped():
    assert ev.threshold_levels(-80, -1) == [-80.0, -95.0, -95.0]
    assert len(ev.sweep_pairs()) == 64


def trade_table(seed=1, n=1200):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        name = "HOT" if i % 4 else "B"
        side = "sell" if rng.random() < 0.45 else "buy"
        rows.append((name, f"2020-{1 + i * 12 // n:02d}-{1 + (i * 28 * 12 // n) % 28:02d}", i, side, Decimal(int(rng.integers(1, 40))) / 4,
                     Decimal(int(rng.integers(100, 200))) / 10, Decimal("0.05")))
    return rows


def walk_book(rows, splits):
    book = {"q": Decimal(0), "c": Decimal(0), "r": Decimal(0), "f": Decimal(0)}
    events = [(d, 1, i, s, q, p, f) for _, d, i, s, q, p, f in rows] + [(d, 0, 0, "split", k, None, None) for d, k in splits]
    for _, _, _, side, q, p, fee in sorted(events, key=lambda e: e[:3]):
        if side == "split":
            book["q"] *= q
            continue
        book["f"] += fee
        if side == "buy":
            book["q"] += q
            book["c"] += q * p + fee
        elif book["q"] > 0:
            sold = min(q, book["q"])
            part = book["c"] * sold / book["q"]
            book["r"] += q * p - fee - part
            book["q"] -= sold
            book["c"] -= part
    return book


@pytest.mark.parametrize("size", [40, 100_000])
def test_average_cost_book_with_splits_and_oversells(spark, size):
    rows = trade_table()
    trades = spark.createDataFrame(
        [("paper", a, b, c, d, e, f, g) for a, b, c, d, e, f, g in rows],
        "kind string, instrument string, day string, id int, side string, quantity decimal(18,6), price decimal(18,6), fee decimal(18,6)",
    ).selectExpr("*", "to_date(day) AS date").drop("day").repartition(4)
    splits = [("HOT", "2020-05-10", 3.0), ("HOT", "2020-05-10", 3.0), ("HOT", "2020-09-01", 0.5), ("B", "2019-01-01", 7.0)]
    bars = spark.createDataFrame(splits, "instrument string, day string, split_factor double").selectExpr("instrument", "to_date(day) AS date", "split_factor")
    got = {r.instrument: r for r in books.average_cost_book(trades, bars, order=["id"], size=size).collect()}
    for name, events in (("HOT", [("2020-05-10", Decimal(3)), ("2020-09-01", Decimal("0.5"))]), ("B", [("2019-01-01", Decimal(7))])):
        want = walk_book([r for r in rows if r[0] == name], events)
        assert float(got[name].quantity) == pytest.approx(float(want["q"]), abs=1e-9)
        assert got[name].cost == pytest.approx(float(want["c"]), abs=1e-6)
        assert got[name].realized_pnl == pytest.approx(float(want["r"]), abs=1e-6)
        assert float(got[name].fees) == pytest.approx(float(want["f"]))
        assert got[name].oversold > 0


@pytest.mark.parametrize("held,factors,want", [
    (15_000_000, [1 / 15], "1000000"), (15_000_000, [1 / 300], "50000"), (15_000_000, [1 / 15, 1 / 15], "66666.666666666667"), (7, [1.5, 3.0], "31.5"), (15_000_000, [0.066667], "1000005"), (10, [1.0345678], "10.345678"),
    (10, [1.0345678, 0.066667], "0.689715315226"),
])
def test_split_factors_are_exact(spark, held, factors, want):
    trades = spark.createDataFrame([("live", "A", 1, "buy", Decimal(held), Decimal(1), Decimal(0))],
                                   "kind string, instrument string, id int, side string, quantity decimal(18,6), price decimal(18,6), fee decimal(18,6)"
                                   ).selectExpr("*", "DATE'2020-01-01' AS date")
    bars = spark.createDataFrame([("A", f"2020-02-{k + 1:02d}", f) for k, f in enumerate(factors)], "instrument string, day string, split_factor double")
    bars = bars.selectExpr("instrument", "to_date(day) AS date", "split_factor")
    row = books.average_cost_book(trades, bars, order=["id"]).first()
    assert row.quantity == Decimal(want) and row.cost == held
    ledger = books.book_ledger(trades, bars, order=["id"]).first()
    assert ledger.held_after == held and ledger.cost == held


def test_many_odd_factors_keep_fifteen_digits(spark):
    factors = [0.066667, 1.0345678, 14.999925, 1.123456789, 0.3333, 3.0003, 0.001, 0.0123457]
    trades = spark.createDataFrame([("live", "A", 1, "buy", Decimal(1_000_000), Decimal(1), Decimal(0))],
                                   "kind string, instrument string, id int, side string, quantity decimal(18,6), price decimal(18,6), fee decimal(18,6)"
                                   ).selectExpr("*", "DATE'2020-01-01' AS date")
    bars = spark.createDataFrame([("A", f"2020-02-{k + 1:02d}", f) for k, f in enumerate(factors)], "instrument string, day string, split_factor double")
    row = books.average_cost_book(trades, bars.selectExpr("instrument", "to_date(day) AS date", "split_factor"), order=["id"]).first()
    want = Decimal(1_000_000)
    for f in factors:
        want *= Decimal(str(f))
    assert float(row.quantity) == pytest.approx(float(want), rel=1e-12) and row.cost == 1_000_000


@pytest.mark.parametrize("size", [40, 100_000])
def test_ledger_ends_where_the_book_does(spark, size):
    trades = spark.createDataFrame(
        [("paper", a, b, c, d, e, f, g) for a, b, c, d, e, f, g in trade_table()],
        "kind string, instrument string, day string, id int, side string, quantity decimal(18,6), price decimal(18,6), fee decimal(18,6)",
    ).selectExpr("*", "to_date(day) AS date").drop("day")
    book = {r.instrument: r for r in books.average_cost_book(trades, order=["id"], size=size).collect()}
    rows = books.book_ledger(trades, order=["id"], size=size).collect()
    for name, b in book.items():
        mine = sorted((r for r in rows if r.instrument == name), key=lambda r: (r.date, r.id))
        assert mine[-1].cost == pytest.approx(b.cost, abs=1e-6) and mine[-1].held_after == b.quantity
        assert sum(r.realized_pnl for r in mine) == pytest.approx(b.realized_pnl, abs=1e-6)


@pytest.mark.parametrize("size", [1, 100_000])
def test_rows_without_a_quantity_change_no_holdings(spark, size):
    rows = [("A", i, side, None if q is None else Decimal(q), Decimal(2), Decimal(0)) for i, (side, q) in enumerate([("buy", None), ("sell", 3), ("buy", 10), ("sell", None), ("sell", 4), ("buy", None)])]
    trades = spark.createDataFrame(rows, "instrument string, id int, side string, quantity decimal(18,6), price decimal(18,6), fee decimal(18,6)").selectExpr(
        "*", "date_add(DATE'2020-01-01', id) AS date", "'live' AS kind")
    row = books.average_cost_book(trades, order=["id"], size=size).first()
    assert (float(row.quantity), row.cost, row.oversold, row.trades) == (6.0, 12.0, 1, 6)


def test_a_book_reads_its_trades_three_times_at_most(spark, tmp_path):
    """Once to count the rows of the chunks, once for their totals and once to walk them (Spark may share the last two); not again for every running sum."""
    trades = spark.createDataFrame([("live", "A", 1, "buy", Decimal(5), Decimal(10), Decimal(1))],
                                   "kind string, instrument string, id int, side string, quantity decimal(18,6), price decimal(18,6), fee decimal(18,6)"
                                   ).selectExpr("*", "DATE'2020-01-01' AS date")
    trades.write.parquet(str(tmp_path / "trades"))
    book = books.average_cost_book(spark.read.parquet(str(tmp_path / "trades")), order=["id"])
    assert 1 <= book._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 4  # the layout is joined on both ways


def test_totals_compute_positions_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for frame in rows:
            made.add(len(frame))
            yield frame

    kind = "currency string, market_value double, cost double, realized_pnl double, unrealized_pnl double, fees double"
    positions = spark.createDataFrame([("USD", 1.0, 1.0, 1.0, 1.0, 1.0), ("EUR", 2.0, 1.0, 1.0, 1.0, 1.0), ("XXX", 9.0, 1.0, 1.0, 1.0, 1.0)], kind).mapInPandas(seen, kind)
    rates = spark.createDataFrame([("EUR", "USD", 1.5)], "base string, quote string, rate double").selectExpr("DATE'2020-01-01' AS date", "*")
    row = books.portfolio_totals(positions, rates, "USD").first()
    assert (row.market_value, row.missing_fx) == (4.0, ["XXX"]) and made.value == 3


def test_sell_without_holdings_only_pays_the_fee(spark):
    trades = spark.createDataFrame([("live", "A", 1, "sell", Decimal(5), Decimal(10), Decimal(1))],
                                   "kind string, instrument string, id int, side string, quantity decimal(18,6), price decimal(18,6), fee decimal(18,6)"
                                   ).selectExpr("*", "DATE'2020-01-01' AS date")
    row = books.average_cost_book(trades, order=["id"]).first()
    assert (float(row.quantity), row.cost, row.realized_pnl, float(row.fees)) == (0.0, 0.0, 0.0, 1.0)


def test_budgeted_topk_equals_the_one_by_one_walk(spark):
    rng = np.random.default_rng(4)
    cands, accounts, want = [], [], set()
    for day in range(40):
        names = [(f"S{i}", float(rng.integers(0, 4)), bool(rng.random() < 0.6)) for i in range(rng.integers(1, 12))]
        cash, slots = float(rng.integers(0, 6) * 100), int(rng.integers(0, 4))
        accounts.append((day, cash, 50.0, 100.0, slots))
        left, free = cash, slots
        for name, priority, new in sorted(names, key=lambda c: (c[1], c[0])):
            if left - 50 + 1e-9 < 100 or (new and free <= 0):
                continue
            left, free = left - 100, free - new
            want.add((day, name))
        cands += [(day, *c) for c in names]
    got = ranking.budgeted_topk(spark.createDataFrame(cands, "date int, symbol string, priority double, is_new boolean"),
                                spark.createDataFrame(accounts, "date int, cash double, reserve double, budget double, slots int"))
    assert {(r.date, r.symbol) for r in got.collect()} == want


def test_fill_sizes(spark):
    rows = [("A", 1, 0, Decimal(0), Decimal(9000), Decimal(10), 1), ("B", -1, 2, Decimal(8), Decimal(9000), Decimal(10), 1),
            ("C", -2, 2, Decimal(8), Decimal(9000), Decimal(10), 1), ("D", -1, 1, Decimal(0), Decimal(9000), Decimal(10), 1)]
    fills = spark.createDataFrame(rows, "symbol string, delta int, position_steps int, held decimal(18,6), capital decimal(18,2), fill_price decimal(18,6), cycle_id int")
    got = {r.symbol: r for r in signals.size_fills(fills).collect()}
    assert float(got["A"].quantity) == 300 and float(got["A"].fee) == 4.5 and got["A"].steps_after == 1
    assert float(got["B"].quantity) == 4 and got["B"].cycle_after == 1
    assert float(got["C"].quantity) == 8 and got["C"].steps_after == 0 and got["C"].cycle_after == 2
    assert got["D"].quantity is None and got["D"].steps_after == 1
