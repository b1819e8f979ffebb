"""Ticks over a stream, with a restart and a tick that is tried again, against a loop over the same messages."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.plans import stores
from tidemark.streaming.ticks import MESSAGE, Book, run_book

LIMIT, PORTFOLIO = 60, 10_000.0


def loop(ticks):
    """The same rules, a message and an order at a time."""
    signals, orders, executions, positions, fills, remote, events = {}, {}, {}, {}, [], {}, []
    on = True
    for messages in ticks:
        now, was_on = max(m[1] for m in messages), on
        for kind, _, _, body in sorted(messages, key=lambda m: m[2]):
            if kind == "trading":
                on = body != "off"
            elif kind == "fill":
                fills.append(json.loads(body))
            elif kind == "remote":
                m = json.loads(body)
                remote[m["exchange_order_id"]] = m["remote_status"]
            elif kind == "signal":
                m = json.loads(body)
                if m["signal_id"] not in signals:
                    signals[m["signal_id"]] = m | {"status": "NEW"}
                    events.append(("SIGNAL_EMITTED", m["signal_id"]))
        for s in sorted((s for s in signals.values() if s["status"] == "NEW"), key=lambda s: (s["signal_ts"], s["signal_id"])) if on else []:
            entry, stop = s["execution_price"], s["retest_level"] - s["atr"]
            size = round(PORTFOLIO * 0.002 / (entry - stop), 5) if entry > 0 and 0 < stop < entry else 0.0
            taken = s["symbol"] in positions or any(o["symbol"] == s["symbol"] and o["status"] in ("PENDING", "PARTIAL") for o in orders.values())
            status = "REJECTED_POSITION_OPEN" if taken else "REJECTED_INVALID_DATA" if entry <= 0 or stop <= 0 or s["atr"] <= 0 else "REJECTED_INVALID_SIZE" if size <= 0 else "PENDING"
            oid = f"ord_{s['signal_id']}" + ("" if status == "PENDING" else "_rej")
            orders[oid] = {"signal_id": s["signal_id"], "symbol": s["symbol"], "price": round(entry * 1.005, 2) if status == "PENDING" else entry, "size": size if status == "PENDING" else 0.0, "done": 0.0, "status": status, "at": now, "x": None}
            s["status"] = "ORDER_PENDING" if status == "PENDING" else status
            if status == "PENDING":
                events.append(("ORDER_PENDING", oid))
        for oid, o in orders.items():
            if o["status"] != "PENDING":
                continue
            if o["x"] is None:
                o["x"] = f"cb_{oid}"
                events.append(("ORDER_SUBMITTED", oid))
                continue
            for f in fills:
                if f["exchange_order_id"] != o["x"] or o["status"] not in ("PENDING", "PARTIAL") or o["done"] + f["size"] > o["size"] * 1.0001 or f["execution_id"] in executions:
                    continue
                executions[f["execution_id"]] = (oid, f["price"], f["size"])
                o["done"] += f["size"]
                o["status"] = "FILLED" if o["done"] >= o["size"] * 0.9999 else "PARTIAL"
                cost, held, entry_ts, _ = positions.get(o["symbol"], (0.0, 0.0, now, 0.0))
                s = signals[o["signal_id"]]
                positions[o["symbol"]] = (cost + f["price"] * f["size"], held + f["size"], entry_ts, s["retest_level"] - s["atr"])
            if o["status"] == "FILLED":
                signals[o["signal_id"]]["status"] = "ORDER_FILLED"
                events += [("ORDER_FILLED", oid), ("POSITION_OPENED", oid)]
            if o["status"] != "PENDING":
                continue
            if remote.get(o["x"]) in ("CANCELLED", "FAILED", "EXPIRED"):
                o["status"], signals[o["signal_id"]]["status"] = "FAILED", "FAILED_EXCHANGE"
                events.append(("ORDER_FAILED_EXCHANGE", oid))
            elif now - o["at"] >= LIMIT:
                o["status"], signals[o["signal_id"]]["status"] = "EXPIRED", "FAILED_TIMEOUT"
                events.append(("ORDER_TIMEOUT", oid))
        if was_on and not on:
            events.append(("TRADING_DISABLED", now))
    return signals, orders, executions, positions, events


def given(rng):
    """Six ticks of 25 seconds: signals of few symbols, fills (some over, some told twice), failures, and trading off for a while."""
    ticks, seq, made = [], 0, []
    for t in range(6):
        now, out = 1000 + 25 * t, []

        def say(kind, body, now=now, out=out):
            nonlocal seq
            seq += 1
            out.append((kind, now - rng.randrange(5), seq, body if isinstance(body, str) else json.dumps(body)))

        say("beat", "")
        out[-1] = ("beat", now, *out[-1][2:])
        if t == 2:
            say("trading", "off")
        if t == 4:
            say("trading", "on")
        for k in range(5):
            sid = f"s{t}{k}"
            level = rng.choice([50.0, 80.0, 120.0, -1.0])
            say("signal", {"signal_id": sid, "symbol": rng.choice("ABCDEFGHIJKLMNOP"), "breakout_level": level + 1, "retest_level": level, "atr": rng.choice([2.0, 3.0]), "rsi": 60.0, "execution_price": level + 4.0, "signal_ts": now * 10 + k})
            made.append((sid, level, json.loads(out[-1][3])["atr"]))
        for sid, level, atr in rng.sample(made, min(len(made), 4)):
            size = round(PORTFOLIO * 0.002 / (4.0 + atr), 5)
            for part in rng.choice([(1.0,), (0.5, 0.5), (0.4,), (1.5,)]):
                fill = {"exchange_order_id": f"cb_ord_{sid}", "execution_id": f"e{rng.randrange(10_000)}", "price": level + 4.0, "size": size * part, "fee": 0.1}
                for _ in range(rng.choice([1, 1, 2])):
                    say("fill", fill)
        for sid, _, _ in rng.sample(made, 2):
            say("remote", {"exchange_order_id": f"cb_ord_{sid}", "remote_status": rng.choice(["OPEN", "FAILED"])})
        ticks.append(out)
    return ticks


def test_ticks_equal_a_loop(spark, tmp_path):
    ticks = given(random.Random(5))
    src, check = f"file://{tmp_path}/src", f"file://{tmp_path}/check"
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for half in (ticks[:3], ticks[3:]):
            for messages in half:
                spark.createDataFrame(messages, MESSAGE).coalesce(1).write.mode("append").parquet(src)
            book = Book(spark, f"file://{tmp_path}/book", LIMIT, PORTFOLIO, buckets=2)  # a new process knows only the folder
            run_book(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(src), book, check).awaitTermination()
        before = {name: book.logs[name].version().batches for name in book.logs}
        book.logs["events"].append(book.table("events").limit(0).withColumn("__tick", F.lit(5)), "other", 0)
        book.take(spark.createDataFrame(ticks[-1], MESSAGE), 5)  # the last tick again
        assert {name: book.logs[name].version().batches for name in before if name != "events"} == {n: b for n, b in before.items() if n != "events"}
        signals, orders, executions, positions, events = loop(ticks)
        near = lambda x: None if x is None else round(x, 6)
        assert {r.signal_id: r.status for r in book.table("signals").collect()} == {k: s["status"] for k, s in signals.items()}
        got = {r.order_id: (r.status, near(r.executed_size), near(r.size), near(r.price), r.exchange_order_id, r.created_at) for r in book.table("orders").collect()}
        assert got == {k: (o["status"], near(o["done"]), near(o["size"]), near(o["price"]), o["x"], o["at"]) for k, o in orders.items()}
        assert {r.execution_id: (r.order_id, r.price, near(r.size)) for r in book.table("executions").collect()} == {k: (o, p, near(s)) for k, (o, p, s) in executions.items()}
        assert {r.symbol: (near(r.avg_entry), near(r.current_size), r.entry_ts, near(r.stop_price)) for r in book.table("positions").collect()} == {k: (near(c / s), near(s), at, near(stop)) for k, (c, s, at, stop) in positions.items()}
        kinds = {}
        for kind, _ in events:
            kinds[kind] = kinds.get(kind, 0) + 1
        assert {r.event_type: r["count"] for r in book.table("events").groupBy("event_type").count().collect()} == kinds
        statuses = {o["status"] for o in orders.values()}
        assert {"FILLED", "PARTIAL", "EXPIRED", "FAILED", "REJECTED_POSITION_OPEN", "REJECTED_INVALID_DATA"} <= statuses and kinds["TRADING_DISABLED"] == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_ticks_of_the_tables(spark):
    """Every signal has one order, and every customer at most one that is live or filled at a time (a filled one stays for ever)."""
    rows = stores.many_ticks(spark, SF).toPandas()
    assert rows["signal_id"].is_unique and len(rows) == spark.read.parquet(f"{SF}/orders.parquet").count()
    held = rows[rows["status"].isin(["PENDING", "PARTIAL", "FILLED"])]
    assert held["symbol"].is_unique
    assert {"FILLED", "PARTIAL", "FAILED", "EXPIRED", "REJECTED_POSITION_OPEN"} <= set(rows["status"])
