"""Stores, streams with restarts, backfills and capture: broken off, repeated, replaced, and begun again."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from recallium.operators.graph_store import GraphStore
from recallium.sources import spools
from recallium.sources.backfill import Backfill
from recallium.sources.stores import BucketStore, Conflict, newest
from recallium.streaming.capture import captured_files
from recallium.streaming.limits import ROCKSDB, rate_limited_stream
from recallium.streaming.replay import in_legs, in_time_slices, replay_into, run_to_end, settings
from recallium.streaming.streams import rate_limited

STATE = {"spark__sql__streaming__stateStore__providerClass": ROCKSDB}
PAIR = "k long, revision long, seq long, v string"


def store_of(spark, path, buckets=4):
    return BucketStore(spark, f"{path}/store", ["k"], PAIR, buckets)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# Stores


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    s = store_of(spark, tmp_path, 8)
    assert s.read().count() == 0
    s.merge(spark.createDataFrame([(k, 1, k, "a") for k in range(100)], PAIR), newest(["k"], ["revision", "seq"]))
    before = s.manifest()["files"]
    s.merge(spark.createDataFrame([(5, 2, 0, "b"), (5, 1, 9, "old")], PAIR), newest(["k"], ["revision", "seq"]))
    after = s.manifest()["files"]
    assert set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1
    assert {r.k: r.v for r in s.read().collect()} == {k: "b" if k == 5 else "a" for k in range(100)}
    s.vacuum()
    assert s.read().count() == 100 and len(s.log.names()) == 1


def test_a_batch_counts_once_and_a_replaced_writer_is_fenced(spark, tmp_path):
    s = store_of(spark, tmp_path)
    row = lambda v: spark.createDataFrame([(1, 1, 1, v)], PAIR)
    keep = newest(["k"], ["revision", "seq"])
    old = s.take_over()
    assert s.merge(row("a"), keep, "s", 0, old) and not s.merge(row("z"), keep, "s", 0, old)
    new = s.take_over()
    with pytest.raises(Conflict):
        s.merge(row("b"), keep, "s", 1, old)
    assert s.merge(row("c"), keep, "s", 1, new) and s.done("s") == 1
    assert rows_of(s.read()) == [(1, 1, 1, "c")]


def test_two_writers_of_one_version_and_a_torn_manifest(spark, tmp_path):
    s = store_of(spark, tmp_path)
    keep = newest(["k"], ["revision", "seq"])
    s.merge(spark.createDataFrame([(1, 1, 1, "a")], PAIR), keep)

    def meanwhile(stored, changes):
        store_of(spark, tmp_path).merge(spark.createDataFrame([(2, 1, 1, "other")], PAIR), keep)
        return keep(stored, changes)

    with pytest.raises(Conflict):
        s.merge(spark.createDataFrame([(3, 1, 1, "lost")], PAIR), meanwhile)
    assert rows_of(s.read()) == [(1, 1, 1, "a"), (2, 1, 1, "other")]
    (tmp_path / "store/manifests/000000000003.json").write_text('{"version": 3, "fil')
    assert s.read().count() == 2
    s.merge(spark.createDataFrame([(3, 1, 1, "c")], PAIR), keep)
    assert s.read().count() == 3 and s.manifest()["version"] == 4


# Replay


def test_replay_survives_a_kill_between_store_and_checkpoint(spark, tmp_path):
    r = random.Random(4)
    intents = [(r.randrange(30), r.randrange(4), k, f"v{k}") for k in range(300)]
    store = store_of(spark, tmp_path)
    sink = replay_into(store, ["revision", "seq"])
    died = []

    def dies(batch, number):
        sink(batch, number)
        if number in (1, 3) and number not in died:
            died.append(number)
            raise RuntimeError("killed after the store has the batch, before the checkpoint has it")

    for leg in range(6):
        spark.createDataFrame(intents[leg * 50 : leg * 50 + 50], PAIR).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            try:
                run_to_end(spark.readStream.schema(PAIR).parquet(f"{tmp_path}/in"), f"{tmp_path}/check", each=dies)
                break
            except StreamingQueryException:
                continue
    assert died == [1, 3] and store.done("outbox") == 5
    best = {}
    for x in intents:
        best[x[0]] = max(best.get(x[0], x), x, key=lambda y: (y[1], y[2]))
    assert rows_of(store.read()) == sorted(best.values(), key=str)


# Limits


def test_streamed_limits_equal_the_batch_form(spark, tmp_path):
    r = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = [(k, r.choice([1, 1, 1, 2, None]), start + timedelta(seconds=r.choice([0, 0.5, 1]) + r.randrange(4000))) for k in range(600)] + [(9000 + k, 7, start + timedelta(seconds=1000 * k)) for k in range(5)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    with settings(spark, **STATE):
        in_legs(spark, in_time_slices(events, "ts", 4), str(tmp_path), lambda s: run_to_end(rate_limited_stream(s, 60, 3), f"{tmp_path}/check", f"{tmp_path}/out"))
    got = spark.read.parquet(f"{tmp_path}/out").select("event_id", "in_window", "limited")
    want = rate_limited(events, 60, 3).select("event_id", "in_window", "limited")
    assert rows_of(got) == rows_of(want) and any(x.limited for x in got.collect())
    assert len(os.listdir(f"{tmp_path}/check/commits")) >= 4
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB


def test_time_slices_cover_all_rows_once(spark):
    df = spark.createDataFrame([(k, None if k % 10 == 0 else datetime(2024, 1, 1 + k % 3)) for k in range(50)], "id long, ts timestamp_ntz")
    parts = [{r.id for r in p.collect()} for p in in_time_slices(df, "ts", 5)]
    assert sorted(x for p in parts for x in p) == list(range(50))
    assert len(in_time_slices(df.limit(0), "ts", 3)) == 1


def test_a_state_holds_a_group_of_users(spark, tmp_path):
    start = datetime(2024, 1, 1)
    events = spark.createDataFrame([(k, k * 7 % 40, start + timedelta(seconds=k * 3)) for k in range(400)], "event_id long, user_id long, ts timestamp_ntz")
    with settings(spark, **STATE):
        in_legs(spark, in_time_slices(events, "ts", 2), str(tmp_path), lambda s: run_to_end(rate_limited_stream(s, 300, 2, groups=3), f"{tmp_path}/check", f"{tmp_path}/out"))
    got = spark.read.parquet(f"{tmp_path}/out").select("event_id", "in_window", "limited")
    assert rows_of(got) == rows_of(rate_limited(events, 300, 2).select("event_id", "in_window", "limited"))


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from recallium.sources import stores

    monkeypatch.setattr(stores, "TASK_ROWS", 20)
    s = store_of(spark, tmp_path, 2)
    for v in ("a", "b"):
        s.merge(spark.createDataFrame([(k, ord(v), k, v) for k in range(300)], PAIR), newest(["k"], ["revision", "seq"]))
    assert rows_of(s.read()) == sorted([(k, ord("b"), k, "b") for k in range(300)], key=str)
    for folder in s.manifest()["files"].values():
        assert len([n for n in os.listdir(f"{s.path}/{folder}") if n.endswith(".parquet")]) > 3


# Graph


def test_graph_batch_broken_off_between_its_stores(spark, tmp_path, monkeypatch):
    at = lambda d: datetime(2024, 1, d)
    ment = "user_id string, memory_id long, name string, type string, salience double, captured_at timestamp"
    rel = "user_id string, memory_id long, source string, target string, relation string, weight double, captured_at timestamp"
    one = [("u", 1, "Ada", "p", 0.5, at(5)), ("u", 1, "ada", "p", 0.9, at(5)), ("u", 2, "Ada", "p", None, at(3)), ("v", 3, "Ada", "p", 0.1, at(9))]
    two = [("u", 2, "ADA", "p", 0.7, at(3)), ("u", 4, "ADA", "p", 0.2, at(1)), ("u", 4, "Bob", "p", 0.2, at(1))]
    pairs = [("u", 1, "Ada", "Bob", "knows", 0.4, at(5)), ("u", 2, "ada", "bob", "knows", 0.3, at(3)), ("u", 2, "ada", "Ada", "knows", 0.3, at(3))]
    more = [("u", 4, "Ada", "Bob", "knows", 0.35, at(1))]
    g = GraphStore(spark, str(tmp_path), 4)
    g.merge(spark.createDataFrame(one, ment), spark.createDataFrame(pairs, rel), 0)
    real = g.links.merge
    monkeypatch.setattr(g.links, "merge", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        g.merge(spark.createDataFrame(two, ment), spark.createDataFrame(more, rel), 1)
    monkeypatch.setattr(g.links, "merge", real)
    for _ in range(2):
        g.merge(spark.createDataFrame(two, ment), spark.createDataFrame(more, rel), 1)
    ents = {(r.user_id, r.name): (r.label, r.mention_count, r.first_seen.day, r.last_seen.day) for r in g.entities.read().collect()}
    assert ents == {("u", "ada"): ("Ada", 3, 1, 5), ("v", "ada"): ("Ada", 1, 9, 9), ("u", "bob"): ("Bob", 1, 1, 1)}
    (r,) = g.relations.read().collect()
    assert (r.weight, r.evidence_count, r.last_evidence.day) == (0.4, 3, 1)
    assert {(x.memory_id, x.name): x.salience for x in g.links.read().filter("user_id = 'u'").collect()} == {(1, "ada"): 0.9, (2, "ada"): 0.7, (4, "ada"): 0.2, (4, "bob"): 0.2}


# Backfill


def test_backfill_stopped_after_any_page_writes_each_row_once(spark, tmp_path):
    rows = [(k * 7 % 501, f"r{k}") for k in range(500)] + [(None, "no key"), (3, "same key")]
    df = spark.createDataFrame(rows, "k long, v string")
    job = Backfill(spark, str(tmp_path), "k")
    made = 0
    while not job.complete():
        with pytest.raises(RuntimeError, match="stop"):
            Backfill(spark, str(tmp_path), "k").run(df, 100, each=lambda p: (_ for _ in ()).throw(RuntimeError("stop")))
        made += Backfill(spark, str(tmp_path), "k").run(df, 100, stop_after=1)
    assert made == len(job.done()) == 6 and rows_of(job.read()) == rows_of(df)
    assert job.run(df, 7) == 0


def test_a_replaced_backfill_commits_nothing(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    first = Backfill(spark, str(tmp_path), "k")

    def replaced(page):
        Backfill(spark, str(tmp_path), "k").run(df, 50, stop_after=1)
        return page

    with pytest.raises(Conflict):
        first.run(df, 50, each=replaced)
    Backfill(spark, str(tmp_path), "k").run(df, 50)
    assert first.complete() and first.read().count() == 100


# Spools and capture


def mail(k, hour, text, sender="a"):
    import base64

    return json.dumps({"id": f"m{k}", "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "Date", "value": f"2024-01-01T{hour:02d}:00:00Z"}, {"name": "From", "value": sender}, {"name": "Subject", "value": f"s{k}"}], "parts": [{"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(text.encode()).decode()}}]}})


def test_spool_reads_mails_with_filters_pushed(spark, tmp_path):
    spools.register(spark)
    (tmp_path / "one.json").write_text("\n".join([mail(1, 1, "first"), "no mail", "", mail(2, 5, "zweite é", "b"), '{"id": "m3"}']))
    (tmp_path / "two.json").write_text(mail(4, 9, "x\ny"))
    (tmp_path / "_SUCCESS").write_text("no item")
    df = spark.read.format("spool").option("path", str(tmp_path)).option("kind", "mail").load()
    assert [(r.item_id, r.sender, r.title, r.text, r.sent and r.sent.hour) for r in sorted(df.collect(), key=lambda r: r.item_id)] == [("m1", "a", "s1", "first", 1), ("m2", "b", "s2", "zweite é", 5), ("m3", None, None, "", None), ("m4", "a", "s4", "x\ny", 9)]
    late = df.filter("sent > timestamp'2024-01-01 05:00:00'")
    assert [r.item_id for r in late.collect()] == ["m4"] and df.filter("sent >= timestamp'2024-01-01 05:00:00'").count() == 2
    assert df.filter("file = 'one.json'").count() == 3
    reader = spools.SpoolReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([spools.EqualTo(("file",), "two.json"), spools.EqualTo(("sender",), "a"), spools.GreaterThan(("sent",), datetime(2024, 1, 1, 8))]))
    assert len(rest) == 1 and [os.path.basename(p.uri) for p in reader.partitions()] == ["two.json"]
    assert spark.read.format("spool").option("path", f"{tmp_path}/none").load().count() == 0


def test_feed_items():
    rss = '<item><title>T</title><link>http://l</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate><description>&lt;p&gt;a  b&lt;/p&gt;</description></item>'
    key, sent, sender, title, text = spools.feed_item(rss)
    assert (key, sent.isoformat(), sender, title, text()) == ("http://l", "2024-01-02T02:04:05+00:00", None, "T", "a b")
    atom = '<entry xmlns="http://www.w3.org/2005/Atom"><id>i</id><updated>2024-01-02T00:00:00Z</updated><author><name>N</name></author><content>c</content></entry>'
    key, sent, sender, title, text = spools.feed_item(atom)
    assert (key, sent.hour, sender, title, text()) == ("i", 0, "N", None, "c")
    assert spools.feed_item("<item>") is None and spools.when("yesterday") is None and spools.when(None) is None


def test_spool_stream_keeps_its_cursor_over_restarts(spark, tmp_path):
    spools.register(spark)
    (tmp_path / "in").mkdir()
    put = lambda name, k, t: ((tmp_path / "in" / name).write_text(mail(k, 1, "x")), os.utime(tmp_path / "in" / name, (t, t)))
    run = lambda: run_to_end(spark.readStream.format("spool").option("path", f"{tmp_path}/in").load(), f"{tmp_path}/check", f"{tmp_path}/out")
    put("a", 1, 1000)
    put("b", 2, 2000)
    run()
    put("c", 3, 2000)  # late, with the cursor's own time
    put("d", 4, 3000)
    run()
    run()
    got = sorted(r.item_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == ["m1", "m2", "m3", "m4"]


def test_capture_of_new_changed_and_touched_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, text, t: ((tmp_path / "in" / name).write_text(text), os.utime(tmp_path / "in" / name, (t, t)))
    with settings(spark, **STATE):
        run = lambda: run_to_end(captured_files(spark, f"{tmp_path}/in"), f"{tmp_path}/check", f"{tmp_path}/out")
        put("a.md", "one", 1000)
        put("b.md", "two", 1000)
        run()
        put("a.md", "one", 2000)  # touched
        put("b.md", "two!", 2000)  # changed
        put("c.md", "", 2000)  # new and blank
        run()
        put("b.md", "two!", 3000)
        put("d.md", "late", 2000)  # the time of the last look
        run()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((os.path.basename(r.path), r.change, r.text) for r in got) == [("a.md", "new", "one"), ("b.md", "changed", "two!"), ("b.md", "new", "two"), ("c.md", "new", ""), ("d.md", "new", "late")]


# Exports


def test_chatgpt_parts_that_are_no_text(spark):
    from recallium.sources.importers import parse_export

    node = lambda t, role, parts: {"message": {"author": {"role": role}, "create_time": t, "content": {"parts": parts}}}
    chats = [{"id": "c1", "title": "t", "create_time": 1, "mapping": {"x": node(1, "user", ["look at this", {"asset_pointer": "file://1"}, 7, None, True, " \n ", "\tthen \n"]), "y": node(2, "assistant", ['"quoted"', ["no"]])}},
             {"id": "c2", "title": "image only", "create_time": 1, "mapping": {"x": node(1, "user", [{"asset_pointer": "file://2"}])}}]
    got = parse_export(spark.createDataFrame([(json.dumps(chats),)], "value string"), "chatgpt", F.lit(datetime(2024, 1, 1))).collect()
    assert [(r.source_ref, r.content) for r in got] == [("c1", 'User: look at this\nthen\n\nAssistant: "quoted"')]


def test_streams_end_without_a_time_limit():
    import inspect

    from recallium.plans import streaming_queries
    from recallium.streaming import replay

    for module in (replay, streaming_queries):
        assert "awaitTermination(6" not in inspect.getsource(module)


def test_each_leg_is_a_batch_of_its_own(spark, tmp_path):
    seen = {}
    in_legs(spark, [spark.range(3), spark.range(2)], str(tmp_path), lambda s: run_to_end(s, f"{tmp_path}/check", each=lambda b, n: seen.update({n: b.count()})))
    assert seen == {0: 3, 1: 2}
