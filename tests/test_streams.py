"""Streams: bounded state, repeats within and behind it, restarts, and live weights."""

import json
import os
from pathlib import Path

import pytest

from tallyforge.operators import evaluate
from tallyforge.sources import draws, history
from tallyforge.streaming import ingest


@pytest.fixture(scope="module")
def raw(spark, sf):
    return [r.asDict() for r in history.raw(draws.draws(spark, sf).where("idx < 30")).orderBy("issue").collect()]


def put(folder: Path, name: str, records: list[dict], at: int) -> None:
    (folder / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in records))
    os.utime(folder / name, (at, at))


def run(spark, source, store, checkpoint, horizon="1 hour"):
    q = ingest.ingest(spark, str(source), store, checkpoint, horizon=horizon)
    q.awaitTermination()
    return q


def test_state_is_bounded_and_repeats_are_stored_once(spark, raw, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    day, held = 1_700_000_000, []
    for k in range(6):  # each file a day later, five new records and the five before again
        put(source, f"{k}.json", raw[max(0, 5 * k - 5) : 5 * k + 5], day + 86_400 * k)
        progress = run(spark, source, store, checkpoint).recentProgress
        held += [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
        assert spark.read.parquet(store).count() == 5 * k + 5
    assert held and max(held) <= 20 and held[-1] <= 20  # of 55 records that arrived
    stored = spark.read.parquet(store)
    assert stored.select("draw_no").distinct().count() == stored.count() == 30
    assert {r["draw_no"] for r in stored.collect()} == {int(r["issue"]) for r in raw}


def test_replay_after_a_restart_changes_nothing(spark, raw, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = str(tmp_path / "store")
    put(source, "0.json", raw[:10], 1_700_000_000)
    run(spark, source, store, str(tmp_path / "cp"))
    # The last batch is done again, as if its commit had been lost; then all files, as a stream without a past.
    for gone in Path(tmp_path, "cp", "commits").iterdir():
        gone.unlink()
    run(spark, source, store, str(tmp_path / "cp"))
    run(spark, source, store, str(tmp_path / "other"))
    assert spark.read.parquet(store).count() == 10


def test_late_ids_are_taken_and_of_two_records_one_is_told(spark, raw, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "cp")
    put(source, "0.json", raw[20:], 1_700_900_000)
    run(spark, source, store, checkpoint)
    late = raw[3] | {"sales": None}
    put(source, "1.json", [late, raw[3], raw[25] | {"sales": "1"}], 1_700_900_001)
    run(spark, source, store, checkpoint)
    got = {r["draw_no"]: r for r in spark.read.parquet(store).collect()}
    assert len(got) == 11 and got[int(raw[3]["issue"])]["sales"] == int(raw[3]["sales"])
    assert got[int(raw[25]["issue"])]["sales"] == int(raw[25]["sales"])  # what is stored stays


def test_one_of_each_doesnt_depend_on_order(spark):
    rows = [(1, "a", None), (1, None, 5), (1, "b", None), (2, None, None), (None, "x", 1)]
    for own in (rows, rows[::-1]):
        got = ingest.one_of_each(spark.createDataFrame(own, "draw_no long, a string, b int"))
        assert sorted(map(tuple, got.collect())) == [(1, "b", None), (2, None, None)]


def test_live_weights_are_the_folded_ones(spark, tmp_path):
    """Batch by batch, the stream's weights and recent scores are those of the whole history so far."""
    scores = [(m, k, (3 * m + 7 * k) % 11 / 11) for m in range(3) for k in range(23)]
    source = tmp_path / "s"
    schema = "member int, idx long, score double"
    for part in ([r for r in scores if r[1] >= 15], [r for r in scores if r[1] < 15 and r[0] < 2], [r for r in scores if r[1] < 15 and r[0] == 2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = ingest.weight_stream(spark.readStream.schema(schema).parquet(str(source)))
        q = stream.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(str(tmp_path / f"out-{k}"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    newest = {}
    for k in range(3):
        newest |= {r["member"]: r for r in spark.read.parquet(str(tmp_path / f"out-{k}")).collect()}
    want = {r["member"]: r for r in evaluate.member_weights(spark.createDataFrame(scores, schema)).collect()}
    assert set(newest) == set(want) == {0, 1, 2}
    for m, r in want.items():
        assert newest[m]["n"] == 23 and newest[m]["weight"] == pytest.approx(r["weight"]) and newest[m]["recent"] == pytest.approx(r["recent"])
