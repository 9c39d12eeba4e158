"""The versioned store, and the full refresh that ends in one of its versions."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import draws, history, refresh, store


@pytest.fixture(scope="module")
def raw(spark, sf):
    return history.raw(draws.draws(spark, sf)).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions_are_read_back(spark, raw, tmp_path):
    folder = f"file://{tmp_path}/s"
    some = raw.where("issue % 2 = 0")
    history.save(some, folder)
    assert rows(history.load_history(spark, folder)) == rows(some)
    history.save(raw, folder, "2")
    assert rows(history.load_history(spark, folder)) == rows(raw) and rows(history.load_history(spark, folder, 1)) == rows(some)
    assert history.extend(some, folder) == 3
    assert rows(history.load_history(spark, folder, 3)) == rows(raw.unionByName(some))
    assert len(store.manifest(folder, 3)["files"]) == len(store.manifest(folder, 2)["files"]) + len(store.manifest(folder, 1)["files"])
    assert store.restore(folder, 1) == 4 and rows(history.load_history(spark, folder)) == rows(some)
    table = store.versions(spark, folder).orderBy("version").collect()
    n, k = raw.count(), some.count()
    assert [(r.version, r.records) for r in table] == [(1, k), (2, n), (3, n + k), (4, k)]
    assert table[1].newest == raw.agg(F.max("issue")).first()[0] and table[1].oldest == raw.agg(F.min("issue")).first()[0]
    typed = history.parse(history.load_history(spark, folder, 2))
    assert typed.where("draw_date IS NULL OR blue IS NULL OR size(reds) <> 6").count() == 0
    with pytest.raises(ValueError, match="no version 9"):
        history.load_history(spark, folder, 9)
    assert history.malformed(spark, f"{folder}/data").count() == 0


def test_newest_is_first_and_files_are_skipped_by_id(spark, raw, tmp_path):
    folder = f"{tmp_path}/s"
    made = store.write(history._written_form(raw), folder, "期号", most=50)
    ends = [(f["newest"], f["oldest"]) for f in made["files"]]
    assert ends == sorted(ends, reverse=True) and all(a[1] >= b[0] for a, b in zip(ends, ends[1:])) and len(ends) > 1
    since = ends[0][1]
    part = store.snapshot(spark, folder, history.RAW, since=since, key="期号")
    assert part.count() == made["files"][0]["records"] and len(part.inputFiles()) < len(ends) + 1


def test_a_write_that_fails_leaves_the_old_version(spark, raw, tmp_path):
    folder = f"{tmp_path}/s"
    history.save(raw, folder)
    bad = raw.withColumn("sales", F.when(F.col("issue") == raw.first()["issue"], F.raise_error(F.lit("lost"))).otherwise(F.col("sales")))
    with pytest.raises(Exception, match="lost"):
        history.save(bad.repartition(4), folder)
    assert list(store.manifests(folder)) == [1] and rows(history.load_history(spark, folder)) == rows(raw)
    assert len(list(Path(tmp_path, "s", "data").iterdir())) == 1
    assert not [p for p in Path(tmp_path, "s", "versions").iterdir() if p.name.startswith(".")]


def test_of_two_writers_one_is_told(spark, raw, tmp_path):
    folder = f"{tmp_path}/s"
    history.save(raw.limit(3), folder)
    with pytest.raises(store.Taken):
        history.save(raw, folder, 1)
    spark.dataSource.register(store.VersionedRecords)
    late = raw.limit(1).select(F.col("issue").alias("期号")).write.format("record_versions").mode("overwrite").options(key="期号", base="0")
    with pytest.raises(Exception, match="version 1"):
        late.save(folder)
    assert history.load_history(spark, folder).count() == 3


def test_empty_and_odd_records(spark, raw, tmp_path):
    folder = f"{tmp_path}/s"
    history.save(raw.limit(0), folder)
    assert history.load_history(spark, folder).count() == 0 and store.versions(spark, folder).first()["records"] == 0
    odd = spark.createDataFrame([(None, "\n\"é日\\", "x"), ("5", None, "y"), ("5", None, "y")], "issue string, weekday string, extra string")
    history.save(odd, folder)
    got = history.load_history(spark, folder)
    assert rows(got.select("issue", "weekday", "reds")) == rows(odd.select("issue", "weekday", F.lit(None).cast("string")))


def test_vacuum_keeps_what_is_named(spark, raw, tmp_path):
    folder = f"{tmp_path}/s"
    for n in (3, 4, 5):
        history.save(raw.limit(n), folder)
    history.extend(raw.limit(2), folder)
    assert store.vacuum(folder, 2) == (2, 0)
    gone, files = store.vacuum(folder, 1, older_than=0)
    assert gone == 1 and files > 0
    assert history.load_history(spark, folder).count() == 7 and store.vacuum(folder, 1, 0) == (0, 0)
    with pytest.raises(ValueError, match="must stay"):
        store.vacuum(folder, 0)


def test_refresh_resumes_and_switches_at_once(spark, sf, raw, tmp_path):
    objects = {r["issue"]: r.asDict(recursive=True) for r in history.api_objects(draws.draws(spark, sf).where("idx < 40")).collect()}
    log, broken = str(tmp_path / "log"), tmp_path / "broken"

    def transport(params, timeout):
        if params["transactionType"] == "list":
            return {"resCode": "000000", "issue": sorted(objects, key=int, reverse=True)[: int(params["count"])]}
        with open(log, "a") as f:
            f.write(params["issue"] + "\n")
        if params["issue"] == "lost":
            return {"resCode": "9"}
        if Path(broken).exists() and int(params["issue"]) >= int(sorted(objects, key=int)[22]):
            raise RuntimeError("the line is down")
        return {"resCode": "000000"} | objects[params["issue"]]

    folder, progress = f"{tmp_path}/s", f"{tmp_path}/progress"
    history.save(raw.limit(1), folder)
    arguments = {"count": 37, "lanes": 2, "chunk": 5, "pace": refresh.Pace(0, 100, 0), "wait": lambda s: None}
    broken.write_text("")
    with pytest.raises(Exception, match="the line is down"):
        refresh.refresh(spark, transport, folder, progress, **arguments)
    assert history.load_history(spark, folder).count() == 1
    chunks = {p.name for p in Path(progress, "chunks").iterdir() if not p.name.startswith(".")}
    ids = sorted(objects, key=int)[-37:]
    done = {i for k in range(8) if f"{k:06d}.json" in chunks for i in ids[5 * k : 5 * k + 5]}
    assert 0 < len(done) < 37 and json.loads(Path(progress, "ids.json").read_text()) == ids
    broken.unlink()
    Path(log).write_text("")
    outcome = {r["issue"]: r for r in refresh.refresh(spark, transport, folder, progress, **arguments).collect()}
    assert sorted(Path(log).read_text().split()) == sorted(set(ids) - done) and not Path(progress).exists()
    assert set(outcome) == set(ids) and all(r["fetched"] and r["stored"] == (int(r["issue"]) % 7 != 0) for r in outcome.values())
    stored = history.load_history(spark, folder)
    assert {r["issue"] for r in stored.collect()} == {i for i in ids if int(i) % 7} and list(store.manifests(folder)) == [1, 2]
    with pytest.raises(ValueError, match="no ids"):
        refresh.refresh(spark, lambda params, timeout: {"resCode": "1"}, folder, progress, **arguments)


def test_too_few_answers_change_nothing(spark, tmp_path):
    def transport(params, timeout):
        return {"resCode": "000000", "issue": ["2", "1"]} if params["transactionType"] == "list" else {"resCode": "4"}

    with pytest.raises(ValueError, match="0 of 2"):
        refresh.refresh(spark, transport, f"{tmp_path}/s", f"{tmp_path}/p", wait=lambda s: None, least=0.5)
    assert not store.manifests(f"{tmp_path}/s")


def test_lanes_share_the_pace():
    pace = refresh.Pace(0.25, 100, 2.0)
    alone = sum(pace.after(k) for k in range(1, 3501))
    assert alone == 35 * 2.0 + 3465 * 0.25
    assert sum(pace.after(k, 5) for k in range(1, 701)) == alone
