"""Queries over the whole table: against DuckDB or brute force, without a cap on draws."""

import math
from collections import Counter
from hashlib import md5
from pathlib import Path

import duckdb
import pytest

from tallyforge.operators import evaluate, sequence
from tallyforge.plans import registry, sequence_queries
from tallyforge.sources.draws import SQL_DRAWS, draws

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same(spark, duck, name: str, sql: str) -> int:
    """Number of rows, if they are the same but for the sixth place of doubles."""
    theirs = duck.sql(SQL_DRAWS + sql).df()
    ours = registry.QUERIES[name](spark, SF).toPandas()[list(theirs.columns)]
    keys = [c for c in theirs.columns if theirs[c].dtype != float]
    ours, theirs = (x.sort_values(keys).reset_index(drop=True) for x in (ours, theirs))
    assert len(ours) == len(theirs)
    for c in theirs.columns:
        if c in keys:
            assert (ours[c] == theirs[c]).all()
        else:
            assert (ours[c] - theirs[c]).abs().max() < 2e-6
    return len(ours)


def test_hotness_of_every_draw(spark, duck):
    n = duck.sql(SQL_DRAWS + "SELECT n FROM n_draws").fetchall()[0][0]
    z = sequence_queries._Z.format(picked="SELECT idx FROM draws")
    rows = same(spark, duck, "T12_hotness", z + "SELECT idx, colour, ball, z FROM z")
    assert rows > 0.99 * n * 49


def orders(rows, n_perm: int, first: int = 0) -> dict[int, list]:
    """The rows as they are (0) and in the orders of n_perm shuffles."""
    by = {r["idx"] - first: (r["reds"], r["blue"]) for r in rows.collect()}
    key = lambda p, i: (md5(f"1:{p}:{i}".encode()).hexdigest(), i)
    return {0: [by[k] for k in sorted(by)]} | {p: [by[i] for i in sorted(by, key=lambda i: key(p, i))] for p in range(1, n_perm + 1)}


def test_permutations_are_refitted_by_fold(spark, sf):
    def hits(seq) -> int:
        val, n = int(len(seq) * (1 - 0.85) / 4), 0
        for k in range(4):
            c = Counter(b for reds, _ in seq[(k + 1) * val :] for b in reds)
            best = set(sorted(c, key=lambda b: (-c[b], b))[:6])
            n += sum(len(best & set(reds)) for reds, _ in seq[k * val : (k + 1) * val])
        return n

    rows = draws(spark, sf).select("idx", "reds", "blue").cache()
    h = {p: hits(seq) for p, seq in orders(rows, 500).items()}
    got = registry.QUERIES["V8_permutation_test"](spark, sf).first()
    assert got["p"] == sum(h[p] >= h[0] for p in range(1, 501)) / 500
    assert got["observed"] == pytest.approx(h[0] / (4 * int(rows.count() * (1 - 0.85) / 4)), abs=1e-6)


def test_hotness_is_held_against_a_thousand_shuffles(spark, sf):
    def extreme(seq) -> float:
        w = [math.exp(-math.log(2) * k / 50) for k in range(len(seq))]
        e, most = sum(w), 0.0
        for balls, p, has in ((range(1, 34), 6 / 33, lambda x, b: b in x[0]), (range(1, 17), 1 / 16, lambda x, b: b == x[1])):
            for b in balls:
                s = sum(v for v, x in zip(w, seq) if has(x, b))
                most = max(most, abs((s / e - p) / math.sqrt(p * (1 - p) / e)))
        return round(most, 9)

    rows = draws(spark, sf).where("idx BETWEEN 1 AND 150").select("idx", "reds", "blue").cache()
    z = {p: extreme(seq) for p, seq in orders(rows, 1000, 1).items()}
    got = registry.QUERIES["V9_permutation_hotness"](spark, sf).first()
    assert got["p"] == sum(z[p] >= z[0] for p in range(1, 1001)) / 1000
    assert got["observed"] == pytest.approx(z[0], abs=1e-6)


def test_probability_of_every_draw(spark, duck):
    sql = """, f AS (SELECT 'red' AS colour, ball, count(*)::DOUBLE AS c FROM balls GROUP BY ball UNION ALL SELECT 'blue', blue, count(*) FROM draws GROUP BY blue),
    l AS (SELECT colour, ball, log10(c / sum(c) OVER (PARTITION BY colour)) AS l FROM f)
    SELECT idx, sum(l) AS log10_p FROM (SELECT idx, 'red' AS colour, ball FROM balls UNION ALL SELECT idx, 'blue', blue FROM draws) JOIN l USING (colour, ball) GROUP BY idx"""
    assert same(spark, duck, "M3_combination_probability", sql) == duck.sql(SQL_DRAWS + "SELECT n FROM n_draws").fetchall()[0][0]


def test_matrix_product_of_every_embedding(spark, duck):
    sql = """SELECT i, j, sum(x * ((7 * k + 11 * j) % 13 - 6) / 6.0::DOUBLE) AS value FROM (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), (SELECT j::INT AS j FROM range(8) t(j)) GROUP BY i, j"""
    assert same(spark, duck, "N1_matrix_product", sql) == 8 * duck.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]


def test_members_fold_over_blocks(spark):
    scores = [(m, k * 3, ((m + 1) * k * 7 % 11) / 10) for m in range(2) for k in range(3 - 2 * m, 2900)]
    got = {r["member"]: r for r in evaluate.member_weights(spark.createDataFrame(scores, "member int, idx long, score double")).collect()}
    for m in range(2):
        own, w = [s for _, _, s in sorted((x for x in scores if x[0] == m), reverse=True)], 1.0
        for s in own:
            w = 0.9 * w + 0.1 * s
        assert got[m]["weight"] == pytest.approx(w) and got[m]["recent"] == pytest.approx(sum(own[-10:]) / 10)


def test_hotness_orders_a_block_once(spark, sf):
    """No window over rows of single balls: a block's draws are sorted, not 49 times as many rows."""
    plan = sequence.hotness_of_all(draws(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    own = [line for line in plan.splitlines() if "Window [" in line]
    assert own and not any("colour" in line or "ball#" in line for line in own)
