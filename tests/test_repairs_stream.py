"""Repairs released once: the stream against the whole and against a plain loop, with repeated and late evidence."""

import random

from hearthledger.streaming import repairs as R

ROWS = "repair_id long, version long, evidence_hash string"


def plain(batches):
    state, out = {}, []
    for batch in batches:
        for r, v, h in sorted((x for x in batch if x[0] is not None and x[1] is not None), key=lambda x: (x[0], x[1], x[2] or "")):
            if r not in state:
                state[r] = (v, h, h is None)
                if h is None:
                    out.append((r, v, None, None, "ignored"))
            elif not state[r][2] and v > state[r][0] and h != state[r][1]:
                out.append((r, v, state[r][1], h, "ignored" if h is None else "released"))
                state[r] = (v, state[r][1], True)
    return sorted(out, key=str)


def some(seed, n, start):
    rng = random.Random(seed)
    return [(rng.randrange(12), start + i, rng.choice(["a", "a", "a", "b", None])) for i in range(n)]


def tuples(df):
    return sorted(((r.repair_id, r.version, r.before, r.after, r.outcome) for r in df.collect()), key=str)


def test_all_at_once(spark):
    rows = [*some(1, 80, 0), (None, 1, "a"), (3, None, "b"), (50, 1, "a"), (50, 2, "a")]
    assert tuples(R.released_once(spark.createDataFrame(rows, ROWS))) == plain([rows])
    assert R.released_once(spark.createDataFrame([], ROWS)).count() == 0


def test_stream_releases_once(spark, tmp_path):
    batches = [some(2, 10, 0), some(3, 10, 20), [(i, 5, "late") for i in range(12)], some(4, 30, 40), [(r, v, h) for r, v, h in some(4, 30, 40)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = R.released_stream(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")))
            # Each run takes up where the one before stopped, from its checkpoint.
            run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            run.awaitTermination(120)
            assert not run.isActive, i
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = tuples(spark.read.parquet(str(tmp_path / "out")))
    assert got == plain(batches)
    assert len({r[0] for r in got}) == len(got)
